"""Language identification by rank-order profiles of character n-grams.

Every language has a profile: its most frequent n-grams of one to three letters, in order of frequency. A
document's own most frequent n-grams are ranked in the same way, and the language whose ranks are least out
of place wins. An n-gram that the profile lacks counts as out of place by the profile's length.

Defined cases: a text that is null or has no letter is `und` with score 0, as is any text when nothing was
learned; equal distances go to the language whose name comes first; equal frequencies are ranked by n-gram; an
empty table gives an empty result; repeated rows are predicted alike, and those of one id are all learned from,
but a row without an id is only predicted;
very long texts are counted whole; other columns of the input are not looked at.
The prediction is a function of the text and the profiles alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile and ranked in a document.
PROFILE = 400
#: Documents of one language that a profile is learned from at most: those of the smallest hashed ids.
SAMPLE_PER_LANGUAGE = 400
BITS = 21
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text as numbers, and their counts. Runs of other characters are one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter_table()[points]
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = np.where(is_letter, points.astype(np.int64) + 1, 1)
    codes = np.concatenate(([1], codes, [1]))  # 1 is the gap; letters are above it
    codes = codes[np.append(True, (codes[1:] != 1) | (codes[:-1] != 1))]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    grams = np.concatenate((codes[codes > 1], (codes[:-1] << BITS) | codes[1:], ((a << 2 * BITS) | (b << BITS) | c)[b > 1]))
    return np.unique(grams, return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent, ties by number; grams are sorted."""
    return grams[np.argsort(-counts, kind="stable")[:k]]


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], size: int = PROFILE) -> "Profiles":
        languages = sorted(ranked)
        grams = np.unique(np.array([g for x in languages for g in ranked[x]], dtype=np.int64))
        ranks = np.full((len(languages), len(grams)), -1, dtype=np.int64)
        for i, language in enumerate(languages):
            ranks[i, np.searchsorted(grams, ranked[language])] = np.arange(len(ranked[language]))
        return cls(languages, grams, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngram_counts(text or "")
        if not len(grams) or not self.languages:
            return "und", 0.0
        own = top(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = np.where(self.grams[at] == own, self.ranks[:, at], -1)
        apart = np.where(theirs >= 0, np.abs(theirs - np.arange(len(own))), self.size).sum(axis=1)
        best = int(np.argmin(apart))
        return self.languages[best], 1.0 - float(apart[best]) / (self.size * len(own))


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def learn(docs: DataFrame, size: int = PROFILE, per_language: int = SAMPLE_PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> Profiles:
    """Profiles of the languages in docs, each from a bounded sample of whole texts.

    The sample is taken on ids: about how many a language has gives the share of the hashes that holds twice as many
    as are wanted, so only those are sorted, each once, however many tasks or repeated rows there are. At most per_language ids of each language go
    to every task, and no text is moved. N-grams are summed in each task and then by key.
    """
    ids = docs.where(F.col(language_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(language_column).alias("lang"), F.xxhash64(id_column).alias("h"))
    share = ids.groupBy("lang").agg((F.lit(2.0 * per_language) / F.approx_count_distinct("id")).alias("share"))
    place = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "id")
    few = ids.join(F.broadcast(share), "lang").where(F.shiftrightunsigned("h", 11) < F.col("share") * float(1 << 53)).select("id", "lang", "h").distinct()
    sample = few.select("id", "lang", F.row_number().over(place).alias("n")).where(F.col("n") <= per_language).select("id", "lang")
    texts = docs.select(F.col(id_column).alias("id"), F.col(language_column).alias("lang"), F.col(text_column).alias("text")).join(F.broadcast(sample), ["id", "lang"], "left_semi")

    def count(batches):
        for batch in batches:
            total: dict[str, list] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(language, []).append(ngram_counts(text or ""))
            for language, parts in total.items():
                grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.select("lang", "gram", F.row_number().over(rank).alias("r")).where(F.col("r") <= size)
    ranked: dict[str, list[tuple[int, int]]] = {}
    for row in best.collect():  # size rows a language
        ranked.setdefault(row.lang, []).append((row.r, row.gram))
    return Profiles.of({k: [g for _, g in sorted(v)] for k, v in ranked.items()}, size)


def predict(docs: DataFrame, profiles: Profiles, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of each document."""

    def run(batches):
        for batch in batches:
            found = [profiles.predict(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[id_column, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(id_column, held_out(id_column).alias("held_out"), text_column)
    return chosen.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, lang_pred string, score double")
