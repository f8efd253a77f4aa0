"""Target-distribution importance resampling with a dictionary of distinct n-gram strings.

Features are runs of one to three words. Each block of documents has a dictionary: its distinct strings are
numbered, counted, and hashed once each, a longer run's crc32 following from those of its parts. Buckets sum the
counts of all blocks; a bucket's gain is the log ratio of its share in the target and in the documents. Gains are
joined back to the documents' feature counts through the dictionary, and a document's weight is the sum over them. With
Gumbel noise of a seeded hash the highest scores are a draw without replacement in proportion to exp(weight / 1000).

One dictionary over all documents was built first; a shuffle of its strings takes several times the input on disk (the
README has the figures), so dictionaries meet by their buckets: a task sends a row for each bucket and nothing else.

Ranks come from one range partitioning by score: rows are numbered within their range, and ranges are shifted by
the sizes of those before.

Defined cases: a null text, or one without words, has no features and weight 0; an empty target gives the gains of
smoothing alone; an empty table gives an empty result; repeated rows are scored each, and equal rows are drawn one
after the other; a null id is hashed as an empty one and comes last among ties; long texts are counted whole; carried
columns travel in a struct, so their names clash with nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, written
from .urls import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_word, _lower = re.compile(WORD), str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Settings:
    longest: int = 3
    buckets: int = 10_000
    least_words: int = 20
    per_cent: int = 5
    seed: str = "42"


#: Characters of text whose words and n-grams are numbered together; a longer text is a block of its own.
BLOCK = 4_000_000
_advance: list[np.ndarray] = []


def advances(k: int) -> np.ndarray:
    """What 2**k zero bytes behind a message do to its crc32: a table for each of the four bytes."""
    while len(_advance) <= k:
        if not _advance:
            low = np.arange(256, dtype=np.uint32)
            for _ in range(8):
                low = np.where(low & 1, (low >> 1) ^ np.uint32(0xEDB88320), low >> 1)
            moved = [low, *[np.arange(256, dtype=np.uint32) << np.uint32(8 * (j - 1)) for j in (1, 2, 3)]]
            _advance.append(np.stack(moved))
        else:
            last = _advance[-1]
            _advance.append(np.stack([moved_on(row, last) for row in last]))
    return _advance[k]


def moved_on(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    a, b, c, d = (tables[j][(crc >> np.uint32(8 * j)) & np.uint32(255)] for j in range(4))
    return a ^ b ^ c ^ d


def joined_crc(crc: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two strings behind each other, from that of each and the second one's length in bytes."""
    crc, k = crc.copy(), 0
    while np.any(length >> k):
        odd = np.flatnonzero((length >> k) & 1)
        crc[odd] = moved_on(crc[odd], advances(k))
        k += 1
    return crc ^ tail


@dataclass(frozen=True)
class Block:
    """Words of some texts, and for each length of runs: the text of each run, its number, and the numbers' crc32."""

    words: np.ndarray
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def numbered(texts: list[str], longest: int) -> Block:
    """A dictionary of the distinct runs of these texts; each distinct string gets its crc32 once."""
    found = [_word.findall(t.translate(_lower)) for t in texts]
    words = np.array([len(w) for w in found], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), words)
    coded = pa.array([w for some in found for w in some], pa.string()).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.array([zlib.crc32(w) for w in names], dtype=np.uint32)
    behind = np.array([zlib.crc32(b" " + w) for w in names], dtype=np.uint32)
    length = np.array([len(w) + 1 for w in names], dtype=np.int64)
    runs, number = [(text, code, crc)], code
    for n in range(2, longest + 1):
        here = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) if len(text) >= n else np.array([], dtype=np.int64)
        # runs that are one word shorter start at places of their own, so they are found by their start
        start = np.zeros(len(text), dtype=np.int64)
        start[runs_at if n > 2 else slice(None)] = number
        keys, number = np.unique(start[here] * max(len(names), 1) + code[here + n - 1], return_inverse=True)
        head, last = np.divmod(keys, max(len(names), 1))
        crc = joined_crc(crc[head], behind[last], length[last])
        runs.append((text[here], number, crc))
        runs_at = here
    return Block(words, runs)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of BLOCK characters, or of one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(texts: DataFrame, by: Settings) -> DataFrame:
    """(bucket, n) from texts (text): each task counts distinct strings block by block and sends a row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(by.buckets, dtype=np.int64)
        for b in batches:
            rows = b.column("text").to_pylist()
            for i, j in blocks(rows):
                for _, number, crc in numbered(rows[i:j], by.longest).runs:
                    np.add.at(total, crc % by.buckets, np.bincount(number, minlength=len(crc)))
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(total[bucket], pa.int64())], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(ours: DataFrame, target: DataFrame, by: Settings) -> DataFrame:
    """(bucket, gain) of all buckets, from the counts of both."""
    every = ours.sparkSession.range(by.buckets).select(F.col("id").alias("bucket"))
    s, t = ours.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    rows = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    total = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = lambda n, of: (F.col(n) + 1).cast("double") * (F.col(of) + by.buckets).cast("double")
    return rows.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.log(share("t", "all_s") / share("s", "all_t")) * 1000).alias("gain"))  # one row


def weighed(rows: DataFrame, gain: np.ndarray, by: Settings) -> DataFrame:
    """rows (text and others) with n_words, n_features and weight instead of the text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            words, features, weight = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for i, j in blocks(texts):
                block = numbered(texts[i:j], by.longest)
                words[i:j] = block.words
                for text, number, crc in block.runs:
                    features[i:j] += np.bincount(text, minlength=j - i)
                    np.add.at(weight, text + i, gain[crc % by.buckets][number])
            own = [b.column(c) for c in b.schema.names if c != "text"]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(words), pa.array(features), pa.array(weight)], [*names, "n_words", "n_features", "weight"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, T.LongType())
    return rows.mapInArrow(weigh, schema)


def noise(id_: Column, seed: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, by: Settings) -> DataFrame:
    """rows (id, eligible, score and others) with their rank among the drawn."""
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()]
    placed = rows.withColumn("twin", F.monotonically_increasing_id()).repartitionByRange(*order, "twin").withColumn("part", F.spark_partition_id())
    placed = written(placed, "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"), F.count_if("eligible").alias("able"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))  # a row for each range
    most = sizes.agg(F.coalesce(F.floor(F.sum("able") * by.per_cent / 100), F.lit(0)).alias("most"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered = placed.join(F.broadcast(starts), "part").crossJoin(F.broadcast(most)).withColumn("place", place)
    return numbered.withColumn("rank", F.when(F.col("eligible") & (F.col("place") <= F.col("most")), F.col("place")))


def resampled(docs: DataFrame, target: DataFrame, by: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns of every document with (n_features, weight, score, rank); rank is null where it is not drawn."""
    text = text_or_empty(f"`{text_column}`").alias("text")
    ours, theirs = (written(bucket_counts(df.select(text), by), "buckets") for df in (docs, target))  # read twice
    told = gains(ours, theirs, by)
    gain = np.zeros(by.buckets, dtype=np.int64)
    for r in told.collect():  # a row for each bucket, so by.buckets at most
        gain[r.bucket] = r.gain
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(f"`{id_column}`").alias("id"), text)
    scored = weighed(rows, gain, by).withColumn("score", F.col("weight") + noise(F.col("id"), by.seed)).withColumn("eligible", F.col("n_words") >= by.least_words)
    # ranges are sampled before rows are sent, which would weigh every text twice
    return ranked(written(scored, "scored"), by).select("doc.*", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))
