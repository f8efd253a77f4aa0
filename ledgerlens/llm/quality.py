"""A quality classifier whose prior is learned from hosts and paths by hierarchical empirical Bayes.

A logistic model on counts of characters and words gives each document's own evidence. Grouped sums of its
probabilities give every host, and every path within a host, a posterior rate of good documents: a Beta
prior around the parent's rate, whose strength is estimated from how much siblings differ beyond chance
(method of moments). A site with few documents therefore stays near its parent, and the root is the rate of
all documents. A document's score joins its evidence with its path's rate, its own part left out.

Defined cases: null host and path are the empty name; a document without words has score 0 and is rejected;
without labels of both kinds the model has no evidence and the site rates decide; repeated rows count each in
the rates, and once, by their least features, in the fit; a tie at the threshold is kept; an empty table gives
an empty result; very long texts are counted whole; other columns keep their names and values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import shingles as sh
from .common import written

#: Labelled documents that the model is fitted on at most: those of the smallest hashed ids.
TRAINING_ROWS = 20_000
THRESHOLD = 0.5
#: Bounds of a prior's strength in documents, and of a probability before its logit is taken.
STRENGTH = (2.0, 10_000.0)
EDGE = 1e-4
SITE = ("host", "path")

CLASSES = np.full(256, 5)
CLASSES[[*range(65, 91)]] = 0  # capitals
CLASSES[[*range(97, 123)]] = 1  # small letters
CLASSES[[*range(48, 58)]] = 2  # digits
CLASSES[[ord(c) for c in ".,;:'\"-?()"]] = 3  # common punctuation
CLASSES[[ord(c) for c in " \t\r\n"]] = 4
CLASSES[[*range(128, 256)]] = 6
FEATURES = ("log_words", "capitals", "digits", "punctuation", "other_signs", "beyond_ascii", "line_rate", "word_length", "repeats_next", "distinct", "repeats_line")


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; texts without words have a first feature of 0."""
    values, offsets = sh.utf8(column)
    out = np.zeros((len(column), len(FEATURES)))
    for i, j in sh.chunks(offsets):
        own, bounds = values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.maximum(np.diff(bounds), 1)
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        kinds = np.bincount(row * 7 + CLASSES[own], minlength=7 * (j - i)).reshape(-1, 7)
        hashes, counts = sh.words(own, bounds)
        many = np.maximum(counts, 1)
        owner = np.repeat(np.arange(j - i), counts)
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        order = np.argsort(hashes)
        order = order[np.argsort(owner[order], kind="stable")]
        again = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        lines, line_row = sh.line_bounds(own, bounds)
        line_words, line_counts = sh.words(own, lines)
        keys = np.zeros(len(line_counts), dtype=np.uint64)
        keys[line_counts > 0] = sh.set_keys(line_words, line_counts)
        place = np.lexsort((keys, line_row))
        twice = (keys[place][1:] == keys[place][:-1]) & (line_row[place][1:] == line_row[place][:-1]) & (keys[place][1:] != 0)
        n_lines = np.bincount(line_row, minlength=j - i)
        block = out[i:j]
        block[:, 0] = np.log1p(counts)
        for at, kind in enumerate((0, 2, 3, 5, 6), start=1):
            block[:, at] = kinds[:, kind] / size
        block[:, 6] = n_lines / many
        block[:, 7] = (size - kinds[:, 4]) / many
        block[:, 8] = np.bincount(owner[1:][same], minlength=j - i) / many
        block[:, 9] = 1 - np.bincount(owner[order][1:][again], minlength=j - i) / many
        block[:, 10] = np.bincount(line_row[place][1:][twice], minlength=j - i) / np.maximum(n_lines, 1)
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def text_features(texts: pa.Array) -> pa.Array:
    rows = features(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.reshape(-1)))


@dataclass(frozen=True)
class Model:
    """A logistic model on standardised features."""

    weights: list[float]
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> "Model":
        """Penalised Newton steps."""
        if len(y) == 0 or y.min() == y.max():
            return cls([0.0] * len(FEATURES), 0.0)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
        w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [penalty] * x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        plain = w[1:] / scale
        return cls([float(v) for v in plain], float(w[0] - plain @ mean))

    def logit(self, column: str) -> Column:
        terms = [F.lit(w) * F.get(F.col(column), i) for i, w in enumerate(self.weights)]
        return sum(terms, F.lit(self.bias))


def bounded(p: Column) -> Column:
    return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))


def logit(p: Column) -> Column:
    return F.log(bounded(p) / (1 - bounded(p)))


def fit(known: DataFrame, labels: DataFrame, id_column: str, label_column: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """The model from a bounded sample of labels; known holds (id, features)."""
    said = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("double")).alias("y"))
    sample = said.orderBy(F.xxhash64("id"), "id").limit(rows)
    got = known.select(F.col(id_column).alias("id"), "features").join(F.broadcast(sample), "id").groupBy("id").agg(F.min(F.struct("y", "features")).alias("r")).orderBy("id").select("r.*").toArrow()
    x = np.array(got.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy()
    keep = x[:, 0] > 0
    return Model.fit(x[keep], y[keep])


def strength(sites: DataFrame, rate: str) -> float:
    """Method of moments: how many documents the parent's rate counts as for a site."""
    chance = F.col(rate) * (1 - F.col(rate))
    apart = (F.col("good") / F.col("n") - F.col(rate)) ** 2
    found = sites.agg(F.sum(F.col("n") * apart).alias("apart"), F.sum(chance).alias("chance"), F.sum(F.col("n") * chance).alias("weighted"), F.sum("n").alias("n")).first()
    if not found.n:
        return STRENGTH[1]
    beyond, within = max(0.0, (found.apart - found.chance) / found.n), found.weighted / found.n
    return min(max(within / beyond - 1 if beyond > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1])


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, good, parent, strength) of each path, and the rate of all: scored holds SITE and p."""
    paths = written(scored.groupBy(*SITE).agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    base = min(max(total.good / total.n if total.n else 0.5, EDGE), 1 - EDGE)
    hosts = hosts.withColumn("base", F.lit(base))
    k = strength(hosts, "base")
    hosts = hosts.select("host", ((F.col("good") + k * base) / (F.col("n") + k)).alias("parent"))
    paths = paths.join(hosts, "host")
    return written(paths.withColumn("strength", F.lit(strength(paths, "parent"))), "rates"), base


def judged(rows: DataFrame, model: Model, sites: DataFrame, base: float) -> DataFrame:
    """rows (SITE, features) with p, site_rate, score and keep."""
    rows = rows.withColumn("p", own_probability(model)).join(sites, list(SITE), "left")
    # a document's own probability is left out of its path's rate
    rate = (F.col("good") - F.col("p") + F.col("strength") * F.col("parent")) / (F.col("n") - 1 + F.col("strength"))
    rows = rows.withColumn("site_rate", F.coalesce(bounded(rate), F.lit(base)))
    score = 1 / (1 + F.exp(-(logit(F.col("p")) - logit(F.lit(base)) + logit(F.col("site_rate")))))
    rows = rows.withColumn("score", F.when(F.get("features", F.lit(0)) > 0, score).otherwise(0.0))
    return rows.withColumn("keep", F.col("score") >= THRESHOLD).drop("n", "good", "parent", "strength")


def own_probability(model: Model) -> Column:
    return F.when(F.get("features", F.lit(0)) > 0, bounded(1 / (1 + F.exp(-model.logit("features"))))).otherwise(EDGE)


def site_columns(docs: DataFrame, host: Column, path: Column, text_column: str) -> DataFrame:
    return docs.withColumns({"host": F.coalesce(host.cast("string"), F.lit("")), "path": F.coalesce(path.cast("string"), F.lit("")), "features": text_features(F.coalesce(F.col(text_column), F.lit("")))})


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, host, path, p, site_rate, score, keep) of each document."""
    rows = written(site_columns(docs.select(id_column, text_column, host.alias("h"), path.alias("g")), F.col("h"), F.col("g"), text_column).select(id_column, *SITE, "features"), "features")
    model = fit(rows, labels, id_column)
    sites, base = site_rates(rows.select(*SITE, own_probability(model).alias("p")))
    return judged(rows, model, sites, base).select(id_column, *SITE, "p", "site_rate", "score", "keep")


def kept(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    own = [F.col(f"doc.`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*docs.columns).alias("doc"), host.alias("h"), path.alias("g"), F.col(text_column).alias("t"), F.col(id_column).alias("i"))
    known = written(site_columns(rows, F.col("h"), F.col("g"), "t").select("doc", "i", *SITE, "features"), "features")
    model = fit(known, labels.select(F.col(id_column).alias("i"), "quality"), "i")
    sites, base = site_rates(known.select(*SITE, own_probability(model).alias("p")))
    return judged(known, model, sites, base).where("keep").select(*own)
