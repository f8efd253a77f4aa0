"""Near-duplicate classes of documents or paragraphs: MinHash bands, Bayesian pruning, exact verification.

Units of text (whole documents, or their lines) become sets of word shingles. Equal sets are one node, so
copies are never compared. Nodes that share a band of their MinHash signature are candidates:

* In each bucket the node that shares the most buckets overall is the centre; every member is paired with it.
* A pair's signatures are compared batch by batch, and it is dropped once the posterior chance of the wanted
  similarity is below the chosen miss probability. Survivors are verified on the full sets.
* Two members of a bucket may be similar although one of them is not similar to the centre. The symmetric
  difference is a metric, and x and y differ by D(x) ^ D(y) if D(x) is what x and the centre do not share.
  So a similar pair whose one side failed must share more than half of the other side's differences
  (`least_shared`). An index over each member's rarest differences finds all such pairs of different classes;
  they are pruned and verified like the others. No bucket is capped and no bucket's pairs are all emitted.

Similar pairs are links, and linked nodes form classes by label propagation.

Defined cases: a null or wordless unit has the empty set and is linked with nothing; a unit of fewer words
than a shingle has one shingle of all its words; A-Z are lowered, words end at space and the control
characters 9 to 13. A pair at the threshold is missed by all bands with the chance `miss_chance` states.
Repeated rows are units of their own with equal sets; rows of one id and position count as one in what is removed.
An empty table gives an empty result; very long texts are cut into shingles whole, one at a time; ties of centres
go to the larger node and those of classes to the least id; other columns, whatever their names, are not looked at.
Nodes are 64-bit hashes of sets: n distinct sets hold n * n / 2**65 false equalities on average.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import checkpoint, drop, written
from .passages import shared_passages

#: Signature values compared before each look at the posterior.
BATCH = 32
#: Words of 64 bits in the bitmap that stands for a member's differences where pairs are found.
BITMAP_WORDS = 16
#: One node in so many is looked at to find buckets that would fill a task.
LOOK = 64


@dataclass(frozen=True)
class Settings:
    """shingle: words in a shingle; percent: the least Jaccard similarity; bands of rows; miss: the posterior
    chance of similarity below which a candidate is dropped; lines: units are lines, not whole texts;
    least_words: shorter units are left alone."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    miss: float = 1e-7
    lines: bool = False
    least_words: int = 1

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def miss_chance(self) -> float:
        """The chance that no band of a pair at the threshold agrees."""
        return (1 - (self.percent / 100) ** self.rows) ** self.bands

    def least_matches(self) -> list[int]:
        """For each batch end, the matches below which a pair is dropped.

        Under a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), whose upper
        tail at t is the chance of at most m successes in n + 1 trials of chance t. Signature values are
        cut to 16 bits; chance agreements only add matches.
        """
        t, out = self.percent / 100, []
        for n in range(BATCH, self.size + 1, BATCH):
            tail, m = 0.0, 0
            while m <= n:
                tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if tail >= self.miss:
                    break
                m += 1
            out.append(m)
        return out


def bands_for(percent: int, rows: int, miss: float) -> int:
    """The fewest bands that miss a pair at the threshold with at most the given chance."""
    bands = 1
    while (1 - (percent / 100) ** rows) ** bands > miss:
        bands += 1
    return bands


def each_unit(batch: pa.RecordBatch, text_index: int, cfg: Settings):
    """Chunk by chunk: each unit's row in the batch, position, number of words, shingles and their counts."""
    values, offsets = sh.utf8(batch.column(text_index))
    for i, j in sh.chunks(offsets):
        own = values[offsets[i] : offsets[j]]
        bounds, row = offsets[i : j + 1] - offsets[i], np.arange(j - i)
        if cfg.lines:
            bounds, row = sh.line_bounds(own, bounds)
        position = np.arange(len(row)) - np.searchsorted(row, row) if cfg.lines else np.zeros(len(row), dtype=np.int64)
        hashes, counts = sh.words(own, bounds)
        if cfg.least_words > 1:
            short = counts < cfg.least_words
            hashes, counts = hashes[~np.repeat(short, counts)], np.where(short, 0, counts)
        found, number = sh.shingles(hashes, counts, cfg.shingle)
        yield row + i, position, counts, found, number


def units(docs: DataFrame, cfg: Settings, id_column: str, text_column: str) -> DataFrame:
    """(id, position, n_shingles, node, signature) of each unit, written to the shared folder.

    A signature is given once for each node and task, two bytes a value. Sets too small to be similar to any
    other have none: the likest other set has one shingle more, and n / (n + 1) must reach the threshold.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for row, position, _, found, number in each_unit(batch, 1, cfg):
                some = number > 0
                keys = sh.set_keys(found, number).view(np.int64)
                node = np.zeros(len(number), dtype=np.int64)
                node[some] = keys
                fresh, able = np.zeros(len(number), dtype=bool), 100 * number >= cfg.percent * (number + 1)
                for u, key in zip(np.flatnonzero(some).tolist(), keys.tolist(), strict=True):
                    if able[u] and key not in seen:
                        seen.add(key)
                        fresh[u] = True
                new = number * fresh
                signature = sh.signatures(found[np.repeat(fresh, number)], new, cfg.size)
                cut = iter(signature.astype(np.uint16))
                raw = pa.array([next(cut).tobytes() if f else None for f in fresh], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(position, pa.int32()), pa.array(number, pa.int64()), pa.array(node, mask=~some), raw],
                    names=["id", "position", "n_shingles", "node", "signature"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, position int, n_shingles bigint, node bigint, signature binary")
    return written(rows, "units")


def shared_buckets(found: DataFrame, cfg: Settings) -> DataFrame:
    """(key, node) of the buckets that hold more than one node; a key is a hash of a band's bytes.

    Members are dealt by key once; counting and joining both read that exchange. A bucket that a look at some
    nodes shows to be larger than a quarter of a task's share is known to hold several nodes, and its members
    are not dealt at all. There are at most four such buckets for each shuffle partition.
    """
    width = 2 * cfg.rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(cfg.bands)])
    signed = found.where(F.col("signature").isNotNull())
    members = signed.select("node", F.explode(keys).alias("key"))
    look = signed.where(F.pmod(F.xxhash64("node"), F.lit(LOOK)) == 0)
    share = max(2, look.count() * cfg.bands // (4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    seen = look.select("node", F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    hot = F.broadcast(written(seen.where((F.col("n") > share) & (F.col("lo") != F.col("hi"))).select("key"), "hot-buckets"))
    dealt = members.join(hot, "key", "left_anti").repartition("key")
    sizes = dealt.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    return written(dealt.join(sizes, "key").select("key", "node").unionByName(members.join(hot, "key").select("key", "node")), "buckets")


def stars_of(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b) of centres and their nodes, written: in each bucket the node with the most company in all its buckets is the centre.

    Sizes and centres are written, so that each join has an exchange on either side and a large bucket can be split;
    they go as soon as what is made from them is written.
    """
    sizes = written(buckets.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    company = buckets.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("score"))
    scored = buckets.join(company, "node")
    centres = written(scored.groupBy("key").agg(F.max(F.struct("score", "node")).alias("c")).select("key", F.col("c.node").alias("centre")), "centres")
    drop(sizes)
    stars = written(buckets.join(centres, "key").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    drop(centres)
    return stars


def prune(pairs: DataFrame, signatures: DataFrame, cfg: Settings) -> DataFrame:
    """The pairs (a, b) that no batch of signature values drops."""
    least = cfg.least_matches()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(n, -1) for i in (2, 3))
            alive, matches = np.arange(n), np.zeros(n, dtype=np.int64)
            for k, bound in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
                alive, matches = alive[matches >= bound], matches[matches >= bound]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["a", "b"])

    sides = signatures.select("node", "signature")
    both = pairs.join(sides.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(sides.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, cfg: Settings, id_column: str, text_column: str) -> DataFrame:
    """(node, n, hashes) for the wanted (id, position, node), from the documents' texts."""
    places = wanted.groupBy("id").agg(F.collect_list("position").alias("positions"))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(places, "id").select("text", "positions")

    def run(batches):
        for batch in batches:
            asked = [set(p) for p in batch.column(1).to_pylist()]
            for row, position, _, found, number in each_unit(batch, 0, cfg):
                keys = iter(sh.set_keys(found, number).view(np.int64).tolist())
                ends = np.cumsum(number)
                nodes, sizes, sets = [], [], []
                for r, p, n, end in zip(row.tolist(), position.tolist(), number.tolist(), ends.tolist(), strict=True):
                    if n and ((key := next(keys)) or True) and p in asked[r]:
                        nodes.append(key)
                        sizes.append(n)
                        sets.append(found[end - n : end].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "n", "hashes"])

    return texts.mapInArrow(run, "node bigint, n bigint, hashes binary").dropDuplicates(["node"])


def compare(pairs: DataFrame, sets: DataFrame, cfg: Settings) -> DataFrame:
    """(a, b, na, nb, shared, linked, differences) of each pair; differences where `explain` is set."""

    def run(batches):
        for batch in batches:
            explain = batch.column(2).to_pylist()
            na, nb = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            shared, apart = np.zeros(batch.num_rows, dtype=np.int64), []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(6), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                twin = both[1:] == both[:-1]
                shared[i] = twin.sum()
                single = ~(np.append(twin, False) | np.append(False, twin))
                apart.append(both[single].view(np.int64) if explain[i] else None)
            linked = 100 * shared >= cfg.percent * (na + nb - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(5), pa.array(shared), pa.array(linked), pa.array(apart, pa.list_(pa.int64()))], names=["a", "b", "na", "nb", "shared", "linked", "differences"])

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "explain", "na", "ha", "nb", "hb")
    return both.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint, shared bigint, linked boolean, differences array<bigint>")


def least_shared(cfg: Settings) -> Column:
    """The fewest differences that a member must share with a failed one to be similar to it.

    x and y are similar if they differ by at most q (|x| + |y|) with q = (100 - p) / (100 + p). With D for
    the differences from the centre c, they differ by |Dx| + |Dy| - 2 s. The failed y has |Dy| > q (|y| + |c|),
    so s > (|Dx| + q (|c| - |x|)) / 2.
    """
    p = cfg.percent
    apart = F.col("na") + F.col("nb") - 2 * F.col("shared")
    bound = (100 + p) * apart + (100 - p) * (F.col("na") - F.col("nb"))
    return F.greatest(F.lit(1), F.floor(bound / (2 * (100 + p))) + 1).cast("int")


def bitmap(name: str) -> list[Column]:
    """Aggregates w0, w1, ...: a bitmap in which each 64-bit hash in the column sets one bit."""
    word = F.pmod(F.col(name), F.lit(BITMAP_WORDS))
    bit = F.expr(f"shiftleft(1L, cast(shiftright({name}, 32) & 63 as int))")
    return [F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0)).alias(f"w{i}") for i in range(BITMAP_WORDS)]


def ones(words: list[Column]) -> Column:
    return reduce(Column.__add__, map(F.bit_count, words))


def excess(cfg: Settings) -> Column:
    """What a member adds to the differences that a similar pair must share, in units of 1 / (2 (100 + p)).

    x and y differ by |Dx| + |Dy| - 2 s, which is at most q (|x| + |y|) if the sum of both members' is at most 2 (100 + p) s.
    """
    return (100 + cfg.percent) * (F.col("na") + F.col("nb") - 2 * F.col("shared")) - (100 - cfg.percent) * F.col("nb")


def around_centres(stars: DataFrame, labels: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs (a, b) of members of one centre, in different classes so far, that may be similar.

    stars: compared (centre a, member b) with differences; labels: classes by the stars' links. A difference
    that only members of one class have is dropped. Of a member's others it is enough to look up its rarest,
    and where both members failed, both sides need only their rarest. Two members are paired only if their
    bitmaps, and what is left of both lists from the shared one on, leave room for as many as the pair needs
    by its sizes; all pairs are verified on their sets later.
    """
    rows = stars.where(F.col("differences").isNotNull()).select(F.col("a").alias("centre"), F.col("b").alias("node"), "linked", least_shared(cfg).alias("least"), excess(cfg).alias("excess"), "differences")
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    about = ["centre", "node", "label", "linked", "least", "excess"]
    parts = rows.select(*about, F.explode("differences").alias("d"))
    common = parts.groupBy("centre", "d").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("failed"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    parts = written(parts.join(common.where("failed > 0 and lo <> hi").select("centre", "d", "n"), ["centre", "d"]), "differences")
    named = [f"w{i}" for i in range(BITMAP_WORDS)]
    per_node = parts.groupBy(*about).agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("ds"), *bitmap("d"))
    per_node = per_node.where(~F.col("linked") | (F.size("ds") >= F.col("least")))
    per_node = per_node.withColumn("spare", F.size("ds") - ones([F.col(w) for w in named]))
    places = per_node.select(*about, "spare", F.array(*named).alias("bits"), F.size("ds").alias("size"), F.posexplode("ds").alias("place", "x"))
    places = places.where(~F.col("linked") | (F.col("place") <= F.col("size") - F.col("least")))
    rare = F.col("place") <= F.col("size") - F.col("least")
    places = written(places.withColumns({"d": F.col("x.d"), "room": F.col("size") - F.col("place"), "rare": rare}).drop("x", "size", "place"), "places")
    x, y = (
        places.select("centre", "d", "linked", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("label", "least", "excess", "spare", "bits", "room", "rare")])
        for s in ("x", "y")
    )
    # what two lists share sets bits in both bitmaps, but for what falls on a bit that is set already
    both = ones([F.col("bits_x")[i].bitwiseAND(F.col("bits_y")[i]) for i in range(BITMAP_WORDS)])
    # lists have one order, so at the first difference that two share, all they share is still to come in both
    most = F.least(both + F.least("spare_x", "spare_y"), "room_x", "room_y")
    enough = (most >= F.col("least_x")) & (2 * (100 + cfg.percent) * most >= F.col("excess_x") + F.col("excess_y")) & (F.col("label_x") != F.col("label_y"))
    y = y.where(~F.col("linked")).drop("linked")
    failed = x.where("not linked and rare_x").join(y.where("rare_y"), ["centre", "d"]).where((F.col("x") < F.col("y")) & enough & (most >= F.col("least_y")))
    mixed = x.where("linked").join(y, ["centre", "d"]).where(enough)
    return failed.select("x", "y").union(mixed.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes; a label is the least node that can be reached.

    Each round a node takes the least label of itself and its neighbours, and then its label's label, so
    chains shorten by half.
    """
    both = checkpoint(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen, labels.node == seen.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = checkpoint(near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = now.select("node", "label")
        if now.where("old <> label").isEmpty():
            return labels


def link_nodes(found: DataFrame, docs: DataFrame, cfg: Settings, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Classes (node, label) by links to centres, and (node, label) of labels that further links join."""
    buckets = shared_buckets(found, cfg)
    stars = stars_of(buckets)
    nodes = buckets.select("node").distinct()
    firsts = found.where(F.col("signature").isNotNull()).select("id", "position", "node", "signature").join(nodes, "node", "left_semi")
    firsts = written(firsts.dropDuplicates(["node"]), "candidates")
    drop(buckets)
    sets = written(shingle_sets(docs, firsts.select("id", "position", "node"), cfg, id_column, text_column), "sets")
    likely = prune(stars, firsts, cfg).select("a", "b", F.lit(True).alias("likely"))
    crowded = stars.groupBy("a").agg(F.count("*").alias("members")).where("members > 1").select("a", F.lit(True).alias("crowded"))
    asked = stars.join(likely, ["a", "b"], "left").join(crowded, "a", "left").where("likely or crowded")
    compared = written(compare(asked.select("a", "b", F.coalesce("crowded", F.lit(False)).alias("explain")), sets, cfg), "compared")
    drop(stars)
    labels = written(components(compared.where("linked")), "labels")
    others = prune(around_centres(compared, labels, cfg), firsts, cfg)
    more = compare(others.select("a", "b", F.lit(False).alias("explain")), sets, cfg).where("linked").select("a", "b")
    for side in ("a", "b"):
        more = more.join(labels.select(F.col("node").alias(side), F.col("label").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return labels, written(components(more), "joined")


def classes(docs: DataFrame, cfg: Settings, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, position, n_shingles, node, label) of every unit; units of one label are one class."""
    found = units(docs, cfg, id_column, text_column)
    labels, joined = link_nodes(found, docs, cfg, id_column, text_column)
    rows = found.select("id", "position", "n_shingles", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = rows.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return written(rows.select("id", "position", "n_shingles", "node", F.coalesce("to", "label").alias("label")), "classes")


def near_duplicates(docs: DataFrame, cfg: Settings, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): a document's class is its least id, and that one is kept."""
    rows = classes(docs, cfg, id_column, text_column)
    least = written(rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("least")), "least")
    rows = rows.join(least, "label", "left").withColumn("component_id", F.coalesce("least", "id"))
    return rows.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.expr("id <=> component_id").alias("kept"))


def repeated_paragraphs(docs: DataFrame, cfg: Settings, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_paragraphs, n_removed, removed, kept_in, n_shared_passages) of each document.

    Of each class of paragraphs the one at the least (id, position) stays. removed lists the positions of
    the others, kept_in the documents that hold what stays for them. Passages that documents share within longer
    paragraphs, or over several, are no paragraphs and stay; n_shared_passages tells of them (passages.py).
    """
    rows = classes(docs, cfg, id_column, text_column)
    place = F.struct("id", "position")
    crowd = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(written(crowd.select("label", "first"), "firsts"), "label", "left").withColumn("gone", F.col("first").isNotNull() & (F.col("first") != place))
    per_doc = rows.groupBy("id").agg(
        F.count("*").alias("n_paragraphs"), F.count_if("gone").alias("n_removed"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("position")))).alias("removed"), F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("first.id")))).alias("kept_in")
    )
    empty = F.array()
    all_ids = docs.select(F.col(id_column).alias("id"))
    passages = shared_passages(docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))).withColumnRenamed("key", "id")
    out = all_ids.join(per_doc, "id", "left").join(passages, "id", "left")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", empty.cast("array<int>")).alias("removed"), F.coalesce("kept_in", empty.cast(f"array<{docs.schema[id_column].dataType.simpleString()}>")).alias("kept_in"), F.coalesce("n_shared_passages", F.lit(0)).alias("n_shared_passages"))
