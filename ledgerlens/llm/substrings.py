"""Removal of every byte that a repeated long string covers, exact to the byte.

A string of `length` bytes at s holds the window of its first `window` 8-byte grams. The gram of the least
hash there, leftmost on ties, is the string's anchor: equal strings have their anchors at equal places. A run
of starts that share an anchor is one row. The candidates are narrowed step by step, and at every step what
is settled leaves:

* All strings of a run hold the `core` bytes after the anchor. A run whose core is unique holds no repeat.
* Runs of equal extent and content are one class; a class of two or more is repeated as a whole.
* What is left stands at the edges of repeated passages. One run of each class is cut into blocks of `BLOCK`
  starts, at equal places behind the anchor, and blocks are settled as runs were: by what their strings share,
  then by all they hold.
* The single strings of the last open blocks are counted.

Every step is a count by key, summed before it moves, and a join with the keys found twice; no group is ever
gathered, so a passage in a third of all rows takes the same path as any other.

Defined cases: null texts are empty and keep nothing; an empty table gives an empty result; texts shorter than
`length` keep everything; very long texts are one row each and are handled whole; a string may repeat within
its own document and overlap itself; null ids and repeated ids are documents of their own, since rows are told
apart by a hash of id and text; rows equal in both repeat each other; other columns of the input, whatever
their names, are not looked at. Strings are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import written
from .passages import shared_passages

LENGTH = 400
WINDOW = 200
GRAM = 8
#: Starts in a block of an edge run.
BLOCK = 16
BASE = 0x9E3779B97F4A7C15 | 1
BYTE_VALUE = sh.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64."""
    global _powers, _inverse
    if n > len(_powers):
        m = max(n, 2 * len(_powers), 1 << 16)
        back = pow(BASE, -1, 1 << 64)
        _powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(m, BASE, dtype=np.uint64)))
        _inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(m, back, dtype=np.uint64)))
    return _powers, _inverse


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw) + 1)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], dtype=np.uint64)))


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to stop; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return sh.mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    n = len(raw) - GRAM + 1
    x = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        x |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return sh.mix(x)


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, from running minima of blocks."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs_of(raw: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, core hash, context hash) of each run of one text's starts.

    Anchors of windows that start no string follow with a first start of -1: they only tell that their core
    stands here too.
    """
    n, core_bytes = len(raw), length - window + 1
    if n < max(core_bytes, window + GRAM - 1):
        return tuple(np.zeros(0, dtype=t) for t in (np.int32, np.int32, np.int32, np.uint64, np.uint64))
    grams = gram_hashes(raw)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_least(packed, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    strings, rest = anchor[: max(n - length + 1, 0)], np.unique(anchor[max(n - length + 1, 0) :])
    rest = rest[(rest + core_bytes <= n) & ~np.isin(rest, strings[-1:])]
    first = np.flatnonzero(np.append(True, strings[1:] != strings[:-1])) if len(strings) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(strings)) - 1 if len(strings) else first
    at = np.append(strings[first], rest)
    prefix = prefix_hash(raw)
    core = span_hash(prefix, at, at + core_bytes)
    none = np.full(len(rest), -1, dtype=np.int64)
    context = np.append(block_context(prefix, first, last, at[: len(first)], length), none.astype(np.uint64))
    return np.append(first, none).astype(np.int32), np.append(last, none - 1).astype(np.int32), at.astype(np.int32), core, context


def block_context(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of all that the strings from first to last hold, and of their places before the anchor."""
    place = (at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
    return sh.mix(span_hash(prefix, first, last + length) + sh.mix(place))


def runs(docs: DataFrame, length: int, window: int) -> DataFrame:
    """(key, first, last, at, core, context) of every run of docs (key, text)."""

    def run(batches):
        for batch in batches:
            values, offsets = sh.utf8(batch.column(1))
            size = 0
            parts: list[tuple[np.ndarray, ...]] = []
            owners: list[int] = []

            def made():
                rows = pa.array(np.repeat(owners, [len(p[0]) for p in parts]).astype(np.int64))
                columns = [np.concatenate([p[k] for p in parts]) for k in range(5)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array(c) for c in columns[:3]), *(pa.array(c.view(np.int64)) for c in columns[3:])], names=["key", "first", "last", "at", "core", "context"])

            for i in range(batch.num_rows):
                parts.append(runs_of(values[offsets[i] : offsets[i + 1]], length, window))
                owners.append(i)
                size += len(parts[-1][0])
                if size > 50_000:
                    yield made()
                    parts, owners, size = [], [], 0
            if parts:
                yield made()

    return docs.mapInArrow(run, "key bigint, first int, last int, at int, core bigint, context bigint")


def blocks(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(key, first, edge, shared, context, hashes) of the blocks of the placed runs.

    shared is a hash of the bytes that all strings at a block's places hold, hashes are those of its strings.
    """
    listed = places.groupBy("key").agg(F.collect_list(F.struct("first", "last", "at", "edge")).alias("places"))
    texts = docs.join(listed, "key")
    step = min(BLOCK, length)

    def run(batches):
        for batch in batches:
            values, offsets = sh.utf8(batch.column(1))
            for i, asked in enumerate(batch.column(2)):
                prefix = prefix_hash(values[offsets[i] : offsets[i + 1]])
                whole = asked.values
                for begin in range(0, len(whole), 1000):
                    some = whole.slice(begin, 1000)
                    first, last, at = (some.field(k).to_numpy().astype(np.int64) for k in ("first", "last", "at"))
                    least, most = (at - last) // step, (at - first) // step
                    number = most - least + 1
                    owner, block = np.repeat(np.arange(len(first)), number), sh.ragged(least, number)
                    far = at[owner] - block * step
                    lo, hi = np.maximum(first[owner], far - step + 1), np.minimum(last[owner], far)
                    strings = sh.ragged(lo, hi - lo + 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hi - lo + 1)), pa.int32()), pa.array(span_hash(prefix, strings, strings + length).view(np.int64)))
                    shared = span_hash(prefix, far, far - step + 1 + length)
                    context = block_context(prefix, lo, hi, at[owner], length)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(len(owner), i))), pa.array(lo.astype(np.int32)), some.field("edge").take(pa.array(owner)), pa.array(shared.view(np.int64)), pa.array(context.view(np.int64)), lists],
                        names=["key", "first", "edge", "shared", "context", "hashes"],
                    )

    return texts.select("key", "text", "places").mapInArrow(run, "key bigint, first int, edge boolean, shared bigint, context bigint, hashes array<bigint>")


def twice(rows: DataFrame, column: str) -> DataFrame:
    """The values of a column that more than one row has.

    They are written, so that a join with them has an exchange on either side and a hot value's rows can be split.
    """
    return written(rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(column), "keys")


def repeated_starts(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(key, first, last, shared) of docs (key, text): ranges of starts of repeated strings.

    A row of a null first tells how many anchors of the document have a core that stands elsewhere too.
    """
    every = runs(docs, length, window)
    some = written(every.join(twice(every, "core"), "core"), "runs")
    strings = some.where("first >= 0")
    kinds = written(strings.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "at")).alias("one")), "classes")
    whole = strings.join(kinds.where("n > 1").select("core", "context"), ["core", "context"]).select("key", "first", "last")
    places = kinds.join(twice(kinds, "core"), "core").select("one.*", (F.col("n") == 1).alias("edge"))
    cut = written(blocks(docs, places, length), "blocks")
    some_blocks = written(cut.join(twice(cut, "shared"), "shared"), "open-blocks")
    block_kinds = written(some_blocks.groupBy("shared", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "edge", "hashes")).alias("one")), "block-classes")
    equal = some_blocks.where("edge").join(block_kinds.where("n > 1").select("shared", "context"), ["shared", "context"]).select("key", "first", (F.col("first") + F.size("hashes") - 1).alias("last"))
    last_ones = block_kinds.join(twice(block_kinds, "shared"), "shared").select("one.key", "one.first", (F.col("one.edge") & (F.col("n") == 1)).alias("edge"), F.posexplode("one.hashes").alias("k", "string"))
    start = F.col("first") + F.col("k")
    single = last_ones.where("edge").join(twice(last_ones, "string"), "string").select("key", start.alias("first"), start.alias("last"))
    found = whole.unionByName(equal).unionByName(single).withColumn("shared", F.lit(0).cast("bigint"))
    anchors = some.groupBy("key").agg(F.count("*").alias("shared")).select("key", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "shared")
    return found.unionByName(anchors)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_anchors, n_shared_passages) of each document.

    n_shared_anchors counts anchors whose core stands elsewhere too, n_shared_passages those of words that other
    documents have (passages.py): passages too short to be removed show there, all of 50 words or more in the latter.
    """
    ids, text = F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    rows = docs.select(F.xxhash64(id_column, text_column).alias("key"), text, ids)
    spans = F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("spans")
    none = F.lit(None).cast("int")
    said = shared_passages(rows.select("key", "text")).select("key", none.alias("first"), none.alias("last"), F.lit(0).cast("bigint").alias("shared"), F.col("n_shared_passages").alias("passages"))
    found = repeated_starts(rows.select("key", "text"), length, window).withColumn("passages", F.lit(0).cast("bigint")).unionByName(said)
    found = found.groupBy("key").agg(spans, F.sum("shared").alias("shared"), F.sum("passages").alias("passages"))

    def run(batches):
        for batch in batches:
            values, offsets = sh.utf8(batch.column(1))
            out = []
            for i, spans in enumerate(batch.column(2)):
                raw = values[offsets[i] : offsets[i + 1]]
                if not spans.is_valid or not len(spans.values):
                    out.append((len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()))
                    continue
                marks = spans.values
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(edge, marks.field("first").to_numpy(), 1)
                np.add.at(edge, marks.field("last").to_numpy() + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                count = int(gone.sum())
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), count, n_spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), batch.column(3), batch.column(4)], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_anchors", "n_shared_passages"])

    kind = docs.schema[id_column].dataType.simpleString()
    both = rows.join(found, "key", "left").select("id", "text", "spans", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("shared", "passages")])
    return both.mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared_anchors bigint, n_shared_passages bigint")
