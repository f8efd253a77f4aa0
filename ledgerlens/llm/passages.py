"""Passages of words that several documents share, wherever they begin and end.

Of each WINDOW runs of CORE words in a row the one of the least hash is an anchor of the text. Two documents that
share CORE + WINDOW - 1 = 50 words in a row have an anchor in common, and those with a common anchor share CORE words
at least. Lines and paragraphs play no part, so a passage within a longer line, or over several, is seen.

Defined cases: null texts and those of fewer than CORE words have no anchors; a passage that stands twice in one
document only is not shared; A-Z are lowered and words end at space and the control characters 9 to 13. Anchors are
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import written

CORE, WINDOW = 26, 25


def anchors_of(hashes: np.ndarray, counts: np.ndarray, core: int = CORE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(unit, anchor) of the distinct anchors of units with counts words of the given hashes; a unit with few runs has their least."""
    number = np.maximum(counts - core + 1, 0)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), number)
    at = sh.ragged(first, number)
    if not len(at):
        return owner, np.zeros(0, dtype=np.uint64)
    codes = sh.odd_numbers(core, 13)
    runs = np.zeros(len(at), dtype=np.uint64)
    for j in range(core):
        runs += hashes[at + j] * codes[j]
    runs = sh.mix(runs)
    # the least of the next 2 ** k, and of `window` by two of those that overlap; both stay within the unit
    left = np.repeat(np.cumsum(number), number) - np.arange(len(at))
    least, width = runs, 1
    while 2 * width <= window:
        ahead = np.append(least[width:], least[:width])
        least, width = np.where(left > width, np.minimum(least, ahead), least), 2 * width
    ahead = np.append(least[window - width :], least[: window - width])
    least = np.where(left > window - width, np.minimum(least, ahead), least)
    whole = (left >= window) | (left == np.repeat(number, number))
    owner, least = owner[whole], least[whole]
    fresh = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))
    both = np.unique(np.rec.fromarrays((owner[fresh], least[fresh]), names="owner,anchor"))
    return both.owner, both.anchor


def shared_passages(docs: DataFrame) -> DataFrame:
    """(key, n_shared_passages) of docs (key, text) that share anchors with other rows: how many."""

    def run(batches):
        for batch in batches:
            values, offsets = sh.utf8(batch.column(1))
            for i, j in sh.chunks(offsets):
                row, anchor = anchors_of(*sh.words(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), pa.array(anchor.view(np.int64))], names=["key", "anchor"])

    every = docs.select("key", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, anchor bigint")
    # written, so that a join with them has an exchange on either side and a hot anchor's rows can be split
    twice = written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    return every.join(twice, "anchor").groupBy("key").agg(F.count("*").alias("n_shared_passages"))
