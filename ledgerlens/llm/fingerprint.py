"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash space is kept.

A sketch grows with its document, so two sketches of very unequal documents still estimate containment, and
the sketch of a union is the union of the sketches. Sketches are sorted arrays of distinct 64-bit hashes and
all work is done by DataFrame functions.

A text of which no hash falls below the threshold keeps its smallest one as a stand-in, so that short texts
remain comparable. A stand-in lies above the threshold, which tells it from a member: where a sketch is joined
or compared with one that has members, stand-ins do not count, so merging gives the union's sketch exactly.

Defined cases: a null text is the empty text; words are separated by white space and lowered; a text of
fewer words than a shingle has one shingle of all its words; the empty text has the empty sketch. Two empty
sketches are alike (1), an empty one and another are not (0). An empty table gives an empty result; a very
long text is one row, its sketch a fixed share of its shingles; ids are whole numbers, rows of one id follow
each other by their texts' hashes and null ids come last; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK

#: Words in a shingle.
SHINGLE = 5
#: One hash in so many is kept: a text of a hundred words still has some 25, whose likeness is known to a tenth.
SCALE = 4
#: Slices of the id order for each shuffle partition; each is sorted by itself.
SLICES_PER_PARTITION = 4
SPACES = " \t\n\x0b\x0c\r"


def threshold(scale: int) -> Column:
    return F.lit(min(-(1 << 63) + (1 << 64) // scale, (1 << 63) - 1))


def with_sketch(df: DataFrame, text: str, to: str, scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text column. Steps are columns of their own, so each is computed once."""
    words, kept = f"_{to}_words", f"_{to}_all"
    bare = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACES))
    df = df.withColumn(words, F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, WORD_BREAK), lambda w: F.xxhash64(w))))
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(shingle)]))
    df = df.withColumn(kept, F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(hashes)).drop(words)
    low = F.filter(F.col(kept), lambda h: h <= threshold(scale))
    df = df.withColumn(to, F.array_sort(F.array_distinct(low)))
    return df.withColumn(to, F.when((F.size(to) == 0) & (F.size(kept) > 0), F.array(F.array_min(kept))).otherwise(F.col(to))).drop(kept)


def members(sketch: str, scale: int = SCALE) -> Column:
    """The number of members. Sketches are sorted, so either all hashes are members or there is one stand-in."""
    return F.when(F.get(F.col(sketch), 0) <= threshold(scale), F.size(sketch)).otherwise(0)


def likeness(a: str, b: str, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity of two sketch columns, 0 to 1; two stand-ins are alike if they are equal."""
    common, known = F.size(F.array_intersect(a, b)), members(a, scale) + members(b, scale)
    every = F.when(known > 0, known).otherwise(F.size(a) + F.size(b)) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b holds; an empty a is contained in anything."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str, b: str, scale: int = SCALE) -> Column:
    """The sketch of both documents' shingles together: the members of both, or the lesser stand-in."""
    every = F.array_sort(F.array_union(a, b))
    return F.when((members(a, scale) > 0) | (members(b, scale) > 0), F.filter(every, lambda h: h <= threshold(scale))).otherwise(F.slice(every, 1, 1))


def shown(sketch: str) -> Column:
    """Sixteen hexadecimal digits a hash, in the sketch's order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def id_slices(ids: DataFrame, column: str, slices: int) -> list[int]:
    """Cuts of about equally many rows each; a bounded number of values."""
    if slices < 2:
        return []
    found = ids.select(F.col(column).cast("double").alias("x")).stat.approxQuantile("x", [i / slices for i in range(1, slices)], 1 / (4 * slices))
    return sorted({min(int(x), (1 << 63) - 1) for x in found})


def with_slice(df: DataFrame, column: str, cuts: list[int], to: str = "_slice") -> DataFrame:
    """The number of cuts up to a row's id, by binary search; the cuts are one row that every task gets."""
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    filled = cuts + [(1 << 63) - 1] * (2 * steps[0] - len(cuts))
    row = df.sparkSession.createDataFrame([(filled,)], "_cuts array<bigint>")
    df = df.crossJoin(F.broadcast(row)).withColumn(to, F.lit(0))
    for step in steps:
        df = df.withColumn(to, F.when(F.element_at("_cuts", F.col(to) + step) <= F.col(column), F.col(to) + step).otherwise(F.col(to)))
    return df.drop("_cuts")


def with_place(docs: DataFrame, slices: int) -> DataFrame:
    """docs (id, text) with tie, the text's hash, and slice and sub, which cut the order of descending id and then tie.

    Null ids are slice -1, below all others. An id with more rows than a slice should have is a slice of its own in
    as many parts as it would fill; there are fewer such ids than slices.
    """
    sizes = docs.groupBy("id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = {r.id: -(-r.n * slices // max(total, 1)) for r in sizes.where((F.col("n") > 1) & (F.col("n") * slices > total)).collect()}
    most = (1 << 63) - 1
    cuts = sorted({*id_slices(docs, "id", slices), *[x for h in hot if h is not None for x in (h, h + 1) if x <= most]})
    rows = with_slice(docs, "id", cuts).withColumn("slice", F.when(F.col("id").isNull(), -1).otherwise(F.col("_slice"))).drop("_slice")
    parts = docs.sparkSession.createDataFrame([(h, n) for h, n in hot.items()], "id bigint, parts bigint")
    rows = rows.withColumn("tie", F.xxhash64("text")).join(F.broadcast(parts.withColumnRenamed("id", "_id")), F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id")
    share = F.floor((F.shiftrightunsigned("tie", 32).bitwiseXOR(F.lit(1 << 31)) * F.col("parts")) / F.lit(float(1 << 32))).cast("bigint")
    return rows.withColumn("sub", F.coalesce(share, F.lit(0).cast("bigint"))).drop("parts")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scale: int = SCALE) -> DataFrame:
    """Each text, its edited form and its likeness to that and to the next document.

    The next document is the one of the next smaller id, and the first one after the last; rows of one id
    follow each other by their texts' hashes, null ids come last. Ids are cut into slices by quantiles, as
    many as shuffle partitions and some; an id, or its absence, that fills a slice is cut by its texts' hashes. A slice
    is sorted by itself, and the first row of the slice below stands behind it as a guest, so no task sees more than a
    slice and one row. Of the texts only one row a slice is read and shuffled a second time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    slices = SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = with_place(docs, slices)
    first = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit(0)).alias("turned"), "tie")
    heads = placed.groupBy("slice", "sub").agg(F.min(first).alias("first"))
    order = Window.orderBy("slice", F.desc("sub"))  # a row a slice
    above = F.struct("slice", "sub")
    heads = heads.select("first", F.coalesce(F.lead(above).over(order), F.first(above).over(order)).alias("seat"))
    guests = placed.withColumn("first", first).join(F.broadcast(heads), "first").groupBy("seat").agg(F.first(F.struct("id", "text", "tie")).alias("row"))
    guests = guests.select("row.*", "seat.*", F.lit(True).alias("guest"))
    placed = placed.select("id", "text", "tie", "slice", "sub", F.lit(False).alias("guest")).unionByName(guests)
    follow = Window.partitionBy("slice", "sub").orderBy("guest", F.desc("id"), "tie")
    n = F.char_length("text")
    moved = F.floor(n / 3).cast("int")
    rows = placed.withColumn("next_text", F.coalesce(F.lead("text").over(follow), F.lit("")))
    rows = rows.select("slice", "sub", "guest", "id", "tie", n.cast("bigint").alias("n_chars"), "text", F.concat(F.left("text", n - moved), F.left("next_text", moved)).alias("edited"))
    rows = with_sketch(with_sketch(rows, "text", "sketch", scale), "edited", "edited_sketch", scale)
    rows = rows.select("slice", "sub", "guest", "id", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch")
    rows = rows.withColumn("next_sketch", F.coalesce(F.lead("sketch").over(follow), F.array().cast("array<bigint>"))).where(~F.col("guest"))
    return rows.select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256", shown("sketch").alias("fingerprint"), shown("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch", scale).alias("near_edited"), likeness("sketch", "next_sketch", scale).alias("near_next"), containment("sketch", "edited_sketch").alias("contained"),
    )
