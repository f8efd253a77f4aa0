"""Mixing sources to target weights by budgets over a tree of domains, languages and sources.

Capacities rise: a leaf can give its tokens as often as epochs are allowed, an inner node the sum of its
children. Budgets fall: a node's budget is shared by weight among its children; a child that cannot use its
share gives the rest to its siblings, and only what all siblings cannot use was never given to the node, so
it went to the node's own siblings before. A leaf takes whole epochs and then a prefix of one more, in the
order of a seeded hash.

The order is a hash, so its leading digits cut a leaf into buckets. Token sums by bucket find the one bucket
in which the prefix ends; only that bucket's rows are sorted. All work is done by DataFrame functions.

Defined cases: null labels are the empty label; a name without a weight has weight 1, a weight is a positive
whole number; a text without words has no tokens and comes with the prefix at its place,
no more often than epochs are allowed; repeated rows are
separate rows; shares are rounded down to whole tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
BUCKET_DIGITS = 3
#: Wide enough for tokens times weight.
WIDE = "decimal(30,0)"


def word_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    named = weights.get(level, {})
    if not named:
        return F.lit(1).cast("bigint")
    table = F.create_map(*[F.lit(x) for kv in sorted(named.items()) for x in kv])
    return F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == F.col(level))), 0), F.lit(1)).cast("bigint")


def shared_out(children: DataFrame, parents: DataFrame | None, parent_keys: list[str], level: str, weights: dict) -> DataFrame:
    """children with their budgets: (keys, capacity) under parents' budgets.

    In the order of capacity by weight a child is full as long as its fair share covers its capacity; the
    others share by weight what the full ones leave.
    """
    rows = children.join(parents, parent_keys) if parent_keys else children.crossJoin(parents)  # the root is one row
    rows = rows.withColumn("w", weight_of(level, weights))
    by = Window.partitionBy(*parent_keys) if parent_keys else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("w"), level)
    wide = lambda c: F.col(c).cast(WIDE)
    rows = rows.withColumns({
        "before": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("full", wide("capacity") * F.col("rest") <= (wide("parent_budget") - F.col("before")) * F.col("w"))
    rows = rows.withColumns({"taken": F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(by), "open_w": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by)})
    share = F.expr(f"(cast(parent_budget - taken as {WIDE}) * cast(w as decimal(8,0))) div greatest(open_w, 1)")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast("bigint")).select(*parent_keys, level, "capacity", "budget")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], per_mille: int, epochs: int) -> DataFrame:
    """(labels, tokens, budget) of each leaf, from (labels, tokens)."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    levels = [leaves.groupBy(*LEVELS[: k + 1]).agg(F.sum("capacity").alias("capacity")) for k in range(len(LEVELS))]
    budget = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * per_mille).alias("x")).select(F.expr("x div 1000").alias("parent_budget"))
    for k, level in enumerate(LEVELS):
        given = shared_out(levels[k], budget, list(LEVELS[:k]), level, weights)
        budget = given.select(*LEVELS[: k + 1], F.col("budget").alias("parent_budget"))
    return leaves.drop("capacity").join(budget.withColumnRenamed("parent_budget", "budget"), list(LEVELS))


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]], per_mille: int, epochs: int, seed: int = 0, id_column: str = "doc_id", token_column: str = "tokens", to: str = "copies") -> DataFrame:
    """The chosen rows of docs with the number of times each is used.

    docs carries the labels and a token count. per_mille is the budget in thousandths of all tokens.
    """
    names = {x: f"_{x}" for x in LEVELS}
    labels = list(names.values())
    own = [c for c in docs.columns if c != to]
    # own columns travel in a struct, so that their names clash with nothing here
    rows = docs.select(
        F.struct(*own).alias("_doc"), *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(v) for k, v in names.items()],
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_name"), F.col(id_column).alias("_id"), F.coalesce(F.col(token_column), F.lit(0)).alias("_tokens"),
    )
    leaves = rows.groupBy(*labels).agg(F.sum("_tokens").alias("tokens")).withColumnsRenamed({v: k for k, v in names.items()})
    budgets = leaf_budgets(leaves, weights, per_mille, epochs)
    budgets = budgets.select(*[F.col(k).alias(v) for k, v in names.items()], F.expr("case when tokens > 0 then budget div tokens else 0 end").alias("_whole"), F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("_part"))
    budgets = written(budgets, "budgets")

    def keyed(leaf: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("_whole").cast("string"), "_name").cast("binary"))
        return rows.join(leaf, labels).withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))

    sums = keyed(budgets).groupBy(*labels, "_part", "_bucket").agg(F.sum("_tokens").alias("_sum"))
    running = F.sum("_sum").over(Window.partitionBy(*labels).orderBy("_bucket"))
    cuts = sums.withColumn("_end", running).where(F.col("_end") > F.col("_part"))
    cuts = cuts.groupBy(*labels).agg(F.min(F.struct("_bucket", (F.col("_end") - F.col("_sum")).alias("_before"))).alias("_c"))
    cuts = written(budgets.join(cuts.select(*labels, F.col("_c._bucket").alias("_cut"), F.col("_c._before").alias("_before")), labels, "left"), "cuts")
    every = keyed(cuts)
    whole = every.where(F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut"))).withColumn("_copies", F.least(F.col("_whole") + 1, F.lit(epochs)))
    # a leaf without a cut has part 0 and no tokens beyond, so all of its rows belong to the prefix
    later = every.where((F.col("_bucket") > F.col("_cut")) & (F.col("_whole") > 0)).withColumn("_copies", F.col("_whole"))
    place = Window.partitionBy(*labels, "_bucket").orderBy("_key", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = every.where(F.col("_bucket") == F.col("_cut"))
    fits = F.col("_before") + F.sum("_tokens").over(place) <= F.col("_part")
    edge = edge.withColumn("_copies", F.least(F.col("_whole") + F.when(fits, 1).otherwise(0), F.lit(epochs))).where(F.col("_copies") > 0)
    chosen = [*[F.col(f"_doc.`{c}`") for c in own], F.col("_copies").cast("bigint").alias(to)]
    return whole.select(chosen).unionByName(edge.select(chosen)).unionByName(later.select(chosen))
