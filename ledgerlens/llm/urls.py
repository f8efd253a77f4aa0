"""URL filter: a blocked Bloom filter of listed keys lets possible hits through to an exact hash join.

Two kinds of keys are listed: rules (a host and a beginning of the path, with a verdict) and canonical URLs, which
are blocked. A page asks for its own canonical URL and for those beginnings that a rule could have: the last labels
of its host, as many as some rule names, with the first characters of its path, as many as some rule has. The
filter's blocks are rows of eight 64-bit words, and a key sets one bit in each word of one block, so asking is one
broadcast join on the block's number. What passes is joined exactly with the rules and the listed URLs, which
removes false positives. Rules go before listed URLs, and the longest rule wins.

The filter has at most MOST_BLOCKS blocks of 64 bytes whatever the list's length, so its broadcast is bounded; a list
beyond some 2.7 million keys only lets more false positives through. Rules are a list of the caller's, at most
MOST_RULES. Listed URLs are never broadcast by this module. Only distinct URLs are asked for, once each.

Defined cases: a null URL or one without `://` has an empty host and path, is listed nowhere and is allowed; an
empty table gives an empty result; an empty list allows all that no rule blocks; repeated rows are judged each; long
URLs are taken whole; rules of equal length are ranked by their host's length, and a rule given twice counts as first
given; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import union_all, written

BLOCK_BITS, WORDS, KEY_BITS = 512, 8, 12
MOST_BLOCKS, MOST_RULES = 1 << 16, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that do not change what a page shows, and words in hosts of unwanted sites.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
UNWANTED = r"(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; empty where there are none."""
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One name for the variants of a URL: no scheme, www or m, default port, closing slash, tracking or fragment."""
    place = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    ends = F.rtrim(path, F.lit("/"))
    ends = F.when(F.endswith(ends, F.lit("/index.html")), F.left(ends, F.length(ends) - 11)).otherwise(ends)
    asked = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(host != "", F.concat(place, ends, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(F.lit(""))))


def unwanted_urls(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """(canonical): a list made of pages whose host names an unwanted kind of site."""
    host, path, query = parts(F.col(f"`{url_column}`"))
    return pages.select(host.alias("host"), path.alias("path"), query.alias("query")).where(F.col("host").rlike(UNWANTED)).select(canonical(F.col("host"), F.col("path"), F.col("query")).alias("canonical"))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column) -> list[Column]:
    """One of 64 bits for each word."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter of keys (key), a row for each block that has a bit."""
    set_bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias(f"b{j}") for j, bit in enumerate(bits_of(F.col("key")))]
    return keys.select(block_of(F.col("key"), blocks).alias("block"), *set_bits).groupBy("block").agg(*[F.bit_or(f"b{j}").alias(f"w{j}") for j in range(WORDS)])


def passing(asked: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """The rows of asked (key and others) that the filter of keys does not rule out."""
    every = reduce(lambda a, b: a & b, [F.getbit(F.col(f"w{j}"), bit) == 1 for j, bit in enumerate(bits_of(F.col("key")))])
    rows = asked.withColumn("block", block_of(F.col("key"), blocks)).join(F.broadcast(bloom(keys, blocks)), "block")  # MOST_BLOCKS rows at most
    return rows.where(every).select(*asked.columns)


def rule_keys(host: Column, path: Column, rules: Sequence[Rule]) -> list[Column]:
    """What a page may be ruled by: ends of its host with beginnings of its path."""
    labels = F.split(host, r"\.")
    out = []
    for n in sorted({r.host.count(".") + 1 for r in rules}):
        tail = F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), "."))
        out += [F.when(F.length(path) >= length, F.concat(F.lit("rule "), tail, F.left(path, F.lit(length)))) for length in sorted({len(r.path) for r in rules})]
    return out


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row of pages; listed (canonical) are URLs to block."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; larger lists belong into listed")
    spark = pages.sparkSession
    ruled = [(f"rule {r.host}{r.path}", f"{r.host}{r.path}", r.verdict, len(r.host + r.path), len(r.host), -i) for i, r in enumerate(rules)]
    by_rule = spark.createDataFrame(ruled, "key string, rule string, verdict string, length int, host_length int, turn int")
    by_list = written(listed.where("canonical is not null").select(F.concat(F.lit("url "), "canonical").alias("key")).distinct(), "listed-urls")
    keys = by_rule.select("key").union(by_list)
    blocks = min(MOST_BLOCKS, max(1, (by_list.count() + len(rules)) * KEY_BITS // BLOCK_BITS + 1))
    host, path, query = parts(F.col("url"))
    urls = pages.select(F.col(f"`{url_column}`").alias("url")).where("url is not null").distinct()
    urls = urls.select("url", host.alias("host"), path.alias("path"), query.alias("query"))
    own = F.concat(F.lit("url "), canonical(F.col("host"), F.col("path"), F.col("query")))
    asked = urls.select("url", F.explode(F.filter(F.array(own, *rule_keys(F.col("host"), F.col("path"), rules)), lambda k: k.isNotNull())).alias("key"))
    possible = passing(asked, keys, blocks)
    place = lambda *c: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(f"p{i}") for i, x in enumerate(c)]).alias("place")
    hits = union_all([
        possible.join(F.broadcast(by_rule), "key").select("url", "rule", "verdict", place(1, F.col("length"), F.col("host_length"), F.col("turn"))),
        possible.where(F.startswith("key", F.lit("url "))).join(by_list, "key").select("url", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), place(0, 0, 0, 0)),
    ])
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), "place").alias("best"))
    host, path, _ = parts(F.col("url"))
    rows = pages.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").alias("url")).join(best, "url", "left")
    return rows.select(F.col("id").alias(id_column), host.alias("host"), path.alias("path"), "best.rule", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
