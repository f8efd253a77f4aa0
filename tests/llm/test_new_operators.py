"""URL filter, target resampling and sort-means against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import resample, sortmeans, urls
from ledgerlens.llm.queries import CLUSTERS, DRAW, ORACLE_SQL, RULES, op11_url_filter, op12_target_resampling, op13_sort_means


def same_as_sql(spark, small, name, query):
    for t in ("pages", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = query(spark, small)
    want = duckdb.sql(ORACLE_SQL[name])
    rows = lambda found: Counter(tuple(r) for r in found)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


# URL filter

PAGES = [
    None, "", "no scheme", "https://", "://", "https://NET/", "https://net", "https://net?x", "http://a.net/x", "http://a.net:80/x", "https://Example.NET/en/1", "https://www.example.net/en/", "https://example.net/enx",
    "https://example.com/de/3?q#f", "https://notexample.com/de/3", "https://m.example.com/de", "https://x.org/fr/a/b", "https://x.org#/fr/", "https://spam.site.com/a?utm_source=x&b=2&a=1", "http://www.spam.site.com/a/?a=1&b=2#top",
    "https://www.spam.site.com/a/index.html?ref=1&b=2&a=1", "https://spam.site.com/a?b=2", "https://clean.site.com/a", "https://ü.net/é", "https://a.net/" + "x/" * 50_000, "https://" + "a." * 20_000 + "net/", "https://u:p@x.net/", "a://b://c/d",
]


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group(), (re.match(r"[^?#]*\?([^#]*)", rest) or [None, ""])[1]


def plain_canonical(url):
    host, path, query = plain_parts(url)
    if not host:
        return None
    host = re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", host))
    path = path.rstrip("/")
    path = path[:-11] if path.endswith("/index.html") else path
    asked = sorted(x for x in query.split("&") if x and not re.match(r"(utm_[^=]*|ref|gclid|fbclid)(=|$)", x))
    return host + path + ("?" + "&".join(asked) if asked else "")


def plain_verdict(url, rules, listed):
    host, path, _ = plain_parts(url)
    fit = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host)))
        return best.host + best.path, best.verdict
    return None, "block" if plain_canonical(url) in listed else "allow"


def test_urls_are_judged_as_one_by_one(spark):
    pages = spark.createDataFrame([(i, u, "x", i) for i, u in enumerate(PAGES)] + [(3, PAGES[3], "y", 1)] * 2, "page_id bigint, url string, key string, block int").repartition(3)
    listed = spark.createDataFrame([("spam.site.com/a?a=1&b=2",), ("spam.site.com/a?a=1&b=2",), (None,)], "canonical string")
    rules = [*RULES, urls.Rule("block", "", "")][:4] + [urls.Rule("allow", "b.net", "/l"), urls.Rule("block", "net", "/l/ab")]
    got = urls.judged(pages, listed, rules).collect()
    assert len(got) == len(PAGES) + 2
    for r in got:
        url = PAGES[r.page_id]
        assert (r.host, r.path) == plain_parts(url)[:2]
        assert (r.rule, r.verdict) == plain_verdict(url, rules, {"spam.site.com/a?a=1&b=2"}), url
    assert sum(r.verdict == "block" and r.rule is None for r in got) == 3
    assert {r.verdict for r in urls.judged(pages, listed.limit(0)).collect()} == {"allow"}
    assert urls.judged(pages.limit(0), listed, rules).collect() == []


def test_a_full_filter_only_costs_exact_probes(spark):
    """One block for 5,000 keys lets everything through, and the join still decides."""
    listed = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    asked = spark.range(4000, 9000).select(F.concat(F.lit("k"), "id").alias("key"))
    none_lost = lambda blocks: urls.passing(asked, listed, blocks)
    assert none_lost(1).count() == 5000
    wide = none_lost(128)
    assert wide.join(listed, "key").count() == 1000 and wide.count() < 1000 + 4000 * 0.05


def test_url_query(spark, small):
    same_as_sql(spark, small, "op11_url_filter", op11_url_filter)


# Target resampling


def plain_words(text):
    return re.findall(resample.WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_resampled(docs, target, by=DRAW):
    def features(text):
        w = plain_words(text)
        return [" ".join(w[i : i + n]) for n in range(1, by.longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % by.buckets
    ours = Counter(bucket(f) for _, t in docs for f in features(t))
    theirs = Counter(bucket(f) for t in target for f in features(t))
    all_s, all_t = sum(ours.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (all_s + by.buckets) / ((ours[b] + 1) * (all_t + by.buckets))))
    rows = []
    for i, t in docs:
        found = features(t)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{by.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, len(plain_words(t)) >= by.least_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: by.per_cent * len(able) // 100]
    out = Counter((*r[:4], k + 1) for k, r in enumerate(drawn))
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return out + Counter({(*r, None): n for r, n in rest.items()})


def test_resampling_equals_a_plain_version(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = op12_target_resampling(spark, small)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain_resampled(docs, target)


def test_resampling_of_edge_cases(spark, edges, nothing):
    by = resample.Settings(per_cent=60, least_words=1)
    more = edges.union(edges.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("bigint")))
    docs = [(r.doc_id, r.text) for r in more.collect()]
    target = spark.createDataFrame([("two words a b c d",), (None,), ("",)], "text string")
    got = resample.resampled(more, target, by, carry=more.columns)
    assert got.columns[: len(more.columns)] == more.columns
    assert Counter(tuple(r)[:1] + tuple(r)[-4:] for r in got.collect()) == plain_resampled(docs, ["two words a b c d"], by)
    assert resample.resampled(nothing, target, by).collect() == []
    assert resample.resampled(edges, nothing, by).count() == edges.count()


@pytest.mark.parametrize("size", [1, 30, 10**6])
def test_dictionaries_of_blocks(size, monkeypatch):
    """Every run's crc32 from the dictionary is that of its string, in blocks of any size."""
    monkeypatch.setattr(resample, "BLOCK", size)
    texts = ["", "Ab ab AB c", "--", "x" * 3000 + " ß東 a " + "y" * 70_000, "a b c d a b c d", "one"]
    got = {}
    for i, j in resample.blocks(texts):
        for n, (text, number, crc) in enumerate(resample.numbered(texts[i:j], 4).runs, start=1):
            assert len(set(crc[number].tolist())) == len(crc)
            for k, x in zip(text + i, crc[number]):
                got.setdefault((int(k), n), []).append(int(x))
    for k, t in enumerate(texts):
        w = plain_words(t)
        for n in range(1, 5):
            assert got.get((k, n), []) == [zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)]


# Sort-means


def plain_clusters(vectors, by=CLUSTERS):
    """vectors: (id, whole components)."""
    seeds = sorted(vectors, key=lambda r: (hashlib.sha256(f"{by.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[: by.k]
    cents = [list(v) for _, v in seeds]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), k) for k, c in enumerate(cents))
    for _ in range(by.rounds):
        at = [near(v)[1] for _, v in vectors]
        for k in set(at):
            own = [v for (_, v), a in zip(vectors, at) if a == k]
            cents[k] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in vectors]
    total = Counter()
    for _, d, k in found:
        total[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, k, d, total[k], sum(total.values()), digest[k]) for i, d, k in found)


def test_clusters_equal_sql(spark, small):
    same_as_sql(spark, small, "op13_sort_means", op13_sort_means)


@pytest.mark.parametrize("k", [1, 4, 40])
def test_clusters_of_edge_cases(spark, k):
    by = sortmeans.Settings(k=k, size=3, scale=2, rounds=3, seed="1")
    inf, nan = float("inf"), float("nan")
    r = np.random.default_rng(k)
    good = [(i, [float(x) for x in r.integers(-4, 5, 3) / 2]) for i in range(60)] + [(7, [0.0, 0.0, 0.0]), (7, [1.0, -1.0, 0.25]), (7, [1.0, -1.0, 0.25]), (None, [9.0, 9.0, -9.1]), (61, [-0.0, 1e-30, -1e-30])]
    bad = [(70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, None, 2.0]), (74, [1.0, inf, 2.0]), (75, [1.0, nan, 2.0]), (76, [1.0, 2.0, 3.0, 4.0]), (77, [-inf, 0.0, 0.0])]
    rows = spark.createDataFrame([(i, v, "c", 1, [1]) for i, v in good + bad], "vec_id bigint, embedding array<double>, cluster string, distance int, v array<int>").repartition(3)
    whole = [(i, [math.floor(2 * x) for x in v]) for i, v in good]
    assert Counter(tuple(x) for x in sortmeans.clusters(rows, by).collect()) == plain_clusters(whole, by)
    assert sortmeans.clusters(rows.limit(0), by).collect() == []


def test_huge_components_are_held_at_the_largest(spark):
    rows = spark.createDataFrame([(1, [1e300, -1e300]), (2, [-1e300, 1e300]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    found = {x.vec_id: x for x in sortmeans.clusters(rows, sortmeans.Settings(k=1, size=2, rounds=0)).collect()}
    assert max(x.distance for x in found.values()) <= 8 * sortmeans.LARGEST**2


def test_scans_stop_early_but_never_too_early():
    """Sort-means against all distances, with many ties."""
    r = np.random.default_rng(3)
    for _ in range(200):
        k, n = int(r.integers(1, 9)), int(r.integers(1, 40))
        x, cents, before = r.integers(-3, 4, (n, 2)), r.integers(-3, 4, (k, 2)), r.integers(0, k, n).astype(np.int32)
        at, d = sortmeans.nearest(x, before, cents)
        every = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
        assert (d == every.min(axis=1)).all() and (at == every.argmin(axis=1)).all()
