"""Quality, mixing and the pipeline against brute force."""

import hashlib
import re

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import mixing, pii, quality
from ledgerlens.llm.queries import ORACLE_SQL, SEED, WEIGHTS, domain_of, op6_site_quality, op10_source_mixture, vocabulary_path

from .test_duplicates import groups, shingle_set


def logit(p):
    p = min(max(p, quality.EDGE), 1 - quality.EDGE)
    return np.log(p / (1 - p))


def test_site_rates_shrink_towards_their_parents(spark, small):
    """Rates and scores again from the documents' own probabilities."""
    rows = op6_site_quality(spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    total = sum(r.p for r in rows) / len(rows)

    def sums(key):
        out = {}
        for r in rows:
            n, good = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, good + r.p)
        return out

    def strength(sites, rate):
        n = sum(c for c, _ in sites.values())
        apart = sum(c * (g / c - rate(k)) ** 2 for k, (c, g) in sites.items())
        chance = sum(rate(k) * (1 - rate(k)) for k in sites)
        weighted = sum(c * rate(k) * (1 - rate(k)) for k, (c, _) in sites.items())
        beyond = max(0.0, (apart - chance) / n)
        return min(max(weighted / n / beyond - 1 if beyond else quality.STRENGTH[1], quality.STRENGTH[0]), quality.STRENGTH[1])

    hosts, paths = sums(lambda r: r.host), sums(lambda r: (r.host, r.path))
    k = strength(hosts, lambda _: total)
    parent = {h: (g + k * total) / (n + k) for h, (n, g) in hosts.items()}
    q = strength(paths, lambda x: parent[x[0]])
    for r in rows:
        n, good = paths[r.host, r.path]
        rate = (good - r.p + q * parent[r.host]) / (n - 1 + q)
        score = 1 / (1 + np.exp(-(logit(r.p) - logit(total) + logit(rate))))
        empty = not (docs[r.doc_id].text or "").split()
        assert r.score == pytest.approx(0 if empty else score, abs=1e-6)
        assert r.keep == (r.score >= quality.THRESHOLD)


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.keep for r in op6_site_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None]
    good = [got[i] for i, q in labels if q == 1]
    bad = [got[i] for i, q in labels if q == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3


def test_quality_of_held_out_labels(spark):
    """The model learns from four fifths of the labels and agrees with the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels.where(~held), F.col("source"), F.col("lang")).collect()}
    rest = [(r.doc_id, r.quality) for r in labels.where(held).where("quality is not null").collect()]
    assert len(rest) > 50 and np.mean([got[i] == (q == 1) for i, q in rest]) > 0.85


def test_quality_features():
    """Each feature again in plain Python."""
    texts = ["", "One two, two.\nOne two, two.\nx", "été 12!!  a A a", " \n", "word " * 50, "#$% a\n\nb"]
    for text, row in zip(texts, quality.features(pa.array(texts)).tolist(), strict=True):
        raw, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        lines = [b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", x.lower())) for x in re.findall(rb"[^\n]*\n|[^\n]+$", raw)]
        size, many = max(len(raw), 1), max(len(words), 1)
        share = lambda kind: sum(quality.CLASSES[b] == kind for b in raw) / size  # noqa: B023, E731
        want = [
            np.log1p(len(words)), share(0), share(2), share(3), share(5), share(6), len(lines) / many, (size - sum(b in b" \t\r\n" for b in raw)) / many,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, 1 - (len(words) - len(set(words))) / many, (len([x for x in lines if x]) - len({x for x in lines if x})) / max(len(lines), 1),
        ]
        assert row == pytest.approx(want), text


def test_quality_of_odd_rows(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(8, 1, 0), (0, 0, 0), (4, None, None), (12, 1, 0), (5, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = quality.classify(edges, labels, F.col("source"), F.col("lang")).collect()
        assert len(got) == edges.count()
        assert all(not r.keep and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
        kept = quality.kept(edges, labels, F.col("source"), F.col("lang"))
        assert kept.columns == edges.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)
        assert quality.classify(nothing, labels, F.col("source"), F.col("lang")).collect() == []
        assert quality.kept(nothing, labels, F.col("source"), F.col("lang")).collect() == []


# -- mixing


def shares(children, budget):
    """[(name, capacity, weight)] to {name: budget}, by sharing what is left among the open ones."""
    out, left, rest = {}, budget, list(children)
    while True:
        total = sum(w for _, _, w in rest)
        full = [c for c in rest if c[1] * total <= left * c[2]]
        if not full:
            return out | {n: left * w // total for n, _, w in rest}
        # the one of least capacity by weight first: filling it only raises the others' shares
        n, c, w = min(full, key=lambda x: (x[1] / x[2], x[0]))
        out[n] = c
        left -= c
        rest.remove((n, c, w))
        if not rest:
            return out


def test_mixture(spark):
    rows = [(i, ("d0", "d1", None)[i % 3], ("en", "de")[i % 2], f"s{i % 5}", (i * 37) % 50) for i in range(400)] + [(1000 + i, "d0", "en", "hot", 10) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long").withColumn("_key", F.lit("own")).withColumn("_bucket", F.lit(1)).withColumn("copies_", F.lit(2))
    got = mixing.mixed(docs, WEIGHTS, 600, 2, 7).collect()
    assert {r._key for r in got} == {"own"} and {r._bucket for r in got} == {1}
    cap = {}
    for i, d, l, s, n in rows:
        key = (d or "", l, s)
        cap[key] = cap.get(key, 0) + n
    w = lambda level, name: WEIGHTS.get(level, {}).get(name, 1)
    total = sum(cap.values()) * 600 // 1000
    inner = lambda n, pre: {k[: n + 1]: sum(2 * c for q, c in cap.items() if q[: n + 1] == k[: n + 1]) for k in cap if k[:n] == pre}
    want = {}
    for (d,), bd in shares([(k, c, w("domain", k[0])) for k, c in inner(0, ()).items()], total).items():
        for (_, l), bl in shares([(k, c, w("lang", k[1])) for k, c in inner(1, (d,)).items()], bd).items():
            want |= shares([(k, c, 1) for k, c in inner(2, (d, l)).items()], bl)
    chosen = {r.doc_id: r.copies for r in got}
    for key, budget in want.items():
        mine = [(i, n) for i, d, l, s, n in rows if (d or "", l, s) == key]
        whole, part = divmod(budget, cap[key]) if cap[key] else (0, 0)
        taken, used = sorted((hashlib.md5(f"{7}/{whole}/{i}".encode()).hexdigest(), i, n) for i, n in mine), 0
        for _, i, n in taken:
            used += n
            assert chosen.get(i, 0) == whole + (used <= part)


def test_mixture_of_nothing_and_of_odd_rows(spark, edges, nothing):
    lean = lambda df: df.withColumn("domain", F.lit(None).cast("string")).withColumn("tokens", mixing.word_tokens("text"))
    assert mixing.mixed(lean(nothing), WEIGHTS, 600, 2, 7).collect() == []
    got = mixing.mixed(lean(edges), WEIGHTS, 1000, 1, 7)
    assert got.count() == edges.count() and {r.copies for r in got.collect()} == {1}
    assert mixing.mixed(lean(edges), WEIGHTS, 0, 1, 7).agg(F.sum("tokens")).first()[0] in (0, None)


def test_mixture_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op10_source_mixture"]).fetchall()
    got = op10_source_mixture(spark, small).select("doc_id", "domain", "lang", "source", "tokens", "copies").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# -- the pipeline


def test_pipeline_equals_plain_code(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    keep = {r.doc_id for r in op6_site_quality(spark, small).collect() if r.keep}
    rows = sorted((r for r in docs if r.doc_id in keep), key=lambda r: r.doc_id)
    root = groups([shingle_set(r.text, corpus_pipeline.NEAR.shingle) for r in rows], corpus_pipeline.NEAR.percent)
    rows = [r.asDict() for k, r in enumerate(rows) if root[k] == k]
    for r in rows:
        r["text"] = pii.masked(r["text"])
        r["n_chars"] = len(r["text"])
    masked = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    lean = masked.select("doc_id", domain_of("source").alias("domain"), "lang", "source", mixing.word_tokens("text").alias("tokens"))
    chosen = {r.doc_id for r in mixing.mixed(lean, WEIGHTS, corpus_pipeline.BUDGET, 1, SEED).collect()}
    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    want = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"], library.encode(r["text"], add_special_tokens=False).ids) for r in rows if r["doc_id"] in chosen}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars, r.token_ids) for r in got} == want
    assert len(got) == len(want) > 20


def test_stages_take_odd_rows(spark, small, edges, nothing):
    for docs in (edges, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, small)
            rows = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            assert len(rows) <= docs.count()


def test_near_duplicates_of_rows_without_ids(spark, small):
    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(None, words[0]), (None, words[0]), (None, words[1]), (7, words[1] + " end"), (None, words[2]), (8, words[3]), (9, words[3])]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, docs, small).collect()
    want = [(None, words[0]), (7, words[1] + " end"), (None, words[2]), (8, words[3])]
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in want)
