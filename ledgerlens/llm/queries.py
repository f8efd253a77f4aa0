"""The operators' queries over the documents table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, langid, media, mixing, neardup, pii, quality, resample, sortmeans, substrings, urls
from .common import table, written

#: Where the vocabulary files of public tokenizers lie; a parameter, never copied.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Target weights of the tree; a name that is not listed has weight 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
#: The token budget in thousandths of all tokens, the epochs a document may be used, and the order's seed.
PER_MILLE, EPOCHS, SEED = 600, 2, 7


def domain_of(source: str) -> Column:
    """The tables name no domains; a source belongs to one of four by the first digit of its MD5."""
    return F.concat(F.lit("d"), F.expr(f"(instr('0123456789abcdef', substring(md5(coalesce({source}, '')), 1, 1)) - 1) div 4").cast("string"))


def op1_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


#: Near-duplicate documents: sets of four-word shingles, Jaccard similarity 0.8.
DOCUMENTS = neardup.Settings(shingle=4, percent=80, rows=5, bands=neardup.bands_for(80, 5, 1e-5))
#: Repeated paragraphs: every line that has a word; five-word shingles, a shorter line is one shingle.
PARAGRAPHS = neardup.Settings(shingle=5, percent=80, rows=4, bands=neardup.bands_for(80, 4, 1e-5), lines=True)


def op3_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.repeated_paragraphs(table(spark, sf_dir, "documents"), PARAGRAPHS)


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), DOCUMENTS)


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents name no URLs: a source is the host, and a language within it the path."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs.where(~langid.held_out())))


def op8_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", domain_of("source").alias("domain"), "lang", "source", mixing.word_tokens("text").alias("tokens"))
    return mixing.mixed(written(docs, "tokens"), WEIGHTS, PER_MILLE, EPOCHS, SEED)


#: Rules on URLs; the longest that fits decides.
RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical URLs of pages on unwanted sites."""
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.unwanted_urls(pages), RULES)


#: Runs of up to three words in 10,000 buckets; five per cent of the documents of 20 words or more are drawn.
DRAW = resample.Settings(longest=3, buckets=10_000, least_words=20, per_cent=5, seed="42")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), DRAW)


#: Centroids, components, scale, rounds and seed of the clustering.
CLUSTERS = sortmeans.Settings(k=16, size=64, scale=64, rounds=3, seed="1")


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.clusters(table(spark, sf_dir, "embeddings"), CLUSTERS)


QUERIES = {f.__name__: f for f in (op1_scaled_sketches, op2_pii_spans, op3_paragraph_bands, op4_minhash_bayes, op5_repeated_substrings, op6_site_quality, op7_language_profiles, op8_bpe_tokens, op9_media_sequences, op10_source_mixture, op11_url_filter, op12_target_resampling, op13_sort_means)}


def _level(name: str, parent: str, keys: list[str], level: str, weight: str) -> str:
    """One level of budgets in SQL: parent's rows carry parent_budget."""
    on = f"JOIN {parent} USING ({', '.join(keys)})" if keys else f"CROSS JOIN {parent}"
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    every = ", ".join([*keys, level])
    return f"""{name}_0 AS (SELECT {every}, sum(capacity) AS capacity, CAST({weight} AS HUGEINT) AS w, any_value(parent_budget) AS parent_budget FROM leaves {on} GROUP BY {every}),
{name}_1 AS (SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_0 WINDOW o AS ({part} ORDER BY CAST(capacity AS DOUBLE) / CAST(w AS DOUBLE), {level})),
{name}_2 AS (SELECT *, capacity * rest <= (parent_budget - before) * w AS filled FROM {name}_1),
{name}_3 AS (SELECT *, sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({part}) AS taken, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}) AS open_w FROM {name}_2),
{name} AS (SELECT {every}, CASE WHEN filled THEN capacity ELSE CAST((parent_budget - taken) * w AS HUGEINT) // CAST(greatest(open_w, 1) AS HUGEINT) END AS parent_budget FROM {name}_3)"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END"


def _nearest(name: str, cents: str) -> str:
    """Each vector's nearest of cents, ties to the smaller number."""
    return f"""{name} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.r, q.c, CAST(sum((p.v - q.v) * (p.v - q.v)) AS BIGINT) AS d FROM parts p JOIN {cents} q USING (i) GROUP BY ALL) GROUP BY r)"""


def _moved(name: str, cents: str, near: str) -> str:
    """The floored means of near's clusters; a centroid without vectors stays."""
    return f"""{name} AS (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.v) AS v FROM {cents} o LEFT JOIN (SELECT c, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM parts JOIN {near} USING (r) GROUP BY ALL) m USING (c, i))"""


def _rounds(n: int) -> str:
    return ",\n".join(f"{_nearest(f'near_{k}', f'cents_{k}')},\n{_moved(f'cents_{k + 1}', f'cents_{k}', f'near_{k}')}" for k in range(n))


ORACLE_SQL: dict[str, str] = {
    "op10_source_mixture": f"""WITH docs AS (
SELECT doc_id, 'd' || CAST((instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) // 4 AS VARCHAR) AS domain, lang, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
rows_ AS (SELECT doc_id, domain AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s, lang, source, tokens FROM docs),
leaves AS (SELECT d, l, s, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) AS HUGEINT) * {EPOCHS} AS capacity FROM rows_ GROUP BY d, l, s),
root AS (SELECT CAST(coalesce(sum(tokens), 0) AS HUGEINT) * {PER_MILLE} // 1000 AS parent_budget FROM leaves),
{_level("domains", "root", [], "d", _case("d", WEIGHTS["domain"]))},
{_level("langs", "domains", ["d"], "l", _case("l", WEIGHTS["lang"]))},
{_level("sources", "langs", ["d", "l"], "s", "1")},
budgets AS (SELECT d, l, s, CASE WHEN tokens > 0 THEN parent_budget // tokens ELSE 0 END AS whole_, CASE WHEN tokens > 0 THEN parent_budget % tokens ELSE 0 END AS part FROM sources JOIN leaves USING (d, l, s)),
keyed AS (SELECT *, md5('{SEED}/' || CAST(whole_ AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR)) AS k FROM rows_ JOIN budgets USING (d, l, s)),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY k, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, d AS domain, lang, source, tokens, CAST(least(whole_ + CASE WHEN upto <= part THEN 1 ELSE 0 END, {EPOCHS}) AS BIGINT) AS copies FROM placed WHERE whole_ + CASE WHEN upto <= part THEN 1 ELSE 0 END > 0""",
    "op11_url_filter": f"""WITH cut AS (
SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM cut),
tidied AS (SELECT *, regexp_replace(regexp_replace(host, '^(www|m)[.]', ''), ':(80|443)$', '') AS place, rtrim(path, '/') AS ends, list_sort([x FOR x IN string_split(query, '&') IF x <> '' AND NOT regexp_matches(x, '{urls.TRACKING}')]) AS asked FROM named),
whole AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN place || CASE WHEN suffix(ends, '/index.html') THEN left(ends, length(ends) - 11) ELSE ends END || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical FROM tidied),
listed AS (SELECT DISTINCT canonical FROM whole WHERE regexp_matches(host, '{urls.UNWANTED}')),
ruled AS (SELECT w.*, CASE {" ".join(f"WHEN ('.' || host) LIKE '%.{r.host}' AND prefix(path, '{r.path}') THEN '{r.host}{r.path}'" for r in sorted(RULES, key=lambda r: -len(r.host + r.path)))} END AS rule, l.canonical IS NOT NULL AS is_listed FROM whole w LEFT JOIN listed l USING (canonical))
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.host}{r.path}' THEN '{r.verdict}'" for r in RULES)} WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op13_sort_means": f"""WITH kept AS (
SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, [CAST(floor(CAST(x AS DOUBLE) * {CLUSTERS.scale}) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {CLUSTERS.size} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
first_ AS (SELECT v, row_number() OVER (ORDER BY sha256('{CLUSTERS.seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept QUALIFY c < {CLUSTERS.k}),
parts AS (SELECT r, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM kept),
cents_0 AS (SELECT c, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM first_),
{_rounds(CLUSTERS.rounds)},
{_nearest("near_", f"cents_{CLUSTERS.rounds}")},
named AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM cents_{CLUSTERS.rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM near_ JOIN kept USING (r) JOIN named USING (c)""",
}
