"""Fiscal inputs derived from the star-schema tables, by the same rules in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORIES = ("NOTA FISCAL RFB", "NOTA FISCAL SERVICO", "FATURA", "RECIBO E OUTROS", "DESPESAS", "PREVISAO")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def entity(name: str, key: str):
    return F.concat(F.upper(name), F.when(F.col(key) % 2 == 0, " LTDA").otherwise(" S.A."))


def tax_number(key: str):
    """Every fourth customer has a tax id, its key in 14 digits."""
    return F.when(F.col(key) % 4 == 0, F.lpad(F.col(key).cast("string"), 14, "0"))


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items as ledger lines. seq numbers the items of an order, so no global order is needed."""
    items, orders, people = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = items.withColumn("seq", F.col("l_orderkey") * 1000 + F.row_number().over(place))
    # orders meet their customers first, so that of large tables the many items are dealt once, by order, and not again by customer
    rows = rows.join(orders.join(people, F.col("o_custkey") == F.col("c_custkey")), rows.l_orderkey == orders.o_orderkey)
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return rows.select(
        "seq", key.alias("order_key"), F.when(F.col("l_returnflag") == "R", "CR").otherwise("CP").alias("orig"),
        F.when(key % 3 == 0, F.concat(F.lit("NF"), F.lpad(key.cast("string"), 7, "0"))).otherwise(key.cast("string")).alias("nf"),
        entity("c_name", "c_custkey").alias("entity"), tax_number("c_custkey").alias("entity_id"), F.col("c_custkey").cast("string").alias("entity_code"),
        F.get(names, (key % 6).cast("int")).alias("category"), cents("o_totalprice").alias("header_cents"), cents("l_extendedprice").alias("item_cents"),
        F.to_date("o_orderdate").alias("issue_date"), F.date_add(F.to_date("o_orderdate"), (key % 40).cast("int")).alias("entry_date"), F.to_date("l_shipdate").alias("due_date"), (key % 5).cast("string").alias("branch"),
    )


LINES_SQL = f"""ledger_lines AS (
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
  o_orderkey AS order_key, CASE WHEN l_returnflag = 'R' THEN 'CR' ELSE 'CP' END AS orig,
  CASE WHEN o_orderkey % 3 = 0 THEN 'NF' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS nf,
  upper(c_name) || CASE WHEN c_custkey % 2 = 0 THEN ' LTDA' ELSE ' S.A.' END AS entity, CAST(c_custkey AS VARCHAR) AS entity_code, CASE WHEN c_custkey % 4 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 14, '0') END AS entity_id,
  [{", ".join(f"'{c}'" for c in CATEGORIES)}][CAST(o_orderkey % 6 AS INTEGER) + 1] AS category,
  CAST(round(o_totalprice * 100) AS BIGINT) AS header_cents, CAST(round(l_extendedprice * 100) AS BIGINT) AS item_cents,
  CAST(o_orderdate AS DATE) AS issue_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS entry_date, CAST(l_shipdate AS DATE) AS due_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

PAYABLE_SQL = f"""{LINES_SQL},
payable AS (SELECT *, strftime(coalesce(entry_date, issue_date), '%m.%Y') AS period,
  coalesce(nullif(ltrim(regexp_replace(nf, '^[A-Za-z]+', ''), '0'), ''), ltrim(nf, '0')) AS nf_clean
FROM ledger_lines WHERE orig = 'CP' AND category NOT IN ('PREVISAO', 'FINANC GIRO', 'ADIANTAMENTO', 'DUPLICATA', 'IMPOSTO'))"""

NOTES_SQL = f"""{PAYABLE_SQL},
notes AS (SELECT min(seq) AS seq, period, nf, entity, arg_min(nf_clean, seq) AS nf_clean, arg_min(category, seq) AS category, min(entity_id) AS entity_id, arg_min(header_cents, seq) AS header_cents,
  arg_min(issue_date, seq) AS issue_date, arg_min(entry_date, seq) AS entry_date, CAST(sum(item_cents) AS BIGINT) AS item_sum, coalesce(list(item_cents ORDER BY seq) FILTER (WHERE item_cents > 0), []) AS items
FROM payable GROUP BY period, nf, entity)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a document: numbers, value, emitter and its tax id are right, wrong or absent by the order's key.

    Of documents with a wrong number every other one has the right one as its alternative; some are taxes or cards.
    """
    orders, people = (read(spark, sf_dir, t) for t in ("orders", "customer"))
    items = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("total"), F.min(cents("l_extendedprice")).alias("least"))
    rows = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, header = F.col("o_orderkey"), cents("o_totalprice")
    case = key % 7
    value = F.when(case == 1, F.floor(header / 2)).when(case == 2, F.floor(header / 3)).when(case == 3, header + 100).when(case == 4, F.coalesce("least", header)).when(case == 6, F.coalesce("total", header)).otherwise(header)
    kinds = F.array(*[F.lit(k) for k in ("NF", "NFS", "FATURA", "RECIBO", "Não identificado")])
    wrong = F.when(key % 11 == 0, F.concat(F.lit("9"), key.cast("string"))).when(key % 10 == 0, F.concat(F.lit("8"), key.cast("string")))
    day = F.date_add(F.to_date("o_orderdate"), (key % 40).cast("int"))
    none = F.lit(None).cast("string")
    return rows.select(
        key.alias("doc_seq"), F.when(key % 17 == 0, none).otherwise(F.coalesce(wrong, key.cast("string"))).alias("nf"), F.when((key % 17 != 0) & (key % 4 == 0) & wrong.isNotNull(), key.cast("string")).alias("nf_alt"),
        F.when((key % 19 == 0) & (key % 17 != 0), key.cast("string")).alias("order_nr"), F.when(key % 13 != 0, F.upper("c_name")).alias("emitter"), F.when(key % 3 == 0, tax_number("c_custkey")).alias("emitter_id"),
        value.cast("bigint").alias("cents"), F.when(key % 23 == 0, "IMPOSTO").otherwise(F.get(kinds, (key % 5).cast("int"))).alias("kind"), day.alias("doc_date"), F.date_format(day, "MM.yyyy").alias("period"),
        F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" , "), F.upper("c_name"), F.lit(" , NF "), key.cast("string"), F.when(key % 31 == 0, " CC 278").otherwise(""), F.lit(".pdf")).alias("file"), F.concat(F.lit("d"), (key % 3).cast("string")).alias("folder"),
    )


DOCS_SQL = """own_items AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS least FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey),
docs AS (SELECT o_orderkey AS doc_seq, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '9' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 10 = 0 THEN '8' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS doc_nf,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 4 = 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 10 = 0) THEN CAST(o_orderkey AS VARCHAR) END AS nf_alt, CASE WHEN o_orderkey % 3 = 0 AND c_custkey % 4 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 14, '0') END AS emitter_id,
  CASE WHEN o_orderkey % 19 = 0 AND o_orderkey % 17 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS order_nr, CASE WHEN o_orderkey % 13 <> 0 THEN upper(c_name) END AS emitter,
  CASE o_orderkey % 7 WHEN 1 THEN h // 2 WHEN 2 THEN h // 3 WHEN 3 THEN h + 100 WHEN 4 THEN coalesce(least, h) WHEN 6 THEN coalesce(total, h) ELSE h END AS cents,
  CASE WHEN o_orderkey % 23 = 0 THEN 'IMPOSTO' ELSE ['NF', 'NFS', 'FATURA', 'RECIBO', 'Não identificado'][CAST(o_orderkey % 5 AS INTEGER) + 1] END AS kind, day AS doc_date, strftime(day, '%m.%Y') AS doc_period,
  strftime(day, '%Y.%m.%d') || ' , ' || upper(c_name) || ' , NF ' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 31 = 0 THEN ' CC 278' ELSE '' END || '.pdf' AS file, 'd' || CAST(o_orderkey % 3 AS VARCHAR) AS folder
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS h, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS day FROM orders) JOIN customer ON o_custkey = c_custkey LEFT JOIN own_items ON o_orderkey = l_orderkey)"""
#: A row for each number of a document, as the pairs need it.
KEYS_SQL = "keys AS (SELECT *, doc_nf AS key, 0 AS rank FROM docs WHERE doc_nf IS NOT NULL UNION ALL SELECT *, nf_alt AS key, 1 AS rank FROM docs WHERE nf_alt IS NOT NULL UNION ALL SELECT *, order_nr AS key, 2 AS rank FROM docs WHERE order_nr IS NOT NULL)"

#: Pairs in SQL need: cents, header_cents, item_sum, items, kind, category, emitter, emitter_id, entity, entity_id.
BASIS_SQL = """CASE WHEN coalesce(cents, 0) <= 0 THEN NULL WHEN header_cents > 0 AND abs(cents - header_cents) <= 2 THEN 'header' WHEN item_sum > 0 AND abs(cents - item_sum) <= 2 THEN 'items'
WHEN len(list_filter(items, lambda v: abs(cents - v) <= 2)) > 0 THEN 'item'
WHEN header_cents > cents AND len(list_filter(range(2, 25), lambda n: abs(cents * n - header_cents) * 10 <= n * 15 + 20)) > 0 THEN 'instalment ' || CAST(list_filter(range(2, 25), lambda n: abs(cents * n - header_cents) * 10 <= n * 15 + 20)[1] AS VARCHAR) || 'x'
WHEN header_cents * 2 > cents * 3 AND (header_cents * 2 + cents) // (cents * 2) BETWEEN 2 AND 24 AND abs(header_cents - ((header_cents * 2 + cents) // (cents * 2)) * cents) * 100 <= cents THEN 'instalment ' || CAST((header_cents * 2 + cents) // (cents * 2) AS VARCHAR) || 'x' END"""
NOTE_KIND_SQL = "CASE category WHEN 'NOTA FISCAL RFB' THEN 'NF' WHEN 'NOTA FISCAL SERVICO' THEN 'NFS' WHEN 'FATURA' THEN 'FATURA' WHEN 'RECIBO E OUTROS' THEN '*' END"
KIND_SQL = f"(({NOTE_KIND_SQL}) IS NULL OR ({NOTE_KIND_SQL}) = '*' OR ({NOTE_KIND_SQL}) = upper(kind) OR kind = 'Não identificado' OR (kind IN ('NF', 'NFS') AND ({NOTE_KIND_SQL}) IN ('NF', 'NFS', 'FATURA')))"
#: Emitters are customers' names and entities are those with a company form behind, so one holds the other.
ENTITY_SQL = "(coalesce(emitter_id = entity_id, FALSE) OR coalesce(contains(entity, emitter) OR contains(emitter, entity), FALSE))"
NAMED_SQL = "(emitter IS NOT NULL OR emitter_id IS NOT NULL)"
