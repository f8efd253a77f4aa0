"""Nested payloads to clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import absent, without_null_words

ITEM = "struct<descricao:string,quantidade:string,valorTotal:string>"
INVOICES = f"struct<notas:array<struct<numero:string,emitente:string,itens:array<{ITEM}>>>>"
# Labels that are no names.
LABELS = (
    "data de emissão", "data emissão", "cnpj", "cpf", "destinatário", "remetente", "endereço", "municipio", "município", "uf", "ie", "inscricao",
    "inscrição", "fone", "telefone", "fax", "email", "cep", "complemento", "bairro", "logradouro", "nome", "razão social", "razao social",
)
#: What a JSON text begins with.
JSON_START = r'^[ \t\r\n]*[{\["tfn0-9-]'
SECTIONS = ("payments", "expenses", "instalments")


def json_text(c: Column) -> Column:
    """JSON text as it stands, or what lies between its first and last brace; NULL if neither parses.

    A text is only parsed if it begins as JSON may, since each failure costs an exception.
    """
    parses = lambda x: F.when(x.rlike(JSON_START) & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parses(absent(c)), parses(absent(F.regexp_extract(c, r"(?s)\{.*\}", 0))))


def repaired(c: Column, array_key: str = "rows") -> Column:
    """A payload cut within its rows: whole rows are kept and the brackets closed."""
    whole = F.regexp_extract(c, r"(?s)^(.*\})", 1)
    return F.when(F.contains(c, F.lit(f'"{array_key}"')) & (whole != ""), F.concat(whole, F.lit("]}")))


def is_label(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return low.isin(*LABELS) | low.rlike(r"^\d{2}/\d{2}/\d{4}")


def clean_name(c: Column) -> Column:
    s = without_null_words(c)
    return F.when(is_label(s), "").otherwise(F.coalesce(s, F.lit("")))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def invoices(payload: Column) -> Column:
    """Invoices of a payload: items need a description, labels are no names, bad numbers are zero.

    The payload is parsed as it stands, and once more between its outer braces only where that gives nothing.
    """
    braces = absent(F.regexp_extract(payload, r"(?s)\{.*\}", 0))
    parsed = F.coalesce(F.from_json(payload, INVOICES)["notas"], F.from_json(braces, INVOICES)["notas"], F.array().cast("array<struct<numero:string,emitente:string,itens:array<" + ITEM + ">>>"))
    item = lambda i: F.struct(F.trim(i["descricao"]).alias("text"), number_or_zero(i["quantidade"]).alias("quantity"), (number_or_zero(i["valorTotal"]) * 100).cast("bigint").alias("cents"))
    described = lambda i: i.isNotNull() & (F.coalesce(F.trim(i["descricao"]), F.lit("")) != "")
    note = lambda n: F.struct(without_null_words(n["numero"]).alias("number"), clean_name(n["emitente"]).alias("emitter"), F.transform(F.filter(F.coalesce(n["itens"], F.array().cast(f"array<{ITEM}>")), described), item).alias("items"))
    return F.transform(F.filter(parsed, lambda n: n.isNotNull()), note)


def due_key(c: Column) -> Column:
    """A due date DD/MM/YYYY as a sortable number, NULL if it is none."""
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(c, r"^(\d{2})/(\d{2})/(\d{4})$", "$3$2$1").cast("int"))


def distinct_instalments(rows: DataFrame, doc: str) -> DataFrame:
    """Instalments with a due date, the first of each own number, or else of each due date and value."""
    rows = rows.withColumn("due_key", due_key(F.col("due"))).where(F.col("due_key").isNotNull())
    key = F.coalesce(F.concat(F.lit("n"), absent(F.trim("own_number"))), F.concat_ws("|", F.lit("d"), F.col("due"), F.col("cents").cast("string")))
    first = Window.partitionBy(doc, "_key").orderBy("seq")
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_key", "_n")


def exploded_instalments(docs: DataFrame, name: str, parts: str) -> DataFrame:
    """One row for each instalment, named file#pN; a document without instalments stays one row."""
    rows = docs.select("*", F.posexplode_outer(parts).alias("_pos", "part"))
    many = F.size(parts) > 1
    return rows.withColumn(name, F.when(many, F.concat(F.col(name), F.lit("#p"), (F.col("_pos") + 1).cast("string"))).otherwise(F.col(name))).drop("_pos", parts)


def card_rows(cards: DataFrame, card: str, label: str) -> DataFrame:
    """Rows of a card's sections in fixed order; equal labels of cards get a running number.

    cards: (card, label, section, seq, text, cents); rows without text or amount go, other sections too.
    """
    names = cards.select("owner", card, label).distinct()
    run = F.row_number().over(Window.partitionBy("owner", label).orderBy(card))
    names = names.withColumn("sheet", F.when(run > 1, F.concat(F.col(label), F.lit(" ("), run.cast("string"), F.lit(")"))).otherwise(F.col(label)))
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    rows = cards.where((F.coalesce(F.trim("text"), F.lit("")) != "") & F.col("cents").isNotNull()).withColumn("section_order", order).where("section_order > 0")
    place = F.row_number().over(Window.partitionBy("owner", card).orderBy("section_order", "seq"))
    return rows.join(names.select("owner", card, "sheet"), ["owner", card]).withColumn("line", place)


# The first row of a card's sheet, the names of its sections, and how a section's row looks.
SHEET_HEADER = ("Data", "Descrição", "Parcela", "Valor (R$)")
SECTION_NAMES = {"payments": "PAGAMENTO E DEMAIS CRÉDITOS", "expenses": "DESPESAS", "instalments": "PARCELAMENTOS"}


def card_sheets(cards: DataFrame, card: str, label: str) -> DataFrame:
    """(owner, card, sheet, line, seq, cells): each card's sheet, with its header, a row before each section, and card_rows().

    cards: as for card_rows(), with date and part besides. A section has its row if it has any entry at all, valid or not.
    """
    names = cards.select("owner", card, label).distinct()
    run = F.row_number().over(Window.partitionBy("owner", label).orderBy(card))
    names = names.withColumn("sheet", F.when(run > 1, F.concat(F.col(label), F.lit(" ("), run.cast("string"), F.lit(")"))).otherwise(F.col(label)))
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    known = cards.withColumn("section_order", order).where("section_order > 0")
    title = F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_NAMES.items() for x in kv]), F.col("section"))
    heads = known.select("owner", card, "section_order", "section").distinct()
    cells = lambda *c: F.array(*[F.coalesce(x, F.lit("")) for x in c]).alias("cells")
    blank, none = F.lit(""), F.lit(None).cast("bigint").alias("seq")
    valid = known.where((F.coalesce(F.trim("text"), F.lit("")) != "") & F.col("cents").isNotNull())
    amount = (F.col("cents") / 100).cast("decimal(18,2)").cast("string")
    rows = names.select("owner", card, F.lit(0).alias("section_order"), F.lit(0).alias("_k"), none, F.array(*[F.lit(h) for h in SHEET_HEADER]).alias("cells"))
    rows = rows.unionByName(heads.select("owner", card, "section_order", F.lit(0).alias("_k"), none, cells(F.concat(F.lit("── "), title, F.lit(" ──")), blank, blank, blank)))
    rows = rows.unionByName(valid.select("owner", card, "section_order", F.lit(1).alias("_k"), "seq", cells(F.trim("date"), F.trim("text"), F.trim("part"), amount)))
    line = F.row_number().over(Window.partitionBy("owner", card).orderBy("section_order", "_k", "seq"))
    return rows.withColumn("line", line).join(names.select("owner", card, "sheet"), ["owner", card]).select("owner", card, "sheet", "line", "seq", "cells")


def statement_rows(rows: DataFrame) -> DataFrame:
    """Movements with a text and an amount; a balance that is no number is blank."""
    amount, balance = F.col("amount").try_cast("decimal(18,2)"), F.col("balance").try_cast("decimal(18,2)")
    valid = rows.where((F.coalesce(F.trim("text"), F.lit("")) != "") & amount.isNotNull())
    return valid.withColumns({"cents": (amount * 100).cast("bigint"), "balance_cents": (balance * 100).cast("bigint")})
