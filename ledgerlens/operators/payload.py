"""Report rows with a JSON payload: document fields, answers of extractors, and payloads back to rows.

A field is looked up under its keys in order and the first one that says anything counts; what the payload
lacks is read from the file's name. The payload is parsed once, as a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.text import absent, bound, digits, no_zeros, norm
from .extract import due_key, json_text, number_or_zero, without_null_words

MAP = "map<string,string>"
# The keys of each field in a payload, in the order in which they are asked, and the sign of a blank.
NUMBER_KEYS = ("Nº da NF-e", "Nº do CT-e", "Número do documento")
ORDER_KEYS = ("Ordem de Compra", "ordemCompra")
EMITTER_KEYS = ("Razão social emitente", "Emitente", "Nome fantasia")
TAX_ID_KEYS = ("CNPJ emitente", "CNPJ Emitente")
VALUE_KEYS = ("Valor total", "Total da NF-e", "Valor")
DUE_KEYS = ("Data de vencimento", "Data de Vencimento")
INSTALMENT_KEY = "Parcela"
BLANK = "—"
# Document kinds, those an answer may name, and the key of a number by kind.
KINDS = ("CONSORCIO", "CTE", "FATURA", "IMPOSTO", "NF", "NFS", "RECIBO")
UNKNOWN, UNSURE = "Não identificado", "baixa"
NUMBER_KEY = {"CTE": "Nº do CT-e", "IMPOSTO": "Número do documento"}
# The fields of an answer by kind.
TYPED_FIELDS = {
    "CTE": "numero_cte serie chave_acesso data_emissao cnpj_emitente remetente destinatario valor_total_prestacao valor_carga",
    "FATURA": "numero_fatura data_emissao vencimento cnpj_emitente nome_emitente descricao valor_total",
    "IMPOSTO": "tipo_guia codigo_receita competencia periodo_apuracao numero_documento cnpj_cpf vencimento valor_principal multa juros valor_total",
    "NF": "numero_nfe serie chave_acesso data_emissao cnpj_emitente nome_emitente cnpj_destinatario nome_destinatario natureza_operacao valor_produtos valor_icms valor_total",
    "NFS": "numero_nfse data_emissao cnpj_prestador nome_prestador cnpj_tomador nome_tomador descricao_servico valor_servico aliquota_iss iss_retido valor_liquido",
    "RECIBO": "numero_recibo data pagador beneficiario descricao valor",
}
#: Pictures of an answer: how many are taken, and the characters of the longest.
PICTURES, PICTURE_CHARS = 6, 7_000_000


def first_said(payload: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys' values that is not empty."""
    return F.coalesce(*[absent(F.element_at(payload, k)) for k in keys])


def plain_number(c: Column) -> Column:
    """Digits without leading zeros; NULL if there are none."""
    return absent(no_zeros(digits(c)))


def number_or_file(said: Column, by_file: Column) -> Column:
    """The payload's digits if it has any, else the file's number."""
    return F.when(digits(said) != "", plain_number(said)).otherwise(by_file)


def document_fields(rows: DataFrame, payer_word: str, payer_root: str) -> DataFrame:
    """rows (file, payload, and a column tax_id of the report) with nf, nf_alt, order_nr, emitter, emitter_id, cents, due, day.

    Where the payer was read as the emitter, only the part that is the payer's goes: the name that holds its word,
    the id of its root. An instalment's day is its due date.
    """
    rows = rows.withColumn("_p", F.from_json("payload", MAP))
    p, file = F.col("_p"), F.col("file")
    by_file = text.number_in_file(file)
    due = F.trim(absent(F.nullif(first_said(p, DUE_KEYS), F.lit(BLANK))))
    rows = rows.withColumns({
        "_file_nf": by_file, "nf": number_or_file(first_said(p, NUMBER_KEYS), by_file), "order_nr": number_or_file(first_said(p, ORDER_KEYS), text.order_in_file(file)),
        "emitter": absent(norm(F.coalesce(first_said(p, EMITTER_KEYS), text.emitter_in_file(file)))), "emitter_id": F.coalesce(text.tax_id(first_said(p, TAX_ID_KEYS)), text.tax_id(F.col("tax_id"))),
        "cents": F.coalesce(text.money_cents(first_said(p, VALUE_KEYS)), text.amount_in_file(file)), "due": due,
    })
    part = F.coalesce(first_said(p, (INSTALMENT_KEY,)).isNotNull() & F.col("due").isNotNull(), F.lit(False))
    return rows.withColumns({
        "nf_alt": F.when(~F.col("_file_nf").eqNullSafe(F.col("nf")), F.col("_file_nf")), "day": F.when(part, dates.written_date(F.col("due"))).otherwise(dates.file_date(file)),
        "emitter": F.when(~F.coalesce(F.col("emitter").rlike(f"{text.B}{payer_word}{text.E}"), F.lit(False)), F.col("emitter")),
        "emitter_id": F.when(~F.coalesce(F.left("emitter_id", F.lit(8)) == payer_root, F.lit(False)), F.col("emitter_id")),
    }).drop("_p", "_file_nf")


def due_in(due: Column, period: Column) -> Column:
    """Whether a written due date falls in a period MM.YYYY."""
    return F.coalesce(dates.period(dates.written_date(due)) == period, F.lit(False))


def instalment_due(file: Column, payload: Column) -> Column:
    """The due date of a row that is an instalment (#pN with a part in its payload)."""
    p = F.from_json(payload, MAP)
    part = file.rlike("(?i)#p\\d+$") & absent(F.element_at(p, INSTALMENT_KEY)).isNotNull()
    return F.when(part, absent(F.element_at(p, DUE_KEYS[0])))


def due_day(c: Column) -> Column:
    """DD/MM/YYYY as the day key DD.MM.YYYY."""
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.replace(c, F.lit("/"), F.lit(".")))


def cut(c: Column, most: int) -> Column:
    """Trimmed text of at most so many characters; nothing is the empty text."""
    return F.left(F.coalesce(F.trim(c), F.lit("")), F.lit(most))


def farm_name(c: Column) -> Column:
    """A farm's name with the small farm's word replaced."""
    return F.trim(F.regexp_replace(without_null_words(c), f"(?iu){text.B}S[íi]tio{text.E}", "Fazenda"))


def number_key(kind: Column) -> Column:
    """The payload's key of the number, by kind."""
    table = F.create_map(*[F.lit(x) for kv in NUMBER_KEY.items() for x in kv])
    return F.coalesce(F.element_at(table, kind), F.lit(NUMBER_KEYS[0]))


def known_kind(c: Column) -> Column:
    k = F.upper(F.trim(c))
    return F.when(k.isin(*KINDS), k).otherwise("")


PART = "struct<vencimento:string,valor:string,nossoNumero:string>"
ANSWER = f"struct<tipo:string,emitente:string,cnpj:string,dataEmissao:string,dataVencimento:string,numeroDocumento:string,ordemCompra:string,valorTotal:string,parcelas:array<{PART}>>"


def answers(c: Column) -> Column:
    """A full reading of a document: kind of the known ones, numbers as digits, distinct instalments by due date."""
    return bound(json_text(c), lambda t: bound(F.from_json(t, ANSWER), lambda a: bound(distinct_parts(a["parcelas"]), lambda first: clean_answer(a, first))))


def distinct_parts(parts: Column) -> Column:
    """Instalments with a due date, the first of each own number, or else of each due date and value."""
    due = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda x: due_key(x["vencimento"]).isNotNull())
    key = lambda x: F.coalesce(F.concat(F.lit("n"), absent(F.trim(x["nossoNumero"]))), F.concat_ws("|", F.lit("d"), x["vencimento"], number_or_zero(x["valor"]).cast("string")))
    keyed = F.transform(due, lambda x: F.struct(key(x).alias("key"), x.alias("part")))
    fresh = lambda every: F.filter(every, lambda x, i: F.array_position(every["key"], x["key"]) == i + 1)
    return F.transform(bound(keyed, fresh), lambda x: x["part"])


def clean_answer(a: Column, first: Column) -> Column:
    tax_id = digits(a["cnpj"])
    return F.struct(
        known_kind(a["tipo"]).alias("kind"), cut(a["emitente"], 1 << 20).alias("emitter"), F.when(F.length(tax_id).isin(11, 14), tax_id).otherwise("").alias("tax_id"), cut(a["dataEmissao"], 40).alias("issued"), cut(a["dataVencimento"], 40).alias("due"),
        F.coalesce(plain_number(a["numeroDocumento"]), F.lit("")).alias("number"), F.coalesce(plain_number(a["ordemCompra"]), F.lit("")).alias("order_nr"), (number_or_zero(a["valorTotal"]) * 100).cast("bigint").alias("cents"),
        (F.size(first) > 1).alias("in_parts"), F.transform(first, lambda x: F.struct(x["vencimento"].alias("due"), (number_or_zero(x["valor"]) * 100).cast("bigint").alias("cents"), F.coalesce(F.trim(x["nossoNumero"]), F.lit("")).alias("own_number"))).alias("parts"),
    )


def answer_rows(rows: DataFrame, answer: str, local: DataFrame, key: str = "doc_seq", keep=lambda df: df) -> DataFrame:
    """(key, file, kind, number, due, cents, origin): one row a document or instalment.

    An answer without kind, emitter, number and parts is of no use; such documents keep the row that local reading gave.
    Answers are read once a row, as explode() stops the optimizer from repeating them; keep() may store what they say,
    which is asked for twice.
    """
    a = keep(rows.select(key, "file", F.explode(F.array(answers(F.col(answer)))).alias("a")))
    useful = (F.col("a.kind") != "") | (F.col("a.emitter") != "") | (F.col("a.number") != "") | (F.size("a.parts") > 0)
    good = a.where(F.coalesce(useful, F.lit(False)))
    parts = good.select(key, "file", "a", F.posexplode_outer(F.when(F.col("a.in_parts"), F.col("a.parts"))).alias("_i", "part"))
    only = F.when(F.size("a.parts") == 1, F.get("a.parts", 0)["due"])
    cents = F.when(F.col("part").isNull(), F.col("a.cents")).otherwise(F.when(F.col("part.cents") > 0, F.col("part.cents")).otherwise(F.col("a.cents")))
    read = parts.select(
        key, F.when(F.col("_i").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("#p"), (F.col("_i") + 1).cast("string"))).alias("file"),
        F.when(F.col("a.kind") == "", UNKNOWN).otherwise(F.col("a.kind")).alias("kind"), absent(F.col("a.number")).alias("number"), F.coalesce(F.col("part.due"), absent(F.col("a.due")), only).alias("due"), F.when(cents > 0, cents).alias("cents"), F.lit("answer").alias("origin"),
    )
    rest = local.join(good.select(key), key, "left_anti")
    return read.unionByName(rest.select(key, "file", "kind", "number", "due", "cents", F.lit("local").alias("origin")))


NOTE = "struct<numero:string,dataEmissao:string,emitente:struct<razaoSocial:string,cnpj:string>,destinatario:struct<razaoSocial:string,cnpj:string,endereco:string>,itens:array<struct<descricao:string>>,totalNF:string>"


def summary_notes(c: Column) -> Column:
    """Notes of a short reading: items are descriptions, ids that are none are blank, totals that are none are zero."""
    notes = F.coalesce(bound(json_text(c), lambda t: F.from_json(t, f"struct<notas:array<{NOTE}>>"))["notas"], F.array().cast(f"array<{NOTE}>"))
    said = lambda x: F.coalesce(without_null_words(x), F.lit(""))
    valid = lambda x: F.when(F.coalesce(said(x).rlike(f"^(?:{text.TAX_ID}|{text.PERSON_ID})$"), F.lit(False)), said(x)).otherwise("")
    lines = lambda n: F.filter(F.transform(F.coalesce(n["itens"], F.array().cast("array<struct<descricao:string>>")), lambda i: said(i["descricao"])), lambda d: d != "")
    note = lambda n: F.struct(said(n["numero"]).alias("number"), said(n["emitente"]["razaoSocial"]).alias("emitter"), valid(n["emitente"]["cnpj"]).alias("emitter_id"), said(n["destinatario"]["razaoSocial"]).alias("recipient"), valid(n["destinatario"]["cnpj"]).alias("recipient_id"), lines(n).alias("items"), (number_or_zero(n["totalNF"]) * 100).cast("bigint").alias("cents"))
    return F.transform(F.filter(notes, lambda n: n.isNotNull()), note)


def kind_answer(c: Column) -> Column:
    """(kind, confidence) of a classifier's answer; a kind that is none of the known is unknown with low confidence."""

    def judged(a: Column) -> Column:
        known = F.coalesce(a["category"].isin(*KINDS, UNKNOWN), F.lit(False))
        return F.struct(F.when(known, a["category"]).otherwise(UNKNOWN).alias("kind"), F.when(known, a["confidence"]).otherwise(UNSURE).alias("confidence"))

    return bound(json_text(c), lambda t: bound(F.from_json(t, "struct<category:string,confidence:string>"), judged))


def typed_fields(c: Column, kind: Column) -> Column:
    """An answer's fields that its kind has, as a map; fields of other kinds and those not said go."""
    said = F.from_json(json_text(c), MAP)
    table = F.create_map(*[x for k, v in TYPED_FIELDS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v.split()]))])
    names = F.coalesce(F.element_at(table, kind), F.array().cast("array<string>"))
    return F.map_filter(F.coalesce(said, F.create_map().cast(MAP)), lambda k, v: F.array_contains(names, k) & v.isNotNull())


def pictures(images: Column) -> Column:
    """The first valid data URIs of a list: (media type, payload)."""
    shape = r"^data:image/(jpeg|jpg|png);base64,([A-Za-z0-9+/=]+)$"
    valid = F.slice(F.filter(images, lambda x: (F.length(x) <= PICTURE_CHARS) & x.rlike(shape)), 1, PICTURES)
    kind = lambda x: F.regexp_extract(x, shape, 1)
    return F.transform(valid, lambda x: F.struct(F.concat(F.lit("image/"), F.when(kind(x) == "jpg", "jpeg").otherwise(kind(x))).alias("media_type"), F.regexp_extract(x, shape, 2).alias("data")))


def first_pages(rows: DataFrame, doc: str, order: str, most: int = PICTURES) -> DataFrame:
    """A document's first pages, in order."""
    place = Window.partitionBy(doc).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")
