"""Document kinds and fields from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import PERSON_ID, TAX_ID, B, E, absent, bound, found, norm_ascii


def w(words: str) -> str:
    """Whole words."""
    return f"{B}(?:{words}){E}"


# Marks of each kind over unaccented capitals, in order of evaluation.
STRONG = (
    ("CONSORCIO", w("CONSORCIO") + "|COTA DE CONSORCIO|PARCELA DE CONSORCIO|" + w("ADMINISTRADORA DE CONSORCIOS?|GRUPO DE CONSORCIO")),
    ("CTE", w("DACTE") + "|CONHECIMENTO DE TRANSPORTE|DOCUMENTO AUXILIAR DO CONHECIMENTO|" + w("CT-?E|MDF-?E") + "|TRANSPORTE RODOVIARIO DE CARGAS"),
    ("IMPOSTO", w("DARF") + "|ARRECADACAO DE RECEITAS FEDERAIS|GUIA DA PREVIDENCIA SOCIAL|" + w("DCTFWEB") + "|FGTS DIGITAL|GUIA DO FGTS|" + w("GFD") + "|DARF-?SIMPLES"),
    ("NF", w("DANFE") + "|DOCUMENTO AUXILIAR DA NOTA FISCAL ELETRONI|NATUREZA DA OPERACAO"),
    ("NFS", w("NFS-?E") + "|NOTA FISCAL DE SERVICOS? ELETRONICA|NOTA FISCAL ELETRONICA DE SERVICOS?"),
)
PUBLIC_BODY = w("GOVERNO|PREFEITURA|MUNICIPIO|SECRETARIA|MINISTERIO|RECEITA FEDERAL|FAZENDA (?:NACIONAL|ESTADUAL|MUNICIPAL|PUBLICA)|SEFAZ|ESTADO DE|UNIAO|TRIBUNAL|AUTARQUIA")
WEAK = (
    ("IMPOSTO", w("GUIA|DCTFWEB|INSS|FGTS|DARF|GPS")),
    ("NFS", "NOTA FISCAL DE SERVICOS?"),
    ("FATURA", w("FATURA")),
    ("NF", "NOTA FISCAL"),
    ("RECIBO", w("RECIBO")),
)
#: For each pattern a few words of which any match of it holds one, so that most texts are told by plain searches.
HINTS = {
    STRONG[0][1]: ("CONSORCIO",),
    STRONG[1][1]: ("CTE", "CT-E", "MDF", "CONHECIMENTO", "TRANSPORTE RODOVIARIO"),
    STRONG[2][1]: ("DARF", "ARRECADACAO DE", "GUIA D", "DCTFWEB", "FGTS DIGITAL", "GFD"),
    STRONG[3][1]: ("DANFE", "DOCUMENTO AUXILIAR", "NATUREZA DA"),
    STRONG[4][1]: ("NFS", "NOTA FISCAL"),
    WEAK[0][1]: ("GUIA", "DCTFWEB", "INSS", "FGTS", "DARF", "GPS"),
    WEAK[1][1]: ("NOTA FISCAL DE",),
    WEAK[2][1]: ("FATURA",),
    WEAK[3][1]: ("NOTA FISCAL",),
    WEAK[4][1]: ("RECIBO",),
}
# An electronic invoice's key, the nature of its operation and its purchase order.
ACCESS_KEY = rf"{B}(\d[\d ]{{42,52}}\d){E}"
NATURE = r"NATUREZA DA OPERACAO[:\s]*([A-Z0-9 .,/-]{4,40})"
PURCHASE_ORDER = (r"(?:ORDEM\s+DE\s+COMPRA[-–\s]*OCP|OCP|ORDEM\s+DE\s+COMPRA)[:\s#Nº°.]*(\d{4,})", rf"{B}OC[:\s#]*(\d{{4,}}){E}")
UNKNOWN = "Não identificado"
MONEY = r"R?\$?\s*([\d.,]{3,})"
# A field's label and shape, by document kind.
FIELDS = {
    "NF": {
        "number": r"(?:NR\.?DOCUMENTO|N[º°]?\.?\s*(?:DA )?NF-?E|NUMERO)\D{0,8}(\d{3,9})",
        "series": r"SERIE\D{0,4}(\d{1,3})",
        "issued": r"(?:DATA (?:DE |DA )?EMISSAO|EMISSAO)[:\s]*([\d/]{8,10})",
        "emitter_id": rf"{B}CNPJ[:\s]*({TAX_ID})",
        "total": rf"VALOR TOTAL DA NOTA[:\s]*{MONEY}",
    },
    "CTE": {
        "number": r"(?:NR\.?DOCUMENTO|N[º°]?\.?\s*(?:DO )?CT-?E)\D{0,8}(\d{3,9})",
        "issued": r"(?:DATA (?:DE |DA )?EMISSAO|EMISSAO)[:\s]*([\d/]{8,10})",
        "emitter_id": rf"{B}CNPJ[:\s]*({TAX_ID})",
        "total": rf"VALOR TOTAL DA PRESTACAO[:\s]*{MONEY}",
    },
    "IMPOSTO": {
        "slip": w("DARF-?SIMPLES|DARF|GPS|DCTFWEB|GFD|FGTS DIGITAL|GNRE").replace("(?:", "(", 1),
        "emitter_id": rf"{B}(?:CNPJ|CPF)[:\s]*({TAX_ID}|{PERSON_ID})",
        "due": r"(?:DATA DE )?VENCIMENTO[:\s]*([\d/]{8,10})",
        "total": rf"VALOR TOTAL[:\s]*{MONEY}",
    },
}
# Marks of a payment slip, and of its repeated parts.
SLIP = "NOSSO NUMERO|FICHA DE COMPENSA|" + w("CEDENTE") + "|BENEFICIARIO|" + w("PAGADOR|SACADO") + "|LINHA DIGITAVEL"
# Words of a carrier's paper that the text alone does not prove.
TRANSPORT = w("EXPRESSO|TRANSPORTES?") + "|TRANSPORTADORA|RODOVIARIO|" + w("LOGISTICA") + "|TRANSPORTE DE CARGA"
CONFIRMED = "DACTE confirmado"
HINTS[TRANSPORT] = ("EXPRESSO", "TRANSPORT", "RODOVIARIO", "LOGISTICA")
HINTS[SLIP] = ("NOSSO NUMERO", "FICHA DE COMPENSA", "CEDENTE", "BENEFICIARIO", "PAGADOR", "SACADO", "LINHA DIGITAVEL")
SLIP_PARTS = (r"\d{5}[.\s]\d{5}\s+\d{5}[.\s]\d{6}\s+\d{5}[.\s]\d{6}\s+\d\s+\d{14}", r"NOSSO NUMERO\D{0,8}[\d./-]{6,}", r"VENCIMENTO\D{0,8}\d{2}[/.]\d{2}[/.]\d{2,4}")


def classified(text: Column, emitter: Column) -> Column:
    """(kind, evidence, origin): the first strong mark, a public emitter, the first weak mark."""
    return bound(norm_ascii(text), lambda t: verdict_of(t, norm_ascii(emitter)))


def holds(t: Column, pattern: str) -> Column:
    """Whether a pattern matches; it is only tried where one of its words stands."""
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(word)) for word in HINTS[pattern]]) & t.rlike(pattern)


def verdict_of(t: Column, e: Column) -> Column:
    verdict = lambda kind, evidence, origin: F.struct(F.lit(kind).alias("kind"), evidence.alias("evidence"), F.lit(origin).alias("origin"))
    rules = [(holds(t, p), verdict(k, F.regexp_extract(t, p, 0), "strong")) for k, p in STRONG]
    rules.append((F.coalesce(e.rlike(PUBLIC_BODY), F.lit(False)), verdict("IMPOSTO", F.concat(F.lit("emitter: "), e), "emitter")))
    rules += [(holds(t, p), verdict(k, F.regexp_extract(t, p, 0), "weak")) for k, p in WEAK]
    chain = reduce(lambda c, rule: c.when(*rule), rules[1:], F.when(*rules[0]))
    return chain.otherwise(verdict(UNKNOWN, F.lit(None).cast("string"), "none"))


def analyzed(text: Column, emitter: Column, picture: Column, reading: Column) -> Column:
    """(kind, evidence, origin, read, text): a document's verdict, with a reading of its picture as a second source.

    The reading counts where the text is a picture's or tells no kind, if it tells one. A document of another kind that
    no strong mark proves, and whose text sounds like a carrier's, becomes a CTE if the reading holds that kind's mark.
    """
    said = F.struct(text.alias("text"), reading.alias("reading"), classified(text, emitter).alias("c"), classified(reading, emitter).alias("r"), F.coalesce(picture, F.lit(False)).alias("picture"))

    def judge(x: Column) -> Column:
        unsure = x["reading"].isNotNull() & (x["picture"] | (x["c"]["kind"] == UNKNOWN))
        taken = unsure & (x["r"]["kind"] != UNKNOWN)
        read = taken | (unsure & x["picture"])
        verdict = F.when(taken, x["r"]).otherwise(x["c"])
        full = F.when(taken, x["reading"]).when(read, F.coalesce(absent(x["reading"]), x["text"])).otherwise(x["text"])
        carrier = ~read & (verdict["kind"] != "CTE") & (verdict["origin"] != "strong") & x["reading"].isNotNull()
        carrier &= bound(norm_ascii(x["text"]), lambda t: holds(t, TRANSPORT)) & bound(norm_ascii(x["reading"]), lambda t: holds(t, STRONG[1][1]))
        carrier = F.coalesce(carrier, F.lit(False))
        return F.struct(
            F.when(carrier, "CTE").otherwise(verdict["kind"]).alias("kind"), F.when(carrier, CONFIRMED).otherwise(verdict["evidence"]).alias("evidence"), F.when(carrier, "reading").otherwise(verdict["origin"]).alias("origin"),
            (F.coalesce(read, F.lit(False)) | carrier).alias("read"), F.when(carrier, F.concat(x["text"], F.lit("\n"), x["reading"])).otherwise(full).alias("text"),
        )

    return bound(said, judge)


def fields(text: Column, kind: str) -> Column:
    """The labelled fields of a kind; what is not there is NULL."""
    return bound(norm_ascii(text), lambda t: F.struct(*[F.trim(found(t, p)).alias(name) for name, p in FIELDS[kind].items()]))


def product_fields(text: Column) -> Column:
    """The fields of a product invoice, with its key, the nature of the operation and the purchase order."""

    def found_in(t: Column) -> Column:
        named = [F.trim(found(t, p)).alias(name) for name, p in FIELDS["NF"].items()]
        key = absent(F.regexp_replace(F.regexp_extract(t, ACCESS_KEY, 1), r"\s+", ""))
        return F.struct(*named, key.alias("access_key"), F.trim(found(t, NATURE)).alias("nature"), F.coalesce(*[found(t, p) for p in PURCHASE_ORDER]).alias("order_nr"))

    return bound(norm_ascii(text), found_in)


def may_hold_slips(text: Column, pages: Column) -> Column:
    """A payment slip with two different lines, own numbers or due dates, or of two pages."""

    def gate(t: Column) -> Column:
        repeated = [F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))) >= 2 for p in SLIP_PARTS]
        return holds(t, SLIP) & (reduce(lambda a, b: a | b, repeated) | (F.coalesce(pages, F.lit(0)) >= 2))

    return bound(norm_ascii(text), gate)
