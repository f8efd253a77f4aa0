"""What makes a document and a ledger note agree, as Column expressions over whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B, E, base_file, entity_core, norm

#: Cents by which equal values may differ, and the most instalments of a purchase.
TOLERANCE, INSTALMENTS = 2, 24
# Ledger categories that are no fiscal documents.
NOT_FISCAL = ("PREVISAO", "FINANC GIRO", "ADIANTAMENTO", "DUPLICATA", "IMPOSTO")
# Ledger category to document kind; the wildcard agrees with any kind.
KINDS = {"NOTA FISCAL RFB": "NF", "NOTA FISCAL SERVICO": "NFS", "FATURA": "FATURA", "IMPOSTO": "IMPOSTO", "RECIBO E OUTROS": "*"}


def is_card_entry(number: Column, entity: Column) -> Column:
    """Credit-card entries of the ledger, by number code or by entity."""
    return F.upper(F.trim(number)).rlike(r"^CC\d|^CR[.\s]") | entity.rlike(rf"{B}CAR(TAO)?\s*CRED|{B}CARTAO\s+DE\s+CREDITO{E}")


# Number series of tax slips, and the marks of card files.
TAX_SERIES = (r"9039\d{2}$", r"9049\d{2}$")
CARD_MARKS = (rf"{B}CC\s?\d{{2,}}{E}", rf"{B}CART[ÃA]O\s+DE\s+CR[ÉE]DITO{E}")


def is_tax(kind: Column, number: Column, emitter: Column, file: Column) -> Column:
    """Taxes: by kind, by number series, or by a public emitter."""
    tests = (norm(kind) == "IMPOSTO", *[number.rlike(f"^{s}") for s in TAX_SERIES], F.upper(emitter).rlike("GOVERNO|PREFEITURA"), F.upper(file).rlike(rf"{B}GOVERNO{E}"))
    return F.greatest(*[F.coalesce(t, F.lit(False)) for t in tests])


def is_card_file(file: Column) -> Column:
    """Card statements, by a code of two digits or more or by the card's words in the file's name."""
    name = F.upper(base_file(file))
    return F.coalesce(F.greatest(*[name.rlike(m) for m in CARD_MARKS]), F.lit(False))


def ledger_kind(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.element_at(table, norm(category))


def kind_ok(doc_kind: Column, note_kind: Column) -> Column:
    """Kinds agree, or one side gives nothing to compare."""
    d, n = norm(doc_kind), norm(note_kind)
    service = d.isin("NF", "NFS")
    ok = (n == "*") | (d == n) | (d == "NÃO IDENTIFICADO") | (service & n.isin("NF", "NFS", "FATURA"))
    return n.isNull() | d.isNull() | (n == "") | (d == "") | ok


def near(a: Column, b: Column) -> Column:
    return (b > 0) & (F.abs(a - b) <= TOLERANCE)


def value_basis(doc: Column, header: Column, item_sum: Column, items: Column) -> Column:
    """What of the note the document's value equals: header, items, one item, or an instalment; else NULL.

    n instalments may miss the header by 1.5 cents each and the tolerance; unequal ones must divide the
    header within 0.01 of a whole number.
    """
    counts = F.sequence(F.lit(2), F.lit(INSTALMENTS))
    even = F.get(F.filter(counts, lambda n: F.abs(doc * n - header) * 10 <= n * 15 + TOLERANCE * 10), 0)
    ratio = F.floor((header * 2 + doc) / (doc * 2)).cast("bigint")  # rounded half up
    uneven = F.when((header * 2 > doc * 3) & ratio.between(2, INSTALMENTS) & (F.abs(header - ratio * doc) * 100 <= doc), ratio)
    parts = F.coalesce(even.cast("bigint"), uneven)
    return (
        F.when(F.coalesce(doc, F.lit(0)) <= 0, F.lit(None))
        .when(near(doc, header), "header")
        .when(near(doc, item_sum), "items")
        .when(F.exists(items, lambda v: F.abs(doc - v) <= TOLERANCE), "item")
        .when((header > doc) & parts.isNotNull(), F.concat(F.lit("instalment "), parts.cast("string"), F.lit("x")))
    )


def first_words(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def names_match(a: Column, b: Column, core_a: Column | None = None, core_b: Column | None = None) -> Column:
    """Equal, sharing first words, or one name's core within the other's; an absent name never matches.

    Where the cores are given as columns, computed once before a join, the names must be normalised too.
    """
    if core_a is None or core_b is None:
        a, b = norm(a), norm(b)
        core_a, core_b = entity_core(a), entity_core(b)
    wa, wb = first_words(a), first_words(b)
    words = (a == b) | (wa == wb) | F.contains(a, wb) | F.contains(b, wa)
    core = (core_a != "") & (core_b != "") & (F.contains(core_a, core_b) | F.contains(core_b, core_a))
    return F.coalesce((a != "") & (b != "") & (words | core), F.lit(False))


def same_entity(name_a: Column, id_a: Column, name_b: Column, id_b: Column, core_a: Column | None = None, core_b: Column | None = None) -> Column:
    """Equal tax ids are proof; different ones prove nothing and the names decide."""
    return F.coalesce(id_a == id_b, F.lit(False)) | names_match(name_a, name_b, core_a, core_b)
