"""Text normalisation and extraction as Column expressions; absent values are NULL.

Word boundaries are written as look-arounds over ASCII word characters, and white space includes the
no-break space and the byte-order mark, so results do not depend on a regex engine's idea of Unicode.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\u00A0\uFEFF]+"
#: A word boundary before and after, for ASCII letters, digits and the underscore.
B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

def _decomposed() -> tuple[str, str, str]:
    """Letters below U+2000 with marks and the letters under them, and the marks themselves, by Unicode's decomposition."""
    letters, plain, marks = [], [], []
    for c in map(chr, range(0x80, 0x2000)):
        base = [d for d in unicodedata.normalize("NFD", c) if not 0x300 <= ord(d) <= 0x36F]
        if not base:
            marks.append(c)
        elif base != [c] and len(base) == 1:
            letters.append(c)
            plain.append(base[0])
    return "".join(letters), "".join(plain), "".join(marks)


ACCENTED, UNACCENTED, MARKS = _decomposed()

# The pattern of a tax id (14 digits) and of a personal one (11 digits), with or without signs.
TAX_ID = r"\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}[-\s]?\d{2}"
PERSON_ID = r"\d{3}[.\s]?\d{3}[.\s]?\d{3}[-\s]?\d{2}"
# Company forms and trade words that are no part of a name's core.
CORE_NOISE = r"S/?A|S\.?A\.?|LTDA|ME|EPP|EIRELI|CIA|COMPANHIA|REDES?|DISTRIBUIDORA|COMERCIO|COM|IND(?:USTRIA)?|SERVICOS?|S\.A|EI"
# Marks before a document's number in a file name.
NUMBER_MARK = r"(?:NFS?|NF-?e|CTE|CT-?e|RCB|RC|FAT|FT)"
# Numbers, orders, amounts and emitters as they stand in file names, and words that mean nothing.
LAST_NUMBER = r"[.\s](\d{3,})\s*$"
ORDER_MARK = rf"(?i){B}OCP?\s*[-#.]?\s*(\d{{4,}})"
FILE_AMOUNT = r"(?i)DOC[-\s]*(?:R\$\s*)?(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})"
FILE_EMITTER = (
    rf"(?i)\d{{4}}\.\d{{2}}\.\d{{2}}\s*[.,]?\s*(.+?)\s*[.,]?\s*{B}{NUMBER_MARK}\s*\.?\s*\d",
    rf"(?i){B}DOC[-\s]+[\d.,]+\s*[-–]\s*[\d.]+\s*[.,]\s*(.+?)\s*[.,]?\s*{B}NF\s+\d",
    rf"(?i){B}DOC[-\s]+[\d.,]+[-–]\d{{4}}-\d{{2}}-\d{{2}}[-–\s]+(.+?)\s*[-–]\s*NF\s+\d",
)
NULL_WORDS = r"(?i)(?:^|\s*[-–]\s*)(?:null|undefined|n/a)\s*$"
BARE_TAX_ID = r"(?<!\d)\d{14}(?!\d)"
# What a document mark, a date and a document's prefix look like in a normalised file name.
KIND_MARK = rf"{B}(?:RCB|RC|RECIBO|FAT|FT|FATURA|NFS|NFE|NF|BOL|BOLETO|GUIA|DARF|GPS|INSS|FGTS|CTE|DACTE|IMOVEL|OCP|OC){E}"
NAME_DATE = rf"(?:20\d{{2}}\.\d{{2}}\.\d{{2}}|\d{{2}}\.\d{{2}}\.20\d{{2}}|{B}20\d{{2}})\.?"
NAME_PREFIX = r"^\d{1,4}\.?DOC[-\s]*[\d.,]*\s*-?\s*"
TAIL_CODES = r"\s+[A-Z]?\d[A-Za-z0-9_]*(?:\s+[A-Z]?\d[A-Za-z0-9_]*)*$"


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, not wherever body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def absent(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or NULL."""
    return absent(F.regexp_extract(c, pattern, group))


def norm(c: Column) -> Column:
    """Trimmed, upper case, single spaces; accents stay."""
    return F.upper(F.trim(F.regexp_replace(c, BLANK, " ")))


def norm_ascii(c: Column) -> Column:
    """As norm, without accents."""
    return F.trim(F.regexp_replace(F.translate(F.upper(c), ACCENTED + MARKS, UNACCENTED), BLANK, " "))


def norm_company(c: Column) -> Column:
    """As norm_ascii, with anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(norm_ascii(c), "[^A-Z0-9]+", " "))


def entity_core(c: Column) -> Column:
    """A company's name without tax ids, forms and signs."""
    c = norm(c)
    for pattern in (f"{B}{TAX_ID}{E}", f"{B}{PERSON_ID}{E}", f"{B}(?:{CORE_NOISE}){E}", r"[.,/\-]"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, BLANK, " "))


def tax_id(c: Column) -> Column:
    """The first 14-digit id, written out or bare, as digits."""
    return F.coalesce(absent(digits(F.regexp_extract(c, TAX_ID, 0))), found(c, BARE_TAX_ID, 0))


def labelled_tax_id(c: Column) -> Column:
    """The id after its label, or else the first fully written one, as it stands."""
    t = norm_ascii(c)
    return F.coalesce(found(t, rf"{B}CNPJ[:\s/]*?({TAX_ID})"), found(t, r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def masked_id(c: Column) -> Column:
    """14 or 11 digits in their written form, anything else NULL."""
    d = digits(c)
    long = F.concat_ws("", d.substr(1, 2), F.lit("."), d.substr(3, 3), F.lit("."), d.substr(6, 3), F.lit("/"), d.substr(9, 4), F.lit("-"), d.substr(13, 2))
    short = F.concat_ws("", d.substr(1, 3), F.lit("."), d.substr(4, 3), F.lit("."), d.substr(7, 3), F.lit("-"), d.substr(10, 2))
    return F.when(F.length(d) == 14, long).when(F.length(d) == 11, short)


def no_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def clean_number(c: Column) -> Column:
    """A document number without leading letters and zeros; suffixes stay."""
    c = F.trim(c)
    return absent(F.coalesce(absent(no_zeros(F.regexp_replace(c, "^[A-Za-z]+", ""))), no_zeros(c)))


def base_file(c: Column) -> Column:
    """A file name without the mark of an instalment."""
    return F.regexp_replace(c, "(?i)#p\\d+$", "")


def stem(c: Column) -> Column:
    return F.regexp_replace(base_file(c), "(?i)\\.pdf$", "")


def number_in_file(c: Column) -> Column:
    """The number behind a document mark, else a last block of three digits or more."""
    marked = found(base_file(c), rf"(?i){B}{NUMBER_MARK}\s*\.?\s*(\d+)")
    bare = found(stem(c), LAST_NUMBER)
    n = F.coalesce(marked, bare)
    return F.coalesce(absent(no_zeros(n)), n)


def order_in_file(c: Column) -> Column:
    """A purchase order's number."""
    return absent(no_zeros(F.regexp_extract(base_file(c), ORDER_MARK, 1)))


def emitter_in_file(c: Column) -> Column:
    """The emitter between a date or an amount and the document mark, by three patterns in order."""
    name = F.trim(stem(c))
    return absent(F.trim(F.regexp_replace(F.coalesce(*[found(name, p) for p in FILE_EMITTER]), r"[.,\s]+$", "")))


def bare_edges(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^[\s.,\-]+|[\s.,\-]+$", ""))


def emitter_by_marks(c: Column) -> Column:
    """The emitter between a file name's date, or its prefix, and the first document mark; codes at its end go.

    If nothing is left before the mark, the mark is part of the name.
    """
    name = norm_ascii(F.regexp_replace(c, "(?i)\\.pdf$", ""))
    date = F.regexp_instr(name, F.lit(NAME_DATE))
    after_date = F.substring(name, date + F.length(F.regexp_extract(name, NAME_DATE, 0)), F.length(name))
    rest = F.when(date > 0, after_date).otherwise(F.regexp_replace(name, NAME_PREFIX, ""))
    mark = F.regexp_instr(rest, F.lit(KIND_MARK))
    before = bare_edges(F.when(mark > 0, F.substring(rest, F.lit(1), mark - 1)).otherwise(rest))
    whole = F.when(F.length(before) < 2, bare_edges(rest)).otherwise(before)
    short = bare_edges(F.regexp_replace(whole, TAIL_CODES, ""))
    return F.when((F.length(short) >= 2) & ~short.rlike(r"^[\d.,\s]+$"), short)


def money_cents(c: Column) -> Column:
    """Cents of an amount such as 1.234,56; NULL unless above zero."""
    plain = F.replace(F.replace(F.regexp_replace(c, r"[^\d,.\-]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    cents = (F.regexp_extract(plain, r"^-?\d*\.?\d+", 0).try_cast("decimal(18,4)") * 100).cast("decimal(18,0)").cast("bigint")
    return F.when(cents > 0, cents)


def amount_in_file(c: Column) -> Column:
    return money_cents(found(base_file(c), FILE_AMOUNT))


def without_null_words(c: Column) -> Column:
    """Trimmed, without a trailing null, undefined or n/a."""
    return F.trim(F.regexp_replace(F.trim(c), NULL_WORDS, ""))
