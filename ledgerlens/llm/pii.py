"""Personal data in plain and in disguised form, with spans in the source text.

Plain identifiers are found by fixed patterns. For disguised ones small transducers rewrite the text:
look-alike characters, compatibility forms and character entities become ASCII, spelled digits become digits, and forms such as "(at)" or " dot "
become "@" and ".". Separators inside a spelled number go, first those up to commas; a span that another
way of joining finds is taken where none of its kind was. Each rewritten stretch remembers where it came
from, so a span found in the rewritten text is mapped back to the characters of the source. Plain spans
always stay; a mapped span is added if it holds at least one rewritten stretch and is no plain span already.

A bare " at " before a plain domain counts only if the name looks like one or an announcing word stands at most
CUE_WORDS words before it; the word lists below are fixed values and decide no more than that.

Defined cases: a null text is the empty text and has no spans; spans count code points, the end is
exclusive; kinds are found independently and may overlap; repeated rows give repeated results; an empty table
gives an empty result; other columns, whatever their names, are not looked at. Very long texts are scanned whole, in
time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The plain patterns.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Spelled digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

# Letters of other scripts that look like ASCII letters, and signs that stand for others.
LOOK_ALIKES = {
    **dict(zip("аеорсхуіјѕԁһкмтвн", "aeopcxyijsdhkmtbh", strict=True)),
    **dict(zip("οανιρτυκε", "oaviptuke", strict=True)),
    **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212\ufe63", "-"),
    **dict.fromkeys("\u00a0\u2007\u2009\u202f", " "),
    **dict.fromkeys("\u3002\u2024\ufe52", "."),
    "\ufe6b": "@",
}  # lower case: the text is lowered first
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def spelled(words) -> str:
    """An alternation that branches on the first letter, so that most places fail at once."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by_letter.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(map(re.escape, rest))})" for a, rest in sorted(by_letter.items()))


WORD = rf"(?:{spelled(DIGIT_WORDS)})"
DIGIT_RUN = re.compile(rf"(?<!\w)(?:plus\s+)?(?:(?:double|triple)\s+)?{WORD}(?:(?:[\s,.-]+|\s+(?:dot|punto|punkt|point)\s+)(?:(?:double|triple)\s+)?(?:{WORD}|\d+)(?!\w)){{2,}}")
DIGIT_PART = re.compile(rf"(?<!\w)(?:(plus)\s+(?=\w)|(?:(double|triple)\s+)?({WORD}|\d+)(?!\w))")
#: Which separators inside a run are left out, tried in this order: up to commas, up to blanks and hyphens, all, none.
JOINS = (1, 0, 2, -1)
#: Blanks before a bracket are tried from the first of them on only, so a long run of blanks costs no more than its length.
OPEN, CLOSE = r"(?:(?<!\s)\s++)?[\[({<]\s*+", r"\s*+[\])}>]\s*+"
AT_MARK = rf"{OPEN}(?:at|arroba|arobase|@){CLOSE}|_(?:at|arroba|arobase)_"
DOT_MARK = rf"{OPEN}(?:dot|punto|punkt|point|\.){CLOSE}|_(?:dot|punto|punkt|point)_"
DISGUISE = re.compile(
    rf"(?P<at>{AT_MARK}|(?<=[a-z0-9])\s+(?:at|arroba)\s+(?!(?:the|an?|this|that)\s)(?=[a-z0-9-]+(?:\s+(?:dot|punto|punkt)\s+|{DOT_MARK})[a-z0-9]))"
    rf"|(?P<dot>{DOT_MARK}|(?<=[a-z0-9])\s+(?:dot|punto|punkt)\s+(?=[a-z0-9]))"
)
#: A cheap test that most texts fail.
HINT = re.compile(r"[\[({<]\s*(?:at|arroba|arobase|@|dot|punto|punkt|point|\.)\s*[\])}>]|_(?:at|arroba|arobase|dot|punto|punkt|point)_|\s(?:dot|punto|punkt|point|arroba|arobase)\s|\sat\s+[a-z0-9-]+\.[a-z0-9]")

# Addresses whose mark is told from prose by what stands around it.
AT = re.compile(rf"(?P<sure>{AT_MARK}|(?<=[a-z0-9])\s+(?:arroba|arobase)\s+)|(?P<bare>(?<=[a-z0-9])\s+at\s+)|@")
LABEL = re.compile(r"[a-z0-9-]+")
DOT = re.compile(rf"(?P<point>\s+point\s+)|(?P<word>{DOT_MARK}|\s+(?:dot|punto|punkt)\s+)|\.")
#: Ends of domains that tell an address from "at some point in".
ENDS = frozenset("com org net edu gov info biz io dev app eu fr de es it uk us ca ch be nl lu pt pl se dk no fi ie mx ar br co cl pe jp cn ru au nz xyz".split())
#: Words that are no name before " at " or no domain after it, and words that announce an address.
NO_NAME = frozenset("me us you him her them it is are was were be look looks looking shop page site online now here there and or available visit found live work works working stay out up down in on to".split())
NO_DOMAIN = frozenset("the a an this that some which what one any every each no".split())
CUE = re.compile(r"emails?|mails?|write|contact|reach|address|adresse|courriel|correo|escrib\w*|schreib\w*|[ée]cri\w*")
#: Words that may stand between an announcing word and a name, whatever separates them.
CUE_WORDS = 2
#: A character written as an entity; only letters, digits and the signs of identifiers are taken.
ENTITY = re.compile(r"&(?:#0*([0-9]{2,3})|#x0*([0-9a-f]{2})|(commat|period|plus|lowbar|hyphen|dash))(?:;|(?![0-9a-z]))")
ENTITY_NAMES = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-", "dash": "-"}
SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789@.+_-()")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches; each "@" is met once, and the name before it is read backwards."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", max(at + 1, low))


def ips(text: str):
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            yield m.span()


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            yield m.span()


FINDERS = (("email", emails), ("ip", ips), ("card", cards), ("phone", phones))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), in that order."""
    return sorted((start, k, end) for k, (_, find) in enumerate(FINDERS) for start, end in find(text))


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@cache
def plain_form(c: str) -> str | None:
    """What a character stands for in an identifier; None if it stands for itself.

    Besides the tables these are decimal digits of any script and compatibility forms of letters, digits and signs,
    such as full-width, mathematical and circled ones; raised and lowered ones and fractions stand for themselves.
    """
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    if unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>")):
        return None
    form = unicodedata.normalize("NFKC", c).lower()
    return form if form and (form in SIGNS or form.isascii() and form.isalnum()) else None


def odd_edits(low: str) -> list[tuple[int, int, str]]:
    """Characters and entities that stand for others."""
    edits = []
    if not low.isascii() and (odd := "".join(c for c in set(low) if not c.isascii() and plain_form(c) is not None)):
        edits = [(m.start(), m.end(), plain_form(m.group())) for m in re.finditer(f"[{re.escape(odd)}]", low)]
    if "&" in low:
        for m in ENTITY.finditer(low):
            c = ENTITY_NAMES.get(m[3]) or chr(int(m[1]) if m[1] else int(m[2], 16)).lower()
            if c in SIGNS:
                edits.append((m.start(), m.end(), c))
        edits.sort()
    return edits


class Rewritten:
    """A text whose stretches remember where they stood in the source."""

    def __init__(self, text: str):
        self.text, self.at, self.src, self.end = text, [0], [0], [len(text)]

    def source(self, start: int, stop: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, stop - 1) - 1
        a = self.src[i] + (start - self.at[i] if self.copied(i) else 0)
        b = self.src[j] + (stop - self.at[j]) if self.copied(j) else self.end[j]
        return a, b

    def copied(self, i: int) -> bool:
        length = (self.at[i + 1] if i + 1 < len(self.at) else len(self.text)) - self.at[i]
        return self.end[i] - self.src[i] == length and not self.changed[i]

    changed: list[bool] = [False]

    def holds_change(self, start: int, stop: int) -> bool:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, stop - 1) - 1
        return any(self.changed[i : j + 1])

    def replace(self, edits: list[tuple[int, int, str]]) -> "Rewritten":
        """Edits, in order and disjoint, in places of this text; places lead on to the source."""
        if not edits:
            return self
        out = Rewritten("")
        out.at, out.src, out.end, out.changed = [], [], [], []
        parts, size = [], 0

        def add(piece: str, src: int, end: int, changed: bool) -> None:
            nonlocal size
            if piece or changed:
                out.at.append(size)
                out.src.append(src)
                out.end.append(end)
                out.changed.append(changed)
                parts.append(piece)
                size += len(piece)

        def copy(start: int, stop: int) -> None:
            i = bisect_right(self.at, start) - 1
            while start < stop:
                limit = min(stop, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                if limit > start:
                    add(self.text[start:limit], *self.source(start, limit), self.changed[i])
                start, i = max(start, limit), i + 1

        last = 0
        for start, stop, new in edits:
            copy(last, start)
            add(new, *self.source(start, stop), True)
            last = stop
        copy(last, len(self.text))
        out.text = "".join(parts)
        return out


def digit_edits(text: str, runs: list[re.Match], level: int) -> list[tuple[int, int, str]]:
    """Spelled digits as digits. From level 0 on a dot word in a run is ".", and separators up to the level go."""
    edits = []
    for run in runs:
        last = None
        for m in DIGIT_PART.finditer(text, run.start(), run.end()):
            if last is not None and level >= 0:
                between = text[last : m.start()]
                if any(c.isalpha() for c in between):
                    edits.append((last, m.start(), "."))
                elif level >= (2 if "." in between or "\n" in between else 1 if "," in between else 0):
                    edits.append((last, m.start(), ""))
            if m[1]:
                edits.append((m.start(), m.end(), "+"))
            elif m[2] or m[3] in DIGIT_WORDS:
                edits.append((m.start(), m.end(), DIGIT_WORDS.get(m[3], m[3]) * {"double": 2, "triple": 3}.get(m[2], 1)))
            last = None if m[1] else m.end()
    return edits


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def announced(text: str, at: int) -> bool:
    """Whether an announcing word stands before `at`, with CUE_WORDS words between at most."""
    for _ in range(CUE_WORDS + 1):
        end = at
        while end > 0 and not is_word(text[end - 1]):
            end -= 1
        start = end
        while start > 0 and is_word(text[start - 1]):
            start -= 1
        if end == at or start == end:
            return False
        if CUE.fullmatch(text, start, end):
            return True
        at = start
    return False


def named(text: str, at: int) -> bool:
    """Whether what ends at `at` looks like the name of an address before a plain domain."""
    start = at
    while start > 0 and text[start - 1] in LOCAL_CHARS:
        start -= 1
    name = text[start:at]
    return name not in NO_NAME and (bool(re.search(r"[a-z0-9][._%+0-9-]+[a-z0-9]|[a-z][0-9]", name)) or announced(text, start))


def point_in_name(text: str, low: int, at: int) -> tuple[int, int] | None:
    """A spelled point inside the name that ends at `at` and starts at low or later."""
    start = at
    while start > low and text[start - 1] in LOCAL_CHARS:
        start -= 1
    end = start
    while end > low and text[end - 1].isspace():
        end -= 1
    first = end - len("point")
    while first > low and text[first - 1].isspace():
        first -= 1
    spelled_so = text[max(end - 5, 0) : end] == "point" and first < end - 5 and first > low and text[first - 1] in LOCAL_CHARS and text[first - 1].isalnum()
    return (first, start) if start < at and end < start and spelled_so else None


def address_edits(text: str) -> list[tuple[int, int, str]]:
    """Marks of addresses: the at, and the dots of its domain and name.

    A bare " point " belongs to the domain if a known end or another dot follows, or if it is the first dot after
    a mark that is no prose. A bare " at " before a domain of plain dots needs a name that looks like one.
    """
    edits: list[tuple[int, int, str]] = []
    before = 0
    for m in AT.finditer(text):
        low, before = before, m.end()
        first = label = LABEL.match(text, m.end())
        if not first or edits and m.start() < edits[-1][1]:
            continue
        dots = []
        while dot := DOT.match(text, label.end()):
            following = LABEL.match(text, dot.end())
            if not following or dot["point"] and not (following.group() in ENDS or m["sure"] and not dots or DOT.match(text, following.end())):
                break
            dots.append(dot)
            label = following
        if not dots:
            continue
        points = any(d["point"] for d in dots)
        if m["bare"] and (first.group() in NO_DOMAIN or points and label.group() not in ENDS or not points and not any(d["word"] for d in dots) and not named(text, m.start())):
            continue
        if m["sure"]:
            if p := point_in_name(text, max(low, edits[-1][1] if edits else 0), m.start()):
                edits.append((*p, "."))
        if m.group() != "@":
            edits.append((m.start(), m.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in dots if d.group() != "."]
    return edits


def rewritings(text: str) -> list[Rewritten]:
    """The text without its disguises, once for each way to join its spelled digits that differs; none if it has none."""
    low = lowered(text)
    form = Rewritten(low).replace(odd_edits(low))
    forms, tried, runs = [], [], list(DIGIT_RUN.finditer(form.text))
    for level in JOINS if runs else JOINS[:1]:
        edits = digit_edits(form.text, runs, level)
        if edits in tried:
            continue
        tried.append(edits)
        out = form.replace(edits)
        if HINT.search(out.text):
            out = out.replace(address_edits(out.text))
            out = out.replace([(m.start(), m.end(), "@" if m["at"] else ".") for m in DISGUISE.finditer(out.text)])
        if any(out.changed):
            forms.append(out)
    return forms


def all_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The plain spans and those of disguised identifiers, by start and kind."""
    added: set[tuple[int, int, int]] = set()
    for form in rewritings(text):
        found = []
        for start, k, stop in plain_spans(form.text):
            if form.holds_change(start, stop):
                a, b = form.source(start, stop)
                if not any(k == q and s <= a and b <= e for s, q, e in plain) and not any(k == q and s < b and a < e for s, q, e in added):
                    found.append((a, k, b))
        added.update(found)
    return sorted({*plain, *added})


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def masked(text: str) -> str:
    """The text with a placeholder such as <EMAIL> for each span; overlapping spans share the first's."""
    out, last = [], 0
    for start, k, end in all_spans(text, plain_spans(text)):
        if start >= last:
            out += [text[last:start], f"<{KINDS[k].upper()}>"]
        last = max(last, end)
    return "".join([*out, text[last:]]) if out else text


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each document.

    The counts and the digest are those of the plain spans; spans holds all, n_added those of disguises.
    """

    def run(batches):
        for batch in batches:
            counts, hashes, spans, added = [[] for _ in KINDS], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                plain = plain_spans(text)
                every = all_spans(text, plain)
                for k, column in enumerate(counts):
                    column.append(sum(q == k for _, q, _ in plain))
                hashes.append(hashlib.sha256(shown(plain).encode()).hexdigest())
                spans.append(shown(every))
                added.append(len(every) - len(set(plain)))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with placeholders instead of personal data; a null text stays null, other columns stay."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(masked, na_action="ignore")

    return docs.withColumn(text_column, mask(F.col(text_column)))
