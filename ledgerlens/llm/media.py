"""Media columns: interleaved sequences of text and media references, resolved by digest.

A page's HTML becomes an ordered array of parts. A part is a stretch of text, or a reference to a medium by
the digest of its payload, with its caption. Media lie once each in a store, a Parquet table keyed by
digest; pages hold references only. Resolving joins the references with what is read back from the store
and leaves positions and captions as they were.

Defined cases: null HTML has no parts; a reference without a stored medium stays, with null features; equal
payloads share one medium; a null or empty payload is padded like any other; a caption is that of its
figure's media since the caption before, or of those that follow if there are none, else it is text; without one the
medium's alternative text stands in, which is kept besides; a caption that is never closed ends with its figure, or
with the page, and outside a figure it is text; a tag that is never closed is text.
Repeated rows give repeated results and an empty table an empty one; very long pages are parsed whole, in time
that grows with their length; other columns are not looked at. Pixels are 8-bit grey, 64 a row, in a lossless PNG.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 64
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
PARTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string,alt:string>>"
FEATURES = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 br tr article section blockquote figure figcaption".split())
SILENT = frozenset("script style head title noscript template".split())


def padded(payload: bytes) -> bytes:
    """Zeros appended up to a positive multiple of the row length."""
    return payload.ljust(max(1, -(-len(payload) // WIDTH)) * WIDTH, b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Samples as an 8-bit grey picture, unfiltered rows."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_HEAD + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of a picture that to_png() stored, checksums verified."""
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(lines[:, 1:]).reshape(-1)


def feature(samples: np.ndarray) -> str:
    """Mean and spread in thousandths, and a 64-bit mean hash over 8 bands of rows by 8 of columns."""
    rows = samples.reshape(-1, WIDTH).astype(np.int64)
    columns = rows.reshape(len(rows), 8, WIDTH // 8).sum(axis=2)
    edges = np.arange(9) * len(rows) // 8
    sums = np.concatenate((np.zeros((1, 8), dtype=np.int64), np.cumsum(columns, axis=0)))
    cells = (sums[edges[1:]] - sums[edges[:-1]]).reshape(-1)
    area = np.repeat(edges[1:] - edges[:-1], 8) * (WIDTH // 8)
    total, count, square = int(rows.sum()), rows.size, int((rows * rows).sum())
    bits = cells * count > area * total
    spread = (square * count - total * total) * 1_000_000 // (count * count)
    return f"mean={total * 1000 // count};var={spread};hash={int(''.join('1' if b else '0' for b in bits), 2):016x}"


class Parts(HTMLParser):
    """Text and media references in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.silent, self.bare, self.caption = 0, [], None
        self.inside, self.pending, self.pending_used = False, "", False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.parts.append({"position": len(self.parts), "kind": "text", "text": text, "ref": None, "caption": None, "alt": None})

    def end_caption(self) -> None:
        """Give the open caption to the figure's media since the caption before, or to those that follow; outside a figure it is text."""
        said, self.caption = " ".join("".join(self.caption or []).split()), None
        if not self.inside:
            if said:
                self.words.append(said)
                self.flush()
            return
        self.lose_pending()
        if not self.bare:
            self.pending = said
        for part in self.bare if said else ():
            part["caption"] = said
        self.bare = []

    def lose_pending(self) -> None:
        """A caption that no medium followed is text."""
        if self.pending and not self.pending_used:
            self.words.append(self.pending)
            self.flush()
        self.pending, self.pending_used = "", False

    def end_figure(self) -> None:
        if self.caption is not None:
            self.end_caption()
        self.lose_pending()
        self.flush()
        self.inside, self.bare = False, []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.end_figure()
            self.inside = True
        elif tag == "figcaption":
            if self.caption is not None:
                self.end_caption()
            self.caption = []
        elif tag in ("img", "audio", "video", "source") and (src := dict(attrs).get("src")):
            self.flush()
            alt = dict(attrs).get("alt")
            part = {"position": len(self.parts), "kind": "media", "text": None, "ref": src, "caption": self.pending or alt, "alt": alt}
            self.parts.append(part)
            if self.pending:
                self.pending_used = True
            elif self.inside:
                self.bare.append(part)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.words.append(data)


def closed(page: str) -> str:
    """The page with marks that nothing closes written as text, so that no parser looks for their ends again and again."""
    at = page.rfind("-->") + 1
    page = page[:at] + page[at:].replace("<!--", "&lt;!--")
    at = page.rfind(">") + 1
    return page[:at] + page[at:].replace("<", "&lt;")


def parts_of(page: str | None) -> list[dict]:
    parser = Parts()
    parser.feed(closed(page or ""))
    parser.close()
    parser.end_figure()
    return parser.parts


def sequence_digest(parts: list[dict]) -> str:
    """SHA-256 over each part's position, kind, and text or reference, in order."""
    h = hashlib.sha256()
    for part in parts:
        said = f"{part['position']}:{part['kind']}:{part['ref'] if part['kind'] == 'media' else part['text']}"
        h.update(f"{len(said)}:{said}".encode("utf-8", "surrogatepass"))
    return h.hexdigest()


#: Characters of whole lines that stand between two figures of a drawn page, at least.
BLOCK = 8_000


WHOLE = "whole"


def blocks_of(text: str) -> list[str]:
    """Stretches of whole lines, each of BLOCK characters or more but the last."""
    out, lines, size = [], [], 0
    for line in text.split("\n"):
        lines.append(line)
        size += len(line) + 1
        if size > BLOCK:
            out.append("\n".join(lines))
            lines, size = [], 0
    return [*out, "\n".join(lines)] if lines or not out else out


def payloads_of(text: str) -> list[bytes]:
    """The whole text, and the first line of each of its blocks, which many texts may share."""
    return [x.encode("utf-8", "surrogatepass") for x in (text, *(block.partition("\n")[0] for block in blocks_of(text)))]


def figure(payload: bytes, alt: str, caption: str) -> str:
    said = f"<figcaption>{html.escape(caption)}</figcaption>" if caption else ""
    return f'<figure><img src="sha256:{hashlib.sha256(padded(payload)).hexdigest()}" alt="{alt}">{said}</figure>'


def rendered(text: str) -> str:
    """A page of a text's lines: behind each block a figure of its first line, under the words of that, at the end one of the whole text."""
    whole, *payloads = payloads_of(text)
    out = []
    for k, (block, payload) in enumerate(zip(blocks_of(text), payloads, strict=True)):
        out += [f"<p>{html.escape(line)}</p>" for line in block.split("\n")]
        out.append(figure(payload, f"block {k}", block[:40]))
    return f"<article>{''.join(out)}{figure(whole, WHOLE, f'{len(whole)} bytes')}</article>"


#: Rows whose parts are held as Python objects at once.
SLICE = 256
PART_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("alt", pa.string())]))


def interleaved(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, parts): the ordered sequence of each page."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([parts_of(x.as_py()) for x in rows.column(1)], PART_TYPE)], names=[id_column, "parts"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, html_column).mapInArrow(run, f"`{id_column}` {kind}, parts {PARTS}")


def references(sequences: DataFrame, id_column: str = "page_id") -> DataFrame:
    """(id, position, caption, alt, digest): one row for each media reference."""
    part = sequences.select(id_column, F.explode("parts").alias("part")).where("part.kind = 'media'")
    return part.select(id_column, "part.position", "part.caption", "part.alt", F.regexp_replace("part.ref", "^sha256:", "").alias("digest"))


#: Digests that a task remembers to write equal payloads once; beyond them it starts anew and only writes some twice.
REMEMBERED = 500_000


def store(payloads: DataFrame, column: str = "payload", pieces: Callable[[bytes | str | None], list[bytes]] = lambda value: [value or b""]) -> DataFrame:
    """Write each payload as a picture and return the store's reader: (digest, media). pieces gives a row's payloads.

    A task writes equal payloads once; copies in other tasks are equal rows, of which readers take one.
    """

    def encode(batches):
        seen: set[bytes] = set()
        names = ["digest", "media"]
        for batch in batches:
            digests, media, size = [], [], 0
            for payload in (padded(x) for value in batch.column(0) for x in pieces(value.as_py())):
                key = hashlib.sha256(payload)
                if key.digest() in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key.digest())
                digests.append(key.hexdigest())
                media.append(to_png(payload))
                size += len(media[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], names=names)
                    digests, media, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=names)

    return written(payloads.select(column).mapInArrow(encode, "digest string, media binary"), "media")


def read_back(stored: DataFrame) -> DataFrame:
    """Features of each stored medium, from its bytes, one row a digest; dealt by digest, as a join with references needs them."""

    def decode(batches):
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0), batch.column(1), strict=True):
                raw = media.as_py()
                samples = from_png(raw)
                payload = samples.tobytes()
                rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return stored.mapInArrow(decode, FEATURES).dropDuplicates(["digest"])


def resolve(refs: DataFrame, features: DataFrame) -> DataFrame:
    """References with the features of their media; one that resolves to nothing keeps nulls."""
    return refs.join(features, "digest", "left")


def document_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document as a page of its text with figures of lines, and one that holds the whole text's bytes as samples.

    The page is drawn and parsed in one pass. Of its sequence the media parts leave the task, and of the whole the
    number of parts and a digest over their order, kinds, texts and references. All references are resolved; those of the
    whole text give the row's features, and media_sequence_sha256 is a digest over those of position, caption, payload and
    feature of each, in order.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                sizes, media, numbers, digests = [], [], [], []
                for value in rows.column(2):
                    text = value.as_py() or ""
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    parts = parts_of(rendered(text))
                    numbers.append(len(parts))
                    digests.append(sequence_digest(parts))
                    media.append([part for part in parts if part["kind"] == "media"])
                columns = [rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(digests, pa.string()), pa.array(media, PART_TYPE)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_bytes", "n_parts", "sequence_sha256", "parts"])

    features = read_back(store(docs.select(text_column), text_column, lambda text: payloads_of(text or "")))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    sequences = rows.mapInArrow(run, f"row bigint, id {kind}, n_bytes bigint, n_parts bigint, sequence_sha256 string, parts {PARTS}")
    refs = references(sequences.select(F.struct("row", "id", "n_bytes", "n_parts", "sequence_sha256").alias("key"), "parts"), "key").select("key.*", "position", "caption", "alt", "digest")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    said = F.concat_ws(":", "position", F.length(F.coalesce("caption", F.lit(""))), F.coalesce("caption", F.lit("")), "payload_sha256", "feature")
    # what a part adds is shortened, and only the whole text's features are taken along, before rows meet again
    whole = F.when(F.col("alt") == WHOLE, F.struct("id", "n_bytes", *names, "position", "caption", "n_parts", "sequence_sha256"))
    parts = resolve(refs, features).select("row", F.struct("position", F.left(F.sha2(said, 256), F.lit(16)).alias("h")).alias("part"), whole.alias("w"))
    told = F.transform(F.array_sort(F.collect_list("part")), lambda x: x["h"])
    out = parts.groupBy("row").agg(F.max("w").alias("w"), F.count("*").alias("n_media"), F.sha2(F.array_join(told, ","), 256).alias("media_sequence_sha256"))
    return out.select(F.col("w.id").alias(id_column), "w.n_bytes", *[f"w.{c}" for c in names], "w.position", "w.caption", "w.n_parts", "w.sequence_sha256", "n_media", "media_sequence_sha256")
