"""BPE encoding and decoding by batched merge rounds in numpy.

The words of many texts are interned, and each new word is split into its initial symbols. All new words
of a batch lie one after another in one flat array of symbol ids. A round looks every adjacent pair up by
binary search over the sorted pair keys of the merge table, takes the lowest rank in each word, and joins
all its occurrences from left to right; words without a known pair drop out. Rounds end when none is left. A word
of more than LONG bytes would take a round for each rank in it; its pairs wait in a heap by rank and place instead, so
its time grows with its length and not with the square.

Defined cases: a null text is the empty text and has no tokens; special tokens that stand in a text are
single tokens; white space separates words and is not kept; any UTF-8 text can be encoded because the
initial symbols are bytes. Rows are independent, so repeated rows give repeated results; an empty table gives
an empty result; a very long text is taken in pieces, which changes no id; columns of other names stay or are
not looked at. Executors get the vocabulary file from the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Characters of text that are tokenised together at most; a longer text is cut at spaces.
CHUNK_CHARS = 1 << 18
#: Rows whose token ids are held and handed on together.
ROWS = 256
#: Interned words after which a worker starts a new table.
MAX_WORDS = 100_000
#: Bytes of a word beyond which its pairs are taken from a heap.
LONG = 256
#: A pair key is left * 2**20 + right.
SHIFT = 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(shown)))
    return [names[b] for b in range(256)]


class Interner(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of all slices, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class WordBpe:
    """Word-level BPE with an end-of-word mark, read from a tokenizer file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*vocab.values(), *self.specials.values()]) + 1, dtype=object)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in side], dtype=np.int64) for side in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        keys = (left << SHIFT) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int64), made
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int64)
        self.split = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        #: Characters of which a text with a special token holds one, a cheap test that most texts fail.
        self.first_of_specials = {s[0] for s in self.specials}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        #: White space is Unicode's White_Space; Python's own \s has four control characters more.
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        #: The same for lower-case ASCII, of which the standard module is faster; only where \s stands in a class.
        plain = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r\x20")
        self.ascii_words = re.compile(plain) if "\\p" not in plain and pattern.count(r"\s") == pattern.count(r"[^\s") else self.words
        self.rank_of: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        self.index = Interner()
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of plain text, and special tokens with their ids."""
        at = 0
        for m in self.split.finditer(text) if self.split and any(c in text for c in self.first_of_specials) else ():
            yield text[at : m.start()], None
            yield m.group(), self.specials[m.group()]
            at = m.end()
        yield text[at:], None

    def text_words(self, text: str) -> list[str]:
        """Normalised words; a special token is given as itself behind a mark that no word holds."""
        found: list[str] = []
        for piece, special in self.pieces(text):
            if special is not None:
                found.append(f" {special}")
            elif piece.isascii():
                found += self.ascii_words.findall(piece.lower())
            else:
                # lower case goes character by character, without the final form of sigma
                found += self.words.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return found

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol ids of all words in one flat array, and each word's number of symbols."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        if long := np.flatnonzero(lengths > LONG).tolist():
            for i in long:
                merged = self.merged_by_heap(symbols[ends[i] - lengths[i] : ends[i]])
                done_symbols.append(merged)
                done_owner.append(np.full(len(merged), i))
            short = np.repeat(lengths <= LONG, lengths)
            symbols, owner = symbols[short], owner[short]
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            keys = (symbols[:-1] << SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ranks = np.where(inside & (self.keys[at] == keys), self.ranks[at], len(self.ranks))
            ranks = np.append(ranks, len(self.ranks))
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(ranks, first)
            size = np.diff(np.append(first, len(symbols)))
            active = best < len(self.ranks)
            if not active.all():
                settled = np.repeat(~active, size)
                done_symbols.append(symbols[settled])
                done_owner.append(owner[settled])
                symbols, owner, ranks = symbols[~settled], owner[~settled], ranks[~settled]
                best, size = best[active], size[active]
                if not len(symbols):
                    break
            best = np.repeat(best, size)
            hit = ranks == best
            # a pair of equal symbols can overlap itself: of each run take every other one
            place = np.flatnonzero(hit)
            new_run = np.append(True, np.diff(place) != 1)
            run_start = place[np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))]
            place = place[(place - run_start) % 2 == 0]
            symbols[place] = self.made_by_rank[best[place]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, dtype=np.uint32), lengths
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def merged_by_heap(self, word: np.ndarray) -> np.ndarray:
        """One long word's symbols after all merges: the pair of lowest rank first, of equal ones the leftmost."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        rank_of, made, n = self.rank_of, self.made_by_rank, len(word)
        keys = (word[:-1] << SHIFT) | word[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == keys)
        heap = ((self.ranks[at[known]] << 40) | known).tolist()
        heapify(heap)
        symbol, after, before = word.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def push(i: int) -> None:
            j = after[i]
            if j < n and (rank := rank_of.get((symbol[i] << SHIFT) | symbol[j])) is not None:
                heappush(heap, (rank << 40) | i)

        while heap:
            rank, i = divmod(heappop(heap), 1 << 40)
            j = after[i]
            if symbol[i] < 0 or j >= n or rank_of.get((symbol[i] << SHIFT) | symbol[j]) != rank:
                continue  # one of the two went into another merge
            symbol[i], symbol[j] = int(made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        left = np.array(symbol, dtype=np.int64)
        return left[left >= 0]

    def learn(self) -> None:
        """Encode the words that were interned since the last call."""
        known = len(self.starts)
        if len(self.index) == known:
            return
        fresh = [w for w, _ in zip(reversed(self.index), range(len(self.index) - known), strict=False)][::-1]
        plain = [i for i, w in enumerate(fresh) if w[0] != " "]
        symbols, sizes = self.merge_rounds([fresh[i].encode("utf-8", "surrogatepass") for i in plain])
        lengths = np.ones(len(fresh), dtype=np.int64)
        lengths[plain] = sizes
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), dtype=np.uint32)
        flat[ragged(starts[plain], sizes)] = symbols
        for i, w in enumerate(fresh):
            if w[0] == " ":
                flat[starts[i]] = int(w[1:])
        self.starts = np.append(self.starts, starts + len(self.flat))
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, flat)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > MAX_WORDS:
            self.reset()
        numbers, sizes = [], []
        for text in texts:
            words = self.text_words(text)
            sizes.append(len(words))
            numbers.append(np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words)))
        self.learn()
        number = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        ids = self.flat[ragged(self.starts[number], self.lengths[number])]
        per_text = np.zeros(len(texts), dtype=np.int64)
        np.add.at(per_text, np.repeat(np.arange(len(texts)), sizes), self.lengths[number])
        return np.split(ids, np.cumsum(per_text)[:-1]) if texts else []

    def encode_stream(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, batch by batch; a very long text is taken in pieces between spaces."""
        batch, size = [], 0
        for text in texts:
            if len(text) > CHUNK_CHARS:
                yield from self.encode_batch(batch)
                batch, size = [], 0
                yield np.concatenate([ids for part in long_parts(text) for ids in self.encode_batch([part])])
                continue
            batch.append(text)
            size += len(text)
            if size > CHUNK_CHARS:
                yield from self.encode_batch(batch)
                batch, size = [], 0
        yield from self.encode_batch(batch)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder gives them."""
        return " ".join(self.tokens[ids].tolist())


def long_parts(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = text.find(" ", at + CHUNK_CHARS)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


_loaded: dict[str, WordBpe] = {}


def loaded(name: str) -> WordBpe:
    """One encoder a worker and file; the file came with the session's files."""
    if name not in _loaded:
        _loaded[name] = WordBpe(SparkFiles.get(name))
    return _loaded[name]


def sent(docs: DataFrame, vocabulary: str) -> str:
    """Send the vocabulary file to all executors; its name there."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each document; other columns are ignored."""

    name = sent(docs, vocabulary)

    def run(batches):
        model = loaded(name)
        for batch in batches:
            texts = (t if t is not None else "" for t in (x.as_py() for x in batch.column(1)))
            counts, hashes, decoded = [], [], []
            for ids in model.encode_stream(texts):
                counts.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def with_token_ids(docs: DataFrame, vocabulary: str, text_column: str = "text", to: str = "token_ids") -> DataFrame:
    """docs with an array column of token ids; all other columns stay as they are."""
    docs = docs.drop(to)
    place = docs.columns.index(text_column)
    names = [*docs.columns, to]

    name = sent(docs, vocabulary)

    def run(batches):
        model = loaded(name)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = list(model.encode_stream(t.as_py() or "" for t in part.column(place)))
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(to, ArrayType(IntegerType()))]))
