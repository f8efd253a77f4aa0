"""Operators on single texts: sketches, PII, language, BPE and media, against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, fingerprint, langid, media, pii
from ledgerlens.llm.queries import vocabulary_path


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["edges", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


# -- sketches


def test_sketches_of_texts_and_edits(docs):
    got = fingerprint.fingerprints(docs).collect()
    order = sorted(rows_of(docs), key=lambda x: -x[0])
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in order)
    if len({i for i, _ in order}) < len(order):  # repeated rows follow each other: a copy's next text may be its own
        assert len({(r.doc_id, r.n_chars, r.fingerprint) for r in got}) == len({i for i, _ in order})
        order = [x for k, x in enumerate(order) if k == 0 or order[k - 1][0] != x[0]]
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert all(r.n_chars == len(text) for r in by_id[i])
        assert sha(edited) in {r.edited_sha256 for r in by_id[i]}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


@pytest.mark.parametrize("ids", [[1, 2, 3, None], [None], [None, None, None], [5], [7] * 40, [None] * 30 + [1] * 30 + [2], [3, 3, None, None, 9], [(1 << 63) - 1, -(1 << 63), 0, None], [*range(40), None]])
def test_next_texts_with_few_repeated_or_absent_ids(spark, ids):
    """Descending ids, rows of one id by their texts' hashes, null ids last, and the first again after the last."""
    texts = [f"{k} " + "abc def " * (k % 5) for k in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(3)
    rows = [(r.doc_id, r.text) for r in sorted(df.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    want = Counter()
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 3
        want[i, sha(text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut])] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprints(df).collect()) == want


def test_equal_texts_have_equal_sketches_and_likeness_follows_jaccard(documents):
    got = {r.doc_id: r for r in fingerprint.fingerprints(documents).collect()}
    prints = {}
    for i, text in rows_of(documents):
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    order = sorted(rows_of(documents), key=lambda x: -x[0])

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    off = []
    for k, (i, text) in enumerate(order):
        edited = text[: len(text) - len(text) // 3] + order[(k + 1) % len(order)][1][: len(text) // 3]
        a, b = shingles(text), shingles(edited)
        if len(a) > 400:
            off.append(abs(len(a & b) / len(a | b) - got[i].near_edited))
    assert np.mean(off) < 0.05


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h", "f g h i j k l m")], "x string, y string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "x", "sx", scale=1), "y", "sy", scale=1)
    row = df.select(F.size(fingerprint.merged("sx", "sy", 1)).alias("n"), F.size("sx").alias("a"), F.size("sy").alias("b"), fingerprint.containment("sx", "sx").alias("c")).first()
    assert (row.n, row.c) == (row.a + row.b, 1.0)


@pytest.mark.parametrize("scale", [1, 4, 16])
def test_merged_sketches_equal_the_union_s(spark, scale):
    """Texts of 0 to 60 words: the sketch of all shingles of both, by members and stand-ins."""
    r = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 1000, n))
    rows = [(text(a), text(b)) for a in (0, 3, 5, 12, 60) for b in (0, 1, 5, 30, 60)]
    df = spark.createDataFrame(rows, "x string, y string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "x", "sx", scale), "y", "sy", scale)
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "x", "ax", 1), "y", "ay", 1)
    got = df.select("ax", "ay", fingerprint.merged("sx", "sy", scale).alias("m"), fingerprint.likeness("sx", "sy", scale).alias("l")).collect()
    limit = min(-(1 << 63) + (1 << 64) // scale, (1 << 63) - 1)

    def sketch(hashes):
        return sorted(h for h in hashes if h <= limit) or sorted(hashes)[:1]

    for row in got:
        both = sketch({*row.ax, *row.ay})
        assert row.m == both
        common = {*sketch(row.ax)} & {*sketch(row.ay)}
        assert 0 <= row.l <= 1 and (row.l > 0) == (bool(common) or not (row.ax or row.ay))


def test_sketches_of_an_empty_table_and_of_many_slices(spark, nothing, documents):
    assert fingerprint.fingerprints(nothing).collect() == []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    few = {r.doc_id: r.asDict() for r in fingerprint.fingerprints(documents).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert {r.doc_id: r.asDict() for r in fingerprint.fingerprints(documents).collect()} == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# -- personal data


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return sum(s[::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    numbers = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out += [(m.start(), 2, m.end()) for m, d in numbers if 12 <= len(d) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(docs):
    texts = dict(rows_of(docs))
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(listed(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == q for _, k, _ in want) for q in range(4)]
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write jane (at) example (dot) com now", "email", "jane (at) example (dot) com"),
        ("write jane at example dot com now", "email", "jane at example dot com"),
        ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("mail ｊane＠example．com!", "email", "ｊane＠example．com"),
        ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
        ("at 10[.]0[.]0[.]3 it is", "ip", "10[.]0[.]0[.]3"),
        ("ruf ４１１１ １１１１ １１１１ １１１１ an", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguised_spans_lie_on_the_source(text, kind, found):
    spans = pii.all_spans(text, pii.plain_spans(text))
    assert (kind, found) in {(pii.KINDS[k], text[a:b]) for a, k, b in spans}


CARD_WORDS = ["four"] + ["one"] * 15


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        (f"card {', '.join(CARD_WORDS)} ok", "card", ", ".join(CARD_WORDS)),
        (f"card {'  '.join(CARD_WORDS)} ok", "card", "  ".join(CARD_WORDS)),
        ("card four\n" + "\n".join(CARD_WORDS[1:]), "card", "\n".join(CARD_WORDS)),
        ("call plus four nine, three zero, one two three, four five six now", "phone", "plus four nine, three zero, one two three, four five six"),
        (f"cards {' '.join(CARD_WORDS)}, {' '.join(CARD_WORDS)}.", "card", " ".join(CARD_WORDS)),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("hôte un neuf deux point un six huit point un point un ici", "ip", "un neuf deux point un six huit point un point un"),
        ("écrire à jean arobase exemple point fr merci", "email", "jean arobase exemple point fr"),
        ("jean (arobase) exemple point co point uk, merci", "email", "jean (arobase) exemple point co point uk"),
        ("jean point petit arobase exemple point fr", "email", "jean point petit arobase exemple point fr"),
        ("write jane at mail.example dot com now", "email", "jane at mail.example dot com"),
        ("write jane at example dot co dot uk now", "email", "jane at example dot co dot uk"),
        ("mail jane at example.com now", "email", "jane at example.com"),
        ("jane.doe at example.com", "email", "jane.doe at example.com"),
    ],
)
def test_separators_and_marks_of_disguises(text, kind, found):
    spans = pii.all_spans(text, pii.plain_spans(text))
    assert (kind, found) in {(pii.KINDS[k], text[a:b]) for a, k, b in spans}


@pytest.mark.parametrize("text", ["they look at example.com often", "write to us at example.com", "it stopped at some point in time", "see you at noon.then go", "at that point com fell", "one, two. three\nfour", "le point de vue at home"])
def test_prose_around_marks_stays(text):
    assert pii.all_spans(text, pii.plain_spans(text)) == []


def test_plain_address_before_the_word_point():
    text = "ask a@b.org point taken"
    assert pii.all_spans(text, pii.plain_spans(text)) == pii.plain_spans(text)


@pytest.mark.parametrize("text", ["meet at noon dot", "three or four five people", "look at the dot com boom of one two three", "nothing here", "", "one two three four five six seven eight nine words"])
def test_clean_texts_stay(text):
    assert pii.all_spans(text, pii.plain_spans(text)) == []
    assert pii.masked(text) == text


@pytest.mark.parametrize("text", [" " * 1_000_000 + "(at)", "a (at) b" + " " * 1_000_000 + "(dot)", "(" * 200_000 + " at )", "x at" + "\n" * 500_000 + "y dot z", "one" + ", " * 300_000 + "two", "one " * 200_000, "+1" + " " * 500_000])
def test_time_grows_with_length_only(text):
    """A million blanks or marks; a quadratic pattern would take hours."""
    began = time.perf_counter()
    pii.all_spans(text, pii.plain_spans(text))
    assert time.perf_counter() - began < 20


def disguised(r):
    """(text, kind, start, end): an identifier in one of many disguises between clean words."""
    words = lambda n: " ".join(r.choice("river stone of the candle and window paper lantern field".split()) for _ in range(n))
    spelled = {str(i): w for i, w in enumerate("zero one two three four five six seven eight nine".split())}
    name, host, end = r.choice(["jane", "max.muster", "o_k"]), r.choice(["example", "mail-box", "foo"]), r.choice(["com", "org", "de"])
    mark, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("_at_", "_dot_"), (" {at} ", "."), (" arroba ", " punto "), (" arobase ", " point ")])
    number = "49" + "".join(r.choice("0123456789") for _ in range(10))
    ip = [str(r.randrange(256)) for _ in range(4)]
    wide = str.maketrans("0123456789+.", "０１２３４５６７８９＋．")
    kind, form = r.choice([
        ("email", name + mark + host + dot + end), ("email", name.replace("a", "а").replace("o", "о") + "@" + host + "." + end),
        ("phone", "plus " + " ".join(spelled[d] for d in number)), ("phone", f"+{number}".translate(wide)),
        ("ip", " dot ".join(" ".join(spelled[d] for d in part) for part in ip)), ("ip", ".".join(ip).translate(wide)),
    ])
    if "а" not in form and "о" not in form and form == name + "@" + host + "." + end:
        return disguised(r)
    before = words(r.randrange(1, 9)) + " "
    return before + form + " " + words(5), kind, len(before), len(before) + len(form)


def test_recall_of_generated_disguises():
    """Known identifiers at known places: nearly all are found where they stand, and nothing else is."""
    r, hit, wrong, n = random.Random(8), 0, 0, 600
    for _ in range(n):
        text, kind, start, end = disguised(r)
        found = pii.all_spans(text, pii.plain_spans(text))
        hit += any((pii.KINDS[k], s, e) == (kind, start, end) for s, k, e in found)
        wrong += sum(e <= start or s >= end for s, _, e in found)
    assert hit >= 0.95 * n and wrong == 0


@pytest.mark.parametrize(("text", "want"), [
    ("\U0001d5c3ohn@example.com", "email:0:16,email:1:16"), ("jane&#64;example.com", "email:0:20"), ("jane&commat;example&period;com x", "email:0:30"), ("a&#x40;b&#46;org", "email:0:16"),
    ("jean point " + "x" * 300 + " arobase exemple point fr", "email:0:336"), ("write to " + " " * 90 + "jane at example.com", "email:99:118"), ("e-mail: jane" + " at example.com", "email:8:27"),
    ("mail big old blue jane at example.com", ""), ("①②③ x at y.com", ""), ("call +\U0001d7ce\U0001d7cf 234 567 890 now", "phone:5:20"), ("m² 1.2.3.4", "ip:3:10"), ("x&#200;y&amp;z", ""),
])
def test_forms_of_characters_and_announced_names(text, want):
    assert pii.shown(pii.all_spans(text, pii.plain_spans(text))) == want


@pytest.mark.parametrize("text", ["a_at_b" * 60_000, " at b.com" * 50_000, "mail" + " " * 300_000 + "x at y.com", "a point b (at) c " * 30_000, "&#64;" * 80_000, "x" * 300_000 + " at y.com"])
def test_time_of_marks_grows_with_length_only(text):
    began = time.perf_counter()
    pii.all_spans(text, pii.plain_spans(text))
    assert time.perf_counter() - began < 25


def test_masking(edges, nothing):
    got = {r.doc_id: r.text for r in pii.mask_pii(edges).collect()}
    assert got[0] is None and got[3] == "one"
    assert got[20] == "mail <EMAIL> or a@b, ip 10.0.0.300 <IP>, card <CARD>, phone <PHONE>"
    assert pii.mask_pii(edges).columns == edges.columns
    assert pii.mask_pii(nothing).collect() == [] and pii.find_pii(nothing).collect() == []


# -- language


def test_profiles_hold_out_documents_and_predict_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs.where(~langid.held_out()))).collect()}
    right = total = 0
    for r in docs.collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if got[r.doc_id].held_out and r.lang is not None and len(r.text or "") > 100:
            total += 1
            right += got[r.doc_id].lang_pred == r.lang
    assert total > 100 and right / total > 0.95


def test_ngram_counts():
    text = "Ab  ab-é"
    want = Counter()
    norm = " " + re.sub(r"[^a-zé]+", " ", text.lower()) + " "
    for n in (1, 2, 3):
        for k in range(len(norm) - n + 1):
            g = norm[k : k + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                want[g] += 1
    grams, counts = langid.ngram_counts(text)
    assert sorted(counts.tolist()) == sorted(want.values())


def out_of_place(texts, held, size=langid.PROFILE):
    """Rank-order profiles in plain Python: (language, distance share) of each text."""

    def grams(text):
        norm = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        norm = re.sub(" +", " ", norm)
        found = Counter(norm[k : k + n] for n in (1, 2, 3) for k in range(len(norm) - n + 1))
        return Counter({g: c for g, c in found.items() if g.strip() and not (len(g) == 3 and g[1] == " ")})

    def code(gram):
        return [sum((1 if c == " " else ord(c) + 1) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))]

    def ranked(counter):
        return sorted(counter, key=lambda g: (-counter[g], code(g)))[:size]

    totals = {}
    for i, text, lang in texts:
        if lang is not None and not held(i):
            totals.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in sorted(totals.items())}
    for i, text, _ in texts:
        own = ranked(grams(text))
        apart = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for lang, p in profiles.items()}
        yield i, min(apart, key=lambda x: (apart[x], x)) if own else "und"


def test_predictions_equal_plain_rank_orders(documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.select("doc_id", "text", "lang").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    got = {r.doc_id: r.lang_pred for r in langid.predict(documents, langid.learn(documents.where(~langid.held_out()))).collect()}
    assert got == dict(out_of_place(rows, held))


def test_language_of_odd_texts(edges, nothing):
    got = {r.doc_id: r for r in langid.predict(edges, langid.learn(edges)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(edges, langid.learn(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, langid.learn(edges)).collect() == []


def test_languages_are_learned_from_one_id_that_many_rows_share(spark):
    rows = [(1, "der die und das ist nicht ein", "de")] * 3000 + [(2, "the and of to in is it that", "en")] * 3000 + [(3, "der und das ist", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.learn(docs, per_language=5)).collect()}
    assert got == {1: "de", 2: "en", 3: "de"}


# -- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_decoded_text_equal_the_library(docs, library):
    texts = dict(rows_of(docs))
    got = bpe.encode_decode(docs, vocabulary_path()).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_odd_characters(library):
    model = bpe.WordBpe(vocabulary_path())
    odd = ["a\x1cb\x85c d", "é ẛ̣ ﬁ", "ΑΣ ΑΣ. Σ", "İIı", "it's we'LL 'tis", "x²½", "a b", "<|endoftext|>a<|endoftext|", "​‍", "퟿￿", "aaaaaaaaaaaaaaaa" * 50, "१२३ ٣", "éͅ", "12,345.67", "__init__", "<|ENDOFTEXT|>"]
    for text, ids in zip(odd, model.encode_batch(odd), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_columns(edges, nothing):
    df = bpe.with_token_ids(edges, vocabulary_path())
    assert [c for c in df.columns if c != "token_ids"] == [c for c in edges.columns if c != "token_ids"]
    assert {r.doc_id: r.token_ids for r in df.collect()}[0] == []
    assert bpe.encode_decode(nothing, vocabulary_path()).collect() == []


@pytest.mark.parametrize("length", [250, 257, 700, 5000])
def test_long_words_are_merged_alike(length):
    """Words on both sides of the limit, of few letters and of many, against the library."""
    model, plain = bpe.WordBpe(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    plain.no_truncation()
    plain.no_padding()
    r = random.Random(length)
    for letters in ("a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz", "éaß"):
        text = "".join(r.choice(letters) for _ in range(length)) + " tail"
        assert model.encode_batch([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_time_of_a_word_grows_with_its_length_only():
    r = random.Random(1)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.perf_counter()
    assert len(bpe.WordBpe(vocabulary_path()).encode_batch([word])[0]) > 300_000
    assert time.perf_counter() - began < 60


# -- media


def test_document_media(docs):
    texts = dict(rows_of(docs))
    got = media.document_media(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows_of(docs))
    same = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        stored = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha(stored))
        assert same.setdefault(raw, r.feature) == r.feature
        # the page again, as a plain list: lines without white space alone, a figure behind each block, the whole at the end
        want, at = [], 0
        text = texts[r.doc_id]
        for block in media.blocks_of(text):
            assert text[at : at + len(block)] == block and (len(block) >= media.BLOCK or at + len(block) == len(text))
            at += len(block) + 1
            lines = [" ".join(x.split()) for x in block.replace("\x00", "\ufffd").split("\n")]
            want += [("text", x) for x in lines if x] + [("media", block, " ".join(block[:40].split()))]
        want.append(("media", text, f"{len(raw)} bytes"))
        media_parts = [(k, x) for k, x in enumerate(want) if x[0] == "media"]
        assert (r.n_parts, r.n_media, r.position, r.caption) == (len(want), len(media_parts), len(want) - 1, f"{len(raw)} bytes")
        if "\x00" not in text:
            told = []
            for k, (_, x, caption) in media_parts:
                payload = media.padded((x if k == len(want) - 1 else x.partition("\n")[0]).encode())
                caption = caption or f"block {[p[0] for p in media_parts].index(k)}"
                told.append(sha(f"{k}:{len(caption)}:{caption}:{sha(payload)}:{media.feature(np.frombuffer(payload, dtype=np.uint8))}")[:16])
            assert r.media_sequence_sha256 == sha(",".join(told))


def test_pages_keep_the_order_of_text_and_media(spark):
    page = '<html><title>no</title><p>One &amp; <b>two</b></p><figure><img src="sha256:aa" alt="x"><figcaption>A cap</figcaption></figure>after<script>no</script><img src="b.png" alt="plain"></html>'
    rows = media.interleaved(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()
    parts = {r.page_id: [(p.position, p.kind, p.text or p.ref, p.caption) for p in r.parts] for r in rows}
    assert parts[1] == [(0, "text", "One & two", None), (1, "media", "sha256:aa", "A cap"), (2, "text", "after", None), (3, "media", "b.png", "plain")]
    assert parts[2] == parts[3] == []
    refs = media.references(media.interleaved(spark.createDataFrame([(1, page)], "page_id long, html string")))
    found = media.resolve(refs, spark.createDataFrame([("aa", 64)], "digest string, payload_bytes long")).collect()
    assert {(r.digest, r.payload_bytes, r.caption) for r in found} == {("aa", 64, "A cap"), ("b.png", None, "plain")}


@pytest.mark.parametrize(("page", "want"), [
    ('<figure><img src="a"><figcaption>cap</figure>after', [("a", "cap"), ("after", None)]), ('<figure><figcaption>first</figcaption><img src="a"></figure>', [("a", "first")]),
    ("<figcaption>lost and found", [("lost and found", None)]), ('<img src="a"><figcaption>text</figcaption>b', [("a", None), ("text", None), ("b", None)]),
    ("one <b", [("one <b", None)]), ("a<!-- b", [("a<!-- b", None)]), ("<figure><figcaption>alone</figcaption></figure>end", [("alone", None), ("end", None)]),
    ('<figure><img src="a" alt="x"><figcaption>one</figcaption><img src="b"><figcaption>two</figcaption><img src="c" alt="z"></figure>', [("a", "one"), ("b", "two"), ("c", "z")]),
    ('<figure><figcaption>one</figcaption><img src="a"><img src="b"><figcaption>two</figcaption><img src="c"></figure>', [("a", "one"), ("b", "one"), ("c", "two")]),
    ('<figure><img src="a"><img src="b"><figcaption>both</figcaption><figcaption>lone</figcaption></figure>', [("a", "both"), ("b", "both"), ("lone", None)]),
    ('<figure><img src="a" alt="x"><figcaption> </figcaption></figure>', [("a", "x")]),
])
def test_unclosed_and_odd_marks_lose_nothing(page, want):
    assert [(p["text"] or p["ref"], p["caption"]) for p in media.parts_of(page)] == want


@pytest.mark.parametrize("page", ["<a " * 200_000, "<!-- " * 200_000 + ">", "<p>" * 100_000, "<img src='" * 50_000, "&" * 200_000, "<script>" + "<" * 200_000, "<figure>" + "<img src=a><figcaption>x</figcaption>" * 20_000, "<figure>" + "<img src=a>" * 20_000 + "<figcaption>x</figcaption>" * 20_000])
def test_parsing_time_grows_with_length_only(page):
    began = time.perf_counter()
    media.parts_of(page)
    assert time.perf_counter() - began < 20


def test_pages_through_the_store(spark):
    """References of pages, payloads in a store, captions and positions side by side after the digest join."""
    digest = lambda b: sha(media.padded(b))
    page = f'<p>one</p><figure><img src="sha256:{digest(b"abc")}"><figcaption>A</figcaption></figure>two<img src="sha256:{digest(b"")}" alt="B"><img src="gone.png">'
    features = media.read_back(media.store(spark.createDataFrame([(b"abc",), (b"abc",), (None,)], "payload binary")))
    refs = media.references(media.interleaved(spark.createDataFrame([(7, page), (8, page)], "page_id long, html string")))
    got = {(r.page_id, r.position): (r.caption, r.payload_bytes, r.payload_sha256) for r in media.resolve(refs, features).collect()}
    for i in (7, 8):
        assert [got[i, k] for k in (1, 3, 4)] == [("A", 64, digest(b"abc")), ("B", 64, digest(b"")), (None, None, None)]
    assert len(got) == 6


def test_pages_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = media.interleaved(pages).collect()
    assert len(rows) == pages.count()
    assert all([p.position for p in r.parts] == list(range(len(r.parts))) for r in rows)


def test_pictures():
    payload = bytes(range(256)) * 3
    stored = media.to_png(payload)
    assert media.from_png(stored).tobytes() == payload
    with pytest.raises(ValueError):
        media.from_png(stored[:60] + b"\0" + stored[61:])
