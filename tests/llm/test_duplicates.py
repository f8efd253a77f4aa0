"""Near-duplicates, repeated paragraphs and repeated strings, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from ledgerlens.llm import neardup, substrings
from ledgerlens.llm.queries import DOCUMENTS, PARAGRAPHS

from .conftest import sentence


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(sets, percent):
    """Least member of each connected component: exact comparison of all that share a shingle."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def check_documents(docs, cfg):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect())
    sets = [shingle_set(t, cfg.shingle) for _, t in rows]
    root = groups(sets, cfg.percent)
    got = neardup.near_duplicates(docs, cfg).collect()
    assert len(got) == docs.count()
    want = {i: (len(s), rows[root[k]][0]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}
    for r in got:
        assert (r.doc_id, r.n_shingles, r.component_id) == (r.doc_id, *want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("name", ["edges", "documents"])
def test_classes_of_documents(name, request):
    check_documents(request.getfixturevalue(name), DOCUMENTS)


def test_buckets_that_are_not_dealt(documents, monkeypatch):
    """Where every node is looked at, all larger buckets take the way of hot ones."""
    monkeypatch.setattr(neardup, "LOOK", 1)
    check_documents(documents, DOCUMENTS)


def test_crowd_around_a_failed_centre(spark):
    """A large family whose members are far from most others: links must not hang on one centre."""
    r = random.Random(11)
    base = sentence(r, 60).split()
    rows = []
    for i in range(150):
        words = list(base)
        for k in r.sample(range(60), 1 + i % 5):
            words[k] = f"v{r.randrange(3)}"
        rows.append((i, " ".join(words)))
    for i in range(150, 190):  # chains: each differs from the one before in one word
        words = rows[-1][1].split() if i > 150 else sentence(r, 60).split()
        words[i % 60] = f"c{i}"
        rows.append((i, " ".join(words)))
    check_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), DOCUMENTS)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_long_lists_of_differences_with_and_without_ansi(spark, ansi):
    """Two failed members of one centre, each far from it in more shingles than its bitmap tells apart."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        cfg = replace(DOCUMENTS, shingle=1)
        stars = [(1, 2, 300, 300, 200, False, list(range(200))), (1, 3, 300, 300, 200, False, list(range(10, 210)))]
        compared = spark.createDataFrame(stars, "a long, b long, na long, nb long, shared long, linked boolean, differences array<bigint>")
        labels = spark.createDataFrame([], "node long, label long")
        assert [tuple(r) for r in neardup.around_centres(compared, labels, cfg).collect()] == [(2, 3)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("common, pairs", [(35, 0), (41, 0), (42, 780)])
def test_crowd_that_shares_the_centre_s_differences(spark, common, pairs):
    """Failed members of one centre share more than half of their differences; a pair is similar from 42 of 58 on."""
    stars = [(0, i, 147, 147, 118, False, [*range(common), *range(1000 * i, 1000 * i + 58 - common)]) for i in range(1, 41)]
    compared = spark.createDataFrame(stars, "a long, b long, na long, nb long, shared long, linked boolean, differences array<bigint>")
    labels = spark.createDataFrame([], "node long, label long")
    assert neardup.around_centres(compared, labels, DOCUMENTS).count() == pairs


def test_empty_table_of_documents(nothing):
    assert neardup.near_duplicates(nothing, DOCUMENTS).collect() == []
    assert neardup.repeated_paragraphs(nothing, PARAGRAPHS).collect() == []


def test_pruning_bounds():
    cfg = replace(DOCUMENTS, miss=1e-7)
    bounds = cfg.least_matches()
    assert bounds == sorted(bounds) and 0 < bounds[-1] < 0.8 * cfg.size
    assert cfg.miss_chance <= 1e-5


def lines_of(text):
    return [x for x in re.findall(r"[^\n]*\n|[^\n]+$", text or "")]


@pytest.mark.parametrize("name", ["edges", "documents"])
def test_repeated_paragraphs(name, request):
    docs = request.getfixturevalue(name).dropDuplicates(["doc_id"])
    cfg = PARAGRAPHS
    places, sets, number = [], [], Counter()
    for i, text in sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        for k, line in enumerate(lines_of(text)):
            number[i] += 1
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= cfg.least_words:
                places.append((i, k))
                sets.append(shingle_set(line, cfg.shingle))
    root = groups(sets, cfg.percent)
    gone = defaultdict(list)
    for k, place in enumerate(places):
        if root[k] != k:
            gone[place[0]].append(place[1])
    got = {r.doc_id: r for r in neardup.repeated_paragraphs(docs, cfg).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert (r.n_paragraphs, r.n_removed, r.removed) == (number[i], len(gone[i]), sorted(gone[i]))


def test_repeated_short_lines(spark):
    """Lines of fewer words than a shingle are compared whole; blank ones are left alone."""
    rows = [(1, "Read more\nalpha\n\nAll rights reserved\nRead more"), (2, "read  MORE\n\none two three four\nalpha beta"), (3, "one two three four\none two three four five\n \nalpha")]
    got = {r.doc_id: r for r in neardup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), PARAGRAPHS).collect()}
    assert {i: (r.n_paragraphs, r.removed, r.kept_in) for i, r in got.items()} == {1: (5, [4], [1]), 2: (4, [0], [1]), 3: (4, [0, 3], [1, 2])}


@pytest.mark.parametrize("percent", [50, 80])
def test_small_sets_are_similar_from_their_least_size_on(spark, percent):
    """Sets of 1 to 6 shingles and the same with one more, at the size where a link first holds."""
    cfg = replace(DOCUMENTS, shingle=1, percent=percent, rows=1, bands=40)
    rows = [(10 * n + k, " ".join(f"w{n}x{i}" for i in range(n + k))) for n in range(1, 7) for k in range(2)]
    check_documents(spark.createDataFrame(rows, "doc_id long, text string"), cfg)


# -- exact strings


def removed(texts, length):
    """texts: bytes; what remains of each, by counting every string."""
    count = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def check_strings(rows, df, **how):
    want = sorted((i, *w) for (i, _), w in zip(rows, removed([(t or "").encode() for _, t in rows], how.get("length", 400)), strict=True))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, **how).collect())
    assert got == want


@pytest.mark.parametrize("name", ["edges", "documents"])
def test_repeated_strings(name, request):
    df = request.getfixturevalue(name)
    check_strings([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df)


@pytest.mark.parametrize("block", [1, 5, 16])
def test_strings_with_overlaps_and_few_letters(spark, block, monkeypatch):
    """Short strings over two letters, periods and copies, cut into blocks of several sizes."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    r = random.Random(3)
    rows = []
    for i in range(60):
        kind = i % 4
        text = "".join(r.choice("ab") for _ in range(r.randrange(0, 150)))
        text = "ab" * r.randrange(60) if kind == 1 else text
        text = text + rows[-1][1][r.randrange(20) :] if kind == 2 and rows else text
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_strings(rows, df, length=24, window=12)


def test_strings_of_null_and_repeated_ids(spark):
    """Rows are told apart by id and text; null ids are documents too."""
    r = random.Random(4)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = part(60)
    rows = [(None, part(40) + shared), (None, shared + part(30)), (1, part(80)), (1, part(20) + shared + part(20)), (2, part(50)), (2, None), (None, None)]
    texts = [(t or "").encode() for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, length=24, window=12).collect())
    assert got == sorted(removed(texts, 24)) and sum(x[1] for x in got) == 180


def test_shared_anchors(spark):
    """A passage too short to be removed shows in n_shared_anchors; other texts have none."""
    r = random.Random(6)
    part = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared = part(390)
    rows = [(1, part(500) + shared + part(300)), (2, part(200) + shared), (3, part(900)), (4, None), (5, "")]
    got = {r.doc_id: (r.n_removed, r.n_shared_anchors > 0) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (0, False), 4: (0, False), 5: (0, False)}


def test_no_strings(nothing):
    assert substrings.remove_repeats(nothing).collect() == []


def test_passages_of_fifty_words_are_seen(spark):
    """Every one of 50 words that two documents share, within longer lines or over several; none that one document repeats, or of 25 words."""
    r, count = random.Random(5), 40
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 5))) + str(r.randrange(10**6))
    prose = lambda n: [word() for _ in range(n)]
    rows = []
    for i in range(count):
        long, short = prose(50), prose(25)
        for k, part in enumerate((long, long, short, short)):
            text = " ".join(prose(r.randrange(60)) + part + prose(r.randrange(60)))
            rows.append((4 * i + k, text.replace(" ", "\n", 3 * (k % 2))))
    own = " ".join(prose(60))
    rows += [(4 * count, f"{own} {' '.join(prose(9))} {own}"), (4 * count + 1, None), (4 * count + 2, "")]
    got = {x.doc_id: x.n_shared_passages for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if n > 0} == {i for i in range(4 * count) if i % 4 < 2}


def test_paragraphs_tell_of_passages_within_them(spark):
    """Fifty words within two longer lines are no repeated line; repeated short lines are no passage."""
    words = lambda a, n: " ".join(f"w{a}x{i}" for i in range(n))
    rows = [(1, f"{words(1, 30)} {words(0, 50)} {words(2, 30)}"), (2, f"{words(3, 40)} {words(0, 50)} {words(4, 40)}"), (3, f"so it is\n{words(5, 60)}"), (4, f"so it is\n{words(6, 60)}"), (5, None)]
    got = {r.doc_id: (r.n_removed, r.n_shared_passages > 0) for r in neardup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), PARAGRAPHS).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (0, False), 4: (1, False), 5: (0, False)}
