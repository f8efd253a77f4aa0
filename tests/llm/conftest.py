import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, node bigint, label string, n int, p double, score double, features string, _key string, _bucket string, _whole int, tokens string, position int, keep string, host string, token_ids string, copies int, doc string"
EXTRA = 17


def sentence(r, words):
    return " ".join(r.choice("amber basin cedar delta ember fjord grove haven inlet jetty knoll lagoon mesa notch oasis pond quay ridge shoal tarn".split()) + str(r.randrange(400)) for _ in range(words))


def edge_rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, scripts of more than one byte."""
    r = random.Random(5)
    base = sentence(r, 120)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(sentence(r, 40) for _ in range(600))
    shared = sentence(r, 90)
    texts = [
        None, "", " \n\t ", "one", "One", "two words", "a b c d", "a b c d", base, " ".join(near), base.upper(), base + " tail", long, long + " more",
        sentence(r, 50) + "\n" + shared, sentence(r, 70) + "\n" + shared, shared + "\n" + shared, "Grüße aus Köln, naïve café Ωμέγα 東京 \U0001f600", "\x00\x01 control", "x" * 5000,
        "mail a.b@c-d.org or a@b, ip 10.0.0.300 10.0.0.3, card 4111 1111 1111 1111, phone +49 30 1234567", "write jane (at) example (dot) com, call plus four nine three zero one two three four five six",
        "<|endoftext|> marks <|startoftext|>", "日本語のテキスト", "ΣΑΣ ΟΔΟΣ İstanbul ǅ ﬁ",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "web", "books")[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8]]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([row + (None,) * EXTRA for row in edge_rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
