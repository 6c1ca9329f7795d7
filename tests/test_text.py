import random

from pyspark.sql import functions as F

from qrelia.functions.text import (
    bm25_tokenize,
    cast_score,
    corpus_text,
    falsy_to_empty,
    max_tokens,
    normalize_text,
)

SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85"] + [
    chr(c) for c in (0xA0, 0x1680, 0x2000, 0x2003, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]
NOT_SPACES = [chr(0x200B), chr(0xFEFF), chr(0x180E)]


def random_texts(n=200):
    rng = random.Random(7)
    pieces = SPACES + NOT_SPACES + ["a", "Bc", "É", "xyz", "Ω", "1"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_whitespace_rules_match_split(spark):
    texts = random_texts() + ["", " ", "　 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i", normalize_text(F.col("t")).alias("n"), bm25_tokenize(F.col("t")).alias("w")
    ).collect()
    for r in rows:
        assert r["n"] == " ".join(texts[r["i"]].split())
        assert r["w"] == texts[r["i"]].lower().split()


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(normalize_text(F.col("t"))).first()[0] is None


def test_corpus_text(spark):
    df = spark.createDataFrame([("T", "x"), ("", "x"), ("T", ""), ("", ""), (None, "x")], "title string, text string")
    got = df.select(corpus_text(falsy_to_empty(df, "title"), falsy_to_empty(df, "text"))).collect()
    assert [r[0] for r in got] == ["T\nx", "x", "T", "", "x"]
    assert df.select(falsy_to_empty(df, "absent")).first()[0] == ""


def test_score_is_cut_off(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,), (0.0,)], "s double")
    assert [r[0] for r in df.select(cast_score(F.col("s"))).collect()] == [1, -1, 0]


def test_max_tokens(spark):
    df = spark.createDataFrame([("a  b\tc d",), ("a",), ("",)], "t string")
    assert [r[0] for r in df.select(max_tokens(F.col("t"), 3)).collect()] == ["a b c", "a", ""]


def test_zero_and_false_are_empty(spark):
    df = spark.createDataFrame([(0, 0.0, False, "0"), (7, 0.5, True, ""), (None, None, None, None)], "a int, b double, c boolean, d string")
    got = [tuple(r) for r in df.select(*[falsy_to_empty(df, c) for c in df.columns]).collect()]
    assert got == [("", "", "", "0"), ("7", "0.5", "true", ""), ("", "", "", "")]
