import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions import udfs
from pairloom.functions import vectors as V

ODD = ["", " a\tB \n c ", "é\xa0X\x85y\x1cz", "Straße ²①x̂", "日本 語🙂ab", "A" * 10, None]


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_normal_forms(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string")
    for r in df.select("x", T.norm1(F.col("x")).alias("n1"), T.norm2(F.col("x")).alias("n2")).collect():
        if r.x is None:
            assert r.n1 is None
            continue
        assert r.n1 == " ".join(r.x.split()).lower()
        plain = "".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in r.x.lower())
        assert r.n2 == " ".join(plain.split())


def test_grams(spark):
    df = spark.createDataFrame([(x,) for x in ODD if x is not None], "x string")
    for r in df.select("x", *[T.char_grams(F.col("x"), n).alias(f"g{n}") for n in (3, 5)]).collect():
        for n in (3, 5):
            assert sorted(r[f"g{n}"]) == sorted({r.x[i : i + n] for i in range(len(r.x) - n + 1)})
    got = spark.createDataFrame([("a b  C d",)], "x string").select(T.word_grams(F.col("x"), 2, 3).alias("g")).first().g
    assert sorted(got) == ["a b", "a b c", "b c", "b c d", "c d"]


def test_set_measures(spark):
    a, b = (lambda v: F.array(*map(F.lit, v)).cast("array<string>")), None
    df = spark.range(1)
    get = lambda c: df.select(c).first()[0]
    assert get(T.jaccard(a([]), a([]))) == 1.0 and get(T.jaccard(a(["x"]), a([]))) == 0.0 and get(T.jaccard(a(["x", "y"]), a(["y", "z"]))) == pytest.approx(1 / 3)
    assert get(T.containment(a([]), a([]))) == 1.0 and get(T.containment(a(["x"]), a([]))) == 0.0 and get(T.containment(a(["x", "y", "z"]), a(["y"]))) == 1.0
    assert get(T.jaccard(a([]), a([]), 0.0)) == 0.0 and b is None


def test_predicates(spark):
    assert one(spark, T.numeric_razor(F.col("a"), F.col("b")), a="v 1.2 of x", b="v 1.3 of x") is True
    assert one(spark, T.numeric_razor(F.col("a"), F.col("b")), a="v 1.2 of x", b="v 1.3 of y") is False
    assert one(spark, T.numeric_razor(F.col("a"), F.col("b")), a="same 1", b="same 1") is False
    assert one(spark, T.digit_direction(F.col("a"), F.col("b")), a="1 and 2", b="2") == 1
    assert one(spark, T.digit_direction(F.col("a"), F.col("b")), a="1", b="1 2") == -1
    assert one(spark, T.digit_direction(F.col("a"), F.col("b")), a="none", b="1 2") == 0
    assert one(spark, T.script(F.col("a")), a="123") == "none" and one(spark, T.script(F.col("a")), a="привет") == "ru" and one(spark, T.script(F.col("a")), a="при abc") == "mixed"
    assert one(spark, T.lost_digit_runs(F.col("a"), F.col("b")), a="12 and 34", b="34") == ["12"]
    assert one(spark, T.token_count(F.col("a")), a="two words, done!") == 5
    assert one(spark, T.corridor(F.col("a"), F.col("b"), F.col("c")), a="x" * 100, b="title", c="y" * 400) == "length"
    assert one(spark, T.swap_case(F.col("a")), a="aBc1") == "AbC1"
    assert one(spark, T.skeleton(F.col("a")), a="a1 ж!") == "<mixed len=5 shape=wd.w.>"
    assert one(spark, T.plain_marks(F.col("a")), a="“x”—y…«z»‐ ") == '"x"-y..."z"- '


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(V.dot(F.col("a"), F.col("b")), V.norm(F.col("a")), V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.unit_gate(F.col("a"), 2), V.unit_gate(F.col("a"), 3), V.pair_block(F.col("a"), F.col("b"))).first()
    assert r[0] == 24 and r[1] == 5 and r[2] == pytest.approx(0.96) and r[3] == 1.0 and r[4] == "bad-vector-norm" and r[5] == "bad-vector-size" and list(r[6]) == [3, 4, 4, 3, 1, 1, 12, 12]


def test_udfs(spark):
    assert one(spark, udfs.nfc(F.col("a")), a="é") == unicodedata.normalize("NFC", "é")
    assert one(spark, udfs.edit_mass(F.col("a"), F.col("b")), a="abcdef", b="abXXef") == 2
    hulls = one(spark, udfs.edit_hulls(F.col("a"), F.col("b")), a="one two three four", b="one 2 three 4")
    assert len(hulls) == 1 and hulls[0].a_start == 4
    assert one(spark, udfs.canonical_json(F.struct(F.lit("ж").alias("b"), F.lit(None).cast("string").alias("a"), F.lit(1e-7).alias("c")))) == '{"a":null,"b":"ж","c":1e-07}'
    assert one(spark, udfs.digit_cipher(F.col("a")), a="v10.5") == "v07.0"
    text = "one two\n\nthree four\nfive six\n\nseven"
    assert one(spark, udfs.cut_by_units(F.col("a"), F.lit(4)), a=text) == "one two\n\nthree four"
    assert re.fullmatch("[0-9a-f]{64}", one(spark, udfs.blake2b_256(F.col("a")), a="x"))
