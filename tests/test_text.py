from pyspark.sql import functions as F

from parley.functions import messages as ms
from parley.functions import text as tx


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*cols).first()


def test_tokens_and_content_tokens(spark):
    r = one(spark, "Women's  T-Shirt, 100% Cotton!", tx.tokens(F.col("x")).alias("t"))
    assert r.t == ["women", "s", "t", "shirt", "100", "cotton"]
    r = one(spark, "I want a red shoe", tx.content_tokens(tx.tokens(F.col("x"))).alias("t"))
    assert r.t == ["red", "shoe"]


def test_clean_value(spark):
    r = one(spark, " -; soft \t wool ,. ", tx.clean_value(F.col("x")).alias("v"))
    assert r.v == "soft wool"
    r = one(spark, "a" * 179 + " b", tx.clean_value(F.col("x")).alias("v"))
    assert r.v == "a" * 179


def test_family_order(spark):
    cases = {"under 5 dollars": "budget", "soft cotton in red": "material", "covered": "color", "outfit": "style",
             "network": "use_case", "wide brim": "size", "zipper": "feature"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.f for r in df.select("x", tx.family(F.col("x")).alias("f")).collect()} == cases


def test_coarse_category_splits_before_comparing(spark):
    df = spark.createDataFrame([(["Clothing, Shoes & Jewelry", "Boys", "Clothing", "Pants"],), ([],),
                                (["Clothing", "Shoes"],)], "c array<string>")
    got = [r.x for r in df.select(tx.coarse_category(F.col("c")).alias("x")).collect()]
    assert got == ["Boys Pants", "clothing item", "Shoes"]


def test_message_shapes(spark):
    m = F.col("x")
    r = one(spark, "I'm looking for red shoes. A key requirement is: one. two.",
            ms.recognised(m).alias("known"), ms.override_tail(m).alias("tail"), ms.constraints(m).alias("c"))
    assert r.known and r.tail == "two." and r.c == ["one. two"]
    r = one(spark, "an unchanged replacement", ms.override(m).alias("o"), ms.recognised(m).alias("known"))
    assert r.o and not r.known
    r = one(spark, "For that, what matters is: color: Dark Grey; 100% wool.",
            F.transform(ms.constraints(m), lambda c: ms.value_phrase(c, 22)).alias("p"))
    assert r.p == ["dark grey", "100 wool"]


def test_question_text_is_repeatable(spark):
    cols = [tx.question_text(F.lit("color"), F.lit(True), F.col("x")).alias("a"),
            tx.question_text(F.lit("color"), F.lit(True), F.col("x"), variety=False).alias("b")]
    a, b = one(spark, "s1|2", *cols), one(spark, "s1|2", *cols)
    assert a == b and a.b == "Here's my closest match so far. Any colour you'd prefer?"
