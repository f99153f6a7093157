from pyspark.sql import functions as F

from hintloom.operators import cases

PAIRS = "array<struct<input:string,output:string>>"


def test_pairs_and_choice(spark):
    df = spark.createDataFrame([(["a", "b"], ["x"], "tests", [("t", "u")], None, [("g", "h")]), (None, ["x"], "split", None, [("p", "q")], [("g", "h")])], f"i array<string>, o array<string>, kind string, tests {PAIRS}, pub {PAIRS}, gen {PAIRS}")
    none = F.lit(None).cast(PAIRS)
    rows = df.select(cases.paired(F.col("i"), F.col("o")).alias("p"), cases.chosen_cases(F.col("kind"), F.col("tests"), F.col("pub"), F.col("gen"), none).alias("c")).collect()
    assert [tuple(x) for x in rows[0].p] == [("a", "x")] and rows[1].p == []
    assert [x.input for x in rows[0].c] == ["t"] and [x.input for x in rows[1].c] == ["p", "g"]


def test_arguments_and_modes(spark):
    df = spark.createDataFrame([("[1]", "file", "f"), ("3", None, "f"), (None, "function", None)], "v string, mode string, fn string")
    first = F.array(F.struct(F.col("v").alias("input"), F.lit("").alias("output")))
    rows = df.select(cases.as_arguments(F.col("v")).alias("a"), cases.wants_function(F.col("mode"), F.col("fn"), first).alias("w")).collect()
    assert [(r.a, r.w) for r in rows] == [("[1]", True), ("[3]", False), ("[]", True)]
    assert spark.range(1).select(cases.seconds(F.lit(2), F.lit(500_000_000)).alias("s")).first().s == 2.5


def test_details(spark):
    df = spark.createDataFrame([("e", None, " "), (None, "", None)], "c string, d string, e string")
    assert [r.x for r in df.select(cases.verdict_detail(F.col("c"), F.col("d"), F.col("e")).alias("x")).collect()] == ["[compile_error]\ne", None]
    s = spark.createDataFrame([("WA", ["AC", "WA", "AC"])], "s string, c array<string>")
    assert s.select(cases.verdict_summary(F.col("s"), F.col("c")).alias("x")).first().x == "verdict: WA; cases: AC=2, WA=1"
    o = cases.ordered_statuses(spark.createDataFrame([("ZZ",), ("WA",), ("AC",), ("AA",)], "s string"), "s").orderBy("place").collect()
    assert [r.s for r in o] == ["AC", "WA", "AA", "ZZ"]
    two = cases.adapt({"a": (s, {"k": F.col("s")}), "b": (df, {"k": F.col("c"), "more": F.col("d")})}).collect()
    assert [(r.origin, r.k, r.more) for r in two] == [("a", "WA", None), ("b", "e", None), ("b", None, "")]
