from pyspark.sql import functions as F

from vitrine.llm import term_frequency as tf

SCHEMA = "id long, words array<struct<word:string,n:int>>, tags array<string>, term string"


def counts(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return tf.term_counts(df, {"words": (F.col("words.word"), F.col("words.n")), "tags": (F.col("tags"), None)})


def test_counts_and_marks(spark):
    rows = [(1, [("A ", 2), ("a", 3), (None, 9), (" ", 1), ("b", None)], ["X  y", "x y"], "t"), (2, None, ["x y", None], "t"), (3, [], None, "t"), (3, [("A", 1)], [], "t")]
    got = {(r["field_name"], r["term"]): (r["n_uses"], r["n_records"]) for r in counts(spark, rows).collect()}
    assert got == {("words", "a"): (6, 2), ("words", "b"): (0, 1), ("tags", "x y"): (3, 2)}
    total = spark.createDataFrame([(4,)], "n long")
    marks = {(r["term"]): r["mark"] for r in tf.marked(counts(spark, rows), total, 1, 0.25).collect()}
    assert marks == {"a": "common", "b": "rare", "x y": "common"}


def test_long_list_and_empty(spark):
    rows = [(1, None, [f"t{i % 5000}" for i in range(50_000)], None)]
    assert {(r["n_uses"], r["n_records"]) for r in counts(spark, rows).collect()} == {(10, 1)}
    assert counts(spark, []).count() == 0
