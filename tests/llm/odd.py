"""Rows that every operator has to bear: nulls, empty and long texts, repeated rows, names that clash."""

from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over the lazy dog while seven small owls watch from an old oak near the river "
ROWS = [
    (1, PROSE * 3, "en"), (2, PROSE * 3, "en"), (3, PROSE * 2 + "and then it slept", None), (3, PROSE * 2 + "and then it slept", None),
    (4, None, "en"), (5, "", "de"), (6, " \t\n ", None), (7, "12345 !!! 678", "fr"), (None, PROSE, "en"), (None, None, None),
    (8, "wort " * 40_000, "de"), (9, "x" * 300_000, "en"), (10, "é" * 50 + " ñandú İstanbul ß 中文 <|endoftext|> 𝔘", "es"),
    (11, "one two", "en"), (12, "ONE two", "en"), (13, "+1 (255) 555-8013 call a.b@c.example.org, 10.0.0.300 10.0.0.30", "en"),
]
CLASHING = ("size part shard start nth total rank pii sid n u v kind counts block key x y tiles mine other component host wrapper "
            "html term toxic score found want items place _key _spread _nth version n_tokens sign").split()


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def none(spark):
    return documents(spark, [])
