"""Documents are cut up once: what Spark makes of the jobs over chunks, and lines with every kind of line end."""

import re

from pyspark.sql import functions as F

from quotelens.functions.text import LINE_END, lines
from quotelens.operators.chunking import chunk_lines, pack_blocks


def files(spark, n=40, size=60):
    docs = spark.range(n).select((F.col("id") - F.col("id") % 4).alias("request_id"), F.concat(F.col("id").cast("string"), F.lit(".md")).alias("path"), (F.col("id") % 4).cast("int").alias("ord"), F.repeat(F.lit("some words in a line\n"), size).alias("content"))
    return docs.withColumn("lines", lines(F.col("content")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_cut_up_once(spark):
    text = plan(chunk_lines(files(spark), 200))
    assert text.count("ArrowEvalPython") == 1
    assert not re.search(r"Filter .*slice\(", text)


def test_keys_and_costs_are_taken_once(spark):
    packed = pack_blocks(chunk_lines(files(spark), 200), 200).select("request_id", "ord", "part", "block_no")
    assert plan(packed).split("Initial Plan")[0].count("ArrowEvalPython") == 1
    assert packed.count() > 40


def test_lines_of_every_kind(spark):
    texts = [f"{a}{x}{b}{y}{c}" for x in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029" for y in ("", "\n", "\r", "\r\n", "\r\r\n", "\n\r", "\u2028", "\x85\r\n") for a in ("", "é") for b in ("", "b‧") for c in ("", " c")]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lines(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: re.split(LINE_END, re.sub(f"(?:{LINE_END})\\Z", "", t)) for i, t in enumerate(texts)}
