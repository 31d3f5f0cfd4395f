"""Numbers in the JVM, the answer stream and the evaluation job, against plain Python."""

import json
import re
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotelens.functions.numbers import numeric_values, values
from quotelens.jobs.evaluation import evaluate
from quotelens.operators import prompts
from quotelens.operators.evaluate import run_matrix
from quotelens.operators.prompts import PROFILES, route_model
from quotelens.sources.files import BINARY, LINE, MISSING
from quotelens.streaming.answers import ARRIVALS, answer_stream, gather, stored
from quotelens.streaming.verification import with_rocksdb

NUMBERS = [
    None, "", "x", "12", "2.500", "1.2", "15,5", "1.234.567,8", "1234.567", "0.500", "12.34.567", "a1b22", "٣ ٤٤", "3/5", "1 / 2 / 3", "1/2/3", "15/09/2026", "39/2015", "1.5/2", "2/1.5", "1/2.", "1/2,", "a/2", "/3/4",
    "1̈2", "treinta y dos", "tres quintos, 7", "un 5", "una y uno", "mil una", "cinco\x0b6", "cien por ciento", "por ciento 8", "mitad", "ümit 4.000", "1.000.00", "9.", ",9", "9..9", "9.,9",
]


def test_numbers_in_the_jvm_are_those_of_the_reader(spark):
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "id int, text string")
    got = {r["id"]: r["v"] for r in df.select("id", numeric_values(F.col("text")).alias("v")).collect()}
    for k, text in enumerate(NUMBERS):
        assert got[k] == (None if text is None else sorted(values(text))), text


def test_only_texts_that_need_it_go_to_python(spark):
    df = spark.createDataFrame([("12 and 2.500 un 7",)], "text string").select(numeric_values(F.col("text")).alias("v"), F.length("text"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().toString()  # it is in the plan, for texts that hold words or slashes
    assert df.first()["v"] == ["12", "2500", "7"]


# -- the answer stream


def at(minutes):
    return datetime.fromtimestamp(1_700_000_000 + 60 * minutes, timezone.utc).replace(tzinfo=None)


def test_state_holds_requests_of_so_long_only(spark, tmp_path):
    """Blocks once, whole requests, expiry of what never becomes complete; rows of state go when they are old."""
    (tmp_path / "in").mkdir()
    arrivals = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("arrived", "5 minutes").withColumn("n_blocks", F.lit(2))
    out, sizes = [], []

    def run(*rows):
        spark.createDataFrame([(r, b, c, at(m)) for r, b, c, m in rows], ARRIVALS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = with_rocksdb(spark, lambda: gather(arrivals, timedelta(minutes=30)).writeStream.foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start())
        stream.awaitTermination()
        sizes.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = sorted(out)
        out.clear()
        return got

    assert run((1, 0, "a", 0), (2, 0, "b", 0), (2, 0, "twice", 0), (3, 0, None, 0), (3, 1, "d", 1)) == [(3, 0, "", True), (3, 1, "d", True)]
    assert run((1, 1, "e", 10), (3, 0, "again", 10)) == [(1, 0, "a", True), (1, 1, "e", True)]
    assert sizes[-1] == 3
    assert run((4, 0, "f", 100), (4, 1, "g", 100)) == [(2, 0, "b", False), (4, 0, "f", True), (4, 1, "g", True)]
    assert run((3, 0, "late", 2), (3, 1, "late", 2)) == []
    run((5, 0, "h", 300), (5, 1, "i", 300))
    assert sizes[-1] == 1  # of four requests only the last one is held


def test_a_batch_done_again_leaves_one_answer(spark, tmp_path):
    text = ["one two three four"]
    chunks = spark.createDataFrame([(i, 0, "a.md", 0, 1, 0, text, False) for i in (1, 2)], "request_id long, block_no int, path string, ord int, part int, first_line int, lines array<string>, is_code boolean")
    requests = spark.createDataFrame([(1, "one two?", "k1", 1), (2, "one two?", "k2", 1)], "request_id long, question string, key string, n_blocks int")
    said = "- one two three\n  > one two three"

    def arrive(*rows):
        spark.createDataFrame([(r, 0, c, at(m)) for r, c, m in rows], ARRIVALS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        answer_stream(spark, f"{tmp_path}/in", chunks, requests, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()

    assert stored(spark, f"{tmp_path}/store").count() == 0
    arrive((1, said, 0), (2, "in no form", 0))
    run()
    for commit in (tmp_path / "log" / "commits").iterdir():
        commit.unlink()
    run()
    assert [r["key"] for r in stored(spark, f"{tmp_path}/store").collect()] == ["k1"]
    arrive((1, said, 500))  # time goes on
    run()
    arrive((1, said, 1000), (2, said, 1000))  # forgotten by the stream; the store knows the first
    run()
    assert sorted(r["key"] for r in stored(spark, f"{tmp_path}/store").collect()) == ["k1", "k2"]
    reports = spark.read.parquet(f"{tmp_path}/out/reports").groupBy("request_id").count().collect()
    assert sorted(map(tuple, reports)) == [(1, 1), (2, 2)]


# -- the evaluation


def test_evaluation_over_several_blocks(spark, tmp_path):
    """Windows so small that files fall into many blocks: every block is asked, reports are those of whole files, each file is read once."""
    files = {f"f{k}.md": "\n".join(f"line {k} number {n} says word{n}" for n in range(40)) for k in range(3)} | {"code.py": "x = 1\n" * 60, "bin.txt": "\0"}
    files |= {"own.log": "uno dos tres"}
    reads = tmp_path / "reads"
    reads.mkdir()

    def own(content):
        import uuid

        (reads / uuid.uuid4().hex).touch()
        return content.decode().splitlines()

    cases = [(f"f{k}.md", f"number {n} says word{n}?", "dato", [f"says word{n}"]) for k in range(3) for n in (0, 17, 39)]
    cases += [("code.py", "what is x?", "sin_respuesta", []), ("bin.txt", "q?", "dato", []), ("gone.txt", "q?", "dato", []), ("f0.md", "w" * 900, "dato", []), ("own.log", "uno dos tres?", "dato", ["dos"])]
    profiles = [("small", "m", "code-m", 300, 100, 100, 0.0), ("big", "m", "code-m", 5000, 100, 100, 0.25)]

    def respond(batch: pd.DataFrame) -> pd.Series:
        def one(user, body, model):
            asked = json.loads(body)
            assert asked["model"] == model and asked["messages"][1]["content"] == user
            words = re.search(r"^Question: (.*?)\??$", user, re.M)[1]
            said = "NO CONSTA" if words not in user.replace(f"Question: {words}?", "") else f"- {words}\n  > {words}"
            return json.dumps({"choices": [{"message": {"content": said}, "finish_reason": "stop"}]})

        return pd.Series([one(*row) for row in zip(batch["user"], batch["body"], batch["model"])])

    content = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()] + [("unused.log", bytearray(b"x"))], "path string, content binary")
    done = evaluate(spark.createDataFrame(cases, "file string, question string, type string, expected array<string>"), content, spark.createDataFrame(profiles, PROFILES), ["end", "start", "end"], respond, {".log": (own, LINE)})
    runs = done.runs.collect()
    assert len(runs) == len(cases) * 2 * 2
    for r in runs:
        if r["file"] == "bin.txt":
            assert r["error"] == f"bin.txt: {BINARY}" and not r["ok"] and r["calls"] == 0
        elif r["file"] == "gone.txt":
            assert r["error"] == f"gone.txt: {MISSING}"
        elif r["question"].startswith("www") and r["model"] == "small":
            assert "leaves no room" in r["error"]
        elif r["file"] == "code.py":
            assert r["error"] is None and r["ok"] and r["report"].startswith("No consta")
        elif r["file"] == "own.log":
            assert r["ok"] and "(own.log:línea 1)" in r["report"]
        elif not r["question"].startswith("www"):
            n = int(re.search(r"number (\d+)", r["question"])[1])
            assert r["ok"] and r["error"] is None and r["report"].endswith(f"({r['file']}:línea {n + 1})"), r
            assert r["report"].count("- ") == 1
            assert (r["calls"] > 5) == (r["model"] == "small")
    assert len(list(reads.iterdir())) == 1  # one file has that reader and is named: it was read once for all runs
    small = [r for r in done.summary.collect() if r["model"] == "small" and r["variant"] == "end"]
    assert {(r["type"], r["hits"], r["runs"], r["errors"]) for r in small} == {("dato", 10, 13, 3), ("sin_respuesta", 1, 1, 0), (None, 11, 14, 3)}
    pages = {r["text"] for r in done.dumps.where("model = 'big'").collect()}
    assert f"### [--] q?\n\ngone.txt: {MISSING}\n" in pages
    assert {r["temperature"] for r in done.prompts.select(F.get_json_object("body", "$.temperature").alias("temperature")).distinct().collect()} == {"0.0", "0.25"}
    assert {r["model"] for r in done.prompts.where("model = 'code-m'").select("model").distinct().collect()} == {"code-m"}


def test_evaluation_moves_texts_three_times(spark):
    """Files in which nothing repeats: what is shuffled stays below five times their bytes, with eight runs of each; it was over forty times."""
    import random

    letters = random.Random(5)
    files = {f"f{k}.txt": "\n".join(" ".join("".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(8)) for _ in range(1500)) for k in range(16)}
    cases = [(p, " ".join(t.split("\n")[3].split()[:4]) + "?", "dato", [t.split()[25]]) for p, t in files.items()]
    profiles = [(f"p{k}", "m", "c", 900_000, 100 + k, 100, 0.0) for k in range(4)]

    def respond(batch: pd.DataFrame) -> pd.Series:
        words = batch["user"].str.extract(r"Question: (.*?)\?\n")[0]
        return words.map(lambda w: json.dumps({"choices": [{"message": {"content": f"- {w}\n  > {w}"}, "finish_reason": "stop"}]}))

    content = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary").cache()
    content.count()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> dict[int, int]:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before, least = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        done = evaluate(spark.createDataFrame(cases, "file string, question string, type string, expected array<string>"), content, spark.createDataFrame(profiles, PROFILES), ["end", "start"], respond)
        assert {(r["ok"], r["calls"]) for r in done.runs.collect()} == {(True, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    size = sum(map(len, files.values()))
    moved = sum(n for k, n in written().items() if k not in before)
    assert size < moved < 5 * size, moved / size


def test_file_blocks_are_those_of_packing(spark):
    """Blocks cut within a file's row equal those that chunks packed by requests of one file give: whole, in parts, lines over the budget, without lines."""
    from quotelens.operators.chunking import build_blocks, chunk_lines, file_blocks, pack_blocks

    texts = [[f"line {n} " + "x" * (n * k % 97) for n in range(3 * k)] for k in range(12)] + [[], ["y" * 2000], ["", "", "a"]]
    rows = [(i * 10 + j, ("d.md", "long/" * 9 + "c.py")[i % 2], 0, lines, budget) for i, lines in enumerate(texts) for j, budget in enumerate((1, 45, 60, 120, 400, 100_000))]
    docs = spark.createDataFrame(rows, "request_id long, path string, ord int, lines array<string>, budget long")
    packed = pack_blocks(chunk_lines(docs).join(docs.select("request_id", "budget"), "request_id"))
    key = ["request_id", "block_no", "is_code"]
    want = {(*r[:3], r["text"]) for r in build_blocks(packed).select(*key, "text").collect()}
    got = file_blocks(docs.drop("ord"))
    assert {(*r[:3], r["text"]) for r in got.select(*key, "text").collect()} == want and len(want) > 200
    places = ["request_id", "block_no", "part", "first_line", "lines"]
    plain = lambda df: sorted((*r[:4], tuple(r["lines"])) for r in df.select(*places).collect())
    assert plain(got.select("request_id", "block_no", F.inline("chunks"))) == plain(packed)


def test_evaluation_refuses_what_it_does_not_know(spark):
    none = spark.createDataFrame([], "file string, question string, type string, expected array<string>")
    for variants in ([], ["sideways"]):
        with pytest.raises(ValueError, match="variant"):
            evaluate(none, none, none, variants, None)
    with pytest.raises(ValueError, match="list"):
        run_matrix(none, spark.range(10_001).withColumnRenamed("id", "model"), spark.createDataFrame([("end",)], "variant string"))


def test_profiles_as_a_table(spark):
    profiles = spark.createDataFrame([("a", "doc", "code", 100, 10, 5, 0.5), ("b", "d2", "c2", 100, 20, 5, 0.0)], PROFILES)
    blocks = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True), (4, "none", True)], "request_id long, profile string, is_code boolean")
    got = route_model(blocks, profiles).select("request_id", "model", "output", "temperature").collect()
    assert sorted(map(tuple, got)) == [(1, "code", 10, 0.5), (2, "doc", 10, 0.5), (3, "c2", 20, 0.0)]
    assert prompts.LAYOUTS.keys() == {"end", "start"}


def test_claims_told_three_times_are_verified_once(spark):
    """The query's plan begins at kept verdicts: no join of claims and chunks is left in it."""
    from quotelens.queries import dedupe_verified

    plan = dedupe_verified(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan
