"""Reports in parts and the kept index of passages, against what the one-row and one-pass forms give."""

import random

import pytest
from pyspark.sql import functions as F

from quotelens.operators.passages import PassageIndex
from quotelens.operators.report import compose_report, in_parts, report_parts
from quotelens.operators.search import locate_in_corpus, runs


@pytest.mark.parametrize("most", [1, 50, 700, 10**9])
def test_parts_are_the_report(spark, most):
    rng = random.Random(2)
    kept = [(i, rng.randrange(4), k, f"claim {rng.random()}", "q " * rng.randint(1, 9), f"p{rng.randrange(3)}", "línea 1", (rng.randrange(5), rng.randrange(50))) for i in (1, 1, 1, 2) for k in range(60)]
    kept = [(*r[:2], n, *r[3:]) for n, r in enumerate(kept)]
    claims = spark.createDataFrame(kept, "request_id long, block_no int, claim_no long, claim string, quote string, path string, location string, pos struct<ord: int, line: int>").repartition(6)
    requests = spark.createDataFrame([(1,), (2,), (3,)], "request_id long")
    rejections = spark.createDataFrame([(1, "sin_cita", 2), (1, "sin_formato", 1), (3, "cita_ajena", 1)], "request_id long, reason string, n long")
    unread = spark.createDataFrame([(i, k, f"f{k}", "no existe") for i in (2, 3) for k in range(30)], "request_id long, ord int, path string, reason string")
    want = {r["request_id"]: r["report"] for r in compose_report(requests, claims, rejections, unread).collect()}
    got: dict = {}
    for r in sorted(report_parts(requests, claims, rejections, unread, most).collect(), key=lambda r: (r["request_id"], r["section"], r["part"])):
        got.setdefault(r["request_id"], {}).setdefault(r["section"], []).append(r["text"])
        assert len(r["text"]) <= most + 200
    assert {i: "\n\n".join("\n".join(parts) for _, parts in sorted(sections.items())) for i, sections in got.items()} == want


def test_one_key_is_dealt_to_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), "id", F.lit("x" * 50).alias("text"))
    parts = in_parts(rows, "k", ["id"], 5_000).collect()
    assert sum(p["text"].count("\n") + 1 for p in parts) == 20_000 and sorted(p["part"] for p in parts) == list(range(len(parts)))
    assert in_parts(rows.where("false"), "k", ["id"], 10).count() == 0


def test_index_answers_as_a_search_of_everything(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice(["uno", "Dos", "tres,", "«cuatro»", "5", "seis_siete", "ocho"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(90)] + [(90, None), (91, ""), (92, " .. "), (93, "uno"), (94, "uno Dos")]
    quotes = [(k, " ".join(docs[rng.randrange(90)][1].split(" ")[2 : 2 + rng.randint(1, 6)])) for k in range(40)] + [(90, "uno"), (91, "nowhere"), (92, "uno nowhere dos"), (93, None), (94, ""), (95, "..."), (96, "uno dos")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(quotes, "item_id long, text string")
    index = PassageIndex(spark, str(tmp_path / "index"))
    index.add(frame.where("doc_id < 50"))
    assert sorted(map(tuple, index.locate(asked).collect())) == sorted(map(tuple, locate_in_corpus(asked, frame.where("doc_id < 50")).collect()))
    index.add(frame.where("doc_id >= 50"))
    want = sorted(map(tuple, locate_in_corpus(asked, frame).collect()))
    assert sorted(map(tuple, index.locate(asked).collect())) == want and len(want) > 40
    assert index.locate(asked.where("false")).count() == 0


def test_runs_are_hashed_once_a_word(spark):
    """Runs by plain Python: as many as there are distinct ones, of equal words the same hash in the corpus and in a quote; no table of counts beside the postings."""
    texts = [(1, "a b a b a"), (2, "é"), (3, "a b"), (4, ""), (5, "x y z w")]
    frame = spark.createDataFrame(texts, "doc_id long, words string").repartition(3)
    got = runs(frame, "doc_id", [1, 2, 3]).collect()
    want = {(i, k, tuple(w[j : j + k])) for i, t in texts for w in [t.split()] for k in (1, 2, 3) for j in range(len(w) - k + 1)}
    assert len(got) == len(want) == len({tuple(r) for r in got})
    by_size = {(r["doc_id"], r["size"]): {x["run"] for x in got if (x["doc_id"], x["size"]) == (r["doc_id"], r["size"])} for r in got}
    assert by_size[3, 1] == by_size[1, 1] and by_size[3, 2] < by_size[1, 2] and not by_size[5, 2] & by_size[1, 2]
    assert {tuple(r) for r in runs(frame, "doc_id").collect()} == {tuple(r) for r in got if r["size"] == min(3, len(dict(texts)[r["doc_id"]].split()))}


def test_index_keeps_postings_and_texts_alone(spark, tmp_path):
    PassageIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame([(1, "uno dos tres")], "doc_id long, text string"))
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["postings", "texts"]
