"""The passage index holds words and runs of three, is made without a shuffle, and finds quotes of any length."""

from pyspark.sql import functions as F

from quotelens.operators import passages
from quotelens.operators.passages import PassageIndex
from quotelens.operators.search import locate_in_corpus

TEXTS = [(i, f"the {'red' if i % 3 else 'blue'} fox {i} saw a dog, and dog {i % 7} ran") for i in range(300)] + [(300, "a"), (301, "dog ran"), (302, ""), (303, None), (304, "…")]


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_added_without_a_shuffle(spark, tmp_path):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).localCheckpoint()
    before = shuffled(spark)
    PassageIndex(spark, str(tmp_path / "i")).add(frame)
    assert shuffled(spark) == before
    words = {i: "".join(c if c.isalnum() else " " for c in (t or "")).split() for i, t in TEXTS}
    want = sum(len(set(w)) + len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) for w in words.values())
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).count() == want
    assert int(spark.conf.get(passages.WRITERS)) == 0


def test_quotes_of_any_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(passages, "STRETCH", 50)
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(["dog", "dog ran", "ran dog", "fox 17", "blue fox", "the red fox 17 saw", "dog 5 ran", "cat", "a", "saw a dog, and dog 5 ran"])), "item_id int, text string")
    asked = asked.withColumn("item_id", F.col("item_id").cast("long"))
    index = PassageIndex(spark, str(tmp_path / "i"))
    index.add(frame)
    got = sorted(map(tuple, index.locate(asked).collect()))
    assert got == sorted(map(tuple, locate_in_corpus(asked, frame).collect()))
    assert {i for i, _, _ in got} == {0, 1, 3, 4, 5, 6, 8, 9}
