"""The pipeline's stages one by one against what the operators say, and the whole run over odd rows."""

import collections
import random
import re

import corpus_pipeline
from quotelens.llm import language, packing, quality, suffixdedup
from quotelens.llm.frames import table


def one_of_each_group(rows):
    """By plain sets and plain reachability: of each group the row with the smallest id, null last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return [rows[k] for k in range(len(rows)) if group[k] == k]


def test_near_dedup_loses_no_row_that_only_shares_an_id(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    a, b, c = prose(), prose(), prose()
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(1, a), (1, b), (1, b), (2, near), (None, c), (None, near), (None, None), (3, c), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (3, c), (None, None), (4, ""), (5, "")], key=str)


def test_stages(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = table(spark, str(tmp_path), "documents")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        seen[name] = (now, spark.read.parquet(f"{tmp_path}/{k}"))
        now = seen[name][1]
        if k < 4:
            assert now.columns == docs.columns
    text = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())

    before, after = seen["language_id"]
    und = {r["doc_id"] for r in language.identify(before).where("lang_pred = 'und'").collect()}
    assert {200, 201, 202, 203} <= und
    assert text(after) == collections.Counter({k: n for k, n in text(before).items() if k[1] and any(c.isalpha() for c in k[1])})

    before, after = seen["quality_rules"]
    kept = collections.Counter(r["doc_id"] for r in quality.judge(before, table(spark, str(tmp_path), "labels")).where("kept").collect())
    assert collections.Counter(r["doc_id"] for r in after.collect()) == kept

    before, after = seen["near_dedup"]
    assert text(after) == collections.Counter(one_of_each_group(text(before)))
    assert any(k[0] is None for k in text(after))

    before, after = seen["suffix_dedup"]
    left = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in suffixdedup.remove(before).collect()}
    assert {(r["doc_id"], r["text"]) for r in after.collect()} == {(r["doc_id"], t) for r in suffixdedup.remove(before).collect() if (t := bytes(r["kept"]).decode("utf-8", "ignore")).strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    assert sum(len(t) for t in left.values()) < sum(len(t) for _, t in text(before))

    before, after = seen["best_fit_packing"]
    assert sorted(r["length"] for r in after.collect()) == sorted(r["length"] for r in packing.pack(before).collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == after.columns and whole.count() == after.count()


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
