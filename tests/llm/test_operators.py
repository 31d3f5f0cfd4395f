"""Each operator against a brute-force version, an exact round trip or held-out accuracy, odd rows included."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotelens.llm.bytesets import grams, hashes
from quotelens.llm import html, language, lmscore, neardup, neighbours, packing, pieces, quality, sharding, suffixdedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def clashing(df, *names):
    """df with more columns, called as an operator might call its own."""
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


# 1


def test_packing_places_every_piece_once(docs, corpus):
    got = packing.pack(clashing(docs, "piece", "start", "length", "part", "rank", "n", "sequence_id")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenizer.encode("a <|endoftext|> x", add_special_tokens=False).ids == [64, 220, 50256, 2124]
    want = []
    for doc_id, text, *_ in corpus:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, len(ids)] if len(ids) <= 2048 else [0, *range(first, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    for capacity, n in ((50, 400), (2048, 5000), (7, 1)):
        lengths = np.minimum(capacity, rng.geometric(4 / capacity, n))
        counts = np.bincount(lengths, minlength=capacity + 1)
        rows = packing.plan(counts, capacity)
        used = np.zeros(capacity + 1, int)
        fill = collections.Counter()
        for length, rank, times, sequence, _ in rows.tolist():
            assert rank == used[length]
            used[length] += times
            for s in range(sequence, sequence + times):
                fill[s] += length
        assert (used == counts).all() and max(fill.values()) <= capacity
        assert len(fill) <= math.ceil(lengths.sum() / capacity * 1.01) + 1
    assert len(packing.plan(np.zeros(5, int), 4)) == 0


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


# 2


def brute_repeats(rows):
    """Rows equal in id and text are one document; rows of one id with other texts come in the order of the operator's hash."""
    seen, out = set(), {}
    for doc_id, _, text in rows:
        b = (text or "").encode()
        covered = np.zeros(len(b) + 1, int)
        for p in range(len(b) - suffixdedup.LENGTH + 1):
            w = b[p : p + suffixdedup.LENGTH]
            if w in seen:
                covered[p] += 1
                covered[p + suffixdedup.LENGTH] -= 1
            seen.add(w)
        gone = np.cumsum(covered)[: len(b)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[doc_id, text] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup_equals_brute_force(spark, docs, hot, monkeypatch):
    if hot:  # the split of anchors with many units, also in the tasks' own Python
        monkeypatch.setattr(suffixdedup, "HOT", 1)
        spark.sparkContext.broadcast(None)
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").distinct().collect()
    want = brute_repeats(sorted((tuple(r) for r in keyed), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
    odd = clashing(docs, "doc", "text_hash", "kept", "whole", "n_bytes", "units", "beside")
    got = suffixdedup.remove(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    rest = suffixdedup.cleaned(odd).collect()
    assert set(rest[0].asDict()) == set(odd.columns) and all(r["kept"] == r["whole"] == r["doc"] == "clash" for r in rest)
    ids = collections.Counter(tuple(r) for r in got)
    expected = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        expected[(r["doc_id"], *want[r["doc_id"], r["text"]])] += 1
    assert ids == expected


def test_suffix_dedup_spreads_a_passage_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 20)
    monkeypatch.setattr(suffixdedup, "HOT_HERE", 4, raising=False)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, other = letters(150), letters(130)
    rows = [(i, letters(140) + (passage if i % 3 else other) + letters(140)) for i in range(240)] + [(240 + i, letters(300)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    # What one bucket takes, and what meets under one key, must not grow with the documents that hold the passage.
    blobs = suffixdedup.dealt(keyed, 64).cache()
    assert blobs.groupBy("bucket").agg(F.sum(F.length("anchor") / 8).alias("n")).agg(F.max("n")).first()[0] < 120
    look = suffixdedup.judged(blobs).where("anchor IS NOT NULL").groupBy("doc", "text_hash").agg(F.collect_list(F.struct("anchor", "pos", "n", "hot")).alias("units"))
    found = suffixdedup.fetched(keyed.join(look, ["doc", "text_hash"]).repartition(4)).cache()
    assert found.count() > 240
    assert found.groupBy("key").count().agg(F.max("count")).first()[0] <= 20
    want = brute_repeats([(i, None, t) for i, t in rows])
    got = suffixdedup.remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: want[i, t] for i, t in rows}


def test_suffix_dedup_spreads_a_passage_over_many_blocks(spark, monkeypatch):
    """A passage whose anchor has few differing units in each block, and many in all blocks together."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = letters(150)
    rows = [(i, letters(140) + passage + letters(140)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24).cache()
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    most = lambda blobs: blobs.groupBy("bucket").agg(F.sum(F.length("anchor") / 8).alias("n")).agg(F.max("n")).first()[0]
    assert most(suffixdedup.dealt(keyed, 64)) > 240
    frequent = suffixdedup.frequent_anchors(keyed, 100, 1)
    assert 1 <= len(frequent) < 40 and len(suffixdedup.frequent_anchors(keyed, 1000, 1)) == 0
    assert len(np.intersect1d(suffixdedup.frequent_anchors(keyed, 100, 4), frequent)) >= 1
    assert most(suffixdedup.dealt(keyed, 64, frequent)) < 240
    monkeypatch.setattr(suffixdedup, "FREQUENT", 100)
    monkeypatch.setattr(suffixdedup, "LOOKED", 1)
    want = brute_repeats([(i, None, t) for i, t in rows])
    got = suffixdedup.remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: want[i, t] for i, t in rows}


def test_suffix_classes_equal_brute_force():
    rng = random.Random(1)
    for length in (3, 5, 9):
        for _ in range(25):
            texts = [bytes(rng.choices(b"ab" if length < 9 else b"a", k=rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
            raw = b"".join(t + b"\0" for t in texts)
            flat = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
            flat[np.frombuffer(raw, np.uint8) == 0] = 0
            order, number = suffixdedup.classes(flat, length)
            for i in range(1, len(order)):
                a, b = (raw[p : p + length] for p in order[i - 1 : i + 1])
                assert (a == b and len(a) == length and 0 not in a) == (number[i] == number[i - 1])


def test_lm_learns_in_single_precision(monkeypatch):
    """The chances of a batch's noise, the largest matrix of a step, were worked out in double."""
    kinds, chances = [], lmscore.chances
    monkeypatch.setattr(lmscore, "chances", lambda odds: kinds.append(odds.dtype) or chances(odds))
    rng = np.random.default_rng(0)
    p = lmscore.fresh(np.arange(1, 41))
    squares = {k: np.zeros_like(v) for k, v in p.items()}
    one, two, target = rng.integers(0, 40, (3, 64))
    lmscore.learn(p, squares, np.zeros(40, np.float32), one, two, target, np.ones(64, np.float32), rng.integers(0, 40, 16))
    assert kinds == [np.float32] and all(v.dtype == np.float32 for v in (*p.values(), *squares.values()))
    odds = np.array([-100.0, -2.0, 0.0, 3.0, 100.0], np.float32)
    assert np.allclose(chances(odds.copy()), 1 / (1 + np.exp(-odds.astype(float).clip(-30, 30))), rtol=1e-5)


def test_suffix_classes_from_ranked_strings_on():
    """Lengths on both sides of what sorting has ranked, with few and with all symbols: ranks tell those strings apart, and classes are those of brute force."""
    rng = np.random.default_rng(3)
    for length in (1, 2, 8, 13, 17, 24, 40) * 20:
        symbols = int(rng.choice([1, 2, 3, 256]))
        pool = [rng.integers(1, symbols + 1, int(rng.integers(1, 60))) for _ in range(3)]
        flat = np.concatenate([np.concatenate([pool[rng.integers(3)], pool[rng.integers(3)], [0]]) for _ in range(int(rng.integers(1, 8)))]).astype(np.uint16)
        padded = np.concatenate([flat, np.zeros(40, np.uint16)]).tolist()
        order, begin, ranks = suffixdedup.suffix_order(flat, length, min(suffixdedup.BEGIN, length))
        assert 1 <= begin <= length and len({(tuple(padded[i : i + begin]), int(ranks[i])) for i in range(len(flat))}) == len(set(ranks.tolist()))
        assert [padded[i : i + length] for i in order.tolist()] == sorted(padded[i : i + length] for i in range(len(flat)))
        order, number = suffixdedup.classes(flat, length)
        for i in range(1, len(order)):
            a, b = (padded[p : p + length] for p in order[i - 1 : i + 1].tolist())
            assert (a == b and 0 not in a) == (number[i] == number[i - 1])


def test_suffix_dedup_sends_no_digests_and_keeps_no_dead_shuffles(spark, docs, tmp_path):
    from quotelens.lineage import CLEAR, cut

    blobs = suffixdedup.dealt(docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text"), 4)
    assert "digest" not in blobs.columns
    blocks = lambda: {str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, was = blocks(), spark.conf.get(CLEAR, "false")
    done = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), clear=True)
    assert not blocks() - before and spark.conf.get(CLEAR, "false") == was
    assert done.count() == 7


def test_strings_with_an_end_are_alone_whatever_follows():
    """Texts that come again and again, so that what follows an end ties."""
    rng = random.Random(5)
    for _ in range(400):
        pool = [bytes(rng.choices(b"ab", k=rng.randint(1, 16))) for _ in range(3)]
        raw = b"".join(rng.choice(pool) + b"\0" for _ in range(rng.randint(2, 9)))
        flat = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
        flat[np.frombuffer(raw, np.uint8) == 0] = 0
        length = rng.choice((5, 9, 12))
        order, number = suffixdedup.classes(flat, length)
        for i in range(1, len(order)):
            a, b = (raw[p : p + length] for p in order[i - 1 : i + 1])
            assert (a == b and len(a) == length and 0 not in a) == (number[i] == number[i - 1])


def test_units_cover_every_string_once_in_pieces(monkeypatch):
    x = np.frombuffer(bytes(random.Random(2).choices(b"abcd ", k=5000)), np.uint8)
    off = np.array([0, 30, 30, 2500, 2599, 2699, 5000])
    for bits in (20, 10):
        monkeypatch.setattr(suffixdedup, "_PLACE_BITS", bits)
        monkeypatch.setattr(suffixdedup, "PIECE", 1 << bits)
        u = suffixdedup.units(x, off)
        got = collections.Counter((r, s) for r, p, n in zip(u["row"], u["pos"], u["n"], strict=True) for s in range(p, p + n))
        assert got == {(r, s): 1 for r in range(6) for s in range(off[r + 1] - off[r] - 99)}


def test_suffix_dedup_trusts_no_digest(spark, docs, monkeypatch):
    """Digests that are all alike: only bytes tell units and strings apart."""
    same = lambda u: {**u, "digest": u["digest"] * np.uint64(0) + (u["n"].astype(np.uint64))}
    plain = suffixdedup.units
    monkeypatch.setattr(suffixdedup, "units", lambda flat, off: same(plain(flat, off)))
    rows = docs.where("doc_id < 200").select("doc_id", "text").distinct()
    keyed = rows.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), "text").collect()
    x = [(r["text"] or "").encode() for r in keyed]
    table = pa.table({"doc": [r["doc"] for r in keyed], "text_hash": [r["text_hash"] for r in keyed], "text": [t.decode() for t in x]})
    # The mapper's own function, without Spark, as its Python would not see the change.
    caught = {}
    fake = type("Docs", (), {"mapInArrow": lambda self, run, schema: caught.setdefault("run", run)})()
    suffixdedup.dealt(fake, 8)
    texts = {(r["doc"], r["text_hash"]): t for r, t in zip(keyed, x, strict=True)}
    n_again = 0
    for blob in pa.Table.from_batches(caught["run"](iter(table.to_batches()))).to_pylist():
        again = {k: np.frombuffer(blob[f"again_{k}"], suffixdedup._KINDS[k]) for k in suffixdedup._REPEATS}
        for d, h, p, n in zip(*(again[k].tolist() for k in suffixdedup._REPEATS), strict=True):
            piece = texts[d, h][p : p + n + suffixdedup.LENGTH - 1]
            assert any(piece in t for key, t in texts.items() if key != (d, h)) or texts[d, h].count(piece) > 1
            n_again += 1
    assert n_again > 20


def test_suffix_dedup_of_nothing(empty):
    assert suffixdedup.remove(empty).count() == 0


# 3


def test_base_scores_equal_brute_force_and_model_beats_them(docs, corpus):
    texts = [(i, WORD.findall((t or "").translate(LOWER)) + [0]) for i, t, *_ in corpus]
    c = collections.Counter(w for i, ws in texts if fold(i, 7) not in (None, 2) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, fold(i, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in texts), key=str)
    got = lmscore.op3(clashing(docs, "doc", "text_hash", "learnt", "score", "rows", "held_out")).collect()
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 5)) for r in got), key=str) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    p = lmscore.fresh(rng.integers(0, 50, 1024))
    near, far, sums = lmscore.tables(p)
    for one, two in ((3, 9), (1024, 1024)):
        assert np.exp(near[one] + far[two] - sums[one, two]).sum() == pytest.approx(1, abs=1e-4)


def test_scores_equal_brute_force(spark, corpus):
    """Every token's probability by the definition: a softmax over all outcomes, and for words without an outcome of their own their share of the class."""
    docs = spark.createDataFrame([r for r in corpus if not r[1] or len(r[1]) < 3000], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    learning = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    model = lmscore.vocabulary(learning, 16)
    p = {k: v.astype(float) for k, v in lmscore.trained(learning, model).items()}
    size, named = model["size"], dict(zip(model["hash"].tolist(), model["outcome"].tolist(), strict=True))
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    counts = collections.Counter(w for r in docs.collect() for w in words(r["text"]))

    def outcome(word):
        raw = word.encode()
        own = named.get(int(hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), lower=True)[0]))
        return (raw[-1] * 31 + raw[-2 if len(raw) > 1 else -1] * 7) % lmscore.RARE if own is None or own < lmscore.RARE else own

    members = collections.defaultdict(list)
    for w in counts:
        members[outcome(w)].append(w)
    softmax = {}
    got = lmscore.score(docs).collect()
    want = collections.defaultdict(list)
    for r in docs.collect():
        u = v = size
        total = 0.0
        for w in [*words(r["text"]), None]:
            k = lmscore.END if w is None else outcome(w)
            if (u, v) not in softmax:
                z = (p["C"][0] * p["R"][v] + p["C"][1] * p["R"][u]) @ p["Q"].T + p["b"]
                softmax[u, v] = z - np.log(np.exp(z - z.max()).sum()) - z.max()
            total += softmax[u, v][k] / math.log(10)
            if k < lmscore.RARE:
                total += math.log10((counts[w] + 1) / (sum(counts[x] for x in members[k]) + len(members[k]) + 1))
            u, v = v, k
        want[r["doc_id"]].append(total)
    assert len(got) == docs.count()
    for r in got:
        assert any(r["score"] == pytest.approx(x, rel=2e-3, abs=2e-3) for x in want[r["doc_id"]])


def test_outcomes_grow_with_the_vocabulary():
    sizes = [lmscore.outcome_count(v) for v in (0, 100_000, 400_000, 700_000, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[1] == lmscore.LEAST < sizes[2] < sizes[3] < sizes[4] == lmscore.MOST


def test_scores_of_nothing_and_from_nothing(docs, empty):
    assert lmscore.op3(empty).count() == 0
    untaught = lmscore.score(docs, F.lit(False)).collect()
    assert len(untaught) == docs.count() and {r["train_tokens"] for r in untaught} == {0} and {r["n_known"] for r in untaught} == {0}


# 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"<p>no</p>"</script></head><body><header><h1>Site of the news</h1></header>
<nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site and it is what it is for all of you who come to it.</div>
<article><h1>A &amp; B&#33;</h1><p>The first   paragraph of<br>the <b>text</b> is in the article and it is as long as it has to be for that.</p><aside>Related <a href=y>thing</a></aside>
<p>Sh&eacute;.</p><form>name <input></form><section id="comments"><p>I think that the comment is not in the text of the article and that it has to go.</p></section></article>
<div class="sidebar"><p>The side of the page is not what it is about, as it is in the sidebar and for the reader only.</p></div><footer>&copy; 2024 The Site</footer><!-- <p>c</p> --></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "A & B!\nThe first paragraph of the text is in the article and it is as long as it has to be for that.\nShé."
    body = "The story of the day is that it was in the town and that the people of it came to see what it was, for it had not been there before and it was as large as a house."
    plain = f"<div><a href=a>Home</a> | <a href=b>News</a></div><h2>Head</h2><div>{body}</div><p>Short one.</p><p>{body}</p><div><a href=c>More</a></div>"
    assert html.main_text(plain) == f"Head\n{body}\nShort one.\n{body}"
    for empty in (None, "", "   ", "<p></p>", "<script>x", "<!-- x", "<"):
        assert html.main_text(empty) in ("", "<")
    assert html.main_text("<article><p>a < b and 3 > 2</article>") == "a < b and 3 > 2"
    assert html.main_text("<article><p>cut off <b>here") == "cut off here"
    assert len(html.main_text("<article>" + "<p>word</p>" * 20000).split("\n")) == 20000


BODY = "The story of the day is that it was in the town and that the people of it came to see what it was, for it had not been there before and it was as large as a house."
NAMES = "Berlin Hamburg Munich Cologne Frankfurt Stuttgart Dresden Leipzig Nuremberg Hanover Bremen Essen Dortmund Duisburg Bochum Wuppertal Bielefeld Bonn Mannheim"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><meta y><p>{}</p>", "<html><head><meta x><body><p>{}</p>", '<article class="post tag-politics category-search"><p>{}</p></article>', "<p>{}</p><svg/><p>Fin.</p><p>{}</p>",
        "<p>{}<button>Buy<p>{}</p>", "<p>{}</p><svg><path/><p>{}</p>", '<div class="overflow-hidden" aria-hidden="false"><article><p>{}</p></article></div>', "<form><div><p>{}</p></div></form>",
        "<object><p>{}</p>", "<select><option>a<p>{}</p>", '<div class=sidebar><p>{}</p></div>', '<div id="page" class="with sidebar"><main><p>{}</p></main></div>', "<form><article><p>{}</p></article></form>",
        '<article><p>{}</p><div class="ad"><p>Buy it in the shop of the day for it is as good as it was.</p></div><p>{}</p></article>', "<article><p>{}</p><p hidden>The text that was hidden in the page is not for the reader of it at all.</p></article>",
    ],
)
def test_main_text_is_found_in_ordinary_pages(page):
    text = html.main_text(page.replace("{}", BODY))
    assert [x for x in text.split("\n") if x != "Fin."] == [BODY] * page.count("{}")


def test_copyright_signs_and_unlisted_languages():
    short = f"{BODY[:90]} © of it"
    assert html.main_text(f"<article><p>{short}</p></article>") == short
    russian = "один два три четыре пять шесть семь восемь девять десять " * 5
    assert html.main_text(f"<div><a href=x>раз</a></div><div><p>{russian}</p></div>") == russian.strip()


def test_density_decides_where_nothing_is_declared_and_within_articles(monkeypatch):
    plain = f"<div>{BODY}</div><div>{NAMES}</div><div>{NAMES}</div><div>{BODY}</div>"
    mixed = f"<article><p>{BODY}</p><p>{NAMES} <a href=x>More cities</a></p><p>{BODY}</p></article>"
    assert html.main_text(plain) == html.main_text(mixed) == f"{BODY}\n{BODY}"
    monkeypatch.setattr(html, "STOP_WORDS", frozenset())
    assert NAMES in html.main_text(plain) and NAMES in html.main_text(mixed)


def plain_passes(page):
    """Both passes over the page's blocks as the rules are written: neighbours are looked for one by one."""
    for by_name in (True, False):
        found = [(b, t) for b in html.blocks(page, by_name) if (t := b.text())]
        declared = any(b.article and not b.never for b, _ in found)
        never = [b.never or declared and not b.article for b, _ in found]
        share = lambda t: sum(w in html.STOP_WORDS for w in re.findall(r"[^\W\d_]+", t.lower())) / max(1, len(re.findall(r"[^\W\d_]+", t)))
        known = any(not n and len(t) >= 70 and share(t) >= 0.15 for n, (_, t) in zip(never, found, strict=True))
        labels = []
        for n, (b, t) in zip(never, found, strict=True):
            links = sum(len(x) for x, linked in b.parts if linked) / sum(len(x) for x, _ in b.parts)
            ends = t.rstrip("\"'”’»)]")[-1:] in tuple(".!?:;…。！？؟।")
            if n or links > 0.33:
                labels.append("bad")
            elif b.heading or len(t) < 70:
                labels.append("short" if b.article or not links and "©" not in t else "bad")
            elif (known and share(t) >= 0.30 or not known) and len(t) > 140:
                labels.append("good")
            elif not known or share(t) >= 0.15 or b.article and (not links or b.listed or ends):
                labels.append("near")
            else:
                labels.append("bad")

        def side(k, steps):
            for i in steps:
                inside = found[k][0].article
                if labels[i] in ("good", "bad") and (not inside or found[i][0].article == inside and not never[i]):
                    return labels[i]
            return ""

        out = []
        for k, (b, t) in enumerate(found):
            before, after = side(k, range(k - 1, -1, -1)), side(k, range(k + 1, len(found)))
            around = {before, after} - {""}
            if labels[k] == "good" or labels[k] == "near" and (b.article or around != {"bad"}):
                out.append(t)
            elif labels[k] == "short" and (around != {"bad"} if b.article else around == {"good"} or b.heading and after == "good"):
                out.append(t)
        if out:
            return "\n".join(out)
    return ""


def test_two_passes_equal_brute_force():
    rng = random.Random(19)
    inner = [BODY, BODY[:100], "Short one.", NAMES, f"{NAMES} <a href=x>More</a>", "<a href=a>Home</a> | <a href=b>News</a>", "© 2024", f"{NAMES}.", "Zwei.", f"<a href=c>{BODY}</a>", BODY[:60]]
    seen = set()
    for _ in range(600):
        parts = [f"<{tag}{name}>{rng.choice(inner)}</{tag}>" for _ in range(rng.randint(1, 9)) for tag in [rng.choice("p div h2 li td aside".split())] for name in [rng.choice(["", "", "", ' class="ad"', ' class="tags"', " hidden"])]]
        if rng.random() < 0.6:
            a, b = sorted((rng.randint(0, len(parts)), rng.randint(0, len(parts))))
            parts[a:b] = ["<article>", *parts[a:b], "</article>"]
        page = "".join(parts)
        seen.add(got := html.main_text(page))
        assert got == plain_passes(page), page
    assert len(seen) > 80 and "" in seen


def test_extract_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    rows = clashing(rows, "text", "n_chars")
    got = rows_of(html.extract(rows), "page_id", "n_chars")
    assert [n for _, n in got].count(0) == 2 and len(got) == 4


# 5


def exact(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            near = sorted(((-float((q * v).sum()), j) for j, v in good if j != i and len(v) == len(q)))[:20]
            out[i] = near
    return out


def test_neighbours_find_nearly_all(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + rng.normal(size=16) * 0.4) * rng.uniform(0.5, 2)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a third are one vector
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [1.0, None] * 8), (2100, [1.0] * 3), (2101, [2.0] * 3), (None, [1.0] * 16)]
    want = exact(rows)
    got = collections.defaultdict(list)
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "size", "shard", "block", "score", "rank", "ids")
    for r in sorted(neighbours.search(table).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    assert set(got) == set(want)
    found = total = 0
    values = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and None not in v}
    for q, near in want.items():
        assert len(got[q]) == len(near)
        found += len({j for _, j in near} & {j for j, _ in got[q]})
        total += len(near)
        for j, score in got[q]:
            assert score == pytest.approx(float(values[q] @ values[j]), rel=1e-12)
    assert found / total >= 0.97
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("least", "most", "shards"), [(300, 100_000, 4), (100, 400, 8)])
def test_neighbours_in_several_shards(spark, monkeypatch, least, most, shards):
    """Isotropic vectors, which no shard or centre favours: recall over shards kept to the number of partitions, and beyond it."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", least)
    monkeypatch.setattr(neighbours, "SHARD_MOST", most)
    x = np.random.default_rng(5).normal(size=(3000, 32)).astype(np.float32)
    assert neighbours.shard_count(len(x), 4) == shards
    want = exact([(i, v.astype(float).tolist()) for i, v in enumerate(x)])
    got = collections.defaultdict(set)
    for r in neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({j for _, j in near} & got[q]) for q, near in want.items()) / (20 * len(want)) >= 0.95


def test_long_runs_are_parsed_in_time_in_proportion(monkeypatch):
    """Lanes that never meet: the phrases of passes without end, and a megabyte of one letter in seconds."""
    import time

    import numpy as np

    from quotelens.llm import language

    model = language.fit({"a": (b"aaab abab aaaaaaaaaaaaaaaaaaaab " * 20), "b": b"bcbcbd aabba " * 30})
    tables = [language.walker(*edges, model["classes"], model["width"]) for edges in model["edges"]]
    texts = [b"a" * 20_000, b"ab" * 9_000 + b"zz", b"", b"bc" * 700, b"aaab" * 4_000 + b"q" * 3_000 + b"aaab" * 2_000]
    flat, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language.phrases(model, tables, flat, off)
    monkeypatch.setattr(language, "PASSES", 10**6)
    assert (language.phrases(model, tables, flat, off) == got).all()
    monkeypatch.setattr(language, "PASSES", 0)
    assert (language.phrases(model, tables, flat, off) == got).all()
    monkeypatch.undo()
    began = time.monotonic()
    language.phrases(model, tables, np.full(1_000_000, 97, np.uint8), np.array([0, 1_000_000]))
    assert time.monotonic() - began < 10


def test_nested_pages_take_time_in_proportion():
    """Open containers and end tags without a beginning cost the same each, however deep they are."""
    import time

    from quotelens.llm import html

    began = time.monotonic()
    assert [b.article for b in html.blocks("<article><div class='ad'>" * 20_000 + "x")] == [1]
    assert len(html.blocks("<div>" * 20_000 + "</nav>" * 20_000 + "x")) == 1
    assert time.monotonic() - began < 8


def test_equal_texts_of_many_documents_fall_into_many_buckets():
    """What tells rows of a text apart is dealt by document and text, so empty or equal texts don't gather."""
    import numpy as np

    from quotelens.llm.bytesets import mix

    doc, text = np.arange(1000, dtype=np.int64), np.full(1000, 7, np.int64)
    marks = mix(doc.view(np.uint64) + text.view(np.uint64))
    assert len(np.unique(marks)) == 1000 and np.bincount((marks >> np.uint64(32)).astype(np.int64) % 16, minlength=16).max() < 120


@pytest.mark.parametrize(("n", "low", "high"), [(6000, 0.2, 5.0), (2000, 1e-3, 1e3)])
def test_neighbours_of_vectors_with_differing_norms(spark, n, low, high):
    """The largest inner product favours long vectors: those of all lengths are asked for."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 64))
    x *= (rng.uniform(low, high, n) / np.linalg.norm(x, axis=1))[:, None]
    x = x.astype(np.float32)
    asked = np.arange(0, n, 20)
    scores = x[asked].astype(float) @ x.T.astype(float)
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {int(q): set(row.tolist()) for q, row in zip(asked, np.argsort(-scores, 1)[:, :20])}
    got = collections.defaultdict(set)
    for r in neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(near & got[q]) for q, near in want.items()) / (20 * len(want)) >= 0.97


def test_bands_of_norms(spark):
    rows = [([1.0, 0.0],), ([0.6, 0.8],), ([1e200, 1e200],), ([1e-200, 0.0],), ([5.0, 0.0],), ([0.999999, 0.0],)]
    bands = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(neighbours.band_of(F.col("v"))).collect()]
    assert bands[0] == bands[1] == bands[5] == 0 and bands[3] < 0 < bands[4] < bands[2]


# 6


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                least[q] = p
    return {i: root(i) for i in ids}, sets


def test_near_duplicates_equal_brute_force(docs, corpus):
    want, _ = brute_components([(i, t) for i, t, *_ in corpus if i is not None])
    for r in neardup.link(docs).collect():
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])


def test_near_copies_of_copies_are_linked(spark, empty):
    """A large group whose members are not all near its centre: links must be found between any two."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        words = list(base if rng.random() < 0.6 else rows[rng.randrange(len(rows))][1].split())
        for k in rng.sample(range(len(words)), rng.randint(1, 6)):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = brute_components(rows)
    assert len(set(want.values())) > 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(df).collect()} == {i: (len(sets[i][0]), c) for i, c in want.items()}
    assert neardup.link(empty).count() == 0


# 7


def test_shards_are_contiguous_and_even(docs, corpus, empty):
    got = sharding.shard(docs.withColumn("size", F.lit("clash"))).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in [(-1 if r[0] is None else r[0], *r[1:]) for r in corpus])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda d: (d is not None, d))
    for s in {r["shard"] for r in got}:
        assert [r["slot"] for r in order if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))
    small = [(i, "x" * (i % 7)) for i in range(4000)]
    sizes = collections.Counter()
    for r in sharding.shard(docs.sparkSession.createDataFrame(small, "doc_id long, text string")).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 14
    assert sharding.shard(empty).count() == 0


# 8


def test_languages(docs, corpus, empty):
    got = collections.defaultdict(list)
    for r in language.op8(clashing(docs, "lang_pred", "score", "rank", "before", "n", "held_out")).collect():
        got[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 4) == 2)
    assert sum(len(x) for x in got.values()) == len(corpus)
    for i in (200, 201, 202, 203):
        assert got[i][0]["lang_pred"] == "und"
    held = [(r["lang_pred"], lang) for i, _, lang, *_ in corpus if i is not None and i < 120 and i not in (1, 2) for r in got[i] if r["held_out"]]
    assert len(held) > 10 and sum(a == b for a, b in held) / len(held) > 0.95
    assert language.op8(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(False)).collect()} == {"und"}


def greedy_phrases(text, sample):
    n = k = 0
    while k < len(text):
        size = 1
        while k + size < len(text) and text[k : k + size + 1] in sample:
            size += 1
        n, k = n + 1, k + size
    return n


def test_phrases_are_greedy_longest_matches_of_whole_texts():
    rng = random.Random(3)
    taught = {"x": "".join(rng.choices("abc ", k=300)).encode(), "y": "".join(rng.choices("abd ", k=900)).encode()}
    model = language.fit(taught)
    tables = [language.walker(*e, model["classes"], model["width"]) for e in model["edges"]]
    texts = ["".join(rng.choices("abcd ", k=n)) for n in (0, 1, 17, 256, 257, 900, 512, 1024, 1025, 5000)]
    texts += [(taught["x"] * 9).decode(), taught["y"].decode() * 3, "a" * 3000, "abc" * 700]  # matches across lanes, and lanes that never meet
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    squeezed, cuts = language.folded(flat, off)
    raw = squeezed.tobytes()
    for row, got in enumerate(language.phrases(model, tables, flat, off)):
        for i, sample in enumerate(taught.values()):
            assert int(got[i]) == greedy_phrases(raw[cuts[row] : cuts[row + 1]], re.sub(b" +", b" ", sample))


def test_a_small_sample_does_not_lose_to_a_large_one(spark):
    """Longer samples have longer matches in any language: counts are weighed by the log of the sample."""
    rng = random.Random(13)
    prose = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))
    one, two = "eeeaaarrnnssttiloudm", "eeeaaarrnnssttilouzk"
    rows = [(i, prose(one, 300), "large") for i in range(60)] + [(100, prose(two, 60), "small")] + [(200 + i, prose(two, 60), None) for i in range(20)] + [(300 + i, prose(one, 60), None) for i in range(20)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[200 + i] == "small" for i in range(20)) >= 18 and sum(got[300 + i] == "large" for i in range(20)) >= 18


def test_more_languages_than_a_worker_holds_at_once(spark):
    """Languages beyond a group, each of letters of its own, those with the fewest labelled rows among them; all but the most frequent stay unknown if only so many are asked for."""
    rng = random.Random(21)
    n = language.GROUP + 12
    prose = lambda k, size: " ".join("".join(rng.choices([chr(0x4E00 + 40 * k + j) for j in range(12)], k=rng.randint(2, 4))) for _ in range(size))
    rows = [(1000 * k + j, prose(k, 60), f"l{k:03}") for k in range(n) for j in range(2 if k < 20 else 1)] + [(1000 * k + 500, prose(k, 30), None) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert sum(got[1000 * k + 500] == f"l{k:03}" for k in range(n)) >= n - 2
    some = {r["lang_pred"] for r in language.identify(docs, languages=20).collect()}
    assert some <= {f"l{k:03}" for k in range(20)}


def test_letters_by_category(spark):
    rows = [(1, "½ Ⅷ ② 12"), (2, "½ a"), (3, "你"), (4, "__ 5")] + [(10 + i, "some words of text here", "aa") for i in range(3)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame([(*r, None)[:3] for r in rows], "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[4] == "und" and got[2] == got[3] == "aa"


# 9


def test_pieces_equal_brute_force_and_round_trip(docs, corpus, empty):
    model = pieces.pieces()
    texts = {t for _, t, *_ in corpus if t and len(t) < 400} | {"你好 𝕏 ▁", "   ", "\n\n a", "é" * 50}
    for text in texts:
        whole = pieces.MARK + text.replace(" ", pieces.MARK)
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(whole)
        for end in range(1, len(whole) + 1):
            for begin in range(max(0, end - 24), end):
                found = model.scores.get(whole[begin:end])
                cost = found[0] if found else model.unknown if end - begin == 1 else None
                if cost is not None:
                    best[end] = max(best[end], (best[begin][0] + cost, end - begin))
        ids, score, _ = model.encode(text)
        assert score == best[-1][0]
        assert model.decode(ids.tolist()) == text.replace(pieces.MARK, " ")
    got = pieces.decode(pieces.encode(docs)).select("doc_id", "text").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((i, (t or "").replace(pieces.MARK, " ")) for i, t, *_ in corpus), key=str)
    assert pieces.op9(empty).count() == 0
    assert pieces.op9(docs).count() == len(corpus)


def test_chunks_are_solved_side_by_side(corpus, monkeypatch):
    """Words of usual length never take the way of one chunk at a time, and come out as they do on it, also with a memory and batches so small that both are begun anew."""
    rng = random.Random(9)
    letters = list("abeinst é▁ \n\r\t你𝕏€ßтю.,12") + ["the", " the", "▁▁", "ing"]
    texts = [t for _, t, *_ in corpus] + ["", "é" * 63, "x" * 63] + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(500)]
    alone = pieces.Pieces()
    want = []
    for text in texts:
        whole = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
        solved = [alone.chunk(c) for c in re.findall(f"{pieces.MARK}*[^{pieces.MARK}\n]+|{pieces.MARK}+|\n", whole)]
        want.append((np.frombuffer(b"".join(s[0] for s in solved), np.int32).tolist(), sum(s[1] for s in solved), sum(s[2] for s in solved)))

    def refused(self, text):
        raise AssertionError(f"{text!r} was solved alone")

    monkeypatch.setattr(pieces.Pieces, "chunk", refused)
    for setting in ({}, {"MEMO": 50, "WINDOW": 100, "LANES": 16}):
        for name, value in setting.items():
            monkeypatch.setattr(pieces, name, value)
        model = pieces.Pieces()
        for text, hoped in zip(texts[:20], want, strict=False):
            ids, *rest = model.encode(text)
            assert (ids.tolist(), *rest) == hoped
        for some, hoped in ((texts, want), (texts[::-1], want[::-1])):
            ids, n, scores, n_bytes = model.encode_all(some)
            ends = np.cumsum(n)
            got = [(ids[a:b].tolist(), score, k) for a, b, score, k in zip([0, *ends], ends, scores, n_bytes, strict=False)]
            assert got == hoped
            assert model.decode_all(ids, ends) == [(t or "").replace(pieces.MARK, " ") for t in some]
    monkeypatch.undo()
    assert alone.encode("ab" * 400)[0].tobytes() == alone.chunk(pieces.MARK + "ab" * 400)[0]


def test_rows_are_taken_by_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_BYTES", 10)
    monkeypatch.setattr(pieces, "BATCH", 3)
    texts = ["", None, "a", "b", "x" * 30, "cccc", "d" * 8, "eee", "f"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert [p.column("text").to_pylist() for p in pieces.parts([batch], "text")] == [["", None, "a"], ["b"], ["x" * 30], ["cccc"], ["d" * 8], ["eee", "f"]]
    lists = pa.RecordBatch.from_pydict({"ids": pa.array([[1, 2, 3], None, [4], [5], []], pa.list_(pa.int32()))})
    assert [p.column("ids").to_pylist() for p in pieces.parts([lists], "ids")] == [[[1, 2, 3]], [None, [4], [5]], [[]]]


# 10


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_equal_brute_force(spark, docs, corpus, empty):
    rng = random.Random(7)
    bad = [(500 + i, "".join(rng.choices("#$% ab", k=700)), "aa", "s", 1) for i in range(60)]
    everything = docs.unionByName(spark.createDataFrame(bad, docs.schema))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(500 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (9999, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(everything, labels).collect()
    texts = collections.defaultdict(set)
    for i, t, *_ in corpus + bad:
        texts[i].add(t)
    assert len(got) == len(corpus) + len(bad)
    for r in got:
        counts = tuple(r)[1:6]
        assert counts in {brute_counts(t) for t in texts[r["doc_id"]]}
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] is not None and r["doc_id"] >= 540 or r["doc_id"] in range(100, 120):
            assert r["kept"] == (not r["base_failed"] and r["doc_id"] < 500)
    unlabelled = quality.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in unlabelled)
    assert quality.judge(empty, labels).count() == 0


def test_quality_verdicts_equal_brute_force(spark, docs, corpus):
    """The fitted model applied by hand: every word, pair of words and run of four bytes looked up by itself."""
    rng = random.Random(17)
    bad = [(500 + i, "".join(rng.choices("#$% ab", k=700)), "aa", "s", 1) for i in range(60)]
    everything = docs.unionByName(spark.createDataFrame(bad, docs.schema))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(500 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality._fitted(everything, labels)
    mask = (1 << quality.BITS) - 1

    def by_hand(text):
        raw = text.translate(LOWER).encode()
        spots = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        word = [int(hashes(np.frombuffer(raw, np.uint8), np.array([a]), np.array([b]), lower=True)[0]) for a, b in spots]
        pair = [int(grams(np.array([a, b], np.uint64), 2)[0]) for a, b in zip(word, word[1:], strict=False)]
        whole = text.encode()
        quads = [(int.from_bytes(whole[k : k + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BITS) for k in range(len(whole) - 3)]
        z = model["bias"]
        for weights, codes in zip(model["weights"], ([h & mask for h in word], [h & mask for h in pair], quads), strict=True):
            z += sum(float(weights[c]) for c in codes) / max(1, len(codes))
        return 1 / (1 + math.exp(-(model["slope"] * z + model["shift"])))

    want = collections.defaultdict(set)
    for i, t, *_ in corpus + bad:
        n, _, _, _, repeated = brute_counts(t)
        failed = n < 50 or 100 * repeated > 50 * n
        want[i].add((failed, not failed and by_hand(t) >= quality.KEEP_FROM))
    got = quality.judge(clashing(everything, "n_words", "kept", "quality", "probability", "size"), labels).collect()
    assert len(got) == len(corpus) + len(bad)
    for r in got:
        assert (r["base_failed"], r["kept"]) in want[r["doc_id"]]


def test_the_labelled_sample_is_bounded_and_takes_an_id_once(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    rows = [(i, "x" * 90) for i in range(40)] + [(1, f"again {k}") for k in range(500)] + [(41, "y" * 5000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(42)] * 3, "doc_id long, quality int, toxic int")
    texts, good = quality.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    for value in (0, 1):
        assert 800 < sum(len(t) for t, g in zip(texts, good, strict=True) if g == value) <= 1000
    assert sum(t.startswith(b"again") for t in texts) <= 1
