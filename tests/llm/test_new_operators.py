"""Operators 11 to 13 against plain versions, with every odd case."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotelens.llm import alignment, codes, exactdedup
from quotelens.llm import queries as llm

SF = "/root/testdata/sf0.001"
CLASH = ["id", "mine", "own", "full", "slot", "again", "row", "length", "beginning", "size", "kept", "digest", "batch", "number", "x", "codes", "key", "error", "text_sha256"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- exact duplicates


def plain_classes(rows):
    def order(i):
        return (i is None, i or 0)

    norm = [re.sub("[\\x20\\x09-\\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for k, t in enumerate(norm):
        groups[t].append(k)
    out = []
    for members in groups.values():
        first = min(members, key=lambda k: order(rows[k][0]))
        for k in members:
            out.append((rows[k][0], rows[first][0], len(members), k == first, hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    long = "word " * 60_000
    own = ["a b", "a  b", "a\t\nb", " a b", "a b ", None, "", "   ", "\n", "ünï\vx", "ünï x", "ü x", "ü x", long, long + " ", long + "x", long[:-1] + "y", "x" * 300 + "1", "x" * 300 + "2"]
    rows = [(i, t) for i, t in enumerate(own)]
    rows += [(i + 100, "same again") for i in range(40)] + [(7, "same again"), (7, "same again"), (None, "same again"), (None, "only null"), (None, "only null"), (None, None)]
    return rows


def test_exact_dedup(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = plain_classes(texts)
    assert rows_of(exactdedup.classes(df, digests=True)) == want
    assert rows_of(exactdedup.classes(clashing(df))) == sorted((w[:4] for w in want), key=repr)


def test_exact_dedup_keeps_rows_whole(spark, texts):
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string")).repartition(3)
    left = exactdedup.keep(df)
    assert left.columns == df.columns
    got = [(r["doc_id"], re.sub("[\\x20\\x09-\\x0D]+", " ", r["text"] or ""), r["kept"]) for r in left.collect()]
    kept = [(w[0], w[4], "clash") for w in plain_classes(texts) if w[3]]
    assert sorted(((i, hashlib.sha256(t.encode()).hexdigest(), c) for i, t, c in got), key=repr) == sorted(kept, key=repr)


def test_exact_dedup_when_slots_are_full(spark, texts, monkeypatch):
    """With few slots, rows that are alone are read in full too; nothing else changes."""
    monkeypatch.setattr(exactdedup, "SLOTS", 2)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(exactdedup.classes(df, digests=True)) == plain_classes(texts)


def test_exact_dedup_reads_only_survivors_in_full(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    full = {r["id"] for r in exactdedup.refined(df).where("full IS NOT NULL").collect()}
    assert {0, 1, 2, 100, 139, 17, 18} <= full and not {3, 4} & full  # same beginnings go on to the full hash, lengths of their own don't


# -- codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows (vec_id, components or None, label): Lloyd's algorithm with all distances, in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = min((r for r in kept if len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, len(r[1])), default=None)
    kept = [r for r in kept if first and len(r[1]) == len(first[1])]
    if not kept:
        return [], ""
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest():
        return [[min(range(len(books[p])), key=lambda c: (far(cut(r[1], p), books[p][c]), c)) for p in range(parts)] for r in kept]

    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for c in range(len(books[p])):
                mine = [cut(r[1], p) for r, a in zip(kept, at) if a[p] == c]
                if mine:
                    books[p][c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = nearest()
    errors = [sum(far(cut(r[1], p), books[p][a[p]]) for p in range(parts)) for r, a in zip(kept, at)]
    labels = Counter()
    for r, e in zip(kept, errors):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in a), e, labels[r[2]], digest) for r, a, e in zip(kept, at, errors)), key=repr), digest


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, size=64, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size)) * rng.uniform(0.1, 2, (n, 1))
    x[n // 2 :] = np.round(x[n // 2 :] * 2) / 2  # many ties
    x[5], x[6] = x[4], -x[4]
    return [(i * 3, [float(np.float32(v)) for v in row], int(i % 5) if i % 7 else None) for i, row in enumerate(x)]


def test_codes(spark):
    rows = vectors(150)
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [nan] * 64, 1), (4, [inf] + [0.0] * 63, 1), (5, [None] + [0.0] * 63, 1), (7, [0.0] * 64, None), (8, [0.5] * 32, 1), (10, [], 1), (11, [0.1] * 17, 1), (-1, [0.25] * 64, 9), (None, [0.5] * 64, 9), rows[9], rows[9]]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(5)
    assert rows_of(codes.op11(clashing(df))) == plain_codes(rows + odd)[0]


def test_codes_of_few_or_no_rows(spark):
    assert codes.op11(spark.createDataFrame([], VECTORS)).collect() == []
    few = vectors(9)[:7] + [(0, None, 1)]
    assert rows_of(codes.op11(spark.createDataFrame(few, VECTORS))) == plain_codes(few)[0]
    one = [(4, [3e38, -3e38] * 32, None)]  # components beyond the bound are held there
    assert [tuple(r)[:4] for r in codes.op11(spark.createDataFrame(one, VECTORS)).collect()] == [(4, "00" * 16, 0, 0)]


def test_bounds_rule_out_most_distances_and_none_too_many():
    """Assignment by bounds, round after round, is the assignment by all distances, and takes a part of them."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 4, 4)) * 300
    x = (centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 4, 4)) * 20).astype(np.int64)
    x[:200] = x[200:400]
    books = codes.first_books(x[:64].reshape(64, -1), 4)
    state = codes.first_assignment(x, books)
    for _ in range(6):
        sums = np.zeros(books.entries.shape, np.int64)
        counts = np.zeros(books.entries.shape[:2], np.int64)
        for p in range(4):
            np.add.at(sums[p], state[0][:, p], x[:, p])
            np.add.at(counts[p], state[0][:, p], 1)
        books = codes.updated(books, sums, counts)
        *state, work = codes.assign(x, books, *state)
        want = codes.first_assignment(x, books)[0]
        assert (state[0] == want).all()
        # Upper bounds are never below the real distance, lower bounds never above it.
        for p in range(4):
            d = np.sqrt(codes.exact(x[:, p], books.entries[p]).astype(float))
            assert (state[1][:, p] >= d[np.arange(len(x)), state[0][:, p]]).all()
            low = np.where(state[2][:, p] > 0, state[1][:, p : p + 1].astype(float) + state[2][:, p] * books.unit[p], 0)
            assert (low <= d + 1e-9).all()
    assert work < 0.2 * x.shape[0] * 4 * 64


# -- alignment


def plain_alignment(rows):
    """rows (doc_id, text): byte by byte, from both libraries' own encodings of whole texts."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: these bytes are themselves, the others follow from 256 on
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs, pairs = [], Counter()
    for _, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        owner_a = [i for i, t in enumerate(a_bytes) for _ in t]
        owner_b = [i for i, t in enumerate(b_bytes) for _ in t]
        links = sorted(set(zip(owner_a, owner_b)))
        groups, ga, gb = [], [], []
        for k, (i, j) in enumerate(zip(owner_a, owner_b)):
            ga += [i] if i not in ga[-1:] else []
            gb += [j] if j not in gb[-1:] else []
            if (k + 1 == len(owner_a) or owner_a[k + 1] != i) and (k + 1 == len(owner_b) or owner_b[k + 1] != j):
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((a, b, [(a[i], b[j]) for i, j in links], [([a[i] for i in x], [b[j] for j in y]) for x, y in groups]))
        pairs.update(set(docs[-1][2]))
    best = defaultdict(int)
    for (i, _), n in pairs.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, _), (a, b, links, groups) in zip(rows, docs):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(pairs[x] == best[x[0]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr), pairs


ODD = [
    None, "", " ", "   ", "\n", "a", "▁", "x ▁ y", "ünï  cödé", "  two  spaces  ", "tab\t and\n  lines \n\n end \n", "中文字符 混合 text", "🙂🙃 emoji 👩‍👩‍👧", "<|endoftext|> <s> <unk> <0x41>", "a\0b", "don't I'll we're", "1234567 12,345.67",
    "  nbsp  em   line", "\x1c \x1d x", "ﬁ ǆ é é", "word" * 3000, "é" * 500, " \n \t " * 50, "Привет, мир!  Как   дела?", "مرحبا بالعالم", "x\r\n  y\r\n",
]


def test_alignment(spark, corpus):
    rows = [(r[0], r[1]) for r in corpus] + [(1000 + k, t) for k, t in enumerate(ODD)]
    want, pairs = plain_alignment(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(alignment.align(clashing(df))) == want
    assert sum(w[1] == 0 for w in want) < 20  # most of them have tokens
    best = defaultdict(int)
    for (a, _), n in pairs.items():
        best[a] = max(best[a], n)
    written = alignment.aligned(df)
    got = alignment.pairs_of(alignment.pair_counts(written)).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, n, n == best[a]) for (a, b), n in pairs.items())


def test_alignment_over_many_tasks(spark, docs, monkeypatch):
    """Stripes dealt to several tasks, small batches: the same rows."""
    want = rows_of(alignment.align(docs))
    monkeypatch.setattr(alignment, "TASK_BYTES", 500)
    monkeypatch.setattr(alignment, "BATCH", 7)
    assert rows_of(alignment.align(docs)) == want


def test_alignment_of_no_rows(spark, empty):
    assert alignment.align(empty).collect() == []


def test_words_are_encoded_as_whole_texts_are(corpus):
    """Words put together give the libraries' ids of the whole text."""
    model = alignment.Pair()
    for text in [t for _, t, *_ in corpus if t] + [t for t in ODD if t]:
        first, second = model.encode_all([text])[0]
        assert "".join(alignment.WORDS.findall(" " + text)) == " " + text
        if len(first):
            assert first.tolist() == model.slow.encode(" " + text, add_special_tokens=False).ids
            assert second.tolist() == model.second.encode(text)


def test_a_model_with_pieces_over_words_is_refused(monkeypatch):
    class Model:
        def __init__(self, **_): ...
        def get_piece_size(self): return 1  # noqa: E704
        def id_to_piece(self, i): return "a▁b"  # noqa: E704
        def is_byte(self, i): return False  # noqa: E704

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="beginning of a word"):
        alignment.Pair()


# -- contracts


def plain_frame(df):
    df = df.astype(object)[sorted(df.columns)]
    cell = lambda v: "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_exact_dedup"])
def test_new_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert plain_frame(llm.queries()[name](spark, SF).toPandas()) == plain_frame(con.sql(llm.oracle_sql()[name]).df())


def test_new_contracts(spark):
    want = {
        "op11_vector_codes": [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")],
        "op12_exact_dedup": [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")],
        "op13_cross_tokenizer_alignment": [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")],
    }
    for name, columns in want.items():
        assert llm.queries()[name](spark, SF).dtypes == columns
