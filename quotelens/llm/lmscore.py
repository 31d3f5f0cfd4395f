"""Language-model scores of whole texts by a log-bilinear model, trained in numpy by noise-contrastive estimation.

Tokens: lower-case words and one end for each text. The model's outcomes are the most frequent training words, the end,
and RARE classes of all other words (by their last two bytes); inside a class a word has probability (c + 1) / (N + V + 1) with
the class's own N and V, where the 1 more is for words never seen. Outcome w after outcomes u, v has the score
(C1 * R[v] + C2 * R[u]) . Q[w] + b[w]; the sums over outcomes are one matrix product for all pairs (u, v).

The outcomes grow with the vocabulary, as 2 * sqrt(V): from LEAST to MOST of them, where three tables of MOST * MOST scores are what a Python
worker may hold and work out. Training takes every training text once, in ROUNDS parts by hash: in each round all tasks learn from the same
parameters, and their mean by tokens begins the next. So steps grow with the texts. Which texts a task learns from, in which order and
with which noise, depends on how Spark deals the input to tasks: scores of another split of the same rows differ a little.

Word counts cover all training texts. Words are told apart by 64-bit hashes. The FREQUENT words are broadcast, a bounded table; what
concerns other words meets in hash buckets, as blobs, and comes back as sums for each document. Frequent words never get there,
so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, hashes, mix, slices, utf8, words
from .frames import cut, fold_of, partitions

RARE, SIZE = 127, 32
LEAST, MOST = 1024, 2048
END = RARE
FREQUENT = 1 << 16
ROUNDS, NOISE, BATCH, STEP = 3, 128, 4096, 0.05
END_HASH = np.uint64(0x5851F42D4C957F2D)
#: Text that a task takes together, and text whose rare words make a bucket.
BLOCK, BUCKET = 1 << 25, 1 << 26
#: Parameters of so many tasks are added up by one, level by level, until no more sums than this are left for the driver.
SLOTS = 8


def tokens(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and rare class of every token of all rows, ends included, and where each row's begin."""
    starts, ends, first = words(flat, off)
    h = hashes(flat, starts, ends, lower=True)
    last = LOWER[flat[ends - 1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    prior = LOWER[flat[np.maximum(ends - 2, starts)]].astype(np.int64) if len(ends) else last
    kind = (last * 31 + prior * 7) % RARE
    rows = len(off) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(first))
    out, classes = np.full(len(h) + rows, END_HASH, np.uint64), np.full(len(h) + rows, END, np.int64)
    out[at], classes[at] = h, kind
    return out, classes, first + np.arange(rows + 1)


def look_up(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the value is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def by_bucket(hashed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    of = ((hashed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """Distinct words of each block of training text with their counts, by bucket."""

    def rows(hashed, classes, n):
        order, cuts = by_bucket(hashed, buckets)
        used = np.flatnonzero(np.diff(cuts))
        pick = [order[cuts[b] : cuts[b + 1]] for b in used]
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array([x[p].tobytes() for p in pick], pa.binary()) for x in (hashed, classes.astype(np.uint8), n.astype(np.int64)))],
            ["bucket", "hashes", "classes", "counts"],
        )

    def merged(held):
        h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, c[first], np.bincount(inverse, n, len(u)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                flat, off = utf8(part.column("text"))
                h, c, _ = tokens(flat, off)
                if len(h):
                    held.append(merged([(h, c, np.ones(len(h), np.int64))]))
                    size += len(flat)
                if size >= BLOCK:
                    yield rows(*merged(held))
                    held, size = [], 0
        if held:
            yield rows(*merged(held))

    return docs.mapInArrow(run, "bucket int, hashes binary, classes binary, counts binary")


def summed(blobs: DataFrame, buckets: int) -> DataFrame:
    """For each bucket: its most frequent words, and for each class tokens and distinct words."""
    most = -(-FREQUENT // buckets)

    def run(group: pa.Table) -> pa.Table:
        h, c, n = (np.frombuffer(b"".join(group.column(k).to_pylist()), t) for k, t in (("hashes", np.uint64), ("classes", np.uint8), ("counts", np.int64)))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n, c = np.bincount(inverse, n, len(u)).astype(np.int64), c[first].astype(np.int64)
        top = np.lexsort((u, -n))[:most]
        return pa.table({
            "top": pa.array([[{"hash": a, "class": b, "n": k} for a, b, k in zip(u.view(np.int64)[top].tolist(), c[top].tolist(), n[top].tolist(), strict=True)]], pa.list_(pa.struct([("hash", pa.int64()), ("class", pa.int32()), ("n", pa.int64())]))),
            "tokens": pa.array([np.bincount(c, n, RARE + 1).astype(np.int64).tolist()], pa.list_(pa.int64())),
            "distinct": pa.array([np.bincount(c, minlength=RARE + 1).tolist()], pa.list_(pa.int64())),
        })

    return blobs.groupBy("bucket").applyInArrow(run, "top array<struct<hash: long, class: int, n: long>>, tokens array<long>, distinct array<long>")


def outcome_count(distinct: int) -> int:
    """128, 256, ... outcomes about 2 * sqrt(distinct words)."""
    return min(MOST, max(LEAST, -(-int(2 * distinct**0.5) // 128) * 128))


def vocabulary(docs: DataFrame, buckets: int) -> dict:
    """What of the counts all tasks need; its size is bounded by FREQUENT."""
    sums = cut(summed(counted(docs, buckets), buckets))
    top = sums.select(F.inline("top")).orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    per_class = sums.select(F.posexplode(F.arrays_zip("tokens", "distinct"))).groupBy("pos").agg(F.sum("col.tokens").alias("n"), F.sum("col.distinct").alias("v")).collect()
    n, v = np.zeros(RARE + 1, np.int64), np.zeros(RARE + 1, np.int64)
    for r in per_class:
        n[r["pos"]], v[r["pos"]] = r["n"], r["v"]
    h = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    c, k = np.array([r["class"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64)
    outcome = c.copy()
    total, distinct = int(n.sum()), int(v.sum())
    size = outcome_count(distinct)
    named = np.flatnonzero(h != END_HASH)[: size - RARE - 1]
    outcome[named] = END + 1 + np.arange(len(named))
    counts = np.zeros(size, np.int64)
    counts[: RARE + 1] = n
    np.subtract.at(n, c[named], k[named])
    np.subtract.at(v, c[named], 1)
    counts[:RARE] = n[:RARE]
    counts[outcome[named]] = k[named]
    by = np.argsort(h)
    # The log10 that stands for the words of a class: nothing for the end and the named words.
    inside = np.zeros(size)
    inside[:RARE] = np.log10(n[:RARE] + v[:RARE] + 1)
    return {"size": size, "hash": h[by], "outcome": outcome[by], "count": k[by], "N": total, "V": distinct, "counts": counts, "inside": inside}


def outcomes(model: dict, hashed: np.ndarray, classes: np.ndarray) -> np.ndarray:
    at, there = look_up(model["hash"], hashed)
    return np.where(there, model["outcome"][at], classes) if len(model["hash"]) else classes


def contexts(outcome: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes one and two places before each token of its row; start where there is none."""
    one, two = np.full(len(outcome), start), np.full(len(outcome), start)
    one[1:], two[2:] = outcome[:-1], outcome[:-2]
    heads = first[:-1]  # every row has its end at least
    one[heads], two[heads] = start, start
    next_ = heads + 1
    two[next_[next_ < len(two)]] = start
    return one, two


# The model


def fresh(counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    share = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))
    return {
        "R": rng.normal(0, 0.1, (len(counts) + 1, SIZE)).astype(np.float32),
        "Q": rng.normal(0, 0.1, (len(counts), SIZE)).astype(np.float32),
        "C": np.ones((2, SIZE), np.float32) * np.array([[1.0], [0.6]], np.float32),
        "b": np.log(share).astype(np.float32),
    }


def _scatter(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    s = index[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.add.reduceat(rows[order], first, axis=0)


def chances(odds: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-odds)), in place."""
    np.clip(odds, -30, 30, out=odds)
    np.negative(odds, out=odds)
    np.exp(odds, out=odds)
    odds += 1
    return np.reciprocal(odds, out=odds)


def learn(p: dict, squares: dict, noise_log: np.ndarray, one: np.ndarray, two: np.ndarray, target: np.ndarray, weight: np.ndarray, noise: np.ndarray) -> None:
    """One step of noise-contrastive estimation, noise shared by the batch; AdaGrad by row."""
    log_k = float(np.log(len(noise)))  # a numpy scalar would make all of this double
    r1, r2 = p["R"][one], p["R"][two]
    predicted = r1 * p["C"][0] + r2 * p["C"][1]
    w = weight / weight.sum()
    q = p["Q"][target]
    sure = (predicted * q).sum(1) + p["b"][target] - noise_log[target] - log_k
    up = (w / (1 + np.exp(np.clip(sure, -30, 30)))).astype(np.float32)  # towards the data
    down = chances(predicted @ p["Q"][noise].T + (p["b"][noise] - noise_log[noise] - log_k))
    down *= w[:, None]
    g_pred = up[:, None] * q - down @ p["Q"][noise]
    moves = [
        ("Q", *_scatter(np.concatenate([target, noise]), np.concatenate([up[:, None] * predicted, -(down.T @ predicted)]))),
        ("R", *_scatter(np.concatenate([one, two]), np.concatenate([g_pred * p["C"][0], g_pred * p["C"][1]]))),
        ("b", *_scatter(np.concatenate([target, noise]), np.concatenate([up, -down.sum(0)]))),
    ]
    g_c = np.stack([(g_pred * r1).sum(0), (g_pred * r2).sum(0)])
    for name, at, g in moves:
        squares[name][at] += g * g
        p[name][at] += STEP * g / np.sqrt(squares[name][at] + 1e-8)
    squares["C"] += g_c * g_c
    p["C"] += STEP * g_c / np.sqrt(squares["C"] + 1e-8)


def trained(docs: DataFrame, model: dict) -> dict[str, np.ndarray]:
    """Every task learns from all of its texts, from the same start; the mean by tokens is the start of the next round."""
    spark = docs.sparkSession
    p = fresh(model["counts"])
    shapes = [(k, p[k].shape) for k in ("R", "Q", "C", "b")]
    noise_share = (model["counts"] + 0.5) ** 0.75
    noise_share /= noise_share.sum()

    size = model["size"]
    for number in range(ROUNDS):
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == number) if ROUNDS > 1 else docs
        sent = spark.sparkContext.broadcast((model, p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, start = sent.value
            p = {k: v.copy() for k, v in start.items()}
            squares = {k: np.zeros_like(v) for k, v in p.items()}
            noise_log = np.log(noise_share).astype(np.float32)
            rng = np.random.default_rng([number, TaskContext.get().partitionId()])
            seen = 0
            for batch in batches:
                for rows in slices(batch, "text", 1 << 22):
                    h, c, first = tokens(*utf8(rows.column("text")))
                    if not len(h):
                        continue
                    w = outcomes(model, h, c)
                    one, two = contexts(w, first, size)
                    key, n = np.unique((two * (size + 1) + one) * size + w, return_counts=True)
                    mixed = rng.permutation(len(key))
                    key, n = key[mixed], n[mixed]
                    target, pair = key % size, key // size
                    noise = rng.choice(size, (-(-len(key) // BATCH), NOISE), p=noise_share)
                    for i, at in enumerate(range(0, len(key), BATCH)):
                        s = slice(at, at + BATCH)
                        learn(p, squares, noise_log, pair[s] % (size + 1), pair[s] // (size + 1), target[s], n[s].astype(np.float32), noise[i])
                    seen += len(w)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(seen)]), pa.array([b"".join((p[k].astype(np.float64) * seen).tobytes() for k, _ in shapes)], pa.binary())],
                    ["slot", "weight", "sums"],
                )

        def add(group: pa.Table) -> pa.Table:
            total = None
            for x in group.column("sums"):
                y = np.frombuffer(x.as_py(), np.float64)
                total = y.copy() if total is None else total + y
            return pa.table({"slot": pa.array([group.column("slot")[0].as_py()], pa.int32()), "weight": pa.array([float(sum(group.column("weight").to_pylist()))]), "sums": pa.array([total.tobytes()], pa.binary())})

        kind = "slot int, weight double, sums binary"
        left, sums = part.rdd.getNumPartitions(), part.mapInArrow(run, kind)
        while left > SLOTS:
            sums = sums.withColumn("slot", F.expr(f"slot div {SLOTS}").cast("int")).groupBy("slot").applyInArrow(add, kind)
            left = -(-left // SLOTS)
        parts = sums.collect()
        if parts:
            mean = sum(np.frombuffer(r["sums"], np.float64) for r in parts) / sum(r["weight"] for r in parts)
            at = 0
            for k, shape in shapes:
                n = int(np.prod(shape))
                p[k] = mean[at : at + n].reshape(shape).astype(np.float32)
                at += n
    return p


def tables(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores from the nearer and the farther context, and the log of the sum over outcomes for each pair (nearer, farther)."""
    near = (p["R"] * p["C"][0]) @ p["Q"].T + p["b"]
    far = (p["R"] * p["C"][1]) @ p["Q"].T
    top_near, top_far = near.max(1), far.max(1)
    sums = np.exp(near - top_near[:, None]) @ np.exp(far - top_far[:, None]).T
    return near, far, np.log(np.maximum(sums, 1e-30)) + top_near[:, None] + top_far[None, :]


def rare_words(docs: DataFrame, sent, buckets: int) -> DataFrame:
    """Sums over a text's words outside the broadcast table: log10(c + 1) and how many are known. rows counts equal rows of the input."""

    def rows(held):
        h, n, learnt, doc, text = (np.concatenate(x) for x in zip(*held, strict=True))
        order, cuts = by_bucket(h, buckets)
        used = np.flatnonzero(np.diff(cuts))
        pick = [order[cuts[b] : cuts[b + 1]] for b in used]
        kinds = (np.uint64, np.int32, np.bool_, np.int64, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array([x[q].astype(t).tobytes() for q in pick], pa.binary()) for x, t in zip((h, n, learnt, doc, text), kinds, strict=True))],
            ["bucket", "hashes", "counts", "learnt", "docs", "texts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = sent.value, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                flat, off = utf8(part.column("text"))
                h, _, first = tokens(flat, off)
                doc, text, learnt = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "text_hash", "learnt"))
                row = np.repeat(np.arange(len(off) - 1), np.diff(first))
                out = ~look_up(model["hash"], h)[1] & (h != END_HASH)
                h, row = h[out], row[out]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)])
                n = np.diff(np.concatenate([new, [len(h)]]))
                h, row = h[new], row[new]
                # One entry more for each row, so that rows can be told how often they occur; by document and text, as many documents may have one text.
                mark = np.arange(len(off) - 1)
                held.append((np.concatenate([h, mix(doc.astype(np.int64).view(np.uint64) + text.astype(np.int64).view(np.uint64))]), np.concatenate([n, np.zeros(len(mark), np.int64)]), learnt[np.concatenate([row, mark])].astype(bool), doc[np.concatenate([row, mark])], text[np.concatenate([row, mark])]))
                size += len(flat)
                if size >= BLOCK:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    def add(group: pa.Table) -> pa.Table:
        kinds = (("hashes", np.uint64), ("counts", np.int32), ("learnt", np.bool_), ("docs", np.int64), ("texts", np.int64))
        h, n, learnt, doc, text = (np.frombuffer(b"".join(group.column(k).to_pylist()), t) for k, t in kinds)
        word = n > 0
        u, inverse = np.unique(h, return_inverse=True)
        c = np.bincount(inverse, n * learnt, len(u))[inverse]
        order = np.lexsort((text, doc))
        doc, text = doc[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])[: len(doc)])
        add_up = lambda x: np.add.reduceat(x[order], first) if len(first) else x[:0]
        sums = (doc[first], text[first], add_up(n * np.log10(c + 1)), add_up(np.where(c > 0, n, 0).astype(np.int64)), add_up((~word).astype(np.int64)))
        # What a bucket knows of the documents goes to their owners as blobs too, not as a row for each document.
        order, cuts = by_bucket(mix(sums[0].view(np.uint64) + sums[1].view(np.uint64)), buckets)
        used = np.flatnonzero(np.diff(cuts))
        return pa.table({"owner": pa.array(used.astype(np.int32))} | {k: pa.array([x[order[cuts[b] : cuts[b + 1]]].astype(t).tobytes() for b in used], pa.binary()) for (k, t), x in zip(parts, sums, strict=True)})

    def merge(group: pa.Table) -> pa.Table:
        doc, text, logs, known, rows = (np.frombuffer(b"".join(group.column(k).to_pylist()), t) for k, t in parts)
        order = np.lexsort((text, doc))
        doc, text = doc[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])[: len(doc)])
        return pa.table({"doc": doc[first], "text_hash": text[first]} | {k: np.add.reduceat(x[order], first) if len(first) else x[:0] for k, x in (("logs", logs), ("known", known), ("rows", rows))})

    parts = (("doc", np.int64), ("text_hash", np.int64), ("logs", np.float64), ("known", np.int64), ("rows", np.int64))
    blobs = docs.mapInArrow(run, "bucket int, hashes binary, counts binary, learnt binary, docs binary, texts binary")
    sums = blobs.groupBy("bucket").applyInArrow(add, "owner int, " + ", ".join(f"{k} binary" for k, _ in parts))
    return sums.groupBy("owner").applyInArrow(merge, "doc long, text_hash long, logs double, known long, rows long")


_TABLES: dict = {}


def score(docs: DataFrame, learn_from=None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    learn_from: condition on the rows to learn from. Null text is empty: one token, the end. Nothing to learn from: train_tokens 0
    and a uniform model over what it knows, that is log10(1 / 1) for the base. Repeated rows get the same scores. A very long text is scored
    whole. Other columns of docs play no part. Empty table: no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))).alias("learnt"),
    ).withColumn("text_hash", F.xxhash64("text"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET))
    learning = keyed.where("learnt").select("text")
    model = vocabulary(learning, 4 * buckets)
    p = trained(learning, model)
    table = spark.sparkContext.broadcast(model)
    parameters = spark.sparkContext.broadcast(p)
    rare = rare_words(keyed.select("doc", "text_hash", "text", "learnt"), table, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        if _TABLES.get("of") is not parameters.value:
            _TABLES.update(of=parameters.value, tables=tables(parameters.value))
        near, far, sums = _TABLES["tables"]
        logs = np.log10(model["count"] + 1.0)
        inside = model["inside"]
        for batch in batches:
            for part in slices(batch, "text"):
                h, c, first = tokens(*utf8(part.column("text")))
                at, there = look_up(model["hash"], h)
                w = outcomes(model, h, c)
                one, two = contexts(w, first, model["size"])
                chosen = (near[one, w] + far[two, w] - sums[one, two]) / np.log(10) - inside[w]
                local = np.where(there, logs[at], 0.0) if len(logs) else np.zeros(len(h))
                add_up = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]  # noqa: E731, B023
                in_class = np.where(w < RARE, local, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("doc"), part.column("text_hash"), pa.array(np.diff(first)), pa.array(add_up(there.astype(np.int64))), pa.array(add_up(local)), pa.array(add_up(chosen.astype(np.float64) + in_class))],
                    ["doc_id", "doc", "text_hash", "n_tokens", "here", "local", "chosen"],
                )

    scored = keyed.select("doc_id", "doc", "text_hash", "text").mapInArrow(run, "doc_id long, doc long, text_hash long, n_tokens long, here long, local double, chosen double")
    both = scored.join(rare, ["doc", "text_hash"])
    logs, known = F.col("logs") / F.col("rows"), (F.col("known") / F.col("rows")).cast("long")
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("here") + known).alias("n_known"),
        F.lit(model["N"]).cast("long").alias("train_tokens"),
        (F.col("local") + logs - F.col("n_tokens") * F.log10(F.lit(float(model["N"] + model["V"] + 1)))).alias("base_score"),
        (F.col("chosen") + logs).alias("score"),
    )


def op3(docs: DataFrame) -> DataFrame:
    """Learns from folds other than 2 of 7; scores every row."""
    fold = fold_of("doc_id", 7)
    known = docs.withColumn("__learn", F.coalesce(fold != 2, F.lit(False)))
    out = score(known, F.col("__learn"))
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
