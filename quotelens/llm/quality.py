"""Quality rules: hashed word and character n-gram logistic regression, calibrated, scored in Arrow batches against fixed thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import SPACE, grams, hashes, mix, slices, utf8, whole, words
from .frames import give_back, tidy

#: The classifier is fitted on at most so many labelled documents of each class, those with the smallest hashes of their ids, and of these on whole
#: texts of at most so many bytes together (longer texts teach nothing).
SAMPLE_ROWS, SAMPLE_BYTES = 1_500, 1 << 24
#: A document is kept from this calibrated probability of being good.
KEEP_FROM = 0.35
#: The contract's fixed limits.
MIN_WORDS, REPEAT_PERCENT = 50, 50
BITS = 16
FAMILIES = ("word", "word pair", "4 bytes")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(flat: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five base counts of each row."""
    starts, ends, first = words(flat, off)
    n_words = np.diff(first)
    rows = len(off) - 1
    characters = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    spaces = np.concatenate([[0], np.cumsum(SPACE[flat])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[flat])])
    out = {
        "n_words": n_words,
        "word_chars": np.diff(characters[off]) - np.diff(spaces[off]),
        "n_symbols": np.diff(symbols[off]),
        "n_dup_lines": np.zeros(rows, np.int64),
        "n_repeat_words": np.zeros(rows, np.int64),
    }
    h = hashes(flat, starts, ends, lower=False)
    row = np.repeat(np.arange(rows), n_words)
    if len(h) >= 3:
        key = mix(grams(h, 3) + row[: len(h) - 2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        inside = np.flatnonzero(whole(first, 3))
        key = key[inside]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[inside[twice] + k] = True
        out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    raw = flat.tobytes()
    for i in range(rows):
        part = raw[off[i] : off[i + 1]]
        if b"\n" in part:
            lines = [x for x in part.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def features(flat: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the hashed features of all rows, one after another, and where each row's begin."""
    starts, ends, first = words(flat, off)
    h = hashes(flat, starts, ends, lower=True)
    mask = np.uint64((1 << BITS) - 1)
    pairs = whole(first, 2)
    quads = np.zeros(0, np.uint64)
    quad_first = np.zeros(len(off), np.int64)
    if len(flat) >= 4:
        x = flat.astype(np.uint32)
        code = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
        within = np.ones(len(code), bool)
        for cut in off[1:-1]:
            within[max(0, cut - 3) : cut] = False
        quads = (code[within] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        quad_first = np.concatenate([[0], np.cumsum(within)])[np.minimum(off, len(code))]
    pair_first = np.concatenate([[0], np.cumsum(pairs)])[np.minimum(first, len(pairs))]
    return [
        ((h & mask).astype(np.int64), first),
        ((grams(h, 2)[pairs] & mask).astype(np.int64), pair_first),
        (quads.astype(np.int64), quad_first),
    ]


def means(weight: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean weight of each row's features; 0 for none."""
    sums = np.concatenate([[0.0], np.cumsum(weight[codes], dtype=np.float64)])
    return np.diff(sums[first]) / np.maximum(1, np.diff(first))


def logits(model: dict, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    z = np.full(len(off) - 1, model["bias"])
    for weight, (codes, first) in zip(model["weights"], features(flat, off), strict=True):
        z += means(weight, codes, first)
    return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[bytes], good: np.ndarray, rounds: int = 60, step: float = 60.0, decay: float = 1e-4) -> dict | None:
    """Full-batch AdaGrad on three quarters of the rows, then Platt's scaling on the others. None unless both classes are there."""
    if len(set(good.tolist())) < 2:
        return None
    fit = np.arange(len(texts)) % 4 != 3
    if len(set(good[fit].tolist())) < 2 or len(set(good[~fit].tolist())) < 2:
        fit[:] = True
    y = good[fit].astype(float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh the same
    # Each family as (code, row, frequency), equal codes of a row added up.
    found: list[list] = [[] for _ in FAMILIES]
    base = 0
    for flat, off in _runs([t for t, f in zip(texts, fit, strict=True) if f]):
        for own, (codes, first) in zip(found, features(flat, off), strict=True):
            row = np.repeat(np.arange(len(off) - 1), np.diff(first))
            key, n = np.unique(row.astype(np.int64) << BITS | codes, return_counts=True)
            row = key >> BITS
            own.append(((key & ((1 << BITS) - 1)).astype(np.int32), (row + base).astype(np.int32), (n / np.maximum(1, np.diff(first))[row]).astype(np.float32)))
        base += len(off) - 1
    parts = [tuple(np.concatenate(x) for x in zip(*own, strict=True)) for own in found]
    del found
    model = {"bias": 0.0, "weights": [np.zeros(1 << BITS) for _ in FAMILIES]}
    squares = [np.full(1 << BITS, 1e-8) for _ in FAMILIES]
    for _ in range(rounds):
        z = np.full(len(y), model["bias"])
        for w, (codes, row, f) in zip(model["weights"], parts, strict=True):
            z += np.bincount(row, w[codes] * f, len(y))
        slope = (sigmoid(z) - y) * share
        model["bias"] -= 0.5 * slope.sum()
        for w, s, (codes, row, f) in zip(model["weights"], squares, parts, strict=True):
            g = np.bincount(codes, slope[row] * f, 1 << BITS) + decay * w / len(y)
            s += g * g
            w -= step / rounds * g / np.sqrt(s)
    rest = ~fit if (~fit).any() else fit
    z = np.concatenate([logits(model, flat, off) for flat, off in _runs([t for t, f in zip(texts, rest, strict=True) if f])])
    return model | dict(zip(("slope", "shift"), platt(z, good[rest].astype(float)), strict=True))


def _runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts as flat arrays, about `most` bytes at once: what is made of them takes many times as much."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield np.frombuffer(b"".join(texts[at:to]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]).astype(np.int64)
        at = to


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Newton's method for sigmoid(a z + b), with Platt's smoothed targets and a small ridge."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        d, w = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -4, 4)
    return max(a, 1e-3), b


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Whole texts of labelled documents, within SAMPLE_ROWS and SAMPLE_BYTES for each class; of rows that share an id, one. Those bounds hold for what reaches the driver and for the ids sent to the scan."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    picked = None
    for value in (0, 1):
        one = known.where(F.col("quality") == value).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        picked = one if picked is None else picked.unionByName(one)
    picked = picked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.withColumn("size", F.octet_length("text")).where(F.col("size") <= SAMPLE_BYTES)
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    up_to = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", one).where("n = 1").withColumn("sum", F.sum("size").over(up_to)).where(F.col("sum") <= SAMPLE_BYTES)
    rows = rows.select("text", "quality", F.xxhash64("doc_id").alias("by"), "doc_id").collect()
    rows.sort(key=lambda r: (r["by"], r["doc_id"]))
    return [r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], int)


def _fitted(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The classifier as it is sent to the tasks: 3 * 2^BITS single-precision weights at most."""
    model = train(*labelled_sample(docs, labels))
    give_back()
    return model and model | {"weights": [w.astype(np.float32) for w in model["weights"]]}


def verdicts(model: dict | None, text: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base counts, whether the base rules fail, and the probability of being good (1 without a model)."""
    flat, off = utf8(text)
    c = counts(flat, off)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
    return c, failed, sigmoid(model["slope"] * logits(model, flat, off) + model["shift"]) if model else np.ones(len(failed))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps. Null and empty texts go; of equal rows all stay or all go; a null id hinders nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(_fitted(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, failed, p = verdicts(sent.value, part.column("text"))
                yield part.filter(pa.array(~failed & (p >= KEEP_FROM)))

    return docs.mapInArrow(tidy(run), docs.schema)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the probability of being good, for each row of docs.

    Null or empty text: all counts 0, so base_failed. Rows with an unknown or null id are judged by their text alike; labels that are
    null, or of ids that docs lacks, teach nothing. Without labels of both classes the base rules alone decide (probability null). Equal
    rows get equal results. A very long text is counted and scored whole. Other columns of docs play no part. Empty table: no rows.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(_fitted(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                c, failed, p = verdicts(model, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed), pa.array(~failed & (p >= KEEP_FROM)), pa.array(p if model else [None] * len(failed), pa.float64())],
                    ["doc_id", *c, "base_failed", "kept", "probability"],
                )

    return docs.mapInArrow(tidy(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
