"""Near-duplicates by min-max hashing: of every permutation both the least and the greatest value go into the signature, so half
the permutations give as many values. Bands of the signature propose pairs, whole shingle sets confirm them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import BASE, grams, hashes, mix, slices, utf8, words
from .frames import cut, tidy
from .graph import components

SHINGLE = 5
#: Links need 100 * |A & B| >= PERCENT * |A | B|.
PERCENT = 75
#: 64 permutations give 128 values: 32 bands of two minima and two maxima. A pair at 0.75 is missed by all with (1 - 0.75 ** 4) ** 32 < 6e-6.
PERMUTATIONS, BANDS = 64, 32
#: Shingles of the sets that a task of leftover() holds together.
CHUNK = 500_000
_RNG = np.random.Generator(np.random.PCG64(19990923))
_FACTORS = _RNG.integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingles(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's 5-word shingles, one row after another, and where each row's begin.

    A row of one to four words has one shingle, all its words; a row without words has none.
    """
    starts, ends, first = words(flat, off)
    h = hashes(flat, starts, ends, lower=True)
    five = grams(h, SHINGLE)
    parts = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            parts.append(np.unique(five[a : b - SHINGLE + 1]))
        elif b > a:
            parts.append(grams(h[a:b], b - a) + np.uint64(b - a))
        else:
            parts.append(h[:0])
    return np.concatenate([*parts, h[:0]]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def bands(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band; rows must not be empty."""
    out = np.zeros((len(off) - 1, BANDS), np.uint64)
    width = PERMUTATIONS // BANDS
    for k in range(PERMUTATIONS):
        y = values * _FACTORS[k] + _SHIFTS[k]
        for ends in (np.minimum.reduceat(y, off[:-1]), np.maximum.reduceat(y, off[:-1])):
            out[:, k // width] = mix(out[:, k // width] * BASE + ends + np.uint64(k))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the shingle set, and band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, off = shingles(*utf8(part.column("text")))
                sizes = np.diff(off)
                some = sizes > 0
                keys = np.zeros((len(sizes), BANDS), np.uint64)
                if some.any():
                    keys[some] = bands(values, np.concatenate([off[:-1][some], off[-1:]]))
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """node (the doc_id) and its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, off = shingles(*utf8(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["node", "shingles"])

    return docs.mapInArrow(tidy(run), "node long, shingles array<long>")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are similar enough."""
    left, right = texts.select(F.col("node").alias("a"), F.col("shingles").alias("one")), texts.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", F.size("one").alias("n"), F.size("two").alias("m"), F.size(F.array_intersect("one", "two")).alias("common"))
    return both.where(100 * F.col("common") >= PERCENT * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def _fitting(one: str, two: str):
    """Sets whose sizes alone allow the similarity."""
    return 100 * F.least(one, two) >= PERCENT * F.greatest(one, two)


def leftover(buckets: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components that the stars have left apart though they share a bucket.

    Each such bucket goes to its largest component C; the bucket's other rows become queries of C, and are held against all of C and
    against each other. So whatever shares a bucket is compared unless it is connected already, once for all buckets, and
    no pairs are made: a task gets whole sets, of queries and of targets, in chunks of about CHUNK shingles.
    """
    at = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = at.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    open_ = per.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1 AND all > 2")
    queries = at.join(open_.select("bucket", F.col("top.component").alias("owner")), "bucket").where("component <> owner").select("owner", "node", "component", "n").distinct()
    queries = cut(queries)
    everyone = at.select("node", "component", "n").distinct()
    targets = everyone.join(queries.select(F.col("owner").alias("component")).distinct(), "component", "left_semi").select(F.col("component").alias("owner"), "node", "component", "n")
    sizes = queries.groupBy("owner").agg(F.sum("n").alias("asked")).join(targets.groupBy("owner").agg(F.sum("n").alias("held")), "owner")
    chunks = sizes.select("owner", F.ceil(F.col("asked") / CHUNK).cast("int").alias("q_chunks"), F.ceil((F.col("asked") + F.col("held")) / CHUNK).cast("int").alias("t_chunks"))

    def dealt(rows: DataFrame, own: str, other: str, role: int) -> DataFrame:
        """Rows in their own chunk, once for each chunk of the other role."""
        here = rows.join(chunks, "owner").withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"{own}_chunks")).cast("int"))
        return here.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1))).select("owner", "q", "t", F.lit(role).alias("role"), "node", "component")

    rows = dealt(queries, "q", "t", 0).unionByName(dealt(targets.unionByName(queries), "t", "q", 1))

    def compare(group: pa.Table) -> pa.Table:
        role, node, component = (group.column(c).to_numpy() for c in ("role", "node", "component"))
        lists = group.column("shingles").combine_chunks()
        values, off = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        _, code = np.unique(values, return_inverse=True)
        sizes = np.diff(off)
        t, q = np.flatnonzero((role == 1) & (sizes > 0)), np.flatnonzero(role == 0)
        at = np.concatenate([np.arange(off[i], off[i + 1]) for i in t] or [off[:0]])
        heads = np.cumsum(sizes[t]) - sizes[t]
        held, mark = code[at], np.zeros(len(code) + 1, np.int32)
        links: list[tuple[int, int]] = []
        for i in q.tolist():
            if not len(t):
                break
            own = code[off[i] : off[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[held], heads)
            mark[own] = 0
            near = (100 * common >= PERCENT * (len(own) + sizes[t] - common)) & (component[t] != component[i])
            if near.any():  # one link to each component is enough
                _, first = np.unique(component[t][near], return_index=True)
                links += [(min(a, b), max(a, b)) for a, b in zip([int(node[i])] * len(first), node[t][near][first].tolist(), strict=True)]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    whole = rows.join(texts, "node")
    return whole.groupBy("owner", "q", "t").applyInArrow(compare, "a long, b long").distinct()


def link(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Null text and text without words: set size 0, a component of its own. Rows with one doc_id count as one document when links
    are followed. Null ids are linked with nothing but take their copies' component. Empty table: no rows.

    Equal sets are one node from the start (the smallest doc_id), so thousands of copies are one row in the search. In each bucket the
    node with most bucket mates, mostly the text that the others were made from, is held against the others; leftover() sees to the rest.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = cut(signed(docs))
    full = base.where("n_shingles > 0")
    nodes = full.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    buckets = cut(rows.join(shared, "bucket").select("bucket", "node", "n", "size"))
    mates = cut(buckets.groupBy("node").agg(F.max("n").alias("n"), F.sum("size").alias("mates")))
    wanted = cut(sets(docs.join(mates.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")))
    centres = buckets.join(mates.select("node", "mates"), "node").groupBy("bucket").agg(F.max(F.struct("mates", F.negative("node").alias("minus"), "n")).alias("top"))
    pairs = buckets.join(centres.select("bucket", F.negative("top.minus").alias("centre"), F.col("top.n").alias("m")), "bucket").where((F.col("node") != F.col("centre")) & _fitting("n", "m"))
    edges = cut(confirm(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct(), wanted))
    labels = components(edges)
    found = cut(leftover(buckets.select("bucket", "node", "n"), labels, wanted))
    if found.limit(1).count():
        labels = components(edges.unionByName(found))
    classes = full.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")).join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    linked = full.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))
    alone = base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
