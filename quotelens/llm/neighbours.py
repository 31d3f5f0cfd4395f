"""Approximate nearest neighbours by inner product: in each shard a robust-pruned directed graph, searched by beams.

Vectors get one more component that makes all norms of a shard equal, so the largest inner product is the least distance, and
pruning by distance holds. Equal vectors are one node with their ids beside it. Every node is inserted twice, with pruning at
distance ratio 1 and then ALPHA: a greedy search from the shard's entry points proposes neighbours, of which those are kept that no
kept one is nearer to (by ALPHA) than the node itself. Queries search every shard in blocks; scores are computed again in double precision.

Norms of a shard differ by BAND at the most. Where they differ more, the larger ones are near to every query and the smaller ones to one another, and a search
that begins among these misses what it looks for; so nodes are dealt to bands of norms first, and a band to shards.

A search costs much the same in a shard of any size, so shards are few: they have SHARD_ROWS nodes while there are no more of them than
partitions, then grow to SHARD_MOST, and with them the beam. Only beyond that their number grows with the data, and work with queries times shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, partitions

NEAREST, EVERY = 20, 20
#: Nodes of a shard (about) at the least and the most, edges of a node, beam while building and while searching SHARD_ROWS, nodes expanded at once.
SHARD_ROWS, SHARD_MOST, DEGREE, BUILD_BEAM, SEARCH_BEAM, WIDE = 6_000, 48_000, 28, 64, 160, 4
ALPHA = 1.2
#: The largest norm of a band is about so many times its smallest.
BAND = 1.1
ENTRIES = 16
#: Queries that travel together, so a shard's graph is sent once for so many.
QUERY_BLOCK = 16_384


def shard_count(nodes: int, partitions: int) -> int:
    return max(1, min(-(-nodes // SHARD_ROWS), max(partitions, -(-nodes // SHARD_MOST))))


def band_of(embedding: Column) -> Column:
    """The band of a vector's norm. A norm of 1 is in the middle of one, so vectors that are 1 long but for rounding share it."""
    most = F.array_max(F.transform(embedding, F.abs))  # so that no square is too large or too small
    squares = F.aggregate(F.transform(embedding, lambda v: v / most), F.lit(0.0), lambda a, v: a + v * v)
    return F.floor((F.log(most) + F.log(squares) / 2) / F.log(F.lit(BAND)) + 0.5).cast("int")


def search_beam(nodes: int) -> int:
    """Recall falls slowly with a shard's size (at beam 160 from 0.987 for 6,000 nodes to 0.949 for 18,000, isotropic in 64 dimensions); a wider beam makes up for it."""
    return int(SEARCH_BEAM * max(1.0, nodes / SHARD_ROWS) ** 0.4)


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and inner products found for each query, best first; -1 where there are fewer. edges: node by DEGREE, -1 for none."""
    rows, n = len(q), len(x)
    beam = min(beam, n)
    seen = np.zeros((rows, n), bool)
    ids = np.full((rows, beam), -1)
    best = np.full((rows, beam), -np.inf, np.float32)
    done = np.zeros((rows, beam), bool)
    new = np.tile(entries[:beam], (rows, 1))
    active = np.arange(rows)
    while len(active):
        at = np.repeat(active, new.shape[1]).reshape(new.shape)
        good = (new >= 0) & ~seen[at, new]
        # The same node twice in a row of `new` counts once.
        order = np.argsort(new, axis=1, kind="stable")
        s = np.take_along_axis(new, order, 1)
        twice = np.zeros_like(good)
        np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
        good &= ~twice
        seen[at[good], new[good]] = True
        found = np.full(new.shape, -np.inf, np.float32)
        found[good] = np.einsum("ij,ij->i", x[new[good]], q[at[good]])
        all_ids = np.concatenate([ids[active], np.where(good, new, -1)], 1)
        all_best = np.concatenate([best[active], found], 1)
        all_done = np.concatenate([done[active], np.zeros(new.shape, bool)], 1)
        pick = np.argsort(-all_best, axis=1, kind="stable")[:, :beam]
        ids[active], best[active], done[active] = (np.take_along_axis(v, pick, 1) for v in (all_ids, all_best, all_done))
        open_ = ~done[active] & (ids[active] >= 0)
        active, open_ = active[open_.any(1)], open_[open_.any(1)]
        if not len(active):
            break
        first = np.argsort(~open_, axis=1, kind="stable")[:, :WIDE]
        real = np.take_along_axis(open_, first, 1)
        nodes = np.where(real, np.take_along_axis(ids[active], first, 1), 0)
        done[active[:, None], first] |= real
        new = np.where(real[:, :, None], edges[nodes], -1).reshape(len(active), -1)
    return ids, best


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int = DEGREE) -> np.ndarray:
    """Up to `degree` diverse neighbours of each node from its candidates (-1 for none)."""
    out = np.full((len(nodes), degree), -1)
    step = max(1, (1 << 22) // max(1, candidates.shape[1] ** 2))
    for a in range(0, len(nodes), step):
        node, c = nodes[a : a + step], candidates[a : a + step]
        c = np.sort(c, 1)
        alive = (c >= 0) & (c != node[:, None])
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        y = x[np.maximum(c, 0)]
        size = (x[node] ** 2).sum(1)  # all norms are equal
        near = np.maximum(0, 2 * (size[:, None] - np.einsum("ij,ikj->ik", x[node], y)))
        near[~alive] = np.inf
        order = np.argsort(near, 1, kind="stable")
        c, near, alive, y = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(alive, order, 1), np.take_along_axis(y, order[:, :, None], 1)
        apart = np.maximum(0, 2 * (size[:, None, None] - y @ y.transpose(0, 2, 1)))
        rows = np.arange(len(node))
        for k in range(degree):
            first = alive.argmax(1)
            there = alive[rows, first]
            if not there.any():
                break
            out[a : a + step][there, k] = c[rows, first][there]
            alive &= ~(there[:, None] & (alpha * alpha * apart[rows, first] <= near))
            alive[rows, first] = False
    return out


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors with their last component, the edges and the entry points of a shard's graph."""
    x = vectors.astype(np.float32)
    norms = (x.astype(np.float64) ** 2).sum(1)
    x = np.concatenate([x, np.sqrt(np.maximum(0, norms.max() - norms))[:, None].astype(np.float32)], 1)
    n = len(x)
    rng = np.random.default_rng(11)
    edges = np.full((n, DEGREE), -1)
    if n > 1:
        edges[:, : min(DEGREE, n - 1)] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(DEGREE, n - 1)))) % n
    middle = int((x @ x.mean(0)).argmax())
    entries = np.unique(np.concatenate([[middle], rng.choice(n, min(n, ENTRIES), replace=False)]))
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for a in range(0, n, 1024):
            nodes = order[a : a + 1024]
            found, _ = beam_search(x, edges, entries, x[nodes], BUILD_BEAM)
            edges[nodes] = robust_prune(x, nodes, np.concatenate([found, edges[nodes]], 1), alpha)
            # The other way round too; a node whose edges are full is pruned again.
            target, source = edges[nodes].ravel(), np.repeat(nodes, DEGREE)
            target, source = target[target >= 0], source[target >= 0]
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            for _ in range(len(target)):
                if not len(target):
                    break
                first = np.concatenate([[True], target[1:] != target[:-1]])
                rank = np.arange(len(target)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                now = rank < DEGREE  # more than so many at a time go in turn
                who = np.unique(target[now])
                wide = np.full((len(who), 2 * DEGREE), -1)
                wide[:, :DEGREE] = edges[who]
                wide[np.searchsorted(who, target[now]), DEGREE + rank[now]] = source[now]
                free = (np.sort(wide, 1)[:, :-1] >= 0).sum(1)  # roomy nodes just take the new edges in
                full = free >= DEGREE
                edges[who[full]] = robust_prune(x, who[full], wide[full], alpha)
                edges[who[~full]] = -np.sort(-wide[~full], 1)[:, :DEGREE]
                target, source = target[~now], source[~now]
    return x, edges, entries


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and components as double, without rows that take no part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0))
        .withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    )


def search(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose id is divisible by `every`.

    Null, zero or non-finite vectors take no part, nor do null ids; vectors of different sizes are not compared. Ties go to the smaller
    vec_id. Fewer candidates than asked for: all of them. No queries or an empty table: no rows. Rows with one id: each is a
    candidate, and as queries each searches for itself, so an id that occurs twice gets the better of both lists once. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    # A query needs at most nearest + 1 of the ids of equal vectors, itself among them.
    rank = Window.partitionBy("embedding").orderBy("vec_id")
    members = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= nearest + 1)
    nodes = cut(members.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # A row for each band: norms of doubles have some 15,000 at the most.
    nodes = nodes.withColumns({"size": F.size("embedding"), "band": band_of(F.col("embedding"))})
    bands = sorted((r["size"], r["band"], r["count"]) for r in nodes.groupBy("size", "band").count().collect())
    total, shards, ranges = sum(n for *_, n in bands), 0, []
    for size, band, n in bands:
        own = shard_count(n, -(-partitions(spark) * n // total))
        ranges.append((size, band, shards, own))
        shards += own
    dealt = nodes.join(spark.createDataFrame(ranges, "size int, band int, first int, own int"), ["size", "band"])
    sharded = dealt.select("size", (F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("own"))).cast("int").alias("shard"), "embedding", "ids")
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def index(group: pa.Table) -> pa.Table:
        x = np.array(group.column("embedding").to_pylist(), np.float64)
        _, edges, entries = build(x)
        ids = group.column("ids").combine_chunks()
        return pa.table({
            "size": pa.array([x.shape[1]], pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
            "vectors": pa.array([x.tobytes()], pa.binary()), "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()), "entries": pa.array([entries.astype(np.int32).tobytes()], pa.binary()),
            "ids": pa.array([ids.flatten().to_numpy().astype(np.int64).tobytes()], pa.binary()), "counts": pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()], pa.binary()),
        })

    # By range, so that every shard has a task of its own.
    graphs = cut(sharded.repartitionByRange(shards, "size", "shard").groupBy("size", "shard").applyInArrow(index, "size int, shard int, vectors binary, edges binary, entries binary, ids binary, counts binary"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.size("embedding").alias("size"), "vec_id", "embedding")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def packed(group: pa.Table) -> pa.Table:
        x = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table({"size": group.column("size").slice(0, 1), "asking": pa.array([group.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "asked": pa.array([x.tobytes()], pa.binary())})

    blocked = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        .groupBy("size", "block")
        .applyInArrow(packed, "size int, asking binary, asked binary")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                x = np.frombuffer(row["vectors"]).reshape(-1, row["size"])
                edges = np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE)
                counts = np.frombuffer(row["counts"], np.int32)
                ids, first = np.frombuffer(row["ids"], np.int64), np.concatenate([[0], np.cumsum(counts)])
                who, q = np.frombuffer(row["asking"], np.int64), np.frombuffer(row["asked"]).reshape(-1, row["size"])
                nodes, entries, beam = x.astype(np.float32), np.frombuffer(row["entries"], np.int32), search_beam(len(x))
                found = np.concatenate([beam_search(nodes, edges, entries, q[a : a + 512].astype(np.float32), beam)[0] for a in range(0, len(q), 512)])
                out: list[list] = [[], [], []]
                for k, (me, v) in enumerate(zip(who.tolist(), q, strict=True)):
                    at = found[k][found[k] >= 0]
                    score = (x[at] * v).sum(1)
                    by = np.argsort(-score, kind="stable")
                    least = score[by[min(len(by), nearest + 1) - 1]] if len(by) else 0
                    at, score = at[score >= least], score[score >= least]  # all ties stay
                    all_ids = np.concatenate([ids[first[j] : first[j + 1]] for j in at] or [ids[:0]])
                    scores = np.repeat(score, counts[at])
                    other = all_ids != me
                    all_ids, scores = all_ids[other], scores[other]
                    top = np.lexsort((all_ids, -scores))[:nearest]
                    for column, values in zip(out, ([me] * len(top), all_ids[top].tolist(), scores[top].tolist()), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    near = blocked.join(graphs, ["size", "shard"]).select("size", "vectors", "edges", "entries", "ids", "counts", "asking", "asked").mapInArrow(find, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
