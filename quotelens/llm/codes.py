"""Vector code compression: product codes whose codebooks come from Elkan's form of Lloyd's algorithm, in integers.

Components are floor(256 x), a vector is cut into equal parts, and each part position has a codebook. Rows keep, from round to round, an upper
bound on the distance to the entry they are assigned to, for each part, and a lower bound for each entry, half a byte each: how many units of the part it
lies above the upper bound, rounded down. Entries move, bounds are shifted by as much, and a distance is worked out only where the bounds don't rule the entry
out *strictly*; what is worked out is compared in integers, ties to the lower index. So rounding only ever costs a needless distance, never a wrong code.

The state of a round is a table in the shared folder: a pass over it makes the next one and, for each task, the sums of the entries' parts.
Codebooks (16 x 64 entries) are all that goes to tasks or to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import new_folder, remove_folder
from .frames import cut, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows worked on at once: 16 x 64 distances of 8 bytes for each.
ROWS = 1_024
#: A part's unit of lower bounds is its codebook's greatest distance divided by so many; bounds of more than LEVELS units above the upper one stay there.
STEPS, LEVELS = 64, 15
MOST = (1 << 63) - 1


@dataclass
class Codebooks:
    """entries[part, entry, position], all integers, and what Elkan's tests need of them."""

    entries: np.ndarray
    unit: np.ndarray  # of lower bounds, for each part; from the first entries, so that it stays the same
    moved: np.ndarray  # how far each entry has moved since the bounds were written, rounded up

    def between(self) -> np.ndarray:
        """Distances between the entries of a part, rounded down."""
        e = self.entries
        return _down(np.sqrt((((e[:, :, None] - e[:, None]) ** 2).sum(3)).astype(np.float64)))


def _down(x: np.ndarray) -> np.ndarray:
    """A float that is no greater than the real root, for the root of an integer taken in double precision."""
    return np.maximum(0, x * (1 - 1e-12))


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-12)


def first_books(seeds: np.ndarray, parts: int) -> Codebooks:
    """Codebooks of the first rows' parts; seeds: rows of integers, in order."""
    entries = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    books = Codebooks(entries, np.ones(parts), np.zeros(entries.shape[:2]))
    books.unit = np.maximum(1.0, books.between().max((1, 2)) / STEPS)
    return books


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, size) to entries (m, size)."""
    return ((x[:, None] - entries[None]) ** 2).sum(2)


def _levels(lower: np.ndarray, upper: np.ndarray, unit: float) -> np.ndarray:
    """Lower bounds (rows, entries) as units above the row's upper bound. 0 says nothing of the entry."""
    return np.clip(np.floor((lower - upper[:, None]) / unit), 0, LEVELS).astype(np.uint8)


def _kept(x: np.ndarray) -> np.ndarray:
    """Upper bounds as they are kept: single precision, rounded up."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def first_assignment(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, upper bounds and lower bounds (as levels) of x (rows, parts, size), with every distance worked out."""
    n, parts, _ = x.shape
    codes, upper = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32)
    lower = np.zeros((n, parts, books.entries.shape[1]), np.uint8)
    for p in range(parts):
        d = exact(x[:, p], books.entries[p])
        codes[:, p] = d.argmin(1)  # the first of equals
        upper[:, p] = _kept(np.sqrt(d.min(1).astype(np.float64)))
        lower[:, p] = _levels(_down(np.sqrt(d.astype(np.float64))), upper[:, p].astype(np.float64), books.unit[p])
    return codes, upper, lower


def assign(x: np.ndarray, books: Codebooks, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The next assignment from the last one's codes, upper bounds and lower bounds (as levels): codes, upper, lower, and how many distances it took."""
    n, parts, _ = x.shape
    m = books.entries.shape[1]
    codes, upper, lower = codes.copy(), upper.copy(), lower.copy()
    between, work = books.between(), 0
    for p in range(parts):
        entries, half = books.entries[p], between[p] / 2
        own = codes[:, p].astype(np.int64)
        before = upper[:, p].astype(np.float64)
        u = _up(before + books.moved[p][own])
        low = np.where(lower[:, p] > 0, _down(before[:, None] + lower[:, p] * books.unit[p] - books.moved[p]), 0.0)

        def open_pairs(rows: np.ndarray) -> np.ndarray:
            """Pairs of a row and an entry that no bound rules out."""
            left = (low[rows] <= u[rows][:, None]) & (half[own[rows]] <= u[rows][:, None])
            left[np.arange(len(rows)), own[rows]] = False
            return left

        nearest = np.where(np.eye(m, dtype=bool), np.inf, half).min(1)
        rows = np.flatnonzero(u >= nearest[own])  # the others are strictly nearest to their own entry
        rows = rows[open_pairs(rows).any(1)]
        # The own entry's distance first: with that bound tight, fewer others are left.
        mine = ((x[rows, p] - entries[own[rows]]) ** 2).sum(1)
        root = np.sqrt(mine.astype(np.float64))
        u[rows], low[rows, own[rows]] = _up(root), _down(root)
        left = open_pairs(rows)
        i, c = np.nonzero(left)
        d = ((x[rows[i], p] - entries[c]) ** 2).sum(1)
        work += len(rows) + len(d)
        low[rows[i], c] = _down(np.sqrt(d.astype(np.float64)))
        best = np.full((len(rows), m), MOST)
        best[i, c] = d
        best[np.arange(len(rows)), own[rows]] = mine
        codes[rows, p] = best.argmin(1)  # the first of equals
        u[rows] = _up(np.sqrt(best.min(1, initial=MOST).astype(np.float64)))
        upper[:, p] = _kept(u)
        lower[:, p] = _levels(low, upper[:, p].astype(np.float64), books.unit[p])
    return codes, upper, lower, work


def errors_of(x: np.ndarray, books: Codebooks, codes: np.ndarray) -> np.ndarray:
    """Squared distance of each row to what its codes stand for."""
    at = books.entries[np.arange(x.shape[1])[None], codes]
    return ((x - at) ** 2).sum((1, 2))


def updated(books: Codebooks, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
    """Entries at the floors of their parts' means; those without parts stay. sums[part, entry, position]."""
    entries = np.where(counts[:, :, None] > 0, np.floor_divide(sums, np.maximum(1, counts)[:, :, None]), books.entries)
    return Codebooks(entries, books.unit, _up(np.sqrt(((entries - books.entries) ** 2).sum(2).astype(np.float64))))


def integers(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the rows that take part, x as an array of long, and the number of components.

    Rows whose vector is null or empty or holds null or non-finite components go. All vectors have the size of the smallest kept id's (the first of
    those that the parts divide); rows of other sizes go too. Components are held where sums of squares still fit a long, for 64 components at 2^27, which is 524,288 before scaling.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), e.cast("array<double>").alias("embedding"))
    rows = rows.where(e.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(e) > 0) & (F.size(e) % parts == 0))
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size(e).alias("size")))["size"].alias("size")).first()["size"]
    size = first or parts
    most = isqrt((1 << 62) // size) // 2
    held = F.transform(e, lambda v: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), v * F.lit(float(SCALE))))).cast("long"))
    return rows.where(F.size(e) == size).select("vec_id", "label", held.alias("x")), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of integers, from arrays or from cells of 2, 4 or 8 bytes a component."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)
    return np.stack([np.frombuffer(v, f"<i{len(v) // size}").astype(np.int64) for v in column.to_pylist()])


def _cells(rows: np.ndarray) -> pa.Array:
    """A binary cell for each row of a matrix."""
    n, width = rows.shape[0], rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _components(x: np.ndarray) -> pa.Array:
    most = np.abs(x).max(initial=0)
    return _cells(x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"))


def _halves(lower: np.ndarray) -> pa.Array:
    """Levels, two to a byte."""
    flat = lower.reshape(len(lower), -1)
    flat = np.pad(flat, ((0, 0), (0, flat.shape[1] % 2)))
    return _cells(flat[:, ::2] | flat[:, 1::2] << 4)


def _state(batch: pa.RecordBatch, parts: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, upper and lower of a batch of kept rows."""
    n = batch.num_rows
    read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, -1)
    packed = read("lower", np.uint8)
    lower = np.stack([packed & 15, packed >> 4], 2).reshape(n, -1)[:, : parts * m].reshape(n, parts, m)
    return read("codes", np.uint8), read("upper", np.float32), lower


STATE = "vec_id long, label string, x binary, codes binary, upper binary, lower binary, part int, entry int, sums array<long>, members long"


def _round(rows: DataFrame, books: Codebooks, size: int, path: str) -> None:
    """One assignment of all rows, written to path with its bounds, and after each task's rows its sums for each part and entry (in rows without x)."""
    parts, m = books.entries.shape[:2]
    width = size // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, m, width), np.int64), np.zeros((parts, m), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                b = batch.slice(a, ROWS)
                x = _matrix(b.column("x"), size).reshape(-1, parts, width)
                if "codes" in b.schema.names:
                    codes, upper, lower, _ = assign(x, books, *_state(b, parts, m))
                else:
                    codes, upper, lower = first_assignment(x, books)
                for p in range(parts):
                    np.add.at(sums[p], codes[:, p], x[:, p])
                    counts[p] += np.bincount(codes[:, p], minlength=m)
                none = pa.nulls(b.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("label"), _components(x.reshape(len(x), -1)), _cells(codes), _cells(upper), _halves(lower), none, none, pa.nulls(b.num_rows, pa.list_(pa.int64())), pa.nulls(b.num_rows, pa.int64())],
                    ["vec_id", "label", "x", "codes", "upper", "lower", "part", "entry", "sums", "members"],
                )
        part, entry = np.nonzero(counts)
        if len(part):
            n, none = len(part), lambda kind: pa.nulls(len(part), kind)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(sums[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays(
                [none(pa.int64()), none(pa.string()), *(none(pa.binary()) for _ in range(4)), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), lists, pa.array(counts[part, entry])],
                ["vec_id", "label", "x", "codes", "upper", "lower", "part", "entry", "sums", "members"],
            )

    rows.mapInArrow(tidy(run), STATE).write.parquet(path)


def _sums(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The tasks' sums added up: a row for each part and entry, 1,024 at the most."""
    width = books.entries.shape[2]
    added = state.where("members IS NOT NULL").groupBy("part", "entry").agg(F.sum("members").alias("members"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))
    sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    for row in added.collect():
        sums[row["part"], row["entry"]] = [row[f"s{k}"] for k in range(width)]
        counts[row["part"], row["entry"]] = row["members"]
    return sums, counts


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame | None, int]:
    """The codebooks after all rounds, the state of the last round (vec_id, label, x, codes and bounds, from before the last update) and the number of components. No rows: no state.

    The first entries are the parts of the smallest ids' vectors, in order (of rows with one id, and of null ids, which come last, by their components);
    fewer rows than entries: as many entries as rows. Repeated rows count each time.
    """
    spark = vectors.sparkSession
    rows, size = integers(vectors, parts)
    seeds = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "x").limit(entries).select("x").collect()
    if not seeds:
        return Codebooks(np.zeros((parts, 0, 1), np.int64), np.ones(parts), np.zeros((parts, 0))), None, size
    books, path = first_books(np.array([r["x"] for r in seeds], np.int64), parts), None
    for _ in range(rounds):
        before, path = path, new_folder(spark, "codes")
        _round(rows, books, size, path)
        if before:
            remove_folder(spark, before)
        state = spark.read.parquet(path)
        books = updated(books, *_sums(state, books))
        rows = state.where("x IS NOT NULL").select("vec_id", "label", "x", "codes", "upper", "lower")
    return books, rows, size


def encode(state: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error: the last assignment, by the state's bounds, and its squared distances summed over parts."""
    parts, m, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                b = batch.slice(a, ROWS)
                x = _matrix(b.column("x"), size).reshape(-1, parts, width)
                codes, *_ = assign(x, books, *_state(b, parts, m))
                hexes = codes.tobytes().hex()
                texts = [hexes[k : k + 2 * parts] for k in range(0, len(hexes), 2 * parts)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(texts, pa.string()), pa.array(errors_of(x, books, codes))], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(tidy(run), "vec_id long, label string, code string, error long")


def digest(books: Codebooks) -> str:
    """sha256 of all components, by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of each row that takes part, and the codebooks. vectors: vec_id, embedding, and label if there is one; other columns play no part.

    Null, empty, non-finite vectors and those of another size go (see integers()). Null ids are rows like others, last among the first entries. Ties
    between entries go to the lower index. Empty table, or no row that takes part: no rows, empty codebooks.
    """
    books, state, size = train(vectors, parts, entries, rounds)
    if state is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long"), books
    return encode(state, books, size), books


def op11(vectors: DataFrame) -> DataFrame:
    """The codes with the errors summed over equal labels (nulls together, none beyond the largest long) and the codebooks' digest."""
    coded, books = compress(vectors)
    coded = cut(coded)
    coded = coded.withColumn("key", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label")))
    # Partial sums first, and both sides of the join are dealt anew, so that a label that many rows have can be split.
    added = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = cut(coded.groupBy("key").agg(added.alias("label_error")))
    return coded.join(sums, "key").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
