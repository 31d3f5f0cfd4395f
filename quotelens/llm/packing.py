"""Best-fit packing by exact complements: how many pieces there are of each length decides everything, so the plan is made
from a histogram of at most `capacity` counts; which piece takes which place follows from its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, tidy

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=2)
def encoders(name: str):
    """The JSON tokenizer, the same vocabulary as ranks, which is four times as fast, and the strings of the JSON one's added tokens, which the ranks lack."""
    import base64
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, tuple(t.content for t in slow.get_added_tokens_decoder().values())


def token_ids(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """Ids of a text and the end id after them, as little-endian unsigned 32-bit numbers.

    Both encoders give the same ids. Texts that hold an added token's string go to the JSON tokenizer, which makes that token of it, and so
    do characters beyond Latin letters, as the two may class letters by different Unicode versions.
    """
    slow, fast, added = encoders(name)
    text = text or ""
    if any(x in text for x in added) or not text.isascii() and max(text) >= "ɐ":
        ids = slow.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_to_numpy(text, disallowed_special=())
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END
    return out


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: only what is longer than a sequence is cut, and only the first piece may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


class Lengths:
    """How many pieces are left of each length, and which sums two of them make: an index that is kept as lengths run out."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        self.left[: len(counts)] = counts
        self.left[0] = 0
        self.capacity = capacity
        self.there = (self.left > 0).astype(np.int64)
        #: For each sum, the number of pairs of different lengths that make it, both left, and one more if two pieces of half its length are.
        self.pairs = np.convolve(self.there, self.there)[: capacity + 1]
        halves = np.arange(0, capacity // 2 + 1)
        self.pairs[2 * halves] -= self.there[halves]
        self.pairs //= 2
        self.pairs[2 * halves] += self.left[halves] > 1

    def add(self, length: int, many: int) -> None:
        """So many pieces more, or fewer, of a length; the index follows where the length runs out or comes back."""
        before = int(self.left[length])
        after = self.left[length] = before + many
        if (before > 0) != (after > 0):
            step = 1 if after > 0 else -1
            self.there[length] = 0  # a length makes no pair of different lengths with itself
            self.pairs[length:] += step * self.there[: self.capacity + 1 - length]
            self.there[length] = after > 0
        if (before > 1) != (after > 1) and 2 * length <= self.capacity:
            self.pairs[2 * length] += 1 if after > 1 else -1

    def pair(self, total: int) -> tuple[int, int] | None:
        """The two lengths of that sum that can be taken most often."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange((total + 1) // 2, total)
        often = np.minimum(self.left[a], self.left[total - a])
        often[a == total - a] //= 2
        best = int(a[often.argmax()])
        return best, total - best

    def fills(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths of that sum, as few as can be; of several pairs the one that can be taken most often, with the longest third length that leaves one."""
        if self.left[gap]:
            return (gap,)
        two = self.pair(gap)
        if two:
            return two
        third = np.flatnonzero(self.there[:gap])
        for c in third[self.pairs[gap - third] > 0][::-1].tolist():
            self.add(c, -1)  # held back, as the pair may want that length too
            two = self.pair(gap - c)
            self.add(c, 1)
            if two:
                return c, *two
        return None


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset): pieces of that length and those ranks lie at that offset of consecutive sequences.

    Longest pieces first. For the gap that a piece leaves, one, two or three lengths that fill it exactly are looked up, as
    their counts allow; where none do, the longest that fits goes in, and what is left of the gap is tried again.
    Each step uses up a length, so steps are bounded by lengths, not by pieces.
    """
    lengths = Lengths(counts, capacity)
    left = lengths.left
    used = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    longest = capacity

    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            break
        parts, gap = [longest], capacity - longest
        lengths.add(longest, -1)  # held back while the gap is filled
        while gap:
            found = lengths.fills(gap)
            if found is None:
                below = np.flatnonzero(left[1 : gap + 1])
                if not len(below):
                    break
                found = (int(below[-1]) + 1,)
            for v in found:
                lengths.add(v, -1)
            parts += found
            gap -= sum(found)
        for v in parts:
            lengths.add(v, 1)
        times = min(int(left[v]) // parts.count(v) for v in set(parts))
        offset = 0
        for v in parts:
            rows.append((v, int(used[v]), times, sequence, offset))
            used[v] += times
            lengths.add(v, -times)
            offset += v
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY, text: str = "text") -> DataFrame:
    """Pieces with the partition they were made in and their rank there among pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for i, doc_id in enumerate(ids):
                tokens = token_ids(texts[i].as_py(), name)
                for k, (at, n) in enumerate(pieces_of(len(tokens), capacity)):
                    rows.append((doc_id, k, at, n, zlib.crc32(tokens[at : at + n].tobytes()), part, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs.

    Null text is empty: one piece with the end id alone. Rows with equal or null ids are packed as documents of their own. A very long text
    is tokenized whole and cut into many pieces. Other columns of docs play no part. Empty table: no rows. The texts are read once and tokenized where they lie; shuffled are only the pieces' lengths and ranks.
    """
    pieces = cut(cut_documents(docs, capacity, name, text))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most `capacity` rows reach the driver, whatever the input.
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    sent = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ranks_before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(rows) else rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
