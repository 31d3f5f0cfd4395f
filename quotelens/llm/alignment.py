"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often pairs of ids go together in a corpus.

A text is encoded by both tokenizers once, and where tokens begin and end gives its groups and its links. Links are kept as postings: for a batch of documents
and a stripe of first ids, the pairs and for each pair the documents that hold it. Stripes take ids by remainder, so that common ids are spread over them.
Counts: the postings' sizes, partitioned by stripe, are added up with np.add.at in a dense block of that stripe's ids by all second ids, whose row maxima give
each id's best count. Scoring: blocks and postings are partitioned alike, each block goes before its postings, and what a document gets from each
stripe is added up. A stripe that has more than its share is dealt to several tasks, each with the block.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import new_folder
from .frames import cut, tidy
from .packing import encoders

FIRST, SECOND = "byte_bpe_50k", "piece_bpe_32k.model"
MARK = "▁"
#: Stripes of first ids, documents and bytes of text of a batch (a longer text is a batch of its own), bytes of postings that one task should get of a stripe.
STRIPES, BATCH, BATCH_BYTES, TASK_BYTES = 96, 1_000, 4 << 20, 64 << 20
#: Partial counts of a stripe come together in so many places before they do in one.
SPREAD = 16
#: Words remembered by a worker, and the longest that is.
MEMO, MEMO_CHARS = 300_000, 48
#: A word: spaces and what follows them up to the next space. After white space of another kind the spaces belong to it, as the first tokenizer takes them together.
WORDS = re.compile(r" *[^ ]+(?:(?<=\s) +[^ ]*)*| +")


@lru_cache(maxsize=1 << 16)
def settled(character: str) -> bool:
    """Whether a character was a letter, a digit or neither in Unicode 3.2 and is so still: both encoders of the first vocabulary class it alike, whatever versions they know."""
    old = unicodedata.ucd_3_2_0.category(character)
    return old != "Cn" and (old[0] if old[0] in "LN" else "") == (c if (c := unicodedata.category(character)[0]) in "LN" else "")


class Pair:
    """Both tokenizers, their tokens' lengths in bytes, and words already encoded."""

    def __init__(self, first: str = FIRST, second: str = SECOND):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.fast = encoders(first)[1]
        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{first}.json"))  # one of our own, as the setting stays
        self.slow.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        # Byte-level entries have a character for each byte; added tokens are not reached, as their strings are plain text here.
        self.first_sizes = np.zeros(self.slow.get_vocab_size(), np.int64)
        for token, i in self.slow.get_vocab(with_added_tokens=False).items():
            self.first_sizes[i] = len(token)
        self.pieces: list[bytes] = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(MARK, " ").encode())
            # Merges stay within words only if no piece has a mark after another character.
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"{second} has the piece {piece!r}, which goes on over the beginning of a word")
        self.second_sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.mark = self.second.piece_to_id(MARK)
        numbers = [str(i).encode() for i in range(max(len(self.first_sizes), len(self.pieces)))]
        self.digits = np.array([list(n.ljust(6)) for n in numbers], np.uint8)
        self.n_digits = np.array([len(n) for n in numbers], np.int64)
        self.memo: dict[str, tuple[bytes, bytes, bool]] = {}

    def first_ids(self, words: list[str]) -> np.ndarray:
        """Ids of words put together, which are those of each, as no token goes over the end of a word that doesn't end in white space."""
        text = "".join(words)
        if text.isascii() or all(map(settled, set(text))):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.concatenate([self.fast.encode_to_numpy(w, disallowed_special=()) if all(map(settled, w)) else self.slow.encode(w, add_special_tokens=False).ids for w in words]).astype(np.int64)

    def learn(self, words: list[str], into: dict) -> None:
        """Ids of words that begin with a space, by both, as 32-bit numbers, and whether both give its bytes back."""
        # Words in white space are encoded alone, the others together.
        alone = [w for w in words if w[-1].isspace()]
        for some in ([w for w in words if not w[-1].isspace()], *([w] for w in alone)):
            if not some:
                continue
            raw = [w.encode() for w in some]
            first = self.first_ids(some)
            ends = np.cumsum(self.first_sizes[first])
            at = [0, *np.searchsorted(ends, np.cumsum([len(r) for r in raw]), "right").tolist()]
            # The library puts a mark before every text but an empty one.
            second = [x or [self.mark] for x in self.second.encode([w[1:] for w in some], num_threads=1)]
            packed = first.astype(np.int32).tobytes()
            for k, (word, own) in enumerate(zip(some, raw, strict=True)):
                mine = packed[4 * at[k] : 4 * at[k + 1]]
                fine = b"".join([self.pieces[i] for i in second[k]]) == own
                into[word] = mine, array("i", second[k]).tobytes(), fine

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by both tokenizers of each text, with a space before it; none if it is null or empty or if the ids don't give its bytes back."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = [WORDS.findall(" " + t) if t else [] for t in texts]
        known, long = self.memo, {}
        unknown = {w for some in words for w in some if w not in known}
        self.learn([w for w in unknown if len(w) <= MEMO_CHARS], known)
        self.learn([w for w in unknown if len(w) > MEMO_CHARS], long)
        out, none = [], np.zeros(0, np.int32)
        for some in words:
            found = [known[w] for w in some] if not long else [known.get(w) or long[w] for w in some]
            if found and all([f[2] for f in found]):
                out.append((np.frombuffer(b"".join([f[0] for f in found]), np.int32), np.frombuffer(b"".join([f[1] for f in found]), np.int32)))
            else:
                out.append((none, none))
        return out


@lru_cache(maxsize=1)
def pair(first: str = FIRST, second: str = SECOND) -> Pair:
    return Pair(first, second)


class Aligned:
    """A batch of texts: where tokens begin and end, taken over all texts one after the other."""

    def __init__(self, model: Pair, texts: list[str | None]):
        encoded = model.encode_all(texts)
        self.model = model
        self.n_first, self.n_second = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
        self.first, self.second = (np.concatenate([e[k] for e in encoded] or [np.zeros(0, np.int32)]) for k in (0, 1))
        first_ends, second_ends = np.cumsum(model.first_sizes[self.first]), np.cumsum(model.second_sizes[self.second])
        of_first = np.repeat(np.arange(len(texts)), self.n_first)
        # Where both end, a group does. Second ends before each first end, and the other way round by counting.
        before = np.searchsorted(second_ends, first_ends)
        self.closing_first = second_ends[np.minimum(before, len(second_ends) - 1)] == first_ends if len(second_ends) else np.zeros(0, bool)
        self.closing_second = np.zeros(len(self.second), bool)
        self.closing_second[before[self.closing_first]] = True
        self.n_groups = np.bincount(of_first[self.closing_first], minlength=len(texts))
        # A link for each stretch between two neighbouring ends: one token of each side lies over it, and no other stretch has the same two.
        shared = np.cumsum(self.closing_first) - self.closing_first
        stretches = len(self.first) + len(self.second) - int(self.closing_first.sum())
        ended_first = np.zeros(stretches, np.int64)
        ended_first[np.arange(len(self.first)) + before - shared] = 1
        ended_second = 1 - ended_first
        ended_second[np.flatnonzero(ended_first)[self.closing_first]] = 1
        a, b = np.cumsum(ended_first) - ended_first, np.cumsum(ended_second) - ended_second
        self.link_first, self.link_second, self.link_text = self.first[a], self.second[b], of_first[a]
        self.n_links = np.bincount(self.link_text, minlength=len(texts))

    def digests(self) -> list[str]:
        """sha256 of the groups' ids: first ids with commas, a bar, second ids with commas; groups parted by semicolons. Empty for texts without tokens."""
        n = len(self.first) + len(self.second)
        # A group's first ids come after all second ids of the groups before, its second ids after all its first ids.
        group1, group2 = (np.cumsum(c) - c for c in (self.closing_first, self.closing_second))
        firsts, seconds = np.flatnonzero(self.closing_first) + 1, np.concatenate([[0], np.flatnonzero(self.closing_second) + 1])
        at1, at2 = np.arange(len(self.first)) + seconds[group1], np.arange(len(self.second)) + (firsts[group2] if n else 0)
        ids, marks = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at1], ids[at2] = self.first, self.second
        marks[at1[self.closing_first]], marks[at2[self.closing_second]] = ord("|"), ord(";")
        # All numbers written at once, digit by digit, each with its mark after it.
        sizes = self.model.n_digits[ids]
        ends = np.cumsum(sizes + 1)
        written, begins = np.zeros(int(ends[-1]) if n else 0, np.uint8), ends - sizes - 1
        for k in range(int(sizes.max(initial=0))):
            there = np.flatnonzero(sizes > k)
            written[begins[there] + k] = self.model.digits[ids[there], k]
        written[ends - 1] = marks
        out, raw, at, token = [], written.tobytes(), 0, 0
        for many in (self.n_first + self.n_second).tolist():
            token += many
            to = int(ends[token - 1]) if many else at
            out.append(hashlib.sha256(raw[at : to - 1]).hexdigest() if many else "")
            at = to
        return out

    def postings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each stripe: pairs (first id // STRIPES and second id in one number), texts of each pair, then for these texts their numbers in the batch and how often each holds the pair."""
        wide = self.link_first.astype(np.uint64)
        key = (wide % STRIPES << np.uint64(48)) | (wide // STRIPES << np.uint64(36)) | (self.link_second.astype(np.uint64) << np.uint64(20)) | self.link_text.astype(np.uint64)
        key, times = np.unique(key, return_counts=True)
        stripe, text = (key >> np.uint64(48)).astype(np.int64), (key & np.uint64((1 << 20) - 1)).astype(np.uint32)
        of, pair_at, sizes = np.unique(key >> np.uint64(20), return_index=True, return_counts=True)
        own = (of & np.uint64((1 << 28) - 1)).astype(np.uint32)
        at = np.searchsorted(of >> np.uint64(28), np.arange(STRIPES + 1).astype(np.uint64))
        where = np.append(pair_at, len(key))
        for s in np.unique(stripe).tolist():
            a, b = at[s], at[s + 1]
            yield s, own[a:b], sizes[a:b], text[where[a] : where[b]], times[where[a] : where[b]].astype(np.uint32)


def batches_of(rows: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """The columns' values, BATCH rows or BATCH_BYTES bytes of the last column (a text) at a time."""
    taken: list[list] = [[] for _ in columns]
    weight = 0
    for batch in rows:
        for row in zip(*(batch.column(c) for c in columns), strict=True):
            values = [v.as_py() for v in row]
            for column, v in zip(taken, values, strict=True):
                column.append(v)
            weight += len(values[-1] or "")
            if len(taken[0]) >= BATCH or weight >= BATCH_BYTES:
                yield taken
                taken, weight = [[] for _ in columns], 0
    if taken[0]:
        yield taken


_FIELDS = [
    ("batch", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("stripe", pa.int32()), ("weight", pa.int64()), ("pairs", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary()), ("times", pa.binary()),
]
_WRITTEN = "batch long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, weight long, pairs binary, sizes binary, texts binary, times binary"


def small(values: np.ndarray) -> bytes:
    """Numbers as bytes, in one, two or four bytes each (the first byte says which), the high bytes after the low ones, which packs better."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def large(raw: bytes) -> np.ndarray:
    """What small() wrote."""
    width = raw[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _FIELDS], [c for c, _ in _FIELDS])


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Each row of docs encoded once, written to the shared folder and read again, in two kinds of rows.

    Of documents: batch, number (within it), doc_id, n_a, n_b, n_groups, n_links, groups_sha256. Of postings: batch, stripe, pairs, sizes, texts (numbers within
    the batch), times, as bytes (see small()), and weight, their length. Null and empty texts, and those that either tokenizer doesn't give back, have
    zeros and no postings. Long texts are encoded whole, repeated rows each, null ids like others. Empty table: no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, batch = pair(first, second), TaskContext.get().partitionId() << 32
        for ids, texts in batches_of(rows, "doc_id", "text"):
            batch += 1
            own = Aligned(model, texts)
            yield _rows(batch=[batch] * len(ids), number=range(len(ids)), doc_id=ids, n_a=own.n_first, n_b=own.n_second, n_groups=own.n_groups, n_links=own.n_links, groups_sha256=own.digests())
            # Numbers of a pair's texts as steps from one to the next.
            stripes, cells = [], []
            for stripe, pairs, sizes, numbers, times in own.postings():
                begins = np.cumsum(sizes) - sizes
                steps = np.diff(numbers.astype(np.int64), prepend=0)
                steps[begins] = numbers[begins]
                stripes.append(stripe)
                cells.append([small(np.diff(pairs.astype(np.int64), prepend=0)), small(sizes), small(steps), small(times)])
            if stripes:
                one = [list(c) for c in zip(*cells, strict=True)]
                yield _rows(batch=[batch] * len(stripes), stripe=stripes, weight=[sum(map(len, c)) for c in cells], pairs=one[0], sizes=one[1], texts=one[2], times=one[3])

    path = new_folder(docs.sparkSession, "alignment")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), _WRITTEN).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


class Block:
    """Counts of a stripe: its first ids by all second ids, in one dense matrix, and which pairs of it are in use."""

    def __init__(self, first_size: int, second_size: int):
        self.counts = np.zeros((-(-first_size // STRIPES), second_size), np.int64)
        self.used: list[np.ndarray] = []
        self.held = 0

    def add(self, pairs: np.ndarray, sizes: np.ndarray) -> None:
        np.add.at(self.counts, (pairs >> 16, pairs & 0xFFFF), sizes)
        self.used.append(pairs)
        self.held += len(pairs)
        if self.held > 1 << 22:
            self.used = [np.unique(np.concatenate(self.used))]
            self.held = len(self.used[0]) // 2  # so that it is done again only after as many new ones

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in use and their counts, which are zero from then on."""
        pairs = np.unique(np.concatenate([*self.used, np.zeros(0, np.int64)]))
        counts = self.counts[pairs >> 16, pairs & 0xFFFF]
        self.counts[pairs >> 16, pairs & 0xFFFF] = 0
        self.used, self.held = [], 0
        return pairs, counts


_COUNTED = "stripe int, spot int, pairs binary, counts binary"


def _totals(counted: DataFrame, *keys: str, sizes: tuple[int, int]) -> DataFrame:
    """counted (stripe, spot, pairs, counts), partitioned and sorted by keys: for each their sums, from one dense block, over which the rows stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = Block(*sizes), None

        def row() -> pa.RecordBatch:
            pairs, counts = block.take()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[-1] if len(now) > 1 else 0], pa.int32()), pa.array([pairs.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["stripe", "spot", "pairs", "counts"])

        for batch in batches:
            for key, pairs, counts in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("pairs"), batch.column("counts"), strict=True):
                if now is not None and key != now:
                    yield row()
                now = key
                block.add(np.frombuffer(pairs.as_py(), np.int64), np.frombuffer(counts.as_py(), np.int64))
        if now is not None:
            yield row()

    return counted.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), _COUNTED)


def pair_counts(written: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(stripe, pairs, counts): for each stripe its pairs, as first id // STRIPES << 16 | second id, and how many documents hold each, as 64-bit numbers."""
    sizes = _sizes(first, second)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The postings of a task added up before they are shuffled, a stripe's pairs in a row, as often as they get many."""
        kept: dict[int, list] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            spot = TaskContext.get().partitionId() % SPREAD
            for stripe, parts in kept.items():
                pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                counts = np.zeros(len(pairs), np.int64)
                np.add.at(counts, at, np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([spot], pa.int32()), pa.array([pairs.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["stripe", "spot", "pairs", "counts"])

        for batch in batches:
            for stripe, pairs, counts in zip(batch.column("stripe").to_pylist(), batch.column("pairs").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                part = np.cumsum(large(pairs)), large(counts)
                kept.setdefault(stripe, []).append(part)
                held += len(part[0])
                if held > 1 << 22:
                    yield from out()
                    kept, held = {}, 0
        yield from out()

    parts = written.where("stripe IS NOT NULL").select("stripe", "pairs", "sizes").mapInArrow(tidy(unpack), _COUNTED)
    return _totals(_totals(parts, "stripe", "spot", sizes=sizes), "stripe", sizes=sizes).select("stripe", "pairs", "counts")


@lru_cache(maxsize=4)
def _sizes(first: str, second: str) -> tuple[int, int]:
    """Vocabulary sizes, which the widths of a pair's two numbers bound."""
    import public_tokenizers
    import sentencepiece

    sizes = encoders(first)[0].get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second)).get_piece_size()
    if sizes[0] > STRIPES << 12 or sizes[1] > 1 << 16:
        raise ValueError(f"at most {STRIPES << 12} first and {1 << 16} second ids")
    return sizes


def scores(written: DataFrame, counts: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(batch, number, n_best, count_sum) of each document that has links: links whose pair's count is its first id's greatest (ties included), and all links' counts added up."""
    sizes = _sizes(first, second)
    postings = written.where("stripe IS NOT NULL").select("stripe", "batch", "weight", "pairs", "sizes", "texts", "times")
    # How many tasks a stripe is dealt to: one for each TASK_BYTES of it. STRIPES rows at the most.
    shares = {r["stripe"]: max(1, -(-r["weight"] // TASK_BYTES)) for r in postings.groupBy("stripe").agg(F.sum("weight").alias("weight")).collect()}
    share = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col("stripe")] if shares else F.lit(1)
    null = lambda kind: F.lit(None).cast(kind)
    blocks = counts.select("stripe", F.explode(F.sequence(F.lit(0), (share - 1).cast("int"))).alias("spot"), null("long").alias("batch"), "pairs", "counts", null("binary").alias("sizes"), null("binary").alias("texts"), null("binary").alias("times"))
    dealt = postings.select("stripe", F.pmod(F.xxhash64("batch"), share).cast("int").alias("spot"), "batch", "pairs", null("binary").alias("counts"), "sizes", "texts", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = Block(*sizes), None
        for rows in batches:
            for row in rows.to_pylist():
                if row["batch"] is None:  # the block comes first
                    block.take()
                    own, counted = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["counts"], np.int64)
                    block.add(own, counted)
                    # Row maxima, of the cells in use: pairs are in order, so a row's cells stand together.
                    ids, begins = np.unique(own >> 16, return_index=True)
                    best = np.zeros(len(block.counts), np.int64)
                    best[ids] = np.maximum.reduceat(counted, begins)
                    continue
                pairs, of = np.cumsum(large(row["pairs"])), large(row["sizes"])
                count = block.counts[pairs >> 16, pairs & 0xFFFF]
                top = count == best[pairs >> 16]
                begins, steps = np.cumsum(of) - of, large(row["texts"])
                numbers = np.cumsum(steps)
                numbers -= np.repeat(numbers[begins] - steps[begins], of)
                times = large(row["times"])
                there, at = np.unique(numbers, return_inverse=True)
                n_best, total = np.zeros(len(there), np.int64), np.zeros(len(there), np.int64)
                np.add.at(n_best, at, times * np.repeat(top, of))
                np.add.at(total, at, times * np.repeat(count, of))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), row["batch"]), pa.int64()), pa.array(there, pa.int32()), pa.array(n_best), pa.array(total)], ["batch", "number", "n_best", "count_sum"])

    together = blocks.unionByName(dealt).repartition("stripe", "spot").sortWithinPartitions("stripe", "spot", F.col("batch").asc_nulls_first())
    found = together.mapInArrow(tidy(run), "batch long, number int, n_best long, count_sum long")
    return found.groupBy("batch", "number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text; other columns play no part).

    first is a byte-level vocabulary of whose names both files exist, second a model whose pieces stay within words. Null and empty texts, and those of which
    either tokenizer loses something, have zeros and an empty digest. A text's added-token strings are plain text. Repeated rows count as documents
    of their own; null ids are documents like others. Empty table: no rows.
    """
    written = aligned(docs, first, second)
    counts = cut(pair_counts(written, first, second))
    own = written.where("number IS NOT NULL").select("batch", "number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = own.join(scores(written, counts, first, second), ["batch", "number"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def pairs_of(counts: DataFrame) -> DataFrame:
    """The counts of pair_counts() as rows: a, b, documents, best (whether it is a's greatest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, pairs, many in zip(batch.column("stripe").to_pylist(), batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                pairs, many = np.frombuffer(pairs, np.int64), np.frombuffer(many, np.int64)
                best = np.zeros(int((pairs >> 16).max()) + 1, np.int64)
                np.maximum.at(best, pairs >> 16, many)
                a = (pairs >> 16) * STRIPES + stripe
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(pairs & 0xFFFF), pa.array(many), pa.array(many == best[pairs >> 16])], ["a", "b", "documents", "best"])

    return counts.mapInArrow(run, "a long, b long, documents long, best boolean")
