"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

At every position the automaton's output links list the pieces that end there; each relaxes the best score with the one at its
beginning. Pieces hold the word mark only at their beginning or alone, and some characters are in no piece, so texts fall
into chunks whose best segmentations don't depend on each other. A batch's distinct chunks are looked up among those solved before, as words
come again, and the others are solved side by side: the automaton is held in arrays, and a step takes the next character of all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Chunks and ids remembered by a worker (those of the chunks looked up at once always are).
MEMO, MEMO_IDS = 400_000, 8 << 20
#: Characters of the longest chunk that is solved beside others, chunks solved side by side, chunks looked up at once, rows and bytes of text of a batch (a longer text is a batch of its own).
LONG, LANES, WINDOW, BATCH, BATCH_BYTES = 64, 8_192, 1 << 19, 500, 4 << 20


class Tables:
    """The automaton in arrays. A node is a piece's beginning, numbered by length, the root 0; a character's code is 0 if it is in no piece."""

    def __init__(self, scores: dict[str, tuple[float, int]]):
        code = {c: i for i, c in enumerate(sorted(set("".join(scores))), 1)}
        nodes = ["", *sorted({p[:k] for p in scores for k in range(1, len(p) + 1)}, key=len)]
        at = {p: i for i, p in enumerate(nodes)}
        self.codes = np.zeros(0x110000, np.int32)
        for c, i in code.items():
            self.codes[ord(c)] = i
        self.codes[ord(" ")] = self.codes[ord(MARK)]  # texts come with spaces for marks
        self.width = len(code) + 1
        #: Whether a character is a piece by itself, by code.
        self.alone = np.array([False, *(c in scores for c in sorted(code))])
        #: The longest node that a node ends with; the longest piece that it ends with, itself or not; the next shorter piece. 0: none.
        fail, ending, shorter = ([0] * len(nodes) for _ in range(3))
        for i, p in enumerate(nodes[1:], 1):
            fail[i] = next(at[p[k:]] for k in range(1, len(p) + 1) if p[k:] in at)
            shorter[i] = ending[fail[i]]
            ending[i] = i if p in scores else shorter[i]
        self.fail, self.ending, self.shorter = np.array(fail), np.array(ending), np.array(shorter)
        self.depth = np.array([len(p) for p in nodes])
        self.score, self.ids = np.array([scores.get(p, (0.0, -1))[0] for p in nodes]), np.array([scores.get(p, (0.0, -1))[1] for p in nodes], np.int32)
        self.root = np.zeros(self.width, np.int64)
        for p in nodes[1:]:
            if len(p) == 1:
                self.root[code[p]] = at[p]
        # Ways from node to node lie in a hash table, by node and code in one number.
        ways = np.array([(at[p[:-1]] * self.width + code[p[-1]], at[p]) for p in nodes if len(p) > 1], np.int64).reshape(-1, 2)
        self.bits = max(4, int(4 * len(ways)).bit_length())
        self.ways, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        place = self._place(ways[:, 0])
        while len(ways):
            free = self.ways[place] < 0
            self.ways[place[free]] = ways[free, 0]
            mine = self.ways[place] == ways[:, 0]
            self.to[place[mine]] = ways[mine, 1]
            ways, place = ways[~mine], (place[~mine] + 1) % len(self.ways)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes after one more character: along fail links until there is a way."""
        out = self.root[code]
        on = np.flatnonzero((state > 0) & (code > 0))
        state, code = state[on], code[on]
        while len(on):
            key = state * self.width + code
            at = self._place(key)
            found = self.ways[at]
            other = np.flatnonzero((found != key) & (found >= 0))
            while len(other):
                at[other] = (at[other] + 1) % len(self.ways)
                found[other] = self.ways[at[other]]
                other = other[(found[other] != key[other]) & (found[other] >= 0)]
            hit = found == key
            out[on[hit]] = self.to[at[hit]]
            state = self.fail[state]
            more = np.flatnonzero(~hit & (state > 0))
            on, state, code = on[more], state[more], code[more]
        return out


def put(whole: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """whole with more from at on, twice as long if there was no room."""
    if at + len(more) > len(whole):
        whole = np.append(whole[:at], np.zeros(at + 2 * len(more), whole.dtype))
    whole[at : at + len(more)] = more
    return whole


class Memo:
    """Chunks solved: where each is in the arrays that hold numbers of ids, scores and numbers of byte pieces, and where its ids begin, in bytes."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}
        self.ids, self.n_ids, self.scores, self.n_bytes, self.begins = (np.zeros(1, kind) for kind in (np.int32, np.int64, np.float64, np.int64, np.int64))

    def add(self, chunks: list[bytes], ids: np.ndarray, n_ids: np.ndarray, scores: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """Where these chunks are now."""
        at, first = len(self.slots), int(self.begins[len(self.slots)])
        self.ids = put(self.ids, first // 4, ids)
        self.n_ids, self.scores, self.n_bytes = put(self.n_ids, at, n_ids), put(self.scores, at, scores), put(self.n_bytes, at, n_bytes)
        self.begins = put(self.begins, at + 1, first + 4 * np.cumsum(n_ids))
        self.slots.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        return np.arange(at, len(self.slots))

    def ids_of(self, where: np.ndarray) -> np.ndarray:
        """The ids of these chunks, one after the other."""
        whole = pa.Array.from_buffers(pa.large_binary(), len(self.slots), [None, pa.py_buffer(self.begins), pa.py_buffer(self.ids)])
        return np.frombuffer(whole.take(pa.array(where)).buffers()[2], np.int32)[: int(self.n_ids[where].sum())]


class Pieces:
    """A model's pieces and scores. A character in no piece costs the lowest score less 10 and becomes its UTF-8 bytes."""

    def __init__(self, name: str = MODEL):
        import ahocorasick
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.texts: list[bytes] = []
        self.bytes: dict[int, int] = {}
        self.scores: dict[str, tuple[float, int]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.texts.append(b"")
            else:
                self.texts.append(piece.replace(MARK, " ").encode())
                self.scores[piece] = (model.get_score(i), i)
                # Chunks are solved apart, which is right only if no piece goes on over the beginning of a word.
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"{name} has the piece {piece!r}, which goes on over the beginning of a word")
        self.unknown = min(s for s, _ in self.scores.values() if s > -1e8) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.lines = "\n" not in set("".join(self.scores))
        self.byte_ids = np.array([self.bytes.get(b, -1) for b in range(256)], np.int32)
        self.entries, self.nothing = pa.array([*self.texts, b""], pa.binary()), len(self.texts)
        self.memo = Memo()

    @cached_property
    def tables(self) -> Tables:
        return Tables(self.scores)

    def chunk(self, text: str) -> tuple[bytes, float, int]:
        """Ids as 32-bit numbers, score and number of byte pieces. Of equally good segmentations the one with the longer last piece, from the end on."""
        n = len(text)
        best = [-float("inf")] * (n + 1)
        last: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0], at = 0.0, 0  # best[: at + 1] is final
        for end, (size, score, i) in self.automaton.iter(text):
            while at < end:  # positions that the automaton has passed
                at += 1
                self._unknown(text, at, best, last)
            value = best[end + 1 - size] + score
            if value > best[end + 1] or value == best[end + 1] and size > last[end + 1][0]:
                best[end + 1], last[end + 1] = value, (size, i)
        while at < n:
            at += 1
            self._unknown(text, at, best, last)
        ids: list[int] = []
        n_bytes, k = 0, n
        while k:
            size, i = last[k]
            if i >= 0:
                ids.append(i)
            else:
                raw = text[k - 1].encode()
                ids.extend(self.bytes[b] for b in reversed(raw))
                n_bytes += len(raw)
            k -= size
        return np.array(ids[::-1], np.int32).tobytes(), best[n], n_bytes

    def _unknown(self, text, at, best, last):
        if text[at - 1] not in self.scores and best[at - 1] + self.unknown > best[at]:
            best[at], last[at] = best[at - 1] + self.unknown, (1, -1)

    def solve(self, chunks: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """These chunks, in UTF-8 with spaces for marks, short ones side by side: the order they were solved in and, in that order, their ids, numbers of ids, scores and numbers of byte pieces."""
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        n_chars = np.diff(np.cumsum((raw & 0xC0) != 0x80)[ends - 1], prepend=0)
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        begins = np.cumsum(n_chars) - n_chars
        order = np.argsort(-n_chars, kind="stable")
        long = int((n_chars > LONG).sum())
        alone = [self.chunk(chunks[k].decode().replace(" ", MARK)) for k in order[:long].tolist()]
        out = [(np.frombuffer(ids, np.int32), [len(ids) // 4], [score], [n_bytes]) for ids, score, n_bytes in alone]
        for at in range(long, len(order), LANES):
            lanes = order[at : at + LANES]
            out.append(self._side_by_side(chars, begins[lanes], n_chars[lanes]))
        return order.tolist(), *(np.concatenate(x) for x in zip(*out, strict=True))

    def _side_by_side(self, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that begin at begins in chars, of falling sizes; positions are rows of the arrays, chunks their columns."""
        t, width, deep = self.tables, len(begins), int(sizes[0])
        best = np.zeros((deep + 1, width))
        size, ids = np.zeros((deep + 1, width), np.int32), np.full((deep + 1, width), -1, np.int32)
        flat, state = best.reshape(-1), np.zeros(width, np.int64)
        many = np.searchsorted(-sizes, -np.arange(deep), "left")  # chunks that have a character there
        for k in range(deep):
            m = int(many[k])
            code = t.codes[chars[begins[:m] + k]]
            state = t.step(state[:m], code)
            value, by, of = np.full(m, -np.inf), np.zeros(m, np.int32), np.full(m, -1, np.int32)
            # Pieces that end here, the longest first: a shorter one has to be better.
            node = t.ending[state]
            on = np.flatnonzero(node)
            node = node[on]
            while len(on):
                n = t.depth[node]
                reached = flat[(k + 1 - n) * width + on] + t.score[node]
                better = np.flatnonzero(reached > value[on])
                there = on[better]
                value[there], by[there], of[there] = reached[better], n[better], t.ids[node[better]]
                node = t.shorter[node]
                more = np.flatnonzero(node)
                on, node = on[more], node[more]
            reached = best[k, :m] + self.unknown
            there = np.flatnonzero(~t.alone[code] & (reached > value))
            value[there], by[there], of[there] = reached[there], 1, -1
            best[k + 1, :m], size[k + 1, :m], ids[k + 1, :m] = value, by, of
        ends, at, lane = np.zeros((width, deep + 1), bool), sizes.copy(), np.arange(width)
        while len(lane):
            ends[lane, at] = True
            at = at - size[at, lane]
            more = np.flatnonzero(at)
            at, lane = at[more], lane[more]
        lane, at = np.nonzero(ends)
        found = ids[at, lane]
        unknown = np.flatnonzero(found < 0)
        n_ids, n_bytes = np.bincount(lane, minlength=width), np.zeros(width, np.int64)
        if len(unknown):
            # A character in no piece becomes its bytes.
            some = chars[begins[lane[unknown]] + at[unknown] - 1]
            times = np.ones(len(found), np.int64)
            times[unknown] += (some > 0x7F).astype(np.int64) + (some > 0x7FF) + (some > 0xFFFF)
            found, lane = np.repeat(found, times), np.repeat(lane, times)
            unknown = np.flatnonzero(found < 0)
            found[unknown] = self.byte_ids[np.frombuffer(some.tobytes().decode("utf-32-le").encode(), np.uint8)]
            if (found < 0).any():
                raise ValueError("the model has no piece for a byte")
            n_ids, n_bytes = np.bincount(lane, minlength=width), np.bincount(lane[unknown], minlength=width)
        return found, n_ids, best[sizes, np.arange(width)], n_bytes

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and for each text how many they are, its score and number of byte pieces. A mark is put before each; null or empty: none."""
        raw = [f" {t.replace(MARK, ' ')}".encode() if t else b"" for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        data = b"".join(raw)
        if not data:
            return np.zeros(0, np.int32), *(np.zeros(len(texts), kind) for kind in (np.int64, np.float64, np.int64))
        # A chunk begins with a text, a run of marks, a line end in no piece, and after that.
        byte = np.frombuffer(data, np.uint8)
        mark = byte == ord(" ")
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        if self.lines:
            line = byte == ord("\n")
            first |= line
            first[1:] |= line[:-1]
        first[np.append(0, ends[ends < len(data)])] = True
        begins = np.flatnonzero(first)
        row = np.searchsorted(ends, begins, "right")
        offsets, buffer = np.append(begins, len(data)).astype(np.int32), pa.py_buffer(data)
        found, n_ids, scores, n_bytes = [], *(np.zeros(len(texts)) for _ in range(3))
        for at in range(0, len(begins), WINDOW):
            here = row[at : at + WINDOW]
            chunks = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(offsets[at : at + WINDOW + 1]), buffer]).dictionary_encode()
            where = self._solved(chunks.dictionary)[chunks.indices.to_numpy()]
            memo = self.memo
            found.append(memo.ids_of(where))
            n_ids += np.bincount(here, memo.n_ids[where], len(texts))
            scores += np.bincount(here, memo.scores[where], len(texts))
            n_bytes += np.bincount(here, memo.n_bytes[where], len(texts))
        return np.concatenate(found), n_ids.astype(np.int64), scores, n_bytes.astype(np.int64)

    def _solved(self, chunks: pa.BinaryArray) -> np.ndarray:
        """Where in the memory each of these distinct chunks is; those not there are solved."""
        data, offsets = chunks.buffers()[2].to_pybytes(), np.frombuffer(chunks.buffers()[1], np.int32)[: len(chunks) + 1].tolist()
        keys = [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        where = np.fromiter((self.memo.slots.get(k, -1) for k in keys), np.int64, len(keys))
        fresh = np.flatnonzero(where < 0)
        if len(self.memo.slots) + len(fresh) > MEMO or self.memo.begins[len(self.memo.slots)] > 4 * MEMO_IDS:
            self.memo, fresh = Memo(), np.arange(len(keys))
        if len(fresh):
            some = [keys[k] for k in fresh.tolist()]
            order, *found = self.solve(some)
            where[fresh[order]] = self.memo.add([some[k] for k in order], *found)
        return where

    def encode(self, text: str | None) -> tuple[np.ndarray, float, int]:
        """Ids, score and number of byte pieces of a whole text; a mark is put before it. Null or empty: none."""
        ids, _, score, n_bytes = self.encode_all([text])
        return ids, float(score[0]), int(n_bytes[0])

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids that lie one after the other and end at ends: pieces joined, marks as spaces, without the one put before the text. Ids out of range and control pieces give nothing."""
        joined = self.entries.take(pa.array(np.where((ids >= 0) & (ids < len(self.texts)), ids, self.nothing)))
        offsets, data = np.frombuffer(joined.buffers()[1], np.int32), memoryview(joined.buffers()[2] or b"")
        to = offsets[ends].tolist()
        return [str(data[a:b], "utf-8", "replace").removeprefix(" ") for a, b in zip([0, *to], to, strict=False)]

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(maxsize=2)
def pieces(name: str = MODEL) -> Pieces:
    return Pieces(name)


def parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows, BATCH or BATCH_BYTES of this column (texts or lists of ids) at a time."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            room = BATCH_BYTES + (int(ends[at - 1]) if at else 0)
            to = max(at + 1, min(at + BATCH, int(np.searchsorted(ends, room, "right"))))
            yield batch.slice(at, to - at)
            at = to


def encode(docs: DataFrame, name: str = MODEL, text: str = "text") -> DataFrame:
    """doc_id, ids, n_byte_pieces and score for each row of docs. Null or empty text: no ids, score 0. Empty table: no rows.

    Texts of any length are encoded whole, chunk by chunk. Of equally good segmentations the one with the longer last piece is taken, from the end on.
    Repeated rows are encoded each, null ids like others; other columns play no part, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for part in parts(batches, "text"):
            ids, n, scores, n_bytes = model.encode_all(part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(n_bytes), pa.array(scores)], ["doc_id", "ids", "n_byte_pieces", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_byte_pieces long, score double")


def decode(encoded: DataFrame, name: str = MODEL) -> DataFrame:
    """The columns of encode() with the text instead of nothing: doc_id, ids, n_byte_pieces, score, text. Null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for part in parts(batches, "ids"):
            ids = part.column("ids")
            ends = np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))
            texts = model.decode_all(ids.flatten().fill_null(-1).to_numpy(), ends)
            texts = pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "ids", "n_byte_pieces", "score")), texts], ["doc_id", "ids", "n_byte_pieces", "score", "text"])

    return encoded.select("doc_id", "ids", "n_byte_pieces", "score").mapInArrow(run, "doc_id long, ids array<int>, n_byte_pieces long, score double, text string")


def op9(docs: DataFrame) -> DataFrame:
    """Every text encoded, and decoded again: digests of both ways. Nulls, empty and very long texts, ties, repeated rows and other columns as encode() has them; null texts decode as empty."""
    out = decode(encode(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [zlib.crc32(v.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) for v in batch.column("ids")]
            n = [len(v) for v in batch.column("ids")]
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("n_byte_pieces"), batch.column("score"), pa.array(crcs, pa.int64()), pa.array([zlib.crc32(t.as_py().encode()) for t in text], pa.int64())],
                ["doc_id", "n_pieces", "n_byte_pieces", "score", "ids_crc32", "decoded_crc32"],
            )

    return out.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, decoded_crc32 long")
