"""Removal of long repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

Which strings of LENGTH bytes repeat is found in shards that hold every string which may repeat elsewhere in the corpus:

1. Each string has an anchor, its K-byte gram of least hash (leftmost at ties), so equal strings have equal anchors. Runs of
   consecutive strings with one anchor are a unit. Units travel as (anchor, digest of their bytes, place), without bytes. Within a block
   of text, which has the bytes at hand, units of one digest are compared with the first of them, and equal ones are repeats.
2. Units of one anchor meet in one bucket. Where there are several, equal or not, all are fetched with their bytes and go to one shard.
3. A shard's suffixes are sorted as far as LENGTH asks; breadth-first backward extension then derives the common prefixes of
   neighbouring suffixes by increasing value, from the empty string on, stopping at LENGTH: neighbours without a value by then
   share LENGTH bytes. Of each such class all places but the first are repeats.

Hashes only bring together what may be equal: no byte is removed but by a class of step 3 or a comparison of bytes.

Shards are cut at anchors and bounded in bytes. Strings of a hot anchor, one with more than HOT units, more than HOT_HERE differing ones
in one block of text or about FREQUENT in all blocks, meet by 128-bit digests instead: each task sends the first of equal ones alone and names the others at
once, and in the sorted rows of a digest all that equal the first one, byte by byte, are repeats, so that no key gathers more than a row from
each task's HELD strings. Units of an anchor that is hot in a block or in all blocks are dealt by their digests, not by their anchor.
Which anchors are frequent in all blocks is told by every LOOKED-th document; this decides on the way that units take and never on a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytesets import BASE, mix, utf8
from .frames import cut, partitions, tidy

LENGTH = 100
K = 32
WINDOW = LENGTH - K + 1
#: Positions are taken in pieces of at most so many, so that one fits in the low bits beside a hash.
_PLACE_BITS = 20
PIECE = 1 << _PLACE_BITS
#: Text that a mapper takes together, and bytes of units that make a shard.
BLOCK, SHARD = 1 << 24, 1 << 20
HOT = 10_000
#: Differing units of an anchor within a block that make it hot, and strings of hot anchors that a task tells apart together.
HOT_HERE, HELD = 512, 1 << 18
#: Units of an anchor in all blocks together that make it hot, and the share of documents (one in so many) that are looked at for it.
FREQUENT, LOOKED = 1 << 20, 64
#: Text of a partition in which texts meet what was found in them.
PARTITION = 1 << 28
NULL_ID = -(2**63)


# Anchors


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on."""
    n = len(x) - K + 1
    wide = x.astype(np.uint64)
    for step in (1, 2, 4):
        wide = wide[:-step] | wide[step:] << np.uint64(8 * step)
    out = np.zeros(n, np.uint64)
    for k in range(0, K, 8):
        out ^= wide[k : k + n]
        out *= BASE
        out ^= out >> np.uint64(29)
    return mix(out)


def units(flat: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Units of all rows: anchor, digest, row, pos (first string's start in its row), n (strings)."""
    parts = []
    at = 0
    while at < len(off) - 1:  # rows in runs of up to PIECE bytes; a longer row by itself, in overlapping pieces
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, "right")) - 1)
        begin, end = int(off[at]), int(off[to])
        if end - begin <= PIECE:
            parts.append(_units(flat[begin:end], off[at : to + 1] - begin, np.arange(at, to), 0))
        else:
            for a in range(begin, max(begin + 1, end - LENGTH + 1), PIECE - LENGTH + 1):
                b = min(end, a + PIECE)
                parts.append(_units(flat[a:b], np.array([0, b - a]), np.array([at]), a - begin))
        at = to
    names = ("anchor", "digest", "row", "pos", "n")
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return {k: np.concatenate([*(p[i] for p in parts if p), np.zeros(0, kind)]) for i, (k, kind) in enumerate(zip(names, kinds, strict=True))}


def _units(x: np.ndarray, off: np.ndarray, rows: np.ndarray, shift: int):
    if len(x) < LENGTH:
        return None
    h = gram_hashes(x)
    low = np.uint64(PIECE - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    n_strings = len(x) - LENGTH + 1
    at = (least[:n_strings] & low).astype(np.int64)
    inside = np.zeros(n_strings, bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            inside[a : b - LENGTH + 1] = True
    change = np.ones(n_strings, bool)
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    first_of = np.zeros(n_strings, bool)
    starts = off[:-1][off[:-1] < n_strings]
    first_of[starts] = True
    heads = np.flatnonzero((change | first_of) & inside)
    if not len(heads):
        return None
    stops = np.flatnonzero(np.concatenate([(change | first_of)[1:], [True]]) & inside) + 1
    n = stops - heads
    tail = heads + n - 1 + LENGTH - K
    digest = (n.astype(np.uint64) << np.uint64(32)) + (at[heads] - heads).astype(np.uint64)
    for k in range(0, WINDOW + LENGTH - K, K):
        digest = mix(digest * BASE + h[np.minimum(heads + k, tail)])
    digest = mix(digest * BASE + h[tail])
    row = np.searchsorted(off, heads, "right") - 1
    return h[at[heads]], digest, rows[row], heads - off[row] + shift, n


#: What travels of a unit; its digest has done its work within the block. A place is below 2 GB, the most that a row's text can have.
_BLOBS = ("anchor", "doc", "text_hash", "pos", "n")
_KINDS = {"anchor": np.uint64, "digest": np.uint64, "doc": np.int64, "text_hash": np.int64, "pos": np.int32, "n": np.int16}
_REPEATS = ("doc", "text_hash", "pos", "n")


def _firsts(u: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by anchor, digest where units have one, and place, and which in that order are the first of equal units, or of those of an anchor. A place that repeated rows name again is left out."""
    content = [k for k in ("anchor", "digest") if k in u]
    keys = [*content, "doc", "text_hash", "pos"]
    order = np.lexsort([u[k] for k in keys[::-1]])
    own = np.ones(len(order), bool)
    own[1:] = False
    for k in keys:
        own[1:] |= u[k][order[1:]] != u[k][order[:-1]]
    order = order[own]
    first = np.ones(len(order), bool)
    first[1:] = False
    for k in content:
        first[1:] |= u[k][order[1:]] != u[k][order[:-1]]
    return order, first


def same_bytes(flat: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, asked: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Whether the `sizes` bytes from place one and from place two on are equal, for what is asked."""
    out = np.zeros(len(one), bool)
    which = np.flatnonzero(asked)
    ends = np.cumsum(sizes[which])
    at = 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        here = which[at:to]
        heads = np.cumsum(sizes[here]) - sizes[here]
        step = np.arange(int(sizes[here].sum())) - np.repeat(heads, sizes[here])
        equal = flat[step + np.repeat(one[here], sizes[here])] == flat[step + np.repeat(two[here], sizes[here])]
        out[here] = np.logical_and.reduceat(equal, heads)
        at = to
    return out


def frequent_anchors(docs: DataFrame, least: int, one_of: int) -> np.ndarray:
    """Anchors of about `least` units or more, by a look at one document in `one_of`; sorted.

    An anchor with few differing units in each block needs many documents to get so many, so its share of those looked at is close to its share of all. All bytes
    over `least` bounds how many there can be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(*utf8(batch.column("text")))
            order = np.lexsort((u["digest"], u["anchor"]))
            anchor, digest = u["anchor"][order], u["digest"][order]
            differs = np.ones(len(order), bool)
            differs[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
            found, n = np.unique(anchor[differs], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    looked = docs.where(F.pmod(F.xxhash64("doc", "text_hash"), F.lit(one_of)) == 0)
    counted = looked.mapInArrow(tidy(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") * one_of >= least).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(np.uint64))


def dealt(docs: DataFrame, buckets: int, frequent: np.ndarray | None = None) -> DataFrame:
    """The units of each block of text, by bucket of their anchors, as blobs. Repeats within a block are told apart at once, so
    that a group of copies sends one unit for each block. An anchor with over HOT_HERE differing units in the block has them in the
    buckets below 0, by digest, and its own bucket is told so (common). So have the frequent anchors, of which no bucket is told, as all blocks have them there.
    """
    sent = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)
    schema = "bucket int, common binary, " + ", ".join(f"{k} binary" for k in _BLOBS) + ", " + ", ".join(f"again_{k} binary" for k in _REPEATS)

    def rows(held: list[dict[str, np.ndarray]], flat: np.ndarray) -> pa.RecordBatch:
        u = {k: np.concatenate([h[k] for h in held]) for k in (*_BLOBS, "digest", "at")}
        order, first = _firsts({k: u[k] for k in ("anchor", "digest", *_REPEATS)})
        head = order[first][np.cumsum(first) - 1]
        sure = same_bytes(flat, u["at"][order], u["at"][head], u["n"][order] + LENGTH - 1, ~first) & ~first
        keep, again = np.sort(order[~sure]), order[sure]
        anchors = u["anchor"][order[first]]
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(anchors)), bool), anchors[1:] != anchors[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(anchors)]]))
        known = np.isin(anchors[heads], sent.value) if sent else np.zeros(len(heads), bool)
        common = np.sort(anchors[heads[(sizes > HOT_HERE) & ~known]])
        spread = np.zeros(len(u["anchor"]), bool)
        spread[order] = np.repeat((sizes > HOT_HERE) | known, sizes)[np.cumsum(first) - 1]
        of = np.where(spread, np.uint64(buckets) + u["digest"] % np.uint64(buckets), u["anchor"] % np.uint64(buckets)).astype(np.int64)
        out: dict[str, list] = {name: [] for name in ("bucket", "common", *_BLOBS, *(f"again_{k}" for k in _REPEATS))}
        keep, again = keep[np.argsort(of[keep], kind="stable")], again[np.argsort(of[again], kind="stable")]
        told = (common % np.uint64(buckets)).astype(np.int64)
        used = np.unique(np.concatenate([of[keep], told]))  # what repeats has its first in the same bucket
        values = {k: u[k][keep].astype(_KINDS[k]) for k in _BLOBS}
        repeats = {k: u[k][again].astype(_KINDS[k]) for k in _REPEATS}
        cuts, again_cuts = ([np.searchsorted(of[x], used, side) for side in ("left", "right")] for x in (keep, again))
        for i, b in enumerate(used.tolist()):
            out["bucket"].append(b if b < buckets else buckets - 1 - b)
            out["common"].append(common[told == b].tobytes() if len(common) and b < buckets else b"")
            for k in _BLOBS:
                out[k].append(values[k][cuts[0][i] : cuts[1][i]].tobytes())
            for k in _REPEATS:
                out[f"again_{k}"].append(repeats[k][again_cuts[0][i] : again_cuts[1][i]].tobytes())
        kinds = [pa.int32(), *[pa.binary()] * (len(out) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for batch in batches:
            flat, off = utf8(batch.column("text"))
            ids, hashes = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
            u = units(flat, off)
            held.append({"anchor": u["anchor"], "digest": u["digest"], "doc": ids[u["row"]], "text_hash": hashes[u["row"]], "pos": u["pos"], "n": u["n"], "at": size + off[u["row"]] + u["pos"]})
            texts.append(flat)
            size += len(flat)
            if size >= BLOCK:
                yield rows(held, np.concatenate(texts))
                held, texts, size = [], [], 0
        if held:
            yield rows(held, np.concatenate(texts))

    return docs.mapInArrow(tidy(run), schema)


def judged(blobs: DataFrame) -> DataFrame:
    """doc, text_hash, pos, n, and the anchor where the unit's bytes must be looked at, as another unit has that anchor; without an anchor the unit
    is a repeat. hot: its anchor has more than HOT units, more than HOT_HERE differing ones in some block, or is frequent."""

    def run(group: pa.Table) -> pa.Table:
        u = {k: np.frombuffer(b"".join(group.column(k).to_pylist()), _KINDS[k]) for k in _BLOBS}
        order, new = _firsts(u)
        anchor = u["anchor"][order]
        of = np.cumsum(new) - 1
        together = np.bincount(of)[of] if len(of) else of
        common = np.isin(anchor, np.frombuffer(b"".join(group.column("common").to_pylist()), np.uint64)) | (group.column("bucket")[0].as_py() < 0)
        look = (together > 1) | common
        again = {k: np.frombuffer(b"".join(group.column(f"again_{k}").to_pylist()), _KINDS[k]) for k in _REPEATS}
        n_again = len(again["doc"])
        anchors = np.concatenate([np.zeros(n_again, np.int64), anchor[look].view(np.int64)])
        hot = np.concatenate([np.zeros(n_again, bool), (together[look] > HOT) | common[look]])
        places = {k: pa.array(np.concatenate([again[k], u[k][order[look]]]).astype(np.int64)) for k in _REPEATS}
        return pa.table({**places, "anchor": pa.array(anchors, mask=np.arange(len(anchors)) < n_again), "hot": pa.array(hot)})

    return blobs.groupBy("bucket").applyInArrow(run, "doc long, text_hash long, pos long, n long, anchor long, hot boolean")


# Shards


def _ordered(key: np.ndarray, wide: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their keys of `wide` bits, and where in it a key differs from the one before. Where both fit in 64 bits the places are sorted
    along below the keys, which is several times as fast as an argsort."""
    if wide + bits <= 64:
        both = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
        order, sorted_ = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        order = np.argsort(key)
        sorted_ = key[order]
    differs = np.ones(len(key), bool)
    differs[1:] = sorted_[1:] != sorted_[:-1]
    return order, differs


def suffix_order(t: np.ndarray, depth: int, begin: int = 1) -> tuple[np.ndarray, int, np.ndarray]:
    """Places of t in the order of their first `depth` symbols at least (symbols below 512, 0 ends a text); those that have more symbols in common come in any order.
    Ranks of parts that follow each other make the next key. And ranks of places by their first symbols, with how many these are: the most that sorting
    has ranked on its way, up to `begin`.
    """
    n = len(t)
    bits = n.bit_length()
    there = np.bincount(t, minlength=1) > 0
    there[0] = True  # 0 stays the least symbol
    wide = max(1, int(there.sum() - 1).bit_length())
    done = max(1, min(depth, (64 - bits) // wide))
    padded = np.concatenate([(np.cumsum(there) - 1).astype(np.uint64)[t], np.zeros(done, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(done):
        key <<= np.uint64(wide)
        key |= padded[k : k + n]
    wide *= done
    ranked, ranks = 1, t
    while True:
        order, differs = _ordered(key, wide, bits)
        if done >= depth and done > begin:
            return order, ranked, ranks
        rank = np.empty(n, np.uint64)
        rank[order] = (np.cumsum(differs) - 1).astype(np.uint64)
        if done <= begin:
            ranked, ranks = done, rank
        if done >= depth or int(rank[order[-1]]) == n - 1:
            return order, ranked, ranks
        key = rank << np.uint64(bits)
        key[: max(0, n - done)] |= rank[done:] + np.uint64(1)
        wide, done = 2 * bits, 2 * done


#: Interval expansion begins with strings of at most so many symbols, as many as suffix sorting has ranked.
BEGIN = 16


def classes(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of t and, for each place in it, a number that neighbours share if they share `length` symbols without a 0 among them.

    Intervals of suffixes that begin with one string are extended backward by a symbol, all strings of one length at a time, from those that suffix sorting has
    ranked on: between these the common prefix is shorter, and intervals of all of them are at hand.
    An interval whose right end has no common prefix yet gives it its value, the length so far, and goes on; others stop.
    Each end is set once, so the intervals handled are no more than the suffixes. Every 0 is a symbol of its own: a suffix with one among
    the symbols ranked is alone from the beginning, and so is whatever it is extended to.
    """
    n = len(t)
    order, begin, ranks = suffix_order(t, length, min(BEGIN, length))
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    head = t[order]
    transform = t[order - 1]  # the symbol before each suffix; before the first text comes the last one's 0
    back = inverse[order - 1]
    stops = np.flatnonzero(t == 0)
    left = np.repeat(np.concatenate([stops, [n]]), np.diff(np.concatenate([[-1], stops, [n - 1]]))) - np.arange(n)  # symbols before the next 0
    left = left[order]
    ended = np.zeros(n + 1, bool)
    ended[0] = ended[n] = True
    begins = left < begin
    ranks = ranks[order]
    begins[0] = True
    begins[1:] |= ranks[1:] != ranks[:-1]
    ended[:n] |= begins
    place = np.flatnonzero(left >= begin)
    interval = (np.cumsum(begins) - 1)[place]
    for _ in range(begin, length):
        keep = transform[place] != 0
        place, interval = back[place[keep]], interval[keep]
        if not len(place):
            break
        if len(place) * 8 > n:
            mark = np.full(n, -1, np.int64)
            mark[place] = interval
            place = np.flatnonzero(mark >= 0)
            interval = mark[place]
        else:
            by = np.argsort(place)
            place, interval = place[by], interval[by]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (interval[1:] != interval[:-1]) | (head[place[1:]] != head[place[:-1]])
        number = np.cumsum(new) - 1
        ends = place[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(place) - 1]])] + 1
        fresh = ~ended[ends]
        ended[ends] = True
        keep = fresh[number]
        place, interval = place[keep], number[keep]
        if not len(place):
            break
    # A string with a 0 is alone. Extension alone doesn't tell that where what follows the 0 is in no certain order.
    short = left < length
    ended[:n] |= short
    ended[1:] |= short
    return order, np.cumsum(ended[:n])


def repeats(texts: list[bytes], doc: np.ndarray, text_hash: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, first start and number of consecutive strings that start earlier too, among the units of a shard. Units of a document have no string in common, so
    with units in the order of documents and places, strings are in that order too.
    """
    by = np.lexsort((pos, text_hash, doc))
    flat = np.frombuffer(b"".join([texts[i] + b"\0" for i in by.tolist()]), np.uint8).astype(np.uint16) + np.uint16(1)
    sizes = np.array([len(x) + 1 for x in texts])[by]
    heads = np.cumsum(sizes) - sizes
    flat[heads + sizes - 1] = 0
    order, number = classes(flat, LENGTH)
    many = np.bincount(number)[number] > 1
    # By class and place; both fit in a long, as there are no more of either than bytes of a shard.
    bits = len(flat).bit_length()
    both = np.sort(number[many] << bits | order[many])
    later = np.zeros(len(both), bool)
    later[1:] = both[1:] >> bits == both[:-1] >> bits
    place = np.sort(both[later] & ((1 << bits) - 1))
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1] + 1  # a unit's end is between its strings and the next one's
    first = np.flatnonzero(new)
    unit = np.searchsorted(heads, place[first], "right") - 1
    return by[unit], place[first] - heads[unit], np.diff(np.concatenate([first, [len(place)]]))


def later_places(key: np.ndarray, second: np.ndarray, places: list[np.ndarray], strings: np.ndarray, before: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Of strings (a row of bytes each) in the order of their digests (key, second) and places: which are first of their digest, which equal its
    first one and lie elsewhere, and digest, bytes and place of the last first one. before: the latter of the rows that came earlier.
    """
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
    if before:
        first[0] = (key[0], second[0]) != before[:2]
    at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))  # -1: goes on from before
    later = np.zeros(len(key), bool)
    for k, x in enumerate(places):
        later |= x != np.where(at >= 0, x[at], before[3 + k] if before else 0)
    equal = (strings == strings[at]).all(1)
    if before and at[0] < 0:
        old = at < 0
        equal[old] = (strings[old] == before[2]).all(1)
    # Should a digest have two strings, the other one is left alone like a first one.
    first |= ~equal
    last = (key[at[-1]], second[at[-1]], strings[at[-1]].copy(), *(x[at[-1]] for x in places)) if at[-1] >= 0 else before
    return first, later & equal, last


def in_shards(rows: DataFrame) -> DataFrame:
    """Repeats among fetched rows, which are in the order of key, second and place: units of one key are together in one shard of about SHARD
    bytes; strings with a digest (key, second) repeat if they equal the first of it; rows without bytes are repeats.
    """

    def shard(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held)
        doc, text_hash, pos, n = (table.column(c).to_numpy() for c in _REPEATS)
        unit, start, count = repeats(table.column("bytes").to_pylist(), doc, text_hash, pos, n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[unit], text_hash[unit], pos[unit] + start, count)], list(_REPEATS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, before = [], 0, None, None
        for batch in batches:
            known, digested = batch.column("bytes").is_null(), pc.invert(batch.column("second").is_null())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(known) for c in _REPEATS], list(_REPEATS))
            strings = batch.filter(digested)
            if strings.num_rows:
                key, second, *places = (strings.column(c).to_numpy() for c in ("key", "second", "doc", "text_hash", "pos"))
                _, later, before = later_places(key, second, places, utf8(strings.column("bytes"))[0].reshape(-1, LENGTH), before)
                yield pa.RecordBatch.from_arrays([strings.column(c).filter(pa.array(later)) for c in _REPEATS], list(_REPEATS))
            batch = batch.filter(pc.invert(pc.or_(known, digested)))
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            _, off = utf8(batch.column("bytes"))
            ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1  # a shard may end here
            at = 0
            if held and keys[0] != last and size >= SHARD:
                yield from shard(held)
                held, size = [], 0
            for to in ends.tolist():
                if size + off[to] - off[at] >= SHARD and to < len(keys):
                    held.append(pa.Table.from_batches([batch.slice(at, to - at)]))
                    yield from shard(held)
                    held, size, at = [], 0, to
            held.append(pa.Table.from_batches([batch.slice(at)]))
            size += int(off[-1] - off[at])
            last = keys[-1]
        if held:
            yield from shard(held)

    return rows.mapInArrow(tidy(run), "doc long, text_hash long, pos long, n long")


def fetched(rows: DataFrame) -> DataFrame:
    """The bytes of the units listed with each text, with their anchor as key. Of hot anchors each string by itself, its digest as key and
    second; of equal strings that a task holds together only the first, and the others as repeats, without bytes.
    """
    names = ("key", "second", *_REPEATS, "bytes")

    def told_apart(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, second, *places, strings = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((*places[::-1], second, key))
        first, later, _ = later_places(key[by], second[by], [x[by] for x in places], strings[by])
        one = by[first]
        texts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(one), [None, pa.py_buffer(strings[one].tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[one], second[one], *(x[one] for x in places), np.ones(len(one), np.int64))] + [texts], list(names))
        doc, text_hash, pos = (x[by[later]] for x in places)
        by = np.lexsort((pos, text_hash, doc))
        doc, text_hash, pos = doc[by], text_hash[by], pos[by]
        new = np.ones(len(by), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (pos[1:] > pos[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:] - 1, [len(by) - 1]]) if len(by) else head
        key = mix(text_hash[head].view(np.uint64) ^ mix(pos[head].view(np.uint64))).view(np.int64)
        columns = [pa.array(key), pa.nulls(len(key), pa.int64()), *(pa.array(x) for x in (doc[head], text_hash[head], pos[head], pos[tail] - pos[head] + 1)), pa.nulls(len(key), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            flat, off = utf8(batch.column("text"))
            column = batch.column("units")
            entries = column.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            key, pos, n = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "pos", "n"))
            hot = entries.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            raw = flat.tobytes()
            ids, hashes = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
            begin = off[row] + pos
            for unit in np.flatnonzero(hot).tolist():
                a, times = int(begin[unit]), int(n[unit])
                digests = b"".join([hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in range(a, a + times)])
                pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
                strings = np.lib.stride_tricks.sliding_window_view(flat[a : a + times + LENGTH - 1], LENGTH)
                held.append((pair[:, 0], pair[:, 1], np.full(times, ids[row[unit]]), np.full(times, hashes[row[unit]]), pos[unit] + np.arange(times), strings))
                size += times
                if size >= HELD:
                    yield from told_apart(held)
                    held, size = [], 0
            cold = np.flatnonzero(~hot)
            texts = [raw[a : a + s] for a, s in zip(begin[cold].tolist(), (n[cold] + LENGTH - 1).tolist(), strict=True)]
            row, key, pos, n = row[cold], key[cold], pos[cold], n[cold]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), pa.int64()), *(pa.array(x) for x in (ids[row], hashes[row], pos, n)), pa.array(texts, pa.binary())], list(names))
        if held:
            yield from told_apart(held)

    return rows.mapInArrow(tidy(run), "key long, second long, doc long, text_hash long, pos long, n long, bytes binary")


def spans_of(pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that strings starting at pos .. pos + n - 1 cover."""
    if not len(pos):
        return pos, pos
    by = np.argsort(pos, kind="stable")
    begin, end = pos[by], np.maximum.accumulate(pos[by] + n[by] - 1 + LENGTH)
    new = np.ones(len(by), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.concatenate([first[1:] - 1, [len(by) - 1]])]


def remove(docs: DataFrame, text: str = "text", beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end) and kept (the remaining bytes), for each row of docs; the
    columns named in `beside` come along in a struct of that name, whatever they are called. Other columns of docs play no part.

    Null text is empty: nothing removed, digest of the empty string. Texts shorter than LENGTH bytes stay whole, very long ones are taken in
    overlapping pieces. A null id comes before
    all others. Rows with one id but different texts are different documents, in the order of a hash of the text; rows equal in both
    are the same document and get the same result. Empty table: no rows.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    along = [F.struct(*beside).alias("beside")] if beside else []
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *along,
    )
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = count * max(1, min(4, -(-total // (count << 22))), -(-total // (count << 25)))
    plain = keyed.select("doc", "text_hash", "text")
    verdicts = cut(judged(dealt(plain, buckets, frequent_anchors(plain, FREQUENT, LOOKED))), clear=True)
    count = max(count, -(-total // PARTITION))
    texts = keyed.repartition(count, "doc", "text_hash")
    look = verdicts.where("anchor IS NOT NULL").groupBy("doc", "text_hash").agg(F.collect_list(F.struct("anchor", "pos", "n", "hot")).alias("units"))
    again = verdicts.where("anchor IS NULL").groupBy("doc", "text_hash").agg(F.collect_list(F.struct("pos", "n")).alias("whole"))
    # Both joins read the texts with the same columns, so that they are shuffled once.
    found = fetched(texts.join(look.hint("shuffle_hash"), ["doc", "text_hash"]))
    in_shard = in_shards(found.repartition(count, "key").sortWithinPartitions("key", "second", "doc", "text_hash", "pos"))
    parts = in_shard.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("pos", "n")).alias("partly"))
    joined = texts.join(again.hint("shuffle_hash"), ["doc", "text_hash"], "left").join(parts.hint("shuffle_hash"), ["doc", "text_hash"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = utf8(batch.column("text"))
            raw = flat.tobytes()
            rows = batch.num_rows
            places = []
            for name in ("whole", "partly"):
                column = batch.column(name)
                entries = column.flatten()
                sizes = np.diff(column.offsets.to_numpy()) * ~column.is_null().to_numpy(zero_copy_only=False)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                places.append((entries.field("pos").to_numpy(zero_copy_only=False), entries.field("n").to_numpy(zero_copy_only=False), cuts))
            removed, n_spans, digests, spans, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [], [], []
            for i in range(rows):
                x = raw[off[i] : off[i + 1]]
                pos, n = (np.concatenate([p[k][p[2][i] : p[2][i + 1]] for p in places]) for k in (0, 1))
                begin, end = spans_of(pos, n)
                rest, last = [], 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    rest.append(x[last:a])
                    last = b
                rest = b"".join([*rest, x[last:]])
                removed[i], n_spans[i] = len(x) - len(rest), len(begin)
                digests.append(hashlib.sha256(rest).hexdigest())
                spans.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                kept.append(rest)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in first), pa.array(np.diff(off)), pa.array(removed), pa.array(n_spans), pa.array(digests, pa.string()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                [f.name for f in schema],
            )

    first = ["doc_id", "beside"] if beside else ["doc_id"]
    joined = joined.select(F.col("doc_id").cast("long").alias("doc_id"), *first[1:], "text", "whole", "partly")
    results = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>, kept binary")
    schema = StructType([*(joined.schema[c] for c in first), *results.fields])
    return joined.mapInArrow(tidy(run), schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, and what remove() leaves of their texts; rows of which nothing but white space is left go.

    What a cut leaves of a character of several bytes is left out, and n_chars, if there, is counted again. Null texts go; of equal rows all stay
    or all go; an empty table gives no rows.
    """
    beside = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    rest = remove(docs, beside=beside).select("doc_id", *(["beside"] if beside else []), "kept")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py().decode("utf-8", "ignore") for x in batch.column("kept")]
            columns = {c: batch.column("beside").field(k) for k, c in enumerate(beside)} | {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array([bool(t.strip()) for t in texts], pa.bool_()))

    return rest.mapInArrow(tidy(run), docs.schema)

