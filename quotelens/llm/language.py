"""Language ID by cross-parsing: the language whose labelled text parses a document into the fewest longest-match phrases wins.

A suffix automaton holds all substrings of a language's sample. Walking it byte by byte finds the longest match from
the place where the last phrase ended; where no transition is left, a phrase ends and the walk starts again at the root. One parse runs
through a text from its first byte to its last.

A sample of more bytes has longer matches, whatever the language: in a text of its own language about log(bytes) / entropy of them each. So phrase
counts are normalised: the mean phrase length is divided by the log of the sample's size, which gives an estimate of the cross entropy,
and the language with the least of it wins.

Texts of a batch are walked side by side, so that one numpy gather advances all their parses; a text of many bytes is walked in lanes. A
lane does not know in which state the one before it ends. But longest-match parses that begin at different places soon begin a phrase at the
same byte, from where on they are one: a lane is walked on, into the next one, until it meets that one's parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bytesets import LOWER, slices, utf8
from .frames import fold_of, tidy

#: Bounds of the sample that the automata are fitted on: documents for each language, bytes for each language and in all.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_ALL = 64, 32_768, 262_144
#: Languages that are learnt unless the caller asks for more, those with the most labelled rows; ties in alphabetical order.
MOST_LANGUAGES = 1024
#: Languages whose tables a worker has at a time.
GROUP = 128
LANE = 512
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_a_letter(text: str) -> bool:
    """A character of a category L; the regular expression lets numbers such as \u00bd or \u2167 pass too."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


#: Lower case; whatever ASCII holds besides letters is a space.
_FOLD = np.where((LOWER >= 0x80) | (LOWER >= 0x61) & (LOWER <= 0x7A), LOWER, np.uint8(0x20)).astype(np.uint8)


def folded(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lower case, with one space for each run of bytes that are no letters."""
    x = _FOLD[flat]
    keep = x != 0x20
    keep[1:] |= x[:-1] != 0x20
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def automaton(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix automaton as (from, byte, to) transitions; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    rows = [(s, c, t) for s, edges in enumerate(nexts) for c, t in edges.items()]
    a = np.array(rows, np.int32).reshape(-1, 3)
    return a[:, 0].copy(), a[:, 1].astype(np.uint8), a[:, 2].copy()


def walker(source: np.ndarray, byte: np.ndarray, target: np.ndarray, classes: np.ndarray, width: int) -> np.ndarray:
    """Dense table: at state * width + class the next state's offset; its sign bit tells that a phrase ended. Class 0 is padding."""
    alone = 1 + int(target.max(initial=0))  # the state after a byte unknown here, which is a phrase of its own
    restart = np.full(width, alone * width, np.int32)
    at_root = source == 0
    restart[classes[byte[at_root]]] = target[at_root] * np.int32(width)
    table = np.tile(restart | np.int32(-(2**31)), (alone + 1, 1))
    table[0] = restart  # where a text begins, no phrase ends
    table[source, classes[byte]] = target * np.int32(width)
    table[:, 0] = np.arange(alone + 1, dtype=np.int32) * np.int32(width)  # padding stays where it is
    return table.ravel()


def sample(docs: DataFrame, learn_from, languages: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """Bounded sample of labelled whole documents, by language: of SAMPLE_DOCS documents picked by hash as many as give SAMPLE_BYTES, short ones of
    200 bytes and more first, so that many of them speak for the language; the last one is cut. So about twice SAMPLE_BYTES for each of at most `languages` reach the driver.
    """
    known = docs.where(learn_from & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    langs = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    size = F.octet_length("text")
    before = Window.partitionBy("lang").orderBy(size < 200, size, "rank").rowsBetween(Window.unboundedPreceding, -1)
    picked = (
        known.join(F.broadcast(langs), "lang")
        .select("doc_id", "lang", "text", F.row_number().over(rank).alias("rank"))
        .where(F.col("rank") <= SAMPLE_DOCS)
        .select("lang", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("before"), F.substring("text", 1, SAMPLE_BYTES).alias("text"), "rank")
        .where(F.col("before") < SAMPLE_BYTES)
    )
    texts: dict[str, list[bytes]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], r["before"], r["rank"])):
        texts.setdefault(row["lang"], []).append(row["text"].encode())
    most = max(2048, min(SAMPLE_BYTES, SAMPLE_ALL // max(1, min(GROUP, len(texts)))))
    return {lang: b" ".join(_fill(parts, most)) for lang, parts in sorted(texts.items())}


def _fill(parts: list[bytes], most: int) -> Iterator[bytes]:
    left = most
    for part in parts:
        if left <= 0:
            return
        yield part[:left]
        left -= len(part)


def fit(texts: dict[str, bytes]) -> dict:
    """What tasks need of at most GROUP languages: their names, byte classes, transitions, and what a phrase of each weighs; its size is bounded by SAMPLE_ALL."""
    parts = {lang: folded(x := np.frombuffer(text, np.uint8), np.array([0, len(x)]))[0] for lang, text in texts.items()}
    used = np.unique(np.concatenate([*parts.values(), np.zeros(0, np.uint8)])).astype(np.uint8)
    classes = np.full(256, 1, np.int64)  # 0: padding, 1: a byte that no sample has
    classes[used] = np.arange(len(used)) + 2
    weights = np.log2(np.array([max(2, len(x)) for x in parts.values()], float))
    return {"langs": list(parts), "classes": classes, "width": len(used) + 2, "edges": [automaton(x) for x in parts.values()], "weights": weights}


def fit_groups(texts: dict[str, bytes]) -> list[dict]:
    """fit() for each GROUP languages."""
    langs = list(texts)
    return [fit({lang: texts[lang] for lang in langs[a : a + GROUP]}) for a in range(0, len(langs), GROUP)]


_STATE = np.int32(2**31 - 1)
#: Times that lanes are parsed again side by side; what hasn't met by then (as in a long run of one letter) is walked straight through.
PASSES = 12


def phrases(model: dict, tables: list[np.ndarray], flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Phrases of each row under each language: one parse from a row's first byte to its last."""
    flat, off = folded(flat, off)
    sizes = np.diff(off)
    lanes = -(-sizes // LANE)
    out = np.zeros((len(sizes), len(tables)), np.int64)
    if not lanes.sum():
        return out
    row = np.repeat(np.arange(len(sizes)), lanes)
    number = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = off[:-1][row] + number * LANE
    size = np.minimum(LANE, off[1:][row] - start)
    classes = model["classes"].astype(np.int32)[flat]
    grid = np.zeros((LANE, len(row)), np.int32)
    for k in range(LANE):
        here = size > k
        grid[k, here] = classes[start[here] + k]
    for i, table in enumerate(tables):
        # Every lane as if a phrase began with it: the step of each byte, its sign bit telling that a phrase ended before it.
        steps = np.empty_like(grid)
        at = np.zeros(len(row), np.int32)
        for k in range(LANE):
            steps[k] = table[at + grid[k]]
            at = steps[k] & _STATE
        count, ends = (steps < 0).sum(0), at.copy()
        # Then from the state in which the lane before ends, until both are in the same state; from there on nothing differs.
        todo = np.flatnonzero(number > 0)
        alone = count.copy()
        for _ in range(PASSES):
            if not len(todo):
                break
            lane, at, more = todo, ends[todo - 1], np.zeros(len(todo), np.int64)
            left, was = np.arange(len(todo)), np.zeros(len(todo), np.int64)
            before = ends[todo]
            met = np.zeros(len(todo), bool)
            for k in range(LANE):
                step, guess = table[at[left] + grid[k, lane[left]]], steps[k, lane[left]]
                more[left] += step < 0
                was[left] += guess < 0
                at[left] = step & _STATE
                same = at[left] == guess & _STATE
                met[left[same]] = True
                left = left[~same]
                if not len(left):
                    break
            count[lane] = more + np.where(met, alone[lane] - was, 0)
            ends[lane] = np.where(met, steps[-1, lane] & _STATE, at)
            # A lane that ends otherwise than was taken for true has its successor parsed again.
            moved = lane[ends[lane] != before] + 1
            todo = moved[(moved < len(row)) & (number[np.minimum(moved, len(row) - 1)] > 0)]
        _walk(table, grid, row, todo, count, ends)
        np.add.at(out[:, i], row, count)
        out[sizes > 0, i] += 1
    return out


def _walk(table: np.ndarray, grid: np.ndarray, row: np.ndarray, todo: np.ndarray, count: np.ndarray, ends: np.ndarray) -> None:
    """Settle lanes that are still to be parsed again, and those after them in their rows as far as it matters: byte by byte, so in time proportional to the text."""
    step_of, past, open_ = memoryview(np.ascontiguousarray(table)).cast("B").cast("i"), 0, set(todo.tolist())
    for first in sorted(open_):
        if first < past:  # settled with an earlier one
            continue
        lane, state = first, int(ends[first - 1])
        while True:
            more = 0
            for c in grid[:, lane].tolist():
                step = step_of[state + c]
                if step < 0:
                    more += 1
                state = step & 0x7FFFFFFF
            same, count[lane], ends[lane] = state == ends[lane], more, state
            lane += 1
            # It goes on within the row, unless the next lane was parsed from this very state.
            if lane == len(row) or row[lane] != row[first] or same and lane not in open_:
                break
        past = lane


def identify(docs: DataFrame, learn_from=None, text: str = "text", languages: int = MOST_LANGUAGES) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs; other columns play no part.

    learn_from: condition on the rows that may be learnt from (with a non-null lang). languages: how many are learnt at most; every one may be told of a row. Null text, or text without a letter:
    `und`, score 0. No labelled row at all: `und` for every row. Ties: the language first in alphabetical order. Repeated rows get equal
    results; a very long text is parsed whole. Empty table: no rows. The score is 0.5 where the two best languages need equally many
    normalised phrases, and nears 1 as the second needs more.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"), "lang")
    out = _predict(docs.select("doc_id", "text"), sample(docs, F.lit(True) if learn_from is None else learn_from, languages))
    return out.select("doc_id", "lang_pred", "score")


def label(docs: DataFrame, learn_from=None, languages: int = MOST_LANGUAGES) -> DataFrame:
    """The rows of docs with lang_pred and score added; learns as identify() does. Columns of those names in docs are replaced."""
    docs = docs.drop("lang_pred", "score")
    return _predict(docs, sample(docs.select("doc_id", "text", "lang"), F.lit(True) if learn_from is None else learn_from, languages))


def _predict(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """All columns of docs and the prediction from the column text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_groups(texts))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, held = sent.value, {}
        langs = np.array([*(lang for m in models for lang in m["langs"]), "und"], object)

        def counted(model: dict, *row: np.ndarray) -> np.ndarray:
            tables = held.get(id(model))
            if tables is None:  # of several groups only one has its tables at a time
                held.clear()
                tables = held[id(model)] = [walker(*edges, model["classes"], model["width"]) for edges in model["edges"]]
            return phrases(model, tables, *row) * model["weights"]

        for batch in batches:
            for part in slices(batch, "text"):
                flat, off = utf8(part.column("text"))
                raw = flat.tobytes()
                has_letter = np.array([has_a_letter(raw[a:b].decode("utf-8", "replace")) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], bool)
                if models:
                    counts = np.concatenate([counted(m, flat, off) for m in models], 1)
                    best = counts.argmin(1)
                    ranked = np.sort(counts, 1)
                    second = ranked[:, min(1, ranked.shape[1] - 1)]
                    score = np.where(second > 0, second / np.maximum(1, ranked[:, 0] + second), 0.5)
                    # 1/2 at a tie; a rival that needs twice the phrases gives 0.8.
                    score = score**2 / (score**2 + (1 - score) ** 2)
                else:
                    best, score = np.zeros(len(off) - 1, int), np.zeros(len(off) - 1)
                known = has_letter & bool(models)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs[np.where(known, best, len(langs) - 1)], pa.string()), pa.array(np.where(known, score, 0.0))],
                    [*part.schema.names, "lang_pred", "score"],
                )

    return docs.mapInArrow(tidy(run), schema)


def op8(docs: DataFrame) -> DataFrame:
    """Learns from folds other than 2 of 4; predicts every row."""
    fold = fold_of("doc_id", 4)
    out = identify(docs, (fold != 2) & F.col("doc_id").isNotNull())
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
