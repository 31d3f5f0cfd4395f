"""Documents to chunks within a token budget, and chunks to blocks. Python sees costs, never texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import is_code, tokens, wrap
from ..lineage import cut

# Fixed value: tokens set aside for the tags around a part.
TAG_TOKENS = 40
#: Files of a request that pack_blocks() looks at together.
RANGE = 1024


def fill(costs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Begin and end of consecutive runs that are as long as the limit allows; what exceeds it alone is a run of its own."""
    sums = np.concatenate([[0], np.cumsum(costs)])
    out, at = [], 0
    while at < len(costs):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + limit, "right")) - 1)
        out.append((at, to))
        at = to
    return out


@F.pandas_udf(ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])))
def _cuts(costs: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else [{"begin": a, "end": b} for a, b in fill(np.asarray(c), int(m))] for c, m in zip(costs, limit, strict=True)])


def request_budget(requests: DataFrame, window: int | Column, output: int | Column, reserve: int | Column) -> tuple[DataFrame, DataFrame]:
    """Requests with the tokens left for files, and those whose question leaves none, with the reason. Sizes are numbers, or columns of requests."""
    left = requests.withColumn("question_tokens", tokens(F.col("question"))).withColumn("budget", F.lit(window) - F.lit(output) - F.lit(reserve) - F.col("question_tokens"))
    no_room = left.where("budget <= 0").withColumn("reason", F.concat(F.lit("question takes "), F.col("question_tokens").cast("string"), F.lit(" tokens and leaves no room for files")))
    return left.where("budget > 0"), no_room


def chunk_lines(documents: DataFrame, budget: Column | int = None) -> DataFrame:
    """Chunks of documents (request_id, path, ord, lines and, if no budget is given, budget; unit comes along).

    A document that fits whole is one chunk, without a line range. Otherwise lines are taken as long as they fit beside
    the tags, at least one. Columns: request_id, path, ord, part, parts, first_line, lines, wrapped, tokens, is_code. tokens
    comes from lengths alone, so whoever asks for costs does not build texts.
    """
    limit = F.col("budget") if budget is None else F.lit(budget) if isinstance(budget, int) else budget
    beside = ["unit"] if "unit" in documents.columns else []
    docs = _cut_up(documents.select("request_id", "path", "ord", *beside, "lines", limit.alias("budget")))
    # Of a column that is made row by row, Spark would first ask, in a filter before the cuts are known, whether it is empty: every line split anew for each piece.
    chunks = docs.select("request_id", "path", "ord", *beside, "whole", F.size("cuts").alias("parts"), F.inline(_pieces()))
    return chunks.select(
        "request_id", "path", "ord", *beside, "part", "parts", "first_line", "lines", _wrapped("lines", "first_line", "part", "parts").alias("wrapped"),
        _costs("lines", "first_line", "part", "parts").alias("tokens"), is_code(F.col("path")).alias("is_code"),
    )


def _cut_up(documents: DataFrame) -> DataFrame:
    """documents (lines, budget, ...) with whole, whether all lines fit, and cuts, where their chunks begin and end."""
    docs = documents.withColumns({"lines": F.coalesce("lines", F.array().cast("array<string>")), "budget": F.col("budget").cast("long")})
    docs = docs.withColumn("whole", whole_tokens("lines") <= F.col("budget"))
    costs = F.when(~F.col("whole"), F.transform("lines", lambda x: F.floor((F.length(x) + 4) / 4).cast("int")))
    everything = F.array(F.struct(F.lit(0).alias("begin"), F.size("lines").alias("end")))
    return docs.withColumn("cuts", F.coalesce(_cuts(costs, F.greatest(F.col("budget") - TAG_TOKENS, F.lit(1))), everything))


def _pieces() -> Column:
    """The chunks of _cut_up()'s rows in order: (part, first_line, lines). Pieces are cut within the row, so that no chunk carries the whole document through the generator."""
    piece = lambda c, i: F.struct((i + 1).alias("part"), c["begin"].alias("first_line"), F.slice("lines", c["begin"] + 1, c["end"] - c["begin"]).alias("lines"))
    return F.transform("cuts", piece)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _either(lines, first_line, part, parts, make) -> Column:
    """make(line range, part, parts) for a chunk of a file that was cut, make() for a whole one."""
    lines, first_line, part, parts = map(_column, (lines, first_line, part, parts))
    span = F.concat((first_line + 1).cast("string"), F.lit("-"), (first_line + F.size(lines)).cast("string"))
    return F.when(F.col("whole"), make()).otherwise(make(span, part, parts))


def _wrapped(lines, first_line, part, parts) -> Column:
    return _either(lines, first_line, part, parts, lambda *x: wrap(F.col("path"), F.array_join(lines, "\n"), *x))


def _costs(lines, first_line, part, parts) -> Column:
    return _wrapped_tokens(lines, _either(lines, first_line, part, parts, lambda *x: wrap(F.lit(""), F.lit(""), *x)))


def whole_tokens(lines: Column | str) -> Column:
    """What a file (path) takes of a budget as one chunk."""
    return _wrapped_tokens(lines, wrap(F.lit(""), F.lit("")))


def file_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of requests that have a file each: documents (request_id, path, lines, budget and, if known, unit) to request_id, block_no, path, is_code, unit, text, chunks (part, first_line, lines).

    The same chunks and blocks as by chunk_lines(), pack_blocks() and build_blocks(), cut within the file's row: no text is moved, and whoever asks for chunks alone builds no texts.
    """
    beside = ["unit"] if "unit" in documents.columns else []
    docs = _cut_up(documents.select("request_id", "path", *beside, "lines", "budget")).withColumn("pieces", _pieces()).drop("cuts").withColumn("parts", F.size("pieces"))
    costs = F.when(F.col("parts") > 1, F.transform("pieces", lambda p: _costs(p["lines"], p["first_line"], p["part"], F.col("parts"))))
    one = F.when(F.col("parts") > 0, F.array(F.struct(F.lit(0).alias("begin"), F.col("parts").alias("end")))).otherwise(F.array())
    docs = docs.withColumn("runs", F.coalesce(_cuts(costs, F.col("budget")), one))
    block = lambda r, i: F.struct(i.alias("block_no"), F.slice("pieces", r["begin"] + 1, r["end"] - r["begin"]).alias("chunks"))
    blocks = docs.select("request_id", "path", *beside, "whole", "parts", F.inline(F.transform("runs", block)))
    text = F.array_join(F.transform("chunks", lambda p: _wrapped(p["lines"], p["first_line"], p["part"], F.col("parts"))), "")
    return blocks.select("request_id", "block_no", "path", is_code(F.col("path")).alias("is_code"), *beside, text.alias("text"), "chunks")


def _wrapped_tokens(lines: Column | str, tags: Column) -> Column:
    """tokens(wrap(path, lines joined by line breaks, ...)) from lengths alone. tags: what wrap() gives for no path and no text."""
    size, last = F.size(lines), F.try_element_at(lines, F.lit(-1))
    text = F.aggregate(F.transform(lines, lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) + F.greatest(size - 1, F.lit(0))
    # wrap() adds a line break to a text that is there and does not end with one.
    ending = F.when((text > 0) & (last != "") & ~last.endswith("\n"), 1).otherwise(0)
    return F.floor((F.length(tags) + F.length("path") + text + ending + 3) / 4).cast("long")


def tails(costs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a run of chunks does to the block that is open before it, for every fill that this may have.

    (least fills, blocks begun, fill left), the least fill from 0 up: with a fill of at least that, so many blocks are begun here and the last one is
    filled so far. A fill of 0 is no open block.
    """
    n = len(costs)
    sums = np.concatenate([[0], np.cumsum(costs)])
    # The chunk at which a block that begins at each chunk ends, and what follows from there, from the end on.
    after = np.maximum(np.arange(n) + 1, np.searchsorted(sums, sums[:-1] + limit, "right") - 1)
    begun, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if after[i] == n:
            begun[i], left[i] = 1, sums[n] - sums[i]
        else:
            begun[i], left[i] = 1 + begun[after[i]], left[after[i]]
    # With an open block of fill f, the first chunk k with f + sums[k + 1] > limit begins the next one.
    least, blocks, fills = [0], [int(begun[0])], [int(left[0])]
    held = int(np.searchsorted(sums, limit, "right")) - 1  # chunks that fit in an open block at the most
    for k in range(held, -1, -1):
        first = max(1, limit - int(sums[k + 1]) + 1) if k < n else 1
        if k == n:  # all fit: the fill left depends on the one before, told by -1
            least.append(1)
            blocks.append(0)
            fills.append(-1)
        elif first > least[-1]:
            least.append(first)
            blocks.append(int(begun[k]))
            fills.append(int(left[k]))
        else:
            blocks[-1], fills[-1] = int(begun[k]), int(left[k])
    return np.array(least), np.array(blocks), np.array(fills)


def pack_blocks(chunks: DataFrame, budget: Column | int = None) -> DataFrame:
    """Chunks with block_no, from 0 in each request: documents first, then code, each in file order and filled in turn.

    A request is taken in ranges of RANGE files, so one of any size is spread over many tasks; these see keys and costs alone. Each range says what
    it does to the block left open before it, for every fill that this may have (no more than chunks fit in a block); a request's ranges are
    then chained, a row each, and the ranges number their blocks. chunks needs budget where none is given. Keys and costs are checkpointed, see cut().
    """
    limit = F.col("budget") if budget is None else F.lit(budget) if isinstance(budget, int) else budget
    keys = ["request_id", "is_code", "range"]
    thin = chunks.select("request_id", "is_code", F.expr(f"ord div {RANGE}").cast("int").alias("range"), "ord", "part", "tokens", limit.cast("long").alias("budget"))
    # Read twice: documents are cut up once for it, and a second time for their texts.
    thin = cut(thin)

    def summarize(rows: pd.DataFrame, heads: np.ndarray) -> pd.DataFrame:
        costs, limits = rows["tokens"].to_numpy(), rows["budget"].to_numpy()
        each = [tails(costs[i:j], int(limits[i])) for i, j in zip(heads, [*heads[1:], len(rows)], strict=True)]
        least, blocks, fills = (list(x) for x in zip(*each, strict=True))
        return rows[keys].iloc[heads].assign(total=np.add.reduceat(costs, heads), least=least, blocks=blocks, fills=fills)

    def chain(ranges: pd.DataFrame, heads: np.ndarray) -> pd.DataFrame:
        numbers, fills = np.zeros(len(ranges), np.int64), np.zeros(len(ranges), np.int64)
        columns = (ranges[c].to_numpy() for c in ("is_code", "total", "least", "blocks", "fills"))
        begins = set(heads.tolist())
        number = fill_now = code_before = 0
        for i, (is_code_now, total, least, blocks, ends) in enumerate(zip(*columns, strict=True)):
            if i in begins:
                number, fill_now = -1, 0
            elif is_code_now != code_before:
                fill_now = 0
            code_before = is_code_now
            numbers[i], fills[i] = number, fill_now
            at = int(np.searchsorted(least, fill_now, "right")) - 1
            number += int(blocks[at])
            fill_now = fill_now + total if ends[at] < 0 else int(ends[at])
        return ranges[keys].assign(number=numbers, fill=fills)

    def place(rows: pd.DataFrame, heads: np.ndarray) -> pd.DataFrame:
        costs, limits, numbers, fills = (rows[c].to_numpy() for c in ("tokens", "budget", "number", "fill"))
        out = []
        for i, j in zip(heads, [*heads[1:], len(rows)], strict=True):
            held = int(fills[i] > 0)  # a block left open takes what fits before the first one begins
            runs = fill(np.concatenate([fills[i : i + held], costs[i:j]]), int(limits[i]))
            out.append((numbers[i] + 1 - held + np.repeat(np.arange(len(runs)), [b - a for a, b in runs]))[held:])
        return rows[["request_id", "ord", "part"]].assign(block_no=np.concatenate(out))

    def by_group(df: DataFrame, group: list[str], order: list[str], f, schema: str) -> DataFrame:
        """f(rows, where its groups begin) over whole groups in order, as many as a batch brings; a group lies in one task."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                if not len(batch):
                    continue
                heads = _heads(batch, group)
                if held and (batch[group].iloc[0] != held[-1][group].iloc[-1]).any():
                    yield done(held)
                    held = []
                if heads[-1]:  # the last group may go on in the next batch
                    yield done([*held, batch.iloc[: heads[-1]]])
                    held = []
                held.append(batch.iloc[heads[-1] :])
            if held:
                yield done(held)

        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            return f(rows, _heads(rows, group))

        # Dealt by a hash of the keys. A repartition by the keys themselves is left out after a join by them, and a join that then turns into a broadcast
        # reads its input where it lies: a group would be taken in pieces.
        return df.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, *order).mapInPandas(run, schema)

    ranges = by_group(thin, keys, ["ord", "part"], summarize, "request_id long, is_code boolean, range int, total long, least array<long>, blocks array<long>, fills array<long>")
    starts = by_group(ranges, ["request_id"], ["is_code", "range"], chain, "request_id long, is_code boolean, range int, number long, fill long")
    placed = by_group(thin.join(starts, keys), keys, ["ord", "part"], place, "request_id long, ord int, part int, block_no int")
    return chunks.join(placed, ["request_id", "ord", "part"])


def _heads(rows: pd.DataFrame, group: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), bool)
    new[0] = True
    for c in group:
        x = rows[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def build_blocks(packed: DataFrame) -> DataFrame:
    """request_id, block_no, is_code, text, chunks (keys in order). A block's size is bounded by the budget or one chunk."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "part", "path", "wrapped")))
    blocks = packed.groupBy("request_id", "block_no", "is_code").agg(parts.alias("p"))
    return blocks.select(
        "request_id", "block_no", "is_code",
        F.array_join(F.transform("p", lambda x: x["wrapped"]), "").alias("text"),
        F.transform("p", lambda x: F.struct(x["ord"].alias("ord"), x["part"].alias("part"), x["path"].alias("path"))).alias("chunks"),
    )


def whole_files(chunks: DataFrame) -> DataFrame:
    """Each file of a request in one piece again, all in block 0, for responses that are about the request and not about one of its blocks. A row has a file's lines."""
    beside = ["unit"] if "unit" in chunks.columns else []
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "lines"))), lambda x: x["lines"])
    files = chunks.groupBy("request_id", "path", "ord", "is_code", *beside).agg(F.flatten(pieces).alias("lines"))
    return files.withColumns({"block_no": F.lit(0), "part": F.lit(1), "first_line": F.lit(0)})
