"""Which documents hold a passage, over a whole corpus: by the rarest run of three words, then exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..batches import small_batches
from ..functions.text import clean_quote, normalize
from ..lineage import cut
from .verify import found_at

RUN = 3
#: Values that runs are told apart by before they are shuffled: a broadcast of 8 MB at most.
FILTER = 1 << 20
#: Texts whose runs are taken together.
AT_ONCE = 200
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(norm: Column) -> Column:
    """A text's words with a space between them."""
    return F.trim(F.regexp_replace(norm, "[^\\p{L}\\p{N}]+", " "))


def hashed_runs(rows: pa.RecordBatch, key: str, sizes: list[int] | None = None) -> pa.RecordBatch:
    """runs() of the rows of a batch."""
    split = pc.split_pattern(rows.column("words"), " ")
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    known = pc.list_flatten(split).dictionary_encode()
    hashed = hash_array(known.dictionary.to_numpy(zero_copy_only=False), categorize=False)[known.indices.to_numpy()]
    begins = np.concatenate([[0], ends[:-1]])
    most = [RUN] if sizes is None else sizes
    # For each size k, the hash of the k words from each place on; those that go over a text's end are never taken.
    at, row, out = {}, [], []
    for k in range(1, max(most) + 1):
        before = at[k - 1][: len(hashed) - k + 1] if k > 1 else np.uint64(0)
        x = (before ^ hashed[k - 1 :]) * _FACTOR
        at[k] = x ^ (x >> np.uint64(29))
    for i, (begin, end) in enumerate(zip(begins, ends, strict=True)):
        for k in [min(RUN, end - begin)] if sizes is None else most:
            if end - begin >= k:
                own = np.unique(at[k][begin : end - k + 1])
                row.append((i, k, len(own)))
                out.append(own)
    places, lengths, counts = np.array(row, np.int64).reshape(-1, 3).T
    return pa.record_batch({
        key: rows.column(key).take(pa.array(np.repeat(places, counts))), "size": pa.array(np.repeat(lengths, counts).astype(np.int32)),
        "run": pa.array(np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)),
    })


def runs(texts: DataFrame, key: str, sizes: list[int] | None = None) -> DataFrame:
    """(key, size, run): the distinct runs of so many consecutive words of each row of texts (key, words), hashed; without sizes, of RUN words, or of all where they are fewer.

    A found quote begins and ends at word ends, so the runs of a quote are runs of every text that holds it. Each word of a batch is hashed once, its runs
    are arithmetic on whole columns: as functions over arrays they took most of a search's time, as Spark goes through these one element at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield hashed_runs(batch.slice(at, AT_ONCE), key, sizes)

    small_batches(texts.sparkSession)
    own = texts.where("words <> ''").select(key, "words")
    return own.mapInArrow(run, StructType([own.schema[key], StructField("size", IntegerType()), StructField("run", LongType())]))


def locate_in_corpus(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id, position (from 1, in the normalised text) of every document that holds a quote.

    quotes (item_id, text), documents (doc_id, text). Each quote is looked up by its rarest run of RUN words (of all its words, if they
    are fewer), one row for each; how often runs occur is counted for the runs of quotes only. A quote without a word is in no document.

    The corpus is read twice: once for the runs that some quote has, which are written, and once for the texts that are looked at.
    """
    asked = quotes.select("item_id", normalize(clean_quote(F.col("text"))).alias("search")).withColumn("words", words(F.col("search"))).where("words <> ''")
    wanted = runs(asked, "item_id")
    # Most runs of the corpus are in no quote. They go before the shuffle, by a table of at most FILTER values, whatever the quotes.
    part = lambda run: F.pmod(run, F.lit(FILTER))
    parts = wanted.select(part(F.col("run")).alias("part")).distinct()
    corpus = documents.select("doc_id", normalize(F.col("text")).alias("norm"))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # three at the most
    if not sizes:
        return corpus.where("false").select(F.lit(0).cast("long").alias("item_id"), "doc_id", F.lit(0).alias("position"))
    some = runs(corpus.select("doc_id", words(F.col("norm")).alias("words")), "doc_id", sizes).withColumn("part", part(F.col("run"))).join(F.broadcast(parts), "part", "left_semi")
    held = cut(some.join(wanted.select("size", "run").distinct(), ["size", "run"], "left_semi").select("doc_id", "size", "run"))
    often = held.groupBy("size", "run").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, ["size", "run"]).groupBy("item_id", "size").agg(F.min(F.struct("n", "run"))["run"].alias("run"))
    pairs = cut(held.join(rarest, ["size", "run"]).select("item_id", "doc_id"))
    # Documents without a candidate are left out before their texts are normalised or shuffled.
    texts = documents.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", normalize(F.col("text")).alias("norm"))
    near = pairs.join(asked.select("item_id", "search"), "item_id").join(texts, "doc_id")
    return near.withColumn("position", found_at(F.col("norm"), F.col("search"))).where("position > 0").select("item_id", "doc_id", "position")
