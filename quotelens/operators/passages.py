"""A kept index of a corpus for locate_in_corpus(): built once, added to, and asked as often as there are quotes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import small_batches
from ..functions.text import clean_quote, normalize
from ..lineage import cut
from .search import AT_ONCE, RUN, hashed_runs, runs, words
from .verify import found_at

#: Folders that postings and texts are dealt to, by run and by document: what a search reads is so many parts of the whole at the least.
PARTS = 64
#: Runs that are indexed: words, for quotes of fewer than RUN words, and runs of RUN words.
SIZES = [1, RUN]
#: Postings that a task sorts by run at a time.
STRETCH = 1 << 22
#: Bytes of a file that a task collects before it writes them, for each of the PARTS files that it has open.
GROUP_BYTES = 4 * 1024 * 1024
#: Files that a task has open at once; with so many, Spark writes into folders without sorting by them.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Rarest runs that are looked for within files by their values; more of them are found by a join alone.
NAMED = 1_000


def _part(run: Column) -> Column:
    """The folder of a run, in the order of runs."""
    return F.shiftright(run, 58) + PARTS // 2


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, words) to (doc_id, run, part), sorted by run in stretches of about STRETCH rows."""

    def done(docs: list, found: list) -> pa.RecordBatch:
        run = np.concatenate(found)
        order = np.argsort(run)
        run = run[order]
        return pa.record_batch({"doc_id": np.concatenate(docs)[order], "run": run, "part": ((run >> 58) + PARTS // 2).astype(np.int32)})

    docs, found, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            rows = hashed_runs(batch.slice(at, AT_ONCE), "doc_id", SIZES)
            docs.append(rows.column("doc_id").to_numpy())
            found.append(rows.column("run").to_numpy())
            held += rows.num_rows
            if held >= STRETCH:
                yield done(docs, found)
                docs, found, held = [], [], 0
    if held:
        yield done(docs, found)


class PassageIndex:
    """Words and runs of RUN words with the documents that hold them, and the normalised texts, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, documents: DataFrame) -> None:
        """Index documents (doc_id long, text) that are new to it. Null texts and texts without words are in no answer.

        Nothing is shuffled or sorted as a whole: each task writes a file for each part, whose runs are in order for stretches.
        """
        small_batches(self.spark)
        texts = documents.select("doc_id", normalize(F.col("text")).alias("norm")).where("norm <> ''")
        self._append(texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), "texts")
        own = texts.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("norm")).alias("words")).where("doc_id IS NOT NULL AND words <> ''")
        self._append(own.mapInArrow(_postings, "doc_id long, run long, part int"), "postings")

    def _append(self, rows: DataFrame, table: str) -> None:
        before = self.spark.conf.get(WRITERS)
        self.spark.conf.set(WRITERS, str(PARTS))
        try:
            rows.write.mode("append").option("parquet.block.size", GROUP_BYTES).partitionBy("part").parquet(f"{self.path}/{table}")
        finally:
            self.spark.conf.set(WRITERS, before)

    def locate(self, quotes: DataFrame) -> DataFrame:
        """item_id, doc_id, position as locate_in_corpus() gives them for quotes (item_id, text) and all that has been added.

        Each quote is looked up by its rarest run, as its runs' postings tell; of texts only the folders of documents that hold one are read.
        """
        asked = cut(quotes.select("item_id", normalize(clean_quote(F.col("text"))).alias("search")).withColumn("words", words(F.col("search"))).where("words <> ''"))
        few = F.size(F.split("words", " ")) < RUN
        wanted = runs(asked.where(~few), "item_id", [RUN]).unionByName(runs(asked.where(few), "item_id", [1])).select("item_id", "run", _part(F.col("run")).alias("part"))
        # Most runs of a corpus are in one document, so a table of their counts would be as large as the postings; they are counted here.
        postings = self.spark.read.schema("doc_id long, run long, part int").parquet(f"{self.path}/postings")
        often = postings.join(wanted.select("part", "run").distinct(), ["part", "run"], "left_semi").groupBy("part", "run").agg(F.count("*").alias("n"))
        # A quote of which some run is nowhere is nowhere itself.
        found = wanted.join(often, ["part", "run"], "left").groupBy("item_id").agg(F.min_by(F.struct("part", "run"), F.struct(F.coalesce("n", F.lit(0)), "run")).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
        rarest = cut(found.where("n > 0").select("item_id", "key.*"))
        parts = [r["part"] for r in rarest.select("part").distinct().collect()]  # PARTS at the most
        postings = postings.where(F.col("part").isin(parts))
        named = [r["run"] for r in rarest.select("run").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            postings = postings.where(F.col("run").isin(named))
        pairs = cut(postings.join(rarest, ["part", "run"]).select("item_id", "doc_id").distinct().withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))))
        parts = [r["part"] for r in pairs.select("part").distinct().collect()]
        texts = self.spark.read.schema("doc_id long, norm string, part int").parquet(f"{self.path}/texts").where(F.col("part").isin(parts)).drop("part")
        texts = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
        near = pairs.drop("part").join(asked.select("item_id", "search"), "item_id").join(texts, "doc_id")
        return near.withColumn("position", found_at(F.col("norm"), F.col("search"))).where("position > 0").select("item_id", "doc_id", "position")
