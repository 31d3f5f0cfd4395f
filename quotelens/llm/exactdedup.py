"""Exact duplicates by progressive refinement: rows are grouped by length, then by a hash of their beginning, then by a hash of all.

Two texts are equal when they are the same after each run of white space is replaced by one space. A first scan makes thin rows (length,
hash of the beginning); only rows whose length and beginning occur again are read in full and hashed. The rows that another one
shares a class with are thin too: texts are never shuffled to find classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut

SPACES = "[\\x20\\x09-\\x0D]+"
#: Characters of the beginning that are hashed.
BEGINNING = 256
#: What a row may share is told apart by so many values before it is read in full, whatever the number of rows: the table of them that is
#: broadcast has at most so many rows of 8 bytes. More rows than values mean that more is read in full, not that anything is lost.
SLOTS = 1 << 20


def normal(text: Column) -> Column:
    """What is compared: white space runs as one space each; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _slot(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def _again(thin: DataFrame, *keys: str) -> DataFrame:
    """The slots of keys that occur more than once: SLOTS rows at the most."""
    return thin.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(_slot(*map(F.col, keys)).alias("slot")).distinct()


def refined(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, mine, own, full): every row of docs with its text normalised, all its own columns, and, if its length and beginning occur again, the hash of the whole text; full is null for rows that are alone."""
    mine = normal(F.col(text_column))
    # Own columns go into a struct, so they clash with none of ours.
    rows = docs.select(F.col(id_column).cast("long").alias("id"), mine.alias("mine"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))
    length, beginning = F.octet_length("mine"), F.xxhash64(F.substring("mine", 1, BEGINNING))
    # Length and beginning cost one pass over the texts and are kept, 16 bytes a row; each step shuffles what is left of them.
    thin = cut(rows.select(length.alias("length"), beginning.alias("beginning")))
    lengths = cut(_again(thin, "length"))
    some = thin.withColumn("slot", _slot(F.col("length"))).join(F.broadcast(lengths), "slot", "left_semi")
    pairs = cut(_again(some, "length", "beginning").withColumn("again", F.lit(True)))
    marked = rows.withColumn("slot", _slot(length, beginning)).join(F.broadcast(pairs), "slot", "left")
    return marked.select("id", "mine", "own", F.when(F.col("again"), F.sha2("mine", 256)).alias("full"))


def classes(docs: DataFrame, digests: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept for each row of docs: which row of its class stays, and how many rows the class has.

    Null texts count as empty, and empty texts are equal to one another; texts of any length are compared whole. The row with the smallest
    id stays, a null id being the largest; of rows that share that id too, one. A class of null ids has a null keep_id. Repeated
    rows are rows of their own. Empty table: no rows. Other columns play no part, whatever their names. With `digests`
    there is text_sha256 besides, of every row's normalised text, those that are alone included.
    """
    rows = refined(docs, id_column, text_column)
    digest = F.coalesce("full", F.sha2("mine", 256)) if digests else F.col("full")
    # Written once: the numbers of rows are the same in all that follows.
    thin = cut(rows.select("id", "full", digest.alias("digest"), F.monotonically_increasing_id().alias("row")))
    alone, shared = thin.where("full IS NULL"), thin.where("full IS NOT NULL")
    # A class's first row and size come from partial sums, so a large class is a row a task. Cut, so that the join below can split a large class.
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    firsts = cut(shared.groupBy("full").agg(F.min(order).alias("first"), F.count("*").alias("size")))
    found = shared.join(firsts, "full").select("id", F.col("first.id").alias("keep_id"), "size", (F.col("first.row") == F.col("row")).alias("kept"), "digest")
    found = found.unionByName(alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "digest"))
    out = found.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))
    return out if digests else out.drop("text_sha256")


def keep(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns and texts as they are. Rows that are alone are not shuffled, nor are rows that go."""
    rows = refined(docs, id_column, text_column)
    order = F.struct(F.col("id").isNull().alias("last"), "id")
    shared = rows.where("full IS NOT NULL")
    firsts = cut(shared.groupBy("full").agg(F.min(order)["id"].alias("first")))
    # Of a class the rows with the first id are left, one unless rows are repeated.
    left = shared.join(firsts, "full").where(F.col("id").eqNullSafe(F.col("first")))
    one = left.groupBy("full").agg(F.any_value("own").alias("own"))
    return rows.where("full IS NULL").select("own.*").unionByName(one.select("own.*"))
