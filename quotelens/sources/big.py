"""Text files of any size: read in splits by many tasks, lines numbered over the whole file.

Spark cuts a file into splits at line feeds; everything else that ends a line is looked for within what lies between two of them, so neither a CR LF nor a
character of several bytes is ever cut. What a split holds is written once, with a running number of its task; how many lines each split has, added up
in the order of splits, then gives every line its number. Only that table of splits, one row for each, is joined to the lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_END, extension
from ..lineage import new_folder
from .files import BINARY, LINE, PROBE

#: Up to so many splits are sent to all tasks, about 100 bytes each; a table of more is joined by shuffling.
SENT = 1 << 18
#: What ends a line, but for what a line feed ends.
_OTHER_END = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]\\z"
_BOM = 3


@dataclass
class BigLines:
    #: path, line_index (long, from 0), text, location.
    lines: DataFrame
    #: path, reason of files that are binary.
    unreadable: DataFrame


def read_big_lines(spark: SparkSession, *paths: str, above: int = 0, without: list[str] | None = None) -> BigLines:
    """Lines of the text files among paths (files, folders, patterns) that are larger than `above` bytes, as text_lines() gives them.

    UTF-8 with bad bytes replaced; a NUL among a file's first bytes makes it binary. A file without a byte has no lines. A single line that no line
    feed ends within 2 GB is beyond a row of Spark's and ends the job. `without`: extensions of files that are no text.
    """
    m = F.col("_metadata")
    # Paths as binaryFile has them.
    path = F.regexp_replace(F.url_decode(F.replace(m["file_path"], F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    raw = spark.read.option("lineSep", "\n").text(list(paths)).where(m["file_size"] > above)
    if without:
        raw = raw.where(~extension(m["file_name"]).isin(without))
    rows = raw.select(path.alias("path"), m["file_block_start"].alias("split"), m["file_size"].alias("bytes_in_file"), "value")
    text = F.regexp_replace(F.make_valid_utf8("value"), "\r\\z", "")  # of a CR LF
    rows = rows.select("path", "split", "bytes_in_file", "value", text.alias("clean"))
    rows = rows.select(
        "path", "split", "bytes_in_file", (F.octet_length("value") + 1).alias("n_bytes"),
        F.when(F.contains("value", F.lit("\0")), F.position(F.lit(b"\x00"), F.col("value").cast("binary"))).alias("nul"),
        (F.col("clean").rlike(_OTHER_END) & ~F.col("value").endswith("\r")).alias("open_end"), F.split("clean", LINE_END).alias("parts"),
    )
    rows = rows.select("path", "split", "bytes_in_file", "n_bytes", "nul", "open_end", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("pos", "text"))
    first = F.col("pos") == 0
    rows = rows.select(
        "path", "split", "bytes_in_file", F.when(first, F.col("n_bytes")).otherwise(0).alias("n_bytes"), F.when(first, F.col("nul")).alias("nul"),
        (F.col("open_end") & (F.col("pos") == F.col("n_parts") - 1)).alias("open_end"), "text", F.monotonically_increasing_id().alias("number"),
    )
    # Written once: the numbers are those of the splits as they were planned and read then.
    folder = new_folder(spark, "lines")
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)

    splits = rows.groupBy("path", "split").agg(
        F.count("*").alias("n"), F.min("number").alias("first"), F.max("number").alias("last"), F.sum("n_bytes").alias("n_bytes"), F.max("bytes_in_file").alias("bytes_in_file"),
        F.min(F.when(F.col("nul").isNotNull(), F.col("number"))).alias("nul"), F.max_by("open_end", "number").alias("open_end"),
    )
    by_file, whole = Window.partitionBy("path").orderBy("split"), Window.partitionBy("path")
    splits = splits.withColumns({
        "before": F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "bytes_read": F.sum("n_bytes").over(whole), "last_split": F.max("split").over(whole),
    })
    # Without a line feed at its end a file has a byte less than lines have, each with one; a byte order mark is not among what is read.
    splits = splits.withColumn("beyond", F.col("bytes_read") - F.col("bytes_in_file"))
    splits = splits.withColumns({"unended": F.col("beyond").isin(1, 1 - _BOM), "mark": F.col("beyond").isin(-_BOM, 1 - _BOM) & (F.col("split") == 0)})

    # A file is binary by where its first NUL is; only rows at the beginning of files that have one there are looked at, PROBE of them at the most.
    suspects = splits.where(F.col("before") + F.col("nul") - F.col("first") <= PROBE).select("path").distinct()
    skipped = F.when(F.max("mark").over(whole), _BOM).otherwise(0)
    begun = splits.withColumn("skipped", skipped).where((F.col("split") <= PROBE) & (F.col("before") <= PROBE)).join(suspects, "path", "left_semi").select("path", "split", "first", "before", "skipped")
    begin = rows.join(begun, ["path", "split"]).where(F.col("before") + F.col("number") - F.col("first") <= PROBE)
    place = F.coalesce(F.sum("n_bytes").over(Window.partitionBy("path").orderBy("split", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binary = begin.select("path", "nul", (place + F.col("skipped")).alias("at")).where(F.col("at") + F.col("nul") <= PROBE).select("path").distinct()

    fine = splits.join(binary, "path", "left_anti").select("path", "split", "first", "last", "before", "mark", (F.col("unended") & F.col("open_end") & (F.col("split") == F.col("last_split"))).alias("cut"))
    table = F.broadcast(fine) if fine.count() <= SENT else fine
    joined = rows.select("path", "split", "number", "text").join(table, ["path", "split"])
    # What ends the last line of a file without a line feed leaves an empty line behind that is none.
    joined = joined.where(~(F.col("cut") & (F.col("number") == F.col("last"))))
    index = F.col("before") + F.col("number") - F.col("first")
    own = F.when(F.col("mark") & (F.col("number") == F.col("first")), F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text"))
    lines = joined.select("path", index.alias("line_index"), own.alias("text"), F.concat(F.lit(LINE + " "), (index + 1).cast("string")).alias("location"))
    return BigLines(lines, binary.select("path", F.lit(BINARY).alias("reason")))
