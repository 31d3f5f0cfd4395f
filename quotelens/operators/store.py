"""The store of answers as a folder that is added to and pruned while it is read.

Rows lie in folders that never change. A version is a small file that names the folders it is made of; the newest version is the store, and is
written last, so whoever reads has one version or the next, whole. Who finds the number of a version taken puts what was done meanwhile beside their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "key string, report string, written_at timestamp"
#: Buckets of times that are counted at once; what they narrow down to is counted again.
BUCKETS = 4096
_OLDEST = -(1 << 63)


def newest(store: DataFrame, most: int) -> DataFrame:
    """The newest `most` rows of store (key, written_at, ...), of equally new ones those with the smallest keys; no time is oldest. None for most <= 0.

    Nothing is sorted and no row is moved: counts of times, then of keys among the last time's rows, give where to cut, a few passes of partial sums
    over bounded tables. Only of rows that share the last key and time too are some taken by number, in one task.
    """
    if most <= 0:
        return store.where("false")
    t = F.coalesce(F.unix_micros(F.col("written_at").cast("timestamp")), F.lit(_OLDEST))
    key = F.coalesce("key", F.lit(""))
    ends = store.agg(F.min(t).alias("low"), F.max(t).alias("high"), F.count("*").alias("n")).first()
    if ends["n"] <= most:
        return store
    low, high, left = ends["low"], ends["high"], most
    if low == _OLDEST:  # times first; rows without one are the last
        timed = store.where("written_at IS NOT NULL").agg(F.min(t).alias("low"), F.count("*").alias("n")).first()
        low = timed["low"] if timed["n"] >= most else _OLDEST
        if timed["n"] < most:
            high, left = _OLDEST, most - timed["n"]
    while low < high:
        width = (high - low) // BUCKETS + 1
        bucket = F.floor((t - low) / width)  # of a width of many units, rounding may put a time beside its bucket, which does no harm as each bucket's own ends count
        counts = store.where((t >= low) & (t <= high)).groupBy(bucket.alias("bucket"))
        rows = sorted(counts.agg(F.count("*").alias("n"), F.min(t).alias("low"), F.max(t).alias("high")).collect(), key=lambda r: -r["low"])
        for row in rows:  # newest first
            if row["n"] >= left:
                low, high = row["low"], row["high"]
                if row["n"] == left:
                    return store.where(t >= low)
                break
            left -= row["n"]
    return _smallest(store, t == low, key, left).unionByName(store.where(t > low))


def _smallest(store: DataFrame, among, key, left: int) -> DataFrame:
    """The `left` rows with the smallest keys of those rows, found by ever longer beginnings of keys."""
    begin = ""
    while True:
        here = store.where(among & key.startswith(begin)).groupBy(F.substring(key, 1, len(begin) + 1).alias("begin"))
        rows = here.agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).collect()
        for row in sorted(rows, key=lambda r: r["begin"]):
            if row["n"] > left:
                begin = row["begin"]
                break
            left -= row["n"]
            if not left:
                return store.where(among & (key <= row["last"]))
        if row["first"] == row["last"]:
            return store.where(among & (key < row["first"])).unionByName(store.where(among & (key == row["first"])).limit(left))


class AnswerStore:
    """A store of answers (see ANSWERS) in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.paths(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, list[str]]:
        """Number and folders of the newest version; 0 and none before anything is stored."""
        where = self.paths(f"{self.path}/versions")
        names = sorted(s.getPath().getName() for s in self.files.listStatus(where)) if self.files.exists(where) else []
        names = [n for n in names if n.isdigit()]
        if not names:
            return 0, []
        stream = self.files.open(self.paths(f"{self.path}/versions/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1]), text.split()

    def read(self) -> DataFrame:
        """All answers of the newest version. What is stored or pruned later doesn't change what this DataFrame reads."""
        folders = self.version()[1]
        if not folders:
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet(*(f"{self.path}/rows/{f}" for f in folders))

    def append(self, rows: DataFrame) -> None:
        """Answers (key, report, written_at) added."""
        new = self._write(rows)
        self._commit(lambda folders: [*folders, new])

    def prune(self, most: int) -> None:
        """All but the newest `most` answers go, see newest(). Answers added meanwhile stay."""
        _, before = self.version()
        new = self._write(newest(self.read(), most)) if before else None
        if new:
            self._commit(lambda folders: [new, *(f for f in folders if f not in before)])

    def clear_old(self) -> None:
        """Take away versions before the newest one, and folders that it doesn't name. For when nobody reads an old version, or writes, any more."""
        number, folders = self.version()
        for kind, kept in (("rows", set(folders)), ("versions", {f"{number:012d}"})):
            for status in self.files.listStatus(self.paths(f"{self.path}/{kind}")) if number else []:
                if status.getPath().getName() not in kept:
                    self.files.delete(status.getPath(), True)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select("key", "report", F.col("written_at").cast("timestamp").alias("written_at")).write.parquet(f"{self.path}/rows/{name}")
        return name

    def _commit(self, change) -> None:
        """The next version, from the newest one's folders. A number is taken by renaming a file that is whole; if another writer was first, that writer's version is the one to change."""
        while True:
            number, folders = self.version()
            target, draft = self.paths(f"{self.path}/versions/{number + 1:012d}"), self.paths(f"{self.path}/drafts/{uuid.uuid4().hex}")
            stream = self.files.create(draft)
            stream.write(bytearray("\n".join(change(folders)).encode()))
            stream.close()
            self.files.mkdirs(target.getParent())
            if not self.files.exists(target) and self.files.rename(draft, target):
                return
            self.files.delete(draft, False)
