"""Responses verified as they arrive, each block once."""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.verify import flag_unformatted, parse_claims, verify

RESPONSES = "request_id long, block_no int, content string"
_STATE = "spark.sql.streaming.stateStore.providerClass"
_STARTING = Lock()
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """A stream started with its state in RocksDB, so that a batch touches the state of its own keys only. The stream takes the session's setting as it starts; streams that start here wait for one another."""
    with _STARTING:
        before = spark.conf.get(_STATE)
        spark.conf.set(_STATE, _ROCKSDB)
        try:
            return start()
        finally:
            spark.conf.set(_STATE, before)


def verify_stream(spark: SparkSession, source: str, chunks: DataFrame, requests: DataFrame, target: str, checkpoint: str, watch: dict | None = None) -> StreamingQuery:
    """Verdicts of the response files (Parquet) in source, in target/verdicts/batch=N.

    Blocks seen are keyed state of the stream, in RocksDB, so a batch touches the state of its own blocks only. A batch that is done again
    after a failure starts from the state that it had the first time and writes its folder anew, whether or not the first try got so
    far. target and checkpoint belong together: with a new checkpoint, take a new target.
    """

    def batch(rows: DataFrame, number: int) -> None:
        # Read three times below; and the duplicates' choice of a row must be one and the same in all of them.
        fresh = rows.persist()
        claims = parse_claims(fresh)
        verdicts = verify(claims, chunks, requests).unionByName(flag_unformatted(fresh, claims), allowMissingColumns=True)
        verdicts.write.mode("overwrite").parquet(f"{target}/verdicts/batch={number}")
        fresh.unpersist()

    stream = spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", 100).parquet(source).dropDuplicates(["request_id", "block_no"])
    return with_rocksdb(spark, lambda: stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(watch or {"availableNow": True})).start())
