"""What runs leave behind, as tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_outputs(path: str, reports: DataFrame, verified: DataFrame, rejections: DataFrame, unreadable: DataFrame | None = None, dumps: DataFrame | None = None) -> None:
    """Reports, verified claims, counts of rejections and unreadable files; dumps are partitioned by model and variant."""
    for name, rows in (("reports", reports), ("verified", verified), ("rejections", rejections), ("unreadable", unreadable)):
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
    if dumps is not None:
        dumps.write.mode("overwrite").partitionBy("model", "variant").json(f"{path}/dumps")
