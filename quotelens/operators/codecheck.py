"""Model-written Python: taken out of its fence, and accepted or rejected without being run."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import is_code, lines, strip

ACCEPTED, OUTSIDE, EMPTY, INVALID, STRAY = "ok", "text outside the fence", "empty", "not valid Python", "stray expression"
LARGE = 350


def strip_fences(text: Column) -> tuple[Column, Column]:
    """(code, whether text follows the fence). Only a text that begins with a fence is wrapped in one; the last fence closes it."""
    rows = lines(strip(text))
    fence = F.filter(F.transform(rows, lambda x, i: F.when(F.regexp_replace(x, "^\\s+", "").startswith("```"), i).otherwise(-1)), lambda i: i >= 0)
    wrapped = F.coalesce(F.get(fence, F.lit(0)) == 0, F.lit(False))
    last = F.when(F.size(fence) > 1, F.element_at(fence, -1)).otherwise(F.size(rows))
    inner = strip(F.array_join(F.slice(rows, F.lit(2), F.greatest(last - 1, F.lit(0))), "\n"))
    after = strip(F.array_join(F.slice(rows, last + 2, F.greatest(F.size(rows) - last - 1, F.lit(0))), "\n"))
    return F.when(wrapped, inner).otherwise(strip(text)), wrapped & (after != "")


def status_of(code: str) -> str:
    if not code.strip():
        return EMPTY
    try:
        tree = ast.parse(code)
        compile(tree, "<response>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return INVALID
    for place, node in enumerate(tree.body):
        if isinstance(node, ast.Expr) and not isinstance(node.value, ast.Call):
            docstring = place == 0 and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
            if not docstring:
                return STRAY
    return ACCEPTED


@F.pandas_udf(StringType())
def python_status(code: pd.Series) -> pd.Series:
    """Whether a text is Python that can be used: it compiles, and no bare expression but calls and a leading docstring stands in it."""
    return code.map(lambda c: EMPTY if c is None else status_of(c))


def triage_code(responses: DataFrame, text: str = "text") -> DataFrame:
    """responses with code, status and n_lines (0 unless accepted)."""
    code, outside = strip_fences(F.coalesce(F.col(text), F.lit("")))
    out = responses.withColumn("code", code).withColumn("__outside", outside)
    out = out.withColumn("status", F.when(F.col("__outside"), OUTSIDE).otherwise(python_status(F.col("code")))).drop("__outside")
    return out.withColumn("n_lines", F.when(F.col("status") == ACCEPTED, F.size(lines(F.col("code")))).otherwise(0))


def large_sources(files: DataFrame, threshold: int | str | None = LARGE) -> DataFrame:
    """Code files (path, content) of more lines than the threshold, by line feeds and carriage returns alone; a threshold that is no positive number counts as 350."""
    try:
        most = int(threshold)
    except (TypeError, ValueError):
        most = LARGE
    most = most if most > 0 else LARGE
    parts = F.split("content", "\r\n|[\r\n]")
    n = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return files.where(is_code(F.col("path"))).select("path", n.alias("n_lines")).where(F.col("n_lines") > most)
