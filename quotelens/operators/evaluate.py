"""Runs of cases by models and prompt variants: reports scored by their quotes, and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, normalize, strip

NO_ANSWER = "sin_respuesta"


#: Rows of a list of models or variants.
LISTED = 10_000


def run_matrix(cases: DataFrame, models: DataFrame, variants: DataFrame) -> DataFrame:
    """Every case with every model and variant; both are lists that someone has written, of LISTED rows at the most."""
    for name, rows in (("models", models), ("variants", variants)):
        if rows.limit(LISTED + 1).count() > LISTED:
            raise ValueError(f"{name}: more than {LISTED} rows are no list to send to every task")
    return cases.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(variants))


def parse_report(report: Column) -> dict[str, Column]:
    """verified: what stands before the notes; quotes: its quote lines, joined; discarded and unformatted: the notes' counts."""
    verified = F.element_at(F.split(report, "\n\n(?:Descartadas? \\p{Nd}|Archivos no leídos)", 2), 1)
    bare = F.filter(F.transform(lines(verified), strip), lambda x: x.startswith(">"))
    count = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(report, pattern, 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))
    return {
        "verified": verified,
        "quotes": F.array_join(F.transform(bare, lambda x: strip(F.substr(x, F.lit(2)))), " "),
        "discarded": count("Descartadas? ([0-9]+)"),
        "unformatted": count("([0-9]+) respuestas? sin el formato pedido"),
    }


def is_hit(kind: Column, expected: Column, report: Column, error: Column) -> Column:
    """A case without an answer wants the report that says so; others want every expected fragment within the quotes."""
    parts = parse_report(report)
    quotes = normalize(parts["quotes"])
    silent = parts["verified"].startswith("No consta") & ~report.contains("sin el formato pedido")
    found = F.forall(expected, lambda f: F.contains(quotes, normalize(f)))
    return F.coalesce(error.isNull() & F.when(kind == NO_ANSWER, silent).otherwise(found), F.lit(False))


def score_runs(runs: DataFrame) -> DataFrame:
    """runs (model, variant, type, expected, report, error, seconds, calls, ...) with ok, discarded and unformatted."""
    parts = parse_report(F.coalesce("report", F.lit("")))
    return runs.withColumn("ok", is_hit(F.col("type"), F.col("expected"), F.coalesce("report", F.lit("")), F.col("error"))).withColumn("discarded", parts["discarded"]).withColumn("unformatted", parts["unformatted"])


def summarize_runs(scored: DataFrame) -> DataFrame:
    """For each model and variant, by type and in all (type null): hits, runs, and sums of discarded, unformatted, errors, seconds and calls."""
    return scored.groupingSets([["model", "variant", "type"], ["model", "variant"]], "model", "variant", "type").agg(
        F.count_if("ok").alias("hits"), F.count("*").alias("runs"), F.sum("discarded").alias("discarded"), F.sum("unformatted").alias("unformatted"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("seconds").alias("seconds"), F.sum("calls").alias("calls"),
    )
