"""Evaluation: cases by models and prompt variants, from files to a summary, with everything shared that runs have in common."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import small_batches
from ..functions.text import is_code
from ..lineage import cut
from ..operators.chunking import file_blocks, request_budget, whole_tokens
from ..operators.evaluate import run_matrix, score_runs, summarize_runs
from ..operators.prompts import LAYOUTS, OK, SYSTEM, laid_out, parse_responses, request_json, route_model
from ..operators.report import compose_report, dedupe_verified, no_readable_input, tally_rejections
from ..operators.verify import flag_unformatted, parse_claims, verify
from ..sources.files import MISSING, read_all

#: Prompts that a responder gets at once.
ASKED_AT_ONCE = 100


@dataclass
class Evaluation:
    #: request_id (one for each run), block_no, profile, variant, model, body: what was asked.
    prompts: DataFrame
    #: The cases' own columns, profile, variant, report, error, seconds, calls, ok, discarded, unformatted.
    runs: DataFrame
    #: For each profile (as model) and variant, by type and in all.
    summary: DataFrame
    #: model, variant, question, text: a page for each run.
    dumps: DataFrame


def ask(prompts: DataFrame, responder: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """request_id, block_no, body, seconds by a function of the caller's from prompts to chat responses as JSON. Each prompt is asked once: what comes back is kept before anything reads it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ASKED_AT_ONCE):
                some = batch.iloc[at : at + ASKED_AT_ONCE].reset_index(drop=True)
                began = time.monotonic()
                bodies = list(responder(some))
                yield pd.DataFrame({"request_id": some["request_id"], "block_no": some["block_no"], "body": bodies, "seconds": (time.monotonic() - began) / len(some)})

    small_batches(prompts.sparkSession)
    return cut(prompts.select("request_id", "block_no", "model", "variant", "system", "user", "body").mapInPandas(run, "request_id long, block_no int, body string, seconds double"))


def evaluate(cases: DataFrame, files: DataFrame, profiles: DataFrame, variants: list[str], responder: Callable[[pd.DataFrame], pd.Series], readers: dict | None = None) -> Evaluation:
    """Every case with every profile and variant: asked, verified, reported, scored and summed up.

    cases (file, question, type, expected, ...), files (path, content), profiles as PROFILES has them, one for each model under test; its name is the run's
    model. A file is read once, however many runs name it, and cut into blocks where it lies, once for each budget that questions and profiles leave and once
    for all budgets that it fits in whole; runs share these blocks and their index, and only prompts are there for each run. Texts are moved three times: to be read, to
    be asked about and to have quotes found in them. A run whose question leaves no room, whose file can't be read,
    or one of whose responses holds no content has an error, and is no hit. Variants name LAYOUTS; others are refused before anything runs.
    """
    unknown = [v for v in variants if v not in LAYOUTS]
    if unknown or not variants:
        raise ValueError(f"unknown variants: {', '.join(unknown)}" if unknown else "no variant")
    spark = cases.sparkSession
    matrix = run_matrix(cases, profiles, spark.createDataFrame([(v,) for v in dict.fromkeys(variants)], "variant string"))
    runs = cut(matrix.withColumn("request_id", F.monotonically_increasing_id()))
    ready, rejected = request_budget(runs, F.col("window"), F.col("output"), F.col("reserve"))

    # A file's plans, one for each budget, come along when it is read, so that blocks are cut where its lines lie. Plans that the whole file fits in have the same one block.
    plans = cut(ready.select("file", "budget").distinct().withColumn("plan_id", F.monotonically_increasing_id()))
    wanted = plans.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("plan_id", "budget")).alias("plans"))
    read = cut(read_all(files.join(wanted, "path").select("path", "content", "plans"), readers))
    documents = read.where("reason IS NULL").withColumn("roomy", F.array_min(F.filter("plans", lambda p: p["budget"] >= whole_tokens("lines")))["plan_id"])
    same = F.when(F.col("budget") >= F.col("need"), F.col("roomy")).otherwise(F.col("plan_id"))
    layouts = cut(documents.select("roomy", whole_tokens("lines").alias("need"), F.inline("plans")).groupBy("plan_id").agg(F.min(same).alias("layout_id")))
    apart = F.filter("plans", lambda p: (p["plan_id"] == F.col("roomy")) | (p["budget"] < whole_tokens("lines")))
    blocks = file_blocks(documents.select("path", "lines", "unit", F.inline(apart)).withColumnRenamed("plan_id", "request_id"))

    planned = ready.join(plans, ["file", "budget"]).join(layouts, "plan_id", "left")
    planned = cut(planned.select("request_id", "layout_id", "profile", "variant", "question", "file"))
    routed = route_model(planned.withColumn("is_code", is_code(F.col("file"))), profiles)  # before texts come to it
    asked = routed.join(blocks.select(F.col("request_id").alias("layout_id"), "block_no", "text"), "layout_id").withColumn("system", F.lit(SYSTEM))
    asked = asked.withColumn("user", laid_out(F.col("text"), F.col("question"), F.col("variant")))
    prompts = request_json(asked, F.col("output"), F.col("temperature")).select("request_id", "block_no", "profile", "variant", "model", "system", "user", "body")
    answers = parse_responses(ask(prompts, responder))

    fine = answers.where(F.col("status") == OK).select("request_id", "block_no", "content")
    claims = parse_claims(fine)
    requests = runs.select("request_id", "question")
    chunks = blocks.select("request_id", "block_no", "path", F.lit(0).alias("ord"), "is_code", "unit", F.inline("chunks"))
    verdicts = cut(verify(claims.join(planned.select("request_id", "layout_id"), "request_id"), chunks, requests, place="layout_id"))
    rejections = tally_rejections(verdicts, flag_unformatted(fine, claims))
    unread = planned.where("layout_id IS NULL").join(read.where("reason IS NOT NULL").groupBy(F.col("path").alias("file")).agg(F.min("reason").alias("reason")), "file", "left")
    unread = unread.select("request_id", F.lit(0).alias("ord"), F.col("file").alias("path"), F.coalesce("reason", F.lit(MISSING)).alias("reason"))
    reports = compose_report(requests, dedupe_verified(verdicts), rejections, unread)

    failed = no_readable_input(planned.select("request_id"), answers, unread).select("request_id", F.col("reasons").alias("unreadable"))
    silent = answers.where(F.col("status") != OK).groupBy("request_id").agg(F.min_by("status", "block_no").alias("silent"))
    spent = answers.groupBy("request_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("calls"))
    done = runs.join(reports, "request_id").join(rejected.select("request_id", F.col("reason").alias("full")), "request_id", "left")
    for beside in (failed, silent, spent):
        done = done.join(beside, "request_id", "left")
    error = F.coalesce("full", "unreadable", "silent")
    own = [c for c in cases.columns if c not in ("profile", "variant")]
    out = done.select(
        *own, "profile", F.col("profile").alias("model"), "variant", F.when(error.isNull(), F.col("report")).otherwise("").alias("report"), error.alias("error"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls"),
    )
    scored = cut(score_runs(out))
    page = F.concat(F.lit("### ["), F.when(F.col("ok"), "OK").otherwise("--"), F.lit("] "), F.col("question"), F.lit("\n\n"), F.coalesce("error", "report"), F.lit("\n"))
    return Evaluation(prompts, scored, summarize_runs(scored), scored.select("model", "variant", "question", page.alias("text")))
