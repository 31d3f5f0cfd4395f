"""Whole jobs: documents to prompts, responses to reports, and cases to a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import build_blocks, chunk_lines, pack_blocks, request_budget
from ..operators.evaluate import score_runs, summarize_runs
from ..operators.prompts import render_prompts, request_json, route_model
from ..operators.report import compose_report, dedupe_verified, no_readable_input, tally_rejections
from ..operators.reuse import answer_key, split_cached
from ..operators.verify import flag_unformatted, parse_claims, verify
from ..sources.files import MISSING


@dataclass(frozen=True)
class Profile:
    window: int = 8192
    output: int = 1024
    reserve: int = 1024
    document_model: str = "documents"
    code_model: str = "code"
    temperature: float = 0.0


@dataclass
class Prompts:
    chunks: DataFrame
    blocks: DataFrame
    prompts: DataFrame
    #: Requests whose question leaves no room for files, with the reason.
    rejected: DataFrame
    #: request_id, ord, path, reason of every file that could not be read or is not there.
    unread: DataFrame
    #: Requests without a readable file, with all reasons.
    failed: DataFrame


def to_prompts(requests: DataFrame, documents: DataFrame, profile: Profile = Profile(), unreadable: DataFrame | None = None) -> Prompts:
    """requests (request_id, question, paths), documents (path, lines, unit if known): chunks with their block, blocks, and a request body for each.

    Each path is read once; lines meet the requests that name them. unreadable: (path, reason) as extract() gives it; a path that is in neither
    table has the reason MISSING.
    """
    ready, rejected = request_budget(requests, profile.window, profile.output, profile.reserve)
    named = ready.select("request_id", "budget", F.posexplode("paths").alias("ord", "path"))
    beside = [c for c in ("lines", "unit") if c in documents.columns]
    chunks = pack_blocks(chunk_lines(named.join(documents.select("path", *beside), "path")).join(ready.select("request_id", "budget"), "request_id"))
    blocks = build_blocks(chunks)
    prompts = request_json(render_prompts(route_model(blocks, profile.code_model, profile.document_model), ready), profile.output, profile.temperature)
    unread = named.select("request_id", "ord", "path").join(documents.select("path").distinct(), "path", "left_anti")
    if unreadable is not None:
        unread = unread.join(unreadable.groupBy("path").agg(F.min("reason").alias("reason")), "path", "left")
    reason = F.coalesce("reason", F.lit(MISSING)) if unreadable is not None else F.lit(MISSING)
    unread = unread.select("request_id", "ord", "path", reason.alias("reason"))
    return Prompts(chunks, blocks, prompts, rejected, unread, no_readable_input(ready.select("request_id"), blocks, unread))


@dataclass
class Known:
    #: request_id, key, report of requests answered before.
    hits: DataFrame
    #: request_id, key of the others.
    misses: DataFrame
    #: The prompts of the others.
    prompts: DataFrame


def split_known(work: Prompts, requests: DataFrame, store: DataFrame, profile: Profile = Profile(), variant: str = "") -> Known:
    """What of the work the store (key, report, written_at) has answered already, and what is left to ask."""
    keys = answer_key(requests, work.blocks, work.unread, variant, profile.document_model, profile.code_model, profile.output, profile.temperature)
    hits, misses = split_cached(keys, store)
    return Known(hits, misses, work.prompts.join(misses.select("request_id"), "request_id", "left_semi"))


@dataclass
class Reports:
    verdicts: DataFrame
    kept: DataFrame
    rejections: DataFrame
    reports: DataFrame


def to_reports(responses: DataFrame, chunks: DataFrame, requests: DataFrame, unreadable: DataFrame | None = None) -> Reports:
    """responses (request_id, block_no, content) to verdicts and a report for each request.

    Locations are in the unit of each file (lines, paragraphs), and files that were not read (request_id, ord, path, reason) are named, as Prompts has
    them. Verdicts are persisted, as reports read them twice; unpersist them when the reports are written.
    """
    claims = parse_claims(responses)
    verdicts = verify(claims, chunks, requests).persist()
    kept = dedupe_verified(verdicts)
    rejections = tally_rejections(verdicts, flag_unformatted(responses, claims))
    return Reports(verdicts, kept, rejections, compose_report(requests, kept, rejections, unreadable))


def to_summary(runs: DataFrame) -> DataFrame:
    return summarize_runs(score_runs(runs))
