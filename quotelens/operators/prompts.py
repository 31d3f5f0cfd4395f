"""Prompts out, responses in: chat requests as JSON for a model elsewhere, or a function of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import small_batches
from ..functions.text import strip

SYSTEM = (
    "Answer a single question from the files given and from nothing else; keep to the language of the question. "
    "Each fact takes two lines: '- ' and the fact, then '  > ' and a passage of the files, copied exactly, that shows it. "
    "Do not sum up, guess or make up numbers. If the files do not hold the answer, write NO CONSTA and nothing more.\n\n"
    'Example.\nFiles:\n<file path="notice.md">\nThe pool opens at nine. Children under ten need company.\n</file>\n'
    "Question: When does the pool open?\n- The pool opens at nine.\n  > The pool opens at nine\nQuestion: Who owns the pool?\nNO CONSTA"
)
REMINDER = "Only facts that answer this question, each with '- ' and a copied '  > ' line; otherwise NO CONSTA.\nAnswer:\n"

# What a response row can be.
OK, MALFORMED, REASONING_ONLY, EMPTY = "ok", "malformed", "reasoning only", "empty"
_ENVELOPE = "struct<choices: array<struct<message: struct<content: string, reasoning: string, reasoning_content: string>, finish_reason: string>>>"


#: Where a prompt has its question, by the variant's name.
LAYOUTS: dict[str, Callable[[Column, Column], Column]] = {
    "end": lambda files, question: F.concat(F.lit("Files:\n"), files, F.lit("\nQuestion: "), question, F.lit("\n" + REMINDER)),
    "start": lambda files, question: F.concat(F.lit("Question: "), question, F.lit("\nFiles:\n"), files, F.lit("\n" + REMINDER)),
}
#: A table of profiles: code and documents have models of their own, and window, output, reserve and temperature in common.
PROFILES = "profile string, document_model string, code_model string, window int, output int, reserve int, temperature double"


def route_model(blocks: DataFrame, code_model: str | DataFrame, document_model: str | None = None) -> DataFrame:
    """blocks with the model that reads them. With a table of profiles instead of a name: the model of the profile that each block names, with its output and temperature; a block that names none of them is left out."""
    if isinstance(code_model, DataFrame):
        # Sent to every task: dealt by profile, all texts would meet in as many tasks as there are profiles.
        blocks = blocks.join(F.broadcast(code_model.select("profile", "document_model", "code_model", "output", "temperature")), "profile")
        return blocks.withColumn("model", F.when(F.col("is_code"), F.col("code_model")).otherwise(F.col("document_model"))).drop("code_model", "document_model")
    return blocks.withColumn("model", F.when(F.col("is_code"), code_model).otherwise(document_model))


def render_prompts(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """blocks with system and user: files first, the question after them, then a reminder of the format."""
    joined = blocks.join(requests.select("request_id", "question"), "request_id")
    return joined.withColumn("system", F.lit(SYSTEM)).withColumn("user", LAYOUTS["end"](F.col("text"), F.col("question")))


def laid_out(text: Column, question: Column, variant: Column) -> Column:
    """The user's part of a prompt in the layout that its variant names; null for a name that is none."""
    out = F.lit(None).cast("string")
    for name, layout in LAYOUTS.items():
        out = F.when(variant == name, layout(text, question)).otherwise(out)
    return out


def request_json(prompts: DataFrame, most_output: int | Column, temperature: float | Column) -> DataFrame:
    """prompts (with model, system and user) and the body of a chat request."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    body = F.struct(
        F.col("model"), F.lit(temperature).alias("temperature"), F.lit(most_output).alias("max_tokens"), F.lit(False).alias("stream"),
        F.array(message("system", "system"), message("user", "user")).alias("messages"),
    )
    return prompts.withColumn("body", F.to_json(body))


def parse_responses(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """envelopes with content (null unless status is ok), status and finish_reason. Bad rows stay, with their status."""
    parsed = envelopes.withColumn("__e", F.try_element_at(F.from_json(F.col(body), _ENVELOPE)["choices"], F.lit(1)))
    message = F.col("__e.message")
    content = strip(F.coalesce(message["content"], F.lit("")))
    thought = F.coalesce(F.when(message["reasoning"] != "", message["reasoning"]), message["reasoning_content"], F.lit(""))
    status = F.when(message.isNull(), MALFORMED).when(content != "", OK).when(strip(thought) != "", REASONING_ONLY).otherwise(EMPTY)
    return parsed.withColumn("status", status).withColumn("content", F.when(F.col("status") == OK, content)).withColumn("finish_reason", F.col("__e.finish_reason")).drop("__e")


def answer_blocks(prompts: DataFrame, responder: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """request_id, block_no, content by a function of the caller's from prompts to contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_id": batch["request_id"], "block_no": batch["block_no"], "content": responder(batch)})

    small_batches(prompts.sparkSession)
    return prompts.select("request_id", "block_no", "model", "system", "user").mapInPandas(run, "request_id long, block_no int, content string")
