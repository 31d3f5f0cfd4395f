"""Claims and quotes: parsed from responses, found in their block, checked against each other. All built-in but number words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numeric_values
from ..functions.text import (
    LEAST_COVERAGE,
    clean_quote,
    content_words,
    covered,
    digit_strings,
    is_not_stated,
    lines,
    normalize,
    stems,
    strip,
    touches,
)
from .intervals import interval_join

# Reasons for rejecting, in the order of reports, with their wording there.
REASONS = {
    "sin_formato": "respuestas sin el formato pedido",
    "sin_cita": "sin cita",
    "cita_corta": "con cita de menos de 3 palabras",
    "cita_no_encontrada": "con cita no encontrada en el documento",
    "cifras_no_respaldadas": "con cifras que no están en su cita",
    "cita_no_respalda": "con cita que no respalda la afirmación",
    "cita_ajena": "con cita ajena a la pregunta",
}
LEAST_QUOTE_WORDS = 3
SKIPPED = "no consta"
_BULLET = "^(?:[\\s\x1c-\x1f\x85]*[-*•]|\\p{Nd}+[.)])[\\s\x1c-\x1f\x85]+"


def parse_claims(responses: DataFrame, key: tuple[str, ...] = ("request_id", "block_no")) -> DataFrame:
    """key, claim_no (from 1), claim, quote of each bullet of responses (key, content). What comes before the first bullet is nobody's."""
    # All within a row: where bullets stand cuts the array of lines, so no response is taken apart and shuffled.
    bare = F.filter(F.transform(lines(F.col("content")), lambda x: F.struct(x.alias("line"), strip(x).alias("bare"))), lambda x: x["bare"] != "")
    typed = F.transform("__bare", _typed)
    places = F.filter(F.transform("__typed", lambda x, i: F.when(x["kind"] == "bullet", i).otherwise(-1)), lambda i: i >= 0)
    own = lambda start, k: F.slice(F.col("__typed"), start + 1, F.coalesce(F.get(F.col("__places"), k + 1), F.size("__typed")) - start)
    rows = responses.select(*key, bare.alias("__bare")).withColumn("__typed", typed).withColumn("__places", places)
    items = rows.select(*key, F.posexplode(F.transform("__places", own)).alias("__n", "__item"))

    def joined(keep) -> Column:
        return strip(F.array_join(F.transform(F.filter("__item", keep), lambda x: x["part"]), " "))

    return items.select(*key, (F.col("__n") + 1).cast("long").alias("claim_no"), joined(lambda x: x["kind"] != "quote").alias("claim"), joined(lambda x: x["kind"] == "quote").alias("quote"))


def _typed(row: Column) -> Column:
    quoted, bullet = row["bare"].startswith(">"), row["line"].rlike(_BULLET)
    part = F.when(quoted, strip(F.regexp_replace(row["bare"], "^>+", ""))).when(bullet, F.regexp_replace(row["line"], _BULLET, "")).otherwise(row["bare"])
    return F.struct(F.when(quoted, "quote").when(bullet, "bullet").otherwise("more").alias("kind"), part.alias("part"))


def flag_unformatted(responses: DataFrame, claims: DataFrame, key: tuple[str, ...] = ("request_id", "block_no")) -> DataFrame:
    """Responses that say something, not that nothing is stated, without a single bullet."""
    some = responses.where((strip(F.col("content")) != "") & ~is_not_stated(F.col("content"))).select(*key)
    return some.join(claims.select(*key).distinct(), list(key), "left_anti").withColumn("reason", F.lit("sin_formato"))


def chunk_index(chunks: DataFrame) -> DataFrame:
    """chunks with norm, the normalised non-empty lines joined by a space, and starts, where in it each line of chunks begins. Once for each chunk."""
    norm = F.filter(F.transform("lines", lambda x, i: F.struct(normalize(x).alias("t"), i.alias("line"))), lambda x: x["t"] != "")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["t"]) + 1).alias("at"), F.concat(acc["starts"], F.array(F.struct(acc["at"].alias("start"), x["line"].alias("line")))).alias("starts")
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, line: int>>").alias("starts"))
    with_norm = chunks.withColumn("__n", norm)
    return with_norm.withColumn("norm", F.array_join(F.transform("__n", lambda x: x["t"]), " ")).withColumn("starts", F.aggregate("__n", none, step)["starts"]).drop("__n")


def pattern(quote: Column) -> Column:
    """Regular expression for a normalised quote as whole words, and not in the middle of a longer number."""
    literal = F.concat(F.lit("\\Q"), F.regexp_replace(quote, "\\\\E", "\\\\E\\\\\\\\E\\\\Q"), F.lit("\\E"))
    first, last = F.substring(quote, 1, 1), F.substring(quote, -1, 1)
    return F.concat(
        F.when(first.rlike("[\\p{L}\\p{N}]"), "(?<![\\p{L}\\p{N}_])").otherwise(""),
        F.when(first.rlike("\\p{Nd}"), "(?<!\\p{Nd}[.,])").otherwise(""),
        literal,
        F.when(last.rlike("[\\p{L}\\p{N}]"), "(?![\\p{L}\\p{N}_])").otherwise(""),
        F.when(last.rlike("\\p{Nd}"), "(?![.,]\\p{Nd})").otherwise(""),
    )


def found_at(text: Column, quote: Column) -> Column:
    """Place of the quote in the text from 1; 0 if it isn't there. Only texts that hold it literally meet the regular expression."""
    return F.when(text.contains(quote), F.regexp_instr(text, pattern(quote))).otherwise(0)


def quote_line(at: Column, starts: Column) -> Column:
    """The line that a place (from 1) lies in: the last one that begins no later."""
    return F.array_max(F.filter(starts, lambda s: s["start"] < at))["line"]


def line_intervals(indexed: DataFrame, *keys: str) -> DataFrame:
    """keys, line, start, end of every line of chunk_index()'s rows that has text: the places of norm (from 0) that are the line's, in long form."""
    piece = lambda s, i: F.struct(s["line"].alias("line"), s["start"].alias("start"), F.coalesce(F.get("starts", i + 1)["start"], F.length("norm") + 1).alias("end"))
    return indexed.select(*keys, F.inline(F.transform("starts", piece)))


def quote_lines(hits: DataFrame, indexed: DataFrame, *keys: str) -> DataFrame:
    """hits (keys, at from 0, ...) with the line that each lies in: quote_line() for places and lines as rows, where no row has a chunk's lines together."""
    return interval_join(hits, line_intervals(indexed, *keys), list(keys)).drop("start", "end")


def with_hits(claims: DataFrame, indexed: DataFrame, place: str = "request_id") -> DataFrame:
    """claims (request_id, block_no, claim_no, search, ...) and hit: path, is_code and pos of the first chunk of the block that holds search; null if none does.

    One shuffle, by block: the grouping by claim that picks the first chunk keeps the partitioning of the join. `place`: what names the chunks' blocks, where
    several requests share them: that column of claims, and request_id of the chunks.
    """
    unit = F.col("unit") if "unit" in indexed.columns else F.lit(None).cast("string")
    chunk = indexed.select(F.col("request_id").alias(place), "block_no", "path", "ord", "part", "first_line", "is_code", "norm", "starts", unit.alias("unit"))
    rest = [c for c in claims.columns if c not in ("request_id", "block_no", "claim_no", place)]
    rows = claims.join(chunk, [place, "block_no"], "left").withColumn("at", found_at(F.col("norm"), F.col("search")))
    found = F.col("at") > 0
    line = F.when(found, F.col("first_line") + quote_line(F.col("at"), F.col("starts")))
    rows = rows.select("request_id", "block_no", "claim_no", F.struct(*rest).alias("own"), F.when(found, F.struct("ord", "part")).alias("order"), F.struct("path", "is_code", "unit", F.struct("ord", line.alias("line")).alias("pos")).alias("place"))
    return rows.groupBy("request_id", "block_no", "claim_no").agg(F.first("own").alias("own"), F.min_by("place", "order").alias("hit")).select("request_id", "block_no", "claim_no", "own.*", "hit")


def locate_quotes(claims: DataFrame, indexed: DataFrame) -> DataFrame:
    """For each claim (request_id, block_no, claim_no, search) that is found: the first chunk of its block that holds it, and the line there."""
    return with_hits(claims.select("request_id", "block_no", "claim_no", "search"), indexed).where("hit IS NOT NULL").drop("search")


def _subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def verify(claims: DataFrame, chunks: DataFrame, requests: DataFrame, unit: str = "línea", place: str = "request_id") -> DataFrame:
    """claims with path, location, pos, quote as shown, and reason: null if verified, otherwise the first check that fails.

    chunks (request_id, block_no, path, ord, part, first_line, lines, is_code, and unit where locations of a file have one of their own) and claims meet by block, whose size the budget bounds; numbers
    and words are looked at only where the quote has been found. `place`: see with_hits(). Bullets that say nothing is stated have the reason SKIPPED.
    """
    asked = requests.select("request_id", "question")
    ready = claims.withColumn("shown", clean_quote(F.col("quote"))).withColumn("search", normalize(F.col("shown")))
    ready = ready.withColumn(
        "early",
        F.when(is_not_stated(F.col("claim")), SKIPPED).when(F.col("search") == "", "sin_cita").when(F.size(F.split("search", " ")) < LEAST_QUOTE_WORDS, "cita_corta"),
    )
    ready = ready.withColumn("search", F.when(F.col("early").isNull(), F.col("search")))
    both = with_hits(ready, chunk_index(chunks), place).join(asked, "request_id", "left")
    # Checks of what was found, on columns that are null for the rest, so that the costly ones are skipped there.
    claim, quote = F.when(F.col("hit").isNotNull(), F.col("claim")), F.when(F.col("hit").isNotNull(), F.col("quote"))
    code = F.col("hit.is_code")
    numbers = F.when(code, _subset(digit_strings(claim), digit_strings(quote))).otherwise(_subset(numeric_values(F.when(~code, claim)), numeric_values(F.when(~code, quote))))
    both = both.withColumn("__numbers", numbers).withColumn("__stems", stems(content_words(quote)))
    support = F.coalesce(covered(content_words(claim), F.col("__stems")) >= LEAST_COVERAGE, F.lit(False))
    on_topic = touches(content_words(F.coalesce("question", F.lit(""))), F.col("__stems"))
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("hit").isNull(), "cita_no_encontrada")
        .when(~F.col("__numbers"), "cifras_no_respaldadas")
        .when(~code & ~support, "cita_no_respalda")
        .when(~code & ~on_topic, "cita_ajena")
    )
    out = both.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.select(
        "request_id", "block_no", "claim_no", "claim", F.col("shown").alias("quote"), "reason",
        F.when(ok, F.col("hit.path")).alias("path"),
        F.when(ok, F.concat(F.coalesce("hit.unit", F.lit(unit)), F.lit(" "), (F.col("hit.pos.line") + 1).cast("string"))).alias("location"),
        F.when(ok, F.col("hit.pos")).alias("pos"),
    )
