"""The library's registered queries: each operator over inputs derived from the whole tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
from html import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import fixtures as fx
from .functions.numbers import numeric_values as numbers_of
from .functions.text import clean_quote, content_words, covered, digit_strings, is_code, lines, normalize, stems, tokens, touches, wrap
from .lineage import cut, new_folder, remove_folder
from .jobs.evaluation import evaluate as evaluate_cases
from .jobs.grounded import to_prompts, to_reports, to_summary
from .operators import chunking, codecheck, evaluate, prompts, report, reuse, search, verify
from .operators.passages import PassageIndex
from .operators.store import AnswerStore
from .sources import files, sinks
from .sources.big import read_big_lines
from .sources.datasource import register
from .streaming.answers import answer_stream as start_answers
from .streaming.answers import stored
from .streaming.verification import verify_stream as start_stream


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.text_lines(fx.documents(spark, sf_dir).select("doc_id", "text"))


def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.html_lines(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


@F.pandas_udf(BinaryType())
def _docx(text: pd.Series) -> pd.Series:
    """A text as a Word file, one paragraph a line."""

    def one(t: str) -> bytes:
        out = io.BytesIO()
        body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in (t or "").split("\n"))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD_NS[1:-1]}"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    return text.map(one)


def office_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.documents(spark, sf_dir)
    made = docs.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), _docx("text").alias("content"))
    return files.office_lines(made).select("doc_id", "line_index", "text", "location")


def _as_html(text: Column) -> Column:
    """A text as HTML gives it back, with a break for each line end."""
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, by turns as text, as text with a NUL, as HTML and as a broken Word file: lines counted, reasons given."""
    docs, turn = fx.documents(spark, sf_dir), F.col("doc_id") % 4
    path = F.concat(F.col("doc_id").cast("string"), F.when(turn == 2, ".HTM").when(turn == 3, ".docx").otherwise(".txt"))
    content = F.when(turn == 1, F.concat(F.lit("a\0"), F.col("text"))).when(turn == 2, F.concat(F.lit("<p>"), _as_html(F.col("text")), F.lit("</p><script>x</script>"))).otherwise(F.col("text"))
    good, bad = files.extract(docs.select("doc_id", path.alias("path"), content.cast("binary").alias("content")))
    good = good.select("doc_id", "path", F.size("lines").alias("n_lines"), "unit", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.select("doc_id", "path", F.lit(None).cast("int").alias("n_lines"), F.lit(None).cast("string").alias("unit"), "reason"))


def _zip(name: str, body: str, fault: str = "") -> bytes:
    """A zip file with one member, sound or with one fault."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    raw = bytearray(out.getvalue())
    central, data = raw.rindex(b"PK\x01\x02"), 30 + len(name)
    if fault == "damaged":
        raw[data] = 0x07  # a kind of block that deflate doesn't have
    elif fault == "encrypted":
        raw[6] |= 1
        raw[central + 8] |= 1
    elif fault == "unknown method":
        raw[8], raw[central + 10] = 99, 99
    elif fault == "too large":
        raw[central + 24 : central + 28] = (files.MEMBER_MOST + 1).to_bytes(4, "little")
    return bytes(raw)


def _word(text: str) -> str:
    return f'<w:document xmlns:w="{files.WORD_NS[1:-1]}"><w:body>' + "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n")) + "</w:body></w:document>"


def _odt(text: str) -> str:
    return f'<o:doc xmlns:o="o" xmlns:t="{files.ODT_NS[1:-1]}">' + "".join(f"<t:p>{escape(x)}</t:p>" for x in text.split("\n")) + "</o:doc>"


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as office files, by turns sound (Word, then OpenDocument) and with each fault that an archive can have; all in one run. The caller's reader raises what no reader should."""
    faults = ["", "", "damaged", "encrypted", "unknown method", "too large", "no archive", "no member", "no XML", "raises"]

    @F.pandas_udf(BinaryType())
    def made(turn: pd.Series, text: pd.Series) -> pd.Series:
        def one(k: int, t: str | None) -> bytes:
            t, fault = t or "", faults[k]
            if k == 1:
                return _zip("content.xml", _odt(t))
            if fault in ("no archive", "raises"):
                return t.encode()
            return _zip("word/other.xml" if fault == "no member" else "word/document.xml", t if fault == "no XML" else _word(t), fault)

        return pd.Series([one(int(k), t) for k, t in zip(turn, text, strict=True)])

    def own(content: bytes) -> list[str]:
        raise LookupError(len(content))

    docs, turn = fx.documents(spark, sf_dir), (F.col("doc_id") % len(faults)).cast("int")
    path = F.concat(F.col("doc_id").cast("string"), F.when(turn == 1, ".odt").when(turn == 9, ".own").otherwise(".docx"))
    good, bad = files.extract(docs.select("doc_id", path.alias("path"), made(turn, F.col("text")).alias("content")), files.READERS | {".own": (own, files.LINE)})
    good = good.select("doc_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("text"), "unit", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(bad.select("doc_id", F.lit(None).cast("int").alias("n_lines"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("unit"), "reason"))


def _marked(content: bytes) -> list[str]:
    """A caller's own reader."""
    return [f"| {x}" for x in content.decode().split("\n")]


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents a file, by turns Word, OpenDocument, HTML, text, a format of the caller's and no valid Word file, read by the data source in groups of files."""
    folder, kinds = new_folder(spark, "source"), [".docx", ".odt", ".html", ".txt", ".own", ".docx"]

    def write(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        text = "\n".join(x or "" for x in group.sort_by("doc_id").column("text").to_pylist())
        turn = bucket % len(kinds)
        html = "<p>" + escape(text, quote=False).replace("\n", "<br>") + "</p><script>x</script>"
        made = (lambda: _zip("word/document.xml", _word(text)), lambda: _zip("content.xml", _odt(text)), html.encode, text.encode, text.encode, text.encode)[turn]()
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/{bucket}{kinds[turn]}", compression=None) as out:  # a task that is run again writes the same
            out.write(made)
        return pa.table({"bucket": pa.array([bucket], pa.int64())})

    docs = fx.documents(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 50).cast("long").alias("bucket"), "text")
    docs.groupBy("bucket").applyInArrow(write, "bucket long").count()
    name = register(spark, files.READERS | {".own": (_marked, files.PARAGRAPH)})
    read = spark.read.format(name).option("groupBytes", 1 << 20).load(folder)
    return read.select(F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("long").alias("bucket"), "line_index", "text", "location", "reason")


#: Bytes of a file of big_file_lines, about: a task writes it, many tasks read it.
FILE_BYTES = 512 * 1024 * 1024


def big_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents one after the other in text files of FILE_BYTES, with line ends of three kinds by turns, read in splits and numbered over all files in order."""
    folder = new_folder(spark, "big-file")
    ends = F.when(F.col("doc_id") % 3 == 0, "\r\n").when(F.col("doc_id") % 3 == 1, "\u2028").otherwise("\n")
    docs = fx.documents(spark, sf_dir).select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), ends).alias("value"))
    size = docs.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    dealt = docs.repartitionByRange(size // FILE_BYTES + 1, "doc_id")
    dealt.sortWithinPartitions("doc_id").select("value").write.text(folder)  # names of files are in the order of ranges
    found = read_big_lines(spark, f"{folder}/*.txt").lines
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    begins = found.groupBy("path").agg(F.count("*").alias("n")).select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    index = F.col("begin") + F.col("line_index")
    return found.join(F.broadcast(begins), "path").select(index.alias("line_index"), "text", F.concat(F.lit(files.LINE + " "), (index + 1).cast("string")).alias("location"))


def wrapped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.derived(spark, sf_dir, fx.FILES)
    whole = wrap(F.col("path"), F.col("content"))
    return rows.select("doc_id", is_code(F.col("path")).alias("is_code"), tokens(whole).alias("tokens"), F.sha2(whole, 256).alias("wrapped"))


def large_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecheck.large_sources(fx.derived(spark, sf_dir, fx.FILES), 12)


def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, rejected = chunking.request_budget(fx.derived(spark, sf_dir, fx.REQUESTS), 90, 40, 40)
    return ready.select("request_id", "question_tokens", "budget", F.lit("").alias("reason")).unionByName(rejected.select("request_id", "question_tokens", "budget", "reason"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.derived(spark, sf_dir, fx.FILES).withColumn("lines", lines(F.col("content")))
    return chunking.chunk_lines(rows, fx.BUDGET)


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("request_id", "ord", "part", "parts", "first_line", F.size("lines").alias("n_lines"), "tokens", "is_code", F.sha2("wrapped", 256).alias("wrapped"))


def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pack_blocks(_chunks(spark, sf_dir), fx.BUDGET).select("request_id", "ord", "part", "block_no")


def pack_one_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the files of one request, packed in ranges."""
    rows = fx.derived(spark, sf_dir, fx.ONE_REQUEST).withColumn("lines", lines(F.col("content")))
    return chunking.pack_blocks(chunking.chunk_lines(rows, fx.BUDGET), fx.BUDGET).select("ord", "part", "block_no")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.build_blocks(chunking.pack_blocks(_chunks(spark, sf_dir), fx.BUDGET))


def build_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("request_id", "block_no", "is_code", F.size("chunks").alias("n_chunks"), F.sha2("text", 256).alias("text"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.render_prompts(prompts.route_model(_blocks(spark, sf_dir), "reads-code", "reads-text"), fx.derived(spark, sf_dir, fx.REQUESTS))


def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("request_id", "block_no", "model", F.sha2("system", 256).alias("system"), F.sha2("user", 256).alias("user"))


def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body, read back field by field."""
    body = F.col("body")
    field = lambda path: F.get_json_object(body, path)
    return prompts.request_json(_prompts(spark, sf_dir), 1024, 0.5).select(
        "request_id", "block_no", field("$.model").alias("model"), field("$.temperature").cast("double").alias("temperature"), field("$.max_tokens").cast("int").alias("max_tokens"),
        field("$.stream").alias("stream"), field("$.messages[0].role").alias("first_role"), F.sha2(field("$.messages[1].content"), 256).alias("user"),
    )


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.parse_responses(fx.derived(spark, sf_dir, fx.ENVELOPES)).select("request_id", "block_no", "status", "content", "finish_reason")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.parse_claims(fx.derived(spark, sf_dir, fx.RESPONSES))


def parse_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("request_id", "claim_no", "claim", "quote")


def flag_unformatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.flag_unformatted(fx.derived(spark, sf_dir, fx.RESPONSES), _claims(spark, sf_dir)).select("request_id", "reason")


def quote_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, shown form, words and digits of whole texts between marks."""
    line = F.concat(F.lit(" …*“"), F.col("text"), F.lit("”_.. "))
    return fx.documents(spark, sf_dir).select(
        "doc_id", normalize(line).alias("norm"), clean_quote(line).alias("shown"), F.array_join(content_words(line), " ").alias("words"),
        F.array_join(F.array_sort(digit_strings(F.col("text"))), " ").alias("digits"),
    )


def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the first half of each document's text by the second, and whether they share a stem."""
    half = F.expr("length(text) div 2").cast("int")
    one, two = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    rows = fx.documents(spark, sf_dir).select("doc_id", content_words(one).alias("one"), stems(content_words(two)).alias("two"))
    return rows.select("doc_id", F.round(covered(F.col("one"), F.col("two")), 9).alias("coverage"), touches(F.col("one"), F.col("two")).alias("touches"))


def document_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, shown form and words of whole texts."""
    text = F.concat(F.lit(" …*“"), F.col("text"), F.lit("”_.. "))
    return fx.documents(spark, sf_dir).select(
        "doc_id", F.sha2(normalize(text), 256).alias("norm"), F.sha2(clean_quote(text), 256).alias("shown"), F.sha2(F.array_join(content_words(text), " "), 256).alias("words")
    )


def line_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each line by the next one of its document, and whether they share a stem."""
    rows = fx.documents(spark, sf_dir).select("doc_id", F.transform(lines(F.col("text")), content_words).alias("words"))
    pair = lambda w, k: F.struct(k.alias("line"), w.alias("one"), F.get("words", k + 1).alias("two"))
    pairs = rows.select("doc_id", F.inline(F.slice(F.transform("words", pair), F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))))
    return pairs.select("doc_id", "line", F.round(covered(F.col("one"), stems(F.col("two"))), 9).alias("coverage"), touches(F.col("one"), stems(F.col("two"))).alias("touches"))


def numeric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's characters, counted: the number in Spanish words, in digits with dots, and a fraction."""

    @F.pandas_udf("string")
    def spelt(n: pd.Series) -> pd.Series:
        return n.map(fx.number_phrase)

    n = F.length("text") + F.col("doc_id")
    text = F.concat(F.lit("hay "), spelt((n % 1000000).cast("long")), F.lit(", o sea "), F.translate(F.format_number(n + 1000000, 0), ",", "."), F.lit("; tres quintos, 0"), (F.col("doc_id") % 7 + 1).cast("string"), F.lit(" / 8 y la mitad"))
    return fx.documents(spark, sf_dir).select("doc_id", F.array_join(numbers_of(text), " ").alias("found"))


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that stand in each document, whole texts, of any length."""
    return fx.documents(spark, sf_dir).select("doc_id", F.array_join(numbers_of(F.col("text")), " ").alias("found"))


def _chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derived(spark, sf_dir, fx.CHUNKS).withColumn("lines", lines(F.col("text")))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verify(_claims(spark, sf_dir), _chunk_table(spark, sf_dir), fx.derived(spark, sf_dir, fx.QUESTIONS))


def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("request_id", "claim_no", "quote", "reason", "path", "location")


def locate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir).withColumn("search", normalize(clean_quote(F.col("quote")))).where("search <> ''")
    hits = verify.locate_quotes(claims, verify.chunk_index(_chunk_table(spark, sf_dir)))
    return hits.select("request_id", "claim_no", "hit.path", F.col("hit.pos.line").alias("line"))


def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What locate_quotes gives, with places and lines as rows that meet in an interval join."""
    claims = _claims(spark, sf_dir).withColumn("search", normalize(clean_quote(F.col("quote")))).where("search <> ''")
    indexed = verify.chunk_index(_chunk_table(spark, sf_dir))
    hits = claims.join(indexed.select("request_id", "block_no", "path", "norm"), ["request_id", "block_no"]).withColumn("at", verify.found_at(F.col("norm"), F.col("search")) - 1)
    hits = hits.where("at >= 0").select("request_id", "block_no", "path", "claim_no", "at")
    return verify.quote_lines(hits, indexed, "request_id", "block_no", "path").select("request_id", "claim_no", "path", "line")


def passage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents in which the passages begin that locate_in_corpus finds."""
    docs = fx.documents(spark, sf_dir)
    hits = search.locate_in_corpus(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs)
    indexed = verify.chunk_index(docs.select("doc_id", lines(F.col("text")).alias("lines")))
    return verify.quote_lines(hits.withColumn("at", F.col("position") - 1), indexed, "doc_id").select("item_id", "doc_id", "line")


def _reports(spark: SparkSession, sf_dir: str):
    return to_reports(fx.derived(spark, sf_dir, fx.RESPONSES), _chunk_table(spark, sf_dir), fx.derived(spark, sf_dir, fx.QUESTIONS))


def tally_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).rejections.groupBy("reason").agg(F.sum("n").alias("n"))


def dedupe_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified claim three times, in other blocks and between marks: one of each stays."""
    verdicts = cut(_verdicts(spark, sf_dir))  # read three times
    again = verdicts.withColumn("block_no", F.col("block_no") + 1).withColumn("quote", F.concat(F.lit("*"), "quote", F.lit("* ")))
    return report.dedupe_verified(verdicts.unionByName(again).unionByName(verdicts.withColumn("block_no", F.lit(7)))).select("request_id", "block_no", "claim_no", "path", "quote")


def compose_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).reports


def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims about all documents as one request's, with every eleventh document among its unread files: its report in parts of 2,000 characters."""
    one, ids = F.lit(0).cast("long").alias("request_id"), F.col("request_id")
    verdicts = cut(_verdicts(spark, sf_dir).withColumn("pos", F.struct(ids.cast("int").alias("ord"), F.col("pos.line").alias("line"))).withColumn("block_no", ids.cast("int")).withColumn("request_id", one))
    off = verify.flag_unformatted(fx.derived(spark, sf_dir, fx.RESPONSES), _claims(spark, sf_dir)).withColumn("request_id", one)
    rows = fx.derived(spark, sf_dir, fx.FILES).where("doc_id % 11 = 5")
    unread = rows.select(one, F.col("doc_id").cast("int").alias("ord"), "path", F.lit("no existe").alias("reason"))
    request = spark.range(1).select(F.col("id").alias("request_id"))
    return report.report_parts(request, report.dedupe_verified(verdicts), report.tally_rejections(verdicts, off), unread, 2000).select("section", "part", F.sha2("text", 256).alias("text"))


def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.derived(spark, sf_dir, fx.FILES)
    answers = fx.derived(spark, sf_dir, fx.REQUESTS).select("request_id", F.col("question").alias("report"))
    return report.token_savings(rows, answers, _blocks(spark, sf_dir))


def no_readable_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which only every fourth has a block; its files are unreadable by name."""
    requests = fx.derived(spark, sf_dir, fx.REQUESTS)
    rows = fx.derived(spark, sf_dir, fx.FILES).where("ord < 3").select("request_id", "ord", "path", F.lit("no existe").alias("reason"))
    return report.no_readable_input(requests, requests.where("request_id % 80 = 0"), rows)


def locate_in_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_in_corpus(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), fx.documents(spark, sf_dir))


def passage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two thirds of the documents, searched; then of all of them, searched again."""
    index = PassageIndex(spark, new_folder(spark, "passages"))
    docs, quotes = fx.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    index.add(docs.where("doc_id % 3 < 2"))
    first = cut(index.locate(quotes).withColumn("search", F.lit(1)))
    index.add(docs.where("doc_id % 3 = 2"))
    return first.unionByName(index.locate(quotes).withColumn("search", F.lit(2)))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.answer_key(fx.derived(spark, sf_dir, fx.REQUESTS), _blocks(spark, sf_dir), None, "end", "reads-text", "reads-code", 1024, 0.5)


def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir)


def split_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that knows every third request, twice, as its question was answered then."""
    keys = _keys(spark, sf_dir)
    requests = fx.derived(spark, sf_dir, fx.REQUESTS)
    known = keys.join(requests, "request_id").where("request_id % 60 = 0")
    old, new = (known.select("key", F.concat(F.lit(t), "question").alias("report"), F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp").alias("written_at")) for t, d in (("old ", 1), ("new ", 2)))
    hits, misses = reuse.split_cached(keys, old.unionByName(new))
    return hits.select("request_id", "report").unionByName(misses.select("request_id", F.lit(None).cast("string").alias("report")))


def to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that may be kept: those without a response out of form."""
    responses = fx.derived(spark, sf_dir, fx.RESPONSES)
    keys = responses.select("request_id", F.sha2(F.col("request_id").cast("string"), 256).alias("key"))
    reports = responses.select("request_id", F.col("content").alias("report"))
    kept = reuse.to_store(keys, reports, verify.flag_unformatted(responses, _claims(spark, sf_dir)), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return kept.select("key", F.sha2("report", 256).alias("report"))


def prune_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return reuse.prune_store(events.select(F.sha2(F.col("event_id").cast("string"), 256).alias("key"), F.col("ts").alias("written_at")), 500).select("key")


def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store filled in three steps from all events, then pruned to half of them: what a reader from before still reads, and what a new one does."""
    store = AnswerStore(spark, new_folder(spark, "store"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("key"), F.col("event_type").alias("report"), F.col("ts").alias("written_at"))
    for part in range(3):
        store.append(rows.where(F.col("event_id") % 3 == part))
    old = store.read()
    store.prune(events.count() // 2)
    before, after = (df.select("key", F.lit(True).alias(name)) for df, name in ((old, "before"), (store.read(), "after")))
    return rows.select("key").join(before, "key", "left").join(after, "key", "left").select("key", F.coalesce("before", F.lit(False)).alias("before"), F.coalesce("after", F.lit(False)).alias("after"))


def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, variants = (spark.createDataFrame([(x,) for x in values], f"{name} string") for name, values in (("model", ("m1", "m2")), ("variant", ("end", "start"))))
    return evaluate.run_matrix(fx.derived(spark, sf_dir, fx.CASES).select("case_id", "type"), models, variants)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = fx.derived(spark, sf_dir, fx.CASES).withColumn("expected", F.array(F.concat(F.lit("**"), "expected", F.lit("** "))))
    return evaluate.score_runs(fx.derived(spark, sf_dir, fx.REPORTS).join(cases, "case_id"))


def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("case_id", "model", "variant", "ok", "discarded", "unformatted")


def summarize_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = fx.derived(spark, sf_dir, fx.CASES).withColumn("expected", F.array(F.concat(F.lit("**"), "expected", F.lit("** "))))
    return to_summary(fx.derived(spark, sf_dir, fx.REPORTS).join(cases, "case_id"))


def respond(batch: pd.DataFrame) -> pd.Series:
    """A stand-in for models. careful quotes the question's words if the files hold them; careless claims something else, or talks, or answers in no form at all."""

    def one(model: str, variant: str, user: str) -> str:
        words = re.search(r"^Question: (.*)\?$", user, re.M)[1].strip()
        path, text = re.search(r'<file path="([^"]*)"[^>]*>\n(.*)</file>', user, re.S).groups()
        if words not in text:
            said = "NO CONSTA"
        elif model.startswith("careful"):
            said = f"- {words}\n  > {words}"
        elif variant == "start":
            said = f"They say {words}"
        elif int(re.search(r"(\d+)\.\w+$", path)[1]) % 11 == 5:
            return '{"choices": []}'
        else:
            said = f"- alpha omega gamma delta\n  > {words}"
        return json.dumps({"choices": [{"message": {"content": said}, "finish_reason": "stop"}]})

    return pd.Series([one(*row) for row in zip(batch["model"], batch["variant"], batch["user"], strict=True)])


#: Two models with room for every document, and one whose window no question leaves anything of.
EVALUATED_PROFILES = [("careful", "careful", "careful-code", 1_000_000, 1024, 1024, 0.0), ("careless", "careless", "careless-code", 1_000_000, 512, 1024, 0.5), ("tiny", "careful", "careful", 1024, 512, 512, 0.0)]


def _evaluation(spark: SparkSession, sf_dir: str):
    cases = fx.derived(spark, sf_dir, fx.EVALUATED).withColumn("expected", F.array("expected"))
    return evaluate_cases(cases, fx.derived(spark, sf_dir, fx.EVALUATED_FILES).withColumn("content", F.col("content").cast("binary")), spark.createDataFrame(EVALUATED_PROFILES, prompts.PROFILES), ["end", "start"], respond)


def evaluate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation, from cases and files through a responder: every run's report, error and score."""
    columns = ["case_id", "model", "variant", "ok", "discarded", "unformatted", "error", F.sha2("report", 256).alias("report"), "calls"]
    return _evaluation(spark, sf_dir).runs.select(*columns)


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation, summed up."""
    return _evaluation(spark, sf_dir).summary.drop("seconds")


def triage_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecheck.triage_code(fx.derived(spark, sf_dir, fx.CODE)).select("doc_id", "status", "n_lines", "code")


def code_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecheck.triage_code(fx.derived(spark, sf_dir, fx.CODE)).groupBy("status").agg(F.count("*").alias("n"))


def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A responder that says how long its prompt is."""
    return prompts.answer_blocks(_prompts(spark, sf_dir), lambda batch: "n " + batch["user"].str.len().astype(str))


def read_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as JSON lists of a thousand and read again; every third lacks what is expected."""
    path = new_folder(spark, "cases")
    rows = fx.derived(spark, sf_dir, fx.CASES).select(F.floor(F.col("case_id") / 1000).alias("bucket"), F.col("case_id").cast("string").alias("archivo"), F.concat(F.lit("¿"), "expected").alias("pregunta"), F.col("type").alias("tipo"), F.when(F.col("type") != evaluate.NO_ANSWER, F.array("expected")).alias("esperado"))
    lists = rows.groupBy("bucket").agg(F.to_json(F.collect_list(F.struct("archivo", "pregunta", "tipo", "esperado"))).alias("value"))
    lists.write.partitionBy("bucket").text(path)
    return files.read_cases(spark, path).select("file", "question", "type", F.concat_ws("|", "expected").alias("expected"))


def write_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every output table written, dumps by model and variant, and its rows counted."""
    path, done = new_folder(spark, "outputs"), _reports(spark, sf_dir)
    dumps = fx.derived(spark, sf_dir, fx.REPORTS).select("model", "variant", "case_id", "report")
    sinks.write_outputs(path, done.reports, done.kept, done.rejections, None, dumps)
    counts = [(name, spark.read.parquet(f"{path}/{name}")) for name in ("reports", "verified", "rejections")] + [("dumps", spark.read.json(f"{path}/dumps"))]
    out = None
    for name, rows in counts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def verify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that arrive in two files, the second with blocks of the first again: verdicts counted by reason."""
    base = new_folder(spark, "stream")
    responses = fx.derived(spark, sf_dir, fx.RESPONSES)
    chunks, requests = _chunk_table(spark, sf_dir), fx.derived(spark, sf_dir, fx.QUESTIONS)
    for part in (responses.where("request_id % 3 < 2"), responses.where("request_id % 3 > 0")):
        part.write.mode("append").parquet(f"{base}/in")
        start_stream(spark, f"{base}/in", chunks, requests, f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/out/verdicts").groupBy("reason").agg(F.count("*").alias("n"))


def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two blocks that arrive in five files over hours: blocks apart, twice, hours late, once more after they are forgotten, and requests that never become complete; the third file's batch is done twice. Every report once, null for a request that expired."""
    base = new_folder(spark, "answers")
    ids, minutes = F.col("request_id"), lambda m: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * m))
    first = fx.derived(spark, sf_dir, fx.RESPONSES)
    second = first.withColumn("block_no", F.lit(1)).withColumn("content", F.lit("NO CONSTA"))
    never = (ids % 3 == 2) & (ids % 7 == 3)
    files_of = [
        (0, first.where(ids % 3 < 2).unionByName(second.where(ids % 3 == 0))),
        (30, second.where(ids % 3 == 1).unionByName(first.where(ids % 3 == 0))),
        (240, first.where(ids % 3 == 2).unionByName(second.where((ids % 3 == 2) & ~never))),
        (5, first.where(ids % 3 == 0).unionByName(second.where(ids % 3 == 0))),  # long before the watermark
        (600, first.where((ids % 3 == 1) & (ids % 8 != 6)).unionByName(second.where((ids % 3 == 1) & (ids % 8 != 6)))),  # known from the store
    ]
    key = F.sha2(ids.cast("string"), 256).alias("key")
    requests = fx.derived(spark, sf_dir, fx.QUESTIONS).select("request_id", "question", key, F.lit(2).alias("n_blocks"))
    chunks = _chunk_table(spark, sf_dir)

    def run() -> None:
        start_answers(spark, f"{base}/in", chunks, requests, f"{base}/store", f"{base}/out", f"{base}/log").awaitTermination()

    for number, (at, rows) in enumerate(files_of):
        rows.withColumn("arrived", minutes(at)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run()
        if number == 2:  # as if the driver had stopped before it noted that the last batch was done
            last = max(int(r["batch"]) for r in spark.read.parquet(f"{base}/out/reports").select("batch").distinct().collect())
            remove_folder(spark, f"{base}/log/commits/{last}")
            run()
    reports = spark.read.parquet(f"{base}/out/reports").select("request_id", "report")
    gone = spark.read.schema("request_id long, block_no int, content string").parquet(f"{base}/out/expired").select("request_id", F.lit(None).cast("string").alias("report"))
    kept = stored(spark, f"{base}/store").groupBy("key").agg(F.count("*").alias("times"))
    return reports.unionByName(gone).withColumn("key", key).join(kept, "key", "left").select("request_id", "report", F.coalesce("times", F.lit(0)).alias("times_stored"))


def unread_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over requests of twenty files each, of which some are binary and some are not there: reports name them, with their reasons."""
    rows = fx.derived(spark, sf_dir, fx.FILES)
    paths = rows.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))
    requests = fx.derived(spark, sf_dir, fx.REQUESTS).join(paths, "request_id")
    content = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("a\0"), F.col("content"))).otherwise(F.col("content"))
    documents, unreadable = files.extract(rows.where("doc_id % 11 <> 5").select("path", content.cast("binary").alias("content")))
    work = to_prompts(requests, documents, unreadable=unreadable)
    responses = work.blocks.select("request_id", "block_no", F.lit("NO CONSTA").alias("content"))
    reports = to_reports(responses, work.chunks, requests, work.unread).reports
    return reports.join(work.failed, "request_id", "left").select("request_id", "report", "reasons")


def office_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over Word files: locations are paragraphs."""
    docs = fx.documents(spark, sf_dir)
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".docx"))
    documents, unreadable = files.extract(docs.select(path.alias("path"), _docx("text").alias("content")))
    questions = fx.derived(spark, sf_dir, fx.QUESTIONS)
    requests = questions.withColumn("paths", F.array(F.concat(F.col("request_id").cast("string"), F.lit(".docx"))))
    work = to_prompts(requests, documents, unreadable=unreadable)
    # A request has one response, about any of its lines, and a long file several blocks.
    return verify.verify(_claims(spark, sf_dir), chunking.whole_files(work.chunks), questions).select("request_id", "claim_no", "quote", "reason", "path", "location")


NAMES = """
    text_lines html_lines office_lines extract wrapped_files large_sources request_budget chunk_lines pack_blocks build_blocks
    render_prompts request_json parse_responses parse_claims flag_unformatted quote_forms document_forms word_overlap line_overlap numeric_values
    locate_quotes verify_claims tally_rejections dedupe_verified compose_report token_savings no_readable_input locate_in_corpus
    answer_key split_cached to_store prune_store run_matrix score_runs summarize_runs triage_code code_statuses answer_blocks read_cases write_outputs verify_stream
    unread_report office_report broken_files big_file_lines quote_lines passage_lines evaluate_runs evaluation_summary answer_stream store_snapshots passage_index report_parts pack_one_request source_lines
""".split()


#: Queries without SQL, which tests hold against brute-force versions.
BEYOND_SQL = ["document_numbers"]


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def queries_beyond_sql() -> dict:
    return {name: globals()[name] for name in BEYOND_SQL}
