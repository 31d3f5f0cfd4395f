"""Readers: files, or tables with a text column, to lines with their locations; what can't be read gets a reason instead."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..batches import small_batches
from ..functions.text import extension, lines

# Locations, reasons, bytes looked at for a NUL, the largest member of a zip file.
LINE, PARAGRAPH = "línea", "párrafo"
BINARY, INVALID, TOO_LARGE = "formato binario no soportado", "no es un documento válido", "es demasiado grande para leerlo"
MISSING = "no existe"
PROBE, MEMBER_MOST = 8192, 50 * 1024 * 1024
# HTML tags that break lines, that add a space, that have no text.
BREAKING = frozenset("""
    p div br li tr h1 h2 h3 h4 h5 h6 section article header footer table ul ol blockquote pre dt dd hr title nav main aside
    figure figcaption thead tbody tfoot caption details summary form address dl
""".split())
CELLS, SILENT = frozenset(("td", "th")), frozenset(("script", "style"))
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ODT_NS = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"

RESULT = StructType([StructField("lines", ArrayType(StringType())), StructField("reason", StringType())])


def binary(content: Column) -> Column:
    return F.position(F.lit(b"\x00"), F.substring(content, 1, PROBE)) > 0


def decoded(content: Column) -> Column:
    """UTF-8 with bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def located(df: DataFrame, lines_column: str, unit: str | Column = LINE) -> DataFrame:
    """One row for each line: line_index from 0, text, location."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    rest = [c for c in df.columns if c != lines_column]
    out = df.select(*rest, unit.alias("__unit"), F.posexplode(lines_column).alias("line_index", "text"))
    return out.select(*rest, "line_index", "text", F.concat("__unit", F.lit(" "), (F.col("line_index") + 1).cast("string")).alias("location"))


def text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines of a text column; a text with a NUL among its first bytes is binary and has none. Other columns come along."""
    rest = [c for c in df.columns if c != text]
    plain = df.where(~F.coalesce(binary(F.col(text).cast("binary")), F.lit(False)))
    return located(plain.select(*rest, lines(F.col(text)).alias("__lines")), "__lines")


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def _tag(self, tag: str, step: int) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent + step)
        elif tag in BREAKING:
            self.out.append("\n")
        elif tag in CELLS and step > 0:
            self.out.append(" ")

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def _squeezed(texts) -> list[str]:
    return [t for t in (" ".join(x.split()) for x in texts) if t]


def read_html(content: bytes) -> list[str]:
    parser = _Html()
    parser.feed("\n".join(content.decode("utf-8", "replace").splitlines()))
    parser.close()
    return _squeezed("".join(parser.out).split("\n"))


class Unreadable(Exception):
    """A file that a reader gives up on; the message is its reason."""


def _member(content: bytes, name: str) -> ElementTree.Element:
    """The XML in a zip file's member. Whatever is wrong with the archive (no zip file, member missing, encrypted, packed in an unknown way or damaged) or with the XML makes the file invalid."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        size = archive.getinfo(name).file_size
    except Exception as e:  # noqa: BLE001
        raise Unreadable(INVALID) from e
    if size > MEMBER_MOST:
        raise Unreadable(TOO_LARGE)
    try:
        packed = archive.read(name)
        return ElementTree.fromstring(packed)
    except (RecursionError, MemoryError):
        raise
    except Exception as e:  # noqa: BLE001
        raise Unreadable(INVALID) from e


def _paragraphs(root: ElementTree.Element, tags: set[str], render: Callable) -> Iterator[str]:
    """Outermost elements of those tags in document order; what lies within one belongs to it."""
    waiting = list(reversed(root))
    while waiting:
        element = waiting.pop()
        if element.tag in tags:
            yield render(element)
        else:
            waiting.extend(reversed(element))


def _word_text(paragraph: ElementTree.Element) -> str:
    breaks = {WORD_NS + "tab", WORD_NS + "br"}
    return "".join(" " if e.tag in breaks else e.text or "" for e in paragraph.iter() if e.tag in breaks or e.tag == WORD_NS + "t")


def _odt_text(paragraph: ElementTree.Element) -> str:
    def inside(e: ElementTree.Element) -> Iterator[str]:
        yield e.text or ""
        for child in e:
            if child.tag == ODT_NS + "s":
                times = child.get(ODT_NS + "c", "1")
                yield " " * min(100, max(0, int(times) if re.fullmatch(r"\s*[+-]?\d+\s*", times) else 1))
            elif child.tag in (ODT_NS + "tab", ODT_NS + "line-break"):
                yield " "
            else:
                yield from inside(child)
            yield child.tail or ""

    return "".join(inside(paragraph))


def read_docx(content: bytes) -> list[str]:
    return _squeezed(_paragraphs(_member(content, "word/document.xml"), {WORD_NS + "p"}, _word_text))


def read_odt(content: bytes) -> list[str]:
    return _squeezed(_paragraphs(_member(content, "content.xml"), {ODT_NS + "p", ODT_NS + "h"}, _odt_text))


#: Extension to (function from bytes to lines, unit of locations). Callers add their own; what has none is text.
READERS: dict[str, tuple[Callable[[bytes], list[str]], str]] = {".html": (read_html, LINE), ".htm": (read_html, LINE), ".docx": (read_docx, PARAGRAPH), ".odt": (read_odt, PARAGRAPH)}


def outcome(read: Callable[[bytes], list[str]], content: bytes) -> tuple[list[str] | None, str | None]:
    """What a reader makes of a file, and no reason; or nothing and a reason, whatever it raises or gives instead of a list of texts."""
    try:
        found = [None if x is None else str(x) for x in read(content)]
        return [None if x is None else x.encode("utf-8", "replace").decode() for x in found], None
    except Exception as e:  # noqa: BLE001
        own = str(e) if isinstance(e, Unreadable) or str(e) in (BINARY, INVALID, TOO_LARGE) else ""
        return None, own or f"no se pudo extraer el texto ({type(e).__name__})"


def helper(readers: dict[str, Callable[[bytes], list[str]]]):
    """Readers as one vectorized function of (extension, content) to struct<lines, reason>, by outcome(). Null content gives nulls."""

    def one(kind, content):
        if content is None:
            return None, None
        return outcome(lambda raw: readers[kind](raw), bytes(content))

    @F.pandas_udf(RESULT)
    def run(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(k, c) for k, c in zip(kind, content, strict=True)], columns=["lines", "reason"])

    return run


def html_lines(df: DataFrame, html: str = "html") -> DataFrame:
    """Lines of an HTML column. Other columns come along; null has none."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != html]
    read = df.where(F.col(html).isNotNull()).select(*rest, helper({"": read_html})(F.lit(""), F.col(html).cast("binary"))["lines"].alias("__lines"))
    return located(read, "__lines")


def read_all(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """files (path, content binary, ...) without their content: lines with their unit, or a reason, which is null for what has been read. One bad file stops nothing."""
    small_batches(files.sparkSession)
    readers = READERS if readers is None else readers
    rest = [c for c in files.columns if c != "content"]
    rows = files.withColumn("__kind", extension(F.col("path")))
    own = F.col("__kind").isin(list(readers))
    # Text and what is decoded as text must not be binary; only what has a reader of its own goes to Python, in one pass over all files.
    decodes = ~own | F.col("__kind").isin([k for k, (read, _) in readers.items() if read is read_html])
    rows = rows.withColumn("__bad", F.col("content").isNull() | decodes & binary(F.col("content")))
    read = helper({k: f for k, (f, _) in readers.items()})
    rows = rows.withColumn("__read", F.when(own, read(F.col("__kind"), F.when(own & ~F.col("__bad"), F.col("content")))))
    unit = F.lit(LINE)
    for kind, (_, name) in readers.items():
        unit = F.when(F.col("__kind") == kind, name).otherwise(unit)
    return rows.select(
        *rest,
        F.when(own, F.col("__read.lines")).when(~F.col("__bad"), lines(decoded(F.col("content")))).alias("lines"),
        unit.alias("unit"),
        F.when(F.col("content").isNull(), INVALID).when(F.col("__bad"), BINARY).when(own, F.col("__read.reason")).alias("reason"),
    )


def extract(files: DataFrame, readers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable) of read_all(): each reads the files for itself."""
    done = read_all(files, readers)
    return done.where("reason IS NULL").drop("reason"), done.where("reason IS NOT NULL").drop("lines", "unit")


def office_lines(files: DataFrame) -> DataFrame:
    """Paragraphs of .docx and .odt files (path, content)."""
    read, _ = extract(files.where(extension(F.col("path")).isin(".docx", ".odt")))
    return located(read.drop("unit"), "lines", PARAGRAPH)


def _there(spark: SparkSession, paths: tuple[str, ...]) -> list[str]:
    def there(path: str) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        return found is not None and len(found) > 0

    return [p for p in paths if there(p)]


#: Bytes of a file that is read as one row: what such a row costs is a few times as much.
ROW_MOST = 256 * 1024 * 1024


def read_files(spark: SparkSession, *paths: str, most: int = ROW_MOST) -> DataFrame:
    """path, content of files, folders or patterns, of files of at most so many bytes; larger ones have no row here (see read_documents()). What is not there has no row; the requests that name it get the reason MISSING."""
    some = _there(spark, paths)
    if not some:
        return spark.createDataFrame([], "path string, content binary")
    # The filter is pushed to the reader, which then doesn't open larger files.
    return spark.read.format("binaryFile").load(some).where(F.col("length") <= most).select("path", "content")


def too_large(spark: SparkSession, *paths: str, readers: dict | None = None, most: int = ROW_MOST) -> DataFrame:
    """(path, reason) of files that are too large for a row and have a reader of their own, which takes a file whole. Lengths are listed; no content is read."""
    kinds, some = list(READERS if readers is None else readers), _there(spark, paths)
    if not some:
        return spark.createDataFrame([], "path string, reason string")
    large = spark.read.format("binaryFile").load(some).where(F.col("length") > most).select("path")
    return large.where(extension(F.col("path")).isin(kinds)).select("path", F.lit(TOO_LARGE).alias("reason"))


def read_documents(spark: SparkSession, *paths: str, readers: dict | None = None, most: int = ROW_MOST) -> tuple[DataFrame, DataFrame]:
    """(lines, unreadable) of files of any size: lines (path, line_index long, text, location), reasons (path, reason).

    Files of at most `most` bytes are read a row each, larger texts in splits by many tasks; a larger file of another format is TOO_LARGE. One bad file stops nothing.
    """
    from .big import read_big_lines

    documents, bad = extract(read_files(spark, *paths, most=most), readers)
    small = located(documents, "lines", F.col("unit")).select("path", F.col("line_index").cast("long").alias("line_index"), "text", "location")
    some = _there(spark, paths)
    if not some:
        return small, bad
    large = read_big_lines(spark, *some, above=most, without=list(READERS if readers is None else readers))
    return small.unionByName(large.lines), bad.select("path", "reason").unionByName(too_large(spark, *paths, readers=readers, most=most)).unionByName(large.unreadable)


CASE = "archivo string, pregunta string, tipo string, esperado array<string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of evaluation cases as file, question, type, expected."""
    raw = spark.read.schema(CASE).option("multiLine", True).json(path)
    return raw.select(F.col("archivo").alias("file"), F.col("pregunta").alias("question"), F.col("tipo").alias("type"), F.coalesce("esperado", F.array().cast("array<string>")).alias("expected"))
