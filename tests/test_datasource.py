"""Files as a data source."""

import io
import zipfile

import pytest

from quotelens.functions.text import extension, lines
from quotelens.sources.datasource import extension_of, grouped, read_text, register
from quotelens.sources.files import BINARY, INVALID, LINE, READERS, TOO_LARGE, decoded
from pyspark.sql import functions as F


def test_groups_hold_every_file_once_within_their_bytes():
    files = [(f"{k:03}", (k * 37) % 90) for k in range(200)] + [("big", 5000)]
    groups = grouped(files, 300)
    assert sorted(f for g in groups for f in g) == sorted(files)
    assert all(sum(n + 1 for _, n in g) <= 300 or len(g) == 1 for g in groups)
    assert max(len(g) for g in grouped([(str(k), 0) for k in range(1000)], 100)) <= 100
    assert grouped([], 10) == []


def test_python_rules_equal_those_of_columns(spark):
    names = ["a.TXT", ".hidden", "..x.y", "d.e/f", "a.b.C", "end.", "x/.a.b"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(extension(F.col("p"))).collect()
    assert [r[0] for r in rows] == [extension_of(n) for n in names]
    raw = [b"", b"a", b"a\n", b"a\r\nb\n\n", "x\u2028y\x85".encode(), b"\xff\xfea\nb", b"\n"]
    rows = spark.createDataFrame([(bytearray(x),) for x in raw], "c binary").select(lines(decoded(F.col("c")))).collect()
    assert [r[0] for r in rows] == [read_text(x) for x in raw]


def test_one_bad_file_stops_nothing(spark, tmp_path):
    def own(content):
        raise LookupError(content)

    (tmp_path / "sub").mkdir()
    (tmp_path / "_no").mkdir()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("else", "x")
    for name, content in {"a.txt": b"one\ntwo", "sub/b.txt": b"a\0b", "c.docx": buffer.getvalue(), "d.own": b"x", "e.txt": b"", "_no/f.txt": b"no", ".g.txt": b"no", "h.txt": b"long" * 100}.items():
        (tmp_path / name).write_bytes(content)
    name = register(spark, READERS | {".own": (own, LINE)}, "lines_of_a_test")
    for group in (10, 1 << 20):
        df = spark.read.format(name).option("groupBytes", group).option("maxBytes", 350).load(str(tmp_path))
        got = sorted((r["path"].rsplit("/", 1)[-1], r["text"], r["location"], r["reason"]) for r in df.collect())
        assert got == [
            ("a.txt", "one", "línea 1", None), ("a.txt", "two", "línea 2", None), ("b.txt", None, None, BINARY), ("c.docx", None, None, INVALID),
            ("d.own", None, None, "no se pudo extraer el texto (LookupError)"), ("h.txt", None, None, TOO_LARGE),
        ]
    assert spark.read.format(name).option("groupBytes", 10).load(str(tmp_path)).rdd.getNumPartitions() > 1
    (tmp_path / "empty").mkdir()
    assert spark.read.format(name).load(str(tmp_path / "empty")).count() == 0


def test_no_path_is_an_error(spark):
    with pytest.raises(Exception, match="needs a folder"):
        spark.read.format(register(spark)).load().count()
