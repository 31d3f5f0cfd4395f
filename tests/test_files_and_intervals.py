"""Files of any size and kind, and places in intervals, against plain Python."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quotelens.operators.intervals import interval_join
from quotelens.queries import _odt, _word, _zip
from quotelens.sources import files
from quotelens.sources.big import read_big_lines


@pytest.fixture
def tiny_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(raw: bytes):
    if b"\0" in raw[:8192]:
        return files.BINARY
    return raw.decode("utf-8", "replace").splitlines()


def some_text(rng, n):
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\r\r\n", "\n\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\x1f"]
    return "".join(rng.choice(["añ", "😀", "x y", "", "línea ", "\ufeff"]) * rng.randint(0, 9) + rng.choice(ends) for _ in range(n))


def test_big_files(spark, tmp_path, tiny_splits):
    rng = random.Random(4)
    contents = {f"r{k}.txt": some_text(rng, rng.choice([1, 2, 40, 400])).encode() for k in range(12)}
    contents |= {
        "empty.txt": b"", "one.txt": b"x", "feed.txt": b"\n", "cr.txt": b"a\r", "crlf.txt": b"a\r\nb\r\n", "vt.txt": b"a\x0b", "vt feed.txt": b"a\x0b\n", "only vt.txt": b"\x0b", "vt cr.txt": b"a\x0b\r", "sep.txt": "a\u2028".encode(),
        "mark.txt": "\ufeffa\nb".encode(), "mark end.txt": "\ufeffa\nb\n".encode(), "mark only.txt": "\ufeffa".encode(), "bad.txt": b"a\xff\xfe\xc3\nb\xe2\x82", "100% + ñ.txt": b"a\nb", "long line.txt": b"y" * 5000 + b"\r\n" + b"z" * 3000,
        "nul first.txt": b"\0", "nul in time.txt": b"ab\n" * 2730 + b"c\0d\n", "nul at end of probe.txt": b"x" * 8191 + b"\0", "nul too late.txt": b"x" * 8192 + b"\0\ny", "nul later.txt": b"ab\n" * 2731 + b"\0\n", "nul and mark.txt": "\ufeff".encode() + b"x" * 8188 + b"\0", "nul after mark.txt": "\ufeff".encode() + b"x" * 8189 + b"\0",
    }
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    big = read_big_lines(spark, str(tmp_path))
    got = {}
    for row in big.lines.collect():
        got.setdefault(row["path"].rsplit("/", 1)[1], {})[row["line_index"]] = row["text"]
        assert row["location"] == f"línea {row['line_index'] + 1}"
    bad = {r["path"].rsplit("/", 1)[1] for r in big.unreadable.collect()}
    for name, raw in contents.items():
        want = plain(raw)
        if want == files.BINARY:
            assert name in bad and name not in got, name
        else:
            assert name not in bad and [got.get(name, {}).get(k) for k in range(len(got.get(name, {})))] == want, name
    # Paths are those that whole files have.
    paths = {r["path"] for r in files.read_files(spark, str(tmp_path)).select("path").collect()}
    assert {r["path"] for r in big.lines.select("path").distinct().collect()} <= paths


def test_big_files_are_read_by_many_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "a.txt").write_bytes(b"line of text\r\n" * 2000)
    big = read_big_lines(spark, str(tmp_path))
    assert big.lines.count() == 2000
    raw = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 20


def test_documents_of_any_size(spark, tmp_path, tiny_splits):
    """Small and large files of all kinds in one call: the large texts by splits, large files of other kinds with a reason."""
    text = "uno\r\ndos\u2028tres\n" * 300
    (tmp_path / "small.txt").write_bytes(b"a\nb")
    (tmp_path / "large.txt").write_bytes(text.encode())
    (tmp_path / "small.docx").write_bytes(_zip("word/document.xml", _word("p q\n\nr")))
    (tmp_path / "large.docx").write_bytes(b"PK" + b"x" * 3000)
    (tmp_path / "small.bin").write_bytes(b"\0")
    (tmp_path / "large.bin").write_bytes(b"\0" + b"x" * 3000)
    lines, bad = files.read_documents(spark, str(tmp_path), str(tmp_path / "not there"), most=1000)
    got = sorted((r["path"].rsplit("/", 1)[1], r["line_index"], r["text"], r["location"]) for r in lines.collect())
    want = [("small.txt", 0, "a", "línea 1"), ("small.txt", 1, "b", "línea 2"), ("small.docx", 0, "p q", "párrafo 1"), ("small.docx", 1, "r", "párrafo 2")]
    assert got == sorted(want + [("large.txt", k, t, f"línea {k + 1}") for k, t in enumerate(text.splitlines())])
    assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()) == [("large.bin", files.BINARY), ("large.docx", files.TOO_LARGE), ("small.bin", files.BINARY)]


FAULTS = ["damaged", "encrypted", "unknown method", "too large"]


def test_readers_never_end_a_job(spark):
    class Odd(BaseException):
        pass

    def raises(kind):
        def read(content):
            raise kind("x")

        return read

    kinds = {f".e{k}": (raises(e), files.LINE) for k, e in enumerate([zlib.error, RuntimeError, NotImplementedError, OSError, UnicodeError, ZeroDivisionError, StopIteration])}
    kinds |= {".none": (lambda content: None, files.LINE), ".number": (lambda content: [1, None, "\ud800"], files.LINE)}
    rows = [(f"{f}.docx", bytearray(_zip("word/document.xml", _word("text"), f))) for f in FAULTS] + [(f"{f}.odt", bytearray(_zip("content.xml", _odt("text"), f))) for f in FAULTS]
    rows += [(f"x{k}", bytearray(b"x")) for k in kinds] + [("nothing.odt", bytearray(b"")), ("null.docx", None), ("good.odt", bytearray(_zip("content.xml", _odt("a  b\n\nc"))))]
    good, bad = files.extract(spark.createDataFrame(rows, "path string, content binary"), files.READERS | kinds)
    reasons = {r["path"]: r["reason"] for r in bad.collect()}
    for kind in (".docx", ".odt"):
        assert [reasons[f"{f}{kind}"] for f in FAULTS] == [files.INVALID] * 3 + [files.TOO_LARGE]
    assert {reasons[f"x{k}"] for k in kinds if k.startswith(".e")} == {f"no se pudo extraer el texto ({e})" for e in ("error", "RuntimeError", "NotImplementedError", "OSError", "UnicodeError", "ZeroDivisionError", "StopIteration")}
    assert reasons["x.none"] == "no se pudo extraer el texto (TypeError)" and reasons["nothing.odt"] == reasons["null.docx"] == files.INVALID
    lines = {r["path"]: r["lines"] for r in good.collect()}
    assert lines == {"good.odt": ["a b", "c"], "x.number": ["1", None, "?"]}


def test_interval_join(spark):
    rng = random.Random(9)
    intervals = [(k % 3, a, a + n, k) for k in range(300) for a, n in [(rng.randint(-50, 5000), rng.choice([0, 1, 1, 2, 3, 7, 8, 9, 64, 1000, 4096, -5]))]]
    intervals += [(1, -(1 << 62), (1 << 62) - 1, 900), (None, 0, 9, 901), (1, None, 5, 902), (1, 5, None, 903), (2, (1 << 62), (1 << 62) + 1, 904)]
    points = [(k % 3, rng.randint(-60, 5200), k) for k in range(400)] + [(1, 5, 5), (1, 5, 5), (None, 3, 1), (2, None, 2), (2, 1 << 62, 3)]
    p = spark.createDataFrame(points, "g int, at long, id int")
    i = spark.createDataFrame(intervals, "g int, start long, end long, own int")
    joined = interval_join(p, i, ["g"])
    want = sorted((g, at, n, own) for g, at, n in points for h, a, b, own in intervals if None not in (g, at, a, b) and g == h and a <= at < b)
    assert sorted(map(tuple, joined.select("g", "at", "id", "own").collect())) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|CartesianProduct", plan)
    assert interval_join(p, i.where("false"), ["g"]).count() == 0
    assert set(joined.columns) == {"g", "at", "id", "start", "end", "own"}


def test_interval_join_makes_few_rows(spark):
    """However long an interval is, it goes into two cells at the most."""
    i = spark.createDataFrame([(0, 0, 10**15), (0, 1, 2)], "g int, start long, end long")
    p = spark.range(1000).select(F.lit(0).alias("g"), (F.col("id") * 10**12).alias("at"))
    assert interval_join(p, i, ["g"]).count() == 1000


def test_big_file_lines_over_several_files(spark, monkeypatch):
    """Lines are numbered over all files, and no task writes more than a file."""
    from quotelens import queries

    whole = sorted(queries.big_file_lines(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(queries, "FILE_BYTES", 100_000)
    folders = []
    made = queries.new_folder
    monkeypatch.setattr(queries, "new_folder", lambda *x: folders.append(made(*x)) or folders[-1])
    assert sorted(queries.big_file_lines(spark, "/root/testdata/sf0.001").collect()) == whole
    assert spark.read.format("binaryFile").load(f"{folders[0]}/*.txt").count() > 3
