"""Sources, chunking, verification, reports, reuse, evaluation, triage and streaming on small rows of our own."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quotelens.batches import BATCH_ROWS
from quotelens.jobs.grounded import Profile, split_known, to_prompts, to_reports
from quotelens.operators import chunking, codecheck, evaluate, prompts, report, reuse, search, verify
from quotelens.sources import files
from quotelens.sources.sinks import write_outputs
from quotelens.streaming.verification import verify_stream

DOC = ["Artículo 4. La junta se reúne dos veces al año.", "Sus acuerdos requieren mayoría simple de los", "miembros presentes y 1.500 votos."]


def zipped(member: str, xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(member, xml)
    return out.getvalue()


def test_extract_formats_and_reasons(spark):
    word = f'<w:document xmlns:w="{files.WORD_NS[1:-1]}"><w:body><w:p><w:r><w:t>Uno  a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>celda</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    odt = f'<o xmlns:text="{files.ODT_NS[1:-1]}"><text:h>T</text:h><text:p>a<text:s text:c="3"/>b<text:line-break/>c</text:p><text:p>x<text:p>in</text:p>y</text:p></o>'
    rows = [
        ("a.md", "línea\nb\r\n".encode()), ("b.TXT", b"x\0y"), ("c.html", b"<title>t</title><p>a<br>b&amp;c<td>d</td><script>no</script><!-- n -->"), ("d.docx", zipped("word/document.xml", word)),
        ("e.odt", zipped("content.xml", odt)), ("f.docx", b"nothing"), ("g.docx", zipped("other", "x")), ("h.weird", b"\xff ok"), ("i.md", b""),
    ]
    good, bad = files.extract(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["path"]: (r["lines"], r["unit"]) for r in good.collect()}
    assert got == {
        "a.md": (["línea", "b"], "línea"), "c.html": (["t", "a", "b&c d"], "línea"), "d.docx": (["Uno a b", "celda"], "párrafo"),
        "e.odt": (["T", "a b c", "xiny"], "párrafo"), "h.weird": (["� ok"], "línea"), "i.md": ([], "línea"),
    }
    assert {r["path"]: r["reason"] for r in bad.collect()} == {"b.TXT": files.BINARY, "f.docx": files.INVALID, "g.docx": files.INVALID}
    assert [r["location"] for r in files.located(good.where("path = 'd.docx'").drop("unit"), "lines", "párrafo").orderBy("line_index").collect()] == ["párrafo 1", "párrafo 2"]


def test_read_files_and_cases(spark, tmp_path):
    (tmp_path / "x.md").write_text("a\nb")
    (tmp_path / "cases.json").write_text(json.dumps([{"archivo": "x.md", "pregunta": "¿a?", "tipo": "dato", "esperado": ["a"]}, {"archivo": "y", "pregunta": "q", "tipo": "sin_respuesta"}]))
    assert files.read_files(spark, f"{tmp_path}/*.md").count() == 1
    assert [(r["type"], r["expected"]) for r in files.read_cases(spark, f"{tmp_path}/cases.json").orderBy("file").collect()] == [("dato", ["a"]), ("sin_respuesta", [])]


def documents(spark, rows):
    return spark.createDataFrame(rows, "request_id long, path string, ord int, lines array<string>")


def test_chunks_keep_all_lines_and_fit(spark):
    rows = [(1, "a.md", 0, [f"line {i} " + "x" * (i % 50) for i in range(300)]), (1, "b.py", 1, ["y" * 5000, "z"]), (1, "c.md", 2, []), (2, "d.md", 0, ["short"])]
    chunks = chunking.chunk_lines(documents(spark, rows), 200)
    got = chunks.orderBy("request_id", "ord", "part").collect()
    for request, path, _, lines in rows:
        own = [r for r in got if (r["request_id"], r["path"]) == (request, path)]
        assert [x for r in own for x in r["lines"]] == lines
        assert all(r["first_line"] == sum(len(p["lines"]) for p in own[:k]) for k, r in enumerate(own))
        assert all(r["tokens"] <= 200 or len(r["lines"]) == 1 for r in own)
        assert len(own) == own[0]["parts"]
    assert 'lines="1-1" part="1/2"' in [r for r in got if r["path"] == "b.py"][0]["wrapped"]
    assert [r["wrapped"] for r in got if r["path"] == "c.md"] == ['<file path="c.md">\n</file>\n']
    packed = chunking.pack_blocks(chunks, 200)
    blocks = chunking.build_blocks(packed).orderBy("request_id", "block_no").collect()
    one = [b for b in blocks if b["request_id"] == 1]
    assert [b["block_no"] for b in one] == list(range(len(one)))
    assert [b["is_code"] for b in one] == sorted(b["is_code"] for b in one)
    assert "".join(b["text"] for b in one) == "".join(r["wrapped"] for r in sorted((r for r in got if r["request_id"] == 1), key=lambda r: (r["is_code"], r["ord"], r["part"])))


def test_fill_lets_an_oversized_one_go_alone():
    assert chunking.fill([5, 1, 1, 9, 1], 3) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert chunking.fill([], 3) == []


def test_responses_and_statuses(spark):
    bodies = ['{"choices":[{"message":{"content":" x "},"finish_reason":"stop"}]}', '{"choices":[{"message":{"content":null,"reasoning":"r"}}]}', '{"choices":[]}', "junk", None, '{"choices":[{"message":{"content":""},"finish_reason":"length"}]}']
    rows = prompts.parse_responses(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).orderBy("i").collect()
    assert [(r["status"], r["content"]) for r in rows] == [("ok", "x"), ("reasoning only", None), ("malformed", None), ("malformed", None), ("malformed", None), ("empty", None)]


def run_checks(spark, content, question="¿Cuántas veces se reúne la junta?", path="ley.md", lines=DOC):
    responses = spark.createDataFrame([(1, 0, content)], "request_id long, block_no int, content string")
    chunks = spark.createDataFrame([(1, 0, path, 0, 1, 0, path.endswith(".py"), lines)], "request_id long, block_no int, path string, ord int, part int, first_line int, is_code boolean, lines array<string>")
    requests = spark.createDataFrame([(1, question)], "request_id long, question string")
    return to_reports(responses, chunks, requests)


GOOD = "  > La junta se reúne dos veces al año"


@pytest.mark.parametrize(
    ("content", "reasons"),
    [
        (f"- La junta se reúne dos veces al año\n{GOOD}", [None]),
        ("1. Mayoría simple de miembros presentes\n  > mayoría SIMPLE de los miembros…", ["cita_ajena"]),
        (f"- La junta se reúne 3 veces al año\n{GOOD}", ["cifras_no_respaldadas"]),
        (f"- La junta se reúne tres veces al año\n{GOOD}", ["cifras_no_respaldadas"]),
        ("- sin cita", ["sin_cita"]),
        ("- corta\n> dos veces", ["cita_corta"]),
        ("- otra\n> la junta nunca se reúne", ["cita_no_encontrada"]),
        ("- votos\n> presentes y 1.50", ["cita_no_encontrada"]),
        ("- votos\n> acuerdos requieren mayor", ["cita_no_encontrada"]),
        (f"- el presidente nombra ministros siempre\n{GOOD}", ["cita_no_respalda"]),
        ("- **NO CONSTA**.", ["no consta"]),
        ("No consta", []),
        (f"intro\n- La junta se reúne\n\n  dos veces al año\n> La junta se reúne\n>> dos veces\n- b\n{GOOD}", [None, "cita_no_respalda"]),
    ],
)
def test_verdicts(spark, content, reasons):
    rows = run_checks(spark, content).verdicts.orderBy("claim_no").collect()
    assert [r["reason"] for r in rows] == reasons


def test_code_compares_digits_only(spark):
    lines = ["def f():", "    return a, b  # two values here"]
    for claim, reason in (("devuelve dos valores", None), ("devuelve 2 valores", "cifras_no_respaldadas")):
        assert [r["reason"] for r in run_checks(spark, f"- {claim}\n> return a, b # two values", path="x.py", lines=lines).verdicts.collect()] == [reason]


def test_locations_and_report(spark):
    out = run_checks(spark, f"- La junta se reúne dos veces al año\n{GOOD}.\n- Mayoría simple de los miembros\n> mayoría simple de los miembros\n- la junta\n- x\n> a b", question="junta miembros")
    assert out.reports.collect()[0]["report"] == (
        "- La junta se reúne dos veces al año\n  > La junta se reúne dos veces al año\n  (ley.md:línea 1)\n"
        "- Mayoría simple de los miembros\n  > mayoría simple de los miembros\n  (ley.md:línea 2)\n\n"
        "Descartadas 2 afirmaciones: 1 sin cita, 1 con cita de menos de 3 palabras."
    )
    again = report.dedupe_verified(out.verdicts.unionByName(out.verdicts.withColumn("block_no", F.col("block_no") + 1)))
    assert again.count() == out.kept.count() == 2
    silent = run_checks(spark, "prosa sin formato")
    assert silent.reports.collect()[0]["report"] == "No consta en los documentos.\n\n1 respuesta sin el formato pedido."


def test_boundaries_search_on_past_a_bad_match(spark):
    rows = spark.createDataFrame([("xa b c a b c", "a b c"), ("21.500 votos; 1.500 votos", "1.500 votos"), ("\\e x \\e y z", "\\e y z"), ("a_b c d", "b c d")], "t string, q string")
    assert [r[0] for r in rows.select(verify.found_at(F.col("t"), F.col("q"))).collect()] == [8, 15, 6, 0]


def test_corpus_search_equals_plain_search(spark):
    docs = spark.createDataFrame([(1, "uno dos tres cuatro"), (2, "Uno, «dos»\ntres"), (3, "xuno dos tres"), (4, "dos tres"), (5, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "uno dos tres"), (2, "dos tres"), (3, "nada de esto"), (4, " . "), (5, None)], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in search.locate_in_corpus(quotes, docs).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (2, 3), (2, 4)} - {(2, 2)} | ({(2, 2)} if "dos tres" in "uno, dos tres" else set())
    assert search.locate_in_corpus(quotes, docs.limit(0)).count() == 0


def test_reuse(spark):
    requests = spark.createDataFrame([(1, "q"), (2, "q")], "request_id long, question string")
    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "ab"), (2, 1, "")], "request_id long, block_no int, text string")
    base = {r["request_id"]: r["key"] for r in reuse.answer_key(requests, blocks).collect()}
    assert base[1] != base[2]
    for change in ({"variant": "v"}, {"document_model": "m"}, {"code_model": "m"}, {"output": 1}, {"temperature": 0.1}):
        assert {r["key"] for r in reuse.answer_key(requests, blocks, **change).collect()}.isdisjoint(base.values())
    unread = spark.createDataFrame([(1, 0, "p", "no existe")], "request_id long, ord int, path string, reason string")
    other = {r["request_id"]: r["key"] for r in reuse.answer_key(requests, blocks, unread).collect()}
    assert other[1] != base[1]
    store = spark.createDataFrame([(f"k{i}", "r", i) for i in range(6)], "key string, report string, t int").select("key", "report", F.timestamp_seconds("t").alias("written_at"))
    assert {r["key"] for r in reuse.prune_store(store, 3).collect()} == {"k3", "k4", "k5"}
    assert reuse.prune_store(store, 0).count() == 0


def test_reports_are_scored_by_quotes(spark):
    rows = [("dato", ["«El Año»"], "- x\n  > en el año 3\n  (p:1)", None), ("dato", ["año 4"], "- año 4\n  > en el año 3\n  (p:1)", None), ("dato", [], "x", None), ("sin_respuesta", [], "No consta en los documentos.", None), ("sin_respuesta", [], "No consta en los documentos.\n\n2 respuestas sin el formato pedido.", None), ("dato", [], "", "fallo")]
    runs = spark.createDataFrame([(i, "m", "v", *r, 1.5, 2) for i, r in enumerate(rows)], "i int, model string, variant string, type string, expected array<string>, report string, error string, seconds double, calls long")
    scored = evaluate.score_runs(runs).orderBy("i").collect()
    assert [r["ok"] for r in scored] == [True, False, True, True, False, False]
    assert scored[4]["unformatted"] == 2
    total = {r["type"]: r for r in evaluate.summarize_runs(evaluate.score_runs(runs)).collect()}
    assert (total[None]["hits"], total[None]["runs"], total["dato"]["hits"], total[None]["errors"], total[None]["seconds"]) == (3, 6, 2, 1, 9.0)


CODE = {
    "```python\nx = 1\n```": ("ok", 1), "```\nx = 1": ("ok", 1), "x = '''\n```\n'''\n": ("ok", 3), "```\na = 1\n```\ngracias": (codecheck.OUTSIDE, 0), "": ("empty", 0), "```\n```": ("empty", 0),
    '"""doc"""\nmain()': ("ok", 2), "def f(:": (codecheck.INVALID, 0), "return 1": (codecheck.INVALID, 0), "x = 1\nListo": (codecheck.STRAY, 0), "x = 1\n'late'": (codecheck.STRAY, 0), "# only": ("ok", 1),
    '```\nd = """\n```\ninner\n```\n"""\n```': ("ok", 5),
}


def test_code_triage(spark):
    rows = spark.createDataFrame([(k,) for k in CODE] + [(None,)], "text string")
    got = {r["text"]: (r["status"], r["n_lines"]) for r in codecheck.triage_code(rows).collect()}
    assert got == CODE | {None: ("empty", 0)}


def test_large_sources(spark):
    rows = spark.createDataFrame([("a.py", "x\n" * 400), ("b.md", "x\n" * 400), ("c.py", "x\r\n" * 350), ("d.py", "x\x0c" * 900)], "path string, content string")
    for threshold in (350, "x", 0, None):
        assert [(r["path"], r["n_lines"]) for r in codecheck.large_sources(rows, threshold).collect()] == [("a.py", 400)]


def test_documents_to_reports_with_a_responder(spark, tmp_path):
    requests = spark.createDataFrame([(1, "¿Cuándo se reúne la junta?", ["ley.md", "x.py"]), (2, "q" * 40000, ["ley.md"])], "request_id long, question string, paths array<string>")
    out = to_prompts(requests, spark.createDataFrame([("ley.md", DOC), ("x.py", ["a = 1"])], "path string, lines array<string>"), Profile(window=2500, output=500, reserve=500))
    assert [r["request_id"] for r in out.rejected.collect()] == [2]
    bodies = [json.loads(r["body"]) for r in out.prompts.orderBy("block_no").collect()]
    assert [b["model"] for b in bodies] == ["documents", "code"]
    assert bodies[0]["messages"][1]["content"].index("Artículo") < bodies[0]["messages"][1]["content"].index("Question: ¿Cuándo")
    answers = prompts.answer_blocks(out.prompts, lambda p: p["user"].map(lambda u: "- La junta se reúne dos veces al año\n> La junta se reúne dos veces al año" if "Artículo" in u else "NO CONSTA"))
    done = to_reports(answers, out.chunks, requests)
    texts = {r["request_id"]: r["report"] for r in done.reports.collect()}
    assert texts[1].endswith("(ley.md:línea 1)") and texts[2] == "No consta en los documentos."
    write_outputs(str(tmp_path), done.reports, done.kept, done.rejections)
    assert spark.read.parquet(f"{tmp_path}/verified").count() == 1


def test_stream_counts_redelivered_blocks_once(spark, tmp_path):
    chunks = spark.createDataFrame([(i, 0, "ley.md", 0, 1, 0, False, DOC) for i in (1, 2)], "request_id long, block_no int, path string, ord int, part int, first_line int, is_code boolean, lines array<string>")
    requests = spark.createDataFrame([(1, "junta"), (2, "junta")], "request_id long, question string")
    for ids in ((1,), (1, 2), (2,)):
        spark.createDataFrame([(i, 0, f"- La junta se reúne dos veces al año\n{GOOD}") for i in ids], "request_id long, block_no int, content string").write.mode("append").parquet(f"{tmp_path}/in")
        verify_stream(spark, f"{tmp_path}/in", chunks, requests, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/verdicts").collect()
    assert sorted((r["request_id"], r["reason"]) for r in rows) == [(1, None), (2, None)]


def test_stream_gives_the_same_verdicts_when_a_batch_is_done_again(spark, tmp_path):
    """As if the driver had died after the batch's output was written and before it was committed."""
    chunks = spark.createDataFrame([(i, 0, "ley.md", 0, 1, 0, False, DOC) for i in (1, 2, 3)], "request_id long, block_no int, path string, ord int, part int, first_line int, is_code boolean, lines array<string>")
    requests = spark.createDataFrame([(i, "junta") for i in (1, 2, 3)], "request_id long, question string")

    def arrive(*ids):
        spark.createDataFrame([(i, 0, f"- La junta se reúne dos veces al año\n{GOOD}") for i in ids], "request_id long, block_no int, content string").write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        verify_stream(spark, f"{tmp_path}/in", chunks, requests, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
        return sorted((r["batch"], r["request_id"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out/verdicts").collect())

    arrive(1)
    run()
    arrive(1, 2)
    want = run()
    assert want == [(0, 1, None), (1, 2, None)]
    for name in ("1", ".1.crc"):
        (tmp_path / "log" / "commits" / name).unlink()
    assert run() == want
    arrive(2, 3)
    assert run() == [*want, (2, 3, None)]


def test_budgets_savings_and_unreadable(spark):
    ready, rejected = chunking.request_budget(spark.createDataFrame([(1, "q"), (2, "q" * 100)], "request_id long, question string"), 100, 50, 30)
    assert ([r["budget"] for r in ready.collect()], rejected.count()) == ([19], 1)
    contents = spark.createDataFrame([(1, "x" * 400)], "request_id long, content string")
    savings = report.token_savings(contents, spark.createDataFrame([(1, "y" * 40)], "request_id long, report string"), spark.createDataFrame([(1, 0)], "request_id long, block_no int")).collect()[0]
    assert (savings["direct"], savings["reported"], savings["percent"], savings["blocks"]) == (100, 10, 90.0, 1)
    unread = spark.createDataFrame([(2, 1, "b", "r2"), (2, 0, "a", "r1")], "request_id long, ord int, path string, reason string")
    asked = spark.createDataFrame([(1,), (2,)], "request_id long")
    assert [(r["request_id"], r["reasons"]) for r in report.no_readable_input(asked, asked.where("request_id = 1"), unread).collect()] == [(2, "a: r1; b: r2")]


def test_packing_by_ranges_equals_packing_in_one_go(spark, monkeypatch):
    """A large request beside small ones, in ranges of a few files; blocks go on from range to range."""
    import random

    rng = random.Random(6)
    rows = [(request, f"{i}.{'py' if rng.random() < 0.3 else 'md'}", i, part, rng.choice([1, 7, 30, 90, 130])) for request, n in ((1, 400), (2, 3), (3, 1)) for i in range(n) for part in range(1, rng.randint(2, 4))]
    chunks = spark.createDataFrame(rows, "request_id long, path string, ord int, part int, tokens long").withColumn("is_code", F.col("path").endswith(".py"))
    want = {}
    for request in (1, 2, 3):
        number = -1
        for code in (False, True):
            filled = None
            for _, _, i, part, cost in sorted((r for r in rows if r[0] == request and r[1].endswith(".py") == code), key=lambda r: r[2:4]):
                if filled is None or filled + cost > 100:
                    number, filled = number + 1, 0
                filled += cost
                want[request, i, part] = number
    for size in (5, 1024):
        monkeypatch.setattr(chunking, "RANGE", size)
        assert {(r["request_id"], r["ord"], r["part"]): r["block_no"] for r in chunking.pack_blocks(chunks, 100).collect()} == want


def test_packing_deals_groups_itself(spark):
    """Blocks are numbered on rows dealt for that: the join's own dealing doesn't stand in for it, as a join that turns into a broadcast reads files where they lie."""
    chunks = spark.range(0, 400, 1, 4).select((F.col("id") % 2).alias("request_id"), F.lit("a.md").alias("path"), F.floor(F.col("id") / 2).cast("int").alias("ord"), F.lit(1).alias("part"), F.lit(30).cast("long").alias("tokens"), (F.col("id") < 0).alias("is_code"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        packed = chunking.pack_blocks(chunks, 100)
        plan = packed._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for name in settings:
            spark.conf.unset(name)
    number = next(i for i, line in enumerate(plan) if "MapInPandas" in line)
    below = next(line for line in plan[number:] if "Exchange" in line or "Join" in line)
    assert "Exchange" in below
    assert {(r["request_id"], r["ord"]): r["block_no"] for r in packed.collect()} == {(request, i): i // 3 for request in (0, 1) for i in range(200)}


def test_a_response_about_a_file_in_several_blocks(spark):
    """A quote may lie in any block, or over the end of one."""
    words = [f"uno{i} dos{i} tres{i} cuatro{i}" for i in range(60)]
    documents = spark.createDataFrame([("a.md", words)], "path string, lines array<string>")
    requests = spark.createDataFrame([(1, "uno50 cuatro50", ["a.md"])], "request_id long, question string, paths array<string>")
    work = to_prompts(requests, documents, Profile(window=300, output=50, reserve=50))
    last = work.chunks.where("part = 2").select(F.col("first_line")).first()[0]
    assert work.blocks.count() > 1
    quotes = [words[50], f"tres{last - 1} cuatro{last - 1} uno{last} dos{last}"]
    responses = spark.createDataFrame([(1, 0, "\n".join(f"- {x} \n  > {x}" for x in quotes))], "request_id long, block_no int, content string")
    asked = requests.withColumn("question", F.lit(""))
    found = verify.verify(verify.parse_claims(responses), chunking.whole_files(work.chunks), asked).orderBy("claim_no").collect()
    assert [(r["reason"], r["location"]) for r in found] == [(None, "línea 51"), (None, f"línea {last}")]


def test_readers_get_small_batches(spark):
    """Python sees no more than BATCH_ROWS files at once, whatever the session says."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for make in (lambda: files.extract(spark.createDataFrame([("a.html", b"x")], "path string, content binary")), lambda: files.html_lines(spark.createDataFrame([("x",)], "html string"))):
            spark.conf.set(name, "10000")
            make()
            assert int(spark.conf.get(name)) == BATCH_ROWS
    finally:
        spark.conf.set(name, before)


def test_readers_of_the_callers_own(spark):
    def shouting(content: bytes) -> list[str]:
        if content == b"bad":
            raise ValueError("no pages")
        return content.decode().upper().split("|")

    rows = spark.createDataFrame([("a.pdf", b"one|two"), ("b.PDF", b"bad"), ("c.md", b"plain"), ("d.pdf", None)], "path string, content binary")
    good, bad = files.extract(rows, {**files.READERS, ".pdf": (shouting, "p.")})
    assert {r["path"]: (r["lines"], r["unit"]) for r in good.collect()} == {"a.pdf": (["ONE", "TWO"], "p."), "c.md": (["plain"], "línea")}
    assert {r["path"]: r["reason"] for r in bad.collect()} == {"b.PDF": "no se pudo extraer el texto (ValueError)", "d.pdf": files.INVALID}


def test_unread_files_and_units_reach_the_report(spark, tmp_path):
    (tmp_path / "ley.md").write_text("\n".join(DOC))
    (tmp_path / "x.bin").write_bytes(b"a\0b")
    found, unreadable = files.extract(files.read_files(spark, f"{tmp_path}/ley.md", f"{tmp_path}/x.bin", f"{tmp_path}/absent.md"))
    short = F.concat(F.lit(""), F.element_at(F.split("path", "/"), -1)).alias("path")
    documents, unreadable = found.select(short, "lines", F.lit("párrafo").alias("unit")), unreadable.select(short, "reason")
    requests = spark.createDataFrame([(1, "¿Cuándo se reúne la junta?", ["x.bin", "ley.md", "absent.md"]), (2, "¿junta?", ["x.bin"])], "request_id long, question string, paths array<string>")
    work = to_prompts(requests, documents, unreadable=unreadable)
    assert sorted((r["request_id"], r["ord"], r["path"], r["reason"]) for r in work.unread.collect()) == [(1, 0, "x.bin", files.BINARY), (1, 2, "absent.md", "no existe"), (2, 0, "x.bin", files.BINARY)]
    assert [(r["request_id"], r["reasons"]) for r in work.failed.collect()] == [(2, f"x.bin: {files.BINARY}")]
    answers = spark.createDataFrame([(1, 0, f"- La junta se reúne dos veces al año\n{GOOD}")], "request_id long, block_no int, content string")
    done = to_reports(answers, work.chunks, requests, work.unread)
    report_of = {r["request_id"]: r["report"] for r in done.reports.collect()}
    assert report_of[1].endswith(f"(ley.md:párrafo 1)\n\nArchivos no leídos:\n- x.bin: {files.BINARY}\n- absent.md: no existe")
    assert report_of[2] == f"No consta en los documentos.\n\nArchivos no leídos:\n- x.bin: {files.BINARY}"
    assert files.read_files(spark, f"{tmp_path}/nothing*").count() == 0


def test_known_requests_are_not_asked_again(spark, tmp_path):
    requests = spark.createDataFrame([(1, "¿Cuándo se reúne la junta?", ["ley.md"]), (2, "¿Quién vota?", ["ley.md"])], "request_id long, question string, paths array<string>")
    work = to_prompts(requests, spark.createDataFrame([("ley.md", DOC)], "path string, lines array<string>"))
    nothing = spark.createDataFrame([], "key string, report string, written_at timestamp")
    first = split_known(work, requests, nothing)
    assert first.hits.count() == 0 and first.prompts.count() == 2
    reports = spark.createDataFrame([(1, "uno"), (2, "dos")], "request_id long, report string")
    unformatted = spark.createDataFrame([(2, "sin_formato")], "request_id long, reason string")
    for _ in range(2):  # a report that is appended again does no harm
        reuse.append_store(reuse.to_store(first.misses, reports, unformatted, F.lit("2024-01-01 00:00:00").cast("timestamp")), f"{tmp_path}/store")
    again = split_known(work, requests, spark.read.parquet(f"{tmp_path}/store"))
    assert [(r["request_id"], r["report"]) for r in again.hits.collect()] == [(1, "uno")]
    assert {r["request_id"] for r in again.prompts.collect()} == {2}


def test_the_first_of_several_chunks_counts(spark):
    """A block of four chunks, two of which hold the quote, and a document cut in parts: the first in order, and the line within the file."""
    many = [f"relleno {k} de la norma" for k in range(6)]
    rows = [(1, 0, "a.md", 0, 1, 0, many), (1, 0, "b.md", 1, 2, 3, [*many[:2], DOC[0]]), (1, 0, "b.md", 1, 1, 0, many[:3]), (1, 0, "c.md", 2, 1, 0, DOC), (1, 1, "a.md", 0, 2, 6, DOC)]
    chunks = spark.createDataFrame(rows, "request_id long, block_no int, path string, ord int, part int, first_line int, lines array<string>").withColumn("is_code", F.lit(False))
    claims = verify.parse_claims(spark.createDataFrame([(1, 0, f"- La junta se reúne dos veces al año\n{GOOD}")], "request_id long, block_no int, content string"))
    got = verify.verify(claims, chunks, spark.createDataFrame([(1, "junta")], "request_id long, question string")).collect()
    assert [(r["path"], r["location"], r["reason"]) for r in got] == [("b.md", "línea 6", None)]
