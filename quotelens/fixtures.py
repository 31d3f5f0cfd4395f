"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and DuckDB both read.

{docs} stands for documents: Spark puts a DataFrame there, DuckDB the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUDGET = 200
#: documents with one of their lines, from anywhere in the text, and the line after it, split off once.
_DOCS = "(SELECT *, split_part(text, chr(10), CAST(1 + (doc_id * 7) % n AS INT)) AS l1, split_part(text, chr(10), CAST(2 + (doc_id * 7) % n AS INT)) AS l2 FROM (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM {docs}))"
_FIRST, _SECOND = "d.l1", "d.l2"


def _words(line: str, a: int, b: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"split_part({line}, ' ', {k})" for k in range(a, b + 1)) + ")"


PATH = "concat(d.source, '/', CAST(d.doc_id AS STRING), CASE d.doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' ELSE '.sql' END)"
#: Twenty documents a request.
FILES = f"SELECT d.doc_id, CAST(d.doc_id - d.doc_id % 20 AS BIGINT) AS request_id, CAST(d.doc_id % 20 AS INT) AS ord, {PATH} AS path, d.text AS content FROM {_DOCS} d"
#: All documents in one request, far enough apart that it is packed in several ranges of files.
ONE_REQUEST = f"SELECT d.doc_id, CAST(0 AS BIGINT) AS request_id, CAST(d.doc_id * 5 AS INT) AS ord, {PATH} AS path, d.text AS content FROM {{docs}} d"
REQUESTS = f"SELECT d.doc_id AS request_id, concat({_words(_FIRST, 1, 6)}, '?') AS question FROM {_DOCS} d WHERE d.doc_id % 20 = 0"

_QUOTE = _words(_FIRST, 2, 8)
_NEXT = _words(_FIRST.replace("d.", "n."), 1, 9)
_ITEM = "concat('- ', {}, chr(10), '  > ', {})"
#: One response for each document about one of its lines, by turns: verbatim quote and an unrelated claim; quote across a line break; digits added; short
#: quote; no quote; words of the next document; prose; nothing stated.
RESPONSES = f"""
SELECT d.doc_id AS request_id, CAST(0 AS INT) AS block_no, CASE d.doc_id % 8
  WHEN 0 THEN concat('Intro', chr(10), {_ITEM.format(_QUOTE, _QUOTE)}, chr(10), {_ITEM.format("'alpha omega gamma delta'", f"concat('“', {_QUOTE}, '”')")})
  WHEN 1 THEN concat({_ITEM.format(_SECOND, f"concat({_words(_FIRST, 1, 40)}, ' ', {_words(_SECOND, 1, 3)}, ' …')")}, chr(10), 'more')
  WHEN 2 THEN concat('1. ', {_QUOTE}, ' 12345', chr(10), '>> ', {_QUOTE})
  WHEN 3 THEN {_ITEM.format(_QUOTE, _words(_FIRST, 2, 3))}
  WHEN 4 THEN concat('* ', {_QUOTE})
  WHEN 5 THEN concat(chr(9), '• ', {_NEXT}, chr(10), '> ', {_NEXT}, chr(10), '- **NO CONSTA**.')
  WHEN 6 THEN concat('Prose: ', {_QUOTE})
  ELSE ' No consta. ' END AS content
FROM {_DOCS} d LEFT JOIN {_DOCS} n ON n.doc_id = d.doc_id + 1"""
#: What is asked of each document: its own words, or for every third something else.
QUESTIONS = f"SELECT d.doc_id AS request_id, CASE WHEN d.doc_id % 24 IN (8, 9) THEN 'wholly unrelated matters' ELSE {_QUOTE} END AS question FROM {_DOCS} d"
#: Each document as the one chunk of its request; every fifth path is code.
CHUNKS = "SELECT d.doc_id AS request_id, CAST(0 AS INT) AS block_no, concat(d.source, '/', CAST(d.doc_id AS STRING), CASE WHEN d.doc_id % 5 = 0 THEN '.py' ELSE '.md' END) AS path, CAST(0 AS INT) AS ord, CAST(1 AS INT) AS part, CAST(0 AS INT) AS first_line, d.doc_id % 5 = 0 AS is_code, d.text FROM {docs} d"
_JSON = "replace(replace(replace({}, '\"', ''), chr(92), ''), chr(10), ' ')"
_BODY = _JSON.format("d.text")
#: Chat responses as JSON: with content; with reasoning alone, under either name; empty; cut off; without choices.
ENVELOPES = f"""
SELECT d.doc_id AS request_id, CAST(0 AS INT) AS block_no, CASE d.doc_id % 6
  WHEN 0 THEN concat('{{{{"choices":[{{{{"message":{{{{"content":" ', {_BODY}, ' "}}}},"finish_reason":"stop"}}}}]}}}}')
  WHEN 1 THEN '{{{{"choices":[{{{{"message":{{{{"content":null,"reasoning":"hm"}}}},"finish_reason":"length"}}}}]}}}}'
  WHEN 2 THEN '{{{{"choices":[{{{{"message":{{{{"content":"","reasoning":"","reasoning_content":"hm"}}}},"finish_reason":"length"}}}}]}}}}'
  WHEN 3 THEN '{{{{"choices":[{{{{"message":{{{{"content":"  "}}}},"finish_reason":"stop"}}}}]}}}}'
  WHEN 4 THEN '{{{{"choices":[{{{{"message'
  ELSE '{{{{"error":"busy"}}}}' END AS body
FROM {_DOCS} d"""
#: Code as models write it.
CODE = f"""
SELECT d.doc_id, CASE d.doc_id % 8
  WHEN 0 THEN concat('```python', chr(10), 'x = ', CAST(d.doc_id AS STRING), chr(10), 'print(x)', chr(10), '```')
  WHEN 1 THEN concat('```', chr(10), 'def f():', chr(10), '    return ', CAST(d.doc_id AS STRING))
  WHEN 2 THEN concat('```', chr(10), 'x = 1', chr(10), '```', chr(10), d.text, ' so')
  WHEN 3 THEN concat('Here it is: ', d.text)
  WHEN 4 THEN concat('x = ', CAST(d.doc_id AS STRING), chr(10), 'Done')
  WHEN 5 THEN concat('return ', CAST(d.doc_id AS STRING))
  WHEN 6 THEN concat('# ', CAST(d.doc_id AS STRING))
  ELSE '   ' END AS text
FROM {_DOCS} d"""
#: Reports of runs: every document a case, two models, two variants.
CASES = f"SELECT d.doc_id AS case_id, CASE d.doc_id % 3 WHEN 0 THEN 'dato' WHEN 1 THEN 'orientacion' ELSE 'sin_respuesta' END AS type, {_QUOTE} AS expected FROM {_DOCS} d"
REPORTS = f"""
SELECT d.doc_id AS case_id, m.model, v.variant, CASE (d.doc_id + m.i + v.i) % 5
  WHEN 0 THEN concat('- a', chr(10), '  > ', {_QUOTE}, chr(10), '  (x:1)', chr(10), chr(10), 'Descartadas ', CAST(2 + d.doc_id % 3 AS STRING), ' afirmaciones: 2 sin cita.')
  WHEN 1 THEN concat('- ', {_QUOTE}, chr(10), '  > something else', chr(10), '  (x:1)')
  WHEN 2 THEN 'No consta en los documentos.'
  WHEN 3 THEN concat('No consta en los documentos.', chr(10), chr(10), '3 respuestas sin el formato pedido.')
  ELSE '' END AS report, CASE WHEN (d.doc_id + m.i + v.i) % 5 = 4 THEN 'no backend' END AS error,
  CAST(d.doc_id % 7 AS DOUBLE) AS seconds, CAST(1 + d.doc_id % 2 AS BIGINT) AS calls
FROM {_DOCS} d CROSS JOIN (SELECT 'm1' AS model, 0 AS i UNION ALL SELECT 'm2', 1) m CROSS JOIN (SELECT 'end' AS variant, 0 AS i UNION ALL SELECT 'start', 2) v"""

#: A case for each document: what the first words of a line are followed by.
EVALUATED = f"SELECT d.doc_id AS case_id, {PATH} AS file, concat({_words(_FIRST, 1, 9)}, '?') AS question, CASE d.doc_id % 3 WHEN 0 THEN 'dato' WHEN 1 THEN 'orientacion' ELSE 'sin_respuesta' END AS type, {_words(_FIRST, 3, 7)} AS expected FROM {_DOCS} d"
#: The cases' files: some are not there, some are binary.
EVALUATED_FILES = f"SELECT {PATH} AS path, CASE WHEN d.doc_id % 13 = 4 THEN concat('a', chr(0), d.text) ELSE d.text END AS content FROM {{docs}} d WHERE d.doc_id % 17 <> 3"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, docs=documents(spark, sf_dir))


def duck(sql: str) -> str:
    return sql.format(docs="documents")


def number_phrase(n: int) -> str:
    """0 <= n < 1000000 in Spanish words."""
    units = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte".split()
    units += ["veinti" + u for u in "uno dós trés cuatro cinco séis siete ocho nueve".split()]
    tens = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
    hundreds = "ciento doscientos trescientas cuatrocientos quinientas seiscientos setecientos ochocientas novecientos".split()

    def small(k: int) -> str:
        if k < 30:
            return units[k]
        if k < 100:
            return tens[k // 10 - 3] + (f" y {units[k % 10]}" if k % 10 else "")
        if k == 100:
            return "cien"
        return hundreds[k // 100 - 1] + (f" {small(k % 100)}" if k % 100 else "")

    if n < 1000:
        return small(n)
    head = "mil" if n < 2000 else f"{small(n // 1000)} mil"
    return head + (f" {small(n % 1000)}" if n % 1000 else "")
