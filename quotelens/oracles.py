"""DuckDB SQL for the library's queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

from . import fixtures as fx
from .functions.numbers import NUMBER_WORDS
from .functions.text import CODE_EXTENSIONS, LEAST_COVERAGE, LEAST_WORD, LINE_END, MARKS, NOT_STATED, SPACES, STEM, STOP_WORDS
from .operators.prompts import REMINDER, SYSTEM
from .operators.report import NOTHING
from .operators.verify import REASONS, SKIPPED
from .sources.files import BINARY, BREAKING, INVALID, TOO_LARGE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q('^' + SPACES + '+')}, ''), {q(SPACES + '+$')}, '')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, {q(MARKS)}, {q(' ' * len(MARKS))})), {q(SPACES + '+')}, ' ', 'g'))"


def clean(x: str) -> str:
    inner = f"regexp_replace(regexp_replace({strip(x)}, '^[.…]+', ''), '[.…]+$', '')"
    return strip(inner)


def split(x: str) -> str:
    parts = f"string_split_regex({x}, {q(LINE_END)})"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END"


def not_stated(x: str) -> str:
    return f"regexp_replace(regexp_replace({norm(x)}, '^[ .…:;!¡]+', ''), '[ .…:;!¡]+$', '') = {q(NOT_STATED)}"


def words(x: str) -> str:
    empty = "[" + ", ".join(q(w) for w in sorted({*STOP_WORDS, *NUMBER_WORDS})) + "]"
    parts = f"string_split_regex(strip_accents(lower({x})), '[^0-9a-z]+')"
    return f"list_filter({parts}, lambda w: length(w) >= {LEAST_WORD} AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({empty}, w))"


def share(claim: str, quote: str) -> str:
    stems = f"list_transform({quote}, lambda w: substr(w, 1, {STEM}))"
    found = f"len(list_filter({claim}, lambda w: list_contains({stems}, substr(w, 1, {STEM}))))"
    return f"CASE WHEN len({claim}) > 0 THEN {found}::DOUBLE / len({claim}) END"


def touching(question: str, quote: str) -> str:
    cut = lambda x: f"list_transform({x}, lambda w: substr(w, 1, {STEM}))"
    return f"(len({question}) = 0 OR list_has_any({cut(question)}, {cut(quote)}))"


def digits(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*'))"


def toks(x: str) -> str:
    return f"((length({x}) + 3) // 4)"


CODE = f"regexp_extract(path, '\\.[^.]*$') IN ({', '.join(q(x) for x in CODE_EXTENSIONS)})"
FILES, REQUESTS, RESPONSES, QUESTIONS, CHUNK_TABLE, ENVELOPES, CODES, CASES, REPORTS = map(
    fx.duck, (fx.FILES, fx.REQUESTS, fx.RESPONSES, fx.QUESTIONS, fx.CHUNKS, fx.ENVELOPES, fx.CODE, fx.CASES, fx.REPORTS)
)
WRAPPED = "concat('<file path=\"', path, '\"', {attributes}, '>', chr(10), {text}, CASE WHEN {text} <> '' AND right({text}, 1) <> chr(10) THEN chr(10) ELSE '' END, '</file>', chr(10))"

_LINES = f"SELECT doc_id, i - 1 AS line_index, p[i] AS text FROM (SELECT doc_id, {split('text')} AS p FROM documents) t, unnest(range(1, len(p) + 1)) u(i)"

# Greedy cutting and filling: one row at a time, with the sum so far.
CHUNKS = f"""
  files AS ({FILES}),
  parts AS (SELECT *, {split("content")} AS lines, {CODE} AS is_code FROM files),
  whole AS (SELECT *, {WRAPPED.format(attributes="''", text="array_to_string(lines, chr(10))")} AS wrapped_whole FROM parts),
  long AS (SELECT doc_id, i, lines[i] AS line, (length(lines[i]) + 4) // 4 AS cost FROM whole, unnest(range(1, len(lines) + 1)) u(i) WHERE {toks("wrapped_whole")} > {fx.BUDGET}),
  walk(doc_id, i, line, acc, part) AS (
    SELECT doc_id, i, line, cost, 1 FROM long WHERE i = 1
    UNION ALL
    SELECT n.doc_id, n.i, n.line, CASE WHEN w.acc + n.cost > {fx.BUDGET - 40} THEN n.cost ELSE w.acc + n.cost END, CASE WHEN w.acc + n.cost > {fx.BUDGET - 40} THEN w.part + 1 ELSE w.part END
    FROM walk w JOIN long n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
  pieces AS (SELECT doc_id, part, min(i) AS a, max(i) AS b, string_agg(line, chr(10) ORDER BY i) AS text, max(max(part)) OVER (PARTITION BY doc_id) AS parts FROM walk GROUP BY doc_id, part),
  chunks AS (
    SELECT request_id, path, ord, 1 AS part, 1 AS parts, 0 AS first_line, len(lines) AS n_lines, wrapped_whole AS wrapped, is_code FROM whole WHERE {toks("wrapped_whole")} <= {fx.BUDGET}
    UNION ALL
    SELECT w.request_id, w.path, w.ord, p.part, p.parts, p.a - 1, p.b - p.a + 1,
      {WRAPPED.format(attributes="concat(' lines=\"', p.a::VARCHAR, '-', p.b::VARCHAR, '\" part=\"', p.part::VARCHAR, '/', p.parts::VARCHAR, '\"')", text="p.text").replace("path,", "w.path,")}, w.is_code
    FROM pieces p JOIN whole w USING (doc_id))"""
BLOCKS = f"""{CHUNKS},
  queue AS (SELECT *, {toks("wrapped")} AS cost, row_number() OVER (PARTITION BY request_id, is_code ORDER BY ord, part) AS n FROM chunks),
  fill(request_id, is_code, n, acc, number) AS (
    SELECT request_id, is_code, n, cost, 0 FROM queue WHERE n = 1
    UNION ALL
    SELECT q.request_id, q.is_code, q.n, CASE WHEN f.acc + q.cost > {fx.BUDGET} THEN q.cost ELSE f.acc + q.cost END, CASE WHEN f.acc + q.cost > {fx.BUDGET} THEN f.number + 1 ELSE f.number END
    FROM fill f JOIN queue q ON q.request_id = f.request_id AND q.is_code = f.is_code AND q.n = f.n + 1),
  packed AS (
    SELECT q.*, f.number + CASE WHEN q.is_code THEN coalesce((SELECT max(d.number) + 1 FROM fill d WHERE d.request_id = q.request_id AND NOT d.is_code), 0) ELSE 0 END AS block_no
    FROM queue q JOIN fill f USING (request_id, is_code, n)),
  blocks AS (SELECT request_id, block_no, is_code, count(*) AS n_chunks, string_agg(wrapped, '' ORDER BY ord, part) AS text FROM packed GROUP BY ALL),
  requests AS ({REQUESTS}),
  prompts AS (SELECT b.*, concat('Files:', chr(10), text, chr(10), 'Question: ', question, chr(10), {q(REMINDER)}) AS user_text, CASE WHEN is_code THEN 'reads-code' ELSE 'reads-text' END AS model FROM blocks b JOIN requests USING (request_id))"""

_BULLET = r"^(?:[\s\x1c-\x1f\x{85}]*[-*•]|\p{Nd}+[.)])[\s\x1c-\x1f\x{85}]+"
CLAIMS = f"""
  responses AS ({RESPONSES}),
  raw AS (SELECT request_id, i AS pos, p[i] AS line FROM (SELECT request_id, {split("content")} AS p FROM responses) t, unnest(range(1, len(p) + 1)) u(i)),
  rows_ AS (SELECT *, {strip("line")} AS bare FROM raw),
  kinds AS (SELECT *, CASE WHEN bare[1] = '>' THEN 'quote' WHEN regexp_matches(line, {q(_BULLET)}) THEN 'bullet' ELSE 'more' END AS kind FROM rows_ WHERE bare <> ''),
  counted AS (SELECT *, count(*) FILTER (kind = 'bullet') OVER (PARTITION BY request_id ORDER BY pos) AS claim_no FROM kinds),
  claims AS (
    SELECT request_id, claim_no,
      {strip("coalesce(string_agg(CASE kind WHEN 'bullet' THEN regexp_replace(line, " + q(_BULLET) + ", '') ELSE bare END, ' ' ORDER BY pos) FILTER (kind <> 'quote'), '')")} AS claim,
      {strip("coalesce(string_agg(" + strip("regexp_replace(bare, '^>+', '')") + ", ' ' ORDER BY pos) FILTER (kind = 'quote'), '')")} AS quote
    FROM counted WHERE claim_no > 0 GROUP BY ALL),
  unformatted AS (SELECT request_id FROM responses WHERE {strip("content")} <> '' AND NOT ({not_stated("content")}) AND request_id NOT IN (SELECT request_id FROM claims))"""

_LETTER, _AT = r"\p{L}\p{N}", r"\p{Nd}"


def _search(text: str, quote: str) -> str:
    """Text before the first whole occurrence, boundary included; null if there is none. RE2 has no lookaround, so boundaries are matched."""
    before = f"CASE WHEN regexp_matches(left({quote}, 1), '{_AT}') THEN '(?:^|[^{_LETTER}_.,]|(?:^|[^{_AT}])[.,])' WHEN regexp_matches(left({quote}, 1), '[{_LETTER}]') THEN '(?:^|[^{_LETTER}_])' ELSE '' END"
    after = f"CASE WHEN regexp_matches(right({quote}, 1), '{_AT}') THEN '(?:$|[^{_LETTER}_.,]|[.,](?:$|[^{_AT}]))' WHEN regexp_matches(right({quote}, 1), '[{_LETTER}]') THEN '(?:$|[^{_LETTER}_])' ELSE '' END"
    pattern = f"concat('(?s)^(.*?', {before}, ')', regexp_escape({quote}), {after})"
    return f"CASE WHEN contains({text}, {quote}) AND regexp_matches({text}, {pattern}) THEN regexp_extract({text}, {pattern}, 1) END"


_VERDICTS = f"""
  flat AS (SELECT request_id, path, is_code, i AS line, {norm("lines[i]")} AS t FROM docs, unnest(range(1, len(lines) + 1)) u(i)),
  filled AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY request_id ORDER BY line) - length(t) - 1 AS start FROM flat WHERE t <> ''),
  indexed AS (SELECT request_id, path, is_code, string_agg(t, ' ' ORDER BY line) AS norm FROM filled GROUP BY ALL),
  ready AS (SELECT *, {clean("quote")} AS shown, {norm(clean("quote"))} AS search FROM claims),
  sought AS (SELECT r.*, x.path, x.is_code, {_search("x.norm", "r.search")} AS head FROM ready r LEFT JOIN indexed x USING (request_id)),
  placed AS (SELECT s.*, (SELECT max(f.line) FROM filled f WHERE f.request_id = s.request_id AND f.start <= length(s.head)) AS line FROM sought s),
  weighed AS (
    SELECT p.*, question, {words("claim")} AS claim_words, {words("quote")} AS quote_words, {words("question")} AS question_words,
      list_transform({digits("claim")}, lambda d: CASE WHEN NOT is_code AND regexp_full_match(d, '[0-9]{{1,3}}(?:[.][0-9]{{3}})+') THEN replace(d, '.', '') ELSE d END) AS claim_digits,
      list_transform({digits("quote")}, lambda d: CASE WHEN NOT is_code AND regexp_full_match(d, '[0-9]{{1,3}}(?:[.][0-9]{{3}})+') THEN replace(d, '.', '') ELSE d END) AS quote_digits
    FROM placed p JOIN ({QUESTIONS}) a USING (request_id)),
  verdicts AS (
    SELECT *, CASE
      WHEN {not_stated("claim")} THEN {q(SKIPPED)}
      WHEN search = '' THEN 'sin_cita'
      WHEN len(string_split(search, ' ')) < 3 THEN 'cita_corta'
      WHEN head IS NULL THEN 'cita_no_encontrada'
      WHEN NOT list_has_all(quote_digits, claim_digits) THEN 'cifras_no_respaldadas'
      WHEN NOT is_code AND NOT coalesce(({share("claim_words", "quote_words")}) >= {LEAST_COVERAGE}, false) THEN 'cita_no_respalda'
      WHEN NOT is_code AND NOT {touching("question_words", "quote_words")} THEN 'cita_ajena'
    END AS reason FROM weighed),
  tally AS (SELECT request_id, reason, count(*) AS n FROM (SELECT request_id, reason FROM verdicts WHERE reason <> {q(SKIPPED)} UNION ALL SELECT request_id, 'sin_formato' FROM unformatted) GROUP BY ALL)"""
VERDICTS = f"""{CLAIMS},
  docs AS (SELECT request_id, path, is_code, {split("text")} AS lines FROM ({CHUNK_TABLE}) c),{_VERDICTS}"""
_SQUEEZED = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, {q(SPACES + '+')}, ' ', 'g'))), lambda x: x <> '')"
OFFICE_VERDICTS = f"""{CLAIMS},
  docs AS (SELECT doc_id AS request_id, concat(doc_id::VARCHAR, '.docx') AS path, false AS is_code, {_SQUEEZED} AS lines FROM documents),{_VERDICTS}"""

_OWN = [r for r in REASONS if r != "sin_formato"]
_REPORT = f"""
  kept AS (SELECT *, row_number() OVER (PARTITION BY request_id, path, {norm("shown")} ORDER BY line, claim_no) AS k FROM verdicts WHERE reason IS NULL),
  said AS (SELECT request_id, string_agg(concat('- ', claim, chr(10), '  > ', shown, chr(10), '  (', path, ':línea ', line::VARCHAR, ')'), chr(10) ORDER BY line, claim_no) AS claims FROM kept WHERE k = 1 GROUP BY ALL),
  notes AS (SELECT request_id, sum(n) FILTER (reason <> 'sin_formato') AS total, sum(n) FILTER (reason = 'sin_formato') AS off,
    concat_ws(', ', {", ".join(f"CASE WHEN sum(n) FILTER (reason = {q(r)}) > 0 THEN concat((sum(n) FILTER (reason = {q(r)}))::BIGINT::VARCHAR, {q(' ' + REASONS[r])}) END" for r in _OWN)}) AS detail FROM tally GROUP BY ALL)
SELECT a.request_id, concat_ws(chr(10) || chr(10), coalesce(claims, {q(NOTHING)}),
  CASE WHEN total = 1 THEN concat('Descartada 1 afirmación: ', detail, '.') WHEN total > 1 THEN concat('Descartadas ', total::BIGINT::VARCHAR, ' afirmaciones: ', detail, '.') END,
  CASE WHEN off > 0 THEN concat(off::BIGINT::VARCHAR, CASE WHEN off = 1 THEN ' respuesta' ELSE ' respuestas' END, ' sin el formato pedido.') END) AS report
FROM ({QUESTIONS}) a LEFT JOIN said USING (request_id) LEFT JOIN notes USING (request_id)"""


def _field(x: str) -> str:
    return f"concat(length({x})::VARCHAR, ':', {x})"


_SETTINGS = "".join(f"{len(x)}:{x}" for x in ("quotelens-1", "end", "reads-text", "reads-code", "1024", "0.5"))
KEYS = f"""{BLOCKS},
  hashed AS (SELECT request_id, string_agg(sha256(text), '' ORDER BY block_no) AS h FROM blocks GROUP BY ALL),
  keys AS (SELECT r.request_id, question, sha256(concat({q(_SETTINGS)}, {_field("question")}, {_field("coalesce(h, '')")}, '0:')) AS key FROM requests r LEFT JOIN hashed USING (request_id))"""

_TAGS = "|".join(sorted(BREAKING, key=len, reverse=True))
_PLAIN = "html"
for _p, _r in ((r"<!--.*?-->|<!DOCTYPE[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""), (rf"</?(?:{_TAGS})(?:\s[^>]*)?/?>", "\n"), (r"<(?:td|th)(?:\s[^>]*)?>", " "), (r"<[^>]*>", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, {q(_p)}, {q(_r)}, 'gis')"
for _p, _r in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
    _PLAIN = f"replace({_PLAIN}, '{_p}', '{_r}')"
_PLAIN = f"regexp_replace({_PLAIN}, '&amp;?', '&', 'g')"

SCORED = f"""
  parts AS (SELECT r.*, type, expected, split_part(regexp_replace(report, '\\n\\n(?:Descartadas? [0-9]|Archivos no leídos)', chr(1)), chr(1), 1) AS verified FROM ({REPORTS}) r JOIN ({CASES}) c USING (case_id)),
  quoted AS (SELECT *, array_to_string(list_transform(list_filter(string_split(verified, chr(10)), lambda x: trim(x)[1] = '>'), lambda x: trim(substr(trim(x), 2))), ' ') AS quotes FROM parts),
  scored AS (SELECT *, error IS NULL AND CASE WHEN type = 'sin_respuesta' THEN starts_with(verified, 'No consta') AND NOT contains(report, 'sin el formato pedido') ELSE contains({norm("quotes")}, {norm("expected")}) END AS ok,
    coalesce(TRY_CAST(regexp_extract(report, 'Descartadas? ([0-9]+)', 1) AS BIGINT), 0) AS discarded, coalesce(TRY_CAST(regexp_extract(report, '([0-9]+) respuestas? sin el formato pedido', 1) AS BIGINT), 0) AS unformatted FROM quoted)"""

_PASSAGES = f"a AS (SELECT item_id, {norm(clean('text'))} AS search FROM benchmark), d AS (SELECT doc_id, {norm('text')} AS norm FROM documents), h AS (SELECT item_id, doc_id, {_search('norm', 'search')} AS head FROM a JOIN d ON contains(norm, search) WHERE search <> '')"

# The evaluation by the same rules, over runs instead of documents.
_RUNS = "SELECT request_id, question FROM runs"
_EVALUATED = f"""
  runs AS (SELECT c.*, d.text, m.model, m.i, v.variant, v.k, c.case_id * 10 + m.i * 2 + v.k AS request_id, regexp_replace(regexp_replace(question, '[?]$', ''), '^ +| +$', '', 'g') AS words,
      CASE WHEN m.model = 'tiny' THEN concat('question takes ', {toks("question")}::VARCHAR, ' tokens and leaves no room for files') WHEN c.case_id % 17 = 3 THEN concat(file, ': no existe') WHEN c.case_id % 13 = 4 THEN concat(file, ': ', {q(BINARY)}) END AS early,
      m.model = 'careless' AND v.variant = 'end' AND c.case_id % 11 = 5 AS mute
    FROM ({fx.duck(fx.EVALUATED)}) c JOIN documents d ON d.doc_id = c.case_id CROSS JOIN (VALUES ('careful', 0), ('careless', 1), ('tiny', 2)) m(model, i) CROSS JOIN (VALUES ('end', 0), ('start', 1)) v(variant, k)),
  {CLAIMS.replace(RESPONSES, """SELECT request_id, CASE WHEN model = 'careful' THEN concat('- ', words, chr(10), '  > ', words) WHEN variant = 'start' THEN concat('They say ', words)
    ELSE concat('- alpha omega gamma delta', chr(10), '  > ', words) END AS content FROM runs WHERE early IS NULL AND NOT mute""").strip()},
  docs AS (SELECT request_id, path, {CODE} AS is_code, lines FROM (SELECT request_id, file AS path, {split("text")} AS lines FROM runs WHERE early IS NULL) t),{_VERDICTS.replace(QUESTIONS, _RUNS)},
  {_REPORT.replace(QUESTIONS, _RUNS).replace("\nSELECT a.request_id, concat_ws", ",\n  composed AS (SELECT a.request_id, concat_ws").strip()}),
  final AS (SELECT case_id, model, variant, type, expected, coalesce(early, CASE WHEN mute THEN 'malformed' END) AS error, CASE WHEN early IS NULL AND NOT mute THEN report ELSE '' END AS report, CASE WHEN early IS NULL THEN 1 ELSE 0 END AS calls FROM runs JOIN composed USING (request_id)),
  {SCORED.replace(f"({REPORTS}) r JOIN ({CASES}) c USING (case_id)", "final r").replace("r.*, type, expected,", "r.*,").strip()}"""

STATUS = "CASE doc_id % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'text outside the fence' WHEN 3 THEN 'not valid Python' WHEN 4 THEN 'stray expression' WHEN 5 THEN 'not valid Python' WHEN 6 THEN 'ok' ELSE 'empty' END"

ORACLE = {
    "text_lines": f"SELECT doc_id, line_index::INT AS line_index, text, concat('línea ', (line_index + 1)::VARCHAR) AS location FROM ({_LINES})",
    "html_lines": f"""WITH t AS (SELECT page_id, list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, {q(SPACES + "+")}, ' ', 'g'))), lambda x: x <> '') AS p FROM pages)
        SELECT page_id, (i - 1)::INT AS line_index, p[i] AS text, concat('línea ', i::VARCHAR) AS location FROM t, unnest(range(1, len(p) + 1)) u(i)""",
    "office_lines": f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, {q(SPACES + "+")}, ' ', 'g'))), lambda x: x <> '') AS p FROM documents)
        SELECT doc_id, (i - 1)::INT AS line_index, p[i] AS text, concat('párrafo ', i::VARCHAR) AS location FROM t, unnest(range(1, len(p) + 1)) u(i)""",
    "extract": f"""SELECT doc_id, concat(doc_id::VARCHAR, CASE doc_id % 4 WHEN 2 THEN '.HTM' WHEN 3 THEN '.docx' ELSE '.txt' END) AS path,
        (CASE doc_id % 4 WHEN 0 THEN len({split("text")}) WHEN 2 THEN len({_SQUEEZED}) END)::INT AS n_lines, CASE WHEN doc_id % 2 = 0 THEN 'línea' END AS unit,
        CASE doc_id % 4 WHEN 1 THEN {q(BINARY)} WHEN 3 THEN {q(INVALID)} END AS reason FROM documents""",
    "wrapped_files": f"SELECT doc_id, {CODE} AS is_code, {toks('w')} AS tokens, sha256(w) AS wrapped FROM (SELECT *, {WRAPPED.format(attributes=chr(39) * 2, text='content')} AS w FROM ({FILES}))",
    "large_sources": f"SELECT path, n_lines::INT AS n_lines FROM (SELECT path, len(string_split(content, chr(10))) - CASE WHEN right(content, 1) = chr(10) OR content = '' THEN 1 ELSE 0 END AS n_lines FROM ({FILES}) WHERE {CODE}) WHERE n_lines > 12",
    "request_budget": f"SELECT request_id, t AS question_tokens, 10 - t AS budget, CASE WHEN t >= 10 THEN concat('question takes ', t::VARCHAR, ' tokens and leaves no room for files') ELSE '' END AS reason FROM (SELECT request_id, {toks('question')} AS t FROM ({REQUESTS}))",
    "chunk_lines": f"WITH RECURSIVE {CHUNKS} SELECT request_id, ord, part::INT AS part, parts::INT AS parts, first_line::INT AS first_line, n_lines::INT AS n_lines, {toks('wrapped')} AS tokens, is_code, sha256(wrapped) AS wrapped FROM chunks",
    "pack_blocks": f"WITH RECURSIVE {BLOCKS} SELECT request_id, ord, part::INT AS part, block_no::INT AS block_no FROM packed",
    "pack_one_request": f"WITH RECURSIVE {BLOCKS.replace(FILES, fx.duck(fx.ONE_REQUEST))} SELECT ord, part::INT AS part, block_no::INT AS block_no FROM packed",
    "build_blocks": f"WITH RECURSIVE {BLOCKS} SELECT request_id, block_no::INT AS block_no, is_code, n_chunks::INT AS n_chunks, sha256(text) AS text FROM blocks",
    "render_prompts": f"WITH RECURSIVE {BLOCKS} SELECT request_id, block_no::INT AS block_no, model, sha256({q(SYSTEM)}) AS system, sha256(user_text) AS \"user\" FROM prompts",
    "request_json": f"WITH RECURSIVE {BLOCKS} SELECT request_id, block_no::INT AS block_no, model, 0.5::DOUBLE AS temperature, 1024::INT AS max_tokens, 'false' AS stream, 'system' AS first_role, sha256(user_text) AS \"user\" FROM prompts",
    "parse_responses": f"""SELECT d.doc_id AS request_id, 0::INT AS block_no, CASE WHEN d.doc_id % 6 = 0 AND {strip(fx._BODY)} <> '' THEN 'ok' WHEN d.doc_id % 6 IN (0, 3) THEN 'empty' WHEN d.doc_id % 6 IN (1, 2) THEN 'reasoning only' ELSE 'malformed' END AS status,
        CASE WHEN d.doc_id % 6 = 0 AND {strip(fx._BODY)} <> '' THEN {strip(fx._BODY)} END AS content, CASE WHEN d.doc_id % 6 IN (0, 3) THEN 'stop' WHEN d.doc_id % 6 IN (1, 2) THEN 'length' END AS finish_reason FROM {fx.duck(fx._DOCS)} d""",
    "parse_claims": f"WITH {CLAIMS} SELECT request_id, claim_no, claim, quote FROM claims",
    "flag_unformatted": f"WITH {CLAIMS} SELECT request_id, 'sin_formato' AS reason FROM unformatted",
    "quote_forms": f"WITH t AS (SELECT doc_id, text, concat(' …*“', text, '”_.. ') AS x FROM documents) SELECT doc_id, {norm('x')} AS norm, {clean('x')} AS shown, array_to_string({words('x')}, ' ') AS words, array_to_string(list_sort({digits('text')}), ' ') AS digits FROM t",
    "word_overlap": f"WITH t AS (SELECT doc_id, {words('substr(text, 1, length(text) // 2)')} AS a, {words('substr(text, length(text) // 2 + 1)')} AS b FROM documents) SELECT doc_id, round({share('a', 'b')}, 9) AS coverage, {touching('a', 'b')} AS touches FROM t",
    "document_forms": f"WITH t AS (SELECT doc_id, concat(' …*“', text, '”_.. ') AS x FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL) SELECT doc_id, sha256({norm('x')}) AS norm, sha256({clean('x')}) AS shown, sha256(array_to_string({words('x')}, ' ')) AS words FROM t",
    "line_overlap": f"WITH l AS (SELECT doc_id, {split('text')} AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(1, len(x))) AS k FROM l), w AS (SELECT doc_id, k, {words('x[k]')} AS a, {words('x[k + 1]')} AS b FROM p) SELECT doc_id, (k - 1)::INT AS line, round({share('a', 'b')}, 9) AS coverage, {touching('a', 'b')} AS touches FROM w",
    "numeric_values": "WITH t AS (SELECT doc_id, length(text) + doc_id AS n FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct([(n % 1000000)::VARCHAR, (n + 1000000)::VARCHAR, '3/5', concat((doc_id % 7 + 1)::VARCHAR, '/8'), '1/2'])), ' ') AS found FROM t",
    "locate_quotes": f"WITH {VERDICTS} SELECT request_id, claim_no, path, (line - 1)::INT AS line FROM placed WHERE search <> '' AND head IS NOT NULL",
    "verify_claims": f"WITH {VERDICTS} SELECT request_id, claim_no, shown AS quote, reason, CASE WHEN reason IS NULL THEN path END AS path, CASE WHEN reason IS NULL THEN concat('línea ', line::VARCHAR) END AS location FROM verdicts",
    "tally_rejections": f"WITH {VERDICTS} SELECT reason, sum(n)::BIGINT AS n FROM tally GROUP BY ALL",
    "dedupe_verified": f"WITH {VERDICTS} SELECT request_id, 0::INT AS block_no, claim_no, path, shown AS quote FROM (SELECT *, row_number() OVER (PARTITION BY request_id, path, {norm('shown')} ORDER BY line, claim_no) AS k FROM verdicts WHERE reason IS NULL) WHERE k = 1",
    "compose_report": f"WITH {VERDICTS}, {_REPORT}",
    "report_parts": f"""WITH {VERDICTS}, kept AS (SELECT *, row_number() OVER (PARTITION BY request_id, path, {norm("shown")} ORDER BY line, claim_no) AS k FROM verdicts WHERE reason IS NULL),
        said AS (SELECT request_id AS a, line AS b, claim_no AS c, concat('- ', claim, chr(10), '  > ', shown, chr(10), '  (', path, ':línea ', line::VARCHAR, ')') AS t FROM kept WHERE k = 1),
        unread AS (SELECT doc_id AS a, 0 AS b, 0 AS c, concat('- ', path, ': no existe') AS t FROM ({FILES}) WHERE doc_id % 11 = 5),
        begun AS (SELECT *, (sum(length(t) + 1) OVER (PARTITION BY section ORDER BY a, b, c) - length(t) - 1) // 2000 AS part FROM (SELECT 0 AS section, * FROM said UNION ALL SELECT 3, * FROM unread)),
        parts AS (SELECT section, part, concat(CASE WHEN section = 3 AND part = 0 THEN concat('Archivos no leídos:', chr(10)) ELSE '' END, string_agg(t, chr(10) ORDER BY a, b, c)) AS text FROM begun GROUP BY section, part),
        sums AS (SELECT sum(n) FILTER (reason <> 'sin_formato') AS total, sum(n) FILTER (reason = 'sin_formato') AS off,
          concat_ws(', ', {", ".join(f"CASE WHEN sum(n) FILTER (reason = {q(r)}) > 0 THEN concat((sum(n) FILTER (reason = {q(r)}))::BIGINT::VARCHAR, {q(' ' + REASONS[r])}) END" for r in _OWN)}) AS detail FROM tally),
        notes AS (SELECT 1 AS section, 0 AS part, CASE WHEN total = 1 THEN concat('Descartada 1 afirmación: ', detail, '.') WHEN total > 1 THEN concat('Descartadas ', total::BIGINT::VARCHAR, ' afirmaciones: ', detail, '.') END AS text FROM sums
          UNION ALL SELECT 2, 0, CASE WHEN off > 0 THEN concat(off::BIGINT::VARCHAR, CASE WHEN off = 1 THEN ' respuesta' ELSE ' respuestas' END, ' sin el formato pedido.') END FROM sums)
        SELECT section::INT AS section, part::BIGINT AS part, sha256(text) AS text FROM (SELECT * FROM parts UNION ALL SELECT * FROM notes) WHERE text IS NOT NULL""",
    "token_savings": f"""WITH RECURSIVE {BLOCKS}, d AS (SELECT request_id, sum({toks("content")})::BIGINT AS direct, sum(len(string_split(content, chr(10))))::BIGINT AS lines FROM files GROUP BY ALL), b AS (SELECT request_id, count(DISTINCT block_no) AS blocks FROM blocks GROUP BY ALL)
        SELECT request_id, direct, {toks("question")} AS reported, direct - {toks("question")} AS saved, CASE WHEN direct = 0 THEN 0.0 ELSE round(100.0::DOUBLE * (direct - {toks("question")}) / direct, 1) END AS percent, lines, blocks FROM d JOIN requests USING (request_id) JOIN b USING (request_id)""",
    "no_readable_input": f"WITH r AS ({REQUESTS}), f AS ({FILES}) SELECT request_id, string_agg(concat(path, ': no existe'), '; ' ORDER BY ord) AS reasons FROM r JOIN f USING (request_id) WHERE request_id % 80 <> 0 AND ord < 3 GROUP BY ALL",
    "locate_in_corpus": f"""WITH {_PASSAGES}
        SELECT item_id, doc_id, (length(head) + 1)::INT AS position FROM h WHERE head IS NOT NULL""",
    "passage_index": f"""WITH {_PASSAGES}, p AS (SELECT item_id, doc_id, (length(head) + 1)::INT AS position FROM h WHERE head IS NOT NULL)
        SELECT *, 1::INT AS search FROM p WHERE doc_id % 3 < 2 UNION ALL SELECT *, 2 FROM p""",
    "answer_key": f"WITH RECURSIVE {KEYS} SELECT request_id, key FROM keys",
    "split_cached": f"SELECT request_id, CASE WHEN request_id % 60 = 0 THEN concat('new ', question) END AS report FROM ({REQUESTS})",
    "to_store": f"WITH {CLAIMS} SELECT sha256(request_id::VARCHAR) AS key, sha256(content) AS report FROM responses WHERE request_id NOT IN (SELECT request_id FROM unformatted)",
    "prune_store": "SELECT sha256(event_id::VARCHAR) AS key FROM events ORDER BY ts DESC, key LIMIT 500",
    "store_snapshots": "SELECT key, true AS before, row_number() OVER (ORDER BY ts DESC, key) <= (SELECT count(*) // 2 FROM events) AS after FROM (SELECT sha256(event_id::VARCHAR) AS key, ts FROM events)",
    "run_matrix": f"SELECT case_id, type, model, variant FROM ({CASES}), (VALUES ('m1'), ('m2')) m(model), (VALUES ('end'), ('start')) v(variant)",
    "score_runs": f"WITH {SCORED} SELECT case_id, model, variant, ok, discarded, unformatted FROM scored",
    "summarize_runs": f"WITH {SCORED} SELECT model, variant, type, count(*) FILTER (ok) AS hits, count(*) AS runs, sum(discarded)::BIGINT AS discarded, sum(unformatted)::BIGINT AS unformatted, count(error) AS errors, sum(seconds) AS seconds, sum(calls)::BIGINT AS calls FROM scored GROUP BY GROUPING SETS ((model, variant, type), (model, variant))",
    "triage_code": f"""SELECT doc_id, {STATUS} AS status, (CASE doc_id % 8 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 6 THEN 1 ELSE 0 END)::INT AS n_lines,
        CASE doc_id % 8 WHEN 0 THEN concat('x = ', doc_id::VARCHAR, chr(10), 'print(x)') WHEN 1 THEN concat('def f():', chr(10), '    return ', doc_id::VARCHAR) WHEN 2 THEN 'x = 1' ELSE {strip("text")} END AS code FROM ({CODES})""",
    "code_statuses": f"SELECT {STATUS} AS status, count(*) AS n FROM documents GROUP BY ALL",
    "answer_blocks": f"WITH RECURSIVE {BLOCKS} SELECT request_id, block_no::INT AS block_no, concat('n ', length(user_text)::VARCHAR) AS content FROM prompts",
    "read_cases": f"SELECT case_id::VARCHAR AS file, concat('¿', expected) AS question, type, CASE WHEN type = 'sin_respuesta' THEN '' ELSE expected END AS expected FROM ({CASES})",
    "write_outputs": f"""WITH {VERDICTS}, kept AS (SELECT DISTINCT request_id, path, {norm("shown")} AS t FROM verdicts WHERE reason IS NULL)
        SELECT 'reports' AS output, count(*) AS n FROM ({QUESTIONS}) UNION ALL SELECT 'verified', count(*) FROM kept UNION ALL SELECT 'rejections', count(*) FROM tally UNION ALL SELECT 'dumps', count(*) FROM ({REPORTS})""",
    "unread_report": f"""WITH r AS ({REQUESTS}), f AS ({FILES}),
        u AS (SELECT request_id, string_agg(concat('- ', path, ': ', reason), chr(10) ORDER BY ord) AS listed, string_agg(concat(path, ': ', reason), '; ' ORDER BY ord) AS reasons, count(*) AS n FROM
          (SELECT *, CASE WHEN doc_id % 11 = 5 THEN 'no existe' WHEN content IS NULL THEN {q(INVALID)} WHEN doc_id % 7 = 3 THEN {q(BINARY)} END AS reason FROM f) WHERE reason IS NOT NULL GROUP BY request_id),
        a AS (SELECT request_id, count(*) AS n FROM f GROUP BY ALL)
        SELECT r.request_id, concat_ws(chr(10) || chr(10), {q(NOTHING)}, 'Archivos no leídos:' || chr(10) || listed) AS report, CASE WHEN u.n = a.n THEN reasons END AS reasons FROM r JOIN a USING (request_id) LEFT JOIN u USING (request_id)""",
    "office_report": f"WITH {OFFICE_VERDICTS} SELECT request_id, claim_no, shown AS quote, reason, CASE WHEN reason IS NULL THEN path END AS path, CASE WHEN reason IS NULL THEN concat('párrafo ', line::VARCHAR) END AS location FROM verdicts",
    "broken_files": f"""WITH t AS (SELECT doc_id, doc_id % 10 AS k, {_SQUEEZED} AS p FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
        SELECT doc_id, CASE WHEN k < 2 THEN len(p) END::INT AS n_lines, CASE WHEN k < 2 THEN sha256(array_to_string(p, chr(10))) END AS text, CASE WHEN k < 2 THEN 'párrafo' END AS unit,
        CASE WHEN k = 5 THEN {q(TOO_LARGE)} WHEN k = 9 THEN 'no se pudo extraer el texto (LookupError)' WHEN k > 1 THEN {q(INVALID)} END AS reason FROM t""",
    "source_lines": f"""WITH g AS (SELECT doc_id // 50 AS bucket, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL),
        t AS (SELECT bucket, bucket % 6 AS k, CASE bucket % 6 WHEN 3 THEN {split("text")} WHEN 4 THEN list_transform(string_split(text, chr(10)), lambda x: concat('| ', x)) ELSE {_SQUEEZED} END AS p FROM g)
        SELECT bucket, (i - 1)::BIGINT AS line_index, p[i] AS text, concat(CASE WHEN k IN (2, 3) THEN 'línea ' ELSE 'párrafo ' END, i::VARCHAR) AS location, NULL::VARCHAR AS reason FROM t, unnest(range(1, len(p) + 1)) u(i) WHERE k < 5
        UNION ALL SELECT bucket, NULL, NULL, NULL, {q(INVALID)} FROM t WHERE k = 5""",
    "big_file_lines": f"""WITH t AS (SELECT doc_id, {split("x")} AS p FROM (SELECT doc_id, concat(coalesce(text, ''), chr(10)) AS x FROM documents)),
        l AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS n, p[i] AS text FROM t, unnest(range(1, len(p) + 1)) u(i)) SELECT n - 1 AS line_index, text, concat('línea ', n::VARCHAR) AS location FROM l""",
    "quote_lines": f"WITH {VERDICTS} SELECT request_id, claim_no, path, (line - 1)::INT AS line FROM placed WHERE search <> '' AND head IS NOT NULL",
    "passage_lines": f"""WITH {_PASSAGES}, f AS (SELECT doc_id, i, {norm("x[i]")} AS t FROM (SELECT doc_id, {split("text")} AS x FROM documents) y, unnest(range(1, len(x) + 1)) u(i)),
        s AS (SELECT doc_id, i, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1 AS start FROM f WHERE t <> '')
        SELECT item_id, doc_id, (max(i) - 1)::INT AS line FROM h JOIN s USING (doc_id) WHERE head IS NOT NULL AND start <= length(head) GROUP BY ALL""",
    "evaluate_runs": f"WITH {_EVALUATED} SELECT case_id, model, variant, ok, discarded, unformatted, error, sha256(report) AS report, calls::BIGINT AS calls FROM scored",
    "evaluation_summary": f"WITH {_EVALUATED} SELECT model, variant, type, count(*) FILTER (ok) AS hits, count(*) AS runs, sum(discarded)::BIGINT AS discarded, sum(unformatted)::BIGINT AS unformatted, count(error) AS errors, sum(calls)::BIGINT AS calls FROM scored GROUP BY GROUPING SETS ((model, variant, type), (model, variant))",
    "answer_stream": f"""WITH {VERDICTS}, done AS (WITH {_REPORT.strip()}) SELECT request_id, CASE WHEN request_id % 3 = 2 AND request_id % 7 = 3 THEN NULL ELSE report END AS report,
        CASE WHEN request_id % 3 = 2 AND request_id % 7 = 3 OR request_id IN (SELECT request_id FROM unformatted) THEN 0 ELSE 1 END::BIGINT AS times_stored FROM done""",
    "verify_stream": f"WITH {VERDICTS} SELECT reason, count(*) AS n FROM (SELECT reason FROM verdicts UNION ALL SELECT 'sin_formato' FROM unformatted) GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
