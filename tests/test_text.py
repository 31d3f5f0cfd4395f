"""Column expressions against the rules said in plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.functions.numbers import numeric_values, values

EDGES = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "  　x   y\x1f", "año 😀", "İΣ ΑΣ", "É̂ñü ẞß øĿ ǆ ﬁ K", "**“A’s”** `b` _c_ «d»", "…. x. …"]


def column(spark, values_, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], "i int, t string")
    return [r["o"] for r in rows.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()]


def test_lines_are_splitlines(spark):
    assert column(spark, EDGES, T.lines) == [t.splitlines() for t in EDGES]
    assert column(spark, [None], T.lines) == [None]


def test_strip_and_squeeze(spark):
    assert column(spark, EDGES, T.strip) == [t.strip() for t in EDGES]
    assert column(spark, EDGES, T.squeeze) == [" ".join(t.split()) for t in EDGES]


def test_normalize(spark):
    marks = str.maketrans(dict.fromkeys(T.MARKS, " "))
    assert column(spark, EDGES, T.normalize) == [" ".join(t.translate(marks).lower().split()) for t in EDGES]


def test_content_words_fold_accents(spark):
    def folded(t):
        flat = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        return [w for w in re.split("[^0-9a-z]+", flat) if len(w) >= 3 and not w.isdigit() and w not in T.STOP_WORDS]

    samples = [*EDGES, "La cámara número 12 está ABIERTA", "Ça où þorn Ärger İstanbul", "x́yź 1234 the committee"]
    assert column(spark, samples, T.content_words) == [folded(t) for t in samples]
    assert column(spark, ["veinte cuartos y mil gatos"], T.content_words) == [["gatos"]]


def test_tokens_and_code(spark):
    assert column(spark, ["", "a", "abcd", "abcde", "😀😀😀😀"], T.tokens) == [0, 1, 1, 2, 1]
    assert column(spark, ["a.py", ".py", "d/x.SQL", "x.tar.gz", "d.py/x", "..py", "a.md"], T.is_code) == [True, False, True, False, False, False, False]


def test_not_stated(spark):
    assert column(spark, ["NO CONSTA", " **No consta**… ", "no consta nada", "¡No  consta!"], T.is_not_stated) == [True, True, False, True]


def test_coverage(spark):
    rows = spark.createDataFrame([("las cámaras graban video", "la camara graba el vídeo"), ("perro gato perro", "perro"), ("el la 12", "x")], "a string, b string")
    got = [r[0] for r in rows.select(T.coverage(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, pytest.approx(2 / 3), None]


PHRASES = {
    "treinta y dos": {"32"}, "treinta y cuarenta": {"30", "40"}, "doscientos mil trescientos": {"200300"}, "mil y una": {"1000"}, "mil una": {"1001"},
    "Ley 39/2015": {"39/2015"}, "15/09/2026": {"15", "09", "2026"}, "tres quintos": {"3/5"}, "un tercio": {"1/3"}, "la mitad": {"1/2"}, "el cien por cien": {"100"},
    "diez por ciento": {"10"}, "2.500 euros": {"2500"}, "81.2 y 15,5": {"81.2", "15,5"}, "ciento un": {"101"}, "un plazo": set(), "treinta, cinco": {"30", "5"},
    "treinta cinco": {"35"}, "veintidós mil": {"22000"}, "mil mil": {"1000"}, "3 / 05": {"3/5"}, "1.5/2": {"1.5", "2"}, "cero": {"0"}, "treinta y un mil": {"31000"}, "": set(),
}


@pytest.mark.parametrize("text", PHRASES)
def test_number_phrases(text):
    assert values(text) == PHRASES[text]


def test_numbers_are_read_back():
    from quotelens.fixtures import number_phrase

    for n in [0, *range(2, 1100), *range(1990, 2130), *range(20900, 21200), 99999, 100000, 101001, 999999]:
        assert values(number_phrase(n)) == {str(n)}, number_phrase(n)


def test_numeric_values_column(spark):
    assert column(spark, [*PHRASES, None], numeric_values) == [*(sorted(v) for v in PHRASES.values()), None]
