"""Queries over whole texts: numbers against a brute-force reader."""

import hashlib
import random
import re
import unicodedata

import pytest

import __spark_entry__
from quotelens.fixtures import number_phrase

SF = "/root/testdata/sf0.001"
PARTS = "tercio cuarto quinto sexto septimo octavo noveno decimo".split()


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@pytest.fixture(scope="module")
def phrases():
    """Every spelling of the numbers below 10,000 that the fixture or its masculine, feminine and apocopated forms give."""
    out = {}
    for n in range(10_000):
        words = plain(number_phrase(n))
        for form in (words, words.replace("ientas", "ientos"), words.replace("ientos", "ientas")):
            out[form] = n
            for end in ("un", "una"):
                if form.endswith("uno"):
                    out[form[:-3] + end] = n
    return {p: n for p, n in out.items() if p not in ("un", "una", "uno")}


def brute(text, phrases):
    """Looks up every run of words, longest first, and walks the digits by hand."""
    found, flat, k, rest = set(), plain(text), 0, []
    while k < len(flat):  # digits, with dots and commas between them; fractions stand between neither slashes nor digits
        if not flat[k].isdecimal():
            rest.append(flat[k])
            k += 1
            continue
        end = k
        while end < len(flat) and (flat[end].isdecimal() or flat[end] in ".," and end + 1 < len(flat) and flat[end + 1].isdecimal()):
            end += 1
        token, after = flat[k:end], re.match(r"\s*/\s*(\d+)(?![/\d]|[.,]\d)", flat[end:])
        if after and token.isdecimal() and (k == 0 or flat[k - 1] != "/"):
            found.add(f"{int(token)}/{int(after[1])}")
            end += after.end()
        else:
            parts = token.split(".")
            thousands = len(parts) > 1 and len(parts[0]) <= 3 and all(len(p) == 3 and p.isdecimal() for p in parts[1:]) and parts[0].isdecimal()
            found.add("".join(parts) if thousands else token)
        rest.append(" " if after else flat[k:end])
        k = end
    for piece in re.split(r"[,;:.()\[\]]", "".join(rest)):
        words = [w for w in re.findall("[0-9a-z]+", piece) if not w.isdigit()]
        at = 0
        while at < len(words):
            if words[at] == "mitad":
                found.add("1/2")
            elif at + 1 < len(words) and words[at + 1].rstrip("s") in PARTS and (words[at] in ("un", "una", "uno") or phrases.get(words[at], 99) < 30):
                found.add(f"{phrases.get(words[at], 1)}/{PARTS.index(words[at + 1].rstrip('s')) + 3}")
                at += 1
            else:
                for n in range(9, 0, -1):
                    if (value := phrases.get(" ".join(words[at : at + n]))) is not None and at + n <= len(words):
                        found.add(str(value))
                        at += n - 1
                        break
            at += 1
    return found


def written(rng):
    """A long text with numbers of all kinds, most of them far from its first line."""
    filler = lambda: " ".join(rng.choices("la casa del río tiene ventanas grandes que dan al mar".split(), k=rng.randint(5, 60)))
    kinds = [lambda: number_phrase(rng.choice([n for n in range(2, 9999) if n != 1])), lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 9)} / {rng.randint(2, 9)}",
             lambda: f"{rng.randint(1, 999)}.{rng.randint(100, 999)}", lambda: f"{rng.randint(1, 99)},{rng.randint(1, 99)}", lambda: "tres quintos", lambda: "la mitad", lambda: "veintidós mil"]
    return "\n".join(f"{filler()} {rng.choice(kinds)()}{rng.choice([', ', '. ', '; '])}{filler()}." for _ in range(rng.randint(3, 200)))


def test_numbers_of_whole_documents(spark, phrases, tmp_path):
    rng = random.Random(4)
    phrases = phrases | {"veintidos mil": 22000}
    rows = [(i, written(rng)) for i in range(40)] + [(40, None), (41, ""), (42, "sin nada"), (43, "x " * 40_000 + "\nquinientos doce")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["found"] for r in __spark_entry__.queries()["document_numbers"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else " ".join(sorted(brute(t, phrases))) for i, t in rows}
    assert got[43] == "512" and any(len(v.split()) > 50 for v in got.values() if v)


def test_numbers_of_the_table(spark, phrases):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["found"] for r in __spark_entry__.queries()["document_numbers"](spark, SF).collect()}
    assert got == {i: None if t is None else " ".join(sorted(brute(t, phrases))) for i, t in texts.items()}


def test_forms_of_whole_texts(spark, tmp_path):
    long = "primera\n" + "una CASA\n" * 3000
    rows = [(1, f"{long}*fin*  distinto…"), (2, f"{long}*fin*  diverso…"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["document_forms"](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    body = "primera " + "una casa " * 3000
    assert got[1]["norm"] == sha(f"… {body}fin distinto… ..")
    assert got[1]["words"] == sha("primera " + "casa " * 3000 + "fin distinto")
    assert all(got[1][c] != got[2][c] for c in ("norm", "shown", "words"))


def test_overlap_of_every_pair_of_lines(spark, tmp_path):
    texts = ["perro gato\nperro\nlos gatos negros\r\n12\n\nnegras", "sola", "", None, "\n".join(f"palabra{chr(97 + k % 7)}" for k in range(50))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line"]): (r["coverage"], r["touches"]) for r in __spark_entry__.queries()["line_overlap"](spark, str(tmp_path)).collect()}
    want = {}
    for i, text in enumerate(texts):
        words = [[w for w in re.findall("[0-9a-z]+", x) if len(w) > 2 and not w.isdigit() and w != "los"] for x in (text or "").splitlines()]
        for k, (one, two) in enumerate(zip(words, words[1:], strict=False)):
            hits = [w for w in one if w[:5] in {x[:5] for x in two}]
            want[i, k] = (round(len(hits) / len(one), 9) if one else None, bool(hits) or not one)
    assert got == want and len(got) == 54
