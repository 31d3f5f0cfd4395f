"""Column expressions for text: lines, normal forms, words, digits. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line, what counts as white space, what normalising turns into spaces.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_REPLACED, _ONE_END = ("\r\n", "\u2028", "\u2029"), "[\n\r\x0b\x0c\x1c\x1d\x1e\x85]"
SPACES = "[\\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The characters of SPACES.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MARKS = "*_`\"“”«»‘’"
NOT_STATED = "no consta"
STEM, LEAST_WORD, LEAST_COVERAGE = 5, 3, 0.6

# Extensions of program code.
CODE_EXTENSIONS = """
    .py .js .jsx .ts .tsx .mjs .cjs .java .kt .scala .cs .go .rs .c .h .cpp .hpp .cc .rb .php .swift
    .m .lua .pl .r .sql .sh .bash .ps1 .psm1 .vue .svelte
""".split()

# Words without content, folded.
STOP_WORDS = """
    el la los las lo un una unos unas al del de ante bajo con contra desde durante
    entre hacia hasta mediante para por segun sin sobre tras que como cuando donde
    cual cuales quien quienes cuanto cuanta cuantos cuantas este esta estos estas
    esto ese esa esos esas eso aquel aquella aquellos aquellas sus mis tus nos les
    ser sera seran son era eran fue fueron sido siendo estar esta estan estaba
    haber hay han habia hace hacen hacer tener tiene tienen tenia puede pueden
    podra podran poder debe deben debera deberan deber mas muy tambien pero sino
    porque pues otro otra otros otras todo toda todos todas cada vez segun
    the and for with from that this these those which what who whom how when
    where there their they them than then not are was were been has have had
    does did its into onto upon also but can could should would will shall may
    might must
""".split()


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """For translate(): characters whose lower case without accents is one ASCII letter or digit, then accents that vanish."""
    letters, plain, gone = [], [], []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.combining(c):
            gone.append(c)
            continue
        rest = "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.combining(x))
        if len(rest) == 1 and rest.isascii() and rest.isalnum():
            letters.append(c)
            plain.append(rest)
    return "".join(letters + gone), "".join(plain)


def lines(text: Column) -> Column:
    """The lines of a text, without an empty one after a line end at its end. Null: null; empty: none."""
    # The line end that ends the text is taken off first, so that the text is split once.
    last = F.when(F.substring(text, -2, 2) == "\r\n", 2).when(F.substring(text, -1, 1).rlike(LINE_END), 1).otherwise(0)
    rest = F.substring(text, F.lit(1), F.length(text) - last)
    # Line ends that are several characters, or beyond Latin-1, become line feeds first: what is left is a class that regular expressions find several times as fast.
    for end in _REPLACED:
        rest = F.replace(rest, F.lit(end), F.lit("\n"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(rest, _ONE_END))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def squeeze(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def normalize(text: Column) -> Column:
    """Lower case without Markdown marks and quotation marks, white space squeezed. The ASCII apostrophe stays."""
    gone = MARKS + _BLANKS
    return F.trim(F.regexp_replace(F.lower(F.translate(text, gone, " " * len(gone))), "  +", " "))


def clean_quote(quote: Column) -> Column:
    """A quote as it is shown: without white space and full stops or ellipses around it."""
    return strip(F.regexp_replace(strip(quote), "^[.…]+|[.…]+$", ""))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.translate(text, *folding())), "\u0307", "")


def tokens(text: Column) -> Column:
    """Estimate: a quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def extension(path: Column) -> Column:
    """The last extension in lower case; a name that only begins with dots has none."""
    return F.lower(F.regexp_extract(base_name(path), "^\\.*[^.].*?(\\.[^.]*)$", 1))


def is_code(path: Column) -> Column:
    return extension(path).isin(CODE_EXTENSIONS)


def is_not_stated(text: Column) -> Column:
    """The answer that the documents don't say, with or without punctuation around it."""
    return F.regexp_replace(normalize(text), "^[ .…:;!¡]+|[ .…:;!¡]+$", "") == NOT_STATED


def digit_strings(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(\\p{Nd}+(?:[.,]\\p{Nd}+)*)"), F.lit(1)))


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f(*values) with every value computed once for the row. Inside a function over an array, the optimizer would compute it for each element."""
    names = [f"v{k}" for k in range(len(values))]
    one = F.array(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))))
    return F.get(F.transform(one, lambda x: f(*(x[n] for n in names))), 0)


def content_words(text: Column) -> Column:
    """Folded words with content, in order and with repeats."""
    from .numbers import NUMBER_WORDS

    empty = sorted({*STOP_WORDS, *NUMBER_WORDS})
    return F.filter(F.split(fold(text), "[^0-9a-z]+"), lambda w: (F.length(w) >= LEAST_WORD) & (F.translate(w, "0123456789", "") != "") & ~w.isin(empty))


def stems(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, STEM)))


def coverage(claim: Column, quote: Column) -> Column:
    """Share of the claim's content words whose stem the quote has; null if it has no such words."""
    return covered(content_words(claim), stems(content_words(quote)))


def covered(words: Column, quote_stems: Column) -> Column:
    def share(words: Column, quote_stems: Column) -> Column:
        n = F.size(words)
        found = F.size(F.filter(words, lambda w: F.array_contains(quote_stems, F.substring(w, 1, STEM))))
        return F.when(n > 0, found / n)

    return let(share, words, quote_stems)


def touches(question_words: Column, quote_stems: Column) -> Column:
    """The question shares a stem, or has no content words."""
    return let(lambda q, stem: (F.size(q) == 0) | F.arrays_overlap(stems(q), stem), question_words, quote_stems)


def wrap(path: Column, text: Column, line_range: Column | None = None, part: Column | None = None, parts: Column | None = None) -> Column:
    """A file's text between tags that name it."""
    attributes = F.concat(F.lit('<file path="'), path, F.lit('"'))
    if line_range is not None:
        attributes = F.concat(attributes, F.lit(' lines="'), line_range, F.lit('"'))
    if part is not None:
        attributes = F.concat(attributes, F.lit(' part="'), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit('"'))
    return F.concat(attributes, F.lit(">\n"), text, F.when((text != "") & ~text.endswith("\n"), "\n").otherwise(""), F.lit("</file>\n"))
