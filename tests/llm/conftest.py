import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "the th er on an re he in ed nd ha at en es of or nt ea ti to it st".split(), "bb": "que de la el en ción mente ar os as ía ño ue ro ca do".split()}


def prose(rng, n, lang="aa"):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with every odd case: null, empty, blank, letterless, copies, near copies, shared passages, repeated rows and ids, a long one."""
    rng = random.Random(5)
    rows = []
    passage = prose(rng, 60)
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        text = prose(rng, rng.randint(60, 160), lang)
        if i % 10 == 3:
            text = f"{text}\n{passage}\n{prose(rng, 20, lang)}"
        rows.append((i, text, lang, "s", len(text)))
    for i in range(120, 135):  # copies and near copies
        words = rows[i - 119][1].split(" ")
        if i % 3:
            words[5] = "changed"
        text = " ".join(words)
        rows.append((i, text, rows[i - 119][2], "s", len(text)))
    long = prose(rng, 6000)
    odd = [None, "", " \n\t", "12 34 -- !!", "one", "ONE", "a b c d", "ünï " * 80, "spam " * 90, long, f"{long} more", "<|endoftext|> x", "▁ mark  two  spaces ", "\n".join(["same line here"] * 40)]
    rows += [(200 + k, t, None, None, None) for k, t in enumerate(odd)]
    rows += [rows[1], rows[1], (2, "another text under a used id", "aa", "s", 5), (None, prose(rng, 90), "aa", "s", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
