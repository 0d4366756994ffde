import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, node string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1, n=60):
    """Random prose with exact and near copies, shared passages, repeated
    lines and sources; plus NULLs, empty and blank texts, a very long text,
    repeated rows, rows of one id and rows without one."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    texts = [prose(rng, words, rng.randint(30, 120)).replace(" e", ".\nE", 3) for _ in range(n)]
    passage = prose(rng, words, 70)
    for i in range(5, 12):
        texts[i] = texts[i] + "\n" + passage + "\n" + prose(rng, words, 15)
    for i in range(12, 18):
        texts[i] = texts[12]
    for i in range(18, 26):  # near copies: one word of many differs
        w = texts[18].split(" ")
        w[i % len(w)] = "changed" + str(i)
        texts[i] = " ".join(w)
    rows = [(i, t, ["en", "de", "fr", None][i % 4], f"s{i % 5}" if i % 7 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, "en", "s0", None), (1001, "", None, "s1", 0), (1002, " \n\t\x0b\n ", "en", None, 4),
             (1003, "one", "en", "s2", 3), (1004, prose(rng, words, 30000), "en", "s0", 0), (1004, texts[3], "en", "s0", 0),
             (1005, texts[4], "es", "s3", 0), (1005, texts[4], "es", "s3", 0), (None, texts[12], "en", "s1", 0),
             (None, prose(rng, words, 50), None, None, None), (1006, "Ärger über Öl ÉCOLE 東京都 \U0001f600 x y", "de", "s1", 0)]
    return [(*r, "a", "b", "c") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
