"""Small tables with every awkward case, and brute-force versions."""

import re

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, size long, node long, n long"


def table(spark, texts, sources=None, langs=None, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    n = len(texts)
    sources, langs, ids = sources or ["s"] * n, langs or ["en"] * n, ids or list(range(n))
    rows = [
        (i, t, g, s, len(t or ""), 7, "x", 1, 2, 3) for i, t, g, s in zip(ids, texts, langs, sources, strict=True)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [None, "", " \n\t ", "a", "één straße naïve", "x" * 5000, "a b c\n" * 4000, "a b c d e", "a b c d e", "!!! ??? ...", "0 1 2"]
