"""Small tables for the corpus tests."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators might use inside; as extra columns they must not matter.
CLASH = ["rank", "slot", "node", "first", "line", "w", "h1", "block", "part", "cell", "size", "n", "id", "v", "token", "start", "units"]


def docs(spark, texts, source="s"):
    """Documents 0, 1, ...; a text may be (text, source)."""
    rows = []
    for i, t in enumerate(texts):
        text, src = t if isinstance(t, tuple) else (t, source)
        rows.append((i, text, "en", src, None if text is None else len(text)))
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


def words(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
