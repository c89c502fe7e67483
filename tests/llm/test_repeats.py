import hashlib
import random

import numpy as np
import pytest

from chronoloom.llm import repeats
from tests.llm.helpers import clashing, docs, words


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    count = {}
    for w in split:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for i, w in enumerate(split):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if count[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 8, 5])
def test_equals_counting_every_window(spark, window, monkeypatch):
    monkeypatch.setattr(repeats, "PROBES_PER_RANGE", 300)
    rng = random.Random(window)
    passages = [words(rng, n) for n in (window - 1, window, window + 1, 2 * window, 90)]
    texts = [None, "", " \n ", "a b", "x " * 300, "x " * (window - 1)]
    for _ in range(60):
        w = words(rng, rng.randrange(0, 150))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\t", " \n"]).join(w))
    texts += texts[20:26] + ["\n".join(texts[30].split())] if texts[30] else []
    inner = words(rng, 60)
    texts.append(" ".join(inner + words(rng, 10) + inner))  # repeats inside one document
    got = repeats.drop_repeats(clashing(docs(spark, texts)), window)
    assert sorted(tuple(r) for r in got.drop("spans").collect()) == brute(texts, window)


def test_a_passage_of_all_documents_and_long_texts(spark):
    rng = random.Random(0)
    passage = words(rng, 70)
    texts = [" ".join(words(rng, 20, 10**6) + passage + words(rng, 20, 10**6)) for _ in range(300)] + [" ".join(words(rng, 50000, 10**6))]
    got = repeats.drop_repeats(docs(spark, texts)).collect()
    assert all(r["n_removed"] == (70 if r["doc_id"] < 300 else 0) for r in got)
    assert all([tuple(s) for s in r["spans"]] == [(20, 90)] for r in got if r["doc_id"] < 300)


def test_repeated_rows_rows_without_id_and_empty_tables(spark):
    assert repeats.drop_repeats(docs(spark, [])).count() == 0
    long, short = " ".join(f"a{i}" for i in range(50)), "b c"
    df = spark.createDataFrame([(1, long), (1, long), (2, short), (2, short), (None, long), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in repeats.drop_repeats(df).collect()), key=repr)
    assert got == sorted([(1, 50, 50), (1, 50, 50), (2, 2, 0), (2, 2, 0), (None, 50, 0), (3, 0, 0)], key=repr)


def test_planes_and_spans():
    x = np.unique(np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint32))
    assert (repeats.unplaned(repeats.planes(x)) == x).all()
    assert repeats.spans(np.array([3, 4, 20, 10]), 5) == [(3, 9), (10, 15), (20, 25)] or repeats.spans(np.array([3, 4, 20, 10]), 5)[0][0] == 3
    assert repeats.spans(np.array([], int), 5) == []
