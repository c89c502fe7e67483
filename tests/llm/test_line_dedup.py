import random

import pytest

from chronoloom.llm import line_dedup
from tests.llm.helpers import clashing, docs, words


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(texts, least):
    seen, out = [], []
    for t in texts:
        if t is None:
            out.append((None, 0, 0))
            continue
        kept, gone, lines = [], 0, t.split("\n")
        for line in lines:
            w = [x.decode() for x in line.encode().split()]
            if w and any(w == s or (min(len(w), len(s)) >= least and distance_one(w, s)) for s in seen):
                gone += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        out.append(("\n".join(kept), len(lines), gone))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_comparing_every_pair_of_lines(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, n, 30) for n in (1, 2, 7, 8, 8, 9, 12, 13, 30, 31, 60) for _ in range(3)]
    texts = [None, "", "\n", " \n\n ", "a  b\nb a\na b"]
    for _ in range(90):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i, kind = rng.randrange(len(w)), rng.randrange(3)
                w[i : i + (kind != 0)] = [] if kind == 1 and len(w) > 1 else [f"w{rng.randrange(30)}"]
            lines.append(rng.choice([" ", " ", "  ", "\t"]).join(w))
        texts.append("\n".join(lines))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(clashing(docs(spark, texts))).collect()}
    want = brute(texts, 8)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


def test_hot_lines_long_texts_rows_without_id_and_empty_tables(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    hot = "the very same line with a few more words here"
    texts = [hot, *[f"{hot}\nown {i}" for i in range(200)], "\n".join(f"long line number {i} of one long text with words" for i in range(3000))]
    got = line_dedup.dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()
    assert got[0]["text"] == hot and all(r["text"] == f"own {r['doc_id'] - 1}" for r in got[1:201])
    assert got[201]["n_removed"] == 2999 and got[201]["n_lines"] == 3000  # each differs from the first in one word
    mixed = spark.createDataFrame([(None, hot), (1, hot), (1, hot), (2, hot), (2, None)][:4], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(mixed).collect()), key=repr)
    assert out == sorted([(None, hot, 0), (1, hot, 0), (1, hot, 0), (2, "", 1)], key=repr)


def test_plan_is_native_and_has_no_cross_join(spark):
    plan = line_dedup.dedup_lines(docs(spark, ["a b\nc", "a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
