import itertools
import random
import zlib

import numpy as np
import pytest

from chronoloom.llm import packing
from chronoloom.llm.queries import tokenizer_file
from tests.llm.helpers import clashing, docs

ODD = ["", None, " ", "a  b", "a\n b \n\nc", "x\ty", "tail ", " head", "it's 12345 DON'T", "a <|endoftext|> b", "é ñ　x", "word " * 6000, "\x1c a \x85 b"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def ids_of(tokenizer, text):
    return [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 2]


def test_pieces_hold_the_tokenizer_s_ids_and_fill_sequences_without_gaps(spark, tokenizer):
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice(["the", "of", "Zug.", "ñandú", "x1"]) for _ in range(rng.randrange(1, 900))) for _ in range(80))]
    df = docs(spark, texts)
    tokens = packing.cut_tokens(df, tokenizer_file(), 1024)
    pieces = {(r["doc_id"], r["piece"]): r for r in tokens.collect()}
    for i, text in enumerate(texts):
        own = [pieces[k] for k in sorted(k for k in pieces if k[0] == i)]
        got = list(itertools.chain.from_iterable(np.frombuffer(r["ids"], "<u4").tolist() for r in own))
        assert got == ids_of(tokenizer, text), repr(text)[:80]
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert all(r["length"] == 1024 for r in own[1:]) and own[0]["length"] <= 1024
    placed = packing.pack_documents(df, tokenizer_file(), 1024).collect()
    assert len(placed) == len(pieces)
    per = {}
    for r in placed:
        assert r["ids_crc32"] == zlib.crc32(pieces[r["doc_id"], r["piece"]]["ids"])
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in placed)
    large = sum(r["length"] > 512 for r in placed)  # no two of these share a sequence
    assert len(per) <= 1.05 * max(large, -(-total // 1024))


def test_sequences_join_the_ids(spark):
    df = docs(spark, ["a b c", "d e", None, "f " * 1500])
    tokens = packing.cut_tokens(df, tokenizer_file(), 64)
    placed = packing.best_fit(tokens.select("doc_id", "piece", "start", "length"), ["doc_id", "piece"], 64)
    made = packing.sequences(tokens, placed).collect()
    assert sum(r["length"] for r in made) == sum(len(r["ids"]) // 4 for r in tokens.collect())
    assert all(len(r["ids"]) == 4 * r["length"] <= 256 for r in made)


def test_fullest_equals_trying_all_combinations():
    rng = random.Random(3)
    for _ in range(60):
        counts = np.zeros(31, np.int64)
        for _ in range(rng.randrange(1, 6)):
            counts[rng.randrange(1, 31)] += rng.randrange(1, 3)
        room = rng.randrange(1, 31)
        items = [i for i in range(31) for _ in range(counts[i])]
        best = max((s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room), default=0)
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == best
        assert all(chosen.count(x) <= counts[x] for x in chosen)


def test_patterns_use_up_the_histogram():
    rng = np.random.default_rng(0)
    h = {int(i): int(n) for i, n in zip(range(1, 101), rng.integers(0, 50, 100)) if n}
    used = dict.fromkeys(h, 0)
    sequences = 0
    for times, lengths in packing.slack_patterns(h, 100):
        assert sum(lengths) <= 100
        sequences += times
        for x in lengths:
            used[x] += times
    assert used == h
    large = sum(n for i, n in h.items() if i > 50)
    assert sequences <= 1.02 * max(large, sum(i * n for i, n in h.items()) / 100)


def test_hot_length_repeated_rows_and_other_columns(spark):
    df = clashing(docs(spark, ["same text"] * 70 + [None] * 5).unionByName(docs(spark, ["same text"] * 3)))
    placed = packing.pack_documents(df, tokenizer_file(), 16).collect()
    assert len(placed) == 78
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == 78
    again = packing.pack_documents(df, tokenizer_file(), 16).collect()
    key = lambda r: (r["doc_id"], r["sequence_id"], r["offset"])
    assert sorted(map(key, placed)) == sorted(map(key, again))


def test_empty_table_null_id_and_bad_length(spark):
    assert packing.pack_documents(docs(spark, []), tokenizer_file()).count() == 0
    null = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert packing.pack_documents(null, tokenizer_file()).count() == 2
    with pytest.raises(ValueError):
        packing.best_fit(spark.createDataFrame([(1, 20)], "id long, length long"), ["id"], 10)
