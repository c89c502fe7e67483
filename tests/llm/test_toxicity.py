import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import toxicity as tox
from tests.llm.helpers import clashing, docs


def model_of(text):
    counts = {}
    for w in text.split():
        w = "\x00\x00" + w + "\x00"
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 1
    return tox.CharacterModel(counts)


def cost_of(text, model):
    a = b = "\x00"
    total = 0.0
    for c in text:
        if c == "\x00" and b == "\x00":
            continue
        total += model.cost(a, b, c)
        a, b = b, c
    return total


def test_viterbi_equals_trying_every_path():
    model = model_of("stupid idiot loser moron the of and idea stop loose " * 3)
    for token, spaced in (("1d10t", False), ("s t u p", True), ("looser", False), ("m0ron", False), ("$top", False), ("iiidea", False)):
        lattice = tox.readings(token, spaced)
        best = min((cost_of("".join(t for t, _ in path) + "\x00", model) + sum(c for _, c in path), "".join(t for t, _ in path)) for path in itertools.product(*lattice))
        assert tox.viterbi(lattice, model) == best[1].strip("\x00")


def test_disguises_are_undone_and_plain_words_kept():
    rest = tox.Restorer(model_of("stupid idiot loser moron the of and idea " * 5))
    for token in ("1d1ot", "id10t", "idi0t", "idiiiot"):
        assert rest.words(token) == ["idiot"], token
    assert rest.words("stück") == ["stück"] and rest.words("12345") == [] and rest.words("the,") == ["the"] and rest.words("") == []
    assert rest.spaced("you i d i o t") == ["idiot"] and rest.spaced("s.t.u.p.i.d") == ["stupid"]


def corpus(spark, n=600, seed=0):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                t = rng.choice(["nasty", "rotten", "awful"])
                w.insert(rng.randrange(len(w)), rng.choice([t, t, t.replace("a", "4"), t.replace("o", "0"), " ".join(t), t[0] + t[1] * 4 + t[2:]]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark):
    df, labels = corpus(spark)
    out = tox.toxicity(clashing(df), labels).join(labels, "doc_id").collect()
    assert len(out) == 600
    held = [r for r in out if r["held_out"]]
    assert 60 < len(held) < 180
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_held_out_labels_are_never_read(spark):
    df, labels = corpus(spark, 300, 5)
    turned = labels.withColumn("toxic", F.when(tox.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (dict(tox.toxicity(df, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert one == two


def test_remainder_is_the_text_s_crc(spark):
    import zlib
    got = spark.range(200).select("id", tox.remainder(F.col("id")).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_edges(spark):
    df, labels = corpus(spark, 120, 2)
    strange = spark.createDataFrame([(1000, None), (1001, ""), (None, "nasty"), (1002, "nasty " * 50000), (1003, "\u0000 ! @ 1 " + "4" * 5000)], "doc_id long, text string")
    both = df.select("doc_id", "text").unionByName(strange).unionByName(strange)
    out = tox.toxicity(both, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")))
    rows = out.where("doc_id >= 1000 or doc_id is null").collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert tox.toxicity(df.limit(0), labels).count() == 0
    assert tox.toxicity(df, labels.limit(0)).count() == 120
    assert tox.toxicity(df, labels.withColumn("toxic", F.lit(0))).where("predicted = 1").count() == 0


def test_long_runs_without_white_space_are_read():
    rest = tox.Restorer(model_of("stupid idiot loser moron the of and idea " * 5))
    some = ["the", "idea", "of", "loser", "and", "moron"] * 5
    for sign in (",", "/", "_", "\u00a0\u2060"[1], "\u3002"):
        assert rest.words(sign.join([*some, "1d1ot", "idea"])) == [*some, "idiot", "idea"], sign
    assert rest.words("the" * 30 + ",2nd," + "idiot") == ["the" * 30, "nd", "idiot"]
    read = rest.words("1d10t" * 4000)  # one part: decoded whole, in linear time
    assert "".join(read).count("idiot") == 4000
    model = rest.model
    said = tox.viterbi(tox.readings("id10t!" * 15, False), model)
    assert said.replace("\x00", "").count("idiot") >= 14


def test_documents_without_white_space_are_scored_by_their_words(spark):
    df, labels = corpus(spark)
    glued = spark.createDataFrame([(5000, ",".join(["abc", "fed", "nasty", "r0tten", "gab"] * 8)), (5001, ",".join(["abc", "fed", "cab", "feed", "gab"] * 8)),
                                   (5002, "/".join(["abc", "fed", "nasty", "rotten"] * 8).replace("/", " "))], "doc_id long, text string")
    out = {r["doc_id"]: r["predicted"] for r in tox.toxicity(df.select("doc_id", "text").unionByName(glued), labels).where("doc_id >= 5000").collect()}
    assert out == {5000: 1, 5001: 0, 5002: 1}


def test_every_trigram_count_is_seen(spark):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 80)]
    common = ["".join(rng.choice(letters) for _ in range(120_000)) + " iii qiq ziz" * 50 for _ in range(3)]  # 240,000 trigrams and more
    texts = spark.createDataFrame([(i, t * 2) for i, t in enumerate(common)] + [(9, "zlqx rlqx")], "doc_id long, text string")
    table = tox.trigram_counts(texts)
    ask = lambda k: "".join(chr((k >> s) & 0x1FFFFF) for s in (42, 21, 0))
    counts = {ask(r["key"]): r["n"] for r in table.collect()}
    assert len(counts) > 200_000
    codes = ["tz1qx", "tr1qx", "sz 1 q x", "tid10t!", "t" + "z1" * 5, "l" + "z1qx" * 30]
    got = {r["code"]: r["words"] for r in tox.restored(spark.createDataFrame([(c,) for c in codes * 2], "code string"), table).collect()}
    assert got["tz1qx"] == ["zlqx"] and got["tr1qx"] == ["rlqx"]
    model = tox.CharacterModel(counts)
    assert got == {c: [w for w in tox.decode(c[1:], c[0] == "s", model) if c[0] != "s" or len(w) > 2] for c in codes}
