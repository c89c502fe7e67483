"""Toxicity scores with noisy-channel deobfuscation.

Words may be disguised: digits and signs for letters, letters set apart, letters repeated. Such a token is a lattice of
readings; the channel gives each reading a cost, a character model of the corpus gives each string one, and a Viterbi
search takes the cheapest path. The restored words are then scored by a word model learned from labelled documents.

The character counts stay a table. Distinct disguised strings are dealt to blocks, and the trigrams that a block's
readings pass through are joined to the counts, so every count of the corpus is seen and none is gathered in one place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import slices
from chronoloom.session import written

# Signs and digits, and the letters that they stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c", "£": "l"}
MAX_LABELLED = 200_000  # labelled documents that the word model is fitted on: those with the smallest hashes
MAX_TERMS = 50_000  # size of the word model: the most significant terms
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]){3,}[^\W_](?![^\W_])")
_THRICE = re.compile(r"(.)\1\1", re.S)
_RUN = re.compile(r"(.)\1*", re.S)
LONG = 60  # tokens with more characters are runs of text without white space: cut at signs, and not remembered
_SIGNS = re.compile("[^" + re.escape("".join(c for c in LEET if not c.isalnum())) + r"\w]+|_+")
_EDGE = "\x00"
_BLOCK = 200_000  # characters of disguised strings that are decoded together


class CharacterModel:
    """P(c | a, b) from trigram counts, backed off to shorter contexts. _EDGE stands for a word's bound."""

    def __init__(self, trigrams: dict[str, int]):
        self.three, self.two, self.one = dict(trigrams), Counter(), Counter()
        context2, context1, total = Counter(), Counter(), 0
        for t, n in trigrams.items():
            self.two[t[1:]] += n
            self.one[t[2]] += n
            context2[t[:2]] += n
            context1[t[1]] += n
            total += n
        self.context2, self.context1, self.total, self.known = context2, context1, total, {}

    def cost(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        if key not in self.known:
            p1 = (self.one[c] + 0.1) / (self.total + 0.1 * (len(self.one) + 1))
            p2 = (self.two[b + c] + 4 * p1) / (self.context1[b] + 4)
            p3 = (self.three.get(key, 0) + 4 * p2) / (self.context2[a + b] + 4)
            self.known[key] = -log(p3)
        return self.known[key]


def readings(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of one character, the strings it may stand for and what the channel charges."""
    out = []
    for m in _RUN.finditer(token):
        c, n = m[1], len(m[0])
        if spaced and c in " .-_*":
            out.append([("", 0.5), (_EDGE, 2.0)])
            continue
        choices = [(c * min(n, 4), 0.0 if n < 3 else 1.0 * n)]
        if n > 1 and c.isalpha():
            choices += [(c, 2.0 if n == 2 else 0.5)] + ([(c * 2, 1.0)] if n > 2 else [])
        for letter in LEET.get(c, ""):
            choices += [(letter, 1.0)] + ([(letter * 2, 1.0)] if n == 2 else [])
        if not c.isalnum():  # a sign may also bound or interrupt a word
            choices = [(_EDGE, 1.0), ("", 1.5), *choices[1:]]
        out.append(choices)
    return out


def viterbi(lattice: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """The cheapest reading; _EDGE inside it parts words. A state is the last two characters.

    Paths are chains of (path so far, text), so time and memory are linear in the length.
    """
    best: dict[tuple[str, str], tuple[float, tuple]] = {(_EDGE, _EDGE): (0.0, ())}
    for choices in [*lattice, [(_EDGE, 0.0)]]:
        after: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (cost, said) in best.items():
            for text, charge in choices:
                x, y, total = a, b, cost + charge
                for c in text:
                    if c == _EDGE and y == _EDGE:
                        continue
                    total += model.cost(x, y, c)
                    x, y = y, c
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (said, text))
        best = after
    least = min(cost for cost, _ in best.values())
    return min(_spoken(said) for cost, said in best.values() if cost == least).strip(_EDGE)


def _spoken(path: tuple) -> str:
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def tokens_of(text: str) -> list[str]:
    """Tokens of a text; of a long one its parts between signs."""
    tokens = text.split()
    if max(map(len, tokens), default=0) <= LONG:
        return tokens
    return [t for token in tokens for t in ([token] if len(token) <= LONG else [p for p in _SIGNS.split(token) if p])]


def pieces(token: str) -> list[tuple[str, bool]]:
    """(string, disguised): words that a token says as they stand, and strings that have more than one reading."""
    core = token.strip(".,;:?\"'()[]{}<>«»„“”*_-#~`/\\=&^%")
    if core.endswith("!") and core[:-1].isalpha():
        core = core[:-1]
    if core.isalpha():
        return [(core, _repeats(core))]
    if not any(c.isalpha() for c in core):
        return []
    if len(core) > LONG and len(parts := _SIGNS.split(core)) > 1:
        return [x for part in parts for x in pieces(part)]
    if any(c in LEET for c in core) or _repeats(core):
        return [(core, True)]
    return [(w, False) for w in re.split(r"[\W\d_]+", core) if w]


def decode(token: str, spaced: bool, model: CharacterModel | TableModel) -> list[str]:
    return [w for w in re.split(r"[\W\d_]+", viterbi(readings(token, spaced), model)) if w]


class Restorer:
    """Restored words of tokens; only disguised ones have more than one path, so only they are decoded."""

    def __init__(self, model: CharacterModel):
        self.model = model

    def words(self, token: str) -> list[str]:
        return [w for s, disguised in pieces(token) for w in (decode(s, False, self.model) if disguised else [s])]

    def spaced(self, text: str) -> list[str]:
        """Words whose letters stand apart."""
        return [w for m in _SPACED.finditer(text) for w in decode(m[0], True, self.model) if len(w) > 2]


def codes_of(token: str) -> list[str]:
    """The disguised strings of a token behind a letter for their kind: t, or l for long ones. Kind s is letters apart."""
    return [("l" if len(s) > LONG else "t") + s for s, disguised in pieces(token) if disguised]


def spaced_codes(text: str) -> list[str]:
    return ["s" + m[0] for m in _SPACED.finditer(text)]


def _repeats(word: str) -> bool:
    return _THRICE.search(word) is not None


def terms(word: str) -> list[str]:
    """A word's features: itself and its beginnings, which words of one root share."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(key, n): trigrams of all lower-cased texts, other characters than letters and digits being one bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, 0, 1_000_000):
            codes = np.frombuffer("\n".join(t.decode() for t in texts).lower().encode("utf-32-le"), np.uint32)
            kinds, place = np.unique(np.r_[np.uint32(10), codes, np.uint32(10)], return_inverse=True)
            kinds = np.array([k if chr(k).isalnum() else 0 for k in kinds.tolist()], np.uint64)
            codes = kinds[place]
            codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
            if len(codes) < 3:
                continue
            keys, n = np.unique((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def passed(lattice: list[list[tuple[str, float]]]) -> set[str]:
    """All trigrams whose cost the search may ask for."""
    states, out = {(_EDGE, _EDGE)}, set()
    for choices in [*lattice, [(_EDGE, 0.0)]]:
        after = set()
        for a, b in states:
            for text, _ in choices:
                x, y = a, b
                for c in text:
                    if c == _EDGE and y == _EDGE:
                        continue
                    out.add(x + y + c)
                    x, y = y, c
                after.add((x, y))
        states = after
    return out


class TableModel:
    """Costs of the trigrams that a block's readings pass through, from rows (key, cost)."""

    def __init__(self, keys: list[int], costs: list[float]):
        self.costs = dict(zip(keys, costs, strict=True))

    def cost(self, a: str, b: str, c: str) -> float:
        return self.costs[_key(a + b + c)]


def _key(t: str) -> int:
    return (ord(t[0]) << 42) | (ord(t[1]) << 21) | ord(t[2])


def trigram_costs(keys: DataFrame, trigrams: DataFrame) -> DataFrame:
    """`keys` (key and others) with the cost that CharacterModel gives each key on all rows of `trigrams`."""
    low, n = F.lit(0x1FFFFF), F.sum("n")
    last, middle = F.col("key").bitwiseAND(low), F.shiftright("key", 21).bitwiseAND(low)
    pair, front = F.col("key").bitwiseAND(F.lit((1 << 42) - 1)), F.shiftright("key", 21)
    # one row per character: bounded by the alphabets
    one = trigrams.groupBy(last.alias("c")).agg(n.alias("one"))
    context1 = trigrams.groupBy(middle.alias("b")).agg(n.alias("context1"))
    two = trigrams.groupBy(pair.alias("bc")).agg(n.alias("two"))
    context2 = trigrams.groupBy(front.alias("ab")).agg(n.alias("context2"))
    whole = one.agg(F.coalesce(F.sum("one"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds")).first()
    rows = keys.withColumns({"c": last, "b": middle, "bc": pair, "ab": front})
    rows = rows.join(trigrams.select("key", F.col("n").alias("three")), "key", "left").join(two, "bc", "left").join(context2, "ab", "left")
    rows = rows.join(F.broadcast(one), "c", "left").join(F.broadcast(context1), "b", "left").na.fill(0, ["one", "two", "three", "context1", "context2"])
    p1 = (F.col("one") + 0.1) / (whole["total"] + 0.1 * (whole["kinds"] + 1))
    p2 = (F.col("two") + 4 * p1) / (F.col("context1") + 4)
    p3 = (F.col("three") + 4 * p2) / (F.col("context2") + 4)
    return rows.select(*keys.columns, (-F.log(p3)).alias("cost"))


def _lattice(code: str) -> list[list[tuple[str, float]]]:
    return readings(code[1:], code[0] == "s")


def restored(codes: DataFrame, trigrams: DataFrame) -> DataFrame:
    """(code, words): the words that each distinct code stands for, by the counts `trigrams` (key, n) of all texts."""
    codes = written(codes.select("code").distinct(), "codes")
    size = codes.agg(F.sum(F.length("code"))).first()[0] or 0
    blocks = codes.select("code", F.pmod(F.xxhash64("code"), F.lit(1 + size // _BLOCK)).alias("block"))

    def need(own: pa.Table) -> pa.Table:
        found = set().union(*(passed(_lattice(code)) for code in own.column("code").to_pylist()))
        block = own.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(found), pa.int64()), "key": pa.array([_key(t) for t in found], pa.int64())})

    def read(own: pa.Table, costs: pa.Table) -> pa.Table:
        model = TableModel(costs.column("key").to_pylist(), costs.column("cost").to_pylist())
        names = own.column("code").to_pylist()
        words = [decode(code[1:], code[0] == "s", model) for code in names]
        words = [[w for w in ws if len(w) > 2] if code[0] == "s" else ws for code, ws in zip(names, words, strict=True)]
        return pa.table({"code": pa.array(names, pa.string()), "words": pa.array(words, pa.list_(pa.string()))})

    costs = trigram_costs(blocks.groupBy("block").applyInArrow(need, "block long, key long"), trigrams)
    return blocks.groupBy("block").cogroup(costs.groupBy("block")).applyInArrow(read, "code string, words array<string>")


def remainder(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def term_counts(train: DataFrame, trigrams: DataFrame) -> DataFrame:
    """(term, pos, neg) of train (row, text, toxic): documents of either label that hold a term in their restored text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 0, 4_000_000):
            ids, found = [], []
            for text, row in zip(texts, part.column(1).to_pylist(), strict=True):
                lower = text.decode().lower()
                own = {c for token in set(tokens_of(lower)) if not token.isalpha() or _THRICE.search(token) for c in codes_of(token)}
                own.update(spaced_codes(lower))
                ids += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["row", "code"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for part, texts in slices(batches, 0, 4_000_000):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label, read in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                own = {t for w in read or [] for t in terms(w)}
                for token in set(tokens_of(text.decode().lower())):
                    if token not in known:
                        plain = [t for w, disguised in pieces(token) if not disguised for t in terms(w)]
                        if len(token) > LONG:
                            own.update(plain)
                            continue
                        if len(known) > 60_000:
                            known.clear()
                        known[token] = plain
                    own.update(known[token])
                seen[label].update(own)
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][w] for w in names], pa.int64()),
                                              pa.array([seen[0][w] for w in names], pa.int64())], names=["term", "pos", "neg"])

    found = written(train.select("text", "row").mapInArrow(find, "row long, code string"), "train-codes")
    read = found.join(restored(found, trigrams), "code").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("read"))
    train = train.join(read, "row", "left").select("text", "toxic", "read")
    counted = train.mapInArrow(count, "term string, pos long, neg long")
    return counted.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0")


class WordModel:
    """Trigram counts, weights of terms, and a logistic curve over what a document's words add up to."""

    def __init__(self, trigrams: DataFrame, weights: dict[str, float], curve: list[float]):
        self.trigrams, self.weights, self.curve = trigrams, weights, curve


def _best(weights: dict[str, float], words: list[str]) -> float:
    return max((weights.get(t, 0.0) for w in words for t in terms(w)), default=0.0)


class _Scorer(dict):
    """Weight of a token, that of the strongest term of its words; of a disguised one its code."""

    def __init__(self, weights: dict[str, float], limit: int = 150_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, token: str) -> float | str:
        found = pieces(token)
        if found and found[0][1]:  # a token of tokens_of has one piece if any is disguised
            w = ("l" if len(found[0][0]) > LONG else "t") + found[0][0]
        else:
            w = _best(self.weights, [p for p, _ in found])
        if len(token) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[token] = w
        return w

    def features(self, text: str) -> tuple[float, float, float, list[str]]:
        lower = text.lower()
        tokens = tokens_of(lower)
        found = [w for w in map(self.__getitem__, set(tokens)) if w]
        plain = [w for w in found if type(w) is float]
        return sum(plain), max(plain, default=0.0), log(1.0 + len(tokens)), [w for w in found if type(w) is str] + spaced_codes(lower)


def _features(docs: DataFrame, model: WordModel, carried: str, kind: str) -> DataFrame:
    """`carried` of `docs` (text and it) with three features of the text: total, top and length."""
    weights = model.weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(weights)
        for part, texts in slices(batches, 0):
            rows = [scorer.features(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(3)),
                                              pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=[carried, "total", "top", "length", "codes"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, total, top = [], [], []
            for code, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # a token counts once, with its strongest word; letters apart and long strings word by word
                own = [_best(weights, words)] if code[0] == "t" else [_best(weights, [w]) for w in (words if code[0] == "s" else dict.fromkeys(words))]
                if any(own):
                    codes.append(code)
                    total.append(sum(own))
                    top.append(max(own))
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(total, pa.float64()), pa.array(top, pa.float64())], names=["code", "more", "high"])

    base = docs.mapInArrow(each, f"{carried} {kind}, total double, top double, length double, codes array<string>")
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "features")  # a row keeps its number once written
    codes = base.select("row", F.explode("codes").alias("code"))
    heavy = restored(codes, model.trigrams).mapInArrow(weigh, "code string, more double, high double")
    hits = codes.join(heavy, "code").groupBy("row").agg(F.sum("more").alias("more"), F.max("high").alias("high"))
    return base.join(hits, "row", "left").select(
        carried, (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), F.greatest("top", F.coalesce("high", F.lit(0.0))).alias("top"), "length")


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    z, beta = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        pull = np.r_[1e-6, np.full(x.shape[1], penalty)]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * beta)
        beta = beta + np.clip(step, -5, 5)
    return beta


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> WordModel:
    """Learn from the labelled documents whose crc32 remainder isn't `held_out`.

    At most MAX_LABELLED of them (smallest hashes) are used, each text once, so copies don't count as evidence. Terms are
    learned on all remainders but the last; the curve over them on the last, where terms found by chance don't help.
    Labels that are null or neither 0 nor 1 are left out. Without labels of both kinds the curve is the plain rate.
    """
    trigrams = written(trigram_counts(docs), "trigrams")
    fold = remainder(F.col("doc_id"), folds)
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"), fold.alias("fold"))
    usable = usable.where(F.col("toxic").isin(0, 1) & (F.col("fold") != held_out))
    usable = usable.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # MAX_LABELLED rows of two numbers: a few MB at most
    marked = texts.select("doc_id", F.xxhash64("text").alias("digest")).join(F.broadcast(usable), F.col("doc_id") == F.col("_id"))
    single = marked.groupBy("digest").agg(F.min(F.struct("doc_id", "toxic", "fold")).alias("m")).select(F.col("m.doc_id").alias("_id"), "m.toxic", "m.fold")
    chosen = docs.sparkSession.createDataFrame(single.collect(), "_id long, toxic int, fold int")
    train = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic", "fold")
    train = written(train.withColumn("row", F.monotonically_increasing_id()), "train")
    last = (held_out - 1) % folds
    n = {r["toxic"]: r["n"] for r in chosen.where(F.col("fold") != last).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    p, q = (F.col("pos") + 0.5) / (pos + 1.0), (F.col("neg") + 0.5) / (neg + 1.0)
    weight = F.log(p / q)
    strength = weight / F.sqrt(1.0 / (F.col("pos") + 0.5) + 1.0 / (F.col("neg") + 0.5))
    counted = term_counts(train.where(F.col("fold") != last), trigrams).withColumns({"weight": weight, "strength": strength})
    best = counted.where((F.col("strength") >= 2.5) & (F.col("weight") >= 1.5) & (F.col("pos") >= 3)).orderBy(F.desc("strength"), "term").limit(MAX_TERMS)
    weights = {r["term"]: r["weight"] for r in best.select("term", "weight").collect()} if pos and neg else {}
    model = WordModel(trigrams, weights, [0.0, 0.0, 0.0, 0.0])
    rows = _features(train.where(F.col("fold") == last).select("text", "toxic"), model, "toxic", "int").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if len(y) and 0 < y.sum() < len(y):
        model.curve = _logistic(np.array([[r["total"], r["top"], r["length"]] for r in rows]), y).tolist()
    else:
        model.curve = [log((pos + 0.5) / (neg + 0.5)), 0.0, 0.0, 0.0]
    return model


def score(docs: DataFrame, model: WordModel) -> DataFrame:
    """(doc_id, score): the chance that a document is toxic. Null and empty texts are scored as texts without words."""
    b = model.curve
    found = _features(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), model, "doc_id", "long")
    line = F.lit(b[0]) + F.lit(b[1]) * F.col("total") + F.lit(b[2]) * F.col("top") + F.lit(b[3]) * F.col("length")
    return found.select("doc_id", (1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    The character model counts all texts; the word model learns from labels outside the held-out remainder. Only texts
    enter a score. Rows without a doc_id are scored, with a null held_out. Repeated rows are scored alike. Other columns
    aren't read. Empty tables give empty results. predicted is 1 from a score of 0.5 on.
    """
    model = fit(docs, labels, held_out, folds)
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
