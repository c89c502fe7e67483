"""Line de-duplication by a deletion-neighbourhood join. DataFrame functions only.

Two lines are near-equal if one word inserted, deleted or replaced turns one into the other (lines of at least
`min_words` words; shorter ones only if equal). A line's deletion neighbourhood is the set of its variants with one word
left out. Lines that differ in one word share a variant at the same place; a line that lacks a word of another equals
one of that one's variants. Variants travel as hashes and are joined by grouping them, which keeps the earliest line of
each group and never makes pairs.

Only lines that share half of their words' run with another line get variants: of two near-equal lines the half without
the edit is the same in both, so nothing is lost, and the edit lies in the other half, so only that half is varied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import written

_SPACES = r"[\x20\x09-\x0D]+"
_KEY = ["h1", "h2"]


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _words(line: Column) -> Column:
    """Words of a trimmed line that has any."""
    return F.split(line, _SPACES)


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line, h1, h2, halves): a row for each line that has words, its hashes and those of its halves.

    halves holds, for a line of n >= min_words words, the hashes of the first and last half of n words and of n - 1.
    """
    raw = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = raw.select("doc_id", "line", _trimmed(F.col("raw")).alias("t")).where(F.col("t") != "").select("doc_id", "line", _words(F.col("t")).alias("w"))
    n = F.size("w")

    def halves(of: Column) -> list[Column]:
        """Names of the two halves that a line of n words shares with the words that lines of `of` words leave."""
        head = F.floor(of / 2).cast("int")
        tail = of - head
        return [F.xxhash64(of, F.lit(0), F.slice("w", F.lit(1), head)), F.xxhash64(of, F.lit(1), F.slice("w", n - tail + 1, tail))]

    return rows.select(
        "doc_id", "line", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(7), "w").alias("h2"),
        F.when(n >= min_words, F.array(*halves(n), *halves(n - 1))).alias("halves"))


def near_lines(lines: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2): keys of lines with an earlier near-equal line, confirmed on the words."""
    firsts = written(lines.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "line")).alias("first"), F.first("halves").alias("halves")), "lines")
    # one hash names a line here: a clash marks a line in vain, no more
    halves = firsts.where(F.col("halves").isNotNull()).select("h1", F.posexplode("halves").alias("kind", "half"))
    # kinds 0, 1: halves of the line itself, which others' variants may equal; 2, 3: halves that its own variants keep
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("m"), F.max("kind").alias("top")).where("m > 1 and top > 1").select("half")
    marked = written(halves.join(shared, "half").groupBy("h1").agg(F.collect_set("kind").alias("kinds")), "marked")
    marked = firsts.select(*_KEY, "first").join(marked, "h1")
    # words of the marked lines, from the place where each stands first
    wanted = marked.select(F.col("first.doc_id").alias("doc_id"), F.struct(F.col("first.line").alias("line"), *_KEY, "kinds").alias("m"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("m").alias("marks"))
    texts = docs.where(F.col("text").isNotNull()).join(wanted, "doc_id").select("doc_id", F.split("text", "\n").alias("all"), F.explode("marks").alias("m"))
    rows = texts.select("doc_id", "m.*", _words(_trimmed(F.element_at("all", F.col("m.line") + 1))).alias("w")).dropDuplicates(_KEY)
    rows = written(rows.select(*_KEY, F.struct("doc_id", "line").alias("first"), "kinds", "w"), "marked-lines")

    n, w = F.size("w"), F.col("w")
    head = F.floor((n - 1) / 2).cast("int")
    late = F.when(F.array_contains("kinds", 2), F.sequence(head, n - 1)).otherwise(F.array().cast("array<int>"))
    early = F.when(F.array_contains("kinds", 3) & (head > 0), F.sequence(F.lit(0), head - 1)).otherwise(F.array().cast("array<int>"))

    def without(i: Column) -> Column:
        return F.concat(F.slice(w, F.lit(1), i), F.slice(w, i + 2, n))

    gaps = rows.select(*_KEY, "first", F.explode(F.concat(early, late)).alias("gap"), "w")
    variants = gaps.select(*_KEY, "first", "gap", F.xxhash64(without(F.col("gap"))).alias("v1"))
    variants = written(variants, "variants")
    # replaced word: variants of two lines at the same place
    places = variants.groupBy("v1", "gap").agg(F.min(F.struct("first", *_KEY)).alias("e"), F.count(F.lit(1)).alias("m")).where("m > 1")
    replaced = variants.join(places.select("v1", "gap", "e"), ["v1", "gap"]).where(F.col("e.first") < F.col("first"))
    # word left out: a line and another's variant; the earliest of either kind is what the other kind needs
    plain = rows.select(*_KEY, "first", F.xxhash64("w").alias("v1"))
    earliest_plain = plain.groupBy("v1").agg(F.min(F.struct("first", *_KEY)).alias("e"))
    earliest_cut = variants.groupBy("v1").agg(F.min(F.struct("first", *_KEY)).alias("e"))
    longer = variants.join(earliest_plain, "v1").where(F.col("e.first") < F.col("first"))
    shorter = plain.join(earliest_cut, "v1").where(F.col("e.first") < F.col("first"))
    met = replaced.select(*_KEY, "e").union(longer.select(*_KEY, "e")).union(shorter.select(*_KEY, "e"))
    met = met.select(*_KEY, F.col("e.h1").alias("g1"), F.col("e.h2").alias("g2")).distinct()
    # edit distance of one, on the words: what two lines share from the front and from the back
    mine = rows.select(*_KEY, "w")
    theirs = rows.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("w").alias("u"))
    pairs = met.join(mine, _KEY).join(theirs, ["g1", "g2"])
    short = F.least(F.size("w"), F.size("u"))
    fore = F.coalesce(F.array_position(F.zip_with("w", "u", lambda x, y: F.coalesce(x == y, F.lit(False))), False), F.lit(0))
    aft = F.coalesce(F.array_position(F.zip_with(F.reverse("w"), F.reverse("u"), lambda x, y: F.coalesce(x == y, F.lit(False))), False), F.lit(0))
    common = F.least(F.when(fore == 0, short).otherwise(fore - 1) + F.when(aft == 0, short).otherwise(aft - 1), short)
    one_edit = (F.abs(F.size("w") - F.size("u")) <= 1) & (F.greatest(F.size("w"), F.size("u")) - common <= 1) & (F.least(F.size("w"), F.size("u")) >= min_words)
    return pairs.where(one_edit).select(*_KEY).distinct()


def removed_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(doc_id, removed): line numbers (from 0) that go from each document that loses any."""
    lines = written(lines_of(docs, min_words), "document-lines")
    near = near_lines(lines, docs, min_words).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.lit(True).alias("near"))
    firsts = lines.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("times"))
    judged = firsts.join(near, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    judged = judged.where("times > 1 or near").select(*_KEY, "first", F.coalesce("near", F.lit(False)).alias("near"))
    judged = written(judged, "judged-lines")  # one row per line text: a very common line's rows can then be split
    gone = lines.select("doc_id", "line", *_KEY).join(judged, _KEY).where(F.col("near") | (F.struct("doc_id", "line") > F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """`docs` with text reduced to lines that no earlier line equals or nearly equals, n_lines and n_removed.

    Lines end at a line feed; earlier means a smaller doc_id, then an earlier line; white space between words doesn't
    count. A line goes if any earlier line of the input is equal or, from `min_words` words on, one word away. Lines
    without words stay. A null text stays null. A doc_id must stand for one text: rows that repeat a document keep the
    same lines. Rows without doc_id stay as they are. Other columns pass through. An empty table gives an empty result.
    """
    gone = removed_lines(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("__id"), F.col("removed").alias("__removed"))
    joined = docs.join(gone, F.col("doc_id") == F.col("__id"), "left").withColumn("__lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__removed")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i + 1)), "\n"))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.select(
        *others, text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).cast("long").alias("n_removed"))
