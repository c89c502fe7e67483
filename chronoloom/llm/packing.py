"""Best-fit packing of tokenised documents into sequences of fixed capacity (minimum bin slack).

A piece is described by its length, and lengths run from 1 to the capacity, so the packing problem is the histogram of
lengths: at most `capacity` numbers, however many documents there are. The slack-minimising search runs on that
histogram and gives a short list of patterns (which lengths share a sequence, and how often). Spark then deals pieces
to the slots of their length by rank; nothing larger than the histogram leaves the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import slices
from chronoloom.session import written

_PIECES = "doc_id long, piece int, start long, length long, ids binary"
# Where a space stands between two characters that aren't white space, byte-level BPE always begins a new unit.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
# Fixed value: how this kind of tokenizer cuts a text before it merges bytes.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Merger:
    """Ids of texts, as little-endian 32-bit bytes.

    The tokenizer file gives the vocabulary. Where its ids are in the order of its merges, units that aren't known yet
    are merged by tiktoken from that same vocabulary, which costs a fifth; else by tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unit = self._merger(path) or self.encode

    def _merger(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != sorted(made) or self.tokenizer.normalizer is not None:
            return None
        # Each byte is shown as one printable character: itself where it is one, else the next from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(map(shown.__getitem__, t)): i for t, i in vocabulary.items() if t not in self.specials}
        merge = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda unit: np.array(merge(unit), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Units(dict):
    """Ids of the units between single spaces, remembered by one task; forgets all before it holds more than `limit`."""

    def __init__(self, merger: _Merger, limit: int = 150_000):
        super().__init__()
        self.merger, self.limit = merger, limit

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[unit] = ids = self.merger.unit(unit)
        return ids

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.merger.specials):  # a special token's string may reach over a space
            return self.merger.encode(text)
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text):
            head, *rest = _SPLIT.split(text)
        else:
            head, *rest = text.split(" ")
        return self[head] + b"".join([self[u] for u in map(" ".__add__, rest)]) if text else b""


@lru_cache(maxsize=1)
def _merger(path: str) -> _Merger:
    """Loaded once by each worker."""
    return _Merger(path)


def cut_tokens(docs: DataFrame, tokenizer: str, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of each document's ids followed by `eos`.

    `tokenizer` is the file of a byte-level BPE tokenizer that every executor has. ids: unsigned 32-bit, little-endian.
    A document longer than `capacity` is cut into pieces of `capacity`, of which the first may be shorter. A null or
    empty text is the one token `eos`. Null doc_ids and repeated rows are kept as rows of their own. Whole texts are
    read; only doc_id and text are used of the columns.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, tail = _Units(_merger(tokenizer)), np.array([eos], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids", pa.binary())])
        for part, texts in slices(batches, 1):
            out: list[tuple] = []
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = units.of(text.decode()) + tail
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                out += [(doc, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, _PIECES)


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """The combination of available lengths that fills `room` most; among equals the one with the longest pieces.

    Bit t of a reach set says that a sum of t is feasible. One set is kept per length (copies in powers of two), from
    short to long, and the choice is read back from the longest down.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in np.nonzero(counts[: room + 1])[0].tolist():
        left, copies = min(int(counts[length]), room // length), 1
        while left > 0:
            take = min(copies, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, copies = left - take, copies * 2
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(layers):
        if total >= length * take and before >> (total - length * take) & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def slack_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use up the histogram: each holds the longest piece left and the fullest rest.

    A pattern is repeated as often as the counts allow, so there are far fewer patterns than sequences.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    while counts.any():
        longest = int(np.nonzero(counts)[0][-1])
        counts[longest] -= 1
        lengths = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        used = np.bincount(lengths, minlength=capacity + 1)
        times = int((counts[used > 0] // used[used > 0]).min())
        counts -= used * times
        out.append((times, lengths))
    return out


def best_fit(pieces: DataFrame, by: Sequence[str], capacity: int = 1024, length: str = "length") -> DataFrame:
    """`pieces` with sequence_id and offset: every sequence holds at most `capacity`, places are gapless from 0.

    `by` are columns that order pieces of one length, so that reruns agree; rows equal in all of them are exchanged
    freely. Lengths must lie in 1..capacity (else ValueError). An empty table gives an empty result. Read twice, so
    hand in a table that is cheap to read. The rows of a length are dealt to as many buckets as the square root of the
    largest count, so neither the rows of a bucket nor the buckets of a length are many.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    rows = pieces.groupBy(length).count().collect()  # one row per length: at most `capacity`
    histogram = {r[0]: r[1] for r in rows}
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    slots, base = [], 0
    filled = dict.fromkeys(histogram, 0)
    for times, lengths in slack_patterns(histogram, capacity):
        place = 0
        for size in sorted(set(lengths), reverse=True):
            many = lengths.count(size)
            slots.append((size, filled[size], filled[size] + times * many, many, base, place))
            filled[size] += times * many
            place += many * size
        base += times
    # One row per length and pattern: bounded by the capacity, not by the data.
    plan = spark.createDataFrame(slots, "__l long, __from long, __to long, __many long, __base long, __place long")
    buckets = math.isqrt(max(histogram.values(), default=0)) + 1
    keyed = pieces.withColumn("__b", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    sums = keyed.groupBy(F.col(length).alias("__l"), F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__l").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__l", "__c", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(length, "__b").orderBy(*by)) - 1)
    ranked = ranked.join(sums, (F.col(length) == F.col("__l")) & (F.col("__b") == F.col("__c"))).drop("__l")
    rank = F.col("__r") + F.col("__before")
    placed = ranked.withColumn("__rank", rank).join(
        F.broadcast(plan), (F.col(length) == F.col("__l")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    at = F.col("__rank") - F.col("__from")
    return placed.select(
        *pieces.columns,
        (F.col("__base") + F.floor(at / F.col("__many"))).cast("long").alias("sequence_id"),
        (F.col("__place") + at % F.col("__many") * F.col(length)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """Pieces of all documents with ids, sequence_id and offset. Tokens are written once; placing moves no ids.

    Returns doc_id, piece, start, length, ids_crc32 (of the piece's ids), sequence_id, offset. The ids themselves are
    in `cut_tokens`, which `sequences` joins to the places.
    """
    tokens = written(cut_tokens(docs, tokenizer, capacity, eos), "tokens")
    narrow = tokens.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit(narrow, ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences; tokens from `cut_tokens` of documents with unique doc_ids."""
    parts = placed.select("doc_id", "piece", "sequence_id", "offset").join(tokens, ["doc_id", "piece"])
    rows = parts.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    hexed = F.aggregate("parts", F.lit(""), lambda a, p: F.concat(a, F.hex(p["ids"])))
    return rows.select("sequence_id", "length", F.unhex(hexed).alias("ids"))
