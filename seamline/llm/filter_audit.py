"""How document filters overlap: every order of five filters, counted from one scan of the texts.

The scan reads Arrow's buffers as they are: byte classes by one table look-up, words, capitals, symbols and code points
as differences of prefix sums at the documents' offsets. Distinct words come from hashes of all words of a block at once
(polynomials of a prefix sum, brought to a common place by the inverse power), sorted within each document; equal
neighbours are compared byte by byte, and a document where two different words share a hash is counted anew by a set.
Work goes in blocks of about a megabyte; a longer document goes in pieces that end at white space.

A document becomes five bits, one for each filter that it fails. Copies are found over digests: counts by (digest, part,
bits) first, so a hot text is a few rows before anything is gathered. The masks, at most 32 for each part, then give all
120 orders without looking at documents again.

Filters: A under 200 words; B 100 * distinct < 50 * words; C 100 * capitals > 3 * code points; D a symbol of #$%&*|;
E a smaller doc_id has the same text, anywhere in the table.

Defined results: a null text counts as empty (it fails A alone, or also E); very long texts are read whole; rows that
repeat an id are documents of their own, none a smaller id than another; a null id is no smaller id and never fails E,
and has no labels; of several labels of an id any 1 counts; a null part is the empty string; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.common import whole

LETTERS = "ABCDE"
BLOCK = 1 << 20
SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8


def _classes() -> np.ndarray:
    of = np.zeros(256, np.uint8)
    of[[0x20, *range(0x09, 0x0E)]] |= SPACE
    of[ord("A") : ord("Z") + 1] |= CAPITAL
    of[[ord(c) for c in "#$%&*|"]] |= SYMBOL
    of[0x80:0xC0] |= INNER  # the later bytes of a code point
    return of


CLASSES = _classes()
_VALUES = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each b[s:e] that doesn't hang on its place."""
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * up[: len(b)], dtype=np.uint64, out=sums[1:])
    h = (sums[e] - sums[s]) * down[s]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _same_bytes(data: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[p:p+n] and data[q:q+n] are the same, for each of many; in slices of a few blocks' bytes."""
    out = np.ones(len(p), bool)
    ends = np.cumsum(n)
    low = 0
    while low < len(p):
        before = ends[low] - n[low]
        high = max(low + 1, int(np.searchsorted(ends, before + 2 * BLOCK, "right")))
        size = n[low:high]
        first = ends[low:high] - size - before
        inside = np.arange(int(size.sum())) - np.repeat(first, size)
        same = data[np.repeat(p[low:high], size) + inside] == data[np.repeat(q[low:high], size) + inside]
        out[low:high] = np.logical_and.reduceat(same, first)
        low = high
    return out


def distinct_words(data: np.ndarray, doc: np.ndarray, h: np.ndarray, s: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
    """Distinct words of each document; doc (ascending), h, s and n are the words' documents, hashes, places and sizes."""
    key = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[again], order[again + 1]
    ok = n[a] == n[b]
    ok[ok] = _same_bytes(data, s[a[ok]], s[b[ok]], n[a[ok]])
    out = np.bincount(doc, minlength=docs) - np.bincount(doc[a[ok]], minlength=docs)
    for k in np.unique(doc[a[~ok]]):
        low, high = np.searchsorted(doc, [k, k + 1])
        out[k] = len({data[x : x + y].tobytes() for x, y in zip(s[low:high], n[low:high])})
    return out


def _words(b: np.ndarray, cls: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; documents end words. starts and ends are those of documents that aren't empty."""
    inside = (cls & SPACE) == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[starts] = inside[starts]
    last[ends - 1] = inside[ends - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _pieces(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Pieces of a long document that end at white space, or where a longer word ends."""
    while low < high:
        cut = min(low + BLOCK, high)
        if cut < high:
            spaces = np.flatnonzero(CLASSES[data[low:cut]] & SPACE)
            if len(spaces):
                cut = low + int(spaces[-1]) + 1
            else:
                while cut < high and not CLASSES[data[cut]] & SPACE:
                    step = np.flatnonzero(CLASSES[data[cut : cut + BLOCK]] & SPACE)
                    cut = cut + int(step[0]) if len(step) else min(cut + BLOCK, high)
        yield low, cut
        low = cut


def _scan_block(data: np.ndarray, o: np.ndarray, out: np.ndarray) -> None:
    """Counts of the documents data[o[k]:o[k + 1]], into the rows of out: words, distinct, capitals, code points, symbols."""
    low, high = int(o[0]), int(o[-1])
    b, at = data[low:high], o - low
    if not len(b):
        return
    cls = CLASSES[b]
    full = at[1:] > at[:-1]
    s, e = _words(b, cls, at[:-1][full], at[1:][full])
    doc = np.searchsorted(at, s, "right") - 1
    sums = np.zeros(len(b) + 1, np.int64)
    for column, bit in ((2, CAPITAL), (3, INNER), (4, SYMBOL)):
        np.cumsum((cls & bit) != 0, out=sums[1:])
        out[:, column] = sums[at[1:]] - sums[at[:-1]]
    out[:, 3] = at[1:] - at[:-1] - out[:, 3]
    out[:, 0] = np.bincount(doc, minlength=len(out))
    if len(s):
        out[:, 1] = distinct_words(b, doc, word_hashes(b, s, e), s, e - s, len(out))


def _scan_long(data: np.ndarray, low: int, high: int, out: np.ndarray) -> None:
    places, sizes, hashes = [], [], []
    for x, y in _pieces(data, low, high):
        b = data[x:y]
        cls = CLASSES[b]
        s, e = _words(b, cls, np.array([0]), np.array([y - x]))
        out[2] += np.count_nonzero(cls & CAPITAL)
        out[3] += len(b) - np.count_nonzero(cls & INNER)
        out[4] += np.count_nonzero(cls & SYMBOL)
        places.append(s + x)
        sizes.append(e - s)
        hashes.append(word_hashes(b, s, e))
    s, n, h = map(np.concatenate, (places, sizes, hashes))
    out[0] = len(s)
    if len(s):
        out[1] = distinct_words(data, np.zeros(len(s), np.int64), h, s, n, 1)[0]


def scan_texts(texts: pa.Array) -> np.ndarray:
    """An array of (words, distinct words, capitals, code points, symbols) for texts without nulls, from their buffers."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    out = np.zeros((len(texts), 5), np.int64)
    _, offsets, buffer = texts.buffers()
    if not len(texts) or buffer is None:
        return out
    o = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffer, np.uint8)
    low = 0
    while low < len(texts):
        if o[low + 1] - o[low] > BLOCK:
            _scan_long(data, int(o[low]), int(o[low + 1]), out[low])
            low += 1
            continue
        high = max(low + 1, int(np.searchsorted(o, o[low] + BLOCK, "right")) - 1)
        _scan_block(data, o[low : high + 1], out[low:high])
        low = high
    return out


def failure_bits(counts: np.ndarray) -> np.ndarray:
    words, distinct, capitals, chars, symbols = counts.T
    return (words < 200) * 1 + (100 * distinct < 50 * words) * 2 + (100 * capitals > 3 * chars) * 4 + (symbols > 0) * 8


def scanned(docs: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, digest, bits, words, distinct, capitals, chars, symbols), a row for each document."""
    names = ["words", "distinct", "capitals", "chars", "symbols"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole(text), 256)).alias("digest"), whole(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = scan_texts(batch.column(3))
            columns = [*[batch.column(k) for k in range(3)], pa.array(failure_bits(counts).astype(np.int32)), *[pa.array(c) for c in counts.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "bits", *names])

    return rows.mapInArrow(run, "doc_id long, part string, digest binary, bits int, " + ", ".join(f"{n} long" for n in names))


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail, bit k for letter k."""
    marks = _marks(labels)
    rows = scanned(docs, part, doc_id, text).select("doc_id", "part", "digest", "bits").join(marks, F.col("doc_id") == F.col("_l"), "left").drop("_l")
    keys = ["digest", "part", "bits", "good", "toxic"]
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    per_id = rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("c"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    # documents without an id have no smaller one, as they compare with none
    groups = per_id.groupBy(*keys).agg(F.sum("c").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("nameless"))
    smallest = F.min("first.doc_id").over(W.partitionBy("digest"))  # a few rows for each text: its parts and labels
    groups = groups.withColumn("free", F.col("nameless") + F.when(F.col("first.doc_id") == smallest, F.col("first.c")).otherwise(0))
    split = groups.withColumn("x", F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("free").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("free")).alias("n")))))
    cells = split.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"))
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("x.n")).otherwise(0))
    return cells.agg(F.sum("x.n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def _marks(labels: DataFrame) -> DataFrame:
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.groupBy(F.col("doc_id").alias("_l")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def audit(masks: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    # at most 32 cells for each part
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))

    def bits(x: Column) -> Column:
        return sum((F.when(F.contains(x, F.lit(c)), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(LETTERS)), F.lit(0))

    steps = steps.withColumn("own", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumns({"bit": bits(F.col("own")), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})

    def total(where, field: str = "n") -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda s, c: s + c[field])

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) > 0
    there = lambda c: c["mask"].bitwiseAND(F.col("before")) == 0
    removed = lambda c: there(c) & fails(c)
    out = steps.select(
        "part",
        "filter_order",
        "step",
        "own",
        total(lambda c: there(c) & ~fails(c)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda c: ~there(c) & fails(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )
    # 120 rows for each part and filter
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "own"))).drop("own")
