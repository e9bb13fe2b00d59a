"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

One permutation spreads the shingles over a ring, a second one, shifted by k places around the ring, gives the k-th
coordinate: h_k(S) = min over s in S of second[(first(s) + k) mod ring]. So a shingle's 128 values are one contiguous
run of a table, and all coordinates of a document are one minimum over rows.

1. Texts with the same words form a class, for which its smallest id stands.
2. Classes that share a band meet in a bucket. Every member is paired with two leaders, the bucket's smallest id and the
   member that meets most others over all its bands, never with all others. Pairs whose sizes or one-bit signatures rule
   out the similarity go; the rest is verified on full sets.
3. Verified links give components. In buckets that still hold several components, members outside the bucket's largest
   component are paired with members of other components, so that no link between components is lost to step 2. A
   member's shingles that no other such member has can't be in an intersection, and counts of the rest by class bound
   what a pair can share: in a large group of copies with edits of their own, few pairs are left to verify.

128 coordinates in 32 bands of 4 miss a pair of similarity 0.75 with probability (1 - 0.75^4)^32 = 5e-6; the bit filter
drops one with about 1e-5. A larger similarity makes both smaller.

Defined results: a null text counts as empty; documents without words have no shingles and are linked with nothing; a
row with a null id keeps a null component and is kept; rows with the same id count as one document, which is linked where
one of its texts is; very long texts are shingled whole; ties and repeated rows fall into one class; an empty table gives
an empty result; columns not named are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import whole, written
from seamline.llm.components import components
from seamline.llm.shingles import byte_slices, mix, normal_form, shingle_sets

COORDINATES, BANDS = 128, 32
RING = 1 << 20
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of the 128 one-bit coordinates, 16 differ on average at a similarity of 0.75; the deviation is 3.7.
MOST_BITS = 32
ROWS_AT_ONCE = 8192
#: Classes of shingles whose counts bound an intersection.
CLASSES = 128
_ring: list[np.ndarray] = []


def _second() -> np.ndarray:
    """The table of the second permutation, one row for each place of the ring: the values at the next 128 places."""
    if not _ring:
        order = np.argsort(mix(np.arange(RING, dtype=np.uint64) + np.uint64(77_000_001))).astype(np.uint32)
        around = np.concatenate([order, order[:COORDINATES]])
        _ring.append(np.lib.stride_tricks.sliding_window_view(around, COORDINATES))
    return _ring[0]


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, 128): circulant MinHash of each text's shingles; texts without any get the largest value."""
    table = _second()
    place = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    out = np.full((len(starts) - 1, COORDINATES), np.iinfo(np.uint32).max, np.uint32)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for low in range(0, len(place), ROWS_AT_ONCE):
        who = owner[low : low + ROWS_AT_ONCE]
        heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        least = np.minimum.reduceat(table[place[low : low + ROWS_AT_ONCE]], heads, axis=0)
        ids = who[heads]
        out[ids] = np.minimum(out[ids], least)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """(texts, 32) band keys; a band holds coordinates that are 32 places apart."""
    rows = signature.reshape(len(signature), COORDINATES // BANDS, BANDS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS))
    for j in range(COORDINATES // BANDS):
        key = mix(key * np.uint64(0x100000001B3) + rows[:, j, :])
    return key.view(np.int64)


def bits_of(signature: np.ndarray) -> np.ndarray:
    """(texts, 2): one hashed bit of every coordinate, in two 64-bit numbers."""
    bit = (mix(signature.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bit, axis=1).view(">u8").astype(np.uint64).view(np.int64)


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n, keys, s1, s2), written: one pass over the texts. digest is null without words."""
    schema = "doc_id long, digest binary, n long, keys array<long>, s1 long, s2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            for low, high in byte_slices(raw, 1 << 20):
                texts = raw.slice(low, high - low).to_pylist()
                shingles, starts = shingle_sets(texts)
                n = np.diff(starts)
                signature = signatures(shingles, starts)
                bits = bits_of(signature)
                digests = [hashlib.md5(normal_form(t)).digest() if k else None for t, k in zip(texts, n.tolist())]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32)), pa.array(bands_of(signature).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), keys, pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                    names=["doc_id", "digest", "n", "keys", "s1", "s2"],
                )

    return written(docs.select(F.col(doc_id).cast("long"), whole(text)).mapInArrow(run, schema), "described")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets have the similarity. texts: (doc_id, text), stored."""
    b_side = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = b_side.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                first = part.column(2).dictionary_encode()  # a leader's text comes in many rows
                of_a = first.indices.to_pylist()
                a_sets, a_at = shingle_sets(first.dictionary.cast(pa.binary()).to_pylist())
                b_sets, b_at = shingle_sets(part.column(3).cast(pa.binary()).to_pylist())
                keep = []
                for k, j in enumerate(of_a):
                    x, y = a_sets[a_at[j] : a_at[j + 1]], b_sets[b_at[k] : b_at[k + 1]]
                    merged = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                    keep.append(shared > 0 and 100 * shared >= PERCENT * (len(merged) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shared_shingles(texts: DataFrame) -> DataFrame:
    """(node, most, shared): of the shingles that some other document of texts has too, how many there are and how many
    fall into each of CLASSES classes. What two documents have in common is at most the sum, over the classes, of the
    smaller count.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            for low, high in byte_slices(raw, 1 << 20):
                sets, at = shingle_sets(raw.slice(low, high - low).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[low:high], np.diff(at))), pa.array(sets.view(np.int64))], names=["node", "shingle"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, alone = batch.column(1).cast(pa.binary()), batch.column(2)
            for low, high in byte_slices(raw, 1 << 20):
                sets, at = shingle_sets(raw.slice(low, high - low).to_pylist())
                most, shared = [], []
                for k, own in enumerate(alone.slice(low, high - low)):
                    mine = sets[at[k] : at[k + 1]].view(np.int64)
                    if own.is_valid:
                        mine = mine[~np.isin(mine, own.values.to_numpy(), assume_unique=True)]
                    most.append(len(mine))
                    shared.append(np.bincount(mine & (CLASSES - 1), minlength=CLASSES))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, CLASSES * len(most) + 1, CLASSES, dtype=np.int32)), pa.array(np.concatenate(shared), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(most, pa.int64()), lists], names=["node", "most", "shared"])

    rows = texts.select("doc_id", "text").mapInArrow(shingles, "node long, shingle long")
    one = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1")
    alone = one.groupBy("node").agg(F.collect_list("shingle").alias("alone"))  # no more than the document's own shingles
    both = texts.join(alone, F.col("doc_id") == F.col("node"), "left").select("doc_id", "text", "alone")
    return both.mapInArrow(counted, "node long, most long, shared array<int>")


def _possible(x: str, y: str) -> Column:
    """What sizes and one-bit signatures leave open."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    sizes = (nx * 100 >= ny * PERCENT) & (ny * 100 >= nx * PERCENT)
    return sizes & (F.bit_count(F.col(f"{x}s1").bitwiseXOR(F.col(f"{y}s1"))) + F.bit_count(F.col(f"{x}s2").bitwiseXOR(F.col(f"{y}s2"))) <= MOST_BITS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs."""
    rows = described(docs, doc_id, text)
    classes = written(rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    own = classes.withColumnRenamed("digest", "_d")
    reps = rows.join(own, (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("_d"))).dropDuplicates(["rep", "digest"])
    reps = written(reps.select("rep", "n", "s1", "s2", "keys"), "reps")  # a row for each of the texts of an id
    banded = reps.select(F.explode("keys").alias("key"), "rep")
    sizes = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low")).filter("size > 1"), "sizes")
    met = written(banded.join(sizes, "key"), "met")
    degrees = met.groupBy("rep").agg(F.sum("size").alias("degree"))
    hubs = written(met.join(degrees, "rep").groupBy("key").agg(F.max_by("rep", "degree").alias("hub")), "hubs")
    to_low, to_hub = met.select("rep", F.col("low").alias("lead")), met.join(hubs, "key").select("rep", F.col("hub").alias("lead"))
    pairs = to_low.union(to_hub).filter("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()

    def facts(side: str) -> DataFrame:
        return reps.select(F.col("rep").alias(side), *[F.col(c).alias(side + c) for c in ("n", "s1", "s2")])

    pairs = written(pairs.join(facts("a"), "a").join(facts("b"), "b").filter(_possible("a", "b")).select("a", "b").distinct(), "pairs")
    nodes = met.select(F.col("rep").alias("node")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    texts = texts.join(nodes, F.col("doc_id") == F.col("node"), "left_semi").withColumn("_h", F.md5("text"))
    texts = written(texts.dropDuplicates(["doc_id", "_h"]).drop("_h"), "texts")
    links = verified(pairs, texts)
    several = rows.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b"))
    several = written(several.filter("_a <> _b").select("doc_id"), "several")
    if not several.isEmpty():  # an id with several texts links their classes
        of_ids = rows.join(several, "doc_id").join(classes, "digest").select("doc_id", "rep").distinct()
        least = of_ids.groupBy("doc_id").agg(F.min("rep").alias("a"))
        links = links.union(of_ids.join(least, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")))
    links = written(links.distinct(), "links")
    labels = written(components(links), "first-labels")

    # what leaders didn't join: members outside a bucket's largest component, against those of other components
    own = met.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    own = written(own, "own")
    held = own.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
    mixed = written(held.groupBy("key").agg(F.max_by("c", "size").alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "mixed")
    left = written(own.join(mixed, "key").select("key", "rep", "c", "main"), "left")
    some = left.select("rep").distinct()
    shares = shared_shingles(texts.join(some, F.col("doc_id") == F.col("rep"), "left_semi"))
    bounded = reps.select("rep", "n", "s1", "s2").join(shares, F.col("rep") == F.col("node")).drop("node")
    bounded = written(bounded.filter(F.col("most") * 100 >= F.col("n") * PERCENT), "bounded")
    left = written(left.join(bounded, "rep"), "left")
    x, y = (left.select("key", *[F.col(k).alias(side + k) for k in ("rep", "c", "main", "n", "s1", "s2", "most", "shared")]) for side in "xy")
    needed = (F.col("xn") + F.col("yn")) * PERCENT
    common = F.aggregate(F.zip_with("xshared", "yshared", lambda i, j: F.least(i, j)), F.lit(0), lambda s, v: s + v)
    enough = (F.least("xmost", "ymost") * (100 + PERCENT) >= needed) & (common * (100 + PERCENT) >= needed)
    once = (F.col("yc") == F.col("ymain")) | (F.col("xrep") < F.col("yrep"))
    more = x.filter("xc <> xmain").join(y, (x.key == y.key) & (F.col("xc") != F.col("yc")) & once & _possible("x", "y") & enough)
    more = more.select(F.least("xrep", "yrep").alias("a"), F.greatest("xrep", "yrep").alias("b")).distinct()
    more = written(more.join(pairs, ["a", "b"], "left_anti"), "more")
    further = written(verified(more, texts).distinct(), "further")
    if not further.isEmpty():  # links between components: these stand for their members
        of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias("c" + side))
        between = further.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(written(between, "between")).select(F.col("node").alias("component"), F.col("component").alias("lowest"))
        ends = further.select(F.col("a").alias("node")).union(further.select("b")).distinct()
        known = labels.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("component"))
        labels = known.join(joined, "component", "left").select("node", F.coalesce("lowest", "component").alias("component"))

    named = written(classes.join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("class_component")), "named")
    out = rows.select("doc_id", "digest", "n").join(named, "digest", "left")
    component = F.coalesce("class_component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
