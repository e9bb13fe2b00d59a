"""A stored positional index over shards of captions: built once, added to shard by shard, asked again and again.

Captions of one block meet in one task, which makes all of its postings; they travel to their folders as one compressed
batch for each bucket. An index that an earlier version stored, with folders below "postings", must be built anew.

A posting block holds what one token has in BLOCK_ROWS rows of a shard: gaps between rows and between places, a pair for
each occurrence (0 as the gap of a row that goes on). Blocks lie in folders by shard and by the token's bucket, sorted by
token, so a lookup opens the buckets of its tokens and skips row groups by their statistics. A shard that is added again
replaces what it had; others are left as they are. Beside the postings there is a row for each caption with its length.

A phrase is found by intersecting places: blocks of its tokens that share shard and block meet in one group, whose size
is bounded by the block's rows. Names are compiled as for a scan of the texts, so both ways give the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.text import spaced_caption
from seamline.operators.matching import MAX_BROADCAST_SYNONYMS
from seamline.storage import dealt_out, stored

BLOCK_ROWS, BUCKETS = 1024, 64
#: Up to so many tokens are named in the scan's filter, so that it can skip row groups.
MAX_LISTED = 2_000
POSTINGS = "token string, block long, first long, n_rows int, rows array<int>, places array<int>, shard int, bucket int"
LENGTHS = "row long, n int, shard int"
#: What a packed batch of postings holds, and about how many bytes of them are unpacked at a time.
PACKED = pa.schema([("token", pa.string()), ("first", pa.int64()), ("n_rows", pa.int32()), ("rows", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])
OUT_BYTES = 8 << 20


def _bucket(token: Column) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(BUCKETS)).cast("int")


def _packed(group: pa.Table) -> pa.Table:
    """(shard, block, bucket, size, packed): the postings of one block of a shard, one compressed batch for each bucket that has any."""
    group = group.combine_chunks().sort_by("row")
    texts = pc.split_pattern(group.column("hay").combine_chunks(), " ")
    caption, token = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy()), texts.flatten()
    said = pc.not_equal(token, "")
    caption, token = caption[said.to_numpy(zero_copy_only=False)], token.filter(said)
    row = group.column("row").to_numpy()[caption]
    place = np.arange(len(caption)) - np.searchsorted(caption, caption)  # from 0 in each caption
    coded = token.dictionary_encode()
    bucket = np.array([zlib.crc32(t.encode()) % BUCKETS for t in coded.dictionary.to_pylist()], np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    number = np.empty(len(bucket), np.uint16 if len(bucket) <= 1 << 16 else np.uint32)
    number[by_bucket] = np.arange(len(bucket))
    number = number[coded.indices.to_numpy()]
    order = np.argsort(number, kind="stable")
    number, row, place = number[order], row[order], place[order]
    fresh = np.append(True, number[1:] != number[:-1])[: len(number)]
    moved = fresh | np.append(True, row[1:] != row[:-1])[: len(row)]
    starts = np.flatnonzero(fresh)
    row_gaps = np.where(fresh, 0, np.diff(row, prepend=row[:1]))
    place_gaps = np.where(moved, place, np.diff(place, prepend=place[:1]))
    n_rows = np.add.reduceat(moved, starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32)
    ends = pa.array(np.append(starts, len(number)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (row_gaps, place_gaps)]
    whole = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(by_bucket)).cast(pa.string()), pa.array(row[starts]), pa.array(n_rows), *lists], schema=PACKED)
    cuts = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))
    there = np.flatnonzero(np.diff(cuts))
    plain = [whole.slice(cuts[b], cuts[b + 1] - cuts[b]).serialize() for b in there]
    same = lambda name, kind: pa.array(np.full(len(there), group.column(name)[0].as_py()), kind)
    columns = [same("shard", pa.int32()), same("block", pa.int64()), pa.array(there, pa.int32()), pa.array([x.size for x in plain], pa.int64()), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in plain], pa.binary())]
    return pa.table(columns, names=["shard", "block", "bucket", "size", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting blocks from packed ones, about OUT_BYTES at a time."""
    held, size = [], 0

    def joined() -> Iterator[pa.RecordBatch]:
        return iter(pa.concat_tables(held).combine_chunks().to_batches())

    for batch in batches:
        for x in batch.to_pylist():
            one = pa.ipc.read_record_batch(pa.py_buffer(pa.decompress(x["packed"], x["size"], codec="zstd")), PACKED)
            fixed = {"block": pa.int64(), "shard": pa.int32(), "bucket": pa.int32()}
            filled = {k: pa.array(np.full(len(one), x[k]), t) for k, t in fixed.items()}
            held.append(pa.table([one.column(0), filled["block"], *one.columns[1:], filled["shard"], filled["bucket"]], names=["token", "block", *PACKED.names[1:], "shard", "bucket"]))
            size += x["size"]
            if size > OUT_BYTES:
                yield from joined()
                held, size = [], 0
    if held:
        yield from joined()


def add_shards(captions: DataFrame, root: str, shard: str = "shard", row: str = "row", text: str = "text") -> None:
    """Puts the captions' shards into the index. (shard, row) names a caption.

    Captions of one block meet in one task, and their postings go on to their folders compressed; no row is made for an
    occurrence of a token.
    """
    spark = captions.sparkSession
    rows = dealt_out(captions).select(F.col(shard).cast("int").alias("shard"), F.col(row).cast("long").alias("row"), F.trim(F.coalesce(spaced_caption(F.col(text)), F.lit(""))).alias("hay"))
    blocks = rows.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS)).groupBy("shard", "block").applyInArrow(_packed, "shard int, block long, bucket int, size long, packed binary")
    # dealt out evenly and in a stated number: by their packed size, partitions would be joined to too large ones
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartitionById(tasks, F.pmod(F.col("shard") * BUCKETS + F.col("bucket"), F.lit(tasks)).cast("int"))
    laid = dealt.mapInArrow(_unpacked, POSTINGS).sortWithinPartitions("shard", "bucket", "token", "block")
    put = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root.rstrip('/')}/{name}")
    put(laid, "blocks", "shard", "bucket")
    n = F.when(F.col("hay") == "", 0).otherwise(F.size(F.split("hay", " ")))
    put(rows.select("row", n.alias("n"), "shard").repartition("shard"), "lengths", "shard")


def lengths(spark: SparkSession, root: str) -> DataFrame:
    """(shard, row, n): the tokens of each caption."""
    return spark.read.schema(LENGTHS).parquet(f"{root.rstrip('/')}/lengths").select("shard", "row", "n")


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST_SYNONYMS + 1).count() <= MAX_BROADCAST_SYNONYMS else df


def _terms(phrases: DataFrame, stored: DataFrame) -> DataFrame:
    """(phrase, k, n, first, token): the tokens of each different phrase; an open one stands for all that begin so."""
    each = phrases.select(F.explode("phrases").alias("p")).distinct()
    terms = each.select(phrase_id(F.col("p")).alias("phrase"), F.size("p.words").alias("n"), F.col("p.first").alias("first"), F.posexplode("p.words").alias("k", "token"))
    is_open = F.col("token").endswith("*")
    closed = terms.filter(~is_open)
    opened = terms.filter(is_open).withColumn("token", F.rtrim("token", F.lit("*")))
    if not opened.isEmpty():
        known = stored.select(F.col("token").alias("t")).distinct()
        closed = closed.unionByName(known.join(F.broadcast(opened), F.startswith("t", "token")).drop("token").withColumnRenamed("t", "token"))
    return closed.select("phrase", "k", "n", "first", "token", _bucket(F.col("token")).alias("bucket"))


def phrase_id(phrase: Column) -> Column:
    return F.xxhash64(phrase)


def _decoded(first: int, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = rows != 0
    new[0] = True
    total = np.cumsum(places)
    starts = np.flatnonzero(new)
    before = (total - places)[starts]
    return first + np.cumsum(rows), total - np.repeat(before, np.diff(np.append(starts, len(rows))))


def _intersected(group: pa.Table) -> pa.Table:
    """(phrase, shard, row, hits) of one phrase in one block: starts at which each of its tokens stands in its place."""
    n, at_first = group.column("n")[0].as_py(), group.column("first_only")[0].as_py()
    schema = pa.schema([("phrase", pa.int64()), ("shard", pa.int32()), ("row", pa.int64()), ("hits", pa.int32())])
    by_k: dict[int, list[np.ndarray]] = {}
    for k, first, rows, places in zip(*(group.column(c).to_pylist() for c in ("k", "first", "rows", "places"))):
        r, p = _decoded(first, np.array(rows, np.int64), np.array(places, np.int64))
        start = p - k
        by_k.setdefault(k, []).append((r - first // BLOCK_ROWS * BLOCK_ROWS << 40 | start)[start >= 0])
    if len(by_k) < n:
        return schema.empty_table()
    found = None
    for k in sorted(by_k, key=lambda k: sum(map(len, by_k[k]))):  # the rarest token first
        here = np.unique(np.concatenate(by_k[k]))
        found = here if found is None else np.intersect1d(found, here, assume_unique=True)
        if not len(found):
            return schema.empty_table()
    if at_first:
        found = found[found & ((1 << 40) - 1) == 0]
    rows, hits = np.unique(found >> 40, return_counts=True)
    base = group.column("block")[0].as_py() * BLOCK_ROWS
    return pa.table([pa.array(np.full(len(rows), group.column("phrase")[0].as_py())), pa.array(np.full(len(rows), group.column("shard")[0].as_py(), np.int32)), pa.array(base + rows), pa.array(hits.astype(np.int32))], schema=schema)


def phrase_hits(spark: SparkSession, root: str, phrases: DataFrame) -> DataFrame:
    """(phrase, shard, row, hits): how often each phrase of compiled names stands in each caption that has it. No text is read."""
    stored = spark.read.schema(POSTINGS).parquet(f"{root.rstrip('/')}/blocks")
    terms = _terms(phrases.filter("not skipped"), stored)
    listed = [r[0] for r in terms.select("token").distinct().limit(MAX_LISTED + 1).collect()]
    if len(listed) <= MAX_LISTED:
        stored = stored.filter(F.col("token").isin(listed))
    met = stored.join(_sent(terms.withColumnRenamed("first", "first_only")), ["token", "bucket"])
    schema = "phrase long, shard int, row long, hits int"
    return met.select("phrase", "k", "n", "first_only", "shard", "block", "first", "rows", "places").groupBy("phrase", "shard", "block").applyInArrow(_intersected, schema)


def indexed_matches(spark: SparkSession, root: str, phrases: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(shard, row, class_id, synonym, prio): captions that hold all phrases of a name, as a scan of the texts finds them."""
    hits = phrase_hits(spark, root, phrases) if hits is None else hits
    asked = phrases.filter("not skipped").select("class_id", "synonym", "prio", F.array_distinct(F.transform("phrases", phrase_id)).alias("ids"))
    asked = asked.withColumn("_need", F.size("ids")).select("*", F.explode("ids").alias("phrase")).drop("ids")
    met = hits.join(_sent(asked), "phrase")
    many = met.filter("_need > 1").groupBy("shard", "row", "class_id", "synonym", "prio", "_need").agg(F.count(F.lit(1)).alias("_n")).filter("_n = _need")
    keys = ["shard", "row", "class_id", "synonym", "prio"]
    return met.filter("_need = 1").select(*keys).unionByName(many.select(*keys))


def ranked(spark: SparkSession, root: str, phrases: DataFrame, k: int | None = None) -> DataFrame:
    """(shard, row, class_id, synonym, prio, score, rank): matches of a name in each shard by BM25, the most relevant first.

    Each phrase of a name is a term; its frequency and the lengths are those of the shard. k1 1.2, b 0.75; a phrase in half of a
    shard's captions or more weighs 1e-6. Ties go by row.
    """
    k1, b = 1.2, 0.75
    hits = stored(phrase_hits(spark, root, phrases))  # counted and scored: places are intersected once
    sizes = lengths(spark, root)
    per_shard = sizes.groupBy("shard").agg(F.count(F.lit(1)).alias("_rows"), F.avg("n").alias("_mean"))  # a row for each shard
    frequency = hits.groupBy("phrase", "shard").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.ln((F.col("_rows") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = frequency.join(F.broadcast(per_shard), "shard").select("phrase", "shard", "_mean", F.when(idf <= 0, 1e-6).otherwise(idf).alias("_idf"))
    tf = F.col("hits").cast("double")
    part = F.col("_idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("_mean")))
    scored = hits.join(weights, ["phrase", "shard"]).join(sizes, ["shard", "row"]).select("phrase", "shard", "row", part.alias("part"))
    asked = phrases.filter("not skipped").select("class_id", "synonym", "prio", F.size("phrases").alias("_need"), F.explode(F.transform("phrases", phrase_id)).alias("phrase"))
    keys = ["shard", "row", "class_id", "synonym", "prio"]
    out = scored.join(_sent(asked), "phrase").groupBy(*keys, "_need").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("_n")).filter("_n = _need")
    out = out.select(*keys, "score", F.row_number().over(W.partitionBy("class_id", "synonym", "shard").orderBy(F.desc("score"), "row")).alias("rank"))
    return out if k is None else out.filter(F.col("rank") <= k)
