"""Hard negatives for anchors by bit-sliced integer products.

Components become whole numbers, floor(scale * x), and a row's score with an anchor is their inner product. A row's
components are cut into bit-planes. Planes are multiplied with the anchors most significant first; what is left of a
component lies between 0 and 2^k - 1, so after each plane every score lies in an interval whose ends hang on the
anchor's positive and negative components alone. A pair is dropped once its interval can't qualify: for positives, when
its upper end is below the anchor's fifth best so far; for negatives, when it meets none of the anchor's score windows,
or only where three better rows are known. While many pairs are left a plane is one matrix product; then the few that
are left go on as a list. What is left after the last plane has its exact score.

Anchors are a stated set of queries that meets all rows in blocks: they are dealt by hashes into chunks of at most some
MAX_ANCHOR_BYTES, each is sent to the tasks once, and every task reads its own rows once for the positives and once for
the negatives. Rows are never shuffled; a task sends its best rows for each anchor, and these are ranked. Each chunk's
result is stored before its broadcasts go.

Defined results: rows without label or vector, or with a null or non-finite component, take no part; a null id is no
anchor and never a partner; shorter vectors count as padded with zeros; partners of an anchor that share id and score
count once, and so does an anchor that repeats wholly (id, label and vector); rows with an anchor's own id are no
partners of it; ties go by smaller id; an anchor without another row of its label has no positives and no result; a
positive below 0 has no negatives, as its window is empty; scores that might not fit 62 bits raise ValueError; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.common import written

#: Components of anchors that are sent to the tasks at once, as 8-byte numbers.
MAX_ANCHOR_BYTES = 32 << 20
#: Rows that a task holds at once; rows and anchors of one matrix product; pairs of a list that are multiplied at once.
UNIT_ROWS, TILE_ROWS, TILE_ANCHORS, LIST_PAIRS = 16_384, 4_096, 256, 1 << 15
#: Below this share of live pairs a tile goes on as a list.
LISTED_SHARE = 1 / 16
NEVER = -(1 << 62)


class Planes:
    """Rows as bit-planes of their components plus 2^(bits - 1), so that all planes but the constant are 0 or 1."""

    def __init__(self, values: np.ndarray, bits: int, dtype: type):
        self.bits, self.dtype = bits, dtype
        self.lifted = values + (1 << (bits - 1))
        self._made: dict[int, np.ndarray] = {}

    def __getitem__(self, k: int) -> np.ndarray:
        if k not in self._made:
            self._made[k] = ((self.lifted >> k) & 1).astype(self.dtype)
        return self._made[k]


class Anchors:
    """A chunk of anchors: ids, labels, components and what bounds need."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, bits: int):
        self.ids, self.labels, self.values, self.bits = ids, labels, values, bits
        self.sums = values.sum(1)
        self.up = np.maximum(values, 0).sum(1)
        self.down = np.minimum(values, 0).sum(1)
        largest = int(np.abs(values).sum(1).max(initial=0))
        self.dtype = np.float32 if largest < 1 << 24 else np.float64  # a plane's product is exact in either
        self.exact = np.float64 if largest << bits < 1 << 53 else np.int64


Test = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def survivors(anchors: Anchors, of: np.ndarray, planes: Planes, dense: Callable[[np.ndarray, np.ndarray], np.ndarray], listed: Test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, r, score) of the pairs that no interval has ruled out; a counts within `of`, the anchors of this tile.

    dense(lower, upper) tells live pairs of the whole tile, listed(a, r, lower, upper) of a list of pairs.
    """
    values = anchors.values[of].astype(planes.dtype)
    up, down = anchors.up[of].astype(anchors.exact), anchors.down[of].astype(anchors.exact)
    score = np.repeat((anchors.sums[of] * -(1 << (planes.bits - 1))).astype(anchors.exact)[:, None], len(planes.lifted), 1)
    a = r = s = None
    for k in range(planes.bits - 1, -1, -1):
        left = (1 << k) - 1
        if a is None:
            step = values @ planes[k].T
            score += (step if step.dtype == anchors.exact else step.astype(anchors.exact)) * (1 << k)
            if k > planes.bits - 4 and k:
                continue  # the first planes leave intervals wider than all scores
            live = dense(score + (left * down)[:, None], score + (left * up)[:, None])
            if not k or np.count_nonzero(live) < LISTED_SHARE * live.size:
                a, r = np.nonzero(live)
                s = score[a, r]
        else:
            plane = planes[k]
            for low in range(0, len(a), LIST_PAIRS):
                cut = slice(low, low + LIST_PAIRS)
                s[cut] += np.einsum("ij,ij->i", values[a[cut]], plane[r[cut]]).astype(anchors.exact) * (1 << k)
            live = listed(a, r, s + left * down[a], s + left * up[a])
            if not live.all():
                a, r, s = a[live], r[live], s[live]
        if a is not None and not len(a):
            break
    return a, r, s.astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group by score, then smaller id; one id and score counts once. Sorted by group and rank."""
    order = np.lexsort((ident, -score, group))
    g, s, i = group[order], score[order], ident[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order, g = order[new], g[new]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < k]


class Lists:
    """The k best (score, id) of each of n groups so far, as they come in."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), NEVER, np.int64), np.zeros((n, k), np.int64)

    @property
    def least(self) -> np.ndarray:
        """What a newcomer must reach; NEVER while a group isn't full."""
        return self.scores[:, -1]

    def put(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        wanted = score >= self.least[group]
        if not wanted.any():
            return
        group, score, ident = group[wanted], score[wanted], ident[wanted]
        touched = np.unique(group)
        held = self.scores[touched] != NEVER
        old = np.repeat(touched, held.sum(1))
        group = np.concatenate([old, group])
        score = np.concatenate([self.scores[touched][held], score])
        ident = np.concatenate([self.ids[touched][held], ident])
        top = best(group, score, ident, self.k)
        g = group[top]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        self.scores[touched], self.ids[touched] = NEVER, 0
        self.scores[g, rank], self.ids[g, rank] = score[top], ident[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, k = np.nonzero(self.scores != NEVER)
        return group, self.scores[group, k], self.ids[group, k]


def _tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(low, min(low + size, n)) for low in range(0, n, size))


def add_positives(anchors: Anchors, found: Lists, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
    """Puts the best rows of each anchor's own label into found."""
    unique_ids = len(np.unique(ids)) == len(ids)
    for label in np.intersect1d(labels, anchors.labels):
        mine, theirs = np.flatnonzero(anchors.labels == label), np.flatnonzero(labels == label)
        for rows in _tiles(len(theirs), TILE_ROWS):
            r_ids = ids[theirs[rows]]
            planes = Planes(values[theirs[rows]], anchors.bits, anchors.dtype)
            for tile in _tiles(len(mine), TILE_ANCHORS):
                of = mine[tile]
                least = found.least[of].astype(anchors.exact)
                other = anchors.ids[of][:, None] != r_ids[None, :]

                def dense(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                    nonlocal least
                    if unique_ids and len(r_ids) > found.k and (least == NEVER).any():
                        # the k-th best lower end is reached by k rows of this tile
                        kth = np.partition(np.where(other, lower, anchors.exact(NEVER)), -found.k, axis=1)[:, -found.k]
                        least = np.maximum(least, kth)
                    return other & (upper >= least[:, None])

                a, r, s = survivors(anchors, of, planes, dense, lambda a, r, lower, upper: upper >= least[a])
                found.put(of[a], s, r_ids[r])


def windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole n with 50 p <= 100 n <= 95 p, for each positive score p; NEVER holds no window."""
    there = scores != NEVER
    p = np.where(there, scores, 0)
    low, high = -((-p) // 2), (95 * p) // 100
    return np.where(there, low, 1), np.where(there, high, 0)


def add_negatives(anchors: Anchors, low: np.ndarray, high: np.ndarray, found: Lists, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
    """Puts the best rows of other labels into found, for each window low[a, w] <= score <= high[a, w]: group a * windows + w."""
    count = low.shape[1]
    some = (low <= high).any(1)
    for rows in _tiles(len(ids), TILE_ROWS):
        r_ids, r_labels = ids[rows], labels[rows]
        planes = Planes(values[rows], anchors.bits, anchors.dtype)
        for tile in _tiles(len(anchors.ids), TILE_ANCHORS):
            of = np.arange(tile.start, tile.stop)[some[tile]]
            if not len(of):
                continue
            # a row must reach the third best that a window holds, once it holds three
            lo, hi = np.maximum(low[of], found.least.reshape(-1, count)[of]), high[of]
            open_ = lo <= hi
            floor = np.where(open_, lo, -NEVER).min(1).astype(anchors.exact)
            ceiling = np.where(open_, hi, NEVER).max(1).astype(anchors.exact)
            other = (anchors.labels[of][:, None] != r_labels[None, :]) & (anchors.ids[of][:, None] != r_ids[None, :])

            def listed(a, r, lower, upper, lo=lo, hi=hi, open_=open_):
                live = np.zeros(len(a), bool)
                for w in range(count):
                    live |= open_[a, w] & (upper >= lo[a, w]) & (lower <= hi[a, w])
                return live

            a, r, s = survivors(anchors, of, planes, lambda lower, upper, f=floor, c=ceiling, o=other: o & (upper >= f[:, None]) & (lower <= c[:, None]), listed)
            for w in range(count):
                fits = (s >= low[of][a, w]) & (s <= high[of][a, w])
                found.put(of[a[fits]] * count + w, s[fits], r_ids[r[fits]])


def usable(rows: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part; v holds whole numbers. label: a column or an expression."""
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows, padded with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _units(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, size = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(map(np.concatenate, zip(*held)))

    for batch in batches:
        for cut in _tiles(batch.num_rows, UNIT_ROWS):
            piece = batch.slice(cut.start, cut.stop - cut.start)
            held.append((piece.column(0).to_numpy(), piece.column(1).to_numpy(), _matrix(piece.column(2), dims)))
            size += piece.num_rows
            if size >= UNIT_ROWS:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _ranked(found: DataFrame, group: list[str], k: int) -> DataFrame:
    """found with rank, the k best of each group by score, then smaller id; one id and score counts once."""
    order = W.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).dropDuplicates([*group, "rank"])


def _one_chunk(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, name: str) -> DataFrame:
    """The stored result of a chunk of anchors."""
    sc, dims = rows.sparkSession.sparkContext, anchors.values.shape[1]
    shared = sc.broadcast(anchors)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lists(len(shared.value.ids), positives)
        for unit in _units(batches, dims):
            add_positives(shared.value, found, *unit)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.rows()], names=["anchor", "score", "id"])

    # at most `positives` rows for each anchor of the chunk
    own = _ranked(rows.mapInArrow(near, "anchor long, score long, id long"), ["anchor"], positives).collect()
    scores, ids = np.full((len(anchors.ids), positives), NEVER, np.int64), np.zeros((len(anchors.ids), positives), np.int64)
    for r in own:
        scores[r["anchor"], r["rank"] - 1], ids[r["anchor"], r["rank"] - 1] = r["score"], r["id"]
    low, high = windows(scores)
    sought = sc.broadcast((low, high, scores, ids))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, scores, ids = sought.value
        found = Lists(low.size, negatives)
        for unit in _units(batches, dims):
            add_negatives(shared.value, low, high, found, *unit)
        group, score, ident = found.rows()
        columns = [shared.value.ids[group // positives], ids.ravel()[group], scores.ravel()[group], group, score, ident]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score", "slot", "score", "id"])

    found = rows.mapInArrow(hard, "anchor_id long, positive_id long, positive_score long, slot long, score long, id long")
    out = written(_ranked(found, ["slot"], negatives), name)
    shared.destroy()
    sought.destroy()
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Callable[[Column], Column],
    positives: int = 5,
    negatives: int = 3,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    max_anchor_bytes: int = MAX_ANCHOR_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first `negatives` rows of another label
    that score between 50 % and 95 % of the positive's score, for each of the first `positives` rows of the anchor's label."""
    rows = usable(embeddings, scale, vec_id, vector, label)
    size = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    asked = F.count_if(is_anchor(F.col("id")))
    dims, largest, n = rows.agg(F.max(F.size("v")), F.max(size), asked).first()
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    dims, largest = max(dims, 1), int(largest)
    if 100 * dims * max(largest, 1) ** 2 >= 1 << 62:
        raise ValueError("scores may not fit 62 bits; take a smaller scale")
    bits = max(largest, 1).bit_length() + 1
    chunks = math.ceil(8 * dims * n / max_anchor_bytes)
    queries = rows.filter(is_anchor(F.col("id")))
    parts = []
    for chunk in range(chunks):
        mine = queries.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).distinct() if chunks > 1 else queries.distinct()
        got = mine.sort("id", "label", "v").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        lists = got.column("v").combine_chunks()
        anchors = Anchors(got.column("id").to_numpy(), got.column("label").to_numpy(), _matrix(lists, dims), bits)
        parts.append(_one_chunk(rows, anchors, positives, negatives, f"negatives-{chunk}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")])
