"""Samplers: per class, rank candidates by a score and take the first K that pass.

One function covers them all. They differ in the first score, its order, a second score with a threshold, and what is
excluded. Ties go by id, so results don't depend on how rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.vectors import class_means, dot, normalised

#: Thresholds of the second scores.
IMAGE_TEXT, IMAGE_IMAGE, NEAR_DUPLICATE = 0.25, 0.65, 0.9
#: Rows of one side in a near-duplicate block; pivots of a class, and bytes of all pivots, at most.
BLOCK_ROWS, MAX_PIVOTS, MAX_PIVOT_BYTES = 512, 256, 16 << 20
#: Copies of rows in one batch on their way to blocks, at most, however many blocks a class has.
OUT_ROWS = 8192
#: Rows that are drawn for each pivot, of which the pivots are those that lie furthest apart.
DRAWN = 4


def exemplars(features: DataFrame, n: int = 16, seed: int = 0, ident: str = "vec_id", vector: str = "embedding", keep: bool = False) -> DataFrame:
    """(label, ex): n rows of each class, by a hash of their id. keep: with place, from 1."""
    order = W.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string"))), ident)
    return features.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).select("label", F.col(vector).alias("ex"), *([F.col("_rn").alias("place")] if keep else []))


def prompt_score(features: DataFrame, prompts: DataFrame, vector: str, name: str) -> DataFrame:
    """features with the similarity to their class's prompt vector. prompts: (label, vec), a row for each class."""
    return features.join(prompts, "label").withColumn(name, F.round(dot(F.col(vector), F.col("vec")), 6)).drop("vec")


def exemplar_score(features: DataFrame, shown: DataFrame, vector: str, name: str, reduce: str = "avg") -> DataFrame:
    """features with the mean, max or min of the similarities to their class's exemplars, a bounded array for each class."""
    gathered = shown.groupBy("label").agg(F.collect_list("ex").alias("exs"))
    sims = F.transform("exs", lambda e: F.round(dot(F.col(vector), e), 9))
    value = {
        "avg": F.aggregate(F.array_sort(sims), F.lit(0.0), lambda s, x: s + x) / F.size("exs"),
        "max": F.array_max(sims),
        "min": F.array_min(sims),
    }[reduce]
    return features.join(gathered, "label").withColumn(name, F.round(value, 6)).drop("exs")


def sample(scored: DataFrame, k: int, order: list[Column], accept: Column | None = None, exclude: DataFrame | None = None, ident: str = "vec_id") -> DataFrame:
    """The first k acceptable rows of each class, with rank. exclude: (label, id) pairs that never count.

    Only the k first rows of a class leave a task, so a large class isn't gathered.
    """
    rows = scored if exclude is None else scored.join(exclude.select("label", ident).distinct(), ["label", ident], "left_anti")
    rows = rows if accept is None else rows.filter(accept)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(*order, ident))).filter(F.col("rank") <= k)


def audited(scored: DataFrame, k: int, score: str, accept: Column, ident: str = "vec_id") -> DataFrame:
    """Rows that a scan down the scores looks at until it has k: status sampled or filtered.

    The k-th accepted row of each class, found by the capped sampler, says where the scan ends.
    """
    rows = scored.withColumn("status", F.when(F.coalesce(accept, F.lit(False)), "sampled").otherwise("filtered"))
    last = sample(rows, k, [F.desc(score)], F.col("status") == "sampled", ident=ident).filter(F.col("rank") == k)
    last = last.select("label", F.col(score).alias("_s"), F.col(ident).alias("_i"))
    seen = F.col("_i").isNull() | (F.col(score) > F.col("_s")) | ((F.col(score) == F.col("_s")) & (F.col(ident) <= F.col("_i")))
    return rows.join(last, "label", "left").filter(seen).drop("_s", "_i")


class _Cells:
    """What the tasks know of each class: pivots, and for each pivot's cell its radius, longest vector and number of blocks."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots
        self.radius, self.longest, self.blocks = ({k: np.zeros(len(v), t) for k, v in pivots.items()} for t in (float, float, np.int64))

    def placed(self, label: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the class's pivots, and the nearest one of each row.

        Worked out pivot by pivot, so that a row's distances don't hang on the rows that it is read with.
        """
        far = np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in self.pivots[label]], 1))
        return far, far.argmin(1)

    def reachable(self, label: int, far: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """The largest dot product that each row can have with any row of each cell: 2 a.b = |a|^2 + |b|^2 - |a - b|^2."""
        gap = np.maximum(far - self.radius[label][None, :], 0)
        return (squares[:, None] + self.longest[label][None, :] ** 2 - gap * gap) / 2


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = batch.column(2)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat.reshape(batch.num_rows, -1)


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the furthest from those before it; fewer if there are no more different ones."""
    picked = [0]
    far = ((rows - rows[0]) ** 2).sum(1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[picked[-1]]) ** 2).sum(1))
    return rows[picked]


def _copies(batch: pa.RecordBatch, row: np.ndarray, own: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch's rows at row, each with its own block and another one, in batches of OUT_ROWS at most."""
    for start in range(0, len(row), OUT_ROWS):
        r, a, b = (x[start : start + OUT_ROWS] for x in (row, own, other))
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(r)).columns, *[pa.array(x.astype(np.int32)) for x in (a, np.minimum(a, b), np.maximum(a, b))]], names=["label", "id", "v", "block", "low", "high"])


def _to_cells_in_reach(rows: DataFrame, sizes: dict[int, tuple[int, int]], threshold: float) -> DataFrame:
    """rows (label, id, v) with block, low and high: a copy for each pair of blocks that may hold a match of the row."""
    room = max(1, MAX_PIVOT_BYTES // (8 * DRAWN * max(d for _, d in sizes.values()) * len(sizes)))
    wanted = {k: max(1, min(-(-n // BLOCK_ROWS), MAX_PIVOTS, room)) for k, (n, _) in sizes.items()}
    spark = rows.sparkSession
    limits = F.broadcast(spark.createDataFrame([(k, DRAWN * n) for k, n in wanted.items()], "label int, most int"))
    drawn = exemplars(rows.select("label", "id", "v"), DRAWN * max(wanted.values()), ident="id", vector="v", keep=True).join(limits, "label").filter("place <= most")
    pivots: dict[int, list] = {}
    for r in drawn.orderBy("label", "place").collect():
        pivots.setdefault(r["label"], []).append(r["ex"])
    cells = _Cells({k: _spread(np.array(v, np.float64), wanted[k]) for k, v in pivots.items()})
    shared = spark.sparkContext.broadcast(cells)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            labels, _, v = _vectors(batch)
            for label in np.unique(labels):
                mine = v[labels == label]
                far, cell = shared.value.placed(int(label), mine)
                length, near = np.sqrt((mine * mine).sum(1)), far[np.arange(len(mine)), cell]
                for c in np.unique(cell):
                    at, one = cell == c, found.setdefault((int(label), int(c)), [0.0, 0.0, 0])
                    found[int(label), int(c)] = [max(one[0], float(near[at].max())), max(one[1], float(length[at].max())), one[2] + int(at.sum())]
        columns = list(zip(*[(*k, *x) for k, x in found.items()])) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()))], names=["label", "cell", "radius", "longest", "n"])

    per_cell = rows.mapInArrow(stats, "label int, cell int, radius double, longest double, n long").groupBy("label", "cell").agg(F.max("radius").alias("radius"), F.max("longest").alias("longest"), F.sum("n").alias("n"))
    for r in per_cell.collect():  # as many rows as pivots at most
        k, c = r["label"], r["cell"]
        cells.radius[k][c], cells.longest[k][c], cells.blocks[k][c] = r["radius"], r["longest"], -(-r["n"] // BLOCK_ROWS)
    known = spark.sparkContext.broadcast(cells)
    least = threshold - 1e-6  # bounds are worked out in floating point

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                labels, ids, v = _vectors(batch)
                for label in np.unique(labels):
                    at = np.flatnonzero(labels == label)
                    far, cell = known.value.placed(int(label), v[at])
                    reach = known.value.reachable(int(label), far, (v[at] ** 2).sum(1)) > least
                    blocks = known.value.blocks[int(label)]
                    first = np.cumsum(blocks) - blocks  # blocks are numbered over the class
                    own = first[cell] + (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[cell]
                    r, c = np.nonzero(reach & (blocks > 0)[None, :])
                    n = blocks[c]
                    r = np.repeat(r, n)
                    other = np.repeat(first[c], n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                    yield from _copies(batch, at[r], own[r], other)

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(sent, f"label int, id long, v {kind}, block int, low int, high int")


def near_duplicates(features: DataFrame, threshold: float = NEAR_DUPLICATE, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(label, id) of rows that come after a row of their class more similar than the threshold, removed or not.

    Rows of a class lie in cells around pivots, which are some of its rows. A row goes only to cells that can hold a match:
    it is no closer to any row of a cell than its distance to the pivot less the cell's radius. A large cell is cut into
    blocks, and two blocks at a time meet in one matrix product, so a class of any size is spread over many tasks and only
    ids leave them. Where vectors lie evenly in all directions every cell is in reach, and each row goes to all of them.
    """
    # all of one length, so that a batch is a matrix; rows without a vector have no duplicates
    rows = features.filter(F.col(vector).isNotNull() & F.col("label").isNotNull()).select("label", F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"))
    sizes = {r["label"]: (r["n"], r["d"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).collect()}  # a row for each class
    if not sizes:
        return rows.select("label", F.col("id").alias(ident)).limit(0)
    one_block = all(n <= BLOCK_ROWS for n, _ in sizes.values())  # then there is nothing to leave out
    spread = rows.withColumns({c: F.lit(0) for c in ("block", "low", "high")}) if one_block else _to_cells_in_reach(rows, sizes, threshold)

    def later(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], group.column("block").to_numpy()[order]
        v = np.array(group.column("v").to_pylist(), np.float64)[order]
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        near = np.round(v @ v.T, 9) > threshold
        near &= ids[:, None] < ids[None, :]
        if low != high:
            near &= block[:, None] != block[None, :]
        hit = ids[near.any(0)]
        return pa.table({"label": pa.array(np.full(len(hit), group.column("label")[0].as_py()), pa.int32()), "id": pa.array(hit, pa.int64())})

    found = spread.groupBy("label", "low", "high").applyInArrow(later, "label int, id long")
    return found.distinct().withColumnRenamed("id", ident)


def few_shot(rows: DataFrame, k: int, seed: int, label: str = "label", ident: str = "vec_id") -> DataFrame:
    """k rows of each class without replacement, by a hash of id and seed; smaller classes are kept whole."""
    order = W.partitionBy(label).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string"))), ident)
    return rows.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= k)


def mean_exemplar_score(features: DataFrame, shown: DataFrame, vector: str, name: str) -> DataFrame:
    """Similarity to the mean of the class's exemplars, brought to length 1."""
    means = class_means(shown, vector="ex", unit=False).withColumn("vec", normalised(F.col("vec")))
    return prompt_score(features, means, vector, name)
