"""Postings as they travel to their folders, and ranks from hits that are stored once."""

import random

import numpy as np
import pyarrow as pa

from seamline.operators import matching as M
from seamline.operators import positional_index as I


def test_packed_postings_are_those_of_the_texts():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["of", "the", "é", *map(str, range(300))], k=rng.randint(0, 400))) for _ in range(200)] + [""]
    rows = [1024 * 7 + 4 * k for k in range(len(texts))]
    group = pa.table({"shard": pa.array([3] * len(texts), pa.int32()), "row": pa.array(rows[::-1]), "hay": texts[::-1], "block": [7] * len(texts)})
    packed = I._packed(group)
    found = {}
    for batch in I._unpacked(iter(packed.to_batches())):
        for x in batch.to_pylist():
            r, p = I._decoded(x["first"], np.array(x["rows"]), np.array(x["places"]))
            assert x["token"] not in found and (x["shard"], x["block"]) == (3, 7) and x["n_rows"] == len(set(r))
            found[x["token"]] = list(zip(r.tolist(), p.tolist()))
    want = {}
    for r, t in zip(rows, texts):
        for place, w in enumerate(t.split()):
            want.setdefault(w, []).append((r, place))
    assert found == want and packed.num_rows <= I.BUCKETS
    assert sum(map(len, packed.column("packed").to_pylist())) < 4 * sum(map(len, want.values()))
    assert I._packed(group.slice(0, 1)).num_rows == 0


def test_places_are_intersected_once_for_ranks(spark, tmp_path):
    I.add_shards(spark.createDataFrame([(0, 1, "of the sea"), (0, 2, "the of"), (0, 3, None)], "shard int, row long, text string"), str(tmp_path))
    ranks = I.ranked(spark, str(tmp_path), M.phrases_of(spark.createDataFrame([(0, "of the", 1, 0)], "class_id int, synonym string, cnt int, ord int")))
    assert [(r.row, r["rank"]) for r in ranks.collect()] == [(1, 1)]
    assert "FlatMapGroupsInArrow" not in ranks._jdf.queryExecution().executedPlan().toString()
