"""Copies of rows on their way to near-duplicate blocks."""

import numpy as np
import pyarrow as pa

from seamline.operators import sampling as S


def test_copies_leave_in_bounded_batches():
    n, blocks = 2048, 100
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array(range(n)), pa.array([[float(k), 1.0] for k in range(n)])], names=["label", "id", "v"])
    row, other = np.repeat(np.arange(n), blocks), np.tile(np.arange(blocks), n)
    out = list(S._copies(batch, row, row % blocks, other))
    assert max(x.num_rows for x in out) <= S.OUT_ROWS and sum(x.num_rows for x in out) == n * blocks
    whole = pa.Table.from_batches(out)
    assert whole.column("id").to_pylist() == row.tolist()
    assert whole.column("low").to_pylist() == np.minimum(row % blocks, other).tolist() and whole.column("high").to_pylist() == np.maximum(row % blocks, other).tolist()
