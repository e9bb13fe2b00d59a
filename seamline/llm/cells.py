"""Cells: documents dealt by their ids into groups of bounded text, which a task handles as a whole.

Defined results: rows with the same id share a cell; rows with a null id are dealt by their texts; a null text counts as
empty; a text longer than a cell's share makes one long cell; an empty table has one cell; other columns stay, but a
column `cell` is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a cell, on average: at least 200 cells where they hold half a MB each, and never over 16 MB.
CELL_BYTES, SMALL_CELL_BYTES, MANY_CELLS = 16 << 20, 1 << 19, 200


def dealt_to_cells(plain: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """plain with a cell for each row, the number of cells and the bytes of text."""
    total = plain.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    cells = max(1, math.ceil(total / CELL_BYTES), min(MANY_CELLS, math.ceil(total / SMALL_CELL_BYTES)))
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    return plain.withColumn("cell", F.pmod(key, F.lit(cells)).cast("int")), cells, total
