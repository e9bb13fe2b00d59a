"""Packing: concatenate and cut.

Pass 1 turns every document into ids plus an end id and adds up, inside each partition, where each document starts;
the ids go to a table in the shared folder with the partition's number. The partitions' totals, one row each, become
global offsets by a prefix sum. Pass 2 cuts the one long run of ids into windows of a fixed size; a document that
crosses a boundary gives one record for each window that it touches.

A tokenizer is (file of ranks, splitting pattern) or (file of ranks, splitting pattern, added tokens as (string, id) pairs): the
strings of added tokens become their ids wherever they stand in a text, as in the tokenizers library. All windows are full but the last, so padding is less than one window for the whole table.

Defined results: a null text counts as empty and is the end id alone; repeated rows are packed each on their own; rows
with a null id are packed too; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.common import whole, written

WINDOW = 2048
END_ID = 1


class TextIds:
    """Ids of whole texts by a byte-level BPE vocabulary, given as ranks; strings of special tokens are ordinary text, unless added.

    tiktoken reads the ranks: on this vocabulary its ids are those of the tokenizers library, at about four times the speed.
    Ids are little-endian, 2 bytes each where the vocabulary allows.
    """

    def __init__(self, ranks: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens=dict(added))
        self.kind = np.dtype("<u2" if max([*known.values(), *dict(added).values()]) < 1 << 16 else "<u4")

    @classmethod
    def of_worker(cls, *tokenizer) -> TextIds:
        """One for each worker process."""
        if tokenizer not in _of_worker:
            _of_worker[tokenizer] = cls(*tokenizer)
        return _of_worker[tokenizer]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids and the end id, as bytes; copies are encoded once."""
        ids: dict[str, bytes] = {}
        for text in texts:
            if text not in ids:
                ids[text] = np.array([*self.encoder.encode(text, allowed_special="all", disallowed_special=()), END_ID], self.kind).tobytes()
        return [ids[t] for t in texts]


_of_worker: dict[tuple, TextIds] = {}


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def tokenized(docs: DataFrame, tokenizer: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, start, n, doc_id, ids) as a written table: start counts the ids before it in its partition."""
    schema = "part int, start long, n long, doc_id long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = TextIds.of_worker(*tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                ids = encoder.encode(piece.column(1).to_pylist())
                n = np.array([len(x) // encoder.kind.itemsize for x in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), piece.column(0), pa.array(ids, pa.binary())], names=["part", "start", "n", "doc_id", "ids"])

    return written(docs.select(F.col(doc_id).cast("long"), whole(text)).mapInArrow(run, schema), "ids")


def pack(docs: DataFrame, tokenizer: tuple, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row for each piece.

    ids are little-endian unsigned 32-bit integers; ids_crc32 is theirs.
    """
    kind = TextIds.of_worker(*tokenizer).kind
    stored = tokenized(docs, tokenizer, doc_id, text)
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    # a row for each partition: some thousands at most, as many as a scan has tasks
    bases = totals.select(F.col("part").alias("of"), (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    placed = stored.join(F.broadcast(bases), F.col("part") == F.col("of")).select("doc_id", "n", "ids", (F.col("base") + F.col("start")).alias("at"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                out: list[list] = [[] for _ in names]
                piece = batch.slice(low, 512)
                for doc, n, ids, at in zip(*[c.to_pylist() for c in piece.columns]):
                    wide = np.frombuffer(ids, kind).astype("<u4").tobytes()
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, window)
                        length = min(n - start, window - offset)
                        part = wide[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc, start, length, zlib.crc32(part), n, sequence, offset, part)):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, out)], names=names)

    return placed.mapInArrow(cut, schema)
