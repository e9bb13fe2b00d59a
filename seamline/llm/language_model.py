"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | features) * P(place | class, word before) * P(token | place). Features are hashed: the word
before, the two before, and skips to the second and third word before. The most frequent training tokens (the head) share
classes by rank and have a place each. All other tokens are classed by their ending and share a class's places by hash;
within a place a token has its smoothed share of the place's training tokens. The hashed rows follow the square root of
the number of training tokens, up to 2^MOST_ROW_BITS, so that weights can be sent to every task.

1. Exact counts: map tasks count their words, buckets add them up; the driver reads the head and one total for each place.
2. Training covers all training texts. Tasks add up, for every weight, how often its feature and outcome were observed
   and how often the model expects them; the sums over all tasks make one gradient update. Its step for a weight is
   1 / (4 features * the logarithmic mean of both), so the change is log(observed / expected) / 4: iterative scaling.
   The first update, from zero weights, needs counts only; further ones take a part of the texts each, dealt by a hash of
   the id. Nothing depends on how the table is partitioned. Weights of a place within its class have one feature, for
   which the first update is the exact optimum.
3. Scoring: cells of documents ask buckets for the counts of their words, so counts of rare words are never broadcast.

Tokens are words as of the shingles module, and one end for each text. The base score is that of a smoothed unigram model.

Defined results: a null text counts as empty and is one end token; very long texts are scored whole; rows with a null id
are training rows (their id reads as an empty text); repeated rows get equal scores and count each time in training; with
no training text all counts are 0 and both scores are those of the smoothed model; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.cells import dealt_to_cells
from seamline.llm.common import fold_of, whole
from seamline.llm.shingles import byte_slices, join_texts, mix, words_of

HEAD_CLASSES, CLASS_SIZE, TAIL_CLASSES = 16, 64, 16
CLASSES = HEAD_CLASSES + TAIL_CLASSES
HEAD = HEAD_CLASSES * CLASS_SIZE
#: Bits of a hashed row of class weights, and what rows of place weights have fewer.
LEAST_ROW_BITS, MOST_ROW_BITS, WORD_BITS_LESS = 14, 16, 1
#: Updates after the first one, each over its part of the texts; what an observed or expected count is smoothed with.
ROUNDS, SMOOTHING, PLACE_SMOOTHING, FEATURES = 2, 32.0, 128.0, 4
#: Tokens whose probabilities are worked out at once.
BATCH = 4096
#: Text of a training task, on average: its sums of some tens of MB are sent once for all of it.
TASK_BYTES = 64 << 20
END = np.uint64(0x9D5C0FB1A37E2468)
#: Weight rows in one block of what tasks send back.
BLOCK_ROWS = 1 << 10
_FEATURES = mix(np.arange(501, 505, dtype=np.uint64))


def held_out(doc_id: object, mod: int = 5, value: int = 1) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == value


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, tail class, where each text starts, with the end): every text's words and its end token."""
    data, starts = join_texts(texts)
    code, begin, end, first = words_of(data, starts)
    ending = data[end - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(end - 2, begin)]
    kind = (mix(ending + np.uint64(9001)) % np.uint64(TAIL_CLASSES)).astype(np.uint8)
    places = first[1:]
    code, kind = np.insert(code, places, END), np.insert(kind, places, 0)
    return code, kind, first + np.arange(len(first))


def _counted(token: np.ndarray, kind: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, sorted, with their class and the sum of their weights."""
    order = np.argsort(token, kind="stable")
    token = token[order]
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return token[heads], kind[order][heads], np.add.reduceat(weight[order], heads) if len(heads) else weight[:0]


@dataclass
class Model:
    """What tasks need for training and scoring; its size is bounded by the constants above."""

    n: int
    v: int
    head: np.ndarray  # sorted tokens
    rank: np.ndarray  # of each, by count
    class_bias: np.ndarray
    word_bias: np.ndarray  # (classes, class size)
    tail_mass: np.ndarray  # (tail classes, class size)
    tail_words: np.ndarray
    weights: np.ndarray  # (rows, classes)
    word_weights: np.ndarray  # (rows, class size)

    def targets(self, token: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place in the class) of each token."""
        tail, place = HEAD_CLASSES + kind.astype(np.int64), place_of(token)
        if not len(self.head):
            return tail, place
        at = np.minimum(np.searchsorted(self.head, token), len(self.head) - 1)
        known, rank = self.head[at] == token, self.rank[at]
        return np.where(known, rank // CLASS_SIZE, tail), np.where(known, rank % CLASS_SIZE, place)


def place_of(token: np.ndarray) -> np.ndarray:
    """The place of a token that is not in the head."""
    return (mix(token ^ np.uint64(0x3C79AC492BA7B653)) % np.uint64(CLASS_SIZE)).astype(np.int64)


def features(token: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """(tokens, 4): rows, hashed to so many bits, of the word before, both before, and the skips; nothing reaches over a text's start."""
    place = np.arange(len(token)) - np.repeat(starts[:-1], np.diff(starts))
    before = []
    for k in (1, 2, 3):
        shifted = np.zeros(len(token), np.uint64)
        shifted[k:] = token[:-k] if len(token) > k else token[:0]
        shifted[place < k] = 0
        before.append(shifted)
    one, two, three = before
    raw = np.stack([one ^ _FEATURES[0], mix(one + _FEATURES[1]) ^ two, two ^ _FEATURES[2], three ^ _FEATURES[3]], axis=1)
    return (mix(raw) >> np.uint64(64 - bits)).astype(np.int64)


def word_rows(token: np.ndarray, starts: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    """The row of the word before in the token's class."""
    before = np.zeros(len(token), np.uint64)
    before[1:] = token[:-1]
    before[starts[:-1][starts[:-1] < len(token)]] = 0
    return (mix(before ^ mix(classes.astype(np.uint64) + np.uint64(70))) >> np.uint64(64 - bits)).astype(np.int64)


def _exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials, their sum in each row, what was taken from each row's logits first): a row's maximum is only sought where the sum is near a float's limits."""
    exps = np.exp(np.minimum(logits, 80))
    total, shift = exps @ np.ones(exps.shape[1], exps.dtype), np.zeros(len(exps), logits.dtype)
    odd = np.flatnonzero((total > 1e33) | (total < 1e-20))
    if len(odd):
        shift[odd] = logits[odd].max(axis=1)
        exps[odd] = np.exp(logits[odd] - shift[odd, None])
        total[odd] = exps[odd].sum(axis=1)
    return exps, total, shift


def _shares(logits: np.ndarray) -> np.ndarray:
    """Each row's softmax."""
    exps, total, _ = _exps(logits)
    exps /= total[:, None]
    return exps


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row's softmax, the logarithm at one place."""
    _, total, shift = _exps(logits)
    return logits[np.arange(len(at)), at].astype(np.float64) - shift - np.log(total)


def _summed(model: Model, rows: np.ndarray) -> np.ndarray:
    """The class logits of each token: its rows of the weights, and the bias."""
    out = np.take(model.weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += np.take(model.weights, rows[:, k], axis=0)
    out += model.class_bias
    return out


def _bits(table: np.ndarray) -> int:
    return len(table).bit_length() - 1


def _word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, tokens, kinds, counts): packed counts of training tokens, a row for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, kind, count = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        parts: list[tuple] = []

        def merge() -> None:
            nonlocal token, kind, count
            token, kind, count = _counted(*[np.concatenate(c) for c in zip((token, kind, count), *parts)])
            parts.clear()

        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for low, high in byte_slices(raw, 1 << 20):
                own = [t for i, t in zip(ids[low:high], raw.slice(low, high - low).to_pylist()) if not held_out(i)]
                if own:
                    t, k, _ = tokens_of(own)
                    parts.append(_counted(t, k, np.ones(len(t), np.int64)))
                if len(parts) == 8:
                    merge()
        merge()
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(edges)).tolist()
        token, kind, count = token[order], kind[order], count[order]
        cut = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in filled], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), cut(token), cut(kind), cut(count)], names=["bucket", "tokens", "kinds", "counts"])

    return docs.mapInArrow(run, "bucket int, tokens binary, kinds binary, counts binary")


def _unpack(group: pa.Table, name: str, kind: str) -> np.ndarray:
    found = [np.frombuffer(x, kind) for x in group.column(name).to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _counts_model(docs: DataFrame, buckets: int) -> Model:
    """Counts over all training texts; weights are still zero."""
    schema = "token long, kind int, place int, c long, v long, top boolean"

    def add_up(group: pa.Table) -> pa.Table:
        """A bucket's most frequent tokens, and its tokens and words for each ending class."""
        token, kind, count = _counted(_unpack(group, "tokens", "<u8"), _unpack(group, "kinds", "u1"), _unpack(group, "counts", "<i8"))
        top = np.lexsort((token, -count))[:HEAD]
        cell = kind.astype(np.int64) * CLASS_SIZE + place_of(token)
        filled = np.unique(cell)
        mass, words = (np.bincount(cell, weights=w, minlength=TAIL_CLASSES * CLASS_SIZE).astype(np.int64)[filled] for w in (count, np.ones(len(count))))
        return pa.table({
            "token": pa.array(np.concatenate([token[top].view(np.int64), np.zeros(len(filled), np.int64)])),
            "kind": pa.array(np.concatenate([kind[top], filled // CLASS_SIZE]).astype(np.int32)),
            "place": pa.array(np.concatenate([place_of(token[top]), filled % CLASS_SIZE]).astype(np.int32)),
            "c": pa.array(np.concatenate([count[top], mass])),
            "v": pa.array(np.concatenate([np.ones(len(top), np.int64), words])),
            "top": pa.array(np.arange(len(top) + len(filled)) < len(top)),
        })

    found = _word_counts(docs, buckets).groupBy("bucket").applyInArrow(add_up, schema).persist(StorageLevel.DISK_ONLY)
    try:
        totals = found.filter("not top").groupBy("kind", "place").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
        top = found.filter("top").orderBy(F.desc("c"), "token").limit(HEAD).collect()
    finally:
        found.unpersist()
    mass, words = np.zeros((2, TAIL_CLASSES, CLASS_SIZE), np.int64)
    for r in totals:
        mass[r.kind, r.place], words[r.kind, r.place] = r.c, r.v
    n, v = int(mass.sum()), int(words.sum())
    for r in top:
        mass[r.kind, r.place] -= r.c
        words[r.kind, r.place] -= 1
    return untrained(n, v, np.array([r.token for r in top], np.int64).view(np.uint64), np.array([r.c for r in top], np.float64), mass, words)


def untrained(n: int, v: int, tokens: np.ndarray, counts: np.ndarray, mass: np.ndarray, words: np.ndarray) -> Model:
    """The model of the head's tokens and counts, by rank, and of the totals of the other places; weights are zero."""
    head = np.zeros((HEAD_CLASSES, CLASS_SIZE))
    head.ravel()[: len(counts)] = counts
    held = np.concatenate([head, mass + 0.5 * (words + 1)])
    with np.errstate(divide="ignore"):
        class_bias, word_bias = (np.where(x > 0, np.log(x / np.maximum(x.sum(-1, keepdims=True), 1e-300)), -1e30).astype(np.float32) for x in (held.sum(1), held))
    order = np.argsort(tokens)
    bits = min(max(round(np.log2(n + 1) / 2 + 3), LEAST_ROW_BITS), MOST_ROW_BITS)
    zeros = np.zeros((1 << bits, CLASSES), np.float32), np.zeros((1 << bits - WORD_BITS_LESS, CLASS_SIZE), np.float32)
    return Model(n, v, tokens[order], np.arange(len(tokens))[order], class_bias, word_bias, mass, words, *zeros)


def sums_of(model: Model, texts: list[bytes], first: bool, sums: dict[str, np.ndarray]) -> None:
    """Adds what the texts show and, after the first update, what the model expects of them, to the sums of each weight."""
    token, kind, starts = tokens_of(texts)
    target, place = model.targets(token, kind)
    rows, width = features(token, starts, _bits(model.weights)), model.weights.shape
    seen = np.bincount((rows * CLASSES + target[:, None]).ravel(), minlength=model.weights.size)
    sums["seen"] += seen.reshape(width)
    if first:
        row = word_rows(token, starts, target, _bits(model.word_weights))
        for name, at, size in (("places", place, CLASS_SIZE), ("classes", target, CLASSES)):
            sums[name] += np.bincount(row * size + at, minlength=sums[name].size).reshape(sums[name].shape)
        return
    for a in range(0, len(token), 32 * BATCH):
        f = rows[a : a + 32 * BATCH]
        p = np.empty((CLASSES, len(f)))
        for b in range(0, len(f), BATCH):
            p[:, b : b + BATCH] = _shares(_summed(model, f[b : b + BATCH])).T
        columns = np.ascontiguousarray(f.T)
        for c, column in enumerate(p):
            sums["expected"][:, c] += reduce(np.add, [np.bincount(row, column, len(model.weights)) for row in columns])


def update(model: Model, sums: dict[str, np.ndarray], first: bool) -> None:
    """One update of all weights by the sums over the texts."""
    share = np.exp(model.class_bias.astype(np.float64) - np.logaddexp.reduce(model.class_bias.astype(np.float64)))
    expected = sums["seen"].sum(1, keepdims=True) * share if first else sums["expected"]
    model.weights += (np.log((sums["seen"] + SMOOTHING * share + 1e-9) / (expected + SMOOTHING * share + 1e-9)) / FEATURES).astype(np.float32)
    if first:  # a row belongs to one class, but for hashes that meet
        prior = _shares(model.word_bias.astype(np.float64))
        expected, n = sums["classes"] @ prior, sums["classes"].sum(1, keepdims=True)
        prior = (expected + 1e-9) / (n + CLASS_SIZE * 1e-9)
        model.word_weights += np.log((sums["places"] + PLACE_SMOOTHING * prior) / (expected + PLACE_SMOOTHING * prior)).astype(np.float32)


def _train_round(docs: DataFrame, model: Model, turn: int, tasks: int) -> None:
    """An update by the training texts whose turn it is; turn 0 is the first update, by all of them."""
    first = turn == 0
    mine = fold_of("doc_id", 5) != 1
    if not first:
        code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        mine &= F.floor(code / 5) % ROUNDS == turn - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"seen": "<u4", "places": "<u4", "classes": "<u4"} if first else {"seen": "<u4", "expected": "<f4"}
    shapes = {k: {"places": model.word_weights.shape, "classes": (len(model.word_weights), CLASSES)}.get(k, model.weights.shape) for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        sums = {k: np.zeros(shape, np.float64 if k == "expected" else np.int64) for k, shape in shapes.items()}
        some = False
        for batch in batches:
            raw = batch.column(0).cast(pa.binary())
            for low, high in byte_slices(raw, 1 << 20):
                some = True
                sums_of(start, raw.slice(low, high - low).to_pylist(), first, sums)
        for name, table in sums.items():
            for b in range(0, len(table), BLOCK_ROWS):
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b], pa.int32()), pa.array([table[b : b + BLOCK_ROWS].astype(kinds[name]).tobytes()], pa.binary())], names=["name", "block", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over all tasks, block by block."""
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, block, sums in zip(*[c.to_pylist() for c in batch.columns]):
                found[name, block] = found.get((name, block), 0.0) + np.frombuffer(sums, kinds[name]).astype(np.float64)
        for (name, block), sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["name", "block", "sums"])

    schema = "name string, block int, sums binary"
    found = docs.filter(mine).select("text").coalesce(tasks).mapInArrow(run, schema).repartition("name", "block").mapInArrow(total, schema)
    sums = {k: np.zeros(shape) for k, shape in shapes.items()}
    for row in found.collect():  # a row for each block of the weights
        block = np.frombuffer(row.sums, np.float64).reshape(-1, sums[row.name].shape[1])
        sums[row.name][row.block : row.block + len(block)] = block
    shared.destroy()
    update(model, sums, first)


def fit(docs: DataFrame, buckets: int, size: int) -> Model:
    """docs: (doc_id, text), of size bytes."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    model = _counts_model(docs, buckets)
    for turn in range(ROUNDS + 1):
        _train_round(docs, model, turn, tasks)
    return model


def _log_probabilities(model: Model, token: np.ndarray, kind: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Natural logarithms of the model's probability of each token."""
    target, place = model.targets(token, kind)
    rows, row2 = features(token, starts, _bits(model.weights)), word_rows(token, starts, target, _bits(model.word_weights))
    out = np.empty(len(token))
    for a in range(0, len(token), BATCH):
        part = slice(a, a + BATCH)
        y, j = target[part], place[part]
        inner = np.take(model.word_weights, row2[part], axis=0)
        inner += np.take(model.word_bias, y, axis=0)
        out[part] = _log_share(_summed(model, rows[part]), y) + _log_share(inner, j)
    tail = np.flatnonzero(target >= HEAD_CLASSES)
    at = target[tail] - HEAD_CLASSES, place[tail]
    out[tail] += np.log((count[tail] + 0.5) / (model.tail_mass[at] + 0.5 * (model.tail_words[at] + 1)))
    return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    dealt, cells, size = dealt_to_cells(plain)
    model = fit(plain, cells, size)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def asked(group: pa.Table) -> tuple[list[bytes], list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, texts = group.column("doc_id").to_pylist(), group.column("text").cast(pa.binary()).to_pylist()
        token, kind, starts = tokens_of(texts)
        distinct, place = np.unique(token, return_inverse=True)
        bucket = (distinct % np.uint64(cells)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return ids, token, kind, starts, distinct, place, bucket, order

    def ask(group: pa.Table) -> pa.Table:
        """For each bucket, a cell's distinct tokens and how often its training texts have them."""
        ids, token, _, starts, distinct, place, bucket, order = asked(group)
        training = np.repeat([not held_out(i) for i in ids], np.diff(starts))
        count = np.bincount(place, weights=training, minlength=len(distinct)).astype("<u4")[order]
        edges = np.searchsorted(bucket[order], np.arange(cells + 1))
        filled = np.flatnonzero(np.diff(edges)).tolist()
        cut = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in filled], pa.binary())
        return pa.table({"bucket": pa.array(filled, pa.int32()), "cell": pa.array([group.column("cell")[0].as_py()] * len(filled), pa.int32()), "tokens": cut(distinct[order]), "counts": cut(count)})

    def answer(group: pa.Table) -> pa.Table:
        """The counts over all cells, for each cell in the order of its tokens."""
        tokens = _unpack(group, "tokens", "<u8")
        _, place = np.unique(tokens, return_inverse=True)
        total = np.bincount(place, weights=_unpack(group, "counts", "<u4")).astype("<i8")[place]
        edges = np.cumsum([0, *[len(x) // 8 for x in group.column("tokens").to_pylist()]])
        return pa.table({"cell": group.column("cell"), "bucket": group.column("bucket"), "totals": pa.array([total[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out_names = [f.split()[0] for f in out.split(", ")]

    def scored(group: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        ids, token, kind, starts, distinct, place, bucket, order = asked(group)
        answers = answers.sort_by("bucket")
        count = np.zeros(len(distinct), np.int64)
        count[order] = _unpack(answers, "totals", "<i8")
        count = count[place]
        base = np.log10((count + 0.5) / (model.n + 0.5 * (model.v + 1)))
        own = _log_probabilities(model, token, kind, starts, count) / np.log(10)
        at = starts[:-1]
        columns = [
            pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(np.diff(starts)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
            pa.array(np.full(len(ids), model.n)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(own, at)),
        ]
        return pa.table(columns, names=out_names)

    questions = dealt.groupBy("cell").applyInArrow(ask, "bucket int, cell int, tokens binary, counts binary")
    answers = questions.groupBy("bucket").applyInArrow(answer, "cell int, bucket int, totals binary")
    return dealt.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(scored, out)
