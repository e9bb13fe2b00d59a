"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits in lower case, with any other character beyond ASCII. Terms are the words of the benchmark; words that over 3 % of the documents hold have no weight. Passages are windows of
48 words, 24 apart, and each has a TF-IDF vector over the terms. Other words count in a passage's length only.

1. Document frequencies of the terms over all documents.
2. A distributed randomised SVD of all passages and benchmark pieces: tasks add up A'(A G) for a random G, and the driver
   turns the sum, as large as terms x rank, into singular values and vectors (single pass, by the Nystroem formula).
3. Passages and benchmark pieces meet in the latent space. A passage is a candidate for an item when their cosine, with
   the passage's full length, reaches MIN_COSINE. A passage whose weight in the terms is too small for that is skipped.
   A space of RANK directions leaves out much of a large benchmark. For each item it is worked out what cosine a passage
   with half of the item's weight would have in the space; items for which that isn't well above MIN_COSINE are sought
   in an exact way too: a match leaves out few of an item's words, so it holds a known share of any set of them, and
   stretches of a document that hold that share of the item's rarest words are candidates as well (class Rarest).
4. Candidates are checked on the words around the passage: the longest common subsequence with the whole item must
   reach VERBATIM of its words; or PARAPHRASE of them, if the item's answer words (its rarest) nearly all occur too.

Defined results: null texts count as empty; an item without words matches nothing; equal items match each on their own;
repeated rows match each on their own; a row with a null id is checked like any other; very long texts are read whole, passage by passage;
of several places where a document holds an item the first one that is checked is told, and ties go by word hashes; with an empty table on either side
nothing matches; filtering keeps all columns, and names that clash with ours do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import whole
from seamline.llm.shingles import PUNCTUATION, byte_slices, join_texts, words_of

WINDOW, STRIDE = 48, 24
RANK, OVERSAMPLE = 128, 16
PIECE = 32
#: Words of more documents than this share, and than this number, have no weight.
MAX_DOCUMENT_SHARE, MIN_STOP_DOCUMENTS = 0.03, 20
MIN_COSINE = 0.15
#: An item is left to the latent search alone if half of it would have so many times MIN_COSINE.
HELD_WELL = 1.6
VERBATIM, PARAPHRASE, ANSWER_SHARE, ANSWERS = 0.7, 0.5, 0.9, 0.25
#: Below so many words an item counts as found only nearly whole.
SHORT, SHORT_SHARE = 8, 0.9
#: The benchmark is read by the driver and sent to all tasks; a larger one is checked in parts of so many items or bytes.
PART_ITEMS, PART_BYTES = 10_000, 2 << 20
#: Benchmark pieces that passages are compared with at once.
PIECES_AT_ONCE = 4096
#: Share of an item's words, beyond those that a match may leave out, by which the exact way seeks it.
SOUGHT = 0.2
#: Postings, or chunks x items, that are added up at once.
_AT_ONCE = 1 << 21
_TABLE_BITS = 22


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, starts = join_texts(texts)
    code, _, _, first = words_of(data, starts, PUNCTUATION)
    return code, first


class Terms:
    """The benchmark's words: from a word's hash to its number, or -1."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.words, self.first = _words([t for _, t in items])
        self.known = np.unique(self.words)
        self.table = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.crowded = len(self.known) > 1 << (_TABLE_BITS - 4)
        self.table[(self.known >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = np.arange(len(self.known))
        places = self.known >> np.uint64(64 - _TABLE_BITS)
        self.crowded |= len(np.unique(places)) < len(places)

    def number(self, words: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(words), -1, np.int64)
        if self.crowded:  # two terms share a place
            at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1).astype(np.int64)
        else:
            at = self.table[(words >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)].astype(np.int64)
        return np.where((at >= 0) & (self.known[at] == words), at, -1)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first word, word after) of the benchmark's pieces of about PIECE words."""
        found = []
        for k, (a, b) in enumerate(zip(self.first, self.first[1:])):
            edges = np.linspace(a, b, max(1, round((b - a) / PIECE)) + 1).astype(int)
            found += [(k, x, y) for x, y in zip(edges, edges[1:]) if y > x]
        return tuple(np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


class Rarest:
    """Postings of the rarest terms of items of about one length: chunks of a document that may hold a match.

    A verbatim match leaves out at most n - VERBATIM * n of an item's n words, so of rarest words that count more than that
    together, all but so many are there; a paraphrase holds ANSWER_SHARE of the answer words. Every window that an item is
    checked in, WINDOW + 2 x its words, lies in two chunks that follow each other.
    """

    def __init__(self, size: int, items: list[int], whole_items: list[np.ndarray], answers: list[np.ndarray], terms: Terms, frequency: np.ndarray):
        self.size, self.items = size, np.array(items, np.int64)
        self.least, self.least_answers = np.zeros(len(items)), np.zeros(len(items))
        found = []
        for at, k in enumerate(items):
            own = whole_items[k]
            n = len(own)
            distinct, times = np.unique(terms.number(own), return_counts=True)
            order = np.lexsort((distinct, frequency[distinct]))
            distinct, times = distinct[order], times[order]
            left_out = n - math.ceil((SHORT_SHARE if n < SHORT else VERBATIM) * n - 1e-9)
            sought = np.searchsorted(np.cumsum(times), left_out + (n if n < SHORT else max(2, round(SOUGHT * n)))) + 1
            times = np.where(np.arange(len(times)) < sought, times, 0)
            self.least[at] = max(1, times.sum() - left_out)
            answer = np.isin(distinct, terms.number(answers[k]))
            self.least_answers[at] = math.ceil(ANSWER_SHARE * len(answers[k]) - 1e-9) if n >= SHORT else np.inf
            found += [(t, at, c, a) for t, c, a in zip(distinct.tolist(), times.tolist(), answer.tolist()) if c or a and n >= SHORT]
        found.sort()
        term, item, times, answer = (np.array(c) for c in zip(*found))
        self.item, self.times, self.answer = item.astype(np.int32), times.astype(np.float32), answer.astype(np.float32)
        self.at = np.searchsorted(term, np.arange(len(terms.known) + 1))

    def candidates(self, number: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, word after) of two chunks that may hold the item."""
        degree = np.append(np.diff(self.at), 0)  # of terms, and of words that are none
        has = np.flatnonzero(degree[number] > 0)
        if not len(has):
            return
        chunks = -(-np.diff(first) // self.size)
        base = np.cumsum(chunks) - chunks
        doc = np.searchsorted(first, has, side="right") - 1
        inner = (has - first[doc]) // self.size
        chunk, width = base[doc] + inner, len(degree)
        code = np.unique(np.concatenate([chunk * width + number[has], chunk[inner > 0] * width - width + number[has[inner > 0]]]))
        chunk, term = code // width, code % width
        size = degree[term]
        heads = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        tails = np.append(heads[1:], len(chunk))
        work = np.add.reduceat(size, heads) + len(self.items)
        part = np.cumsum(work) // _AT_ONCE
        for low, high in zip(*_runs(part)):
            a, b = heads[low], tails[high - 1]
            n = size[a:b]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[term[a:b]], n)
            row = np.repeat(np.repeat(np.arange(high - low), tails[low:high] - heads[low:high]), n)
            key = row * len(self.items) + self.item[place]
            shape = high - low, len(self.items)
            hits, answered = (np.bincount(key, weights=w[place], minlength=shape[0] * shape[1]).reshape(shape) for w in (self.times, self.answer))
            for r, k in zip(*(x.tolist() for x in np.nonzero((hits >= self.least) | (answered >= self.least_answers)))):
                c = chunk[heads[low + r]]
                d = int(np.searchsorted(base, c, side="right")) - 1
                start = int(first[d] + (c - base[d]) * self.size)
                yield d, int(self.items[k]), start, int(min(start + 2 * self.size, first[d + 1]))


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """(first, after) of runs of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist()
    return edges[:-1], edges[1:]


def thinly_held(item: np.ndarray, first: np.ndarray, after: np.ndarray, number: np.ndarray, weight: np.ndarray, length: np.ndarray, other: float) -> set[int]:
    """Items of which a piece may be missed in the latent space.

    A piece's weights have a length in the space (length) and one of their own. A passage that holds the half of the weight,
    by the square, and otherwise words of the usual weight has about the cosine that is worked out here.
    """
    thin = set()
    for k, a, b, held in zip(item.tolist(), first, after, length):
        times, where = np.unique(number[a:b], return_counts=True)[::-1]
        own = float(((times * weight[where]) ** 2).sum())
        passage = own / 2 + max(WINDOW - (b - a) / 2, 0) * other**2
        if own <= 0 or held / math.sqrt(own) * math.sqrt(own / 2 / passage) < HELD_WELL * MIN_COSINE:
            thin.add(k)
    return thin


def by_rarest_words(whole_items: list[np.ndarray], answers: list[np.ndarray], terms: Terms, frequency: np.ndarray, wanted: set[int]) -> list[Rarest]:
    """The wanted items' postings, one table for each power of two that an item's window fits into."""
    sizes: dict[int, list[int]] = {}
    for k, own in enumerate(whole_items):
        if len(own) and k in wanted:
            sizes.setdefault(1 << (WINDOW + 2 * len(own) - 1).bit_length(), []).append(k)
    return [Rarest(size, items, whole_items, answers, terms, frequency) for size, items in sorted(sizes.items())]


@dataclass
class Passages:
    """Windows of a batch: the term occurrences in each, its squared length and where it lies."""

    term: np.ndarray  # of each occurrence in a block
    block: np.ndarray
    blocks: int
    follows: np.ndarray  # does the next block belong to the same document?
    squared: np.ndarray
    within: np.ndarray  # the part of the squared length that terms have
    start: np.ndarray
    doc: np.ndarray


def passages(words: np.ndarray, first: np.ndarray, terms: Terms, weight: np.ndarray, other: float) -> Passages:
    """A passage is a block of STRIDE words and the block after it in the same document."""
    n = np.diff(first)
    count = -(-n // STRIDE)
    doc = np.repeat(np.arange(len(n)), count)
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + inner * STRIDE
    number = terms.number(words)
    has = np.flatnonzero(number >= 0)
    has = has[weight[number[has]] > 0]
    owner = np.searchsorted(start, has, side="right") - 1
    size = np.minimum(STRIDE, first[1:][doc] - start)
    stop = np.bincount(np.searchsorted(start, np.flatnonzero((number >= 0) & (weight[number] == 0)), side="right") - 1, minlength=len(start)) if len(start) else np.zeros(0)
    own = np.bincount(owner, minlength=len(start))
    within = np.bincount(owner, weights=weight[number[has]] ** 2, minlength=len(start))
    squared = within + (size - own - stop) * other**2
    follows = np.concatenate([doc[1:] == doc[:-1], [False]]) if len(doc) else np.zeros(0, bool)
    nxt = lambda x: x + np.where(follows, np.concatenate([x[1:], [0]]), 0) if len(x) else x
    return Passages(number[has], owner, len(start), follows, nxt(squared), nxt(within), start, doc)


def _projected(p: Passages, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(blocks, rank) sums of weighted rows of the basis, both blocks of a passage together."""
    out = np.zeros((p.blocks, basis.shape[1]), np.float32)
    if len(p.block):
        heads = np.flatnonzero(np.concatenate([[True], p.block[1:] != p.block[:-1]]))
        out[p.block[heads]] = np.add.reduceat(basis[p.term] * weight[p.term].astype(np.float32)[:, None], heads, axis=0)
        out[:-1] += np.where(p.follows[:-1, None], out[1:], 0)
    return out


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each term occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        count, rows = np.zeros(len(terms.known), np.int64), 0
        for batch in batches:
            raw = batch.column(0).cast(pa.binary())
            rows += len(raw)
            for low, high in byte_slices(raw, 1 << 20):
                words, first = _words(raw.slice(low, high - low).to_pylist())
                number = terms.number(words)
                doc = np.repeat(np.arange(high - low), np.diff(first))
                pair = np.unique(doc[number >= 0] * len(count) + number[number >= 0]) if len(count) else np.zeros(0, np.int64)
                count += np.bincount(pair % max(len(count), 1), minlength=len(count))
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(count[held], rows))], names=["term", "n"])

    found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term
    count, rows = np.zeros(len(terms.known), np.int64), 0
    for term, n in found:
        if term < 0:
            rows = n
        else:
            count[term] = n
    return rows, count


def latent_basis(docs: DataFrame, terms: Terms, weight: np.ndarray, other: float, rank: int = RANK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(basis, singular values) of all passages and benchmark pieces with length 1; pieces together weigh as much as passages."""
    width = min(rank + OVERSAMPLE, len(terms.known))
    random = np.random.default_rng(seed).standard_normal((len(terms.known), width)).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((terms, weight, random))
    block = 256  # terms in one row of what tasks send: the sums are dealt by it

    def gathered(total: np.ndarray, p: Passages, weight: np.ndarray, random: np.ndarray) -> None:
        rows = _projected(p, weight, random) / np.maximum(p.squared, 1e-9)[:, None].astype(np.float32)
        # a block's terms stand in its own passage and in the one that began a block earlier
        rows[1:] += np.where(p.follows[:-1, None], rows[:-1], 0)
        order = np.argsort(p.term, kind="stable")
        term = p.term[order]
        heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        if len(heads):
            total[term[heads]] += np.add.reduceat(rows[p.block[order]] * weight[term].astype(np.float32)[:, None], heads, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, random = shared.value
        total, n = np.zeros(random.shape, np.float64), 0
        for batch in batches:
            raw = batch.column(0).cast(pa.binary())
            for low, high in byte_slices(raw, 1 << 19):
                words, first = _words(raw.slice(low, high - low).to_pylist())
                p = passages(words, first, terms, weight, other)
                n += p.blocks
                gathered(total, p, weight, random)
        for low in range(0, len(total), block):
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([n]), pa.array([total[low : low + block].astype("<f4").tobytes()], pa.binary())], names=["low", "n", "part"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts that this side has read, one row for each place."""
        seen: dict[int, list] = {}
        for batch in batches:
            for low, n, part in zip(*[c.to_pylist() for c in batch.columns]):
                one = seen.setdefault(low, [0, 0.0])
                one[0] += n
                one[1] = one[1] + np.frombuffer(part, "<f4").astype(np.float64)
        for low, (n, part) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([n]), pa.array([part.astype("<f4").tobytes()], pa.binary())], names=["low", "n", "part"])

    schema = "low long, n long, part binary"
    total, n = np.zeros(random.shape), 0
    for row in docs.mapInArrow(run, schema).repartition("low").mapInArrow(add_up, schema).collect():
        total[row.low : row.low + block] = np.frombuffer(row.part, "<f4").reshape(-1, width)
        n = row.n
    item, a, b = terms.pieces()
    own = np.zeros(random.shape)
    number = terms.number(terms.words)
    for x, y in zip(a, b):
        t = number[x:y]
        w = weight[t]
        np.add.at(own, t, np.outer(w, (w[:, None] * random[t]).sum(0)) / max((w**2).sum(), 1e-9))
    sums = total + own * max(1.0, n / max(len(a), 1))
    core = random.T @ sums
    values, turn = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((len(terms.known), 1), np.float32), np.zeros(1)
    left, singular, _ = np.linalg.svd(sums @ (turn[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank].astype(np.float32), singular[:rank]


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, with the item's places as the bits of one number."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    state = full = (1 << len(item)) - 1
    for w in words.tolist():
        match = places.get(w)
        if match:
            hit = state & match
            state = (state + hit | state - hit) & full
    return len(item) - state.bit_count()


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, common_words, item_words, cosine, first_word): a row for each row of docs and item found in it.

    A benchmark of any size: its parts are checked one after the other, each against all documents.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.lower(whole(item_text)).alias("t"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, math.ceil(n / PART_ITEMS), math.ceil(size / PART_BYTES))
    own = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    return reduce(DataFrame.unionByName, [_contaminated(docs, items.filter(own == k).collect(), doc_id, text) for k in range(parts)])


def _contaminated(docs: DataFrame, rows: list, doc_id: str, text: str) -> DataFrame:
    """The same for a part of the benchmark: rows of (i, t)."""
    terms = Terms(sorted(((r.i, r.t.encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
    schema = "doc_id long, item_id long, common_words int, item_words int, cosine double, first_word long"
    if not len(terms.known):
        return docs.sparkSession.createDataFrame([], schema)
    texts = docs.select(F.lower(whole(text)).alias("text"))
    n, frequency = document_frequencies(texts, terms)
    weight = np.where(frequency > max(MAX_DOCUMENT_SHARE * n, MIN_STOP_DOCUMENTS), 0.0, np.log((n + 1) / (frequency + 1)) + 1)
    other = float(np.median(weight[weight > 0])) if (weight > 0).any() else 1.0
    basis, _ = latent_basis(texts, terms, weight, other)
    item, first, after = terms.pieces()
    number = terms.number(terms.words)
    pieces = np.zeros((len(item), basis.shape[1]), np.float32)
    for k, (a, b) in enumerate(zip(first, after)):
        pieces[k] = (basis[number[a:b]] * weight[number[a:b]].astype(np.float32)[:, None]).sum(0)
    length = np.linalg.norm(pieces, axis=1)
    whole_items = [terms.words[a:b] for a, b in zip(terms.first, terms.first[1:])]
    answers = []
    for words in whole_items:
        distinct = np.unique(words)
        answers.append(distinct[np.lexsort((distinct, frequency[terms.number(distinct)]))][: max(1, round(ANSWERS * len(distinct)))])
    # pieces of stop words alone have no direction: their items are sought by their rarest words, however frequent
    pieces = pieces / np.maximum(length, 1e-6)[:, None]
    rarest = by_rarest_words(whole_items, answers, terms, frequency, thinly_held(item, first, after, number, weight, length, other))
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight, basis, pieces, item, whole_items, answers, rarest))

    def found_in(words: np.ndarray, k: int, state: tuple) -> int | None:
        """The common words of item k and these words, if they make a match."""
        whole_items, answers = state
        own = whole_items[k]
        near = words[np.isin(words, own)]
        if len(near) < PARAPHRASE * len(own):
            return None
        common = common_subsequence(own, near)
        share = common / len(own)
        if len(own) < SHORT:
            return common if share >= SHORT_SHARE else None
        if share >= VERBATIM or share >= PARAPHRASE and np.isin(answers[k], near).mean() >= ANSWER_SHARE:
            return common
        return None

    def cosine_of(p: Passages, at: int, own: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> float:
        """The best cosine of a passage and an item's pieces."""
        mine = (p.block == at) | (p.block == at + 1) & p.follows[at]
        vector = (basis[p.term[mine]] * weight[p.term[mine]].astype(np.float32)[:, None]).sum(0)
        return float((own @ vector).max(initial=0.0) / np.sqrt(max(p.squared[at], 1e-9)))

    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, basis, pieces, item, whole_items, answers, rarest = shared.value
        state = whole_items, answers
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            for low, high in byte_slices(raw, 1 << 19):
                words, first = _words(raw.slice(low, high - low).to_pylist())
                p = passages(words, first, terms, weight, other)
                best: dict[tuple[int, int], list] = {}
                near = np.flatnonzero(p.within >= MIN_COSINE**2 * p.squared) if len(pieces) else np.zeros(0, np.int64)
                if len(near):
                    projected = _projected(p, weight, basis)[near] / np.sqrt(np.maximum(p.squared[near], 1e-9))[:, None]
                    met = []
                    for c in range(0, len(pieces), PIECES_AT_ONCE):
                        cosine = projected @ pieces[c : c + PIECES_AT_ONCE].T
                        row, column = np.nonzero(cosine >= MIN_COSINE)
                        met += zip(row.tolist(), (column + c).tolist(), cosine[row, column].tolist())
                    for r, c, likeness in sorted(met):
                        at, k, doc = near[r], int(item[c]), int(p.doc[near[r]])
                        if (doc, k) in best:
                            best[doc, k][2] = max(best[doc, k][2], likeness)
                            continue
                        own = len(whole_items[k])
                        a = max(first[doc], p.start[at] - own)
                        b = min(first[doc + 1], p.start[at] + WINDOW + own)
                        common = found_in(words[a:b], k, state)
                        if common is not None:
                            best[doc, k] = [common, own, likeness, int(a - first[doc])]
                number = terms.number(words)
                for table in rarest:
                    for doc, k, low_word, high_word in table.candidates(number, first):
                        # what no window reaches, the chunks around them may; what they don't reach, no window does
                        if (doc, k) in best or found_in(words[low_word:high_word], k, state) is None:
                            continue
                        own, begin, end = len(whole_items[k]), int(first[doc]), int(first[doc + 1])
                        for start in range(begin + (low_word - begin) // STRIDE * STRIDE, high_word, STRIDE):
                            a, b = max(begin, start - own), min(end, start + WINDOW + own)
                            common = found_in(words[a:b], k, state)
                            if common is not None:
                                at = int(np.searchsorted(p.start, start))
                                best[doc, k] = [common, own, cosine_of(p, at, pieces[item == k], weight, basis), a - begin]
                                break
                if best:
                    ids = batch.column(0).slice(low, high - low).to_pylist()
                    rows = [[ids[doc], terms.ids[k], *found] for (doc, k), found in sorted(best.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(whole(text)).alias("text")).mapInArrow(run, schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **names: str) -> DataFrame:
    """docs without the documents in which an item was found; rows with a null id stay."""
    found = contaminated(docs, benchmark, doc_id, **names).select(F.col("doc_id").alias("__seam_id")).distinct()
    return docs.join(found, F.col(doc_id) == F.col("__seam_id"), "left_anti")
