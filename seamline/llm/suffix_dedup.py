"""Suffix-array dedup: bytes covered by a string of 100 bytes that also starts earlier.

The method is threshold-bounded interval expansion on a Burrows-Wheeler transform (BWT). Suffixes of a block of text are
sorted, the BWT is derived, and intervals of suffixes with a common prefix are extended backwards breadth first: level k
finds every border between neighbours whose common prefix has exactly k bytes. The expansion stops at 100 levels; where
no border was found, neighbours share 100 bytes or more.

Equal strings must meet in one block, without all text in one place:

1. Documents are dealt to cells by their ids. Every 100-byte window names its smallest hash of 32 bytes as its anchor;
   equal windows have equal anchors. Cells send the distinct anchors of their windows, 4 bytes each, to buckets, and a
   bucket answers which ones several cells hold.
2. A run of windows with the same repeated anchor is a segment. A cell sends each distinct segment once, with its first
   place, to the bucket of its anchor; further places in the cell repeat an earlier one and need no search.
3. A bucket lays its distinct segments one after the other, in the order of their first places, and expands intervals
   over them. Of the windows of a group with 100 common bytes the first in that order stays, the others repeat it.
4. The cells get the repeated stretches of their documents, unite them and take the covered bytes out.

A very frequent text costs a bucket one segment from each cell, however many copies there are. An anchor in many different
segments (a frequent line between texts of its own) would not: cells tell a bucket how many bytes of distinct segments they
have for an anchor, and beyond HOT_BYTES in all the anchor is hot. Its windows go one by one, by 128-bit hashes of their 100
bytes, to the buckets of those; each cell sends a distinct window once, with its first place.

Defined results: a null text counts as empty; rows with null ids come after all others, by their cells and then by their
texts; rows with the same id are ordered by their texts, and each row is a document of its own; of equal rows the first
keeps what the others lose; very long texts are handled whole, their anchors in pieces; an empty table gives an empty
result; columns not named are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.cells import dealt_to_cells
from seamline.llm.common import whole
from seamline.llm.shingles import mix

LENGTH = 100
GRAM = 32
#: Bytes of segments in one BWT, whose arrays stay in the cache; one anchor has at most HOT_BYTES more.
BLOCK_BYTES = 1 << 18
HOT_BYTES = 1 << 20
#: A window of a hot anchor: its hash, its document's key, the document's number in its cell and its start.
WINDOW_ROW = np.dtype([("high", "<u8"), ("low", "<u8"), ("key", "<i8"), ("ordinal", "<i4"), ("start", "<i4")])
PLACE_BITS = 28
#: Bytes whose anchors are worked out at once: arrays that stay in the cache.
PIECE = 1 << 18
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_LAST = np.iinfo(np.int64).max


def window_anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, window after) of the runs of windows with the same anchor in the same place. starts: of documents, with the end."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, factor, step = _BYTE[data], 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        code = code[:-step] + code[step:] * np.uint64(factor)
        factor, step = factor * factor % (1 << 64), 2 * step
    code = mix(code)
    # the place in the low bits: of equal hashes the leftmost counts, and a run ends where the place changes
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, span, grams = code & ~low | np.arange(len(code), dtype=np.uint64), 1, LENGTH - GRAM + 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if grams > span:
        least = np.minimum(least[: span - grams], least[grams - span :])
    # windows from the last 99 bytes of a document would run on into the next one
    cut = np.zeros(n + 1, np.int32)
    np.add.at(cut, np.minimum(np.maximum(starts[1:] - LENGTH + 1, starts[:-1]), n), 1)
    np.add.at(cut, np.minimum(starts[1:], n), -1)
    inside = np.cumsum(cut[:-1]) == 0
    border = np.ones(n + 1, bool)
    border[1:-1] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    border[starts[(starts > 0) & (starts < n)]] = True
    edges = np.flatnonzero(border)
    first, after = edges[:-1], edges[1:]
    real = inside[first]
    return code[(least[first[real]] & low).astype(np.int64)], first[real], after[real]


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffixes by their first 160 symbols (0 to 255; nothing follows the end), equal ones by place. Up to 2^21 symbols in packed numbers."""
    n = len(symbols)
    bits = max(1, (n + 1).bit_length())
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(5, np.uint64)])
    key = padded[:n]
    for k in range(1, 5):
        key = key << np.uint64(8) | padded[k : k + n]
    place = np.arange(n, dtype=np.uint64)
    packed = 40 + bits <= 64 and 3 * bits <= 64
    rank, reach = np.zeros(n + 1, np.uint64), 5
    while True:
        if packed:
            order = np.sort(key << np.uint64(bits) | place)
            suffixes = (order & np.uint64((1 << bits) - 1)).astype(np.int64)
            value = order >> np.uint64(bits)
        else:
            suffixes = np.argsort(key, kind="stable")
            value = key[suffixes]
        fresh = np.concatenate([[False], value[1:] != value[:-1]])
        if reach >= LENGTH or fresh[1:].all():
            return suffixes
        rank[suffixes] = np.cumsum(fresh).astype(np.uint64) + np.uint64(1)
        ahead = np.zeros(n, np.uint64)
        if reach < n:
            ahead[: n - reach] = rank[reach:n]
        key = rank[:n] << np.uint64(bits) | ahead
        reach *= 2


def long_borders(symbols: np.ndarray, suffixes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix in order: does it differ from the one before within `length` symbols?

    Backward extension, breadth first: an interval that level k began is extended by every symbol that stands before its
    suffixes; the extended interval begins at the place of the symbol's first occurrence there, and if no shorter prefix
    has put a border at that place, level k + 1 does.
    """
    n = len(symbols)
    bwt = symbols[suffixes - 1]  # before the first symbol stands the last one
    by_symbol = np.argsort(bwt, kind="stable")
    extended = np.empty(n, np.int64)  # the place that a suffix takes with the symbol before it
    extended[by_symbol] = np.arange(n)
    previous = np.full(n, -1, np.int64)  # the last place before with the same symbol
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    border = np.zeros(n + 1, bool)
    first = np.flatnonzero(previous < 0)
    border[extended[first]] = border[0] = border[n] = True
    begun = np.sort(extended[first])
    for _ in range(1, length):
        if not len(begun):
            break
        borders = np.flatnonzero(border)
        size = borders[np.searchsorted(borders, begun) + 1] - begun
        ends = np.cumsum(size)
        rows = np.arange(ends[-1]) + np.repeat(begun - (ends - size), size)
        firsts = rows[previous[rows] < np.repeat(begun, size)]
        places = extended[firsts]
        begun = np.sort(places[~border[places]])
        border[begun] = True
    return border[:n]


def repeated_windows(segments: list[bytes]) -> list[tuple[int, int, int]]:
    """(segment, first, after): runs of windows that also start earlier, in an earlier segment or earlier in this one."""
    used = np.frombuffer(b"".join(segments), np.uint8)
    table = np.zeros(256, np.uint8)
    present = np.unique(used)
    if len(present) > 255:
        raise ValueError("bytes of UTF-8 text take fewer than 256 values")
    table[present] = np.arange(1, len(present) + 1)
    sizes = np.array([len(s) for s in segments], np.int64)
    at = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int((sizes + 1).sum()), np.uint8)  # a 0 after each segment
    owner = np.repeat(np.arange(len(segments)), sizes)
    symbols[np.arange(len(used)) + owner] = table[used]
    suffixes = sorted_suffixes(symbols)
    border = long_borders(symbols, suffixes)
    heads = np.flatnonzero(border)
    room = np.repeat(at + sizes, sizes + 1) - np.arange(len(symbols))
    least = np.minimum.reduceat(suffixes, heads)
    again = suffixes != np.repeat(least, np.diff(np.append(heads, len(suffixes))))
    again &= room[suffixes] >= LENGTH
    marked = np.zeros(len(symbols) + 1, bool)
    marked[suffixes[again]] = True
    edge = np.diff(np.concatenate([[False], marked]).view(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    which = np.searchsorted(at, begin, side="right") - 1
    return list(zip(which.tolist(), (begin - at[which]).tolist(), (end - at[which]).tolist()))


class _Cell:
    """A cell's documents in a fixed order, their bytes with one byte between them, and their anchors."""

    def __init__(self, group: pa.Table, doc_id: str, text: str):
        ids, texts = group.column(doc_id).to_pylist(), group.column(text).cast(pa.binary()).to_pylist()
        rows = sorted(((i is None, i or 0, t) for i, t in zip(ids, texts)))
        self.ids = [None if gone else i for gone, i, _ in rows]
        self.keys = np.array([_LAST if gone else i for gone, i, _ in rows], np.int64)
        self.raw = b"\xff".join([*[t for *_, t in rows], b""])
        sizes = np.array([len(t) for *_, t in rows], np.int64)
        self.sizes, self.at = sizes, np.cumsum(sizes + 1) - (sizes + 1)
        self.data = np.frombuffer(self.raw, np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, edges = [], np.append(self.at, len(self.data))
        for low in range(0, max(len(self.data), 1), PIECE):  # pieces share 99 bytes, so each window is in one of them
            high = min(low + PIECE + LENGTH - 1, len(self.data))
            inside = edges[(edges > low) & (edges < high)]
            found.append((low, *window_anchors(self.data[low:high], np.concatenate([[0], inside - low, [high - low]]))))
        anchor, first, after = (np.concatenate(x) for x in zip(*[(a, low + f, low + t) for low, a, f, t in found]))
        own = np.searchsorted(self.at, first, side="right") - 1  # windows that reach the byte between documents go
        after = np.minimum(after, self.at[own] + self.sizes[own] - LENGTH + 1)
        real = after > first
        return anchor[real], first[real], after[real]

    def code_sizes(self, code: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes and the bytes of the distinct segments of each; of two segments both count."""
        values, place, count = np.unique(code, return_inverse=True, return_counts=True)
        size = after - first + LENGTH - 1
        many = np.flatnonzero(count[place] > 2)
        seen: set[tuple[int, bytes]] = set()
        for k, p, a, b in zip(many.tolist(), place[many].tolist(), first[many].tolist(), (after[many] + LENGTH - 1).tolist()):
            piece = p, self.raw[a:b]
            if piece in seen:
                size[k] = 0
            else:
                seen.add(piece)
        return values, np.bincount(place, weights=size, minlength=len(values)).astype(np.int64)


def _window_rows(cell: _Cell, first: np.ndarray, after: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """WINDOW_ROWs of the first places of the distinct windows of these runs; (document, start, windows) of the further places."""
    seen: set[bytes] = set()
    rows, places, further = [], [], []
    for a, b, doc in zip(first.tolist(), after.tolist(), own.tolist()):
        at = int(cell.at[doc])
        for w in range(a, b):
            digest = hashlib.blake2b(cell.raw[w : w + LENGTH], digest_size=16).digest()
            if digest not in seen:
                seen.add(digest)
                rows.append(digest)
                places.append((doc, w - at))
            elif further and further[-1][0] == doc and further[-1][1] + further[-1][2] == w - at:
                further[-1] = (doc, further[-1][1], further[-1][2] + 1)
            else:
                further.append((doc, w - at, 1))
    out = np.zeros(len(rows), WINDOW_ROW)
    if rows:
        halves = np.frombuffer(b"".join(rows), "<u8").reshape(-1, 2)
        out["high"], out["low"] = halves.T
        out["ordinal"], out["start"] = np.array(places).T
        out["key"] = cell.keys[out["ordinal"]]
    return out, further


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor % np.uint64(buckets)).astype(np.int64)


def _high(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(32)).astype("<u4")


#: The most bytes of a segment: windows that share a place of 32 bytes.
_MOST = 2 * LENGTH - GRAM


def placed_segments(dealt: DataFrame, cells: int, hot_bytes: int) -> DataFrame:
    """The segments that each bucket expands, and windows of hot anchors that it compares."""

    def _code(anchor: np.ndarray) -> np.ndarray:
        return _bucket(anchor, cells).astype(np.uint64) << np.uint64(32) | _high(anchor).astype(np.uint64)

    def anchors(group: pa.Table) -> pa.Table:
        """What a cell has: for each bucket the distinct anchors, by their high halves."""
        cell = group.column("cell")[0].as_py() if group.num_rows else 0
        texts = _Cell(group, "doc_id", "text")
        anchor, first, after = texts.runs()
        code, size = texts.code_sizes(_code(anchor), first, after)
        edges = np.searchsorted(code, np.arange(cells + 1, dtype=np.uint64) << np.uint64(32))
        high = (code & np.uint64(0xFFFFFFFF)).astype("<u4")
        heavy = size > _MOST
        filled = np.flatnonzero(np.diff(edges)).tolist()
        return pa.table({
            "bucket": pa.array(filled, pa.int32()),
            "cell": pa.array([cell] * len(filled), pa.int32()),
            "held": pa.array([high[edges[b] : edges[b + 1]].tobytes() for b in filled], pa.binary()),
            "heavy": pa.array([np.stack([high, np.minimum(size, 1 << 31).astype("<u4")], 1)[edges[b] : edges[b + 1]][heavy[edges[b] : edges[b + 1]]].tobytes() for b in filled], pa.binary()),
        })

    def shared(group: pa.Table) -> pa.Table:
        """What a bucket answers each cell: those of its anchors that another cell has too, and the hot ones."""
        held = [np.frombuffer(x, "<u4") for x in group.column("held").to_pylist()]
        ordered = np.sort(np.concatenate(held))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        answers = [h[np.isin(h, twice, assume_unique=True)].tobytes() for h in held]
        values, count = np.unique(ordered, return_counts=True)
        total = count * _MOST
        heavy = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("heavy").to_pylist()]).reshape(-1, 2)
        np.add.at(total, np.searchsorted(values, heavy[:, 0]), heavy[:, 1].astype(np.int64) - _MOST)
        many = values[total > hot_bytes]
        hot = [h[np.isin(h, many, assume_unique=True)].tobytes() for h in held]
        return pa.table({"cell": group.column("cell"), "bucket": group.column("bucket"), "shared": pa.array(answers, pa.binary()), "hot": pa.array(hot, pa.binary())}).filter(pa.array([len(a) + len(b) > 0 for a, b in zip(answers, hot)]))

    held = dealt.groupBy("cell").applyInArrow(anchors, "bucket int, cell int, held binary, heavy binary")
    answers = held.groupBy("bucket").applyInArrow(shared, "cell int, bucket int, shared binary, hot binary")

    place = "target int, anchor long, cell int, ordinal int, key long, start int, windows int, segment binary"
    place_schema = pa.schema([("target", pa.int32()), ("anchor", pa.int64()), ("cell", pa.int32()), ("ordinal", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("segment", pa.binary())])

    def segments(group: pa.Table, answer: pa.Table) -> pa.Table:
        """A cell's distinct segments with repeated anchors, each at its first place; and, without a segment, its further places.

        Windows of hot anchors: rows with ordinal -1 that hold a bucket's WINDOW_ROWs.
        """
        if not group.num_rows:
            return place_schema.empty_table()
        number = group.column("cell")[0].as_py()
        cell = _Cell(group, "doc_id", "text")
        anchor, first, after = cell.runs()
        code = _code(anchor)
        known, hot = ([np.uint64(b) << np.uint64(32) | np.frombuffer(s, "<u4").astype(np.uint64) for b, s in zip(answer.column("bucket").to_pylist(), answer.column(c).to_pylist())] for c in ("shared", "hot"))
        values, place, count = np.unique(code, return_inverse=True, return_counts=True)
        wanted = count > 1
        if known:
            wanted |= np.isin(values, np.concatenate(known))
        heated = np.isin(values, np.concatenate(hot)) if hot else np.zeros(len(values), bool)
        chosen, alone = np.flatnonzero((wanted & ~heated)[place]), np.flatnonzero(heated[place])
        own = np.searchsorted(cell.at, first[chosen], side="right") - 1
        seen: set[bytes] = set()
        pieces, fresh = [], []
        raw = cell.raw
        for a, b in zip(first[chosen].tolist(), (after[chosen] + LENGTH - 1).tolist()):
            piece = raw[a:b]
            new = piece not in seen
            if new:
                seen.add(piece)
            fresh.append(new)
            pieces.append(piece if new else None)
        windows, further = _window_rows(cell, first[alone], after[alone], np.searchsorted(cell.at, first[alone], side="right") - 1)
        target = (windows["high"] % np.uint64(cells)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        targets, at = np.unique(target[order], return_index=True)
        packed = [(t, 0, number, -1, 0, 0, len(w), w.tobytes()) for t, w in zip(targets.tolist(), np.split(windows[order], at[1:]))]
        packed += [(number, 0, number, doc, int(cell.keys[doc]), start, n, None) for doc, start, n in further]
        extra = pa.table([pa.array(c, f.type) for c, f in zip(zip(*packed), place_schema)], schema=place_schema) if packed else place_schema.empty_table()
        plain = pa.table(
            [
                pa.array(np.where(fresh, _bucket(anchor[chosen], cells), number), pa.int32()),
                pa.array(anchor[chosen].view(np.int64)),
                pa.array(np.full(len(chosen), number), pa.int32()),
                pa.array(own, pa.int32()),
                pa.array(cell.keys[own]),
                pa.array(first[chosen] - cell.at[own], pa.int32()),
                pa.array(after[chosen] - first[chosen], pa.int32()),
                pa.array(pieces, pa.binary()),
            ],
            schema=place_schema,
        )
        return pa.concat_tables([plain, extra])

    return dealt.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(segments, place)


def repeats_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row for each row of docs."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    dealt, cells, _ = dealt_to_cells(plain)
    placed = placed_segments(dealt, cells, HOT_BYTES)
    stretch = "cell int, ordinal int, start int, windows int"

    def expanded(group: pa.Table) -> pa.Table:
        """The stretches of windows that repeat an earlier one, from a bucket's segments; places without a segment go on."""
        packed = [(c, np.frombuffer(x, WINDOW_ROW)) for c, o, x in zip(*(group.column(n).to_pylist() for n in ("cell", "ordinal", "segment"))) if o < 0]
        group = group.filter(pc.greater_equal(group.column("ordinal"), 0)).sort_by([(c, "ascending") for c in ("anchor", "key", "cell", "ordinal", "start")])
        cell, ordinal, start, windows = (group.column(c).to_numpy() for c in ("cell", "ordinal", "start", "windows"))
        key, anchor, texts = group.column("key").to_numpy(), group.column("anchor").to_numpy(), group.column("segment").to_pylist()
        again = np.array([t is None for t in texts], bool)
        firsts: dict[bytes, int] = {}
        for k, t in enumerate(texts):
            if t is not None and firsts.setdefault(t, k) != k:
                again[k] = True  # another cell's copy of a segment whose first place is earlier
        kept = np.flatnonzero(~again)
        found = [(cell[again], ordinal[again], start[again], windows[again])]
        if packed:
            own, rows = np.repeat([c for c, _ in packed], [len(w) for _, w in packed]), np.concatenate([w for _, w in packed])
            order = np.lexsort((rows["start"], rows["ordinal"], own, rows["key"], rows["low"], rows["high"]))
            own, rows = own[order], rows[order]
            later = np.flatnonzero((rows["high"][1:] == rows["high"][:-1]) & (rows["low"][1:] == rows["low"][:-1])) + 1
            found.append((own[later], rows["ordinal"][later], rows["start"][later], np.ones(len(later), np.int32)))
        sizes = np.array([len(texts[k]) + 1 for k in kept], np.int64)
        low = 0
        while low < len(kept):
            high, total = low, 0
            while high < len(kept) and (total + sizes[high] <= BLOCK_BYTES - 2 or high == low or anchor[kept[high]] == anchor[kept[high - 1]]):
                total += sizes[high]
                high += 1
            if high < len(kept) and high > low:  # an anchor's segments stay together
                back = high
                while back > low and anchor[kept[back - 1]] == anchor[kept[high]]:
                    back -= 1
                high = back if back > low else high
            part = kept[low:high]
            part = part[np.lexsort((start[part], ordinal[part], cell[part], key[part]))]
            runs = repeated_windows([texts[k] for k in part])
            if runs:
                which, begin, end = (np.array(x) for x in zip(*runs))
                rows = part[which]
                found.append((cell[rows], ordinal[rows], start[rows] + begin, end - begin))
            low = high
        columns = [np.concatenate(x) for x in zip(*found)]
        return pa.table([pa.array(c, pa.int32()) for c in columns], names=["cell", "ordinal", "start", "windows"])

    stretches = placed.groupBy("target").applyInArrow(expanded, stretch)

    def removed(group: pa.Table, repeats: pa.Table) -> pa.Table:
        cell = _Cell(group, "doc_id", "text") if group.num_rows else None
        if cell is None:
            return pa.table([pa.array([], t) for t in out_types], names=out_names)
        change = np.zeros(len(cell.data) + 1, np.int32)
        begin = cell.at[repeats.column("ordinal").to_numpy()] + repeats.column("start").to_numpy()
        np.add.at(change, begin, 1)
        np.add.at(change, begin + repeats.column("windows").to_numpy() + LENGTH - 1, -1)
        covered = np.cumsum(change[:-1]) > 0
        rises = covered & ~np.concatenate([[False], covered[:-1]])
        counts = [np.concatenate([[0], np.cumsum(x)]) for x in (covered, rises)]
        gone, spans = (c[cell.at + cell.sizes] - c[cell.at] for c in counts)
        rows = []
        for k, (a, n) in enumerate(zip(cell.at.tolist(), cell.sizes.tolist())):
            kept = cell.data[a : a + n][~covered[a : a + n]].tobytes() if gone[k] else cell.raw[a : a + n]
            rows.append([cell.ids[k], n, int(gone[k]), int(spans[k]), hashlib.sha256(kept).hexdigest(), *[kept] * keep_bytes])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), out_types)], names=out_names)

    out_schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    out_names = [f.split()[0] for f in out_schema.split(", ")]
    out_types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_bytes
    return dealt.groupBy("cell").cogroup(stretches.groupBy("cell")).applyInArrow(removed, out_schema)
