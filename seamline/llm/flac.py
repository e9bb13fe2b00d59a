"""Media columns: FLAC streams in a binary column, decoded to PCM blocks with seekable sample offsets.

Streams are mono with a fixed block size. The encoder picks for each frame a constant, a verbatim or a fixed linear
predictor subframe with partitioned Rice residuals. The decoder finds frames by their sync code, header checksum and
running number (where samples look like such a header, by the frames' checksums), verifies both checksums, and decodes Rice residuals (4 and 5 bit parameters, escapes) with
fixed and quantised linear predictors. All frames of a batch are decoded side by side: numpy steps over the samples of
a block, not over frames, and a task holds a bounded number of frames.

Defined results: a null text or payload counts as empty; payloads are padded with 255 to a positive multiple of the block
size; very long texts make streams of many frames, decoded FRAMES_AT_ONCE at a time; a stream that can't be read, or with a wrong checksum, gives ok = false and no PCM; repeated rows give equal
values; an empty table gives an empty result; columns not named are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import whole

BLOCK = 576
RATE = 8000
#: Frames that are encoded or decoded at once.
FRAMES_AT_ONCE = 4096
#: A seek point for every so many frames.
SEEK_EVERY = 16
PARTITION_ORDER = 3

# fixed values of the format: block sizes and sample rates by header code, predictor weights by order
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
FIXED_WEIGHTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    value = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, value << 1 ^ poly, value << 1) & ((1 << bits) - 1)
    return value


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc16_rows(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, one step for each byte place."""
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    crc = np.zeros(len(at), np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # those longer than k
        crc[:n] = (crc[:n] << 8 ^ CRC16[crc[:n] >> 8 ^ data[at[:n] + k]]) & 0xFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def _coded_number(n: int) -> bytes:
    """A frame's number in the header's UTF-8-like form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            return bytes([(0xFF00 >> len(tail) + 1 & 0xFF) | n, *reversed(tail)])
        limit >>= 1


_headers: dict[int, bytes] = {}


def _frame_header(number: int) -> bytes:
    """Fixed block size of 576, 8 kHz, mono, 8 bits."""
    if number not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        head = bytes([0xFF, 0xF8, 0x24, 0x02]) + _coded_number(number)
        _headers[number] = head + bytes([_crc8(head)])
    return _headers[number]


def _encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of (F, BLOCK) signed samples: all their bytes, and each frame's length."""
    f, parts = len(samples), 1 << PARTITION_ORDER
    width = BLOCK // parts
    residual = samples.astype(np.int16)
    order = np.zeros(f, np.int32)
    chosen, least = residual.copy(), np.abs(residual[:, 4:]).sum(1, dtype=np.int32)
    for k in range(1, 5):
        residual = np.concatenate([residual[:, :1], residual[:, 1:] - residual[:, :-1]], axis=1)
        cost = np.abs(residual[:, 4:]).sum(1, dtype=np.int32)
        better = cost < least
        if better.any():
            order[better], least = k, np.minimum(cost, least)
            chosen[better] = residual[better]
    coded = np.arange(BLOCK)[None, :] >= order[:, None]
    cut = np.where(coded, chosen << 1 ^ chosen >> 15, 0).reshape(f, parts, width).astype(np.int32)
    count = coded.reshape(f, parts, width).sum(2)
    # a parameter near the logarithm of the mean; no quotient passes 40, which the largest value may force
    mean, largest = cut.sum(2) / count, cut.max(2)
    best_k = np.maximum(np.floor(np.log2(np.maximum(mean * 0.7, 1))), np.ceil(np.log2(np.maximum(largest / 40, 1)))).astype(np.int32)
    best_bits = (cut >> best_k[:, :, None]).sum(2) + count * (best_k + 1)
    rice_bits = best_bits.sum(1) + 4 * parts + 6 + 8 * order
    constant = (samples == samples[:, :1]).all(1)
    verbatim = ~constant & (rice_bits >= 8 * BLOCK)
    rice = ~constant & ~verbatim

    # columns: subframe header, four warm-up places, method and partition order, then for each partition its parameter and samples
    cols = 6 + parts * (1 + width)
    value, size = np.zeros((f, cols), np.int32), np.zeros((f, cols), np.int32)
    value[:, 0] = np.where(constant, 0, np.where(verbatim, 1 << 1, (8 + order) << 1))
    size[:, 0] = 8
    raw = samples.astype(np.int32) & 0xFF
    for k in range(4):
        warm = rice & (order > k) | (constant & (k == 0))
        value[warm, 1 + k], size[warm, 1 + k] = raw[warm, k], 8
    value[rice, 5], size[rice, 5] = PARTITION_ORDER, 6
    body_value, body_size = value[:, 6:].reshape(f, parts, 1 + width), size[:, 6:].reshape(f, parts, 1 + width)
    k3 = best_k[:, :, None]
    rice_value = (1 << k3) | (cut & ((1 << k3) - 1))
    rice_size = np.where(coded.reshape(f, parts, width), (cut >> k3) + 1 + k3, 0)
    three = rice[:, None, None]
    body_value[:, :, 1:] = np.where(three, np.where(rice_size > 0, rice_value, 0), np.where(verbatim[:, None, None], raw.reshape(f, parts, width), 0))
    body_size[:, :, 1:] = np.where(three, rice_size, np.where(verbatim[:, None, None], 8, 0))
    body_value[:, :, 0], body_size[:, :, 0] = np.where(rice[:, None], best_k, 0), np.where(rice[:, None], 4, 0)

    heads = [_frame_header(int(n)) for n in numbers]
    head_len = np.array([len(h) for h in heads], np.int64)
    ends = np.cumsum(size, axis=1, dtype=np.int32)
    body_len = (ends[:, -1] + 7) // 8
    length = head_len + body_len + 2
    start = np.cumsum(length) - length
    last = (ends + 8 * (start + head_len)[:, None].astype(np.int32)).ravel()  # the bit after each field
    value, held = value.ravel(), size.ravel() > 0
    last, value = last[held], value[held].astype(np.int64)
    word, shift = (last - 1) >> 5, 31 - ((last - 1) & 31)
    shifted = value << shift
    words = int(length.sum() + 3) // 4 + 1
    total = np.bincount(word, weights=shifted & 0xFFFFFFFF, minlength=words)
    over = shifted >> 32
    spill = over > 0
    total += np.bincount(word[spill] - 1, weights=over[spill], minlength=words)
    data = total.astype(np.uint64).astype(">u4").view(np.uint8)[: int(length.sum())].copy()
    flat = np.frombuffer(b"".join(heads), np.uint8)
    data[np.repeat(start - (np.cumsum(head_len) - head_len), head_len) + np.arange(len(flat))] = flat
    crc = _crc16_rows(data, start, length - 2)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 0xFF
    return data, length


def padded(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of the block size."""
    return payload + b"\xff" * (-len(payload) % BLOCK if payload else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each padded payload; its bytes are 8-bit samples, 128 standing for zero."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int)
    pieces, lengths = [], []
    for low in range(0, len(samples), FRAMES_AT_ONCE):
        data, length = _encode_frames(samples[low : low + FRAMES_AT_ONCE], numbers[low : low + FRAMES_AT_ONCE])
        pieces.append(data)
        lengths.append(length)
    data = np.concatenate(pieces).tobytes() if pieces else b""
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    offset = np.concatenate([[0], np.cumsum(length)])
    out, at = [], 0
    for count in counts:
        own, base = length[at : at + count], offset[at]
        pcm = samples[at : at + count].tobytes()
        bits = RATE << 44 | 0 << 41 | 7 << 36 | len(pcm)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + bits.to_bytes(8, "big") + hashlib.md5(pcm).digest()
        points = b"".join(struct.pack(">QQH", k * BLOCK, int(offset[at + k] - base), BLOCK) for k in range(0, count, SEEK_EVERY))
        meta = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        out.append(b"fLaC" + meta + data[base : offset[at + count]])
        at += count
    return out


@dataclass
class Decoded:
    """ok: all checksums hold. samples: signed; offsets: of each frame's first byte, from the first frame."""

    ok: bool
    samples: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    seek_points: np.ndarray


def _metadata(stream: bytes) -> tuple[int, bytes, np.ndarray, int, int] | None:
    """(first frame's place, md5, seek points, bits, block size), or None where this is no stream of the supported kind."""
    if stream[:4] != b"fLaC":
        return None
    at, last, md5, points, bits, block = 4, False, b"", np.zeros((0, 2), np.int64), 0, 0
    while not last:
        if at + 4 > len(stream):
            return None
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0 and len(body) == 34:
            low, high = struct.unpack(">HH", body[:4])
            packed = int.from_bytes(body[10:18], "big")
            if low != high or packed >> 41 & 7:
                return None
            block, bits, md5 = high, (packed >> 36 & 31) + 1, body[18:34]
        elif kind == 3:
            points = np.array([p[:2] for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF], np.int64).reshape(-1, 2)
        at += 4 + size
    return (at, md5, points, bits, block) if block and bits in (8, 16) else None


def _frame_at(data: bytes, at: int, number: int, block: int) -> tuple[int, int] | None:
    """(length of the header, samples) if a header with this number starts here."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] != 0xF8:
        return None
    code, rate, channels = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4
    coded = _coded_number(number)
    end = at + 4 + len(coded)
    if channels or data[at + 4 : end] != coded:
        return None
    size = BLOCK_SIZES.get(code, block)
    if code == 6:
        size, end = data[end] + 1, end + 1
    elif code == 7:
        size, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return (end + 1 - at, size) if end < len(data) and _crc8(data[at:end]) == data[end] else None


class _Bits:
    """Reads bits at many places at once."""

    def __init__(self, window: np.ndarray, pos: np.ndarray):
        self.window, self.pos, self.top = window, pos, 8 * (len(window) - 8)

    @classmethod
    def over(cls, data: np.ndarray, pos: np.ndarray) -> _Bits:
        """window: for each byte the eight that start there, as one number."""
        full = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(full, 8)[: len(data) + 8])
        return cls(eight.view(">u8").ravel().astype(np.uint64), pos)

    def _look(self, who: np.ndarray | slice) -> np.ndarray:
        pos = np.minimum(self.pos[who], self.top)
        return self.window[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(self, who: np.ndarray | slice, n: np.ndarray | int) -> np.ndarray:
        """n bits (up to 32) as an unsigned number."""
        n = np.asarray(n, np.int64)
        got = (self._look(who) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)
        self.pos[who] += n
        return got

    def unary(self, who: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is skipped too."""
        seen = (self._look(who) >> np.uint64(11)).astype(np.float64)
        zeros = np.where(seen > 0, 1075 - (seen.view(np.int64) >> 52), 53)
        self.pos[who] += zeros
        more = np.flatnonzero((seen == 0) & (self.pos[who] < self.top))
        if len(more):
            zeros[more] += self.unary(who[more])
        rest = np.flatnonzero(seen > 0)
        self.pos[who[rest]] += 1
        return zeros

    def rice(self, who: np.ndarray | slice, k: np.ndarray) -> np.ndarray:
        """A Rice code each, with parameters k, as an unsigned number."""
        window = self._look(who)
        seen = (window >> np.uint64(11)).astype(np.float64)
        zeros = 1075 - (seen.view(np.int64) >> 52)
        used = zeros + k + 1
        if used.max() > 57:  # a long quotient, or damage
            who = np.arange(len(self.pos))[who]
            q = self.unary(who)
            return q << k | self.take(who, k)
        self.pos[who] += used
        low = window << (zeros + 1).astype(np.uint64) >> np.uint64(1) >> (63 - k).astype(np.uint64)
        return zeros << k | low.astype(np.int64)


def _signed(x: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = 1 << (np.asarray(bits, np.int64) - 1)
    return (x ^ half) - half


def _decode_frames(data: np.ndarray, pos: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(F, size) samples of frames whose subframes start at bit places pos, and whether each could be read."""
    f = len(pos)
    reader = _Bits.over(data, pos.copy())
    everyone = np.arange(f)
    kind = reader.take(everyone, 8)
    wasted, kind = kind & 1, kind >> 1
    out = np.zeros((size, f), np.int64)
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    good = (wasted == 0) & ((kind <= 1) | fixed | lpc) & (order < size)
    constant = np.flatnonzero(good & (kind == 0))
    if len(constant):
        out[:, constant] = _signed(reader.take(constant, bits), bits)
    verbatim = np.flatnonzero(good & (kind == 1))
    for t in range(size if len(verbatim) else 0):
        out[t, verbatim] = _signed(reader.take(verbatim, bits), bits)
    rice = np.flatnonzero(good & (fixed | lpc))
    rice = rice[np.argsort(-order[rice], kind="stable")]  # those with a j-th weight come first
    if not len(rice):
        return out.T, good
    reader, orders, is_lpc = _Bits(reader.window, reader.pos[rice]), order[rice], lpc[rice]
    top, fine = int(orders[0]), np.ones(len(rice), bool)
    reach = [int(np.searchsorted(-orders, -j, side="left")) for j in range(top + 1)]  # how many have more than j weights
    got = np.zeros((size, len(rice)), np.int64)
    for t in range(top):
        got[t, : reach[t]] = _signed(reader.take(slice(0, reach[t]), bits), bits)
    weights, shift = np.zeros((top + 1, len(rice)), np.int64), np.zeros(len(rice), np.int64)
    for k in range(min(top, 4) + 1):
        for j, w in enumerate(FIXED_WEIGHTS[k]):
            weights[j, ~is_lpc & (orders == k)] = w
    quantised = np.flatnonzero(is_lpc)
    if len(quantised):
        precision = reader.take(quantised, 4) + 1
        shift[quantised] = _signed(reader.take(quantised, 5), 5)
        for j in range(int(orders[quantised].max())):
            has = orders[quantised] > j
            weights[j, quantised[has]] = _signed(reader.take(quantised[has], precision[has]), precision[has])
        fine[quantised[(precision == 16) | (shift[quantised] < 0)]] = False
        shift = np.maximum(shift, 0)
    everyone = slice(None)
    method, parts = reader.take(everyone, 2), reader.take(everyone, 4)
    fine[method > 1] = False
    wide = np.where(method == 1, 5, 4)
    per = np.maximum(size >> parts, 1)
    parameter, raw = np.zeros(len(rice), np.int64), np.full(len(rice), -1, np.int64)
    starts = {t for p in np.unique(per).tolist() for t in range(0, size, p)} | set(range(top + 1))
    escapes = False
    for t in range(int(orders[-1]), size):
        active = everyone if t >= top else np.flatnonzero(orders <= t)
        if t in starts:
            begins = np.flatnonzero(((t % per == 0) & (orders <= t)) | (t == orders))
            code = reader.take(begins, wide[begins])
            escape = code == (1 << wide[begins]) - 1
            parameter[begins], raw[begins] = code, -1
            if escape.any():
                raw[begins[escape]] = reader.take(begins[escape], 5)
            escapes = bool((raw >= 0).any())
        if escapes:
            ids = np.arange(len(rice))[active]
            e = np.zeros(len(ids), np.int64)
            plain, odd = np.flatnonzero(raw[ids] < 0), np.flatnonzero(raw[ids] >= 0)
            if len(plain):
                u = reader.rice(ids[plain], parameter[ids[plain]])
                e[plain] = u >> 1 ^ -(u & 1)
            n = raw[ids[odd]]
            e[odd] = np.where(n > 0, _signed(reader.take(ids[odd], n), np.maximum(n, 1)), 0)
        else:
            u = reader.rice(active, parameter[active])
            e = u >> 1 ^ -(u & 1)
        got[t, active] = e
        if top and reach[0]:
            m = reach[0]
            past = np.zeros(m, np.int64)
            for j in range(min(top, t)):
                past[: reach[j]] += weights[j, : reach[j]] * got[t - 1 - j, : reach[j]]
            got[t, :m] += np.where(orders[:m] <= t, past >> shift[:m], 0)
    out[:, rice] = got
    good[rice] = fine
    return out.T, good


def _frames_in_turn(stream: bytes, first: int, block: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(places, heads) of frames: each begins at the first header with the next running number."""
    starts, heads, at = [], [], first
    while at >= 0:
        head = _frame_at(stream, at, len(starts), block)
        if head:
            starts.append(at)
            heads.append(head)
        at = stream.find(b"\xff\xf8", at + 1)
    return starts, heads


def _number_at(data: bytes, at: int) -> int | None:
    """The running number that is coded here as in UTF-8, if it is one."""
    lead = data[at] if at < len(data) else 0xFF
    more = next((k for k in range(7) if not lead & 0x80 >> k), 7)
    if more in (1, 7):
        return None
    number = lead & 0x7F >> more
    for byte in data[at + 1 : at + max(more, 1)]:
        number = number << 6 | byte & 0x3F
    return number


def _frames_by_checksum(stream: bytes, first: int, block: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The same where samples look like a header: a frame ends where its checksum holds, and a wrong end is taken back."""
    marks: dict[int, list[tuple[int, tuple[int, int]]]] = {}
    at = stream.find(b"\xff\xf8", first)
    while at >= 0:
        number = _number_at(stream, at + 4)
        head = None if number is None else _frame_at(stream, at, number, block)
        if head:
            marks.setdefault(number, []).append((at, head))
        at = stream.find(b"\xff\xf8", at + 1)

    def ends(number: int, begin: int) -> Iterator[tuple[int, tuple[int, int] | None]]:
        for end, head in [*[m for m in marks.get(number + 1, ()) if m[0] > begin], (len(stream), None)]:
            frame = np.frombuffer(stream, np.uint8, end - begin, begin)
            if _crc16_rows(frame, np.zeros(1, np.int64), np.array([end - begin]))[0] == 0:
                yield end, head

    path = [m for m in marks.get(0, ()) if m[0] == first]
    open_ends = [ends(0, first)] if path else []
    while open_ends:
        end, head = next(open_ends[-1], (-1, None))
        if end == len(stream):
            return [p for p, _ in path], [h for _, h in path]
        if end < 0:
            open_ends.pop()
            path.pop()
        else:
            path.append((end, head))
            open_ends.append(ends(len(path) - 1, end))
    return [], []


def decode(streams: list[bytes]) -> list[Decoded]:
    """Every stream's samples and frame places; frames of all streams are decoded side by side."""
    meta = [_metadata(stream) for stream in streams]
    edges: list[list[int]] = [[] for _ in streams]
    rows: list[list[np.ndarray | None]] = [[] for _ in streams]

    def read(chosen: list[int], frames_of: Callable[[bytes, int, int], tuple[list[int], list[tuple[int, int]]]]) -> None:
        jobs: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
        for s in chosen:
            first, _, _, bits, block = meta[s]
            starts, heads = frames_of(streams[s], first, block)
            edges[s], rows[s] = [*starts, len(streams[s])], [None] * len(heads)
            for k, (n, size) in enumerate(heads):
                jobs.setdefault((size, bits), []).append((s, k, edges[s][k], edges[s][k + 1], n))
        for (size, bits), frames in jobs.items():
            for low in range(0, len(frames), FRAMES_AT_ONCE):
                part = frames[low : low + FRAMES_AT_ONCE]
                length = np.array([b - a for _, _, a, b, _ in part], np.int64)
                begin = np.cumsum(length) - length
                data = np.frombuffer(b"".join([streams[s][a:b] for s, _, a, b, _ in part]), np.uint8)
                right = _crc16_rows(data, begin, length) == 0  # over a frame with its checksum
                got, good = _decode_frames(data, 8 * (begin + np.array([n for *_, n in part])), size, bits)
                got = got.astype(np.int8 if bits == 8 else "<i2")
                for row, (s, k, *_), fine in zip(got, part, right & good):
                    rows[s][k] = row if fine else None

    def whole_stream(s: int) -> bool:
        return bool(rows[s]) and edges[s][0] == meta[s][0] and all(r is not None for r in rows[s])

    known = [s for s, m in enumerate(meta) if m is not None]
    read(known, _frames_in_turn)
    read([s for s in known if not whole_stream(s)], _frames_by_checksum)
    out = []
    for s, m in enumerate(meta):
        none = np.zeros(0, np.int8)
        if m is None:
            out.append(Decoded(False, none, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)))
            continue
        first, md5, points, *_ = m
        ok = whole_stream(s)
        samples = np.concatenate(rows[s]) if ok else none
        ok = ok and (md5 == bytes(16) or hashlib.md5(samples.tobytes()).digest() == md5)
        out.append(Decoded(ok, samples if ok else none, np.array(edges[s][:-1], np.int64) - first, np.array([0 if r is None else len(r) for r in rows[s]], np.int64), points))
    return out


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes together, or a single row."""
    low, total = 0, 0
    for k, n in enumerate(sizes):
        if k > low and total + n > most:
            yield low, k
            low, total = k, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a FLAC stream."""
    schema = "doc_id long, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            sizes = pc.binary_length(raw).to_pylist()
            for low, high in _slices(sizes, BLOCK * FRAMES_AT_ONCE):
                media = encode([padded(x) for x in raw.slice(low, high - low).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes[low:high], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long"), whole(text)).mapInArrow(run, schema)


def _feature(samples: np.ndarray) -> str:
    """Mean, root mean square, largest size and sign changes of the samples."""
    x = samples.astype(np.int64)
    changes = int(np.count_nonzero(np.signbit(samples[1:]) != np.signbit(samples[:-1])))
    return f"mean={x.sum() / len(x):.6f};rms={(np.dot(x, x) / len(x)) ** 0.5:.6f};peak={int(np.abs(x).max())};crossings={changes}"


def features(stored: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """Digests and features of 8-bit streams, all from bytes read back: one row for each stream."""
    schema = "doc_id long, n_bytes long, ok boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_seek_points long"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [x or b"" for x in batch.column(2).to_pylist()]
            ids, n_bytes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in _slices([len(s) for s in streams], BLOCK * FRAMES_AT_ONCE):
                rows = []
                for k, got in zip(range(low, high), decode(streams[low:high])):
                    raw = (got.samples.view(np.uint8) ^ 0x80).tobytes() if got.ok else None
                    seen = [len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:])] if got.ok else [None] * 3
                    rows.append([ids[k], n_bytes[k], got.ok, *seen, len(streams[k]), hashlib.sha256(streams[k]).hexdigest(), _feature(got.samples) if got.ok else None, len(got.offsets), len(got.seek_points)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return stored.select(F.col(doc_id).cast("long"), "n_bytes", media).mapInArrow(run, schema)


def pcm_blocks(stored: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, n_samples, ok, pcm): a row for each frame, little-endian PCM.

    A stream that can't be read gives one row with ok = false and null places.
    """
    schema = "doc_id long, block long, sample_offset long, byte_offset long, n_samples long, ok boolean, pcm binary"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, ids = [x or b"" for x in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for low, high in _slices([len(s) for s in streams], BLOCK * FRAMES_AT_ONCE):
                rows = []
                for k, got in zip(range(low, high), decode(streams[low:high])):
                    if not got.ok:
                        rows.append([ids[k], None, None, None, None, False, None])
                        continue
                    at = np.cumsum(got.sizes) - got.sizes
                    rows += [[ids[k], j, int(a), int(o), int(n), True, got.samples[a : a + n].tobytes()] for j, (a, o, n) in enumerate(zip(at, got.offsets, got.sizes))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return stored.select(F.col(doc_id).cast("long"), media).mapInArrow(run, schema)
