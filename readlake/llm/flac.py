"""FLAC media columns: 8-bit mono streams written and read back many frames at a time.

A frame has ``BLOCK`` samples. The frames of a batch of rows are lanes of numpy arrays: linear
prediction, Rice codes and checksums advance by one sample or byte in all lanes at once. Every
frame has a seek point, so a reader finds the frame of a sample without scanning.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread, whole_text

BLOCK, RATE = 192, 8000
#: Frames that are worked on at once.
LANES = 8192
#: Coefficient bits and shift of the encoder's second-order linear predictor.
PRECISION, SHIFT = 9, 6
#: Coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Seek points that one metadata block holds: its length has 24 bits.
MOST_POINTS = ((1 << 24) - 5) // 18
#: Names the metadata blocks that hold the points of every frame where the seek table can't.
_ALL_POINTS = b"rlsk"
_SEEK = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """Remainders after ``bits`` further bits of every register value on those bits."""
    crc = np.arange(1 << bits, dtype=np.uint32) << max(0, width - bits)
    for _ in range(bits):
        crc = np.where(crc >> (width - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << width) - 1)
    return crc


CRC8, CRC16 = _crc_table(0x07, 8, 8).astype(np.uint8), _crc_table(0x8005, 16, 16).astype(np.uint16)
#: Leading zeros of 16 bits.
ZEROS = np.array([16 - int(x).bit_length() for x in range(1 << 16)], dtype=np.uint8)


def _crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksums of data[start:end] for all lanes; zeros in front don't change them."""
    steps = (int((end - start).max(initial=0)) + 1) // 2
    crc = np.zeros(len(start), np.uint16)
    for k in range(steps, 0, -1):
        at = end - 2 * k
        first = np.where(at >= start, data[np.maximum(at, 0)], 0).astype(np.uint16)
        second = np.where(at + 1 >= start, data[np.maximum(at + 1, 0)], 0)
        crc = CRC16[crc ^ (first << 8 | second)]
    return crc


def _headers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Header bytes of the frames (a row each) and their lengths: sync, block size, rate, one
    channel, 8 bits, the frame's number in one to six bytes, checksum."""
    n = len(numbers)
    size = 1 + sum((numbers >= limit).astype(np.int64) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((n, 11), np.uint8)
    out[:, :4] = (0xFF, 0xF8, 0x14, 0x02)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])[size]
    for k in range(6):
        part = numbers >> np.maximum(6 * (size - 1 - k), 0)
        out[:, 4 + k] = np.where(k >= size, 0, np.where(k == 0, lead | part, 0x80 | part & 0x3F))
    crc = np.zeros(n, np.uint8)
    for k in range(10):
        crc = np.where(k < 4 + size, CRC8[crc ^ out[:, k]], crc)
    out[np.arange(n), 4 + size] = crc
    return out, 5 + size


def _zigzag(e: np.ndarray) -> np.ndarray:
    return e << 1 ^ e >> 31


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames, one after the other, and the length of each. ``samples``: (n, BLOCK) of -128..127."""
    n = len(samples)
    s = samples.astype(np.int32)
    residuals, costs, parameters = [], [], []
    f = s.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, k:], f[:, : BLOCK - k], dtype=np.float64) for k in range(3))
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 0, det, 1)
    c = np.stack([np.where(det > 0, r1 * (r0 - r2) / safe, 0), np.where(det > 0, (r0 * r2 - r1 * r1) / safe, 0)])
    c = np.clip(np.rint(c * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)
    for order in (0, 1, 2, -2):
        e = np.zeros_like(s)
        if order == 0:
            e = s
        elif order == 1:
            e[:, 1:] = s[:, 1:] - s[:, :-1]
        elif order == 2:
            e[:, 2:] = s[:, 2:] - 2 * s[:, 1:-1] + s[:, :-2]
        else:
            e[:, 2:] = s[:, 2:] - (c[0][:, None] * s[:, 1:-1] + c[1][:, None] * s[:, :-2] >> SHIFT)
        z = _zigzag(e)
        total, most = z.sum(1, dtype=np.int64), z.max(1)
        ks = np.arange(8)[:, None]
        bits = (BLOCK - abs(order)) * (1 + ks) + (total >> ks) + 8 * abs(order) + (9 + 2 * PRECISION) * (order < 0)
        bits = np.where(most >> ks < 16, bits, 1 << 30)  # a unary part fits what a reader looks at
        residuals.append(z)
        costs.append(bits.min(0))
        parameters.append(bits.argmin(0))
    choice = np.argmin(costs, 0)
    order, lpc = np.array([0, 1, 2, 2])[choice], choice == 3
    k = np.choose(choice, parameters).astype(np.int64)
    z = np.choose(choice[:, None], residuals)
    z_bits = (z >> k[:, None]) + 1 + k[:, None]
    z_value = (1 << k[:, None]) | z & ((1 << k[:, None]) - 1)
    z_bits[:, 0] = np.where(order > 0, 0, z_bits[:, 0])
    z_bits[:, 1] = np.where(order > 1, 0, z_bits[:, 1])
    value, bits = np.empty((n, 7 + BLOCK), np.int64), np.empty((n, 7 + BLOCK), np.int64)
    value[:, 0], bits[:, 0] = np.where(lpc, 0b0100001 << 1, (8 + order) << 1), 8  # the type, no wasted bits
    value[:, 1], bits[:, 1] = s[:, 0] & 255, 8 * (order > 0)
    value[:, 2], bits[:, 2] = s[:, 1] & 255, 8 * (order > 1)
    value[:, 3], bits[:, 3] = (PRECISION - 1) << 5 | SHIFT, 9 * lpc
    for j in (0, 1):
        value[:, 4 + j], bits[:, 4 + j] = c[j] & ((1 << PRECISION) - 1), PRECISION * lpc
    value[:, 6], bits[:, 6] = k, 10  # method 0, one partition, its parameter
    value[:, 7:], bits[:, 7:] = z_value, z_bits
    header, header_bytes = _headers(numbers)
    offset = np.cumsum(bits, 1)
    body = (offset[:, -1] + 7) // 8
    length = header_bytes + body + 2
    start = np.cumsum(length) - length
    at = (offset - bits + 8 * (start + header_bytes)[:, None]).ravel()
    bits, value = bits.ravel(), np.where(bits > 0, value, 0).ravel().astype(np.uint64)
    wide = value << (64 - (at & 31) - bits).astype(np.uint64)
    words = np.zeros((int(length.sum()) + 7) // 4 + 1)
    for word, part in ((at >> 5, wide >> np.uint64(32)), ((at >> 5) + 1, wide & np.uint64(0xFFFFFFFF))):
        words += np.bincount(word, part, len(words))  # no bit is set twice, so sums are unions
    data = np.frombuffer(words.astype(np.uint32).astype(">u4").tobytes(), np.uint8)[: int(length.sum())].copy()
    for j in range(11):
        own = j < header_bytes
        data[start[own] + j] = header[own, j]
    crc = _crc16(data, start, start + length - 2)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 255
    return data, length


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (n, BLOCK), frame numbers and subframe types of the frames data[start:end]; a frame
    whose header or checksums are wrong raises ValueError."""
    n = len(start)
    data = np.concatenate([data, np.zeros(12, np.uint8)])
    if np.any(end - start < 10) or np.any(data[start] != 0xFF) or np.any(data[start + 1] != 0xF8) or np.any(data[start + 2] != 0x14) or np.any(data[start + 3] != 0x02):
        raise ValueError("not a frame of this stream's form")
    lead = data[start + 4].astype(np.int64)
    ones = np.array([8 - (255 - b).bit_length() for b in range(256)])[lead]
    size = np.maximum(ones, 1)
    number = np.where(ones == 0, lead, lead & (0x7F >> ones))
    for k in range(1, 6):
        number = np.where(k < size, number << 6 | data[start + 4 + k] & 0x3F, number)
    crc = np.zeros(n, np.uint8)
    for k in range(10):
        crc = np.where(k < 4 + size, CRC8[crc ^ data[start + k]], crc)
    if np.any(crc != data[start + 4 + size]):
        raise ValueError("wrong header checksum")
    if np.any(_crc16(data, start, end - 2) != data[end - 2].astype(np.uint16) << 8 | data[end - 1]):
        raise ValueError("wrong frame checksum")
    window = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    window = window.astype(np.uint64)
    last = len(window) - 1
    full = np.uint64(0xFFFFFFFF)

    def look(at: np.ndarray) -> np.ndarray:
        """32 bits from bit ``at`` on, of which 25 hold."""
        return window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint64) & full

    def read(at: np.ndarray, bits: int) -> np.ndarray:
        return (look(at) >> np.uint64(32 - bits)).astype(np.int64)

    def signed(x: np.ndarray, bits: int) -> np.ndarray:
        return x - (x >> (bits - 1) << bits)

    at = 8 * (start + 5 + size)
    kind = read(at, 8) >> 1
    at = at + 8
    constant, verbatim, lpc = kind == 0, kind == 1, kind >= 32
    fixed = (kind >= 8) & (kind <= 12)
    if not np.all(constant | verbatim | fixed | lpc):
        raise ValueError("reserved subframe type")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, np.where(verbatim, BLOCK, 0)))
    out = np.zeros((BLOCK, n), np.int32)
    out[:, constant] = signed(read(at[constant], 8), 8)
    for t in range(int(order.max(initial=0))):
        own = order > t
        out[t, own] = signed(read(at[own], 8), 8)
        at[own] += 8
    shift, coded = np.zeros(n, np.int64), lpc | fixed
    most = int(order[coded].max(initial=0))
    coefficients = np.zeros((most, n), np.int64)
    for o in range(1, min(most, 4) + 1):
        for j in range(o):
            coefficients[j, fixed & (order == o)] = FIXED[o][j]
    if lpc.any():
        for bits in range(1, 16):
            own = lpc & (read(at, 4) + 1 == bits)
            if own.any():
                shift[own] = signed(read(at[own] + 4, 5), 5)
                for j in range(int(order[own].max())):
                    deep = own & (order > j)
                    coefficients[j, deep] = signed(read(at[deep] + 9 + j * bits, bits), bits)
                at[own] += 9 + bits * order[own]
                lpc = lpc & ~own  # their place has moved on
    lanes = np.flatnonzero(coded)
    at, own_order, own_shift, coefficients = at[lanes], order[lanes], shift[lanes], coefficients[:, lanes]
    method, partitions = read(at, 2), read(at + 2, 4)
    if np.any(method > 1):
        raise ValueError("reserved coding method")
    at = at + 6
    width, each = 4 + method, BLOCK >> partitions
    k = np.zeros(len(lanes), np.uint64)
    most_order, alone, result = int(own_order.max(initial=0)), not partitions.any(), out[:, lanes]
    for t in range(BLOCK):
        new = np.flatnonzero(t % each == 0) if not alone or t == 0 else ()
        if len(new):
            k[new] = (look(at[new]) >> (32 - width[new]).astype(np.uint64))
            if np.any(k[new] == (1 << width[new]) - 1):
                raise ValueError("unencoded partitions aren't supported")
            at[new] += width[new]
        some = slice(None) if t >= most_order else np.flatnonzero(own_order <= t)
        p, kk = at[some], k[some]
        w = look(p)
        q = ZEROS[w >> np.uint64(16)].astype(np.int64)
        base = np.zeros(0)
        if (q == 16).any():  # long unary parts, sixteen bits at a time
            base = np.zeros(len(p), np.int64)
            while (far := q == 16).any():
                base[far] += 16
                q[far] = ZEROS[look(p[far] + base[far]) >> np.uint64(16)]
            w = look(p + base)
        w = w << (q + 1).astype(np.uint64) & full
        deep = kk > 8  # the remainder may lie beyond the window
        rest = w >> (np.uint64(32) - kk)
        whole = q + base if len(base) else q
        if deep.any():
            rest[deep] = look(p[deep] + whole[deep] + 1) >> (np.uint64(32) - kk[deep])
        z = whole << kk.astype(np.int64) | rest.astype(np.int64)
        at[some] = p + whole + 1 + kk.astype(np.int64)
        e = z >> 1 ^ -(z & 1)
        if most:
            guess = sum(coefficients[j][some] * result[t - j - 1][some] for j in range(min(most, t))) if t else 0
            e = e + (guess >> own_shift[some])
        result[t, some] = e
    out[:, lanes] = result
    return np.ascontiguousarray(out.T), number, kind


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file of each payload, whose length is a positive multiple of BLOCK: byte b is sample b - 128."""
    frames = np.array([len(p) // BLOCK for p in payloads], np.int64)
    first = np.cumsum(frames) - frames
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int8).reshape(-1, BLOCK)
    numbers = np.arange(len(samples), dtype=np.int64) - np.repeat(first, frames)
    parts, lengths = [], []
    for a in range(0, len(samples), LANES):
        data, length = encode_frames(samples[a : a + LANES], numbers[a : a + LANES])
        parts.append(data.tobytes())
        lengths.append(length)
    data, length = b"".join(parts), np.concatenate(lengths)
    end = np.cumsum(length)
    out = []
    for a, n in zip(first.tolist(), frames.tolist()):
        size, begin = length[a : a + n], int(end[a] - length[a])
        points = np.zeros(n, _SEEK)
        points["sample"], points["offset"], points["samples"] = np.arange(n) * BLOCK, end[a : a + n] - size - begin, BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(samples[a : a + n].tobytes()).digest()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + _seek_blocks(points) + data[begin : int(end[a + n - 1])])
    return out


def _seek_blocks(points: np.ndarray) -> bytes:
    """The seek table, as the last metadata block. With more points than it holds it has every second
    one, or third, and so on, and application blocks after it have them all."""
    every = -(-len(points) // MOST_POINTS)
    blocks = [(3, points[::every].tobytes())]
    if every > 1:
        blocks += [(2, _ALL_POINTS + points[a : a + MOST_POINTS].tobytes()) for a in range(0, len(points), MOST_POINTS)]
    last = len(blocks) - 1
    return b"".join(bytes([kind | 128 * (k == last)]) + len(body).to_bytes(3, "big") + body for k, (kind, body) in enumerate(blocks))


def frame_places(stream: bytes) -> tuple[int, np.ndarray, bytes]:
    """Where the frames of a file begin, their seek points, and the samples' MD5."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, points, digest, all_points = 4, False, None, b"", []
    while not last:
        last, kind, size = stream[at] >= 128, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            digest = stream[at + 22 : at + 38]
        elif kind == 3:
            points = np.frombuffer(stream, _SEEK, size // _SEEK.itemsize, at + 4)
        elif kind == 2 and stream[at + 4 : at + 8] == _ALL_POINTS:
            all_points.append(np.frombuffer(stream, _SEEK, (size - 4) // _SEEK.itemsize, at + 8))
        at += 4 + size
    if points is None:
        raise ValueError("no seek table")
    return at, np.concatenate(all_points) if all_points else points, digest


def decode_streams(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The payload of each file and its frames' subframe types; all checksums are verified."""
    places = [frame_places(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    start = np.concatenate([b + at + points["offset"].astype(np.int64) for b, (at, points, _) in zip(base, places)])
    last = np.cumsum([len(points) for _, points, _ in places])
    end = np.append(start[1:], 0)
    end[last - 1] = base[1:]
    data = np.frombuffer(b"".join(streams), np.uint8)
    samples, kinds = [], []
    for a in range(0, len(start), LANES):
        low, high = int(start[a]), int(end[min(a + LANES, len(start)) - 1])
        block, number, kind = decode_frames(data[low:high], start[a : a + LANES] - low, end[a : a + LANES] - low)
        samples.append(block.astype(np.int8))
        kinds.append(kind)
        wanted = np.arange(a, a + len(number)) - np.repeat(np.append(0, last[:-1]), np.diff(np.append(0, last)))[a : a + len(number)]
        if np.any(number != wanted):
            raise ValueError("frames are out of order")
    pcm, kind = np.concatenate(samples), np.concatenate(kinds)
    payloads, types = [], []
    for (_, points, digest), stop in zip(places, last.tolist()):
        own = pcm[stop - len(points) : stop]
        if hashlib.md5(own.tobytes()).digest() != digest:
            raise ValueError("wrong digest of the samples")
        payloads.append((own.astype(np.int16) + 128).astype(np.uint8).tobytes())
        types.append(kind[stop - len(points) : stop])
    return payloads, types


def decode_samples(stream: bytes, first: int, count: int, places: tuple[int, np.ndarray, bytes] | None = None) -> bytes:
    """The payload's bytes from sample ``first`` on, ``count`` of them or as many as there are. The seek
    points say which frames hold them; no others are read, and the checksums of these are verified."""
    at, points, _ = places or frame_places(stream)
    sample = points["sample"].astype(np.int64)
    stop = min(first + count, int(sample[-1]) + int(points["samples"][-1]))
    if first < 0 or first >= stop:
        return b""
    low, high = int(np.searchsorted(sample, first, "right")) - 1, int(np.searchsorted(sample, stop))
    begin = np.append(at + points["offset"].astype(np.int64), len(stream))
    data, parts = np.frombuffer(stream, np.uint8), []
    for a in range(low, high, LANES):
        b = min(a + LANES, high)
        block, number, _ = decode_frames(data[begin[a] : begin[b]], begin[a:b] - begin[a], begin[a + 1 : b + 1] - begin[a])
        if np.any(number != np.arange(a, b)):
            raise ValueError("frames are out of order")
        parts.append((block.astype(np.int16) + 128).astype(np.uint8).ravel())
    skip = first - int(sample[low])
    return np.concatenate(parts)[skip : skip + stop - first].tobytes()


def payload(text: bytes) -> bytes:
    """The text's bytes and as many spaces as make a positive multiple of BLOCK."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def feature(samples: np.ndarray, kinds: np.ndarray) -> str:
    """Frames by predictor, greatest amplitude, mean size and sign changes of a payload's samples."""
    x = samples.astype(np.int16) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    fixed, linear = int(np.count_nonzero((kinds >= 8) & (kinds <= 12))), int(np.count_nonzero(kinds >= 32))
    size = np.abs(x)
    return f"fixed={fixed};lpc={linear};peak={int(size.max())};mean={int(size.sum(dtype=np.int64)) * 1000 // len(x)};crossings={changes}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _text_slices(batches: Iterator[pa.RecordBatch], most: int = LANES * BLOCK) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, so many at a time that they come to about ``most`` bytes; a longer text comes alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch[0].to_pylist(), batch[1]):
            text = text.as_py()
            if texts and size + len(text) > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + BLOCK
    if texts:
        yield ids, texts


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().cast("binary").alias("data")))


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media) with the FLAC file of each whole text; a null text counts as empty."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _text_slices(batches):
            media = encode_streams([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    return _texts(docs).mapInArrow(store, "doc_id long, media binary")


_BLOCKS = "doc_id long, first_sample long, pcm binary"


def _block_batch(doc_id: int | None, starts: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([doc_id] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], ["doc_id", "first_sample", "pcm"])


def pcm_blocks(media: DataFrame, samples: int = 16 * BLOCK) -> DataFrame:
    """(doc_id, first_sample, pcm): the decoded samples of each file in blocks that start at
    multiples of ``samples``, so that a reader filters on the offset it wants. A null file has none.

    A file is decoded from seek point to seek point, about ``LANES`` frames at a time, and the digest of
    all its samples is compared at the end: a worker holds the file and one stretch of it.
    """
    stretch = max(1, LANES * BLOCK // samples) * samples

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, stream in zip(batch["doc_id"].to_pylist(), batch["media"]):
                if not stream.is_valid:
                    continue
                stream = stream.as_py()
                places, digest, at = frame_places(stream), hashlib.md5(), 0
                while pcm := decode_samples(stream, at, stretch, places):
                    digest.update((np.frombuffer(pcm, np.uint8) ^ 128).tobytes())
                    starts = range(0, len(pcm), samples)
                    yield _block_batch(doc_id, [at + a for a in starts], [pcm[a : a + samples] for a in starts])
                    at += len(pcm)
                if digest.digest() != places[2]:
                    raise ValueError("wrong digest of the samples")

    return media.select("doc_id", "media").mapInArrow(decode, _BLOCKS)


def pcm_range(media: DataFrame, first: int, count: int) -> DataFrame:
    """(doc_id, first_sample, pcm) with ``count`` samples of each file from ``first`` on, fewer where the
    file ends before; files that end before ``first`` and null files have no row. The file is sought,
    not decoded: only the frames that hold the range are read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, stream in zip(batch["doc_id"].to_pylist(), batch["media"]):
                if stream.is_valid and (pcm := decode_samples(stream.as_py(), first, count)):
                    yield _block_batch(doc_id, [first], [pcm])

    return media.select("doc_id", "media").mapInArrow(decode, _BLOCKS)


def media_report(docs: DataFrame) -> DataFrame:
    """Store each whole text as a FLAC file, read that back, and describe both: ``SCHEMA``.

    A null or empty text is one block of spaces. Rows stand each for itself, so repeated rows and
    null ids give repeated results and an empty table none; equal texts have equal files. A worker
    holds about ``LANES`` frames at a time, or one text that is longer, of any length. Only doc_id
    and text are read, so further columns cannot clash.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _text_slices(batches):
            media = encode_streams([payload(t) for t in texts])
            stored, kinds = decode_streams(media)
            rows = [
                (i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(p, np.uint8), k), len(k))
                for i, t, p, m, k in zip(ids, texts, stored, media, kinds)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], [x.split()[0] for x in SCHEMA.split(", ")])

    return _texts(docs).mapInArrow(report, SCHEMA)


def op3_flac_media(spark, sf_dir: str) -> DataFrame:
    """``media_report`` of all ``documents``, which states what nulls, empty and long texts give."""
    return media_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
