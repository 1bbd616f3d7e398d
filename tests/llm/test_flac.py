import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from readlake.llm import flac

from .data import awkward, empty, table


def test_round_trip_and_batch_independence():
    r = random.Random(1)
    raw = [b"", b" ", b"x" * 192, b"x" * 193, os.urandom(5000), bytes([0, 255] * 500), bytes(192), b"a" * 40000, bytes(r.choices(range(256), k=777))]
    payloads = [flac.payload(t) for t in raw]
    media = flac.encode_streams(payloads)
    assert flac.decode_streams(media)[0] == payloads
    assert [flac.encode_streams([p])[0] for p in payloads] == media
    assert any((k >= 32).any() for k in flac.decode_streams(media)[1])  # a linear predictor was used


def crc16(data):
    crc = 0
    for x in data:
        crc ^= x << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def test_frame_layout_and_damage():
    media = flac.encode_streams([flac.payload(b"some text " * 100)])[0]
    at, points, digest = flac.frame_places(media)
    frame = media[at : at + int(points["offset"][1])]
    assert media[:4] == b"fLaC" and frame[:2] == b"\xff\xf8" and crc16(frame[:-2]) == int.from_bytes(frame[-2:], "big")
    assert points["sample"].tolist() == list(range(0, 192 * len(points), 192))
    for place in (at + 3, at + 9, len(media) - 1):
        bad = bytearray(media)
        bad[place] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(bad)])


def test_long_unary_parts_and_partitions_are_read():
    """A frame written bit by bit: order 1, two partitions of parameter 0 and 3, one long unary code."""
    samples = [0, 40, 41] + [41] * 189
    residual = [b - a for a, b in zip(samples, samples[1:])]
    zig = [2 * x if x >= 0 else -2 * x - 1 for x in residual]
    bits = "00010010" + "00000000" + "00" + "0001"
    for k, part in ((0, zig[:95]), (3, zig[95:])):
        bits += f"{k:04b}" + "".join("0" * (z >> k) + "1" + (f"{z & ((1 << k) - 1):0{k}b}" if k else "") for z in part)
    bits += "0" * (-len(bits) % 8)
    header, size = flac._headers(np.array([0]))
    body = bytes(header[0, : size[0]]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame = np.frombuffer(body + crc16(body).to_bytes(2, "big"), np.uint8)
    out, number, kind = flac.decode_frames(frame, np.array([0]), np.array([len(frame)]))
    assert out[0].tolist() == samples and number[0] == 0 and kind[0] == 9


def test_more_frames_than_a_seek_table_holds(monkeypatch):
    raw = flac.payload(os.urandom(192 * 100))
    (plain,) = flac.encode_streams([raw])
    monkeypatch.setattr(flac, "MOST_POINTS", 30)
    (media,) = flac.encode_streams([raw])
    assert flac.decode_streams([media, media])[0] == [raw, raw]
    at, points, _ = flac.frame_places(media)
    assert len(points) == 100 and media[at:] == plain[-len(media) + at :]
    table = 4 + 4 + 34  # after the stream's description
    assert media[table] == 3 and int.from_bytes(media[table + 1 : table + 4], "big") == 25 * 18


def test_very_long_text(spark):
    text = "long words and more of them " * 400_000
    (row,) = flac.media_report(table(spark, [text])).collect()
    assert row.n_bytes == len(text) and row.payload_sha256 == hashlib.sha256(flac.payload(text.encode())).hexdigest()


def test_report(spark):
    texts = awkward() + ["é" * 96, "x" * 192]
    rows = {r.doc_id: r for r in flac.media_report(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
    assert rows[3].media_sha256 == rows[4].media_sha256 and rows[3].feature == rows[4].feature
    assert flac.media_report(empty(spark)).count() == 0


def test_stored_media_has_seekable_blocks(spark):
    docs = table(spark, ["abc " * 3000, None])
    blocks = flac.pcm_blocks(flac.store_media(docs)).orderBy("doc_id", "first_sample").collect()
    joined = b"".join(r.pcm for r in blocks if r.doc_id == 0)
    assert joined == flac.payload(b"abc " * 3000) and [r.first_sample for r in blocks if r.doc_id == 0][:2] == [0, 3072]


def test_ranges_are_sought(spark, monkeypatch):
    r = random.Random(5)
    raw = flac.payload(bytes(r.choices(range(256), k=20_000)))
    (media,) = flac.encode_streams([raw])
    for lanes in (7, flac.LANES):
        monkeypatch.setattr(flac, "LANES", lanes)
        for first, count in [(0, 1), (191, 2), (192, 192), (5, 5000), (len(raw) - 3, 99), (0, len(raw)), (len(raw), 1), (3, 0), (-1, 4)]:
            assert flac.decode_samples(media, first, count) == (raw[first : first + count] if first >= 0 else b"")
    at, points, _ = flac.frame_places(media)
    bad = bytearray(media)
    bad[at + int(points["offset"][3]) + 9] ^= 4  # the fourth frame: nothing else notices
    assert flac.decode_samples(bytes(bad), 0, 576) == raw[:576] and flac.decode_samples(bytes(bad), 768, 9999) == raw[768:10767]
    with pytest.raises(ValueError):
        flac.decode_samples(bytes(bad), 570, 7)
    files = spark.createDataFrame([(1, media), (2, flac.encode_streams([flac.payload(b"short")])[0]), (3, None), (None, media)], "doc_id long, media binary")
    rows = {x.doc_id: x for x in flac.pcm_range(files, 300, 1000).collect()}
    assert set(rows) == {1, None} and rows[1].pcm == rows[None].pcm == raw[300:1300] and rows[1].first_sample == 300
    blocks = flac.pcm_blocks(files.where("doc_id = 1"), 500).orderBy("first_sample").collect()
    assert b"".join(x.pcm for x in blocks) == raw and [x.first_sample for x in blocks] == list(range(0, len(raw), 500))
    assert flac.pcm_range(files.where("false"), 0, 5).count() == flac.pcm_blocks(files.where("false")).count() == 0


def test_blocks_verify_the_digest(spark):
    media = bytearray(flac.encode_streams([flac.payload(b"some text " * 100)])[0])
    media[8 + 18] ^= 1  # the digest in the stream's description
    with pytest.raises(Exception, match="wrong digest"):
        flac.pcm_blocks(spark.createDataFrame([(1, bytes(media))], "doc_id long, media binary")).collect()
