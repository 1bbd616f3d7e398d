"""Binary alignments against the same records as text."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from readlake.operators import quality
from readlake.sources import bam, text

COLUMNS = ("read_id", "flag", "transcript_id", "start", "end", "mapq", "cigar", "seq", "qual", "NM", "M", "I", "D", "S", "H", "read_length", "aligned_length", "transcript_length", "aligned_fraction", "read_coverage", "read_accuracy")


def sam(n, seed=1):
    r = random.Random(seed)
    refs = [(f"T{k}", 500 + 100 * k) for k in range(9)]
    lines = [f"@SQ\tSN:{t}\tLN:{n}" for t, n in refs]
    for i in range(n):
        size = r.choice((1, 20, 33, 150, 4000)) if i % 50 else 30000
        seq = "".join(r.choices("ACGTN", k=size))
        qual = "*" if i % 11 == 0 else "".join(chr(33 + r.randrange(60)) for _ in range(size))
        cigar = f"{size}M" if size < 3 or i % 3 else f"1S{size - 2}M3D1I"
        if i % 13 == 5:
            lines.append(f"r{i}\t4\t*\t0\t0\t*\t*\t0\t0\t{seq}\t{qual}")
        else:
            tag = f"\tNM:i:{i % 400}" if i % 2 else ""
            lines.append(f"r{i}\t{r.choice((0, 16, 256, 2064))}\tT{r.randrange(9)}\t{r.randrange(1, 400)}\t{r.randrange(60)}\t{cigar}\t*\t0\t0\t{seq}\t{qual}{tag}")
    return refs, "\n".join(lines) + "\n"


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    refs, lines = sam(900)
    (folder / "a.sam").write_text(lines)
    whole = text.read_alignments(spark, str(folder / "a.sam"), keep_unmapped=True)
    bam.write_bam(whole.coalesce(1), refs, f"file://{folder}/one")
    bam.write_bam(whole.repartition(5), refs, str(folder / "many"))
    return folder, whole


def test_equals_the_text_in_any_number_of_pieces(spark, both):
    folder, whole = both
    (path,) = glob.glob(f"{folder}/one/part-*.bam")
    want, size = rows(whole), os.path.getsize(path)
    assert len(want) == 900 and size > 500_000
    for pieces in (1, 3, 7, 40):
        got = bam.read_bam(spark, path, keep_unmapped=True, piece=-(-size // pieces))
        assert got.rdd.getNumPartitions() >= 1 and rows(got) == want
    assert rows(bam.read_bam(spark, path, piece=70_001)) == rows(whole.where("cigar is not null"))
    assert rows(bam.read_bam(spark, f"file://{folder}/many", keep_unmapped=True)) == want
    assert len(glob.glob(f"{folder}/many/*")) == 5


def test_pieces_share_no_record_and_lose_none(both):
    (path,) = glob.glob(f"{both[0]}/one/part-*.bam")
    size = os.path.getsize(path)
    for step in (17_000, 65_000, 200_000):
        names = [r[0] for a in range(0, size, step) for r in bam.records_of(path, a, min(size, a + step), False)]
        assert len(names) == len(set(names)) == 900


def test_unmapped_records_are_counted(spark, both):
    folder, whole = both
    got = quality.flag_profile(bam.read_bam(spark, f"{folder}/one", keep_unmapped=True)).first()
    assert got.total == 900 and got.unmapped == sum(i % 13 == 5 for i in range(900)) and got.references == 9
    assert bam.read_bam(spark, f"{folder}/one").where("flag = 4").count() == 0


def test_broken_files(spark, both, tmp_path):
    (path,) = glob.glob(f"{both[0]}/one/part-*.bam")
    data = open(path, "rb").read()
    cut = tmp_path / "cut.bam"
    cut.write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="(?i)broken|block"):
        bam.read_bam(spark, str(cut)).count()
    n = bam.read_bam(spark, str(cut), keep_unmapped=True, skip_corrupt=True).count()
    assert 300 < n < 600
    bam.write_bam(both[1].limit(0), [("T1", 5)], str(tmp_path / "none"))
    assert not glob.glob(f"{tmp_path}/none/*.bam")
    assert both[1].where(F.col("read_id") == "r1").count() == 1


def test_a_header_of_many_references_is_copied_once(tmp_path, monkeypatch):
    """Written block by block from one buffer that does not shrink by copies of what is left, and read into one that grows."""
    import json

    import pyarrow as pa

    references = [(f"T{i}", i + 1) for i in range(40_000)]
    row = {"read_id": "r", "flag": 0, "transcript_id": "T7", "start": 1, "mapq": 3, "cigar": "4M", "seq": "ACGT", "qual": "IIII", "NM": None}
    writer = bam.BamWriter({"path": f"{tmp_path}/x", "references": json.dumps(references)})
    blocks, plain = [], bam._block
    monkeypatch.setattr(bam, "_block", lambda data: blocks.append(len(data)) or plain(data))
    writer.commit([writer.write([pa.RecordBatch.from_pylist([row] * 3)])])
    assert len(blocks) > 10 and set(blocks[:-1]) == {bam.BLOCK}
    [(path, size)] = bam.files_of(f"{tmp_path}/x")
    opened, header = [], bam.header_of
    monkeypatch.setattr(bam, "header_of", lambda p: opened.append(p) or header(p))
    reader = bam.BamReader({"path": path, "table": "references"})
    [batch] = reader.read(bam.Piece(path, 0, size))
    assert list(zip(*(c.to_pylist() for c in batch.columns))) == references and len(opened) == 1
    assert list(bam.records_of(path, 0, size, False)) == [tuple(row.values())] * 3


def test_files_name_their_own_references(spark, both, tmp_path):
    """No list of all references is made: a header has those of its file's records."""
    folder, whole = both
    records = whole.where("transcript_id is not null")
    bam.write_bam(records.repartition(4, "transcript_id"), None, str(tmp_path / "own"))
    files = bam.files_of(str(tmp_path / "own"))
    headers = [bam.header_of(p)[0] for p, _ in files]
    assert 1 < len(files) <= 4 and sorted(x for h in headers for x in h) == sam(900)[0]
    assert rows(bam.read_bam(spark, str(tmp_path / "own"), piece=20_000)) == rows(records.where("cigar is not null"))
    bam.write_bam(whole.coalesce(1), None, str(tmp_path / "all"))
    assert rows(bam.read_bam(spark, str(tmp_path / "all"), keep_unmapped=True, piece=50_000)) == rows(whole)
    with pytest.raises(Exception, match="no length of reference"):
        bam.write_bam(whole.withColumn("transcript_length", F.lit(None)), None, str(tmp_path / "none"))


def test_a_header_of_own_references_is_bounded(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bam, "NAMED", 100)
    monkeypatch.setattr(bam, "WAITING", 1000)
    row = {"read_id": "r", "flag": 0, "transcript_id": "T7", "start": 1, "mapq": 3, "cigar": "4M", "seq": "ACGT", "qual": "IIII", "NM": None, "transcript_length": 9}
    writer = bam.BamWriter({"path": f"{tmp_path}/x"})
    some = [row | {"transcript_id": f"T{k % 250}", "read_id": f"r{k}"} for k in range(1000)]
    writer.commit([writer.write([pa.RecordBatch.from_pylist(some)]), writer.write([])])
    files = bam.files_of(f"{tmp_path}/x")
    assert all(len(bam.header_of(p)[0]) <= 100 for p, _ in files) and len(files) == 10
    got = sorted(r[:3] for p, n in files for r in bam.records_of(p, 0, n, False))
    assert got == sorted((x["read_id"], 0, x["transcript_id"]) for x in some)
    with pytest.raises(ValueError, match="two lengths"):
        writer.write([pa.RecordBatch.from_pylist([row, row | {"transcript_length": 8}])])
