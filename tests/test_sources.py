import gzip

import pytest
from pyspark.sql import Observation

from readlake.operators import density, quality
from readlake.sources import tables, text

GTF = """# comment
c\tsrc\ttranscript\t1\t100\t.\t+\t.\tgene_id "g"; transcript_id "T1";
c\tsrc\texon\t1\t100\t.\t+\t.\ttranscript_id "T1";
c\tsrc\tmRNA\t51\t300\t.\t-\t.\tID=transcript:T2;Parent=gene:g
c\tsrc\ttranscript\t5\t9\t.\t+\t.\ttranscript_id T3
"""


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_annotation(spark, tmp_path):
    path = put(tmp_path, "a.gtf", GTF)
    got = {r.transcript_id: (r.start, r.end, r.strand) for r in text.read_gtf(spark, path).collect()}
    assert got == {"T1": (1, 100, "+"), "T3": (5, 9, "+")}
    got = {r.transcript_id: (r.length, r.strand) for r in text.read_gtf(spark, path, "lenient").collect()}
    assert got == {"T1": (100, "+"), "T2": (250, "-"), "T3": (5, "+")}
    other = put(tmp_path, "b.gtf", "s1\tx\tgene\t1\t50\t.\t+\t.\tk\ns2\tx\tgene\tq\t50\t.\t+\t.\tk\n")
    assert {(r.transcript_id, r.length) for r in text.read_gtf(spark, other, "lenient").collect()} == {("s1", 50), ("s2", 1000)}
    doubled = put(tmp_path, "c.gtf", GTF + 'c\tsrc\ttranscript\t7\t20\t.\t-\t.\ttranscript_id "T1";\n')
    assert {r.transcript_id: r.start for r in text.read_gtf(spark, doubled).collect()}["T1"] == 7


def test_reads(spark, tmp_path):
    records = "".join(f"@r{i} x y\nACGT{'A' * (i % 5)}\n+\n@III{'J' * (i % 5)}\n" for i in range(500))
    plain = put(tmp_path, "a.fastq", records)
    packed = str(tmp_path / "b.fastq.gz")
    with gzip.open(packed, "wt") as f:
        f.write("@z\nAC\n+\nII\n")
    reads = text.read_fastq(spark, [plain, packed])
    rows = {r.read_id: r for r in reads.collect()}
    assert len(rows) == 501 and rows["r7"].seq == "ACGTAA" and rows["r7"].qual == "@IIIJJ" and rows["z"].qual == "II"
    out = str(tmp_path / "out")
    text.write_fastq(reads, out)
    assert {(r.read_id, r.seq, r.qual) for r in text.read_fastq(spark, out).collect()} == {(r.read_id, r.seq, r.qual) for r in rows.values()}


def test_sequences(spark, tmp_path):
    path = put(tmp_path, "a.fa", "".join(f">s{i} note\n{'ACGT' * 3}\n{'GG' * i}\n" for i in range(40)) + ">last\nA\n")
    rows = {r.seq_id: r for r in text.read_fasta(spark, path).collect()}
    assert len(rows) == 41 and rows["s3"].seq == "ACGT" * 3 + "GGGGGG" and rows["last"].length == 1
    lines = [r.value.split("\t") for r in text.annotation_from_sequences(text.read_fasta(spark, path)).collect()]
    assert len(lines) == 82 and {x[2] for x in lines} == {"transcript", "exon"} and all(x[3] == "1" for x in lines)
    assert text.concat_sequences(text.read_fasta(spark, path), text.read_fasta(spark, path)).count() == 82


SAM = """@SQ\tSN:T1\tLN:200
r1\t0\tT1\t11\t60\t10S50M5I45M5D10S\t*\t0\t0\t{0}\t{1}\tNM:i:21
r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII
r3\t16\tT1\t1\t7\t4M\t*\t0\t0\tAACG\tABCD
broken line
r3\t272\tT1\tx\t7\t4M\t*\t0\t0\tAACG\tABCD
""".format("A" * 120, "I" * 120)


def test_alignments(spark, tmp_path):
    al = text.read_alignments(spark, put(tmp_path, "a.sam", SAM))
    rows = {r.read_id: r for r in al.collect()}
    assert set(rows) == {"r1", "r3"}
    r = rows["r1"]
    assert (r.start, r.end, r.M, r.I, r.D, r.S, r.H, r.read_length, r.aligned_length, r.read_coverage, r.read_accuracy, r.transcript_length) == (10, 110, 95, 5, 5, 20, 0, 120, 100, 0.5, 0.8, 200)
    assert rows["r3"].read_accuracy is None
    back = {r.read_id: r for r in text.alignments_to_reads(al).collect()}
    assert (back["r3"].seq, back["r3"].qual) == ("CGTT", "DCBA") and back["r1"].seq == "A" * 120
    assert text.merge_alignments(al, al).count() == 4


def test_a_folder_of_alignment_files(spark, tmp_path):
    """Headers that repeat give every record once; unmapped ones on request; breaks are counted and kept."""
    put(tmp_path, "a.sam", SAM)
    put(tmp_path, "b.sam", SAM + "r4\tx\tT1\t1\t7\t4M\t*\t0\t0\tAACG\tABCD\nr5\t0\t*\t1\t7\t4M\t*\t0\t0\tAACG\tABCD\n")
    folder = str(tmp_path)
    assert sorted(r.read_id for r in text.read_alignments(spark, folder).collect()) == ["r1", "r1", "r3", "r3"]
    counts = Observation()
    every = text.read_alignments(spark, folder, keep_unmapped=True, counts=counts)
    assert every.count() == 6
    assert counts.get == {"lines": 12, "kept": 6, "unmapped": 0, "fields": 2, "flag": 1, "place": 2, "alignment": 1}
    flags = quality.flag_profile(every).first()
    assert (flags.total, flags.unmapped, flags.references) == (6, 2, 1)
    assert sorted(r.reason for r in text.rejected_records(spark, folder).collect()) == ["alignment", "fields", "fields", "flag", "place", "place"]
    put(tmp_path, "c.sam", "@SQ\tSN:T1\tLN:300\n")
    with pytest.raises(Exception, match="two lengths"):
        text.read_alignments(spark, folder).collect()


def test_files_split_into_blocks(spark, tmp_path):
    """Lines are numbered by file and block, however small the pieces that are read."""
    path = put(tmp_path, "a.fastq", "".join(f"@r{i}\n{'ACGT' * (i % 9 + 1)}\n+\n{'@III' * (i % 9 + 1)}\n" for i in range(3000)))
    fasta = put(tmp_path, "a.fa", "\n" + "".join(f">s{i} x\r\nAC\r\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = text.read_fastq(spark, path).collect()
        assert len(rows) == 3000 and all(r.seq == "ACGT" * (int(r.read_id[1:]) % 9 + 1) and len(r.qual) == len(r.seq) for r in rows)
        assert sorted((r.seq_id, r.seq) for r in text.read_fasta(spark, fasta).collect()) == sorted((f"s{i}", "AC") for i in range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_merging_leaves_out_what_cannot_be_read(spark, tmp_path):
    good = put(tmp_path, "a.sam", SAM)
    broken = tmp_path / "b.sam.gz"
    broken.write_bytes(gzip.compress(SAM.encode())[:60])
    merged = text.merge_alignment_files(spark, [good, str(broken), str(tmp_path / "none.sam")])
    assert text.record_count(merged).first()[0] >= 2
    with pytest.raises(ValueError):
        text.merge_alignment_files(spark, [str(tmp_path / "none.sam")])


def test_tables_and_saved_models(spark, tmp_path):
    assert tables.empty(spark, "tracking").count() == 0
    df = spark.createDataFrame([("b", "t", 3)], tables.SCHEMAS["expected"])
    for form in ("csv", "parquet"):
        tables.write_table(df, str(tmp_path / form), form)
        assert tables.read_table(spark, str(tmp_path / form), "expected", form).collect() == df.collect()
    shape, effect = density.preset_model(spark, "cdna", 50)
    tables.save_density_model(shape, effect, str(tmp_path / "model"))
    again = tables.load_density_model(spark, str(tmp_path / "model"))
    assert again[0].count() == 300 and {r.length_bin: r.effect for r in again[1].collect()}[4] == 4 / 1.2


def test_lines_are_split_once_and_counted_in_one_pass(spark, tmp_path):
    """The fields that filters look at are a column, not a split for each look; missing operations cost no search."""
    from pyspark.sql import functions as F

    from readlake.functions import reads as R

    path = str(tmp_path / "a.sam")
    open(path, "w").write("@SQ\tSN:T1\tLN:90\nr1\t0\tT1\t5\t7\t10M2D\t*\t0\t0\tACGT\tIIII\tNM:i:2\nr2\tx\tT1\t5\t7\t10M\t*\t0\t0\tA\tI\nr3\t0\tT1\n")
    rows = text.rejected_records(spark, path)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(r.reason for r in rows.collect()) == ["fields", "flag"]
    got = spark.createDataFrame([("10M2D3M",), ("",), (None,)], "c string").select(R.cigar_count(F.col("c"), "M"), R.cigar_count(F.col("c"), "I")).collect()
    assert [tuple(r) for r in got] == [(13, 0), (0, 0), (None, None)]
