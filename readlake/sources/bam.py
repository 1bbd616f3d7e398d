"""Binary alignments as a Spark data source, read in pieces and written by many tasks.

A file is a chain of compressed blocks, and records run across them. A piece is a range of bytes: its
task looks for the first block that begins in it, then for the first record that begins in that
block, and reads on over the end of the range until its last record is whole. So pieces need
neither an index nor one another, and each record is read by the piece where its first byte's block begins.
"""

from __future__ import annotations

import json
import shutil
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from readlake.functions import reads as R

from .text import with_measures

#: Bytes of a piece, uncompressed bytes of a written block, records of a batch.
PIECE, BLOCK, BATCH = 32 << 20, 65_280, 10_000
#: Records that must follow one another from a place for it to be taken for the start of one.
CHAIN = 24
RECORDS = "read_id string, flag int, transcript_id string, start int, mapq int, cigar string, seq string, qual string, NM int"
REFERENCES = "transcript_id string, transcript_length int"
#: Records that are written with the lengths of their references.
OWN = f"{RECORDS}, transcript_length int"
# Fixed values of the format: the last block of a file, operations, and bases by their number.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
_FROM_HEX = str.maketrans(dict(zip("0123456789abcdef", BASES)))
_TO_HEX = str.maketrans(dict(zip(BASES + BASES.lower(), "0123456789abcdef" * 2)))
_QUALITY = bytes(min(126, q + 33) for q in range(256))
_RAW_QUALITY = bytes(max(0, c - 33) for c in range(256))
_WORD = struct.Struct("<i").unpack_from
#: References in the header of a file that names its own, and bytes of records that wait for it in memory.
NAMED, WAITING = 1 << 16, 32 << 20
#: Operations of a record up to this length are kept, as records of short ones repeat them.
SHORT = 64


class Broken(ValueError):
    """The file ends or makes no sense here."""


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a path or URL lies; the same in every task."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(URL or path, size) of a file, or of the files of a folder that aren't hidden."""
    fs, own = file_system(path)
    info = fs.get_file_info(own)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(own)] if path.endswith(own) else path.split("://")[0] + "://"
    found = fs.get_file_info(pafs.FileSelector(own))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size and f.base_name[0] not in "._")


def _block_size(head: bytes) -> int | None:
    """Size of the block whose first 18 bytes these are, or None if they are none's."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


class Blocks:
    """The uncompressed bytes of a file's blocks from one that begins at or after ``start``."""

    def __init__(self, path: str, start: int):
        fs, own = file_system(path)
        self.file = fs.open_input_file(own)
        self.size = self.file.size()
        self.at = self._first(start)

    def _first(self, start: int) -> int:
        """The first place from ``start`` where a block begins and another, or the end, follows it."""
        while start < self.size:
            window = self.file.read_at(min(2 << 16, self.size - start), start)
            k = window.find(b"\x1f\x8b\x08\x04")
            while k >= 0 and k + 18 <= len(window):
                size = _block_size(window[k : k + 18])
                after = start + k + (size or 0)
                if size and (after == self.size or _block_size(self.file.read_at(18, after))):
                    return start + k
                k = window.find(b"\x1f\x8b\x08\x04", k + 1)
            start += max(1, len(window) - 17)
        return self.size

    def next(self) -> tuple[int, bytes] | None:
        """(place of the block, its bytes), or None at the end."""
        if self.at >= self.size:
            return None
        size = _block_size(self.file.read_at(min(18, self.size - self.at), self.at))
        if not size or self.at + size > self.size:
            raise Broken(f"no block at {self.at}")
        data = self.file.read_at(size, self.at)
        try:
            out = zlib.decompress(data[18:-8], -15)
        except zlib.error as error:
            raise Broken(str(error)) from error
        if zlib.crc32(out) != struct.unpack_from("<I", data, size - 8)[0]:
            raise Broken(f"checksum of the block at {self.at}")
        place, self.at = self.at, self.at + size
        return place, out


def header_of(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """References (name, length), and where the records begin: a block's place, and the byte in it."""
    blocks, data, places = Blocks(path, 0), bytearray(), []

    def need(n: int) -> None:
        while len(data) < n:
            got = blocks.next()
            if got is None:
                raise Broken("the header ends early")
            places.append((len(data), got[0]))
            data.extend(got[1])

    need(12)
    if data[:4] != b"BAM\x01":
        raise Broken("no binary alignments")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    (n,) = struct.unpack_from("<i", data, at)
    at, references = at + 4, []
    for _ in range(n):
        if at + 4 > len(data):
            need(at + 4)
        after = at + 8 + _WORD(data, at)[0]
        if after > len(data):
            need(after)
        references.append((data[at + 4 : after - 5].decode(), _WORD(data, after - 4)[0]))
        at = after
    need(at)
    if at == len(data):
        return references, blocks.at, 0
    first, place = max(x for x in places if x[0] <= at)
    return references, place, at - first


def _plausible(data: bytes, at: int, references: Sequence[tuple[str, int]]) -> int | None:
    """Where the record at a place ends if it can be one, None if it can't, -1 if the data end in it."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, name, _, _, ops, _, length, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    body = 32 + name + 4 * ops + (length + 1) // 2 + length
    if size < body or name < 2 or length < 0 or not -1 <= ref < len(references) or not -1 <= mate < len(references) or pos < -1 or mate_pos < -1:
        return None
    if ref >= 0 and pos > references[ref][1]:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] or not all(32 < c < 127 for c in text[:-1])):
        return None
    return at + 4 + size if at + 4 + size <= len(data) else -1


def _first_record(data: bytes, bound: int, references: Sequence[tuple[str, int]], ended: bool) -> int | None:
    """The first place below ``bound`` where records begin that follow one another."""
    for start in range(bound):
        at, n = start, 0
        while at is not None and at >= 0 and at < len(data) and n < CHAIN:
            at, n = _plausible(data, at, references), n + 1
        if at is not None and (at == len(data) or n == CHAIN or (at == -1 and (n > 1 or not ended))):
            return start
    return None


@lru_cache(1 << 16)
def _named(raw: bytes) -> str:
    """The text of packed operations."""
    return "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack(f"<{len(raw) // 4}I", raw))


@lru_cache(1 << 16)
def _packed(cigar: str) -> bytes:
    """Operations of a text, packed."""
    ops, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | OPERATIONS.index(c))
            n = ""
    return struct.pack(f"<{len(ops)}I", *ops)


def decoded(data: bytes, at: int, references: Sequence[tuple[str, int]]) -> tuple:
    """Fields of the record at a place."""
    size, ref, pos, name, mapq, _, ops, flag, length = struct.unpack_from("<iiiBBHHHi", data, at)
    end, at = at + 4 + size, at + 36
    read_id = data[at : at + name - 1].decode()
    at += name
    raw = bytes(data[at : at + 4 * ops])
    cigar = (_named(raw) if len(raw) <= SHORT else _named.__wrapped__(raw)) or None
    at += 4 * ops
    seq = data[at : at + (length + 1) // 2].hex().translate(_FROM_HEX)[:length] or "*"
    at += (length + 1) // 2
    raw = data[at : at + length]
    qual = "*" if not raw or raw[0] == 255 else raw.translate(_QUALITY).decode()
    return read_id, flag, references[ref][0] if ref >= 0 else None, pos, mapq, cigar, seq, qual, _edits(data, at + length, end)


def _edits(data: bytes, at: int, end: int) -> int | None:
    """The number of the tag NM."""
    while at + 3 <= end:
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if tag == b"NM" and kind in _TAG_NUMBERS:
            return struct.unpack_from(f"<{_TAG_NUMBERS[kind]}", data, at)[0]
        if kind in "ZH":
            at = data.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _TAG_SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += _TAG_SIZES[kind]
    return None


def records_of(path: str, start: int, end: int, skip_corrupt: bool) -> Iterator[tuple]:
    """The records that begin in blocks that begin in [start, end)."""
    references, place, inside = header_of(path)
    if end <= place:
        return
    known = start <= place
    try:
        blocks = Blocks(path, max(start, place))
        data, at, bound = b"", inside if known else None, 0  # records begin below ``bound`` of the data
        while True:
            own = blocks.at < end
            got = blocks.next() if own or at is None or at < bound else None
            if got is not None:
                data += got[1]
                bound = len(data) if own else bound
            if at is None and (got is None or len(data) > 4 * BLOCK):
                at = _first_record(data, bound, references, got is None)
                if at is None:
                    return
            while at is not None and at < bound and at + 4 <= len(data) and at + 4 + struct.unpack_from("<i", data, at)[0] <= len(data):
                yield decoded(data, at, references)
                at += 4 + struct.unpack_from("<i", data, at)[0]
            if got is None:
                if at is not None and at < bound:
                    raise Broken("the file ends in a record")
                return
            if at is not None and at > 1 << 20:
                data, bound, at = data[at:], bound - at, 0
    except (Broken, struct.error, IndexError, ValueError):
        if not skip_corrupt:
            raise


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class BamSource(DataSource):
    """Format ``bam``. Options: ``table`` (``records`` or ``references``), ``pieceBytes``, ``skipCorrupt``; for
    writing ``references``, the names and lengths as JSON, without which records have a transcript_length."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return REFERENCES if self.options.get("table") == "references" else RECORDS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "records")
        self.piece = int(options.get("pieceBytes", PIECE))
        self.skip = options.get("skipCorrupt", "false").lower() == "true"

    def partitions(self) -> list[Piece]:
        found = files_of(self.path)
        if self.table == "references":
            return [Piece(p, 0, n) for p, n in found]
        return [Piece(p, a, min(n, a + self.piece)) for p, n in found for a in range(0, n, self.piece)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if self.table == "references":
            found = header_of(piece.path)[0]
            names, sizes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int32())], ["transcript_id", "transcript_length"])
            return
        kinds = [("read_id", pa.string()), ("flag", pa.int32()), ("transcript_id", pa.string()), ("start", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("NM", pa.int32())]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), kinds)], [n for n, _ in kinds])

        for record in records_of(piece.path, piece.start, piece.end, self.skip):
            held.append(record)
            if len(held) >= BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, names: Sequence[str]):
        self.names = names


class BamFile:
    """A file that is written. With ``references`` its header comes first; else it names the references of its own
    records, and these wait, compressed, until it is closed."""

    def __init__(self, fs: pafs.FileSystem, path: str, references: Sequence[tuple[str, int]] | None):
        self.out, self.named = fs.open_output_stream(path), dict(references or ())
        self.number = {name: k for k, name in enumerate(self.named)}
        self.waiting = tempfile.SpooledTemporaryFile(WAITING) if references is None else None
        self.data = bytearray() if references is None else bytearray(_header(references))

    def takes(self, row: dict) -> bool:
        """Whether the record's reference is in the header, or can come into it."""
        name = row["transcript_id"]
        if self.waiting is None or name is None:
            return True
        if name not in self.number:
            if len(self.number) >= NAMED:
                return False
            if row["transcript_length"] is None:
                raise ValueError(f"no length of reference {name}")
            self.number[name], self.named[name] = len(self.number), row["transcript_length"]
        if self.named[name] != row["transcript_length"]:
            raise ValueError(f"two lengths of reference {name}")
        return True

    def add(self, row: dict) -> None:
        self.data += encoded(row, self.number)
        if len(self.data) >= BLOCK:  # a header of many references is many blocks at once
            whole = len(self.data) - len(self.data) % BLOCK
            _blocks(self.data, whole, self.waiting or self.out)
            del self.data[:whole]

    def close(self) -> None:
        if self.waiting is not None:
            header = _header(list(self.named.items()))
            _blocks(header, len(header), self.out)
            self.waiting.seek(0)
            shutil.copyfileobj(self.waiting, self.out)
            self.waiting.close()
        if self.data:
            self.out.write(_block(bytes(self.data)))
        self.out.write(END)
        self.out.close()


class BamWriter(DataSourceArrowWriter):
    """Files for each partition that has rows, which appear when the whole write is committed: one, or where files
    name their own references one for each ``NAMED`` of these."""

    def __init__(self, options):
        self.path = options["path"]
        self.references = [tuple(x) for x in json.loads(options["references"])] if options.get("references") else None

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.path)
        names, own = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if own is None or not own.takes(row):
                    if own is not None:
                        own.close()
                    fs.create_dir(f"{folder}/_temporary", recursive=True)
                    names.append(f"{uuid.uuid4().hex}.bam")
                    own = BamFile(fs, f"{folder}/_temporary/{names[-1]}", self.references)
                    own.takes(row)
                own.add(row)
        if own is not None:
            own.close()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        fs, folder = file_system(self.path)
        for k, name in enumerate(name for m in messages if m is not None for name in m.names):
            fs.move(f"{folder}/_temporary/{name}", f"{folder}/part-{k:05}-{name}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        fs, folder = file_system(self.path)
        if fs.get_file_info(f"{folder}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/_temporary")


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2s2H", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


def _blocks(data: bytes | bytearray, end: int, out) -> None:
    """The first ``end`` bytes as blocks."""
    for at in range(0, end, BLOCK):
        out.write(_block(bytes(data[at : min(end, at + BLOCK)])))


def _header(references: Sequence[tuple[str, int]]) -> bytes:
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references).encode()
    names = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references)) + names


def _raw_quality(text: bytes) -> bytes:
    if text and min(text) < 33:
        raise ValueError("no quality")
    return text.translate(_RAW_QUALITY)


def encoded(row: dict, number: dict[str, int]) -> bytes:
    """A record of ``RECORDS``, as bytes."""
    name, seq = row["read_id"].encode() + b"\0", "" if row["seq"] in (None, "*") else row["seq"]
    cigar = "" if row["cigar"] in (None, "*") else row["cigar"]
    ops = _packed(cigar) if len(cigar) <= SHORT else _packed.__wrapped__(cigar)
    packed = bytes.fromhex((seq + "=" * (len(seq) % 2)).translate(_TO_HEX))
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else _raw_quality(row["qual"].encode("latin-1"))
    tag = b"" if row["NM"] is None else b"NMi" + struct.pack("<i", row["NM"])
    ref = number.get(row["transcript_id"], -1)
    core = struct.pack("<iiBBHHHiiii", ref, row["start"], len(name), row["mapq"] or 0, 0, len(ops) // 4, row["flag"], len(seq), -1, -1, 0)
    body = core + name + ops + packed + qual + tag
    return struct.pack("<i", len(body)) + body


def read_bam(spark: SparkSession, path: str, keep_unmapped: bool = False, skip_corrupt: bool = False, piece: int = PIECE) -> DataFrame:
    """What ``text.read_alignments`` gives of SAM text, of a binary file or a folder of such. A broken file
    is an error, or with ``skip_corrupt`` gives the records before the break."""
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam").option("pieceBytes", piece).option("skipCorrupt", str(skip_corrupt).lower())
    references = source.option("table", "references").load(path).groupBy("transcript_id").agg(F.max("transcript_length").alias("transcript_length"))
    records = spark.read.format("bam").option("pieceBytes", piece).option("skipCorrupt", str(skip_corrupt).lower()).option("table", "records").load(path)
    mapped = ~R.has_flag(F.col("flag"), R.UNMAPPED) & F.col("transcript_id").isNotNull() & F.col("cigar").isNotNull()
    return with_measures(records if keep_unmapped else records.where(mapped), references)


def write_bam(records: DataFrame, references: Sequence[tuple[str, int]] | None, path: str) -> None:
    """Records (columns of ``RECORDS``) as a folder of binary files, each with all references in its header. Without
    ``references`` the records have their ``transcript_length``, and each file names the references of its own
    records, so that no header, nor the driver, has to hold all of very many."""
    records.sparkSession.dataSource.register(BamSource)
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in (RECORDS if references is not None else OWN).split(", ")]
    writer = records.select(*columns).write.format("bam").mode("append")
    if references is not None:
        writer = writer.option("references", json.dumps([list(r) for r in references]))
    writer.save(path)
