"""Alignments from BGZF-compressed BAM files, as a Python data source.

A file is cut at block boundaries into byte ranges; each task inflates its blocks, checks their CRC and decodes the
records that begin in its range (a record that runs over is completed from the following blocks). Local paths and
those that pyarrow's file systems open are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the end-of-file block.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SCHEMA = "read_name string, flag int, seq string, ref_id int, pos long, mapq int, cigar string, next_ref_id int, next_pos long, tlen int, bases string, bin int, qual string, tags map<string,string>"


def _open(path: str):
    system, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return system.open_input_file(where)


def block_size(head: bytes) -> int:
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a BGZF block")
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at < 12 + extra:
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC":
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    raise ValueError("a BGZF block has no size")


def blocks(f, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated content) of the blocks that begin in [at, end)."""
    while at < end:
        f.seek(at)
        size = block_size(f.read(18))
        f.seek(at)
        raw = f.read(size)
        head = 12 + struct.unpack_from("<H", raw, 10)[0]
        out = zlib.decompress(raw[head:-8], -15)
        check, n = struct.unpack_from("<II", raw, size - 8)
        if zlib.crc32(out) != check or len(out) != n:
            raise ValueError(f"the block at {at} is damaged")
        yield at, out
        at += size


def header(f) -> tuple[list[tuple[str, int]], int]:
    """Chromosomes (name, length) and the number of inflated bytes before the first record."""
    size = f.size()
    f.seek(max(0, size - len(EOF)))
    if f.read(len(EOF)) != EOF:
        raise ValueError("the file is truncated: it has no end block")
    data, stream = b"", blocks(f, 0, size)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            data += next(stream)[1]

    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    count, at = struct.unpack_from("<i", data, at)[0], at + 4
    out = []
    for _ in range(count):
        need(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + n)
        out.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    return out, at


#: Bytes and struct codes of the numeric tag types.
NUMBERS = {"c": (1, "b"), "C": (1, "B"), "s": (2, "h"), "S": (2, "H"), "i": (4, "i"), "I": (4, "I"), "f": (4, "f")}


def read_tags(b: bytes, at: int) -> dict[str, str]:
    """Tags of a record as text, each with its type in front ("i:5", "Z:text", "Bs:1,2"); the first of a name counts."""
    out: dict[str, str] = {}
    while at + 3 <= len(b):
        name, kind, at = b[at : at + 2].decode("ascii"), chr(b[at + 2]), at + 3
        if kind == "A":
            value, at = chr(b[at]), at + 1
        elif kind in NUMBERS:
            n, code = NUMBERS[kind]
            value, at = str(struct.unpack_from(f"<{code}", b, at)[0]), at + n
        elif kind in "ZH":
            end = b.index(0, at)
            value, at = b[at:end].decode(), end + 1
        elif kind == "B":
            sub, count, at = chr(b[at]), struct.unpack_from("<I", b, at + 1)[0], at + 5
            n, code = NUMBERS[sub]
            value, kind, at = ",".join(map(str, struct.unpack_from(f"<{count}{code}", b, at))), "B" + sub, at + n * count
        else:
            raise ValueError(f"the tag {name} has an unknown type {kind!r}")
        out.setdefault(name, f"{kind}:{value}")
    return out


def record(b: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, bin_, n_cigar, flag, n_seq, nref, npos, tlen = struct.unpack_from("<iiBBHHHiiii", b, 0)
    at = 32 + n_name
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", b, at))
    at += 4 * n_cigar
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in b[at : at + (n_seq + 1) // 2])[:n_seq]
    at += (n_seq + 1) // 2
    raw = b[at : at + n_seq]
    qual = "*" if not raw or raw[0] == 255 else bytes(min(q, 93) + 33 for q in raw).decode("ascii")
    return (b[32 : 31 + n_name].decode(), flag, names[ref] if ref >= 0 else None, ref, pos + 1, mapq, cigar, nref, npos + 1, tlen, seq, bin_, qual, read_tags(b, at + n_seq))


class Range(InputPartition):
    """Blocks [start, end) and the inflated offset in the first where its first record begins."""

    def __init__(self, start: int, end: int, skip: int):
        self.start, self.end, self.skip = start, end, skip


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Range]:
        """Cuts where a record begins: the record chain is walked once on the driver by its lengths only."""
        out: list[Range] = []
        with _open(self.path) as f:
            _, left = header(f)
            first, skip, left = None, 0, left
            size = f.size()
            tail = b""
            for at, data in blocks(f, 0, size):
                pos = 0
                if first is None:
                    if left >= len(data):
                        left -= len(data)
                        continue
                    first, skip, pos, left = at, left, left, 0
                elif left == 0 and not tail and at - first >= self.split:
                    out.append(Range(first, at, skip))
                    first, skip = at, 0
                else:
                    take = min(left, len(data))
                    left, pos = left - take, take
                if tail and not left:
                    data, pos, tail = tail + data, 0, b""
                while not left and pos < len(data):
                    if pos + 4 > len(data):
                        tail = data[pos:]
                        break
                    n = 4 + struct.unpack_from("<I", data, pos)[0]
                    left = max(0, pos + n - len(data))
                    pos = min(pos + n, len(data))
            if first is not None:
                out.append(Range(first, size, skip))
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        with _open(self.path) as f:
            names = [n for n, _ in header(f)[0]]
            data, skip = b"", part.skip
            for _, more in blocks(f, part.start, part.end):
                data = data + more[skip:] if data else more[skip:]  # what is left over is shorter than a record
                skip, at = 0, 0
                while at + 4 <= len(data):
                    n = struct.unpack_from("<I", data, at)[0]
                    if at + 4 + n > len(data):
                        break
                    yield record(data[at + 4 : at + 4 + n], names)
                    at += 4 + n
                data = data[at:]
            if data:
                raise ValueError("the file ends inside a record")


class BamSource(DataSource):
    """spark.dataSource.register(BamSource); spark.read.format("bam").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)
