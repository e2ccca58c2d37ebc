"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file holds one data frame per document (its ids as little-endian unsigned 32-bit integers), then a skippable frame with the documents' ids and lengths, then a
skippable frame in the public seekable layout: per data frame the compressed size, the size and the low half
of the XXH64 of its content, then the number of frames, a descriptor and a magic number. A reader fetches the
tail, then only the frames of the documents it wants, and checks each frame before use.

Documents are range-partitioned by doc_id, so files follow each other in ascending order and each is written by
one task from a sorted stream. Files carry a fresh name per attempt and count only if the task's row in the
manifest does; a lost executor leaves an unreferenced file and nothing else. They are written through
pyarrow's file systems below the folder named in spark.checkpoint.dir, which every executor can reach.

Encoding works on pieces and remembers them. A blank between two other characters, a mark behind a letter and a lone
line feed between words always start a new pre-token of this vocabulary, so pieces are encoded independently; texts
with a blank between two white spaces, or with a special token's string, go to the tokenizers library whole.

Cases: a null text counts as empty and gives the end id alone; null doc_ids come first; repeated rows are
written as often as they come; an empty table writes no file and gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import opened, scratch, stored, table

END_ID = 0
#: Ids of a frame at most, unless one document has more: 1 gives every document a frame of its own.
FRAME_IDS = 1
#: Bytes that a reader fetches at once of neighbouring frames that it wants.
FETCH = 4 << 20
LEVEL = 3
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Descriptor: bit 7 says that the table has checksums.
DESCRIPTOR = 0x80
VOCABULARY = "byte_bpe_50k.json"
#: Pieces a worker remembers, and code points that are cut and looked up at once.
REMEMBERED, BATCH = 600_000, 4_000_000


#: White space beyond ASCII, as the vocabulary's pattern sees it; fixed values.
WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[\x09-\x0d\x1c-\x20{WIDE}]"
#: Letters and marks between which a pre-token always ends, whatever stands around them; fixed values.
LETTER, MARK = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


# ---- encoding --------------------------------------------------------------------------------------------


class Encoder:
    """ids of texts as bytes (little-endian unsigned 32-bit), as the tokenizers library gives them.

    Texts are cut into pieces by Arrow, a batch at a time; only a batch's different pieces become Python strings.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _values(self, pieces: list[str]) -> list[bytes]:
        """ids of different pieces; new ones are remembered while there is room."""
        values = list(map(self.seen.get, pieces))
        new = [p for p, v in zip(pieces, values) if v is None]
        if not new:
            return values
        fresh = self._library(new)
        self.seen.update(zip(new[: max(0, REMEMBERED - len(self.seen))], fresh))
        rest = iter(fresh)
        return [next(rest) if v is None else v for v in values]

    def _batch(self, texts: list[str]) -> list[bytes]:
        rows = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(rows, f"{SPACE} {SPACE}")
        for s in ("\0", *self.special):
            whole = pc.or_(whole, pc.match_substring(rows, s))
        # a lone line feed between words, then marks behind letters, then blanks
        cut = pc.replace_substring_regex(rows.filter(pc.invert(whole)), f"({LETTER}|{MARK})\n({LETTER})", "\\1\0\n\0\\2")
        cut = pc.replace_substring_regex(cut, f"({LETTER})({MARK})", "\\1\0\\2")
        parts = pc.split_pattern(pc.replace_substring(cut, " ", "\0 "), "\0")
        pieces = parts.flatten().dictionary_encode()
        values = self._values(pieces.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        first, piece = np.cumsum(size) - size, pieces.indices.to_numpy()
        n = size[piece]
        end = np.cumsum(n)
        ids = pool[np.repeat(first[piece] - (end - n), n) + np.arange(n.sum())].tobytes()
        bound = (4 * np.r_[0, end][parts.offsets.to_numpy()]).tolist()
        whole = whole.to_pylist()
        library, looked = iter(self._library([t for t, w in zip(texts, whole) if w])), iter(zip(bound, bound[1:]))
        return [next(library) if w else ids[slice(*next(looked))] for w in whole]

    def _segments(self, text: str) -> list[str]:
        """A long text cut before blanks between other characters, where encoding starts anew."""
        out, at = [], 0
        if not any(s in text for s in self.special):
            k = text.find(" ", BATCH)
            while k > 0:
                if text[k - 1].isspace() or text[k + 1 : k + 2].strip() == "":
                    k = text.find(" ", k + 1)
                    continue
                out.append(text[at:k])
                at, k = k, text.find(" ", k + BATCH)
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        batch, room = [], BATCH
        for t in texts:
            if len(t) > BATCH:
                out += self._batch(batch) if batch else []
                out.append(b"".join([self._batch([s])[0] for s in self._segments(t)]))
                batch, room = [], BATCH
                continue
            if len(t) > room:
                out += self._batch(batch)
                batch, room = [], BATCH
            batch.append(t)
            room -= len(t)
        return out + (self._batch(batch) if batch else [])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- the file format -------------------------------------------------------------------------------------


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Appends documents to a binary sink; ``close`` writes index and seek table."""

    def __init__(self, sink, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        self.sink, self.frame_ids = sink, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.part: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []  # (doc_id, ids); the order is the order of the ids
        self.nulls: list[int] = []
        self.per_frame: list[int] = []
        self.in_frame = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.in_frame and self.size + len(ids) > 4 * self.frame_ids:
            self._flush()
        if doc_id is None:
            self.nulls.append(len(self.docs))
        self.docs.append((doc_id or 0, len(ids) // 4))
        self.part.append(ids)
        self.size += len(ids)
        self.in_frame += 1

    def _flush(self) -> None:
        raw = b"".join(self.part)
        packed = self.zstd.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), _checksum(raw)))
        self.per_frame.append(self.in_frame)
        self.part, self.size, self.in_frame = [], 0, 0

    def close(self) -> None:
        if self.in_frame:
            self._flush()
        index = struct.pack("<III", len(self.docs), len(self.per_frame), len(self.nulls))
        index += np.array([d for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes()
        index += np.array(self.per_frame, "<u4").tobytes() + np.array(self.nulls, "<u4").tobytes()
        packed = self.zstd.compress(index)
        body = packed + struct.pack("<II", len(packed), _checksum(index))
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(seek)) + seek)


class Reader:
    """Random access: the tail first, then only the frames that are asked for."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.size()
        n, how, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or how != DESCRIPTOR:
            raise ValueError("no seek table at the end of the file")
        table_at = end - 9 - 12 * n - 8
        kind, size = struct.unpack("<II", self._at(table_at, 8))
        if kind != SKIPPABLE_TABLE or size != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(self._at(table_at + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.r_[0, np.cumsum(self.frames[:, 0])]
        packed, check = struct.unpack("<II", self._at(table_at - 8, 8))
        index = self.zstd.decompress(self._at(table_at - 8 - packed, packed))
        if _checksum(index) != check:
            raise ValueError("the document index is damaged")
        docs, parts, nulls = struct.unpack_from("<III", index)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 12)
        self.lengths = np.frombuffer(index, "<u8", docs, 12 + 8 * docs).astype(np.int64)
        self.per_frame = np.frombuffer(index, "<u4", parts, 12 + 16 * docs).astype(np.int64)
        self.nulls = set(np.frombuffer(index, "<u4", nulls, 12 + 16 * docs + 4 * parts).tolist())
        self.first = np.r_[0, np.cumsum(self.per_frame)]

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int, packed: bytes | None = None) -> bytes:
        """Content of a frame, checked; packed: its bytes in the file, if they were fetched already."""
        size, raw_size, check = (int(x) for x in self.frames[k])
        if packed is None:
            packed = self._at(int(self.offset[k]), size)
        raw = self.zstd.decompress(packed, max_output_size=max(raw_size, 1)) if raw_size else b""
        if len(raw) != raw_size or _checksum(raw) != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; with ``wanted``, only frames that hold one of these ids are fetched."""
        keep = None if wanted is None else np.isin(self.doc_ids, np.fromiter(wanted, np.int64))
        hit = np.ones(len(self.frames), bool) if keep is None else np.logical_or.reduceat(np.r_[keep, False], self.first[:-1]) & (self.per_frame > 0)
        k = 0
        while k < len(self.frames):
            if not hit[k]:
                k += 1
                continue
            end = k + 1  # neighbours are fetched together
            while end < len(self.frames) and hit[end] and self.offset[end + 1] - self.offset[k] <= FETCH:
                end += 1
            block, base = memoryview(self._at(int(self.offset[k]), int(self.offset[end] - self.offset[k]))), int(self.offset[k])
            for f in range(k, end):
                ids, at = np.frombuffer(self.frame(f, block[int(self.offset[f]) - base : int(self.offset[f + 1]) - base]), "<u4"), 0
                for d in range(int(self.first[f]), int(self.first[f + 1])):
                    n = int(self.lengths[d])
                    if keep is None or keep[d]:
                        yield (None if d in self.nulls else int(self.doc_ids[d])), ids[at : at + n]
                    at += n
            k = end


# ---- files of a whole table ------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, tokenizer_path: str) -> list[tuple[str, int]]:
    """Writes the table's documents in ascending doc_id order; the files' names and id counts, in that order.

    The driver gets one row per file, not per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        end = struct.pack("<I", END_ID)
        first, ids, name = None, 0, f"part-{uuid.uuid4().hex}.tok"
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                for doc_id, got in zip(part.column(0).to_pylist(), encoder(tokenizer_path).encode([t or "" for t in part.column(1).to_pylist()])):
                    if writer is None:
                        system, path = opened(folder)
                        system.create_dir(path, recursive=True)
                        sink = system.open_output_stream(f"{path}/{name}", compression=None)
                        writer, first = Writer(sink), doc_id
                    writer.add(doc_id, got + end)
                    ids += len(got) // 4 + 1
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([ids], pa.int64())], names=["name", "first", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = stored(dealt.mapInArrow(run, "name string, first long, ids long"), "manifest")
    return [(r["name"], r["ids"]) for r in manifest.orderBy(F.col("first").asc_nulls_first()).collect()]


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    starts = np.cumsum([0, *(n for _, n in files)]).tolist()
    rows = [(name, starts[k]) for k, (name, _) in enumerate(files)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, path = opened(folder)
                out: list[tuple] = []
                with system.open_input_file(f"{path}/{name}") as f:
                    for doc_id, ids in Reader(f).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame(rows, "name string, start long")
    if rows:
        names = names.repartition(len(rows), "name")
    return names.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY)))
