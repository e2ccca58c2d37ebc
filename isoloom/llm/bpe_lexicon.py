"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words are counted over all documents; the ``FREQUENT`` most frequent ones are merged once and compiled into a
minimal automaton over their bytes: equal suffixes share states, and each arc carries the number of lexicon
words that sort before it, so that the sum along a path is the word's place in a table of id sequences. The
file (arcs, outputs, id table) is sent to executors as a Spark file and memory-mapped there, so the workers of
a machine share its pages. Pieces with a word outside the lexicon are merged exactly by rank, in batches.

The rules are those of the vocabulary file, read with the tokenizers library where it defines text handling
(normalisation, splitting, byte symbols): composed and lower-cased text, white space dropped, words ended by a
suffix symbol. The file names no decoder, so decoding joins the ids' symbols with blanks. Strings of special
tokens take their own ids; texts that hold one go through the library whole, as do texts with the four control
characters that Python alone takes for white space.

Cases: null and empty texts give no ids and decode to an empty text; repeated rows are encoded alike, one
result row each; texts of any length are encoded whole; an empty table gives no rows and an empty lexicon;
only doc_id and text are read (``encode_columns`` keeps the other columns and gives new ones names that clash
with none).
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, freeing, put, scratch, stored, table

VOCABULARY = "word_bpe_49k.json"
#: Words in the lexicon, at most, out of those that occur twice or more; its file stays below 2 MB.
FREQUENT = 30_000
#: Pieces a worker remembers, and the size up to which it also remembers those made of others.
REMEMBERED, COMPOSED = 300_000, 80_000
#: Texts that are encoded together, and different pieces that are counted before their words are passed on.
TOGETHER, PIECES = 256, 150_000
CONTROL = "\x1c\x1d\x1e\x1f"


#: The word pattern of the vocabulary, for lower-case ASCII.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def _symbols() -> dict[int, int]:
    """Byte -> code point that stands for it: printable Latin-1 itself, others counted from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b if b in shown else 256 + k for b, k in zip(sorted(range(256), key=lambda b: (b in shown, b)), range(256))}


SYMBOLS = _symbols()


# ---- the automaton ---------------------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words with their ids, as one flat file.

    Words are added in sorted order; states that no later word can change are replaced by an equal registered
    state, so suffixes are shared while building and the automaton is never larger than its result plus one word.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # (accepts, [(byte, state)])

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append((node[0], list(node[1])))
        return registry[key]

    path: list[list] = [[False, []]]  # open states along the last word; arcs lead to settled states
    last = b""
    order = sorted(entries)

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))

    for word in order:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        close(shared)
        for _ in word[shared:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = settle(path[0])
    count = [0] * len(states)  # words accepted from a state; a state is settled after those it leads to
    for k, (accepts, arcs) in enumerate(states):
        count[k] = accepts + sum(count[t] for _, t in arcs)
    first, labels, targets, outputs = [0], bytearray(), [], []
    for accepts, arcs in states:
        before = int(accepts)
        for c, t in arcs:
            labels.append(c)
            targets.append(t)
            outputs.append(before)
            before += count[t]
        first.append(len(labels))
    ids = [entries[w] for w in order]
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [np.array(first, "<u4"), np.array(targets, "<u4"), np.array(outputs, "<u4"), np.array(starts, "<u4"), np.array([i for x in ids for i in x], "<u4"), np.frombuffer(bytes(labels), np.uint8), np.array([a for a, _ in states], np.uint8)]
    head = struct.pack("<II", 0x5844464C, root) + b"".join(struct.pack("<I", len(a)) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The memory-mapped file; ``ids`` gives a word's ids as bytes, or None."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, self.root, *sizes = struct.unpack_from("<9I", self.map)
        if magic != 0x5844464C:
            raise ValueError("not a lexicon file")
        at, view, parts = 36, memoryview(self.map), []
        for n, width in zip(sizes, (4, 4, 4, 4, 4, 1, 1)):
            piece = view[at : at + n * width]
            parts.append(piece.cast("I") if width == 4 else piece)
            if len(parts) == 5:
                self.ids_at = at
            if len(parts) == 6:
                self.labels_at = at
            at += n * width
        self.first, self.targets, self.outputs, self.starts, _, _, self.accepts = parts
        self.states = sizes[6]
        if sizes[4]:
            self.ids_at = 36 + 4 * sum(sizes[:4])
        self.labels_at = 36 + 4 * sum(sizes[:5])

    def ids(self, word: bytes) -> bytes | None:
        state, place, find, base = self.root, 0, self.map.find, self.labels_at
        first, targets, outputs = self.first, self.targets, self.outputs
        for k in range(len(word)):
            arc = find(word[k : k + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            arc -= base
            place += outputs[arc]
            state = targets[arc]
        if not self.accepts[state]:
            return None
        return self.map[self.ids_at + 4 * self.starts[place] : self.ids_at + 4 * self.starts[place + 1]]


# ---- the vocabulary --------------------------------------------------------------------------------------


class Vocabulary:
    """Symbols, ranks and text handling of a BPE file with word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = model["end_of_word_suffix"] or ""
        self.id_of: dict[str, int] = model["vocab"]
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        size = max(max(self.id_of.values()), *self.special.values()) + 1 if self.special else max(self.id_of.values()) + 1
        self.symbols: list[bytes] = [b""] * size
        for s, i in [*self.id_of.items(), *self.special.items()]:
            self.symbols[i] = s.encode()

    @cached_property
    def rank(self) -> dict[tuple[str, str], int]:
        """Place of each merge; only compiling a lexicon asks for it."""
        with open(self.path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        return {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(merges)}

    def words(self, piece: str) -> list[str]:
        """Words of a piece of text, spelled in byte symbols: by equal plain rules where these are certain to give
        what the library gives, else by the library's own normaliser and splitter."""
        if piece.isascii() and piece.isprintable():
            return PLAIN.findall(piece.lower())
        base = piece.rstrip(".,;:!?")
        if base.isalpha() and "\u03a3" not in base and is_normalized("NFC", base) and (small := base.lower()).isalpha():
            word = small.encode().decode("latin-1").translate(SYMBOLS)
            return [word] if len(base) == len(piece) else [word, piece[len(base) :]]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def merge(self, word: str) -> list[int]:
        """Exact byte-pair merging: the pair of lowest rank first, everywhere from the left, until none is left."""
        parts = [*word[:-1], word[-1] + self.suffix]
        rank = self.rank
        while len(parts) > 1:
            best = min((rank.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.id_of[p] for p in parts if p in self.id_of]

    def merged(self, texts: list[str]) -> list[bytes]:
        """ids by exact merging in the tokenizers library, for texts or pieces of them."""
        if not texts:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: bytes) -> bytes:
        """The text of little-endian ids, in UTF-8: their symbols between blanks."""
        return b" ".join(map(self.symbols.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Codec:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.seen: dict[str, bytes] = {}
        self.taken: Counter[str] = Counter()

    def _word(self, word: str) -> bytes:
        """ids of one word: from the lexicon, else merged by rank."""
        got = self.lexicon.ids(word.encode()) if self.lexicon is not None else None
        if got is not None:
            self.taken["lexicon"] += 1
            return got
        self.taken["merged"] += 1
        return np.array([t.id for t in self.vocabulary.library.model.tokenize(word)], "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """ids of new pieces, word by word; those of parts before closing punctuation come from remembered ones."""
        seen, parts = self.seen, {}
        for p in pieces:
            base = p.rstrip(".,;:!?")
            parts[p] = (base, p[len(base) :]) if base != p and base.isalpha() and base.lower().isalpha() else (p,)
        atoms = {q for v in parts.values() for q in v if q not in seen}
        got = {q: b"".join(map(self._word, self.vocabulary.words(q))) for q in atoms}
        if len(seen) + len(got) <= REMEMBERED:
            seen.update(got)
        made = {p: b"".join([got[q] if q in got else seen[q] for q in v]) for p, v in parts.items() if len(v) > 1}
        if len(seen) + len(made) <= COMPOSED:
            seen.update(made)
        return got | made

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """ids of whole texts, little-endian unsigned 32-bit. Each piece is looked up once; holes are filled after."""
        special, find = list(self.vocabulary.special), self.seen.get
        out: list[bytes] = [b""] * len(texts)
        whole: list[int] = []
        open_: list[tuple[int, list[str], list, list[int]]] = []
        missing: set[str] = set()
        for k, t in enumerate(texts):
            if not t:
                continue
            if any(s in t for s in special) or any(c in t for c in CONTROL):
                whole.append(k)
                continue
            pieces = t.split()
            ids = list(map(find, pieces))
            if None in ids:
                holes, at = [], -1
                try:
                    while True:
                        at = ids.index(None, at + 1)
                        holes.append(at)
                except ValueError:
                    pass
                missing.update([pieces[h] for h in holes])
                open_.append((k, pieces, ids, holes))
            else:
                out[k] = b"".join(ids)
        fresh = self._learn(missing) if missing else {}
        for k, pieces, ids, holes in open_:
            for h in holes:
                ids[h] = fresh[pieces[h]]
            out[k] = b"".join(ids)
        self.taken["texts"] += len(whole)
        for k, ids in zip(whole, self.vocabulary.merged([texts[k] for k in whole])):
            out[k] = ids
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_VOCABULARIES: dict[str, Vocabulary] = {}
_CODECS: dict[tuple[str, str], Codec] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def codec(path: str, lexicon: str) -> Codec:
    """One per worker and lexicon; older lexicons are let go."""
    if (path, lexicon) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, lexicon] = Codec(vocabulary(path), Lexicon(SparkFiles.get(lexicon)))
    return _CODECS[path, lexicon]


# ---- over tables -----------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): every word of all documents, counted on its partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for p, n in pieces.items():
                for w in vocabulary(path).words(p):
                    words[w] += n
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                if text := t.as_py():
                    pieces.update(text.lower().split())
                if len(pieces) > PIECES:
                    yield counted()
        if pieces:
            yield counted()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(freeing(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, frequent: int = FREQUENT) -> str:
    """Counts, compiles, and hands the file to the cluster; the name executors find it by."""
    counts = stored(word_counts(docs, path).where("n >= 2"), "word-counts")
    # a few hundred rows say from which count on enough words are left, so that no partition sends its own top list
    slices = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("s")).agg(F.count("*").alias("k")).collect()
    least, held = 0, 0
    for r in sorted(slices, key=lambda r: -r["s"]):
        least, held = r["s"], held + r["k"]
        if held >= frequent:
            break
    top = counts.where(F.floor(F.log2("n") * 8) >= least).orderBy(F.desc("n"), "word").limit(frequent).collect()
    voc = vocabulary(path)
    data = compile_lexicon({r["word"].encode(): voc.merge(r["word"]) for r in top})
    name = f"lexicon-{uuid.uuid4().hex}.mat"  # a name may be given to a cluster once
    spark = docs.sparkSession
    spark.sparkContext.addFile(put(scratch(spark, "lexicon"), name, data))
    return name


def encode(docs: DataFrame, path: str, lexicon: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lexicon)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for at in range(0, b.num_rows, TOGETHER):
                for ids in c.encode_all(b.column(1).slice(at, TOGETHER).to_pylist()):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(c.vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_columns(docs: DataFrame, path: str, lexicon: str, digest: bool = False) -> DataFrame:
    """docs with ids (array<int>) and decoded (string; with ``digest`` its SHA-256) behind its columns, under names
    that clash with none. Rows leave in small batches, so a worker never holds more than ``TOGETHER`` rows' ids."""

    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                ids = c.encode_all(b.column(at_text).to_pylist())
                text = [c.vocabulary.decode(x) for x in ids]
                out = [hashlib.sha256(x).hexdigest() for x in text] if digest else [x.decode() for x in text]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, flat, pa.array(out, pa.string())], names=[*b.schema.names, ids_name, text_name])

    ids_name, text_name = free_name(docs, "ids"), free_name(docs, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType())), T.StructField(text_name, T.StringType())])
    return docs.mapInArrow(freeing(run), schema)


def op5_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)
    return encode(docs, path, build_lexicon(docs, path))
