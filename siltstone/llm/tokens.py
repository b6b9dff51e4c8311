"""Token ids by the ``tokenizers`` library, and their fixed-width binary files.

The encoder cuts texts at ASCII white space, which no token of the word-level
BPE crosses, and words of plain Latin letters further into letters, digits and
symbols, as the tokenizer's own pattern does. Cutting and looking up parts that
it has met is done for a megabyte at a time (``units``); a new part is handed to
the BPE model, any other word to the whole tokenizer. Results equal ``encode``
of the whole text.

A file holds blocks of ``BLOCK`` ids, each id in the minimum bits for the
vocabulary, then a footer with the documents' ids and starts and the byte
offset of every block, so any range of ids is read and unpacked with numpy from
the blocks it touches.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import units
from siltstone.llm.common import Batches, Scratch, map_arrow

TOKENIZER = "word_bpe_49k.json"
BLOCK = 4096
MAGIC = b"SILTTOK1"
#: Units that a worker keeps with their ids, about; and ids of these. Beyond that it starts afresh.
KEPT_UNITS, KEPT_IDS = 1_000_000, 8_000_000

_PLAIN = re.compile("[!-&(-~¡-įı-˿]+").fullmatch
_PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
_NOTHING = np.empty(0, np.int64)

# Classes of bytes: white space, letters, digits, symbols, and what only the tokenizer itself can judge.
_LETTER, _DIGIT, _SYMBOL, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:39] = _CLASS[40:127] = _SYMBOL
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[units.SPACE] = 0
#: Second bytes of two-byte Latin letters (first byte 0xC3), and those of upper case.
_SECOND, _UPPER_SECOND = np.zeros(256, bool), np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_UPPER_SECOND[0x80:0x9F] = _SECOND[0x80:0x9F]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for letters from U+0100."""
    out, extra = {}, 0x100
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


@dataclass
class Encoded:
    """Texts of a chunk: their ids, where each text ends, where words end and whether a sentence does, and whether the last text goes on in the next chunk."""

    ids: np.ndarray
    ends: np.ndarray
    word_ends: np.ndarray
    stops: np.ndarray
    goes_on: bool = False


class Encoder:
    """Whole texts to ids; one instance for each worker and file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 2**16 else "<u4")
        letters = _byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")
        self.table = units.KeyTable(21)
        self._clear()
        sample = "Plain Words, über-große naïve; x2=10% (ok)..."
        whole = self.tokenizer.encode(sample, add_special_tokens=False).ids
        #: Other tokenizers than word-level BPE go through ``encode`` alone.
        self.by_word = True
        self.by_word = self.ids(sample).tolist() == whole
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.others: dict[bytes, int] = {}
        self.n_units = self.n_ids = 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, self.dtype)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _keep(self, found: list[list[int]]) -> np.ndarray:
        """Store the ids of new units; returns their numbers."""
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.dtype, int(counts.sum()))
        first, last = self.n_units, self.n_units + len(found)
        while last > len(self.start):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while self.n_ids + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.start[first:last] = self.n_ids + np.cumsum(counts) - counts
        self.count[first:last] = counts
        self.pool[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_units, self.n_ids = last, self.n_ids + len(flat)
        return np.arange(first, last)

    def _word(self, word: bytes) -> list[int]:
        """A word that the byte classes don't settle."""
        text = word.decode()
        if not _PLAIN(text) or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        cut, letters = self.tokenizer.model.tokenize, self.letters
        mapped = ["".join([chr(letters[b]) for b in part.encode()]) for part in _PARTS(text.lower())]
        return [t.id for part in mapped for t in cut(part)]

    def _chunk(self, raw: bytes, ends: list[int], goes_on: bool) -> Encoded:
        if self.n_units > KEPT_UNITS or self.n_ids > KEPT_IDS:
            self._clear()
        padded = np.frombuffer(raw, np.uint8)
        codes = padded[: -units.KEY_BYTES]
        kind, low = _CLASS[codes], _LOWER[padded]
        two = np.flatnonzero(codes[:-1] == 0xC3)
        if len(two):
            second = codes[two + 1]
            two = two[_SECOND[second]]
            kind[two] = kind[two + 1] = _LETTER
            low[two + 1] += np.where(_UPPER_SECOND[codes[two + 1]], 32, 0).astype(np.uint8)
        if b"<|" in raw:
            at = np.flatnonzero((codes[:-1] == 60) & (codes[1:] == 124))
            kind[at] = _OTHER
        odd = kind == _OTHER
        if odd.any():  # the whole words that have such bytes
            filled = kind > 0
            edge = np.diff(filled.astype(np.int8), prepend=0)
            first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            so_far = np.concatenate([[0], np.cumsum(odd)])
            bad = so_far[last] > so_far[first]
            mark = np.zeros(len(kind) + 1, np.int8)
            mark[first[bad]] = 1
            mark[last[bad]] = -1
            inside = np.cumsum(mark[:-1]).astype(bool)
            kind[inside] = _OTHER
            low[: len(codes)][inside] = codes[inside]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        start = np.flatnonzero((kind > 0) & ((kind != before) | (kind == _DIGIT)))
        end = np.flatnonzero((kind[:-1] > 0) & ((kind[:-1] != kind[1:]) | (kind[:-1] == _DIGIT))) + 1
        size = end - start
        number = np.empty(len(start), np.int64)
        alone = (kind[start] == _OTHER) | (size > units.KEY_BYTES)
        easy = np.flatnonzero(~alone)
        k1, k2 = units.keys_of(low, start[easy], size[easy])
        number[easy] = self.table.find(k1, k2)
        new = np.flatnonzero(number[easy] < 0)
        if len(new):
            rep, same = units.distinct(k1[new], k2[new])
            mapped = self.letters[low].tobytes().decode("utf-32-le")
            cut = self.tokenizer.model.tokenize
            pick = easy[new[rep]]
            fresh = self._keep([[t.id for t in cut(mapped[a:b])] for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)])
            self.table.add(k1[new[rep]], k2[new[rep]], fresh)
            number[easy[new]] = fresh[same]
        for i in np.flatnonzero(alone).tolist():
            a, b = int(start[i]), int(end[i])
            word = raw[a:b] if kind[a] == _OTHER else low[a:b].tobytes()
            known = self.others.get(word)
            if known is None:
                known = self.others[word] = int(self._keep([self._word(word)])[0])
            number[i] = known
        count = self.count[number]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.repeat(self.start[number] - upto + count, count) + np.arange(total)]
        whole = kind[end] == 0  # units that end a word
        last = codes[end[whole] - 1]
        text_ends = np.concatenate([[0], upto])[np.searchsorted(start, ends)]
        return Encoded(ids, text_ends, upto[whole], (last == 46) | (last == 33) | (last == 63), goes_on)

    def chunks(self, texts: Iterable[bytes]) -> Iterator[Encoded]:
        """Ids of UTF-8 texts, in chunks of bounded size; a long text takes several."""
        if self.by_word:
            for raw, ends, goes_on in units.chunks(texts):
                yield self._chunk(raw, ends, goes_on)
        else:
            for text in texts:
                x = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype)
                yield Encoded(x, np.array([len(x)]), _NOTHING, np.empty(0, bool))

    def texts(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        wait: list[np.ndarray] = []
        for got in self.chunks(texts):
            if got.goes_on or wait:
                wait.append(got.ids)
                if not got.goes_on:
                    yield np.concatenate(wait)
                    wait = []
                continue
            at = 0
            for end in got.ends.tolist():
                yield got.ids[at:end]
                at = end

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.texts([(text or "").encode()]))


def raw_text(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


class PackedWriter:
    """Streams documents into one file; memory holds a block and 17 bytes for each document."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = [0]
        self.offsets: list[int] = [len(MAGIC)]
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        x = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(x) if last else len(x) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            data = pack(x[i : min(i + BLOCK, whole)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.n_waiting = [x[whole:]], len(x) - whole

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        footer = b"".join(
            [
                struct.pack("<IIQQ", self.bits, BLOCK, len(self.doc_ids), len(self.offsets)),
                np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
                null.tobytes(),
                np.array(self.starts, "<u8").tobytes(),
                np.array(self.offsets, "<u8").tobytes(),
            ]
        )
        self.out.write(footer)
        self.out.write(struct.pack("<Q", len(footer)) + MAGIC)


class PackedReader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        tail = source.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a packed token file, or cut off")
        (n,) = struct.unpack("<Q", tail[:8])
        footer = source.read_at(n, end - 16 - n)
        self.bits, self.block, docs, offsets = struct.unpack_from("<IIQQ", footer)
        at = struct.calcsize("<IIQQ")
        take = lambda kind, k: np.frombuffer(footer, kind, k, at)
        self.doc_ids = take("<i8", docs)
        at += 8 * docs
        self.null = take(np.uint8, docs).astype(bool)
        at += docs
        self.starts = take("<u8", docs + 1).astype(np.int64)
        at += 8 * (docs + 1)
        self.offsets = take("<u8", offsets).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        data = self.source.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        n = min(b * self.block, int(self.starts[-1])) - a * self.block
        if self.block * self.bits % 8 == 0:
            x = unpack(data, n, self.bits)
        else:  # blocks end at whole bytes
            step = -(-self.block * self.bits // 8)
            x = np.concatenate([unpack(data[i * step : (i + 1) * step], min(self.block, n - i * self.block), self.bits) for i in range(b - a)])
        return x[start - a * self.block : stop - a * self.block]

    def documents(self, span: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) in order, read in spans of about ``span`` ids."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + span, "right")) - 1)
            x = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                ids = x[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
                yield (None if self.null[k] else int(self.doc_ids[k])), int(self.starts[k]), ids
            i = j


def _write(out_dir: str, tokenizer: str, end_id: int):
    def run(batches: Batches) -> Batches:
        enc = Encoder.of(tokenizer)
        fs, root = file_system(out_dir)
        fs.create_dir(root)
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:06d}.bin"
        trial = f"{root}/.{name}-{uuid.uuid4().hex}"
        end = np.array([end_id], enc.dtype)
        with fs.open_output_stream(trial) as out:
            w = PackedWriter(out, width(max(enc.vocabulary, end_id + 1)))
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.texts(map(raw_text, batch.column(1))), strict=True):
                    w.add(doc_id, np.concatenate([ids, end]))
            w.close()
        fs.move(trial, f"{root}/{name}")  # a repeated task replaces its own file by the same bytes
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([part], pa.int32()), pa.array([len(w.doc_ids)]), pa.array([w.starts[-1]])],
            names=["file", "part", "n_docs", "n_ids"],
        )

    return run


def write_token_files(docs: DataFrame, out_dir: str, end_id: int, tokenizer: str, scratch: Scratch) -> DataFrame:
    """Write all texts to packed files in ascending ``doc_id`` order; returns the manifest ``file, part, n_docs, n_ids``."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(map_arrow(ordered, _write(out_dir, tokenizer, end_id), "file string, part int, n_docs long, n_ids long"), "manifest")


def _read_back(out_dir: str):
    def run(batches: Batches) -> Batches:
        fs, root = file_system(out_dir)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows = [(d, base + s, len(x), crc_of(x)) for d, s, x in PackedReader(source).documents()]
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(manifest: DataFrame, out_dir: str) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32`` of every document. Files are read by the executors, one to a task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.where("n_docs > 0").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.select("file", "base")
    return map_arrow(files.repartition(max(1, manifest.count())), _read_back(out_dir), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Encode, write, and read back all documents.

    Output, a row for each input row: ``doc_id, start, n_tokens, ids_crc32``.
    Null and empty texts have the end id alone. Null ``doc_id`` come first;
    rows that repeat a ``doc_id`` follow each other in the order of their
    texts. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    out_dir = scratch.path("files")
    manifest = write_token_files(docs, out_dir, end_id, tokenizer or default_tokenizer(), scratch)
    return read_token_files(manifest, out_dir)
