"""Token ids in one compressed file a shard: a wavelet matrix (Information Systems 47, 2015).

A shard's ids are split into bit-planes, the highest bit first; each plane stably moves its zeros before its ones. With
counts of ones a machine word, a plane answers rank and select, and the planes together answer: the token at a place,
how often a token stands in a range, and where its k-th occurrence is, without holding the ids themselves.

File: magic, then length-prefixed sections: a JSON header, document ids, their validity, token counts, and each plane's
bits; every section is a zstandard frame.

Texts become ids piece by piece. A piece begins at a blank after something that is no blank; the tokenizer's pre-tokens
never cross such a place, so pieces encode alone as they do in their text, and each worker encodes a repeated piece once.
New pieces are put in rows, as they could stand in a text, because the tokenizer takes long for each text it is given.

Edge cases: null text counts as empty and leaves the end id alone; null ids come first; repeated rows each have an entry;
an empty table gives no file and an empty result; a text is held in one task's memory, and so is its shard.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm import bytescan
from flowloom.llm.common import put_file, scratch, store

MAGIC, END, SHARD_TOKENS, CACHE_PIECES = b"FLWM0001", 0, 1 << 21, 2_000_000
#: About the bytes of new pieces that the tokenizer gets as one text.
JOINED = 2048


class WaveletMatrix:
    """Access, rank and select over a sequence of unsigned numbers; arguments may be arrays."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n, self.bits = planes, n, len(planes)
        self.ones = [np.concatenate(([0], np.cumsum(np.bitwise_count(p), dtype=np.int64))) for p in planes]
        self.zeros = [n - int(c[-1]) for c in self.ones]

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        a, planes = tokens.astype(np.uint16 if bits <= 16 else np.uint32), []
        for shift in range(bits - 1, -1, -1):
            bit = (a >> a.dtype.type(shift)) & a.dtype.type(1) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            a = np.concatenate((a[~bit], a[bit]))
        return cls(planes, len(tokens))

    def _rank1(self, k: int, i):
        word, below = i >> 6, np.uint64(1) << (np.asarray(i) & 63).astype(np.uint64)
        padded = self.planes[k][np.minimum(word, max(len(self.planes[k]) - 1, 0))] if len(self.planes[k]) else np.uint64(0)
        return self.ones[k][word] + np.where((np.asarray(i) & 63) > 0, np.bitwise_count(padded & (below - np.uint64(1))), 0)

    def _select(self, k: int, j, one: bool):
        """The place of the j-th one or zero (from 0) of a plane."""
        runs = self.ones[k] if one else np.arange(len(self.ones[k]), dtype=np.int64) * 64 - self.ones[k]
        word = np.searchsorted(runs, j, "right") - 1
        inside = np.unpackbits((self.planes[k][word] if one else ~self.planes[k][word]).reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")
        return word * 64 + np.argmax(np.cumsum(inside, axis=1) == (j - runs[word] + 1)[:, None], axis=1)

    def access(self, i) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        out = np.zeros(i.shape, np.int64)
        for k in range(self.bits):
            bit = (self.planes[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0
            ones = self._rank1(k, i)
            out = out << 1 | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = int(self._rank1(k, lo)), int(self._rank1(k, hi))
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often token stands in places lo to hi, hi excluded."""
        if token < 0 or token >> self.bits:
            return 0
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """All places of token, ascending."""
        if token < 0 or token >> self.bits or not self.n:
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(token, 0, self.n), dtype=np.int64)
        for k in range(self.bits - 1, -1, -1):
            if len(at):
                one = bool(token >> (self.bits - 1 - k) & 1)
                at = self._select(k, at - self.zeros[k] if one else at, one)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[k].view(np.uint8), bitorder="little", count=self.n).view(bool)
            out, z = np.empty(self.n, kind), self.zeros[k]
            out[~bit] = a[:z]
            out[bit] = a[z:] | kind(1 << (self.bits - 1 - k))
            a = out
        return a


def pack(ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, tokens: np.ndarray, bits: int) -> bytes:
    """A shard as the bytes of its file."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = WaveletMatrix.build(tokens, bits).planes
    head = json.dumps({"docs": len(ids), "tokens": len(tokens), "bits": bits}).encode()
    out = [MAGIC]
    for part in (head, ids.astype("<i8").tobytes(), np.packbits(valid).tobytes(), counts.astype("<i8").tobytes(), *(p.astype("<u8").tobytes() for p in planes)):
        frame = squeeze(part)
        out += [len(frame).to_bytes(8, "little"), frame]
    return b"".join(out)


class Shard:
    """A shard read back: document ids, where each document begins, and the wavelet matrix of the tokens."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        at, parts, unpack = 8, [], zstandard.ZstdDecompressor().decompress
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(unpack(data[at + 8 : at + 8 + n]))
            at += 8 + n
        head = json.loads(parts[0])
        self.ids = np.frombuffer(parts[1], "<i8")
        self.valid = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=head["docs"]).astype(bool)
        self.counts = np.frombuffer(parts[3], "<i8")
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.matrix = WaveletMatrix([np.frombuffer(p, "<u8") for p in parts[4:]], head["tokens"])

    def document(self, k: int) -> np.ndarray:
        return self.matrix.access(np.arange(self.starts[k], self.starts[k + 1]))


class PieceEncoder:
    """Encodes texts by their pieces; pieces seen before come from a cache of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, int(self.tokenizer.get_vocab_size() - 1).bit_length())
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # that a token stands for, where each of its characters is a byte
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self._clear()

    def _clear(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and their places
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.spelt, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)  # the pieces' own bytes, compared at every hit

    @staticmethod
    def _starts(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where the pieces of a segment begin: at its cuts, and at blanks after what is certainly no blank."""
        blank = bytescan.is_blank(b)
        solid = ~blank & ~((b >= 0x1C) & (b <= 0x1F))
        solid[1:] &= ~((b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0)))
        solid[2:] &= ~((b[:-2] >= 0xE1) & (b[:-2] <= 0xE3) & ((b[1:-1] == 0x80) | (b[1:-1] == 0x81) | (b[1:-1] == 0x9A)))
        begins = np.zeros(len(b), bool)
        begins[1:] = blank[1:] & solid[:-1]
        begins[0], begins[cuts] = True, True
        return np.flatnonzero(begins)

    def _coded(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of pieces, their numbers of tokens, and the pieces' bytes.

        Pieces go to the tokenizer in rows: one may follow another wherever a piece would begin at that place of a text. The
        tokens' bytes tell the pieces apart; should any piece not end with a token, all are encoded alone."""
        size = ends - starts
        upto = np.cumsum(size)
        begin = upto - size
        text = b[np.arange(upto[-1]) + np.repeat(starts - begin, size)]
        raw, free = text.tobytes(), np.zeros(len(text), bool)
        free[self._starts(text, begin[:0])] = True
        alone = ~free[begin]
        alone[0] = True
        alone[1:] |= begin[1:] // JOINED != begin[:-1] // JOINED

        def encoded(begin: np.ndarray) -> list[list[int]]:
            rows = [raw[i:j].decode() for i, j in itertools.pairwise([*begin.tolist(), len(raw)])]
            return [x.ids for x in self.tokenizer.encode_batch(rows, add_special_tokens=False)]

        tokens = np.fromiter(itertools.chain.from_iterable(encoded(begin[alone])), np.uint32)
        end = np.cumsum(self.bytes[tokens])
        count = np.searchsorted(end, upto, "right")
        if len(end) and end[-1] == upto[-1] and count[0] and np.array_equal(end[count - 1], upto):
            return tokens, np.diff(count, prepend=0), text
        coded = encoded(begin)
        return np.fromiter(itertools.chain.from_iterable(coded), np.uint32), np.array([len(x) for x in coded], np.int64), text

    def _segment(self, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a segment, its pieces' starts and their numbers of tokens."""
        starts = self._starts(b, cuts)
        ends = np.concatenate((starts[1:], [len(b)]))
        kinds, first, which = bytescan.kinds(b, starts, ends)
        if len(self.begin) + len(kinds) > CACHE_PIECES:
            self._clear()
        s, e = starts[first], ends[first]
        at = np.searchsorted(self.known, kinds)
        slot, taken = np.full(len(kinds), -1, np.int64), np.zeros(len(kinds), bool)
        if len(self.known):
            place = np.minimum(at, len(self.known) - 1)
            taken = self.known[place] == kinds
            met = np.flatnonzero(taken)
            own = self.slots[place[met]]
            same = bytescan.same_spans(b, s[met], e[met], self.text, self.spelt[own], self.spelt[own + 1])
            slot[met[same]] = own[same]
        new = np.flatnonzero(slot < 0)
        if len(new):
            tokens, n, text = self._coded(b, s[new], e[new])
            slot[new] = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(new))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(n)))
            self.flat = np.concatenate((self.flat, tokens))
            self.spelt = np.concatenate((self.spelt, self.spelt[-1] + np.cumsum(e[new] - s[new])))
            self.text = np.concatenate((self.text, text))
            free = new[~taken[new]]  # of pieces with one hash the cache finds the first alone
            free = free[np.unique(kinds[free], return_index=True)[1]]
            self.known, self.slots = np.insert(self.known, at[free], kinds[free]), np.insert(self.slots, at[free], slot[free].astype(np.int32))
        slot = slot[which]
        size = self.begin[slot + 1] - self.begin[slot]
        upto = np.cumsum(size)
        return self.flat[np.arange(upto[-1]) + np.repeat(self.begin[slot] - upto + size, size)], starts, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after another, and each text's number of them."""
        b, offsets = bytescan.text_bytes(texts)
        tokens, counts = [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in self._safe_segments(b, offsets):
            found, starts, size = self._segment(b[lo:hi], bytescan.inner_cuts(offsets, lo, hi))
            tokens.append(found)
            np.add.at(counts, np.searchsorted(offsets, starts + lo, "right") - 1, size)
        return np.concatenate(tokens), counts

    def _safe_segments(self, b: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Segments that end with a text or before a piece, and so cut no piece."""
        lo = 0
        for _, hi in bytescan.segments(b, offsets):
            if hi < len(b) and offsets[np.searchsorted(offsets, hi)] != hi:
                inside = self._starts(b[lo:hi], bytescan.inner_cuts(offsets, lo, hi))
                if len(inside) == 1:
                    continue  # the piece goes on
                hi = lo + int(inside[-1])
            yield lo, hi
            lo = hi
        if lo < len(b):
            yield lo, len(b)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _writer(folder: str, tokenizer: str, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, valid, counts, tokens, held, seq = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            name = f"{part:06d}-{seq:06d}.wm"
            data = [np.concatenate(x) for x in (ids, valid, counts, tokens)]
            put_file(folder, name, pack(*data, code.bits))
            for x in (ids, valid, counts, tokens):
                x.clear()
            out = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "docs": [len(data[0])], "tokens": [held]})
            held, seq = 0, seq + 1
            return out

        for batch in batches:
            for lo in range(0, len(batch), 256):
                own = batch.slice(lo, 256)
                found, n = code.encode(own.column(1))
                ended = np.insert(found, np.cumsum(n), END)
                ids.append(own.column(0).fill_null(0).to_numpy())
                valid.append(np.asarray(own.column(0).is_valid()))
                counts.append(n + 1)
                tokens.append(ended)
                held += len(ended)
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    return write


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs' tokens to folder in ascending order of a whole-number id; returns the manifest (file, part, seq, docs, tokens)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return store(placed.mapInArrow(_writer(folder, tokenizer, shard_tokens), "file string, part long, seq long, docs long, tokens long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            shard = Shard(content.as_py())
            all_ids = shard.matrix.all().astype("<u4")
            crc = [zlib.crc32(all_ids[a:b].tobytes()) for a, b in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"file": [file.as_py()] * len(crc), "doc_id": pa.array(shard.ids, mask=~shard.valid), "offset": shard.starts[:-1], "n_tokens": shard.counts, "ids_crc32": pa.array(crc, pa.int64())})


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files that the manifest lists."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.wm").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = files.mapInArrow(_reader, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", before(Window.orderBy("part"), "n").alias("part_base"))  # a row a partition
    bases = manifest.join(parts, "part").select("file", (F.col("part_base") + before(Window.partitionBy("part").orderBy("seq"), "tokens")).alias("base"))
    bases = store(bases, "bases")
    return docs.join(bases, "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write docs as shards into the shared folder and read every document back."""
    spark = docs.sparkSession
    folder = f"{scratch(spark, 'tokens')}"
    manifest = write_shards(docs, folder, tokenizer, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest)
