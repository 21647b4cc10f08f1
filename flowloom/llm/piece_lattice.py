"""SentencePiece encoding and decoding as a relational lattice.

A text becomes words: it is cut wherever no piece of the model holds the two bytes on either side next to each other (at
blanks, at most punctuation and figures). No edge of the lattice crosses such a place, so words encode alone. For each
distinct word its substrings up to the longest piece are exploded and equi-joined to the piece table; the edges found are
grouped by word, and a higher-order aggregate folds them into the word's ids.

The fold. For a unigram model it is Viterbi (best sum of scores). A BPE model's scores are merge priorities, not
log-probabilities: their best sum isn't what the library returns. For such a model the fold runs over the same edges, but
each step applies the best edge that spans exactly two of the current symbols, as BPE does. The model file says which. The
fold's state is a bit mask of symbol boundaries; words of more than 61 characters fold in numpy by the same rules, from the
same edges. All edges of one such word meet in one task: about 100 bytes a character of a word that nothing cuts.

Joining words back to texts. A dictionary of words that recur in a bounded sample of texts goes to every executor; it only
saves work. Texts are never shuffled: rows are known by their file and place, and the words that the dictionary lacks are
joined to their ids as (rows' place, word) and written as one patch file for every 65,536 rows into the shared folder, in
parts of 4,096 rows. The tasks that encode read the parts of their own rows. Words are looked up by hash and compared byte
by byte, or by their bytes; a word without ids is an error.

Edge cases: null text counts as empty and has no ids; characters outside the vocabulary become byte ids; repeated rows are
encoded alike; an empty table gives an empty table; further columns pass through, whatever their names; docs that don't
come straight from files are stored first.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm import bytescan
from flowloom.llm.common import drop, fresh, let, put_file, scratch, settings, store

SPACE, SHORT = "▁", 61
#: Order and id of a character that is no piece; both have 20 bits.
_NONE = (1 << 20) - 1
#: Most words of the dictionary that goes to every executor, and about how many texts it comes from (those whose place's hash is divisible by a number).
FREQUENT_WORDS, SAMPLE_TEXTS = 500_000, 20_000
#: Rows of a file that share a patch file, and a part of it.
GROUP_ROWS, PART_ROWS = 65_536, 4_096
#: Words whose edges one task groups.
WORDS_A_PART = 20_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message; four- and eight-byte numbers stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


def _is_unigram(path: str) -> bool:
    """Whether a model is of the unigram kind: its trainer's settings (field 2) give the kind in field 3, and 1, unigram, where it is missing."""
    with open(path, "rb") as file:
        settings = [v for k, v in _fields(file.read()) if k == 2]
    kind = next((v for x in settings for k, v in _fields(x) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError("neither a unigram nor a BPE model")
    return kind == 1


class Pieces:
    """The pieces of a model file: NORMAL pieces with scores, ids of bytes, where words are cut, and every id's bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.vocab_size())
        self.unigram = _is_unigram(path)
        self.normal = [(p.id_to_piece(i), i, float(p.get_score(i))) for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.longest = max(len(x[0]) for x in self.normal)
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        back = {i: x.replace(SPACE, " ").encode() for x, i, _ in self.normal} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.surface = [back.get(i, b"") for i in ids]

    def cuts(self) -> np.ndarray:
        """[byte, next byte]: whether a text is cut between the two. Never inside a character."""
        cut = np.ones((256, 256), bool)
        cut[:, 0x80:0xC0] = False
        for piece, _, _ in self.normal:
            b = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            cut[b[:-1], b[1:]] = False
        return cut

    def table(self, spark: SparkSession) -> DataFrame:
        rows = sorted(self.normal, key=lambda x: (-x[2], x[1]))
        if len(rows) >= _NONE or self.normal[-1][1] >= _NONE:
            raise ValueError("too many pieces")
        return spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "piece string, id int, score double, order int")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _packed(order: Column, s: Column, e: Column, id: Column) -> Column:
    """An edge as one number that sorts by order, then place: 20 bits of order, 6 each of s and e, 20 of id."""
    return F.call_function("shiftleft", order.cast("long"), F.lit(32)).bitwiseOR(s.cast("long") * (1 << 26) + e * (1 << 20) + id)


def _unpacked(x: Column) -> tuple[Column, Column, Column]:
    """s, e and id of a packed edge."""
    field = lambda by, bits: F.shiftright(x, by).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    return field(26, 6), field(20, 6), field(0, 20)


def _fold_merges(edges: Column, n: Column) -> Column:
    """The boundary mask that BPE merging leaves, from packed edges in order of rank and place."""

    def span(x: Column) -> Column:
        s, e, _ = _unpacked(x)
        return F.struct((_bit(s) + _bit(e)).alias("ends"), (_bit(e) - 2 * _bit(s)).alias("inner"))

    spans = F.transform(F.filter(edges, lambda x: _unpacked(x)[1] - _unpacked(x)[0] > 1), span)
    step = lambda spans: lambda mask, _: let(F.get(F.filter(spans, lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1)), F.lit(0)), lambda x: F.when(x.isNull(), mask).otherwise(mask.bitwiseAND(F.bitwise_not(x["inner"]))))
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return let(spans, lambda x: F.aggregate(steps, 2 * _bit(n) - 1, step(x)))


def _fold_viterbi(edges: Column, n: Column) -> Column:
    """The boundary mask of the path with the best sum of scores, from edges (rank, x), x packed."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("mask")))

    def step(best: Column, e: Column) -> Column:
        def longer(x: Column) -> Column:
            at = best[_unpacked(x["x"])[0]]
            return F.struct((at["cost"] + x["rank"]).alias("cost"), at["mask"].bitwiseOR(_bit(e)).alias("mask"))

        return F.concat(best, F.array(F.array_min(F.transform(F.filter(edges, lambda x: _unpacked(x["x"])[1] == e), longer))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)["mask"]


def _merge_long(rank: np.ndarray) -> list[tuple[int, int]]:
    """Spans that BPE merging leaves of a long word, by a heap over its edges. rank[k, s]: that of the edge from s to s + k + 1, infinite without one."""
    size = rank.shape[1]
    end, before = list(range(1, size + 1)), list(range(-1, size))  # of the symbol that begins at each place
    heap = [(float(rank[1, s]), s, s + 1, s + 2) for s in np.flatnonzero(np.isfinite(rank[1])).tolist()] if len(rank) > 1 else []
    heapq.heapify(heap)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if end[s] != m or m >= size or end[m] != e:
            continue
        end[s], end[m] = e, -1
        if e < size:
            before[e] = s
        for a, b in ((before[s], s), (s, e)):
            if a >= 0 and b < size and end[b] - a <= len(rank) and np.isfinite(rank[end[b] - a - 1, a]):
                heapq.heappush(heap, (float(rank[end[b] - a - 1, a]), a, b, end[b]))
    out, s = [], 0
    while s < size:
        out.append((s, end[s]))
        s = end[s]
    return out


def _viterbi_long(rank: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the path with the least sum of ranks."""
    size = rank.shape[1]
    cost, from_ = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
    cost[0] = 0
    for e in range(1, size + 1):
        s = np.arange(max(0, e - len(rank)), e)
        own = cost[s] + rank[e - s - 1, s]
        k = int(np.argmin(own))
        cost[e], from_[e] = own[k], s[k]
    out, e = [], size
    while e > 0:
        out.append((int(from_[e]), e))
        e = int(from_[e])
    return out[::-1]


def _fold_long(longest: int, unigram: bool):
    """The ids of one long word from its edges (key, n, s, e, rank, ids), by the same rules as the short ones."""

    def fold(edges: pa.Table) -> pa.Table:
        edges = edges.combine_chunks()
        s, e = edges["s"].to_numpy(), edges["e"].to_numpy()
        rank, place = np.full((longest, edges["n"][0].as_py()), np.inf), np.zeros((longest, edges["n"][0].as_py()), np.int64)
        rank[e - s - 1, s], place[e - s - 1, s] = edges["rank"].to_numpy(), np.arange(len(s))
        path = np.array((_viterbi_long if unigram else _merge_long)(rank), np.int64)
        found = edges["ids"].combine_chunks() if isinstance(edges["ids"], pa.ChunkedArray) else edges["ids"]
        ids = found.take(pa.array(place[path[:, 1] - path[:, 0] - 1, path[:, 0]])).flatten()
        return pa.table({"key": edges["key"][:1], "ids": pa.array([ids], pa.list_(pa.int32()))})

    return fold


def _substrings(longest: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for lo in range(0, len(word), 4096):
                    found = [(s, s + k, word[s : s + k]) for s in range(lo, min(lo + 4096, len(word))) for k in range(1, min(longest, len(word) - s) + 1)]
                    s, e, sub = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(s), pa.int64()), "n": pa.array([len(word)] * len(s), pa.int32()), "s": pa.array(s, pa.int32()), "e": pa.array(e, pa.int32()), "sub": sub})

    return explode


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of a table of distinct words (word), whose blanks are SPACE. The piece table is broadcast: it is as large as the vocabulary."""
    n = F.length("word")
    table = F.broadcast(pieces.table(words.sparkSession))
    long = store(words.where(n > SHORT).withColumn("key", F.monotonically_increasing_id()), "long")
    words = words.where(n <= SHORT).repartition(max(1, -(-words.count() // WORDS_A_PART)), "word")
    most = F.least(F.lit(pieces.longest), n)
    spots = words.select("word", n.alias("n"), most.alias("most"), F.explode(F.sequence(F.lit(0), n * most - 1)).alias("i"))
    spots = spots.select("word", "n", F.floor(F.col("i") / F.col("most")).cast("int").alias("s"), (F.col("i") % F.col("most") + 1).alias("k")).where("s + k <= n")
    short = spots.select("word", "n", "s", (F.col("s") + F.col("k")).alias("e"), F.substring(F.col("word"), F.col("s") + 1, F.col("k")).alias("sub"))

    def edges(found: DataFrame, *more: str) -> DataFrame:
        """The substrings that are pieces, and single characters whether or not they are."""
        met = found.join(table, F.col("sub") == F.col("piece"), "left").where("id IS NOT NULL OR e = s + 1")
        return met.select(*more, "n", "s", "e", F.coalesce(-F.col("score"), F.lit(1e9)).alias("rank"), F.coalesce("order", F.lit(_NONE)).alias("order"), F.coalesce("id", F.lit(_NONE)).alias("id"))

    codes = F.array(*map(F.lit, pieces.bytes))

    def spelt(c: Column) -> Column:
        """The ids of a character's bytes."""
        raw = F.hex(c.cast("binary"))
        return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: codes[F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int")])

    def ids(word: Column, packed: Column, mask: Column) -> Column:
        def on_path(x: Column) -> Column:
            s, e, _ = _unpacked(x)
            return mask.bitwiseAND(2 * _bit(e) - _bit(s)) == _bit(s) + _bit(e)

        def placed(x: Column) -> Column:
            s, _, id = _unpacked(x)
            return F.struct(s.alias("s"), id.alias("id"))

        path = F.array_sort(F.transform(F.filter(packed, on_path), placed))
        known = lambda p: F.transform(p, lambda x: x["id"])
        mixed = lambda p: F.flatten(F.transform(p, lambda x: F.when(x["id"] == _NONE, spelt(F.substring(word, x["s"] + 1, F.lit(1)))).otherwise(F.array(x["id"]))))
        return let(path, lambda p: F.when(F.exists(p, lambda x: x["id"] == _NONE), mixed(p)).otherwise(known(p)))

    edge = _packed(F.col("order"), F.col("s"), F.col("e"), F.col("id"))
    if pieces.unigram:
        grouped = edges(short, "word").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("rank", edge.alias("x")))).alias("edges"))
        mask, packed = _fold_viterbi(F.col("edges"), F.col("n")), F.col("edges.x")
    else:
        grouped = edges(short, "word").groupBy("word", "n").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        mask, packed = _fold_merges(F.col("edges"), F.col("n")), F.col("edges")
    done = grouped.select("word", let(F.struct(packed.alias("packed"), mask.alias("mask")), lambda x: ids(F.col("word"), x["packed"], x["mask"])).alias("ids"))
    if long.isEmpty():
        return done
    spread = long.select("key", "word").repartition("key").mapInArrow(_substrings(pieces.longest), "key long, n int, s int, e int, sub string")
    known = edges(spread, "key", "sub").select("key", "n", "s", "e", "rank", F.when(F.col("id") == _NONE, spelt(F.col("sub"))).otherwise(F.array("id")).alias("ids"))
    folded = known.groupBy("key").applyInArrow(_fold_long(pieces.longest, pieces.unigram), "key long, ids array<int>")
    return done.union(long.join(folded, "key").select("word", "ids"))


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts with the dummy blank in front; SPACE itself counts as a blank."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    return bytescan.text_bytes(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))))


def _words(texts: pa.Array, cut: np.ndarray):
    """Bytes and spans of all words of a batch, and words before each text."""
    b, offsets = _prepared(texts)
    begins = np.zeros(len(b) + 1, bool)
    begins[1:-1] = cut[b[:-1], b[1:]]
    begins[offsets] = True
    starts = np.flatnonzero(begins[:-1])
    return b, starts, np.concatenate((starts[1:], [len(b)])) if len(starts) else starts, np.searchsorted(starts, offsets)


def _batches(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most)))
        yield lo, hi
        lo = hi


class Dictionary:
    """Ids of words by the words' hashes, with the words' bytes compared; of words with one hash it holds one."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        b, at = bytescan.text_bytes(pc.replace_substring(words.cast(pa.large_string()), SPACE, " "))
        hashes = bytescan.span_hashes(b, at[:-1], at[1:])
        begin = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))).astype(np.int64)
        self.hashes, order = np.unique(hashes, return_index=True)
        self.text, self.starts, self.ends = b, at[:-1][order], at[1:][order]
        self.size, self.first, self.flat = np.diff(begin)[order], begin[:-1][order], ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    def find(self, hashes: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of words, -1 where they are unknown."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            met = np.flatnonzero(self.hashes[at] == hashes)
            own = at[met]
            same = bytescan.same_spans(b, starts[met], ends[met], self.text, self.starts[own], self.ends[own])
            out[met[same]] = own[same]
        return out


def _runs(group: pa.Array, part: pa.Array) -> list[int]:
    """Places at which the rows' patch part changes, and both ends."""
    g, p = group.to_numpy(zero_copy_only=False), part.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(g)] if len(g) else []


def _missing(shared, cut: np.ndarray):
    """(group, part, word) of the words that the dictionary lacks, each once a part in every task, from (group, part, text)."""

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = None, set()
        for whole in batches:
            for first, last in itertools.pairwise(_runs(whole.column(0), whole.column(1))):
                batch = whole.slice(first, last - first)
                if (own := (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())) != place:
                    place, seen = own, set()
                for lo, hi in _batches(batch.column(2)):
                    b, starts, ends, _ = _words(batch.column(2).slice(lo, hi - lo), cut)
                    hashes, at, _ = bytescan.kinds(b, starts, ends)
                    rare = at[shared.value.find(hashes, b, starts[at], ends[at]) < 0]
                    raw = b.tobytes()
                    new = {raw[i:j] for i, j in zip(starts[rare].tolist(), ends[rare].tolist(), strict=True)} - seen
                    seen |= new
                    words = [w.decode().replace(" ", SPACE) for w in new]
                    same = lambda c: batch.column(c).slice(0, 1).take(pa.array(np.zeros(len(words), np.int64)))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array(words, pa.string())], names=["g", "p", "word"])

    return missing


def _write_patches(folder: str):
    """Writes a file a group, with a record batch a part; rows come in order of group and part, a group in one task alone."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((g, batch, lo, hi) for batch in batches for lo, hi in itertools.pairwise(_runs(batch.column(0), batch.column(0))) for g in (batch.column(0)[lo].as_py(),))
        for g, own in itertools.groupby(rows, lambda x: x[0]):
            table = pa.Table.from_batches([batch.slice(lo, hi - lo) for _, batch, lo, hi in own]).combine_chunks()
            at = _runs(table["p"].combine_chunks(), table["p"].combine_chunks())
            sink = pa.BufferOutputStream()
            body = table.select(["word", "ids"])
            meta = {"parts": ",".join(str(table["p"][k].as_py()) for k in at[:-1])}
            with pa.ipc.new_file(sink, body.schema.with_metadata(meta), options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                for lo, hi in itertools.pairwise(at):
                    file.write_table(body.slice(lo, hi - lo).replace_schema_metadata(meta), max_chunksize=hi - lo)
            put_file(folder, f"{g}.arrow", sink.getvalue())
            yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int64())})

    return write


class _Patches:
    """The words and ids of one part at a time, from the patch files."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.at, self.group, self.file = None, None, None
        self.places: dict[bytes, int] = {}

    def open(self, group: int, part: int) -> None:
        if self.at == (group, part):
            return
        if group != self.group:
            path = f"{self.root}/{group}.arrow"
            here = self.fs.get_file_info(path).type == pafs.FileType.File
            self.group, self.file = group, pa.ipc.open_file(self.fs.open_input_file(path)) if here else None  # without rare words there is no file
        parts = self.file.schema.metadata[b"parts"].decode().split(",") if self.file else []
        self.at, self.places = (group, part), {}
        if str(part) in parts:
            own = self.file.get_batch(parts.index(str(part)))
            self.places = {w.replace(SPACE, " ").encode(): k for k, w in enumerate(own.column("word").to_pylist())}
            upto = np.concatenate(([0], np.cumsum(pc.list_value_length(own.column("ids")).to_numpy(zero_copy_only=False)))).astype(np.int64)
            self.first, self.size, self.flat = upto[:-1], np.diff(upto), own.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int32)


class _Surface:
    """The texts of lists of ids, all of a batch at once."""

    def __init__(self, surface: list[bytes]):
        self.size = np.array([len(x) for x in surface], np.int64)
        self.first, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(surface), np.uint8)

    def texts(self, ids: pa.ListArray) -> pa.StringArray:
        """Each list's bytes without the first, which is the dummy blank; null stays null. Bytes that make no character become U+FFFD."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        n = self.size[flat]
        last = np.cumsum(n)
        b = self.bytes[np.arange(last[-1] if len(last) else 0) + np.repeat(self.first[flat] - last + n, n)]
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        begin = np.concatenate(([0], last))[upto]
        some = begin[1:] > begin[:-1]
        b = np.delete(b, begin[:-1][some])
        begin -= np.concatenate(([0], np.cumsum(some)))
        raw = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(b)])
        try:
            out = raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            out = pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.string()))


def _assemble(shared, cut: np.ndarray, folder: str, surface: _Surface | None):
    """(own, text, ids) from (own, text, group, part), and the text that the ids decode to where their surface is given."""

    def coded(texts: pa.Array, patches: _Patches) -> pa.Array:
        known = shared.value
        b, starts, ends, upto = _words(texts, cut)
        hashes, first, which = bytescan.kinds(b, starts, ends)
        found = known.find(hashes, b, starts[first], ends[first])
        size, begin = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        met = np.flatnonzero(found >= 0)
        size[met], begin[met] = known.size[found[met]], known.first[found[met]]
        rare = np.flatnonzero(found < 0)
        extra = np.zeros(0, np.int32)
        if len(rare):
            raw = b.tobytes()
            spelt = [raw[i:j] for i, j in zip(starts[first[rare]].tolist(), ends[first[rare]].tolist(), strict=True)]
            at = np.array([patches.places.get(w, -1) for w in spelt])
            if (at < 0).any():
                raise ValueError(f"no ids for the word {spelt[int(np.argmin(at))]!r}")
            n = patches.size[at]
            extra = patches.flat[np.arange(n.sum()) + np.repeat(patches.first[at] - np.cumsum(n) + n, n)]
            size[rare], begin[rare] = n, len(known.flat) + np.cumsum(n) - n
        n, at = size[which], begin[which]
        last = np.cumsum(n)
        at = np.arange(last[-1] if len(last) else 0) + np.repeat(at - last + n, n)
        ids = known.flat[np.minimum(at, max(len(known.flat) - 1, 0))] if len(known.flat) else np.zeros(len(at), np.int32)
        late = np.flatnonzero(at >= len(known.flat))
        ids[late] = extra[at[late] - len(known.flat)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], last))[upto].astype(np.int32)), pa.array(ids, pa.int32()))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patches = _Patches(folder)
        for whole in batches:
            for first, last in itertools.pairwise(_runs(whole.column(2), whole.column(3))):
                patches.open(whole.column(2)[first].as_py(), whole.column(3)[first].as_py())
                batch = whole.slice(first, last - first)
                for lo, hi in _batches(batch.column(1)):
                    part = batch.slice(lo, hi - lo)
                    out = {"own": part.column(0), "text": part.column(1), "ids": coded(part.column(1), patches)}
                    yield pa.RecordBatch.from_pydict(out if surface is None else out | {"decoded": surface.texts(out["ids"])})

    return assemble


def _placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs, stored unless it comes from files, and each row's file and number in it."""
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"], meta["file_path"]).schema
    except AnalysisException:
        docs = store(docs, "docs")
        meta = docs.metadataColumn("_metadata")
    return docs, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def encode(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None, frequent: int = FREQUENT_WORDS, sampled: int = SAMPLE_TEXTS, decoded: str | None = None) -> tuple[DataFrame, str]:
    """docs' columns (or those of carry) and the ids of each whole text; returns it and the new column's name.

    decoded names a further column, the text that the ids decode to: the Python worker that made the ids does that, so no second worker and its memory are needed."""
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    (name,) = fresh(docs, "ids")
    pieces = Pieces(model)
    cut = pieces.cuts()
    docs, place = _placed(docs)
    group = F.xxhash64(place["file"], F.floor(place["row"] / GROUP_ROWS))  # files with one hash share their patches, which does no harm
    part = (F.floor(place["row"] / PART_ROWS) % (GROUP_ROWS // PART_ROWS)).cast("int")
    texts = docs.select(group.alias("g"), part.alias("p"), docs[text].alias("text"))
    shape = "g long, p int, word string"
    none = spark.sparkContext.broadcast(Dictionary(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))))
    every = max(1, docs.count() // sampled)
    few = docs.select(F.lit(0).cast("long").alias("g"), part.alias("p"), docs[text].alias("text")).where(F.pmod(F.xxhash64(place), F.lit(every)) == 0)
    again = few.mapInArrow(_missing(none, cut), shape).groupBy("word").count().where("count > 1")
    common = store(again.orderBy(F.desc("count"), "word").limit(frequent).select("word"), "common")
    in_memory = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": 2 * WORDS_A_PART}  # a task groups its words' edges without sorting
    with settings(spark, in_memory):
        found = encode_words(common, pieces).toArrow().combine_chunks()  # at most `frequent` rows
    whole = lambda c: found[c].combine_chunks() if isinstance(found[c], pa.ChunkedArray) else found[c]
    shared = spark.sparkContext.broadcast(Dictionary(whole("word"), whole("ids")))
    drop(common)
    rare = store(texts.mapInArrow(_missing(shared, cut), shape), "rare")  # a part that two tasks read may have a word twice, which does no harm
    words = store(rare.select("word").distinct(), "words")
    with settings(spark, in_memory):
        coded = store(encode_words(words, pieces), "coded")
    drop(words)
    folder = scratch(spark, "patches")
    dealt = rare.join(coded, "word").select("g", "p", "word", "ids").repartition("g").sortWithinPartitions("g", "p")
    drop(store(dealt.mapInArrow(_write_patches(folder), "g long"), "written"))
    drop(rare)
    drop(coded)
    own = F.struct(F.lit(0).alias("_"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry) if c != text))
    rows = docs.select(own.alias("own"), docs[text].alias("text"), group.alias("g"), part.alias("p"))
    schema = T.StructType([rows.schema["own"], rows.schema["text"], T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * (decoded is not None))
    done = rows.mapInArrow(_assemble(shared, cut, folder, None if decoded is None else _Surface(pieces.surface)), schema)
    more = [] if decoded is None else [F.col("decoded").alias(decoded)]
    return done.select(*((F.col("text") if c == text else F.col("own")[f"c{i}"]).alias(c) for i, c in enumerate(carry)), F.col("ids").alias(name), *more), name


def decode(model: str):
    """A column function: the text of an array of ids. Bytes that make no character become U+FFFD."""
    surface = _Surface(Pieces(model).surface)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return surface.texts(ids)

    return text
