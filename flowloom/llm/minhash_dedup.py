"""Near duplicates: MinHash with banding, links confirmed on full sets, components by alternating stars.

A text's set is its distinct 5-word shingles after lower-casing A-Z (fewer words: the whole sequence; none: empty, linked
with nothing), held as 64-bit hashes. Texts with the same set (128 bits over all its members, and its size) form a class,
so copies never meet in pairs. Each class has 128 universal hash minima in 32 bands of 4: a pair of similarity 0.85 shares
no band with probability 6e-11, one of 0.80 with probability 5e-8. The threshold is `percent`, 85 unless told otherwise.

1. Each band bucket links its members to its least class (a star, linear in the bucket). Candidates whose signatures agree
   in too few of 128 places (74 at 0.85, 65 at 0.80; a pair at the threshold has fewer with probability 3e-14 and 4e-14)
   go, the rest are confirmed on their full sets.
2. Components of the confirmed links. A bucket that lies within one component is settled, however many members it has.
3. Members of the other buckets of three or more are joined on the rarest members of their sets (the prefix filter, which
   itself loses no pair): those of different components are compared, signatures first as above, and the components are
   taken again with the links so found. Up to three rounds compare, for each shingle, one member of each component with 32 of
   its largest component, which joins most of what belongs together; then all members that are still apart meet, whatever
   the rounds have compared. No bucket is capped. Holders of one shingle that lie in its largest component meet
   the others alone, 256 of them a task, so a shingle that a large group shares is split.

Edge cases: null text counts as empty; rows with equal id and text tie, and the first in the input's files stays; an empty
table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm import bytescan
from flowloom.llm.common import fresh, store, temporary
from flowloom.llm.components import connected_components

WIDTH, HASHES, BANDS, PERCENT = 5, 128, 32, 85
#: Holders of one shingle that a task compares with the holders in other components.
SPLIT = 256
#: Rounds in which components that share shingles are compared by a few members each, before all members are; and how many
#: members of a shingle's largest component such a round compares with one of each other component.
FIRST_ROUNDS, TRIES = 3, 32
#: Share of the pairs at the threshold that the comparison of signatures may lose.
MISS = 1e-13
_ROWS = HASHES // BANDS
_rng = np.random.default_rng(20140613)
_A, _B = (_rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and n+1 offsets."""
    b, offsets = bytescan.text_bytes(texts)
    w, at = bytescan.word_hashes(bytescan.lower(b), offsets)
    count = np.diff(at)
    size = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    out_at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(out_at[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(w) >= WIDTH:
            run = np.zeros(len(w) - WIDTH + 1, np.uint64)
            for k in range(WIDTH):
                run = run * bytescan.BASE + w[k : k + len(run)]
            doc = np.repeat(np.arange(len(count)), size)
            long = count[doc] >= WIDTH
            place = at[:-1][doc] + np.arange(len(out)) - out_at[:-1][doc]
            out[long] = bytescan.mix(run[place[long]])
        for n in range(1, WIDTH):
            few = np.flatnonzero(count == n)
            value = np.full(len(few), n, np.uint64)
            for k in range(n):
                value = value * bytescan.BASE + w[at[few] + k]
            out[out_at[few]] = bytescan.mix(value ^ np.uint64(0xA5A5A5A5))
    for i in np.flatnonzero(size > 1):
        out[out_at[i] : out_at[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[out_at[:-1][size > 0]] = True
    kept_at = np.concatenate(([0], np.cumsum(new)))[out_at]
    return out[new], kept_at


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minima of each set that isn't empty, as 32-bit numbers."""
    full = np.flatnonzero(np.diff(at))
    sig = np.zeros((len(full), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        lo = 0
        while lo < len(full):  # sets whose members fit into the cache together; a large set stands alone
            hi = max(lo + 1, int(np.searchsorted(at[full], at[full[lo]] + 16384)))
            h, begins = sets[at[full[lo]] : at[full[hi - 1] + 1]], at[full[lo:hi]] - at[full[lo]]
            room, short = np.empty_like(h), np.empty(len(h), np.uint32)
            for k in range(HASHES):
                np.multiply(h, _A[k], out=room)
                np.add(room, _B[k], out=room)
                np.right_shift(room, np.uint64(32), out=room)
                np.copyto(short, room, casting="unsafe")
                sig[lo:hi, k] = np.minimum.reduceat(short, begins)
            lo = hi
    return sig


def _sketch(text: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                sets, at = shingle_sets(part.column(text))
                n = np.diff(at)
                full = n > 0
                keys = np.zeros((2, len(n)), np.uint64)
                bands, short = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), HASHES), np.int16)
                if full.any():
                    with np.errstate(over="ignore"):
                        for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                            keys[k, full] = np.add.reduceat(bytescan.mix(sets ^ np.uint64(salt)), at[:-1][full])
                        sig = signatures(sets, at)
                        short[full] = sig.astype(np.uint16).view(np.int16)
                        value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
                        for k in range(_ROWS):
                            value = value * bytescan.BASE + sig[:, k::_ROWS]
                        bands[full] = bytescan.mix(value)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(full, x.shape[1], 0)))), pa.int32()), pa.array(x[full].ravel(), kind))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists(bands.view(np.int64), pa.int64()), lists(short, pa.int16())], names=[*part.schema.names, "n", "k1", "k2", "bands", "sig"])

    return sketch


def least_agreeing(percent: int) -> int:
    """Places in which two signatures must agree, so that a pair at the threshold is lost with probability MISS at most."""
    t, lost, k = percent / 100, 0.0, 0
    while k < HASHES and (lost := lost + math.comb(HASHES, k) * t**k * (1 - t) ** (HASHES - k)) <= MISS:
        k += 1
    return k


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose full sets are similar enough."""
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                (a, a_at), (b, b_at) = (shingle_sets(part.column(c)) for c in ("ta", "tb"))
                keep = []
                for i in range(len(part)):
                    x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """pairs (u, v) of classes whose full sets are similar enough."""
    near = pairs.join(reps.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(reps.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v").where(_agreeing(F.col("su"), F.col("sv")) >= least_agreeing(percent)).select("u", "v")
    near = store(near, "candidates")
    both = near.join(texts.select(F.col("node").alias("u"), F.col("text").alias("ta")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tb")), "v")
    return store(both.select("u", "v", "ta", "tb").mapInArrow(_confirm(percent), "u long, v long"), "links")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root, set size and shingle: a row for each member of a set."""
    for batch in batches:
        for lo in range(0, len(batch), 64):
            part = batch.slice(lo, 64)
            sets, at = shingle_sets(part.column(2))
            n = np.diff(at)
            each = pa.array(np.repeat(np.arange(len(part)), n))
            yield pa.RecordBatch.from_arrays([part.column(0).take(each), part.column(1).take(each), pa.array(np.repeat(n, n)), pa.array(sets.view(np.int64))], names=["node", "root", "n", "h"])


def _prefixes(buckets: DataFrame, roots: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """h, node, root, n, at: members of the sets in open buckets (of three or more, in several components) by which they may meet.

    Two sets of similarity t share one of their |x| - ceil(t |x|) + 1 members that come first in any common order. Rarest
    first, these are the members that a text shares with few others, so a text that is far from a large group meets none of it."""
    placed = _rooted(buckets, roots)
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi AND n > 2").select("key")
    nodes = store(placed.join(open_, "key", "left_semi").select("node", "root").distinct(), "open")
    members = store(nodes.join(texts, "node").select("node", "root", "text").mapInArrow(_members, "node long, root long, n long, h long"), "members")
    shared = members.groupBy("h").agg(F.count("*").alias("df"))
    ranked = members.join(shared, "h").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("df", "h")))  # one text's members
    return store(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("df > 1").select("h", "node", "root", "n", "at"), "prefixes")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _room(percent: int) -> str:
    """Whether the first member that two sets share leaves room for enough others."""
    return f"{100 + percent} * (1 + least(nu - au, nv - av)) >= {percent} * (nu + nv)"


def _first_pairs(first: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each shingle a member of each of its components with TRIES members of its largest one, other ones every turn: at most TRIES pairs a row.

    Joined by shingle and place among the tries, so a shingle that many components share is split."""
    one = F.min(F.struct(F.xxhash64("node", F.lit(turn), "h").alias("x"), "node", "n", "at")).alias("one")
    slot = F.pmod(F.xxhash64("h", "node", F.lit(turn)), F.lit(TRIES)).cast("int").alias("slot")
    by_slot = store(first.groupBy("h", "root", slot).agg(F.count("*").alias("c"), one), "by_slot")
    by_root = by_slot.groupBy("h", "root").agg(F.sum("c").alias("c"), F.min("one").alias("one"))
    top = store(by_root.groupBy("h").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("h", F.col("most.root").alias("top")), "top")
    side = lambda x: (F.col("one.node").alias(x), F.col("one.n").alias(f"n{x}"), F.col("one.at").alias(f"a{x}"))
    each = F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("slot")
    others = by_root.join(top, "h").where("root <> top").select("h", *side("u"), each)
    tried = by_slot.join(top, "h").where("root = top").select("h", "slot", *side("v"))
    met = others.join(tried, ["h", "slot"]).where(_room(percent))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _cross_pairs(first: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a shingle of their prefixes and have room for enough others."""
    # members of a shingle's largest component meet only those of its others, not one another
    by_root = first.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("roots"), F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("most"))
    hot = store(by_root.where("roots > 1").select("h", F.col("most.root").alias("top"), F.ceil(F.col("all") / SPLIT).cast("int").alias("salts")), "shingles")
    first = store(first.join(hot, "h"), "apart")
    side = lambda rows, x: rows.select("h", "salt", F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("at").alias(f"a{x}"))
    left = side(first.where("root <> top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "u")
    right = side(first.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")), "v")
    met = left.join(right, ["h", "salt"]).where(f"ru <> rv AND {_room(percent)}")
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, percent: int = PERCENT) -> tuple[DataFrame, str]:
    """docs' columns (or those of carry) and a struct (n_shingles, component_id, kept); returns it and the struct's name.

    Texts whose sets are similar by percent / 100 or more are linked."""
    carry = docs.columns if carry is None else carry
    (name,) = fresh(docs, "near")
    own = F.struct(F.lit(0).alias("_"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry) if c != text))
    rows = docs.select(own.alias("own"), docs[id].alias("id"), F.monotonically_increasing_id().alias("row"), docs[text].alias("text"))
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("n long, k1 long, k2 long, bands array<long>, sig array<short>").fields])
    with temporary(docs.sparkSession) as keep:
        base = keep(store(rows.mapInArrow(_sketch(3), schema), "sketches"))
        classes = store(base.where("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "row")).alias("best")).withColumn("node", F.col("best.row")), "classes")
        reps = store(base.select("row", "bands", "sig").join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "reps")
        buckets = reps.select("node", F.explode("bands").alias("key"))
        pivots = buckets.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
        buckets = store(buckets.join(pivots, "key"), "buckets")
        met = buckets.select(F.col("node").alias("row")).distinct()
        texts = store(base.select("row", "text").join(met, "row", "left_semi").withColumnRenamed("row", "node"), "texts")
        links = _confirmed(buckets.where("node <> v").select(F.col("node").alias("u"), "v").distinct(), reps, texts, percent)
        roots = connected_components(links)
        first = _prefixes(buckets.select("key", "node"), roots, texts, percent)
        for k in range(FIRST_ROUNDS + 1):
            pairs = _first_pairs(first, percent, k) if k < FIRST_ROUNDS else _cross_pairs(first, percent)
            more = _confirmed(pairs, reps, texts, percent)
            if not more.isEmpty():
                links = links.union(more)
                roots = connected_components(links)
                first = store(_rooted(first.drop("root"), roots), "prefixes")
        joined = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = joined.groupBy("root").agg(F.min("best").alias("first"))
        places = keep(store(joined.join(first, "root").select("n", "k1", "k2", "first"), "places"))
    base = base.withColumn("k1", F.when(F.col("n") > 0, F.col("k1")).otherwise(F.col("row")))  # empty texts join nothing, each in its own place
    out = base.drop("bands", "sig", *([] if text in carry else ["text"])).join(places, ["n", "k1", "k2"], "left")
    verdict = F.struct(F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"), F.when(F.col("n") > 0, F.col("first.row") == F.col("row")).otherwise(True).alias("kept"))
    return out.select(*((F.col("text") if c == text else F.col("own")[f"c{i}"]).alias(c) for i, c in enumerate(carry)), verdict.alias(name)), name


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, with its columns as they were."""
    grouped, name = near_groups(docs, **options)
    return grouped.where(F.col(name)["kept"]).drop(name)
