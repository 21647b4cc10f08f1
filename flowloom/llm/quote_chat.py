"""Conversations in reply order, without quotations.

1. Each message is parsed: lines that begin with > marks form passages by quote level, a line that announces a quotation
   ("On ... wrote:") goes with it, and the rest is the message's own text. A passage is normalised (lower case, blanks
   joined, so re-wrapped lines agree). Of passages and own texts alike, the whole, each paragraph, each line and each
   sentence are hashed with 128 bits, however short.
2. Quoted hashes join the first message of the conversation that holds them, or else that of the first other conversation.
   The messages that hold a hash are reduced to the first of each conversation, and these to two conversations, before the
   joins, so they are many to one.
3. A message replies to the message that its lowest quote level leads to; passages before lines and sentences, those of
   under 20 characters last, the latest turn first.
   Thread root and depth follow by pointer doubling, in as many rounds as the logarithm of the longest chain.
4. Messages are ordered by conversation, thread, depth and turn: a range partitioning, a count by partition and conversation,
   and row numbers inside partitions. A conversation of any length is spread over partitions, and becomes chats of at most
   `messages` messages.

Edge cases: null text counts as empty; a null role is "user"; a null conversation is one of its own; a null turn comes first
and neither quotes nor is quoted; the conversation named '' isn't the null one; messages of nothing but quotes stay, empty; rows equal in all columns each stay; an empty
table gives an empty table; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import store

#: Messages of a chat, and characters from which a line or sentence goes before shorter ones when a parent is chosen.
MESSAGES, LINE_CHARS = 64, 20
_STOPS, _CLOSERS = tuple(".!?…。！？"), "\"'”’»)]」』*_"
_WIDE_STOP = re.compile(r"([。！？][」』”’]*)")
_MARKS = re.compile(r"(?:[ \t]?>)+")
_ANNOUNCES = re.compile(r"^\s*(?:(?:on|am|le|el)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:|.*\b(?:wrote|schrieb|a écrit|escribió)\s*:)\s*$", re.IGNORECASE)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _hash(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own text, and its quoted passages as (level, lines)."""
    own, passages, open_level = [], [], 0
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)
        level = marks[0].count(">") if marks else 0
        if not level:
            own.append(line)
        elif level != open_level:
            if not open_level:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ANNOUNCES.match(own[-1]):
                    own.pop()
            passages.append((level, []))
        if level:
            passages[-1][1].append(line[marks.end() :].strip())
        open_level = level
    return "\n".join(own).strip(), [(k, p) for k, p in passages if any(p)]


def _paragraphs(lines: list[str]) -> Iterator[str]:
    held: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            held.append(line)
        elif held:
            yield normal(" ".join(held))
            held = []


def _sentences(paragraph: str) -> Iterator[str]:
    """The sentences of a normalised paragraph: up to a word that ends in a full stop or the like, whatever closes after it."""
    held: list[str] = []
    for word in _WIDE_STOP.sub(r"\1 ", paragraph).split():
        held.append(word)
        if word.rstrip(_CLOSERS).endswith(_STOPS):
            yield " ".join(held)
            held = []
    if held:
        yield " ".join(held)


def _parts(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(kind, text) of a text's parts: 0 whole, 1 paragraph, 2 line, 3 sentence, 4 line or sentence of under LINE_CHARS characters."""
    yield 0, normal(" ".join(lines))
    paragraphs = list(_paragraphs(lines))
    yield from ((1, p) for p in paragraphs)
    yield from ((2 if len(x) >= LINE_CHARS else 4, x) for x in map(normal, lines))
    yield from ((3 if len(x) >= LINE_CHARS else 4, x) for p in paragraphs for x in _sentences(p))


def own_hashes(own: str) -> list[bytes]:
    return list(dict.fromkeys(_hash(x) for x in dict.fromkeys(x for _, x in _parts(own.split("\n"))) if x))


def quote_hashes(passages: list[tuple[int, list[str]]]) -> list[dict]:
    """Hashes to look up, with the passage's level and the kind of match."""
    found: dict[bytes, dict] = {}
    for level, lines in passages:
        for kind, x in _parts(lines):
            if x:
                found.setdefault(h := _hash(x), {"level": level, "kind": kind, "hash": h})
    return list(found.values())


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("kind", pa.int32()), ("hash", pa.binary())]))
    for batch in batches:
        parsed = [parse(x) for x in batch.column("text").to_pylist()]
        own = [x for x, _ in parsed]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "conv", "turn", "role")), pa.array(own, pa.string()), pa.array([own_hashes(x) for x in own], pa.list_(pa.binary())), pa.array([quote_hashes(x) for _, x in parsed], kind)], names=["row", "conv", "turn", "role", "own", "holds", "quotes"])


def parse_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """row, conv, turn, role, own, holds, quotes for each message, written once so that row numbers are fixed."""
    rows = messages.select(F.monotonically_increasing_id().alias("row"), messages[conv].cast("string").alias("conv"), messages[turn].cast("long").alias("turn"), F.coalesce(messages[role], F.lit("user")).alias("role"), messages[text].alias("text"))
    return store(rows.mapInArrow(_parse_rows, "row long, conv string, turn long, role string, own string, holds array<binary>, quotes array<struct<level:int,kind:int,hash:binary>>"), "messages")


def _key(conv: str) -> Column:
    """A join key that is never null and keeps the null conversation apart from all texts, '' too."""
    return F.when(F.col(conv).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(conv)))


def link_replies(parsed: DataFrame) -> DataFrame:
    """row, parent, outside: the message that each quoting message replies to, and whether it is in another conversation."""
    quotes = parsed.where("turn IS NOT NULL AND size(quotes) > 0").select("row", _key("conv").alias("conv"), "turn", F.explode("quotes").alias("q")).select("row", "conv", "turn", "q.*")
    holds = parsed.where("turn IS NOT NULL").select(F.col("row").alias("at"), _key("conv").alias("conv"), F.col("turn").alias("t"), F.explode("holds").alias("hash"))
    wanted = quotes.select("hash").distinct()
    holds = holds.join(wanted, "hash", "left_semi")  # only hashes that some message quotes
    near = holds.groupBy("hash", "conv").agg(F.min(F.struct("t", "at")).alias("near"))
    place = F.row_number().over(Window.partitionBy("hash").orderBy("conv"))
    two = near.withColumn("place", place).where("place <= 2")  # limited before the shuffle as well, so a common passage is no large group
    far = two.groupBy("hash").agg(*(F.min(F.when(F.col("place") == k, F.struct("conv", "near.t", "near.at"))).alias(c) for k, c in ((1, "far"), (2, "next"))))
    met = quotes.join(near, ["hash", "conv"], "left").join(far, "hash", "left")
    inside = F.coalesce(F.col("near.t") < F.col("turn"), F.lit(False))
    met = met.withColumn("inside", inside).withColumn("far", F.when(F.col("far.conv") != F.col("conv"), F.col("far")).otherwise(F.col("next")))
    met = met.where(F.col("inside") | F.col("far").isNotNull())
    best = F.min(F.struct((~F.col("inside")).alias("outside"), "level", "kind", F.when(F.col("inside"), -F.col("near.t")).alias("late"), F.when(F.col("inside"), F.col("near.at")).otherwise(F.col("far.at")).alias("parent")))
    return store(met.groupBy("row").agg(best.alias("b")).select("row", "b.parent", "b.outside"), "links")


def thread_places(links: DataFrame) -> DataFrame:
    """row, root, depth of each message that replies within its conversation. Parents have smaller turns, so there is no cycle."""
    state = store(links.where("NOT outside").select("row", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select(F.col("row").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        step = store(state.join(up, "root", "left").select("row", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "threads")
        if step.where("moved").isEmpty():
            return step.select("row", "root", "depth")
        state = step.drop("moved")


def chats(messages: DataFrame, size: int = MESSAGES, **columns) -> DataFrame:
    """conv, part, n_messages, n_replies, n_outside, chat: the formatted messages of each conversation in reply order, at most `size` a row."""
    spark = messages.sparkSession
    parsed = parse_messages(messages, **columns)
    links = link_replies(parsed)
    threads = thread_places(links)
    rows = parsed.select("row", "conv", "turn", "role", "own").join(links, "row", "left").join(threads, "row", "left")
    roots = rows.where("root IS NOT NULL").select("root").distinct().join(parsed.select(F.col("row").alias("root"), F.col("turn").alias("root_turn")), "root")
    rows = rows.join(roots, "root", "left").select("row", "conv", "turn", "role", "own", "parent", "outside", F.coalesce("root_turn", "turn").alias("thread"), F.coalesce("root", "row").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))
    order = ["conv", "thread", "root", "depth", "turn", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(rows.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "ordered")
    key = F.struct(F.col("conv").isNull().alias("none"), F.coalesce("conv", F.lit("")).alias("conv"))
    dealt = dealt.withColumn("key", key)
    counts = dealt.groupBy("key", "pid").agg(F.count("*").alias("n"))
    bases = store(counts.select("key", "pid", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "bases")
    own = F.row_number().over(Window.partitionBy("key", "pid").orderBy(*order[1:]))
    placed = dealt.withColumn("own_place", own).join(bases, ["key", "pid"]).withColumn("place", F.col("base") + F.col("own_place") - 1).withColumn("part", F.floor(F.col("place") / size))
    message = F.struct("place", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"), F.lit("\n")).alias("text"))
    done = placed.groupBy("key", "part").agg(F.array_sort(F.collect_list(message)).alias("m"), F.count("parent").alias("n_replies"), F.sum(F.coalesce(F.col("outside"), F.lit(False)).cast("long")).alias("n_outside"))
    return done.select(F.when(~F.col("key.none"), F.col("key.conv")).alias("conv"), "part", F.size("m").cast("long").alias("n_messages"), "n_replies", "n_outside", F.array_join(F.col("m.text"), "").alias("chat"))
