"""Chat formatting by quotation linking."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.common import attach_groups, cut, field, map_texts, row_ids

MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: "On ... wrote:" in the languages of the corpus.
LEAD_IN = re.compile(r"(?i)^.{0,200}\b(wrote|schrieb|écrit|escribió)\b.{0,80}:\s*$")


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes and lead-ins, and the quoted passages as (level, text) in order.

    A passage is a run of lines of one quote level; blank lines inside stay.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        mark = MARK.match(line)
        level = mark[1].count(">") if mark else 0
        if level:
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[mark.end() :])
            if not last:
                while own and not own[-1].strip():
                    own.pop()
                if own and LEAD_IN.match(own[-1]):
                    own.pop()
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip("\n") if passages else text or "", [(n, "\n".join(p)) for n, p in passages]


def spans(text: str) -> set[str]:
    """What a quote may repeat: the whole text, each paragraph and each line, normalised and not empty."""
    return {s for s in map(normalise, (text, *re.split(r"\n\s*\n", text), *text.split("\n"))) if s}


def parse(messages: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """keep..., row, own (text without quotes), n_quotes, marks: (hash, level, chars), level 0 for what the message itself says."""
    mark = T._parse_datatype_string("array<struct<h: long, level: int, chars: int>>")
    schema = T.StructType([*(field(messages, c) for c in keep), T.StructField("row", T.LongType()), T.StructField("own", T.StringType()), T.StructField("n_quotes", T.IntegerType()), T.StructField("marks", mark)])

    def run(batches):
        from xxhash import xxh3_64_intdigest

        ids, kind = row_ids(), pa.list_(pa.struct([("h", pa.int64()), ("level", pa.int32()), ("chars", pa.int32())]))
        for batch in batches:
            own, n, marks = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                rest, passages = split_quotes(t)
                own.append(rest)
                n.append(len(passages))
                marks.append([{"h": xxh3_64_intdigest(s) - (1 << 63), "level": level, "chars": len(s)} for level, p in ((0, rest), *passages) for s in spans(p)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([next(ids) for _ in own], pa.int64()), pa.array(own, pa.string()), pa.array(n, pa.int32()), pa.array(marks, kind)], schema.names)

    return map_texts(messages.select(*keep, text), run, schema)


def link_quotes(parsed: DataFrame, conv: str, turn: str, block: int = 4096) -> DataFrame:
    """(row, parent, reply_to): the earlier message of the conversation that a message quotes most, and its turn.

    Every quoted span meets the latest earlier message that says it.  What is said of a
    hash is first reduced to a row per turn, then looked up by blocks of ``block`` turns
    with the last one of the blocks before, so that neither pairs nor long ordered
    groups arise where many messages share a span.  The outermost quotes decide, then
    the most characters, then the latest message.
    """
    t = F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63)))
    marks = parsed.select(conv, t.alias("t"), "row", F.explode("marks").alias("m")).select(F.xxhash64(F.coalesce(F.col(conv).cast("string"), F.lit("~")), F.col(conv).isNull(), "m.h").alias("key"), "t", "row", "m.level", "m.chars")
    asked = cut(marks.groupBy("key").agg(F.max("level").alias("top"), F.count("*").alias("n")).where("top > 0").select("key", "n"))
    said = marks.where("level = 0").groupBy("key", "t").agg(F.max("row").alias("parent"))  # of one turn the last row
    said = attach_groups(said, asked, "key", "n").select("key", "t", "parent", F.lit(False).alias("quotes"))
    asks = marks.where("level > 0").select("key", "t").distinct().select("key", "t", F.lit(None).cast("long").alias("parent"), F.lit(True).alias("quotes"))
    both = cut(said.unionByName(asks).withColumn("block", F.floor(F.col("t") / block)))
    last = lambda w: F.last(F.when(~F.col("quotes"), F.struct("t", "parent")), ignorenulls=True).over(w)
    one = Window.partitionBy("key", "block").orderBy("t", F.desc("quotes")).rowsBetween(Window.unboundedPreceding, -1)  # a message does not quote its own turn
    ends = both.where("not quotes").groupBy("key", "block").agg(F.max(F.struct("t", "parent")).alias("end"))
    blocks = both.select("key", "block").distinct().join(ends, ["key", "block"], "left")
    earlier = F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("earlier", earlier).select("key", "block", "earlier")
    met = both.withColumn("near", last(one)).where("quotes").join(blocks, ["key", "block"]).select("key", "t", F.coalesce("near", "earlier").alias("said")).where("said is not null")
    met = cut(met.select("key", "t", "said.parent", F.col("said.t").alias("at")))
    quotes = marks.where("level > 0").withColumn("kt", F.xxhash64("key", "t"))
    groups = cut(quotes.groupBy("key", "t").agg(F.count("*").alias("n")).join(met, ["key", "t"]).select(F.xxhash64("key", "t").alias("kt"), "n", "parent", "at"))
    voted = attach_groups(quotes.select("kt", "row", "level", "chars"), groups, "kt", "n")
    votes = voted.groupBy("row", "level", "parent", "at").agg(F.sum("chars").alias("chars"))
    best = votes.groupBy("row").agg(F.max_by(F.struct("parent", "at"), F.struct(-F.col("level"), F.col("chars"), F.col("at"), F.col("parent"))).alias("b"))
    return best.select("row", "b.parent", F.when(F.col("b.at") > -(1 << 63), F.col("b.at")).alias("reply_to"))


def thread(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(row, root, thread, depth) of the rows that answer others, by pointer doubling: rounds grow with the log of the depth.

    ``links`` is (row, parent, reply_to); ``thread`` is the root's turn.  Roots that many rows share are joined
    where these rows lie.  Without links there are none.
    """
    state = cut(links.select("row", F.col("parent").alias("root"), F.col("reply_to").alias("thread"), F.lit(1).alias("depth")))
    for _ in range(rounds):
        up = state.select(F.col("row").alias("root"), F.col("root").alias("next"), F.col("thread").alias("next_thread"), F.col("depth").alias("more"))
        groups = cut(state.groupBy("root").agg(F.count("*").alias("n")).join(up, "root", "left"))
        if groups.where("next is not null").isEmpty():
            return state
        moved = F.col("next").isNotNull()
        step = attach_groups(state, groups, "root", "n")
        state = cut(step.select("row", F.coalesce("next", "root").alias("root"), F.when(moved, F.col("next_thread")).otherwise(F.col("thread")).alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    raise RuntimeError(f"threads deeper than 2^{rounds}")


def numbered(rows: DataFrame, group: str, *order: str, name: str = "position") -> DataFrame:
    """Rows with their place (from 0) in their group, however large: a range sort, then counts by group and task."""
    placed = cut(rows.orderBy(group, *order).withColumn("task", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    parts = placed.groupBy(group, "task").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(group).alias("of"), F.col("task").alias("in_task"), "first", before.alias("before"))
    same = F.col(group).eqNullSafe(F.col("of")) & (F.col("task") == F.col("in_task"))  # a key holds rows of one sort task at most
    return placed.join(parts, same).withColumn(name, F.col("nth") - F.col("first") + F.col("before")).drop("task", "nth", "of", "in_task", "first", "before")


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Reply-ordered conversations without quotes, a row per message:
    conv_id, turn, role, text, n_quotes, reply_to, thread, depth, position.

    ``reply_to`` is the turn of the message quoted, ``thread`` the turn of the first
    message of its chain of replies (its own if it answers none) and ``depth`` its
    distance from that.  ``position`` (from 0, gapless) orders a conversation: thread by
    thread in order of their first messages, each message after what it answers.
    Nothing is gathered into one row, so conversations of any length are whole.

    Turns are whole numbers.  Null texts are empty messages, null conversations are one
    conversation, null turns come first.  Repeated rows each give a row and a position.
    Other columns are not read.  An empty table gives none.
    """
    named = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    parsed = cut(parse(named, ("conv_id", "turn", "role"), "text"))
    links = cut(link_quotes(parsed, "conv_id", "turn"))
    tops = thread(links).join(links.select("row", "reply_to"), "row")
    turns = parsed.select("conv_id", "turn", "row").join(tops, "row", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    turns = turns.withColumn("root", F.coalesce("root", "row")).withColumn("thread", F.when(F.col("depth") == 0, F.col("turn")).otherwise(F.col("thread")))
    placed = numbered(turns, "conv_id", "thread", "root", "turn", "row").drop("conv_id", "turn", "root")
    out = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"), "n_quotes", "row").join(placed, "row")
    return out.select("conv_id", "turn", "role", "text", "n_quotes", "reply_to", "thread", "depth", "position")
