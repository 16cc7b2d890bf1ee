"""Chat formatting by quotation linking.

The lines of a message are parsed into levels of quotation (``>`` marks). A quoted
passage, a run of lines of one level, is normalised and hashed, and so is each message's own
text: whole, by runs between quotes, by paragraphs and by lines. A passage is linked
to the last message before it in its conversation that has the hash, at any level; the longest
passage of the shallowest level that links names the message replied to. Threads follow the replies to their
first message, and every message is given without its quotes, in reply order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, cut

_MARKS = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
_INTRO = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
_GAP = re.compile(r"\s+")


def levels(text: str) -> list[tuple[int, str]]:
    """Quote level and rest of each line; lines that only introduce a quote below them are left out."""
    lines = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return [(n, rest) for i, (n, rest) in enumerate(lines) if not (_INTRO.match(rest) and i + 1 < len(lines) and lines[i + 1][0] > n)]


def runs(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    out: list[tuple[int, list[str]]] = []
    for n, rest in lines:
        if out and out[-1][0] == n:
            out[-1][1].append(rest)
        else:
            out.append((n, [rest]))
    return [(n, "\n".join(x)) for n, x in out]


def passage_hash(text: str) -> int | None:
    """A 64-bit hash of a passage without regard to case and white space; None if it has no letters or digits."""
    plain = _GAP.sub(" ", text).strip().lower()
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "big", signed=True) if any(c.isalnum() for c in plain) else None


def parts(text: str) -> set[str]:
    """A text, its paragraphs and its lines."""
    return {text, *re.split(r"\n\s*\n", text), *text.split("\n")}


def parse_message(text: str | None) -> tuple[str, list[dict], list[int], int]:
    """``(own text, quoted passages, hashes of own passages, number of quoted passages)`` of a message.

    A passage of several lines is also looked for by its paragraphs and lines, which weigh less.
    """
    pieces = runs(levels(text or ""))
    own = [x for n, x in pieces if n == 0]
    body = "\n".join(own).strip()
    mine = {passage_hash(p) for x in [body, *own] for p in parts(x)} - {None}
    quotes = {}
    for n, x in pieces:
        if n:
            for p in parts(x):
                h = passage_hash(p)
                if h is not None:
                    quotes[n, h] = max(quotes.get((n, h), 0), len(p))
    return re.sub(r"\n{3,}", "\n\n", body), [{"level": n, "hash": h, "size": s} for (n, h), s in sorted(quotes.items())], sorted(mine), sum(n > 0 for n, _ in pieces)


_PARSED = "conv_id long, turn long, role string, text string, quotes array<struct<level:int,hash:long,size:int>>, own array<long>, n_quotes int"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))
    for batch in batches:
        found = [parse_message(t) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.list_(pa.int64())), pa.array([f[3] for f in found], pa.int32())], names=["conv_id", "turn", "role", "text", "quotes", "own", "n_quotes"])


#: Turns of a conversation that are ordered together; longer runs of one passage or of replies to one message are ordered by such pieces.
PIECE = 1024


def _last_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``found``, the greatest ``source`` of a row of the same ``keys`` at an earlier ``turn``.

    The rows of a key are split by pieces of turns: within a piece a window carries the
    source, and from piece to piece only a row a piece is carried.
    """
    rows = rows.withColumn("piece", F.floor(F.col("turn") / PIECE))
    carried = rows.groupBy(*keys, "piece").agg(F.max("source").alias("most"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*keys, "piece", F.max("most").over(earlier).alias("carried"))
    within = Window.partitionBy(*keys, "piece").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("found", F.max("source").over(within)).join(carried, [*keys, "piece"]).withColumn("found", F.coalesce("found", "carried")).drop("piece", "carried")


def _next_sibling(links: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, next``: the next turn that replies to the same message, by pieces as above."""
    rows = links.select("conv_id", "turn", "reply_to", F.floor(F.col("turn") / PIECE).alias("piece"))
    first = rows.groupBy("conv_id", "reply_to", "piece").agg(F.min("turn").alias("first"))
    first = first.select("conv_id", "reply_to", "piece", F.lead("first").over(Window.partitionBy("conv_id", "reply_to").orderBy("piece")).alias("later"))
    rows = rows.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id", "reply_to", "piece").orderBy("turn")))
    return rows.join(first, ["conv_id", "reply_to", "piece"]).select("conv_id", "turn", "reply_to", F.coalesce("next", "later").alias("next"))


def _places(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, place``: a message's place in the reply order of its thread, counted from 0.

    In this order a message is followed by its first reply, or else by the next reply to
    the nearest message above that has one. The list is ranked by doubling steps.
    """
    step = scratch.table(_next_sibling(links).select("conv_id", "turn", F.coalesce("next", "reply_to").alias("to"), F.col("next").isNotNull().alias("done")))
    while not step.where("not done").isEmpty():  # who has no next sibling takes that of the message above
        up = step.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("up"), F.col("done").alias("up_done"), F.lit(True).alias("known"))
        got = step.join(up, ["conv_id", "to"], "left")
        step = scratch.table(got.select("conv_id", "turn", F.when(F.col("done"), F.col("to")).otherwise(F.col("up")).alias("to"), (F.col("done") | F.coalesce("up_done", ~F.coalesce("known", F.lit(False)))).alias("done")))
    first = links.groupBy("conv_id", "reply_to").agg(F.min("turn").alias("first")).withColumnRenamed("reply_to", "turn")
    every = links.select("conv_id", "turn").union(links.select("conv_id", "reply_to")).distinct()
    ahead = every.join(first, ["conv_id", "turn"], "left").join(step, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("first", "to").alias("next"))
    ahead = scratch.table(ahead.withColumn("n", F.col("next").isNotNull().cast("long")))
    while not ahead.where("next is not null").isEmpty():
        after = ahead.select("conv_id", F.col("turn").alias("next"), F.col("next").alias("then"), F.col("n").alias("more"))
        ahead = scratch.table(ahead.join(after, ["conv_id", "next"], "left").select("conv_id", "turn", F.col("then").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return ahead.select("conv_id", "turn", "n")


def _unmarked(text: Column) -> Column:
    """Text in which no control mark can be read."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """A row a message: ``conv_id, turn, role, text, reply_to, thread_turn, place, depth, n_quotes, n_linked, links, formatted``.

    ``text`` is without quotes, ``reply_to`` the turn replied to (null if nothing quoted is
    found). ``n_quotes`` counts the quoted passages (runs of lines of one level over 0), ``links`` names the turns they are
    from, each once a level (``level, source``, sorted), and ``n_linked`` counts these turns, each
    once. ``thread_turn`` is the first turn of its thread, ``depth`` the replies between and ``place`` the
    place in the thread's reply order, in which each message is followed by the replies to it. The
    order of a conversation is ``thread_turn, place``. In ``formatted``, ``<|`` of role and text is escaped.
    Null text is empty; rows without
    conversation or turn, and rows that repeat a turn, are kept; the latter share their
    links and place. A table without rows gives none, and texts of any length are parsed whole. Other columns aren't read.
    """
    spark = messages.sparkSession
    given = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as scratch:
        parsed = scratch.table(given.mapInArrow(_parse, _PARSED))
        placed = parsed.where("conv_id is not null and turn is not null")
        asked = scratch.table(placed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct())
        wanted = asked.select("conv_id", "hash").distinct()
        has = placed.select("conv_id", "turn", F.explode("own").alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi").distinct()
        # one ordered pass over those that have a passage and those that quote it; no pairs
        both = has.select("conv_id", "hash", "turn", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("size")).union(asked.select("conv_id", "hash", "turn", F.lit(None).cast("long"), "level", "size"))
        linked = _last_before(both, ["conv_id", "hash"]).where("level is not null and found is not null").withColumn("source", F.col("found"))
        best = F.max(F.struct(-F.col("level"), "size", "source")).getField("source")
        found = F.array_sort(F.collect_set(F.struct("level", "source")))
        links = scratch.table(linked.groupBy("conv_id", "turn").agg(best.alias("reply_to"), F.count_distinct("source").alias("n_linked"), found.alias("links")))
        jumps = scratch.table(links.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")))
        while True:
            up = jumps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
            step = scratch.table(jumps.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
            jumps = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        behind = _places(links.select("conv_id", "turn", "reply_to"), scratch)
        out = parsed.join(links, ["conv_id", "turn"], "left").join(jumps, ["conv_id", "turn"], "left").withColumn("thread_turn", F.coalesce("root", "turn"))
        out = out.join(behind, ["conv_id", "turn"], "left").join(behind.select("conv_id", F.col("turn").alias("thread_turn"), F.col("n").alias("whole")), ["conv_id", "thread_turn"], "left")
        out = out.select(
            "conv_id", "turn", "role", "text", "reply_to", "thread_turn", F.coalesce(F.col("whole") - F.col("n"), F.lit(0)).alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.coalesce("links", F.array().cast("array<struct<level:int,source:bigint>>")).alias("links"),
            F.concat(F.lit("<|"), _unmarked(F.coalesce("role", F.lit("user"))), F.lit("|>\n"), _unmarked(F.col("text")), F.lit("\n")).alias("formatted"),
        )
        return cut(out)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
