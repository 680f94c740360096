"""Chat formatting with collapse of cumulative snapshots.

Loggers often store a conversation again after every turn. Turn hashes, salted
with their position, are summed along each conversation, which gives a hash for
every prefix. A conversation whose whole hash is a proper prefix of another one
is its snapshot and goes; of equal conversations the least id stays. What is
maximal is rendered in parts of bounded length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordered import in_ranges, with_prefix_sums
from tidemark.session import materialised

PART_TURNS = 64
DIGEST = ("d1", "d2", "d3", "d4")


def _marked(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    mark = F.md5(F.concat(F.coalesce(F.concat(F.lit("r"), "role"), F.lit("n")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n"))))
    return rows.filter("conv_id IS NOT NULL").withColumn("mark", mark)


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, place, d1..d4): each turn's place and the hash up to it.

    Works on ids and hashes only. Range partitions split long conversations.
    """
    turns = _marked(conversations).select("conv_id", "turn", "mark").distinct()
    order = ["conv_id", "turn", "mark"]
    ranged = in_ranges(turns, order, "turns")
    placed = with_prefix_sums(ranged, order, {"place": F.lit(1).cast("long")}, by="conv_id").withColumn("place", F.col("place") + 1)
    for i in (0, 1):
        h = F.xxhash64("place", "mark", F.lit(i))
        placed = placed.withColumns({f"t{2 * i + 1}": h.bitwiseAND(F.lit(2**32 - 1)), f"t{2 * i + 2}": F.shiftrightunsigned(h, 32)})
    sums = with_prefix_sums(placed, order, {f"d{i}": F.col(f"t{i}") for i in range(1, 5)}, by="conv_id")
    sums = sums.withColumns({f"d{i}": F.col(f"d{i}") + F.col(f"t{i}") for i in range(1, 5)})
    return sums.select(*order, "place", *DIGEST)


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that no other one continues."""
    whole = hashes.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by(F.struct(*DIGEST), "place").alias("last"))
    whole = materialised(whole.select("conv_id", "n_turns", "last.*"), "conversations")
    proper = hashes.join(whole.select("conv_id", "n_turns"), "conv_id").filter("place < n_turns").select(F.col("place").alias("n_turns"), *DIGEST).distinct()
    one = whole.groupBy("n_turns", *DIGEST).agg(F.min("conv_id").alias("conv_id"))
    return one.join(proper, ["n_turns", *DIGEST], "left_anti").select("conv_id", "n_turns")


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations, rendered in order.

    Turns are ordered by number (null first), then by a hash of role and text;
    repeated rows are one turn. A part holds up to ``part_turns`` turns, so most
    conversations have one; parts count from 0. Markers inside of texts are
    broken up. A null role is rendered as ``unknown``, a null text as empty; they
    differ from these words when conversations are compared. Rows without a
    conv_id belong to no conversation and are left out, as are extra columns; an
    empty table gives an empty result.
    """
    hashes = materialised(prefix_hashes(conversations), "prefix_hashes")
    kept = materialised(maximal_conversations(hashes), "maximal")
    places = hashes.join(kept, "conv_id").select("conv_id", F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "mark", "place", "n_turns")
    turns = _marked(conversations).withColumn("turn", F.coalesce("turn", F.lit(-(2**63)))).join(places, ["conv_id", "turn", "mark"])
    turns = turns.groupBy("conv_id", "n_turns", "place").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|im_start|>"), plain(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), plain(F.coalesce("text", F.lit(""))), F.lit("<|im_end|>\n"))
    parts = turns.select("conv_id", "n_turns", F.expr(f"(place - 1) div {part_turns}").alias("part"), F.struct("place", line.alias("line")).alias("turn"))
    parts = parts.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("text"))


ORACLE = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text,
    md5(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n')) AS mark FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS place, string_agg(mark, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark)),
m AS (SELECT min(conv_id) AS conv_id FROM p WHERE place = n_turns AND prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns) GROUP BY prefix)
SELECT conv_id, (place - 1) // 64 AS part, n_turns, string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
    || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM p JOIN m USING (conv_id) GROUP BY ALL"""
