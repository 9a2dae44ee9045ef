"""Chat transcripts from logged conversations, cumulative snapshots collapsed.

A conversation is often logged again after each turn, so one log is a prefix of the next. Each turn gets a rolling
hash of all turns up to it. A log whose whole hash is also the hash of a shorter-than-whole prefix of another log is a
snapshot and goes; of logs that are equal throughout, the one with the smallest id stays. The rest is rendered.

The rolling hash adds up hashes of (position, role, text), two 64-bit hashes in 32-bit halves, so it is a running
sum and can be cut: turns are numbered and summed in chunks of ``CHUNK`` turn numbers, and chunk totals become
offsets. No task needs a whole conversation before rendering, whose result is one value per conversation by nature.
Equal prefixes, however frequent, are one row per task before they are shuffled.

Cases: turns are ordered by (turn, role, text), NULL first, and equal rows are turns of their own; a NULL role reads
``unknown`` and a NULL text is empty; turns without a conversation id belong to no conversation and are left out; an
empty table gives no rows. Markers inside texts are broken up so that they cannot pose as turns. Built-in
expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jobmargin.llm.common import stored

CHUNK = 256
# The markers around a turn.
START, END = "<|im_start|>", "<|im_end|>"
HALVES = ("s0", "s1", "s2", "s3")
LOW = 0xFFFFFFFF


def _numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, chunk, position from 1, role, text)."""
    turns = conversations.where("conv_id is not null").select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 40))).alias("chunk"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text"))
    ranked = turns.withColumn("rank", rank).join(offsets, ["conv_id", "chunk"])
    return ranked.select("conv_id", "chunk", (F.col("offset") + F.col("rank")).alias("position"), "role", "text")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, s0..s3): the rolling hash up to each turn."""
    first, second = F.xxhash64("position", "role", "text"), F.xxhash64("text", "role", "position", F.lit(1))
    halves = [
        f(h).alias(name)
        for name, (h, f) in zip(
            HALVES,
            [(h, f) for h in (first, second) for f in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(LOW)))],
        )
    ]
    hashed = turns.select("conv_id", "chunk", "position", *halves)
    inside = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("size"), *[F.sum(h).alias(h) for h in HALVES])
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "conv_id", "chunk", F.sum("size").over(whole).alias("n_turns"),
        *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(f"{h}_before") for h in HALVES],
    )
    running = hashed.select("conv_id", "chunk", "position", *[F.sum(h).over(inside).alias(h) for h in HALVES])
    return running.join(offsets, ["conv_id", "chunk"]).select(
        "conv_id", "position", "n_turns", *[(F.col(h) + F.col(f"{h}_before")).alias(h) for h in HALVES]
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged) of the logs that no other one continues; n_logged counts equal logs."""
    prefixes = stored(_prefixes(turns), "prefixes")
    key = ["position", *HALVES]
    logs = prefixes.where("position = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    continued = prefixes.where("position < n_turns").select(*key).distinct()
    return logs.join(continued, key, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "n_logged")


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged and the rendered chat of each maximal conversation."""
    turns = stored(_numbered_turns(conversations), "turns")
    kept = maximal_conversations(turns)
    safe = [F.regexp_replace(c, r"<\|im_(start|end)\|>", r"<| im_$1 |>") for c in ("role", "text")]
    segment = F.concat(F.lit(START), safe[0], F.lit("\n"), safe[1], F.lit(f"{END}\n"))
    pieces = turns.join(kept.select("conv_id"), "conv_id", "left_semi").select(
        "conv_id", "chunk", F.struct("position", segment.alias("segment")).alias("piece")
    )
    ordered = F.array_join(F.sort_array(F.collect_list("piece")).getField("segment"), "")
    chunks = pieces.groupBy("conv_id", "chunk").agg(ordered.alias("segment"))
    chats = chunks.select("conv_id", F.struct("chunk", "segment").alias("piece")).groupBy("conv_id").agg(ordered.alias("chat"))
    return kept.join(chats, "conv_id").select("conv_id", "n_turns", "n_logged", "chat")
