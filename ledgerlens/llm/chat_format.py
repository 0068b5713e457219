"""Chat formatting after cumulative snapshots have collapsed, on DataFrames only.

A logged conversation that is a prefix of a longer one, turn by turn in role
and text, is a snapshot of it and goes; of equal conversations the one of least
conv_id stays.  What stays is rendered with role markers.

Method
------
The hash of a prefix is the exclusive or of two 64-bit hashes of (position,
role, text) over its turns, so it rolls along a window and can be put together
from blocks: positions and hashes run within blocks of ``BLOCK`` turn numbers,
and a row for each block carries them on, so a conversation that holds a third
of all rows is spread over many tasks.  Whole-conversation hashes are
anti-joined with the distinct prefix hashes of longer ones (an opening that
many conversations share is one row there).

Whatever the turn numbers, a rendered conversation is one row for each
``PART_TURNS`` turns in order (part 0, 1, ...), so no row grows without bound.
Only conversations of several blocks are dealt anew for that.

Edge cases: rows without conv_id belong to no conversation and are left out;
turns sort by number, then role and text, null numbers first; repeated rows are
one turn; null roles and texts are empty; a marker inside a text is broken up
by a blank; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
PART_TURNS = 1024
START, END = "<|im_start|>", "<|im_end|>"


def maximal_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, block, n_blocks, pos, role, text, n_turns) of every turn of the conversations that stay.

    Texts are dealt once, by conversation and block; windows, joins and the rendering that follow keep to that.
    """
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long")).repartition("conv_id", "block").distinct()

    here = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = rows.withColumn("nth", F.row_number().over(here)).join(counts.select("conv_id", "block", "before"), ["conv_id", "block"])
    placed = placed.select("conv_id", "block", (F.col("before") + F.col("nth")).alias("pos"), "role", "text")
    placed = placed.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "pos", "role"))

    rolling = Window.partitionBy("conv_id", "block").orderBy("pos")
    blocks = placed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.max("pos").alias("last"))
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)).alias("e1"), F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)).alias("e2"),
        F.bit_xor("b1").over(whole).alias("w1"), F.bit_xor("b2").over(whole).alias("w2"), F.max("last").over(whole).alias("n_turns"), F.count("*").over(whole).alias("n_blocks"),
    )
    prefix = placed.select("conv_id", "block", "pos", F.bit_xor("h1").over(rolling).alias("r1"), F.bit_xor("h2").over(rolling).alias("r2")).join(blocks, ["conv_id", "block"])
    longer = prefix.filter("pos < n_turns").select(F.col("pos").alias("n_turns"), F.col("r1").bitwiseXOR(F.col("e1")).alias("w1"), F.col("r2").bitwiseXOR(F.col("e2")).alias("w2")).distinct()
    ends = blocks.groupBy("n_turns", "w1", "w2").agg(F.min("conv_id").alias("conv_id"))
    kept = ends.join(longer, ["n_turns", "w1", "w2"], "left_anti").select("conv_id", "n_turns")
    stay = blocks.select("conv_id", "block", "n_blocks").join(kept, "conv_id")
    return placed.select("conv_id", "block", "pos", "role", "text").join(stay, ["conv_id", "block"])


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered) of the conversations that stay."""
    clean = F.replace(F.replace("text", F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))
    piece = F.concat(F.lit(START), F.col("role"), F.lit("\n"), clean, F.lit(END + "\n"))
    rows = maximal_turns(turns).select("conv_id", "block", "n_blocks", F.floor((F.col("pos") - 1) / PART_TURNS).alias("part"), "n_turns", F.struct("pos", piece.alias("piece")).alias("piece"))
    pieces = F.sort_array(F.collect_list("piece")).alias("pieces")
    whole = rows.filter("n_blocks = 1").groupBy("conv_id", "block", "part", "n_turns").agg(pieces).drop("block")
    dealt = rows.filter("n_blocks > 1").groupBy("conv_id", "part", "n_turns").agg(pieces)
    return whole.unionByName(dealt).select("conv_id", "part", "n_turns", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"))


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """The maximal conversations of ``conversations``, rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS s FROM turns GROUP BY conv_id
), kept AS (
  SELECT * FROM whole a WHERE NOT EXISTS (
    SELECT 1 FROM whole b WHERE b.s[1] = a.s[1] AND (b.n > a.n OR (b.n = a.n AND b.conv_id < a.conv_id)) AND b.s[1:a.n] = a.s)
)
SELECT conv_id, CAST(p AS BIGINT) AS part, CAST(n AS BIGINT) AS n_turns, array_to_string(list_transform(s[1024 * p + 1:1024 * (p + 1)], lambda x:
  '<|im_start|>' || x.r || chr(10) || replace(replace(x.t, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10)), '') AS rendered
FROM (SELECT *, unnest(range(0, (n - 1) // 1024 + 1)) AS p FROM kept)
"""
