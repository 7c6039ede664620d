"""Chat formatting with a collapse of cumulative snapshots, in DataFrame functions only.

A log often holds a conversation many times, each time some turns longer. Every turn is
hashed with its place, and the hashes are added up from a conversation's first turn on,
so the sum after turn k stands for its first k turns. A conversation whose last sum is
some longer one's sum at the same place is a snapshot of it; an anti-join drops those. Of
equal conversations the one with the smallest conv_id stays. The rest are rendered from a
template.

Scale. Turns are dealt to ranges of (conv_id, turn, role, opening of the text), so a
conversation with a third of all turns is numbered, hashed and added up in many tasks;
what a range adds to the next is one small row for it and conversation. Work and memory
grow with the turns, not with their square. Equal conversations and equal prefixes are
pre-aggregated before the anti-join. Only the turns of conversations that stay are
gathered, one conversation a row, since a row is what is asked for.

Defined results. A null conv_id has no identity: such rows are left out. Turns sort by
turn (nulls first), role, text; repeated rows are turns of their own. Null role or text
hashes apart from an empty one and renders as empty. An empty table gives no rows.
Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import discard, keyed, materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ORDER = ["turn", "role", "text"]


def _digests(place: Column) -> list[Column]:
    """Two 60-bit numbers of a turn and its place."""
    mark = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    h = F.sha2(F.concat_ws("/", place.cast("string"), mark(F.col("role")), mark(F.col("text"))), 256)
    return [F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]


def _carried(rows: DataFrame, **sums: Column) -> DataFrame:
    """conv_id, _part and, for each sum, what the ranges before this one add up to."""
    per = rows.groupBy("conv_id", "_part").agg(*[c.alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("conv_id", "_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(n) for n in sums])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place and hash of the turns up to each place of each conversation."""
    rows = keyed(turns, "conv_id", *_ORDER).where("conv_id IS NOT NULL")
    dealt = materialize(rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).withColumn("_part", F.spark_partition_id()), "dealt")
    local = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*_ORDER)))
    placed = local.join(_carried(dealt, count=F.count("*")), ["conv_id", "_part"]).withColumn("place", F.col("_k") + F.col("count"))
    one, two = _digests(F.col("place"))
    hashed = materialize(placed.select("conv_id", "_part", "place", one.alias("a"), two.alias("b")), "hashed")
    upto = Window.partitionBy("conv_id", "_part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    added = hashed.withColumns({c: F.sum(c).over(upto) for c in "ab"}).join(_carried(hashed, before_a=F.sum("a"), before_b=F.sum("b")), ["conv_id", "_part"])
    total = lambda c: (F.col(c) + F.col(f"before_{c}")).cast("string")
    out = materialize(added.select("conv_id", "place", F.concat_ws("/", F.col("place").cast("string"), total("a"), total("b")).alias("hash")), "prefixes")
    discard(dealt)
    discard(hashed)
    return out


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no snapshot of a longer one, one of each equal kind."""
    every = prefixes(turns)
    ends = every.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by("hash", "place").alias("hash"))
    kinds = ends.groupBy("hash").agg(F.min(F.struct("conv_id", "n_turns")).alias("m"))
    shorter = every.join(ends.select("conv_id", "n_turns"), "conv_id").where("place < n_turns").select("hash").distinct()
    return kinds.join(shorter, "hash", "left_anti").select("m.conv_id", F.col("m.n_turns").cast("long").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, open_: str = OPEN, close: str = CLOSE) -> DataFrame:
    """conv_id, n_turns, rendered of the kept conversations (conv_id, n_turns)."""
    rows = keyed(turns, "conv_id", *_ORDER).join(kept, "conv_id")
    whole = rows.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct(*_ORDER))).alias("turns"))
    line = lambda t: F.concat(F.lit(open_), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(close + "\n"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    return render(turns, materialize(maximal(turns), "kept"))


SQL = """
WITH c AS (SELECT conv_id, count(*) AS n_turns,
                  list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
                  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT DISTINCT turns[1:k] AS prefix FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c))
SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, any_value(rendered) AS rendered
FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = c.turns) GROUP BY turns
"""
