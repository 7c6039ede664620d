"""Vector search: the nearest items per category, one per creator, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions.vectors import dot, half
from quillspan.sources.scratch import dropped, staged

QUERY_BYTES = 16 << 20  # of query vectors in a block
ITEM_ROWS = 50_000  # in a block
CELLS = 2 << 20  # of a score matrix
RANKED = 500_000  # candidate rows that a task sorts, about
TASKS = 200  # at most: up to as many, Spark writes a shuffle without holding rows
_OUT = pa.schema([("qid", pa.int64()), ("category", pa.int32()), ("id", pa.int64()), ("creator", pa.int64()), ("score", pa.float64())])
_ITEM = ["id", "category", "creator", "title", "vector", "penalty"]
_QUERY = ["qid", "qcategory", "qcreator", "qtitle", "qvector", "qexclude"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _ints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


@dataclass(frozen=True)
class Rule:
    """A caller's rule: skip(queries, items) is given the named columns of some queries and items as
    dicts of arrays, and returns which items (columns) each query (row) may not find. An item's
    columns and a query's have different names."""

    skip: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]
    query_columns: tuple[str, ...] = ()
    item_columns: tuple[str, ...] = ()


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_pandas())


class _Queries:
    """A block of queries: arrays, and the (query, item) pairs that a query leaves out."""

    def __init__(self, table: pa.Table, rule: Rule | None) -> None:
        self.own = {c: _values(table.column(c)) for c in (rule.query_columns if rule else ())}
        self.id, self.category, self.creator, self.title = (_ints(table.column(c)) for c in ("qid", "qcategory", "qcreator", "qtitle"))
        self.vector = _matrix(table.column("qvector"))
        self.exclude = table.column("qexclude").to_pylist()


def _best(items: pa.Table | pa.RecordBatch, q: _Queries, same: int, other: int, per_creator: bool, own: bool, digits: int | None, rule: Rule | None = None) -> Iterator[pa.RecordBatch]:
    """The rows that can be among a query's best of these items: of each category, the ones that
    reach its k-th best score, and one a creator. A matrix of CELLS scores is held at a time."""
    columns = [_ints(items.column(c)) for c in ("id", "category", "creator", "title", "penalty")]
    order = np.lexsort((columns[0], columns[2], columns[1]))
    ids, category, creator, title, penalty = (c[order] for c in columns)
    vectors = _matrix(items.column("vector"))[order]
    groups = np.stack([category, creator if per_creator else ids])
    starts = np.flatnonzero(np.r_[True, (groups[:, 1:] != groups[:, :-1]).any(axis=0)])
    sizes, kinds = np.diff(np.r_[starts, len(ids)]), category[starts]
    place = np.arange(len(ids))
    told = {c: _values(items.column(c))[order] for c in (rule.item_columns if rule else ())}
    row_of = {k: i for i, k in enumerate(ids.tolist())} if any(q.exclude) else {}
    step = max(1, CELLS // len(ids))
    for at in range(0, len(q.id), step):
        part = slice(at, at + step)
        s = q.vector[part] @ vectors.T - penalty
        if digits is not None:
            s = np.round(s, digits)
        if own:
            s[(q.id[part, None] == ids) | (q.creator[part, None] == creator) | (q.title[part, None] == title)] = -np.inf
        if rule:
            s[np.broadcast_to(rule.skip({c: v[part] for c, v in q.own.items()}, told), s.shape)] = -np.inf
        for i, gone in enumerate(q.exclude[part]):
            cols = [row_of[g] for g in gone or () if g in row_of]
            s[i, cols] = -np.inf
        best = np.maximum.reduceat(s, starts, axis=1)
        for kind in np.unique(kinds):
            cols = np.flatnonzero(kinds == kind)
            k = np.where(q.category[part] == kind, same, other)
            few = best[:, cols]
            top = min(max(same, other), len(cols))
            high = -np.partition(-few, top - 1, axis=1)[:, :top]
            high.sort(axis=1)
            cut = high[np.arange(len(few)), np.clip(top - k, 0, top - 1)]
            a, b = np.nonzero((few >= np.maximum(cut, -1e300)[:, None]) & (k > 0)[:, None])
            if not len(a):
                continue
            g = cols[b]
            # the first item of the group that has its best score: the smallest id
            first = np.array([starts[y] + int(np.argmax(s[x, starts[y] : starts[y] + sizes[y]])) for x, y in zip(a, g, strict=True)]) if per_creator else place[starts[g]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([q.id[part][a], category[first], ids[first], creator[first], few[a, b]], _OUT.types, strict=True)], schema=_OUT)


def _dealt(rows: DataFrame, number: int, *keys: str) -> DataFrame:
    """About `number` rows by a hash of the keys, RANKED to a task: what a task sorts doesn't follow the input."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(TASKS, max(least, -(-number // RANKED)))), *keys)


def scores(items: DataFrame, queries: DataFrame, same: int, other: int | None = None, per_creator: bool = True, own: bool = False, digits: int | None = 6, rule: Rule | None = None) -> DataFrame:
    """Candidate rows qid, category, id, creator, score: a superset of each query's best items,
    `same` of its own category and `other` (same, if None) of each other one, one per creator,
    from products in double precision less the item's penalty, rounded to `digits` if told.
    The queries are written before this returns, as their size decides the plan.

    items: id, category, creator, vector, penalty and, if there is one, title. queries: qid,
    qcreator, qvector and, if there are any, qcategory, qtitle, qexclude (ids never to be
    found). With own, an item with the query's id, creator or title is skipped. Titles are
    compared by a 64-bit hash. What a rule skips isn't found either.

    Queries that fit QUERY_BYTES are broadcast to the items' partitions. More of them are dealt
    to blocks of that size, as items are to blocks of ITEM_ROWS, and every pair of blocks is
    one group: rows move as often as there are blocks on the other side. The result lies by qid and
    category, so ranks within them need no further shuffle.
    """
    other = same if other is None else other
    titled = F.xxhash64("title") if "title" in items.columns else F.col("id")
    things = items.select("id", F.col("category").cast("int").alias("category"), F.col("creator").cast("long").alias("creator"), titled.alias("title"), "vector", F.col("penalty").cast("double").alias("penalty"), *(rule.item_columns if rule else ()))
    has = lambda c, v: F.col(c) if c in queries.columns else F.lit(v)
    qtitle = F.xxhash64("qtitle") if "qtitle" in queries.columns else F.col("qid")
    asked = queries.select("qid", has("qcategory", -1).cast("int").alias("qcategory"), F.col("qcreator").cast("long").alias("qcreator"), qtitle.alias("qtitle"), F.transform("qvector", lambda x: x.cast("double")).alias("qvector"), has("qexclude", None).cast("array<long>").alias("qexclude"), *(rule.query_columns if rule else ()))
    asked = staged(asked, "queries")
    size, asks = asked.agg(F.sum(8 * F.size("qvector") + 8 * F.coalesce(F.size("qexclude"), F.lit(0)) + 64), F.count("*")).first()
    size, (count, kinds) = size or 0, things.agg(F.count("*"), F.count_distinct("category")).first()
    found = lambda blocks: asks * min(count, kinds * max(same, other) * blocks)  # rows of the result, about
    schema = "qid long, category int, id long, creator long, score double"
    if size <= QUERY_BYTES:
        block = asked.sparkSession.sparkContext.broadcast(asked.orderBy("qid").toArrow())  # its size is checked above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = _Queries(block.value, rule)
            for batch in batches:
                for at in range(0, batch.num_rows if len(q.id) else 0, ITEM_ROWS):
                    yield from _best(batch.slice(at, ITEM_ROWS), q, same, other, per_creator, own, digits, rule)

        batches = asked.sparkSession.sparkContext.defaultParallelism + count // int(asked.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return _dealt(things.mapInArrow(run, schema), found(batches), "qid", "category")

    qblocks, iblocks = -(-size // QUERY_BYTES), max(1, -(-count // ITEM_ROWS))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    nothing = lambda df, names: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    of_query, of_item = [*_QUERY, *(rule.query_columns if rule else ())], [*_ITEM, *(rule.item_columns if rule else ())]
    left = asked.select(*of_query, *nothing(things, of_item), F.pmod(F.xxhash64("qid"), F.lit(qblocks)).alias("_q")).withColumn("_i", spread(iblocks))
    right = things.select(*nothing(asked, of_query), *of_item, F.pmod(F.xxhash64("id"), F.lit(iblocks)).alias("_i")).withColumn("_q", spread(qblocks))

    def pair(table: pa.Table) -> pa.Table:
        asks = table.column("qid").is_valid()
        q, rows = table.filter(asks), table.filter(pc.invert(asks))
        out = [] if not q.num_rows or not rows.num_rows else list(_best(rows, _Queries(q, rule), same, other, per_creator, own, digits, rule))
        return pa.Table.from_batches(out, schema=_OUT)

    blocks = left.unionByName(right).repartition(min(TASKS, qblocks * iblocks), "_q", "_i")
    return _dealt(blocks.groupBy("_q", "_i").applyInArrow(pair, schema), found(iblocks), "qid", "category")


def nearest(items: DataFrame, queries: DataFrame, k: int, per_creator: bool = True, own: bool = False, other: int | None = None, rule: Rule | None = None) -> DataFrame:
    """qid, category, id, score, place: the best per category; equal scores in id order. With
    `other`, k counts in the query's own category (qcategory) and other in the rest."""
    rows = scores(items, queries, k, other, per_creator, own, rule=rule)
    best = [F.desc("score"), F.asc("id")]
    if per_creator:
        rows = rows.withColumn("_c", F.row_number().over(W.partitionBy("qid", "category", "creator").orderBy(*best))).where("_c = 1")
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("qid", "category").orderBy(*best)))
    if other is not None and other != k:
        rows = rows.join(queries.select("qid", "qcategory"), "qid").where(F.col("place") <= F.when(F.col("category") == F.col("qcategory"), k).otherwise(other))
    return rows.where(F.col("place") <= max(k, other or 0)).select("qid", "category", "id", "score", "place")


def representative(items: DataFrame, *group: str) -> DataFrame:
    """group, id, score: the item with the largest product with its group's summed vector; the
    first id wins a tie. Sums are pre-aggregated by dimension, and the join's side is theirs to choose."""
    total = items.select(*group, F.posexplode("vector").alias("d", "x")).groupBy(*group, "d").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = total.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))
    rows = items.join(total, list(group)).withColumn("score", F.round(dot(F.col("vector"), F.col("total")), 6))
    return rows.groupBy(*group).agg(F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("id"), F.max("score").alias("score"))


def wins(items: DataFrame, queries: DataFrame) -> DataFrame:
    """id, category, penalty, wins: how often an item is among its category's two best (no rule
    about creators here)."""
    n = nearest(items, queries, 2, per_creator=False).groupBy("id").agg(F.count("*").alias("wins"))
    return items.select("id", "category", "penalty").join(n, "id", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def shortlists(items: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """qid, category, id, raw, least: each query's `size` best items of each category by the product
    alone, and the product that no other item of the category exceeds (null if there is none)."""
    raw = scores(items.withColumn("penalty", F.lit(0.0)), queries, size + 1, per_creator=False, digits=None)
    ranked = raw.withColumn("_p", F.row_number().over(W.partitionBy("qid", "category").orderBy(F.desc("score"), "id"))).where(F.col("_p") <= size + 1)
    least = F.max(F.when(F.col("_p") > size, F.col("score"))).over(W.partitionBy("qid", "category"))
    return ranked.withColumn("least", least).where(F.col("_p") <= size).select("qid", "category", "id", F.col("score").alias("raw"), "least")


def wins_of(short: DataFrame, items: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wins() from shortlists, and the queries (qid) that were searched anew: those with a category
    where an item off the list could reach the second place, whatever its penalty (at least the
    category's smallest) is."""
    smallest = items.groupBy("category").agg(F.min("penalty").alias("_free"))  # a row a category
    rows = short.join(items.select("id", "penalty"), "id").join(F.broadcast(smallest), "category")
    rows = _dealt(rows, short.count(), "qid", "category")
    rows = rows.withColumn("score", F.round(F.col("raw") - F.col("penalty"), 6)).withColumn("_most", F.round(F.col("least") - F.col("_free"), 6))
    rows = rows.withColumn("_p", F.row_number().over(W.partitionBy("qid", "category").orderBy(F.desc("score"), "id"))).where("_p <= 2")
    places = staged(rows.select("qid", "category", "id", F.col("_p").alias("place"), (F.col("_most").isNotNull() & (F.col("score") <= F.col("_most"))).alias("_open")), "places")
    anew = staged(places.where("_open").select("qid").distinct(), "searched-anew")
    found = places.join(anew, "qid", "left_anti").select("id")
    if not anew.isEmpty():
        found = found.union(nearest(items, queries.join(anew, "qid", "left_semi"), 2, per_creator=False).select("id"))
    n = found.groupBy("id").agg(F.count("*").alias("wins"))
    return items.select("id", "category", "penalty").join(n, "id", "left").withColumn("wins", F.coalesce("wins", F.lit(0))), anew


def exposure(items: DataFrame, queries: DataFrame, rounds: int = 6, beta: float = 0.02, size: int = 16) -> DataFrame:
    """id, category, penalty: each round counts wins and moves the penalty half way to
    beta * log(share), where share is an item's wins over its category's mean, each plus one.
    The last penalty is rounded to half precision, as it is stored; in between, to eight places.

    All pairs are scored once, for lists of `size` items a query and category; penalties move the
    places on them. Only a query whose list may miss a winner is searched again in a round."""
    every = staged(items, "items")
    asked = staged(queries, "queries")
    penalty = staged(every.select("id", F.col("penalty").cast("double").alias("penalty")), "penalty")
    short = staged(shortlists(every, asked, size), "shortlists")
    for k in range(rounds):
        counted, _ = wins_of(short, every.drop("penalty").join(penalty, "id"), asked)
        mean = F.avg("wins").over(W.partitionBy("category"))
        step = F.lit(beta) * F.log(F.greatest((F.col("wins") + 1) / (mean + 1), F.lit(1.0)))
        moved = F.round(0.5 * F.col("penalty") + 0.5 * step, 8)
        after = staged(counted.select("id", (half(moved) if k == rounds - 1 and rounds > 1 else moved).alias("penalty")), "penalty")
        dropped(penalty)
        penalty = after
    return every.select("id", "category").join(penalty, "id").select("id", "category", "penalty")


def concentration(counted: DataFrame, wins_: str = "wins", part: int = 100) -> DataFrame:
    """One row: the mean over categories of the share of all wins that the most frequent
    1 / part of a category's items take (rounded down: a small category has none), and the most wins."""
    rows = counted.withColumn("_r", F.row_number().over(W.partitionBy("category").orderBy(F.desc(wins_), "id"))).withColumn("_n", F.count("*").over(W.partitionBy("category")))
    top = F.coalesce(F.sum(F.when(F.col("_r") <= F.floor(F.col("_n") / part), F.col(wins_))), F.lit(0))
    each = rows.groupBy("category").agg((top / F.nullif(F.sum(wins_), F.lit(0))).alias("share"), F.max(wins_).alias("most"))
    return each.agg(F.avg("share").alias("share"), F.max("most").alias("most"))


def flat(found: DataFrame, *keys: Column | str) -> DataFrame:
    """keys and ids: each query's finds as one list, category by category, best first."""
    row = F.struct("category", "place", "id")
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["id"]).alias("ids"))
