"""Lookups with stated rules for duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT_BLOCK, RIGHT_BLOCK = 64, 1024  # rows of crossed() that meet as one, about: a task holds their pairs at once
RUN = 256  # values of the right that follow one value of the left


def first_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_v")).select(key, "_v.*")


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, "_v.*")


def truthy(value: Column) -> Column:
    """Null for an empty text or a zero, as for null."""
    return F.when((value.cast("string") != "") & (value.cast("string") != "0"), value)


def with_latest(rows: DataFrame, other: DataFrame, key: str, order: Column) -> DataFrame:
    """Inner join with the last row of each key in other."""
    return rows.join(last_wins(other, key, order), key)


def enriched(rows: DataFrame, key: str, extras: list[tuple[DataFrame, str, Column]]) -> DataFrame:
    """Left joins with the last row of each key in each extra (table, value, order); an empty or
    missing value gives null."""
    for other, value, order in extras:
        one = other.groupBy(key).agg(truthy(F.max_by(value, order)).alias(value))
        rows = rows.join(one, key, "left")
    return rows


def overlaid(base: DataFrame, over: DataFrame, key: str, fields: list[str], maps: list[str] = ()) -> DataFrame:
    """base's rows with over's fields where over has them; map columns are merged key by key, and
    over's entries win. A row of over whose key base lacks stays out."""
    cols = over.select(key, *[F.col(c).alias(f"_{c}") for c in [*fields, *maps]])
    rows = base.join(cols, key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.create_map().cast(base.schema[c.removeprefix("_")].dataType))

    def merge(m: str) -> Column:
        own, new = empty(m), empty(f"_{m}")
        return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k)), new).alias(m)

    merged = [merge(m) for m in maps]
    untouched = [F.col(c) for c in base.columns if c not in fields and c not in maps]
    return rows.select(*untouched, *[F.coalesce(f"_{c}", c).alias(c) for c in fields], *merged)


def refreshed(results: DataFrame, candidates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The results that are still candidates, with the candidates' current fields where they have
    them: a selection that changed keeps what was worked out and takes the new order."""
    cols = candidates.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    rows = results.join(cols, key)
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in results.columns])


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value (null if the key has several), owners."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("owners"), F.min(value).alias("_m")).select(key, F.when(F.col("owners") == 1, F.col("_m")).alias(value), "owners")


def pending(candidates: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Candidates that no table of results has."""
    for d in done:
        candidates = candidates.join(d.select(key).distinct(), key, "left_anti")
    return candidates


def known(rows: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key each table (table, key) has."""
    for t, key in tables:
        rows = rows.join(t.select(key).distinct(), key, "left_semi")
    return rows


def precedence(base: DataFrame, key: str, layers: list[tuple[DataFrame, str, Column]]) -> DataFrame:
    """key, origin (number of the layer), v: the value of the first layer (table, value, order) that
    has one; within a layer the later row wins."""
    for k, (layer, value, order) in enumerate(layers):
        base = base.join(layer.groupBy(key).agg(F.max_by(value, order).alias(f"_v{k}")), key, "left")
    names = [F.col(f"_v{k}") for k in range(len(layers))]
    origin = F.coalesce(*[F.when(v.isNotNull(), k) for k, v in enumerate(names)])
    return base.select(key, origin.alias("origin"), F.coalesce(*names).alias("v"))


def first_key_match(rows: DataFrame, tables: list[tuple[DataFrame, str]], value: str, default: str) -> DataFrame:
    """rows with value: of the first table (table, key; one row a key) that has the row's key."""
    for k, (t, key) in enumerate(tables):
        rows = rows.join(t.select(key, F.col(value).alias(f"_v{k}")), key, "left")
    return rows.withColumn(value, F.coalesce(*[F.col(f"_v{k}") for k in range(len(tables))], F.lit(default))).drop(*[f"_v{k}" for k in range(len(tables))])


def shared_rows(one: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """key, mine, theirs: the rows of two catalogues that both have the key."""
    return one.select(key, F.col(value).alias("mine")).join(other.select(key, F.col(value).alias("theirs")), key)


def within(left: DataFrame, right: DataFrame, on: str, a: str, b: str, width: int) -> DataFrame:
    """Pairs with equal `on` and |a - b| <= width: a range join on buckets of the width, so
    a pair meets in one of three neighbouring buckets (left has three copies) and no key is
    crossed with itself; a hot (key, bucket) is split by adaptive execution."""
    left = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(a) / width) + i for i in (-1, 0, 1)])))
    right = right.withColumn("_b", F.floor(F.col(b) / width))
    return left.join(right, [on, "_b"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_b")


def union_of(*tables: DataFrame) -> DataFrame:
    """All rows; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _in_blocks(rows: DataFrame, on: list[str], value: str, size: int) -> tuple[DataFrame, DataFrame]:
    """on, _block, and the values of about `size` rows; and on, _blocks: how many blocks there are. Values are
    dealt by their hash, so no task gathers a whole key."""
    sizes = rows.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, on).select(*on, F.struct(value).alias(f"_{value}"), F.pmod(F.xxhash64(value), "_blocks").cast("int").alias("_block"))  # a null stays in a struct
    return dealt.groupBy(*on, "_block").agg(F.collect_list(f"_{value}").alias(f"_{value}")), sizes


def _runs(values: Column) -> Column:
    """An array cut into arrays of RUN, with the last one cut after its last eighth value: Parquet packs values
    by eights, so what is repeated as eights is repeated as bytes, which its compression finds."""
    n = F.size(values)
    even = n - F.pmod(n, F.lit(8))
    full = F.transform(F.sequence(F.lit(0), F.floor((even - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, F.least(F.lit(RUN), even - k * RUN)))
    return F.concat(F.when(even > 0, full).otherwise(F.slice(F.array(values), 1, 0)), F.array(F.slice(values, even + 1, n - even)))


def crossed(left: DataFrame, right: DataFrame, a: str, b: str, on: list[str], links: DataFrame | None = None, to: list[str] | None = None) -> DataFrame:
    """Every pair of a left row's a and a right row's b with equal `on`; or, with links (on, to, and more
    columns, which are kept), whose `on` and `to` a link names. Nulls in `on` and `to` meet nothing.

    For joins whose result is as good as all that is to be done. Blocks of rows meet, and not rows, so
    what is shuffled grows with the result divided by LEFT_BLOCK * RIGHT_BLOCK, where keys have that many.
    A key's blocks lie in many tasks. Pairs come in runs of one a, and the same b follow each a of
    a block, so that a column format keeps them in little."""
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    to = to or on
    lefts, _ = _in_blocks(left, on, a, LEFT_BLOCK)
    rights, sizes = _in_blocks(right, to, b, RIGHT_BLOCK)
    met = lefts.drop("_block")
    told = [] if links is None else [c for c in links.columns if c not in (*on, *to)]
    if links is not None:
        met = met.join(links, on)
    met = met.join(sizes, to).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    where = [*to, "_block"]
    # merged, as that join holds the one block of the right and streams those of the left
    met = met.select(*where, f"_{a}", *told).repartition(tasks, *where).join(rights.repartition(tasks, *where).hint("merge"), where)
    each = met.select(f"_{a}", F.explode(_runs(F.col(f"_{b}"))).alias("_run"), *told)
    return each.select(F.inline(f"_{a}"), "_run", *told).select(a, F.inline("_run"), *told)
