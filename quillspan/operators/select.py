"""Selection under quotas, caps and floors."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from quillspan.functions.text import UNKNOWN
from quillspan.sources.scratch import staged


def wanted(quota: float | Column, factor: float | Column) -> Column:
    """Candidates for a quota, rounded half to even on doubles."""
    number = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    return F.bround(number(quota) * number(factor)).cast("int")


def era_name(start: Column, end: Column) -> Column:
    return F.when(start > 0, F.concat_ws("-", start.cast("string"), end.cast("string"))).otherwise(F.concat(F.lit("before-"), (end + 1).cast("string")))


def eras(spark: SparkSession, table: list[tuple[int, int, int]]) -> DataFrame:
    """era, first, last, quota of a fixed list of year ranges, both ends included."""
    rows = spark.createDataFrame(table, "first int, last int, quota int")
    return rows.select(era_name(F.col("first"), F.col("last")).alias("era"), "first", "last", "quota")


def in_eras(rows: DataFrame, table: DataFrame, year: str) -> DataFrame:
    """rows with the era (era, quota) that their year lies in; other rows go. The table is a short
    list, so the range join is a broadcast of it."""
    return rows.join(F.broadcast(table), F.col(year).between(F.col("first"), F.col("last"))).drop("first", "last")


def class_targets(spark: SparkSession, total: int, shares: dict[str, float], fixed: dict[str, int]) -> DataFrame:
    """grp, target: total split by shares, each rounded half to even and the remainder given to the
    last class, beside groups of fixed size."""
    names = list(shares)
    split = {k: round(total * s) for k, s in shares.items()}
    split[names[-1]] += total - sum(split.values())
    return spark.createDataFrame([*split.items(), *fixed.items()], "grp string, target int")


def effective_targets(defaults: DataFrame, chosen: DataFrame) -> DataFrame:
    """grp, target: the defaults, overruled by what the chosen rows (grp, target) record."""
    own = chosen.where("target IS NOT NULL").groupBy("grp").agg(F.max("target").alias("own"))
    return defaults.join(own, "grp", "full_outer").select("grp", F.coalesce("own", "target").alias("target"))


def spread(rows: DataFrame, n: int, year: str, order: list[Column], factor: float = 1.0, by: str | None = None) -> DataFrame:
    """The best n rows (of each `by`), spread over years: a first pass takes at most
    ceil(factor * n / years) of a year, free places go to the best of the rest. Adds place.

    No row below the n-th of its year can be chosen, so each year is cut to n first (in many
    tasks, before the shuffle); what is left of a group is n rows a year.
    """
    group = [by] if by else []
    every, each = W.partitionBy(*group), W.partitionBy(*group, year)
    rows = rows.withColumn("_in_year", F.row_number().over(each.orderBy(*order))).where(F.col("_in_year") <= n)
    rows = rows.withColumn("_years", F.size(F.collect_set(year).over(every)))
    cap = F.greatest(F.lit(1), F.ceil(F.lit(factor * n) / F.col("_years")))
    rows = rows.withColumn("_fits", F.col("_in_year") <= cap)
    rows = rows.withColumn("_first", F.col("_fits") & (F.row_number().over(W.partitionBy(*group, "_fits").orderBy(*order)) <= n))
    rows = rows.withColumn("place", F.row_number().over(every.orderBy(F.desc("_first"), *order)))
    return rows.where(F.col("place") <= n).drop("_years", "_in_year", "_fits", "_first")


def with_floors(rows: DataFrame, n: int, floor: int, scene: str, year: str, order: list[Column], by: str) -> DataFrame:
    """The best `floor` rows of each scene are reserved, the other places of n spread over years:
    n rows of each `by`, with reserved and place. Free places depend on how many scenes a group
    has, so the rest is spread for the n it could be and cut to what is free."""
    ranked = rows.withColumn("_s", F.row_number().over(W.partitionBy(by, scene).orderBy(*order)))
    held = ranked.where(F.col("_s") <= floor).drop("_s")
    counts = held.groupBy(by).agg(F.count("*").alias("_held"))
    rest = ranked.where(F.col("_s") > floor).drop("_s").join(counts, by, "left").withColumn("_free", F.greatest(F.lit(n) - F.coalesce("_held", F.lit(0)), F.lit(0)))
    rest = rest.withColumn("_in_year", F.row_number().over(W.partitionBy(by, year).orderBy(*order))).where(F.col("_in_year") <= n)
    rest = rest.withColumn("_years", F.size(F.collect_set(year).over(W.partitionBy(by))))
    rest = rest.withColumn("_fits", F.col("_in_year") <= F.greatest(F.lit(1), F.ceil(F.col("_free") / F.col("_years"))))
    rest = rest.withColumn("_first", F.col("_fits") & (F.row_number().over(W.partitionBy(by, "_fits").orderBy(*order)) <= F.col("_free")))
    rest = rest.withColumn("_p", F.row_number().over(W.partitionBy(by).orderBy(F.desc("_first"), *order))).where(F.col("_p") <= F.col("_free"))
    out = held.withColumns({"reserved": F.lit(True), "_first": F.lit(True)}).unionByName(rest.withColumn("reserved", F.lit(False)).drop("_held", "_free", "_in_year", "_years", "_fits", "_p"))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("reserved"), F.desc("_first"), *order))
    return out.withColumn("place", place).drop("_first")


def capped(rows: DataFrame, n: int, cap: int, shape: list[str], maker: str, order: list[Column], unknown: str = UNKNOWN) -> DataFrame:
    """One per title shape, at most `cap` of a known maker, the first n. shape decides maker."""
    rows = rows.withColumn("_s", F.row_number().over(W.partitionBy(*shape).orderBy(*order))).where("_s = 1")
    rows = rows.withColumn("_m", F.row_number().over(W.partitionBy(maker).orderBy(*order))).where((F.col("_m") <= cap) | (F.col(maker) == unknown))
    return rows.orderBy(*order).limit(n).drop("_s", "_m")


def capped_by_class(rows: DataFrame, kind: str, sizes: dict[str, int], cap: int, shape: str, maker: str, order: list[Column], unknown: str = UNKNOWN) -> DataFrame:
    """capped() class by class in the order of sizes, which share shapes and makers: a shape that an
    earlier class took is gone, and its makers' places count. shape decides maker, and a class
    that is full looks at no further rows. Each class's picks are written, so plans stay short."""
    taken = None
    for name, n in sizes.items():
        own = rows.where(F.col(kind) == name)
        if taken is not None:
            had = taken.groupBy(maker).agg(F.count("*").alias("_had"))
            own = own.join(taken.select(shape).distinct(), shape, "left_anti").join(had, maker, "left")
        else:
            own = own.withColumn("_had", F.lit(0))
        own = own.withColumn("_s", F.row_number().over(W.partitionBy(shape).orderBy(*order))).where("_s = 1")
        place = F.row_number().over(W.partitionBy(maker).orderBy(*order)) + F.coalesce("_had", F.lit(0))
        own = own.withColumn("_m", place).where((F.col("_m") <= cap) | (F.col(maker) == unknown))
        picked = staged(own.orderBy(*order).limit(n).select(*rows.columns), "picked")
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


FEW = 100_000  # rows that one task may walk


def two_key_cap(rows: DataFrame, a: str, b: str, order: list[str], limit: int, seen: list[str] | None = None, few: int = FEW) -> DataFrame:
    """Greedy in order: a row stays if fewer than `limit` kept rows before it have its a, and fewer
    its b. With `seen`, it must also be the first row with these columns that would be kept.

    The counts interact, so plain windows give other rows. Each round decides what is certain: a
    row is kept once the undecided rows before it, all counted as kept, leave room in both of
    its groups, and dropped once a group is full of kept ones. Rows that no round touches wait
    for ones before them; the first undecided row is always decided, so rounds end. Only windows
    over a and b are needed, so a group of keys that are all connected is still worked on in many
    tasks. Once `few` rows are undecided, which chains of keys would decide one by one, one
    task walks them.
    """
    left, rounds, names = rows.withColumn("_k", F.struct(*order)), [], rows.columns
    before = lambda *c: F.row_number().over(W.partitionBy(*c).orderBy("_k")) - 1
    while True:
        kept = reduce(DataFrame.unionByName, [r.where("_sure").select(*names) for r in rounds]) if rounds else None
        now = left
        if kept is not None:  # these tables are small beside the input: rows that are kept
            for c, n in ((a, "_na"), (b, "_nb")):
                now = now.join(kept.groupBy(c).agg(F.count("*").alias(n)), c, "left").fillna(0, [n])
            now = now.where((F.col("_na") < limit) & (F.col("_nb") < limit))
            if seen:
                now = now.join(kept.select(*seen).distinct(), seen, "left_anti")
        else:
            now = now.withColumns({"_na": F.lit(0), "_nb": F.lit(0)})
        if rounds and rounds[-1]._undecided <= few:
            return kept.unionByName(_walked(now, a, b, limit, seen or [], names))
        sure = (F.col("_na") + before(a) < limit) & (F.col("_nb") + before(b) < limit)
        if seen:
            sure &= before(*seen) == 0
        rounds.append(staged(now.select(*names, "_k", sure.alias("_sure")), "round"))
        left = rounds[-1].where("NOT _sure").drop("_sure")
        rounds[-1]._undecided = left.count()
        if not rounds[-1]._undecided:
            return reduce(DataFrame.unionByName, [r.where("_sure").select(*names) for r in rounds])


def _walked(rows: DataFrame, a: str, b: str, limit: int, seen: list[str], names: list[str]) -> DataFrame:
    """The rows (FEW at most) that stay, by a walk in the order of _k; _na and _nb are the places that
    are taken of their groups."""
    kind = lambda c: F.to_json(F.struct(*c)) if c else F.lit(None).cast("string")
    one = rows.withColumn("_one", F.lit(0)).select("*", F.row_number().over(W.partitionBy("_one").orderBy("_k")).alias("_at"), kind([a]).alias("_a"), kind([b]).alias("_b"), kind(seen).alias("_seen")).drop("_k")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at").reset_index(drop=True)
        left, right, had, stays = {}, {}, set(), []
        for k, (x, y, na, nb, s) in enumerate(zip(frame["_a"], frame["_b"], frame["_na"], frame["_nb"], frame["_seen"], strict=True)):
            if left.setdefault(x, na) < limit and right.setdefault(y, nb) < limit and (s is None or s not in had):
                left[x] += 1
                right[y] += 1
                had.add(s)
                stays.append(k)
        return frame.loc[stays, names]

    return one.groupBy("_one").applyInPandas(walk, StructType([rows.schema[n] for n in names]))


def hash_order(seed: str, key: str) -> Column:
    """A fixed random order: a hash of seed and key."""
    return F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)


def best_by_flags(rows: DataFrame, group: str, flags: list[Column], seed: str, key: str, n: int) -> DataFrame:
    """The first n rows of each group, with place: those with the first flag first, then the second,
    ...; equals in hash order. Cut before the shuffle."""
    order = [F.desc(F.coalesce(f, F.lit(False))) for f in flags]
    rows = rows.withColumn("_h", hash_order(seed, key))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order, "_h", key))).where(F.col("place") <= n).drop("_h")


def _turns(rows: DataFrame) -> DataFrame:
    """rows with the least and the largest turn that they can be taken in: one more than the kept
    rows before them in their pool, and than those that may be kept."""
    before = W.partitionBy("_pool").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    sure, maybe = F.coalesce(F.sum(F.col("_sure").cast("int")).over(before), F.lit(0)), F.coalesce(F.count("*").over(before), F.lit(0))
    return rows.withColumns({"_least": sure + 1, "_most": maybe + 1})


def round_robin(rows: DataFrame, pool: str, place: list[Column], n: int, shape: str, maker: str, cap: int, unknown: str = UNKNOWN, few: int = FEW) -> DataFrame:
    """Pools take turns, in the order of their names, until n rows are taken: each takes its first row
    whose shape no pool has taken, and whose maker (unless unknown) has fewer than cap rows so
    far. A row that is passed over costs no turn; no pool takes more than ceil(2 n / pools).
    Pools may share rows. shape decides maker. Adds turn.

    A pool passes over a row only if its shape is taken or its maker is full. So of a pool only
    the first row of a shape and the first cap of a maker count, and of these the first
    ceil(2 n / pools) + 2 n, however large the pool is. The rest is decided in rounds: the turn
    of a row lies between those with none and with all of the open rows before it taken; a row is
    dropped if rows that surely come before it take its shape or fill its maker, and kept if
    no row that may come before it could. The earliest open row is always decided. Once
    `few` rows are left, one task walks them in their order.
    """
    pools = rows.select(pool).distinct().count()
    most = max(1, -(-2 * n // max(1, pools)))
    own = rows.withColumns({"_pool": F.col(pool), "_shape": F.col(shape), "_maker": F.when(F.col(maker) != unknown, F.col(maker)), "_order": F.struct(*place)})
    own = own.withColumn("_s", F.row_number().over(W.partitionBy("_pool", "_shape").orderBy("_order"))).where("_s = 1")
    own = own.withColumn("_m", F.row_number().over(W.partitionBy("_pool", "_maker").orderBy("_order"))).where((F.col("_m") <= cap) | F.col("_maker").isNull())
    own = own.withColumn("_place", F.row_number().over(W.partitionBy("_pool").orderBy("_order"))).where(F.col("_place") <= most + 2 * n)
    left = staged(own.drop("_s", "_m", "_order").withColumn("_sure", F.lit(False)), "pools")
    size = left.count()
    while size > few:
        now = staged(_turns(left).where(F.col("_least") <= most), "turns")
        if not now.where("NOT _sure").limit(1).count():
            left = now.drop("_least", "_most")
            break
        key = F.struct(F.col("_least").alias("a"), F.col("_most").alias("b"), F.col("_pool").alias("p"), F.col("_sure").alias("s"))
        held = lambda c: now.where(F.col(c).isNotNull()).groupBy(c).agg(F.collect_list(key).alias(f"{c}s"))  # noqa: E731  # a row a pool and shape; cap rows a pool and maker
        both = now.join(held("_shape"), "_shape").join(held("_maker"), "_maker", "left")
        sooner = lambda k: F.struct(k["b"], k["p"]) < F.struct("_least", "_pool")
        maybe = lambda k: F.struct(k["a"], k["p"]) < F.struct("_most", "_pool")
        other = lambda k: k["p"] != F.col("_pool")
        count = lambda c, test: F.coalesce(F.size(F.filter(c, test)), F.lit(0))
        gone = (count("_shapes", lambda k: k["s"] & sooner(k) & other(k)) > 0) | (F.coalesce(count("_makers", lambda k: k["s"] & sooner(k)), F.lit(0)) >= cap)
        free = (count("_shapes", lambda k: maybe(k) & other(k)) == 0) & (F.col("_makers").isNull() | (count("_makers", lambda k: maybe(k)) < cap))
        decided = both.where(F.col("_sure") | ~gone).withColumn("_sure", F.col("_sure") | free)
        left = staged(decided.select(*rows.columns, *[c for c in left.columns if c not in rows.columns and c != "_sure"], "_sure"), "pools")
        size = left.count()
    if size <= few:
        names = rows.columns

        def walk(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("_place")
            known = frame["_maker"].notna()
            heads = {p: list(zip(part.index, part["_shape"], part["_maker"], known[part.index], strict=True)) for p, part in sorted(frame.groupby("_pool"), key=lambda x: x[0])}
            at, taken, shapes, makers, out = dict.fromkeys(heads, 0), dict.fromkeys(heads, 0), set(), Counter(), []
            while len(out) < n:
                before = len(out)
                for p, mine in heads.items():
                    while taken[p] < most and at[p] < len(mine) and len(out) < n:
                        i, kind, who, named = mine[at[p]]
                        at[p] += 1
                        if kind not in shapes and not (named and makers[who] >= cap):
                            shapes.add(kind)
                            makers[who] += bool(named)
                            taken[p] += 1
                            out.append((i, taken[p]))
                            break
                if len(out) == before:
                    break
            return frame.loc[[i for i, _ in out]].assign(turn=[t for _, t in out])[[*names, "turn"]]

        one = left.select(*rows.columns, *[c for c in ("_pool", "_shape", "_maker", "_place") if c not in rows.columns]).withColumns({"_shape": F.col("_shape").cast("string"), "_maker": F.col("_maker").cast("string"), "_one": F.lit(0)})
        return one.groupBy("_one").applyInPandas(walk, StructType([*rows.schema.fields, StructField("turn", IntegerType())]))
    turns = left.withColumn("turn", F.row_number().over(W.partitionBy("_pool").orderBy("_place")))
    turns = turns.where(F.col("turn") <= most)
    return turns.orderBy("turn", "_pool").limit(n).select(*rows.columns, "turn")


def moved_quotas(groups: DataFrame, shares: list[float]) -> DataFrame:
    """grp, have, quota, filled, target: places that groups with movable quotas can't fill go to the
    others (in order of rank), by shares rounded half to even, and the rest to the last of them.

    groups: grp, have, quota, rank (null for those whose places move). A short list of groups."""
    rows = groups.withColumn("filled", F.when(F.col("rank").isNull(), F.least("have", "quota")).otherwise(F.col("quota")))
    free = rows.agg(F.sum(F.col("quota") - F.col("filled")).alias("_free"))
    part = [F.bround(F.col("_free").cast("double") * F.lit(s)).cast("long") for s in shares]
    rest = F.col("_free") - sum(part) if part else F.col("_free")
    extra = F.lit(0).cast("long")
    for k, p in enumerate([*part, rest], 1):
        extra = F.when(F.col("rank") == k, p).otherwise(extra)
    return rows.crossJoin(free).select("grp", "have", "quota", "filled", (F.col("filled") + extra).alias("target"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], target: int | Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= target)


def cutoffs(kept: DataFrame, group: str, key: list[str], targets: DataFrame) -> DataFrame:
    """group, cut: of each group (group, target) that is full, the key (a struct) of its last kept row."""
    k = F.struct(*key)
    ranked = kept.join(targets, group).withColumn("_p", F.row_number().over(W.partitionBy(group).orderBy(k)))
    return ranked.where(F.col("_p") == F.col("target")).select(group, k.alias("cut"))


def not_beaten(candidates: DataFrame, cuts: DataFrame, group: str, key: list[str]) -> DataFrame:
    """The candidates that come before their group's cutoff; all, if the group is not full."""
    return candidates.join(cuts, group, "left").where(F.col("cut").isNull() | (F.struct(*key) < F.col("cut"))).drop("cut")


def first_of_shape(rows: DataFrame, shape: list[str], order: list[Column]) -> DataFrame:
    """The first row of each title shape in the order of fetching."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*shape).orderBy(*order))).where("_k = 1").drop("_k")


def sampled(rows: DataFrame, group: str, key: str, sizes: dict[str, int], salt: str) -> DataFrame:
    """The first rows of each group in the order of a hash: a row that goes changes no other's place."""
    most = max(sizes.values(), default=0)
    size = F.coalesce(*[F.when(F.col(group) == g, n) for g, n in sizes.items()], F.lit(0))
    rows = rows.withColumn("_h", hash_order(salt, key))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("_h", key))).where((F.col("place") <= most) & (F.col("place") <= size)).drop("_h")


def ordered_union(*parts: DataFrame, key: str, order: str) -> DataFrame:
    """key, part, order of the first appearance of each key: part by part, by order within one."""
    every = None
    for k, p in enumerate(parts):
        one = p.select(key, F.lit(k).alias("part"), F.col(order).alias("order"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min(F.struct("part", "order")).alias("_m")).select(key, "_m.part", "_m.order")


def pool_fill(first: DataFrame, rest: DataFrame, key: str, size: int, order: Column) -> DataFrame:
    """key, filled: all of first's keys, and of the rest as many others as `size` has room for,
    in order."""
    have = first.select(key).distinct()
    room = size - have.count()
    others = rest.select(key).distinct().join(have, key, "left_anti")
    return have.withColumn("filled", F.lit(False)).union(others.orderBy(order, key).limit(max(room, 0)).withColumn("filled", F.lit(True)))


def unlike_ids(rows: DataFrame, id_: str, mark: str) -> DataFrame:
    """rows whose id several have get all "-mark" behind it, so none depends on the others' order."""
    n = F.count("*").over(W.partitionBy(id_))
    return rows.withColumn("_n", n).withColumn(id_, F.when(F.col("_n") > 1, F.concat_ws("-", id_, F.col(mark).cast("string"))).otherwise(F.col(id_))).drop("_n")


def numbered_ids(rows: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """rows whose id came before get -2, -3, ... in order; what comes out is not checked again."""
    k = F.row_number().over(W.partitionBy(id_).orderBy(*order))
    return rows.withColumn("_k", k).withColumn(id_, F.when(F.col("_k") > 1, F.concat_ws("-", id_, F.col("_k").cast("string"))).otherwise(F.col(id_))).drop("_k")
