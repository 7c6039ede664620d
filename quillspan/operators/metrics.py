"""Ranks, ranking metrics and gates. Ranks write the ranges that they deal rows to, so a call that
returns them runs a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.sources.scratch import staged

FIT, NON_FIT = 2.0, 0.5
SHIP_MARGIN, INSTALLED_MARGIN = 0.05, 0.01


def running(rows: DataFrame, order: list[Column | str], size: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with name: the sum of `size` over the rows up to them in `order`, which is unique, within
    `by`. Rows are dealt to ranges of (by, order), so a group that has most rows lies in many of
    them; sums within a range are offset by those of the group's ranges before it, and only one
    number a range comes together."""
    dealt = staged(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*by, "_range").agg(F.sum(size).alias("_held"))
    before = sizes.select(F.col("_range").alias("_of_range"), *[F.col(c).alias(f"_of_by{k}") for k, c in enumerate(by)], (F.sum("_held").over(W.partitionBy(*by).orderBy("_range")) - F.col("_held")).alias("_before"))
    inside = dealt.withColumn("_inside", F.sum(size).over(W.partitionBy(*by, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_of_range")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_of_by{k}"))
    return inside.join(before, same).withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_of_range", "_before", "_inside", *[f"_of_by{k}" for k in range(len(by))])


def ordinal(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with their place, from 1, in the order of a unique key."""
    return running(rows.withColumn("_one", F.lit(1)), [key], "_one", name).drop("_one")


def shared_ranks(rows: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value, name: ranks from 1 over all rows (of each `by`), equal values sharing their mean.
    Counts of values are ranked, not rows."""
    counts = running(rows.groupBy(*by, value).agg(F.count("*").alias("_c")), [value], "_c", "_upto", by)
    return counts.select(*by, value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))


def spearman(rows: DataFrame, one: str, other: str) -> DataFrame:
    """One row, rho: the correlation of shared ranks over all rows."""
    return rows.join(shared_ranks(rows, one, "_x"), one).join(shared_ranks(rows, other, "_y"), other).agg(F.corr("_x", "_y").alias("rho"))


def within_auc(rows: DataFrame, group: str, fit: str, score: str) -> DataFrame:
    """One row: pairs ordered right (ties half) over all fit/other pairs of a group; null if none. Rank
    sums come from the counts of (group, score), so no task holds a group."""
    counts = rows.groupBy(group, score).agg(F.count("*").alias("_c"), F.count_if(fit).alias("_p"), F.count_if(~F.col(fit)).alias("_o"))
    ranked = running(counts, [score], "_c", "_upto", (group,))
    g = ranked.groupBy(group).agg(F.sum(F.col("_p") * (F.col("_upto") - (F.col("_c") - 1) / 2)).alias("s"), F.sum("_p").alias("p"), F.sum("_o").alias("n"))
    return g.agg((F.sum(F.when(F.col("n") > 0, F.col("s") - F.col("p") * (F.col("p") + 1) / 2)) / F.nullif(F.sum(F.col("p") * F.col("n")), F.lit(0))).alias("auc"))


def objective(rows: DataFrame, group: str, rating: str, score: str, fit: float = FIT) -> DataFrame:
    """One row: auc, rho and their mean, -inf if it isn't finite; a score that is no finite number
    makes auc and rho NaN."""
    r = rows.withColumn("_fit", F.col(rating) >= fit)
    odd = rows.agg(F.count_if(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))).alias("_odd"))
    both = within_auc(r, group, "_fit", score).crossJoin(spearman(rows, rating, score)).crossJoin(odd)
    nan = lambda c: F.when(F.col("_odd") > 0, float("nan")).otherwise(F.coalesce(c, F.lit(float("nan")))).alias(c)
    out = both.select(nan("auc"), nan("rho"))
    return out.select("auc", "rho", F.coalesce(finite((F.col("auc") + F.col("rho")) / 2), F.lit(float("-inf"))).alias("objective"))


def finite(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def at_least(x: Column, margin: float) -> Column:
    """x >= margin, where null and NaN fail."""
    return F.coalesce(finite(x) >= margin, F.lit(False))


def ship_gate(student: Column, baseline: Column, new: Column | None = None, old: Column | None = None) -> Column:
    """struct<ok, reasons>: the student must lead the baseline, and not fall behind the installed
    one on the pairs that both have. Without an installed one only the lead counts."""
    lead = F.when(~at_least(student - baseline, SHIP_MARGIN), "lead")
    fall = F.lit(None).cast("string") if new is None else F.when(~at_least(new - old, -INSTALLED_MARGIN), "installed")
    reasons = F.filter(F.array(lead, fall), lambda r: r.isNotNull())
    return F.struct((F.size(reasons) == 0).alias("ok"), F.array_join(reasons, ",").alias("reasons"))


def worst(rows: DataFrame, group: str, rating: str, score: str, key: str, n: int = 25) -> DataFrame:
    """kind (missed or false), key, group, rating, place of the fits that their group ranks lowest and
    of the others that it ranks highest: a report of fixed length. place is 0 at the top, 1 at the bottom."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_size"))  # a row a group
    p = running(rows.withColumn("_one", F.lit(1)), [F.desc(score), key], "_one", "_k", (group,)).join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    p = p.withColumn("_place", (F.col("_k") - 1) / F.greatest(F.col("_size") - 1, F.lit(1)))
    missed = p.where(F.col(rating) >= FIT).orderBy(F.desc("_place"), score, key).limit(n).withColumn("kind", F.lit("missed"))
    false = p.where(F.col(rating) <= NON_FIT).orderBy("_place", F.desc(score), key).limit(n).withColumn("kind", F.lit("false"))
    return missed.unionByName(false).select("kind", key, group, rating, F.col("_place").alias("place"))


def label_metrics(rows: DataFrame, gap: str, choices: list[tuple[str, str]]) -> DataFrame:
    """One row: the mean of gap (null without a palette), and the share of right choices where there
    is a label, for pairs of columns (label, predicted)."""
    share = [F.avg(F.when(F.col(a).isNotNull(), F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0))).alias(f"{a}_accuracy") for a, b in choices]
    return rows.agg(F.avg(gap).alias("gap"), *share)


def prior_correction(rows: DataFrame, prior: DataFrame, taus: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75), loss: float = 0.02) -> DataFrame:
    """One row, tau and accuracy: the largest tau whose accuracy is at most `loss` below that of none.
    rows: logits (array) and label (an index); prior: one row, prior (an array)."""
    each = rows.crossJoin(prior).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    z = F.zip_with("logits", "prior", lambda x, p: x - F.col("tau") * F.log(p))
    right = each.withColumn("_z", z).withColumn("_c", F.array_position("_z", F.array_max("_z")) - 1)
    acc = right.groupBy("tau").agg(F.avg(F.when(F.col("_c") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))
    plain = acc.where("tau = 0").select(F.col("accuracy").alias("_plain"))
    return acc.crossJoin(plain).where(F.col("accuracy") >= F.col("_plain") - loss).agg(F.max("tau").alias("tau"), F.max_by("accuracy", "tau").alias("accuracy"))


def best_recipe(recipes: DataFrame, cap: int) -> DataFrame:
    """One row, name: the recipe (name, bytes, digest, score) under the size cap with the best score,
    then the smallest; recipes with one digest share the score that the first of them has."""
    fit = recipes.where(F.col("bytes") <= cap)
    first = fit.groupBy("digest").agg(F.min_by("score", "name").alias("_s"))
    score = F.coalesce(finite(F.col("_s")), F.lit(float("-inf")))
    return fit.join(first, "digest").agg(F.max_by("name", F.struct(score, -F.col("bytes"), F.col("name"))).alias("name"))


def fit_groups(ratings: DataFrame, splits: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """feeling, category, items, ratings: rated works of training feelings by category, padded with -1
    and 0 to width; groups whose works all have one rating go, as do unknown works."""
    rows = ratings.join(splits.where("split = 'train'").select("feeling"), "feeling", "left_semi").join(items, "item")
    g = rows.groupBy("feeling", "category").agg(F.array_sort(F.collect_list(F.struct("item", "rating"))).alias("_g"), F.count_distinct("rating").alias("_d")).where("_d > 1")
    pad = lambda c, v: F.slice(F.concat(F.transform("_g", lambda x: x[c]), F.array_repeat(F.lit(v), width)), 1, width)
    return g.select("feeling", "category", pad("item", -1).alias("items"), pad("rating", 0.0).alias("ratings"))


def listwise_targets(rows: DataFrame, group: list[str], rating: str, tau: float = 1.0) -> DataFrame:
    """rows with target: the softmax of rating / tau within each group."""
    w = W.partitionBy(*group)
    e = F.exp((F.col(rating) - F.max(rating).over(w)) / F.lit(tau))
    return rows.withColumn("_e", e).withColumn("target", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def useful_rows(rows: DataFrame) -> DataFrame:
    """Rows of the evaluation split, with a positive, a palette or a label; others teach nothing."""
    return rows.where((F.col("split") == "eval") | F.col("positive").isNotNull() | F.coalesce("has_palette", F.lit(False)) | F.coalesce("light", "face").isNotNull())
