"""Each registered query against its SQL, and hand-made cases."""

import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspan.functions import color, hashing, text
from quillspan.operators import joins, metrics, select
from quillspan.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(float(r[i]) if isinstance(r[i], Decimal) else r[i] for i in at) for r in want.fetchall()), key=repr)


def greedy(rows, limit):
    """The sequential rule: (key, a, b, seen) in order."""
    na, nb, seen, out = {}, {}, set(), []
    for k, a, b, x in sorted(rows):
        if na.get(a, 0) < limit and nb.get(b, 0) < limit and (a, x) not in seen:
            na[a], nb[b] = na.get(a, 0) + 1, nb.get(b, 0) + 1
            seen.add((a, x))
            out.append(k)
    return out


def test_two_key_cap_is_greedy(spark):
    import random

    rows = spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate([("A", 1), ("A", 2), ("B", 2), ("B", 1), ("C", 2)])], "i int, a string, n int")
    assert sorted(r.i for r in select.two_key_cap(rows, "a", "n", ["i"], 1).collect()) == [0, 2]
    assert select.two_key_cap(rows.limit(0), "a", "n", ["i"], 1).count() == 0
    rng = random.Random(5)
    for limit, na, nb in ((1, 9, 9), (3, 6, 11), (2, 30, 2)):
        made = [(k, rng.randrange(na), rng.randrange(nb), rng.randrange(4)) for k in range(160)]
        df = spark.createDataFrame(made, "k int, a int, b int, x int")
        assert sorted(r.k for r in select.two_key_cap(df, "a", "b", ["k"], limit, seen=["a", "x"]).collect()) == greedy(made, limit)


def test_spread_equals_the_sequential_rule(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([2000, 2001, 2002]), rng.randint(0, 5)) for i in range(40)]
    for n in (1, 7, 39, 60):
        cap, first, rest, per = max(1, math.ceil(n / len({y for _, y, _ in rows}))), [], [], {}
        for i, y, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
            if len(first) < n and per.get(y, 0) < cap:
                per[y] = per.get(y, 0) + 1
                first.append(i)
            else:
                rest.append(i)
        df = select.spread(spark.createDataFrame(rows, "i int, y int, k int"), n, "y", [F.desc("k"), F.asc("i")])
        assert [r.i for r in df.orderBy("place").collect()] == first + rest[: n - len(first)]


def test_rounding_hash_and_gates(spark):
    one = spark.range(1)
    r = one.select(select.wanted(450, 1.35).alias("a"), select.wanted(750, 1.35).alias("b"), select.wanted(10, 1.8).alias("c"), hashing.hash_fraction(F.lit("val:hello")).alias("h"),
                   metrics.at_least(F.lit(float("nan")), 0.05).alias("nan"), metrics.at_least(F.lit(None).cast("double"), 0.05).alias("null")).first()
    assert (r.a, r.b, r.c, r.h, r.nan, r["null"]) == (608, 1013, 18, 0.4621307752095163, False, False)


def test_normalise_and_season(spark):
    rows = spark.createDataFrame([("  “Hello, World!” …",), ("$5 bill.",), ("...",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.normalize_feeling(F.col("t"))).collect()] == ["hello, world", "$5 bill", "", None]
    months = spark.range(1, 13).select(color.season(F.col("id"), F.lit(False)).alias("n"), color.season(F.col("id"), F.lit(True)).alias("s")).collect()
    assert [r.n for r in months][:3] == ["winter", "winter", "spring"] and months[0].s == "summer"


def test_auc_of_ties_and_of_one_sided_groups(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("a", False, 1.0), ("b", True, 3.0)], "g string, fit boolean, s double")
    assert metrics.within_auc(rows, "g", "fit", "s").first().auc == 0.5
    assert metrics.within_auc(rows.where("g = 'b'"), "g", "fit", "s").first().auc is None


def test_range_join_meets_every_pair_once(spark):
    a = spark.createDataFrame([(1, 0), (1, 7), (1, -9)], "k int, a int")
    b = spark.createDataFrame([(1, 8), (1, 15), (1, -1), (2, 0)], "k int, b int")
    got = sorted((r.a, r.b) for r in joins.within(a, b, "k", "a", "b", 8).collect())
    assert got == [(-9, -1), (0, -1), (0, 8), (7, -1), (7, 8), (7, 15)]


def test_json_lines_tolerate_only_a_torn_tail(spark, tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    from quillspan.sources.io import json_lines

    schema = StructType([StructField("a", LongType())])
    (tmp_path / "good").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert sorted(r.a for r in json_lines(spark, str(tmp_path / "good"), schema).collect()) == [1, 2]
    (tmp_path / "bad").write_text('{"a": 1}\n{"a"\n{"a": 2}\n')
    with pytest.raises(ValueError):
        json_lines(spark, str(tmp_path / "bad"), schema)


def test_stream_put_if_absent(spark, tmp_path):
    from quillspan.streaming.puts import stream_into

    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    spark.createDataFrame([("a", 0)], "k string, at int").write.parquet(store)
    spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, at int").write.parquet(source)
    q = stream_into(spark.readStream.schema("k string, at int").parquet(source), store, str(tmp_path / "check"), "k", "at")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(store).collect())) == [("a", 0), ("b", 2)]


def test_pages_that_break_off_in_an_entity(spark, tmp_path):
    """html_clip decodes what its SQL decodes; other entities with a semicolon too."""
    ends = ["&", "&am", "&amp", "&amp;", "&quo", "&quot", "&quot;", "&copy", "&copy;", "&middot", "&middot;", "&ampx;", "&quotx;", "&x;", "&x&amp;y", "a" * 210 + "&quot"]
    made = [f"<p>one &amp; two {e}" for e in ends] + [f"{e} <b class='&quot'>{'word ' * 50}" for e in ends] + ["", "<p>", None]
    spark.createDataFrame(list(enumerate(made)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, QUERIES["html_clip"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(c.sql(SQL["html_clip"]).fetchall())
    more = spark.createDataFrame([("&lt;&#233;&#xE9;&eacute;&lt &eacute &#233 &bogus;",)], "t string")
    assert more.select(text.decode_ended_entities("t").alias("t")).first().t == "<ééé&lt &eacute &#233 &bogus;"
