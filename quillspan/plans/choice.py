"""Selection queries: orders stand in for ranked candidates by year, parts for works with makers,
lineitems for artist-name pools, documents by source for topic pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text
from quillspan.functions.text import UNKNOWN
from quillspan.operators import joins, select, state
from quillspan.plans.base import query
from quillspan.sources.io import table

_ERAS = [(-5000, 1995, 400), (1996, 1997, 222), (1998, 2100, 150)]
_ORDERS = "o AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, o_totalprice AS rank, CASE WHEN year(o_orderdate) <= 1995 THEN 'before--4999' WHEN year(o_orderdate) <= 1997 THEN '1996-1997' ELSE '1998-2100' END AS era, o_custkey FROM orders)".replace("'before--4999'", "'before-1996'")


def _ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("rank"), "o_custkey")
    return select.in_eras(o, select.eras(spark, _ERAS), "y")


def _best():
    return [F.desc("rank"), F.asc("o_orderkey")]


@query("WITH " + _ORDERS + """, y AS (SELECT *, row_number() OVER (PARTITION BY era, y ORDER BY rank DESC, o_orderkey) AS iny FROM o),
c AS (SELECT era, greatest(1, ceil(300.0 / count(DISTINCT y))) AS cap FROM o GROUP BY era),
f AS (SELECT y.*, iny <= cap AS fits FROM y JOIN c USING (era)),
p AS (SELECT *, fits AND row_number() OVER (PARTITION BY era, fits ORDER BY rank DESC, o_orderkey) <= 300 AS first FROM f),
r AS (SELECT era, o_orderkey, row_number() OVER (PARTITION BY era ORDER BY first DESC, rank DESC, o_orderkey) AS place FROM p)
SELECT era, o_orderkey, place::INT AS place FROM r WHERE place <= 300""")
def era_spread_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.spread(_ranked_orders(spark, sf_dir), 300, "y", _best(), by="era").select("era", "o_orderkey", "place")


@query("WITH " + _ORDERS + """, e AS (SELECT era, count(*) // 7 AS quota FROM o GROUP BY era), f AS (SELECT * FROM (VALUES ('film', 1.3::DOUBLE), ('song', 1.8::DOUBLE), ('book', 1.35::DOUBLE)) t(category, factor))
SELECT category || ':' || era AS grp, quota::INT AS quota, round_even(quota::DOUBLE * factor, 0)::INT AS wanted FROM e, f""")
def era_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by category and era with a seventh of the era's orders as quota, and how many candidates
    that asks for."""
    factors = spark.createDataFrame([("film", 1.3), ("song", 1.8), ("book", 1.35)], "category string, factor double")
    quotas = _ranked_orders(spark, sf_dir).groupBy("era").agg(F.floor(F.count("*") / 7).cast("int").alias("quota"))
    rows = quotas.crossJoin(F.broadcast(factors))
    return rows.select(F.concat_ws(":", "category", "era").alias("grp"), "quota", select.wanted(F.col("quota"), F.col("factor")).alias("wanted"))


@query("WITH " + _ORDERS + """, s AS (SELECT o.*, c_mktsegment AS scene, row_number() OVER (PARTITION BY era, c_mktsegment ORDER BY rank DESC, o_orderkey) AS s FROM o JOIN customer ON c_custkey = o_custkey),
k AS (SELECT *, s <= 18 AS reserved FROM s), free AS (SELECT era, greatest(290 - count(*) FILTER (WHERE reserved), 0) AS free FROM k GROUP BY era),
y AS (SELECT *, row_number() OVER (PARTITION BY era, y ORDER BY rank DESC, o_orderkey) AS iny FROM k WHERE NOT reserved),
c AS (SELECT y.era, greatest(1, ceil(any_value(free) / count(DISTINCT y))) AS cap, any_value(free) AS free FROM y JOIN free USING (era) GROUP BY y.era),
f AS (SELECT y.*, free, iny <= cap AS fits FROM y JOIN c USING (era)),
p AS (SELECT *, fits AND row_number() OVER (PARTITION BY era, fits ORDER BY rank DESC, o_orderkey) <= free AS first FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY first DESC, rank DESC, o_orderkey) AS q FROM p),
u AS (SELECT era, o_orderkey, rank, true AS reserved, true AS first FROM k WHERE reserved UNION ALL SELECT era, o_orderkey, rank, false, first FROM r WHERE q <= free)
SELECT era, o_orderkey, reserved, row_number() OVER (PARTITION BY era ORDER BY reserved DESC, first DESC, rank DESC, o_orderkey)::INT AS place FROM u""")
def scene_floor_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scene reserves 18 of an era's 290 places; the rest are spread over years."""
    o, c = _ranked_orders(spark, sf_dir), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "y", "rank", "era", F.col("c_mktsegment").alias("scene"))
    return select.with_floors(rows, 290, 18, "scene", "y", _best(), "era").select("era", "o_orderkey", "reserved", "place")


_SHAPE = "regexp_replace(regexp_replace(replace(lower(p_name), '&', 'and'), '[^a-z0-9]+', '', 'g'), '[0-9]+', '', 'g')"
_MAKER = "CASE WHEN p_brand = 'Brand#3' THEN 'Unknown artist' ELSE p_brand END"


@query("WITH p AS (SELECT p_partkey, p_retailprice, " + _SHAPE + " AS shape, " + _MAKER + """ AS maker FROM part), s AS (SELECT *, row_number() OVER (PARTITION BY shape, maker ORDER BY p_retailprice DESC, p_partkey) AS s FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY p_retailprice DESC, p_partkey) AS m FROM s WHERE s = 1)
SELECT p_partkey, maker FROM m WHERE m <= 8 OR maker = 'Unknown artist' ORDER BY p_retailprice DESC, p_partkey LIMIT 150""")
def maker_cap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of a title shape, eight of a known maker, the first 150."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", text.title_shape(F.col("p_name")).alias("shape"), F.expr(_MAKER).alias("maker"))
    return select.capped(p, 150, 8, ["shape", "maker"], "maker", [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "maker")


_CLASSES = {"PROMO": 60, "ECONOMY": 50, "SMALL": 40}


def _class_sql() -> str:
    """The classes one after another, each by the same rule over what the ones before left."""
    out = "WITH p AS (SELECT p_partkey, p_type, p_retailprice, " + _SHAPE + " || '/' || " + _MAKER + " AS shape, " + _MAKER + " AS maker FROM part)"
    for k, (name, n) in enumerate(_CLASSES.items()):
        before = " UNION ALL ".join(f"SELECT p_partkey, p_type, p_retailprice, shape, maker FROM t{j}" for j in range(k)) or "SELECT p_partkey, p_type, p_retailprice, shape, maker FROM p WHERE false"
        out += f""", b{k} AS ({before}), s{k} AS (SELECT p.*, row_number() OVER (PARTITION BY shape ORDER BY p_retailprice DESC, p_partkey) AS s FROM p WHERE p_type = '{name}' AND shape NOT IN (SELECT shape FROM b{k})),
m{k} AS (SELECT s{k}.*, row_number() OVER (PARTITION BY s{k}.maker ORDER BY p_retailprice DESC, p_partkey) + coalesce(had, 0) AS m FROM s{k} LEFT JOIN (SELECT maker, count(*) AS had FROM b{k} GROUP BY maker) h ON h.maker = s{k}.maker WHERE s = 1),
t{k} AS (SELECT * FROM m{k} WHERE m <= 8 OR maker = 'Unknown artist' ORDER BY p_retailprice DESC, p_partkey LIMIT {n})"""
    return out + " " + " UNION ALL ".join(f"SELECT p_partkey, p_type, maker FROM t{k}" for k in range(len(_CLASSES)))


@query(_class_sql())
def class_cap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes in turn that share title shapes and makers' places."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", text.title_shape(F.col("p_name")).alias("shape"), F.expr(_MAKER).alias("maker"))
    p = p.withColumn("shape", F.concat_ws("/", "shape", "maker"))
    return select.capped_by_class(p, "p_type", _CLASSES, 8, "shape", "maker", [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "p_type", "maker")


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS artist, l_suppkey // 10 * 1000 + l_partkey % 25 AS name, l_suppkey // 10 AS block, (l_suppkey % 10 + 1)::INT AS ai, (l_partkey % 25 + 1)::INT AS bi,
  row_number() OVER (PARTITION BY l_suppkey // 10 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem),
t AS (SELECT block, 0::BIGINT AS k, NULL::BIGINT AS l_orderkey, NULL::BIGINT AS l_linenumber, NULL::BIGINT AS artist, NULL::BIGINT AS name, [0 FOR x IN range(10)] AS na, [0 FOR x IN range(25)] AS nb, false AS ok FROM r GROUP BY block
  UNION ALL SELECT r.block, r.k, r.l_orderkey, r.l_linenumber::BIGINT, r.artist, r.name, CASE WHEN na[ai] < 3 AND nb[bi] < 3 THEN list_transform(na, lambda x, i: CASE WHEN i = ai THEN x + 1 ELSE x END) ELSE na END, CASE WHEN na[ai] < 3 AND nb[bi] < 3 THEN list_transform(nb, lambda x, i: CASE WHEN i = bi THEN x + 1 ELSE x END) ELSE nb END, na[ai] < 3 AND nb[bi] < 3
  FROM t JOIN r ON r.block = t.block AND r.k = t.k + 1 WHERE list_sum(na) < 30)
SELECT l_orderkey, l_linenumber::INT AS l_linenumber, artist, name FROM t WHERE ok""")
def two_key_cap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 lines per supplier and per name, greedily by price. (Names are made so that the
    SQL, which goes line by line, can go through blocks of ten suppliers side by side.)"""
    name = (F.floor(F.col("l_suppkey") / 10) * 1000 + F.pmod("l_partkey", F.lit(25))).alias("name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("artist"), name, (-F.col("l_extendedprice")).alias("price"))
    return select.two_key_cap(rows, "artist", "name", ["price", "l_orderkey", "l_linenumber", "l_partkey"], 3).select("l_orderkey", "l_linenumber", "artist", "name")


_ROBIN = """WITH RECURSIVE d AS (SELECT doc_id, n_chars % 460 AS shape, CASE WHEN n_chars % 460 % 23 > 0 THEN 'm' || n_chars % 460 % 23 ELSE 'Unknown artist' END AS maker, sha256('topic:' || doc_id) AS h, source, lang FROM documents WHERE n_chars IS NOT NULL),
p AS (SELECT 's:' || source AS pool, * FROM d WHERE source IS NOT NULL UNION ALL SELECT 'l:' || lang, * FROM d WHERE lang IS NOT NULL),
c AS (SELECT *, dense_rank() OVER (ORDER BY pool) - 1 AS k, row_number() OVER (PARTITION BY pool ORDER BY h, doc_id) AS place FROM p),
z AS (SELECT count(DISTINCT pool) AS pools, greatest(1, ceil(180.0 / count(DISTINCT pool))) AS most FROM c),
t AS (SELECT 0 AS step, NULL::STRUCT(place BIGINT, doc_id BIGINT, pool VARCHAR, shape BIGINT, maker VARCHAR, k BIGINT) AS pick, []::BIGINT[] AS shapes, []::VARCHAR[] AS makers, []::BIGINT[] AS took, 0 AS idle
  UNION ALL SELECT step + 1, pick, CASE WHEN pick IS NULL THEN shapes ELSE list_append(shapes, pick.shape) END, CASE WHEN pick IS NULL THEN makers ELSE list_append(makers, pick.maker) END,
    CASE WHEN pick IS NULL THEN took ELSE list_append(took, pick.k) END, CASE WHEN pick IS NULL THEN idle + 1 ELSE 0 END
  FROM (SELECT t.step, t.shapes, t.makers, t.took, t.idle, min(struct_pack(place := c.place, doc_id := c.doc_id, pool := c.pool, shape := c.shape, maker := c.maker, k := c.k)) FILTER (WHERE c.k IS NOT NULL) AS pick
    FROM t CROSS JOIN z LEFT JOIN c ON c.k = t.step % z.pools AND NOT list_contains(t.shapes, c.shape) AND (c.maker = 'Unknown artist' OR len(list_filter(t.makers, lambda m: m = c.maker)) < 3) AND len(list_filter(t.took, lambda m: m = c.k)) < z.most
    WHERE len(t.took) < 90 AND t.idle < z.pools GROUP BY ALL))
SELECT pick.doc_id AS doc_id, pick.pool AS pool, pick.shape AS shape, pick.maker AS maker, len(list_filter(took, lambda m: m = pick.k))::INT AS turn FROM t WHERE pick IS NOT NULL"""


@query(_ROBIN)
def topic_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools by source and by language share documents, shapes and makers; 90 of them in turns, one of
    each shape, three of a known maker."""
    d = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").selectExpr("doc_id", "source", "lang", "n_chars % 460 AS shape")
    d = d.withColumn("maker", F.when(F.col("shape") % 23 > 0, F.concat(F.lit("m"), F.col("shape") % 23)).otherwise(UNKNOWN))
    pools = d.withColumn("pool", F.explode(F.array(F.concat(F.lit("s:"), "source"), F.concat(F.lit("l:"), "lang")))).where("pool IS NOT NULL")
    order = [F.sha2(F.concat(F.lit("topic:"), F.col("doc_id").cast("string")), 256), F.col("doc_id")]
    return select.round_robin(pools, "pool", order, 90, "shape", "maker", 3).select("doc_id", "pool", "shape", "maker", "turn")


@query("""SELECT p_type, p_partkey, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size % 5 = 0 DESC, p_brand < 'Brand#15' DESC, p_retailprice > 1000 DESC, sha256('1337' || p_partkey), p_partkey) AS place FROM part) WHERE place <= 30""")
def highlight_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By highlight, picture and tags; equals in a fixed random order."""
    flags = [F.col("p_size") % 5 == 0, F.col("p_brand") < "Brand#15", F.col("p_retailprice") > 1000]
    return select.best_by_flags(table(spark, sf_dir, "part"), "p_type", flags, "1337", "p_partkey", 30).select("p_type", "p_partkey", "place")


@query("""WITH g AS (SELECT substr(p_brand, 1, 7) AS grp, count(*) AS have FROM part GROUP BY 1), w AS (SELECT *, CASE grp WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 WHEN 'Brand#3' THEN 3 END AS rank, least(have, 90) AS least_ FROM g),
v AS (SELECT *, CASE WHEN rank IS NULL THEN least_ ELSE 90 END AS filled FROM w), f AS (SELECT sum(90 - filled) AS free FROM v)
SELECT grp, have, filled, (filled + CASE rank WHEN 1 THEN round_even(free * 0.6::DOUBLE, 0) WHEN 2 THEN round_even(free * 0.25::DOUBLE, 0) WHEN 3 THEN free - round_even(free * 0.6::DOUBLE, 0) - round_even(free * 0.25::DOUBLE, 0) ELSE 0 END)::BIGINT AS target FROM v, f""")
def quota_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfilled places go to three other groups: 60 %, 25 % and the rest, rounded half to even."""
    g = table(spark, sf_dir, "part").groupBy(F.substring("p_brand", 1, 7).alias("grp")).agg(F.count("*").alias("have"))
    rank = F.expr("CASE grp WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 WHEN 'Brand#3' THEN 3 END")
    moved = select.moved_quotas(g.withColumn("quota", F.lit(90).cast("long")).withColumn("rank", rank), [0.6, 0.25])
    return moved.select("grp", "have", F.col("filled").cast("long").alias("filled"), F.col("target").cast("long").alias("target"))


@query("""WITH d AS (SELECT * FROM (VALUES ('a', 480), ('b', 241), ('c', 240), ('d', 242), ('aic', 500), ('nasa', 300)) t(grp, target)),
o AS (SELECT grp, max(target) AS own FROM (SELECT (['a', 'nasa', 'new'])[p_partkey % 3 + 1] AS grp, CASE WHEN p_partkey % 2 = 0 THEN 100 + p_partkey % 3 END AS target FROM part) WHERE target IS NOT NULL GROUP BY grp)
SELECT coalesce(d.grp, o.grp) AS grp, coalesce(own, target)::INT AS target FROM d FULL JOIN o ON d.grp = o.grp""")
def quota_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total split by shares with the remainder in the last class, then what chosen rows record."""
    defaults = select.class_targets(spark, 1203, {"a": 0.399, "b": 0.2, "c": 0.1995, "d": 0.2}, {"aic": 500, "nasa": 300})
    chosen = table(spark, sf_dir, "part").selectExpr("element_at(array('a', 'nasa', 'new'), cast(p_partkey % 3 + 1 AS int)) AS grp", "CASE WHEN p_partkey % 2 = 0 THEN cast(100 + p_partkey % 3 AS int) END AS target")
    return select.effective_targets(defaults, chosen)


_TOP = """SELECT o_orderpriority, o_orderkey, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 25"""


@query(_TOP)
def top_target_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_per_group(table(spark, sf_dir, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 25).select("o_orderpriority", "o_orderkey", "place")


@query(_TOP)
def cutoff_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, found in two batches: once a group is full, later rows that its last kept row
    beats are never ranked."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", (-F.col("o_totalprice")).alias("price"))
    first, later = o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0")
    targets = o.select("o_orderpriority").distinct().withColumn("target", F.lit(25))
    cuts = select.cutoffs(first, "o_orderpriority", ["price", "o_orderkey"], targets)
    rows = first.unionByName(select.not_beaten(later, cuts, "o_orderpriority", ["price", "o_orderkey"]))
    return select.top_per_group(rows, "o_orderpriority", [F.asc("price"), F.asc("o_orderkey")], 25).select("o_orderpriority", "o_orderkey", "place")


@query("""WITH c AS (SELECT d.doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, d.doc_id) AS place
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT doc_id, lang, place::INT AS place FROM c WHERE place <= 20""")
def refill_after_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected documents leave in two rounds, and the next of the same language enter."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    rows = state.refilled(docs, labels.where("quality = 0 AND toxic = 0"), "lang", [F.desc("n_chars"), F.asc("id")], 20, [labels.where("quality = 0 AND toxic = 1"), labels.where("toxic = 1")])
    return rows.select(F.col("id").alias("doc_id"), "lang", "place")


@query("""SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY """ + _SHAPE + """, p_brand ORDER BY p_size // 20, p_partkey) AS k FROM part) WHERE k = 1""")
def one_per_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a series by one author, the one that was fetched first, over all eras."""
    p = table(spark, sf_dir, "part").withColumn("shape", text.title_shape(F.col("p_name")))
    return select.first_of_shape(p, ["shape", "p_brand"], [F.floor(F.col("p_size") / 20), F.col("p_partkey")]).select("p_partkey", "p_name", "p_brand")


@query("""SELECT doc_id, lang, place::INT AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('leak:' || doc_id), doc_id) AS place FROM documents) WHERE place <= CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 20 WHEN 'de' THEN 10 ELSE 0 END""")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of stated size of each language in the order of a salted hash."""
    return select.sampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 40, "fr": 20, "de": 10}, "leak:").select("doc_id", "lang", "place")


@query("""WITH c AS (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL AND role = 'user' AND conv_id % 3 = 0), r AS (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM c)),
n AS (SELECT 120 - count(*) AS room FROM c)
SELECT md5(text) AS key, false AS filled FROM c UNION ALL SELECT md5(text), true FROM (SELECT text, row_number() OVER (ORDER BY ('0x' || substr(sha1(text), 1, 8))::BIGINT / 4294967296.0, text) AS k FROM r), n WHERE k <= greatest(room, 0)""")
def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a first set, and of the others as many as a pool of 120 has room for, by hash."""
    from quillspan.functions.hashing import hash_fraction

    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    rows = select.pool_fill(c.where("role = 'user' AND conv_id % 3 = 0"), c, "text", 120, hash_fraction(F.col("text")))
    return rows.select(F.md5("text").alias("key"), "filled")


@query("""WITH u AS (SELECT user_id, 0 AS part, event_id AS o FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 1, event_id FROM events WHERE event_type = 'view')
SELECT user_id, part::INT AS part, o AS "order" FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, o) = 1""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two lists, each once, where it comes first."""
    e = table(spark, sf_dir, "events")
    return select.ordered_union(e.where("event_type = 'click'"), e.where("event_type = 'view'"), key="user_id", order="event_id")


@query("""SELECT kind, key, price FROM (SELECT 'part' AS kind, p_partkey AS key, p_retailprice AS price FROM part UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier)
ORDER BY list_position(['supplier', 'part'], kind), key LIMIT 150""")
def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All categories' rows in one table, by category and key: the first 150 of the catalogue."""
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"))
    return joins.union_of(p, s).orderBy(F.array_position(F.array(F.lit("supplier"), F.lit("part")), F.col("kind")), "key").limit(150)
