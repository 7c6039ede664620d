"""Search queries: the wall around a query, worlds around an item, exposure, names, heads.

Embeddings stand in for items and query vectors: category = label, creator = vec_id % 50,
title = 't' || vec_id % 70; named items take title, creator and album from the part with the
same key. Query sets are stated ids against all items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions import color, hashing, vectors
from quillspan.operators import names, search, space
from quillspan.plans.base import query
from quillspan.sources.io import table

def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("category"), F.pmod("vec_id", F.lit(50)).alias("creator"), F.concat(F.lit("t"), F.pmod("vec_id", F.lit(70))).alias("title"), F.col("embedding").alias("vector"), F.lit(0.0).alias("penalty"))


def _vectors(items: DataFrame, where: str) -> DataFrame:
    return items.where(where).select(F.col("id").alias("qid"), F.col("category").alias("qcategory"), F.col("creator").alias("qcreator"), F.col("title").alias("qtitle"), F.col("vector").alias("qvector"))


_PAIRS = """WITH i AS (SELECT vec_id AS id, label AS category, vec_id % 50 AS creator, 't' || vec_id % 70 AS title, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT id AS qid, creator AS qcreator, title AS qtitle, v AS qv, category AS qcategory FROM i WHERE id % {mod} = 0),
s AS (SELECT qid, qcreator, qtitle, qcategory, category, id, creator, title, round(list_inner_product({qv}, v), 6) AS score FROM q, i),"""
_DIVERSE = """c AS (SELECT *, row_number() OVER (PARTITION BY qid, category, creator ORDER BY score DESC, id) AS rc FROM s WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) AS place FROM c WHERE rc = 1)
SELECT qid, category, id, score, place::INT AS place FROM r WHERE place <= 2"""


@query(_PAIRS.format(mod=25, qv="qv") + _DIVERSE.format(where="true"))
def knn_diverse_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return search.nearest(items, _vectors(items, "id % 25 = 0"), 2)


@query(_PAIRS.format(mod=20, qv="qv") + _DIVERSE.format(where="id <> qid AND creator <> qcreator AND title <> qtitle AND id NOT IN (qid + 1, qid + 2)"))
def world_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two works of the item's own category and two of each other one, without the item, its
    creator, its title and the ids that the path has already."""
    items = _items(spark, sf_dir)
    path = _vectors(items, "id % 20 = 0").withColumn("qexclude", F.array(F.col("qid") + 1, F.col("qid") + 2))
    return search.nearest(items, path, 2, own=True, other=2)


@query(_PAIRS.format(mod=25, qv="qv") + _DIVERSE.format(where="abs(qid - id) > 40 AND (qid + creator) % 3 <> 0"))
def rule_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two works a category that a caller's own rule allows: far enough by number, and of creators that
    suit the query."""
    items = _items(spark, sf_dir).withColumn("maker", F.col("creator"))
    asked = _vectors(items, "id % 25 = 0").withColumn("qn", F.col("qid"))

    def skip(queries, items):
        far = abs(queries["qn"][:, None] - items["nr"]) > 40
        return ~far | ((queries["qn"][:, None] + items["maker"]) % 3 == 0)

    return search.nearest(items.withColumn("nr", F.col("id")), asked, 2, rule=search.Rule(skip, ("qn",), ("nr", "maker")))


@query("""WITH i AS (SELECT vec_id AS id, label AS category, vec_id % 50 AS creator, embedding::DOUBLE[] AS v FROM embeddings),
b AS (SELECT a.id AS qid, a.creator AS qcreator, [0.7 * x[1] + 0.3 * x[2] FOR x IN list_zip(t.v, a.v)] AS m FROM i a JOIN i t ON t.id = a.id + 1 WHERE a.id % 50 = 0),
q AS (SELECT qid, qcreator, [x / sqrt(list_inner_product(m, m)) FOR x IN m] AS qv FROM b),
s AS (SELECT qid, category, id, creator, round(list_inner_product(qv, v), 6) AS score FROM q, i),""" + _DIVERSE.format(where="true"))
def anchor_blend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are 0.7 of an item's vector (the next id) and 0.3 of the text's, normalised."""
    items = _items(spark, sf_dir)
    near = items.select((F.col("id") - 1).alias("qid"), F.col("vector").alias("anchor"))
    mixed = _vectors(items, "id % 50 = 0").join(near, "qid").withColumn("qvector", vectors.blend(F.col("anchor"), F.col("qvector"), 0.7))
    return search.nearest(items, mixed.drop("anchor"), 2)


@query("""WITH i AS (SELECT vec_id AS id, label AS category, embedding::DOUBLE[] AS v FROM embeddings),
t AS (SELECT category, list(x ORDER BY d) AS total FROM (SELECT category, d, sum(v[d]) AS x FROM i, range(1, 65) r(d) GROUP BY category, d) GROUP BY category),
s AS (SELECT category, id, round(list_inner_product(v, total), 6) AS score FROM i JOIN t USING (category))
SELECT category, id, score FROM s QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, id) = 1""")
def group_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.representative(_items(spark, sf_dir), "category")


@query(_PAIRS.format(mod=5, qv="qv") + """w AS (SELECT id, count(*) AS wins FROM (SELECT id, row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) AS p FROM s) WHERE p <= 2 GROUP BY id),
m AS (SELECT i.id, category, coalesce(wins, 0) AS n, avg(coalesce(wins, 0)) OVER (PARTITION BY category) AS mean FROM i LEFT JOIN w USING (id))
SELECT id, category, round(0.5 * 0.02 * ln(greatest((n + 1) / (mean + 1), 1.0)), 8) AS penalty FROM m""")
def exposure_penalty_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return search.exposure(items, _vectors(items, "id % 5 = 0"), 1).withColumn("penalty", F.round("penalty", 8))


_WINS = """w{k} AS (SELECT id, count(*) AS wins FROM (SELECT id, row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) AS place FROM (SELECT qid, category, s.id, round(list_inner_product(qv, v) - {p}, 6) AS score FROM q, i s {join})) WHERE place <= 2 GROUP BY id),
m{k} AS (SELECT i.id, i.category, {p0} AS old, coalesce(wins, 0) AS n, avg(coalesce(wins, 0)) OVER (PARTITION BY i.category) AS mean FROM i LEFT JOIN w{k} USING (id) {join0}),
p{k} AS (SELECT id, category, round(0.5 * old + 0.5 * 0.02 * ln(greatest((n + 1) / (mean + 1), 1.0)), 8) AS penalty FROM m{k})"""
_ROUNDS = ", ".join(
    _WINS.format(k=k, p="0" if k == 1 else "pen.penalty", join="" if k == 1 else f"JOIN p{k - 1} pen ON pen.id = s.id", p0="0" if k == 1 else f"old{k}.penalty", join0="" if k == 1 else f"JOIN p{k - 1} old{k} ON old{k}.id = i.id").replace("category, s.id", "s.category, s.id")
    for k in range(1, 7)
)
_HALF = "CASE WHEN penalty = 0 THEN 0 ELSE round_even(penalty / pow(2.0, greatest(floor(log2(abs(penalty))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(penalty))), -14) - 10) END"
_EXPOSED = """WITH i AS (SELECT vec_id AS id, label AS category, vec_id % 50 AS creator, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT id AS qid, v AS qv FROM i WHERE id % 5 = 0), """


@query(_EXPOSED + _ROUNDS + f" SELECT id, category, {_HALF} AS penalty FROM p6")
def exposure_penalty_round6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six damped rounds, a table written after each; the result in half precision."""
    items = _items(spark, sf_dir)
    return search.exposure(items, _vectors(items, "id % 5 = 0"))


@query(_PAIRS.format(mod=5, qv="qv") + """w AS (SELECT id, count(*) AS wins FROM (SELECT id, row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) AS p FROM s) WHERE p <= 2 GROUP BY id),
a AS (SELECT i.category, coalesce(wins, 0) AS wins, row_number() OVER (PARTITION BY i.category ORDER BY coalesce(wins, 0) DESC, i.id) AS r, count(*) OVER (PARTITION BY i.category) AS n FROM i LEFT JOIN w USING (id)),
c AS (SELECT category, coalesce(sum(wins) FILTER (WHERE r <= n // 10), 0) / nullif(sum(wins), 0) AS share, max(wins) AS most FROM a GROUP BY category)
SELECT round(avg(share), 8) AS share, max(most) AS most FROM c""")
def exposure_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over categories of the share of places in the top two that the most frequent
    tenth takes (a hundredth of these small categories is nobody), and the most frequent item's."""
    items = _items(spark, sf_dir)
    return search.concentration(search.wins(items, _vectors(items, "id % 5 = 0")), part=10).select(F.round("share", 8).alias("share"), "most")


@query(_PAIRS.format(mod=25, qv="qv") + """h AS (SELECT qid, category, id, round(list_inner_product(qv[1:32], v[1:32]), 6) AS half FROM q, i),
a AS (SELECT qid, category, id FROM s QUALIFY row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) <= 10),
b AS (SELECT qid, category, id FROM h QUALIFY row_number() OVER (PARTITION BY qid, category ORDER BY half DESC, id) <= 10),
o AS (SELECT a.qid, a.category, count(b.id) AS both_ FROM a LEFT JOIN b USING (qid, category, id) GROUP BY ALL)
SELECT category, round(avg(both_ / 10.0), 6) AS fidelity FROM o GROUP BY category""")
def fidelity_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the ten best under the full vectors and under their first half."""
    items = _items(spark, sf_dir)
    half = items.withColumn("vector", F.slice("vector", 1, 32))
    pick = lambda x: search.nearest(x, _vectors(x, "id % 25 = 0"), 10, per_creator=False).select("qid", "category", "id")
    both = pick(items).join(pick(half).withColumn("hit", F.lit(1)), ["qid", "category", "id"], "left")
    return both.groupBy("qid", "category").agg(F.count("hit").alias("n")).groupBy("category").agg(F.round(F.avg(F.col("n") / 10), 6).alias("fidelity"))


@query(_PAIRS.format(mod=25, qv="qv") + """p AS (SELECT qid, score AS own FROM s WHERE id = qid + 1),
r AS (SELECT p.qid, count(*) FILTER (WHERE s.score > own) AS above FROM p JOIN s USING (qid) JOIN i t ON t.id = p.qid + 1 AND t.category = s.category GROUP BY p.qid)
SELECT count(*) AS queries, round(avg(CASE WHEN above < 10 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM r""")
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positive of each query is the next id; a hit has fewer than ten better items in its category."""
    items = _items(spark, sf_dir)
    q = _vectors(items, "id % 25 = 0").join(items.select((F.col("id") - 1).alias("qid"), F.col("category").alias("pc"), F.col("vector").alias("pv")), "qid")
    own = q.select("qid", "pc", F.round(vectors.dot(F.col("qvector"), F.col("pv")), 6).alias("own"))
    best = search.nearest(items, q.select("qid", "qcreator", "qvector"), 10, per_creator=False)
    # fewer than ten better ones: the tenth best does not beat the positive
    tenth = best.join(own, "qid").where("category = pc").groupBy("qid", "own").agg(F.count_if(F.col("score") > F.col("own")).alias("above"))
    return tenth.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("above") < 10, 1.0).otherwise(0.0)), 6).alias("recall"))


@query("""WITH i AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT * FROM i WHERE id % 20 = 0)
SELECT i.id, round(max(list_cosine_similarity(i.v, e.v)), 6) AS nearest FROM i, e WHERE i.id % 20 <> 0 GROUP BY i.id HAVING round(max(list_cosine_similarity(i.v, e.v)), 6) < 0.88""")
def near_eval_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay: their best cosine to an evaluation row is below 0.88."""
    every = _items(spark, sf_dir).withColumn("vector", vectors.unit(F.col("vector")))
    return space.farther_than(every.where("id % 20 <> 0"), every.where("id % 20 = 0"), 0.88).select("id", "nearest")


# --- walls and heads ----------------------------------------------------------------------

_PENALTY = "round(0.001 * (id % 9), 6)"
_WALL = """WITH i AS (SELECT vec_id AS id, label AS category, vec_id % 50 AS creator, 't' || vec_id % 70 AS title, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT t.id AS qid, t.v AS tv, n.creator AS acreator, n.title AS atitle, n.v AS av FROM i t LEFT JOIN i n ON n.id = t.id + 1 AND t.id % 40 = 0 WHERE t.id % 20 = 0),
b AS (SELECT *, CASE WHEN av IS NULL THEN tv ELSE [0.7 * x[1] + (1 - 0.7) * x[2] FOR x IN list_zip(av, tv)] END AS m FROM a),
q AS (SELECT qid, acreator, atitle, CASE WHEN av IS NULL THEN m ELSE [x / sqrt(list_inner_product(m, m)) FOR x IN m] END AS qv FROM b),
s AS (SELECT qid, category, id, creator, round(list_inner_product(qv, v) - """ + _PENALTY + """, 6) AS score FROM q, i WHERE acreator IS NULL OR (creator <> acreator AND title <> atitle)),
""" + _DIVERSE.format(where="true")


def _wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, category, id, score, place. Every second query has an anchor, the next item: its
    vector is blended in, its creator and title are left out. Queries are no items themselves,
    so their keys are negative."""
    items = _items(spark, sf_dir).withColumn("penalty", F.expr(_PENALTY))
    asked = items.where("id % 20 = 0").select("id", F.col("vector").alias("own"))
    anchor = items.select((F.col("id") - 1).alias("id"), F.col("creator").alias("acreator"), F.col("title").alias("atitle"), F.col("vector").alias("avector")).where("id % 40 = 0")
    rows = asked.join(anchor, "id", "left")
    vector = F.when(F.col("avector").isNull(), F.transform("own", lambda x: x.cast("double"))).otherwise(vectors.blend(F.col("avector"), F.col("own"), 0.7))
    asked = rows.select((-F.col("id") - 1).alias("qid"), F.coalesce("acreator", F.lit(-1)).alias("qcreator"), F.coalesce("atitle", F.lit("")).alias("qtitle"), vector.alias("qvector"))
    return search.nearest(items, asked, 2, own=True).withColumn("qid", -F.col("qid") - 1)


@query(_WALL)
def wall_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wall(spark, sf_dir)


@query("WITH RECURSIVE found AS (" + _WALL + """), l AS (SELECT qid, list(id ORDER BY category, place) AS ids FROM found GROUP BY qid),
seeds AS (SELECT qid, ids, list_reduce(list_prepend(2166136261::HUGEINT, [ascii(c)::HUGEINT FOR c IN string_split('feeling ' || qid, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM l),
w AS (SELECT qid, ids, h, len(ids) AS last FROM seeds UNION ALL
      SELECT qid, [CASE WHEN k = last THEN ids[j] WHEN k = j THEN ids[last] ELSE ids[k] END FOR k IN range(1, len(ids) + 1)], h, last - 1
      FROM (SELECT *, (floor(xor(b, b >> 14) / 4294967296.0 * last) + 1)::BIGINT AS j
            FROM (SELECT *, xor(a, (a + (xor(a, a >> 7) * (a | 61)) % 4294967296) % 4294967296) AS b
                  FROM (SELECT qid, ids, last, h, (xor(h, h >> 15) * (h | 1)) % 4294967296 AS a
                        FROM (SELECT qid, ids, last, (h + 1831565813) % 4294967296 AS h FROM w WHERE last > 1)))))
SELECT qid, array_to_string(ids, ' ') AS ids FROM w WHERE last <= 1""")
def wall_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks of each query in the order that its text fixes."""
    found = search.flat(_wall(spark, sf_dir), "qid")
    return found.select("qid", F.array_join(hashing.seeded_shuffle(F.col("ids"), F.concat(F.lit("feeling "), F.col("qid").cast("string"))).cast("array<string>"), " ").alias("ids"))


_LINE = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"
_LAB3 = ", ".join(
    "(" + " + ".join(f"({w}) * cbrt({a} * r + {b} * g + {c} * b)" for w, (a, b, c) in zip(row, color.TO_LMS, strict=True)) + f") AS {n}"
    for row, n in zip(color.TO_LAB, ("la", "aa", "ba"), strict=True)
)
_HEADS = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.id AS qid, a.id, a.id % 3 AS kind, round(list_inner_product(q.v, a.v), 6) AS score FROM e q, e a WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, id) AS place FROM s),
t AS (SELECT qid, id, place, exp((score - max(score) OVER (PARTITION BY qid)) / 0.03) AS x FROM r WHERE kind = 0 AND place <= 3),
w AS (SELECT qid, id, place, x / sum(x) OVER (PARTITION BY qid) AS w FROM t),
d AS (SELECT qid, max(w) FILTER (WHERE place = 1) >= 0.7 AS sure FROM w GROUP BY qid),
u AS (SELECT w.qid, w.id, CASE WHEN sure THEN CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END ELSE w END AS w FROM w JOIN d USING (qid)),
h AS (SELECT qid, id, w, slot, substr(sha1(id || ':' || slot), 1, 6) AS hex FROM u, range(5) x(slot)),
c AS (SELECT qid, w, slot, ('0x' || hex[1:2])::INT / 255.0::DOUBLE AS r, ('0x' || hex[3:4])::INT / 255.0::DOUBLE AS g, ('0x' || hex[5:6])::INT / 255.0::DOUBLE AS b FROM h),
n AS (SELECT qid, w, slot, """ + ", ".join(f"{_LINE.format(c=c)} AS {c}" for c in "rgb") + " FROM c), k AS (SELECT qid, w, slot, " + _LAB3 + """ FROM n),
z AS (SELECT qid, slot, sum(w * la) AS l, sum(w * sqrt(aa * aa + ba * ba)) AS c, sum(w * CASE WHEN sqrt(aa * aa + ba * ba) > 1e-6 THEN aa / sqrt(aa * aa + ba * ba) ELSE 0 END) AS x, sum(w * CASE WHEN sqrt(aa * aa + ba * ba) > 1e-6 THEN ba / sqrt(aa * aa + ba * ba) ELSE 0 END) AS y FROM k GROUP BY qid, slot)
SELECT z.qid, slot::INT AS slot, round(l, 6) AS l, round(c * cos(atan2(y, x)), 6) AS a, round(c * sin(atan2(y, x)), 6) AS b, light.id AS light, face.id AS face
FROM z JOIN r light ON light.qid = z.qid AND light.kind = 1 AND light.place = 1 JOIN r face ON face.qid = z.qid AND face.kind = 2 AND face.place = 1"""


@query(_HEADS)
def anchor_heads_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette, light and typeface of each query from the nearest phrases: the three best palettes
    weighted by a softmax at 0.03, or the best one alone if its weight is 0.7 or more."""
    e = _items(spark, sf_dir)
    phrases = e.withColumn("category", F.pmod("id", F.lit(3)).cast("int"))
    best = search.nearest(phrases, _vectors(phrases, "id % 20 = 0"), 3, per_creator=False)
    colors = F.array(*[F.substring(F.sha1(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(k)))), 1, 6) for k in range(5)])
    palettes = best.where("category = 0").withColumn("palette", color.palette_of(colors))
    top = palettes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "score", "palette"))).alias("top"))
    weights = vectors.softmax(F.transform("top", lambda x: x["score"]), 0.03)
    top = top.withColumn("w", weights)
    alone = F.get("w", F.lit(0)) >= 0.7
    mixed = color.blended(F.zip_with("top", "w", lambda t, w: F.struct(w.alias("w"), t["palette"].alias("palette"))))
    palette = F.when(alone, F.get("top", F.lit(0))["palette"]).otherwise(mixed)
    pick = lambda kind, name: best.where(f"category = {kind} AND place = 1").select("qid", F.col("id").alias(name))
    rows = top.select("qid", F.posexplode(palette).alias("slot", "c")).join(pick(1, "light"), "qid").join(pick(2, "face"), "qid")
    return rows.select("qid", "slot", *[F.round(F.get("c", F.lit(k)), 6).alias(n) for k, n in enumerate("lab")], "light", "face")


@query("""WITH p AS (SELECT list(prior ORDER BY k) AS prior FROM (SELECT k, (1 + count(e.vec_id)) / sum(1 + count(e.vec_id)) OVER () AS prior FROM range(8) r(k) LEFT JOIN embeddings e ON e.label = k GROUP BY k)),
l AS (SELECT vec_id, [x[1] - 0.5 * ln(x[2]) FOR x IN list_zip((embedding::DOUBLE[])[1:8], prior)] AS z FROM embeddings, p)
SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS choice FROM l""")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class with the largest logit after half the log of its prior is taken off."""
    e = table(spark, sf_dir, "embeddings")
    n = spark.range(8).select(F.col("id").cast("int").alias("label")).join(e.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    prior = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: x["n"]).alias("n")).select(F.transform("n", lambda x: x / F.aggregate("n", F.lit(0.0), lambda s, y: s + y)).alias("prior"))
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return e.crossJoin(F.broadcast(prior)).select("vec_id", vectors.first_largest(vectors.corrected(logits, F.col("prior"), 0.5)).alias("choice"))  # one row


@query(_PAIRS.format(mod=20, qv="qv") + """h AS (SELECT qid, qcreator, qtitle, category, i.id, i.creator, i.title, round(list_inner_product(qv[1:32], v[1:32]), 6) AS score FROM q, i),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, category, creator ORDER BY score DESC, id) AS rc FROM s WHERE id <> qid AND creator <> qcreator AND title <> qtitle),
g AS (SELECT *, row_number() OVER (PARTITION BY qid, category, creator ORDER BY score DESC, id) AS rc FROM h WHERE id <> qid AND creator <> qcreator AND title <> qtitle),
a AS (SELECT qid, category, id FROM f WHERE rc = 1 QUALIFY row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) <= 2),
b AS (SELECT qid, category, id FROM g WHERE rc = 1 QUALIFY row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) <= 2)
SELECT round(count(b.id) / count(*), 6) AS fidelity FROM a LEFT JOIN b USING (qid, category, id)""")
def world_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the works around an item under the full vectors that their first half finds too."""
    items = _items(spark, sf_dir)
    found = lambda x: search.nearest(x, _vectors(x, "id % 20 = 0"), 2, own=True).select("qid", "category", "id")
    half = found(items.withColumn("vector", F.slice("vector", 1, 32))).withColumn("hit", F.lit(1))
    return found(items).join(half, ["qid", "category", "id"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("fidelity"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, 0.001 * (vec_id % 9) AS p FROM embeddings)
SELECT a.vec_id, round(list_inner_product(a.v, b.v) - b.p, 6) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def penalty_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalty as one more dimension: the plain product takes it off."""
    e = table(spark, sf_dir, "embeddings").withColumn("p", F.lit(0.001) * F.pmod("vec_id", F.lit(9)))
    a = e.select("vec_id", vectors.with_penalty(F.col("embedding"), None).alias("q"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), vectors.with_penalty(F.col("embedding"), F.col("p")).alias("v"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.dot(F.col("q"), F.col("v")), 6).alias("score"))


@query("""WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:32] AS h, (embedding::DOUBLE[])[33:64] AS x FROM embeddings)
SELECT a.vec_id, round(0.7 * list_cosine_similarity(a.h, b.h) + 0.3 * list_cosine_similarity(a.x, b.x), 6) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def mixed_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spaces side by side: one product is 0.7 of one cosine and 0.3 of the other."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.joined_spaces(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), 0.3).alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.dot(F.col("v"), F.col("w")), 6).alias("score"))


@query(_PAIRS.format(mod=25, qv="qv") + """t AS (SELECT qid, id FROM s QUALIFY row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id) <= 3),
c AS (SELECT id FROM t UNION SELECT qid + 1 FROM q JOIN i ON i.id = qid + 1 UNION SELECT id FROM (SELECT id FROM i ORDER BY sha256('draw:' || id) LIMIT 20))
SELECT qid, c.id, t.id IS NOT NULL AS picked FROM q CROSS JOIN c LEFT JOIN t USING (qid, id)""")
def candidate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of one training step and which of them each query picked: the best three a
    category of any query, the positives (the next ids) and twenty in the order of a hash."""
    items = _items(spark, sf_dir)
    asked = _vectors(items, "id % 25 = 0")
    positives = asked.select((F.col("qid") + 1).alias("id")).join(items, "id", "left_semi")
    return space.candidates(items, asked, positives, 3, 20)


@query()
def item_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of neighbouring items in the sixteen dimensions that keep products best."""
    projected = space.project(_items(spark, sf_dir).select("id", "vector"), 16)
    b = projected.select((F.col("id") - 1).alias("id"), F.col("vector").alias("w"))
    return projected.join(b, "id").select("id", F.round(vectors.dot(F.col("vector"), F.col("w")), 6).alias("score"))


# --- names --------------------------------------------------------------------------------

_COMMON = ["red", "blue", "small", "economy", "ring"]
_WORDS = r"regexp_extract_all(regexp_replace(replace(lower(strip_accents({x})), '&', ' and '), '[''’]', '', 'g'), '[a-z0-9]+')"
_CONTENT = "list_filter(" + _WORDS + ", lambda w: NOT list_contains(" + str(names.content_words.__globals__["STOP_WORDS"]) + ", w))"
_EXACT0 = "list_filter(" + _WORDS + ", lambda w: NOT list_contains(" + str(names.FILLER_WORDS) + ", w))"
_EXACT = "array_to_string(CASE WHEN (" + _EXACT0 + ")[1] = 'the' THEN (" + _EXACT0 + ")[2:] ELSE " + _EXACT0 + " END, ' ')"
_NAMED = """named AS (SELECT vec_id AS id, (['film', 'song', 'book', 'art', 'poem'])[label % 5 + 1] AS category, label % 5 AS corder, p_name AS title, p_brand AS creator, p_type AS album, embedding::DOUBLE[] AS v FROM embeddings JOIN part ON p_partkey = vec_id),
texts AS (SELECT id AS qid, CASE id // 7 % 7 WHEN 0 THEN title WHEN 1 THEN title || ' by ' || creator WHEN 2 THEN 'the ' || creator || ' film' WHEN 3 THEN album || ' album by ' || creator WHEN 4 THEN 'i feel like a ' || title || ' today' WHEN 5 THEN album ELSE 'listening to ' || title END AS text FROM named WHERE id % 7 = 0)"""
_AT = "list_filter(range(1, len(w) - len({p}) + 2), lambda i: w[i:i + len({p}) - 1] = {p})[1]"
_COVERS = "len(list_filter(range(1, len(w) + 1), lambda i: counted[i] AND ({spans}))) = total"
_MATCHED = _NAMED + """,
n AS (SELECT id, corder, creator, album, """ + f"{_CONTENT.format(x='title')} AS t, {_CONTENT.format(x='creator')} AS c, {_CONTENT.format(x='album')} AS al, {_EXACT.format(x='title')} AS te, {_EXACT.format(x='album')} AS ae" + """ FROM named),
asked0 AS (SELECT qid, """ + f"{_CONTENT.format(x='text')} AS w, {_EXACT.format(x='text')} AS e" + """ FROM texts),
asked AS (SELECT *, [NOT list_contains(""" + str(names.FILLER_WORDS) + """, x) FOR x IN w] AS counted, len(list_filter(w, lambda x: NOT list_contains(""" + str(names.FILLER_WORDS) + """, x))) AS total FROM asked0),
pairs AS (SELECT asked.*, n.*, """ + f"{_AT.format(p='t')} AS ta, {_AT.format(p='c')} AS ca, {_AT.format(p='al')} AS aa" + """ FROM asked, n WHERE total > 0),
ok AS (SELECT *, """ + ", ".join(f"len(list_filter({p}, lambda x: NOT list_contains({_COMMON}, x))) = 0 AS {p}common" for p in ("t", "c", "al")) + """ FROM pairs),
hits AS (SELECT qid, 0 AS kind, corder, id FROM ok WHERE len(t) > 0 AND ta IS NOT NULL AND (""" + _COVERS.format(spans="i BETWEEN ta AND ta + len(t) - 1") + """ AND NOT (tcommon AND (len(t) = 1 OR e <> te)) OR len(c) > 0 AND ca IS NOT NULL AND """ + _COVERS.format(spans="i BETWEEN ta AND ta + len(t) - 1 OR i BETWEEN ca AND ca + len(c) - 1") + """)
UNION ALL SELECT qid, 1, corder, id FROM ok WHERE len(al) > 0 AND aa IS NOT NULL AND (""" + _COVERS.format(spans="i BETWEEN aa AND aa + len(al) - 1") + """ AND NOT (alcommon AND (len(al) = 1 OR e <> ae)) OR len(c) > 0 AND ca IS NOT NULL AND """ + _COVERS.format(spans="i BETWEEN aa AND aa + len(al) - 1 OR i BETWEEN ca AND ca + len(c) - 1") + """)
UNION ALL SELECT qid, 2, corder, id FROM ok WHERE len(c) > 0 AND ca IS NOT NULL AND """ + _COVERS.format(spans="i BETWEEN ca AND ca + len(c) - 1") + """ AND NOT (ccommon AND len(c) = 1)),
matched AS (SELECT qid, kind::INT AS kind, id FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY kind, corder, id) = 1)"""
_REPRESENTED = """sums AS (SELECT creator, g, list(x ORDER BY d) AS total, any_value(members) AS members FROM (SELECT creator, g, d, sum(v[d]) AS x, count(*) AS members FROM (SELECT creator, NULL AS g, v FROM named UNION ALL SELECT creator, album, v FROM named), range(1, 65) r(d) GROUP BY creator, g, d) GROUP BY creator, g),
reps AS (SELECT s.creator, s.g AS album, n.id FROM sums s JOIN named n ON n.creator = s.creator AND (s.g IS NULL OR n.album = s.g) WHERE members > 1 QUALIFY row_number() OVER (PARTITION BY s.creator, s.g ORDER BY round(list_inner_product(n.v, total), 6) DESC, n.id) = 1)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part")
    category = F.element_at(F.array(*map(F.lit, names.CATEGORY_ORDER)), (F.pmod("label", F.lit(5)) + 1).cast("int"))
    return e.join(p, e.vec_id == p.p_partkey).select(F.col("vec_id").alias("id"), category.alias("category"), F.col("label").alias("label"), F.col("p_name").alias("title"), F.col("p_brand").alias("creator"), F.col("p_type").alias("album"), F.col("embedding").alias("vector"))


def _typed(items: DataFrame) -> DataFrame:
    text = """CASE id div 7 % 7 WHEN 0 THEN title WHEN 1 THEN title || ' by ' || creator WHEN 2 THEN 'the ' || creator || ' film' WHEN 3 THEN album || ' album by ' || creator
        WHEN 4 THEN 'i feel like a ' || title || ' today' WHEN 5 THEN album ELSE 'listening to ' || title END"""
    return items.where("id % 7 = 0").select(F.col("id").alias("qid"), F.expr(text).alias("text"))


@query("WITH " + _MATCHED + " SELECT qid, kind, id FROM matched")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that a typed text names by title, album or creator."""
    items = _named(spark, sf_dir)
    return names.name_matches(_typed(items), items, _COMMON)


@query("WITH " + _NAMED + ", " + _REPRESENTED + " SELECT creator, album, id FROM reps")
def name_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.representatives(_named(spark, sf_dir))


@query("WITH " + _NAMED + f""", n AS (SELECT DISTINCT unnest({_WORDS.format(x="title || ' ' || creator || ' ' || album")}) AS word FROM named),
w AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct({_WORDS.format(x="text")})) AS word FROM (SELECT doc_id, text FROM documents UNION ALL SELECT p_partkey, p_name FROM part)) GROUP BY word HAVING count(*) >= 0.02 * ((SELECT count(*) FROM documents) + (SELECT count(*) FROM part)))
SELECT word FROM w WHERE word IN (SELECT word FROM n)""")
def name_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names that are in a fiftieth of the texts."""
    texts = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "part").select("p_name"))
    return names.name_words(_named(spark, sf_dir), names.common_words(texts, "text", 0.02))


@query()
def name_one_piece_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a public tokenizer takes as one piece, with the names and the texts that have them."""
    named = _named(spark, sf_dir).select(F.lit(1).alias("name"), F.concat_ws(" ", "title", "creator", "album").alias("text"))
    texts = table(spark, sf_dir, "documents").select(F.lit(0).alias("name"), "text")
    used = names.used_words(named.union(texts), "text", "name")
    counts = used.groupBy("word").agg(F.sum("name").alias("names"), F.sum(1 - F.col("name")).alias("texts"))
    return counts.join(names.one_piece_words(spark), "word")


@query("WITH " + _MATCHED + ", " + _REPRESENTED + """, chosen AS (SELECT m.qid, coalesce(r.id, m.id) AS aid FROM matched m JOIN named a ON a.id = m.id LEFT JOIN reps r ON kind > 0 AND r.creator = a.creator AND r.album IS NOT DISTINCT FROM CASE WHEN kind = 1 THEN a.album END),
base AS (SELECT x.qid, t.v AS tv, a.creator AS acreator, a.title AS atitle, a.v AS av FROM texts x JOIN named t ON t.id = x.qid LEFT JOIN chosen USING (qid) LEFT JOIN named a ON a.id = aid),
mixed AS (SELECT *, CASE WHEN av IS NULL THEN tv ELSE [0.7 * x[1] + (1 - 0.7) * x[2] FOR x IN list_zip(av, tv)] END AS m FROM base),
vecs AS (SELECT qid, acreator, atitle, CASE WHEN av IS NULL THEN m ELSE [x / sqrt(list_inner_product(m, m)) FOR x IN m] END AS qv FROM mixed),
sc AS (SELECT qid, corder AS category, id, creator, round(list_inner_product(qv, v), 6) AS score FROM vecs, named WHERE acreator IS NULL OR (creator <> acreator AND title <> atitle)),
one AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qid, category, creator ORDER BY score DESC, id) = 1)
SELECT qid, category, id, score, row_number() OVER (PARTITION BY qid, category ORDER BY score DESC, id)::INT AS place FROM one QUALIFY place <= 2""")
def match_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed text's wall: the item it names, if any, is blended into its vector, and left out."""
    items = _named(spark, sf_dir)
    typed = _typed(items)
    chosen = names.anchors(typed, items, _COMMON).withColumnRenamed("id", "aid")
    a = items.select(F.col("id").alias("aid"), F.col("creator").alias("acreator"), F.col("title").alias("atitle"), F.col("vector").alias("av"))
    rows = typed.join(items.select(F.col("id").alias("qid"), F.col("vector").alias("tv")), "qid").join(chosen, "qid", "left").join(a, "aid", "left")
    vector = F.when(F.col("av").isNull(), F.transform("tv", lambda x: x.cast("double"))).otherwise(vectors.blend(F.col("av"), F.col("tv"), 0.7))
    asked = rows.select((-F.col("qid") - 1).alias("qid"), F.xxhash64("acreator").alias("qcreator"), F.coalesce("atitle", F.lit("")).alias("qtitle"), vector.alias("qvector"))
    found = items.select("id", F.pmod("label", F.lit(5)).alias("category"), F.xxhash64("creator").alias("creator"), "title", "vector", F.lit(0.0).alias("penalty"))
    return search.nearest(found, asked, 2, own=True).withColumn("qid", -F.col("qid") - 1)
