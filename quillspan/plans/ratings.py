"""Catalogue joins, splits, audits, ranking metrics and gates on documents, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import hashing, text
from quillspan.operators import audit, joins, metrics
from quillspan.plans.base import query
from quillspan.sources.io import table

# --- joins ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice > 200000""")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.where("o_totalprice > 200000").join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey, "left").join(r, r.r_regionkey == n.n_regionkey, "left")
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT c_custkey, c_name, event_type, value FROM customer JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id) ON user_id = c_custkey""")
def latest_profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their last event: of several profiles of a key the last one counts."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    rows = joins.with_latest(c, table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), "user_id", F.col("event_id"))
    return rows.select(F.col("user_id").alias("c_custkey"), "c_name", "event_type", "value")


@query("""WITH l AS (SELECT doc_id, nullif(max(quality), 0) AS quality FROM labels GROUP BY doc_id), t AS (SELECT conv_id AS doc_id, nullif(arg_max(CASE WHEN conv_id % 7 = 0 THEN '' ELSE text END, turn), '') AS theme FROM conversations GROUP BY conv_id)
SELECT d.doc_id, quality, md5(theme) AS theme FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN t USING (doc_id)""")
def enrich_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two left joins that add only values that say something."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    themes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.col("text")).alias("theme"), "turn")
    out = joins.enriched(docs, "doc_id", [(table(spark, sf_dir, "labels"), "quality", F.col("quality")), (themes, "theme", F.col("turn"))])
    return out.select("doc_id", "quality", F.md5("theme").alias("theme"))


@query("""WITH b AS (SELECT p_partkey AS id, p_name AS title, p_size AS year, MAP {'kind': p_type, 'tag': 'base'} AS signal FROM part), o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1900 END AS year, p_partkey % 5 AS k FROM part WHERE p_partkey % 4 <> 0)
SELECT b.id, coalesce(o.title, b.title) AS title, coalesce(o.year, b.year)::INT AS year, b.signal['kind'] AS kind, CASE WHEN k = 1 THEN 'over' ELSE 'base' END AS tag, CASE WHEN k IN (1, 2) THEN 'new' END AS extra FROM b LEFT JOIN o USING (id)""")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source facts under resolved ones: fields and entries of a map, the resolved ones win."""
    p = table(spark, sf_dir, "part")
    base = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.create_map(F.lit("kind"), "p_type", F.lit("tag"), F.lit("base")).alias("signal"))
    entries = F.expr("CASE p_partkey % 5 WHEN 1 THEN map('tag', 'over', 'extra', 'new') WHEN 2 THEN map('extra', 'new') WHEN 3 THEN NULL ELSE cast(map() AS map<string, string>) END")
    over = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) END").alias("title"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_size + 1900 END").alias("year"), entries.alias("signal"))
    rows = joins.overlaid(base, over, "id", ["title", "year"], ["signal"])
    return rows.select("id", "title", F.col("year").cast("int").alias("year"), *[F.col("signal")[k].alias(k) for k in ("kind", "tag", "extra")])


@query("""SELECT r.o_orderkey, coalesce(c.o_orderpriority, r.o_orderpriority) AS grp, r.o_totalprice AS price, CASE WHEN c.o_orderkey % 5 <> 0 THEN c.o_custkey ELSE r.o_custkey END AS place
FROM (SELECT o_orderkey, '?' AS o_orderpriority, o_totalprice, -1 AS o_custkey FROM orders WHERE o_orderkey % 3 = 0) r JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) c USING (o_orderkey)""")
def rerun_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are still candidates, with the candidates' current group and order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("place"))
    results = o.where("o_orderkey % 3 = 0").withColumns({"grp": F.lit("?"), "place": F.lit(-1).cast("long")})
    candidates = o.where("o_orderkey % 2 = 0").withColumn("place", F.when(F.col("o_orderkey") % 5 != 0, F.col("place")))
    return joins.refreshed(results, candidates, "o_orderkey", ["grp", "place"])


@query("""WITH d AS (SELECT user_id, min(year(ts))::INT AS year, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS codes FROM events WHERE user_id % 3 <> 0 GROUP BY user_id)
SELECT c_custkey, year, codes FROM customer JOIN d ON user_id = c_custkey WHERE year IS NOT NULL""")
def dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key has a date in the looked-up answers, with its codes in order."""
    e = table(spark, sf_dir, "events").where("user_id % 3 <> 0")
    d = e.groupBy(F.col("user_id").alias("c_custkey")).agg(F.min(F.year("ts")).alias("year"), F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("codes"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(d.where("year IS NOT NULL"), "c_custkey").select("c_custkey", "year", "codes")


@query("""SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id IN (SELECT conv_id FROM conversations)""")
def rated_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings whose work and feeling both exist."""
    return joins.known(table(spark, sf_dir, "labels").select("doc_id", "quality"), (table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id"), (table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id"), "doc_id"))


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY user_id""")
def first_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    at = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"), F.count("*").alias("n"))


@query("""SELECT text, CASE WHEN count(DISTINCT conv_id) = 1 THEN min(conv_id) END AS conv_id, count(DISTINCT conv_id) AS owners FROM conversations GROUP BY text""")
def ambiguous_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unambiguous(table(spark, sf_dir, "conversations").select("text", "conv_id"), "text", "conv_id")


@query("""WITH a AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 GROUP BY user_id), b AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'view' AND user_id % 4 <> 0 GROUP BY user_id)
SELECT c_custkey, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 END::INT AS origin, coalesce(a.v, b.v) AS v FROM customer LEFT JOIN a ON a.user_id = c_custkey LEFT JOIN b ON b.user_id = c_custkey""")
def overlay_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's value before another source's; of several rows the later one wins."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_type", "value", "event_id")
    layers = [(e.where("event_type = 'click' AND c_custkey % 3 <> 0"), "value", F.col("event_id")), (e.where("event_type = 'view' AND c_custkey % 4 <> 0"), "value", F.col("event_id"))]
    return joins.precedence(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", layers)


@query("""SELECT a.event_id AS one, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch(a.ts)::BIGINT - epoch(b.ts)::BIGINT) <= 600""")
def duration_tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("s", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long"))
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("one"), F.col("s").alias("a"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"), F.col("s").alias("b"))
    return joins.within(a, b, "user_id", "a", "b", 600).select("one", "other")


@query("""SELECT a.p_partkey, a.p_retailprice AS mine, b.p_retailprice + 1 AS theirs FROM part a JOIN part b USING (p_partkey) WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 3 = 0""")
def shared_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that two catalogues share, so that both can be scored on them."""
    p = table(spark, sf_dir, "part")
    return joins.shared_rows(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 1), "p_partkey", "p_retailprice")


@query("""SELECT a.doc_id FROM documents a WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.doc_id AND len(list_intersect(regexp_extract_all(lower(a.text), '[a-z]+'), regexp_extract_all(lower(c.text), '[a-z]+'))) > 0)""")
def overlapping_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a word with a conversation of the same key."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.words_of(F.col("text")).alias("a"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), text.words_of(F.col("text")).alias("b"))
    return d.join(c, "doc_id").where(F.arrays_overlap("a", "b")).select("doc_id").distinct()


# --- splits ---------------------------------------------------------------------------------

_SPLIT = """h AS (SELECT doc_id, ('0x' || substr(sha1('heldout:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS a, ('0x' || substr(sha1('val:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS b FROM documents),
split AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'eval' WHEN doc_id % 2 = 0 AND a < 0.1 THEN 'heldout' WHEN b < 0.05 THEN 'val' ELSE 'train' END AS split FROM h)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    salted = lambda s: hashing.hash_fraction(F.concat(F.lit(s), F.col("doc_id").cast("string")))
    split = F.when(F.col("doc_id") % 50 == 0, "eval").when((F.col("doc_id") % 2 == 0) & (salted("heldout:") < 0.1), "heldout").when(salted("val:") < 0.05, "val").otherwise("train")
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("split"))


@query("WITH " + _SPLIT + " SELECT doc_id, split FROM split")
def stable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval, then heldout among rows with a positive, then val, then train, by salted hashes."""
    return _split(spark, sf_dir)


@query("WITH " + _SPLIT + """ SELECT doc_id FROM split JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE split = 'eval' OR doc_id % 2 = 0 OR n_chars % 5 = 0 OR quality IS NOT NULL OR toxic IS NOT NULL""")
def teaching_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are evaluated or teach something: a positive, a palette or a label."""
    d = _split(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select("doc_id", "split", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("positive"), (F.col("n_chars") % 5 == 0).alias("has_palette"), F.col("quality").alias("light"), F.col("toxic").alias("face"))
    return metrics.useful_rows(rows).select("doc_id")


_RATES = "rates AS (SELECT o_custkey AS feeling, o_orderkey AS item, (o_orderkey % 4)::DOUBLE AS rating FROM orders WHERE o_custkey % 30 < 3), cats AS (SELECT o_orderkey AS item, (o_orderkey % 3)::INT AS category FROM orders WHERE o_orderkey % 7 <> 0)"


def _rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    rates = o.where("o_custkey % 30 < 3").select(F.col("o_custkey").alias("feeling"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 4).cast("double").alias("rating"))
    return rates, o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 3).cast("int").alias("category"))


@query("WITH " + _RATES + """, g AS (SELECT feeling, category, list(item ORDER BY item) AS items, list(rating ORDER BY item) AS ratings FROM rates JOIN cats USING (item) WHERE feeling % 4 <> 0 GROUP BY feeling, category HAVING count(DISTINCT rating) > 1)
SELECT feeling, category, array_to_string(list_concat(items, [-1 FOR k IN range(12)])[1:12], ' ') AS items, array_to_string([round(x, 1) FOR x IN list_concat(ratings, [0.0 FOR k IN range(12)])[1:12]], ' ') AS ratings FROM g""")
def fit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated works of training feelings by category, padded; groups of one rating have no order to learn."""
    rates, cats = _rates(spark, sf_dir)
    splits = rates.select("feeling").distinct().withColumn("split", F.when(F.col("feeling") % 4 != 0, "train").otherwise("val"))
    g = metrics.fit_groups(rates, splits, cats, 12)
    text_ = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return g.select("feeling", "category", text_("items"), text_("ratings"))


@query("WITH " + _RATES + """ SELECT feeling, item, round(exp(rating / 0.5) / sum(exp(rating / 0.5)) OVER (PARTITION BY feeling, category), 8) AS target FROM rates JOIN cats USING (item)""")
def listwise_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of a group as a distribution at temperature one half."""
    rates, cats = _rates(spark, sf_dir)
    return metrics.listwise_targets(rates.join(cats, "item"), ["feeling", "category"], "rating", 0.5).select("feeling", "item", F.round("target", 8).alias("target"))


# --- audits ---------------------------------------------------------------------------------

_SKIP = str(audit.SKIPPED)
_WORDS = f"unnest(list_filter(list_distinct(regexp_extract_all(lower({{x}}), '[a-z]+')), lambda w: NOT list_contains({_SKIP}, w))) AS word"
_SHARES = f"w AS (SELECT doc_id, lang, {_WORDS.format(x='text')} FROM documents), t AS (SELECT lang, count(*) AS texts FROM documents GROUP BY lang), s AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)"


@query("WITH " + _SHARES + " SELECT lang, word, n, round(n / texts, 6) AS share FROM s JOIN t USING (lang) WHERE n / texts > 0.1")
def word_share_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = audit.word_shares(table(spark, sf_dir, "documents"), "lang", "text").withColumn("r", F.col("n") / F.col("texts"))
    return s.where("r > 0.1").select("lang", "word", "n", F.round("r", 6).alias("share"))


_FIELD = "f{k} AS (SELECT lang, word, count(*) / any_value(texts) AS share FROM (SELECT doc_id, lang, " + _WORDS + " FROM documents) JOIN (SELECT lang, count(*) AS texts FROM documents GROUP BY lang) USING (lang) GROUP BY lang, word)"
_FIRST = "string_split(text, chr(10))[1]"


@query("WITH " + _FIELD.format(k=0, x=_FIRST) + ", " + _FIELD.format(k=1, x="text") + ", g AS (SELECT count(DISTINCT lang) AS k FROM documents)"
       + " UNION ALL ".join(f" SELECT '{f}' AS field, lang, word, round(share, 6) AS share, share > {lim} AS flagged, round((t - share) / greatest(k - 1, 1), 6) AS others FROM f{n} JOIN (SELECT word, sum(share) AS t FROM f{n} GROUP BY word) USING (word), g WHERE share > 0.1" for n, (f, lim) in enumerate((("line", 0.25), ("text", 0.4)))))
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a tenth of a language's first lines or texts use, flagged above a quarter or two
    fifths, with their mean share in the other languages."""
    d = table(spark, sf_dir, "documents").select("lang", F.get(F.split("text", "\n"), F.lit(0)).alias("line"), "text")
    return audit.overuse(d, "lang", {"line": 0.25, "text": 0.4}, 0.1).select("field", "lang", "word", F.round("share", 6).alias("share"), "flagged", F.round("others", 6).alias("others"))


@query(f"""WITH d AS (SELECT DISTINCT doc_id, toxic FROM labels), w AS (SELECT doc_id, {_WORDS.format(x="text")} FROM documents),
c AS (SELECT count(*) FILTER (WHERE toxic = 1) AS n, count(*) FILTER (WHERE toxic = 0) AS m FROM d JOIN (SELECT DISTINCT doc_id FROM documents) USING (doc_id)),
k AS (SELECT word, count(*) FILTER (WHERE toxic = 1) AS a, count(*) FILTER (WHERE toxic = 0) AS b FROM w JOIN d USING (doc_id) GROUP BY word),
g AS (SELECT *, a / n AS pa, b / m AS pb FROM k, c),
f AS (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + lgamma(m + 1) - lgamma(a + b - x + 1) - lgamma(m - a - b + x + 1) - lgamma(n + m + 1) + lgamma(a + b + 1) + lgamma(n + m - a - b + 1)) FOR x IN range(a, least(n, a + b) + 1)]) AS p FROM g WHERE pa - pb >= 0.05 - 1e-9 AND pa >= 2 * greatest(pb, 1 / m) - 1e-9)
SELECT word, a, b, round(p, 6) AS p FROM f WHERE p < 0.05""")
def leak_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that toxic documents use more than others: gain, ratio and an exact test."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").distinct()
    d = table(spark, sf_dir, "documents").join(labels, "doc_id")
    side = [F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)]
    sizes = d.select("doc_id", "toxic").distinct().agg(side[0].alias("n"), side[1].alias("m"))
    used = audit.each_word(d, "text", "toxic").groupBy("word").agg(side[0].alias("a"), side[1].alias("b"))
    return audit.leaks(used, sizes).select("word", "a", "b", F.round("p", 6).alias("p"))


# --- metrics --------------------------------------------------------------------------------

_RATED = "r AS (SELECT lang, (quality + 2 * (1 - toxic))::DOUBLE AS rating, n_chars::DOUBLE AS sim, l.doc_id FROM labels l JOIN documents d USING (doc_id))"
_AUC = """, p AS (SELECT sum(CASE WHEN a.{s} > b.{s} THEN 1.0 WHEN a.{s} = b.{s} THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM r a JOIN r b ON a.lang = b.lang AND a.rating >= 3 AND b.rating < 3),
k AS (SELECT rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS x, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS y FROM r), c AS (SELECT corr(x, y) AS rho FROM k)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select("doc_id", "lang", (F.col("quality") + 2 * (1 - F.col("toxic"))).cast("double").alias("rating"), F.col("n_chars").cast("double").alias("sim")).withColumn("fit", F.col("rating") >= 3)


@query("WITH " + _RATED + _AUC.format(s="sim") + " SELECT round(auc, 6) AS auc FROM p")
def rated_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.within_auc(_rated(spark, sf_dir), "lang", "fit", "sim").select(F.round("auc", 6).alias("auc"))


@query("WITH " + _RATED + _AUC.format(s="sim") + " SELECT round(rho, 6) AS rho FROM c")
def rated_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(_rated(spark, sf_dir), "rating", "sim").select(F.round("rho", 6).alias("rho"))


_OBJ = "o{n} AS (SELECT (auc + rho) / 2 AS o FROM (SELECT sum(CASE WHEN a.s{n} > b.s{n} THEN 1.0 WHEN a.s{n} = b.s{n} THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM q a JOIN q b ON a.lang = b.lang AND a.rating >= 3 AND b.rating < 3), (SELECT corr(x, y) AS rho FROM (SELECT rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS x, rank() OVER (ORDER BY s{n}) + (count(*) OVER (PARTITION BY s{n}) - 1) / 2.0 AS y FROM q)))"


@query("WITH " + _RATED + ", q AS (SELECT *, sim AS s0, (doc_id % 17)::DOUBLE AS s1, sim + 1000 * (doc_id % 3) AS s2 FROM r), " + ", ".join(_OBJ.format(n=n) for n in range(3)) + """, a AS (SELECT o0.o AS student, o1.o AS baseline, o2.o AS installed FROM o0, o1, o2),
l AS (SELECT *, student - baseline >= 0.05 AS leads, student - installed >= -0.01 AS holds FROM a)
SELECT round(student, 6) AS student, round(baseline, 6) AS baseline, round(installed, 6) AS installed, leads AND holds AS ok, concat_ws(',', CASE WHEN NOT leads THEN 'lead' END, CASE WHEN NOT holds THEN 'installed' END) AS reasons FROM l""")
def ship_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score against a baseline's and an installed one's: how far it must lead, and may fall back."""
    r = _rated(spark, sf_dir)
    one = lambda score, name: metrics.objective(r.withColumn("s", score), "lang", "rating", "s", 3.0).select(F.col("objective").alias(name))
    rows = one(F.col("sim"), "student").crossJoin(one((F.col("doc_id") % 17).cast("double"), "baseline")).crossJoin(one(F.col("sim") + 1000 * (F.col("doc_id") % 3), "installed"))
    gate = metrics.ship_gate(F.col("student"), F.col("baseline"), F.col("student"), F.col("installed"))
    return rows.select(*[F.round(c, 6).alias(c) for c in ("student", "baseline", "installed")], gate["ok"].alias("ok"), gate["reasons"].alias("reasons"))


@query("WITH " + _RATED + """, p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sim DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM r),
q AS (SELECT doc_id, lang, rating, (k - 1) / greatest(n - 1, 1) AS place, sim FROM p)
SELECT 'missed' AS kind, doc_id, lang, rating, round(place, 6) AS place FROM (SELECT * FROM q WHERE rating >= 2 ORDER BY place DESC, sim, doc_id LIMIT 25)
UNION ALL SELECT 'false', doc_id, lang, rating, round(place, 6) FROM (SELECT * FROM q WHERE rating <= 0.5 ORDER BY place, sim DESC, doc_id LIMIT 25)""")
def worst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 fits that their group ranks lowest and the 25 others it ranks highest: a fixed report."""
    return metrics.worst(_rated(spark, sf_dir), "lang", "rating", "sim", "doc_id").select("kind", "doc_id", "lang", "rating", F.round("place", 6).alias("place"))


@query("""WITH d AS (SELECT d.doc_id, CASE WHEN doc_id % 3 <> 0 THEN abs(n_chars % 100 - 50) / 100.0::DOUBLE END AS gap, quality AS light, (n_chars % 2)::INT AS plight, toxic AS face, (doc_id % 2)::INT AS pface FROM documents d LEFT JOIN labels USING (doc_id))
SELECT round(avg(gap), 8) AS gap, round(avg(CASE WHEN light IS NOT NULL THEN (light = plight)::INT END), 8) AS light_accuracy, round(avg(CASE WHEN face IS NOT NULL THEN (face = pface)::INT END), 8) AS face_accuracy FROM d""")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean gap where there is a palette, and right choices where there is a label."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(F.when(F.col("doc_id") % 3 != 0, F.abs(F.col("n_chars") % 100 - 50) / 100).alias("gap"), F.col("quality").alias("light"), (F.col("n_chars") % 2).cast("int").alias("plight"), F.col("toxic").alias("face"), (F.col("doc_id") % 2).cast("int").alias("pface"))
    m = metrics.label_metrics(rows, "gap", [("light", "plight"), ("face", "pface")])
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


@query("""WITH v AS (SELECT range::INT AS label FROM range(0, 12)), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT v.label, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (), 8) AS prior FROM v LEFT JOIN c USING (label)""")
def class_prior_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class priors with one count added, over a vocabulary that has unused classes."""
    v = spark.range(12).select(F.col("id").cast("int").alias("label"))
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    rows = v.join(c, "label", "left").select("label", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return rows.crossJoin(rows.agg(F.sum("n").alias("t"))).select("label", F.round(F.col("n") / F.col("t"), 8).alias("prior"))


@query("""WITH p AS (SELECT list(prior ORDER BY k) AS prior FROM (SELECT k, (1 + count(e.vec_id)) / sum(1 + count(e.vec_id)) OVER () AS prior FROM range(10) r(k) LEFT JOIN embeddings e ON e.label = k GROUP BY k)),
t AS (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS tau), z AS (SELECT tau, label, [x[1] * 8 - tau * ln(x[2]) FOR x IN list_zip((embedding::DOUBLE[])[1:10], prior)] AS z FROM embeddings, p, t),
a AS (SELECT tau, avg((list_position(z, list_max(z)) - 1 = label)::INT) AS accuracy FROM z GROUP BY tau)
SELECT max(tau) AS tau, round(arg_max(accuracy, tau), 8) AS accuracy FROM a WHERE accuracy >= (SELECT accuracy FROM a WHERE tau = 0) - 0.02""")
def prior_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest correction by the prior that costs at most two points of accuracy."""
    e = table(spark, sf_dir, "embeddings")
    n = spark.range(10).select(F.col("id").cast("int").alias("label")).join(e.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    prior = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: x["n"]).alias("n")).select(F.transform("n", lambda x: x / F.aggregate("n", F.lit(0.0), lambda s, y: s + y)).alias("prior"))
    rows = e.select(F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 8).alias("logits"), "label")
    out = metrics.prior_correction(rows, prior)
    return out.select("tau", F.round("accuracy", 8).alias("accuracy"))


@query("""WITH r AS (SELECT 'r' || p_partkey AS name, p_size * 1000000 AS bytes, substr(sha1((p_partkey // 3)::VARCHAR), 1, 6) AS digest, CASE WHEN p_partkey % 10 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice % 7 END AS score FROM part),
f AS (SELECT *, first_value(score) OVER (PARTITION BY digest ORDER BY name) AS s FROM r WHERE bytes <= 24 * 1048576)
SELECT name FROM f ORDER BY CASE WHEN isnan(s) THEN '-inf'::DOUBLE ELSE s END DESC, bytes, name DESC LIMIT 1""")
def best_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score, then the smallest, of recipes under a size cap; equal digests share a score."""
    rows = table(spark, sf_dir, "part").selectExpr("'r' || p_partkey AS name", "p_size * 1000000 AS bytes", "substr(sha1(cast(p_partkey div 3 AS string)), 1, 6) AS digest", "CASE WHEN p_partkey % 10 = 0 THEN double('NaN') ELSE p_retailprice % 7 END AS score")
    return metrics.best_recipe(rows, 24 << 20)


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("""SELECT label, n, round(n / sum(n) OVER (), 6) AS share, count(*) OVER () AS classes FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ORDER BY n DESC, label LIMIT 1""")
def mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), F.max("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.count("*").alias("classes"))
