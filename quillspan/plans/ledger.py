"""Sources, stores and state: landed answers, caches, ledgers, digests, bundles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.functions import hashing
from quillspan.functions.vectors import half
from quillspan.operators import joins, publish, state, versions
from quillspan.plans.base import query
from quillspan.sources import io
from quillspan.sources.io import table
from quillspan.sources.scratch import scratch_path
from quillspan.streaming.puts import put_if_absent


# --- files ----------------------------------------------------------------------------------


@query("""SELECT p_partkey::VARCHAR AS p_partkey, 'say "' || p_name || '", twice' AS title, p_type AS cls FROM part WHERE p_partkey % 5 <> 0 AND p_size % 2 = 0""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of a CSV file's columns, as text, of the rows that are free and have a title."""
    header = ["p_partkey", "title", "free", "Classification", "note"]
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 5 <> 0 THEN 'say \"' || p_name || '\", twice' END AS title", "CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END AS free", "p_type || ' | other' AS Classification", "'one\ntwo' AS note")
    path = scratch_path(spark, "csv")
    p.write.option("header", True).option("escape", '"').csv(path)
    rows = io.csv_columns(spark, path, header, ["p_partkey", "title", "free", "Classification"])
    return rows.where("free = 'True' AND title IS NOT NULL").select("p_partkey", "title", F.trim(F.element_at(F.split("Classification", r"\|"), 1)).alias("cls"))


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written in two appends and read again, and its summary."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = scratch_path(spark, "log")
    io.append_json_lines(e.where("event_id % 2 = 0"), path)
    io.append_json_lines(e.where("event_id % 2 = 1"), path)
    schema = StructType([f for f in e.schema.fields])
    rows = io.json_lines(spark, path, schema).where("event_type <> 'error'")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("""SELECT conv_id, turn, md5('{"conv_id":' || conv_id || ',"turn":' || turn || '}') AS line FROM conversations""")
def sorted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log rewritten in order of a key and of whole rows, in the place of the old one."""
    c = table(spark, sf_dir, "conversations").select("turn", "conv_id")
    path = scratch_path(spark, "sorted")
    io.write_json_lines(c, path)
    io.write_sorted(io.json_rows(spark, path, c.schema), path, "conv_id")
    lines = spark.read.text(path)
    parsed = F.from_json("value", c.schema)
    return lines.select(parsed["conv_id"].alias("conv_id"), parsed["turn"].alias("turn"), F.md5(F.replace(F.col("value"), F.lit(" "), F.lit(""))).alias("line"))


_HALF = "CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END"


@query("SELECT vec_id, round(sum(h * k), 6) AS total FROM (SELECT vec_id, k, " + _HALF + " AS h FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS k FROM embeddings)) GROUP BY vec_id")
def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored in half precision and read again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", io.decode_half(io.encode_half("embedding")).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(weighted, 6).alias("total"))


@query("SELECT event_id, " + _HALF.replace("x", "value") + " AS h FROM events")
def half_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers rounded to half precision without leaving the JVM."""
    return table(spark, sf_dir, "events").select("event_id", half(F.col("value")).alias("h"))


@query("""SELECT 'f' || s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'size' WHEN s_suppkey % 11 = 0 THEN 'digest' END AS problem FROM supplier""")
def file_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files against a registry of sizes and digests."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("name"), F.encode("s_name", "UTF-8").alias("content"))
    files = s.where("s_suppkey % 5 <> 0").select(F.concat(F.lit("/landing/"), "name").alias("path"), "content", F.length("content").alias("length"))
    digest = F.sha2(F.when(F.col("s_suppkey") % 11 == 0, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("content")), 256)
    registry = s.select("name", (F.length("content") + F.when(F.col("s_suppkey") % 7 == 0, 1).otherwise(0)).alias("bytes"), digest.alias("sha256"))
    return io.verified(files, registry)


@query("""WITH l AS (SELECT DISTINCT source AS author, lang AS title, text FROM documents WHERE doc_id % 5 <> 0 AND source <> 'src3' AND text IS NOT NULL),
s AS (SELECT DISTINCT source AS author, lang AS title, text FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL AND len(string_split(text, chr(10))) BETWEEN 2 AND 40 AND source NOT IN (SELECT author FROM l))
SELECT author, title, md5(text) AS text FROM l UNION ALL SELECT author, title, md5(text) FROM s""")
def poem_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors' lists, each poem once; an author whose list failed has the poems fetched by title."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("source").alias("author"), F.col("lang").alias("title"), "text")
    out = io.snapshot_poems(d.where("doc_id % 5 <> 0 AND author <> 'src3'"), d.where("doc_id % 7 = 0"), 2, 40)
    return out.select("author", "title", F.md5("text").alias("text"))


# --- remote sources that have landed ------------------------------------------------------------


@query("""WITH p AS (SELECT user_id AS source, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), g AS (SELECT source, (k - 1) // 4 + 1 AS page, list(event_id ORDER BY event_id) AS items FROM p GROUP BY 1, 2),
h AS (SELECT source, page, CASE WHEN (source + page) % 9 = 0 THEN [] ELSE items END AS items, 3 + source % 4 AS pages FROM g),
f AS (SELECT *, max((len(items) = 0)::INT) OVER (PARTITION BY source ORDER BY page) AS ended, coalesce(sum(len(items)) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WHERE page <= pages)
SELECT source, page, unnest(items) AS item FROM f WHERE ended = 0 AND before < 13""")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages up to the named total, the first empty one, or the quota."""
    from pyspark.sql.window import Window as W

    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    g = e.groupBy(F.col("user_id").alias("source"), (F.floor((F.col("k") - 1) / 4) + 1).alias("page")).agg(F.array_sort(F.collect_list("event_id")).alias("items"))
    g = g.select("source", "page", (3 + F.col("source") % 4).alias("pages"), F.when((F.col("source") + F.col("page")) % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.col("items")).alias("items"))
    return io.paged(g, 13)


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 404 ELSE 200 END AS status, CASE WHEN event_type = 'signup' THEN '<html>' ELSE props END AS body FROM events),
f AS (SELECT user_id, arg_min(CASE WHEN status = 200 THEN body ELSE '' END, event_id) AS body FROM e WHERE status = 404 OR (status = 200 AND body LIKE '{%') GROUP BY user_id)
SELECT c_custkey, f.user_id IS NOT NULL AS hit, nullif(body, '') AS body FROM customer LEFT JOIN f ON f.user_id = c_custkey""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that landed answers serve; secrets are no part of a key, errors are never kept."""
    e = table(spark, sf_dir, "events")
    url = lambda c, secret: F.concat(F.lit("https://api.example/x?id="), c.cast("string"), F.lit(f"&api_key={secret}"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 404).otherwise(200)
    landed = e.select(io.request_key(url(F.col("user_id"), "old"), None).alias("key"), F.col("event_id").alias("at"), status.alias("status"), F.when(F.col("event_type") == "signup", "<html>").otherwise(F.col("props")).alias("body"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", io.request_key(url(F.col("c_custkey"), "new"), None).alias("key"))
    return asked.join(io.cached_answers(asked.select("key"), landed), "key").select("c_custkey", "hit", "body")


@query("""WITH l AS (SELECT user_id AS host, event_id AS t, event_type NOT IN ('error', 'view', 'click') AS ok FROM events),
r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY host ORDER BY t) AS run FROM l), f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY host, run ORDER BY t) AS fails FROM r),
b AS (SELECT *, max((fails >= 3)::INT) OVER (PARTITION BY host ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broken FROM f)
SELECT host, t AS "at", ok, coalesce(broken, 0) = 0 AS allowed FROM b""")
def host_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host that fails three times in a row is asked no more."""
    e = table(spark, sf_dir, "events")
    return io.stopped_hosts(e.select(F.col("user_id").alias("host"), F.col("event_id").alias("at"), (~F.col("event_type").isin("error", "view", "click")).alias("ok")), 3)


@query("""WITH l AS (SELECT event_type AS host, event_id AS id, (epoch(ts)::BIGINT // 600)::DOUBLE AS t FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, id) * 1.5::DOUBLE AS k FROM l)
SELECT host, id, round(max(t - k) OVER (PARTITION BY host ORDER BY t, id) + k, 3) AS start FROM k""")
def request_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When requests may start, a second and a half apart for each host."""
    e = table(spark, sf_dir, "events")
    at = F.floor(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) / 600).cast("double")
    return io.paced(e.select(F.col("event_type").alias("host"), F.col("event_id").alias("id"), at.alias("at")), 1.5).select("host", "id", F.round("start", 3).alias("start"))


# --- stores -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_id % 97 = 0), a AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 97 <> 0 GROUP BY user_id)
SELECT user_id, event_id FROM a WHERE user_id NOT IN (SELECT user_id FROM s)""")
def put_if_absent_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    store, new = e.where("event_id % 97 = 0").select("user_id").distinct(), e.where("event_id % 97 <> 0")
    return put_if_absent(store, new, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id")


@query("""SELECT c_custkey AS code, CASE WHEN c_custkey % 3 = 0 THEN 'moods' WHEN c_custkey % 5 = 0 THEN 'paths' END AS origin, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS value FROM customer""")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value behind a code: from the store of feelings, else from that of paths."""
    c = table(spark, sf_dir, "customer").withColumn("code", F.col("c_custkey"))
    moods, paths = c.where("code % 3 = 0").select("code", F.col("c_name").alias("value")), c.where("code % 5 = 0").select("code", F.col("c_mktsegment").alias("value"))
    return publish.looked_up(c.select("code"), [("moods", moods), ("paths", paths)])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment END AS value, c_custkey % 4 = 0 AS precomputed FROM customer""")
def sample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precomputed results before computed ones."""
    c = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "rooms")
    publish.write_rooms(c.where("c_custkey % 4 = 0").select((F.col("c_custkey") % 4).alias("code"), "c_custkey", F.col("c_name").alias("value"), F.lit("t").alias("text")), path)
    ready = spark.read.parquet(path).select("c_custkey", "value")
    return publish.ready_or_computed(c, ready, c.select("c_custkey", F.col("c_mktsegment").alias("value")), "c_custkey")


@query("""SELECT s_suppkey::VARCHAR AS code, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS text, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 2 ELSE 0 END::INT AS steps,
CASE WHEN s_suppkey % 5 = 0 THEN 'faded' WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 THEN 'changed' END AS note FROM supplier""")
def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share links opened under one bundle: unknown codes, feelings, and paths of another bundle."""
    s = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey AS string) AS code", "CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS text", "CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN array('film:a', 'song:b') ELSE cast(array() AS array<string>) END AS trail", "CASE WHEN s_suppkey % 2 = 0 THEN 'b1' ELSE 'b0' END AS bundle")
    return publish.opened_path(s, F.lit("b1")).select("code", "text", F.size("trail").alias("steps"), "note")


@query("""WITH f AS (SELECT CASE WHEN s_suppkey = 0 THEN 'manifest.json' ELSE 'img/' || substr(sha256(s_name), 1, 20) || '.webp' END AS name, s_suppkey FROM supplier)
SELECT name, CASE WHEN name = 'manifest.json' THEN 1 ELSE 0 END::INT AS turn FROM f WHERE name NOT IN (SELECT name FROM f WHERE s_suppkey % 3 = 1)""")
def publish_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not online yet, the manifest last."""
    s = table(spark, sf_dir, "supplier")
    f = s.select("s_suppkey", F.when(F.col("s_suppkey") == 0, "manifest.json").otherwise(publish.image_key(F.sha2("s_name", 256))).alias("name"))
    return publish.uploads(f.select("name"), f.where("s_suppkey % 3 = 1"), "manifest.json")


_VERSION = """WITH l AS (SELECT {k} AS k, {k} || chr(0) || {d} || chr(10) AS line FROM {t}), r AS (SELECT substr(sha1(k), 1, 2) AS r, sha256(string_agg(line, '' ORDER BY k)) AS d FROM l GROUP BY 1)
SELECT substr(sha256(string_agg(d, '' ORDER BY r)), 1, 8) AS version FROM r"""


@query(_VERSION.format(k="n_nationkey::VARCHAR", d="n_name", t="nation"))
def content_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.content_version(table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string")), "n_nationkey", "n_name")


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'bundles/2026-01-0' || n_nationkey % 8 || '-abc' || n_nationkey % 10 || '/' ELSE 'bundles/2026-02-01-zz' || n_nationkey || '/' END AS prefix, n_nationkey % 2 = 0 AS reused FROM nation WHERE n_nationkey IN (4, 7)""")
def publish_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An online prefix with the same content is used again; new content gets a new one."""
    n = table(spark, sf_dir, "nation")
    online = n.where("n_nationkey < 8").select(F.concat(F.lit("bundles/2026-01-0"), (F.col("n_nationkey") % 8).cast("string"), F.lit("-abc"), (F.col("n_nationkey") % 10).cast("string"), F.lit("/")).alias("prefix"))
    one = publish.reused_prefix(online, F.lit("abc4"), F.lit("2026-02-01"))
    return one.union(publish.reused_prefix(online, F.lit("zz7"), F.lit("2026-02-01")))


@query("""SELECT 'supplier' AS name, count(*) AS rows, count(*) AS again FROM supplier UNION ALL SELECT 'nation', count(*), count(*) FROM nation""")
def bundle_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle written, installed over an older one, and read back with its manifest."""
    tables = {"supplier": table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "id"), "nation": table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "id")}
    target = scratch_path(spark, "bundle")
    publish.write_bundle({k: v.limit(3) for k, v in tables.items()}, "id", target)
    publish.write_bundle(tables, "id", target)
    told = publish.read_document(spark, f"{target}/manifest.json")["tables"]
    counted = joins.union_of(*[spark.read.parquet(f"{target}/{n}").agg(F.count("*").alias("again")).withColumn("name", F.lit(n)) for n in tables])
    return counted.join(spark.createDataFrame([(n, t["rows"]) for n, t in told.items()], "name string, rows long"), "name").select("name", "rows", "again")


# --- state ----------------------------------------------------------------------------------------


@query("""SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def pending_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return joins.pending(c, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id")), key="conv_id")


@query("""WITH a AS (SELECT s_suppkey AS key, s_name, s_nationkey FROM supplier WHERE s_suppkey % 7 <> 0), b AS (SELECT s_suppkey AS key, s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS reason FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.s_name <> b.s_name OR a.s_nationkey <> b.s_nationkey""")
def stamp_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    new = s.where("s_suppkey % 11 <> 0").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    snap = lambda d: state.snapshot(d, "s_suppkey", "s_name", "s_nationkey")
    return state.changes(snap(s.where("s_suppkey % 7 <> 0")), snap(new))


@query("""SELECT s_suppkey, 'config.n' AS path, 'config.n changed: ' || s_nationkey || ' -> ' || s_nationkey + 1 AS reason FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'inputs.a.csv', 'inputs.a.csv changed: none -> "' || s_name || '"' FROM supplier WHERE s_suppkey % 3 = 0""")
def nested_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two nested states, path by path."""
    s = table(spark, sf_dir, "supplier")
    doc = lambda n, name: F.to_json(F.struct(F.struct(n.alias("n"), F.lit(1).alias("m")).alias("config"), F.struct(F.struct(name.alias("csv")).alias("a")).alias("inputs")))
    old = s.select("s_suppkey", doc(F.col("s_nationkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))).alias("doc"))
    new = s.select("s_suppkey", doc(F.col("s_nationkey") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0), F.col("s_name")).alias("doc"))
    return state.nested_changes(old, new, "s_suppkey", "doc").where("path <> 'inputs.a'")


@query("""WITH c AS (SELECT user_id AS key, event_type AS digest, event_id AS ordinal, value FROM events), p AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS digest FROM events GROUP BY user_id)
SELECT key, arg_max(c.ordinal, c.ordinal) AS ordinal, arg_max(c.value, c.ordinal) AS value FROM c JOIN p USING (key, digest) WHERE c.value > 0 GROUP BY key""")
def fingerprint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cache = e.select(F.col("user_id").alias("key"), F.col("event_type").alias("digest"), F.col("event_id").alias("ordinal"), "value")
    prints = joins.last_wins(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("digest"), "ts", "event_id"), "key", F.struct("ts", "event_id")).select("key", "digest")
    return state.reusable(cache, prints, F.col("value") > 0)


_CACHE = "cache AS (SELECT event_id AS ordinal, user_id AS key, 'm' || event_id % 4 // 3 AS signature, event_type AS print, value FROM events WHERE user_id % 4 <> 0)"


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    cache = e.where("user_id % 4 <> 0").selectExpr("event_id AS ordinal", "user_id AS key", "'m' || event_id % 4 div 3 AS signature", "event_type AS print", "value")
    return cache, e.select(F.col("user_id").alias("key")).distinct().withColumn("print", F.when(F.col("key") % 3 == 0, "click").otherwise("view"))


@query("WITH " + _CACHE + """, w AS (SELECT DISTINCT user_id AS key, CASE WHEN user_id % 3 = 0 THEN 'click' ELSE 'view' END AS print FROM events),
ok AS (SELECT DISTINCT key FROM cache JOIN w USING (key, print) WHERE signature = 'm0' AND value > 14), l AS (SELECT key, arg_max(signature, ordinal) AS s, arg_max(print, ordinal) AS p FROM cache GROUP BY key)
SELECT key, CASE WHEN ok.key IS NOT NULL THEN NULL WHEN l.key IS NULL THEN 'new key' WHEN s <> 'm0' THEN 'signature' WHEN p <> w.print THEN 'prompt' ELSE 'rejected' END AS reason FROM w LEFT JOIN ok USING (key) LEFT JOIN l USING (key)""")
def cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each key needs a request: new, another signature, another prompt, or a rejected answer."""
    cache, wanted = _cache(spark, sf_dir)
    return state.plan_of(cache, wanted, "m0", F.col("value") > 14)


@query("WITH " + _CACHE + """, w AS (SELECT DISTINCT user_id AS key, CASE WHEN user_id % 3 = 0 THEN 'click' ELSE 'view' END AS print FROM events), ok AS (SELECT DISTINCT key FROM cache JOIN w USING (key, print) WHERE signature = 'm0' AND value > 14)
SELECT count(*) AS keys, count(ok.key) AS used, count(*) - count(ok.key) AS missing, ceil((count(*) - count(ok.key)) / 7)::BIGINT AS requests FROM w LEFT JOIN ok USING (key)""")
def cache_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, wanted = _cache(spark, sf_dir)
    return state.coverage(state.plan_of(cache, wanted, "m0", F.col("value") > 14), 7)


@query("WITH " + _CACHE + """, w AS (SELECT DISTINCT user_id AS key, CASE WHEN user_id % 3 = 0 THEN 'click' ELSE 'view' END AS print FROM events), u AS (SELECT max(ordinal) AS ordinal FROM cache JOIN w USING (key, print) WHERE signature = 'm0' AND value > 14 GROUP BY key)
SELECT 'unused' AS kind, count(*) AS n FROM cache WHERE ordinal NOT IN (SELECT ordinal FROM u) UNION ALL SELECT 'kept', count(*) FROM u""")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that no used record comes from, and what a prune leaves."""
    cache, wanted = _cache(spark, sf_dir)
    used = state.reusable(cache.where("signature = 'm0'").withColumnRenamed("print", "digest").drop("signature"), wanted.withColumnRenamed("print", "digest"), F.col("value") > 14)
    kept = state.pruned(cache, state.table_digest(cache), used)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(state.unused(cache, used), "unused").union(count(kept, "kept"))


@query("WITH " + _CACHE + """ SELECT key, max(ordinal) AS ordinal, upper(arg_max(print, ordinal)) AS shown FROM cache WHERE key % 4 = 1 GROUP BY key""")
def materialized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted records of all wanted keys, projected; a key without one is an error."""
    cache, wanted = _cache(spark, sf_dir)
    records = cache.groupBy("key").agg(F.max("ordinal").alias("ordinal"), F.max_by("print", "ordinal").alias("print"))
    keys = cache.where("key % 4 = 1").select("key").distinct()
    return state.projected(records, keys, lambda r: r.select("key", "ordinal", F.upper("print").alias("shown")))


_LEDGER = "req AS (SELECT c_custkey AS id, sha256(c_name || CASE WHEN c_custkey % 6 = 0 THEN '!' ELSE '' END) AS request FROM customer), led AS (SELECT event_id AS n, sha256('Customer#' || lpad(user_id::VARCHAR, 9, '0')) AS request, (value::BIGINT % 5)::INT AS emotion FROM events)"


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, e = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    requests = c.select(F.col("c_custkey").alias("id"), F.sha2(F.concat("c_name", F.when(F.col("c_custkey") % 6 == 0, "!").otherwise("")), 256).alias("request"))
    ledger = e.select(F.col("event_id").alias("n"), F.sha2(F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")), 256).alias("request"), (F.rint("value").cast("long") % 5).cast("int").alias("emotion"))
    return requests, ledger


@query("WITH " + _LEDGER + " SELECT id FROM req WHERE request NOT IN (SELECT request FROM led)")
def ungraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose current request has no grade."""
    return state.ungraded(*_ledger(spark, sf_dir)).select("id")


@query("WITH " + _LEDGER + " SELECT id FROM req JOIN (SELECT request, arg_max(emotion, n) AS g FROM led GROUP BY request) USING (request) WHERE g < 2")
def failing_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those whose last grade for the current request is too low, under today's threshold."""
    return state.failing(*_ledger(spark, sf_dir), "emotion", 2, "n")


@query("""WITH k AS (SELECT n_nationkey AS key FROM nation), l AS (SELECT n_nationkey AS key, 'old' AS w, 'd' || n_nationkey % 3 AS d FROM nation WHERE n_nationkey % 4 <> 0), f AS (SELECT n_nationkey AS key FROM nation WHERE n_nationkey % 5 <> 0)
SELECT k.key, CASE WHEN d = 'd1' THEN 'old' WHEN f.key IS NOT NULL THEN 'new' ELSE '' END AS words, CASE WHEN d = 'd1' OR k.key % 2 = 0 THEN 'd1' END AS digest FROM k LEFT JOIN l USING (key) LEFT JOIN f USING (key)""")
def frozen_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that stay while their digest does, and new ones, frozen only if their sample was whole."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    lists = n.where("key % 4 <> 0").select("key", F.array(F.lit("old")).alias("words"), F.concat(F.lit("d"), (F.col("key") % 3).cast("string")).alias("digest"))
    found = n.where("key % 5 <> 0").withColumn("new", F.array(F.lit("new")))
    out = state.frozen(lists, n.withColumn("now", F.lit("d1")), found, n.where("key % 2 = 0"))
    return out.select("key", F.array_join("words", " ").alias("words"), "digest")


@query("""SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def kept_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops that a newer version can't mend stay dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus")
    return state.still_dropped(o, 2, 3, (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).select("id")


@query("""SELECT 'orders.parquet' AS file UNION ALL SELECT 'nation.parquet'""")
def observed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files the rows of two scans came from."""
    return state.read_files(table(spark, sf_dir, "orders")).union(state.read_files(table(spark, sf_dir, "nation")))


@query("""WITH n AS (SELECT (SELECT count(*) FROM part) AS part, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitem)
SELECT 'part' AS step, part AS rows, 'up to date' AS status, '' AS reasons FROM n UNION ALL SELECT 'orders', orders, 'will run', 'inputs.rows changed' FROM n
UNION ALL SELECT 'lineitem', lineitem, 'will run', 'orders will run' FROM n UNION ALL SELECT 'export', orders + lineitem, 'will run', 'no stamp' FROM n""")
def step_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run over steps whose inputs are tables: stamps know part and lineitem as they are, and
    orders with a row less."""
    noop, have = lambda: None, {t: table(spark, sf_dir, t).count() for t in ("part", "orders", "lineitem")}
    have["export"] = have["orders"] + have["lineitem"]
    steps = [state.Step(t, "build", lambda t=t: {"inputs": {"rows": have[t]}}, noop, needs) for t, needs in (("part", ()), ("orders", ()), ("lineitem", ("orders",)), ("export", ()))]
    known = {t: {"inputs": {"rows": have[t] - (t == "orders")}} for t in ("part", "orders", "lineitem")}
    rows = [(name, have[name], "will run" if why else "up to date", "; ".join(why)) for name, why in state.dry_run(steps, state.Stamps(known), "build")]
    return spark.createDataFrame(rows, "step string, rows long, status string, reasons string")


# --- versions -----------------------------------------------------------------------------------


@query("""WITH used AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 3 ELSE 1 END AS since FROM events WHERE user_id IN (SELECT user_id FROM used)""")
def raced_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that one writer prunes and another appends to: the prune that was decided on the older
    version is refused, and is done on the newest one; what the newest version shows."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    used = rows.where("event_type = 'purchase'").select("user_id").distinct()
    store = versions.VersionedTable(spark, scratch_path(spark, "cache"))
    first = store.change(lambda _: rows.where("event_id % 5 <> 0").select("event_id", "user_id", F.lit(1).alias("since")))
    store.change(lambda old: old.union(rows.where("event_id % 5 = 0").select("event_id", "user_id", F.lit(3).alias("since"))))
    keep = lambda df: df.join(used, "user_id", "left_semi").select("event_id", "user_id", "since")
    try:
        versions.prune(store, first, keep)
    except versions.Lost:
        versions.prune(store, store.version(), keep)
    return store.read()


@query("""SELECT p_type AS category, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_size > 3 GROUP BY p_type""")
def bundle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of items published, and published again without some; what readers of the newest
    version count."""
    items = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    store = versions.VersionedTable(spark, scratch_path(spark, "bundle"))
    store.change(lambda _: items)
    store.change(lambda old: old.where("p_size > 3"))
    return store.read().groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


# --- documents, swaps and runs that write and are read back -----------------------------------


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document of the orders' totals by priority (five rows), replaced once, and read back."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    path = scratch_path(spark, "totals") + ".json"
    publish.write_document(spark, path, {"rows": []})
    publish.write_document(spark, path, {"rows": [r.asDict() for r in totals.collect()]})
    return spark.createDataFrame([(r["priority"], r["n"], float(r["total"])) for r in publish.read_document(spark, path)["rows"]], "priority string, n long, total double")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25")
def swap_install(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table installed in the place of an older one."""
    rows, place = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), scratch_path(spark, "installed")
    for part in (rows.where("l_quantity > 45"), rows.where("l_quantity > 25")):
        staging = scratch_path(spark, "staging")
        part.write.parquet(staging)
        publish.swapped_in(spark, staging, place)
    return spark.read.parquet(place)


def _built(spark: SparkSession, sf_dir: str) -> tuple[list[state.Step], str, dict[str, str]]:
    """Steps: customers with their orders' sum, then the sums by nation; the inputs' digests are their states."""
    root, limit = scratch_path(spark, "steps"), {"least": "0"}
    sums = lambda: table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    customers = lambda: table(spark, sf_dir, "customer").join(sums(), "c_custkey").where(F.col("spent") > float(limit["least"])).select("c_custkey", "c_nationkey", "spent").write.mode("overwrite").parquet(f"{root}/customers")
    nations = lambda: spark.read.parquet(f"{root}/customers").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("spent"), 2).alias("spent")).write.mode("overwrite").parquet(f"{root}/nations")
    digest = state.table_digest(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    steps = [state.Step("customers", "build", lambda: {"inputs": {"customer": digest}, "config": dict(limit)}, customers), state.Step("nations", "build", lambda: {"config": dict(limit)}, nations, ("customers",))]
    return steps, root, limit


@query("SELECT c_nationkey, count(*) AS customers, round(sum(spent), 2) AS spent, 'done,done,up to date,up to date,done,done' AS runs FROM (SELECT c_custkey, c_nationkey, sum(o_totalprice) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING sum(o_totalprice) > 100000) GROUP BY c_nationkey")
def steps_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that run, are found current, and run again after a change; what they have written."""
    steps, root, limit = _built(spark, sf_dir)
    stamps, runs = state.Stamps(), []
    for least in ("0", "0", "100000"):
        limit["least"] = least
        runs += [status for _, status in state.run_steps(steps, stamps, "build")]
    return spark.read.parquet(f"{root}/nations").withColumn("runs", F.lit(",".join(runs)))


@query("SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1")
def provenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provenance document whose step has counted a table; its configuration, read back from the file."""
    counts, path = {r.s: r.n for r in table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n")).collect()}, scratch_path(spark, "provenance") + ".json"  # five segments
    stamps = state.Stamps()
    state.run_steps([state.Step("count", "build", lambda: {"inputs": counts}, lambda: None)], stamps, "build")
    publish.write_document(spark, path, json.loads(state.provenance(stamps, {"format": "1"}, {"table": "customer"})))
    found = publish.read_document(spark, path)["steps"]["count"]["inputs"]
    return spark.createDataFrame(sorted(found.items()), "segment string, customers long")
