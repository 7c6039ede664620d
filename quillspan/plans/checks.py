"""Filters and checks: the first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.functions import text
from quillspan.operators import validate
from quillspan.plans.base import query
from quillspan.sources.io import table


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 > 5 THEN 'page' WHEN o_orderstatus = 'P' THEN 'adult' WHEN o_orderkey % 7 = 0 THEN 'poster' WHEN year(o_orderdate) <> 1994 + o_custkey % 6 THEN 'year'
WHEN o_totalprice / 1000 < CASE WHEN year(o_orderdate) < 1997 THEN 50 WHEN year(o_orderdate) < 1998 THEN 100 ELSE 200 END THEN 'votes' END AS problem FROM orders""")
def film_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a film is left out: page, adult, poster, year, or votes under its era's floor."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    floor = F.when(year < 1997, 50).when(year < 1998, 100).otherwise(200)
    return o.select("o_orderkey", validate.film_problem(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 7 != 0, "x.jpg"), year, 1994 + F.col("o_custkey") % 6, F.col("o_custkey") % 7, F.lit(5), F.col("o_totalprice") / 1000, floor).alias("problem"))


_BOOK = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' Boxed Set' WHEN 1 THEN p_name || ' Books 1 - 3' WHEN 2 THEN '  ' ELSE p_name END"


@query("WITH t AS (SELECT p_partkey, " + _BOOK + """ AS title, p_partkey % 5 AS k, p_brand FROM part), a AS (SELECT *, CASE k WHEN 0 THEN NULL WHEN 1 THEN p_brand WHEN 2 THEN 'Second Hand' WHEN 3 THEN p_brand END AS author FROM t)
SELECT p_partkey, CASE WHEN trim(title) = '' THEN 'title' WHEN author IS NULL THEN 'author' WHEN regexp_matches(trim(title), '""" + text.BUNDLE_PATTERN + """') THEN 'bundle' END AS problem, author FROM a""")
def book_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with a title and a main author that are no bundles."""
    people = """CASE p_partkey % 5 WHEN 0 THEN array(named_struct('name', p_brand, 'role', 'Editor')) WHEN 1 THEN array(named_struct('name', ' ' || p_brand, 'role', cast(NULL AS string)))
        WHEN 2 THEN array(named_struct('name', '', 'role', 'Author'), named_struct('name', 'Second Hand', 'role', 'Author')) WHEN 3 THEN array(named_struct('name', p_brand, 'role', 'Author'), named_struct('name', 'x', 'role', 'Author')) END"""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_BOOK} AS title", f"coalesce({people}, cast(array() AS array<struct<name: string, role: string>>)) AS people")
    authors = validate.main_authors(F.col("people"))
    return t.select("p_partkey", validate.book_problem(F.col("title"), authors).alias("problem"), F.get(authors, F.lit(0)).alias("author"))


_SONG = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' (Live)' WHEN 1 THEN ' sped up' WHEN 2 THEN ' alive' ELSE '' END"


@query(f"SELECT p_partkey, y.year FROM part JOIN (SELECT o_custkey AS k, min(year(o_orderdate))::INT AS year FROM orders GROUP BY 1) y ON k = p_partkey WHERE NOT regexp_matches({_SONG}, '{text.VERSION}')")
def song_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs that are no other version of one and have a year."""
    years = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("p_partkey")).agg(F.min(F.year("o_orderdate")).alias("year"))
    return table(spark, sf_dir, "part").where(~F.expr(_SONG).rlike(text.VERSION)).join(years, "p_partkey").select("p_partkey", "year")


@query(r"""WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines, row_number() OVER (PARTITION BY lower(source), lower(text), len(string_split(text, chr(10))) BETWEEN 2 AND 40 ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL)
SELECT coalesce(CASE WHEN NOT lines BETWEEN 2 AND 40 THEN 'not 2-40 lines' WHEN k > 1 THEN 'duplicate title' END, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1""")
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poems by the reason that drops them; of equal ones of usable length the first stays."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("lines", F.size(F.split("text", "\n")))
    fits = F.col("lines").between(2, 40)
    d = d.withColumn("k", F.row_number().over(W.partitionBy(F.lower("source"), F.sha2(F.lower("text"), 256), fits).orderBy("doc_id")))
    return d.groupBy(F.coalesce(validate.poem_problem(F.col("lines"), F.col("k"), 2, 40), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_PICTURE = "CASE p_partkey % 8 WHEN 0 THEN 'PIA' || (10000 + p_partkey) WHEN 1 THEN p_name || ' rocket rollout' WHEN 2 THEN p_name || ' (Getty)' WHEN 3 THEN 'Portraits of ' || p_name WHEN 4 THEN 'x' || p_partkey ELSE p_name END"


@query(f"SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'rights' WHEN regexp_matches({_PICTURE}, '{validate.JUNK_PATTERN}') THEN 'junk' WHEN regexp_matches({_PICTURE} || ' ' || p_brand, '{validate.PEOPLE_PATTERN}') THEN 'people' WHEN regexp_matches(trim({_PICTURE}), '{validate.CATALOG_NUMBER}') THEN 'number' END AS problem FROM part")
def picture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose rights, subject or title keeps them out."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PICTURE} AS title", "p_brand", "p_size % 9 <> 0 AS free")
    return t.select("p_partkey", validate.picture_problem(F.col("title"), F.col("title"), F.concat_ws(" ", "title", "p_brand"), F.col("free")).alias("problem"))


_TAGS = "CASE {k} WHEN 0 THEN 'seen live' WHEN 1 THEN 'my favourites' WHEN 2 THEN '1999' WHEN 3 THEN 'indie' WHEN 4 THEN 'best of' ELSE 'dream pop' END"


@query("SELECT p_partkey, coalesce(string_agg(tag, ',' ORDER BY k) FILTER (WHERE NOT regexp_matches(tag, '" + validate.TAG_JUNK + "')), '') AS tags FROM (SELECT p_partkey, k, " + _TAGS.format(k="(p_partkey + 5 * k) % 7") + " AS tag FROM part, range(4) r(k)) GROUP BY p_partkey")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that say something about the work rather than about its listeners."""
    tags = F.expr("array(" + ", ".join(_TAGS.format(k=f"(p_partkey + {5 * k}) % 7") for k in range(4)) + ")")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(validate.clean_tags(tags, validate.TAG_JUNK), ",").alias("tags"))


_EXAMPLES = ["the last train home on a winter night"]
_FRAGMENTS = ["never name a title", "6 to 30 words"]
_TEXT = "CASE conv_id % 9 WHEN 0 THEN 'The last train  home on a winter night' WHEN 1 THEN text || ' Never NAME a title' WHEN 2 THEN NULL ELSE text END"


@query(r"WITH t AS (SELECT conv_id, turn, " + _TEXT + r""" AS t FROM conversations), n AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS n, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS s FROM t)
SELECT conv_id, turn, coalesce(n BETWEEN 6 AND 30 AND s <> 'the last train home on a winter night' AND NOT contains(s, 'never name a title') AND NOT contains(s, '6 to 30 words'), false) AS feeling FROM n""")
def feeling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of six to thirty words that copy neither an example nor the instructions."""
    t = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_TEXT} AS t")
    return t.select("conv_id", "turn", validate.is_feeling(F.col("t"), _EXAMPLES, _FRAGMENTS).alias("feeling"))


_CASES = [
    ("a quiet secret kept for a", "", "", None), ("", "", "", "line length"), ("one two three four five six seven eight nine ten eleven", "", "", "line length"), ("the", "", "", "line end"),
    ("the rain'skeeps falling", "", "", "glued words"), ("warm light", "blank", "", "no description"), ("warm light", "", "example", "query 2 copies"), ("warm light", "", "short", "query 2 length"),
    ("extraordinarilylong line", "", "", "word form"), ("warm light", "", "same", "equal queries"), ("bitter light", "", "", "blocked word"), ("never name a title", "", "", "instructions"), ("a dream, of,", "", "", None),
]


@query("SELECT p_partkey, ([" + ", ".join("NULL" if c[3] is None else f"'{c[3]}'" for c in _CASES) + f"])[p_partkey % {len(_CASES)} + 1] AS problem FROM part")
def validate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that an answer fails, over answers that each fail a stated one."""
    pick = lambda k: F.get(F.array(*[F.lit(c[k]) for c in _CASES]), F.pmod("p_partkey", F.lit(len(_CASES))).cast("int"))
    prose = F.when(pick(1) == "blank", " ").otherwise("It is a slow, well-lit story; nobody hurries.")
    q1 = F.lit("i walk home late and everything is still")
    q2 = F.when(pick(2) == "example", "The last train home on a winter night").when(pick(2) == "short", "too few words").when(pick(2) == "same", q1).otherwise("rain on the roof while i pack my bags")
    q3 = F.lit("we laughed until the lights went out again")
    problem = validate.answer_problem(pick(0), prose, [q1, q2, q3], text.forms_of(["bitter"]), _EXAMPLES, _FRAGMENTS)
    return table(spark, sf_dir, "part").select("p_partkey", problem.alias("problem"))


@query("""WITH t AS (SELECT p_partkey, (['film', 'song', 'poem', 'book'])[p_partkey % 4 + 1] AS c, p_partkey % 3 = 0 AS noimage, p_partkey % 5 = 0 AS noprimary, p_partkey % 7 = 0 AS nolink, p_partkey % 11 = 0 AS notext FROM part),
u AS (SELECT p_partkey, unnest([CASE WHEN c <> 'poem' AND noimage THEN 'no image' END, CASE WHEN noprimary THEN 'no primary link' END, CASE WHEN c = 'song' AND nolink THEN 'no link or preview' END, CASE WHEN c = 'poem' AND notext THEN 'no poem text' END]) AS problem FROM t)
SELECT p_partkey, problem FROM u WHERE problem IS NOT NULL""")
def bundle_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that items lack for their category."""
    p = table(spark, sf_dir, "part")
    mod = lambda n, v: F.when(F.col("p_partkey") % n != 0, v)
    category = F.get(F.array(*map(F.lit, ("film", "song", "poem", "book"))), F.pmod("p_partkey", F.lit(4)).cast("int"))
    problems = validate.item_problems(category, mod(3, "i"), mod(5, "p"), mod(7, "d"), F.lit("v"), mod(11, "t"))
    return p.select("p_partkey", F.explode(problems).alias("problem"))


@query(r"""SELECT s_suppkey, (['feeling', NULL, 'path', 'path', 'bundle', NULL, 'feeling', 'path'])[s_suppkey % 8 + 1] AS problem, regexp_full_match(CASE WHEN s_suppkey % 3 = 0 THEN substr(s_name, 1, 7) ELSE substr(s_name, 12, 7) END, '[0-9A-Za-z]{7}') AS code FROM supplier""")
def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a share request is refused, and which codes are codes."""
    k = "s_suppkey % 8"
    t = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", f"CASE {k} WHEN 0 THEN '  ' WHEN 6 THEN repeat('x', 501) ELSE ' hello ' END AS text",
        f"CASE {k} WHEN 2 THEN cast(array() AS array<string>) WHEN 3 THEN array('film:a', 'Film B') WHEN 4 THEN array('film:a') WHEN 5 THEN array('film:a', 'song:b-2') WHEN 7 THEN array_repeat('film:a', 51) END AS trail",
        f"CASE {k} WHEN 4 THEN 'a b' ELSE '2026-01-02-abc' END AS bundle", "CASE WHEN s_suppkey % 3 = 0 THEN substr(s_name, 1, 7) ELSE substr(s_name, 12, 7) END AS code",
    )
    return t.select("s_suppkey", validate.request_problem(F.col("text"), F.col("trail"), F.col("bundle")).alias("problem"), F.col("code").rlike(validate.CODE).alias("code"))


@query("""WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:3] AS c FROM embeddings) SELECT vec_id, c[1] BETWEEN 0 AND 1 AND c[2] BETWEEN -0.5 AND 0.5 AND c[3] BETWEEN -0.5 AND 0.5 AS ok, floor(c[2] * 1e4 + 0.5) / 1e4 AS a FROM e""")
def color_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in range, and one channel to four places, halves up."""
    from quillspan.functions.color import four_places

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("c"))
    return e.select("vec_id", validate.color_triple(F.col("c")).alias("ok"), four_places(F.get("c", F.lit(1))).alias("a"))


@query("""SELECT p_partkey, '{"id":' || p_partkey || ',"title":"' || p_name || '"' || CASE WHEN p_size % 3 = 0 THEN ',"year":null' ELSE ',"year":' || p_size END || CASE WHEN p_size % 2 = 0 THEN ',"album":"' || p_type || '"' ELSE '' END
|| CASE WHEN p_size % 5 = 0 THEN ',"image":null' ELSE ',"image":{"src":"i' || p_partkey || '"}' END || ',"links":{"primary":"p"' || CASE WHEN p_size % 4 = 0 THEN '' ELSE ',"other":"o"' END || '}}' AS json FROM part""")
def public_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as published: no nulls but year and image, no empty links."""
    p = table(spark, sf_dir, "part")
    row = {"id": F.col("p_partkey"), "title": F.col("p_name"), "year": F.when(F.col("p_size") % 3 != 0, F.col("p_size")), "album": F.when(F.col("p_size") % 2 == 0, F.col("p_type"))}
    links = F.create_map(F.lit("primary"), F.lit("p"), F.lit("other"), F.when(F.col("p_size") % 4 == 0, "").otherwise("o"))
    image = F.when(F.col("p_size") % 5 != 0, F.struct(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("src")))
    return p.select("p_partkey", validate.public_json(row, ["year"], links, image).alias("json"))


@query("""SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM part WHERE p_partkey < 500) AS items, (SELECT count(*) FROM part WHERE p_partkey < 500 AND p_partkey NOT IN (SELECT vec_id FROM embeddings)) AS lost, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS misfit,
(SELECT count(*) FROM embeddings) = (SELECT count(*) FROM part WHERE p_partkey < 500) AND (SELECT count(*) FROM part WHERE p_partkey < 500 AND p_partkey NOT IN (SELECT vec_id FROM embeddings)) = 0 AS ok""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vectors and items are the same keys, once each, and all vectors have one length."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return validate.conservation(v, table(spark, sf_dir, "part").where("p_partkey < 500").select(F.col("p_partkey").alias("id")), 64)


@query("""SELECT event_id, (props ->> '$.k')::BIGINT AS k, coalesce(props ->> '$.a.b', 'none') AS b FROM events""")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested field, and the default of one that is missing."""
    p = F.from_json("props", "k bigint, a struct<b string>")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["a"]["b"], F.lit("none")).alias("b"))
