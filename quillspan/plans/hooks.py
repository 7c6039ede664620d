"""Hooks at work: a job with a stand-in for the model, an encoder, rules by category."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import jobs
from quillspan.plans.base import query
from quillspan.sources.io import table


def _prompt(rows: list[dict]) -> str:
    return "\n".join(f"{k}. {r['p_name']} by {r['p_brand']}" for k, r in enumerate(rows, 1))


def _answer(prompt: str) -> str:
    """A stand-in for a model: numbered rows in upper case. At first it forgets rows of one brand."""
    rows = [line.split(". ", 1) for line in prompt.split("\n\n")[0].split("\n")]
    again = "refused" in prompt
    return json.dumps([{"n": int(n), "text": t.upper()} for n, t in rows if again or not t.endswith("Brand#9")])


def _accept(keys: list[str], answer: str) -> dict[str, dict]:
    """Records by number; titles of bolts are refused."""
    rows = json.loads(answer)
    numbers = [r["n"] for r in rows]
    return {keys[r["n"] - 1]: {"text": r["text"]} for r in rows if numbers.count(r["n"]) == 1 and "BOLT" not in r["text"]}


JOB = jobs.Job(_prompt, _accept, ("p_name", "p_brand"), per_request=20)


@query("""SELECT p_partkey::VARCHAR AS key, CASE WHEN p_name NOT LIKE '%bolt%' THEN '{"text": "' || upper(p_name || ' by ' || p_brand) || '"}' END AS record FROM part""")
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a job that asks for twenty keys at a time and takes up what was refused."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_brand")
    return JOB.records(JOB.requests(rows), _answer).select("key", "record")


def _shape(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count("e"), t.count(" ")] for t in texts], np.float32)


@query("""SELECT conv_id, turn, length(text)::FLOAT AS a, (length(text) - length(replace(text, 'e', '')))::FLOAT AS b, (length(text) - length(replace(text, ' ', '')))::FLOAT AS c FROM conversations""")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an encoder in batches of like length."""
    out = jobs.encoded(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", _shape, 2000)
    return out.select("conv_id", "turn", *[F.get("vector", F.lit(k)).alias(n) for k, n in enumerate("abc")])


@query("""SELECT p_partkey, upper(p_name) AS title, NULL::INT AS size FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey, p_name, p_size::INT FROM part WHERE p_type = 'SMALL' AND p_size > 10""")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of its own for each category."""
    rules = {"PROMO": lambda r: r.select("p_partkey", F.upper("p_name").alias("title")), "SMALL": lambda r: r.where("p_size > 10").select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").cast("int").alias("size"))}
    return jobs.by_category(table(spark, sf_dir, "part"), "p_type", rules)


_STYLES = [f"style {k}" for k in range(30)]


@query("WITH s AS (SELECT c_name AS s, row_number() OVER (ORDER BY sha256(c_name), c_name) - 1 AS i, count(*) OVER () AS c FROM customer), g AS (SELECT s, c, i * 30 + k AS id, k FROM s, range(30) r(k)) SELECT format('seed-{:04d}', id) AS key, s AS situation, 'style ' || k AS style, least(10, c * 200 - 5 - id * 10)::INT AS n FROM g WHERE id < c * 20")
def request_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of requests over a grid of situations (customers) and styles, two thirds of it used."""
    customers = table(spark, sf_dir, "customer").select("c_name")
    return jobs.seed_grid(customers, "c_name", _STYLES, customers.count() * 200 - 5, 10)
