"""Quality rules whose cutoffs follow each language and source.

Fixed base rules fail a document outright. Of the rest, four integer measures go into
log-linear histograms (128 buckets a power of two, so a bucket is within 1/128 of its
values), one per (lang, source). Such sketches merge by adding counts, exactly and in
any order. Each language's sketch is added to those of its sources, scaled down to the
weight of `PRIOR` documents, and the sketch of all documents to each language's in the
same way: a source of few documents gets about its language's cutoffs, a large one its
own, and nothing switches at a size.

A cutoff is read off the group's sketch alone: as far beyond its tail quantile (`LEVELS`)
as that lies from the median. A group in which the quantile is zero, such as a source
without markup, so admits none of the measure, one in which it is common admits much.
Cutoffs are joined back to the measures, never to texts; a source with a third of all
rows is pre-aggregated for its sketch and its join is left to adaptive skew handling.

Defined results. Null, empty or wordless text: zero counts, base_failed. Null lang or
source: a group of its own. Repeated rows count each and are returned each. Ties fall in
one bucket, and a document is judged by its bucket. An empty table gives no rows. Whole
texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import byte_texts, discard, keyed, lean, materialize, wide

MIN_WORDS = 10
PRIOR = 50  # documents that the coarser sketch counts for in a finer one
#: The tail quantile of each measure, in thousandths, and whether short values are judged too.
LEVELS = {"word_len": (900, True), "symbols": (900, False), "dup_lines": (990, False), "repeats": (990, False)}
_UNIT = 1000  # a document's weight, so that the prior's shares are integers
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """How many words lie in a `size`-word window that occurs twice or more."""
    n = len(words)
    kinds = dict.fromkeys(words)
    if n <= size or len(kinds) == n:
        return 0
    number = dict(zip(kinds, range(len(kinds)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    bits = len(kinds).bit_length()
    if size * bits <= 63:
        key = ids[: n - size + 1].copy()
        for i in range(1, size):
            key = key << bits | ids[i : n - size + 1 + i]
    else:  # exact all the same: windows are numbered anew as they grow
        key = ids
        for i in range(1, size):
            key = np.unique(key[: n - i] * len(kinds) + ids[i:], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(size):
        covered[i : i + len(key)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word; those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines), len(lines) - len(set(lines))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for t in byte_texts(part.column(1)):
                    words = t.split() if t else []
                    if not words:
                        rows.append((0,) * 6)
                        continue
                    # code points: bytes that do not continue a character
                    joined = b"".join(words)
                    chars = len(joined) if joined.isascii() else len(joined.decode())
                    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
                    n_lines, dup = duplicate_lines(t)
                    rows.append((len(words), chars, symbols, dup, repeated_words(words), n_lines))
                cols = np.array(rows, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *map(pa.array, cols)], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
    return wide(keyed(docs, "doc_id", "text", "lang", "source")).mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, {counts}")


def bucket(value: Column) -> Column:
    """The lower end of value's log-linear bucket."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def per_mille() -> dict[str, Column]:
    part = lambda a, b: F.expr(f"{a} * 1000 div {b}")
    return {"word_len": part("word_chars", "n_words"), "symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def sketches(passed: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one histogram per group and measure."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in per_mille().items()]))
    return passed.select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups: sums of the finer ones' counts."""
    return table.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Null-safe equality of a's columns with b's, whose names end in an underscore."""
    out = F.lit(True)
    for c in by:
        out &= a[c].eqNullSafe(b[c + "_"])
    return out


def shrunk(fine: DataFrame, coarse: DataFrame, by: list[str], prior: int = PRIOR) -> DataFrame:
    """fine's sketches plus the coarser group's, scaled to the weight of prior documents.

    fine has the columns `by`, of which coarse has the first ones. Weights of fine are
    documents; the result's are thousandths of one, as are coarse's, if it was shrunk itself.
    """
    shared = [c for c in by if c in coarse.columns]
    share = coarse.withColumn("t", F.sum("n").over(Window.partitionBy(*shared, "measure")))
    share = share.select(*[F.col(c).alias(c + "_") for c in shared], "measure", "bucket", F.expr(f"{prior * _UNIT} * n div t").alias("n"))
    groups = fine.select(*by).distinct()
    lent = groups.join(share, _same(groups, share, shared)).select(*by, "measure", "bucket", "n")
    return merged(fine.withColumn("n", F.col("n") * _UNIT).select(*by, "measure", "bucket", "n").unionByName(lent), by)


def fences(table: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, lo and hi of each group's sketch."""
    w = Window.partitionBy(*by, "measure")
    level = F.coalesce(*[F.when(F.col("measure") == k, v) for k, (v, _) in LEVELS.items()])
    below = table.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w)).withColumn("level", level)
    at = lambda q: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * q, F.col("bucket")))
    cut = below.groupBy(*by, "measure").agg(at(1000 - F.col("level")).alias("low"), at(F.lit(500)).alias("mid"), at(F.col("level")).alias("high"))
    return cut.select(*by, "measure", (2 * F.col("low") - F.col("mid")).alias("lo"), (2 * F.col("high") - F.col("mid")).alias("hi"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and lo_*, hi_* of each measure."""
    langs = shrunk(merged(sketch, ["lang"]), merged(sketch, []), ["lang"], prior)
    rows = fences(shrunk(sketch, langs, ["lang", "source"], prior), ["lang", "source"])
    each = [F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"{c}_{k}") for k in LEVELS for c in ("lo", "hi")]
    return rows.groupBy("lang", "source").agg(*each)


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs."""
    bad = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    table = materialize(measures(docs).withColumn("base_failed", bad), "measures")
    sketch = materialize(sketches(table.where("NOT base_failed")), "sketch")
    cuts = materialize(thresholds(sketch, prior), "cuts").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    discard(sketch)
    rows = table.join(cuts, _same(table, cuts, ["lang", "source"]), "left")
    inside = F.lit(True)
    for k, v in per_mille().items():
        inside &= bucket(v) <= F.col(f"hi_{k}")
        if LEVELS[k][1]:
            inside &= bucket(v) >= F.col(f"lo_{k}")
    kept = F.when(F.col("base_failed"), False).otherwise(inside)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
grams AS (SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5)),
twice AS (SELECT r, unnest(range(i, i + 5)) AS pos FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
reps AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM twice GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM w LEFT JOIN lines USING (r) LEFT JOIN reps USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             word_chars * 1000 // nullif(n_words, 0) AS word_len, n_symbols * 1000 // nullif(word_chars, 0) AS symbols,
             n_dup_lines * 1000 // nullif(n_lines, 0) AS dup_lines, n_repeat_words * 1000 // nullif(n_words, 0) AS repeats FROM m),
v AS (SELECT lang, source, unnest(['word_len', 'symbols', 'dup_lines', 'repeats']) AS measure, unnest([word_len, symbols, dup_lines, repeats]) AS x FROM b WHERE NOT base_failed),
k AS (SELECT lang, source, measure, (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) AS bucket FROM v),
g AS (SELECT lang, source, measure, bucket, count(*) AS n FROM k GROUP BY ALL),
every AS (SELECT measure, bucket, sum(n)::BIGINT AS n, (sum(sum(n)) OVER (PARTITION BY measure))::BIGINT AS t FROM g GROUP BY measure, bucket),
l AS (SELECT lang, measure, bucket, sum(n)::BIGINT AS n FROM (SELECT lang, measure, bucket, n * 1000 AS n FROM g
      UNION ALL SELECT lang, measure, bucket, 50000 * n // t FROM (SELECT DISTINCT lang FROM g), every) GROUP BY lang, measure, bucket),
lt AS (SELECT *, (sum(n) OVER (PARTITION BY lang, measure))::BIGINT AS t FROM l),
s AS (SELECT lang, source, measure, bucket, sum(n)::BIGINT AS n FROM (SELECT lang, source, measure, bucket, n * 1000 AS n FROM g
      UNION ALL SELECT x.lang, x.source, measure, bucket, 50000 * n // t FROM (SELECT DISTINCT lang, source FROM g) x JOIN lt ON lt.lang IS NOT DISTINCT FROM x.lang) GROUP BY lang, source, measure, bucket),
cum AS (SELECT *, (sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket))::BIGINT AS upto, (sum(n) OVER (PARTITION BY lang, source, measure))::BIGINT AS total,
               CASE WHEN measure IN ('word_len', 'symbols') THEN 900 ELSE 990 END AS level FROM s),
q AS (SELECT lang, source, measure, min(bucket) FILTER (WHERE upto * 1000 >= total * (1000 - level)) AS low, min(bucket) FILTER (WHERE upto * 1000 >= total * 500) AS mid,
             min(bucket) FILTER (WHERE upto * 1000 >= total * level) AS high FROM cum GROUP BY ALL),
c AS (SELECT lang, source, measure, CASE WHEN measure = 'word_len' THEN 2 * low - mid ELSE 0 END AS lo, 2 * high - mid AS hi FROM q),
x AS (SELECT r, lang, source, unnest(['word_len', 'symbols', 'dup_lines', 'repeats']) AS measure, unnest([word_len, symbols, dup_lines, repeats]) AS x FROM b WHERE NOT base_failed),
ok AS (SELECT x.r, bool_and((x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) BETWEEN lo AND hi) AS inside
       FROM x JOIN c ON c.lang IS NOT DISTINCT FROM x.lang AND c.source IS NOT DISTINCT FROM x.source AND c.measure = x.measure GROUP BY x.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE inside END AS kept
FROM b LEFT JOIN ok USING (r)
"""
