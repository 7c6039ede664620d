"""Spelling variants: words of the corpus at distance one, by a trie self-join.

The vocabulary is a trie that is cut by prefix, one subtrie a group of rows. A group's
trie is walked once; each node inherits its active nodes, those at distance one, from
its parent: the parent itself (a letter deleted), the node's siblings (replaced) and its
children (inserted), and what the parent's active nodes have under the same letter.
Where a word ends, the active nodes at which one ends are its near words.

A pair whose edit lies in the prefix isn't in one subtrie, but then it agrees on the
rest. So words of length 2j and 2j + 1 are filed in class j (those of length 2j + 2 too,
as longer members) under their first j letters, and again under their last j: a pair
is taken under its prefix if that is equal, else under its suffix. A group whose letters
exceed `limit` is cut again in the same way, by half of what its words have between
prefix and suffix, so no task holds more than the trie of a bounded number of letters
(or of all strings of three) however many words share a prefix. Near words are counted
in the group; per word and group one row leaves the task.

Roots come from pointer doubling over the words that have a form; n at least doubles at
every step, so there are at most seven rounds.

Defined results. Null, empty or letterless text: no words. A null doc_id is written as
an empty id when letters are deleted. Rows that repeat are counted each. Very long texts
and runs are used whole. An empty table gives no rows. Only doc_id and text are read, so
further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import discard, keyed, lean, materialize, wide

LEAST_LENGTH, LEAST_COUNT = 5, 3
LIMIT = 1 << 17  # letters in a group's trie
SLIP = 97  # one run of a document in so many loses a letter
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, near long, best long, form string"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def slipped(doc_id: Column, word: Column) -> Column:
    """The word, or, where SLIP divides the checksum of id and word, without one of its letters."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Each word of the corpus with its number of occurrences: word, n."""
    runs = wide(keyed(docs, "doc_id", "text")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    each = runs.select("doc_id", lower_ascii(F.col("run")).alias("run")).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return each.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key() -> Column:
    return F.xxhash64("j", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, hi)"))


def filed(vocabulary: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Words under their classes' prefixes and suffixes. A row's group is `key`; its words share
    the first lo and the last hi letters; pairs that share the first `bar` are found elsewhere."""
    half = F.floor(F.length("word") / 2).cast("int")
    classes = F.when((F.length("word") % 2 == 0) & (half - 1 >= least_length // 2), F.array(half, half - 1)).otherwise(F.array(half))
    ways = F.array(*[F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), bar.cast("int").alias("bar")) for lo, hi, bar in ((F.col("j"), F.lit(0), F.lit(-1)), (F.lit(0), F.col("j"), F.col("j")))])
    return vocabulary.select("word", "n", F.explode(classes).alias("j")).select("word", "n", "j", F.inline(ways)).withColumn("key", _key())


def cut(groups: DataFrame, limit: int) -> DataFrame:
    """groups, those with more letters than limit cut until none is left that can be."""
    while True:
        between = F.length("word") - F.col("lo") - F.col("hi")
        hot = groups.groupBy("key").agg(F.sum(between).alias("letters"), F.min(2 * F.col("j") - F.col("lo") - F.col("hi")).alias("room"))
        hot = materialize(hot.where((F.col("letters") > limit) & (F.col("room") >= 2)).select("key"), "hot-prefixes")
        if hot.isEmpty():
            return groups
        rest = groups.join(hot, "key", "left_anti")
        half = F.floor((2 * F.col("j") - F.col("lo") - F.col("hi")) / 2).cast("int")
        ways = F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("hi"), F.col("bar")), F.struct(F.col("lo"), (F.col("hi") + half).alias("hi"), (F.col("lo") + half).alias("bar")))
        again = groups.join(hot, "key", "left_semi").select("word", "n", "j", F.inline(ways)).withColumn("key", _key())
        groups = materialize(rest.unionByName(again), "prefix-groups")


def near_in_trie(middles: list[str]) -> Iterator[tuple[int, set[int]]]:
    """For each of these different strings that has some: its index, and the indices of those at distance one."""
    root: dict[str, Any] = {}
    for k, middle in enumerate(middles):
        node = root
        for letter in middle:
            node = node.setdefault(letter, {})
        node[""] = k
    todo = [(root, [child for letter, child in root.items() if letter])]
    while todo:
        node, active = todo.pop()
        end = node.get("")
        if end is not None:
            near = {m[""] for m in active if "" in m}
            if near:
                yield end, near
        for letter, child in node.items():
            if letter:
                under = [node]
                under += [sibling for x, sibling in node.items() if x and x != letter]
                under += [below for x, below in child.items() if x]
                under += [m[letter] for m in active if letter in m]
                todo.append((child, under))


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NEAR rows of the groups, which come sorted by key."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("key", "j", "lo", "hi", "bar", "word", "n")), strict=True))
    out: list[tuple[str, int, int, str]] = []
    for _, group in groupby(rows, key=itemgetter(0)):
        members = list(group)
        if len(members) > 1:
            _, j, lo, hi, bar, _, _ = members[0]
            longer = 2 * j + 2
            middles = [w[lo : len(w) - hi] for _, _, _, _, _, w, _ in members]
            if len(set(middles)) < len(middles):
                members, middles = _apart(members, middles)  # two groups under one hash
            for at, near in near_in_trie(middles):
                word = members[at][5]
                head, tail, skip = word[:lo], word[len(word) - hi :], word[:bar] if bar >= 0 else None
                count, best, form = 0, -1, ""
                for k in near:
                    other, n = members[k][5], members[k][6]
                    if len(word) == len(other) == longer or other[:bar] == skip or other[:lo] != head or other[len(other) - hi :] != tail:
                        continue
                    count += 1
                    if n > best or n == best and other < form:
                        best, form = n, other
                if count:
                    out.append((word, count, best, form))
        if len(out) >= 8192:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _apart(members: list[tuple], middles: list[str]) -> tuple[list[tuple], list[str]]:
    """Whole words in place of the middles, where a hash has met two groups."""
    return members, [m[5] for m in members]


def _batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    word, near, best, form = zip(*rows, strict=True)
    return pa.record_batch([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best, pa.int64()), pa.array(form, pa.string())], ["word", "near", "best", "form"])


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, limit: int = LIMIT) -> DataFrame:
    """Per word that has near words: how many, and the one with the largest n: word, n_near, best, form."""
    groups = cut(filed(vocabulary, least_length), limit)
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = groups.select("key", "j", "lo", "hi", "bar", "word", "n").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lean(_near_words), NEAR)
    best = F.min(F.struct((-F.col("best")).alias("best"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.best")).alias("best"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """The last of the forms that follow each other from each word of (word, form): word, root.
    Forms must not lead in circles."""
    at = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        # a word whose last step led nowhere is at its root, and asks no more
        onward = at.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moving = at.where("moved").join(onward, F.col("root") == F.col("_at"), "left")
        moving = moving.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved"))
        before, at = at, materialize(at.where("NOT moved").unionByName(moving), "roots")
        discard(before)
    return at.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, limit: int = LIMIT) -> DataFrame:
    """The words of docs with the form that each is a variant of: word, form, root, n, n_near, form_n."""
    vocabulary = materialize(words(docs, least_length, least_count), "vocabulary")
    near = vocabulary.join(near_words(vocabulary, least_length, limit), "word", "left")
    is_form = F.col("best") >= 2 * F.col("n")
    table = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("best")).alias("form_n")), "variants")
    out = table.join(roots(table.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc_table() -> list[int]:
    """What one nibble adds to a CRC-32, by the polynomial's rule."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
codes AS (
  SELECT run, n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: unicode(x)::BIGINT) AS points FROM runs),
nibbles AS (
  SELECT run, n, flatten(list_transform(flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END)), lambda b: [b & 15, b >> 4])) AS bits
  FROM codes),
summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 4, ({_crc_table()}::BIGINT[])[(xor(c, b) & 15) + 1])), 4294967295) AS h FROM nibbles),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
holes AS (
  SELECT word, n, k, substr(word, 1, k::INT - 1) || substr(word, k::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS best, (min(struct_pack(m := -n, other := other))).other AS form FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * w.n THEN form END AS form, CASE WHEN best >= 2 * w.n THEN best END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
steps AS (
  SELECT word, word AS place, form AS onward FROM forms
  UNION ALL SELECT s.word, s.onward, f.form FROM steps s JOIN forms f ON s.onward = f.word)
SELECT f.word, f.form, s.place AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON f.word = s.word AND s.onward IS NULL
"""
