"""Names in free text: the item that a query names, and what is prepared for it.

A query names an item if the item's title, its album or its creator, or a title or album
with the creator, stand in it as runs of words and cover every word that isn't filler.
Queries meet names by an equi-join on runs of words: a run is one row, however many items
there are, and items of one creator or album are reduced to the best before the join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import FILLER_WORDS, content_words, exact_name, plain_words
from quillspan.operators.search import representative
from quillspan.sources.scratch import bounded_batches, staged

#: Fixed value: the order in which categories win a tie.
CATEGORY_ORDER = ("film", "song", "book", "art", "poem")


#: A vocabulary's entry that is a word, without the marks of its start or end.
_ENTRY = re.compile("(?:\u2581|\u0120|##)?([a-z0-9]+)(?:</w>)?")


def _all_common(words: Column, common: list[str]) -> Column:
    return F.forall(words, lambda w: w.isin(common)) if common else F.size(words) == 0


def prepared(items: DataFrame, common: list[str]) -> DataFrame:
    """Names of items (id, category, title, creator, album) as words: phrases title, creator and
    album (null if empty), their sizes, exact names, and whether a phrase has common words only."""
    rows = items.select("id", "category", "title", "creator", "album", *[plain_words(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("title", "creator", "album")])
    for c in ("title", "creator", "album"):
        w = content_words(F.col(f"_{c}"))
        rows = rows.withColumns({f"{c}_words": F.when(F.size(w) > 0, w), f"{c}_exact": exact_name(F.col(f"_{c}"))})
        rows = rows.withColumns({f"{c}_phrase": F.array_join(f"{c}_words", " "), f"{c}_common": _all_common(F.col(f"{c}_words"), common)})
    order = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    return rows.drop("_title", "_creator", "_album").withColumn("rank", F.struct(F.when(order > 0, order).otherwise(99).alias("category"), F.col("id").alias("id")))


def _runs(queries: DataFrame, longest: int) -> DataFrame:
    """qid, phrase, at: the runs of up to `longest` content words of each query, at their first place."""
    size = F.size("words")
    spans = F.explode(F.expr(f"flatten(transform(sequence(0, size(words) - 1), i -> transform(sequence(1, least({longest}, size(words) - i)), n -> named_struct('at', i, 'phrase', array_join(slice(words, i + 1, n), ' ')))))"))
    return queries.where(size > 0).select("qid", spans.alias("r")).groupBy("qid", "r.phrase").agg(F.min("r.at").alias("at"))


def _covered(total: str, *spans: tuple[Column, Column]) -> Column:
    """Whether the spans (first place, size) hold all of the query's words that count."""
    inside = lambda i: F.array_contains(F.array(*[(i >= at) & (i < at + n) for at, n in spans]), True)
    return F.size(F.filter("counted", inside)) == F.col(total)


def name_matches(queries: DataFrame, items: DataFrame, common: list[str]) -> DataFrame:
    """qid, kind (0 title, 1 album, 2 creator), id of the best item that each query (qid, text)
    names; queries that name none have no row.

    A phrase of common words only needs more than one word and, without the creator, to be the
    whole query as typed (fillers and a leading "the" aside). The best is by kind, then category
    order, then id.
    """
    names = staged(prepared(items, common), "names")
    asked = queries.select("qid", plain_words(F.coalesce("text", F.lit(""))).alias("all"))
    counted = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: ~F.get(F.col("words"), i).isin(FILLER_WORDS))
    asked = asked.select("qid", content_words(F.col("all")).alias("words"), exact_name(F.col("all")).alias("exact")).withColumn("counted", F.when(F.size("words") > 0, counted).otherwise(F.array().cast("array<int>")))
    asked = staged(asked.withColumn("total", F.size("counted")).where("total > 0"), "asked")
    longest = names.agg(F.max(F.greatest(*[F.coalesce(F.size(f"{c}_words"), F.lit(1)) for c in ("title", "creator", "album")]))).first()[0] or 1
    runs = staged(_runs(asked, longest), "runs")
    # one row a distinct name: an album or a creator stands for its best item
    per = [F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank")]
    phrase = lambda c: [F.col(f"{c}_{x}") for x in ("phrase", "words", "exact", "common")]
    creators = [F.col("creator_phrase"), F.col("creator_words"), F.col("creator_common")]
    found = None
    for kind, c in enumerate(("title", "album")):
        kinds = names.where(f"{c}_words IS NOT NULL").groupBy(*phrase(c), *creators).agg(*per)
        hit = runs.withColumnRenamed("phrase", f"{c}_phrase").join(kinds, f"{c}_phrase").join(asked, "qid")
        also = runs.select("qid", F.col("phrase").alias("creator_phrase"), F.col("at").alias("cat"))
        hit = hit.join(also, ["qid", "creator_phrase"], "left")
        n, cn = F.size(f"{c}_words"), F.size("creator_words")
        alone = _covered("total", (F.col("at"), n)) & ~(F.col(f"{c}_common") & ((n == 1) | (F.col("exact") != F.col(f"{c}_exact"))))
        # with the creator, common words need not be the whole query, and there are at least two
        both = F.col("cat").isNotNull() & _covered("total", (F.col("at"), n), (F.coalesce("cat", F.lit(-1)), F.coalesce(cn, F.lit(0))))
        rows = hit.where(alone | both).select("qid", F.lit(kind).alias("kind"), "rank", "id")
        found = rows if found is None else found.union(rows)
    makers = names.where("creator_words IS NOT NULL").groupBy(*creators).agg(*per)
    hit = runs.withColumnRenamed("phrase", "creator_phrase").join(makers, "creator_phrase").join(asked, "qid")
    cn = F.size("creator_words")
    found = found.union(hit.where(_covered("total", (F.col("at"), cn)) & ~(F.col("creator_common") & (cn == 1))).select("qid", F.lit(2).alias("kind"), "rank", "id"))
    return found.groupBy("qid").agg(F.min(F.struct("kind", "rank", "id")).alias("m")).select("qid", "m.kind", "m.id")


def representatives(items: DataFrame) -> DataFrame:
    """creator, album (null for all of a creator's items), id: the item nearest to the sum of each
    group of two or more; items have id, creator, album and vector. A null album is a group too."""
    rows = items.select("id", "creator", F.coalesce("album", F.lit("")).alias("album"), "vector")
    by_creator = representative(rows, "creator").select("creator", F.lit(None).cast("string").alias("album"), "id")
    by_album = representative(rows, "creator", "album").select("creator", "album", "id")
    many = lambda *k: rows.groupBy(*k).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return by_creator.join(many("creator"), "creator", "left_semi").unionByName(by_album.join(many("creator", "album"), ["creator", "album"], "left_semi"))


def anchors(queries: DataFrame, items: DataFrame, common: list[str]) -> DataFrame:
    """qid, id: the item that each query names; a creator or an album is represented by the item
    nearest to the sum of its vectors."""
    hits = name_matches(queries, items, common)
    own = items.select("id", "creator", F.coalesce("album", F.lit("")).alias("own_album"))
    chosen = representatives(items).withColumnsRenamed({"id": "chosen", "album": "group_album"})
    rows = hits.join(own, "id")
    group = (rows.creator == chosen.creator) & F.when(rows.kind == 1, rows.own_album).eqNullSafe(chosen.group_album) & (rows.kind > 0)
    return rows.join(chosen, group, "left").select("qid", F.coalesce("chosen", "id").alias("id"))


def used_words(texts: DataFrame, text: str, *others: str) -> DataFrame:
    """word and the other columns: the distinct words of each text. A worker holds the words of
    one bounded batch of texts at a time."""
    bounded_batches(texts.sparkSession)
    return texts.select(*others, F.explode(F.array_distinct(plain_words(F.col(text)))).alias("word"))


def common_words(texts: DataFrame, text: str, share: float) -> DataFrame:
    """word: those in at least `share` of the texts, where there is no vocabulary to ask."""
    n = used_words(texts, text).groupBy("word").agg(F.count("*").alias("n"))
    return n.crossJoin(texts.agg(F.count("*").alias("t"))).where(F.col("n") >= F.col("t") * share).select("word")


def one_piece_words(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """word: those of small letters and digits that the tokenizer of this file takes as one piece. A
    word that is one piece stands in the vocabulary, alone or with a mark of its start or end, so
    only its entries are asked: as many words as it has, whatever the texts."""
    from tokenizers import Tokenizer

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    asked = Tokenizer.from_file(vocabulary)
    entries = sorted({m[1] for entry in asked.get_vocab() if (m := _ENTRY.fullmatch(entry))})
    pieces = asked.encode_batch(entries, add_special_tokens=False)
    return spark.createDataFrame([(w,) for w, p in zip(entries, pieces, strict=True) if len(p.ids) == 1], "word string")


def name_words(items: DataFrame, words: DataFrame) -> DataFrame:
    """The words (word) that some name of the items has."""
    every = items.select(F.explode(plain_words(F.concat_ws(" ", "title", "creator", "album"))).alias("word")).distinct()
    return words.join(every, "word", "left_semi")
