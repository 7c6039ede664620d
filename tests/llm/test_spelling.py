"""Spelling variants against every pair of words, and against SQL."""

import collections
import random
import re
import zlib

import duckdb
import pytest

from quillspan.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, key long, root string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(docs):
    n = collections.Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = [None, "", " 12 - ", "À la Maison maison MAISON", "äöüßÿ ÄÖÜSSŸ ×÷ a×b×cde÷fghij"]
    texts += [" ".join(rng.choice(stems) for _ in range(rng.choice([5, 300]))) for _ in range(40)]
    texts += ["chain chaine chaines " + "chain " * 40 + "chaine " * 12 + "chaines " * 3 + "chainess " * 3] * 3
    run = "x" * 40 + "".join(rng.choice("pq") for _ in range(3000))
    texts += [f"{run} {run[:7]}{run[8:]}"] * 3  # long runs, one letter apart
    docs = [(i, t, "w", 1, 2, "r") for i, t in enumerate(texts)]
    return [*docs, docs[8], (None, "nobody knows nobody knows nobody knows " * 40, None, None, None, None)]


@pytest.mark.parametrize("limit", [spelling.LIMIT, 20])
def test_variants_equal_every_pair(spark, edges, limit):
    assert rows(spelling.variants(spark.createDataFrame(edges, SCHEMA), limit=limit)) == sorted(brute(edges), key=repr)


def test_variants_equal_sql(spark, edges):
    c = duckdb.connect()
    documents = spark.createDataFrame([e for e in edges if len(e[1] or "") < 5000], SCHEMA).toArrow()  # noqa: F841
    want = c.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.SQL})").fetchall()
    assert rows(spelling.variants(spark.createDataFrame([e for e in edges if len(e[1] or "") < 5000], SCHEMA))) == sorted(want, key=repr)


def test_no_documents(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_prefix_for_a_third_of_the_words(spark):
    """Most words share their first half, so its trie is cut; every near pair is still met once."""
    rng = random.Random(6)
    words = {"abcdefgh" + "".join(rng.choice("xyz") for _ in range(rng.randint(5, 8))) for _ in range(500)}
    words |= {"".join(rng.choice("uvw") for _ in range(rng.randint(3, 6))) + "abcdefgh" for _ in range(400)}
    words |= {"abc" + "".join(rng.choice("rst") for _ in range(rng.randint(2, 5))) + "efgh" for _ in range(300)}
    docs = [(i, " ".join(sorted(words))) for i in range(4)]
    got = rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), limit=100))
    assert got == sorted(brute(docs), key=repr)
    groups = spelling.cut(spelling.filed(spark.createDataFrame([(w, 3) for w in words], "word string, n long")), 100)
    biggest = groups.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert biggest <= 100


def test_trie_finds_every_edit():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(200)})
    got = dict(spelling.near_in_trie(words))
    for k, w in enumerate(words):
        assert got.get(k, set()) == {i for i, x in enumerate(words) if near(w, x)}
