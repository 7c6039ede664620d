"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has a probability for each
piece. A word's probability is the sum over all its segmentations into pieces, found by
the forward algorithm; a text's is the product over its words, as no piece crosses a
word's start. Pieces of every length count. Training is expectation-maximisation over
the same sum (forward-backward) on the word counts of all labelled documents, with all
their words of up to LONG letters (longer runs are no words of a language). Prediction
reads every whole text. A longer run is scored exactly too: it is cut into
parts that are worked off side by side, for each of the states that a part can begin in,
and the parts are then joined like matrices, so a run of a million letters takes seconds.

Scale. Training counts words in one pass; each round works on the distinct words of a
language in many tasks, and only the sums by piece come to the driver (languages x pieces).
One more pass for prediction, no shuffle of texts; the model has fixed size. keep_known()
needs one pass before it, over the labelled documents, for its thresholds.

Defined results. Null text or no letter: `und`, score 0. No labelled row at all: every
text is `und`. Ties go to the language that sorts first. Repeated rows are returned each.
Letters that no piece covers count as one unknown piece each. Extra columns are not read.
The score compares the learned languages with each other, so a text in none of them can
have a high one; keep_known() therefore also asks for a fit: letter by letter, the text
may be at most FAR times as surprising as its language's labelled documents are in the
median (of all of them, to three decimals).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import byte_texts, keyed, lean, materialize, tokenizer_path, wide

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 3
FAR = 3.0  # times as surprising, letter by letter, as the language's own texts
CACHED = 250_000
LONG = 256  # letters of a word that a sample may teach; longer ones are scored in parts
PART = 512  # letters of a part
SIDE = 64  # parts that are worked off at a time
_START = "▁"
MILLION = 1_000_000  # parts of a count
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = 18
_POWERS = np.array([pow(int(_BASE), k, 1 << 64) for k in range(256)], np.uint64)


def vocabulary_pieces(path: str) -> list[str]:
    """The lower-case pieces of letters in the vocabulary, with or without a word start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    fit = lambda p: (q := p.removeprefix(_START)) and _LETTERS.fullmatch(q) and q == q.lower()
    return sorted({p for p in found if fit(p)})


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _TABLE)).astype(np.int64)


@dataclass
class Pieces:
    """Piece numbers by the polynomial hash of their letters (open addressing)."""

    keys: np.ndarray
    numbers: np.ndarray
    size: int
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Pieces:
        keys, numbers = np.zeros(1 << _TABLE, np.uint64), np.full(1 << _TABLE, -1, np.int32)
        for k, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = h * _BASE + np.uint64(ord(c) + 1)
            s = int(_slot(np.array([h]))[0])
            while numbers[s] >= 0:
                s = (s + 1) & ((1 << _TABLE) - 1)
            keys[s], numbers[s] = h, k
        return cls(keys, numbers, len(pieces), max(map(len, pieces), default=1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 if none; the unknown piece is number `size`."""
        s = _slot(h)
        out = self.numbers[s]
        wrong = np.flatnonzero((out >= 0) & (self.keys[s] != h))
        out[wrong] = -1
        while len(wrong):
            s[wrong] = (s[wrong] + 1) & ((1 << _TABLE) - 1)
            n = self.numbers[s[wrong]]
            hit = self.keys[s[wrong]] == h[wrong]
            out[wrong[hit]] = n[hit]
            wrong = wrong[(n >= 0) & ~hit]
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices, and hashes of the first 0, 1, ... letters (after the word start) of the
    words of each length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = "".join(words[i] for i in at).encode("utf-32-le")
        codes = np.frombuffer(flat, "<u4").reshape(len(at), n).astype(np.uint64) + np.uint64(1)
        first = np.zeros((n + 2, len(at)), np.uint64)
        first[1] = ord(_START) + 1
        for j in range(n):
            first[j + 2] = first[j + 1] * _BASE + codes[:, j]
        yield at, first


def _piece_ids(first: np.ndarray, table: Pieces, j: int, span: int) -> np.ndarray:
    """Pieces that end before position j and are `span` long; single letters always are one."""
    ids = table.find(first[j] - first[j - span] * _POWERS[span])
    return np.where(ids < 0, table.size, ids) if span == 1 else ids


def word_scores(words: list[str], table: Pieces, probs: np.ndarray) -> np.ndarray:
    """log P(word | language), words x languages: all segmentations summed.

    probs: (pieces + 2) x languages; the row before the last is the unknown piece, the
    last one is zero. Forward values are scaled as they go, so long words don't vanish.
    """
    out = np.zeros((len(words), probs.shape[1]))
    for k, word in enumerate(words):
        if len(word) > LONG:
            out[k] = _long_score(word, table, probs)
    short = [k for k, word in enumerate(words) if len(word) <= LONG]
    for at, first in _by_length([words[k] for k in short]):
        t = len(first) - 1
        ring, log = [np.ones((len(at), probs.shape[1]))], np.zeros((len(at), probs.shape[1]))
        for j in range(1, t + 1):
            now = np.zeros_like(log)
            for span in range(1, min(j, table.longest) + 1):
                ids = _piece_ids(first, table, j, span)
                hit = np.flatnonzero(ids >= 0)
                if 2 * len(hit) > len(ids):
                    now += ring[-span] * probs[ids]
                elif len(hit):
                    now[hit] += ring[-span][hit] * probs[ids[hit]]
            scale = np.maximum(now, 1e-280)
            ring = [np.minimum(r / scale, 1e280) for r in ring[1 - table.longest :]] + [np.ones_like(now)] if j % 8 == 0 else [*ring[-table.longest :], now]
            if j % 8 == 0:
                log += np.log(scale)
        out[[short[k] for k in at]] = log + np.log(np.maximum(ring[-1], 1e-300))
    return out


def _long_score(word: str, table: Pieces, probs: np.ndarray) -> np.ndarray:
    """word_scores() of one long word. The forward values at a part's end are linear in the
    `longest` values before its start; the parts' matrices come from running each part on
    the unit vectors, SIDE parts at a time, and the values go through them in order."""
    deep, langs = table.longest, probs.shape[1]
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    codes = np.concatenate([np.array([ord(_START) + 1], np.uint64), codes])
    state, log = np.zeros((deep, langs)), np.zeros(langs)  # values at the last positions, the newest last
    state[-1] = 1
    done = 0  # positions whose values are known
    while done < len(codes):
        whole = min(SIDE, (len(codes) - done) // PART)
        parts, size = (whole, PART) if whole else (1, len(codes) - done)
        before = min(done, deep)
        text = np.concatenate([np.zeros(deep - before, np.uint64), codes[done - before : done + parts * size]])
        rows = np.stack([text[k * size : k * size + size + deep] for k in range(parts)])
        hashes = np.zeros((size + deep + 1, parts), np.uint64)
        for j in range(size + deep):
            hashes[j + 1] = hashes[j] * _BASE + rows[:, j]
        ring = [np.zeros((parts, deep, langs)) for _ in range(deep)]
        for b in range(deep):
            ring[b][:, b] = 1
        part_log = np.zeros((parts, langs))
        for j in range(1, size + 1):
            now = np.zeros((parts, deep, langs))
            for span in range(1, deep + 1):
                ids = _piece_ids(hashes, table, deep + j, span)
                if (ids >= 0).any():
                    now += ring[-span] * probs[ids][:, None, :]
            ring = [*ring[1:], now]
            if j % 8 == 0:
                scale = np.maximum(np.max([r.max(axis=1) for r in ring], axis=0), 1e-280)
                ring = [r / scale[:, None] for r in ring]
                part_log += np.log(scale)
        matrices = np.stack(ring, axis=1)  # part, place at the end, place before the start, language
        for k in range(parts):
            state = np.einsum("obl,bl->ol", matrices[k], state)
            scale = np.maximum(state.max(axis=0), 1e-280)
            state, log = state / scale, log + np.log(scale) + part_log[k]
        done += parts * size
    return log + np.log(np.maximum(state[-1], 1e-300))


def _expected(words: list[str], weights: np.ndarray, table: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language's words under its probabilities, each word's in whole
    millionths: sums don't depend on the order of the words."""
    counts = np.zeros(table.size + 2)
    for at, first in _by_length(words):
        t, n = len(first) - 1, len(at)
        # of each place and length: the words that have a piece there, and the piece
        found = {}
        for j in range(1, t + 1):
            for s in range(1, min(j, table.longest) + 1):
                ids = _piece_ids(first, table, j, s)
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    found[j, s] = hit, ids[hit]
        fore, back = np.zeros((t + 1, n)), np.zeros((t + 1, n))
        fore[0], back[t] = 1, 1
        # a factor for each letter keeps long words from vanishing; it cancels out
        scale = np.exp(-word_scores([words[i] for i in at], table, probs[:, None])[:, 0] / t) if t > 30 else np.ones(n)
        for (j, s), (hit, ids) in found.items():  # in order of j
            fore[j, hit] += fore[j - s, hit] * probs[ids] * scale[hit] ** s
        for j in range(t, 0, -1):
            for s in range(1, min(j, table.longest) + 1):
                if (j, s) in found:
                    hit, ids = found[j, s]
                    back[j - s, hit] += back[j, hit] * probs[ids] * scale[hit] ** s
        share = weights[at] / np.maximum(fore[t], 1e-300)
        each = [np.rint(MILLION * np.nan_to_num(share[hit] * fore[j - s, hit] * back[j, hit] * probs[ids] * scale[hit] ** s)) for (j, s), (hit, ids) in found.items()]
        counts += np.bincount(np.concatenate([ids for _, ids in found.values()]), np.concatenate(each), table.size + 2)
    counts[-1] = 0
    return counts / MILLION


@dataclass
class Model:
    langs: list[str]
    table: Pieces
    probs: np.ndarray
    docs: DataFrame | None = None  # the labelled documents that it was learned from

    def __getstate__(self) -> dict:
        return {**self.__dict__, "docs": None}  # tasks get the numbers only

    @cached_property
    def floors(self) -> np.ndarray:
        """By language: the least log-likelihood a letter of a text that fits."""
        return _floors(self.docs, self) if self.langs else np.zeros(0)


def train(docs: DataFrame, vocabulary: str | None = None) -> Model:
    """Learn from the rows of docs with a lang: text and lang only."""
    labelled = keyed(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    table = Pieces.of(vocabulary_pieces(vocabulary or tokenizer_path(VOCABULARY)))
    if not langs:
        return Model([], table, np.zeros((table.size + 2, 0)))
    words = wide(labelled).select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")).where(F.length("word") <= LONG)
    words = materialize(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    probs = np.full((table.size + 2, len(langs)), 1 / (table.size + 1))
    for _ in range(ROUNDS):
        probs[-1] = 0
        counts = _counted(words, langs, table, probs) + 0.02
        probs = counts / counts[:-1].sum(axis=0)
    probs[-1] = 0
    return Model(langs, table, probs, labelled)


def _counted(words: DataFrame, langs: list[str], table: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected counts, pieces x languages, of all words (lang, word, n), added up by tasks in millionths."""
    shared = words.sparkSession.sparkContext.broadcast((table, probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, probs = shared.value
        total = np.zeros(probs.shape, np.int64)
        for part in _gathered(batches, 100_000):
            own = np.array([langs.index(x) for x in part.column(0).to_pylist()])
            for k in np.unique(own):
                mine = part.filter(pa.array(own == k))
                found = _expected(mine.column(1).to_pylist(), mine.column(2).to_numpy().astype(float), table, probs[:, k])
                total[:, k] += np.rint(MILLION * found).astype(np.int64)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    out = np.zeros(probs.shape)
    rows = wide(words).mapInArrow(lean(run), "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    out[rows.piece, rows.lang] = rows.n / MILLION
    return out


def _floors(docs: DataFrame, model: Model) -> np.ndarray:
    """By language, FAR times the median log-likelihood a letter of its labelled documents, rounded
    to thousandths: of each there is a count."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, parts = shared.value, []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                for part in _parts(batch):
                    parts.append(part)
                    yield part.column(0)

        for n, log, letters in totals(texts(), model):
            lang = parts.pop().column(1)
            own = np.array([model.langs.index(x) for x in lang.to_pylist()], int)
            fit = np.round(1000 * log[np.arange(n), own] / np.maximum(letters, 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([lang, pa.array(fit)], ["lang", "fit"]).filter(pa.array(letters > 0))

    rows = wide(docs.select("text", "lang")).mapInArrow(lean(run), "lang string, fit long").groupBy("lang", "fit").agg(F.count("*").alias("n")).toPandas()
    out = np.full(len(model.langs), -np.inf)
    for k, lang in enumerate(model.langs):
        own = rows[rows.lang == lang].sort_values("fit")
        if len(own):
            below, n = own.n.cumsum().to_numpy(), own.n.sum()
            middle = [own.fit.iloc[int(np.searchsorted(below, m))] for m in ((n - 1) // 2 + 1, n // 2 + 1)]
            out[k] = FAR * sum(middle) / 2000
    return out


class _Scores(dict):
    """White-space separated chunk to its row of scores; rows of new chunks come later. A chunk of
    one word has the word's row, so a word is scored once, whatever signs stand around it."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, np.zeros((1, len(model.langs) + 1))  # row 0: no word
        self.words: dict[str, int] = {}
        self.used, self.new, self.joint = 1, [], []  # rows; words, and (row, rows of its words) of chunks, to fill

    def _row(self) -> int:
        self.used += 1
        return self.used - 1

    def _word(self, word: str) -> int:
        k = self.words.get(word)
        if k is None:
            k = self.words[word] = self._row()
            self.new.append(word)
        return k

    def __missing__(self, chunk: bytes) -> int:
        text = chunk.decode().lower()
        of = [self._word(text)] if text.isalpha() else [self._word(w) for w in _LETTERS.findall(text) if any(map(str.isalpha, w))]
        if len(of) > 1:
            self.joint.append((self._row(), of))
            of = [self.joint[-1][0]]
        k = self[chunk] = of[0] if of else 0
        return k

    def fill(self) -> np.ndarray:
        """Row of each chunk: log probabilities by language, and its letters and words."""
        if self.used > len(self.rows):
            grown = np.zeros((max(self.used, 2 * len(self.rows)), self.rows.shape[1]))
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        if self.new:
            at = [self.words[w] for w in self.new]
            self.rows[at, :-1] = word_scores(self.new, self.model.table, self.model.probs)
            self.rows[at, -1] = [len(w) + 1.0 for w in self.new]
            self.new = []
        if self.joint:
            n = [len(of) for _, of in self.joint]
            np.add.at(self.rows, np.repeat([k for k, _ in self.joint], n), self.rows[[w for _, of in self.joint for w in of]])
            self.joint = []
        return self.rows


def totals(texts: Iterator[pa.Array], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each array: its length, the texts' log-likelihoods by language, and their letters and words."""
    cache = _Scores(model)
    for column in texts:
        if max(len(cache), len(cache.words)) > CACHED:
            cache = _Scores(model)
        at = [np.fromiter(map(cache.__getitem__, p), np.int64, len(p)) if (p := t.split() if t else []) else np.zeros(0, np.int64) for t in byte_texts(column)]
        rows = cache.fill()
        total = np.array([rows[a].sum(axis=0) if len(a) else np.zeros(rows.shape[1]) for a in at]).reshape(len(at), len(model.langs) + 1)
        yield len(at), total[:, :-1], total[:, -1]


def predictions(texts: Iterator[pa.Array], model: Model, floors: np.ndarray | None = None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """lang_pred and score of each text, and whether it fits its language (its floor, if given); array by array."""
    floors = np.full(len(model.langs), -np.inf) if floors is None else floors
    names = np.array([*model.langs, "und"], object)
    for n, log, letters in totals(texts, model):
        if not model.langs:
            yield ["und"] * n, np.zeros(n), np.zeros(n, bool)
            continue
        best = log.argmax(axis=1)
        score = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
        fits = (letters > 0) & (log.max(axis=1) >= floors[best] * letters)
        yield names[np.where(letters > 0, best, len(model.langs))].tolist(), np.where(letters > 0, score, 0.0), fits


def _parts(batch: pa.RecordBatch, size: int = 1000) -> list[pa.RecordBatch]:
    return [batch.slice(at, size) for at in range(0, batch.num_rows, size)]


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of `size` rows or somewhat more, from batches that may be much smaller."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                for part in _parts(batch):
                    parts.append(part)
                    yield part.column(1)

        for lang, score, _ in predictions(texts(), shared.value):
            yield pa.RecordBatch.from_arrays([parts.pop().column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return wide(keyed(docs, "doc_id", "text")).mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language is identified with min_score or more and that fit
    it; all columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                for part in _parts(batch):
                    parts.append(part)
                    yield part.column("text")

        for _, score, fits in predictions(texts(), *shared.value):
            yield parts.pop().filter(pa.array(fits & (score >= min_score)))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows not held out."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
