"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives each document a posterior over domains.
Document rates r >= 0 are then fitted so that the expected domain token totals,
sum_i r_i * tokens_i * p_i, meet the targets, by projected gradient steps on the least
squares of the misfit. Its gradient for document i is p_i . (total - target), so the
gradients of all steps add up to one number a domain, y, and the steps are projected in
their lazy form: r_i = max(0, 1 - p_i . y), the starting rate moved by all steps so far
and cut at the bound. Among the rates that meet the targets this leads to those with the
least change (squares of r - 1, weighted by tokens). Plain steps need hundreds of passes
where domains overlap, so a step is preconditioned: (total - target) times the inverse of
G = sum_i tokens_i p_i p_i' over the documents that are not at their bound; it is halved,
in the same pass, where that comes closer. Steps end when each total is within 1e-4 of its
own target. Targets that no rates meet are logged as missed, and mix_rates() returns the
relative miss of each row's domain.

Scale. A pass reads one narrow table (tokens and posteriors) and needs only domains-many
sums for each tried step, so no state per document is kept, nothing is shuffled and a
lost executor costs its own partitions. Only y (one number a domain) is held.

Defined results. Rows whose label columns are null teach nothing. A document with null,
empty or wordless text has zero tokens and the rate 1: it changes no total. A domain
without documents has no effect. Repeated rows count each. No labelled row at all gives
one domain and rates that scale to its target. Extra columns pass through mix() as is.
"""

from __future__ import annotations

import logging
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quillspan.llm.common import byte_texts, free_names, keyed, lean, materialize, read_table, wide

MAX_LABELLED = 2000  # documents that the classifier is fitted on, about
LEAST_DOCS = 3  # that have a feature, in the sample
PENALTIES = (1e-4, 3e-4, 1e-3, 3e-3)
PASSES = 40  # at most; 2 to 7 are usual
LARGEST = 100.0  # a step beyond it means that the targets can't be met
GIVE = 0.01
#: Targets as multiples of the expected domain totals before mixing.
TARGETS = {"good": 1.25, "plain": 1.05, "toxic": 0.15}
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = string.punctuation.encode()


def features(word: bytes) -> tuple[int, ...]:
    """Hashes of the word without the signs at its ends, and of those signs if they are two or more."""
    if word.isascii():
        core = word.lower().strip(_SIGNS)
        rest = word.lower().replace(core, b"", 1) if core else word
    else:
        whole = word.decode().lower()
        text = _ENDS.sub("", whole)
        core, rest = text.encode(), (whole.replace(text, "", 1) if text else whole).encode()
    found = ([core] if core else []) + ([b"\0" + rest] if len(rest) > 1 or not core else [])
    return tuple(xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in found)


class _Features(dict):
    """Word to its features: hashes, or the rows of a classifier's features."""

    def __init__(self, rows: dict[int, int] | None = None) -> None:
        self.rows = rows

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        found = features(word)
        k = self[word] = found if self.rows is None else tuple(self.rows[h] for h in found if h in self.rows)
        return k


def _bag(text: bytes | None, known: _Features) -> tuple[int, np.ndarray]:
    """Number of words, and the text's distinct features."""
    words = text.split() if text else []
    return len(words), np.array(sorted({k for w in set(words) for k in known[w]}), np.int64)


@dataclass
class Classifier:
    domains: list[str]
    rows: dict[int, int]  # hash of a feature to its row of weights
    weights: np.ndarray  # (features + 1) x domains; the last row is the bias

    def posterior(self, bag: np.ndarray) -> np.ndarray:
        z = self.weights[-1] + self.weights[bag].sum(axis=0)
        e = np.exp(z - z.max())
        return e / e.sum()


def domain_of(quality: str = "quality", toxic: str = "toxic"):
    """toxic, good or plain; null if neither column says."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.coalesce(quality, toxic).isNotNull(), "plain")


def _telling(bags: list[np.ndarray], y: np.ndarray) -> dict[int, int]:
    """The features whose document counts tell domains apart: by the G statistic, against
    what as many more parameters cost (Bayesian information criterion)."""
    hashes, at = np.unique(np.concatenate(bags), return_inverse=True)
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    have = np.stack([np.bincount(at, y[row, k], len(hashes)) for k in range(y.shape[1])], axis=1)
    gain, prior = 0.0, y.sum(axis=0)
    for x in (have, prior - have):
        gain = gain + 2 * (x * np.log(np.maximum(x, 1e-9) / np.maximum(x.sum(axis=1, keepdims=True) * prior / len(y), 1e-9))).sum(axis=1)
    return {int(h): k for k, h in enumerate(hashes[(have.sum(axis=1) >= LEAST_DOCS) & (gain >= (y.shape[1] - 1) * np.log(len(y)))])}


def _softmax(bags: list[np.ndarray], y: np.ndarray, rows: dict[int, int], penalty: float, passes: int) -> Classifier:
    """Weights of the features in rows, by full-batch Adam."""
    own = [[rows[h] for h in b.tolist() if h in rows] for b in bags]
    row, col = np.repeat(np.arange(len(own)), [len(b) for b in own]), np.array([k for b in own for k in b], np.int64)
    w = np.zeros((len(rows) + 1, y.shape[1]))
    w[-1] = np.log(np.maximum(y.mean(axis=0), 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, passes + 1):
        z = np.stack([np.bincount(row, x[col], len(own)) for x in w.T], axis=1) + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        err = (p / p.sum(axis=1, keepdims=True) - y) / len(own)
        g = np.stack([np.bincount(col, x[row], len(w)) for x in err.T], axis=1) + penalty * w
        g[-1] = err.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier([], rows, w)


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, passes: int = 300) -> Classifier:
    """Softmax regression on distinct words without the signs at their ends, on the driver.
    Only words that tell domains apart are used; the penalty of their weights is the one
    with the least loss on a fifth of the sample that the fit has not seen.

    labels: doc_id, quality, toxic. About max_labelled rows are used, by a hash of doc_id.
    """
    rows = keyed(labels, "doc_id", "quality", "toxic").select("doc_id", domain_of().alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = fitted_sample(rows, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for b in batches:
            bags = [_bag(t, known)[1] for t in byte_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.list_(pa.int64()))], ["domain", "bag"])

    # the sample's size is bounded by max_labelled, so it may be broadcast
    texts = keyed(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", "text")
    got = texts.mapInArrow(lean(run), "domain string, bag array<long>").collect()
    domains = sorted({r.domain for r in got}) or ["all"]
    got = sorted((r for r in got if r.bag), key=lambda r: (r.domain, r.bag))
    if len(domains) == 1 or not got:
        return Classifier(domains, {}, np.zeros((1, len(domains))))
    bags, y = [np.array(r.bag, np.int64) for r in got], np.eye(len(domains))[[domains.index(r.domain) for r in got]]
    # copies of a text go to the same side
    unseen = np.array([xxhash.xxh3_64_intdigest(b.tobytes()) % 5 == 0 for b in bags])
    penalty = PENALTIES[-1]
    if unseen.any() and not unseen.all():
        part = lambda side: ([b for b, x in zip(bags, side, strict=True) if x], y[side])
        (b0, y0), (b1, y1) = part(~unseen), part(unseen)
        telling, losses = _telling(b0, y0), []
        for x in PENALTIES:
            own = _softmax(b0, y0, telling, x, passes)
            p = np.array([own.posterior([telling[h] for h in b.tolist() if h in telling]) for b in b1])
            losses.append((-np.log(np.maximum((p * y1).sum(axis=1), 1e-12)).mean(), x))
        penalty = min(losses)[1]
    model = _softmax(bags, y, _telling(bags, y), penalty, passes)
    return Classifier(domains, model.rows, model.weights)


def fitted_sample(rows: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """About max_labelled of rows, by a hash of doc_id."""
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1e6 * min(1.0, max_labelled / max(rows.count(), 1)))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words), p (posterior by domain) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = _Features(own.rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bags = [_bag(t, known) for t in byte_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in bags], pa.int64()), pa.array([own.posterior(b).tolist() for _, b in bags], pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return wide(keyed(docs, "doc_id", "text")).mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, p array<double>")


def _classified(docs: DataFrame, model: Classifier) -> tuple[DataFrame, list[str]]:
    """docs with n_tokens and the posterior, and the names of these two, which docs doesn't have."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    added = free_names(names, "_n", "_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = _Features(own.rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bags = [_bag(t, known) for t in byte_texts(part.column("text"))]
                new = [pa.array([n for n, _ in bags], pa.int64()), pa.array([own.posterior(b).tolist() for _, b in bags], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *new], [*names, *added])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(added[0], LongType()), StructField(added[1], ArrayType(DoubleType()))])), added


def rates(n: np.ndarray, p: np.ndarray, steps: list[np.ndarray], least: np.ndarray | None = None) -> np.ndarray:
    """The rates of documents after the steps so far; least: by likeliest domain, 0 if None."""
    low = 0.0 if least is None else least[p.argmax(axis=1)]
    r = np.ones(len(n))
    for y in steps:
        r = np.where(n > 0, np.maximum(low, r - p @ y), 1.0)
    return r


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


def _sums(table: DataFrame, k: int, tried: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a table of (tokens, posterior): domain totals at rate 1, and for each tried y: the dual function without its linear
    part, the domain totals, and G over the documents that are not at their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + len(tried) * (1 + k + k * k))
        for b in batches:
            n, p = b.column(0).to_numpy().astype(float), _matrix(b.column(1), k)
            low, own = least[p.argmax(axis=1)], [n @ p]
            for y in tried:
                z = 1 - p @ y
                mass = (n * (z > low))[:, None] * p
                own += [[n @ np.where(z > low, z * z / 2, low * z - low * low / 2)], (n * np.maximum(low, z)) @ p, (mass.T @ p).ravel()]
            total += np.concatenate(own)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    out = np.zeros(k + len(tried) * (1 + k + k * k))
    for r in table.mapInArrow(lean(run), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    each = out[k:].reshape(len(tried), -1)
    return out[:k], each[:, 0], each[:, 1 : k + 1], each[:, k + 1 :].reshape(-1, k, k)


def _solve(table: DataFrame, goals: np.ndarray, least: np.ndarray, passes: int, tolerance: float, give: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, and the totals reached and sought. Misfits cost their square over give."""
    k = len(goals)
    tried, step = np.zeros((1, k)), np.zeros(k)
    for n in range(passes + 1):
        plain, value, totals, g = _sums(table, k, tried, least)
        goal, soft = plain * goals, give * np.maximum(plain, 1)
        best = int((value + tried @ goal + (soft * tried * tried).sum(axis=1) / 2).argmin())
        y, now = tried[best], totals[best]
        slope = goal - now + soft * y
        if (np.abs(slope) <= tolerance * np.maximum(goal, 1)).all() or np.abs(y).max() > LARGEST or n == passes:
            return y, now, goal
        step = -np.linalg.solve(g[best] + np.diag(soft), slope)
        tried = y + 2.0 ** -np.arange(0, 16, 2)[:, None] * step


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float], passes: int = PASSES, tolerance: float = 1e-4, least: np.ndarray | None = None, columns: tuple[str, str] = ("n_tokens", "p")) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sum of the steps, y, the domain totals that it reaches, and the target totals; columns name
    the table's tokens and posterior.

    Each total is within tolerance of its own target. If no rates do that, a warning names
    the domains that miss and by how much, and rates stay moderate (GIVE).
    """
    table = table.select(*[F.col(f"`{c}`") for c in columns])
    goals = np.array([targets.get(d, 1.0) for d in domains])
    least = np.zeros(len(domains)) if least is None else least
    met = lambda now, goal: np.abs(now - goal) <= tolerance * np.maximum(goal, 1)
    y, now, goal = _solve(table, goals, least, passes, tolerance / 10, 1e-9)
    if not met(now, goal).all():
        y, now, goal = _solve(table, goals, least, passes, tolerance / 10, GIVE)
        missed = [f"{d} {x / max(g, 1):.4f}" for d, x, g, ok in zip(domains, now, goal, met(now, goal), strict=True) if not ok]
        if missed:
            logging.getLogger(__name__).warning("no rates meet the targets; reached, as a share of the target: %s", ", ".join(missed))
    return [y], now, goal


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate, domain_miss for each row of docs.

    domain_miss: by how much of its target the domain's expected total differs from it after
    mixing, at most 1e-4 where the targets can be met."""
    model = fit_classifier(docs, labels, max_labelled)
    table = materialize(memberships(docs, model), "memberships")
    steps, reached, goal = fit_rates(table, model.domains, targets or TARGETS)
    miss = np.abs(reached - goal) / np.maximum(goal, 1)
    names, k = np.array(model.domains, object), len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b.column(2), k)
            r = rates(b.column(1).to_numpy(), p, steps)
            own = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[own], pa.string()), pa.array(r), pa.array(miss[own])], ["doc_id", "n_tokens", "domain", "rate", "domain_miss"])

    return table.mapInArrow(lean(run), f"doc_id {table.schema['doc_id'].dataType.simpleString()}, n_tokens long, domain string, rate double, domain_miss double")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs with each row as often as its rate says: the whole part of rate + u, where u
    in [0, 1) is a hash of doc_id and text, so expected totals are the fitted ones. Rows
    whose likeliest domain has a target of 1 or more have rates of 1 or more: none goes."""
    model = fit_classifier(docs, labels, max_labelled)
    targets = targets or TARGETS
    least = np.array([float(targets.get(d, 1.0) >= 1) for d in model.domains])
    # one pass classifies; texts are written once beside their posteriors, and not classified again
    table, (tokens, posterior) = _classified(docs, model)
    table = materialize(table, "classified")
    steps, _, _ = fit_rates(table, model.domains, targets, least=least, columns=(tokens, posterior))
    names, k = docs.columns, len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                r = rates(part.column(tokens).to_numpy(), _matrix(part.column(posterior), k), steps, least)
                u = np.array([xxhash.xxh3_64_intdigest(b"%s/%s" % (str(i).encode(), t or b"")) / 2.0**64 for i, t in zip(part.column("doc_id").to_pylist(), byte_texts(part.column("text")), strict=True)])
                yield part.select(names).take(pa.array(np.repeat(np.arange(part.num_rows), np.floor(r + u).astype(np.int64))))

    return table.mapInArrow(lean(run), docs.schema)


def read_labels(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")
