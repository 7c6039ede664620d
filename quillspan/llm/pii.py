"""Personal data: base patterns, and further spans chosen by boosted trees.

The base kinds follow fixed patterns and always stay. Generators with high recall then
propose further, overlapping spans: spelled-out e-mail addresses, telephone numbers
without a plus, IPv6 addresses, card numbers with odd separators, national, bank and
passport numbers, credentials, and long runs that look random. Gradient-boosted trees
score each from its format and its context. An isotonic regression over held-out examples
turns a kind's scores into chances; a span is taken if its chance is SURE or more, and if
no base span or better span overlaps it.
The trees are trained here, on examples that templates make; they have fixed size and
travel with the task, so the pass over the texts moves no text between machines.

Defined results. Null text counts as empty: zero counts, the digest of "", no spans.
Repeated rows are returned each. Offsets are code points, ends exclusive. Very long
texts are scanned whole. Extra columns are not read by find_spans and kept by redact.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm.common import keyed, lean, wide

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "secret")
_RANK = {k: i for i, k in enumerate((*BASE_KINDS, *MORE_KINDS))}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The base kinds' spans: leftmost, non-overlapping per kind, failing ones dropped."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Generators: (kind, a cheap pattern that any match of it contains, pattern). None has an
# upper length: a hit ends where its run of characters ends.
_COLONS = re.compile(r"::|(?:[0-9A-Fa-f]{1,4}:){7}")
_BRACKET_AT = re.compile(r"[\[({]at[\])}]", re.IGNORECASE)
_KEY_HEAD = re.compile(r"AKIA|ASIA|gh[opsu]_|xox[abprs]-|[sr]k_live_|-----BEGIN")
_ASSIGN = re.compile(r"[=:]")
_SPELLED_DOT = re.compile(r"\sdot\s", re.IGNORECASE)
_TOKEN_HEAD = re.compile(r"eyJ|earer |EARER ")
_PASSPORT = re.compile(r"passport", re.IGNORECASE)
_RANDOM = re.compile(r"[A-Za-z0-9_+/=-]{24}")
SURE = 0.9
GENERATORS = [
    ("email", _SPELLED_DOT, re.compile(r"\b[A-Za-z0-9_-]+(?:\s(?:dot|underscore|dash)\s[A-Za-z0-9_-]+)*\s(?:at|\[at\]|\(at\))\s[A-Za-z0-9-]+(?:\sdot\s[A-Za-z0-9-]+)+\b", re.IGNORECASE)),
    ("secret", _TOKEN_HEAD, re.compile(r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?|\b[Bb](?:earer|EARER) [A-Za-z0-9._~+/-]{12,}=*")),
    ("account", _PASSPORT, re.compile(r"passport(?:\s+(?:no\.?|number|nr\.?|is|#)){0,2}\s*[:#]?\s*([A-Z]{0,2}[0-9]{6,9})\b", re.IGNORECASE)),
    ("secret", _RANDOM, re.compile(r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_+/=-]{24,}(?![A-Za-z0-9_+/=.@-])")),
    ("email", _BRACKET_AT, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?| dot )[A-Za-z0-9-]+)+", re.IGNORECASE)),
    ("phone", _DIGIT, re.compile(r"(?<![0-9.+-])\(?[0-9]{2,5}\)?(?:[ .-]\(?[0-9]{2,4}\)?){1,4}(?![0-9])")),
    ("ip", _COLONS, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")),
    ("card", _DIGIT, re.compile(r"(?<![0-9.])[0-9]{3,4}(?:[._/][0-9]{3,6}){2,4}(?![0-9.])")),
    ("account", _DIGIT, re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", _ASSIGN, re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b ?[=:] ?\"?[A-Za-z0-9_/+-]{6,}\"?", re.IGNORECASE)),
    ("secret", _KEY_HEAD, re.compile(r"\b(?:AKIA|ASIA|gh[opsu]_|xox[abprs]-|[sr]k_live_)[A-Za-z0-9-]{12,}")),
    ("secret", _KEY_HEAD, re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")),
]
_CUES = {
    "phone": re.compile(r"(?:tel|phone|call|mobile|cell|fax|dial|whatsapp)\W*(?:\w+\W+)?$", re.IGNORECASE),
    "mail": re.compile(r"(?:mail|contact|write|reach)\W*(?:\w+\W+){0,2}$", re.IGNORECASE),
    "money": re.compile(r"(?:card|visa|iban|account|bank|ssn|social|security)\W*(?:\w+\W+){0,2}$", re.IGNORECASE),
    "other": re.compile(r"(?:version|isbn|page|order|item|date|year|no|nr|vol|part|section|chapter|id|build|issue|ratio|score|from|between)\W*$", re.IGNORECASE),
}
# Fixed value: endings of addresses.
_ENDING = re.compile(r"(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|pl|example|test)$", re.IGNORECASE)
_AT_WORD = re.compile(r"\bat\b", re.IGNORECASE)
FEATURES = 22


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands before and after it."""
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits = [c for c in s if c.isdigit()]
    runs = [len(r) for r in re.findall(r"[0-9]+", s)] or [0]
    letters = sum(c.isalpha() for c in s)
    seps = [c for c in s if not c.isalnum()]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in s[:400]]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))  # between digits, cases and signs
    return [
        _RANK[kind], len(s), len(digits), letters, len(seps), len(set(seps)), len(runs), runs[0], runs[-1], max(runs),
        float(len(digits) > 1 and luhn("".join(digits))), len(set(s)) / len(s),
        *(float(bool(p.search(before))) for p in _CUES.values()), float(after.isalnum()), float(s.startswith("19") or s.startswith("20")),
        float(any(c.isupper() for c in s)) + float(any(c.islower() for c in s)), turns / len(s), float(bool(_AT_WORD.search(s))) + float(bool(_ENDING.search(s))), float(bool(_TOKEN_HEAD.match(s) or _KEY_HEAD.match(s))),
    ]


def _is_ip6(run: str) -> bool:
    try:
        return len(run) > 3 and bool(ipaddress.IPv6Address(run))
    except ValueError:
        return False


def propose(text: str) -> list[Span]:
    """All spans of all generators; they may overlap."""
    out, held = [], {}
    for kind, need, pattern in GENERATORS:
        if need not in held:
            held[need] = need.search(text) is not None
        if held[need]:
            out += [(kind, *m.span(m.lastindex or 0)) for m in pattern.finditer(text) if kind != "ip" or _is_ip6(m[0])]
    return list(dict.fromkeys(out))


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of spans that the generators find in made sentences."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 9)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        body = d(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    good = [
        lambda: (rng.choice(["mail ", "contact me at ", "write to ", ""]), f"{word()}{rng.choice([' ', ''])}{rng.choice(['[at]', '(at)', '{at}', '(At)', '[AT]', '{AT}'])} {word()}{rng.choice([' [dot] ', ' (dot) ', ' dot ', '.', ' {dot} '])}{rng.choice(['com', 'org', 'net', 'de', 'example'])}"),
        lambda: (rng.choice(["call ", "phone: ", "tel. ", "fax ", "my mobile is ", ""]), rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(3)}"])),
        lambda: (rng.choice(["host ", "from ", ""]), ":".join(hexes(4) for _ in range(8))),
        lambda: (rng.choice(["host ", "from ", "address ", ""]), rng.choice([f"2001:db8::{hexes(rng.randint(1, 4))}", f"fe80::{hexes(rng.randint(1, 4))}", f"fe80::{hexes(4)}:{hexes(4)}", f"{hexes(4)}:{hexes(3)}::{hexes(2)}", ":".join(rng.choice("abcdef") * 4 for _ in range(8))])),
        lambda: (rng.choice(["card ", "visa ", ""]), grouped(card(), rng.choice("._/"))),
        lambda: (rng.choice(["ssn ", "social security number ", ""]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (rng.choice(["iban ", "account ", ""]), rng.choice(["DE", "FR", "ES", "GB"]) + d(2) + " " + grouped(d(18), " ")),
        lambda: (rng.choice(["use ", "with ", ""]), rng.choice(["password=", "token = ", "api_key: ", "secret="]) + rng.choice([hexes(rng.randint(8, 24)), f'"{hexes(40)}"'])),
        lambda: ("", rng.choice(["AKIA", "ghp_"]) + hexes(20).upper()),
        lambda: (rng.choice(["key ", ""]), rng.choice(["AKIA", "ghp_", "sk_live_", "xoxb-"]) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([16, 24, 36, 120])))),
        lambda: (rng.choice(["use ", "with ", ""]), rng.choice(["password=", "token=", "secret: "]) + hexes(rng.randint(60, 200))),
        lambda: ("", "-----BEGIN " + rng.choice(["", "RSA ", "EC "]) + "PRIVATE KEY-----\n" + "".join(hexes(64) + "\n" for _ in range(rng.randint(1, 20))) + rng.choice(["-----END PRIVATE KEY-----", ""])),
    ]
    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    dots = lambda k: " dot ".join(word() for _ in range(k))
    good += [
        lambda: (rng.choice(["mail ", "contact me at ", "write to ", "i am ", ""]), f"{dots(rng.randint(1, 2))} at {word()} dot {rng.choice(['com', 'org', 'net', 'de', 'co dot uk'])}"),
        lambda: (rng.choice(["call ", "phone: ", "tel. ", "dial ", "my mobile is ", "fax "]), rng.choice([f"{d(3)}-{d(4)}", f"{d(3)} {d(4)}", f"{d(3)}.{d(4)}"])),
        lambda: (rng.choice(["use ", "header ", ""]), "eyJ" + mixed(rng.randint(15, 60)) + "." + mixed(rng.randint(20, 90)) + rng.choice(["", "." + mixed(43)])),
        lambda: (rng.choice(["authorization: ", "send ", ""]), rng.choice(["Bearer ", "bearer "]) + mixed(rng.randint(16, 64))),
        lambda: (rng.choice(["passport ", "passport no. ", "Passport number: ", "passport # "]), rng.choice(["", "X", "C", "AB"]) + d(rng.randint(7, 9))),
        lambda: (rng.choice(["key ", "use ", "value ", ""]), mixed(rng.choice([24, 32, 40, 64]))),
        lambda: (rng.choice(["key ", "use ", ""]), hexes(rng.choice([32, 40, 64]))),
        lambda: (rng.choice(["use ", "my ", "the ", ""]), rng.choice(["password: ", "password=", "pwd = ", "Password: "]) + word() + d(rng.randint(1, 4)) + rng.choice(["", word()[:2]])),
        lambda: (rng.choice(["key ", "see ", ""]), rng.choice(["ghp_", "gho_", "sk_live_", "rk_live_", "xoxp-", "xoxb-"]) + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz" + rng.choice(["", "0123456789"])) for _ in range(rng.randint(14, 44)))),
        lambda: (rng.choice(["key ", ""]), rng.choice(["AKIA", "ASIA"]) + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
    ]
    bad = [
        lambda: (rng.choice(["", "about ", "order ", "page ", "from "]), rng.choice([f"{d(3)}-{d(4)}", f"{d(3)} {d(4)}", f"{d(3)}.{d(4)}"])),
        lambda: (rng.choice(["look ", "meet ", ""]), f"{rng.choice(['the', 'a', 'red'])} dot {rng.choice(['on', 'in', 'is'])} at {word()} dot {rng.choice(['and', 'then', 'here'])} {word()}"),
        lambda: ("", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(24, 60)))),
        lambda: ("", "-".join(word() for _ in range(rng.randint(5, 9)))),
        lambda: ("", "_".join(word() for _ in range(rng.randint(5, 9)))),
        lambda: ("", "/".join(word() for _ in range(rng.randint(5, 9)))),
        lambda: ("", rng.choice("-=_") * rng.randint(24, 80)),
        lambda: ("", "".join(rng.choice("acgt") for _ in range(rng.randint(24, 90)))),
        lambda: ("", d(rng.randint(24, 60))),
        lambda: (rng.choice(["date ", "on ", ""]), f"{rng.choice(['19', '20'])}{d(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        lambda: (rng.choice(["version ", "build ", ""]), f"{d(2)}.{d(2)}.{d(2)}"),
        lambda: (rng.choice(["from ", "between ", ""]), f"19{d(2)}-20{d(2)}"),
        lambda: (rng.choice(["score ", "page ", "ratio ", ""]), f"{d(2)}-{d(2)}"),
        lambda: (rng.choice(["order ", "item no ", "id "]), f"{d(4)}-{d(4)}"),
        lambda: (rng.choice(["isbn ", "ISBN "]), f"978-{d(2)}-{d(4)}-{d(3)}"),
        lambda: (rng.choice(["", "there are ", "about "]), rng.choice([f"{d(2)} {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(3)}"])),
        lambda: (rng.choice(["at ", ""]), ":".join(d(2) for _ in range(4))),
        lambda: (rng.choice(["item ", "part "]), f"{d(3)}/{d(3)}/{d(3)}"),
        lambda: ("the ", rng.choice(["token: something", "password: required", "secret: nothing-here"])),
        lambda: ("use ", rng.choice(["std::", "face::", "add::", "a::"]) + rng.choice(["bad", "add", "cafe", "de"])),
    ]
    rows, labels = [], []
    while len(rows) < n:
        label = rng.random() < 0.5
        cue, body = rng.choice(good if label else bad)()
        head = " ".join(word() for _ in range(rng.randint(1, 6)))
        text = f"{head} {cue}{body} {word()} {word()}."
        at = len(head) + 1 + len(cue)
        for kind, s, e in propose(text):
            hit = label and s <= at + 7 and e >= at + len(body) - 1
            rows.append(features(text, kind, s, e))
            labels.append(float(hit))
    return np.array(rows), np.array(labels)


@dataclass
class Trees:
    """Oblivious trees: each has one (feature, cut) per level and a value per leaf."""

    feature: np.ndarray  # trees x depth
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row."""
        bits = x[:, self.feature] > self.cut
        at = (bits << np.arange(self.feature.shape[1])).sum(axis=2)
        raw = self.bias + self.leaf[np.arange(len(self.leaf)), at].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3) -> Trees:
    """Gradient boosting with logistic loss and Newton leaf values."""
    # every value of a feature that has few: rare kinds have values of their own
    cuts = [v[:-1] if len(v := np.unique(c)) <= 24 else np.unique(np.quantile(c, np.linspace(0.03, 0.97, 24))) for c in x.T]
    options = [(f, c) for f, v in enumerate(cuts) for c in v]
    above = np.array([x[:, f] > c for f, c in options])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    raw, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node, chosen = np.zeros(len(y), int), []
        for level in range(depth):
            gain = np.zeros(len(options))
            for leaf in range(1 << level):
                inside = node == leaf
                gi, hi = above[:, inside] @ g[inside], above[:, inside] @ h[inside]
                gain += gi**2 / (hi + 1) + (g[inside].sum() - gi) ** 2 / (h[inside].sum() - hi + 1)
            best = int(gain.argmax())
            chosen.append(options[best])
            node += above[best] << level
        value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
        raw += value[node]
        trees.append((*zip(*chosen, strict=True), value))
    f, c, v = zip(*trees, strict=True)
    return Trees(np.array(f), np.array(c), np.array(v), bias)


def isotonic(y: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to y: neighbours that fall are pooled into their mean."""
    sums, sizes = [], []
    for v in y.tolist():
        sums.append(v), sizes.append(1)
        while len(sums) > 1 and sums[-2] * sizes[-1] >= sums[-1] * sizes[-2]:
            v, n = sums.pop(), sizes.pop()
            sums[-1] += v
            sizes[-1] += n
    return np.repeat(np.array(sums) / np.array(sizes), sizes) if len(y) else np.zeros(0)


@functools.lru_cache(maxsize=2)
def trained(sure: float = SURE, n: int = 9000, seed: int = 11) -> tuple[Trees, dict[str, float]]:
    """The trees, and by kind the lowest score whose chance, on other examples, is `sure` or more."""
    trees = boost(*examples(n, seed), rounds=60)
    x, y = examples(n, seed + 1)
    score, kinds = trees.score(x), x[:, 0]
    cuts = {}
    for kind, k in _RANK.items():
        own = kinds == k
        order = np.argsort(score[own], kind="stable")
        fit = np.flatnonzero(isotonic(y[own][order]) >= sure)
        cuts[kind] = float(score[own][order][fit[0]]) if len(fit) else 2.0
    return trees, cuts


class _Covered:
    """Disjoint intervals; whether a new one meets them takes a binary search."""

    def __init__(self, spans: list[Span] = ()) -> None:
        self.starts, self.ends = [], []
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s

    def add(self, s: int, e: int) -> None:
        k = bisect_left(self.starts, s)
        self.starts.insert(k, s), self.ends.insert(k, e)


def find(text: str, model: tuple[Trees, dict[str, float]]) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that the trees add, both in order of kind and start."""
    base = sorted(base_spans(text), key=lambda s: (_RANK[s[0]], s[1]))
    taken, added = _Covered(base), []
    offered = [s for s in propose(text) if not taken.meets(s[1], s[2])]
    if offered:
        trees, cuts = model
        score = trees.score(np.array([features(text, *s) for s in offered]))
        for x, s in sorted(zip(-score, offered, strict=True)):
            if -x >= cuts[s[0]] and not taken.meets(s[1], s[2]):
                taken.add(s[1], s[2])
                added.append(s)
    return base, sorted(added, key=lambda s: (_RANK[s[0]], s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (_RANK[s[0]], s[1])))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds and of all spans, base_sha256, spans for each row of docs."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, digests, spans = [], [], []
                for t in part.column(1):
                    base, added = find(t.as_py() or "", model)
                    counts.append([*(sum(k == s[0] for s in base) for k in BASE_KINDS), len(base) + len(added)])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(base + added))
                cols = np.array(counts, np.int64).reshape(-1, len(BASE_KINDS) + 1).T
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in (*BASE_KINDS, "spans")), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in (*BASE_KINDS, "spans"))
    return wide(keyed(docs, "doc_id", "text")).mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; n_chars, if there is one, follows."""
    model = trained()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [None if t is None else redacted(t, [s for x in find(t, model) for s in x]) for t in part.column("text").to_pylist()]
                cols = {n: part.column(n) for n in names}
                if "n_chars" in cols:
                    old = part.column("text").to_pylist()
                    sizes = [n if t == o else len(t) for n, t, o in zip(cols["n_chars"].to_pylist(), texts, old, strict=True)]
                    cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
                cols["text"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return docs.mapInArrow(lean(run), docs.schema)
