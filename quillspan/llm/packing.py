"""Best-fit packing of tokenised documents by large-item matching.

Documents are cut into pieces of at most `capacity` tokens; pieces are packed whole.
Only piece lengths matter, and there are at most `capacity` of them, so the plan is made
over counts by length: a table of fixed size, however many documents there are. Pieces
over a third of the capacity are matched, the longest with the longest that still fits,
at most two to a sequence; shorter ones, longest first, go to the sequences with the
smallest gap that takes them. The plan is a list of runs: "of the pieces of length L,
those ranked lo to hi lie at offset o of sequences s, s + 1, ...". Ranks come from
per-chunk counts, so a length that a third of all pieces have is ranked in many tasks.

Defined results. Null or empty text: the end token alone, one piece of length 1. Rows
that repeat are packed as often as they occur; pieces of rows with the same doc_id and
length may change places, which changes no total. An empty table gives no rows. A null
doc_id is kept as null. Extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import byte_texts, keyed, lean, materialize, tokenizer_path, wide, worker_cache

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CACHED = 150_000  # chunks a worker remembers; beyond that it starts anew


#: Bytes of UTF-8 that no word of lower-case letters has stand for "last byte of the word".
_LAST = {**{b: bytes([b - 32]) for b in range(97, 123)}, **{b: bytes([b - 128]) for b in range(128, 192)}}
_RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _word_merges(path: str) -> Callable[[bytes], list[int]] | None:
    """Ids of one word of lower-case letters, by the vocabulary's merges alone; None if the
    vocabulary is no byte-level one whose ids follow its merges and whose words end in </w>."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model.get("vocab"), model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or suffix != "</w>" or any(vocab["".join(m)] != 512 + k for k, m in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])):
        return None
    letters, ranks = _byte_letters(), {}
    for token, k in vocab.items():
        raw = bytes(letters[c] for c in token.removesuffix(suffix))
        if all(97 <= c < 123 or c >= 128 for c in raw) and (not token.endswith(suffix) or raw[-1] in _LAST):
            ranks[raw[:-1] + _LAST[raw[-1]] if token.endswith(suffix) else raw] = k
    for b in range(256):
        ranks.setdefault(bytes([b]), 1_000_000 + b)  # never met in a word
    merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda word: merge(word[:-1] + _LAST[word[-1]])


class _Chunks(dict):
    """White-space separated chunk to its ids as 32-bit bytes.

    The vocabulary's pre-tokeniser never joins across white space, nor letters with digits
    or signs (but for apostrophes), so a text's ids are those of its runs, in order. Runs of
    letters up to U+017F, which no normalisation changes, are merged directly; any other run
    goes through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.word = Tokenizer.from_file(path), _word_merges(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if self.word is None:
            out = self.whole(chunk.decode())
        elif chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                out = _packed(self.word(low))
            elif b"'" in low or len(runs := _RUNS.findall(low)) == 1:
                out = self.whole(low.decode())
            else:
                out = b"".join([self[r] for r in runs])
        elif chunk[-1] in b".," and chunk[-2:-1].isalpha():
            out = self[chunk[:-1]] + self[chunk[-1:]]
        else:
            text = chunk.decode()
            low = text.lower()
            out = _packed(self.word(low.encode())) if low.isalpha() and max(low) < "\u0180" else self.whole(text)
        self[chunk] = out
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _tokenizer(path: str) -> _Chunks:
    kept = worker_cache(__name__)
    if path not in kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept[path] = _Chunks(path)
    return kept[path]


def token_bytes(texts: list[bytes | None], chunks: _Chunks) -> Iterator[bytes]:
    """Each whole text's ids as little-endian 32-bit bytes, without the end token."""
    for t in texts:
        if len(chunks) > CACHED:
            chunks.clear()
        if not t:
            yield b""
        elif b"<|" in t:  # special tokens' names are found before letters become lower case
            yield chunks.whole(t.decode())
        else:  # a letter that a mark follows composes before it becomes lower case
            yield b"".join(map(chunks.__getitem__, (t if b"\xcc" in t or b"\xcd" in t else t.lower()).split()))


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if with_ids, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or tokenizer_path(VOCABULARY)
        chunks, end, step = _tokenizer(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts = byte_texts(part.column(1))
                owner, number, crc, length, ids = [], [], [], [], []
                for k, own in enumerate(token_bytes(texts, chunks)):
                    all_ids = own + end
                    for n, s in enumerate(range(0, len(all_ids), step)):
                        raw = all_ids[s : s + step]
                        owner.append(k), number.append(n), length.append(len(raw) // 4), crc.append(zlib.crc32(raw))
                        if with_ids:
                            ids.append(np.frombuffer(raw, "<i4"))
                number = np.array(number, np.int32)
                out = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], [*names, *["ids"] * with_ids])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return wide(keyed(docs, "doc_id", "text")).mapInArrow(lean(run), schema + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, lo, hi, sequence, offset) that place all pieces of each length.

    Sequences with the same fill are one group, so the work depends on the number of
    lengths and groups and not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    runs, top = [], 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of them), sorted

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, sequence, offset))
        used[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        one = large[-1]
        if not left[one]:
            large.pop()
            continue
        k = bisect_left(large, capacity - one + 1) - 1  # the longest partner that fits
        while k >= 0 and (not left[large[k]] or large[k] == one and left[one] < 2):
            k -= 1
        n = left[one] if k < 0 else left[one] // 2 if large[k] == one else min(left[one], left[large[k]])
        place(one, n, top, 0)
        gap = capacity - one
        if k >= 0:
            place(large[k], n, top, one)
            gap -= large[k]
        if gap:
            insort(gaps, (gap, top, n))
        top += n
    for small in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[small]:
            k = bisect_left(gaps, (small, -1, -1))
            if k < len(gaps):
                gap, first, n = gaps.pop(k)
                m = min(n, left[small])
                place(small, m, first, capacity - gap)
                if m < n:
                    insort(gaps, (gap, first + m, n - m))
                if gap > small:
                    insort(gaps, (gap - small, first, m))
                continue
            fit = capacity // small
            rows, rest = divmod(left[small], fit)
            for n, full in ((rows, fit), (1, rest)):
                if n and full:
                    for i in range(full):
                        place(small, n, top, i * small)
                    if capacity - full * small:
                        insort(gaps, (capacity - full * small, top, n))
                    top += n
    return runs


def ranked(table: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """table with rank: 0, 1, ... within each length, without gathering a length.

    Rows are dealt to chunks by a hash; a window ranks each (length, chunk), and chunk
    offsets come from sums over the counts of chunks.
    """
    rows = table.count()
    chunks = max(32, -(-rows // chunk_rows))
    dealt = table.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    per = dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "offsets")
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    local = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    # no broadcast: the offsets grow with the rows, and the window has dealt by these keys already
    return local.join(offsets.hint("shuffle_hash"), ["length", "_chunk"]).withColumn("rank", F.col("_before") + F.col("_at")).drop("_chunk", "_before", "_at")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset (and their ids, if asked for)."""
    table = materialize(pieces(docs, capacity, vocabulary, end_id, with_ids), "pieces")
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(counts, capacity))
    length, lo, _, sequence, offset = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 5
    key = length << 48 | lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, n << 48 | rank, "right") - 1
            new = [pa.array(sequence[at] + rank - lo[at]), pa.array(offset[at])]
            names = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], [*names, "sequence_id", "offset"])

    rows = ranked(table)
    kept = [c for c in rows.columns if c != "rank"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "rank").mapInArrow(lean(run), f"{schema}, sequence_id long, offset long")
