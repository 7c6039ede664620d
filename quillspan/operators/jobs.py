"""Hooks: jobs that ask a model, encoders, and a rule per category.

The model and the encoder are callables; answers and vectors come back as tables, so what
is cached, checked and projected is the same whoever answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quillspan.operators.metrics import ordinal
from quillspan.operators.validate import chunked

Ask = Callable[[str], str]


@dataclass(frozen=True)
class Job:
    """What a job asks and accepts.

    build: the prompt of some keys' rows (a list of dicts). parse: records by key, from the
    keys and the answer; keys that it leaves out are rejected, a ValueError rejects all.
    reads: the columns that a key's prompt depends on.
    """

    build: Callable[[list[dict]], str]
    parse: Callable[[list[str], str], dict[str, dict]]
    reads: tuple[str, ...]
    per_request: int = 1

    def prints(self, rows: DataFrame) -> DataFrame:
        """key, print: a digest of what each key's prompt depends on."""
        return rows.select("key", F.sha2(F.to_json(F.struct(*self.reads)), 256).alias("print"))

    def requests(self, rows: DataFrame) -> DataFrame:
        """request, keys, prompt of the rows (key and self.reads), per_request to a request."""
        build, columns = self.build, self.reads
        dealt = rows.join(chunked(rows.select("key"), "key", self.per_request), "key")
        packed = dealt.groupBy(F.col("chunk").alias("request")).agg(F.array_sort(F.collect_list(F.struct("place", F.to_json(F.struct(*columns)).alias("row"), "key"))).alias("r"))

        @F.pandas_udf("string")
        def prompt(rows_: pd.Series) -> pd.Series:
            return rows_.map(lambda x: build([json.loads(r) for r in x]))

        return packed.select("request", F.transform("r", lambda x: x["key"].cast("string")).alias("keys"), prompt(F.transform("r", lambda x: x["row"])).alias("prompt"))

    def records(self, requests: DataFrame, ask: Ask, tries: int = 3) -> DataFrame:
        """key, record (JSON; null if rejected), error: each request is asked until all of its keys
        are accepted, `tries` times at most; what an earlier answer had right stays."""
        parse = self.parse

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for keys, prompt in zip(batch["keys"], batch["prompt"], strict=True):
                    keys, got, error = list(keys), {}, None
                    for k in range(tries):
                        try:
                            got = {**parse(keys, ask(prompt if k == 0 else f"{prompt}\n\nThe last answer was refused: {error}")), **got}
                            error = f"{len(keys) - len(got)} of {len(keys)} keys rejected"
                        except ValueError as e:
                            error = str(e)
                        if len(got) == len(keys):
                            break
                    out += [(key, json.dumps(got[key], sort_keys=True) if key in got else None, None if key in got else error) for key in keys]
                yield pd.DataFrame(out, columns=["key", "record", "error"])

        return requests.select("keys", "prompt").mapInPandas(run, "key string, record string, error string")


def encoded(texts: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], budget: int = 8192) -> DataFrame:
    """texts with vector: encode is called on texts of like length, so many that the longest times
    their number stays within budget; a MemoryError halves the budget and tries again.

    Rows are dealt to ranges of the length over the whole table and sorted within, and a batch
    goes on over the bounds of Arrow batches, so little is padded: only a range's last batch
    is smaller than it could be. Equal lengths are spread by a hash of the row."""
    plain = [F.col(f"`{f.name}`") for f in texts.schema.fields if isinstance(f.dataType, AtomicType)]
    length = free_name(texts.columns, "length")
    dealt = texts.withColumn(length, F.coalesce(F.length(text), F.lit(0))).repartitionByRange(length, F.xxhash64(*plain)).sortWithinPartitions(length)

    def vectors(values: list[str], room: list[int]) -> list[np.ndarray]:
        try:
            return [np.asarray(v, np.float32) for v in encode(values)]
        except MemoryError:
            if len(values) == 1:
                raise
            room[0] = max(1, room[0] // 2)
            half = len(values) // 2
            return vectors(values[:half], room) + vectors(values[half:], room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, held, count = [budget], [], 0  # slices of rows that wait for their batch to fill

        def done() -> Iterator[pa.RecordBatch]:
            values = [t or "" for part in held for t in part.column(text).to_pylist()]
            found = vectors(values, room)
            at = 0
            for part in held:
                own = pa.array(found[at : at + part.num_rows], pa.list_(pa.float32()))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), own], [*names, "vector"])

        for batch in batches:
            start = 0
            for k, n in enumerate(batch.column(length).to_pylist()):
                if count and (count + 1) * max(n, 1) > room[0]:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    yield from done()
                    held, count, start = [], 0, k
                count += 1
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield from done()

    names = texts.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, vector array<float>")


def free_name(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def by_category(rows: DataFrame, category: str, rules: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each category's rows through its own rule, in one table; rows without a rule go."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rule(rows.where(F.col(category) == name)) for name, rule in rules.items()])


def seed_grid(situations: DataFrame, situation: str, styles: list[str], total: int, per_request: int) -> DataFrame:
    """key, situation, style, n of requests for `total` texts: all styles of a situation come before
    the next situation, situations in the order of their hash; raises if the grid is too small."""
    need = -(-total // per_request) if per_request > 0 else 0
    if total < 1 or need < 1 or need > situations.count() * len(styles):
        raise ValueError("the grid has fewer seeds than requests, or a count isn't positive")
    hashed = situations.select(F.col(situation).alias("situation")).withColumn("_order", F.struct(F.sha2("situation", 256).alias("h"), F.col("situation").alias("s")))
    numbered = ordinal(hashed, "_order", "_i").withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(len(styles) - 1))))
    grid = numbered.withColumn("_id", (F.col("_i") - 1) * len(styles) + F.col("_t")).where(F.col("_id") < need)
    n = F.least(F.lit(per_request), F.lit(total) - F.col("_id") * per_request)
    return grid.select(F.format_string("seed-%04d", "_id").alias("key"), "situation", F.get(F.array(*map(F.lit, styles)), F.col("_t")).alias("style"), n.cast("int").alias("n"))
