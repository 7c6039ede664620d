"""Incremental recomputation: digests, caches of answers, ledgers, and a graph of steps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# --- digests ----------------------------------------------------------------------------


def snapshot(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, digest of the selected columns only, so other changes leave it as it was."""
    return rows.select(F.col(key).alias("key"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key and reason (added, removed, changed) of what differs."""
    both = old.select("key", F.col("digest").alias("_o")).join(new.select("key", F.col("digest").alias("_n")), "key", "full_outer")
    reason = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return both.select("key", reason.alias("reason")).where("reason IS NOT NULL")


def _leaves(value, path: str = "") -> dict[str, str]:
    if isinstance(value, dict) and value:
        return {k: v for name, x in value.items() for k, v in _leaves(x, f"{path}.{name}" if path else name).items()}
    return {path: json.dumps(value, ensure_ascii=False, sort_keys=True)}


@F.pandas_udf(MapType(StringType(), StringType()))
def leaves(doc: pd.Series) -> pd.Series:
    """Dotted paths and JSON values of a nested JSON object's leaves; an empty object is a leaf."""
    return doc.map(lambda t: {} if t is None else _leaves(json.loads(t)))


def nested_changes(old: DataFrame, new: DataFrame, key: str, doc: str) -> DataFrame:
    """key, path, reason: where the nested objects of both tables differ, with both values."""
    flat = lambda df, name: df.select(key, F.explode(leaves(F.col(doc))).alias("path", name))
    both = flat(old, "_o").join(flat(new, "_n"), [key, "path"], "full_outer").where(~F.col("_o").eqNullSafe(F.col("_n")))
    said = lambda c: F.coalesce(c, F.lit("none"))
    return both.select(key, "path", F.concat(F.col("path"), F.lit(" changed: "), said("_o"), F.lit(" -> "), said("_n")).alias("reason"))


# --- caches of answers --------------------------------------------------------------------


def reusable(cache: DataFrame, prints: DataFrame, accepted) -> DataFrame:
    """The last cached record of each key whose digest is the current one and that is accepted.

    cache: key, digest, ordinal and values. prints: key, digest."""
    rest = [c for c in cache.columns if c not in ("key", "digest")]
    fit = cache.join(prints, ["key", "digest"], "left_semi").where(accepted)
    return fit.groupBy("key").agg(F.max_by(F.struct(*rest), "ordinal").alias("_v")).select("key", "_v.*")


def plan_of(cache: DataFrame, wanted: DataFrame, signature: str, accepted: Column) -> DataFrame:
    """key, reason: what stands between each wanted key (key, print) and a usable record: null if
    there is one, else new key, signature, prompt, or rejected by the parser. The reason is that
    of the last entry with the key. cache: key, ordinal, signature, print and values."""
    good = cache.where((F.col("signature") == signature) & accepted).join(wanted, ["key", "print"], "left_semi").select("key").distinct().withColumn("_ok", F.lit(True))
    last = cache.groupBy("key").agg(F.max_by(F.struct("signature", F.col("print").alias("was")), "ordinal").alias("_l"))
    rows = wanted.join(good, "key", "left").join(last, "key", "left")
    changed = F.when(F.col("_l").isNull(), "new key").when(F.col("_l.signature") != signature, "signature").when(~F.col("_l.was").eqNullSafe(F.col("print")), "prompt").otherwise("rejected")
    return rows.select("key", F.when(F.col("_ok").isNull(), changed).alias("reason"))


def coverage(plan: DataFrame, per_request: int) -> DataFrame:
    """One row: keys, used, missing, and the requests that the missing ones would take."""
    used = F.count_if(F.col("reason").isNull())
    return plan.agg(F.count("*").alias("keys"), used.alias("used"), F.count_if(F.col("reason").isNotNull()).alias("missing"), F.ceil(F.count_if(F.col("reason").isNotNull()) / per_request).alias("requests"))


def unused(cache: DataFrame, used: DataFrame) -> DataFrame:
    """The cache entries (by ordinal) that no used record comes from."""
    return cache.join(used.select("ordinal").distinct(), "ordinal", "left_anti")


def projected(records: DataFrame, wanted: DataFrame, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The records of the wanted keys in order of key, projected; raises if a key has none."""
    missing = wanted.select("key").join(records.select("key"), "key", "left_anti").limit(6)
    lost = [r.key for r in missing.collect()]  # six at most
    if lost:
        raise RuntimeError(f"keys without an accepted record, for example {lost[:5]}")
    rows = records.join(wanted.select("key").distinct(), "key", "left_semi").orderBy("key")
    return project(rows) if project else rows


def pruned(cache: DataFrame, seen: str, used: DataFrame) -> DataFrame:
    """The cache without unused entries; raises if it is no longer the one whose digest was seen."""
    if table_digest(cache) != seen:
        raise RuntimeError("the cache changed after it was inspected; inspect it again")
    return cache.join(used.select("ordinal").distinct(), "ordinal", "left_semi")


def table_digest(rows: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: rows' hashes are added up in two halves."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(F.count("*"), *[part(k) for k in range(5)]).first()
    return hashlib.sha256(repr(tuple(str(x) for x in r)).encode()).hexdigest()


# --- ledgers ------------------------------------------------------------------------------


def ungraded(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """The requests (id, request) that the ledger hasn't got: an old grade of a changed one doesn't count."""
    return requests.join(ledger.select("request").distinct(), "request", "left_anti")


def failing(requests: DataFrame, ledger: DataFrame, grade: str, least: float, ordinal_: str) -> DataFrame:
    """id of those whose last grade for their current request is below `least`: the threshold holds
    for old grades too, and what has no grade isn't dropped."""
    last = ledger.groupBy("request").agg(F.max_by(grade, ordinal_).alias("_g"))
    return requests.join(last, "request").where(F.col("_g") < least).select("id")


def refilled(candidates: DataFrame, drops: DataFrame, group: str, order: list[Column], target: int, rounds: Iterable[DataFrame]) -> DataFrame:
    """The target best of each group after each round's failures (id) have left for good: a place
    that becomes free goes to the next candidate."""
    from quillspan.operators.select import top_per_group

    gone = drops.select("id")
    for failed in rounds:
        gone = gone.union(failed.select("id"))
    return top_per_group(candidates.join(gone.distinct(), "id", "left_anti"), group, order, target)


def frozen(lists: DataFrame, digests: DataFrame, found: DataFrame, complete: DataFrame) -> DataFrame:
    """key, words, digest: a list stays while its digest is the current one; else the found list
    takes its place, with a digest only if its sample was complete, so it is tried again otherwise.

    lists: key, words, digest. digests: key, now. found: key, new. complete: key."""
    rows = digests.join(lists.withColumnsRenamed({"words": "_w", "digest": "_d"}), "key", "left").join(found, "key", "left").join(complete.select("key").withColumn("_c", F.lit(True)), "key", "left")
    kept = F.coalesce(F.col("_d") == F.col("now"), F.lit(False))
    return rows.select("key", F.when(kept, F.col("_w")).otherwise(F.coalesce("new", F.array().cast("array<string>"))).alias("words"), F.when(kept | F.col("_c"), F.col("now")).alias("digest"))


def still_dropped(drops: DataFrame, version: int, current: int, fixable: Column) -> DataFrame:
    """The drops that stay: a newer resolver takes up only those that its change can mend."""
    return drops if version >= current else drops.where(~F.coalesce(fixable, F.lit(False)))


# --- steps --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """A step of a graph: what it needs, and how its state (a JSON object) and its run are had."""

    name: str
    command: str
    state: Callable[[], dict]
    run: Callable[[], object]
    needs: tuple[str, ...] = ()


@dataclass
class Stamps:
    """The last state of each step, as written after it ran."""

    known: dict[str, dict] = field(default_factory=dict)

    def reasons(self, step: Step) -> list[str]:
        """Why a step isn't current: no stamp, or what its stamp and its state differ in."""
        old, new = self.known.get(step.name), step.state()
        if old is None:
            return ["no stamp"]
        a, b = _leaves(old), _leaves(new)
        return [f"{k} changed" for k in sorted({*a, *b}) if a.get(k) != b.get(k)] + [f"missing {k}" for k, v in sorted(b.items()) if v == "null"]


def dry_run(steps: list[Step], stamps: Stamps, command: str) -> list[tuple[str, list[str]]]:
    """Each of the command's steps with the reasons why it would run, those of steps before it included."""
    dirty: set[str] = set()
    out = []
    for s in (s for s in steps if s.command == command):
        why = stamps.reasons(s) + [f"{n} will run" for n in s.needs if n in dirty]
        if why:
            dirty.add(s.name)
        out.append((s.name, why))
    return out


def run_steps(steps: list[Step], stamps: Stamps, command: str) -> list[tuple[str, str]]:
    """Run what isn't current, in order; a stamp is written after a step has ended."""
    out = []
    for s in (s for s in steps if s.command == command):
        if stamps.reasons(s):
            s.run()
            stamps.known[s.name] = json.loads(json.dumps(s.state()))
            out.append((s.name, "done"))
        else:
            out.append((s.name, "up to date"))
    return out


def provenance(stamps: Stamps, versions: dict[str, str], config: dict) -> str:
    """One JSON document: versions, configuration, and each step's state."""
    return json.dumps({"versions": versions, "config": config, "steps": stamps.known}, sort_keys=True, indent=2)


def read_files(rows: DataFrame) -> DataFrame:
    """file, sha256-able name of each file that the rows were read from: a receipt of observed reads."""
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).distinct()
