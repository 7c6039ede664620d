"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are collapsed to their smallest vec_id first. The rest are dealt to shards
by a hash of vec_id; each shard builds its graph, and every vector is searched in every
shard, in blocks. A query whose whole beam links is searched again with twice
the beam, down to brute force, so a dense cluster is not cut off. A block's first beam
is narrow and doubles until an audit against brute force over the shard finds
`AUDIT_RECALL` of the links; audited are queries from all over the block and, as most
have no links at all, the ones whose best hit comes closest to the cut. Found pairs are
verified by cosine in double precision, on the numbers as they were given. Vectors of
each length have graphs of their own.

A block returns a count for each query and a spanning forest of its links, so rows stay
linear in the vectors even if a third of them link with each other. Components are then
united over all forests.

Scale. Rows moved are vectors times shards, and there is a shard for every 200,000
vectors: the square of the input, divided by that. 8 shards serve 1.6 million vectors.

Defined results. Null, empty, zero or non-finite vectors link with nothing: 0 links, a
component of their own. Vectors of different lengths don't link. Rows that repeat a
vec_id with one vector count as one vector. A vec_id with several different vectors is
one node: links of any of them lead to it and through it, and n_links adds up the links of
each of its vectors, those among them included. A null vec_id links with nothing, has a null component_id and is kept. An empty table gives no
rows. Only vec_id and the embedding are read, labels and further columns never.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import discard, keyed, lean, map_groups, materialize
from quillspan.llm.graph import connected_components

COSINE = 0.95
SHARDS, SHARD_ROWS = 8, 200_000
BLOCKS, BLOCK_ROWS = 8, 20_000
DEGREE, BUILD_BEAM = 12, 32
AUDITED, AUDIT_RECALL = 48, 0.99
_CHUNK = 4 << 20


def _lockstep(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all rows of q at once: ids and similarities, best first, -1 if none.

    near: neighbours of each node, -1 if none. entry: starting nodes, a row for each query.
    """
    n, b = len(near), len(q)
    beam = max(beam, entry.shape[1])
    seen = np.zeros((b, n + 1), bool)  # the last column takes the -1s
    ids = np.full((b, beam), -1, np.int32)
    sims = np.full((b, beam), -np.inf, np.float32)
    fresh = np.zeros((b, beam), bool)
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("bkd,bd->bk", x[entry], q), -np.inf)
    fresh[:, : entry.shape[1]] = entry >= 0
    np.put_along_axis(seen, entry.astype(np.int64), True, axis=1)
    act = np.arange(b)
    while len(act):
        open_ = np.where(fresh[act], sims[act], -np.inf)
        top = np.argpartition(-open_, min(step, beam) - 1, axis=1)[:, :step]
        ok = np.take_along_axis(open_, top, axis=1) > -np.inf
        go = ok.any(axis=1)
        act, top, ok = act[go], top[go], ok[go]
        if not len(act):
            break
        own = np.arange(len(act))[:, None]
        fresh[act[:, None], top] = False
        new = near[np.where(ok, ids[act[:, None], top], -1)]
        new = np.where(ok[:, :, None], new, -1).reshape(len(act), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[act[:, None], new]] = -1
        seen[act[:, None], new] = True
        seen[:, -1] = False
        s = np.where(new >= 0, np.einsum("bkd,bd->bk", x[new], q[act]), -np.inf)
        all_s = np.concatenate([sims[act], s], axis=1)
        best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[act] = all_s[own, best]
        ids[act] = np.concatenate([ids[act], new], axis=1)[own, best]
        fresh[act] = np.concatenate([fresh[act], new >= 0], axis=1)[own, best]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` neighbours of each row: those closer to it than to one chosen before,
    then the closest of the rest. ids are sorted by similarity; -1 if none."""
    b, k = ids.shape
    v = x[ids]
    between = np.einsum("bid,bjd->bij", v, v)
    chosen = np.zeros((b, k), bool)
    count = np.zeros(b, int)
    for i in range(k):
        far = ~(chosen & (between[:, i] > sims[:, i, None])).any(axis=1)
        take = far & (ids[:, i] >= 0) & (count < degree)
        chosen[:, i] = take
        count += take
    rank = np.where(ids >= 0, np.where(chosen, 0, k) + np.arange(k), 3 * k)
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows as doubles of length 1. Scaled by a power of two first, so that squares of
    very small or large components neither vanish nor overflow."""
    x = raw.astype(float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Layers over vectors in order of falling level: layer l holds the first rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> None:
        rng = np.random.default_rng(len(ids))
        level = np.minimum(np.floor(-np.log(rng.random(len(ids))) / np.log(degree)), 6).astype(int)
        order = np.argsort(-level, kind="stable")
        self.ids, self.raw, level = ids[order], x[order], level[order]
        self.x = np.zeros((len(ids) + 1, x.shape[1]), np.float32)  # the last row serves -1
        self.x[:-1] = _unit(self.raw)
        self.layers: list[np.ndarray] = []  # from the top
        for lev in range(level.max(initial=0), -1, -1):
            n = int((level >= lev).sum())
            if n:
                self.layers.append(self._layer(n, degree * (2 if lev == 0 else 1), beam))

    def _entries(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        entry = np.zeros((len(q), 1), np.int32)
        for near in layers:
            entry = _lockstep(self.x, near, q, entry, 4)[0][:, :2]
        return entry

    def _layer(self, n: int, degree: int, beam: int) -> np.ndarray:
        near = np.full((n + 1, degree), -1, np.int32)
        done = 0
        while done < n:
            size = min(n - done, max(32, min(done, 512)))
            new = np.arange(done, done + size, dtype=np.int32)
            q = self.x[new]
            inner = q @ q.T  # the batch sees itself by brute force
            np.fill_diagonal(inner, -np.inf)
            k = min(size - 1, beam // 2)
            own = np.argpartition(-inner, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((size, 0), int)
            ids, sims = new[own], np.take_along_axis(inner, own, axis=1)
            if done:
                entry = self._entries(q, self.layers)
                entry = np.where(entry < done, entry, 0)
                old, s = _lockstep(self.x, near[:done], q, entry[:, :1], beam)
                ids, sims = np.concatenate([ids, old], axis=1), np.concatenate([sims, s], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            near[new] = _diverse(self.x, ids, sims, degree)
            self._link_back(near, new, degree)
            done += size
        return near[:n]

    def _link_back(self, near: np.ndarray, new: np.ndarray, degree: int) -> None:
        src = np.repeat(new, near.shape[1])
        dst = near[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 512):
            part = slice(at, at + 512)
            width = min(int(count[part].max()), 2 * degree)
            cols = np.arange(width)
            extra = np.where(cols < count[part, None], src[np.minimum(start[part, None] + cols, len(src) - 1)], -1)
            ids = np.concatenate([near[nodes[part]], extra], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("bkd,bd->bk", self.x[ids], self.x[nodes[part]]), -np.inf).astype(np.float32)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * degree]
            near[nodes[part]] = _diverse(self.x, np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1), degree)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return _lockstep(self.x, self.layers[-1], q, self._entries(q, self.layers[:-1]), beam)

    def _searched(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """search() of all rows, in steps that bound the memory."""
        step = max(16, min(512, 16_000_000 // max(len(self.ids), 1)))
        parts = [self.search(q[i : i + step], beam) for i in range(0, len(q), step)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _found(self, q: np.ndarray, rows: np.ndarray, beam: int, cut: np.float32, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, node) of at least cut. A row whose whole beam links is searched again with
        twice the beam, and by brute force from a quarter of the nodes on. known: what a search
        of all rows of q with this beam has found."""
        n = len(self.ids)
        at, node = [], []
        while len(rows):
            step = max(16, min(512, 16_000_000 // max(n, 1)))
            again = []
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                if beam >= n // 4:
                    a, b = np.nonzero(q[part] @ self.x[:-1].T >= cut)
                    at.append(part[a]), node.append(b)
                    continue
                ids, sims = self.search(q[part], beam) if known is None else (known[0][part], known[1][part])
                full = (sims >= cut).sum(axis=1) > 0.75 * beam
                again.append(part[full])
                a, k = np.nonzero((sims >= cut) & ~full[:, None])
                at.append(part[a]), node.append(ids[a, k])
            rows = np.concatenate(again) if again else np.zeros(0, int)
            beam, known = beam * 2, None
        return np.concatenate(at), np.concatenate(node)

    def links(self, raw: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of raw, node) with at least this cosine, verified in double precision.

        Audited are rows from all over raw, and those whose best hits lie closest to the cut. The
        audit holds what _found() finds, wider beams for full ones included: so a dense cluster
        widens the beams of its own rows and not those of the whole block."""
        n, unit = len(self.ids), _unit(raw)
        q = unit.astype(np.float32)
        cut, beam, known = np.float32(cosine - 1e-5), 16, None
        if beam < n // 4:
            known = self._searched(q, beam)
            near = np.argsort(np.abs(known[1] - cut).min(axis=1), kind="stable")[:AUDITED]
            audit = np.unique(np.concatenate([np.linspace(0, len(q) - 1, AUDITED).astype(int), near]))
            want = int((q[audit] @ self.x[:-1].T >= cut).sum())
            while beam < n // 4 and len(self._found(q, audit, beam, cut, known)[0]) < AUDIT_RECALL * want:
                beam, known = beam * 2, None
        at, node = self._found(q, np.arange(len(q)), beam, cut, known)
        own = _unit(self.raw[np.unique(node)])
        place = np.searchsorted(np.unique(node), node)
        ok = np.zeros(len(at), bool)
        for i in range(0, len(at), 100_000):
            s = slice(i, i + 100_000)
            ok[s] = np.einsum("kd,kd->k", unit[at[s]], own[place[s]]) >= cosine
        return at[ok], node[ok]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links reduced to (node, smallest node of its component)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[out].tolist(), nodes[label[out]].tolist(), strict=True))


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _valid(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id and v (the numbers' bytes) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if v is None or any(c is None for c in v) else np.array(v, kind) for v in b.column(1).to_pylist()]
            got = [v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None for v in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["vec_id", "v"])

    return keyed(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL").mapInArrow(lean(run), "vec_id long, v binary").where("v IS NOT NULL")


def _same_id(valid: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between the representatives of the different vectors that rows of one vec_id have."""
    several = materialize(valid.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "several-vectors")
    nodes = materialize(valid.join(several, "vec_id", "left_semi").join(reps.select("v", "rep"), "v").select("vec_id", "rep"), "several-nodes")
    low = nodes.groupBy("vec_id").agg(F.min("rep").alias("low"))
    return nodes.join(low, "vec_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    number = "<f4" if element == "float" else "<f8"
    valid = materialize(_valid(vectors, number).dropDuplicates(["vec_id", "v"]), "vectors")
    every = keyed(vectors, "vec_id")
    reps = materialize(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("w", F.length("v")), "reps")
    parts = lambda n, least, size: F.when(n < 1000, 1).otherwise(F.greatest(F.lit(least), F.ceil(n / size))).cast("int")
    n = F.col("n")
    sizes = materialize(reps.groupBy("w").agg(F.count("*").alias("n")).select("w", parts(n, SHARDS, SHARD_ROWS).alias("shards"), parts(n, BLOCKS, BLOCK_ROWS).alias("blocks")), "sizes")
    rows = reps.join(sizes, "w").select("w", "rep", "copies", "v", "shards", "blocks", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"))

    def build(table: pa.Table) -> pa.RecordBatch:
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        graph = Graph(np.stack([ids, copies], axis=1), _numbers(table.column("v"), number))
        blob = pickle.dumps(graph, protocol=5)
        parts = [blob[i : i + _CHUNK] for i in range(0, len(blob), _CHUNK)]
        same = lambda c: pa.array([table.column(c)[0].as_py()] * len(parts), pa.int32())
        return pa.RecordBatch.from_arrays([same("w"), same("shard"), same("blocks"), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["w", "shard", "blocks", "id", "data"])

    graphs = materialize(map_groups(rows, ["w", "shard"], build, "w int, shard int, blocks int, id long, data binary", ["rep"]), "graphs")

    def query(table: pa.Table) -> pa.RecordBatch | None:
        kind = table.column("kind").to_numpy()
        n = int((kind == 0).sum())
        if not n or n == len(kind):
            return None
        graph: Graph = pickle.loads(b"".join(table.column("data")[:n].to_pylist()))
        ids = table.column("id").to_numpy()[n:]
        at, node = graph.links(_numbers(table.column("data")[n:], number), cosine)
        a, b, weight = ids[at], graph.ids[node, 0], graph.ids[node, 1]
        other = a != b
        at, a, b, weight = at[other], a[other], b[other], weight[other]
        n_links = np.bincount(at, weight, len(ids)).astype(np.int64)
        pairs = forest(a, b) if len(a) else []
        one, two = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), *one], pa.int64()), pa.array([*n_links.tolist(), *[0] * len(one)], pa.int64()), pa.array([*[None] * len(ids), *two], pa.int64())], ["id", "n", "other"])

    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = graphs.select("w", "shard", F.lit(0).alias("kind"), "id", "data", upto("blocks").alias("block"))
    right = rows.select("w", upto("shards").alias("shard"), F.lit(1).alias("kind"), F.col("rep").alias("id"), F.col("v").alias("data"), F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int").alias("block"))
    found = materialize(map_groups(left.unionByName(right), ["w", "shard", "block"], query, "id long, n long, other long", ["kind", "id"]), "found")
    counts = found.where("other IS NULL").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    edges = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    parts = connected_components(edges.union(_same_id(valid, reps)))
    classes = reps.join(counts, "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    classes = materialize(classes.select("v", (F.col("n") + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("class")), "classes")
    per = valid.join(classes, "v").groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("class").alias("class"))
    component = F.coalesce("class", "vec_id")
    out = every.join(per, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    for old in (graphs, found, sizes):
        discard(old)
    return out
