"""Near-duplicate vectors by cells of near ones and hierarchical navigable small-world graphs.

A table of more than ``route_from`` vectors is cut into overlapping cells:
each vector lies in those of its nearest pivots, which are a bounded sample of
the vectors. In a cell all pairs are compared; a crowded one is searched by
graphs, in which whole blocks of queries advance together in numpy, with beams
that widen while they are full of matches or while an audit against brute force
finds too few. What comes out is audited against brute force over all vectors,
and done again with more cells for each should recall be too low.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.operators.components import connected_components, spanning_forest
from portolan.session import discard, materialize, private_name, ship_code


@dataclass(frozen=True)
class HnswParams:
    threshold: float = 0.95  # cosine from which two vectors are near-duplicates
    links: int = 12  # of a node in an upper layer; twice as many in the lowest
    build_beam: int = 48
    beam: int = 32
    shard_rows: int = 8192
    expand: int = 4  # candidates of each query that one step expands
    block: int = 256  # queries that advance together
    audit_rows: int = 64
    recall: float = 0.97
    seed: int = 5
    route_from: int = 16_384  # vectors of one length above which they are cut into cells
    pivot_rows: int = 1024  # vectors for each pivot, as long as there are no more than ``pivots``
    pivots: int = 16_384
    pivot_mb: int = 16  # of all pivots of one length
    cells: int = 4  # of a vector
    whole_rows: int = 32_768  # of a cell above which graphs search it
    audit_queries: int = 1024  # vectors of each length that are held against all others


class Graph:
    """The layers over unit vectors ``x``; neighbours of layer l are rows of ``layers[l]``, filled up with -1."""

    def __init__(self, x: np.ndarray, p: HnswParams):
        self.x, self.p = np.ascontiguousarray(x, np.float32), p
        n = len(x)
        rng = np.random.Generator(np.random.PCG64(p.seed))
        height = np.floor(-np.log(1.0 - rng.random(n)) / math.log(p.links)).astype(np.int64)
        self.height = np.minimum(height, max(0, int(math.log(max(n, 2), p.links))))
        self.layers: list[np.ndarray] = []
        self.entry = np.zeros(0, np.int64)

    def build(self) -> Graph:
        p, n = self.p, len(self.x)
        self.layers = [np.full((n, p.links * (1 if lay else 2)), -1, np.int32) for lay in range(int(self.height.max(initial=0)) + 1)]
        done = 0
        while done < n:
            ids = np.arange(done, min(n, done + min(max(32, done // 2), p.block)))
            self._insert(ids, done)
            done = int(ids[-1]) + 1
            low = self.height[:done]
            self.entry = np.flatnonzero(low == low.max())[:8]
        return self

    def _insert(self, ids: np.ndarray, done: int) -> None:
        p = self.p
        q = self.x[ids]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        start = None
        for lay in range(len(self.layers) - 1, -1, -1):
            here = self.height[ids] >= lay
            found = np.full((len(ids), 0), -1, np.int64)
            sims = np.zeros((len(ids), 0), np.float32)
            if done:
                if start is None and lay > int(self.height[:done].max()):
                    pass
                else:
                    first = np.broadcast_to(self.entry, (len(ids), len(self.entry))) if start is None else start
                    found, sims = self.search_layer(q, first, p.build_beam if here.any() else 8, lay)
                    start = found[:, :8]
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            peers = np.flatnonzero(here)
            cand = np.concatenate([found[rows], np.broadcast_to(ids[peers], (len(rows), len(peers)))], 1)
            sim = np.concatenate([sims[rows], among[np.ix_(rows, peers)]], 1)
            sim = np.where(cand == ids[rows][:, None], -np.inf, sim)
            width = min(p.build_beam, cand.shape[1])
            order = np.argsort(-sim, axis=1, kind="stable")[:, :width]
            cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
            cand = np.where(np.isfinite(sim), cand, -1)
            self._link(lay, ids[rows], cand, sim)

    def _select(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in falling similarity, those nearer to the node than to any chosen before; then the nearest of the rest."""
        b, c = cand.shape
        vec = self.x[np.maximum(cand, 0)]
        pair = vec @ vec.transpose(0, 2, 1)
        nearest = np.full((b, c), -np.inf, np.float32)
        chosen = np.zeros((b, c), bool)
        count = np.zeros(b, np.int64)
        for j in range(c):
            take = (cand[:, j] >= 0) & (count < most) & (sim[:, j] > nearest[:, j])
            chosen[:, j] = take
            count += take
            if take.any():
                nearest[take] = np.maximum(nearest[take], pair[take, j])
        rank = np.where(cand < 0, 2 * c, np.where(chosen, 0, c) + np.arange(c))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(cand, order, 1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((b, most - out.shape[1]), -1, out.dtype)], 1)
        return out

    def _link(self, lay: int, ids: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        nbrs = self.layers[lay]
        most = nbrs.shape[1]
        chosen = self._select(cand, sim, self.p.links)
        wide = np.full((len(ids), most), -1, np.int64)
        wide[:, : chosen.shape[1]] = chosen
        nbrs[ids] = wide
        src, dst = np.repeat(ids, chosen.shape[1]), chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(node), 512):
            nd, fs, ct = node[at : at + 512], first[at : at + 512], count[at : at + 512]
            new = np.full((len(nd), int(ct.max())), -1, np.int64)
            rows = np.repeat(np.arange(len(nd)), ct)
            cols = np.arange(len(rows)) - np.repeat(np.cumsum(ct) - ct, ct)
            new[rows, cols] = src[np.repeat(fs, ct) + cols]
            old = nbrs[nd].astype(np.int64)
            new[(new[:, :, None] == old[:, None, :]).any(2)] = -1
            both = np.concatenate([old, new], 1)
            s = np.einsum("bcd,bd->bc", self.x[np.maximum(both, 0)], self.x[nd])
            s[both < 0] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, : 3 * most]
            both, s = np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)
            crowded = (both >= 0).sum(1) > most
            kept = np.full((len(nd), most), -1, np.int64)
            width = min(most, both.shape[1])
            kept[:, :width] = both[:, :width]
            if crowded.any():
                kept[crowded] = self._select(both[crowded], s[crowded], most)
            nbrs[nd] = kept

    def search_layer(self, q: np.ndarray, start: np.ndarray, beam: int, lay: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes that a beam search from ``start`` reaches for each query: (ids, similarities), best first, -1 where none."""
        x, nbrs, n = self.x, self.layers[lay], len(self.x)
        b = len(q)
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        opened = np.zeros((b, beam), bool)
        visited = np.zeros((b, n + 1), bool)
        visited[:, n] = True  # where -1 points
        rows = np.arange(b)
        new = np.asarray(start, np.int64)
        active = rows
        while len(active):
            new = np.where(visited[active[:, None], new], -1, new)
            # Of equal entries the first stays.
            order = np.sort(new, axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            new = order
            visited[active[:, None], new] = True
            s = np.einsum("bcd,bd->bc", x[np.maximum(new, 0)], q[active])
            s[new < 0] = -np.inf
            all_ids = np.concatenate([ids[active], new], 1)
            all_sims = np.concatenate([sims[active], s], 1)
            all_open = np.concatenate([opened[active], np.zeros(new.shape, bool)], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            sims[active] = np.take_along_axis(all_sims, order, 1)
            opened[active] = np.take_along_axis(all_open, order, 1)
            waiting = ~opened & (ids >= 0)
            active = np.flatnonzero(waiting.any(1))
            if not len(active):
                break
            w = waiting[active]
            pick = np.argsort(~w, axis=1, kind="stable")[:, : self.p.expand]
            real = np.take_along_axis(w, pick, 1)
            opened[active[:, None], pick] |= real
            at = np.where(real, ids[active[:, None], pick], 0)
            new = np.where(real[:, :, None], nbrs[at], -1).reshape(len(active), -1).astype(np.int64)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.broadcast_to(self.entry, (len(q), len(self.entry)))
        for lay in range(len(self.layers) - 1, 0, -1):
            if lay <= int(self.height[self.entry[0]]):
                start, _ = self.search_layer(q, start, 8, lay)
        return self.search_layer(q, start, beam, 0)

    def matches(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every match the beam finds; queries whose beam holds nothing but matches are searched again with a wider one, in the end against all."""
        n, low = len(self.x), np.float32(self.p.threshold - 1e-6)
        todo = np.arange(len(q))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):
            full = []
            for a in range(0, len(todo), self.p.block):
                part = todo[a : a + self.p.block]
                if beam >= n:
                    r, c = np.nonzero(q[part] @ self.x.T >= low)
                    found.append((part[r], c))
                    continue
                ids, sims = self.search(q[part], beam)
                more = sims[:, -1] >= low
                r, c = np.nonzero((sims >= low) & ~more[:, None])
                found.append((part[r], ids[r, c]))
                full.append(part[more])
            todo = np.concatenate(full) if full else todo[:0]
            beam *= 2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def audited(self, q: np.ndarray, seed: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """``matches`` with the beam doubled until sampled queries find ``recall`` of what brute force finds for them, each query counted alike; and the beam.

        ``own`` is each query's own node, or -1; that match counts nothing.
        Queries are drawn until ``audit_rows`` of them have matches, or all are drawn.
        """
        p, n = self.p, len(self.x)
        rng = np.random.Generator(np.random.PCG64(seed))
        drawn = rng.permutation(len(q))
        sample, true = np.zeros(0, np.int64), np.zeros((0, n), bool)
        for k in range(0, len(q), p.block):
            part = drawn[k : k + p.block]
            near = q[part] @ self.x.T >= np.float32(p.threshold)
            if own is not None:
                mine = np.flatnonzero(own[part] >= 0)
                near[mine, own[part[mine]]] = False
            some = np.flatnonzero(near.any(1))[: p.audit_rows - len(sample)]
            sample, true = np.concatenate([sample, part[some]]), np.concatenate([true, near[some]])
            if len(sample) >= p.audit_rows:
                break
        at = np.full(len(q), -1)
        at[sample] = np.arange(len(sample))
        beam = p.beam
        while True:
            a, b = self.matches(q, beam)
            mine = at[a] >= 0
            hit = true[at[a[mine]], b[mine]]
            got = np.bincount(at[a[mine]][hit], minlength=len(sample))
            if not len(sample) or float(np.mean(got / true.sum(1))) >= p.recall or beam >= n:
                return a, b, beam
            beam *= 2


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    x = np.array(pdf["v"].tolist(), np.float32).reshape(len(pdf), -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


#: How far a product of unit vectors in half precision can be from that of the vectors: each is off by 2^-11 at most.
_HALF = 0.0011


def nearest_pivots(q: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` pivots of the largest product with each query. They lie among as many runs of 64 pivots, those of the largest maxima."""
    n, run = len(pivots), 64
    most = min(most, n)
    sims = np.full((len(q), -(-n // run) * run), -np.inf, np.float32)
    np.matmul(q, pivots.T, out=sims[:, :n])
    runs = sims.reshape(len(q), -1, run)
    if runs.shape[1] > most:
        top = np.argpartition(-runs.max(2), most - 1, axis=1)[:, :most]
        near = np.take_along_axis(runs, top[:, :, None], 1).reshape(len(q), -1)
        of = (top[:, :, None] * run + np.arange(run)).reshape(len(q), -1)
    else:
        near, of = sims, np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.take_along_axis(of, np.argpartition(-near, most - 1, axis=1)[:, :most], 1)


class _Groups:
    """Groups of rows; ``label`` is each row's, up to date after ``join``."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        other = a != b
        if other.any():
            forest = spanning_forest(pd.DataFrame({"a": a[other], "b": b[other]}).drop_duplicates())
            to = np.arange(len(self.label))
            to[forest["a"].to_numpy()] = forest["b"].to_numpy()
            self.label = to[self.label]


def cell_links(x: np.ndarray, p: HnswParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure): rows of a cell whose links connect what its pairs connect, as far as half precision tells; the rest, not sure, need a closer look."""
    n, groups = len(x), _Groups(len(x))
    low, sure = np.float32(p.threshold - _HALF), np.float32(p.threshold + _HALF)
    doubt: list[tuple[np.ndarray, np.ndarray]] = []
    if n <= p.whole_rows:
        for k in range(0, n, p.block):
            sims = x[k : k + p.block] @ x[k:].T
            c = np.arange(sims.shape[0])
            sims[c, c] = -np.inf
            cols = np.flatnonzero(sims.max(0) >= low)
            if not len(cols):
                continue
            sims = sims[:, cols]
            hit = sims >= sure
            some = hit.any(0)
            first = hit.argmax(0)
            groups.join(k + first[some], k + cols[some])
            # What else a column meets counts only if its group isn't that of the first.
            mine = groups.label[k : k + len(sims)]
            r, c = np.nonzero(hit & (mine[:, None] != groups.label[k + cols][None, :]))
            groups.join(k + r, k + cols[c])
            r, c = np.nonzero((sims >= low) & ~hit & (groups.label[k : k + len(sims)][:, None] != groups.label[k + cols][None, :]))
            doubt.append((k + r, k + cols[c]))
    else:
        wide = replace(p, threshold=p.threshold - _HALF)
        for k in range(0, n, p.shard_rows):
            g = Graph(x[k : k + p.shard_rows], wide).build()
            own = np.full(n, -1)
            own[k : k + len(g.x)] = np.arange(len(g.x))
            a, b, _ = g.audited(x, p.seed + k, own)
            b = b + k
            near = np.concatenate([np.einsum("nd,nd->n", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= sure
            groups.join(a[near], b[near])
            doubt.append((a[~near], b[~near]))
    child = np.flatnonzero(groups.label != np.arange(n))
    da, db = (np.concatenate([d[i] for d in doubt] or [np.zeros(0, np.int64)]) for i in (0, 1))
    open_ = groups.label[da] != groups.label[db]
    da, db = da[open_], db[open_]
    return np.r_[child, da], np.r_[groups.label[child], db], np.r_[np.ones(len(child), bool), np.zeros(len(da), bool)]


def _vectors(batch: pa.RecordBatch | pa.Table, name: str, dim: int) -> np.ndarray:
    """Unit vectors of a column of arrays that all have ``dim`` entries."""
    x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))


def _sampled(keyed: DataFrame, sizes: list, most: int, seed: int, limit_mb: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each (length, vectors, wanted) of ``sizes`` (ids, unit vectors) of a sample by hash."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, n, want in sizes:
        want = max(1, min(want, most, (limit_mb << 20) // (4 * dim)))
        order = F.xxhash64("h", F.lit(seed))
        share = min(1.0, (want + 6 * want**0.5 + 10) / n)
        rows = keyed.filter((F.col("dim") == dim) & (F.abs(order % 1_000_003) < math.ceil(share * 1_000_003))).select(order.alias("o"), "h", "v").collect()  # about ``want``, which is bounded
        rows = sorted(rows, key=lambda r: (r["o"], r["h"]))[:want]
        out[dim] = np.array([r["h"] for r in rows], np.int64), _unit(pd.DataFrame({"v": [r["v"] for r in rows]}))
    return out


def near_pairs(contents: DataFrame, p: HnswParams) -> DataFrame:
    """Edges (a, b) that connect what the pairs of at least ``threshold`` connect, for distinct vectors (h, v), as far as they meet in a cell. Vectors of each length have cells of their own."""
    spark = contents.sparkSession
    keyed = contents.select("h", "v", F.size("v").alias("dim"))
    large = keyed.groupBy("dim").count().filter(F.col("count") > p.route_from).collect()  # lengths of many vectors each
    pivots = spark.sparkContext.broadcast({d: x for d, (_, x) in _sampled(keyed, [(r[0], r[1], -(-r[1] // p.pivot_rows)) for r in large], p.pivots, p.seed, p.pivot_mb).items()})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                x, at = _vectors(part, "v", dim), pivots.value.get(dim)
                h, half = part.column("h").to_numpy(), x.astype(np.float16)
                step = max(1, min(512, 4096 // p.cells))
                for k in range(0, len(x), step):
                    cells = np.zeros((len(x[k : k + step]), 1), np.int64) if at is None else nearest_pivots(x[k : k + step], at, p.cells)
                    c = cells.shape[1]
                    data = np.repeat(half[k : k + step], c, axis=0)
                    packed = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * (2 * dim)), pa.py_buffer(np.ascontiguousarray(data))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), dim, np.int32)), pa.array(cells.ravel().astype(np.int32)), pa.array(np.repeat(h[k : k + step], c)), packed], ["dim", "cell", "h", "x"])

    def link(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(table.num_rows, -1).astype(np.float32)
        h = table.column("h").to_numpy()
        order = np.argsort(h)
        a, b, sure = cell_links(np.ascontiguousarray(x[order]), p)
        return pa.table({"a": h[order][a], "b": h[order][b], "sure": sure})

    routed = keyed.mapInArrow(route, "dim int, cell int, h long, x binary")
    found = materialize(routed.groupBy("dim", "cell").applyInArrow(link, "a long, b long, sure boolean"), "vector-links")
    sure, doubt = found.filter("sure").select("a", "b"), found.filter("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not found.filter("not sure").limit(1).count():
        sure._portolan_path = found._portolan_path
        return sure
    ends = doubt.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    vectors = materialize(keyed.join(ends, "h", "left_semi"), "vector-doubts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                ok = np.einsum("nd,nd->n", _vectors(part, "va", dim), _vectors(part, "vb", dim), dtype=np.float64) >= p.threshold - 1e-7
                yield part.select(["a", "b"]).filter(pa.array(ok))

    pairs = doubt.join(vectors.select(F.col("h").alias("a"), F.col("v").alias("va"), "dim"), "a").join(vectors.select(F.col("h").alias("b"), F.col("v").alias("vb")), "b")
    near = materialize(sure.unionAll(pairs.select("a", "b", "va", "vb", "dim").mapInArrow(judge, "a long, b long")), "vector-edges")
    discard(vectors)
    discard(found)
    return near


def true_pairs(contents: DataFrame, p: HnswParams) -> DataFrame:
    """(a, b): what brute force over all vectors finds for ``audit_queries`` of each length that was cut into cells."""
    keyed = contents.select("h", "v", F.size("v").alias("dim"))
    large = keyed.groupBy("dim").count().filter(F.col("count") > p.route_from).collect()
    asked = contents.sparkSession.sparkContext.broadcast(_sampled(keyed, [(r[0], r[1], p.audit_queries) for r in large], p.audit_queries, p.seed + 1, p.pivot_mb))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                if dim not in asked.value:
                    continue
                names, q = asked.value[dim]
                x, h = _vectors(part, "v", dim), part.column("h").to_numpy()
                r, c = np.nonzero(x @ q.T >= np.float32(p.threshold))
                other = h[r] != names[c]
                yield pa.RecordBatch.from_arrays([pa.array(names[c][other]), pa.array(h[r][other])], ["a", "b"])

    return keyed.mapInArrow(compare, "a long, b long")


def measured_recall(truth: DataFrame, groups: DataFrame) -> float:
    """The share of its true pairs that an audited vector is in one group with, on average; 1 if there are none."""
    ga = groups.select(F.col("node").alias("a"), F.col("component").alias("ga"))
    gb = groups.select(F.col("node").alias("b"), F.col("component").alias("gb"))
    found = truth.join(ga, "a", "left").join(gb, "b", "left").groupBy("a").agg(F.avg(F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)).cast("int")).alias("r"))
    got = found.agg(F.avg("r")).first()[0]
    return 1.0 if got is None else got


def linked_groups(contents: DataFrame, p: HnswParams) -> DataFrame:
    """(node, component) of near-duplicates; cells for each vector are doubled until recall is reached, or there are no more."""
    truth = None
    while True:
        edges = near_pairs(contents, p)
        groups = materialize(connected_components(edges, "a", "b"), "vector-components")
        discard(edges)
        truth = materialize(true_pairs(contents, p), "vector-audit") if truth is None else truth
        if p.cells >= p.pivots or measured_recall(truth, groups) >= p.recall:
            discard(truth)
            return groups
        discard(groups)
        p = replace(p, cells=2 * p.cells)


def near_duplicate_vectors(vectors: DataFrame, params: HnswParams = HnswParams(), vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vectors`` without the vectors themselves, with group_id, the least id among a vector and its near-duplicates, and kept.

    One row of each group is kept: that of the least id; of rows that repeat
    it, each one. Equal vectors are copies and are searched for once; vectors
    of different lengths resemble each other in nothing. A vector that is
    null, empty or zero, or that has a null, NaN or infinite entry resembles
    nothing: its group_id is its own id. A null id comes after all others. Columns called group_id or kept are
    replaced, others passed on; an empty table gives an empty table.
    """
    p = params
    ship_code(vectors.sparkSession)
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists(v, lambda x: F.abs(x) > 1e-12)
    keyed = vectors.select(F.xxhash64(v).alias("h"), F.col(f"`{vec_id}`").alias("k"), F.when(sound, v).alias("v"))
    usable = keyed.filter("v is not null")
    contents = materialize(usable.withColumn("v", F.col("v").cast("array<float>")).groupBy("h").agg(F.first("v").alias("v"), F.min("k").alias("k")), "vector-contents")
    groups = linked_groups(contents, p)
    named = contents.select("h", "k").join(groups.select(F.col("node").alias("h"), F.col("component").alias("g")), "h", "left").withColumn("g", F.coalesce("g", "h"))
    least = named.groupBy("g").agg(F.min("k").alias("group_id"))
    h, g = private_name(vectors, "__h"), private_name(vectors, "__g")
    of = materialize(named.join(least, "g").select(F.col("h").alias(h), F.col("group_id").alias(g)), "vector-groups")
    discard(contents)
    discard(groups)
    names = [c for c in vectors.columns if c not in (vector, "group_id", "kept")]
    left = vectors.select(*[F.col(f"`{c}`") for c in names], F.when(sound, F.xxhash64(v)).alias(h))
    joined = left.join(of, h, "left").withColumn("group_id", F.coalesce(g, F.col(f"`{vec_id}`")))
    return joined.select(*[F.col(f"`{c}`") for c in names], "group_id", F.col("group_id").eqNullSafe(F.col(f"`{vec_id}`")).alias("kept"))
