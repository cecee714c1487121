"""Near-duplicate vectors through hierarchical navigable small-world graphs, one graph per shard.

Equal vectors are one node.  Nodes are stored once in the shared folder and dealt to shards; a shard's task builds the graph of
its own nodes and then reads all nodes from the folder as queries, a batch at a time, so queries are not shuffled.  Searches run
in lock step over a block of queries, so every step is a few array operations.  A search descends the levels, fills a beam
on the lowest one, and then follows links from every node found within the threshold until no new one turns up.  Before
that, an audit compares queries drawn from all nodes with an exact scan of the shard; while it misses links, the beam
widens.  Cosines are verified in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_keys
from .components import connected_components
from .simhash import _forest

THRESHOLD = 0.9
#: Nodes a shard may hold (its vectors and links stay in one task's memory) and the least number of shards.
SHARD_NODES, LEAST_SHARDS = 262_144, 6
LINKS, BUILD_BEAM, BEAM = 12, 32, 16
BLOCK = 1024
#: Queries drawn for a shard's audit, the recall it asks for, and the draws they are chosen from.
AUDITED, RECALL, DRAWS = 1024, 0.99, 1 << 30


class Graph:
    """The graph of one shard: unit vectors x (float32) and neighbour lists per level, -1 where there is none."""

    def __init__(self, unit: np.ndarray, seed: int = 1):
        n = len(unit)
        self.x = np.ascontiguousarray(unit, np.float32)
        rng = np.random.default_rng(seed)
        # Order and levels come from a fixed stream, so a repeated attempt builds the same graph.
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        self.top = int(level.max()) if n else 0
        self.links = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(order[0]) if n else -1
        at = 1
        while at < n:
            size = min(max(16, at), BLOCK, n - at)
            self._insert(order[at : at + size], level)
            at += size

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.x[new]
        start = np.full((len(new), 1), self.entry, np.int64)
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        for k in range(self.top, -1, -1):
            mine = np.flatnonzero(level[new] >= k)
            if not len(mine):
                start = self.search(q, start, k, 1)[0][:, :1]
                continue
            ids, sims = self.search(q, start, k, BUILD_BEAM)
            start = ids[:, :1]
            # Nodes inserted together also see each other.
            fellow = np.argsort(-inner[np.ix_(mine, mine)], axis=1)[:, : min(LINKS, len(mine) - 1)]
            other = new[mine][fellow] if fellow.size else np.zeros((len(mine), 0), np.int64)
            both = np.hstack([ids[mine], other])
            score = np.hstack([sims[mine], np.take_along_axis(inner[np.ix_(mine, mine)], fellow, 1) if fellow.size else np.zeros((len(mine), 0))])
            self._connect(new[mine], both, score, k)

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        width = self.links[k].shape[1]
        chosen = self._diverse(ids, sims, LINKS)
        self.links[k][nodes, : chosen.shape[1]] = chosen
        src = np.repeat(nodes, chosen.shape[1])
        dst = chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first = np.unique(dst, return_index=True)
        bounds = np.r_[first, len(dst)]
        most = int(np.diff(bounds).max()) if len(targets) else 0
        added = np.full((len(targets), most), -1, np.int64)
        row = np.repeat(np.arange(len(targets)), np.diff(bounds))
        added[row, np.arange(len(dst)) - first[row]] = src
        merged = np.hstack([self.links[k][targets].astype(np.int64), added])
        for low in range(0, len(targets), BLOCK):
            t, m = targets[low : low + BLOCK], merged[low : low + BLOCK]
            sim = np.where(m >= 0, np.einsum("qd,qmd->qm", self.x[t], self.x[np.maximum(m, 0)]), -3)
            kept = self._diverse(m, sim, width)
            self.links[k][t] = -1
            self.links[k][t, : kept.shape[1]] = kept

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """At most `most` neighbours: first those nearer to the node than to one already taken, then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        double = np.zeros(ids.shape, bool)
        srt = np.argsort(ids, axis=1, kind="stable")
        s = np.take_along_axis(ids, srt, 1)
        np.put_along_axis(double, srt[:, 1:], s[:, 1:] == s[:, :-1], 1)
        valid = (ids >= 0) & ~double
        if ids.shape[1] > 4 * most:
            ids, sims, valid = ids[:, : 4 * most], sims[:, : 4 * most], valid[:, : 4 * most]
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("qad,qbd->qab", v, v)
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            close = ((between[:, j] > sims[:, j, None]) & taken).any(1)
            taken[:, j] = valid[:, j] & ~close & (taken.sum(1) < most)
        rank = np.where(taken, 0, np.where(valid, 1, 2))
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(rank, pick, 1) < 2, np.take_along_axis(ids, pick, 1), -1)

    def search(self, q: np.ndarray, start: np.ndarray, k: int, beam: int, visited: np.ndarray | None = None):
        """Lock-step best-first search of level k: (ids, similarities) by falling similarity, -1 and -2 where none."""
        n, links = len(q), self.links[k]
        seen = np.zeros((n, len(self.x)), bool) if visited is None else visited
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0, np.float32)
        done = np.ones((n, beam), bool)
        w = min(start.shape[1], beam)
        ids[:, :w], done[:, :w] = start[:, :w], False
        sims[:, :w] = np.einsum("qd,qmd->qm", q, self.x[start[:, :w]])
        np.put_along_axis(seen, start, True, 1)
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], -3, sims[live])
            best = open_.argmax(1)
            on = open_[np.arange(len(live)), best] > -2
            live, best = live[on], best[on]
            if not len(live):
                break
            node = ids[live, best]
            done[live, best] = True
            near = links[node].astype(np.int64)
            fresh = (near >= 0) & ~np.take_along_axis(seen[live], np.maximum(near, 0), 1) if len(live) < n // 4 else (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            found = near[r, c]
            seen[live[r], found] = True
            s = np.full(near.shape, -3.0, np.float32)
            s[r, c] = np.einsum("id,id->i", q[live[r]], self.x[found])
            all_s = np.hstack([sims[live], s])
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.where(sims[live] > -2, np.take_along_axis(np.hstack([ids[live], near]), top, 1), -1)
            done[live] = np.take_along_axis(np.hstack([done[live], ~fresh]), top, 1) | (sims[live] <= -2)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with similarity of at least threshold that the search meets."""
        start = np.full((len(q), 1), self.entry, np.int64)
        for k in range(self.top, 0, -1):
            start = self.search(q, start, k, 1)[0][:, :1]
        seen = np.zeros((len(q), len(self.x)), bool)
        ids, sims = self.search(q, start, 0, beam, seen)
        row, col = np.nonzero(sims >= threshold)
        found = [(row, ids[row, col])]
        known = np.zeros_like(seen)  # what the beam passed over is met again by the links of what it kept
        known[found[0]] = True
        while len(found[-1][0]):
            fr, fn = found[-1]
            hits_r, hits_n = [], []
            for low in range(0, len(fr), 65_536):
                near = self.links[0][fn[low : low + 65_536]].astype(np.int64)
                r = np.repeat(fr[low : low + 65_536], near.shape[1])
                near = near.ravel()
                ok = near >= 0
                r, near = r[ok], near[ok]
                ok = ~known[r, near]
                r, near = r[ok], near[ok]
                ok = np.einsum("id,id->i", q[r], self.x[near]) >= threshold
                r, near = r[ok], near[ok]
                key = np.unique(r * np.int64(len(self.x)) + near)
                r, near = key // len(self.x), key % len(self.x)
                known[r, near] = True
                hits_r.append(r), hits_n.append(near)
            found.append((np.concatenate(hits_r), np.concatenate(hits_n)))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def audited_beam(graph: Graph, q: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[int, int, int]:
    """(beam, links met, links there are): the beam is doubled until a search for q meets enough of the links that an exact
    scan finds.  own: the node each query is itself, or -1; that one is no link."""
    there = 0
    for low in range(0, len(q), 64):
        hit = q[low : low + 64] @ graph.x.T >= threshold
        mine = np.flatnonzero(own[low : low + 64] >= 0)
        hit[mine, own[low + mine]] = False
        there += int(hit.sum())
    while True:
        met, step = 0, _block(graph)
        for low in range(0, len(q), step):
            row, node = graph.within(q[low : low + step], threshold, beam)
            met += int((node != own[row + low]).sum())
        if met >= RECALL * there or beam >= len(graph.x):
            return beam, met, there
        beam *= 2


def _block(graph: Graph) -> int:
    """Queries searched together: a bound of the memory for what they have seen."""
    return max(16, min(BLOCK, 32_000_000 // max(len(graph.x), 1)))


def _stored(folder: str, draws: int | None = None):
    """Batches (node, weight, vector) of the stored nodes; with draws those whose draw is less."""
    system, path = pafs.FileSystem.from_uri(folder)
    table = ds.dataset(path, filesystem=system, format="parquet")
    where = None if draws is None else ds.field("draw") < draws
    for batch in table.to_batches(columns=["node", "weight", "vector"], filter=where, batch_size=4 * BLOCK, batch_readahead=1, fragment_readahead=1, use_threads=False):
        if batch.num_rows:
            yield batch


def _by_length(batch: pa.RecordBatch):
    """(positions, vectors) of the rows of each vector length."""
    vectors = batch.column("vector")
    size = pc.binary_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        some = vectors if len(at) == len(size) else vectors.take(pa.array(at))
        yield at, np.frombuffer(b"".join(some.to_pylist()), np.float64).reshape(len(at), -1)


class _Part:
    """The vectors of one length of a shard, with their graph and the beam its audit asks for."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, exact: np.ndarray):
        order = np.argsort(node)
        self.node, self.weight, self.exact = node[order], weight[order], exact[order]
        self.graph, self.beam, self.audit = Graph(self.exact), BEAM, (0, 0)

    def own(self, node: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return np.where(self.node[at] == node, at, -1)

    def links(self, node: np.ndarray, q: np.ndarray, threshold: float):
        """(node, number of links) and (node, node) of a forest of the links of some queries."""
        step = _block(self.graph)
        for low in range(0, len(q), step):
            some, names = q[low : low + step], node[low : low + step]
            # Single precision is off by less than 1e-5; doubles decide.
            row, met = self.graph.within(some.astype(np.float32), threshold - 1e-5, self.beam)
            sure = np.concatenate([np.einsum("id,id->i", some[row[i : i + 262_144]], self.exact[met[i : i + 262_144]]) >= threshold for i in range(0, len(row), 262_144)] or [np.zeros(0, bool)])
            row, met = row[sure], met[sure]
            other = names[row] != self.node[met]
            row, met = row[other], met[other]
            if len(row):
                n = np.bincount(row, weights=self.weight[met], minlength=len(some)).astype(np.int64)
                hit = np.flatnonzero(n)
                yield (names[hit], n[hit]), _forest(names[row], self.node[met])


def _search_shards(folder: str, draws: int, threshold: float):
    """Rows (shard, node, weight, vector) of whole shards -> links counted (kind 0), a forest of links (1), audits (2)."""

    def rows(a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    def search(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        parts = {v.shape[1]: _Part(node[at], weight[at], v) for at, v in _by_length(table)}
        sample: dict[int, list] = {}
        for batch in _stored(folder, draws):
            for at, v in _by_length(batch):
                sample.setdefault(v.shape[1], []).append((batch.column("node").to_numpy()[at], v))
        for n, part in parts.items():
            if n in sample:
                names, q = (np.concatenate(x) for x in zip(*sample[n], strict=True))
                part.beam, met, there = audited_beam(part.graph, q.astype(np.float32), part.own(names), threshold)
                yield rows([met], [there], 2)
        for batch in _stored(folder):
            names = batch.column("node").to_numpy()
            for at, v in _by_length(batch):
                if v.shape[1] in parts:
                    for counted, forest in parts[v.shape[1]].links(names[at], v, threshold):
                        yield rows(*counted, 0)
                        yield rows(*forest, 1)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True) if len(shard) else ():
                if held and held[0].column("shard")[0].as_py() != shard[low]:
                    yield from search(held)
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from search(held)

    return run


def _unit(batches):
    for b in batches:
        out = []
        for x in b.column("v").to_pylist():
            x = np.array(x, np.float64)
            x = x / np.abs(x).max()
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("node", "one", "two", "weight", "low", "draw")] + [pa.array(out, pa.binary())], [*"node one two weight low draw vector".split()])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, shard_nodes: int = SHARD_NODES, shards: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are their own
    component; vectors of different length never link; equal vectors link with each other.  A row without vec_id counts
    as a link of others but names no component (its own is that of its links, or null).  Rows that repeat a vec_id count
    each.  An empty table gives no rows; other columns are not read.
    """
    return search(vectors, id_col, column, threshold, shard_nodes, shards)[0]


def search(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, shard_nodes: int = SHARD_NODES, shards: int = 0) -> tuple[DataFrame, tuple[int, int]]:
    """near_duplicates() and what its audits saw: (links met, links there are) of the queries drawn, over all shards."""
    spark = vectors.sparkSession
    v = F.col(f"`{column}`").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(good, v).alias("v"))
    # Two hashes of 64 bits stand for a vector: that two of 10**12 different vectors share both has a probability of 2e-15.
    one, two = F.xxhash64("v"), F.xxhash64(F.lit("second"), "v")
    rows = rows.select("vec_id", *[F.when(F.col("v").isNotNull(), h).alias(c) for c, h in (("one", one), ("two", two))], "v")
    grouped = rows.filter("v is not null").groupBy("one", "two").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    grouped = grouped.withColumns({"node": F.monotonically_increasing_id(), "draw": F.pmod("two", F.lit(DRAWS)).cast("int")})
    nodes = materialize(grouped.mapInArrow(_unit, "node long, one long, two long, weight long, low long, draw int, vector binary"), "nodes")
    n = nodes.count()
    count = shards or max(LEAST_SHARDS, -(-n // shard_nodes))
    place = F.get(F.array(*[F.lit(k) for k in spread_keys(spark, count)]), F.col("shard"))
    own = nodes.select(F.pmod(F.col("one"), F.lit(count)).cast("int").alias("shard"), "node", "weight", "vector")
    dealt = own.repartition(count, place).sortWithinPartitions("shard")
    drawn = -(-AUDITED * DRAWS // max(n, 1))  # about AUDITED queries, all of them if there are fewer
    found = materialize(dealt.mapInArrow(_search_shards(nodes.stored_at, drawn, threshold), "a long, b long, kind int"), "found")
    roots = connected_components(found.filter("kind = 1").select("a", "b"))
    linked = roots.join(nodes.select("node", "low"), "node")
    named = linked.groupBy("root").agg(F.min("low").alias("component"))
    moved = linked.join(named, "root").select("node", "component")
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    known = nodes.select("node", "one", "two", "weight", "low").join(moved, "node", "left").join(counts, "node", "left")
    known = known.select("one", "two", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "low").alias("component"))
    joined = rows.select("vec_id", "one", "two").join(known, ["one", "two"], "left")
    component = F.when(F.col("one").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    audit = found.filter("kind = 2").agg(F.sum("a"), F.sum("b")).first()
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), (audit[0] or 0, audit[1] or 0)
