"""Embedding near-dedup by a robust-pruned flat graph.

Equal vectors are one node, so copies cost nothing. Centroids fitted on a
bounded sample cut the nodes into overlapping shards: each node goes to its
OVERLAP nearest centroids. Each shard builds a graph by robust
pruning: from a node's nearest candidates the nearest is kept and those are
dropped that are much nearer to it than to the node, again and again; a few
edges across the node's range keep dense groups in one piece, and a piece of
the graph that nothing leads to has a medoid of its own. The adjacency lists that a node gets in its shards are united, and made mutual.

Every node is a query in its shards. A greedy beam search starts at the shard's
medoids; whatever it meets in range is then expanded along the graph until
nothing new is in range. Nodes that the walks have put in one group are then
verified with each other by cosine in double precision, so that what a walk
missed in a dense group is counted, too; a pair counts in the least shard that
both ends share. What leaves a task is a count for each node and a spanning
forest of its links. A shard over MAX_SHARD nodes is dealt as pairs of its parts.

The recall is audited: a bounded sample of nodes is compared with all nodes.
If it is under LEAST_RECALL, the overlap and the beam are widened and the
search is run again; after the last try all pairs are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, components, cut, maybe_broadcast
from trackloom.llm.simhash import Forest


@dataclass(frozen=True)
class Settings:
    """Bounds and widths; sample, max_clusters and audit bound what the driver holds."""

    threshold: float = 0.95
    shard: int = 1000
    max_shard: int = 4000
    max_clusters: int = 2048
    sample: int = 20_000
    overlap: int = 2
    candidates: int = 48
    degree: int = 16
    across: int = 6
    alpha: float = 1.2
    beam: int = 48
    medoids: int = 8
    audit: int = 256
    least_recall: float = 0.97
    tries: int = 3


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k directions by spherical k-means, started from spread rows; x has rows of length one."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], c)
    return c


def prune(x: np.ndarray, s: Settings) -> np.ndarray:
    """Robust-pruned out-edges of each row of x (rows of length one), -1 where there are fewer.

    A row with more rows in range than pruning leaves gets `across` edges to
    any of those, so that a dense group does not fall into islands.
    """
    n = len(x)
    k = min(s.candidates, n - 1)
    out = np.full((n, s.degree + s.across), -1, np.int64)
    rng = np.random.default_rng(11)
    if k < 1:
        return out
    small = x.astype(np.float32)
    for a in range(0, n, 512):
        own = small[a : a + 512]
        sims = own @ small.T
        sims[np.arange(len(own)), np.arange(a, a + len(own))] = -np.inf
        cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        far, alive, rows = 1 - sim, np.ones(cand.shape, bool), np.arange(len(own))
        points = small[cand]
        for r in range(s.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            best = cand[rows, pick]
            out[a : a + len(own), r] = np.where(some, best, -1)
            alive[rows, pick] = False
            between = 1 - np.einsum("ijk,ik->ij", points, small[best])
            alive &= s.alpha * between > far
        near = sims >= s.threshold
        for i in np.flatnonzero(near.sum(axis=1) > 4).tolist():
            some = np.flatnonzero(near[i])
            out[a + i, s.degree :][: min(s.across, len(some))] = rng.choice(some, min(s.across, len(some)), replace=False)
    return out


def _adjacency(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mutual edges as a padded table, at most 64 of a node."""
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    sizes = np.bincount(a, minlength=n)
    at = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table = np.full((n, max(1, min(64, int(sizes.max(initial=1))))), -1, np.int64)
    inside = at < table.shape[1]
    table[a[inside], at[inside]] = b[inside]
    return table


def _medoids(x: np.ndarray, k: int) -> np.ndarray:
    """The node nearest to the mean, and nodes far from those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.array(sorted(set(chosen)))


def _starts(x: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """The medoids of all nodes, and the one of each piece into which the graph falls, so that no piece is out of reach."""
    forest = Forest(len(x))
    a, column = np.nonzero(table >= 0)
    forest.join(a, table[a, column])
    root = forest.find(np.arange(len(x)))
    order = np.argsort(root, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(root[order]) != 0]))
    pieces = np.split(order, begins[1:])
    own = [int(p[(x[p] @ x[p].mean(axis=0)).argmax()]) for p in pieces] if len(pieces) > 1 else []
    return np.unique(np.concatenate([_medoids(x, k), np.array(own, np.int64)]))


def search(x: np.ndarray, table: np.ndarray, q: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) in range: beam search from the medoids, then expansion in range."""
    n, starts, width = len(x), _starts(x, table, s.medoids), 4
    single = x.astype(np.float32)
    found_q, found_n = [], []
    low = np.float32(s.threshold - 1e-5)
    for a in range(0, len(q), 1024):
        query = q[a : a + 1024].astype(np.float32)
        m = len(query)
        seen, hit = np.zeros((m, n), bool), np.zeros((m, n), bool)
        ids = np.tile(starts, (m, 1))
        sims = query @ single[starts].T
        seen[:, starts] = True
        np.put_along_axis(hit, ids, sims >= low, 1)
        if len(starts) > s.beam:
            best = np.argpartition(-sims, s.beam - 1, axis=1)[:, : s.beam]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        done = np.zeros(ids.shape, bool)
        active = np.arange(m)
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            w = min(width, open_sims.shape[1])
            pick = np.argpartition(-open_sims, w - 1, axis=1)[:, :w]
            live = np.isfinite(np.take_along_axis(open_sims, pick, 1))
            active, pick, live = active[live.any(axis=1)], pick[live.any(axis=1)], live[live.any(axis=1)]
            if not len(active):
                break
            done[active[:, None], pick] = True
            nodes = np.where(live, ids[active[:, None], pick], -1)
            near = np.where(nodes[:, :, None] >= 0, table[nodes], -1).reshape(len(active), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[active[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(fresh)
            new = near[row, col]
            value = np.full(near.shape, -np.inf, np.float32)
            value[row, col] = np.einsum("ij,ij->i", query[active[row]], single[new])
            seen[active[row], new] = True
            hit[active[row], new] = value[row, col] >= low
            all_sims = np.concatenate([sims[active], value], axis=1)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            keep = min(s.beam, all_sims.shape[1])
            best = np.argpartition(-all_sims, keep - 1, axis=1)[:, :keep]
            if ids.shape[1] < keep:
                grow = keep - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)))
                sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, grow)), constant_values=True)
            ids[active, :keep] = np.take_along_axis(all_ids, best, 1)
            sims[active, :keep] = np.take_along_axis(all_sims, best, 1)
            done[active, :keep] = np.take_along_axis(all_done, best, 1)
        row, node = np.nonzero(hit)
        while len(row):
            nxt_row, nxt_node = [], []
            for b in range(0, len(row), 20_000):
                r = np.repeat(row[b : b + 20_000], table.shape[1])
                t = table[node[b : b + 20_000]].ravel()
                r, t = r[t >= 0], t[t >= 0]
                new = ~seen[r, t]
                code = np.unique(r[new] * n + t[new])
                r, t = code // n, code % n
                seen[r, t] = True
                near = np.einsum("ij,ij->i", query[r], single[t]) >= low
                hit[r[near], t[near]] = True
                nxt_row.append(r[near])
                nxt_node.append(t[near])
            row, node = np.concatenate(nxt_row), np.concatenate(nxt_node)
        row, node = np.nonzero(hit)
        for b in range(0, len(row), 200_000):
            r, t = row[b : b + 200_000], node[b : b + 200_000]
            true = np.einsum("ij,ij->i", q[a + r], x[t]) >= s.threshold
            found_q.append(a + r[true])
            found_n.append(t[true])
    return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (np.zeros(0, int), np.zeros(0, int))


def nodes_of(vectors: DataFrame, id_col: str, emb: str) -> tuple[DataFrame, DataFrame]:
    """(rows(id, k1, k2, valid), nodes(rid, k1, k2, dim, least, copies, emb)): one node for each valid distinct vector."""
    v = F.col("emb")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(emb).alias("emb"))
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    valid = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda e: e != 0)
    rows = rows.select("id", "emb", F.xxhash64("emb").alias("k1"), F.xxhash64(F.lit(1), "emb").alias("k2"), F.coalesce(valid, F.lit(False)).alias("valid"))
    nodes = rows.where("valid").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("emb").alias("emb"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("rid"), "k1", "k2", F.size("emb").alias("dim"), "least", "copies", "emb")
    return rows.drop("emb"), cut(nodes)


def _assign(nodes: DataFrame, centers: dict[int, np.ndarray], s: Settings) -> DataFrame:
    """(rid, copies, emb, own, cluster): each node under its nearest centroids, own listing all of them."""
    shared = nodes.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                part, c = b.take(at), shared.value[int(d)]
                k = min(s.overlap, len(c))
                best = np.argpartition(-(unit(_matrix(part.column("emb"))) @ c.T), k - 1, axis=1)[:, :k]
                # the dimension keeps clusters of different dimensions apart
                own = np.sort(best, axis=1).astype(np.int64) + (int(d) << 32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), k).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in ("rid", "copies", "emb")] + [lists], ["rid", "copies", "emb", "own"])

    rows = nodes.select("rid", "copies", "emb", "dim")
    kind = dict(rows.dtypes)["emb"]
    return rows.mapInArrow(run, f"rid long, copies long, emb {kind}, own array<long>").withColumn("cluster", F.explode("own"))


def _fit(nodes: DataFrame, s: Settings) -> dict[int, np.ndarray]:
    """Centroids for each dimension, from a bounded sample of nodes."""
    out = {}
    for r in nodes.groupBy("dim").count().collect():
        picked = nodes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("k1"), "k1").limit(s.sample).select("emb").toArrow()
        k = max(1, min(s.max_clusters, round(r["count"] / s.shard)))
        out[r["dim"]] = centroids(unit(_matrix(picked["emb"])), k)
    return out


def link(nodes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(counts(rid, links), edges(a, b)): links of each node weighted by copies, and a spanning forest."""
    assigned = cut(_assign(nodes, _fit(nodes, s), s))
    parts = assigned.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / s.max_shard).cast("int").alias("parts"))
    dealt = assigned.join(maybe_broadcast(cut(parts)), "cluster").withColumn("home", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        rid = t.column("rid").to_numpy()
        to = prune(unit(_matrix(t.column("emb"))), s)
        return pa.table({"rid": rid, "near": pa.array([rid[r[r >= 0]] for r in to], pa.list_(pa.int64()))})

    graph = dealt.groupBy("cluster", "home").applyInArrow(build, "rid long, near array<long>")
    united = graph.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # Parts of a cluster meet in pairs, so that a task holds two parts at most.
    asked = dealt.join(united, "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.withColumns({"lo": F.least("home", "other"), "hi": F.greatest("home", "other")}).drop("other", "parts")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        cluster, lo, hi = (k.as_py() for k in key)
        t = t.sort_by("rid")
        rid, copies, home = (t.column(c).to_numpy() for c in ("rid", "copies", "home"))
        x, own = unit(_matrix(t.column("emb"))), np.array(t.column("own").to_pylist())
        near = t.column("near").combine_chunks()
        forest = Forest(len(rid))
        for nodes_of, asks in {(lo, hi), (hi, lo)}:
            at, queries = np.flatnonzero(home == nodes_of), np.flatnonzero(home == asks)
            if not len(at) or not len(queries):
                continue
            lists = near.take(pa.array(at))
            ends = lists.value_lengths().to_numpy()
            a, b = np.repeat(np.arange(len(at)), ends), lists.flatten().to_numpy()
            place = np.minimum(np.searchsorted(rid[at], b), len(at) - 1)
            here = rid[at][place] == b
            q, n = search(x[at], _adjacency(len(at), a[here], place[here]), x[queries], s)
            forest.join(queries[q], at[n])
        root, counts = forest.find(np.arange(len(rid))), np.zeros(len(rid), np.int64)
        for q, n in _inside(x, root, s.threshold):
            if lo != hi:
                across = home[q] != home[n]
                q, n = q[across], n[across]
            # A pair that shares several clusters counts in the least of them.
            shared = np.zeros(len(q), np.int64) + (1 << 62)
            for i in range(own.shape[1]):
                both = (own[q, i][:, None] == own[n]).any(axis=1)
                shared = np.minimum(shared, np.where(both, own[q, i], 1 << 62))
            mine = shared == cluster
            np.add.at(counts, q[mine], copies[n[mine]])
        keep = (counts > 0) | (root != np.arange(len(rid)))
        return pa.table({"rid": rid[keep], "links": counts[keep], "root": rid[root[keep]]})

    found = cut(asked.groupBy("cluster", "lo", "hi").applyInArrow(run, "rid long, links long, root long"))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    return counts, found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")).distinct()


def _inside(x: np.ndarray, root: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (q, n) in range, both ways, of rows with one root, in blocks."""
    order = np.argsort(root, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(root[order]) != 0])) if len(order) else order
    for members in np.split(order, begins[1:]) if len(order) else []:
        if len(members) < 2:
            continue
        for i in range(0, len(members), 256):
            a, b = np.nonzero(x[members[i : i + 256]] @ x[members].T >= threshold)
            a, b = members[i + a], members[b]
            yield a[a != b], b[a != b]


def link_exact(nodes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """What link() returns, from all pairs of nodes of one dimension: blocks of nodes are dealt as pairs of blocks."""
    sizes = cut(nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / s.max_shard).cast("int").alias("parts")))
    dealt = nodes.select("rid", "copies", "emb", "dim").join(maybe_broadcast(sizes), "dim").withColumn("home", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("rid", "copies", "emb", "dim", "home", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rid, copies, home = (t.column(c).to_numpy() for c in ("rid", "copies", "home"))
        x, lo, hi = unit(_matrix(t.column("emb"))), key[1].as_py(), key[2].as_py()
        one, two = np.flatnonzero(home == lo), np.flatnonzero(home == hi)
        counts, forest = np.zeros(len(rid), np.int64), Forest(len(rid))
        for i in range(0, len(one), 256):
            a, b = np.nonzero(x[one[i : i + 256]] @ x[two].T >= s.threshold)
            a, b = one[i + a], two[b]
            a, b = a[a != b], b[a != b]
            np.add.at(counts, a, copies[b])
            if lo != hi:
                np.add.at(counts, b, copies[a])
            forest.join(a, b)
        root = forest.find(np.arange(len(rid)))
        keep = (counts > 0) | (root != np.arange(len(rid)))
        return pa.table({"rid": rid[keep], "links": counts[keep], "root": rid[root[keep]]})

    found = cut(dealt.groupBy("dim", "lo", "hi").applyInArrow(run, "rid long, links long, root long"))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    return counts, found.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")).distinct()


#: Linked nodes that an audit should rest on, and how often a sample with fewer is made eight times as large.
LINKED, GROWS = 30, 2


def audit(nodes: DataFrame, counts: DataFrame, s: Settings) -> float:
    """Mean over the linked nodes of a bounded sample of the share of their true links that counts holds.

    A sample with few linked nodes is grown. 1 if the largest one has none.
    """
    for grown in range(GROWS + 1):
        shares = _shares(nodes, counts, s, s.audit * 8**grown)
        if len(shares) >= LINKED:
            break
    return float(shares.mean()) if len(shares) else 1.0


def _shares(nodes: DataFrame, counts: DataFrame, s: Settings, size: int) -> np.ndarray:
    """For each node of a sample that has true links, the share that counts holds."""
    picked = nodes.orderBy(F.xxhash64(F.lit(3), "k1"), "k1").limit(size)
    sample = picked.join(counts, "rid", "left").select("rid", "emb", F.coalesce("links", F.lit(0)).alias("links")).toArrow()
    held = {}
    for r, e in zip(sample["rid"].to_pylist(), sample["emb"].to_pylist(), strict=True):
        held.setdefault(len(e), []).append((r, e))
    held = {d: (np.array([r for r, _ in x]), unit(np.array([e for _, e in x]))) for d, x in held.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                if int(d) not in shared.value:
                    continue
                rids, q = shared.value[int(d)]
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                x, other, copies = unit(_matrix(part.column("emb"))), part.column("rid").to_numpy(), part.column("copies").to_numpy()
                for i in range(0, len(q), 512):
                    near = (q[i : i + 512] @ x.T >= s.threshold) & (rids[i : i + 512, None] != other[None])
                    n = (near * copies).sum(axis=1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(rids[i : i + 512][n > 0]), pa.array(n[n > 0])], ["rid", "n"])

    true = nodes.select("rid", "copies", "emb", "dim").mapInArrow(run, "rid long, n long").groupBy("rid").agg(F.sum("n").alias("n")).collect()
    links = dict(zip(sample["rid"].to_pylist(), sample["links"].to_pylist(), strict=True))
    return np.array([min(1.0, links[r["rid"]] / r["n"]) for r in true])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", emb: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links counts the other rows linked directly, equal vectors included. A
    vector that is null, empty or zero, or that holds a null or non-finite
    component, has no links and is its own component, as have vectors of
    different lengths between them. Rows that repeat an id are rows like any
    other; a null id is a component's least id only if all its ids are null.
    """
    s = settings or Settings()
    arrow_batches(vectors.sparkSession)
    rows, nodes = nodes_of(vectors, id_col, emb)
    for _ in range(s.tries):
        counts, edges = link(nodes, s)
        if audit(nodes, counts, s) >= s.least_recall:
            break
        s = replace(s, overlap=s.overlap + 1, beam=s.beam * 2, candidates=s.candidates + 16, degree=s.degree + 8)
    else:
        counts, edges = link_exact(nodes, s)
    groups = components(edges)
    roots = nodes.join(groups, nodes["rid"] == groups["node"], "left").select("rid", "k1", "k2", "least", "copies", F.coalesce("root", "rid").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    told = roots.join(least, "root").join(counts, "rid", "left").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("valid"))
    out = rows.join(told, ["k1", "k2", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
