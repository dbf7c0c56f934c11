"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Equal directions are one node of the index. Nodes are dealt to shards by hash; a shard's graph is built in
one task and stored as flat arrays: unit vectors, node numbers, and per layer a table of neighbours of
fixed width, -1 where there are fewer. Nodes are numbered from the top layer down, so that a layer's nodes
are the first ones and layers need no maps. Queries visit every shard, and what the shards find is merged
by exact cosine in double precision.

Nodes are put in, and queries searched, many at a time in NumPy: a batch searches the graph as it was before
the batch, its members see each other by a matrix product, and links back are added afterwards.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise

#: Links of a new node; the lowest layer keeps twice as many.
LINKS = 16
#: Candidates kept while building, and while searching.
BUILD_WIDTH, SEARCH_WIDTH = 80, 192
#: A shard holds so many nodes at least where there are several, and so many bytes of vectors at most; up to
#: SHARDS shards grow together before there are more of them.
SHARD_NODES, SHARD_BYTES, SHARDS = 4096, 64 << 20, 64
#: Queries of one search task; the graph is sent once for each.
TASK_QUERIES = 1 << 17
#: Candidates beyond the number asked for that reach the exact comparison.
SPARE = 8
#: Bytes of one row of a stored graph.
CHUNK = 4 << 20
_BATCH = 256
_BITS = 32 << 20  # bytes of the marks of visited nodes


class Graph:
    """Unit vectors (float32), neighbours of layer l as (nodes of the layer, width) int32."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    def _near(self, queries: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.vectors[nodes], queries[rows])

    def _descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """The nearest node that greedy steps reach in the layers above ``down_to``, for every query."""
        at = np.zeros(len(queries), np.int64)
        best = queries @ self.vectors[0]
        for layer in range(len(self.layers) - 1, down_to, -1):
            links, moving = self.layers[layer], np.arange(len(queries))
            while len(moving):
                near = links[at[moving]]
                sims = np.einsum("ijk,ik->ij", self.vectors[near], queries[moving])
                sims[near < 0] = -np.inf
                to = sims.argmax(1)
                got = sims[np.arange(len(moving)), to]
                better = got > best[moving]
                moving, to, got, near = moving[better], to[better], got[better], near[better]
                at[moving], best[moving] = near[np.arange(len(moving)), to], got
        return at

    def search_layer(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int, n: int, step: int = 8):
        """(nodes, similarities), ``width`` a query, nearest first, -1 where fewer were reached: best-first from
        ``start`` over the first ``n`` nodes, ``step`` nodes opened at once."""
        q, links = len(queries), self.layers[layer]
        nodes = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        nodes[:, 0], sims[:, 0], open_[:, 0] = start, self._near(queries, np.arange(q), start), True
        seen = np.zeros((q, n), bool)
        seen[np.arange(q), start] = True
        stamp = np.empty((q, n), np.int16)
        active = np.arange(q)
        while len(active):
            order = np.argsort(~open_[active], axis=1, kind="stable")[:, :step]
            line = active[:, None]
            chosen, is_open = nodes[line, order], open_[line, order]
            open_[line, order] = False
            near = links[np.where(is_open, chosen, 0)].astype(np.int64)
            near[~is_open] = -1
            near = near.reshape(len(active), -1)
            row, col = np.nonzero(near >= 0)
            node, own = near[row, col], active[row]
            new = ~seen[own, node]
            row, col, node, own = row[new], col[new], node[new], own[new]
            stamp[own, node] = col  # of a node met twice in one step, one column wins
            once = stamp[own, node] == col
            row, node, own = row[once], node[once], own[once]
            seen[own, node] = True
            got = self._near(queries, own, node)
            good = got > sims[own, -1]
            row, node, got = row[good], node[good], got[good]
            if len(row):
                counts = np.bincount(row, minlength=len(active))
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)  # row ascends
                more = int(counts.max())
                wide_sims = np.full((len(active), width + more), -np.inf, np.float32)
                wide_nodes = np.full((len(active), width + more), -1, np.int64)
                wide_open = np.zeros((len(active), width + more), bool)
                wide_sims[:, :width], wide_nodes[:, :width], wide_open[:, :width] = sims[active], nodes[active], open_[active]
                wide_sims[row, width + place], wide_nodes[row, width + place], wide_open[row, width + place] = got, node, True
                best = np.argsort(-wide_sims, axis=1, kind="stable")[:, :width]
                inner = np.arange(len(active))[:, None]
                sims[active], nodes[active], open_[active] = wide_sims[inner, best], wide_nodes[inner, best], wide_open[inner, best]
            active = active[open_[active].any(1)]
        return nodes, sims

    def search(self, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities): about the ``k`` nearest of every query, nearest first, -1 where there are fewer."""
        n, width = len(self.vectors), max(width, k)
        nodes, sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
        size = max(1, min(_BATCH, _BITS // max(n, 1)))
        for a in range(0, len(queries) if n else 0, size):
            some = queries[a:a + size]
            got, near = self.search_layer(some, self._descend(some, 0), 0, width, n)
            nodes[a:a + size], sims[a:a + size] = got[:, :k], near[:, :k]
        return nodes, sims


def _spread(vectors: np.ndarray, nodes: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of candidates (nearest first, -1 for none), up to ``width`` that are no nearer to a chosen one than to
    their own node; what is left goes to the nearest of the others."""
    rows, c = nodes.shape
    among = vectors[nodes]
    among = np.matmul(among, among.transpose(0, 2, 1))
    barred, chosen, count = nodes < 0, np.zeros((rows, c), bool), np.zeros(rows, np.int64)
    for j in range(c):
        take = ~barred[:, j] & (count < width)
        chosen[:, j] = take
        count += take
        barred |= take[:, None] & (among[:, j, :] >= sims)
    rank = np.where(chosen, 0, 1) + np.where(nodes < 0, 2, 0)
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(nodes, order, 1)
    if c < width:
        out = np.pad(out, ((0, 0), (0, width - c)), constant_values=-1)
    return out.astype(np.int32)


def _link_back(graph: Graph, layer: int, begin: int, fresh: np.ndarray, width: int, fill: np.ndarray) -> None:
    """Add the reverse of the new nodes' links; lists hold up to half as many again before they are thinned to ``width``."""
    links, vectors = graph.layers[layer], graph.vectors
    row, col = np.nonzero(fresh >= 0)
    to, new = fresh[row, col].astype(np.int64), (begin + row).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    while len(to):
        first = np.concatenate([[True], to[1:] != to[:-1]])
        full = fill[to] >= links.shape[1]
        thin = np.unique(to[full & first])
        for a in range(0, len(thin), 1024):
            some = thin[a:a + 1024]
            near = links[some].astype(np.int64)
            sims = np.einsum("ijk,ik->ij", vectors[near], vectors[some])
            sims[near < 0] = -np.inf
            by = np.argsort(-sims, axis=1, kind="stable")
            kept = _spread(vectors, np.take_along_axis(near, by, 1), np.take_along_axis(sims, by, 1), width)
            links[some, :width], links[some, width:] = kept, -1
            fill[some] = (kept >= 0).sum(1)
        starts = np.flatnonzero(first)
        place = np.arange(len(to)) - np.repeat(starts, np.diff(np.append(starts, len(to))))
        at = fill[to] + place
        fits = at < links.shape[1]
        links[to[fits], at[fits]] = new[fits]
        added, times = np.unique(to[fits], return_counts=True)
        fill[added] += times
        to, new = to[~fits], new[~fits]


def build(vectors: np.ndarray, seed: int = 0, links: int = LINKS, width: int = BUILD_WIDTH) -> tuple[Graph, np.ndarray]:
    """(graph, order): the graph of unit vectors, whose node i is row ``order[i]``."""
    n = len(vectors)
    level = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    level, vectors = level[order], np.ascontiguousarray(vectors[order], np.float32)
    sizes = [int((level >= x).sum()) for x in range(int(level.max(initial=0)) + 1)]
    widths = [2 * links if x == 0 else links for x in range(len(sizes))]
    graph = Graph(vectors, [np.full((s, w + w // 2), -1, np.int32) for s, w in zip(sizes, widths)])
    fill = [np.zeros(s, np.int64) for s in sizes]
    begin = min(n, 1)
    while begin < n:
        top = int(level[begin])
        limit = sizes[top] if sizes[top] > begin else n  # a batch lies in one layer's new nodes
        end = min(begin + max(1, min(begin, _BATCH, _BITS // n)), limit)
        batch, base = vectors[begin:end], np.arange(begin, end)
        inside = batch @ batch.T
        inside[np.triu_indices(len(batch))] = -np.inf  # links to earlier members; the later ones link back
        start = graph._descend(batch, top)
        for layer in range(top, -1, -1):
            nodes, sims = graph.search_layer(batch, start, layer, width, begin)
            start = np.where(nodes[:, 0] >= 0, nodes[:, 0], start)
            mates = np.argsort(-inside, axis=1)[:, :links]
            mate_sims = np.take_along_axis(inside, mates, 1)
            mates = np.where(np.isfinite(mate_sims), mates + begin, -1)
            nodes, sims = np.concatenate([nodes, mates], 1), np.concatenate([sims, mate_sims], 1)
            by = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            fresh = _spread(vectors, np.take_along_axis(nodes, by, 1), np.take_along_axis(sims, by, 1), links)
            graph.layers[layer][base, :links] = fresh
            fill[layer][base] = (fresh >= 0).sum(1)
            _link_back(graph, layer, begin, fresh, widths[layer], fill[layer])
        begin = end
    return graph, order


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit, asks) of (id, vector, asks): vectors at length 1 in double precision. Rows go whose vector is null,
    empty or zero or holds anything but finite numbers."""
    for batch in batches:
        vectors = batch.column(1)
        sizes = vectors.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy()
        good = (sizes > 0) & (np.bincount(row, ~np.isfinite(values), len(sizes)) == 0)
        most = np.zeros(len(sizes))
        if len(values):
            most[sizes > 0] = np.maximum.reduceat(np.abs(values), (np.cumsum(sizes) - sizes)[sizes > 0])
        good &= most > 0
        values, row = values[good[row]], row[good[row]]
        values = values / most[row]  # neither squares nor sums can overflow
        values /= np.sqrt(np.bincount(row, values * values, len(sizes)))[row]
        ends = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
        kept = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), pa.ListArray.from_arrays(ends, pa.array(values)),
                                          batch.column(2).filter(kept)], ["id", "unit", "asks"])


def _pack(graph: Graph, ids: np.ndarray) -> bytes:
    head = np.array([len(graph.vectors), graph.vectors.shape[1], len(graph.layers), *(x for t in graph.layers for x in t.shape)], np.int64)
    return b"".join([np.int64(len(head)).tobytes(), head.tobytes(), ids.astype(np.int64).tobytes(), graph.vectors.tobytes(),
                     *(t.tobytes() for t in graph.layers)])


def _unpack(data: bytes) -> tuple[Graph, np.ndarray]:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, size, 8).tolist()
    n, d, deep, *shapes = head
    at = 8 + 8 * size
    ids = np.frombuffer(data, np.int64, n, at)
    at += 8 * n
    vectors = np.frombuffer(data, np.float32, n * d, at).reshape(n, d)
    at, layers = at + 4 * n * d, []
    for i in range(deep):
        rows, wide = shapes[2 * i:2 * i + 2]
        layers.append(np.frombuffer(data, np.int32, rows * wide, at).reshape(rows, wide))
        at += 4 * rows * wide
    return Graph(vectors, layers), ids


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy().astype(np.float32).reshape(n, -1) if n else np.empty((0, 0), np.float32)


def build_index(nodes: DataFrame, shard_nodes: int | None = None) -> DataFrame:
    """Graphs of ``nodes`` (node long, unit array<double>): rows (dim, shard, chunk, data) of about CHUNK bytes.

    Only vectors of one length are compared, so they make shards of their own.
    """
    sizes = nodes.groupBy(F.size("unit").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (4 * F.col("dim")))) if shard_nodes is None else F.lit(shard_nodes)
    least = SHARD_NODES if shard_nodes is None else shard_nodes
    shards = F.greatest(F.least(F.ceil(F.col("n") / least), F.lit(SHARDS)), F.ceil(F.col("n") / most)).cast("int")
    dealt = (nodes.withColumn("dim", F.size("unit")).join(F.broadcast(sizes.select("dim", shards.alias("shards"))), "dim")
             .withColumn("shard", F.pmod(F.xxhash64("unit", F.lit("shard")), "shards").cast("int"))
             .select("dim", "shard", "node", F.col("unit").cast("array<float>").alias("unit")))

    def make(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks().sort_by("node")
        ids, vectors = rows["node"].to_numpy(), _matrix(rows["unit"].combine_chunks())
        dim, shard = rows["dim"][0].as_py(), rows["shard"][0].as_py()
        graph, order = build(vectors, seed=shard)
        data = _pack(graph, ids[order])
        parts = [data[a:a + CHUNK] for a in range(0, len(data), CHUNK)]
        return pa.table({"dim": pa.array([dim] * len(parts), pa.int32()), "shard": pa.array([shard] * len(parts), pa.int32()),
                         "chunk": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})

    return dealt.groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, chunk int, data binary")


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query, node, near): about the ``k`` nearest nodes of every query (query long, unit array<double>) in all shards.

    A task has one graph and some queries: the rows of the graph come first, then the queries in batches.
    """
    shards = index.select("dim", "shard").distinct()
    deals = max(1, -(-queries.count() // TASK_QUERIES))
    asked = (queries.select("query", F.size("unit").alias("dim"), F.col("unit").cast("array<float>").alias("unit"))
             .withColumn("deal", F.pmod(F.xxhash64("query"), F.lit(deals)).cast("int")).join(F.broadcast(shards), "dim"))
    graphs = index.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    none = lambda t: F.lit(None).cast(t)
    rows = graphs.select("dim", "shard", "deal", "chunk", "data", none("bigint").alias("query"), none("array<float>").alias("unit")).unionByName(
        asked.select("dim", "shard", "deal", none("int").alias("chunk"), none("binary").alias("data"), "query", "unit"))
    key = ["dim", "shard", "deal"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, parts, begun = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            is_query = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if not is_query[a]:
                    if begun != tuple(marks[a]):
                        graph, parts, begun = None, [], tuple(marks[a])
                    parts += batch.column(4).slice(a, b - a).to_pylist()
                    continue
                if parts:
                    (graph, ids), parts = _unpack(b"".join(parts)), []
                nodes, sims = graph.search(_matrix(batch.column(6).slice(a, b - a)), k, width)
                row, col = np.nonzero(nodes >= 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(batch.column(5).slice(a, b - a).to_numpy()[row]), pa.array(ids[nodes[row, col]]),
                    pa.array(sims[row, col].astype(np.float64))], ["query", "node", "near"])

    found = (rows.repartition(*key).sortWithinPartitions(*key, F.col("chunk").asc_nulls_last(), "query")
             .mapInArrow(find, "query bigint, node bigint, near double"))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.col("near").desc(), "node"))
    return found.withColumn("place", best).filter(F.col("place") <= k).drop("place")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            width: int = SEARCH_WIDTH, shard_nodes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of every row where ``is_query``, nearest first.

    Candidates are all rows with another id; ``score`` is the cosine of the original vectors in double precision,
    ties go to the smaller id. Rows with a null id, or with a vector that ``_units`` leaves out, take no part. Only
    vectors of the same length are near each other. Rows that repeat an id with the same direction count once, with another direction
    as rows of their own, and none is a candidate of its own id. Fewer rows come back where there are fewer candidates.
    """
    valid = vectors.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = materialise(valid.mapInArrow(_units, "id bigint, unit array<double>, asks boolean").withColumn("hash", F.xxhash64("unit")), "vectors")
    # Of equal directions, the k + 1 smallest ids can be results; Spark cuts to them before and after the shuffle.
    same = ["hash", "unit"]
    first = F.dense_rank().over(W.partitionBy(*same).orderBy("id"))
    few = valid.dropDuplicates(["id", *same]).withColumn("place", first).filter(F.col("place") <= k + 1)
    nodes = materialise(few.groupBy(*same).agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn(
        "node", F.monotonically_increasing_id()), "nodes")
    index = materialise(build_index(nodes.select("node", "unit"), shard_nodes), "graphs")
    asking = materialise(valid.filter("asks").select("id", *same).distinct(), "queries")
    asked = materialise(asking.select(*same).distinct().withColumn("query", F.monotonically_increasing_id()), "directions")
    found = search_index(index, asked.select("query", "unit"), k + 1 + SPARE, width)
    dot = F.aggregate(F.zip_with(F.col("unit"), F.col("other"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = found.join(nodes.select("node", F.col("unit").alias("other"), "ids"), "node").join(asked, "query").select(
        *same, dot.alias("score"), "ids")
    one = scored.select(*same, F.explode("ids").alias("vec_id"), "score")
    near = F.row_number().over(W.partitionBy(*same).orderBy(F.col("score").desc(), "vec_id"))
    # k + 1 candidates serve every query of a direction: one of them may be its own row.
    lists = one.withColumn("place", near).filter(F.col("place") <= k + 1).groupBy(*same).agg(
        F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    # Very many queries may share a direction: they meet its list in SALTS parts.
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
    parts = asking.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    each = parts.join(lists.withColumn("salt", salts), [*same, "salt"]).select(
        F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("found"))
    return each.select("query_id", F.posexplode("found").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
