"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search in it.

Nodes are distinct vectors; copies hang on one node, so that a vector that stands everywhere is one node. The graph starts from
random-projection cells of bounded size. Each round joins every node's neighbours (both directions) with their vectors, compares
neighbours of a common node with each other where one of the two is new, and merges what improves a node's list. A search keeps a beam of the nearest
nodes for each query and expands them along the graph, by joins, until no beam holds an unexpanded node. Graph building is
approximate and walks on half-precision vectors; the beam is measured anew on the original vectors, so every distance in a result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.shared import materialize, release_shuffles

#: Neighbours of a node, cells it starts from, mean and largest rows of a cell, most rounds, share of changed links that ends them.
DEGREE, TREES, CELL_ROWS, ROUNDS, STILL = 24, 10, 256, 5, 0.02
#: Links that a cell, and a hub in a round, proposes for a node, the nearest ones. What a hub leaves out, other hubs may propose; the search is approximate, and README gives its recall.
FROM_CELL, FROM_HUB = 8, 5
#: Nodes in a query's beam, nodes every search also starts from.
BEAM, ENTRIES = 160, 32


@dataclass
class Index:
    """nodes (node, vec: float64 bytes, key, code: the vector's scale and half-precision components), members (node, vec_id: the ``copies`` smallest ids of each node), graph (node, nbr), entries (node)."""

    nodes: DataFrame
    members: DataFrame
    graph: DataFrame
    entries: DataFrame
    size: int
    copies: int


def _matrix(blobs, size: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, size)


def _codes(blobs, size: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 4 + 2 * size)
    return raw[:, 4:].copy().view(np.float16).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows that can take part: id not null, vector of finite components, not all zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, vec) with the vector as float64 bytes."""

    @F.pandas_udf("binary")
    def pack(column: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float64).tobytes() for v in column], dtype="object")

    return rows.select("vec_id", pack("v").alias("vec"))


def _coded(size: int):
    @F.pandas_udf("binary")
    def code(vec: pd.Series) -> pd.Series:
        """The vector's own scale, then its components in half precision of that scale, so that one huge row hides no other."""
        if not len(vec):
            return pd.Series([], dtype="object")
        m = _matrix(vec, size)
        most = np.abs(m).max(axis=1)
        scales, units = np.minimum(most, 1e15).astype(np.float32), (m / most[:, None]).astype(np.float16)
        return pd.Series([s.tobytes() + u.tobytes() for s, u in zip(scales, units, strict=True)], dtype="object")

    return code


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy("dist", "nbr")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def _start_graph(nodes: DataFrame, size: int, count: int) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1, count / CELL_ROWS)))))
    planes = np.random.default_rng(7).standard_normal((TREES, size, bits))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = _codes(batch["code"], size) if len(batch) else np.zeros((0, size), np.float32)
            for tree in range(TREES):
                cell = ((m @ planes[tree]) > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({"tree": tree, "cell": cell, "node": batch["node"], "code": batch["code"]})

    celled = nodes.mapInPandas(cells, "tree int, cell long, node long, code binary")
    crowds = materialize(celled.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * CELL_ROWS)).cast("int").alias("parts")), "ann-cells")
    placed = celled.join(crowds, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        m, ids = _codes(pdf["code"], size), pdf["node"].to_numpy()
        k = min(FROM_CELL, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"node": [], "nbr": [], "dist": []}).astype({"node": "int64", "nbr": "int64", "dist": "float64"})
        norm = (m**2).sum(axis=1)
        d = norm[:, None] + norm[None, :] - 2 * m @ m.T
        np.fill_diagonal(d, np.inf)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"node": np.repeat(ids, k), "nbr": ids[near].ravel(), "dist": np.maximum(np.take_along_axis(d, near, 1), 0).ravel().astype(np.float64)})

    pairs = placed.groupBy("tree", "cell", "part").applyInPandas(compare, "node long, nbr long, dist double")
    return _best(pairs.groupBy("node", "nbr").agg(F.min("dist").alias("dist")), DEGREE).withColumn("new", F.lit(True))


def _local_joins(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by hub: neighbours of a common node with their vectors. Gives pairs that improve a list."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        hub = batch["hub"].to_numpy()
        last = int(np.searchsorted(hub, hub[-1])) if len(hub) else 0
        rest = batch.iloc[last:]
        yield _compare_hubs(batch.iloc[:last], size)
    if rest is not None and len(rest):
        yield _compare_hubs(rest, size)


def _compare_hubs(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    if len(rows):
        vec, hub = _codes(rows["code"], size), rows["hub"].to_numpy()
        node, fresh, worst = rows["node"].to_numpy(), rows["new"].to_numpy(bool), rows["worst"].to_numpy()
        edges = np.flatnonzero(np.diff(hub)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(hub)], strict=True):
            f = fresh[a:b]
            if b - a < 2 or not f.any():
                continue
            m = vec[a:b]
            norm = np.einsum("ij,ij->i", m, m)
            d = np.maximum(norm[:, None] + norm[None, :] - 2 * (m @ m.T), 0)
            better = (d < worst[a:b, None]) & (f[:, None] | f[None, :])
            np.fill_diagonal(better, False)
            d = np.where(better, d, np.inf)
            if b - a > FROM_HUB:
                near = np.argpartition(d, FROM_HUB - 1, axis=1)[:, :FROM_HUB]
                i, j = np.nonzero(np.isfinite(np.take_along_axis(d, near, 1)))
                j = near[i, j]
            else:
                i, j = np.nonzero(better)
            found[0].append(node[a:b][i])
            found[1].append(node[a:b][j])
            found[2].append(d[i, j].astype(np.float64))
    return pd.DataFrame({"node": np.concatenate(found[0]), "nbr": np.concatenate(found[1]), "dist": np.concatenate(found[2])})


def _descend(graph: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One round: neighbours of neighbours become neighbours where they are nearer."""
    back = graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "dist", "new")
    both = graph.select("node", "nbr", "new").unionByName(_best(back, DEGREE).select("node", "nbr", "new"))
    links = both.groupBy("node", "nbr").agg(F.max("new").alias("new")).select(F.col("node").alias("hub"), F.col("nbr").alias("node"), "new")
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= DEGREE, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
    spots = links.join(nodes.select("node", "code").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf")))), "node")
    grouped = spots.repartition("hub").sortWithinPartitions("hub").select("hub", "node", "new", "worst", "code")
    pairs = grouped.mapInPandas(lambda batches: _local_joins(batches, size), "node long, nbr long, dist double")
    old = graph.select("node", "nbr", "dist", F.lit(0).alias("fresh"))
    merged = old.unionByName(pairs.withColumn("fresh", F.lit(1))).groupBy("node", "nbr").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    return _best(merged, DEGREE).select("node", "nbr", "dist", (F.col("fresh") == 1).alias("new"))


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", copies_kept: int = 11) -> Index:
    """Indexes every usable row. Of the copies of a vector the ``copies_kept`` smallest ids are listed: enough for the best of any search for fewer neighbours than that.

    Vectors of another length than the commonest take no part, nor do rows without id, null or zero vectors, or such with null or non-finite components. Rows repeated with their id
    are one row; an id with several vectors counts with each. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 1
    keyed = _packed(rows.where(F.size("v") == size)).withColumn("key", F.md5("vec"))
    first = Window.partitionBy("key").orderBy("vec_id")
    listed = materialize(keyed.select("vec_id", "vec", "key").distinct().withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= copies_kept), "ann-listed")
    nodes = materialize(listed.where("rn = 1").select(F.col("vec_id").alias("node"), "vec", "key"), "ann-nodes")
    members = materialize(listed.select("vec_id", "key").join(nodes.select("node", "key"), "key").select("node", "vec_id"), "ann-members")
    count = nodes.count()
    nodes = materialize(nodes.select("node", "vec", "key", _coded(size)("vec").alias("code")), "ann-coded")
    graph = materialize(_start_graph(nodes, size, count), "ann-graph")
    for _ in range(ROUNDS):
        release_shuffles(spark)
        graph = materialize(_descend(graph, nodes, size), "ann-graph")
        if graph.where("new").count() <= STILL * count * DEGREE:
            break
    release_shuffles(spark)
    back = _best(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "dist"), DEGREE)
    walk = materialize(graph.select("node", "nbr").union(back.select("node", "nbr")).distinct(), "ann-walk")
    entries = nodes.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES)
    return Index(nodes, members, walk, materialize(entries, "ann-entries"), size, copies_kept)


def _distances(pairs: DataFrame, size: int) -> DataFrame:
    """(query, node, dist) of rows with a query's code (asked_code) and a node's (code)."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        return pd.Series(np.sqrt(((_codes(a, size).astype(np.float64) - _codes(b, size)) ** 2).sum(axis=1)))

    return pairs.select("query", "node", distance("asked_code", "code").alias("dist"))


def _unpacked(size: int):
    @F.pandas_udf("array<double>")
    def unpack(vec: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(vec, size)) if len(vec) else [], dtype="object")

    return unpack


def search(index: Index, queries: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows found for each query, its own id left out, ties to the smaller id; score is the Euclidean distance
    in double precision, squares added in the order of the components.

    ``k`` must be below the index's ``copies_kept``. Unusable queries give no rows; a query repeated with its vector is answered once. A walk ends when its beam holds no unexpanded node.
    """
    if not 0 < k < index.copies:
        raise ValueError(f"this index lists {index.copies} copies of a vector, so k must be from 1 to {index.copies - 1}")
    spark = queries.sparkSession
    asked = usable(queries, id_col, vector_col)
    asked = _packed(asked.where(F.size("v") == index.size).distinct()).withColumn("query", F.xxhash64("vec_id", "vec"))
    asked = asked.select("query", F.col("vec_id").alias("query_id"), F.md5("vec").alias("key"), F.col("vec").alias("asked"), _coded(index.size)("vec").alias("asked_code"))
    asked = materialize(asked, "ann-queries")
    # a query whose vector is in the index starts there, whichever copy it is
    own = asked.join(index.nodes.select("node", "key"), "key").select("query", "node")
    # ENTRIES nodes for every query: a fixed number, so this is no pairing of tables
    fixed = asked.select("query").join(F.broadcast(index.entries.agg(F.collect_list("node").alias("e"))), how="cross").select("query", F.explode("e").alias("node"))
    frontier = own.unionByName(fixed).distinct()
    seen = None
    while True:
        met = frontier.join(index.nodes.select("node", "code"), "node").join(asked.select("query", "asked_code"), "query")
        measured = _distances(met, index.size).withColumn("open", F.lit(True))
        beam = Window.partitionBy("query").orderBy("dist", "node")
        rows = measured if seen is None else seen.unionByName(measured)
        ranked = materialize(rows.withColumn("at", F.row_number().over(beam)), "ann-seen")
        front = ranked.where(F.col("open") & (F.col("at") <= BEAM)).select("query", "node")
        if front.isEmpty():  # every round closes what it expands, and no node is met twice, so this comes
            break
        seen = ranked.select("query", "node", "dist", (F.col("open") & (F.col("at") > BEAM)).alias("open"))
        steps = front.join(index.graph, "node").select("query", F.col("nbr").alias("node")).distinct()
        frontier = materialize(steps.join(ranked.select("query", "node"), ["query", "node"], "left_anti"), "ann-front")
        release_shuffles(spark)
    last = ranked.where(F.col("at") <= BEAM).select("query", "node").join(index.nodes.select("node", "vec"), "node").join(asked.select("query", "asked"), "query")
    open_vectors = last.select("query", "node", _unpacked(index.size)("asked").alias("a"), _unpacked(index.size)("vec").alias("b"))
    squares = F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))
    exact = open_vectors.select("query", "node", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("dist"))
    near = exact.join(index.members, "node").join(asked.select("query", "query_id"), "query").where("vec_id != query_id")
    order = Window.partitionBy("query").orderBy("dist", "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.col("dist").alias("score"))
