"""Near-duplicate vectors with an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook of its own; a pair of codes is a cell of the product
grid. Every vector lives in one cell. As a query it walks the grid by the multi-sequence algorithm: cells in
increasing order of the summed distance of its halves to the two codewords. How many cells it visits is calibrated
on the sample: vectors are moved by just the allowed angle in random directions, and the visits are set so
that ``recall`` of them are found in the cells of their origin's walk. Both of a pair walk, so a pair is missed only if
neither finds the other, and every pair met is verified by its cosine in double precision.

Large cells are cut into pairs of blocks, so no task holds more than two blocks of even a cell with a third of all
vectors. Equal vectors are merged first and counted. What travels to the cells is each vector in 32 bits a component, with
its list of cells only where it lives. 32-bit cosines settle all pairs but those within ``BAND`` of the threshold, which
are looked up and compared in double precision. Links are not listed: a block returns for each vector the number of links
found and one edge to the block's contracted component.

The codebooks come from a bounded sample (``SAMPLE_ROWS`` vectors by hash order); their size grows with the square
root of the number of vectors up to ``MAX_CODES``, so cells keep their size. Vectors of different lengths can't be compared;
each length has an index of its own.

States: vectors that are null, zero, or hold null or non-finite components link with nothing and are kept as components of
their own; a null id is kept, gets links, but is no component's id unless all its ids are null; repeated rows are vectors of
their own and link with each other; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.common import Labels, Workspace, block_grid, connected_components

#: Vectors of the sample for codebooks and calibration.
SAMPLE_ROWS = 20_000
#: Vectors that a cell should hold, codewords of a codebook at most, rows of a block.
CELL_ROWS = 200
MAX_CODES = 1024
BLOCK_ROWS = 2_000
#: Cosines of 32-bit vectors that are this close to the threshold are worked out again in double precision.
BAND = 1e-5


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Codewords of the rows of ``x``; deterministic."""
    rng = np.random.default_rng(7)
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin(distances(x, centers), axis=1)
        for c in range(k):
            own = x[near == c]
            centers[c] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]


def walk(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """For each row the first ``visits`` cells (code1 * codes + code2) by ``d1 + d2``: the multi-sequence order.

    The cell at ranks (i, j) of the two sorted lists comes after all cells at smaller ranks, so the first n cells
    have (i + 1) * (j + 1) <= n; only those candidates are sorted."""
    k = d1.shape[1]
    visits = min(visits, k * k)
    deep = min(k, visits)
    s1, s2 = (np.argsort(d, axis=1, kind="stable")[:, :deep] for d in (d1, d2))
    ranks = np.array([(i, j) for i in range(deep) for j in range(min(deep, visits // (i + 1)))])
    a, b = s1[:, ranks[:, 0]], s2[:, ranks[:, 1]]
    total = np.take_along_axis(d1, a, 1) + np.take_along_axis(d2, b, 1)
    first = np.argsort(total, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(a * k + b, first, 1)


class Index:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2
        codes = max(1, min(MAX_CODES, math.isqrt(max(1, total // CELL_ROWS)), len(sample)))
        self.books = [kmeans(sample[:, : self.half], codes), kmeans(sample[:, self.half :], codes)]
        self.codes = codes
        self.visits = self.calibrate(sample[:4000], cosine, recall)

    def calibrate(self, sample: np.ndarray, cosine: float, recall: float) -> int:
        """The visits at which ``recall`` of vectors at exactly the cosine are met from their origin."""
        rng = np.random.default_rng(11)
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(1)[:, None] * sample
        noise /= np.linalg.norm(noise, axis=1)[:, None] + 1e-300
        other = cosine * sample + math.sqrt(1 - cosine * cosine) * noise
        cells = self.cells(other, 1)[:, 0]
        visits = 1
        while visits < self.codes**2:
            if (self.cells(sample, visits) == cells[:, None]).any(1).mean() >= recall:
                break
            visits = max(visits + 1, int(visits * 1.3))
        return min(visits, self.codes**2)

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        return walk(distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1]), visits)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and very small components."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def unpacked(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def vector_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.995
) -> DataFrame:
    """One row per row of ``vectors``: the id, ``n_links`` (other vectors at ``cosine`` or more), ``component_id`` (the
    smallest id reached through links, itself included)."""
    ws = Workspace(vectors.sparkSession, "vectors")
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # Equal vectors become one node (-0.0 and 0.0 are equal), known by two hashes together.
    exact = F.transform(v, lambda x: x + 0.0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, exact).alias("v"))
    rows = rows.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    own = [F.first("v").alias("v"), F.min("id").alias("low"), F.count(F.lit(1)).alias("n")]
    merged = ws.write(rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(*own).select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("width"), "*"))
    alone = rows.where("v IS NULL").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    widths = {r["width"]: r["count"] for r in merged.groupBy("width").count().orderBy("width").collect()}
    if not widths:
        return alone
    parts = [_links(ws, merged.where(F.col("width") == w), w, total, cosine, recall) for w, total in widths.items()]
    found = ws.write(functools.reduce(DataFrame.unionAll, parts))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comps = ws.write(connected_components(ws, found, "a", "b"))
    nodes = merged.select("node", "k1", "k2", "low", "n").join(links, "node", "left").join(comps.withColumnRenamed("id", "node"), "node", "left")
    nodes = ws.write(nodes.select("k1", "k2", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    known = nodes.join(least, "root").select("k1", "k2", "n_links", "component_id")
    linked = rows.where("v IS NOT NULL").select("id", "k1", "k2").join(known, ["k1", "k2"]).select(F.col("id").alias(id_col), "n_links", "component_id")
    return linked.unionByName(alone)


def _links(ws: Workspace, merged: DataFrame, width: int, total: int, cosine: float, recall: float) -> DataFrame:
    """Of the distinct vectors ``merged`` (``node``, ``v`` of ``width`` components, ``n`` copies) the links found: ``a``, the ``b``
    that it is contracted to, and how many copies of others ``a`` is linked with by the pairs of one block."""
    sample = merged.orderBy(F.xxhash64("v", F.lit(1)), "node").select("v").limit(SAMPLE_ROWS).toArrow()
    index = Index(unit(matrix(sample.column("v"), width)), total, cosine, recall)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("v"), width))
            cells = index.cells(x, index.visits)
            columns = [batch.column("node"), batch.column("n"), packed(x.astype(np.float32)), pa.array(cells[:, 0]), pa.array(list(np.sort(cells, axis=1)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "x", "home", "visited"])

    placed = merged.select("node", "n", "v").mapInArrow(place, "node long, n long, x binary, home long, visited array<long>")
    placed = ws.write(placed.withColumn("cell", F.explode("visited")).withColumn("visited", F.when(F.col("cell") == F.col("home"), F.col("visited"))))
    grid = block_grid(placed, ["cell"], "node", BLOCK_ROWS)

    def compare(table: pa.Table) -> pa.Table:
        node, n, home, cell, blk, bi, bj = (table.column(c).to_numpy() for c in ("node", "n", "home", "cell", "blk", "bi", "bj"))
        x = unpacked(table.column("x"), np.float32, width)
        at_home = np.flatnonzero(home == cell)
        visited = np.zeros((len(node), index.visits), np.int64)
        visited[at_home] = matrix(table.column("visited").take(pa.array(at_home)), index.visits)
        links, labels, unsure = np.zeros(len(node), np.int64), Labels(len(node)), [[], [], []]
        for s in range(0, len(node), 512):
            near = x[s : s + 512] @ x[at_home].T
            i, j = np.nonzero(near >= cosine - BAND)
            sure = near[i, j] >= cosine + BAND
            i, j = i + s, at_home[j]
            keep = (i != j) & ((bi[0] == bj[0]) | (blk[i] != blk[j]))
            i, j, sure = i[keep], j[keep], sure[keep]
            # The other way round only if j's own walk does not come to i's cell.
            back = ~(visited[j] == home[i][:, None]).any(1)
            for k, part in enumerate((i[~sure], j[~sure], back[~sure])):
                unsure[k].append(part)
            i, j, back = i[sure], j[sure], back[sure]
            np.add.at(links, i, n[j])
            np.add.at(links, j[back], n[i[back]])
            labels.link(i, j)
        out = np.flatnonzero((links > 0) | (labels.of != np.arange(len(node))))
        i, j, back = (np.concatenate(part) for part in unsure)
        # Unsure pairs are rows with the number of copies that each side would add.
        return pa.table({
            "a": np.concatenate([node[out], node[i]]), "b": np.concatenate([node[labels.of[out]], node[j]]),
            "links": np.concatenate([links[out], n[j]]), "back": pa.array([None] * len(out) + (n[i] * back).tolist(), pa.int64()),
        })

    found = ws.write(grid.groupBy("cell", "bi", "bj").applyInArrow(compare, "a long, b long, links long, back long"))
    vectors = merged.select("node", "v")
    pairs = found.where("back IS NOT NULL").join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b")

    def verify(batches):
        for batch in batches:
            if batch.num_rows:
                ok = (unit(matrix(batch.column("x"), width)) * unit(matrix(batch.column("y"), width))).sum(1) >= cosine
                a, b, links, back = (batch.column(c).to_numpy()[ok] for c in ("a", "b", "links", "back"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in ((a, b), (b, a), (links, back))], ["a", "b", "links"])

    exact = pairs.select("a", "b", "links", "back", "x", "y").mapInArrow(verify, "a long, b long, links long")
    return found.where("back IS NULL").select("a", "b", "links").unionAll(exact)
