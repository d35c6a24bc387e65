"""SimHash near-duplicate detection with vantage-point trees.

A fingerprint is the bitwise majority of the hashes of a document's word shingles. Equal fingerprints are
merged first, so copies cost nothing afterwards. The distinct ones are joined by Hamming distance:

1. A vantage-point tree is laid out on a bounded sample. Each inner node holds a pivot fingerprint and a
   radius; a fingerprint within the radius goes left, others go right. By the triangle inequality two
   fingerprints within ``max_bits`` of each other have distances to the pivot that differ by ``max_bits`` at
   most, so a left one whose distance lies in the last ``max_bits`` values before the boundary is also sent
   right. Every linked pair thus meets in some leaf, whatever the pivots are; the sample only sets the balance.
2. Each leaf is a shard. Where the sample is too small for shards to be, large leaves get trees of their own, laid out and
   applied in the cluster, as often as it takes. Shards that still came out large are cut into pairs of blocks. Within a group the
   same recursion goes on in memory down to small sets that are compared directly, and links are contracted
   to one edge per fingerprint, so a large set of near copies never becomes a list of pairs.
3. Components over these edges come from ``common.connected_components``.

For wide radii (near copies by similarity rather than by a few bits) no pivot among fingerprints prunes, since
unrelated ones all lie near half the bits. ``near_duplicates`` then uses the empty document as its vantage
point: a document's distance from it is its number of shingles, and two sets of similarity ``s`` differ in size
by the factor ``s`` at most, so shards are ranges of sizes, and documents near a lower boundary are also sent
up. That path compares all rows of a size range in blocks, so its work grows with the square of the range. The
fingerprints give candidates only: components of candidates are gathered with their shingle sets, and two documents
link if the exact similarity of their sets reaches ``s``.

Rows in other states: a null text counts as empty; a document without words has fingerprint zero and links
like any other; a null id takes part in links but never becomes a component's id unless all ids of the
component are null (then the id is null); repeated rows are kept as rows; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.common import PREFIX, Labels, Workspace, among, block_grid, connected_components

#: Rows of the sample that lays out a tree, and of its leaves at least.
SAMPLE_ROWS = 20_000
SAMPLE_LEAF = 64
#: Fingerprints that a shard should hold, and a block of a shard that came out larger.
SHARD_ROWS = 40_000
BLOCK_ROWS = 60_000
#: In memory, sets up to this size are compared directly.
DIRECT = 512
#: Shingles of a block of sets that are compared exactly; blocks into which smaller groups are cut for more tasks.
BLOCK_SHINGLES = 2_000_000
BLOCKS = 8
#: Rows of a block of candidates, and of one where a range of sizes has over BLOCKS of them.
RANGE_ROWS, WIDE_RANGE_ROWS = 20_000, 100_000
#: Up to this size of sets the odds of bits are counted out, beyond it they are those of large sets.
COUNTED = 64


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words`` words, repeats included; A-Z lower-cased."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, hashed = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([hashed(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = words - 1
    pairs = zip(starts[: len(tokens) - last].tolist(), ends[last:].tolist(), strict=True)
    return np.fromiter((hashed(line[s:e], 42) for s, e in pairs), np.uint64, len(tokens) - last)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, shingle_words: int, distinct: bool = False) -> DataFrame:
    """``rows`` (``id``, ``key``, ``text``) as ``id``, ``key``, ``fp``, ``fp2`` (64 more bits, of remixed hashes), ``size``
    (number of shingles) and ``node`` (a hash of all shingles). With ``distinct`` each different shingle counts once; else
    ``fp2`` is ``fp`` and ``node`` 0. Texts are read whole."""

    def each(batches):
        for batch in batches:
            fp, fp2, size, node = [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes((text.as_py() or "").encode(), shingle_words)
                if distinct:
                    hashes = np.unique(hashes)
                    fp2.append(majority(remix(hashes)))
                node.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42) if distinct else 0)
                fp.append(majority(hashes))
                size.append(len(hashes))
            columns = [batch.column("id"), batch.column("key"), as_long(fp), as_long(fp2 or fp), pa.array(size, pa.int64()), as_long(node)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fp", "fp2", "size", "node"])

    return rows.select("id", "key", "text").mapInArrow(each, "id long, key long, fp long, fp2 long, size long, node long")


def as_long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64) if values else np.zeros(0, np.int64), pa.int64())


def remix(h: np.ndarray) -> np.ndarray:
    """Independent bits from the same hashes (a splitmix finaliser)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def best_split(fps: np.ndarray, max_bits: int, seed: int) -> tuple[int, int] | None:
    """The (pivot, radius) whose larger side, overlap included, is least; None if nothing gets smaller."""
    rng = np.random.default_rng(seed)
    best, least = None, 0.95 * len(fps)
    for pivot in fps[rng.integers(0, len(fps), 8)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(fps ^ pivot), minlength=65))
        radius = np.arange(65)
        left = upto
        right = len(fps) - upto[np.maximum(radius - max_bits, 0)] * (radius >= max_bits)
        larger = np.maximum(left, right)
        at = int(np.argmin(larger))
        if larger[at] < least:
            best, least = (int(pivot), at), larger[at]
    return best


def sides(fps: np.ndarray, pivot: int, radius: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    far = np.bitwise_count(fps ^ np.uint64(pivot)).astype(np.int64)
    return np.flatnonzero(far <= radius), np.flatnonzero(far > radius - max_bits)


def layout(sample: np.ndarray, total: int, max_bits: int, shard_rows: int, seed: int = 1):
    """A nested (pivot, radius, left, right), leaves being None, so that a leaf gets about ``shard_rows`` rows."""
    if not len(sample) or total <= shard_rows or len(sample) < SAMPLE_LEAF:
        return None
    split = best_split(sample, max_bits, seed)
    if split is None:
        return None
    left, right = sides(sample, *split, max_bits)
    parts = [layout(sample[x], int(total * len(x) / len(sample)), max_bits, shard_rows, 2 * seed + k) for k, x in enumerate((left, right))]
    return (*split, *parts)


def route(tree, fps: np.ndarray, max_bits: int):
    """Yields (leaf number, positions of the fingerprints it gets)."""

    def down(node, at, name):
        if node is None:
            yield name, at
        else:
            left, right = sides(fps[at], node[0], node[1], max_bits)
            yield from down(node[2], at[left], 2 * name)
            yield from down(node[3], at[right], 2 * name + 1)

    yield from down(tree, np.arange(len(fps)), 1)


def link_near(fps: np.ndarray, max_bits: int, labels: Labels) -> None:
    """Links all pairs of ``fps`` within ``max_bits``."""
    todo = [(np.arange(len(fps)), 1)]
    while todo:
        at, seed = todo.pop()
        own = fps[at]
        split = best_split(own, max_bits, seed) if len(at) > DIRECT else None
        if split is not None:
            left, right = sides(own, *split, max_bits)
            todo += [(at[left], 2 * seed % 1_000_003), (at[right], (2 * seed + 1) % 1_000_003)]
            continue
        for s in range(0, len(at), DIRECT):
            for t in range(s, len(at), 1024):
                i, j = np.nonzero(np.bitwise_count(own[s : s + DIRECT, None] ^ own[None, t : t + 1024]) <= max_bits)
                i, j = i + s, j + t
                keep = i < j
                labels.link(at[i[keep]], at[j[keep]])


def split_again(leaves: DataFrame, max_bits: int, shard_rows: int, sample_rows: int) -> DataFrame:
    """``leaves`` (``leaf``, ``fp``) with leaves of over ``2 * shard_rows`` split by a tree of their own, laid out on a sample
    of ``sample_rows`` of their rows at most, wherever those are: the driver sees neither rows nor trees."""
    large = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard_rows)
    picked = F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 40)) < F.lit(float(sample_rows) * (1 << 40)) / F.col("n")

    def build(table: pa.Table) -> pa.Table:
        sample = np.sort(table.column("fp").to_numpy().view(np.uint64))
        tree = layout(sample, table.column("n")[0].as_py(), max_bits, shard_rows)
        return pa.table({"large": table.column("leaf")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = leaves.join(large, "leaf").where(picked).groupBy("leaf").applyInArrow(build, "large long, tree binary")

    def spread(batches):
        for batch in batches:
            known, fps = {}, batch.column("fp").to_numpy().view(np.uint64)
            names, tree = batch.column("leaf").to_numpy(), batch.column("tree")
            for leaf in np.unique(names):
                own = np.flatnonzero(names == leaf)
                if leaf not in known:
                    value = tree[int(own[0])].as_py()
                    known[leaf] = pickle.loads(value) if value else None
                for sub, at in route(known[leaf], fps[own], max_bits):
                    # A leaf's name is hashed with that of its subtree; leaves that share a name are one shard.
                    name = xxhash.xxh64_intdigest(f"{leaf}.{sub}") >> 1 if known[leaf] is not None else leaf
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name, np.int64)), pa.array(fps[own[at]].view(np.int64))], ["leaf", "fp"])

    return leaves.join(trees, F.col("leaf") == F.col("large"), "left").select("leaf", "fp", "tree").mapInArrow(spread, "leaf long, fp long")


def hamming_components(ws: Workspace, distinct: DataFrame, max_bits: int, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(``fp``, ``root``) of every fingerprint of the written table ``distinct`` (column ``fp``, no repeats) that
    is linked, directly or through others, to another one at ``max_bits`` or fewer differing bits."""
    total = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toArrow().column("fp").to_numpy()
    tree = layout(sample.view(np.uint64), total, max_bits, shard_rows)

    def spread(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for leaf, at in route(tree, fps, max_bits):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf)), pa.array(fps[at].view(np.int64))], ["leaf", "fp"])

    def near(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        labels = Labels(len(fps))
        link_near(fps, max_bits, labels)
        linked = np.flatnonzero(labels.of != np.arange(len(fps)))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[labels.of[linked]].view(np.int64)})

    leaves = distinct.select("fp").mapInArrow(spread, "leaf long, fp long")
    # A sample lays out leaves of SAMPLE_LEAF of its rows at least; where they stand for too many, they are split again.
    held = total * SAMPLE_LEAF / max(1, len(sample))
    while held > 2 * shard_rows and len(sample) >= 4 * SAMPLE_LEAF:
        leaves = split_again(ws.write(leaves), max_bits, shard_rows, sample_rows)
        held = held * SAMPLE_LEAF / sample_rows
    grid = block_grid(leaves, ["leaf"], "fp", BLOCK_ROWS)
    edges = grid.select("leaf", "bi", "bj", "fp").groupBy("leaf", "bi", "bj").applyInArrow(near, "a long, b long")
    return connected_components(ws, edges, "a", "b").select(F.col("id").alias("fp"), "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 lowercase hex digits), ``component_id`` (the
    smallest id reached through links at ``max_bits`` or fewer differing bits, itself included)."""
    ws = Workspace(docs.sparkSession, "simhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = ws.write(fingerprints(texts, shingle_words).select("id", "fp"))
    distinct = ws.write(rows.groupBy("fp").agg(F.min("id").alias("low")))
    linked = hamming_components(ws, distinct, max_bits)
    smallest = linked.join(distinct, "fp").groupBy("root").agg(F.min("low").alias("least"))
    known = ws.write(linked.join(smallest, "root").select("fp", "least"))
    of = distinct.join(known, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    return rows.join(of, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def similar_bits(bits: int, similarity: float, slack: float) -> int:
    """Bits in which the fingerprints of two equally large sets of that Jaccard similarity differ, plus ``slack``
    standard deviations. Their cosine is 2s/(1+s); a bit differs with probability angle/pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def bit_limits(bits: int, similarity: float, slack: float) -> np.ndarray:
    """Like ``similar_bits`` for small sets, by both sizes (the smaller up to ``COUNTED``): halves of even sets are
    ties, which count as 0. -1 where only equal sets are that similar."""
    half = [np.array([math.comb(n, i) / 2.0**n for i in range(n + 1)]) for n in range(2 * COUNTED)]
    out = np.full((COUNTED + 1, int(COUNTED / similarity + 1e-9) + 1), -1)
    for a in range(1, COUNTED + 1):
        for b in range(a, int(a / similarity + 1e-9) + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both > a or both == b:
                continue
            i = np.arange(both + 1)
            # For i ones among the common hashes: the odds that the rest lifts either set over its half.
            one, two = (np.array([half[n - both][max(0, n // 2 + 1 - k) :].sum() for k in i]) for n in (a, b))
            p = float((half[both] * (one * (1 - two) + two * (1 - one))).sum())
            out[a, b] = round(bits * p + slack * math.sqrt(bits * p * (1 - p)))
    return out


def candidates(ws: Workspace, distinct: DataFrame, similarity: float, slack: float) -> DataFrame:
    """(``id``, ``root``): components of the written sets ``distinct`` (``node``, ``fp``, ``fp2``, ``size``) over pairs whose
    sizes differ by the factor ``similarity`` at most and whose 128 bits differ by ``slack`` deviations more than expected at most."""
    most, limits = similar_bits(128, similarity, slack), bit_limits(128, similarity, slack)
    widest = max(most, int(limits.max()))
    # Ranges of sizes as wide as the tolerance: a set meets its own range and, coming from below, the next one.
    level = F.floor(F.log(F.col("size") + F.lit(1.0)) / F.lit(math.log(1 / similarity))).cast("long")
    placed = distinct.select("node", "fp", "fp2", "size", level.alias("own"), F.explode(F.array(level, level + 1)).alias("shard"))

    def near(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("node", "ascending")])
        node, size, own, shard, blk, bi, bj = (table.column(c).to_numpy() for c in ("node", "size", "own", "shard", "blk", "bi", "bj"))
        a, b = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2"))
        labels, home = Labels(len(node)), np.flatnonzero(own == shard)
        upto = widest if len(size) and size[0] <= COUNTED else most
        for s in range(0, len(node), 128):
            i = np.arange(s, min(s + 128, len(node)))
            for t in range(np.searchsorted(home, s), np.searchsorted(size[home], size[i[-1]] / similarity + 1e-9, "right"), 4096):
                j = home[t : t + 4096]
                x, y = np.nonzero(np.bitwise_count(a[i][:, None] ^ a[j][None, :]) + np.bitwise_count(b[i][:, None] ^ b[j][None, :]) <= upto)
                x, y = i[x], j[y]
                small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                ok = (small >= similarity * large - 1e-9) & ((bi[0] == bj[0]) | (blk[x] != blk[y])) & (x != y)
                x, y, small, large = x[ok], y[ok], small[ok], large[ok]
                counted = limits[np.minimum(small, COUNTED), np.minimum(large, limits.shape[1] - 1)]
                ok = np.bitwise_count(a[x] ^ a[y]) + np.bitwise_count(b[x] ^ b[y]) <= np.where(small <= COUNTED, counted, most)
                labels.link(x[ok], y[ok])
        linked = np.flatnonzero(labels.of != np.arange(len(node)))
        return pa.table({"a": node[linked], "b": node[labels.of[linked]]})

    edges = block_grid(placed, ["shard"], "node", RANGE_ROWS, WIDE_RANGE_ROWS, BLOCKS).groupBy("shard", "bi", "bj").applyInArrow(near, "a long, b long")
    return ws.write(connected_components(ws, edges, "a", "b"))


def link_sets(sets: np.ndarray, size: np.ndarray, blk: np.ndarray | None, similarity: float, labels: Labels) -> None:
    """Links all pairs of sets whose exact similarity is ``similarity`` or more. ``sets`` has the sets' hashes one after
    the other, by ascending ``size``. With ``blk`` only pairs of different blocks count. Pairs that are already linked
    through others are not compared."""
    ids = np.unique(sets, return_inverse=True)[1]
    held, ends = np.zeros(len(ids), bool), np.cumsum(size)
    for x in range(len(size) - 1):
        y = np.arange(x + 1, np.searchsorted(size, size[x] / similarity + 1e-9, "right"))
        y = y[labels.of[y] != labels.of[x]]
        y = y if blk is None else y[blk[y] != blk[x]]
        if not len(y):
            continue
        own = ids[ends[x] - size[x] : ends[x]]
        held[own] = True
        step = max(1, BLOCK_SHINGLES // int(size[y[-1]]))
        for part in (y[k : k + step] for k in range(0, len(y), step)):
            found = held[np.concatenate([ids[ends[k] - size[k] : ends[k]] for k in part])]
            both = np.add.reduceat(found.astype(np.int64), np.cumsum(size[part]) - size[part])
            part = part[both * (1 + similarity) >= similarity * (size[x] + size[part]) - 1e-9]
            labels.link(np.full(len(part), x), part)
        held[own] = False


def near_duplicates(ws: Workspace, rows: DataFrame, texts: DataFrame, shingle_words: int, similarity: float = 0.8, slack: float = 3.5) -> DataFrame:
    """Groups of the written fingerprints ``rows`` (see ``fingerprints``, with ``distinct``) of ``texts`` whose shingle sets
    have a similarity of ``similarity`` or more: ``node`` and ``group``, for each different set, where ``group`` is the same
    for all of a group.

    Candidates come from the fingerprints, whose limit is ``slack`` deviations above the distance expected at the
    similarity; unrelated sets differ in 64 bits on average, with a deviation of 5.7. Each link is verified.
    """
    row = F.min(F.struct("key", "fp", "fp2", "size")).alias("row")
    distinct = ws.write(rows.groupBy("node").agg(row).select("node", "row.*"))
    known = candidates(ws, distinct, similarity, slack)
    picked = distinct.join(known, distinct["node"] == known["id"]).select("key", "node", "size", "root")
    # Cut for memory, and smaller groups for more tasks; only groups of several blocks are listed.
    weight = F.sum("size") / F.lit(float(BLOCK_SHINGLES))
    blocks = F.ceil(F.greatest(weight, F.least(20 * weight, F.lit(float(BLOCKS))))).cast("int")
    cut = picked.groupBy("root").agg(blocks.alias("nb")).where("nb > 1")
    picked = ws.write(picked.join(cut, "root", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).select("key", "node", "size", "root", "nb"))

    def read(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes((t.as_py() or "").encode(), shingle_words)).view(np.int64) for t in batch.column("text")]
            columns = [*(batch.column(c) for c in ("node", "size", "root", "nb")), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "root", "nb", "set"])

    sets = texts.select("key", "text").where(among(picked, "key")(F.col("key"))).join(picked, "key").dropDuplicates(["key"]).select("node", "size", "root", "nb", "text")
    sets = sets.mapInArrow(read, "node long, size long, root long, nb int, set array<long>")
    grid = (
        sets.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("node", "size", "root", "set", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    )

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("node", "ascending")])
        node, size, blk, bi, bj = (table.column(c).to_numpy() for c in ("node", "size", "blk", "bi", "bj"))
        labels = Labels(len(node))
        link_sets(table.column("set").combine_chunks().flatten().to_numpy(), size, None if bi[0] == bj[0] else blk, similarity, labels)
        linked = np.flatnonzero(labels.of != np.arange(len(node)))
        return pa.table({"a": node[linked], "b": node[labels.of[linked]]})

    edges = grid.groupBy("root", "bi", "bj").applyInArrow(verify, "a long, b long")
    groups = ws.write(connected_components(ws, edges, "a", "b"))
    return distinct.join(groups, distinct["node"] == groups["id"], "left").select("node", F.coalesce(groups["root"], "node").alias("group"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of ``near_duplicates`` the row with the smallest
    id stays (a null id counts as the largest; then the smallest hash of the row decides; of rows that are
    equal throughout one stays). All columns are returned as they came."""
    spark = docs.sparkSession
    ws = Workspace(spark, "dedup")
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields]
    hashed = [c for c, f in zip(quoted, docs.schema.fields, strict=True) if not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    key = F.xxhash64(*hashed)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = ws.write(fingerprints(texts, shingle_words, distinct=True))
    groups = near_duplicates(ws, rows, texts, shingle_words, similarity)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key"))
    best = rows.groupBy("node").agg(first.alias("first")).join(groups, "node").groupBy("group").agg(F.min("first").alias("first"))
    winners = ws.write(best.select(F.col("first.key").alias(PREFIX + "key")))
    # Only rows that go or whose key repeats need an exact look, and those that share their marks; the others stay where they are.
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(winners, F.col("key") == winners[PREFIX + "key"], "left")
    doubtful = among(ws.write(counts.where(F.col(PREFIX + "key").isNull() | (F.col("n") > 1)).select("key")), "key")
    keyed = docs.withColumn(PREFIX + "key", key)
    sure, rest = keyed.where(~doubtful(F.col(PREFIX + "key"))), keyed.where(doubtful(F.col(PREFIX + "key")))
    nth = F.row_number().over(Window.partitionBy(PREFIX + "key").orderBy(PREFIX + "key"))
    first = rest.join(winners, PREFIX + "key", "left_semi").withColumn(PREFIX + "nth", nth).where(F.col(PREFIX + "nth") == 1)
    return sure.select(*quoted).unionAll(first.select(*quoted))
