"""Most similar vectors for every vector (problem 5): a forest of sorted hash strings.

Each tree gives every vector a long string of bits, the sides of its own random hyperplanes that the
vector lies on, and keeps the strings in sorted order, where vectors with a common prefix stand together.
A run of equal strings, as a dense bundle gives, is split by further hyperplanes whose thresholds are fitted
to that run, other ones in each tree. For every vector all trees are ascended at the same pace, from the
longest common prefix to ever shorter ones, until together they hold enough candidates; the candidates are
compared by cosine in blocks, so the work grows with the number of vectors and not with its square. How far to ascend
is found from the strings alone; vectors travel to the trees once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptbook.plans.lineage import cut
from promptbook.plans.sampling import bounded_sample

#: Trees, bits of a hash string, places to either side of a match that a tree stands for.
TREES, BITS, WINDOW = 8, 62, 320
#: The ascent ends when all trees together hold this many times the places they stand for.
ENOUGH = 4
#: Runs of equal strings longer than this are split by further bits, at most ``MORE_BITS`` of them.
LONG_RUN, MORE_BITS = 64, 40
#: Strings with so many rows of the sample are split before the rows are dealt out to tasks.
HEAVY = 16
#: Vectors, at most, from which the thresholds of the hyperplanes and the borders of the partitions are fitted.
SAMPLE = 4096
#: Vectors travel to the trees as whole numbers of 16 bits, half their size; cosines are exact to about 0.00002.
SCALE = 32767
#: Cosines that a task holds at a time.
BLOCK = 4_000_000
#: Rows of the sorted arrays that one task holds.
TASK_ROWS = 60_000


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``(id, v)`` of each id once: arrays of ``dim`` finite numbers that are not all zero."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim)
            yield pa.RecordBatch.from_arrays([b.column("id"), flat.cast(pa.list_(pa.float32()))], names=["id", "u"])

    return run


def _hash(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One number of BITS bits for each vector; the first hyperplane is the highest bit."""
    bits = (x @ planes.T > cuts).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _places(borders: tuple[np.ndarray, np.ndarray], h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """How many borders, pairs of a string and its further bits in sorted order, lie at or below each row."""
    low, high = np.searchsorted(borders[0], h, "left"), np.searchsorted(borders[0], h, "right")
    out = high.copy()
    for at in np.unique(low[low < high]):
        same = (low == at) & (high > at)
        out[same] = at + np.searchsorted(borders[1][at : high[same][0]], more[same], "right")
    return out


def _strings(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray, heavy: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of one tree and, for the heavy ones, the further bits with the thresholds fitted to them."""
    h = _hash(x, planes[0], cuts)
    more = np.zeros(len(h), np.int64)
    for string, own in heavy.items():
        if len(same := np.flatnonzero(h == string)):
            more[same] = _hash(x[same], planes[1], own)
    return h, more


def _hash_batches(dim: int, planes: np.ndarray, cuts: np.ndarray, heavy: list[dict], borders: list[tuple], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("u"), dim)
            if whole:
                small = np.rint(x * SCALE).astype(np.int16)
                small = pa.array([r.tobytes() for r in small], pa.binary())
            else:
                small = pa.nulls(len(x), pa.binary())
            rest = [b.column("id"), small, b.column("level")]
            for t in range(len(planes)):
                h, more = _strings(x, planes[t], cuts[t], heavy[t])
                part = _places(borders[t], h, more) + t * (len(borders[t][0]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(h), pa.array(more), *rest], names=["part", "h", "more", "id", "u", "level"])

    return run


def _common(strings: np.ndarray) -> np.ndarray:
    """Length of the prefix that each string shares with the one before it."""
    differ = strings[1:] ^ strings[:-1]
    return np.concatenate([[-1], BITS - np.array([int(d).bit_length() for d in differ], dtype=np.int64)]) if len(strings) else np.zeros(0, np.int64)


def _runs(common: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of every run of rows that share a prefix of ``level`` bits."""
    first = np.flatnonzero(common < level)
    return first, np.append(first[1:], len(common))


def _ordered(h: np.ndarray, more: np.ndarray, x: np.ndarray | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of one sorted array after all bits, and the prefix each shares with the one before. Long runs
    are halved at the median of each further hyperplane, so the lengths of prefixes do not need the vectors ``x``."""
    common, further = _common(h), _common(more)
    common = np.where(common == BITS, BITS + np.maximum(further, 0), common)
    order = np.arange(len(h))
    rng = np.random.default_rng(seed)
    depth = 2 * BITS
    for _ in range(MORE_BITS):
        first, end = _runs(common, depth)
        long = end - first > LONG_RUN
        if not long.any():
            break
        plane = None if x is None else rng.standard_normal(x.shape[1]).astype(np.float32)
        depth += 1
        for lo, hi in zip(first[long], end[long]):
            if plane is not None:
                order[lo:hi] = order[lo:hi][np.argsort(x[order[lo:hi]] @ plane, kind="stable")]
            common[lo + 1 : hi] = depth
            common[(lo + hi) // 2] = depth - 1
    return order, common


def _sizes(enough: int):
    """For each row the levels at which its run grows and by how much, from the longest prefix upwards until enough. Runs
    too short to matter beside ``enough`` are counted with the next longer one."""
    names = pa.schema([("id", pa.int64()), ("level", pa.int32()), ("grown", pa.int64())])

    def run(part: int, ids: np.ndarray, x: np.ndarray | None, common: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
        before = np.ones(len(ids), np.int64)
        for at in np.unique(common)[::-1]:
            first, end = _runs(common, max(0, at))
            now = np.repeat(end - first, end - first)
            now = np.where((now < enough // 128) & (at > 0), before, now)
            grown = np.flatnonzero((now > before) & (before < enough))
            if len(grown):
                yield pa.RecordBatch.from_arrays([pa.array(ids[grown]), pa.array(np.full(len(grown), max(0, at), np.int32)), pa.array((now - before)[grown])], schema=names)
            before = now

    return run


def _search(k: int, least: float):
    """For each row its best among the rows that share its prefix of the level asked for."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def block(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        s = x[rows] @ x[lo:hi].T
        s[np.arange(len(rows)), rows - lo] = -2
        kth = None
        if hi - lo > k and np.count_nonzero(s >= least) > 8 * k * len(rows):
            kth = np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k]
        row, col = np.nonzero(s >= (least if kth is None else np.maximum(kth, least)[:, None]))
        if not len(row):
            return
        cos = np.einsum("ij,ij->i", x[rows[row]].astype(np.float64), x[lo + col].astype(np.float64))
        order = np.lexsort((-cos, row))
        row, col, cos = row[order], col[order], cos[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[row[best]]]), pa.array(ids[lo + col[best]]), pa.array(cos[best])], schema=names)

    def run(part: int, ids: np.ndarray, x: np.ndarray, common: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in np.unique(level):
            first, end = _runs(common, at)
            rows = np.flatnonzero(level == at)
            own = np.searchsorted(first, rows, "right") - 1
            for r in np.split(rows, np.flatnonzero(np.diff(own)) + 1):
                j = np.searchsorted(first, r[0], "right") - 1
                lo, hi = first[j], end[j]
                step = max(1, BLOCK // (hi - lo))
                for i in range(0, len(r) if hi - lo > 1 else 0, step):
                    yield from block(ids, x, r[i : i + step], lo, hi)

    return run


def _by_part(dim: int, work):
    """Runs ``work`` over each sorted array, with all bits of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = None

        def flush():
            if held:
                t = pa.Table.from_batches(held)
                x = None
                if t["u"].null_count < t.num_rows:
                    x = np.frombuffer(b"".join(t["u"].to_pylist()), dtype=np.int16).reshape(-1, dim).astype(np.float32)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                order, common = _ordered(np.asarray(t["h"]), np.asarray(t["more"]), x, int(part))
                yield from work(int(part), np.asarray(t["id"])[order], None if x is None else x[order], common, np.asarray(t["level"])[order])
                held.clear()

        for b in batches:
            p = np.asarray(b.column("part"))
            edges = [0, *(np.flatnonzero(np.diff(p)) + 1), len(p)]
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    if part is not None and p[i] != part:
                        yield from flush()
                    part = p[i]
                    held.append(b.slice(i, j - i))
        yield from flush()

    return run


def forest_pairs(units: DataFrame, dim: int, k: int, least: float, trees: int = TREES, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """``(a, b, cosine)``: for each number ``id`` of ``units(id, u)`` its ``k`` best by cosine, of ``least`` or more."""
    n = units.count()
    sample = bounded_sample(units, "u", SAMPLE)
    if not sample:
        return units.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double")
    x = np.array(sample, dtype=np.float32)
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((trees, 2, BITS, dim)).astype(np.float32)
    cuts = np.stack([np.median(x @ p[0].T, axis=0) for p in planes])
    per_tree = max(1, -(-n // TASK_ROWS))
    heavy, borders = [], []
    for p, c in zip(planes, cuts):
        h = _hash(x, p[0], c)
        strings, count = np.unique(h, return_counts=True)
        heavy.append({int(s): np.median(x[h == s] @ p[1].T, axis=0) for s in strings[count >= HEAVY]})
        h, more = _strings(x, p, c, heavy[-1])
        at = np.lexsort((more, h))[np.arange(1, per_tree) * len(x) // per_tree]
        borders.append((h[at], more[at]))

    def arrays(rows: DataFrame, whole: bool) -> DataFrame:
        hashed = rows.mapInArrow(_hash_batches(dim, planes, cuts, heavy, borders, whole), "part int, h bigint, more bigint, id bigint, u binary, level int")
        return hashed.repartitionById(trees * per_tree, "part").sortWithinPartitions("part", "h", "more", "id")

    enough = ENOUGH * trees * 2 * window
    grown = arrays(units.withColumn("level", F.lit(0)), False).mapInArrow(_by_part(dim, _sizes(enough)), "id bigint, level int, grown bigint")
    grown = grown.groupBy("id", "level").agg(F.sum("grown").alias("grown"))
    seen = grown.withColumn("seen", F.sum("grown").over(W.partitionBy("id").orderBy(F.desc("level"))))
    levels = seen.groupBy("id").agg(F.max(F.when(F.col("seen") >= enough, F.col("level"))).alias("level"))
    wanted = units.join(levels, "id", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    found = arrays(wanted, True).mapInArrow(_by_part(dim, _search(k, least)), "a bigint, b bigint, cosine double")
    found = found.repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))  # one shuffle for this and the ranking
    best = found.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b")))
    return best.where(F.col("r") <= k).select("a", "b", "cosine")


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, least: float = -1.0, trees: int = TREES, window: int = WINDOW) -> DataFrame:
    """``(id, neighbour, cosine)``: the ``k`` most similar others of every valid vector, of ``least`` or more.

    Vectors of the same direction form a class that enters the forest once. Of a class its ``k + 1`` smallest
    ids stand as neighbours, found by a limit that works before the shuffle, so a class that holds a third of
    all rows is never gathered. Equal cosines rank by id.

    Edge cases: null ids or arrays, arrays of another length, with null, NaN or infinite elements or all zero
    are left out; an id in several rows counts once (its greatest array); an empty table gives no rows; fewer
    than ``k`` others give fewer rows; other columns are ignored.
    """
    units = valid_vectors(df, id_col, vec_col, dim).mapInArrow(_units(dim), "id string, u array<float>")
    units = cut(units.withColumn("key", F.struct(F.xxhash64("u").alias("k1"), F.xxhash64("u", F.lit(1)).alias("k2"))))
    first = units.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = cut(first.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max_by("u", -F.col("r")).alias("u")))
    classes = classes.withColumn("rep", F.monotonically_increasing_id())  # fixed by the checkpoint under it; numbers travel, not ids
    pairs = forest_pairs(classes.select(F.col("rep").alias("id"), "u"), dim, k, least, trees, window)

    others = pairs.join(classes.select(F.col("rep").alias("b"), F.col("ids").alias("bs")), "b").select("a", F.explode("bs").alias("neighbour"), "cosine")
    others = others.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k)
    heads = classes.where(F.size("ids") <= k).select(F.col("rep").alias("a"), "ids")
    outside = others.join(heads, "a").where(F.col("r") <= k + 1 - F.size("ids")).select(F.explode("ids").alias("id"), "neighbour", "cosine")
    copies = units.select("id", "key").join(classes.where(F.size("ids") > 1).select("key", "ids"), "key")
    inside = copies.select("id", F.explode(F.slice(F.array_remove("ids", F.col("id")), 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine")).where(F.lit(1.0) >= least)
    return outside.unionByName(inside)


def exact_cosines(neighbours: DataFrame, df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``neighbours(id, neighbour)`` with the cosines of the vectors as they are stored, which the forest rounds."""
    units = valid_vectors(df, id_col, vec_col, dim)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    units = units.select("id", "v", length(F.col("v")).alias("l"))
    both = neighbours.select("id", "neighbour").join(units, "id").join(units.select(F.col("id").alias("neighbour"), F.col("v").alias("w"), F.col("l").alias("m")), "neighbour")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return both.select("id", "neighbour", (dot / (F.col("l") * F.col("m"))).alias("cosine"))
