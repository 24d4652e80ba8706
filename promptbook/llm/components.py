"""Connected components by propagating minimum labels with shortcuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptbook.plans.lineage import cut

#: Edges that a task joins at a time before labels are propagated.
LOCAL_EDGES = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        t = pa.Table.from_batches(held)
        held.clear()
        nodes, ends = np.unique(np.concatenate([np.asarray(t["a"]), np.asarray(t["b"])]), return_inverse=True)
        a, b = ends[: t.num_rows], ends[t.num_rows :]
        root = np.arange(len(nodes))
        while True:  # least root of both ends, then of the root's root, until nothing moves
            least = np.minimum(root[a], root[b])
            now = root.copy()
            for x in (a, b, root[a], root[b]):
                np.minimum.at(now, x, least)
            now = now[now]
            if (now == root).all():
                break
            root = now
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root]), pa.array(nodes)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LOCAL_EDGES:
            yield from flush()
    yield from flush()


def contract(edges: DataFrame, near: str) -> DataFrame:
    """``(a, b)`` with the components of ``edges(a, b, near)`` between numbers: each task joins the edges it holds, and
    leaves one edge for each of their nodes, from the least node joined to it. Edges of equal ``near``, which should
    be those of one neighbourhood, meet in a task, so that long chains become short before labels are propagated."""
    return edges.repartition(near).select("a", "b").mapInArrow(_stars, "a bigint, b bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` of every node on an edge; ``label`` is the smallest node of its component.

    Each round a node takes the least label among its neighbours, passes that on to its former root,
    and jumps to the label of its label, so the rounds grow with the logarithm of the diameter.
    Labels are never collected; each round is cut by a checkpoint. Null ends are ignored, loops give
    a node with its own label, an empty input gives an empty result.
    """
    two = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    two = cut(two.unionByName(two.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(two.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(max_rounds):
        heard = two.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        hooks = step.where("label < was").groupBy(F.col("was").alias("node")).agg(F.min("label").alias("hook"))
        step = step.join(hooks, "node", "left").select("node", "was", F.least("label", F.coalesce("hook", "label")).alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        now = cut(step.join(up, "label").select("node", "was", F.col("top").alias("label")))
        labels = now.select("node", "label")
        if now.where("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"labels did not settle within {max_rounds} rounds")
