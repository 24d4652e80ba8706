"""Grouping records into similarity clusters on a grid (problem 1).

Points are quantised to cells whose diagonal is below the radius, so all points of a cell touch
each other. Cells are counted, adjacent cells that hold a touching pair are joined, and minimum
labels are propagated over cells to convergence. Work is on cells and boxes, which are numbered, so
that ids stay with the points, and a cell that holds a third of all rows costs one pre-aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptbook.llm.components import components, contract
from promptbook.plans.lineage import cut

#: Cell side as a share of the radius: the diagonal, 0.99 of the radius, stays below it.
SIDE = 0.7
#: Two cells are compared point by point only if that takes at most so many comparisons; larger pairs are refined.
DIRECT = 4096
#: Bits of the numbers of cells that do not tell squares of cells apart; links within a square are contracted by one task.
SQUARE_BITS = 5
#: Offsets of the cells that can hold a touching point, one of each opposite pair.
OFFSETS = [(i, j) for i in range(0, 3) for j in range(-2, 3) if i > 0 or j > 0]


def _valid(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e12))


def _near(a: str, b: str, axis: str) -> Column:
    """Smallest distance along an axis of two boxes."""
    return F.greatest(F.lit(0.0), F.col(f"{b}.lo{axis}") - F.col(f"{a}.hi{axis}"), F.col(f"{a}.lo{axis}") - F.col(f"{b}.hi{axis}"))


def _far(a: str, b: str, axis: str) -> Column:
    """Largest distance along an axis of two boxes."""
    return F.greatest(F.col(f"{b}.hi{axis}") - F.col(f"{a}.lo{axis}"), F.col(f"{a}.hi{axis}") - F.col(f"{b}.lo{axis}"))


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Extent and number of the points of each cell, and a number for the cell, fixed by the checkpoint under it."""
    boxes = cut(points.groupBy(*keys).agg(F.min("px").alias("lox"), F.max("px").alias("hix"), F.min("py").alias("loy"), F.max("py").alias("hiy"), F.count("*").alias("n")))
    return boxes.select(*keys, F.monotonically_increasing_id().alias("key"), F.struct("lox", "hix", "loy", "hiy", "n").alias("box"))


def _split(pairs: DataFrame, radius: float) -> DataFrame:
    """Adds ``near`` and ``far``, the squared least and largest distances of boxes ``p`` and ``q``, and drops pairs too far apart."""
    near = _near("p", "q", "x") ** 2 + _near("p", "q", "y") ** 2
    far = _far("p", "q", "x") ** 2 + _far("p", "q", "y") ** 2
    return pairs.withColumn("near", near).withColumn("far", far).where(F.col("near") <= radius * radius)


def touching_groups(points: DataFrame, id_col: str, x_col: str, y_col: str, radius: float = 0.5, min_size: int = 20) -> DataFrame:
    """Largest sets connected by touching (at most ``radius`` apart) with at least ``min_size`` members.

    Returns ``(group_key, member, px, py, cx, cy, cell_n, group_n)``, one row per member.

    Edge cases: rows with a null id, or with x or y null, NaN, infinite or beyond 1e12, belong to no
    group; an id in several rows counts once, at its greatest valid (x, y); points at the same place
    are different members; other columns are ignored; an empty table gives no rows.
    """
    side = radius * SIDE
    xy = points.select(F.col(id_col).alias("id"), F.col(x_col).cast("double").alias("px"), F.col(y_col).cast("double").alias("py"))
    xy = xy.where(F.col("id").isNotNull() & _valid(F.col("px")) & _valid(F.col("py")))
    xy = xy.groupBy("id").agg(F.max(F.struct("px", "py")).alias("p")).select("id", "p.px", "p.py")
    pts = cut(xy.withColumn("cx", F.floor(F.col("px") / side)).withColumn("cy", F.floor(F.col("py") / side)))
    cells = _boxes(pts, ["cx", "cy"])

    offsets = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in OFFSETS])).alias("o")
    square = F.xxhash64(F.shiftright("cx", SQUARE_BITS), F.shiftright("cy", SQUARE_BITS)).alias("square")
    left = cells.select(F.col("key").alias("a"), F.col("box").alias("p"), "cx", "cy", square, offsets).select("a", "p", "square", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    pairs = cut(_split(left.join(cells.select("cx", "cy", F.col("key").alias("b"), F.col("box").alias("q")), ["cx", "cy"]).drop("cx", "cy"), radius))

    r2 = radius * radius
    found = [pairs.where(F.col("far") <= r2).select("a", "b", "square")]
    open_ = pairs.where(F.col("far") > r2).select("a", "b", "square", F.col("a").alias("pa"), F.col("b").alias("pb"), "p", "q")
    level, parents = 0, pts.join(cells.select("cx", "cy", F.col("key").alias("box_key")), ["cx", "cy"]).select("px", "py", "box_key")
    while not open_.isEmpty():
        small = open_.where(F.col("p.n") * F.col("q.n") <= DIRECT)
        ends = parents.select(F.col("box_key"), "px", "py")
        exact = (
            small.select("a", "b", "square", "pa", "pb")
            .join(ends.select(F.col("box_key").alias("pa"), F.col("px").alias("x1"), F.col("py").alias("y1")), "pa")
            .join(ends.select(F.col("box_key").alias("pb"), F.col("px").alias("x2"), F.col("py").alias("y2")), "pb")
            .where((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2 <= r2)
            .select("a", "b", "square")
            .distinct()
        )
        found.append(cut(exact))
        large = open_.where(F.col("p.n") * F.col("q.n") > DIRECT)
        if large.isEmpty():
            break
        level += 1
        fine = side / 4.0**level
        down = parents.withColumn("fx", F.floor(F.col("px") / fine)).withColumn("fy", F.floor(F.col("py") / fine))
        used = large.select(F.col("pa").alias("box_key")).union(large.select(F.col("pb").alias("box_key"))).distinct()
        down = down.join(used, "box_key", "left_semi")
        children = _boxes(down, ["box_key", "fx", "fy"])
        parents = cut(down.join(children.select("box_key", "fx", "fy", F.col("key").alias("child")), ["box_key", "fx", "fy"]).select("px", "py", F.col("child").alias("box_key")))
        sub = large.select("a", "b", "square", "pa", "pb").join(children.select(F.col("box_key").alias("pa"), F.col("key").alias("ka"), F.col("box").alias("p")), "pa").join(children.select(F.col("box_key").alias("pb"), F.col("key").alias("kb"), F.col("box").alias("q")), "pb")
        sub = cut(_split(sub.select("a", "b", "square", F.col("ka").alias("pa"), F.col("kb").alias("pb"), "p", "q"), radius))
        sure = sub.where(F.col("far") <= r2).select("a", "b", "square").distinct()
        found.append(sure)
        open_ = cut(sub.where(F.col("far") > r2).select("a", "b", "square", "pa", "pb", "p", "q").join(sure, ["a", "b"], "left_anti"))

    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    labels = components(contract(edges, "square"))
    groups = cells.select(F.col("key").alias("node"), "cx", "cy", F.col("box.n").alias("cell_n")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = groups.groupBy("label").agg(F.sum("cell_n").alias("group_n")).where(F.col("group_n") >= min_size)
    groups = groups.join(sizes, "label").select("label", "cx", "cy", "cell_n", "group_n")
    members = pts.join(groups, ["cx", "cy"])
    names = members.groupBy("label").agg(F.min("id").alias("group_key"))
    return members.join(names, "label").select("group_key", F.col("id").alias("member"), "px", "py", "cx", "cy", "cell_n", "group_n")


def describe_groups(members: DataFrame, k: int = 5) -> DataFrame:
    """``(group_key, n_members, typical)``: size and the ``k`` most typical members, those of the densest cells.

    Within a cell members rank by distance to the group's centre, then by id. Only the ``k`` best of a
    cell and then of a group are ranked together, so no group is gathered whole: cells are ranked first.
    """
    from pyspark.sql import Window as W

    centre = members.groupBy("group_key").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"))
    cells = members.groupBy("group_key", "cx", "cy").agg(F.first("cell_n").alias("n"))
    top_cells = cells.withColumn("r", F.row_number().over(W.partitionBy("group_key").orderBy(F.desc("n"), "cx", "cy"))).where(F.col("r") <= k).select("group_key", "cx", "cy", "r")
    near = members.join(top_cells, ["group_key", "cx", "cy"]).join(centre, "group_key")
    near = near.withColumn("d", (F.col("px") - F.col("mx")) ** 2 + (F.col("py") - F.col("my")) ** 2)
    best = near.withColumn("w", F.row_number().over(W.partitionBy("group_key", "cx", "cy").orderBy("d", "member"))).where(F.col("w") <= k)
    best = best.withColumn("o", F.row_number().over(W.partitionBy("group_key").orderBy("r", "w"))).where(F.col("o") <= k)
    return best.groupBy("group_key").agg(F.max("group_n").alias("n_members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "member"))), lambda s: s["member"]), " | ").alias("typical"))
