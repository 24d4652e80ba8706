"""Filling fixed-capacity containers with items (problem 8): vector bin packing by dot products.

A container has simultaneous limits on tokens, on segments and on loss-bearing tokens. It is filled item by
item: of all that still fit, the one whose demands have the greatest dot product with the room left goes in.
Only sizes travel, never texts; items are dealt at random to shards of bounded size, each packed by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptbook.plans.lineage import cut

#: Items packed together in one task. The last containers of a shard stay part empty, so larger shards waste less.
SHARD_ITEMS = 20_000


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and place within it of every item; each item must fit an empty container."""
    n = len(tokens)
    order = np.lexsort((-loss, -tokens))  # largest first: those that fit are a tail of this order
    t, l = tokens[order].astype(np.int64), loss[order].astype(np.int64)
    neg = -t
    left = np.ones(n, bool)
    container, place = np.empty(n, np.int64), np.empty(n, np.int64)
    weight = np.array([t.sum() / capacity, l.sum() / max(1, max_loss), n / max_segments]) + 1e-9
    weight /= weight.sum()
    index = np.arange(n)
    number, packed, since = 0, 0, 0
    while packed < n:
        room_t, room_l, room_s = capacity, max_loss, max_segments
        filled = 0
        while room_s:
            lo = np.searchsorted(neg, -room_t)
            if lo == len(t):
                break
            fits = left[lo:] & (l[lo:] <= room_l)
            a, b = weight[0] * room_t / capacity**2, weight[1] * room_l / max(1, max_loss) ** 2
            score = np.where(fits, a * t[lo:] + b * l[lo:], -1.0)
            best = int(np.argmax(score))
            if score[best] < 0:
                break
            i = lo + best
            left[i] = False
            container[index[i]], place[index[i]] = number, filled
            room_t, room_l, room_s = room_t - t[i], room_l - l[i], room_s - 1
            filled, packed, since = filled + 1, packed + 1, since + 1
            if since >= 128:
                t, l, neg, index, left, since = t[left], l[left], neg[left], index[left], left[left], 0
        if not filled:
            raise ValueError("an item exceeds the limits of an empty container")
        number += 1
    back_c, back_p = np.empty(n, np.int64), np.empty(n, np.int64)
    back_c[order], back_p[order] = container, place
    return back_c, back_p


def _pack_shards(capacity: int, max_segments: int, max_loss: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        shards = np.asarray(t["shard"])
        for s in np.unique(shards):
            part = t.filter(pa.array(shards == s)).sort_by([("id", "ascending"), ("part", "ascending")])
            loss = np.asarray(part["n_loss"])
            c, p = pack(np.asarray(part["n_tokens"]), np.minimum(loss, max_loss), capacity, max_segments, max_loss)
            out = pa.table([pa.array((np.int64(s) << 32) + c), pa.array(p.astype(np.int32)), part["id"], part["part"], part["n_parts"], part["start_token"], part["n_tokens"], part["n_loss"], pa.array(loss > max_loss)], schema=schema)
            yield from out.to_batches()

    return run


def fill_containers(sizes: DataFrame, capacity: int, max_segments: int, max_loss: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(container, place, id, part, n_parts, start_token, n_tokens, n_loss, over_loss)`` for ``sizes(id, n_tokens, n_loss)``.

    Every item lies whole in one container, unless it alone exceeds the capacity: then it is cut into parts of the
    capacity, and only its last part shares a container by choice. An item or part within the capacity that alone has
    more loss-bearing tokens than the limit is not cut but marked ``over_loss``; no other loss-bearing item joins it. Of a
    cut item all tokens count as loss-bearing in all parts but the first.

    Edge cases: null sizes count as 0; an item of no tokens takes a place but no room; a repeated row is packed
    again; ties go by id; an empty table gives no rows; limits below 1 are an error.
    """
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("limits must be at least 1")
    kind = dict(sizes.dtypes)["id"]
    step = capacity
    whole = sizes.select("id", F.coalesce("n_tokens", F.lit(0)).alias("n"), F.coalesce("n_loss", F.lit(0)).alias("l"))
    n_parts = F.when(F.col("n") > capacity, F.ceil(F.col("n") / step)).otherwise(1).cast("int")
    parts = whole.withColumn("n_parts", F.greatest(n_parts, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    size = F.when(F.col("n_parts") == 1, F.col("n")).otherwise(F.least(F.lit(step), F.col("n") - F.col("part") * step)).cast("int")
    start = (F.when(F.col("n_parts") == 1, 0).otherwise(F.col("part") * step)).cast("int")
    loss = F.when(F.col("n_parts") == 1, F.col("l")).when(F.col("part") > 0, size).otherwise(F.greatest(F.lit(0), size - (F.col("n") - F.col("l")))).cast("int")
    items = cut(parts.select("id", "part", "n_parts", start.alias("start_token"), size.alias("n_tokens"), loss.alias("n_loss")))
    shards = max(1, round(items.count() / shard_items))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    schema = pa.schema([("container", pa.int64()), ("place", pa.int32()), ("id", arrow), ("part", pa.int32()), ("n_parts", pa.int32()), ("start_token", pa.int32()), ("n_tokens", pa.int32()), ("n_loss", pa.int32()), ("over_loss", pa.bool_())])
    return dealt.mapInArrow(_pack_shards(capacity, max_segments, max_loss, schema), f"container bigint, place int, id {kind}, part int, n_parts int, start_token int, n_tokens int, n_loss int, over_loss boolean")
