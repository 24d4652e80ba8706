"""Mixing sources to target weights (problem 9): a min-cost flow over membership patterns.

Texts are classed by the set of target sources they occur in. Each class routes its tokens to the quotas of
its sources; drawing them once more costs more every time, so repetition is spread as thinly as the quotas
allow. Only the totals of the classes reach the driver, at most one row for each set of sources; documents
are then selected in a seeded order by running totals.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptbook.plans.lineage import cut

#: Classes that the flow is solved for at most, beside those of single sources.
MAX_CLASSES = 2048
#: Texts of a bucket of the seeded order within a class, about; running totals are taken over buckets, then within each.
BUCKET_TEXTS = 5_000


class _Flow:
    """Maximum flow by shortest augmenting levels. Arcs added later cost more than all before, so running it
    after each addition gives the flow of least cost."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                x = queue.popleft()
                for e in self.arcs[x]:
                    if self.room[e] > 0 and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if t not in level:
                return total
            at = [0] * len(self.arcs)
            while got := self._push(s, t, level, at):
                total += got

    def _push(self, s: int, t: int, level: dict[int, int], at: list[int]) -> int:
        path: list[int] = []
        x = s
        while x != t:
            while at[x] < len(self.arcs[x]):
                e = self.arcs[x][at[x]]
                if self.room[e] > 0 and level.get(self.to[e], -1) == level[x] + 1:
                    break
                at[x] += 1
            else:
                if x == s:
                    return 0
                x = self.to[path.pop() ^ 1]
                at[x] += 1
                continue
            path.append(e)
            x = self.to[e]
        least = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= least
            self.room[e ^ 1] += least
        return least


def _route(weights: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens routed in all, and from each class to each source."""
    classes, sources = sorted(weights), sorted(quotas)
    node = {x: i + 2 for i, x in enumerate([*classes, *sources])}
    flow = _Flow(len(node) + 2)
    out = {(c, s): flow.add(node[c], node[s], weights[c] * repeats[s]) for c in classes for s in c if s in quotas}
    for s in sources:
        flow.add(node[s], 1, quotas[s])
    total = 0
    for _ in range(max(repeats.values(), default=0)):  # the next repetition is used only where the ones before don't do
        for c in classes:
            flow.add(0, node[c], weights[c])
        total += flow.run(0, 1)
        if total == sum(quotas.values()):
            break
    return total, {k: flow.room[e ^ 1] for k, e in out.items() if flow.room[e ^ 1]}


def plan_mix(weights: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens to draw from each class for each source. ``total`` is the wished size of the mixture; by default
    the greatest at which every source that has any text reaches its share (shares of absent ones are void)."""
    present = {s for c in weights for s in c if weights[c] > 0}
    shares = {s: w for s, (w, r) in targets.items() if s in present and w > 0 and r > 0}
    if not shares:
        return {}
    repeats = {s: targets[s][1] for s in shares}
    norm = sum(shares.values())
    quota = lambda size: {s: int(size * w / norm) for s, w in shares.items()}
    hi = sum(w for c, w in weights.items() if set(c) & set(shares)) * max(repeats.values())
    hi = hi if total is None else min(total, hi)
    lo = 0
    if _route(weights, quota(hi), repeats)[0] == sum(quota(hi).values()):
        lo = hi
    while hi - lo > max(1, hi // 1_000_000):
        mid = (lo + hi) // 2
        q = quota(mid)
        lo, hi = (mid, hi) if _route(weights, q, repeats)[0] == sum(q.values()) else (lo, mid)
    return _route(weights, quota(lo), repeats)[1]


def text_key(text: str) -> Column:
    """128 bits that stand for a text, so that texts need not travel; null for a null text."""
    return F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")))


def _one_source(goals: dict[str, tuple[float, int]]) -> Column:
    """One of the sources in ``class``, by the hash ``h`` in proportion to the shares; the last where all are 0."""
    share = F.create_map(*[F.lit(x) for s, (w, _) in sorted(goals.items()) for x in (s, float(max(w, 0.0)))])
    upto = F.transform("class", lambda s, i: F.aggregate(F.slice("class", 1, i + 1), F.lit(0.0), lambda a, x: a + share[x]))
    point = (F.shiftrightunsigned("h", 11) / F.lit(float(2**53))) * upto[F.size("class") - 1]
    return F.coalesce(F.element_at("class", F.nullif(F.array_position(F.transform(upto, lambda u: point < u), True), F.lit(0)).cast("int")), F.element_at("class", -1))


def mix_sources(records: DataFrame, targets: DataFrame, seed: int = 11, total: int | None = None, max_classes: int = MAX_CLASSES) -> DataFrame:
    """``(source, id, n_repeats, n_tokens)``: the records drawn for each source and how often.

    ``records(id, source, key, n_tokens)``, where ``key`` stands for the text (``text_key``), and
    ``targets(source, target_share, max_repeats)``. Sources are compared trimmed and in lower case. Exact
    copies of a text are one text, drawn for a source as the record
    of that source with the smallest id, so no text is repeated in a source beyond its cap.

    Edge cases: records with a null source, id or key, of no tokens, or of a source that is not listed are not
    drawn; a listed source without records has no share and the others' shares are scaled up; repeated target
    rows count once (the greatest share and cap); an empty table on either side gives no rows.
    """
    name = F.lower(F.trim("source"))
    spark = records.sparkSession
    rows = targets.where("source is not null").groupBy(name.alias("source")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()  # one row per listed source
    goals = {x.source: (x.w or 0.0, x.r or 0) for x in rows}
    empty = spark.createDataFrame([], "source string, id bigint, n_repeats bigint, n_tokens bigint")
    if not goals:
        return empty
    listed = records.where("id is not null and key is not null and n_tokens > 0").select("id", name.alias("source"), "key", F.col("n_tokens").cast("long").alias("n_tokens"))
    listed = listed.where(F.col("source").isin(list(goals)))
    once = listed.groupBy("key", "source").agg(F.min("id").alias("id"), F.max("n_tokens").alias("n_tokens"))
    texts = once.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("source", "id"))).alias("members"), F.max("n_tokens").alias("n"))  # at most one member per listed source
    texts = cut(texts.select("key", "members", "n", F.col("members.source").alias("class"), F.xxhash64("key", F.lit(seed)).alias("h")))
    sizes = cut(texts.groupBy("class").agg(F.sum("n").alias("weight"), F.count("*").alias("texts")))
    held = sizes.where(F.size("class") > 1).orderBy(F.desc("weight"), "class").limit(max_classes).select("class", F.lit(True).alias("held"))
    if sizes.where(F.size("class") > 1).count() > max_classes:
        texts = texts.join(F.broadcast(held), "class", "left").withColumn("class", F.when(F.col("held") | (F.size("class") == 1), F.col("class")).otherwise(F.array(_one_source(goals))))  # at most max_classes rows
        texts = cut(texts.drop("held"))
        sizes = texts.groupBy("class").agg(F.sum("n").alias("weight"), F.count("*").alias("texts"))
    rows = sizes.collect()  # at most max_classes and one for each listed source
    weights = {tuple(x["class"]): x.weight for x in rows}
    buckets = max(1, sum(x.texts for x in rows) // BUCKET_TEXTS)
    texts = texts.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    drawn = plan_mix(weights, goals, total)
    if not drawn:
        return empty
    spans, at = [], dict.fromkeys(weights, 0)
    for (c, s), tokens in sorted(drawn.items()):
        spans.append((list(c), s, at[c], tokens, weights[c]))
        at[c] += tokens
    plan = F.broadcast(spark.createDataFrame(spans, "class array<string>, source string, start bigint, length bigint, weight bigint"))  # classes times sources

    before = texts.groupBy("class", "bucket").agg(F.sum("n").alias("b")).withColumn("offset", F.sum("b").over(W.partitionBy("class").orderBy("bucket")) - F.col("b")).drop("b")
    inside = F.sum("n").over(W.partitionBy("class", "bucket").orderBy("h", "key")) - F.col("n") / 2
    placed = texts.withColumn("inside", inside).join(before, ["class", "bucket"]).withColumn("mid", F.col("offset") + F.col("inside"))
    times = F.ceil((F.col("start") + F.col("length") - F.col("mid")) / F.col("weight")) - F.ceil((F.col("start") - F.col("mid")) / F.col("weight"))
    picked = placed.join(plan, "class").withColumn("n_repeats", times.cast("long")).where("n_repeats > 0")
    own = F.filter("members", lambda m: m["source"] == F.col("source"))[0]["id"]
    return picked.select("source", own.alias("id"), "n_repeats", F.col("n").alias("n_tokens"))


def shares(draws: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, n_records, n_draws, n_tokens, most_repeats, actual_share)`` for every listed source."""
    name = F.lower(F.trim("source"))
    goals = targets.where("source is not null").groupBy(name.alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = draws.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("n_repeats").alias("n_draws"), F.sum(F.col("n_repeats") * F.col("n_tokens")).alias("n_tokens"), F.max("n_repeats").alias("most_repeats"))
    both = goals.join(got, "source", "left").na.fill(0, ["n_records", "n_draws", "n_tokens", "most_repeats"])
    return both.withColumn("actual_share", F.round(F.col("n_tokens") / F.sum("n_tokens").over(W.partitionBy(F.lit(1))), 6))  # one row per listed source
