"""Frequency of every distinct term (problem 2): recursive radix spilling.

Each map task counts the terms of its own records with DuckDB and adds them up whenever they exceed its budget, so
a term that occurs everywhere leaves a task as about one row. The counts are partitioned by bits of the term's hash
(Spark's shuffle is the first spill to disk). A task whose partition exceeds its budget first adds up what it holds; if
that is still too much, as there are too many different terms, it writes it to its own scratch space by the next hash
bits, again and again, and DuckDB aggregates each part by itself. One term, however often it comes, is never written
more than once for each budget.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run of letters, digits and underscores; a term of a text is such a run of three or more letters a-z only.
RUN = r"[\p{L}\p{N}_]+"
WORD = r"[a-z]{3,}"
#: Hash bits of the first level, at most so many tasks, and of each further level.
FIRST_BITS, NEXT_BITS = 20, 4
#: Bytes of counts that a task holds before it adds them up, or splits them by further hash bits.
BUDGET = 64 << 20
#: Records that a map task counts at once.
MAP_ROWS = 2_000

SPLITS = {
    "words": f"SELECT r, unnest(regexp_extract_all(t, '{RUN}')) AS term FROM batch",
    "entries": r"SELECT r, (regexp_replace(regexp_replace(e, '^[\s\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x1c-\x1f\x{85}\p{Z}]+$', '')) AS term FROM (SELECT r, unnest(string_split(t, ',')) AS e FROM batch)",
}
KEEP = {"words": f"regexp_full_match(term, '{WORD}')", "entries": "term <> ''"}


def _duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '384MB'")
    con.execute(f"SET temp_directory = '{_scratch() or tempfile.gettempdir()}'")
    return con


def _scratch() -> str | None:
    """The task's own scratch space: of the folders that Spark's spills use on this executor, the one with the most room.
    What is written there is read by the same task only, so it need not be shared."""
    folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)]
    return max(folders, key=lambda d: shutil.disk_usage(d).free, default=None)


_COUNTS = pa.schema([("field", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("records", pa.int64())])


def _count_batches(field: str, kind: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        held, size, least = [], 0, budget
        for b in (x.slice(i, MAP_ROWS) for x in batches for i in range(0, x.num_rows, MAP_ROWS)):
            con.register("batch", pa.table({"r": pa.array(range(b.num_rows), pa.int64()), "t": b.column(0)}))
            got = con.sql(f"SELECT term, sum(n)::BIGINT AS n, count(*)::BIGINT AS records FROM (SELECT r, term, count(*) AS n FROM ({SPLITS[kind]}) WHERE {KEEP[kind]} GROUP BY r, term) GROUP BY term").to_arrow_table()
            held.append(pa.table([pa.array([field] * got.num_rows, pa.string()), got["term"].cast(pa.string()), got["n"], got["records"]], schema=_COUNTS))
            size += held[-1].nbytes
            if size > least:
                held = [_sum(con, held)]
                size = held[0].nbytes
                if size > budget // 2:  # mostly different terms: they leave, and the shuffle parts them
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from _sum(con, held).to_batches()

    return run


def _sum(con, tables: list[pa.Table]) -> pa.Table:
    con.register("part", pa.concat_tables(tables))
    return con.sql("SELECT field, term, sum(n)::BIGINT AS n, sum(records)::BIGINT AS records FROM part GROUP BY field, term").to_arrow_table().cast(_COUNTS)


def _sum_hashed(con, tables: list[pa.Table]) -> pa.Table:
    con.register("part", pa.concat_tables(tables))
    return con.sql("SELECT field, term, sum(n)::BIGINT AS n, sum(records)::BIGINT AS records, any_value(h) AS h FROM part GROUP BY field, term").to_arrow_table().cast(tables[0].schema)


def _spill(con, batches: Iterator[pa.RecordBatch], depth: int, folder: str, budget: int) -> Iterator[pa.Table]:
    """Aggregates the batches. What exceeds the budget also when added up goes to files by the next hash bits, each of
    which is handled the same way; when no bits are left, or all have one hash, it is added up as it is."""
    shift = 64 - FIRST_BITS - NEXT_BITS * (depth + 1)
    writers: dict[int, tuple] = {}
    own = os.path.join(folder, f"radix{depth}-{os.urandom(4).hex()}")
    held: list[pa.Table] = []
    size, least = 0, budget

    def write() -> None:
        t = held[0]
        digit = (np.asarray(t["h"]).astype("uint64") >> np.uint64(shift)) & np.uint64((1 << NEXT_BITS) - 1)
        os.makedirs(own, exist_ok=True)
        for d in np.unique(digit):
            if d not in writers:
                sink = pa.OSFile(os.path.join(own, str(d)), "wb")
                writers[d] = (sink, pa.ipc.new_stream(sink, t.schema))
            writers[d][1].write_table(t.filter(pa.array(digit == d)))
        held.clear()

    try:
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += held[-1].nbytes
            if size > least:
                held[:] = [_sum_hashed(con, held)]
                size = held[0].nbytes
                if size <= budget // 2:
                    continue
                if shift < 0 or held[0].num_rows < 2:
                    least = max(budget, 2 * size)  # nothing to split
                    continue
                write()
                size = 0
        if held and writers:
            held[:] = [_sum_hashed(con, held)]
            write()
        elif held:
            yield _sum(con, [t.drop_columns(["h"]) for t in held])
            held.clear()
        for sink, w in writers.values():
            w.close()
            sink.close()
        for d in sorted(writers):
            with pa.OSFile(os.path.join(own, str(d)), "rb") as source:
                yield from _spill(con, iter(pa.ipc.open_stream(source)), depth + 1, own, budget)
            os.remove(os.path.join(own, str(d)))
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _aggregate(budget: int):
    out = pa.schema([("field", pa.string()), ("term", pa.string()), ("n_total", pa.int64()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="census-", dir=_scratch())
        try:
            for t in _spill(_duck(), batches, 0, folder, budget):
                yield from pa.table([t["field"], t["term"], t["n"], t["records"]], schema=out).to_batches()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def term_census(fields: dict[str, tuple[DataFrame, str]], budget: int = BUDGET) -> DataFrame:
    """``(field, term, n_total, n_records)``: how often each term occurs and in how many records.

    ``fields`` maps a field's name to a table of one text column with a row for each record, and how its
    terms are cut: ``words`` (runs of letters, digits and underscores of the lower-cased text that consist
    of three or more letters a-z only) or ``entries`` (between commas, trimmed, lower-cased, not empty).

    Edge cases: null and empty texts have no terms; a text of any length is counted whole; an empty table
    gives no rows. Rows must have been made unique by record before. ``budget`` is the bytes of counts that a task holds.
    """
    counts = None
    for field, (df, kind) in fields.items():
        text = df.select(F.lower(df.columns[0]).alias("t")).where("t is not null")  # full case mapping, in the JVM
        part = text.mapInArrow(_count_batches(field, kind, budget), "field string, term string, n bigint, records bigint")
        counts = part if counts is None else counts.unionByName(part)
    hashed = counts.withColumn("h", F.xxhash64("field", "term"))
    radix = hashed.withColumn("radix", F.shiftrightunsigned(F.col("h"), 64 - FIRST_BITS)).repartition("radix")
    return radix.drop("radix").mapInArrow(_aggregate(budget), "field string, term string, n_total bigint, n_records bigint")


def mark_terms(census: DataFrame, totals: DataFrame, rare: int = 2, common_percent: int = 56) -> DataFrame:
    """Adds ``mark``: ``rare`` for terms of at most ``rare`` records, ``common`` for those of more than the
    percentage of all records of the field (``totals``: ``field, total``, one row per field). A term can get
    both, in two rows; terms with neither mark have a null ``mark``."""
    marks = F.array_compact(F.array(F.when(F.col("n_records") <= rare, F.lit("rare")), F.when(F.col("n_records") * 100 > F.col("total") * common_percent, F.lit("common"))))
    return census.join(F.broadcast(totals), "field").withColumn("mark", F.explode_outer(marks))
