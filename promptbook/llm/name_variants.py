"""Linking variant spellings of names (problem 3): a pigeonhole segment join.

The persons of a play are those of its printed list of roles and, where a play prints names both in capitals and
otherwise, those in capitals. Every word of a person's name is cut into k + 1 segments for k = 2 edits, which go into an
inverted index by play, length, place and text: a word with one typing slip (insertion, omission, replacement, or two
letters exchanged, which is two edits), or a long word with two slips, keeps one segment, at most as many places aside.
The beginnings of words are indexed whole and, for abbreviations with a slip, by their segments too. The words of every
other spelling look up their substrings; candidates are verified word by word with an edit distance banded to k,
words being given to each other by the cheapest assignment. Each spelling goes to its best person if that one is
clearly the best. Spellings without a person are then compared with each other in the same way, and names in capitals
that no list has with all other persons, so that every spelling meets every other of its play.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptbook.functions.roles import parse_roles
from promptbook.llm.components import components
from promptbook.plans.lineage import cut

#: Words before a name that are no part of it: fixed values, in the spelling of ``letters``.
TITLES = frozenset("a an the sir lord lady mistris mistresse mistress mrs maister master mr king queen queene prince duke old ioung".split())
#: What a description may end with that belongs to the next name of the list: a title behind a separator.
NEXT_TITLE = r"(?:[^\w\s,]|\n)\s*(?:Old|Young|King|Queen|Duke|Prince|Sir|Lord|Lady)\s*$"
#: Edits that leave at least one of one more segments whole.
EDITS = 2
#: Words of at least so many letters may have two slips, others of three letters one.
LONG_WORD, LEAST_WORD = 8, 3
#: Digits that are read for letters within a word: fixed values.
DIGITS = str.maketrans("0158", "oisb")
#: A spelling is linked if it is within the greatest cost and the next person is further by the margin.
MOST, MARGIN = 2.7, 0.25
#: Names both in capitals are within this cost of each other if one is a slip of the other.
SAME_CAPITALS = 2.1
MISSING = "•"
#: Beginnings longer than this are looked up by their first letters, and compared whole when they are verified.
HEAD = 32


def letters(text: str) -> str:
    """One spelling for letters that printers used for each other."""
    t = unicodedata.normalize("NFKC", text).lower().replace("vv", "w").replace("v", "u").replace("y", "i").replace("j", "i")
    return t.replace("uu", "w")


def words(name: str | None) -> list[tuple[str, bool]]:
    """The words of a name without titles, each with whether it is marked as cut short. A digit within a word is a letter
    misread; a number is a word of its own, and a name with one keeps its titles, as it has no other words."""
    out: list[tuple[str, bool]] = []
    for raw in re.findall(rf"[\w'\-{MISSING}]+[.:]*|[.:]+", name or ""):
        mark = raw.rstrip(".:")
        if mark in ("", MISSING):
            if out:
                out[-1] = (out[-1][0], True)
            continue
        word = letters(mark).replace("'", "").replace("-", "")
        if word and not word.isdigit():
            word = word.translate(DIGITS)
        if word:
            out.append((word, raw != mark))
    if any(w.isdigit() for w, _ in out):
        return [(w, short and not w.isdigit()) for w, short in out]
    return [w for w in out if w[0] not in TITLES]


def slips(word: str) -> int:
    """How many slips a word of this length may have."""
    n = len(word)
    return 2 if n >= LONG_WORD else 1 if n >= LEAST_WORD else 0


def distance(a: str, b: str, k: int) -> int | None:
    """Insertions, omissions, replacements and exchanges of neighbours that turn ``a`` into ``b``, if at most ``k``; cells
    further than ``k`` from the diagonal are never computed. An illegible letter stands for any one."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return None
    far = k + 1
    older: dict[int, int] = {}
    above = {j: j for j in range(min(m, k) + 1)}
    for i in range(1, n + 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            if j == 0:
                row[j] = i
                continue
            same = a[i - 1] == b[j - 1] or MISSING in (a[i - 1], b[j - 1])
            best = min(above.get(j - 1, far) + (not same), above.get(j, far) + 1, row.get(j - 1, far) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, older.get(j - 2, far) + 1)
            row[j] = best
        if min(row.values()) > k:
            return None
        older, above = above, row
    return above[m] if above.get(m, far) <= k else None


def other_sex(a: str, b: str) -> bool:
    """Whether two words differ in no more than endings that tell a woman's name from a man's."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return {a[i:], b[i:]} in ({"a", "o"}, {"a", "us"})


def slipped(word: str, target: str) -> float | None:
    """Cost of the slips between a word and one of a person's name; None if they are too many for its length. One slip
    in a word of three letters and two in a long one leave the first letter alone."""
    k = slips(target)
    if not k or len(word) < LEAST_WORD or other_sex(word, target):
        return None
    d = distance(word, target, k)
    if d is None:
        return None
    if (d == 2 or min(len(word), len(target)) == LEAST_WORD) and word[0] != target[0]:
        return None
    return 0.5 if d == 0 else 1.6 if d == 2 else 1.3 if min(len(word), len(target)) == LEAST_WORD else 1.0


@lru_cache(200_000)
def word_cost(word: str, short: bool, formal: tuple[str, ...], target: str) -> float | None:
    """How far a word of a spelling is from a word of a person's name; None if they don't go together."""
    if word == target:
        return 0.0
    if word.isdigit() or target.isdigit():
        return None
    if target in formal:
        return 0.4
    if MISSING in word and len(word) == len(target) and all(x in (y, MISSING) for x, y in zip(word, target)) and word.count(MISSING) < len(word):
        return 0.5
    if len(word) == 1:
        return 1.2 if target[0] == word else None
    if target.startswith(word) and (short or len(word) >= 3):
        return 0.8
    cost = slipped(word, target)
    if cost is not None:
        return cost
    if short and len(word) >= 4 and any(distance(word, target[:k], 1) is not None for k in (len(word) - 1, len(word), len(word) + 1) if k < len(target)):
        return 1.6
    return None


def assign(costs: list[list[float | None]]) -> float | None:
    """Least sum of costs that gives every row a column of its own; None if there is no way. Shortest augmenting paths,
    so names of any number of words are compared."""
    n, m = len(costs), len(costs[0])
    if n > m:
        return None
    none = 1e6
    c = [[none if x is None else x for x in row] for row in costs]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while owner[at]:
            used[at] = True
            row, step, to = owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = c[row - 1][j - 1] - u[row] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    total = sum(c[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])
    return None if total >= none / 2 else total


def name_cost(spelling: list[tuple[str, bool, list[str]]], person: list[str]) -> float | None:
    """Cost of the cheapest way to give every word of the spelling a word of its own in the person's name. Initials alone
    stand for a name that has them all in this order; numbers must be the same."""
    if not spelling or sorted(w for w, _, _ in spelling if w.isdigit()) != sorted(w for w in person if w.isdigit()):
        return None
    if all(len(w) == 1 and not w.isdigit() for w, _, _ in spelling):
        whole = len(spelling) > 1 and [w for w, _, _ in spelling] == [p[0] for p in person]
        return 1.2 * len(spelling) if whole and all(len(p) > 1 for p in person) else None
    best = assign([[word_cost(w, s, tuple(f), p) for p in person] for w, s, f in spelling])
    if best is not None:
        best += 0.05 * (len(person) - len(spelling))
    if best is None and len(spelling) > 1 and spelling[0][:2] == ("m", True):  # "M." is Master or Mistress as often as a first name
        title = name_cost(spelling[1:], person)
        best = None if title is None else title + 1.5  # less likely than the initial of a namesake
    return best


@lru_cache(None)
def _segments(n: int) -> list[tuple[int, int]]:
    """Begin and end of the segments of ``n`` letters."""
    at = [n * i // (EDITS + 1) for i in range(EDITS + 2)]
    return list(zip(at, at[1:]))


def _index(word: str) -> list[str]:
    """Keys under which a word of a person's name is found: its beginnings and their last segments, and its own first and
    last one. One slip breaks at most two segments side by side, so the first or the last stays; of two slips in a long
    word the middle segment may be the one that stays."""
    n = len(word)
    keys = [f"p{word[:k]}" for k in range(1, min(n, HEAD) + 1)]
    for m in range(LEAST_WORD, min(n, HEAD)):
        a, e = _segments(m)[-1]
        keys.append(f"b{m}.{word[a:e]}")
    if n >= LEAST_WORD:
        keys += [f"{n}.{i}.{word[a:e]}" for i, (a, e) in enumerate(_segments(n)) if i != 1 or slips(word) > 1]
    return keys


def _probes(word: str, short: bool, formal: list[str], alone: bool) -> list[str]:
    """Keys that a word of a spelling looks up: itself as a beginning, its formal names, substrings at shifted places."""
    if word.isdigit():
        return [f"p{word[:HEAD]}"]
    keys = [f"p{f[:HEAD]}" for f in formal]
    start = word[:HEAD].split(MISSING)[0]
    if start and (len(word) > 1 or alone):
        keys.append(f"p{start}")
    n = len(word)

    def shifted(kind: str, a: int, e: int, k: int) -> Iterator[str]:
        for p in range(max(0, a - k), min(n - (e - a), a + k) + 1):
            part = word[p : p + e - a]
            if MISSING not in part:
                yield f"{kind}.{part}"

    if n >= LEAST_WORD:
        for m in range(max(LEAST_WORD, n - 2), n + 3):
            k, parts = slips("x" * m), _segments(m)
            if abs(m - n) <= k:
                keys.append(f"{m}.0.{word[: parts[0][1]]}")
                for i in range(EDITS if k == 1 else 1, EDITS + 1):
                    keys += shifted(f"{m}.{i}", *parts[i], k)
        for m in (n - 1, n, n + 1) if short and n > LEAST_WORD else ():
            keys.append(f"p{word[: max(2, _segments(m)[0][1])]}")  # a single letter would ask for every name with it
            keys += shifted(f"b{m}", *_segments(m)[-1], 1)
    return [k for k in dict.fromkeys(keys) if MISSING not in k]


_KEYS = T.ArrayType(T.StringType())
_WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("short", T.BooleanType())]))


@F.pandas_udf(_WORDS)
def _words(names: pd.Series) -> pd.Series:
    return names.map(lambda n: [{"word": w, "short": s} for w, s in words(n)])


@F.pandas_udf(_KEYS)
def _index_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda n: sorted({k for w in n.split() for k in _index(w)}))


@F.pandas_udf(_KEYS)
def _probe_keys(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: sorted({k for spelling in [_decode(c)] for w, s, f in spelling for k in _probes(w, s, f, all(len(x) == 1 for x, _, _ in spelling))}))


def _decode(code: str) -> list[tuple[str, bool, list[str]]]:
    out = []
    for part in code.split(" "):
        word, short, *formal = part.split("/")
        out.append((word, short == "1", formal))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        code, person = b.column("code").to_pylist(), b.column("person").to_pylist()
        own, theirs = b.column("about").to_pylist(), b.column("person_about").to_pylist()
        costs = []
        for c, p, x, y in zip(code, person, own, theirs):
            cost = name_cost(_decode(c), p.split())
            if cost is not None and x and y:  # a description that the list of roles gives to the person speaks for them
                cost = cost - 1.0 if x in y.split("\n") else cost + 1.0
            costs.append(cost)
        yield pa.RecordBatch.from_arrays([b.column("tcp"), b.column("name"), b.column("target"), pa.array(costs, pa.float64())], names=["tcp", "name", "target", "cost"])


def _best(spellings: DataFrame, persons: DataFrame) -> DataFrame:
    """``(tcp, name, target, cost, n)``: the best persons of each spelling, n > 1 if none is clearly the best."""
    # only hashes of keys and ends travel; pairs are joined back to their strings, which are what is verified
    spellings = spellings.withColumn("nid", F.xxhash64("tcp", "name"))
    persons = persons.withColumn("pid", F.xxhash64("tcp", "target"))
    index = persons.select("pid", "tcp", F.explode(_index_keys("person")).alias("key")).select(F.xxhash64("tcp", "key").alias("h"), "pid")
    probes = spellings.select("nid", "tcp", F.explode(_probe_keys("code")).alias("key")).select(F.xxhash64("tcp", "key").alias("h"), "nid")
    ends = probes.join(index, "h").select("nid", "pid").distinct()
    pairs = ends.join(spellings, "nid").join(persons.select("pid", F.col("tcp").alias("play"), "target", "person", "person_about"), "pid").where("tcp = play and name <> target")
    costs = pairs.mapInArrow(_verify, "tcp string, name string, target string, cost double").where(F.col("cost") <= MOST)
    near = costs.withColumn("least", F.min("cost").over(W.partitionBy("tcp", "name"))).where(F.col("cost") < F.col("least") + MARGIN)
    return near.withColumn("n", F.count("*").over(W.partitionBy("tcp", "name")))


def link_names(table: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(tcp, person, name)``: the spellings of each person of each play that stands under two or more names.

    ``table(tcp, normalized_name, role_description)``, ``catalogue(tcp, roles)``. All joins are by play and key,
    so a name that is in every play meets only the names of its own play.

    Edge cases: rows with a null play or name count for nothing, as do names without a letter; names with a
    number ("1. Lord") are only linked with those of the same number; repeated rows count once; null descriptions, plays that
    the catalogue lacks and null lists of roles only take evidence away; a spelling that fits two persons
    equally well is not linked; other columns are ignored; empty tables give no rows.
    """
    known = table.where("tcp is not null and normalized_name is not null").select("tcp", F.col("normalized_name").alias("name"), F.nullif(F.trim("role_description"), F.lit("")).alias("about"))
    names = known.groupBy("tcp", "name").agg(F.max("about").alias("about")).withColumn("words", _words("name")).where(F.size("words") > 0)

    roles = catalogue.where("tcp is not null and roles is not null").select("tcp", F.explode(parse_roles("roles")).alias("r"))
    roles = roles.select("tcp", _words("r.name").alias("words"), F.regexp_replace("r.description", NEXT_TITLE, "").alias("about")).where(F.size("words") > 0)
    capital = (F.upper("name") == F.col("name")) & F.col("name").rlike(r"\p{L}{2}") & ~F.col("name").contains(MISSING)
    joined = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    listed = roles.select("tcp", joined.alias("person"), F.nullif(F.regexp_replace("about", r"[\s.;|]+$", ""), F.lit("")).alias("about"))
    # capitals tell a person only in a play that prints other names otherwise; what the list has is a person in any
    mixed = names.groupBy("tcp").agg(F.max(F.upper("name") != F.col("name")).alias("mixed"))
    names = names.join(mixed, "tcp").withColumn("person", joined)
    names = names.join(listed.select("tcp", "person", F.lit(True).alias("listed")).distinct(), ["tcp", "person"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    names = cut(names.withColumn("own", capital & (F.col("mixed") | F.col("listed"))).select("tcp", "name", "about", "words", "person", "own", "listed"))
    spoken = names.where("own").select("tcp", "person", "about")
    persons = cut(listed.unionByName(spoken).groupBy("tcp", "person").agg(F.array_join(F.array_sort(F.collect_set("about")), "\n").alias("person_about")).withColumn("target", F.concat(F.lit("="), F.col("person"))))

    called = F.lower(F.regexp_extract("person_about", r"called (\p{L}+)", 1))
    nick = persons.select(F.split("person", " ")[0].alias("formal"), _words(called).alias("w")).where(F.size("w") == 1)
    nick = nick.groupBy(F.col("w")[0]["word"].alias("word")).agg(F.array_sort(F.collect_set("formal")).alias("formal"))  # first names of one nickname

    rest = names.where("not own").select("tcp", "name", "about", F.posexplode("words").alias("pos", "w")).select("tcp", "name", "about", "pos", "w.word", "w.short")
    rest = rest.join(nick, "word", "left").withColumn("part", F.concat_ws("/", "word", F.col("short").cast("int").cast("string"), F.array_join(F.coalesce("formal", F.array().cast("array<string>")), "/")))
    rest = rest.withColumn("part", F.regexp_replace("part", "/+$", ""))
    codes = rest.groupBy("tcp", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), " ").alias("code"), F.max("about").alias("about"))
    codes = cut(codes)

    first = cut(_best(codes, persons))
    linked = first.where("n = 1").select("tcp", F.col("target").alias("person"), "name")

    left = cut(codes.join(first.select("tcp", "name").distinct(), ["tcp", "name"], "left_anti"))
    plain = F.array_join(F.transform(F.split("code", " "), lambda p: F.split(p, "/")[0]), " ")
    among = left.select("tcp", F.col("name").alias("target"), plain.alias("person"), F.coalesce("about", F.lit("")).alias("person_about")).where(~F.col("person").contains(MISSING) & F.col("person").rlike(r"[^ ]{2}"))
    second = cut(_best(left, among))
    node = lambda c: F.struct("tcp", F.col(c).alias("name"))
    groups = components(second.where("n = 1").select(node("name").alias("a"), node("target").alias("b")))
    groups = cut(groups.select("node.tcp", F.col("label.name").alias("head"), "node.name"))
    # a spelling that fits several equally well belongs to them if they are one person
    several = second.where("n > 1").join(groups.select("tcp", F.col("name").alias("target"), "head"), ["tcp", "target"], "left").withColumn("head", F.coalesce("head", "target"))
    several = several.groupBy("tcp", "name").agg(F.min("head").alias("head"), F.max("head").alias("other")).where("head = other").select("tcp", "head", "name")
    members = groups.unionByName(several)
    members = members.unionByName(members.select("tcp", "head", F.col("head").alias("name")))
    alone = members.select("tcp", F.concat(F.lit("~"), F.col("head")).alias("person"), "name").distinct()

    # names in capitals that no list has: slips of another person's name, with the same initial
    unlisted = names.where("own and not listed").select("tcp", F.concat(F.lit("="), "person").alias("name"), F.max("about").over(W.partitionBy("tcp", "person")).alias("about"), F.concat_ws(" ", F.transform(F.split("person", " "), lambda w: F.concat(w, F.lit("/0")))).alias("code")).distinct()
    third = _best(unlisted, persons).where((F.col("n") == 1) & (F.col("cost") <= SAME_CAPITALS) & (F.substring("name", 2, 1) == F.substring("target", 2, 1)))
    merged = components(third.select(node("name").alias("a"), node("target").alias("b")))
    merged = merged.select("node.tcp", F.col("node.name").alias("person"), F.col("label.name").alias("head"))

    own = names.where("own").select("tcp", F.concat(F.lit("="), "person").alias("person"), "name")
    everyone = own.unionByName(linked).unionByName(alone).join(merged, ["tcp", "person"], "left")
    everyone = everyone.select("tcp", F.coalesce("head", "person").alias("person"), "name").distinct()
    return everyone.withColumn("k", F.count("*").over(W.partitionBy("tcp", "person"))).where("k > 1").drop("k")


def variant_pairs(links: DataFrame) -> DataFrame:
    """``(tcp, name_a, name_b)`` of every two spellings of a person; a person has few spellings."""
    a, b = links.withColumnRenamed("name", "name_a"), links.withColumnRenamed("name", "name_b")
    return a.join(b, ["tcp", "person"]).where("name_a < name_b").select("tcp", "name_a", "name_b").distinct()
