from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptbook.llm.name_variants import _index, _probes, assign, distance, link_names, slipped, slips, variant_pairs, words

ROLES = "ELIZABETH RANSHAW, a pedant, called Bess; THOMAS STANBOURNE, a merchant, called Tom; Old ANTHONY STANBOURNE, a host, called Tony; MELINA, a page; MELINUS, a pedant; VELTULPHO, a hermit; SERVANT, attending"
NAMES = ["ELIZABETH RANSHAW", "THOMAS STANBOURNE", "ANTHONY STANBOURNE", "MELINA", "MELINUS", "SERVANT", "1. Lord", "2. Lord"]
VARIANTS = {"Elizabeth Ranſhaw": "ELIZABETH RANSHAW", "Ransahw": "ELIZABETH RANSHAW", "Ranshaw, Elizabeth": "ELIZABETH RANSHAW", "Bess": "ELIZABETH RANSHAW", "E. Ranshaw": "ELIZABETH RANSHAW", "Mistris Ranshavv": "ELIZABETH RANSHAW", "Rans •": "ELIZABETH RANSHAW", "Tom Stanbourne": "THOMAS STANBOURNE", "Thom. Stan:": "THOMAS STANBOURNE", "Melyna": "MELINA", "mELINUS": "MELINUS", "Serv": "SERVANT", "A Seruant": "SERVANT"}


def tables(spark, names, roles=ROLES, tcp="A1"):
    table = spark.createDataFrame([(tcp, n, None, "clash", i) for i, n in enumerate(names)], "tcp string, normalized_name string, role_description string, target string, code int")
    return table, spark.createDataFrame([(tcp, roles, "x")], "tcp string, roles string, person string")


def found(spark, names, **kw):
    return {(r.tcp, r.name_a, r.name_b) for r in variant_pairs(link_names(*tables(spark, names, **kw))).collect()}


def test_variants_reach_their_person_and_no_other(spark):
    got = {frozenset(p[1:]) for p in found(spark, [*NAMES, *VARIANTS, "Stanbourne", "Veltulhpo.", "Lord Veltvlpho"])}
    person = VARIANTS | {n: n for n in NAMES}
    everyone = list(person)
    want = {frozenset((a, b)) for a in everyone for b in everyone if a < b and person[a] == person[b]}
    want.add(frozenset(("Veltulhpo.", "Lord Veltvlpho")))
    assert got == want


def test_names_of_other_plays_and_ambiguous_names_stay_apart(spark):
    table = tables(spark, ["SERVANT"], tcp="A1")[0].unionByName(tables(spark, ["Servant"], tcp="A2")[0])
    catalogue = spark.createDataFrame([("A3", "X")], "tcp string, roles string")
    assert variant_pairs(link_names(table, catalogue)).count() == 0


def test_spellings_without_a_listed_person_find_each_other(spark):
    assert found(spark, ["Selavstro", "Lord Selvastro", "Sel."], roles=None) == {("A1", "Lord Selvastro", "Selavstro"), ("A1", "Sel.", "Selavstro"), ("A1", "Lord Selvastro", "Sel.")}


def test_m_is_an_initial_rather_than_a_title(spark):
    names = ["MARY HOLBURY", "ROBERT HOLBURY", "ROBERT UPMERE", "M. Holbury", "M. Upmere"]
    assert found(spark, names, roles=None) == {("A1", "M. Holbury", "MARY HOLBURY"), ("A1", "M. Upmere", "ROBERT UPMERE")}


def test_nulls_blanks_repeats_and_nothing(spark):
    names = ["KING JOHN", "KING JOHN", "King Iohn", None, "", " ", "•", "...", "x" * 3000]
    assert found(spark, names, roles=None) == {("A1", "KING JOHN", "King Iohn")}
    t, c = tables(spark, NAMES)
    assert link_names(t.where("false"), c.where("false")).count() == 0


@pytest.mark.parametrize("a,b,ok", [("presford", "presofrd", True), ("presford", "presfrd", True), ("presford", "pressford", True), ("presford", "presf•rd", True), ("melinus", "melina", False), ("melandro", "melandra", False), ("philoria", "philorius", False), ("abcd", "badc", False), ("rosencrantz", "rosincrontz", True), ("tom", "thom", True), ("tom", "bom", False)])
def test_slips(a, b, ok):
    assert (slipped(a, b) is not None) is ok and (slipped(b, a) is not None) is ok


PAIRS = [["HAMLET", "HAMLETT"], ["Tom", "Tomm"], ["Tom", "Thom"], ["R0BERT", "ROBERT"], ["R0bert", "Robert"], ["J. S.", "JOHN SMITH"], ["Rosencrantz", "Rosincrontz"], ["ROSENCRANTZ", "ROSINCRONTZ"], ["HAM.", "HAMLET"], ["Hamlet", "HAMLET"], ["A Tall Thin Grave Learned Patient Clerk", "Patient Learned Grave Thin Tall Clerke"], ["1. Watchman", "1 WATCHMAN"]]


def test_no_kind_of_name_is_left_out(spark):
    """With capitals only, without any, with digits, of many words, of initials; in a play of one way of printing and of two."""
    plays = {f"A{i}": names for i, names in enumerate(PAIRS)} | {f"B{i}": [*names, "OPHELIA", "Ophelia"] for i, names in enumerate(PAIRS)}
    table = spark.createDataFrame([(tcp, n, None) for tcp, names in plays.items() for n in names], "tcp string, normalized_name string, role_description string")
    got = {(r.tcp, r.name_a, r.name_b) for r in variant_pairs(link_names(table, spark.createDataFrame([], "tcp string, roles string"))).collect()}
    assert got == {(tcp, *sorted(names[:2])) for tcp, names in plays.items()} | {(tcp, "OPHELIA", "Ophelia") for tcp in plays if tcp[0] == "B"}


def test_different_names_stay_apart(spark):
    names = ["HAMLET", "HAMLETA", "1. Watchman", "2. Watchman", "Watchman", "J. S.", "JOHN TAYLOR", "PHILORIA", "PHILORIUS", "Ned", "Tom"]
    assert found(spark, names, roles=None) == {("A1", "HAMLET", "HAMLETA")}
    assert found(spark, names[2:], roles=None) == set()


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=3, max_size=12), st.text("abc", min_size=3, max_size=12))
def test_banded_distance_and_shared_segments(a, b):
    full = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    plain = [row[:] for row in full]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            for t in (full, plain):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                full[i][j] = min(full[i][j], full[i - 2][j - 2] + 1)
    for k in (1, 2, 3):
        assert distance(a, b, k) == (full[-1][-1] if full[-1][-1] <= k else None)
    near = full[-1][-1] <= 1 or slips(b) == 2 and plain[-1][-1] <= 2
    if near and abs(len(a) - len(b)) <= slips(b):
        assert set(_probes(a, False, [], True)) & set(_index(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=4, max_size=4), min_size=1, max_size=4))
def test_assignment_is_the_cheapest(costs):
    ways = [sum(costs[i][j] for i, j in enumerate(p)) for p in permutations(range(4), len(costs)) if all(costs[i][j] is not None for i, j in enumerate(p))]
    assert assign(costs) == (min(ways) if ways else None)


def test_words():
    assert words("Sir Thom. Stan •") == [("thom", True), ("stan", True)]
    assert words("Ranſhaw, VVilliam") == [("ranshaw", False), ("william", False)]
    assert words(None) == [] and words("1. Lord") == [("1", False), ("lord", False)] and words("R0bert") == [("robert", False)]
