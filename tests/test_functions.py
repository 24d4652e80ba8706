import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptbook.functions import text as T
from promptbook.functions.matching import lcs, token_set_ratio
from promptbook.functions.roles import parse_roles
from promptbook.operators.excerpts import HALF, passages

ODD = ["", " ", "a•b  c\n", "Haſ-te, ÉLAN!", "x\x1cy\x85z w", "haſte café abc1 wee'l dog", "İstanbul café _a a_b", "ß ẞ ﬁne Ⅷ", "tab\tand\x0bvertical", "  lead and trail  ", "A" * 5000, "<a href='x'>&amp;\"</a>", "日本語 text ok"]


def column(spark, f, values=ODD):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def python_match(s):
    if not isinstance(s, str):
        return ""
    s = unicodedata.normalize("NFKC", s).replace("ſ", "s").replace("ß", "ss")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip().lower()


def clip(text, n):
    head = text[:n]
    return text if len(text) <= n else (head.rsplit(" ", 1)[0] if " " in head else head) + "…"


def test_text_functions_follow_python(spark):
    values = [*ODD, None]
    assert column(spark, T.normalize_for_match) == [python_match(v) for v in values]
    assert column(spark, T.clean_speech) == [re.sub(r"\s+", " ", (v or "").replace("•", " ")).strip() for v in values]
    assert column(spark, T.collapse) == [None if v is None else re.sub(r"\s+", " ", v).strip() for v in values]
    assert column(spark, T.n_words)[:-1] == [len(v.split()) for v in ODD]
    terms = column(spark, lambda c: F.regexp_extract_all(F.lower(c), F.lit(T.TERM), 1))
    assert terms[:-1] == [[w for w in re.findall(r"\w+", v.lower()) if re.fullmatch("[a-z]{3,}", w)] for v in ODD]
    assert column(spark, lambda c: T.truncate(c, 9)) == [clip(re.sub(r"\s+", " ", v or "").strip(), 9) for v in values]


def test_ids_and_names(spark):
    assert column(spark, T.display_name, ["__crowd__", " Inf • "]) == ["[crowd]", "INF •", None]
    assert column(spark, T.slugify, ["A1::KING JOHN", "É–ſt", "::", "a-b__c"]) == ["A1_KING_JOHN", "E_st", "untitled", "a-b_c", "untitled"]
    assert column(spark, T.html_escape, ["<a & 'b'>\""]) == ["&lt;a &amp; &#x27;b&#x27;&gt;&quot;", ""]
    assert column(spark, T.top_words, ["a, b ,,c", ""]) == [["a", "b", "c"], [], []]


def test_labels_and_orders(spark):
    df = spark.createDataFrame([(-1, ["x"]), (3, ["a", "b", "c", "d"]), (4, [])], "cluster int, words array<string>")
    assert [r[0] for r in df.select(T.label_for(F.col("cluster"), F.col("words"))).collect()] == ["-1: outliers", "3: a, b, c", "4"]
    df = spark.createDataFrame([(v,) for v in ("Unknown", "1600s", "1590s", "c.1580")], "d string")
    assert [r.d for r in df.orderBy(*T.decade_rank(F.col("d"))).collect()] == ["1590s", "1600s", "c.1580", "Unknown"]


def test_highlight_marks_whole_words_and_keeps_entities(spark):
    df = spark.createDataFrame([("Amp & Ampere, the King's king kingdom.", ["king", "amp"]), ("a <b>", [])], "t string, k array<string>")
    got = [r[0] for r in df.select(T.highlight(F.col("t"), F.col("k"))).collect()]
    assert got == ["<mark>Amp</mark> &amp; Ampere, the <mark>King</mark>&#x27;s <mark>king</mark> kingdom.", "a &lt;b&gt;"]


def test_roles(spark):
    texts = ["King JOHN OF GAUNT, uncle; ACT I", "HENRY III, a king", "no names", "KING, " + "word " * 200, "ÆNEAS; CAFÉ-KEEPER"]
    read = [[(r["name"], r["description"]) for r in row] for row in column(spark, parse_roles, texts)]
    assert read[:3] == [[("JOHN", "OF"), ("GAUNT", "uncle;")], [("HENRY III", "a king")], []]
    assert read[3][0][1].endswith("word…") and len(read[3][0][1]) <= 401
    assert read[4] == [("KEEPER", "")] and read[5] == []


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
def test_ratio_properties(a, b):
    assert lcs(a, b) == brute_lcs(a, b)
    r = token_set_ratio(a, b)
    assert 0 <= r <= 100 and r == token_set_ratio(b, a)
    if set(a.split()) and set(a.split()) <= set(b.split()):
        assert r == 100


def test_ratio_values():
    assert token_set_ratio("virginius", "virginia") == 100 * (1 - (17 - 14) / 17)
    assert token_set_ratio("king", "king john") == 100
    assert token_set_ratio("", "x") == 0


def test_passages():
    text = "word " * 100 + "dagger here " + "word " * 100 + "dagger poison " + "word " * 100
    got = passages(text, ["poison", "dagger"], 5)
    assert [h for _, h in got] == [["poison", "dagger"], ["dagger"]]
    assert all(len(p) >= 2 * HALF for p, _ in got)
    assert passages(None, ["x"], 2) == [] and passages("text", [], 2) == [] and passages("İ dagger", ["dagger"], 1)[0][0] == "İ dagger"
