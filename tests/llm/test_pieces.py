import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptbook.llm.text_pieces import cut_text, pieces


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n,;ſé!"), max_size=400), st.integers(2, 40), st.data())
def test_pieces_give_the_text_back(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    cuts = cut_text(text, limit, overlap)
    assert all(e - a <= limit for a, e in cuts)
    assert all(b[0] == a[1] - overlap or b[0] == 0 for a, b in zip(cuts, cuts[1:]))
    whole = text[cuts[0][0] : cuts[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(cuts, cuts[1:]))
    assert whole == text and len(cuts) == 1 if len(text) <= limit else len(cuts) > 1


def test_cuts_at_the_most_natural_place():
    text = "One sentence here. Another one there.\n\nA new paragraph. Short end."
    assert [text[a:e] for a, e in cut_text(text, 45, 0)] == ["One sentence here. Another one there.\n\n", "A new paragraph. Short end."]
    assert cut_text("word " * 4, 11, 0) == [(0, 10), (10, 20)]
    assert cut_text("x" * 25, 10, 2) == [(0, 8), (6, 16), (14, 24), (22, 25)]


def test_operator_edges(spark):
    rows = [("a", "x" * 30), ("b", ""), ("c", None), ("d", "y" * 10), ("e", "z" * 200_000)]
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "cid string, text string, piece_no int, piece string")
    got = pieces(df, "cid", "text", 10, 3)
    n = {r.id: (r["count"]) for r in got.groupBy("id").count().collect()}
    assert set(n) == {"a", "b", "d", "e"} and n["b"] == n["d"] == 1 and n["a"] > 3
    assert got.where("n_chars > 10 or n_chars <> length(piece)").count() == 0
    assert pieces(df.where("false"), "cid", "text", 10, 3).count() == 0
    with pytest.raises(ValueError):
        pieces(df, "cid", "text", 10, 10)
