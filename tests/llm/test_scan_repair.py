import numpy as np
import pytest

from promptbook.llm import scan_repair as s
from promptbook.llm.boosting import Boosted

CLEAN = "/root/testdata/sf0.001/character_documents.parquet"


def run(spark, pages, clean, meta):
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "row_id long, tcp string, speech_text string, kind string, piece int")
    m = spark.createDataFrame(meta, "tcp string, title string")
    return {(r.row_id, r.kind, r.piece) for r in s.find_repairs(df, clean, m).collect()}


@pytest.fixture(scope="module")
def clean(spark):
    return spark.read.parquet(CLEAN).select("speech_text")


def test_held_out_pages_are_repaired(spark, clean):
    texts = [r.speech_text for r in clean.where("speech_text is not null").distinct().collect()]
    rng = np.random.default_rng(9)
    pages, want = [], set()
    for i, t in enumerate(sorted(texts)[:60]):
        lines, flags, breaks = s.typeset(" ".join(t.split()[:150]), "A Merry Tankard", rng)
        pages.append((i, "A1", "\n".join(lines)))
        want |= {(i, "hyphen", f"{a}-{b}" if h else a + b) for a, b, h in breaks if not any(c.isdigit() or c == s.MISSING for c in a + b)}
        for x, f in zip(lines, flags):
            if f:
                want.add((i, "page_no" if s._PAGE_LINE.fullmatch(x) else "header", s.squeeze(x)))
    got = run(spark, pages, clean, [("A1", "A Merry Tankard")])
    for kind in ("hyphen", "header", "page_no"):
        w, g = {x for x in want if x[1] == kind}, {x for x in got if x[1] == kind}
        assert len(w & g) / len(w) > 0.85, (kind, len(w), len(g), sorted(w - g)[:8])
        assert len(w & g) / len(g) > 0.75, (kind, sorted(g - w)[:8])


def test_known_cases(spark, clean):
    pages = [
        (1, "A1", "Too sha1l the captaine haue march thc siege in the year 1588,\nand thou ſhall sur-\nPage 35\nrender the garri-\nA MERRY TANKARD. 29\nson of my captaine, for the hell-\nhound did march of my garrison."),
        (2, "A1", "The captaine haue march sur- render A Merry Tankard [90] the garrison of my st•ll captaine Pag. 82 and the siege xl. did march."),
        (3, "A1", None),
        (4, "A1", "  "),
        (1, "A1", "A"),
        (None, "A1", "sha1l"),
    ]
    got = run(spark, pages, clean, [("A1", "A Merry Tankard"), (None, "x"), ("A9", None)])
    assert {(1, "char", "shall"), (1, "char", "the"), (1, "hyphen", "surrender"), (1, "hyphen", "garrison"), (1, "page_no", "Page 35"), (1, "header", "A MERRY TANKARD. 29")} <= got
    assert {(2, "hyphen", "surrender"), (2, "header", "A Merry Tankard [90]"), (2, "page_no", "Pag. 82"), (2, "page_no", "xl."), (2, "char", "still")} <= got
    assert not any("1588" in p for _, _, p in got) and {r for r, _, _ in got} == {1, 2}


def test_empty_tables_and_very_long_texts(spark, clean):
    none = clean.where("false")
    assert run(spark, [], none, []) == set()
    assert run(spark, [(1, "A1", "sha1l mar-\nch")], none, []) == {(1, "hyphen", "march")}
    assert (1, "char", "shall") in run(spark, [(1, None, "the captaine sha1l march " * 20_000)], clean, [])


def test_misreadings():
    assert s.misreading("sha1l", "shall") == [("1", "l", 3)]
    assert s.misreading("pilgrirn", "pilgrim") == [("rn", "m", 6)]
    assert s.misreading("shai1", "shall") == [("i", "l", 3), ("1", "l", 4)]
    assert s.misreading("capta•nz", "captaine") and s.misreading("capxaqne", "captaine")
    assert s.misreading("abc", "xbz") is None and s.misreading("same", "same") is None and s.misreading("qnd", "end") == [("q", "e", 0)]


def test_numbers_of_the_text_stay(spark, clean):
    """Also in texts without line ends: a number in place of a word is none of a page, one between words that go together is."""
    texts = [r.speech_text for r in clean.where("speech_text is not null").distinct().collect()]
    words = max(texts, key=len).split()[:40]
    foreign = [(i, "A1", " ".join([*words[:i], str(20 + i), *words[i:]])) for i in range(5, 35)]
    own = [(100 + i, "A1", " ".join([*words[:i], str(20 + i), "crowns", *words[i + 2 :]])) for i in range(5, 35)]
    got = run(spark, [*foreign, *own, (200, "A1", "I gave him 12 crowns and 40 pounds for the horse.")], clean, [("A1", "A Merry Tankard")])
    numbers = {r for r, kind, _ in got if kind == "page_no"}
    assert not numbers & {200, *range(100, 140)}
    assert len(numbers) > 20


def test_two_misreadings_and_a_title_in_lower_case(spark, clean):
    lines = ["Too shaI1 the captaine haue march the siege of thy", "garrison, and the captainc haue m•rch thy s•ege too", "a merry tankard", "shall the cap-", "taine haue march the siege of thy garrison, and thou"]
    got = run(spark, [(1, "A1", "\n".join(lines))], clean, [("A1", "A Merry Tankard")])
    assert {(1, "char", "shall"), (1, "char", "captaine"), (1, "char", "siege"), (1, "hyphen", "captaine"), (1, "header", "a merry tankard")} <= got


def test_known_words_are_settled_exactly_beyond_the_common_ones(spark, clean, monkeypatch):
    pages = [(1, "A1", "The captaine sha1l march the siege, and his captaine shall not march.")]
    before = run(spark, pages, clean, [("A1", "A Merry Tankard")])
    monkeypatch.setattr(s, "COMMON_WORDS", 3)
    after = run(spark, pages, clean, [("A1", "A Merry Tankard")])
    assert before == after == {(1, "char", "shall")}


def scan(text, rng, width=44):
    """Pages set by another rule than that of ``typeset``: fixed width, one mark, every 9th word broken, every 14th misread."""
    out, want, line = [], set(), ""
    for i, word in enumerate(text.split()):
        core = "".join(c for c in word if c.isalpha())
        if i % 14 == 5 and core == word and len(word) > 4 and word.islower():
            k = int(rng.integers(len(word)))
            want.add(("char", word))
            word = word[:k] + s.MISSING + word[k + 1 :]
        elif i % 9 == 4 and core == word and len(word) > 6 and word.islower():
            want.add(("hyphen", word))
            out.append(f"{line} {word[:4]}-".strip())
            line = word[4:]
            continue
        if len(line) + len(word) > width:
            out.append(line)
            line = ""
            if len(out) % 15 == 0:
                out.append(f"[{len(out)}]")
                want.add(("page_no", out[-1]))
        line = f"{line} {word}".strip()
    return "\n".join([*out, line]), want


def test_noise_of_another_kind(spark, clean):
    texts = sorted(r.speech_text for r in clean.where("length(speech_text) > 300").distinct().collect())[:60]
    rng = np.random.default_rng(3)
    made = [scan(t, rng) for t in texts]
    got = run(spark, [(i, "A1", t) for i, (t, _) in enumerate(made)], clean, [("A1", "A Merry Tankard")])
    want = {(i, *w) for i, (_, ws) in enumerate(made) for w in ws}
    assert len(want & got) / len(want) > 0.9
    assert len(want & got) / len(got) > 0.8


def test_compounds_and_title_spans():
    assert s.title_span("85 The Tragedic of Thrasippus Thou", "the tragedie of thrasippus") == "85 The Tragedic of Thrasippus"
    assert s.title_span("Alas Fie Soft", "the tragedie of thrasippus") is None


def test_index_finds_every_single_misreading():
    for word in ("of", "the", "clad", "captaine", "pilgrim"):
        for i in range(len(word)):
            form = word[:i] + s.MISSING + word[i + 1 :]
            assert set(s.probe_keys(form)) & set(s.index_keys(word)), form
            other = form.replace(s.MISSING, "z")
            for j in range(len(word) if len(word) > s.SHORT_WORD else 0):  # and every two of a long word
                two = other[:j] + "k" + other[j + 1 :]
                assert set(s.probe_keys(two)) & set(s.index_keys(word)), two
    for read, printed in (("pilgrirn", "pilgrim"), ("rnartial", "martial"), ("cornet", "comet"), ("dad", "clad"), ("proda", "procla"), ("orade", "oracle"), ("lirnb", "limb")):
        assert s.misreading(read, printed) and set(s.probe_keys(read)) & set(s.index_keys(printed)), read


def test_boosting_learns_and_is_deterministic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    a, b = Boosted().fit(x[:3000], y[:3000]), Boosted().fit(x[:3000], y[:3000])
    p = a.predict(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.95 and (p == b.predict(x[3000:])).all()
    assert Boosted().fit(np.zeros((2, 1)), np.array([0, 1])).predict(np.zeros((0, 1))).shape == (0,)
