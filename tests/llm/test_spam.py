from promptbook.llm.spam_pages import spam_pages, spam_shares

SPEECH = "Of a crooked circle, we conjured the cauldrons; I would now enchant the incantation of each imp. The raven under thy circle did mutter, and thou wast gone from me. "
SPAM = {
    1: "ruff, wig, skull prop playbook playbook wig, quarto wig, ink set ink set playbook, quarto, playbook, skull prop, skull prop, ink set wig wig wig",
    2: '<a href="https://a.test/x">ink set</a>\n<a href="www.b.test/y">theatre ticket</a>\n<a href="http://c.test/">parchment</a>',
    3: "Cheap ruff, new ruff, old ruff. Buy ruff here and get ruff today. Our ruff beats any other ruff. Ruff is the best ruff you can find. Cheap ruff, new ruff, old ruff. ",
    4: "skullprop, doublet, playbook$27.99, theatre ticket $51.99, mask size 1, goblet $59.99, wig bargain, playbook 2 for 1, costume",
    5: "* Buy Lute https://a.invalid/q.html\n> Deal Lute https://b.invalid/p?id=8\n- Bargain Audio Play www.c.test/playbook.html",
    6: SPEECH + "poster poster, poster, stage dagger, poster, playbook playbook, playbook stage dagger poster, stage dagger playbook poster, stage dagger, stage dagger, playbook playbook poster playbook stage dagger poster stage dagger, stage dagger poster",
}
FAIR = {
    10: SPEECH * 5,
    11: SPEECH + "\n\nLinks: https://a.test/x https://b.test/y www.c.test/z",
    12: "The Persons of the Play.\nSperosthenes, a waiting gentlewoman.\nMelello, an envious courtier.\nNervimon, an old counsellor.\nMardatius, brother to the Duke.",
    13: "Come a tunefuller cymbals, I did warble thee in my galliards.\nWith hey, with ho, the measure and the viol oh,\nThe treble of his viols must tune a viol!\nWith hey, with ho, the measure and the viol oh,\nFrom the lawful choir she came to me.\nWith hey, with ho, the measure and the viol oh,",
    14: "burrow: a word for what the keeper would call the burrow of the house.\nhound: a word for what the forest would call the kennel of the house.\nthickets: a word for what the quarry would call the hunters of the house.",
    15: "Dans et bague la nuit chanson pour dans ne une. Mon chanson pas bague il de vous forest pas elle. Nous une le ton ne pas berger poignard reine dans juge.",
    16: SPEECH * 3 + "wig, ruff, quarto, poster, mask",
    17: "Exit.",
}
EDGE = {20: None, 21: "", 22: " \n ", 23: "... !!", 24: SPEECH * 3000, 25: SPAM[1] * 500}


def frame(spark):
    pages = {**SPAM, **FAIR, **EDGE}
    return spark.createDataFrame([(i, t, "x", 7) for i, t in [*pages.items(), (1, SPAM[1])]], "doc_id long, text string, id string, n_words int")


def test_spam_is_flagged_and_writing_is_not(spark):
    assert {r.id for r in spam_pages(frame(spark), "doc_id", "text").collect()} == {*SPAM, 25}


def test_edges(spark):
    got = {r.id for r in spam_shares(frame(spark), "doc_id", "text").collect()}
    assert got == {*SPAM, *FAIR, 24, 25}
    assert spam_shares(frame(spark).where("false"), "doc_id", "text").count() == 0


STEADY = {
    30: "Buy the best ruff at our shop today. " * 100,
    31: "Get your tickets for the new play here and we will seat you tonight. " * 100,
    32: "".join(f"Buy the best {w} at our shop today. " for w in ["ruff", "wig", "mask", "lute", "quill"] * 12),
    33: "Order a fine printed quarto with gilded edges or a sturdy leather binding from this bookseller because prices fall every single week and delivery costs nothing. " * 40,
}


def test_keyword_sentences_at_a_steady_distance_are_flagged(spark):
    pages = spark.createDataFrame([*STEADY.items(), (40, SPEECH * 100), *FAIR.items()], "doc_id long, text string")
    assert {r.id for r in spam_pages(pages, "doc_id", "text").collect()} == {*STEADY}


OTHER = {
    50: "Litwo! Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie. Panno święta, co jasnej bronisz Częstochowy i w Ostrej świecisz Bramie.",
    51: "Det var en gång en prins, han ville ha sig en prinsessa, men det skulle vara en riktig prinsessa. Så reste han hela världen runt för att hitta en sådan, men överallt var det något i vägen. Prinsessor fanns det nog av, men om det var riktiga prinsessor, det kunde han inte alls bli klok på.",
    52: "Het was nu al diep in de nacht en de wind ging om het oude huis als een hond die zijn baas zoekt. Zij zat bij het vuur en dacht aan wat hij haar had gezegd toen zij nog jong was en niets van de wereld wist.",
    53: "В начале жизни школу помню я; там нас, детей беспечных, было много; неровная и резвая семья. Смиренная, одетая убого, но видом величавая жена над школою надзор хранила строго.",
}
TAGS_ELSEWHERE = {60: "peruka, maska, kostium, lutnia, kaptur, rękawiczki, sztylet, korona, plakat, bilet, kurtyna, lalka, pergamin, kałamarz, peleryna, szpada"}


def test_writing_in_other_languages_is_not_flagged(spark):
    pages = spark.createDataFrame([*OTHER.items(), *TAGS_ELSEWHERE.items()], "doc_id long, text string")
    assert {r.id for r in spam_pages(pages, "doc_id", "text").collect()} == {60}


def test_one_keyword_at_an_unvaried_gap_is_flagged(spark):
    import random

    rng = random.Random(4)
    filler = [f"w{a}{b}ord"[: 4 + k % 3] for k, (a, b) in enumerate((x, y) for x in "abcdefghij" for y in "klmnopqrst")]
    page = lambda gap: " ".join(w for _ in range(22) for w in ["playbook", *(rng.choice([*filler, *["the", "of", "and", "to"] * 15]) for _ in range(gap() - 1))])
    pages = spark.createDataFrame([(1, page(lambda: 15)), (2, page(lambda: rng.randint(9, 21)))], "doc_id long, text string")
    assert {r.id for r in spam_pages(pages, "doc_id", "text").collect()} == {1}
