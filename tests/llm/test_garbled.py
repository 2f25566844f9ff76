"""Detection and restoration on clean, garbled and merely unusual texts."""

import random

import pytest

from siltstone.llm import garbled as g

SENTENCES = {
    "fr": ["Le ministère a prévu une dépense élevée à l’été.", "Où sont passés les élèves de la forêt ?", "Voilà très précisément ce qu’ils ont décidé.", "La côte a été gâtée par l’hiver « précoce »."],
    "de": ["Der frühere Bürgermeister prüft die Brücke – über Jahre.", "Für die Höfe fließt künftig mehr Geld.", "Die Wärme in den Räumen wäre größer.", "„Natürlich“, sagte die Präsidentin über das Gebäude."],
    "pl": ["Połowa posłów głosowała za poprawką o łąkach.", "Proszę o głos, mówił żółty sąsiad.", "Przebudowę szpitala zaczęto w środę.", "Się nie zgadzają, lecz właśnie zapłaciła."],
    "es": ["El señor ministro habló del año próximo.", "La educación pública está aquí, según él.", "¿Quién pagará mañana la sesión?", "Así llegó la campaña del café."],
    "en": ["The café in Brünnholm isn’t far – they say.", "“Naïve résumés” cost £5 under § 12.", "It’s a plain sentence without much.", "The pensioners’ forum met twice."],
}
DECOYS = ["SÃO MATIAS – º e ª.", "CHÂTEAU, ÂGE, TÂCHE.", "Formula: ƒ(x) = xⁿ ± ½.", "Area: 1 250 m², 90 m³, 4°.", "Новый Берег and שלום.", "cafe\u0301 decomposed", "緑の谷市 👍🏽", "PELA ÚLTIMA VEZ: NÃO", "Price: £5, €7, ¥900; ® and ™"]


def corpus(n=1500, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rnd.choice(list(SENTENCES))
        out.append(" ".join(rnd.choice(SENTENCES[lang]) for _ in range(6)) + (" " + rnd.choice(DECOYS) if rnd.random() < 0.2 else ""))
    return out


@pytest.fixture(scope="module")
def model():
    texts = corpus()
    rnd = random.Random(2)
    for i in rnd.sample(range(len(texts)), 60):  # the corpus it is fitted on is itself not clean
        made = g.garble(texts[i], g.CHAINS[rnd.choice(list(g.CHAINS))])
        texts[i] = made if made is not None else texts[i]
    return g.Model().fit(texts)


def test_clean_texts_stay(model):
    assert [t for t in corpus(400, seed=9) if model.judge(t) is not None] == []


@pytest.mark.parametrize("chain", [c for c in g.CHAINS if c.startswith("utf-8>")])
def test_utf8_chains_are_restored_exactly(model, chain):
    for lang, sentences in SENTENCES.items():
        text = " ".join(sentences)
        made = g.garble(text, g.CHAINS[chain])
        got = model.judge(made)
        assert got is not None and got[1] == text, (chain, lang, made, got)


@pytest.mark.parametrize("chain, langs", [("cp1252>cp850", "fr de es"), ("cp1252>mac_roman", "fr de es"), ("cp1250>cp1252", "pl"), ("iso8859-2>latin-1", "pl")])
def test_single_byte_chains(model, chain, langs):
    for lang in langs.split():
        text = " ".join(SENTENCES[lang])
        if (made := g.garble(text, g.CHAINS[chain])) is None:
            text = text.replace("’", "'").replace("„", '"').replace("“", '"').replace("–", "-")
            made = g.garble(text, g.CHAINS[chain])
        got = model.judge(made)
        assert got is not None and got[1] == text, (chain, lang, made, got)


def test_one_garbled_passage(model):
    text = " ".join(SENTENCES["de"] * 5)
    passage = SENTENCES["de"][0]
    made = text.replace(passage, g.garble(passage, g.CHAINS["utf-8>cp1252"]), 1)
    assert model.judge(made)[1] == text


def test_lost_characters_are_reported_and_kept(model):
    made = "Der fr\ufffdhere B\ufffdrgermeister"
    assert model.judge(made) == (g.LOSSY, made, False)


@pytest.mark.parametrize("text", ["", "plain ascii", "x" * 100_000, "é" * 50_000, *DECOYS])
def test_edge_texts(model, text):
    assert model.judge(text) is None


def test_inversion_is_strict():
    assert g.invert("plain", g.CHAINS["utf-8>cp1252"]) is None
    assert g.invert("Ã©", g.CHAINS["utf-8>cp1252"]) == "é" and g.invert("ÃN", g.CHAINS["utf-8>cp1252"]) is None


def test_table(spark):
    texts = corpus(600)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    bad = {7: "utf-8>cp1252", 8: "utf-8>latin-1", 9: "utf-8>cp1251"}
    rows = [(i, g.garble(t, g.CHAINS[bad[i]]) if i in bad else t, x) for i, t, x in rows]
    rows += [rows[7], (9001, None, "x"), (9002, "", "x"), (None, rows[8][1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chain string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.restored == texts[8 if r.doc_id is None else r.doc_id]) for r in g.find(df).collect())
    assert got == [(-1, True), (7, True), (7, True), (8, True), (9, True)]
    assert g.find(df.limit(0)).count() == 0


def test_one_rare_word_of_a_one_byte_chain_by_counts_of_all_texts(spark):
    texts = corpus(600)
    texts[3] += " Frühprüfer"  # the only other occurrence
    texts[5] = texts[5] + " It stands beside the other one: " + g.garble("Frühprüfer", g.CHAINS["cp1252>cp850"])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(r.doc_id, r.restored) for r in g.find(df, sample=300).collect()]
    assert got == [(5, texts[5].replace(g.garble("Frühprüfer", g.CHAINS["cp1252>cp850"]), "Frühprüfer"))]


def test_rare_originals_count_for_a_chain(model):
    word, back = g.garble("früheste", g.CHAINS["cp1252>cp850"]), "früheste"
    for there in (0, 1, 3, 10, 40):
        model.words, model.own = {back: there}, {}
        assert model.gain(word, back) >= g.LEAST_SINGLE
        assert model.gain(back, word) < 0


def test_the_rest_of_a_text_with_lost_characters_is_restored(model):
    texts = [" ".join(SENTENCES[lang]) for lang in SENTENCES] * 8
    for text in texts:
        made = "\ufffd " + g.garble(text, g.CHAINS["utf-8>cp1252"])
        chain, restored, complete = model.judge(made)
        assert restored == "\ufffd " + text and not complete and chain.startswith(g.LOSSY + ", utf-8>")
    one = " ".join(SENTENCES["pl"])
    one = one.replace("„", '"').replace("’", "'")
    chain, restored, complete = model.judge("\ufffdx " + g.garble(one, g.CHAINS["cp1250>cp1252"]))
    assert restored == "\ufffdx " + one and not complete


def test_many_passages_are_all_restored(model):
    good = " ".join(SENTENCES["pl"])
    bad = g.garble("Przebudowę szpitala zaczęto w środę, mówił żółty sąsiad.", g.CHAINS["cp1250>cp1252"])
    text = (good + " ") + " ".join(f"{bad} {good}" for _ in range(7))
    chain, restored, complete = model.judge(text)
    assert chain == "cp1250>cp1252" and complete
    assert restored == text.replace(bad, "Przebudowę szpitala zaczęto w środę, mówił żółty sąsiad.")


def test_the_classifier_alone(spark, model):
    text = " ".join(SENTENCES["de"])
    assert model.predict(g.garble(text, g.CHAINS["utf-8>cp1252"])) == ("utf-8>cp1252", text)
    assert model.predict("plain") is None and model.predict("") is None
    assert model.predict("Der fr\ufffdhere B\ufffdrgermeister")[0] == g.LOSSY
    rows = [(i, t) for i, t in enumerate(corpus(600))] + [(700, g.garble(text, g.CHAINS["utf-8>cp1252"])), (None, None), (701, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert (700, "utf-8>cp1252", text) in [tuple(r) for r in g.predicted(df).collect()]
    assert g.predicted(df.limit(0)).count() == 0


def test_a_garbled_text_delivered_often_is_still_found(spark):
    good = " ".join(SENTENCES["pl"]).replace("„", '"')
    bad = g.garble("Przebudowę szpitala zaczęto w środę, mówił żółty sąsiad. Się nie zgadzają, lecz właśnie zapłaciła.", g.CHAINS["cp1250>cp1252"])
    rows = list(enumerate([*corpus(900), good])) + [(10_000 + i, bad) for i in range(450)]  # a third of all rows
    got = {r.doc_id: r.restored for r in g.find(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), sample=400).collect()}
    assert set(got) == set(range(10_000, 10_450))
    assert set(got.values()) == {"Przebudowę szpitala zaczęto w środę, mówił żółty sąsiad. Się nie zgadzają, lecz właśnie zapłaciła."}


def test_the_classifier_knows_what_stands_late_in_one_long_text(spark):
    hebrew = "הישיבה נפתחה בבוקר והשר דיבר על התקציב החדש של העיר"
    texts = [*corpus(600), "plain words " * 2000 + hebrew]  # after 24,000 characters, nowhere else
    bad = "Before it stood this: " + g.garble(hebrew, g.CHAINS["utf-8>mac_roman"])
    df = spark.createDataFrame(list(enumerate([*texts, bad])), "doc_id bigint, text string")
    assert [(r.doc_id, r.chain, r.restored) for r in g.find(df).collect()] == [(601, "utf-8>mac_roman", "Before it stood this: " + hebrew)]


def test_the_classifier_knows_one_text_among_very_many(spark):
    hebrew = "הישיבה נפתחה בבוקר והשר דיבר על התקציב החדש של העיר"
    texts = [f"№ {i} café" for i in range(40_000)] + [hebrew, "Before it stood this: " + g.garble(hebrew, g.CHAINS["utf-8>mac_roman"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [(r.doc_id, r.restored) for r in g.find(df).collect()] == [(40_001, "Before it stood this: " + hebrew)]


def test_the_fit_of_a_table_is_that_of_all_its_texts(spark):
    texts = corpus(900) + ["緑の谷市" * 30 + f" שלום {i}" for i in range(3)]  # words over 64 characters, pairs beyond the alphabet
    for i in range(0, 900, 20):
        texts[i] = g.garble(texts[i], g.CHAINS["utf-8>latin-1"])
    texts = list(dict.fromkeys(texts))
    alone = g.Model().fit(texts)
    model, counted = g.fit(spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(3))
    counts = {r.key: r.n for r in counted.collect()}
    assert (model.weights == alone.weights).all() and model.total == alone.total and model.floor == alone.floor
    assert {k: n for k, n in counts.items() if k[0] != " "} == dict(alone.words)
    model.words = counts
    for word in ("緑の谷市", "市緑", "שלום", "é", "Ã©"):
        assert model.reads(word) == pytest.approx(alone.reads(word))
    assert {p for p in alone.bigrams if p not in model.bigrams} == {k[1:] for k in counts if k[0] == " "}
