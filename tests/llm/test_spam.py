import pytest
from lexiframe.llm import spam

TEXT = (
    "The old bridge was closed for repairs, and the people of the town had to walk around the lake. Nobody knew when it would be opened again. "
    "A letter from the council said that the work had begun in spring. It was not clear why the builders had left in June. "
)
STUFFED = "cheap green shoes buy shoes online best green shoes sale shoes cheap shoes green shoes deals buy green shoes " * 4
SPAM = [
    STUFFED,
    "best red lamp, cheap red lamp, lamp sale, red lamp online, buy lamp, cheap lamp deals, red lamp price, lamp lamp, best lamp sale, lamp online " * 2,
    "\n".join(f"lake house {i} - http://shop{i}.example/page/{i}" for i in range(20)),
    " ".join(f"#buycheaplamp #lampsale{i}" for i in range(20)),
    "Lake Tent | River Boots | Sun Lamp | Moon Tent | Star Lamp | Hill Boots | Tree Tent | Wind Lamp | Rain Boots | Sea Tent",
    "\n".join(f"Old Lamp A{i} ${i}.99 Add to cart" for i in range(12)),
    "Our new tent is the best tent for tent buyers in Lund. Buy tent in Rome at the tent store for tent. " * 6,
    "便宜词典购买词典热卖词典折扣词典优惠词典批发词典" * 5,
    "Lampe kaufen, Lampe billig, Lampe Angebot, Lampe günstig, Lampe Preis, Lampe Versand, Lampe neu, Lampe Rabatt, " * 3,
    "ch34p sh03s 0nl1ne sh0es ch3ap shoes b​uy s​hoes cheap sh0es best shoes deals shoes sale " * 4,
]
FINE = [
    TEXT,
    TEXT * 3 + STUFFED[:100],
    "\n".join(f"LOC Town{i}" for i in range(40)),
    "\n".join(f"word{i} NN O" for i in range(40)),
    "\n".join(f"iter {i} loss {i}.5 P 90.1 R 80.2 F1 85.0" for i in range(20)),
    "\n".join(f"tent pole{i}: a long tent which the camper sets up when the wind of Lund moves it." for i in range(10)),
    "\n".join(f"[{i}] A. Writer, 19{i + 10}. The book of the river was read by all. http://papers.example/{i}" for i in range(10)),
    "", None, "  \n",
]


def test_kinds(spark):
    rows = [(i, t, None if i % 3 else "en") for i, t in enumerate(SPAM)] + [(100 + i, t, "und") for i, t in enumerate(FINE)] + [(200 + i, TEXT, "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id for r in spam.found(df).collect()}
    assert got == set(range(len(SPAM)))
    s = {r.doc_id: (r.n_tokens, r.n_spam) for r in spam.scores(df).collect()}
    assert s[107] == s[108] == s[109] == (0, 0) and len(s) == len(rows)


PROSE = {
    "ru": "Старый мост закрыли на ремонт, и жителям города приходилось обходить озеро. Никто не знал, когда его снова откроют. "
    "В письме совета говорилось, что работы начались весной. Было неясно, почему строители ушли в июне. ",
    "it": "Il vecchio ponte era chiuso per lavori e gli abitanti della città dovevano girare intorno al lago. Nessuno sapeva quando sarebbe stato riaperto. "
    "Una lettera del consiglio diceva che i lavori erano cominciati in primavera. Non era chiaro perché gli operai fossero andati via a giugno. ",
    "pl": "Stary most zamknięto z powodu remontu i mieszkańcy miasta musieli obchodzić jezioro. Nikt nie wiedział, kiedy zostanie znowu otwarty. "
    "W liście rady napisano, że prace zaczęły się wiosną. Nie było jasne, dlaczego robotnicy odeszli w czerwcu. ",
    "el": "Η παλιά γέφυρα έκλεισε για επισκευές και οι κάτοικοι της πόλης έπρεπε να περπατούν γύρω από τη λίμνη. Κανείς δεν ήξερε πότε θα άνοιγε ξανά. ",
    "en": TEXT,
}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.mark.parametrize("label", ["own", None, "en"])
def test_prose_of_other_languages(spark, label):
    """Single and repeated paragraphs of languages without a list, with and without the right label."""
    rows = [(200 + i, TEXT, "en") for i in range(30)]
    for i, (lang, t) in enumerate(PROSE.items()):
        said = lang if label == "own" else label
        rows += [(i, t, said), (10 + i, t * 2, said), (20 + i, (t + "\n") * 4, said), (30 + i, t * 9, said)]
    assert spam.found(_docs(spark, rows)).count() == 0


def test_a_language_is_learned(spark):
    """Function words of a language without a list come from its documents, and its spam is found."""
    verbs = "zamknięto otwarto malowano sprzedano kupiono widziano".split()
    nouns = "most dom ogród zegar rynek okno list".split()
    prose = [(i, " ".join(f"Nie było jasne, czy {nouns[(i + j) % 7]} i {nouns[(i * 3 + j + 1) % 7]} w mieście {verbs[(i + j) % 6]}, ale to się nie stało." for j in range(5)), "pl") for i in range(40)]
    stuffed = "tanie buty buty kup buty online buty najlepsze buty promocja buty wyprzedaż tanie buty sklep buty rabat " * 5
    bare = "buty rabat sklep zima ceny moda lato tanio buty rabat sklep zima ceny moda lato tanio nowe marki wygoda styl " * 4
    df = _docs(spark, [*prose, (900, stuffed, "pl"), (901, bare, "pl")])
    assert "nie" in spam.learn(df)["pl"] and {r.doc_id for r in spam.found(df).collect()} == {900, 901}


def test_repeated_word_pairs(spark):
    base = [(200 + i, f"{TEXT} It was seen by {i} of them.", "en") for i in range(30)]
    pairs = "lamp shade desk lamp wall light desk lamp wall light lamp shade garden chair lamp shade garden chair desk lamp " * 4
    assert {r.doc_id for r in spam.found(_docs(spark, [*base, (1, pairs, "en"), (2, pairs, "en")])).collect()} == {1, 2}


@pytest.mark.parametrize("n", [1, 39, 41, 95, 400])
def test_windows_cover_the_whole_line(n):
    line = " ".join(f"w{i}" for i in range(n))
    assert " ".join(spam.units(line)).split() == line.split()
    assert "".join(spam.unspaced_units("词" * n)) == "词" * n


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, STUFFED * 300, "en", 0)], "doc_id bigint, text string, lang string, units int")
    assert spam.found(df).count() == 1 and spam.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("w,form", [("ch34p", "cheap"), ("0nl1ne", "online"), ("Word", "word"), ("a17", "a17"), ("1999", "1999")])
def test_word_form(w, form):
    assert spam.word_form(w) == form
