"""Text, segmentation and extraction expressions against values worked out by hand."""

import re

from pyspark.sql import functions as F

from tabularium.functions import extract, segment, text


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())




def T():
    return F.col("t")


ARTICLES = "ARTICLE 1 - La TVA est due au taux de 19% selon l'article 5 du présent code.\nARTICLE 2 bis - La retenue est de 1000 dinars."


def test_tokens_fold_accents_and_ligatures(spark):
    assert one(spark, "L'Œuvre DÉFÉRÉE, n° 12 — été", text.tokens(T()))[0] == ["l", "oeuvre", "deferee", "n", "12", "ete"]
    assert one(spark, None, text.tokens(T()))[0] is None
    assert one(spark, "", text.tokens(T()))[0] == []


def test_strip_takes_every_blank(spark):
    assert one(spark, " \t a b \n", text.strip(T()))[0] == "a b"


def test_types_by_name_have_different_precedence(spark):
    assert one(spark, "Note_code.pdf", text.type_by_name(T()), text.category(T())) == ("code", "note")
    assert one(spark, "recueil.pdf", text.category(T()))[0] == "code"
    assert one(spark, "x.pdf", text.category(T()))[0] == "loi"
    assert one(spark, "x.pdf", text.document_type(T(), F.lit("NOTE COMMUNE n° 3")))[0] == "note_commune"
    assert one(spark, "x.pdf", text.document_type(T(), F.lit(None).cast("string")))[0] == "loi"


def test_table_markdown_keeps_the_repeated_header(spark):
    df = spark.createDataFrame([([["H1", "H2"], ["a", None], ["b\nc"]], ["H1", "H2"])], "rows array<array<string>>, heads array<string>")
    md, once, prose = df.select(text.table_markdown(F.col("rows"), F.col("heads")), text.table_markdown(F.col("rows"), F.col("heads"), True), text.table_prose(F.col("rows"), F.col("heads"))).first()
    assert md == "| H1 | H2 |\n| --- | --- |\n| H1 | H2 |\n| a |  |\n| b c |  |"
    assert once == "| H1 | H2 |\n| --- | --- |\n| a |  |\n| b c |  |"
    assert prose == "H1: H1. H2: H2.\nH1: a.\nH1: b\nc."


def test_escapes_runs_and_markdown(spark):
    assert one(spark, "a<b & 'c'", text.xml_escape(T()))[0] == "a&lt;b &amp; &apos;c&apos;"
    assert one(spark, "x\ny", text.word_runs(T()))[0].count("<w:br/>") == 1
    assert one(spark, "**a** *b* `c`\nd", text.light_markdown(T()))[0] == "<strong>a</strong> <em>b</em> <code>c</code><br/>d"


def test_highlight_and_stop_words(spark):
    assert one(spark, "<em>DE</em> <em>TVA</em>", text.unmark_stop_words(T()))[0] == "de <em>TVA</em>"
    assert one(spark, "la tva due", text.highlight(T(), ["TVA"]))[0] == "la <em>tva</em> due"
    assert one(spark, "x" * 400, text.highlight(T(), ["tva"]))[0] == "x" * 300 + "…"


def test_short_values(spark):
    assert one(spark, "d", text.short_reference(T(), F.lit(2024), F.lit(4), F.lit(" Art. 3 ")), text.short_reference(T(), F.lit(0), F.lit(4), F.lit(""))) == ("d — 2024 — p.4 — Art. 3", "d — p.4")
    assert one(spark, "a" * 601, text.truncated(T(), 600))[0] == "a" * 600 + "…"
    assert one(spark, " A ", text.text_key(T()))[0] == one(spark, "A", text.text_key(T()))[0]
    assert one(spark, "", text.title_of(T()))[0] == "Sans titre"
    assert one(spark, "k", text.label_of(T(), {"k": "Label"}))[0] == "Label"


def test_segments_rejoin_to_the_text(spark):
    pattern = r"(?m)^ARTICLE"
    parts = one(spark, ARTICLES, segment.cut_before(T(), pattern))[0]
    assert parts[0] == "" and len(parts) == 3 and "".join(parts) == ARTICLES


def test_matches_agree_with_finditer(spark):
    s = "é19% 𝒳 7,5 % fin 3%"
    got = one(spark, s, segment.matches(T(), r"\d+(?:,\d+)? ?%"))[0]
    assert [(m.text, m.offset) for m in got] == [(m.group(), m.start()) for m in re.finditer(r"\d+(?:,\d+)? ?%", s)]
    assert one(spark, "none", segment.matches(T(), r"\d"))[0] == []


def test_packing_is_greedy(spark):
    assert one(spark, "Aa bb. Cc dd. Ee.", segment.packed_paragraphs(T(), 14))[0] == ["Aa bb. Cc dd.", "Ee."]
    assert one(spark, "x\n1) un\n2) deux", segment.packed_paragraphs(T(), 9))[0] == ["x\n1) un", "2) deux"]
    assert one(spark, "", segment.packed_paragraphs(T(), 9))[0] == [""]


def test_sentences_fill_windows_with_overlap(spark):
    text = "un deux trois. quatre cinq six. sept huit neuf. dix"
    assert one(spark, text, segment.sentence_windows(T(), 8, 4))[0] == ["un deux trois. quatre cinq six.", "quatre cinq six. sept huit neuf.", "sept huit neuf. dix"]
    assert one(spark, text, segment.sentence_windows(T(), 8, 0))[0] == ["un deux trois. quatre cinq six.", "sept huit neuf. dix"]
    long = one(spark, "mot " * 50, segment.sentence_windows(T(), 8, 2))[0]
    assert " ".join(long).split().count("mot") >= 50 and all(len(x.split()) <= 8 for x in long)
    assert one(spark, None, segment.sentence_windows(T()))[0] == [] and one(spark, "  ", segment.sentence_windows(T()))[0] == []
    assert one(spark, "a b c d. e", segment.sentence_windows(T(), 14, 5, F.length))[0] == ["a b c d. e"]


def test_extraction_of_references_and_amounts(spark):
    first = ARTICLES.split("\n")[0]
    assert one(spark, first, extract.article_refs(T()))[0] == ["ARTICLE 1", "l'article 5"]
    assert one(spark, first, extract.cross_refs(T()))[0] == ["Art. 5 présent code"]
    got = one(spark, ARTICLES, extract.thresholds(T()))[0]
    assert [(t.value, t.full_text) for t in got] == [("19", "19%"), ("1000", "1000 dinars")]
    assert one(spark, "TVA au taux", extract.concepts(T()))[0] == ["TVA", "taux"]
    assert one(spark, "tva", extract.concepts(T()))[0] == []
    assert one(spark, "dégrèvement dégrevement dégreve degrevm", extract.concepts(T()))[0] == ["dégreve", "degrevm"]
    assert one(spark, "ARTICLE 2 bis - x", extract.article_key(T()))[0] == "Art. 2 bis"


def test_entities_are_capped_and_in_order(spark):
    got = one(spark, ARTICLES, extract.entities(T()))[0]
    assert ("TVA", "tax_concept") in got and ("19 19%", "threshold") in got and len(got) <= 15


def test_legal_terms(spark):
    seen = "Au sens « établissement stable ».\nSociété dénommé \"Mère\".\nau sens « établissement stable ». Au sens de la loi. Means ab."
    code, convention = one(spark, seen, extract.legal_terms(T()), extract.legal_terms(T(), "convention"))
    assert [x.strip() for x in code] == ["établissement stable", 'Mère"', "de la loi"]
    assert [x.strip() for x in convention] == ["établissement stable", "de la loi"]
    assert len(one(spark, "\n".join(f"au sens terme{i}" for i in range(12)), extract.legal_terms(T()))[0]) == 10
