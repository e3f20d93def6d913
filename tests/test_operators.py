"""Relational operators: search, graph, chunkers, tables, reports, components, streaming, files."""

import datetime

import pytest
from pyspark.sql import Row, functions as F

from tabularium.functions import text
from tabularium.operators import chunkers, graph, report, running, search, tables
from tabularium.operators.components import connected_components
from tabularium.plans.latest import latest_rows
from tabularium.plans.staging import staged
from tabularium.sources import files
from tabularium.streaming import ingest


def test_bm25_ranks_rarer_and_shorter_first(spark):
    df = spark.createDataFrame([(1, "tva tva retenue"), (2, "tva"), (3, "autre texte"), (4, None), (5, "")], "id int, text string")
    got = search.top(search.bm25(df, "text", "TVA"), 10, "id").collect()
    assert [r.id for r in got] == [1, 2] or [r.id for r in got] == [2, 1]
    assert search.bm25(df, "text", " - ").count() == 0
    filtered = search.bm25(df, "text", "tva", F.col("id") > 1).collect()
    assert [round(r.score, 9) for r in filtered] == [round(r.score, 9) for r in got if r.id == 2] or filtered[0].id == 2


def test_fuzzy_terms_respect_the_length(spark):
    vocab = spark.createDataFrame([("facture", 3), ("factures", 1), ("tva", 2), ("tv", 1)], "term string, df int")
    got = {(r.query_term, r.term) for r in search.fuzzy_terms(vocab, ["factur", "tv"]).collect()}
    assert got == {("factur", "facture"), ("factur", "factures"), ("tv", "tv")}


def test_facets_sum_to_the_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert search.facet(df, "k").collect() == [Row(value="a", n=2), Row(value="b", n=1)]


def test_same_page_pairs(spark):
    df = spark.createDataFrame([("a", "d", 1), ("b", "d", 1), ("c", "d", 1), ("x", "d", 2), ("n", None, 1), ("a", "d", 1)], "id string, doc_name string, page_num int")
    got = sorted(map(tuple, graph.same_page(df).collect()))
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
    assert {r.id: r.n_links for r in graph.same_page_rows(df).collect()} == {"a": 2, "b": 2, "c": 2, "x": 0}


def test_topic_score_takes_the_first_field(spark):
    df = spark.createDataFrame([("la tva", "Art. 3", None, "tva.pdf", "1", 1)], "text string, article_ref string, section_title string, doc_name string, id string, page_num int")
    assert graph.topic_search(df, ["tva", "art", ""], 5).first().score == 3.5
    assert graph.topic_search(df, [], 5).count() == 0


def test_vector_topk_skips_unusable(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [0.6, 0.8])], "id int, v array<float>")
    assert [(r.id, r.similarity) for r in graph.vector_topk(df, "id", "v", [2.0, 0.0], 3).collect()] == [(1, 1.0), (5, 0.6)]


def test_merge_keeps_the_best_score(spark):
    a, b = (spark.createDataFrame(x, "id string, score double") for x in ([("x", 1.0), ("y", 2.0)], [("x", 3.0)]))
    assert [tuple(r) for r in graph.merge_ranked(a, b).collect()] == [("x", 3.0), ("y", 2.0)]


def test_law_chunks(spark):
    text = "p" * 60 + "\nArt. 1 - un\nArt. 2 bis - " + "x" * 1990 + "\n1) a\n2) b"
    docs = spark.createDataFrame([("d", "loi.pdf", text), ("e", "loi2.pdf", "rien"), ("f", "loi3.pdf", "")], "document_id string, filename string, text string")
    got = {r.chunk_id: r for r in chunkers.index_chunks(docs).collect()}
    assert set(got) == {"d_preamble", "d_art_1", "d_art_2 bis_p1", "d_art_2 bis_p2", "e_full", "f_full"}
    assert got["d_art_2 bis_p2"].content.endswith("2) b") and got["d_art_2 bis_p2"].part == 2


def test_note_chunks(spark):
    text = "RESUME\nbref\nI. Champ\nintro\nA. Qui\nx\nB. Quoi\ny\nII. Taux\nz"
    docs = spark.createDataFrame([("n", "note.pdf", text)], "document_id string, filename string, text string")
    got = {r.chunk_id: r.content for r in chunkers.index_chunks(docs).collect()}
    assert got["n_resume"] == "RESUME\nbref" and got["n_sec_I_A"] == "I. Champ\n\nA. Qui\nx" and got["n_sec_II"] == "II. Taux\nz"


def test_legal_chunks_carry_heading_and_page(spark):
    pages = spark.createDataFrame([("d", 1, "DISPOSITIONS GENERALES DE LOI\nArt. 1 - a", 1), ("d", 2, "Art. 2 - b", 2)], "doc_name string, page_num int, text string, ord int")
    got = chunkers.legal_article_chunks(chunkers.joined_pages(pages)).orderBy("ord").collect()
    assert [(r.article_ref, r.page_num) for r in got] == [("Art. 1", 1), ("Art. 2", 2)]
    assert all(r.text.startswith("[DISPOSITIONS GENERALES DE LOI]\nArt.") for r in got)


def test_units_make_up_the_text_and_know_their_page(spark):
    pages = spark.createDataFrame([("d", 1, "avant\nArt. 1 - a", 1), ("d", None, "suite", 2), ("d", 3, "Art. 2 - b\nArt. 3 - c", 3), ("e", 5, "", 1)], "doc_name string, page_num int, text string, ord int").withColumn("extra", F.lit(1))
    docs = chunkers.joined_pages(pages)
    got = chunkers.placed_units(docs, chunkers._cut_units(chunkers.LEGAL_ARTICLE)).orderBy("doc_name", "ord").collect()
    assert "".join(r.raw for r in got if r.doc_name == "d") == docs.where("doc_name = 'd'").first().text
    assert [r.page_num for r in got] == [None, 1, 3, 3, 5] and got[3].before.endswith("Art. 2 - b\n")
    assert chunkers.placed_units(docs.limit(0), chunkers._cut_units(chunkers.LEGAL_ARTICLE)).count() == 0


def test_the_heading_is_found_over_many_short_articles(spark):
    text = "DISPOSITIONS RELATIVES AUX TAUX\n" + "".join(f"Art.{i}-\n" for i in range(40)) + "Art. 99 - fin"
    docs = spark.createDataFrame([("d", [Row(page=1, ord=1, text=text)], text)], "doc_name string, pages array<struct<page:int,ord:int,text:string>>, text string")
    rows = chunkers.placed_units(docs, chunkers._cut_units(chunkers.LEGAL_ARTICLE)).orderBy("ord").collect()
    assert all(r.before == text[max(0, r.start - 300) : r.start] for r in rows)


def test_documents_are_routed_by_name_and_text(spark):
    law, note = "Loi de finances\nDispositions\nArt. 1 - a", "Note commune\nOBJET : x\nI. Champ"
    rows = [("Code.pdf", law), ("convention.pdf", law), ("x.pdf", law), ("y.pdf", note), ("z.pdf", "Loi de finances. Dispositions"), ("w.pdf", "rien"), ("v.pdf", None)]
    pages = spark.createDataFrame([(n, 1, t, 1) for n, t in rows], "doc_name string, page_num int, text string, ord int")
    docs = chunkers.joined_pages(pages)
    kinds = {r[0]: r[1] for r in docs.select("doc_name", chunkers.chunker_of(F.col("doc_name"), F.col("text"))).collect()}
    assert kinds == {"Code.pdf": "code", "convention.pdf": "convention", "x.pdf": "loi", "y.pdf": "note", "z.pdf": "generic", "w.pdf": "generic", "v.pdf": "generic"}
    out = chunkers.graph_chunks(docs).collect()
    assert {r.doc_kind for r in out} == {"code", "convention", "loi", "note", "generic"} and {r.doc_name for r in out} == {n for n, t in rows if t}
    t = spark.createDataFrame([("x.pdf", 9, 0, [["a"], ["b"]], None, "native", None), ("x.pdf", 12, 1, [["a"]], None, None, "c"), ("q.pdf", None, 0, None, None, None, None)], "doc_name string, page_num int, table_index int, raw_data array<array<string>>, headers array<string>, method string, context_before string")
    both = chunkers.with_table_chunks(chunkers.graph_chunks(docs), tables.table_chunks(t), pages).where("doc_kind = 'table'").collect()
    assert {(r.page_num, r.chunk_type, r.article_ref) for r in both} == {(9, "table_markdown", "Art. 1"), (9, "table_prose", "Art. 1"), (12, "table_markdown", ""), (12, "table_prose", "")}
    assert next(r.text for r in both if r.page_num == 12 and r.chunk_type == "table_prose") == "[TABLE NARRATIVE – page 12]\nColonne 1: a."


def test_code_chunks(spark):
    text = "CHAPITRE I - Base\nSECTION 1 - Sec\nARTICLE 1 - La TVA au taux de 19%\nARTICLE 2 bis - fin de la retenue"
    docs = spark.createDataFrame([("c", [Row(page=7, ord=1, text=text)], text)], "doc_name string, pages array<struct<page:int,ord:int,text:string>>, text string")
    got = chunkers.code_chunks(docs).orderBy("_article_i").collect()
    assert [r.article_ref for r in got] == ["Art. 1", "Art. 2 bis"] and got[0].page_num == 7
    assert got[0].chapter_ref == "CHAPITRE I" and got[0].section_ref == "SECTION 1" and got[0].thresholds[0].value == "19"
    assert got[0].text.startswith("[CHAPITRE I]\n[SECTION 1]\nARTICLE 1\nARTICLE 1 - ")


def test_code_chunks_keep_legal_terms(spark):
    text = "ARTICLE 1 - Il est soumis au sens «revenu net» défini."
    docs = spark.createDataFrame([("c", [Row(page=1, ord=1, text=text)], text)], "doc_name string, pages array<struct<page:int,ord:int,text:string>>, text string")
    assert [chunkers.code_chunks(docs, kind).first().entities.legal_terms for kind in ("code", "convention")] == [["revenu net"]] * 2


def test_nearest_article_reaches_nine_pages(spark):
    a = spark.createDataFrame([("d", 3, 1, "Art. 1"), ("d", 9, 1, "Art. 2"), ("d", 9, 2, "Art. 3"), ("e", 60, 1, "Art. 9")], "doc_name string, page_num int, ord int, article_ref string")
    t = spark.createDataFrame([("d", 12, 1), ("d", 19, 2), ("e", 66, 3), ("x", 1, 4)], "doc_name string, page_num int, row int")
    assert {r.row: r.article_ref for r in chunkers.nearest_article(t, a).collect()} == {1: "Art. 3", 2: "", 3: "Art. 9", 4: ""}


def test_text_tables(spark):
    lines = ["a | b | c", "x\ty\tz", "p   q   r", "plain", "a | b | c", "d | e | f"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "id int, text string")
    assert [tuple(r)[:3] for r in tables.text_tables(df, "id", "text").collect()] == [(1, 0, 3)]


def test_word_boxes(spark):
    rows = [("w1", 0, 0, 30, 10, 90), ("w2", 100, 1, 30, 10, 90), ("w3", 0, 20, 30, 10, 90), ("low", 0, 20, 30, 10, 10), (" ", 0, 20, 1, 1, 99)]
    df = spark.createDataFrame([(1, *r) for r in rows], "page int, text string, left int, top int, width int, height int, conf int")
    got = {r.text: (r.line_no, r.column_no) for r in tables.word_columns(tables.word_rows(df, ["page"]), ["page"]).collect()}
    assert got == {"w1": (1, 1), "w2": (1, 2), "w3": (2, 1)}
    words = F.array(*[F.struct(F.lit(t).alias("top"), F.lit(t).alias("left"), F.lit(str(t)).alias("text")) for t in (0, 12, 13)])
    assert [[w.text for w in r] for r in spark.range(1).select(tables.anchored_rows(words)).first()[0]] == [["0", "12"], ["13"]]
    bounds = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 10), (10, 20))])
    assert tuple(spark.range(1).select(*[tables.column_of(F.lit(x), bounds) for x in (5, 10, 99)]).first()) == (0, 1, 1)


def test_context_and_sections(spark):
    df = spark.createDataFrame([(1, 1, "A", "d", 0, 2, None), (1, 2, " A ", "d", 0, 3, None), (1, 3, "B", "d", 2020, 4, "Art. 1")], "req int, ord int, text string, doc_name string, year int, page_num int, article_ref string")
    kept = report.distinct_texts(df, ["req"], "text", [F.col("ord")], 5)
    assert report.context_of(kept, "req", "text", "place").first().context == "[1] d — p.2\nA\n\n[2] d — 2020 — p.4 — Art. 1\nB"
    answer = "--- SECTION 1 : COMPRÉHENSION DES FAITS\nf\n--- SECTION 2 : ÉTENDUE\ne\n--- SECTION 3 SOMMAIRE\ns\n--- SECTION 4 ANALYSES\na\n--- SECTION 5 ABRÉVIATIONS\nTVA"
    got = spark.createDataFrame([(answer,)], "t string").select(report.generated_sections(F.col("t")).alias("s")).first().s
    assert tuple(got) == ("f", "e", "s", "a", "")  # a list of abbreviations has more than a hundred signs
    long = "TVA : taxe sur la valeur ajoutée. " * 4
    forms = [f"--- SECTION 5 DOCUMENTS ET ABRÉVIATIONS : {long}--- fin", f"5. DOCUMENTS ET ABRÉVIATIONS :\n{long}", f"Abréviations : {long}\nSources : x", "ABRÉVIATIONS : TVA", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(forms)], "i int, t string").select("i", report.generated_sections(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s.ABREVIATIONS for r in rows] == [long.strip()] * 3 + ["", ""] and rows[4].s.FAITS == ""
    assert spark.range(1).select(report.filled_template(F.lit("<{{X}}>"), {"X": F.lit("a&b")})).first()[0] == "<a&amp;b>"


def test_latest_rows_and_clashing_names(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, "a", t(2), "x"), (2, "a", t(1), "y"), (3, "b", None, "z"), (4, None, t(1), "n"), (5, None, t(1), "m")], "row_no int, k string, at timestamp, _keep string")
    assert sorted(r.row_no for r in latest_rows(df, ["k"], [F.col("at")], "row_no").collect()) == [1, 3, 5]
    assert latest_rows(df.limit(0), ["k"], [F.col("at")], "row_no").count() == 0


def test_running_values_cross_blocks(spark):
    df = spark.createDataFrame([(i, "g" if i % 3 else None, f"t{i}" if i % 7 == 0 else None) for i in range(100)], "i int, g string, t string")
    sums = {r.i: r.s for r in running.running_sum(df, "g", "i", F.when(F.col("i") > 0, F.col("i")), "s", block=8).collect()}
    held = {r.i: r.c for r in running.carried(df, "g", "i", "t", "c", block=8).collect()}
    for i in range(100):
        same = [j for j in range(i + 1) if bool(j % 3) == bool(i % 3)]
        assert sums[i] == sum(same) and held[i] == next((f"t{j}" for j in reversed(same) if j % 7 == 0), None)


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (None, 1)], "a int, b int")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(21)) and got[101] == 100 and len(got) == 23
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_stream_resumes_and_upserts(spark, tmp_path):
    src, log, at = (str(tmp_path / x) for x in ("in", "log", "cp"))
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "row int, k string, v int")
    one.coalesce(1).write.parquet(src)
    stream = lambda: ingest.stream_files(spark, src, one.schema, files_per_batch=1)
    ingest.run_available(stream(), at, ingest.append_log(log, F.col("v") > 0))
    spark.createDataFrame([(3, "a", 2), (4, "c", -1)], "row int, k string, v int").coalesce(1).write.mode("append").parquet(src)
    ingest.run_available(stream(), at, ingest.append_log(log, F.col("v") > 0))
    ingest.run_available(stream(), at, ingest.append_log(log, F.col("v") > 0))
    assert sorted(tuple(r) for r in ingest.current_state(spark, log, "k", [F.col("v")], "row").collect()) == [(2, "b", 1), (3, "a", 2)]
    assert spark.read.parquet(log + "_failed").where("k = 'c'").count() == 1


def test_late_rows_count_no_more(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: datetime.datetime(2024, 1, d, 12)
    schema = "ts timestamp, kind string"
    run = lambda: ingest.run_windows(ingest.windowed_counts(ingest.stream_files(spark, src, spark.createDataFrame([], schema).schema, files_per_batch=1), "ts", "2 days", "1 day", "kind").select(F.col("window.start").alias("day"), "kind", "n"), at)
    for rows in ([(day(1), "a"), (day(1), "a"), (day(10), "a")], [(day(9), "a"), (day(1), "late")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    got = {(r.day.day, r.kind): r.n for r in ingest.window_state(spark, at, ["day", "kind"]).collect()}
    assert got == {(1, "a"): 2, (9, "a"): 1, (10, "a"): 1}


def test_batches_are_counted_beyond_the_kept_progress(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(0, 4, 1, 4).write.parquet(src)
    seen = []
    n = ingest.run_available(ingest.stream_files(spark, src, spark.range(1).schema, files_per_batch=1), str(tmp_path / "cp"), lambda df, i: seen.append(i))
    assert n == len(set(seen)) == 4


def test_status_of_files(spark):
    rows = [("a", "failed", None, "x" * 400, "2024-01-01 10:00", None), ("a", "done", 5, None, "2024-01-02 10:00", "o"), ("b", "failed", None, "y" * 400, "2024-01-01 10:00", None), ("c", "in_progress", None, None, None, None), ("a", "in_progress", None, None, "2024-01-02 10:00", None)]
    state = ingest.latest_status(spark.createDataFrame(rows, "filename string, status string, chunks int, error string, timestamp_text string, output string"))
    got = {r.filename: r for r in state.collect()}
    assert (got["a"].status, got["a"].chunks, got["a"].output) == ("done", 5, "o") and len(got["b"].error) == 300 and got["c"].status == "in_progress"
    assert tuple(ingest.run_counters(spark.createDataFrame([("a",), ("b",), ("n",)], "filename string"), state).first()) == (1, 1, 2, 5)


def test_whole_json_files_and_templates(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a_processed.json").write_text('[\n  {"chunk_id": "1",\n   "content": "é"},\n  {"chunk_id": "2"}\n]')
    (tmp_path / "j" / "b.json").write_text("[]")
    rows = files.processed_json(spark, str(tmp_path / "j"), whole_files=True, glob="*_processed.json").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.content, r.source_file) for r in rows] == [("1", "é", "a_processed.json"), ("2", None, "a_processed.json")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<a>{{X}} é</a>")
        z.writestr("word/other.xml", "<b>{{X}}</b>".encode("utf-16"))
        z.writestr("media.bin", b"{{X}}")
    df = spark.createDataFrame([(1, bytearray(out.getvalue())), (2, bytearray(b"none")), (3, None)], "id int, content binary")
    got = {r.id: r for r in files.filled_documents(df, spark.createDataFrame([(1, {"X": "v&amp;"})], "id int, filled map<string,string>"), "id").collect()}
    with zipfile.ZipFile(io.BytesIO(got[1].content)) as z:
        assert z.read("word/document.xml").decode() == "<a>v&amp; é</a>" and z.read("word/other.xml").decode("utf-16") == "<b>v&amp;</b>" and z.read("media.bin") == b"{{X}}"
    assert got[2].content is None and got[2].error and got[3].error
    assert files.stored_chunks(spark.createDataFrame([("x" * 6000,), (None,)], "text string")).select(F.max(F.length("text"))).first()[0] == 5000


def test_islands_of_recognised_rows(spark):
    rows = [(1, f"a{y}", 0, y, 10, 8) for y in (0, 20, 40)] + [(1, f"b{y}", 50, y, 10, 8) for y in (0, 20, 40)] + [(1, "alone", 0, 60, 10, 8), (1, "c", 0, 80, 5, 8), (1, "d", 60, 80, 5, 8)]
    lines = tables.word_rows(spark.createDataFrame([(*r, 90) for r in rows], "page int, text string, left int, top int, width int, height int, conf int"), ["page"])
    assert [tuple(r) for r in tables.row_islands(lines, ["page"], 62, 200).collect()] == [(1, 1, 3, 0, 0, 62, 53)]


def test_ranks_and_facets(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 8.0), (3, 0.01), (4, 4.0)], "id int, score double")
    assert [(r.id, r.rank, r.percent) for r in search.ranked(df, "id").orderBy("rank").collect()] == [(2, 1, 100), (1, 2, 50), (4, 3, 50), (3, 4, 2)]
    rows = spark.createDataFrame([("a", 1, "tva"), ("a", None, "TVA x"), ("b", 1, "rien"), (None, 2, "tva")], "k string, v int, text string")
    got = {(r.field, r.value): r.n for r in search.facets(search.matching(rows, "text", "tva"), {"k": 5, "v": 1}).collect()}
    assert got == {("k", "a"): 2, ("v", "1"): 1}
    assert search.matching(rows, "text", " - ").count() == 0


def test_prompts_answers_and_helpers(spark):
    q = spark.createDataFrame([(1, "et {context} ?"), (2, None)], "id int, question string")
    c = spark.createDataFrame([(1, "loi")], "id int, context string")
    h = spark.createDataFrame([(1, 2, "assistant", "oui"), (1, 1, "user", "bonjour")], "id int, turn int, role string, text string")
    prompts = report.chat_prompts(q, c, h, "id", "{context}|{history}|{question}|{other}")
    assert {r.id: r.prompt for r in prompts.collect()} == {1: "loi|user: bonjour\nassistant: oui|et {context} ?|{other}", 2: "|||{other}"}
    assert {r.id: r.answer for r in files.answers(prompts, "id", "prompt", lambda p: 1 / 0).collect()} == {1: "", 2: ""}
    row = spark.createDataFrame([(datetime.datetime(2024, 5, 6, 7, 8, 9), 185.9, -1.0, "x" * 300)], "t timestamp, s double, n double, v string")
    assert tuple(row.select(text.stamp(F.col("t")), text.duration(F.col("s")), text.duration(F.col("n"))).first()) == ("2024-05-06 07:08", "3m 05s", None)
    got = {r.property: r.value for r in graph.properties(row.withColumn("k", F.lit(1)).withColumn("z", F.lit(None).cast("string")), "k").collect()}
    assert set(got) == {"t", "s", "n", "v"} and got["v"] == "x" * 200 + "... [TRUNCATED]"
    assert row.select(text.key_of("d", F.lit(3), "p")).first()[0] == "d_3_p"


def test_tables_of_pages(spark):
    t = spark.createDataFrame([(1, [["a", None], None, ["b", "c"]]), (2, [["a"]]), (3, None)], "id int, raw_data array<array<string>>")
    assert [(r.id, r.raw_data) for r in tables.usable_tables(t).collect()] == [(1, [["a", ""], ["b", "c"]])]
    f = spark.createDataFrame([("d", 2, 0, " x "), ("d", 3, 0, " "), ("d", 4, 0, None)], "doc_name string, page_num int, table_index int, text string")
    assert [r.text for r in tables.image_table_chunks(f).collect()] == ["[TABLE IMAGE — page 2]\nx"]
    pages = spark.createDataFrame([("x" * 10, 10000, 6000), ("x" * 10, 10000, 10), (None, 10000, None), ("x" * 100, 10000, 9000)], "t string, a int, i int")
    assert [tuple(r) for r in pages.select(tables.is_image_page(F.col("t"), F.col("a")), tables.is_image_page(F.col("t"), F.col("a"), F.col("i"))).collect()] == [(True, True), (True, False), (True, False), (False, False)]
    boxes = spark.createDataFrame([(2, 3, 200, 150), (0, 0, 90, 900), (500, 500, 300, 300)], '`left` int, top int, width int, height int').withColumn("w", F.lit(600)).withColumn("h", F.lit(700))
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in tables.table_regions(boxes, "w", "h").collect()) == [(0, 0, 207, 158), (495, 495, 600, 700)]


def test_forced_runs_and_keys_once(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.createDataFrame([(datetime.datetime(2024, 1, 1), "a"), (datetime.datetime(2024, 1, 1), "a"), (datetime.datetime(2024, 1, 1), "b")], "t timestamp, k string").coalesce(1).write.parquet(src)
    seen = []
    take = lambda df, i: seen.append(sorted(r.k for r in df.collect()))
    stream = lambda: ingest.once_by_key(ingest.stream_files(spark, src, spark.read.parquet(src).schema), "k", "t", "1 day")
    for force in (False, False, True):
        ingest.run_available(stream(), at, take, force=force)
    assert [x for x in seen if x] == [["a", "b"], ["a", "b"]]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tabularium.plans.staging import shared_dir

    fake = lambda master, at: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: at), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_dir(fake("spark://x:7077", "hdfs://y/z")) == "hdfs://y/z"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(fake(master, None))


def test_files_and_adapters(spark, tmp_path):
    (tmp_path / "lois_finances").mkdir()
    (tmp_path / "lois_finances" / "a.pdf").write_bytes(b"un|deux")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "empty.pdf").write_bytes(b"")
    found = files.documents(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.prioritised(found).collect()] == ["a.pdf", "b.pdf"]
    assert files.folder_counts(found).count() == 2

    def extract(b):
        if b == b"bad":
            raise ValueError("unreadable")
        return [(i, t, False) for i, t in enumerate(b.decode().split("|"), 1)]

    pages = files.extracted_pages(found, extract)
    assert pages.where("error LIKE 'ValueError%'").count() == 1 and pages.where("text IS NOT NULL").count() == 2
    out = files.with_recognition(pages.where("error IS NULL"), lambda p: p.select("doc_path", "page_num", F.lit("ocr").alias("text")))
    assert {r.text for r in out.collect()} == {"ocr"}
    vec = spark.createDataFrame([("a b",), (None,)], "t string").select(files.text_embedder(F.col("t"), 8)).collect()
    assert len(vec[0][0]) == 8 and sum(vec[1][0]) == 0
    assert files.answers(spark.createDataFrame([(1, "q")], "id int, p string"), "id", "p").first().answer == ""
    table = spark.createDataFrame([("x", None)], "chunk_id string, content string")
    assert files.without_nulls(table).first().json == '{"chunk_id":"x"}'
    assert files.cached(spark, str(tmp_path / "c"), lambda: table).count() == 1 and files.cached(spark, str(tmp_path / "c"), lambda: 1 / 0).count() == 1


def test_staged_is_readable_again(spark):
    df = staged(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and df.agg(F.sum("x")).first()[0] == 10


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_queries_agree_with_their_sql(spark, sf):
    import os

    import duckdb

    from tabularium import catalog
    from tools.compare import TABLES, norm

    root = f"/root/testdata/{sf}"
    if not os.path.isdir(root):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    oracle = catalog.oracle_sql()
    for name, query in catalog.queries().items():
        df = query(spark, root)
        cols = sorted(df.columns)
        got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
        if name in oracle:
            cur = con.execute(oracle[name])
            have = [d[0] for d in cur.description]
            assert sorted(have) == cols, name
            assert sorted((tuple(norm(dict(zip(have, r))[c]) for c in cols) for r in cur.fetchall()), key=repr) == got, name


def test_graph_queries_take_all_mentions(spark, tmp_path):
    from tabularium.plans import knowledge

    texts = {"a": "Le taux de la TVA est de 19 %.", "b": "L'article 12 du code fixe la retenue.", "c": "Voir article 7 du régime des retenues.", "d": "Rien ici.", "e": "La pénalité suit le taux."}
    rows = [(k, t, "doc", p, "text", "code", "", "") for p, (k, t) in enumerate(texts.items(), 1)]
    spark.createDataFrame(rows, "id string, text string, doc_name string, page_num int, chunk_type string, doc_type string, article_ref string, section_title string").write.parquet(f"{tmp_path}/graph_chunk.parquet")
    # a: TVA, taux, 19 19 %; b: retenue, article, cross reference; c: article, cross reference; e: pénalité, taux
    assert {(r.rel, r.n) for r in knowledge.rel_counts(spark, str(tmp_path)).collect()} == {("MENTIONED_IN", 10)}
    assert {(r.name, r.n_chunks) for r in knowledge.graph_concepts(spark, str(tmp_path)).collect()} == {("TVA", 1), ("taux", 2), ("retenue", 1), ("pénalité", 1)}
    assert [r.id for r in knowledge.graph_expand(spark, str(tmp_path)).collect()] == ["a", "b", "c", "e"]
