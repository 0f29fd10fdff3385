"""Known values and edge cases of the document operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from folioscope import tables
from folioscope.functions import jsonx, models, text, vectors
from folioscope.operators import concepts, export, library, segment, themes
from folioscope.sources import books
from folioscope.streaming.ingest import inbox_files, ingest

FB2 = """<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info>
<book-title>A Book of Springs</book-title><author><first-name>Vera</first-name><last-name>Lugovaya</last-name></author></title-info></description>
<body><section><title><p>Chapter 1</p></title><p>Первый абзац о силе и движении.</p><p>a<em>b</em> второй абзац про массу тела.</p>
<section><p>Вложенный абзац про энергию тела.</p></section></section></body></FictionBook>"""


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_concept_name_by_lexicon(spark):
    lemmas = {"решение": "решение", "задач": "задача", "на": "на", "движение": "движение"}
    m = F.create_map(*[F.lit(v) for kv in lemmas.items() for v in kv])
    assert one(spark, "Решение задач на движение 12", lambda c: text.concept_name(c, lambda w: m[w])) == "решение задача на движение"


def test_fallback_sentences_keep_their_first_characters(spark):
    """A sentence that begins with its own place in the text, and one with spaces at its ends."""
    said = [f"{i} and then some words that make it long enough." for i in range(3)]
    rows = spark.createDataFrame([(0, " ".join(said)), (1, "  " + said[1] + "\n" + said[1])], "id int, t string").select("id", text.fallback_sentences(F.col("t")).alias("s"))
    assert dict(rows.collect()) == {0: " ".join(said), 1: f"{said[1]} {said[1]}"}


def test_importance_at_halves(spark):
    """Seven of eight at rank six: a product a bit below 0.7175, as SQL has it."""
    words = ["alpha"] * 8 + ["beta" + x for x in "abcde" for _ in range(7)]
    rows = concepts.frequent_concepts(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), ["doc_id"])
    assert {r.rank: r.importance for r in rows.collect()}[6] == 0.717


def test_bare_ampersands(spark):
    """References need their semicolon, so a cut one stays as it is."""
    page = books.parse_html("<h1>a &amp;&amp;&amp</h1><p>?a=1&copy=2 &#38; &#x26; &quot;</p>")
    assert (page["title"], page["chapters"][0]["paragraphs"]) == ("a &&&amp", ['?a=1&copy=2 & & "'])


def test_page_paragraphs(spark):
    assert one(spark, "first paragraph is long\r\nenough\n\nshort\n\nsecond paragraph is long", text.page_paragraphs) == ["first paragraph is long enough", "second paragraph is long"]
    s = "A sentence of words. " * 30
    built = one(spark, s, lambda c: text.page_paragraphs(F.regexp_replace(c, "zzz", "")))
    assert built == [" ".join(s.split())]
    assert one(spark, "tiny", text.page_paragraphs) == []


def test_json(spark):
    assert one(spark, '[{"a": 1}, {"b": 2}, {"c"', jsonx.salvaged) == ['{"a": 1}', '{"b": 2}']
    assert one(spark, 'so: [ 3, {"a": 1} ,"x", [4], {"bad": {"b": 2}, {"c": {"d": 3}} ] {"e": 5}', jsonx.salvaged) == ['{"a": 1}', '{"b": 2}', '{"c": {"d": 3}}']
    assert one(spark, '{"a": 1}', jsonx.salvaged) == [] and one(spark, "[", jsonx.salvaged) == []
    assert one(spark, "no json", lambda c: jsonx.lenient_json(c).isNull()) is True
    assert one(spark, ["3", "x", "9", "3", "1"], lambda c: jsonx.clean_boundaries(c, F.lit(5)), "array<string>") == [1, 3, 5]


def test_hash_embedding(spark):
    v = one(spark, "Один два два", vectors.hash_embedding)
    assert len(v) == 128 and math.isclose(sum(x * x for x in v), 1.0)
    assert one(spark, "", vectors.hash_embedding) == [0.0] * 128


def test_even_parts(spark):
    got = spark.range(1, 11).select(themes.even_part(F.col("id"), F.lit(10), F.lit(4)).cast("int").alias("p")).collect()
    assert [r.p for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_three_blocks(spark):
    df = spark.createDataFrame([(1, 1, "Chapter", i, "word " * n) for i, n in enumerate((300, 350, 300), 1)], "book int, chapter int, chapter_title string, pos int, text string")
    got = segment.logical_blocks(df, 200, 760, 500).orderBy("order_number").collect()
    assert [(r.title, r.token_count, r.start_paragraph, r.end_paragraph) for r in got] == [("Chapter — блок 1", 300, 1, 1), ("Chapter — блок 2", 350, 2, 2), ("Chapter — блок 3", 300, 3, 3)]


def python_blocks(paragraphs, scores, least, target, most):
    """The rule for one book of chapters, written as loops."""
    out, calls = [], 0

    def by_score(idx):
        chunks, cur, acc = [], [], 0
        for k, i in enumerate(idx):
            s = scores[i] if k else None
            if cur and ((acc >= least and s >= 0.34) or (acc >= target and s >= 0.25) or acc + paragraphs[i] > most):
                chunks.append(cur)
                cur, acc = [], 0
            cur.append(i)
            acc += paragraphs[i]
        return merge([*chunks, cur], max(80, least // 2))

    def merge(chunks, limit):
        done = []
        for c in chunks:
            if done and sum(paragraphs[i] for i in c) < limit:
                done[-1] = done[-1] + c
            else:
                done.append(c)
        return done

    idx = list(range(len(paragraphs)))
    best = by_score(idx)
    if 6 <= len(idx) <= 80:
        cuts, acc = [], 0
        for i in idx:
            acc += paragraphs[i]
            if acc >= target:
                cuts.append(i + 1)
                acc = 0
        if not cuts or cuts[-1] != len(idx):
            cuts.append(len(idx))
        chunks = merge([idx[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], max(40, least // 2))
        again = []
        for c in chunks:
            again += by_score(c) if sum(paragraphs[i] for i in c) > most else [c]
        chunks = merge(again, max(40, least // 2))
        sizes = [sum(paragraphs[i] for i in c) for c in chunks]
        if not any(w > int(most * 1.4) for w in sizes) and sum(w < max(35, int(least * 0.4)) for w in sizes) <= max(1, len(sizes) // 2):
            best = chunks
    return [len(c) for c in best]


def test_blocks_like_loops(spark):
    from folioscope.plans.views import lines

    src = lines(spark, "/root/testdata/sf0.001").withColumn("chapter", F.lit(1))
    paragraphs = segment.kept_paragraphs(src).cache()
    scored = segment.boundary_scores(paragraphs).select("book", "idx", "words", "score").orderBy("book", "idx").collect()
    got = segment.chunk_numbers(paragraphs, 40, 80, 160).groupBy("book", "chunk").count().orderBy("book", "chunk").collect()
    by: dict = {}
    for r in scored:
        by.setdefault(r.book, []).append(r)
    sizes: dict = {}
    for r in got:
        sizes.setdefault(r.book, []).append(r["count"])
    assert sizes == {b: python_blocks([r.words for r in rs], [r.score for r in rs], 40, 80, 160) for b, rs in by.items()}


def test_fb2(spark):
    files = spark.createDataFrame([("a.fb2", FB2.encode()), ("b.fb2", b"<broken")], "path string, content binary")
    good, bad = books.fb2_books(files).orderBy("path").collect()
    assert (good.title, good.authors, good._error) == ("A Book of Springs", "Vera Lugovaya", None)
    assert [len(c.paragraphs) for c in good.chapters] == [3, 1] and good.chapters[1].chapter_title == books.NO_CHAPTER
    assert good.chapters[0].paragraphs[1].startswith("a b ") and bad._error


def test_resolution(spark):
    # Ratios to the first: 30/32 for the second, 28/32 for the last.
    names = ["квантовый физика", "квантовый физики", "теория поля", "квантовый физика", "химия", "квантовая физика"]
    df = spark.createDataFrame([(i, n, "") for i, n in enumerate(names)], "seq long, name string, description string")
    got = {r.seq: r.concept for r in concepts.resolved(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 5}


def test_russian_definitions(spark):
    df = spark.createDataFrame([(1, "Масса — это мера инертности тела. Под работой понимается произведение силы и пути. Просто так.")], "doc_id int, text string")
    got = {r.normalized_term: r.definition for r in concepts.definition_terms(df, ["doc_id"]).collect()}
    assert set(got) == {"масса", "работой"} and got["масса"].startswith("Масса")


def test_rotation(spark):
    rows = [(i, 1, i, i, "t", i > 0, "R") for i in range(50)] + [(99, 2, 1, 1, "t", False, "R")]
    df = spark.createDataFrame(rows, "id long, user_id long, book_id long, uploaded_at long, title string, is_protected boolean, status string")
    got = {r.user_id: r for r in library.rotation(df).collect()}
    assert got[1].need_confirmation and got[1].book_to_delete == 0 and got[2].can_upload
    assert {r.user_id: r.can_upload for r in library.rotation(df, confirmed=True).collect()} == {1: True, 2: True}


def test_duplicates_by_copies(spark):
    b = spark.createDataFrame([(1, 7, 5), (2, 7, 5)], "id long, user_id long, book_id long")
    m = spark.createDataFrame([(1, 5)], "mention_id long, book_id long")
    assert library.visible(m, b, 7).count() == 1 and library.visible(m, b, 7, keep_duplicates=True).count() == 2


def test_csv(spark):
    data = export.csv_bytes(spark.createDataFrame([("а", 'q"x')], "block string, concept string"))
    assert data == b"\xef\xbb\xbfblock,concept\r\n\xd0\xb0,\"q\"\"x\"\r\n"


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.fb2").write_text(FB2)
    (inbox / "b.FB2").write_text("<broken")
    (inbox / "c.pdf").write_bytes(b"one page of text, long enough")
    (inbox / "d.txt").write_text("not a book")

    def extract(data):
        return None, None, [data.decode()]

    for _ in range(2):
        ingest(inbox_files(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "cp"), extract_pdf=extract).awaitTermination()
    assert {r.title for r in spark.read.parquet(str(tmp_path / "out/books")).collect()} == {"A Book of Springs", books.PDF_TITLE}
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "out/status")).collect()) == ["failed", "ready", "ready"]


def test_read_books(spark, tmp_path):
    (tmp_path / "a.FB2").write_text(FB2)
    (tmp_path / "b.pdf").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in books.read_books(spark, str(tmp_path)).collect()}
    assert got["a.FB2"].title == "A Book of Springs" and got["b.pdf"]._error == "no PDF reader"
    rows = books.lines(books.read_books(spark, str(tmp_path))).orderBy("chapter", "pos").collect()
    assert [(r.chapter, r.pos, r.chapter_title) for r in rows] == [(1, 1, "Chapter 1"), (1, 2, "Chapter 1"), (1, 3, "Chapter 1"), (2, 1, books.NO_CHAPTER)]


def test_bad_files_are_kept_apart(spark):
    deep = "<FictionBook><body>" + "<section>" * 3000 + "<p>at the very bottom</p>" + "</section>" * 3000 + "</body></FictionBook>"
    rows = [("a", None), ("b", b'<?xml version="1.0" encoding="no-such"?><a/>'), ("c", deep.encode()), ("d", b"")]
    got = {r.path: r for r in books.fb2_books(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(got[k]._error and got[k].chapters == [] for k in "abd")
    assert len(got["c"].chapters) == 3000 and got["c"].chapters[2999].paragraphs == ["at the very bottom"]
    pages = books.html_books(spark.createDataFrame([("a", None), ("b", "<h1>T &amp; t</h1><p>one<p>two <b>x</b></p>no")], "path string, content string")).orderBy("path").collect()
    assert pages[0].title == books.NO_TITLE and (pages[1].title, pages[1].chapters[0].paragraphs) == ("T & t", ["one", "two x"])


def test_pdf(spark):
    s = "A sentence of words. " * 30
    pages = ["first paragraph is long\r\nenough\n\nshort\n\nsecond paragraph is long", None, "tiny", s.replace(" ", "\n\n")]
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "path string, content binary")

    def extract(data):
        if data == b"3":
            raise OSError("unreadable")
        return (" My  title ", " An  author ", pages) if data == b"1" else (None, None, [None, ""])

    a, b, c = books.pdf_books(files, extract).orderBy("path").collect()
    assert (a.title, a.authors, a.metadata) == ("My title", "An author", {"source_format": "pdf", "pages_total": "4", "pages_with_text": "2"})
    assert [x.chapter_title for x in a.chapters] == ["Page 1", "Page 4"] and a.chapters[0].paragraphs == ["first paragraph is long enough", "second paragraph is long"]
    assert [len(p) for p in a.chapters[1].paragraphs] == [251, 251, 125]
    assert b._error == "no text" and c._error == "unreadable" and books.parse_pages("", "", ["x" * 30])["title"] == "PDF document"
    same = spark.createDataFrame([("a", " My  title ", " An  author ", pages), ("b", None, None, [None, ""])], "path string, title string, authors string, pages array<string>")
    assert [tuple(r) for r in books.page_books(same).orderBy("path").collect()][0] == tuple(a) and books.page_books(same).where("path = 'b'").first()._error == "no text"
    assert {r.status for r in books.statuses(books.page_books(same)).collect()} == {"ready", "failed"}


def test_embedding_by_a_model(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "bad"), (3, None)], "i int, text string")

    def load():
        def model(t):
            if t == "bad":
                raise RuntimeError
            return [float(len(t)), 1.0]

        return model

    def broken():
        raise OSError

    got = {r.i: r.v for r in df.select("i", vectors.embedding("text", load).alias("v")).collect()}
    assert got[1] == [7.0, 1.0] and got[3] == [0.0, 1.0] and len(got[2]) == 128 and vectors.embedded("bad", load) == got[2]
    spare = {r.i: r.v for r in df.select("i", vectors.embedding("text", broken).alias("v")).collect()}
    assert spare == {r.i: r.v for r in df.select("i", vectors.embedding("text").alias("v")).collect()} and vectors.embedded("one two", broken) == spare[1]


def test_breaker(spark):
    now, calls = [0.0], []

    def call(prompt):
        calls.append(prompt)
        if prompt in ("slow", "bad"):
            raise TimeoutError if prompt == "slow" else ValueError
        return f" {prompt}! "

    ask = models.Breaker(call, slow_pause=5, error_pause=120, clock=lambda: now[0])
    assert ask("a") == "a!" and ask("slow") is None and ask("a") is None and ask(None) is None
    now[0] = 15.0
    assert ask("a") == "a!" and ask("bad") is None
    now[0] = 134.9
    assert ask("a") is None and calls == ["a", "slow", "a", "bad"]
    now[0] = 135.0
    assert ask("a") == "a!" and models.Breaker(None)("a") is None
    df = spark.createDataFrame([("x",), (None,)], "p string")
    assert sorted(map(str, (r.a for r in df.select(models.replies("p", lambda: lambda t: t * 2).alias("a")).collect()))) == ["None", "xx"]
    assert df.select(models.replies("p").alias("a")).where("a is not null").count() == 0


def test_theme_hierarchy_from_replies(spark):
    """One chapter of four blocks with a reply, one whose reply is no list, one whose reply has a single subtopic."""
    said = ["energy keeps moving through closed systems", "momentum changes with applied force", "pressure grows under deep water", "light bends between different media"]
    rows = [(1, i + 1, f"Chapter {'ABC'[i // 4]}", 10 * i + 1, 10 * i + 5, f"{said[i % 4]} every time. Then more words about {said[i % 4]} follow here.", f"Block {i + 1}: {said[i % 4]}.") for i in range(12)]
    blocks = spark.createDataFrame(rows, "book int, order_number int, chapter_title string, start_paragraph int, end_paragraph int, source_text string, short_summary string")
    reply = {
        "themes": [
            {"title": "Late", "start_block": 3, "end_block": 99, "summary": "nothing that the text says", "subthemes": [{"name": "a"}, {"name": " "}, {"name": "A", "start_block": 4, "end_block": 4}, {"name": "b", "source_quote": " own  words ", "importance_score": 9}]},
            {"start_block": "0", "end_block": "2", "summary": "energy and momentum: systems with applied force", "subthemes": [{"name": "force", "summary": "force changes momentum", "start_block": "2"}, {"name": "energy", "start_block": 2.0}, "x"]},
        ]
    }
    one_sub = [{"title": None, "start_block": 1, "end_block": 4, "subthemes": [{"name": "only one"}]}]
    answers = [(1, 1, "Sure: " + json.dumps(reply)), (1, 2, "no idea"), (1, 3, json.dumps(one_sub))]
    t, s = themes.theme_hierarchy(blocks, spark.createDataFrame(answers, "book int, run int, reply string"))
    t, s = t.orderBy("theme").collect(), s.orderBy("theme", "idx").collect()
    assert [(r.title, r.start_block, r.end_block, r.start_paragraph, r.end_paragraph) for r in t] == [
        ("Chapter A — тема 1", 1, 2, 1, 15), ("Late", 3, 4, 21, 35), ("Chapter B — часть 1", 5, 6, 41, 55), ("Chapter B — часть 2", 7, 8, 61, 75), ("None", 9, 12, 81, 115),
    ]
    assert t[0].summary == "energy and momentum: systems with applied force" and t[1].summary == f"Block 3: {said[2]}. Block 4: {said[3]}."
    first = [r for r in s if r.theme == 1]
    assert [(r.name, r.start_block, r.end_block, r.start_paragraph, r.importance, r.summary) for r in first] == [
        ("force", 2, 2, 11, 0.6, "force changes momentum"), ("energy", 1, 2, 1, 0.6, f"Block 1: {said[0]}. Block 2: {said[1]}."),
    ]
    late = [r for r in s if r.theme == 2]
    assert [(r.name, r.start_block, r.importance, r.source_quote) for r in late] == [("a", 3, 0.6, f"Block 3: {said[2]}. {said[2]} every time."[: len(f"Block 3: {said[2]}.")]), ("b", 3, 1.0, "own words")]
    made = [r for r in s if r.theme == 3]
    assert 2 <= len(made) <= 4 and all(r.source_quote and r.summary.startswith("Block 5") for r in made)
    plain = [r for r in s if r.theme == 5]
    assert len(plain) >= 2 and {(r.summary, r.source_quote) for r in plain} == {(themes.SUBTOPIC_SUMMARY, "")} and [round(r.importance, 2) for r in plain[:2]] == [0.8, 0.65]


def test_written(spark):
    rows = [(1, " ", "x", 1, 1, "q", 0.5), (2, "текст", "bad single word", 1, 1, "q", 0.5), (3, "magnetic field", "", 1, 1, "q1", 2.0), (4, "magnetic fields", "around a wire", 1, 2, "q2", None), (5, "magnetic field", "again", 2, 1, "q3", -1.0)]
    c, m = concepts.written(spark.createDataFrame(rows, "seq long, name string, summary string, book long, block long, quote string, importance double"))
    assert [tuple(r) for r in c.collect()] == [(3, "magnetic field", "magnetic field", "around a wire")]
    assert sorted((r.concept, r.block, r.seq, r.book, r.explanation, r.quote, r.importance) for r in m.collect()) == [(3, 1, 5, 2, "again", "q3", 0.0), (3, 2, 4, 1, "around a wire", "q2", 0.6)]


def test_budget(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate((10, 10, 30, 1))] + [(2, 0, "x" * 41)]
    got = themes.within_budget(spark.createDataFrame(rows, "book int, place int, line string"), ["book"], "place", 40).collect()
    assert sorted((r.book, r.place) for r in got) == [(1, 0), (1, 1)]


def test_uploads_of_the_bot(spark):
    files = spark.createDataFrame([(1, "a.fb2", 5, "h")], "user_id int, filename string, size long, file_hash string")
    cache = spark.createDataFrame([("h", True, False)], "file_hash string, has_blocks boolean, has_themes boolean")
    assert library.upload_gate(files, cache).first().verdict == "processing" and library.upload_gate(files, cache, need_themes=False).first().verdict == "ready"


def test_files_of_books(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 1), ("h2", 2)], "file_hash string, v int")
    export.overwrite_books(rows, str(tmp_path / "b"))
    export.overwrite_books(spark.createDataFrame([("h1", 9)], "file_hash string, v int"), str(tmp_path / "b"))
    assert {(r.file_hash, r.v) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {("h1", 9), ("h2", 2)}
    for kind in ("csv", "json", "parquet"):
        export.export(rows, str(tmp_path / kind), kind)
    export.export(rows.select("file_hash"), str(tmp_path / "txt"), "txt")
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.text(str(tmp_path / "txt")).count() == 2
    with pytest.raises(ValueError):
        export.export(rows, str(tmp_path / "doc"), "doc")


def test_checkpoints_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())


def test_tables_are_dropped(spark):
    import os

    before = tables.cuts_so_far(spark)
    a, b = tables.cut(spark.range(3)), tables.cut(spark.range(4))
    tables.drop_all_but(spark, before, b)
    assert not os.path.exists(a._folioscope_path.removeprefix("file://")) and b.count() == 4
    tables.drop_cut(b)
    assert tables.cuts_so_far(spark) == before


def test_quoted_summaries(spark):
    """Two blocks' own summaries without a word to weigh, others of that kind, and a generic quote."""
    dull = "la le ch " * 250
    rows = [(1, i, "C", i, i, dull, s) for i, s in enumerate([dull, "No 12", "le la"], 1)] + [(2, 1, "C", 1, 1, "Main meaning: waves.", "Main meaning: waves."), (3, 1, "C", 1, 1, "Waves and tides of the sea.", " Waves  and tides. ")]
    blocks = spark.createDataFrame(rows, "book int, order_number int, chapter_title string, start_paragraph int, end_paragraph int, source_text string, short_summary string")
    quote = dull + "No 12"
    said = [(1, 1, quote), (2, 1, "Main meaning: waves."), (3, 1, "Waves and tides."), (1, 2, "le la No 12"), (3, 2, "nothing that it says")]
    held = spark.createDataFrame([(*r, 1, 3) for r in said], "book int, theme int, summary string, start_block int, end_block int")
    got = {stand: {(r.book, r.theme): r.summary for r in themes.theme_summaries(held, blocks, quotes_stand=stand).collect()} for stand in (True, False)}
    assert got[True] == {(1, 1): quote[:2000], (2, 1): "Main meaning: waves.", (3, 1): "Waves and tides.", (1, 2): dull[:1900].strip(), (3, 2): "Waves and tides."}
    assert got[False] == got[True] | {(1, 1): dull[:1900].strip()}
