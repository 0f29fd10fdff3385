"""Themes and subtopics over a book's blocks: runs of chapters, even parts, topic phrases, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import jsonx as J
from folioscope.functions import text as T
from folioscope.tables import cut

# Fixed values.
TOPIC_STOP_WORDS = ["книга", "автор", "глава", "тема", "раздел", "пример", "задача", "текст", "данный", "этот", "такой", "вопрос"]
DEFAULT_SECTION, DEFAULT_THEME, DEFAULT_SUMMARY = "Основной раздел", "Тема", "Ключевая смысловая часть главы."
SUBTOPIC_SUMMARY = "Ключевая подтема этого смыслового фрагмента."
MAIN_THEME, MAIN_SUMMARY = "Основная тема", "Ключевая тема главы."


def chapter_runs(blocks: DataFrame) -> DataFrame:
    """Adds run (consecutive blocks of one chapter title, from 1), local (place in it, from 1) and run_size."""
    order = Window.partitionBy("book").orderBy("order_number")
    title = T.or_default(T.normal_spaces("chapter_title"), DEFAULT_SECTION)
    rows = blocks.withColumn("chapter_title", title).withColumn("new", F.coalesce(F.lag("chapter_title").over(order) != F.col("chapter_title"), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    whole = Window.partitionBy("book", "run")
    return rows.withColumn("local", F.row_number().over(whole.orderBy("order_number"))).withColumn("run_size", F.count("*").over(whole))


def theme_count(n: Column) -> Column:
    return F.when(n <= 2, 1).when(n <= 5, 2).when(n <= 9, 3).otherwise(4)


def even_part(place: Column, total: Column, parts: Column) -> Column:
    """The part (from 1) that a place (from 1) falls in, when the first total % parts get one more."""
    small, more = F.floor(total / parts), total % parts
    edge = more * (small + 1)
    return F.when(place <= edge, F.floor((place - 1) / (small + 1)) + 1).otherwise(more + F.floor((place - 1 - edge) / F.greatest(small, F.lit(1))) + 1).cast("int")


def theme_segments(blocks: DataFrame) -> DataFrame:
    """book, run, part, title, chapter_title, block and paragraph ranges, summary: one row for each fallback theme.

    blocks holds short_summary besides what segment.blocks gives.
    """
    return _segments(chapter_runs(blocks)).drop("start", "end")


def _segments(runs: DataFrame) -> DataFrame:
    """theme_segments() of chapter_runs(), with the places in the run that each begins and ends at."""
    rows = runs.withColumn("part", even_part(F.col("local"), F.col("run_size"), theme_count(F.col("run_size"))))
    both = F.array_sort(F.collect_list(F.when(F.col("k") <= 2, F.struct("order_number", "short_summary", F.left("source_text", F.lit(350)).alias("head")))))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("book", "run", "part").orderBy("order_number")))
    out = rows.groupBy("book", "run", "part").agg(
        F.first("chapter_title").alias("chapter_title"), F.min("order_number").alias("start_block"), F.max("order_number").alias("end_block"), F.min("local").alias("start"), F.max("local").alias("end"),
        F.min("start_paragraph").alias("start_paragraph"), F.max("end_paragraph").alias("end_paragraph"), both.alias("two"),
    )
    summaries = T.normal_spaces(F.array_join(F.filter(F.transform("two", lambda x: x["short_summary"]), lambda s: s != ""), " "))
    heads = T.normal_spaces(F.array_join(F.transform("two", lambda x: x["head"]), " "))
    summary = F.coalesce(F.nullif(summaries, F.lit("")), F.nullif(heads, F.lit("")), F.lit(DEFAULT_SUMMARY))
    title = F.format_string("%s — часть %d", T.or_default(F.col("chapter_title"), DEFAULT_THEME), "part")
    order = F.row_number().over(Window.partitionBy("book").orderBy("run", "part"))
    return out.select("book", order.alias("theme"), "run", "part", title.alias("title"), "chapter_title", "start_block", "end_block", "start_paragraph", "end_paragraph", summary.alias("summary"), "start", "end")


def theme_blocks(themes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that stand in each theme's range. Ranges of a book are few, so the join goes by book."""
    return themes.select("book", "theme", "start_block", "end_block").join(blocks, "book").where(F.col("order_number").between(F.col("start_block"), F.col("end_block")))


def _evidence(rows: DataFrame, key: list[str], head: int, chars: int, limit: int) -> DataFrame:
    """key..., evidence, spare, quoted, block and paragraph ranges of rows (blocks under a key).

    evidence is each block's summary with the first `chars` characters of its text; spare is the first `limit`
    digests, a digest being the summary or else the first `head` characters; quoted is the digests of the first two
    blocks, uncut: what theme_segments() makes of blocks that have summaries.
    """
    digest = F.trim(T.or_default(F.col("short_summary"), F.left("source_text", F.lit(head))))
    said = T.normal_spaces(F.concat(F.coalesce("short_summary", F.lit("")), F.lit("\n"), F.left("source_text", F.lit(chars))))
    listed = F.array_sort(F.collect_list(F.struct("order_number", digest.alias("d"), said.alias("e"))))
    ranges = [F.min("order_number").alias("start_block"), F.max("order_number").alias("end_block"), F.min("start_paragraph").alias("start_paragraph"), F.max("end_paragraph").alias("end_paragraph")]
    parts = F.filter(F.transform("x", lambda x: x["d"]), lambda d: d != "")
    spare = F.left(F.array_join(F.slice(parts, 1, limit), " "), F.lit(1900))
    quoted = T.normal_spaces(F.array_join(F.transform(F.slice("x", 1, 2), lambda x: x["d"]), " "))
    evidence = F.array_join(F.transform("x", lambda x: x["e"]), "\n\n")
    return rows.groupBy(*key).agg(listed.alias("x"), *ranges).withColumns({"evidence": evidence, "spare": spare, "quoted": quoted}).drop("x")


def theme_summaries(themes: DataFrame, blocks: DataFrame, quotes_stand: bool = False) -> DataFrame:
    """book, theme, summary held against the blocks it stands for.

    With quotes_stand the summaries of a theme's first two blocks stand as they are, even without a word to weigh.
    """
    key = ["book", "theme"]
    rows = _evidence(theme_blocks(themes, blocks), key, 240, 1400, 3)
    return T.grounded(rows.join(themes.select(*key, "summary"), key), "summary", "evidence", "spare", "quoted" if quotes_stand else None).select(*key, "summary")


def block_digests(runs: DataFrame, most: int = 260) -> DataFrame:
    """book, run, local, line: what a model is told of each block."""
    digest = F.left(T.normal_spaces(T.or_default(F.col("short_summary"), F.left("source_text", F.lit(240)))), F.lit(most))
    return runs.select("book", "run", "local", F.format_string("[%d] p%d-%d: %s", "local", "start_paragraph", "end_paragraph", digest).alias("line"))


def within_budget(lines: DataFrame, key: list[str], place: str, most: int = 6500) -> DataFrame:
    """The first of lines(key..., place, line) that fit into `most` characters, one more counted for each line before."""
    order = Window.partitionBy(*key).orderBy(place)
    used = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("line")
    rows = lines.withColumn("_over", (used > most).cast("int"))
    return rows.withColumn("_over", F.max("_over").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_over = 0").drop("_over")


def _raw_themes(runs: DataFrame, replies: DataFrame | None) -> DataFrame:
    """book, run, place, chapter_title, title, summary, start, end, subthemes: from replies, else even parts of a run."""
    made = _segments(runs).select("book", "run", F.col("part").alias("place"), "chapter_title", "title", "summary", "start", "end")
    if replies is None:
        return made.withColumn("subthemes", F.lit(None))
    sizes = runs.groupBy("book", "run").agg(F.first("chapter_title").alias("chapter_title"), F.first("run_size").cast("int").alias("n"))
    told = replies.select("book", "run", J.lenient_json(F.col("reply")).alias("v")).join(sizes, ["book", "run"])
    told = told.select("book", "run", "chapter_title", F.posexplode(J.reply_themes(F.col("v"), F.col("n"))).alias("k", "x"))
    told = told.select("book", "run", (F.col("k") + 1).alias("place"), "chapter_title", "x.title", "x.summary", "x.start", "x.end", "x.subthemes")
    return made.join(told.select("book", "run").distinct(), ["book", "run"], "left_anti").unionByName(told, allowMissingColumns=True)


def theme_hierarchy(blocks: DataFrame, replies: DataFrame | None = None, quotes_stand: bool = False) -> tuple[DataFrame, DataFrame]:
    """Themes and subtopics of books' blocks; replies(book, run, reply) hold a model's answer for a run of a chapter.

    themes: book, theme, chapter_title, title, summary, block and paragraph ranges. subtopics: book, theme, idx, name,
    normalized_name, summary, source_quote, importance, block and paragraph ranges; at most four a theme. Summaries
    are held against the blocks' text, those of themes as theme_summaries() does with quotes_stand. Where a reply gives
    fewer than two subtopics, phrases of the text stand in.
    """
    key = ["book", "theme"]
    runs = cut(chapter_runs(blocks))
    raw = _raw_themes(runs, replies).withColumn("theme", F.row_number().over(Window.partitionBy("book").orderBy("run", "place")))
    title = F.left(T.or_default(F.col("title"), F.format_string("%s — тема %d", "chapter_title", "place")), F.lit(512))
    raw = cut(raw.withColumn("title", title))
    own = raw.select(*key, "run", "start", "end").join(runs.drop("chapter_title"), ["book", "run"]).where(F.col("local").between(F.col("start"), F.col("end")))
    gathered = _evidence(own, key, 240, 1400, 3).join(raw.select(*key, "run", "chapter_title", "title", "summary"), key)
    themes = cut(T.grounded(gathered, "summary", "evidence", "spare", "quoted" if quotes_stand else None).select(*key, "run", "chapter_title", "title", "summary", "start_block", "end_block", "start_paragraph", "end_paragraph"))

    texts = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("order_number", "source_text"))).alias("x"))
    texts = texts.select(*key, F.array_join(F.transform("x", lambda x: x["source_text"]), "\n\n").alias("text"))
    ranges = raw.select(*key, "run", F.col("start").alias("first"), F.col("end").alias("last"))
    told = None
    if replies is not None:
        told = raw.select(*key, "run", F.col("start").alias("first"), F.col("end").alias("last"), F.posexplode("subthemes").alias("idx", "x")).where("x.name <> ''")
        lo, hi = (F.when(F.col(f"x.{c}").rlike("^[0-9]+$"), F.col(f"x.{c}").try_cast("bigint")) for c in ("start", "end"))
        lo = F.greatest(F.col("first"), F.least(F.coalesce(lo, F.col("first")), F.col("last")))
        hi = F.greatest(F.col("first"), F.least(F.coalesce(hi, F.col("last")), F.col("last")))
        told = told.withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n >= 2")
        told = cut(told.select(*key, "run", "idx", "x.name", "x.summary", "x.quote", "x.importance", lo.alias("first"), F.greatest(lo, hi).alias("last")))
        answered = raw.where("subthemes is not null").select(*key)
        texts = texts.join(told.select(*key).distinct(), key, "left_anti")
    named = cut(fallback_names(raw, texts))
    # Names made for a theme of no reply are subthemes like any other if there are two; else they stay as they are.
    many = named.groupBy(*key).agg((F.count("*") >= 2).alias("many"))
    if replies is not None:
        many = many.join(answered.withColumn("answered", F.lit(True)), key, "left").select(*key, (F.col("many") & F.col("answered").isNull()).alias("many"))
    made = named.join(many, key).join(ranges, key)
    held = made.where("many").select(*key, "run", "idx", "name", F.lit(SUBTOPIC_SUMMARY).alias("summary"), F.lit("").alias("quote"), "importance", F.col("first"), F.col("last"))
    if told is not None:
        held = held.unionByName(told)
    rows = held.join(runs.drop("chapter_title"), ["book", "run"]).where(F.col("local").between(F.col("first"), F.col("last")))
    proof = _evidence(rows, [*key, "idx"], 200, 1200, 2).join(held.select(*key, "idx", "name", "summary", "quote", "importance"), [*key, "idx"])
    quote = F.left(T.or_default(F.col("quote"), T.first_quote(F.col("evidence"))), F.lit(500))
    bounds = ["start_block", "end_block", "start_paragraph", "end_paragraph"]
    full = T.grounded(proof, "summary", "evidence", "spare").select(*key, "idx", "name", F.left("summary", F.lit(1000)).alias("summary"), quote.alias("source_quote"), "importance", *bounds)
    plain = made.where("not many").join(themes.select(*key, *bounds), key).select(*key, "idx", "name", F.lit(SUBTOPIC_SUMMARY).alias("summary"), F.lit("").alias("source_quote"), "importance", *bounds)
    found = deduplicated_subtopics(full.unionByName(plain).withColumn("name", F.left("name", F.lit(255))).where(T.concept_name(F.col("name")) != ""))
    return themes.drop("run"), found


def _tokens(texts: DataFrame, key: list[str]) -> DataFrame:
    return texts.select(*key, F.posexplode(T.lower_words(F.col("text"))).alias("pos", "word"))


def topic_ngrams(texts: DataFrame, key: list[str], noun=T.plain_noun, modifier=lambda w: F.lit(False), lemma=lambda w: w, most: int = 4) -> DataFrame:
    """key..., rank, phrase, n: the most frequent phrases of two and three words that end in a noun; earlier first on ties."""
    stop = F.array(*[F.lit(w) for w in TOPIC_STOP_WORDS])
    w = F.col("w")

    def grams(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("span"), F.slice(w, i, n).alias("g")))

    rows = texts.select(*key, T.lower_words(F.col("text")).alias("w")).select(*key, F.explode(F.concat(grams(2), grams(3))).alias("x")).select(*key, "x.*")
    rows = rows.where(~F.arrays_overlap("g", stop) & noun(F.element_at("g", -1)) & F.forall("g", lambda t: noun(t) | modifier(t)))
    rows = rows.withColumn("phrase", F.array_join(F.transform("g", lemma), " ")).where(F.length("phrase") >= 4)
    counts = rows.groupBy(*key, "phrase").agg(F.count("*").alias("n"), F.min(F.struct("pos", "span")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select(*key, "rank", "phrase", "n")


def topic_nouns(texts: DataFrame, key: list[str], noun=T.plain_noun, most: int = 8) -> DataFrame:
    """key..., rank, noun, n: the most frequent nouns; earlier first on ties."""
    rows = _tokens(texts, key).where(~F.col("word").isin(TOPIC_STOP_WORDS) & noun(F.col("word")) & (F.length("word") > 3))
    counts = rows.groupBy(*key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select(*key, "rank", F.col("word").alias("noun"), "n")


def fallback_names(themes: DataFrame, texts: DataFrame, most: int = 4) -> DataFrame:
    """book, theme, idx, name, importance: phrases of texts(book, theme, text), filled up with nouns in their chapter, else one main idea."""
    key = ["book", "theme"]
    texts = cut(texts)
    phrases = topic_ngrams(texts, key, most=most).select(*key, F.lit(0).alias("kind"), "rank", F.col("phrase").alias("name"))
    themes = themes.join(texts.select(*key), key, "left_semi")
    nouns = topic_nouns(texts, key).join(themes.select(*key, "chapter_title"), key)
    named = F.when(F.coalesce(F.col("chapter_title"), F.lit("")) == "", F.col("noun")).otherwise(F.concat("noun", F.lit(" в контексте "), F.left("chapter_title", F.lit(40))))
    nouns = nouns.select(*key, F.lit(1).alias("kind"), "rank", named.alias("name"))
    spare = themes.select(*key, F.lit(2).alias("kind"), F.lit(1).alias("rank"), F.concat(F.lit("Основные идеи: "), T.or_default(F.col("chapter_title"), "раздел")).alias("name"))
    rows = phrases.unionByName(nouns).unionByName(spare)
    # The spare stands only where there is nothing else.
    rows = rows.withColumn("best", F.min("kind").over(Window.partitionBy(*key))).where((F.col("kind") < 2) | (F.col("best") == 2))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy(*key, "name").orderBy("kind", "rank"))).where("seen = 1")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy(*key).orderBy("kind", "rank"))).where(F.col("idx") <= most)
    return rows.select(*key, "idx", F.left("name", F.lit(255)).alias("name"), F.greatest(F.lit(0.2), 0.95 - F.col("idx") * 0.15).alias("importance"))


def deduplicated_subtopics(subtopics: DataFrame, most: int = 4) -> DataFrame:
    """The first of each normalised name, at most `most` a theme."""
    rows = subtopics.withColumn("normalized_name", T.concept_name(F.col("name")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("book", "theme", "normalized_name").orderBy("idx"))).where("k = 1")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("book", "theme").orderBy("idx"))).where(F.col("k") <= most).drop("k")


def whole_book_themes(blocks: DataFrame, themes: DataFrame) -> DataFrame:
    """One theme from first to last block for every book that has blocks but no theme."""
    k = F.row_number().over(Window.partitionBy("book").orderBy("order_number"))
    rows = blocks.join(themes.select("book").distinct(), "book", "left_anti").withColumn("k", k)
    two = F.array_sort(F.collect_list(F.when((F.col("k") <= 2) & (F.coalesce(F.col("short_summary"), F.lit("")) != ""), F.struct("k", "short_summary"))))
    ends = rows.groupBy("book").agg(
        F.min("order_number").alias("start_block"), F.max("order_number").alias("end_block"), F.min("start_paragraph").alias("start_paragraph"), F.max("end_paragraph").alias("end_paragraph"),
        F.max(F.when(F.col("k") == 1, F.coalesce("chapter_title", F.lit("")))).alias("own"), two.alias("two"),
    )
    summary = F.left(F.array_join(F.transform("two", lambda x: x["short_summary"]), " "), F.lit(2000))
    return ends.select(
        "book", F.lit(1).alias("theme"), T.or_default(F.col("own"), DEFAULT_SECTION).alias("chapter_title"), T.or_default(F.col("own"), MAIN_THEME).alias("title"),
        "start_block", "end_block", "start_paragraph", "end_paragraph", T.or_default(summary, MAIN_SUMMARY).alias("summary"),
    )


def book_summary(summaries: DataFrame) -> DataFrame:
    """book, summary from summaries(book, order_number, short_summary): a frame around the first three."""
    first = summaries.withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy("order_number"))).where("k <= 3")
    rows = first.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "short_summary"))), lambda x: x["short_summary"]), "; ").alias("s"))
    text = F.concat(
        F.lit("1. General theme: source material explains key ideas from the original text.\n2. Key ideas: "), "s", F.lit("\n3. Learning outcome: reader understands the core concepts and links between them.")
    )
    return rows.select("book", text.alias("summary"))
