"""From paragraphs to logical blocks.

Chapters are arrays of (word count, boundary score); cuts that depend on the cut before are folds over these
arrays in the JVM, merges of small chunks are running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.jsonx import clean_boundaries
from folioscope.functions.vectors import cosine, hash_embedding
from folioscope.tables import cut

# Fixed values.
TRANSITIONS = ["итак", "таким образом", "следовательно", "в заключение", "подведем итог", "далее", "с другой стороны", "однако", "например"]
TITLE_LIKE = r"^\s*(?:\d+[.)]\s+)?[А-ЯA-Z][^.!?]{2,120}$"
STRONG, WEAK = 0.34, 0.25
LEAST_PARAGRAPHS, MOST_PARAGRAPHS, MOST_CHAPTERS = 6, 80, 8


def kept_paragraphs(lines: DataFrame) -> DataFrame:
    """lines(book, chapter, chapter_title, pos, text) -> paragraphs of 20 characters or more, numbered in the book and the chapter."""
    rows = lines.withColumn("text", T.normal_spaces("text")).where(F.length("text") >= 20)
    return rows.select(
        "book", "chapter", "chapter_title", "pos", "text",
        F.row_number().over(Window.partitionBy("book").orderBy("chapter", "pos")).alias("number"),
        F.row_number().over(Window.partitionBy("book", "chapter").orderBy("pos")).alias("idx"),
        T.word_count(F.col("text")).alias("words"),
    )


def boundary_scores(paragraphs: DataFrame) -> DataFrame:
    """Adds `score`: how much a paragraph looks like a beginning; null for a chapter's first."""
    before = Window.partitionBy("book", "chapter").orderBy("idx")
    rows = paragraphs.withColumn("vec", hash_embedding(F.left("text", F.lit(2200)))).withColumn("vec0", F.lag("vec").over(before))
    low = F.lower("text")
    hint = F.lit(False)
    for h in TRANSITIONS:
        hint = hint | low.startswith(h)
    score = (1.0 - cosine(F.col("vec0"), F.col("vec"))) * 0.8 + F.when(hint, 0.2).otherwise(0.0) + F.when(F.col("text").rlike(TITLE_LIKE), 0.5).otherwise(0.0) + F.when(F.length("text") < 80, 0.05).otherwise(0.0)
    return rows.withColumn("score", F.when(F.col("idx") > 1, score)).drop("vec", "vec0")


def chapters(paragraphs: DataFrame, *cols: str) -> DataFrame:
    """One row for each chapter with its paragraphs in order."""
    items = F.array_sort(F.collect_list(F.struct("idx", "words", *cols)))
    return paragraphs.groupBy("book", "chapter").agg(items.alias("items"))


def _fold(items: Column, step) -> Column:
    """Chunk number of each item; step(acc, item) says whether to cut before it, and what is carried on."""
    begin = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def add(state: Column, item: Column) -> Column:
        fresh, acc = step(state, item)
        chunk = state["chunk"] + F.when(fresh, 1).otherwise(0)
        return F.struct(acc.cast("long").alias("acc"), chunk.alias("chunk"), F.array_append(state["out"], chunk).alias("out"))

    return F.aggregate(items, begin, add, lambda s: s["out"])


def greedy_words(items: Column, target: int) -> Column:
    """Cut after the paragraph with which a chunk reaches the target; the most is never below it."""

    def step(state: Column, item: Column) -> tuple[Column, Column]:
        fresh = state["acc"] >= target
        return fresh, F.when(fresh, item["words"]).otherwise(state["acc"] + item["words"])

    return _fold(items, step)


def greedy_scores(items: Column, least: int, target: int, most: int) -> Column:
    """Cut before a paragraph by its boundary score or where the chunk would grow too large."""

    def step(state: Column, item: Column) -> tuple[Column, Column]:
        acc = state["acc"]
        fresh = (item["idx"] > 1) & (((acc >= least) & (item["score"] >= STRONG)) | ((acc >= target) & (item["score"] >= WEAK)) | (acc + item["words"] > most))
        fresh = F.coalesce(fresh, F.lit(False))
        return fresh, F.when(fresh, item["words"]).otherwise(acc + item["words"])

    return _fold(items, step)


def numbered(chaptered: DataFrame, chunk: Column) -> DataFrame:
    """(book, chapter, idx, words, chunk) from chunk numbers of each chapter's items."""
    zipped = chaptered.select("book", "chapter", F.explode(F.arrays_zip(F.col("items"), chunk.alias("chunk"))).alias("z"))
    return zipped.select("book", "chapter", "z.items.idx", "z.items.words", "z.chunk")


def merged_small(rows: DataFrame, threshold: int) -> DataFrame:
    """Chunks of fewer words than the threshold join the chunk before; the first never does."""
    whole = Window.partitionBy("book", "chapter", "chunk")
    order = Window.partitionBy("book", "chapter").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chunk_words", F.sum("words").over(whole)).withColumn("head", F.col("idx") == F.min("idx").over(whole))
    opens = F.col("head") & ((F.col("chunk") == 0) | (F.col("chunk_words") >= threshold))
    return rows.withColumn("chunk", F.sum(opens.cast("int")).over(order) - 1).drop("chunk_words", "head")


def valid_chapters(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(book, chapter, valid): no chunk too large, and not too many too small."""
    sizes = rows.groupBy("book", "chapter", "chunk").agg(F.sum("words").alias("w"))
    small = F.count_if(F.col("w") < max(35, int(least * 0.4)))
    return sizes.groupBy("book", "chapter").agg(((F.count_if(F.col("w") > int(most * 1.4)) == 0) & (small <= F.greatest(F.lit(1), F.floor(F.count("*") / 2)))).alias("valid"))


def chunk_numbers(paragraphs: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """(book, chapter, idx, words, chunk) by the whole rule: word counts for the first chapters of middling length, if valid, else scores."""
    scored = cut(chapters(boundary_scores(paragraphs), "score"))
    by_score = merged_small(numbered(scored, greedy_scores(F.col("items"), least, target, most)), max(80, least // 2))
    sized = scored.select("book", "chapter", "items", F.size("items").between(LEAST_PARAGRAPHS, MOST_PARAGRAPHS).alias("fits"))
    first = Window.partitionBy("book", "fits").orderBy("chapter")
    chosen = sized.where("fits").withColumn("k", F.row_number().over(first)).where(F.col("k") <= MOST_CHAPTERS)
    by_words = merged_small(numbered(chosen, greedy_words(F.col("items"), target)), max(40, least // 2))
    # Chunks over the most are split again by scores, which numbers them anew within the chapter.
    wide = cut(by_words).withColumn("chunk_words", F.sum("words").over(Window.partitionBy("book", "chapter", "chunk")))
    scores = scored.select("book", "chapter", F.explode("items").alias("i")).select("book", "chapter", "i.idx", "i.score")
    again = wide.where(F.col("chunk_words") > most).join(scores, ["book", "chapter", "idx"])
    parts = again.groupBy("book", "chapter", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "words", "score"))).alias("items"), F.min("idx").alias("lo"))
    local = F.transform("items", lambda x: F.struct((x["idx"] - F.col("lo") + 1).alias("idx"), x["words"].alias("words"), x["score"].alias("score")))
    parts = parts.withColumn("local", local)
    again = parts.select("book", "chapter", "chunk", F.explode(F.arrays_zip(F.col("items"), greedy_scores(F.col("local"), least, target, most).alias("sub"))).alias("z")).select("book", "chapter", "chunk", "z.items.idx", "z.items.words", "z.sub")
    sub = Window.partitionBy("book", "chapter", "chunk", "sub")
    run = Window.partitionBy("book", "chapter", "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    again = again.withColumn("w", F.sum("words").over(sub)).withColumn("head", F.col("idx") == F.min("idx").over(sub))
    again = again.withColumn("sub", F.sum((F.col("head") & ((F.col("sub") == 0) | (F.col("w") >= max(80, least // 2)))).cast("int")).over(run) - 1)
    joined = wide.where(F.col("chunk_words") <= most).select("book", "chapter", "idx", "words", "chunk", F.lit(0).alias("sub")).unionByName(again.select("book", "chapter", "idx", "words", "chunk", "sub"))
    dense = F.dense_rank().over(Window.partitionBy("book", "chapter").orderBy("chunk", "sub")) - 1
    by_words = cut(merged_small(joined.select("book", "chapter", "idx", "words", dense.alias("chunk")), max(40, least // 2)))
    good = valid_chapters(by_words, least, most).where("valid").select("book", "chapter")
    return by_words.join(good, ["book", "chapter"], "left_semi").unionByName(by_score.join(good, ["book", "chapter"], "left_anti"))


def split_at(paragraphs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(book, chapter, idx, words, chunk): chapters cut after the paragraphs that boundaries(book, chapter, after) name.

    after is an array of numbers or texts from anywhere, a model's reply for one; what is no place in the chapter is
    left out, and the last paragraph always ends a chunk. A chapter without a row is one chunk.
    """
    rows = paragraphs.select("book", "chapter", "idx", "words", F.max("idx").over(Window.partitionBy("book", "chapter")).alias("n"))
    rows = rows.join(boundaries.select("book", "chapter", "after"), ["book", "chapter"], "left")
    ends = clean_boundaries(F.coalesce(F.col("after").cast("array<string>"), F.array().cast("array<string>")), F.col("n"))
    before = F.size(F.filter(ends, lambda e: e < F.col("idx")))
    return rows.select("book", "chapter", "idx", "words", before.alias("chunk"))


def blocks(paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """book, order_number, title, chapter, chapter_title, start_paragraph, end_paragraph, source_text, token_count."""
    rows = paragraphs.join(chunks.select("book", "chapter", "idx", "chunk"), ["book", "chapter", "idx"])
    out = rows.groupBy("book", "chapter", "chunk").agg(
        F.first("chapter_title").alias("chapter_title"), F.min("number").alias("start_paragraph"), F.max("number").alias("end_paragraph"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n\n").alias("source_text"),
    )
    several = F.count("*").over(Window.partitionBy("book", "chapter")) > 1
    place = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("chunk"))
    title = F.when(several, F.format_string("%s — блок %d", "chapter_title", place)).otherwise(F.col("chapter_title"))
    order = F.row_number().over(Window.partitionBy("book").orderBy("start_paragraph"))
    return out.select("book", order.alias("order_number"), title.alias("title"), "chapter", "chapter_title", "start_paragraph", "end_paragraph", "source_text", T.word_count(F.col("source_text")).alias("token_count"))


def logical_blocks(lines: DataFrame, least: int = 260, target: int = 760, most: int = 1300) -> DataFrame:
    paragraphs = kept_paragraphs(lines)
    return blocks(paragraphs, chunk_numbers(paragraphs, least, target, most))
