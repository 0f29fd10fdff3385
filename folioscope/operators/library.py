"""Queries over a library: user_books, blocks, concepts, mentions, edits.

Visibility is a semi join by default, so a user with two copies of a book sees a mention once;
keep_duplicates=True joins instead and returns it once for each copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.vectors import cosine, embedded, embedding

# Fixed values.
BOOK_LIMIT, UPLOAD_LIMIT = 50, 50 * 1024 * 1024
EXTENSIONS = [".fb2", ".pdf"]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def my_books(books: DataFrame, user: int, number: int = 1, size: int = 20) -> DataFrame:
    return page(books.where(F.col("user_id") == user), [F.desc("uploaded_at"), F.desc("id")], number, size)


def with_counts(rows: DataFrame, on: str, **tables: DataFrame) -> DataFrame:
    """rows with <name>_count for each table, by its column `on`; 0 where there are none."""
    for name, table in tables.items():
        counts = table.groupBy(on).agg(F.count("*").alias(f"{name}_count"))
        rows = rows.join(counts, on, "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)).cast("long"))
    return rows


def visible(rows: DataFrame, books: DataFrame, user: int | None = None, keep_duplicates: bool = False) -> DataFrame:
    """Rows of books that the user holds; without a user, of every user, with user_id."""
    if user is None:
        held = books.select("user_id", "book_id")
        return rows.join(held if keep_duplicates else held.distinct(), "book_id")
    held = books.where(F.col("user_id") == user).select("book_id")
    return rows.join(held, "book_id", "inner" if keep_duplicates else "left_semi")


def library_header(books: DataFrame, limit: int = BOOK_LIMIT) -> DataFrame:
    """One row a user: books, protected books, and the oldest unprotected book of a full library."""
    free = F.when(~F.col("is_protected"), F.struct("uploaded_at", "id"))
    rows = books.groupBy("user_id").agg(F.count("*").alias("books"), F.count_if("is_protected").alias("protected"), F.min(free).alias("oldest"))
    return rows.select("user_id", "books", "protected", F.when(F.col("books") >= limit, F.col("oldest.id")).alias("oldest_free"))


def rotation(books: DataFrame, confirmed: bool = False, limit: int = BOOK_LIMIT) -> DataFrame:
    """user_id, can_upload, need_confirmation, reason, book_to_delete."""
    head = library_header(books, limit)
    full, none = F.col("books") >= limit, F.col("oldest_free").isNull()
    reason = F.when(~full, "ok").when(none, "all_protected").when(F.lit(confirmed), "rotate").otherwise("confirm")
    return head.select("user_id", (~full | (~none & F.lit(confirmed))).alias("can_upload"), (full & ~none & ~F.lit(confirmed)).alias("need_confirmation"), reason.alias("reason"), F.when(full, F.col("oldest_free")).alias("book_to_delete"))


def batch_check(requests: DataFrame, books: DataFrame, limit: int = BOOK_LIMIT) -> DataFrame:
    """requests(user_id, files, confirmed) -> status 200, 409 (confirmation wanted) or 400 (nothing may go)."""
    head = library_header(books, 0).select("user_id", "books", "oldest_free")
    rows = requests.join(head, "user_id", "left")
    over = F.coalesce("books", F.lit(0)) + F.col("files") > limit
    return rows.select("user_id", "files", F.when(~over | F.col("confirmed"), 200).when(F.col("oldest_free").isNull(), 400).otherwise(409).alias("status"))


def upload_gate(files: DataFrame, cache: DataFrame, need_themes: bool = True) -> DataFrame:
    """files(user_id, filename, size, file_hash) with cache(file_hash, has_blocks, has_themes): the verdict on each upload."""
    ext = F.lower(F.regexp_extract(F.trim("filename"), r"(\.[^./]+)$", 1))
    ready = F.coalesce(F.col("has_blocks") & (F.col("has_themes") | F.lit(not need_themes)), F.lit(False))
    rows = files.join(cache, "file_hash", "left")
    verdict = F.when(F.col("size") > UPLOAD_LIMIT, "too_large").when(~ext.isin(EXTENSIONS), "bad_extension").when(F.col("size") == 0, "empty").when(ready, "ready").otherwise("processing")
    return rows.select("user_id", "filename", "file_hash", verdict.alias("verdict"), ((verdict == "processing") & F.col("has_blocks").isNotNull()).alias("force_reanalyze"))


def analysis_ready(cache: DataFrame, blocks: DataFrame, themes: DataFrame) -> DataFrame:
    return cache.join(blocks, "file_hash", "left_semi").join(themes, "file_hash", "left_semi")


def donors(books: DataFrame) -> DataFrame:
    """For books without a file, the newest other book of the same hash that has one."""
    having = books.where("file is not null").groupBy("file_hash").agg(F.max(F.struct("uploaded_at", "id", "file")).alias("d"))
    return books.where("file is null").join(having, "file_hash").select("id", F.col("d.id").alias("donor_id"), F.col("d.file").alias("file"))


def book_concepts(mentions: DataFrame, concepts: DataFrame, book: int, q: str = "", number: int = 1, size: int = 50) -> DataFrame:
    rows = mentions.where(F.col("book_id") == book).join(concepts, "concept_id")
    if q:
        rows = rows.where(T.contains_fold(F.col("name"), q) | T.contains_fold(F.col("normalized_name"), q))
    return page(rows, [F.desc("importance"), F.asc("mention_id")], number, size, 200)


def all_concepts(mentions: DataFrame, concepts: DataFrame, books: DataFrame, book: int | None = None) -> DataFrame:
    """user_id, concept_id, name, mentions, titles: per user, distinct mentions and sorted distinct titles."""
    rows = mentions if book is None else mentions.where(F.col("book_id") == book)
    rows = rows.join(books.select("user_id", "book_id", "title").distinct(), "book_id")
    out = rows.groupBy("user_id", "concept_id").agg(F.count_distinct("mention_id").alias("mentions"), F.array_join(F.array_sort(F.collect_set("title")), ", ").alias("titles"))
    return out.join(concepts.select("concept_id", "name"), "concept_id")


def edit_state(log: DataFrame) -> DataFrame:
    """log(user_id, mention_id, text, ts, op): the standing text of each (user, mention); resets remove it."""
    last = log.groupBy("user_id", "mention_id").agg(F.max(F.struct("ts", "op", "text")).alias("x"))
    return last.where("x.op <> 'reset'").select("user_id", "mention_id", F.col("x.text").alias("custom"))


def effective_explanations(mentions: DataFrame, edits: DataFrame, user: int | None = None) -> DataFrame:
    own = edits if user is None else edits.where(F.col("user_id") == user)
    return mentions.join(own.select("mention_id", "custom"), "mention_id", "left").withColumn("effective", F.coalesce("custom", "explanation"))


def latest_books(books: DataFrame) -> DataFrame:
    """The newest copy that a user holds of each book."""
    return books.groupBy("user_id", "book_id").agg(F.max_by("id", F.struct("uploaded_at", "id")).alias("user_book_id"))


def hybrid_search(concepts: DataFrame, scores: DataFrame, q: str, most: int = 10) -> DataFrame:
    """Concepts that contain q, and the best by score(concept_id, score): each once, best first."""
    best = scores.orderBy(F.desc("score"), "concept_id").limit(most)
    direct = concepts.where(T.contains_fold(F.col("name"), q) | T.contains_fold(F.col("normalized_name"), q)).select("concept_id")
    found = direct.union(best.select("concept_id")).distinct().join(best, "concept_id", "left")
    return found.join(concepts.select("concept_id", "name"), "concept_id").select("concept_id", "name", F.coalesce("score", F.lit(0.0)).alias("score"))


def nearest_to(vectors: DataFrame, asked: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows of highest cosine to the vector of the one row of asked(vec); none without it."""
    one = asked.select(F.col(vec).alias("_asked")).limit(1)
    rows = vectors.withColumn("_on", F.lit(1)).join(F.broadcast(one.withColumn("_on", F.lit(1))), "_on")
    return rows.select(key, cosine(F.col(vec), F.col("_asked")).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest(vectors: DataFrame, query: list[float], k: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows of highest cosine to the query vector: a scan with a top-k in each task."""
    score = cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def similar_blocks(blocks: DataFrame, books: DataFrame, query: str, user: int, k: int = 5, load=None) -> DataFrame:
    """The user's k blocks (book_id, order_number, title, short_summary, source_text) nearest to the words of a query."""
    text = T.or_default(F.col("short_summary"), F.left("source_text", F.lit(3000)))
    return _similar(visible(blocks, books, user).withColumn("text", text), query, ["book_id", "order_number"], k, load)


def similar_concepts(concepts: DataFrame, mentions: DataFrame, books: DataFrame, query: str, user: int, k: int = 10, load=None) -> DataFrame:
    """The k concepts (concept_id, name, description) nearest to a query, of those that the user's books mention."""
    own = visible(mentions, books, user).select("concept_id").distinct()
    return _similar(concepts.join(own, "concept_id", "left_semi").withColumn("text", F.concat_ws(". ", "name", "description")), query, ["concept_id"], k, load)


def _similar(rows: DataFrame, query: str, key: list[str], k: int, load) -> DataFrame:
    asked = F.array(*[F.lit(x) for x in embedded(query, load)])
    scored = rows.withColumn("score", cosine(embedding("text", load), asked)).drop("text")
    return scored.orderBy(F.desc("score"), *key).limit(k)


def concept_page(mentions: DataFrame, concepts: DataFrame, books: DataFrame, blocks: DataFrame, edits: DataFrame, concept: int, user: int) -> DataFrame:
    """A concept's mentions in the user's library, best first, with the user's own explanations and newest copies; none if it isn't there."""
    own = visible(mentions.where(F.col("concept_id") == concept), books, user, keep_duplicates=True)
    own = effective_explanations(own, edits, user).join(concepts.select("concept_id", "name"), "concept_id")
    titles = blocks.select("book_id", F.col("order_number").alias("block_no"), F.col("title").alias("block_title"))
    newest = latest_books(books.where(F.col("user_id") == user)).drop("user_id")
    return own.join(titles, ["book_id", "block_no"], "left").join(newest, "book_id").orderBy(F.desc("importance"), F.desc("mention_id"))


def concept_context(mentions: DataFrame, concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every mention with its concept's name and block's title, in falling order of importance within the concept."""
    titles = blocks.select("book_id", F.col("order_number").alias("block_no"), F.col("title").alias("block_title"))
    rows = mentions.join(concepts.select("concept_id", "name"), "concept_id").join(titles, ["book_id", "block_no"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("concept_id").orderBy(F.desc("importance"), "mention_id")))


def concepts_by_name(mentions: DataFrame, concepts: DataFrame, books: DataFrame, q: str = "") -> DataFrame:
    """all_concepts() of which the name or the normalised name holds q, in order of their names."""
    if q:
        concepts = concepts.where(T.contains_fold(F.col("name"), q) | T.contains_fold(F.col("normalized_name"), T.concept_name(F.lit(q))))
    return all_concepts(mentions, concepts, books).orderBy("user_id", "name", "concept_id")


def book_page(book: DataFrame, blocks: DataFrame, themes: DataFrame, subtopics: DataFrame, mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """For each row of book(book_id, ...): blocks, themes with their subtopics, and mentions by importance and name, as arrays in order."""
    own = blocks.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("order_number", "title"))).alias("blocks"))
    below = subtopics.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_score"), "subtopic_id", "name"))).alias("s"))
    listed = themes.join(below, "theme_id", "left").select("book_id", F.struct("ord", "title", F.coalesce(F.transform("s", lambda x: x["name"]), F.array().cast("array<string>")).alias("subtopics")).alias("t"))
    listed = listed.groupBy("book_id").agg(F.array_sort(F.collect_list("t")).alias("themes"))
    named = mentions.join(concepts.select("concept_id", "name"), "concept_id")
    found = named.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("_score"), "name", "mention_id"))).alias("m"))
    rows = book.join(own, "book_id", "left").join(listed, "book_id", "left").join(found, "book_id", "left")
    return rows.withColumn("mentions", F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["mention_id"].alias("mention_id")))).drop("m")


def find_book(books: DataFrame, name: str) -> DataFrame:
    """For each user the newest book whose title holds a name."""
    rows = books.where(T.contains_fold(F.col("title"), name))
    return top_per_user(rows, [F.desc("uploaded_at"), F.desc("id")], 1).drop("rank")


def concept_cards(mentions: DataFrame, concepts: DataFrame, books: DataFrame, name: str, k: int = 10) -> DataFrame:
    """For each user the k best mentions of the first concept of all whose name holds a name."""
    first = concepts.where(T.contains_fold(F.col("name"), name)).orderBy("concept_id").limit(1).select("concept_id", "name")
    return top_per_user(visible(mentions.join(F.broadcast(first), "concept_id"), books, keep_duplicates=True), [F.desc("importance"), F.asc("mention_id")], k)


def found_concepts(mentions: DataFrame, concepts: DataFrame, books: DataFrame, q: str, k: int = 20) -> DataFrame:
    """For each user the first k concepts of the library whose names hold q."""
    rows = visible(mentions.select("book_id", "concept_id"), books).select("user_id", "concept_id").distinct()
    return top_per_user(rows.join(concepts.where(T.contains_fold(F.col("name"), q)).select("concept_id", "name"), "concept_id"), [F.asc("concept_id")], k)


def toggled(books: DataFrame, ids: DataFrame) -> DataFrame:
    """books with is_protected turned round for each id of ids."""
    marked = books.join(ids.select("id").distinct().withColumn("_turn", F.lit(True)), "id", "left")
    return marked.withColumn("is_protected", F.col("is_protected") != F.coalesce("_turn", F.lit(False))).drop("_turn")


def deleted(books: DataFrame, ids: DataFrame) -> DataFrame:
    """books without those of ids that aren't protected."""
    return books.join(deletable(books).join(ids.select("id"), "id", "left_semi").select("id"), "id", "left_anti")


def reanalysed(books: DataFrame, ids: DataFrame) -> DataFrame:
    """books with the status `processing` and no error for each id of ids."""
    marked = books.join(ids.select("id").distinct().withColumn("_again", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("_again"), "processing").otherwise(F.col("status"))).drop("_again")


def latest_status(log: DataFrame, most: int = 2000) -> DataFrame:
    """log(book, ts, error) of finished analyses: the last one's status, ready or failed, and its error."""
    last = log.groupBy("book").agg(F.max_by(F.struct("error"), "ts").alias("x"))
    return last.select("book", F.when(F.col("x.error").isNull(), "ready").otherwise("failed").alias("status"), F.left(F.coalesce("x.error", F.lit("")), F.lit(most)).alias("error_message"))


def compared_titles(mentions: DataFrame, books: DataFrame, least: int = 1) -> DataFrame:
    """user_id, concept_id, mentions, titles for concepts with at least `least` mentions."""
    rows = mentions.join(books.select("user_id", "book_id", "title").distinct(), "book_id")
    out = rows.groupBy("user_id", "concept_id").agg(F.count_distinct("mention_id").alias("mentions"), F.array_join(F.array_sort(F.collect_set("title")), ", ").alias("titles"))
    return out.where(F.col("mentions") >= least)


def user_stats(books: DataFrame, blocks: DataFrame, mentions: DataFrame, limit: int = BOOK_LIMIT) -> DataFrame:
    """user_id, books, protected, remaining, concepts, blocks; a book held twice counts once for blocks and concepts."""
    held = books.select("user_id", "book_id").distinct()
    own = books.groupBy("user_id").agg(F.count("*").alias("books"), F.count_if("is_protected").alias("protected"))
    n_blocks = held.join(blocks.groupBy("book_id").agg(F.count("*").alias("n")), "book_id").groupBy("user_id").agg(F.sum("n").alias("blocks"))
    n_concepts = held.join(mentions.select("book_id", "concept_id").distinct(), "book_id").groupBy("user_id").agg(F.count_distinct("concept_id").alias("concepts"))
    rows = own.join(n_blocks, "user_id", "left").join(n_concepts, "user_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("blocks", "concepts")}
    return rows.withColumns(zero).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("books")))


def top_per_user(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("rank") <= k)


def deletable(books: DataFrame) -> DataFrame:
    return books.where(~F.col("is_protected"))


def view_counts(log: DataFrame) -> DataFrame:
    return log.where(F.col("event_type") == "view").groupBy("user_id").agg(F.count("*").alias("views"), F.max("ts").alias("last_view"))
