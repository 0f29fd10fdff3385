"""Exports of a book's blocks and concepts, and writing of analysis tables."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concept_rows(blocks: DataFrame, mentions: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """block_title, concept, explanation, quote, importance in block order, best first; edits(mention_id, custom) stand in.

    Concepts go to blocks by title, so blocks of one title share theirs.
    """
    if edits is not None:
        mentions = mentions.join(edits, "mention_id", "left").withColumn("explanation", F.coalesce("custom", "explanation")).drop("custom")
    rows = blocks.select("book_id", "order_number", "title").join(mentions, ["book_id", "title"], "left")
    return rows.orderBy("book_id", "order_number", F.desc_nulls_last("importance"), "mention_id")


def nested(blocks: DataFrame, mentions: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """book_id, payload: a book's blocks with their concepts as one JSON text.

    With books(book_id, title, authors, original_filename, summary) the payload begins with the book and its summary.
    """
    concepts = mentions.groupBy("book_id", "title").agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("_order"), "mention_id", "name", "explanation"))).alias("c"))
    rows = blocks.join(concepts, ["book_id", "title"], "left")
    own = F.transform(F.coalesce("c", F.expr("cast(array() as array<struct<_order:double,mention_id:bigint,name:string,explanation:string>>)")), lambda x: F.struct(x["name"].alias("name"), x["explanation"].alias("explanation")))
    items = F.array_sort(F.collect_list(F.struct("order_number", "title", own.alias("concepts"))))
    out = rows.groupBy("book_id").agg(items.alias("blocks"))
    fields = [F.col("blocks")]
    if books is not None:
        out = books.join(out, "book_id", "left")
        head = F.struct(F.col("book_id").alias("id"), "title", *[F.coalesce(c, F.lit("")).alias(c) for c in ("authors", "original_filename")])
        fields = [head.alias("book"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("blocks", F.array().cast("array<struct<order_number:int,title:string,concepts:array<struct<name:string,explanation:string>>>>")).alias("blocks")]
    return out.select("book_id", F.to_json(F.struct(*fields)).alias("payload"))


def report(rows: DataFrame) -> DataFrame:
    """book_id, text: a line for each block and its concepts, from rows(book_id, order_number, title, names)."""
    line = F.format_string("%d. %s: %s", "order_number", "title", F.coalesce("names", F.lit("-")))
    lines = F.array_sort(F.collect_list(F.struct("order_number", line.alias("line"))))
    return rows.groupBy("book_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def full_report(books: DataFrame, blocks: DataFrame, mentions: DataFrame) -> DataFrame:
    """book_id, text: title, authors, summary, then numbered blocks and concepts, as a reader gets them.

    books(book_id, title, authors, summary), blocks(book_id, order_number, title, chapter_title, short_summary),
    mentions(book_id, order_number, mention_id, block_title, name, importance, explanation, quote).
    """

    def said(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))

    def numbered(x: Column, i: Column) -> Column:
        return F.concat((i + 1).cast("string"), F.lit(". "), x["t"])

    block = F.concat("title", F.lit("\n   Chapter: "), said("chapter_title"), F.lit("\n   Short summary: "), said("short_summary"), F.lit("\n"))
    b = blocks.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("order_number", block.alias("t")))).alias("b"))
    concept = F.concat("name", F.lit("\n   Block: "), "block_title", F.lit("\n   Explanation: "), F.coalesce("explanation", F.lit("")), F.lit("\n   Quote: "), F.coalesce("quote", F.lit("")), F.lit("\n"))
    m = mentions.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("order_number", (-F.col("importance")).alias("i"), "mention_id", concept.alias("t")))).alias("m"))
    head = [F.concat(F.lit("Book: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Authors: "), said("authors")), F.lit("\nSummary:"), said("summary"), F.lit("\nLogical blocks:")]
    rows = books.join(b, "book_id", "left").join(m, "book_id", "left")
    return rows.select("book_id", F.concat_ws("\n", *head, F.transform("b", numbered), F.lit("Concepts:"), F.transform("m", numbered)).alias("text"))


def csv_bytes(rows: DataFrame) -> bytes:
    """One book's rows as CSV with a byte-order mark and CRLF. For whole tables use df.write.csv."""
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(rows.columns)
    for r in rows.toLocalIterator():
        writer.writerow(r)
    return out.getvalue().encode("utf-8-sig")


def export(rows: DataFrame, path: str, kind: str) -> None:
    writers = {"csv": lambda w: w.option("header", True).option("lineSep", "\r\n").csv(path), "json": lambda w: w.json(path), "txt": lambda w: w.text(path), "parquet": lambda w: w.parquet(path)}
    if kind not in writers:
        raise ValueError(f"unknown format: {kind}")
    writers[kind](rows.write.mode("overwrite"))


def metadata(book: DataFrame, **counts: DataFrame) -> DataFrame:
    """book(book_id, metadata map) with <name>_count entries merged over it."""
    for name, table in counts.items():
        n = table.groupBy("book_id").agg(F.count("*").alias("n"))
        book = book.join(n, "book_id", "left")
        book = book.withColumn("metadata", _with_entry(f"{name}_count", F.coalesce("n", F.lit(0)).cast("string"))).drop("n")
    return book


def _with_entry(key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter("metadata", lambda k, _: k != key), F.create_map(F.lit(key), value))


def overwrite_books(rows: DataFrame, path: str) -> None:
    """Replace the partitions (file_hash) that rows hold, leaving other books as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_hash").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new)


def without(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key).where(" and ".join(f"{k} is not null" for k in key)).distinct(), key, "left_anti")


def upserted_vectors(old: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """old and new are (embedding_id, embedding): new ones replace old ones of their id; ids of gone(embedding_id) go, null or empty ones aside."""
    rows = upserted(old, new, ["embedding_id"])
    return rows if gone is None else without(rows, gone.where("embedding_id <> ''"), ["embedding_id"])


def block_vectors(blocks: DataFrame, vector: Column) -> DataFrame:
    """(embedding_id, embedding) of blocks(block_id, ...)."""
    return blocks.select(F.format_string("block:%d", "block_id").alias("embedding_id"), vector.alias("embedding"))
