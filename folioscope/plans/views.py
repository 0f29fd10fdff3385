"""The engine's tables as views of the driver's: documents as books of lines, orders as a library.

Each view has a DataFrame for Spark and, for the oracle, SQL that DuckDB runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of blocks that suit the short chapters of the test tables.
LEAST, TARGET, MOST = 40, 80, 160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; ten make a chapter."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    chapter = F.floor(F.col("p") / 10).cast("int") + 1
    return rows.select("book", chapter.alias("chapter"), F.format_string("Chapter %d", chapter).alias("chapter_title"), (F.col("p") + 1).alias("pos"), "text")


def user_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: two neighbouring ones are copies of one book; customers hold them."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.floor(F.col("o_orderkey") / 2).alias("book_id"), F.col("o_orderdate").alias("uploaded_at"),
        F.concat(F.lit("Book "), (F.col("o_orderkey") % 97).cast("string")).alias("title"), F.col("o_orderpriority").startswith("1").alias("is_protected"), F.col("o_orderstatus").alias("status"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: a part is mentioned in a block (line number) of a book."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mention_id"), F.col("l_partkey").alias("concept_id"), F.floor(F.col("l_orderkey") / 2).alias("book_id"),
        F.col("l_linenumber").alias("block_no"), (F.col("l_quantity") / 50).alias("importance"), F.concat("l_returnflag", "l_linestatus").alias("explanation"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("book_id", F.col("block_no").alias("order_number")).distinct().withColumn("title", F.concat(F.lit("Block "), (F.col("order_number") % 3).cast("string")))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), F.lower("p_name").alias("normalized_name"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of edits: returned items are edited, those with a tax over 6 per cent reset at a later time."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.lit(1).cast("long").alias("user_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mention_id"), F.concat(F.lit("edited "), F.col("l_linestatus")).alias("text"), F.lit(1).alias("ts"), F.lit("edit").alias("op"), "l_tax"
    )
    return rows.drop("l_tax").unionByName(rows.where("l_tax * 100 > 6.5").select("user_id", "mention_id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("ts"), F.lit("reset").alias("op")))


WORD = "[A-Za-zА-Яа-яЁё0-9-]+"
PARAGRAPHS = f"""
line as (select doc_id as book, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
para0 as (select book, cast((pos - 1) // 10 + 1 as integer) as chapter, 'Chapter ' || cast((pos - 1) // 10 + 1 as varchar) as chapter_title, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as text from line),
para as (select *, cast(row_number() over (partition by book order by pos) as integer) as number, cast(row_number() over (partition by book, chapter order by pos) as integer) as idx,
  cast(len(regexp_extract_all(text, '{WORD}')) as bigint) as words from para0 where length(text) >= 20)"""
#: Greedy chunks by words, small ones merged: chunk numbers from 0.
CHUNKS = (
    PARAGRAPHS
    + f""",
fold as (select book, chapter, idx, words, words as acc, 0 as raw from para where idx = 1 union all
  select p.book, p.chapter, p.idx, p.words, case when f.acc >= {TARGET} then p.words else f.acc + p.words end, f.raw + case when f.acc >= {TARGET} then 1 else 0 end
  from fold f join para p on p.book = f.book and p.chapter = f.chapter and p.idx = f.idx + 1),
sized as (select *, sum(words) over (partition by book, chapter, raw) as cw, row_number() over (partition by book, chapter, raw order by idx) as k from fold),
chunk as (select book, chapter, idx, words, cast(sum(case when k = 1 and (raw = 0 or cw >= {max(40, LEAST // 2)}) then 1 else 0 end) over (partition by book, chapter order by idx) - 1 as integer) as chunk from sized)"""
)
BLOCKS = (
    CHUNKS
    + f""",
block0 as (select book, chapter, chunk, any_value(chapter_title) as chapter_title, min(number) as start_paragraph, max(number) as end_paragraph, string_agg(text, chr(10) || chr(10) order by number) as source_text
  from para join chunk using (book, chapter, idx) group by book, chapter, chunk),
block1 as (select book, cast(row_number() over (partition by book order by start_paragraph) as integer) as order_number, case when count(*) over (partition by book, chapter) > 1 then chapter_title || ' — блок ' || cast(row_number() over (partition by book, chapter order by chunk) as varchar) else chapter_title end as title,
  chapter, chapter_title, start_paragraph, end_paragraph, source_text, cast(len(regexp_extract_all(source_text, '{WORD}')) as bigint) as token_count from block0),
pick as (select *, list_filter(list_transform(string_split(regexp_replace(source_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) >= 35) as whole,
  list_filter(list_transform(string_split(regexp_replace(source_text, '[.!?]+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) >= 35) as pieces from block1),
block as (select * exclude (whole, pieces), coalesce(nullif(trim(array_to_string(list_slice(case when len(whole) > 0 then whole else pieces end, 1, 3), ' '), ' '), ''), trim(left(source_text, 500), ' ')) as short_summary from pick)"""
)
LIBRARY = """
user_book as (select o_orderkey as id, o_custkey as user_id, o_orderkey // 2 as book_id, o_orderdate as uploaded_at, 'Book ' || cast(o_orderkey % 97 as varchar) as title, starts_with(o_orderpriority, '1') as is_protected, o_orderstatus as status from orders),
mention as (select l_orderkey * 8 + l_linenumber as mention_id, l_partkey as concept_id, l_orderkey // 2 as book_id, l_linenumber as block_no, l_quantity / 50 as importance, l_returnflag || l_linestatus as explanation from lineitem),
block as (select distinct book_id, block_no as order_number, 'Block ' || cast(block_no % 3 as varchar) as title from mention),
concept as (select p_partkey as concept_id, p_name as name, lower(p_name) as normalized_name from part),
edit as (select l_orderkey * 8 + l_linenumber as mention_id, max('edited ' || l_linestatus) as custom from lineitem where l_returnflag = 'R' group by 1 having not bool_or(l_tax * 100 > 6.5))"""
