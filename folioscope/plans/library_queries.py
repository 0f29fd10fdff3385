"""Queries on a library, its map and exports, and on sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.vectors import embedding
from folioscope.operators import export as X
from folioscope.operators import graph as G
from folioscope.operators import library as L
from folioscope.plans.analysis_queries import SUBTOPICS, hierarchy
from folioscope.plans.registry import query
from folioscope.plans.text_queries import SLOTS, word_blocks
from folioscope.plans.views import BLOCKS, LIBRARY, blocks, concepts, edits, mentions, table, user_books
from folioscope.sources import books as B
from folioscope.streaming.ingest import ingest
from folioscope.tables import cut, shared_dir


@query(f"with {LIBRARY} select id, title from user_book where user_id = 7 order by uploaded_at desc, id desc limit 20")
def my_books(spark, sf_dir):
    return L.my_books(user_books(spark, sf_dir), 7).select("id", "title")


@query(f"with {LIBRARY} select id, coalesce(b.n, 0) as blocks_count, coalesce(m.n, 0) as mentions_count from user_book left join (select book_id, count(*) as n from block group by 1) b using (book_id) left join (select book_id, count(*) as n from mention group by 1) m using (book_id)")
def book_counts(spark, sf_dir):
    return L.with_counts(user_books(spark, sf_dir), "book_id", blocks=blocks(spark, sf_dir), mentions=mentions(spark, sf_dir)).select("id", "blocks_count", "mentions_count")


@query(f"with {LIBRARY} select user_id, count(*) as books, count(*) filter (is_protected) as protected, case when count(*) >= 5 then arg_min(id, (uploaded_at, id)) filter (not is_protected) end as oldest_free from user_book group by user_id")
def library_header(spark, sf_dir):
    return L.library_header(user_books(spark, sf_dir), 5)


@query(f"""with {LIBRARY}, h as (select user_id, count(*) as n, arg_min(id, (uploaded_at, id)) filter (not is_protected) as o from user_book group by user_id)
select user_id, n < 5 as can_upload, n >= 5 and o is not null as need_confirmation, case when n < 5 then 'ok' when o is null then 'all_protected' else 'confirm' end as reason, case when n >= 5 then o end as book_to_delete from h""")
def rotation_candidate(spark, sf_dir):
    return L.rotation(user_books(spark, sf_dir), limit=5)


@query(f"""with {LIBRARY}, h as (select user_id, count(*) as n, count(*) filter (not is_protected) as free from user_book group by user_id)
select c_custkey as user_id, c_nationkey % 4 as files, case when coalesce(n, 0) + c_nationkey % 4 <= 12 or c_custkey % 2 = 0 then 200 when coalesce(free, 0) = 0 then 400 else 409 end as status from customer left join h on user_id = c_custkey""")
def batch_limit(spark, sf_dir):
    req = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 4).alias("files"), (F.col("c_custkey") % 2 == 0).alias("confirmed"))
    return L.batch_check(req, user_books(spark, sf_dir), 12)


@query("""with f as (select doc_id, source, n_chars * 40000 as size, sha256(text) as h from documents), c as (select sha256(text) as h, bool_or(quality is not null) as themes from documents left join labels using (doc_id) group by 1)
select doc_id as user_id, case when size > 52428800 then 'too_large' when doc_id % 5 = 0 then 'bad_extension' when themes then 'ready' else 'processing' end as verdict,
  case when size > 52428800 then false when doc_id % 5 = 0 then false when themes then false else true end as force_reanalyze from f join c using (h)""")
def cache_reuse(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    files = docs.select(F.col("doc_id").alias("user_id"), F.when(F.col("doc_id") % 5 == 0, "a.doc").otherwise(" A.FB2 ").alias("filename"), (F.col("n_chars") * 40000).alias("size"), F.sha2("text", 256).alias("file_hash"))
    cache = docs.join(labels, "doc_id", "left").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.lit(True).alias("has_blocks"), F.bool_or(F.col("quality").isNotNull()).alias("has_themes"))
    return L.upload_gate(files, cache).select("user_id", "verdict", "force_reanalyze")


@query("select distinct sha256(text) as file_hash from documents where sha256(text) in (select sha256(text) from documents join labels using (doc_id) where quality = 1) and sha256(text) in (select sha256(text) from documents join labels using (doc_id) where toxic = 0)")
def analysis_ready(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash")), table(spark, sf_dir, "labels")
    own = docs.join(labels, "doc_id")
    return L.analysis_ready(docs.select("file_hash").distinct(), own.where("quality = 1"), own.where("toxic = 0"))


@query("""with b as (select doc_id as id, sha256(text) as h, case when doc_id % 3 = 0 then source end as file from documents)
select b.id, d.donor_id, d.file from b join (select h, max(id) as donor_id, arg_max(file, id) as file from b where file is not null group by h) d using (h) where b.file is null""")
def donor_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("file"), F.col("doc_id").alias("uploaded_at"))
    return L.donors(rows)


@query(f"""with {LIBRARY} select id, title, (select count(*) from block b where b.book_id = u.book_id) as blocks_count, coalesce(v.views, 0) as views from user_book u left join (select user_id, count(*) as views from events where event_type = 'view' group by 1) v using (user_id)""")
def book_detail(spark, sf_dir):
    views = L.view_counts(table(spark, sf_dir, "events")).select("user_id", "views")
    rows = L.with_counts(user_books(spark, sf_dir), "book_id", blocks=blocks(spark, sf_dir)).join(views, "user_id", "left")
    return rows.select("id", "title", "blocks_count", F.coalesce("views", F.lit(0)).alias("views"))


@query(f"with {LIBRARY} select order_number, n as concepts_count from block join (select book_id, block_no as order_number, count(*) as n from mention group by 1, 2) using (book_id, order_number) where book_id = 3 order by order_number limit 30")
def blocks_page(spark, sf_dir):
    own = blocks(spark, sf_dir).where("book_id = 3")
    counts = mentions(spark, sf_dir).where("book_id = 3").groupBy(F.col("block_no").alias("order_number")).agg(F.count("*").alias("concepts_count"))
    return L.page(own.join(counts, "order_number", "left"), [F.asc("order_number")], 1, 30, 200).select("order_number", "concepts_count")


@query(f"with {LIBRARY} select mention_id, name, importance, coalesce(custom, explanation) as effective, user_id from mention join concept using (concept_id) left join edit using (mention_id) join (select distinct user_id, book_id from user_book) using (book_id)")
def block_detail(spark, sf_dir):
    rows = mentions(spark, sf_dir).join(concepts(spark, sf_dir), "concept_id")
    rows = L.effective_explanations(rows, L.edit_state(edits(spark, sf_dir)))
    return L.visible(rows, user_books(spark, sf_dir)).select("mention_id", "name", "importance", "effective", "user_id")


@query(f"with {LIBRARY} select mention_id, concept_id, name from mention join concept using (concept_id) where book_id = 5 and contains(upper(name), 'E') order by importance desc, mention_id limit 50")
def book_concepts(spark, sf_dir):
    return L.book_concepts(mentions(spark, sf_dir), concepts(spark, sf_dir), 5, "e").select("mention_id", "concept_id", "name")


@query(f"with {LIBRARY} select user_id, concept_id, name, count(distinct mention_id) as mentions, array_to_string(list_sort(list(distinct title)), ', ') as titles from mention join user_book using (book_id) join concept using (concept_id) group by 1, 2, 3")
def all_concepts(spark, sf_dir):
    return L.all_concepts(mentions(spark, sf_dir), concepts(spark, sf_dir), user_books(spark, sf_dir))


@query(f"with {LIBRARY} select user_id, concept_id, mention_id, importance from mention join user_book using (book_id)")
def concept_detail(spark, sf_dir):
    return L.visible(mentions(spark, sf_dir), user_books(spark, sf_dir), keep_duplicates=True).select("user_id", "concept_id", "mention_id", "importance")


@query(f"with {LIBRARY} select mention_id, coalesce(custom, explanation) as effective from mention left join edit using (mention_id)")
def effective_explanation(spark, sf_dir):
    return L.effective_explanations(mentions(spark, sf_dir), L.edit_state(edits(spark, sf_dir))).select("mention_id", "effective")


@query(f"with {LIBRARY} select mention_id, custom from edit")
def edit_state(spark, sf_dir):
    return L.edit_state(edits(spark, sf_dir)).select("mention_id", "custom")


@query(f"with {LIBRARY} select user_id, book_id, arg_max(id, (uploaded_at, id)) as user_book_id from user_book group by 1, 2")
def latest_user_book(spark, sf_dir):
    return L.latest_books(user_books(spark, sf_dir))


@query(f"""with {LIBRARY}, s as (select p_partkey as concept_id, cast(p_size as double) / 100 as score from part order by score desc, concept_id limit 10),
f as (select concept_id from concept where contains(upper(name), 'RED') or contains(upper(normalized_name), 'RED') union select concept_id from s) select concept_id, name, coalesce(score, 0.0) as score from f join concept using (concept_id) left join s using (concept_id)""")
def concept_search(spark, sf_dir):
    scores = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), (F.col("p_size").cast("double") / 100).alias("score"))
    return L.hybrid_search(concepts(spark, sf_dir), scores, "red")


@query("""with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 0) select vec_id, cast(floor(list_cosine_similarity(cast(embedding as double[]), q) * 1e6 + 0.5) as bigint) as score_e6 from embeddings, q order by list_cosine_similarity(cast(embedding as double[]), q) desc, vec_id limit 5""")
def knn_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return L.nearest_to(rows, rows.where("vec_id = 0"), 5).select("vec_id", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


@query("""with q as (select cast(embedding as double[]) as q from embeddings where vec_id = 3) select vec_id, cast(floor(list_cosine_similarity(cast(embedding as double[]), q) * 1e6 + 0.5) as bigint) as score_e6 from embeddings, q where label = 3 order by list_cosine_similarity(cast(embedding as double[]), q) desc, vec_id limit 10""")
def knn_concepts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return L.nearest_to(rows.where("label = 3"), rows.where("vec_id = 3"), 10).select("vec_id", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


@query(f"with {LIBRARY} select user_id, concept_id, count(distinct mention_id) as mentions, array_to_string(list_sort(list(distinct title)), ', ') as titles from mention join user_book using (book_id) group by 1, 2 having count(distinct mention_id) >= 2")
def compare_titles(spark, sf_dir):
    return L.compared_titles(mentions(spark, sf_dir), user_books(spark, sf_dir), 2)


@query(f"""with {LIBRARY}, held as (select distinct user_id, book_id from user_book), o as (select user_id, count(*) as books, count(*) filter (is_protected) as protected from user_book group by 1)
select user_id, books, protected, coalesce(nb, 0) as blocks, coalesce(nc, 0) as concepts, greatest(0, 50 - books) as remaining from o left join (select user_id, count(*) as nb from held join block using (book_id) group by 1) using (user_id)
left join (select user_id, count(distinct concept_id) as nc from held join mention using (book_id) group by 1) using (user_id)""")
def user_stats(spark, sf_dir):
    rows = L.user_stats(user_books(spark, sf_dir), blocks(spark, sf_dir), mentions(spark, sf_dir))
    return rows.withColumn("blocks", F.col("blocks").cast("long"))


@query(f"with {LIBRARY}, r as (select user_id, id, title, cast(row_number() over (partition by user_id order by uploaded_at desc, id desc) as integer) as rank from user_book) select * from r where rank <= 3")
def bot_topk(spark, sf_dir):
    return L.top_per_user(user_books(spark, sf_dir).select("user_id", "id", "title", "uploaded_at"), [F.desc("uploaded_at"), F.desc("id")], 3).drop("uploaded_at")


@query(f"with {LIBRARY} select id from user_book where not is_protected and status = 'F'")
def deletable_books(spark, sf_dir):
    return L.deletable(user_books(spark, sf_dir)).where("status = 'F'").select("id")


@query(f"with {LIBRARY} select id from user_book where user_id = 9 and contains(upper(title), 'BOOK 1')")
def access_isolation(spark, sf_dir):
    return user_books(spark, sf_dir).where((F.col("user_id") == 9) & T.contains_fold(F.col("title"), "book 1")).select("id")


@query(f"""with {LIBRARY}, f as (select *, row_number() over (partition by user_id, book_id order by title, id) as k from user_book where book_id in (select book_id from mention where importance > 0.9))
select user_id, book_id, id, cast(row_number() over (partition by user_id order by title, id) as integer) as ord from f where k = 1""")
def map_books(spark, sf_dir):
    return G.map_books(user_books(spark, sf_dir), mentions(spark, sf_dir).where("importance > 0.9")).select("user_id", "book_id", "id", "ord")


def _themes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("book_id"), F.col("vec_id").alias("theme_id"), F.format_string("Theme %d", "vec_id").alias("title"), F.format_string("About %d", "vec_id").alias("summary"), F.col("embedding").alias("vec"), F.col("vec_id").alias("ord"))


def _subtopics(spark, sf_dir):
    """All events, dealt over all themes."""
    themes = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("themes")).withColumn("one", F.lit(1))
    rows = table(spark, sf_dir, "events").withColumn("one", F.lit(1)).join(F.broadcast(themes), "one")
    return rows.select((F.col("event_id") % F.col("themes")).alias("theme_id"), F.col("event_id").alias("subtopic_id"), F.col("event_type").alias("name"), F.col("props").alias("summary"), ((F.col("event_id") % 130) / 100).alias("score"))


_MAP = """theme as (select label as book_id, vec_id as theme_id, 'Theme ' || cast(vec_id as varchar) as title, 'About ' || cast(vec_id as varchar) as summary from embeddings),
subtopic as (select event_id % (select count(*) from embeddings) as theme_id, event_id as subtopic_id, event_type as name, props as summary, (event_id % 130) / 100 as score from events)"""


@query(f"""with {_MAP}, n as (select theme.*, coalesce(k, 0) as k from theme left join (select theme_id, count(*) as k from subtopic group by 1) using (theme_id)),
b as (select book_id, count(*) as t, cast(sum(k) as bigint) as k from n group by book_id)
select 'book-' || cast(book_id as varchar) as id, 'book' as kind, 'Book ' || cast(book_id as varchar) as label, 2800 as size_e2, null as parent, 'All of ' || cast(book_id as varchar) as summary, t as themes_count, k as subtopics_count from b union all
select 'theme-' || cast(theme_id as varchar), 'theme', title, 1800, 'book-' || cast(book_id as varchar), summary, null, k from n union all
select 'subtopic-' || cast(subtopic_id as varchar), 'subtopic', name, 1000 + 7 * least(100, subtopic_id % 130), 'theme-' || cast(theme_id as varchar), summary, null, null from subtopic""")
def map_nodes(spark, sf_dir):
    themes = _themes(spark, sf_dir)
    books = themes.select("book_id", F.format_string("Book %d", "book_id").alias("title"), F.format_string("All of %d", "book_id").alias("summary")).distinct()
    return G.nodes(books, themes, _subtopics(spark, sf_dir)).withColumn("size_e2", F.floor(F.col("size") * 100 + 0.5).cast("long")).drop("size")


@query(f"""with {_MAP} select 'book-' || cast(book_id as varchar) as source, 'theme-' || cast(theme_id as varchar) as target, 100 as weight_e2 from theme union all select 'theme-' || cast(theme_id as varchar), 'subtopic-' || cast(subtopic_id as varchar), subtopic_id % 130 from subtopic""")
def map_contains_edges(spark, sf_dir):
    return G.contains_edges(_themes(spark, sf_dir), _subtopics(spark, sf_dir)).select("source", "target", F.floor(F.col("weight") * 100 + 0.5).cast("long").alias("weight_e2"))


#: Themes of the documents with what is embedded of them, and the slots of the first 220.
_THEME_TEXTS = (
    SUBTOPICS
    + """,
names as (select book, theme, string_agg(name, ', ' order by idx) as names from subtopic group by 1, 2),
said as (select 100000 * book + theme as doc_id, book, left(title || '. ' || left(summary, 2000) || '. ' || chapter_title || '. ' || coalesce(names, ''), 3200) as text from theme left join names using (book, theme) order by 1 limit 220)"""
)


def _document_themes(spark, sf_dir):
    """Themes of documents with an id that goes by book and place."""
    themes, subtopics = hierarchy(spark, sf_dir)
    key = (F.lit(100000) * F.col("book") + F.col("theme")).alias("theme_id")
    below = subtopics.select(key, F.col("idx").alias("subtopic_id"), "name", F.col("importance").alias("score"))
    return G.theme_texts(themes.select(key, F.col("book").alias("book_id"), "title", "summary", "chapter_title"), below)


@query(f"""with recursive {_THEME_TEXTS} select book as book_id, doc_id as theme_id, text from said""")
def map_theme_texts(spark, sf_dir):
    """Of the first 220 themes, as a map shows no more related ones."""
    return _document_themes(spark, sf_dir).orderBy("theme_id").limit(G.MOST_THEMES).select("book_id", "theme_id", "text")


@query(f"""with recursive {_THEME_TEXTS}, {SLOTS.format('said')}, norm as (select doc_id, sqrt(sum(v * v)) as n from slot group by 1),
pair as (select a.doc_id as source, b.doc_id as target, sum(x.v * y.v) as d from said a join said b on a.doc_id < b.doc_id and a.book <> b.book join slot x on x.doc_id = a.doc_id join slot y on y.doc_id = b.doc_id and x.slot = y.slot group by 1, 2),
edge as (select source, target, d / (p.n * q.n) as w from pair join norm p on p.doc_id = source join norm q on q.doc_id = target)
select source, target, cast(floor(w * 1e4 + 0.5) as bigint) as weight_e4 from edge where w >= 0.82 order by floor(w * 1e4 + 0.5) desc, source, target limit 180""")
def map_related_edges(spark, sf_dir):
    themes = _document_themes(spark, sf_dir).withColumn("ord", F.col("theme_id")).orderBy("ord").limit(G.MOST_THEMES)
    edges = G.related_edges(themes.withColumn("vec", embedding("text")))
    return edges.select("source", "target", F.floor(F.col("weight") * 1e4 + 0.5).cast("long").alias("weight_e4"))


_RELATED = """first as (select vec_id as ord, label as book_id, vec_id as theme_id, cast(embedding as double[]) as v from embeddings order by vec_id limit 220),
edge as (select a.ord as oa, b.ord as ob, a.book_id as ba, b.book_id as bb, a.theme_id as source, b.theme_id as target, list_cosine_similarity(a.v, b.v) as w from first a join first b on a.ord < b.ord and a.book_id <> b.book_id)"""


_LAYOUT = (
    _MAP
    + """, b as (select book_id, row_number() over (order by book_id) as i, count(*) over () as n from (select distinct book_id from theme)),
p as (select book_id, case when n = 1 then 1300.0 else 1300.0 + cos(2 * pi() * (i - 1) / n) * 510 end as bx, case when n = 1 then 750.0 else 750.0 + sin(2 * pi() * (i - 1) / n) * 510 end as hy from b),
t as (select book_id, theme_id, row_number() over (partition by book_id order by theme_id) - 1 as i, count(*) over (partition by book_id) as n from theme),
placed as (select theme_id, case when n = 1 then bx else bx + cos(-pi() / 2 + 2 * pi() * i / n) * greatest(120, least(220, 80 + 14 * n)) end as x, case when n = 1 then hy else hy + sin(-pi() / 2 + 2 * pi() * i / n) * greatest(120, least(220, 80 + 14 * n)) end as y from t join p using (book_id)),
s as (select theme_id, subtopic_id, row_number() over (partition by theme_id order by subtopic_id % 130 desc, subtopic_id) - 1 as i, count(*) over (partition by theme_id) as n from subtopic)"""
)


def _placed(spark, sf_dir):
    themes = _themes(spark, sf_dir)
    books = themes.select("book_id").distinct()
    # A map's books are one user's, so few; they are ordered in one task.
    books = books.select("book_id", F.row_number().over(Window.orderBy("book_id")).alias("ord"), F.count("*").over(Window.partitionBy()).alias("total"))
    return G.layout(books, themes)


@query(f"with {_LAYOUT} select theme_id, cast(floor(x * 100 + 0.5) as bigint) as x_e2, cast(floor(y * 100 + 0.5) as bigint) as y_e2 from placed")
def map_layout(spark, sf_dir):
    return _placed(spark, sf_dir).select("theme_id", F.floor(F.col("x") * 100 + 0.5).cast("long").alias("x_e2"), F.floor(F.col("y") * 100 + 0.5).cast("long").alias("y_e2"))


@query(f"""with {_LAYOUT}, q as (select s.*, x as cx, y as cy, greatest(74, least(145, 62 + 10 * n)) as r from s join placed using (theme_id))
select theme_id, subtopic_id, cast(floor(case when n = 1 then cx else cx + cos(pi() / 2 + 2 * pi() * i / n) * r end * 100 + 0.5) as bigint) as x_e2, cast(floor(case when n = 1 then cy else cy + sin(pi() / 2 + 2 * pi() * i / n) * r end * 100 + 0.5) as bigint) as y_e2 from q""")
def map_subtopic_layout(spark, sf_dir):
    rows = G.subtopic_layout(_placed(spark, sf_dir), _subtopics(spark, sf_dir))
    return rows.select("theme_id", "subtopic_id", F.floor(F.col("x") * 100 + 0.5).cast("long").alias("x_e2"), F.floor(F.col("y") * 100 + 0.5).cast("long").alias("y_e2"))


@query(f"""with {LIBRARY}, {_MAP}, m as (select book_id, count(*) as t, cast(sum(coalesce(k, 0)) as bigint) as k from theme left join (select theme_id, count(*) as k from subtopic group by 1) using (theme_id) group by 1),
h as (select user_id, count(*) as owned, count(t) as themed, cast(coalesce(sum(t), 0) as bigint) as themes_count, cast(coalesce(sum(k), 0) as bigint) as subtopics_count from (select distinct user_id, book_id from user_book) left join m using (book_id) group by 1)
select user_id, case when themes_count > 0 then themed else owned end as books_count, themes_count, subtopics_count from h""")
def map_user_meta(spark, sf_dir):
    return G.user_meta(user_books(spark, sf_dir), _themes(spark, sf_dir), _subtopics(spark, sf_dir))


@query(f"with {_MAP} select book_id, count(*) as themes, cast(sum(coalesce(k, 0)) as bigint) as subtopics from theme left join (select theme_id, count(*) as k from subtopic group by 1) using (theme_id) group by 1")
def map_meta(spark, sf_dir):
    return G.meta(_themes(spark, sf_dir), _subtopics(spark, sf_dir))


@query(f"with {_RELATED} select least(ba, bb) as a, greatest(ba, bb) as b, cast(floor(sum(floor(w * 1e4 + 0.5)) + 0.5) as bigint) as sum_e4, count(*) as n from edge where w >= 0.25 group by 1, 2")
def book_relations(spark, sf_dir):
    own = _themes(spark, sf_dir).select("theme_id", "book_id")
    edges = G.related_edges(_themes(spark, sf_dir), 0.25, most=1_000_000)
    rows = edges.join(own.select(F.col("theme_id").alias("source"), F.col("book_id").alias("a")), "source").join(own.select(F.col("theme_id").alias("target"), F.col("book_id").alias("b")), "target")
    return G.book_relations(rows).select("a", "b", F.floor(F.col("weight") * F.col("n") * 1e4 + 0.5).cast("long").alias("sum_e4"), "n")


@query(f"with {_MAP} select theme_id from theme where contains(lower(title || ' ' || cast(book_id as varchar)), 'theme 1')")
def map_filter(spark, sf_dir):
    return G.matching(_themes(spark, sf_dir), "THEME 1", "title", "book_id").select("theme_id")


@query(f"with {LIBRARY}, m as (select mention_id, mention.book_id, b.title, importance, coalesce(custom, explanation) as explanation from mention join block b on b.book_id = mention.book_id and b.order_number = block_no left join edit using (mention_id)) select b.book_id, b.order_number, b.title, mention_id, importance, explanation from block b left join m on m.book_id = b.book_id and m.title = b.title")
def export_concepts(spark, sf_dir):
    own = blocks(spark, sf_dir)
    titled = mentions(spark, sf_dir).join(own.select("book_id", F.col("order_number").alias("block_no"), "title"), ["book_id", "block_no"]).drop("block_no", "concept_id")
    return X.concept_rows(own, titled, L.edit_state(edits(spark, sf_dir)).select("mention_id", "custom")).select("book_id", "order_number", "title", "mention_id", "importance", "explanation")


@query(f"with {LIBRARY}, n as (select book_id, block_no as order_number, string_agg(cast(concept_id as varchar), ', ' order by mention_id, cast(concept_id as varchar)) as names from mention group by 1, 2) select book_id, string_agg(cast(order_number as varchar) || '. ' || title || ': ' || names, chr(10) order by order_number) as text from block join n using (book_id, order_number) group by 1")
def export_blocks(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("mention_id", F.col("concept_id").cast("string").alias("c"))))
    names = mentions(spark, sf_dir).groupBy("book_id", F.col("block_no").alias("order_number")).agg(F.array_join(F.transform(listed, lambda x: x["c"]), ", ").alias("names"))
    return X.report(blocks(spark, sf_dir).join(names, ["book_id", "order_number"], "left"))


_TITLED = """m as (select mention.*, b.title as block_title, name from mention join block b on b.book_id = mention.book_id and b.order_number = block_no join concept using (concept_id)),
book as (select book_id, arg_min(title, id) as title, 'Author ' || cast(book_id % 9 as varchar) as authors, case when book_id % 3 = 0 then '' else 'Sum of ' || cast(book_id as varchar) end as summary from user_book group by book_id)"""


def _books(spark, sf_dir):
    rows = user_books(spark, sf_dir).groupBy("book_id").agg(F.min_by("title", "id").alias("title"))
    summary = F.when(F.col("book_id") % 3 == 0, "").otherwise(F.format_string("Sum of %d", "book_id"))
    return rows.withColumns({"authors": F.concat(F.lit("Author "), (F.col("book_id") % 9).cast("string")), "original_filename": F.lit(None).cast("string"), "summary": summary})


def _titled(spark, sf_dir):
    titles = blocks(spark, sf_dir).select("book_id", F.col("order_number").alias("block_no"), "title")
    return mentions(spark, sf_dir).join(titles, ["book_id", "block_no"]).join(concepts(spark, sf_dir), "concept_id")


@query(f"""with {LIBRARY}, {_TITLED}, c as (select book_id, block_title as title, string_agg('{{"name":"' || name || '","explanation":"' || explanation || '"}}', ',' order by importance desc, mention_id, name, explanation) as c from m group by 1, 2),
b as (select book_id, string_agg('{{"order_number":' || cast(order_number as varchar) || ',"title":"' || title || '","concepts":[' || coalesce(c, '') || ']}}', ',' order by order_number) as b from block left join c using (book_id, title) group by 1)
select book_id, '{{"book":{{"id":' || cast(book_id as varchar) || ',"title":"' || title || '","authors":"' || authors || '","original_filename":""}},"summary":"' || summary || '","blocks":[' || coalesce(b, '') || ']}}' as payload from book left join b using (book_id)""")
def export_json_rows(spark, sf_dir):
    return X.nested(blocks(spark, sf_dir), _titled(spark, sf_dir), _books(spark, sf_dir))


@query(f"""with {LIBRARY}, {_TITLED}, b0 as (select *, row_number() over (partition by book_id order by order_number) as i from block),
b as (select book_id, string_agg(cast(i as varchar) || '. ' || title || chr(10) || '   Chapter: -' || chr(10) || '   Short summary: Block of ' || cast(order_number as varchar) || chr(10), chr(10) order by i) as b from b0 group by 1),
c0 as (select *, row_number() over (partition by book_id order by block_no, importance desc, mention_id, name, block_title, explanation) as i from m),
c as (select book_id, string_agg(cast(i as varchar) || '. ' || name || chr(10) || '   Block: ' || block_title || chr(10) || '   Explanation: ' || explanation || chr(10) || '   Quote: ' || chr(10), chr(10) order by i) as c from c0 group by 1)
select book_id, concat_ws(chr(10), 'Book: ' || title, 'Authors: ' || authors, chr(10) || 'Summary:', case when summary = '' then '-' else summary end, chr(10) || 'Logical blocks:', b, 'Concepts:', c) as text from book left join b using (book_id) left join c using (book_id)""")
def export_txt(spark, sf_dir):
    own = blocks(spark, sf_dir).select("book_id", "order_number", "title", F.lit("").alias("chapter_title"), F.format_string("Block of %d", "order_number").alias("short_summary"))
    found = _titled(spark, sf_dir).select("book_id", F.col("block_no").alias("order_number"), "mention_id", F.col("title").alias("block_title"), "name", "importance", "explanation", F.lit(None).cast("string").alias("quote"))
    return X.full_report(_books(spark, sf_dir), own, found)


@query(f"with {LIBRARY} select b.book_id, cast(nb as varchar) as blocks, cast(nm as varchar) as mentions, 'plain' as source from (select book_id, count(*) as nb from block group by 1) b join (select book_id, count(*) as nm from mention group by 1) m using (book_id)")
def analysis_metadata(spark, sf_dir):
    own, found = blocks(spark, sf_dir), mentions(spark, sf_dir)
    base = own.select("book_id").distinct().withColumn("metadata", F.create_map(F.lit("source"), F.lit("plain"), F.lit("blocks_count"), F.lit("0")))
    rows = X.metadata(base, blocks=own, mentions=found)
    return rows.select("book_id", F.col("metadata")["blocks_count"].alias("blocks"), F.col("metadata")["mentions_count"].alias("mentions"), F.col("metadata")["source"].alias("source"))


@query("""select vec_id as k, case when vec_id % 2 = 0 then label + 100 else label end as v from embeddings where vec_id % 10 <> 0""")
def keyed_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").alias("v"))
    new = old.where("k % 2 = 0").select("k", (F.col("v") + 100).alias("v"))
    return X.without(X.upserted(old, new, ["k"]), old.where("k % 10 = 0"), ["k"])


@query(r"""with h as (select page_id, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') as h from pages),
p as (select page_id, h, list_transform(string_split(regexp_replace(h, '<p>', chr(1), 'g'), chr(1))[2:], lambda x: trim(regexp_replace(regexp_replace(string_split(x, '</p>')[1], '<[^>]*>?', ' ', 'g'), '\s+', ' ', 'g'), ' ')) as p from h)
select cast(page_id as varchar) as path, trim(regexp_replace(replace(replace(regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'), ' ') as title, cast(len(list_filter(p, lambda x: x <> '')) as integer) as paragraphs from p""")
def html_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return B.html_books(pages).select("path", "title", F.size(F.col("chapters")[0]["paragraphs"]).alias("paragraphs"))


def _fictionbooks(spark, sf_dir):
    """Documents wrapped as FictionBook files; those of some sources break off."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace(esc, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")
    body = F.array_join(F.transform(F.split(clean, "\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><FictionBook><description><title-info><book-title>'), F.col("source"), F.lit("</book-title></title-info></description><body><section>"), body, F.lit("</section></body>"))
    xml = F.concat(xml, F.when(F.col("source") == "src3", "").otherwise("</FictionBook>"))
    return table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".fb2")).alias("path"), F.encode(xml, "utf-8").alias("content"))


_FB2 = r"""p as (select doc_id, source, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x00-\x1f\x{85}\x{a0}]+', ' ', 'g'), ' ')), lambda x: x <> '')) as n from documents),
f as (select cast(doc_id as varchar) || '.fb2' as path, source, cast(n as integer) as n, source <> 'src3' and n > 0 as good from p)"""


@query(f"with {_FB2} select path, case when good then source end as title, case when good then n end as paragraphs, not good as failed from f")
def fb2_parse(spark, sf_dir):
    rows = B.fb2_books(_fictionbooks(spark, sf_dir))
    return rows.select("path", "title", F.when(F.size("chapters") > 0, F.size(F.col("chapters")[0]["paragraphs"])).alias("paragraphs"), F.col("_error").isNotNull().alias("failed"))


@query(f"with {_FB2} select path, case when good then 'ready' else 'failed' end as status, case when good then n else 0 end as paragraphs from f")
def stream_ingest(spark, sf_dir):
    """The same files arriving as rows of a table: read once each by a stream, with what it left in its folders."""
    files = cut(_fictionbooks(spark, sf_dir))
    out = f"{shared_dir(spark)}/folioscope/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(files.schema).parquet(files._folioscope_path)
    ingest(stream, out, f"{out}/checkpoint").awaitTermination()
    books = spark.read.parquet(f"{out}/books").select("path", F.size(F.col("chapters")[0]["paragraphs"]).alias("n"))
    return spark.read.parquet(f"{out}/status").join(books, "path", "left").select("path", "status", F.coalesce("n", F.lit(0)).alias("paragraphs"))


_PAGE = r"case when doc_id % 3 = 0 then regexp_replace(text, '\s+', chr(10) || chr(10), 'g') else regexp_replace(text, '\. ', '.' || chr(10) || chr(10), 'g') end"
#: The last part of an accumulated text that is still open, with one sentence more.
_GROWN = "trim(string_split(a, chr(2))[-1] || ' ' || s, ' ')"
_PAGES = rf"""t as (select doc_id, {_PAGE} as t from documents),
p0 as (select doc_id, list_filter(list_transform(string_split(regexp_replace(t, '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: length(x) >= 20) as pieces,
  list_filter(string_split(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g'), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as parts from t),
p as (select doc_id, case when len(pieces) > 0 then pieces else list_filter(string_split(list_reduce(list_prepend('', parts), lambda a, s: left(a, length(a) - length(string_split(a, chr(2))[-1])) || {_GROWN} || case when length({_GROWN}) >= 240 then chr(2) else '' end), chr(2)), lambda x: length(x) >= 20) end as p from p0)"""


def _pages(spark, sf_dir):
    """Documents as pages: every third has each word on a line of its own, so that it is put together again from sentences."""
    words, stops = F.regexp_replace("text", r"(?U)\s+", "\n\n"), F.regexp_replace("text", r"\. ", ".\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, words).otherwise(stops).alias("text"))


@query(f"with {_PAGES} select doc_id, cast(len(p) as bigint) as n, array_to_string(p, '|') as paragraphs from p")
def pdf_page_paragraphs(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", T.page_paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("paragraphs"))


@query(f"""with {_PAGES} select cast(p.doc_id as varchar) as path, case when len(p) > 0 then case when d.doc_id % 2 = 0 then 'PDF document' else source end end as title, case when len(p) > 0 then 'Page 2' end as chapter_title,
case when len(p) > 0 then '3' end as pages_total, case when len(p) > 0 then '1' end as pages_with_text, cast(len(p) as integer) as paragraphs, len(p) = 0 as failed from p join documents d on d.doc_id = p.doc_id""")
def pdf_parse(spark, sf_dir):
    """A book of three pages for each document; the first has no text and the last can't be read."""
    title = F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("source"))
    files = _pages(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), title.alias("title"), F.lit(None).cast("string").alias("authors"), F.array(F.lit(" \n "), F.col("text"), F.lit(None)).alias("pages"))
    rows = B.page_books(files)
    first = F.when(F.size("chapters") > 0, F.col("chapters")[0])
    return rows.select(
        "path", "title", first["chapter_title"].alias("chapter_title"), F.col("metadata")["pages_total"].alias("pages_total"), F.col("metadata")["pages_with_text"].alias("pages_with_text"),
        F.coalesce(F.size(first["paragraphs"]), F.lit(0)).alias("paragraphs"), F.col("_error").isNotNull().alias("failed"),
    )


@query(f"""with {LIBRARY}, {_MAP}, bl as (select book_id, string_agg(title, '|' order by order_number) as blocks from block group by 1),
th as (select book_id, string_agg(title || ':' || coalesce(s, ''), '|' order by theme_id) as themes from theme left join (select theme_id, string_agg(name, ',' order by score desc, subtopic_id) as s from subtopic group by 1) using (theme_id) group by 1),
me as (select book_id, string_agg(name || ' ' || cast(mention_id as varchar), '|' order by importance desc, name, mention_id) as mentions from mention join concept using (concept_id) group by 1)
select id, coalesce(v.views, 0) as views, blocks, themes, mentions from user_book left join (select user_id, count(*) as views from events where event_type = 'view' group by 1) v using (user_id) left join bl using (book_id) left join th using (book_id) left join me using (book_id)""")
def book_page(spark, sf_dir):
    """Every book's page: blocks, themes with subtopics, mentions by importance and name, and how often its reader looked."""
    views = L.view_counts(table(spark, sf_dir, "events")).select("user_id", "views")
    books = user_books(spark, sf_dir).join(views, "user_id", "left").select("id", "book_id", F.coalesce("views", F.lit(0)).alias("views"))
    rows = L.book_page(books, blocks(spark, sf_dir), _themes(spark, sf_dir), _subtopics(spark, sf_dir), mentions(spark, sf_dir), concepts(spark, sf_dir))

    def joined(c, one):
        return F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, one), "|")).alias(c)

    return rows.select("id", "views", joined("blocks", lambda x: x["title"]), joined("themes", lambda x: F.concat(x["title"], F.lit(":"), F.array_join(x["subtopics"], ","))), joined("mentions", lambda x: F.concat(x["name"], F.lit(" "), x["mention_id"].cast("string"))))


@query(f"with {LIBRARY} select user_id, concept_id, name, count(distinct mention_id) as mentions, array_to_string(list_sort(list(distinct title)), ', ') as titles from mention join user_book using (book_id) join concept using (concept_id) where contains(upper(name), 'RED RING') or contains(upper(normalized_name), 'RED RING') group by 1, 2, 3")
def concepts_by_name(spark, sf_dir):
    return L.concepts_by_name(mentions(spark, sf_dir), concepts(spark, sf_dir), user_books(spark, sf_dir), "Red Ring")


@query(f"with {LIBRARY}, l as (select user_id, book_id, arg_max(id, (uploaded_at, id)) as user_book_id from user_book group by 1, 2) select user_id, mention_id, name, importance, coalesce(custom, explanation) as effective, b.title as block_title, user_book_id from mention join concept using (concept_id) join user_book using (book_id) left join (select * from edit where 1 = 1) e using (mention_id) left join block b on b.book_id = mention.book_id and order_number = block_no join l using (user_id, book_id) where concept_id = 11 and user_id = (select min(user_id) from mention join user_book using (book_id) where concept_id = 11)")
def concept_page(spark, sf_dir):
    """The page of one concept for the first user who has it."""
    found, books = mentions(spark, sf_dir), user_books(spark, sf_dir)
    first = L.visible(found.where("concept_id = 11"), books).agg(F.min("user_id").alias("user_id"))
    mine = books.join(F.broadcast(first), "user_id", "left_semi").withColumn("user_id", F.lit(1).cast("long"))
    rows = L.concept_page(found, concepts(spark, sf_dir), mine, blocks(spark, sf_dir), edits(spark, sf_dir).transform(L.edit_state), 11, 1)
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one").select("user_id", "mention_id", "name", "importance", "effective", "block_title", "user_book_id")


@query(f"with {LIBRARY} select concept_id, mention_id, name, b.title as block_title, cast(row_number() over (partition by concept_id order by importance desc, mention_id) as integer) as place from mention join concept using (concept_id) join block b on b.book_id = mention.book_id and order_number = block_no")
def concept_context(spark, sf_dir):
    return L.concept_context(mentions(spark, sf_dir), concepts(spark, sf_dir), blocks(spark, sf_dir)).select("concept_id", "mention_id", "name", "block_title", "place")


_COMPARED = "'1. Common points: concept ' || chr(39) || name || chr(39) || ' appears in multiple user sources.' || chr(10) || '2. Differences: emphasis changes by context of each source.' || chr(10) || '3. Where simpler: shorter and more applied explanations.' || chr(10) || '4. Where deeper: longer blocks with expanded reasoning.' || chr(10) || '5. Final takeaway: comparison built from books ' || titles || '.'"


@query(f"with {LIBRARY}, t as (select user_id, concept_id, name, array_to_string(list_sort(list(distinct title)), ', ') as titles from mention join user_book using (book_id) join concept using (concept_id) group by 1, 2, 3 having count(distinct mention_id) >= 2) select user_id, concept_id, {_COMPARED} as reply from t")
def compare_replies(spark, sf_dir):
    rows = L.compared_titles(mentions(spark, sf_dir), user_books(spark, sf_dir), 2).join(concepts(spark, sf_dir), "concept_id")
    return rows.select("user_id", "concept_id", T.compare_reply(F.col("name"), F.col("titles")).alias("reply"))


def _owned(spark, sf_dir):
    """Documents as books of seven users."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), (F.col("doc_id") % 7).alias("user_id"))


_ASKED = "is the of that and in a tion"


@query(f"""with recursive {BLOCKS}, txt as (select book * 100000 + order_number as doc_id, book, order_number, case when short_summary <> '' then short_summary else left(source_text, 3000) end as text from block where book % 7 = 3),
both_ as (select doc_id, text from txt union all select -1, '{_ASKED}'), {SLOTS.format('both_')}, norm as (select doc_id, sqrt(sum(v * v)) as n from slot group by 1),
dot as (select a.doc_id, sum(a.v * b.v) as d from slot a join slot b on b.doc_id = -1 and a.slot = b.slot where a.doc_id >= 0 group by 1),
sc as (select book, order_number, coalesce(d / (n.n * q.n), 0.0) as s from txt left join dot using (doc_id) left join norm n using (doc_id) join norm q on q.doc_id = -1)
select book as book_id, order_number, cast(floor(s * 1e6 + 0.5) as bigint) as score_e6 from sc order by s desc, book, order_number limit 5""")
def similar_blocks(spark, sf_dir):
    rows = word_blocks(spark, sf_dir).withColumnRenamed("book", "book_id")
    return L.similar_blocks(rows, _owned(spark, sf_dir), _ASKED, 3).select("book_id", "order_number", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


@query(f"""with {LIBRARY}, own as (select distinct concept_id from mention where book_id in (select book_id from user_book where user_id = 7)),
txt as (select p_partkey as doc_id, p_name || '. ' || p_type as text from part where p_partkey in (select concept_id from own)), both_ as (select * from txt union all select -1, 'red ring'), {SLOTS.format('both_')}, norm as (select doc_id, sqrt(sum(v * v)) as n from slot group by 1),
dot as (select a.doc_id, sum(a.v * b.v) as d from slot a join slot b on b.doc_id = -1 and a.slot = b.slot where a.doc_id >= 0 group by 1),
sc as (select txt.doc_id as concept_id, cast(floor(coalesce(d / (n.n * q.n), 0.0) * 1e6 + 0.5) as bigint) as score_e6 from txt left join dot using (doc_id) left join norm n using (doc_id) join norm q on q.doc_id = -1)
select concept_id, score_e6 from sc order by score_e6 desc, concept_id limit 10""")
def similar_concepts(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    rows = L.similar_concepts(named, mentions(spark, sf_dir), user_books(spark, sf_dir), "red ring", 7)
    return rows.select("concept_id", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


@query(f"with {LIBRARY}, r as (select user_id, id, title, row_number() over (partition by user_id order by uploaded_at desc, id desc) as k from user_book where contains(upper(title), 'BOOK 4')) select user_id, id, title from r where k = 1")
def bot_find_book(spark, sf_dir):
    return L.find_book(user_books(spark, sf_dir), "book 4").select("user_id", "id", "title")


@query(f"with {LIBRARY}, f as (select concept_id from concept where contains(upper(name), 'RED RING') order by concept_id limit 1), r as (select user_id, mention_id, importance, cast(row_number() over (partition by user_id order by importance desc, mention_id) as integer) as rank from mention join user_book using (book_id) where concept_id in (select concept_id from f)) select user_id, mention_id, rank from r where rank <= 10")
def bot_concept_cards(spark, sf_dir):
    return L.concept_cards(mentions(spark, sf_dir), concepts(spark, sf_dir), user_books(spark, sf_dir), "red ring").select("user_id", "mention_id", "rank")


@query(f"with {LIBRARY}, r as (select user_id, concept_id, name, cast(row_number() over (partition by user_id order by concept_id) as integer) as rank from (select distinct user_id, concept_id, name from mention join user_book using (book_id) join concept using (concept_id) where contains(upper(name), 'RED'))) select user_id, concept_id, name, rank from r where rank <= 20")
def bot_found_concepts(spark, sf_dir):
    return L.found_concepts(mentions(spark, sf_dir), concepts(spark, sf_dir), user_books(spark, sf_dir), "red").select("user_id", "concept_id", "name", "rank")


@query(f"""with {LIBRARY}, late as (select id from user_book where status = 'P')
select id, case when status = 'P' then not is_protected else is_protected end as is_protected, case when status = 'P' then 'processing' else status end as status from user_book where is_protected or status <> 'O'""")
def book_actions(spark, sf_dir):
    """Pending books are turned round and analysed again, open ones deleted unless they are protected."""
    books = user_books(spark, sf_dir)
    left = L.deleted(books, books.where("status = 'O'"))
    return L.toggled(L.reanalysed(left, books.where("status = 'P'")), books.where("status = 'P'")).select("id", "is_protected", "status")


@query("""with l as (select user_id as book, ts, event_id, case when event_type = 'error' then 'event ' || cast(event_id as varchar) end as error from events), r as (select *, row_number() over (partition by book order by ts desc) as k from l)
select book, case when error is null then 'ready' else 'failed' end as status, coalesce(error, '') as error_message from r where k = 1""")
def latest_status(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), "ts", F.when(F.col("event_type") == "error", F.format_string("event %d", "event_id")).alias("error"))
    return L.latest_status(log)


@query("""select 'block:' || cast(vec_id as varchar) as embedding_id, cast(floor(list_sum(cast(embedding as double[])) * case when vec_id % 3 = 0 then -1e4 else 1e4 end + 0.5) as bigint) as sum_e4 from embeddings where label <> 1""")
def keyed_vectors(spark, sf_dir):
    """Vectors of blocks: every third is written anew with its sign turned, those of one label are deleted."""
    rows = table(spark, sf_dir, "embeddings").withColumn("block_id", F.col("vec_id"))
    old = X.block_vectors(rows, F.col("embedding"))
    new = X.block_vectors(rows.where("vec_id % 3 = 0"), F.transform("embedding", lambda x: -x))
    gone = rows.where("label = 1").select(F.format_string("block:%d", "vec_id").alias("embedding_id")).unionByName(rows.select(F.when(F.col("label") == 2, "").alias("embedding_id")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return X.upserted_vectors(old, new, gone).select("embedding_id", F.floor(total * 1e4 + 0.5).cast("long").alias("sum_e4"))
