"""Queries on texts: scalar functions, JSON, embeddings, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import jsonx as J
from folioscope.functions import text as T
from folioscope.functions import vectors as V
from folioscope.operators import segment as S
from folioscope.plans.registry import query
from folioscope.plans.views import BLOCKS, CHUNKS, LEAST, MOST, PARAGRAPHS, TARGET, WORD, lines, table

_SENTENCES = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_SPACES = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"select doc_id, cast(len(regexp_extract_all(text, '{WORD}')) as bigint) as n_words from documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(r"""select doc_id, case when cyr > 0 and cyr >= lat then 'ru' when lat > 0 then 'en' else 'auto' end as hint
from (select doc_id, len(regexp_extract_all(text, '[А-Яа-яЁё]')) as cyr, len(regexp_extract_all(text, '[A-Za-z]')) as lat from documents)""")
def lang_hint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.language_hint(F.col("text")).alias("hint"))


@query(f"select doc_id, {_SPACES.format('text')} as text from documents")
def ws_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normal_spaces(F.col("text")).alias("text"))


@query(f"select doc_id, cast(len({_SENTENCES.format('text')}) as bigint) as n, {_SENTENCES.format('text')}[1] as first from documents")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), s[0].alias("first"))


PICK = r"""coalesce(nullif(trim(array_to_string(list_slice(case when len(whole) > 0 then whole else pieces end, 1, {1}), ' '), ' '), ''), trim(left({0}, 500), ' '))"""
PICKED = (
    "list_filter(list_transform(" + _SENTENCES + ", lambda s: trim(s, ' ')), lambda s: length(s) >= 35) as whole, "
    "list_filter(list_transform(string_split(regexp_replace({0}, '[.!?]+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) >= 35) as pieces"
)


@query(f"select doc_id, {PICK.format('text', 3)} as summary from (select doc_id, text, {PICKED.format('text')} from documents)")
def fallback_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fallback_sentences(F.col("text")).alias("summary"))


@query(f"""select doc_id, left(case when length(head) < 20 then t else head end, 220) as quote
from (select doc_id, t, {_SENTENCES.format('t')}[1] as head from (select doc_id, {_SPACES.format('text')} as t from documents))""")
def first_quote(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.first_quote(F.col("text")).alias("quote"))


@query("select doc_id, case when length(t) > 600 then left(t, 380) || chr(10) || '...' || chr(10) || right(t, 180) else t end as prompt from (select doc_id, trim(text, ' ') as t from documents)")
def head_tail_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.head_and_tail(F.col("text"), 600).alias("prompt"))


@query(f"select page_id, {_SPACES.format(chr(34) + 'h' + chr(34))} as text from (select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as h from pages)")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(r"""select doc_id, case when length(v) = 0 then false when regexp_matches(v, '[\x{4E00}-\x{9FFF}]') then false
when doc_id % 2 = 0 then regexp_matches(v, '[А-Яа-яЁёA-Za-z]') or regexp_matches(v, '^[A-Z0-9-]{2,8}$') else true end as fits from (select doc_id, trim(text, ' ') as v from documents)""")
def lang_compat(spark, sf_dir):
    hint = F.when(F.col("doc_id") % 2 == 0, "ru").otherwise("en")
    return _docs(spark, sf_dir).select("doc_id", T.language_fits(F.col("text"), hint).alias("fits"))


_NAME = f"array_to_string(list_filter(list_transform(regexp_extract_all({{0}}, '{WORD}'), lambda w: lower(w)), lambda w: not regexp_full_match(w, '[0-9]+')), ' ')"


@query(f"select doc_id, {_NAME.format('text')} as name from documents")
def concept_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.concept_name(F.col("text")).alias("name"))


@query(f"""select conv_id, turn, n = '' or length(n) < 2 or len(string_split(n, ' ')) > 7 or (len(string_split(n, ' ')) = 1 and n in ('текст','книга','глава','раздел','пример','задача','тема','автор')) or regexp_full_match(n, '[0-9]+') as bad
from (select conv_id, turn, {_NAME.format('text')} as n from conversations)""")
def bad_concept(spark, sf_dir):
    """Turns of conversations as names: some are a few words long."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.bad_concept(F.col("text")).alias("bad"))


@query(f"""select page_id, array_to_string(list_slice(regexp_extract_all({_SPACES.format('h')}, '{WORD}'), 1, 4), ' ') as term from (select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as h from pages)""")
def clean_term(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_term(F.col("html")).alias("term"))


_TOKENS = (
    f"list_distinct(list_filter(list_transform(regexp_extract_all({{0}}, '{WORD}'), lambda w: lower(w)), "
    "lambda w: length(w) >= 3 and not regexp_full_match(w, '[0-9]+') and not list_contains(['книга','автор','текст','пример','задача','глава','раздел','данный','этот','тема'], w)))"
)


@query(f"select doc_id, cast(len({_TOKENS.format('text')}) as bigint) as n, array_to_string(list_sort({_TOKENS.format('text')}), ' ') as tokens from documents")
def content_tokens(spark, sf_dir):
    t = T.content_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query(f"""with t as (select doc_id, {_TOKENS.format('text')} as a from documents)
select t.doc_id, case when len(t.a) > 0 and len(u.a) > 0 then cast(floor(len(list_intersect(t.a, u.a)) * 10000 / len(t.a)) as bigint) else 0 end as overlap_e4 from t join t u on u.doc_id = t.doc_id + 1""")
def grounding_overlap(spark, sf_dir):
    """Each document as a summary of the one after it."""
    rows = _docs(spark, sf_dir).select("doc_id", T.content_tokens(F.col("text")).alias("a"))
    rows = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    score = F.when((F.size("a") > 0) & (F.size("b") > 0), F.floor(F.size(F.array_intersect("a", "b")).cast("long") * 10000 / F.size("a"))).otherwise(0)
    return rows.select("doc_id", score.cast("long").alias("overlap_e4"))


@query("""with s as (select doc_id, case doc_id % 4 when 0 then 'This section discusses ' || text when 1 then 'This chapter discusses and this block discusses ' || text when 2 then 'Main meaning: ' || text else text end as v from documents),
hit as (select doc_id, v, cast(contains(lower(v), 'this section discusses') as integer) + cast(contains(lower(v), 'this chapter discusses') as integer) + cast(contains(lower(v), 'this block discusses') as integer) + cast(contains(lower(v), 'the main idea is') as integer) + cast(contains(lower(v), 'this material describes') as integer) as en from s)
select doc_id, contains(lower(v), 'main meaning') or en >= 2 or (length(v) < 65 and en >= 1) as generic from hit""")
def generic_summary(spark, sf_dir):
    k = F.col("doc_id") % 4
    v = F.when(k == 0, F.concat(F.lit("This section discusses "), F.col("text"))).when(k == 1, F.concat(F.lit("This chapter discusses and this block discusses "), F.col("text")))
    v = v.when(k == 2, F.concat(F.lit("Main meaning: "), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.generic_summary(v).alias("generic"))


@query("select doc_id, sha256(text) as file_hash from documents")
def doc_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("select sha256(text) as file_hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def duplicate_books(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("select event_id, cast(props ->> '$.k' as bigint) as k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(J.lenient_json(F.col("props")), "$.k", "bigint").alias("k"))


_FENCE = chr(96) * 3


@query("""select event_id, case when event_id % 5 = 3 then null else cast(props ->> '$.k' as bigint) end as k from events""")
def lenient_json(spark, sf_dir):
    """Props as a model would return them: plain, fenced, in prose, broken, with a tail."""
    k, p = F.col("event_id") % 5, F.col("props")
    reply = F.when(k == 0, p).when(k == 1, F.concat(F.lit(f"{_FENCE}json\n"), p, F.lit(f"\n{_FENCE}"))).when(k == 2, F.concat(F.lit("Here it is: "), p, F.lit(" Done.")))
    reply = reply.when(k == 3, F.left(p, F.length(p) - 1)).otherwise(F.concat(p, F.lit(" and no more")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(J.lenient_json(reply), "$.k", "bigint").alias("k"))


@query("""select event_id, cast(case event_id % 3 when 2 then 0 else 2 end as bigint) as n from events""")
def json_key_items(spark, sf_dir):
    k, p = F.col("event_id") % 3, F.col("props")
    pair = F.concat(F.lit("["), p, F.lit(", 5, "), p, F.lit("]"))
    reply = F.when(k == 0, F.concat(F.lit('{"items": '), pair, F.lit("}"))).when(k == 1, pair).otherwise(F.lit('{"other": [{}]}'))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.size(J.items(J.lenient_json(reply))), F.lit(0)).cast("long").alias("n"))


@query("""select event_id, 2 as n, props as first from events""")
def json_salvage(spark, sf_dir):
    reply = F.concat(F.lit('{"concepts": ['), F.col("props"), F.lit(", "), F.col("props"), F.lit(', {"name": "bro'))
    return table(spark, sf_dir, "events").select("event_id", J.salvaged(reply).alias("objects")).select("event_id", F.size("objects").alias("n"), F.col("objects")[0].alias("first"))


@query("""select o_orderkey, array_to_string(list_sort(list_distinct(list_append(list_filter(list(cast(l_quantity as integer)), lambda v: v between 1 and 20), 20))), ',') as boundaries from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def boundary_clean(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_quantity").cast("int").cast("string")).alias("v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return raw.join(orders, "o_orderkey").select("o_orderkey", F.array_join(J.clean_boundaries(F.col("v"), F.lit(20)), ",").alias("boundaries"))


SLOTS = f"""
word as (select doc_id, w, count(*) as c from (select doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as w from {{0}}) group by doc_id, w),
code as (select w, sha256(w) as h from (select distinct w from word)),
byte as (select w, i, cast(('0x' || substr(h, cast(2 * i + 1 as integer), 2)) as bigint) as b from code, unnest(range(16)) as u(i)),
slot as (select doc_id, (11 * i + b) % 128 as slot, cast(sum(c * b) as bigint) as v from word join byte using (w) group by 1, 2)"""


@query(f"""with {SLOTS.format('documents')}
select doc_id, cast(slot as bigint) as slot, cast(floor(v / sqrt(sum(v * v) over (partition by doc_id)) * 1e6 + 0.5) as bigint) as v_e6 from slot where v > 0""")
def hash_embedding(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(V.hash_embedding("text")).alias("slot", "v"))
    return rows.where("v > 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.floor(F.col("v") * 1e6 + 0.5).cast("long").alias("v_e6"))


@query("""select a.vec_id as a, b.vec_id as b, cast(floor(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) * 1e6 + 0.5) as bigint) as cos_e6 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("vb"))
    return a.join(b, "a").select("a", "b", F.floor(V.cosine(F.col("va"), F.col("vb")) * 1e6 + 0.5).cast("long").alias("cos_e6"))


@query(f"with {PARAGRAPHS} select book, chapter, number, idx, words, text from para")
def paragraphs(spark, sf_dir):
    return S.kept_paragraphs(lines(spark, sf_dir)).select("book", "chapter", "number", "idx", "words", "text")


_SCORES = (
    PARAGRAPHS
    + f""",
pw as (select book, number, w, count(*) as c from (select book, number, unnest(regexp_extract_all(lower(left(text, 2200)), '{WORD}')) as w from para) group by 1, 2, 3),
code as (select w, sha256(w) as h from (select distinct w from pw)),
byte as (select w, i, cast(('0x' || substr(h, cast(2 * i + 1 as integer), 2)) as bigint) as b from code, unnest(range(16)) as u(i)),
slot as (select book, number, (11 * i + b) % 128 as slot, cast(sum(c * b) as bigint) as v from pw join byte using (w) group by 1, 2, 3),
norm as (select book, number, sqrt(sum(v * v)) as n from slot group by 1, 2),
dots as (select a.book, b.number, sum(a.v * b.v) as d from slot a join slot b on a.book = b.book and b.number = a.number + 1 and a.slot = b.slot group by 1, 2),
scored as (select p.*, case when idx > 1 then (1.0 - coalesce(d / (n1.n * n0.n), 0)) * 0.8 + case when regexp_matches(text, '^\\s*(?:\\d+[.)]\\s+)?[А-ЯA-Z][^.!?]{{2,120}}$') then 0.5 else 0.0 end + case when length(text) < 80 then 0.05 else 0.0 end end as score
  from para p left join dots using (book, number) left join norm n1 using (book, number) left join norm n0 on n0.book = p.book and n0.number = p.number - 1)"""
)


@query(f"with {_SCORES} select book, number, cast(floor(score * 1e6 + 0.5) as bigint) as score_e6 from scored where idx > 1")
def boundary_score(spark, sf_dir):
    rows = S.boundary_scores(S.kept_paragraphs(lines(spark, sf_dir))).where("idx > 1")
    return rows.select("book", "number", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


@query(f"with recursive {CHUNKS} select book, chapter, idx, raw from fold")
def greedy_boundaries(spark, sf_dir):
    chaptered = S.chapters(S.kept_paragraphs(lines(spark, sf_dir)))
    return S.numbered(chaptered, S.greedy_words(F.col("items"), TARGET)).select("book", "chapter", "idx", F.col("chunk").alias("raw"))


@query(f"with recursive {CHUNKS} select book, chapter, idx, chunk from chunk")
def boundary_merge(spark, sf_dir):
    chaptered = S.chapters(S.kept_paragraphs(lines(spark, sf_dir)))
    return S.merged_small(S.numbered(chaptered, S.greedy_words(F.col("items"), TARGET)), max(40, LEAST // 2)).select("book", "chapter", "idx", "chunk")


_GREEDY = (
    _SCORES
    + f""",
gfold as (select book, chapter, idx, words, words as acc, 0 as raw from scored where idx = 1 union all
  select s.book, s.chapter, s.idx, s.words, case when cut then s.words else acc + s.words end, raw + case when cut then 1 else 0 end
  from (select f.book, f.chapter, p.idx, p.words, f.acc, f.raw, (f.acc >= {LEAST} and p.score >= 0.34) or (f.acc >= {TARGET} and p.score >= 0.25) or f.acc + p.words > {MOST} as cut
        from gfold f join scored p on p.book = f.book and p.chapter = f.chapter and p.idx = f.idx + 1) s),
gsized as (select *, sum(words) over (partition by book, chapter, raw) as cw, row_number() over (partition by book, chapter, raw order by idx) as k from gfold),
gchunk as (select book, chapter, idx, words, cast(sum(case when k = 1 and (raw = 0 or cw >= {max(80, LEAST // 2)}) then 1 else 0 end) over (partition by book, chapter order by idx) - 1 as integer) as chunk from gsized)"""
)


@query(f"with recursive {_GREEDY} select book, chapter, idx, raw from gfold")
def greedy_blocks(spark, sf_dir):
    chaptered = S.chapters(S.boundary_scores(S.kept_paragraphs(lines(spark, sf_dir))), "score")
    return S.numbered(chaptered, S.greedy_scores(F.col("items"), LEAST, TARGET, MOST)).select("book", "chapter", "idx", F.col("chunk").alias("raw"))


@query(f"with recursive {_GREEDY} select book, chapter, idx, chunk from gchunk")
def merge_small_chunks(spark, sf_dir):
    chaptered = S.chapters(S.boundary_scores(S.kept_paragraphs(lines(spark, sf_dir))), "score")
    return S.merged_small(S.numbered(chaptered, S.greedy_scores(F.col("items"), LEAST, TARGET, MOST)), max(80, LEAST // 2)).select("book", "chapter", "idx", "chunk")


@query(f"""with recursive {CHUNKS}, size as (select book, chapter, chunk, sum(words) as w from chunk group by 1, 2, 3)
select book, chapter, count(*) filter (w > {int(MOST * 1.4)}) = 0 and count(*) filter (w < {max(35, int(LEAST * 0.4))}) <= greatest(1, count(*) // 2) as valid from size group by 1, 2""")
def chunks_valid(spark, sf_dir):
    chaptered = S.chapters(S.kept_paragraphs(lines(spark, sf_dir)))
    merged = S.merged_small(S.numbered(chaptered, S.greedy_words(F.col("items"), TARGET)), max(40, LEAST // 2))
    return S.valid_chapters(merged, LEAST, MOST)


#: The whole rule: word counts for the first eight chapters of 6 to 80 paragraphs, wide chunks cut again by scores; scores for the rest.
_LOGICAL = (
    _GREEDY
    + CHUNKS[len(PARAGRAPHS) :]
    + f""",
picked as (select book, chapter from (select book, chapter, row_number() over (partition by book order by chapter) as k from (select book, chapter, count(*) as n from para group by 1, 2) where n between 6 and 80) where k <= 8),
wide as (select c.*, sum(words) over (partition by book, chapter, chunk) as cw, row_number() over (partition by book, chapter, chunk order by idx) as li from chunk c join picked using (book, chapter)),
again as (select w.book, w.chapter, w.chunk, w.li, w.idx, w.words, s.score from wide w join scored s using (book, chapter, idx) where w.cw > {MOST}),
afold as (select book, chapter, chunk, li, idx, words, words as acc, 0 as raw from again where li = 1 union all
  select s.book, s.chapter, s.chunk, s.li, s.idx, s.words, case when cut then s.words else acc + s.words end, raw + case when cut then 1 else 0 end
  from (select p.*, f.acc, f.raw, (f.acc >= {LEAST} and p.score >= 0.34) or (f.acc >= {TARGET} and p.score >= 0.25) or f.acc + p.words > {MOST} as cut
        from afold f join again p on p.book = f.book and p.chapter = f.chapter and p.chunk = f.chunk and p.li = f.li + 1) s),
asized as (select *, sum(words) over (partition by book, chapter, chunk, raw) as sw, row_number() over (partition by book, chapter, chunk, raw order by idx) as k from afold),
asub as (select book, chapter, idx, words, chunk, sum(case when k = 1 and (raw = 0 or sw >= {max(80, LEAST // 2)}) then 1 else 0 end) over (partition by book, chapter, chunk order by idx) - 1 as sub from asized),
dense as (select *, dense_rank() over (partition by book, chapter order by chunk, sub) - 1 as raw from (select book, chapter, idx, words, chunk, 0 as sub from wide where cw <= {MOST} union all select book, chapter, idx, words, chunk, sub from asub)),
dsized as (select *, sum(words) over (partition by book, chapter, raw) as sw, row_number() over (partition by book, chapter, raw order by idx) as k from dense),
bywords as (select book, chapter, idx, words, sum(case when k = 1 and (raw = 0 or sw >= {max(40, LEAST // 2)}) then 1 else 0 end) over (partition by book, chapter order by idx) - 1 as chunk from dsized),
good as (select book, chapter from (select book, chapter, chunk, sum(words) as w from bywords group by 1, 2, 3) group by 1, 2 having count(*) filter (w > {int(MOST * 1.4)}) = 0 and count(*) filter (w < {max(35, int(LEAST * 0.4))}) <= greatest(1, count(*) // 2)),
lchunk as (select book, chapter, idx, chunk from bywords semi join good using (book, chapter) union all select book, chapter, idx, chunk from gchunk anti join good using (book, chapter)),
lblock as (select book, chapter, chunk, any_value(chapter_title) as chapter_title, min(number) as start_paragraph, max(number) as end_paragraph, string_agg(text, chr(10) || chr(10) order by number) as source_text
  from para join lchunk using (book, chapter, idx) group by book, chapter, chunk)"""
)


@query(f"""with recursive {_LOGICAL} select book, cast(row_number() over (partition by book order by start_paragraph) as integer) as order_number,
case when count(*) over (partition by book, chapter) > 1 then chapter_title || ' — блок ' || cast(row_number() over (partition by book, chapter order by chunk) as varchar) else chapter_title end as title,
chapter, chapter_title, start_paragraph, end_paragraph, source_text, cast(len(regexp_extract_all(source_text, '{WORD}')) as bigint) as token_count from lblock""")
def logical_blocks(spark, sf_dir):
    return S.logical_blocks(lines(spark, sf_dir), LEAST, TARGET, MOST)


@query(f"""with {PARAGRAPHS}, cuts as (select book, chapter, list_sort(list_distinct(list_append(list_filter([3, 7, max(idx) // 2, max(idx) + 4], lambda e: e between 1 and max(idx)), max(idx)))) as ends from para group by 1, 2)
select book, chapter, idx, cast(len(list_filter(ends, lambda e: e < idx)) as integer) as chunk from para join cuts using (book, chapter)""")
def chunks_at_boundaries(spark, sf_dir):
    """Chapters cut after the third and seventh paragraph and the middle; the names of places that there aren't are left out."""
    paragraphs = S.kept_paragraphs(lines(spark, sf_dir))
    n = F.max("idx").alias("n")
    cuts = paragraphs.groupBy("book", "chapter").agg(n).select("book", "chapter", F.array(F.lit("7"), F.lit("3"), F.floor(F.col("n") / 2).cast("string"), (F.col("n") + 4).cast("string"), F.lit("x")).alias("after"))
    return S.split_at(paragraphs, cuts).select("book", "chapter", "idx", "chunk")


@query(f"""with {PARAGRAPHS}, t as (select book, chapter, cast(sum(words) as bigint) as total from para group by 1, 2)
select book, chapter, total, cast(greatest(greatest(1, ceil(total / {MOST}.0)), least(greatest(1, ceil(total / {LEAST}.0)), greatest(1, round_even(total / {TARGET}.0, 0)))) as bigint) as desired from t""")
def prompt_targets(spark, sf_dir):
    totals = S.kept_paragraphs(lines(spark, sf_dir)).groupBy("book", "chapter").agg(F.sum("words").alias("total"))
    return totals.withColumn("desired", T.prompt_targets(F.col("total"), LEAST, TARGET, MOST))


def word_blocks(spark, sf_dir):
    """Blocks by word counts alone, with summaries."""
    paragraphs = S.kept_paragraphs(lines(spark, sf_dir))
    chunks = S.merged_small(S.numbered(S.chapters(paragraphs), S.greedy_words(F.col("items"), TARGET)), max(40, LEAST // 2))
    return S.blocks(paragraphs, chunks).withColumn("short_summary", T.fallback_sentences(F.col("source_text")))


@query(f"with recursive {BLOCKS} select book, order_number, title, chapter_title, start_paragraph, end_paragraph, token_count, short_summary from block")
def block_summaries(spark, sf_dir):
    return word_blocks(spark, sf_dir).select("book", "order_number", "title", "chapter_title", "start_paragraph", "end_paragraph", "token_count", "short_summary")


@query(f"""with recursive {BLOCKS} select book, count(*) as n_blocks, cast(sum(token_count) as bigint) as n_words,
'1. General theme: source material explains key ideas from the original text.' || chr(10) || '2. Key ideas: ' || string_agg(short_summary, '; ' order by order_number) filter (order_number <= 3) || chr(10) || '3. Learning outcome: reader understands the core concepts and links between them.' as summary from block group by book""")
def book_summary(spark, sf_dir):
    from folioscope.operators.themes import book_summary as summary

    rows = word_blocks(spark, sf_dir)
    sizes = rows.groupBy("book").agg(F.count("*").alias("n_blocks"), F.sum("token_count").alias("n_words"))
    return sizes.join(summary(rows), "book")


@query(r"""select event_id, event_type in ('view', 'click') as yes, cast(floor(greatest(0.0, least(1.0, value / 100)) * 1e6) as bigint) as score_e6 from events""")
def scalar_defaults(spark, sf_dir):
    yes = T.truthy(F.when(F.col("event_type").isin("view", "click"), F.lit(" Yes ")).otherwise(F.lit("off")))
    return table(spark, sf_dir, "events").select("event_id", yes.alias("yes"), F.floor(T.unit_score((F.col("value") / 100).cast("string"), 0.5) * 1e6).cast("long").alias("score_e6"))


@query("""with r as (select event_id, 1 + event_id % 9 as n, cast(trunc(value) as integer) % 12 - 1 as a, event_id % 13 as b from events),
f as (select *, least(greatest(a, 1), n) as first from r),
t as (select event_id, 0 as src, first as start, case when event_id % 4 = 1 then first else greatest(first, least(b, n)) end as "end", case when event_id % 5 = 2 then '' else 'A title' end as title,
  case when event_id % 6 = 0 then 0 when event_id % 6 = 1 then 60 else 100 end as importance_e2 from f union all select event_id, 1, 1, 1, '', 60 from r)
select event_id, cast(row_number() over (partition by event_id order by start, "end", src) as integer) as place, cast(start as integer) as start, cast("end" as integer) as "end", title, cast(importance_e2 as bigint) as importance_e2 from t""")
def reply_themes(spark, sf_dir):
    """Replies with two themes, numbers as numbers or text, some fields missing, and something that is no theme."""
    e = table(spark, sf_dir, "events")
    a, b = F.col("value").cast("int") % 12 - 1, F.col("event_id") % 13
    end = F.when(F.col("event_id") % 4 == 1, F.lit("")).otherwise(F.format_string(', "end_block": "%d"', b))
    title = F.when(F.col("event_id") % 5 == 2, F.lit("")).otherwise(F.lit(', "title": " A   title "'))
    sub = F.format_string('[{"name": "N", "importance_score": %s}, 4]', F.when(F.col("event_id") % 6 == 0, "-3").when(F.col("event_id") % 6 == 1, '"x"').otherwise("7"))
    theme = F.concat(F.format_string('{"start_block": %d', a), end, title, F.lit(', "subthemes": '), sub, F.lit("}"))
    listed = F.concat(F.lit("["), theme, F.lit(', "none", {"start_block": "1", "subthemes": [{}]}]'))
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"themes": '), listed, F.lit("}"))).otherwise(listed)
    rows = e.select("event_id", F.posexplode(J.reply_themes(J.lenient_json(reply), 1 + F.col("event_id") % 9)).alias("k", "x"))
    score = F.floor(F.col("x.subthemes")[0]["importance"] * 100 + 0.5).cast("long")
    return rows.select("event_id", (F.col("k") + 1).alias("place"), "x.start", "x.end", "x.title", score.alias("importance_e2"))
