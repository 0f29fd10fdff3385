"""Concepts of blocks: by noun frequency, from model replies, by definition; their resolution and mentions."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.vectors import cosine, hash_embedding
from folioscope.tables import components, cut

# Fixed values.
EXPLANATION = "Concept is grounded in this logical block and explained by the source fragment."
DEFINITIONS = [
    (r"(?iu)^([^.!?]{1,120}?)\s*[—-]\s*это\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+это\s+так(?:ой|ая|ое)\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+это\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+называется\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+называют\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+представляет собой\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+представляют собой\s+(.+)$", 1),
    (r"(?iu)^под\s+([^.!?]{1,120}?)\s+понимается\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+понимается как\s+(.+)$", 1),
    (r"(?iu)^([^.!?]{1,120}?)\s+является\s+(.+)$", 1),
]


def tagged(words: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Adds lemma and noun to rows with `word`, from lexicon(word, lemma, pos) or by plain rules without one."""
    if lexicon is None:
        return words.withColumn("lemma", F.col("word")).withColumn("noun", T.plain_noun(F.col("word")))
    known = lexicon.groupBy("word").agg(F.min(F.struct("lemma", "pos")).alias("x")).select("word", "x.lemma", "x.pos")
    return words.join(known, "word", "left").withColumn("noun", F.coalesce(F.col("pos") == "NOUN", F.lit(False))).withColumn("lemma", F.coalesce("lemma", "word")).drop("pos")


def frequent_concepts(texts: DataFrame, key: list[str], lexicon: DataFrame | None = None, most: int = 7) -> DataFrame:
    """key..., rank, name, freq, importance, source_quote: the most frequent noun lemmas, earlier first on ties."""
    words = texts.select(*key, F.posexplode(T.lower_words(F.col("text"))).alias("pos", "word")).where((F.length("word") > 2) & ~F.col("word").rlike("^[0-9]+$"))
    counts = tagged(words, lexicon).where(F.col("noun") & ~F.col("lemma").isin(T.CONTENT_STOP_WORDS)).groupBy(*key, "lemma").agg(F.count("*").alias("freq"), F.min("pos").alias("first"))
    order = Window.partitionBy(*key).orderBy(F.desc("freq"), "first")
    rows = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("top", F.max("freq").over(Window.partitionBy(*key)))
    score = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("freq") / F.col("top"))) * ((100 - F.col("rank") * 3) / 100)  # in hundredths: 1 - 6 * 0.03 is a bit above 0.82
    quotes = texts.select(*key, F.left(T.fallback_sentences(F.col("text"), 1), F.lit(300)).alias("source_quote"))
    return rows.join(quotes, key).select(*key, "rank", F.col("lemma").alias("name"), "freq", (F.floor(score * 1000 + 0.5) / 1000).alias("importance"), "source_quote")


def clean_concepts(items: DataFrame, key: list[str], most: int = 10) -> DataFrame:
    """items(key..., seq, name, short_explanation, source_quote, importance_score, hint): the usable ones, best first."""
    name = F.trim("name")
    rows = items.withColumn("name", name).where((F.length("name") > 0) & (F.length("name") <= 140))
    fits = T.language_fits(F.col("name"), F.col("hint"))
    rows = rows.where(~F.col("hint").isin("ru", "en") | fits).withColumn("score", T.unit_score(F.col("importance_score"), 0.5))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key, F.lower("name")).orderBy("seq"))).where("k = 1")

    def blank(c: str):
        return F.when(F.col("hint").isin("ru", "en") & ~T.language_fits(F.col(c), F.col("hint")), F.lit("")).otherwise(F.coalesce(F.trim(c), F.lit("")))

    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "seq"))).where(F.col("rank") <= most)
    return rows.select(*key, "rank", "name", "score", blank("short_explanation").alias("short_explanation"), F.left(blank("source_quote"), F.lit(800)).alias("source_quote"))


def topped_up(found: DataFrame, spare: DataFrame, key: list[str], least: int = 3, most: int = 10) -> DataFrame:
    """found(key..., rank, name) filled up from spare(key..., rank, name) where there are fewer than `least`."""
    named = found.select(*key, F.lit(0).alias("kind"), "rank", "name")
    extra = spare.select(*key, F.lit(1).alias("kind"), "rank", "name", F.lower("name").alias("low"))
    extra = extra.join(found.select(*key, F.lower("name").alias("low")).distinct(), [*key, "low"], "left_anti").drop("low")
    rows = named.unionByName(extra).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("kind", "rank")))
    return rows.where(((F.col("kind") == 0) | (F.col("k") <= least)) & (F.col("k") <= most)).select(*key, F.col("k").alias("rank"), "name", "kind")


def definition_terms(texts: DataFrame, key: list[str], definitions=DEFINITIONS, noun=T.plain_noun) -> DataFrame:
    """key..., normalized_term, term, definition, seq: per sentence the first valid term; per term the longest definition."""
    rows = texts.select(*key, F.posexplode(T.sentences(T.strip_tags(F.col("text")))).alias("seq", "sentence"))
    terms = [T.clean_term(F.nullif(F.regexp_extract("sentence", p, g), F.lit(""))) for p, g in definitions]
    term = F.coalesce(*[F.when(T.valid_term(t, noun), t) for t in terms])
    rows = rows.withColumn("term", term).where("term is not null").withColumn("normalized_term", F.array_join(T.lower_words(F.col("term")), " "))
    best = Window.partitionBy(*key, "normalized_term").orderBy(F.desc(F.length("sentence")), "seq")
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").select(*key, "normalized_term", "term", F.col("sentence").alias("definition"), "seq")


def lemma_counts(texts: DataFrame, key: list[str], lexicon: DataFrame | None = None) -> DataFrame:
    words = texts.select(*key, F.explode(T.lower_words(F.col("text"))).alias("word")).where(~F.col("word").rlike("^[0-9]+$"))
    return tagged(words, lexicon).groupBy(*key, "lemma").agg(F.count("*").alias("n"))


def term_frequency(terms: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """terms(key..., normalized_term): the least count of the term's words, a missing word counting 1."""
    words = terms.select(*key, "normalized_term", F.explode(F.split("normalized_term", " ")).alias("lemma"))
    return words.join(counts, [*key, "lemma"], "left").groupBy(*key, "normalized_term").agg(F.greatest(F.lit(1), F.min(F.coalesce("n", F.lit(1)))).cast("long").alias("frequency"))


def resolved(names: DataFrame, alike: float = 0.9, close: float = 0.85, block: int = 4096) -> DataFrame:
    """names(seq, name, description) in write order -> seq, normalized_name, concept (seq of the one that it became).

    Exact names agree by a group-by. Of what is left every pair is bounded, block by block, as any two texts may be
    close by hashed words that share slots: a pair goes on if the product of its embeddings is near enough, or if
    the counts of its characters allow the ratio. Each connected group is then decided in write order by one task.
    """
    rows = names.select("seq", T.concept_name(F.col("name")).alias("normalized_name"), F.coalesce("description", F.lit("")).alias("description"), "name").where("normalized_name <> ''")
    firsts = rows.groupBy("normalized_name").agg(F.min(F.struct("seq", "name", "description")).alias("f")).select("normalized_name", "f.*")

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    vec = firsts.select("seq", hash_embedding("normalized_name").alias("v"), hash_embedding(F.concat_ws(". ", "name", "description")).alias("d"))
    pairs = _candidates(firsts.select("seq", "normalized_name").join(vec, "seq"), alike, close, max(1, -(-firsts.count() // block)))
    old = vec.join(firsts, "seq").select(F.col("seq").alias("a"), F.col("normalized_name").alias("na"), F.col("d").alias("da"))
    new = vec.join(firsts, "seq").select(F.col("seq").alias("b"), F.col("normalized_name").alias("nb"), F.col("v").alias("vb"))
    scored = pairs.join(new, "b").join(old, "a")
    scored = cut(scored.select("a", "b", "na", F.greatest(ratio("nb", "na"), F.lit(0.0)).alias("r"), cosine(F.col("vb"), F.col("da")).alias("c")).where((F.col("r") >= alike) | (F.col("c") >= close)))
    roots = components(scored.select("a", "b"))
    grouped = scored.join(roots, F.col("a") == roots["node"]).select("root", "a", "b", "na", "r", "c")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, int] = {}
        for seq in sorted({*pdf["a"], *pdf["b"]}):
            made = pdf[(pdf["b"] == seq) & pdf["a"].map(lambda x: own.get(x) == x)]
            near = made[made["r"] >= alike].sort_values(["r", "na"], ascending=[False, True])
            if near.empty:
                near = made[made["c"] >= close].sort_values(["c", "na"], ascending=[False, True])
            own[seq] = seq if near.empty else int(near.iloc[0]["a"])
        return pd.DataFrame({"seq": list(own), "concept": list(own.values())})

    decided = grouped.groupBy("root").applyInPandas(decide, "seq long, concept long")
    first = firsts.join(decided, "seq", "left").select("normalized_name", F.coalesce("concept", "seq").alias("concept"))
    return rows.join(first, "normalized_name").select("seq", "normalized_name", "concept")


def _candidates(rows: DataFrame, alike: float, close: float, blocks: int) -> DataFrame:
    """rows(seq, normalized_name, v, d) -> all pairs a < b whose bounds reach either limit; rows are dealt into `blocks`."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("seq"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["own"] == pdf["own"].min()], pdf[pdf["own"] == pdf["own"].max()]
        x_seq, y_seq = x["seq"].to_numpy(), y["seq"].to_numpy()
        x_len, y_len = x["normalized_name"].str.len().to_numpy(), y["normalized_name"].str.len().to_numpy()
        x_v, x_d, y_v, y_d = (np.stack(c) for c in (x["v"], x["d"], y["v"], y["d"]))
        x_n, y_n = _characters(x["normalized_name"]), _characters(y["normalized_name"])
        y_norm = (y_n * y_n).sum(axis=1)
        a, b = [], []
        for k in range(0, len(x), 512):
            s = slice(k, k + 512)
            first = x_seq[s, None] < y_seq
            ok = np.where(first, x_d[s] @ y_v.T, x_v[s] @ y_d.T) >= close - 1e-6
            # The ratio is 2 * matched / both lengths, so (1 - alike) of both is the most that character counts differ by.
            most = (1 - alike) * (x_len[s, None] + y_len) + 1e-6
            near = (x_n[s] * x_n[s]).sum(axis=1)[:, None] + y_norm - 2 * (x_n[s] @ y_n.T) <= most * most
            i, j = np.nonzero(near & ~ok)
            for c in range(0, len(i), 65536):
                p, q = i[c : c + 65536], j[c : c + 65536]
                ok[p, q] = np.abs(x_n[s][p] - y_n[q]).sum(axis=1) <= most[p, q]
            i, j = np.nonzero(ok & (x_seq[s, None] != y_seq))
            a.append(np.minimum(x_seq[s][i], y_seq[j]))
            b.append(np.maximum(x_seq[s][i], y_seq[j]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    pairs = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).groupBy("x", "y").applyInPandas(bounded, "a long, b long")
    return pairs.distinct()


def _characters(names: pd.Series) -> np.ndarray:
    """Counts of each name's characters by their codes modulo 64; merged characters only lessen differences."""
    return np.stack([np.bincount([ord(c) % 64 for c in n], minlength=64) for n in names]).astype(float)


def last_mentions(writes: DataFrame) -> DataFrame:
    """writes(seq, concept, block, ...): the last write of each (concept, block), with the number of writes."""
    whole = Window.partitionBy("concept", "block")
    rows = writes.withColumn("k", F.row_number().over(whole.orderBy(F.desc("seq")))).withColumn("writes", F.count("*").over(whole))
    return rows.where("k = 1").drop("k")


def written(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and mentions left by writes(seq, name, summary, book, block, quote, importance), in order of seq.

    A name that is empty or bad is skipped. The first writer of a concept gives its name, the first summary that isn't
    empty its description. The last write of a concept in a block gives the mention.
    concepts: concept, name, normalized_name, description. mentions: concept, block, book, seq, explanation, quote, importance.
    """
    name = F.trim("name")
    rows = writes.withColumn("name", name).where((F.coalesce(name, F.lit("")) != "") & ~T.bad_concept(F.col("name")))
    rows = cut(rows.withColumns({"summary": F.left(F.trim(F.coalesce("summary", F.lit(""))), F.lit(2000)), "importance": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.6))))}))
    became = cut(resolved(rows.select("seq", "name", F.col("summary").alias("description"))))
    rows = rows.join(became, "seq")
    kept = rows.groupBy("concept").agg(
        F.left(F.min_by("name", "seq"), F.lit(255)).alias("name"), F.left(F.min_by("normalized_name", "seq"), F.lit(255)).alias("normalized_name"),
        F.coalesce(F.min_by("summary", F.when(F.col("summary") != "", F.col("seq"))), F.lit("")).alias("description"),
    )
    mentions = last_mentions(rows.select("concept", "block", "book", "seq", F.col("summary").alias("explanation"), "quote", "importance")).drop("writes")
    return kept, mentions
