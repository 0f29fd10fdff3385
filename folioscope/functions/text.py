"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WORD = "[A-Za-zА-Яа-яЁё0-9-]+"
#: Whole words of three characters or more that are no numbers.
LONG_WORD = "(?<![A-Za-zА-Яа-яЁё0-9-])(?![0-9]+(?![A-Za-zА-Яа-яЁё0-9-]))[A-Za-zА-Яа-яЁё0-9-]{3,}"
BAD_SINGLE_WORDS = ["текст", "книга", "глава", "раздел", "пример", "задача", "тема", "автор"]
CONTENT_STOP_WORDS = ["книга", "автор", "текст", "пример", "задача", "глава", "раздел", "данный", "этот", "тема"]
TERM_STOP_WORDS = ["это", "и", "в", "на", "к", "с", "по", "как", "под", "для", "или", "из", "о", "об", "а", "но", "то", "что"]
GENERIC_RU = [
    "в этом блоке рассматривается",
    "в данной главе рассматривается",
    "в тексте рассматривается",
    "данный раздел посвящен",
    "основная идея заключается",
    "данный материал",
    "main meaning",
    "2-4 предложения",
    "конкретикой из блоков",
    "по сути, с конкретикой",
]
GENERIC_EN = ["this section discusses", "this chapter discusses", "this block discusses", "the main idea is", "this material describes", "main meaning", "2-4 sentences"]
GENERIC_ALWAYS = ["main meaning", "2-4 предложения", "2-4 sentences", "по сути, с конкретикой из блоков"]

COMPARED = [
    "2. Differences: emphasis changes by context of each source.",
    "3. Where simpler: shorter and more applied explanations.",
    "4. Where deeper: longer blocks with expanded reasoning.",
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def lower_words(text: Column) -> Column:
    return F.transform(words(text), F.lower)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def normal_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def long_pieces(text: Column, pattern: str, least: int = 35) -> Column:
    # A lambda of its own: F.trim takes two arguments, and transform() would give it a piece's place as the characters to trim.
    return F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def fallback_sentences(text: Column, limit: int = 3) -> Column:
    """The first long sentences, else long pieces between stops, else the head of the text."""
    whole, pieces = long_pieces(text, r"(?<=[.!?])\s+"), long_pieces(text, r"[.!?]+")
    picked = F.when(F.size(whole) > 0, whole).otherwise(pieces)
    return F.coalesce(F.nullif(F.trim(F.array_join(F.slice(picked, 1, limit), " ")), F.lit("")), F.trim(F.left(text, F.lit(500))))


def first_quote(text: Column, most: int = 220) -> Column:
    whole = normal_spaces(text)
    head = sentences(whole)[0]
    return F.left(F.when(F.length(head) < 20, whole).otherwise(head), F.lit(most))


def head_and_tail(text: Column, most: int) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 220)), F.lit("\n...\n"), F.right(t, F.lit(180)))).otherwise(t)


def language_hint(text: Column) -> Column:
    cyrillic, latin = F.regexp_count(text, F.lit("[А-Яа-яЁё]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((cyrillic > 0) & (cyrillic >= latin), "ru").when(latin > 0, "en").otherwise("auto")


def language_fits(value: Column, hint: Column) -> Column:
    v = F.trim(value)
    russian = v.rlike("[А-Яа-яЁё]") | v.rlike("[A-Za-z]") | v.rlike("^[A-Z0-9-]{2,8}$")
    return F.when(F.coalesce(F.length(v), F.lit(0)) == 0, False).when(v.rlike("[一-鿿]"), False).when(hint == "ru", russian).otherwise(True)


def concept_name(text: Column, lemma=lambda w: w) -> Column:
    """Lower-case words without numbers, each by `lemma`, joined."""
    return F.array_join(F.transform(F.filter(lower_words(text), lambda w: ~w.rlike("^[0-9]+$")), lemma), " ")


def bad_concept(text: Column) -> Column:
    name = concept_name(text)
    count = F.size(F.split(name, " "))
    return (name == "") | (F.length(name) < 2) | (count > 7) | ((count == 1) & name.isin(BAD_SINGLE_WORDS)) | name.rlike("^[0-9]+$")


def clean_term(text: Column) -> Column:
    return F.array_join(F.slice(words(strip_tags(text)), 1, 4), " ")


def noun_phrase(term: Column, noun) -> Column:
    """One to four words, one of them a noun by the predicate `noun`."""
    w = lower_words(term)
    return F.size(w).between(1, 4) & F.exists(w, noun)


def valid_term(term: Column, noun) -> Column:
    return (F.length(term) >= 2) & ~term.rlike("^[0-9]+$") & ~F.lower(term).isin(TERM_STOP_WORDS) & noun_phrase(term, noun)


def plain_noun(word: Column) -> Column:
    """Stand-in for a part-of-speech lexicon: letters only, and over three of them."""
    return (F.length(word) > 3) & word.rlike("^[a-zа-яё]+$")


def content_tokens(text: Column, lemma=None) -> Column:
    """Different words of three characters or more, numbers and stop words aside, in lower case and by `lemma`, in order."""
    stop = F.array(*[F.lit(w) for w in CONTENT_STOP_WORDS])
    long = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LONG_WORD), F.lit(0))
    tokens = F.array_except(F.transform(long, F.lower), stop)
    if lemma is None:
        return tokens
    return F.array_except(F.filter(F.transform(tokens, lemma), lambda w: F.length(w) >= 3), stop)


def _hits(text: Column, markers: list[str]) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + F.contains(text, F.lit(m)).cast("int")
    return out


def generic_summary(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    ru, en = _hits(low, GENERIC_RU), _hits(low, GENERIC_EN)
    return (_hits(low, GENERIC_ALWAYS) > 0) | (ru >= 2) | (en >= 2) | ((F.length(low) < 65) & ((ru >= 1) | (en >= 1)))


def overlap(a: Column, b: Column) -> Column:
    """The share of the tokens in a that b holds too."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def grounded(rows: DataFrame, summary: str, evidence: str, fallback: str, quoted: str | None = None) -> DataFrame:
    """rows with `summary` held against `evidence`: what shares too little with it or is generic gives way to `fallback`, or to sentences of the evidence.

    A summary that equals the column `quoted` stands, whatever its words. In steps, so that the tokens of the evidence
    are made once a row.
    """
    own, spare = (F.nullif(normal_spaces(F.coalesce(F.col(x), F.lit(""))), F.lit("")) for x in (summary, fallback))
    rows = rows.withColumns({"_own": own, "_spare": spare})
    rows = rows.withColumn("_spare", F.coalesce("_spare", F.when(F.col("_spare").isNull(), fallback_sentences(F.col(evidence)))))
    rows = rows.withColumn("_said", F.coalesce("_own", "_spare"))
    rows = rows.withColumns({"_a": content_tokens(F.col("_said")), "_b": content_tokens(F.col(evidence)), "_generic": generic_summary(F.col("_said"))})
    weak = (overlap(F.col("_a"), F.col("_b")) < 0.18) | F.col("_generic")
    if quoted is not None:
        weak = weak & ~F.col("_own").eqNullSafe(F.col(quoted))
    return rows.withColumn(summary, F.left(F.when(weak, F.col("_spare")).otherwise(F.col("_said")), F.lit(2000))).drop("_own", "_spare", "_said", "_a", "_b", "_generic")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), F.lit(False))


def contains_fold(text: Column, part: Column | str) -> Column:
    return F.contains(F.upper(text), F.upper(F.lit(part) if isinstance(part, str) else part))


def or_default(text: Column, default: Column | str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def unit_score(value: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def page_paragraphs(text: Column) -> Column:
    """Paragraphs of a page's text: blank-line pieces of 20 characters or more, else sentences gathered to 240."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    pieces = F.filter(F.transform(F.split(unix, r"\n{2,}"), normal_spaces), lambda p: F.length(p) >= 20)
    parts = F.filter(F.split(normal_spaces(unix), r"(?<=[.!?])\s+"), lambda s: s != "")

    def add(acc: Column, s: Column) -> Column:
        grown = F.trim(F.concat_ws(" ", acc["open"], s))
        full = F.length(grown) >= 240
        return F.struct(F.when(full, F.array_append(acc["done"], grown)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    built = F.aggregate(parts, begin, add, lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda p: F.length(p) >= 20))
    return F.when(F.size(pieces) > 0, pieces).otherwise(built)


def prompt_targets(total: Column, least: int, target: int, most: int) -> Column:
    """How many blocks a chapter of so many words is asked to be cut into: total / target, within what the sizes allow."""
    low, high = (F.greatest(F.lit(1), F.ceil(total / max(1, x))) for x in (most, least))
    wanted = F.greatest(F.lit(1), F.bround(total / max(1, target)))
    return F.greatest(low, F.least(high, wanted)).cast("long")


def compare_reply(name: Column, titles: Column) -> Column:
    """The answer to a comparison that needs no model: titles are the different titles of the sources, joined."""
    first = F.concat(F.lit("1. Common points: concept '"), name, F.lit("' appears in multiple user sources."))
    last = F.concat(F.lit("5. Final takeaway: comparison built from books "), or_default(F.coalesce(titles, F.lit("")), "without source labels"), F.lit("."))
    return F.concat_ws("\n", first, *[F.lit(x) for x in COMPARED], last)
