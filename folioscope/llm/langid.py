"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a space, and its byte n-grams are hashed to rows of an
embedding table; their mean goes through a linear layer to a softmax. Both are trained together by stochastic
gradient descent in numpy, one document at a time with all of its n-grams, on a bounded sample of rows: at most `per_lang`
labelled documents of each language and about `most` of all, drawn by hash from the whole table. Where there are more
than most / 10 languages, those with the most documents are learnt.

As many documents again, which training never sees, calibrate it: they set the temperature, and the least score
that a document must reach. That is the k-th smallest score of the n rightly predicted ones, k being reject * (n + 1)
rounded down, so that no more than the share `reject` of documents like them is expected below it; while n is too
small for that (k = 0) only `und` is rejected.

Prediction reads every n-gram of the whole text. Defined results: `und`, score 0, for a null text or one without
a letter, and for every text when no row is labelled; rows with equal doc_id are predicted on their own;
a null doc_id counts as the empty text for the fold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import pieces

PER_LANG, MOST = 400, 4000
ORDERS, BITS, DIM = (2, 3, 4), 16, 16
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_CHUNK = 1 << 20


def held_out() -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(0)) % 4 == 2


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Rows of the table for the n-grams of one order, one for each place in data but the last order - 1."""
    m = max(0, len(data) - order + 1)
    x = data[:m].astype(np.uint32)
    for i in range(1, order):
        x |= data[i : i + m].astype(np.uint32) << np.uint32(8 * i)
    x += np.uint32(order * 0x3C6EF372 & 0xFFFFFFFF)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0x9E3779B1)
    return x >> np.uint32(32 - BITS)


def letters(text: str | None) -> bytes:
    """The text as words between spaces; empty if it has no letter."""
    if not text or not _LETTER.search(text):
        return b""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a row for each n-gram
    weights: np.ndarray  # from the mean row to the languages
    bias: np.ndarray
    temperature: float
    least: float

    def __post_init__(self):
        # Where there are few languages, each n-gram's share of the logits is less to add up than its row.
        self.share = (self.table @ self.weights).astype(np.float32) if len(self.langs) <= self.table.shape[1] else None

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of the mean over all n-grams of each text, worked off in chunks of many short texts or parts of a long one."""
        rows_of = self.table if self.share is None else self.share
        sums, counts = np.zeros((len(texts), rows_of.shape[1])), np.zeros(len(texts))
        size, rows, parts, limits = 0, [], [], []

        def flush() -> None:
            nonlocal size
            data = np.frombuffer(b"".join(parts), np.uint8)
            ends = np.cumsum([len(p) for p in parts])
            begins = ends - [len(p) for p in parts]
            at = np.asarray(rows)
            for n in ORDERS:
                share = rows_of[grams(data, n)]
                many = np.minimum(ends - begins - n + 1, limits)
                ok = many > 0
                if ok.any():
                    # Sums of the first `many` n-grams of each part; what lies between is left out.
                    edges = np.stack([begins[ok], (begins + many)[ok]], axis=1).ravel()
                    last = edges[-1] >= len(share)
                    got = np.add.reduceat(share, edges[:-1] if last else edges, axis=0)[::2]
                    np.add.at(sums, at[ok], got)
                    np.add.at(counts, at[ok], many[ok])
            rows.clear()
            parts.clear()
            limits.clear()
            size = 0

        for row, b in enumerate(texts):
            for o in range(0, len(b), _CHUNK):  # n-grams over the borders of a long text's parts belong to the earlier part alone
                part = b[o : o + _CHUNK + max(ORDERS) - 1]
                rows.append(row)
                parts.append(part)
                limits.append(_CHUNK)
                size += len(part)
                if size >= _CHUNK:
                    flush()
        if parts:
            flush()
        mean = sums / np.maximum(counts, 1)[:, None]
        return (mean @ self.weights if self.share is None else mean) + self.bias

    def scores(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        return best, z[np.arange(len(z)), best]


#: A document as the different rows of the table that its n-grams hash to, and each one's share of them.
Bag = tuple[np.ndarray, np.ndarray]


def bag_of(data: np.ndarray) -> Bag:
    rows, counts = np.unique(np.concatenate([grams(data, n) for n in ORDERS]), return_counts=True)
    return rows, (counts / max(1, counts.sum())).astype(np.float32)


def fit(bags: list[Bag], targets: np.ndarray, spare: list[Bag], truth: np.ndarray, langs: list[str], reject: float, updates: int = 12_000, rate: float = 0.5, seed: int = 3) -> Model:
    """Train on bags of the languages `targets`; calibrate on `spare` of the languages `truth`."""
    rng = np.random.default_rng(seed)
    c = len(langs)
    table = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, c), np.float32), np.zeros(c, np.float32)
    weight = (len(bags) / (c * np.maximum(np.bincount(targets, minlength=c), 1))).astype(np.float32)
    epochs = max(3, -(-updates // len(bags)))
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for d in rng.permutation(len(bags)):
            rows, share = bags[d]
            mean = share @ table[rows]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[targets[d]] -= 1
            p *= weight[targets[d]] * step
            back = weights @ p
            weights -= np.outer(mean, p)
            bias -= p
            table[rows] -= np.outer(share * np.float32(8), back)
    model = Model(langs, table, weights, bias, 1.0, 0.0)
    if not spare:
        return model
    z = np.stack([share @ table[rows] for rows, share in spare]) @ weights + bias

    def loss(t: float) -> float:
        y = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(y).sum(axis=1)) - y[np.arange(len(y)), truth]).mean())

    model.temperature = float(min(np.geomspace(0.02, 20, 61), key=loss))
    best, score = model.scores(z)
    right = np.sort(score[best == truth])
    k = int(reject * (len(right) + 1))
    model.least = float(right[k - 1]) if k else 0.0
    return model


def train(docs: DataFrame, per_lang: int = PER_LANG, reject: float = 0.001, most: int = MOST) -> Model | None:
    """Fit on documents outside the held-out fold with a language; None if there are none."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, most // 10)).collect()
    if not counts:
        return None
    per_lang = max(10, min(per_lang, most // len(counts)))
    # Twice as many and half as many again, so that per_lang are left to train and to calibrate; a rare language comes whole.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 3.0 * per_lang / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 53)) / float(1 << 53)

    def bag(batches):
        for batch in pieces(batches):
            kept, rows, shares = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = np.frombuffer(letters(text), np.uint8)
                if len(data) > min(ORDERS):
                    own, part = bag_of(data)
                    kept.append(i)
                    rows.append(own.astype(np.uint16).tobytes())
                    shares.append(part.tobytes())
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(at), batch.column("draw").take(at), pa.array(rows, pa.binary()), pa.array(shares, pa.binary())], ["lang", "draw", "rows", "shares"])

    # Equal rows have one draw and count once, so the sample stays near 3 * per_lang rows a language; of those the first are taken.
    drawn = labelled.select("lang", draw.alias("draw"), "text").where(F.col("draw") < share[F.col("lang")])
    drawn = drawn.mapInArrow(bag, "lang string, draw double, rows binary, shares binary").groupBy("lang", "draw").agg(F.min(F.struct("rows", "shares")).alias("bag"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    rows = drawn.withColumn("place", place).where(F.col("place") <= 2 * per_lang).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.place))
    langs = sorted({r.lang for r in rows})
    number = {x: i for i, x in enumerate(langs)}
    of: dict[bool, tuple[list[Bag], list[int]]] = {True: ([], []), False: ([], [])}
    for r in rows:  # every other document calibrates
        bags, targets = of[r.place % 2 == 1]
        bags.append((np.frombuffer(r.bag.rows, np.uint16), np.frombuffer(r.bag.shares, np.float32)))
        targets.append(number[r.lang])
    (bags, targets), (spare, truth) = of[True], of[False]
    return fit(bags, np.array(targets), spare, np.array(truth, int), langs, reject)


def _judged(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    plain = [letters(t) for t in texts]
    lang, score = np.full(len(plain), "und", object), np.zeros(len(plain))
    some = [i for i, b in enumerate(plain) if b.strip()]
    if model is not None and some:
        best, p = model.scores(model.logits([plain[i] for i in some]))
        lang[some], score[some] = np.array(model.langs, object)[best], p
    return lang, score, (lang == "und") | (score < (model.least if model is not None else 0.0))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with lang_pred, score and rejected (by the calibrated least score, or `und`); those named like them are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = ("lang_pred", "score", "rejected")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in made])

    def run(batches):
        for batch in pieces(batches):
            lang, score, rejected = _judged(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(~_judged(shared.value, batch.column("text").to_pylist())[2]))

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; trained on docs itself."""
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(only)
    return predict(only.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
