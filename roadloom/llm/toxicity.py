"""Toxicity by class-conditional Kneser-Ney models over characters, with shared backoff counts from the whole corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix, table, written

#: Orders of the class models, and the highest of the shared model below them. What the shared model takes off each count.
ORDERS, SHARED_ORDER, DISCOUNT = (5, 6), 4, 0.75
#: Bits of a code point and its successor; a long holds three.
BITS, EACH = 21, 3
#: The code of the space before a word, which nothing precedes.
START = ord(" ") + 1
#: Widths of the passages, in words, from which the fit chooses; 0 is the whole text.
SPANS = (1, 2, 3, 5, 8, 16, 0)


def laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each between two spaces; the place in its word and the number of the word of each."""
    joined = "".join([f" {w} " for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    return codes, place, word


def packed_grams(codes: np.ndarray, place: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact ``order``-grams at ``ends``: the last three code points, and those before, with 0 for what lies before the word."""
    low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    for k in range(order):
        code = np.where(place[ends] >= k, codes[np.maximum(ends - k, 0)].astype(np.int64) + 1, 0)
        part = low if k < EACH else high
        part |= code << (BITS * (k % EACH))
    return high, low


def last(high: np.ndarray, low: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` characters of packed grams."""
    return high & ((1 << BITS * max(order - EACH, 0)) - 1), low & ((1 << BITS * min(order, EACH)) - 1)


def context(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams without their last character, which leaves its place empty."""
    return high, low & ~((1 << BITS) - 1)


def keyed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each packed gram."""
    return mix(mix(high.view(np.uint64)) ^ low.view(np.uint64))


def packed_counts(words: list[str], amounts: dict[str, np.ndarray], order: int) -> pd.DataFrame:
    """Sums of the ``amounts`` of ``words`` by the ``order``-grams they hold, one at each character after the first space."""
    codes, place, word = laid_out(words)
    ends = np.flatnonzero(place > 0)
    high, low = packed_grams(codes, place, ends, order)
    by = np.lexsort((low, high))
    high, low, word = high[by], low[by], word[ends[by]]
    starts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    sums = {name: np.add.reduceat(n[word], starts) if len(starts) else n[:0] for name, n in amounts.items()}
    return pd.DataFrame({"high": high[starts], "low": low[starts], **sums})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class OrderTable:
    """One order of both class models: sorted grams with log ratios, sorted contexts with log ratios of their backoff weights."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


class ClassCounts:
    """(Continuation) counts of one order in one class, with its contexts' totals and what backing off from them weighs."""

    def __init__(self, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> None:
        self.keys, first = np.unique(keyed(high, low), return_index=True)
        self.count = count[first]
        ones, twos = (self.count == 1).sum(), (self.count == 2).sum()
        self.discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        self.contexts, inverse = np.unique(keyed(*context(high[first], low[first])), return_inverse=True)
        self.total = np.bincount(inverse, self.count, len(self.contexts))
        self.spare = np.minimum(self.count, self.discount)
        self.spare = np.bincount(inverse, self.spare, len(self.contexts)) / np.maximum(self.total, 1e-300)

    def weights(self, contexts: np.ndarray) -> np.ndarray:
        """What is left for the order below after each context: all of it after one that the class never has."""
        at, has = _find(self.contexts, contexts)
        return np.where(has, self.spare[at] if len(self.spare) else 1.0, 1.0)

    def probability(self, grams: np.ndarray, contexts: np.ndarray, below: np.ndarray) -> np.ndarray:
        at, has = _find(self.keys, grams)
        c, there = _find(self.contexts, contexts)
        own = np.where(has & there, np.maximum(self.count[at] - self.discount, 0) / self.total[c], 0.0) if len(self.keys) else 0.0
        return own + self.weights(contexts) * below


class KneserNeyPair:
    """A toxic and an ordinary interpolated Kneser-Ney model over the characters of words, both upon one shared model.

    Before a word's space stand empty places, so that every character has a gram of the highest order. ``grams(high, low, toxic,
    ordinary)`` are those with their counts, ``shared(high, low, p)`` holds the shared probability of each ``SHARED_ORDER``-gram that
    ends one. The highest order has counts; those below count the different characters before a gram, or, where it starts with the
    word and has none, its occurrences.
    """

    def __init__(self, grams: pd.DataFrame, shared: pd.DataFrame) -> None:
        high, low = (grams[c].to_numpy(np.int64) for c in ("high", "low"))
        known = keyed(*(shared[c].to_numpy(np.int64) for c in ("high", "low")))
        by = np.argsort(known)
        at, has = _find(known[by], keyed(*last(high, low, SHARED_ORDER)))
        p = shared["p"].to_numpy(float)[by]
        own = [np.where(has, p[at] if len(p) else 1.0, 1e-6)] * 2
        del known, by, at, has
        self.tables: dict[int, OrderTable] = {}
        for order in ORDERS:
            cut = last(high, low, order)
            names, heads = keyed(*cut), keyed(*context(*cut))
            models = [ClassCounts(*self._at_order(high, low, grams[c].to_numpy(float), order)) for c in ("toxic", "ordinary")]
            own = [m.probability(names, heads, b) for m, b in zip(models, own, strict=True)]
            heads = np.unique(heads)
            backoff = np.log(models[0].weights(heads) / models[1].weights(heads)).astype(np.float32)
            names, at = np.unique(names, return_index=True)
            self.tables[order] = OrderTable(names, np.log(own[0][at] / own[1][at]).astype(np.float32), heads, backoff)

    @staticmethod
    def _at_order(high: np.ndarray, low: np.ndarray, count: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        live = count > 0
        high, low, count = high[live], low[live], count[live]
        if order < ORDERS[-1]:
            k = order - EACH - 1
            starts = np.where(high >> (BITS * k) & ((1 << BITS) - 1) <= START, 1, 0).astype(bool)  # nothing before it: its own count
            count = np.where(starts, count, 1.0)
            high, low = last(high, low, order)
        keys, first, inverse = np.unique(keyed(high, low), return_index=True, return_inverse=True)
        return high[first], low[first], np.bincount(inverse, count, len(keys))

    def log_ratios(self, words: list[str], block: int = 1 << 19) -> np.ndarray:
        """For each word, the toxic less the ordinary log-likelihood."""
        codes, place, word = laid_out(words)
        out = np.zeros(len(words))
        every = np.flatnonzero(place > 0)
        for a in range(0, len(every), block):
            ends = every[a : a + block]
            high, low = packed_grams(codes, place, ends, ORDERS[-1])
            value, open_ = np.zeros(len(ends)), np.ones(len(ends), bool)
            for order in reversed(ORDERS):
                t = self.tables[order]
                cut = last(high, low, order)
                at, has = _find(t.grams, keyed(*cut))
                now = open_ & has
                value[now] += t.ratio[at[now]]
                open_ &= ~has
                at, has = _find(t.contexts, keyed(*context(*cut)))
                now = open_ & has
                value[now] += t.backoff[at[now]]
            out += np.bincount(word[ends], value, len(words))
        return out


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if isinstance(text, str) else []


def likeliest(values: np.ndarray, span: int) -> float:
    """The greatest mean of ``span`` consecutive words' log-likelihood ratios; of all words if there are no more or ``span`` is 0."""
    if not len(values):
        return 0.0
    if span == 0 or len(values) <= span:
        return float(values.sum() / max(span, len(values)))
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[span:] - sums[:-span]).max() / span)


class DocumentScorer:
    """Length-normalised log-likelihood ratios of documents' likeliest toxic passages, through a bounded cache of word values."""

    def __init__(self, model: KneserNeyPair, cached: int = 300_000) -> None:
        self.model, self.cached, self.known = model, cached, {}

    def __call__(self, texts: list[str | None], spans: tuple[int, ...]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        fresh = set().union(*split).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > self.cached:
                self.known.clear()
                fresh = set().union(*split)
            order = list(fresh)
            self.known.update(zip(order, self.model.log_ratios(order).tolist(), strict=True))
        values = [np.fromiter(map(self.known.__getitem__, w), float, len(w)) for w in split]
        return np.array([[likeliest(v, s) for s in spans] for v in values]).reshape(-1, len(spans))


def shared_counts(docs: DataFrame, held: int = 100_000) -> DataFrame:
    """``(high, low, n)``: how often all documents have each ``SHARED_ORDER``-gram of characters, exactly, as a table keyed by the gram.

    A task counts words, ``held`` different ones at a time, and gives out the sums by gram.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()

        def sums() -> pd.DataFrame:
            return packed_counts(list(words), {"n": np.fromiter(words.values(), np.int64, len(words))}, SHARED_ORDER)

        for pdf in frames:
            for text in pdf["text"]:
                words.update(words_of(text))
                if len(words) >= held:
                    yield sums()
                    words.clear()
        yield sums()

    return mapped(docs.select("text"), run, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))


def class_grams(docs: DataFrame, held: int = 100_000) -> DataFrame:
    """``(high, low, toxic, ordinary)``: how often toxic and ordinary ones of ``docs(text, toxic)`` have each gram of the highest order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, list[int]] = {}

        def sums() -> pd.DataFrame:
            counts = np.array(list(words.values()), np.int64).reshape(-1, 2)
            return packed_counts(list(words), {"toxic": counts[:, 0], "ordinary": counts[:, 1]}, ORDERS[-1])

        for pdf in frames:
            for text, label in zip(pdf["text"], pdf["toxic"].tolist(), strict=True):
                for w in words_of(text):
                    words.setdefault(w, [0, 0])[1 - label] += 1
                if len(words) >= held:
                    yield sums()
                    words.clear()
        yield sums()

    sums = mapped(docs.select("text", "toxic"), run, "high long, low long, toxic long, ordinary long")
    return sums.groupBy("high", "low").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _cut(order: int, prefix: str = "") -> list[Column]:
    """The last ``order`` characters of packed grams."""
    masks = {"high": (1 << BITS * max(order - EACH, 0)) - 1, "low": (1 << BITS * min(order, EACH)) - 1}
    return [F.col(name).bitwiseAND(F.lit(mask)).alias(prefix + name) for name, mask in masks.items()]


def shared_model(docs: DataFrame, grams: DataFrame) -> pd.DataFrame:
    """``(high, low, p)``: the shared Kneser-Ney probability of each ``SHARED_ORDER``-gram that ends one of ``grams(high, low)``.

    The highest order has the counts of all ``docs``, those below the numbers of different characters before a gram (a gram that
    starts a word, before which there is nothing, its count); each is discounted and interpolated with the one below. Counts and
    their contexts' totals are made over the whole table; only what ``grams`` need is carried through the joins and reaches the driver.
    """
    counts, wanted = shared_counts(docs), written(grams.select(*_cut(SHARED_ORDER)).distinct())
    tables = {}
    for order in range(SHARED_ORDER, 0, -1):
        if order < SHARED_ORDER:
            cut = counts.select(*_cut(order), "n")
            name, k = ("high", order - EACH - 1) if order > EACH else ("low", order - 1)
            starts = F.shiftright(name, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)) <= START if order > 1 else F.lit(False)
            counts = cut.groupBy("high", "low").agg(F.sum(F.when(starts, F.col("n")).otherwise(1)).alias("n"))
        tables[order] = counts = written(counts)
    below = None
    for order in range(1, SHARED_ORDER + 1):
        before = [F.col("high").alias("before_high"), F.col("low").bitwiseAND(F.lit(~((1 << BITS) - 1))).alias("before_low")]
        contexts = tables[order].groupBy(*before).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        own = tables[order].join(wanted.select(*_cut(order)).distinct(), ["high", "low"]).select("high", "low", "n", *before, *_cut(order - 1, "tail_"))
        own = own.join(contexts, ["before_high", "before_low"])
        if below is None:
            own = own.withColumn("p", F.col("n") / F.col("total"))
        else:
            own = own.join(below, ["tail_high", "tail_low"]).withColumn("p", (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("q")) / F.col("total"))
        own = written(own.select("high", "low", "p"))
        below = own.select(F.col("high").alias("tail_high"), F.col("low").alias("tail_low"), F.col("p").alias("q"))
    return own.toPandas()


@dataclass
class ToxicityModel:
    pair: KneserNeyPair
    slope: float
    offset: float
    span: int = 0

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -30, 30)))


def logistic(value: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a little ridge, by Newton's method on the standardised value of weighted rows."""
    mean, sd = float(value.mean()), float(value.std()) or 1.0
    x = np.stack([(value - mean) / sd, np.ones(len(value))], 1)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 0.05 * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), grad)
        b = b - np.clip(step, -2, 2)
    return float(b[0] / sd), float(b[1] - b[0] * mean / sd)


def ranks_above(value: np.ndarray, label: np.ndarray) -> float:
    """The chance that a row of label 1 has a greater value than one of label 0 (ties half): the area under the curve."""
    order = pd.Series(value).rank().to_numpy()
    ones = int(label.sum())
    return float((order[label == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(label) - ones)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> ToxicityModel:
    """Fits on rows of ``labels(doc_id, toxic)``; shared counts come from every row of ``docs``.

    Of each class at most ``max_rows`` labelled documents, those with the smallest hashed doc_id, are used: three quarters for the
    class models' grams, the others for the width of the passages (of ``SPANS`` the one that tells the classes apart best) and for the
    logistic curve from length-normalised log-likelihood ratio to probability. A row of the
    curve weighs as many labelled documents of its class as it stands for, so that the cut does not change the classes' shares. Only
    ids, grams of these rows with their counts and ratios reach the driver, so its memory is bounded by ``max_rows``. Null labels and texts are left out; of rows that
    repeat a doc_id the smallest text and label count. Without a document of both classes every score is 0.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min(F.col("toxic").cast("int")).alias("toxic"))
    known = docs.select("doc_id").distinct().join(known, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    ids = [tuple(r) for k in (0, 1) for r in known.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(max_rows).collect()]
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = docs.sparkSession.createDataFrame(ids, known.schema)
    taken = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    taken = written(taken.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), (F.pmod(F.shiftright(F.first("h"), 7), F.lit(4)) != 0).alias("fit")))
    kinds = {(r["toxic"], r["fit"]) for r in taken.select("toxic", "fit").distinct().collect()}
    split = len(kinds) == 4
    fit = taken.where("fit") if split else taken
    grams = written(class_grams(fit))
    shared = shared_model(docs, grams)
    pair = KneserNeyPair(grams.toPandas(), shared)
    del shared
    if len({toxic for toxic, _ in kinds}) < 2:
        return ToxicityModel(pair, 0.0, -30.0)
    held = _values((taken.where("not fit") if split else taken).select("toxic", "text"), pair).toPandas()
    value = np.array(held["values"].tolist(), float).reshape(-1, len(SPANS))
    label = held["toxic"].to_numpy(np.int64)
    best = max(range(len(SPANS)), key=lambda k: (round(ranks_above(value[:, k], label), 9), -k))
    order = np.lexsort((label, value[:, best]))
    value, label = value[order, best], label[order]
    stands_for = np.array([counts.get(k, 0) / max(1, sum(r[1] == k for r in ids)) for k in (0, 1)])
    return ToxicityModel(pair, *logistic(value, label, stands_for[label]), SPANS[best])


def _values(docs: DataFrame, pair: KneserNeyPair) -> DataFrame:
    """``(toxic, values)``: a text's value for each width of passages."""
    shipped = docs.sparkSession.sparkContext.broadcast(pair)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = DocumentScorer(shipped.value)
        for pdf in frames:
            texts = pdf["text"].tolist()
            for k in range(0, len(texts), 256):
                yield pd.DataFrame({"toxic": pdf["toxic"].iloc[k : k + 256], "values": list(score(texts[k : k + 256], SPANS))})

    return mapped(docs.select("toxic", "text"), run, "toxic int, values array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """Adds ``column``, the probability of toxicity of each whole text, to ``docs``; null and empty texts count as no words.

    The value of a text is the greatest difference of the two models' log-likelihoods, by word, over its passages of the model's
    width: a long text is as toxic as its most toxic passage. The model (bounded by the rows it was fitted on) is broadcast once. A
    column of the same name is replaced; repeated rows get equal scores; an empty table stays empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != column]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        score = DocumentScorer(m.pair)
        for pdf in frames:
            texts = pdf["text"].tolist()
            value = np.concatenate([score(texts[k : k + 256], (m.span,))[:, 0] for k in range(0, len(texts), 256)]) if texts else np.zeros(0)
            yield pdf.assign(**{column: m.probability(value)})

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes) + f", `{column}` double"
    return mapped(docs.select(*rest), run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the rows that may be learnt from: those whose crc32(doc_id as text) mod 4 is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def fitted(spark, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    return fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels", "doc_id", "toxic")))
