"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: No piece of a word-boundary vocabulary has its boundary mark or a blank after another character, or holds a line feed, so no merge
#: crosses the start of a run of blanks or a line feed, and a text's pieces are those of its pre-tokens in turn.
PRE_TOKEN = re.compile("[ ▁]+[^ ▁\n]*|[^ ▁\n]+|\n+")
#: Pre-tokens with more characters are known by a 128-bit digest after a line feed, which no pre-token with other characters holds.
LONG = 40


def frequencies(text: str | None) -> Counter:
    """How often a text has each pre-token; a blank comes before the first, as the model puts one there."""
    return Counter(PRE_TOKEN.findall(f" {text}")) if text else Counter()


def key_of(token: str) -> str:
    return token if len(token) <= LONG else "\n" + xxhash.xxh3_128_hexdigest(token.encode("utf-8", "surrogatepass"))


class PieceCounter:
    """Pieces of pre-tokens."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        assert not any(re.search("[^▁]▁|▁▁+[^▁]|[ \n]", p) for p in pieces), "pieces cross pre-tokens"
        self.edge = len(self.model.encode("\n"))

    def __call__(self, tokens: list[str]) -> list[int]:
        """The model itself puts a blank before what it encodes: one of the token's own is left out, or a line feed set in between."""
        inner = [t[0] in " ▁" for t in tokens]
        encoded = self.model.encode([t[1:] if own else "\n" + t for t, own in zip(tokens, inner, strict=True)], num_threads=1) if tokens else []
        return [(len(ids) if len(t) > 1 else 1) if own else len(ids) - self.edge for t, own, ids in zip(tokens, inner, encoded, strict=True)]


def vocabulary(docs: DataFrame, model: str, held: int = 400_000) -> DataFrame:
    """``(key, n, pieces)`` for every distinct pre-token of all ``docs``: how often it occurs, and its pieces, counted once."""

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(counts: Counter) -> pd.DataFrame:
            rows = [(key_of(t), t if len(t) > LONG else None, n) for t, n in counts.items()]
            return pd.DataFrame(rows, columns=["key", "token", "n"])

        counts: Counter[str] = Counter()
        for pdf in frames:
            for text in pdf["text"]:
                counts.update(frequencies(text))
                if len(counts) >= held:
                    yield table(counts)
                    counts.clear()
        yield table(counts)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(model)
        for pdf in frames:
            tokens = pdf.pop("token")
            yield pdf.assign(pieces=counter(pdf["key"].where(tokens.isna(), tokens).tolist()))

    sums = mapped(docs.select("text"), tally, "key string, token string, n long").groupBy("key", "token").agg(F.sum("n").alias("n"))
    return written(mapped(sums, count, "key string, n long, pieces long"))


def most_frequent(table: DataFrame, rows: int) -> DataFrame:
    """The most frequent pre-tokens, at most ``rows``: all those that occur as often as some power of 2 ** (1 / 8) or more."""
    level = F.floor(F.log2("n") * 8).cast("int")
    left, least = rows, 1 << 20
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 512 levels
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    return table.where(level >= least)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, broadcast_rows: int = 250_000) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``, from whole texts; no ids of a document are made.

    All distinct pre-tokens of the corpus, summed map-side first, make a table of piece counts. The most frequent ones, at most
    ``broadcast_rows`` and each a short key, are broadcast and meet the documents' pre-token frequencies where these are made; the frequencies of all
    rarer ones are joined to the table in a shuffle and added. A null or empty text has 0 bytes and 0 tokens; repeated rows give
    repeated results; further columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = vocabulary(docs, model)
    top = most_frequent(table, broadcast_rows).select("key", "pieces").toPandas()
    shipped = docs.sparkSession.sparkContext.broadcast(dict(zip(top["key"], top["pieces"].tolist(), strict=True)))
    del top

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for pdf in frames:
            for part in (pdf.iloc[a : a + 512] for a in range(0, len(pdf), 512)):
                rows = []
                for doc, text in zip(part["doc_id"].array, part["text"], strict=True):
                    own = frequencies(text)
                    met = {t: k for t in own if (k := known.get(t if len(t) <= LONG else key_of(t))) is not None}
                    rest = [t for t in own if t not in met] if len(met) < len(own) else []
                    rows.append((doc, len(text.encode()) if text else 0, sum(k * own[t] for t, k in met.items()), [key_of(t) for t in rest], [own[t] for t in rest]))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "met", "rest", "times"])

    rows = mapped(docs, meet, "doc_id long, n_bytes long, met long, rest array<string>, times array<int>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("key"), "r.times")
    rest = rest.join(table.hint("merge"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    counted = rows.drop("rest", "times").join(rest, "row", "left").withColumn("n_tokens", F.col("met") + F.coalesce("others", F.lit(0)))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
