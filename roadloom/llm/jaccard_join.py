"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until buckets are small, in repeated runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, bounds, components, mapped, mix, whole_groups, written
from .repeats import Sums

#: Runs, levels below a run's first split, and splits made at each of them.
RUNS, LEVELS, BRANCHES = 10, 6, 2


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of a text's different ``n``-word sequences; the whole text's, if it has fewer words; none without words."""
    words = text.lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(Sums(hashes).all(min(n, len(words))))


SALTS = mix(np.arange(1, RUNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Places of the trees below the first split that have a token of their own; the levels after the second take other runs' ones.
FURTHER = RUNS * 2 * BRANCHES


def sampled(tokens: np.ndarray) -> np.ndarray:
    """For each place of the runs' trees a sampled token, equal in two sets with their Jaccard similarity as chance.

    The runs' first splits take the token with the smallest hash. The further ones share one hash: its residue deals the tokens out
    to the places, where the smallest stands; a place without a token takes the next one's.
    """
    out = np.empty(len(SALTS) + FURTHER, np.uint64)
    for k, salt in enumerate(SALTS):
        out[k] = mix(tokens ^ salt).min()
    h = mix(tokens + np.uint64(0x632BE59BD9B4E019))
    spots = np.full(FURTHER, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(spots, (h % np.uint64(FURTHER)).astype(np.int64), h)
    filled = np.flatnonzero(spots != np.iinfo(np.uint64).max)
    out[len(SALTS) :] = spots[filled[np.searchsorted(filled, np.arange(FURTHER)) % len(filled)]]
    return out


def _prints(docs: DataFrame, n: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (pdf.iloc[a : a + 256] for pdf in frames for a in range(0, len(pdf), 256)):
            rows = []
            for doc, tag, text in zip(part["doc_id"].array, part["tag"], part["text"], strict=True):
                s = shingles(text, n)
                if not len(s):
                    rows.append((doc, tag, 0, 0, 0, []))
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((doc, tag, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), len(s), sampled(s).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "tag", "one", "two", "n", "sample"])

    return mapped(docs, run, "doc_id long, tag long, one long, two long, n int, sample array<long>")


def _buckets(sets: DataFrame, limit: int) -> DataFrame:
    """``(bucket, rep, wide)``: final buckets of two sets or more. Wide ones were split on, until they held mostly alike sets or to the end."""
    runs = F.posexplode(F.slice("sample", 1, RUNS)).alias("run", "token")
    rows = sets.select("rep", runs).select(F.xxhash64("run", "token").alias("bucket"), "run", "rep")
    done = []
    for level in range(LEVELS + 1):
        rows = written(rows)
        sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")).hint("merge")
        done.append(rows.join(sizes.where(F.col("m") <= limit), "bucket").select("bucket", "rep", F.lit(False).alias("wide")))
        wide = written(rows.join(sizes.where(F.col("m") > limit), "bucket").select("bucket", "run", "rep", "m"))
        if wide.isEmpty():
            break
        if level == LEVELS:
            done.append(wide.select("bucket", "rep", F.lit(True).alias("wide")))
            break
        base = RUNS + level % 2 * RUNS * BRANCHES
        spots = F.explode(F.array(*[F.lit(b) for b in range(BRANCHES)])).alias("branch")
        tokens = sets.select("rep", F.slice("sample", base + 1, RUNS * BRANCHES).alias("own"))
        split = wide.select("bucket", "run", "rep", "m", spots).join(tokens.hint("merge"), "rep")
        token = F.element_at("own", (F.col("run") + level // 2) % RUNS * BRANCHES + F.col("branch") + 1)
        split = written(split.select("bucket", F.xxhash64("bucket", "branch", token).alias("child"), "run", "rep", "m"))
        # a bucket that a split leaves mostly whole holds sets that are alike: it is compared as it is
        most = split.groupBy("bucket", "child").agg(F.count("*").alias("c"), F.first("m").alias("m")).groupBy("bucket").agg(F.max("c").alias("c"), F.first("m").alias("m"))
        alike = written(most.where("c >= 0.6 * m").select("bucket", F.lit(True).alias("alike")))
        done.append(wide.join(alike, "bucket").select("bucket", "rep", F.lit(True).alias("wide")))
        rows = split.join(alike, "bucket", "left").where("alike is null").select(F.col("child").alias("bucket"), "run", "rep")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _useful(members: DataFrame, block: int = 20_000) -> DataFrame:
    """Narrow buckets less those whose members all share a smaller one, where every pair of theirs is met."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, "bucket", block):
            keys, paths, keep = pdf["bucket"].to_numpy(), pdf["paths"].tolist(), np.ones(len(pdf), bool)
            edges = bounds(keys)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                common = set(paths[a].tolist() if hasattr(paths[a], "tolist") else paths[a])
                for k in range(a + 1, b):
                    common.intersection_update(paths[k])
                keep[a:b] = min(common) >= keys[a]
            yield pdf.loc[keep, ["bucket", "rep"]]

    return mapped(members.repartition("bucket").sortWithinPartitions("bucket"), run, "bucket long, rep long")


def _compare(sets: list[np.ndarray], paths: list[np.ndarray], bucket: int, sides: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a Jaccard similarity of ``least`` or more that are met here: for whom ``bucket`` is the smallest in common.

    ``sides``: 0 and 1 for the two blocks of a wide bucket, of which only pairs across are met; 2 for one block.
    """
    m = len(sets)
    size = np.array(list(map(len, sets)))
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    by = np.argsort(token, kind="stable")
    owner_by, starts = owner[by], np.searchsorted(token[by], np.arange(len(tokens) + 1))
    edge = np.concatenate([[0], np.cumsum(size)])
    smaller = [set(p[p < bucket].tolist()) for p in paths]
    left, right = [], []
    for i in range(m):
        own = token[edge[i] : edge[i + 1]]
        if m == 2:
            if i:
                break
            shared = np.array([size[0], len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        else:
            shared = np.bincount(np.concatenate([owner_by[starts[t] : starts[t + 1]] for t in own]), minlength=m)
        ok = shared >= least * (size[i] + size - shared)
        ok[: i + 1] = False
        if sides[i] < 2:
            ok &= sides != sides[i]
        for j in np.flatnonzero(ok).tolist():
            if smaller[i].isdisjoint(smaller[j]):
                left.append(i)
                right.append(j)
    return np.array(left, np.int64), np.array(right, np.int64)


def jaccard_join(docs: DataFrame, n: int = 5, least: float = 0.8, limit: int = 400, chunk: int = 400) -> DataFrame:
    """``(doc_id, text_class, class_id, n_links, kept)``: documents whose ``n``-word shingle sets have a Jaccard similarity of ``least``.

    Documents with the same set are one text class (its smallest doc_id). ``n_links`` counts the other rows directly linked, copies
    included; ``class_id`` is the smallest doc_id reachable by links, ``kept`` marks one row of each class: of those with that doc_id,
    the one that ``one_of_each`` keeps (equal rows are marked alike). Words are split at white space, in lower case; a text of fewer
    than ``n`` words is one shingle; null and empty texts link with nothing and are kept; rows with a null doc_id take part, and a
    class of nothing else has null as its id; other columns are ignored; an empty table gives an empty result.

    A run puts two similar sets into one bucket with the chance ``least`` or more; ten runs miss a pair at the threshold once in
    ten million, or, where buckets are wide and split further by two tokens a level, about once in a million. Buckets of alike sets are
    compared in blocks. A pair met in several buckets counts in the smallest.
    """
    joined = classified(docs, n, least, limit, chunk)
    return joined.select("doc_id", "text_class", "class_id", "n_links", "kept")


def classified(docs: DataFrame, n: int = 5, least: float = 0.8, limit: int = 400, chunk: int = 400) -> DataFrame:
    """As ``jaccard_join``, with ``tag``, a hash of the row's text. Sets are numbered; the numbers stay as they are written once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tag", F.xxhash64("text"))
    prints = written(_prints(docs, n))
    whose = F.max(F.struct(F.bitwise_not("doc_id").alias("last"), "tag"))  # the smallest doc_id, if there is one
    sets = prints.where("n > 0").groupBy("one", "two").agg(whose.alias("whose"), F.count("*").alias("copies"), F.first("sample").alias("sample"))
    sets = written(sets.select("one", "two", F.bitwise_not("whose.last").alias("doc_id"), "whose.tag", "copies", "sample").withColumn("rep", F.monotonically_increasing_id()))
    buckets = written(_buckets(sets.select("rep", "sample"), limit).dropDuplicates(["bucket", "rep"]))
    paths = written(buckets.groupBy("rep").agg(F.sort_array(F.collect_list("bucket")).alias("paths")))
    narrow = _useful(buckets.where("not wide").join(paths.hint("merge"), "rep").select("bucket", "rep", "paths")).withColumn("wide", F.lit(False))
    met = written(narrow.unionByName(buckets.where("wide")))
    m = written(met.where("wide").groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    wide = met.where("wide").join(m, "bucket").withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    lo, hi = F.least("c", "o"), F.greatest("c", "o")
    wide = wide.select("bucket", "rep", "c", other).select(F.xxhash64("bucket", lo, hi).alias("g"), "bucket", "rep", F.when(lo == hi, 2).when(F.col("c") == lo, 0).otherwise(1).alias("side"))
    tasks = met.where("not wide").select(F.col("bucket").alias("g"), "bucket", "rep", F.lit(2).alias("side")).unionByName(wide)
    asked = tasks.groupBy("rep").agg(F.collect_list(F.struct("g", "bucket", "side")).alias("tasks")).join(paths, "rep")
    owners = sets.join(asked, "rep").select(F.coalesce("doc_id", "tag").alias("key"), "tag", "rep", "one", "two", "copies", "tasks", "paths")

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for text, rep, one, two, copies, tasks, paths in zip(pdf["text"], pdf["rep"], pdf["one"], pdf["two"], pdf["copies"], pdf["tasks"], pdf["paths"], strict=True):
                s = shingles(text, n)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                if ((d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)) == (one, two):  # else another text of that hash
                    data = s.tobytes()
                    rows += [(t["g"], t["bucket"], t["side"], rep, copies, np.asarray(paths, np.int64).tobytes(), data) for t in tasks]
            yield pd.DataFrame(rows, columns=["g", "bucket", "side", "rep", "copies", "paths", "tokens"])

    keyed = docs.select(F.coalesce("doc_id", "tag").alias("key"), "tag", "text").join(owners.hint("merge"), ["key", "tag"])
    shipped = mapped(keyed.select("text", "rep", "one", "two", "copies", "tasks", "paths"), sets_of, "g long, bucket long, side int, rep long, copies long, paths binary, tokens binary")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, "g", 4_000_000, lambda p: int(p["tokens"].str.len().sum())):
            rows = []
            edges = bounds(pdf["g"].to_numpy())
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = pdf.iloc[a:b].drop_duplicates("rep")
                if len(own) < 2:
                    continue
                rep, copies = own["rep"].to_numpy(), own["copies"].to_numpy()
                tokens = [np.frombuffer(x, np.uint64) for x in own["tokens"]]
                left, right = _compare(tokens, [np.frombuffer(x, np.int64) for x in own["paths"]], int(own["bucket"].iloc[0]), own["side"].to_numpy(), least)
                if not len(left):
                    continue
                links = np.bincount(left, copies[right], len(own)) + np.bincount(right, copies[left], len(own))
                forest = Forest(len(own))
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    forest.join(i, j)
                rows += [(int(rep[k]), int(links[k]), int(rep[forest.root(k)])) for k in np.flatnonzero(links).tolist()]
            yield pd.DataFrame(rows, columns=["rep", "links", "to"])

    found = written(mapped(shipped.repartition("g").sortWithinPartitions("g"), meet, "rep long, links long, to long"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_set = sets.drop("sample").join(links.hint("merge"), "rep", "left").join(classes.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    by_set = written(by_set.withColumn("class", F.coalesce("component", "rep")))
    firsts = by_set.groupBy("class").agg(F.max(F.struct(F.bitwise_not("doc_id").alias("last"), "tag")).alias("f"))
    firsts = firsts.select("class", F.bitwise_not("f.last").alias("class_id"), F.col("f.tag").alias("first_tag"))
    text_class, links = F.col("doc_id").alias("text_class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    by_set = written(by_set.join(firsts.hint("merge"), "class").select("one", "two", text_class, links, "class_id", "first_tag"))
    joined = prints.drop("sample").withColumn("has", F.when(F.col("n") > 0, True)).join(by_set.withColumn("has", F.lit(True)), ["one", "two", "has"], "left")
    alone = F.col("has").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("tag").eqNullSafe(F.col("first_tag")))
    return joined.select("doc_id", "tag", F.when(alone, F.col("doc_id")).otherwise(F.col("text_class")).alias("text_class"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"), alone.alias("alone"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, the first of those with its smallest doc_id; of equal rows one. Rows without words all stay."""
    rest = docs.columns
    own = docs.withColumn("_tag", F.xxhash64("text"))
    own = own.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.col("_tag")))
    stay = classified(docs).where("kept").select(F.coalesce("doc_id", "tag").alias("_key"), F.col("tag").alias("_tag"), "alone").distinct()
    left = own.join(stay.hint("merge"), ["_key", "_tag"])
    return left.where("not alone").dropDuplicates(["_key", "_tag"]).select(*rest).unionByName(left.where("alone").select(*rest))
