"""Every stage of the corpus pipeline on planted rows, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from test_llm import brute, prose

import corpus_pipeline
from roadloom.llm import decontamination, jaccard_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, tag string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(8)
    shared, item = prose(900, 60), prose(901, 30)
    insult = lambda: " ".join(r.choice(["slimeball", "dunderhead", "nitwitted"]) for _ in range(4))
    texts = [(k, prose(1000 + k, 60)) for k in range(120)]
    texts += [(200 + k, f"{prose(1200 + k, 25)} {insult()} {prose(1300 + k, 25)}") for k in range(60)]
    base = prose(902, 150).split()
    texts += [(300 + k, " ".join([*base[: 7 * k + 1], f"edit{k}", *base[7 * k + 1 :]])) for k in range(6)] + [(310, " ".join(base))]
    texts += [(320, prose(903, 40)), (320, prose(904, 40)), (321, prose(903, 40)), (None, prose(904, 40)), (None, prose(905, 40)), (322, prose(906, 40)), (322, prose(906, 40))]
    texts += [(400 + k, f"{prose(1400 + k, 20)} {shared} {prose(1500 + k, 20)}") for k in range(4)]
    edited = item.split()
    edited[9] = "other"
    texts += [(500, f"{prose(907, 40)} {item}"), (501, f"{' '.join(edited)} {prose(908, 40)}")]
    texts += [(600, None), (601, ""), (601, ""), (602, prose(909, 9000))]
    rows = [(k, t, "en", "s", len(t) if t is not None else None, None, "x") for k, t in texts]
    labels = [(k, int(200 <= k < 260)) for k, _ in texts if k is not None and k < 260]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_drop_toxic(spark, sf_dir):
    docs = documents(spark, sf_dir)
    left = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert left.dtypes == docs.dtypes
    toxic = lambda t: any(w in (t or "") for w in ("slimeball", "dunderhead", "nitwitted"))
    assert rows_of(left) == Counter({k: n for k, n in rows_of(docs).items() if not toxic(k[1])})


def test_drop_near_duplicates(spark, sf_dir):
    """One row of each class of similar texts stays, rows without words all stay; a doc_id that names two texts keeps both."""
    docs = documents(spark, sf_dir)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert left.dtypes == docs.dtypes
    every = rows_of(docs)
    texts = sorted({t for _, t in every if t})
    sets = [set(jaccard_join.shingles(t, 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for (k, t), _ in every.items():
        if t:
            g = group[texts.index(t)]
            first[g] = min(first.get(g, (True, 0)), (k is None, k or 0))
    got = rows_of(left)
    assert sum(n for (_, t), n in got.items() if t) == len(first) and all(n == 1 for (_, t), n in got.items() if t)
    assert {group[texts.index(t)]: (k is None, k or 0) for k, t in got if t} == first
    assert Counter({k: n for k, n in got.items() if not k[1]}) == Counter({k: n for k, n in every.items() if not k[1]})


def test_cut_repeats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    cut = corpus_pipeline.cut_repeats(spark, docs, sf_dir)
    assert cut.dtypes == docs.dtypes
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = [(t or "").split() for _, t in rows]
    want = Counter()
    for (k, t), w, gone in zip(rows, words, brute(words, 35), strict=True):
        want[k, " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t] += 1
    assert rows_of(cut) == want and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cut.collect())


def test_drop_leaks(spark, sf_dir):
    docs = documents(spark, sf_dir)
    left = corpus_pipeline.drop_leaks(spark, docs, sf_dir)
    assert left.dtypes == docs.dtypes
    item = decontamination.normal_words(prose(901, 30))
    numbers = {}
    code = lambda ws: np.array([numbers.setdefault(w, len(numbers) + 1) for w in ws], np.int64)
    target = code(item)
    leaks = lambda t: decontamination.smith_waterman(target, code(decontamination.normal_words(t)))[0] >= 0.6 * len(item) - 1e-9
    gone = {k for k, _ in rows_of(docs) if k in (500, 501)}
    assert rows_of(left) == Counter({k: n for k, n in rows_of(docs).items() if not leaks(k[1])}) and gone == {500, 501}


def test_pack_sequences(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = corpus_pipeline.pack_sequences(spark, docs, sf_dir).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got[got["piece"] == 0]) == docs.count()
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all() and got.groupby("sequence_id")["length"].sum().max() <= 4096


def test_run(spark, sf_dir):
    """All stages: the pieces are those of the documents that the stages leave, one after the other."""
    docs = documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    kept = docs.count()
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert kept < documents(spark, sf_dir).count() - 60 and len(out[out["piece"] == 0]) == kept


def test_empty_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
