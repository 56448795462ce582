import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import chat, decontamination, html_blocks, html_extraction, jaccard_join, metric_join, packing, substring_dedup, suffix_dedup, token_counts, toxicity
from roadloom.llm.common import components
from roadloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, tag string, n_words long, score double"


def docs_of(spark, texts):
    """Rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(k, t, "x", 7, None) for k, t in texts], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["la", "mi", "so", "fa", "re"]) + r.choice(["ta", "no", "ki", "pu"]) + r.choice(["", "s", "n", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    shared = prose(1, 60)
    out = [(0, None), (1, ""), (2, "one"), (3, f"{prose(2, 80)} {shared} {prose(3, 20)}"), (4, f"{prose(4, 10)} {shared}"), (5, prose(5, 90)), (6, prose(5, 90)), (6, prose(5, 90)), (7, "ab " * 300), (8, "é" * 500), (9, prose(6, 5000) + " " + shared)]
    return out + [(100 + k, f"{prose(50 + k, 12)} {shared} {prose(90 + k, 12)}") for k in range(30)]


def brute(parts, width):
    """Which items of each sequence a repeated window covers."""
    seen = Counter(tuple(p[i : i + width]) for p in parts for i in range(len(p) - width + 1))
    out = []
    for p in parts:
        gone = [False] * len(p)
        for i in range(len(p) - width + 1):
            if seen[tuple(p[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


@pytest.mark.parametrize("limit", [200, 5])
def test_substring_dedup(spark, corpus, limit, monkeypatch):
    monkeypatch.setattr(substring_dedup.WindowRepeats.__init__, "__defaults__", (limit, 100_000))
    got = substring_dedup.substring_dedup(docs_of(spark, corpus)).collect()
    words = [(t or "").split() for _, t in corpus]
    want = sorted((k, len(w), " ".join(x for x, g in zip(w, gone) if not g)) for (k, _), w, gone in zip(corpus, words, brute(words, 35)))
    assert sorted((r.doc_id, r.n_words, r.kept) for r in got) == want


@pytest.mark.parametrize("limit", [200, 5])
def test_suffix_dedup(spark, corpus, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup.WindowRepeats.__init__, "__defaults__", (limit, 100_000))
    got = suffix_dedup.suffix_dedup(docs_of(spark, corpus)).collect()
    data = [(t or "").encode() for _, t in corpus]
    want = sorted((k, len(d), bytes(b for b, g in zip(d, gone) if not g)) for (k, _), d, gone in zip(corpus, data, brute(data, 200)))
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == want


def test_window_kernels():
    r = random.Random(3)
    for _ in range(200):
        width, letters = r.choice([3, 5, 8]), r.choice(["ab", "abc", "a"])
        counts = [r.randint(1, 12) for _ in range(r.randint(1, 6))]
        segments = ["".join(r.choice(letters) for _ in range(c + width - 1)).encode() for c in counts]
        copies = np.array([r.choice([1, 1, 2]) for _ in counts])
        seen = Counter()
        for s, c, n in zip(segments, counts, copies):
            for i in range(c):
                seen[s[i : i + width]] += n
        want = [[seen[s[i : i + width]] > 1 for i in range(c)] for s, c in zip(segments, counts)]
        groups = np.zeros(len(counts), int)
        assert [x.tolist() for x in suffix_dedup.repeated_windows(segments, counts, copies, width, groups)] == want
        parts = [[bytes([x]) for x in s] for s in segments]
        assert [x.tolist() for x in substring_dedup.parsed_windows(parts, counts, copies, width, groups, 2)] == want


@pytest.mark.parametrize("rows", [250_000, 3, 0])
def test_token_counts(spark, corpus, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = corpus + [(200, " a\n\n  b\t▁c▁ </s>　"), (201, "x" * 4000)]
    got = token_counts.token_counts(docs_of(spark, texts), tokenizer_path("piece_bpe_32k.model"), broadcast_rows=rows).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((k, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for k, t in texts)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = corpus + [(300, "a.b, c.. <|endoftext|>. it's, x Don't."), (301, prose(9, 6000))]
    got = packing.pack_documents(docs_of(spark, texts), tokenizer_path("word_bpe_49k.json")).toPandas()
    want = []
    for k, t in texts:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(k, p, p * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for p in range(-(-len(ids) // 4096)) for part in (ids[4096 * p : 4096 * p + 4096],)]
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096


def test_packing_tasks_leave_no_cache(spark, monkeypatch):
    import gc

    import pandas as pd
    from pyspark import cloudpickle

    tasks = []
    monkeypatch.setattr(packing, "mapped", lambda df, run, schema: tasks.append(cloudpickle.dumps(run)))
    packing.tokenized_pieces(docs_of(spark, [(1, "a")]), tokenizer_path("word_bpe_49k.json"), 4096, 1)
    run = cloudpickle.loads(tasks[0])  # as a worker gets it, and holds it while the task gives memory back
    assert len(pd.concat(run(iter([pd.DataFrame({"doc_id": [1, 2], "text": ["some words", None]})])))) == 2
    gc.collect()
    assert not any(isinstance(x, packing.WordEncoder) for x in gc.get_objects())


def test_word_ids_are_the_tokenizers():
    encode = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"), cached=500, group=7)
    bits = ["a", "B", "é", "É", "Über", " ", "  ", "\n", "\t", ".", "'", "'s", "'S", "'re", "W\u030a", "\u0301", "İ", "Σ", "<|endoftext|>", "<|", "<|ENDOFTEXT|>", "\x1c", "\xa0", "\u3000", "漢", "1", "½", "µ", "×", "_", "!?", "🙂", "x\u0338", "\x00"]
    for seed in range(300):
        r = random.Random(seed)
        texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(10)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(texts)] == [encode.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_plan_equals_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(100):
        capacity = r.randint(5, 40)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        bins = []
        for s in sorted(sizes, reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= s), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(capacity - s)
            else:
                bins[fit] -= s
        plan = packing.best_fit_plan(Counter(sizes), capacity)
        assert 1 + max((b for _, _, _, b, _ in plan), default=-1) <= len(bins) + 0 if not sizes else True
        used = set()
        for (length, first, each, base, _), last in zip(plan, [None] * len(plan)):
            nexts = [p[1] for p in plan if p[0] == length and p[1] > first]
            n = (min(nexts) if nexts else Counter(sizes)[length]) - first
            used |= {base + k // each for k in range(n)}
        assert len(used) == len(bins)


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", hard), (-1, 1, "assistant", hard), (1, 0, "us\ner\\", "a\\<|b\\\\"), (1, 1, "user", None), (2, None, "assistant", ""), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (3, 2, None, "tail"), (None, 0, "assistant", "n")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.chat_examples(turns)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_jaccard_join(spark):
    base = [prose(k, 120) for k in range(4)]
    texts = [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for k, b in enumerate(base):
        words = b.split()
        for j in range(12):
            w = list(words)
            if j:
                w[(7 * j + k) % 120] = f"edit{j}"
            texts.append((10 + 20 * k + j, " ".join(w)))
        texts.append((10 + 20 * k + 15, b))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs_of(spark, texts), limit=4, chunk=5).collect()}
    sets = {k: set(jaccard_join.shingles(t, 5).tolist()) for k, t in texts}
    links = {a: {b for b in sets if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in sets}
    for a in sets:
        reach, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert (got[a].n_links, got[a].class_id, got[a].kept) == (len(links[a]), min(reach), a == min(reach))


def reachable(links):
    """The members of each node's component."""
    out = {}
    for a in links:
        reach, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        out[a] = reach
    return out


@pytest.mark.parametrize("chunk_rows", [None, 4, 16])
def test_metric_join(spark, chunk_rows):
    r = np.random.RandomState(0)
    x = r.randn(60, 8)
    hot = x[7] + 0.02 * r.randn(40, 8)
    chain = np.stack([np.cos(np.arange(12) * 0.3), np.sin(np.arange(12) * 0.3), *np.zeros((6, 12))], 1)
    x = np.vstack([x, x[:30] + 0.05 * r.randn(30, 8), x[:5], hot, chain])
    vectors = {k: v for k, v in enumerate(x)}
    vectors |= {300: np.array([1.0, 0.0, 0.0]), 301: np.array([1.0, 0.01, 0.0]), 302: np.array([3.0, 4.0]), 303: np.array([1e200, 1e200, 0]), 304: np.array([1.0, 1.0, 0.01])}
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [])]
    rows = [(k, v.tolist(), 1) for k, v in vectors.items()] + [(k, v, 1) for k, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {g.vec_id: g for g in metric_join.metric_join(df, chunk_rows=chunk_rows).collect()}
    unit = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, v in vectors.items()}
    links = {a: {b for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95} for a in unit}
    assert len(got) == len(rows) and max(map(len, links.values())) > 35
    for a, reach in reachable(links).items():
        assert (got[a].n_links, got[a].component_id, got[a].kept) == (len(links[a]), min(reach), a == min(reach))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(200, 205))


def test_metric_join_of_repeated_ids(spark):
    """Rows that repeat a vec_id are vectors of their own; rows without one take part."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    got = metric_join.metric_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == Counter([(1, 3, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 3, 1, False), (None, 0, None, True), (3, 3, 1, False), (3, 3, 1, False)])


def test_leaks(spark):
    item = prose(70, 40)
    edited = item.split()
    for k in (5, 17, 29):
        edited[k] = "other"
    del edited[33]
    texts = [(0, None), (1, ""), (2, f"{prose(71, 50)} {item.upper()} {prose(72, 50)}"), (3, f"{prose(73, 50)} {' '.join(edited)}"), (4, prose(74, 400)), (4, prose(74, 400))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, texts), bench).collect()) == [(2, 1), (3, 1)]
    assert decontamination.leaks(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_leaks_of_edited_copies(spark):
    """Seeds find what brute-force alignment of every item with every document finds, with and without clean copies beside."""
    lengths = [3, 5, 8, 10, 11, 20, 40, 60]
    items = {k: prose(300 + k, n).split() for k, n in enumerate(lengths)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    for clean in (False, True):
        texts = []
        for k, w in items.items():
            for every in (2, 3, 4, 5, 6, 7):
                for shift in range(0, every, 2):
                    swapped = ["zz" if j % every == shift else x for j, x in enumerate(w)]
                    longer = [y for j, x in enumerate(w) for y in ([x, "zz"] if j % every == shift else [x])]
                    texts += [" ".join(["yy"] * 90 + c + ["xx"] * 90) for c in (swapped, longer)]
            texts += [" ".join(w)] * 3 if clean else []
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, list(enumerate(texts))), bench).collect()}
        numbers = {w: n for n, w in enumerate(sorted({x for t in texts for x in t.split()} | {x for w in items.values() for x in w}))}
        coded = {k: np.array([numbers[x] for x in w]) for k, w in items.items()}
        want = {(d, k) for d, t in enumerate(texts) for k, w in coded.items() if decontamination.smith_waterman(w, np.array([numbers[x] for x in t.split()]))[0] >= 0.6 * len(w) - 1e-9}
        assert got == want and len({k for _, k in want}) == len(items)


def test_leak_with_a_repeated_seed():
    """A seed that the item holds twice, far apart, opens the span of its later place too."""
    words = [f"w{k}" for k in range(40)]
    words[37:] = words[:3]
    items = decontamination.Items([(1, " ".join(words))], 3, 0.6)
    numbers = items.numbers(" ".join(["yy"] * 90 + [words[0], "zz", *words[2:]] + ["xx"] * 90))
    seed = int(items.grams(items.words[0], 3)[0])
    assert decontamination.alignments(items, {seed}, numbers)[0][1] == 38 / 40


def test_toxicity_held_out(spark):
    r = random.Random(5)
    rows = [(k, prose(1000 + k, 60) + (" " + " ".join(r.choice(["slimeball", "dunderhead", "nitwitted"]) for _ in range(3)) if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(240)]
    docs = docs_of(spark, [(k, t) for k, t, _ in rows] + [(999, None), (998, "")])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows[:180]] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = {g.doc_id: g.score for g in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert all((got[k] >= 0.3) == bool(y) for k, _, y in rows[180:]) and got[999] == got[998] < 0.3
    none = toxicity.fit_toxicity(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def kneser_ney(counts, top, discounts, below=None, low=0):
    """Brute-force interpolated Kneser-Ney over words with counts: ``p(gram)`` for grams, as strings padded with 0, of up to ``top``."""
    grams = {top: Counter()}
    for w, n in counts.items():
        s = "\0" * top + f" {w} "
        for end in range(top + 2, len(s) + 1):
            grams[top][s[end - top : end]] += n
    for k in range(top - 1, low, -1):
        kinds = {g[-(k + 1) :] for g in grams[k + 1]}
        grams[k] = Counter()
        for g in kinds:
            starts = k > 1 and g[1] in "\0 "
            grams[k][g[1:]] += grams[k + 1][g] if starts else 1
    for k in range(top - 1, low, -1):  # a gram that starts a word has one predecessor, whose own count it takes
        assert sum(grams[k].values()) > 0

    def p(gram):
        k = len(gram)
        if k == low:
            return below(gram) if below else None
        after = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        d = discounts(k, grams[k]) if k > 1 or below else 0.0
        own = max(grams[k].get(gram, 0) - d, 0) / sum(after.values())
        if not d:
            return own
        return own + sum(min(n, d) for n in after.values()) / sum(after.values()) * p(gram[1:])

    return p


def test_shared_counts(spark):
    """Counts of all documents are exact, also with more different grams than any fixed table holds."""
    r = random.Random(9)
    texts = [" ".join("".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(5)) for _ in range(60)) for _ in range(300)] + ["ab abc \U0010ffff", "Ab\nabc", None, ""]
    docs = docs_of(spark, list(enumerate(texts)))
    order = toxicity.SHARED_ORDER
    want = Counter()
    for w in (f" {x} " for t in texts if t for x in t.lower().split()):
        for end in range(2, len(w) + 1):
            code = sum((ord(c) + 1) << 21 * k for k, c in enumerate(reversed(w[max(0, end - order) : end])))
            want[code >> 63, code & (1 << 63) - 1] += 1
    got = {(x.high, x.low): x.n for x in toxicity.shared_counts(docs, held=1000).collect()}
    assert got == want and len(want) > 1 << 16


def test_kneser_ney_against_brute_force(spark):
    """The shared probabilities and both class models' log ratios, on a toy corpus."""
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(30)) for _ in range(12)]
    docs = docs_of(spark, list(enumerate(texts)))
    fit = docs.where("doc_id < 6").select("text", (F.col("doc_id") < 3).cast("int").alias("toxic"))
    table = toxicity.class_grams(fit, held=20)
    shared = toxicity.shared_model(docs, table)
    words = Counter(w for t in texts for w in t.split())
    top = toxicity.SHARED_ORDER
    below = kneser_ney(words, top, lambda k, _: toxicity.DISCOUNT)
    fit_words = Counter(w for t in texts[:6] for w in t.split())

    def grams(word, k):
        s = "\0" * k + f" {word} "
        return [s[end - k : end] for end in range(k + 2, len(s) + 1)]

    def packed(gram):
        code = sum(((ord(c) + 1) if c != "\0" else 0) << 21 * k for k, c in enumerate(reversed(gram)))
        return code >> 63, code & (1 << 63) - 1

    got = {(x.high, x.low): x.p for x in shared.itertuples()}
    wanted = {g for w in fit_words for g in grams(w, top)}
    assert got.keys() == {packed(g) for g in wanted} and all(got[packed(g)] == pytest.approx(below(g)) for g in wanted)
    assert sum(below(" ab" + c) for c in "abc ") == pytest.approx(1)
    classes = [Counter(w for t in part for w in t.split()) for part in (texts[:3], texts[3:6])]

    def discounts(k, counts):
        ones, twos = (sum(n == x for n in counts.values()) for x in (1, 2))
        return min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))

    models = [kneser_ney(c, toxicity.ORDERS[-1], discounts, below, top) for c in classes]
    every = sorted(fit_words)
    pair = toxicity.KneserNeyPair(table.toPandas(), shared)
    seen = [w for w in every if all(g in wanted for g in grams(w, top))]
    want = [sum(np.log(models[0](g) / models[1](g)) for g in grams(w, toxicity.ORDERS[-1])) for w in seen]
    assert np.allclose(pair.log_ratios(seen), want, atol=1e-4)


def test_passages():
    value = np.array([1.0, -1.0, 3.0, 3.0, -5.0])
    assert toxicity.likeliest(value, 2) == 3.0 and toxicity.likeliest(value, 0) == pytest.approx(0.2) and toxicity.likeliest(value[:0], 2) == 0.0
    assert toxicity.likeliest(value[:1], 2) == 0.5


def test_toxicity_keeps_class_shares(spark, monkeypatch):
    """The rows of the curve weigh what each class has in the labels, also where one class is cut."""
    docs = docs_of(spark, [(k, prose(2000 + k, 30) + (" slimeball dunderhead" if k % 10 == 0 else "")) for k in range(200)])
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(200)], "doc_id long, toxic int")
    seen = []
    own = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda *a: seen.append(a) or own(*a))
    toxicity.fit_toxicity(docs, labels, max_rows=30)
    _, label, weight = seen[0]
    assert set(weight[label == 0]) == {6.0} and set(weight[label == 1]) == {1.0}
    value, y = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 1, 0, 1])
    times = np.array([3, 1, 3, 1])
    repeated = own(np.repeat(value, times), np.repeat(y, times), np.ones(8))
    assert np.allclose(own(value, y, times.astype(float)), repeated, atol=0.05)


def test_html(spark):
    model = html_extraction.labeller()
    wrong = total = 0
    for seed in range(9_000_000, 9_000_100):
        blocks, label = html_blocks.PageMaker(seed).page()
        if blocks:
            wrong += int(((model.chances([html_extraction.features(blocks)])[0] >= 0.5) != label.astype(bool)).sum())
            total += len(label)
    assert wrong <= 0.01 * total
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a>x</a></li></ul></nav><article><h1>A &amp;amp; B</h1><p>one\n two<br><p><b>three</article><footer>&copy; me</footer>"
    rows = [(1, "u", page, "z"), (2, "u", None, "z"), (3, None, "", "z"), (4, "u", "<", "z")]
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1] == "A &amp; B\none two\nthree" and got[2] == got[3] == ""


#: Pages in hand-written markup with their main text.
PAGES = [
    ("<html><head><title>x</title><p>lost text</p></html>", "lost text"),
    ("<html><head><title>x</title>bare text", "bare text"),
    ("<title>t</title><meta charset=utf-8><article><h1>One</h1><p>two</article>", "One\ntwo"),
    ("<body><article><p>a<template><p>never</p></template> b</p><p>c</p></article></body>", "a b\nc"),
    ("<body><main><p>a<noscript><p>never</p></noscript> b</p></main></body>", "a b"),
    ("<body><article><p>See <svg><text>drawn</text></svg> this figure of words</p><svg><path><p>after the drawing</p></article></body>", "See this figure of words\nafter the drawing"),
    ("<nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><article><h1>Tides</h1><p>The sea rises twice a day.</p><ul><li>spring<li>neap</ul></article><footer>&copy; 2020</footer>", "Tides\nThe sea rises twice a day.\nspring\nneap"),
    ("<div class=cookie-banner><p>We use cookies.</p><button>OK</button></div><main><h1>Bread</h1><p>Flour &amp; water,\n salt.</p></main>", "Bread\nFlour & water, salt."),
    ("<header><div>The Daily</div></header><div class=sidebar><ul><li><a href=#>More</a></ul></div><article><h2>Rain</h2><p>It rained.</p></article>", "Rain\nIt rained."),
    ("<article><h1>Owls</h1><p>Owls hunt at night.</p></article><section class=comments><h3>Comments</h3><div class=comment><span>Ann</span><p>Nice owls!</p></div></section>", "Owls\nOwls hunt at night."),
    ("<article><p>First part.</p><div class=ad>Buy now</div><p>Second part.</p></article>", "First part.\nSecond part."),
    ("<form><label>Mail</label><input><button>Send</button></form><article><p>Body of it.</p></article><aside><h3>Related</h3><ul><li><a href=#>Other</a></ul></aside>", "Body of it."),
    ("<article><h1>T</h1><table><tr><td>a<td>b<tr><td>c<td>d</table><blockquote>said so</blockquote></article><footer><p>imprint</p></footer>", "T\na\nb\nc\nd\nsaid so"),
    ("<div id=content><h1>Plain</h1><p>One.</p><p>Two &#8211; three&hellip;</p></div><div class=footer><p>All rights</p></div>", "Plain\nOne.\nTwo \u2013 three\u2026"),
]


def test_html_pages(spark):
    rows = [(k, "u", html) for k, (html, _) in enumerate(PAGES)] * 2 + [(None, None, PAGES[0][0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text) for r in html_extraction.extract_main_text(df).collect()]
    assert sorted(g for g in got if g[0] is not None) == sorted([(k, t) for k, (_, t) in enumerate(PAGES)] * 2) and (None, PAGES[0][1]) in got
    assert html_extraction.extract_main_text(df.limit(0)).count() == 0


def test_html_of_a_very_long_page():
    html = "<article>" + "<p>some words here</p>" * 30_000 + "</article>"
    assert html_extraction.main_texts(["<p>x", html, None], html_extraction.labeller())[1].count("\n") == 29_999


def test_labels_do_not_depend_on_the_batch():
    model = html_extraction.labeller()
    pages = [p for p in (html_blocks.PageMaker(s).page()[0] for s in range(8_000_000, 8_000_012)) if p]
    alone = [model.chances([html_extraction.features(p)])[0] for p in pages]
    for a, b in zip(alone, model.chances([html_extraction.features(p) for p in pages]), strict=True):
        assert np.allclose(a, b)


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "a")]).limit(0)
    assert substring_dedup.substring_dedup(none).count() == suffix_dedup.suffix_dedup(none).count() == jaccard_join.jaccard_join(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert token_counts.token_counts(none, tokenizer_path("piece_bpe_32k.model")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_join.metric_join(vectors).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(90, 80), (80, 70), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 70: 70, 80: 70, 90: 70}
