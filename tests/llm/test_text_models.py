import math
import random
import zlib

import numpy as np
import pytest

from siftwell.llm import language, toxicity


def _gradient_check(name):
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(1).items()}
    features = toxicity.Features.of(["hello", "a", "", "world!"])
    rows = rng.integers(0, 4, (3, 5))

    def loss():
        return float(toxicity.forward(p, toxicity.gates(p, features.vectors(p)), rows)[0].sum())

    vectors = features.vectors(p)
    tab = toxicity.gates(p, vectors)
    out, trace = toxicity.forward(p, tab, rows, keep=True)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    d_table = np.zeros_like(tab)
    toxicity.backward(p, rows, trace, np.ones(len(out)), grads, d_table)
    grads["in"] += np.swapaxes(np.broadcast_to(vectors, (2, *vectors.shape)), 1, 2) @ d_table
    grads["in_bias"] += d_table.sum(1, keepdims=True)
    features.backward((d_table @ np.swapaxes(p["in"], 1, 2)).sum(0), grads)
    at = tuple(np.argwhere(np.abs(grads[name]) > 1e-6)[0])
    keep, eps = p[name][at], 1e-4
    p[name][at] = keep + eps
    high = loss()
    p[name][at] = keep - eps
    low = loss()
    p[name][at] = keep
    assert grads[name][at] == pytest.approx((high - low) / (2 * eps), rel=0.05, abs=2e-4)


@pytest.mark.parametrize("name", ["word", "char", "in", "in_bias", "state", "attend", "attend_out", "out"])
def test_gradients(name):
    _gradient_check(name)


def _labelled(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if i % 3 == 0:
            text[rng.randrange(len(text))] = rng.choice(["zgrub", "vexnok", "qwarl"]) + rng.choice(["", "s", "ed"])
        rows.append((" ".join(text), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = _labelled(500, 1)
    return toxicity.train([t for t, _ in rows], [y for _, y in rows], steps=200)


def test_unseen_texts_are_told_apart(model):
    rows = _labelled(200, 2)
    predicted = model.scores([t for t, _ in rows]) >= toxicity.THRESHOLD
    assert (predicted == np.array([y for _, y in rows], bool)).mean() > 0.9


def test_every_window_counts_and_batches_do_not_matter(model):
    clean = "aeiou lmn rst " * 200
    toxic = clean + "zgrub vexnok qwarl"
    alone = [model.scores([t])[0] for t in (clean, toxic, "", None)]
    assert alone[1] > alone[0] and alone[2] == alone[3]
    assert np.allclose(model.scores([clean, toxic, "", None, "a " * 40]).tolist()[:4], alone, atol=1e-5)
    assert toxicity.windows(100).tolist() == [0, 24, 48, 68] and toxicity.windows(3).tolist() == [0] and toxicity.windows(32).tolist() == [0]


def plain_score(model, text):
    """The score of one text, a number at a time."""
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    words = (text or "").lower().split() or [""]

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def vector(word):
        out = list(p["word"][zlib.crc32(word.strip(toxicity.PUNCTUATION).encode()) % toxicity.WORD_BUCKETS])
        codes = [ord(c) for c in f"\x02{word}\x03"]
        sums = [0.0] * toxicity.CHAR_DIM
        scale = 1 / math.sqrt(max(1, 2 * len(codes) - 5))
        for n in (3, 4):
            for i in range(len(codes) - n + 1):
                three = codes[i] * 7919 + codes[i + 1] * 104_729 + codes[i + 2] * 1_299_709
                at = three if n == 3 else three * 31 + codes[i + 3] * 15_485_863 + 17
                for k in range(toxicity.CHAR_DIM):
                    sums[k] += p["char"][at % toxicity.CHAR_BUCKETS][k] * scale
        return out + sums

    def states(vectors, d):
        h, out = [0.0] * toxicity.HIDDEN, []
        for x in vectors if d == 0 else vectors[::-1]:
            gate = [p["in_bias"][d][0][j] + sum(v * p["in"][d][i][j] for i, v in enumerate(x)) for j in range(3 * toxicity.HIDDEN)]
            u = [sum(v * p["state"][d][i][j] for i, v in enumerate(h)) for j in range(3 * toxicity.HIDDEN)]
            new = []
            for j in range(toxicity.HIDDEN):
                z, r = sigmoid(gate[j] + u[j]), sigmoid(gate[toxicity.HIDDEN + j] + u[toxicity.HIDDEN + j])
                c = math.tanh(gate[2 * toxicity.HIDDEN + j] + r * u[2 * toxicity.HIDDEN + j])
                new.append(z * h[j] + (1 - z) * c)
            h = new
            out.append(h)
        return out if d == 0 else out[::-1]

    best = -math.inf
    starts = [*range(0, max(0, len(words) - toxicity.SPAN), toxicity.SCORE_STRIDE), max(0, len(words) - toxicity.SPAN)]
    for start in starts:
        vectors = [vector(w) for w in words[start : start + toxicity.SPAN]]
        both = [a + b for a, b in zip(states(vectors, 0), states(vectors, 1), strict=True)]
        energy = [sum(math.tanh(p["attend_bias"][k] + sum(v * p["attend"][i][k] for i, v in enumerate(s))) * p["attend_out"][k] for k in range(toxicity.ATTEND)) for s in both]
        weights = [math.exp(e) for e in energy]
        pooled = [sum(w * s[i] for w, s in zip(weights, both, strict=True)) / sum(weights) for i in range(2 * toxicity.HIDDEN)]
        best = max(best, p["out_bias"][0] + sum(v * p["out"][i] for i, v in enumerate(pooled)))
    return sigmoid((best - model.centre) * model.scale + math.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD)))


def test_scores_against_plain_loops(model):
    texts = ["", None, "one", "Zgrub, vexnok!", "aeiou lmn rst " * 25, " ".join(t for t, _ in _labelled(4, 9))]
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=1e-4)


def test_long_texts_do_not_use_up_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * 5000 if i % 10 else f"short {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(2000)], "doc_id long, toxic int")
    seen = []
    train, toxicity.train = toxicity.train, lambda texts, truth: seen.extend(zip(texts, truth, strict=True))
    try:
        toxicity.fit(docs, labels, {1: 40, 0: 40})
    finally:
        toxicity.train = train
    assert len(seen) == 80 and all(len(t) < 20 for t, _ in seen)


def test_a_passage_counts_wherever_it_starts(model):
    clean, passage = "aeiou lmn rst".split() * 40, "lmn rst zgrub aeiou lmn vexnok rst lmn aeiou qwarl lmn rst zgrub lmn aeiou rst vexnok".split()
    texts = [" ".join([*clean[:i], *passage, *clean[i:]]) for i in range(len(clean) + 1)]
    n = len(clean) + len(passage)
    starts = next(toxicity._by_length([np.arange(n)], toxicity.SCORE_STRIDE))[1][:, 0]
    assert all(any(s <= i and i + len(passage) <= s + toxicity.SPAN for s in starts) for i in range(len(texts)))
    assert (model.scores(texts) >= toxicity.THRESHOLD).all()


def test_one_label_or_none():
    assert toxicity.train([], []).scores(["x"])[0] < toxicity.THRESHOLD
    assert toxicity.train(["a"], [0]).scores(["x"])[0] < toxicity.THRESHOLD
    assert toxicity.train(["a"], [1]).scores(["x"])[0] >= toxicity.THRESHOLD


def test_score_rows_and_stage(spark, model):
    docs = spark.createDataFrame([(1, "zgrub vexnok", 1.0), (2, "", 2.0), (3, None, 3.0), (None, "lmn", 4.0), (2, "", 2.0)], "doc_id long, text string, score double")
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 3)}
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 1 not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.keep_clean(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r["score"] for r in scored if r["toxic"]], [r["score"] for r in scored if not r["toxic"]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.8  # 29 toxic texts to learn from


def test_fit_never_sees_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 4 == 2)) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).scores(["text 1"])[0] < toxicity.THRESHOLD  # all labels it may see are 0


@pytest.fixture(scope="module")
def tongues():
    return language.train([("the cat sat on the mat and then it left", "en"), ("der hund und die katze sind nicht im haus", "de"), ("le chat est dans la maison avec nous", "fr")])


def brute_fusion(rows, model):
    """The same posterior with plain loops."""
    langs, out = model.languages, []
    n = len(langs)

    def soft(logs):
        e = np.exp(np.array(logs) - max(logs))
        return e / e.sum()

    texts = [model.likelihoods(r[1]) for r in rows]
    ps = [soft(t) if t.any() else None for t in texts]
    zero = np.zeros(n)
    level = lambda host, k: host.split(".")[-k:] if k else []

    def total(test):
        return sum((p for r, p in zip(rows, ps, strict=True) if p is not None and test(r)), zero)

    whole = total(lambda r: True)
    for r, t, p in zip(rows, texts, ps, strict=True):
        own = p if p is not None else zero
        prior = (whole + 1) / (whole.sum() + n)
        for k in (1, 2):
            c = total(lambda x, k=k: level(x[3], k) == level(r[3], k))
            prior = (c + 5 * prior) / (c.sum() + 5)
        c = np.maximum(total(lambda x: x[3] == r[3]) - own, 0)
        prior = (c + 5 * prior) / (c.sum() + 5)
        d = np.maximum(total(lambda x: x[2] == r[2]) - own, 0)
        base = (whole + 1) / (whole.sum() + n)
        said = np.log((d + 2 * base) / (d.sum() + 2) / base) if r[2] else zero
        post = soft(t + np.log(prior) + said)
        out.append((r[0], langs[int(post.argmax())], post.max()))
    return out


def test_fusion_against_plain_loops(spark, tongues):
    rows = [(1, "the cat and the mat", "en", "a.b.com"), (2, "der hund im haus", "de", "a.b.com"), (3, "", "en", "a.b.com"), (4, "xx", "", "c.de"), (5, "le chat", "fr", ""), (6, None, "", ""), (7, "die katze", "en", "x.c.de"), (7, "die katze", "en", "x.c.de")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    got = sorted(((r["id"], r["lang"], r["confidence"]) for r in language.fuse(language.evidence(df, tongues).cache(), tongues.languages).collect()))
    for a, b in zip(got, sorted(brute_fusion(rows, tongues)), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)


def test_pages_and_documents(spark, tongues):
    pages = spark.createDataFrame([(1, "http://a.com/x", "<html lang='EN-us'><p>the cat sat on the mat"), (2, None, None), (3, "x", "")], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as declared")
    rows = {r["page_id"]: r for r in language.identify_pages(pages, tongues).collect()}
    assert (rows[1]["lang"], rows[1]["declared"], rows[1]["accepted"]) == ("en", "en", True) and not rows[2]["accepted"] and not rows[3]["accepted"]
    docs = spark.createDataFrame([(1, "the cat sat", "en", "s"), (2, "1234 !!", "en", "s"), (None, "", None, None), (1, "the cat sat", "en", "s")], "doc_id long, text string, lang string, source string")
    kept = language.keep_identified(docs, tongues)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1]
    assert language.identify_documents(docs.limit(0), tongues).count() == 0


def test_rows_of_one_id_are_judged_each(spark, tongues):
    long = "the cat sat on the mat and then it left " * 30_000
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", "s", 1), (1, "1234 !!", "en", "s", 2), (2, long, "en", "s", 3)], "doc_id long, text string, lang string, source string, _mark int")
    got = language.keep_identified(docs, tongues)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["_mark"]) for r in got.collect()) == [(1, 1), (2, 3)]
    assert tongues.likelihoods(long).argmax() == tongues.languages.index("en")


def test_documents_keep_their_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = language.identify_documents(docs, language.fit(docs)).collect()
    assert np.mean([r["text_lang"] == r["declared"] for r in rows]) > 0.9
    assert np.mean([r["accepted"] for r in rows]) > 0.95


def test_every_language_is_fitted(spark):
    tags = [f"{a}{b}" for a in "bcdfghjk" for b in "aeiouvwxy"] + ["EN-us", "en_GB", "Esperanto"]
    docs = spark.createDataFrame([(i, f"{t} words", t) for i, t in enumerate(tags)], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == sorted([*tags[:-3], "en", "esperanto"])
