"""Classifiers and language ID: held-out accuracy, and defined results for odd rows."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import language, quality, toxicity

PLAIN = "river stone paper window garden letter morning silver".split()
LANGS = {
    "aa": "baba dado gugu mimi".split(),
    "bb": "krstt vlkk przm strx".split(),
    "cc": "élan çava œuvre où".split(),
}


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def labelled(spark, documents):
    draw = random.Random(3)
    texts, labels = [], []
    for k in range(400):
        words = [draw.choice(PLAIN) for _ in range(draw.randrange(5, 60))]
        bad, insult = draw.random() < 0.3, draw.random() < 0.3
        if bad:
            words = [w + draw.choice(["%%%", "$$$"]) for w in words]
        if insult:  # neither word alone is toxic, both together are
            words.insert(draw.randrange(len(words)), "dolt")
        group = draw.random() < 0.5
        if group:
            words.insert(draw.randrange(len(words)), "flatlanders")
        texts.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(insult and group)))
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "stone " * 50_000), (3, texts[3][1]), (None, "x y")]
    labels += [(3, 0, 0), (7, None, None), (None, 1, 1), (5000, 1, 0)]
    return documents(texts + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts, labels


def check(rows, modulus, out, truth):
    assert len(rows) == 406
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, modulus) == out)
    own = {r.doc_id: r for r in rows}
    assert own[1000].score == own[1001].score == own[1002].score
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality(labelled):
    docs, labels, texts, known = labelled
    truth = {d: q for d, q, _ in known[:400]}
    assert check(quality.quality(docs, labels).collect(), 3, 1, truth) > 0.95


def test_toxicity_learns_a_pair(labelled, monkeypatch):
    docs, labels, texts, known = labelled
    # Few documents: more passes and larger steps of the factors.
    for name, value in {"EPOCHS": 60, "BATCH": 32, "PAIR_SCALE": 0.5, "PAIR_RATE": 0.1}.items():
        monkeypatch.setattr(toxicity, name, value)
    truth = {d: t for d, _, t in known[:400]}
    assert check(toxicity.toxicity(docs, labels).collect(), 5, 0, truth) > 0.9


def test_labels_held_out_are_not_read(labelled, spark):
    docs, labels, *_ = labelled
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (
        sorted((r.doc_id or -1, r.score) for r in quality.quality(docs, x).collect()) for x in (labels, turned)
    )
    assert one == two


def test_without_labels_or_rows(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a b"), (2, None)])
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert all(r.predicted == int(r.score >= 0.5) for r in toxicity.toxicity(docs, none).collect())
    assert quality.quality(documents([]), none).count() == 0
    assert toxicity.toxicity(documents([]), none).count() == 0


def test_labels_of_absent_documents_use_no_bound(labelled, spark):
    docs, labels, _, known = labelled
    strangers = spark.range(1_000_000, 1_100_000).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic")
    more = labels.select("doc_id", "quality", "toxic").union(strangers)
    from pyspark.sql import functions as F

    from tessera.llm import labelled as L

    rows = L.training_rows(docs, more, "quality", F.lit(True), 100).collect()
    assert len(rows) == 100 and len({r.label for r in rows}) == 2
    again = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, None)], "doc_id long, text string")
    one = L.training_rows(again, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"), "quality", F.lit(True), 10)
    assert [tuple(r) for r in one.collect()] == [(1, "a", 1)]


def test_a_rare_term_keeps_its_weight():
    draw = np.random.Generator(np.random.PCG64(1))
    docs = [np.unique(draw.integers(10, 400, 30)) for _ in range(6000)]
    y = np.zeros(6000)
    for k in range(0, 60, 10):  # six documents in six thousand
        docs[k], y[k] = np.append(docs[k], 5000), 1.0
    w = np.frombuffer(toxicity.fit(docs, y), np.float32)[1 : (1 << toxicity.BITS) + 1]
    assert w[5000] > 0.5 and w[5000] > 2 * np.abs(w[:5000]).max()


def test_factorization_machine_is_a_sum_over_pairs():
    draw = np.random.Generator(np.random.PCG64(2))
    w, v = draw.normal(size=50), draw.normal(size=(50, toxicity.FACTORS))
    docs = [np.sort(draw.choice(50, n, replace=False)) for n in (0, 1, 2, 7, 30)]
    first = np.cumsum([0] + [len(d) for d in docs])
    got = toxicity.logits(np.concatenate(docs), first, 0.3, w, v)
    for d, value in zip(docs, got):
        scale = min(toxicity.PAIR_SCALE, toxicity.PAIR_NORM / np.sqrt(max(len(d), 1)))
        pairs = sum(v[i] @ v[j] * scale**2 for a, i in enumerate(d) for j in d[a + 1 :])
        assert np.isclose(value, 0.3 + w[d].sum() + pairs)


def test_ftrl_against_plain_python():
    draw = np.random.Generator(np.random.PCG64(3))
    docs = [np.unique(draw.integers(0, 40, n)) for n in (1, 5, 9, 3, 12, 7) * 5]
    y = np.array([float(d[0] % 2) for d in docs])
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for d, label in zip(docs, y):
            x = {int(i): len(d) ** -0.5 for i in d} | {quality.INTERCEPT: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / quality.ALPHA * w[i]
                n[i] = old + g * g
    got = np.frombuffer(quality.fit(docs, y), np.float32)
    assert np.allclose(got[[*range(40), quality.INTERCEPT]], [weight(i) for i in [*range(40), quality.INTERCEPT]], atol=1e-5)
    assert not got[40 : quality.INTERCEPT].any()


def test_mixture_and_set_against_plain_em():
    draw = np.random.Generator(np.random.PCG64(4))
    grams = 1 << language.BITS
    p = draw.dirichlet(np.full(grams, 0.02), 4).T + 1e-9
    texts = [" ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 5)) for _ in range(60)) for _ in range(6)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    # Make languages out of the texts: 0 and 1 of one text each, 2 of two, 3 of nothing here.
    found, of = language.trigrams(data, offsets)
    for lang, docs in enumerate([(0,), (1,), (2, 3)]):
        p[:, lang] = np.bincount(found[np.isin(of, docs)], minlength=grams) + 0.01
    p /= p.sum(0)
    mixed = texts[0] + " " + texts[1] + " " + texts[2]
    for text, want in ((texts[0], {0}), (texts[3], {2}), (mixed, {0, 1, 2}), (texts[0] + " " + texts[2] * 2, {0, 2})):
        one = np.frombuffer(text.encode(), np.uint8)
        best, share, chosen, some = language.infer(one, np.array([0, len(one)]), p)
        assert set(np.flatnonzero(chosen[0])) == want and some[0]
        grams_of = language.trigrams(one, np.array([0, len(one)]))[0]
        plain = np.full(4, 0.25)
        for _ in range(400):
            part = p[grams_of] * plain
            plain = (part / part.sum(1, keepdims=True)).mean(0)
        assert abs(share[0] - plain[best[0]]) < 0.03
        assert plain.argmax() == best[0]


def test_languages(documents):
    draw = random.Random(9)

    def text(lang, n):
        return " ".join(draw.choice(LANGS[lang]) for _ in range(n)).title()

    rows, langs = [], []
    for k in range(300):
        langs.append(draw.choice(list(LANGS)))
        rows.append((k, text(langs[-1], draw.randrange(2, 40))))
    mixed = [(901, text("aa", 40) + " " + text("bb", 12)), (902, text("bb", 400) + text("cc", 90))]
    odd = [(910, None), (911, ""), (912, "12 !? 34"), (913, "日本"), (None, text("cc", 9)), (0, rows[0][1])]
    langs += ["bb", "aa", "aa", "aa", "aa", "aa", " ", langs[0]]
    got = language.languages(documents(rows + mixed + odd, langs=langs)).collect()
    assert len(got) == 308
    own = {r.doc_id: r for r in got}
    assert all(own[k].lang_pred == langs[k] for k in range(300) if own[k].held_out)
    assert own[901].lang_pred == "aa" and 0.5 < own[901].score < 0.95
    assert own[902].lang_pred == "bb"
    assert own[901].langs == ["aa", "bb"] and abs(sum(own[901].proportions) - 1) < 1e-6
    assert own[910].langs == [] and own[910].proportions == []
    assert [(own[k].lang_pred, own[k].score) for k in (910, 911, 912)] == [("und", 0.0)] * 3
    assert own[913].lang_pred in LANGS and own[None].lang_pred == "cc" and not own[None].held_out
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) for r in got if r.doc_id is not None)


def test_no_language_learned(documents):
    rows = language.languages(documents([(1, "abc"), (2, None)], langs=[None, "x"])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert language.languages(documents([])).count() == 0


def test_toxicity_learns_pairs_with_the_constants_of_production():
    import numpy as np
    import pyarrow as pa

    from tessera.llm import text as T

    draw = random.Random(12)
    vocabulary = [f"word{k}" for k in range(2000)]

    def sample(n):
        texts, kinds = [], []
        for _ in range(n):
            words = [draw.choice(vocabulary) for _ in range(draw.randrange(5, 60))]
            kind = draw.choice(["plain", "plain", "toxic", "crossed"])
            if kind != "plain":  # an insult is toxic beside its own group alone
                insult = draw.randrange(2)
                group = insult if kind == "toxic" else 1 - insult
                words += [("dolt", "oaf")[insult], ("flatlanders", "hillfolk")[group]]
                draw.shuffle(words)
            texts.append(" ".join(words))
            kinds.append(kind)
        docs = []
        for _, _, data, offsets in T.slices(pa.array(texts)):
            found, first = toxicity.terms(data, offsets)
            docs += [found[a:b] for a, b in zip(first, first[1:])]
        return docs, np.array(kinds)

    docs, kinds = sample(toxicity.MAX_TRAINING_DOCS)
    model = np.frombuffer(toxicity.fit(docs, (kinds == "toxic").astype(float)), np.float32)
    size = 1 << toxicity.BITS
    docs, kinds = sample(2000)
    found, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    v = model[size + 1 :].reshape(size, toxicity.FACTORS)
    marked = toxicity.logits(found, first, float(model[0]), model[1 : size + 1], v) >= 0
    assert marked[kinds == "crossed"].mean() < 0.05
    assert marked[kinds == "toxic"].mean() > 0.95
