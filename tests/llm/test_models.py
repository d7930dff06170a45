"""Language identification and toxicity by held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm import langid, toxicity

LANGS = {"en": "the of and ing tion er that with".split(), "de": "der und ung sch ei ich ö ü".split(), "fr": "le que ai eau eux é è ment".split()}


def text(rng, lang, n):
    parts = LANGS[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_by_held_out_rows(table):
    rng = random.Random(1)
    rows, said = [], []
    for i in range(500):
        lang = rng.choice(list(LANGS))
        said.append(lang)
        rows.append((i, text(rng, lang, rng.randrange(5, 60)), lang if i < 250 else None, "s"))
    odd = [(600, None, "en", "s"), (601, "", "en", "s"), (602, "123 ... !", "en", "s"), (603, "der und sch " * 30_000, None, "s"), (None, rows[0][1], None, None)]
    docs = table([*rows, *odd])
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    held = [got[i].language == said[i] for i in range(250, 500)]
    assert np.mean(held) > 0.97
    sure = np.array([got[i].confidence for i in range(250, 500)])
    assert abs(sure.mean() - np.mean(held)) < 0.1
    for i in (600, 601, 602):
        assert got[i].language is None and got[i].confidence == 0 and not got[i].accepted
    assert got[603].language == "de" and got[None].language == got[0].language
    left = langid.keep_identified(docs)
    assert left.columns == docs.columns and left.count() == sum(r.accepted for r in got.values())


@pytest.mark.parametrize("name", ["__text", "text_", "language_", "Confidence", "row_", "mark"])
def test_language_with_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "der und sch", "de", "q"), (2, "the of and", "en", "q")], f"doc_id long, text string, lang string, {name} string")
    left = langid.keep_identified(docs)
    assert left.columns == docs.columns and {r[3] for r in left.collect()} <= {"q"}


def test_language_sample_is_of_distinct_texts_by_label(table):
    """Copies take no second place in the sample, and a rare language has some."""
    rng = random.Random(4)
    rows = [(i, text(rng, "en", 12), "en", "s") for i in range(400)] + [(1000 + i, text(rng, "de", 12), "de", "s") for i in range(12)]
    rows += [(2000 + i, rows[k][1], "en", "s") for k in range(0, 400, 40) for i in range(150)]
    drawn = [(r.t, r.y) for r in langid.draw(table(rows), "text", "lang", 80).collect()]
    assert len(set(drawn)) == len(drawn) and 76 <= len(drawn) <= 80 and sum(y == "de" for _, y in drawn) >= 10
    assert {y for _, y in drawn} == {"en", "de"}
    assert langid.quotas({"a": 5, "b": 7}, 12) == {"a": 5, "b": 7} and sum(langid.quotas({str(i): i for i in range(1, 40)}, 10).values()) == 10
    names, w, t = langid.fit(table(rows), sample=80)
    assert names == ["de", "en"]


def test_ftrl_by_a_dense_fit():
    """Whole rows, each coordinate for itself: the same weights."""
    rng = np.random.default_rng(3)
    x = rng.poisson(0.3, (200, 30)) * rng.random((200, 30))
    y = (x[:, :3] + 0.05 * rng.random((200, 3))).argmax(axis=1)
    z, n = np.zeros((30, 3)), np.zeros((30, 3))
    rng = np.random.default_rng(1)

    def weights():
        return np.where(np.abs(z) <= langid.L1, 0, -(z - np.sign(z) * langid.L1) / ((langid.BETA + np.sqrt(n)) / langid.ALPHA + langid.L2))

    for _ in range(2):
        for i in rng.permutation(200):
            w = weights()
            e = np.exp(x[i] @ w)
            g = np.outer(x[i], e / e.sum() - np.eye(3)[y[i]])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / langid.ALPHA * w
            n += g * g
    got = langid.ftrl([(np.flatnonzero(r), r[r > 0]) for r in x], y, 3, 2)
    assert got[:30] == pytest.approx(weights(), abs=1e-9) and not got[30:].any()


def test_language_by_brute_force(table):
    """The query's rows from n-grams counted one by one, with the weights of the same model."""
    rng = random.Random(9)
    rows = [(i, text(rng, lang, rng.randrange(1, 30)) + rng.choice(["", " 12 !? ", "É"]), lang, "s") for i in range(60) for lang in (rng.choice(list(LANGS)),)]
    rows += [(70, "the of and der und sch", None, "s"), (71, "é", None, "s")]
    docs = table(rows)
    names, w, t = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}

    def bucket(gram):
        h = np.uint32(0)
        for k, c in enumerate(gram):
            h = (h ^ (h >> np.uint32(15))) + np.uint32(ord(c)) * langid._MULTIPLY[k]
        return int((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - langid.BITS))

    with np.errstate(over="ignore"):
        for d, said, *_ in rows:
            plain = re.sub("[^a-z\u00c0-\U0010ffff]+", " ", said.lower())
            found = [bucket(plain[i : i + k]) for k in (1, 2, 3) for i in range(len(plain) - k + 1)]
            p = langid.softmax((w[found].sum(axis=0) / len(found) + w[-1]) / t)
            assert got[d].language == names[int(p.argmax())] and got[d].confidence == pytest.approx(p.max(), abs=1e-4)


def test_equal_probabilities(table):
    """Two labels of the same texts are as likely: the first in the alphabet is named."""
    rows = [(i, "one text", "xx" if i % 2 else "aa", "s") for i in range(2)]
    names, w, t = langid.fit(table(rows))
    tied = langid.classified(table(rows), "text", ["doc_id"], (["aa", "xx"], np.zeros_like(w), t), ("language", "confidence")).collect()
    assert {(r.language, r.confidence) for r in tied} == {("aa", 0.5)}


def test_no_labels(table):
    assert langid.identify_languages(table([(1, "words", None, "s")])).collect()[0].accepted is False
    assert langid.identify_languages(table([])).count() == 0


def test_temperature():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, (4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    assert langid.temperature(5 * z, y) == pytest.approx(5, rel=0.15) and langid.temperature(z[:0], y[:0]) == 1


def test_toxicity_by_held_out_rows(table, spark):
    rng = random.Random(2)
    plain, rude = [f"plain{i}" for i in range(400)], ["grunt", "oaf", "swinehund", "nitwit", "blockhead"]
    rows, labels, toxic = [], [], {}
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic[i] = rng.random() < 0.2
        if toxic[i]:
            for _ in range(rng.randrange(1, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "!", "$$$"]))
        rows.append((i, " ".join(words), "en", "s"))
        if i < 500:
            labels.append((i, int(toxic[i]), "x"))
    labels += [(3, None, "x"), (None, 1, "x"), (5000, 1, "x"), (4, int(toxic[4]), "x")]
    rows += [(901, None, "en", "s"), (902, "", "en", "s"), (903, "plain1 " * 50_000 + "oaf nitwit oaf", "en", "s"), (904, " ".join(rude * 3), "en", "s"), (905, "oaf", "en", "s")]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(rows), marks).collect()}
    held = [got[i].is_toxic == toxic[i] for i in range(500, 900)]
    assert np.mean(held) > 0.97
    assert got[901].expected_severity == got[902].expected_severity == 0 and not got[901].is_toxic
    assert got[903].is_toxic and got[904].expected_severity > got[905].expected_severity
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.is_toxic for r in toxicity.score_toxicity(table(rows[:5]), none).collect())
    assert toxicity.score_toxicity(table([]), marks).count() == 0


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(4)
    rows = [(np.array([0]), np.array([x])) for x in rng.normal(0, 2, 1500)]
    grades = np.digitize([x[0] for _, x in rows], [-1, 0.5, 2])
    w, theta = toxicity.fit_ordinal(rows, grades, 3, 1, epochs=10)
    assert w[0] > 0 and (np.diff(theta) > 0).all()


def test_features_that_speak_against_take_part():
    rng = random.Random(5)
    texts = [f"{'oaf' if i % 2 else 'kind'} word{i} " + " ".join(rng.choice(["a", "b", "c"]) for _ in range(9)) for i in range(400)]
    words, w, theta = toxicity.fit(texts, np.arange(400) % 2)
    (mean, _), (fair, _) = (toxicity.scores(pa.array([t]), words, w) for t in ("oaf", "kind"))
    assert mean[0] > theta[0] > fair[0] and fair[0] < 0 and (np.diff(theta) > 0).all() and len(theta) == toxicity.GRADES


def dense_ordinal(x, grades, levels, epochs):
    """fit_ordinal over whole rows, in the order that it takes."""
    z, n = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    theta, seen = np.linspace(1, levels, levels), np.full(levels, 1e-2)
    rng = np.random.default_rng(3)

    def weights():
        return np.array([0.0 if abs(a) <= toxicity.L1 else -(a - np.sign(a) * toxicity.L1) / ((toxicity.BETA + b**0.5) / toxicity.ALPHA + toxicity.L2) for a, b in zip(z, n)])

    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            w, k = weights(), grades[i]
            s = float(x[i] @ w)
            cdf = [0.0, *(1 / (1 + np.exp(-(t - s))) for t in theta), 1.0]
            p = max(cdf[k + 1] - cdf[k], 1e-6)
            g = (1 - cdf[k + 1] - cdf[k]) * x[i]
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / toxicity.ALPHA * w
            n += g * g
            for edge, sign in ((k, -1), (k - 1, 1)):
                if 0 <= edge < levels:
                    slope = np.clip(sign * cdf[edge + 1] * (1 - cdf[edge + 1]) / p, -5, 5)
                    seen[edge] += slope**2
                    theta[edge] -= 0.3 * slope / np.sqrt(seen[edge])
            for edge in range(1, levels):
                theta[edge] = max(theta[edge], theta[edge - 1] + 0.05)
    return weights(), theta


def test_ordinal_by_a_dense_fit():
    rng = np.random.default_rng(8)
    x = rng.poisson(0.4, (250, 12)).astype(float)
    grades = np.digitize(x @ rng.normal(0, 1, 12) + rng.logistic(0, 0.3, 250), [-0.5, 0.5, 1.5])
    rows = [(np.flatnonzero(r), r[r > 0]) for r in x]
    w, theta = toxicity.fit_ordinal(rows, grades, 3, 12, epochs=4)
    dense_w, dense_theta = dense_ordinal(x, grades, 3, 4)
    assert w == pytest.approx(dense_w, abs=1e-9) and theta == pytest.approx(dense_theta, abs=1e-9)
    assert np.abs(np.digitize(x @ w, theta) - grades).mean() < 0.45


def test_toxicity_by_brute_force(table, spark):
    """The query's rows from the model that plain Python fits to the same labels, word by word."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["swinehund", "nitwit"] if i % 5 == 0 and k % 4 == 0 else ["plain", "fine", "good", "day"]) for k in range(rng.randrange(3, 30))), "en", "s") for i in range(300)]
    rows += [(400, "plain nitwit", "en", "s"), (None, "swinehund day", "en", "s"), (401, None, "en", "s")]
    marks = [(i, int(i % 5 == 0)) for i in range(300)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(rows), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    label = {}
    for i, y in marks:
        label[rows[i][1]] = max(y, label.get(rows[i][1], 0))
    words, w, theta = toxicity.fit(sorted(label), np.array([label[t] for t in sorted(label)]))
    weight = dict(zip(words.tolist(), w))
    for d, t, *_ in rows:
        if t is None:
            assert got[d].expected_severity == 0
            continue
        seen = Counter(int(h) for word in t.split() for h in next(toxicity._each([word])))
        s = sum(weight.get(h, 0) * (1 + np.log(n)) for h, n in seen.items())
        over = 1 / (1 + np.exp(theta - s))
        assert got[d].expected_severity == pytest.approx(over.sum(), abs=1e-6) and got[d].is_toxic == (over[0] >= 0.5)
