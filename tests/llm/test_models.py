"""Quality and toxicity: held-out accuracy, pairs, interactions, edge rows."""
import numpy as np
import pyarrow as pa

from assayframe.llm import quality, toxicity

BIG = "/root/testdata/sf0.1"


def held_out(spark, run, label):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", label)
    out = run(spark, BIG)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 700 and all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == r[label] for r in rows]), rows


def test_quality_held_out(spark):
    accuracy, rows = held_out(spark, quality.op5_bradley_terry_quality, "quality")
    assert accuracy > 0.98
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_held_out(spark):
    accuracy, rows = held_out(spark, toxicity.op8_factorization_toxicity, "toxic")
    assert accuracy > 0.975
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_pairs_prefer_the_good():
    y = np.array([1] * 30 + [0] * 5)
    win, lose = quality.preference_pairs(y, 1)
    assert (y[win] == 1).all() and (y[lose] == 0).all() and set(lose) == set(range(30, 35))


def test_machine_learns_a_pair_effect():
    """Two words that are harmless alone and toxic together."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(800):
        words = ["plain", "words", "here"] + [w for w in ("insult", "group") if rng.random() < 0.5]
        texts.append(" ".join(words))
        labels.append(int("insult" in words and "group" in words))
    flat, bounds = toxicity.terms(pa.array(texts))
    machine = toxicity.fit_machine(flat, bounds, np.array(labels))
    a, b, both = machine.score(pa.array(["plain words insult", "plain words group", "plain group words insult"]))
    assert a < 0.5 and b < 0.5 and both > 0.5


def test_terms_that_tell_only_in_a_pair():
    """Neither insult nor group is commoner in toxic texts; only which of them meet tells."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(3000):
        insult, group = rng.integers(2), rng.random() < 0.5
        words = [("insult", "joke")[insult]] + ["group"] * group + [f"n{rng.integers(200)}" for _ in range(10)]
        texts.append(" ".join(words))
        labels.append(int((insult == 0) == group))
    flat, bounds = toxicity.terms(pa.array(texts))
    scores = toxicity.fit_machine(flat, bounds, np.array(labels)).score(pa.array(["insult", "joke", "group insult", "group joke"]))
    assert scores[2] > 0.5 > scores[3] and scores[2] - scores[3] > 0.5


def test_machine_equals_the_plain_sum():
    """Score and one fitted step against double loops over documents and pairs of terms."""
    texts = ["alpha beta", "beta gamma GAMMA", "alpha gamma delta", "delta", "", "alpha beta gamma"]
    flat, bounds = toxicity.terms(pa.array(texts))
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(np.unique(flat), rng.normal(size=4), rng.normal(size=(4, 3)), 0.3)
    at = {t: i for i, t in enumerate(machine.terms.tolist())}
    want = []
    for d in range(len(texts)):
        own = [at[t] for t in flat[bounds[d] : bounds[d + 1]].tolist()]
        assert len(own) == len(set(texts[d].lower().split()))
        z = machine.b + sum(machine.w[i] for i in own) + sum(machine.v[i] @ machine.v[j] for i in own for j in own if i < j)
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(machine.score(pa.array(texts)), want)
    chi = toxicity.evidence(np.array([30.0, 10.0]), np.array([20.0, 2.0]), 100, 20.0)
    table = [(abs(20 - 6) - 0.5) ** 2 / (6 * 0.8 * 0.7), (abs(2 - 2) - 0.5) ** 2 * 0]
    assert np.allclose(chi, table)


def test_blocks_change_nothing(monkeypatch):
    texts = [" ".join(f"w{(i * k) % 17}" for k in range(1, 9)) for i in range(60)]
    flat, bounds = toxicity.terms(pa.array(texts))
    y = np.arange(60) % 3 == 0
    whole = toxicity.fit_machine(flat, bounds, y.astype(int), rounds=20)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    parts = toxicity.fit_machine(flat, bounds, y.astype(int), rounds=20)
    assert np.allclose(whole.w, parts.w, atol=1e-4) and np.allclose(whole.score(pa.array(texts)), parts.score(pa.array(texts)), atol=1e-3)


def plain_features(text):
    """Quality features of one text by counting over its bytes and words."""
    raw = (text or "").encode()
    out = np.zeros(quality.N_FEATURES)
    for a, b in zip(raw, raw[1:]):
        out[int(quality.CLASS[a]) * quality.N_CLASS + int(quality.CLASS[b])] += 1
    out[: quality.N_PAIRS] = np.sqrt(out[: quality.N_PAIRS] / max(1, len(raw) - 1))
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = [w for w in low.translate(bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))).split(b" ") if w]
    many = max(1, len(words))
    out[quality.N_PAIRS] = sum(a == b for a, b in zip(words, words[1:])) / many
    out[quality.N_PAIRS + 1] = (len(words) - len(set(words))) / many
    out[quality.N_PAIRS + 2] = sum(a == b for a, b in zip(words, words[2:])) / many
    out[quality.N_PAIRS + 3] = np.log1p(len(raw)) / 10
    return out


def test_quality_features_equal_plain_counts(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [None, "", "a", "A a  a b\ta", "é!|#$%&* 12,3"]
    assert np.allclose(quality.features(pa.array(texts)), np.array([plain_features(t) for t in texts]))


def test_pair_loss_is_at_its_least():
    """The fitted weights have no slope left in the loss written out pair by pair; the cut is a quantile."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=120) > 0.4).astype(int)
    model = quality.fit_pairs(x, y)
    win, lose = quality.preference_pairs(y, 7)
    scale = x.std(0)

    def loss(u):
        return sum(np.log1p(np.exp(-(x[i] - x[j]) / scale @ u)) for i, j in zip(win, lose)) / len(win) + 1e-3 / 2 * u @ u

    u = model.weights * scale
    for k in range(5):
        step = np.eye(5)[k] * 1e-4
        assert abs(loss(u + step) - loss(u - step)) / 2e-4 < 1e-5
    raw = x @ model.weights
    assert model.level in quality.LEVELS and np.isclose(model.cut, np.quantile(raw, model.level))
    errors = [np.mean(raw[y == 0] >= c) + np.mean(raw[y == 1] < c) for c in np.quantile(raw, quality.LEVELS)]
    assert np.isclose(np.mean(raw[y == 0] >= model.cut) + np.mean(raw[y == 1] < model.cut), min(errors))
    given = quality.fit_pairs(x, y, level=0.25)
    assert np.isclose(np.mean(x @ given.weights < given.cut), 0.25)


DOCS = [(1, None, 9.0), (2, "", 9.0), (3, "word", 9.0), (3, "word", 9.0), (None, "some words " * 50_000, 9.0)]


def test_edge_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, label double")
    for op, label in ((quality, "quality"), (toxicity, "toxic")):
        for labels in ([], [(1, 1)], [(1, 1), (2, 0), (3, 0), (3, 0), (None, 1), (8, None)]):
            df = spark.createDataFrame(labels, f"doc_id long, {label} int")
            rows = op.score_documents(docs, df).collect()
            assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
            assert rows[2].score == rows[3].score and rows[0].score == rows[1].score
        assert op.score_documents(docs.limit(0), df).collect() == []


def test_only_training_labels_matter(spark):
    """Labels of the held-out fold change no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) quality")
    a, b = (quality.score_documents(docs, x).orderBy("doc_id").toPandas()["score"] for x in (labels, flipped))
    assert np.array_equal(a, b)
