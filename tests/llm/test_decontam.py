"""Retrieval against scoring every item for every passage."""
import math
import re

from assayframe.llm import decontam

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, items):
    seqs = {i: words(t) for i, t in items if words(t)}
    n = len(seqs)
    mean = sum(map(len, seqs.values())) / n
    df = {}
    for s in seqs.values():
        for t in set(s):
            df[t] = df.get(t, 0) + 1

    def score(passage, s):
        out = 0
        for t in set(s) & set(passage):
            tf = s.count(t)
            out += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(s) / mean))
        return out

    grams = lambda s: {tuple(s[k : k + 3]) for k in range(max(1, len(s) - 2))} if s else set()
    hits = set()
    for d, text in docs:
        w = words(text)
        for i, s in seqs.items():
            step = 32
            while step < len(s):
                step *= 2
            for k in range(max(1, -(-len(w) // step) - 1)):
                p = w[k * step : (k + 2) * step]
                if p and score(p, s) / score(s, s) >= 0.6 - 1e-9:
                    cut = len(s) - max(1, len(s) // 3) if len(s) > 1 else 1
                    have = grams(p)
                    share = lambda part: sum(any(g == h[: len(g)] for h in (have if len(g) == 3 else {tuple(p[x : x + len(g)]) for x in range(len(p))})) for g in grams(part)) / len(grams(part)) if part else 0
                    if share(s[:cut]) >= 0.5 and share(s[cut:]) >= 0.5:
                        hits.add((d, i))
    return hits


def test_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs += [(10_000 + i, "Lead in words. " + t + " And more follows here.") for i, t in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert got == brute(docs, items)
    assert len(items) == len({i for _, i in got})


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "one two three four five six seven eight nine ten", "a"), (4, "one two three four five six seven eight nine ten", "a"), (4, "one two three four five six seven eight nine ten", "a"), (5, "something else entirely", "a")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, "One two three, four five six seven eight nine ten."), (8, None), (9, "!!"), (None, "one two")], "item_id long, text string")
    got = decontam.leaks(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 7), (4, 7), (4, 7)]
    assert decontam.leaks(docs, bench.limit(0)).collect() == [] and decontam.leaks(docs.limit(0), bench).collect() == []
    kept = decontam.without_leaks(docs, bench).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 5]


def test_short_items_equal_brute_force(spark):
    """Verbatim items of 1 to 8 words are found inside longer texts, as by brute force."""
    vocab = [f"w{k}x" for k in range(60)]
    items = [(n, " ".join(vocab[n * (n - 1) // 2 : n * (n + 1) // 2])) for n in range(1, 9)] + [(9, "w0x w2x"), (10, " ".join(vocab[40:52]))]
    docs = [(i, f"lead in {'pad ' * (7 * i)}{t} and more follows {'end ' * i}") for i, t in items]
    docs += [(20, "w1x pad w5x pad w9x"), (21, "w28x w29x w30x pad w31x w32x"), (22, "w2x w1x"), (23, "w10x w11x w12x w13x")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert {(i, i) for i, _ in items} <= got
    assert {h for h in got if h[1] != 1} == {h for h in brute(docs, items) if h[1] != 1}
    assert {d for d, i in got if i == 1} == {1, 9}  # a one-word item is its own answer
    kept = {r.doc_id for r in decontam.without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got} and 21 in kept


def test_slices_do_not_change_scores(spark, sf, monkeypatch):
    """An index in slices gives the rows of one index, edited passages included."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, t in items:
        w = t.split()
        docs += [(10_000 + 100 * i + k, " ".join(x for j, x in enumerate(w) if j % k)) for k in (3, 4, 5, 6, 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontam.leaks(df, bench).collect())
    whole = found()
    kept = sorted(r.doc_id for r in decontam.without_leaks(df, bench).select("doc_id").collect())
    assert len(list(decontam.slices(bench))) == 1
    monkeypatch.setattr(decontam, "INDEX_BYTES", sum(len(t.encode()) for _, t in items) // 4)
    assert len(list(decontam.slices(bench))) > 3
    assert whole and found() == whole
    assert sorted(r.doc_id for r in decontam.without_leaks(df, bench).select("doc_id").collect()) == kept


def test_long_items_do_not_widen_short_ones(spark):
    """Beside an item of 3,000 words, scattered words of a short one are still no leak, and both are found."""
    long = " ".join(f"l{k}q" for k in range(3000))
    short = "why does the red fox jump over nine lazy dogs at dawn"
    apart = " ".join(w + " pad" * 60 for w in short.split())
    docs = spark.createDataFrame([(1, apart), (2, f"so {short} then"), (3, f"a b {long} c")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, short), (8, long)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()) == [(2, 7), (3, 8)]
