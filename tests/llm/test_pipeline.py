"""The pipeline's stages against brute force on a small table."""
import corpus_pipeline
from assayframe.llm import common, surrogates
from pyspark.sql import functions as F

from test_decontam import brute as leaked
from test_jaccard import brute
from test_surrogates import brute as replaced


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, seen[-1], sf), name)
        seen.append(out)
        if name != "encoding":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    first, good, single, clean, safe, encoded = seen
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) < ids(first) and len(ids(good)) > 0.7 * len(ids(first))
    groups = brute([(r.doc_id, r.text) for r in good.collect()])
    assert ids(single) == {d for d, _, c in groups if c == d}
    assert ids(clean) <= ids(single) and len(ids(clean)) > 0.8 * len(ids(single))
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    assert ids(clean) == ids(single) - {d for d, _ in leaked([(r.doc_id, r.text) for r in single.collect()], items)}
    before = clean.orderBy("doc_id").collect()
    assert [r.text for r in safe.orderBy("doc_id").collect()] == replaced([r.text for r in before])
    assert ids(safe) == ids(clean) == ids(encoded)
    entities = lambda df: {e.lower() for r in df.select(surrogates.found(F.col("text")).alias("e")).collect() for e in r.e}
    assert not entities(clean) & entities(safe)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in encoded.collect())


def test_stages_pass_clashing_columns_through(spark, sf):
    docs = common.table(spark, sf, "documents").withColumns({c: F.lit(7) for c in ("score", "predicted", "n_entities", "component_id", "fp", "part", "item_id")})
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert encoded.columns == ["doc_id", "n_tokens", "ids", "exact"] and encoded.count() == docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.where("score != 7 or n_entities != 7 or component_id != 7").isEmpty(), name


def test_run_on_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_nulls_repeats_and_long_texts(spark, sf):
    """Each stage judges rows, not ids: null ids, null and empty texts, repeated rows and a text of 2 MB."""
    good = common.table(spark, sf, "documents").orderBy("doc_id").limit(1).first().text
    long = "plain words of a long text go on and on, " * 50_000
    item = common.table(spark, sf, "benchmark").first().text
    rows = [(1, good, "en"), (1, good, "en"), (1, "Mail a.b@c.org about it, please, when you can.", "en"), (None, good, None), (None, None, "de"), (2, None, None), (2, "", "en"), (3, long, "en"), (4, f"So: {item} Right.", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted(map(str, df.collect()))
    assert set(key(stages["quality"](spark, docs, sf))) <= set(key(docs))
    single = stages["near_duplicates"](spark, docs, sf)
    want = docs.where("doc_id is not null or text is null").distinct()
    assert key(single) == key(want)
    clean = stages["decontamination"](spark, docs, sf)
    assert key(clean) == key(docs.where("doc_id is null or doc_id != 4"))
    safe = stages["pii"](spark, docs, sf)
    assert safe.count() == docs.count() and safe.where("text like '%a.b@c%'").isEmpty() and not safe.where("text like 'Mail %@%.org about it, please, when you can.'").isEmpty()
    assert key(safe.where("text is null or text not like 'Mail%'")) == key(docs.where("text is null or text not like 'Mail%'"))
    encoded = stages["encoding"](spark, docs, sf)
    assert encoded.count() == docs.count() and encoded.where("not exact").isEmpty() and encoded.where("n_tokens = 0").count() == 3
