"""Registered queries over the structure-activity operators, with oracle SQL.

The test tables hold no molecules, so operators bind to stand-ins: ``part``
and ``documents`` are compounds, per-part figures of ``lineitem`` and the
elements of ``embeddings`` are descriptors, ``labels`` is an external table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalars import finite, generated_id, inactive, measured, molecule_file_id, r6, safe_run_id, squeeze
from .operators import blocked, clean, colstats, domain, evaluate, external, neighbours, plots, select, split
from .sources.tables import staged
from .streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import catalog_branches, catalog_models, catalog_reports  # noqa: F401  these register their queries

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from . import catalog_branches, catalog_models, catalog_reports  # noqa: F401

    return ORACLES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- validation

def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "n_chars")
    return clean.mark(docs.withColumn("original_row_index", F.col("doc_id")), "text", "n_chars", "doc_id")


SQUEEZED = "lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"
MARKED = f"""marked AS (SELECT doc_id, {SQUEEZED} AS s, n_chars::DOUBLE AS a FROM documents),
valid AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS copy FROM marked WHERE s IS NOT NULL AND s <> '' AND a IS NOT NULL)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return validate_stats(spark, d)


@query("validate_stats", f"""WITH {MARKED} SELECT count(*) AS n, min(a) AS min_activity, max(a) AS max_activity,
round(avg(a), 6) AS mean_activity, round(median(a), 6) AS median_activity, round(stddev_samp(a), 6) AS std_activity FROM valid WHERE copy = 1""")
def validate_stats(spark: SparkSession, d: str) -> DataFrame:
    return clean.activity_stats(clean.keep_first(marked_documents(spark, d)))


@query("validation_counts", f"""WITH {MARKED} SELECT (SELECT count(*) FROM marked) AS original_rows,
(SELECT count(*) FROM marked WHERE s IS NULL OR s = '') AS invalid_structures, (SELECT count(*) FROM marked WHERE a IS NULL) AS invalid_activities,
count(*) FILTER (copy = 1) AS valid_rows, count(*) FILTER (copy > 1) AS duplicates FROM valid""")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    return clean.counts(marked_documents(spark, d))


@query("dedupe_keep_first", f"WITH {MARKED} SELECT doc_id::VARCHAR AS compound_id, a AS activity, doc_id AS original_row_index FROM valid WHERE copy = 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return clean.keep_first(marked_documents(spark, d)).select("compound_id", "activity", "original_row_index")


@query("duplicate_compounds", f"""WITH {MARKED} SELECT v.doc_id::VARCHAR AS compound_id, f.doc_id AS first_row FROM valid v JOIN valid f ON v.s = f.s AND f.copy = 1 WHERE v.copy > 1""")
def duplicate_compounds(spark: SparkSession, d: str) -> DataFrame:
    return clean.duplicates(marked_documents(spark, d)).select("compound_id", "first_row")


PROPS = "json_extract_string(props, '$.k')"


@query("quarantine_rows", f"""SELECT event_id::VARCHAR AS compound_id, event_type, (try_cast({PROPS} AS DOUBLE) IS NULL OR event_type = 'error') AS bad
FROM events WHERE try_cast({PROPS} AS DOUBLE) IS NULL OR event_type = 'error'""")
def quarantine_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events whose number does not parse, or whose structure stand-in is refused."""
    ev = read(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    refuse = lambda c: F.when(c != "error", c)
    marked = clean.mark(ev.withColumn("original_row_index", F.col("event_id")), "event_type", "k", "event_id", canonical=refuse)
    return clean.quarantine(marked).select("compound_id", "event_type", clean.bad().alias("bad"))


@query("coerce_json_numeric", f"""SELECT event_type, count(*) AS n, count(try_cast({PROPS} AS DOUBLE)) AS n_numeric, round(avg(try_cast({PROPS} AS DOUBLE)), 6) AS mean_k FROM events GROUP BY 1""")
def coerce_json_numeric(spark: SparkSession, d: str) -> DataFrame:
    k = finite(F.get_json_object("props", "$.k").try_cast("double"))
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_numeric"), r6(F.avg(k)).alias("mean_k"))


@query("generated_ids", """SELECT p_partkey, 'compound_' || p_partkey AS compound_id, printf('mol_%04d', p_partkey + 1) AS mol_id,
regexp_full_match(p_brand, '^[a-zA-Z0-9_\\-\\.]+$') AS safe_id FROM part""")
def generated_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k, generated_id(k).alias("compound_id"), molecule_file_id(k).alias("mol_id"), safe_run_id(F.col("p_brand")).alias("safe_id"))


@query("preview_head", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def preview_head(spark: SparkSession, d: str) -> DataFrame:
    """A preview is a report of 20 rows; the limit is the feature."""
    return read(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


@query("structure_hash", "SELECT p_partkey, sha256(lower(p_name)) AS structure_sha256 FROM part")
def structure_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.sha2(squeeze(F.col("p_name")), 256).alias("structure_sha256"))


# ------------------------------------------------------------------ external

def doc_compounds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("compound_id"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))


def doc_external(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("\t")).alias("compound_id"), "quality", F.col("toxic").alias("n_chars"))


@query("external_left_join", """SELECT d.doc_id::VARCHAR AS compound_id, d.n_chars::DOUBLE AS n_chars, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS ext__n_chars
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def external_left_join(spark: SparkSession, d: str) -> DataFrame:
    merged = external.merge_external(doc_compounds(spark, d), doc_external(spark, d), ordinal=None)
    return merged.table.select("compound_id", "n_chars", "quality", "ext__n_chars")


@query("external_fallback_key", """WITH e AS (SELECT p_name, min(p_partkey) AS first_key FROM part GROUP BY 1)
SELECT p_partkey::VARCHAR AS compound_id, e.first_key::DOUBLE AS size FROM part JOIN e USING (p_name)""")
def external_fallback_key(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    gen = part.select(F.col("p_partkey").cast("string").alias("compound_id"), F.col("p_name").alias("canonical_smiles"))
    ext = part.select(F.concat(F.lit("x"), "p_partkey").alias("compound_id"), F.concat(F.lit(" "), "p_name").alias("smiles"), F.col("p_partkey").alias("size"), F.col("p_partkey").alias("row"))
    return external.merge_external(gen, ext, ordinal="row").table.select("compound_id", "size")


@query("external_overlap_report", """WITH l AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT DISTINCT doc_id FROM labels)
SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM l SEMI JOIN r USING (doc_id)) AS matched_keys,
(SELECT count(*) FROM r ANTI JOIN l USING (doc_id)) AS right_only, round((SELECT count(*) FROM l SEMI JOIN r USING (doc_id)) / (SELECT count(*) FROM documents), 6) AS matched_share""")
def external_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return external.overlap_report(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("unmatched_examples", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 5")
def unmatched_examples(spark: SparkSession, d: str) -> DataFrame:
    """Five examples of unmatched ids: the limit is the report's."""
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti").orderBy("doc_id").limit(5)


@query("id_set_operations", """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both,
(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS documents_only""")
def id_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and difference of two id sets in one grouped pass."""
    a = read(spark, d, "documents").select("doc_id", F.lit(1).alias("side"))
    b = read(spark, d, "labels").select("doc_id", F.lit(2).alias("side"))
    sides = a.unionByName(b).groupBy("doc_id").agg(F.max(F.col("side") == 1).alias("a"), F.max(F.col("side") == 2).alias("b"))
    return sides.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("documents_only"))


# -------------------------------------------------------------- column stats

DESCRIPTORS = ["avg_qty", "max_price", "min_discount", "std_tax", "n_returned", "constant"]


def part_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Wide per-part figures; a value is missing where a part has few lines."""
    li = read(spark, d, "lineitem")
    per = li.groupBy("l_partkey").agg(
        F.count("*").alias("n_lines"), F.avg("l_quantity").alias("avg_qty"), F.max("l_extendedprice").alias("max_price"), F.min("l_discount").alias("min_discount"),
        F.stddev_samp("l_tax").alias("std_tax"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("n_returned"),
    )
    part = read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("activity"), "p_brand")
    # both sides are rows: by its file alone ``part`` would seem small enough to send
    wide = part.join(per.hint("merge"), F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("constant", F.lit(5.0))
    sparse = F.when(F.col("n_lines") >= 22, F.col("max_price"))
    return wide.withColumn("max_price", sparse).select("p_partkey", "activity", "p_brand", *DESCRIPTORS)


WIDE = """wide AS (SELECT p_partkey, p_retailprice AS activity, p_brand, avg_qty, CASE WHEN n_lines >= 22 THEN max_price END AS max_price, min_discount, std_tax, n_returned, 5.0::DOUBLE AS constant
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, avg(l_quantity) AS avg_qty, max(l_extendedprice) AS max_price, min(l_discount) AS min_discount, stddev_samp(l_tax) AS std_tax,
(count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS n_returned FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
long AS (SELECT p_partkey, unnest(['avg_qty', 'max_price', 'min_discount', 'std_tax', 'n_returned', 'constant']) AS descriptor, unnest([avg_qty, max_price, min_discount, std_tax, n_returned, constant]) AS value FROM wide),
med AS (SELECT descriptor, count(*) AS n, count(value) AS present, median(value) AS median FROM long GROUP BY 1),
filled AS (SELECT l.p_partkey, descriptor, coalesce(value, median) AS value FROM long l JOIN med USING (descriptor)),
stats AS (SELECT descriptor, stddev_samp(value) AS std, stddev_pop(value) AS scale, avg(value) AS mean FROM filled GROUP BY 1),
fitted AS (SELECT m.*, s.std, s.scale, s.mean, CASE WHEN present = 0 THEN 'nonnumeric' WHEN 1 - present / n > 0.2 THEN 'missing>0.2' WHEN std = 0 THEN 'constant' WHEN std < 0.01 THEN 'near_constant_std<0.01' END AS reason
FROM med m LEFT JOIN stats s USING (descriptor))"""


def part_long(spark: SparkSession, d: str) -> DataFrame:
    return colstats.to_long(part_descriptors(spark, d), "p_partkey", DESCRIPTORS)


@query("col_missing_fraction", f"WITH {WIDE} SELECT descriptor, round(1 - present / n, 6) AS missing_fraction FROM med")
def col_missing_fraction(spark: SparkSession, d: str) -> DataFrame:
    return colstats.medians(part_long(spark, d)).select("descriptor", r6(1 - F.col("present") / F.col("n")).alias("missing_fraction"))


@query("col_median_impute", f"WITH {WIDE} SELECT p_partkey, descriptor, round(value, 6) AS value FROM filled WHERE value IS NOT NULL")
def col_median_impute(spark: SparkSession, d: str) -> DataFrame:
    long = part_long(spark, d)
    return colstats.impute(long, colstats.medians(long)).where("value is not null").select("p_partkey", "descriptor", r6(F.col("value")).alias("value"))


@query("col_std_filters", f"WITH {WIDE} SELECT descriptor, round(median, 6) AS median, round(std, 6) AS std, round(mean, 6) AS mean, reason FROM fitted")
def col_std_filters(spark: SparkSession, d: str) -> DataFrame:
    fitted = colstats.filter_reasons(part_long(spark, d))
    return fitted.select("descriptor", r6(F.col("median")).alias("median"), r6(F.col("std")).alias("std"), r6(F.col("mean")).alias("mean"), "reason")


@query("removal_reasons", f"""WITH {WIDE} SELECT bucket, count(reason) AS n_removed FROM (VALUES ('nonnumeric'), ('missing'), ('constant'), ('near_constant'), ('correlated')) b(bucket)
LEFT JOIN fitted ON starts_with(reason, bucket) GROUP BY 1""")
def removal_reasons(spark: SparkSession, d: str) -> DataFrame:
    return colstats.reason_counts(colstats.filter_reasons(part_long(spark, d)))


SPLIT = "CASE WHEN place <= ceil(0.2 * n) AND n > 5 THEN 'test' ELSE 'train' END"
SPLITS = f"""splits AS (SELECT p_partkey, p_brand AS cluster, activity, {SPLIT} AS split FROM (SELECT p_partkey, p_brand, activity,
row_number() OVER (PARTITION BY p_brand ORDER BY md5('42:' || p_partkey), p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM wide))"""
TRAINED = f"""{WIDE.split('med AS')[0]} {SPLITS}, med AS (SELECT descriptor, count(*) AS n, count(value) AS present, median(value) AS median FROM long JOIN splits USING (p_partkey) WHERE split = 'train' GROUP BY 1),
stats AS (SELECT descriptor, stddev_samp(coalesce(value, median)) AS std, stddev_pop(coalesce(value, median)) AS scale, avg(coalesce(value, median)) AS mean FROM long JOIN splits USING (p_partkey) JOIN med USING (descriptor) WHERE split = 'train' GROUP BY 1),
kept AS (SELECT * FROM med JOIN stats USING (descriptor) WHERE present > 0 AND 1 - present / n <= 0.2 AND std >= 0.01)"""


def part_split(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_split(part_descriptors(spark, d).withColumnRenamed("p_brand", "cluster"), "p_partkey")


@query("zscore_fit_transform", f"""WITH {TRAINED} SELECT p_partkey, split, descriptor, round((coalesce(value, median) - mean) / scale, 6) AS value FROM long JOIN splits USING (p_partkey) JOIN kept USING (descriptor)""")
def zscore_fit_transform(spark: SparkSession, d: str) -> DataFrame:
    """Statistics from train rows alone, applied to train and test."""
    parts = staged(part_split(spark, d), "zscore-rows")
    long = colstats.to_long(parts, "p_partkey", DESCRIPTORS, ("split",))
    fitted = colstats.filter_reasons(long.where("split = 'train'").drop("split"))
    return colstats.zscore(long, fitted).select("p_partkey", "split", "descriptor", r6(F.col("value")).alias("value"))


EMBEDDED = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
PAIRS = f"""{EMBEDDED}, c AS (SELECT vec_id, label, i, v - avg(v) OVER (PARTITION BY i) AS v FROM e),
corrs AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS r FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2)"""
NAME = "'d' || lpad({}::VARCHAR, 3, '0')"


def dims_of(df: DataFrame, col: str) -> int:
    return df.agg(F.max(F.size(col))).first()[0]


def embedding_names(n: int) -> list[str]:
    return [f"d{i:03d}" for i in range(n)]


@query("corr_pairs", f"WITH {PAIRS} SELECT {NAME.format('i')} AS first, {NAME.format('j')} AS second, round(r, 6) AS r FROM corrs")
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    n = dims_of(e, "embedding")
    return colstats.corr_pairs(spark, colstats.correlation(e, "embedding", n), embedding_names(n)).withColumn("r", r6(F.col("r")))


@query("corr_with_target", f"WITH {EMBEDDED} SELECT {NAME.format('i')} AS descriptor, round(corr(v, label), 6) AS r FROM e GROUP BY i")
def corr_with_target(spark: SparkSession, d: str) -> DataFrame:
    long = colstats.vector_to_long(read(spark, d, "embeddings"), "vec_id", "embedding")
    y = read(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"))
    return long.join(y, "vec_id").groupBy("descriptor").agg(r6(F.corr("value", "y")).alias("r"))


@query("corr_prune_simple", f"WITH {PAIRS} SELECT DISTINCT {NAME.format('j')} AS descriptor FROM corrs WHERE r > 0.08")
def corr_prune_simple(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    n = dims_of(e, "embedding")
    gone = colstats.simple_prune(colstats.correlation(e, "embedding", n), embedding_names(n), 0.08)
    return spark.createDataFrame([(g,) for g in gone], "descriptor string")


GREEDY = f"""WITH RECURSIVE {PAIRS}, tc AS (SELECT i, abs(corr(v, label)) AS t FROM e GROUP BY 1),
o AS (SELECT row_number() OVER (ORDER BY abs(r) DESC, i, j) AS k, {NAME.format('i')} AS first, {NAME.format('j')} AS second, (SELECT t FROM tc WHERE tc.i = corrs.i) AS ti, (SELECT t FROM tc WHERE tc.i = corrs.j) AS tj FROM corrs WHERE abs(r) > 0.08),
l AS (SELECT k, first, second, CASE WHEN ti < tj THEN first ELSE second END AS lose, CASE WHEN ti < tj THEN second ELSE first END AS win FROM o),
g(k, gone, because) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT l.k, CASE WHEN list_contains(gone, first) OR list_contains(gone, second) THEN gone ELSE list_append(gone, lose) END,
CASE WHEN list_contains(gone, first) OR list_contains(gone, second) THEN because ELSE list_append(because, win) END FROM g JOIN l ON l.k = g.k + 1)
SELECT unnest(gone) AS dropped, unnest(because) AS because_of FROM g WHERE k = (SELECT max(k) FROM g)"""


@query("corr_prune_greedy", GREEDY)
def corr_prune_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by falling correlation; of each the one farther from the target goes, unless either is gone."""
    e = read(spark, d, "embeddings")
    n = dims_of(e, "embedding")
    return blocked.prune_correlated(e, "embedding", "label", embedding_names(n), 0.08, block=16)


# --------------------------------------------------------------------- split

@query("cluster_split", f"WITH {WIDE}, {SPLITS} SELECT p_partkey, cluster, split FROM splits")
def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    return part_split(spark, d).select("p_partkey", "cluster", "split")


@query("split_stats", f"WITH {WIDE}, {SPLITS} SELECT split, count(*) AS n, round(avg(activity), 6) AS mean_activity, round(stddev_samp(activity), 6) AS std_activity FROM splits GROUP BY 1")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return split.split_stats(part_split(spark, d))


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"))


@query("split_disjoint", f"WITH {WIDE}, {SPLITS} SELECT count(*) AS n_shared FROM (SELECT p_partkey FROM splits WHERE split = 'train' INTERSECT SELECT p_partkey FROM splits WHERE split = 'test')")
def split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    parts = part_split(spark, d)
    return parts.groupBy("p_partkey").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_shared"))


FOLD = "(('0x' || substr(md5('42:' || p_partkey), 1, 8))::BIGINT % 5)::INTEGER"


@query("kfold_assign", f"SELECT p_partkey, {FOLD} AS fold FROM part")
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return split.assign_folds(read(spark, d, "part").select("p_partkey"), "p_partkey")


SIL = """d AS (SELECT a.vec_id, a.label, b.label AS to_label, sum(sqrt(greatest(0, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))))) AS s, count(*) AS n
FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(CASE WHEN label = to_label AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> to_label THEN s / n END) AS b FROM d GROUP BY 1, 2)"""


@query("silhouette_scores", f"WITH {SIL} SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY 1")
def silhouette_scores(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    per = split.silhouette(e, "vec_id", "embedding", "label")
    return per.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("silhouette")).alias("silhouette"))


DB = f"""WITH {EMBEDDED}, c AS (SELECT label, i, avg(v) AS c FROM e GROUP BY 1, 2),
o AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, e.label, sqrt(sum((v - c) * (v - c))) AS d FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
w AS (SELECT la, max((x.s + y.s) / m) AS worst FROM m JOIN o x ON x.label = la JOIN o y ON y.label = lb GROUP BY 1)
SELECT round(avg(worst), 6) AS davies_bouldin FROM w"""


@query("davies_bouldin", DB)
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return spark.createDataFrame([(round(split.davies_bouldin(e, "vec_id", "embedding", "label"), 6),)], "davies_bouldin double")


# ------------------------------------------------------- metrics and choices

def predictions(spark: SparkSession, d: str) -> DataFrame:
    """A fixed linear predictor, so that every engine scores alike."""
    parts = part_split(spark, d)
    fold = split.assign_folds(parts, "p_partkey")
    return fold.withColumn("predicted", 1000 + 12 * F.col("avg_qty") + 5 * F.col("n_returned")).where("predicted is not null")


PREDICTED = f"""{WIDE}, {SPLITS}, preds AS (SELECT s.p_partkey, s.cluster, s.split, s.activity, avg_qty, n_returned, {FOLD.replace('p_partkey', 's.p_partkey')} AS fold, 1000 + 12 * avg_qty + 5 * n_returned AS predicted FROM splits s JOIN wide w ON s.p_partkey = w.p_partkey WHERE avg_qty IS NOT NULL)"""
R2 = "1 - sum((activity - predicted) ** 2) / sum((activity - m) ** 2)"


@query("regression_metrics", f"""WITH {PREDICTED} SELECT split, count(*) AS n, round({R2}, 6) AS r2, round(sqrt(avg((activity - predicted) ** 2)), 6) AS rmse, round(avg(abs(activity - predicted)), 6) AS mae
FROM (SELECT *, avg(activity) OVER (PARTITION BY split) AS m FROM preds) GROUP BY 1""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.regression_metrics(predictions(spark, d), ["split"])
    return m.select("split", "n", r6(F.col("r2")).alias("r2"), r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"))


def fold_table(spark: SparkSession, d: str) -> DataFrame:
    """Train and validation r2 of each fold and brand group: all rows meet all folds once."""
    p = predictions(spark, d).where("split = 'train'").select("activity", "predicted", F.col("fold").alias("own"), F.explode(F.array(*map(F.lit, range(5)))).alias("fold"))
    m = evaluate.regression_metrics(p.withColumn("part", F.when(F.col("own") == F.col("fold"), "val").otherwise("train")), ["fold", "part"])
    return m.groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("r2"))).alias("train_r2"), F.max(F.when(F.col("part") == "val", F.col("r2"))).alias("val_r2"))


FOLDS = f"""{PREDICTED}, folds AS (SELECT fold, max(CASE WHEN part = 'train' THEN r2 END) AS train_r2, max(CASE WHEN part = 'val' THEN r2 END) AS val_r2 FROM (
SELECT fold, part, {R2} AS r2 FROM (SELECT *, avg(activity) OVER (PARTITION BY fold, part) AS m FROM (
SELECT activity, predicted, f.fold, CASE WHEN p.fold = f.fold THEN 'val' ELSE 'train' END AS part FROM preds p, (SELECT unnest(range(5)) AS fold) f WHERE split = 'train')) GROUP BY 1, 2) GROUP BY 1)"""


@query("fold_metrics", f"WITH {FOLDS} SELECT fold::INTEGER AS fold, round(train_r2, 6) AS train_r2, round(val_r2, 6) AS val_r2 FROM folds")
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return fold_table(spark, d).select("fold", r6(F.col("train_r2")).alias("train_r2"), r6(F.col("val_r2")).alias("val_r2"))


@query("cv_summary", f"WITH {FOLDS} SELECT round(avg(train_r2), 6) AS mean_train_r2, round(avg(val_r2), 6) AS mean_cv_r2, round(stddev_pop(val_r2), 6) AS std_cv_r2, round(avg(train_r2) - avg(val_r2), 6) AS gap FROM folds")
def cv_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.cv_summary(fold_table(spark, d), [])
    return s.select(*[r6(F.col(c)).alias(c) for c in ("mean_train_r2", "mean_cv_r2", "std_cv_r2", "gap")])


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """A candidate a supplier nation: shares of line figures stand for its scores."""
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("candidate_id")).agg(F.avg("s_acctbal").alias("a"), F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    score = F.col("a") / 10000
    return s.select("candidate_id", F.round(F.least(F.lit(1.0), score + 0.2), 4).alias("mean_train_r2"), F.round(score, 4).alias("mean_cv_r2"), F.round((F.col("hi") - F.col("lo")) / 60000, 4).alias("std_cv_r2"), (F.col("candidate_id") % 4).cast("double").alias("simplicity"))


CANDIDATES = """cands AS (SELECT s_nationkey AS candidate_id, round(least(1.0, a / 10000 + 0.2), 4) AS mean_train_r2, round(a / 10000, 4) AS mean_cv_r2, round((hi - lo) / 60000, 4) AS std_cv_r2, (s_nationkey % 4)::DOUBLE AS simplicity
FROM (SELECT s_nationkey, avg(s_acctbal) AS a, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY 1)),
assessed AS (SELECT *, CASE WHEN std_cv_r2 > 0.15 THEN 'unstable' WHEN mean_train_r2 < 0.4 AND mean_cv_r2 < 0.5 THEN 'underfit' WHEN mean_train_r2 - mean_cv_r2 > 0.15 AND mean_train_r2 > 0.4 THEN 'overfit' WHEN mean_cv_r2 < 0.5 THEN 'poor_performance' ELSE 'good' END AS status FROM cands)"""


@query("overfit_status", f"WITH {CANDIDATES} SELECT candidate_id, status, status = 'good' AS acceptable, mean_train_r2 - mean_cv_r2 > 0.25 AS severe FROM assessed")
def overfit_status(spark: SparkSession, d: str) -> DataFrame:
    return select.assess(candidates(spark, d)).select("candidate_id", "status", "acceptable", "severe")


@query("candidate_rank", f"WITH {CANDIDATES} SELECT candidate_id, mean_cv_r2, (row_number() OVER (ORDER BY mean_cv_r2 DESC, candidate_id))::INTEGER AS rank FROM cands")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return select.rank_candidates(candidates(spark, d)).select("candidate_id", "mean_cv_r2", "rank")


@query("one_se_count", f"""WITH {CANDIDATES}, b AS (SELECT * FROM cands ORDER BY mean_cv_r2 DESC, candidate_id LIMIT 1)
SELECT b.candidate_id AS best_n, round(b.mean_cv_r2 - b.std_cv_r2, 6) AS threshold, min(c.candidate_id) AS selected_n FROM b JOIN cands c ON c.mean_cv_r2 >= b.mean_cv_r2 - b.std_cv_r2 GROUP BY 1, 2""")
def one_se_count(spark: SparkSession, d: str) -> DataFrame:
    out = select.one_se_count(candidates(spark, d).withColumnRenamed("candidate_id", "n_features"))
    return out.select("best_n", r6(F.col("threshold")).alias("threshold"), "selected_n")


SELECTED = """pool AS (SELECT * FROM assessed WHERE status = 'good' OR NOT EXISTS (SELECT 1 FROM assessed WHERE status = 'good')), b AS (SELECT mean_cv_r2, std_cv_r2 FROM pool ORDER BY mean_cv_r2 DESC, candidate_id LIMIT 1)
SELECT candidate_id, mean_cv_r2, simplicity FROM pool WHERE mean_cv_r2 >= (SELECT mean_cv_r2 - std_cv_r2 - 1e-9 FROM b) ORDER BY simplicity, candidate_id LIMIT 1"""


@query("select_final", f"WITH {CANDIDATES}, {SELECTED}")
def select_final(spark: SparkSession, d: str) -> DataFrame:
    return select.select_simplest(select.assess(candidates(spark, d)), "candidate_id").select("candidate_id", "mean_cv_r2", "simplicity")


@query("grid_expand", """SELECT n_name AS estimator, a.v AS depth, b.v AS leaf, c.v AS bootstrap FROM nation, (VALUES (3), (5), (8)) a(v), (VALUES (1), (2)) b(v), (VALUES ('true'), ('false')) c(v)""")
def grid_expand(spark: SparkSession, d: str) -> DataFrame:
    """Grid expansion as chained explodes of value lists: no shuffle, no join."""
    values = lambda *v: F.explode(F.array(*map(F.lit, v)))
    out = read(spark, d, "nation").select(F.col("n_name").alias("estimator"), values(3, 5, 8).alias("depth"))
    return out.withColumn("leaf", values(1, 2)).withColumn("bootstrap", values("true", "false"))


TRUTH = "t AS (SELECT doc_id, quality AS y, (n_chars > 1500)::INTEGER AS yhat, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return read(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("yhat"), F.col("n_chars").cast("double").alias("score"))


@query("classification_metrics", f"""WITH {TRUTH}, k AS (SELECT count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn FROM t)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tn / (tn + fp), 6) AS specificity FROM k""")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.classification_metrics(labelled(spark, d), "y", "yhat")
    return m.select("tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "mcc", "accuracy", "specificity")])


@query("roc_auc_rank", f"""WITH {TRUTH}, p AS (SELECT score FROM t WHERE y = 1), n AS (SELECT score FROM t WHERE y = 0)
SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS auc FROM p, n""")
def roc_auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_auc(labelled(spark, d), "y", "score").select(r6(F.col("auc")).alias("auc"))


# -------------------------------------------------------- domain and models

def one_feature(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select(F.col("p_partkey").alias("compound_id"), "split", "activity", "predicted", F.array("avg_qty").alias("x"))


DOMAIN = f"""{PREDICTED}, tr AS (SELECT count(*) AS n, avg(avg_qty) AS mx, sum((avg_qty - (SELECT avg(avg_qty) FROM preds WHERE split = 'train')) ** 2) AS sxx FROM preds WHERE split = 'train'),
ad AS (SELECT p_partkey AS compound_id, split, 1 / tr.n + (avg_qty - mx) ** 2 / sxx AS leverage, 6 / tr.n AS h_star, (activity - predicted) / sqrt((SELECT avg((activity - predicted) ** 2) FROM preds)) AS z FROM preds, tr),
cl AS (SELECT *, CASE WHEN leverage > h_star AND abs(z) > 3 THEN 'outside_both' WHEN leverage > h_star THEN 'high_leverage' WHEN abs(z) > 3 THEN 'response_outlier' ELSE 'in_domain' END AS applicability_domain FROM ad)"""


@query("leverage_ad", f"WITH {DOMAIN} SELECT compound_id, split, round(leverage, 6) AS leverage, round(z, 6) AS standardized_residual, applicability_domain FROM cl")
def leverage_ad(spark: SparkSession, d: str) -> DataFrame:
    ad = domain.applicability(one_feature(spark, d), "x", 1)
    return ad.select("compound_id", "split", r6(F.col("leverage")).alias("leverage"), r6(F.col("standardized_residual")).alias("standardized_residual"), "applicability_domain")


@query("ad_summary", f"""WITH {DOMAIN} SELECT split, count(*) AS n, count(*) FILTER (applicability_domain = 'in_domain') AS n_in_domain, round(100.0 * count(*) FILTER (applicability_domain = 'in_domain') / count(*), 6) AS pct_in_domain FROM cl GROUP BY 1""")
def ad_summary(spark: SparkSession, d: str) -> DataFrame:
    return domain.domain_summary(domain.applicability(one_feature(spark, d), "x", 1))


@query("ad_flagged", f"WITH {DOMAIN} SELECT compound_id, split, applicability_domain FROM cl WHERE applicability_domain <> 'in_domain'")
def ad_flagged(spark: SparkSession, d: str) -> DataFrame:
    return domain.flagged_ids(domain.applicability(one_feature(spark, d), "x", 1))


@query("knn_predict", f"""WITH {PREDICTED}, near AS (SELECT q.p_partkey, t.activity, row_number() OVER (PARTITION BY q.p_partkey ORDER BY sqrt((q.avg_qty - t.avg_qty) ** 2 + (q.n_returned - t.n_returned) ** 2), t.p_partkey) AS r
FROM preds q JOIN preds t ON q.split = 'test' AND t.split = 'train') SELECT p_partkey, round(avg(activity), 4) AS predicted FROM near WHERE r <= 5 GROUP BY 1""")
def knn_predict(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("x", F.array("avg_qty", "n_returned"))
    out = neighbours.knn_predict(p.where("split = 'train'"), p.where("split = 'test'"), "p_partkey", "x", "activity")
    return out.select("p_partkey", F.round("predicted", 4).alias("predicted"))


@query("ols_fit_predict", f"""WITH {PREDICTED}, c AS (SELECT regr_slope(activity, avg_qty) AS b, regr_intercept(activity, avg_qty) AS a FROM preds WHERE split = 'train')
SELECT p_partkey, split, round(a + b * avg_qty, 4) AS predicted FROM preds, c""")
def ols_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    p = staged(predictions(spark, d), "ols-rows")
    c = p.where("split = 'train'").agg(F.regr_slope("activity", "avg_qty").alias("b"), F.regr_intercept("activity", "avg_qty").alias("a")).first()
    return p.select("p_partkey", "split", F.round(F.lit(c["a"]) + F.lit(c["b"]) * F.col("avg_qty"), 4).alias("predicted"))


@query("predictions_union", f"WITH {PREDICTED} SELECT p_partkey AS compound_id, split, round(predicted, 6) AS predicted_activity, round(activity - predicted, 6) AS residual FROM preds")
def predictions_union(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    out = p.where("split = 'train'").unionByName(p.where("split = 'test'"))
    return out.select(F.col("p_partkey").alias("compound_id"), "split", r6(F.col("predicted")).alias("predicted_activity"), r6(F.col("activity") - F.col("predicted")).alias("residual"))


@query("plot_scatter_data", f"""WITH {PREDICTED}, m AS (SELECT least(min(activity), min(predicted)) AS lo, greatest(max(activity), max(predicted)) AS hi FROM preds)
SELECT split, round(activity, 6) AS activity, round(predicted, 6) AS predicted, round(lo - 0.05 * (hi - lo), 6) AS axis_min, round(hi + 0.05 * (hi - lo), 6) AS axis_max FROM preds, m""")
def plot_scatter_data(spark: SparkSession, d: str) -> DataFrame:
    out = plots.plot_scatter(predictions(spark, d))
    return out.select("split", *[r6(F.col(c)).alias(c) for c in ("activity", "predicted", "axis_min", "axis_max")])


@query("plot_williams_data", f"WITH {DOMAIN} SELECT round(leverage, 6) AS leverage, round(z, 6) AS standardized_residual, split, round(h_star, 6) AS h_star FROM cl")
def plot_williams_data(spark: SparkSession, d: str) -> DataFrame:
    out = plots.plot_williams(domain.applicability(one_feature(spark, d), "x", 1))
    return out.select(*[r6(F.col(c)).alias(c) for c in ("leverage", "standardized_residual")], "split", r6(F.col("h_star")).alias("h_star"))


@query("binarise_labels", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS y FROM customer")
def binarise_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("y"))


WRITTEN = "CASE p_size % 5 WHEN 0 THEN 'ni' WHEN 1 THEN p_size::VARCHAR || '/4' WHEN 2 THEN ' ' || p_retailprice::VARCHAR || ' ' WHEN 3 THEN '0' ELSE p_brand END"


@query("regression_labels", f"""WITH w AS (SELECT p_partkey, p_size, p_retailprice, {WRITTEN} AS response FROM part)
SELECT p_partkey, (response <> 'ni')::INTEGER AS active, CASE p_size % 5 WHEN 1 THEN p_size / 4.0 WHEN 2 THEN p_retailprice END::DOUBLE AS value FROM w""")
def regression_labels(spark: SparkSession, d: str) -> DataFrame:
    """Classes and numbers of one response column that holds marks, quotients, numbers and other text; parts stand for samples."""
    size = F.col("p_size") % 5
    response = (
        F.when(size == 0, "ni").when(size == 1, F.concat(F.col("p_size").cast("string"), F.lit("/4")))
        .when(size == 2, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" "))).when(size == 3, "0").otherwise(F.col("p_brand"))
    )
    part = read(spark, d, "part").select("p_partkey", response.alias("response"))
    return part.select("p_partkey", inactive(F.col("response")).cast("int").alias("active"), measured(F.col("response")).alias("value"))


@query("example_split", f"WITH {WIDE}, {SPLITS} SELECT p_partkey, cluster, split FROM splits")
def example_split(spark: SparkSession, d: str) -> DataFrame:
    """Train and test tables of the split by clusters, put together again."""
    train, test = split.cluster_tables(part_descriptors(spark, d).withColumnRenamed("p_brand", "cluster"), "p_partkey")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.select("p_partkey", "cluster", "split")


@query("event_drift", """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(value) AS n, round(avg(value), 6) AS mean_value, round((avg(value) - 50) * sqrt(count(value)) / 10, 6) AS drift_z FROM events GROUP BY 1""")
def event_drift(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming monitor."""
    return monitor.drift(read(spark, d, "events"), "ts", "value", 50.0, 10.0)
