"""Queries over branches, stored models, outside descriptors and the wider searches."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import PREDICTED, R2, predictions, query, read
from .catalog_models import embeddings, fold_products, fold_rows, training
from .functions.scalars import r6
from .operators import backend, branches, evaluate, search
from .operators.forests import fit_forest, forest_column
from .operators.products import all_subsets
from .oracle_pls import pls_sql
from .sources.tables import staged

BRANCHED = f"""{PREDICTED}, b AS (SELECT cluster AS branch, split, activity, predicted FROM preds),
m AS (SELECT branch, split, count(*) AS n, {R2} AS r2, sqrt(avg((activity - predicted) ** 2)) AS rmse, avg(abs(activity - predicted)) AS mae FROM (SELECT *, avg(activity) OVER (PARTITION BY branch, split) AS m FROM b) GROUP BY 1, 2),
w AS (SELECT branch, max(r2) FILTER (split = 'train') AS train_r2, max(r2) FILTER (split = 'test') AS test_r2, max(rmse) FILTER (split = 'test') AS test_rmse, max(mae) FILTER (split = 'test') AS test_mae FROM m GROUP BY 1)"""


@query("branch_evaluation", f"""WITH {BRANCHED} SELECT branch, round(train_r2, 6) AS train_r2, round(test_r2, 6) AS test_r2, round(test_rmse, 6) AS test_rmse, round(test_mae, 6) AS test_mae,
branch <> 'Brand#1' AS acceptable, (row_number() OVER (ORDER BY branch <> 'Brand#1' DESC, test_r2 DESC NULLS LAST, branch))::INTEGER AS place FROM w""")
def branch_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Every branch on train and test rows, and its place; a brand of part stands for a branch."""
    p = predictions(spark, d).withColumnRenamed("cluster", "branch")
    out = branches.branch_evaluation(p, F.col("branch") != "Brand#1")
    return out.select("branch", *[r6(F.col(c)).alias(c) for c in ("train_r2", "test_r2", "test_rmse", "test_mae")], "acceptable", "place")


@query("winner_match", """WITH b AS (SELECT p_partkey::VARCHAR AS branch, p_brand AS estimator, p_size % 2 = 0 AS exp, [p_type, p_name] AS f FROM part), w AS (SELECT estimator, exp, f FROM b WHERE branch = '7'),
m AS (SELECT b.branch, b.f = w.f AS exact FROM b JOIN w ON b.estimator = w.estimator AND b.exp = w.exp AND list_sort(b.f) = list_sort(w.f)) SELECT branch, exact FROM m ORDER BY exact DESC, branch LIMIT 1""")
def winner_match(spark: SparkSession, d: str) -> DataFrame:
    """The branch with the winner's estimator, kind and features; parts stand for branches, part 7 for the winner."""
    part = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("branch"), F.col("p_brand").alias("estimator"), (F.col("p_size") % 2 == 0).alias("is_expansion"), F.array("p_type", "p_name").alias("features"))
    return branches.match_winner(part, part.where("branch = '7'"))


@query("backend_alignment", """WITH o AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS o, CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE '' END AS e, l_quantity AS q FROM lineitem WHERE l_quantity > 40),
f AS (SELECT k, e, q FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY o) = 1)
SELECT p_partkey, round(q, 6) AS q, CASE WHEN k IS NULL THEN 'missing' WHEN e <> '' THEN 'error' ELSE 'ok' END AS backend_status FROM part LEFT JOIN f ON k = p_partkey""")
def backend_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an outside program joined back by key, the first of a key; lines of large quantity stand for its output."""
    li = read(spark, d, "lineitem").where("l_quantity > 40")
    out = li.select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.when(F.col("l_returnflag") == "R", "bad").otherwise("").alias("error"), F.col("l_quantity").alias("q"))
    return backend.align_backend(read(spark, d, "part").select("p_partkey"), out, "p_partkey").select("p_partkey", r6(F.col("q")).alias("q"), "backend_status")


@query("whole_data_cv", f"""WITH {PREDICTED} SELECT fold, count(*) AS n, round({R2}, 6) AS r2, round(sqrt(avg((activity - predicted) ** 2)), 6) AS rmse, round(avg(abs(activity - predicted)), 6) AS mae
FROM (SELECT *, avg(activity) OVER (PARTITION BY fold) AS m FROM preds) GROUP BY 1""")
def whole_data_cv(spark: SparkSession, d: str) -> DataFrame:
    """Validation figures of each fold over train and test rows together."""
    p = predictions(spark, d)
    both = p.where("split = 'train'").unionByName(p.where("split = 'test'"))
    return evaluate.regression_metrics(both, ["fold"]).select("fold", "n", *[r6(F.col(c)).alias(c) for c in ("r2", "rmse", "mae")])


@query("model_round_trip", pls_sql(2))
def model_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A fitted model written as tables, read back, and applied to every row."""
    import numpy as np

    from .operators import registry
    from .sources import models

    data = training(spark, d)
    model = registry.create("pls", {"n_components": 2}).fit(data.x, data.y)
    rows = spark.createDataFrame(models.to_rows(model), models.SCHEMA).collect()
    back = models.from_rows("pls", [tuple(r) for r in rows])
    assert np.array_equal(back.coef, model.coef)
    scorer = models.Scorer("pls", {}, data.names, None, back)
    return scorer.predict(embeddings(spark, d)).select("vec_id", F.round("predicted", 6).alias("predicted"))


@query("rf_classify")
def rf_classify(spark: SparkSession, d: str) -> DataFrame:
    """A forest of two classes: label 0 against the rest; the error of a target of 0 and 1 is half of Gini's impurity."""
    rows = staged(embeddings(spark, d).withColumn("y", (F.col("label") == 0).cast("double")), "forest-classes")
    forest = fit_forest(rows, "vec_id", "features", "y")
    share = forest_column(forest, "features")
    return rows.select("vec_id", share.alias("share")).select("vec_id", (F.col("share") > 0.5).cast("int").alias("predicted"), F.round("share", 6).alias("probability"))


PAIR_FITS = """x AS (SELECT vec_id, (('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT % 5)::INTEGER AS f, label::DOUBLE AS y, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT a.f, a.i, b.i AS j, count(*) AS n, sum(a.v) AS sa, sum(b.v) AS sb, sum(a.y) AS sy, sum(a.v * a.v) AS saa, sum(a.v * b.v) AS sab, sum(b.v * b.v) AS sbb, sum(a.v * a.y) AS say, sum(b.v * a.y) AS sby, sum(a.y * a.y) AS syy
FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2, 3),
t AS (SELECT f, i, j, n, sa, sb, sy, saa, sab, sbb, say, sby, syy, {total} FROM p WINDOW w AS (PARTITION BY i, j)),
c AS (SELECT *, tsaa - tsa * tsa / tn AS caa, tsab - tsa * tsb / tn AS cab, tsbb - tsb * tsb / tn AS cbb, tsay - tsa * tsy / tn AS cay, tsby - tsb * tsy / tn AS cby, tsyy - tsy * tsy / tn AS cyy FROM t),
b AS (SELECT *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS b1, (cby * caa - cay * cab) / (caa * cbb - cab * cab) AS b2 FROM c),
s AS (SELECT *, (tsy - b1 * tsa - b2 * tsb) / tn AS b0 FROM b),
r AS (SELECT i, j, (b1 * cay + b2 * cby) / cyy AS train, 1 - (syy - 2 * (b0 * sy + b1 * say + b2 * sby) + n * b0 * b0 + 2 * b0 * (b1 * sa + b2 * sb) + b1 * b1 * saa + b2 * b2 * sbb + 2 * b1 * b2 * sab) / (syy - sy * sy / n) AS cv FROM s)""".replace(
    "{total}", ", ".join(f"sum({c}) OVER w - {c} AS t{c}" for c in ("n", "sa", "sb", "sy", "saa", "sab", "sbb", "say", "sby", "syy"))
)


@query("exhaustive_select", f"""WITH {PAIR_FITS} SELECT ['d' || lpad(i::VARCHAR, 3, '0'), 'd' || lpad(j::VARCHAR, 3, '0')] AS selected_features,
round(avg(train), 6) AS mean_train_r2, round(avg(cv), 6) AS mean_cv_r2, round(stddev_pop(cv), 6) AS std_cv_r2 FROM r GROUP BY i, j""")
def exhaustive_select(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the 64 features under cross-validation; two components of two features are least squares."""
    got = all_subsets(spark, fold_products(spark, d), 2, {"n_components": 2})
    return got.select("selected_features", *[r6(F.col(c)).alias(c) for c in ("mean_train_r2", "mean_cv_r2", "std_cv_r2")])


@query("two_objective_select")
def two_objective_select(spark: SparkSession, d: str) -> DataFrame:
    """The front of subsets of 4 features by CV r2 and CV error."""
    return spark.createDataFrame(search.two_objective_selection(spark, fold_rows(spark, d), 4, "pls", {"n_components": 3}))


@query("mcc_sfs_select")
def mcc_sfs_select(spark: SparkSession, d: str) -> DataFrame:
    """Forward selection led by Matthews' coefficient of labels under 5 against the rest."""
    data = training(spark, d)
    data.y = (data.y < 5).astype(float)
    return spark.createDataFrame(search.forward_selection(spark, data, "pls", {"n_components": 3}, scorer="mcc"))

