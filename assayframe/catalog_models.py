"""Model queries: embedding, clusters, estimators and searches (rows-only checks).

Their results depend on seeded iteration that SQL cannot repeat; the tests
check them against plain programmes and known answers.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import dims_of, embedding_names, predictions, query, read
from .operators import search, split
from .operators.forests import fit_forest, forest_column
from .operators.manifold import umap_embed
from .operators.products import FoldProducts
from .operators.scalable import pls_fit
from .oracle_pls import pls_sql
from .sources.tables import staged


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("features"))


def training(spark: SparkSession, d: str, first: int | None = None) -> search.Training:
    """The vectors as a training matrix; of their elements only the ``first`` ones, if a search needs no more."""
    e = embeddings(spark, d)
    names = embedding_names(dims_of(e, "features"))[:first]
    wide = e.select("vec_id", "label", *[F.col("features")[i].alias(c) for i, c in enumerate(names)])
    return search.Training.load(wide, "vec_id", names, "label")


def fold_products(spark: SparkSession, d: str) -> FoldProducts:
    e = embeddings(spark, d)
    names = embedding_names(dims_of(e, "features"))
    wide = e.select("vec_id", "label", *[F.col("features")[i].alias(c) for i, c in enumerate(names)])
    return FoldProducts.load(wide, "vec_id", names, "label")


def fold_rows(spark: SparkSession, d: str) -> FoldProducts:
    """Sums by the folds that a search on rows deals, and the rows beside them."""
    e = embeddings(spark, d)
    names = embedding_names(dims_of(e, "features"))
    dealt = split.permuted_folds(e, "vec_id")
    wide = dealt.select("vec_id", "fold", "label", *[F.col("features")[i].alias(c) for i, c in enumerate(names)])
    return FoldProducts.load(wide, "vec_id", names, "label", fold="fold", keep=True)


@query("kmeans_split")
def kmeans_split(spark: SparkSession, d: str) -> DataFrame:
    placed = split.cluster(split.embed(embeddings(spark, d)), 4)
    return split.stratified_split(placed, "vec_id").select("vec_id", "cluster", "split")


@query("umap_split")
def umap_split(spark: SparkSession, d: str) -> DataFrame:
    """Manifold layout of every vector, clusters of it, and their split; tests hold the layout to its neighbours."""
    laid = staged(umap_embed(embeddings(spark, d)), "umap-split")
    placed = split.cluster(laid, 4)
    out = split.stratified_split(placed, "vec_id")
    return out.select("vec_id", F.col("embedding")[0].alias("umap_1"), F.col("embedding")[1].alias("umap_2"), "cluster", "split")


@query("choose_clusters")
def choose_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The layout is written once; every k and measure reads it."""
    best, scores = split.choose_k(staged(split.embed(embeddings(spark, d)), "choose-clusters"), "vec_id")
    return spark.createDataFrame([(k, float(s), k == best) for k, s in scores.items()], "k int, score double, chosen boolean")


FOREST_COLUMNS = ("avg_qty", "n_returned", "min_discount")


def forest_rows(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).drop("predicted").withColumn("x", F.array(*[F.col(c).cast("double") for c in FOREST_COLUMNS]))


@query("rf_fit_predict")
def rf_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    """The forest of histograms with its defaults, 100 trees of depth 10; tests hold it to the exact kernel."""
    rows = staged(forest_rows(spark, d), "forest-rows")
    forest = fit_forest(rows.where("split = 'train'"), "p_partkey", "x", "activity")
    return rows.select("p_partkey", "split", F.round(forest_column(forest, "x"), 6).alias("predicted"))


@query("et_fit_predict")
def et_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    """Extremely randomised trees with their defaults over the same rows."""
    rows = staged(forest_rows(spark, d), "forest-rows")
    forest = fit_forest(rows.where("split = 'train'"), "p_partkey", "x", "activity", extra=True)
    return rows.select("p_partkey", "split", F.round(forest_column(forest, "x"), 6).alias("predicted"))


@query("pls_fit_predict", pls_sql(3))
def pls_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    model = pls_fit(e, "features", "label", dims_of(e, "features"), 3)
    return e.select("vec_id", F.round(model.column("features"), 6).alias("predicted"))


@query("sfs_select")
def sfs_select(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(search.forward_selection(spark, fold_products(spark, d), "pls", {"n_components": 3}))


@query("ga_select")
def ga_select(spark: SparkSession, d: str) -> DataFrame:
    best, history = search.genetic_selection(spark, fold_products(spark, d), 4, "pls", {"n_components": 3})
    return spark.createDataFrame(history).withColumn("selected", F.array(*map(F.lit, best)))


@query("hpo_rounds")
def hpo_rounds(spark: SparkSession, d: str) -> DataFrame:
    found = search.tune(spark, fold_products(spark, d), "pls")
    rows = [(s["source"], s["mean_train_r2"], s["mean_cv_r2"], s["std_cv_r2"], s["status"], s is found.chosen) for s in found.summaries]
    return spark.createDataFrame(rows, "source string, mean_train_r2 double, mean_cv_r2 double, std_cv_r2 double, status string, selected boolean")


@query("feature_importance")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """Share of each descriptor in what the cuts of a forest gain, the greatest first."""
    rows = staged(forest_rows(spark, d), "forest-rows").where("split = 'train'")
    shares = fit_forest(rows, "p_partkey", "x", "activity").importances().tolist()
    return spark.createDataFrame(list(zip(FOREST_COLUMNS, shares)), "descriptor string, importance double").orderBy(F.desc("importance"))
