"""Report-shaped queries: counts, top rows, list columns, unions and plot tables."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CANDIDATES, DOMAIN, WIDE, candidates, one_feature, part_long, query, read
from .catalog_models import ga_select, hpo_rounds, sfs_select, training
from .functions.molecule import canonical_column
from .functions.scalars import r6
from .operators import colstats, domain, external, plots, registry, search, select
from .operators.branches import unique_branches
from .operators.oversample import oversample
from .sources import tables
from .streaming import arrivals


@query("variance_threshold", f"WITH {WIDE} SELECT descriptor, round(var_samp(value), 6) AS variance FROM filled GROUP BY 1 HAVING var_samp(value) > 0.01")
def variance_threshold(spark: SparkSession, d: str) -> DataFrame:
    long = part_long(spark, d)
    filled = colstats.impute(long, colstats.medians(long))
    return filled.groupBy("descriptor").agg(F.var_samp("value").alias("variance")).where("variance > 0.01").withColumn("variance", r6(F.col("variance")))


@query("constant_columns", f"WITH {WIDE} SELECT descriptor FROM long GROUP BY 1 HAVING count(DISTINCT value) = 1")
def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    """A column is constant where least and greatest agree: no distinct count is needed."""
    return part_long(spark, d).groupBy("descriptor").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a = b").select("descriptor")


@query("columns_with_missing", f"WITH {WIDE} SELECT count(*) AS n_columns FROM med WHERE present < n")
def columns_with_missing(spark: SparkSession, d: str) -> DataFrame:
    return colstats.medians(part_long(spark, d)).agg(F.count_if(F.col("present") < F.col("n")).alias("n_columns"))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("generation_stats", "SELECT event_type AS generation, max(value) AS best_fitness, min(value) AS least_fitness, round(avg(value), 6) AS avg_fitness, round(stddev_pop(value), 6) AS std_fitness FROM events GROUP BY 1")
def generation_stats(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("generation"))
    return e.agg(F.max("value").alias("best_fitness"), F.min("value").alias("least_fitness"), r6(F.avg("value")).alias("avg_fitness"), r6(F.stddev_pop("value")).alias("std_fitness"))


@query("candidate_top5", f"WITH {CANDIDATES} SELECT candidate_id, mean_cv_r2 FROM cands ORDER BY mean_cv_r2 DESC, candidate_id LIMIT 5")
def candidate_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five candidates a proposer is shown; the limit is the feature."""
    return select.rank_candidates(candidates(spark, d)).where("rank <= 5").select("candidate_id", "mean_cv_r2")


@query("ad_id_lists", f"WITH {DOMAIN} SELECT applicability_domain, list(compound_id ORDER BY compound_id)::VARCHAR AS ids FROM cl WHERE applicability_domain <> 'in_domain' GROUP BY 1")
def ad_id_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ordered id lists of the compounds outside the domain, as the report shows them."""
    flagged = domain.flagged_ids(domain.applicability(one_feature(spark, d), "x", 1))
    ids = F.array_sort(F.collect_list("compound_id"))
    return flagged.groupBy("applicability_domain").agg(F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query("branches_unique", """SELECT branch, p_partkey AS first_key FROM (SELECT p_brand AS branch, p_partkey, 0 AS l FROM part WHERE p_size > 45 UNION ALL SELECT p_brand, p_partkey, 1 FROM part WHERE p_size <= 30)
QUALIFY row_number() OVER (PARTITION BY branch ORDER BY l, p_partkey) = 1""")
def branches_unique(spark: SparkSession, d: str) -> DataFrame:
    """Union of branch lists, the first of each name kept."""
    part = read(spark, d, "part").select(F.col("p_brand").alias("branch"), F.col("p_partkey").alias("place"), "p_size")
    lists = [part.where("p_size > 45").drop("p_size"), part.where("p_size <= 30").drop("p_size")]
    return unique_branches(lists).select("branch", F.col("place").alias("first_key"))


@query("feature_list_concat", "SELECT p_partkey, p_brand || '|' || p_type AS features FROM part")
def feature_list_concat(spark: SparkSession, d: str) -> DataFrame:
    """Fixed and extra features in order, as one list."""
    both = F.concat(F.array("p_brand"), F.array("p_type"))
    return read(spark, d, "part").select("p_partkey", F.array_join(both, "|").alias("features"))


@query("group_best", "SELECT c_mktsegment AS cluster, max(c_acctbal) AS best FROM customer GROUP BY 1")
def group_best(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cluster")).agg(F.max("c_acctbal").alias("best"))


@query("latest_per_conversation", "SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def latest_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"))


# The lists of components of the PLS grids by status, and combinations of the other parameters.
PLS_GRIDS = "('overfit', [2, 3, 5, 8], 4), ('underfit', [10, 15, 20, 30], 4), ('unstable', [5, 8, 10, 15], 1), ('default', [5, 10, 15], 2)"


@query("grid_sizes", f"""WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), g(status, components, rest) AS (VALUES {PLS_GRIDS})
SELECT p_brand, status, (len(components) * rest)::INTEGER AS n_all, (greatest(1, len(list_filter(components, lambda c: c <= least(n // 3, n - 1)))) * rest)::INTEGER AS n_kept FROM n, g""")
def grid_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Combinations of the PLS grids before and after they are fitted to a table; a brand's parts stand for one of a third as many descriptors."""
    sizes = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))

    def fitted(batches):
        for pdf in batches:
            rows = []
            for brand, n in zip(pdf["p_brand"], pdf["n"]):
                for status in ("overfit", "underfit", "unstable", "default"):
                    grid = registry.grid_for("pls", status)
                    kept, _ = registry.sanitise("pls", grid, n // 3, n)
                    kept, _ = registry.shrink(kept, 120)
                    rows.append((brand, status, registry.combinations(grid), registry.combinations(kept)))
            yield pd.DataFrame(rows, columns=["p_brand", "status", "n_all", "n_kept"])

    return sizes.mapInPandas(fitted, "p_brand string, status string, n_all int, n_kept int")


CHAINS = """c AS (SELECT p_partkey, p_retailprice, p_size % 9 + 1 AS k, ['', 'O', 'N'][p_partkey % 3 + 1] AS e FROM part)"""


@query("external_structure_join", f"""WITH {CHAINS}, x AS (SELECT k, e, min_by(p_retailprice, p_partkey) AS price FROM c GROUP BY 1, 2)
SELECT p_partkey::VARCHAR AS compound_id, repeat('C', k::INTEGER) || e AS canonical_smiles, price FROM c JOIN x USING (k, e)""")
def external_structure_join(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors joined by structure, the two sides writing it differently; a chain's length and end come from a part."""
    part = read(spark, d, "part")
    k, end = (F.col("p_size") % 9).cast("int"), F.element_at(F.array(*map(F.lit, ("", "O", "N"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    left = part.select(F.col("p_partkey").cast("string").alias("compound_id"), F.concat(end, F.lit("C"), F.repeat(F.lit("C"), k)).alias("smiles"))
    generated = left.select("compound_id", canonical_column(F.col("smiles")).alias("canonical_smiles"))
    written = F.concat(F.lit(" [CH3]"), F.repeat(F.lit("[CH2]"), k - 1), F.when(k > 0, F.when(end == "", "C").otherwise(F.concat(F.lit("C"), end))).otherwise(end))
    written = F.when(k == 0, F.concat(F.lit("C"), end)).otherwise(written)
    outside = part.select(F.concat(F.lit("x"), "p_partkey").alias("compound_id"), written.alias("smiles"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("row"))
    merged = external.merge_external(generated, outside, ordinal="row", canonical=canonical_column)
    return merged.table.select("compound_id", "canonical_smiles", "price")


@query("stream_first_arrivals", """SELECT user_id, min(event_id) AS event_id, count(*) AS copies FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def stream_first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a stream: the first event of each user, with state in the stream's checkpoint."""
    path = tables.staged_path(spark, "first-arrivals")
    known = read(spark, d, "events").select("user_id", "event_id").schema
    stream = spark.readStream.schema(known).parquet(f"{d}/event[s].parquet")
    found = arrivals.first_arrivals(stream, "user_id", "event_id")
    into = found.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    into.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/rows").select("user_id", "event_id", "copies")


@query("minority_oversample")
def minority_oversample(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("features"))
    return oversample(e, "vec_id", "features", "y", 1)


@query("fold_scores")
def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fold metrics of the five estimators with their defaults on ten features."""
    return search.evaluate(spark, training(spark, d, 10), [(i, e, {}, list(range(10))) for i, e in enumerate(registry.NAMES)])


@query("plot_sfs_data")
def plot_sfs_data(spark: SparkSession, d: str) -> DataFrame:
    return plots.plot_sfs(sfs_select(spark, d), 2)


@query("plot_ga_data")
def plot_ga_data(spark: SparkSession, d: str) -> DataFrame:
    return plots.plot_ga(ga_select(spark, d))


@query("plot_rounds_data")
def plot_rounds_data(spark: SparkSession, d: str) -> DataFrame:
    return plots.plot_rounds(hpo_rounds(spark, d))


@query("plot_split_data")
def plot_split_data(spark: SparkSession, d: str) -> DataFrame:
    from .catalog_models import embeddings
    from .operators import split

    placed = split.cluster(split.embed(embeddings(spark, d)), 4)
    return plots.plot_split(split.stratified_split(placed, "vec_id"))


