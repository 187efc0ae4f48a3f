"""The whole dataflow: 16 stages from a raw compound table to a validated model."""
from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.molecule import canonical_column, descriptor_table
from ..operators import backend as outside
from ..operators import branches as branching
from ..operators import blocked, clean, colstats, domain, evaluate, external, registry, search, split
from ..operators.manifold import umap_embed
from ..sources import models, tables

STAGES = (
    "validation", "descriptors", "external_merge", "embedding", "split", "preprocessing", "feature_selection", "feature_count", "genetic_selection",
    "baseline_cv", "tuning", "expansion", "fallback", "cross_model_selection", "final_model", "applicability_domain",
)


@dataclass
class Config:
    structure: str = "smiles"
    activity: str = "activity"
    compound_id: str | None = None
    min_valid: int = 20
    test_fraction: float = 0.20
    seed: int = 42
    embedding: str = "umap"  # or "pca"
    n_neighbors: int = 15
    min_dist: float = 0.1
    k_range: tuple[int, int] = (2, 10)
    cluster_seed: int = 60
    max_missing: float = 0.20
    min_std: float = 0.01
    max_corr: float = 0.95
    sfs_features: int = 20
    folds: int = 5
    population: int = 50
    generations: int = 30
    rounds: int = 3
    cap: int = 120
    estimator: str = "random_forest"
    params: dict = field(default_factory=dict)
    fallbacks: tuple[str, ...] = ("pls", "extra_trees", "svr", "knn")
    expand_by: int = 2
    tuning: bool = True
    fallback: bool = True


@dataclass
class Run:
    config: Config
    log: list[dict] = field(default_factory=list)
    report: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    scorer: models.Scorer | None = None

    def stage(self, name: str, work, callback=None):
        """Run one stage and keep its status and seconds."""
        began = time.perf_counter()
        entry = {"stage": name, "status": "Running"}
        self.log.append(entry)
        try:
            out = work()
            entry["status"] = "Completed"
            return out
        except Exception as e:
            entry.update(status="Failed", error=str(e))
            raise
        finally:
            entry["seconds"] = round(time.perf_counter() - began, 3)
            if callback:
                callback(dict(entry))


def branch(spark: SparkSession, data: search.Training, c: Config, estimator: str, params: dict, base: bool, proposer=None) -> dict:
    """Selection, count, genetic search and tuning of one estimator.

    ``expansion`` is the wider branch, or None with the reason in ``skipped``.
    """
    rounds = c.rounds if c.tuning else 0
    sfs = search.forward_selection(spark, data, estimator, params, min(c.sfs_features, len(data.names)))
    k = search.one_se(sfs)
    chosen, history = search.genetic_selection(spark, data, k, estimator, params, population=c.population, generations=c.generations, seed=c.seed)
    part = data.select(chosen)
    tuned = search.tune(spark, part, estimator, rounds, c.cap, proposer)
    out = {"estimator": estimator, "features": chosen, "sfs": sfs, "history": history, "summaries": tuned.summaries, "is_expansion": False, **tuned.chosen}
    free = len(data.names) - len(chosen)
    reasons = (("disabled", not c.expand_by), ("branch is acceptable", tuned.chosen["status"] == "good"), ("no descriptor is left", not free), (f"fewer than {c.expand_by} descriptors are left", free < c.expand_by))
    out["skipped"] = next((reason for reason, holds in reasons if holds), None)
    if out["skipped"]:
        out["expansion"] = None
        return out
    used = tuned.chosen["params"] if base else {}  # other estimators expand with their defaults
    more, _ = search.genetic_selection(spark, data, c.expand_by, estimator, used, fixed=chosen, population=c.population, generations=c.generations, seed=c.seed)
    wide = data.select(more)
    again = search.tune(spark, wide, estimator, rounds, c.cap, proposer)
    out["expansion"] = {"estimator": estimator, "features": more, "summaries": again.summaries, "is_expansion": True, **again.chosen}
    return out


def cross_model(branches: list[dict]) -> dict:
    """Greatest mean CV score over acceptable branches (all, if none).

    Simplicity is compared within one estimator only: its scales differ.
    """
    flat = [b for x in branches for b in (x, x.get("expansion")) if b]
    pool = [b for b in flat if b["status"] == "good"] or flat
    best = max(pool, key=lambda b: b["mean_cv_r2"])
    near = [b for b in pool if b["estimator"] == best["estimator"] and b["mean_cv_r2"] >= best["mean_cv_r2"] - best["std_cv_r2"] - 1e-9]
    return min(near, key=lambda b: b["simplicity"])


def run(spark: SparkSession, raw: DataFrame, config: Config | None = None, extra: DataFrame | None = None, out_dir: str | None = None, callback=None, proposer=None, backend: outside.Backend | None = None, backend_descriptors: list[str] | None = None) -> Run:
    """All stages; ``raw`` needs the ordinal that ``tables.read_csv`` adds.

    ``backend`` is an outside program whose ``backend_descriptors`` join those
    of this library; compounds that it fails on are reported and stay.

    ``proposer(estimator, status, summaries)`` may give the grids of the tuning
    rounds.  A fallback branch that fails is reported and the others go on.
    """
    c = config or Config()
    r = Run(c)
    step = lambda name, work: r.stage(name, work, callback)
    keep = tables.staged
    rows, invalid, dups, report = step("validation", lambda: clean.validate(raw, c.structure, c.activity, c.compound_id, c.min_valid, canonical=canonical_column))
    r.report["validation"] = report
    source = raw.select(F.col("original_row_index").cast("long").alias("original_row_index"), F.col(c.structure).alias("__smiles"))
    rows = keep(rows.join(source, "original_row_index"), "rows")
    r.tables |= {"invalid": invalid, "duplicates": dups}

    def describe() -> DataFrame:
        own = descriptor_table(rows, "compound_id", "__smiles")
        if backend is None:
            return keep(own, "descriptors")
        answers = keep(outside.run_backend(rows, "compound_id", "__smiles", backend, backend_descriptors), "backend")
        aligned = outside.align_backend(rows.select("compound_id"), answers, "compound_id")
        r.tables["backend_report"] = outside.backend_report(aligned, "compound_id")
        return keep(own.unionByName(colstats.to_long(aligned, "compound_id", backend_descriptors)), "descriptors")

    long = step("descriptors", describe)

    def merge() -> DataFrame:
        if extra is None:
            return long
        m = external.merge_external(rows.select(*clean.META), extra, canonical=canonical_column)
        r.report["external"] = {"key": m.key, "warnings": m.warnings}
        return keep(long.unionByName(colstats.to_long(m.table, "compound_id", m.features)), "merged")

    long = step("external_merge", merge)

    def embed() -> DataFrame:
        fitted = keep(colstats.filter_reasons(long, 1.0, 0.0), "provisional")
        vectors = keep(colstats.to_vectors(colstats.zscore(long, fitted), "compound_id"), "provisional-vectors")
        if c.embedding == "pca":
            return keep(split.embed(vectors), "embedding")
        return keep(umap_embed(vectors, n_neighbors=c.n_neighbors, min_dist=c.min_dist, seed=c.seed), "embedding")

    embedded = step("embedding", embed)

    def divide() -> DataFrame:
        k, scores = split.choose_k(embedded, "compound_id", *c.k_range, c.cluster_seed)
        r.report["clusters"] = {"k": k, "scores": scores}
        placed = keep(split.cluster(embedded, k, c.cluster_seed), "clusters")
        parts = split.stratified_split(placed, "compound_id", fraction=c.test_fraction, seed=c.seed)
        parts = keep(parts.select("compound_id", "embedding", "cluster", "split"), "split")
        split.check_split(parts, "compound_id")
        return parts

    parts = step("split", divide)

    def preprocess() -> tuple[DataFrame, list[str]]:
        train = keep(long.join(parts.where("split = 'train'").select("compound_id"), "compound_id"), "train")
        fitted = keep(colstats.filter_reasons(train, c.max_missing, c.min_std), "fitted")
        z = colstats.zscore(long, fitted)
        names = [x[0] for x in fitted.where("reason is null").select("descriptor").orderBy("descriptor").collect()]
        if not names:
            raise ValueError("no descriptor is left after the filters")
        vectors = keep(colstats.to_vectors(z, "compound_id").join(rows.select("compound_id", "activity"), "compound_id").join(parts.select("compound_id", "split"), "compound_id"), "vectors")
        pruned = blocked.prune_correlated(vectors.where("split = 'train'"), "features", "activity", names, c.max_corr)
        gone = {x["dropped"]: x["because_of"] for x in pruned.collect()}  # one row a descriptor at most
        r.report["removed"] = {x["descriptor"]: x["reason"] for x in fitted.where("reason is not null").collect()} | {k: f"correlated_with_{v}" for k, v in gone.items()}
        kept = [n for n in names if n not in gone]
        wide = keep(vectors.select("compound_id", "activity", "split", *[F.col("features")[names.index(n)].alias(n) for n in kept]), "matrix")
        return wide, kept, fitted

    wide, names, fitted = step("preprocessing", preprocess)
    data = search.Training.load(wide.where("split = 'train'"), "compound_id", names, "activity", c.folds, c.seed)
    first = step("feature_selection", lambda: branch(spark, data, c, c.estimator, c.params, True, proposer))
    step("feature_count", lambda: r.report.update(features=first["features"]))
    step("genetic_selection", lambda: r.tables.update(ga_history=spark.createDataFrame(first["history"])))
    step("baseline_cv", lambda: r.report.update(baseline=first["summaries"][0]))
    step("tuning", lambda: r.report.update(rounds=first["summaries"][1:]))
    step("expansion", lambda: r.report.update(expansion=bool(first["expansion"])))

    def fall_back() -> list[dict]:
        out: list[dict] = []
        if first["status"] == "good" or not c.fallback:
            return out
        for e in c.fallbacks:
            if e != c.estimator:
                try:
                    out.append(branch(spark, data, c, e, {}, False, proposer))
                except Exception as error:  # the run has other branches
                    r.report.setdefault("failed_branches", {})[e] = str(error)
        return out

    others = step("fallback", fall_back)
    winner = step("cross_model_selection", lambda: cross_model([first, *others]))
    r.report["winner"] = {k: winner[k] for k in ("estimator", "features", "params", "status", "mean_cv_r2", "std_cv_r2", "is_expansion")}
    r.report["branches"] = [{k: b[k] for k in ("estimator", "source", "mean_cv_r2", "gap", "status", "is_expansion")} for x in [first, *others] for b in (x, x["expansion"]) if b]
    r.report["skipped_expansions"] = {x["estimator"]: x["skipped"] for x in [first, *others] if x["skipped"]}

    def final() -> DataFrame:
        table = branching.branch_table(spark, [first, *others])
        predicted = keep(branching.branch_predictions(spark, table, data, wide, seed=c.seed), "branch-predictions")
        judged = branching.branch_evaluation(predicted.join(table.select("branch", "status"), "branch"))
        r.tables["branch_evaluation"] = judged.drop("acceptable", "place").join(table.drop("place"), "branch")
        chosen = spark.createDataFrame([(winner["estimator"], winner["is_expansion"], winner["features"])], "estimator string, is_expansion boolean, features array<string>")
        r.report["winner_branch"] = branching.match_winner(table, chosen).first()["branch"]
        at = [data.names.index(n) for n in winner["features"]]
        model = registry.create(winner["estimator"], winner["params"], c.seed).fit(data.x[:, at], data.y)
        r.scorer = models.Scorer(winner["estimator"], winner["params"], winner["features"], fitted.where("reason is null").select("descriptor", "median", "mean", "scale", "reason"), model)
        ready = wide.select("compound_id", "activity", "split", F.array(*winner["features"]).alias("x"))
        scored = keep(r.scorer.predict(ready, "x"), "predictions")
        r.report["metrics"] = [x.asDict() for x in evaluate.regression_metrics(scored, ["split"]).orderBy("split").collect()]
        return scored

    scored = step("final_model", final)
    ad = step("applicability_domain", lambda: keep(domain.applicability(scored, "x", len(winner["features"])), "domain"))
    r.report["domain"] = [x.asDict() for x in domain.domain_summary(ad).orderBy("split").collect()]
    r.tables |= {"clean": rows.drop("__smiles"), "split": parts, "matrix": wide, "predictions": scored.drop("x"), "applicability_domain": ad.drop("x"), "stage_log": spark.createDataFrame([{"stage": x["stage"], "status": x["status"], "seconds": x["seconds"]} for x in r.log])}
    if out_dir:
        for name, table in r.tables.items():
            tables.write_table(table, f"{out_dir}/{name}")
        models.save(spark, f"{out_dir}/final_model", r.scorer)
        r.report["sfs"] = json.loads(first["sfs"].to_json(orient="records"))
        models.write_text(spark, f"{out_dir}/report.json", json.dumps({"config": asdict(c), **r.report}, indent=2, default=str))
        models.write_text(spark, f"{out_dir}/report.md", markdown(r))
    return r


def table_of(rows: list[dict], columns: list[str]) -> list[str]:
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(columns) + " |", "|---" * len(columns) + "|", *["| " + " | ".join(cell(x.get(c)) for c in columns) + " |" for x in rows], ""]


def markdown(r: Run) -> str:
    """The report: data, descriptors, feature count, tuning, branches, the model and its domain."""
    w, v = r.report["winner"], r.report["validation"]
    reasons: dict[str, int] = {}
    for reason in r.report["removed"].values():
        kind = next((k for k in ("near_constant", "nonnumeric", "missing", "constant", "correlated") if str(reason).startswith(k)), "other")
        reasons[kind] = reasons.get(kind, 0) + 1
    lines = ["# Model report", "", f"Compounds: {v['valid_rows']} of {v['original_rows']} rows; {v['duplicates']} duplicates, {v['invalid_structures']} invalid structures, {v['invalid_activities']} invalid activities.", ""]
    lines += ["## Descriptors", "", f"Removed: {len(r.report['removed'])}.", "", *table_of([{"reason": k, "n": n} for k, n in sorted(reasons.items())], ["reason", "n"])]
    if "sfs" in r.report:
        lines += ["## Feature count", "", *table_of(r.report["sfs"], ["n_features", "mean_train_r2", "mean_cv_r2", "std_cv_r2", "train_r2"])]
    lines += ["## Tuning", "", *table_of([r.report["baseline"], *r.report["rounds"]], ["source", "mean_train_r2", "mean_cv_r2", "std_cv_r2", "gap", "status"])]
    lines += ["## Branches", "", *table_of(r.report["branches"], ["estimator", "source", "mean_cv_r2", "gap", "status", "is_expansion"])]
    lines += [f"No expansion of {e}: {reason}." for e, reason in r.report["skipped_expansions"].items()]
    lines += [f"Branch {e} failed: {error}" for e, error in r.report.get("failed_branches", {}).items()]
    lines += ["", "## Model", "", f"Winner: {w['estimator']} on {', '.join(w['features'])} ({w['status']}, CV R2 {w['mean_cv_r2']:.3f} +- {w['std_cv_r2']:.3f}).", "", *table_of(r.report["metrics"], ["split", "n", "r2", "rmse", "mae"])]
    lines += ["## Applicability domain", "", *table_of(r.report["domain"], ["split", "n", "n_in_domain", "pct_in_domain"])]
    return "\n".join(lines) + "\n"


def score_compounds(spark: SparkSession, folder: str, raw: DataFrame, key: str, smiles: str) -> DataFrame:
    """(key, features, predicted) of new compounds by a stored run's model; structures that do not parse are left out."""
    scorer = models.load(spark, f"{folder}/final_model")
    return scorer.predict(scorer.vectors(descriptor_table(raw, key, smiles), key))


def resume_search(spark: SparkSession, folder: str, estimator: str = "random_forest", rounds: int = 3, cap: int = 120, folds: int = 5, proposer=None, final: bool = False) -> search.Search:
    """Tune again on the stored matrix and features of an earlier run; ``final`` also stores the chosen model in its place."""
    report = json.loads(models.read_text(spark, f"{folder}/report.json"))
    wide = spark.read.parquet(f"{folder}/matrix")
    names = report["winner"]["features"]
    data = search.Training.load(wide.where("split = 'train'"), "compound_id", names, "activity", folds, report["config"]["seed"])
    found = search.tune(spark, data, estimator, rounds, cap, proposer)
    if final:
        old = models.load(spark, f"{folder}/final_model")
        model = registry.create(estimator, found.chosen["params"], report["config"]["seed"]).fit(data.x, data.y)
        fitted = spark.createDataFrame(old.fitted.collect(), old.fitted.schema)  # one row a descriptor; its files are overwritten
        models.save(spark, f"{folder}/final_model", models.Scorer(estimator, found.chosen["params"], names, fitted, model))
    return found
