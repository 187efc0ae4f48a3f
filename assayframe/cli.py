"""Command line: run the dataflow on a CSV, or search again from a stored run."""
from __future__ import annotations

import argparse
import importlib
import logging.config
import shlex

from .operators import backend, external
from .plans import workflow
from .session import get_spark
from .sources import artifacts, tables


#: stages of a run on standard error; libraries' own loggers stay as they are
LOGGING = {
    "version": 1,
    "disable_existing_loggers": False,
    "formatters": {"stage": {"format": "{asctime} {message}", "style": "{", "datefmt": "%H:%M:%S"}},
    "handlers": {"stages": {"class": "logging.StreamHandler", "formatter": "stage"}},
    "loggers": {"assayframe.run": {"level": "INFO", "handlers": ["stages"], "propagate": False}},
}


def named(reference: str | None):
    """The function of ``module:function``, a proposer of grids."""
    if not reference:
        return None
    module, _, function = reference.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="assayframe")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="validate, model and report a CSV of compounds")
    run.add_argument("csv")
    run.add_argument("--structure", default="smiles")
    run.add_argument("--activity", default="activity")
    run.add_argument("--compound-id")
    run.add_argument("--external", help="CSV of external descriptors, rows in file order")
    run.add_argument("--backend", help="command of an outside program that answers lines of JSON")
    run.add_argument("--backend-descriptors", default="", help="its descriptors, with commas between")
    run.add_argument("--backend-seconds", type=float, default=600.0, help="time for each compound")
    run.add_argument("--disable-fallback", action="store_true", help="model with the first estimator only")
    again = sub.add_parser("resume", help="tune again on a stored run")
    again.add_argument("run_dir", nargs="?", help="the run's folder; or give --run-id")
    again.add_argument("--estimator", default="random_forest")
    again.add_argument("--run-final-model", action="store_true", help="fit and store the chosen model")
    score = sub.add_parser("score", help="predict the compounds of a CSV with a stored run's model")
    score.add_argument("csv")
    score.add_argument("run_dir")
    score.add_argument("--structure", default="smiles")
    score.add_argument("--compound-id", default="compound_id")
    score.add_argument("--to", required=True, help="folder for the predictions")
    for q in (run, again):
        q.add_argument("--output-root", "--out", default="outputs")
        q.add_argument("--run-id", default=None)
        q.add_argument("--disable-hpo", action="store_true", help="baseline only, no tuning rounds")
        q.add_argument("--proposer", help="module:function that gives the grids")
        q.add_argument("--max-rounds", type=int, default=3)
        q.add_argument("--max-candidates", type=int, default=120)
        q.add_argument("--cv-folds", type=int, default=5)
    a = p.parse_args(argv)
    logging.config.dictConfig(LOGGING)
    log = logging.getLogger("assayframe.run")
    if a.command == "resume" and not (a.run_dir or a.run_id):
        p.error("resume needs a run folder or --run-id")
    spark = get_spark()
    if a.command == "score":
        raw = tables.read_csv(spark, a.csv, None)
        tables.write_csv(workflow.score_compounds(spark, a.run_dir, raw, a.compound_id, a.structure).select(a.compound_id, "predicted"), a.to)
        return 0
    rounds = 0 if a.disable_hpo else a.max_rounds
    if a.command == "resume":
        folder = a.run_dir or str(artifacts.run_dir(a.output_root, a.run_id))
        found = workflow.resume_search(spark, folder, a.estimator, rounds, a.max_candidates, a.cv_folds, named(a.proposer), a.run_final_model)
        for s in found.summaries:
            print(f"{s['source']}: CV R2 {s['mean_cv_r2']:.4f} +- {s['std_cv_r2']:.4f} ({s['status']})" + " <- chosen" * (s is found.chosen))
        return 0
    folder = artifacts.run_dir(a.output_root, a.run_id or artifacts.new_run_id())
    artifacts.copy_input(a.csv, folder / "input.csv")
    c = workflow.Config(structure=a.structure, activity=a.activity, compound_id=a.compound_id, rounds=rounds, cap=a.max_candidates, folds=a.cv_folds, tuning=not a.disable_hpo, fallback=not a.disable_fallback)
    extra = tables.read_csv(spark, a.external, external.ORDINAL) if a.external else None
    program = backend.Supervised(shlex.split(a.backend), a.backend_seconds) if a.backend else None
    names = [n for n in a.backend_descriptors.split(",") if n]
    told = lambda e: log.info("%s: %s in %s s", e["stage"], e["status"], e["seconds"])
    workflow.run(spark, tables.read_csv(spark, a.csv), c, extra, str(folder), told, named(a.proposer), program, names)
    artifacts.zip_run(folder, folder / "run.zip")
    print((folder / "report.md").read_text())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
