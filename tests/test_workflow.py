"""The whole dataflow on thirty molecules."""
from assayframe.plans import workflow
from assayframe.sources import tables

SMILES = "C CC CCC CCCC CCCCC CCO CCCO CCCCO c1ccc(O)cc1 CCN CCCN CC(C)O CC(C)N CC(=O)O CCC(=O)O c1ccccc1 Cc1ccccc1 CCc1ccccc1 Clc1ccccc1 Brc1ccccc1 Fc1ccccc1 Nc1ccccc1 OCc1ccccc1 C1CCCCC1 OC1CCCCC1 NC1CCCCC1 CC#N CCC#N CSC c1ccccc1O".split()


def test_run(spark, tmp_path):
    (tmp_path / "in.csv").write_text("compound_id,smiles,y\n" + "".join(f"C{i:03d},{s},{i * 0.5 + i % 3 * 0.1}\n" for i, s in enumerate(SMILES)))
    raw = tables.read_csv(spark, str(tmp_path / "in.csv"))
    c = workflow.Config(activity="y", compound_id="compound_id", k_range=(2, 3), sfs_features=2, population=6, generations=2, rounds=1, cap=4, estimator="pls", params={"n_components": 2}, fallbacks=("knn",), folds=3)
    r = workflow.run(spark, raw, c, out_dir=str(tmp_path / "out"))
    assert r.report["validation"]["duplicates"] == 1 and r.report["validation"]["valid_rows"] == 29
    assert [x["stage"] for x in r.log] == list(workflow.STAGES) and all(x["status"] == "Completed" for x in r.log)
    assert {m["split"] for m in r.report["metrics"]} == {"train", "test"} and (tmp_path / "out" / "report.md").exists()
    again = workflow.resume_search(spark, str(tmp_path / "out"), "pls", rounds=1, cap=2, folds=3)
    assert again.summaries[0]["source"] == "baseline"
    judged = r.tables["branch_evaluation"].collect()
    assert {b["branch"] for b in judged} >= {r.report["winner_branch"]} and all(b["test_n"] and b["train_n"] for b in judged)
    of_winner = next(b for b in judged if b["branch"] == r.report["winner_branch"])
    assert abs(of_winner["test_rmse"] - next(m["rmse"] for m in r.report["metrics"] if m["split"] == "test")) < 1e-9
    assert set(r.report["skipped_expansions"]) <= {"pls", "knn"}
    # a stored model scores the same compounds alike, and others whatever their order and columns
    new = workflow.score_compounds(spark, str(tmp_path / "out"), raw.drop("y").orderBy("smiles"), "compound_id", "smiles")
    old = {x["compound_id"]: x["predicted"] for x in r.tables["predictions"].collect()}
    got = {x["compound_id"]: x["predicted"] for x in new.collect()}
    assert set(old) < set(got) and all(abs(got[k] - v) < 1e-6 for k, v in old.items())
    before = (tmp_path / "out" / "final_model" / "model.json").read_text()
    workflow.resume_search(spark, str(tmp_path / "out"), "knn", rounds=0, folds=3, proposer=lambda *a: None, final=True)
    assert "knn" in (tmp_path / "out" / "final_model" / "model.json").read_text() != before
    assert workflow.score_compounds(spark, str(tmp_path / "out"), raw, "compound_id", "smiles").count() == 30


def test_proposer_and_failing_branch(spark, tmp_path, monkeypatch):
    (tmp_path / "in.csv").write_text("compound_id,smiles,y\n" + "".join(f"C{i:03d},{s},{i * 7 % 11}\n" for i, s in enumerate(SMILES)))
    raw = tables.read_csv(spark, str(tmp_path / "in.csv"))
    asked = []
    propose = lambda estimator, status, summaries: asked.append((estimator, status, len(summaries))) or {"n_components": [1, 99]}
    whole = workflow.branch

    def branch(spark, data, c, estimator, *rest):
        if estimator == "svr":
            raise RuntimeError("no such luck")
        return whole(spark, data, c, estimator, *rest)

    monkeypatch.setattr(workflow, "branch", branch)
    c = workflow.Config(activity="y", compound_id="compound_id", k_range=(2, 2), sfs_features=1, population=4, generations=1, rounds=1, cap=4, estimator="pls", params={"n_components": 1}, fallbacks=("svr",), folds=3, expand_by=0)
    r = workflow.run(spark, raw, c, proposer=propose)
    assert asked and asked[0][0] == "pls" and r.report["failed_branches"] == {"svr": "no such luck"}
    assert r.report["skipped_expansions"] == {"pls": "disabled"}
    assert "Branch svr failed" in workflow.markdown(r) and "## Feature count" not in workflow.markdown(r)


def test_outside_descriptors_join_by_structure(spark, tmp_path, monkeypatch):
    """Ids that do not match, structures written otherwise: the run joins them."""
    (tmp_path / "in.csv").write_text("compound_id,smiles,y\n" + "".join(f"C{i:03d},{s},{i * 7 % 11}\n" for i, s in enumerate(SMILES)))
    (tmp_path / "more.csv").write_text("compound_id,smiles,logp\n" + "".join(f"other{i},{s},{i + i % 4}\n" for i, s in enumerate(["OCC", "OCCC", "Oc1ccccc1", "NCC", "CCCC", "N#CC", *SMILES[14:29]])))
    raw, extra = (tables.read_csv(spark, str(tmp_path / f)) for f in ("in.csv", "more.csv"))
    extra = extra.withColumnRenamed("original_row_index", "external_row_index")
    c = workflow.Config(activity="y", compound_id="compound_id", k_range=(2, 2), sfs_features=1, population=4, generations=1, rounds=0, estimator="pls", params={"n_components": 1}, fallback=False, folds=3, expand_by=0, max_missing=0.5)
    r = workflow.run(spark, raw, c, extra)
    assert r.report["external"]["key"] == "canonical_smiles" and any("joined on structure" in w for w in r.report["external"]["warnings"])
    assert "logp" in {*r.tables["matrix"].columns, *r.report["removed"]}
