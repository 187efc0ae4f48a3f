"""Operators on small fixtures with known answers."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.functions.molecule import canonical, canonical_column, descriptor_table, parse
from assayframe.operators import clean, colstats, domain, evaluate, external, neighbours, ranks, registry, search, select, split
from assayframe.operators.scalable import pls_fit
from assayframe.sources import artifacts, tables
from assayframe.streaming import monitor


def compounds(spark, rows, schema="smiles string, activity string"):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return tables.with_ordinal(df, "original_row_index")


@pytest.mark.parametrize("a, b", [("c1ccc(O)cc1", "c1ccccc1O"), ("CCO", "OCC"), ("C1=CC=CC=C1", "c1ccccc1"), ("CC(=O)Oc1ccccc1C(=O)O", "O=C(O)C1=CC=CC=C1OC(C)=O"), ("[NH4+]", "[H]N([H])([H])[H+]")][:4])
def test_canonical_equal(a, b):
    assert canonical(a) == canonical(b) is not None


def test_canonical_apart():
    forms = [canonical(s) for s in ("CCO", "COC", "CCN", "C=C", "C#C", "c1ccccc1", "C1CCCCC1", "[Na+].[Cl-]", "[13CH4]", "C")]
    assert len(set(forms)) == len(forms) and None not in forms


@pytest.mark.parametrize("bad", ["invalid_xyz", "", None, "C(", "C1CC", "C=", "[Xx]", "CC)", "C(C)(C)(C)(C)C"])
def test_invalid(bad):
    assert parse(bad) is None


def test_validation_cases(spark):
    rows = [("C" * (i + 1), str(i)) for i in range(20)] + [("invalid_xyz", "1")] * 5
    marked = clean.mark(compounds(spark, rows), "smiles", "activity", canonical=canonical_column)
    c = clean.counts(marked).first()
    assert (c.valid_rows, c.invalid_structures, c.duplicates) == (20, 5, 0)
    rows = [("CCO", "1")] * 10 + [("C" * (i + 4), str(i)) for i in range(15)] + [("CCN", None), ("CCCN", "inf"), ("CCCCN", "x")]
    clean_rows, invalid, dups, report = clean.validate(compounds(spark, rows), "smiles", "activity", min_valid=10, canonical=canonical_column)
    assert report["duplicates"] == 9 and report["invalid_activities"] == 3 and invalid.count() == 3 and dups.count() == 9
    first = clean_rows.where("original_row_index = 0").first()
    assert first.compound_id == "compound_0"
    with pytest.raises(ValueError, match="Too few"):
        clean.validate(compounds(spark, rows[:2]), "smiles", "activity")
    with pytest.raises(ValueError, match="not found"):
        clean.mark(compounds(spark, rows[:2]), "structure", "activity")


def test_external(spark):
    gen = spark.createDataFrame([("C1", "CCO", 1.0, 0.1), ("C2", "CCN", 2.0, 0.2), ("C3", "CCC", 3.0, 0.3)], "compound_id string, canonical_smiles string, activity double, feat_a double")
    ext = spark.createDataFrame([(" C1 ", "10", "1"), ("C2", "20", "2"), ("C2", "21", "2"), ("C9", "99", "3")], "compound_id string, ext_feat string, feat_a string").coalesce(1)
    m = external.merge_external(gen, ext)
    got = {r.compound_id: r for r in m.table.collect()}
    assert m.features == ["ext_feat", "ext__feat_a"] and got["C1"].ext_feat == 10 and got["C2"].ext_feat == 20 and got["C3"].ext_feat is None and len(m.warnings) == 3
    by_structure = spark.createDataFrame([("X1", " CCO", 5.0)], "compound_id string, smiles string, mw double")
    assert external.merge_external(gen, by_structure).key == "canonical_smiles"
    with pytest.raises(ValueError, match="compound_id"):
        external.merge_external(gen, ext.drop("compound_id"))
    with pytest.raises(ValueError, match="no matching"):
        external.merge_external(gen, ext.where("compound_id = 'C9'"))
    assert external.suggest_id_column(["x", "id"]) == "id" and external.suggest_id_column(["x"]) is None


def test_filters_and_greedy(spark):
    rng = np.random.default_rng(0)
    n = 30
    d = {"d0": np.full(n, 5.0), "d1": 5 + rng.normal(0, 0.001, n), "d3": rng.normal(size=n), "gone": np.full(n, np.nan), "sparse": np.where(np.arange(n) < 10, np.nan, 1.0 * np.arange(n))}
    d["d2"] = d["d3"] + rng.normal(0, 0.01, n)
    wide = spark.createDataFrame([(i, *[float(d[k][i]) for k in d]) for i in range(n)], "id long, " + ", ".join(f"{k} double" for k in d))
    fitted = {r.descriptor: r.reason for r in colstats.filter_reasons(colstats.to_long(wide, "id", list(d))).collect()}
    assert fitted == {"d0": "constant", "d1": "near_constant_std<0.01", "d2": None, "d3": None, "gone": "nonnumeric", "sparse": "missing>0.2"}
    r = np.array([[1, 0.99, 0.2], [0.99, 1, 0.97], [0.2, 0.97, 1]])
    assert colstats.greedy_prune(r, np.array([0.5, 0.4, 0.9]), ["a", "b", "c"]) == [("b", "a")]
    assert colstats.greedy_prune(r, np.array([0.5, 0.5, 0.9]), ["a", "b", "c"]) == [("b", "a")]


def test_greedy_query_equals_plain_loop(spark, sf):
    from assayframe import catalog

    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(e["embedding"]).astype(float)
    r = np.corrcoef(np.column_stack([x, e["label"]]).T)
    names = catalog.embedding_names(x.shape[1])
    live, gone = set(names), []
    pairs = sorted((-abs(r[i, j]), names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names)) if abs(r[i, j]) > 0.08)
    for _, a, b in pairs:
        if a in live and b in live:
            ta, tb = (abs(r[names.index(k), -1]) for k in (a, b))
            lose = a if ta < tb else b if tb < ta else max(a, b)
            live.discard(lose)
            gone.append(lose)
    assert {g.dropped for g in catalog.corr_prune_greedy(spark, sf).collect()} == set(gone)


def test_split_small_clusters(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(20)], "id long, cluster int")
    out = split.stratified_split(df, "id")
    split.check_split(out, "id")
    assert out.where("split = 'test'").count() == 4  # no cluster is large enough: the global split


def test_metrics_known(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5), (4.0, 4.0)], "activity double, predicted double")
    m = evaluate.regression_metrics(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert m.r2 == pytest.approx(0.9) and m.rmse == pytest.approx(0.125**0.5) and m.mae == 0.25
    t = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    c = evaluate.classification_metrics(t, "y", "p").first()
    assert (c.precision, c.recall, c.accuracy, c.specificity) == (1.0, 0.5, 0.75, 1.0)


@pytest.mark.parametrize("train, cv, std, want", [(0.95, 0.55, 0.05, "overfit"), (0.72, 0.65, 0.06, "good"), (0.25, 0.20, 0.04, "underfit"), (0.70, 0.62, 0.25, "unstable"), (0.60, 0.35, 0.05, "overfit")])
def test_status(spark, train, cv, std, want):
    assert search.status_of(spark, train, cv, std) == want


def test_one_se(spark):
    df = spark.createDataFrame([(1, 0.50, 0.40, 0.05), (2, 0.60, 0.55, 0.04), (3, 0.70, 0.58, 0.03), (4, 0.75, 0.57, 0.03)], "n_features int, mean_train_r2 double, mean_cv_r2 double, std_cv_r2 double")
    r = select.one_se_count(df).first()
    assert (r.best_n, r.selected_n) == (3, 2)


def test_applicability_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -1, 0.5] + rng.normal(0, 0.1, 40)
    p = y + rng.normal(0, 0.2, 40)
    rows = [(i, "train" if i < 30 else "test", float(y[i]), float(p[i]), x[i].tolist()) for i in range(40)]
    ad = domain.applicability(spark.createDataFrame(rows, "compound_id long, split string, activity double, predicted double, x array<double>"), "x", 3).toPandas().set_index("compound_id").sort_index()
    a = np.column_stack([np.ones(40), x])
    h = np.einsum("ij,jk,ik->i", a, np.linalg.pinv(a[:30].T @ a[:30]), a)
    assert np.allclose(ad["leverage"], h) and np.allclose(ad["h_star"], 12 / 30)
    assert np.allclose(ad["standardized_residual"], (y - p) / np.sqrt(((y - p) ** 2).mean()))


def test_knn_equals_kernel(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(50)], "id long, x array<double>, y double")
    for weights in ("uniform", "distance"):
        got = neighbours.knn_predict(df.where("id < 40"), df.where("id >= 35"), "id", "x", "y", 3, weights, block=16).toPandas().sort_values("id")["predicted"]
        model = registry.create("knn", {"n_neighbors": 3, "weights": weights}).fit(x[:40], y[:40])
        assert np.allclose(got, model.predict(x[35:]))


@pytest.mark.parametrize("name", registry.NAMES)
def test_estimators_fit(name):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 60)
    p = registry.create(name, {"n_estimators": 30} if "n_estimators" in registry.DEFAULTS[name] else {}).fit(x, y).predict(x)
    assert search.scores(y, p)[0] > 0.7
    assert registry.create("pls", {"n_components": 10}).fit(x[:20, :1], y[:20]).n_components == 1
    assert registry.create("knn", {"n_neighbors": 25}).fit(x[:5], y[:5]).k_used == 5


def test_distributed_pls_equals_kernel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5))
    y = x @ rng.normal(size=5) + 3
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(80)], "x array<double>, y double").repartition(3)
    model = pls_fit(df, "x", "y", 5, 2)
    local = registry.create("pls", {"n_components": 2}).fit(x, y)
    assert np.allclose(x @ model.coef + model.intercept, local.predict(x))


def test_grids():
    grid, notes = registry.sanitise("svr", {"C": [1000, "10", 1.0, 1.0], "nope": [1], "kernel": ["rbf", "sigmoid"], "gamma": ["scale", 0.5, 9]}, 5, 20)
    assert grid == {"C": [10, 1.0], "kernel": ["rbf"], "gamma": ["scale", 0.5]} and notes
    grid, _ = registry.sanitise("random_forest", {"bootstrap": [True, "false"], "max_samples": [0.7], "max_depth": ["None", 5, 9999]}, 5, 20)
    assert grid == {"bootstrap": [True, False], "max_depth": [None, 5]}
    small, drawn = registry.shrink(registry.grid_for("random_forest", "overfit"), 120)
    assert registry.combinations(small) <= 120 and not drawn
    assert registry.sanitise("pls", {"n_components": [500]}, 5, 20)[0] == registry.GRIDS["pls"]["default"]


def test_search_finds_the_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    y = 3 * x[:, 2] - 2 * x[:, 5] + rng.normal(0, 0.1, 60)
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(60)], "id long, y double, " + ", ".join(f"{n} double" for n in names))
    data = search.Training.load(df, "id", names, "y")
    sfs = search.forward_selection(spark, data, "pls", {"n_components": 3}, most=3)
    assert set(sfs["selected_features"][1]) == {"f2", "f5"} and search.one_se(sfs) == 2
    best, history = search.genetic_selection(spark, data, 2, "pls", {"n_components": 2}, population=16, generations=5)
    assert set(best) == {"f2", "f5"} and len(history) == 5
    more, _ = search.genetic_selection(spark, data, 1, "pls", {"n_components": 2}, fixed=["f2"], population=8, generations=3)
    assert more == ["f2", "f5"]
    with pytest.raises(ValueError):
        search.genetic_selection(spark, data, 9, "pls")
    found = search.tune(spark, data, "pls", rounds=1, cap=4)
    assert found.chosen["source"] == "baseline" and found.chosen["status"] == "good"


def test_artifacts(tmp_path, spark):
    assert len(artifacts.new_run_id()) == 12
    folder = artifacts.run_dir(tmp_path, "run-1")
    tables.save_json(folder / "a" / "x.json", {"a": 1})
    assert artifacts.zip_run(folder, tmp_path / "r.zip").exists()
    with pytest.raises(ValueError):
        artifacts.run_dir(tmp_path, "../x")
    assert artifacts.parse_fenced_json("```json\n{\"a\": [1]}\n```") == {"a": [1]}
    df = spark.range(10)
    one, two = (artifacts.table_fingerprint(d).first() for d in (df, df.repartition(3)))
    assert one == two


def test_csv_ordinal(tmp_path, spark):
    (tmp_path / "c.csv").write_text("id,smiles,y\n001,CCO,1.5\n002,CCN,x\n")
    df = tables.read_csv(spark, str(tmp_path / "c.csv"))
    assert [(r.id, r.original_row_index) for r in df.orderBy("original_row_index").collect()] == [("001", 0), ("002", 1)]
    assert tables.schema_only(spark, str(tmp_path / "c.csv")) == ["id", "smiles", "y"]


def test_descriptor_table(spark):
    df = spark.createDataFrame([("a", "CCO"), ("b", "bad(")], "compound_id string, smiles string")
    got = {r.descriptor: r.value for r in descriptor_table(df, "compound_id", "smiles").collect()}
    assert got["heavy_atoms"] == 3 and got["weight"] == pytest.approx(46.069) and got["wiener"] == 4


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.drift(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "value", 50.0, 10.0)
    q = stream.writeStream.format("memory").queryName("drift_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = monitor.drift(events, "ts", "value", 50.0, 10.0).collect()
    assert sorted(spark.table("drift_out").collect()) == sorted(batch)


def test_oversample_balances(spark):
    from assayframe.operators.oversample import oversample

    rng = np.random.default_rng(6)
    rows = [(i, int(i < 7), rng.normal(size=2).tolist()) for i in range(40)]
    out = oversample(spark.createDataFrame(rows, "id long, y int, x array<double>"), "id", "x", "y", 1, block=100)
    made = np.array([r.features for r in out.where("synthetic").collect()])
    assert out.count() == 33 + 33 and len(made) == 26
    few = np.array([r[2] for r in rows[:7]])
    assert (made >= few.min(0) - 1e-9).all() and (made <= few.max(0) + 1e-9).all()


def test_fold_scores_runs_every_estimator_at_every_size(spark, monkeypatch):
    from types import SimpleNamespace

    from assayframe import catalog_reports
    from assayframe.operators import registry

    for n in (100, 1001, 50_000):
        monkeypatch.setattr(catalog_reports, "training", lambda *_: SimpleNamespace(y=np.zeros(n)))
        monkeypatch.setattr(catalog_reports.search, "evaluate", lambda _, data, units: units)
        assert [(e, p) for _, e, p, _ in catalog_reports.fold_scores(spark, "")] == [(e, {}) for e in registry.NAMES]


def test_svr_does_not_depend_on_held_rows(monkeypatch):
    from assayframe.kernels import linear

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = x[:, 0] - x[:, 1] ** 2
    for kernel in ("rbf", "linear", "poly"):
        a = linear.SVR(kernel=kernel).fit(x, y).predict(x)
        with monkeypatch.context() as m:
            m.setattr(linear, "KERNEL_VALUES", 300)
            assert np.allclose(linear.SVR(kernel=kernel).fit(x, y).predict(x), a, atol=1e-6)


def test_svr_by_working_sets_finds_the_same_function(monkeypatch):
    """Equal rows count as one with a wider bound, and many rows are fitted by working sets: no kernel of all rows is formed."""
    from assayframe.kernels import linear

    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4))
    y = rng.integers(0, 10, 500).astype(float)
    a = linear.SVR(tol=1e-6).fit(x, y)
    monkeypatch.setattr(linear, "WHOLE_ROWS", 120)
    monkeypatch.setattr(linear, "WORKING_ROWS", 60)
    seen = []
    kernel = linear.SVR.kernel
    with monkeypatch.context() as m:
        m.setattr(linear.SVR, "kernel", lambda self, a, b: seen.append(min(len(a), len(b))) or kernel(self, a, b))
        b = linear.SVR(tol=1e-6).fit(x, y)
    assert max(seen) <= 60 and abs(b.beta.sum()) < 1e-6
    assert np.allclose(a.predict(x), b.predict(x), atol=1e-4)
    many = linear.SVR(C=0.25, tol=1e-6).fit(np.tile(x, (4, 1)), np.tile(y, 4))
    assert len(many.x) <= 500 and np.allclose(a.predict(x), many.predict(x), atol=1e-4)


def test_knn_kernel_compares_equal_points_once():
    from assayframe.kernels.trees import KNN

    rng = np.random.default_rng(6)
    x = np.tile(rng.integers(0, 4, size=(40, 2)).astype(float), (5, 1))
    y, q = rng.normal(size=200), rng.integers(0, 5, size=(60, 2)) / 1.0
    for p in (1, 2):
        for weights in ("uniform", "distance"):
            m = KNN(7, weights, p).fit(x, y)
            assert len(m.points) <= 16
            want = []
            for v in q:
                d = (np.abs(x - v) ** p).sum(1) ** (1 / p)
                top = np.argsort(d, kind="stable")[:7]
                w = np.ones(7) if weights == "uniform" else (d[top] == 0) * 1.0 if (d[top] == 0).any() else 1 / d[top]
                want.append((w * y[top]).sum() / w.sum())
            assert np.allclose(m.predict(q), want, atol=1e-12)


def test_units_of_a_search_are_dealt_in_turn(spark):
    """No task gets two of 25 units while others get none; a search of ten features loads ten."""
    from assayframe.catalog_models import training

    data = training(spark, "/root/testdata/sf0.001", 10)
    assert data.x.shape[1] == 10
    out = search.evaluate(spark, data, [(i, "pls", {}, [0, 1]) for i in range(5)])
    per = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in per) == -(-25 // min(25, 4 * spark.sparkContext.defaultParallelism))


def test_oversample_neighbours_of_all_blocks(spark):
    """New points lie between true near neighbours, however many blocks there are."""
    from assayframe.operators.oversample import oversample

    at = [10.0 * (i // 4) + 0.1 * (i % 4) for i in range(40)]  # ten groups of four: a row's three nearest are its group
    rows = [(i, 1, [at[i], 0.0]) for i in range(40)] + [(100 + i, 0, [0.0, 5.0]) for i in range(130)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    out = oversample(df, "id", "x", "y", 1, block=6)
    made = np.array([r.features for r in out.where("synthetic").collect()])
    assert len(made) == 90
    assert all(min(v % 10, 10 - v % 10) <= 0.3 + 1e-9 for v in made[:, 0])
    assert sorted(map(tuple, made)) == sorted(tuple(r.features) for r in oversample(df, "id", "x", "y", 1, block=6).where("synthetic").collect())


SAME = [
    ("C[C@H](N)C(=O)O", "N[C@@H](C)C(=O)O"), ("C[C@H](N)C(=O)O", "OC(=O)[C@@H](N)C"), ("[C@H](F)(Cl)Br", "F[C@@H](Cl)Br"), ("F/C=C/F", "F\\C=C\\F"), ("F/C=C\\F", "F\\C=C/F"), ("C(/F)=C/F", "F\\C=C/F"),
    ("C[C@H](C)O", "CC(C)O"), ("C/C(C)=C/F", "CC(C)=CF"), ("[H]C([H])([H])O", "CO"), ("N[C@@]([H])(C)C(=O)O", "N[C@@H](C)C(=O)O"), ("N[C@]1(F)CCO1", "N[C@@]1(F)OCC1"), ("C[S@](=O)CC", "CC[S@@](=O)C"),
    ("F/C(Cl)=C/F", "Cl\\C(F)=C/F"), ("F/C=C/1CCCCCCCC1F", "F\\C=C\\1CCCCCCCC1F"),
]
OTHER = [
    ("C[C@H](N)C(=O)O", "C[C@@H](N)C(=O)O"), ("F/C=C/F", "F/C=C\\F"), ("F/C=C/F", "FC=CF"), ("C[C@H](N)C(=O)O", "CC(N)C(=O)O"), ("N[C@]1(F)CCO1", "N[C@@]1(F)CCO1"), ("C[S@](=O)CC", "C[S@@](=O)CC"),
    ("O[C@H]1CC[C@@H](C)CC1", "O[C@H]1CC[C@H](C)CC1"), ("F/C(Cl)=C/F", "F/C(Cl)=C\\F"),
]


def test_stereo_tells_compounds_apart():
    from assayframe.functions.molecule import canonical

    assert all(canonical(a) == canonical(b) for a, b in SAME)
    assert all(canonical(a) != canonical(b) for a, b in OTHER)


def written(mol, rng):
    """Another SMILES of a parsed molecule without stereo: a walk from a random atom in random order."""
    near = mol.neighbours()
    marks = {1.0: "-", 1.5: ":", 2.0: "=", 3.0: "#"}
    seen, tree, back, order = set(), {}, {}, {}

    def walk(i, up):
        seen.add(i)
        order[i] = len(order)
        tree[i] = []
        for j in rng.sample(list(near[i]), len(near[i])):
            if j == up:
                continue
            if j in seen:
                if order[j] < order[i]:
                    back.setdefault(i, []).append(j)
            else:
                walk(j, i)
                tree[i].append(j)

    walk(rng.randrange(len(mol.atoms)), None)
    rings = {(i, j): 10 + k for k, (i, j) in enumerate((i, j) for i in back for j in back[i])}

    def text(i):
        symbol, aromatic, charge, isotope, hydrogens = mol.atoms[i]
        out = f"[{isotope or ''}{symbol.lower() if aromatic else symbol}{f'H{hydrogens}' if hydrogens else ''}{f'{charge:+d}' if charge else ''}]"
        for (a, b), n in rings.items():
            if i in (a, b):
                out += f"{marks[near[a][b]]}%{n}"
        branches = [marks[near[i][j]] + text(j) for j in tree[i]]
        return out + "".join(f"({b})" for b in branches[:-1]) + (branches[-1] if branches else "")

    return text(next(iter(order)))


def test_a_thousand_writings_of_symmetric_cages():
    import random

    from assayframe.functions.molecule import canonical, parse

    rng = random.Random(1)
    cages = ["C12C3C4C1C5C2C3C45", "C1C2CC3CC1CC(C2)C3", "C12C3C4C5C1C6C7C2C8C3C9C4C1C5C6C2C7C8C9C12", "CC(C)(C)C(C(C)(C)C)(C(C)(C)C)C(C(C)(C)C)(C(C)(C)C)C(C)(C)C", "c1ccc2ccccc2c1", "OC1C(O)C(O)C(O)C(O)C1O", "C1CC2CCC1CC2", "O=C(O)c1ccc(N)cc1"]
    for smiles in cages:
        mol, want = parse(smiles), canonical(smiles)
        assert all(canonical(written(mol, rng)) == want for _ in range(125)), smiles
    assert len({canonical(c) for c in cages}) == len(cages)


def test_registry_tells_whole_numbers_from_others():
    from assayframe.operators import registry

    grid, notes = registry.sanitise("random_forest", {"n_estimators": [150.5, "200", 300.0, True], "max_depth": ["None", 7.5, "8"], "max_features": [1.0, "sqrt", 2]}, 10, 100)
    assert grid == {"n_estimators": [200, 300], "max_depth": [None, 8], "max_features": [1.0, "sqrt"]} and len(notes) == 4
    grid, _ = registry.sanitise("pls", {"n_components": ["3.0", 2.5, 4], "scale": ["yes", "false"]}, 10, 100)
    assert grid == {"n_components": [3, 4], "scale": [True, False]}
    for estimator in registry.NAMES:
        with pytest.raises(TypeError):
            registry.create(estimator, {"no_such_parameter": 1})
    with pytest.raises(ValueError):
        registry.create("linear")
    assert [registry.SLUGS[e] for e in registry.NAMES] == ["rf", "pls", "et", "svr", "knn"]


def plain_gain(t, k, criterion):
    def error(part):
        if criterion == "squared_error":
            return ((part - part.mean()) ** 2).sum()
        if criterion == "absolute_error":
            return np.abs(part - np.median(part)).sum()
        return -(part * np.log(part.mean())).sum() if part.sum() > 0 else np.inf

    return error(t) - error(t[:k]) - error(t[k:])


def test_criteria_equal_plain_sums():
    from assayframe.kernels.trees import Criterion, Forest

    rng = np.random.default_rng(3)
    for criterion in ("squared_error", "absolute_error", "poisson"):
        for _ in range(10):
            t = rng.poisson(2.0, 12).astype(float)
            t[0] += 1
            assert np.allclose(Criterion(criterion).gains(t), [plain_gain(t, k, criterion) for k in range(1, 12)], atol=1e-9)
    x, y = rng.normal(size=(60, 3)), rng.poisson(3.0, 60).astype(float)
    fits = [Forest(10, criterion=c, seed=1).fit(x, y).predict(x) for c in ("squared_error", "absolute_error", "poisson")]
    assert not np.allclose(fits[0], fits[1]) and not np.allclose(fits[0], fits[2])
    with pytest.raises(ValueError):
        Forest(2, criterion="poisson").fit(x, y - 10)
    with pytest.raises(ValueError):
        Forest(2, criterion="gini").fit(x, y)
    plain, drawn = (Forest(10, extra=True, bootstrap=b, seed=1).fit(x, y).predict(x) for b in (None, True))
    assert not np.allclose(plain, drawn) and np.allclose(plain, Forest(10, extra=True, bootstrap=False, seed=1).fit(x, y).predict(x))


def test_svr_meets_the_conditions_of_its_optimum():
    from assayframe.kernels.linear import SVR

    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 4))
    y = 100 + x @ [1.0, -2.0, 0.5, 0.0] + 0.3 * rng.normal(size=80)
    for kernel, c in (("linear", 1.0), ("rbf", 5.0), ("poly", 0.5)):
        m = SVR(C=c, kernel=kernel, epsilon=0.2, tol=1e-6).fit(x, y)
        assert abs(m.beta.sum()) < 1e-6 and np.abs(m.beta).max() <= c + 1e-9  # the bias is free
        miss = y - m.predict(x)
        full = np.zeros(80)
        full[[int(np.flatnonzero((x == v).all(1))[0]) for v in m.x]] = m.beta
        inside, free, bound = full == 0, (full != 0) & (np.abs(full) < c - 1e-6), np.abs(full) >= c - 1e-6
        assert (np.abs(miss[inside]) <= 0.2 + 1e-4).all() and np.allclose(np.abs(miss[free]), 0.2, atol=1e-4) and (np.abs(miss[bound]) >= 0.2 - 1e-4).all()
    line = SVR(C=100.0, kernel="linear", epsilon=0.0, tol=1e-9).fit(np.arange(10.0)[:, None], 3 * np.arange(10.0) + 50)
    assert np.allclose(line.predict(np.array([[20.0], [-5.0]])), [110.0, 35.0], atol=1e-4)
    assert SVR().fit(x, np.full(80, 7.0)).predict(x[:2]).tolist() == [7.0, 7.0]


def test_models_survive_the_store(spark):
    from assayframe.sources import models

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=50)
    for estimator in registry.NAMES:
        model = registry.create(estimator, {"n_estimators": 7} if "trees" in estimator or "forest" in estimator else {}).fit(x, y)
        rows = spark.createDataFrame(models.to_rows(model), models.SCHEMA).collect()
        back = models.from_rows(estimator, [tuple(r) for r in rows])
        assert np.array_equal(model.predict(x), back.predict(x))
        if hasattr(model, "importances"):
            assert np.array_equal(model.importances(), back.importances())


def test_vectors_align_with_the_training_descriptors(spark):
    train = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 3.0), ("a", "q", 10.0), ("b", "q", 30.0), ("a", "r", 5.0), ("b", "r", 7.0)], "k string, descriptor string, value double")
    fitted = colstats.filter_reasons(train)
    new = spark.createDataFrame([("x", "q", 20.0), ("x", "other", 9.0), ("y", "r", None), ("y", "p", 1.0), ("z", "other", 1.0)], "k string, descriptor string, value double")
    got = {r["k"]: r["features"] for r in colstats.aligned(new, "k", fitted).collect()}
    assert got == {"x": [0.0, 0.0, 0.0], "y": [-1.0, 0.0, 0.0], "z": [0.0, 0.0, 0.0]}
    assert {r["k"]: r["features"] for r in colstats.aligned(new, "k", fitted, ["r", "p"]).collect()}["y"] == [0.0, -1.0]


def test_backend_rows_are_aligned_by_key(spark):
    import pandas as pd

    from assayframe.operators import backend

    compounds = spark.createDataFrame([("a", "C"), ("b", "CC"), ("c", "bad"), ("d", "CCC")], "id string, smiles string").coalesce(1)

    def program(batches):
        for pdf in batches:
            for k, s in zip(pdf["id"], pdf["smiles"]):
                if k != "d":
                    yield pd.DataFrame({"id": [k, k], "error": ["broken" if s == "bad" else "", ""], "size": [float(len(s)), 99.0], "odd": [float("inf"), 1.0]})

    out = backend.run_backend(compounds, "id", "smiles", program, ["size", "odd", "absent"])
    aligned = backend.align_backend(compounds, out, "id")
    assert sorted(map(tuple, aligned.select("id", "size", "odd", "absent", "backend_status").collect())) == [("a", 1.0, None, None, "ok"), ("b", 2.0, None, None, "ok"), ("c", 3.0, None, None, "error"), ("d", None, None, None, "missing")]
    assert sorted(map(tuple, backend.backend_report(aligned, "id").collect())) == [("error", 1, "c"), ("missing", 1, "d"), ("ok", 2, "")]


def test_order_statistics_of_large_groups(spark, monkeypatch):
    """Past SMALL only a bracket is put in order; the results are those of a sort."""
    from assayframe.operators import ranks

    monkeypatch.setattr(ranks, "SMALL", 50)
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, vs in (("a", rng.normal(size=3001)), ("b", rng.integers(0, 5, 2000)), ("c", [1.0, 2.0])) for v in vs] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in "abc"}
    assert {r["g"]: r["median"] for r in ranks.exact_median(df, ["g"], "v").collect()} == want
    numbered = df.where("v is not null").selectExpr("g", "v", "row_number() over (order by g, v) as i")
    for share in (0.2, 0.5, 1.0):
        first = ranks.first_share(numbered, ["g"], F.col("v"), ["i"], share).where("first").groupBy("g").count().collect()
        assert {r["g"]: r["count"] for r in first} == {"a": int(np.ceil(share * 3001)), "b": int(np.ceil(share * 2000)), "c": int(np.ceil(share * 2))}
    chosen = [r["v"] for r in ranks.first_share(numbered, ["g"], F.col("v"), ["i"], 0.2).where("first and g = 'a'").collect()]
    assert sorted(chosen) == sorted(v for g, v in rows if g == "a" and v is not None)[:601]
    run = ranks.running_before(spark.range(1000).selectExpr("id * 7 % 1000 as k", "id as n"), "k", ["n"], 8)
    got = {r["k"]: r["n_before"] for r in run.collect()}
    values = {i * 7 % 1000: i for i in range(1000)}
    assert all(got[k] == sum(values[j] for j in range(k)) for k in range(0, 1000, 37))
    folds = split.assign_folds(spark.range(103).selectExpr("concat('k', lpad(id, 4, '0')) as k"), "k", 5, None).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20, 20, 21, 21, 21]


def test_searches_beyond_the_plain_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = x[:, 1] + x[:, 3] + 0.1 * rng.normal(size=60)
    data = search.Training(x, y, list("abcde"), np.arange(60) % 3)
    best = search.exhaustive_selection(spark, data, 2, "pls", {"n_components": 2})
    assert len(best) == 10 and best.iloc[0]["selected_features"] == ["b", "d"]
    with pytest.raises(ValueError):
        search.exhaustive_selection(spark, data, 2, most=9)
    front = search.two_objective_selection(spark, data, 2, "pls", {"n_components": 2}, population=8, generations=3)
    assert front.iloc[0]["selected_features"] == ["b", "d"]
    classes = search.Training(x, (y > 0).astype(float), data.names, data.folds)
    sfs = search.forward_selection(spark, classes, "pls", {"n_components": 1}, most=1, scorer="mcc", fixed=["b"])
    assert sfs.iloc[0]["selected_features"] == ["b", "d"] and 0.5 < sfs.iloc[0]["mean_cv_r2"] <= 1 and 0.5 < sfs.iloc[0]["train_r2"] <= 1
    assert search.matthews(np.array([1, 1, 0, 0]), np.array([0.9, 0.2, 0.1, 0.3])) == pytest.approx((1 * 2 - 0 * 1) / (1 * 2 * 2 * 3) ** 0.5)
    some = search.drawn({"a": [1, 2, 3], "b": list("xyzw")}, 5, 1)
    assert len({tuple(c.items()) for c in some}) == 5 and some == search.drawn({"a": [1, 2, 3], "b": list("xyzw")}, 5, 1)


def test_null_groups_keep_their_rows(spark, monkeypatch):
    """A null cluster is split like any other, and a null group has a median."""
    from assayframe.operators import ranks, split

    for small in (ranks.SMALL, 5):
        monkeypatch.setattr(ranks, "SMALL", small)
        rows = [(i, None if i < 20 else i % 2, float(i % 17)) for i in range(60)]
        df = spark.createDataFrame(rows, "compound_id long, cluster int, activity double")
        out = split.stratified_split(df, "compound_id").collect()
        assert sorted(r.compound_id for r in out) == list(range(60))
        assert {c: sum(r.split == "test" for r in out if r.cluster == c) for c in (None, 0, 1)} == {None: 4, 0: 4, 1: 4}
        medians = {r.cluster: r["median"] for r in ranks.exact_median(df, ["cluster"], "activity").collect()}
        assert medians == {c: float(np.median([v for _, k, v in rows if k == c])) for c in (None, 0, 1)}
        assert ranks.first_share(df, ["cluster"], F.col("activity"), ["compound_id"], 0.0).where("first").isEmpty()


def test_run_folders_on_the_session_s_file_systems(tmp_path, spark):
    import hashlib
    import zipfile

    folder = artifacts.run_dir(f"file://{tmp_path}", artifacts.new_run_id())
    (tmp_path / "in.csv").write_text("a,b\n1,ü\n")
    copied = artifacts.copy_input(tmp_path / "in.csv", folder / "input.csv")
    assert copied.read_text() == "a,b\n1,ü\n" and artifacts.copy_input(copied, copied).exists()
    assert artifacts.file_sha256(copied) == hashlib.sha256((tmp_path / "in.csv").read_bytes()).hexdigest()
    spark.range(3).coalesce(1).write.parquet(str(folder / "table"))
    artifacts.zip_run(folder, folder / "run.zip")
    with zipfile.ZipFile(str(folder / "run.zip").removeprefix("file://")) as z:
        names = z.namelist()
        assert z.read("input.csv").decode() == "a,b\n1,ü\n" and "run.zip" not in names and any(n.startswith("table/part-") for n in names)
    for name in ("../x", "a/b", "", ".", "..", "a b", "x\n"):
        with pytest.raises(ValueError):
            artifacts.safe_name(name)
    assert artifacts.safe_name("report-1.md") == "report-1.md" and artifacts.parse_fenced_json(' {"a": 2}') == {"a": 2}


PROGRAM = """
import json, sys, time
for line in sys.stdin:
    q = json.loads(line)
    s = q["structure"]
    if s == "hang":
        time.sleep(60)
    if s == "die":
        sys.exit(3)
    if s == "once" and not __import__("os").path.exists(sys.argv[1]):
        open(sys.argv[1], "w").close()
        time.sleep(60)
    print("no json" if s == "odd" else json.dumps({"error": "refused"} if s == "bad" else {"size": len(s), "nan": None}), flush=True)
"""


def test_a_supervised_program_ends_no_task(spark, tmp_path):
    """Programs that hang, die, refuse or babble give error rows; what answers at the second try is kept."""
    import sys

    from assayframe.operators import backend

    (tmp_path / "program.py").write_text(PROGRAM)
    program = backend.Supervised([sys.executable, str(tmp_path / "program.py"), str(tmp_path / "seen")], seconds=2.0)
    names = ["CCO", "hang", "C", "die", "odd", "bad", "once", "CC"]
    df = spark.createDataFrame([(f"k{i}", s) for i, s in enumerate(names)], "id string, smiles string").coalesce(1)
    got = {r.smiles: r for r in df.join(backend.run_backend(df, "id", "smiles", program, ["size"]), "id").collect()}
    assert len(got) == 8 and {s: got[s].size for s in ("CCO", "C", "once", "CC")} == {"CCO": 3.0, "C": 1.0, "once": 4.0, "CC": 2.0}
    assert all(got[s].error == "" for s in ("CCO", "C", "once", "CC")) and got["bad"].error == "refused"
    assert "no answer in 2 s" in got["hang"].error and "code 3" in got["die"].error and got["odd"].error and got["odd"].size is None


def test_responses_of_examples(spark):
    """Marks, quotients, numbers and other text; nothing is evaluated."""
    from assayframe.functions.scalars import inactive, measured

    want = {"ni": (0, None), "0": (1, None), " 2.5 ": (1, 2.5), "3/4": (1, 0.75), "1/0": (1, None), "1/2/4": (1, None), "x": (1, None), "": (1, None), "-7e2": (1, -700.0), "nan": (1, None), "__import__('os')": (1, None)}
    df = spark.createDataFrame([(s,) for s in want] + [(None,)], "s string")
    got = {r.s: (r.a, r.v) for r in df.select("s", inactive(F.col("s")).alias("a"), measured(F.col("s")).alias("v")).collect()}
    assert got == want | {None: (None, None)}


def test_rows_are_never_broadcast_to_groups(spark, tmp_path):
    """Rows whose file is small by repeats: not they but the groups are sent, and neither where groups are many."""
    rows = spark.range(50_000).select(F.col("id"), (F.col("id") % 7).alias("g"), (F.col("id") % 11).cast("double").alias("y"), F.lit(1.0).alias("predicted"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    groups = rows.groupBy("g").agg(F.max("y").alias("m"), F.collect_list("id").alias("all")).select("g", "m")

    def sides(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("BuildRight"), plan.count("BuildLeft"), plan.count("SortMergeJoin")

    met = ranks.with_groups(rows, groups, ["g"])
    assert sides(met)[:2] == (1, 0) and met.count() == 50_000
    few = ranks.FEW_GROUPS
    try:
        ranks.FEW_GROUPS = 3
        met = ranks.with_groups(rows, groups, ["g"])
        assert sides(met) == (0, 0, 1) and met.count() == 50_000
    finally:
        ranks.FEW_GROUPS = few
    assert "Join" not in evaluate.regression_metrics(rows, ["g"], "y")._jdf.queryExecution().executedPlan().toString()
    with_null = spark.createDataFrame([(None, 1.0, 1.0), (None, 3.0, 2.0), ("a", 2.0, 2.0)], "g string, activity double, predicted double")
    assert {r["g"]: (r["n"], r["r2"]) for r in evaluate.regression_metrics(with_null, ["g"]).collect()} == {None: (2, 0.5), "a": (1, None)}


def test_knn_meets_few_pairs_and_misses_none(spark, monkeypatch):
    """Copies, ties and points far from all cells: as brute force says, from a small part of all pairs."""
    rng = np.random.default_rng(8)
    x = np.concatenate((np.round(rng.normal(size=(3000, 2)), 2), np.repeat(rng.integers(0, 3, (40, 2)), 25, 0).astype(float)))
    x = x[rng.permutation(len(x))]
    z = np.concatenate((x[:200], rng.normal(size=(100, 2)) * 3, [[50.0, -50.0]]))
    y = rng.normal(size=len(x))
    train = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, x array<double>, y double")
    test = spark.createDataFrame([(10_000 + i, r.tolist()) for i, r in enumerate(z)] + [(1, None), (2, [float("nan"), 0.0])], "id long, x array<double>")
    seen = {}
    staged = neighbours.staged
    monkeypatch.setattr(neighbours, "staged", lambda df, name: seen.setdefault(name, staged(df, name)))
    got = {r["id"]: r["predicted"] for r in neighbours.knn_predict(train, test, "id", "x", "y", block=64).collect()}
    want = {}
    for i, q in enumerate(z):
        d = np.sqrt(((x - q) ** 2).sum(1))
        want[10_000 + i] = y[np.lexsort((np.arange(len(x)), d))[:5]].mean()
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))
    points, cells = seen["knn-points"].count(), seen["knn-cells"].select("cell").distinct().count()
    assert cells > 20 and points + seen["knn-visits"].count() < 0.3 * points * cells


def test_silhouette_by_products_of_blocks(spark):
    """Blocks in pairs, copies far from the origin, and a single point."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) + 1000
    x[:60] = x[0]
    x[60:90] = x[0] + 1e-7 * rng.normal(size=(30, 6))
    of = [None if i % 9 == 8 else i % 4 for i in range(399)] + [77]
    df = spark.createDataFrame([(i, r.tolist(), c) for i, (r, c) in enumerate(zip(x, of))], "id long, embedding array<double>, cluster int")
    got = {r["id"]: r["silhouette"] for r in split.silhouette(df.where("cluster is not null"), "id", block=64).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    c = np.array([-1 if v is None else v for v in of])
    for i in np.flatnonzero(c >= 0):
        mean = {k: d[i, c == k].sum() / max(1, (c == k).sum() - (k == c[i])) for k in (0, 1, 2, 3, 77)}
        a, b = mean[c[i]], min(v for k, v in mean.items() if k != c[i])
        want = 0.0 if c[i] == 77 else (b - a) / max(a, b)
        assert abs(got[int(i)] - want) < 1e-9
    assert len(got) == (c >= 0).sum()
    assert np.array_equal(split.distances(x[:1], x[:60])[0], np.zeros(60)) and np.allclose(split.distances(x[60:90], x[:90]), d[60:90, :90], rtol=1e-9, atol=0)
