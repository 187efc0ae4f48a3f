"""Canonical SMILES: texts that parse back, whatever the writing."""
import random

import pytest
from assayframe.functions.molecule import canonical, canonical_column, centres, double_bonds, parse
from assayframe.operators import clean, external
from pyspark.sql import functions as F

from test_operators import OTHER, SAME, written

TEXTS = {
    "OCC": "CCO", "C(O)C": "CCO", "[OH][CH2][CH3]": "CCO", "c1ccccc1C": "Cc1ccccc1", "C1=CC=CC=C1C": "Cc1ccccc1", "[Na+].[Cl-]": "[Cl-].[Na+]", "[13CH4]": "[13CH4]", "C": "C", "N": "N",
    "[H]C([H])([H])O": "CO", "O=C=O": "O=C=O", "C#N": "C#N", "c1cc[nH]c1": "c1cc[nH]c1", "[NH4+]": "[NH4+]", "[Fe+2]": "[Fe+2]", "OS(=O)(=O)O": "O=S(=O)(O)O",
}
MORE = [
    "CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "C1CC2CCC1CC2", "c1ccc(cc1)-c1ccccc1", "c1ccc2c(c1)[nH]c1ccccc12", "C[C@]12CC[C@H]3[C@@H](CCc4cc(O)ccc34)[C@@H]1CC[C@@H]2O",
    "OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O", "C/C=C/C=C\\C", "F/C=C/C(/Cl)=C\\Br", "F/C=C/1CCCCCCCC1F", "CC/C(C)=C(/C)O", "N[C@@H](C)C(=O)N[C@@H](CS)C(=O)O", "C[S@](=O)CC", "[O-][N+](=O)c1ccccc1", "C1=CC=C[CH]1", "[2H]C([2H])O",
    "C12C3C4C1C5C2C3C45", "B(O)O", "[se]1cccc1", "CC[N+](C)(C)C.[Br-]", "C" * 1500, "C1CCCCCCCCCCC1C1CCCCC1", "CP(=O)(OC)F", "O=C1NC(=O)c2ccccc12", "Clc1ccc(cc1)C(c1ccccc1)N1CCN(CC1)CCOCC(=O)O",
]


@pytest.mark.parametrize("text, want", TEXTS.items())
def test_text(text, want):
    assert canonical(text) == want


def graph(mol):
    near = mol.neighbours()
    return sorted((*a, len(n)) for a, n in zip(mol.atoms, near)), sorted(mol.bonds.values())


@pytest.mark.parametrize("text", [*MORE, *{s for pair in (*SAME, *OTHER) for s in pair}])
def test_what_is_written_is_the_molecule(text):
    """The text parses, to the same graph and to itself, with as many marks that tell something."""
    first = canonical(text)
    mol, back = parse(text), parse(first)
    assert back is not None and graph(mol) == graph(back) and canonical(first) == first
    near = back.neighbours()
    assert len(centres(back, near)) == first.replace("@@", "@").count("@")
    assert bool(double_bonds(back, near)) == ("/" in first)


@pytest.mark.parametrize("text", [t for t in MORE if not set("@/\\") & set(t) and len(t) < 200])
def test_any_writing_gives_one_text(text):
    rng = random.Random(4)
    mol, want = parse(text), canonical(text)
    if "." in text:
        return
    assert {canonical(written(mol, rng)) for _ in range(40)} == {want}


def test_coupled_double_bonds_turn_together():
    same = ["C/C=C/C=C\\C", "C\\C=C\\C=C/C", "C(=C\\C)/C=C\\C"]
    assert len({canonical(s) for s in same}) == 1 and canonical(same[0]).index("/") < canonical(same[0]).index("\\")
    assert len({canonical(s) for s in ("C/C=C/C=C\\C", "C/C=C/C=C/C", "C/C=C\\C=C/C")}) == 3


def test_structures_join_however_they_are_written(spark):
    """The fallback key of the real dataflow: canonical SMILES on one side, raw ones on the other."""
    raw = spark.createDataFrame([(i, s, float(i)) for i, s in enumerate(("CCO", "c1ccccc1O", "N[C@@H](C)C(=O)O", "CCN"))], "original_row_index long, smiles string, activity double")
    rows, *_ = clean.validate(raw, "smiles", "activity", min_valid=2, canonical=canonical_column)
    outside = spark.createDataFrame([("x1", "OCC", "1"), ("x2", " OC1=CC=CC=C1", "2"), ("x3", "C[C@H](N)C(=O)O", "3"), ("x4", "C[C@@H](N)C(=O)O", "4"), ("x5", "no structure", "5"), ("x6", "C(C)O", "6")], "compound_id string, smiles string, logp string")
    m = external.merge_external(rows.select(*clean.META), outside.withColumn("external_row_index", F.monotonically_increasing_id()), canonical=canonical_column)
    got = {r.canonical_smiles: r.logp for r in m.table.collect()}
    assert m.key == "canonical_smiles" and got == {"CCO": 1.0, canonical("Oc1ccccc1"): 2.0, canonical("N[C@@H](C)C(=O)O"): 3.0, "CCN": None}
    assert any("joined on structure (3 matched)" in w for w in m.warnings)
