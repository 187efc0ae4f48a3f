"""Estimators by name: factory, parameter spaces, grids, sanitising and shrinking."""
from __future__ import annotations

from math import prod
from typing import Any

from ..kernels.linear import PLS, SVR
from ..kernels.trees import KNN, Forest

NAMES = ("random_forest", "pls", "extra_trees", "svr", "knn")

# Defaults, allowed values or ranges, and grids by status.
DEFAULTS: dict[str, dict[str, Any]] = {
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt", "bootstrap": True},
    "pls": {"n_components": 10, "scale": False, "max_iter": 500},
    "extra_trees": {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt"},
    "svr": {"C": 1.0, "epsilon": 0.1, "gamma": "scale", "kernel": "rbf"},
    "knn": {"n_neighbors": 5, "weights": "uniform", "p": 2, "metric": "minkowski"},
}
FOREST_SPACE = {"n_estimators": (100, 1000), "max_depth": (2, 50), "min_samples_split": (2, 30), "min_samples_leaf": (1, 20), "max_features": {"sqrt", "log2", 0.3, 0.5, 0.7, 1.0}, "bootstrap": {True, False}}
SPACES: dict[str, dict[str, Any]] = {
    "random_forest": FOREST_SPACE | {"max_samples": (0.5, 1.0), "criterion": {"squared_error", "absolute_error", "poisson"}},
    "extra_trees": FOREST_SPACE,
    "pls": {"n_components": (1, 50), "scale": {True, False}, "max_iter": {100, 200, 500, 1000}},
    "svr": {"C": (0.1, 100.0), "epsilon": {0.01, 0.05, 0.1, 0.2, 0.5}, "gamma": ({"scale", "auto"}, (0.001, 1.0)), "kernel": {"rbf", "linear", "poly"}},
    "knn": {"n_neighbors": (1, 30), "weights": {"uniform", "distance"}, "p": {1, 2}, "metric": {"minkowski", "euclidean", "manhattan"}},
}
NULLABLE = {"max_depth", "max_samples"}
INTEGERS = {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "n_components", "n_neighbors", "p", "max_iter"}


# Grids by estimator and status.
GRIDS: dict[str, dict[str, dict[str, list]]] = {
    "random_forest": {
        "overfit": {
            "n_estimators": [200, 500], "max_depth": [3, 5, 8, 12], "min_samples_split": [4, 8, 12], "min_samples_leaf": [2, 4, 8],
            "max_features": ["sqrt", 0.3, 0.5], "bootstrap": [True], "max_samples": [0.7, 0.9],
        },
        "underfit": {
            "n_estimators": [300, 500, 800], "max_depth": [None, 15, 25, 40], "min_samples_split": [2, 4], "min_samples_leaf": [1, 2],
            "max_features": ["sqrt", 0.5, 0.7, 1.0], "bootstrap": [True, False],
        },
        "unstable": {
            "n_estimators": [500, 800, 1000], "max_depth": [5, 8, 12, 20], "min_samples_split": [4, 8], "min_samples_leaf": [2, 4, 6],
            "max_features": ["sqrt", 0.3, 0.5], "bootstrap": [True], "max_samples": [0.7, 0.85, 1.0],
        },
        "default": {
            "n_estimators": [200, 400], "max_depth": [5, 10, 15], "min_samples_split": [2, 4, 8], "min_samples_leaf": [1, 2, 4],
            "max_features": ["sqrt", 0.5], "bootstrap": [True], "max_samples": [0.8, 1.0],
        },
    },
    "extra_trees": {
        "overfit": {
            "n_estimators": [200, 500], "max_depth": [3, 5, 8, 12], "min_samples_split": [4, 8, 12], "min_samples_leaf": [2, 4, 8],
            "max_features": ["sqrt", 0.3, 0.5],
        },
        "underfit": {
            "n_estimators": [300, 500, 800], "max_depth": [None, 15, 25, 40], "min_samples_split": [2, 4], "min_samples_leaf": [1, 2],
            "max_features": ["sqrt", 0.5, 0.7, 1.0],
        },
        "unstable": {
            "n_estimators": [500, 800, 1000], "max_depth": [5, 8, 12, 20], "min_samples_split": [4, 8], "min_samples_leaf": [2, 4, 6],
            "max_features": ["sqrt", 0.3, 0.5],
        },
        "default": {
            "n_estimators": [200, 400], "max_depth": [5, 10, 15], "min_samples_split": [2, 4, 8], "min_samples_leaf": [1, 2, 4],
            "max_features": ["sqrt", 0.5],
        },
    },
    "pls": {
        "overfit": {"n_components": [2, 3, 5, 8], "scale": [False, True], "max_iter": [500, 1000]},
        "underfit": {"n_components": [10, 15, 20, 30], "scale": [False, True], "max_iter": [500, 1000]},
        "unstable": {"n_components": [5, 8, 10, 15], "scale": [True], "max_iter": [1000]},
        "default": {"n_components": [5, 10, 15], "scale": [False, True], "max_iter": [500]},
    },
    "svr": {
        "overfit": {"C": [0.1, 0.5, 1.0], "epsilon": [0.1, 0.2, 0.5], "gamma": ["scale", 0.01, 0.1], "kernel": ["rbf", "linear"]},
        "underfit": {"C": [10.0, 50.0, 100.0], "epsilon": [0.01, 0.05, 0.1], "gamma": ["scale", 0.1, 1.0], "kernel": ["rbf", "poly"]},
        "unstable": {"C": [1.0, 5.0, 10.0], "epsilon": [0.05, 0.1, 0.2], "gamma": ["scale", 0.01], "kernel": ["rbf"]},
        "default": {"C": [0.5, 1.0, 5.0, 10.0], "epsilon": [0.05, 0.1, 0.2], "gamma": ["scale", 0.01, 0.1], "kernel": ["rbf", "linear"]},
    },
    "knn": {
        "overfit": {"n_neighbors": [15, 20, 25], "weights": ["distance"], "p": [2], "metric": ["minkowski"]},
        "underfit": {"n_neighbors": [1, 3, 5], "weights": ["uniform", "distance"], "p": [1, 2], "metric": ["minkowski", "euclidean"]},
        "unstable": {"n_neighbors": [5, 7, 9, 11], "weights": ["uniform"], "p": [2], "metric": ["minkowski"]},
        "default": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"], "p": [2], "metric": ["minkowski"]},
    },
}
SLUGS = {"random_forest": "rf", "pls": "pls", "extra_trees": "et", "svr": "svr", "knn": "knn"}


def grid_for(estimator: str, status: str) -> dict[str, list]:
    found = GRIDS[estimator]
    return {k: list(v) for k, v in found.get(status, found["default"]).items()}


def create(estimator: str, params: dict | None = None, seed: int = 42):
    """A fresh estimator; explicit None values are kept."""
    if estimator not in NAMES:
        raise ValueError(f"unknown estimator {estimator!r}; one of {', '.join(NAMES)}")
    p = DEFAULTS[estimator] | (params or {})
    kinds = {"random_forest": lambda: Forest(**p, seed=seed), "extra_trees": lambda: Forest(**p, extra=True, seed=seed), "pls": lambda: PLS(**p), "svr": lambda: SVR(**p), "knn": lambda: KNN(**p)}
    return kinds[estimator]()


def normalise(name: str, value: Any) -> Any:
    """Text forms of none, booleans and numbers become values."""
    if isinstance(value, str) and value.strip().lower() in ("none", "null"):
        return None
    if name in ("bootstrap", "scale"):
        return value.strip().lower() in ("true", "1", "yes") if isinstance(value, str) else bool(value)
    if isinstance(value, str):
        for kind in (int, float):
            try:
                value = kind(value)
                break
            except ValueError:
                continue
    return int(value) if isinstance(value, float) and value.is_integer() and name in INTEGERS else value


def allowed(name: str, rule: Any, value: Any) -> bool:
    if value is None:
        return name in NULLABLE
    if name in INTEGERS and (isinstance(value, bool) or not isinstance(value, int)):
        return False
    if isinstance(rule, set):
        return any(type(v) is type(value) and v == value or (not isinstance(v, (str, bool)) and not isinstance(value, (str, bool)) and v == value) for v in rule)
    if isinstance(rule[0], set):
        return any(allowed(name, r, value) for r in rule)
    return not isinstance(value, (str, bool)) and rule[0] <= value <= rule[1]


def combinations(grid: dict[str, list]) -> int:
    return prod(len(v) for v in grid.values()) if grid else 0


def sanitise(estimator: str, grid: dict[str, list], n_features: int, n_train: int) -> tuple[dict[str, list], list[str]]:
    """(clean grid, notes): unknown names and values outside the space go."""
    space, out, notes = SPACES[estimator], {}, []
    for name, values in grid.items():
        if name not in space:
            notes.append(f"dropped unknown parameter {name}")
            continue
        kept: list[Any] = []
        for v in values if isinstance(values, list) else [values]:
            v = normalise(name, v)
            inside = allowed(name, space[name], v) and not (name == "n_components" and v > min(n_features, n_train - 1))
            if inside and v not in kept:
                kept.append(v)
            elif not inside:
                notes.append(f"dropped {name}={v!r}")
        if kept:
            out[name] = kept
    if "max_samples" in out and False in out.get("bootstrap", [True]):
        out.pop("max_samples")
        notes.append("dropped max_samples beside bootstrap=False")
    if not out:
        out = grid_for(estimator, "default")
        notes.append("used the default grid")
    return out, notes


def shrink(grid: dict[str, list], cap: int) -> tuple[dict[str, list], bool]:
    """Drop the middle value of the longest list until the product fits the cap."""
    grid = {k: list(v) for k, v in grid.items()}
    while combinations(grid) > cap:
        name = max(grid, key=lambda k: len(grid[k]))
        if len(grid[name]) == 1:
            return grid, True
        grid[name].pop(len(grid[name]) // 2)
    return grid, False
