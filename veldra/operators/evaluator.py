"""Evaluation of candidate expressions in batches: read, guarded, remembered, scored, stopped and recorded."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.simplify import simplify
from ..functions.symbols import SymbolLibrary
from ..functions.tree import Node, as_tree, constants as count_constants
from ..plans.compile import evaluate as run_expression
from ..plans.gradient import NoDerivative, Tape
from .fit import MOST_SENT, Settings, fit_distributed, fit_many, refused
from .quasi_newton import fit_together
from .score import latin_hypercube, score_many, wasserstein_arrays

MODEL = "expr_key string, tokens array<string>, error double, parameters array<double>"


@dataclass
class Event:
    """One evaluation as callbacks see it."""

    expr_key: str
    error: float
    eval_no: int
    experiment_id: str
    is_new_best: bool
    is_cache_hit: bool = False


@dataclass
class Result:
    """Outcome of a search: the summary, the best models, and all models in order of evaluation."""

    min_error: float
    best_expr: str | None
    num_evaluated: int
    evaluation_calls: int
    top_models: list[dict]
    all_models: list[dict]
    success: bool
    approach: str = ""
    metadata: dict = field(default_factory=dict)
    augmentations: dict = field(default_factory=dict)

    def row(self) -> tuple:
        return (self.metadata.get("dataset_name"), self.approach, self.metadata.get("seed"), self.min_error, self.best_expr, self.num_evaluated, self.evaluation_calls, self.success)

    def to_dict(self) -> dict:
        return {"format_version": 1, **vars(self)}

    @classmethod
    def from_dict(cls, d: dict) -> Result:
        return cls(**{k: v for k, v in d.items() if k != "format_version"})

    def show(self, scope: str = "best") -> str:
        """A readable account: of the best model, the top ones, or all in order of evaluation."""
        models = {"best": self.top_models[:1], "top": self.top_models, "all": self.all_models}[scope]
        head = f"{self.metadata.get('dataset_name')} by {self.approach}, seed {self.metadata.get('seed')}: {self.num_evaluated} expressions in {self.evaluation_calls} calls, {'success' if self.success else 'no success'}"
        return "\n".join([head, *(f"  {m['error']:.6g}  {m['expr_key']}  {m['parameters']}" for m in models)])


def save_results(results: list[Result], path: str) -> None:
    """Results as JSON; a folder gets results.json."""
    if os.path.isdir(path):
        path = os.path.join(path, "results.json")
    if not path.endswith(".json"):
        raise ValueError("results are saved as .json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.to_dict() for r in results], f)


def load_results(path: str) -> list[Result]:
    with open(os.path.join(path, "results.json") if os.path.isdir(path) else path, encoding="utf-8") as f:
        return [Result.from_dict(d) for d in json.load(f)]


def results_frame(spark, results: list[Result]) -> DataFrame:
    return spark.createDataFrame([r.row() for r in results], RESULT)


RESULT = "dataset string, approach string, seed int, min_error double, best_expr string, num_evaluated long, evaluation_calls long, success boolean"


def behaviour_at(tokens, points: np.ndarray, settings: Settings, library: SymbolLibrary, seed: int | None) -> np.ndarray:
    """Values at points (rows) for constants of a Latin hypercube (columns)."""
    tree = as_tree(tokens, library)
    k = count_constants(tree, library)
    if not k:
        return np.repeat(run_expression(tree, points, (), library)[:, None], settings.num_consts_sampled, axis=1)
    samples = latin_hypercube(settings.num_consts_sampled, [settings.constant_bounds] * k, seed)
    return np.column_stack([run_expression(tree, points, c, library) for c in samples])


class Evaluator:
    """Scores expressions against one dataset.

    A batch of expressions costs one pass: unknown ones are fitted in parallel tasks, each over the data if they can be sent,
    and one by one over distributed data if they can't. Known ones come from memory. Counts, running best and stops follow the
    order of the batch, exactly as if the expressions had come one at a time.
    """

    def __init__(self, data: DataFrame, columns: Sequence[str], target: str | None = "y", library: SymbolLibrary | None = None, max_evaluations: int = -1, threshold: float | None = None, ranking: str = "rmse", ground_truth: list[str] | None = None, seed: int | None = None, settings: Settings = Settings(), callbacks: Iterable = (), metadata: dict | None = None, experiment_id: str = "0"):
        if ranking not in ("rmse", "bed"):
            warnings.warn(f"ranking {ranking} is unknown; rmse is used", stacklevel=2)
            ranking = "rmse"
        if ranking == "rmse" and target is None:
            raise ValueError("ranking by rmse needs a target")
        if ranking == "bed" and ground_truth is None:
            raise ValueError("ranking by behaviour needs a ground truth")
        self.data, self.columns, self.target = data, list(columns), target
        self.library, self.settings, self.seed, self.ranking, self.ground_truth = SymbolLibrary.or_default(library), settings, seed, ranking, ground_truth
        self.max_evaluations, self.callbacks, self.metadata, self.experiment_id = max_evaluations, list(callbacks), dict(metadata or {}), experiment_id
        self.models: dict[str, dict] = {}
        self.calls, self.best, self.stopped = 0, float("inf"), False
        self.invalid: list[str] = []
        self._local = self._points = None
        self.threshold = threshold
        if threshold is None:
            self.threshold = 1e-7 if ranking == "rmse" else self._bed_threshold()

    # data

    def _rows(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The data as arrays if they are small enough to be sent to tasks; their size is checked first."""
        if self._local is None:
            wanted = [*self.columns, self.target]
            n = self.data.count()
            if n * 8 * len(wanted) > MOST_SENT:
                self._local = False
            else:
                m = self.data.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(wanted)]).toPandas().to_numpy(float)
                self._local = (m[:, :-1], m[:, -1])
        return self._local or None

    def _bed_points(self) -> np.ndarray:
        """Points of the domain: from its bounds if given, else rows of the data drawn with the seed."""
        if self._points is None:
            n = self.settings.num_points_sampled
            if self.settings.domain_bounds is not None:
                self._points = latin_hypercube(n, list(self.settings.domain_bounds), self.seed, spread=True)
            else:
                rows = self.data.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(self.columns)]).orderBy(F.xxhash64(*self.columns, F.lit(self.seed or 0))).limit(n)
                self._points = rows.toPandas().to_numpy(float)
        return self._points

    def _behaviour(self, tokens, seed: int | None) -> np.ndarray:
        return behaviour_at(tokens, self._bed_points(), self.settings, self.library, seed)

    def _bed_threshold(self) -> float:
        """A tenth over the largest of 100 distances of the ground truth to itself with other constants."""
        rng = np.random.default_rng(self.seed)
        own = lambda: self._behaviour(self.ground_truth, int(rng.integers(2**31)))
        return 1.1 * max(behaviour_gap(own(), own()) for _ in range(100))

    # scoring

    def _gaps(self, todo: list[tuple[str, list[str]]]) -> dict[str, tuple[float, list[float]]]:
        """Behaviour distances to the ground truth, candidates in parallel; the points, a number of the settings, go along."""
        points, settings, library, seed = self._bed_points(), self.settings, self.library, self.seed
        truth = self._behaviour(self.ground_truth, seed)

        def run(frames):
            for pdf in frames:
                out = []
                for tokens in pdf["tokens"]:
                    try:
                        out.append(behaviour_gap(behaviour_at(list(tokens), points, settings, library, seed), truth))
                    except (ValueError, IndexError):
                        out.append(float("nan"))
                yield pd.DataFrame({"expr_key": pdf["expr_key"], "error": out})

        spark = self.data.sparkSession
        frame = spark.createDataFrame(todo, "expr_key string, tokens array<string>").repartition(min(len(todo), spark.sparkContext.defaultParallelism))
        return {r["expr_key"]: (r["error"], []) for r in frame.mapInPandas(run, "expr_key string, error double").collect()}

    def _score_free(self, todo: list[tuple[str, list[str]]]) -> dict[str, tuple[float, list[float]]]:
        """The candidates without constants, scored together in one pass over the data."""
        free = []
        for key, tokens in todo:
            try:
                tree = as_tree(tokens, self.library)
                if not count_constants(tree, self.library) and not refused(tree, 0, self.settings, self.library):
                    free.append((key, tree, []))
            except (ValueError, IndexError):
                pass
        if not free:
            return {}
        return {r["expr_key"]: (r["error"], []) for r in score_many(self.data, free, self.columns, self.target, self.library).collect()}

    def _fit_distributed(self, todo: list[tuple[str, list[str]]]) -> dict[str, tuple[float, list[float]]]:
        """The candidates with constants, fitted in step over data that stay distributed; those without a known derivative one by one."""
        out: dict[str, tuple[float, list[float]]] = {}
        together: dict[str, Node] = {}
        for key, tokens in todo:
            try:
                tree = as_tree(tokens, self.library)
                if count_constants(tree, self.library):
                    Tape(tree, self.columns, self.library)
                    together[key] = tree
                elif refused(tree, 0, self.settings, self.library):
                    out[key] = (float("nan"), [])
            except NoDerivative:
                out[key] = fit_distributed(self.data, tokens, self.columns, self.target, self.settings, self.seed, self.library)
            except (ValueError, IndexError):
                out[key] = (float("nan"), [])
        found = fit_together(self.data, list(together.values()), self.columns, self.target, self.settings, self.seed, self.library)
        return out | dict(zip(together, found, strict=True))

    def _score(self, todo: list[tuple[str, list[str]]]) -> dict[str, tuple[float, list[float]]]:
        if self.ranking == "bed":
            return self._gaps(todo)
        rows = self._rows()
        if rows is None:
            return self._score_free(todo) | self._fit_distributed(todo)
        spark = self.data.sparkSession
        frame = spark.createDataFrame(todo, "expr_key string, tokens array<string>").repartition(min(len(todo), spark.sparkContext.defaultParallelism))
        return {r["expr_key"]: (r["error"], list(r["parameters"])) for r in fit_many(frame, *rows, self.settings, self.seed, self.library).collect()}

    def evaluate(self, expressions: Iterable[list[str]], simplified: bool = False) -> list[float]:
        """Errors of expressions in order. After a stop they are NaN and aren't recorded, but still counted as calls."""
        batch = []
        for tokens in expressions:
            tokens = list(tokens)
            if simplified:
                try:
                    tokens = simplify(tokens, self.library)
                except (ValueError, IndexError, ZeroDivisionError):
                    warnings.warn(f"{''.join(tokens)} couldn't be simplified", stacklevel=2)
            batch.append(("".join(tokens), tokens))
        new: dict[str, list[str]] = {}
        for key, tokens in batch:
            if key not in self.models and not self.stopped:
                new.setdefault(key, tokens)
        found = self._score(list(new.items())) if new else {}
        out = []
        for key, tokens in batch:
            self.calls += 1
            if self.stopped:
                out.append(float("nan"))
                continue
            hit = key in self.models
            if not hit:
                error, parameters = found.get(key, (float("nan"), []))
                if error is None or np.isnan(error):
                    error = float("nan")
                    self.invalid.append(key)
                self.models[key] = {"expr_key": key, "tokens": tokens, "error": error, "parameters": parameters, "eval_no": self.calls}
            error = self.models[key]["error"]
            better = not hit and error < self.best
            self.best = error if better else self.best
            self._tell(Event(key, error, self.calls, self.experiment_id, better, hit))
            out.append(error)
        return out

    def _tell(self, event: Event) -> None:
        stop = event.is_new_best and self.threshold is not None and event.error < self.threshold
        stop |= 0 <= self.max_evaluations <= event.eval_no
        for c in self.callbacks:  # all are told, whatever one of them answers
            stop |= c.on_evaluated(event) is False
            if event.is_new_best:
                stop |= c.on_best(event) is False
        self.stopped |= stop

    # storing

    def to_dict(self) -> dict:
        """Everything but the data and the memory of models."""
        return {"format_version": 1, "columns": self.columns, "target": self.target, "library": self.library.to_dict(), "max_evaluations": self.max_evaluations, "threshold": self.threshold, "ranking": self.ranking, "ground_truth": self.ground_truth, "seed": self.seed, "settings": asdict(self.settings), "metadata": self.metadata}

    @classmethod
    def from_dict(cls, d: dict, data: DataFrame) -> Evaluator:
        d = {k: v for k, v in d.items() if k != "format_version"}
        settings = {k: tuple(v) if isinstance(v, list) else v for k, v in d.pop("settings").items()}
        return cls(data, d.pop("columns"), d.pop("target"), SymbolLibrary.from_dict(d.pop("library")), settings=Settings(**settings), **d)

    # results

    def frame(self, spark=None) -> DataFrame:
        rows = [(self.experiment_id, m["eval_no"], m["expr_key"], m["tokens"], m["error"], m["parameters"]) for m in self.models.values()]
        return (spark or self.data.sparkSession).createDataFrame(rows, "experiment_id string, eval_no long, expr_key string, tokens array<string>, error double, parameters array<double>")

    def results(self, approach: str = "", top_k: int = 20) -> Result:
        if not self.models:
            raise ValueError("nothing has been evaluated")
        order = sorted(self.models.values(), key=lambda m: (np.isnan(m["error"]), m["error"], m["eval_no"]))
        k = len(order) if top_k < 0 or top_k > len(order) else top_k
        success = self.threshold is not None and order[0]["error"] < self.threshold
        return Result(order[0]["error"], order[0]["expr_key"], len(self.models), self.calls, order[:k], list(self.models.values()), bool(success), approach, {**self.metadata, "seed": self.seed})


def behaviour_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Behaviour distance of two matrices (points by constant vectors) in memory; see score.behaviour_distance."""
    if len(a) != len(b) or not len(a):
        raise ValueError("behaviours need the same points, and at least one")
    fa, fb = np.isfinite(a).any(axis=1), np.isfinite(b).any(axis=1)
    if (fa != fb).any():
        return float("inf")
    a, b = a[fa], b[fa]
    if np.isinf(a).any() or np.isinf(b).any():
        return float("inf")
    return sum(wasserstein_arrays(x[~np.isnan(x)], y[~np.isnan(y)]) for x, y in zip(a, b, strict=True)) / len(fa)
