"""Augmentations of results: LaTeX, simplified forms, and scores on other data, for the best, top or all models."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from ..functions.simplify import simplify
from ..functions.symbols import SymbolLibrary
from ..functions.tree import latex
from ..plans.compile import evaluate as run_expression
from .evaluator import Evaluator, Result, behaviour_gap

SCOPES = ("best", "top", "all")


class Augmenter:
    """Gives a dict for a model; scope says which models get it."""

    def __init__(self, name: str, scope: str = "top"):
        if scope not in SCOPES:
            raise ValueError(f"scope must be one of {SCOPES}")
        self.name, self.scope = name, scope

    def of(self, model: dict) -> dict:
        raise NotImplementedError

    def write(self, result: Result) -> None:
        models = {"best": result.top_models[:1], "top": result.top_models, "all": result.all_models}[self.scope]
        for m in models:
            found = m.setdefault("augmentations", {})
            found[unused(self.name, found)] = self.of(m)
        if result.top_models:
            best = result.top_models[0]
            own = best.get("augmentations", {})
            names = [n for n in own if n == self.name or n.rpartition("_")[0] == self.name]
            result.augmentations[unused(self.name, result.augmentations)] = own[names[-1]]


def unused(name: str, taken: dict) -> str:
    """name, or name_1, name_2, .."""
    k, out = 0, name
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    return out


class ToLatex(Augmenter):
    def __init__(self, library: SymbolLibrary, scope: str = "top", name: str = "latex"):
        super().__init__(name, scope)
        self.library = library

    def of(self, model: dict) -> dict:
        return {"expr_latex": latex(model["tokens"], self.library)}


class Simplified(Augmenter):
    def __init__(self, library: SymbolLibrary, scope: str = "top", name: str = "simplified"):
        super().__init__(name, scope)
        self.library = library

    def of(self, model: dict) -> dict:
        return {"simplified_expr": "".join(simplify(model["tokens"], self.library))}


class Refit(Augmenter):
    """Error on other data with constants fitted anew to them; frozen=True keeps the model's constants, as a hold-out score."""

    def __init__(self, evaluator: Evaluator, scope: str = "top", name: str = "rmse", frozen: bool = False):
        super().__init__(name, scope)
        self.evaluator, self.frozen = evaluator, frozen

    def score(self, model: dict) -> tuple[float, list[float]]:
        e = self.evaluator
        if self.frozen:
            rows = e._rows()
            if rows is None:
                from .score import rmse

                return rmse(e.data, model["tokens"], e.columns, e.target, model["parameters"], e.library).first()[0], model["parameters"]
            d = run_expression(model["tokens"], rows[0], model["parameters"], e.library) - rows[1]
            return float((d @ d / len(d)) ** 0.5), model["parameters"]
        key = "".join(model["tokens"])
        return e._score([(key, model["tokens"])])[key]

    def of(self, model: dict) -> dict:
        error, parameters = self.score(model)
        return {"error": error, "parameters": parameters}


class Determination(Refit):
    """R squared on other data, at least 0."""

    def __init__(self, evaluator: Evaluator, scope: str = "top", name: str = "r2", frozen: bool = False):
        super().__init__(evaluator, scope, name, frozen)

    def of(self, model: dict) -> dict:
        from pyspark.sql import functions as F

        error, parameters = self.score(model)
        e = self.evaluator
        spread = e.data.agg(F.var_pop(F.col(e.target).cast("double"))).first()[0]
        raw = 1 - error * error / spread if spread else float("nan")
        return {"r2": raw if raw > 0 else 0.0, "parameters": parameters}


class Behaviour(Augmenter):
    """Behaviour distance to the ground truth of an evaluator."""

    def __init__(self, evaluator: Evaluator, scope: str = "top", name: str = "bed"):
        super().__init__(name, scope)
        self.evaluator = evaluator

    def of(self, model: dict) -> dict:
        e = self.evaluator
        return {"bed": behaviour_gap(e._behaviour(model["tokens"], e.seed), e._behaviour(e.ground_truth, e.seed))}


class Custom(Augmenter):
    def __init__(self, name: str, fn: Callable[[dict], dict], scope: str = "top"):
        super().__init__(name, scope)
        self.of = fn


def augment(result: Result, augmenters: list[Augmenter]) -> Result:
    """Writes every augmentation; one that fails is left out with a warning."""
    for a in augmenters:
        try:
            a.write(result)
        except Exception as e:  # noqa: BLE001  an augmentation is extra: the result stands without it
            warnings.warn(f"{a.name} failed: {e}", stacklevel=2)
    return result
