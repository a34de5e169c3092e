"""Callbacks of a search."""

from __future__ import annotations

import json

from .evaluator import Event


class Callback:
    """Override what is needed. Answering False from on_evaluated or on_best ends the search."""

    def on_start(self, info: dict) -> None: ...

    def on_evaluated(self, event: Event) -> bool | None: ...

    def on_best(self, event: Event) -> bool | None: ...

    def on_end(self, info: dict, result) -> None: ...


class EarlyStop(Callback):
    """Ends a search below a threshold or at a number of evaluations; what isn't given comes from the experiment."""

    def __init__(self, threshold: float | None = None, max_evaluations: int | None = None):
        self.threshold, self.max_evaluations = threshold, max_evaluations

    def on_start(self, info: dict) -> None:
        self.threshold = info.get("threshold") if self.threshold is None else self.threshold
        self.max_evaluations = info.get("max_evaluations") if self.max_evaluations is None else self.max_evaluations

    def on_evaluated(self, event: Event) -> bool | None:
        return False if self.max_evaluations is not None and 0 <= self.max_evaluations <= event.eval_no else None

    def on_best(self, event: Event) -> bool | None:
        return False if self.threshold is not None and event.error < self.threshold else None


class Log(Callback):
    """Appends each new best as a line of JSON; {dataset}, {approach} and {seed} in the path are filled in at the start."""

    def __init__(self, path: str):
        self.template = self.path = path

    def on_start(self, info: dict) -> None:
        self.path = self.template.format(dataset=info.get("dataset_name"), approach=info.get("approach"), seed=info.get("seed"))

    def on_best(self, event: Event) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"expr": event.expr_key, "error": event.error, "eval_no": event.eval_no}) + "\n")


class Progress(Callback):
    """Counts evaluations and keeps the best; show() is a line of text."""

    def __init__(self):
        self.n, self.best, self.total = 0, None, None

    def on_start(self, info: dict) -> None:
        self.n, self.best, self.total = 0, None, info.get("max_evaluations")

    def on_evaluated(self, event: Event) -> None:
        self.n = event.eval_no

    def on_best(self, event: Event) -> None:
        self.best = (event.expr_key, event.error)

    def show(self) -> str:
        return f"{self.n}/{self.total if self.total and self.total > 0 else '?'} best {self.best[0]} ({self.best[1]:.6g})" if self.best else f"{self.n}"


class Several(Callback):
    """Tells all of several callbacks, in order; one False is enough to end the search."""

    def __init__(self, *callbacks: Callback):
        self.callbacks = list(callbacks)

    def add(self, c: Callback) -> None:
        self.callbacks.append(c)

    def remove(self, c: Callback) -> None:
        self.callbacks.remove(c)

    def on_start(self, info: dict) -> None:
        for c in self.callbacks:
            c.on_start(info)

    def on_evaluated(self, event: Event) -> bool | None:
        return False if any([c.on_evaluated(event) is False for c in self.callbacks]) else None

    def on_best(self, event: Event) -> bool | None:
        return False if any([c.on_best(event) is False for c in self.callbacks]) else None

    def on_end(self, info: dict, result) -> None:
        for c in self.callbacks:
            c.on_end(info, result)
