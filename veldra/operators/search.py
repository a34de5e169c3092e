"""Searches: sampling a grammar, and evolving expressions. Batches are generated and scored in parallel; stops are exact."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np

from ..functions.grammar import Derivation, Grammar, generate, generate_one
from ..functions.symbols import SymbolLibrary
from ..functions.tree import Node, parse
from .evaluator import Evaluator, Result


@dataclass
class Approach:
    """A search method. scope says how often adapt() runs: never, once (for all experiments) or experiment."""

    name: str = "approach"
    scope: str = "never"

    def prepare(self) -> None: ...

    def adapt(self, data, library: SymbolLibrary) -> None: ...

    def state(self) -> dict:
        return {}

    def restore(self, state: dict) -> None: ...

    def search(self, evaluator: Evaluator, seed: int | None = None) -> None:
        raise NotImplementedError

    def to_dict(self) -> dict:
        return {"approach": type(self).__name__, **{k: v for k, v in asdict(self).items()}}

    @staticmethod
    def from_dict(d: dict) -> Approach:
        d = dict(d)
        return APPROACHES[d.pop("approach")](**d)


@dataclass
class GrammarSampling(Approach):
    """Monte-Carlo sampling of a weighted grammar until the evaluator stops.

    Batches are drawn in parallel and scored in parallel; a batch may hold expressions past the stop, which are then not recorded.
    """

    name: str = "grammar_sampling"
    grammar: str | None = None
    batch: int = 256
    most_batches: int = 100_000
    max_length: int = 50

    def search(self, evaluator: Evaluator, seed: int | None = None) -> None:
        if evaluator.max_evaluations < 0 and evaluator.threshold is None:
            raise ValueError("a search without a budget and a threshold has no end")
        grammar = Grammar.read(self.grammar) if self.grammar else Grammar.of_library(evaluator.library)
        spark = evaluator.data.sparkSession
        for k in range(self.most_batches):
            if evaluator.stopped:
                return
            left = evaluator.max_evaluations - evaluator.calls if evaluator.max_evaluations >= 0 else self.batch
            n = max(1, min(self.batch, left))
            rows = generate(spark, grammar, n, (seed or 0) * 1_000_003 + k, self.max_length).orderBy("sample_id").collect()
            evaluator.evaluate([list(r["tokens"]) for r in rows])


@dataclass
class Evolution(Approach):
    """Evolves expression trees: tournaments, subtree crossover and mutation by the grammar; NaN is worst."""

    name: str = "evolution"
    population: int = 40
    generations: int = 50
    mutation: float = 0.3
    max_length: int = 30

    def search(self, evaluator: Evaluator, seed: int | None = None) -> None:
        rng = np.random.default_rng(seed)
        library = evaluator.library
        grammar = Grammar.of_library(library)

        def fresh() -> list[str]:
            while True:
                t = generate_one(grammar, rng)
                if t is not None and len(t) <= self.max_length:
                    return t

        crowd = [fresh() for _ in range(self.population)]
        fitness = self._fitness(evaluator, crowd)
        for _ in range(self.generations):
            if evaluator.stopped:
                return
            children = []
            while len(children) < self.population:
                a, b = (self._pick(crowd, fitness, rng) for _ in range(2))
                child = self._cross(parse(a, library), parse(b, library), rng)
                if rng.random() < self.mutation:
                    child = self._cross(child, parse(fresh(), library), rng)
                tokens = child.to_list(library)
                children.append(tokens if len(tokens) <= self.max_length else fresh())
            scores = self._fitness(evaluator, children)
            both = sorted(zip([*fitness, *scores], range(2 * self.population), [*crowd, *children], strict=True))[: self.population]
            fitness, crowd = [s for s, _, _ in both], [c for _, _, c in both]

    def _fitness(self, evaluator: Evaluator, crowd: list[list[str]]) -> list[float]:
        return [float("inf") if np.isnan(e) else e for e in evaluator.evaluate(crowd)]

    def _pick(self, crowd, fitness, rng) -> list[str]:
        at = rng.integers(0, len(crowd), 3)
        return crowd[min(at, key=lambda i: fitness[i])]

    def _cross(self, a: Node, b: Node, rng) -> Node:
        """a with a random subtree replaced by one of b."""
        at = int(rng.integers(len(a)))
        new = list(b.postorder())[int(rng.integers(len(b)))]
        nodes = list(a.postorder())
        return a._fold(lambda n, x, y: new if n is nodes[at] else Node(n.symbol, y, x))


@dataclass
class LatentEvolution(Approach):
    """Evolves real vectors that a grammar decodes: convex crossover, mutation scaled by the spread of the population.

    The i-th choice of a derivation is the rule at which the cumulated chances pass the i-th coordinate, taken as a normal
    quantile. adapt() samples expressions and keeps the vectors of the readable ones as the start of every search.
    """

    name: str = "latent_evolution"
    scope: str = "once"
    latent_size: int = 32
    population: int = 40
    generations: int = 50
    mutation: float = 0.5
    max_length: int = 30
    samples: int = 400

    def __post_init__(self):
        self.start: list[list[float]] = []

    def decode(self, grammar: Grammar, z: np.ndarray) -> list[str] | None:
        """Tokens of a vector; None if its coordinates are used up before the derivation is complete."""
        d = Derivation(grammar)
        for x in z:
            if d.complete:
                break
            options = d.options()
            if not options:
                return None
            u = 0.5 * (1 + math.erf(float(x) / math.sqrt(2)))
            at = int(np.searchsorted(np.cumsum([w for _, w in options]), u))
            d.apply(options[min(at, len(options) - 1)][0])
        if not d.complete or len(d.tokens()) > self.max_length:
            return None
        return d.tokens()

    def adapt(self, data, library: SymbolLibrary) -> None:
        grammar = Grammar.of_library(library)
        spark, own = data.sparkSession, self

        def run(frames):
            import pandas as pd

            for pdf in frames:
                found = []
                for i in pdf["id"]:
                    z = np.random.default_rng([own.latent_size, int(i)]).standard_normal(own.latent_size)
                    if own.decode(grammar, z) is not None:
                        found.append((int(i), z.tolist()))
                yield pd.DataFrame(found, columns=["id", "z"])

        rows = spark.range(self.samples).mapInPandas(run, "id long, z array<double>").orderBy("id").collect()
        self.start = [list(r["z"]) for r in rows]

    def state(self) -> dict:
        return {"start": self.start} if self.start else {}

    def restore(self, state: dict) -> None:
        self.start = state.get("start", [])

    def search(self, evaluator: Evaluator, seed: int | None = None) -> None:
        if not self.start:
            self.adapt(evaluator.data, evaluator.library)
        rng = np.random.default_rng(seed)
        grammar = Grammar.of_library(evaluator.library)
        pool = np.array(self.start)
        crowd = pool[rng.choice(len(pool), self.population, replace=len(pool) < self.population)]
        fitness = self._fitness(evaluator, grammar, crowd)
        for _ in range(self.generations):
            if evaluator.stopped:
                return
            at = np.array([[min(rng.integers(0, len(crowd), 3), key=lambda i: fitness[i]) for _ in range(2)] for _ in range(self.population)])
            share = rng.random((self.population, 1))
            children = share * crowd[at[:, 0]] + (1 - share) * crowd[at[:, 1]]
            children += (rng.random((self.population, 1)) < self.mutation) * rng.standard_normal(children.shape) * (crowd.std(axis=0) + 0.1)
            scores = self._fitness(evaluator, grammar, children)
            both, all_scores = np.concatenate([crowd, children]), np.concatenate([fitness, scores])
            best = np.argsort(all_scores, kind="stable")[: self.population]
            crowd, fitness = both[best], all_scores[best]

    def _fitness(self, evaluator: Evaluator, grammar: Grammar, crowd: np.ndarray) -> np.ndarray:
        decoded = [self.decode(grammar, z) for z in crowd]
        errors = iter(evaluator.evaluate([t for t in decoded if t is not None]))
        scores = np.array([np.inf if t is None else next(errors) for t in decoded])
        return np.where(np.isnan(scores), np.inf, scores)


APPROACHES = {c.__name__: c for c in (GrammarSampling, Evolution, LatentEvolution)}


def run(dataset, spark, approach: Approach, experiments: int = 1, seed: int = 0, top_k: int = 20, callbacks=(), store=None, **settings) -> list[Result]:
    """Experiments with seeds seed + 1, seed + 2, ..; the approach adapts as its scope says."""
    out = []
    if approach.scope == "once" and not approach.state():
        approach.adapt(dataset.load(spark, store), dataset.library)
    for k in range(experiments):
        own = seed + 1 + k
        approach.prepare()
        evaluator = dataset.evaluator(spark, store, own, **settings)
        evaluator.callbacks = list(callbacks)
        if approach.scope == "experiment":
            approach.adapt(evaluator.data, dataset.library)
        info = {"dataset_name": dataset.name, "approach": approach.name, "seed": own, "max_evaluations": evaluator.max_evaluations, "threshold": evaluator.threshold}
        for c in callbacks:
            c.on_start(info)
        approach.search(evaluator, own)
        result = evaluator.results(approach.name, top_k)
        for c in callbacks:
            c.on_end(info, result)
        out.append(result)
    return out
