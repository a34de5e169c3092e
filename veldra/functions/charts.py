"""Chart parsing of sequences by a weighted grammar: inside probabilities, expected rule counts, likeliest derivations, learnt weights."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import Grammar, Rule


class Chart:
    """All derivations of a sequence at once, as sums of products over spans.

    A cell is a side, or the first symbols of a rule, over a span; its terms are products of the cells that it splits into. Every cell is filled once,
    after those that it needs, so that the same list read backwards tells how much each of them adds to the whole. Rules mustn't be empty, nor lead
    from a side back to itself without a further symbol. Time goes with the cube of the length.
    """

    def __init__(self, grammar: Grammar, tokens: Sequence[str], weights: Sequence[float] | None = None):
        self.grammar, self.tokens = grammar, list(tokens)
        totals = {lhs: sum(r.weight for r in rules) for lhs, rules in grammar.by_lhs.items()}
        self.weights = [r.weight / totals[r.lhs] for r in grammar.rules] if weights is None else list(weights)
        self.rules = {lhs: [k for k, r in enumerate(grammar.rules) if r.lhs == lhs] for lhs in grammar.by_lhs}
        if any(not r.rhs for r in grammar.rules):
            raise ValueError("a rule without symbols can't be parsed")
        self.values: list[float] = []
        self.terms: list[list[tuple[int, int, int]]] = []  # of each cell: (rule or -1, cell or -1, cell or -1)
        self.place: dict[tuple, int] = {}
        self.open: set[tuple] = set()
        n = len(self.tokens)
        for wide in range(1, n):  # short spans first, so that none asks deeply for others
            for i in range(n - wide + 1):
                for lhs in self.rules:
                    self._side(lhs, i, i + wide)
        self.root = self._side(grammar.start, 0, n) if self.tokens else -1

    def _keep(self, key: tuple, terms: list[tuple[int, int, int]]) -> int:
        get = lambda k: 1.0 if k < 0 else self.values[k]
        self.values.append(sum((self.weights[r] if r >= 0 else 1.0) * get(a) * get(b) for r, a, b in terms))
        self.terms.append(terms)
        self.place[key] = len(self.values) - 1
        return self.place[key]

    def _side(self, lhs: str, i: int, j: int) -> int:
        key = (lhs, i, j)
        if key in self.place:
            return self.place[key]
        if key in self.open:
            raise ValueError(f"{lhs} leads back to itself")
        self.open.add(key)
        terms = [(r, cell, -1) for r in self.rules[lhs] if (cell := self._first(r, len(self.grammar.rules[r].rhs), i, j)) >= -1]
        self.open.remove(key)
        return self._keep(key, terms)

    def _first(self, r: int, k: int, i: int, j: int) -> int:
        """The cell of a rule's first k symbols over a span; -1 for nothing over nothing, -2 where there is no way."""
        if k == 0:
            return -1 if i == j else -2
        if j - i < k:
            return -2
        key = (r, k, i, j)
        if key in self.place:
            return self.place[key]
        symbol = self.grammar.rules[r].rhs[k - 1]
        terms = []
        if symbol not in self.grammar.by_lhs:
            before = self._first(r, k - 1, i, j - 1) if self.tokens[j - 1] == symbol else -2
            terms = [(-1, before, -1)] if before >= -1 else []
        else:
            for cut in range(i + k - 1, j) if k > 1 else (i,):
                before = self._first(r, k - 1, i, cut)
                if before >= -1:
                    terms.append((-1, before, self._side(symbol, cut, j)))
        return self._keep(key, terms)

    @property
    def inside(self) -> float:
        """The sequence's probability; 0 if the grammar doesn't derive it."""
        return self.values[self.root] if self.root >= 0 else 0.0

    def counts(self) -> np.ndarray:
        """How often each rule is applied in a derivation of the sequence, on average by their probabilities."""
        out = np.zeros(len(self.weights))
        if self.inside <= 0:
            return out
        share = np.zeros(len(self.values))
        share[self.root] = 1 / self.inside
        get = lambda k: 1.0 if k < 0 else self.values[k]
        for cell in range(len(self.values) - 1, -1, -1):  # every cell stands behind those that it needs
            if not share[cell]:
                continue
            for r, a, b in self.terms[cell]:
                w = self.weights[r] if r >= 0 else 1.0
                if r >= 0:
                    out[r] += share[cell] * w * get(a) * get(b)
                if a >= 0:
                    share[a] += share[cell] * w * get(b)
                if b >= 0:
                    share[b] += share[cell] * w * get(a)
        return out

    def likeliest(self) -> list[Rule]:
        """The rules of the likeliest derivation, leftmost first; of equal ones that of the earliest rules and cuts. Empty without one."""
        if self.inside <= 0:
            return []
        best = [0.0] * len(self.values)
        by = [-1] * len(self.values)
        get = lambda k: 1.0 if k < 0 else best[k]
        for cell, terms in enumerate(self.terms):
            for k, (r, a, b) in enumerate(terms):
                p = (self.weights[r] if r >= 0 else 1.0) * get(a) * get(b)
                if p > best[cell]:
                    best[cell], by[cell] = p, k
        out, todo = [], [self.root]
        while todo:
            cell = todo.pop()
            if cell < 0:
                continue
            r, a, b = self.terms[cell][by[cell]]
            if r >= 0:
                out.append(self.grammar.rules[r])
            todo += [b, a]
        return out


def rule_counts(sequences: DataFrame, tokens: str, grammar: Grammar, weights: Sequence[float] | None = None) -> DataFrame:
    """One row for each rule: rule_id, n (expected applications over all sequences), parsed, unparsed (sequences), log_likelihood of the parsed.

    A task adds up its own sequences, so that a row for each rule and task is all that travels. Equal sequences of a batch are parsed once. Null
    and empty sequences are unparsed. An empty table gives zeros.
    """
    names = ["rule_id", "n", "parsed", "unparsed", "log_likelihood"]
    rules = len(grammar.rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parsed, unparsed, told = np.zeros(rules), 0, 0, 0.0
        for batch in batches:
            often: dict[tuple[str, ...], int] = {}
            for row in batch.column(0).to_pylist():
                key = tuple(row or ())
                often[key] = often.get(key, 0) + 1
            for key, n in often.items():
                chart = Chart(grammar, key, weights)
                if chart.inside > 0:
                    counts += n * chart.counts()
                    parsed, told = parsed + n, told + n * math.log(chart.inside)
                else:
                    unparsed += n
        columns = [pa.array(range(rules), pa.int32()), pa.array(counts), *(pa.array([x] * rules, t) for x, t in ((parsed, pa.int64()), (unparsed, pa.int64()), (told, pa.float64())))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    found = sequences.select(tokens).mapInArrow(run, "rule_id int, n double, parsed long, unparsed long, log_likelihood double")
    zero = sequences.sparkSession.range(rules).selectExpr("cast(id as int) AS rule_id", "0.0D AS n", "0L AS parsed", "0L AS unparsed", "0.0D AS log_likelihood")
    return found.unionByName(zero).groupBy("rule_id").agg(*(F.sum(c).alias(c) for c in names[1:]))


def learnt(sequences: DataFrame, tokens: str, grammar: Grammar, rounds: int = 5) -> tuple[Grammar, list[float]]:
    """(the grammar with weights that make the sequences likelier, their log likelihood before each round): expectation and maximisation in turn.

    A round is a pass over the sequences; the driver gets a row for each rule. Rules of a side without applications keep their weights.
    """
    now, told = grammar, []
    for _ in range(rounds):
        rows = {r["rule_id"]: r for r in rule_counts(sequences, tokens, now).collect()}
        told.append(rows[0]["log_likelihood"])
        totals: dict[str, float] = {}
        for k, r in enumerate(now.rules):
            totals[r.lhs] = totals.get(r.lhs, 0.0) + rows[k]["n"]
        own = [Rule(r.lhs, r.rhs, rows[k]["n"] / totals[r.lhs] if totals[r.lhs] > 0 else r.weight, r.name) for k, r in enumerate(now.rules)]
        now = Grammar(now.start, own, now.constraints)
    return now, told
