import itertools
import math

import numpy as np
import pytest

from veldra.functions.charts import Chart, learnt, rule_counts
from veldra.functions.grammar import Derivation, Grammar, validate

SUMS = "E -> E '+' E [0.3] | E '*' E [0.2] | 'x' [0.5]"
MIXED = "S -> A B [0.4] | A [0.1] | S 'c' S [0.5]\nA -> 'a' [0.5] | 'a' A [0.5]\nB -> 'b' [0.3] | 'a' 'b' [0.3] | B B [0.4]"


def derivations(grammar, tokens):
    """All leftmost derivations of a sequence, as lists of rule numbers with their probabilities: by trying every rule."""
    totals = {lhs: sum(r.weight for r in rules) for lhs, rules in grammar.by_lhs.items()}
    out, todo = [], [((grammar.start,), (), 1.0)]
    while todo:
        form, used, p = todo.pop()
        at = next((k for k, s in enumerate(form) if s in grammar.by_lhs), None)
        if len(form) > len(tokens) or tuple(form[:at]) != tuple(tokens[: at if at is not None else len(form)]):
            continue
        if at is None:
            if len(form) == len(tokens):
                out.append((used, p))
            continue
        for k, r in enumerate(grammar.rules):
            if r.lhs == form[at]:
                todo.append(((*form[:at], *r.rhs, *form[at + 1 :]), (*used, k), p * r.weight / totals[r.lhs]))
    return out


@pytest.mark.parametrize(("text", "letters", "most"), [(SUMS, "x+*", 7), (MIXED, "abc", 6)])
def test_charts_equal_all_derivations(text, letters, most):
    g = Grammar.read(text)
    seen = 0
    for n in range(1, most + 1):
        for tokens in itertools.islice(itertools.product(letters, repeat=n), 0, None, 1 if n < 5 else 7):
            want = derivations(g, tokens)
            chart = Chart(g, tokens)
            total = sum(p for _, p in want)
            assert chart.inside == pytest.approx(total, abs=1e-15)
            counts = np.zeros(len(g.rules))
            for used, p in want:
                for k in used:
                    counts[k] += p / total
            assert chart.counts() == pytest.approx(counts)
            best = chart.likeliest()
            assert bool(best) == bool(want)
            if want:
                seen += len(want) > 1
                told = math.prod(r.weight / sum(x.weight for x in g.by_lhs[r.lhs]) for r in best)
                assert told == pytest.approx(max(p for _, p in want)) and validate(g, best)
                d = Derivation(g)
                for r in best:
                    d.apply(r)
                assert d.tokens() == list(tokens)
    assert seen > 1  # ambiguous ones were among them


def test_grammars_that_cannot_be_parsed():
    with pytest.raises(ValueError):
        Chart(Grammar.read("S -> S | 'a'"), ["a"])
    assert Chart(Grammar.read("S -> 'a'"), []).inside == 0 and Chart(Grammar.read("S -> 'a'"), ["b"]).likeliest() == []


def test_counts_and_weights_over_a_table(spark):
    g = Grammar.read(MIXED)
    rng = np.random.default_rng(4)
    drawn = []
    while len(drawn) < 150:
        try:
            t = Derivation(g).generate(rng, 40)
        except RuntimeError:
            continue
        if len(t) <= 9:
            drawn.append((t, 1))
    rows = [*drawn, (["c"], 1), ([], 1), (None, 1)]
    df = spark.createDataFrame(rows, "t array<string>, n int").repartition(5)
    got = {r.rule_id: r for r in rule_counts(df, "t", g).collect()}
    want = sum(Chart(g, t).counts() for t, _ in drawn)
    assert [got[k].n for k in range(len(g.rules))] == pytest.approx(want.tolist())
    assert got[0].parsed == 150 and got[0].unparsed == 3
    assert got[0].log_likelihood == pytest.approx(sum(math.log(Chart(g, t).inside) for t, _ in drawn))
    flat = Grammar.read(MIXED.replace("0.4", "0.2").replace("0.1", "0.6").replace("0.3", "0.1"))
    better, told = learnt(df, "t", flat, 4)
    assert all(b > a - 1e-9 for a, b in zip(told, told[1:], strict=False)) and told[-1] > told[0]
    for rules in better.by_lhs.values():
        assert sum(r.weight for r in rules) == pytest.approx(1)
    assert {r.n for r in rule_counts(df.limit(0), "t", g).collect()} == {0.0}
