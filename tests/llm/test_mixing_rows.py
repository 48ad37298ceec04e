"""The mix keeps every row whatever its columns are, and its targets are those of resharing step by step."""

import collections
import random

import pytest

from buswright.llm import mixing

NESTED = "doc_id long, text string, source string, m map<string,int>, s struct<m:map<int,array<string>>,x:int>, a array<array<int>>"


def key(v):
    if isinstance(v, dict):
        return tuple(sorted((k, key(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(key(x) for x in v)
    return v


def test_rows_that_differ_in_a_nested_column_alone_all_stay(spark):
    base = [(1, "a b c", "s", {"k": 1}, ({1: ["x"]}, 1), [[1], [2]])]
    odd = [{"k": 2}, {"k": None}, {}, None, {"k": 1, "l": 1}]
    rows = base + [(1, "a b c", "s", m, ({1: ["x"]}, 1), [[1], [2]]) for m in odd]
    rows += [(1, "a b c", "s", {"k": 1}, s, [[1], [2]]) for s in [({1: ["y"]}, 1), ({1: [None, "x"]}, 1), ({1: ["x", None]}, 1), (None, 1), ({1: ["x"]}, None), None, ({}, 1)]]
    rows += [(1, "a b c", "s", {"k": 1}, ({1: ["x"]}, 1), a) for a in [[[1, 2]], [[1], [2], []], [[], [1], [2]], [None, [1], [2]], [[1], None, [2]], [[None, 1], [2]], [], None]]
    rows += [(None, "a b c", "s", {"k": 1}, None, None), (None, "a b c", "s", {"k": 2}, None, None)]
    d = spark.createDataFrame(rows + base, NESTED).repartition(3)
    got = mixing.training_order(d)
    assert got.columns == [*d.columns, "mix_position"]
    count = collections.Counter(key(tuple(r)[:-1]) for r in got.collect())
    # one source takes all of itself once: each row, and the repeated one twice
    assert count == collections.Counter(key(tuple(r)) for r in d.collect())
    assert len(count) == len(rows) and max(count.values()) == 2


def test_a_plan_of_no_documents_is_empty(spark):
    none = spark.createDataFrame([], NESTED)
    assert mixing.training_order(none).collect() == [] and mixing.mix_plan(none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing_until_none_is_above_its_cap(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([1, 5, 40, 900, 30_000]) for i in range(r.randrange(1, 9))}
    rows = [(i, " ".join(["w"] * 1), s) for i, s in enumerate(sizes)]
    table = spark.createDataFrame([(i, n, s) for (i, _, s), n in zip(rows, sizes.values(), strict=True)], "doc_id long, size long, source string")
    got = {x.source: x.target for x in mixing.source_targets(table).collect()}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    target, closed, left = dict.fromkeys(sizes, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(closed) < len(sizes):
        all_ = sum(w for s, w in weight.items() if s not in closed)
        share = {s: left * w / all_ for s, w in weight.items() if s not in closed}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                closed.add(s)
    assert got == pytest.approx(target, rel=1e-6)
