"""The n-gram join on groups of texts that share much and are many: texts put together from the same passages."""

import random

import numpy as np
import pyarrow as pa
import pytest

from buswright.llm import ngram_join


def scattered(r, count, passages=12, taken=8):
    """Texts of passages in random order, and copies of every tenth with up to three words changed."""
    known = [[f"p{k}x{r.randrange(10**6)}" for _ in range(10)] for k in range(passages)]
    texts = [[w for p in r.sample(known, taken) for w in p] for _ in range(count)]
    for base in texts[:count:10]:
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(len(copy))] = f"e{r.random()}"
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def by_force(rows, percent=85, width=4):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for i, w in ((i, t.split()) for i, t in rows)}
    name = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and name[a] != name[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((name[a], name[b]))
                name = {i: low if n == high else n for i, n in name.items()}
    return name


@pytest.mark.parametrize("frequent", [256, 4])
def test_texts_of_scattered_passages_link_as_all_pairs_give(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "_BLOCK", 20)
    went, parts = [], ngram_join._by_parts
    monkeypatch.setattr(ngram_join, "_by_parts", lambda *a: went.append(1) or parts(*a))
    rows = scattered(random.Random(5), 150)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.linked(d, ngram_join.Rule(frequent=frequent)).collect()}
    assert got == by_force(rows) and went


@pytest.mark.parametrize("rule", [ngram_join.Rule(), ngram_join.Rule(5, 80)])
def test_sets_that_link_have_an_entry_of_parts_in_common(rule):
    r = np.random.default_rng(1)
    tried = 0
    while tried < 400:
        n = int(r.integers(1, 300))
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        gone, new = int(r.integers(0, n // 8 + 1)), int(r.integers(0, n // 8 + 1))
        other = np.concatenate([base[gone:], r.integers(0, 2**63, new, dtype=np.uint64)])
        both = n - gone
        if not len(other) or 100 * both < rule.percent * (n + new):
            continue
        tried += 1
        one, two = ({b: (own, sketch, set(e.tolist())) for b, own, sketch, e in ngram_join.set_parts(k, rule)} for k in (base, other))
        home = next(b for b, (own, *_) in (one if n <= len(other) else two).items() if own)
        assert one[home][2] & two[home][2]
        differ = ngram_join.unequal(pa.array([one[home][1].tobytes()]), pa.array([two[home][1].tobytes()]))
        assert differ[0] <= ngram_join.most_unequal(n, len(other), rule)


def test_sketches_of_other_sets_differ_in_more_parts_than_links_may():
    r, rule = np.random.default_rng(2), ngram_join.Rule()
    known = r.integers(0, 2**63, 600, dtype=np.uint64)
    sketches = [next(s for _, own, s, _ in ngram_join.set_parts(r.permutation(known)[:400], rule) if own) for _ in range(40)]
    x, y = (pa.array([s.tobytes() for s in half]) for half in (sketches[:20], sketches[20:]))
    assert (ngram_join.unequal(x, y) > ngram_join.most_unequal(400, 400, rule)).all()


def test_bands_cover_every_size_once():
    edges = ngram_join.size_bands(5000)
    assert edges[0] == 1 and edges[-1] > 5000 and (np.diff(edges) > 0).all()
    assert (edges[1:] <= np.maximum(edges[:-1] + 1, edges[:-1] * 1.1)).all()


def edited(r, count, words, edits):
    """Texts of one origin with so many words of each changed, apart, and the origin."""
    base = [f"b{r.randrange(10**6)}" for _ in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, count):
        copy = list(base)
        for k in r.sample(range(2, words - 2, 5), edits(i)):
            copy[k] = f"e{r.random()}"
        rows.append((i, " ".join(copy)))
    return rows


def test_texts_of_one_origin_too_far_apart_make_few_pairs(spark):
    # of 147 tokens a change takes four and brings four: links differ in 23 at the most, these in 32, or 24 where changes meet
    rule, rows = ngram_join.Rule(), edited(random.Random(8), 120, 150, lambda i: 1 if i % 2 else 3)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    members = [(0, i, 147, 147, 0 if i % 2 or not i else i, i % 2 == 0 and i > 0) for i, _ in rows]
    members = spark.createDataFrame(members, "g long, doc long, n long, reach long, component long, odd boolean")
    assert ngram_join._by_parts(d, members, rule).count() <= len(rows)


def test_members_that_link_stay_in_their_group(spark):
    r, rule = random.Random(4), ngram_join.Rule()
    rows = scattered(r, 60) + [(i + 500, t) for i, t in edited(r, 60, 90, lambda i: i % 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = ngram_join._whole_sets(d, d.select("doc_id"), rule)
    held = {x.doc_id: set(x.tokens) for x in sets.collect()}
    members = spark.createDataFrame([(int(i >= 500), i, len(t), len(t) - i % 3, i, i % 5 > 0) for i, t in held.items()], "g long, doc long, n long, reach long, component long, odd boolean")
    left = {x.doc for x in ngram_join._able_members(members, sets, rule).collect()}
    link = lambda a, b: 100 * len(held[a] & held[b]) >= 85 * len(held[a] | held[b])
    linked = {x for a in held for b in held if a < b and (a >= 500) == (b >= 500) and (a % 5 or b % 5) and link(a, b) for x in (a, b)}
    assert linked and linked <= left and len(left) < len(held)
