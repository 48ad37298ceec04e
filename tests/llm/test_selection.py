"""Hard negatives, importance resampling and license scans against plain versions of what they do."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buswright.llm import hard_negatives, importance, licenses

SHORT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def short_words(text):
    return SHORT_WORD.findall((text or "").translate(LOWER))


# hard negatives


def plain_negatives(rows, every=5):
    held = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    held = [(n, *r) for n, r in enumerate(held)]
    out = []
    for n, anchor, label, v in held:
        if anchor % every:
            continue
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=False))
        near = sorted(((-score(w), i) for m, i, k, w in held if m != n and k == label))[:5]
        for minus, positive in near:
            p = -minus
            far = sorted((-score(w), i) for _, i, k, w in held if k != label and 50 * p <= 100 * score(w) <= 95 * p)[:3]
            out += [(anchor, positive, rank + 1, i, p, -s) for rank, (s, i) in enumerate(far)]
    return sorted(out)


def mined(spark, rows, **options):
    d = spark.createDataFrame([(i, label, v, "x") for i, label, v in rows], "vec_id long, label int, embedding array<double>, cell string")
    return sorted(tuple(r) for r in hard_negatives.mine(d, F.col("vec_id") % 5 == 0, **options).collect())


def test_negatives_equal_all_products(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, r.choice([0, 0, 0, 1, 2, 7]), [r.gauss(0.05, 0.2) for _ in range(12)]) for i in range(120)]
    rows += [(7, 1, rows[6][2]), (7, 1, rows[6][2]), (5, 2, rows[5][2]), (200, 0, [0.0] * 12), (201, 1, [-3.5] * 12), (-5, 1, [1.0] * 12)]  # repeats, ties, zeros
    rows += [(300, None, [1.0] * 12), (301, 1, None), (302, 1, [None] * 12), (303, 1, [float("nan")] * 12), (304, 1, [float("inf")] * 12), (None, 1, [1.0] * 12), (305, 1, []), (306, 1, [1.0])]
    want = plain_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 100
    # many cells, and every score looked at one by one or all to the last plane
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 20)
    monkeypatch.setattr(hard_negatives, "FEWEST_ANCHORS", 4)
    assert mined(spark, rows) == want


@pytest.mark.parametrize("few", [0.0, 1.0])
@pytest.mark.parametrize("size", [1.0, 3e3, 1e5])
def test_planes_give_exact_scores_in_every_type(few, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "_FEW", few)
    r = np.random.default_rng(1)
    q = np.floor(256 * r.normal(0, size, (60, 8))).astype(np.int64)
    column = lambda x: pa.chunked_array([pa.array(x.tolist(), pa.list_(pa.int32()))])
    label = r.integers(0, 3, 60)
    rows = pa.table({"key": np.arange(60), "vec_id": np.arange(60), "label": label, "v": column(q)})
    anchors = pa.table({"a_key": np.arange(0, 60, 6), "a_vec_id": np.arange(0, 60, 6), "a_label": label[::6], "a_v": column(q[::6])})
    got = sorted((int(a), int(b), int(s)) for a, best, score in hard_negatives._positives_of(rows, anchors, 4) for b, s in zip(best, score, strict=True))
    products = (q.astype(object) @ q.astype(object).T)[::6]
    want = [(a, b, products[a][b]) for a in range(10) for b in sorted((b for b in range(60) if b != 6 * a and label[b] == label[6 * a]), key=lambda b: (-products[a][b], b))[:4]]
    assert got == sorted(want)


def test_a_component_past_32_bits_is_an_error_and_no_rows_give_none(spark):
    assert mined(spark, []) == []
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, 1, [1e9]), (1, 1, [1.0])])


# importance resampling


def plain_draw(docs, target, percent=5, least=20):
    def runs(t):
        w = short_words(t)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    found = [(i, *runs(t)) for i, t in docs]
    s = collections.Counter(b for _, _, f in found for b in f)
    t = collections.Counter(b for text in target for b in runs(text)[1])
    n_s, n_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t)))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    counted = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(counted[: percent * len(counted) // 100]):
        r[5] = rank + 1
    return sorted((r[0] is None, r[0] or 0, *(x or 0 for x in r[1:])) for r in out)


def test_crcs_of_runs_follow_from_those_of_words():
    r = random.Random(2)
    for _ in range(30):
        words = ["".join(r.choice("abcé9") for _ in range(r.choice([1, 2, 5, 9, 63, 64, 65, 300, 5000]))) for _ in range(9)]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, rows = importance.words_of(data, np.array([0, len(data)]))
        crcs = importance.word_crcs(data, starts, ends)
        for n, (run, last) in enumerate(importance.run_crcs(crcs, ends - starts, rows, 4), 1):
            assert run.tolist() == [zlib.crc32(" ".join(words[i - n + 1 : i + 1]).encode()) for i in last.tolist()] and len(run) == 9 - n + 1


def test_long_texts_in_stretches_have_the_same_features(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice(["Ab", "é", "12", " ", "-", "x" * 70, "\n"]) for _ in range(3000))
    whole = sorted(np.concatenate([f for f, _, _ in importance.features(pa.array([text]))]).tolist())
    for size in (10, 100, 5000):
        monkeypatch.setattr(importance, "STRETCH", size)
        parts = list(importance.features(pa.array([text])))
        assert len(parts) > 1 and sorted(np.concatenate([f for f, _, _ in parts]).tolist()) == whole
        assert sum(n for _, _, n in parts) == len(short_words(text))


def test_drawn_documents_equal_a_plain_draw(spark):
    r = random.Random(5)
    prose = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    docs = [(i, prose(r.randrange(0, 60), 30 if i % 3 else 200)) for i in range(300)]
    docs += [(7, docs[7][1]), (7, "another text " * 9), (None, prose(30, 20)), (None, None), (900, None), (901, ""), (902, "ÀB c\x00d " * 40), (903, " - "), (904, "z" * 200_000)]
    target = [prose(40, 25) for _ in range(20)] + [None, ""]
    d = spark.createDataFrame([(t, i, "s", 0) for i, t in docs], "text string, doc_id long, weight string, rank int").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in importance.drawn(d, t).collect()]
    assert sorted((x[0] is None, x[0] or 0, *(y or 0 for y in x[1:])) for x in got) == plain_draw(docs, target)
    ranks = sorted(x[5] for x in got if x[5])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    kept = importance.resampled(d, t)
    assert kept.columns == d.columns and collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(x[0] for x in got if x[5])


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    assert importance.drawn(none, some).collect() == []
    assert sorted((r.doc_id, r.n_features, r.rank) for r in importance.drawn(some, none, least_words=1, percent=50).collect()) in ([(1, 6, 1), (2, 1, None)], [(1, 6, None), (2, 1, 1)])


# license scans


def plain_base(text):
    w = short_words(text)
    at = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), sorted(at)


def test_phrases_stand_where_their_words_do(spark):
    r = random.Random(6)
    some = "cc by all rights reserved general public license CC By-NC 4.0 x Rights é".split()
    texts = [" ".join(r.choice(some) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", "cc", "cc by", "CC-BY", "ALL RIGHTS RESERVED." * 50, "Kcc by", "cc Kby cc\x00by", "cc by " * 4000, "general public all rights license"]
    d = spark.createDataFrame([(None if i % 9 == 8 else i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key int").repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, tuple((s.first_word, s.label) for s in r.spans if s.exact)) for r in licenses.spans(d).collect())
    want = collections.Counter((None if i % 9 == 8 else i // 2, plain_base(t)[0], tuple(plain_base(t)[1])) for i, t in enumerate(texts))
    assert got == want
    assert licenses.spans(d.limit(0)).collect() == []


def test_templates_with_lost_and_added_words_are_found(spark):
    notice = dict(licenses.TEMPLATES)["mit"].split()
    r = random.Random(7)
    noise = lambda n: " ".join(f"n{r.randrange(99)}" for _ in range(n))
    whole = " ".join(notice)
    changed = " ".join([*notice[:8], "quite", "freely", *notice[8:14], *notice[15:]])
    texts = {"whole": f"{noise(30)} {whole} {noise(9)}", "changed": f"{noise(30)} {changed.upper()} {noise(9)}", "half": f"{noise(5)} {' '.join(notice[:9])} {noise(40)} {' '.join(notice[9:])}", "twice": f"{whole} {noise(50)} {whole}", "none": noise(80)}
    d = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in licenses.spans(d).collect()}
    named = {k: [(s.label, s.first_word) for s in v.spans] for k, v in got.items()}
    assert named == {"whole": [("mit", 30)], "changed": [("mit", 30)], "half": [], "twice": [("mit", 0), ("mit", len(notice) + 50)], "none": []}
    assert got["whole"].score == 1 and 0.7 <= got["changed"].score < 1 and 0 < got["half"].score < 0.7 and got["none"].score == 0
    assert got["whole"].spans[0].last_word == 29 + len(notice)


@pytest.mark.parametrize("name", ["op11_bit_sliced_negatives", "op12_crc_resampling", "op13_diagonal_licenses"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from buswright.llm import registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    df = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLE_SQL:
        docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
        got = sorted((False, r.doc_id, r.n_features, r.weight, r.score, r.rank or 0) for r in df.collect())
        want = plain_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
        assert got == [(*x[:2], *x[3:]) for x in want]
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(registry.ORACLE_SQL[name])
    assert df.columns == want.columns and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))
