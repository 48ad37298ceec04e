"""The corpus operators on small fixtures, against plain versions of what they do."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buswright.llm import components, exact_dedup, language, minhash, mixing, near_copies, ngram_join, piece_bpe, quality, registry, token_store, toxicity, warc

tokenizers_here = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __n string, tokens int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, partitions=3):
    """doc_id, text and source; the other columns have names that operators might use themselves."""
    full = [(i, t, "en", s, len(t) if t else None, "x", 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(r, words, vocabulary=300):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    base = prose(r, 120, 100_000).split()
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, "one", "b"), (5, "One", "b"), (6, "one two three", "c"), (7, "a" * 5000, "c"), (8, "é 😀 ß x", "c"), (9, "same same " * 400, "a")]
    for i in range(40):
        words = list(base)
        for _ in range(i % 7):
            words[r.randrange(len(words))] = f"edit{r.random()}"
        rows.append((100 - i, " ".join(words), "a" if i % 2 else None))
    rows += [(200 + i, prose(r, 30 + i), f"s{i % 3}") for i in range(40)]
    rows += [(300 + i, rows[20][1] + " " * i, "a") for i in range(5)]
    rows += [(400, prose(r, 20_000), "long")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return documents(spark, corpus).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql_on_odd_rows(spark, corpus, name, tmp_path):
    rows = [(i, t, "en", s, 0) for i, t, s in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pages = [(i, f"http://x/{i} y", t) for i, t, _ in corpus]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    show = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(df.select(*columns).collect()) == show(want.project(", ".join(columns)).fetchall())


def test_mixing_meets_targets_and_never_repeats_more_than_three_times(spark, docs, empty):
    rows = mixing.mix_plan(docs).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-3
    order = mixing.training_order(docs)
    assert order.columns == [*docs.columns, "mix_position"]
    at = [(r.mix_position, r.doc_id) for r in order.collect()]
    assert at == sorted(at) and max(collections.Counter(i for _, i in at).values()) <= 3
    assert mixing.mix_plan(empty).count() == 0


def test_rows_without_doc_id_and_with_repeated_ones_are_mixed_as_planned(spark):
    rows = [(None, "one two", "a"), (None, "three four five", "b"), (None, "one two", "a"), (7, "six seven", "a"), (7, "eight nine ten x y", "b"), (7, "eight nine ten x z", "c")]
    rows += [(8, "same row here", "a")] * 3 + [(9, "just one", None)]
    d = documents(spark, rows)
    want = collections.Counter()
    for r in mixing.mix_plan(d).where("taken > 0").collect():
        want[r.doc_id, r.source, r["size"]] += -(-r.taken // r["size"])
    got = [(r.doc_id, r.source, r.text, r.mix_position) for r in mixing.training_order(d).collect()]
    assert collections.Counter((i, s, len(t.split())) for i, s, t, _ in got) == want
    assert {(i, s, t) for i, s, t, _ in got} <= {(i, s, t) for i, t, s in rows} and {None, 7, 8} <= {i for i, *_ in got}
    again = mixing.training_order(documents(spark, rows[::-1], 5)).collect()
    assert [(r.doc_id, r.source, r.text, r.mix_position) for r in again] == got


def test_slopes_move_words_in_time_alone(spark):
    d = documents(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(400)])
    at = mixing.mix_plan(d, weights=(1,), slopes=(-0.9, 0.9)).where("taken > 0").groupBy("source").agg(F.avg("position").alias("p"), F.sum("taken").alias("n")).collect()
    by = {r.source: r for r in at}
    assert by["a"].p < 0.42 < 0.58 < by["b"].p and by["a"].n == by["b"].n


def test_exact_copies_with_repeated_rows_and_null_ids(spark, docs, empty, corpus):
    d = documents(spark, [(5, "x y", "a"), (5, "x y", "a"), (6, "xy", "a"), (None, "q", "a"), (None, "q ", "a"), (7, "other", "a")])
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(d, capacity=1, depth=3).collect())
    assert got == {(5, 5, 3, True): 1, (5, 5, 3, False): 1, (6, 5, 3, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1, (7, 7, 1, True): 1}
    left = exact_dedup.deduplicated(d)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == ["5", "7", "None"]
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_the_directory_splits_full_buckets():
    cells = exact_dedup.directory({0: 5, 1: 5, 7: 100}, 3, 6)
    assert cells == [(0, 0, 3), (1, 1, 3), (2, 3, 2), (4, 5, 2), (6, 6, 3), (7, 7, 3)]


def shingle_sets(rows, width):
    out = {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset()
    return out


def linked_by_force(rows, percent=85, width=4):
    sets = shingle_sets(rows, width)
    name = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * len(sets[a] | sets[b]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = {i: low if n == high else n for i, n in name.items()}
    return {i: (len(sets[i]), name[i]) for i in sets}


@pytest.mark.parametrize("frequent", [256, 2])
def test_the_jaccard_join_finds_what_all_pairs_give(spark, docs, corpus, frequent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs, ngram_join.Rule(frequent=frequent)).collect()}
    assert got == linked_by_force(corpus)


def test_large_groups_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_SMALL_GROUP", 1)
    monkeypatch.setattr(ngram_join, "_BLOCK", 5)
    r = random.Random(3)
    base, rows = prose(r, 100, 10_000).split(), []
    for i in range(45):
        words = list(base)
        for _ in range(r.randrange(9)):
            words[r.randrange(100)] = f"e{r.random()}"
        rows.append((90 - i, " ".join(words), "a"))
    rows += [(500 + i, " ".join(base[:60] + prose(r, 40, 10_000).split()), "a") for i in range(10)]
    # one task meets the larger doc_id of equal texts first
    rows += [(95, rows[3][1], "a")]
    d = documents(spark, sorted(rows, reverse=True), 1)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.linked(d, ngram_join.Rule(frequent=4)).collect()}
    assert got == linked_by_force(rows)


def test_the_jaccard_join_on_empty_tables_and_null_ids(spark, empty):
    assert ngram_join.linked(empty).count() == 0
    d = documents(spark, [(None, "a b c d e", "a"), (2, "a b c d e", "a"), (3, None, "a")])
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.linked(d).collect()) == [("2", 2, 2), ("3", 0, 3), ("None", 2, None)]


@pytest.mark.parametrize("words", [4, 12, 400])
def test_a_row_without_doc_id_hides_no_document_of_the_same_text(spark, words):
    text = prose(random.Random(words), words, 100_000)
    rows = [(None, text), (5, text), (3, text + " "), (9, text if words < 40 else text + " edit")]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("3", 3), ("5", 3), ("9", 3), ("None", None)]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40))


def test_pieces_are_those_of_the_library(spark, docs, corpus, empty):
    import sentencepiece

    r = random.Random(5)
    odd = ["".join(r.choice("abeth in er  \n▁é日😀<s>_.,0\t\x00") for _ in range(r.randrange(50))) for _ in range(500)]
    odd += [" " * 700, "a" * 3000, "ab" * 900, "".join(r.choice("abcdefgh") for _ in range(5000)), "▁▁", " x"]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers_here.path("piece_bpe_32k.model"))
    d = documents(spark, corpus + [(1000 + i, t, "a") for i, t in enumerate(odd)])
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    for row in piece_bpe.encode_decode(d, piece_bpe.model_content()).collect():
        ids = sp.encode(texts[row.doc_id])
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == sp.decode(ids), repr(texts[row.doc_id][:50])
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_decode(empty, piece_bpe.model_content()).count() == 0


def test_the_token_store_gives_back_what_it_was_given(spark, corpus, empty, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizers_here.path("word_bpe_49k.json"))
    r = random.Random(6)
    odd = ["".join(r.choice(list("abE'st.,!?;: \n\t§<>0é÷ßÉ日…") + ["<|endoftext|>", "́", "<|STARTOFTEXT|>"]) for _ in range(r.randrange(30))) for _ in range(400)]
    d = documents(spark, corpus + [(1000 + i, t, "a") for i, t in enumerate(odd)])
    path = str(tmp_path / "store")
    root = token_store.write_store(d, path, token_store.tokenizer_content())
    token_store.verify_store(spark, path, root)
    rows = sorted((x.doc_id, x.text or "") for x in d.collect())
    digests, whole = ({x.doc_id: x for x in f(spark, path).collect()} for f in (token_store.document_digests, token_store.read_documents))
    start = 0
    for i, t in rows:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        assert whole[i].ids == ids and whole[i].start == start, repr(t[:40])
        assert tuple(digests[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    with pytest.raises(ValueError, match="manifest"):
        token_store.verify_store(spark, path, "00" * 32)
    none = str(tmp_path / "none")
    token_store.verify_store(spark, none, token_store.write_store(empty, none, token_store.tokenizer_content()))
    assert token_store.document_digests(spark, none).count() == 0


def test_crcs_of_parts_join_to_that_of_the_whole():
    tables, a, b = token_store._power_tables(), b"first", b"the second" * 50
    got = token_store.crc_joined(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]), tables)
    assert got[0] == zlib.crc32(a + b)


def test_chunks_stay_the_same_when_text_is_put_before_them():
    r = np.random.default_rng(1)
    long = r.integers(0, 49_000, 8000).astype(np.int32)
    moved = np.r_[r.integers(0, 49_000, 77).astype(np.int32), long]
    ends = [token_store.cut(x, np.array([0, len(x)]))[0] for x in (long, moved)]
    assert len(set(ends[0]) & {e - 77 for e in ends[1]}) >= len(ends[0]) - 2


def test_archives_are_standard_and_read_in_chunks(spark, tmp_path, empty):
    r = random.Random(2)
    big = "".join(chr(r.randrange(32, 1000)) for _ in range(300_000))
    rows = [(1, "http://a/ b", big), (2, None, "short"), (3, "http://c", "short"), (4, "http://d", None), (5, "http://e", ""), (9, "http://f", big), (6, "http://g", "x" * 100), (7, "http://h", "x" * 100), (None, "http://i", "y"), (8, "http://j", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(warc.record_plan(pages), str(tmp_path / "w"))
    chunks = warc.read_archives(spark, manifest, chunk=4096).persist()
    bodies = collections.defaultdict(bytes)
    for c in chunks.orderBy("record_id", "chunk_no").collect():
        assert len(c.body) <= 4096
        bodies[c.page_id] += bytes(c.body)
        assert c.digest == hashlib.sha256(bodies[c.page_id]).hexdigest() and c.bytes_so_far == len(bodies[c.page_id])
    assert bodies[1].decode() == big and bodies[8].decode() == rows[-1][2] and bodies[9] == b""
    got = {x.page_id: x for x in warc.records(chunks).collect()}
    assert {i: (x.record_type, x.refers_to) for i, x in got.items() if x.refers_to is not None} == {9: ("revisit", 1), 7: ("revisit", 6)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    none = warc.write_archives(warc.record_plan(pages.limit(0)), str(tmp_path / "n"))
    assert warc.records(warc.read_archives(spark, none)).count() == 0


def test_fingerprints_of_texts_and_their_edits(spark, docs, corpus, empty, monkeypatch):
    monkeypatch.setattr(minhash._parts, "__defaults__", (20,))
    got = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    rows = sorted((i, t or "") for i, t, _ in corpus)
    one = lambda t: minhash.fingerprint_text(minhash.signatures(pa.array([t]))[0])
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (one(t), one(edited))
    assert minhash.fingerprints(empty).count() == 0
    assert minhash.fingerprints(docs.where("doc_id = 4")).first().near_next == 1.0


def test_fingerprints_estimate_jaccard():
    r = random.Random(1)
    base = prose(r, 400, 10**6).split()
    for edits in (0, 8, 25):
        words = list(base)
        for k in range(edits):
            words[k * 16] = "other"
        sets = [x for x in shingle_sets([(0, " ".join(base)), (1, " ".join(words))], 5).values()]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        s = minhash.signatures(pa.array([" ".join(base), " ".join(words)]))
        assert abs((s[0] == s[1]).mean() - true) < 0.2


def test_near_duplicates_are_those_of_all_pairs(spark, docs, corpus, empty):
    got = {r.doc_id: r.class_id for r in near_copies.near_duplicates(docs).collect()}
    assert got == {i: name for i, (_, name) in linked_by_force(corpus, 80, 5).items()}
    assert near_copies.near_duplicates(empty).count() == 0


def labelled(spark, kind):
    r, rows, labels = random.Random(8), [], []
    bad = ["scum", "trash", "moron"]
    for i in range(900):
        words = prose(r, r.randrange(20, 200)).split()
        hit = i % 3 == 0
        if hit and kind == "toxic":
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad).capitalize() + ",")
        if hit and kind == "quality":
            words = [w for w in words[:12] for _ in range(9)]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(hit), int(hit)))
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "é scum, Trash! ß", "a")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_and_their_spans(spark, empty):
    d, labels = labelled(spark, "toxic")
    tagger = toxicity.train(d, labels)
    out = toxicity.score(d, tagger)
    assert out.columns == [*d.columns, "toxic_score", "toxic_spans"]
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].toxic_score >= 0.5) == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert got[2000].toxic_score == got[2001].toxic_score < 0.5 and got[2000].toxic_spans == []
    assert [(s.start, s.end) for s in got[2002].toxic_spans] == [(2, 13)]
    assert toxicity.score(empty, tagger).count() == 0
    assert toxicity.score(d, toxicity.train(d, labels.limit(0))).where("toxic_score >= 0.5").count() == 0


def test_marginals_are_those_of_a_plain_recursion():
    r = np.random.default_rng(2)
    bounds = np.array([0, 1, 1, 700, 703, 1500])
    s, a = r.normal(0, 2, 1500), r.normal(0, 1, (2, 2))
    p, joint = toxicity.marginals(s, bounds, a)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        e = np.stack([np.ones(high - low), np.exp(s[low:high])], axis=1)
        w, f, b = np.exp(a), np.zeros((high - low, 2)), np.ones((high - low, 2))
        for t in range(high - low):
            f[t] = e[t] * (f[t - 1] @ w if t else 1)
            f[t] /= f[t].sum()
        for t in range(high - low - 2, -1, -1):
            b[t] = w @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b
        assert np.allclose(p[low:high], (want / want.sum(axis=1, keepdims=True))[:, 1] if high > low else [])
        assert np.allclose(joint[low + 1 : high, [1, 3]].sum(axis=1), p[low + 1 : high])


def test_quality_is_learnt_and_calibrated(spark, empty):
    d, labels = labelled(spark, "quality")
    vectors = quality.train_vectors(d)
    network = quality.train(d, labels, vectors)
    got = {r.doc_id: r.quality_score for r in quality.score(d, network, vectors).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert got[2000] == got[2001] and 0 <= got[2000] <= 1
    assert quality.score(empty, network, vectors).count() == 0
    assert quality.train(d, labels.limit(0), vectors).score(np.zeros((1, 2 * quality.WIDTH + 4)))[0] == 0.5


def test_languages_are_told_apart(spark, empty):
    words = {"xx": "bal dor kin sol", "yy": "ünt äsch öder ßen", "zz": "que ción ños", "ww": "wha tch thi sse", "vv": "kaa lii moo nuu", "uu": "rzy szcz prz", "tt": "ngo mba kwe"}
    r, rows = random.Random(9), []
    for i in range(1400):
        lang = sorted(words)[i % 7]
        rows.append((i, " ".join(r.choice(words[lang].split()) + r.choice(words[lang].split()) for _ in range(30)), lang, "s", 0, "x", 1))
    rows += [(5000, None, "xx", "s", 0, "x", 1), (5001, "123 !", "yy", "s", 0, "x", 1), (5002, "", None, "s", 0, "x", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = language.train(d, sample=60)
    out = language.identify(d.drop("lang"), model)
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(1400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == sorted(words)[i % 7] for i in held) >= 0.99 * len(held)
    assert {(got[i].lang_pred, got[i].lang_score) for i in (5000, 5001, 5002)} == {("und", 0.0)}
    assert all(0 <= x.lang_score <= 1 for x in got.values())
    assert language.identify(empty, language.train(empty)).count() == 0


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 20):
        c = language.codewords(n)
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, c.shape[1] // 5)


def test_the_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    rows = [(i, prose(r, 80, 5000) + (" scum trash" * 3 if i % 4 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(240)]
    rows += [(1000 + i, rows[1][1] + " " * i, "en", "s0", 0) for i in range(6)] + [(2000, rows[2][1] + " more", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == columns
        kept[name] = {x.doc_id for x in docs.collect()}
    assert kept["toxicity"] == {x[0] for x in rows if x[0] % 4 or x[0] >= 1000}
    assert kept["exact dedup"] == {x for x in kept["toxicity"] if x < 1000 and x != 1} | {1005, 2000}
    assert kept["n-gram Jaccard join"] == kept["exact dedup"] - {2000}
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in last.collect()} == kept["mixing sources"]
