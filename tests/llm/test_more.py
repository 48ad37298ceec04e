"""The corpus operators against plain versions of what they do, on odd rows, and through their queries."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buswright.llm import common, exact_dedup, language, minhash, mixing, near_copies, ngram_join, piece_bpe, quality, registry, token_store, toxicity, warc, wordcache

tokenizers_here = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


# words whose hashes are equal under any polynomial of an odd base modulo 2**64
ONE = thue_morse(1024)
TWO = ONE.translate(str.maketrans("ab", "ba"))


def prose(r, words, vocabulary=300):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    data = np.frombuffer(f"{ONE} {TWO} x {ONE} yy x".encode(), np.uint8)
    starts, ends, _ = common.word_bounds(data, np.array([0, len(data)]))
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == 4
    # and even where all hashes are equal
    monkeypatch.setattr(wordcache, "block_hashes", lambda blocks, first, counts, lengths: np.zeros(len(counts), np.uint64))
    which, words = wordcache.distinct_words(data, starts, ends)
    assert [words[i] for i in which.tolist()] == data.tobytes().split(b" ") and len(words) == 4


def test_a_cache_that_is_full_or_meets_long_words_still_encodes():
    encode = lambda words: (np.concatenate([np.frombuffer(w, np.uint8).astype(np.int32) for w in words]), np.array([len(w) for w in words], np.int64))
    cache, r = wordcache.WordCache(encode, limit=20, longest=3), random.Random(1)
    for _ in range(30):
        words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(15)]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = common.word_bounds(data, np.array([0, len(data)]))
        ids, counts = cache(data, starts, ends)
        assert bytes(ids.astype(np.uint8)).decode() == "".join(words) and counts.tolist() == [len(w) for w in words]
        assert all(len(w) <= 3 for w in cache.known)


def test_words_that_hash_alike_elsewhere_give_the_libraries_ids_and_no_link(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = {1: f"{ONE} {TWO}", 2: f"{TWO} {ONE}", 3: f"{ONE} {ONE}", 4: f"p q r {ONE}", 5: f"p q r {TWO}"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers_here.path("piece_bpe_32k.model"))
    for row in piece_bpe.encode_decode(d, piece_bpe.model_content()).collect():
        assert row.ids == sp.encode(texts[row.doc_id]) and row.decoded == texts[row.doc_id]
    tk = Tokenizer.from_file(tokenizers_here.path("word_bpe_49k.json"))
    path = str(tmp_path / "store")
    token_store.write_store(d, path, token_store.tokenizer_content())
    for row in token_store.document_digests(spark, path).collect():
        assert row.ids_crc32 == zlib.crc32(np.array([*tk.encode(texts[row.doc_id], add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert {r.doc_id: r.component_id for r in ngram_join.linked(d).collect()} == {i: i for i in texts}


def test_a_store_without_a_chunk_or_with_a_wrong_size_is_an_error(spark, tmp_path):
    r = random.Random(3)
    d = spark.createDataFrame([(i, prose(r, 50 * i)) for i in range(6)], "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(d, path, token_store.tokenizer_content())
    chunks, recipes = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/recipes")
    lost, wrong = str(tmp_path / "lost"), str(tmp_path / "wrong")
    for to in (lost, wrong):
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{to}/manifest")
    recipes.write.parquet(f"{lost}/recipes")
    chunks.where(F.col("chunk_id") != F.lit(chunks.first().chunk_id)).write.parquet(f"{lost}/chunks")
    chunks.write.parquet(f"{wrong}/chunks")
    recipes.withColumn("n_tokens", F.col("n_tokens") + (F.col("doc_id") == 4).cast("int")).write.parquet(f"{wrong}/recipes")
    for read in (token_store.document_digests, token_store.read_documents):
        assert read(spark, path).count() == 6
        with pytest.raises(Exception, match="is missing from the store"):
            read(spark, lost).collect()
        with pytest.raises(Exception, match="not the .* of its recipe"):
            read(spark, wrong).collect()


def test_other_tokenizers_get_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizers_here.path("byte_bpe_50k.json")
    encoder, plain = token_store._Encoder(token_store.tokenizer_content(path)), Tokenizer.from_file(path)
    texts = ["Two words", None, "", "Ünï  <|x|> 12"]
    ids, bounds = encoder(pa.array(texts))
    assert not encoder.by_words
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_an_archive_that_ends_early_is_an_error(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://p/{i}", f"page {i} " * 40) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.record_plan(pages), str(tmp_path / "w"))
    assert warc.records(warc.read_archives(spark, manifest), manifest).count() == 5
    path = manifest.first().path
    whole = gzip.open(path).read()
    with open(path, "wb") as f:
        f.write(gzip.compress(whole[: whole.rindex(b"WARC/1.1")]))
    with pytest.raises(ValueError, match="4 records, not the 5"):
        warc.records(warc.read_archives(spark, manifest), manifest)


def plain_minhash(text):
    a, b = minhash.permutations()
    prime = (1 << 31) - 1
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in WORD.findall(text)]
    if not words:
        return ["ffffffff"] * 64
    one = lambda w: int(common.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    mix = lambda x: int(common.mixed(np.array([x], np.uint64))[0])
    keys = set()
    for k in range(max(len(words) - 4, 1)):
        key = 0
        for w in words[k : k + 5]:
            key = mix((key * 0x9E3779B97F4A7C15 + one(w)) % (1 << 64))
        keys.add(key)
    return [f"{min((int(i) * (x % prime) + int(j)) % prime or prime for x in keys):08x}" for i, j in zip(a, b, strict=True)]


def test_fingerprints_and_likeness_are_those_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(minhash._parts, "__defaults__", (4,))
    monkeypatch.setattr(minhash, "_STRETCH", 7)
    r = random.Random(5)
    base = prose(r, 40)
    texts = {3: base, 5: base + " tail", 8: None, 9: "", 12: "É two Words", 20: prose(r, 9), 21: base.upper(), 30: base[: len(base) // 2]}
    got = {x.doc_id: x for x in minhash.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts)
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        own, nxt = texts[i] or "", texts[following] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + nxt[:cut]
        sides = [plain_minhash(t) for t in (own, edited, nxt)]
        x = got[i]
        assert (x.fingerprint, x.edited_fingerprint) == ("".join(sides[0]), "".join(sides[1]))
        assert x.near_edited == sum(p == q for p, q in zip(sides[0], sides[1], strict=True)) / 64
        assert x.near_next == sum(p == q for p, q in zip(sides[0], sides[2], strict=True)) / 64


def test_permutations_are_a_universal_family():
    # agreement of the smallest values estimates likeness without bias, also of shingles that differ in high bits alone
    x = (np.arange(400, dtype=np.uint64) << np.uint64(20)) + np.uint64(5)
    agree = []
    for a, b in zip(*minhash.permutations(), strict=True):
        y = minhash._reduced(a * minhash._reduced(x) + b)
        agree.append(y[:300].min() == y[100:].min())
    assert abs(np.mean(agree) - 0.5) < 0.2


def test_near_copies_of_all_degrees_are_found(spark):
    r, rows = random.Random(6), []
    for k in range(150):
        words = prose(r, 200, 10**6).split()
        rows.append((2 * k, " ".join(words)))
        for at in r.sample(range(200), k % 7):
            words[at] = f"edit{r.random()}"
        rows.append((2 * k + 1, " ".join(words)))
    got = {x.doc_id: x.class_id for x in near_copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    linked = [k for k in range(150) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    found = [k for k in range(150) if got[2 * k + 1] == 2 * k]
    assert set(found) <= set(linked) and len(found) >= 0.99 * len(linked) and len(linked) > 80


def test_profiles_and_decoding_are_those_of_plain_loops(monkeypatch):
    monkeypatch.setattr(language, "_STRETCH", 5)
    texts = ["Abc abd", "", "é", "a" * 23]
    got = language.profiles(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        data, counts = text.lower().encode() if text.isascii() else text.encode(), collections.Counter()
        for n in (1, 2, 3, 4):
            for i in range(len(data) - n + 1):
                key = 0
                for k, byte in enumerate(data[i : i + n]):
                    key = key * 257 + byte + 1 if k else byte + 1
                counts[(key % (1 << 32) * 0x9E3779B1 % (1 << 32)) >> 20] += 1
        norm = math.sqrt(sum(counts.values())) or 1
        assert np.allclose(row[sorted(counts)], [math.sqrt(counts[b]) / norm for b in sorted(counts)], atol=1e-6) and np.count_nonzero(row) == len(counts)
    r = np.random.default_rng(1)
    model = language.Identifier(["aa", "bb", "cc"], language.codewords(3), r.normal(size=(language.BUCKETS, 3)).astype(np.float32), np.zeros(3, np.float32), r.random((3, 3)))
    best, top, _ = model.predict(got)
    for i, x in enumerate(got):
        margins = [float(x @ model.weights[:, k]) for k in range(3)]
        loss = [sum(math.log1p(math.exp(-margins[k] * model.codes[c][k])) * model.trust[c][k] for k in range(3)) for c in range(3)]
        shares = [math.exp(-v) / sum(math.exp(-w) for w in loss) for v in loss]
        assert best[i] == int(np.argmin(loss)) and abs(top[i] - max(shares)) < 1e-5


def test_word_vectors_and_pools_are_those_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(quality, "_STRETCH", 3)
    texts = ["a b c a b", "b b", "", None, "c d e f g h a"]
    index = quality.index_vectors()
    buckets = lambda t: quality.word_buckets(pa.array([t]))[0].tolist()
    want = np.zeros((quality.WORDS, quality.WIDTH))
    for t in texts:
        words = buckets(t)
        for i, w in enumerate(words):
            for j in range(max(i - quality.REACH, 0), min(i + quality.REACH + 1, len(words))):
                if j != i:
                    want[w] += index[words[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.train_vectors(spark.createDataFrame([(t,) for t in texts], "text string")), want, atol=1e-6)
    got = quality.pooled(pa.array(texts), want.astype(np.float32))
    for t, row in zip(texts, got, strict=True):
        words = buckets(t)
        if not words:
            assert not row.any()
            continue
        v = want[words]
        alike = sum(float(x @ y) for x, y in zip(v, v[1:], strict=False)) / len(words)
        same = sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words)
        plain = [*v.mean(axis=0), *v.std(axis=0), alike, same, len(set(words)) / len(words), math.log1p(len(words)) / 8]
        assert np.allclose(row, plain, atol=1e-3)


def test_long_chains_are_tagged_in_stretches(monkeypatch):
    r = np.random.default_rng(4)
    bounds, scores, a = np.array([0, 0, 900, 2000, 2001]), r.normal(0, 2, 2001), r.normal(0, 1, (2, 2))
    whole = toxicity.probabilities(scores, bounds, a)
    monkeypatch.setattr(toxicity, "_WORDS", 130)
    assert np.allclose(toxicity.probabilities(scores, bounds, a), whole) and np.allclose(toxicity.marginals(scores, bounds, a)[0], whole)


def test_what_toxicity_learns_from_is_bounded_by_words(spark):
    rows = [(i, i % 2, i, 10 * (i + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, toxic int, text_hash long, size long")
    taken = toxicity.chosen_sample(df, {1: 12, 0: 30}, {1: 900, 0: 700})
    for label, most, words in ((1, 12, 900), (0, 30, 700)):
        mine = [10 * (i + 1) for i, t, _ in taken if t == label]
        assert 0 < len(mine) <= most and sum(mine) <= words
    assert taken == toxicity.chosen_sample(df.repartition(5), {1: 12, 0: 30}, {1: 900, 0: 700})


CLASHING = "doc_id long, text string, source string, TOXIC_score string, toxic_spans string, Lang_Pred int, lang_score string, lettered string, quality_score string, row int, doc string, slope int, shares int, __row int, norm string, bucket int, mix_position string, n int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "s", "a", "b", i, "c", "d", "e", 7 * i, "f", 3, 4, 5, "g", 6, "h", 8) for i, t in texts], CLASHING)


def test_columns_of_any_name_keep_their_values(spark):
    texts = [(1, "one two three"), (2, "one  two three"), (3, None), (4, "four five six seven")]
    d = clashing(spark, texts)
    kept = exact_dedup.deduplicated(d)
    assert kept.columns == d.columns and {tuple(r) for r in kept.collect()} == {tuple(r) for r in d.collect() if r.doc_id != 1}
    mixed = mixing.training_order(d)
    own = [c for c in d.columns if c != "mix_position"]
    assert mixed.columns == [*own, "mix_position"]
    assert {tuple(r) for r in mixed.select(*own).collect()} == {tuple(r) for r in d.where("text IS NOT NULL").select(*own).collect()}
    tagger = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    for out, added in (
        (toxicity.score(d, tagger), ["toxic_score", "toxic_spans"]),
        (language.identify(d, None), ["lang_pred", "lang_score", "lang_ambiguous"]),
        (quality.score(d, quality.fit(np.zeros((0, 68)), np.zeros(0, int)), np.zeros((quality.WORDS, quality.WIDTH), np.float32)), ["quality_score"]),
    ):
        stay = [c for c in d.columns if c.lower() not in added]
        assert out.columns == [*stay, *added] and out.orderBy("doc_id").select(*stay).collect() == d.orderBy("doc_id").select(*stay).collect()


def test_hot_keys_are_looked_up_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rows = [(k, i) for i, k in enumerate("aaaaaabbccccd")]
    df = spark.createDataFrame(rows, "k string, i int")
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = sorted((r.k, r.i, r.n) for r in common.looked_up(df, sizes, ["k"], "n", 13).collect())
    assert got == sorted((k, i, "aaaaaabbccccd".count(k)) for k, i in rows)


def test_lists_of_a_shared_passage_end_without_pairs(spark):
    r = random.Random(12)
    passage = prose(r, 300, 10**6).split()
    # a tenth of each text is its own: all share a passage, none links
    rows = [(i, " ".join(passage + prose(r, 40, 10**6).split())) for i in range(120)]
    # and two that differ in three words of theirs
    rows += [(500, " ".join(passage[:200])), (501, " ".join(passage[:200] + ["more"]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.linked(d, ngram_join.Rule(frequent=8)).collect()}
    assert got == {i: 500 if i == 501 else i for i, _ in rows}


def test_near_copies_with_repeated_ids_are_documents_of_their_own(spark):
    import corpus_pipeline

    r = random.Random(2)
    a, b = prose(r, 100, 10**6), prose(r, 100, 10**6)
    rows = [(7, a, "x"), (7, b, "y"), (3, a + " more", "x"), (9, b + " more", "y"), (None, a, "z"), (4, None, "n"), (5, "", "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = corpus_pipeline.drop_near_copies(spark, d, "")
    assert left.columns == d.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, d.where("NOT (doc_id = 7 AND source = 'x') AND coalesce(doc_id, 0) != 9").collect()))


COLUMNS = {
    "op1_language_codes": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_quality_network": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_minhash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op5_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_warc_chunks": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_piece_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_toxic_spans": "doc_id bigint, held_out boolean, score double, predicted int, toxic_spans array<struct<start:int,end:int>>",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, r = tmp_path_factory.mktemp("tables"), random.Random(8)
    rows = [(i, prose(r, r.randrange(1, 60)) + (" scum trash" if i % 4 == 0 else ""), ["en", "fr", None][i % 3], f"s{i % 2}", 0) for i in range(80)]
    rows += [(200, None, None, None, 0), (201, "", "en", None, 0), (202, "¡12!", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(i, f"http://u/{i}", t) for i, t, *_ in rows], "page_id long, url string, html string").write.parquet(str(root / "pages.parquet"))
    return str(root), rows


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_have_a_row_a_document_and_their_columns(spark, tables, name):
    root, rows = tables
    df = registry.QUERIES[name](spark, root)
    assert set(COLUMNS[name].split(", ")) <= {f"{n} {t}" for n, t in df.dtypes}
    got = df.collect()
    key = "page_id" if name.startswith("op6") else "doc_id"
    assert sorted(x[key] for x in got) == sorted(x[0] for x in rows)
    if "held_out" in df.columns:
        parts, rest = (5, 0) if name.startswith("op8") else (3, 1)
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % parts == rest) and 0 <= x.score <= 1 for x in got)
    if "predicted" in df.columns:
        assert all(x.predicted == int(x.score >= 0.5) for x in got)
    if name.startswith("op1_"):
        assert {x.doc_id for x in got if x.lang_pred == "und"} == {200, 201, 202} and {x.lang_pred for x in got} <= {"en", "fr", "und"}
    if name.startswith("op8"):
        texts = {x[0]: x[1] or "" for x in rows}
        assert {texts[x.doc_id][s.start : s.end] for x in got for s in x.toxic_spans} <= {"scum trash", "scum", "trash"}
