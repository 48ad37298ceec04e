"""Rows that repeat a doc_id, or have none, where stores are parted and models learn."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from buswright.llm import language, quality, token_store


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))


def test_a_store_parts_rows_without_or_with_one_doc_id_and_holds_bodies_once(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    long_ = words(r, 1500)
    rows = [(None, "")] * 60 + [(None, words(r, 30)) for _ in range(40)] + [(7, words(r, 20)) for _ in range(40)] + [(8, long_)] * 3 + [(9, None)]
    monkeypatch.setattr(token_store, "PART_CHUNKS", 20)
    path = str(tmp_path / "store")
    root = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, token_store.tokenizer_content())
    assert sorted(n for n in os.listdir(path) if not n.startswith(".")) == ["chunks", "manifest", "recipes"]
    token_store.verify_store(spark, path, root)
    recipes = spark.read.parquet(f"{path}/recipes")
    for doc_id in (None, 7):
        assert recipes.where(F.col("doc_id").eqNullSafe(doc_id)).select("part").distinct().count() > 1
    # the order goes on over parts, and the starts leave no gap
    order = lambda x: (x.doc_id is not None, x.doc_id or 0, x.n_tokens, [bytes(c) for c in x.chunk_ids])
    held = sorted(recipes.collect(), key=lambda x: (order(x), x.part))
    assert [x.part for x in held] == sorted(x.part for x in held)
    read = sorted(token_store.read_documents(spark, path).collect(), key=lambda x: x.start)
    assert [x.start for x in read] == np.cumsum([0, *[x.n_tokens for x in read[:-1]]]).tolist()
    assert [(x.doc_id, x.n_tokens) for x in read] == [(x.doc_id, x.n_tokens) for x in held]
    assert sorted((str(x.doc_id), zlib.crc32(np.array(x.ids, "<u4").tobytes())) for x in read) == sorted((str(x.doc_id), x.ids_crc32) for x in token_store.document_digests(spark, path).collect())


def test_of_rows_that_repeat_a_doc_id_one_teaches_whatever_their_order(spark):
    r = random.Random(8)
    texts = [(i, words(r, 40) + (" zug zwei" if i % 2 else " one two"), "de" if i % 2 else "en") for i in range(60)]
    texts += [(i, words(r, 40), lang) for i, _, lang in texts[:20] for _ in range(5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(texts)
        d = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(seed + 1)
        model, network = language.train(d), quality.train(d, labels, quality.train_vectors(d))
        asked = d.select("doc_id", "text").dropDuplicates()
        found.append((
            sorted(map(tuple, language.identify(asked, model).select("doc_id", "text", "lang_pred", F.round("lang_score", 9)).collect())),
            sorted(map(tuple, quality.score(asked, network, quality.train_vectors(d)).select("doc_id", "text", F.round("quality_score", 6)).collect())),
        ))
    assert found[0] == found[1]
