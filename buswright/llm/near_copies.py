"""Near copies by joining the bands of MinHash fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buswright.llm.common import materialise
from buswright.llm.minhash import SHINGLE, SIMILARITY, bands
from buswright.llm.ngram_join import Rule, components_of


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, a row a document: the smallest doc_id reachable by links.

    Documents link when the Jaccard similarity of their sets of five-word shingles is
    at least ``similarity``, verified on the whole sets, and they agree in a band of
    their fingerprints. A pair of similarity 0.8 agrees in none once in about 4,000
    pairs; pairs that agree in one are never dropped. ``similarity`` is a whole
    number of hundredths, since sets are compared in whole numbers.

    Null and empty texts and texts without words link with nothing. doc_ids are
    distinct: rows that repeat both doc_id and text get the same class. Rows without
    doc_id have a null class and link with nothing. Very long texts are sets like
    others, read in bounded batches; ties need no order, since a class is named by its
    smallest doc_id. Other columns are left out, whatever their names, and an empty
    table gives an empty result.
    """
    percent = round(100 * similarity)
    if not math.isclose(percent, 100 * similarity) or not 0 < percent <= 100:
        raise ValueError(f"a similarity of 0.01 to 1 in whole hundredths is expected, not {similarity}")
    index = materialise(bands(docs), "minhash-bands")
    named = components_of(docs, index, Rule(width=SHINGLE, percent=percent))
    return docs.select("doc_id").join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
