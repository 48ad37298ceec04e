"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from buswright.llm import exact_dedup, hard_negatives, importance, language, licenses, minhash, mixing, ngram_join, piece_bpe, quality, token_store, toxicity, warc

QUERIES = {
    "op1_language_codes": language.op1_language_codes,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_quality_network": quality.op3_quality_network,
    "op4_minhash": minhash.op4_minhash,
    "op5_token_store": token_store.op5_token_store,
    "op6_warc_chunks": warc.op6_warc_chunks,
    "op7_piece_bpe": piece_bpe.op7_piece_bpe,
    "op8_toxic_spans": toxicity.op8_toxic_spans,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_bit_sliced_negatives": hard_negatives.op11_bit_sliced_negatives,
    "op12_crc_resampling": importance.op12_crc_resampling,
    "op13_diagonal_licenses": licenses.op13_diagonal_licenses,
}

ORACLE_SQL = {
    "op2_source_mix": mixing.OP2_SQL,
    "op6_warc_chunks": warc.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op11_bit_sliced_negatives": hard_negatives.OP11_SQL,
    "op13_diagonal_licenses": licenses.OP13_SQL,
}
