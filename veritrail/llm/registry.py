"""Queries of the training-data operators and the SQL to hold them against."""

from __future__ import annotations

import corpus_pipeline
from veritrail.llm.bpe import op5_byte_bpe
from veritrail.llm.decontaminate import OP4_SQL, op4_minhash_containment
from veritrail.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from veritrail.llm.ngram_lm import op3_ngram_trie
from veritrail.llm.passage_dedup import OP10_SQL, op10_line_dedup
from veritrail.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from veritrail.llm.quality_cnn import op2_byte_cnn_quality
from veritrail.llm.quality_rules import op6_compression_bands
from veritrail.llm.sharding import op1_histogram_sort
from veritrail.llm.simhash import op7_simhash_near_dedup
from veritrail.llm.token_counts import op9_section_tokens
from veritrail.llm.toxicity_crf import op8_crf_toxicity
from veritrail.llm.warc import OP12_SQL, op12_warc_boundary_chain

OPERATORS = (
    op1_histogram_sort,
    op2_byte_cnn_quality,
    op3_ngram_trie,
    op4_minhash_containment,
    op5_byte_bpe,
    op6_compression_bands,
    op7_simhash_near_dedup,
    op8_crf_toxicity,
    op9_section_tokens,
    op10_line_dedup,
    op11_prefix_trie,
    op12_warc_boundary_chain,
    op13_hard_negatives,
)


def queries():
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op4_minhash_containment": OP4_SQL, "op10_line_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_warc_boundary_chain": OP12_SQL, "op13_hard_negatives": OP13_SQL}
