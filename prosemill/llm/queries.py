"""The subpackage's registered queries; none of them is expressible in SQL unless ``oracle_sql`` has it."""

from __future__ import annotations

import corpus_pipeline
from prosemill.llm.dart_minhash import op4_dart_minhash
from prosemill.llm.fuzzy_lines import op10_fuzzy_lines
from prosemill.llm.gear_chunks import op5_gear_chunks
from prosemill.llm.kk_shards import op2_kk_shards
from prosemill.llm.kmeans_tree import op3_kmeans_tree
from prosemill.llm.language_id import op8_language_id
from prosemill.llm.nbest_pieces import op9_nbest_pieces
from prosemill.llm.qgram_leaks import op7_qgram_leaks
from prosemill.llm.sparse_suffixes import op6_sparse_suffixes
from prosemill.llm.semicrf_pii import op1_semicrf_pii

_ALL = (
    op1_semicrf_pii,
    op2_kk_shards,
    op3_kmeans_tree,
    op4_dart_minhash,
    op5_gear_chunks,
    op6_sparse_suffixes,
    op7_qgram_leaks,
    op8_language_id,
    op9_nbest_pieces,
    op10_fuzzy_lines,
)


def queries():
    return {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
