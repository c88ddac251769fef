"""The registered queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import op4_decontamination as op4
from tidemark.llm import op7_chat_format as op7
from tidemark.llm import op11_centroid_clustering as op11
from tidemark.llm import op12_nearest_neighbours as op12
from tidemark.llm import op13_periodic_runs as op13
from tidemark.llm.op1_best_fit_packing import op1_best_fit_packing
from tidemark.llm.op2_minhash_dedup import op2_minhash_dedup
from tidemark.llm.op3_suffix_dedup import op3_suffix_dedup
from tidemark.llm.op5_substring_dedup import op5_substring_dedup
from tidemark.llm.op6_pii import op6_pii
from tidemark.llm.op8_embedding_dedup import op8_embedding_dedup
from tidemark.llm.op9_quality import op9_quality
from tidemark.llm.op10_secrets import op10_secrets

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_dedup, op3_suffix_dedup, op4.op4_decontamination, op5_substring_dedup, op6_pii,
                                   op7.op7_chat_format, op8_embedding_dedup, op9_quality, op10_secrets, op11.op11_centroid_clustering, op12.op12_nearest_neighbours,
                                   op13.op13_periodic_runs)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op4_decontamination": op4.ORACLE, "op7_chat_format": op7.ORACLE, "op11_centroid_clustering": op11.ORACLE, "op12_nearest_neighbours": op12.ORACLE,
           "op13_periodic_runs": op13.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
