"""The training-data queries of this subpackage and their SQL."""

from __future__ import annotations

from . import hard_negatives, line_dedup, mixing, ngram_join, topk_search
from .alignment import op11_tokenizer_alignment
from .bpe import op9_byte_level_bpe
from .decontaminate import op7_decontamination
from .hard_negatives import op12_hard_negatives
from .html_text import op1_html_extraction
from .line_dedup import op5_line_dedup
from .mixing import op13_mix_sources
from .ngram_join import op2_ngram_jaccard_join
from .quality import op6_quality
from .secrets import op3_secret_scan
from .substring_dedup import op10_substring_dedup
from .topk_search import op8_exact_topk_search
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_ngram_jaccard_join, op3_secret_scan, op4_toxicity, op5_line_dedup, op6_quality, op7_decontamination, op8_exact_topk_search, op9_byte_level_bpe, op10_substring_dedup, op11_tokenizer_alignment, op12_hard_negatives, op13_mix_sources)}


def queries():
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    import corpus_pipeline

    sql = {"op2_ngram_jaccard_join": ngram_join.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op8_exact_topk_search": topk_search.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_mix_sources": mixing.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
