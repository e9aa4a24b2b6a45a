"""The queries of this subpackage."""

from __future__ import annotations

from kgspark.llm.alignment import op11_cross_tokenizer_alignment
from kgspark.llm.fingerprint import op8_fingerprint
from kgspark.llm.lines import SQL as LINES_SQL
from kgspark.llm.lines import op12_line_dedup
from kgspark.llm.media import op2_media_columns
from kgspark.llm.mixing import op7_mixing
from kgspark.llm.negatives import op13_hard_negatives
from kgspark.llm.packing import op1_best_fit_packing
from kgspark.llm.quality import op5_quality_classifier
from kgspark.llm.secrets import op4_secret_scans
from kgspark.llm.sharding import op10_sharding
from kgspark.llm.simhash import op9_simhash_near_dedup
from kgspark.llm.tokens import op3_token_counts
from kgspark.llm.toxicity import op6_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_media_columns,
        op3_token_counts,
        op4_secret_scans,
        op5_quality_classifier,
        op6_toxicity,
        op7_mixing,
        op8_fingerprint,
        op9_simhash_near_dedup,
        op10_sharding,
        op11_cross_tokenizer_alignment,
        op12_line_dedup,
        op13_hard_negatives,
    )
}

#: The others can't be written in SQL that runs on whole tables: tests hold them against brute force.
ORACLE: dict[str, str] = {"op12_line_dedup": LINES_SQL}
