"""The registered queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigia.llm.bpe_codec import op10_byte_bpe
from vigia.llm.collocations import OP11_SQL, op11_collocations
from vigia.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from vigia.llm.html_extraction import op8_html_extraction
from vigia.llm.jaccard_join import op3_jaccard_join
from vigia.llm.license_scan import OP2_SQL, op2_license_scan
from vigia.llm.mixing import op12_mixing
from vigia.llm.packing import op4_packing
from vigia.llm.quality_rules import OP9_SQL, op9_quality_rules
from vigia.llm.ranked_search import OP13_SQL, op13_ranked_search
from vigia.llm.token_counts import op1_token_counts
from vigia.llm.token_files import op6_token_files
from vigia.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {"op2_license_scan": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op9_quality_rules": OP9_SQL, "op11_collocations": OP11_SQL, "op13_ranked_search": OP13_SQL}
