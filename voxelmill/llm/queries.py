"""The registered queries of this subpackage and their SQL."""

from .decontaminate import op6_decontamination
from .divergence import op12_source_divergence, op12_sql
from .fill_middle import op11_fill_in_middle, op11_sql
from .fingerprints import op2_fingerprints
from .licences import op1_licence_scan, scan_sql
from .near_dedup import op4_minhash_dedup, op4_sql
from .packing import op3_best_fit_packing
from .pieces import op13_sentence_pieces
from .quality import op5_quality_classifier
from .sharding import op7_sharding
from .suffix_dedup import op9_suffix_dedup
from .token_files import op8_token_files
from .warc import op10_sql, op10_warc

QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_fingerprints": op2_fingerprints,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_token_files": op8_token_files,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_divergence": op12_source_divergence,
    "op13_sentence_pieces": op13_sentence_pieces,
}
SQL: dict[str, str] = {"op1_licence_scan": scan_sql(), "op4_minhash_dedup": op4_sql(), "op10_warc": op10_sql(), "op11_fill_in_middle": op11_sql(), "op12_source_divergence": op12_sql()}
