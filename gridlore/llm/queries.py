"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import OP1_SQL, op1_chat_format
from .decontaminate import OP3_SQL, op3_benchmark_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .language_id import op5_language_id
from .licenses import OP12_SQL, op12_license_scan
from .packing import op7_best_fit_packing
from .pii import op8_pii_pseudonyms
from .spelling import OP11_SQL, op11_spelling_variants
from .suffix_dedup import OP10_SQL, op10_suffix_dedup
from .token_counts import op4_token_counts
from .warc import OP2_SQL, op2_warc_transactions
from .whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_warc_transactions, op3_benchmark_decontamination, op4_token_counts, op5_language_id, op6_exact_dedup, op7_best_fit_packing, op8_pii_pseudonyms, op9_jaccard_join, op10_suffix_dedup, op11_spelling_variants, op12_license_scan, op13_embedding_whitening)}
SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL, "op2_warc_transactions": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op9_jaccard_join": OP9_SQL, "op10_suffix_dedup": OP10_SQL,
    "op11_spelling_variants": OP11_SQL, "op12_license_scan": OP12_SQL,
}
