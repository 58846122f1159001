"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from repaylens.llm.bpe import op2_bpe
from repaylens.llm.bytebpe import op12_byte_bpe
from repaylens.llm.fingerprint import OP3_SQL, op3_exact_dedup
from repaylens.llm.jaccard import op7_jaccard
from repaylens.llm.leaks import op8_decontamination
from repaylens.llm.licenses import op10_licenses
from repaylens.llm.lines import op1_line_dedup
from repaylens.llm.negatives import OP11_SQL, op11_hard_negatives
from repaylens.llm.ranked import OP13_SQL, op13_ranked_search
from repaylens.llm.shards import op4_sharding
from repaylens.llm.toxicity import op9_toxicity
from repaylens.llm.trees import op6_chat
from repaylens.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_warc": op5_warc,
    "op6_chat": op6_chat,
    "op7_jaccard": op7_jaccard,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE = {
    "op3_exact_dedup": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
