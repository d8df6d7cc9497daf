"""The registered queries of this package and their SQL."""

from __future__ import annotations

from kinweave.llm.bpe import op1_bpe
from kinweave.llm.centroids import OP13_SQL, op13_centroids
from kinweave.llm.exact import OP6_SQL, op6_exact_dedup
from kinweave.llm.hnsw import op8_hnsw
from kinweave.llm.jaccard import op4_ngram_jaccard
from kinweave.llm.langid import op7_language_id
from kinweave.llm.mixing import op5_mixing
from kinweave.llm.pii import op10_pii
from kinweave.llm.repair import OP11_SQL, op11_repair
from kinweave.llm.suffixes import op12_suffixes
from kinweave.llm.tokencount import op9_token_counts
from kinweave.llm.urlfilter import OP3_SQL, op3_url_filter
from kinweave.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_url_filter": op3_url_filter,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_hnsw": op8_hnsw,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_repair": op11_repair,
    "op12_suffixes": op12_suffixes,
    "op13_centroids": op13_centroids,
}
ORACLE: dict[str, str] = {"op2_warc": OP2_SQL, "op3_url_filter": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op11_repair": OP11_SQL, "op13_centroids": OP13_SQL}
