"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from shelfmark.llm.ann import op7_posting_list_search
from shelfmark.llm.bpe import op3_pair_index_bpe
from shelfmark.llm.dartminhash import op8_dart_minhash
from shelfmark.llm.divergence import SQL as DIVERGENCE_SQL
from shelfmark.llm.divergence import op11_source_divergence
from shelfmark.llm.hmm import op9_hmm_likelihood
from shelfmark.llm.huffman import op1_huffman_token_file
from shelfmark.llm.mixing import SQL as MIXING_SQL
from shelfmark.llm.mixing import op10_fair_queue_mix
from shelfmark.llm.prefixtrie import SQL as TRIE_SQL
from shelfmark.llm.prefixtrie import op13_prefix_trie
from shelfmark.llm.secretscan import op6_crf_secrets
from shelfmark.llm.tokencounts import op12_overlap_token_counts
from shelfmark.llm.topk import SQL as TOPK_SQL
from shelfmark.llm.topk import op5_tiled_top_k
from shelfmark.llm.toxicity import op4_lexicon_toxicity
from shelfmark.llm.urlfilter import op2_url_model_ratio

QUERIES = {
    f.__name__: f
    for f in (
        op1_huffman_token_file,
        op2_url_model_ratio,
        op3_pair_index_bpe,
        op4_lexicon_toxicity,
        op5_tiled_top_k,
        op6_crf_secrets,
        op7_posting_list_search,
        op8_dart_minhash,
        op9_hmm_likelihood,
        op10_fair_queue_mix,
        op11_source_divergence,
        op12_overlap_token_counts,
        op13_prefix_trie,
    )
}

ORACLES = {"op5_tiled_top_k": TOPK_SQL, "op10_fair_queue_mix": MIXING_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op13_prefix_trie": TRIE_SQL}
