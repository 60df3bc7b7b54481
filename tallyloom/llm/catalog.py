"""The subpackage's registered queries and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from tallyloom.llm import chat, decontaminate, jaccard_join, prefix_trie, ranked_search, warc
from tallyloom.llm.byte_bpe import op2_byte_bpe
from tallyloom.llm.chat import op10_chat
from tallyloom.llm.decontaminate import op1_decontaminate
from tallyloom.llm.jaccard_join import op13_jaccard_join
from tallyloom.llm.language import op6_language
from tallyloom.llm.media import op7_media, page_sequences
from tallyloom.llm.packed_tokens import op3_packed_tokens
from tallyloom.llm.pii import op9_pii
from tallyloom.llm.prefix_trie import op11_prefix_trie
from tallyloom.llm.ranked_search import op12_ranked_search
from tallyloom.llm.simhash import op8_simhash
from tallyloom.llm.token_counts import op5_token_counts
from tallyloom.llm.warc import op4_warc

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_byte_bpe, op3_packed_tokens, op4_warc, op5_token_counts, op6_language, op7_media, op8_simhash, op9_pii, op10_chat, op11_prefix_trie, op12_ranked_search, op13_jaccard_join)}
QUERIES["page_sequences"] = page_sequences
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op4_warc": warc.ORACLE, "op10_chat": chat.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_ranked_search": ranked_search.ORACLE, "op13_jaccard_join": jaccard_join.ORACLE} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
