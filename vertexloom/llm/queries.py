"""The queries of this subpackage, each an operator applied to its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm.common import table
from vertexloom.llm.fingerprints import fingerprint_query
from vertexloom.llm.jaccard import jaccard_query
from vertexloom.llm.langid import language_query
from vertexloom.llm.mixing import mix_query
from vertexloom.llm.neardup import near_duplicate_query
from vertexloom.llm.oracles import JACCARD, MIX, NEAR
from vertexloom.llm.packing import pack_query
from vertexloom.llm.sharding import shard_query
from vertexloom.llm.tokenfile import token_file_query
from vertexloom.llm.tokens import token_count_query
from vertexloom.llm.toxicity import toxicity_query


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": lambda s, d: jaccard_query(table(s, d, "documents")),
    "op2_mix_sources": lambda s, d: mix_query(table(s, d, "documents")),
    "op3_best_fit_packing": lambda s, d: pack_query(table(s, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op4_language_id": lambda s, d: language_query(table(s, d, "documents")),
    "op5_embedding_near_dedup": lambda s, d: near_duplicate_query(table(s, d, "embeddings")),
    "op6_token_files": lambda s, d: token_file_query(table(s, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op7_toxicity": lambda s, d: toxicity_query(table(s, d, "documents"), table(s, d, "labels")),
    "op8_fingerprints": lambda s, d: fingerprint_query(table(s, d, "documents")),
    "op9_sharding": lambda s, d: shard_query(table(s, d, "documents")),
    "op10_token_counts": lambda s, d: token_count_query(table(s, d, "documents"), tokenizer("byte_bpe_50k.json")),
}

#: Tokenizers, trained models, hashes and rings that DuckDB lacks are compared with brute force in tests/llm instead.
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": JACCARD, "op2_mix_sources": MIX, "op5_embedding_near_dedup": NEAR}
