"""Queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from .common import documents
from .op01_language import identify_languages
from .op02_toxicity import score_toxicity
from .op03_ngram_join import jaccard_components
from .op03_ngram_join import oracle as jaccard_sql
from .op04_packing import pack_documents
from .op05_passages import repeated_passages
from .op06_bpe import encode_documents
from .op07_sharding import oracle as sharding_sql
from .op07_sharding import shard_rows
from .op08_merkle import fingerprint_edits
from .op08_merkle import oracle as merkle_sql
from .op09_secrets import oracle as secrets_sql
from .op09_secrets import scan_documents
from .op10_topk import oracle as topk_sql
from .op10_topk import search_embeddings
from .op11_codes import compress_embeddings
from .op11_codes import oracle as codes_sql
from .op12_divergence import audit_sources
from .op12_divergence import oracle as divergence_sql
from .op13_kmeans_tree import nearest_embeddings

#: The vocabulary file that the packing and encoding queries are stated for.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {
    "op1_ppm_language": lambda spark, sf_dir: identify_languages(documents(spark, sf_dir)),
    "op2_factorization_toxicity": lambda spark, sf_dir: score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op3_ngram_jaccard": lambda spark, sf_dir: jaccard_components(documents(spark, sf_dir)),
    "op4_sum_of_squares_packing": lambda spark, sf_dir: pack_documents(documents(spark, sf_dir), VOCABULARY),
    "op5_collinear_passages": lambda spark, sf_dir: repeated_passages(documents(spark, sf_dir)),
    "op6_bpe_automaton": lambda spark, sf_dir: encode_documents(documents(spark, sf_dir), VOCABULARY),
    "op7_feistel_sharding": lambda spark, sf_dir: shard_rows(documents(spark, sf_dir)),
    "op8_merkle_fingerprints": lambda spark, sf_dir: fingerprint_edits(documents(spark, sf_dir)),
    "op9_blob_ledger_secrets": lambda spark, sf_dir: scan_documents(documents(spark, sf_dir)),
    "op10_ball_tree_topk": lambda spark, sf_dir: search_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op11_delta_lloyd_codes": lambda spark, sf_dir: compress_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op12_source_divergence": lambda spark, sf_dir: audit_sources(documents(spark, sf_dir)),
    "op13_kmeans_tree": lambda spark, sf_dir: nearest_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
}

ORACLES = {
    "op3_ngram_jaccard": jaccard_sql(),
    "op7_feistel_sharding": sharding_sql(),
    "op8_merkle_fingerprints": merkle_sql(),
    "op9_blob_ledger_secrets": secrets_sql(),
    "op10_ball_tree_topk": topk_sql(),
    "op11_delta_lloyd_codes": codes_sql(),
    "op12_source_divergence": divergence_sql(),
}
