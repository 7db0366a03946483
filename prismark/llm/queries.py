"""The corpus operators as queries over whole tables: name -> (spark, folder) -> DataFrame; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import blocks, clusters, minhash, mixing, packing, passages, phrases, ppm, rules, sketches, tokens, toxicity, urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies by distinct 2-word shingles at a Jaccard similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=2, percent=80)


def vocabulary() -> str:
    """The public vocabulary file; it has the same path on the driver and on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_prefix_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text from its prefix table, and the longest prefix within 2048 of them."""
    return tokens.token_counts(table(spark, folder, "documents"), vocabulary(), limit=2048)


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of texts that are equal without white space, by block naming."""
    return blocks.exact_duplicates(table(spark, folder, "documents"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, then the weighted vocabulary, for every url of `pages`."""
    return urls.filter_urls(table(spark, folder, "pages"))


def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of every text and of its edited version, and how alike they and the next document's are."""
    return sketches.fingerprints(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learned from the labels outside the held-out third."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text without the strings of 50 bytes that a smaller document has."""
    return passages.repeated_passages(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of every document for which the expected tokens of good, poor and toxic text meet their targets."""
    docs = table(spark, folder, "documents")
    domains = mixing.fit_domains(docs, mixing.domain_labels(table(spark, folder, "labels")), mixing.DOMAINS)
    return mixing.mixed(docs, domains, mixing.TARGETS, vocabulary())


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 4096 tokens out of whole texts and their lexical neighbours."""
    return packing.pack(table(spark, folder, "documents"), vocabulary(), window=4096)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text by byte context trees, learned outside the held-out fifth."""
    return ppm.identify_languages(table(spark, folder, "documents"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Lloyd's rounds over the distinct quantised vectors of `embeddings`, assigned back to every usable vector."""
    return clusters.clusters(table(spark, folder, "embeddings"), k=8, rounds=10, dims=64, scale=1024, salt="3")


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's first 2000 phrases of two and three words."""
    return phrases.collocations(table(spark, folder, "documents"), longest=3, least=10, inside_percent=50, top=2000)


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every text, and the verdict of the cascade of rules."""
    return rules.judged(table(spark, folder, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_prefix_token_counts": op2_prefix_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": blocks.ORACLE_SQL,
    "op4_url_filters": urls.oracle_sql(),
    "op11_centroid_clustering": clusters.oracle_sql(),
    "op12_phrase_collocations": phrases.ORACLE_SQL,
    "op13_quality_rules": rules.oracle_sql(),
}
