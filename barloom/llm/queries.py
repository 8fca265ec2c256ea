"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import prefix_trie
from .common import table
from .url_filter import judge_sql


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_fst import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_tokens

    return pack_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).drop("url", "payload")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages")).drop("n_hits")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_dimension_scan": op1_ann,
    "op2_png_media": op2_media,
    "op3_sentencepiece_transducer": op3_sentencepiece,
    "op4_ordinal_toxicity": op4_toxicity,
    "op5_karmarkar_karp_shards": op5_sharding,
    "op6_skip_chain_pii": op6_pii,
    "op7_simhash_gray_index": op7_simhash,
    "op8_karmarkar_karp_packing": op8_packing,
    "op9_warc_normaliser": op9_warc,
    "op10_site_style_tree": op10_html,
    "op11_weighted_url_vocabulary": op11_urls,
    "op12_sequence_collapse_trie": op12_trie,
    "op13_identity_map_alignment": op13_alignment,
}

#: DuckDB SQL where it can express the whole result: what the archives give back is what was put in.
ORACLES: dict[str, str] = {
    "op9_warc_normaliser": """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), f AS (SELECT payload, min(page_id) AS first FROM p WHERE strlen(payload) >= 100 GROUP BY payload)
SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload)""",
    "op11_weighted_url_vocabulary": judge_sql(),
    "op12_sequence_collapse_trie": prefix_trie.ORACLE,
}
