"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fptree, htmlmain, langid, media, ngramjoin, oracles, piecesampling, pii, rangejoin, sstable, suffixdedup, toxicity, variants
from .common import table


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that would give it away."""
    return pii.report(table(spark, sf_dir, "documents"))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an 8-bit audio file, read back and analysed."""
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that start in an earlier one."""
    return suffixdedup.digest(table(spark, sf_dir, "documents"))


def op4_sstable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to sorted-string-table shards and read back."""
    return sstable.digest(sstable.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the overlaps."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "bm25", "question_overlap", "answer_overlap")})


def _held_out() -> Column:
    """Whether crc32 of doc_id's text leaves 0 modulo 5."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated toxicity score for every document."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out(), "score", "predicted")


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return ngramjoin.classes(table(spark, sf_dir, "documents"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled, reproducible segmentation of every document, decoded again."""
    return piecesampling.digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.select("doc_id", "lang", "text")))
    return found.select("doc_id", _held_out(), "lang_pred", "score")


def op11_vector_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors whose cosine reaches 0.95."""
    return rangejoin.join(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for each benchmark item."""
    return fptree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, the form it is taken for, and that form's root."""
    return variants.group(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii_spans, op2_audio_features, op3_suffix_dedup, op4_sstable_ids, op5_benchmark_leaks, op6_toxicity, op7_shingle_join, op8_sampled_pieces, op9_main_text, op10_language, op11_vector_range_join, op12_ranked_search, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    """Of the others no SQL is possible, or none that is fast enough on whole tables; tests hold them against plain versions."""
    return {"op1_pii_spans": oracles.PII_SPANS, "op3_suffix_dedup": oracles.SUFFIX_DEDUP, "op5_benchmark_leaks": oracles.BENCHMARK_LEAKS, "op7_shingle_join": oracles.SHINGLE_JOIN, "op9_main_text": oracles.MAIN_TEXT, "op11_vector_range_join": oracles.VECTOR_RANGE_JOIN, "op12_ranked_search": oracles.RANKED_SEARCH, "op13_spelling_variants": oracles.SPELLING_VARIANTS}
