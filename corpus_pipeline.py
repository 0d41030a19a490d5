"""A corpus pipeline of the operators in veilwright.llm: each stage reads what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import line_dedup, quality_suffix, sentencepiece_codec, simhash_dedup, source_mix
from veilwright.llm.common import staged, table
from veilwright.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the length and repetition rules. Null or empty texts go; repeated rows stay."""
    return quality_suffix.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and near-repeated lines, n_chars to match; documents left without a word go.

    Near is one word more, less or other in lines of five words or more, and one character in all of five characters.

    Null texts have no lines and stay as they are, n_chars included.
    """
    out = line_dedup.line_dedup(docs, drop_emptied=True, char_edits=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by doc_id of each group of SimHash near-duplicates: 3-word shingles, at most 3 bits.

    Null and empty texts are one group; documents without doc_id come last in theirs.
    """
    return simhash_dedup.simhash_dedup(docs, words_per_shingle=3, distance=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1, 150% of all words, a source at most twice.

    A null source is a source of its own; a document without words is repeated with its source's whole copies only.
    """
    return source_mix.mixed_documents(docs, (5, 2, 1), 1.5, 2.0, seed=8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip, parity) of every row of the mix. Null and empty texts have no ids."""
    return sentencepiece_codec.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

#: XXH64 fingerprints and SentencePiece ids cannot be said in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read back as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
