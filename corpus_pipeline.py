"""The documents of a corpus, prepared for training: checked, freed of copies and benchmark text, masked, and packed.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and is written as Parquet before the
next one reads it. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from vellum import session
from vellum.llm import fertility, minhash, packing, personal_data, spaced_seeds
from vellum.llm.encoding import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the bands of tokeniser fertility; null and empty texts go."""
    return fertility.within_bands(docs, tokenizer_file("piece_bpe_32k.model"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that shares 80 % or more of its 5-word shingles."""
    return minhash.without_near_copies(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, worn or not, of a benchmark item."""
    return spaced_seeds.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data as <KIND> and n_chars counted anew; a null text stays null."""
    return personal_data.without_personal_data(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096), 4096)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("decontamination", decontamination),
          ("personal_data", personal_data_masking), ("best_fit_packing", best_fit_packing)]

# Tokenisers, signatures and a trained field are beyond SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of `sf_dir`."""
    session.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
