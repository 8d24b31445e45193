"""The registered queries of this folder, over whole tables with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum import session
from vellum.llm import (fertility, fill_in_middle, hard_negatives, licences, main_text, minhash, ngram_bloom, packing, personal_data, piece_coding,
                        spaced_seeds, suffix_dedup, token_records)
from vellum.llm.encoding import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(session.ship(spark), sf_dir)
    QUERIES[run.__name__] = shipped
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document: 3-word shingles, 85 % or more in common."""
    return minhash.near_copies(table(spark, sf_dir, "documents"), words=3, percent=85).drop("text_hash")


@query
def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best overlap of every document with every benchmark item it holds a copy of."""
    found = spaced_seeds.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "n_equal")


@query
def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and fertility bands of every document."""
    made = fertility.verdicts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "n_tokens", "byte_tokens", "chars_per_token", "words_per_token", "byte_share", "entropy")


@query
def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as records in ascending doc_id order and read back from them."""
    folder = session.fresh_folder(spark, "records")
    token_records.write_records(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    read = token_records.read_records(token_records.read_index(spark, folder), folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op5_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and the log-frequency Bloom filter model's score of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return ngram_bloom.scores(docs.select("doc_id", "text", held_out.alias("held_out")), "held_out")


@query
def op6_semi_markov_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the rules' spans, and all spans with the model's."""
    return personal_data.detected(table(spark, sf_dir, "documents"), ["doc_id"]).drop("masked")


@query
def op7_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document that grants a licence."""
    return licences.scanned(table(spark, sf_dir, "documents"))


@query
def op8_maximum_scoring_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once strings of 50 bytes that an earlier one has are gone."""
    left = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 ids, placed by best fit decreasing."""
    made = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(made, 4096)


@query
def op11_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor, scored exactly; the labels of every seventh row are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query
def op12_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with a SentencePiece merge model and decoded again."""
    return piece_coding.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op13_skip_list_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-middle example, and restored from it."""
    made = fill_in_middle.filled(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op11_four_russians_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS alike, list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
    id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5"""

ORACLES["op13_skip_list_fill_in_middle"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
    array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
