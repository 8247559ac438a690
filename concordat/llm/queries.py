"""One query for each operation of this subpackage, over whole tables, and the SQL that equals it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import bpe, exact, jaccard, langid, lines, lm, negatives, neighbours, packing, phrases, telephony, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"), packing.vocabulary("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", langid.held_out("doc_id").alias("held_out"), "text"), langid.fit(docs)).drop("text")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_digest(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), packing.vocabulary("byte_bpe_multi_50k.tiktoken"), packing.split_pattern(), digests=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), packing.vocabulary("byte_bpe_50k.tiktoken"), packing.split_pattern())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_bundles(table(spark, sf_dir, "pages"))).drop("body")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_repeated_passages, op3_packing, op4_language_id, op5_media, op6_byte_bpe, op7_token_counts, op8_exact_dedup, op9_ngram_jaccard_join, op10_warc, op11_nearest_neighbours, op12_collocations, op13_hard_negatives)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t""",
    "op12_collocations": """
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[ \\x09]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k)),
        f AS (SELECT lang, phrase, k, count(*) AS n FROM grams GROUP BY ALL),
        c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND n >= 30),
        cut AS (SELECT lang, phrase, n AS a, j, array_to_string(words[:j], ' ') AS first, array_to_string(words[j + 1:], ' ') AS rest FROM c, range(1, 4) t(j) WHERE j < k),
        cuts AS (SELECT cut.*, l.n AS l, r.n AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.n + r.n) AS BIGINT) AS score
            FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = first JOIN f r ON r.lang = cut.lang AND r.phrase = rest),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inner_parts AS (SELECT lang, n AS longer, unnest(list_transform(range(1, k - len_k + 2), lambda i: array_to_string(words[i:i + len_k - 1], ' '))) AS phrase
            FROM c, range(2, 4) s(len_k) WHERE len_k < k),
        most AS (SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.a),
        total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, score
        FROM kept k JOIN total USING (lang) QUALIFY rank <= 2000""",
    "op13_hard_negatives": """
        WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, other_id) AS INTEGER) AS rank,
            other_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
        QUALIFY rank <= 5""",
}
