"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import anchors, binslack, bitslices, crossparse, cutting, hostpaths, interpolation, minhash, positive_unlabelled, rankqueue, repetition, sonphrases, vptree
from tastemill.llm.shared import crc_remainder, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ACCEPTED = 0.3


def register(run):
    QUERIES[run.__name__] = run
    return run


@register
def op1_bbit_minhash_groups(spark: SparkSession, root: str) -> DataFrame:
    """Near-duplicate groups of all documents on sets of 4-word shingles."""
    return minhash.groups(tables(spark, root, "documents"), size=4, percent=80)


@register
def op2_positive_unlabelled_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality of every document by a classifier of positives and unlabelled text."""
    docs, labels = tables(spark, root, "documents"), tables(spark, root, "labels")
    scorer = positive_unlabelled.learn(docs, labels, crc_remainder("doc_id", 5) != 0)
    scored = positive_unlabelled.score(docs, scorer)
    return scored.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


@register
def op3_deleted_interpolation(spark: SparkSession, root: str) -> DataFrame:
    """Log probability of every document by interpolated bigrams."""
    fold = crc_remainder("doc_id", 7)
    scored = interpolation.score(tables(spark, root, "documents"), fold != 2, fold == 3)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op4_cross_parsing_language(spark: SparkSession, root: str) -> DataFrame:
    """Language of every document by cross-parsing."""
    docs = tables(spark, root, "documents")
    parser = crossparse.learn(docs, crc_remainder("doc_id", 4) != 2)
    found = crossparse.predict(docs, parser)
    return found.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@register
def op5_host_path_extraction(spark: SparkSession, root: str) -> DataFrame:
    """Main text of every page."""
    return hostpaths.extract(tables(spark, root, "pages"))


@register
def op6_difference_cover_passages(spark: SparkSession, root: str) -> DataFrame:
    """Words of every document without passages that an earlier document has."""
    stripped = anchors.strip_repeats(tables(spark, root, "documents").select("doc_id", "text"), window=13)
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register
def op7_suffix_array_repetition(spark: SparkSession, root: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return repetition.judge(tables(spark, root, "documents"))


@register
def op8_rank_queue_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    coded = rankqueue.encode_and_decode(tables(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op9_vantage_point_search(spark: SparkSession, root: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return vptree.nearest(tables(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)


@register
def op10_cutting_stock_packing(spark: SparkSession, root: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return cutting.pack(tables(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op11_minimum_bin_slack(spark: SparkSession, root: str) -> DataFrame:
    """All documents in as few sequences of at most 2048 ids as the method finds."""
    return binslack.pack(tables(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op12_son_phrases(spark: SparkSession, root: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return sonphrases.phrases(tables(spark, root, "documents"))


ORACLES["op12_son_phrases"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
runs AS (
    SELECT lang, 1 AS k, unnest(ws) AS phrase FROM lists
    UNION ALL SELECT lang, 2, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) FROM lists
    UNION ALL SELECT lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) FROM lists
), totals AS (SELECT lang, count(*) AS n FROM runs WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 10),
cuts AS (
    SELECT lang, phrase, f AS a, k, 1 AS c, split_part(phrase, ' ', 1) AS x, substr(phrase, strpos(phrase, ' ') + 1) AS y FROM f WHERE k > 1
    UNION ALL
    SELECT lang, phrase, f, k, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM f WHERE k = 3
), scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.k, a, fx.f AS l, fy.f AS r, c,
           (1000000::hugeint * a * a) // (fx.f::hugeint * fy.f) AS score
    FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
around AS (
    SELECT lang, phrase, max(f) AS around FROM (
        SELECT lang, f, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase FROM f WHERE k = 3
        UNION ALL SELECT lang, f, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM f WHERE k = 3) GROUP BY lang, phrase
), kept AS (
    SELECT w.* FROM weakest w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase AND w.k = 2
    WHERE around IS NULL OR 100 * around < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@register
def op13_bit_sliced_search(spark: SparkSession, root: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return bitslices.search(bitslices.build(tables(spark, root, "documents")), tables(spark, root, "benchmark"))


ORACLES["op13_bit_sliced_search"] = r"""
WITH words AS (
    SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY rid, doc_id, term),
lengths AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
size AS (SELECT count(*) AS total_docs, sum(n)::BIGINT AS total_terms FROM lengths),
weights AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * total_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, total_docs
), asked AS (
    SELECT DISTINCT iid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark)
), scored AS (
    SELECT iid, item_id, tf.rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total_docs) // total_terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (rid), size GROUP BY iid, item_id, tf.rid, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
