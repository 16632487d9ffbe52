"""The registered queries of this package, and their SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

import corpus_pipeline
from affinity.llm.collocations import collocations
from affinity.llm.decontaminate import contaminated
from affinity.llm.forest import nearest
from affinity.llm.language import identify
from affinity.llm.licenses import scan_licenses
from affinity.llm.lm import score_documents
from affinity.llm.minhash import near_duplicates
from affinity.llm.negatives import hard_negatives
from affinity.llm.ngram_join import ngram_join
from affinity.llm.passages import repeated_passages
from affinity.llm.pieces import digests, encode_documents
from affinity.llm.quality import score_quality
from affinity.llm.text import read_table
from affinity.llm.toxicity import score_toxicity


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    return digests(encode_documents(read_table(spark, sf_dir, "documents"), model, cached=150_000))


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op11_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))


def op13_packed_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, vectors.filter("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_prefix_forest": op1_prefix_forest,
        "op2_minhash": op2_minhash,
        "op3_spaced_seeds": op3_spaced_seeds,
        "op4_weak_supervision": op4_weak_supervision,
        "op5_pieces": op5_pieces,
        "op6_factorization_machine": op6_factorization_machine,
        "op7_language": op7_language,
        "op8_licenses": op8_licenses,
        "op9_trie_lm": op9_trie_lm,
        "op10_chaining": op10_chaining,
        "op11_automata": op11_automata,
        "op12_count_rtree": op12_count_rtree,
        "op13_packed_rtree": op13_packed_rtree,
        "pipeline": corpus_pipeline.run,
    }


#: Products of each anchor with all rows; the list functions keep null components apart.
_HARD_NEGATIVES = """
WITH p AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM p a JOIN p b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, g.other AS positive_id, n.other AS negative_id, g.score AS positive_score,
  n.score AS negative_score, row_number() OVER (
    PARTITION BY anchor_id, g.other ORDER BY n.score DESC, n.other)::INT AS rank
FROM positives g JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 50 * g.score <= 100 * n.score AND 100 * n.score <= 95 * g.score
QUALIFY rank <= 3
"""


def _linked_sql(words: int, percent: int, kept: str) -> str:
    """Sets of shingles, links, and the smallest id reachable, by joins on equal shingles."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
    translate(coalesce(text, ''), '{upper}', '{lower}'), '[ \\t\\n\\x0B\\f\\r]+') IF x <> ''] AS words
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(
    [array_to_string(words[i:i + {words - 1}], ' ') FOR i IN range(1, greatest(len(words) - {words - 2}, 2))]) END AS shingles
  FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(shingles) AS n_shingles, component_id{kept} FROM s JOIN c USING (doc_id)
"""


_COLLOCATIONS = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS id, [x FOR x IN string_split_regex(piece, '[ \\t]+') IF x <> ''] AS words FROM p),
t AS (SELECT lang, id, unnest(words) AS w1, unnest(range(len(words))) AS pos FROM w),
x AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY id ORDER BY pos)),
f AS (
  SELECT lang, [w1] AS gram, count(*) AS a FROM x GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) FROM x WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM x WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(gram) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(gram) > 1 AND a >= 10),
parts AS (
  SELECT lang, gram, a, k, gram[:k] AS first, gram[k + 1:] AS rest
  FROM c, (VALUES (1), (2)) AS sizes(k) WHERE k < len(gram)),
cuts AS (
  SELECT q.lang, q.gram, q.a, q.k, l.a AS l, r.a AS r,
    (1000000::HUGEINT * q.a * q.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM parts q JOIN f l ON l.lang = q.lang AND l.gram = q.first JOIN f r ON r.lang = q.lang AND r.gram = q.rest
  QUALIFY row_number() OVER (PARTITION BY q.lang, q.gram ORDER BY score, q.k) = 1),
inside AS (
  SELECT lang, gram[1:2] AS gram, a FROM c WHERE len(gram) = 3
  UNION ALL SELECT lang, gram[2:3], a FROM c WHERE len(gram) = 3),
longer AS (SELECT lang, gram, max(a) AS most FROM inside GROUP BY ALL),
kept AS (
  SELECT lang, array_to_string(gram, ' ') AS phrase, cuts.a, l, r, score
  FROM cuts LEFT JOIN longer USING (lang, gram) WHERE most IS NULL OR 100 * most < 50 * cuts.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash": _linked_sql(5, 75, ", doc_id = component_id AS kept"),
        "op11_automata": _COLLOCATIONS,
        "op12_count_rtree": _linked_sql(3, 90, ""),
        "op13_packed_rtree": _HARD_NEGATIVES,
    }
