"""The registered query of every operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import table


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.edit_embedding import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 24)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from statloom.llm.bpe import decoded_documents

    return decoded_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.substrings import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from statloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.dart_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.hard_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, scale=256)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.periodic import periodic_runs, run_digests, with_planted_runs

    return run_digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.main_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_licences, op2_mixing, op3_embeddings, op4_edit_embedding, op5_sharding, op6_bpe, op7_substrings, op8_token_counts, op9_toxicity, op10_dart_minhash,
                                   op11_hard_negatives, op12_periodic_runs, op13_main_text)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: SQL for the operators whose results it can express by comparing all with all, which small tables allow.
ORACLES: dict[str, str] = {
    "op3_embeddings": """WITH RECURSIVE parts AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings),
        sound AS (SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x)) AND bool_or(x <> 0)),
        v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN sound USING (vec_id)),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) ELSE 0 END >= 0.95),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM link GROUP BY a),
        told AS (SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(r.b, e.vec_id)) AS component_id
                 FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN least_of r ON e.vec_id = r.a)
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM told""",
    "op7_substrings": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS lo FROM d WHERE len(w) >= 20),
        windows AS (SELECT doc_id, lo, array_to_string(w[lo + 1 : lo + 20], ' ') AS run FROM places),
        ordered AS (SELECT doc_id, lo, row_number() OVER (PARTITION BY run ORDER BY doc_id, lo) AS nth FROM windows),
        gone AS (SELECT DISTINCT doc_id, unnest(range(lo, lo + 20)) AS i FROM ordered WHERE nth > 1),
        words AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
        left_over AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY words.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN left_over l ON d.doc_id = l.doc_id""",
    "op10_dart_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        runs AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS run FROM runs),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON p.a = x.doc_id JOIN sizes y ON p.b = y.doc_id WHERE 5 * p.n >= 4 * (x.n + y.n - p.n)),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        told AS (SELECT doc_id, least(doc_id, coalesce(b, doc_id)) AS class_id FROM documents LEFT JOIN least_of ON doc_id = a)
        SELECT doc_id, class_id, doc_id = class_id AS kept FROM told""",
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, embedding
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        parts AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v),
        odd AS (SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
        w AS (SELECT vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts WHERE vec_id NOT IN (SELECT vec_id FROM odd)),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
              FROM w a JOIN w b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
