"""The registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafaudit.llm import bpe, exact, html, lines, merkle, near, negatives, packing, quality, search, secrets, warc
from leafaudit.llm.common import read_table
from leafaudit.session import scratch_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_components(read_table(spark, sf_dir, "documents"), width=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.scan_secrets(read_table(spark, sf_dir, "documents")))


def op6_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", search.integer_components().alias("components"))
    return search.top_k(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(read_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.merkle_manifest(docs, received={"text": F.when(struck, merkle.lower_ascii("text")).otherwise(F.col("text"))})


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy, archives = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(read_table(spark, sf_dir, "pages"), legacy)
    warc.convert_arc(spark, legacy, archives)
    found = warc.read_warc(spark, archives, payloads=False).filter("record_type <> 'warcinfo'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.mining_rows(read_table(spark, sf_dir, "embeddings"))
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    rows = rows.withColumn("label", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe_encoding, op2_line_dedup, op3_ngram_jaccard_join, op4_exact_dedup, op5_secret_scans, op6_top_k_search, op7_quality_classifier, op8_token_counts, op9_html_extraction, op10_packing, op11_merkle_manifest, op12_warc, op13_hard_negatives)
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_top_k_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || lang, '') AS g, text, list_reduce(
                    list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
            FROM documents),
        l AS (
            SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN xor(crc, 4294967295) % 3 = 0
                        THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
                        ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS back
            FROM d),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM l),
        up AS (
            SELECT 0 AS level, g, p, n, leaf AS digest FROM leaves
            UNION ALL
            SELECT level + 1, g, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM up WHERE n > 1 GROUP BY level, g, p // 8, n),
        subroots AS (
            SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS p, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (
            SELECT 0 AS level, p, n, subroot AS digest FROM subroots
            UNION ALL
            SELECT level + 1, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY level, p // 8, n),
        sides AS (
            SELECT level, g, p,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY level, g, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY level, g, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM (SELECT level, g, p, n, digest FROM up WHERE n > 1 UNION ALL SELECT 1000 + level, NULL, p, n, digest FROM top WHERE n > 1)),
        fold AS (
            SELECT 0 AS level, g, p AS home, p, back AS h, '' AS proof FROM leaves
            UNION ALL
            SELECT f.level + 1, f.g, f.home, f.p // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
            FROM fold f JOIN sides s ON s.level = f.level AND s.g = f.g AND s.p = f.p),
        low AS (SELECT g, home, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM fold GROUP BY g, home),
        high AS (
            SELECT 1000 AS level, low.g, low.home, s.p, low.h, low.proof FROM low JOIN subroots s ON s.g = low.g
            UNION ALL
            SELECT f.level + 1, f.g, f.home, f.p // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
            FROM high f JOIN sides s ON s.level = f.level AND s.g IS NULL AND s.p = f.p),
        done AS (SELECT g, home, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM high GROUP BY g, home)
        SELECT a.doc_id, a.leaf, s.subroot, t.digest AS root, sha256(done.proof) AS proof_sha256, done.h AS folded_root, done.h = t.digest AS verified
        FROM leaves a JOIN done ON done.g = a.g AND done.home = a.p JOIN subroots s ON s.g = a.g JOIN top t ON t.n = 1""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
                AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 5""",
    "op12_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
                   row_number() OVER g AS place, first_value(page_id) OVER g AS last
            FROM pages WINDOW g AS (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST))
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN last END AS refers_to
        FROM p""",
}
