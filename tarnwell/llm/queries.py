"""One query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import language_id, ppm, resampling, suffix_dedup, token_store, toxicity
from tarnwell.llm.alignment import align
from tarnwell.llm import decontamination
from tarnwell.llm.decontamination import find_overlaps
from tarnwell.llm.jaccard_join import link
from tarnwell.llm.license_scan import scan_licenses
from tarnwell.llm.packing import pack
from tarnwell.llm.secret_scan import scan_secrets
from tarnwell.llm.voronoi_topk import top_k
from tarnwell.sources import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    ).drop("text_key")


def op5_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "documents")).drop("first_of_component", "text_key")


def op8_token_store(
    spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None
) -> DataFrame:
    index = token_store.write_store(
        read_table(spark, sf_dir, "documents"),
        tokenizer_path or public_tokenizers.path("word_bpe_49k.json"),
        token_store.new_store_folder(spark),
    )
    return token_store.read_store(index)


def op9_packing(
    spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None
) -> DataFrame:
    return pack(
        read_table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op11_token_alignment(
    spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    return align(
        read_table(spark, sf_dir, "documents"),
        a_path or public_tokenizers.path("byte_bpe_50k.json"),
        b_path or public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_voronoi_topk": op5_voronoi_topk,
    "op6_ppm_scoring": op6_ppm_scoring,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_store": op8_token_store,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_suffix_dedup": op13_suffix_dedup,
}



def masks_in_sql() -> str:
    """Rows of (size of the short items they are for or 0, number, offsets, span)."""
    masks = [(0, mask) for mask in decontamination.MASKS]
    masks += [(size, mask) for size in range(1, decontamination.WINDOW) for mask in decontamination.short_masks(size)]
    return ", ".join(f"({size}, {i}, {list(mask)}, {mask[-1] + 1})" for i, (size, mask) in enumerate(masks))


#: SQL for DuckDB, for the queries that SQL can express whole: plain nested comparisons.
ORACLES = {
    "op4_decontamination": f"""
        WITH masks(size, number, mask, span) AS (VALUES {masks_in_sql()}),
        docs AS (
            SELECT row_number() OVER () AS r, doc_id, text, words AS w
            FROM (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents)
        ),
        items AS (
            SELECT row_number() OVER () AS i, item_id, w, least(len(w), 13) AS width
            FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark)
            WHERE len(w) > 0
        ),
        used AS (SELECT * FROM masks WHERE size = 0 OR size IN (SELECT len(w) FROM items)),
        doc_seeds AS (
            SELECT r, number, p, list_transform(mask, lambda o: w[p + o + 1]) AS picked
            FROM (SELECT r, w, number, mask, unnest(range(len(w) - span + 1)) AS p FROM docs, used)
        ),
        item_seeds AS (
            SELECT i, number, span, q, list_transform(mask, lambda o: w[q + o + 1]) AS picked
            FROM (
                SELECT i, w, number, mask, span, unnest(range(len(w) - span + 1)) AS q
                FROM items, used WHERE size = CASE WHEN width < 13 THEN width ELSE 0 END
            ) JOIN items USING (i, w)
            WHERE width = 13 OR q = 0
        ),
        hits AS (
            SELECT d.r, s.i, number, p, q, span, x.w AS a, y.w AS b, width
            FROM doc_seeds d JOIN item_seeds s USING (number, picked) JOIN docs x ON x.r = d.r JOIN items y ON y.i = s.i
        ),
        compared AS (
            SELECT r, i, p, width,
                   list_max(list_transform(range(CASE WHEN width = 13 THEN span - 13 ELSE 0 END, 1), lambda z:
                       CASE WHEN width < 13 AND p + width > len(a) THEN 0 ELSE
                       list_sum(list_transform(range(width), lambda k: CASE
                           WHEN least(p, q) + z + k >= 0 AND p + z + k < len(a) AND q + z + k < len(b)
                                AND a[p + z + k + 1] = b[q + z + k + 1] THEN 1 ELSE 0 END)) END)) AS same
            FROM hits
        )
        SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS first_word, CAST(max(p) AS INTEGER) AS last_word,
               count(*) AS seeds, max(CAST(same AS DOUBLE) / c.width) AS best
        FROM compared c JOIN docs USING (r) JOIN items USING (i)
        WHERE same * 100 >= c.width * 80
        GROUP BY doc_id, text, item_id
    """,
    "op5_voronoi_topk": """
        WITH whole AS (
            SELECT vec_id,
                   list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
            FROM whole q JOIN whole d ON q.vec_id <> d.vec_id
            WHERE q.vec_id % 100 = 0
        ),
        ranked AS (
            SELECT query_id, vec_id, score,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op7_jaccard_join": """
        WITH RECURSIVE split AS (
            SELECT doc_id,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, s FROM (
                SELECT doc_id,
                       unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
                                             lambda i: array_to_string(w[i:i + 3], ' '))) AS s
                FROM split WHERE len(w) > 0
            )
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        linked AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, p.n, q.n
            HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
        ),
        reached AS (
            SELECT x, y FROM linked
            UNION
            SELECT r.x, l.y FROM reached r JOIN linked l ON r.y = l.x
        )
        SELECT d.doc_id,
               coalesce(max(n), 0) AS n_shingles,
               least(d.doc_id, (SELECT min(y) FROM reached r WHERE r.x = d.doc_id)) AS component_id,
               (SELECT count(*) FROM linked l WHERE l.x = d.doc_id) AS links
        FROM documents d LEFT JOIN sizes USING (doc_id)
        GROUP BY d.doc_id
    """,
    "op12_importance_resampling": """
        WITH crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce(
                [CAST(i AS BIGINT)] || range(8),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of
        ),
        split AS (
            SELECT d.rowid_ AS r, doc_id, target, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM (
                SELECT row_number() OVER () AS rowid_, doc_id, text, FALSE AS target FROM documents
                UNION ALL
                SELECT -row_number() OVER (), NULL, text, TRUE FROM benchmark
            ) d
        ),
        words AS (SELECT r, target, unnest(w) AS word FROM split),
        spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
        hashed AS (
            SELECT word, xor(list_reduce(
                [4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda i: CAST(('0x' || h[i:i + 1]) AS BIGINT)),
                lambda c, b: xor(crc_of[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) % 10000 AS bucket
            FROM spelled, crc_table
        ),
        counts AS (
            SELECT bucket, CAST(count(*) FILTER (WHERE NOT target) AS DOUBLE) AS s,
                   CAST(count(*) FILTER (WHERE target) AS DOUBLE) AS t
            FROM words JOIN hashed USING (word) GROUP BY bucket
        ),
        totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
            FROM counts, totals
        ),
        weights AS (
            SELECT r, CAST(sum(gain) AS BIGINT) AS gain, count(*) AS n
            FROM words JOIN hashed USING (word) JOIN gains USING (bucket)
            WHERE NOT target GROUP BY r
        ),
        scored AS (
            SELECT r, doc_id, coalesce(n, 0) AS n_features,
                   coalesce((gain - ((gain % n) + n) % n) // n, 0) AS weight,
                   CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM split LEFT JOIN weights USING (r) WHERE NOT target
        ),
        keyed AS (
            SELECT r, doc_id, n_features, weight,
                   weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM scored
        ),
        places AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () AS n
            FROM keyed WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
        FROM keyed LEFT JOIN places USING (r)
    """,
    "op13_suffix_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ),
        strings AS (
            SELECT r, place, md5(substr(h, 2 * place + 1, 400)) AS m
            FROM (SELECT r, h, unnest(range(len(h) // 2 - 199)) AS place FROM d)
        ),
        repeated AS (SELECT m FROM strings GROUP BY m HAVING count(*) > 1),
        hits AS (SELECT r, place FROM strings WHERE m IN (SELECT m FROM repeated)),
        marked AS (
            SELECT r, place, CASE WHEN place <= lag(place) OVER (PARTITION BY r ORDER BY place) + 200 THEN 0 ELSE 1 END AS new
            FROM hits
        ),
        runs AS (SELECT r, place, sum(new) OVER (PARTITION BY r ORDER BY place) AS run FROM marked),
        spans AS (SELECT r, min(place) AS b, max(place) + 200 AS e FROM runs GROUP BY r, run),
        per_doc AS (
            SELECT r, count(*) AS n_spans, CAST(sum(e - b) AS BIGINT) AS n_removed,
                   list(b ORDER BY b) AS begins, list(e ORDER BY b) AS ends
            FROM spans GROUP BY r
        ),
        cuts AS (
            SELECT r, doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
                   [0] || coalesce(ends, []) AS f, coalesce(begins, []) || [len(h) // 2] AS t
            FROM d LEFT JOIN per_doc USING (r)
        )
        SELECT doc_id, len(h) // 2 AS n_bytes, n_removed, n_spans,
               sha256(unhex(array_to_string(
                   list_transform(range(1, len(f) + 1), lambda i: substr(h, 2 * f[i] + 1, 2 * (t[i] - f[i]))), ''))) AS kept_sha256
        FROM cuts
    """,
}
