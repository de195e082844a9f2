"""Registered queries of the operators, and the SQL (DuckDB) that some must agree with."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import (
    exact_dedup, fill_middle, licenses, mixing, packing, repetition, secrets, simhash, token_files, toxicity, vector_codes,
    warc, window_packing,
)

# Parameters of packing and token files: where the public vocabulary files are.
WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_data=False).where("last").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)).drop("text_hash")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)).drop("text_hash")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    q.__name__: q
    for q in (
        op1_exact_dedup, op2_warc, op3_best_fit_packing, op4_token_files, op5_license_scan, op6_mixing, op7_simhash,
        op8_secret_scan, op9_repetition, op10_toxicity, op11_vector_codes, op12_fill_middle, op13_window_packing, pipeline,
    )
}

ORACLE = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), k AS (
            SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
        ), k AS (
            SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS response_id FROM p
        )
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
        FROM k
    """,
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
            FROM d GROUP BY source
        ), c AS (
            SELECT *, 2 * source_size AS most, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
                   sum(2 * source_size) OVER earlier AS fixed, sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS free
            FROM s WINDOW earlier AS (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT *, (budget - coalesce(fixed, 0)::DOUBLE) / free::DOUBLE AS lvl FROM c
        ), t AS (
            SELECT source, source_size,
                   least(w * (SELECT lvl FROM l WHERE lvl <= most / w ORDER BY most / w, source LIMIT 1), most::DOUBLE) AS target
            FROM l
        ), r AS (
            SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
                   row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS place,
                   ('0x' || substr(md5('mix-1|' || coalesce(d.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, ((floor(u + (place + 1) * e) - floor(u + place * e)) * size)::BIGINT AS taken
        FROM r
    """,
    "op12_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x
            FROM documents
        ), h AS (
            SELECT *, len(units) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
                   ('0x' || x[25:32])::BIGINT AS h4
            FROM d
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), p AS (
            SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix,
                   array_to_string(list_slice(units, a + 1, b), '') AS middle,
                   array_to_string(list_slice(units, b + 1, n), '') AS suffix
            FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}


def _lloyd_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Every part against every entry; components are integers held as doubles, so that all products are exact."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
            SELECT row_id, part, v, min((list_inner_product(v, v) - 2 * list_inner_product(v, e) + list_inner_product(e, e))::BIGINT
                                        * 256 + entry) AS found
            FROM p JOIN b{k} USING (part) GROUP BY ALL
        )""")
        if k < rounds:
            steps.append(f"""s{k} AS (
            SELECT part, found % 256 AS entry, place, sum(x) AS total, count(*) AS n
            FROM (SELECT part, found, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{k}) GROUP BY ALL
        ), m{k} AS (
            SELECT part, entry, list(floor(total / n) ORDER BY place) AS e FROM s{k} GROUP BY ALL
        ), b{k + 1} AS (
            SELECT part, entry, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (part, entry)
        )""")
    return f"""
        WITH d AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_id, vec_id, label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS whole
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), w AS (
            SELECT max(len(whole)) // 16 AS width FROM d
        ), p AS (
            SELECT row_id, part, whole[part * width + 1 : (part + 1) * width] AS v FROM d, w, (SELECT unnest(range(16)) AS part)
        ), b0 AS (
            SELECT part, row_id - 1 AS entry, v AS e FROM p WHERE row_id <= 64
        ), {", ".join(steps)}, r AS (
            SELECT row_id, string_agg(format('{{:02x}}', found % 256), '' ORDER BY part) AS code, sum(found // 256)::BIGINT AS error
            FROM a{rounds} GROUP BY row_id
        ), f AS (
            SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS x
            FROM b{rounds}
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, f.x AS codebooks_sha256
        FROM d JOIN r USING (row_id), f
    """


ORACLE["op11_vector_codes"] = _lloyd_sql()
