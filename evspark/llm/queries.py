"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import best_fit, bpe, chat, language_id, line_dedup, packing, quality, simhash, spelling, spotsigs, substring_dedup, vector_codes
from . import exact_dedup as ed
from .common import sha256_hex, table

#: File names of the public tokenizers in use; ``public_tokenizers.path`` gives their place.
TOKENIZER_FILE, RANK_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_FILE), token_pattern())
    return packing.with_checksums(pieces)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (~quality.learnable()).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.exact_dedup(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_path(RANK_FILE), token_pattern()
    return bpe.round_trip_documents(table(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join("ids", " ")).alias("ids_sha256"),
        sha256_hex(F.col("text")).alias("decoded_sha256"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.samples(spark))
    return chat.read_back(chat.render(chat.turns_as_log(turns)), in_order=True)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256_hex(F.col("kept")).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit_language_model(docs, language_id.learnable())
    found = language_id.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (~language_id.learnable()).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_FILE), token_pattern(), tokens=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_chat_format": op6_chat_format,
    "op7_suffix_array": op7_suffix_array,
    "op8_language_id": op8_language_id,
    "op9_simhash": op9_simhash,
    "op10_spotsigs": op10_spotsigs,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_best_fit": op13_best_fit,
}


def _vector_codes_sql(rounds: int = 6) -> str:
    """Rounds are written out one after the other: nearest entries (n), then means (c)."""
    ctes = [
        """kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """parts AS MATERIALIZED (
            SELECT vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS r(p))""",
        """c0 AS MATERIALIZED (
            SELECT p, e - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM parts) WHERE e <= 16)""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""n{r} AS MATERIALIZED (
            SELECT vec_id, p, min({{'d': list_sum(list_transform(list_zip(b.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.e}}) AS m
            FROM parts b JOIN c{r} c USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (
            WITH cells AS (SELECT p, m.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM parts JOIN n{r} USING (vec_id, p)),
            means AS (SELECT p, e, i, CAST(((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*)) AS BIGINT) AS y FROM cells GROUP BY p, e, i)
            SELECT p, e, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS x FROM means GROUP BY p, e) u USING (p, e))""")
    return f"""
        WITH {", ".join(ctes)},
        books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
        codes AS (
            SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM codes JOIN kept USING (vec_id), books"""


ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": _vector_codes_sql(),
    "op4_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
