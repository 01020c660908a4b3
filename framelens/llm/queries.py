"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.quality import held_out, scored, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.lm import language_model

    return language_model(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.suffix import repeated_spans

    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("froms").cast("long").alias("n_spans"), "kept_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.wrappers import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelens.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _containment_sql(items: str, word: str) -> str:
    """The verified pairs by comparing all shingles: ``items`` is a relation (item, text)."""
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{word}') AS w FROM documents),
        s AS (
            SELECT r, doc_id, p, array_to_string(w[p : p + 4], ' ') AS s
            FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
        i AS (SELECT item, regexp_extract_all({_LOWER}, '{word}') AS w FROM ({items})),
        t AS (
            SELECT DISTINCT item, array_to_string(w[p : p + 4], ' ') AS s
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
        n AS (SELECT item, count(*) AS n_shingles FROM t GROUP BY item),
        hits AS (
            SELECT r, doc_id, item, n_shingles, count(DISTINCT s) AS n_shared, count(DISTINCT s) / n_shingles AS containment, min(p) - 1 AS first_word
            FROM s JOIN t USING (s) JOIN n USING (item) GROUP BY r, doc_id, item, n_shingles
            HAVING count(DISTINCT s) >= 0.8 * n_shingles)
    """


def _license_sql() -> str:
    from framelens.llm.licenses import TEMPLATES

    rows = ", ".join("({}, '{}', '{}', '{}')".format(i, *(x.replace("'", "''") for x in t)) for i, t in enumerate(TEMPLATES))
    names = f"(VALUES {rows}) AS v(item, license, part, text)"
    return _containment_sql(f"SELECT * FROM {names}", "[^\\x00-/:-@\\[-`{-\\x7F]+") + f"""
        SELECT doc_id, license, part, item AS template, n_shingles, n_shared, containment, first_word, containment = max(containment) OVER (PARTITION BY r, first_word) AS best
        FROM hits JOIN (SELECT item, license, part FROM {names}) USING (item)
    """


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op9_decontamination": _containment_sql("SELECT item_id AS item, text FROM benchmark", "[^ \\t-\\r]+") + """
        SELECT doc_id, item AS item_id, n_shingles, n_shared, containment FROM hits
    """,
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER (PARTITION BY text_sha256, doc_id ORDER BY doc_id) AS copy
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, text_sha256 FROM g
    """,
}
