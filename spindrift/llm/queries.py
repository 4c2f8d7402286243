"""The registered queries of the corpus operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, chaining, exact_dedup, jaccard, media, minmax, mixing, packing, periodic, pii, spelling, toxicity, warc
from .common import table

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
TOXIC_AT = 0.7


def op1_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chaining.fuzzy_passages(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("other_id", "other_doc_id")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.resolve_revisits(table(spark, sf_dir, "pages"))
    return warc.read_bundles(warc.write_bundles(records)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bwt.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def fitted_lexicon(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Lexicon:
    """Learned from the labels of training rows alone."""
    labels = table(spark, sf_dir, "labels").filter(toxicity.training_mask()).select("doc_id", "toxic")
    return toxicity.learn(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, fitted_lexicon(spark, sf_dir, docs))
    return scored.select("doc_id", (~toxicity.training_mask()).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), CAPACITY)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_features(media.encode_media(table(spark, sf_dir, "documents")))
    return found.withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_components(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), change=spelling.thinned)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_periods(table(spark, sf_dir, "documents"))
    found = periodic.periodic_runs(docs).withColumn("best", periodic.strongest(F.col("runs")))
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(periodic.run_list(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE_SQL: dict[str, str] = {
    "op3_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(encode(coalesce(html, ''))) AS h FROM pages),
        g AS (SELECT h, max(page_id) AS last FROM p GROUP BY 1)
        SELECT page_id, octet_length(raw) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (m // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (m % 4))::INT) & 31) + 1)::INT, 1) FOR m IN range(0, 32)], '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM p JOIN g USING (h)""",
    "op5_exact_dedup": r"""
        WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, count(*) AS group_size, max(n) AS best FROM k GROUP BY 1),
        w AS (SELECT k.text_sha256, min(k.doc_id) AS keep_id FROM k JOIN g ON k.text_sha256 = g.text_sha256 AND k.n = g.best GROUP BY 1)
        SELECT k.doc_id, w.keep_id, g.group_size, k.doc_id = w.keep_id AS kept, k.text_sha256
        FROM k JOIN g USING (text_sha256) JOIN w USING (text_sha256)""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
        u AS (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 3, 2))) AS i FROM w WHERE len(x) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(x[i:i + 4], ' ') AS g FROM u),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT i, j FROM p JOIN c x ON x.doc_id = i JOIN c y ON y.doc_id = j WHERE 100 * k >= 75 * (x.n + y.n - k)),
        e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.j FROM r JOIN e ON r.y = e.i)
        SELECT r.x AS doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN c ON c.doc_id = r.x GROUP BY r.x""",
}

_SIMILAR = ORACLE_SQL["op10_jaccard_join"].replace("75 * (x.n", "85 * (x.n")
ORACLE_SQL["op11_minmax"] = f"SELECT *, doc_id = component_id AS kept FROM ({_SIMILAR})"


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
