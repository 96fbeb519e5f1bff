"""One registered query per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Integer parts of the mixture; all other sources together get the part of "*".
MIX_TARGETS = {"src0": 10, "src1": 6, "src2": 6, "src3": 4, "src4": 4, "src5": 2, "src6": 2, "src7": 1, "*": 13}


def tokenizer_path() -> str:
    """Where the public tokenizer's file is on the driver."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.bpe import encode_decode

    return token_digests(encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path()))


def token_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.pagetext import page_texts

    return page_texts(_table(spark, sf_dir, "pages"))


def op4_legacy_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.warc import legacy_to_warc

    return legacy_to_warc(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.exactdup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"), hash_all=True)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.mixing import mixed_files

    rows = mixed_files(_table(spark, sf_dir, "documents"), MIX_TARGETS)
    return rows.select("doc_id", "source", "mix_class", "mix_block", "mix_slot", "mix_position")


def op8_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.packing import packed_files

    rows = packed_files(_table(spark, sf_dir, "documents"), tokenizer_path())
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "position_ids")]
    return rows.select("window", "row", "n_tokens", "cu_seqlens", "doc_ids", "doc_offsets", *digests)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op11_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferry.llm.periodic import periodic_runs, planted, strongest

    found = periodic_runs(_table(spark, sf_dir, "documents"), rewrite=planted).withColumn("best", strongest("runs"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_grammar": op1_toxicity_grammar,
    "op2_bpe_encode_decode": op2_bpe_encode_decode,
    "op3_page_text": op3_page_text,
    "op4_legacy_to_warc": op4_legacy_to_warc,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_packed_tokens": op8_packed_tokens,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_simhash_bk_trees": op11_simhash_bk_trees,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

_EQUAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FIVES = ", ".join(f"CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER)" for i in range(8))
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[{i}] >> {shift}) & 31 AS INTEGER) + 1, 1)" for i in range(1, 9) for shift in (15, 10, 5, 0)
)

_SHARE = "1 + (1000000000::HUGEINT * ({c} + 5)) // ({n} + 5 * {v})"
_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_EQUAL}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
s AS (SELECT lang, source, term, n, v, sum(n) OVER (PARTITION BY lang, source) AS total,
    sum(n) OVER (PARTITION BY lang, term) AS m, sum(n) OVER (PARTITION BY lang) AS whole FROM c JOIN v USING (lang)),
p AS (SELECT lang, source, term, n, {_SHARE.format(c="n", n="total", v="v")} AS p, {_SHARE.format(c="m", n="whole", v="v")} AS q FROM s),
pairs AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
found AS (
    SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op12_source_divergence": _DIVERGENCE,
    "op4_legacy_to_warc": (
        "WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), "
        f"v AS (SELECT page_id, payload_bytes, h, [{_FIVES}] AS v, max(page_id) OVER (PARTITION BY h) AS head FROM t) "
        f"SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, "
        "CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, "
        "CASE WHEN page_id <> head THEN head END AS refers_to FROM v"
    ),
    "op6_exact_dedup": (
        f"WITH t AS (SELECT doc_id, sha256({_EQUAL}) AS text_sha256 FROM documents), "
        "g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256) "
        "SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"
    ),
}
