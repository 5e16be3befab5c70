"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, embeddings, fim, langid, licenses, packing, periodic, pfor, quality, sharding, simhash, toxicity
from .common import materialize, read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read_table(spark, sf_dir, "documents")).drop("spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("passages")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), digests_only=True)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.tokenize_and_read_back(read_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("""SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
                         (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)""")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = materialize(chat.format_conversations(rows), "chat")
    out = out.withColumn("formatted", chat.formatted_text()).withColumn("loss", chat.loss_text())
    turns = chat.read_turns(F.col("formatted"))
    newline = F.lit("\n")
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once, because packing reads the lengths twice
    return packing.pack(materialize(pfor.token_counts(read_table(spark, sf_dir, "documents")), "lengths"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"),
                        F.array_join(F.array_sort(F.array_distinct("findings.license")), ",").alias("licenses"),
                        F.array_join(F.flatten("findings.missing"), " ").alias("missing"), F.array_join(F.flatten("findings.added"), " ").alias("added"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(periodic.with_planted_runs(read_table(spark, sf_dir, "documents")))
    best = periodic.strongest()
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restore(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_tokens": op2_tokens,
    "op3_toxicity": op3_toxicity,
    "op4_chat": op4_chat,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_bpe": op8_bpe,
    "op9_langid": op9_langid,
    "op10_embeddings": op10_embeddings,
    "op11_runs": op11_runs,
    "op12_shards": op12_shards,
    "op13_fim": op13_fim,
}

def _sql_escaped_length(column: str) -> str:
    """Code points of an escaped text: one more for each backslash, two for each control string."""
    template = chat.Template()
    found = " + ".join(f"2 * (length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in template.controls)
    return f"length({column}) + length({column}) - length(replace({column}, '\\', '')) + {found}"


ORACLE_SQL: dict[str, str] = {
    "op4_chat": f"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum({sum(map(len, chat.Template().controls))} + {_sql_escaped_length('role')} + {_sql_escaped_length('text')}) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op13_fim": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        g AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                     CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
        p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
