"""The pipeline's stages on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from circuitscope.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES} and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    parts = {"en": "the ing tion and er wh sh ly".split(), "de": "sch ung keit ü ein ver lich zu".split()}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(2, 4))) for _ in range(n))
    rows, labels = [], []
    for k in range(400):
        lang = ("en", "de")[k % 2]
        words = text(lang, rng.randint(60, 150)).split()
        if k % 5 == 0:
            words[3] = rng.choice(["vileword", "nastyone"])
        rows.append((k, " ".join(words), lang, "s"))
        labels.append((k, 1, int(k % 5 == 0)))
    near = rows[1][1].split()
    near[50] = "changed"
    rows += [(600, rows[1][1], "en", "s"), (601, " ".join(near), "en", "s"), (700, "123 456", None, None), (701, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, left, str(tmp_path)).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in left.select("doc_id").collect()})
        if name != "best_fit_packing":
            assert left.schema == docs.schema
    toxic = {k for k in range(400) if k % 5 == 0}
    assert len(ids[0] & toxic) <= 4 and len({r[0] for r in rows} - toxic - ids[0]) <= 4
    assert ids[1] == ids[0] - {700, 701}
    assert ids[2] == ids[1] - {600, 601}
    assert ids[3] == ids[2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == ids[3]


def test_odd_rows_and_columns(spark, tmp_path):
    text = " ".join(f"the word{k % 50} of it" for k in range(40))
    rows = [(k, f"{text} number{k} and{k} more{k} words{k} here{k} " * 2, "en") for k in range(30)]
    odd = [(None, text, "en"), (None, None, None), (3, rows[3][1], "en"), (3, "another text of a repeated id " + text, None), (500, "", None), (501, None, "en"), (502, "5 6 7", "en"),
           (503, "long words of a text " * 60_000, "en"), (504, "long words of a text " * 60_000, "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    for name in ("rep", "key", "fp", "score", "n_tokens", "__text", "component_id"):  # names that the operators use themselves
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (39, 35, None, None)):
        left = stage(spark, left, str(tmp_path))
        if want:
            assert left.count() == want and left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id", "piece").where("piece = 0").collect()]
    assert 503 in ids and 504 not in ids and None in ids and not {500, 501, 502} & set(ids)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
