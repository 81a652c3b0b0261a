"""The pipeline's stages against what their operators decide, and the queries registered."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from kithline.llm import decontaminate as contamination
from kithline.llm import quality_model, simhash, token_files, toxicity
from kithline.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for before, after in zip(seen[:4], seen[1:5], strict=True):
        assert after.columns == docs.columns
        assert after.exceptAll(before).count() == 0
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen[:5]]
    score = quality_model.score_quality(docs, quality_model.fit_quality(docs, labels))
    assert ids[1] == {r[0] for r in score.filter(F.col("out.score") >= corpus_pipeline.LEAST_QUALITY).select("row.doc_id").collect()}
    toxic = toxicity.score_toxicity(seen[1], toxicity.fit_toxicity(docs, labels))
    assert ids[2] == {r[0] for r in toxic.filter(F.col("out.p_toxic") < toxicity.TOXIC).select("row.doc_id").collect()}
    assert ids[3] == {r["component_id"] for r in simhash.near_duplicates(seen[2]).collect()}
    found = contamination.find_contamination(seen[3], bench)
    assert ids[4] == {r[0] for r in found.filter(~contamination.is_contaminated()).select("row.doc_id").collect()}
    packed = seen[5].select(F.explode(F.arrays_zip("doc_ids", "piece_tokens")).alias("p"), "capacity")
    got = {r["d"]: r["n"] for r in packed.groupBy(F.col("p.doc_ids").alias("d")).agg(F.sum("p.piece_tokens").alias("n")).collect()}
    tokens = {r["doc_id"]: len(r["ids"]) // 2 for r in token_files.encoded(seen[4], tokenizer_path(), added=True).select("row.doc_id", "out.ids").collect()}
    assert got == tokens
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = {k for k in ids[0] if quality.get(k) == 1}
    assert len(good - ids[1]) <= 0.02 * len(good)


def test_quality_stage_keeps_what_op7_keeps(spark, monkeypatch):
    """Scores between 0.5 and op7's threshold are rejected as well."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = F.struct((F.pmod("doc_id", F.lit(101)) / 100.0).alias("score")).alias("out")
    monkeypatch.setattr(quality_model, "fit_quality", lambda *a: None)
    monkeypatch.setattr(quality_model, "score_quality", lambda d, m, keep=None: d.select(F.struct(*[c for c in d.columns if keep is None or c in keep]).alias("row"), scores))
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    want = {r["doc_id"] for r in QUERIES["op7_quality_model"](spark, SF).filter("predicted = 1").collect()}
    assert kept == want and len(kept) < docs.count()


def test_stages_on_empty_and_wide_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.limit(20).withColumns({"out": F.lit("x"), "row": F.lit(1), "score": F.lit(0.1), "component_id": F.lit(None).cast("long"), "fp": F.lit("f")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        got = stage(spark, wide, SF)
        assert got.count() > 0
        assert k == 4 or got.columns == wide.columns


def test_run_leaves_one_stage(spark, monkeypatch):
    """Of what the stages write only the last one's input stays."""
    from pathlib import Path

    from kithline.llm.common import shared_dir

    same = lambda s, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), same) for k in range(5)])
    folder = Path(shared_dir(spark).removeprefix("file:")) / "kithline"
    stages = lambda: {p.name for p in folder.glob("stage*")}
    before = stages()
    got = corpus_pipeline.run(spark, SF)
    assert {name.split("-")[0] for name in stages() - before} == {"stage3"}
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_texts_are_not_sorted_to_keep_one(spark):
    """Rows are kept where they lie; only rows that repeat an id with its text are numbered."""
    docs = spark.createDataFrame([(k, f"own text {k} of {k * k} words") for k in range(30)] + [(None, "no id at all here")], "doc_id long, text string")
    found = simhash.keep_one(docs)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort" not in plan
    rows = sorted(map(tuple, docs.collect()), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == rows
    twice = docs.union(docs.filter("doc_id % 3 = 0 or doc_id is null"))
    assert sorted(map(tuple, simhash.keep_one(twice).collect()), key=str) == rows


def test_kept_rows_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 3)
    docs = spark.createDataFrame([(k // 2 if k < 40 else None, f"own text {k // 2} of {k // 2 * 7} words") for k in range(44)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=str) == sorted({tuple(r) for r in docs.collect()}, key=str)


def test_written_row_groups_are_small(spark, tmp_path):
    """A task of the next stage holds a row group on the heap, beside the one that it writes."""
    import pyarrow.parquet as pq

    from kithline.llm.common import ROW_GROUP_BYTES, written

    text = F.concat(*[F.sha2((F.col("id") * 32 + j).cast("string"), 256) for j in range(32)])
    written(spark.range(25_000).select("id", text.alias("text")).coalesce(1), "", f"{tmp_path}/texts")
    sizes = [m.row_group(i).total_byte_size for f in tmp_path.glob("texts/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(sizes) > 3 * ROW_GROUP_BYTES and max(sizes) < 2 * ROW_GROUP_BYTES  # before: one row group
