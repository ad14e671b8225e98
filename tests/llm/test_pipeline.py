"""The pipeline's stages on the smallest tables and on corner cases."""

from collections import Counter

import pyarrow as pa

import corpus_pipeline
import __spark_entry__

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).persist()
        counts.append(docs.count())
        if name != names[-1]:
            assert docs.columns == columns
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    assert 200 > counts[0] > counts[1] == counts[2]
    assert sum(r["length"] for r in docs.collect()) > 0
    found = Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).drop("sequence_id", "offset").collect()))
    assert found == Counter(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_corner_cases(spark, corner, empty):
    for start in (corner, empty):
        docs = start.withColumn("n_chars", corner["n"].cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, FOLDER)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        docs.collect()


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 14))


def test_stages_read_small_arrow_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(spark, docs, folder):
        def count(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        return docs.mapInArrow(count, "n long")

    try:
        stage = corpus_pipeline._in_small_batches(sizes)
        rows = spark.range(0, 3000, 1, 1)
        spark.conf.set(name, 10000)
        # The rows are read after the stage has returned.
        assert [r["n"] for r in stage(spark, rows, FOLDER).collect()] == [1000] * 3
        spark.conf.set(name, 500)
        assert [r["n"] for r in stage(spark, rows, FOLDER).collect()] == [500] * 6
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.set(name, before)
