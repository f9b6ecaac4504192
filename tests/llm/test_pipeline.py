"""The pipeline against plain versions of its stages."""

import os
import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
from test_minhash import brute
from test_packing import valid
from tillroll.llm import quality, toxicity


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{folder}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "packing":
            valid(out.collect(), before, 2048)
            break
        assert out.columns == columns
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert 0 < len(after) < len(before)
        if name == "near_duplicates":
            assert after == {i for i, w in brute(before, 5).items() if w[2]}
        else:
            model = (toxicity if name == "toxicity" else quality).fit(docs, labels)
            scores = model.scores(pa.array([t for _, t in before]))
            keep = scores < 0.3 if name == "toxicity" else scores >= 0.5
            assert after == {i for (i, _), k in zip(before, keep, strict=True) if k}
        docs = out


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0


def test_odd_rows(spark, odd, odd_rows, none):
    """Every stage stands odd rows, clashing columns and an empty table, and keeps the columns."""
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, odd, "/root/testdata/sf0.001"), stage(spark, none, "/root/testdata/sf0.001")
        assert empty.count() == 0
        if name == "packing":
            valid(out.collect(), [r[:2] for r in odd_rows], 2048)
        else:
            assert out.dtypes == empty.dtypes == odd.dtypes
            assert {r["_first_k"] for r in out.collect()} <= {r["_first_k"] for r in odd.collect()}


CHILD = """
import os, sys, threading
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).config("spark.driver.memory", "3g").getOrCreate()
import corpus_pipeline
pieces = {}
def one(i):
    pieces[i] = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())
threads = [threading.Thread(target=one, args=(i,)) for i in range(2)]
[t.start() for t in threads]
[t.join() for t in threads]
assert pieces[0] == pieces[1] and len(pieces[0]) > 20, pieces
assert any(n.startswith("pipeline-") for n in os.listdir(sys.argv[1]))
spark.stop()
"""


def test_two_at_once_leave_nothing(tmp_path):
    """Two pipelines in threads of one driver both give their results, and the shared folder is empty when it ends."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", CHILD, str(tmp_path)], check=True, cwd=root, timeout=900, capture_output=True)
    # Spark makes an empty folder of its own there.
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []
    assert not any(n.startswith(("pipeline-", "cut-")) for n in os.listdir(tmp_path))
