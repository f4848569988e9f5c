"""The jobs: growing input, repeated runs, settings and their command line."""

import json
import logging
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import brick_demand, common, corpus_volume
from jobs.registry import ORACLES, QUERIES
from voxelspark.sources import store

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tables(db, folder, *names):
    for n in names:
        db.execute(f"create or replace view {n} as select * from '{folder}/{n}.parquet'")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_oracle(spark, name):
    db = duckdb.connect()
    tables(db, SF, "supplier", "events", "nation", "documents")
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(*columns)) == sorted(want.fetchall(), key=repr)


def volume_oracle(documents):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{documents}/*.parquet')")
    return sorted(db.execute(ORACLES["job2_corpus_volume"]).fetchall(), key=repr)


def test_stream_takes_only_what_is_new(spark, tmp_path, caplog):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = str(tmp_path / "documents")
    config = {"documents": source, "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check"), "files_per_batch": 1}
    docs.filter("doc_id < 120").coalesce(1).write.parquet(source)
    with caplog.at_level(logging.INFO, "jobs"):
        assert rows(corpus_volume.run(spark, config)) == volume_oracle(source)
    assert "batch 0: read 120 documents" in caplog.text and "120 documents in all" in caplog.text
    caplog.clear()
    docs.filter("doc_id >= 120").repartition(2).write.mode("append").parquet(source)
    odd = [(None, None, None, None, None), (1, "", "en", "web", 0), (1, " \n", None, None, 3), (2, "word " * 100_000, "xx", "web", 5)]
    spark.createDataFrame(odd, corpus_volume.DOCUMENTS).coalesce(1).write.mode("append").parquet(source)
    with caplog.at_level(logging.INFO, "jobs"):
        grown = rows(corpus_volume.run(spark, config))
    assert grown == volume_oracle(source)
    assert "batch 0:" not in caplog.text and "batch 1:" in caplog.text and "batch 3:" in caplog.text
    counts = spark.read.parquet(f"{config['output']}/counts")
    assert counts.agg(F.sum("n")).first()[0] == docs.count() + len(odd)
    caplog.clear()
    with caplog.at_level(logging.INFO, "jobs"):
        assert rows(corpus_volume.run(spark, config)) == grown
    assert "batch 4" not in caplog.text and "0 batches, 204 documents in all" in caplog.text


def test_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], corpus_volume.DOCUMENTS).write.parquet(str(tmp_path / "documents"))
    config = {"documents": str(tmp_path / "documents"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check")}
    assert corpus_volume.run(spark, config).count() == 0


def test_ties_and_nulls_of_a_cell(spark):
    docs = spark.createDataFrame([(i, "a b", "en", s, 3) for i, s in enumerate(["b", "a", None, "", "a", "b"])], corpus_volume.DOCUMENTS)
    label = {r.source: r.l for r in docs.select("source", corpus_volume.label_of(F.col("source")).alias("l")).distinct().collect()}
    assert label[None] == label[""] != 0
    (cell,) = corpus_volume.majority(corpus_volume.counted(docs)).collect()
    assert cell.label == min(label["a"], label["b"], label[""])


def test_days_are_replaced_alone(spark, tmp_path):
    config = {"tables": SF, "output": str(tmp_path / "demand")}
    whole = rows(brick_demand.run(spark, config))
    days = sorted({r[5] for r in whole})
    assert len(days) > 1
    again = brick_demand.run(spark, config | {"days": days[:1]})
    assert rows(again) == whole
    only = {"tables": SF, "output": str(tmp_path / "one"), "days": days[:1]}
    assert rows(brick_demand.run(spark, only)) == [r for r in whole if r[5] == days[0]]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert before.upper() == "STATIC"


def test_settings(spark):
    with pytest.raises(ValueError, match="unknown settings: tabels"):
        common.settings({"tabels": 1}, {"tables": None})


def test_command_line(tmp_path):
    config = {"documents": f"{SF}/documents.parquet", "output": "replaced", "checkpoint": str(tmp_path / "check")}
    (tmp_path / "c.json").write_text(json.dumps(config))
    env = os.environ | {"PYTHONDONTWRITEBYTECODE": "1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, f"{HERE}/jobs/corpus_volume.py", "--config", str(tmp_path / "c.json"), f"output={tmp_path}/out"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read 200 documents" in done.stderr
    assert os.path.exists(tmp_path / "out" / "store" / "_SUCCESS")


def files_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_box_reads_a_part_of_the_store(spark, tmp_path):
    from voxelspark.operators import volume as V

    g = V.side(spark, SF)
    nodes = V.pyramid(V.to_bricks(V.segmentation(spark, SF), 8), 8)
    path = str(tmp_path / "store")
    store.write(nodes, path, 3)
    low, high = (3, 5, 9), (10, 6, 15)
    box = store.read_box(spark, path, low, high, 2, 8, 3)
    got = {(r.brick_id, r.m, r.label) for r in store.voxels(box, 8).collect()}
    code = lambda x, y, z: sum((c >> b & 1) << 3 * b + i for i, c in enumerate((x, y, z)) for b in range(7))
    meets = {code(x, y, z) for x in range(2) for y in range(1) for z in range(1, 2)}
    want = {(r.brick_id, r.m, r.label) for r in nodes.filter("lod = 2").collect() if r.brick_id in meets}
    assert got == want and g == 32
    assert files_read(store.read(spark, path)) == 4 * 8 and files_read(box) == 1
    back = {(r.brick_id, r.lod, r.m, r.label) for r in store.voxels(store.read(spark, path), 8).collect()}
    assert back == {(r.brick_id, r.lod, r.m, r.label) for r in nodes.collect()}
    assert store.covering((0, 0, 0), (3, 3, 3), 2) == [(0, 63)]
    cells = {c for a, b in store.covering((1, 2, 3), (5, 2, 6), 3, 4096) for c in range(a, b + 1)}
    assert cells == {code(x, y, z) for x in range(1, 6) for y in (2,) for z in range(3, 7)}
