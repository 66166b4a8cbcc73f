"""The registered queries against SQL, the entry point's guard, the pipeline."""

import hashlib
import os
import subprocess
import sys
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import toxicity
from logloom.llm.common import read, written
from logloom.llm.queries import REGISTRY
from tests.conftest import ROOT, SF_SMALL
from tests.llm.conftest import rows_of
from tests.llm.test_dedup import near_brute
from tools.compare import digest


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in REGISTRY.items() if sql))
def test_query_matches_sql(spark, name):
    fn, sql = REGISTRY[name]
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df, rel = fn(spark, SF_SMALL), con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(rel.columns, rel.fetchall())


def test_entry_lists_all_queries_and_imports_without_them(tmp_path):
    import __spark_entry__ as e

    names = [k for k in e.queries() if k.startswith("op") and k[2].isdigit()]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in e.queries()
    for part in os.listdir(ROOT):
        if part not in ("corpus_pipeline.py", "logloom", ".git"):
            (tmp_path / part).symlink_to(f"{ROOT}/{part}")
    (tmp_path / "logloom").mkdir()
    for part in os.listdir(f"{ROOT}/logloom"):
        if part != "llm":
            (tmp_path / "logloom" / part).symlink_to(f"{ROOT}/logloom/{part}")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"],
                         cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
    assert run.stdout.split()[-1] == "False"


def test_every_stage_keeps_columns_and_rows_it_should(spark):
    """Each stage against a plain version on its own input."""
    docs = read(spark, SF_SMALL, "documents")
    labels = read(spark, SF_SMALL, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)

    one = written(stage["toxicity"](spark, docs, SF_SMALL), "t1")
    said = {r.doc_id: r.predicted for r in toxicity.toxicity_report(docs, labels).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(k for k, p in said.items() if not p)

    two = written(stage["exact_dedup"](spark, one, SF_SMALL), "t2")
    last = {}
    for r in one.collect():
        key = (r.text or "").encode().lower()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(last.values())

    three = written(stage["minhash_near_dedup"](spark, two, SF_SMALL), "t3")
    kept = {k for k, _, _, keep in near_brute([(r.doc_id, r.text) for r in two.collect()]) if keep}
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == sorted(kept)

    four = written(stage["mixing"](spark, three, SF_SMALL), "t4")
    n = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert four.columns == docs.columns and n(four) <= 1.5 * n(three) and n(four) > 1.4 * n(three)
    assert four.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2

    five = stage["best_fit_packing"](spark, four, SF_SMALL)
    assert five.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert five.filter("piece = 0").count() == four.count()


def test_pipeline_query_equals_its_stages(spark):
    docs = read(spark, SF_SMALL, "documents")
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, SF_SMALL), f"p-{name}")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(docs.select(*cols)) == rows_of(corpus_pipeline.run(spark, SF_SMALL).select(*cols))


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, odd_docs, SF_SMALL).columns == odd_docs.columns, name
        assert f(spark, no_docs, SF_SMALL).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SF_SMALL).collect() == []


def test_digests_are_of_normalised_texts(spark):
    got = REGISTRY["op3_exact_dedup"][0](spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text for r in read(spark, SF_SMALL, "documents").collect()}
    assert all(r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode().lower()).hexdigest() for r in got)
    assert zlib.crc32(b"") == 0
