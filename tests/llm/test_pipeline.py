"""The pipeline's stages and the registered queries of the subpackage against their oracles."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from cuefold.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, FOLDER)
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    want = sorted(tuple(map(repr, (dict(zip(columns, r))[c] for c in df.columns))) for r in rel.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(map(repr, r)) for r in df.collect()) == want


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    verdicts = {
        "quality_rules": lambda d: {r.doc_id for r in corpus_pipeline.host_quality(d).where("kept").select("doc_id").collect()},
        "near_dedup": lambda d: {r.doc_id for r in corpus_pipeline.near_duplicates(d).where("kept").select("doc_id").collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = verdicts[name](docs) if name in verdicts else None
        docs = corpus_pipeline.durable(stage(spark, docs, FOLDER))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= kept and (want is None or now == want)
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept
    assert corpus_pipeline.STAGES[-1][0] == "packing" and kept


@pytest.mark.parametrize("written", [True, False])
def test_rows_are_judged_one_by_one_whatever_their_ids(spark, written):
    """Null ids are rejected like others; of rows that repeat an id only the bad one goes; copies leave one."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    good = " ".join(f"plain{i} words{i}" for i in range(40))
    other = " ".join(f"further{i} text{i}" for i in range(40))
    rows = [(None, item * 3, "en", "s"), (5, item * 3, "en", "s"), (5, good, "en", "s"), (None, good, "en", "s"), (None, "", "en", "s"), (7, None, None, None), (3, other, "en", "s"), (3, other, "en", "s")]
    docs = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __gone string").repartition(3)
    docs = corpus_pipeline.durable(docs) if written else docs
    left = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, docs, FOLDER).collect()), key=repr)
    want = lambda keep: sorted(((i, t) for i, t, _, _ in rows if keep(t)), key=repr)
    assert left(corpus_pipeline.decontamination) == want(lambda t: t is None or item not in t)
    assert left(corpus_pipeline.quality_rules) == want(lambda t: t in (good, other))
    deduped = left(corpus_pipeline.near_dedup)
    assert deduped == sorted([(5, item * 3), (5, good), (None, ""), (7, None), (3, other)], key=repr)
    assert left(corpus_pipeline.language_id) is not None and corpus_pipeline.near_dedup(spark, docs.limit(0), FOLDER).count() == 0


def test_stages_hand_texts_to_workers_in_small_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    try:
        for given, wanted in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(name, given)
            corpus_pipeline.packing(spark, docs, str(tmp_path))
            assert spark.conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)
