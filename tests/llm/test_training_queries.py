"""Every query over a whole small table, against its SQL where there is one; the pipeline against its operators' rules."""

import duckdb
import pytest

import corpus_pipeline
from siftline.llm import decontaminate
from siftline.llm.common import table
from siftline.llm.oracles import ORACLES
from siftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    sql = con.execute(ORACLES[name])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(sql.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_covers_every_document(spark, name):
    ids = [r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()]
    assert sorted(r.doc_id for r in QUERIES[name](spark, SF).collect()) == sorted(ids)


def test_pipeline_stages_keep_what_they_should(spark):
    docs = before = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == before.columns
        kept[name], docs = out.collect(), spark.createDataFrame(out.collect(), before.schema)
    clean = decontaminate.find_contamination(spark.createDataFrame(kept["decontamination"], before.schema), table(spark, SF, "benchmark"))
    assert clean.filter("found.n_hit > 0 and 20 * found.n_hit >= found.n_words").count() == 0
    assert len({r.doc_id for r in kept["simhash"]}) == len(kept["simhash"]) <= len(kept["toxicity"])
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in kept["mixing"])


def test_run_equals_the_stages(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and a.count() > 0
