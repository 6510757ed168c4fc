"""The pipeline's stages one by one, against SQL and brute force."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from cohortlens.llm import queries_filters, queries_pairs, queries_text
from cohortlens.llm import sentencepiece_sampling as sampling

from . import tables

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], SF_DIR)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def kept_by_sql(before, sql):
    """The rows of a stage's input that SQL keeps."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF_DIR}/benchmark.parquet'")
    con.register("docs", before.toPandas())
    return sorted(con.execute(sql).fetchall(), key=str)


COLUMNS = "d.doc_id, d.text, d.lang, d.source, d.n_chars"


def test_stages_match_sql(stages):
    quality = queries_filters.QUALITY_SQL.format(docs="docs")
    lines = queries_filters.LINES_SQL.format(docs="docs")
    groups = queries_pairs.GROUPS_SQL.format(docs="docs")
    hits = queries_text.CONTAMINATION_SQL.format(docs="docs")
    wanted = [
        f"SELECT {COLUMNS} FROM docs d JOIN ({quality}) q ON q.doc_id = d.doc_id WHERE kept",
        f"SELECT d.doc_id, kept_text, d.lang, d.source, length(kept_text) FROM docs d JOIN ({lines}) l ON l.doc_id = d.doc_id",
        f"SELECT {COLUMNS} FROM docs d JOIN ({groups}) g ON g.doc_id = d.doc_id WHERE component_id = d.doc_id",
        f"SELECT {COLUMNS} FROM docs d JOIN ({hits}) h ON h.doc_id = d.doc_id WHERE NOT contaminated",
    ]
    for before, after, sql in zip(stages[:-2], stages[1:-1], wanted, strict=True):
        assert after.columns == before.columns
        assert rows_of(after) == kept_by_sql(before, sql)


def test_last_stage_decodes_to_its_texts(spark, stages):
    import hashlib
    docs, out = stages[-2], stages[-1]
    digest = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {(r.doc_id, r.text_sha256) for r in out.collect()} == set(digest.items())
    pieces = {(r.doc_id, r["sample"]): hashlib.sha256(r.pieces).hexdigest()
              for r in sampling.encode(docs, samples=2).collect()}
    assert {(r.doc_id, r["sample"]): r.pieces_sha256 for r in out.collect()} == pieces


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(
        map(tuple, stages[-1].collect()))


@pytest.mark.parametrize("rows", [[], tables.odd_pairs()])
def test_stages_take_odd_rows(spark, rows):
    docs = tables.docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= docs.count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
