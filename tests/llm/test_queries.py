import pytest

import corpus_pipeline
from lacuna.llm import queries
from lacuna.llm.common import staged
from tests.conftest import SF


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF)
    other = duck.execute(queries.ORACLE_SQL[name])
    at = [mine.columns.index(c[0]) for c in other.description]
    assert sorted(tuple(r[i] for i in at) for r in mine.collect()) == sorted(other.fetchall())


def test_join_begins_with_the_columns_of_its_sql(spark, duck):
    """By position, not by name: other columns follow those of the contract."""
    mine = queries.op5_partenum(spark, SF)
    other = duck.execute(queries.ORACLE_SQL["op5_partenum"])
    names = [c[0] for c in other.description]
    assert mine.columns == [*names, "n_links"]
    assert sorted(tuple(r)[: len(names)] for r in mine.collect()) == sorted(other.fetchall())


def test_pipeline_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= seen[1] == seen[2] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == seen[3] > 0


def test_pipeline_equals_its_stages(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert first == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
