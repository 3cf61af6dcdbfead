"""Every named query of the library beside its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gavel.plans.oracle import oracle
from gavel.plans.queries import COVERS, QUERIES

SQL = oracle()


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def in_order(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, tables, name):
    frame = QUERIES[name](spark, sf)
    want = tables.sql(SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert in_order(map(tuple, frame.collect()), frame.columns) == in_order(want.fetchall(), want.columns)


def test_queries_without_sql_are_the_trained_models():
    assert set(COVERS) - set(SQL) == {
        "sequence_model_scores", "anomaly_model_scores", "text_model_classes", "trained_scorers_report"
    }


def test_model_queries_score_what_they_were_not_fitted_on(spark, sf):
    from gavel.operators.evaluate import roc_auc
    from gavel.plans.queries import _split_documents, _train_rows

    held_out = {r["event_id"] for r in _train_rows(spark, sf).filter("split = 'validation'").select("event_id").collect()}
    scored = QUERIES["sequence_model_scores"](spark, sf)
    assert {r["event_id"] for r in scored.select("event_id").collect()} == held_out and len(held_out) == 200
    assert roc_auc(scored, "lstm_score", scored["y"]).first()["roc_auc"] > 0.9
    fit, rest = _split_documents(spark, sf)
    assert fit.count() > rest.count() > 0 and not fit.join(rest, "document_id").count()
    assert QUERIES["text_model_classes"](spark, sf).count() == rest.count()
