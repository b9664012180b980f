"""Queries over images against their SQL where several vectors share an id, as from 100,000 vectors on."""

import duckdb
import pytest
from test_queries import plain

import __spark_entry__ as entry

NAMES = (
    "best_variant",
    "image_cache_hits",
    "image_cache_states",
    "image_cache_renewed",
    "perceptual_text",
    "plan_similar_refusals",
    "similar_groups_after",
    "similar_status",
    "similar_verdicts",
)


@pytest.fixture(scope="module")
def shared(small, tmp_path_factory):
    """Half of the vectors have the ids that near copies of the others get."""
    folder = tmp_path_factory.mktemp("shared")
    ids = "vec_id % 250 + vec_id // 250 * 100000 as vec_id"
    duckdb.sql(f"copy (select {ids}, embedding, label from '{small}/embeddings.parquet') to '{folder}/embeddings.parquet'")
    return str(folder)


def untied(column, value):
    """Forms of one variant have no order in the SQL where images share an id."""
    return ";".join(sorted(value.split(";"))) if column == "text" else value


@pytest.mark.parametrize("name", NAMES)
def test_shared_ids_equal_sql(name, spark, shared):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{shared}/embeddings.parquet'")
    found, result = entry.queries()[name](spark, shared), duck.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    mine = sorted(tuple(untied(c, plain(x[c])) for c in columns) for x in found.collect())
    theirs = sorted(tuple(untied(c, plain(v)) for c, v in zip(columns, x)) for x in result.select(*[f'"{c}"' for c in columns]).fetchall())
    assert mine == theirs
