"""Every registered query on empty tables, and on few rows with nulls in every column and repeats."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wayloom.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        pq.write_table(pq.read_table(f"{SOURCE}/{t}.parquet").slice(0, 0), folder / f"{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """40 rows, three of them twice, one of nulls only, and for every column one row that lacks it."""
    folder = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        rows = pq.read_table(f"{SOURCE}/{t}.parquet").slice(0, 40)
        extra = [{**rows.slice(i % rows.num_rows, 1).to_pylist()[0], c: None} for i, c in enumerate(rows.column_names)] + [dict.fromkeys(rows.column_names)]
        pq.write_table(pa.concat_tables([rows, rows.slice(0, 3), pa.Table.from_pylist(extra, schema=rows.schema)]), folder / f"{t}.parquet")
    return str(folder)


def _fails(spark, folder, names):
    failed = {}
    for name in names:
        try:
            registry.queries()[name](spark, folder).collect()
        except Exception as e:  # all names are reported together
            failed[name] = str(e).split("\n")[0][:200]
    return failed


def test_empty_tables(spark, empty):
    assert _fails(spark, empty, registry.queries()) == {}


def test_nulls_and_repeats(spark, odd):
    # hut_days takes a round of jobs for each day; its own test has odd rows
    assert _fails(spark, odd, [n for n in registry.queries() if n != "hut_days"]) == {}
