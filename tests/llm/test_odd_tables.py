"""Every corpus query on empty tables, and on few rows with nulls in every column and repeats."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wayloom.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")
SOURCE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_queries(spark, tmp_path, kind):
    import corpus_pipeline

    for t in TABLES:
        rows = pq.read_table(f"{SOURCE}/{t}.parquet").slice(0, 0 if kind == "empty" else 30)
        if kind == "odd":
            extra = [{**rows.slice(i, 1).to_pylist()[0], c: None} for i, c in enumerate(rows.column_names)] + [dict.fromkeys(rows.column_names)]
            rows = pa.concat_tables([rows, rows.slice(0, 3), pa.Table.from_pylist(extra, schema=rows.schema)])
        pq.write_table(rows, tmp_path / f"{t}.parquet")
    n = {t: pq.read_table(tmp_path / f"{t}.parquet").num_rows for t in TABLES}
    for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        got = query(spark, str(tmp_path)).collect()
        if name not in ("op7_decontaminate", "pipeline"):
            assert len(got) == n["pages" if name[:4] in ("op1_", "op6_") else "documents"], name
