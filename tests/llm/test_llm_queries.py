"""The registered text-corpus queries: names, SQL where there is one, whole tables."""

import os
import re

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = sorted(int(m[1]) for n in queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in queries()


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n.startswith("op")))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF).toPandas(), db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_pipeline_packs_what_its_stages_keep(spark):
    from collections import Counter

    import corpus_pipeline as cp
    from paritylake.llm import packing
    from paritylake.llm.common import table

    docs = table(spark, SF, "documents")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: len(i) for r, i in zip(kept, packing.encode([r["text"] for r in kept], cp.tokenizer_path(), 1))}
    got = Counter()
    for r in cp.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want and len(want) > 20
