"""Mixing of equal-sized documents against its SQL: budgets that are met exactly before the last level."""

import duckdb
import pytest
from barloom.llm import mixing

SIZES = {
    "two equal": [(i, "w " * 7, "a") for i in range(2)],
    "many equal": [(i, "w " * 3, "abc"[i % 3]) for i in range(600)],
    "few a source": [(i, "w " * (1 + i % 2), f"s{i // 4}") for i in range(40)],
    "with empty": [(i, "w " * 4 if i % 5 else "", "a") for i in range(50)],
}


@pytest.mark.parametrize("case", SIZES)
def test_exact_budgets_equal_the_sql(spark, case):
    documents = spark.createDataFrame(SIZES[case], "doc_id long, text string, source string").toPandas()
    with duckdb.connect() as db:
        db.register("documents", documents)
        want = {r[0]: r[4] for r in db.sql(mixing.ORACLE).fetchall()}
    docs = spark.createDataFrame(SIZES[case], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert {r.doc_id: r.taken for r in got} == want
    if case == "two equal":
        assert sum(r.taken for r in got) == 21 and mixing.mix_rows(docs).count() == 3
