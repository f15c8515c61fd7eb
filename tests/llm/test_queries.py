import os

import pytest

import __spark_entry__ as entry
from skein.llm import queries
from tests.test_entry import DIR, against_sql


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run_and_match_their_sql(spark, name):
    against_sql(spark, name)


def test_required_columns(spark):
    want = {"p1_found": ["vec_id", "group_vec_id"], "p4_found": ["qid_a", "qid_b"], "p5_found": ["vec_id_a", "vec_id_b"], "p6_found": ["cluster_id_a", "cluster_id_b"], "p9_found": ["doc_id"]}
    if os.path.isdir(DIR):
        for name, cols in want.items():
            assert entry.queries()[name](spark, DIR).dtypes == [(c, "bigint") for c in cols]
        assert entry.queries()["p7_ids"](spark, DIR).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
