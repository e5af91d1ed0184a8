"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from quirecheck.plans import all_queries
from tests.support import compare, database, session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engines():
    return session(), database(SF_DIR)


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_query(engines, key):
    spark, con = engines
    q = all_queries()[key]
    if q.oracle is None:
        assert q.build(spark, SF_DIR).columns
        return
    difference, _, _ = compare(q.build(spark, SF_DIR), con, q.oracle)
    assert difference == ""


@pytest.mark.parametrize("key", ["occurrence", "cmp_align", "query_medicine", "journal_pending"])
def test_partitions_do_not_matter(engines, key):
    spark, _ = engines
    q = all_queries()[key]

    def rows(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return sorted(map(repr, q.build(spark, SF_DIR).collect()))

    try:
        assert rows(1) == rows(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
