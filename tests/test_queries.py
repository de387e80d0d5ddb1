from __future__ import annotations

import pytest

from quernstone import registry
from tests.oracle import assert_same, connect

ENTRIES = registry.CATALOG.entries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_equals_oracle(spark, sf_dir, duck, name):
    e = ENTRIES[name]
    df = e.build(spark, sf_dir)
    if e.oracle:
        assert_same(df, e.oracle, duck)
    else:
        df.count()


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.oracle))
def test_oracle_gives_rows(name):
    """At the scale at which results are compared, so that no query agrees by having none."""
    assert connect("/root/testdata/sf0.01").sql(ENTRIES[name].oracle).limit(1).fetchall()


def test_every_query_is_documented_by_what_it_covers():
    assert all(e.covers for e in ENTRIES.values())


@pytest.mark.parametrize("name", ["op_tx09_bm25_top_k", "op_jn12_symbol_diff", "op_wn02_thrashing", "op_gr11_expand"])
def test_partitioning_does_not_matter(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, ENTRIES[name].build(spark, sf_dir).collect())))
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_covers_claims_no_method_that_is_not_replicated():
    missing = {"BU04", "RE08", "SRC12", "RT05", "GR20", "SRC25", "SM10", "SM12", "RE09", "EX02", "EX03"}
    assert not missing & {c for e in ENTRIES.values() for c in e.covers}
