"""Every registered query against its SQL, or for rows where it has none."""

import oracle
import pytest
from corpusmill.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


#: Thresholds that select nothing on the smallest tables.
MAY_BE_EMPTY = {"ngram_leakage", "paragraph_gate", "paragraph_passages", "contamination_by_context"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in registry.ORACLE_SQL:
        said = oracle.difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], sf_dir)
        assert said == "" or (said == "no rows" and name in MAY_BE_EMPTY)
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
