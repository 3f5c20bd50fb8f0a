"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from millrace.plans import load
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    c = connect(os.environ.get("MILLRACE_TEST_DIR", FOLDER))
    yield c
    c.close()


@pytest.mark.parametrize("name", REGISTRY)
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, REGISTRY[name], os.environ.get("MILLRACE_TEST_DIR", FOLDER))
    assert ok, message


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_inventory_entry_has_a_query_or_a_test():
    covered = {i for q in REGISTRY.values() for i in q.ids}
    # Entries without a query of their own: adapters whose options are tested, and layout rules.
    elsewhere = {"S7", "S8", "S13", "S20", "S10", "S11", "S12", "S16", "S17", "K2", "K3", "K4", "K6", "K7"}
    groups = {"S": 20, "K": 16, "T": 30, "J": 8, "A": 10, "W": 9, "U": 5, "M": 5, "R": 31, "F": 32, "ST": 8}
    gaps = {"K": {10}, "A": {6}, "T": {16, 17, 18, 19}}
    wanted = {f"{g}{i}" for g, n in groups.items() for i in range(0 if g == "R" else 1, n + 1) if i not in gaps.get(g, ())}
    assert wanted - covered - elsewhere == set()
