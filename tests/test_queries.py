"""Every query with an oracle equals it on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillgraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return f"{float(x):.8g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(map(repr, (tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_assigned_tree_equals_plain_loop(spark):
    from quillgraph.functions.scoring import SPAN_LIMITS
    from quillgraph.operators.orgchart import assign, pair_scores
    from quillgraph.plans.orgchart import members

    scored = pair_scores(members(spark, SF))
    got = {(r.manager_id, r.report_id) for r in assign(scored).collect()}
    tiers = [(85, "c_suite"), (75, "svp"), (65, "vp"), (55, "director"), (-999, "manager")]
    want, managed, used = set(), set(), {}
    for r in sorted(scored.collect(), key=lambda r: (r.company_id, r.domain, -round(r.confidence, 9), r.manager_id, r.report_id)):
        cap = SPAN_LIMITS[next(t for low, t in tiers if r.manager_seniority >= low)]
        if r.report_id not in managed and used.get(r.manager_id, 0) < cap:
            managed.add(r.report_id)
            used[r.manager_id] = used.get(r.manager_id, 0) + 1
            want.add((r.manager_id, r.report_id))
    assert got == want
