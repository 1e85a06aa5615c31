import pytest

from sediment import catalog

from .oracle import duck, rows_of, rows_of_sql

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got, names = rows_of(catalog.queries()[name](spark, SF))
    want, columns = rows_of_sql(con, catalog.oracle_sql()[name])
    assert names == columns
    assert len(got) == len(want)
    assert got == want


def test_goal_preferences_read_all_sessions(spark):
    """No SQL: the operator has a plain version in test_goals; here the query's table is held against it."""
    from sediment.plans.session_queries import SAYINGS, goal_sessions

    from . import test_goals as plain

    known = {v: k for k, v in plain.SAYINGS.items()}
    assert set(SAYINGS) <= set(known)
    rows = sorted((r["session"], r["position"], known.get(r["text"])) for r in goal_sessions(spark, SF).filter("role = 'user'").collect())
    want = {}
    for session in {s for s, _, _ in rows}:
        turns = [(p, n) for s, p, n in rows if s == session]
        if all(n is not None for _, n in turns) and (got := plain.plain_version([n for _, n in turns])):
            want[session] = got[0], ",".join(str(turns[i][0]) for i in got[1])
    got = {r["session"]: (r["kind"], r["supports"]) for r in catalog.queries()["goal_preferences"](spark, SF).collect()}
    assert got == want and len(want) >= 3
