"""Every registered query on the smallest tables: result against its SQL, and no pairwise join in any plan."""

import pytest

import __spark_entry__ as entry
import check
from conftest import check_plan

SF = "/root/testdata/sf0.001"
#: Queries of optional parts have tests of their own.
QUERIES = {k: f for k, f in entry.queries().items() if f.__module__.startswith("faultline.plans")}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.fixture(autouse=True, scope="module")
def shared_tables(spark):
    """Queries of one family differ in their last step; the tables before it are made once per run."""
    from functools import cache

    from faultline.operators import incidents
    from faultline.plans import chain, code, logs, retrieval
    from faultline.session import cut

    patch = pytest.MonkeyPatch()
    made: dict = {}
    for name in ("_clusters", "_profile_and_trends"):
        patch.setattr(logs, name, cache(getattr(logs, name)))
    for module, name in ((logs, "_trends"), (retrieval, "_ranked"), (retrieval, "_hits"), (code, "_units"), (code, "_files"),
                         (logs, "_facts")):
        plain = getattr(module, name)
        patch.setattr(module, name, cache(lambda s, sf, plain=plain: cut(plain(s, sf))))
    one = incidents.Incidents

    def incidents_of(log):
        """One run per log: equal plans over equal files are the same log."""
        key = log.semanticHash()
        if key not in made:
            made[key] = one(log)
        return made[key]

    patch.setattr(incidents, "Incidents", incidents_of)
    patch.setattr(chain, "_evidence", cache(chain._evidence))
    yield
    patch.undo()


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, checked_cuts, name):
    def built(s, sf):
        df = QUERIES[name](s, sf)
        check_plan(df)
        return df

    _, problem = check.compare(spark, con, SF, built, SQL.get(name))
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["namespace", "rank", "cluster_id"] and df.count() > 0
