import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from faultline import session as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return S.pin(S.local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}))


FORBIDDEN = ("CartesianProduct", "NestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check_plan(df):
    plan = plan_of(df)
    for word in FORBIDDEN:
        assert word not in plan, f"{word} in plan:\n{plan[:3000]}"


@pytest.fixture()
def checked_cuts(monkeypatch):
    """Every intermediate table's plan is checked, not only the last one."""
    plain = S.cut

    def cut(df, label="cut"):
        check_plan(df)
        return plain(df, label)

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("faultline") and getattr(module, "cut", None) is plain:
            monkeypatch.setattr(module, "cut", cut)
    return cut
