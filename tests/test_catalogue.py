import pytest

from basalt.plans import catalogue
from basalt.plans import artifacts as _artifacts  # noqa: F401  (these queries join the catalogue)
from basalt.plans import directories as _directories  # noqa: F401
from basalt.plans import ingesting as _ingesting  # noqa: F401
from basalt.plans import listings as _listings  # noqa: F401
from basalt.plans import policies as _policies  # noqa: F401
from basalt.plans import references as _references  # noqa: F401
from basalt.plans import searching as _searching  # noqa: F401


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_equals_its_sql(name, compare):
    compare(catalogue.QUERIES[name], catalogue.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)
