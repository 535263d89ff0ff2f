import pytest

from tickersieve.checks.compare import connect, differences
from tickersieve.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLE[name], connect(sf_dir)) == []
