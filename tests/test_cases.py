"""Operators on small tables against rows set down by hand."""

import pytest

from tests.literal_cases import CASES


@pytest.mark.parametrize("name", list(CASES))
def test_case(spark, name):
    f, names, rows = CASES[name]
    got = f(spark)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted(rows, key=repr)
