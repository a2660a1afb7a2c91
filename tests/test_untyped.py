"""Values compared whatever their kinds, and the hook for an exact path."""

import pytest

from inkwell.operators.filters import untyped_equal
from inkwell.sources.markdown import project_id_from_exact_path


def test_untyped_values(spark):
    texts = ['{"k": 1}', '{"k": 1.0}', '{"k": true}', '{"k": "1"}', '{"k": null}', "{}", '{"k": [1]}', '{"k": 0}', '{"k": false}', '{"k": 9007199254740993}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, j string")
    found = lambda v: {r[0] for r in rows.filter(untyped_equal("j", "k", v)).select("n").collect()}
    assert found(1) == found(1.0) == found(True) == {0, 1, 2}
    assert found("1") == {3} and found(0) == found(False) == {7, 8}
    assert found(9007199254740993) == {9} and found(9007199254740992) == set()
    for bad in (None, [1], float("nan")):
        with pytest.raises(ValueError):
            untyped_equal("j", "k", bad)
    with pytest.raises(ValueError):
        untyped_equal("j", "a b", 1)


@pytest.mark.parametrize(("path", "before", "after"), [
    ("projects/atlas/a.md", {}, "atlas"), ("projects/atlas/a.md", {"project_id": None}, "atlas"), ("projects/atlas/a.md", {"project_id": ""}, ""), ("projects/atlas/a.md", {"project_id": False}, False),
    ("projects/a.md", {}, None), ("projects/atlas/deep/a.md", {}, None), ("x/projects/atlas/a.md", {}, None), ("projects/../a.md", {}, None), ("projects//a.md", {}, None),
])
def test_hook(path, before, after):
    assert project_id_from_exact_path(path, before) is None and before.get("project_id") == after
