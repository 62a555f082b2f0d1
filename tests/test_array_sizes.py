"""How many findings one JSON array holds."""

import json

import oracle
import pytest

from siftlake import plans
from siftlake.plans import paths
from siftlake.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [20, 20_000])
def test_arrays_are_bounded(spark, monkeypatch, rows):
    sizes, read = [], readers.read_json_lists

    def spy(session, path):
        sizes.extend(len(json.loads(r.value)) for r in session.read.text(path).collect() if r.value != "no array")
        return read(session, path)

    monkeypatch.setattr(paths.readers, "read_json_lists", spy)
    monkeypatch.setattr(paths, "_ARRAY_ROWS", rows)
    con = oracle.connect(SF)
    assert oracle.differences(spark, con, plans.QUERIES["findings_arrays"], plans.ORACLES["findings_arrays"], SF) == ""
    assert sum(sizes) == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    # parts are dealt out by a hash
    assert max(sizes) <= 3 * rows
