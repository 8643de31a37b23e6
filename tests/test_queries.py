import os

import pytest

from tests.oracle import same
from treeline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE[name], SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_packing_is_the_fold(spark):
    rows = sorted(registry.QUERIES["pk02_packed"](spark, SF).collect(), key=lambda r: (r.pack, r.hash))
    at, number, filled = None, 0, 0
    for r in rows:
        if r.pack != at:
            at, number, filled = r.pack, 0, 0
        elif filled >= 4 << 20:
            number, filled = number + 1, 0
        assert (r.pack_no, r.offset) == (number, filled)
        filled += r.length


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_chunks_tile_their_files(spark):
    rows = sorted(registry.QUERIES["ch01_chunk_sizes"](spark, SF).collect(), key=lambda r: (r.path, r.idx))
    ends = {}
    for r in rows:
        assert r.offset == ends.get(r.path, 0) and 0 < r.length <= 4096
        ends[r.path] = r.offset + r.length
