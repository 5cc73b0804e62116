"""Flow text: large files in several tasks, heads only at the start of files."""

import pytest

from flowgrid.sources import files

HEAD = "".join(f"* header {k} 7 8 9\n" for k in range(6))


@pytest.fixture
def small_blocks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "20000")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path, small_blocks):
    rows = [(k, k % 97, k * 3 % 1000) for k in range(30_000)]
    (tmp_path / "D7.fma").write_text(HEAD + "".join(f"{a} {b} {c}.75\n" for a, b, c in rows))
    (tmp_path / "D12.fma").write_text(HEAD + "\n1 2 3\r\n  \n4 5\nx y z")  # blank lines, a short one, no numbers, no end of line
    (tmp_path / "D13.fma").write_text(HEAD[:40])
    (tmp_path / "D14.fma").write_text("")
    got = files.read_od_by_hour(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 10
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == sorted([(7, a, b, c) for a, b, c in rows] + [(12, 1, 2, 3), (12, 4, 5, None), (12, None, None, None)], key=str)
    assert files.read_od_text(spark, str(tmp_path / "D7.fma")).count() == len(rows)
    assert files.read_od_text(spark, str(tmp_path / "D7.fma"), skip=0).count() == len(rows) + 6
