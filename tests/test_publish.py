"""A swap is seen whole or not at all."""

import pytest

from tidewake.streaming.publish import Analyses

KIND = "slick_id long, mmsi long, score double"


def seen(table):
    return sorted((r.slick_id, r.mmsi, r.score) for r in table.read().collect())


def test_swaps_are_whole(spark, tmp_path, monkeypatch):
    table = Analyses(spark, str(tmp_path / "a"))
    rows = lambda *r: spark.createDataFrame(list(r), KIND)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.swap(rows((1, 10, 5.0), (1, 11, 4.0), (2, 10, 1.0)))
    first = [(1, 10, 5.0), (1, 11, 4.0), (2, 10, 1.0)]
    assert seen(table) == first
    open_reader = table.read()

    def fails(version):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_point", fails)
        with pytest.raises(OSError):
            table.swap(rows((1, 12, 9.0)))
    assert seen(table) == first  # data and manifest of the failed swap are there, and nobody sees them
    table.swap(rows((1, 12, 9.0), (3, 5, 1.0)))
    assert seen(table) == [(1, 12, 9.0), (2, 10, 1.0), (3, 5, 1.0)]
    assert sorted(tuple(r) for r in open_reader.collect()) == first  # a reader keeps the version that it began with
    # A slick that has no suspects any more.
    table.swap(rows().limit(0), replaced=spark.createDataFrame([(2,)], "slick_id long"))
    assert seen(table) == [(1, 12, 9.0), (3, 5, 1.0)]
    gone = Analyses(spark, str(tmp_path / "b"))
    gone.swap(rows((1, 10, 5.0)))
    gone.swap(rows().limit(0), replaced=spark.createDataFrame([(1,)], "slick_id long"))
    assert seen(gone) == [] and gone.read().columns == ["slick_id", "mmsi", "score"]
    assert len(table.clean()) > 0 and seen(table) == [(1, 12, 9.0), (3, 5, 1.0)]
    assert Analyses(spark, str(tmp_path / "a")).current() == table.current()


def test_many_swaps_become_one_folder(spark, tmp_path):
    table = Analyses(spark, str(tmp_path / "a"), most_folders=3)
    for i in range(6):
        table.swap(spark.createDataFrame([(i, 1, float(i)), (0, 2, float(i))], KIND))
    assert seen(table) == sorted([(0, 2, 5.0), *((i, 1, float(i)) for i in range(1, 6))])
    assert table._manifest(table.current()).select("folder").distinct().count() <= 3
