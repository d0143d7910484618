"""Archives and shapefiles that the tests write."""

import struct
import zipfile

import pytest

from tidewake.operators import calibrate
from tidewake.sources import archives

XML = "<calibration><calibrationVector><line>0</line><pixel>0 10</pixel><sigmaNought>100 300</sigmaNought></calibrationVector></calibration>"


def archive(path, **files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)


def test_an_archive_of_two_bands_ends_in_calibrated_samples(spark, tmp_path):
    archive(tmp_path / "a.zip", S__measurement__s1_vh_1_DOT_tiff="vh", S__measurement__s1_VV_2_DOT_tiff="vv", S__annotation__calibration__calibration_vh_DOT_xml=XML, S__annotation__noise_DOT_xml="<n/>")
    archive(tmp_path / "b.zip", S__measurement__x_vh_DOT_tif="only")
    archive(tmp_path / "c.zip", S__readme_DOT_txt="nothing")
    listed = archives.members(spark, str(tmp_path))
    assert listed.count() == 6
    chosen = {r.path[-5:]: (r.member, r.band) for r in archives.measurements(listed).collect()}
    assert chosen == {"a.zip": ("S/measurement/s1_VV_2.tiff", "vv"), "b.zip": ("S/measurement/x_vh.tif", "vh")}
    (band,) = [bytes(r.content) for r in archives.contents(archives.measurements(listed)).collect() if r.path.endswith("a.zip")]
    assert band == b"vv"
    documents = archives.calibrations(listed)
    (scene,) = [r.scene for r in documents.collect()]
    samples = spark.createDataFrame([(scene, 7, 5.0, 20.0)], "scene string, line int, pixel double, dn double")
    (r,) = calibrate.calibrated(samples, calibrate.luts(documents)).collect()
    assert r.lut == 200.0 and r.db == pytest.approx(-20.0)


def shapefile(path, *records, kind=5):
    body = b""
    for i, parts in enumerate(records, 1):
        points = [p for part in parts for p in part]
        starts = [sum(map(len, parts[:j])) for j in range(len(parts))]
        content = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points) if parts else struct.pack("<i", 0)
        body += struct.pack(">2i", i, len(content) // 2) + content
    path.write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i", 1000, kind) + bytes(64) + body)


def test_shapefiles_give_their_rings(spark, tmp_path):
    outer = [(20.0, 60.0), (20.0, 61.0), (21.0, 61.0), (21.0, 60.0), (20.0, 60.0)]
    hole = [(20.2, 60.2), (20.4, 60.2), (20.4, 60.4), (20.2, 60.4), (20.2, 60.2)]
    line, dot = [(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)], [(1.0, 1.0), (1.0, 1.0001), (1.0001, 1.0001), (1.0, 1.0)]
    shapefile(tmp_path / "land.shp", [outer, hole], [], [line], [dot], [outer[::-1]])
    got = {(r.record, r.part): r for r in archives.land_rings(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 0), (1, 1), (5, 0)}
    assert not got[1, 0].hole and got[1, 1].hole and got[5, 0].hole
    assert [(p.k, p.lon, p.lat) for p in got[1, 1].ring] == [(k, *p) for k, p in enumerate(hole)]
    shapefile(tmp_path / "points.shp", [outer], kind=1)
    with pytest.raises(Exception, match="no polygon shapefile"):
        archives.land_rings(spark, str(tmp_path)).collect()
