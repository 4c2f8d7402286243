import struct
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.cli import main
from spindrift.sources import export, raw
from spindrift.sources.store import TableStore

from .fixtures import recording


@pytest.mark.parametrize("dtype,offset", [("int16", 0), ("uint16", 12), ("float32", 0)])
def test_raw_files(spark, tmp_path, dtype, offset):
    arrays = [np.arange(3000).reshape(1000, 3).astype(dtype), np.arange(600).reshape(200, 3).astype(dtype)]
    paths = []
    for i, a in enumerate(arrays):
        paths.append(str(tmp_path / f"{i}.raw"))
        (tmp_path / f"{i}.raw").write_bytes(bytes(offset) + a.tobytes())
    df = raw.read_raw(spark, paths, dtype, 3, offset, chunk=128)
    for i, a in enumerate(arrays):
        rows = df.filter(f"segment = {i}").orderBy("sample").collect()
        assert np.array_equal(np.array([r.v for r in rows]), a.astype(np.float32)) and [r.sample for r in rows] == list(range(len(a)))
    assert np.array_equal(np.array([r.v for r in raw.read_raw(spark, paths, dtype, 3, offset, channels=[2, 0]).filter("segment = 1").orderBy("sample").collect()]), arrays[1][:, [2, 0]].astype(np.float32))
    stored = raw.read_raw_store(spark, str(tmp_path / "*.raw"), dtype, 3, offset)
    assert sorted(map(tuple, stored.select("segment", "sample").collect())) == sorted(map(tuple, df.select("segment", "sample").collect()))
    (tmp_path / "odd.raw").write_bytes(b"\0" * 7)
    with pytest.raises(Exception, match="whole number"):
        raw.read_raw(spark, [str(tmp_path / "odd.raw")], dtype, 3).count()


def test_frames_and_long_form(spark):
    x = np.random.default_rng(0).normal(size=(50, 4)).astype(np.float32)
    df = raw.from_arrays(spark, [x, x * 2])
    back = raw.to_frames(raw.to_long(df)).filter("segment = 1").orderBy("sample").collect()
    assert np.allclose([r.v for r in back], x * 2) and raw.to_long(df, [1]).count() == 100


def test_probe_files_are_not_executed(spark):
    text = "total_nb_channels = 4\nradius = 100\nchannel_groups = {0: {'channels': list(range(4)), 'geometry': {0: [0, 50], 1: [50, 0], 2: [0, -50], 3: (-50, 0)}}, 1: {'channels': [4, 5, 6, 7]}}\n"
    groups = raw.parse_probe(text)
    assert groups == raw.parse_probe(raw.format_probe(groups))
    table = raw.probe_table(spark, groups)
    assert {(r.channel, r.x, r.y) for r in table.filter("chan_grp = 1").collect()} == {(4, 0.0, 50.0), (5, 50.0, 0.0), (6, 0.0, -50.0), (7, -50.0, 0.0)}
    for bad in ("channel_groups = __import__('os').getcwd()", "x = 1", "channel_groups = open('/etc/passwd')"):
        with pytest.raises(ValueError):
            raw.parse_probe(bad)


def test_store_life_cycle(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    assert store.keys() == [] and not store.has("a")
    store.put("a", spark.range(8), note="x")
    store.append("a", spark.range(8))
    assert store.get("a").count() == 16 and store.annotations("a") == {"note": "x"}
    store.savepoint("before")
    store.overwrite_where("a", spark.range(100, 103), F.col("id") < 4)
    store.annotate("a", more=1)
    assert store.get("a").count() == 11 and store.annotations("a") == {"note": "x", "more": 1}
    store.restore("before")
    assert store.get("a").count() == 16
    store.delete("a")
    assert not store.has("a")
    with pytest.raises(KeyError):
        store.get("a")


def test_exports(spark, tmp_path):
    spikes = spark.createDataFrame([(0, 5, 1, 0.0), (0, 2, 0, 0.0), (1, 9, 1, 0.0), (1, 3, -1, 0.0)], "segment int, index long, cluster_label long, jitter double")
    clusters = spark.createDataFrame([(0, 0), (1, 0)], "cluster_label long, cell_label long")
    rows = export.export_rows(spikes, clusters, use_cells=True)
    assert sorted(map(tuple, rows.collect())) == [(0, 2, 0), (0, 5, 0), (1, 9, 0)]
    paths = export.export(export.export_rows(spikes), str(tmp_path / "out"), ["csv", "mat", "xlsx"])
    assert sorted(spark.read.text(paths[0]).rdd.map(lambda r: r[0]).collect()) == ["2,0", "5,1", "9,1"]
    mat = {r.segment: bytes(r.content) for r in spark.read.parquet(paths[1]).collect()}[0]
    assert len(mat) % 8 == 0 and b"index_0" in mat and struct.pack("<2q", 2, 5) in mat
    book = {r.segment: bytes(r.content) for r in spark.read.parquet(paths[2]).collect()}[1]
    assert b"<v>9</v>" in zipfile.ZipFile(BytesIO(book)).read("xl/worksheets/sheet1.xml")


def test_command_line(spark, tmp_path, capsys):
    x, truth = recording(15_000, gap=110)
    (tmp_path / "a.raw").write_bytes((x * 20).astype("int16").tobytes())
    d = ["-d", str(tmp_path / "work")]
    assert main(["init", *d, "--files", str(tmp_path / "a.raw"), "--channels", "4", "--sample-rate", "15000"]) == 0
    with pytest.raises(SystemExit):
        main(["init", *d])
    assert main(["catalogue", *d, "-p", '{"threshold": 8.0, "min_cluster_size": 12, "right_ms": 1.3}']) == 0
    assert main(["peel", *d]) == 0 and main(["export", *d, "--formats", "csv", "mat"]) == 0 and main(["info", *d]) == 0
    assert "spikes" in capsys.readouterr().out
    spikes = TableStore(spark, str(tmp_path / "work/tables")).get("spikes")
    assert spikes.count() > 0.8 * len(truth)
