import time

import numpy as np
import pytest

from spindrift.sources import live, raw


def drain(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def frames(df):
    return sorted((r.segment, r.sample, tuple(r.v)) for r in df.collect())


def test_growing_files_go_on_from_the_checkpoint(spark, tmp_path):
    """Recorded in three parts with a restart after each, the second ending inside of a sample; then equal to the batch reader, each frame once."""
    data = np.random.default_rng(1).integers(-500, 500, (1000, 3)).astype("int16")
    paths = [str(tmp_path / f"rec{i}.raw") for i in range(2)]
    whole = data.tobytes()
    (tmp_path / "rec0.raw").write_bytes(whole[: 6 * 300])
    drain(live.read_live(spark, paths, "int16", 3, chunk=128), tmp_path)
    (tmp_path / "rec0.raw").write_bytes(whole[: 6 * 700 + 4])
    drain(live.read_live(spark, paths, "int16", 3, chunk=128), tmp_path)
    (tmp_path / "rec0.raw").write_bytes(whole)
    (tmp_path / "rec1.raw").write_bytes(whole[: 6 * 450])
    drain(live.read_live(spark, paths, "int16", 3, chunk=128), tmp_path)
    drain(live.read_live(spark, paths, "int16", 3, chunk=128), tmp_path)
    got = frames(spark.read.parquet(str(tmp_path / "out")))
    assert got == frames(raw.read_raw(spark, paths, "int16", 3)) and len(got) == 1450


def test_replay_at_a_rate(spark, tmp_path):
    """At 100 samples a second from two seconds ago on some 200 samples are there, never all; from long ago on all are."""
    data = np.arange(2 * 5000, dtype="int16").reshape(-1, 2)
    data.tofile(tmp_path / "a.raw")
    paths = [str(tmp_path / "a.raw")]
    begun = time.time()
    drain(live.read_live(spark, paths, "int16", 2, sample_rate=100.0, origin=begun - 2, channels=[1]), tmp_path)
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert 200 <= n <= 100 * (time.time() - begun + 2) + 1 and n < 5000
    drain(live.read_live(spark, paths, "int16", 2, sample_rate=100.0, origin=begun - 1000, channels=[1]), tmp_path)
    assert frames(spark.read.parquet(str(tmp_path / "out"))) == frames(raw.read_raw(spark, paths, "int16", 2, channels=[1]))


def test_offsets():
    reader = live.LiveSignalReader({"paths": "/nowhere/a,/nowhere/b", "total_channel": "2", "chunk": "10"})
    assert reader.initialOffset() == reader.latestOffset() == {"0": 0, "1": 0}
    spans = reader.partitions({"0": 5, "1": 0}, {"0": 27, "1": 3})
    assert [(s.segment, s.start, s.stop) for s in spans] == [(0, 5, 15), (0, 15, 25), (0, 25, 27), (1, 0, 3)]
    with pytest.raises(ValueError):
        live.LiveSignalReader({"paths": "a", "total_channel": "2", "origin": "0"})
