import numpy as np
import pandas as pd
import pytest

from spindrift.operators import filters, peeling
from spindrift.sources.raw import from_arrays
from spindrift.streaming import processors as s

from .fixtures import recording
from .test_models import made


def run(spark, tmp_path, arrays, processor, chunk=500, order=None):
    """Chunks written as files, one to a micro-batch, in the order given."""
    s.use_rocksdb(spark)
    rows = [(seg, a, x.shape[1], x[a : a + chunk].ravel().tolist()) for seg, x in enumerate(arrays) for a in range(0, len(x), chunk)]
    rows = [rows[i] for i in (order or range(len(rows)))]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], s.CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i:04d}"))
    stream = spark.readStream.schema(s.CHUNKS).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in/*"))
    name = f"out_{tmp_path.name}".replace("-", "_").replace("[", "_").replace("]", "_")
    q = s.run_chunks(stream, processor).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


@pytest.mark.parametrize("shuffled", [False, True])
def test_peeling_stream_equals_batch(spark, tmp_path, shuffled):
    x, truth = recording(4000, seed=3)
    order = [2, 0, 1, 5, 3, 4, 7, 6] if shuffled else None
    got = run(spark, tmp_path, [x], s.PeelProcessor(made(), length=4000), order=order)
    batch = peeling.peel_segments(from_arrays(spark, [x.astype(np.float32)]), made()).collect()
    assert sorted((r["index"], r.cluster_label) for r in got) == truth == sorted((r["index"], r.cluster_label) for r in batch)


def test_filter_stream_equals_kernel(spark, tmp_path):
    x = np.random.default_rng(0).normal(0, 10, (3000, 2))
    p = filters.Preprocessing(10000.0, 500.0, 4000.0)
    got = sorted(run(spark, tmp_path, [x], s.FilterProcessor(p, 150, 2)), key=lambda r: r.sample)
    want = filters.preprocess(x, p, normalise=False)
    out = np.array([r.v for r in got])
    assert [r.sample for r in got] == list(range(2850)) and np.abs(out - want[:2850])[300:].max() / np.abs(want).mean() < 0.05


def test_detection_and_noise_streams(spark, tmp_path):
    x, _ = recording(3000)
    got = run(spark, tmp_path, [x], s.DetectProcessor(made()), chunk=300)
    mask = np.argwhere(peeling.Peeler(made()).detect(x))
    assert sorted((r["index"], r.channel) for r in got) == [(int(i), int(c)) for i, c in mask]
    (tmp_path / "b").mkdir()
    rows = run(spark, tmp_path / "b", [x, x + 5], s.NoiseProcessor(1000, 4), chunk=300)
    assert len(rows) == 8 and all(abs(r.mad - np.median(np.abs(x[:1000, r.channel] - np.median(x[:1000, r.channel]))) * 1.4826) < 1e-9 for r in rows if r.segment == 0)


def test_rates_stream(spark, tmp_path):
    pdf = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:09"]), "channel": [1, 1, 2]})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, channel long").parquet(str(tmp_path / "ev"))
    q = s.event_rates(stream, "ts", "4 seconds", "2 seconds", "1 second", "channel").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").groupBy().sum("n").first()[0] == 6


def test_to_chunks(spark):
    x = np.arange(20.0).reshape(10, 2)
    rows = sorted(s.to_chunks(from_arrays(spark, [x]), 4).collect(), key=lambda r: r.i_start)
    assert [r.i_start for r in rows] == [0, 4, 8] and np.array_equal(np.concatenate([np.array(r.v).reshape(-1, r.channels) for r in rows]), x)
