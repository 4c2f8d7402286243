"""Imports of events that other tools have found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import range_join, union_all


def from_spike_table(spikes: DataFrame, unit: str, time: str, sample_rate: float | None = None, segment: str | None = None) -> DataFrame:
    """Spikes of any table of (unit, time): segment, index, unit. Times in seconds where sample_rate is given, else samples."""
    index = F.round(F.col(time) * sample_rate).cast("long") if sample_rate else F.col(time).cast("long")
    return spikes.select((F.col(segment) if segment else F.lit(0)).cast("int").alias("segment"), index.alias("index"), F.col(unit).alias("unit"))


def align_units(spikes: DataFrame, signal: DataFrame, n_left: int, n_right: int, sign: str = "-") -> DataFrame:
    """peak rows from imported units (S24): each unit is moved by the place of its template's extremum.

    The template of a unit is the mean of its windows; its extremum gives channel and shift. Units are numbered in order of their names.
    """
    rows = range_join(spikes, signal, F.col("index") + n_left, F.col("index") + (n_right - 1), F.col("sample"), 4096, ["segment"])
    mean = rows.groupBy("unit", (F.col("sample") - F.col("index")).alias("shift"), "channel").agg(F.avg("value").alias("v"))
    best = mean.groupBy("unit").agg((F.max_by if sign == "+" else F.min_by)(F.struct("shift", "channel"), F.col("v")).alias("e"))
    from pyspark.sql import Window

    named = best.select("unit", "e.shift", "e.channel", (F.row_number().over(Window.orderBy("unit")) - 1).cast("long").alias("cluster_label"))
    moved = spikes.join(F.broadcast(named), "unit").withColumn("index", F.col("index") + F.col("shift"))
    at = moved.join(signal.select("segment", F.col("sample").alias("index"), "channel", F.col("value").alias("extremum_amplitude")), ["segment", "index", "channel"])
    return at.select("segment", "index", "channel", "extremum_amplitude", "cluster_label")


def merge_imports(*spikes: DataFrame) -> DataFrame:
    """Several imports as one table."""
    return union_all(*spikes)


def read_parameters(path: str) -> dict[str, str]:
    """The settings of an INI file, names in lower case without their sections; comments behind # or ; are dropped."""
    from configparser import ConfigParser

    parser = ConfigParser(inline_comment_prefixes=("#", ";"), strict=False, interpolation=None)
    with open(path) as file:
        parser.read_string(file.read())
    return {k: x for section in parser.sections() for k, x in parser.items(section)}


def from_files(spark, spikes: str, parameters: str, kind: str = "parquet", unit: str = "unit", time: str = "time", in_seconds: bool = False) -> DataFrame:
    """Spikes that another tool has left as a table of files (kind: a format that Spark reads) beside its INI parameters.

    The sampling rate comes from the parameters, where it is needed.
    """
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    found = reader.format(kind).load(spikes)
    rate = float(read_parameters(parameters)["sampling_rate"]) if in_seconds else None
    return from_spike_table(found, unit, time, rate, "segment" if "segment" in found.columns else None)


def from_hdf5(spark, path: str, parameters: str) -> DataFrame:
    """Spikes of an HDF5 file with a data set of sample numbers for each unit, `spiketimes/temp_<unit>`, read with the optional h5py library."""
    import h5py

    rows = []
    with h5py.File(path, "r") as file:
        for name, times in file["spiketimes"].items():
            rows += [(int(name.rsplit("_", 1)[-1]), int(t)) for t in times[()].ravel()]
    read_parameters(parameters)
    return from_spike_table(spark.createDataFrame(rows, "unit long, time long"), "unit", "time")
