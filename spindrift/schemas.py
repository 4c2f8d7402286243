"""Table schemas and reserved labels of the event model."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class Label(IntEnum):
    """Reserved cluster labels; valid clusters are 0 or more. NO_WAVEFORM and LEFT_LIMIT share a number on export only."""

    TRASH = -1
    NOISE = -2
    ALIEN = -9
    UNCLASSIFIED = -10
    NO_WAVEFORM = -11
    RIGHT_LIMIT = -12
    MAX_SHIFT = -13
    NO_MORE_PEAK = -20


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_WAVE = T.ArrayType(T.ArrayType(T.FloatType()))

SIGNAL = _struct(segment=T.IntegerType(), sample=T.LongType(), channel=T.IntegerType(), value=T.DoubleType())
FRAMES = _struct(segment=T.IntegerType(), sample=T.LongType(), v=T.ArrayType(T.FloatType()))
BLOCKS = _struct(segment=T.IntegerType(), block=T.LongType(), i_start=T.LongType(), i_stop=T.LongType(), v=_WAVE)
PROBE = _struct(chan_grp=T.IntegerType(), pos=T.IntegerType(), channel=T.IntegerType(), x=T.DoubleType(), y=T.DoubleType())
PEAKS = _struct(peak_id=T.LongType(), segment=T.IntegerType(), index=T.LongType(), channel=T.IntegerType(), extremum_amplitude=T.DoubleType(), cluster_label=T.LongType())
SPIKES = _struct(chan_grp=T.IntegerType(), segment=T.IntegerType(), index=T.LongType(), cluster_label=T.LongType(), jitter=T.DoubleType())
CLUSTERS = _struct(
    cluster_label=T.LongType(), cell_label=T.LongType(), extremum_channel=T.LongType(), extremum_amplitude=T.DoubleType(), waveform_rms=T.DoubleType(), nb_peak=T.LongType(), tag=T.StringType(), annotations=T.StringType(), color=T.LongType()
)
WAVEFORMS = _struct(peak_id=T.LongType(), wf=_WAVE)
