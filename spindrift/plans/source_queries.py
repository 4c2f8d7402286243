"""Queries through sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import export
from . import views as v
from .registry import query


@query("S18_mat_files")
def s18(spark, d):
    return export.export_files(export.export_rows(v.train(spark, d)), "mat").select("segment", "name", F.length("content").alias("size"))


@query("S19_xlsx_files")
def s19(spark, d):
    return export.export_files(export.export_rows(v.train(spark, d)), "xlsx").select("segment", "name", (F.length("content") > 500).alias("written"))


@query("S20_export_cells", f'WITH {v.TRAIN}, {v.CLUSTERS} SELECT segment, "index", cell_label AS label FROM train JOIN clusters USING (cluster_label)')
def s20(spark, d):
    return export.export_rows(v.train(spark, d), v.clusters(spark, d), use_cells=True).select("segment", "index", "label")


@query("S13_spikes_between", f'WITH {v.TRAIN} SELECT peak_id, "index" FROM train WHERE segment = 1 AND "index" >= 1704500000 AND "index" < 1705500000')
def s13(spark, d):
    from ..sources.store import spikes_between

    return spikes_between(v.train(spark, d), 1, 1704500000, 1705500000).select("peak_id", "index")
