"""Command line: bind a recording, build a catalogue, match it, export spikes, list sources."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spindrift")
    p.add_argument("command", choices=["init", "catalogue", "peel", "export", "info"])
    p.add_argument("-d", "--dirname", required=True, help="work folder")
    p.add_argument("-c", "--chan-grp", type=int, default=0)
    p.add_argument("-p", "--parameters", default="{}", help="JSON object of parameters")
    p.add_argument("--files", nargs="*", default=[])
    p.add_argument("--dtype", default="int16")
    p.add_argument("--channels", type=int, default=1)
    p.add_argument("--sample-rate", type=float, default=15000.0)
    p.add_argument("--formats", nargs="*", default=["csv"])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators import catalogue, detect, peeling
    from .plans import pipeline
    from .sources import export, raw
    from .sources.store import TableStore

    spark = SparkSession.builder.appName("spindrift").getOrCreate()
    store = TableStore(spark, f"{a.dirname}/tables")
    if a.command == "init":
        if store.has("recording"):
            raise SystemExit("the work folder is bound to a recording already")
        frames = raw.read_raw(spark, a.files, a.dtype, a.channels)
        store.put("recording", frames, ["segment"], sample_rate=a.sample_rate, channels=a.channels)
        store.put("probe", detect.default_geometry(spark, a.chan_grp, list(range(a.channels))))
        return 0
    about = store.annotations("recording")
    if a.command == "info":
        print(json.dumps({"tables": store.keys(), **about}))
        return 0
    p = pipeline.automatic(about["channels"], about["sample_rate"], **json.loads(a.parameters))
    if a.command == "catalogue":
        processed, _ = pipeline.process(store.get("recording"), p)
        processed = store.put("processed", processed, ["segment"])
        made, peaks = pipeline.build_catalogue(processed, store.get("probe").filter(f"chan_grp = {a.chan_grp}"), p)
        store.put("peaks", peaks)
        catalogue.save_catalogue(spark, made, f"{a.dirname}/catalogues")
    elif a.command == "peel":
        made = catalogue.load_catalogue(spark, f"{a.dirname}/catalogues", a.chan_grp)
        store.put("spikes", peeling.peel_segments(store.get("processed"), made), ["segment"])
    else:
        export.export(export.export_rows(store.get("spikes")), f"{a.dirname}/export", a.formats)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
