"""Exports of event trains: CSV, MAT level 5 and XLSX, per segment or per unit."""

from __future__ import annotations

import struct
import zipfile
from io import BytesIO
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trains import relabel_to_cells


def export_rows(spikes: DataFrame, clusters: DataFrame | None = None, use_cells: bool = False) -> DataFrame:
    """segment, index, label of valid spikes; cell labels instead of cluster labels where asked for."""
    if use_cells:
        if clusters is None:
            raise ValueError("cell labels need the cluster table")
        spikes = relabel_to_cells(spikes, clusters)
    keep = [c for c in ("chan_grp", "segment") if c in spikes.columns]
    return spikes.filter("cluster_label >= 0").select(*keep, "index", F.col("cluster_label").alias("label"))


def write_csv(rows: DataFrame, path: str, split_by_label: bool = False) -> None:
    """`index,label` lines without a header (S17), in folders per group, segment and, where asked for, label."""
    out = rows.sortWithinPartitions("index")
    keys = [c for c in ("chan_grp", "segment") if c in rows.columns]
    if split_by_label:
        out, keys = out.withColumn("unit", F.col("label")), [*keys, "unit"]
    out.select(*keys, "index", "label").write.partitionBy(*keys).csv(path, header=False) if keys else out.select("index", "label").write.csv(path, header=False)


def mat5(arrays: dict[str, list[int]]) -> bytes:
    """Named int64 column vectors as a MAT level 5 file."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)

    # Fixed values of the format: data types int8, int32, uint32, int64, matrix; class of int64 arrays.
    INT8, INT32, UINT32, INT64, MATRIX, INT64_CLASS = 1, 5, 6, 12, 14, 14
    head = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack("<H2s", 0x0100, b"IM")
    body = b""
    for name, values in arrays.items():
        parts = element(UINT32, struct.pack("<II", INT64_CLASS, 0)) + element(INT32, struct.pack("<ii", len(values), 1))
        body += element(MATRIX, parts + element(INT8, name.encode("ascii")) + element(INT64, struct.pack(f"<{len(values)}q", *values)))
    return head + body


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        n, r = divmod(n, 26)
        out, n = chr(65 + r) + out, n - 1
    return out


def xlsx(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """Sheets of (header, rows of numbers) as a workbook."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "http://schemas.openxmlformats.org/package/2006"
    book, links, types = [], [], []
    buffer = BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, (header, rows)) in enumerate(sheets.items(), 1):
            cells = "".join(f"<c r={chr(34)}{_letters(c)}1{chr(34)} t={chr(34)}inlineStr{chr(34)}><is><t>{h}</t></is></c>" for c, h in enumerate(header))
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                part.write(f'<worksheet xmlns="{main}"><sheetData><row r="1">{cells}</row>'.encode())
                numbered = enumerate(rows, 2)
                while some := list(islice(numbered, 20_000)):
                    part.write("".join(f'<row r="{r}">{"".join(f"<c r={chr(34)}{_letters(c)}{r}{chr(34)}><v>{x}</v></c>" for c, x in enumerate(row))}</row>' for r, row in some).encode())
                part.write(b"</sheetData></worksheet>")
            book.append(f'<sheet name="{name[:31]}" sheetId="{i}" r:id="rId{i}"/>')
            links.append(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>')
            types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(book)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kinds}/relationships">{"".join(links)}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(types)}</Types>')
    return buffer.getvalue()


#: Rows of a sheet, but for the header; spreadsheets open no more.
SHEET_ROWS = (1 << 20) - 1


def export_files(rows: DataFrame, kind: str) -> DataFrame:
    """A row per segment: segment, name and content of a .mat (S18) or .xlsx (S19) file, made where the segment's rows are.

    These formats hold a whole segment in one file; a recording too large for that goes out as CSV. An .xlsx file is written as its rows go by,
    a further sheet for each SHEET_ROWS of them; its task holds the segment's two columns and the compressed file.
    """
    import pandas as pd

    if kind not in ("mat", "xlsx"):
        raise ValueError("kind is mat or xlsx")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["index", "label"])
        seg = int(pdf["segment"].iloc[0])
        data = mat5({f"index_{seg}": pdf["index"].tolist(), f"label_{seg}": pdf["label"].tolist()})
        return pd.DataFrame({"segment": [seg], "name": [f"spikes_{seg}.{kind}"], "content": [data]})

    def pairs(table: pa.Table, begin: int):
        for at in range(begin, min(begin + SHEET_ROWS, table.num_rows), 20_000):
            part = table.slice(at, min(20_000, begin + SHEET_ROWS - at))
            yield from zip(*(("" if x is None else x for x in part.column(c).to_pylist()) for c in ("index", "label")), strict=True)

    def make_xlsx(table: pa.Table) -> pa.Table:
        seg = int(table.column("segment")[0].as_py())
        table = table.select(["index", "label"]).sort_by([("index", "ascending"), ("label", "ascending")])
        starts = range(0, table.num_rows, SHEET_ROWS)
        data = xlsx({f"segment_{seg}" + (f"_{i}" if i > 1 else ""): (["index", "label"], pairs(table, begin)) for i, begin in enumerate(starts, 1)})
        return pa.table({"segment": pa.array([seg], pa.int32()), "name": [f"spikes_{seg}.xlsx"], "content": pa.array([data], pa.binary())})

    schema = "segment int, name string, content binary"
    return rows.groupBy("segment").applyInArrow(make_xlsx, schema) if kind == "xlsx" else rows.groupBy("segment").applyInPandas(make, schema)


EXPORTERS = {"csv": write_csv, "mat": lambda rows, path: export_files(rows, "mat").write.parquet(path), "xlsx": lambda rows, path: export_files(rows, "xlsx").write.parquet(path)}


def export(rows: DataFrame, path: str, formats: str | list[str] = "csv", **options) -> list[str]:
    """Write in one or several formats; returns the paths."""
    out = []
    for kind in [formats] if isinstance(formats, str) else list(formats):
        EXPORTERS[kind](rows, f"{path}/{kind}", **(options if kind == "csv" else {}))
        out.append(f"{path}/{kind}")
    return out


def write_report(clusters: DataFrame, noise: DataFrame, path: str) -> list[str]:
    """The report of a sorting as tables (S28): cluster rows (metrics.cluster_report) and noise (metrics.noise_report), one CSV folder each."""
    out = []
    for name, table in (("clusters", clusters.orderBy("cluster_label")), ("noise", noise)):
        table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")  # a row per cluster
        out.append(f"{path}/{name}")
    return out
