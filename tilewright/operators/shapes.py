"""Shape operators over tables: rows go through ``geometry`` batch by batch, groups that depend on order one group at a time.

Rings and lines are arrays of structs (x, y). A group is one tile or one building, so its
size is bounded by what a tile holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import geometry as g

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
LINE = "array<struct<x:double,y:double>>"


def _in(points: list | None) -> list[tuple[float, float]]:
    return [] if points is None else [(p["x"], p["y"]) for p in points]


def _out(points: list) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def _mapped(rows: DataFrame, columns: list[str], name: str, kind: str, arrow: pa.DataType, make: Callable) -> DataFrame:
    """``rows`` with a column that ``make`` gives for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [make(*x) for x in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield batch.append_column(name, pa.array(got, arrow))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{out}, {name} {kind}")


def clipped_rings(rows: DataFrame, ring: str, low: float, high: float, name: str = "clipped") -> DataFrame:
    return _mapped(rows, [ring], name, LINE, pa.list_(POINT), lambda r: _out(g.clip_ring(_in(r), low, high)))


def clipped_lines(rows: DataFrame, line: str, low: float, high: float, name: str = "pieces") -> DataFrame:
    """Pieces of each line in a square, with whether they were cut at their ends."""
    kind = pa.list_(pa.struct([("pts", pa.list_(POINT)), ("cut_start", pa.bool_()), ("cut_end", pa.bool_())]))
    return _mapped(rows, [line], name, f"array<struct<pts:{LINE},cut_start:boolean,cut_end:boolean>>", kind, lambda r: [{"pts": _out(p), "cut_start": a, "cut_end": b} for p, a, b in g.clip_line(_in(r), low, high)])


def long_enough(rows: DataFrame, pieces: str = "pieces", least: float = 256.0) -> DataFrame:
    """A row for each piece that carries a label: whole, or, if it was cut, ``least`` long at least."""
    rest = [c for c in rows.columns if c not in (pieces, "pts", "cut_start", "cut_end")]
    one = rows.select(*rest, F.explode(pieces).alias("piece")).select(*rest, "piece.*")
    return one.withColumn("length", g.length("pts")).where(~(F.col("cut_start") | F.col("cut_end")) | (F.col("length") >= least))


def triangulated(rows: DataFrame, ring: str, holes: str | None = None, name: str = "triangles") -> DataFrame:
    make = lambda r, hs=None: [_out(t) for t in g.triangles(_in(r), [_in(h) for h in hs or ()])]
    return _mapped(rows, [ring, *([holes] if holes else [])], name, f"array<{LINE}>", pa.list_(pa.list_(POINT)), make)


def with_footprint(rows: DataFrame, ring: str, name: str = "footprint") -> DataFrame:
    """A key that is equal for equal rings, wherever they begin and whichever way they go."""
    return _mapped(rows, [ring], name, "string", pa.string(), lambda r: ";".join(f"{x:g},{y:g}" for x, y in g.canonical_ring(_in(r))))


def dashed(rows: DataFrame, line: str, dash: float, gap: float, name: str = "dashes") -> DataFrame:
    return _mapped(rows, [line], name, f"array<{LINE}>", pa.list_(pa.list_(POINT)), lambda r: [_out(d) for d in g.dashes(_in(r), dash, gap)])


def label_anchors(rows: DataFrame, line: str, width: str, name: str = "anchors") -> DataFrame:
    return _mapped(rows, [line, width], name, "array<double>", pa.list_(pa.float64()), lambda r, w: g.anchors(_in(r), w))


def hulls(rows: DataFrame, points: str, name: str = "hull") -> DataFrame:
    return _mapped(rows, [points], name, LINE, pa.list_(POINT), lambda r: _out(g.hull(_in(r))))


def stitched(rows: DataFrame, *tile: str) -> DataFrame:
    """Streets (tile, street, seq, pts) of each tile joined end to end, in the order of ``seq``; a street may be null. A
    boolean column ``drives`` tells which roads count at a junction; without it all do."""
    driven = "drives" in rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        names = [None if s is None or s != s else s for s in pdf.street]
        got = g.stitched([(s, _in(p)) for s, p in zip(names, pdf.pts, strict=True)], list(pdf.drives) if driven else None)
        return pd.DataFrame([(*key, s, _out(p)) for s, p in got], columns=[*tile, "street", "pts"])

    return rows.groupBy(*tile).applyInPandas(run, ", ".join(f"`{t}` {kinds[t]}" for t in tile) + f", street {kinds['street']}, pts {LINE}")


def split_at_junctions(rows: DataFrame, *tile: str) -> DataFrame:
    """Lines (tile, street, seq, pts) cut at inner points where another street passes, with where each piece begins."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        streets: dict = {}
        for s, p in zip(pdf.street, pdf.pts, strict=True):
            for q in _in(p):
                streets.setdefault(q, set()).add(s)
        junctions = {q for q, s in streets.items() if len(s) > 1}
        out = [(*key, s, i, start, _out(part)) for s, i, p in zip(pdf.street, pdf.seq, pdf.pts, strict=True) for part, start in g.split_at(_in(p), junctions)]
        return pd.DataFrame(out, columns=[*tile, "street", "seq", "start", "pts"])

    return rows.groupBy(*tile).applyInPandas(run, ", ".join(f"`{t}` {kinds[t]}" for t in tile) + f", street {kinds['street']}, seq {kinds['seq']}, start double, pts {LINE}")


def outermost(rows: DataFrame, *building: str) -> DataFrame:
    """Rings (building, seq, pts) that no larger ring of their building holds; with columns ``base`` and ``top`` only one that reaches as deep and as high."""
    high = {"base", "top"} <= set(rows.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        return pdf.iloc[g.outermost([_in(p) for p in pdf.pts], list(zip(pdf.base, pdf.top, strict=True)) if high else None)]

    return rows.groupBy(*building).applyInPandas(run, rows.schema)


def outside_areas(rows: DataFrame, line: str, areas: str, name: str = "outside") -> DataFrame:
    """Pieces of each line that lie in none of its areas, as ``scene.on_surfaces`` pairs them."""
    return _mapped(rows, [line, areas], name, f"array<{LINE}>", pa.list_(pa.list_(POINT)), lambda r, a: [_out(p) for p in g.outside(_in(r), [_in(x) for x in a or ()])])


def offset_lines(rows: DataFrame, line: str, by: str, name: str = "moved") -> DataFrame:
    return _mapped(rows, [line, by], name, LINE, pa.list_(POINT), lambda r, d: _out(g.offset(_in(r), d)))


def merged_labels(rows: DataFrame, *group: str) -> DataFrame:
    """Label paths (group, seq, pts) of one text and style in a tile joined into long ones."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = g.merged([_in(p) for p in pdf.sort_values("seq").pts])
        return pd.DataFrame([(*key, i, _out(p)) for i, p in enumerate(got)], columns=[*group, "seq", "pts"])

    return rows.groupBy(*group).applyInPandas(run, ", ".join(f"`{t}` {kinds[t]}" for t in group) + f", seq int, pts {LINE}")
