"""Reports of aggregated rows, and geometries as text for maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.contracts import require


def markdown(df: DataFrame, title: str, *, digits: int = 6, most: int = 1000) -> str:
    """A Markdown table of a report's rows in their order; a table of more than ``most`` rows is no report and an error."""
    rows = df.limit(most + 1).collect()
    require(len(rows) <= most, f"{title}: more than {most} rows")

    def text(v: object) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.{digits}g}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(text, r)) + " |" for r in rows)]) + "\n"


def geojson_polygon(rings: Column) -> Column:
    """A polygon's GeoJSON text; the rings are taken as they come, the shell first."""
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates")))


def legend(df: DataFrame, code: str, name: str, colour: str) -> DataFrame:
    """code, name and colour of a map's classes, once each, by code."""
    return df.select(code, name, colour).where(F.col(code).isNotNull()).distinct().orderBy(code)
