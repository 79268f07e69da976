"""Cells and triangles as a drawing in SVG: lines of text made by the workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A coordinate with four digits."""
    return F.format_string("%.4f", x.cast("double"))


def elements(cells: DataFrame | None = None, tri: DataFrame | None = None) -> DataFrame:
    """``layer``, ``id``, ``line``: a rectangle per cell (``id``, ``lo``, ``hi``) and, above them, a polygon per
    triangle (``id``, x1 ... y3)."""
    parts = []
    if cells is not None:
        at = lambda c, d: F.get(c, F.lit(d))
        size = [number(at("hi", d) - at("lo", d)) for d in range(2)]
        rect = F.concat(F.lit('<rect x="'), number(at("lo", 0)), F.lit('" y="'), number(at("lo", 1)), F.lit('" width="'), size[0], F.lit('" height="'), size[1], F.lit('" class="cell"/>'))
        parts.append(cells.select(F.lit(1).alias("layer"), F.col("id").cast("long").alias("id"), rect.alias("line")))
    if tri is not None:
        corners = F.concat_ws(" ", *[F.concat_ws(",", number(F.col(f"x{k}")), number(F.col(f"y{k}"))) for k in (1, 2, 3)])
        parts.append(tri.select(F.lit(2).alias("layer"), F.col("id").cast("long").alias("id"), F.concat(F.lit('<polygon points="'), corners, F.lit('" class="triangle"/>')).alias("line")))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def write(drawing: DataFrame, path: str, lo: list[float], hi: list[float]) -> None:
    """Writes the elements in order, between the head and the foot of a drawing, as text files that make
    one drawing when they are read by name. The y axis points up."""
    w, h = hi[0] - lo[0], hi[1] - lo[1]
    pen = min(w, h) / 1000
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{lo[0]:g} {-hi[1]:g} {w:g} {h:g}"><style>.cell{{fill:none;stroke:#777;stroke-width:{pen:g}}}.triangle{{fill:none;stroke:#b40;stroke-width:{pen:g}}}</style><g transform="scale(1,-1)">'
    ends = drawing.sparkSession.createDataFrame([(0, 0, head), (9, 0, "</g></svg>")], "layer int, id long, line string")
    drawing.select("layer", "id", "line").union(ends).orderBy("layer", "id").select("line").write.text(path)
