import numpy as np

from orogen.operators.grid import Grid


def raster(spark, rows, res=1.0, min_x=0.0, min_y=0.0, crs="EPSG:2056"):
    """Cells and grid of rows of values, top row first; None is missing."""
    h, w = len(rows), len(rows[0])
    cells = spark.createDataFrame([(x, y, None if rows[y][x] is None else float(rows[y][x])) for y in range(h) for x in range(w)], "x int, y int, z double")
    return cells, Grid(w, h, min_x, min_y, res, res, crs, -9999.0)


def matrix(df, column="v", shape=None):
    rows = df.select("x", "y", column).collect()
    w, h = shape or (max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1)
    out = np.full((h, w), np.nan)
    for x, y, v in rows:
        out[y, x] = np.nan if v is None else v
    return out


# The heights of the two small terrains that the expected results belong to.
MOUND = [[0, 1, 2, 1, 0, 0], [0, 2, 3, 2, 0, 0], [1, 3, 6, 3, 1, 0], [0, 2, 3, 2, 0, 0], [0, 1, 2, 1, 0, 0], [0, 0, 0, 0, 0, 0]]
BASE = [[0, 0.5, 1, 0.5], [0.5, 1, 0, 0.5], [1, 0.5, 0, 0.5], [0.5, 0, 0.5, 1]]
