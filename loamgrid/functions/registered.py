"""Functions that a session knows by name, so that SQL texts can call them.

Scalar ones are SQL functions, which Spark puts into the plan as expressions; table functions are Python ones that
turn a row into rows, called with LATERAL; aggregates work on Arrow batches of a group.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loamgrid.functions.geo import EARTH_M
from loamgrid.sources.headers import SCHEMA, header_of

#: Name, parameters, result type and body of each SQL function.
SCALARS = {
    "haversine_m": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE",
        f"asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) * {2 * EARTH_M}D",
    ),
    "in_box": ("x DOUBLE, y DOUBLE, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE", "BOOLEAN", "x >= xmin AND x < xmax AND y >= ymin AND y < ymax"),
    "as_number": ("cell STRING", "DOUBLE", "try_cast(regexp_replace(trim(cell), ',', '') AS DOUBLE)"),
}

FEATURE = "osm_id string, kind string, n_points int, coordinates array<array<double>>"
AREA_TAGS = ("building", "landuse")


class FileHeader:
    """file_header(path, content): one row, the header of a file; see ``headers.SCHEMA``."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        yield header_of(path, content)


class OsmFeature:
    """osm_feature(element): a landed map element as JSON text to one row, or none if it has no shape."""

    def eval(self, element: str) -> Iterator[tuple]:
        try:
            e = json.loads(element) if element else {}
        except ValueError:
            return
        name = f"{e.get('type')}/{e.get('id')}"
        if e.get("type") == "node":
            yield name, "Point", 1, [[e.get("lon"), e.get("lat")]]
            return
        points = [[p.get("lon"), p.get("lat")] for p in e.get("geometry") or []]
        tags = e.get("tags") or {}
        area = any(t in tags for t in AREA_TAGS) or tags.get("area") == "yes"
        if len(points) >= 2:
            yield name, "Polygon" if area and len(points) >= 4 and points[0] == points[-1] else "LineString", len(points), points


def _weighted_median(values: pd.Series, weights: pd.Series) -> float:
    """The least value at which half of the weight is reached; rows without a value or a positive weight don't count."""
    good = values.notna() & (weights > 0)
    v, w = values[good], weights[good]
    if not len(v):
        return float("nan")
    order = v.argsort(kind="stable")
    reached = w.iloc[order].cumsum()
    return float(v.iloc[order].iloc[int((reached < reached.iloc[-1] / 2).sum())])


def register(spark: SparkSession) -> list[str]:
    """Makes all of them known to the session's SQL; their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("file_header", F.udtf(FileHeader, returnType=SCHEMA))
    spark.udtf.register("osm_feature", F.udtf(OsmFeature, returnType=FEATURE))
    spark.udf.register("weighted_median", F.pandas_udf(_weighted_median, "double"))
    return [*SCALARS, "file_header", "osm_feature", "weighted_median"]
