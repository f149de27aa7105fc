"""Reading and writing layers and records, and classifying files of a lake by their first bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamgrid.sources.headers import SCHEMA, header_of

#: Names that coordinate columns go by, best first.
LAT_NAMES, LON_NAMES = ("latitude", "lat", "y"), ("longitude", "lon", "lng", "long", "x")
#: Kind and family of files by the first bytes, in hexadecimal.
MAGIC = {
    "89504E47": ("png", "raster"), "FFD8FF": ("jpeg", "raster"), "49492A00": ("tiff", "raster"), "4D4D002A": ("tiff", "raster"), "0000270A": ("shp", "vector"), "504B0304": ("zip", "container"),
    "1F8B": ("gzip", "container"), "50415231": ("parquet", "tabular"), "25504446": ("pdf", "document"), "4C415346": ("las", "vector"), "53514C69746520666F726D6174": ("sqlite", "container"), "894844460D0A1A0A": ("hdf5", "raster"),
}


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A layer by its suffix: Parquet, GeoJSON, JSON lines, CSV or TSV (text columns, header)."""
    low = path.lower()
    if low.endswith((".parquet", ".geoparquet")):
        return spark.read.parquet(path)
    if low.endswith(".geojson"):
        return explode_geojson(spark, path)
    if low.endswith((".jsonl", ".ndjson", ".json")):
        return spark.read.json(path)
    return spark.read.csv(path, header=True, sep="\t" if low.endswith((".tsv", ".tab")) else ",")


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """(lon, lat) columns by name: exact first, then as part of a name."""

    def pick(names: tuple[str, ...]) -> str | None:
        for exact in (True, False):
            for n in names:
                for c in columns:
                    if c.lower() == n if exact else len(n) > 1 and n in c.lower():
                        return c
        return None

    lon, lat = pick(LON_NAMES), pick(LAT_NAMES)
    return (lon, lat) if lon and lat else None


def points_from_table(df: DataFrame) -> DataFrame:
    """``df`` with lon and lat as numbers (decimal or degrees, minutes, seconds), only rows in range."""
    from loamgrid.functions.geo import dms_to_degrees

    found = coordinate_columns(df.columns)
    if not found:
        raise ValueError(f"no coordinate columns among {df.columns}")
    lon, lat = (dms_to_degrees(F.col(c).cast("string")) for c in found)
    return df.withColumns({"lon": lon, "lat": lat}).where("lon between -180 and 180 and lat between -90 and 90")


def explode_geojson(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """Features of collections as rows: properties as columns, geometry_type, and geometry as JSON text.

    A file is one collection, or with ``one_a_line`` each of its lines is one, so that large files are read in parts.
    """
    raw = spark.read.json(path, multiLine=not one_a_line)
    f = raw.select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.to_json("f.geometry").alias("geometry"))


def load_elements(df: DataFrame, require_public: bool = True) -> DataFrame:
    """Element records without blank ids, one row an id, tags sorted; by default only public ones (no visibility counts as public)."""
    out = df.where(F.trim("id") != "").dropDuplicates(["id"]).withColumn("tags", F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))))
    return out.where(F.coalesce(F.lower("visibility"), F.lit("public")) == "public") if require_public else out


def profile(df: DataFrame, lon: str = "lon", lat: str = "lat", ring: str | None = None) -> DataFrame:
    """One row: features, columns and their types, geometry kind, bounds, and how many vertices there are in all.

    The geometry is a point (``lon``, ``lat``), or with ``ring`` a closed ring of structs x and y whose first vertex isn't repeated.
    """
    shape = (ring,) if ring else (lon, lat)
    types = F.array(*[F.lit(f"{c}: {t}") for c, t in df.dtypes if c not in shape])
    x, y = (F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])) if ring else (F.array(lon), F.array(lat))
    vertices = F.sum(F.when(F.col(ring).isNotNull(), F.size(ring) + 1)) if ring else F.count(F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), 1))
    return df.agg(
        F.count("*").alias("features"), F.lit(len(df.columns)).alias("columns"), types.alias("types"), F.lit("Polygon" if ring else "Point").alias("geometry"),
        F.min(F.array_min(x)).alias("xmin"), F.min(F.array_min(y)).alias("ymin"), F.max(F.array_max(x)).alias("xmax"), F.max(F.array_max(y)).alias("ymax"), vertices.alias("vertices"),
    )


def sniff(content: Column) -> tuple[Column, Column]:
    """(kind, family) of bytes: by magic numbers, then by what their text begins with."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.ltrim(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    kind = family = None
    for magic, (k, f) in MAGIC.items():
        hit = head.startswith(magic)
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
        family = F.when(hit, f) if family is None else family.when(hit, f)
    xml, html, json_ = text.startswith("<?xml"), F.lower(text).startswith("<!doctype html") | F.lower(text).startswith("<html"), text.rlike(r"^[\[{]")
    csv = text.rlike(r"^[^\n,]+,[^\n]+")
    for hit, k, f in ((html, "html", "metadata"), (xml, "xml", "metadata"), (json_, "json", "metadata"), (csv, "csv", "tabular")):
        kind, family = kind.when(hit, k), family.when(hit, f)
    return kind.otherwise("unknown"), family.otherwise("unknown")


#: Bytes that are read of a file's beginning, and from a TIFF's directory on.
HEAD, DIRECTORY = 65_536, 65_536


def header_catalog(files: DataFrame) -> DataFrame:
    """path and the header (``headers.SCHEMA``) of binaryFile rows (path, content): LAS, SHP, DBF, TIFF and CSV; other files give nulls.

    Python gets the first HEAD bytes and, where a TIFF's directory lies elsewhere, DIRECTORY bytes from there on.
    """
    lower = F.lower("path")
    csv = lower.endswith(".csv") | lower.endswith(".tsv")
    lines = F.when(csv, F.length("content") - F.length(F.translate(F.decode("content", "ISO-8859-1"), "\n", "")))
    byte = lambda k: F.hex(F.substring("content", k, 1))
    mark = F.hex(F.substring("content", 1, 4))
    number = lambda *ks: F.conv(F.concat(*map(byte, ks)), 16, 10).cast("long")
    at = F.when(mark == "49492A00", number(8, 7, 6, 5)).when(mark == "4D4D002A", number(5, 6, 7, 8)).when(mark == "49492B00", number(16, 15, 14, 13, 12, 11, 10, 9)).when(mark == "4D4D002B", number(9, 10, 11, 12, 13, 14, 15, 16))
    far = F.when((at + 8 > HEAD) & (at < 2**31 - DIRECTORY), at)
    heads = files.select("path", F.substring("content", 1, HEAD).alias("head"), lines.cast("long").alias("lines"), far.alias("at"), F.when(far.isNotNull(), F.substring(F.col("content"), (far + 1).cast("int"), F.lit(DIRECTORY))).alias("part"))

    fields = list(to_arrow_schema(T.StructType.fromDDL(SCHEMA)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = zip(*(b.column(c).to_pylist() for c in ("path", "head", "lines", "at", "part")), strict=True)
            rows = [header_of(path, head, n, (where, part) if where is not None else None) for path, head, n, where, part in cells]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], ["path", *(f.name for f in fields)])

    return heads.mapInArrow(read, f"path string, {SCHEMA}")


def notebook_cells(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """(path, name, cell, kind, source) of notebooks, in order; a file is one notebook, or each of its lines is."""
    schema = "name string, cells array<struct<cell_type:string,source:array<string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=not one_a_line).select(F.col("_metadata.file_path").alias("path"), "name", F.posexplode("cells").alias("cell", "c"))
    return raw.select("path", "name", "cell", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("source"))


def wkt_points(text: Column) -> Column:
    """Coordinate pairs of a WKT text as structs (x, y)."""
    number = r"(-?\d+(?:\.\d+)?)"
    xs, ys = (F.regexp_extract_all(text, F.lit(rf"{number}\s+{number}"), F.lit(k)) for k in (1, 2))
    return F.zip_with(xs, ys, lambda a, b: F.struct(a.try_cast("double").alias("x"), b.try_cast("double").alias("y")))


def geo_shape(text: Column) -> Column:
    """JSON shape of a WKT text: one pair a point, two an envelope, more a polygon; else null."""
    p = wkt_points(text)
    pair = lambda q: F.concat(F.lit("["), q["x"].cast("string"), F.lit(","), q["y"].cast("string"), F.lit("]"))
    joined = F.array_join(F.transform(p, pair), ",")
    return (
        F.when(F.size(p) == 1, F.concat(F.lit('{"type":"point","coordinates":'), joined, F.lit("}")))
        .when(F.size(p) == 2, F.concat(F.lit('{"type":"envelope","coordinates":['), joined, F.lit("]}")))
        .when(F.size(p) > 2, F.concat(F.lit('{"type":"polygon","coordinates":[['), joined, F.lit("]]}")))
    )


def osm_features(elements: DataFrame) -> DataFrame:
    """Landed map elements (type, id, lat, lon, tags, geometry) to rows: closed ways with an area tag are polygons; ways under two points are dropped."""
    n = F.size("geometry")
    closed = (n >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    area = closed & (F.map_contains_key("tags", "building") | F.map_contains_key("tags", "landuse") | (F.try_element_at("tags", F.lit("area")) == "yes"))
    kind = F.when(F.col("type") == "node", "Point").when(area, "Polygon").when(n >= 2, "LineString")
    ring = F.when(F.col("type") == "node", F.array(F.struct("lon", "lat"))).otherwise(F.transform("geometry", lambda g: F.struct(g["lon"].alias("lon"), g["lat"].alias("lat"))))
    return elements.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_id"), "tags", kind.alias("kind"), ring.alias("coordinates")).where("kind is not null")


#: The record that catalogue payloads of all providers become.
ASSET = "id string, source string, title string, abstract string, keywords array<string>, bbox array<double>, start string, end string, license string"


def bounds_of(shape: Column) -> Column:
    """[xmin, ymin, xmax, ymax] of all coordinate pairs in the JSON text of a shape; null if it has none."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    part = lambda k: F.transform(F.regexp_extract_all(shape, F.lit(rf"\[\s*{number}\s*,\s*{number}"), F.lit(k)), lambda x: x.try_cast("double"))
    return F.when(F.size(part(1)) > 0, F.array(F.array_min(part(1)), F.array_min(part(2)), F.array_max(part(1)), F.array_max(part(2))))


def interval(text: Column) -> tuple[Column, Column]:
    """(start, end) of "a/b", either of which may be empty; a single time is both."""
    parts = F.split(text, "/")
    side = lambda k: F.when(F.size(parts) == 2, F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit(""))).otherwise(text)
    return side(0), side(1)


def _datacite(j, words) -> tuple[Column, ...]:  # noqa: ANN001
    """A DataCite record: the first usable box, else point; a collected, created or coverage range, else any date, else the year; the longest abstract."""
    a = "$.attributes"
    places = F.from_json(j(f"{a}.geoLocations"), "array<struct<geoLocationBox:struct<westBoundLongitude:string,eastBoundLongitude:string,southBoundLatitude:string,northBoundLatitude:string>,geoLocationPoint:struct<pointLongitude:string,pointLatitude:string>>>")
    number = lambda x: x.try_cast("double")

    def extent(p: Column) -> Column:
        b, q = p["geoLocationBox"], p["geoLocationPoint"]
        w, e, s, n = (number(b[k]) for k in ("westBoundLongitude", "eastBoundLongitude", "southBoundLatitude", "northBoundLatitude"))
        x, y = number(q["pointLongitude"]), number(q["pointLatitude"])
        box = F.array(F.least(w, e), F.least(s, n), F.greatest(w, e), F.greatest(s, n))
        inside = lambda lon, lat: lon.between(-180, 180) & lat.between(-90, 90)
        return F.when(inside(w, s) & inside(e, n), box).when(inside(x, y), F.array(x, y, x, y))

    dates = F.filter(F.from_json(j(f"{a}.dates"), "array<struct<date:string,dateType:string>>"), lambda d: F.trim(d["date"]) != "")
    main = F.filter(dates, lambda d: F.lower(d["dateType"]).isin("collected", "created", "coverage"))
    start, end = interval(F.trim(F.get(F.coalesce(F.when(F.size(main) > 0, main), dates), F.lit(0))["date"]))
    ranged = F.contains(F.get(main, F.lit(0))["date"], F.lit("/"))
    year = F.concat(j(f"{a}.publicationYear"), F.lit("-01-01"))
    told = F.filter(F.from_json(j(f"{a}.descriptions"), "array<struct<description:string,descriptionType:string>>"), lambda d: F.trim(d["description"]) != "")
    abstracts = F.filter(told, lambda d: d["descriptionType"] == "Abstract")
    longest = F.aggregate(F.transform(F.when(F.size(abstracts) > 0, abstracts).otherwise(told), lambda d: F.trim(d["description"])), F.lit(None).cast("string"), lambda m, d: F.when(m.isNull() | (F.length(d) > F.length(m)), d).otherwise(m))
    rights = F.from_json(j(f"{a}.rightsList"), "array<struct<rightsIdentifier:string,rights:string,rightsUri:string>>")
    licence = F.get(F.filter(F.transform(rights, lambda r: F.coalesce(r["rightsIdentifier"], r["rights"], r["rightsUri"])), lambda r: r.isNotNull()), F.lit(0))
    subjects = F.transform(F.from_json(j(f"{a}.subjects"), "array<struct<subject:string>>"), lambda s: s["subject"])
    title = F.trim(F.get(F.from_json(j(f"{a}.titles"), "array<struct<title:string>>"), F.lit(0))["title"])
    box = F.get(F.filter(F.transform(places, extent), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(j(f"{a}.doi"), j("$.id")), title, longest, F.filter(subjects, lambda s: s.isNotNull()), box, F.coalesce(start, year), F.when(ranged, end), licence


def normalise_catalog(landed: DataFrame) -> DataFrame:
    """Landed payloads (provider, payload JSON text) of STAC, CKAN, CMR, OGC Records, Socrata, data.gov and DataCite to one asset schema.

    Unknown providers are left out.
    """
    j = lambda path: F.get_json_object("payload", path)
    words = lambda path: F.from_json(j(path), "array<string>")
    numbers = lambda path: F.from_json(j(path), "array<double>")
    none = F.lit(None).cast("string")
    made = {
        "stac": (j("$.id"), j("$.properties.title"), j("$.properties.description"), words("$.properties.keywords"), numbers("$.bbox"), F.coalesce(j("$.properties.start_datetime"), j("$.properties.datetime")), j("$.properties.end_datetime"), j("$.properties.license")),
        "ckan": (j("$.name"), j("$.title"), j("$.notes"), F.transform(F.from_json(j("$.tags"), "array<struct<name:string>>"), lambda t: t["name"]), F.lit(None).cast("array<double>"), j("$.metadata_created"), none, j("$.license_id")),
        "cmr": (j("$.id"), j("$.dataset_id"), j("$.summary"), F.lit(None).cast("array<string>"), F.transform(F.split(j("$.boxes[0]"), " "), lambda x: x.try_cast("double")), j("$.time_start"), j("$.time_end"), none),
        "ogc-records": (
            F.coalesce(j("$.id"), j("$.properties.identifier"), j("$.properties.id")), F.coalesce(j("$.properties.title"), j("$.properties.name"), j("$.id")), j("$.properties.description"), words("$.properties.keywords"),
            F.coalesce(numbers("$.bbox"), numbers("$.properties.bbox")), j("$.properties.datetime"), j("$.properties.end_datetime"), j("$.properties.license"),
        ),
        "socrata": (
            F.coalesce(j("$.resource.id"), j("$.permalink"), j("$.link")), F.coalesce(j("$.resource.name"), F.lit("Untitled Socrata dataset")), j("$.resource.description"),
            F.filter(F.concat(*[F.coalesce(words(p), F.array().cast("array<string>")) for p in ("$.classification.tags", "$.classification.domain_tags")], F.array(j("$.classification.domain_category"))), lambda t: t.isNotNull() & (t != "")),
            F.lit(None).cast("array<double>"), j("$.resource.createdAt"), j("$.resource.updatedAt"), j("$.resource.license"),
        ),
        "datagov": (
            F.coalesce(j("$.identifier"), j("$.dcat.identifier"), j("$.dcat.landingPage")), F.coalesce(j("$.title"), j("$.dcat.title"), F.lit("Untitled dataset")), F.coalesce(j("$.description"), j("$.dcat.description")),
            F.coalesce(words("$.keyword"), words("$.dcat.keyword")), bounds_of(j("$.spatial_shape")), *interval(F.nullif(j("$.dcat.temporal"), F.lit(""))), F.coalesce(j("$.dcat.license"), j("$.publisher.license")),
        ),
        "datacite": _datacite(j, words),
    }
    names = [p.split()[0] for p in ASSET.split(", ") if not p.startswith("source")]
    out = None
    for provider, columns in made.items():
        one = landed.where(F.col("provider") == provider).select(F.lit(provider).alias("source"), *[c.alias(n) for n, c in zip(names, columns, strict=True)])
        out = one if out is None else out.unionByName(one)
    return out


def write_layer(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """GeoJSON features, one a line: times as ISO text, numbers that aren't finite as null."""
    props = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c).cast("string").alias(c) if t.startswith(("timestamp", "date")) else F.col(c) for c, t in df.dtypes if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: str) -> None:
    """CSV with a header, sorted by a column from the largest on."""
    df.orderBy(F.col(by).desc_nulls_last()).write.mode("overwrite").csv(path, header=True)


def write_parquet_layer(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_docs(df: DataFrame, path: str, key: str) -> None:
    """JSON lines {_id, _source} of every row."""
    df.select(F.to_json(F.struct(F.col(key).cast("string").alias("_id"), F.struct(*[c for c in df.columns if c != key]).alias("_source"))).alias("value")).write.mode("overwrite").text(path)


def import_docs(spark: SparkSession, path: str, source_schema: str) -> DataFrame:
    """Documents back from JSON lines, wrapped in _source or flat."""
    raw = spark.read.text(path)
    wrapped = F.from_json("value", f"_id string, _source struct<{source_schema}>")
    flat = F.from_json("value", f"struct<_id:string,{source_schema}>")
    return raw.select(F.get_json_object("value", "$._id").alias("_id"), F.when(F.get_json_object("value", "$._source").isNotNull(), wrapped["_source"]).otherwise(F.struct(*[flat[p.split(":")[0].strip()] for p in source_schema.split(",")])).alias("s")).select("_id", "s.*")
