"""Queries of learners, sources, sinks and streams."""

from __future__ import annotations

import posixpath
import struct
import uuid
from datetime import timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from loamgrid.functions import registered
from loamgrid.operators import learning as L
from loamgrid.plans import views as V
from loamgrid.plans.durable import checkpoint_dir
from loamgrid.plans.spatial import METRES_SQL
from loamgrid.plans.views import read
from loamgrid.sources import files as S
from loamgrid.streaming import jobs as J


def _folder(spark, name):
    return posixpath.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def p06(spark, d):
    return L.look_alike_groups(read(spark, d, "embeddings"), "vec_id", "embedding", 10)


def p07(spark, d):
    """Ridge predictions of a label's number from vectors at the places of the events of their ids, by held-out blocks of space."""
    places = V.event_points(spark, d).select(F.col("event_id").alias("vec_id"), "lon", "lat")
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")).join(places, "vec_id")
    out = L.ridge_block_cv(L.space_blocks(e, "lon", "lat", 5), "label", "v", "block")
    return out.select("n", "blocks", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "naive_r2", "skill")])


def p08(spark, d):
    """Colours of all vectors in one basis: three components, each from 0 to 1."""
    out = L.shared_pca(read(spark, d, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", *[F.round(F.get("colours", F.lit(k)), 6).alias(c) for k, c in enumerate(("red", "green", "blue"))])


def g11(spark, d):
    e = V.event_points(spark, d).select("event_type", "lon", "lat")
    return L.convex_hull(e, "event_type", "lon", "lat").select("event_type", F.size("hull").alias("corners"), F.round(F.array_min(F.transform("hull", lambda p: p["x"])), 6).alias("xmin"), F.round(F.array_max(F.transform("hull", lambda p: p["y"])), 6).alias("ymax"))


def s01(spark, d):
    """A layer written and read again as CSV."""
    path = _folder(spark, "sites") + ".csv"
    S.write_table(V.site_points(spark, d), path, "balance")
    back = S.points_from_table(S.read_layer(spark, path))
    return back.select(F.col("site_id").cast("long").alias("site_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("balance").cast("double").alias("balance"))


def s01_kinds(spark, d):
    """One layer written as Parquet, GeoJSON, JSON lines, CSV and TSV, and each read by its suffix."""
    sites = V.site_points(spark, d)
    base = _folder(spark, "kinds")
    sites.write.parquet(f"{base}.parquet")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("site_id", "balance", "lon", "lat").alias("properties"))
    features = sites.groupBy(F.floor(F.col("site_id") / 64).alias("k")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    features.repartition("k").select("value").write.text(f"{base}.geojson")
    sites.write.json(f"{base}.jsonl")
    S.write_table(sites, f"{base}.csv", "balance")
    sites.withColumnsRenamed({"lon": "Longitude", "lat": "LAT"}).write.csv(f"{base}.tsv", header=True, sep="\t")
    out = []
    for kind in ("parquet", "geojson", "jsonl", "csv", "tsv"):
        layer = S.explode_geojson(spark, f"{base}.geojson", one_a_line=True) if kind == "geojson" else S.read_layer(spark, f"{base}.{kind}")
        at = S.points_from_table(layer)
        out.append(at.select(F.lit(kind).alias("kind"), F.col("site_id").cast("long").alias("site_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("balance").cast("double").alias("balance")))
    return reduce(lambda a, b: a.unionByName(b), out)


def s03(spark, d):
    """Features written as GeoJSON, one a line, read again."""
    path = _folder(spark, "layer")
    S.write_layer(V.site_points(spark, d), path)
    raw = spark.read.json(path)
    return raw.select(F.col("properties.site_id").alias("site_id"), F.col("geometry.type").alias("kind"), F.round(F.col("geometry.coordinates")[0], 6).alias("lon"))


def s03_collections(spark, d):
    """Features gathered in collections of 64, landed as lines, and taken apart again."""
    path = _folder(spark, "collections")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("site_id", "balance").alias("properties"))
    sites = V.site_points(spark, d)
    made = sites.groupBy(F.floor(F.col("site_id") / 64).alias("k")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    made.repartition("k").select("value").write.option("lineSep", "\n").text(path)
    back = S.explode_geojson(spark, path, one_a_line=True)
    return back.select(F.col("site_id").cast("long").alias("site_id"), "geometry_type", F.round(F.get_json_object("geometry", "$.coordinates[1]").cast("double"), 6).alias("lat"))


def s08(spark, d):
    """Conversations as notebooks, one a line, and their cells in order."""
    path = _folder(spark, "notebooks")
    c = read(spark, d, "conversations")
    cell = F.struct("turn", F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"), F.array(F.col("role"), F.lit("\n"), F.md5(F.encode("text", "UTF-8"))).alias("source"))
    books = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    books.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("name"), "cells")).alias("value")).write.text(path)
    return S.notebook_cells(spark, path, one_a_line=True).select(F.col("name").cast("long").alias("conv_id"), "cell", "kind", "source")


def s14(spark, d):
    """A layer joined with its areas, written as Parquet by area and read again."""
    path = _folder(spark, "parquet-layer")
    sites = V.site_points(spark, d).withColumn("zone", F.col("site_id") % 4)
    S.write_parquet_layer(sites.select("site_id", "zone", "balance"), path, ["zone"])
    return spark.read.parquet(path).groupBy("zone").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance")).select(F.col("zone").cast("long").alias("zone"), "n", "balance")


def s04(spark, d):
    p = read(spark, d, "part")
    raw = p.select(F.when(F.col("p_partkey") % 17 == 0, " ").otherwise((F.col("p_partkey") % 1500).cast("string")).alias("id"), F.split("p_name", " ").alias("tags"), F.when((F.col("p_partkey") % 1500) % 7 == 0, "private").when((F.col("p_partkey") % 1500) % 7 < 4, "Public").alias("visibility"))
    return S.load_elements(raw).select("id").orderBy("id")


def s05(spark, d):
    """Points of events and rings of areas, described."""
    events = S.profile(V.event_points(spark, d).select("event_id", "ts", "value", "lon", "lat"))
    areas = S.profile(V.area_diamonds(spark, d).select("area_id", "area", "ring"), ring="ring")
    both = events.unionByName(areas)
    return both.select("features", "geometry", F.array_join("types", ", ").alias("types"), "vertices", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def s06(spark, d):
    """Pages and the tables' own bytes, by what they begin with."""
    pages = read(spark, d, "pages").select(F.encode("html", "UTF-8").alias("content"))
    numbers = read(spark, d, "part").select(F.encode(F.concat_ws(",", "p_partkey", "p_name"), "UTF-8").alias("content"))
    images = read(spark, d, "nation").select(F.unhex(F.when(F.col("n_nationkey") % 2 == 0, "89504E470D0A1A0A").otherwise("49492A0008000000")).alias("content"))
    kind, family = S.sniff(F.col("content"))
    return pages.unionByName(numbers).unionByName(images).groupBy(kind.alias("kind"), family.alias("family")).agg(F.count("*").alias("n"))


def _packed_headers(batches):
    """LAS, SHP, DBF and TIFF files with the count and bounds of each row (zone, n, xmin, ymin, xmax, ymax)."""
    for b in batches:
        rows = []
        for zone, n, xmin, ymin, xmax, ymax in zip(*(b.column(c).to_pylist() for c in ("zone", "n", "xmin", "ymin", "xmax", "ymax")), strict=True):
            las = bytearray(375)
            las[:4], las[25] = b"LASF", 4 if zone % 2 else 2
            struct.pack_into("<I", las, 107, 0 if zone % 2 else n)
            struct.pack_into("<4d", las, 179, xmax, xmin, ymax, ymin)
            struct.pack_into("<Q", las, 247, n)
            shp = bytearray(100)
            struct.pack_into(">I", shp, 0, 9994)
            struct.pack_into("<4d", shp, 36, xmin, ymin, xmax, ymax)
            dbf = struct.pack("<B3xIHH20x", 3, n, 32 + 2 * 32 + 1, 40) + b"site_id".ljust(32, b"\0") + b"balance".ljust(32, b"\0") + b"\r"
            e, at = "<" if zone % 3 else ">", 70_000 if zone % 2 else 8  # half of the directories lie beyond the bytes that are read first
            tiff = (b"II*\0" if zone % 3 else b"MM\0*") + struct.pack(e + "I", at) + bytes(at - 8) + struct.pack(e + "H", 4)
            for tag, kind, count, value in ((256, 3, 1, None), (257, 4, 1, zone + 1), (33550, 12, 3, at + 60), (33922, 12, 6, at + 84)):
                tiff += struct.pack(e + "HHI", tag, kind, count) + (struct.pack(e + "HH", n, 0) if value is None else struct.pack(e + "I", value))
            tiff += bytes(at + 60 - len(tiff)) + struct.pack(e + "9d", 0.01, 0.01, 0, 0, 0, 0, xmin, ymax, 0)
            rows += [(f"zone={zone}/site.{k}", bytes(c)) for k, c in (("las", las), ("shp", shp), ("dbf", dbf), ("tif", tiff))]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])


def _header_files(spark, d):
    """A layer's zones as CSV files that were landed, and as files of four more kinds with the same counts and bounds."""
    path = _folder(spark, "headers")
    sites = V.site_points(spark, d).withColumn("zone", F.col("site_id") % 8)
    sites.repartition("zone").write.partitionBy("zone").csv(path)
    landed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path).select("path", "content")
    bounds = sites.groupBy("zone").agg(F.count("*").alias("n"), *[f(c).alias(n) for n, f, c in (("xmin", F.min, "lon"), ("ymin", F.min, "lat"), ("xmax", F.max, "lon"), ("ymax", F.max, "lat"))])
    return landed.unionByName(bounds.mapInArrow(_packed_headers, "path string, content binary"))


def _by_zone(catalog):
    zone = F.regexp_extract("path", r"zone=(\d+)", 1).cast("long").alias("zone")
    box = [F.round(F.max(c), 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    names = F.when(F.col("kind") == "dbf", F.array_join("fields", ","))
    return catalog.groupBy("kind", zone).agg(F.sum("n").alias("n"), *box, F.max("width").alias("width"), F.max("height").alias("height"), F.max(names).alias("fields"))


def s07(spark, d):
    """The headers of files of five kinds, one of each zone."""
    return _by_zone(S.header_catalog(_header_files(spark, d)))


def s07_sql(spark, d):
    """The same by the table function that SQL knows by name."""
    registered.register(spark)
    _header_files(spark, d).createOrReplaceTempView("loamgrid_files")
    return _by_zone(spark.sql("SELECT f.path, h.* FROM loamgrid_files AS f, LATERAL file_header(f.path, f.content) AS h"))


def f_registered(spark, d):
    """Landed map elements by a table function, distances by a SQL function, and an aggregate of one's own, all in one SQL text."""
    registered.register(spark)
    V.site_points(spark, d).createOrReplaceTempView("loamgrid_sites")
    return spark.sql("""
        WITH e AS (SELECT site_id, balance, lon, lat, to_json(named_struct('type', if(site_id % 3 = 0, 'node', 'way'), 'id', site_id, 'lon', lon, 'lat', lat, 'tags', map('building', 'yes'),
            'geometry', array(named_struct('lon', lon, 'lat', lat), named_struct('lon', lon + 1, 'lat', lat), named_struct('lon', lon, 'lat', lat + 1), named_struct('lon', lon, 'lat', if(site_id % 3 = 1, lat, lat + 2))))) AS element FROM loamgrid_sites),
        f AS (SELECT e.*, f.kind, f.n_points FROM e, LATERAL osm_feature(e.element) AS f),
        m AS (SELECT kind, round(weighted_median(CAST(balance AS DOUBLE), abs(CAST(balance AS DOUBLE))), 2) AS middle FROM f GROUP BY kind)
        SELECT f.kind, count(*) AS n, sum(f.n_points) AS points, round(sum(haversine_m(f.lon, f.lat, -87.5D, 41.5D)), 1) AS metres, any_value(m.middle) AS middle,
            count_if(in_box(f.lon, f.lat, -88.0D, 41.0D, -87.5D, 41.5D)) AS inside, round(sum(as_number(concat('1,', lpad(cast(f.site_id % 1000 AS STRING), 3, '0'))))) AS numbers
        FROM f JOIN m ON m.kind = f.kind GROUP BY f.kind""")


def s09(spark, d):
    """Parts as payloads of six kinds of catalogue, with the fields of each that may be missing."""
    p = read(spark, d, "part").withColumn("k", F.col("p_partkey") % 6)
    key, even = F.col("p_partkey").cast("string"), F.floor(F.col("p_partkey") / 6) % 2 == 0
    lon = (F.col("p_partkey") % 90).cast("double")
    name = lambda c, n: c.alias(n)
    payloads = {
        "stac": F.struct(name(key, "id"), F.struct(name(F.col("p_name"), "title"), F.lit("x").alias("description"), F.array("p_type").alias("keywords"), F.lit("2020-01-01").alias("datetime")).alias("properties"), F.array(F.lit(-88.0), F.lit(41.0), F.lit(-87.0), F.lit(42.0)).alias("bbox")),
        "ckan": F.struct(name(key, "name"), name(F.col("p_name"), "title"), F.array(F.struct(name(F.col("p_type"), "name"))).alias("tags"), F.lit("2020-01-01").alias("metadata_created")),
        "ogc-records": F.struct(name(F.when(even, key), "id"), F.struct(name(key, "identifier"), name(F.when(even, F.col("p_name")), "title"), name(F.col("p_brand"), "name"), F.array("p_type", "p_brand").alias("keywords"), F.array(lon, lon, lon + 1, lon + 2).alias("bbox"), F.lit("2019-05-06").alias("datetime"), F.lit("2021-05-06").alias("end_datetime")).alias("properties")),
        "socrata": F.struct(F.struct(name(F.when(even, key), "id"), name(F.col("p_name"), "name"), F.lit("2018-01-01").alias("createdAt"), F.lit("2018-02-02").alias("updatedAt"), F.lit("CC0").alias("license")).alias("resource"), F.struct(F.array("p_type").alias("tags"), F.array("p_brand").alias("domain_tags"), F.when(even, F.lit("Crime")).alias("domain_category")).alias("classification"), F.concat(F.lit("https://x.example/"), key).alias("permalink")),
        "datagov": F.struct(name(F.when(even, F.col("p_name")), "title"), F.struct(name(key, "identifier"), name(F.col("p_brand"), "title"), F.array("p_type").alias("keyword"), F.when(even, F.lit("2001-01-01/2002-02-02")).otherwise("2003-03-03").alias("temporal"), F.lit("public").alias("license")).alias("dcat"), F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.array(lon, lon - 1), F.array(lon + 3, lon), F.array(lon, lon + 2))).alias("coordinates")).alias("spatial_shape")),
        "datacite": F.struct(F.struct(name(key, "doi"), F.array(F.struct(name(F.col("p_name"), "title"))).alias("titles"), F.array(F.struct(name(F.col("p_type"), "subject"))).alias("subjects"),
            F.array(F.struct(F.lit("short").alias("description"), F.lit("Abstract").alias("descriptionType")), F.struct(F.lit("longer than it").alias("description"), F.lit("Abstract").alias("descriptionType")), F.struct(F.lit("the longest of them all").alias("description"), F.lit("Other").alias("descriptionType"))).alias("descriptions"),
            F.when(even, F.array(F.struct(F.lit("2010").alias("date"), F.lit("Issued").alias("dateType")), F.struct(F.lit("2001-01-01/2010-12-31").alias("date"), F.lit("Collected").alias("dateType")))).alias("dates"), F.lit(1999).alias("publicationYear"),
            F.array(F.struct(F.when(even, F.struct(name((lon + 5).cast("string"), "westBoundLongitude"), name(lon.cast("string"), "eastBoundLongitude"), F.lit("1").alias("southBoundLatitude"), F.lit("2").alias("northBoundLatitude"))).alias("geoLocationBox"), F.struct(name(lon.cast("string"), "pointLongitude"), F.lit("7.5").alias("pointLatitude")).alias("geoLocationPoint"))).alias("geoLocations"),
            F.array(F.struct(F.lit("some rights").alias("rights")), F.struct(F.lit("CC-BY-4.0").alias("rights"))).alias("rightsList")).alias("attributes")),
    }
    provider, payload = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for n, (k, v) in enumerate(payloads.items()):
        provider, payload = provider.when(F.col("k") == n, k), payload.when(F.col("k") == n, F.to_json(v))
    found = S.normalise_catalog(p.select(provider.alias("provider"), payload.alias("payload")))
    return found.select("id", "source", "title", "abstract", F.array_join("keywords", ",").alias("keywords"), *[F.element_at("bbox", k + 1).alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))], "start", "end", "license")


def s10(spark, d):
    s = V.site_points(spark, d)
    at = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    ring = F.array(at(0, 0), at(0.01, 0), at(0.01, 0.01), at(0, 0))
    way = F.when(F.col("site_id") % 4 == 3, F.slice(ring, 1, 1)).otherwise(ring)
    tags = F.when(F.col("site_id") % 4 == 1, F.create_map(F.lit("building"), F.lit("yes"))).otherwise(F.create_map(F.lit("highway"), F.lit("path")))
    elements = s.select(F.when(F.col("site_id") % 4 == 0, "node").otherwise("way").alias("type"), F.col("site_id").alias("id"), "lon", "lat", tags.alias("tags"), F.when(F.col("site_id") % 4 != 0, way).alias("geometry"))
    return S.osm_features(elements).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("coordinates")).alias("points"))


def s11(spark, d):
    s = read(spark, d, "supplier")
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("POINT ("), F.col("s_suppkey"), F.lit(" 4.5)"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("LINESTRING (1 2, "), F.col("s_suppkey"), F.lit(" 7)"))).otherwise("EMPTY")
    return s.select("s_suppkey", S.geo_shape(text).alias("shape"))


def s24(spark, d):
    path = _folder(spark, "export")
    S.export_docs(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path, "c_custkey")
    return S.import_docs(spark, path, "c_name:string,c_nationkey:int").select(F.col("_id").cast("int").alias("c_custkey"), "c_name", "c_nationkey")


def _events(spark, d):
    return J.stream_of(spark, f"{d}/events.parquet")


def x01(spark, d):
    out = J.drain(J.period_counts(_events(spark, d), "ts"), "update")
    last = out.groupBy("start").agg(F.max_by("n", "__batch").alias("n"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def x02(spark, d):
    out = J.drain(J.usage_by_day(_events(spark, d), "user_id", "ts", "value"), "update")
    last = out.groupBy("user_id", "start").agg(F.max_by(F.struct("turns", "spent"), "__batch").alias("v"))
    return last.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "v.turns", F.round("v.spent", 6).alias("spent"))


def x03(spark, d):
    e = _events(spark, d)
    return J.drain(J.dedupe_calls(e.unionByName(e), "event_id", "ts"), "append").select("event_id", "event_type")


def x04(spark, d):
    """Turns land in three waves, the second with turns of all conversations that the first left out, the third with repeats."""
    landing, turns = _folder(spark, "turns"), read(spark, d, "conversations").select("conv_id", "turn")
    late = (F.col("conv_id") + F.col("turn")) % 3 == 0
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for wave in (turns.where(~late), turns.where(late), turns.where("conv_id % 4 = 0")):
        wave.repartition(files).write.mode("append").parquet(landing)
    out = J.drain(J.session_ring(J.stream_of(spark, f"{landing}/*.parquet", files), "conv_id", "turn", 3), "update")
    last = out.groupBy("conv_id").agg(F.max_by(F.struct("turns", "seen"), "__batch").alias("v"))
    return last.select("conv_id", F.array_join(F.transform("v.turns", lambda t: t.cast("string")), ",").alias("turns"), "v.seen")


def x05(spark, d):
    """Events land in three waves in order of time, but a tenth of them a wave later than they should; a last file tells that no more will come."""
    landing = _folder(spark, "calls")
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.concat_ws("|", "event_type", "props").alias("digest"), (F.col("event_type") == "purchase").alias("change"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    wave = F.least(F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit(first))) * 3 / (F.unix_seconds(F.lit(last)) - F.unix_seconds(F.lit(first)) + 1)) + (F.col("event_id") % 10 == 0).cast("int"), F.lit(2))
    end = e.limit(1).select("user_id", F.lit(last + timedelta(days=60)).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("digest"), F.lit(False).alias("change"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in (*(e.where(wave == k).repartition(files) for k in range(3)), end):
        part.write.mode("append").parquet(landing)
    days = (last - first).days * 2 // 3 + 2  # a call that comes a wave late is ahead of the watermark, wherever batches end
    out = J.drain(J.repeat_detector(J.stream_of(spark, f"{landing}/*.parquet", files), "user_id", "ts", "event_id", "digest", "change", f"{days} days"), "append")
    return out.where("event_id >= 0").select("user_id", "event_id", "repeated")


def x06(spark, d):
    """Conversations land in three waves: all, a third changed and shorter, a fifth as at first; then a seventh has vanished."""
    landing, store = _folder(spark, "landing"), _folder(spark, "store")
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    third = turns.where("conv_id % 3 = 0 and turn > 0").withColumn("text", F.concat("text", F.lit("2")))
    out = None
    for k, wave in enumerate((turns, third, turns.where("conv_id % 5 = 0"))):
        wave.select("conv_id", "turn", F.md5(F.encode("text", "UTF-8")).alias("digest")).write.mode("append").parquet(landing)
        alive = turns.where("conv_id % 7 <> 0").select("conv_id") if k == 2 else None
        out = J.ingest_changed(J.stream_of(spark, f"{landing}/*.parquet"), store, "conv_id", alive=alive)
    return out.select("conv_id", "turn", "digest")


def x07(spark, d):
    out = J.drain(J.trace_summary(_events(spark, d), "user_id", "event_type"), "update")
    names = [c for c in out.columns if c.startswith("n_")]
    return out.groupBy("user_id").agg(F.max_by(F.struct(*names), "__batch").alias("v")).select("user_id", "v.*")


QUERIES = {
    "g11_convex_hull": g11, "p06_look_alike_groups": p06, "p07_ridge_block_cv": p07, "p08_shared_pca": p08, "s01_csv_round_trip": s01, "s01_layer_kinds": s01_kinds, "s03_geojson_round_trip": s03, "s03_feature_collections": s03_collections, "s08_notebook_cells": s08, "s14_parquet_layer": s14, "s04_load_elements": s04, "s05_profile_layer": s05, "s06_sniff": s06, "s07_header_catalog": s07, "s07_header_table_function": s07_sql, "u_registered_functions": f_registered,
    "s09_normalise_catalog": s09, "s10_osm_features": s10, "s11_wkt_to_shape": s11, "s24_export_and_import": s24, "x01_stream_period_counts": x01, "x02_stream_usage": x02, "x03_stream_dedupe": x03, "x04_stream_session_ring": x04,
    "x05_stream_repeats": x05, "x06_stream_ingest": x06, "x07_stream_trace_summary": x07,
}

# the rules of each catalogue on its fields: what goes first, what stands in, what is left empty
_S09 = """WITH p AS (SELECT *, p_partkey % 6 AS k, p_partkey // 6 % 2 = 0 AS even, (p_partkey % 90)::DOUBLE AS lon, p_partkey::VARCHAR AS key FROM part)
SELECT CASE WHEN k = 3 AND NOT even THEN 'https://x.example/' || key ELSE key END AS id, ['stac', 'ckan', 'ogc-records', 'socrata', 'datagov', 'datacite'][k + 1] AS source, CASE WHEN k IN (2, 4) AND NOT even THEN p_brand ELSE p_name END AS title,
CASE k WHEN 0 THEN 'x' WHEN 5 THEN 'longer than it' END AS abstract, p_type || CASE WHEN k = 2 THEN ',' || p_brand WHEN k = 3 THEN ',' || p_brand || CASE WHEN even THEN ',Crime' ELSE '' END ELSE '' END AS keywords,
CASE k WHEN 0 THEN -88.0::DOUBLE WHEN 2 THEN lon WHEN 4 THEN lon WHEN 5 THEN lon END AS xmin, CASE k WHEN 0 THEN 41.0::DOUBLE WHEN 2 THEN lon WHEN 4 THEN lon - 1 WHEN 5 THEN CASE WHEN even THEN 1.0 ELSE 7.5 END END AS ymin,
CASE k WHEN 0 THEN -87.0::DOUBLE WHEN 2 THEN lon + 1 WHEN 4 THEN lon + 3 WHEN 5 THEN CASE WHEN even THEN lon + 5 ELSE lon END END AS xmax, CASE k WHEN 0 THEN 42.0::DOUBLE WHEN 2 THEN lon + 2 WHEN 4 THEN lon + 2 WHEN 5 THEN CASE WHEN even THEN 2.0 ELSE 7.5 END END AS ymax,
CASE k WHEN 2 THEN '2019-05-06' WHEN 3 THEN '2018-01-01' WHEN 4 THEN CASE WHEN even THEN '2001-01-01' ELSE '2003-03-03' END WHEN 5 THEN CASE WHEN even THEN '2001-01-01' ELSE '1999-01-01' END ELSE '2020-01-01' END AS start,
CASE k WHEN 2 THEN '2021-05-06' WHEN 3 THEN '2018-02-02' WHEN 4 THEN CASE WHEN even THEN '2002-02-02' ELSE '2003-03-03' END WHEN 5 THEN CASE WHEN even THEN '2010-12-31' END END AS "end",
CASE k WHEN 3 THEN 'CC0' WHEN 4 THEN 'public' WHEN 5 THEN 'some rights' END AS license FROM p"""
_S07 = """, z AS (SELECT site_id % 8 AS zone, count(*) AS n, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM site_points GROUP BY 1)
SELECT kind, zone, CASE WHEN kind IN ('csv', 'las', 'dbf') THEN n END::BIGINT AS n, round(CASE WHEN kind IN ('las', 'shp', 'tiff') THEN x0 END, 6) AS xmin,
round(CASE WHEN kind IN ('las', 'shp') THEN y0 WHEN kind = 'tiff' THEN y1 - (zone + 1) * 0.01::DOUBLE END, 6) AS ymin, round(CASE WHEN kind IN ('las', 'shp') THEN x1 WHEN kind = 'tiff' THEN x0 + n * 0.01::DOUBLE END, 6) AS xmax,
round(CASE WHEN kind IN ('las', 'shp', 'tiff') THEN y1 END, 6) AS ymax, CASE WHEN kind = 'tiff' THEN n END::BIGINT AS width, CASE WHEN kind = 'tiff' THEN zone + 1 END::BIGINT AS height, CASE WHEN kind = 'dbf' THEN 'site_id,balance' END AS fields
FROM z, (VALUES ('las'), ('shp'), ('dbf'), ('tiff'), ('csv')) k(kind)"""

SQL = {
    "s01_layer_kinds": V.sql_with("site_points", body=" SELECT kind, site_id, round(lon, 6) AS lon, round(lat, 6) AS lat, balance FROM site_points, (VALUES ('parquet'), ('geojson'), ('jsonl'), ('csv'), ('tsv')) k(kind)"),
    "s01_csv_round_trip": V.sql_with("site_points", body=" SELECT site_id, round(lon, 6) AS lon, round(lat, 6) AS lat, balance FROM site_points"),
    "s03_geojson_round_trip": V.sql_with("site_points", body=" SELECT site_id, 'Point' AS kind, round(lon, 6) AS lon FROM site_points"),
    "s03_feature_collections": V.sql_with("site_points", body=" SELECT site_id, 'Point' AS geometry_type, round(lat, 6) AS lat FROM site_points"),
    "s08_notebook_cells": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS cell, CASE WHEN role = 'assistant' THEN 'code' ELSE 'markdown' END AS kind, role || chr(10) || md5(text) AS source FROM conversations",
    "s14_parquet_layer": V.sql_with("site_points", body=" SELECT site_id % 4 AS zone, count(*) AS n, round(sum(balance), 2) AS balance FROM site_points GROUP BY 1"),
    "s04_load_elements": "SELECT DISTINCT (p_partkey % 1500)::VARCHAR AS id FROM part WHERE p_partkey % 17 <> 0 AND (p_partkey % 1500) % 7 <> 0",
    "s05_profile_layer": V.sql_with("event_points", "area_boxes", body=", d AS (SELECT column_name AS c, CASE column_type WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS t FROM (DESCRIBE events) UNION ALL SELECT 'area_id', CASE column_type WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END FROM (DESCRIBE nation) WHERE column_name = 'n_nationkey') SELECT count(*) AS features, 'Point' AS geometry, (SELECT string_agg(c || ': ' || t, ', ' ORDER BY c) FROM d WHERE c IN ('event_id', 'ts', 'value')) AS types, count(*) AS vertices, round(min(lon), 6) AS xmin, round(min(lat), 6) AS ymin, round(max(lon), 6) AS xmax, round(max(lat), 6) AS ymax FROM event_points UNION ALL SELECT count(*), 'Polygon', (SELECT 'area_id: ' || t || ', area: string' FROM d WHERE c = 'area_id'), 5 * count(*), round(min(xmin), 6), round(min(ymin), 6), round(max(xmax), 6), round(max(ymax), 6) FROM area_boxes"),
    "s06_sniff": "SELECT 'html' AS kind, 'metadata' AS family, count(*) AS n FROM pages UNION ALL SELECT 'csv', 'tabular', count(*) FROM part UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'png' ELSE 'tiff' END, 'raster', count(*) FROM nation GROUP BY 1",
    "s07_header_catalog": V.sql_with("site_points", body=_S07),
    "s07_header_table_function": V.sql_with("site_points", body=_S07),
    "u_registered_functions": V.sql_with("site_points", body=f""", s AS (SELECT *, {METRES_SQL.format(x1='lon', y1='lat', x2='-87.5::DOUBLE', y2='41.5::DOUBLE')} AS m, CASE site_id % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' ELSE 'LineString' END AS kind FROM site_points),
w AS (SELECT *, sum(abs(balance)) OVER (PARTITION BY kind ORDER BY balance ROWS UNBOUNDED PRECEDING) AS reached, sum(abs(balance)) OVER (PARTITION BY kind) AS total FROM s)
SELECT kind, count(*) AS n, sum(CASE WHEN kind = 'Point' THEN 1 ELSE 4 END)::BIGINT AS points, round(sum(m), 1) AS metres, round(min(balance) FILTER (reached >= total / 2), 2) AS middle,
count(*) FILTER (lon >= -88 AND lon < -87.5 AND lat >= 41 AND lat < 41.5) AS inside, round(sum(1000 + site_id % 1000))::DOUBLE AS numbers FROM w GROUP BY kind"""),
    "s09_normalise_catalog": _S09,
    "s10_osm_features": "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' ELSE 'LineString' END AS kind, count(*) AS n, sum(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 4 END)::BIGINT AS points FROM supplier WHERE s_suppkey % 4 <> 3 GROUP BY 1",
    "s11_wkt_to_shape": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '{"type":"point","coordinates":[' || s_suppkey || '.0,4.5]}' WHEN 1 THEN '{"type":"envelope","coordinates":[[1.0,2.0],[' || s_suppkey || '.0,7.0]]}' END AS shape FROM supplier""",
    "s24_export_and_import": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "x01_stream_period_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1",
    "x02_stream_usage": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS turns, round(sum(value), 6) AS spent FROM events GROUP BY 1, 2",
    "x03_stream_dedupe": "SELECT event_id, event_type FROM events",
    "x04_stream_session_ring": "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) * CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 1 END AS seen FROM conversations) SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns, any_value(seen) AS seen FROM r WHERE n <= 3 GROUP BY 1",
    "x05_stream_repeats": "WITH w AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS world FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, world, event_type, props ORDER BY ts, event_id) > 1 AS repeated FROM w",
    "x06_stream_ingest": "WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) > 0 AS longer FROM conversations WHERE conv_id % 7 <> 0) SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND conv_id % 5 <> 0 AND longer THEN md5(text || '2') ELSE md5(text) END AS digest FROM c WHERE NOT (conv_id % 3 = 0 AND conv_id % 5 <> 0 AND longer AND turn = 0)",
    "x07_stream_trace_summary": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("error", "click", "view", "purchase", "signup")) + " FROM events GROUP BY 1",
}
