"""Region enrichment: city first, then the first matching box, then a default. No Python function per row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

DEFAULT_REGION = "UNKNOWN"


@dataclass(frozen=True)
class Box:
    code: str
    min_lat: float | None = None
    max_lat: float | None = None
    min_lon: float | None = None
    max_lon: float | None = None


# Ordered region boxes, first match wins.
BOXES = (
    Box("NA", 15.0, 72.0, -170.0, -50.0),
    Box("SA", -56.0, 13.0, -82.0, -34.0),
    Box("EU", 35.0, 72.0, -25.0, 65.0),
    Box("AS", -10.0, 77.0, 65.0, 180.0),
    Box("AF", -35.0, 37.0, -18.0, 52.0),
    Box("OC", -50.0, 0.0, 110.0, 180.0),
)
# City -> (region, latitude, longitude).
CITIES = {
    "New York": ("NA", 40.7128, -74.0060),
    "Los Angeles": ("NA", 34.0522, -118.2437),
    "London": ("EU", 51.5074, -0.1278),
    "Paris": ("EU", 48.8566, 2.3522),
    "Tokyo": ("AS", 35.6762, 139.6503),
    "Sydney": ("OC", -33.8688, 151.2093),
    "São Paulo": ("SA", -23.5505, -46.6333),
    "Mumbai": ("AS", 19.0760, 72.8777),
    "Singapore": ("AS", 1.3521, 103.8198),
    "Dubai": ("AS", 25.2048, 55.2708),
}


def region_by_city(city: Column, cities: dict[str, tuple] = CITIES, default: str = DEFAULT_REGION) -> Column:
    """Case-insensitive; a NULL city gives the default, an unknown one gives NULL (fall through).

    One look into a constant map: in a chain of conditions each of them would lower and trim the city again.
    """
    codes: dict[str, str] = {}
    for name, (code, *_rest) in cities.items():
        if name == name.title():
            codes.setdefault(name.lower(), code)
    if not codes:
        return F.when(city.isNull(), F.lit(default))
    found = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.lower(F.trim(city))]
    return F.when(city.isNull(), F.lit(default)).otherwise(found)


def region_by_box(lat: Column, lon: Column, boxes: Sequence[Box] = BOXES, default: str = DEFAULT_REGION) -> Column:
    """Inclusive bounds in file order; a missing bound is the edge of the world. For up to a few dozen boxes."""
    chain = F.when(lat.isNull() | lon.isNull(), F.lit(default))
    for b in boxes:
        edge = lambda v, world: world if v is None else v
        inside = lat.between(edge(b.min_lat, -90.0), edge(b.max_lat, 90.0)) & lon.between(
            edge(b.min_lon, -180.0), edge(b.max_lon, 180.0))
        chain = chain.when(inside, b.code)
    return chain.otherwise(default)


def enrich_region(df: DataFrame, city: str = "city", lat: str = "lat", lon: str = "lon", out: str = "region",
                  boxes: Sequence[Box] = BOXES, cities: dict[str, tuple] = CITIES, default: str = DEFAULT_REGION) -> DataFrame:
    """Absent columns count as NULL. An empty or NULL city goes on to the coordinates."""
    column = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    name = F.nullif(column(city, "string"), F.lit(""))
    by_city = F.when(name.isNotNull(), region_by_city(name, cities, default))
    return df.withColumn(out, F.coalesce(by_city, region_by_box(column(lat, "double"), column(lon, "double"), boxes, default)))


_EDGES = {"min_lat": -90.0, "max_lat": 90.0, "min_lon": -180.0, "max_lon": 180.0}
#: Boxes of a leaf, cuts of a cell along each axis, and the depth at which cells are no longer cut.
LEAF_BOXES, CUTS, MAX_DEPTH = 32, 4, 10


class BoxTree:
    """A quadtree over boxes: cells are cut until at most ``LEAF_BOXES`` boxes can be the first match of a point in them.

    In a cell that one box covers, later boxes never win, and of boxes that look alike inside a cell only the first can. What is left
    above the limit at ``MAX_DEPTH``, where cells are less than 0.0004 degrees wide, stays a table of boxes per cell (``rest``).
    ``leaves`` holds (depth, cy, cx, boxes) and covers the whole of the boxes' extent.
    """

    def __init__(self, boxes: DataFrame, leaf_boxes: int = LEAF_BOXES, max_depth: int = MAX_DEPTH):
        self.spark, self.leaf_boxes = boxes.sparkSession, leaf_boxes
        rows = stored(boxes.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in _EDGES.items()}).select("ord", "code", *_EDGES)
                      .filter("min_lat <= max_lat and min_lon <= max_lon"), "boxes")  # others hold no point
        extent = rows.agg(F.min("min_lat"), F.max("max_lat"), F.min("min_lon"), F.max("max_lon")).first()
        self.south, self.north, self.west, self.east = (0.0, 0.0, 0.0, 0.0) if extent[0] is None else extent
        cells = self.spark.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("cy"), F.lit(0).cast("long").alias("cx"))
        held = rows.select(F.lit(0).cast("long").alias("cy"), F.lit(0).cast("long").alias("cx"), "*")
        leaves, depth = [], 0
        self.rest: DataFrame | None = None
        item = F.struct("ord", "code", *_EDGES)
        while True:
            held = stored(self._candidates(held, depth), "cell-boxes")
            sizes = held.groupBy("cy", "cx").agg(F.count("*").alias("n"))
            full = stored(sizes.filter(F.col("n") > leaf_boxes).select("cy", "cx"), "full-cells")
            last = depth == max_depth or not full.count()
            small = held if full.isEmpty() else held.join(full, ["cy", "cx"], "left_anti")
            lists = small.groupBy("cy", "cx").agg(F.array_sort(F.collect_list(item)).alias("boxes"))  # leaf_boxes at most
            # Cells without boxes are leaves as well; at the last depth those above the limit keep an empty list and a mark.
            open_cells = cells if last else cells.join(full, ["cy", "cx"], "left_anti")
            leaves.append(open_cells.join(lists, ["cy", "cx"], "left").select("depth", "cy", "cx", "boxes"))
            if last:
                if not full.isEmpty():
                    self.rest = held.join(full, ["cy", "cx"])
                break
            depth += 1
            part = F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1)))
            down = (full.withColumn("py", part).withColumn("px", part)
                    .select((F.col("cy") * CUTS + F.col("py")).alias("cy"), (F.col("cx") * CUTS + F.col("px")).alias("cx")))
            cells = stored(down.select(F.lit(depth).alias("depth"), "cy", "cx"), "cells")
            # A box goes to the children it touches.
            reach = lambda low, high, at, axis: F.sequence(
                F.greatest(self.cell(F.col(low), depth, axis), F.col(at) * CUTS), F.least(self.cell(F.col(high), depth, axis), F.col(at) * CUTS + CUTS - 1))
            held = (held.join(full, ["cy", "cx"]).withColumn("ny", F.explode(reach("min_lat", "max_lat", "cy", 0)))
                    .withColumn("nx", F.explode(reach("min_lon", "max_lon", "cx", 1)))
                    .select(F.col("ny").alias("cy"), F.col("nx").alias("cx"), "ord", "code", *_EDGES))
        self.depths, self.last = list(range(depth + 1)), depth
        self.leaves = stored(reduce(DataFrame.unionByName, leaves), "box-leaves")

    def _share(self, value: Column, axis: int) -> Column:
        low, high = ((self.south, self.north), (self.west, self.east))[axis]
        return (value - F.lit(low)) / F.lit((high - low) or 1.0)

    def cell(self, value: Column, depth: int, axis: int) -> Column:
        """Number of the cell along an axis. Cells divide by powers of two, so those of one depth nest in those of the one above exactly."""
        count = CUTS ** depth
        return F.least(F.floor(self._share(value, axis) * count), F.lit(count - 1)).cast("long")

    def _candidates(self, held: DataFrame, depth: int) -> DataFrame:
        """The boxes that can be first in their cell."""
        top = CUTS ** depth - 1

        def covers(low: str, high: str, at: str, axis: int) -> Column:
            first, last = self.cell(F.col(low), depth, axis), self.cell(F.col(high), depth, axis)
            return (((first < F.col(at)) | (self._share(F.col(low), axis) <= 0))
                    & ((last > F.col(at)) | ((F.col(at) == top) & (self._share(F.col(high), axis) >= 1))))

        marked = held.withColumn("_cover", covers("min_lat", "max_lat", "cy", 0) & covers("min_lon", "max_lon", "cx", 1))
        first = marked.groupBy("cy", "cx").agg(F.min(F.when(F.col("_cover"), F.col("ord"))).alias("_first"))
        live = marked.join(first, ["cy", "cx"]).filter(F.col("_first").isNull() | (F.col("ord") <= F.col("_first")))
        # The part of a box inside its cell; a bound beyond the cell is no bound there.
        inside = lambda c, at, axis, low: F.when(
            (self.cell(F.col(c), depth, axis) >= F.col(at)) if low else (self.cell(F.col(c), depth, axis) <= F.col(at)), F.col(c))
        alike = {"_a": inside("min_lat", "cy", 0, True), "_b": inside("max_lat", "cy", 0, False), "_c": inside("min_lon", "cx", 1, True),
                 "_d": inside("max_lon", "cx", 1, False)}
        return (live.withColumns(alike).groupBy("cy", "cx", *alike).agg(F.min(F.struct("ord", "code", *_EDGES)).alias("_box"))
                .select("cy", "cx", "_box.*"))

    def locate(self, df: DataFrame, lat: str, lon: str, out: str, default: str) -> DataFrame:
        """``df`` with the code of the first box that holds each point. A point lies in one leaf; one outside the extent in none."""
        y, x = F.col(lat), F.col(lon)
        within = F.coalesce(y.between(self.south, self.north) & x.between(self.west, self.east), F.lit(False))
        places = F.array(*[F.struct(F.lit(d).alias("depth"), self.cell(y, d, 0).alias("cy"), self.cell(x, d, 1).alias("cx")) for d in self.depths])
        nowhere = F.array(F.struct(F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("cy"), F.lit(0).cast("long").alias("cx")))
        outside = self.spark.range(1).select(F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("cy"), F.lit(0).cast("long").alias("cx"))
        leaves = self.leaves.unionByName(outside, allowMissingColumns=True).withColumnsRenamed({c: f"_{c}" for c in ("depth", "cy", "cx", "boxes")})
        hit = F.filter("_boxes", lambda b: y.between(b["min_lat"], b["max_lat"]) & x.between(b["min_lon"], b["max_lon"]))
        asked = df.withColumn("_at", F.explode(F.when(within, places).otherwise(nowhere))).withColumns({f"_{c}": F.col(f"_at.{c}") for c in ("depth", "cy", "cx")})
        found = asked.join(leaves, ["_depth", "_cy", "_cx"]).withColumn("_code", F.get(hit, F.lit(0))["code"])
        if self.rest is not None:
            # Points of cells above the limit meet their boxes one by one, each distinct point once.
            r = self.rest.select(F.lit(self.last).alias("_depth"), F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), "ord", F.col("code").alias("_more"), *_EDGES)
            points = asked.filter(F.col("_depth") == self.last).select("_depth", "_cy", "_cx", y.alias("_y"), x.alias("_x")).distinct()
            more = (points.join(r, ["_depth", "_cy", "_cx"]).filter("_y between min_lat and max_lat and _x between min_lon and max_lon")
                    .groupBy("_y", "_x").agg(F.min_by("_more", "ord").alias("_more")))
            found = found.join(more, (y == F.col("_y")) & (x == F.col("_x")), "left").withColumn("_code", F.coalesce("_code", "_more")).drop("_y", "_x", "_more")
        return found.withColumn(out, F.coalesce("_code", F.lit(default))).drop("_at", "_depth", "_cy", "_cx", "_boxes", "_code")


def enrich_region_from_table(df: DataFrame, boxes: DataFrame, lat: str, lon: str, out: str = "region",
                             leaf_boxes: int = LEAF_BOXES, default: str = DEFAULT_REGION) -> DataFrame:
    """First matching box when the boxes are a table (``ord, code, min_lat, max_lat, min_lon, max_lon``) of any size.

    Boxes are indexed by a quadtree whose leaves hold a bounded number of them. A missing bound is the world's edge.
    """
    return BoxTree(boxes, leaf_boxes).locate(df, lat, lon, out, default)


def load_dimension(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ordered boxes, city overrides) from the nested JSON document."""
    schema = (
        "regions array<struct<name:string,code:string,"
        "bounds:struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>>>,"
        "city_overrides map<string,struct<region:string,lat:double,lon:double>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    boxes = doc.select(F.posexplode("regions").alias("ord", "r")).select(
        "ord", F.col("r.code").alias("code"), F.col("r.name").alias("name"),
        F.coalesce("r.bounds.min_lat", F.lit(-90.0)).alias("min_lat"),
        F.coalesce("r.bounds.max_lat", F.lit(90.0)).alias("max_lat"),
        F.coalesce("r.bounds.min_lon", F.lit(-180.0)).alias("min_lon"),
        F.coalesce("r.bounds.max_lon", F.lit(180.0)).alias("max_lon"),
    )
    cities = doc.select(F.explode("city_overrides").alias("city", "c")).select("city", "c.region", "c.lat", "c.lon")
    return boxes, cities
