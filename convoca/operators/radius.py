"""Postcodes within a radius of an origin postcode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoca.functions.geo import EARTH_KM, KM_PER_DEGREE, law_of_cosines_km
from convoca.sources.catalog import Catalog
from convoca.sources.staging import full_width, stage

# side of the grid cells, in degrees
CELL = 0.125
_CELLS_AROUND = int(360 / CELL)
# a cell with more points than this is looked at in four parts of half its side, down to the last level
CROWDED, LAST = 16, 7
# widens the search box and narrows what counts as inside, against rounding at
# their edges; never the result
_SLACK = 1e-6


def _cell(degrees: Column) -> Column:
    return F.floor(degrees / CELL)


def _around(cell_lng: Column) -> Column:
    return F.pmod(cell_lng, F.lit(_CELLS_AROUND))


def with_cell(places: DataFrame) -> DataFrame:
    """Add the grid cell (``cell_lat``, ``cell_lng``) of ``lat``, ``lng``."""
    return places.withColumn("cell_lat", _cell(F.col("lat"))).withColumn(
        "cell_lng", _around(_cell(F.col("lng")))
    )


def located(postcodes: DataFrame) -> DataFrame:
    return postcodes.select(
        "cp",
        F.col("latitud").cast("double").alias("lat"),
        F.col("longitud").cast("double").alias("lng"),
    )


def _box(lat: Column, radius: Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of the box around a circle."""
    half_lat = radius / KM_PER_DEGREE + _SLACK
    reach = F.sin(F.least(radius / EARTH_KM, F.lit(1.5707963))) / F.cos(F.radians(lat))
    over_pole = F.abs(lat) + half_lat >= 89.9
    half_lng = F.when(over_pole | (reach >= 1), F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(reach, F.lit(1.0)))) + _SLACK
    )
    return half_lat, half_lng


def cells_touched(circles: DataFrame) -> DataFrame:
    """``circles`` (lat0, lng0, radio_km, ...) once for each grid cell that the box around the circle touches."""
    half_lat, half_lng = _box(F.col("lat0"), F.col("radio_km").cast("double"))
    west = _cell(F.col("lng0") - F.col("half_lng"))
    east = _cell(F.col("lng0") + F.col("half_lng"))
    south = _cell(F.col("lat0") - F.col("half_lat"))
    north = _cell(F.col("lat0") + F.col("half_lat"))
    return (
        circles.withColumn("half_lat", half_lat)
        .withColumn("half_lng", half_lng)
        .withColumn("cell_lat", F.explode(F.sequence(south, north)))
        .withColumn("cell_lng", F.explode(F.sequence(west, F.least(east, west + _CELLS_AROUND - 1))))
        .withColumn("cell_lng", _around(F.col("cell_lng")))
        .drop("half_lat", "half_lng")
    )


def _center_corner(side: float) -> tuple[Column, Column]:
    """Distance of a circle's center from that of a cell, and of the cell's center from its farthest point."""
    lat, lng = (F.col("cell_lat") + 0.5) * side, (F.col("cell_lng") + 0.5) * side
    center = law_of_cosines_km(F.col("lat0"), F.col("lng0"), lat, lng)
    # no point of a cell is farther from its center than a corner
    corner = F.greatest(
        law_of_cosines_km(lat, lng, lat + side / 2, lng + side / 2),
        law_of_cosines_km(lat, lng, lat - side / 2, lng + side / 2),
    )
    return center, corner


def cells_reached(circles: DataFrame) -> DataFrame:
    """``circles`` once for each grid cell they reach: its name as ``lugar``, and ``dentro`` where it lies inside as a whole."""
    center, corner = _center_corner(CELL)
    return (
        cells_touched(circles)
        .withColumn("center", center)
        .withColumn("corner", corner)
        .filter(F.col("center") - F.col("corner") - 1e-3 <= F.col("radio_km"))
        .withColumn("dentro", F.col("center") + F.col("corner") + 1e-3 <= F.col("radio_km"))
        .withColumn("lugar", cell_name(F.col("cell_lat"), F.col("cell_lng")))
        .drop("center", "corner", "cell_lat", "cell_lng")
    )


def _cells_around(origins: DataFrame, catalog: Catalog) -> DataFrame:
    """The grid cells the box around each distinct (``cp_origen``, ``radio_km``) touches.

    Origins are spread by themselves and not by cell: a crowded cell is shared
    by many tasks.
    """
    asked = full_width(origins.select("cp_origen", "radio_km").distinct(), "cp_origen", "radio_km")
    placed = asked.join(
        catalog.sized(located(catalog.postcodes).toDF("cp_origen", "lat0", "lng0")), "cp_origen"
    )
    return cells_touched(placed).select("cp_origen", "radio_km", "lat0", "lng0", "cell_lat", "cell_lng")


def _members(cells: DataFrame, catalog: Catalog) -> DataFrame:
    """Postcodes of the given cells whose exact distance is within the radius."""
    places = with_cell(located(catalog.postcodes))
    distance = law_of_cosines_km(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng"))
    return (
        cells.join(catalog.sized(places), ["cell_lat", "cell_lng"])
        .withColumn("distancia_km", distance)
        .filter(F.col("distancia_km") <= F.col("radio_km"))
        .select("cp_origen", "radio_km", "cp", "distancia_km")
    )


def postcodes_within(origins: DataFrame, catalog: Catalog) -> DataFrame:
    """All postcodes within each (``cp_origen``, ``radio_km``) of ``origins``.

    Returns ``cp_origen, radio_km, cp, distancia_km``; origins the catalog does
    not know give no rows. Origins meet only the postcodes of the grid cells
    their box touches, then the exact distance decides, so pairs far apart are
    never built.
    """
    return _members(_cells_around(origins, catalog), catalog)


def cell_name(cell_lat: Column, cell_lng: Column) -> Column:
    return F.concat_ws(":", F.lit("celda"), cell_lat.cast("string"), cell_lng.cast("string"))


def _at(level: Column) -> tuple[Column, Column]:
    """The cell of ``lat``, ``lng`` at a level; a level halves the sides of the one before, exactly."""
    times = F.pow(F.lit(2.0), level)
    around = (F.lit(_CELLS_AROUND) * times).cast("bigint")
    return F.floor(F.col("lat") / CELL * times), F.pmod(F.floor(F.col("lng") / CELL * times), around)


def _name(level: Column, cell_lat: Column, cell_lng: Column) -> Column:
    part = F.concat_ws(":", F.concat(F.lit("celda"), level.cast("string")), cell_lat.cast("string"), cell_lng.cast("string"))
    return F.when(level == 0, cell_name(cell_lat, cell_lng)).otherwise(part)


def _points(catalog: Catalog) -> DataFrame:
    """(lat, lng, lugar, depth) of every point with postcodes, staged.

    A point of one postcode has its code as ``lugar``, one of several a name of its own. ``depth`` is the
    level of the smallest cell of the point that is looked at: all cells around it are crowded.
    """
    shared = F.concat_ws(":", F.lit("punto"), F.col("lat").cast("string"), F.col("lng").cast("string"))
    codes = located(catalog.postcodes).filter("cp is not null and lat is not null and lng is not null")
    points = (
        codes.groupBy("lat", "lng")
        .agg(F.min("cp").alias("one"), F.max("cp").alias("other"))
        .select("lat", "lng", F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(shared).alias("lugar"))
    )
    level = F.col("level")
    cells = points.select("lat", "lng", F.explode(F.sequence(F.lit(0), F.lit(LAST - 1))).alias("level"))
    cells = cells.withColumn("cell_lat", _at(level)[0]).withColumn("cell_lng", _at(level)[1])
    on = ["level", "cell_lat", "cell_lng"]
    crowded = cells.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select(*on)
    # a cell around a crowded one is crowded too
    deep = cells.join(crowded, on, "left_semi").groupBy("lat", "lng").agg((F.max("level") + 1).alias("depth"))
    return stage(
        points.join(deep, ["lat", "lng"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))), "puntos"
    )


def places_of(catalog: Catalog, everywhere: str) -> DataFrame:
    """(cp, lugar): each postcode, the places that ``places_within`` may name instead of it, and ``everywhere``."""
    levels = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: _name(k, *_at(k)))
    of_point = _points(catalog).select("lat", "lng", F.concat(F.array("lugar"), levels).alias("lugares"))
    placed = located(catalog.postcodes).join(catalog.sized(of_point), ["lat", "lng"], "left")
    none = F.array().cast("array<string>")
    return placed.select("cp", F.explode(F.array_union(F.array(F.col("cp"), F.lit(everywhere)), F.coalesce("lugares", none))).alias("lugar"))


def places_within(origins: DataFrame, catalog: Catalog) -> DataFrame:
    """What lies within each (``cp_origen``, ``radio_km``), as few places as possible.

    Grid cells that lie inside the circle as a whole are given by name. A cell on its edge is
    looked at in four parts where it is crowded, else by its points; postcodes at the
    same point are one place. So the number of places follows the edge of the
    circle and not the postcodes near it. Together they hold the postcodes of
    ``postcodes_within``. Returns ``cp_origen, radio_km, lugar``.
    """
    points = _points(catalog)
    deepest = points.agg(F.max("depth")).first()[0] or 0
    on = ["level", "cell_lat", "cell_lng"]
    kept = ["cp_origen", "radio_km", "lat0", "lng0", "dentro"]
    cells = _cells_around(origins, catalog).withColumn("level", F.lit(0)).withColumn("dentro", F.lit(False))
    for level in range(deepest + 1):
        here = F.lit(level)
        used = points.filter(F.col("depth") >= level).select(
            here.alias("level"), _at(here)[0].alias("cell_lat"), _at(here)[1].alias("cell_lng"), (F.col("depth") > level).alias("split")
        )
        used = used.groupBy(*on).agg(F.max("split").alias("split"))
        center, corner = _center_corner(CELL / 2**level)
        # cells settled before are of another level: they meet nothing and stay
        now = F.col("level") == level
        cells = (
            cells.join(catalog.sized(used), on, "left")
            .filter(~now | F.col("split").isNotNull())
            .withColumn("center", F.when(now, center))
            .withColumn("corner", F.when(now, corner))
            .filter(~now | (F.col("center") - F.col("corner") - 1e-3 <= F.col("radio_km")))
            .withColumn("dentro", F.coalesce(F.col("center") + F.col("corner") + 1e-3 <= F.col("radio_km"), F.col("dentro")))
        )
        split = now & ~F.col("dentro") & F.col("split")
        itself = F.array(F.struct(*on))
        part = lambda north, east: F.struct(
            F.lit(level + 1).alias("level"),
            (F.col("cell_lat") * 2 + north).alias("cell_lat"),
            (F.col("cell_lng") * 2 + east).alias("cell_lng"),
        )
        parts = F.array(*[part(north, east) for north in (0, 1) for east in (0, 1)])
        cells = cells.select(*kept, F.inline(F.when(split, parts).otherwise(itself)))
    leaves = points.select(
        "lat", "lng", "lugar", F.col("depth").alias("level"), _at(F.col("depth"))[0].alias("cell_lat"), _at(F.col("depth"))[1].alias("cell_lng")
    )
    distance = law_of_cosines_km(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng"))
    whole = cells.filter("dentro").withColumn("lugar", _name(F.col("level"), F.col("cell_lat"), F.col("cell_lng")))
    edge = cells.filter("not dentro").join(catalog.sized(leaves), on).filter(distance <= F.col("radio_km"))
    return whole.select("cp_origen", "radio_km", "lugar").unionByName(edge.select("cp_origen", "radio_km", "lugar"))
