import math
import random

from builders import TOWNS, catalog
from convoca.operators.radius import cell_name, located, places_within, postcodes_within, with_cell
from pyspark.sql import functions as F


def brute(places, origin, radius):
    lat0, lng0 = places[origin]
    found = set()
    for cp, (lat, lng) in places.items():
        a, b, c, d = map(math.radians, (lat0, lng0, lat, lng))
        cosine = math.cos(a) * math.cos(c) * math.cos(d - b) + math.sin(a) * math.sin(c)
        if 6371 * math.acos(max(-1.0, min(1.0, cosine))) <= radius:
            found.add(cp)
    return found


def test_radius_around_the_towns(spark):
    cat = catalog(spark, [], [])
    asked = [("08380", 5), ("08380", 6), ("08380", 8), ("08380", 15), ("08360", 20), ("99999", 20)]
    rows = postcodes_within(spark.createDataFrame(asked, "cp_origen string, radio_km int"), cat).collect()
    found = {}
    for r in rows:
        found.setdefault((r.cp_origen, r.radio_km), set()).add(r.cp)
    assert found == {
        ("08380", 5): {"08380", "08397"},
        ("08380", 6): {"08380", "08397", "17300"},
        ("08380", 8): {"08380", "08397", "17300", "08370"},
        ("08380", 15): {cp for cp, *_ in TOWNS},
        ("08360", 20): {cp for cp, *_ in TOWNS},
    }


def test_grid_finds_the_same_as_all_pairs(spark):
    rng = random.Random(7)
    places = {}
    for i in range(300):
        # around one town, across the date line, and at a pole
        lat, lng = [(41.5, 2.5), (0.0, 180.0), (-17.0, -179.9), (89.6, 30.0)][i % 4]
        lng = (lng + rng.uniform(-1.5, 1.5) * (60 if lat > 80 else 1) + 180) % 360 - 180
        places[f"{i:05d}"] = (min(90.0, lat + rng.uniform(-0.7, 0.7)), lng)
    cat = catalog(spark, [], [], postcodes=[(cp, *p) for cp, p in places.items()])
    asked = [(f"{i:05d}", r) for i in range(60) for r in (1, 20, 100)]
    origins = spark.createDataFrame(asked, "cp_origen string, radio_km int")
    expected = {(o, r, cp) for o, r in asked for cp in brute(places, o, r)}

    rows = postcodes_within(origins, cat).select("cp_origen", "radio_km", "cp").collect()
    assert len(rows) == len(expected)
    assert {tuple(r) for r in rows} == expected

    cells = with_cell(located(cat.postcodes)).select(
        "cp", F.explode(F.array("cp", cell_name(F.col("cell_lat"), F.col("cell_lng")))).alias("lugar")
    )
    reached = places_within(origins, cat)
    rows = reached.join(cells, "lugar").select("cp_origen", "radio_km", "cp").collect()
    assert len(rows) == len(expected)
    assert {tuple(r) for r in rows} == expected
    assert reached.count() < len(expected)
