import math

import pytest
from pyspark.sql import functions as F

from builders import TOWNS
from convoca.functions.geo import haversine_km, law_of_cosines_km
from convoca.functions.text import (
    WHITESPACE,
    decode_tags,
    decode_vector,
    encode_list,
    fold,
    pick_language,
    same_text,
    short_hour,
    slug,
    strip,
)
from convoca.functions.vectors import cosine_similarity, usable
from convoca.operators.upsert import event_key

# kilometres between the five towns
DISTANCES = {
    ("08380", "08370"): 7.575716,
    ("08380", "08360"): 14.717025,
    ("08380", "08397"): 4.498408,
    ("08380", "17300"): 5.364029,
    ("08370", "08360"): 7.153861,
    ("08370", "08397"): 3.077555,
    ("08370", "17300"): 12.894875,
    ("08360", "08397"): 10.225707,
    ("08360", "17300"): 19.995143,
    ("08397", "17300"): 9.830184,
}


def test_distances_of_the_towns(spark):
    places = spark.createDataFrame([(c, a, o) for c, _, a, o in TOWNS], "cp string, lat double, lng double")
    pairs = places.toDF("cp0", "lat0", "lng0").join(places, F.col("cp0") != F.col("cp"))
    args = [F.col(c) for c in ("lat0", "lng0", "lat", "lng")]
    for row in pairs.select("cp0", "cp", haversine_km(*args), law_of_cosines_km(*args)).collect():
        expected = DISTANCES.get((row[0], row[1])) or DISTANCES[(row[1], row[0])]
        assert row[2] == pytest.approx(expected, abs=2e-6)
        assert row[3] == pytest.approx(expected, abs=2e-6)


def test_a_place_is_at_distance_zero_from_itself(spark):
    lat = spark.range(9000).select((F.col("id") / 100).alias("lat"))
    km = law_of_cosines_km(F.col("lat"), F.lit(2.0), F.col("lat"), F.lit(2.0))
    worst = lat.agg(F.max(km), F.count_if(F.isnan(km))).first()
    assert worst[0] < 1e-3 and worst[1] == 0


@pytest.mark.parametrize(
    "left, right, expected",
    [
        ([1.0, 0.0], [1.0, 0.0], 1.0),
        ([1.0, 0.0], [-2.0, 0.0], -1.0),
        ([1.0, 2.0], [2.0, 1.0, 3.0], 4 / (math.sqrt(5) * math.sqrt(14))),
        ([1.0, 2.0], [], 0.0),
        ([1.0, 2.0], [0.0, 0.0], 0.0),
        ([1.0, 2.0], None, None),
    ],
)
def test_cosine(spark, left, right, expected):
    df = spark.createDataFrame([(left, right)], "a array<double>, b array<double>")
    (got,) = df.select(cosine_similarity(F.col("a"), F.col("b"))).first()
    assert got == (None if expected is None else pytest.approx(expected))


def test_vectors_from_json(spark):
    texts = [None, "", "bad", "null", '[1,"x"]', "[1,null]", "[]", "[0,0]", "[1,2.5]"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(usable(decode_vector(df, "v"))).collect()]
    assert got == [None, None, None, None, None, None, [], [0.0, 0.0], [1.0, 2.5]]


def test_tags_from_json(spark):
    cases = {
        None: [],
        "": [],
        "[]": [],
        ' [ "#a" , "b\\"c" ] ': ["#a", 'b"c'],
        "null": None,
        "bad": None,
        "{}": None,
        '"x"': None,
        '["a",1]': None,
        '["a",null]': None,
        '["a",]': None,
        "[" + ",".join(['"#etiqueta"'] * 20000) + "]": ["#etiqueta"] * 20000,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = [r[0] for r in df.select(decode_tags(df, "t")).collect()]
    assert got == list(cases.values())
    lists = spark.createDataFrame([(["a"],), (None,), (["a", None],)], "t array<string>")
    assert [r[0] for r in lists.select(decode_tags(lists, "t")).collect()] == [["a"], [], None]
    assert lists.select(encode_list(F.col("t"))).first()[0] == '["a"]'


def test_slugs_match_like_the_catalog(spark):
    cases = [
        ("Formación", "formacion", True),
        ("MÚSICA", "musica", True),
        ("Aire Libre", "aire_libre", True),
        ("Esports", "deportes", False),
        # the blank becomes part of the slug
        ("musica ", "musica", False),
    ]
    df = spark.createDataFrame(cases, "name string, slug string, same boolean")
    for row in df.select(same_text(slug(F.col("name")), F.col("slug")), "same").collect():
        assert row[0] == row[1]


def test_text_helpers(spark):
    df = spark.createDataFrame([(WHITESPACE + "a b" + WHITESPACE, "Ñandú MÚSICA gratuïts", "música")])
    row = df.select(strip(F.col("_1")), fold(F.col("_2")), fold(F.col("_3"))).first()
    assert tuple(row) == ("a b", "nandu musica gratuits", "musica")
    hours = spark.createDataFrame([("09:00:00",), ("19:30:00",), (None,)], "h string")
    assert [r[0] for r in hours.select(short_hour(F.col("h"))).collect()] == ["9:00:00", "19:30:00", None]
    langs = spark.createDataFrame([("es",), ("ca",), ("fr",), (None,)], "i string")
    picked = langs.select(pick_language(F.col("i"), F.lit("E"), F.lit("C"))).collect()
    assert [r[0] for r in picked] == ["E", "C", "C", "C"]


def test_event_key(spark):
    import hashlib

    df = spark.sql("select 'Fiesta ñ' t, date'2026-01-05' d, 3 c")
    expected = hashlib.sha256("Fiesta ñ2026-01-053".encode()).hexdigest()
    assert df.select(event_key(F.col("t"), F.col("d"), F.col("c"))).first()[0] == expected
