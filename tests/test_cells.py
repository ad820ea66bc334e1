"""Places: cells against the product, with poles, the date line and edges; what location texts mean."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions.geo import haversine_km
from quarryline.operators import cells, geo


@pytest.mark.parametrize("most", [1.5, 300.0, 2_500.0, 12_000.0, 20_000.0])
def test_near_pairs_equal_the_product(spark, most):
    rnd = random.Random(int(most))
    angle = math.degrees(most / 6371.0)

    def spot(i):
        base = rnd.choice([(89.9, 0), (-89.99, 10), (0, 180), (52.5, 13.4), (90, 0), (-90, 5), (33.0, -179.99), (67, 179.9)])
        far = rnd.random() * 1.3 * angle
        turn = rnd.random() * 2 * math.pi
        lat = max(-90.0, min(90.0, base[0] + far * math.sin(turn)))
        lon = base[1] + far * math.cos(turn) / max(0.05, math.cos(math.radians(lat)))
        return i, lat, (lon + 180) % 360 - 180 if rnd.random() < 0.9 else lon

    points = [spot(i) for i in range(250)] + [(900, None, 1.0), (901, 180.0 / 4, 180.0), (902, 45.0, -180.0)]
    places = [(*spot(i), most * rnd.choice([1, 1, 0.5, 0.1])) for i in range(120)] + [(901, 45.0, 180.0, most), (902, 1.0, None, most), (903, 45.0, 179.999, None)]
    a = spark.createDataFrame(points, "a int, latitude double, longitude double")
    b = spark.createDataFrame(places, "b int, lat2 double, lon2 double, r double")
    want = a.crossJoin(b).where(haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")) <= F.col("r"))
    want = sorted((r.a, r.b) for r in want.collect())
    got = sorted((r.a, r.b) for r in cells.near_pairs(a, b, "r", most).collect())
    assert got == want and len(want) > 100


def test_a_radius_above_the_largest_fails(spark):
    a = spark.createDataFrame([(0.0, 0.0)], "latitude double, longitude double")
    b = spark.createDataFrame([(0.0, 0.0, 9.0)], "lat2 double, lon2 double, r double")
    with pytest.raises(Exception, match="above the largest"):
        cells.near_pairs(a, b, "r", 5.0).collect()
    with pytest.raises(ValueError, match="girth"):
        cells.near_pairs(a, b, "r", 0.0)


def test_far_cells_never_meet(spark):
    """5,000 points around the globe and as many places: some hundred pairs reach the distance, not 25 million."""
    rnd = random.Random(1)
    spots = [(math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)) for _ in range(10_000)]
    a = spark.createDataFrame(spots[:5000], "latitude double, longitude double")
    b = spark.createDataFrame([(*s, 100.0) for s in spots[5000:]], "lat2 double, lon2 double, r double")
    found = cells.near_pairs(a, b, "r", 100.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    wide = cells.near_pairs(a, b.withColumn("r", F.lit(100.0)), "r", 100.0).count()
    assert 300 < wide < 5000


def test_resolution_and_preparation(rows):
    places = rows("place_id long, label string, latitude double, longitude double", (1, "Köln", 50.9, 6.9), (2, "Köln", 50.9, 6.9), (3, "Koeln", 1.0, 1.0), (4, "Mainz", 50.0, 8.2), (5, "AB1", 57.0, -2.0))
    names = rows("key string, place_id long", ("koeln", 3), ("koln", 2), ("köln", 1), ("köln", 2), ("mainz", 4))
    postal = rows("postal_code string, place_id long, latitude double, longitude double", ("55116", 4, 50.1, 8.3), ("ab1 3", 5, 57.1, -2.1), ("ab1", 5, 57.2, -2.2))
    inputs = rows("id int, text string", (1, " KÖLN "), (2, "Mainz"), (3, "55116"), (4, "AB1 3XY"), (5, "  "), (6, None), (7, "Atlantis"), (8, "99999"))
    got = sorted(map(tuple, geo.resolve(inputs, "id", "text", postal, names, places).collect()))
    assert got == [(1, 1, "Koeln", 1.0, 1.0, "name", 2), (1, 2, "Köln", 50.9, 6.9, "name", 2), (2, 1, "Mainz", 50.0, 8.2, "name", 1), (3, 1, "Mainz", 50.1, 8.3, "postal", 1), (4, 1, "AB1", 57.1, -2.1, "postal", 1)]
    found = rows("id int, text string, n long", (1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1))
    asked = rows("id int, places array<string>, km int", (1, ["a", "c", "b"], 5), (2, ["x", "a", "y"], 5), (3, ["a"], None), (4, [], 5), (5, None, 5))
    told = {r.id: (r.status, r.unresolved, r.ambiguous) for r in geo.prepared(asked, "id", "places", "km", found).collect()}
    assert told == {1: ("applied", None, ["c", "b"]), 2: ("unresolved", "x", []), 3: ("missing_radius_km", None, []), 4: ("no_request_locations", None, []), 5: ("no_request_locations", None, [])}
