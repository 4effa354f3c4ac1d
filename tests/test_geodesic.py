import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.functions import geo, geodesic


def _degrees(d, m, s):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


#: Lines of published tests: longitude and latitude of both ends, and metres.
LINES = [
    (_degrees(144, 25, 29.5244), _degrees(-37, 57, 3.7203), _degrees(143, 55, 35.3839), _degrees(-37, 39, 10.1561), 54972.271),
    (0, 0, 179.5, 0.5, 19936288.579), (0, 0, 179.7, 0.5, 19944127.421), (0, -90, 0, 90, 20003931.4586),
    (-73.8, 40.6, -0.5, 51.6, 5551759.4003), (0, 0, 1, 0, 111319.4908), (0, 0, 180, 0, 20003931.4586), (0, 0, 0, 90, 10001965.7293),
    (0, 30, 180, -30, 20003931.4586), (179.9, 0, -179.9, 0, 22263.8982), (5, 6, 5, 6, 0.0),
]


@pytest.mark.parametrize("line", LINES)
def test_published_lines(line):
    ends = [np.array([v]) for v in line[:4]]
    back = [ends[2], ends[3], ends[0], ends[1]]
    for found in (geodesic.lengths(*ends)[0], geodesic.lengths(*back)[0]):
        assert abs(found - line[4]) < 0.001


def test_both_ways_agree():
    r = np.random.default_rng(1)
    x1, x2, y1, y2 = r.uniform(-180, 180, 500), r.uniform(-180, 180, 500), r.uniform(-89, 89, 500), r.uniform(-89, 89, 500)
    u1, u2 = (np.arctan((1 - geodesic.FLAT) * np.tan(np.radians(y))) for y in (y1, y2))
    longitude = np.radians(np.abs((x2 - x1 + 180) % 360 - 180))
    found, settled = geodesic._vincenty(u1, u2, longitude)
    assert settled.mean() > 0.98
    assert np.abs(found - geodesic._shooting(u1, u2, longitude))[settled].max() < 0.001


def test_missing_points():
    assert np.isnan(geodesic.lengths([np.nan, 1.0], [0.0, 0.0], [1.0, np.inf], [1.0, 1.0])).all()
    assert len(geodesic.lengths([], [], [], [])) == 0


def _moved(spark, points, source, target):
    df = spark.createDataFrame(points, "x double, y double").coalesce(1)
    x, y = geo.transformed(F.col("x"), F.col("y"), source, target)
    return [(r.a, r.b) for r in df.select(x.alias("a"), y.alias("b")).collect()]


def test_reference_systems(spark):
    (east, north), = _moved(spark, [(-79.387139, 43.642567)], 4326, 32617)  # a published landmark
    assert abs(east - 630084) < 1 and abs(north - 4833438) < 1
    assert _moved(spark, [(117.0, 0.0)], 4490, 4548) == [(500000.0, 0.0)]
    assert _moved(spark, [(117.0, 0.0)], 4490, 4527) == [(39500000.0, 0.0)]
    (_, north), = _moved(spark, [(9.0, -33.0)], 4326, 32732)
    assert abs(10_000_000 - north - 0.9996 * geodesic.lengths([0.0], [0.0], [0.0], [33.0])[0]) < 0.001
    points = [(111.0 + i / 7, -40.0 + 3.1 * i) for i in range(25)]
    for code in (32649, 32750, 4547, 4507, 4518, 3857):
        there = _moved(spark, points, 4326, code)
        assert max(abs(a - b) for p, q in zip(points, _moved(spark, there, code, 4326)) for a, b in zip(p, q)) < 1e-8
    assert _moved(spark, [(1.0, 2.0)], 4326, 4326) == [(1.0, 2.0)]
    with pytest.raises(ValueError):
        geo.projection(2056)
