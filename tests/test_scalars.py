import pytest
from pyspark.sql import functions as F

from pyrogrid.functions import colour, geometry, identity, temperature as t
from pyrogrid.operators.tiles import attach
from pyrogrid.params import Params, read_settings


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_celsius_and_emissivity(spark):
    row = one(spark, *[t.to_celsius(F.lit(v)) for v in (0.0, 127.5, 255.0)])
    assert list(row) == [20.0, 30.0, 40.0]
    row = one(spark, *[F.round(t.correct_emissivity(F.lit(c)), 6) for c in (20.0, 30.0, 37.5)])
    assert list(row) == [20.0, 30.194017, 37.827563]


def test_text_follows_binary_value(spark):
    values = [293.15, 20.25, 20.75, 0.04, 19.95, 36.6]
    row = one(spark, *[t.as_text(F.lit(v), "K") for v in values])
    assert list(row) == [f"{v:.1f} K" for v in values]


def test_pseudonym(spark):
    people = [("Max Mustermann", "01.01.2000"), ("max mustermann", "01.01.2000"),
              ("  Max Mustermann\t", "\u2003\u00a001.01.2000\x1f\n"), ("Max Mustermann", "02.01.2000")]
    df = spark.createDataFrame(people, "name string, dob string")
    got = [r.p for r in df.select(
        identity.pseudonym(F.col("name"), F.col("dob"), "test_salt").alias("p")).collect()]
    assert got == ["ANON-DEB10DB2B323"] * 3 + ["ANON-79D7DA426D48"]
    assert len(got[0]) == 17


@pytest.mark.parametrize("dim,k", [(400, 21), (300, 15), (480, 25), (10, 3)])
def test_odd_kernel(spark, dim, k):
    assert one(spark, geometry.odd_kernel(F.lit(dim), F.lit(dim + 5), 0.05))[0] == k
    assert geometry.odd_kernel_of(dim, dim + 5, 0.05) == k


def test_radiometric(spark):
    rows = [("f", 0, 0, 30315), ("f", 0, 1, 29315), ("f", 1, 0, 31315), ("f", 1, 1, 28315),
            ("g", 0, 0, 300), ("g", 0, 1, 150), ("g", 1, 0, 500), ("g", 1, 1, 200)]
    df = spark.createDataFrame(rows, "frame_id string, y int, x int, raw int").withColumns(
        {"height": F.lit(2), "width": F.lit(2)})
    top = df.groupBy("frame_id").agg(F.max("raw").alias("top"), F.max("height").alias("height"),
                                     F.max("width").alias("width"))
    got = {(r.frame_id, r.y, r.x): r.v for r in attach(df, top).select(
        "frame_id", "y", "x", t.radiometric_to_grey(F.col("raw"), F.col("top")).alias("v")).collect()}
    assert [got["f", y, x] for y in (0, 1) for x in (0, 1)] == [127, 0, 255, 0]
    assert [got["g", y, x] for y in (0, 1) for x in (0, 1)] == [127, 0, 255, 0]


def test_calibration(spark):
    row = one(spark, t.calibrate(F.lit(250), F.lit(2.0), F.lit(20.0), F.lit(40.0)),
              t.calibrate(F.lit(3), F.lit(-2.0), F.lit(20.0), F.lit(40.0)),
              t.calibrate(F.lit(100), F.lit(1.0), F.lit(20.0), F.lit(20.0)),
              t.repair_range(F.lit(30.0), F.lit(20.0)))
    assert list(row) == [255, 0, 113, 31.0]


def test_overlay(spark):
    px = spark.createDataFrame([(100, True), (100, False)], "v int, hot boolean")
    got = {r.hot: (r.b, r.g, r.r) for r in colour.overlay(px, colour.grey_palette(spark)).collect()}
    assert got == {True: (90, 30, 208), False: (100, 100, 100)}
    two = colour.grey_palette(spark).union(spark.createDataFrame(
        [("hot", 100, 1, 2, 3)], "palette string, v int, b int, g int, r int"))
    cold = px.where("not hot").union(spark.createDataFrame([(7, False)], px.schema))
    got = {r.v: (r.b, r.g, r.r) for r in colour.overlay(cold, two, palette="hot").collect()}
    assert got == {100: (1, 2, 3), 7: (7, 7, 7)}


def test_settings(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"sigma_k": 2.5, "use_mad": true}')
    row = read_settings(spark, str(good)).first()
    assert (row.sigma_k, row.use_mad, row.otsu_min) == (2.5, True, Params().otsu_min)
    bad = tmp_path / "bad.json"
    bad.write_text("not json at all")
    assert read_settings(spark, str(bad)).first().sigma_k == Params().sigma_k
    missing = read_settings(spark, str(tmp_path / "none.json")).collect()
    assert [r.sigma_k for r in missing] == [Params().sigma_k]
