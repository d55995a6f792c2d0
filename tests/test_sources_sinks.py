import pytest
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from frames import array, scenario
from pyrogrid.plans.batch import evaluate_folder, run_batch
from pyrogrid.sources import sinks
from pyrogrid.sources.images import EVALUATION, read_images
from pyrogrid.sources.raster import explode_frames


def png(path, a):
    """Minimal 8-bit PNG, grey (h, w) or colour (h, w, 3)."""
    h, w = a.shape[:2]
    kind = 2 if a.ndim == 3 else 0
    raw = b"".join(b"\0" + a[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag, data):
        body = tag + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def folder(tmp_path):
    d = tmp_path / "images"
    d.mkdir()
    for name in ("ulcer", "normal"):
        png(d / f"{name}.PNG", scenario(name)[0])
    png(d / "black.png", np.zeros((30, 40), int))
    (d / "broken.jpg").write_bytes(b"this is no image")
    (d / "notes.txt").write_text("skip me")
    return str(d)


def name(row):
    return row.frame_id.rsplit("/", 1)[-1]


def test_read_images(spark, tmp_path):
    d = tmp_path / "one"
    d.mkdir()
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3))
    png(d / "colour.png", rgb)
    frames = read_images(spark, str(d))
    want = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
    got = array(explode_frames(frames), "v", (5, 7), frames.first().frame_id)
    assert (got == want).all()


def test_bad_files_become_rows(spark, tmp_path):
    frames = read_images(spark, folder(tmp_path), EVALUATION)
    got = {name(r): r.status for r in frames.collect()}
    assert got == {"ulcer.PNG": "ok", "normal.PNG": "ok", "black.png": "ok",
                   "broken.jpg": "decode_error"}


def test_folder_evaluation_and_batch(spark, tmp_path):
    d = folder(tmp_path)
    rows = {name(r): r for r in evaluate_folder(spark, d).collect()}
    assert rows["broken.jpg"].status == "decode_error"
    assert rows["black.png"].status == "empty_body_mask"
    assert (rows["ulcer.PNG"].hotspot_px, rows["ulcer.PNG"].status) == (145, "ok")
    assert rows["ulcer.PNG"].coverage_percent == 0.32
    assert (rows["ulcer.PNG"].width, rows["ulcer.PNG"].height) == (400, 400)
    for mode in ("symmetry", "general"):
        out = tmp_path / mode
        summary = {name(r): r for r in run_batch(spark, d, mode=mode, out=str(out)).collect()}
        assert set(summary) == {"ulcer.PNG", "normal.PNG", "black.png", "broken.jpg"}
        assert (summary["ulcer.PNG"].hotspots, summary["ulcer.PNG"].status) == (
            "145 px", "borderline")
        assert summary["normal.PNG"].status == "normal"
        steps = spark.read.parquet(str(out))
        assert {r.step for r in steps.select("step").distinct().collect()} == {
            "original", "mask", "difference", "hotspots"}
        hot = explode_frames(steps.where("step = 'hotspots' and frame_id like '%/ulcer.PNG'"))
        assert hot.where("v = 255").count() == 145


def test_calibration_offset_in_batch(spark, tmp_path):
    d = folder(tmp_path)
    plain = {name(r): r for r in run_batch(spark, d).collect()}
    cold = {name(r): r for r in run_batch(spark, d, temp_offset=-6.0).collect()}
    assert plain["ulcer.PNG"].hotspots == "145 px"
    # 6 degrees are 76 levels: skin falls to 9, below any body level; only the disc stays up,
    # and a body on one side alone is a large side difference.
    assert cold["normal.PNG"].status == "empty_body_mask"
    assert cold["ulcer.PNG"].status == "clinical"


def test_audit(spark, tmp_path):
    stats = spark.createDataFrame(
        [("p", "a.png", 3.0, 0.05, 20.0, 40.0, 7, 33.5, 1.25)],
        "patient_id string, image_file string, sigma_k double, tophat_factor double, "
        "t_min_c double, t_max_c double, hotspot_px long, max_temp_c double, symmetry_delta double")
    rows = sinks.audit_rows(stats, "me", "general")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        sinks.append_audit(rows, path, fmt)
        sinks.append_audit(rows, path, fmt)
        back = spark.read.option("header", True).format(fmt).load(path)
        assert back.count() == 2 and back.columns == rows.columns
    entries = rows.select("ts", "patient_id", F.lit(None).cast("string").alias("backend"),
                          F.lit(None).cast("long").alias("hotspot_px"),
                          F.lit(None).cast("double").alias("mean_temp_c"), "max_temp_c")
    sinks.export_audit(entries, str(tmp_path / "export"))
    row = spark.read.option("header", True).csv(str(tmp_path / "export")).first()
    assert (row.HotspotsDetected, row.MeanTempC, row.MaxTempC) == ("0", "0.0", "33.5")


def test_benchmark_document(spark, tmp_path):
    part = spark.createDataFrame([("f", 1, 0.5)], "frame_id string, tp long, dice double")
    sinks.write_benchmark(sinks.benchmark_document(part, part, part, part), str(tmp_path / "b"))
    back = spark.read.json(str(tmp_path / "b"))
    assert back.count() == 4
    row = back.where("section = 'dataset'").first()
    assert (row.dataset.tp, row.dataset.dice, row.sensitivity_k) == (1, 0.5, None)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_append_once(spark, tmp_path, fmt):
    schema = "run_id string, frame_id string, n long"
    path = str(tmp_path / "audit")
    first = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "b", 2), (None, "c", 3)], schema)
    for _ in range(2):
        sinks.append_once(first, path, ["run_id", "frame_id"], fmt)
    sinks.append_once(spark.createDataFrame([("r", "b", 9), ("s", "a", 4)], schema), path, ["run_id", "frame_id"], fmt)
    back = spark.read.schema(schema).format(fmt).option("header", True).load(path).collect()
    assert sorted(tuple(r) for r in back if r["run_id"]) == [("r", "a", 1), ("r", "b", 2), ("s", "a", 4)]
    assert [r["n"] for r in back if not r["run_id"]] == [3]
