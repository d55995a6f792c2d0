"""Registered queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import colour, geometry, identity, temperature as temp
from ..operators import (
    components as comp, distance as dst, evaluation as ev, neighbourhood as nb, packed,
    regional as rg, regions as reg, segmentation as seg, threshold as thr, triage as tri)
from ..operators.tiles import attach
from ..params import Params, settings_over_defaults
from ..sources.raster import assemble_frames, explode_frames
from ..sources.sinks import audit_export_rows, audit_rows, benchmark_document
from ..staging import checkpoint, release_kept
from . import batch, oracle as sql
from .detect import detect_frames, detect_hotspots
from .inputs import (
    RASTER, RASTER_NO_MARGIN, detected, embedding_frames, embedding_pixels,
    enlarged_frames, events_raster, lineitem_raster, masked, table)
from .sweep import sweep

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def register(fn):
        def run(spark, folder):
            # Stages held for an earlier query would only pile up in a long session.
            release_kept()
            return fn(spark, folder)
        QUERIES[name] = run
        if text is not None:
            ORACLES[name] = text
        return fn
    return register


def on_px(raster: str, select: str) -> str:
    return sql.query([sql.PX[raster]], select)


PIXEL = "frame_id, y, x"
K = 5  # kernel of the line item raster in single-operator queries


# --- scans, layout, sinks -------------------------------------------------------------

@query("raster_events", on_px("events", "SELECT * FROM px"))
def raster_events(spark, d):
    return events_raster(spark, d)


@query("raster_lineitem", on_px("lineitem", "SELECT * FROM px"))
def raster_lineitem(spark, d):
    return lineitem_raster(spark, d)


@query("frame_layout", on_px("embeddings", "SELECT * FROM px"))
def frame_layout(spark, d):
    return embedding_pixels(spark, d).select("frame_id", "y", "x", "v", "height", "width")


@query("frame_round_trip", on_px("events", "SELECT * FROM px"))
def frame_round_trip(spark, d):
    packed_frames = assemble_frames(events_raster(spark, d)).drop("status")
    return explode_frames(packed_frames).select("frame_id", "y", "x", "v", "height", "width")


@query("radiometric_to_grey", on_px("lineitem", """,
counts AS (SELECT *, CASE WHEN frame_id::INT % 2 = 1 THEN 28000 + v * 20 ELSE 150 + v END c
 FROM px),
c AS (SELECT *, max(c) OVER (PARTITION BY frame_id) top FROM counts),
t AS (SELECT *, CASE WHEN top > 10000 THEN c::FLOAT * 0.01::FLOAT - 273.15::FLOAT
 ELSE c::FLOAT * 0.1::FLOAT END celsius FROM c)
SELECT frame_id, y, x, c AS raw, floor((least(greatest(celsius, 20::FLOAT), 40::FLOAT)
 - 20::FLOAT) / 20::FLOAT * 255::FLOAT)::INT v FROM t"""))
def radiometric_to_grey(spark, d):
    raw = F.when(F.col("frame_id").cast("int") % 2 == 1, F.lit(28000) + F.col("v") * 20) \
        .otherwise(F.lit(150) + F.col("v"))
    px = lineitem_raster(spark, d).withColumn("raw", raw)
    top = px.groupBy("frame_id").agg(F.max("raw").alias("top"), F.max("height").alias("height"),
                                     F.max("width").alias("width"))
    return attach(px, top).select(
        "frame_id", "y", "x", "raw",
        temp.radiometric_to_grey(F.col("raw"), F.col("top")).alias("v"))


AUDIT_STEPS = sql.detection("lineitem", K) + ["""top AS (
 SELECT frame_id, max(v) FILTER (WHERE mask) max_v, count(*) FILTER (WHERE hot) hotspot_px,
  sum(v) FILTER (WHERE mask AND x < width // 2)::DOUBLE
   / count(*) FILTER (WHERE mask AND x < width // 2) l,
  sum(v) FILTER (WHERE mask AND x >= width // 2)::DOUBLE
   / count(*) FILTER (WHERE mask AND x >= width // 2) r
 FROM flagged GROUP BY 1)"""]


def _audit(spark, d):
    found = detected(spark, d, "lineitem")
    px = found.flagged()
    surface = thr.surface_statistics(px, RASTER.sigma_k)
    deltas = rg.raw_delta(px)
    stats = (surface.join(deltas.select("frame_id", "delta"), "frame_id", "left")
             .withColumn("max_temp_c", temp.to_celsius(F.col("max_v")))
             .withColumn("symmetry_delta", F.col("delta"))
             .withColumn("image_file", F.concat(F.col("frame_id"), F.lit(".png")))
             .withColumn("patient_id", identity.pseudonym(F.col("frame_id"), F.lit(""), "salt"))
             .withColumns({"sigma_k": F.lit(RASTER.sigma_k), "t_min_c": F.lit(20.0),
                           "tophat_factor": F.lit(RASTER.tophat_factor), "t_max_c": F.lit(40.0)}))
    return audit_rows(stats, "operator", "symmetry",
                      F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("audit_rows", sql.query(AUDIT_STEPS, """
SELECT TIMESTAMP '2024-01-31 00:00:00' ts,
 'ANON-' || upper(substr(sha256(frame_id || '||salt'), 1, 12)) patient_id,
 'symmetry' analysis_mode, frame_id || '.png' image_file, 1.0::DOUBLE sigma_k,
 0.1::DOUBLE tophat_factor, 20.0::DOUBLE t_min_c, 40.0::DOUBLE t_max_c, hotspot_px,
 20.0::DOUBLE + max_v / 255.0::DOUBLE * 20.0::DOUBLE max_temp_c, abs(l - r) symmetry_delta,
 'operator' AS operator FROM top"""))
def audit_table(spark, d):
    return _audit(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("audit_export", """
SELECT '' AS "Timestamp", 'Customer ' || c_custkey AS "PatientID",
 CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE '' END AS "Backend",
 CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT ELSE 0 END AS "HotspotsDetected",
 CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0::DOUBLE END AS "MeanTempC",
 c_acctbal AS "MaxTempC" FROM customer""")
def audit_export(spark, d):
    known = F.col("c_acctbal") > 0
    rows = table(spark, d, "customer").select(
        F.lit(None).cast("timestamp").alias("ts"),
        F.concat(F.lit("Customer "), F.col("c_custkey")).alias("patient_id"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("backend"),
        F.when(known, F.floor("c_acctbal")).alias("hotspot_px"),
        F.when(known, F.col("c_acctbal")).alias("mean_temp_c"),
        F.col("c_acctbal").alias("max_temp_c"))
    return audit_export_rows(rows)


@query("settings_over_defaults", """
SELECT c_custkey, 'default' run_id,
 coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000.0::DOUBLE END, 3.0::DOUBLE) sigma_k,
 0.05::DOUBLE tophat_factor, 0.0005::DOUBLE min_area_factor, 0.08::DOUBLE min_circularity,
 coalesce(CASE WHEN c_nationkey < 10 THEN c_nationkey END, 35) otsu_min, 50 otsu_max,
 0.05::DOUBLE dist_erosion_factor, coalesce(CASE WHEN c_nationkey % 3 > 0
  THEN c_nationkey % 3 = 1 END, false) use_mad,
 20.0::DOUBLE temp_min_c, 40.0::DOUBLE temp_max_c, 2.2::DOUBLE asymmetry_threshold_c,
 0.65::DOUBLE lower_cutoff_y, 0.015::DOUBLE min_dist_factor, 12.0::DOUBLE min_dist_abs,
 10 border_margin, 10 min_area_abs FROM customer""")
def settings(spark, d):
    stored = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 1000.0).alias("sigma_k"),
        F.when(F.col("c_nationkey") < 10, F.col("c_nationkey")).alias("otsu_min"),
        F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey") % 3 == 1).alias("use_mad"))
    return settings_over_defaults(stored)


# --- scalar functions ------------------------------------------------------------------

@query("celsius", on_px("lineitem", f"""
SELECT {PIXEL}, 20.0::DOUBLE + v / 255.0::DOUBLE * 20.0::DOUBLE celsius FROM px"""))
def celsius(spark, d):
    return lineitem_raster(spark, d).select(
        "frame_id", "y", "x", temp.to_celsius(F.col("v")).alias("celsius"))


@query("emissivity", on_px("lineitem", f""",
c AS (SELECT {PIXEL}, 20.0::DOUBLE + v / 255.0::DOUBLE * 20.0::DOUBLE t FROM px)
SELECT {PIXEL}, round(pow(greatest(0.0::DOUBLE, (pow(t + 273.15::DOUBLE, 4.0::DOUBLE)
 - (1.0::DOUBLE - 0.98::DOUBLE) * pow(20.0::DOUBLE + 273.15::DOUBLE, 4.0::DOUBLE))
 / 0.98::DOUBLE), 0.25::DOUBLE) - 273.15::DOUBLE, 6) celsius FROM c"""))
def emissivity(spark, d):
    return lineitem_raster(spark, d).select(
        "frame_id", "y", "x",
        F.round(temp.to_celsius(F.col("v"), emissivity=True), 6).alias("celsius"))


@query("temperature_units", on_px("lineitem", f""",
c AS (SELECT {PIXEL}, v, 20.0::DOUBLE + v / 255.0::DOUBLE * 20.0::DOUBLE t,
 v / 255.0::DOUBLE * 20.0::DOUBLE d FROM px)
SELECT {PIXEL}, t * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE fahrenheit,
 t + 273.15::DOUBLE kelvin, d delta_c, d * 9.0::DOUBLE / 5.0::DOUBLE delta_f,
 v / 255.0::DOUBLE * greatest(1.0::DOUBLE, 0.5::DOUBLE) delta_narrow FROM c"""))
def temperature_units(spark, d):
    v = F.col("v")
    return lineitem_raster(spark, d).select(
        "frame_id", "y", "x", temp.to_unit(v, "F").alias("fahrenheit"),
        temp.to_unit(v, "K").alias("kelvin"), temp.to_delta(v).alias("delta_c"),
        temp.to_delta(v, "F").alias("delta_f"),
        temp.to_delta(v, "C", 20.0, 20.5).alias("delta_narrow"))


@query("temperature_text", on_px("lineitem", f""",
c AS (SELECT {PIXEL}, v, 20.0::DOUBLE + v / 255.0::DOUBLE * 20.0::DOUBLE t FROM px)
SELECT {PIXEL}, printf('%.1f °C', t) celsius,
 printf('%.1f °F', t * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE) fahrenheit,
 printf('%.1f K', t + 273.15::DOUBLE) kelvin,
 printf('%.1f °C', v / 255.0::DOUBLE * 20.0::DOUBLE) delta FROM c"""))
def temperature_text(spark, d):
    v = F.col("v")
    return lineitem_raster(spark, d).select(
        "frame_id", "y", "x", temp.as_text(temp.to_unit(v)).alias("celsius"),
        temp.as_text(temp.to_unit(v, "F"), "F").alias("fahrenheit"),
        temp.as_text(temp.to_unit(v, "K"), "K").alias("kelvin"),
        temp.as_text(temp.to_delta(v)).alias("delta"))


@query("calibration_offset", on_px("lineitem", f""",
c AS (SELECT *, (frame_id::INT - 4) * 1.5::DOUBLE o,
 CASE WHEN frame_id = '7' THEN 20.0::DOUBLE ELSE 15.0::DOUBLE + frame_id::INT END span0 FROM px)
SELECT {PIXEL}, greatest(0, least(255, v + round_even(o * 255.0::DOUBLE
 / CASE WHEN frame_id = '7' THEN 20.0::DOUBLE ELSE span0 END, 0)::INT))::INT v FROM c"""))
def calibration_offset(spark, d):
    n = F.col("frame_id").cast("int")
    t_max = F.when(n == 7, F.lit(20.0)).otherwise(F.lit(35.0) + n)
    return lineitem_raster(spark, d).select(
        "frame_id", "y", "x",
        temp.calibrate(F.col("v"), (n - 4) * 1.5, F.lit(20.0), t_max).alias("v"))


@query("calibration_range", """
SELECT c_custkey, CASE WHEN hi <= lo THEN lo + 1.0::DOUBLE ELSE hi END t_max,
 (CASE WHEN hi <= lo THEN lo + 1.0::DOUBLE ELSE hi END - lo) / 255.0::DOUBLE per_step
FROM (SELECT c_custkey, c_nationkey::DOUBLE lo, c_acctbal / 100.0::DOUBLE hi FROM customer)""")
def calibration_range(spark, d):
    lo, hi = F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 100.0
    return table(spark, d, "customer").select(
        "c_custkey", temp.repair_range(lo, hi).alias("t_max"),
        temp.degrees_per_step(lo, hi).alias("per_step"))


@query("pseudonyms", """
SELECT c_custkey, 'ANON-' || upper(substr(sha256(lower(c_name) || '|' || c_mktsegment
 || '|salt'), 1, 12)) pseudonym FROM customer""")
def pseudonyms(spark, d):
    padded = F.concat(F.lit(" \t"), F.upper("c_name"), F.lit("\n "))
    return table(spark, d, "customer").select(
        "c_custkey", identity.pseudonym(
            padded, F.concat(F.lit(" "), F.col("c_mktsegment")), "salt").alias("pseudonym"))


@query("odd_kernel", """
SELECT p_partkey, greatest(3, floor(least(p_size * 13, p_partkey % 700 + 1)
 * 0.05::DOUBLE)::INT | 1)::INT k FROM part""")
def odd_kernel(spark, d):
    return table(spark, d, "part").select("p_partkey", geometry.odd_kernel(
        F.col("p_size") * 13, F.col("p_partkey") % 700 + 1, 0.05).alias("k"))


@query("normalise", on_px("lineitem", f"""
SELECT {PIXEL}, CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) * 255.0::DOUBLE / (hi - lo)) END::INT
 norm FROM px JOIN (SELECT frame_id, min(v) lo, max(v) hi FROM px GROUP BY 1) USING (frame_id)"""))
def normalise(spark, d):
    return seg.normalise(lineitem_raster(spark, d)).select("frame_id", "y", "x", "norm")


@query("overlay", sql.query(sql.detection("lineitem", K), f"""
SELECT {PIXEL}, CASE WHEN hot THEN round_even(v * 0.3::DOUBLE + 0.7::DOUBLE * 85.0::DOUBLE, 0)
 ELSE v END::INT b,
 CASE WHEN hot THEN round_even(v * 0.3::DOUBLE + 0.7::DOUBLE * 0.0::DOUBLE, 0) ELSE v END::INT g,
 CASE WHEN hot THEN round_even(v * 0.3::DOUBLE + 0.7::DOUBLE * 255.0::DOUBLE, 0) ELSE v END::INT r
FROM flagged"""))
def overlay(spark, d):
    px = detected(spark, d, "lineitem").flagged()
    return colour.overlay(px, colour.grey_palette(spark)).select(
        "frame_id", "y", "x", "b", "g", "r")


# --- neighbourhoods ----------------------------------------------------------------------

@query("box_blur", sql.query([sql.PX["lineitem"], sql.BLUR],
                             f"SELECT {PIXEL}, blur FROM blurred"))
def box_blur(spark, d):
    return nb.box_blur(lineitem_raster(spark, d)).select("frame_id", "y", "x", "blur")


def _square(name, op, agg, out):
    @query(name, sql.query([sql.PX["lineitem"], sql.near("n", agg, "px", "v", out, K // 2)],
                           f"SELECT {PIXEL}, {out} FROM n"))
    def run(spark, d):
        return op(lineitem_raster(spark, d), K).select("frame_id", "y", "x", out)


_square("dilate", nb.dilate, "max", "dilated")
_square("erode", nb.erode, "min", "eroded")


def _double(name, op, first, second, out):
    steps = [sql.PX["lineitem"], sql.near("a", first, "px", "v", "m", K // 2),
             sql.near("b", second, "a", "m", out, K // 2)]

    @query(name, sql.query(steps, f"SELECT {PIXEL}, {out} FROM b"))
    def run(spark, d):
        return op(lineitem_raster(spark, d), K).select("frame_id", "y", "x", out)


_double("opening", nb.opening, "min", "max", "opened")
_double("closing", nb.closing, "max", "min", "closed")


@query("top_hat", sql.query([sql.PX["lineitem"], sql.hat(K, "v", "px")],
                            f"SELECT {PIXEL}, tophat FROM hat"))
def top_hat(spark, d):
    return nb.top_hat(lineitem_raster(spark, d), K).select("frame_id", "y", "x", "tophat")


@query("top_hat_small_tiles", sql.query([sql.PX["lineitem"], sql.hat(K, "v", "px")],
                                        f"SELECT {PIXEL}, tophat FROM hat"))
def top_hat_small_tiles(spark, d):
    return nb.top_hat(lineitem_raster(spark, d), K, tile=16).select("frame_id", "y", "x", "tophat")


@query("masked_top_hat", sql.query([*sql.segmented("lineitem"), sql.hat(K), sql.DIFF],
                                   f"SELECT {PIXEL}, mask, diff FROM staged"))
def masked_top_hat(spark, d):
    return nb.masked_top_hat(masked(spark, d, "lineitem"), K).select(
        "frame_id", "y", "x", "mask", "diff")


@query("top_hat_ellipse", sql.query(sql.ellipse(K, "lineitem"), f"""
SELECT {PIXEL}, greatest(v - o, 0)::INT tophat FROM px JOIN opn USING ({PIXEL})"""))
def top_hat_ellipse(spark, d):
    return nb.top_hat_ellipse(lineitem_raster(spark, d), K).select(
        "frame_id", "y", "x", "tophat")


@query("packed_blur_top_hat", sql.query(
    [sql.PX["embeddings"], sql.IMG_BLUR, sql.hat(3)],
    f"SELECT {PIXEL}, g AS blur, tophat FROM img JOIN hat USING ({PIXEL})"))
def packed_blur_top_hat(spark, d):
    frames = embedding_frames(spark, d)
    hats = packed.with_blur_and_top_hat(frames, RASTER.tophat_factor)
    return explode_frames(hats.drop("px"), "blur", "tophat").select(
        "frame_id", "y", "x", "blur", "tophat")


# --- segmentation ------------------------------------------------------------------------

@query("histogram", on_px("lineitem", "SELECT frame_id, v, count(*) n FROM px GROUP BY ALL"))
def histogram(spark, d):
    return seg.histogram(lineitem_raster(spark, d)).select("frame_id", "v", "n")


def _levels(name, raster, source):
    @query(name, sql.query([sql.PX[raster], sql.IMG_RAW, sql.level()],
                           "SELECT frame_id, otsu, v_min, v_max, body_threshold FROM level"))
    def run(spark, d):
        return seg.frame_levels(source(spark, d)).select(
            "frame_id", "otsu", "v_min", "v_max", "body_threshold")


_levels("otsu_levels", "lineitem", lineitem_raster)
_levels("otsu_levels_events", "events", events_raster)
_levels("otsu_levels_embeddings", "embeddings", embedding_pixels)


@query("binarise", sql.query([sql.PX["lineitem"], sql.IMG_RAW, sql.level(), sql.FG],
                             f"SELECT {PIXEL}, fg FROM fg"))
def binarise(spark, d):
    px = lineitem_raster(spark, d)
    return seg.binarise(px, seg.frame_levels(px)).select("frame_id", "y", "x", "fg")


def _distance(name, raster, source, tile):
    @query(name, sql.query([sql.PX[raster], sql.IMG_RAW, sql.level(), sql.FG, sql.DIST],
                           f"SELECT {PIXEL}, dist3 FROM dist"))
    def run(spark, d):
        px = source(spark, d)
        fg = seg.binarise(px, seg.frame_levels(px), tile=tile)
        return dst.distance(fg, tile).select("frame_id", "y", "x", "dist3")


_distance("distance", "lineitem", lineitem_raster, dst.TILE)
_distance("distance_events", "events", events_raster, dst.TILE)
_distance("distance_across_tiles", "events", events_raster, 8)


@query("body_mask", sql.query(sql.segmented("lineitem"), f"SELECT {PIXEL}, dist3, mask FROM body"))
def body_mask(spark, d):
    return masked(spark, d, "lineitem").select("frame_id", "y", "x", "dist3", "mask")


@query("body_mask_embeddings", sql.query(sql.segmented("embeddings"),
                                         f"SELECT {PIXEL}, dist3, mask FROM body"))
def body_mask_embeddings(spark, d):
    return masked(spark, d, "embeddings").select("frame_id", "y", "x", "dist3", "mask")


# --- statistics and thresholds --------------------------------------------------------------

DIFF_STEPS = [*sql.segmented("lineitem"), sql.hat(K), sql.DIFF]


def _differences(spark, d):
    return nb.masked_top_hat(masked(spark, d, "lineitem"), K)


@query("gauss_threshold", sql.query([*DIFF_STEPS, sql.cut(3.0)], """
SELECT frame_id, body_px, centre, sigma, baseline, t diff_threshold FROM cut"""))
def gauss_threshold(spark, d):
    return thr.outlier_threshold(_differences(spark, d)).drop("height", "width")


@query("mad_threshold", sql.query([*DIFF_STEPS, sql.cut(3.0, True)], """
SELECT frame_id, body_px, centre, sigma, baseline, mad_is_zero, t diff_threshold FROM cut"""))
def mad_threshold(spark, d):
    return thr.outlier_threshold(_differences(spark, d), use_mad=True).drop("height", "width")


@query("accelerator_threshold", sql.query([*DIFF_STEPS, """m AS (
 SELECT frame_id, count(*) n, sum(diff) s, sum(diff * diff) ss, sum(g) sg
 FROM staged WHERE mask GROUP BY 1),
st AS (SELECT frame_id, n body_px, s::DOUBLE / n centre,
 sqrt(greatest((ss - s::DOUBLE * s / n) / (n - 1), 0.0::DOUBLE)) sigma, sg::DOUBLE / n baseline
 FROM m)"""], """
SELECT *, centre + 3.0::DOUBLE * sigma diff_threshold FROM st"""))
def accelerator_threshold(spark, d):
    return thr.outlier_threshold(_differences(spark, d), variant="accelerator") \
        .drop("height", "width")


@query("accelerator_mad_threshold", sql.query([*DIFF_STEPS, """m AS (
 SELECT frame_id, count(*) body_px, quantile_disc(diff, 0.5)::DOUBLE centre,
  quantile_disc(g, 0.5)::DOUBLE baseline FROM staged WHERE mask GROUP BY 1),
dv AS (SELECT frame_id, quantile_disc(abs(diff - centre), 0.5)::DOUBLE mad
 FROM staged JOIN m USING (frame_id) WHERE mask GROUP BY 1)"""], """
SELECT m.*, 1.4826::DOUBLE * mad sigma, mad = 0 mad_is_zero,
 centre + 3.0::DOUBLE * (1.4826::DOUBLE * mad) diff_threshold FROM m JOIN dv USING (frame_id)"""))
def accelerator_mad_threshold(spark, d):
    return thr.outlier_threshold(_differences(spark, d), use_mad=True, variant="accelerator") \
        .drop("height", "width")


@query("outliers", sql.query([*DIFF_STEPS, sql.cut(1.0), sql.raw()],
                             f"SELECT {PIXEL}, diff FROM raw"))
def outliers(spark, d):
    px = _differences(spark, d)
    return thr.outliers(px, thr.outlier_threshold(px, 1.0)).select("frame_id", "y", "x", "diff")


@query("intensity_histogram", sql.query([*sql.segmented("lineitem"), """e AS (
 SELECT frame_id, min(v) lo, max(v) hi FROM body WHERE mask GROUP BY 1),
b AS (SELECT frame_id, lo, hi, CASE WHEN lo = hi THEN 64
  ELSE least(floor((v - lo) * 128 / (hi - lo)::DOUBLE)::INT, 127) END::INT bin
 FROM body JOIN e USING (frame_id) WHERE mask)"""], """
SELECT frame_id, bin, count(*) px,
 20.0::DOUBLE + lo * (20.0::DOUBLE / 255.0::DOUBLE)
  - CASE WHEN lo = hi THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + bin * CASE WHEN lo = hi
  THEN 0.0078125::DOUBLE ELSE (hi - lo) * (20.0::DOUBLE / 255.0::DOUBLE) / 128 END from_c,
 20.0::DOUBLE + lo * (20.0::DOUBLE / 255.0::DOUBLE)
  - CASE WHEN lo = hi THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + (bin + 1) * CASE WHEN lo = hi
  THEN 0.0078125::DOUBLE ELSE (hi - lo) * (20.0::DOUBLE / 255.0::DOUBLE) / 128 END to_c
FROM b GROUP BY frame_id, bin, lo, hi"""))
def intensity_histogram(spark, d):
    return thr.intensity_histogram(masked(spark, d, "lineitem").where("mask"))


SURFACE = """surface AS (
 SELECT frame_id, count(*) FILTER (WHERE mask) body_px, sum(v) FILTER (WHERE mask)::DOUBLE s,
  sum(v * v) FILTER (WHERE mask)::DOUBLE ss, max(v) FILTER (WHERE mask) max_v,
  count(*) FILTER (WHERE hot) hotspot_px, max(height) height, max(width) width
 FROM flagged GROUP BY 1),
stats AS (SELECT frame_id, body_px, s / body_px mean_v,
 CASE WHEN body_px > 0 THEN sqrt(greatest(ss / body_px - (s / body_px) * (s / body_px),
  0.0::DOUBLE)) END std_v, max_v, hotspot_px,
 CASE WHEN body_px > 0 THEN hotspot_px / body_px::DOUBLE * 100.0::DOUBLE END hotspot_percent,
 CASE WHEN body_px > 0 THEN 'ok' ELSE 'empty_body_mask' END body_status, height, width
 FROM surface)"""


DIM = sql.PX["lineitem"].replace("px AS MATERIALIZED", "bright AS MATERIALIZED") + """,
px AS MATERIALIZED (SELECT frame_id, y, x, CASE WHEN frame_id IN ('2', '5') THEN 0 ELSE v END::INT v,
 height, width FROM bright)"""


@query("surface_empty_body", sql.query([DIM, *sql.detection("lineitem", K)[1:], SURFACE], """
SELECT frame_id, body_px, mean_v, std_v, mean_v + 1.0::DOUBLE * std_v intensity_threshold,
 max_v, hotspot_px, hotspot_percent, body_status FROM stats"""))
def surface_empty_body(spark, d):
    """Two frames without a body keep their rows."""
    v = F.when(F.col("frame_id").isin("2", "5"), 0).otherwise(F.col("v"))
    found = detect_hotspots(lineitem_raster(spark, d).withColumn("v", v), RASTER)
    return thr.surface_statistics(found.flagged(), RASTER.sigma_k)


@query("surface_statistics", sql.query([*sql.detection("lineitem", K), SURFACE], """
SELECT frame_id, body_px, mean_v, std_v, mean_v + 1.0::DOUBLE * std_v intensity_threshold,
 max_v, hotspot_px, hotspot_percent, body_status FROM stats"""))
def surface_statistics(spark, d):
    return thr.surface_statistics(detected(spark, d, "lineitem").flagged(), RASTER.sigma_k)


COVERAGE = """cover AS (SELECT frame_id, body_px, hotspot_px, height, width,
 CASE WHEN body_px > 0 THEN round_even(hotspot_px / body_px::DOUBLE * 100.0::DOUBLE, 2)
  ELSE 0.0::DOUBLE END coverage_percent,
 CASE WHEN body_px > 0 THEN 'ok' ELSE 'empty_body_mask' END status FROM surface)"""


@query("coverage", sql.query([*sql.detection("lineitem", K), SURFACE, COVERAGE],
                             "SELECT * FROM cover"))
def coverage(spark, d):
    return thr.coverage(detected(spark, d, "lineitem").flagged())


@query("coverage_summary", sql.query([*sql.detection("events", 3), SURFACE, COVERAGE], """
SELECT count(*) frames, round(avg(coverage_percent), 6) mean_coverage,
 max(coverage_percent) max_coverage FROM cover"""))
def coverage_summary(spark, d):
    return thr.coverage_summary(thr.coverage(detected(spark, d, "events").flagged())) \
        .withColumn("mean_coverage", F.round("mean_coverage", 6))


# --- components and regions ---------------------------------------------------------------------

def _components(name, raster, k, connectivity, tile=comp.TILE):
    steps = sql.detection(raster, k)[:10] + [sql.labels(connectivity)]

    @query(name, sql.query(steps, f"SELECT {PIXEL}, comp_id FROM lab"))
    def run(spark, d):
        raw = detected(spark, d, raster).raw.drop("comp_id", "boundary")
        return comp.components(raw, connectivity, tile).select("frame_id", "y", "x", "comp_id")


_components("components_4", "lineitem", K, 4)
_components("components_8", "lineitem", K, 8)
_components("components_4_across_tiles", "lineitem", K, 4, 8)
_components("components_8_across_tiles", "events", 3, 8, 4)

REGION = ("frame_id, comp_id, area, perimeter, touches_border, max_dist3, centroid_y, centroid_x, "
          "mean_v, max_v, x0, y0, x1, y1, circularity")


def _columns(text):
    return [c.strip() for c in text.split(",")]


@query("region_stats", sql.query(sql.detection("lineitem", K)[:12], f"SELECT {REGION} FROM reg"))
def region_stats(spark, d):
    return detected(spark, d, "lineitem").regions.select(*_columns(REGION))


def _filtered(name, raster, k, params):
    @query(name, sql.query(sql.detection(raster, k, params)[:13],
                           "SELECT frame_id, comp_id, area, reject_reason FROM judged"))
    def run(spark, d):
        return detected(spark, d, raster, params).regions.select(
            "frame_id", "comp_id", "area", "reject_reason")


_filtered("geometric_filter", "lineitem", K, RASTER)
_filtered("geometric_filter_events", "events", 3, RASTER_NO_MARGIN)
STRICT = replace(RASTER, lower_cutoff_y=0.65, min_dist_abs=1.5, min_area_abs=4,
                 min_circularity=1.2, border_margin=2)
_filtered("geometric_filter_strict", "lineitem", K, STRICT)

BBOX_STEPS = sql.detection("lineitem", K, RASTER)[:8] + [
    sql.cut(1.0),
    """inner_d AS (SELECT a.frame_id, a.y, a.x, min(3 * greatest(abs(a.y - b.y), abs(a.x - b.x))
  + least(abs(a.y - b.y), abs(a.x - b.x))) d
 FROM staged a JOIN staged b ON a.frame_id = b.frame_id WHERE a.mask AND NOT b.mask GROUP BY ALL),
redone AS MATERIALIZED (SELECT s.* EXCLUDE (dist3), CASE WHEN NOT s.mask THEN 0
  ELSE coalesce(d, 1073741824) END::INT dist3
 FROM staged s LEFT JOIN inner_d USING (frame_id, y, x)),
raw AS MATERIALIZED (SELECT s.* FROM redone s JOIN cut USING (frame_id)
 WHERE diff > t AND g > baseline)""",
    sql.labels(8), sql.regions(RASTER), sql.judged(RASTER, bbox=True)]


@query("bounding_box_filter", sql.query(
    BBOX_STEPS, "SELECT frame_id, comp_id, area, reject_reason FROM judged"))
def bounding_box_filter(spark, d):
    found = detected(spark, d, "lineitem")
    inner = dst.distance(found.pixels.drop("dist3").withColumn("fg", F.col("mask")))
    limits = thr.outlier_threshold(inner, RASTER.sigma_k, img="blur")
    raw = thr.outliers(inner, limits, img="blur")
    _, regions = reg.region_stats(raw, RASTER.border_margin, 8)
    return reg.filter_regions(regions, limits, RASTER, "bbox").select(
        "frame_id", "comp_id", "area", "reject_reason")


@query("fill_holes", sql.query(sql.detection("lineitem", K, RASTER_NO_MARGIN, connectivity=8)[:14] + [
    """extent AS MATERIALIZED (SELECT frame_id, comp_id, min(y) y0, max(y) y1, min(x) x0, max(x) x1
 FROM hot GROUP BY ALL),
outside AS MATERIALIZED (
 SELECT b.frame_id, b.comp_id, p.y, p.x, p.y = y0 OR p.y = y1 OR p.x = x0 OR p.x = x1 rim
 FROM extent b JOIN px p ON p.frame_id = b.frame_id AND p.y BETWEEN y0 AND y1
  AND p.x BETWEEN x0 AND x1
 ANTI JOIN hot h ON h.frame_id = b.frame_id AND h.comp_id = b.comp_id AND h.y = p.y AND h.x = p.x),
open_air AS (
 SELECT frame_id, comp_id, y, x FROM outside WHERE rim
 UNION
 SELECT n.frame_id, n.comp_id, n.y, n.x FROM open_air c
 JOIN (SELECT dy, dx FROM """ + sql.offsets(1) + """ WHERE abs(dy) + abs(dx) = 1) o ON true
 JOIN outside n ON n.frame_id = c.frame_id AND n.comp_id = c.comp_id
  AND n.y = c.y + o.dy AND n.x = c.x + o.dx)"""], """
SELECT frame_id, comp_id, y, x FROM hot
UNION ALL SELECT frame_id, comp_id, y, x FROM outside ANTI JOIN open_air
 USING (frame_id, comp_id, y, x)"""))
def fill_holes(spark, d):
    found = detected(spark, d, "lineitem", RASTER_NO_MARGIN)
    raw = found.raw.drop("comp_id", "boundary", "run_id")
    labelled, regions = reg.region_stats(raw, -1, 8)
    judged = reg.filter_regions(regions, found.frame_stats.drop("run_id"), RASTER_NO_MARGIN)
    return reg.fill_holes(reg.kept_pixels(labelled, judged), judged)


HOTSPOTS = sql.detection("lineitem", K, RASTER_NO_MARGIN)[:13] + ["""spots AS (
 SELECT *, CASE WHEN area >= 150 OR mean_v >= 180 THEN 'relevant'
  WHEN area >= 50 OR mean_v >= 140 THEN 'borderline' ELSE 'minor' END severity
 FROM judged WHERE reject_reason IS NULL),
summary AS (SELECT l.frame_id, count(s.comp_id) hotspots,
 coalesce(max(area), 0) largest_area, coalesce(sum(area), 0)::BIGINT hotspot_px,
 round(coalesce(avg(mean_v), 0.0), 6) mean_of_means,
 CASE WHEN coalesce(sum(area), 0) = 0 THEN 'normal' WHEN sum(area) < 150 THEN 'borderline'
  ELSE 'clinical' END finding
 FROM level l LEFT JOIN spots s USING (frame_id) GROUP BY 1)"""]


def _spots(found):
    return found.regions.where("reject_reason is null").drop("run_id")


@query("hotspot_table", sql.query(HOTSPOTS, """
SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, comp_id)::INT rank,
 comp_id, area, mean_v, max_v, x0 bbox_x, y0 bbox_y, x1 - x0 + 1 bbox_w, y1 - y0 + 1 bbox_h,
 centroid_y, centroid_x, severity FROM spots"""))
def hotspot_table(spark, d):
    spots = reg.hotspot_table(_spots(detected(spark, d, "lineitem", RASTER_NO_MARGIN)))
    return spots.select("*", *[F.col(f"bbox.{c}").alias(f"bbox_{c}") for c in "xywh"]).drop("bbox")


def _summary(found):
    return reg.hotspot_summary(found.frame_stats.select("frame_id"), _spots(found)) \
        .withColumn("mean_of_means", F.round("mean_of_means", 6))


@query("hotspot_summary", sql.query(HOTSPOTS, "SELECT * FROM summary"))
def hotspot_summary(spark, d):
    return _summary(detected(spark, d, "lineitem", RASTER_NO_MARGIN))


# --- regional comparison ------------------------------------------------------------------------

SIDES = """sides AS (
 SELECT frame_id, count(*) FILTER (WHERE mask AND x < width // 2) left_px,
  count(*) FILTER (WHERE mask AND x >= width // 2) right_px,
  sum(v) FILTER (WHERE mask AND x < width // 2)::DOUBLE
   / count(*) FILTER (WHERE mask AND x < width // 2) left_mean,
  sum(v) FILTER (WHERE mask AND x >= width // 2)::DOUBLE
   / count(*) FILTER (WHERE mask AND x >= width // 2) right_mean
 FROM {source} GROUP BY 1)"""


@query("asymmetry", sql.query([*sql.segmented("embeddings"), SIDES.format(source="body"), """c AS (
 SELECT *, left_px > 0 AND right_px > 0 both_sides,
  20.0::DOUBLE + left_mean / 255.0::DOUBLE * 20.0::DOUBLE l,
  20.0::DOUBLE + right_mean / 255.0::DOUBLE * 20.0::DOUBLE r FROM sides)"""], """
SELECT frame_id, CASE WHEN both_sides THEN round_even(l, 2) END left_mean_c,
 CASE WHEN both_sides THEN round_even(r, 2) END right_mean_c,
 CASE WHEN both_sides THEN round_even(abs(l - r), 2) END delta_c,
 both_sides AND coalesce(abs(l - r) > 2.2::DOUBLE, false) is_asymmetric,
 CASE WHEN left_px = 0 AND right_px = 0 THEN 'no_tissue' WHEN NOT both_sides THEN 'one_sided'
  WHEN abs(l - r) > 2.2::DOUBLE THEN 'asymmetric' ELSE 'symmetric' END status FROM c"""))
def asymmetry(spark, d):
    return rg.asymmetry(masked(spark, d, "embeddings"))


@query("raw_delta", sql.query([*sql.segmented("embeddings"), SIDES.format(source="body")], """
SELECT *, abs(left_mean - right_mean) delta,
 CASE WHEN left_mean IS NULL OR right_mean IS NULL THEN 'no_data'
  WHEN abs(left_mean - right_mean) >= 15 THEN 'asymmetric' ELSE 'symmetric' END status
FROM sides"""))
def raw_delta(spark, d):
    return rg.raw_delta(masked(spark, d, "embeddings"))


BOXES = """boxes AS MATERIALIZED (
 SELECT frame_id, CASE WHEN x < width // 2 THEN 'left' ELSE 'right' END side, min(x) x0,
  min(y) y0, max(x) x1, max(y) y1 FROM {source} WHERE mask GROUP BY ALL)"""


@query("side_boxes", sql.query([*sql.segmented("events"), BOXES.format(source="body")],
                               "SELECT * FROM boxes"))
def side_boxes(spark, d):
    return rg.side_boxes(masked(spark, d, "events")).drop("height", "width")


ZONES = """zones AS MATERIALIZED (
 SELECT b.frame_id, b.side, z.zone, count(p.y) px,
  coalesce(sum(p.v)::DOUBLE / nullif(count(p.y), 0), 0.0::DOUBLE) mean_v
 FROM boxes b CROSS JOIN (VALUES ('fore', 0), ('mid', 1), ('heel', 2)) z(zone, i)
 LEFT JOIN {source} p ON p.frame_id = b.frame_id AND p.mask
  AND CASE WHEN p.x < p.width // 2 THEN 'left' ELSE 'right' END = b.side
  AND p.y >= b.y0 + z.i * ((b.y1 - b.y0) // 3)
  AND p.y < CASE WHEN z.i = 2 THEN b.y1 ELSE b.y0 + (z.i + 1) * ((b.y1 - b.y0) // 3) END
 GROUP BY ALL)"""


@query("zones", sql.query([*sql.segmented("lineitem"), BOXES.format(source="body"),
                           ZONES.format(source="body")], "SELECT * FROM zones"))
def zones(spark, d):
    return rg.zones(masked(spark, d, "lineitem"))


PAIRS = """pairs AS (SELECT l.frame_id, l.zone, l.mean_v left_mean, r.mean_v right_mean,
  abs(l.mean_v - r.mean_v) delta
 FROM zones l JOIN zones r ON l.frame_id = r.frame_id AND l.zone = r.zone
 WHERE l.side = 'left' AND r.side = 'right')"""


@query("zone_deltas", sql.query([*sql.segmented("embeddings"), BOXES.format(source="body"),
                                 ZONES.format(source="body"), PAIRS], """
SELECT *, CASE WHEN delta >= 15 THEN 'asymmetric' WHEN delta >= 10 THEN 'borderline'
 ELSE 'symmetric' END AS class FROM pairs"""))
def zone_deltas(spark, d):
    return rg.zone_deltas(rg.zones(masked(spark, d, "embeddings")))


ROIS = """rois AS (
 SELECT c_name roi_id, (c_custkey % 7 + 1)::VARCHAR frame_id, (c_custkey % 50)::INT x1,
  ((c_custkey * 7) % 50)::INT x2, c_nationkey y1, (c_nationkey + c_custkey % 60)::INT y2
 FROM customer)"""


def _rois(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_name").alias("roi_id"), (c % 7 + 1).cast("string").alias("frame_id"),
        (c % 50).cast("int").alias("x1"), ((c * 7) % 50).cast("int").alias("x2"),
        F.col("c_nationkey").alias("y1"),
        (F.col("c_nationkey") + c % 60).cast("int").alias("y2"))


@query("roi_stats", sql.query([sql.PX["lineitem"], ROIS, """s AS (
 SELECT roi_id, frame_id, count(*) px, min(v) min_v, max(v) max_v, sum(v)::DOUBLE s,
  sum(v * v)::DOUBLE ss
 FROM rois JOIN px USING (frame_id)
 WHERE x >= least(x1, x2) AND x < greatest(x1, x2) AND y >= least(y1, y2)
  AND y < greatest(y1, y2) AND abs(x1 - x2) >= 2 AND abs(y1 - y2) >= 2 GROUP BY ALL)"""], """
SELECT roi_id, frame_id, px, min_v, max_v, s / px mean_v,
 sqrt(greatest(ss / px - (s / px) * (s / px), 0.0::DOUBLE)) std_v FROM s"""))
def roi_stats(spark, d):
    return rg.roi_stats(lineitem_raster(spark, d), _rois(spark, d))


@query("probe_points", sql.query([*sql.detection("lineitem", K), """points AS (
 SELECT c_name point_id, (c_custkey % 7 + 1)::VARCHAR frame_id,
  (c_custkey % 2000 - 30)::INT y, c_nationkey * 3 - 8 x FROM customer),
size AS (SELECT DISTINCT frame_id, height, width FROM px),
inside AS (SELECT point_id, frame_id, least(greatest(y, 0), height - 1)::INT y,
 least(greatest(x, 0), width - 1)::INT x FROM points JOIN size USING (frame_id))"""], """
SELECT point_id, frame_id, y, x, v, hot is_hotspot,
 20.0::DOUBLE + v / 255.0::DOUBLE * 20.0::DOUBLE celsius
FROM inside JOIN flagged USING (frame_id, y, x)"""))
def probe_points(spark, d):
    found = detected(spark, d, "lineitem")
    points = table(spark, d, "customer").select(
        F.col("c_name").alias("point_id"),
        (F.col("c_custkey") % 7 + 1).cast("string").alias("frame_id"),
        (F.col("c_custkey") % 2000 - 30).cast("int").alias("y"),
        (F.col("c_nationkey") * 3 - 8).alias("x"))
    return rg.probe_points(found.flagged(), points, found.frame_stats)


TRIAGE = [SIDES.format(source="flagged"), BOXES.format(source="flagged"),
          ZONES.format(source="flagged"), """per_zone AS (
 SELECT frame_id, zone, abs(coalesce(max(mean_v) FILTER (WHERE side = 'left'), 0.0)
  - coalesce(max(mean_v) FILTER (WHERE side = 'right'), 0.0)) d FROM zones GROUP BY ALL),
measures AS (
 SELECT s.frame_id, h.hotspot_px, abs(coalesce(left_mean, 0.0) - coalesce(right_mean, 0.0)) delta,
  coalesce(max_zone_delta, 0.0) max_zone_delta
 FROM sides s JOIN (SELECT frame_id, count(*) FILTER (WHERE hot) hotspot_px FROM flagged GROUP BY 1)
  h USING (frame_id)
 LEFT JOIN (SELECT frame_id, max(d) max_zone_delta FROM per_zone GROUP BY 1) USING (frame_id)),
triaged AS (SELECT *, CASE WHEN delta >= 15 OR hotspot_px >= 150 OR max_zone_delta >= 15
  THEN 'clinical' WHEN delta >= 10 OR hotspot_px > 0 OR max_zone_delta >= 10 THEN 'borderline'
  ELSE 'normal' END status FROM measures)"""]


def _triaged(found):
    px = found.flagged()
    return tri.triage_symmetry(found.frame_stats.drop("run_id"),
                               tri.symmetry_deltas(rg.side_means(px)),
                               rg.largest_zone_delta(rg.zones(px)))


@query("triage_symmetry", sql.query(sql.detection("events", 3) + TRIAGE, "SELECT * FROM triaged"))
def triage_symmetry(spark, d):
    return _triaged(detected(spark, d, "events"))


@query("triage_general", sql.query(HOTSPOTS, """
SELECT frame_id, hotspot_px, hotspots, largest_area, finding status FROM summary"""))
def triage_general(spark, d):
    return tri.triage_general(_summary(detected(spark, d, "lineitem", RASTER_NO_MARGIN)))


@query("batch_summary", sql.query(sql.detection("lineitem", K) + TRIAGE, """
SELECT frame_id, printf('%d px', hotspot_px) hotspots,
 printf('%.1f °C', delta / 255.0::DOUBLE * 20.0::DOUBLE) delta,
 printf('%.1f °C', max_zone_delta / 255.0::DOUBLE * 20.0::DOUBLE) zone_delta, status
FROM triaged"""))
def batch_summary(spark, d):
    return tri.batch_summary(_triaged(detected(spark, d, "lineitem")))


@query("batch_summary_general", sql.query(HOTSPOTS, """
SELECT frame_id, printf('%d px', hotspot_px) hotspots, printf('%d px', hotspots) delta,
 printf('%d px', largest_area) zone_delta, finding status FROM summary"""))
def batch_summary_general(spark, d):
    found = detected(spark, d, "lineitem", RASTER_NO_MARGIN)
    return tri.batch_summary(tri.triage_general(_summary(found)).select("*"), "general")


def _c(column):
    return f"20.0::DOUBLE + {column} / 255.0::DOUBLE * 20.0::DOUBLE"


ZONE_COLUMNS = ", ".join(
    f"coalesce(max(mean_v) FILTER (WHERE side = '{s}' AND zone = '{z}'), 0.0::DOUBLE) {s}_{z}"
    for s in ("left", "right") for z in rg.ZONES)


@query("report_rows", sql.query([
    *sql.detection("lineitem", K, RASTER_NO_MARGIN), SURFACE, *HOTSPOTS[13:], *TRIAGE,
    f"wide AS (SELECT frame_id, {ZONE_COLUMNS} FROM zones GROUP BY 1)"], f"""
SELECT frame_id, body_px, st.hotspot_px, hotspot_percent, {_c('st.mean_v')} mean,
 std_v / 255.0::DOUBLE * 20.0::DOUBLE std, {_c('(st.mean_v + 1.0::DOUBLE * std_v)')} threshold,
 {_c('st.max_v')} "max", {_c('left_mean')} left_mean, {_c('right_mean')} right_mean,
 abs(left_mean - right_mean) / 255.0::DOUBLE * 20.0::DOUBLE delta,
 CASE WHEN left_mean IS NULL OR right_mean IS NULL THEN 'no_data'
  WHEN abs(left_mean - right_mean) >= 15 THEN 'asymmetric' ELSE 'symmetric' END symmetry,
 {', '.join(_c(f'{s}_{z}') + f' {s}_{z}' for s in ('left', 'right') for z in rg.ZONES)},
 {', '.join(f'abs(left_{z} - right_{z}) / 255.0::DOUBLE * 20.0::DOUBLE delta_{z}'
            for z in rg.ZONES)},
 hotspots, largest_area, finding
FROM stats st LEFT JOIN sides USING (frame_id) LEFT JOIN wide USING (frame_id)
LEFT JOIN summary USING (frame_id)"""))
def report_rows(spark, d):
    found = detected(spark, d, "lineitem", RASTER_NO_MARGIN)
    px = found.flagged()
    return tri.report_rows(thr.surface_statistics(px, RASTER.sigma_k), rg.raw_delta(px),
                           rg.zones(px), _summary(found))


# --- evaluation -----------------------------------------------------------------------------------

TRUTH_LEVEL = 190


def _truth(px):
    return px.where(F.col("v") >= TRUTH_LEVEL).select("frame_id", "y", "x")


def rates_sql(hot: str, extra: str = "") -> str:
    return f"""counts_{hot} AS (
 SELECT s.frame_id, count(*) FILTER (WHERE h.y IS NOT NULL AND s.mask AND s.v >= {TRUTH_LEVEL}) tp,
  count(*) FILTER (WHERE h.y IS NOT NULL AND s.mask AND s.v < {TRUTH_LEVEL}) fp,
  count(*) FILTER (WHERE h.y IS NULL AND s.mask AND s.v >= {TRUTH_LEVEL}) fn, count(*) n
 FROM staged s LEFT JOIN {hot} h ON h.frame_id = s.frame_id AND h.y = s.y AND h.x = s.x
 GROUP BY 1),
rates_{hot} AS (
 SELECT frame_id, {extra} tp, fp, fn, n - tp - fp - fn tn,
  CASE WHEN tp + fn > 0 THEN round_even(tp::DOUBLE / (tp + fn), 4) ELSE 1.0 END sensitivity,
  CASE WHEN n - tp - fn > 0 THEN round_even((n - tp - fp - fn)::DOUBLE / (n - tp - fn), 4)
   ELSE 1.0 END specificity,
  CASE WHEN tp + fp > 0 THEN round_even(tp::DOUBLE / (tp + fp), 4) ELSE 1.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round_even(tp::DOUBLE / (tp + fn), 4) ELSE 1.0 END recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round_even((2 * tp)::DOUBLE / (2 * tp + fp + fn), 4)
   ELSE 1.0 END dice,
  CASE WHEN tp + fp + fn > 0 THEN round_even(tp::DOUBLE / (tp + fp + fn), 4) ELSE 1.0 END iou
 FROM counts_{hot})"""


@query("confusion_metrics", sql.query(
    [*sql.detection("lineitem", K, RASTER_NO_MARGIN), rates_sql("hot")],
    "SELECT * FROM rates_hot"))
def confusion_metrics(spark, d):
    found = detected(spark, d, "lineitem", RASTER_NO_MARGIN)
    return ev.confusion_metrics(found.hot, _truth(found.pixels), found.frame_stats,
                                found.pixels.where("mask")).drop("run_id")


def run_steps(k: float, mad: bool, tag: str, p: Params) -> list[str]:
    """Threshold to kept pixels of one run, on shared image stages."""
    return [sql.cut(k, mad, f"cut{tag}"), sql.raw(f"cut{tag}", f"raw{tag}"),
            sql.labels(4, f"raw{tag}", f"lab{tag}"), sql.regions(p, f"lab{tag}", f"reg{tag}"),
            sql.judged(p, f"reg{tag}", f"cut{tag}", f"judged{tag}"),
            sql.hot(f"lab{tag}", f"judged{tag}", f"hot{tag}")]


def runs_sql(raster: str, kernel: int, runs: dict[str, tuple[float, bool]]) -> str:
    shared = sql.detection(raster, kernel, RASTER_NO_MARGIN)[:8]
    steps, selects = [], []
    for i, (run, (k, mad)) in enumerate(runs.items()):
        steps += run_steps(k, mad, f"_{i}", RASTER_NO_MARGIN) + [
            rates_sql(f"hot_{i}", f"'{run}' run_id,")]
        selects.append(f"SELECT * FROM rates_hot_{i}")
    return sql.query(shared + steps, "\nUNION ALL ".join(selects))


SWEEP_K = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)


def _run_metrics(spark, d, raster, runs):
    params = [replace(RASTER_NO_MARGIN, run_id=run, sigma_k=k, use_mad=mad)
              for run, (k, mad) in runs.items()]
    found = detected(spark, d, raster, params)
    return ev.confusion_metrics(found.hot, _truth(found.pixels), found.frame_stats,
                                found.pixels.where("mask"))


METHODS = {"gauss": (1.0, False), "mad": (1.0, True)}


@query("method_comparison", runs_sql("lineitem", K, METHODS))
def method_comparison(spark, d):
    return _run_metrics(spark, d, "lineitem", METHODS)


SWEEP = {f"k={k}": (k, False) for k in SWEEP_K}


def sweep_params(runs):
    return [replace(RASTER_NO_MARGIN, run_id=run, sigma_k=k, use_mad=mad) for run, (k, mad) in runs.items()]


@query("sigma_sweep", runs_sql("events", 3, SWEEP))
def sigma_sweep(spark, d):
    """All runs from one component tree per frame."""
    px = events_raster(spark, d)
    return sweep(px, sweep_params(SWEEP), F.col("v") >= TRUTH_LEVEL).metrics


def _sweep_regions(name, raster, k, runs, tile):
    shared = sql.detection(raster, k, RASTER_NO_MARGIN)[:8]
    steps = [s for i, (sigma, mad) in enumerate(runs.values())
             for s in run_steps(sigma, mad, f"_{i}", RASTER_NO_MARGIN)[:5]]

    @query(name, sql.query(shared + steps, "\nUNION ALL ".join(
        f"SELECT '{run}' run_id, {REGION}, reject_reason FROM judged_{i}" for i, run in enumerate(runs))))
    def run(spark, d):
        px = {"events": events_raster, "lineitem": lineitem_raster}[raster](spark, d)
        return sweep(px, sweep_params(runs), tile=tile, kernel=k).regions.select(
            "run_id", *_columns(REGION), "reject_reason")


_sweep_regions("sweep_regions", "events", 3, SWEEP, dst.TILE)
_sweep_regions("sweep_regions_across_tiles", "lineitem", K, {
    "low": (0.5, False), "k=1": (1.0, False), "mad": (1.0, True), "high": (2.5, False)}, 16)


STAGES = {"deep": replace(RASTER_NO_MARGIN, run_id="deep", dist_erosion_factor=0.4),
          "wide": replace(RASTER_NO_MARGIN, run_id="wide", tophat_factor=0.14),
          "level": replace(RASTER_NO_MARGIN, run_id="level", otsu_min=60, otsu_max=120)}
STAGE_KERNELS = {"deep": K, "wide": 7, "level": K}


def stage_sql(run: str, k: int) -> str:
    """One whole detection as a subquery of its own."""
    p = STAGES[run]
    steps = [*sql.detection("lineitem", k, p)[:14], rates_sql("hot", f"'{run}' run_id,")]
    return f"SELECT * FROM ({sql.query(steps, 'SELECT * FROM rates_hot')}) {run}"


@query("stage_sweep", "\nUNION ALL ".join(stage_sql(r, k) for r, k in STAGE_KERNELS.items()))
def stage_sweep(spark, d):
    """Runs that differ in body, kernel and levels, together."""
    found = detected(spark, d, "lineitem", list(STAGES.values()))
    return ev.confusion_metrics(found.hot, _truth(found.pixels), found.frame_stats,
                                found.pixels.where("mask"))


@query("flagged_runs", sql.query(
    [*sql.detection("lineitem", K, RASTER_NO_MARGIN)[:8],
     *[s for i, (k, mad) in enumerate(METHODS.values())
       for s in run_steps(k, mad, f"_{i}", RASTER_NO_MARGIN)]],
    "\nUNION ALL ".join(f"""SELECT s.frame_id, '{run}' run_id, count(*) px,
 count(*) FILTER (WHERE h.y IS NOT NULL) hot_px FROM staged s LEFT JOIN hot_{i} h
 ON h.frame_id = s.frame_id AND h.y = s.y AND h.x = s.x GROUP BY 1""" for i, run in enumerate(METHODS))))
def flagged_runs(spark, d):
    params = [replace(RASTER_NO_MARGIN, run_id=run, sigma_k=k, use_mad=mad)
              for run, (k, mad) in METHODS.items()]
    return detected(spark, d, "lineitem", params).flagged().groupBy("frame_id", "run_id").agg(
        F.count("*").alias("px"), F.count_if("hot").alias("hot_px"))


RATES = ("tp", "fp", "fn", "tn", "sensitivity", "specificity", "precision", "recall", "dice", "iou")


@query("method_comparison_wide", f"""
SELECT frame_id, {', '.join(f"max({c}) FILTER (WHERE run_id = '{m}') {m}_{c}"
                            for m in METHODS for c in RATES)}
FROM ({runs_sql("lineitem", K, METHODS)}) both_methods GROUP BY 1""")
def method_comparison_wide(spark, d):
    """One row per frame with both methods side by side."""
    rows = _run_metrics(spark, d, "lineitem", METHODS)
    return rows.groupBy("frame_id").agg(*[
        F.max(F.when(F.col("run_id") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in RATES])


@query("compare_frames", sql.query([sql.PX["embeddings"], sql.BLUR, """
cut AS (SELECT frame_id, y, x, blur FROM blurred WHERE (y * 8 + x + length(frame_id)) % 11 <> 0)"""], """
SELECT px.frame_id, count(blur) shared_px, count(*) - count(blur) unshared_px,
 max(abs(px.v - blur)) largest_gap, count(*) FILTER (WHERE abs(px.v - blur) > 40) over_tolerance,
 count(*) = count(blur) AND count(*) FILTER (WHERE abs(px.v - blur) > 40) = 0 equal
FROM px LEFT JOIN cut USING (frame_id, y, x) GROUP BY 1"""))
def compare_frames(spark, d):
    """Grey values against smoothed ones (packed path), some of which are missing."""
    frames = embedding_frames(spark, d)
    smooth = explode_frames(packed.with_blur_and_top_hat(frames).select(
        "frame_id", "height", "width", F.col("blur").alias("px")))
    holes = (F.col("y") * 8 + F.col("x") + F.length("frame_id")) % 11 == 0
    return ev.compare_frames(explode_frames(frames), smooth.where(~holes), 40)


@query("compare_paths", sql.query([sql.PX["embeddings"], sql.BLUR], """
SELECT frame_id, y, x, blur AS window_blur, blur AS packed_blur FROM blurred"""))
def compare_paths(spark, d):
    """Smoothing by windows and on packed frames, side by side."""
    frames = embedding_frames(spark, d)
    windows = nb.box_blur(explode_frames(frames)).select(*PIXEL.split(", "), F.col("blur").alias("window_blur"))
    array = packed.with_blur_and_top_hat(frames).select(
        "frame_id", "height", "width", F.col("blur").alias("px"))
    return windows.join(explode_frames(array).select(*PIXEL.split(", "), F.col("v").alias("packed_blur")),
                        PIXEL.split(", "))


# --- whole detection ----------------------------------------------------------------------------------

STATS = """
SELECT l.frame_id, otsu, body_threshold, coalesce(body_px, 0) body_px, max_dist3,
 t diff_threshold, baseline, coalesce(raw_px, 0) raw_px, coalesce(hotspot_px, 0)::BIGINT hotspot_px,
 CASE WHEN body_px IS NULL THEN 'empty_body_mask' ELSE 'ok' END status
FROM level l JOIN deep USING (frame_id) LEFT JOIN cut USING (frame_id)
LEFT JOIN (SELECT frame_id, sum(area)::BIGINT raw_px,
 sum(area) FILTER (WHERE reject_reason IS NULL) hotspot_px FROM judged GROUP BY 1)
 USING (frame_id)"""
STAT_COLUMNS = ("frame_id", "otsu", "body_threshold", "body_px", "max_dist3", "diff_threshold",
                "baseline", "raw_px", "hotspot_px", "status")


def _detection(name, raster, k, params, packed_path=False, mad=False):
    @query(name, sql.query(sql.detection(raster, k, params, mad)[:13], STATS))
    def run(spark, d):
        if not packed_path:
            found = detected(spark, d, raster, params)
        else:
            frames = {"embeddings": embedding_frames, "enlarged": enlarged_frames}.get(
                raster, lambda *a: assemble_frames(events_raster(*a)))(spark, d)
            found = detect_frames(frames, params)
        return found.frame_stats.select(*STAT_COLUMNS)


_detection("detect_hotspots", "lineitem", K, RASTER_NO_MARGIN)
_detection("detect_hotspots_events", "events", 3, RASTER)
_detection("detect_hotspots_mad", "lineitem", K, replace(RASTER_NO_MARGIN, use_mad=True), mad=True)
_detection("detect_frames", "events", 3, RASTER_NO_MARGIN, packed_path=True)
_detection("detect_frames_embeddings", "embeddings", 3, RASTER_NO_MARGIN, packed_path=True)
_detection("detect_frames_enlarged", "enlarged", 3, RASTER_NO_MARGIN, packed_path=True)


@query("hotspot_mask", sql.query(sql.detection("lineitem", K, RASTER_NO_MARGIN)[:14],
                                 f"SELECT {PIXEL}, comp_id FROM hot"))
def hotspot_mask(spark, d):
    return detected(spark, d, "lineitem", RASTER_NO_MARGIN).hot.select(
        "frame_id", "y", "x", "comp_id")


@query("difference_image", sql.query(sql.detection("lineitem", K)[:8], f"""
SELECT {PIXEL}, CASE WHEN hi = lo THEN 0 ELSE floor((diff - lo) * 255.0::DOUBLE / (hi - lo))
 END::INT diff_norm
FROM staged JOIN (SELECT frame_id, min(diff) lo, max(diff) hi FROM staged GROUP BY 1)
 USING (frame_id)"""))
def difference_image(spark, d):
    return detected(spark, d, "lineitem").difference().select("frame_id", "y", "x", "diff_norm")


# --- runs over many frames --------------------------------------------------------------------

READ_FAILED = "frame_id::INT % 50 = 7"


def read_frames(spark, d):
    """Enlarged frames as if read from files, some of which could not be decoded."""
    failed = F.col("frame_id").cast("int") % 50 == 7
    return enlarged_frames(spark, d).select(
        "frame_id", F.when(failed, 0).otherwise(F.col("height")).alias("height"),
        F.when(failed, 0).otherwise(F.col("width")).alias("width"),
        F.when(failed, F.array().cast("array<smallint>")).otherwise(F.col("px")).alias("px"),
        F.when(failed, "decode_error").otherwise("ok").alias("status"))


@query("evaluate_frames", f"""
SELECT frame_id, CASE WHEN NOT bad THEN width END width, CASE WHEN NOT bad THEN height END height,
 CASE WHEN NOT bad THEN body_px END body_px, CASE WHEN NOT bad THEN hotspot_px END hotspot_px,
 CASE WHEN NOT bad THEN CASE WHEN body_px > 0
  THEN round_even(hotspot_px / body_px::DOUBLE * 100.0::DOUBLE, 2) ELSE 0.0::DOUBLE END END coverage_percent,
 CASE WHEN bad THEN 'decode_error' WHEN body_px > 0 THEN 'ok' ELSE 'empty_body_mask' END status
FROM (SELECT *, {READ_FAILED} bad FROM ({sql.query(sql.segmented("enlarged", RASTER_NO_MARGIN), """
 SELECT frame_id, count(*) FILTER (WHERE mask) body_px, max(height) height, max(width) width
 FROM body GROUP BY 1""")}) raw_body
JOIN ({sql.query(sql.detection("enlarged", 3, RASTER_NO_MARGIN)[:13], """
 SELECT l.frame_id, coalesce(n, 0)::BIGINT hotspot_px FROM level l LEFT JOIN (SELECT frame_id,
  sum(area) n FROM judged WHERE reject_reason IS NULL GROUP BY 1) USING (frame_id)""")}) spots
 USING (frame_id))""")
def evaluate_frames(spark, d):
    return batch.evaluate_frames(read_frames(spark, d), RASTER_NO_MARGIN)


def _batch_sql(population: str) -> str:
    steps = [s.replace("mask", population) for s in TRIAGE]
    return sql.query(sql.detection("enlarged", 3, RASTER_NO_MARGIN) + [
        "all_flagged AS (SELECT *, diff > 0 nonzero FROM flagged)",
        *[s.replace("flagged", "all_flagged") for s in steps]], f"""
SELECT frame_id, CASE WHEN NOT bad THEN printf('%d px', hotspot_px) END hotspots,
 CASE WHEN NOT bad THEN printf('%.1f °C', delta / 255.0::DOUBLE * 20.0::DOUBLE) END delta,
 CASE WHEN NOT bad THEN printf('%.1f °C', max_zone_delta / 255.0::DOUBLE * 20.0::DOUBLE) END zone_delta,
 CASE WHEN bad THEN 'decode_error' WHEN empty THEN 'empty_body_mask' ELSE status END status
FROM (SELECT *, {READ_FAILED} bad FROM triaged JOIN (SELECT frame_id, NOT bool_or(mask) empty
 FROM flagged GROUP BY 1) USING (frame_id))""")


@query("batch_frames", _batch_sql("mask"))
def batch_frames(spark, d):
    return batch.batch_frames(read_frames(spark, d), RASTER_NO_MARGIN)


@query("batch_frames_nonzero", _batch_sql("nonzero"))
def batch_frames_nonzero(spark, d):
    """Side and zone means over the pixels with a difference."""
    return batch.batch_frames(read_frames(spark, d), RASTER_NO_MARGIN, population="nonzero_diff")


@query("step_pixels", sql.query([*sql.detection("lineitem", K, RASTER_NO_MARGIN), """stretched AS (
 SELECT *, CASE WHEN hi = lo THEN 0 ELSE floor((diff - lo) * 255.0::DOUBLE / (hi - lo)) END::INT norm
 FROM flagged JOIN (SELECT frame_id, min(diff) lo, max(diff) hi FROM flagged GROUP BY 1) USING (frame_id))"""],
 " UNION ALL ".join(f"SELECT {PIXEL}, height, width, '{n}' step, {c}::INT v FROM stretched" for n, c in {
     "original": "v", "mask": "CASE WHEN mask THEN 255 ELSE 0 END",
     "hotspots": "CASE WHEN hot THEN 255 ELSE 0 END", "difference": "norm"}.items())))
def step_pixels(spark, d):
    """What the step images of a run hold."""
    return batch.step_pixels(detected(spark, d, "lineitem", RASTER_NO_MARGIN))


@query("benchmark_document", f"""
SELECT 'scenario_results' section, frame_id, NULL run_id, dice, iou, NULL::DOUBLE gauss_dice,
 NULL::DOUBLE mad_dice, NULL::DOUBLE coverage_percent, NULL status FROM ({ORACLES["confusion_metrics"]}) a
UNION ALL SELECT 'method_comparison', frame_id, NULL, NULL, NULL, gauss_dice, mad_dice, NULL, NULL
 FROM ({ORACLES["method_comparison_wide"]}) b
UNION ALL SELECT 'sensitivity_k', frame_id, run_id, dice, iou, NULL, NULL, NULL, NULL
 FROM ({ORACLES["sigma_sweep"]}) c
UNION ALL SELECT 'dataset', frame_id, NULL, NULL, NULL, NULL, NULL, coverage_percent, status
 FROM ({ORACLES["evaluate_frames"]}) d""")
def benchmark(spark, d):
    """The four sections of the benchmark document, some fields of each."""
    px = lineitem_raster(spark, d)
    rows = checkpoint(sweep(px, sweep_params(METHODS), F.col("v") >= TRUTH_LEVEL).metrics)
    wide = rows.groupBy("frame_id").agg(*[
        F.max(F.when(F.col("run_id") == m, F.col(c))).alias(f"{m}_{c}") for m in METHODS for c in RATES])
    document = benchmark_document(rows.where("run_id = 'gauss'").drop("run_id"), wide, sigma_sweep(spark, d),
                                  evaluate_frames(spark, d))

    def either(field):
        return F.coalesce(f"scenario_results.{field}", f"sensitivity_k.{field}").alias(field)
    return document.select(
        "section", "frame_id", F.col("sensitivity_k.run_id").alias("run_id"), either("dice"), either("iou"),
        "method_comparison.gauss_dice", "method_comparison.mad_dice", "dataset.coverage_percent", "dataset.status")
