"""Fixed schemas of the stored tables."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, ShortType, StringType,
    StructField, StructType, TimestampType,
)


def _schema(**columns):
    return StructType([StructField(name, kind) for name, kind in columns.items()])


STR, INT, LONG, DBL, BOOL = (
    StringType(), IntegerType(), LongType(), DoubleType(), BooleanType())

FRAMES = _schema(frame_id=STR, height=INT, width=INT, px=ArrayType(ShortType()), status=STR)
PIXELS = _schema(frame_id=STR, y=INT, x=INT, v=INT, height=INT, width=INT)
RAW_PIXELS = _schema(frame_id=STR, y=INT, x=INT, raw=INT, height=INT, width=INT)
TRUTH = _schema(frame_id=STR, y=INT, x=INT)
ROIS = _schema(roi_id=STR, frame_id=STR, x1=INT, y1=INT, x2=INT, y2=INT)
POINTS = _schema(point_id=STR, frame_id=STR, y=INT, x=INT)
PATIENTS = _schema(patient_id=STR, name=STR, dob=STR)
PALETTE = _schema(palette=STR, v=INT, b=INT, g=INT, r=INT)
AUDIT = _schema(
    ts=TimestampType(), patient_id=STR, analysis_mode=STR, image_file=STR,
    sigma_k=DBL, tophat_factor=DBL, t_min_c=DBL, t_max_c=DBL,
    hotspot_px=LONG, max_temp_c=DBL, symmetry_delta=DBL, operator=STR)
