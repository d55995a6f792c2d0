"""Folders of image files as packed frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import FRAMES

# File extensions of evaluation and batch runs, grey weights (blue, green, red).
EVALUATION = ("jpeg", "jpg", "png")
BATCH = ("jpeg", "jpg", "png", "bmp", "tiff", "tif")
GREY_BGR = (0.114, 0.587, 0.299)


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" for c in extension)


def _to_grey(batches):
    for batch in batches:
        packed = []
        for data, channels in zip(batch["data"], batch["nChannels"]):
            flat = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
            if channels > 1:
                flat = np.rint(flat.reshape(-1, channels)[:, :3] @ np.array(GREY_BGR))
            packed.append(flat.astype(np.int16))
        yield batch[["frame_id", "height", "width"]].assign(px=packed, status=batch["status"])


def read_images(spark: SparkSession, path: str, extensions=BATCH) -> DataFrame:
    """8-bit grey frames, named by the full address of their file. Files that cannot be decoded
    stay as rows with a status."""
    names = "*.{" + ",".join(_any_case(e) for e in extensions) + "}"
    files = (spark.read.format("image").option("dropInvalid", False)
             .option("pathGlobFilter", names).load(path).select("image.*"))
    bad = (F.col("height") <= 0) | F.col("height").isNull()
    tagged = files.select(
        F.col("origin").alias("frame_id"), "height", "width",
        "nChannels", "data", F.when(bad, "decode_error").otherwise("ok").alias("status"))
    return tagged.mapInPandas(_to_grey, FRAMES)
