"""Result writers. Files are written by the executors, one per partition."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..schemas import AUDIT
from ..staging import checkpoint


def audit_rows(frame_stats: DataFrame, operator: str, mode: str, ts=None) -> DataFrame:
    """One audit row per frame; expects the audit columns that are not constant."""
    when = F.current_timestamp() if ts is None else ts
    full = (frame_stats.withColumn("ts", when)
            .withColumn("operator", F.lit(operator)).withColumn("analysis_mode", F.lit(mode)))
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT.fields])


def append_audit(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = rows.write.mode("append")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def append_once(rows: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Appends the rows whose keys the folder does not hold yet, one row for each key.

    A batch that is run again adds nothing, whether it ended or broke off: files of a job count only
    once all of it is committed. Keys may be null.
    """
    rows = rows.dropDuplicates(keys)
    try:
        there = rows.sparkSession.read.schema(rows.schema).format(fmt).option("header", True).load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        there = there.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        # Held apart from the folder that is written to.
        rows = checkpoint(rows.join(there, same, "left_anti"))
    append_audit(rows, path, fmt)


def audit_export_rows(audit: DataFrame) -> DataFrame:
    """The six exported columns; missing numbers are 0, missing text is empty."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    def number(c, kind):
        return F.coalesce(F.col(c), F.lit(0)).cast(kind)
    return audit.select(
        text("ts").alias("Timestamp"), text("patient_id").alias("PatientID"),
        text("backend").alias("Backend"),
        number("hotspot_px", "long").alias("HotspotsDetected"),
        number("mean_temp_c", "double").alias("MeanTempC"),
        number("max_temp_c", "double").alias("MaxTempC"))


def export_audit(audit: DataFrame, path: str) -> None:
    audit_export_rows(audit).write.mode("overwrite").option("header", True).csv(path)


def write_steps(steps: dict[str, DataFrame], path: str) -> None:
    """Packed frames of each processing step, partitioned by step."""
    tagged = None
    for name, frames in steps.items():
        part = frames.withColumn("step", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged.write.mode("overwrite").partitionBy("step").parquet(path)


def benchmark_document(metrics: DataFrame, comparison: DataFrame, sweep: DataFrame,
                       dataset: DataFrame) -> DataFrame:
    """Result sections as rows with nested results: scenario results, method comparison,
    sensitivity to k, dataset evaluation. Each section has its own struct column."""
    parts = []
    for name, df in {"scenario_results": metrics, "method_comparison": comparison,
                     "sensitivity_k": sweep, "dataset": dataset}.items():
        parts.append(df.select(F.lit(name).alias("section"), F.col("frame_id"),
                               F.struct(*[c for c in df.columns if c != "frame_id"]).alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_benchmark(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").partitionBy("section").json(path)
