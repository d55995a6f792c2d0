"""Run parameters: defaults, stored overrides, and their form as columns."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Params:
    # The published defaults of the measurement.
    run_id: str = "default"
    sigma_k: float = 3.0
    tophat_factor: float = 0.05
    min_area_factor: float = 0.0005
    min_circularity: float = 0.08
    otsu_min: int = 35
    otsu_max: int = 50
    dist_erosion_factor: float = 0.05
    use_mad: bool = False
    temp_min_c: float = 20.0
    temp_max_c: float = 40.0
    asymmetry_threshold_c: float = 2.2
    lower_cutoff_y: float = 0.65
    min_dist_factor: float = 0.015
    min_dist_abs: float = 12.0
    border_margin: int = 10
    min_area_abs: int = 10

    def __post_init__(self):
        if self.dist_erosion_factor <= 0:
            raise ValueError("dist_erosion_factor must be positive")

    @property
    def stage_key(self):
        """Runs that agree on these share everything up to the top-hat."""
        return (self.tophat_factor, self.otsu_min, self.otsu_max, self.dist_erosion_factor)


def as_list(params) -> list[Params]:
    return [params] if isinstance(params, Params) else list(params)


def with_runs(per_frame: DataFrame, params) -> DataFrame:
    """One copy of each per-frame row for each run, with the run's parameters.

    The runs are literals exploded in place, so no join is involved.
    """
    runs = F.array(*[
        F.struct(*[F.lit(value).alias(name) for name, value in asdict(p).items()])
        for p in as_list(params)])
    return (per_frame.withColumn("_run", F.explode(runs))
            .select("*", *[F.col("_run")[f.name].alias(f.name) for f in fields(Params)])
            .drop("_run"))


def with_run_of(per_frame: DataFrame, params, number: str = "run") -> DataFrame:
    """Adds the parameters of the run whose place in ``params`` stands in a column."""
    runs = F.array(*[
        F.struct(*[F.lit(value).alias(name) for name, value in asdict(p).items()])
        for p in as_list(params)])
    return per_frame.select("*", *[runs[F.col(number)][f.name].alias(f.name) for f in fields(Params)])


def settings_over_defaults(settings: DataFrame, defaults: Params = Params()) -> DataFrame:
    """Fill keys a stored settings row lacks (or holds as NULL) from the defaults."""
    keep = [F.col(c) for c in settings.columns if c not in asdict(defaults)]
    filled = []
    for name, value in asdict(defaults).items():
        default = F.lit(value)
        if name in settings.columns:
            kind = {bool: "boolean", int: "int", float: "double", str: "string"}[type(value)]
            default = F.coalesce(F.col(name).try_cast(kind), default)
        filled.append(default.alias(name))
    return settings.select(*keep, *filled)


def read_settings(spark, path: str, defaults: Params = Params()) -> DataFrame:
    """Stored JSON settings over the defaults; a missing file and unreadable records give the
    defaults."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in asdict(defaults).items())
    try:
        stored = spark.read.schema(schema).option("mode", "PERMISSIVE") \
            .option("multiLine", True).json(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return settings_over_defaults(spark.range(1).select(), defaults)
    return settings_over_defaults(stored, defaults)
