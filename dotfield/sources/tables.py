"""Reading, checking and writing localization tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import header_text

REQUIRED = ("x (nm)", "y (nm)", "channelIndex", "frameIndex")
#: Raw header to internal name.
RENAMES = {
    "x (nm)": "x", "y (nm)": "y", "frameIndex": "frame", "channelIndex": "channel", "intensity (photons)": "photons", "sigmaX (nm)": "sx", "sigmaY (nm)": "sy",
    "background (photons/nm^2)": "bg", "p-value": "pvalue", "pvalue": "pvalue", "localization precision (nm)": "lp",
}
#: Fixed headers of axial coordinates, in lower case.
AXIAL = ("z", "z (nm)", "z(nm)", "z [nm]", "z[nm]", "position_z", "position z [nm]")


@dataclass
class Loaded:
    """A table, or the reason why there is none."""

    table: DataFrame | None
    reason: str | None = None
    warning: str | None = None


def type_of(header: str) -> T.DataType:
    low = header.lower()
    if low in ("frameindex", "frame", "channelindex", "channel"):
        return T.IntegerType()
    text = low in ("channelname", "experiment", "file_name", "label")
    return T.StringType() if text else T.DoubleType()


def headers(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True).columns


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Types follow the headers; a cell that does not parse is null. Nothing is inferred from the rows."""
    names = headers(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType() if isinstance(type_of(n), T.IntegerType) else type_of(n)) for n in names])
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    whole = [n for n in names if isinstance(type_of(n), T.IntegerType)]
    return df.withColumns({n: F.col(f"`{n}`").try_cast("double").cast("int") for n in whole}) if whole else df


def axial_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.strip().lower() in AXIAL]


def flat(df: DataFrame) -> Loaded:
    """Without axial columns and channelName; a value other than 0 in an axial column is a reason to refuse."""
    axial = axial_columns(df.columns)
    if axial:
        deep = F.lit(False)
        for c in axial:
            v = F.col(f"`{c}`").cast("string").try_cast("double")
            deep = deep | F.coalesce((v != 0) & ~F.isnan(v), F.lit(False))
        if df.agg(F.bool_or(deep)).first()[0]:
            return Loaded(None, "non-zero numeric values in axial columns: " + ", ".join(axial))
    return Loaded(df.drop(*axial, "channelName"), None, "dropped: " + ", ".join(axial) if axial else None)


def load(spark: SparkSession, path: str, required=REQUIRED) -> Loaded:
    """A checked table; a missing file, missing columns and axial data give a reason, not an error."""
    try:
        df = read_csv(spark, path)
    except Exception as e:  # noqa: BLE001  Spark's own reading errors
        return Loaded(None, f"cannot be read: {str(e).splitlines()[0][:200]}")
    missing = [c for c in required if c not in df.columns]
    return Loaded(None, "Missing required columns: " + ", ".join(missing)) if missing else flat(df)


def internal(df: DataFrame) -> DataFrame:
    """Internal names; other columns stay."""
    return df.select(*[F.col(f"`{c}`").alias(RENAMES.get(c, c)) for c in df.columns])


def raw(df: DataFrame) -> DataFrame:
    back = {v: k for k, v in reversed(RENAMES.items())}
    known = [c for c in back if c in df.columns]
    return df.select(*[F.col(c).alias(back[c]) for c in known], *[F.col(f"`{c}`") for c in df.columns if c not in known])


def scaled(df: DataFrame, factor: float, columns=("x", "y", "sx", "sy")) -> DataFrame:
    """Lengths times factor: pixels to nanometres or back."""
    return df.withColumns({c: F.col(c) * F.lit(float(factor)) for c in columns if c in df.columns})


def picked(df: DataFrame, *aliases: str, default=None):
    """The first present of several columns, as a number; the default where it is missing or does not parse."""
    for a in aliases:
        if a in df.columns:
            return F.coalesce(F.col(f"`{a}`").cast("string").try_cast("double"), F.lit(default).cast("double"))
    return F.lit(default).cast("double")


def metadata(df: DataFrame, required: list[str]) -> Loaded:
    """A sheet of experiments with trimmed lower-case headers; required ones are looked for in the same way."""
    out = df.toDF(*[header_text(c) for c in df.columns])
    missing = [c for c in map(header_text, required) if c not in out.columns]
    return Loaded(None, "Missing required columns: " + ", ".join(missing)) if missing else Loaded(out)


def save(df: DataFrame, path: str, by: list[str] = (), kind: str = "parquet", mode: str = "append") -> None:
    """Stage tables as <path>/<keys>; an append may bring other columns, which Parquet's schema merge joins."""
    w = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def saved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, for reports."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
