"""Result files of many experiments, <folder>/test_data/<file>.csv, read by kind, merged with their lineage, and joined.

Files are told apart by their names, and those of one header are read together, so there is one scan for each header and none for each
file; the driver sees names and headers, no rows. A merged kind is one table with its keys as columns, which saved() writes as folders by
key: running it again replaces the folders of the keys at hand and no others.
"""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import cell_line, channel_name, columns_alike, inter_channels, prefixed_channel, probe

KINDS = ("cluster_stats", "intra", "inter", "mean_distance", "mean_distance_inter", "cluster_intra", "cluster_inter", "cluster_mean_distance_inter")
LINEAGE = ("source_folder", "source_file", "cell_line", "source_channel_name", "target_channel_name")
KEYS = ("cell_line", "channel", "target")


def kind_of(name: Column) -> tuple[Column, Column, Column]:
    """Kind, channel and target of a file name; null where it is of no kind. Only kinds between channels have a target."""
    plain = F.regexp_replace(name, "^cluster_(?=(intra|inter|mean_distance_radius)_)", "")
    of_cluster = plain != name
    far = lambda pattern, k: F.nullif(F.regexp_extract(plain, rf"^mean_distance_radius_\d+\.\d+_{pattern}\.csv$", k), F.lit(""))
    source, target = inter_channels(plain)
    far_source, far_target = far("(.+)_to_(.+)", 1), far("(.+)_to_(.+)", 2)
    alone = F.when(~plain.contains("_to_") & ~of_cluster, far("(.+)", 1))
    stats, intra = prefixed_channel(plain, "cluster_stats_"), prefixed_channel(plain, "intra_")
    kind = F.when(F.length(stats) > 0, "cluster_stats").when(F.length(intra) > 0, "intra").when(source.isNotNull(), "inter").when(far_source.isNotNull(), "mean_distance_inter").when(alone.isNotNull(), "mean_distance")
    channel = F.coalesce(F.when(F.length(stats) > 0, stats), F.when(F.length(intra) > 0, intra), source, far_source, alone)
    return F.when(of_cluster, F.concat(F.lit("cluster_"), kind)).otherwise(kind), channel, F.coalesce(target, far_target)


def described(paths: DataFrame) -> DataFrame:
    """path with source_folder, source_file, cell_line, kind, source_channel_name and target_channel_name, and the keys channel and target without
    numbers at the end."""
    part = lambda k: F.try_element_at(F.split(F.regexp_replace("path", "%20", " "), "/"), F.lit(k))
    out = paths.withColumns({"source_folder": part(-3), "source_file": part(-1)}).withColumn("cell_line", cell_line(F.col("source_folder")))
    kind, channel, target = kind_of(F.col("source_file"))
    out = out.withColumns({"kind": kind, "source_channel_name": channel, "target_channel_name": target})
    return out.withColumns({"channel": channel_name(F.col("source_channel_name")), "target": channel_name(F.col("target_channel_name"))})


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The result files below root that are of a kind; one row per file, contents are not read."""
    paths = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/test_data/*.csv").select("path")
    return described(paths).filter("kind is not null")


def column_alike(name: str) -> str:
    """A column that names a probe (ast, pst or rst and digits) after distance_to_, inter_ or _to_, without the number that follows it."""
    if re.search("distance_to_|inter_|_to_", name.lower()):
        return re.sub(r"((?:ast|pst|rst)\d+)-\d+", r"\1", name)
    return name


def _alike(df: DataFrame, lineage: list[str]) -> DataFrame:
    """Columns whose names become one: the first value present."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c if c in lineage else column_alike(c), []).append(c)
    df = df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in same]).alias(name) for name, same in groups.items()])
    named = [c for c in df.columns if c not in lineage and re.search("distance_to_|inter_|_to_", c.lower())]
    same = {cs[0]: cs for cs in columns_alike(named).values()}
    gone = {c for cs in same.values() for c in cs[1:]}
    return df.select(*[F.coalesce(*[F.col(f"`{x}`") for x in same.get(c, [c])]).alias(c) for c in df.columns if c not in gone])


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns of which all values are numbers, as numbers."""
    if not names:
        return df
    odd = [F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"c{k}") for k, c in enumerate(names)]
    row = df.agg(*odd).first()
    numeric = {c for k, c in enumerate(names) if row[k] == 0}
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns])


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows of CSV files of unlike headers, columns a file lacks null, with path, __block and __row, which give the order in a file."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("block"))
    heads = lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    by_header = heads.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()  # names of files
    parts = []
    for header, some in by_header:
        names = next(csv.reader([header]))
        schema = ", ".join(f"`{c.strip()}` string" for c in names)
        df = spark.read.csv(some, header=True, schema=schema, enforceSchema=True)
        parts.append(df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged_kind(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """All files of a kind as one table: their columns, LINEAGE, KEYS and place, or None where there is no file.

    place counts the rows from 1 of a folder and its keys, in the order of file names and of rows. cluster_stats come without noise (cluster -1);
    their channel_name is that of the file, as it is wherever files have none. Between channels, columns that differ by a probe's number become one.
    """
    files = listed(spark, root).filter(F.col("kind") == kind).drop("kind")
    paths = [r.path for r in files.select("path").orderBy("path").collect()]  # names of files
    if not paths:
        return None
    rows = read_files(spark, paths)
    own = [c for c in rows.columns if c not in ("path", "__block", "__row")]
    rows = _numbers(rows, own)
    if kind == "cluster_stats" and "cluster" in own:
        rows = rows.filter(F.coalesce(F.col("cluster").cast("string").try_cast("double") != -1, F.lit(True)))
    clash = [c for c in own if c in (*LINEAGE, *KEYS, "place")]
    rows = rows.drop(*clash).join(F.broadcast(files), "path")  # a row per file
    given = F.col("source_channel_name")
    if not kind.endswith("inter"):
        keep = "channel_name" in own and kind.endswith("intra")
        rows = rows.withColumn("channel_name", F.coalesce(F.col("channel_name").cast("string"), given) if keep else given).drop("source_channel_name", "target_channel_name")
    lineage = [c for c in (*LINEAGE, *KEYS, "channel_name", "path", "__block", "__row") if c in rows.columns]
    if kind.endswith("inter"):
        rows = _alike(rows, lineage)
    # A file's blocks are numbered apart and their counts added in order.
    group = ["source_folder", "channel", "target"]
    here = F.row_number().over(W.partitionBy(*group, "source_file", "__block").orderBy("__row"))
    counts = rows.groupBy(*group, "source_file", "__block").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(W.partitionBy(*group).orderBy("source_file", "__block")) - F.col("n")).drop("n")
    counts = counts.select(*[F.col(c).alias(f"__k{c}") for c in (*group, "source_file", "__block")], "before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{c}")) for c in (*group, "source_file", "__block")])
    rows = rows.withColumn("__here", here).join(counts, same)
    return rows.withColumn("place", (F.col("before") + F.col("__here")).cast("long")).drop("before", "__here", "path", "__block", "__row", *[f"__k{c}" for c in (*group, "source_file", "__block")])


def merged(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every kind that has files."""
    tables = {k: merged_kind(spark, root, k) for k in KINDS}
    return {k: t for k, t in tables.items() if t is not None}


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, cell_line, channel, target, files, rows of merged tables."""
    parts = [t.groupBy(F.lit(k).alias("kind"), *KEYS).agg(F.count_distinct("source_folder", "source_file").alias("files"), F.count(F.lit(1)).alias("rows")) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def distribution(files: DataFrame) -> DataFrame:
    """kind, cell_line, channel, target, folders, files: how the listed files are spread."""
    return files.groupBy("kind", *KEYS).agg(F.count_distinct("source_folder").alias("folders"), F.count(F.lit(1)).alias("files"))


def _distance(columns: list[str], *words: str) -> str | None:
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def complete(tables: dict[str, DataFrame]) -> DataFrame:
    """cluster_stats with intra_distance_nm and inter_distance_to_<target>_nm for every target: the values at the same place of the same folder and
    channel in cluster_intra and cluster_inter, null where these have fewer rows. Channels and targets are compared by their probes; in
    cluster_inter the channel is the source. The columns of targets are taken from the names of files."""
    stats = tables["cluster_stats"]
    stats = stats.toDF(*[c.strip().lower() for c in stats.columns]).withColumn("__probe", F.coalesce(probe(F.col("channel")), F.col("channel")))
    key = ["source_folder", "__probe", "place"]

    def column(table: DataFrame | None, *words: str) -> DataFrame | None:
        own = [c for c in table.columns if c not in (*LINEAGE, *KEYS, "place", "channel_name")] if table is not None else []
        name = _distance(own, *words)
        if name is None:
            return None
        return table.select("source_folder", F.coalesce(probe(F.col("channel")), F.col("channel")).alias("__probe"), "place", F.lower(F.coalesce(probe(F.col("target")), F.col("target"))).alias("__target"), F.col(f"`{name}`").alias("__d"))

    intra, inter = column(tables.get("cluster_intra"), "distance", "nn"), column(tables.get("cluster_inter"), "distance")
    out = stats
    if intra is not None:
        out = out.join(intra.select(*key, F.col("__d").alias("intra_distance_nm")), key, "left")
    else:
        out = out.withColumn("intra_distance_nm", F.lit(None).cast("double"))
    if inter is not None:
        targets = [r[0] for r in inter.select("__target").distinct().orderBy("__target").collect()]  # probes, from names of files
        wide = inter.groupBy(*key).pivot("__target", targets).agg(F.first("__d"))
        out = out.join(wide.withColumnsRenamed({t: f"inter_distance_to_{t}_nm" for t in targets}), key, "left")
    return out.drop("__probe")


def saved(df: DataFrame, path: str, keys: list[str]) -> None:
    """df as Parquet in folders by keys; folders of keys that df has are replaced, others stay. So doing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
