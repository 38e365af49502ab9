"""Merging of result files: a folder of files of all kinds, and what each becomes."""

import pytest
from pyspark.sql import functions as F

from dotfield.sources import results

FOLDERS = ("AHA_1_U2OS-WT_AST0063_RST0126_pos1", "AHA_2_U2OS-WT_AST0063-2_RST0126_pos2", "AHA_3_HELA_AST0063_RST0126_pos1", "short")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("results")

    def put(folder, name, *lines):
        at = top / folder / "test_data"
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_text("\n".join(lines) + "\n")

    a, b, c, d = FOLDERS
    put(a, "cluster_stats_AST0063.csv", "cluster,n_points,channel_name", "-1,9,AST0063", "0,20,AST0063", "1,30,AST0063")
    put(b, "cluster_stats_AST0063-2.csv", "cluster,n_points,area_nm2,channel_name", "0,7,1.5,other", "-1,1,,other", "1,8,2.5,other", "2,9,,other")
    put(c, "cluster_stats_AST0063.csv", "cluster,n_points", "0,4")
    put(c, "cluster_stats_RST0126.csv", "cluster,n_points", "0,5")
    put(a, "cluster_intra_AST0063.csv", "nn_distance_nm", "1.5", "2.5")
    put(b, "cluster_intra_AST0063-2.csv", "nn_distance_nm", "3.5")
    put(a, "cluster_inter_AST0063_to_RST0126.csv", "distance_to_rst0126_nm", "10", "20")
    put(b, "cluster_inter_AST0063-2_to_RST0126-1.csv", "distance_to_rst0126-1_nm", "30", "40", "50")
    put(a, "intra_AST0063.csv", "nn_distance_nm,channel_name", "1,kept", "2,kept")
    put(d, "intra_RST0126-3.csv", "nn_distance_nm", "7")
    put(a, "inter_AST0063_to_RST0126.csv", "distance_to_rst0126_nm", "11")
    put(b, "inter_AST0063-2_to_RST0126-1.csv", "x,distance_to_rst0126-1_nm", "0.5,12")
    put(a, "mean_distance_radius_100.0_AST0063.csv", "mean_distance_nm", "5", "6")
    put(a, "mean_distance_radius_100.0_AST0063_to_RST0126.csv", "mean_distance_nm", "8")
    put(a, "cluster_mean_distance_radius_50.5_AST0063_to_RST0126.csv", "mean_distance_nm", "9")
    put(a, "cluster_mean_distance_radius_50.5_AST0063.csv", "mean_distance_nm", "1")
    put(a, "notes.csv", "x", "1")
    return str(top)


@pytest.fixture(scope="module")
def tables(spark, root):
    return {k: t.cache() for k, t in results.merged(spark, root).items()}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_kinds(spark, root):
    files = results.listed(spark, root)
    got = {(r.kind, r.source_channel_name, r.target_channel_name) for r in files.collect()}
    assert ("mean_distance", "AST0063", None) in got and ("mean_distance_inter", "AST0063", "RST0126") in got and ("cluster_mean_distance_inter", "AST0063", "RST0126") in got
    assert {k for k, *_ in got} == set(results.KINDS) and files.count() == 15
    spread = {(r.kind, r.cell_line, r.channel): (r.folders, r.files) for r in results.distribution(files).collect()}
    assert spread["cluster_stats", "U2OS-WT", "AST0063"] == (2, 2) and spread["intra", "Unknown", "RST0126"] == (1, 1)


def test_cluster_stats(tables):
    """Without noise, with the file's channel, unlike columns null, numbers as numbers."""
    t = tables["cluster_stats"]
    got = rows(t.filter("cell_line = 'U2OS-WT'"), "source_folder", "place", "cluster", "n_points", "area_nm2", "channel_name", "channel")
    a, b, *_ = FOLDERS
    assert got == [(a, 1, 0, 20, None, "AST0063", "AST0063"), (a, 2, 1, 30, None, "AST0063", "AST0063"), (b, 1, 0, 7, 1.5, "AST0063-2", "AST0063"), (b, 2, 1, 8, 2.5, "AST0063-2", "AST0063"), (b, 3, 2, 9, None, "AST0063-2", "AST0063")]
    assert dict(t.dtypes)["n_points"] == "double" and dict(t.dtypes)["channel_name"] == "string"


def test_single_channel_kinds(tables):
    assert rows(tables["intra"], "cell_line", "nn_distance_nm", "channel_name", "channel") == [("U2OS-WT", 1, "kept", "AST0063"), ("U2OS-WT", 2, "kept", "AST0063"), ("Unknown", 7, "RST0126-3", "RST0126")]
    assert rows(tables["mean_distance"], "mean_distance_nm", "channel_name", "place") == [(5, "AST0063", 1), (6, "AST0063", 2)]
    assert rows(tables["cluster_intra"], "nn_distance_nm", "source_file") == [(1.5, "cluster_intra_AST0063.csv"), (2.5, "cluster_intra_AST0063.csv"), (3.5, "cluster_intra_AST0063-2.csv")]


def test_kinds_between_channels(tables):
    """A probe's number goes from columns and keys, and stays in the lineage."""
    t = tables["inter"]
    assert "distance_to_rst0126-1_nm" not in t.columns
    assert rows(t, "distance_to_rst0126_nm", "target_channel_name", "target", "source_channel_name", "channel") == [(11, "RST0126", "RST0126", "AST0063", "AST0063"), (12, "RST0126-1", "RST0126", "AST0063-2", "AST0063")]
    assert rows(tables["mean_distance_inter"], "mean_distance_nm", "target") == [(8, "RST0126")]
    assert rows(tables["cluster_mean_distance_inter"], "mean_distance_nm", "target") == [(9, "RST0126")]
    assert results.column_alike("distance_to_ast0063-2_nm") == "distance_to_ast0063_nm" and results.column_alike("plain-2") == "plain-2"


def test_complete(tables):
    got = rows(results.complete(tables).filter("channel = 'AST0063'"), "source_folder", "cluster", "intra_distance_nm", F.col("inter_distance_to_rst0126_nm"))
    a, b, c, _ = FOLDERS
    assert got == [(a, 0, 1.5, 10), (a, 1, 2.5, 20), (b, 0, 3.5, 30), (b, 1, None, 40), (b, 2, None, 50), (c, 0, None, None)]


def test_summary(tables):
    got = {(r.kind, r.cell_line, r.channel, r.target): (r.files, r.rows) for r in results.summary(tables).collect()}
    assert got["cluster_stats", "U2OS-WT", "AST0063", None] == (2, 5) and got["inter", "U2OS-WT", "AST0063", "RST0126"] == (2, 2)


def test_written_again(spark, tables, tmp_path):
    """Folders of the keys at hand are replaced, others stay."""
    path, keys = str(tmp_path / "out"), ["cell_line", "channel"]
    for _ in range(2):
        results.saved(tables["cluster_stats"], path, keys)
    results.saved(tables["cluster_stats"].filter("cell_line = 'HELA' and channel = 'AST0063'").withColumn("n_points", F.lit(99.0)), path, keys)
    assert rows(spark.read.parquet(path), "cell_line", "channel", "n_points")[:2] == [("HELA", "AST0063", 99), ("HELA", "RST0126", 5)]
    assert spark.read.parquet(path).count() == 7


def test_nothing(spark, tmp_path):
    (tmp_path / "a" / "test_data").mkdir(parents=True)
    (tmp_path / "a" / "test_data" / "other.csv").write_text("x\n1\n")
    assert results.merged(spark, str(tmp_path)) == {}
