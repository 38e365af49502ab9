"""Text rules for file, channel, probe and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_name(c: Column) -> Column:
    """Without a trailing -number."""
    return F.regexp_replace(c, r"-\d+$", "")


def cell_line(folder: Column) -> Column:
    """The third part between underscores, or Unknown."""
    return F.coalesce(F.try_element_at(F.split(folder, "_"), F.lit(3)), F.lit("Unknown"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def pair_stem(path: Column) -> Column:
    """The stem without _pip_clusters, _cpp_clusters or _clusters at its end: what the labellings of one table have in common."""
    return F.regexp_replace(stem(path), "(?:_pip|_cpp)?_clusters$", "")


def is_raw_input(path: Column) -> Column:
    """A CSV file that is neither a channel's part (_ch and digits) nor an output (_locs_)."""
    name = file_name(path)
    return name.endswith(".csv") & ~name.rlike(r"_ch\d+\.csv$") & ~name.contains("_locs_")


def experiment_of(path: Column) -> Column:
    """The name before _initial.csv, or else before _after_clustering.csv."""
    return F.nullif(F.regexp_extract(file_name(path), r"^(.*?)(?:_initial|_after_clustering)\.csv$", 1), F.lit(""))


def probe(c: Column) -> Column:
    """The first probe token in capitals: AST, PST or RST in any case, with its digits."""
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)([ARP]ST\d+)", 1)), F.lit(""))


def probe_pair(c: Column) -> tuple[Column, Column]:
    """The probes of a file name that ends with _<probe>_to_<probe>.csv, in capitals."""
    at = lambda k: F.nullif(F.upper(F.regexp_extract(c, r"(?i)_([rap]st\d+)_to_([rap]st\d+)\.csv", k)), F.lit(""))
    return at(1), at(2)


def prefixed_channel(c: Column, prefix: str) -> Column:
    """What stands between a prefix and .csv."""
    return F.when(c.startswith(prefix) & c.endswith(".csv"), c.substr(F.lit(len(prefix) + 1), F.length(c) - len(prefix) - 4))


def distance_channels(c: Column) -> tuple[Column, Column]:
    """Channel and target of mean_distance_radius_<r>_<channel>[_to_<target>].csv; the target is null where there is none."""
    name = F.nullif(F.regexp_extract(c, r"^mean_distance_radius_\d+\.\d+_(.+)\.csv$", 1), F.lit(""))
    pair = F.regexp_extract(name, r"^(.+)_to_(.+)$", 1), F.regexp_extract(name, r"^(.+)_to_(.+)$", 2)
    return F.when(pair[0] != "", pair[0]).otherwise(name), F.nullif(pair[1], F.lit(""))


def inter_channels(c: Column) -> tuple[Column, Column]:
    """Channel and target of inter_<channel>_to_<target>.csv, which may begin with cluster_."""
    at = lambda k: F.nullif(F.regexp_extract(c, r"^(?:cluster_)?inter_(.+)_to_(.+)\.csv$", k), F.lit(""))
    return at(1), at(2)


def stem_labels(c: Column) -> tuple[Column, Column]:
    """Labels of the two channels from a stem: of five parts the fourth and fifth, of three the last two, of two both, of
    one itself and Ch2."""
    parts = F.split(c, "_")
    n = F.size(parts)
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return (
        F.when(n >= 5, at(4)).when(n >= 3, at(-2)).otherwise(at(1)),
        F.when(n >= 5, at(5)).when(n >= 2, at(-1)).otherwise(F.lit("Ch2")),
    )


def header(c: Column) -> Column:
    """Trimmed, blanks as one, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), " +", " "))


def header_text(s: str) -> str:
    return re.sub(r"\s+", " ", s.strip()).lower()


def cell(c: Column) -> Column:
    """Blank text as null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def is_dual(index: Column, last: Column) -> Column:
    """Whether a second channel is described: an index that is not none, and a whole last frame."""
    known = lambda c: F.coalesce(F.lower(cell(c)) != "none", F.lit(False))
    number = cell(last).try_cast("double")
    return known(index) & known(last) & F.coalesce(number == F.floor(number), F.lit(False))


def label_or(c: Column, default: str) -> Column:
    return F.coalesce(cell(c), F.lit(default))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[<>:"/\\|?*\s]+', "_")


def interval(low: Column, high: Column, decimals: int = 2) -> Column:
    return F.format_string(f"[%.{decimals}f, %.{decimals}f]", low, high)


def columns_alike(columns: list[str]) -> dict[str, list[str]]:
    """Columns by their names without -1, -2 or -3 at the end of any part."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(re.sub(r"-[123](?=_|$)", "", c), []).append(c)
    return out
