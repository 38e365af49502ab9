"""The registered queries over the given tables, each with DuckDB SQL where SQL can express it.

Doubles are rounded to four decimals on both sides, and negative zero is made zero.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, precision
from ..operators import cells, cluster, coloc, drift, filters, hdbscan, histogram, merge, search, spatial, tracks
from ..streaming import counts
from . import experiment
from .config import Config
from .views import LE, LL, LV, events, lines, table, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r4(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 4) + F.lit(0.0)
    return out.alias(name) if name else out


LIMITS = filters.Limits((5, 45), 20_000, 8, 0.07)
PASS = "sx BETWEEN 5 AND 45 AND sy BETWEEN 5 AND 45 AND photons >= 20000 AND lp < 8 AND pvalue < 0.07::DOUBLE"


@query(f"WITH {LL} SELECT * FROM ll WHERE {PASS}")
def filter_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return filters.cascade(lines(spark, sf), LIMITS)


@query(f"""WITH {LL}, c AS (SELECT count(*) n0, count(*) FILTER (sx BETWEEN 5 AND 45 AND sy BETWEEN 5 AND 45) n1, count(*) FILTER (sx BETWEEN 5 AND 45 AND sy BETWEEN 5 AND 45 AND photons >= 20000) n2,
count(*) FILTER (sx BETWEEN 5 AND 45 AND sy BETWEEN 5 AND 45 AND photons >= 20000 AND lp < 8) n3, count(*) FILTER ({PASS}) n4 FROM ll)
SELECT 'sigma' AS step, 1 AS position, 'applied' AS status, n0 AS rows_before, n1 AS rows_after FROM c UNION ALL SELECT 'photons', 2, 'applied', n1, n2 FROM c
UNION ALL SELECT 'lp', 3, 'applied', n2, n3 FROM c UNION ALL SELECT 'pvalue', 4, 'applied', n3, n4 FROM c""")
def filter_report(spark: SparkSession, sf: str) -> DataFrame:
    return filters.cascade_report(lines(spark, sf), LIMITS)


@query(f"""WITH {LL}, w AS (SELECT channel, max(frame) // 3 AS last FROM ll GROUP BY channel), o AS (SELECT channel, last, coalesce(sum(last) OVER (ORDER BY channel ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) + 20 AS low FROM w)
SELECT l.channel, l.frame, count(*) AS n FROM ll l JOIN o USING (channel) WHERE l.frame BETWEEN o.low AND o.last * 2 - 1 GROUP BY ALL""")
def frame_window_split(spark: SparkSession, sf: str) -> DataFrame:
    df = lines(spark, sf)
    last = df.groupBy("channel").agg(F.floor(F.max("frame") / 3).alias("last"))
    win = last.select("channel", F.col("last"), F.row_number().over(W.orderBy("channel")).alias("position"))
    spans = filters.frame_windows(win, 20).join(last, "channel").select("channel", "low", (F.col("last") * 2 - 1).alias("high"))
    return filters.in_windows(df, spans).groupBy("channel", "frame").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LL}, b AS (SELECT channel, x, frame, CASE WHEN l_linenumber = 7 THEN NULL ELSE photons END AS photons, y - 5000 AS y, CASE WHEN l_linenumber = 2 THEN -sx ELSE sx END AS sx, sy, lp, pvalue FROM ll)
SELECT channel, CASE WHEN photons IS NULL THEN 'not_finite' WHEN x <= 0 OR y <= 0 THEN 'boundary' WHEN sx <= 0 OR sy <= 0 OR lp <= 0 THEN 'parameter' ELSE 'kept' END AS reason, count(*) AS n FROM b GROUP BY ALL""")
def sanity_reasons(spark: SparkSession, sf: str) -> DataFrame:
    df = lines(spark, sf).withColumns({"photons": F.when(F.col("l_linenumber") != 7, F.col("photons")), "y": F.col("y") - 5000, "sx": F.when(F.col("l_linenumber") == 2, -F.col("sx")).otherwise(F.col("sx"))})
    return filters.sanity(df).groupBy("channel", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_BINS = """e AS (SELECT channel, min(log10(v)) AS lo, max(log10(v)) AS hi FROM s WHERE v > 0 GROUP BY channel), p AS (SELECT s.channel, CAST(least(floor((log10(v) - lo) / ((hi - lo) / 69)), 68) AS INTEGER) AS bin, lo, hi FROM s JOIN e USING (channel) WHERE v > 0),
b AS (SELECT channel, bin, pow(10, lo + bin * ((hi - lo) / 69)) AS low, pow(10, lo + (bin + 1) * ((hi - lo) / 69)) AS high, count(*) AS n FROM p GROUP BY channel, bin, lo, hi)"""


@query(f"WITH {LE}, s AS (SELECT channel, x AS v FROM le), {_BINS} SELECT channel, bin, round(low, 4) AS low, round(high, 4) AS high, n FROM b")
def log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.log_bins(events(spark, sf), "x", ["channel"]).select("channel", "bin", r4("low", "low"), r4("high", "high"), "n")


@query(f"WITH {LE}, s AS (SELECT channel, x AS v FROM le), {_BINS} SELECT channel, round(low, 4) AS low, round(high, 4) AS high, n FROM b QUALIFY row_number() OVER (PARTITION BY channel ORDER BY n DESC, bin) = 1")
def peak_bin(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.peak(histogram.log_bins(events(spark, sf), "x", ["channel"]), ["channel"]).select("channel", r4("low", "low"), r4("high", "high"), "n")


@query(f"""WITH {LL}, s AS (SELECT channel, photons AS v FROM ll), {_BINS}, k AS (SELECT channel, low, high FROM b QUALIFY row_number() OVER (PARTITION BY channel ORDER BY n DESC, bin) = 1)
SELECT channel, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 4) AS median, round(any_value(low), 4) AS peak_low, round(any_value(high), 4) AS peak_high FROM s JOIN k USING (channel) GROUP BY channel""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = histogram.summary(lines(spark, sf), "photons", ["channel"], log=True)
    return out.select("channel", "n", *[r4(c, c) for c in ("mean", "std", "median", "peak_low", "peak_high")])


@query(f"""WITH {LE}, q AS (SELECT channel, min(x) lo, max(x) hi, count(*) n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM le GROUP BY channel),
w AS (SELECT channel, lo, hi, CASE WHEN iqr > 0 THEN least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0::DOUBLE / 3)) ELSE (hi - lo) / (log2(n) + 1) END AS w FROM q), k AS (SELECT channel, lo, hi, CAST(greatest(ceil((hi - lo) / w), 1) AS INTEGER) AS bins FROM w)
SELECT channel, CAST(least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM le JOIN k USING (channel) GROUP BY ALL""")
def auto_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.auto_bins(events(spark, sf), "x", ["channel"]).select("channel", "bin", "n")


_GRID = "g AS (SELECT *, CAST(floor((x - min(x) OVER (PARTITION BY channel)) / (max(x) OVER (PARTITION BY channel) - min(x) OVER (PARTITION BY channel)) * 50) + 1 AS INTEGER) AS xb, CAST(floor((y - min(y) OVER (PARTITION BY channel)) / (max(y) OVER (PARTITION BY channel) - min(y) OVER (PARTITION BY channel)) * 50) + 1 AS INTEGER) AS yb FROM ll), f AS (SELECT * FROM g WHERE xb <= 50 AND yb <= 50)"


@query(f"WITH {LL}, {_GRID} SELECT channel, xb, yb, count(*) AS n, round(ln(1 + count(*)), 4) AS log_density FROM f GROUP BY channel, xb, yb")
def grid_density(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.density(lines(spark, sf), 50, ["channel"]).withColumn("log_density", r4("log_density"))


@query(f"WITH {LL}, {_GRID}, d AS (SELECT *, count(*) OVER (PARTITION BY channel, xb, yb) AS k FROM f) SELECT channel, xb, yb, k AS cell_points, round(sum(x), 2) AS sum_x FROM d WHERE k >= 15 GROUP BY ALL")
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.dense_cells(lines(spark, sf), 50, 15, ["channel"]).groupBy("channel", "xb", "yb", "cell_points").agg(F.round(F.sum("x"), 2).alias("sum_x"))


@query(f"""WITH {LL}, {_GRID}, c AS (SELECT DISTINCT channel FROM ll), a AS (SELECT channel, i AS xb, j AS yb FROM c, range(1, 51) t(i), range(1, 51) u(j)), n AS (SELECT a.channel, coalesce(k, 0) AS k FROM a LEFT JOIN (SELECT channel, xb, yb, count(*) AS k FROM f GROUP BY ALL) USING (channel, xb, yb))
SELECT channel, round(avg(k), 4) AS mean, round(stddev_pop(k), 4) AS std, round(CAST(median(k) AS DOUBLE), 4) AS median FROM n GROUP BY channel""")
def grid_count_stats(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.density_summary(lines(spark, sf), 50, ["channel"]).select("channel", r4("mean", "mean"), r4("std", "std"), r4("median", "median"))


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH {LE} SELECT a.channel, a.loc_id AS i, b.loc_id AS j, round({_D}, 4) AS d FROM le a JOIN le b ON a.channel = b.channel AND a.loc_id < b.loc_id AND a.y BETWEEN b.y - 5 AND b.y + 5 AND {_D} <= 0.5::DOUBLE")
def radius_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.radius_pairs(events(spark, sf), 0.5, ["channel"]).select("channel", "i", "j", r4("d", "d"))


@query(f"WITH {LV}, p AS (SELECT a.loc_id, {_D} AS d FROM lv a JOIN lv b ON a.channel = b.channel AND a.loc_id <> b.loc_id AND {_D} <= 30) SELECT lv.loc_id, round(avg(d), 4) AS mean_distance, count(d) AS neighbours FROM lv LEFT JOIN p USING (loc_id) GROUP BY lv.loc_id")
def mean_in_radius_intra(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.mean_in_radius(vectors(spark, sf), None, 30, ["channel"]).withColumn("mean_distance", r4("mean_distance"))


@query(f"WITH {LV}, p AS (SELECT a.loc_id, {_D} AS d FROM lv a JOIN lv b ON a.channel = 0 AND b.channel = 1 AND {_D} <= 30) SELECT lv.loc_id, round(coalesce(avg(d), 0), 4) AS mean_distance, count(d) AS neighbours FROM lv LEFT JOIN p USING (loc_id) WHERE channel = 0 GROUP BY lv.loc_id")
def mean_in_radius_inter(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return spatial.mean_in_radius(v.filter("channel = 0"), v.filter("channel = 1"), 30, empty=0.0).withColumn("mean_distance", r4("mean_distance"))


def _knn_sql(on: str, k: int) -> str:
    return f"WITH {LV} SELECT a.loc_id AS i, b.loc_id AS j, round({_D}, 4) AS d, CAST(row_number() OVER (PARTITION BY a.loc_id ORDER BY {_D}, b.loc_id) AS INTEGER) AS rank FROM lv a JOIN lv b ON {on} QUALIFY row_number() OVER (PARTITION BY a.loc_id ORDER BY {_D}, b.loc_id) <= {k}"


@query(_knn_sql("a.channel = b.channel AND a.loc_id <> b.loc_id", 5))
def knn_intra(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.knn_join(vectors(spark, sf), None, 5, ["channel"]).select("i", "j", r4("d", "d"), "rank")


@query(_knn_sql("a.channel = 0 AND b.channel = 1", 3))
def knn_inter(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return spatial.knn_join(v.filter("channel = 0"), v.filter("channel = 1"), 3).select("i", "j", r4("d", "d"), "rank")


@query(f"WITH {LV}, k AS (SELECT a.loc_id, {_D} AS d, row_number() OVER (PARTITION BY a.loc_id ORDER BY {_D}) AS r FROM lv a JOIN lv b ON a.loc_id <> b.loc_id) SELECT round(quantile_cont(d, 0.1), 4) AS low, round(quantile_cont(d, 0.9), 4) AS high FROM k WHERE r = 10")
def kth_neighbor_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return search.kth_quantiles(vectors(spark, sf), 10).select(r4("low", "low"), r4("high", "high"))


@query(f"WITH {LV}, n AS (SELECT a.loc_id AS i, arg_min(b.loc_id, struct_pack(d := {_D}, j := b.loc_id)) AS j FROM lv a JOIN lv b ON a.channel = 1 AND b.channel = 0 GROUP BY a.loc_id) SELECT loc_id, count(j) AS n_points FROM (SELECT loc_id FROM lv WHERE channel = 0) LEFT JOIN n ON j = loc_id GROUP BY loc_id")
def voronoi_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return spatial.nearest_counts(v.filter("channel = 0"), v.filter("channel = 1"))


_EDGES = f"e AS (SELECT a.channel, a.loc_id AS i, b.loc_id AS j, {_D} AS d FROM le a JOIN le b ON a.channel = b.channel AND a.loc_id < b.loc_id AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 AND {_D} <= 15)"
_ROOTS = "u AS (SELECT i, j FROM e UNION SELECT j, i FROM e), cc(id, root) AS (SELECT DISTINCT i, i FROM u UNION SELECT u.j, cc.root FROM cc JOIN u ON u.i = cc.id), roots AS (SELECT id, min(root) AS root FROM cc GROUP BY id)"
_TRACKS = f"{_EDGES}, {_ROOTS}, t AS (SELECT channel, coalesce(root, loc_id) AS root, avg(x) AS x, avg(y) AS y, count(*) AS n_locs, min(frame) AS first_frame, max(frame) AS last_frame, max(frame) - min(frame) + 1 AS duration, sqrt(avg(x * x)) AS rms_x FROM le LEFT JOIN roots ON id = loc_id GROUP BY ALL)"


@query(f"WITH {LE}, {_EDGES} SELECT channel, i, j, round(d, 4) AS d FROM e")
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.link_edges(events(spark, sf), 15, 2, ["channel"]).withColumn("d", r4("d"))


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("rms_x", F.col("x"))
    return tracks.tracks(e, 15, 2, ["channel"], {"rms_x": "rms"})


@query(f"WITH RECURSIVE {LE}, {_TRACKS} SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY first_frame, root) AS track_id, round(x, 4) AS x, round(y, 4) AS y, n_locs, first_frame, last_frame, duration, round(rms_x, 4) AS rms_x FROM t")
def link_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return _tracks(spark, sf).select("channel", "track_id", r4("x", "x"), r4("y", "y"), "n_locs", "first_frame", "last_frame", "duration", r4("rms_x", "rms_x"))


@query(f"WITH RECURSIVE {LE}, {_TRACKS} SELECT channel, duration, count(*) AS n FROM t WHERE duration BETWEEN 2 AND 50 GROUP BY ALL")
def track_durations(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.by_duration(_tracks(spark, sf), 2, 50).groupBy("channel", "duration").agg(F.count(F.lit(1)).alias("n"))


def _dbscan_sql(eps: float, least: int, tag: str = "") -> str:
    """CTEs lab<tag>(loc_id, is_core, cluster) of view lv."""
    d = f"{_D} <= {eps}"
    return f"""nb{tag} AS (SELECT a.loc_id AS i, b.loc_id AS j FROM lv a JOIN lv b ON {d}), co{tag} AS (SELECT i FROM nb{tag} GROUP BY i HAVING count(*) >= {least}),
ce{tag} AS (SELECT n.i, n.j FROM nb{tag} n JOIN co{tag} a ON a.i = n.i JOIN co{tag} b ON b.i = n.j), cl{tag}(id, root) AS (SELECT i, i FROM co{tag} UNION SELECT c.j, cl{tag}.root FROM cl{tag} JOIN ce{tag} c ON c.i = cl{tag}.id),
cr{tag} AS (SELECT id, dense_rank() OVER (ORDER BY min(root)) - 1 AS k FROM cl{tag} GROUP BY id),
lab{tag} AS (SELECT lv.loc_id, bool_or(lv.loc_id IN (SELECT i FROM co{tag})) AS is_core, CAST(coalesce(min(CASE WHEN o.id = lv.loc_id THEN o.k END), min(o.k), -1) AS INTEGER) AS cluster FROM lv LEFT JOIN nb{tag} n ON n.i = lv.loc_id LEFT JOIN cr{tag} o ON o.id = n.j GROUP BY lv.loc_id)"""


@query(f"WITH RECURSIVE {LV}, {_dbscan_sql(30, 5)} SELECT * FROM lab")
def dbscan_labels(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.dbscan(vectors(spark, sf), 30, 5)


@query(f"""WITH RECURSIVE {LV}, {_dbscan_sql(30, 5)}, s AS (SELECT cluster, count(*) AS n_points, avg(x) AS cx, avg(y) AS cy, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM lab JOIN lv USING (loc_id) GROUP BY cluster)
SELECT cluster, n_points, round(cx, 4) AS x_center, round(cy, 4) AS y_center, round(sx, 4) AS x_std, round(sy, 4) AS y_std FROM s UNION ALL SELECT -1, 0, NULL, NULL, NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM s WHERE cluster = -1)""")
def cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = cluster.cluster_stats(v.join(cluster.dbscan(v, 30, 5), "loc_id"), hull=False)
    return out.select("cluster", "n_points", *[r4(c, c) for c in ("x_center", "y_center", "x_std", "y_std")])


@query(f"""WITH RECURSIVE {LV}, {_dbscan_sql(30, 5)}, m AS (SELECT cluster, median(x) AS cx, median(y) AS cy, count(*) AS n FROM lab JOIN lv USING (loc_id) WHERE cluster <> -1 GROUP BY cluster)
SELECT cluster, round(cx, 4) AS cx, round(cy, 4) AS cy, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 4) AS radius FROM lab JOIN lv USING (loc_id) JOIN m USING (cluster) GROUP BY cluster, cx, cy""")
def cluster_centres(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return cluster.centres(v.join(cluster.dbscan(v, 30, 5), "loc_id")).select("cluster", r4("cx", "cx"), r4("cy", "cy"), r4("radius", "radius"))


@query()
def cluster_hulls(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = cluster.cluster_stats(v.join(cluster.dbscan(v, 30, 5), "loc_id"))
    return out.select("cluster", "n_points", r4("area", "area"), r4("density", "density"))


@query()
def dbscan_loop(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.dbscan_loop(vectors(spark, sf), 30, 5)


def _phase(spark: SparkSession, sf: str) -> DataFrame:
    return search.phase_space(vectors(spark, sf), [(0, 25.0, 5), (1, 30.0, 5), (2, 34.0, 5)])


_PHASE = f"{LV}, {_dbscan_sql(25, 5, '0')}, {_dbscan_sql(30, 5, '1')}, {_dbscan_sql(34, 5, '2')}, ph AS (SELECT 0 AS cfg_id, loc_id, cluster FROM lab0 UNION ALL SELECT 1, loc_id, cluster FROM lab1 UNION ALL SELECT 2, loc_id, cluster FROM lab2)"
_OVER = "ov AS (SELECT a.cfg_id AS cfg_i, b.cfg_id AS cfg_j, a.cluster AS c_i, b.cluster AS c_j, count(*) AS n FROM ph a JOIN ph b ON a.loc_id = b.loc_id AND a.cfg_id <> b.cfg_id AND a.cluster <> -1 AND b.cluster <> -1 GROUP BY ALL)"
_SCORE = f"""{_OVER}, sz AS (SELECT cfg_id, cluster, count(*) AS s FROM ph WHERE cluster <> -1 GROUP BY ALL), one AS (SELECT cfg_id FROM sz GROUP BY cfg_id HAVING count(*) = 1 AND max(s) * 2 > (SELECT count(*) FROM lv)),
sc AS (SELECT cfg_i AS cfg_id, count(*) AS score FROM ov JOIN sz a ON a.cfg_id = cfg_i AND a.cluster = c_i JOIN sz b ON b.cfg_id = cfg_j AND b.cluster = c_j WHERE n * 2 > a.s AND n * 2 > b.s AND cfg_i NOT IN (SELECT cfg_id FROM one) AND cfg_j NOT IN (SELECT cfg_id FROM one) GROUP BY cfg_i),
al AS (SELECT cfg_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT cfg_id FROM ph) LEFT JOIN sc USING (cfg_id))"""


@query(f"WITH RECURSIVE {_PHASE}, {_OVER} SELECT * FROM ov")
def label_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return search.overlap(_phase(spark, sf))


@query(f"WITH RECURSIVE {_PHASE}, {_SCORE} SELECT * FROM al")
def similarity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return search.similarity(_phase(spark, sf))


#: Two thresholds with two sigmas each.
_GRID_4 = [(0, 25.0, 5), (1, 34.0, 5), (2, 25.0, 6), (3, 34.0, 6)]
_PHASE_4 = f"{LV}, {_dbscan_sql(25, 5, '0')}, {_dbscan_sql(34, 5, '1')}, {_dbscan_sql(25, 6, '2')}, {_dbscan_sql(34, 6, '3')}, ph AS (SELECT 0 AS cfg_id, 5 AS threshold, loc_id, cluster FROM lab0 UNION ALL SELECT 1, 5, loc_id, cluster FROM lab1 UNION ALL SELECT 2, 6, loc_id, cluster FROM lab2 UNION ALL SELECT 3, 6, loc_id, cluster FROM lab3)"
_SCORE_4 = _SCORE.replace("a.loc_id = b.loc_id AND", "a.loc_id = b.loc_id AND a.threshold = b.threshold AND")
_BEST_4 = "be AS (SELECT threshold, cfg_id, score FROM al JOIN (SELECT DISTINCT cfg_id, threshold FROM ph) USING (cfg_id) QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY score DESC, cfg_id) = 1), no AS (SELECT threshold, cfg_id, score, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ())::DOUBLE / (max(score) OVER () - min(score) OVER ()) END AS normalised FROM be)"


def _optima(spark: SparkSession, sf: str) -> DataFrame:
    phase = search.phase_space(vectors(spark, sf), _GRID_4)
    return search.line_of_optima(search.similarity(phase).join(phase.select("cfg_id", "threshold").distinct(), "cfg_id"))


@query(f"WITH RECURSIVE {_PHASE_4}, {_SCORE_4}, {_BEST_4} SELECT threshold, cfg_id, score, round(normalised, 4) AS normalised FROM no")
def line_of_optima(spark: SparkSession, sf: str) -> DataFrame:
    return _optima(spark, sf).withColumn("normalised", r4("normalised"))


@query(f"WITH RECURSIVE {_PHASE_4}, {_SCORE_4}, {_BEST_4} SELECT threshold, cfg_id FROM no ORDER BY coalesce(normalised < 0.5::DOUBLE, false) DESC, threshold LIMIT 1")
def agreed_configuration(spark: SparkSession, sf: str) -> DataFrame:
    return search.consensus(_optima(spark, sf))


@query()
def parameter_search(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(vectors(spark, sf), search.Search())


def _search_sql(ends: str, configs: str, scores: str, choice: str) -> str:
    """SQL of a search: CTE en(low, high), CTE cfg(cfg_id, sigma, threshold, copies), the condition under which labellings are compared, and CTE best(cfg_id) from al(cfg_id, score)."""
    return f"""WITH RECURSIVE {LV}, kd AS (SELECT a.loc_id, {_D} AS d, row_number() OVER (PARTITION BY a.loc_id ORDER BY {_D}) AS r FROM lv a JOIN lv b ON a.loc_id <> b.loc_id), en AS ({ends}), cfg AS ({configs}),
nb AS (SELECT cfg_id, threshold, a.loc_id AS i, b.loc_id AS j FROM lv a JOIN lv b ON {_D} <= (SELECT max(sigma) FROM cfg) JOIN cfg ON {_D} <= sigma), co AS (SELECT cfg_id, i FROM nb GROUP BY cfg_id, threshold, i HAVING count(*) >= threshold),
ce AS (SELECT n.cfg_id, n.i, n.j FROM nb n JOIN co a ON a.cfg_id = n.cfg_id AND a.i = n.i JOIN co b ON b.cfg_id = n.cfg_id AND b.i = n.j),
cl(cfg_id, id, root) AS (SELECT cfg_id, i, i FROM co UNION SELECT c.cfg_id, c.j, cl.root FROM cl JOIN ce c ON c.cfg_id = cl.cfg_id AND c.i = cl.id),
cr AS (SELECT cfg_id, id, dense_rank() OVER (PARTITION BY cfg_id ORDER BY min(root)) - 1 AS k FROM cl GROUP BY cfg_id, id),
ph AS (SELECT n.cfg_id, n.threshold, n.i AS loc_id, CAST(coalesce(min(CASE WHEN o.id = n.i THEN o.k END), min(o.k)) AS INTEGER) AS cluster FROM nb n JOIN cr o ON o.cfg_id = n.cfg_id AND o.id = n.j GROUP BY n.cfg_id, n.threshold, n.i),
ov AS (SELECT a.cfg_id AS cfg_i, b.cfg_id AS cfg_j, a.cluster AS c_i, b.cluster AS c_j, count(*) AS n FROM ph a JOIN ph b ON a.loc_id = b.loc_id AND a.cfg_id <> b.cfg_id AND {scores} GROUP BY ALL),
sz AS (SELECT cfg_id, cluster, count(*) AS s FROM ph GROUP BY ALL), fe AS (SELECT cfg_id, count(*) AS k, max(s) AS m FROM sz GROUP BY cfg_id), one AS (SELECT cfg_id FROM fe WHERE k = 1 AND m * 2 > (SELECT count(*) FROM lv)),
sc AS (SELECT cfg_i AS cfg_id, count(*) AS score FROM ov JOIN sz a ON a.cfg_id = cfg_i AND a.cluster = c_i JOIN sz b ON b.cfg_id = cfg_j AND b.cluster = c_j WHERE n * 2 > a.s AND n * 2 > b.s AND cfg_i NOT IN (SELECT cfg_id FROM one) AND cfg_j NOT IN (SELECT cfg_id FROM one) GROUP BY cfg_i),
al AS (SELECT cfg.cfg_id, threshold, copies * coalesce(score, 0) + (copies - 1) * CASE WHEN cfg.cfg_id IN (SELECT cfg_id FROM one) THEN 0 ELSE coalesce(k, 0) END AS score FROM cfg LEFT JOIN sc USING (cfg_id) LEFT JOIN fe USING (cfg_id)), {choice}
SELECT lv.loc_id, coalesce(p.cluster, -1) AS cluster, round(cfg.sigma, 4) AS sigma, cfg.threshold FROM lv CROSS JOIN best JOIN cfg USING (cfg_id) LEFT JOIN ph p ON p.cfg_id = best.cfg_id AND p.loc_id = lv.loc_id"""


#: Three sigmas between bounds of two neighbours and two thresholds, all six labellings compared.
_ADAPTIVE = search.Search(points=3, min_threshold=5, max_threshold=7, same=None, adaptive=True)
_ADAPTIVE_SQL = _search_sql(
    "SELECT quantile_cont(CASE WHEN r = 5 THEN d END, 0.1) AS low, quantile_cont(CASE WHEN r = 7 THEN d END, 0.9) AS high FROM kd WHERE r IN (5, 7)",
    "SELECT CAST(t.i * 3 + k.i AS INTEGER) AS cfg_id, exp(ln(low) + (ln(high) - ln(low)) * k.i / 2) AS sigma, CAST(5 + t.i AS INTEGER) AS threshold, 1 AS copies FROM en, range(3) k(i), range(2) t(i)",
    "true",
    f"{_BEST_4.replace('al JOIN (SELECT DISTINCT cfg_id, threshold FROM ph) USING (cfg_id)', 'al')}, best AS (SELECT cfg_id FROM no ORDER BY coalesce(normalised < 0.5::DOUBLE, false) DESC, threshold LIMIT 1)",
)
_ONE_SIGMA = search.Search(mode="oneD_thresholds", min_threshold=5, max_threshold=9)
_ONE_SIGMA_SQL = _search_sql(
    "SELECT min(d) AS low FROM kd WHERE r = 9 AND d >= (SELECT median(d) FROM kd WHERE r = 9)",
    "SELECT CAST(i AS INTEGER) AS cfg_id, low AS sigma, CAST(5 + i AS INTEGER) AS threshold, 4 AS copies FROM en, range(4) t(i)",
    "a.threshold = b.threshold",
    "best AS (SELECT cfg_id FROM al ORDER BY score DESC, cfg_id LIMIT 1)",
)


def _searched(points: DataFrame, how: search.Search) -> DataFrame:
    labels, best = search.find_parameters(points, how)
    return labels.crossJoin(F.broadcast(best)).select("loc_id", "cluster", r4("sigma", "sigma"), "threshold")  # one row


@query(_ADAPTIVE_SQL)
def parameter_search_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(vectors(spark, sf), _ADAPTIVE)


@query(_ONE_SIGMA_SQL)
def parameter_search_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(vectors(spark, sf), _ONE_SIGMA)


@query()
def parameter_search_solid(spark: SparkSession, sf: str) -> DataFrame:
    """In three dimensions, each channel with parameters of its own; one row per channel and cluster."""
    v = vectors(spark, sf, deep=True)
    labels, best = search.find_parameters(v, search.Search(axes=("x", "y", "z")), ["channel"])
    n = labels.groupBy("channel", "cluster").agg(F.count(F.lit(1)).alias("n_points"))
    return n.join(F.broadcast(best), "channel").select("channel", "cluster", "n_points", r4("sigma", "sigma"), "threshold")  # a row per channel


@query(f"""WITH RECURSIVE {_PHASE}, n AS (SELECT a.cluster AS u, b.cluster AS v, count(*)::DOUBLE AS n FROM lab0 a JOIN lab1 b USING (loc_id) GROUP BY ALL), u AS (SELECT u, sum(n) AS m FROM n GROUP BY u), v AS (SELECT v, sum(n) AS m FROM n GROUP BY v),
k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS t, (SELECT sum(m * (m - 1) / 2) FROM u) AS su, (SELECT sum(m * (m - 1) / 2) FROM v) AS sv, (SELECT sum(n) FROM n) AS n),
ru AS (SELECT m AS a, count(*) AS ka FROM u GROUP BY m), rv AS (SELECT m AS b, count(*) AS kb FROM v GROUP BY m), x AS (SELECT ka, kb, a, b, k.n, unnest(range(CAST(greatest(1, a + b - k.n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1))::DOUBLE AS i FROM ru, rv, k),
em AS (SELECT sum(ka * kb * i / n * ln(n * i / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(a - i + 1) - lgamma(b - i + 1) - lgamma(n - a - b + i + 1))) AS emi FROM x),
h AS (SELECT (SELECT -sum(m / k.n * ln(m / k.n)) FROM u, k) AS hu, (SELECT -sum(m / k.n * ln(m / k.n)) FROM v, k) AS hv, (SELECT -sum(n.n / k.n * ln(n.n / k.n)) FROM n, k) AS huv)
SELECT round((t - su * sv / (n * (n - 1) / 2)) / ((su + sv) / 2 - su * sv / (n * (n - 1) / 2)), 4) AS ari, round(t / sqrt(su * sv), 4) AS fm, round(2 * (hu + hv - huv) / (hu + hv), 4) AS nmi, round((hu + hv - huv - emi) / ((hu + hv) / 2 - emi), 4) AS ami,
(SELECT count(*) FROM u WHERE u <> -1) AS clusters_u, (SELECT count(*) FROM v WHERE v <> -1) AS clusters_v, (SELECT coalesce(sum(m), 0)::BIGINT FROM u WHERE u = -1) AS noise_u, (SELECT coalesce(sum(m), 0)::BIGINT FROM v WHERE v = -1) AS noise_v FROM k, h, em""")
def partition_agreement(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = cluster.agreement(cluster.dbscan(v, 25, 5), cluster.dbscan(v, 30, 5))
    return out.select(*[r4(c, c) for c in ("ari", "fm", "nmi", "ami")], "clusters_u", "clusters_v", "noise_u", "noise_v")


@query()
def hdbscan_labels(spark: SparkSession, sf: str) -> DataFrame:
    return hdbscan.hdbscan(vectors(spark, sf), 10, 5, ["channel"]).withColumn("density", r4("density"))


@query()
def hull_mask_overlap(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    a, b = [v.join(cluster.dbscan(v, eps, 5), "loc_id") for eps in (25, 30)]
    return cluster.hull_iou(a, b).withColumn("iou", r4("iou"))


_SHIFT = "k AS (SELECT channel, frame >= 360 AS late, CAST(round_even(x / 20, 0) AS BIGINT) AS xu, CAST(round_even(y / 20, 0) AS BIGINT) AS yu, count(*) AS n FROM le GROUP BY ALL), sc AS (SELECT t.channel, CAST(i AS BIGINT) AS dx, CAST(j AS BIGINT) AS dy, CAST(sum(least(t.n, r.n)) AS BIGINT) AS score FROM k t, range(-3, 4) a(i), range(-3, 4) b(j), k r WHERE t.late AND NOT r.late AND t.channel = r.channel AND r.xu = t.xu + i AND r.yu = t.yu + j GROUP BY ALL)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return drift.shift_scores(e.filter("frame < 360"), e.filter("frame >= 360"), 20, 3, ["channel"])


@query(f"WITH {LE}, {_SHIFT} SELECT * FROM sc")
def intersection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


def _phase_sql(c: str) -> str:
    t = f"2 * pi() / 7 * ({c} + 3)"
    return f"atan2(-sum(score * sin({t})), sum(score * cos({t})))"


@query(f"WITH {LE}, {_SHIFT}, a AS (SELECT channel, {_phase_sql('dx')} AS tx, {_phase_sql('dy')} AS ty FROM sc GROUP BY channel) SELECT channel, round((abs(CASE WHEN tx > 0 THEN tx - 2 * pi() ELSE tx END) / (2 * pi() / 7) - 3) * 20, 4) AS px, round((abs(CASE WHEN ty > 0 THEN ty - 2 * pi() ELSE ty END) / (2 * pi() / 7) - 3) * 20, 4) AS py FROM a")
def first_harmonic_peak(spark: SparkSession, sf: str) -> DataFrame:
    return drift.harmonic_peak(_scores(spark, sf), 3, 20, ["channel"]).select("channel", r4("px", "px"), r4("py", "py"))


@query()
def drift_estimate(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.estimate(events(spark, sf), segmentation=100, intersect=20, roi=60)
    return out.select("channel", "frame", r4("dx", "dx"), r4("dy", "dy"))


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """A made drift over the frames of events: dx grows by a hundredth a frame, dy swings."""
    f = events(spark, sf).select("channel", "frame").distinct()
    return f.select("channel", "frame", (F.col("frame") * 0.01).alias("dx"), (F.sin(F.col("frame") / 50.0) * 3).alias("dy"))


_CURVE = "cu AS (SELECT DISTINCT channel, frame, frame * 0.01::DOUBLE AS dx, sin(frame / 50.0::DOUBLE) * 3 AS dy FROM le)"


@query(f"WITH {LE}, {_CURVE} SELECT loc_id, channel, frame, round(x - dx, 4) AS x, round(y - dy, 4) AS y FROM le JOIN cu USING (channel, frame)")
def drift_apply(spark: SparkSession, sf: str) -> DataFrame:
    return drift.applied(events(spark, sf), _curve(spark, sf), ["channel", "frame"]).select("loc_id", "channel", "frame", r4("x", "x"), r4("y", "y"))


@query(f"""WITH {LE}, {_CURVE}, r AS (SELECT channel, frame, dx * 1.1::DOUBLE - dx AS rx, dy * 1.1::DOUBLE - dy AS ry FROM cu), z AS (SELECT channel, rx - arg_min(rx, frame) OVER (PARTITION BY channel) AS rx, ry - arg_min(ry, frame) OVER (PARTITION BY channel) AS ry FROM r), d AS (SELECT channel, sqrt(rx * rx + ry * ry) AS d FROM z)
SELECT channel, round(stddev_pop(d), 4) AS std, round(sqrt(avg(d * d)), 4) AS rmse, round(max(d), 4) AS max, round(median(d), 4) AS median FROM d GROUP BY channel""")
def drift_residuals(spark: SparkSession, sf: str) -> DataFrame:
    true = _curve(spark, sf)
    near = true.withColumns({"dx": F.col("dx") * 1.1, "dy": F.col("dy") * 1.1})
    return drift.residuals(near, true, ["channel"]).select("channel", *[r4(c, c) for c in ("std", "rmse", "max", "median")])


@query(f"WITH {LE}, {_CURVE}, m AS (SELECT arg_max(dx, frame) - arg_min(dx, frame) AS mx, arg_max(dy, frame) - arg_min(dy, frame) AS my FROM cu WHERE channel = 'view') SELECT loc_id, round(x - mx, 4) AS x, round(y - my, 4) AS y FROM le, m WHERE channel = 'click'")
def channel_registration(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return drift.registered(e.filter("channel = 'click'"), _curve(spark, sf).filter("channel = 'view'")).select("loc_id", r4("x", "x"), r4("y", "y"))


@query(f"""WITH RECURSIVE {LE}, g AS (SELECT channel, CAST(floor(frame / 24) AS INTEGER) AS segment, avg(x) - 245 AS rx, avg(y) - 745 AS ry FROM le GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY segment) AS k, sqrt(rx * rx + ry * ry) > 35 AS far FROM g),
r(channel, k, segment, xs, ys, replaced) AS (SELECT DISTINCT channel, 0::BIGINT, -1, []::DOUBLE[], []::DOUBLE[], false FROM o UNION ALL SELECT r.channel, r.k + 1, o.segment, list_append(xs, CASE WHEN far THEN coalesce(list_avg(xs[greatest(1, len(xs) - 9):]), 0) ELSE rx END), list_append(ys, CASE WHEN far THEN coalesce(list_avg(ys[greatest(1, len(ys) - 9):]), 0) ELSE ry END), far FROM r JOIN o ON o.channel = r.channel AND o.k = r.k + 1),
t AS (SELECT channel, segment, replaced, xs[-1] AS rel_x, ys[-1] AS rel_y, list_sum(xs) AS cum_x, list_sum(ys) AS cum_y FROM r WHERE k > 0)
SELECT channel, segment, replaced, round(rel_x, 4) AS rel_x, round(rel_y, 4) AS rel_y, round(cum_x, 4) AS cum_x, round(cum_y, 4) AS cum_y, round(sqrt(cum_x * cum_x + cum_y * cum_y), 4) AS magnitude FROM t""")
def drift_validation(spark: SparkSession, sf: str) -> DataFrame:
    seg = events(spark, sf).groupBy("channel", F.floor(F.col("frame") / 24).cast("int").alias("segment")).agg((F.avg("x") - 245).alias("rel_x"), (F.avg("y") - 745).alias("rel_y"))
    out = drift.checked_segments(seg, ["channel"], 35, 10)
    return out.select("channel", "segment", "replaced", *[r4(c, c) for c in ("rel_x", "rel_y", "cum_x", "cum_y", "magnitude")])


@query()
def drift_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.estimated(events(spark, sf), segmentation=100, intersect=20, roi=60, limit=35)[1]
    return out.select("channel", "segment", "replaced", *[r4(c, c) for c in ("centre", "rel_x", "rel_y", "cum_x", "cum_y", "magnitude")])


_LP = "s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sx * sx + 117.0::DOUBLE * 117 / 12 AS s, photons AS n, lp AS b FROM ll WHERE photons > 0 AND sx > 0 AND lp >= 0)"


@query(f"WITH {LL}, {_LP} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(2 * s / n * (16.0::DOUBLE / 9 + 8 * pi() * s * b / (n * 117.0::DOUBLE * 117))), 4) AS precision FROM s")
def precision_lsq(spark: SparkSession, sf: str) -> DataFrame:
    p = precision.precision(F.col("sx"), F.col("photons"), F.col("lp"), 117, "lsq", emccd=True)
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r4(p, "precision"))


@query()
def precision_mle(spark: SparkSession, sf: str) -> DataFrame:
    p = precision.precision(F.col("sx"), F.col("photons"), F.col("lp"), 117, "mle")
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r4(p, "precision"))


@query(f"WITH {LL}, {_LP} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(s / n * (16.0::DOUBLE / 9 + 8 * pi() * s * b / (n * 117.0::DOUBLE * 117))), 4) AS lp_calculated FROM s")
def precision_by_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Raw headers, one sigma column, a stage in between that carries what the calculation needs."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    raw = lines(spark, sf).withColumnsRenamed({"sx": "sigma [nm]", "photons": "intensity (photons)", "lp": "background"})
    headers = precision.Headers(background="background", sigma="sigma [nm]", output="lp_calculated")
    moved = raw.select(*key, "x", "y", *[F.col(f"`{h}`") for h in headers.carried() if h in raw.columns])
    return precision.with_precision(moved, headers, 117, method="lsq").select(*key, r4("lp_calculated", "lp_calculated"))


@query(f"""WITH {LL}, {_GRID}, c AS (SELECT DISTINCT channel FROM ll), a AS (SELECT channel, i AS xb, j AS yb FROM c, range(1, 51) t(i), range(1, 51) u(j)), n AS (SELECT a.channel, coalesce(k, 0) AS k FROM a LEFT JOIN (SELECT channel, xb, yb, count(*) AS k FROM f GROUP BY ALL) USING (channel, xb, yb)),
e AS (SELECT channel, min(k) AS lo, (max(k) - min(k)) / 30.0::DOUBLE AS w FROM n GROUP BY channel) SELECT channel, CAST(least(floor((k - lo) / w), 29) AS INTEGER) AS bin, round(any_value(lo + least(floor((k - lo) / w), 29) * w), 4) AS low, round(any_value(lo + (least(floor((k - lo) / w), 29) + 1) * w), 4) AS high, round(count(*) / (2500 * any_value(w)), 4) AS density FROM n JOIN e USING (channel) GROUP BY ALL""")
def grid_count_density(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.count_density(lines(spark, sf), 50, ["channel"]).select("channel", "bin", *[r4(c, c) for c in ("low", "high", "density")])


@query("""WITH a AS (SELECT p_brand AS stem, min(p_brand || '_cpp_clusters.csv') AS a FROM part WHERE p_size < 12 GROUP BY 1), b AS (SELECT p_brand || p_type AS s FROM part WHERE p_size > 40), c AS (SELECT s AS stem, min(s || '_pip_clusters.csv') AS b FROM b GROUP BY 1 UNION ALL SELECT p_brand, min(p_brand || '.csv') FROM part WHERE p_size = 25 GROUP BY 1)
SELECT stem, a, b, CASE WHEN a IS NULL THEN 'only_b' WHEN b IS NULL THEN 'only_a' ELSE 'both' END AS side FROM a FULL JOIN c USING (stem)""")
def stem_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two folders that belong together, and those that have no partner."""
    p = table(spark, sf, "part")
    keyed = lambda df: df.withColumn("stem", names.pair_stem(F.col("name")))
    a = p.filter("p_size < 12").select(F.concat(F.lit("/data/a/"), "p_brand", F.lit("_cpp_clusters.csv")).alias("path"))
    b = p.filter("p_size > 40").select(F.concat(F.lit("/b/"), "p_brand", "p_type", F.lit("_pip_clusters.csv")).alias("path")).unionByName(p.filter("p_size = 25").select(F.concat(F.lit("/b/"), "p_brand", F.lit(".csv")).alias("path")))
    return merge.paired(*[keyed(df.select(names.file_name(F.col("path")).alias("name"))) for df in (a, b)], "stem")


@query("""WITH e AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type AS channel, CAST(floor(value / 50) AS BIGINT) AS xb, CAST(floor(user_id * 10 / 500.0) AS BIGINT) AS yb, count(*) AS n FROM events WHERE value >= 10 GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, channel, xb, yb, n FROM e WHERE day + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events WHERE value >= 10)""")
def density_of_a_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts per cell of a stream of event files; the last day is still open when the files end."""
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/event[s].parquet").filter("value >= 10")  # as a pattern, a file will do for a folder
    at = stream.select(F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("x"), (F.col("user_id") * 10.0).alias("y"), F.col("event_type").alias("channel"))
    counted = counts.density_stream(at.withColumns({"x": F.col("x") / 50, "y": F.col("y") / 500}), "time", "1 hour", "1 day", 1.0, ["channel"])
    out = counts.drained(counted, "stream-density")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "channel", "xb", "yb", "n")


_CBC = f"""p AS (SELECT a.loc_id AS i, b.channel AS c, greatest(ceil({_D} / 12.0::DOUBLE), 1) AS m, {_D} AS d FROM lv a JOIN lv b ON a.channel = 0 AND a.loc_id <> b.loc_id AND {_D} <= 60), g AS (SELECT i, min(d) FILTER (c = 1) AS d_nn FROM p GROUP BY i HAVING count(*) FILTER (c = 0) > 0 AND count(*) FILTER (c = 1) > 0),
h AS (SELECT g.i, d_nn, k AS m, (SELECT count(*) FROM p WHERE p.i = g.i AND c = 0 AND p.m <= k) AS na, (SELECT count(*) FROM p WHERE p.i = g.i AND c = 1 AND p.m <= k) AS nb FROM g, range(1, 6) t(k)),
s AS (SELECT i, d_nn, round(na / sum(CASE WHEN m = 5 THEN na END) OVER (PARTITION BY i) * 25.0::DOUBLE / (m * m), 12) AS da, round(nb / sum(CASE WHEN m = 5 THEN nb END) OVER (PARTITION BY i) * 25.0::DOUBLE / (m * m), 12) AS db FROM h),
k AS (SELECT i, d_nn, rank() OVER (PARTITION BY i ORDER BY da) + (count(*) OVER (PARTITION BY i, da) - 1) / 2.0::DOUBLE - 3 AS x, rank() OVER (PARTITION BY i ORDER BY db) + (count(*) OVER (PARTITION BY i, db) - 1) / 2.0::DOUBLE - 3 AS y FROM s),
z AS (SELECT i, d_nn, CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN sum(x * y) / sqrt(sum(x * x) * sum(y * y)) ELSE 0 END AS rho FROM k GROUP BY i, d_nn)"""


@query(f"WITH {LV}, {_CBC} SELECT loc_id, round(d_nn, 4) AS d_nn, round(rho, 4) AS rho, round(rho * exp(-d_nn / 60), 4) AS cbc FROM lv LEFT JOIN z ON i = loc_id WHERE channel = 0")
def cbc(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return coloc.cbc(v.filter("channel = 0"), v.filter("channel = 1"), 60, 5).select("loc_id", r4("d_nn", "d_nn"), r4("rho", "rho"), r4("cbc", "cbc"))


@query()
def voronoi_areas(spark: SparkSession, sf: str) -> DataFrame:
    return cells.voronoi(vectors(spark, sf)).select("loc_id", r4("area", "area"), r4("mean_neighbour_distance", "mean_neighbour_distance"), F.size("neighbours").alias("n_neighbours"))


@query()
def voronoi_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.voronoi_dense(vectors(spark, sf)).withColumn("area", r4("area"))


@query()
def relative_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = coloc.both_directions(v.filter("channel = 0"), v.filter("channel = 1"), coloc.relative_enrichment)
    return out.select("direction", "loc_id", "n_points", r4("area", "area"), r4("enrichment", "enrichment"))


_D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_LV3 = LV.replace(" AS y, ", " AS y, 1000.0::DOUBLE * CAST(embedding[3] AS DOUBLE) AS z, ")


@query(f"WITH {_LV3} SELECT a.loc_id AS i, b.loc_id AS j, round({_D3}, 4) AS d, CAST(row_number() OVER (PARTITION BY a.loc_id ORDER BY {_D3}, b.loc_id) AS INTEGER) AS rank FROM lv a JOIN lv b ON a.channel = b.channel AND a.loc_id <> b.loc_id QUALIFY row_number() OVER (PARTITION BY a.loc_id ORDER BY {_D3}, b.loc_id) <= 3")
def knn_solid(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest neighbours in three dimensions."""
    return spatial.knn_join(vectors(spark, sf, deep=True), None, 3, ["channel"], ("x", "y", "z")).select("i", "j", r4("d", "d"), "rank")


@query()
def relative_enrichment_solid(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf, deep=True)
    out = coloc.relative_enrichment(v.filter("channel = 0"), v.filter("channel = 1"), ("x", "y", "z"))
    return out.select("loc_id", "n_points", r4("area", "volume"), r4("mean_neighbour_distance", "mean_neighbour_distance"), r4("enrichment", "enrichment"))


@query()
def enrichment_bins(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = coloc.enrichment_bins(coloc.relative_enrichment(v.filter("channel = 0"), v.filter("channel = 1")), "mean_neighbour_distance")
    return out.select("bin", "n_regions", "n_points", r4("area", "area"), r4("ratio", "ratio"))


@query(f"""WITH {LL}, e AS (SELECT min(photons) lo, max(photons) hi FROM ll), b AS (SELECT least(floor((photons - lo) / ((hi - lo) / 256)), 255) AS bin, lo, hi, count(*)::DOUBLE AS n FROM ll, e GROUP BY ALL), m AS (SELECT bin, n, lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 256) AS mid FROM b),
w AS (SELECT bin, mid, sum(n) OVER (ORDER BY bin) AS w0, sum(n * mid) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS w, sum(n * mid) OVER () AS s FROM m)
SELECT round(mid, 4) AS threshold FROM w ORDER BY CASE WHEN w > w0 THEN w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) ELSE 0 END DESC, bin LIMIT 1""")
def otsu_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.otsu(lines(spark, sf), "photons").select(r4("threshold", "threshold"))


@query(f"""WITH {LV}, a AS (SELECT a.loc_id, a.channel, {_D} AS d, row_number() OVER (PARTITION BY a.loc_id ORDER BY {_D}, b.loc_id) AS r FROM lv a JOIN lv b ON a.channel = b.channel AND a.loc_id <> b.loc_id), o AS (SELECT a.loc_id, min({_D}) AS d, avg({_D}) FILTER ({_D} <= 30) AS m FROM lv a JOIN lv b ON a.channel <> b.channel GROUP BY a.loc_id),
i AS (SELECT loc_id, channel, min(d) AS d, avg(d) FILTER (d <= 30) AS m FROM a GROUP BY ALL)
SELECT loc_id, channel, round(i.d, 4) AS nn_distance, round(o.d, 4) AS nn_distance_other, round(i.m, 4) AS mean_distance, round(o.m, 4) AS mean_distance_other FROM i JOIN o USING (loc_id)""")
def neighbour_suite(spark: SparkSession, sf: str) -> DataFrame:
    out = experiment.neighbours(vectors(spark, sf), 30, 1)
    return out.select("loc_id", "channel", *[r4(c, c) for c in ("nn_distance", "nn_distance_other", "mean_distance", "mean_distance_other")])


_PEAKS = f"""{_BINS}, k AS (SELECT channel, low, high FROM b QUALIFY row_number() OVER (PARTITION BY channel ORDER BY n DESC, bin) = 1)
SELECT channel, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 4) AS median, round(any_value(low), 4) AS peak_low, round(any_value(high), 4) AS peak_high FROM s JOIN k USING (channel) WHERE v > 0 GROUP BY channel"""


def _summary(df: DataFrame, value: str) -> DataFrame:
    return histogram.summary(df, value, ["channel"], log=True).select("channel", "n", *[r4(c, c) for c in ("mean", "std", "median", "peak_low", "peak_high")])


@query(f"WITH {LV}, s AS (SELECT a.channel, min({_D}) AS v FROM lv a JOIN lv b ON a.channel = b.channel AND a.loc_id <> b.loc_id GROUP BY a.channel, a.loc_id), {_PEAKS}")
def neighbour_distance_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    near = spatial.knn_join(v, None, 1, ["channel"]).filter("rank = 1").select(F.col("i").alias("loc_id"), "d")
    return _summary(v.join(near, "loc_id"), "d")


@query(f"WITH {LV}, s AS (SELECT a.channel, avg({_D}) AS v FROM lv a JOIN lv b ON a.channel = b.channel AND a.loc_id <> b.loc_id AND {_D} <= 30 GROUP BY a.channel, a.loc_id), {_PEAKS}")
def mean_distance_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return _summary(v.join(spatial.mean_in_radius(v, None, 30, ["channel"]).select("loc_id", "mean_distance"), "loc_id"), "mean_distance")


_LABELS = f"WITH RECURSIVE {_PHASE}, lb AS (SELECT lv.channel, lv.x, lv.y, cluster FROM lab0 JOIN lv USING (loc_id) WHERE cluster <> -1)"


@query(f"{_LABELS}, s AS (SELECT 0 AS channel, count(*)::DOUBLE AS v FROM lb GROUP BY cluster), {_PEAKS}")
def cluster_size_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.sizes(cluster.dbscan(vectors(spark, sf), 25, 5).filter("cluster <> -1").withColumn("channel", F.lit(0)), ["channel"])
    return _summary(found.withColumn("n_points", F.col("n_points").cast("double")), "n_points")


# A hull's edges are the pairs of points that have all others on one side.
_AREA = """he AS (SELECT p.cluster, p.x * q.y - q.x * p.y AS c FROM lb p JOIN lb q ON p.cluster = q.cluster AND (p.x <> q.x OR p.y <> q.y) WHERE NOT EXISTS (SELECT 1 FROM lb o WHERE o.cluster = p.cluster AND (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0)),
ar AS (SELECT cluster, sum(c) / 2 AS area FROM he GROUP BY cluster), st AS (SELECT cluster, area, n_points / area AS density FROM ar JOIN (SELECT cluster, count(*) AS n_points FROM lb GROUP BY cluster) USING (cluster) WHERE n_points >= 3),
s AS (SELECT f AS channel, v FROM st, LATERAL (VALUES ('area', area), ('density', density)) t(f, v))"""


@query(f"{_LABELS}, {_AREA}, {_PEAKS.replace('SELECT channel, count(*) AS n, round', 'SELECT channel AS feature, count(*) AS n, round')}")
def cluster_feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    stats = cluster.cluster_stats(v.join(cluster.dbscan(v, 25, 5), "loc_id")).filter("cluster <> -1")
    each = stats.select(F.explode(F.create_map(F.lit("area"), "area", F.lit("density"), "density")).alias("channel", "v"))
    return _summary(each, "v").withColumnRenamed("channel", "feature")


@query(f"WITH {LV}, {_CBC}, cv AS (SELECT rho * exp(-d_nn / 60) AS v FROM z WHERE rho IS NOT NULL), q AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM cv), w AS (SELECT lo, hi, CASE WHEN iqr > 0 THEN least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0::DOUBLE / 3)) ELSE (hi - lo) / (log2(n) + 1) END AS w FROM q), nb AS (SELECT lo, hi, CAST(greatest(ceil((hi - lo) / w), 1) AS INTEGER) AS bins FROM w), bb AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo, any_value((hi - lo) / bins) AS step FROM cv, nb GROUP BY ALL), t AS (SELECT * FROM bb ORDER BY n DESC, bin LIMIT 1) SELECT '1_to_2' AS direction, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 4) AS median, round(any_value(t.lo + t.bin * step), 4) AS peak_low, round(any_value(t.lo + (t.bin + 1) * step), 4) AS peak_high FROM cv, t")
def cbc_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    values = coloc.cbc(v.filter("channel = 0"), v.filter("channel = 1"), 60, 5).withColumn("direction", F.lit("1_to_2"))
    return histogram.summary(values, "cbc", ["direction"]).select("direction", "n", *[r4(c, c) for c in ("mean", "std", "median", "peak_low", "peak_high")])


@query()
def enrichment_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = coloc.both_directions(v.filter("channel = 0"), v.filter("channel = 1"), coloc.relative_enrichment)
    return histogram.summary(out, "enrichment", ["direction"], log=True).select("direction", "n", *[r4(c, c) for c in ("mean", "std", "median", "peak_low", "peak_high")])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), c AS (SELECT o_custkey, o_totalprice AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F')
SELECT o.o_custkey, o.place, o.o_orderkey, o.o_totalprice, c.other FROM o LEFT JOIN c USING (o_custkey, place)""")
def positional_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    right = o.filter("o_orderstatus <> 'F'").withColumn("other", F.col("o_totalprice"))
    return merge.by_place(o.select("o_custkey", "o_orderkey", "o_totalprice"), right, "o_custkey", ["o_orderkey"], ["o_orderdate", "o_orderkey"], ["other"]).select("o_custkey", "place", "o_orderkey", "o_totalprice", "other")


@query("""SELECT source, nation, count(*) AS n, round(avg(balance), 4) AS mean_balance, count(segment) AS with_segment FROM (SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier) GROUP BY source, nation""")
def lineage_union(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return merge.stacked({"customer": c, "supplier": s}).groupBy("source", "nation").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("balance"), "mean_balance"), F.count("segment").alias("with_segment"))


@query(r"""WITH f AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_type || '-' || (p_size % 3 + 1) AS s FROM part), p AS (SELECT p_partkey, s, string_split(s, '_') AS a FROM f)
SELECT p_partkey, coalesce(a[3], 'Unknown') AS cell_line, regexp_replace(s, '-\d+$', '') AS channel, CASE WHEN len(a) >= 5 THEN a[4] WHEN len(a) >= 3 THEN a[-2] ELSE a[1] END AS label_1, CASE WHEN len(a) >= 5 THEN a[5] WHEN len(a) >= 2 THEN a[-1] ELSE 'Ch2' END AS label_2 FROM p""")
def name_rules(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_type"), F.lit("-"), (F.col("p_size") % 3 + 1).cast("string"))
    one, two = names.stem_labels(F.col("s"))
    return table(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", names.cell_line(F.col("s")).alias("cell_line"), names.channel_name(F.col("s")).alias("channel"), one.alias("label_1"), two.alias("label_2"))


@query()
def experiment_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole configured chain over events; one row per stage with its number of rows."""
    c = Config.model_validate({"skip_frames": 0, "linking": {"max_distance": 15}, "regions": {"grid_size": 40, "threshold": 2}, "neighbours": {"radius": 60}, "clustering": {"eps": 12, "min_samples": 4}, "colocalization": {"radius": 60, "channels": ["click", "view"]}})
    out = experiment.run(events(spark, sf), c)
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in out.items()]
    whole = rows[0]
    for x in rows[1:]:
        whole = whole.unionByName(x)
    return whole


