"""Whole records of signals: quality, loudness, pitch tracks and chords from samples, with the SQL of their parts put together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loudness, matching, musical, pitch, quality, report
from ..sources import results, sinks, tables
from . import oracle as o
from .registry import query, rounded
from .spectral_queries import _NOTES, FLUX, HOP, RATE, SIZE, MATCHED, Q, _head, pairs, prints, samples, vectors
from .value_queries import VERDICT, VERDICT_COLUMNS, _weighting_sql

#: The daily sums at a nominal rate: chunks of 4 samples for the noise floor and of 16 for the range.
DAILY_RATE = 40
METRICS = f"""
    lv AS (SELECT signal_id, count(*) AS n, avg(x) AS dc_offset, avg(CASE WHEN abs(x) >= 0.99 THEN 1 ELSE 0 END) AS clipping_ratio, sqrt(avg(x * x)) AS rms,
            CAST(sum(CASE WHEN abs(x) < 0.0001 THEN 1 ELSE 0 END) AS BIGINT) AS dropout_count, count(DISTINCT CASE WHEN pos < 10000 THEN round(x * 32768) END) AS v FROM ev GROUP BY 1),
    c4 AS (SELECT signal_id, pos // 4 AS c, sqrt(avg(x * x)) AS r FROM ev GROUP BY 1, 2), nf AS (SELECT signal_id, coalesce(20 * log10(min(CASE WHEN r > 0 THEN r END)), -60) AS noise_floor_db FROM c4 GROUP BY 1),
    c16 AS (SELECT signal_id, pos // 16 AS c, sqrt(avg(x * x)) AS r FROM ev GROUP BY 1, 2 HAVING sqrt(avg(x * x)) > 0),
    dr AS (SELECT signal_id, CASE WHEN count(*) > 1 THEN 20 * log10({o.percentile("r", 95)} / {o.percentile("r", 10)}) ELSE 0 END AS dynamic_range_db FROM c16 GROUP BY 1),
    sn AS (WITH {_head(2048, "none")}, rk AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY v) AS r, count(*) OVER (PARTITION BY signal_id) AS c FROM mg)
        SELECT signal_id, avg(CASE WHEN r <= c // 3 THEN v END) AS low, max(v) AS peak, sum(CASE WHEN k >= m // 2 - m // 2 // 10 THEN v * v ELSE 0 END) / sum(v * v) AS aliasing_score FROM rk GROUP BY 1),
    fq AS (WITH {_head(4096, "none")}, a AS (SELECT signal_id, avg(v) AS mean, var_pop(v) AS var FROM mg GROUP BY 1) SELECT signal_id, 1 / (1 + var / (mean * mean) * 10) AS frequency_response_score FROM a),
    th AS (WITH {_head(4096, "hann")}, pk AS (SELECT signal_id, max(v) AS p, arg_max(k, v) AS b FROM mg GROUP BY 1),
        ot AS (SELECT mg.signal_id, v FROM mg JOIN pk USING (signal_id) WHERE NOT (abs(k - b) <= 2 OR abs(k - 2 * b) <= 2 OR abs(k - 3 * b) <= 2 OR abs(k - 4 * b) <= 2 OR abs(k - 5 * b) <= 2)),
        fl AS (SELECT signal_id, list_sort(list(v))[count(*) // 2 + 1] AS nf FROM ot GROUP BY 1),
        hp AS (SELECT pk.signal_id, p, coalesce(nf, 0) AS nf, coalesce(sum(CASE WHEN v > 3 * coalesce(nf, 0) AND v > 0.001 * p THEN power(v - coalesce(nf, 0), 2) END), 0) AS hp FROM pk LEFT JOIN fl USING (signal_id) LEFT JOIN mg ON mg.signal_id = pk.signal_id AND mg.k IN (2 * b, 3 * b, 4 * b, 5 * b) GROUP BY 1, 2, 3)
        SELECT signal_id, CASE WHEN hp > 0 AND p > nf THEN sqrt(hp / power(p - nf, 2)) * 100 ELSE 0 END AS thd_percent FROM hp),
    m AS (SELECT lv.*, noise_floor_db, coalesce(dynamic_range_db, 0) AS dynamic_range_db, CASE WHEN v > 30000 THEN 'UltraHigh' WHEN v > 10000 THEN 'High' WHEN v > 256 THEN 'Standard' ELSE 'Low' END AS bit_depth_quality,
            CASE WHEN rms < 0.001 THEN 0 WHEN low > 0 AND peak > low THEN 20 * log10(peak / low) ELSE 60 END AS snr_db, aliasing_score, frequency_response_score, thd_percent
        FROM lv JOIN nf USING (signal_id) LEFT JOIN dr USING (signal_id) JOIN sn USING (signal_id) JOIN fq USING (signal_id) JOIN th USING (signal_id))"""


@query(f"""WITH {Q}, {METRICS}, {VERDICT}
    SELECT signal_id, n, round(dc_offset, 6) AS dc_offset, round(clipping_ratio, 6) AS clipping_ratio, round(noise_floor_db, 6) AS noise_floor_db, round(dynamic_range_db, 6) AS dynamic_range_db, dropout_count, bit_depth_quality,
        round(snr_db, 4) AS snr_db, round(thd_percent, 4) AS thd_percent, round(frequency_response_score, 6) AS frequency_response_score, round(aliasing_score, 6) AS aliasing_score, {VERDICT_COLUMNS.format(rate=float(DAILY_RATE))} FROM t""")
def quality_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, issues, score and confidence of the daily sums, from their samples."""
    found = quality.assess(tables.daily_samples(spark, sf_dir), DAILY_RATE)
    issues = F.array_join(F.transform("issues", lambda i: F.concat(i["issue_type"], F.lit(":"), i["severity"])), ",")
    exact = ("dc_offset", "clipping_ratio", "noise_floor_db", "dynamic_range_db", "dropout_count", "bit_depth_quality", "frequency_response_score", "aliasing_score")
    loose = [F.round(c, 4).alias(c) for c in ("snr_db", "thd_percent")]
    return rounded(found.select("signal_id", "n", *exact, *loose, issues.alias("issues"), F.size("recommendations").alias("n_recommendations"), "overall_score", "quality_confidence"))


@query(f"""WITH RECURSIVE {o.EM}, {_weighting_sql(8000)},
    a AS (SELECT signal_id, coalesce(avg(sq) FILTER (sq >= {loudness.GATE!r}), 1e-10) AS ms FROM y GROUP BY 1),
    g AS (SELECT y.signal_id, coalesce(avg(sq) FILTER (sq >= greatest(ms / 10, {loudness.GATE!r})), max(ms)) AS ms FROM y JOIN a ON a.signal_id = y.signal_id GROUP BY 1),
    u AS (SELECT signal_id, -0.691 + 10 * log10(ms) AS lufs FROM g), l AS (SELECT signal_id, count(*) AS n, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM ev GROUP BY 1),
    d AS (SELECT *, CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE -70 END AS peak_db, CASE WHEN rms > 0 THEN 20 * log10(rms) ELSE -70 END AS rms_db FROM l)
    SELECT signal_id, n, round(peak, 4) AS peak, round(rms, 4) AS rms, round(peak_db, 4) AS true_peak_dbfs, round(peak_db - rms_db, 4) AS dynamic_range, round(coalesce(peak / nullif(rms, 0), 0), 4) AS crest_factor,
        round(lufs, 4) AS loudness_lufs, CAST(0 AS DOUBLE) AS loudness_range, round(least(greatest((lufs + 60) / 55, 0), 1), 4) AS energy_level FROM d JOIN u USING (signal_id)""")
def perceptual_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and weighted loudness of the vectors at a nominal 8 kHz; they are too short for a range."""
    return rounded(loudness.perceptual(samples(spark, sf_dir).select("signal_id", "pos", "x"), 8000), 4)


#: Frames of 64 daily sums at half overlap, at a nominal 2 kHz.
TRACK, TRACK_HOP, TRACK_RATE = 64, 32, 2000


@query(f"""WITH {o.DAILY.replace("price / 1e6 AS x", "price / 1e6 * 0.8 + (1 - (row_number() OVER (PARTITION BY signal_id ORDER BY d) - 1) // 400 % 2) * sin((row_number() OVER (PARTITION BY signal_id ORDER BY d) - 1) / 9.0 * 2 * pi()) AS x")}, {o.frames(TRACK, TRACK_HOP, "ev").replace(", crossed", "")},
    df AS (SELECT a.signal_id, a.f, CAST(b.off - a.off AS INTEGER) AS tau, sum(power(a.x - b.x, 2)) AS d FROM fr a JOIN fr b ON a.signal_id = b.signal_id AND a.f = b.f AND b.off - a.off BETWEEN 1 AND 31 GROUP BY 1, 2, 3),
    nm AS (SELECT signal_id, f, tau, d * tau / sum(d) OVER (PARTITION BY signal_id, f ORDER BY tau) AS y FROM df UNION ALL SELECT DISTINCT signal_id, f, 0, 1.0 FROM df),
    t0 AS (SELECT signal_id, f, min(tau) AS t0 FROM nm WHERE tau >= 2 AND y < 0.5 GROUP BY 1, 2),
    r AS (SELECT n.signal_id, n.f, min(n.tau) AS tau FROM (SELECT *, lead(y) OVER (PARTITION BY signal_id, f ORDER BY tau) AS nx FROM nm) n JOIN t0 USING (signal_id, f) WHERE tau >= t0 AND (nx IS NULL OR nx >= y) GROUP BY 1, 2),
    v AS (SELECT r.signal_id, r.f, r.tau, b.y AS y1, a.y AS y0, c.y AS y2 FROM r JOIN nm b USING (signal_id, f, tau) LEFT JOIN nm a ON a.signal_id = r.signal_id AND a.f = r.f AND a.tau = r.tau - 1 LEFT JOIN nm c ON c.signal_id = r.signal_id AND c.f = r.f AND c.tau = r.tau + 1),
    p AS (SELECT signal_id, f, y1, CASE WHEN y2 IS NULL OR abs((y2 - 2 * y1 + y0) / 2) < 1.1920929e-07 THEN tau ELSE greatest(tau - (y2 - y0) / 2 / (y2 - 2 * y1 + y0), 0) END AS t FROM v WHERE tau BETWEEN 1 AND 40),
    g AS (SELECT fr.signal_id, fr.f, avg(abs(x)) AS amplitude, any_value(n) AS n FROM fr JOIN n USING (signal_id) GROUP BY 1, 2),
    s AS (SELECT g.*, greatest(1 - y1, 0) AS clear, CASE WHEN power(greatest(1 - y1, 0), 2) > 0.5 THEN {TRACK_RATE} / t END AS hz FROM g LEFT JOIN p USING (signal_id, f) WHERE g.f * {TRACK_HOP} + {TRACK} <= n - 1)
    SELECT signal_id, CAST(f AS BIGINT) AS frame_idx, round(f * {TRACK_HOP} / {TRACK_RATE}.0, 6) AS "time", round(hz, 6) AS frequency, round(coalesce(power(clear, 2), 0), 6) AS confidence, round(coalesce(clear, 0), 6) AS clarity, round(amplitude, 6) AS amplitude,
        {_NOTES}[CAST(round(69 + 12 * log2(hz / 440)) AS INTEGER) % 12 + 1] || CAST(CAST(round(69 + 12 * log2(hz / 440)) AS INTEGER) // 12 - 1 AS VARCHAR) AS note_name FROM s""")
def pitch_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitches of the daily sums, with a cycle of nine days in every other stretch, frame by frame; the frame that ends with the signal is left out, unsure ones have no frequency."""
    cycle = F.sin(F.col("pos") / 9.0 * 2 * math.pi) * (1 - F.floor(F.col("pos") / 400) % 2)
    found = pitch.track(tables.daily_samples(spark, sf_dir).withColumn("x", F.col("x") * 0.8 + cycle), TRACK_RATE, pitch.yin(0.5), TRACK, TRACK_HOP)
    return rounded(found.select("signal_id", "frame_idx", "time", "frequency", "confidence", "clarity", "amplitude", "note_name"))


#: Half seconds of 200 daily sums at a nominal 400 Hz, frames of 16 with bins of 25 Hz.
CHORD_RATE, CHORD_SIZE, CHORD_HOP = 400, 16, 8
BIN = f"k * {CHORD_RATE} / {CHORD_SIZE}"


@query(f"""WITH {o.DAILY}, {o.N}, ws AS (SELECT signal_id, unnest(range(0, (n - 200) // 100 + 1)) AS w FROM n WHERE n >= 200),
    wx AS (SELECT ws.signal_id, w, pos - w * 100 AS p, x FROM ws JOIN ev ON ev.signal_id = ws.signal_id AND pos >= w * 100 AND pos < w * 100 + 200),
    fr AS (SELECT signal_id, w, f, p - f * {CHORD_HOP} AS off, x FROM wx, range(0, {(200 - CHORD_SIZE) // CHORD_HOP + 1}) AS r(f) WHERE p >= f * {CHORD_HOP} AND p < f * {CHORD_HOP} + {CHORD_SIZE}),
    {o.dft(CHORD_SIZE, "signal_id, w, f")},
    cs AS (SELECT signal_id, w, ((CAST(round(69 + 12 * log2({BIN} / 440)) AS INTEGER) % 12) + 12) % 12 AS pc, sum(mag) AS v FROM st WHERE mag > 0.001 AND {BIN} > 80 AND {BIN} < 4000 GROUP BY 1, 2, 3),
    ch AS (SELECT signal_id, w, pc, v / sum(v) OVER (PARTITION BY signal_id, w) AS v FROM cs),
    t(suffix, i) AS (VALUES ('', 0), ('', 4), ('', 7), ('m', 0), ('m', 3), ('m', 7)),
    sc AS (SELECT signal_id, w, CAST(r AS INTEGER) AS root, suffix, sum(v) AS score FROM ch, range(0, 12) AS q(r) JOIN t ON i = (pc - r + 12) % 12 GROUP BY 1, 2, 3, 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY signal_id, w ORDER BY round(score, 9) DESC, root, suffix) AS place FROM sc)
    SELECT signal_id, CAST(w AS BIGINT) AS "window", round(w * 100 / {CHORD_RATE}.0, 6) AS start_time, CAST(0.5 AS DOUBLE) AS duration, {_NOTES}[root + 1] || suffix AS chord, round(score, 6) AS confidence FROM b WHERE place = 1 AND score > 0""")
def chord_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of half seconds at half overlap."""
    out = musical.chord_progression(tables.daily_samples(spark, sf_dir), CHORD_RATE, CHORD_SIZE, CHORD_HOP)
    return rounded(out.select("signal_id", F.col("window").cast("long").alias("window"), "start_time", "duration", "chord", "confidence"))


@query(f"""WITH {FLUX}, s AS (SELECT signal_id, f AS pos, l2 AS x FROM fx WHERE f > 0), w AS (SELECT *, max(x) OVER (PARTITION BY signal_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS most,
        count(*) OVER (PARTITION BY signal_id) AS n, sum(x) OVER (PARTITION BY signal_id) AS total, row_number() OVER (PARTITION BY signal_id ORDER BY pos) AS i FROM s),
    mn AS (SELECT *, (total - x + CASE WHEN i = 1 THEN x ELSE 0 END + CASE WHEN i = n THEN x ELSE 0 END) / (n - 1 + CASE WHEN i = 1 THEN 1 ELSE 0 END + CASE WHEN i = n THEN 1 ELSE 0 END) AS mean FROM w),
    tm AS (SELECT signal_id, (pos - 1) * {HOP} / {RATE}.0 AS t FROM mn WHERE x >= most AND x > mean + 0.3),
    h AS (SELECT signal_id, CAST(round(gap / 0.01) AS BIGINT) AS b, count(*) AS votes FROM (SELECT *, t - lag(t) OVER (PARTITION BY signal_id ORDER BY t) AS gap FROM tm) WHERE gap IS NOT NULL GROUP BY 1, 2),
    tp AS (SELECT signal_id, 60 / (b * 0.01) AS tempo FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY votes DESC, b) AS r FROM h WHERE b BETWEEN 31 AND 100) WHERE r = 1),
    l AS (SELECT signal_id, count(*) AS n, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM ev GROUP BY 1), c AS (SELECT signal_id, count(*) AS onsets, max(t) AS last FROM tm GROUP BY 1)
    SELECT l.signal_id, round(n / {RATE}.0, 6) AS duration, {RATE} AS sample_rate, round(peak, 6) AS peak_amplitude, round(rms, 6) AS rms_level,
        round(CASE WHEN rms > 0 THEN 20 * log10(peak) - 20 * log10(rms) ELSE 0 END, 6) + 0.0 AS dynamic_range, CAST(coalesce(onsets, 0) AS INTEGER) AS onsets, round(last, 6) AS last_onset, round(tempo, 6) AS tempo,
        round(coalesce(onsets, 0) / (n / {RATE}.0), 6) AS rhythmic_complexity FROM l LEFT JOIN c ON c.signal_id = l.signal_id LEFT JOIN tp ON tp.signal_id = l.signal_id""")
def analysis_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's quick profile over the vectors: levels, onsets, tempo."""
    found = report.analyze(samples(spark, sf_dir).select("signal_id", "pos", "x"), RATE, "quick", report.Settings(SIZE, HOP))
    onsets = F.col("temporal.onsets")
    return rounded(found.select("signal_id", "summary.*", F.size(onsets).alias("onsets"), F.array_max(onsets).alias("last_onset"), "temporal.tempo", "temporal.rhythmic_complexity"))


@query(f"""WITH a AS (SELECT vec_id AS signal_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS xs, vec_id % 80 AS start FROM embeddings), p AS (SELECT *, CASE WHEN len(xs) > start THEN xs[start + 1:start + 20] ELSE xs END AS page FROM a)
    SELECT signal_id, CAST(len(page) AS INTEGER) AS n, round(list_sum(page), 5) AS total, CASE WHEN len(xs) > start + 20 THEN CAST(start + 20 AS VARCHAR) END AS next FROM p""")
def array_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of twenty of the vectors' samples, each from a place of its own, and where the next one begins."""
    start = (F.col("signal_id") % 80).cast("int")
    parts = vectors(spark, sf_dir).select("signal_id", sinks.page(F.col("samples"), start, 20).alias("page"), sinks.next_cursor(F.col("samples"), start, 20).alias("next"))
    total = F.aggregate("page", F.lit(0.0), lambda s, x: s + x)
    return parts.select("signal_id", F.size("page").alias("n"), F.round(total, 5).alias("total"), "next")


@query("""SELECT user_id, event_id, sha256(concat_ws(chr(31), 'events/' || user_id || '.wav', strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(event_id AS VARCHAR), '[(''profile'', ''quick''), (''size'', 16)]')) AS cache_key,
        sha256(concat_ws(chr(31), 'events/' || user_id || '.wav', CAST(event_id AS VARCHAR), '[]')) AS bare_key FROM events""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of files with a time and parameters, and of files whose time isn't known."""
    rows = tables.table(spark, sf_dir, "events")
    path = F.concat(F.lit("events/"), F.col("user_id").cast("string"), F.lit(".wav"))
    when, none = F.date_trunc("second", "ts").cast("timestamp"), F.lit(None).cast("timestamp")
    return rows.select("user_id", "event_id", results.cache_key(path, when, F.col("event_id"), size=16, profile="quick").alias("cache_key"), results.cache_key(path, none, F.col("event_id")).alias("bare_key"))


@query(f"""WITH RECURSIVE {MATCHED}, o AS (SELECT a, b, tb - ta AS offs FROM rk JOIN ls USING (a, b) WHERE list_contains(rs, r))
    SELECT a AS id_a, b AS id_b, count(*) AS n_segments, round({o.percentile("offs", 50)}, 6) + 0.0 AS time_offset FROM o GROUP BY 1, 2""")
def fp_time_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a vector's matched segments lie in the next of its label: the upper median of their distances."""
    found = matching.matched_segments(matching.segment_candidates(pairs(spark, sf_dir), prints(spark, sf_dir).subs))
    return rounded(matching.time_offset(found))
