"""Operators over the users' events: level, frame, onset, loudness, quality and segment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import classify, layout, loudness, quality, segments, temporal
from ..sources import tables
from . import oracle as o
from .registry import query, rounded

#: Nominal rates: what the events count as a second where seconds matter.
RATE = 16


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_crossings(tables.event_samples(spark, sf_dir))


@query("""
    SELECT user_id AS signal_id, count(*) AS n, round(max(abs(value)), 6) AS peak, round(sqrt(avg(value * value)), 6) AS rms,
        round(CASE WHEN max(abs(value)) > 0 AND avg(value * value) > 0 THEN 20 * log10(max(abs(value)) / sqrt(avg(value * value))) ELSE 0 END, 6) AS dynamic_range_db
    FROM events GROUP BY user_id""")
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, level and their distance in decibels: one aggregation."""
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), F.col("value").cast("double").alias("x"))
    out = loudness.levels(rows)
    level = F.coalesce(F.lit(20.0) * F.log10(scalar.ratio(F.col("peak"), F.col("rms"))), F.lit(0.0))
    return rounded(out.select("signal_id", "n", "peak", "rms", level.alias("dynamic_range_db")))


@query(f"""WITH {o.EV}, {o.CR} SELECT signal_id, count(*) AS n, CAST(sum(crossed) AS BIGINT) AS crossings, round(CASE WHEN count(*) > 1 THEN sum(crossed) / (count(*) - 1) ELSE 0 END, 6) AS zcr FROM cr GROUP BY 1""")
def zero_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crossed(spark, sf_dir).groupBy("signal_id").agg(F.count("*").alias("n"), F.sum("crossed").cast("long").alias("crossings"))
    return rounded(out.withColumn("zcr", F.when(F.col("n") > 1, F.col("crossings") / (F.col("n") - 1)).otherwise(F.lit(0.0))))


@query(f"""WITH {o.EV}, {o.CR}, {o.frames(16, 8)}
    SELECT signal_id, CAST(f AS BIGINT) AS frame_idx, round(sum(CASE WHEN off > 0 THEN crossed ELSE 0 END) / 16, 6) AS zcr, round(sqrt(sum(x * x) / 16), 6) AS rms FROM fr GROUP BY 1, 2""")
def frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.frame_stats(crossed(spark, sf_dir), 16, 8))


@query(f"""WITH {o.EV}, {o.CR}, {o.frames(16, 8)},
    s AS (SELECT signal_id, f, sum(CASE WHEN off > 0 THEN crossed ELSE 0 END) / 16 AS zcr, sqrt(sum(x * x) / 16) AS rms FROM fr GROUP BY 1, 2),
    m AS (SELECT signal_id, avg(rms) AS m FROM s GROUP BY 1)
    SELECT signal_id, round(avg(zcr), 6) AS zcr_mean, round(stddev_pop(zcr), 6) AS zcr_std, round(max(m), 6) AS energy_mean, round(stddev_pop(rms), 6) AS energy_std,
        round(avg(CASE WHEN rms < m * 0.5 THEN 1 ELSE 0 END), 6) AS low_energy_rate FROM s JOIN m USING (signal_id) GROUP BY 1""")
def low_energy_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.stat_features(classify.frame_stats(crossed(spark, sf_dir), 16, 8)))


@query(f"""WITH {o.EV}, c AS (SELECT signal_id, pos // 2 AS c, max(abs(x)) AS p FROM ev GROUP BY 1, 2), d AS (SELECT signal_id, CAST(sum(CASE WHEN p < 0.0001 THEN 1 ELSE 0 END) AS BIGINT) AS dropout_count FROM c GROUP BY 1),
    b AS (SELECT signal_id, count(DISTINCT round(x * 32768)) AS v FROM ev WHERE pos < 10000 GROUP BY 1)
    SELECT signal_id, count(*) AS n, round(avg(x), 6) AS dc_offset, round(avg(CASE WHEN abs(x) >= 0.99 THEN 1 ELSE 0 END), 6) AS clipping_ratio, dropout_count,
        CASE WHEN v > 30000 THEN 'UltraHigh' WHEN v > 10000 THEN 'High' WHEN v > 256 THEN 'Standard' ELSE 'Low' END AS bit_depth_quality
    FROM ev JOIN d USING (signal_id) JOIN b USING (signal_id) GROUP BY signal_id, dropout_count, v""")
def dc_clip_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.event_samples(spark, sf_dir)
    base = samples.groupBy("signal_id").agg(F.count("*").alias("n"), F.avg("x").alias("dc_offset"), F.avg(F.when(F.abs("x") >= quality.CLIP, 1.0).otherwise(0.0)).alias("clipping_ratio"))
    return rounded(base.join(quality.dropouts(samples, 2000), "signal_id").join(quality.bit_depth(samples), "signal_id"))


@query(f"""WITH {o.EV}, c AS (SELECT signal_id, pos // 4 AS c, sqrt(avg(x * x)) AS rms FROM ev GROUP BY 1, 2 HAVING sqrt(avg(x * x)) > 0)
    SELECT signal_id, round(CASE WHEN count(*) > 1 THEN 20 * log10({o.percentile("rms", 95)} / {o.percentile("rms", 10)}) ELSE 0 END, 6) AS dynamic_range_db FROM c GROUP BY 1""")
def dynamic_range_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.dynamic_range(tables.event_samples(spark, sf_dir), 10))


@query(f"""WITH {o.EV}, c AS (SELECT signal_id, pos // 4 AS c, sqrt(avg(x * x)) AS rms FROM ev GROUP BY 1, 2)
    SELECT signal_id, round(coalesce(20 * log10(min(CASE WHEN rms > 0 THEN rms END)), -60), 6) AS noise_floor_db FROM c GROUP BY 1""")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.noise_floor(tables.event_samples(spark, sf_dir), 40))


@query(f"""WITH {o.EV}, f AS (SELECT *, abs(x) >= 0.99 AS clip FROM ev),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY signal_id ORDER BY pos) AS isle FROM f WHERE clip),
    r AS (SELECT signal_id, min(pos) AS s, max(pos) + 1 AS e FROM g GROUP BY signal_id, isle),
    k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY s) AS region FROM r)
    SELECT signal_id, region, round(s / {RATE}, 6) AS "start", round(e / {RATE}, 6) AS "end" FROM k WHERE region <= 10""")
def clip_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clip_regions(tables.event_samples(spark, sf_dir), RATE)
    return rounded(out.withColumn("region", F.col("region").cast("long")))


PEAKS = f"""{o.EV}, w AS (SELECT *, max(x) OVER (PARTITION BY signal_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS most,
        sum(x) OVER a AS bs, count(x) OVER a AS bn, sum(x) OVER b AS fs, count(x) OVER b AS fn FROM ev
        WINDOW a AS (PARTITION BY signal_id ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY signal_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)),
    e AS (SELECT *, CASE WHEN bn = 0 THEN x ELSE bs END AS s1, greatest(bn, 1) AS n1, CASE WHEN fn = 0 THEN x ELSE fs END AS s2, greatest(fn, 1) AS n2 FROM w),
    pk AS (SELECT signal_id, pos, x FROM e WHERE x >= most AND x > (s1 + s2) / (n1 + n2) + 0.3)"""


@query(f"WITH {PEAKS} SELECT signal_id, CAST(pos AS BIGINT) AS pos, round(x, 6) AS x FROM pk")
def onset_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.peak_pick(tables.event_samples(spark, sf_dir)))


DAYS = "tm AS (SELECT user_id AS signal_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS t FROM events)"
TEMPO = f"""{DAYS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY signal_id ORDER BY t) AS gap FROM tm),
    h AS (SELECT signal_id, CAST(round(gap / 0.01) AS BIGINT) AS b, count(*) AS votes FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
    tp AS (SELECT signal_id, b, votes, 60 / (b * 0.01) AS tempo FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY votes DESC, b) AS r FROM h WHERE b BETWEEN 31 AND 100) WHERE r = 1)"""


@query(f"WITH {TEMPO} SELECT signal_id, b AS interval_bin, votes, round(tempo, 6) AS tempo FROM tp")
def tempo_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.tempo(tables.event_times(spark, sf_dir)))


@query(f"""WITH {TEMPO}, p AS (SELECT signal_id, 60 / tempo AS period FROM tp), l AS (SELECT signal_id, max(t) AS last FROM tm GROUP BY 1),
    c AS (SELECT * FROM (SELECT signal_id, t AS phase, row_number() OVER (PARTITION BY signal_id ORDER BY t) AS turn FROM tm) WHERE turn <= 10),
    gr AS (SELECT signal_id, turn, phase, period, last, phase + k * period AS pt FROM c JOIN p USING (signal_id) JOIN l USING (signal_id), range(0, 120) AS r(k) WHERE phase + k * period < last),
    s AS (SELECT gr.signal_id, turn, phase, period, last, sum(1 / (1 + abs(t - pt))) AS score FROM gr JOIN tm ON tm.signal_id = gr.signal_id AND abs(t - pt) < 0.2 * period GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round(score, 9) DESC, turn) AS r FROM s)
    SELECT signal_id, round(phase, 6) AS phase, round(period, 6) AS period, round(score, 6) AS score, CAST(floor((last - phase) / period + 1e-9) + 1 AS BIGINT) AS n_beats FROM b WHERE r = 1""")
def beat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = tables.event_times(spark, sf_dir)
    return rounded(temporal.beats(times, temporal.tempo(times)).select("signal_id", "phase", "period", "score", "n_beats"))


@query(f"""WITH {TEMPO}, p AS (SELECT signal_id, 60 / tempo AS period FROM tp), l AS (SELECT signal_id, max(t) AS last, min(t) AS first FROM tm GROUP BY 1)
    SELECT signal_id, CASE WHEN first + 2 * period <= last THEN CAST(1 AS DOUBLE) ELSE NULL END AS regular FROM p JOIN l USING (signal_id)""")
def beat_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats lie on an exact grid, so wherever there are three the stability is 1 (to six decimals)."""
    times = tables.event_times(spark, sf_dir)
    grid = temporal.beats(times, temporal.tempo(times))
    first = times.groupBy("signal_id").agg(F.min("t").alias("first"))
    steady = temporal.stability(grid).join(grid, "signal_id").join(first, "signal_id")
    many = F.col("first") + F.col("period") * 2 <= F.col("last")
    return rounded(steady.select("signal_id", F.when(many, F.greatest("tempo_stability", F.when(F.col("n_beats") < 3, F.lit(1.0)))).alias("regular")))


@query(f"""WITH {o.EV}, q AS (SELECT signal_id, x * x AS sq FROM ev), k AS (SELECT power(10, (-70 + 0.691) / 10) AS g),
    a AS (SELECT signal_id, coalesce(avg(CASE WHEN sq >= g THEN sq END), 1e-10) AS ms FROM q, k GROUP BY 1),
    b AS (SELECT q.signal_id, ms, avg(CASE WHEN sq >= greatest(ms / 10, g) THEN sq END) AS r FROM q JOIN a USING (signal_id), k GROUP BY 1, 2)
    SELECT signal_id, round(-0.691 + 10 * log10(coalesce(r, ms)), 6) AS lufs FROM b""")
def loudness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass gating of the unweighted power."""
    return rounded(loudness.integrated(tables.event_samples(spark, sf_dir)))


def _hops(size: int, hop: int) -> str:
    return f"""{o.EV}, {o.N}, hs AS (SELECT signal_id, unnest(range(0, (n - {size}) // {hop} + 1)) AS w FROM n WHERE n >= {size}),
        hw AS (SELECT hs.signal_id, w, avg(x * x) AS ms FROM hs JOIN ev ON ev.signal_id = hs.signal_id AND pos >= w * {hop} AND pos < w * {hop} + {size} GROUP BY 1, 2)"""


@query(f"""WITH {_hops(8, 2)} SELECT signal_id, CAST(w AS BIGINT) AS "window", round(CASE WHEN ms > 1e-10 THEN -0.691 + 10 * log10(ms) ELSE -70 END, 6) AS lufs FROM hw""")
def momentary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(loudness.momentary(tables.event_samples(spark, sf_dir), 20))


@query(f"""WITH {_hops(30, 1)}, v AS (SELECT signal_id, -0.691 + 10 * log10(ms) AS l FROM hw WHERE ms >= power(10, (-70 + 0.691) / 10))
    SELECT signal_id, count(*) AS n, round(CASE WHEN count(*) > 1 THEN {o.percentile("l", 95)} - {o.percentile("l", 10)} ELSE 0 END, 6) AS loudness_range FROM v GROUP BY 1""")
def loudness_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(loudness.loudness_range(loudness.short_term(tables.event_samples(spark, sf_dir), 10)))


@query(f"""WITH {o.EV}, {o.CR}, {o.frames(40, 20)}, pr AS (SELECT a.signal_id, a.f, b.off - a.off AS lag, 2 * sum(a.x * b.x) / nullif(sum(a.x * a.x + b.x * b.x), 0) AS c
        FROM fr a JOIN fr b ON a.signal_id = b.signal_id AND a.f = b.f AND b.off - a.off BETWEEN 2 AND 19 GROUP BY 1, 2, 3),
    m AS (SELECT signal_id, f, greatest(max(c), 0) AS c FROM pr GROUP BY 1, 2) SELECT signal_id, round(avg(c), 6) AS hnr FROM m GROUP BY 1""")
def harmonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.harmonicity(tables.event_samples(spark, sf_dir), 1000))


# -- segments -----------------------------------------------------------------------------------


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(crossed(spark, sf_dir), RATE, 8, 4)


@query(f"""WITH {o.SEGMENTS} SELECT signal_id, CAST(segment AS BIGINT) AS segment, round(start_time, 6) AS start_time, round(duration, 6) AS duration, round(energy, 6) AS energy,
    round(spectral_centroid, 6) AS spectral_centroid, round(zcr, 6) AS zcr, round(dynamic_range, 6) AS dynamic_range FROM seg""")
def segments_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = segments.segment_samples(crossed(spark, sf_dir), RATE)
    return rounded(segments.segment_features(dealt, RATE, 8, 4))


@query(f"WITH {o.SEGMENTS} SELECT signal_id, CAST(segment AS BIGINT) AS segment, content_type, label FROM seg")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_rows(spark, sf_dir).select("signal_id", "segment", "content_type", "label")


@query(f"""WITH {o.SEGMENTS} SELECT signal_id, CAST(segment AS BIGINT) AS segment, round(speech, 6) AS speech, round(music, 6) AS music, round(silence, 6) AS silence, content_type, round(low, 6) AS low_energy_rate,
    round(ro, 6) AS rolloff, round(cv, 6) AS centroid_variance, round(fl, 6) AS flux FROM kd""")
def content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = segments.segment_samples(crossed(spark, sf_dir), RATE)
    out = classify.scores(classify.features(dealt, RATE, 8, 4, segments.SEG, "off"))
    return rounded(out.select("signal_id", "segment", "speech", "music", "silence", "content_type", "low_energy_rate", F.col("spectral_rolloff_mean").alias("rolloff"), F.col("spectral_centroid_variance").alias("centroid_variance"), F.col("spectral_flux_mean").alias("flux")))


@query(f"""WITH {o.SEGMENTS}, {o.SEG_LAG}, m AS (SELECT *, sum(CASE WHEN label <> l0 OR abs(energy - e0) > 0.3 OR abs(spectral_centroid - c0) > 1000 OR content_type <> k0 THEN 1 ELSE 0 END) OVER (PARTITION BY signal_id ORDER BY segment) AS run FROM lagged),
    r AS (SELECT signal_id, run, min(label) AS label, min(start_time) AS start_time, max(start_time + duration) AS end_time, min(segment) AS first_segment, count(*) AS n_segments, avg(energy) AS avg_energy, avg(spectral_centroid) AS avg_brightness, avg(dynamic_range) AS dynamic_variation FROM m GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY run) AS section, CASE WHEN label IN ('Verse', 'Chorus', 'Break') THEN label ELSE 'Undefined' END AS section_type, round(start_time, 6) AS start_time,
        round(max_end, 6) AS end_time, CAST(first_segment AS BIGINT) AS first_segment, n_segments, round(avg_energy, 6) AS avg_energy, round(avg_brightness, 6) AS avg_brightness, round(dynamic_variation, 6) AS dynamic_variation
    FROM (SELECT r.*, (SELECT arg_max(m.start_time + m.duration, m.segment) FROM m WHERE m.signal_id = r.signal_id AND m.run = r.run) AS max_end FROM r)""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.sections(segment_rows(spark, sf_dir)).drop("avg_roughness", "rhythmic_density", "harmonic_stability", "confidence")
    return rounded(out.withColumn("section", F.col("section").cast("long")))


@query(f"""WITH {o.SEGMENTS}, {o.SEG_LAG}, d AS (SELECT *, abs(energy - e0) AS de, abs(spectral_centroid - c0) / 5000 AS ds, content_type <> k0 AS dk FROM lagged WHERE e0 IS NOT NULL)
    SELECT signal_id, CAST(segment AS BIGINT) AS to_segment, round(start_time, 6) AS "time", CASE WHEN dk THEN 'Abrupt' WHEN de > 0.5 AND energy > e0 THEN 'BuildUp' WHEN de > 0.5 THEN 'DropOut' ELSE 'Smooth' END AS transition_type,
        round(least(de + ds, 1), 6) AS strength, CAST(0.1 AS DOUBLE) AS duration FROM d WHERE de > 0.3 OR ds > 0.3 OR dk""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.transitions(segment_rows(spark, sf_dir)))


@query(f"""WITH {o.SEGMENTS}, {o.SEG_LAG} SELECT signal_id, CAST(segment AS BIGINT) AS segment, round(start_time, 6) AS "time", round(least(abs(energy - e0) + abs(spectral_centroid - c0) / 10000, 1), 6) AS tension,
    CASE WHEN energy - e0 > 0.2 THEN 'BuildUp' WHEN energy - e0 < -0.2 THEN 'Release' ELSE 'Plateau' END AS change_type FROM lagged WHERE e0 IS NOT NULL""")
def tension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.tension(segment_rows(spark, sf_dir)))


EXTREMES = """ar AS (SELECT *, lag(energy) OVER w AS a, lead(energy) OVER w AS b FROM seg WINDOW w AS (PARTITION BY signal_id ORDER BY segment)),
    ex AS (SELECT signal_id, segment, start_time AS "time", energy, CASE WHEN energy > a AND energy > b THEN 'peak' WHEN energy < a AND energy < b THEN 'valley' END AS kind FROM ar)"""


@query(f"""WITH {o.SEGMENTS}, {EXTREMES} SELECT signal_id, CAST(segment AS BIGINT) AS segment, round("time", 6) AS "time", round(energy, 6) AS energy, kind FROM ex WHERE kind IS NOT NULL""")
def energy_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.energy_extremes(segment_rows(spark, sf_dir)))


PROFILE = """nu AS (SELECT signal_id, energy, row_number() OVER (PARTITION BY signal_id ORDER BY segment) - 1 AS i, count(*) OVER (PARTITION BY signal_id) AS n FROM seg),
    pf AS (SELECT signal_id, max(n) AS n, avg(energy) AS average, var_pop(energy) AS variance, avg(CASE WHEN i >= n * 2 // 3 THEN energy END) - avg(CASE WHEN i < n // 3 THEN energy END) AS d FROM nu GROUP BY 1)"""


@query(f"""WITH {o.SEGMENTS}, {PROFILE} SELECT signal_id, n AS n_segments, round(average, 6) AS average, round(variance, 6) AS variance,
    CASE WHEN n < 3 OR abs(d) < 0.1 THEN 'Flat' WHEN d > 0.2 THEN 'Increasing' WHEN d < -0.2 THEN 'Decreasing' ELSE 'Complex' END AS shape FROM pf""")
def energy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.energy_profile(segment_rows(spark, sf_dir)))


@query(f"""WITH {o.SEGMENTS}, {EXTREMES}, g AS (SELECT signal_id, "time", "time" - lag("time") OVER (PARTITION BY signal_id ORDER BY "time") AS gap FROM ex WHERE kind = 'peak'),
    p AS (SELECT signal_id, min("time") AS first, count(*) AS c FROM g GROUP BY 1 HAVING count(*) > 2), m AS (SELECT signal_id, {o.percentile("gap", 50)} AS period FROM g WHERE gap IS NOT NULL GROUP BY 1)
    SELECT signal_id, round(period, 6) AS period, round(first % period, 6) AS phase, CAST(0.7 AS DOUBLE) AS strength FROM p JOIN m USING (signal_id)""")
def periodic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.periodic_events(segment_rows(spark, sf_dir)))


REPEATS = """nn AS (SELECT *, count(*) OVER (PARTITION BY signal_id) AS n FROM seg),
    st2 AS (SELECT a.signal_id, w AS length, a.segment AS i, b.segment AS j, a.start_time AS start_a, b.start_time AS start_b FROM nn a JOIN nn b ON a.signal_id = b.signal_id, range(2, 9) AS r(w) WHERE a.n >= 2 * w AND b.segment >= a.segment + w AND b.segment < a.n - w),
    rp AS (SELECT s.signal_id, length, i, j, start_a, start_b, avg((1 - abs(p.energy - q.energy) + 1 - least(abs(p.spectral_centroid - q.spectral_centroid) / 10000, 1) + CASE WHEN p.label = q.label THEN 1 ELSE 0 END) / 3) AS similarity
        FROM st2 s, range(0, 8) AS r(d) JOIN seg p ON p.signal_id = s.signal_id AND p.segment = s.i + d JOIN seg q ON q.signal_id = s.signal_id AND q.segment = s.j + d WHERE d < length GROUP BY ALL)"""


@query(f"""WITH {o.SEGMENTS}, {REPEATS} SELECT signal_id, CAST(length AS INTEGER) AS length, round(start_a, 6) AS start_a, round(start_b, 6) AS start_b, round(similarity, 6) AS similarity FROM rp WHERE similarity > 0.7""")
def repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.repetitions(segment_rows(spark, sf_dir)))


@query(f"""WITH {o.SEGMENTS}, {o.SEG_LAG} SELECT signal_id, round(coalesce(avg((1 - abs(energy - e0) + 1 - least(abs(spectral_centroid - c0) / 10000, 1) + 1 - least(abs(zcr - z0), 1)) / 3), 1), 6) AS coherence_score FROM lagged GROUP BY 1""")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.coherence(segment_rows(spark, sf_dir)))


@query(f"""WITH {o.SEGMENTS}, {PROFILE}, {REPEATS}, c AS (SELECT signal_id, count(*) AS r FROM rp WHERE similarity > 0.7 GROUP BY 1), l AS (SELECT signal_id, count(DISTINCT label) AS labels FROM seg GROUP BY 1)
    SELECT signal_id, round(least(greatest((labels / n + variance + (n - 1) / n + 1 - least(coalesce(r, 0) / 10, 1)) / 4, 0), 1), 6) AS temporal_complexity FROM pf JOIN l USING (signal_id) LEFT JOIN c USING (signal_id)""")
def temporal_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment_rows(spark, sf_dir)
    return rounded(segments.complexity(rows, segments.energy_profile(rows), segments.repetitions(rows)))


@query(f"""WITH {o.EV}, {o.N}, c AS (SELECT signal_id, pos // greatest(n // 12, 1) AS c, x FROM ev JOIN n USING (signal_id))
    SELECT signal_id, CAST(c AS BIGINT) AS "column", round(greatest(max(x), 0), 6) AS high, round(least(min(x), 0), 6) AS low, round(sqrt(avg(x * x)), 6) AS rms FROM c GROUP BY 1, 2""")
def waveform_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import render

    return rounded(render.envelope(tables.event_samples(spark, sf_dir), 12))


@query(f"""WITH {o.EV}, p AS (SELECT signal_id, count(*) AS n, max(abs(x)) AS k FROM ev GROUP BY 1)
    SELECT signal_id, n, round(CASE WHEN k > 0 THEN k * 1.1 ELSE 1 END, 6) AS top, CAST(pos AS BIGINT) AS "at", round(x, 6) AS x FROM ev JOIN p USING (signal_id) WHERE pos % greatest(n // 20, 1) = 0""")
def waveform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import render

    return rounded(render.waveform_points(tables.event_samples(spark, sf_dir), 10))


@query("""WITH e AS (SELECT user_id, event_id, ts, CAST(value AS DOUBLE) AS v FROM events), c AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS accessed_at, CAST(1000 + event_id % 500 AS BIGINT) AS size_bytes FROM e),
    r AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY accessed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM c)
    SELECT CAST(event_id AS VARCHAR) AS cache_key, size_bytes FROM r WHERE upto < 1000000""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken as cache entries: those that free a megabyte, least recently used first."""
    from ..sources import results

    rows = tables.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("cache_key"), F.col("ts").alias("created_at"), F.col("ts").alias("accessed_at"), (1000 + F.col("event_id") % 500).cast("long").alias("size_bytes"), F.lit("").alias("result"))
    return results.least_recent(rows, 1_000_000).select("cache_key", "size_bytes")
