"""Files, cache, colours, windows, weighting, verdicts and comparisons as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, scalar
from ..operators import classify, layout, loudness, quality, report, spectral
from ..sources import file_rows, results, stage, synthetic, tables, wav
from . import oracle as o
from .event_queries import RATE, crossed
from .registry import query, rounded
from .spectral_queries import samples, vectors

ENDINGS = ("wav", "mp3", "FLAC", "ogg", "aac", "txt", "WAVE", "oga", "m4a")
ENDING = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "]"


@query(f"""
    WITH p AS (SELECT page_id, lower({ENDING}[page_id % {len(ENDINGS)} + 1]) AS e FROM pages),
    f AS (SELECT page_id, CASE WHEN e IN ('wav', 'wave') THEN 'Wav' WHEN e = 'mp3' THEN 'Mp3' WHEN e = 'flac' THEN 'Flac' WHEN e IN ('ogg', 'oga') THEN 'Ogg' WHEN e IN ('m4a', 'aac') THEN 'M4a' ELSE 'Unknown' END AS format FROM p)
    SELECT page_id, format, format <> 'Unknown' AS supported FROM f""")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format that a path's ending names, whatever its case."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/a.b/file"), F.col("page_id").cast("string"), F.lit("."), ending).alias("path"))
    found = rows.select("page_id", scalar.audio_format("path").alias("format"))
    return found.withColumn("supported", F.col("format") != "Unknown")


def wav_files(spark: SparkSession, sf_dir: str, channels: int) -> DataFrame:
    """The vectors as WAV files, decoded again."""
    files = wav.to_wav(vectors(spark, sf_dir), 8000, channels)
    return wav.decode_rows(files.select(F.col("signal_id").cast("string").alias("path"), F.lit("Wav").alias("format"), "content"))


V = "v AS (SELECT vec_id AS signal_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS FLOAT) AS x FROM embeddings)"


@query(f"WITH {V} SELECT signal_id, 8000 AS sample_rate, 2 AS channels, i // 2 AS pos, round(sum(CAST(x AS DOUBLE)) / 2, 6) AS x FROM v GROUP BY signal_id, i // 2")
def wav_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo files decoded and mixed down."""
    audio = wav_files(spark, sf_dir, 2)
    out = wav.mono(audio).join(audio.select(F.col("path").alias("signal_id"), "channels"), "signal_id")
    return rounded(out.select(F.col("signal_id").cast("long").alias("signal_id"), "sample_rate", "channels", F.col("pos").cast("long").alias("pos"), "x"))


@query(f"WITH {V} SELECT signal_id, 8000 AS sample_rate, i // 2 AS pos, round(sum(CAST(x AS DOUBLE)) / 2, 6) AS x FROM v GROUP BY signal_id, i // 2")
def wav_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as stereo files, each read back in eight ranges of bytes and mixed down."""
    path = stage.new_path(spark, "wav")
    files = wav.to_wav(vectors(spark, sf_dir), 8000, 2)
    file_rows.write_files(files.select(F.concat(F.col("signal_id").cast("string"), F.lit(".wav")).alias("name"), "content"), path)
    one = wav.mono_blocks(file_rows.read_blocks(spark, path, 32, 8192))
    signal = F.regexp_extract("signal_id", r"([^/]*)\.wav$", 1).cast("long")
    out = stage.keep(rounded(one.select(signal.alias("signal_id"), "sample_rate", "pos", "x")))
    stage.drop(spark, path)
    return out


@query(f"WITH {V} SELECT signal_id, i // 4 AS pos, round(CAST(x AS DOUBLE), 6) AS x FROM v WHERE i % 4 = 2")
def wav_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of four channels."""
    one = wav.channel(wav_files(spark, sf_dir, 4), 2)
    return rounded(one.select(F.col("signal_id").cast("long").alias("signal_id"), F.posexplode("samples").alias("pos", "x")).select("signal_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x")))


def user_cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, object]:
    """(events, an entry a user as old as the user's last event, the time of the last event of all)."""
    events = tables.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = events.groupBy("user_id").agg(F.max("ts").alias("created_at"), F.count("*").alias("n"))
    cache = rows.select(results.simple_key(F.col("user_id").cast("string")).alias("cache_key"), "created_at", F.col("created_at").alias("accessed_at"), F.col("n").alias("size_bytes"), F.col("n").cast("string").alias("result"))
    return events, cache, F.lit(events.agg(F.max("ts")).first()[0])


@query("""
    WITH u AS (SELECT user_id, max(ts) AS created_at, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, sha256(CAST(user_id AS VARCHAR)) AS cache_key, created_at + INTERVAL 3 HOUR > (SELECT max(ts) FROM events) AS hit,
        CASE WHEN created_at + INTERVAL 3 HOUR > (SELECT max(ts) FROM events) THEN CAST(n AS VARCHAR) END AS result FROM u""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of every user against entries that live three hours."""
    events, cache, now = user_cache(spark, sf_dir)
    requests = events.select("user_id").distinct().withColumn("cache_key", results.simple_key(F.col("user_id").cast("string")))
    hits, misses = results.lookup(requests, cache, now, 3 * 3600)
    return hits.select("user_id", "cache_key", F.lit(True).alias("hit"), "result").unionByName(misses.select("user_id", "cache_key", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("result")))


@query("SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS entries, CAST(count(*) AS BIGINT) AS total_bytes FROM events")
def cache_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.stats(user_cache(spark, sf_dir)[1])


LIVES = 6 * 24 * 3600
#: Entries of the users' first ten days, as large as they had events, hits of the next ten, and further entries of the last.
REPLAY = f"""e AS (SELECT user_id, ts, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day FROM events),
    p AS (SELECT user_id, max(ts) AS created_at, count(*) AS size FROM e WHERE day < 10 GROUP BY 1),
    g AS (SELECT e.user_id, max(ts) AS hit_at FROM e JOIN p ON p.user_id = e.user_id AND created_at + INTERVAL {LIVES} SECOND > ts WHERE day >= 10 AND day < 20 GROUP BY 1),
    h AS (SELECT p.user_id, created_at, greatest(created_at, coalesce(hit_at, created_at)) AS accessed_at, size, sha256(CAST(p.user_id AS VARCHAR)) AS cache_key FROM p LEFT JOIN g ON g.user_id = p.user_id),
    n AS (SELECT user_id, max(ts) AS created_at, count(*) AS size FROM e WHERE day >= 20 GROUP BY 1),
    b AS (SELECT (SELECT CAST(sum(size) * 3 // 4 AS BIGINT) FROM p) AS most, (SELECT CAST(sum(size) AS BIGINT) FROM n WHERE user_id % 5 = 0) AS coming, (SELECT CAST(sum(size) AS BIGINT) FROM p) AS held),
    r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY accessed_at, cache_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM h),
    s AS (SELECT user_id, created_at, accessed_at, size FROM r, b WHERE upto >= held + coming - most)"""


@query(f"""WITH {REPLAY}, m AS (SELECT * FROM s WHERE user_id NOT IN (SELECT user_id FROM n WHERE user_id % 5 = 0)
        UNION ALL SELECT n.user_id, n.created_at, greatest(n.created_at, coalesce(g.hit_at, n.created_at)), n.size FROM n LEFT JOIN g ON g.user_id = n.user_id WHERE n.user_id % 5 = 0)
    SELECT user_id, sha256(CAST(user_id AS VARCHAR)) AS cache_key, epoch_us(created_at) AS created_us, epoch_us(accessed_at) AS accessed_us, CAST(size AS BIGINT) AS size_bytes FROM m""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events replayed as puts, gets and further puts: what the cache holds then, and when it was last used."""
    events = tables.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events = events.withColumns({"day": F.datediff("ts", F.lit("2024-01-01")), "cache_key": results.simple_key(F.col("user_id").cast("string"))})

    def entries(rows: DataFrame) -> DataFrame:
        made = rows.groupBy("cache_key").agg(F.max("ts").alias("created_at"), F.count("*").alias("size_bytes"), F.min("user_id").cast("string").alias("result"))
        return made.withColumn("accessed_at", F.col("created_at"))

    first = entries(events.where("day < 10"))
    most = first.agg(F.floor(F.sum("size_bytes") * 3 / 4)).first()[0] or 0
    cache = results.ResultCache(spark, stage.new_path(spark, "cache"), most, LIVES)
    cache.put(first.limit(0), F.current_timestamp())
    results.put(spark, f"{cache.path}/entries", first)
    cache.get(events.where("day >= 10 and day < 20").select("cache_key", F.col("ts").alias("at")))
    cache.put(entries(events.where("day >= 20 and user_id % 5 = 0")), F.lit("2024-01-21 00:00:00").cast("timestamp"))
    out = stage.keep(cache.entries().select(F.col("result").cast("long").alias("user_id"), "cache_key", F.unix_micros("created_at").alias("created_us"), F.unix_micros("accessed_at").alias("accessed_us"), "size_bytes"))
    stage.drop(spark, cache.path)
    return out


def _knots(*knots: tuple[float, float, float]) -> str:
    out = ""
    for i, (at, low, high) in enumerate(knots):
        end = knots[i + 1][0] if i + 1 < len(knots) else 1.0
        out += f"WHEN v < {end} OR {end} = 1.0 THEN {low} + (v - {at}) * ({high - low} / {end - at}) "
    return f"CASE {out}END"


MAPS = {
    "viridis": [_knots(*k) for k in (scalar.VIRIDIS_RED, scalar.VIRIDIS_GREEN, scalar.VIRIDIS_BLUE)],
    "plasma": ["240 * power(v, 0.7)", "20 + 100 * v", "140 * power(1 - v, 1.5)"],
    "inferno": ["v * v * 255", "v * 150", "(1 - v * v) * 200"],
    "grayscale": ["v * 255"] * 3,
}


@query("WITH b AS (SELECT vec_id, least(abs(CAST(embedding[1] AS DOUBLE)) * 2 + vec_id % 7 / 70.0, 1.0) AS v FROM embeddings) " + " UNION ALL ".join(
    f"SELECT vec_id AS signal_id, '{name}' AS map, " + ", ".join(f"CAST(floor(least(greatest({x}, 0), 255)) AS INTEGER) AS {c}" for c, x in zip("rgb", parts, strict=True)) + " FROM b" for name, parts in MAPS.items()
))
def colour_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of each vector in every colour map."""
    value = F.least(F.abs(F.element_at("samples", 1)) * 2 + F.col("signal_id") % 7 / F.lit(70.0), F.lit(1.0))
    rows = vectors(spark, sf_dir).select("signal_id", value.alias("v"))
    maps = F.explode(F.array(*[F.struct(F.lit(name).alias("map"), scalar.colormap(name, "v").alias("c")) for name in MAPS]))
    return rows.select("signal_id", maps.alias("m")).select("signal_id", "m.map", "m.c.*")


WINDOWS = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "kaiser": (0.42, 0.5, 0.08), "nuttall": (0.355768, 0.487396, 0.144232, 0.012604), "rectangular": (1.0,)}


def _cosines(terms: tuple[float, ...], n: int) -> str:
    return " + ".join(f"{(-1) ** k * a} * cos({k} * 2 * pi() * i / {n - 1})" for k, a in enumerate(terms))


@query(f"WITH {o.EM} " + " UNION ALL ".join(f"SELECT signal_id, '{name}' AS window_name, round(sum(x * w), 6) + 0.0 AS total, round(sum(x * w * x * w), 6) AS power FROM (SELECT signal_id, x, {_cosines(terms, 64).replace('i /', 'pos /')} AS w FROM ev) GROUP BY 1" for name, terms in WINDOWS.items()))
def window_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors under every window: their sums and powers."""
    shapes = F.array(*[F.struct(F.lit(name).alias("window_name"), F.array(*[F.lit(w) for w in scalar.window_values(name, 64)]).alias("ws")) for name in WINDOWS])
    rows = vectors(spark, sf_dir).select("signal_id", "samples", F.inline(shapes))
    rows = rows.withColumn("xs", F.zip_with("samples", "ws", lambda x, w: x * w))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rounded(rows.select("signal_id", "window_name", total("xs").alias("total"), total(F.transform("xs", lambda x: x * x)).alias("power")))


@query(f"""WITH {o.EM},
    st AS (SELECT signal_id, k, sum(x * cos(2 * pi() * k * pos / 64)) AS re, -sum(x * sin(2 * pi() * k * pos / 64)) AS im FROM ev, range(0, 33) AS r(k) GROUP BY 1, 2)
    SELECT signal_id, CAST(k AS INTEGER) AS bin, round(re * re + im * im, 4) AS power, round(cos(atan2(im, re)), 3) + 0.0 AS phase_cos FROM st WHERE sqrt(re * re + im * im) > 0.01""")
def power_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power and phase of whole vectors; a phase is known where there is power, up to whole turns."""
    made = vectors(spark, sf_dir).select("signal_id", *[spectral.spectrum("samples", kind, "rectangular").alias(kind) for kind in ("power", "phase")])
    cells = made.select("signal_id", F.posexplode(F.arrays_zip("power", "phase")).alias("bin", "c")).where(F.sqrt("c.power") > 0.01)
    return cells.select("signal_id", "bin", F.round("c.power", 4).alias("power"), (F.round(F.cos("c.phase"), 3) + 0.0).alias("phase_cos"))


def _biquads(rate: float) -> list[tuple[float, ...]]:
    """b0, b1, b2, a1, a2 of the two stages, from their corners."""
    import math

    out = []
    for hz, q, shelf in ((filters.PRE_HZ, filters.PRE_Q, False), (filters.LOW_HZ, filters.LOW_Q, True)):
        k = math.tan(math.pi * hz / rate)
        unit = 1.0 / (1.0 + k / q + k * k)
        b = ((k / q + k * k) * unit, 2.0 * k * k * unit, k * k * unit) if shelf else (unit, -2.0 * unit, unit)
        out.append((*b, 2.0 * (k * k - 1.0) * unit, (1.0 - k / q + k * k) * unit))
    return out


def _weighting_sql(rate: float) -> str:
    """y(signal_id, pos, x): the two stages as a recursion over positions."""
    (b0, b1, b2, a1, a2), (d0, d1, d2, c1, c2) = _biquads(rate)
    return f"""w AS (SELECT signal_id, CAST(-1 AS BIGINT) AS pos, 0.0::DOUBLE AS y, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS r, 0.0::DOUBLE AS s FROM (SELECT DISTINCT signal_id FROM ev)
        UNION ALL SELECT e.signal_id, e.pos, {d0!r} * ({b0!r} * e.x + p) + r, {b1!r} * e.x - {a1!r} * ({b0!r} * e.x + p) + q, {b2!r} * e.x - {a2!r} * ({b0!r} * e.x + p),
            {d1!r} * ({b0!r} * e.x + p) - {c1!r} * ({d0!r} * ({b0!r} * e.x + p) + r) + s, {d2!r} * ({b0!r} * e.x + p) - {c2!r} * ({d0!r} * ({b0!r} * e.x + p) + r)
        FROM w JOIN ev e ON e.signal_id = w.signal_id AND e.pos = w.pos + 1),
        y AS (SELECT signal_id, pos, y * y AS sq FROM w WHERE pos >= 0)"""


@query(f"""WITH RECURSIVE {o.EM}, {_weighting_sql(8000)},
    a AS (SELECT signal_id, coalesce(avg(sq) FILTER (sq >= {loudness.GATE!r}), 1e-10) AS ms FROM y GROUP BY 1),
    g AS (SELECT y.signal_id, coalesce(avg(sq) FILTER (sq >= greatest(ms / 10, {loudness.GATE!r})), max(ms)) AS ms FROM y JOIN a ON a.signal_id = y.signal_id GROUP BY 1)
    SELECT signal_id, round(-0.691 + 10 * log10(ms), 4) AS lufs FROM g""")
def weighted_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighting filter and gated level, end to end, of the vectors at a nominal 8 kHz."""
    loud = loudness.weighted(layout.explode_samples(vectors(spark, sf_dir)), 8000, 24)
    return rounded(loudness.integrated(loud), 4)


@query(f"WITH {o.SEGMENTS} SELECT signal_id, CAST(segment AS BIGINT) AS segment, segment * 0.5::DOUBLE AS start_time, segment * 0.5::DOUBLE + 1 AS end_time, content_type FROM al WHERE duration = 1.0")
def segment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of each second at half overlap."""
    out = classify.classify_segments(crossed(spark, sf_dir), RATE, 8, 4)
    return out.select("signal_id", F.col("segment").cast("long").alias("segment"), "start_time", "end_time", "content_type")


#: Made-up metrics of each user that reach into every rule.
METRICS = {
    "n": "count(*)",
    "dc_offset": "avg(value) / 100 - 0.5",
    "clipping_ratio": "avg(CASE WHEN value > 99 THEN 1 ELSE 0 END) / 2",
    "snr_db": "avg(value) * 1.2 - 20",
    "thd_percent": "avg(value) / 15 - 1.5",
    "dropout_count": "sum(CASE WHEN value < 20 THEN 4 ELSE 0 END)",
    "aliasing_score": "avg(CASE WHEN value > 90 THEN 1 ELSE 0 END)",
    "dynamic_range_db": "max(value) / 5",
    "frequency_response_score": "avg(CASE WHEN value > 50 THEN 1 ELSE 0 END)",
}


#: i to t: issues and scores of metrics m at a low sample rate.
VERDICT = """i AS (SELECT *, [CASE WHEN clipping_ratio > 0.01 THEN 'Clipping:Critical' WHEN clipping_ratio > 0.005 THEN 'Clipping:High' WHEN clipping_ratio > 0.001 THEN 'Clipping:Medium' END,
        CASE WHEN snr_db < 20 THEN 'HighNoiseFloor:High' WHEN snr_db < 30 THEN 'HighNoiseFloor:Medium' WHEN snr_db < 40 THEN 'HighNoiseFloor:Low' END,
        CASE WHEN thd_percent > 5 THEN 'Distortion:High' WHEN thd_percent > 2 THEN 'Distortion:Medium' WHEN thd_percent > 1 THEN 'Distortion:Low' END,
        CASE WHEN abs(dc_offset) > 0.01 THEN 'DCOffset:Low' END,
        CASE WHEN dropout_count > 100 THEN 'Dropouts:High' WHEN dropout_count > 50 THEN 'Dropouts:Medium' WHEN dropout_count > 10 THEN 'Dropouts:Low' END,
        CASE WHEN aliasing_score > 0.1 THEN 'Aliasing:Medium' END, 'LowSampleRate:Medium'] AS every FROM m),
    k AS (SELECT *, list_filter(every, lambda x: x IS NOT NULL) AS issues FROM i),
    s AS (SELECT *, 1 - coalesce(list_sum(list_transform(issues, lambda x: CASE split_part(x, ':', 2) WHEN 'Critical' THEN 0.3 WHEN 'High' THEN 0.15 WHEN 'Medium' THEN 0.08 ELSE 0.03 END)), 0) AS base FROM k),
    t AS (SELECT *, base * CASE WHEN snr_db >= 40 THEN 1.0 WHEN snr_db >= 20 THEN 0.8 + (snr_db - 20) * 0.01 ELSE snr_db / 25 END
        * CASE WHEN thd_percent <= 0.5 THEN 1.0 WHEN thd_percent <= 3 THEN 1 - (thd_percent - 0.5) * 0.1 ELSE 0.75 / (1 + (thd_percent - 3) / 10) END
        * (0.8 + frequency_response_score * 0.2) * 0.8 * CASE WHEN clipping_ratio > 0.001 THEN greatest(1 - clipping_ratio * 10, 0.3) ELSE 1 END AS score FROM s)"""
VERDICT_COLUMNS = """array_to_string(issues, ',') AS issues, CAST(len(issues) + CASE WHEN dynamic_range_db < 20 THEN 1 ELSE 0 END + CASE WHEN frequency_response_score < 0.5 THEN 1 ELSE 0 END AS INTEGER) AS n_recommendations,
        round(least(greatest(score, 0), 1), 6) AS overall_score, round(least(n / {rate}, 1) * CASE WHEN snr_db < 10 OR snr_db > 100 THEN 0.8 ELSE 1 END, 6) AS quality_confidence"""


@query(f"""WITH m AS (SELECT user_id AS signal_id, {", ".join(f"CAST({x} AS {'BIGINT' if c in ('n', 'dropout_count') else 'DOUBLE'}) AS {c}" for c, x in METRICS.items())} FROM events GROUP BY 1),
    {VERDICT}
    SELECT signal_id, {VERDICT_COLUMNS.format(rate=16.0)} FROM t""")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues, advice, score and confidence from metrics."""
    metrics = tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("signal_id"))
    metrics = metrics.agg(*[F.expr(x).cast("long" if c in ("n", "dropout_count") else "double").alias(c) for c, x in METRICS.items()])
    judged = quality.with_verdict(quality.with_issues(metrics, 16.0), 16.0)
    issues = F.array_join(F.transform("issues", lambda i: F.concat(i["issue_type"], F.lit(":"), i["severity"])), ",")
    return rounded(judged.select("signal_id", issues.alias("issues"), F.size("recommendations").alias("n_recommendations"), "overall_score", "quality_confidence"))


#: Names of notes, spelt with sharps and flats, and one that isn't a note's.
SPELT = ("C", "C#", "Db", "D", "Eb", "E", "F", "Gb", "G", "G#", "Ab", "A", "Bb", "B", "H")


@query(f"""WITH n AS (SELECT event_id, {list(SPELT)!r}[event_id % {len(SPELT)} + 1] AS name FROM events)
    SELECT event_id, name, CAST(coalesce(map {{'C': 0, 'C#': 1, 'Db': 1, 'D': 2, 'Eb': 3, 'E': 4, 'F': 5, 'Gb': 6, 'G': 7, 'G#': 8, 'Ab': 8, 'A': 9, 'Bb': 10, 'B': 11}}[name], 0) AS INTEGER) AS pitch_class FROM n""")
def note_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note's name of each event, and its place in the octave."""
    name = F.element_at(F.array(*[F.lit(n) for n in SPELT]), (F.col("event_id") % len(SPELT) + 1).cast("int"))
    return tables.table(spark, sf_dir, "events").select("event_id", name.alias("name")).select("event_id", "name", scalar.note_index("name").cast("int").alias("pitch_class"))


@query(f"""WITH {o.EM}, t AS (SELECT 'sine' AS tone, i AS pos, sin(i / 800.0 * 2 * pi() * 44) * 0.8 AS y FROM range(0, 64) AS r(i)
    UNION ALL SELECT 'partials', i, (sin(i / 800.0 * 2 * pi() * 20) + 0.5 * sin(i / 800.0 * 2 * pi() * 40) + 0.25 * sin(i / 800.0 * 2 * pi() * 60)) / 3 FROM range(0, 64) AS r(i))
    SELECT signal_id, tone, round(sum(x * y), 6) + 0.0 AS likeness FROM ev JOIN t ON t.pos = ev.pos GROUP BY 1, 2""")
def tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of two synthetic signals at 800 Hz the vectors hold."""
    tone = synthetic.series(spark, "sine", 0.08, 800, synthetic.sine(44, 0.8))
    tone = tone.unionByName(synthetic.series(spark, "partials", 0.08, 800, synthetic.harmonics(20, {2: 0.5, 3: 0.25})))
    tone = tone.select(F.col("signal_id").alias("tone"), "pos", F.col("x").alias("y"))
    both = samples(spark, sf_dir).select("signal_id", "pos", "x").join(F.broadcast(tone), "pos")
    return rounded(both.groupBy("signal_id", "tone").agg(F.sum(F.col("x") * F.col("y")).alias("likeness")))


@query(f"""WITH {o.EV}, b AS (SELECT signal_id, count(*) AS n, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms FROM ev GROUP BY 1)
    SELECT signal_id, round(n / 16.0, 6) AS duration, 16 AS sample_rate, round(peak, 6) AS peak_amplitude, round(rms, 6) AS rms_level,
        round(CASE WHEN rms > 0 THEN CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE -70 END - 20 * log10(rms) ELSE 0 END, 6) + 0.0 AS dynamic_range FROM b""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of every report."""
    return rounded(report.summary(tables.event_samples(spark, sf_dir), RATE))


def user_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the detailed profile's shape, with made-up figures of each user."""
    base = tables.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("signal_id")).agg(F.count("*").alias("n"), F.avg("value").cast("double").alias("m"), F.max("value").cast("double").alias("top"))
    c = F.col
    return base.select(
        "signal_id",
        F.struct((c("n") / 16.0).alias("duration"), F.when(c("signal_id") % 3 == 0, 16).otherwise(8).alias("sample_rate")).alias("summary"),
        F.struct(F.when(c("signal_id") % 5 > 0, c("m") * 3).alias("tempo")).alias("temporal"),
        F.struct((c("m") - 60).alias("loudness_lufs"), (c("top") / 8).alias("dynamic_range"), (c("m") / 50 - 2).alias("true_peak_dbfs")).alias("perceptual"),
        F.struct((c("m") / 100).alias("overall_score"), F.array().cast(f"array<{quality.ISSUE}>").alias("issues"), F.array(F.lit("equalise")).alias("recommendations")).alias("quality"),
        F.struct(F.element_at(F.array(F.lit("C"), F.lit("D"), F.lit("E")), (c("signal_id") % 3 + 1).cast("int")).alias("key"), (c("m") / 100).alias("confidence")).alias("musical"),
        F.struct(F.array(c("m"), c("top")).alias("spectral_centroid")).alias("spectral"),
        F.struct((c("n") % 9 + 1).alias("n_segments")).alias("segments"),
        F.struct(F.lit("Music").alias("content_type"), (c("m") / 200).alias("confidence")).alias("classification"),
    )


RECORDS = """b AS (SELECT user_id AS id, count(*) AS n, CAST(avg(value) AS DOUBLE) AS m, CAST(max(value) AS DOUBLE) AS top FROM events GROUP BY 1),
    r AS (SELECT id, n / 16.0 AS duration, CASE WHEN id % 3 = 0 THEN 16 ELSE 8 END AS sample_rate, CASE WHEN id % 5 > 0 THEN m * 3 END AS tempo, m - 60 AS lufs, top / 8 AS dyn, m / 100 AS score,
        ['C', 'D', 'E'][id % 3 + 1] AS key, (m + top) / 2 AS centroid, n % 9 + 1 AS segs FROM b)"""


@query(f"""WITH {RECORDS}, p AS (SELECT a.*, b.id AS id2, b.duration AS duration2, b.sample_rate AS rate2, b.tempo AS tempo2, b.lufs AS lufs2, b.dyn AS dyn2, b.score AS score2, b.key AS key2, b.centroid AS centroid2, b.segs AS segs2,
        CASE WHEN a.id % 4 > 0 THEN a.id % 21 / 20.0 ELSE 0 END AS fp FROM r a JOIN r b ON b.id = a.id + 1),
    q AS (SELECT *, 1 - least(abs(centroid - centroid2) / greatest(centroid, centroid2, 1), 1) AS sp, least(greatest(1 - (abs(lufs - lufs2) / 40 + abs(dyn - dyn2) / 30) / 2, 0), 1) AS pe, least(segs, segs2) / greatest(segs, segs2) AS st FROM p)
    SELECT id AS id_a, id2 AS id_b, round(fp, 6) AS fingerprint_similarity, CASE WHEN id % 4 > 0 THEN 'Similar' ELSE 'Unknown' END AS match_type, round(sp, 6) AS spectral_similarity, round(pe, 6) AS perceptual_similarity, round(st, 6) AS structural_similarity,
        round(least(fp * 0.4 + sp * 0.2 + pe * 0.2 + st * 0.2, 1), 6) AS overall_similarity, round(lufs - lufs2, 6) + 0.0 AS loudness_delta, round(tempo - tempo2, 6) + 0.0 AS tempo_delta, round(score - score2, 6) + 0.0 AS quality_delta, round(duration - duration2, 6) + 0.0 AS duration_delta,
        sample_rate = rate2 AS sample_rate_match, key || ' → ' || key2 AS key_change,
        CASE WHEN fp > 0.95 THEN 'same_take' WHEN fp > 0.85 THEN 'other_encoding,light_edit' WHEN fp > 0.7 THEN 'other_master,remix' WHEN fp > 0.5 THEN 'cover,shared_arrangement' ELSE 'unrelated' END AS use_cases FROM q""")
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of a comparison, for neighbouring users."""
    records = user_records(spark, sf_dir)
    ids = records.select(F.col("signal_id").alias("id_a"), (F.col("signal_id") + 1).alias("id_b"))
    pairs = ids.join(records.select(F.col("signal_id").alias("id_b")), "id_b", "left_semi").select("id_a", "id_b")
    matches = pairs.where("id_a % 4 > 0").withColumns({"similarity": F.col("id_a") % 21 / F.lit(20.0), "match_type": F.lit("Similar")})
    out = report.compare(pairs, records, matches)
    return rounded(out.withColumn("use_cases", F.array_join("use_cases", ",")))


@query(f"""WITH {RECORDS}
    SELECT id AS signal_id, '' AS critical, concat_ws(',', CASE WHEN lufs > -14 THEN 'loudness.high' END, CASE WHEN dyn < 6 THEN 'dynamics.narrow' END) AS warnings,
        concat_ws(',', CASE WHEN tempo IS NOT NULL THEN 'tempo' END, 'key', 'content') AS info, 'equalise' AS suggestions, CASE WHEN score > 0.9 THEN 'professional' WHEN score > 0.7 THEN 'good' WHEN score > 0.5 THEN 'acceptable' ELSE 'needs_improvement' END AS verdict FROM r""")
def ranked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a record's figures say, by how grave it is, and the summary's verdict."""
    records = user_records(spark, sf_dir).withColumn("fingerprint", F.struct(F.lit(0).cast("long").alias("perceptual_hash"), F.lit(1).alias("spectral_hashes"), F.lit(1).alias("landmarks")))
    codes = lambda c: F.array_join(F.transform(c, lambda n: n["code"]), ",").alias(c)
    verdict = report.enhanced_summary(records).select("signal_id", F.col("quality.recommendation").alias("verdict"))
    return report.ranked_insights(records).select("signal_id", *[codes(c) for c in ("critical", "warnings", "info")], F.array_join("suggestions", ",").alias("suggestions")).join(verdict, "signal_id")
