"""Pieces of the oracles' SQL (DuckDB): the same relations, said in SQL alone."""

from __future__ import annotations

#: (signal_id, pos, x) of the users' events.
EV = "ev AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / 100 - 0.5 AS x FROM events)"
#: (signal_id, label, pos, x) of the vectors.
EM = "ev AS (SELECT vec_id AS signal_id, label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
#: (signal_id, pos, x) of the daily sums.
DAILY = """days AS (SELECT l_returnflag AS signal_id, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2),
    ev AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY d) - 1 AS pos, price / 1e6 AS x FROM days)"""
#: Signs that change.
CR = "cr AS (SELECT *, CASE WHEN (x >= 0) <> (lag(x) OVER (PARTITION BY signal_id ORDER BY pos) >= 0) THEN 1 ELSE 0 END AS crossed FROM ev)"
#: Lengths.
N = "n AS (SELECT signal_id, count(*) AS n FROM ev GROUP BY 1)"


def frames(size: int, hop: int, source: str = "cr") -> str:
    """fr(signal_id, f, off, x, crossed): whole frames."""
    return f"""{N}, fs AS (SELECT signal_id, unnest(range(0, (n - {size}) // {hop} + 1)) AS f FROM n WHERE n >= {size}),
        fr AS (SELECT fs.signal_id, f, pos - f * {hop} AS off, x, crossed FROM fs JOIN {source} s ON s.signal_id = fs.signal_id AND pos >= f * {hop} AND pos < f * {hop} + {size})"""


def dft(size: int, keys: str = "signal_id, f", source: str = "fr", name: str = "st", off: str = "off") -> str:
    """st(keys, k, mag): magnitudes of the Hann-windowed frames by the transform's definition."""
    w = f"(0.5 - 0.5 * cos(2 * pi() * {off} / {size - 1}))"
    return f"""{name} AS (SELECT {keys}, k, sqrt(power(sum(x * {w} * cos(2 * pi() * k * {off} / {size})), 2) + power(sum(x * {w} * sin(2 * pi() * k * {off} / {size})), 2)) AS mag
        FROM {source}, range(0, {size // 2 + 1}) AS r(k) GROUP BY {keys}, k)"""


def segments(size: int = 16, hop: int = 8, least: int = 4) -> str:
    """sx(signal_id, segment, off, x, crossed): the segments' samples, with the tail."""
    return f"""{N}, sg AS (SELECT signal_id, segment, n FROM (SELECT signal_id, n, unnest(range(0, greatest(0, (n - {size}) // {hop} + 1) + 1)) AS segment FROM n)
            WHERE segment * {hop} + {size} <= n OR segment = 0 OR n - segment * {hop} > {least}),
        sx AS (SELECT sg.signal_id, segment, pos - segment * {hop} AS off, x, crossed FROM sg JOIN cr ON cr.signal_id = sg.signal_id AND pos >= segment * {hop} AND pos < segment * {hop} + {size})"""


def percentile(value: str, percent: int) -> str:
    """The value at index floor(n * percent / 100) of the sorted values of a group."""
    return f"list_sort(list({value}))[least(count(*) * {percent} // 100, count(*) - 1) + 1]"


#: Features, class and label of each segment of the events (16 samples a second, frames of 8 at half overlap).
SEGMENTS = f"""{EV}, {CR}, {segments()},
    base AS (SELECT signal_id, segment, count(*) AS n, sqrt(avg(x * x)) AS energy, sum(CASE WHEN off > 0 THEN crossed ELSE 0 END) AS z FROM sx GROUP BY 1, 2),
    rngs AS (SELECT signal_id, segment, CASE WHEN count(*) > 1 THEN 20 * log10({percentile("rms", 95)} / {percentile("rms", 5)}) ELSE 0 END AS dynamic_range
        FROM (SELECT signal_id, segment, off, sqrt(avg(x * x)) AS rms FROM sx GROUP BY 1, 2, 3 HAVING sqrt(avg(x * x)) > 0) GROUP BY 1, 2),
    sf AS (SELECT signal_id, segment, f, off - f * 4 AS off, x, crossed FROM sx JOIN base USING (signal_id, segment), range(0, 3) AS r(f) WHERE f * 4 + 8 <= n AND off >= f * 4 AND off < f * 4 + 8),
    {dft(8, "signal_id, segment, f", "sf")},
    cen AS (SELECT signal_id, segment, sum(k * mag) / nullif(sum(mag), 0) * 2 AS c FROM st GROUP BY 1, 2),
    fst AS (SELECT signal_id, segment, f, sum(CASE WHEN off > 0 THEN crossed ELSE 0 END) / 8.0 AS zcr, sqrt(sum(x * x) / 8) AS rms FROM sf GROUP BY 1, 2, 3),
    em_ AS (SELECT signal_id, segment, avg(rms) AS m FROM fst GROUP BY 1, 2),
    fa AS (SELECT signal_id, segment, avg(zcr) AS zm, stddev_pop(zcr) AS zs, max(m) AS energy_mean, stddev_pop(rms) AS es, avg(CASE WHEN rms < m * 0.5 THEN 1 ELSE 0 END) AS low FROM fst JOIN em_ USING (signal_id, segment) GROUP BY 1, 2),
    cum AS (SELECT *, sum(mag) OVER (PARTITION BY signal_id, segment, f ORDER BY k) AS upto, sum(mag) OVER (PARTITION BY signal_id, segment, f) AS whole,
        mag - lag(mag) OVER (PARTITION BY signal_id, segment, k ORDER BY f) AS d FROM st),
    fsp AS (SELECT signal_id, segment, f, min(CASE WHEN upto >= whole * 0.85 THEN k END) * 16 / 10.0 AS ro, sum(k * mag) / nullif(sum(mag), 0) * 16 / 10.0 AS ce, sqrt(sum(power(greatest(d, 0), 2))) AS fl, count(d) AS nd FROM cum GROUP BY 1, 2, 3),
    sp AS (SELECT signal_id, segment, avg(ro) AS ro, var_pop(ce) AS cv, coalesce(avg(CASE WHEN nd > 0 THEN fl END), 0) AS fl FROM fsp GROUP BY 1, 2),
    pt AS (SELECT *, CASE WHEN zm > 0.05 AND zs > 0.02 THEN 0.2 ELSE 0 END + CASE WHEN ro < 2000 THEN 0.15 ELSE 0 END + CASE WHEN cv < 1000000 THEN 0.15 ELSE 0 END + CASE WHEN low > 0.3 THEN 0.2 ELSE 0 END
            + CASE WHEN es / greatest(energy_mean, 0.001) > 0.3 AND es / greatest(energy_mean, 0.001) < 0.8 THEN 0.1 ELSE 0 END + CASE WHEN fl > 0.5 THEN 0 ELSE 0.1 END AS s,
        CASE WHEN zm > 0.05 AND zs > 0.02 THEN 0 ELSE 0.2 END + CASE WHEN ro > 4000 THEN 0.15 ELSE 0 END + CASE WHEN cv < 1000000 THEN 0 ELSE 0.15 END + CASE WHEN low > 0.3 THEN 0 ELSE 0.2 END + 0.1
            + CASE WHEN es / greatest(energy_mean, 0.001) > 0.3 AND es / greatest(energy_mean, 0.001) < 0.8 THEN 0 ELSE 0.1 END + CASE WHEN fl > 0.5 THEN 0.15 ELSE 0 END AS m
        FROM fa JOIN sp USING (signal_id, segment)),
    sc AS (SELECT *, CASE WHEN energy_mean < 0.01 THEN 0.02 ELSE s / (s + m + 0.05) END AS speech, CASE WHEN energy_mean < 0.01 THEN 0.03 ELSE m / (s + m + 0.05) END AS music,
        CASE WHEN energy_mean < 0.01 THEN 0.95 ELSE 0.05 / (s + m + 0.05) END AS silence FROM pt),
    kd AS (SELECT *, CASE WHEN silence > speech AND silence > music THEN 'Silence' WHEN greatest(speech, music) <= 0.7 AND least(speech, music) > 0.3 THEN 'Mixed' WHEN speech > music THEN 'Speech' ELSE 'Music' END AS content_type FROM sc),
    al AS (SELECT b.signal_id, b.segment, b.segment * 8 / 16.0 AS start_time, b.n / 16.0 AS duration, energy, coalesce(c, 0) AS spectral_centroid, CASE WHEN b.n > 1 THEN z / (b.n - 1) ELSE 0 END AS zcr,
        coalesce(dynamic_range, 0) AS dynamic_range, coalesce(content_type, 'Silence') AS content_type FROM base b LEFT JOIN rngs USING (signal_id, segment) LEFT JOIN cen USING (signal_id, segment) LEFT JOIN kd USING (signal_id, segment)),
    seg AS (SELECT *, CASE content_type WHEN 'Silence' THEN 'Silence' WHEN 'Speech' THEN 'Speech' WHEN 'Mixed' THEN CASE WHEN energy > 0.6 THEN 'Music' ELSE 'Transition' END
        ELSE CASE WHEN energy < 0.1 THEN 'Break' WHEN energy > 0.7 AND spectral_centroid > 2000 THEN 'Drop' WHEN dynamic_range > 20 AND energy > 0.5 THEN 'Chorus' WHEN spectral_centroid < 1000 AND energy < 0.3 THEN 'Ambient' ELSE 'Verse' END END AS label FROM al)"""
SEG_LAG = "lagged AS (SELECT *, lag(energy) OVER w AS e0, lag(spectral_centroid) OVER w AS c0, lag(zcr) OVER w AS z0, lag(content_type) OVER w AS k0, lag(label) OVER w AS l0 FROM seg WINDOW w AS (PARTITION BY signal_id ORDER BY segment))"
