"""The operators as queries over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    common,
    exact_dedup,
    filter_audit,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    source_mixing,
    substring_dedup,
    toxicity,
    url_filter,
    vector_codes,
    warc,
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, toxicity.fit(docs, labels), threshold=0.7)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(common.read(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.read(spark, sf_dir, "documents"), keep="max")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(common.read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(common.read(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(common.read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels, threshold=0.3)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(common.read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(common.read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(common.read(spark, sf_dir, "documents"))
    return out.drop("content_share")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress_vectors(common.read(spark, sf_dir, "embeddings"))
    low = [F.lower(F.hex(F.substring("code", 2 * i + 1, 1))) for i in range(len(books.parts))]
    out = vector_codes.with_label_error(rows).withColumn("code", F.concat(*low))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(common.read(spark, sf_dir, "documents")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_url_filter, op3_exact_dedup, op4_mix_sources, op5_warc, op6_ngram_join,
        op7_quality_classifier, op8_substring_dedup, op9_best_fit_packing, op10_quality_rules,
        op11_filter_audit, op12_vector_codes, op13_bpe,
    )
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x20\x09-\x0D]+"

HOST = r"translate(regexp_extract(coalesce({0}, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINK = r"""(?i)<(?:a|area)\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"''>]+)"""

# vector codes: floor(1024 x) by part, then rounds of "nearest entry" and "floor of the mean"
NEAREST = """
        a{0} AS MATERIALIZED (SELECT vec_id, part, min(dist) AS dist, arg_min(entry, (dist, entry)) AS entry FROM (
                SELECT vec_id, x.part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS dist FROM x JOIN c{0} c ON c.part = x.part AND c.pos = x.pos GROUP BY 1, 2, 3)
            GROUP BY 1, 2)"""
MOVED = """
        c{1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (
                SELECT x.part, entry, pos, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM x JOIN a{0} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY 1, 2, 3) m
            ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)"""
ROUNDS = ",".join([NEAREST.format(i) + "," + MOVED.format(i, i + 1) for i in range(4)] + [NEAREST.format(4)])

ORACLES = {
    "op2_url_filter": rf"""
        WITH RECURSIVE u AS MATERIALIZED (SELECT page_id, {HOST.format("url")} AS host,
                regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
        rules AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
            ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS t(rule, domain, rule_path, v)),
        m AS MATERIALIZED (SELECT host, path, arg_max(rule, len(rule)) AS rule, arg_max(v, len(rule)) AS v FROM (SELECT DISTINCT host, path FROM u)
            JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, rule_path) GROUP BY 1, 2),
        l AS (SELECT host AS src, {HOST.format("CASE WHEN starts_with(t, '//') THEN 'any:' ELSE '' END || t")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{LINK}', 1)) AS t FROM u)),
        e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
        k AS (SELECT 't' AS kind, src AS host, dst AS goal, n FROM e UNION ALL SELECT 'd', dst, src, n FROM e),
        flow AS MATERIALIZED (SELECT kind, host, goal, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM k),
        c AS (SELECT CASE v WHEN 'allow' THEN 't' ELSE 'd' END AS kind, host, count(*) AS n FROM m GROUP BY 1, 2),
        seeds AS MATERIALIZED (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM c),
        p AS (SELECT 0 AS i, kind, host, seed AS score FROM seeds
            UNION ALL (
                WITH moved AS (SELECT p.i + 1 AS i, f.kind, f.goal AS host, sum(score * share) * 0.85 AS score
                        FROM p JOIN flow f ON f.kind = p.kind AND f.host = p.host WHERE p.i < 120 GROUP BY 1, 2, 3),
                held AS (SELECT kind, sum(score) AS moved FROM moved GROUP BY 1),
                nxt AS (SELECT i, kind, host, score FROM moved
                    UNION ALL SELECT t.i, s.kind, s.host, s.seed * (1 - coalesce(h.moved, 0)) FROM seeds s LEFT JOIN held h ON h.kind = s.kind, (SELECT max(i) + 1 AS i FROM p) t WHERE t.i <= 120)
                SELECT i, kind, host, sum(score) FROM nxt GROUP BY 1, 2, 3)),
        r AS (SELECT host, coalesce(sum(score) FILTER (kind = 't'), 0) AS t, coalesce(sum(score) FILTER (kind = 'd'), 0) AS d FROM p WHERE i = 120 GROUP BY 1)
        SELECT page_id, u.host, u.path, m.rule, coalesce(m.v, CASE WHEN u.host <> '' AND r.d - 0.5 * (r.t + r.d) > 0.001 * (r.t + r.d) THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path LEFT JOIN r ON r.host = u.host""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    "op4_mix_sources": rf"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size,
                length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')) AS symbols
            FROM documents),
        k AS (SELECT doc_id, source, size,
                -ln((CAST(('0x' || md5('17:' || CAST(doc_id AS VARCHAR))[1:12]) AS BIGINT) + 0.5) / 281474976710656.0)
                / (1.0 / (1.0 + symbols / CAST(greatest(size, 1) AS DOUBLE))) AS key FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w
            FROM d GROUP BY source),
        f AS (SELECT *, 2.0 * source_size AS cap, sum(source_size) OVER () * 1.5 AS budget,
                coalesce(sum(2.0 * source_size) OVER o, 0) AS caps_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
            FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT *, cap * w_left > (budget - caps_before) * w AS open, (budget - caps_before) / w_left AS level FROM f),
        v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE open),
        t AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM v) * w, cap)), 6) AS target FROM l),
        p AS (SELECT source, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS full_,
                target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS rest FROM t),
        r AS (SELECT doc_id, size, source_size, target, full_, rest,
                sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
            FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
            CAST(full_ * size + CASE WHEN upto - size / 2.0 <= rest THEN size ELSE 0 END AS BIGINT) AS taken FROM r""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
        h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, first_id FROM p JOIN g USING (html)),
        q AS (SELECT *, [CAST(('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5)) AS BIGINT) FOR i IN range(8)] AS fives FROM h)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((fives[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM q""",
    "op6_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 80 * (a.n + b.n - both_)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
        FROM documents d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_filter_audit": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
        g AS (SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(ws) < 80 * len(ws) THEN 'B' ELSE '' END
                || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
            FROM w LEFT JOIN g ON g.id = w.doc_id),
        m AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        p AS (SELECT '' AS o UNION ALL SELECT o || l FROM p, l WHERE NOT contains(o, l)),
        s AS (SELECT o, i AS step, o[i:i] AS l, o[1:i - 1] AS before FROM p, range(1, 6) r(i) WHERE len(o) = 5),
        r AS (SELECT part, o, step, l, translate(fails, before, '') = fails AS there, contains(fails, l) AS fail, fails, n, good, toxic FROM m, s),
        q AS (SELECT part, o, step, l, coalesce(sum(n) FILTER (there AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (there AND fail), 0) AS removed,
                coalesce(sum(n) FILTER (fail AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (fails = l), 0) AS unique_fails,
                coalesce(sum(good) FILTER (there AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND fail), 0) AS toxic_lost
            FROM r GROUP BY 1, 2, 3, 4)
        SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM q""",
    "op12_vector_codes": f"""
        WITH k AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        x AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(e) // 4) AS part, (i - 1) % (len(e) // 4) AS pos, CAST(floor(1024 * e[i]::DOUBLE) AS BIGINT) AS v
            FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM k)),
        c0 AS MATERIALIZED (SELECT x.part, entry, x.pos, x.v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) o ON o.vec_id = x.vec_id WHERE entry < 256),
        {ROUNDS},
        r AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a4 GROUP BY 1)
        SELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
            (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c4) AS codebooks_sha256
        FROM k JOIN r ON r.vec_id = k.vec_id""",
}
