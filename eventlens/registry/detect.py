"""Detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import detect as D
from . import query

W = X.WINDOWS
FIELDS = ["ua", "action", "session"]
#: Windows as SQL: rows of dated events with the baseline flag, and one row for each suspect window that holds an event.
WIN = """, b AS (SELECT *, ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' AS base, ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25' AS in1, ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' AS in2 FROM ev WHERE ts IS NOT NULL),
 lab AS (SELECT b.*, unnest(list_filter([CASE WHEN in1 THEN 'w1' END, CASE WHEN in2 THEN 'w2' END], lambda x: x IS NOT NULL)) AS label FROM b),
 tot AS (SELECT label, count(*) AS total FROM lab GROUP BY label), nb AS (SELECT count(*) AS n_b FROM b WHERE base)"""


def _vals(src: str, fields=FIELDS, extra: str = "") -> str:
    cols = {"artifact": "artifact", "display_name": "display_name"}
    return " UNION ALL ".join(f"SELECT '{f}' AS field, {cols.get(f, 'a_' + f)} AS val, event_id, ts{extra} FROM {src} WHERE {cols.get(f, 'a_' + f)} <> ''" for f in fields)


FIRST = "arg_min(event_id, (CASE WHEN ts IS NULL THEN '1' ELSE '0' END) || coalesce(CAST(epoch_ms(ts) AS VARCHAR), '') || '~' || event_id)"


@query("window_totals", X.sql(f"{WIN} SELECT 'baseline' AS label, n_b AS total, n_b < 50 AS small FROM nb UNION ALL SELECT label, total, total < 50 FROM tot"))
def window_totals(spark, sf):
    return D.window_totals(X.events(spark, sf), W)


@query(
    "d_value_novelty",
    X.sql(f", v AS ({_vals('ev')}), c AS (SELECT field, val AS value, count(*) AS n, {FIRST} AS event_id FROM v GROUP BY 1, 2 HAVING count(*) <= 3), s AS (SELECT *, round(-ln(n / (SELECT count(*) FROM ev)), 4) AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, value) AS r FROM s) SELECT field, value, n, score, event_id FROM r WHERE r <= 25"),
)
def d_value_novelty(spark, sf):
    return D.value_novelty(X.events(spark, sf), FIELDS)


@query(
    "d_value_novelty_windows",
    X.sql(
        f"{WIN}, v AS ({_vals('lab', extra=', label')}), k AS ({_vals('b', extra=', base')}), known AS (SELECT DISTINCT field, val FROM k WHERE base), c AS (SELECT field, val AS value, label, count(*) AS n, {FIRST} AS event_id FROM v ANTI JOIN known USING (field, val) GROUP BY 1, 2, 3), s AS (SELECT c.*, round(-ln(n / total), 4) AS score FROM c JOIN tot USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, value, label) AS r FROM s) SELECT field, value, label, n, score, event_id FROM r WHERE r <= 25"
    ),
)
def d_value_novelty_windows(spark, sf):
    return D.value_novelty(X.events(spark, sf), FIELDS, W)


COMBO = "concat_ws(chr(31), artifact, a_action, a_k)"


@query(
    "d_value_combo",
    X.sql(
        f"{WIN}, c AS (SELECT {COMBO} AS value, label, count(*) AS n, {FIRST} AS event_id FROM lab WHERE {COMBO} NOT IN (SELECT {COMBO} FROM b WHERE base) GROUP BY 1, 2), s AS (SELECT c.*, round(-ln(n / total), 4) AS score FROM c JOIN tot USING (label)), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, value, label) AS r FROM s) SELECT 'artifact,action,k' AS field, replace(value, chr(31), ';') AS value, label, n, score, event_id FROM r WHERE r <= 25"
    ),
)
def d_value_combo(spark, sf):
    return D.value_combos(X.events(spark, sf), ["artifact", "action", "k"], W).withColumn("value", F.replace("value", F.lit(D.SEPARATOR), F.lit(";")))


NUM = ["bytes", "k"]


@query(
    "d_numeric_range",
    X.sql(f", v AS ({_vals('ev', NUM)}), x AS (SELECT *, CAST(val AS DOUBLE) AS x FROM v), q AS (SELECT field, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY field HAVING count(*) >= 20), bd AS (SELECT field, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) SELECT field, x, lo, hi, count(*) AS n, {FIRST} AS event_id, round(greatest(lo - x, x - hi) / greatest(hi - lo, 1e-9), 4) AS score FROM x JOIN bd USING (field) WHERE x < lo OR x > hi GROUP BY field, x, lo, hi"),
)
def d_numeric_range(spark, sf):
    return D.numeric_range(X.events(spark, sf), NUM)


@query(
    "d_numeric_range_windows",
    X.sql(
        f"{WIN}, v AS ({_vals('b', NUM, extra=', base, in1, in2')}), x AS (SELECT *, CAST(val AS DOUBLE) AS x, CASE WHEN in1 THEN 'w1' WHEN in2 THEN 'w2' END AS label FROM v), bd AS (SELECT field, min(x) AS lo, max(x) AS hi FROM x WHERE base GROUP BY field HAVING count(*) >= 20) SELECT field, x, label, lo, hi, count(*) AS n, {FIRST} AS event_id, round(greatest(lo - x, x - hi) / greatest(hi - lo, 1e-9), 4) AS score FROM x JOIN bd USING (field) WHERE label IS NOT NULL AND (x < lo OR x > hi) GROUP BY field, x, label, lo, hi"
    ),
)
def d_numeric_range_windows(spark, sf):
    return D.numeric_range(X.events(spark, sf), NUM, W)


def notes(spark, sf):
    """Documents as events with one long attribute, dated by their id."""
    docs = X.read(spark, sf, "documents")
    ts = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 30) * 86400)
    return docs.select(F.col("doc_id").cast("string").alias("event_id"), F.col("source").alias("source_id"), ts.alias("timestamp"), F.coalesce("lang", F.lit("")).alias("artifact"), F.create_map(F.lit("note"), F.coalesce("text", F.lit(""))).alias("attributes"))


NOTES = """WITH v AS (SELECT 'note' AS field, text AS val, CAST(doc_id AS VARCHAR) AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INT)) AS ts, {grp} AS grp, CASE WHEN doc_id % 30 BETWEEN 19 AND 23 THEN 'w1' WHEN doc_id % 30 BETWEEN 24 AND 29 THEN 'w2' END AS label FROM documents WHERE text <> ''), lv AS (SELECT DISTINCT field, grp, val FROM v{base}),
 ch AS (SELECT field, grp, val, unnest(list_distinct(string_split(val, ''))) AS c FROM lv), ct AS (SELECT field, grp, c, count(*) AS n_c FROM ch GROUP BY ALL), sz AS (SELECT field, grp, count(*) AS n_vals FROM lv GROUP BY ALL HAVING count(*) >= 20)"""


@query(
    "d_charset",
    NOTES.format(grp="''", base="")
    + f", sc AS (SELECT field, grp, val, count(*) AS n, {FIRST} AS event_id FROM v GROUP BY ALL) SELECT field, grp, md5(val) AS val, n, event_id, 'own' AS basis, round(sum(-ln(n_c / n_vals)), 4) AS score, string_agg(c, '' ORDER BY c) AS chars FROM sc JOIN sz USING (field, grp) JOIN ch USING (field, grp, val) JOIN ct USING (field, grp, c) WHERE n_c <= 3 GROUP BY field, grp, val, n, event_id",
)
def d_charset(spark, sf):
    return D.charset_novelty(notes(spark, sf), ["note"]).withColumn("val", F.md5("val"))


@query(
    "d_charset_windows",
    NOTES.format(grp="''", base=" WHERE label IS NULL")
    + f", sc AS (SELECT field, grp, val, label, count(*) AS n, {FIRST} AS event_id FROM v WHERE label IS NOT NULL GROUP BY ALL), se AS (SELECT *, unnest(list_distinct(string_split(val, ''))) AS c FROM sc) SELECT field, grp, md5(val) AS val, n, event_id, 'own' AS basis, label, round(sum(ln(n_vals + 1)), 4) AS score, string_agg(c, '' ORDER BY c) AS chars FROM se JOIN sz USING (field, grp) ANTI JOIN ct USING (field, grp, c) GROUP BY field, grp, val, n, event_id, label",
)
def d_charset_windows(spark, sf):
    return D.charset_novelty(notes(spark, sf), ["note"], W).withColumn("val", F.md5("val"))


@query(
    "d_charset_grouped",
    NOTES.format(grp="coalesce(lang, '')", base="")
    + f""", sc AS (SELECT field, grp, val, count(*) AS n, {FIRST} AS event_id FROM v GROUP BY ALL), se AS (SELECT *, unnest(list_distinct(string_split(val, ''))) AS c FROM sc), own AS (SELECT se.*, n_vals, n_c, 'own' AS basis FROM se JOIN sz USING (field, grp) JOIN ct USING (field, grp, c) WHERE n_c <= 3),
 bv AS (SELECT DISTINCT field, val FROM v), bn AS (SELECT field, count(*) AS n_vals FROM bv GROUP BY field HAVING count(*) >= 20), bc AS (SELECT field, c, count(*) AS n_c FROM (SELECT field, unnest(list_distinct(string_split(val, ''))) AS c FROM bv) GROUP BY ALL),
 back AS (SELECT se.*, n_vals, n_c, 'fallback' AS basis FROM se ANTI JOIN sz USING (field, grp) JOIN bn USING (field) JOIN bc USING (field, c) WHERE n_c <= 3)
 SELECT field, grp, md5(val) AS val, n, event_id, basis, round(sum(-ln(n_c / n_vals)), 4) AS score, string_agg(c, '' ORDER BY c) AS chars FROM (SELECT field, grp, val, n, event_id, c, n_vals, n_c, basis FROM own UNION ALL SELECT field, grp, val, n, event_id, c, n_vals, n_c, basis FROM back) GROUP BY field, grp, val, n, event_id, basis""",
)
def d_charset_grouped(spark, sf):
    return D.charset_novelty(notes(spark, sf), ["note"], group="artifact").withColumn("val", F.md5("val"))


@query(
    "d_entropy",
    X.sql(
        f""", v AS ({_vals('ev', ['ua', 'session'])}), dv AS (SELECT DISTINCT field, val FROM v WHERE length(val) >= 6), pc AS (SELECT field, val, c, count(*) / length(val) AS p FROM (SELECT field, val, unnest(string_split(val, '')) AS c FROM dv) GROUP BY field, val, c), bt AS (SELECT field, val, round(-sum(p * log2(p)), 9) AS bits FROM pc GROUP BY field, val),
        q AS (SELECT field, quantile_cont(bits, 0.25) AS q1, quantile_cont(bits, 0.75) AS q3 FROM bt GROUP BY field HAVING count(*) >= 20), bd AS (SELECT field, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q), s AS (SELECT field, val, count(*) AS n, {FIRST} AS event_id FROM v GROUP BY ALL)
        SELECT field, val, n, event_id, round(bits, 6) AS bits, CASE WHEN bits > hi THEN 'above' ELSE 'below' END AS direction, round(greatest(lo - bits, bits - hi) / greatest(hi - lo, 1e-9), 4) AS score FROM s JOIN bt USING (field, val) JOIN bd USING (field) WHERE bits < lo OR bits > hi"""
    ),
)
def d_entropy(spark, sf):
    return D.entropy_outliers(X.events(spark, sf), ["ua", "session"])


G = "2 * (CASE WHEN a > 0 THEN a * ln(a / (n_b * sh)) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c / (n_w * sh)) ELSE 0 END + CASE WHEN n_b > a THEN (n_b - a) * ln((n_b - a) / (n_b * (1 - sh))) ELSE 0 END + CASE WHEN n_w > c THEN (n_w - c) * ln((n_w - c) / (n_w * (1 - sh))) ELSE 0 END)"
SHIFT = f"""{WIN}, v AS ({_vals('b', ['action', 'display_name'], extra=', base, in1, in2')}), cn AS (SELECT field, val, count_if(base) AS a, count_if(in1) AS c1, count_if(in2) AS c2 FROM v WHERE base OR in1 OR in2 GROUP BY ALL HAVING count_if(base) > 0),
 ca AS (SELECT field, val, a, 'w1' AS label, c1 AS c FROM cn UNION ALL SELECT field, val, a, 'w2', c2 FROM cn), t AS (SELECT ca.*, n_b, total AS n_w, (a + c) / (n_b + total) AS sh FROM ca, nb JOIN tot ON true WHERE tot.label = ca.label)"""


@query("d_proportion_shift", X.sql(f"{SHIFT} SELECT field, val, label, CAST(a AS BIGINT) AS a, n_b, CAST(c AS BIGINT) AS c, n_w, round({G}, 6) AS g FROM t"))
def d_proportion_shift(spark, sf):
    """Counts and G of every tested value; p, q and the gate are held by tests."""
    return D.shift_candidates(X.events(spark, sf), ["action", "display_name"], W).select("field", "val", "label", "a", "n_b", "c", "n_w", F.round("g", 6).alias("g"))


@query("d_proportion_shift_findings")
def d_proportion_shift_findings(spark, sf):
    return D.proportion_shift(X.events(spark, sf), ["action", "display_name"], W)


@query(
    "d_interval",
    X.sql(
        f"""{WIN}, r AS (SELECT display_name AS val, event_id, ms, 'baseline' AS label FROM b WHERE base UNION ALL SELECT display_name, event_id, ms, label FROM lab), g AS (SELECT *, (ms - lag(ms) OVER (PARTITION BY val, label ORDER BY ms, event_id)) / 1000 AS gap FROM r)
        SELECT val, label, count(*) AS n, count(gap) AS k, round(coalesce(avg(gap), -1), 6) AS mean, round(coalesce(stddev_samp(gap), -1), 6) AS sd, round(coalesce(quantile_cont(gap, 0.5), -1), 6) AS median, (max(ms) - min(ms)) / 1000 AS span, round(coalesce(stddev_samp(gap) / avg(gap), -1), 6) AS cv FROM g GROUP BY val, label"""
    ),
)
def d_interval(spark, sf):
    """Gap statistics of every value and window; the tests and gates are held by tests."""
    out = D.arrival_gaps(X.events(spark, sf), "display_name", W)
    return out.select("val", "label", "n", "k", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("mean", "sd", "median")], "span", F.round(F.coalesce("cv", F.lit(-1.0)), 6).alias("cv"))


@query("d_interval_findings")
def d_interval_findings(spark, sf):
    return D.interval_periodicity(X.events(spark, sf), "display_name", W)


@query(
    "d_drift",
    X.sql(
        f"""{WIN}, r AS (SELECT CAST(a_bytes AS DOUBLE) AS x, base, unnest(CASE WHEN base THEN ['w1', 'w2'] ELSE list_filter([CASE WHEN in1 THEN 'w1' END, CASE WHEN in2 THEN 'w2' END], lambda v: v IS NOT NULL) END) AS label FROM b WHERE base OR in1 OR in2),
        c AS (SELECT label, x, count_if(base) AS b, count_if(NOT base) AS w FROM r GROUP BY ALL), f AS (SELECT *, sum(b) OVER o / sum(b) OVER p AS fb, sum(w) OVER o / sum(w) OVER p AS fw FROM c WINDOW o AS (PARTITION BY label ORDER BY x), p AS (PARTITION BY label))
        SELECT 'bytes' AS field, label, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(w) AS BIGINT) AS n_w, round(max(abs(fb - fw)), 9) AS d, round(max(fb - fw), 9) AS up FROM f GROUP BY label"""
    ),
)
def d_drift(spark, sf):
    return D.drift_numeric(X.events(spark, sf), ["bytes"], W)


@query(
    "d_drift_categories",
    X.sql(
        f"""{WIN}, cn AS (SELECT a_ua AS val, count_if(base) AS b, count_if(in1) AS w1, count_if(in2) AS w2, count(*) AS n FROM b WHERE base OR in1 OR in2 GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, val) AS r FROM cn), ca AS (SELECT CASE WHEN r <= 50 THEN val ELSE '__other__' END AS cat, b, 'w1' AS label, w1 AS w FROM rk UNION ALL SELECT CASE WHEN r <= 50 THEN val ELSE '__other__' END, b, 'w2', w2 FROM rk),
        cc AS (SELECT label, cat, sum(b) AS b, sum(w) AS w FROM ca GROUP BY ALL HAVING sum(b) + sum(w) > 0), ss AS (SELECT *, sum(b) OVER (PARTITION BY label) AS n_b, sum(w) OVER (PARTITION BY label) AS n_w FROM cc)
        SELECT 'ua' AS field, label, CAST(n_b AS BIGINT) AS n_b, CAST(n_w AS BIGINT) AS n_w, round(2 * sum(CASE WHEN b > 0 THEN b * ln(b * (n_b + n_w) / (n_b * (b + w))) ELSE 0 END + CASE WHEN w > 0 THEN w * ln(w * (n_b + n_w) / (n_w * (b + w))) ELSE 0 END), 6) AS g, count(*) - 1 AS df, round(0.5 * sum(abs(b / n_b - w / n_w)), 9) AS tvd FROM ss GROUP BY label, n_b, n_w"""
    ),
)
def d_drift_categories(spark, sf):
    return D.drift_categories(X.events(spark, sf), ["ua"], W)


@query("d_drift_findings")
def d_drift_findings(spark, sf):
    return D.distribution_drift(X.events(spark, sf), ["bytes", "k"], ["action", "artifact"], W)


@query(
    "d_drift_contributors",
    X.sql(f"{WIN}, cn AS (SELECT a_action AS value, count_if(base) AS b, count_if(in1) AS w1, count_if(in2) AS w2 FROM b WHERE base OR in1 OR in2 GROUP BY 1), s AS (SELECT sum(b) AS sb, sum(w1) AS s1, sum(w2) AS s2 FROM cn) SELECT 'w1' AS label, value, round(w1 / s1 - b / sb, 6) AS delta FROM cn, s UNION ALL SELECT 'w2', value, round(w2 / s2 - b / sb, 6) FROM cn, s"),
)
def d_drift_contributors(spark, sf):
    return D.drift_contributors(X.events(spark, sf), "action", W)


FREQ = ", c AS (SELECT display_name AS value, CAST(floor(ms / 1000 / 86400) AS BIGINT) * 86400 AS bucket, count(*) AS c FROM ev WHERE ms IS NOT NULL GROUP BY 1, 2)"


@query(
    "d_frequency",
    X.sql(
        f"{FREQ}, s AS (SELECT value, min(bucket) AS lo, max(bucket) AS hi, sum(c) AS t, sum(c * c) AS sq FROM c GROUP BY value HAVING count(*) >= 3), e AS (SELECT s.*, unnest(range(lo, hi + 1, 86400)) AS bucket FROM s), z AS (SELECT value, bucket, coalesce(c, 0) AS n, (hi - lo) / 86400 AS m, t, sq FROM e LEFT JOIN c USING (value, bucket)), y AS (SELECT *, (t - n) / m AS mean FROM z), x AS (SELECT value, bucket, n, mean, (n - mean) / greatest(sqrt(greatest((sq - n * n - m * mean * mean) / (m - 1), 0)), 0.5) AS z FROM y) SELECT value, bucket, n, round(mean, 6) AS mean, round(z, 4) AS z FROM x WHERE abs(round(z, 4)) >= 2.5"
    ),
)
def d_frequency(spark, sf):
    return D.frequency(X.events(spark, sf), "display_name", 86400)


@query(
    "d_frequency_windowed",
    X.sql(
        f"""{FREQ}, bb AS (SELECT unnest(range(epoch(TIMESTAMP '2024-01-01')::BIGINT, epoch(TIMESTAMP '2024-01-20')::BIGINT, 86400)) AS bucket), w AS (SELECT unnest(range(epoch(TIMESTAMP '2024-01-20')::BIGINT, epoch(TIMESTAMP '2024-01-31')::BIGINT, 86400)) AS bucket),
        st AS (SELECT value, sum(CASE WHEN bucket IN (SELECT bucket FROM bb) THEN c ELSE 0 END) AS t, sum(CASE WHEN bucket IN (SELECT bucket FROM bb) THEN c * c ELSE 0 END) AS sq FROM c WHERE bucket IN (SELECT bucket FROM bb UNION ALL SELECT bucket FROM w) GROUP BY value), y AS (SELECT *, t / 19 AS mean FROM st),
        x AS (SELECT y.value, CASE WHEN w.bucket < epoch(TIMESTAMP '2024-01-25') THEN 'w1' ELSE 'w2' END AS label, w.bucket, coalesce(c.c, 0) AS n, round(mean, 6) AS mean, round((coalesce(c.c, 0) - mean) / greatest(sqrt(greatest((sq - 19 * mean * mean) / 18, 0)), 0.5), 4) AS z FROM y CROSS JOIN w LEFT JOIN c ON c.value = y.value AND c.bucket = w.bucket) SELECT * FROM x WHERE abs(z) >= 2.5"""
    ),
)
def d_frequency_windowed(spark, sf):
    return D.frequency_windowed(X.events(spark, sf), "display_name", 86400, W)


O = "ORDER BY ts, byte_offset, line_number, event_id"


def _grams(n: int, src: str, keys: str) -> str:
    cols = ", ".join(f"lag(val, {i}) OVER w AS v{i}, lag(event_id, {i}) OVER w AS i{i}" for i in range(n - 1, -1, -1))
    gram = " || ' > ' || ".join(f"v{i}" for i in range(n - 1, -1, -1))
    return f"gr AS (SELECT *, {gram} AS gram FROM (SELECT *, {cols}, lag(ms, {n - 1}) OVER w AS first_ms, ms AS last_ms FROM {src} WINDOW w AS (PARTITION BY {keys} {O})) WHERE first_ms IS NOT NULL)"


SEQ = f"{WIN}, sq AS (SELECT *, artifact || a_action AS val0, a_ua AS val, CASE WHEN base THEN -1 WHEN in1 THEN 0 WHEN in2 THEN 1 END AS wid FROM b WHERE base OR in1 OR in2)"


@query(
    "d_sequence_novelty",
    X.sql(f"{SEQ}, {_grams(2, 'sq', 'source_id, wid')}, nw AS (SELECT * FROM gr WHERE wid >= 0), t AS (SELECT wid, count(*) AS total FROM nw GROUP BY wid) SELECT 'w' || (wid + 1) AS label, gram, count(*) AS n, count(DISTINCT source_id) AS sources, min(first_ms) AS first_ms, round(-ln(count(*) / any_value(total)), 4) AS score FROM nw JOIN t USING (wid) WHERE gram NOT IN (SELECT gram FROM gr WHERE wid = -1) GROUP BY wid, gram"),
)
def d_sequence_novelty(spark, sf):
    return D.sequence_novelty(X.events(spark, sf), "ua", 2, W)


ALL = ", sq AS (SELECT *, artifact AS val FROM ev WHERE ms IS NOT NULL)"


@query(
    "d_sequence_motif",
    X.sql(
        f"""{ALL}, {_grams(3, 'sq', 'source_id')}, gp AS (SELECT *, (first_ms - lag(first_ms) OVER (PARTITION BY source_id, gram ORDER BY first_ms, i2)) / 1000 AS gap FROM gr),
        e AS (SELECT gram, source_id, count(*) AS n, count(gap) AS k, CASE WHEN avg(gap) > 0 THEN round(stddev_samp(gap) / avg(gap), 4) END AS cv, round(quantile_cont(gap, 0.5), 4) AS period, min(first_ms) AS first_ms, max(last_ms) AS last_ms FROM gp GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY cv IS NULL, coalesce(cv, -k), source_id) AS r FROM e), s AS (SELECT gram, CAST(sum(n) AS BIGINT) AS support, count(*) AS sources, min(first_ms) AS first_ms, max(last_ms) AS last_ms FROM e GROUP BY gram HAVING sum(n) >= 3)
        SELECT s.*, source_id, cv, period, round(log10(support) * (1 + coalesce(round(greatest(0, 1 - cv), 4), 0)), 4) AS score FROM s JOIN r ON s.gram = r.gram AND r.r = 1"""
    ),
)
def d_sequence_motif(spark, sf):
    return D.sequence_motifs(X.events(spark, sf), "artifact", 3)


@query(
    "seq_segment",
    X.sql(f"{ALL}, ct AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY source_id {O}) > 600000 THEN 1 ELSE 0 END AS cut FROM sq), sg AS (SELECT *, sum(cut) OVER (PARTITION BY source_id {O}) AS segment FROM ct), {_grams(3, 'sg', 'source_id, segment')} SELECT source_id, gram, count(*) AS n FROM gr GROUP BY ALL"),
)
def seq_segment(spark, sf):
    return D.ngrams(X.events(spark, sf), "artifact", 3, max_gap=600).groupBy("source_id", F.array_join("gram", " > ").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "motif_occurrences",
    X.sql(f"{ALL}, {_grams(2, 'sq', 'source_id')}, h AS (SELECT * FROM gr WHERE gram = 'error > error' ORDER BY first_ms, source_id, i1 LIMIT 100) SELECT DISTINCT unnest([i1, i0]) AS event_id, source_id FROM h"),
)
def motif_occurrences(spark, sf):
    """The 100 earliest, as its SQL; motif_occurrences_all has every one."""
    return D.motif_occurrences(X.events(spark, sf), "artifact", ["error", "error"], 100)


@query("motif_occurrences_all", X.sql(f"{ALL}, {_grams(2, 'sq', 'source_id')}, h AS (SELECT * FROM gr WHERE gram = 'error > error') SELECT DISTINCT unnest([i1, i0]) AS event_id, source_id FROM h"))
def motif_occurrences_all(spark, sf):
    return D.motif_occurrences(X.events(spark, sf), "artifact", ["error", "error"])


TPL = r"regexp_replace(regexp_replace(message, '10\.0\.[0-9]+\.[0-9]+', '<IP>'), '[0-9]+', '<NUM>', 'g')"


@query("log_templates", X.sql(f"SELECT {TPL} AS template, count(*) AS n, count(DISTINCT source_id) AS sources, coalesce(min(ms), -1) AS first_ms, coalesce(max(ms), -1) AS last_ms, min(message) AS example FROM ev GROUP BY 1"))
def log_templates(spark, sf):
    return D.log_templates(X.events(spark, sf))


@query("log_templates_new", X.sql(f"SELECT {TPL} || '' AS template, count(*) AS n, count(DISTINCT source_id) AS sources, coalesce(min(ms), -1) AS first_ms, coalesce(max(ms), -1) AS last_ms, min(message) AS example FROM ev GROUP BY 1 HAVING min(ms) >= epoch_ms(TIMESTAMP '2024-01-01 00:03:00')"))
def log_templates_new(spark, sf):
    return D.log_templates(X.events(spark, sf), "2024-01-01 00:03:00")


@query("template_count", X.sql("SELECT count(*) AS n FROM ev WHERE artifact = 'error'"))
def template_count(spark, sf):
    return D.template_count(X.events(spark, sf), ["user <NUM> error from <IP> amount <NUM>"])


ORD = ", o AS (SELECT source_id, event_id, ms, lag(ms) OVER (PARTITION BY source_id ORDER BY byte_offset, line_number, event_id) - ms AS back_ms FROM ev WHERE ms IS NOT NULL)"


@query("d_timestamp_order", X.sql(f"{ORD} SELECT *, round(back_ms / 1000, 3) AS score FROM o WHERE back_ms >= 1000"))
def d_timestamp_order(spark, sf):
    return D.order_violations(X.events(spark, sf))


@query("d_timestamp_order_totals", X.sql(f"{ORD} SELECT source_id, count(*) AS n, max(back_ms) AS worst_ms FROM o WHERE back_ms >= 1000 GROUP BY source_id"))
def d_timestamp_order_totals(spark, sf):
    return D.order_totals(X.events(spark, sf))


INV = ", f AS (SELECT key AS field, count(*) AS coverage, count(DISTINCT val) AS n_distinct, count_if(regexp_matches(val, '^[0-9]+$')) AS num, (SELECT count(*) FROM ev) AS total FROM av GROUP BY key)"
KIND = "CASE WHEN n_distinct <= 1 THEN 'constant' WHEN coverage < 0.05 * total THEN 'sparse' WHEN n_distinct >= 0.9 * coverage THEN 'identifier' ELSE 'categorical' END"


@query("rec_novelty", X.sql(f"{INV} SELECT field, coverage, n_distinct, {KIND} AS kind, {KIND} = 'categorical' AS recommended FROM f"))
def rec_novelty(spark, sf):
    return D.recommend_novelty(X.events(spark, sf))


@query("rec_numeric", X.sql(f"{INV} SELECT field, coverage, n_distinct FROM f WHERE num >= 0.9 * coverage AND coverage >= 0.05 * total AND n_distinct > 1"))
def rec_numeric(spark, sf):
    return D.recommend_numeric(X.events(spark, sf))


@query("rec_strings", X.sql(f"{INV} SELECT field, coverage, n_distinct >= 0.9 * coverage AS identifier FROM f WHERE num < 0.9 * coverage AND n_distinct > 1"))
def rec_strings(spark, sf):
    return D.recommend_strings(X.events(spark, sf))


@query("canonical_inventory", X.sql("SELECT 'client_ip' AS field, count(*) AS coverage, count(DISTINCT coalesce(a_src_ip, a_ip_addr)) AS n_distinct, CAST(0 AS BIGINT) AS n_numeric, count(*) AS total FROM ev"))
def canonical_inventory(spark, sf):
    return D.field_inventory(X.events(spark, sf), ["client_ip"], X.MAPPINGS)


@query("fdr_bh", "WITH p AS (SELECT o_orderkey AS id, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM p) SELECT id, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r")
def fdr_bh(spark, sf):
    from ..functions.stats import benjamini_hochberg

    orders = X.read(spark, sf, "orders")
    top = F.broadcast(orders.agg(F.max("o_totalprice").alias("top")))
    return benjamini_hochberg(orders.crossJoin(top).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / F.col("top")).alias("p"))).select("id", F.round("q", 9).alias("q"))


@query("suppress", X.sql(f", v AS ({_vals('ev')}), c AS (SELECT field, val AS value, count(*) AS n, {FIRST} AS event_id FROM v GROUP BY 1, 2 HAVING count(*) <= 3), s AS (SELECT *, round(-ln(n / (SELECT count(*) FROM ev)), 4) AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, value) AS r FROM s) SELECT field, value, n, score, event_id FROM r WHERE r <= 25 AND event_id NOT LIKE '%5' AND NOT (field = 'ua' AND value LIKE '%1')"))
def suppress(spark, sf):
    ev = X.events(spark, sf)
    found = D.value_novelty(ev, FIELDS)
    allowed = ev.select(F.lit("ua").alias("field"), F.col("attributes")["ua"].alias("value")).where("value LIKE '%1'").distinct()
    return D.suppress(found, allowed, ev.where("event_id LIKE '%5'"))


@query("j_finding_event", X.sql(f"{ORD} , t AS (SELECT 'order' AS field, source_id AS value, event_id, round(back_ms / 1000, 3) AS score FROM o WHERE back_ms >= 1000 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10) SELECT event_id, message, artifact, field, value, score FROM t JOIN ev USING (event_id)"))
def j_finding_event(spark, sf):
    ev = X.events(spark, sf)
    return D.rank_findings(D.order_violations(ev).select(F.lit("order").alias("field"), F.col("source_id").alias("value"), "event_id", "score"), ev, 10)


@query(
    "j_cross_baseline",
    X.sql(f"{SEQ}, {_grams(3, 'sq', 'source_id, wid')} SELECT gram, count(*) AS n FROM gr WHERE wid >= 0 AND gram NOT IN (SELECT gram FROM gr WHERE wid = -1) GROUP BY gram"),
)
def j_cross_baseline(spark, sf):
    return D.sequence_novelty(X.events(spark, sf), "ua", 3, W).groupBy("gram").agg(F.sum("n").alias("n"))


# Rows on which the gates fire: marks and rhythms made from the events.
MARKS = "∀∁∂∃∄∅∆∇∈∉∊∋∌∍∎∏∐∑∓∔∕∖∗∘∙√∛∜∝∞"


def _marked(spark, sf, since: str | None = None):
    """Events with an attribute `mark`, which holds a character of its own in one of 400 events (from a day on)."""
    ev, n = X.events(spark, sf), F.col("event_id").cast("long")
    odd = (n % 400 == 17) & (F.lit(True) if since is None else F.col("timestamp") >= F.lit(since).cast("timestamp"))
    mark = F.concat(F.lit("v"), F.col("attributes")["k"], F.when(odd, F.substring(F.lit(MARKS), (F.floor(n / 400) % 30 + 1).cast("int"), F.lit(1))).otherwise(""))
    return ev.withColumn("attributes", F.create_map(F.lit("mark"), mark))


def _mark_sql(odd: str, base: str, rest: str) -> str:
    return X.sql(f""", v AS (SELECT 'mark' AS field, '' AS grp, event_id, ts, ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' AS base, CASE WHEN ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25' THEN 'w1' WHEN ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' THEN 'w2' END AS label, 'v' || a_k || CASE WHEN {odd} THEN substr('{MARKS}', CAST(CAST(event_id AS BIGINT) // 400 % 30 + 1 AS INT), 1) ELSE '' END AS val FROM ev),
 lv AS (SELECT DISTINCT field, grp, val FROM v{base}), ch AS (SELECT field, grp, val, unnest(list_distinct(string_split(val, ''))) AS c FROM lv), ct AS (SELECT field, grp, c, count(*) AS n_c FROM ch GROUP BY ALL), sz AS (SELECT field, grp, count(*) AS n_vals FROM lv GROUP BY ALL HAVING count(*) >= 20), {rest}""")


@query(
    "d_charset_marks",
    _mark_sql("CAST(event_id AS BIGINT) % 400 = 17", "", f"sc AS (SELECT field, grp, val, count(*) AS n, {FIRST} AS event_id FROM v GROUP BY ALL) SELECT field, grp, val, n, event_id, 'own' AS basis, round(sum(-ln(n_c / n_vals)), 4) AS score, string_agg(c, '' ORDER BY c) AS chars FROM sc JOIN sz USING (field, grp) JOIN ch USING (field, grp, val) JOIN ct USING (field, grp, c) WHERE n_c <= 3 GROUP BY field, grp, val, n, event_id"),
)
def d_charset_marks(spark, sf):
    return D.charset_novelty(_marked(spark, sf), ["mark"])


@query(
    "d_charset_marks_windows",
    _mark_sql("CAST(event_id AS BIGINT) % 400 = 17 AND ts >= TIMESTAMP '2024-01-20'", " WHERE base", f"sc AS (SELECT field, grp, val, label, count(*) AS n, {FIRST} AS event_id FROM v WHERE label IS NOT NULL GROUP BY ALL), se AS (SELECT *, unnest(list_distinct(string_split(val, ''))) AS c FROM sc) SELECT field, grp, val, n, event_id, 'own' AS basis, label, round(sum(ln(n_vals + 1)), 4) AS score, string_agg(c, '' ORDER BY c) AS chars FROM se JOIN sz USING (field, grp) ANTI JOIN ct USING (field, grp, c) GROUP BY field, grp, val, n, event_id, label"),
)
def d_charset_marks_windows(spark, sf):
    return D.charset_novelty(_marked(spark, sf, "2024-01-20"), ["mark"], W)


@query(
    "d_proportion_shift_marks",
    X.sql(f"""{WIN}, v AS (SELECT CASE WHEN CAST(event_id AS BIGINT) % 10 < CASE WHEN base THEN 1 ELSE 4 END THEN 'rare' ELSE 'usual' END AS val, base, in1, in2 FROM b WHERE base OR in1 OR in2), cn AS (SELECT val, count_if(base) AS a, count_if(in1) AS c1, count_if(in2) AS c2 FROM v GROUP BY val),
 ca AS (SELECT val, a, 'w1' AS label, c1 AS c FROM cn UNION ALL SELECT val, a, 'w2', c2 FROM cn), t AS (SELECT ca.*, n_b, total AS n_w, (a + c) / (n_b + total) AS sh, (c / total) / (a / n_b) AS ratio FROM ca, nb JOIN tot ON true WHERE tot.label = ca.label)
 SELECT 'mark' AS field, val AS value, label, CAST(c AS BIGINT) AS n, round(ratio, 4) AS ratio, 'up' AS direction, round({G}, 4) AS score FROM t WHERE ratio >= 2"""),
)
def d_proportion_shift_marks(spark, sf):
    """A value whose share grows from a tenth to four tenths; its p is far below any gate, so SQL needs none."""
    ev = X.events(spark, sf)
    most = F.when(W.baseline.holds(F.col("timestamp")), 1).otherwise(4)
    mark = F.when(F.col("event_id").cast("long") % 10 < most, "rare").otherwise("usual")
    return D.proportion_shift(ev.withColumn("attributes", F.create_map(F.lit("mark"), mark)), ["mark"], W).drop("q")


@query(
    "d_interval_marks",
    """WITH h AS (SELECT DISTINCT event_id % 720 AS hour FROM events), a AS (SELECT count(*) AS a FROM h WHERE hour < 456), w AS (SELECT 'w1' AS label, 432000.0 AS m UNION ALL SELECT 'w2', 604800.0)
 SELECT 'tick' AS value, label, CAST(0 AS BIGINT) AS n, 'missed' AS direction, round((0.5 / m) / (a / 1641600.0), 4) AS ratio FROM a, w UNION ALL SELECT 'fresh', 'w2', count(*), 'new_regularity', NULL FROM h WHERE hour >= 576""",
)
def d_interval_marks(spark, sf):
    """An hourly tick that stops with the baseline, and one that begins with the second window; hours come from the events' ids."""
    hours = X.read(spark, sf, "events").select((F.col("event_id") % 720).alias("hour")).distinct().where("hour < 456 OR hour >= 576")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600)
    name = F.when(F.col("hour") < 456, "tick").otherwise("fresh")
    rows = hours.select(F.col("hour").cast("string").alias("event_id"), F.lit("s").alias("source_id"), at.alias("timestamp"), name.alias("display_name"), F.create_map().cast("map<string,string>").alias("attributes"))
    return D.interval_periodicity(rows, "display_name", W).select("value", "label", "n", "direction", "ratio")
