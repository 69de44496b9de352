"""The operators over whole tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, rules
from ..functions import text as T
from ..functions.continuity import continuity
from ..functions.loss import loss
from ..operators import assembly, context, duplicates, evaluate, history, intervals, merging, metrics, providers, routing, speakers, tracking
from ..sources.history import without_session
from ..sources.tables import captions, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CAPTIONS = "cap AS (SELECT conv_id AS session_id, turn AS id, role AS speaker_id, text AS original, CAST(turn AS DOUBLE) * 10 AS start_s, CAST(turn AS DOUBLE) * 10 + length(text) / 20.0::DOUBLE AS end_s FROM conversations)"
WORD = r"[\p{L}\p{M}\p{N}_]+(?:''[\p{L}\p{M}\p{N}_]+)?"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "conversations")
    return t.groupBy(F.col("conv_id").alias("session_id")).agg(F.min("turn").alias("created")).withColumn("name", F.concat(F.lit("session "), F.col("session_id").cast("string")))


@query(f"""WITH {CAPTIONS}, ses AS (SELECT session_id, min(id) AS created, 'session ' || session_id AS name FROM cap GROUP BY session_id)
SELECT session_id, created, name, (SELECT count(*) FROM cap c WHERE c.session_id = s.session_id) AS captions FROM ses s
WHERE instr(lower(name), 'tion') > 0 OR EXISTS (SELECT 1 FROM cap c WHERE c.session_id = s.session_id AND instr(lower(original), 'tion') > 0)
ORDER BY created DESC, session_id LIMIT 200""")
def history_search(spark: SparkSession, folder: str) -> DataFrame:
    return history.search(_sessions(spark, folder), captions(spark, folder), "TION")


@query(f"WITH {CAPTIONS} SELECT session_id, id, original FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM cap) WHERE k <= 3")
def caption_preview(spark: SparkSession, folder: str) -> DataFrame:
    return history.first_captions(captions(spark, folder), 3).select("session_id", "id", "original")


@query("SELECT conv_id AS session_id, arg_max(role, turn) AS state, max(turn) AS ts FROM conversations GROUP BY 1")
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return history.latest_state(table(spark, folder, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ts"), F.col("role").alias("state")))


@query(f"WITH {CAPTIONS} SELECT session_id, count(*) AS n FROM cap WHERE isfinite(start_s) AND start_s >= 0 AND end_s > start_s GROUP BY 1")
def caption_validity(spark: SparkSession, folder: str) -> DataFrame:
    return history.valid(captions(spark, folder)).groupBy("session_id").agg(F.count("*").alias("n"))


def _stamp(x: str, sep: str) -> str:
    ms = f"CAST(round_even({x} * 1000, 0) AS BIGINT)"
    return f"(printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000))"


_SHOWN = r"trim(regexp_replace(original, '\s+', ' ', 'g'))"


@query(f"""WITH {CAPTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM cap)
SELECT session_id, string_agg(n || chr(10) || {_stamp('start_s', ',')} || ' --> ' || {_stamp('end_s', ',')} || chr(10) || speaker_id || ': ' || {_SHOWN} || chr(10), chr(10) ORDER BY n) || chr(10) AS document FROM n GROUP BY 1""")
def export_srt(spark: SparkSession, folder: str) -> DataFrame:
    return history.export(captions(spark, folder), "srt", speakers=True)


@query(f"""WITH {CAPTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM cap)
SELECT session_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(n || chr(10) || {_stamp('start_s', '.')} || ' --> ' || {_stamp('end_s', '.')} || chr(10) ||
  replace(replace(replace(replace(replace({_SHOWN}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || chr(10), chr(10) ORDER BY n) || chr(10) AS document FROM n GROUP BY 1""")
def export_vtt(spark: SparkSession, folder: str) -> DataFrame:
    return history.export(captions(spark, folder), "vtt")


@query(f"WITH {CAPTIONS} SELECT session_id, string_agg('[' || {_stamp('start_s', ',')} || '] ' || original || chr(10) || '→ ' || original, chr(10) || chr(10) ORDER BY id) || chr(10) AS document FROM cap GROUP BY 1")
def export_txt(spark: SparkSession, folder: str) -> DataFrame:
    return history.export(captions(spark, folder), "txt")


@query(f"WITH {CAPTIONS} SELECT session_id, id, round(start_s - lag(end_s) OVER (PARTITION BY session_id, speaker_id ORDER BY start_s, id), 6) AS gap_s FROM cap")
def turn_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return context.gaps(captions(spark, folder)).select("session_id", "id", F.round("gap_s", 6).alias("gap_s"))


@query(f"WITH {CAPTIONS}, p AS (SELECT *, lag(speaker_id) OVER (PARTITION BY session_id ORDER BY start_s, id) AS previous FROM cap) SELECT session_id, id, previous, speaker_id FROM p WHERE previous <> speaker_id")
def speaker_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return context.transitions(captions(spark, folder)).select("session_id", "id", "previous", "speaker_id")


@query(f"""WITH {CAPTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s, id) AS k FROM cap)
SELECT a.session_id, a.id, coalesce(string_agg(b.original, ' | ' ORDER BY b.k), '') AS context
FROM k a LEFT JOIN k b ON a.session_id = b.session_id AND b.k BETWEEN a.k - 5 AND a.k - 1 AND b.start_s >= a.start_s - 40 GROUP BY 1, 2""")
def context_turns(spark: SparkSession, folder: str) -> DataFrame:
    return context.last_turns(captions(spark, folder), 5, 40.0).select("session_id", "id", F.array_join("context", " | ").alias("context"))


@query(f"""WITH {CAPTIONS} SELECT a.session_id, a.id, (SELECT b.original FROM cap b WHERE b.session_id = a.session_id AND b.id < a.id AND b.speaker_id <> a.speaker_id ORDER BY b.id DESC LIMIT 1) AS reply_to FROM cap a""")
def reply_context(spark: SparkSession, folder: str) -> DataFrame:
    return context.other_speaker(captions(spark, folder)).select("session_id", "id", "reply_to")


_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH {CAPTIONS}, two AS (SELECT * FROM cap UNION ALL SELECT session_id, id + 1000, speaker_id, original || ' !', start_s + 30, end_s + 30 FROM cap), x AS (SELECT *, {_NORM.format('original')} AS norm FROM two), y AS (SELECT *, lag(start_s) OVER (PARTITION BY session_id, speaker_id, norm ORDER BY start_s, id) AS b FROM x)
SELECT session_id, id FROM y WHERE norm <> '' AND start_s - b <= 60""")
def near_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Turns, and each one said again after half a minute."""
    c = captions(spark, folder)
    again = c.withColumn("id", F.col("id") + 1000).withColumn("original", F.concat("original", F.lit(" !"))).withColumn("start_s", F.col("start_s") + 30).withColumn("end_s", F.col("end_s") + 30)
    return intervals.near_repeats(c.unionByName(again), 60.0).select("session_id", "id")


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalized_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{WORD}')) AS n, len(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS distinct_words FROM documents")
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct_words"))


def _incomplete_sql(x: str) -> str:
    edge = r"(?:^|[^\p{L}\p{M}\p{N}_])"
    opened = " OR ".join(f"regexp_matches({x}, '(?i){edge}{p}')" for p in rules.OPEN_ENDS)
    finite = f"regexp_matches({x}, '(?i){edge}(?:{'|'.join(rules.FINITE_VERBS)})(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"
    words = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}]+(?:''[\p{{L}}\p{{M}}]+)?')"
    last = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.CONNECTORS + rules.AUXILIARIES))
    return f"""CASE WHEN {x} = '' THEN true WHEN regexp_matches({x}, '(?:\\.\\.\\.|[…—,:;-])$') THEN true WHEN regexp_matches({x}, '[.?!]$') THEN false
WHEN {opened} THEN true WHEN len({words}) = 0 THEN true WHEN {words}[-1] IN ({last}) THEN true ELSE len({words}) >= 2 AND NOT {finite} END"""


_LINES = r"l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS c FROM l)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document, whole."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query(f"WITH {_LINES} SELECT doc_id, line, {_incomplete_sql('c')} AS incomplete FROM x")
def likely_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "line", T.likely_incomplete(F.col("text")).alias("incomplete"))


@query(f"""WITH {_LINES}, z AS (SELECT *, CAST((doc_id * 37 + line * 101) % 1200 AS DOUBLE) AS p, doc_id % 2 AS ch, CAST((doc_id + line) % 25 AS DOUBLE) AS d FROM x), y AS (SELECT *, {_incomplete_sql('c')} AS inc FROM z)
SELECT doc_id, line, round(0.32 * CASE WHEN p < 250 THEN 0.0 WHEN p < 650 THEN 0.25 + 0.35 * (p - 250) / 400 WHEN p < 900 THEN 0.8 + 0.2 * (p - 650) / 250 ELSE 1 END::DOUBLE
 + 0.22::DOUBLE * CASE WHEN regexp_matches(c, '(?:[,:;…]|\\.\\.\\.)$') THEN 0.0 WHEN regexp_matches(c, '[.?!]$') THEN 1.0 ELSE 0.25 END::DOUBLE
 + 0.28::DOUBLE * CASE WHEN inc THEN 0.0 ELSE 0.85 END::DOUBLE + 0.12::DOUBLE * ch + 0.06::DOUBLE * least(1.0::DOUBLE, d / 18), 4) AS score FROM y""")
def completion_scores(spark: SparkSession, folder: str) -> DataFrame:
    d, k = F.col("doc_id"), F.col("line")
    score = T.completion_score(F.col("text"), ((d * 37 + k * 101) % 1200).cast("double"), d % 2 == 1, ((d + k) % 25).cast("double"))
    return _lines(spark, folder).select("doc_id", "line", score.alias("score"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 100 GROUP BY 1")
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.latency_summary(table(spark, folder, "events"), "event_type", "event_id", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p95")})


@query("""WITH a AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE value >= 50),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events, round(avg(value), 6) AS level FROM b GROUP BY user_id, k""")
def activity_islands(spark: SparkSession, folder: str) -> DataFrame:
    out = intervals.islands(table(spark, folder, "events"), "user_id", "ts", "value", "8 hours", 50.0)
    return out.withColumn("level", F.round("level", 6))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM a) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n FROM b GROUP BY 1, 2""")
def numbered_islands(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.island_numbers(table(spark, folder, "events"), "user_id", "ts", 4 * 3600.0).groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query(f"""WITH {CAPTIONS} SELECT a.session_id, a.id AS a_id, b.id AS b_id, round(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 6) AS seconds
FROM cap a JOIN cap b ON a.session_id = b.session_id AND a.id < b.id AND a.start_s < b.end_s AND b.start_s < a.end_s""")
def overlapping_turns(spark: SparkSession, folder: str) -> DataFrame:
    c = captions(spark, folder)
    return intervals.overlaps(c, c).where("a_id < b_id").withColumn("seconds", F.round("seconds", 6))


@query(f"""WITH {CAPTIONS} SELECT DISTINCT a.session_id, a.end_s AS at_s FROM cap a WHERE EXISTS (SELECT 1 FROM cap b WHERE b.session_id = a.session_id AND abs(a.end_s - b.start_s) <= 0.5)""")
def turn_matches(spark: SparkSession, folder: str) -> DataFrame:
    c = captions(spark, folder)
    return intervals.within_tolerance(c.select("session_id", F.col("end_s").alias("at_s")), c.select("session_id", F.col("start_s").alias("at_s")))


@query(f"""WITH {CAPTIONS}, p AS (SELECT *, lag(original) OVER (PARTITION BY session_id ORDER BY id) AS before FROM cap),
w AS (SELECT session_id, id, list_distinct(regexp_extract_all(lower(original), '{WORD}')) AS a, list_distinct(regexp_extract_all(lower(before), '{WORD}')) AS b FROM p WHERE before IS NOT NULL)
SELECT session_id, id, CASE WHEN len(a) + len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS jaccard FROM w""")
def turn_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    p = captions(spark, folder).withColumn("before", F.lag("original").over(Window.partitionBy("session_id").orderBy("id"))).where("before is not null")
    return p.select("session_id", "id", metrics.jaccard(F.col("original"), F.col("before")).alias("jaccard"))


_CELLS = "SELECT session_id, c AS cell, arg_max(speaker_id, [start_s, end_s]) AS s FROM (SELECT *, unnest(range(CAST(floor(start_s / 0.02) AS BIGINT), CAST(ceil(end_s / 0.02) AS BIGINT))) AS c FROM {0}) GROUP BY 1, 2"


@query(f"""WITH {CAPTIONS}, hyp AS (SELECT session_id, CASE WHEN id % 3 = 0 THEN 'x' ELSE speaker_id END AS speaker_id, start_s + 0.5 AS start_s, end_s + 0.5 AS end_s FROM cap),
r AS ({_CELLS.format('cap')}), h AS ({_CELLS.format('hyp')}), j AS (SELECT coalesce(r.session_id, h.session_id) AS session_id, r.s AS r, h.s AS h FROM r FULL JOIN h ON r.session_id = h.session_id AND r.cell = h.cell)
SELECT session_id, count(r) AS speech, count(*) FILTER (h IS NULL) AS missed, count(*) FILTER (r IS NULL) AS false_alarm, count(*) FILTER (r <> h) AS confused,
CASE WHEN count(r) > 0 THEN (count(*) FILTER (h IS NULL) + count(*) FILTER (r IS NULL) + count(*) FILTER (r <> h))::DOUBLE / count(r) ELSE 0 END AS der FROM j GROUP BY 1""")
def diarization_errors(spark: SparkSession, folder: str) -> DataFrame:
    c = captions(spark, folder)
    late = c.withColumn("speaker_id", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("speaker_id"))).withColumn("start_s", F.col("start_s") + 0.5).withColumn("end_s", F.col("end_s") + 0.5)
    return metrics.diarization_errors(c, late)


@query("""WITH x AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1), u AS (SELECT label, sqrt(list_dot_product(v, v)) AS n, v FROM c),
s AS (SELECT e.vec_id, u.label, greatest(0, least(1, list_dot_product(CAST(e.embedding AS DOUBLE[]), u.v) / u.n)) AS score FROM embeddings e, u),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s)
SELECT a.vec_id, a.label AS speaker, round(a.score, 5) AS score, round(b.score, 5) AS second, a.score >= 0.58 OR (a.score >= 0.48 AND a.score - b.score >= 0.06) AS accepted FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.k = 1 AND b.k = 2""")
def speaker_match(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return speakers.match(e, speakers.profiles(e)).withColumn("score", F.round("score", 5)).withColumn("second", F.round("second", 5))


_ACCENTED, _PLAIN = "éèñßêçíüöóä", "ABCDEFGHIJK"  # DuckDB counts edits of bytes; after lower(), capitals are free to stand for letters of two bytes


@query(rf"""WITH RECURSIVE {CAPTIONS}, p AS (SELECT *, lag(original) OVER (PARTITION BY session_id ORDER BY id) AS before FROM cap),
w AS (SELECT session_id, id, regexp_extract_all(lower(original), '{WORD}') AS r, regexp_extract_all(lower(before), '{WORD}') AS h, translate(lower(regexp_replace(original, '^\s+|\s+$', '', 'g')), '{_ACCENTED}', '{_PLAIN}') AS a, translate(lower(regexp_replace(before, '^\s+|\s+$', '', 'g')), '{_ACCENTED}', '{_PLAIN}') AS b FROM p WHERE before IS NOT NULL),
d AS (SELECT session_id, id, CAST(0 AS BIGINT) AS i, j, CAST(j AS BIGINT) AS v FROM w, unnest(range(len(h) + 1)) AS t(j)
  UNION ALL SELECT session_id, id, i + 1, j, CAST(j + min(m - j) OVER (PARTITION BY session_id, id ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) FROM
  (SELECT d.session_id, d.id, d.i, d.j, least(d.v + 1, coalesce(lag(d.v) OVER (PARTITION BY d.session_id, d.id ORDER BY d.j) + CASE WHEN w.r[d.i + 1] = w.h[d.j] THEN 0 ELSE 1 END, d.v + 1)) AS m FROM d JOIN w ON w.session_id = d.session_id AND w.id = d.id WHERE d.i < len(w.r)))
SELECT w.session_id, w.id, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE d.v / len(r)::DOUBLE END AS wer,
  CASE WHEN a = '' THEN CASE WHEN b = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE levenshtein(a, b) / length(a)::DOUBLE END AS cer
FROM w JOIN d ON d.session_id = w.session_id AND d.id = w.id AND d.i = len(w.r) AND d.j = len(w.h)""")
def word_error_rates(spark: SparkSession, folder: str) -> DataFrame:
    p = captions(spark, folder).withColumn("before", F.lag("original").over(Window.partitionBy("session_id").orderBy("id"))).where("before is not null")
    return metrics.with_word_error_rate(p, "original", "before").select("session_id", "id", "wer", metrics.character_error_rate(F.col("original"), F.col("before")).alias("cer"))


@query()
def repaired_text(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "conversations")
    return T.with_repairs(t, "text", "r").select("conv_id", "turn", "r", T.drop_repetitions(F.col("text")).alias("once"), T.spoken(F.col("text")).alias("spoken")).select("conv_id", "turn", "r.*", "once", "spoken")


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns cut in halves, as a recognizer would give them."""
    c = captions(spark, folder)
    half = (F.length("original") / 2).cast("int")
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("text")) for k, t in ((0, F.left("original", half)), (1, F.substring("original", half + 1, F.length("original"))))]))
    span = (F.col("end_s") - F.col("start_s")) / 2
    return c.select("session_id", "id", "speaker_id", part.alias("p"), "start_s", span.alias("span")).select(
        "session_id", (F.col("id") * 2 + F.col("p.k")).alias("sequence_id"), "speaker_id", "p.text", (F.col("start_s") + F.col("p.k") * F.col("span")).alias("start_s"), (F.col("start_s") + (F.col("p.k") + 1) * F.col("span")).alias("end_s"),
        F.when(F.col("p.k") == 0, 100.0).otherwise(700.0).alias("pause_ms"), (F.col("p.k") == 0).alias("is_partial"), F.lit(0.9).alias("confidence"),
    )


@query()
def assembled_utterances(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.assemble(fragments(spark, folder))


@query()
def merged_by_pause(spark: SparkSession, folder: str) -> DataFrame:
    return merging.merge(fragments(spark, folder), "pause")


@query()
def merged_by_continuity(spark: SparkSession, folder: str) -> DataFrame:
    return merging.merge(fragments(spark, folder), "continuity")


@query(rf"""WITH {CAPTIONS}, h AS (SELECT *, regexp_matches(regexp_replace(left(original, CAST(length(original) // 2 AS INTEGER)), '^\s+|\s+$', '', 'g'), '[.!?]$') AS marked, (start_s + end_s) / 2 AS mid FROM cap),
q AS (SELECT *, regexp_replace(left(original, CAST(length(original) // 2 AS INTEGER)), '^\s+|\s+$', '', 'g') AS a, regexp_replace(substr(original, CAST(length(original) // 2 AS INTEGER) + 1), '^\s+|\s+$', '', 'g') AS b FROM h),
m AS (SELECT session_id, id, 0 AS k, speaker_id, start_s, mid AS end_s, 1 AS fragments, a AS text FROM q WHERE marked UNION ALL SELECT session_id, id, 1, speaker_id, CASE WHEN marked THEN mid ELSE start_s END, end_s, CASE WHEN marked THEN 1 ELSE 2 END,
  CASE WHEN marked THEN b WHEN regexp_matches(a, '[-—]$') OR regexp_matches(b, '^[,.?!]') THEN a || b ELSE a || ' ' || b END FROM q)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY id, k) AS utterance, speaker_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, fragments, text FROM m""")
def merged_by_marks(spark: SparkSession, folder: str) -> DataFrame:
    m = merging.merge(fragments(spark, folder), "buffer")
    return m.select("session_id", "utterance", "speaker_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.size("fragments").alias("fragments"), "text")


@query()
def tracked_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as pieces of a second each, in sessions of 64."""
    v = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("session_id"), F.col("vec_id").alias("segment"), F.lit(0).alias("piece"), (F.col("vec_id") * 2.0).alias("start_s"), (F.col("vec_id") * 2.0 + 1).alias("end_s"), F.lit(None).cast("string").alias("text"), F.col("embedding").cast("array<double>").alias("voiceprint"), F.lit(0.0).alias("pitch"), F.lit(True).alias("clean"), F.lit(None).cast("int").alias("source"))
    return tracking.track(v)


_LINKS = ", ".join(f"'{w}'" for w in rules.LINKS)
_AUX = ", ".join(f"'{w}'" for w in rules.ENGLISH_AUXILIARIES)
_VERBS = ", ".join(f"'{w}'" for w in rules.TRANSITIVE)


@query(rf"""WITH {CAPTIONS}, c AS (SELECT session_id, id, speaker_id, CASE WHEN id % 2 = 0 THEN original || ' I want to' ELSE original END AS t, start_s, end_s + 10 - id * 0.1::DOUBLE AS stop_s FROM cap),
p AS (SELECT *, lag(t) OVER w AS a, lag(stop_s) OVER w AS e FROM c WINDOW w AS (PARTITION BY session_id ORDER BY id)),
x AS (SELECT session_id, id, regexp_replace(a, '^\s+|\s+$', '', 'g') AS a, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b, greatest(0.0::DOUBLE, start_s - e) AS gap, regexp_extract_all(lower(a), '{WORD}') AS wa, regexp_extract_all(lower(t), '{WORD}') AS wb FROM p WHERE a IS NOT NULL),
y AS (SELECT *, regexp_matches(b, '^\p{{Ll}}') AND NOT starts_with(b, 'i ') AS small FROM x),
g AS (SELECT *, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.0::DOUBLE + CASE WHEN wa[-1] IN ({_LINKS}) THEN 0.45 ELSE 0 END::DOUBLE + CASE WHEN wa[-1] IN ({_AUX}) THEN 0.40 ELSE 0 END::DOUBLE + CASE WHEN wa[-1] IN ({_VERBS}) THEN 0.35 ELSE 0 END::DOUBLE
  + CASE WHEN wb[1] IN ({_LINKS}) THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN small THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(a, '(?:\.\.\.|…|-)$') THEN 0.35 ELSE 0 END::DOUBLE) END AS g FROM y),
z AS (SELECT session_id, id, gap, g, 0.25::DOUBLE * CASE WHEN gap <= 0.3 THEN 1 WHEN gap >= 1.4 THEN 0 ELSE 1 - (gap - 0.3::DOUBLE) / 1.1::DOUBLE END + 0.35::DOUBLE * g + 0.2::DOUBLE * CASE WHEN NOT regexp_matches(a, '[.!?]$') THEN 0.8 WHEN small THEN 0.4 ELSE 0.15 END::DOUBLE + 0.2::DOUBLE AS total FROM g)
SELECT session_id, id, round(total, 6) AS score, CASE WHEN gap >= 1.4 AND g < 0.85 THEN 'gap' WHEN total >= 0.5 AND g >= 0.25 THEN 'joined' ELSE 'apart' END AS reason FROM z""")
def continuity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Turns and the ones before as if one speaker said both; every other one is left open."""
    c = captions(spark, folder).withColumn("t", F.when(F.col("id") % 2 == 0, F.concat("original", F.lit(" I want to"))).otherwise(F.col("original"))).withColumn("stop_s", F.col("end_s") + 10 - F.col("id") * 0.1)
    w = Window.partitionBy("session_id").orderBy("id")
    p = c.withColumn("a", F.lag("t").over(w)).withColumn("e", F.lag("stop_s").over(w)).where("a is not null")
    one = F.lit("x")
    return p.withColumn("c", continuity(F.col("a"), one, F.col("e"), F.col("t"), one, F.col("start_s"))).select("session_id", "id", F.round("c.score", 6).alias("score"), "c.reason")


@query(rf"""WITH {CAPTIONS}, p AS (SELECT *, lag(original) OVER (PARTITION BY session_id ORDER BY id) AS before FROM cap),
x AS (SELECT session_id, id, lower(regexp_replace(original, '^\s+|\s+$', '', 'g')) AS truth, CASE id % 5 WHEN 4 THEN '' WHEN 3 THEN regexp_replace(original, '^\S+\s+', '') ELSE original END AS r, CASE id % 5 WHEN 4 THEN '' WHEN 3 THEN original ELSE coalesce(before, '') END AS f,
  CASE WHEN id % 11 = 10 THEN 0 WHEN id % 7 = 6 THEN 2000 ELSE 16000 END AS samples, CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0.01 END AS level, CASE WHEN id % 2 = 0 THEN 0.1 ELSE 0.0 END AS onset, id % 13 <> 12 AS kept, id % 4 <> 3 AS known FROM p),
y AS (SELECT session_id, id, samples, level > 0.015 AS loud, onset > 0.06 AS cut, samples < 2880 AS short, kept, CASE WHEN known THEN truth ELSE '' END AS t, regexp_replace(r, '^\s+|\s+$', '', 'g') AS raw, regexp_replace(f, '^\s+|\s+$', '', 'g') AS final FROM x),
w AS (SELECT *, raw = '' AS silent, list_filter(regexp_split_to_array(t, '\s+'), lambda v: v <> '') AS said, list_filter(regexp_split_to_array(lower(raw), '\s+'), lambda v: v <> '') AS heard FROM y),
k AS (SELECT *, len(heard) > 0 AND len(said) > len(heard) AND said[1] <> heard[1] AS first_lost FROM w)
SELECT session_id, id, CASE WHEN kept AND samples = 0 THEN 'audio no_samples' WHEN NOT silent AND final = '' THEN 'pipeline dropped' WHEN length(final) < 0.4 * length(raw) AND length(raw) > 8 THEN 'pipeline cut_short' WHEN NOT kept THEN 'unknown no_audio_kept'
  WHEN t <> '' AND silent AND (cut OR short) THEN 'audio clipped_or_short' WHEN t <> '' AND silent AND loud THEN 'recognition voice_without_text' WHEN t <> '' AND first_lost AND cut THEN 'audio first_word_clipped'
  WHEN silent AND loud AND NOT short AND cut THEN 'audio clipped' WHEN silent AND loud AND NOT short THEN 'recognition voice_without_text' ELSE 'none captured' END AS kind FROM k""")
def loss_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of which some come without text, some without their first word, and others as the turn before; with audio of several kinds, and the truth for most."""
    i = F.col("id")
    p = captions(spark, folder).withColumn("before", F.lag("original").over(Window.partitionBy("session_id").orderBy("id")))
    raw = F.when(i % 5 == 4, "").when(i % 5 == 3, F.regexp_replace("original", r"^\S+\s+", "")).otherwise(F.col("original"))
    final = F.when(i % 5 == 4, "").when(i % 5 == 3, F.col("original")).otherwise(F.coalesce("before", F.lit("")))
    marks = F.struct(F.when(i % 11 == 10, 0).when(i % 7 == 6, 2000).otherwise(16000).alias("samples"), F.when(i % 3 == 0, 0.1).otherwise(0.01).alias("level"), F.when(i % 2 == 0, 0.1).otherwise(0.0).alias("onset"))
    kind = loss(F.when(i % 13 != 12, marks), raw, final, F.when(i % 4 != 3, F.col("original")))
    return p.select("session_id", "id", F.concat_ws(" ", kind["kind"], kind["reason"]).alias("kind"))


_SHINE = " Su luz BRILLA a través, brilla también y también  brilla, y va  a funcionar; es una fiesta de lastima, no como una fiesta de lástima en absoluto, parte de pena, haciendo un diario o creando un diario, viene a traves."


def _natural_sql(x: str) -> str:
    for pattern, to in rules.NATURAL_SPANISH:
        x = f"regexp_replace({x}, '(?i){pattern}', '{to}', 'g')"
    return x


@query(f"SELECT doc_id, md5({_natural_sql(f"text || '{_SHINE}'")}) AS digest FROM documents")
def natural_spanish(spark: SparkSession, folder: str) -> DataFrame:
    t = F.concat("text", F.lit(_SHINE))
    return table(spark, folder, "documents").select("doc_id", F.md5(T.natural_spanish(t, F.lit("It works."))).alias("digest"))


@query(f"WITH {CAPTIONS} SELECT session_id, id, CASE WHEN speaker_id = 'user' THEN original ELSE 'x ' || original END AS translated FROM cap")
def translated_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of users stay, as they are in the target's language; a provider marks the others."""
    c = captions(spark, folder).select("session_id", "id", F.col("original").alias("text"), F.when(F.col("speaker_id") == "user", "es").otherwise("en").alias("language"), F.lit(True).alias("is_complete"), F.lit(False).alias("is_interrupted"))
    return providers.translate(c, {("en", "es"): lambda: lambda texts: "x " + texts}).select("session_id", "id", "translated")


def _heard_again(spark: SparkSession, folder: str) -> DataFrame:
    """Turns; each one with a mark more, cut short, said again much later, and another text at its time."""
    c = captions(spark, folder).select("session_id", F.col("id").alias("sequence_id"), "speaker_id", F.col("original").alias("text"), "start_s", "end_s", F.lit(0.9).alias("confidence"))
    t = F.col("text")
    short = F.left(t, (F.length(t) * 6 / 10).cast("int"))
    kinds = [(0, t, 0.0, 0.9), (1, F.concat(t, F.lit(" !")), 0.05, 0.8), (2, short, 0.1, 0.7), (3, t, 8.0, 0.6), (4, F.md5(F.concat_ws(" ", "session_id", "sequence_id")), 0.12, None)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("text"), F.lit(late).alias("late"), F.lit(sure).cast("double").alias("confidence")) for k, x, late, sure in kinds])).alias("x")
    return c.select("session_id", "sequence_id", "speaker_id", "start_s", "end_s", each).select("session_id", "sequence_id", "speaker_id", "x.kind", "x.text", (F.col("start_s") + F.col("x.late")).alias("start_s"), (F.col("end_s") + F.col("x.late")).alias("end_s"), "x.confidence")


_AGAIN = rf"""rows AS (SELECT session_id, id AS sequence_id, speaker_id, k AS kind, CASE k WHEN 1 THEN original || ' !' WHEN 2 THEN left(original, CAST(length(original) * 6 // 10 AS INTEGER)) WHEN 4 THEN md5(session_id || ' ' || id) ELSE original END AS text,
  start_s + [0.0, 0.05, 0.1, 8.0, 0.12][k + 1]::DOUBLE AS start_s, end_s + [0.0, 0.05, 0.1, 8.0, 0.12][k + 1]::DOUBLE AS end_s, [0.9, 0.8, 0.7, 0.6, NULL][k + 1]::DOUBLE AS confidence FROM cap, range(5) AS t(k)),
n AS (SELECT *, {_NORM.format('text')} AS norm, row_number() OVER (PARTITION BY session_id, speaker_id ORDER BY start_s, end_s) AS pos FROM rows)"""
#: Whether two normalized texts are alike by the rules for equal and for contained texts; others of these rows have little in common.
_ALIKE = "({0} <> '' AND {1} <> '' AND ({0} = {1} OR (contains({0}, {1}) AND 2 * length({1}) >= length({0})) OR (contains({1}, {0}) AND 2 * length({0}) >= length({1}))))"


@query(f"""WITH RECURSIVE {CAPTIONS}, {_AGAIN},
f AS (SELECT session_id, speaker_id, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(kind BIGINT, sequence_id BIGINT, norm VARCHAR, start_s DOUBLE, end_s DOUBLE)[]) AS kept FROM n GROUP BY 1, 2
  UNION ALL SELECT f.session_id, f.speaker_id, n.pos, CASE WHEN len(list_filter(f.kept, lambda k: n.start_s - k.end_s < 2.5 AND (least(k.end_s, n.end_s) > greatest(k.start_s, n.start_s) OR abs(k.start_s - n.start_s) <= 0.15) AND {_ALIKE.format('n.norm', 'k.norm')})) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'kind': CAST(n.kind AS BIGINT), 'sequence_id': CAST(n.sequence_id AS BIGINT), 'norm': n.norm, 'start_s': n.start_s, 'end_s': n.end_s}}) END FROM f JOIN n ON n.session_id = f.session_id AND n.speaker_id = f.speaker_id AND n.pos = f.pos + 1)
SELECT session_id, k.sequence_id AS sequence_id, CAST(k.kind AS INTEGER) AS kind, round(k.start_s, 6) AS start_s FROM (SELECT session_id, speaker_id, unnest(kept) AS k FROM f WHERE pos = (SELECT max(pos) FROM n WHERE n.session_id = f.session_id AND n.speaker_id = f.speaker_id))""")
def suppressed_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.suppress_repeats(_heard_again(spark, folder)).select("session_id", "sequence_id", "kind", F.round("start_s", 6).alias("start_s"))


@query(rf"""WITH {CAPTIONS}, {_AGAIN}, w AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda v: v <> '') AS words FROM n),
v AS (SELECT *, len(words) - 3 * len(list_filter(range(1, len(words)), lambda i: lower(words[i]) = lower(words[i + 1]))) + coalesce(confidence, 0) - CASE WHEN len(words) > 0 AND length(words[-1]) = 1 AND NOT contains('aiyoeu', lower(words[-1])) THEN 2.5 ELSE 0 END AS worth FROM w),
a AS (SELECT *, row_number() OVER (PARTITION BY session_id, sequence_id ORDER BY worth DESC, start_s) AS k FROM v WHERE kind <> 4)
SELECT session_id, sequence_id, CAST(kind AS INTEGER) AS kind FROM a WHERE k = 1 UNION ALL SELECT session_id, sequence_id, 4 FROM n WHERE kind = 4""")
def resolved_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Turns that are long enough to overlap with what is said again much later are of one utterance with it."""
    again = _heard_again(spark, folder).withColumn("start_s", F.when(F.col("kind") == 3, F.col("start_s") - 7.0).otherwise(F.col("start_s")))
    return duplicates.resolve_channels(again).select("session_id", "sequence_id", "kind")


@query("SELECT event_type, count(*) AS processed, round(arg_max(value * 1000, event_id), 1) AS last_value, round(avg(value * 1000), 1) AS avg_value FROM events GROUP BY 1")
def running_latency(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.running_latency(table(spark, folder, "events"), "event_type", "event_id", "value")


@query(f"WITH {CAPTIONS}, p AS (SELECT *, lag(speaker_id) OVER (PARTITION BY session_id ORDER BY start_s, id) AS previous FROM cap), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s DESC, id DESC) AS k FROM p WHERE previous <> speaker_id) SELECT session_id, id FROM k WHERE k <= 3")
def recent_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return context.recent_transitions(captions(spark, folder), 3).select("session_id", "id")


@query(f"""WITH {CAPTIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s, id) AS k FROM cap)
SELECT a.session_id, a.id, string_agg('[' || b.speaker_id || ']: ' || b.original, chr(10) ORDER BY b.k) AS script
FROM k a JOIN k b ON a.session_id = b.session_id AND b.k BETWEEN a.k - 3 AND a.k AND b.start_s >= a.start_s - 25 GROUP BY 1, 2""")
def dialogue_script(spark: SparkSession, folder: str) -> DataFrame:
    return context.as_script(captions(spark, folder), 4, 25.0).select("session_id", "id", "script")


@query(rf"""WITH {CAPTIONS}, t AS (SELECT *, regexp_replace(original, '^\s+|\s+$', '', 'g') AS a, CASE WHEN id % 4 = 1 THEN '' ELSE lower(left(original, 30)) END AS b FROM cap), u AS (SELECT *, regexp_replace(b, '^\s+|\s+$', '', 'g') AS c FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_s, id) AS k FROM u WHERE a <> '' AND c <> '')
SELECT x.session_id, x.id, coalesce((SELECT string_agg('EN: ' || y.a || ' -> ES: ' || y.c, chr(10) ORDER BY y.k) FROM k y WHERE y.session_id = x.session_id AND y.id <= x.id AND y.k > (SELECT max(z.k) FROM k z WHERE z.session_id = x.session_id AND z.id <= x.id) - 2), '') AS pairs FROM cap x""")
def dialogue_pairs(spark: SparkSession, folder: str) -> DataFrame:
    t = captions(spark, folder).withColumns({"translated": F.when(F.col("id") % 4 == 1, "").otherwise(F.lower(F.left("original", F.lit(30)))), "language": F.lit("en"), "target": F.lit("es")})
    return context.as_pairs(t, 2).select("session_id", "id", "pairs")


@query(f"""WITH {CAPTIONS}, c AS (SELECT session_id, id, floor(start_s / 30) * 30 AS a, start_s - floor(start_s / 30) * 30 - 2 AS s, end_s - floor(start_s / 30) * 30 AS e FROM cap)
SELECT session_id, id, greatest(a, a + s) AS start_s, round(least(a + 30, a + e), 6) AS end_s FROM c WHERE least(a + 30, a + e) > greatest(a, a + s)""")
def clamped_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments that begin before their chunk of 30 seconds or end after it are cut."""
    a = F.floor(F.col("start_s") / 30) * 30.0
    c = captions(spark, folder).select("session_id", "id", a.alias("chunk_start_s"), (a + 30).alias("chunk_end_s"), (F.col("start_s") - a - 2).alias("start_s"), (F.col("end_s") - a).alias("end_s"))
    return routing.clamped(c).select("session_id", "id", "start_s", F.round("end_s", 6).alias("end_s"))


@query("SELECT doc_id, lang AS language FROM documents WHERE lang IN ('es', 'en', 'pt')")
def known_languages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(F.col("lang").isin(*routing.LANGUAGES))
    return d.select("doc_id", routing.known_language(F.col("lang")).alias("language"))


_EDGE = r"([^\p{L}\p{M}\p{N}_]|^){0}([^\p{L}\p{M}\p{N}_]|$)"
_TERMS = {"de": "of", "la": "thé", "que": "that (which)"}


def _replaced_sql(x: str) -> str:
    for term, to in _TERMS.items():
        if to.isascii():
            for _ in range(2):  # what ends one term may begin the next
                x = f"regexp_replace({x}, '(?i){_EDGE.replace('{0}', term)}', '\\1{to}\\2', 'g')"
    return x


@query(rf"SELECT conv_id, turn, md5({_replaced_sql(r"trim(regexp_replace(text, '\s+', ' ', 'g'))")}) AS digest FROM conversations")
def cleaned_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", F.md5(T.clean_source(F.col("text"), _TERMS)).alias("digest"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 3 END) AS s FROM embeddings), p AS (SELECT *, list_max(list_transform(s, lambda x: abs(x))) AS p FROM s),
g AS (SELECT vec_id, CASE WHEN p > 0.001 AND p < 0.25 THEN list_transform(s, lambda x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * least(5.0::DOUBLE, 0.6::DOUBLE / p)))) ELSE s END AS g FROM p)
SELECT vec_id, round(list_max(list_transform(g, lambda x: abs(x))), 6) AS peak, round(list_sum(list_transform(g, lambda x: abs(x))), 6) AS total, CAST(list_sum(list_transform(g, lambda x: abs(CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) * 32767) AS INTEGER)))) AS BIGINT) AS pcm FROM g""")
def faint_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as samples, half of them faint: raised, and as 16-bit numbers."""
    v = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 2 == 0, 0.5).otherwise(3.0)).alias("s"))
    g = v.select("vec_id", arrays.raised(F.col("s")).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + F.abs(x))
    pcm = F.aggregate(arrays.pcm16(F.col("g")), F.lit(0).cast("long"), lambda a, x: a + F.abs(x.cast("long")))
    return g.select("vec_id", F.round(arrays.peak(F.col("g")), 6).alias("peak"), F.round(total, 6).alias("total"), pcm.alias("pcm"))


@query("""WITH x AS (SELECT vec_id, len(embedding) AS n, vec_id % 40 AS a, vec_id % 40 + vec_id % 9 AS b FROM embeddings), y AS (SELECT *, greatest(0, a - 8) AS lo, least(n, b + 8) AS hi FROM x)
SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 4 THEN n ELSE hi - lo END AS INTEGER) AS n, CASE WHEN vec_id % 5 = 4 THEN 2.0::DOUBLE ELSE 2 + lo / 16.0::DOUBLE END AS start_s, CASE WHEN vec_id % 5 = 4 THEN 2 + n / 16.0::DOUBLE ELSE 2 + hi / 16.0::DOUBLE END AS end_s FROM y""")
def regions_with_margins(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as samples at 16 a second from 2 s on; a region in most of them, with half a second around it."""
    i = F.col("vec_id")
    cut = arrays.with_margins(F.col("embedding"), F.lit(2.0), F.when(i % 5 != 4, 2 + (i % 40) / 16), 2 + (i % 40 + i % 9) / 16, rate=16)
    return table(spark, folder, "embeddings").select("vec_id", cut.alias("c")).select("vec_id", F.size("c.samples").alias("n"), "c.start_s", "c.end_s")


@query(f"WITH {CAPTIONS} SELECT session_id, id, round(end_s + 100 - greatest(0, end_s + 1 - (end_s + id % 3)), 6) AS captured_s FROM cap")
def capture_times(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that end before or after their segment, which was captured 100 s after the turn's end."""
    c = captions(spark, folder)
    parts = c.select("session_id", "id", (F.col("end_s") + F.col("id") % 3).alias("end_s"), (F.col("end_s") + 1).alias("segment_end_s"), (F.col("end_s") + 100).alias("segment_captured_s"))
    return routing.with_capture_times(parts).select("session_id", "id", F.round("captured_s", 6).alias("captured_s"))


@query(f"WITH {CAPTIONS} SELECT session_id, id FROM cap WHERE session_id % 7 = 0")
def orphan_captions(spark: SparkSession, folder: str) -> DataFrame:
    c = captions(spark, folder)
    return without_session(c, c.select("session_id").where("session_id % 7 <> 0").distinct()).select("session_id", "id")


@query(f"WITH {CAPTIONS} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY end_s, start_s) AS sequence_id, 'recognition' AS destination FROM cap")
def numbered_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as captured segments on the way without a separator."""
    c = captions(spark, folder).withColumn("captured_s", F.col("end_s"))
    return routing.presegmented(c, detect=False).select("session_id", "id", "sequence_id", "destination")


@query()
def dialogue_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Turns against themselves with a third left out and the rest half a second late."""
    c = captions(spark, folder).select("session_id", "id", "speaker_id", F.col("original").alias("text"), "start_s", "end_s")
    late = c.where("id % 3 <> 2").withColumn("start_s", F.col("start_s") + 0.5).withColumn("end_s", F.col("end_s") + 0.5)
    return evaluate.scorecard(c.drop("id"), late.drop("id"))
