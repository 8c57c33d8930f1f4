"""Queries on event journals, votes, manifests and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import journal as journals
from tessera.operators import joins, votes, windows
from tessera.plans.base import JOURNAL, Registry, journal
from tessera.session import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql
MINUTE = 60e6


@registry.add(f"""WITH {JOURNAL}, f AS (SELECT *, sequence = 1 AS f, sequence > 1 AND event = 'error' AS b FROM journal),
s AS (SELECT *, CASE WHEN f THEN 0 WHEN b THEN 1 ELSE CASE WHEN value > 50 THEN 1 ELSE -1 END END AS st FROM f),
p AS (SELECT user_id, sequence, sum(st) OVER w AS pos_, (sum(b::INT) OVER w)::INT AS segment FROM s WINDOW w AS (PARTITION BY user_id ORDER BY sequence))
SELECT user_id, sequence, segment, (pos_ - min(pos_) OVER (PARTITION BY user_id))::BIGINT AS position FROM p""")
def chain_segments(spark: SparkSession, d: str) -> DataFrame:
    step = F.when(F.col("value") > 50, 1).otherwise(-1)
    return windows.chain_segments(journal(spark, d), "user_id", ["sequence"], step, F.col("event") == "error").select(
        "user_id", "sequence", "segment", F.col("position").cast("long").alias("position")
    )


@registry.add("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS "value", count(*) AS captures FROM events GROUP BY ALL""")
def last_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return windows.last_wins(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@registry.add(f"""WITH {JOURNAL}, r AS (SELECT user_id, (sequence - 1) // 10 AS run, min(us) AS first_us, max(us) AS last_us FROM journal GROUP BY ALL),
n AS (SELECT *, lead(run) OVER w AS next_run, lead(first_us) OVER w AS nf FROM r WINDOW w AS (PARTITION BY user_id ORDER BY first_us, run))
SELECT user_id, run, next_run, round((nf - last_us) / 60e6, 1) AS gap_minutes FROM n WHERE next_run IS NOT NULL""")
def restart_gaps(spark: SparkSession, d: str) -> DataFrame:
    runs = journal(spark, d).groupBy("user_id", F.expr("(sequence - 1) div 10").alias("run")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    return windows.restart_gaps(runs, "user_id", "run", "first_us", "last_us", MINUTE).select("user_id", "run", "next_run", "gap_minutes")


@registry.add(f"""WITH {JOURNAL}, t AS (SELECT user_id, event_id, event, sequence, count(*) FILTER (WHERE event = 'purchase') OVER w AS captures_before, count(*) FILTER (WHERE event = 'purchase') OVER (PARTITION BY user_id) AS planned, round((us - first(us) OVER w) / 60e6, 1) AS elapsed_minutes FROM journal WINDOW w AS (PARTITION BY user_id ORDER BY sequence))
SELECT user_id, event_id, sequence, captures_before, planned, elapsed_minutes, round(captures_before::DOUBLE / nullif(planned, 0), 6) AS fraction FROM t WHERE event = 'error'""")
def incident_timeline(spark: SparkSession, d: str) -> DataFrame:
    j = journal(spark, d).drop("sequence")
    out = windows.incident_timeline(j, "user_id", ["us", "event_id"], "us", F.col("event") == "error", F.col("event") == "purchase", MINUTE)
    return out.select("user_id", "event_id", F.col("sequence").cast("long").alias("sequence"), "captures_before", "planned", "elapsed_minutes", "fraction")


@registry.add(f"""WITH {JOURNAL}, k AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY user_id ORDER BY sequence), 0) AS b FROM journal WHERE event <> 'view')
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE sequence - b <> 1) AS gaps, min(b + 1) FILTER (WHERE sequence - b > 1) AS first_missing, count(*) - count(DISTINCT event_id) AS duplicate_ids FROM k GROUP BY user_id HAVING count(*) FILTER (WHERE sequence - b <> 1) > 0""")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    # the journal without its view events: their numbers are what the check is to find
    return windows.sequence_faults(journal(spark, d).where("event <> 'view'"), "user_id", "sequence", "event_id")


@registry.add(f"""WITH {JOURNAL}, e AS (SELECT user_id, event_id, sequence, CASE WHEN sequence = 1 THEN 'history_started' WHEN event = 'signup' THEN 'history_closed' ELSE event END AS event FROM journal)
SELECT user_id, count(*) AS events, bool_and(true) AS contiguous, count(DISTINCT event_id) = count(*) AS unique_ids, arg_min(event, sequence) = 'history_started' AS starts, count(*) FILTER (WHERE event = 'history_started') = 1 AS one_start,
  coalesce(min(sequence) FILTER (WHERE event = 'history_closed') = max(sequence), true) AS nothing_after_close,
  count(*) FILTER (WHERE event = 'history_closed') > 0 AS closed,
  count(DISTINCT event_id) = count(*) AND arg_min(event, sequence) = 'history_started' AND count(*) FILTER (WHERE event = 'history_started') = 1 AND coalesce(min(sequence) FILTER (WHERE event = 'history_closed') = max(sequence), true) AS valid FROM e GROUP BY user_id""")
def journal_validation(spark: SparkSession, d: str) -> DataFrame:
    e = journal(spark, d).withColumn(
        "event", F.expr("case when sequence = 1 then 'history_started' when event = 'signup' then 'history_closed' else event end")
    )
    return journals.validate(e, "user_id")


@registry.add(f"""WITH {JOURNAL} SELECT user_id, count(*) AS events, count(DISTINCT event) AS kinds, arg_min(event, sequence) AS first_event, arg_max(event, sequence) AS last_event, min(us) AS started, max(us) AS ended, count(*) FILTER (WHERE event = 'purchase') AS captures, count(*) FILTER (WHERE event = 'error') AS incidents FROM journal GROUP BY user_id""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return journals.summary(
        journal(spark, d), "user_id", "us", F.col("sequence"), incident=F.col("event") == "error", capture=F.col("event") == "purchase"
    )


@registry.add(f"""WITH {JOURNAL}, s AS (SELECT *, (sum((event = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY sequence))::INT AS session FROM journal)
SELECT user_id, sequence, session, last_value(CASE WHEN event = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, session ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM s""")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest_state(
        journal(spark, d), "user_id", ["sequence"], F.col("event") == "signup", F.when(F.col("event") == "purchase", F.col("value"))
    ).select("user_id", "sequence", "session", "state")


@registry.add(f"""WITH {JOURNAL}, s AS (SELECT user_id, sequence, CASE WHEN value > 90 AND sequence = 2 THEN -1 ELSE event_id END AS event_id FROM journal WHERE sequence <= 20)
SELECT j.user_id, max(j.sequence) AS journal_sequence, coalesce(max(s.sequence), 0) AS snapshot_sequence, max(j.sequence) - coalesce(max(s.sequence), 0) AS lag, count(s.sequence) = count(*) FILTER (WHERE s.event_id = j.event_id) AS is_prefix
FROM journal j LEFT JOIN s ON s.user_id = j.user_id AND s.sequence = j.sequence GROUP BY j.user_id""")
def snapshot_lag(spark: SparkSession, d: str) -> DataFrame:
    j = journal(spark, d)
    snap = j.where("sequence <= 20").selectExpr("user_id", "sequence", "case when value > 90 and sequence = 2 then -1 else event_id end as event_id")
    return journals.snapshot_lag(j, snap, "user_id")


@registry.add("""WITH v AS (SELECT user_id, event_type AS category, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS nx, sum(n) OVER (PARTITION BY user_id) AS votes FROM v WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, category))
SELECT user_id, votes::BIGINT AS votes, CASE WHEN nx IS NULL OR nx < n THEN category END AS label, NULL::BOOLEAN AS decision, (nx IS NOT NULL AND nx >= n) OR n < votes AS split FROM r WHERE rn = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return votes.tally(table(spark, d, "events"), "user_id", "event_type", "value")


@registry.add("""WITH e AS (SELECT user_id, event_type, value, value > 50 AS yes FROM events), s AS (SELECT user_id, count(*) AS votes, count(*) FILTER (WHERE yes) AS y FROM e GROUP BY 1),
d AS (SELECT *, CASE WHEN 2 * y > votes THEN true WHEN 2 * y < votes THEN false END AS decision FROM s),
c AS (SELECT e.user_id, event_type, count(*) AS n, max(value) AS c FROM e JOIN d ON d.user_id = e.user_id AND e.yes = d.decision GROUP BY ALL),
b AS (SELECT user_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, c DESC, event_type) AS rn FROM c)
SELECT d.user_id, votes, label, decision, decision IS NULL OR (y > 0 AND y < votes) AS split, coalesce(decision AND NOT (decision IS NULL OR (y > 0 AND y < votes)), false) AS exclude, decision IS NULL OR (y > 0 AND y < votes) AS needs_human FROM d LEFT JOIN b ON b.user_id = d.user_id AND rn = 1""")
def decision_vote(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "events").withColumn("yes", F.col("value") > 50)
    return votes.keep_or_exclude(votes.tally(answers, "user_id", "event_type", "value", "yes"))


@registry.add("""WITH a AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT user_id, r, event_type, count(*) AS k, bool_or(n = 1 AND value > 90) AS sure FROM a JOIN (SELECT unnest([1, 3, 5]) AS r) ON n <= r GROUP BY ALL),
q AS (SELECT user_id, r, sum(k)::BIGINT AS used, max(k) AS most, bool_or(sure) AS sure, arg_min(event_type, (-k, event_type)) AS leader FROM p GROUP BY ALL),
f AS (SELECT *, (r = 1 AND sure) OR (r > 1 AND most * 2 > used) OR r = 5 AS done FROM q WHERE r = 1 OR used = r),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY done DESC, CASE WHEN done THEN r ELSE -r END) AS rn FROM f)
SELECT user_id, used, leader AS label, done AS settled FROM g WHERE rn = 1""")
def adaptive_vote(spark: SparkSession, d: str) -> DataFrame:
    return votes.adaptive_rounds(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", confident=F.col("value") > 90)


@registry.add("""SELECT d.doc_id, lang AS agent_value, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, lang) AS verdict, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END <> lang, false) AS overridden, l.doc_id IS NULL AS unmatched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def override_left_join(spark: SparkSession, d: str) -> DataFrame:
    verdicts = table(spark, d, "documents").select("doc_id", F.col("lang").alias("verdict"))
    human = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("verdict"))
    return votes.apply_overrides(verdicts, human, "doc_id", "verdict")


@registry.add("""WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS planned FROM orders WHERE o_orderpriority <> '1-URGENT'), a AS (SELECT l_orderkey AS k, max(l_linestatus) AS done FROM lineitem GROUP BY 1)
SELECT coalesce(p.k, a.k) AS k, planned, done, CASE WHEN a.k IS NULL THEN 'not done' WHEN p.k IS NULL THEN 'not planned' WHEN planned IS DISTINCT FROM done THEN 'differs' ELSE 'as planned' END AS state FROM p FULL JOIN a ON p.k = a.k""")
def plan_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").selectExpr("o_orderkey as k", "o_orderstatus as planned")
    actual = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("done"))
    return votes.plan_against_actual(plan, actual, ["k"], "planned", "done")


@registry.add("""SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type IN ('error', 'signup') AS flagged FROM events""")
def props_json_extract(spark: SparkSession, d: str) -> DataFrame:
    part = scalar.json_part(F.concat(F.lit("answer: "), F.col("props"), F.lit(" end")))
    return table(spark, d, "events").select(
        "event_id", F.get_json_object(part, "$.k").cast("long").alias("k"), F.col("event_type").isin("error", "signup").alias("flagged")
    )


@registry.add("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, substr(line, 1, 200) AS line FROM l WHERE regexp_matches(line, 'token = |rc=-1')""")
def console_line_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike("token = |rc=-1")).select(
        "doc_id", (F.col("n") + 1).cast("long").alias("line_no"), F.substring("line", 1, 200).alias("line")
    )


@registry.add("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '/([a-z]{2})/', 1) AS part, TRY_CAST(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') AS INT) AS idx, regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+') AS matches FROM pages""")
def name_layout_regex(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources import layouts

    return layouts.parse(
        table(spark, d, "pages").select("page_id", "url"), "url", {"scheme": r"^(https?)://", "part": r"/([a-z]{2})/", "idx": r"/[a-z]{2}/([0-9]+)"},
        r"^https?://[^/]+/[a-z]{2}/[0-9]+", ("idx",)
    ).drop("url")


@registry.add("""WITH p AS (SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS part, regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) AS idx, regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+') AS ok FROM pages)
SELECT part, count(*) AS n, count(*) FILTER (WHERE ok) AS matched, count(*) - count(DISTINCT idx) AS repeated, count(*) FILTER (WHERE ok) / count(*) >= 0.95 AS accepted FROM p GROUP BY part""")
def layout_validation(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources import layouts

    parsed = layouts.parse(table(spark, d, "pages").select("url"), "url", {"part": r"/([a-z]{2})/", "idx": r"/[a-z]{2}/([0-9]+)"}, r"^https?://[^/]+/[a-z]{2}/[0-9]+")
    return layouts.validate(parsed, "part", "idx")


@registry.add("SELECT regexp_replace(url, '[0-9]+', '#', 'g') AS shape, count(*) AS n, min(page_id) AS first_id FROM pages GROUP BY 1")
def shape_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(scalar.shape_of(F.col("url")).alias("shape")).agg(
        F.count("*").alias("n"), F.min("page_id").alias("first_id")
    )


@registry.add("""WITH f AS (SELECT doc_id AS path, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 , lang, source FROM documents), m AS (SELECT path, bytes, CASE WHEN source = 'src7' THEN 'changed' ELSE sha256 END AS sha256 FROM f WHERE lang <> 'es')
SELECT m.path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.bytes <> f.bytes OR m.sha256 <> f.sha256 THEN 'mismatch' ELSE 'ok' END AS state FROM m LEFT JOIN (SELECT * FROM f WHERE source <> 'src5') f ON f.path = m.path""")
def content_hash_manifest(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select(
        F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), "lang", "source"
    )
    # a manifest that lacks some files and has some changed, against files of which some are gone
    m = f.where("lang <> 'es'").withColumn("sha256", F.when(F.col("source") == "src7", "changed").otherwise(F.col("sha256")))
    return joins.manifest_check(m, f.where("source <> 'src5'"))


@registry.add("""WITH a AS (SELECT page_id AS path, sha256(html) AS h FROM pages WHERE url NOT LIKE '%#top'), b AS (SELECT page_id AS path, CASE WHEN url LIKE '%feed' THEN '' ELSE sha256(html) END AS h FROM pages WHERE url NOT LIKE '%.html')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'left only' WHEN a.path IS NULL THEN 'right only' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def manifest_difference(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.sha2("html", 256).alias("sha256"), "url")
    right = p.where("url not like '%.html'").withColumn("sha256", F.when(F.col("url").endswith("feed"), "").otherwise(F.col("sha256")))
    return joins.manifest_diff(p.where("url not like '%#top'"), right)


@registry.add("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id")
    ).where("copies > 1")


@registry.add("""SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS name, source IN ('src1', 'src0') AS listed, count(*) AS n FROM documents GROUP BY ALL""")
def alias_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    name = scalar.canonical(F.concat(F.lit(" "), F.upper("lang"), F.lit("_ ")), {"en": "english", "de": "german"})
    return table(spark, d, "documents").groupBy(name.alias("name"), F.col("source").isin("src1", "src0").alias("listed")).agg(F.count("*").alias("n"))


@registry.add("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS nth, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, nth, next_turn, next_role FROM t WHERE next_turn IS NOT NULL""")
def conversation_turn_order(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.serpentine_order(table(spark, d, "conversations"), "conv_id", "turn", F.lit(False)).select(
        "conv_id", "turn", "role", F.col("order").cast("long").alias("nth")
    )
    return windows.consecutive(rows, ["conv_id"], ["turn"], ["turn", "role"])


@registry.add("""WITH r AS (SELECT conv_id, bool_and(true) AS ok, count(*) AS refs FROM conversations GROUP BY 1) SELECT conv_id AS note_id, count(*) AS "references", bool_and(turn <= 4) AS valid FROM conversations GROUP BY conv_id""")
def note_references(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("event_id", F.concat_ws(":", "conv_id", "turn"))
    notes = c.groupBy(F.col("conv_id").alias("note_id")).agg(F.collect_list("event_id").alias("related_ids"), F.lit(4).alias("snapshot_sequence"))
    return journals.note_references(notes, c.select("event_id", F.col("turn").alias("sequence")))


@registry.add("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def event_count_maps(spark: SparkSession, d: str) -> DataFrame:
    counts = journals.event_counts(table(spark, d, "events"), "user_id", "event_type")
    return counts.select(
        "user_id", F.aggregate(F.map_values("event_counts"), F.lit(0).cast("long"), lambda a, b: a + b).alias("n"),
        F.size("event_counts").cast("long").alias("kinds")
    )


@registry.add("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE min(event_type) END AS worst, count(*) AS n FROM events GROUP BY user_id""")
def worst_verdict(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators import aggregates

    return aggregates.worst_of(table(spark, d, "events"), ["user_id"], "event_type", ["error", "purchase"])


@registry.add("""WITH n AS (SELECT event_id, value FROM events WHERE event_type IN ('error', 'view')), t AS (SELECT event_id, value FROM events WHERE event_type IN ('view', 'click'))
SELECT 'append' AS kind, count(*) AS n FROM n WHERE event_id NOT IN (SELECT event_id FROM t) UNION ALL SELECT 'conflict', count(*) FROM n JOIN t ON n.event_id = t.event_id WHERE n.value > 60""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    new = e.where("event_type in ('error', 'view')").select("event_id", F.when(F.col("value") > 60, -1.0).otherwise(F.col("value")).alias("value"))
    fresh, conflict = joins.insert_if_absent(e.where("event_type in ('view', 'click')").select("event_id", "value"), new, "event_id", "value")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(fresh, "append").unionByName(count(conflict, "conflict"))
