"""Queries of the mail pipeline and their DuckDB SQL, on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.functions import clock, headers, rules, text
from maillake.operators import analytics, catalog, features, mail, priority, reports
from maillake.session import materialise, spread
from maillake.sources.files import null_audit
from maillake.sources.tables import table


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_emails").select("file", "message", "source_path", "ingested_at"))


def _emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "emails")


def _list(c: str):
    return F.array_join(c, ";")


def _when(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def raw_messages(spark, d):
    return _raw(spark, d).select("file", F.length("message").alias("chars"), F.md5("message").alias("digest"), "source_path")


def null_audit_query(spark, d):
    return null_audit(_raw(spark, d))


def header_fields(spark, d):
    p = mail.parse_messages(_raw(spark, d))
    return p.select("file", "mailbox", "message_id", "date_raw", "sender", "subject", "transfer_encoding", "x_folder", "source_system")


def address_lists(spark, d):
    p = mail.parse_messages(_raw(spark, d))
    return p.select("file", *(_list(c).alias(c) for c in ("to_addresses", "cc_addresses", "bcc_addresses")))


def date_parse(spark, d):
    p = mail.parse_messages(_raw(spark, d))
    return p.select("file", "date_raw", F.unix_micros("sent_at").alias("sent_micros"), _when("sent_at_local").alias("sent_at_local"))


def body_decode(spark, d):
    p = mail.parse_messages(_raw(spark, d))
    return p.select("file", F.md5(text.full_body(F.col("body"), F.col("transfer_encoding"))).alias("body_full"))


def body_clean(spark, d):
    p = mail.parse_messages(_raw(spark, d))
    return p.select("file", text.clean_body(F.col("body"), F.col("transfer_encoding")).alias("body_clean"))


def subject_threads(spark, d):
    s = F.col("subject")
    return _emails(spark, d).select("message_id", text.thread_subject(s).alias("thread"), text.starts_with_mark(s, text.REPLY).alias("reply"), text.starts_with_mark(s, text.FORWARD).alias("forward"))


def clock_fix(spark, d):
    p = mail.parse_messages(_raw(spark, d)).where("sent_at IS NOT NULL")
    fixed = clock.corrected(F.col("sent_at"), F.col("source_system"))
    return p.select("file", "source_system", _when(clock.office_time(fixed)).alias("office_time"))


def _judged(spark, d):
    judged = mail.with_reason(mail.parse_messages(_raw(spark, d))).select("file", "message_id", "sender", "reason")
    return materialise(spark, judged, "judged")


def quality_pass(spark, d):
    return _judged(spark, d).where("reason IS NULL").select("file", "message_id", "sender")


def quality_quarantine(spark, d):
    return _judged(spark, d).where("reason IS NOT NULL").select("file", "message_id", "sender", "reason")


def _clean(spark, d):
    return mail.clean_columns(mail.split_by_quality(mail.parse_messages(_raw(spark, d)))[0])


def dedup_by_id(spark, d):
    return mail.deduplicate(_clean(spark, d))[0].select("message_id", "file", "body_hash")


def dedup_by_content(spark, d):
    return mail.deduplicate(_clean(spark, d))[1].select("message_id", "file", "body_hash")


def recipients(spark, d):
    return mail.recipient_rows(_emails(spark, d))


def run_metrics(spark, d):
    _, _, _, counts = mail.load_archive(_raw(spark, d), max_share=1.0)
    return spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "metric string, value bigint")


def _flagged(spark, d):
    return analytics.with_flags(_emails(spark, d))


def flags(spark, d):
    return _flagged(spark, d).select("message_id", "is_internal", "is_meeting", "is_after_hours", "is_weekend")


def urgency_flags(spark, d):
    e = _emails(spark, d)
    joined = rules.joined(F.col("subject"), F.col("body_clean"))
    return e.select("message_id", F.coalesce(F.contains("body_clean", F.lit("?")), F.lit(False)).alias("has_question"), *(F.rlike(joined, F.lit(p)).alias(n) for n, p in rules.URGENCY.items()))


def weekly_volume(spark, d):
    return analytics.weekly_volume(_flagged(spark, d))


def monthly_categories(spark, d):
    return analytics.monthly_categories(_flagged(spark, d))


def _pairs(spark, d):
    return analytics.match_replies(_emails(spark, d))


def reply_pairs(spark, d):
    p = _pairs(spark, d)
    return p.select("reply_id", "original_id", "replier", "original_sender", "subject_normalised", F.unix_micros("original_sent_at").alias("original_micros"), F.unix_micros("reply_sent_at").alias("reply_micros"), F.round("response_minutes", 3).alias("response_minutes"))


def person_activity(spark, d):
    return analytics.person_activity(_flagged(spark, d), mail.recipient_rows(_emails(spark, d)), _pairs(spark, d))


def top_senders(spark, d):
    return analytics.top_senders(person_activity(spark, d))


def response_buckets(spark, d):
    return analytics.response_buckets(table(spark, d, "reply_pairs"))


def reply_speed(spark, d):
    return analytics.reply_speed(table(spark, d, "reply_pairs"))


def headline_totals(spark, d):
    return analytics.headline_totals(_flagged(spark, d))


def busiest_week(spark, d):
    return analytics.busiest_week(weekly_volume(spark, d))


def weighted_meeting_share(spark, d):
    return analytics.weighted_share(monthly_categories(spark, d), "meeting_share")


def latest_run(spark, d):
    q = table(spark, d, "dq_quarantine").where("reason IS NOT NULL")
    runs = q.groupBy(F.date_trunc("day", "quarantined_at").cast("date").alias("run_at"), "reason").agg(F.count("*").alias("value"))
    return analytics.latest_run(runs)


def mailbox_owners(spark, d):
    return features.mailbox_owners(_emails(spark, d))


def reply_labels(spark, d):
    return features.reply_labels(_pairs(spark, d))


def content_features(spark, d):
    names = [c for c in features.FEATURES if c not in ("prior_emails_to_recipients", "prior_replies_from_recipients")]
    return features.content_features(_heavy(spark, d)).select("message_id", *names)


def _heavy(spark, d):
    """Mails for much work on each row."""
    return spread(_emails(spark, d))


def _edges(spark, d):
    e = _emails(spark, d)
    return features.sent_to(e, mail.recipient_rows(e))


def contact_history(spark, d):
    return features.contact_history(_edges(spark, d))


def reply_history(spark, d):
    return features.reply_history(_edges(spark, d), _pairs(spark, d))


def eligible_mail(spark, d):
    return features.eligible_mail(_edges(spark, d), mailbox_owners(spark, d))


def _features(spark, d):
    e = _heavy(spark, d)
    return features.message_features(e, mail.recipient_rows(e), _pairs(spark, d))


def message_features(spark, d):
    return _features(spark, d).select("message_id", *features.FEATURES, features.LABEL)


def class_weights(spark, d):
    """Weight of a positive row, over all features."""
    return priority.class_weights(_features(spark, d)).groupBy(features.LABEL).agg(F.round(F.max("class_weight"), 6).alias("class_weight"))


def threshold_sweep(spark, d):
    """The sweep on a score that SQL can compute: earlier replies against all earlier mail."""
    score = (F.col("prior_replies_from_recipients") / (F.col("prior_replies_from_recipients") + 1)).cast("double")
    swept = priority.threshold_sweep(_features(spark, d).withColumn("score", score))
    return swept.select("threshold", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


def rule_baseline(spark, d):
    m = priority.metrics_of(_features(spark, d), F.col("prior_replies_from_recipients") > 0)
    return spark.createDataFrame([("prior_reply_rule", round(m.precision, 6), round(m.recall, 6), round(m.f1, 6), int(m.positives))], "model string, precision double, recall double, f1 double, positives bigint")


def time_split(spark, d):
    before, after, cut = priority.time_split(_emails(spark, d).select("message_id", "sent_at"), 0.2)
    return before.select("message_id", F.lit("train").alias("part"), F.lit(cut).alias("cut")).union(after.select("message_id", F.lit("test"), F.lit(cut)))


def priority_model(spark, d):
    """Full settings, all rows."""
    _, results = priority.train(_features(spark, d))
    return results


def governance_ddl(spark, d):
    return spark.createDataFrame([(k, s) for k, s in enumerate(catalog.statements("data-team"))], "position int, statement string")


def data_dictionary(spark, d):
    return catalog.dictionary_rows(spark)


#: Registered tables that the archive has as files.
_FILED = {"bronze.raw_emails": "raw_emails", "silver.emails": "emails", "silver.recipients": "recipients", "silver.dq_quarantine": "dq_quarantine", "gold.reply_pairs": "reply_pairs"}


def documented_columns(spark, d):
    """Columns that the registry knows of the archive's tables; SQL reads them off the tables themselves."""
    rows = spark.createDataFrame(list(_FILED.items()), "table_name string, filed_as string")
    return catalog.dictionary_rows(spark).join(F.broadcast(rows), "table_name").select("filed_as", "column_name")


def personal_columns(spark, d):
    return catalog.personal_columns(spark)


def rule_quality(spark, d):
    """The meeting rule over labelled mails; here a label says that the Subject line speaks of a meeting."""
    labelled = _raw(spark, d).dropDuplicates(["file"]).select("file", "message")
    subject = headers.header(headers.header_block(F.col("message")), "Subject")
    return analytics.labelled_rule_quality(labelled.withColumn("is_meeting", F.rlike(subject, F.lit(r"(?i)\bmeeting"))))


def chart_weeks(spark, d):
    return reports.chart_weeks(weekly_volume(spark, d))


def chart_months(spark, d):
    """Months with at least 20 mails; the report's floor is for the full archive."""
    return reports.chart_months(monthly_categories(spark, d), 20)


def share_gate(spark, d):
    """Share of quarantined rows and whether the default limit lets the load pass."""
    judged = _judged(spark, d)
    share = F.count("reason") / F.count("*")
    return judged.agg(F.round(share, 6).alias("share"), (share <= mail.MAX_QUARANTINE_SHARE).alias("passes"))


QUERIES = {
    "raw_messages": raw_messages, "null_audit": null_audit_query, "header_fields": header_fields, "address_lists": address_lists,
    "date_parse": date_parse, "body_decode": body_decode, "body_clean": body_clean, "subject_threads": subject_threads, "clock_fix": clock_fix,
    "quality_pass": quality_pass, "quality_quarantine": quality_quarantine, "dedup_by_id": dedup_by_id, "dedup_by_content": dedup_by_content,
    "recipients": recipients, "run_metrics": run_metrics, "flags": flags, "urgency_flags": urgency_flags, "weekly_volume": weekly_volume,
    "monthly_categories": monthly_categories, "reply_pairs": reply_pairs, "person_activity": person_activity, "top_senders": top_senders,
    "response_buckets": response_buckets, "reply_speed": reply_speed, "headline_totals": headline_totals, "busiest_week": busiest_week,
    "weighted_meeting_share": weighted_meeting_share, "latest_run": latest_run, "mailbox_owners": mailbox_owners, "reply_labels": reply_labels,
    "content_features": content_features, "contact_history": contact_history, "reply_history": reply_history, "eligible_mail": eligible_mail,
    "message_features": message_features, "class_weights": class_weights, "threshold_sweep": threshold_sweep, "rule_baseline": rule_baseline,
    "time_split": time_split, "priority_model": priority_model, "governance_ddl": governance_ddl, "data_dictionary": data_dictionary,
    "documented_columns": documented_columns, "personal_columns": personal_columns, "rule_quality": rule_quality, "chart_weeks": chart_weeks,
    "chart_months": chart_months, "share_gate": share_gate,
}

# --- DuckDB SQL --------------------------------------------------------------------------------
# Patterns, bounds and names are written out here on their own, so a wrong one in the operators shows.

_HEADER = "nullif(trim(regexp_extract(block, '(?im)^{0}:[ \\t]*([^\\n]*)', 1)), '')"
_ADDRESS = "CASE WHEN length(regexp_extract(lower(trim({0})), '<([^>]*)>', 1)) > 0 THEN trim(regexp_extract(lower(trim({0})), '<([^>]*)>', 1)) ELSE lower(trim({0})) END"


def _sql_header(name: str) -> str:
    return _HEADER.format(name)


def _sql_addresses(name: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({_sql_header(name)}, ''), ','), lambda a: {_ADDRESS.format('a')}), lambda a: length(a) > 0)"


_Q = "'\"'"
_PARSED = rf"""
text_rows AS (SELECT file, regexp_replace(message, '\r\n?', chr(10), 'g') AS t FROM raw_emails),
split_rows AS (SELECT file,
    regexp_replace(CASE WHEN instr(t, chr(10) || chr(10)) > 1 THEN substr(t, 1, instr(t, chr(10) || chr(10)) - 1) ELSE t END, '\n[ \t]+', ' ', 'g') AS block,
    CASE WHEN instr(t, chr(10) || chr(10)) > 0 THEN substr(t, instr(t, chr(10) || chr(10)) + 2) ELSE '' END AS body FROM text_rows),
named AS (SELECT file, body, split_part(file, '/', 1) AS mailbox, regexp_replace({_sql_header('Message-ID')}, '^<|>$', '', 'g') AS message_id,
    {_sql_header('Date')} AS date_raw, {_sql_header('From')} AS from_raw, {_sql_addresses('To')} AS to_addresses, {_sql_addresses('Cc')} AS cc_addresses,
    {_sql_addresses('Bcc')} AS bcc_addresses, {_sql_header('Subject')} AS subject, lower({_sql_header('Content-Transfer-Encoding')}) AS transfer_encoding,
    {_sql_header('X-Folder')} AS x_folder, coalesce(lower({_sql_header('X-FileName')}), '') AS file_name FROM split_rows),
dated AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(date_raw, '\s*\([^)]*\)\s*$', ''), '^[A-Za-z]{{3}},\s*', ''), '\s+', ' ', 'g')) AS bare FROM named),
cut AS (SELECT *, regexp_matches(bare, '^\d{{1,2}} [A-Za-z]{{3}} \d{{4}} \d{{2}}:\d{{2}}(:\d{{2}})?( [+-]\d{{4}})?$') AS known,
    regexp_extract(bare, '^(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) (\d{{2}}:\d{{2}})(:\d{{2}})?( [+-]\d{{4}})?$', ['d', 'm', 'y', 't', 's', 'o']) AS p FROM dated),
timed AS (SELECT *, instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(p.m)) AS place FROM cut),
walls AS (SELECT *, CASE WHEN known AND place % 3 = 1 THEN try_cast(p.y || '-' || lpad(((place + 2) // 3)::VARCHAR, 2, '0') || '-' || lpad(p.d, 2, '0') || ' ' || p.t || CASE WHEN p.s = '' THEN ':00' ELSE p.s END AS TIMESTAMP) END AS sent_at_local FROM timed),
parsed AS (SELECT *, CASE WHEN p.o <> '' AND substr(p.o, 3, 2)::INT <= 18 AND substr(p.o, 5, 2)::INT < 60 THEN
        sent_at_local - to_seconds((CASE WHEN substr(p.o, 2, 1) = '-' THEN -1 ELSE 1 END) * (substr(p.o, 3, 2)::INT * 3600 + substr(p.o, 5, 2)::INT * 60)) END AS sent_at,
    {_ADDRESS.format('from_raw')} AS sender,
    CASE WHEN ends_with(trim(file_name), '.nsf') THEN 'lotus_notes' WHEN ends_with(trim(file_name), '.pst') THEN 'outlook' ELSE 'unknown' END AS source_system FROM walls)"""
_JUDGED = _PARSED + """,
judged AS (SELECT *, nullif(concat_ws('; ', CASE WHEN message_id IS NULL THEN 'missing_message_id' END, CASE WHEN sent_at IS NULL THEN 'unparseable_date' END,
    CASE WHEN year(sent_at) < 1998 OR year(sent_at) > 2002 THEN 'date_out_of_range' END, CASE WHEN sender IS NULL THEN 'missing_sender' END), '') AS reason FROM parsed)"""


def _sql_decoded() -> str:
    t = "replace(body, '=' || chr(10), '')"
    for code, char in (("=09", "chr(9)"), ("=20", "' '"), ("=3D", "'='"), ("=91", "chr(39)"), ("=92", "chr(39)"), ("=93", "chr(34)"), ("=94", "chr(34)"), ("=96", "'-'"), ("=97", "'-'")):
        t = f"replace({t}, '{code}', {char})"
    return f"CASE WHEN transfer_encoding = 'quoted-printable' THEN regexp_replace({t}, '=[0-9A-F]{{2}}', '', 'g') ELSE body END"


_ONE_LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_FULL = _ONE_LINE.format(_sql_decoded())
#: Where quoted text or a signature begins, one pattern for each of its forms; the body ends at the first that is met.
_CUTS = [
    r"--+\s*Original Message\s*--+", r"------*\s*Forwarded by", r"From:[ \t].*\n(?:.*\n){0,3}?[ \t]*(?:To|Sent|Date):", r"To:[ \t]", r"On .{0,100}wrote:", r">",
    r".*\n[ \t]*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*[AP]M[ \t]*\n(?:[ \t]*\n)*[ \t]*To:",
    r".*[^\s][ \t]+(?:on[ \t]+)?[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*[AP]M[ \t]*\n(?:[ \t]*\n)*[ \t]*To:",
    r"--[ \t]*(?:\n|$)",
]


def _sql_clean() -> str:
    decoded = _sql_decoded()
    return _ONE_LINE.format(f"regexp_replace({decoded}, '(?s)(?m:^)[ \\t]*(?:{'|'.join(f'(?-s:{c})' for c in _CUTS)}).*', '')")


_CLEAN = _sql_clean()
_FIXED = "CASE WHEN source_system = 'lotus_notes' THEN ((sent_at AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC') ELSE sent_at END"
_SILVER = _JUDGED + f""",
silver AS (SELECT message_id, file, sender, subject, {_FIXED} AS sent_fixed, sha256(body) AS body_hash FROM judged WHERE reason IS NULL),
by_id AS (SELECT * FROM silver QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY file) = 1),
by_content AS (SELECT * FROM by_id QUALIFY row_number() OVER (PARTITION BY sender, sent_fixed, subject, body_hash ORDER BY file) = 1)"""
_EVERYONE = "list_concat(coalesce(to_addresses, []::VARCHAR[]), coalesce(cc_addresses, []::VARCHAR[]))"
_MEETING = r"(?i)\b(meeting|meetings|appointment|appointments|conference call|conference calls|conf call|conf calls|conf\. call|conf\. calls|reschedule|rescheduled|postponed|canceled|cancelled|agenda|lets meet|let''s meet|can we meet|could we meet|to meet)\b"
_FLAGGED = rf"""
flagged AS (SELECT *, {_EVERYONE} AS everyone,
    ends_with(sender, '@northmere.example') AND len({_EVERYONE}) > 0 AND len(list_filter({_EVERYONE}, lambda r: NOT ends_with(r, '@northmere.example'))) = 0 AS is_internal,
    regexp_matches(coalesce(subject, '') || ' ' || coalesce(body_full, ''), '{_MEETING}') AS is_meeting,
    isodow(sent_at_houston) >= 6 AS is_weekend,
    isodow(sent_at_houston) >= 6 OR hour(sent_at_houston) < 8 OR hour(sent_at_houston) >= 19 AS is_after_hours FROM emails)"""
_WEEKLY = _FLAGGED + """,
weekly AS (SELECT date_trunc('week', sent_at_houston)::DATE AS week_start, count(*) AS total_emails, count(*) FILTER (WHERE is_internal) AS internal_emails,
    count(*) - count(*) FILTER (WHERE is_internal) AS external_emails FROM flagged GROUP BY 1)"""
_MONTHLY = _FLAGGED + """,
monthly AS (SELECT date_trunc('month', sent_at_houston)::DATE AS month, count(*) AS total_emails, count(*) FILTER (WHERE is_meeting) AS meeting_emails,
    round(count(*) FILTER (WHERE is_meeting) / count(*), 4) AS meeting_share, count(*) FILTER (WHERE is_after_hours) AS after_hours_emails,
    round(count(*) FILTER (WHERE is_after_hours) / count(*), 4) AS after_hours_share, count(*) FILTER (WHERE is_weekend) AS weekend_emails FROM flagged GROUP BY 1)"""
_PAIRS = f"""
timely AS (SELECT message_id, sender, subject_normalised, is_reply, epoch_us(sent_at) AS moment, list_distinct({_EVERYONE}) AS everyone FROM emails WHERE sent_at IS NOT NULL),
asks AS (SELECT message_id AS reply_id, sender AS replier, subject_normalised, moment AS reply_at, unnest(everyone) AS original_sender FROM timely WHERE is_reply AND subject_normalised <> ''),
met AS (SELECT r.*, o.message_id AS original_id, o.moment AS original_at FROM asks r JOIN timely o ON o.subject_normalised = r.subject_normalised AND o.sender = r.original_sender
    AND o.moment < r.reply_at AND o.moment >= r.reply_at - 1209600000000 AND list_contains(o.everyone, r.replier) AND r.replier <> r.original_sender),
pairs AS (SELECT reply_id, original_id, replier, original_sender, subject_normalised, original_at, reply_at, (floor(reply_at / 1000000) - floor(original_at / 1000000)) / 60 AS response_minutes
    FROM met QUALIFY row_number() OVER (PARTITION BY reply_id ORDER BY original_at DESC, original_id) = 1)"""
_RECIPIENTS = """
every_recipient AS (SELECT message_id, unnest(coalesce(to_addresses, []::VARCHAR[])) AS recipient, 'to' AS kind FROM emails UNION ALL SELECT message_id, unnest(coalesce(cc_addresses, []::VARCHAR[])), 'cc' FROM emails),
rcp AS (SELECT message_id, recipient, max(kind) AS recipient_type FROM every_recipient GROUP BY 1, 2)"""
_PEOPLE = _FLAGGED + "," + _RECIPIENTS + "," + _PAIRS + """,
sent AS (SELECT sender AS person, count(*) AS sent_count, round(avg(CASE WHEN is_after_hours THEN 1 WHEN NOT is_after_hours THEN 0 END), 4) AS after_hours_sent_share FROM flagged GROUP BY 1),
received AS (SELECT recipient AS person, count(*) AS received_count FROM rcp GROUP BY 1),
replied AS (SELECT replier AS person, count(*) AS replies_matched, round(median(response_minutes), 1) AS median_response_minutes FROM pairs GROUP BY 1),
people AS (SELECT person, coalesce(sent_count, 0) AS sent_count, after_hours_sent_share, coalesce(received_count, 0) AS received_count, coalesce(replies_matched, 0) AS replies_matched,
    median_response_minutes, ends_with(person, '@northmere.example') AS is_own FROM (sent FULL JOIN received USING (person)) LEFT JOIN replied USING (person))"""
_EDGES = _RECIPIENTS + """,
edges AS (SELECT r.*, e.sender, epoch_us(e.sent_at) AS moment FROM rcp r JOIN emails e USING (message_id))"""
_OWNERS = """
owned AS (SELECT mailbox, sender, count(*) AS n FROM emails GROUP BY 1, 2),
owners AS (SELECT mailbox, sender AS owner FROM owned QUALIFY row_number() OVER (PARTITION BY mailbox ORDER BY n DESC, sender NULLS FIRST) = 1)"""
_CONTACT = """
contacts AS (SELECT message_id, max(prior) AS prior_emails_to_recipients FROM (SELECT message_id, row_number() OVER (PARTITION BY sender, recipient ORDER BY moment NULLS FIRST, message_id) - 1 AS prior FROM edges) GROUP BY 1)"""
_HISTORY = """
moments AS (SELECT message_id, sender AS author, recipient AS replier, moment, 0 AS past FROM edges UNION ALL SELECT NULL, original_sender, replier, reply_at, 1 FROM pairs),
history AS (SELECT message_id, sum(seen)::BIGINT AS prior_replies_from_recipients FROM (SELECT *, sum(past) OVER (PARTITION BY replier, author ORDER BY moment NULLS FIRST, past ROWS UNBOUNDED PRECEDING) AS seen FROM moments) WHERE past = 0 GROUP BY 1)"""
_ELIGIBLE = """
eligible AS (SELECT DISTINCT message_id FROM edges WHERE recipient_type = 'to' AND sender <> recipient AND recipient IN (SELECT owner FROM owners))"""
_LABELS = """
labels AS (SELECT original_id AS message_id, CASE WHEN min(response_minutes) <= 120 THEN 1 ELSE 0 END AS label_replied_2h FROM pairs GROUP BY 1)"""


_URGENT = {
    "has_urgent": r"(?i)\burgent\b", "has_asap": r"(?i)(\basap\b|as soon as possible)", "has_deadline": r"(?i)(\bdeadline\b|\bby (today|tomorrow|eod|end of day|end of the day)\b)",
    "has_action_request": r"(?i)\bplease (respond|reply|confirm|review|advise|call|let me know)\b", "has_important": r"(?i)\bimportant\b",
}
_FEATURES = (
    "body_length word_count to_count cc_count recipient_count is_reply is_forward thread_position has_question sender_is_internal sender_prior_emails prior_emails_to_recipients "
    "prior_replies_from_recipients hour_sent weekday_sent is_after_hours is_meeting has_urgent has_asap has_deadline has_action_request has_important"
).split()


def _sql_urgency(as_int: bool) -> str:
    return ", ".join(
        (f"CASE WHEN {m} THEN 1 ELSE 0 END AS {n}" if as_int else f"{m} AS {n}")
        for n, p in _URGENT.items()
        for m in [f"regexp_matches(concat_ws(' ', coalesce(subject, ''), coalesce(body_clean, '')), '{p}')"]
    )


_CONTENT = _FLAGGED + rf""",
content AS (SELECT message_id, coalesce(length(body_clean), 0)::INT AS body_length, len(list_filter(regexp_split_to_array(coalesce(body_clean, ''), '\s+'), lambda w: w <> ''))::INT AS word_count,
    coalesce(len(to_addresses), 0)::INT AS to_count, coalesce(len(cc_addresses), 0)::INT AS cc_count, (coalesce(len(to_addresses), 0) + coalesce(len(cc_addresses), 0))::INT AS recipient_count,
    CASE WHEN is_reply THEN 1 ELSE 0 END AS is_reply, CASE WHEN is_forward THEN 1 ELSE 0 END AS is_forward,
    CASE WHEN subject_normalised = '' THEN 0 ELSE row_number() OVER (PARTITION BY subject_normalised ORDER BY epoch_us(sent_at) NULLS FIRST, message_id) - 1 END::INT AS thread_position,
    CASE WHEN contains(body_clean, '?') THEN 1 ELSE 0 END AS has_question, CASE WHEN ends_with(sender, '@northmere.example') THEN 1 ELSE 0 END AS sender_is_internal,
    (row_number() OVER (PARTITION BY sender ORDER BY epoch_us(sent_at) NULLS FIRST, message_id) - 1)::INT AS sender_prior_emails,
    hour(sent_at_houston)::INT AS hour_sent, (dayofweek(sent_at_houston) + 1)::INT AS weekday_sent, CASE WHEN is_after_hours THEN 1 ELSE 0 END AS is_after_hours,
    CASE WHEN is_meeting THEN 1 ELSE 0 END AS is_meeting, {_sql_urgency(True)} FROM flagged)"""
_ALL_FEATURES = ",".join([_CONTENT, _EDGES, _PAIRS, _OWNERS, _CONTACT, _HISTORY, _ELIGIBLE, _LABELS]) + f""",
feats AS (SELECT message_id, {', '.join(f'coalesce({c}, 0) AS {c}' if c.startswith('prior_') else c for c in _FEATURES)}, coalesce(label_replied_2h, 0) AS label_replied_2h
    FROM content JOIN eligible USING (message_id) LEFT JOIN contacts USING (message_id) LEFT JOIN history USING (message_id) LEFT JOIN labels USING (message_id))"""
_SCORED = _ALL_FEATURES + """,
scored AS (SELECT label_replied_2h AS y, prior_replies_from_recipients / (prior_replies_from_recipients + 1) AS score, prior_replies_from_recipients > 0 AS said FROM feats)"""
_THRESHOLDS = ", ".join(f"({t / 100}::DOUBLE)" for t in range(10, 100, 5))
_F1 = "CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END"
_BUCKET_ROWS = "('<15 min', 0, 0, 15), ('15-60 min', 1, 15, 60), ('1-2 h', 2, 60, 120), ('2-4 h', 3, 120, 240), ('4-8 h', 4, 240, 480), ('8-24 h', 5, 480, 1440), ('1-3 days', 6, 1440, 4320), ('3-14 days', 7, 4320, 20160)"
_KNOWN = "response_minutes IS NOT NULL AND NOT isnan(response_minutes)"


ORACLES = {
    "raw_messages": "SELECT file, length(message)::INT AS chars, md5(message) AS digest, source_path FROM raw_emails",
    "null_audit": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM raw_emails" for c in ("file", "message", "source_path", "ingested_at")),
    "header_fields": f"WITH {_PARSED} SELECT file, mailbox, message_id, date_raw, sender, subject, transfer_encoding, x_folder, source_system FROM parsed",
    "address_lists": f"WITH {_PARSED} SELECT file, array_to_string(to_addresses, ';') AS to_addresses, array_to_string(cc_addresses, ';') AS cc_addresses, array_to_string(bcc_addresses, ';') AS bcc_addresses FROM parsed",
    "date_parse": f"WITH {_PARSED} SELECT file, date_raw, epoch_us(sent_at) AS sent_micros, strftime(sent_at_local, '%Y-%m-%d %H:%M:%S') AS sent_at_local FROM parsed",
    "body_decode": f"WITH {_PARSED} SELECT file, md5({_FULL}) AS body_full FROM parsed",
    "body_clean": f"WITH {_PARSED} SELECT file, {_CLEAN} AS body_clean FROM parsed",
    "subject_threads": rf"SELECT message_id, trim(regexp_replace(regexp_replace(lower(coalesce(subject, '')), '^(\s*(re|fw|fwd)\s*(\[[0-9]+\])?\s*:\s*)+', ''), '\s+', ' ', 'g')) AS thread, coalesce(regexp_matches(lower(subject), '^\s*re\s*:'), false) AS reply, coalesce(regexp_matches(lower(subject), '^\s*(fw|fwd)\s*:'), false) AS forward FROM emails",
    "clock_fix": f"WITH {_PARSED} SELECT file, source_system, strftime((({_FIXED}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%Y-%m-%d %H:%M:%S') AS office_time FROM parsed WHERE sent_at IS NOT NULL",
    "quality_pass": f"WITH {_JUDGED} SELECT file, message_id, sender FROM judged WHERE reason IS NULL",
    "quality_quarantine": f"WITH {_JUDGED} SELECT file, message_id, sender, reason FROM judged WHERE reason IS NOT NULL",
    "dedup_by_id": f"WITH {_SILVER} SELECT message_id, file, body_hash FROM by_id",
    "dedup_by_content": f"WITH {_SILVER} SELECT message_id, file, body_hash FROM by_content",
    "recipients": f"WITH {_RECIPIENTS} SELECT message_id, recipient, recipient_type FROM rcp",
    "flags": f"WITH {_FLAGGED} SELECT message_id, is_internal, is_meeting, is_after_hours, is_weekend FROM flagged",
    "urgency_flags": f"SELECT message_id, coalesce(contains(body_clean, '?'), false) AS has_question, {_sql_urgency(False)} FROM emails",
    "weekly_volume": f"WITH {_WEEKLY} SELECT * FROM weekly ORDER BY week_start",
    "monthly_categories": f"WITH {_MONTHLY} SELECT * FROM monthly ORDER BY month",
    "reply_pairs": f"WITH {_PAIRS} SELECT reply_id, original_id, replier, original_sender, subject_normalised, original_at AS original_micros, reply_at AS reply_micros, round(response_minutes, 3) AS response_minutes FROM pairs",
    "person_activity": f"WITH {_PEOPLE} SELECT * FROM people",
    "top_senders": f"WITH {_PEOPLE} SELECT person, sent_count FROM people WHERE is_own ORDER BY sent_count DESC, person LIMIT 10",
    "response_buckets": f"SELECT b.bucket, b.position::INT AS position, count(r.response_minutes) AS replies FROM (VALUES {_BUCKET_ROWS}) b(bucket, position, low, high) LEFT JOIN reply_pairs r ON {_KNOWN} AND r.response_minutes >= b.low AND r.response_minutes < b.high GROUP BY 1, 2",
    "reply_speed": f"SELECT count(*) AS matched_replies, round(median(response_minutes), 1) AS median_minutes, round(avg(CASE WHEN response_minutes <= 120 THEN 1 ELSE 0 END), 4) AS share_within_2h FROM reply_pairs WHERE {_KNOWN}",
    "headline_totals": f"WITH {_FLAGGED} SELECT count(*) AS total_emails, {', '.join(f'round(count(*) FILTER (WHERE {c}) / count(*), 4) AS {c[3:]}_share' for c in ('is_meeting', 'is_after_hours', 'is_weekend', 'is_internal'))} FROM flagged",
    "busiest_week": f"WITH {_WEEKLY} SELECT week_start, total_emails FROM weekly WHERE week_start IS NOT NULL ORDER BY total_emails DESC, week_start LIMIT 1",
    "weighted_meeting_share": f"WITH {_MONTHLY} SELECT round(sum(meeting_share * total_emails) / sum(total_emails), 4) AS meeting_share FROM monthly",
    "latest_run": "WITH runs AS (SELECT make_date(1970, 1, 1) + (epoch_us(quarantined_at) // 86400000000)::INT AS run_at, reason, count(*) AS value FROM dq_quarantine WHERE reason IS NOT NULL GROUP BY 1, 2) SELECT * FROM runs WHERE run_at = (SELECT max(run_at) FROM runs)",
    "mailbox_owners": f"WITH {_OWNERS} SELECT mailbox, owner FROM owners",
    "reply_labels": f"WITH {_PAIRS}, {_LABELS} SELECT message_id, label_replied_2h FROM labels",
    "content_features": f"WITH {_CONTENT} SELECT * FROM content",
    "contact_history": f"WITH {_EDGES}, {_CONTACT} SELECT * FROM contacts",
    "reply_history": f"WITH {_EDGES}, {_PAIRS}, {_HISTORY} SELECT * FROM history",
    "eligible_mail": f"WITH {_EDGES}, {_OWNERS}, {_ELIGIBLE} SELECT message_id FROM eligible",
    "message_features": f"WITH {_ALL_FEATURES} SELECT * FROM feats",
    "class_weights": f"WITH {_ALL_FEATURES} SELECT label_replied_2h, round(CASE WHEN label_replied_2h = 1 THEN (SELECT (1 - avg(label_replied_2h)) / avg(label_replied_2h) FROM feats) ELSE 1.0 END, 6) AS class_weight FROM feats GROUP BY 1",
    "threshold_sweep": f"WITH {_SCORED}, t(threshold) AS (VALUES {_THRESHOLDS}), swept AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE score < threshold AND y = 1) AS fn FROM t, scored GROUP BY 1) SELECT threshold, tp, fp, fn, round({_F1}, 6) AS f1 FROM swept",
    "rule_baseline": f"WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE said AND y = 1) AS tp, count(*) FILTER (WHERE said AND y = 0) AS fp, count(*) FILTER (WHERE NOT said AND y = 1) AS fn FROM scored) SELECT 'prior_reply_rule' AS model, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round({_F1}, 6) AS f1, tp + fp AS positives FROM c",
    "time_split": "WITH seconds AS (SELECT message_id, floor(epoch_us(sent_at) / 1000000) AS s FROM emails), cut AS (SELECT quantile_disc(s, 0.8) AS c FROM seconds WHERE s IS NOT NULL) SELECT message_id, CASE WHEN s >= c THEN 'test' ELSE 'train' END AS part, strftime(make_timestamp((c * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS cut FROM seconds, cut",
    "documented_columns": "SELECT table_name AS filed_as, column_name FROM information_schema.columns WHERE table_name IN ('raw_emails', 'emails', 'recipients', 'dq_quarantine', 'reply_pairs')",
    "personal_columns": "SELECT split_part(p, ' ', 1) AS table_name, unnest(string_split(split_part(p, ' ', 2), ',')) AS column_name FROM (VALUES ('bronze.raw_emails message'), ('silver.emails sender,to_addresses,cc_addresses,subject,body_clean,body_full'), ('silver.recipients recipient'), ('silver.dq_quarantine sender,to_addresses,cc_addresses,bcc_addresses,subject,body'), ('gold.reply_pairs replier,original_sender'), ('gold.person_activity person'), ('gold.message_features sender,text')) v(p)",
    "rule_quality": f"WITH {_PARSED}, one AS (SELECT DISTINCT file, subject, {_FULL} AS body_full FROM parsed), said AS (SELECT regexp_matches(coalesce(subject, '') || ' ' || body_full, '{_MEETING}') AS p, coalesce(subject IS NOT NULL AND regexp_matches(subject, '(?i)\\bmeeting'), false) AS y FROM one), c AS (SELECT count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn FROM said) SELECT tp, fp, fn, round(CASE WHEN tp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision, round(CASE WHEN tp > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1 FROM c",
    "chart_weeks": f"WITH {_WEEKLY} SELECT * FROM weekly WHERE week_start BETWEEN DATE '1999-07-01' AND DATE '2002-03-01'",
    "chart_months": f"WITH {_MONTHLY} SELECT * FROM monthly WHERE month BETWEEN DATE '1999-07-01' AND DATE '2002-03-01' AND total_emails >= 20",
    "share_gate": f"WITH {_JUDGED} SELECT round(count(reason) / count(*), 6) AS share, count(reason) / count(*) <= 0.05 AS passes FROM judged",
    "run_metrics": f"WITH {_SILVER} SELECT 'bronze_rows' AS metric, count(*) AS value FROM judged UNION ALL SELECT 'quarantined_rows', count(reason) FROM judged UNION ALL SELECT 'passed_rows', count(*) FROM silver UNION ALL SELECT 'after_message_id_dedup', count(*) FROM by_id UNION ALL SELECT 'after_content_dedup', count(*) FROM by_content UNION ALL SELECT 'recipient_rows', sum(len(list_distinct(list_concat(j.to_addresses, j.cc_addresses))))::BIGINT FROM by_content b JOIN (SELECT DISTINCT ON (file) file, to_addresses, cc_addresses FROM judged) j USING (file)",
}
