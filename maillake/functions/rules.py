"""Keyword and address rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OWN_DOMAIN = "northmere.example"

# Wording of the meeting rule and of the urgency rules.
MEETING = r"(?i)\b(meetings?|appointments?|conference calls?|conf\.? calls?|rescheduled?|postponed|cancell?ed|agenda|(?:let'?s|can we|could we|to) meet)\b"
URGENCY = {
    "has_urgent": r"(?i)\burgent\b",
    "has_asap": r"(?i)\basap\b|as soon as possible",
    "has_deadline": r"(?i)\bdeadline\b|\bby (today|tomorrow|eod|end of (the )?day)\b",
    "has_action_request": r"(?i)\bplease (respond|reply|confirm|review|advise|call|let me know)\b",
    "has_important": r"(?i)\bimportant\b",
}


def joined(*texts: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))


def is_meeting(subject: Column, body: Column) -> Column:
    return F.rlike(joined(subject, body), F.lit(MEETING))


def all_recipients(to: Column, cc: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(to, empty), F.coalesce(cc, empty))


def is_own(person: Column, domain: str = OWN_DOMAIN) -> Column:
    return F.endswith(person, F.lit(f"@{domain}"))


def is_internal(sender: Column, recipients: Column, domain: str = OWN_DOMAIN) -> Column:
    """Own sender and at least one recipient, all of them own."""
    return is_own(sender, domain) & (F.size(recipients) > 0) & F.forall(recipients, lambda r: is_own(r, domain))
