"""Patterns for volatile values and the placeholders that replace them.

Java needs (?U) so that digits, blanks and word boundaries are Unicode-aware. What is
left: (?U)\\w differs on combining marks and superscripts, so a word boundary
next to such a character may fall differently.

A Unicode word boundary is costly to test at every character. Where it pays, a pattern
starts with a cheap lookahead that is implied by what follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These must match exactly for equal results.
_UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
_LONG_HEX = r"\b[0-9a-fA-F]{16,}\b"
_IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
_ID_SEGMENT = r"(?<=/)(\d{3,})(?=/|\n?\z)"
_SESSION = r"\b(session|token|auth|sid|sessionid|jwt)=([A-Za-z0-9._-]+)"
_TIMESTAMP = r"\b20\d{2}-\d{2}-\d{2}[T\s\x1c-\x1f]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?\b"

UUID = "(?U)" + _UUID
LONG_HEX = "(?U)" + _LONG_HEX
IPV4 = r"(?U)(?=\d)\b(?=\d{1,3}\.\d)" + _IPV4.removeprefix(r"\b")
ID_SEGMENT = "(?U)" + _ID_SEGMENT
# The classes hold every character that can be first or second when case is ignored.
SESSION = "(?=[sStTaAjJſ][eEoOuUiIİıwW])(?Ui)" + _SESSION
TIMESTAMP = "(?U)(?=20)" + _TIMESTAMP


def canonical_escapes(c: Column) -> Column:
    """``%2F`` to ``/`` and ``%2E`` to ``.``; every other escape stays."""
    for escaped, plain in (("%2F", "/"), ("%2f", "/"), ("%2E", "."), ("%2e", ".")):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def mask_path(c: Column) -> Column:
    """Canonical lower-case path; the order of the rules is part of the result."""
    c = F.lower(canonical_escapes(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, "/+", "/")
    c = F.regexp_replace(c, ID_SEGMENT, "{USER_ID}")
    c = F.regexp_replace(c, IPV4, "{IP}")
    c = F.regexp_replace(c, UUID, "{UUID}")
    return F.regexp_replace(c, LONG_HEX, "{HASH}")


def mask_values(c: Column) -> Column:
    """Mask times, addresses, sessions, UUIDs and hashes, in that order; case is kept."""
    c = canonical_escapes(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, TIMESTAMP, "{TIMESTAMP}")
    c = F.regexp_replace(c, IPV4, "{IP}")
    c = F.regexp_replace(c, SESSION, "$1={SESSION}")
    c = F.regexp_replace(c, UUID, "{UUID}")
    return F.regexp_replace(c, LONG_HEX, "{HASH}")
