"""String, URL and key/value-list expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's trim() and Java's \s know fewer blanks than str.strip(): (?U) adds the Unicode
# ones and the range adds the four ASCII separators.
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"

# The same set of blanks, written out for trim.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

PAIR_TYPE = "array<struct<k:string,v:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Lambdas re-evaluate any outer expression they mention on every element, so an
    expression needed inside one is bound to a lambda variable first.
    """
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return c.rlike(rf"(?U)^{WS}*\z")


def ws_split(c: Column) -> Column:
    """Words of a string, split on runs of whitespace, never an empty word."""
    return F.filter(F.split(c, rf"(?U){WS}+"), lambda w: w != "")


def before_first(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, 1)


def after_first(c: Column, sep: str) -> Column:
    """Everything after the first ``sep``, or "" when there is none."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.substr(c, at + len(sep))).otherwise("")


def safe_int(c: Column) -> Column:
    """Integer text to BIGINT, 0 for anything else.

    Allows padding, a sign and single underscores between ASCII digits. Values beyond
    BIGINT give 0.
    """
    ok = c.rlike(rf"(?U)^{WS}*[+-]?[0-9](?:_?[0-9])*{WS}*\z")
    digits = F.regexp_replace(c, r"[^0-9+-]", "")
    return F.when(ok, F.coalesce(digits.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def decode_url(c: Column) -> Column:
    """Percent- and plus-decode; broken escapes stay, bad UTF-8 becomes U+FFFD."""
    guarded = F.regexp_replace(text_or_empty(c), r"%(?![0-9a-fA-F]{2})", "%25")
    return F.try_url_decode(guarded)


def split_pairs(query: Column) -> Column:
    """``a=1&b`` to an array of (k, v), undecoded, in order, duplicates kept."""
    parts = F.filter(F.split(text_or_empty(query), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(before_first(p, "=").alias("k"), after_first(p, "=").alias("v")),
    )


def last_wins(pairs: Column) -> Column:
    """Fold duplicate keys: the last value, at the position where the key came first.

    Rows without duplicates pass through. The rest are sorted by (key, position), so a
    hostile request with very many parameters costs n log n, not n squared.
    """

    def fold(e: Column) -> Column:
        ranked = F.array_sort(
            F.transform(e, lambda x, i: F.struct(x["k"].alias("k"), i.alias("at"), x["v"].alias("v")))
        )

        def pick(s: Column) -> Column:
            firsts = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
            lasts = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["k"] != x["k"]))
            merged = F.zip_with(
                firsts,
                lasts,
                lambda f, l: F.struct(f["at"].alias("at"), l["k"].alias("k"), l["v"].alias("v")),
            )
            return F.transform(
                F.array_sort(merged), lambda m: F.struct(m["k"].alias("k"), m["v"].alias("v"))
            )

        return let(ranked, pick)

    def choose(e: Column) -> Column:
        keys = F.transform(e, lambda x: x["k"])
        unique = (F.size(e) < 2) | (F.size(F.array_distinct(keys)) == F.size(e))
        return F.when(unique, e).otherwise(fold(e))

    return let(pairs, choose)


def decode_pairs(pairs: Column) -> Column:
    return F.transform(
        pairs,
        lambda x: F.struct(decode_url(x["k"]).alias("k"), decode_url(x["v"]).alias("v")),
    )


def join_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
