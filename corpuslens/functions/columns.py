"""Severity algebra, hosts, digests and literal classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severities from worst to mildest, the confidences, and the grade of the worst graded severity.
SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
GRADES = ("F", "D", "C", "B", "A")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick(value: Column, table: dict[str, object], default: object = None) -> Column:
    """A chain of ``when`` over a literal table."""
    out = F.lit(default)
    for key, result in reversed(table.items()):
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def severity_rank(severity: Column | str) -> Column:
    """0 for the worst; null for what is no severity."""
    return pick(col(severity), {s: i for i, s in enumerate(SEVERITIES)}).cast("int")


def is_graded(severity: Column | str, confidence: Column | str) -> Column:
    """Whether a finding can lower the grade: not info, not of low confidence."""
    return (col(severity) != "info") & (col(confidence) != "low")


def grade_of(rank: Column | str) -> Column:
    """Grade by the rank of the worst graded finding; null (no such finding) is A."""
    r = col(rank)
    return F.coalesce(F.element_at(F.array(*map(F.lit, GRADES)), r + 1), F.lit("A"))


def sha256_id(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text), 256))


_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"


def url_host(url: Column | str) -> Column:
    """Lower-case host with its port, default ports dropped, user information dropped; null where there is none."""
    u = col(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, _AUTHORITY, 1))
    port = F.when(scheme.isin("http", "ws"), ":80").when(scheme.isin("https", "wss"), ":443").when(scheme == "ftp", ":21")
    bare = F.when(port.isNotNull() & F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    return F.nullif(bare, F.lit(""))


def bare_host(literal: Column | str) -> Column:
    """The part before a path, query or fragment, without user information; null if nothing is left."""
    head = F.regexp_extract(col(literal), r"^([^/?#]*)", 1)
    return F.nullif(F.regexp_replace(head, r"^[^@]*@", ""), F.lit(""))


def normalized_host(literal: Column | str) -> Column:
    """The URL's host, or else the bare form."""
    return F.coalesce(url_host(literal), bare_host(literal))


def charset_of(token: Column | str, distinct: int = 8) -> Column:
    """``base64``, ``hex`` or null. Hex needs a variety of digits: palettes reuse few."""
    t = col(token)
    return F.when(t.rlike("^[A-Za-z0-9+/=]+$") & t.rlike("[0-9]") & t.rlike("[A-Z]"), "base64").when(
        t.rlike("^[0-9a-fA-F]+$") & (F.size(F.array_distinct(F.split(t, ""))) >= distinct), "hex"
    )


def snippet(text: Column | str, size: int = 120) -> Column:
    return F.substring(F.trim(col(text)), 1, size)


def without_controls(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[\x00-\x1f\x7f]", "")


def escape_markdown(text: Column | str) -> Column:
    """For table cells and inline code: pipes, backticks and angle brackets can't break out."""
    out = without_controls(text)
    for raw, safe in (("|", "\\|"), ("`", "'"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def badge_message(grade: Column | str, coverage: Column | str | None = None) -> Column:
    """``grade A``, with its coverage where that is not complete; a failed scan says so."""
    g = col(grade)
    extra = F.lit("") if coverage is None else F.when(col(coverage) == "partial", " (partial)").when(col(coverage) == "unknown", " (coverage unknown)").otherwise("")
    return F.when(g == "X", "scan failed").otherwise(F.concat(F.lit("grade "), g, extra))


# Badge colours by grade.
COLOURS = {"A": "brightgreen", "B": "green", "C": "yellow", "D": "orange", "F": "red", "X": "lightgrey"}


def badge_colour(grade: Column | str) -> Column:
    return pick(col(grade), COLOURS, "lightgrey")
