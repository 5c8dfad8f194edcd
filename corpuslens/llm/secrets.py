"""Operator 10: secret scan by multipart credential linking.

Three base kinds are strong enough to report alone (``assign``, ``access``, ``hex``). Weak candidates - opaque
tokens, endpoints and account names - are common in clean text, so they are reported only when complementary parts of
one credential co-occur: the parts of a text are intervals, scopes are windows around the anchors, and an interval join
of the two links an identifier, a secret and an endpoint.

* anchor: an ``access`` span, or an ``account`` candidate (user, client id, account name with a value).
* ``opaque``: a token of 32 or more characters with letters of both cases and a digit. Linked to an anchor within the
  scope it is reported.
* ``endpoint``: a URL host or connection host. Reported when its scope holds an anchor and a secret part (``opaque``,
  ``assign`` or ``hex``).
* ``account``: reported on the same condition as ``endpoint``: both complements must be there.

A scope reaches SCOPE code points from the anchor's ends and never over a blank line. Null and empty texts have no
spans. The base spans never depend on the linking.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

SCOPE = 400
# The base patterns of the scan. Letter pairs instead of re.IGNORECASE, which would let in U+017F and U+212A.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = re.compile(rf"(?:{_ANY_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of under 20 characters holds no longer one, so the bound may stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}")
# the run before a port is taken once and whole, so that no text is read more than a few times
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/?#\"'<>]{3,}|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]++:[0-9]{2,5}\b")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ACCOUNT = re.compile(r"\b(?:[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii]d)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})")
BLANK = re.compile(r"\n[ \t\r]*\n")
KINDS = ("assign", "access", "hex", "opaque", "endpoint", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans that stand alone, ends exclusive, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def endpoint_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in ENDPOINT.finditer(text):
        begin = m.start()
        if "://" not in m[0]:
            run = m[0][: m[0].index(":")]
            host = run[run.rfind("..") + 2 if ".." in run else 0 :].lstrip(".")
            if not HOST.fullmatch(host):
                continue
            begin += len(run) - len(host)
        found.append((begin, m.end(), "endpoint"))
    return found


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates whose complementary parts share a scope: an interval join by binary search."""
    accounts = [(m.start(1), m.end(1), "account") for m in ACCOUNT.finditer(text)] if ":" in text or "=" in text else []
    anchors = sorted([s for s in base if s[2] == "access"] + accounts)
    if not anchors:
        return []
    strong = [s for s in base if s[2] != "access"]
    taken = sorted(base)
    # furthest end of all base spans up to each: a base span that began earlier may cover many later ones
    reach = list(accumulate((b[1] for b in taken), max))
    opaque = []
    for m in OPAQUE.finditer(text):
        i = bisect_left(taken, (m.end(),))
        if not i or reach[i - 1] <= m.start():
            opaque.append((m.start(), m.end(), "opaque"))
    secrets, endpoints = sorted(strong + opaque), sorted(endpoint_spans(text))
    walls = [m.start() for m in BLANK.finditer(text)]
    out: set[tuple[int, int, str]] = set()
    for anchor in anchors:
        i = bisect_left(walls, anchor[0])
        low = max(anchor[0] - SCOPE, walls[i - 1] if i else 0)
        high = min(anchor[1] + SCOPE, walls[i] if i < len(walls) else len(text))
        parts = [s for s in _inside(secrets, low, high) if not (s[0] < anchor[1] and anchor[0] < s[1])]
        places = _inside(endpoints, low, high)
        if anchor[2] == "access":
            out.update(s for s in parts if s[2] == "opaque")
        if parts and places:
            out.update(places)
            out.update(s for s in parts if s[2] == "opaque")
            if anchor[2] == "account":
                out.add(anchor)
    return list(out)


def _inside(spans: list[tuple[int, int, str]], low: int, high: int) -> list[tuple[int, int, str]]:
    """Those of the sorted spans that lie in [low, high)."""
    return [s for s in spans[bisect_left(spans, (low,)) : bisect_left(spans, (high,))] if s[1] <= high]


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, each by start, then kind as listed in KINDS."""
    text = text or ""
    order = lambda s: (s[0], _RANK[s[2]])
    base = base_spans(text)
    return sorted(base, key=order), sorted(base + linked_spans(text, base), key=order)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) for every row, whole texts, one pass, no shuffle.

    Null texts give empty arrays; repeated rows are scanned like any other; other columns of ``docs`` are not read.
    """
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch):
        got = [scan_text(t) for t in batch.column(1).to_pylist()]
        sides = [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in side[i]] for side in got], pa.list_(one)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *sides], ["id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    item = "array<struct<kind:string,start:bigint,end:bigint>>"
    return arrow_map(docs.select(docs[id_col], docs[text_col]), run, f"id {kind}, base {item}, spans {item}")


def span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(span_text(spans).encode()).hexdigest()
