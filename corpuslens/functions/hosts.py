"""Hosts of literals by the URL standard: a pandas UDF, as built-ins know neither IDNA nor the forms of special schemes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def url_host(literal: str) -> str | None:
    """The host with a port that is not the scheme's own; empty for URLs without a host; None for what is no absolute URL."""
    text = re.sub(r"[\t\n\r]", "", literal.strip("".join(map(chr, range(33)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    if not m:
        return None
    scheme, rest = m[1].lower(), text[m.end() :]
    special = scheme in SPECIAL
    if special:
        rest = re.sub(r"^[/\\]*", "", rest) if scheme != "file" else re.sub(r"^[/\\]{2}", "", rest) if re.match(r"[/\\]{2}", rest) else "/"
    elif rest.startswith("//"):
        rest = rest[2:]
    else:
        return ""
    authority = re.split(r"[/?#\\]" if special else r"[/?#]", rest, maxsplit=1)[0]
    host = authority.rpartition("@")[2]
    m = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:]*)(?::([0-9]*))?", host)
    if not m or m[2] and int(m[2]) > 65535:
        return None
    name, port = m[1], m[2]
    if special and not name.startswith("["):
        name = _domain(name)
        if name is None or not name and scheme != "file":
            return None
    elif not name.startswith("[") and _FORBIDDEN.search(name.replace("%", "")):
        return None
    else:
        name = name.lower() if name.startswith("[") else name
    return name if not port or special and int(port) == SPECIAL[scheme] else f"{name}:{int(port)}"


def _domain(name: str) -> str | None:
    from urllib.parse import unquote

    name = unquote(name, errors="replace")
    try:
        name = name.lower() if name.isascii() else name.encode("idna").decode().lower()
    except UnicodeError:
        return None
    return None if _FORBIDDEN.search(name) else name


def normalize_host(literal: str) -> str | None:
    """The URL's host, else the part before a path, query or fragment without user information; None if nothing is left."""
    return url_host(literal) or re.sub(r"^[^/@]*@", "", re.split(r"[/?#]", literal, maxsplit=1)[0]) or None


def endpoint(literal: str) -> str:
    """The URL's host (which may be empty), else the literal itself."""
    host = url_host(literal)
    return literal if host is None else host


@F.pandas_udf(StringType())
def host_of(literals: pd.Series) -> pd.Series:
    return literals.map(lambda x: None if x is None else normalize_host(x))


@F.pandas_udf(StringType())
def endpoint_of(literals: pd.Series) -> pd.Series:
    return literals.map(lambda x: None if x is None else endpoint(x))
