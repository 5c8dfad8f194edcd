"""Canonical JSON and the digests over it."""

from __future__ import annotations

import hashlib
import json
import math


def canonical(value: object) -> str:
    """Sorted keys (by UTF-16 units), no white space, non-finite numbers as null."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            return "null"
        if value.is_integer() and abs(value) < 1e21:
            return str(int(value))
    return json.dumps(value, ensure_ascii=False)


def sha256_id(text: str | bytes) -> str:
    return "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).hexdigest()


def profile_digest(profile: dict) -> str:
    """Over the four fields of a profile."""
    return sha256_id(canonical({k: profile.get(k) for k in ("analyzerRevision", "ruleCatalogRevision", "rules", "options")}))
