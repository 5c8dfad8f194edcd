"""Specifiers, registry metadata and integrity as expressions. There is no network here: metadata and archives are tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import col

# The forms of Git and npm specifiers.
_GIT = r"^(?:git\+)?(?:ssh://|https?://|git@)\S+$|^(?:github|gitlab|bitbucket):\S+$"
_NPM = r"^@[^/\s]+/[^@\s]+(?:@[^@\s]+)?$|^[^@\s][^/\s]*$"


def classify_specifier(specifier: Column | str, exists: Column | None = None) -> Column:
    """local-path, git-repo or npm-package; anything else is an error. ``exists``: a plain name that is a folder here."""
    s = F.trim(col(specifier))
    there = F.lit(False) if exists is None else exists
    unknown = F.raise_error(F.concat(F.lit("cannot classify specifier: "), col(specifier))).cast("string")
    return F.when(s.rlike(r"^(?:\./|\.\./|/|~)"), "local-path").when(s.rlike(_GIT), "git-repo").when(there, "local-path").when(s.rlike(_NPM), "npm-package").otherwise(unknown)


def npm_name(specifier: Column | str) -> Column:
    """The package name, without ``@version`` or ``@tag``."""
    return F.regexp_replace(col(specifier), r"^(@?[^@]+)@[^@]+$", "$1")


def npm_spec(specifier: Column | str) -> Column:
    """The version or tag asked for, else null."""
    return F.nullif(F.regexp_extract(col(specifier), r"^@?[^@]+@([^@]+)$", 1), F.lit(""))


def registry_path(name: Column | str) -> Column:
    n = col(name)
    return F.when(n.startswith("@"), F.regexp_replace(n, "^([^/]*)/", "$1%2F")).otherwise(n)


def pick_version(spec: Column | str, tags: Column | str, versions: Column | str) -> Column:
    """Of ``versions`` (array, in registry order) that asked for: exact, by tag, else ``latest``, else the last; null if there is none."""
    s, t, v = col(spec), col(tags), col(versions)
    asked = F.when(F.array_contains(v, s), s).otherwise(t[s])
    free = F.coalesce(t["latest"], F.try_element_at(v, F.lit(-1)))
    chosen = F.when(s.isNotNull(), asked).otherwise(free)
    return F.when(F.array_contains(v, chosen), chosen)


def verify_integrity(content: Column | str, integrity: Column | str, shasum: Column | str) -> Column:
    """``content`` if it fits ``sha<bits>-<base64>``, or else the sha1 ``shasum``; without both it is accepted; a mismatch is an error."""
    c, i, s = col(content), col(integrity), col(shasum)
    bits, want = F.regexp_extract(i, r"^sha(512|384|256|1)-([A-Za-z0-9+/=]+)$", 1), F.regexp_extract(i, r"^sha(?:512|384|256|1)-([A-Za-z0-9+/=]+)$", 1)
    hexed = F.when(bits == "1", F.sha1(c)).when(bits == "256", F.sha2(c, 256)).when(bits == "384", F.sha2(c, 384)).when(bits == "512", F.sha2(c, 512))
    error = lambda text: F.raise_error(F.lit(text)).cast("binary")
    by_integrity = F.when(hexed.isNull(), error("unsupported integrity format")).when(F.regexp_replace(F.base64(F.unhex(hexed)), r"\s", "") == want, c).otherwise(error("integrity mismatch"))
    return F.when(i.isNotNull() & (i != ""), by_integrity).when(s.isNotNull() & (s != "") & (F.sha1(c) != s), error("shasum mismatch")).otherwise(c)
