"""Reports, diffs and badges as text: expressions over the nested documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import DEFAULT, AuditConfig
from .functions import badge_colour, badge_message, escape_markdown, without_controls

SECTION = 10
SCOPE = "scope: static facts of one scan profile; no change is proof of safety"


def lines(*parts: Column) -> Column:
    """Text lines; nulls are left out, arrays are many lines."""
    listed = [F.when(p.isNull(), F.array().cast("array<string>")).otherwise(F.array(p)) for p in parts]
    return F.array_join(F.concat(*listed), "\n")


def block(items: Column) -> Column:
    """The items as lines, null for none."""
    return F.when(F.size(items) > 0, F.array_join(items, "\n"))


def where_of(e: Column) -> Column:
    return F.when(e["line"].isNotNull(), F.concat(e["file"], F.lit(":"), e["line"].cast("string"))).otherwise(e["file"])


def flat(items: Column, line: Callable[[Column], Column]) -> Column:
    """One line for each item."""
    return block(F.transform(items, line))


def coverage_of(report: Column, config: AuditConfig = DEFAULT) -> Column:
    return F.coalesce(report[config.context_key]["coverage"]["status"], F.lit("unknown"))


def _counts(c: Column, join: str) -> Column:
    return F.concat_ws(join, *[F.concat(c[s].cast("string"), F.lit(f" {s}")) for s in ("critical", "high", "medium", "low", "info")])


def _finding_lines(f: Column) -> Column:
    letter = F.upper(F.substring(f["severity"], 1, 1))
    head = F.concat(F.lit("["), letter, F.lit("] "), f["id"], F.lit(" — "), f["title"], F.lit(" ("), f["confidence"], F.lit(" confidence)"))
    site = lambda e: F.concat(F.lit("    "), where_of(e), F.coalesce(F.concat(F.lit("  "), e["snippet"]), F.lit("")), F.coalesce(F.concat(F.lit("\n      "), e["note"]), F.lit("")))
    return lines(head, flat(f["evidence"], site), F.concat(F.lit("    fix: "), f["remediation"]), F.lit(""))


def summary_text(report: Column, config: AuditConfig = DEFAULT) -> Column:
    """The summary for people at a terminal."""
    r = report
    return lines(
        F.concat(F.lit(f"{config.tool} {config.version} · "), r["target"]["kind"], F.lit(" · "), r["target"]["specifier"]),
        F.concat(F.lit("grade: "), r["summary"]["grade"], F.lit(" · coverage: "), coverage_of(r, config)),
        F.concat(F.lit("findings: "), _counts(r["summary"]["counts"], " · ")),
        F.when(F.size(r["findings"]) > 0, F.lit("")),
        flat(r["findings"], _finding_lines),
    )


def markdown(report: Column, run_url: Column | str, config: AuditConfig = DEFAULT) -> Column:
    """A bounded report for a pull request: ten graded findings of three places each, eight of the rest."""
    r, c = report, report["summary"]["counts"]
    graded, info = F.filter(r["findings"], lambda f: f["severity"] != "info"), F.filter(r["findings"], lambda f: f["severity"] == "info")
    site = lambda e: F.concat(F.lit("  - `"), where_of(e), F.lit("`"), F.coalesce(F.concat(F.lit(" — `"), e["snippet"], F.lit("`")), F.lit("")))

    def entry(f: Column) -> Column:
        head = F.concat(F.lit("- **["), F.upper(F.substring(f["severity"], 1, 1)), F.lit("] "), f["id"], F.lit("** — "), f["title"], F.lit(" (`"), f["confidence"], F.lit("` confidence)"))
        return lines(head, flat(F.slice(f["evidence"], 1, 3), site))

    more = lambda items, most, text: F.when(F.size(items) > most, F.concat(F.lit("- …and "), (F.size(items) - most).cast("string"), F.lit(text)))
    head = F.concat(F.lit("**Grade: "), r["summary"]["grade"], F.lit("** · coverage: "), coverage_of(r, config), F.lit(" · audited `"), r["target"]["specifier"], F.lit("` · [run]("), F.lit(run_url) if isinstance(run_url, str) else run_url, F.lit(")"))
    table = F.concat(F.lit("| "), F.concat_ws(" | ", *[c[s].cast("string") for s in ("critical", "high", "medium", "low", "info")]), F.lit(" |"))
    some, rest = F.size(graded) > 0, F.size(info) > 0
    return lines(
        F.lit(f"<!-- {config.tool}:comment -->"), F.lit(f"## {config.tool} report"), F.lit(""), head, F.lit(""), F.lit("| critical | high | medium | low | info |"), F.lit("| --- | --- | --- | --- | --- |"), table, F.lit(""),
        F.when(F.size(r["findings"]) == 0, "No findings."), F.when(some, "### Findings\n"), flat(F.slice(graded, 1, 10), entry), more(graded, 10, " more in the report artifact"), F.when(some, ""),
        F.when(rest, F.concat(F.lit("<details><summary>"), F.size(info).cast("string"), F.lit(" info findings (never affect the grade)</summary>\n"))),
        flat(F.slice(info, 1, 8), lambda f: F.concat(F.lit("- **"), f["id"], F.lit("** — "), f["title"])), more(info, 8, " more"), F.when(rest, "</details>\n"),
        F.lit("---"), F.lit("Findings are signals, not verdicts: a low-confidence finding never lowers a grade."),
    )


def badge(report: Column, config: AuditConfig = DEFAULT) -> Column:
    """A badge document; coverage that is not complete is always named."""
    grade = report["summary"]["grade"]
    return F.struct(F.lit(1).alias("schemaVersion"), F.lit(config.tool).alias("label"), badge_message(grade, coverage_of(report, config)).alias("message"), badge_colour(grade).alias("color"), F.when(grade == "X", True).alias("isError"))


def _side(s: Column) -> Column:
    subject = F.coalesce(s["subject"]["subjectLabel"], s["subject"]["packageName"], F.lit("unlabeled subject"))
    digest = s["subject"]["analysisInputDigest"]
    short = F.when(F.length(digest) > 16, F.concat(F.substring(digest, 1, 16), F.lit("…"))).otherwise(digest)
    return F.concat(without_controls(s["scanner"]["name"]), F.lit(" "), without_controls(s["scanner"]["version"]), F.lit(" · grade "), s["grade"], F.lit(" · "), without_controls(subject), F.lit(" · "), short)


def _dotted(item: Column, *keys: str, clean: Callable[[Column], Column] = without_controls) -> Column:
    return F.concat_ws(" · ", *[clean(item[k]) for k in keys])


def _step(item: Column, name: str) -> Column:
    one = lambda s: F.coalesce(item[name][s].cast("string"), F.lit("1"))
    return F.concat(F.lit(f" · {name} "), one("base"), F.lit(" → "), one("head"))


def _sections(diff: Column, clean: Callable[[Column], Column]) -> list[tuple[str, Column, Callable[[Column], Column]]]:
    f, o = diff["findings"], diff["observations"]
    identity, observation = ("rule", "variant", "file", "subject"), ("kind", "file", "subject")
    many = lambda i, side: F.coalesce(i[side]["count"], F.lit(1)).cast("string")
    return [
        ("added findings", f["added"], lambda i: F.concat(F.lit("+ "), _dotted(i, *identity, clean=clean))),
        ("added observations", o["added"], lambda i: F.concat(F.lit("+ "), _dotted(i, *observation, clean=clean))),
        ("removed findings", f["removed"], lambda i: F.concat(F.lit("- "), _dotted(i, *identity, clean=clean), F.lit(" (no longer observed, not proven fixed)"))),
        ("removed observations", o["removed"], lambda i: F.concat(F.lit("- "), _dotted(i, *observation, clean=clean))),
        ("changed findings", f["changed"], lambda i: F.concat(F.lit("~ "), _dotted(i["identity"], *identity, clean=clean), _step(i, "severity"), _step(i, "confidence"), _step(i, "count"))),
        ("changed observation counts", o["countChanged"], lambda i: F.concat(F.lit("~ "), _dotted(i["head"], *observation, clean=clean), F.lit(" · count "), many(i, "base"), F.lit(" → "), many(i, "head"))),
    ]


def diff_text(diff: Column, config: AuditConfig = DEFAULT) -> Column:
    """A diff for people: comparability first, six bounded sections, what is cut off is said."""
    parts = [
        F.concat(F.lit(f"{config.tool} diff · "), diff["comparability"]), F.when(F.size(diff["reasons"]) > 0, F.concat(F.lit("reasons: "), F.array_join(diff["reasons"], ", "))),
        F.concat(F.lit("base: "), _side(diff["base"])), F.concat(F.lit("head: "), _side(diff["head"])),
    ]
    no = diff["comparability"] == "incomparable"
    for title, items, line in _sections(diff, without_controls):
        cut = F.when(F.size(items) > SECTION, F.concat(F.lit("\n  …and "), (F.size(items) - SECTION).cast("string"), F.lit(" more — truncated; see the document for the full result"))).otherwise("")
        parts.append(_section(title, items, line, ~no, cut))
    f = diff["findings"]
    total = F.concat(F.lit("summary: "), F.concat_ws(" · ", *[F.concat(F.size(f[k]).cast("string"), F.lit(f" {k}")) for k in ("added", "removed", "changed", "unchanged")]))
    grades = F.concat(F.lit("grade: "), diff["base"]["grade"], F.lit(" → "), diff["head"]["grade"], F.lit(" (secondary context)"))
    return lines(*parts, F.when(no, "comparison unavailable — when practical, rescan both artifacts with the same scanner and profile."), F.when(~no, total), F.when(~no, grades), F.lit(SCOPE))


def _section(title: str, items: Column, line: Callable[[Column], Column], shown: Column, cut: Column) -> Column:
    body = F.array_join(F.transform(F.slice(items, 1, SECTION), lambda i: F.concat(F.lit("  "), line(i))), "\n")
    return F.when(shown & (F.size(items) > 0), F.concat(F.lit(f"{title} ("), F.size(items).cast("string"), F.lit("):\n"), body, cut))


def diff_markdown(diff: Column, config: AuditConfig = DEFAULT) -> Column:
    """A diff for a pull request, escaped and bounded."""
    no = diff["comparability"] == "incomparable"
    parts = [F.lit(f"### {config.tool} comparison"), F.lit(""), F.concat(F.lit("**"), diff["comparability"], F.lit("** · grade "), diff["base"]["grade"], F.lit(" → "), diff["head"]["grade"])]
    parts.append(F.when(no, F.concat(F.lit("Comparison unavailable: "), F.substring(escape_markdown(F.array_join(diff["reasons"], ", ")), 1, 400))))
    for title, items, line in _sections(diff, escape_markdown):
        cut = F.when(F.size(items) > SECTION, F.concat(F.lit("\n  …and "), (F.size(items) - SECTION).cast("string"), F.lit(" more"))).otherwise("")
        parts.append(_section(f"**{title}**", items, line, ~no, cut))
    return lines(*parts, F.lit(SCOPE))


def unavailable_markdown(reason: Column, config: AuditConfig = DEFAULT) -> Column:
    """The section of a comparison that did not come about; the scan's own report stands."""
    return lines(F.lit(f"### {config.tool} comparison"), F.lit(""), F.concat(F.lit("Comparison unavailable: "), F.substring(escape_markdown(reason), 1, 400)), F.lit(SCOPE))


def rendered(reports: DataFrame, column: Column, name: str = "text") -> DataFrame:
    """(pkg_id, name)."""
    return reports.select("pkg_id", column.alias(name))
