"""What a deployment sets: names, schema ids, scope roots and word lists. Nothing of it is read from the machine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AuditConfig:
    tool: str = "corpuslens"
    version: str = "0.1.0"
    report_schema: str = "corpuslens/report/v1"
    diff_schema: str = "corpuslens/diff/v1"
    digest_kind: str = "corpuslens/analysis-input@1"
    #: Key of the scan context in a report.
    context_key: str = "x-corpuslens"
    #: Section of package.json whose ``seams`` declare capabilities.
    manifest_section: str = "plugin"
    #: Names worth impersonating.
    popular_names: tuple[str, ...] = ("react", "lodash", "express", "axios", "chalk", "webpack", "typescript", "eslint", "commander", "dotenv")
    #: Absolute folders in which a plugin may write.
    scope_roots: tuple[str, ...] = ("/tmp",)
    #: More path parts that name credentials, as regular expressions.
    credential_names: tuple[str, ...] = ()
    #: References are this address and the rule's id.
    rule_pages: str = "docs/rules/"
    limitations: tuple[str, ...] = ("dependencies are not scanned", "static analysis cannot observe runtime-computed behavior")


DEFAULT = AuditConfig()
