"""Package folders, archives, registry metadata and reports as DataFrames."""

from .archives import archive_files
from .packages import FILES_SCHEMA, PackageSource, package_files
from .registry import fetched, head_commit, read_metadata, resolve_packages
from .reports import read_reports
from .resolve import classify_specifier, npm_name, npm_spec, pick_version, registry_path, verify_integrity

__all__ = ["FILES_SCHEMA", "PackageSource", "archive_files", "classify_specifier", "fetched", "head_commit", "npm_name", "npm_spec", "package_files", "pick_version", "read_metadata", "read_reports", "registry_path", "resolve_packages", "verify_integrity"]
