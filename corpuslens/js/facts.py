"""Facts of one parsed file: imports, capability uses, network uses, evaluation, dynamic imports, encoded literals.

The walk is depth first over the fields in their order; names bound by imports are known from where they stand on, in
one flat scope for each file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .parser import Node

# Modules, methods and paths that stand for a capability.
NET_MODULES = frozenset(["net", "http", "https", "http2", "tls", "dgram", "dns"])
FS_MODULES = frozenset(["fs", "fs/promises"])
MODULE_CAPABILITY = {"fs": "fs", "fs/promises": "fs", "child_process": "shell", "worker_threads": "workers", "crypto": "crypto", **dict.fromkeys(sorted(NET_MODULES), "net")}
_FS_WRITE = ["writeFile", "appendFile", "rm", "unlink", "rmdir", "truncate", "rename", "cp", "createWriteStream", "chmod", "chown", "writev"]
FS_WRITE = frozenset([*_FS_WRITE, *(m + "Sync" for m in _FS_WRITE)])
_FS_READ = ["readFile", "readdir", "createReadStream", "stat", "lstat", "exists", "open", "access"]
FS_READ = frozenset([*_FS_READ, *(m + "Sync" for m in _FS_READ)])
SHELL = frozenset(["spawn", "exec", "execFile", "fork", "spawnSync", "execSync", "execFileSync"])
NET = frozenset(["request", "get", "connect", "createConnection", "createSocket", "lookup", "resolve"])
HOME = frozenset(["homedir", "userInfo"])
CREDENTIAL_PATH = re.compile(r"(?:^|[/\\])(?:\.env[^/\\]*|credentials|auth\.json|token|secret|\.npmrc|\.netrc|\.aws|\.ssh|\.gitconfig)(?:$|[/\\])", re.I)

LITERAL_FLOOR, CHARCODES, HEX_DIGITS = 48, 8, 8
_SKIP = frozenset(["type", "start", "line", "wrapped"])


@dataclass
class FileFacts:
    """What one file shows; each list in the order of the walk."""

    imports: list[tuple[str, int]] = field(default_factory=list)
    externals: list[str] = field(default_factory=list)
    caps: list[dict] = field(default_factory=list)
    nets: list[dict] = field(default_factory=list)
    evals: list[dict] = field(default_factory=list)
    dynamic: list[dict] = field(default_factory=list)
    encoded: list[dict] = field(default_factory=list)
    charcodes: list[dict] = field(default_factory=list)


def utf16(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def utf16_head(text: str, units: int) -> str:
    """The first ``units`` UTF-16 units; half a pair at the end is kept as U+FFFD, as it would be printed."""
    if len(text) <= units and text.isascii():
        return text
    return text.encode("utf-16-le", "surrogatepass")[: units * 2].decode("utf-16-le", "replace")


def js_trim(text: str) -> str:
    return text.strip("\t\n\x0b\x0c\r \xa0                　﻿")


def bare(module: str) -> str:
    return module.removeprefix("node:")


def static_string(node: Node | None) -> str | None:
    """The value of a string literal, a template without expressions, or a concatenation of such."""
    parts: list[str] = []
    stack = [node]
    while stack:
        n = stack.pop()
        if not n:
            return None
        if n["type"] == "Literal" and isinstance(n["value"], str):
            parts.append(n["value"])
        elif n["type"] == "TemplateLiteral" and not n["expressions"]:
            parts.append(n["quasis"][0]["value"]["raw"])
        elif n["type"] == "BinaryExpression" and n["operator"] == "+":
            stack += [n["right"], n["left"]]
        else:
            return None
    return "".join(parts)


def literal_arguments(args: list[Node]) -> list[str]:
    out = []
    for a in args:
        if a["type"] == "Literal" and isinstance(a["value"], str):
            out.append(a["value"])
        elif a["type"] == "TemplateLiteral" and not a["expressions"]:
            out.append(a["quasis"][0]["value"]["raw"])
    return out


def named(node: Node | None, name: str) -> bool:
    return bool(node) and node["type"] == "Identifier" and node["name"] == name


def is_process_env(node: Node) -> bool:
    return node["type"] == "MemberExpression" and not node["computed"] and named(node["object"], "process") and named(node["property"], "env")


def method_capabilities(module: str, method: str) -> list[str]:
    if module in FS_MODULES:
        return ["fs", "fs-write"] if method in FS_WRITE else ["fs"] if method in FS_READ else []
    if module == "child_process":
        return ["shell"] if method in SHELL else []
    if module == "os":
        return ["homedir"] if method in HOME else []
    return ["net"] if module in NET_MODULES and method in NET else []


def charset(value: str) -> str | None:
    """base64 or hex of a long literal, else None. Mixed-case hex with a digit is taken for base64."""
    if re.fullmatch(r"[A-Za-z0-9+/=]+", value) and re.search("[0-9]", value) and re.search("[A-Z]", value):
        return "base64"
    return "hex" if re.fullmatch(r"[0-9a-fA-F]+", value) and len(set(value)) >= HEX_DIGITS else None


def inspect(code: str, tree: Node) -> FileFacts:
    """The facts of a file. ``node:`` before a module's name makes no difference but in what is imported."""
    return _Walk(code).run(tree)


class _Walk:
    def __init__(self, code: str):
        self.facts, self.lines = FileFacts(), code.split("\n")
        self.bound: dict[str, tuple[str, str | None]] = {}
        self.known: set[tuple] = set()

    def run(self, tree: Node) -> FileFacts:
        stack = [tree]
        while stack:
            node = stack.pop()
            handler = getattr(self, "n_" + node["type"], None)
            if handler:
                handler(node)
            children = []
            for key, value in node.items():
                if key not in _SKIP:
                    if isinstance(value, list):
                        children += [v for v in value if v]
                    elif isinstance(value, dict) and "type" in value:
                        children.append(value)
            stack += reversed(children)
        self.facts.imports.sort()
        self.facts.externals = sorted(set(self.facts.externals))
        return self.facts

    def snippet(self, line: int) -> str:
        return utf16_head(js_trim(self.lines[line - 1] if line <= len(self.lines) else ""), 120)

    def cap(self, cap: str, line: int, api: str, literals: list[str]) -> None:
        if (line, api, cap) not in self.known:
            self.known.add((line, api, cap))
            self.facts.caps.append({"cap": cap, "line": line, "api": api, "literals": literals, "snippet": self.snippet(line)})

    def net(self, line: int, api: str, literals: list[str]) -> None:
        self.facts.nets.append({"line": line, "api": api, "literals": literals, "snippet": self.snippet(line)})

    def imported(self, name: str, line: int, hashes_are_external: bool = False) -> None:
        self.facts.imports.append((name, line))
        if not name.startswith(".") and (hashes_are_external or not name.startswith("#")):
            self.facts.externals.append(name)

    def n_ImportDeclaration(self, n: Node) -> None:
        source = n.get("source")
        if not source or not source["value"]:
            return
        self.imported(source["value"], n["line"])
        if n["type"] == "ImportDeclaration":
            for s in n["specifiers"]:
                picked = s["imported"].get("name") if s["type"] == "ImportSpecifier" else None
                self.bound[s["local"]["name"]] = (bare(source["value"]), picked)

    n_ExportNamedDeclaration = n_ExportAllDeclaration = n_ImportDeclaration

    def n_VariableDeclarator(self, n: Node) -> None:
        init, target = n["init"], n["id"]
        if not init or init["type"] != "CallExpression" or not named(init["callee"], "require"):
            return
        module = static_string(init["arguments"][0] if init["arguments"] else None)
        if module is None:
            return
        if target["type"] == "Identifier":
            self.imported(module, n["line"])
            self.bound[target["name"]] = (bare(module), None)
        elif target["type"] == "ObjectPattern":
            for p in target["properties"]:
                if p["type"] == "Property" and p["value"]["type"] == "Identifier" and p["key"]["type"] == "Identifier":
                    self.bound[p["value"]["name"]] = (bare(module), p["key"]["name"])

    def n_MemberExpression(self, n: Node) -> None:
        if is_process_env(n) or is_process_env(n["object"]):
            self.cap("env", n["line"], "process.env", [])

    def n_CallExpression(self, n: Node) -> None:
        callee, literals = n["callee"], literal_arguments(n["arguments"])
        if callee["type"] == "Identifier":
            self.plain_call(n, callee["name"], literals)
        elif callee["type"] == "MemberExpression":
            prop = callee["property"]
            self.member_call(n, callee["object"], prop["name"] if prop["type"] == "Identifier" and not callee["computed"] else None, literals)

    n_NewExpression = n_CallExpression

    def plain_call(self, n: Node, name: str, literals: list[str]) -> None:
        line, new = n["line"], n["type"] == "NewExpression"
        module, picked = self.bound.get(name, (None, None))
        if name == "eval" or name == "Function" and new:
            self.facts.evals.append({"line": line, "kind": name, "literal": bool(literals), "value": literals[0] if literals else None, "snippet": self.snippet(line)})
        elif name in ("fetch", "WebSocket"):
            self.net(line, name, literals)
            self.cap("net", line, name, literals)
        elif name == "require" and not new:
            self.loaded(n, "require", n["arguments"][0] if n["arguments"] else None)
        elif name == "Worker" and module == "worker_threads":
            self.cap("workers", line, "worker_threads.Worker", literals)
        elif module is not None and picked is not None:
            self.method(line, module, picked, literals, secrets=False)
        elif module in MODULE_CAPABILITY:
            self.cap(MODULE_CAPABILITY[module], line, module, literals)

    def member_call(self, n: Node, owner: Node, name: str | None, literals: list[str]) -> None:
        line = n["line"]
        if owner["type"] != "Identifier":
            if owner["type"] == "MemberExpression" and is_process_env(owner):
                self.cap("env", line, "process.env", [])
            return
        if owner["name"] in self.bound and name:
            module, picked = self.bound[owner["name"]]
            self.method(line, module, name if picked is None else picked, literals, secrets=True)
        elif owner["name"] in self.bound:
            return
        elif owner["name"] == "String" and name == "fromCharCode":
            codes = [a["value"] for a in n["arguments"] if a["type"] == "Literal" and isinstance(a["value"], float)]
            if len(codes) >= CHARCODES:
                units = b"".join((int(c) % 65536).to_bytes(2, "little") for c in codes[:48])
                self.facts.charcodes.append({"line": line, "chars": units.decode("utf-16-le", "replace")})
        elif owner["name"] in ("http", "https", "net") and name in NET:
            api = f"{owner['name']}.{name}"
            self.net(line, api, literals)
            self.cap("net", line, api, literals)

    def method(self, line: int, module: str, method: str, literals: list[str], secrets: bool) -> None:
        api = f"{module}.{method}"
        for cap in method_capabilities(module, method):
            self.cap(cap, line, api, literals)
            if secrets and cap == "fs" and method in FS_READ and any(map(CREDENTIAL_PATH.search, literals)):
                self.cap("secret-read", line, api, literals)
        if module in NET_MODULES and method in NET:
            self.net(line, api, literals)

    def loaded(self, n: Node, kind: str, source: Node | None) -> None:
        """A require call or an import expression."""
        value = static_string(source)
        if value is not None:
            self.imported(value, n["line"], hashes_are_external=kind == "import")
        if value is None or source["type"] != "Literal":
            self.facts.dynamic.append({"line": n["line"], "kind": kind, "literals": None if value is None else [value], "snippet": self.snippet(n["line"])})

    def n_ImportExpression(self, n: Node) -> None:
        self.loaded(n, "import", n["source"])

    def n_Literal(self, n: Node) -> None:
        value = n["value"]
        if isinstance(value, str) and utf16(value) >= LITERAL_FLOOR and (kind := charset(value)):
            self.facts.encoded.append({"line": n["line"], "value": value, "charset": kind})
