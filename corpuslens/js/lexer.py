"""Tokens of ECMAScript. The parser asks for one token at a time and says when a slash begins a regular expression."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass


class JsSyntaxError(ValueError):
    """A syntax error; the message ends with (line:column), the column from 0 in UTF-16 units."""


@dataclass(slots=True)
class Token:
    kind: str  #: name, private, num, bigint, str, punct, template, regex, eof
    value: object
    start: int
    end: int
    newline: bool  #: a line terminator stands before it
    escaped: bool = False


PUNCTUATORS = sorted(
    "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #".split(), key=len, reverse=True
)
_PUNCT = re.compile("|".join(map(re.escape, PUNCTUATORS)))
_SPACE = re.compile("[\t\x0b\x0c \xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+")
_NAME = re.compile(r"[A-Za-z$_][\w$\u200c\u200d]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0[0-9]+(?:\.\d*)?(?:[eE][+-]?\d+)?|(?:\d(?:_?\d)*n|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)")
_NEWLINE = re.compile("\r\n|[\n\r\u2028\u2029]")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\x0b"}


class Lexer:
    def __init__(self, code: str, module: bool):
        self.code, self.module, self.strict = code, module, module
        self.lines = [0, *(m.end() for m in _NEWLINE.finditer(code))]
        self.begin = 0
        if code.startswith("#!"):
            m = _NEWLINE.search(code)
            self.begin = m.start() if m else len(code)

    def line_of(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def fail(self, at: int, what: str = "Unexpected token") -> JsSyntaxError:
        line = self.line_of(at)
        head = self.code[self.lines[line - 1] : at]
        return JsSyntaxError(f"{what} ({line}:{len(head) + sum(ord(c) > 0xFFFF for c in head)})")

    def skip(self, at: int) -> tuple[int, bool]:
        """Past white space and comments; whether a line terminator was among them."""
        code, n, newline = self.code, len(self.code), False
        while at < n:
            c = code[at]
            if c in "\n\r\u2028\u2029":
                newline, at = True, at + 1
            elif c == "/" and code.startswith("//", at) or not self.module and (code.startswith("<!--", at) or (newline or not code[:at].strip()) and code.startswith("-->", at)):
                m = _NEWLINE.search(code, at)
                at = m.start() if m else n
            elif code.startswith("/*", at):
                end = code.find("*/", at + 2)
                if end < 0:
                    raise self.fail(at, "Unterminated comment")
                newline |= _NEWLINE.search(code, at, end) is not None
                at = end + 2
            elif m := _SPACE.match(code, at):
                at = m.end()
            else:
                break
        return at, newline

    def token(self, at: int) -> Token:
        at, newline = self.skip(at)
        code = self.code
        if at >= len(code):
            return Token("eof", None, at, at, newline)
        c = code[at]
        if c.isascii() and (c.isalpha() or c in "$_") or c == "\\" or not c.isascii() and c.isidentifier():
            return self.name(at, newline)
        if c.isdigit() and c.isascii() or c == "." and at + 1 < len(code) and code[at + 1].isdigit() and code[at + 1].isascii():
            return self.number(at, newline)
        if c in "\"'":
            return self.string(at, newline)
        if c == "`":
            return Token("template", None, at, at + 1, newline)
        if c == "#" and at + 1 < len(code) and (code[at + 1].isidentifier() or code[at + 1] in "$\\"):
            t = self.name(at + 1, newline)
            return Token("private", t.value, at, t.end, newline)
        m = _PUNCT.match(code, at)
        if not m or m[0] == "#":
            raise self.fail(at, f"Unexpected character '{c}'")
        value = m[0]
        if value == "?." and at + 2 < len(code) and code[at + 2].isdigit():
            value = "?"
        return Token("punct", value, at, at + len(value), newline)

    def name(self, at: int, newline: bool) -> Token:
        m = _NAME.match(self.code, at)
        end = m.end() if m else at
        if end < len(self.code) and (self.code[end] == "\\" or not self.code[end].isascii()):
            return self._long_name(at, newline)
        return Token("name", m[0], at, end, newline)

    def _long_name(self, start: int, newline: bool) -> Token:
        at, out, escaped = start, [], False
        while at < len(self.code):
            c = self.code[at]
            if c == "\\":
                m = re.compile(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))").match(self.code, at)
                if not m:
                    raise self.fail(at, "Expecting Unicode escape sequence \\uXXXX")
                c, at, escaped = chr(int(m[1] or m[2], 16)), m.end(), True
            elif ("a" + c).isidentifier() or c in "$\u200c\u200d":
                at += 1
            else:
                break
            out.append(c)
        if not out:
            raise self.fail(start, f"Unexpected character '{self.code[start]}'")
        return Token("name", "".join(out), start, at, newline, escaped)

    def number(self, at: int, newline: bool) -> Token:
        m = _NUMBER.match(self.code, at)
        text, end = m[0], m.end()
        if end < len(self.code) and (self.code[end].isidentifier() or self.code[end] in "$\\" or self.code[end].isdigit()):
            raise self.fail(end, "Identifier directly after number")
        plain = text.replace("_", "")
        if plain.endswith("n") and not plain.startswith(("0x", "0X")) or plain[-1] == "n":
            return Token("bigint", plain[:-1], at, end, newline)
        if plain[:2].lower() in ("0x", "0o", "0b"):
            return Token("num", float(int(plain, 0)), at, end, newline)
        if len(plain) > 1 and plain[0] == "0" and plain.isdigit():
            if self.strict:
                raise self.fail(at, "Invalid number")
            return Token("num", float(int(plain, 8) if not set("89") & set(plain) else int(plain)), at, end, newline)
        return Token("num", float(plain), at, end, newline)

    def string(self, start: int, newline: bool) -> Token:
        quote, at, out, code = self.code[start], start + 1, [], self.code
        while True:
            m = re.compile(r"[^\\\n\r" + quote + "]*").match(code, at)
            out.append(m[0])
            at = m.end()
            if at >= len(code) or code[at] in "\n\r":
                raise self.fail(start, "Unterminated string constant")
            if code[at] == quote:
                return Token("str", "".join(out), start, at + 1, newline)
            piece, at = self.escape(at, template=False)
            out.append(piece)

    def escape(self, at: int, template: bool) -> tuple[str, int]:
        """The value of the escape at a backslash and the place after it."""
        code = self.code
        c = code[at + 1] if at + 1 < len(code) else ""
        if c == "":
            raise self.fail(at, "Unterminated string constant")
        if c in _ESCAPES:
            return _ESCAPES[c], at + 2
        if c == "x":
            m = re.compile("[0-9a-fA-F]{2}").match(code, at + 2)
            if not m:
                raise self.fail(at + 2, "Bad character escape sequence")
            return chr(int(m[0], 16)), m.end()
        if c == "u":
            m = re.compile(r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})").match(code, at + 2)
            if not m or int(m[1] or m[2], 16) > 0x10FFFF:
                raise self.fail(at + 2, "Bad character escape sequence")
            return chr(int(m[1] or m[2], 16)), m.end()
        if c == "\r" and code.startswith("\r\n", at + 1):
            return "", at + 3
        if c in "\n\r\u2028\u2029":
            return "", at + 2
        if c in "01234567":
            m = re.compile("[0-3]?[0-7]{1,2}").match(code, at + 1)
            if m[0] != "0" and (self.strict or template) or m[0] == "0" and m.end() < len(code) and code[m.end()] in "89" and (self.strict or template):
                raise self.fail(at + 1, "Octal literal in template string" if template else "Octal literal in strict mode")
            return chr(int(m[0], 8)), m.end()
        return c, at + 2

    def template(self, at: int) -> tuple[str, str | None, int, bool]:
        """Raw and cooked text from ``at`` on, the place after, and whether it ends the template (else an expression follows)."""
        start, out, code = at, [], self.code
        while True:
            m = re.compile(r"[^\\`$]*").match(code, at)
            out.append(m[0])
            at = m.end()
            if at >= len(code):
                raise self.fail(start, "Unterminated template")
            if code[at] == "`" or code.startswith("${", at):
                raw = code[start:at].replace("\r\n", "\n").replace("\r", "\n")
                cooked = "".join(out).replace("\r\n", "\n").replace("\r", "\n") if None not in out else None
                return raw, cooked, at + (1 if code[at] == "`" else 2), code[at] == "`"
            if code[at] == "$":
                out.append("$")
                at += 1
            else:
                try:
                    piece, at = self.escape(at, template=True)
                    out.append(piece)
                except JsSyntaxError:  # a tagged template may hold a bad escape
                    out.append("")
                    at += 2

    def regex(self, start: int) -> Token:
        at, inside, code = start + 1, False, self.code
        while True:
            if at >= len(code) or code[at] in "\n\r\u2028\u2029":
                raise self.fail(start, "Unterminated regular expression")
            c = code[at]
            if c == "\\":
                at += 1
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "/" and not inside:
                break
            at += 1
        m = re.compile(r"[\w$]*").match(code, at + 1)
        if not set(m[0]) <= set("dgimsuvy") or len(set(m[0])) != len(m[0]):
            raise self.fail(start, "Invalid regular expression flag")
        return Token("regex", (code[start + 1 : at], m[0]), start, m.end(), False)
