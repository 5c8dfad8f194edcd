"""Recursive descent from tokens to ESTree-like dicts.

A node is a dict with ``type``, ``start``, ``line`` and its fields. Fields stand in the order in which the syntax is
read, with the few exceptions that readers of the tree rely on (a switch case's body before its test, a labelled body
before its label). Checks beyond the grammar are few: assignment targets, strict octals and ``with``, and where
``return``, ``import`` and ``export`` may stand. Declarations are not checked for clashes.
"""

from __future__ import annotations

from .lexer import JsSyntaxError, Lexer, Token

Node = dict

KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
STRICT = frozenset("implements interface let package private protected public static yield".split())
PRECEDENCE = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


def parse(code: str, module: bool = True, loose_return: bool = False) -> Node:
    """The program's tree; JsSyntaxError if it is none."""
    try:
        return _Parser(code, module, loose_return).program()
    except RecursionError:
        raise JsSyntaxError("Nesting is too deep (1:0)") from None


class _Cover:
    """Where an object literal held ``{a = 1}``, which only a pattern may."""

    __slots__ = ("at",)

    def __init__(self):
        self.at: int | None = None


class _Parser:
    def __init__(self, code: str, module: bool, loose_return: bool):
        self.lex = Lexer(code, module)
        self.module = module
        self.in_function, self.in_async, self.in_generator = loose_return, module, False
        self.no_arrow: set[int] = set()
        self.last = 0
        self.tok: Token = self.lex.token(self.lex.begin)

    # --- tokens ---

    def next(self) -> Token:
        t = self.tok
        self.last = t.end
        self.tok = self.lex.token(t.end)
        return t

    def save(self):
        return self.tok, self.last, self.in_function, self.in_async, self.in_generator, self.lex.strict

    def restore(self, state) -> None:
        self.tok, self.last, self.in_function, self.in_async, self.in_generator, self.lex.strict = state

    def peek(self) -> Token:
        return self.lex.token(self.tok.end)

    def unexpected(self, token: Token | None = None) -> JsSyntaxError:
        return self.lex.fail((token or self.tok).start)

    def at(self, *values: str) -> bool:
        t = self.tok
        return (t.kind == "punct" or t.kind == "name" and not t.escaped) and t.value in values

    def punct(self, value: str) -> bool:
        return self.tok.kind == "punct" and self.tok.value == value

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.next()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.eat(value):
            raise self.unexpected()

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.punct("}") or self.tok.kind == "eof" or self.tok.newline):
            raise self.unexpected()

    def node(self, type_: str, at: int, /, **fields) -> Node:
        return {"type": type_, "start": at, "line": self.lex.line_of(at), **fields}

    # --- program and statements ---

    def program(self) -> Node:
        body = self.statements(("",), top=True)
        return self.node("Program", 0, body=body, sourceType="module" if self.module else "script")

    def statements(self, ends: tuple[str, ...], top: bool = False, directives: bool = True) -> list[Node]:
        out, prologue = [], directives
        while not (self.tok.kind == "eof" if top else self.at(*ends)):
            if self.tok.kind == "eof":
                raise self.unexpected()
            first = self.tok
            s = self.statement(top=top, declaration=True)
            if prologue:
                prologue = first.kind == "str" and s["type"] == "ExpressionStatement" and s["expression"]["type"] == "Literal"
                if prologue and self.lex.code[first.start + 1 : first.end - 1] == "use strict":
                    self.lex.strict = True
            out.append(s)
        return out

    def statement(self, top: bool = False, declaration: bool = False) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "punct":
            if t.value == "{":
                return self.block()
            if t.value == ";":
                self.next()
                return self.node("EmptyStatement", start)
            if t.value == "@":
                self.decorators()
                return self.statement(top, declaration)
        if t.kind == "name" and not t.escaped:
            handler = getattr(self, f"s_{t.value}", None) if t.value in KEYWORDS else None
            if t.value in ("import", "export"):
                if t.value == "import" and self.peek().value in ("(", "."):
                    handler = None
                else:
                    if not self.module:
                        raise self.lex.fail(start, "'import' and 'export' may appear only with 'sourceType: module'")
                    if not top:
                        raise self.lex.fail(start, "'import' and 'export' may only appear at the top level")
            if t.value in ("class", "const") and not declaration:
                raise self.unexpected()
            if handler:
                return handler()
            if t.value == "let" and self.starts_binding(self.peek()):
                if not declaration:
                    raise self.unexpected()
                return self.variables(start)
            if t.value == "async" and (p := self.peek()).value == "function" and not p.newline and p.kind == "name":
                self.next()
                return self.function(start, statement=True, is_async=True)
        expression = self.expression()
        if expression["type"] == "Identifier" and t.kind == "name" and self.punct(":"):
            self.next()
            return self.node("LabeledStatement", start, body=self.statement(declaration=self.at("function")), label=expression)
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=expression)

    @staticmethod
    def starts_binding(t: Token) -> bool:
        return t.kind == "name" and (t.value not in KEYWORDS) or t.kind == "punct" and t.value in "[{"

    def block(self) -> Node:
        start = self.tok.start
        self.expect("{")
        body = self.statements(("}",), directives=False)
        self.next()
        return self.node("BlockStatement", start, body=body)

    def variables(self, start: int, no_in: bool = False, ended: bool = True) -> Node:
        kind = self.next().value
        out = []
        while True:
            at = self.tok.start
            target = self.binding()
            init = self.assign(no_in) if self.eat("=") else None
            if init is None and ended and (kind == "const" or target["type"] != "Identifier"):
                raise self.unexpected()
            out.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                break
        if ended:
            self.semicolon()
        return self.node("VariableDeclaration", start, declarations=out, kind=kind)

    def s_var(self):
        return self.variables(self.tok.start)

    s_const = s_var

    def s_function(self):
        return self.function(self.tok.start, statement=True)

    def s_class(self):
        return self.class_(statement=True)

    def s_if(self):
        start = self.next().start
        test = self.parenthesised()
        then = self.statement(declaration=self.at("function"))
        other = self.statement(declaration=self.at("function")) if self.eat("else") else None
        return self.node("IfStatement", start, test=test, consequent=then, alternate=other)

    def parenthesised(self) -> Node:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def s_while(self):
        start = self.next().start
        test = self.parenthesised()
        return self.node("WhileStatement", start, test=test, body=self.statement())

    def s_do(self):
        start = self.next().start
        body = self.statement()
        self.expect("while")
        test = self.parenthesised()
        self.eat(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def s_for(self):
        start = self.next().start
        wait = self.in_async and self.eat("await")
        self.expect("(")
        if self.punct(";"):
            init = None
        elif self.at("var", "const") or self.at("let") and self.starts_binding(self.peek()):
            init = self.variables(self.tok.start, no_in=True, ended=False)
            if self.at("in", "of") and len(init["declarations"]) == 1:
                return self.for_in(start, init, wait)
            for d in init["declarations"]:
                if d["init"] is None and (init["kind"] == "const" or d["id"]["type"] != "Identifier"):
                    raise self.unexpected()
        else:
            cover, first = _Cover(), self.tok
            init = self.expression(no_in=True, cover=cover)
            if self.at("of", "in") and not (self.at("of") and first.value == "let" and init["type"] == "Identifier"):
                return self.for_in(start, self.pattern(init), wait)
            self.covered(cover)
        if wait:
            raise self.unexpected()
        self.expect(";")
        test = None if self.punct(";") else self.expression()
        self.expect(";")
        update = None if self.punct(")") else self.expression()
        self.expect(")")
        return self.node("ForStatement", start, init=init, test=test, update=update, body=self.statement())

    def for_in(self, start: int, left: Node, wait: bool) -> Node:
        of = self.next().value == "of"
        right = self.assign() if of else self.expression()
        self.expect(")")
        body = self.statement()
        return self.node("ForOfStatement", start, **{"await": wait}, left=left, right=right, body=body) if of else self.node("ForInStatement", start, left=left, right=right, body=body)

    def s_return(self):
        start = self.tok.start
        if not self.in_function:
            raise self.lex.fail(start, "'return' outside of function")
        self.next()
        value = None if self.tok.newline or self.at(";", "}") or self.tok.kind == "eof" else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, argument=value)

    def s_throw(self):
        start = self.next().start
        if self.tok.newline:
            raise self.lex.fail(self.last, "Illegal newline after throw")
        value = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, argument=value)

    def s_break(self):
        t = self.next()
        label = self.identifier() if self.tok.kind == "name" and not self.tok.newline and self.tok.value not in KEYWORDS else None
        self.semicolon()
        return self.node("BreakStatement" if t.value == "break" else "ContinueStatement", t.start, label=label)

    s_continue = s_break

    def s_debugger(self):
        start = self.next().start
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def s_with(self):
        start = self.tok.start
        if self.lex.strict:
            raise self.lex.fail(start, "'with' in strict mode")
        self.next()
        value = self.parenthesised()
        return self.node("WithStatement", start, object=value, body=self.statement())

    def s_switch(self):
        start = self.next().start
        value = self.parenthesised()
        self.expect("{")
        cases = []
        while not self.eat("}"):
            at = self.tok.start
            if self.eat("default"):
                test = None
            else:
                self.expect("case")
                test = self.expression()
            self.expect(":")
            body = self.statements(("case", "default", "}"), directives=False)
            cases.append(self.node("SwitchCase", at, consequent=body, test=test))
        return self.node("SwitchStatement", start, discriminant=value, cases=cases)

    def s_try(self):
        start = self.next().start
        block, handler = self.block(), None
        if self.at("catch"):
            at = self.next().start
            param = None
            if self.eat("("):
                param = self.binding()
                self.expect(")")
            handler = self.node("CatchClause", at, param=param, body=self.block())
        final = self.block() if self.eat("finally") else None
        if not handler and not final:
            raise self.lex.fail(start, "Missing catch or finally clause")
        return self.node("TryStatement", start, block=block, handler=handler, finalizer=final)

    # --- modules ---

    def s_import(self):
        start = self.next().start
        specifiers: list[Node] = []
        if self.tok.kind != "str":
            if self.tok.kind == "name" and not self.at("from") or self.at("from") and self.peek().value == "from":
                specifiers.append(self.node("ImportDefaultSpecifier", self.tok.start, local=self.identifier()))
                more = self.eat(",")
            else:
                more = True
            if more and self.punct("*"):
                at = self.next().start
                self.expect("as")
                specifiers.append(self.node("ImportNamespaceSpecifier", at, local=self.identifier()))
            elif more:
                self.expect("{")
                while not self.eat("}"):
                    at = self.tok.start
                    imported = self.module_name()
                    local = self.identifier() if self.eat("as") else imported
                    if local["type"] != "Identifier" or local["name"] in KEYWORDS:
                        raise self.unexpected()
                    specifiers.append(self.node("ImportSpecifier", at, imported=imported, local=local))
                    if not self.punct("}"):
                        self.expect(",")
            self.expect("from")
        source = self.source()
        return self.node("ImportDeclaration", start, specifiers=specifiers, source=source, attributes=self.attributes())

    def module_name(self) -> Node:
        if self.tok.kind == "str":
            t = self.next()
            return self.node("Literal", t.start, value=t.value)
        if self.tok.kind != "name":
            raise self.unexpected()
        t = self.next()
        return self.node("Identifier", t.start, name=t.value)

    def source(self) -> Node:
        if self.tok.kind != "str":
            raise self.unexpected()
        t = self.next()
        return self.node("Literal", t.start, value=t.value)

    def attributes(self) -> list[Node]:
        out = []
        if self.at("with") or self.at("assert") and not self.tok.newline:
            self.next()
            self.expect("{")
            while not self.eat("}"):
                at, key = self.tok.start, self.module_name()
                self.expect(":")
                out.append(self.node("ImportAttribute", at, key=key, value=self.source()))
                if not self.punct("}"):
                    self.expect(",")
        self.semicolon()
        return out

    def s_export(self):
        start = self.next().start
        if self.eat("*"):
            exported = self.module_name() if self.eat("as") else None
            self.expect("from")
            source = self.source()
            return self.node("ExportAllDeclaration", start, exported=exported, source=source, attributes=self.attributes())
        if self.eat("default"):
            at = self.tok.start
            if self.at("function"):
                value = self.function(at, statement=True, nameless=True)
            elif self.at("async") and (p := self.peek()).value == "function" and not p.newline:
                self.next()
                value = self.function(at, statement=True, is_async=True, nameless=True)
            elif self.at("class", "@"):
                self.decorators()
                value = self.class_(statement=True, nameless=True)
            else:
                value = self.assign()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, declaration=value)
        if self.punct("{"):
            self.next()
            specifiers = []
            while not self.eat("}"):
                at, local = self.tok.start, self.module_name()
                exported = self.module_name() if self.eat("as") else local
                specifiers.append(self.node("ExportSpecifier", at, local=local, exported=exported))
                if not self.punct("}"):
                    self.expect(",")
            if self.eat("from"):
                source = self.source()
                attributes = self.attributes()
            else:
                source, attributes = None, []
                self.semicolon()
            return self.node("ExportNamedDeclaration", start, declaration=None, specifiers=specifiers, source=source, attributes=attributes)
        declaration = self.statement(declaration=True)
        if declaration["type"] not in ("VariableDeclaration", "FunctionDeclaration", "ClassDeclaration"):
            raise self.lex.fail(declaration["start"])
        return self.node("ExportNamedDeclaration", start, declaration=declaration, specifiers=[], source=None)

    # --- functions, classes, patterns ---

    def function(self, start: int, statement: bool, is_async: bool = False, nameless: bool = False) -> Node:
        self.expect("function")
        generator = self.eat("*")
        name = None
        if self.tok.kind == "name" and not self.punct("("):
            name = self.identifier()
        elif statement and not nameless:
            raise self.unexpected()
        params, body = self.callable(is_async, generator)
        return self.node("FunctionDeclaration" if statement else "FunctionExpression", start, id=name, generator=generator, expression=False, **{"async": is_async}, params=params, body=body)

    def callable(self, is_async: bool, generator: bool) -> tuple[list[Node], Node]:
        kept = self.in_function, self.in_async, self.in_generator, self.lex.strict
        self.in_function, self.in_async, self.in_generator = True, is_async, generator
        params = self.params()
        body = self.function_body()
        self.in_function, self.in_async, self.in_generator, self.lex.strict = kept
        return params, body

    def function_body(self) -> Node:
        start = self.tok.start
        self.expect("{")
        body = self.statements(("}",))
        self.next()
        return self.node("BlockStatement", start, body=body)

    def params(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.eat(")"):
            self.decorators()
            out.append(self.rest() if self.punct("...") else self.binding_default())
            if not self.punct(")"):
                if out[-1]["type"] == "RestElement":
                    raise self.unexpected()
                self.expect(",")
        return out

    def rest(self) -> Node:
        start = self.next().start
        return self.node("RestElement", start, argument=self.binding())

    def binding_default(self) -> Node:
        start, left = self.tok.start, self.binding()
        return self.node("AssignmentPattern", start, left=left, right=self.assign()) if self.eat("=") else left

    def binding(self) -> Node:
        start = self.tok.start
        if self.punct("["):
            self.next()
            items: list[Node | None] = []
            while not self.eat("]"):
                if self.punct(","):
                    self.next()
                    items.append(None)
                    continue
                items.append(self.rest() if self.punct("...") else self.binding_default())
                if not self.punct("]"):
                    self.expect(",")
            return self.node("ArrayPattern", start, elements=items)
        if self.punct("{"):
            self.next()
            properties = []
            while not self.eat("}"):
                properties.append(self.rest() if self.punct("...") else self.binding_property())
                if not self.punct("}"):
                    self.expect(",")
            return self.node("ObjectPattern", start, properties=properties)
        return self.identifier()

    def binding_property(self) -> Node:
        t, start = self.tok, self.tok.start
        computed, key = self.key()
        if self.eat(":"):
            value, short = self.binding_default(), False
        else:
            if t.kind != "name" or computed:
                raise self.unexpected()
            self.check_name(t)
            value, short = dict(key), True
            if self.eat("="):
                value = self.node("AssignmentPattern", start, left=value, right=self.assign())
        return self.node("Property", start, method=False, shorthand=short, computed=computed, key=key, kind="init", value=value)

    def key(self) -> tuple[bool, Node]:
        t = self.tok
        if self.eat("["):
            inner = self.assign()
            self.expect("]")
            return True, inner
        if t.kind in ("str", "num", "bigint"):
            self.next()
            return False, self.node("Literal", t.start, value=t.value if t.kind != "bigint" else None)
        if t.kind == "private":
            self.next()
            return False, self.node("PrivateIdentifier", t.start, name=t.value)
        if t.kind != "name":
            raise self.unexpected()
        self.next()
        return False, self.node("Identifier", t.start, name=t.value)

    def identifier(self) -> Node:
        t = self.tok
        if t.kind != "name":
            raise self.unexpected()
        self.check_name(t)
        self.next()
        return self.node("Identifier", t.start, name=t.value)

    def check_name(self, t: Token) -> None:
        if t.value in KEYWORDS or t.value == "enum":
            raise self.unexpected(t)
        if t.value == "await" and (self.in_async or self.module) or t.value == "yield" and (self.in_generator or self.lex.strict):
            raise self.unexpected(t)
        if self.lex.strict and t.value in STRICT:
            raise self.lex.fail(t.start, f"The keyword '{t.value}' is reserved")

    def decorators(self) -> None:
        if self.punct("@"):
            raise self.lex.fail(self.tok.start, "Unexpected character '@'")

    def class_(self, statement: bool, nameless: bool = False) -> Node:
        start = self.next().start
        kept, self.lex.strict = self.lex.strict, True
        name = None
        if self.tok.kind == "name" and not self.at("extends"):
            name = self.identifier()
        elif statement and not nameless:
            raise self.unexpected()
        parent = self.subscripts(self.tok.start, self.primary()) if self.eat("extends") else None
        at = self.tok.start
        self.expect("{")
        members = []
        while not self.eat("}"):
            if not self.eat(";"):
                members.append(self.member())
        self.lex.strict = kept
        body = self.node("ClassBody", at, body=members)
        return self.node("ClassDeclaration" if statement else "ClassExpression", start, id=name, superClass=parent, body=body)

    def modifier(self, word: str) -> bool:
        """Eats ``word`` if it is a modifier here and not the member's name."""
        if not self.at(word):
            return False
        p = self.peek()
        if p.kind == "punct" and p.value in ("(", "=", ";", "}", ",", ":") or p.kind == "eof" or word == "async" and p.newline:
            return False
        self.next()
        return True

    def member(self) -> Node:
        start = self.tok.start
        self.decorators()
        static = self.modifier("static")
        if static and self.punct("{"):
            kept = self.in_function, self.in_async, self.in_generator
            self.in_function, self.in_async, self.in_generator = False, False, False
            block = self.block()
            self.in_function, self.in_async, self.in_generator = kept
            return self.node("StaticBlock", start, body=block["body"])
        is_async = self.modifier("async")
        generator = self.eat("*")
        kind = "method"
        if not is_async and not generator:
            for word in ("get", "set"):
                if self.modifier(word):
                    kind = word
                    break
        computed, key = self.key()
        if self.punct("("):
            at = self.tok.start
            if kind == "method" and not static and not computed and key.get("name", key.get("value")) == "constructor":
                kind = "constructor"
            params, body = self.callable(is_async, generator)
            value = self.node("FunctionExpression", at, id=None, generator=generator, expression=False, **{"async": is_async}, params=params, body=body)
            return self.node("MethodDefinition", start, static=static, computed=computed, key=key, kind=kind, value=value)
        if kind != "method" or is_async or generator:
            raise self.unexpected()
        value = None
        if self.eat("="):
            kept = self.in_async, self.in_generator
            self.in_async, self.in_generator = False, False
            value = self.assign()
            self.in_async, self.in_generator = kept
        self.semicolon()
        return self.node("PropertyDefinition", start, static=static, computed=computed, key=key, value=value)

    # --- expressions ---

    def covered(self, cover: _Cover) -> None:
        if cover.at is not None:
            raise self.lex.fail(cover.at, "Shorthand property assignments are valid only in destructuring patterns")

    def expression(self, no_in: bool = False, cover: _Cover | None = None) -> Node:
        start, own = self.tok.start, cover or _Cover()
        first = self.assign(no_in, own)
        if not self.punct(","):
            if cover is None:
                self.covered(own)
            return first
        out = [first]
        while self.eat(","):
            out.append(self.assign(no_in, own))
        if cover is None:
            self.covered(own)
        return self.node("SequenceExpression", start, expressions=out)

    def assign(self, no_in: bool = False, cover: _Cover | None = None) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "name" and not t.escaped:
            if t.value == "yield" and self.in_generator:
                return self.yield_(no_in)
            if t.value == "async" and (p := self.peek()).kind == "name" and not p.newline and p.value not in KEYWORDS and self.lex.token(p.end).value == "=>":
                self.next()
                return self.arrow(start, [self.identifier()], True, no_in)
            if t.value == "async" and p.value == "(" and not p.newline and p.kind == "punct":
                found = self.try_arrow(start, True, no_in)
                if found:
                    return found
            if t.value not in KEYWORDS and (p := self.peek()).value == "=>" and p.kind == "punct" and not p.newline:
                return self.arrow(start, [self.identifier()], False, no_in)
        elif t.kind == "punct" and t.value == "(":
            found = self.try_arrow(start, False, no_in)
            if found:
                return found
        own = _Cover()
        left = self.conditional(no_in, own)
        if self.tok.kind == "punct" and self.tok.value in ASSIGN:
            operator = self.tok.value
            target = self.pattern(left) if operator == "=" else self.target(left)
            if operator != "=":
                self.covered(own)
            self.next()
            return self.node("AssignmentExpression", start, operator=operator, left=target, right=self.assign(no_in))
        if own.at is not None:
            if cover is None:
                self.covered(own)
            cover.at = own.at
        return left

    def try_arrow(self, start: int, is_async: bool, no_in: bool) -> Node | None:
        """An arrow function if its parameter list begins here. Places that begin none are remembered, so nesting costs no more than once."""
        if start in self.no_arrow:
            return None
        state = self.save()
        try:
            if is_async:
                self.next()
                self.in_async = True
            params = self.params()
            if not self.punct("=>") or self.tok.newline:
                raise self.unexpected()
        except JsSyntaxError:
            self.restore(state)
            self.no_arrow.add(start)
            return None
        self.in_async = state[3]
        return self.arrow(start, params, is_async, no_in)

    def arrow(self, start: int, params: list[Node], is_async: bool, no_in: bool) -> Node:
        if self.tok.newline:
            raise self.unexpected()
        self.expect("=>")
        kept = self.in_function, self.in_async, self.in_generator, self.lex.strict
        self.in_function, self.in_async, self.in_generator = True, is_async, False
        if self.punct("{"):
            body, short = self.function_body(), False
        else:
            self.in_function = kept[0]
            body, short = self.assign(no_in), True
        self.in_function, self.in_async, self.in_generator, self.lex.strict = kept
        return self.node("ArrowFunctionExpression", start, id=None, expression=short, generator=False, **{"async": is_async}, params=params, body=body)

    def yield_(self, no_in: bool) -> Node:
        start = self.next().start
        if self.tok.newline or self.at(")", "]", "}", ",", ";", ":", "in", "of") or self.tok.kind == "eof":
            return self.node("YieldExpression", start, delegate=False, argument=None)
        delegate = self.eat("*")
        return self.node("YieldExpression", start, delegate=delegate, argument=self.assign(no_in))

    def conditional(self, no_in: bool, cover: _Cover) -> Node:
        start = self.tok.start
        test = self.binary(self.unary(cover), start, 0, no_in)
        if not self.punct("?"):
            return test
        self.next()
        then = self.assign()
        self.expect(":")
        return self.node("ConditionalExpression", start, test=test, consequent=then, alternate=self.assign(no_in))

    def binary(self, left: Node, start: int, least: int, no_in: bool) -> Node:
        while True:
            t = self.tok
            rank = PRECEDENCE.get(t.value, 0) if t.kind == "punct" or t.kind == "name" and not t.escaped else 0
            if rank <= least or t.value == "in" and no_in:
                return left
            self.next()
            at = self.tok.start
            right = self.binary(self.unary(None), at, rank - (t.value == "**"), no_in)
            if t.value == "??" and any(x["type"] == "LogicalExpression" and x["operator"] in ("||", "&&") and not x.get("wrapped") for x in (left, right)):
                raise self.lex.fail(t.start, "Logical expressions and coalesce expressions cannot be mixed. Wrap either by parentheses")
            left = self.node("LogicalExpression" if t.value in ("??", "||", "&&") else "BinaryExpression", start, left=left, operator=t.value, right=right)

    def unary(self, cover: _Cover | None) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "punct" and t.value in ("++", "--"):
            self.next()
            return self.node("UpdateExpression", start, operator=t.value, prefix=True, argument=self.target(self.unary(None)))
        if t.kind == "punct" and t.value in ("+", "-", "!", "~") or t.kind == "name" and t.value in ("typeof", "void", "delete") and not t.escaped:
            self.next()
            argument = self.unary(None)
            if t.value == "delete" and self.lex.strict and argument["type"] == "Identifier":
                raise self.lex.fail(start, "Deleting local variable in strict mode")
            if self.punct("**"):
                raise self.unexpected()
            return self.node("UnaryExpression", start, operator=t.value, prefix=True, argument=argument)
        if t.kind == "name" and t.value == "await" and not t.escaped and self.in_async:
            self.next()
            return self.node("AwaitExpression", start, argument=self.unary(None))
        if t.kind == "private" and self.peek().value == "in":
            self.next()
            return self.node("PrivateIdentifier", start, name=t.value)
        own = _Cover()
        e = self.subscripts(start, self.primary(own))
        if own.at is not None:
            if cover is None or e["type"] not in ("ObjectExpression", "ArrayExpression"):
                self.covered(own)
            cover.at = own.at
        if self.tok.kind == "punct" and self.tok.value in ("++", "--") and not self.tok.newline:
            operator = self.tok.value
            target = self.target(e)
            self.next()
            return self.node("UpdateExpression", start, operator=operator, prefix=False, argument=target)
        return e

    def subscripts(self, start: int, base: Node, calls: bool = True) -> Node:
        chain = False
        while True:
            t = self.tok
            if t.kind == "template":
                if chain:
                    raise self.lex.fail(t.start, "Optional chaining cannot appear in the tag of tagged template expressions")
                base = self.node("TaggedTemplateExpression", start, tag=base, quasi=self.template(tagged=True))
                continue
            if t.kind != "punct":
                break
            optional = t.value == "?."
            if optional:
                if not calls:
                    raise self.lex.fail(t.start, "Optional chaining cannot appear in the callee of new expressions")
                chain = True
                self.next()
            if self.punct("["):
                self.next()
                prop = self.expression()
                self.expect("]")
                base = self.node("MemberExpression", start, object=base, property=prop, computed=True, optional=optional)
            elif self.punct("(") and calls:
                base = self.node("CallExpression", start, callee=base, arguments=self.arguments(), optional=optional)
            elif optional and self.tok.kind == "template":
                raise self.lex.fail(self.tok.start, "Optional chaining cannot appear in the tag of tagged template expressions")
            elif optional or t.value == ".":
                if not optional:
                    self.next()
                if self.tok.kind not in ("name", "private"):
                    raise self.unexpected()
                p = self.next()
                prop = self.node("PrivateIdentifier" if p.kind == "private" else "Identifier", p.start, name=p.value)
                base = self.node("MemberExpression", start, object=base, property=prop, computed=False, optional=optional)
            else:
                break
        return self.node("ChainExpression", start, expression=base) if chain else base

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.eat(")"):
            out.append(self.spread() if self.punct("...") else self.assign())
            if not self.punct(")"):
                self.expect(",")
        return out

    def spread(self, cover: _Cover | None = None) -> Node:
        start = self.next().start
        return self.node("SpreadElement", start, argument=self.assign(False, cover))

    def template(self, tagged: bool = False) -> Node:
        start, at = self.tok.start, self.tok.end
        expressions, quasis = [], []
        while True:
            raw, cooked, after, tail = self.lex.template(at)
            quasis.append(self.node("TemplateElement", at, value={"raw": raw, "cooked": cooked}, tail=tail))
            if tail:
                self.last = after
                self.tok = self.lex.token(after)
                return self.node("TemplateLiteral", start, expressions=expressions, quasis=quasis)
            self.tok = self.lex.token(after)
            expressions.append(self.expression())
            if not self.punct("}"):
                raise self.unexpected()
            at = self.tok.end

    def primary(self, cover: _Cover | None = None) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "punct":
            if t.value in ("/", "/="):
                self.tok = self.lex.regex(start)
                value = self.next().value
                return self.node("Literal", start, value=None, regex={"pattern": value[0], "flags": value[1]})
            if t.value == "(":
                self.next()
                e = self.expression()
                self.expect(")")
                return {**e, "wrapped": True} if e["type"] in ("LogicalExpression", "ObjectExpression", "ArrayExpression", "AssignmentExpression") else e
            if t.value == "[":
                return self.array(cover)
            if t.value == "{":
                return self.object(cover)
            self.decorators()
            raise self.unexpected()
        if t.kind in ("num", "str"):
            self.next()
            return self.node("Literal", start, value=t.value)
        if t.kind == "bigint":
            self.next()
            return self.node("Literal", start, value=None, bigint=t.value)
        if t.kind == "template":
            return self.template()
        if t.kind != "name":
            raise self.unexpected()
        if t.escaped or t.value not in KEYWORDS:
            if t.value == "async" and not t.escaped and (p := self.peek()).value == "function" and p.kind == "name" and not p.newline:
                self.next()
                return self.function(start, statement=False, is_async=True)
            return self.identifier()
        if t.value == "function":
            return self.function(start, statement=False)
        if t.value == "class":
            return self.class_(statement=False)
        if t.value == "new":
            return self.new()
        if t.value == "import":
            return self.import_()
        if t.value in ("this", "super", "null", "true", "false"):
            self.next()
            if t.value == "this":
                return self.node("ThisExpression", start)
            if t.value == "super":
                if not self.at("(", ".", "["):
                    raise self.unexpected()
                return self.node("Super", start)
            return self.node("Literal", start, value={"null": None, "true": True, "false": False}[t.value])
        raise self.unexpected()

    def import_(self) -> Node:
        start = self.next().start
        if self.eat("."):
            t = self.tok
            if not self.eat("meta") or not self.module:
                raise self.unexpected(t)
            return self.node("MetaProperty", start, meta=self.node("Identifier", start, name="import"), property=self.node("Identifier", t.start, name="meta"))
        self.expect("(")
        source = self.assign()
        options = None
        if self.eat(",") and not self.punct(")"):
            options = self.assign()
            self.eat(",")
        self.expect(")")
        return self.node("ImportExpression", start, source=source, options=options)

    def new(self) -> Node:
        start = self.next().start
        if self.eat("."):
            t = self.tok
            if not self.eat("target"):
                raise self.unexpected(t)
            return self.node("MetaProperty", start, meta=self.node("Identifier", start, name="new"), property=self.node("Identifier", t.start, name="target"))
        if self.at("import"):
            raise self.unexpected()
        at = self.tok.start
        callee = self.subscripts(at, self.primary(), calls=False)
        arguments = self.arguments() if self.punct("(") else []
        return self.node("NewExpression", start, callee=callee, arguments=arguments)

    def array(self, cover: _Cover | None) -> Node:
        start, own = self.next().start, _Cover()
        items: list[Node | None] = []
        while not self.eat("]"):
            if self.punct(","):
                self.next()
                items.append(None)
                continue
            items.append(self.spread(own) if self.punct("...") else self.assign(False, own))
            if not self.punct("]"):
                self.expect(",")
        if own.at is not None:
            if cover is None:
                self.covered(own)
            cover.at = own.at
        return self.node("ArrayExpression", start, elements=items)

    def object(self, cover: _Cover | None) -> Node:
        start, own = self.next().start, _Cover()
        out = []
        while not self.eat("}"):
            out.append(self.spread(own) if self.punct("...") else self.property(own))
            if not self.punct("}"):
                self.expect(",")
        if own.at is not None:
            if cover is None:
                self.covered(own)
            cover.at = own.at
        return self.node("ObjectExpression", start, properties=out)

    def property(self, cover: _Cover) -> Node:
        start = self.tok.start
        self.decorators()
        is_async = self.modifier("async")
        generator = self.eat("*")
        kind = "init"
        if not is_async and not generator:
            for word in ("get", "set"):
                if self.modifier(word):
                    kind = word
                    break
        t = self.tok
        computed, key = self.key()
        if key["type"] == "PrivateIdentifier":
            raise self.unexpected(t)
        if self.punct("(") or kind != "init" or is_async or generator:
            at = self.tok.start
            params, body = self.callable(is_async, generator)
            value = self.node("FunctionExpression", at, id=None, generator=generator, expression=False, **{"async": is_async}, params=params, body=body)
            return self.node("Property", start, method=kind == "init", shorthand=False, computed=computed, key=key, kind=kind, value=value)
        if self.eat(":"):
            return self.node("Property", start, method=False, shorthand=False, computed=computed, key=key, value=self.assign(False, cover), kind="init")
        if t.kind != "name" or computed:
            raise self.unexpected()
        self.check_name(t)
        value = dict(key)
        if self.punct("="):
            cover.at = self.tok.start if cover.at is None else cover.at
            self.next()
            value = self.node("AssignmentPattern", start, left=value, right=self.assign())
        return self.node("Property", start, method=False, shorthand=True, computed=False, key=key, kind="init", value=value)

    # --- assignment targets ---

    def target(self, node: Node) -> Node:
        if node["type"] in ("Identifier", "MemberExpression"):
            return node
        raise self.lex.fail(node["start"], "Assigning to rvalue")

    def pattern(self, node: Node) -> Node:
        """A literal read again as a destructuring pattern."""
        kind = node["type"]
        if kind in ("Identifier", "MemberExpression", "ObjectPattern", "ArrayPattern", "AssignmentPattern"):
            return node
        if node.get("wrapped"):
            raise self.lex.fail(node["start"], "Parenthesized pattern" if kind != "AssignmentExpression" else "Assigning to rvalue")
        if kind == "AssignmentExpression" and node["operator"] == "=":
            return {**{k: v for k, v in node.items() if k != "operator"}, "type": "AssignmentPattern"}
        if kind == "ArrayExpression":
            return {**node, "type": "ArrayPattern", "elements": [x and self.element(x) for x in node["elements"]]}
        if kind == "ObjectExpression":
            for p in node["properties"]:
                if p["type"] == "Property" and (p["method"] or p["kind"] != "init"):
                    raise self.lex.fail(p["key"]["start"], "Object pattern can't contain getter or setter")
            return {**node, "type": "ObjectPattern", "properties": [self.element(p) if p["type"] == "SpreadElement" else {**p, "value": self.pattern(p["value"])} for p in node["properties"]]}
        raise self.lex.fail(node["start"], "Assigning to rvalue")

    def element(self, node: Node) -> Node:
        if node["type"] == "SpreadElement":
            return {**node, "type": "RestElement", "argument": self.pattern(node["argument"])}
        return self.pattern(node)
