"""Syntax check of JavaScript and TypeScript modules.

A predictive parser over token kinds (see ecma_lex). Lines that once parsed as whole statements are
remembered by their kinds, so a collection of files costs little more than its different statements.
Only syntax is looked at: no types, no names, no duplicate declarations.
"""

from __future__ import annotations

import re
from array import array

from strandline.sources.ecma_lex import END, GENERIC, GENERIC_PLAIN, IDENT, NAME, WORD, LexError, careful_kinds, fast_tokens, kinds_of

(BREAK, CASE, CATCH, CLASS, CONST, CONTINUE, DEBUGGER, DEFAULT, DELETE, DO, ELSE, ENUM, EXPORT, EXTENDS, FINALLY, FOR, FUNCTION, IF, IMPORT, IN, INSTANCEOF, NEW, RETURN, SWITCH, THROW, TRY, TYPEOF, VAR, VOID, WHILE, WITH) = (
    WORD[w] for w in "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return switch throw try typeof var void while with".split()
)
(AS, ASYNC, AWAIT, YIELD, OF, GET, SET, STATIC, TYPE, INTERFACE, NAMESPACE, MODULE, DECLARE, ABSTRACT, READONLY, FROM, LET, KEYOF, INFER, IS, ASSERTS, UNIQUE, SATISFIES, OVERRIDE, PUBLIC, PRIVATE, PROTECTED, ACCESSOR, GLOBAL, OUT, USING, REQUIRE) = (
    WORD[w] for w in "as async await yield of get set static type interface namespace module declare abstract readonly from let keyof infer is asserts unique satisfies override public private protected accessor global out using require".split()
)
_MODIFIERS = frozenset((STATIC, DECLARE, ABSTRACT, READONLY, OVERRIDE, PUBLIC, PRIVATE, PROTECTED, ACCESSOR))
_PARAMETER_MODIFIERS = frozenset((READONLY, OVERRIDE, PUBLIC, PRIVATE, PROTECTED))
_KEYS = NAME | frozenset("snh[")
_AFTER_TYPE_ARGUMENTS = frozenset(("(", ")", "]", "}", ":", ";", ",", ".", "Q", "?", "=", "o", "u", "&", "|", "t", "\x04", END, "a", "A"))
_CONTINUES = frozenset((ELSE, CATCH, FINALLY))
_CLOSER = {"(": ")", "[": "]", "{": "}"}
#: What a parsed expression may be used as.
VALUE, TARGET, PATTERN = 0, 1, 2
_IN_FUNCTION, _IN_ASYNC, _IN_GENERATOR, _IN_LOOP, _IN_SWITCH, _AMBIENT = 1, 2, 4, 8, 16, 32


class SyntaxFailure(ValueError):
    pass


class _Memory:
    """Lines known to be whole statements or members, by grammar and context."""

    LIMIT = 1_000_000

    def __init__(self) -> None:
        self.known: set[tuple] = set()

    def add(self, key: tuple) -> None:
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        self.known.add(key)


_memory = _Memory()


class _Tokens:
    """A text's token kinds without line ends, where its lines begin, and the partner of each bracket."""

    def __init__(self, kinds: str) -> None:
        lines = kinds.split("\n")
        self.t = "".join(lines) + END
        n = len(self.t)
        self.line_at: dict[int, str] = {}
        self.nl = bytearray(n + 1)
        at = 0
        for line in lines:
            if line:
                self.line_at[at] = line
                self.nl[at] = 1
                at += len(line)
        self.nl[n - 1] = 1
        self.close = close = array("i", bytes(4 * len(self.t)))
        stack: list[int] = []
        t = self.t
        for m in re.finditer(r"[()\[\]{}]", t):
            at = m.start()
            c = t[at]
            if c in "([{":
                stack.append(at)
            else:
                if not stack or _CLOSER[t[stack[-1]]] != c:
                    raise SyntaxFailure("brackets don't match")
                close[stack.pop()] = at
        if stack:
            raise SyntaxFailure("a bracket isn't closed")


class _Parser:
    def __init__(self, tokens: _Tokens, typed: bool, jsx: bool = False) -> None:
        self.t, self.line_at, self.nl, self.close = tokens.t, tokens.line_at, tokens.nl, tokens.close
        self.i = 0
        self.typed = typed
        self.assertions = typed and not jsx
        self.ctx = 0
        self.in_ok = True
        self.cond = 0

    def fail(self, what: str = "unexpected token") -> None:
        raise SyntaxFailure(f"{what} (token {self.i})")

    def eat(self, kind: str) -> None:
        if self.t[self.i] != kind:
            self.fail(f"expected {kind}")
        self.i += 1

    def has(self, kind: str) -> bool:
        if self.t[self.i] == kind:
            self.i += 1
            return True
        return False

    def ident(self) -> None:
        if self.t[self.i] not in IDENT:
            self.fail("expected a name")
        self.i += 1

    def semi(self) -> None:
        k = self.t[self.i]
        if k == ";":
            self.i += 1
        elif k != "}" and k != END and not self.nl[self.i]:
            self.fail("expected a semicolon")

    def end_type_list(self) -> None:
        if self.t[self.i] not in ">G":
            self.fail("expected >")
        self.i += 1

    # statements

    def module(self) -> None:
        self.statements(END)

    def statements(self, until: str) -> None:
        t, known = self.t, _memory.known
        while t[self.i] != until:
            start = self.i
            line = self.line_at.get(start)
            if line is not None and line[-1] == ";":
                key = (self.ctx, self.typed, self.assertions, line)
                after = start + len(line)
                if key in known and t[after] not in _CONTINUES:
                    self.i = after
                    continue
                self.statement()
                if self.i == after and t[start] != DO:
                    _memory.add(key)
            else:
                self.statement()

    def block(self) -> None:
        self.eat("{")
        self.statements("}")
        self.i += 1

    def body(self, ctx: int) -> None:
        """A function's body, or in ambient code and overloads its absence."""
        saved, self.ctx, loose, self.in_ok = self.ctx, ctx | (self.ctx & _AMBIENT), self.in_ok, True
        self.block()
        self.ctx, self.in_ok = saved, loose

    def nested(self, extra: int) -> None:
        """One statement inside another; declarations can't stand there."""
        saved, self.ctx = self.ctx, self.ctx | extra
        k = self.t[self.i]
        if k in (CONST, CLASS) or k == LET and self.t[self.i + 1] in IDENT | frozenset("{[") and not self.nl[self.i + 1]:
            self.fail("declaration in place of a statement")
        self.statement()
        self.ctx = saved

    def statement(self) -> None:
        t, i = self.t, self.i
        k = t[i]
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
            return None
        n = t[i + 1] if k != END else END
        if k in (CONST, VAR) or k == LET and (n in IDENT or n in "{["):
            if k == CONST and n == ENUM and self.typed:
                self.i += 1
                return self.enum()
            self.i += 1
            self.bindings(k == CONST)
            return self.semi()
        if k == IF:
            self.i += 1
            self.paren()
            self.nested(0)
            if self.has(ELSE):
                self.nested(0)
            return None
        if k == RETURN:
            if not self.ctx & _IN_FUNCTION:
                self.fail("return outside a function")
            self.i += 1
            if t[self.i] not in (";", "}", END) and not self.nl[self.i]:
                self.expression()
            return self.semi()
        if k == FOR:
            return self.for_()
        if k == WHILE:
            self.i += 1
            self.paren()
            return self.nested(_IN_LOOP)
        if k == FUNCTION:
            return self.function(True)
        if k == ASYNC and n == FUNCTION and not self.nl[i + 1]:
            return self.function(True)
        if k == CLASS:
            return self.class_(True)
        if k == "@":
            self.decorators()
            if t[self.i] not in (EXPORT, CLASS, ABSTRACT, DEFAULT):
                self.fail("decorators must precede a class")
            return self.statement()
        if k == IMPORT and n not in ("(", "."):
            return self.import_()
        if k == EXPORT:
            return self.export()
        if k == TRY:
            self.i += 1
            self.block()
            if t[self.i] not in (CATCH, FINALLY):
                self.fail("expected catch or finally")
            if self.has(CATCH):
                if self.has("("):
                    self.binding()
                    if self.typed and self.has(":"):
                        self.type()
                    self.eat(")")
                self.block()
            if self.has(FINALLY):
                self.block()
            return None
        if k == SWITCH:
            self.i += 1
            self.paren()
            self.eat("{")
            saved, self.ctx = self.ctx, self.ctx | _IN_SWITCH
            default = False
            while not self.has("}"):
                if self.has(DEFAULT):
                    if default:
                        self.fail("second default")
                    default = True
                else:
                    self.eat(CASE)
                    self.expression()
                self.eat(":")
                while t[self.i] not in (CASE, DEFAULT, "}"):
                    self.statement()
            self.ctx = saved
            return None
        if k == THROW:
            self.i += 1
            if self.nl[self.i]:
                self.fail("newline after throw")
            self.expression()
            return self.semi()
        if k in (BREAK, CONTINUE):
            self.i += 1
            if t[self.i] in IDENT and not self.nl[self.i]:
                self.i += 1
            elif not self.ctx & (_IN_LOOP | (_IN_SWITCH if k == BREAK else 0)):
                self.fail("break or continue outside a loop")
            return self.semi()
        if k == DO:
            self.i += 1
            self.nested(_IN_LOOP)
            self.eat(WHILE)
            self.paren()
            self.has(";")
            return None
        if k == DEBUGGER:
            self.i += 1
            return self.semi()
        if self.typed and self.declaration():
            return None
        if k in IDENT and n == ":":
            self.i += 2
            return self.nested(_IN_LOOP)
        self.expression()
        return self.semi()

    def declaration(self) -> bool:
        """A declaration that TypeScript adds; false if none begins here."""
        t, i = self.t, self.i
        k, n = t[i], t[i + 1]
        if self.nl[i + 1] and k != ENUM:
            return False
        if k == INTERFACE and n in IDENT:
            self.i += 2
            self.type_parameters()
            if self.has(EXTENDS):
                self.type_reference()
                while self.has(","):
                    self.type_reference()
            self.object_type()
            return True
        if k == TYPE and n in IDENT and t[i + 2] in "=<":
            self.i += 2
            self.type_parameters()
            self.eat("=")
            self.type()
            self.semi()
            return True
        if k == ENUM:
            self.enum()
            return True
        if k == ABSTRACT and n == CLASS:
            self.i += 1
            self.class_(True)
            return True
        if k in (NAMESPACE, MODULE) and (n in IDENT or n == "s"):
            self.i += 2
            while self.has("."):
                self.ident()
            saved, self.ctx = self.ctx, self.ctx & _AMBIENT
            if t[self.i] == "{" or not self.ctx & _AMBIENT:
                self.block()
            else:
                self.semi()
            self.ctx = saved
            return True
        if k == DECLARE and (n in IDENT or n in (CONST, VAR, FUNCTION, CLASS, ENUM)):
            self.i += 1
            saved, self.ctx = self.ctx, self.ctx | _AMBIENT
            if n == GLOBAL and t[self.i + 1] == "{":
                self.i += 1
                self.block()
            else:
                self.statement()
            self.ctx = saved
            return True
        return False

    def enum(self) -> None:
        if not self.typed:
            self.fail("enum")
        self.eat(ENUM)
        self.ident()
        self.eat("{")
        while not self.has("}"):
            if self.t[self.i] not in NAME and self.t[self.i] != "s":
                self.fail("expected an enum member")
            self.i += 1
            if self.has("="):
                self.assignment()
            if self.t[self.i] != "}":
                self.eat(",")

    def paren(self) -> None:
        self.eat("(")
        saved, self.in_ok = self.in_ok, True
        self.expression()
        self.in_ok = saved
        self.eat(")")

    def for_(self) -> None:
        t = self.t
        self.i += 1
        if t[self.i] == AWAIT:
            self.i += 1
        self.eat("(")
        k, n = t[self.i], t[self.i + 1]
        if k in (CONST, VAR) or k == LET and (n in IDENT or n in "{["):
            self.i += 1
            saved, self.in_ok = self.in_ok, False
            self.binding()
            if self.typed and self.has(":"):
                self.type()
            if t[self.i] in (OF, IN):
                self.in_ok = saved
                of = t[self.i] == OF
                self.i += 1
                self.assignment() if of else self.expression()
                self.eat(")")
                return self.nested(_IN_LOOP)
            if self.has("="):
                self.assignment()
            elif k == CONST:
                self.fail("const without a value")
            while self.has(","):
                self.one_binding(k == CONST)
            self.in_ok = saved
        elif k != ";":
            saved, self.in_ok = self.in_ok, False
            what = self.expression()
            self.in_ok = saved
            if t[self.i] in (OF, IN):
                if what == VALUE:
                    self.fail("can't be assigned")
                self.i += 1
                self.expression()
                self.eat(")")
                return self.nested(_IN_LOOP)
        self.eat(";")
        if t[self.i] != ";":
            self.expression()
        self.eat(";")
        if t[self.i] != ")":
            self.expression()
        self.eat(")")
        return self.nested(_IN_LOOP)

    def bindings(self, const: bool) -> None:
        self.one_binding(const)
        while self.has(","):
            self.one_binding(const)

    def one_binding(self, const: bool) -> None:
        pattern = self.t[self.i] in "{["
        self.binding()
        if self.typed:
            if self.t[self.i] == "!" and self.t[self.i + 1] == ":":
                self.i += 1
            if self.has(":"):
                self.type()
        if self.has("="):
            self.assignment()
        elif (const or pattern) and not self.ctx & _AMBIENT:
            self.fail("declaration without a value")

    def binding(self) -> None:
        t = self.t
        k = t[self.i]
        if k in IDENT:
            self.i += 1
        elif k == "[":
            self.i += 1
            while not self.has("]"):
                if self.has(","):
                    continue
                rest = self.has("E")
                self.binding()
                if not rest and self.has("="):
                    self.assignment()
                if t[self.i] != "]":
                    self.eat(",")
                    if rest:
                        self.fail("something after the rest")
        elif k == "{":
            self.i += 1
            while not self.has("}"):
                if self.has("E"):
                    self.binding()
                else:
                    k = t[self.i]
                    if k == "[":
                        self.i += 1
                        self.assignment()
                        self.eat("]")
                        self.eat(":")
                        self.binding()
                    else:
                        if k not in NAME and k not in "sn":
                            self.fail("expected a name")
                        self.i += 1
                        if self.has(":"):
                            self.binding()
                        elif k not in IDENT:
                            self.fail("a reserved word can't be bound")
                    if self.has("="):
                        self.assignment()
                if t[self.i] != "}":
                    self.eat(",")
        else:
            self.fail("expected a name or pattern")

    def function(self, statement: bool) -> None:
        ctx = _IN_FUNCTION
        if self.has(ASYNC):
            ctx |= _IN_ASYNC
        self.eat(FUNCTION)
        if self.has("*"):
            ctx |= _IN_GENERATOR
        if statement is True or self.t[self.i] in IDENT:
            self.ident()
        self.signature_and_body(ctx)

    def signature_and_body(self, ctx: int, optional: bool = True) -> None:
        self.type_parameters()
        self.parameters(ctx)
        if self.typed and self.has(":"):
            self.return_type()
        if self.t[self.i] == "{":
            self.body(ctx)
        elif self.typed and optional:
            self.semi()
        else:
            self.fail("expected a body")

    def parameters(self, ctx: int) -> None:
        self.eat("(")
        t = self.t
        saved, self.ctx = self.ctx, ctx | (self.ctx & _AMBIENT)
        loose, self.in_ok = self.in_ok, True
        while not self.has(")"):
            if t[self.i] == "@":
                self.decorators()
            rest = self.has("E")
            if self.typed:
                while t[self.i] in _PARAMETER_MODIFIERS and (t[self.i + 1] in IDENT or t[self.i + 1] in "{["):
                    self.i += 1
                if t[self.i] == "l":
                    self.i += 1
                else:
                    self.binding()
                self.has("?")
                if self.has(":"):
                    self.type()
            else:
                self.binding()
            if self.has("="):
                if rest:
                    self.fail("a rest parameter has no default")
                self.assignment()
            if t[self.i] != ")":
                self.eat(",")
                if rest:
                    self.fail("something after the rest")
        self.ctx, self.in_ok = saved, loose

    def decorators(self) -> None:
        while self.has("@"):
            if self.t[self.i] == "(":
                self.paren()
            else:
                if self.t[self.i] not in NAME:
                    self.fail("expected a decorator")
                self.i += 1
                while self.has("."):
                    self.name()
                if self.t[self.i] in "<(":
                    if self.t[self.i] == "<":
                        self.type_arguments()
                    self.arguments()

    def name(self) -> None:
        if self.t[self.i] not in NAME and self.t[self.i] != "h":
            self.fail("expected a name")
        self.i += 1

    def class_(self, statement: bool) -> None:
        self.eat(CLASS)
        t = self.t
        if t[self.i] in IDENT:
            self.i += 1
        elif statement is True:
            self.fail("class without a name")
        self.type_parameters()
        if self.has(EXTENDS):
            self.unary()
            if self.typed and t[self.i] == "<":
                self.type_arguments()
        if self.typed and t[self.i] == "i":  # implements
            self.i += 1
            self.type_reference()
            while self.has(","):
                self.type_reference()
        self.eat("{")
        saved, loose, self.in_ok = self.ctx, self.in_ok, True
        while not self.has("}"):
            if self.has(";"):
                continue
            self.member()
        self.ctx, self.in_ok = saved, loose

    def member(self) -> None:
        t = self.t
        start = self.i
        line = self.line_at.get(start)
        if line is not None and line[-1] == ";":
            key = ("member", self.typed, self.assertions, self.ctx & _AMBIENT, line)
            if key in _memory.known:
                self.i += len(line)
                return
            self._member()
            if self.has(";"):
                pass
            if self.i == start + len(line):
                _memory.add(key)
            return
        self._member()

    def _member(self) -> None:
        t = self.t
        if t[self.i] == "@":
            self.decorators()
        ends = frozenset(("(", "=", ";", "}", ":", "?", "!", "<", ",", END))
        if t[self.i] == STATIC and t[self.i + 1] == "{":
            self.i += 1
            return self.body(_IN_FUNCTION)
        while t[self.i] in (_MODIFIERS if self.typed else (STATIC, ACCESSOR)) and t[self.i + 1] not in ends and not (self.nl[self.i + 1] and t[self.i] != STATIC):
            self.i += 1
        ctx = _IN_FUNCTION
        accessor = False
        if t[self.i] == ASYNC and t[self.i + 1] not in ends and not self.nl[self.i + 1]:
            ctx |= _IN_ASYNC
            self.i += 1
        if self.has("*"):
            ctx |= _IN_GENERATOR
        if t[self.i] in (GET, SET) and t[self.i + 1] not in ends and not self.nl[self.i + 1]:
            self.i += 1
            accessor = True
        if self.typed and t[self.i] == "[" and t[self.i + 1] in IDENT and t[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.eat("]")
            self.eat(":")
            self.type()
            return self.semi()
        self.key()
        if self.typed and t[self.i] in "?!":
            self.i += 1
        if t[self.i] in "(<":
            if t[self.i] == "<" and not self.typed:
                self.fail()
            return self.signature_and_body(ctx)
        if accessor or ctx != _IN_FUNCTION:
            self.fail("expected parameters")
        if self.typed and self.has(":"):
            self.type()
        if self.has("="):
            saved, self.ctx = self.ctx, _IN_FUNCTION
            self.assignment()
            self.ctx = saved
        return self.semi()

    def key(self) -> None:
        k = self.t[self.i]
        if k not in _KEYS:
            self.fail("expected a member's name")
        self.i += 1
        if k == "[":
            saved, self.in_ok = self.in_ok, True
            self.assignment()
            self.in_ok = saved
            self.eat("]")

    def import_(self) -> None:
        t = self.t
        if self.ctx & _IN_FUNCTION:
            self.fail("import inside a function")
        self.i += 1
        if self.has("s"):
            self.import_attributes()
            return self.semi()
        if self.typed and t[self.i] == TYPE and (t[self.i + 1] in "{*" or t[self.i + 1] in IDENT and (t[self.i + 1] != FROM or t[self.i + 2] in (FROM, "="))):
            self.i += 1
        if t[self.i] in IDENT:
            self.i += 1
            if self.typed and self.has("="):
                if t[self.i] == REQUIRE and t[self.i + 1] == "(":
                    self.i += 2
                    self.eat("s")
                    self.eat(")")
                else:
                    self.ident()
                    while self.has("."):
                        self.name()
                return self.semi()
            if t[self.i] != FROM:
                self.eat(",")
                if t[self.i] not in "*{":
                    self.fail()
        if self.has("*"):
            self.eat(AS)
            self.ident()
        elif t[self.i] == "{":
            self.specifiers(True)
        self.eat(FROM)
        self.eat("s")
        self.import_attributes()
        return self.semi()

    def import_attributes(self) -> None:
        if self.t[self.i] == WITH and self.t[self.i + 1] == "{":
            self.i += 1
            self.object()

    def specifiers(self, importing: bool) -> None:
        t = self.t
        self.eat("{")
        while not self.has("}"):
            if self.typed and t[self.i] == TYPE and t[self.i + 1] not in (",", "}") and (t[self.i + 1] != AS or t[self.i + 2] in IDENT):
                self.i += 1
            plain = t[self.i] in IDENT
            if t[self.i] not in NAME and t[self.i] != "s":
                self.fail("expected a name")
            self.i += 1
            if self.has(AS):
                if importing:
                    self.ident()
                elif t[self.i] in NAME or t[self.i] == "s":
                    self.i += 1
                else:
                    self.fail("expected a name")
            elif importing and not plain:
                self.fail("a reserved word can't be imported")
            if t[self.i] != "}":
                self.eat(",")

    def export(self) -> None:
        t = self.t
        if self.ctx & _IN_FUNCTION:
            self.fail("export inside a function")
        self.i += 1
        k, n = t[self.i], t[self.i + 1]
        if k == DEFAULT:
            self.i += 1
            k, n = t[self.i], t[self.i + 1]
            if k == FUNCTION or k == ASYNC and n == FUNCTION and not self.nl[self.i + 1]:
                return self.function(False)
            if k == "@":
                self.decorators()
                k = t[self.i]
            if k == CLASS:
                return self.class_(False)
            if self.typed and (k == ABSTRACT and n == CLASS):
                self.i += 1
                return self.class_(False)
            if self.typed and k == INTERFACE and n in IDENT:
                self.declaration()
                return None
            self.assignment()
            return self.semi()
        if k == "*":
            self.i += 1
            if self.has(AS):
                if not self.has("s"):
                    self.name()
            self.eat(FROM)
            self.eat("s")
            self.import_attributes()
            return self.semi()
        if self.typed and k == TYPE and n in "{*":
            self.i += 1
            k = t[self.i]
            if k == "*":
                self.i -= 1
                t_saved = self.i
                self.i = t_saved + 2
                if self.has(AS):
                    self.name()
                self.eat(FROM)
                self.eat("s")
                return self.semi()
        if k == "{":
            self.specifiers(False)
            if self.has(FROM):
                self.eat("s")
                self.import_attributes()
            return self.semi()
        if self.typed and k == "=":
            self.i += 1
            self.assignment()
            return self.semi()
        if self.typed and k == AS and n == NAMESPACE:
            self.i += 2
            self.ident()
            return self.semi()
        if self.typed and k == IMPORT:
            return self.import_()
        if k in (CONST, VAR, FUNCTION, CLASS, "@") or k == LET or k == ASYNC and n == FUNCTION:
            return self.statement()
        if self.typed and self.declaration():
            return None
        return self.fail("nothing to export")

    # expressions

    def expression(self) -> int:
        what = self.assignment()
        while self.t[self.i] == ",":
            self.i += 1
            self.assignment()
            what = VALUE
        return what

    def assignment(self) -> int:
        t, i = self.t, self.i
        k = t[i]
        if k in IDENT:
            n = t[i + 1]
            if n == "a" and not self.nl[i + 1]:
                self.i += 2
                self.arrow_body(0)
                return VALUE
            if k == ASYNC and not self.nl[i + 1]:
                if n in IDENT and t[i + 2] == "a":
                    self.i += 3
                    self.arrow_body(_IN_ASYNC)
                    return VALUE
                if (n == "(" or n == "<" and self.typed) and self.arrow(i + 1, _IN_ASYNC):
                    return VALUE
            if k == YIELD and self.ctx & _IN_GENERATOR:
                self.i += 1
                if not self.nl[self.i] and t[self.i] not in (")", "]", "}", ",", ";", ":", END, IN, OF):
                    self.has("*")
                    self.assignment()
                return VALUE
        elif k == "(" or k == "<" and self.typed:
            if self.arrow(i, 0):
                return VALUE
        what = self.conditional()
        k = t[self.i]
        if k == "=":
            if what == VALUE:
                self.fail("can't be assigned")
            self.i += 1
            self.assignment()
            return VALUE
        if k == "A":
            if what != TARGET:
                self.fail("can't be assigned")
            self.i += 1
            self.assignment()
            return VALUE
        return what

    def arrow(self, at: int, extra: int) -> bool:
        """An arrow function whose parameters (or type parameters) begin at `at`; else false and nothing is read."""
        t, saved = self.t, self.i
        if t[at] == "(":
            after = self.close[at] + 1
            if t[after] == "a":
                if self.nl[after]:
                    return False
                self.i = at
                self.parameters(_IN_FUNCTION | extra)
                self.i += 1
                self.arrow_body(extra)
                return True
            if not self.typed or t[after] != ":":
                return False
            first = t[at + 1]
            if first not in IDENT and first not in "){[El@":
                return False
        if t[at] == "<" and not self.assertions and t[at + 1] != CONST and t[at + 2] not in (",", EXTENDS):
            return False  # with JSX, that would be an element
        context = (self.ctx, self.in_ok)
        try:
            self.i = at
            if t[at] == "<":
                self.type_parameters()
            self.parameters(_IN_FUNCTION | extra)
            if self.has(":"):
                self.return_type()
            if t[self.i] != "a" or self.nl[self.i]:
                raise SyntaxFailure("no arrow")
            self.i += 1
            self.arrow_body(extra)
            if self.cond and t[at] == "(" and t[self.i] != ":" and self.close[at] + 1 < self.i and t[self.close[at] + 1] == ":":
                raise SyntaxFailure("the colon belongs to a condition")
            return True
        except SyntaxFailure:
            self.i = saved
            self.ctx, self.in_ok = context
            return False

    def arrow_body(self, extra: int) -> None:
        ctx = _IN_FUNCTION | extra | (self.ctx & _AMBIENT)
        if self.t[self.i] == "{":
            saved, self.cond = self.cond, 0
            self.body(ctx)
            self.cond = saved
        else:
            saved, self.ctx = self.ctx, ctx
            self.assignment()
            self.ctx = saved

    def conditional(self) -> int:
        what = self.binary()
        if self.t[self.i] == "?":
            self.i += 1
            loose, self.in_ok = self.in_ok, True
            self.cond += 1
            self.assignment()
            self.cond -= 1
            self.in_ok = loose
            self.eat(":")
            self.assignment()
            return VALUE
        return what

    def binary(self) -> int:
        t = self.t
        what = self.unary()
        while True:
            k = t[self.i]
            if k in "ou*&|<":
                self.i += 1
            elif k == ">":
                self.i += 1
            elif k == "G":
                self.i += 1
                while t[self.i] == "G":
                    self.i += 1
                self.i += 1  # the > or = it is glued to
                # >>= and >>>= assign; >= compares
                if t[self.i - 1] == "=" and t[self.i - 2] == "G" and t[self.i - 3] == "G":
                    self.assignment()
                    return VALUE
            elif k == IN:
                if not self.in_ok:
                    return what
                self.i += 1
            elif k == INSTANCEOF:
                self.i += 1
            elif self.typed and k in (AS, SATISFIES) and not self.nl[self.i]:
                self.i += 1
                if t[self.i] == CONST:
                    self.i += 1
                else:
                    self.type()
                continue
            else:
                return what
            self.unary()
            what = VALUE

    def unary(self) -> int:
        t = self.t
        k = t[self.i]
        if k in "!~u" or k in (TYPEOF, VOID, DELETE):
            self.i += 1
            self.unary()
            return VALUE
        if k == "I":
            self.i += 1
            if self.unary() != TARGET:
                self.fail("can't be counted up or down")
            return VALUE
        if k == AWAIT and (self.ctx & _IN_ASYNC or not self.ctx & _IN_FUNCTION):
            self.i += 1
            self.unary()
            return VALUE
        if k == "<" and self.assertions:
            self.i += 1
            if not self.has(CONST):
                self.type()
            self.end_type_list()
            self.unary()
            return VALUE
        what = self.postfix_chain()
        if t[self.i] == "I" and not self.nl[self.i]:
            if what != TARGET:
                self.fail("can't be counted up or down")
            self.i += 1
            return VALUE
        return what

    def postfix_chain(self) -> int:
        t = self.t
        k = t[self.i]
        if k == NEW:
            what = self.new()
        else:
            what = self.primary()
        return self.chain(what, True)

    def chain(self, what: int, calls: bool) -> int:
        t = self.t
        while True:
            k = t[self.i]
            if k == ".":
                self.i += 1
                self.name()
                what = TARGET
            elif k == "(" and calls:
                self.arguments()
                what = VALUE
            elif k == "[":
                self.i += 1
                loose, self.in_ok = self.in_ok, True
                self.expression()
                self.in_ok = loose
                self.eat("]")
                what = TARGET
            elif k == "Q" and calls:
                self.i += 1
                k = t[self.i]
                if k == "(":
                    self.arguments()
                elif k == "[":
                    self.i += 1
                    self.expression()
                    self.eat("]")
                elif k == "<" and self.typed:
                    self.type_arguments()
                    self.arguments()
                else:
                    self.name()
                what = VALUE
            elif k == "t":
                self.i += 1
                what = VALUE
            elif k == "\x04":
                self.template()
                what = VALUE
            elif k == "!" and self.typed and not self.nl[self.i]:
                self.i += 1
            elif k == "<" and self.typed and self.generic_call():
                what = VALUE
            else:
                return what

    def generic_call(self) -> bool:
        saved = self.i
        try:
            self.type_arguments()
        except SyntaxFailure:
            self.i = saved
            return False
        k = self.t[self.i]
        if k in _AFTER_TYPE_ARGUMENTS or self.nl[self.i]:
            return True
        self.i = saved
        return False

    def arguments(self) -> None:
        self.eat("(")
        t = self.t
        loose, self.in_ok = self.in_ok, True
        saved, self.cond = self.cond, 0
        while t[self.i] != ")":
            self.has("E")
            self.assignment()
            if t[self.i] != ")":
                self.eat(",")
        self.i += 1
        self.in_ok, self.cond = loose, saved

    def new(self) -> int:
        t = self.t
        self.i += 1
        if self.has("."):
            self.name()
            return VALUE
        if t[self.i] == NEW:
            self.new()
        else:
            if t[self.i] == IMPORT:
                self.fail("import can't be constructed")
            self.primary()
            self.chain(VALUE, False)
        if t[self.i] == "(":
            self.arguments()
        return VALUE

    def template(self) -> None:
        self.i += 1
        while self.has("{"):
            self.expression()
            self.eat("}")
        self.eat("\x05")

    def primary(self) -> int:
        t = self.t
        k = t[self.i]
        if k in IDENT:
            if k == ASYNC and t[self.i + 1] == FUNCTION and not self.nl[self.i + 1]:
                self.function(False)
                return VALUE
            self.i += 1
            return TARGET
        if k in "lnsrt":
            self.i += 1
            return VALUE
        if k == "(":
            self.i += 1
            loose, self.in_ok = self.in_ok, True
            saved, self.cond = self.cond, 0
            what = self.expression()
            self.in_ok, self.cond = loose, saved
            self.eat(")")
            return TARGET if what == TARGET else VALUE
        if k == "[":
            self.i += 1
            loose, self.in_ok = self.in_ok, True
            saved, self.cond = self.cond, 0
            while t[self.i] != "]":
                if self.has(","):
                    continue
                self.has("E")
                self.assignment()
                if t[self.i] != "]":
                    self.eat(",")
            self.i += 1
            self.in_ok, self.cond = loose, saved
            return PATTERN
        if k == "{":
            return self.object()
        if k == FUNCTION:
            self.function(False)
            return VALUE
        if k == CLASS:
            self.class_(False)
            return VALUE
        if k == "\x04":
            self.template()
            return VALUE
        if k == "J":
            self.element()
            return VALUE
        if k == "S":
            self.i += 1
            if t[self.i] not in "(.[":
                self.fail("super alone")
            return VALUE
        if k == IMPORT:
            self.i += 1
            if self.has("."):
                self.name()
            elif t[self.i] != "(":
                self.fail("import in an expression")
            return VALUE
        if k == "h" and t[self.i + 1] == IN:
            self.i += 1
            return VALUE
        if k == "@":
            self.decorators()
            self.class_(False)
            return VALUE
        self.fail()
        return VALUE

    def element(self) -> None:
        self.i += 1
        t = self.t
        while not self.has("j"):
            if t[self.i] == "J":
                self.element()
            else:
                self.eat("{")
                if self.has("}"):
                    continue
                self.has("E")
                self.expression()
                self.eat("}")

    def object(self) -> int:
        t = self.t
        self.eat("{")
        loose, self.in_ok = self.in_ok, True
        saved, self.cond = self.cond, 0
        what = PATTERN
        covered = False
        ends = frozenset((",", "}", ":", "(", "=", "<"))
        while not self.has("}"):
            if self.has("E"):
                self.assignment()
            else:
                ctx = _IN_FUNCTION
                special = False
                if t[self.i] == ASYNC and t[self.i + 1] not in ends and not self.nl[self.i + 1]:
                    self.i += 1
                    ctx |= _IN_ASYNC
                    special = True
                if self.has("*"):
                    ctx |= _IN_GENERATOR
                    special = True
                if t[self.i] in (GET, SET) and t[self.i + 1] not in ends:
                    self.i += 1
                    special = True
                k = t[self.i]
                if k == "h":
                    self.fail("a private name in an object")
                self.key()
                if t[self.i] == "(" or t[self.i] == "<" and self.typed:
                    self.signature_and_body(ctx, False)
                elif special:
                    self.fail("expected parameters")
                elif self.has(":"):
                    self.assignment()
                elif k in IDENT:
                    if self.has("="):
                        self.assignment()
                        covered = True
                else:
                    self.fail("a property without a value")
            if t[self.i] != "}":
                self.eat(",")
        self.in_ok, self.cond = loose, saved
        if covered and t[self.i] not in ("=", ")", "}", "]", ",", OF, IN):
            self.fail("a default outside a pattern")
        return what

    # types

    def type_parameters(self) -> None:
        if self.t[self.i] != "<":
            return
        if not self.typed:
            self.fail("type parameters")
        self.i += 1
        while True:
            while self.t[self.i] in (CONST, IN, OUT) and self.t[self.i + 1] in (IDENT | {IN}):
                self.i += 1
            self.ident()
            if self.has(EXTENDS):
                self.type()
            if self.has("="):
                self.type()
            if not self.has(","):
                break
            if self.t[self.i] in ">G":
                break
        self.end_type_list()

    def type_arguments(self) -> None:
        self.eat("<")
        self.type()
        while self.has(","):
            self.type()
        self.end_type_list()

    def return_type(self) -> None:
        t, i = self.t, self.i
        if t[i] == ASSERTS and (t[i + 1] in IDENT or t[i + 1] == "l") and not self.nl[i + 1] and t[i + 1] != IS:
            self.i += 2
            if self.has(IS):
                self.type()
            return
        if (t[i] in IDENT or t[i] == "l") and t[i + 1] == IS and not self.nl[i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        t = self.t
        k = t[self.i]
        if k == "<" or k == NEW or k == ABSTRACT and t[self.i + 1] == NEW:
            return self.function_type()
        if k == "(" and self.is_function_type():
            return self.function_type()
        self.union_type()
        if t[self.i] == EXTENDS and not self.nl[self.i] and not self.no_conditional:
            self.i += 1
            saved, self.no_conditional = self.no_conditional, True
            self.type()
            self.no_conditional = saved
            self.eat("?")
            self.type()
            self.eat(":")
            self.type()
        return None

    no_conditional = False

    def is_function_type(self) -> bool:
        return self.t[self.close[self.i] + 1] == "a"

    def function_type(self) -> None:
        self.has(ABSTRACT)
        self.has(NEW)
        self.type_parameters()
        self.parameters(self.ctx)
        self.eat("a")
        self.return_type()

    def union_type(self) -> None:
        t = self.t
        if t[self.i] in "|&":
            self.i += 1
        while True:
            self.operator_type()
            if t[self.i] not in "|&":
                return
            self.i += 1

    def operator_type(self) -> None:
        t = self.t
        k, n = t[self.i], t[self.i + 1]
        if k in (KEYOF, UNIQUE, READONLY) and (n in NAME or n in "([{st\x04"):
            self.i += 1
            return self.operator_type()
        if k == INFER and n in IDENT:
            self.i += 2
            if t[self.i] == EXTENDS:
                saved, mark, self.no_conditional = self.no_conditional, self.i, True
                self.i += 1
                self.type()
                self.no_conditional = saved
                if t[self.i] == "?" and not saved:
                    self.i = mark
            return None
        if k == "(" and self.is_function_type() or k == NEW or k == ABSTRACT and n == NEW or k == "<":
            return self.function_type()
        self.primary_type()
        while t[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if t[self.i] != "]":
                self.free_type()
            self.eat("]")
        return None

    def free_type(self) -> None:
        """A type inside brackets, where conditional types are possible again."""
        saved, self.no_conditional = self.no_conditional, False
        self.type()
        self.no_conditional = saved

    def primary_type(self) -> None:
        t = self.t
        k = t[self.i]
        if k in IDENT:
            if k == ASSERTS and t[self.i + 1] in IDENT and not self.nl[self.i + 1]:
                self.i += 1
            return self.type_reference()
        if k in ("l", VOID, "s", "n", "t"):
            self.i += 1
            if k == "l" and t[self.i] == IS and not self.nl[self.i]:
                self.i += 1
                self.type()
            return None
        if k == "\x04":
            self.i += 1
            while self.has("{"):
                self.free_type()
                self.eat("}")
            return self.eat("\x05")
        if k == "u":
            self.i += 1
            return self.eat("n")
        if k == "(":
            self.i += 1
            self.free_type()
            return self.eat(")")
        if k == "{":
            return self.object_type()
        if k == "[":
            self.i += 1
            while not self.has("]"):
                self.has("E")
                if t[self.i] in NAME and (t[self.i + 1] == ":" or t[self.i + 1] == "?" and t[self.i + 2] == ":"):
                    self.i += 1
                    self.has("?")
                    self.eat(":")
                self.free_type()
                self.has("?")
                if t[self.i] != "]":
                    self.eat(",")
            return None
        if k == TYPEOF:
            self.i += 1
            if t[self.i] == IMPORT:
                return self.primary_type()
            if t[self.i] not in NAME:
                self.fail("expected a name")
            self.i += 1
            while self.has("."):
                self.name()
            if t[self.i] == "<" and not self.nl[self.i]:
                self.type_arguments()
            return None
        if k == IMPORT:
            self.i += 1
            self.eat("(")
            self.type()
            self.eat(")")
            while self.has("."):
                self.name()
            if t[self.i] == "<":
                self.type_arguments()
            return None
        return self.fail("expected a type")

    def type_reference(self) -> None:
        self.ident()
        while self.has("."):
            self.name()
        if self.t[self.i] == "<" and not self.nl[self.i]:
            saved, self.no_conditional = self.no_conditional, False
            self.type_arguments()
            self.no_conditional = saved

    def object_type(self) -> None:
        t = self.t
        self.eat("{")
        known = _memory.known
        saved, self.no_conditional = self.no_conditional, False
        if t[self.i] in "u" or t[self.i] in (READONLY, "[") and self.mapped():
            self.no_conditional = saved
            return self.mapped_type()
        while not self.has("}"):
            start = self.i
            line = self.line_at.get(start)
            if line is not None and line[-1] in ";,":
                key = ("type", line)
                if key in known:
                    self.i += len(line)
                    continue
                self.type_member()
                if self.i == start + len(line):
                    _memory.add(key)
            else:
                self.type_member()
        self.no_conditional = saved
        return None

    def mapped(self) -> bool:
        t, i = self.t, self.i
        if t[i] == READONLY:
            i += 1
        return t[i] == "[" and t[i + 1] in IDENT and t[i + 2] == IN

    def mapped_type(self) -> None:
        if self.has("u"):
            self.eat(READONLY)
        else:
            self.has(READONLY)
        self.eat("[")
        self.ident()
        self.eat(IN)
        self.free_type()
        if self.has(AS):
            self.free_type()
        self.eat("]")
        if self.has("u"):
            self.eat("?")
        else:
            self.has("?")
        if self.has(":"):
            self.free_type()
        self.has(";")
        self.eat("}")

    def type_member(self) -> None:
        t = self.t
        ends = frozenset(("(", "=", ";", "}", ":", "?", ",", "<"))
        if t[self.i] == NEW and t[self.i + 1] in "(<":
            self.i += 1
        elif t[self.i] not in "(<":
            if t[self.i] == READONLY and t[self.i + 1] not in ends:
                self.i += 1
            if t[self.i] in (GET, SET) and t[self.i + 1] not in ends:
                self.i += 1
            if t[self.i] == "[" and t[self.i + 1] in IDENT and t[self.i + 2] == ":":
                self.i += 3
                self.type()
                self.eat("]")
                self.eat(":")
                self.type()
                return self.end_member()
            self.key()
            self.has("?")
        if t[self.i] in "(<":
            self.type_parameters()
            self.parameters(self.ctx)
            if self.has(":"):
                self.return_type()
        elif self.has(":"):
            self.type()
        return self.end_member()

    def end_member(self) -> None:
        if not self.has(",") and not self.has(";") and self.t[self.i] != "}" and not self.nl[self.i]:
            self.fail("expected the end of a member")


#: fixed values: what the ending of a path says: (TypeScript, JSX)
GRAMMARS = {"ts": (True, False), "mts": (True, False), "cts": (True, False), "tsx": (True, True), "js": (False, True), "jsx": (False, True), "mjs": (False, False), "cjs": (False, False)}
_MAYBE_JSX = re.compile(r"</|/>")
#: kinds with a < that may begin an expression; one right behind a name in its line can't
_BEGINS = re.compile(r"(?<!i)<")


class Source:
    """A module's text that is checked in several grammars: it is split into tokens once."""

    def __init__(self, text: str | None) -> None:
        text = text or ""
        self.text = text[1:] if text[:1] == "\ufeff" else text
        self.tokens = fast_tokens(self.text)
        self.kinds, self.certain = kinds_of(self.tokens)
        self.maybe_jsx = bool(_MAYBE_JSX.search(self.text))
        self.generic = self.maybe_jsx and bool(GENERIC.search(self.text))
        self._prepared: dict[str, _Tokens | str] = {}
        self._careful: dict[tuple[bool, bool, bool], str | LexError] = {}
        self._known: dict[tuple[str, bool, bool], str | None] = {}

    def _attempt(self, kinds: str, typed: bool, jsx: bool) -> str | None:
        # to the parser JSX changes only what a < that begins an expression may mean, and that only beside types
        key = (kinds, typed, typed and jsx and bool(_BEGINS.search(kinds)))
        if key in self._known:
            return self._known[key]
        if kinds not in self._prepared:
            try:
                self._prepared[kinds] = _Tokens(kinds)
            except SyntaxFailure as error:
                self._prepared[kinds] = str(error)
        tokens = self._prepared[kinds]
        error = tokens if isinstance(tokens, str) else None
        if error is None:
            try:
                _Parser(tokens, typed, jsx).module()
            except SyntaxFailure as failure:
                error = str(failure)
            except RecursionError:
                error = "nested too deeply"
        self._known[key] = error
        return error

    def _kinds(self, jsx: bool, typed: bool, plain_generic: bool) -> str | LexError:
        # types matter to the careful lexer only where a < may begin type parameters or a tag's type arguments
        key = (jsx, jsx and typed and self.generic, plain_generic)
        if key not in self._careful:
            try:
                self._careful[key] = careful_kinds(self.text, jsx, typed, plain_generic)
            except LexError as bad:
                self._careful[key] = bad
        return self._careful[key]

    def error(self, grammar: str) -> str | None:
        """What is wrong with the text in a grammar of GRAMMARS, or None if it parses; empty texts are valid."""
        if not self.text:
            return None
        typed, jsx = GRAMMARS[grammar]
        if self.kinds is not None and not (jsx and self.maybe_jsx):
            error = self._attempt(self.kinds, typed, jsx)
            if error is None or self.certain:
                return error
        error = None
        for plain_generic in (False, True) if typed and jsx and self.generic and GENERIC_PLAIN.search(self.text) else (False,):
            kinds = self._kinds(jsx, typed, plain_generic)
            error = str(kinds) if isinstance(kinds, LexError) else self._attempt(kinds, typed, jsx)
            if error is None:
                return None
        return error


def syntax_error(text: str | None, grammar: str) -> str | None:
    """What is wrong with a module's text in a grammar of GRAMMARS, or None if it parses; null and empty texts are valid."""
    return Source(text).error(grammar) if text else None
