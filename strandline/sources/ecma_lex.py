"""Lexer for JavaScript and TypeScript: a text becomes a string with one character per token.

The common case is one regular expression over the whole text and one dictionary lookup per token.
Texts it can't split for certain (JSX, templates with nested braces, a regular expression after a
closing bracket) go through a careful lexer that follows the brackets.
"""

from __future__ import annotations

import re

# Token kinds that stand for themselves: ( ) [ ] { } ; , : . = ? ! ~ < > * & | @ and
#   i identifier, h private name, n number, s string, r regular expression, t template, l this/null/true/false,
#   S super, u + or -, o other binary operator, A compound assignment, I ++ or --, a =>, Q ?., E ..., G > glued to a following > or =,
#   J start of a JSX element, j its end, \x01 an error; newlines are \n.
ERROR, END = "\x01", "\0"

#: fixed values: the reserved words of the language
RESERVED = """break case catch class const continue debugger default delete do else enum export extends finally for function if
import in instanceof new return switch throw try typeof var void while with""".split()
#: fixed values: words with a meaning in some places only
CONTEXTUAL = """as async await yield of get set static type interface namespace module declare abstract readonly from let keyof infer is
asserts unique satisfies override public private protected accessor global out using require""".split()

WORD = {word: chr(0x100 + n) for n, word in enumerate(RESERVED)} | {word: chr(0x200 + n) for n, word in enumerate(CONTEXTUAL)}
IDENT = frozenset(["i", *(WORD[w] for w in CONTEXTUAL)])
NAME = IDENT | frozenset([*(WORD[w] for w in RESERVED), "l", "S"])

_PUNCTUATION = {p: p for p in "( ) [ ] { } ; , : . = ? ! ~ < > * & | @".split()}
_PUNCTUATION |= {p: "o" for p in "% ** == === != !== <= << && || ?? ^ /".split()}
_PUNCTUATION |= {p: "A" for p in "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()}
_PUNCTUATION |= {">=": "G=", ">>": "G>", ">>>": "GG>", ">>=": "GG=", ">>>=": "GGG=", "+": "u", "-": "u", "++": "I", "--": "I", "=>": "a", "?.": "Q", "...": "E"}
_KINDS = _PUNCTUATION | WORD | {"this": "l", "null": "l", "true": "l", "false": "l", "super": "S", "\ufeff": ""}

_ESCAPE = r"\\(?:\r\n|[\s\S])"
_REGEX = rf"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*"
_COMMENT = r"//[^\r\n\u2028\u2029]*|/\*[\s\S]*?\*/"
_STRING = rf"\"(?:[^\"\\\r\n]|{_ESCAPE})*\"|'(?:[^'\\\r\n]|{_ESCAPE})*'"
#: comments and strings of which the end may be missing: they reach to the end of the text or line, so that no other beginning is tried in them
_OPEN = rf"//[^\r\n\u2028\u2029]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\r\n]|{_ESCAPE})*+\"?|'(?:[^'\\\r\n]|{_ESCAPE})*+'?"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
_WORD = r"(?:[\w$]++|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+"
#: most words, and marks that can't begin anything longer where they stand: both are tried first, since they are most of all tokens
_PLAIN_WORD = r"[A-Za-z_$][\w$]*+(?!\\)"
_PLAIN_MARK = r"[)\]@]|[;,({\[}:~](?!\s*+/)"
_OPERATOR = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
_TEMPLATE = rf"`(?:[^`\\$]|{_ESCAPE}|\$(?!\{{)|\$\{{[^`{{}}'\"/]*\}})*`"
#: an operator after which a slash must begin a regular expression, with that expression
_BEFORE_REGEX = r"[=(,:\[!&|?{};~]"
_FAST = re.compile(rf"[ \t]*+({_PLAIN_WORD}|[\r\n]\s*|{_PLAIN_MARK}|{_OPEN}|{_BEFORE_REGEX}\s*{_REGEX}|{_NUMBER}|{_WORD}|{_TEMPLATE}|#{_WORD}|[=.](?![=.>\d])|{_OPERATOR}|\S)")
_CLOSED = re.compile(_STRING)
_SUBSTITUTION = re.compile(r"\$\{([^}]*)\}")


class _Kinds(dict):
    """Kinds of token texts; those seen first are worked out and kept."""

    LIMIT = 400_000

    def __missing__(self, token: str) -> str:
        kind = self._kind(token)
        if len(self) > self.LIMIT:
            self.clear()
            self.update(_BASE)
        self[token] = kind
        return kind

    @staticmethod
    def _kind(token: str) -> str:
        first = token[0]
        if first in "\r\n":
            return "\n"
        if first in "\"'":
            return "s" if _CLOSED.fullmatch(token) else ERROR
        if token.startswith("//"):
            return ""
        if token.startswith("/*"):
            if len(token) < 4 or not token.endswith("*/"):
                return ERROR
            return "\n" if "\n" in token or "\r" in token else ""
        if first == "`":
            return ("t" + "".join(f"\x02{s}\x03" for s in _SUBSTITUTION.findall(token)) if "${" in token else "t") if len(token) > 1 else ERROR
        if len(token) > 2 and token[-1] != first and first in "=(,:[!&|?{};~" and "/" in token:
            rest = token[1:]
            return _KINDS[first] + ("\x08" if first == "}" else "") + ("\n" if "\n" in rest[: len(rest) - len(rest.lstrip())] else "") + "r"
        if first == "#":
            return "h" if len(token) > 1 and not token[1].isdigit() else ERROR
        if first.isdigit() or (first == "." and len(token) > 1):
            return "n" if re.fullmatch(_NUMBER, token) else ERROR
        if first == "_" or first == "$" or first.isidentifier() or first == "\\":
            return "i" if len(token) > 1 or first != "\\" else ERROR
        return ERROR


#: marks in the kinds of fast_tokens where a slash may divide as well as begin a regular expression: for / and /=, and before an expression after }
UNSURE = "\x06\x07\x08"
_BASE = _KINDS | {"/": "\x06", "/=": "\x07"}
_table = _Kinds(_BASE)


class LexError(ValueError):
    pass


def fast_tokens(text: str) -> list[str]:
    """The texts of a text's tokens in order, comments and line ends among them; any text has some."""
    return _FAST.findall("//" + text if text.startswith("#!") else text)


def kinds_of(tokens: list[str]) -> tuple[str | None, bool]:
    """The kinds of these tokens and whether they are certain; None where only the careful lexer can tell, as for templates with code in them."""
    kinds = "".join(map(_table.__getitem__, tokens))
    if "\x02" in kinds:
        kinds = _checked_templates(kinds)
    if kinds is None or ERROR in kinds:
        return None, False
    if any(mark in kinds for mark in UNSURE):
        return kinds.replace("\x06", "o").replace("\x07", "A").replace("\x08", ""), False
    return kinds, True


def fast_kinds(text: str) -> str | None:
    """kinds_of the text's tokens."""
    return kinds_of(fast_tokens(text))[0]


_template_ok: dict[str, bool] = {}


def _checked_templates(kinds: str) -> str | None:
    """Templates whose substitutions are plain member chains or calls without brackets inside stay; others need the careful lexer."""
    for inner in set(re.findall("\x02(.*?)\x03", kinds, re.S)):
        if not re.fullmatch(r"\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*|\s*\d+\s*", inner) or inner.strip() in WORD and inner.strip() in RESERVED:
            return None
    return re.sub("\x02.*?\x03", "", kinds, flags=re.S)


_CAREFUL = re.compile(rf"(?:(?P<plain>{_PLAIN_WORD})|(?P<nl>[\r\n\u2028\u2029])|(?P<ws>\s+|\ufeff)|(?P<com>{_COMMENT})|(?P<open>/\*)|(?P<str>{_STRING})|(?P<num>{_NUMBER})|(?P<word>#?{_WORD})|(?P<op>{_OPERATOR}|[(){{}}\[\];,:.=?!~<>*&|@%^/+-]))[ \t]*")
_REGEX_RE = re.compile(_REGEX)
_TEMPLATE_CHARS = re.compile(rf"(?:[^`\\$]|{_ESCAPE}|\$(?!\{{))*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:(?:\.|:)[A-Za-z_$][\w$-]*)*")
_JSX_SPACE = re.compile(rf"(?:\s|{_COMMENT})*")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
GENERIC_PLAIN = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*>\s*\(")
#: what a < may begin that only types have: parameters of an arrow function, or the arguments of a tag or call
GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|>\s*\()|<[\w$.:-]+\s*<")
#: kinds after which an operand has just ended
_OPERAND = frozenset("inrstlS)]}jh") | frozenset(WORD[w] for w in CONTEXTUAL)
_HEADS = frozenset(WORD[w] for w in ("if", "while", "for", "with"))
_OPERAND_WORDS = frozenset(WORD[w] for w in ("return", "typeof", "case", "do", "else", "in", "instanceof", "new", "void", "delete", "throw", "await", "yield", "of", "default", "extends"))


def careful_kinds(text: str, jsx: bool, typed: bool, plain_generic: bool = False) -> str:
    """The kinds of a text's tokens; raises LexError where no token can begin or something isn't closed."""
    out: list[str] = []
    stack: list[str] = []  # what each open bracket is: ( with the kind before it, { [ ` (template), J (JSX children), T (JSX tag)
    at, end, last, head_closed, block_closed = 0, len(text), "", False, False
    if text.startswith("#!"):
        at = re.search(r"[\r\n]|$", text).start()

    def jsx_tag(at: int) -> int:
        """From a < to the end of the opening or closing tag, or to the { of an attribute's value."""
        stack.append("")
        return jsx_attributes(jsx_head(at))

    def jsx_head(at: int) -> int:
        at = _JSX_SPACE.match(text, at + 1).end()
        name = _JSX_NAME.match(text, at)
        stack[-1] = "T" + (name.group() if name else "")
        at = name.end() if name else at
        if typed and text[at : at + 1] == "<":  # type arguments
            close = text.find(">", at)
            if close < 0:
                raise LexError("tag isn't closed")
            at = close + 1
        return at

    def jsx_attributes(at: int) -> int:
        while True:
            at = _JSX_SPACE.match(text, at).end()
            c = text[at : at + 1]
            if c == ">":
                stack[-1] = "J" + stack[-1][1:]
                return jsx_children(at + 1)
            if text.startswith("/>", at):
                return jsx_closed(at + 2)
            if len(stack[-1]) == 1:
                raise LexError("fragment with attributes")
            if c == "{":
                if not re.match(r"\{\s*\.\.\.", text[at : at + 60]):
                    raise LexError("attribute without name")
                out.append("{")
                stack.append("{T")
                return at + 1
            name = _JSX_NAME.match(text, at)
            if not name:
                raise LexError("unexpected character in a tag")
            at = _JSX_SPACE.match(text, name.end()).end()
            if text[at : at + 1] == "=":
                at = _JSX_SPACE.match(text, at + 1).end()
                c = text[at : at + 1]
                if c in "\"'" and c:
                    close = text.find(c, at + 1)
                    if close < 0:
                        raise LexError("attribute isn't closed")
                    at = close + 1
                elif c == "{":
                    out.append("{")
                    stack.append("{T")
                    return at + 1
                elif c == "<":
                    out.append("J")
                    return jsx_tag(at)
                else:
                    raise LexError("attribute without value")

    def jsx_children(at: int) -> int:
        while True:
            at = _JSX_TEXT.match(text, at).end()
            c = text[at : at + 1]
            if c == "{":
                out.append("{")
                stack.append("{J")
                return at + 1
            if c == "<":
                if re.match(r"<\s*/", text[at : at + 40]):
                    at = _JSX_SPACE.match(text, at + 1).end() + 1
                    at = _JSX_SPACE.match(text, at).end()
                    name = _JSX_NAME.match(text, at)
                    if "J" + (name.group() if name else "") != stack[-1]:
                        raise LexError("tags don't match")
                    at = _JSX_SPACE.match(text, name.end() if name else at).end()
                    if text[at : at + 1] != ">":
                        raise LexError("tag isn't closed")
                    return jsx_closed(at + 1)
                out.append("J")
                return jsx_tag(at)
            raise LexError("unexpected character between tags" if c else "element isn't closed")

    def jsx_closed(at: int) -> int:
        stack.pop()
        out.append("j")
        if stack and stack[-1][:1] == "J":
            return jsx_children(at)
        if stack and stack[-1][:1] == "T":
            return jsx_attributes(at)
        return at

    def template(at: int) -> int:
        at = _TEMPLATE_CHARS.match(text, at).end()
        if text.startswith("${", at):
            out.append("{")
            stack.append("`")
            return at + 2
        if text[at : at + 1] != "`":
            raise LexError("template isn't closed")
        out.append("\x05")
        return at + 1

    while at < end:
        c = text[at]
        last = out[-1] if out else ""
        if last == "\n":
            last = next((k for k in reversed(out) if k != "\n"), "")
        operand = False
        if c == "<" or c == "/":
            operand = last != "" and last[-1] in _OPERAND and last not in _OPERAND_WORDS or last == "\x05"
            if operand and (last == ")" and head_closed or last == "}" and block_closed):
                operand = False
        elif c == "`":
            out.append("\x04")
            at = template(at + 1)
            continue
        if c == "<" and jsx and not operand and re.match(r"<\s*(?:>|[A-Za-z_$])", text[at : at + 80]):
            if not (typed and (_GENERIC_ARROW.match(text, at) or plain_generic and GENERIC_PLAIN.match(text, at))):
                out.append("J")
                at = jsx_tag(at)
                continue
        if c == "/" and not operand and text[at + 1 : at + 2] not in ("/", "*"):
            m = _REGEX_RE.match(text, at)
            if not m:
                raise LexError("regular expression isn't closed")
            out.append("r")
            at = m.end()
            continue
        m = _CAREFUL.match(text, at)
        if not m:
            raise LexError(f"unexpected character {c!r}")
        at, what = m.end(), m.lastgroup
        token = m[what]
        if what == "ws":
            continue
        if what == "nl" or what == "com":
            if (what == "nl" or "\n" in token) and out[-1:] != ["\n"]:
                out.append("\n")
            continue
        if what == "open":
            raise LexError("comment isn't closed")
        if what == "str":
            out.append("s")
        elif what == "num":
            out.append("n")
        elif what == "plain" or what == "word":
            kind = _table[token]
            if kind == ERROR:
                raise LexError(f"unexpected {token!r}")
            out.append(kind if last not in (".", "Q") or kind not in _OPERAND_WORDS else "i")
        else:
            kind = _KINDS[token]
            if kind in "([{":
                stack.append(kind + last[-1:])
                out.append(kind)
            elif kind in ")]}":
                if not stack:
                    raise LexError(f"unexpected {token}")
                top = stack.pop()
                if top == "`":
                    if kind != "}":
                        raise LexError("template isn't closed")
                    out.append("}")
                    at = template(at)
                    continue
                if "([{".find(top[0]) != ")]}".find(kind):
                    raise LexError(f"unexpected {token}")
                out.append(kind)
                if top in ("{J", "{T") and len(top) == 2 and stack and stack[-1][:1] == top[1]:
                    at = jsx_children(at) if top[1] == "J" else jsx_attributes(at)
                    continue
                head_closed = kind == ")" and top[1:] in _HEADS
                block_closed = kind == "}" and top[1:] in (")", ";", "{", "}", "a", "", WORD["else"], WORD["try"], WORD["finally"], WORD["do"]) and "\n" in text[max(0, at - 400) : at]
            else:
                out.append(kind)
    if stack:
        raise LexError("something isn't closed")
    return "".join(out)
