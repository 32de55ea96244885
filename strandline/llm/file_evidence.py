"""Signs that a source file wasn't written by hand: its path, its banner, and the shape of its tokens."""

from __future__ import annotations

import re

from strandline.sources.ecma_lex import WORD, fast_kinds

# Folders of packages taken over, of build results and of generators, and names tools give to their files.
VENDORED_PATH = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|third[_-]party)/"
    r"|(?:^|/)(?:vendor|vendors|vendored)/[\w.@-]+-\d+\.\d+[\w.-]*/"
    r"|(?:^|/)(?:external|extern|deps|vendor|vendors)/[a-z]+-[a-z-]+/(?!.*/(?:external|extern)/)"
)
BUILT_PATH = re.compile(r"^(?:dist|build|out|public|coverage)/|(?:^|/)static/js/|(?:^|/)(?:dist|_next|\.next|\.nuxt)/|[.-]min\.[cm]?jsx?$|[.-](?:bundle|chunk)\.[cm]?js$")
GENERATED_PATH = re.compile(r"(?:^|/)(?:__generated__|generated|\.generated|codegen/out|gen/out)/|[._-](?:gen|generated|pb|pb2|grpc|g)\.[cm]?[jt]sx?$|\.(?:designer)\.[jt]s$", re.I)

# What tools and people write at the top or the end of such files, in several languages.
GENERATED_TEXT = re.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically)?[- ]?generated\b|\bautomatically (?:produced|created|written|built)\b|\bautogenerated\b"
    r"|\b(?:code|file|this (?:file|module|code)(?: is| was| has been)?) generated (?:by|from|with|automatically)\b|\bgenerated (?:by|from|with|using)\b[^\n]{0,80}"
    r"(?:do not (?:edit|modify|change|touch)|overwritten|\.proto|\.idl|\.graphql|schema|swagger|openapi|template|compiler|generator|protoc)"
    r"|\bend of generated\b|\bbegin(?:ning)? of generated\b|\bmanual (?:edits|changes) will be (?:overwritten|lost)\b|\bchanges (?:made )?here (?:are|will be) (?:lost|overwritten)\b"
    r"|\b(?:erzeugt|generiert)\b[^\n]{0,60}\b(?:nicht von hand|schema|bitte nicht)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b"
    r"|\b(?:archivo|fichero|código|codigo) generado\b|\bgenerado (?:automáticamente|automaticamente|a partir)\b|\bno (?:editar|modificar)\b[^\n]{0,20}\ba mano\b"
    r"|\bfichier généré\b|\bgénéré automatiquement\b",
    re.I,
)
VENDORED_TEXT = re.compile(
    r"\bvendored (?:copy|from|in)\b|\btaken over (?:unchanged|verbatim)?\s*from (?:the )?upstream\b|\btaken over unchanged\b|\breport bugs upstream\b"
    r"|^\s*\*?\s*upstream:\s*https?://|@license\s+[\w@/-]+\s+v?\d+\.\d+|/\*!\s*[\w@/.-]+\s+v?\d+\.\d+(?:\.\d+)?\b|\bcopied (?:verbatim )?from [\w@/-]+@\d|\bübernommen aus [\w@/-]+@?\d|\bcopiado de [\w@/-]+@?\d"
    r"|^\s*(?:/?\*+!?|//)\s*[a-z][\w]*-[\w-]+ - release \d",
    re.I | re.M,
)
COMPILED_TEXT = re.compile(r"Object\.defineProperty\(exports,\s*[\"']__esModule[\"']|=== void 0 \|\| _\w+ === void 0|\b__webpack_require__\b|\b__(?:awaiter|generator|extends|importDefault|createBinding)\b|^//[#@]\s*sourceMappingURL=", re.M)
WRAPPER_TEXT = re.compile(r"typeof define === ?[\"']function[\"'] ?&& ?define\.amd|typeof exports === ?[\"']object[\"'] ?&& ?typeof module !==? ?[\"']undefined[\"']")

#: one of these stands in whatever COMPILED_TEXT matches; looking for them first is cheap
_COMPILED_PARTS = ("__", "void 0", "sourceMappingURL=")
_BANNER = re.compile(r"\s*(?:(?://[^\r\n]*|/\*[\s\S]*?\*/|['\"]use strict['\"];?)\s*)*")
_LAST_COMMENT = re.compile(r"(?://[^\r\n]*|/\*(?:(?!\*/)[\s\S])*\*/)\s*$")
_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[\w$]+|[^\s\w]")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<![\w$])-?(?:0[xX][\da-fA-F]+|\d[\d_.]*)(?![\w$])")
_COMMENTS = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|//[^\n]*|/\*[\s\S]*?\*/")
_PIECE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?P<comment>//[^\r\n]*|/\*[\s\S]*?\*/)")
_PASSED_ON = re.compile(r"^[ \t]*(?:import\b(?:[^;'\"=()]*?\bfrom)?|export\b[^;'\"=()]*?\bfrom)\s*(?:\"[^\"\n]*\"|'[^'\n]*')[ \t]*;?|^[ \t]*['\"]use [a-z ]+['\"][ \t]*;?", re.M)
_DOCUMENT = re.compile(r"\s*\{\s*(?:\"|\}\s*$)")
_WORDS = re.compile(r"(?<![\w$.\"'])[A-Za-z_$][\w$]*")
_WORKING = frozenset(WORD[w] for w in ("function", "if", "for", "while", "switch", "return", "class", "interface", "type", "try", "throw", "do")) | {"a"}
KEYWORDS = frozenset(WORD)
#: A text of fewer characters is data only if it has many literals, or hardly anything else; a JSON object has a wrong ending then.
SHORT = 300
MANY_LITERALS = 12
NOTHING_ELSE = 0.8


def masked_kinds(text: str) -> str:
    """The text's tokens with names, strings and numbers masked, newlines kept; for any text, whether it parses or not."""
    kinds = fast_kinds(text)
    if kinds is not None:
        return kinds
    out = []
    for line in text.split("\n"):
        for token in _TOKEN.findall(line):
            first = token[0]
            if token.startswith(("//", "/*")):
                continue
            out.append(WORD.get(token) or ("s" if first in "\"'`" else "n" if first.isdigit() else "i" if first.isalnum() or first in "_$" else first))
        out.append("\n")
    return "".join(out)


def code_tokens(text: str) -> list[str]:
    """The text's tokens as written, without comments."""
    return [t for t in _TOKEN.findall(text) if not t.startswith(("//", "/*"))]


def signs(path: str | None, text: str | None, kinds: str) -> tuple[list[str], bool]:
    """The signs a file bears by itself, and whether all it consists of is literals. Null and empty texts bear none."""
    path, text = (path or "").replace("\\", "/"), text or ""
    found: list[str] = []
    for name, pattern in (("vendored_path", VENDORED_PATH), ("built_path", BUILT_PATH), ("generated_path", GENERATED_PATH)):
        if pattern.search(path):
            found.append(name)
    edges = _BANNER.match(text.lstrip("﻿")).group() + "\n" + _closing(text)
    if GENERATED_TEXT.search(edges):
        found.append("generated_text")
    if VENDORED_TEXT.search(edges):
        found.append("vendored_text")
    if any(part in text for part in _COMPILED_PARTS) and COMPILED_TEXT.search(text):
        found.append("compiled")
    if WRAPPER_TEXT.search(text):
        found.append("wrapper")
    literal = False
    lines = text.count("\n") + 1
    works = sum(map(kinds.count, _WORKING))
    long_lines, no_work = len(text) / lines > 80, works == 0
    serial = _serial(kinds)
    if not (long_lines or no_work or serial):
        return found, literal
    code = _COMMENTS.sub(r"\1", text) if "/" in text else text
    solid = len("".join(code.split()))
    short = solid < SHORT
    if short:  # what a short text imports or passes on would outweigh the rest
        code = _PASSED_ON.sub("", code)
        solid = len("".join(code.split()))
        serial = serial and _serial(masked_kinds(code))
    if not solid:
        return found, literal
    if long_lines or no_work:
        bare, literals = _LITERAL.subn("", code)
        bare_solid = len("".join(bare.split()))
        if long_lines:
            names = [w for w in _WORDS.findall(bare) if w not in KEYWORDS]
            brief = sum(len(w) <= 2 for w in names) / max(1, len(names))
            spaces = (len(bare) - bare_solid) / max(1, len(bare))
            if len(names) >= 30 and brief >= 0.4 and spaces < 0.12:
                found.append("minified")
        share = (solid - bare_solid) / solid
        literal = no_work and share >= 0.45 and (not short or (literals >= MANY_LITERALS or share >= NOTHING_ELSE) and not _DOCUMENT.match(code))
        if literal:
            found.append("data")
    if serial and _at_depth_zero(code):
        found.append("serial")
    return found, literal


def _closing(text: str) -> str:
    """All comments that end a text, from the first that nothing but comments follows."""
    rest = text.rstrip()
    if not rest.endswith("*/") and "//" not in re.split(r"[\r\n]", rest[rest.rfind("\n") + 1 :])[-1]:
        return ""
    begin = end = 0
    for m in _PIECE.finditer(rest):
        if m.group("comment"):
            if rest[end : m.start()].strip():
                begin = m.start()
            end = m.end()
    if end == len(rest):
        return rest[begin:]
    last = _LAST_COMMENT.search(rest)  # a quote in a regular expression can hide it from the pieces
    return last.group() if last else ""


TOP = frozenset(WORD[w] for w in ("export", "const", "var", "let"))


def _serial(kinds: str) -> bool:
    """Whether nearly all lines are declarations of one or two shapes."""
    lines = [x for x in kinds.split("\n") if x]
    if len(lines) < 8:
        return False
    counts: dict[str, int] = {}
    for x in lines:
        if x[-1] == ";" and (x[0] in TOP or x[0] == "i"):
            counts[x] = counts.get(x, 0) + 1
    most = sorted(counts.values(), reverse=True)[:2]
    return bool(most) and most[0] >= 6 and sum(most) / len(lines) >= 0.75


def _at_depth_zero(code: str) -> bool:
    """Whether most lines begin without indentation."""
    lines = [x for x in code.split("\n") if x.strip()]
    return sum(not x[0].isspace() for x in lines) / len(lines) >= 0.75
