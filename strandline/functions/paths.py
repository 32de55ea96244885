"""Paths and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: fixed value: paths of tests
TEST_PATH = r"(?:^|/)(?:tests?|__tests__|specs?)(?:/|$)|\.(?:spec|test)\.[cm]?[jt]sx?$"
# Helpers that compilers put into files by themselves.
COMPILER_HELPERS = """__awaiter __generator __rest __spread __spreadArray __spreadArrays __values __read __readInt __assign __extends __decorate __metadata
__param __createBinding __setFunctionName __toPrimitive __toPropertyKey __importDefault __importStar __export __exportStar __classPrivateFieldGet
__classPrivateFieldSet __classPrivateFieldIn __addDisposableResource __disposeResources __esDecorate __runInitializers __propKey
_interopRequireDefault _interopRequireWildcard _classCallCheck _defineProperty _toConsumableArray _typeof _extends _objectSpread _objectSpread2
_slicedToArray _asyncToGenerator _createClass _getPrototypeOf _inherits""".split()


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_compiler_helper(name: Column) -> Column:
    return name.isin(COMPILER_HELPERS)


def display_name(identity: Column) -> Column:
    """path/to/file#name as file:name; what has no # stays."""
    return F.when(F.contains(identity, F.lit("#")), F.concat_ws(":", base_name(F.regexp_extract(identity, r"^(.*)#[^#]*$", 1)), F.substring_index(identity, "#", -1))).otherwise(identity)


def method_tail(identity: Column) -> Column:
    """The method at the end of a resolved call: file#this.lock is lock."""
    return F.substring_index(F.substring_index(identity, "#", -1), ".", -1)


def component_name(path: Column) -> Column:
    """The name a file's component would have: its base name without ending, each word with a capital."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    return F.array_join(F.transform(F.filter(F.split(stem, "[^A-Za-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), "")


def glob_regex(glob: str, literal_question: bool = False, slash_after_stars: bool = True) -> str:
    """A regular expression for a whole path: * within a segment, ** across segments.

    `literal_question` keeps ? as itself instead of one character; with `slash_after_stars` a `**/` also
    stands for nothing at all.
    """
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and slash_after_stars:
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?" and not literal_question:
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return f"^{''.join(out)}$"


def ignore_regex(rule: str) -> tuple[str, bool]:
    """(regular expression, negated) of one ignore rule: a slash inside anchors it, one at the end means a directory, ! brings back."""
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    directory = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    body = glob_regex(rule.lstrip("/"))[1:-1]
    return f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if directory else '(?:/.*)?'}$", negated


def directory(path: Column) -> Column:
    """All before the last slash, '' without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The ending with its dot, '' without one."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def module_of(path: Column, depth: int = 4) -> Column:
    """The first directory segments of a path, at most `depth`."""
    return F.array_join(F.slice(F.filter(F.split(directory(path), "/"), lambda s: s != ""), 1, depth), "/")


def package_of(specifier: Column) -> Column:
    """The package an import names: its first segment, with the second one if it has a scope; null for relative ones."""
    scoped = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)
    return F.when(specifier.rlike(r"^\.{0,2}/|^\.{1,2}$"), F.lit(None)).when(scoped != "", scoped).otherwise(F.substring_index(specifier, "/", 1))


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last, beginning with ''."""
    parts = F.split(directory(path), "/")
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
