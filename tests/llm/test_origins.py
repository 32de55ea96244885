"""File origins: signs in any place of a text, clusters by their shape, and copies as written."""

import random

from strandline.llm.file_evidence import masked_kinds, signs
from strandline.llm.handwritten import file_origins

FILES = "file_id long, repo string, path string, text string, ingested_at string"


def test_signs_in_long_comments_and_short_texts():
    def of(text, path="src/a.ts"):
        return signs(path, text, masked_kinds(text))

    code = "export function f(x: number) {\n  if (x) return g('//', x);\n  return 1;\n}\n"
    licence = " * Permission is granted to use, copy and change this text.\n" * 100
    assert of("/*\n" + licence + " * @generated\n */\n" + code)[0] == ["generated_text"]
    assert of(code + "/*\n * vendored from elsewhere\n" + licence + " */\n")[0] == ["vendored_text"]
    assert of(code + "// auto-generated\n" + "// more about it\n" * 200)[0] == ["generated_text"]
    assert of(code + "const s = '/* @generated';\n" + code + "/* end */\n")[0] == []
    assert of("// @generated in the middle\n".join([code, code]) + "// end\n")[0] == []
    assert of("var a=1,b=2;" + "".join(f"{x}=a+b-{y};" for x, y in zip("cdefghijklm", "nopqrstuvwx")))[0] == ["minified"]
    assert of("export const d = [" + ", ".join(map(str, range(40))) + "];\n") == (["data"], True)
    assert of("export const logo = '" + "Zm9v" * 40 + "';\n") == (["data"], True)
    assert of("".join(f"export const K{i} = {i};\n" for i in range(9)))[0] == ["serial"]
    for plain in ("'use strict';\n", "import './polyfills/for-old-browsers';\n", "export * from './components/settings';\n" * 6, "".join(f"export {{ a{i} }} from './a{i}';\n" for i in range(9)), "export const name = 'b';\n", "", code):
        assert of(plain) == ([], False)


def test_copies_without_signs_come_out(spark):
    def code(name, n=6):
        return "".join(f"export function {name}{i}(value: number): number {{\n  const other = value + {i};\n  if (other > 3) throw new Error('{name}');\n  return {name}Table[other];\n}}\n" for i in range(n))

    def changed(text):
        return text.replace("const other = value + 5;", "const other = value - 5;").replace("export", "/* taken */ export", 1)

    long = code("lib", 30)
    rows = [
        (1, "r", "src/a.ts", long),
        (2, "s", "src/b.ts", changed(long)),
        (3, "r", "src/c.ts", code("own")),  # masked the same as 4, by other names
        (4, "s", "src/d.ts", code("their")),
        (5, "r", "node_modules/x-y/e.ts", "import { z } from 'z';\n" + code("five", 9)),
        (6, "r", "src/f.ts", "import { z } from 'z';\n" + code("five", 9)),
        (7, "r", "src/g.ts", "class A {}\n" + code("twice", 12) + "new A();\n"),  # the same project's own
        (8, "r", "src/h.ts", "class A {}\n" + code("twice", 12) + "new A();\n"),
        (9, "r", "lib/i.ts", "type T = 1 | 2;\nlet x: T;\n" + code("built", 14).replace("if", "while")),
        (10, "r", "dist/i.ts", "type T = 1 | 2;\nlet x: T;\n" + code("built", 14).replace("if", "while")),
    ]
    frame = spark.createDataFrame([(*r, None) for r in rows], "file_id long, repo string, path string, text string, ingested_at string")
    got = {r.file_id: (r.handwritten, r.cluster_kind) for r in file_origins(frame).collect()}
    assert {i for i, (by_hand, _) in got.items() if not by_hand} == {1, 2, 5, 6, 10}
    assert got[1][1] == got[2][1] == got[6][1] == "copies"


def test_clusters_count_by_their_shape_alone(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(400)]

    def statement():
        a, b, c = rng.sample(names, 3)
        return rng.choice([f"if ({a}({b}.x, [{c}])) {{ return {a} + {b} * 2; }}", f"for (const {a} of {b}()) {{ {c}[{a}] = !{b}; }}", f"const {a} = {b} ? {c}.map((y) => y.z) : null;", f"{a}.{b}({c}, `t`, {{ {a}: 1, {b} }});", f"while ({a} < {b}.length) {{ {a} += {c}--; }}", f"try {{ {a}(); }} catch (e) {{ throw new {b}(e, {c}); }}"])

    def renamed(text):
        to = dict(zip(names, rng.sample([f"q{i}" for i in range(900)], 400)))
        return __import__("re").sub(r"\bn\d+\b", lambda m: to[m.group()], text)

    parts = ["n1", "(n2)", "[n3]", ".n4", "!n5", "? n6 : n7", "=> n8", "+ 1", "'s'", "{n9}", "return n1;", "&& n2", "...n3", "typeof n4"]
    body = "function n0() {\n" + "\n".join(" ".join(rng.choice(parts) for _ in range(12)) for _ in range(40)) + "\n}\n"
    rows = [(i, f"r{i % 3}", f"src/a{i}.ts", renamed(body)) for i in range(4)]  # one shape across repositories
    rows += [(10 + i, "r", f"src/b{i}.ts", "".join(f"call{j}(table.{rng.choice(names)});\n" for j in range(60 + i))) for i in range(3)]  # the same line over and over
    rows += [(20 + i, f"r{i}", f"src/c{i}.ts", renamed("export const n1 = (n2) => n3(n2, 1);\n")) for i in range(5)]  # short ones of one style
    rows += [(30 + i, f"r{i}", f"src/d{i}.ts", "export {};\n") for i in range(5)]
    rows += [(100 + i, "s", f"src/e{i}.ts", "function n0() {\n" + "\n".join(statement() for _ in range(8)) + "\n}\n") for i in range(200)]
    rows += [(500, None, None, None), (501, "r", None, ""), (501, "r", None, "")]
    frame = spark.createDataFrame([(*r, None) for r in rows], FILES)
    for use_signs in (True, False):
        got = {r.file_id: (r.found_by, r.cluster_kind) for r in file_origins(frame, use_signs=use_signs).where("not handwritten").collect()}
        assert got == {**{i: ("cluster", "copies") for i in range(4)}, **{10 + i: ("both" if use_signs else "cluster", "family") for i in range(3)}}
