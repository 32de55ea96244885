"""The syntax check, declarations, file scans and streaming."""

import json

import pytest

from strandline.sources import files
from strandline.sources.declarations import blanked, declarations
from strandline.sources.ecma import syntax_error

VALID = {
    "ts": [
        "", "﻿export default 1;", "let x: Array<Map<string, number[]>> = [];", "const f = <T,>(x: T): x is T => true;", "enum A { B = 1, 'C' }", "declare module 'x' { export const y: number; }",
        "type A<T> = T extends (infer U)[] ? U : never;", "type M = { readonly [K in keyof T]?: T[K] };", "abstract class A<T> extends B<T> implements C, D { constructor(private readonly x = 1) { super(); } abstract y(): void; static z?: string; get w() { return 1; } #p = 2; }",
        "const x = y as unknown as string; const z = a! + b!.c;", "function f(this: Window, a?: number, ...rest: string[]): asserts a is number {}", "export type { A } from './a'; import type B, { type C } from 'b'; export * as ns from 'q';",
        "const v = a < b && c > d; const w = f<string>(x); const s = a >> b >>> c >= d;", "const t = `a ${b ? `c ${d}` : \"}\"} e`;", "if (!/^[({]+\\w*[)}]?$/.test(x)) throw new Error('x');", "label: for (const a of b) { continue label; }",
        "let a = 1\nlet b = a\n++b", "for (const [k, v] of Object.entries(x)) { if (k in y) break; }", "const { a: { b = 1 }, ...c } = d; [a, b] = [b, a];", "type F = new (...a: any[]) => object; type G = typeof import('x'); let u: unique symbol;", "a ? (b) : c => d;", "x = async <T>(y: T) => { await y; };",
    ],
    "js": ["const a = <div className=\"x\" {...p}>don't {b ? <i/> : null} <></></div>;", "export const f = async function* () { yield* g(); };", "a ??= b?.c?.[0]?.(1) ?? /[/]\\/(?<n>x)/u;", "#!/usr/bin/env node\n'use strict';", "class A { static { this.x = 1; } async *[Symbol.iterator]() {} }"],
    "tsx": ["const a = <T,>(x: T) => <Row<T> key={x} onPick={() => f<T>(x)} />;", "export function A(): JSX.Element { return (<p>text 's {/* no */}</p>); }"],
}
INVALID = {
    "ts": ["const a = ;", "function f( {", "let x = 'abc", "class A { foo() { }", "if (a { }", "<<<<<<< HEAD\nlet a;\n=======\nlet b;\n>>>>>>> x", "const f = (a) =&gt; a;", "return 1;", "import os\n\ndef f(x):\n    return x\n", ".a { color: red; }", "const a = <div/>;", "export const a = 1 const b = 2;", "a + b = c;", "let x: = 3;", "f(a b);", "}", "const x;", "`a ${b"],
    "js": ["let x: string = 'a';", "interface A { b: string }", "const f = (a: number) => a;", "type A = string;", "enum A { B }", "x as string;"],
    "tsx": ["const a = <div><p></div>;", "const a = <string>b;"],
    "mjs": ["const a = <b/>;"],
}


@pytest.mark.parametrize("grammar,text", [(g, t) for g, texts in VALID.items() for t in texts])
def test_valid(grammar, text):
    assert syntax_error(text, grammar) is None


@pytest.mark.parametrize("grammar,text", [(g, t) for g, texts in INVALID.items() for t in texts])
def test_invalid(grammar, text):
    assert syntax_error(text, grammar) is not None


def test_every_cut_of_a_function_is_invalid():
    text = "export function f(a: number): string {\n  const b = g(a, { c: [1, 2] });\n  return `x ${b}`;\n}\n"
    assert syntax_error(text, "ts") is None
    assert all(syntax_error(text[:n], "ts") is not None for n in range(text.index("{") + 1, len(text) - 2))


def test_null_text_is_valid():
    assert syntax_error(None, "ts") is None


def test_declarations_have_exact_ends():
    text = "import a from 'b';\n/* } */ export function f(x: { a: string }) { return '}'; }\nclass A {\n  m(a) { return `{${a}`; }\n  p = 1;\n}\nexport type T = { a: 1 };\nconst g = (x) => { return x; };\ninterface I { a: string }\n"
    got = {(k, n): text[s:e] for k, n, s, e, _ in declarations(text)}
    assert got[("function", "f")].endswith("'}'; }") and got[("function", "m")] == "m(a) { return `{${a}`; }"
    assert got[("type", "T")] == "export type T = { a: 1 };" and got[("function", "g")].endswith("};") and got[("interface", "I")] == "interface I { a: string }"
    assert len(blanked(text)) == len(text)


def test_folder_scan_and_manifests(spark, tmp_path):
    for name, body in {"src/a.ts": "x", "src/b.d.ts": "y", "src/c.js": "z", "node_modules/p/d.ts": "q", "src/gen/e.ts": "w", "package.json": json.dumps({"name": "p", "dependencies": {"r": "1"}})}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = files.text_files(spark, [str(tmp_path)], ["ts", "js"], rules=["gen/"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.ts", "c.js"]
    assert [(r.name, r.declares) for r in files.package_manifests(spark, [str(tmp_path)]).collect()] == [("p", ["r"])]


def test_parse_cache_is_keyed_by_content_and_tool(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    todo, none = files.cached_parse(now, "path", "text", None, "v1")
    assert todo.count() == 2 and none is None
    cache = todo.where("path = 'a'").selectExpr("path", "digest", "'v1' tool", "7 facts")
    todo, good = files.cached_parse(now, "path", "text", cache, "v1")
    assert [r.path for r in todo.collect()] == ["b"] and good.count() == 1
    assert files.cached_parse(now, "path", "text", cache, "v2")[0].count() == 2


def test_type_facts_keep_the_longest_display(spark):
    rows = [("d", 1, "A", [2]), ("d", 1, "A<B>", [2, 9]), ("d", 2, "B", []), ("e", 2, "C", None)]
    got = files.type_facts(spark.createDataFrame(rows, "doc string, id int, display string, args array<int>"), "doc", "id", "display", "args")
    assert {(r.doc, r.id): (r.display, r.argument_displays) for r in got.collect()} == {("d", 1): ("A<B>", ["B"]), ("d", 2): ("B", []), ("e", 2): ("C", [])}


def test_stream_of_new_rows(spark, tmp_path):
    from strandline.streaming.incremental import on_new_rows

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string")
    rows.write.parquet(str(tmp_path / "in"))
    on_new_rows(spark, str(tmp_path / "in"), rows.schema, lambda d: d.groupBy("k").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.k, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("b", 1)]


def test_windowed_counts_leave_late_rows_out(spark, tmp_path):
    from strandline.streaming.incremental import windowed_counts

    schema = "ts timestamp, k string"
    stamps = ["2024-01-01 00:05", "2024-01-01 00:10", "2024-01-01 09:00"]
    spark.createDataFrame([(t, "a") for t in stamps], "t string, k string").selectExpr("cast(t as timestamp) ts", "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    counted = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["k"])

    def run():
        query = counted.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    # later than two hours before the latest seen: too late
    spark.createDataFrame([("2024-01-01 00:30", "a"), ("2024-01-01 20:00", "a")], "t string, k string").selectExpr("cast(t as timestamp) ts", "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(str(r.window_start), r.k): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("2024-01-01 00:00:00", "a")] == 2 and got.get(("2024-01-01 09:00:00", "a")) == 1 and len(got) == 2
