"""Top-level items where strings, comments, regular expressions, templates and line ends are easily taken for others.

Each case: the items in order, as (what it declares, text); the source is their texts with something in between.
"""

from __future__ import annotations

import pytest

from cairn.operators import code, lexing

J, R, G, V, T = ".js", ".rs", ".go", ".java", ".ts"
#: (extension, [(declared, text)], what stands between)
CASES = [
    # JavaScript: regular expressions and divisions
    (J, [("re", 'const re = /["{]/;'), ("a", "function a() { return 1 }"), ("b", "function b() {}")], "\n"),
    (J, [("x", "let x = a / b / c;"), ("y", "let y = (a) / 2 / '{'.length;"), ("f", "function f() {}")], "\n"),
    (J, [("s", "const s = t.split(/[/{]\\//g)"), ("g", "function g() { return /}/.test(`}`) }")], "\n"),
    (J, [("n", "const n = arr[0] / 2"), ("k", "const k = x++ / 3 // {"[:-5]), (None, "// {"), ("h", "function h() {}")], "\n"),
    # templates in templates
    (J, [("t", "const t = `a ${f({ x: `}${1}` })} {`;"), ("u", "function u() {}")], "\n"),
    (J, [("t", "const t = `\\`{ ${`${`{`}`} `"), ("u", "class u {}")], "\n"),
    # line ends
    (J, [("x", "let x = a\n .b()\n .c()"), ("y", "let y = 1")], "\n"),
    (J, [("x", "const x =\n  1 +\n  2"), ("y", "var y = a\n  ? b\n  : c"), (None, "f()")], "\n"),
    (J, [("x", "const x = [1]\n  [0]"), (None, "++i"), ("z", "let z = y\n  || w")], "\n"),
    (J, [("f", "const f = () => {\n  return 1\n}"), ("g", "const g = async x =>\n  x"), (None, "f(g)")], "\n\n"),
    (J, [(None, "import { a,\n b } from 'c'"), (None, "import d\n  from 'e'"), ("f", "function f() {}")], "\n"),
    (J, [("f", "function f() {}"), ("g", "function g() {}"), ("A", "class A extends B {\n  static { x = '}' }\n}")], " "),
    (J, [("f", "function f()\n{\n}"), ("A", "class A\n  extends B\n{ }"), (None, "if (x) { y }\nelse { z }")], "\n"),
    (J, [(None, "try { a() } catch (e) { } finally { }"), (None, "do { x } while (y)"), ("v", "var v")], "\n"),
    (J, [("export", "export { a, b as c };"), ("export", "export * from 'm'"), ("export", "export default () => {}"), ("k", "export default function k() {}")], "\n"),
    (J, [("export", "export default class extends B {}"), ("C", "export class C {}"), ("q", "export const q = { a: 1 }"), (None, "function* gen() { yield 1 }")], "\n"),
    (J, [("{ a, b }", "const { a, b } = c"), ("[d]", "let [d] = e"), ("o", "var o = {\n  m() { return '{' },\n}")], "\n"),
    (J, [(None, "'use strict'"), (None, "/* a { */"), ("f", "function /* no */ f(/* { */) { // }\n}"), (None, "// end")], "\n"),
    (J, [("$f", "function $f() {}"), ("_", "const _ = 1; "[:-1]), ("é", "const é = 2")], "\n"),
    (J, [("App", 'const App = () => (\n  <div a="{">\n    {x}\n  </div>\n)'), ("B", "class B { #p = 1 }")], "\n"),
    (J, [("async_", "async function async_() { await x }"), (None, "async () => {}"), ("e", "let e = a => b\n  => c")], "\n"),
    (J, [(None, "a.b = function () {\n  return {}\n}"), ("c", "const c = function () {}"), (None, "module.exports = { c }")], "\n"),
    # TypeScript
    (T, [("P", "interface P<T extends { a: 1 }> {\n  x: T\n}"), ("Q", "type Q =\n  | { a: 1 }\n  | { b: '}' }"), ("f", "function f(): { a: number } {\n  return { a: 1 }\n}")], "\n"),
    (T, [("E", "enum E { A }"), ("F", "const enum F { B }"), ("G", "export enum G {}"), (None, "abstract class H {}"), ("export", "export abstract class I {}")], "\n"),
    (T, [("C", "@Component({ selector: '}' })\nclass C {\n}"), ("D", "@A @b.c(1)\nexport class D {}"), ("E", "export @f class E {}"[:0] + "@f()\nclass E {}")], "\n\n"),
    (T, [(None, "declare module 'x' {\n  let y: number\n}"), (None, "namespace N { const a = 1 }"), (None, "declare function g(): void"), ("k", "const k = <T,>(x: T) => x")], "\n"),
    (T, [("f", "function f(a: string): void;"), ("f", "function f(a: any) {}"), ("x", "let x = y!"), (None, "var z = 1")], "\n"),
    (T, [("t", "export type t<A> = A extends (infer U)[] ? U : never"), ("export", "export type { X } from './x'"), (None, "type = 5")], "\n"),
    (T, [("x", "const x = y as\n  unknown as\n  Z"), ("w", "const w = {} satisfies\n  V"), ("i", "export default interface i {}")], "\n"),
    (T, [(None, "import type { A } from 'a'"), ("f", "export async function f<T>(\n  x: T,\n): Promise<{ a: T }> {\n}"), ("g", "export const g = (a: { b: 1 }): a is { b: 1 } => true")], "\n"),
    # Rust
    (R, [(None, "/* a /* b */ fn no() {} */"), ("yes", "fn yes() {}")], "\n"),
    (R, [(None, "#![allow(dead_code)]"), (None, "#[derive(Debug, Clone)]"), ("S", "pub struct S { a: char }"), (None, "#[cfg(test)]"), (None, "mod t { fn x() {} }")], "\n"),
    (R, [("f", "fn f<'a>(x: &'a str) -> char { '{' }"), ("g", "fn g() -> u8 { b'}' }"), ("h", "fn h() { '\\'' ; '\\u{7d}' }")], "\n"),
    (R, [("A", 'const A: &str = r#"fn x() { "quoted" }"#;'), ("B", 'static B: &[u8] = br"\\{";'), ("C", 'const C: &str = "a \\" {\n b";'), ("d", "fn d() {}")], "\n"),
    (R, [("P", "const P: S = S { a: 1 };"), ("Q", "static mut Q: [S; 1] = [S { a: 2 }];"), ("r", "const fn r() {}"), ("s", "pub(crate) async unsafe fn s() {}")], "\n"),
    (R, [("impl Display for S<T>", "impl<T: Into<U>> Display for S<T> where T: X {\n  fn f() {}\n}"), ("impl S", "impl S {}"), ("impl Send for S", "unsafe impl Send for S {}"), ("trait U", "pub unsafe trait U: V {}")], "\n"),
    (R, [(None, "use a::{b, c};"), (None, "extern crate x;"), (None, 'extern "C" { fn y(); }'), ("z", 'pub extern "C" fn z() {}'), (None, "macro_rules! m { (}) => {} }"[:18] + "() => {} }")], "\n"),
    (R, [("T", "type T<'a> = Box<dyn Fn(&'a u8) -> u8 + 'a>;"), ("E", "enum E { A { b: u8 }, C(u8) }"), ("N", "struct N(u8);"), ("Z", "struct Z;")], " "),
    (R, [(None, "// one"), (None, "/// doc {"), ("f", "fn f() { /* } /* } */ */ }"), (None, "/* open")], "\n"),
    # Go
    (G, [(None, "package p"), (None, 'import (\n\t"a" // {\n)'), ("S.M", "func (s *S) M() {}"), ("S[T].N", "func (s *S[T]) N() {}"), ("O", "func (s S[T]) O() {}"), ("S.P", "func (S) P() {}")], "\n"),
    (G, [("var", "var x = `{\n` + \"}\""), ("const", "const (\n\ta = iota // }\n\tb\n)"), ("f", "func f() { g('{', '\\'', '\\x7d') }")], "\n"),
    (G, [("T", "type T struct {\n\tA int `json:\"{\"`\n}"), ("type", "type U = T"), ("V", "type (\n\t// doc\n\tV int\n\tW int\n)"), ("G", "type G[K comparable] map[K]int")], "\n"),
    (G, [("f", "func f(\n\ta int,\n) (\n\tb int,\n) {\n}"), ("var", "var y = a +\n\tb"), ("var", "var z = func() int {\n\treturn 1\n}()")], "\n"),
    (G, [("var", "var a = b"), (None, "// trailing {"), ("g", "func g() {}"), (None, "/* last } */")], " \n"[:1] + "\n"),
    (G, [("f", "func f[T any](x T) {}"), ("h", "func h() {\n\tfor i := range `}` {\n\t}\n}"), (None, "//go:build x")], "\n\n"),
    # Java
    (V, [(None, "package p;"), (None, "import java.util.*;"), ("A", "@X(y = {1, 2}, z = @W(\")\"))\npublic final class A<T extends B> {\n  char c = '}';\n}")], "\n"),
    (V, [("A", 'class A { String s = """\n  } "q" {\n  """; }'), ("B", "interface B { default void f() {} }"), ("C", "enum C { X { } , Y; }"), (None, "record R(int a) {}")], "\n"),
    (V, [(None, "/** {@link X} */"), ("D", "abstract sealed class D permits E {}"), (None, "@interface F { int v() default 1; }"), ("G", "non-sealed class G { /* } */ }")], "\n"),
    (V, [("H", "class H {}"), ("I", "class I { int[] a = {1}; Runnable r = () -> { }; }"), (None, "// }"), ("J", "@Deprecated class J {}")], " \n"),
]


@pytest.mark.parametrize(("ext", "want", "between"), CASES)
def test_items(ext, want, between):
    assert [(n, t) for t, n in code.items(between.join(t for _, t in want), ext)] == want


@pytest.mark.parametrize("language", ["script", "rust", "go", "java"])
def test_any_source_is_taken_whole(language):
    """Broken sources too: tokens never overlap, and items hold every sign that is no blank."""
    import random

    r = random.Random(language)
    signs = ["`", "${", "}", "{", "(", ")", "/", "*", "//", "/*", "*/", '"', "'", "\\", "\n", "r#", "#", "x", "fn ", "function ", "class A ", ";", "=", "@", " ", "é", "'''", '"""']
    for _ in range(300):
        source = "".join(r.choice(signs) for _ in range(r.randrange(60)))
        at = 0
        for _, a, b in lexing.tokens(source, language):
            assert at <= a < b and not source[at:a].strip()
            at = b
        spans = lexing.items(source, language)
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        covered = "".join(source[a:b] for a, b in spans)
        if language != "go":  # its semicolons end statements and are not part of them
            assert "".join(covered.split()) == "".join(source.split())


def test_long_sources_take_linear_time():
    import time

    began = time.perf_counter()
    for language, text in (("script", "let a = `${" * 3000), ("rust", "/*" * 20000), ("script", "a / b\n" * 30000), ("java", "{" * 30000), ("script", "/[" * 3000)):
        lexing.items(text, language)
    assert time.perf_counter() - began < 20
