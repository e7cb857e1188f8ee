"""Declarations of every language with brackets or `end`, nested and in unusual forms, and the calls in them.

A symbol is given by its name, kind, and the first and last characters of its text, checked by reading; a call by caller, name and receiver.
"""

import pytest

from quarrylens.extract.facts import calls_of, imports_of, symbols_of

CASES = [
    (
        "cpp",
        r"""struct Box { Box() : v_(0), w_(make(1)) { init(); } ~Box() { drop(); } int v_; Box& operator+(const Box& o) { add(o); return *this; } bool operator()(int x) const { return x; } };
int h(int (*cb)(int)) { return cb(3); }
template <typename T> class Q { template <class U> auto map(U f) const -> Q<U> { return f(x_); } std::vector<std::function<int(int)>> g() override { return std::make_pair<int, T>(1, 2); } };
template <> struct std::hash<Box> { size_t operator()(const Box& b) const noexcept { return b.key(); } };
namespace a::b { static inline void free_one(int n) noexcept(true) try { if (n) { go_on(n); } auto l = [n](int q) { return inner(q); }; Foo x(3); Foo y{3}; new Foo(a()); for (auto& z : items()) { z->run(); } } catch (...) { oops(); } }
enum class E : int { A, B = f(2) };
typedef int (*fn_t)(int); typedef unsigned char byte_t; using X = int;
extern "C" { int cc(void) { return ns::q(1); } }
#define M(x) do { x(); } while (0)
int
main(int argc, char **argv)
{
#ifdef A
  if (a()) {
#else
  if (b()) {
#endif
    c();
  }
  int arr[] = { one(), two() };
  return static_cast<int>(sizeof(x)) + d.e<int>(4);
}
int after() { return 1; }
""",
        [
            ('Box', 'class', 'struct Box { B', 'eturn x; } }'), ('Box', 'method', 'Box() : v_(0),', ' { init(); }'), ('operator+', 'method', 'Box& operator+', 'urn *this; }'),
            ('operator()', 'method', 'bool operator(', ' return x; }'), ('h', 'function', 'int h(int (*cb', 'urn cb(3); }'), ('Q', 'class', 'class Q { temp', '>(1, 2); } }'),
            ('map', 'method', 'auto map(U f) ', 'urn f(x_); }'), ('g', 'method', 'std::vector<st', ' T>(1, 2); }'), ('operator()', 'method', 'size_t operato', 'n b.key(); }'),
            ('free_one', 'function', 'static inline ', '->run(); } }'), ('E', 'type', 'enum class E :', ', B = f(2) }'), ('byte_t', 'type', 'typedef unsign', 'char byte_t;'),
            ('cc', 'function', 'int cc(void) {', ' ns::q(1); }'), ('main', 'function', 'int\nmain(int a', 'e<int>(4);\n}'), ('after', 'function', 'int after() { ', ' return 1; }'),
        ],
        [
            ('Box', 'make', False), ('Box', 'init', False), ('operator+', 'add', False), ('h', 'cb', False), ('map', 'f', False), ('g', 'make_pair', False), ('operator()', 'key', True),
            ('free_one', 'go_on', False), ('free_one', 'inner', False), ('free_one', 'a', False), ('free_one', 'items', False), ('free_one', 'run', True), ('cc', 'q', False),
            ('main', 'a', False), ('main', 'b', False), ('main', 'c', False), ('main', 'one', False), ('main', 'two', False), ('main', 'e', True),
        ],
    ),
    (
        "rust",
        r"""use a::b;
#[derive(Debug, Clone)]
pub(crate) struct A<T>(T) where T: Fn(u8) -> u8;
pub(crate) async fn f<'a, T: Into<Vec<u8>>>(x: &'a T) -> impl Iterator<Item = u8> where T: Fn(u8) -> u8 {
    let Some(y) = g(x) else { return none(); };
    match y { Some(z) if ok(z) => b::<Vec<Vec<u8>>>(z), Foo::Bar(q) => { h(q); } _ => std::iter::once(1).collect::<Vec<_>>() }
    println!("{}", hidden(1));
    for Wrap(p) in all() { p.go(); }
    let c = |Some(k)| run(k);
    let s = S { a: mk(1), b };
    if let Some(v) = x.find() && check(v) {}
    unsafe { raw(); }
}
impl<T> Tr for A<T> { type X = u8; const N: usize = 3; fn m(&self) -> Self { Self(1); A(2); self.n() } fn r#type(&self) {} }
trait Tr { type X; fn m(&self); fn d(&self) { self.m() } }
extern "C" { fn ext(x: u8); }
#[no_mangle]
// c
pub extern "C" fn out() {}
mod t { mod u; pub enum E { A(u8), B { x: u8 } } union N { a: u8 } fn inner() { fn nested() {} } }
macro_rules! mm { ($x:expr) => { fn fake() { call() } }; }
""",
        [
            ('A', 'class', 'pub(crate) str', 'n(u8) -> u8;'), ('f', 'function', 'pub(crate) asy', '{ raw(); }\n}'), ('X', 'class', 'type X = u8;', 'type X = u8;'),
            ('m', 'method', 'fn m(&self) ->', '; self.n() }'), ('type', 'method', 'fn r#type(&sel', 'pe(&self) {}'), ('Tr', 'interface', 'trait Tr { typ', 'self.m() } }'),
            ('d', 'method', 'fn d(&self) { ', '{ self.m() }'), ('out', 'function', 'pub extern "C"', ' fn out() {}'), ('t', 'module', 'mod t { mod u;', 'ted() {} } }'),
            ('u', 'module', 'mod u;', 'mod u;'), ('E', 'class', 'pub enum E { A', ' { x: u8 } }'), ('N', 'class', 'union N { a: u', ' N { a: u8 }'), ('inner', 'method', 'fn inner() { f', 'ested() {} }'),
            ('nested', 'function', 'fn nested() {}', ' nested() {}'), ('mm', 'macro', 'macro_rules! m', 'all() } }; }'),
        ],
        [
            ('f', 'g', False), ('f', 'none', False), ('f', 'ok', False), ('f', 'b', False), ('f', 'h', False), ('f', 'once', False), ('f', 'collect', True), ('f', 'println', False),
            ('f', 'all', False), ('f', 'go', True), ('f', 'run', False), ('f', 'mk', False), ('f', 'find', True), ('f', 'check', False), ('f', 'raw', False), ('m', 'Self', False),
            ('m', 'A', False), ('m', 'n', True), ('d', 'm', True),
        ],
    ),
    (
        "go",
        r"""package p
type ( A struct { x int; f func(int) error }
 B interface { M(x int) string }
 C = int
 D[T any] []T
)
type F func(a int) string
func H[T any](x T) (r map[string]interface{}, err error) { if valid(x) { return nil, fmt.Errorf("x") }
 b := []byte(s); m := make(map[string]int); z := map[string]int(m); H[int](3); go run(); defer func() { c() }()
 for i := range list() { switch kind(i) { case one(): two() } }
 var _ = struct{ a int }{first()}
 x.(T).do()
 return
}
func (s *S[K]) Do(f func(int) int) func() { return func() { s.inner(f(1)) } }
func asm(x int) int
func last() {}
""",
        [
            ('A', 'type', 'A struct { x i', 'int) error }'), ('B', 'type', 'B interface { ', 'nt) string }'), ('D', 'type', 'D[T any] []T', 'D[T any] []T'),
            ('F', 'type', 'F func(a int) ', ' int) string'), ('H', 'function', 'func H[T any](', '()\n return\n}'), ('Do', 'method', 'func (s *S[K])', 'er(f(1)) } }'),
            ('asm', 'function', 'func asm(x int', 'm(x int) int'), ('last', 'function', 'func last() {}', 'nc last() {}'),
        ],
        [
            ('H', 'valid', False), ('H', 'Errorf', True), ('H', 'make', False), ('H', 'H', False), ('H', 'run', False), ('H', 'c', False), ('H', 'list', False), ('H', 'kind', False),
            ('H', 'one', False), ('H', 'two', False), ('H', 'first', False), ('H', 'do', True), ('Do', 'inner', True), ('Do', 'f', False),
        ],
    ),
    (
        "javascript",
        r"""const o = { m() { a(); }, async *gen(x) { b(x); }, get v() { return 1 }, 'str'() {}, arrow: async (x) => c(x), fn: function () { d() }, [e()]: 1, plain: f(2) };
class K extends mix(A, B) { #p = 1; static s = () => g(); constructor(x) { super(x); this.y = h(x); } static async m({ a, b } = {}) { return `q ${i(`z ${j()}`)}`; } #priv() { k(); } get x() { return this.l() } }
export default function main() { if (x) { n() } html`<b>${o1()}</b>`; a?.b?.(p()); new Q(r()); new w.X(s()); return /a(b)/.test(t()) }
var u = function named() { v() }, w = 3, y = z => z.q()
exports.a.b = async function () { c1() }
module.exports = { d1, e1() { f1() } };
const App = () => <div onClick={() => g1()}>Total (sum) it's {h1(1)}</div>
function* gen2() { yield i1() }
label: { j1() }
function k1() { return l1
  (3) }
""",
        [
            ('m', 'method', 'm() { a(); }', 'm() { a(); }'), ('gen', 'method', 'async *gen(x) ', 'x) { b(x); }'), ('v', 'method', 'get v() { retu', '{ return 1 }'),
            ('arrow', 'function', 'arrow: async (', ' (x) => c(x)'), ('fn', 'function', 'fn: function (', 'n () { d() }'), ('K', 'class', 'class K extend', 'this.l() } }'),
            ('m', 'method', 'static async m', '{j()}`)}`; }'), ('x', 'method', 'get x() { retu', 'n this.l() }'), ('main', 'function', 'function main(', '.test(t()) }'),
            ('u', 'function', 'u = function n', 'ed() { v() }'), ('named', 'function', 'function named', 'ed() { v() }'), ('y', 'function', 'y = z => z.q()', '= z => z.q()'),
            ('b', 'function', 'exports.a.b = ', ' () { c1() }'), ('e1', 'method', 'e1() { f1() }', '1() { f1() }'), ('App', 'function', 'App = () => <d', 'h1(1)}</div>'),
            ('gen2', 'function', 'function* gen2', 'yield i1() }'), ('k1', 'function', 'function k1() ', 'n l1\n  (3) }'),
        ],
        [
            ('m', 'a', False), ('gen', 'b', False), ('arrow', 'c', False), ('fn', 'd', False), ('m', 'i', False), ('m', 'j', False), ('x', 'l', True), ('main', 'n', False),
            ('main', 'html', False), ('main', 'o1', False), ('main', 'b', True), ('main', 'p', False), ('main', 'r', False), ('main', 's', False), ('main', 'test', True),
            ('main', 't', False), ('named', 'v', False), ('y', 'q', True), ('b', 'c1', False), ('e1', 'f1', False), ('App', 'g1', False), ('App', 'h1', False), ('gen2', 'i1', False),
            ('k1', 'l1', False),
        ],
    ),
    (
        "tsx",
        r"""export abstract class A<T extends B<C>> implements I { private readonly x: Map<string, Array<number>> = new Map(); constructor(private a: string) { super() } abstract f(x: number): string; get g(): { a: number } { return { a: h<X>(1) }; } private async i<U>(this: A<T>, cb: (x: U) => void): Promise<U[]> { await this.j<U>(cb); return [] } field = (x: number): void => { k(x) } over(a: string): void; over(a: any) { l(a) } @dec() m?(): void }
export interface I { f(x: number): string; g?: (x: number) => void }
declare function q(a: string): void;
export type T = { m(): void; n: () => string } | null
namespace N.M { export const r = <T,>(x: T): x is string => { s(x) } }
declare module "x" { function t(): void }
export const enum E { A = 1 }
const u = useCallback(async (e: Event): Promise<void> => { v(e) }, [w]);
export const Comp: React.FC<{ a: string }> = ({ a }) => { return (<T a={x => y(x)}><><B.C/>don't {z()}</></T>); };
function g1(this: X): asserts x is string { return h1() as unknown as Y<Z> }
let z1: (a: number) => string = (a) => i1(a), z2 = j1();
""",
        [
            ('A', 'class', 'abstract class', 'm?(): void }'), ('constructor', 'method', 'constructor(pr', ' { super() }'), ('f', 'method', 'abstract f(x: ', 'ber): string'),
            ('g', 'method', 'get g(): { a: ', 'h<X>(1) }; }'), ('i', 'method', 'private async ', ' return [] }'), ('over', 'method', 'over(a: string', 'tring): void'),
            ('over', 'method', 'over(a: any) {', 'ny) { l(a) }'), ('m', 'method', 'm?(): void', 'm?(): void'), ('I', 'interface', 'interface I { ', 'r) => void }'),
            ('f', 'method', 'f(x: number): ', 'ber): string'), ('q', 'function', 'declare functi', 'ring): void;'), ('T', 'type', 'type T = { m()', 'ing } | null'),
            ('m', 'method', 'm(): void', 'm(): void'), ('r', 'function', 'r = <T,>(x: T)', ' => { s(x) }'), ('t', 'function', 'function t(): ', 'on t(): void'),
            ('E', 'enum', 'const enum E {', ' E { A = 1 }'), ('Comp', 'function', 'Comp: React.FC', '}</></T>); }'), ('g1', 'function', 'function g1(th', 'wn as Y<Z> }'),
            ('z1', 'function', 'z1: (a: number', '(a) => i1(a)'),
        ],
        [
            ('g', 'h', False), ('i', 'j', True), ('over', 'l', False), ('r', 's', False), ('Comp', 'y', False), ('Comp', 'z', False), ('g1', 'h1', False), ('z1', 'i1', False),
        ],
    ),
    (
        "java",
        r"""package a;
@Ann(x = {"a"})
public abstract class A<T extends B<T>> extends C implements D, E {
  static final Map<String, List<Integer>> M = new HashMap<>() {{ put("a", f()); }};
  public A(int x) { this(x, g()); super.h(); }
  @Override
  protected <U extends T> Map<U, int[]> m(final List<? super U> l, int... r) throws X, Y { return l.stream().map(this::n).collect(Collectors.<U>toList()); }
  abstract int[] o();
  native void p();
  Runnable q = () -> { r1(); };
  Runnable w = new a.b.Thing(s()) { @Override public void run() { t(); } };
  enum K { X(1) { int v() { return u1(); } }, Y; K(int i) {} int z() { return new Foo<A>(x()).y(); } }
  interface I { default void d() { e1(); } int f2(); }
  record P(int a, int b) { P { check(a); } static P of() { return new P(1, 2); } }
  @interface An { String value() default "x"; }
  int last() { if (cond(1)) { return switch (k()) { case 1 -> l1(); default -> { yield l2(); } }; } do { w1(); } while (w2()); assert a1() : a2(); return (int) c1(); }
}
""",
        [
            ('A', 'class', '@Ann(x = {"a"}', 't) c1(); }\n}'), ('m', 'method', '@Override\n  pr', 'toList()); }'), ('o', 'method', 'abstract int[]', 't int[] o();'),
            ('p', 'method', 'native void p(', 've void p();'), ('run', 'method', '@Override publ', 'n() { t(); }'), ('z', 'method', 'int z() { retu', '(x()).y(); }'),
            ('I', 'interface', 'interface I { ', ' int f2(); }'), ('d', 'method', 'default void d', '() { e1(); }'), ('f2', 'method', 'int f2();', 'int f2();'),
            ('of', 'method', 'static P of() ', 'w P(1, 2); }'), ('last', 'method', 'int last() { i', 'int) c1(); }'),
        ],
        [
            ('m', 'stream', True), ('m', 'map', True), ('m', 'collect', True), ('m', 'toList', True), ('run', 't', False), ('z', 'x', False), ('z', 'y', True), ('d', 'e1', False),
            ('last', 'cond', False), ('last', 'k', False), ('last', 'l1', False), ('last', 'l2', False), ('last', 'w1', False), ('last', 'w2', False), ('last', 'a1', False),
            ('last', 'a2', False), ('last', 'c1', False),
        ],
    ),
    (
        "csharp",
        r"""namespace N { using X;
[Attr(1)] public sealed partial class A<T> : B, C where T : class {
  public int P { get; private set; } = F(1);
  public string Q => $"a {G("}")}";
  public A(int x) : base(x) { }
  [Obsolete("a")] public async Task<T?> M<U>(U u, int x = 1) where U : new() { void Local() { } return await H(u); }
  protected abstract void Ab(int x);
  public static A<T> operator +(A<T> a, A<T> b) => a;
  int IFoo.Ex() => 3;
  delegate void Del(int x);
  private readonly Dictionary<string, int> d = new Dictionary<string, int>();
  record struct R(int X); record S(string Y) { public void Z() {} }
  struct T2 { int[] W() { return null; } }
  interface I { void V(); T Get<T>(); }
  enum En { A, B }
} }
namespace D.E; class Z { (int, string) Tup() { return (1, "a"); } ref int Rr() { } }
""",
        [
            ('N', 'module', 'namespace N { ', '{ A, B }\n} }'), ('A', 'class', '[Attr(1)] publ', 'n { A, B }\n}'), ('M', 'method', '[Obsolete("a")', 'wait H(u); }'),
            ('Ab', 'method', 'protected abst', 'd Ab(int x);'), ('Ex', 'method', 'int IFoo.Ex() ', 'o.Ex() => 3;'), ('S', 'class', 'record S(strin', 'oid Z() {} }'),
            ('Z', 'method', 'public void Z(', ' void Z() {}'), ('T2', 'class', 'struct T2 { in', 'rn null; } }'), ('W', 'method', 'int[] W() { re', 'turn null; }'),
            ('I', 'interface', 'interface I { ', ' Get<T>(); }'), ('V', 'method', 'void V();', 'void V();'), ('Get', 'method', 'T Get<T>();', 'T Get<T>();'),
            ('Z', 'class', 'class Z { (int', 't Rr() { } }'), ('Tup', 'method', '(int, string) ', ' (1, "a"); }'), ('Rr', 'method', 'ref int Rr() {', 'int Rr() { }'),
        ],
        [],
    ),
    (
        "php",
        r"""<?php
namespace App\Http;
use X\Y;
#[Attr]
final class A extends B implements C { use T; const X = 1; public function __construct(private int $a) { $f = function ($x) { return $x; }; } abstract protected function ab(): ?string; public static function &s(int ...$x): static { return new class(1) extends Q { function anon() {} }; } }
interface I { public function m(string $x = "}"); }
trait T { function t() { return A::class; } }
enum E: string { case X = 'x'; public function l(): string { return ''; } }
abstract class Z {}
function free() { ?> <b>}</b> <?php echo <<<"EOT"
 } function no() {
EOT; }
if (!function_exists('late')) { function late() {} }
""",
        [
            ('App\\Http', 'module', 'namespace App\\', 'ce App\\Http;'), ('A', 'class', '#[Attr]\nfinal ', '() {} }; } }'), ('__construct', 'method', 'public functio', 'urn $x; }; }'),
            ('ab', 'method', 'abstract prote', '(): ?string;'), ('s', 'method', 'public static ', 'on() {} }; }'), ('anon', 'method', 'function anon(', 'on anon() {}'),
            ('I', 'interface', 'interface I { ', '$x = "}"); }'), ('m', 'method', 'public functio', 'g $x = "}");'), ('T', 'class', 'trait T { func', '::class; } }'),
            ('t', 'method', 'function t() {', ' A::class; }'), ('l', 'method', 'public functio', "return ''; }"), ('Z', 'class', 'abstract class', 't class Z {}'),
            ('free', 'function', 'function free(', 'o() {\nEOT; }'), ('late', 'function', 'function late(', 'on late() {}'),
        ],
        [],
    ),
    (
        "kotlin",
        r"""package a
@Ann class A<T>(val x: Int, private val y: (Int) -> Unit) : B<T>(x), C by y, D {
  companion object { fun make() = A(1) }
  companion object Named { }
  override suspend fun <U : T> List<U>.ext(f: (U) -> String = { it.toString() }): Map<U, String> where U : Any { return map { "a ${f("}")}" } }
  fun m() = n()
  fun long(): Int =
    if (x) 1
    else listOf(1).map { it }
      .sum()
  val p: Int get() = 3
  abstract fun ab(x: Int): Int
  fun last() { }
}
interface I { fun x() }
fun interface Fi { fun y(): Int }
sealed class S
data class P(val a: Int)
object O : I { override fun x() {} }
enum class E { A, B; fun z() = 1 }
fun `with space`() {}
fun String?.orE(): String = this ?: ""
val anon = fun(x: Int): Int { return x }
typealias X = Int
inline fun <reified T> r(): T { TODO() }
""",
        [
            ('A', 'class', '@Ann class A<T', 'last() { }\n}'), ('make', 'function', 'fun make() = A', 'ake() = A(1)'), ('ext', 'function', 'override suspe', 'f("}")}" } }'),
            ('m', 'function', 'fun m() = n()', 'un m() = n()'), ('long', 'function', 'fun long(): In', '      .sum()'), ('ab', 'function', 'abstract fun a', 'x: Int): Int'),
            ('last', 'function', 'fun last() { }', 'n last() { }'), ('I', 'class', 'interface I { ', ' { fun x() }'), ('x', 'function', 'fun x()', 'fun x()'),
            ('Fi', 'class', 'fun interface ', 'n y(): Int }'), ('y', 'function', 'fun y(): Int', 'fun y(): Int'), ('S', 'class', 'sealed class S', 'aled class S'),
            ('P', 'class', 'data class P(v', '(val a: Int)'), ('O', 'class', 'object O : I {', 'fun x() {} }'), ('x', 'function', 'override fun x', 'e fun x() {}'),
            ('E', 'class', 'enum class E {', 'un z() = 1 }'), ('z', 'function', 'fun z() = 1', 'fun z() = 1'), ('with space', 'function', 'fun `with spac', ' space`() {}'),
            ('orE', 'function', 'fun String?.or', '= this ?: ""'), ('r', 'function', 'inline fun <re', 'T { TODO() }'),
        ],
        [],
    ),
    (
        "swift",
        r"""import A
public final class A<T>: B, C where T: D {
  private(set) var x: Int { get { 1 } set { f() } }
  class func cf() -> Int { 1 }
  @discardableResult static func s<U>(_ a: U, b: (Int) -> Void = { _ in }) async throws -> [U: Int] where U: E { "a \(f("}"))" }
  init() { }
  deinit { }
  subscript(i: Int) -> Int { 1 }
  enum K { case a(Int), b; func k() {} }
}
extension A: F { func ext() {} static func == (l: A, r: A) -> Bool { true } }
protocol P { func p(); var q: Int { get } }
struct S { let closure = { (x: Int) in x } }
func free(x: Int...) -> some View { #"raw " }"# }
actor Ac { nonisolated func n() {} }
""",
        [
            ('A', 'class', 'public final c', 'c k() {} }\n}'), ('cf', 'method', 'class func cf(', '-> Int { 1 }'), ('s', 'method', '@discardableRe', '\\(f("}"))" }'),
            ('K', 'class', 'enum K { case ', 'unc k() {} }'), ('k', 'method', 'func k() {}', 'func k() {}'), ('ext', 'method', 'func ext() {}', 'unc ext() {}'),
            ('==', 'method', 'static func ==', 'ool { true }'), ('P', 'interface', 'protocol P { f', 'nt { get } }'), ('S', 'class', 'struct S { let', 'nt) in x } }'),
            ('free', 'function', 'func free(x: I', '"raw " }"# }'), ('Ac', 'class', 'actor Ac { non', 'unc n() {} }'), ('n', 'method', 'nonisolated fu', ' func n() {}'),
        ],
        [],
    ),
    (
        "bash",
        r"""#!/bin/bash
a() { echo "${x#}"; }
function b { if [ $# -gt 0 ]; then echo "}"; fi
}
function c() ( cd x; )
d ()
{
  cat <<EOF
e() {
EOF
  local f=$(g "$(h)")
}
my-func.x() { :; }
case $1 in start) a ;; esac
""",
        [
            ('a', 'function', 'a() { echo "${', 'o "${x#}"; }'), ('b', 'function', 'function b { i', 'ho "}"; fi\n}'), ('c', 'function', 'function c() (', '() ( cd x; )'),
            ('d', 'function', 'd ()\n{\n  cat <', '(g "$(h)")\n}'), ('my-func.x', 'function', 'my-func.x() { ', 'c.x() { :; }'),
        ],
        [],
    ),
    (
        "ruby",
        r"""require "x"
module A::B
  class C < D
    attr_reader :x
    class << self
      def s1; x if y; end
    end
    def self.b(x) = x + 1
    def ==(o) o.a == a end
    def []=(k, v)
      @h[k] = v unless v.nil?
      while k do v += 1 end
      x = if k then 1 else 2 end
      [1].each do |i| puts "end #{i}" end
      y = case k when 1 then :end end
      z = <<~EOS
        def no
        end
      EOS
      begin; foo; rescue; bar; end
      a.class; b.end; { if: 1, end: 2 }
      r = /def x; end/ =~ k
      return if k
      w %w[class def]
      until k; k = 1; end
      for i in [1] do p i end
      loop { |q| break }
    end
    def empty?; end
    def <=>(other) = a <=> other.a
    private def priv(a = {}, *b, &c)
      yield
    end
    def x=(v); @x = v; end
    def -@; self; end
    Foo = Struct.new(:a) do
      def inner; end
    end
  end
end
=begin
class No
end
=end
def top() = puts(
  1)
def after
end
__END__
def never; end
""",
        [
            ('B', 'module', 'module A::B\n  ', 'nd\n  end\nend'), ('C', 'class', 'class C < D\n  ', '   end\n  end'), ('s1', 'method', 'def s1; x if y', ' x if y; end'),
            ('b', 'method', 'def self.b(x) ', 'b(x) = x + 1'), ('==', 'method', 'def ==(o) o.a ', 'o.a == a end'), ('[]=', 'method', 'def []=(k, v)\n', 'ak }\n    end'),
            ('empty?', 'method', 'def empty?; en', ' empty?; end'), ('<=>', 'method', 'def <=>(other)', ' <=> other.a'), ('priv', 'method', 'def priv(a = {', 'ield\n    end'),
            ('x=', 'method', 'def x=(v); @x ', ' @x = v; end'), ('-@', 'method', 'def -@; self; ', '@; self; end'), ('inner', 'method', 'def inner; end', 'f inner; end'),
            ('top', 'method', 'def top() = pu', '= puts(\n  1)'), ('after', 'method', 'def after\nend', 'ef after\nend'),
        ],
        [],
    ),
    (
        "lua",
        r"""local M = {}
function M.a.b(x) if x then return 1 elseif y then return 2 else end end
function M:c() for i = 1, 2 do while true do repeat local f = function() end until x end end end
local function d() return [[ end ]] end
M.e = function(x) return x end -- end
local g = function() end
local t = { h = function() end, ["i"] = function() end, 1 }
--[==[ function no() end ]==]
function last() goto done ::done:: end
""",
        [
            ('b', 'function', 'function M.a.b', 'else end end'), ('c', 'method', 'function M:c()', ' end end end'), ('f', 'function', 'f = function()', 'nction() end'),
            ('d', 'function', 'local function', '[ end ]] end'), ('e', 'function', 'M.e = function', 'return x end'), ('g', 'function', 'g = function()', 'nction() end'),
            ('h', 'function', 'h = function()', 'nction() end'), ('last', 'function', 'function last(', '::done:: end'),
        ],
        [],
    ),
]


def _text(src, s):
    lines = src.split("\n")
    at = lambda line, column: sum(len(x) + 1 for x in lines[:line]) + len(lines[line].encode()[:column].decode())
    return src[at(s.start_line, s.start_column) : at(s.end_line, s.end_column)]


@pytest.mark.parametrize("lang,src,symbols,calls", CASES, ids=[c[0] for c in CASES])
def test_symbols_and_calls(lang, src, symbols, calls):
    found = symbols_of(src, lang)
    assert [(s.name, s.kind, _text(src, s)[:14], _text(src, s)[-12:]) for s in found] == symbols
    assert [(a, c, m) for a, _, c, _, _, m in calls_of(src, lang, found)] == calls


def calls(src, lang):
    return {(a, c) for a, _, c, *_ in calls_of(src, lang, symbols_of(src, lang))}


def test_what_is_no_call():
    assert calls("struct Box { Box() : v_(0) {} int v_; };", "cpp") == set()
    assert calls("int h(int (*cb)(int)) { return 0; }", "c") == set()
    assert calls("pub(crate) async fn f() {}", "rust") == set()
    assert calls("fn f(o: O) { match o { Some(x) => {} Foo(y) | Bar(y) if ok(y) => run(y), _ => {} } let P(a, b) = two(); }", "rust") == {("f", "ok"), ("f", "run"), ("f", "two")}
    assert calls("fn f() { vec![g(1)]; assert!(h(2)); }", "rust") == {("f", "vec"), ("f", "assert")}
    assert calls("int f() { Foo a(1); unsigned b = sizeof(int); return int(c) + new_one(a); }", "cpp") == {("f", "new_one")}
    assert calls("class A { void f() { new B(g()); new c.D<E>(1); @X(2) int y; } }", "java") == {("f", "g")}
    assert calls("function f() { return <p>Total (sum) of f(x) {g(1)}</p>; }", "javascript") == {("f", "g")}
    assert calls("function f() { const r = /a(b)/, s = `c(d) ${e(1)}`, t = 'h(i)'; }", "javascript") == {("f", "e")}
    assert calls("func f() { x := []byte(y); z := map[string]int(w); var g interface{ M() }; k(x) }", "go") == {("f", "k")}


def test_calls_with_type_arguments():
    assert calls("fn f() { b::<Vec<Vec<u8>>>(x); y.into::<A<B>>(); T::<u8>::new(); }", "rust") == {("f", "b"), ("f", "into"), ("f", "new")}
    assert calls("func f() { H[T](x); G[map[string]int, K](y) }", "go") == {("f", "H"), ("f", "G")}
    assert calls("function f() { g<Map<A, B[]>>(x); if (a < b && c > (d)) h(); }", "typescript") == {("f", "g"), ("f", "h")}
    assert calls("int f() { g<A<int>>(1); a.b<2>(); if (x < y && z > (w)) {} return 0; }", "cpp") == {("f", "g"), ("f", "b")}


def test_visibility_and_long_heads():
    words = " ".join(f"#[a{k}]" for k in range(200))
    src = f"{words}\npub(crate)\n{' ' * 900}async fn f() {{}}\n#[no_mangle]\n// note\nfn g() {{}}\n"
    assert [(s.name, s.start_line, s.visibility) for s in symbols_of(src, "rust")] == [("f", 1, "public"), ("g", 5, "public")]
    notes = "\n".join(f"@N{k}(a = {{1, 2}})" for k in range(100))
    assert [(s.name, s.start_line) for s in symbols_of(f"class A {{\n{notes}\npublic void f() {{}}\n}}", "java")] == [("A", 0), ("f", 1)]
    assert {s.name: s.visibility for s in symbols_of("export default class A {}\nexport const f = () => 1, g = function () {};\nconst h = () => 2;\n", "typescript")} == {"A": "public", "f": "public", "g": "public", "h": "private"}


def test_broken_brackets_lose_little():
    assert [s.name for s in symbols_of("fn a() { ( }\nfn b() { ] }\nfn c() {}\n", "rust")] == ["a", "b", "c"]
    assert [s.name for s in symbols_of("#if X\nint a() {\n#else\nint a(int b) {\n#endif\n}\nint c() { return 1; }\n", "c")] == ["a", "a", "c"]
    for lang in ("rust", "go", "typescript", "tsx", "javascript", "c", "cpp", "java", "csharp", "php", "kotlin", "swift", "bash", "ruby", "lua"):
        for src in ("", "{", "}", "((", "'", '"', "`", "/*", "fn", "class", "function (", "def ", "<", "a <b", "x = {" * 50, "template <", "match {", "type (", "enum", "@", "#", "operator", "typedef"):
            symbols_of(src, lang)


def test_time_is_in_proportion():
    import time

    sources = {"rust": "impl T{k} {{ fn f{k}(&self) {{ match x {{ Some(y) => g(y), _ => h() }} }} }}\n", "cpp": "struct S{k} {{ int f() {{ return g<int>(h(1)); }} }};\n", "typescript": "class C{k} {{ m(a: B<C>): D {{ return this.n<E>(f()); }} }}\n", "java": "class C{k} {{ List<A<B>> m(int a) {{ return n(this.f()); }} }}\n", "ruby": "def f{k}(a)\n  if a then b(1) end\nend\n"}
    for lang, line in sources.items():
        took = []
        for n in (1000, 4000):
            src = "".join(line.format(k=k) for k in range(n))
            began = time.process_time()
            assert len(symbols_of(src, lang)) >= n
            took.append(time.process_time() - began)
        assert took[1] < 9 * took[0] + 0.2, lang


def test_python_that_its_parser_refuses():
    src = 'import os, a.b as c\nfrom .x import y\nclass A(B):\n    """def no(): f()"""\n    def m(self, x=(1, 2)):\n        print "old", g(x)  # h()\n        self.k(os.l())\n\n        def inner():\n            exec "s"\n            return n()\ndef last(): pass\n'
    found = symbols_of(src, "python")
    assert [(s.name, s.kind, *s.span) for s in found] == [("A", "class", 2, 0, 10, 22), ("m", "function", 4, 4, 10, 22), ("inner", "function", 8, 8, 10, 22), ("last", "function", 11, 0, 11, 16)]
    assert [(a, c, m) for a, _, c, _, _, m in calls_of(src, "python", found)] == [("m", "g", False), ("m", "k", True), ("m", "l", True), ("inner", "n", False)]
    assert [(m, line, column) for m, line, column in imports_of(src, "python")] == [("os", 0, 7), ("a.b", 0, 11), (".x", 1, 5)]


@pytest.mark.parametrize("lang", ["rust", "go", "typescript", "tsx", "javascript", "c", "cpp", "java", "php", "kotlin", "swift", "bash", "ruby", "lua", "python"])
def test_long_comments_and_blank_lines_take_time_in_proportion(lang):
    import time

    from quarrylens.extract.facts import facts_of

    mark = {"python": "#", "ruby": "#", "bash": "#", "lua": "--"}.get(lang, "//")
    took = []
    for n in (3000, 12000):
        began = time.process_time()
        facts_of(("<?php\n" if lang == "php" else "") + f"{mark} more words here\n" * n + "\n" * n + "x = 1\n" * n, lang)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2
