"""Source code with nested declarations in all languages whose calls are read, and YAML and TOML, generated from the driver's tables.

A file has p_size % 4 + 1 levels, each indented by two more spaces: a line that opens the level, one that holds its calls, and, after the
innermost, one that closes it.  {i} is the part's key and the level's number.  Names, strings and types hold brackets that are none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.tables import dealt


class Nest(NamedTuple):
    """outer opens the outermost level, inner the others; a level declares ``name`` where its line says so."""

    language: str
    ending: str
    outer: str
    inner: str
    calls: str
    close: str


# The lines of a level in each language.  Each calls c{i} and, after a dot or an arrow, m{i}.
NESTS = (
    Nest("rust", "rs", "pub(crate) fn f{i}<T: Into<Vec<u8>>>(x: T) -> [u8; 2] {", "pub(crate) fn f{i}<T: Into<Vec<u8>>>(x: T) -> [u8; 2] {", "c{i}::<Vec<Vec<u8>>>(\"}\", '{').m{i}(|Some(q)| q);", "}"),
    Nest("go", "go", "func F{i}[T any](x map[string]interface{}) (r struct{ a int }) {", "g := func(y []T) {", 'c{i}[T]("}").m{i}([]byte(`{`))', "}"),
    Nest("python", "py", 'def f{i}(x={1: "("}):', 'def f{i}(x={1: "("}):', 'é = c{i}(")").m{i}(x)', ""),
    Nest("typescript", "ts", "async function f{i}<T extends X<Y>>(x: (a: T) => void): Promise<{ a: T }> {", "async function f{i}<T extends X<Y>>(x: (a: T) => void): Promise<{ a: T }> {", "c{i}<Array<T>>(`}${x}`).m{i}(/[}]/);", "}"),
    Nest("tsx", "tsx", "const f{i} = (x: { a: number }): B => {", "const f{i} = (x: { a: number }): B => {", "c{i}(<b t=\"}\">don't (so) {x}</b>)?.m{i}();", "};"),
    Nest("javascript", "js", "function* f{i}({ a, b } = {}) {", "function* f{i}({ a, b } = {}) {", "c{i}(`}${`{${a}`}`).m{i}(b / 2 / 1);", "}"),
    Nest("c", "c", "static int f{i}(int (*cb)(int), char *s) {", "if (s[0] == '}') {", 'c{i}("}", sizeof(s), (int)1)->m{i}(2);', "}"),
    Nest("cpp", "cpp", "struct S{i} : B<int> {", "struct S{i} : B<int> {", 'S{i}& operator+(int x) { return c{i}<T<int>>(R"(})").m{i}(X{1}); }', "};"),
    Nest("java", "java", "class S{i}<T extends B<T>> {", "class S{i}<T extends B<T>> {", '@A(x = {"}"}) <U> Map<U, int[]> f{i}(U... x) throws E { return this.<U>c{i}(new D(x)).m{i}(); }', "}"),
)

# A level of a YAML and of a TOML file.  {i} as above.
YAML_LEVEL = "k{i}: &a{i}\n{in}  t: |\n{in}    x{i}: no\n\n{in}  'q:{i}': {e: 1, f: [\"}\", {g: 2}]} # h: 3\n{in}  u: a:b\n{in}    more: no\n{in}  n:\n"
TOML_TABLE = '[t{i}."x y"]\nk = {e = 1, "f" = [{g = 2}, "}"]} # h = 3\ns = """\nx = 1\n[no]\n"""\n"q r" = \'=\'\n'


def depth() -> Column:
    return (F.col("p_size") % 4 + 1).cast("int")


def _level(line: Column, key: Column, i: Column) -> Column:
    return F.concat(F.repeat(F.lit(" "), 2 * i), F.replace(line, F.lit("{i}"), F.concat(key, F.lit("_"), i.cast("string"))), F.lit("\n"))


def nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, text."""
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    which = (F.col("p_partkey") % len(NESTS)).cast("int")
    pick = lambda field: F.element_at(F.array(*[F.lit(getattr(n, field)) for n in NESTS]), which + 1)
    key = F.col("p_partkey").cast("string")
    levels = F.sequence(F.lit(0), depth() - 1)
    down = F.transform(levels, lambda i: F.concat(_level(F.when(i == 0, pick("outer")).otherwise(pick("inner")), key, i), F.lit("  "), _level(pick("calls"), key, i)))
    up = F.transform(F.reverse(levels), lambda i: F.when(pick("close") == "", F.lit("")).otherwise(_level(pick("close"), key, i)))
    text = F.concat(F.array_join(down, ""), F.array_join(up, ""))
    return part.select(F.concat(F.lit("nest/f"), key, F.lit("."), pick("ending")).alias("path"), pick("language").alias("language"), text.alias("text"))


def data_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, text of a YAML file of nested mappings, or a TOML file of as many tables, for each part."""
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    key = F.col("p_partkey").cast("string")
    levels = F.sequence(F.lit(0), depth() - 1)
    named = lambda text, i: F.replace(F.lit(text), F.lit("{i}"), F.concat(key, F.lit("_"), i.cast("string")))
    margin = lambda i: F.repeat(F.lit(" "), 4 * i)
    yaml = F.array_join(F.transform(levels, lambda i: F.concat(margin(i), F.replace(named(YAML_LEVEL, i), F.lit("{in}"), margin(i)))), "")
    toml = F.array_join(F.transform(levels, lambda i: named(TOML_TABLE, i)), "")
    is_yaml = F.col("p_partkey") % 2 == 0
    language = F.when(is_yaml, "yaml").otherwise("toml")
    return part.select(F.concat(F.lit("data/f"), key, F.lit("."), language).alias("path"), language.alias("language"), F.when(is_yaml, yaml).otherwise(toml).alias("text"))
