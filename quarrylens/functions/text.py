"""Scalar functions over names, paths and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> F.Column:
    """Fold A to Z only; other scripts keep their case."""
    return F.translate(_col(c), UPPER, LOWER)


def fold(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def contains_ci(c, needle: str) -> F.Column:
    """Literal substring, ASCII case-insensitive; wildcards have no meaning."""
    return F.contains(ascii_lower(c), F.lit(fold(needle)))


def basename(path) -> F.Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent_dir(path) -> F.Column:
    """Directory of a path; `.` for a file at the root."""
    p = _col(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path) -> F.Column:
    """Last extension; none for a bare dotfile."""
    return F.regexp_extract(_col(path), "[^/]\\.([^./]+)$", 1)


def normalize_path(path) -> F.Column:
    """Collapse `.`, `..` and empty segments; `..` at the root is ignored."""
    start = F.array().cast("array<string>")

    def step(acc, seg):
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when((seg == "") | (seg == "."), acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    return F.array_join(F.aggregate(F.split(_col(path), "/"), start, step), "/")


def token_estimate(n_bytes) -> F.Column:
    """Four bytes a token, rounded down."""
    return F.floor(_col(n_bytes) / 4).cast("long")


def savings(baseline, returned) -> F.Column:
    return F.greatest(_col(baseline) - _col(returned), F.lit(0)).cast("long")


def reduction(baseline, returned) -> F.Column:
    """Saved percent with one decimal, half away from zero; 0 without a baseline."""
    base = _col(baseline)
    value = savings(base, returned).cast("double") * 100.0 / base
    return F.when(base <= 0, F.lit(0.0)).otherwise(F.floor(value * 10.0 + 0.5) / 10.0)


def iso_utc(ns) -> F.Column:
    """ISO-8601 of unix nanoseconds, whole seconds, in the session time zone (UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(_col(ns) / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shortened(text, most: int = 200) -> F.Column:
    t = _col(text)
    return F.when(F.char_length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def node_key(name, path, line) -> F.Column:
    return F.concat_ws(chr(1), _col(name), _col(path), _col(line).cast("string"))


def rotate_to_min(cycle) -> F.Column:
    """A cycle of names turned so that the least comes first."""
    c = _col(cycle)
    at = F.array_position(c, F.array_min(c)).cast("int")
    return F.concat(F.slice(c, at, F.size(c)), F.slice(c, F.lit(1), at - 1))


def duration_seconds(text) -> F.Column:
    """Seconds of `7d`, `2h`, `30m`, `120s`; null for anything else."""
    t = F.trim(_col(text))
    unit = F.create_map(*[F.lit(x) for x in ("d", 86400, "h", 3600, "m", 60, "s", 1)])
    good = t.rlike("^[0-9]+[dhms]$")
    return F.when(good, F.regexp_extract(t, "^([0-9]+)", 1).try_cast("long") * F.element_at(unit, F.right(t, F.lit(1)))).cast("long")


def window_label(seconds) -> F.Column:
    """`last 7 days`: the largest unit that divides the seconds."""
    s = _col(seconds)
    many = lambda n, name: F.concat(F.lit("last "), n.cast("string"), F.lit(" " + name), F.when(n == 1, "").otherwise("s"))
    out = many(s, "second")
    for size, name in ((60, "minute"), (3600, "hour"), (86400, "day")):
        out = F.when((s >= size) & (s % size == 0), many(F.floor(s / size), name)).otherwise(out)
    return out


def thousands(n) -> F.Column:
    return F.format_number(_col(n), 0)


def abbreviated(n) -> F.Column:
    """`805`, `12.4K`, `1.5M`, `2.1G`."""
    v = _col(n)
    size, sign = F.abs(v), F.when(v < 0, "-").otherwise("")
    out = F.concat(sign, size.cast("string"))
    for unit, name in ((1_000, "K"), (1_000_000, "M"), (1_000_000_000, "G")):
        # of a tie the even one; ten times the whole may not fit into 64 bits
        tenth = F.bround((size.cast("decimal(38,0)") * 10).cast("double") / float(unit), 0).cast("decimal(38,0)")
        out = F.when(size >= unit, F.concat(sign, ((tenth - tenth % 10) / 10).cast("decimal(38,0)").cast("string"), F.lit("."), (tenth % 10).cast("int").cast("string"), F.lit(name))).otherwise(out)
    return out


def meter(percent, width: int = 20) -> F.Column:
    full = F.floor(F.greatest(F.least(_col(percent), F.lit(100.0)), F.lit(0.0)) / 100 * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def shell_quote(text) -> F.Column:
    t = _col(text)
    return F.when(t.rlike("^[\\w./@%+=:,-]+$"), t).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def setting_flag(text) -> F.Column:
    """true or false in any case of letters, spaces around them ignored; null for anything else."""
    t = F.lower(F.trim(_col(text)))
    return F.when(t == "true", True).when(t == "false", False)
