"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_expr(e: str | Column) -> Column:
    """A row expression given as SQL text or as a Column."""
    return F.expr(e) if isinstance(e, str) else e


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without time zone."""
    return F.unix_micros(as_column(ts).cast("timestamp"))


def moment(as_of) -> Column:
    """The reference time of an age rule: a Column, a datetime or timestamp text."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def age_seconds(ts: str | Column, as_of) -> Column:
    return (micros(moment(as_of)) - micros(ts)) / F.lit(1e6)


def key_hash(key: str | Column, salt: str = "") -> Column:
    """The first 32 bits of the md5 of the key text. A NULL key counts as empty
    text, so every row has a hash."""
    text = F.concat(F.lit(salt), F.coalesce(as_column(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def key_bucket(key: str | Column, salt: str = "", buckets: int = 10_000) -> Column:
    """A repeatable bucket 0..buckets-1 from the key's hash."""
    return key_hash(key, salt) % buckets


def in_sample(key: str | Column, rate: float, salt: str = "") -> Column:
    """Whether a key is in the repeatable sample of this rate; outside (0, 1) all are."""
    return key_hash(key, salt) < F.lit(round(rate * 2**32)) if 0 < rate < 1 else F.lit(True)


def differs(a: str | Column, b: str | Column) -> Column:
    """IS DISTINCT FROM: NULL counts as a value."""
    return ~as_column(a).eqNullSafe(as_column(b))


def clean_identifier(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(as_column(c)), "[^A-Za-z0-9_]", "")


def is_identifier(c: str | Column) -> Column:
    return as_column(c).rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def shorten(c: str | Column, limit: int) -> Column:
    text = as_column(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def index_name(table: str | Column, column: str | Column) -> Column:
    """Index name of a table column, at most 63 characters."""
    return F.substring(F.concat_ws("_", F.lit("idx"), as_column(table), as_column(column)), 1, 63)


def grade(value: str | Column, high: float, low: float, names=("ok", "warn", "danger")) -> Column:
    """Three levels: at least ``high``, at least ``low``, below."""
    v = as_column(value)
    return F.when(v >= high, names[0]).when(v >= low, names[1]).otherwise(names[2])


def ratio(part: str | Column, whole: str | Column, empty: float) -> Column:
    p, w = as_column(part), as_column(whole)
    return F.when(w > 0, p.cast("double") / w.cast("double")).otherwise(F.lit(float(empty)))


def slo_breach(p99: str | Column, err_pct: str | Column, max_p99_ms: int, max_error_pct: float) -> tuple[Column, Column]:
    """Breach flag and reason. Latency is judged first, a limit of 0 is off."""
    p, e = as_column(p99), as_column(err_pct)
    slow = (p > max_p99_ms) if max_p99_ms > 0 else F.lit(False)
    failing = (e > max_error_pct) if max_error_pct > 0 else F.lit(False)
    slow, failing = F.coalesce(slow, F.lit(False)), F.coalesce(failing, F.lit(False))
    why = F.when(
        slow,
        F.concat(F.lit("p99 "), F.bround(p, 0).cast("long").cast("string"), F.lit(f"ms > {int(max_p99_ms)}ms")),
    ).when(failing, F.format_string(f"error-rate %.2f%% > {max_error_pct:.2f}%%", e))
    return slow | failing, why


def health_score(active, max_conns, lag_ms, waiting, dead) -> Column:
    """0..1 load score: connections, replication lag, lock queue, dead rows.

    A sample without any reading is unknown and scores 0.5.
    """
    a, m, lag, q, d = (as_column(c) for c in (active, max_conns, lag_ms, waiting, dead))
    known = F.coalesce(a, m, lag, q, d).isNotNull()
    conn = F.when(m > 0, F.lit(1.0) - F.coalesce(a, F.lit(0)).cast("double") / m.cast("double")).otherwise(1.0)
    repl = F.when(lag > 0, F.greatest(F.lit(0.0), F.lit(1.0) - lag / F.lit(1000.0))).otherwise(1.0)
    lock = F.when(q > 0, F.greatest(F.lit(0.0), F.lit(1.0) - q.cast("double") / F.lit(10.0))).otherwise(1.0)
    dead_part = F.when(d > 1_000_000, 0.5).when(d > 100_000, 0.75).otherwise(1.0)
    total = conn * 0.3 + repl * 0.3 + lock * 0.2 + dead_part * 0.2
    return F.when(known, total).otherwise(0.5)
