"""State events of data changes: current state, intervals, transitions, lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeguard.functions.columns import as_column, micros
from changeguard.operators.ordered import scan
from changeguard.plans.plan import FLOW, ROLLED_BACK, ROLLING_BACK, TERMINAL

PAGE_SIZE = 20
DIRECT_ROWS = 10_000


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. Spark keeps one row per key and task before the shuffle."""
    return last_n(df, key, order, 1)


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows per group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def is_terminal(state: str | Column) -> Column:
    return as_column(state).isin(*TERMINAL)


def current_state(events: DataFrame) -> DataFrame:
    """State row per change from its event log; the newest event wins."""
    at = F.struct("created_at", "id")
    return events.groupBy("migration_id").agg(
        F.max_by("to_state", at).alias("state"), F.max("created_at").alias("updated_at")
    ).withColumn("terminal", is_terminal("state"))


def migration_summary(migrations: DataFrame, state: DataFrame) -> DataFrame:
    return migrations.join(state, "migration_id", "inner")


def state_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("state").agg(F.count("*").alias("n"))


def success_rate(state: DataFrame) -> DataFrame:
    """Done among finished changes in percent (0 if none), and how many are active."""
    done, back = F.count_if(F.col("state") == "Done"), F.count_if(F.col("state") == ROLLED_BACK)
    c = state.agg(done.alias("done"), back.alias("rolled_back"), F.count_if(~is_terminal("state")).alias("active"))
    ended = F.col("done") + F.col("rolled_back")
    return c.withColumn("success_rate", F.when(ended > 0, F.round(F.col("done") * 100.0 / ended)).otherwise(0).cast("long"))


def flow_progress(state: DataFrame, column: str = "state") -> DataFrame:
    """Percent of the happy path: round(100 * position / 8); other states are 0."""
    at = F.array_position(F.array(*[F.lit(s) for s in FLOW]), F.col(column))
    return state.withColumn("progress_pct", F.round(at * 100.0 / len(FLOW)).cast("long"))


def state_intervals(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """[enter, leave) of every state with the dwell time in seconds. The last
    state is open: leave is NULL and it lasts until ``as_of`` if given."""
    rows = scan(events, ["migration_id"], ["created_at", "id"], lead={"leave_at": F.col("created_at")})
    end = F.col("leave_at") if as_of is None else F.coalesce("leave_at", as_of)
    return rows.select(
        "migration_id", F.col("to_state").alias("state"), F.col("created_at").alias("enter_at"), "leave_at",
        ((micros(end) - micros("created_at")) / 1e6).alias("dwell_s"),
    )


def state_at(log: DataFrame, events: DataFrame, ts: str, key: str = "migration_id", tie: str = "id") -> DataFrame:
    """Log rows with the state their change was in at that time.

    The interval join as one ordered pass: events and log rows are put in one
    line per change and the last state is carried on, so no key produces pairs.
    """
    return asof(log, events, key, ts, "created_at", {"state": "to_state"}, tie, "id")


def asof(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, take: dict[str, str],
    left_tie: str, right_tie: str,
) -> DataFrame:
    """Each left row with columns of the latest right row at or before its time.

    Ties keep their own types. A NULL key matches nothing.
    """
    names = left.columns
    marks = right.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(right_tie).alias("_right_tie"),
        F.struct(*[F.col(src).alias(new) for new, src in take.items()]).alias("_mark"),
    )
    rows = left.select(
        F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
        F.col(left_tie).alias("_left_tie"), F.struct(*names).alias("_row"),
    )
    line = rows.unionByName(marks, allowMissingColumns=True)
    filled = scan(line, ["_k"], ["_t", "_side", "_right_tie", "_left_tie"], fill={"_last": F.col("_mark")})
    return filled.filter(F.col("_side") == 1).select("_row.*", *[F.col(f"_last.{n}").alias(n) for n in take])


def allowed_move() -> Column:
    """Whether (from_state, to_state) is an edge of the state graph."""
    f, t = F.col("from_state"), F.col("to_state")
    edges = [F.struct(F.lit(a), F.lit(b)) for a, b in zip(FLOW, FLOW[1:], strict=False)]
    edges += [F.struct(F.lit(a), F.lit(ROLLING_BACK)) for a in ("Canary", "Cutover")]
    edges.append(F.struct(F.lit(ROLLING_BACK), F.lit(ROLLED_BACK)))
    return F.array_contains(F.array(*edges), F.struct(f.alias("col1"), t.alias("col2")))


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Events that the state graph forbids, or whose from_state is not the state
    before. A move to the same state is a checkpoint; a first event may have no
    from_state."""
    rows = scan(events, ["migration_id"], ["created_at", "id"], lag={"previous_state": F.col("to_state")}, number="_rn")
    first = (F.col("_rn") == 1) & F.col("from_state").isNull()
    checkpoint = F.col("from_state").eqNullSafe(F.col("to_state"))
    broken = ~F.col("from_state").eqNullSafe(F.col("previous_state")) & (F.col("_rn") > 1)
    reason = F.when(first | (checkpoint & ~broken), None).when(broken, "chain_broken").when(
        ~F.coalesce(allowed_move(), F.lit(False)), "not_allowed")
    return (
        rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        .select("migration_id", "id", "from_state", "to_state", "previous_state", "reason")
    )


def recent(df: DataFrame, ts: str = "created_at", tie: str | None = None) -> DataFrame:
    """Newest first."""
    return df.orderBy(F.desc(ts), *([F.desc(tie)] if tie else []))


def page(df: DataFrame, order: Sequence[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) in ascending order. Early pages are a top-k, later
    ones are cut from a distributed numbering."""
    first = number * size
    if first + size <= DIRECT_ROWS:
        return df.orderBy(*order).offset(first).limit(size)
    rows = scan(df, [], order, number="_rn")
    return rows.filter((F.col("_rn") > first) & (F.col("_rn") <= first + size)).drop("_rn")


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / size).cast("long").alias("pages"))


def resumable(state: DataFrame) -> DataFrame:
    """Unfinished changes, oldest update first."""
    return state.filter(~F.col("terminal")).orderBy("updated_at", "migration_id")


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows where any column contains the text, whatever its case; an empty text keeps all."""
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return df.filter(hit)


def submit_new(cur: DataFrame, incoming: DataFrame, key: Sequence[str] = ("plan_id", "version"), order: Sequence[str] = ("created_at",)) -> DataFrame:
    """Current rows plus incoming ones with a new key; the first of several wins."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = incoming.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    return cur.unionByName(first.join(cur.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def refused_ids(ids: DataFrame, state: DataFrame, key: str = "migration_id") -> DataFrame:
    """Requested ids that may not be purged because the change is not finished."""
    return ids.join(state.filter(~F.col("terminal")).select(key), key, "left_semi")


def purge(tables: dict[str, DataFrame], ids: DataFrame, state: DataFrame, key: str = "migration_id") -> dict[str, DataFrame]:
    """Remove the finished changes among ``ids`` from a table and its children."""
    gone = ids.join(state.filter(F.col("terminal")).select(key), key, "left_semi").select(key)
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}
