"""A gated data change from start to end, resumable at every step."""

from __future__ import annotations

import datetime as dt
import json
import math
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeguard.functions.columns import key_hash
from changeguard.operators.backfill import fill_pending
from changeguard.operators.lifecycle import current_state
from changeguard.operators.parity import drift_columns, parity_gate, verify_columns
from changeguard.operators.registry import service_readiness
from changeguard.operators.schema_change import ChangeError, contract, expand, rollback, verify_rollback
from changeguard.operators.slo import canary_run, lag_gate
from changeguard.plans.plan import FLOW, ROLLED_BACK, ROLLING_BACK, TERMINAL, Plan
from changeguard.sources.commits import CommitLog, Folder, as_file, commit_name
from changeguard.sources.logs import BACKFILL_LOG, STATE_EVENT, append_log, read_log

#: Rows one range of a backfill is meant to have; each range is written and logged on its own.
RANGE_ROWS = 50_000_000
#: Files a range is dealt into when the source is cut.
RANGE_FILES = 16


@dataclass(frozen=True)
class RequestLog:
    """Where the objectives of a rollout are measured."""

    df: DataFrame
    key: str
    latency: str
    is_error: Column


@dataclass(frozen=True)
class ChangeResult:
    state: str
    table: DataFrame
    events: DataFrame


class ChangeJob:
    """Runs one plan on one table. ``workdir`` is a shared folder and belongs to
    this change: the event, batch and canary logs, the filled ranges and the final table.

    Events are numbered commits, and a run claims the log before its first step: of two runs on one folder the one
    that started earlier is refused at its next step. Data is written aside and moved to its place whole, so a
    stop between data and event leaves data that the next run takes over.

    ``lag`` has ``max_lag_ms`` rows as of now; ``as_of`` is the time of the log
    entries, the current time if it is not given.
    """

    def __init__(self, df: DataFrame, plan: Plan, requests: RequestLog | None, workdir: str, key: str = "id", registry: DataFrame | None = None,
                 lag: DataFrame | None = None, as_of: dt.datetime | None = None, range_rows: int = RANGE_ROWS):
        self.df, self.plan, self.requests, self.key, self.registry, self.lag = df, plan, requests, key, registry, lag
        self.spark = df.sparkSession
        self.as_of, self.range_rows = as_of, range_rows
        self.workdir, self.events_path, self.filled_path, self.final_path = workdir, *(f"{workdir}/{n}" for n in ("events", "filled", "final"))
        self.log = CommitLog(self.spark, self.events_path, STATE_EVENT)
        self.backfill_path, self.canary_path = f"{workdir}/backfill-log", f"{workdir}/canary-log"
        have = {c.lower() for c in df.columns}
        self.added = [s for s in plan.add if s.name.lower() not in have]

    def run(self, max_steps: int | None = None) -> ChangeResult:
        """Advance to a final state, or by ``max_steps``; a range of the backfill is a step."""
        state, seq, self.noted = self._where()
        steps = {
            "Pending": lambda: {}, "Expanding": self._expand, "Backfilling": self._backfill, "Verifying": self._verify,
            "Canary": self._canary, "Cutover": self._cutover, "Contracting": self._contract, ROLLING_BACK: self._rollback,
        }
        done = 0
        while state not in TERMINAL and (max_steps is None or done < max_steps):
            note = steps[state]()
            after = note.pop("next", None) or (ROLLED_BACK if state == ROLLING_BACK else FLOW[FLOW.index(state) + 1])
            seq += 1
            self._log(seq, state, after, note)
            state, done = after, done + 1
        return ChangeResult(state, self._table(state), read_log(self.spark, self.events_path, "state"))

    def _where(self) -> tuple[str, int, dict]:
        """(state, number of the last event, what the last event notes); this run is the writer from now on."""
        row = self.log.last()[1]
        if not row or row["to_state"] not in TERMINAL:
            row = self.log.claim()
        return (row["to_state"], row["id"], json.loads(row["detail"] or "{}")) if row else ("Pending", 0, {})

    def _now(self) -> dt.datetime:
        return dt.datetime.now(dt.UTC) if self.as_of is None else self.as_of

    def _log(self, seq: int, before: str, after: str, note: dict) -> None:
        self.log.commit([{"id": seq, "migration_id": self.plan.id, "from_state": before, "to_state": after, "detail": json.dumps(note), "created_at": self._now()}])
        self.noted = note

    def _publish(self, df: DataFrame, folder: str, name: str, watch: dict[str, Column] | None = None) -> dict:
        """Write ``df`` aside and move it to ``folder``/``name`` whole; what is there already, from a run that
        stopped before its event, stays. Returns the ``watch`` aggregates, from the write itself where there is one."""
        place, path = Folder(self.spark, folder), f"{folder}/{name}"
        watch = watch or {"rows": F.count(F.lit(1))}
        if not place.exists(name):
            seen = Observation()
            aside = f"{self.workdir}/attempts/{self.log.writer}/{name}"
            df.observe(seen, *(c.alias(n) for n, c in watch.items())).write.mode("overwrite").parquet(aside)
            if place.move(aside, name):
                return seen.get
        return self.spark.read.schema(df.schema).parquet(path).agg(*(c.alias(n) for n, c in watch.items())).first().asDict()

    def _table(self, state: str) -> DataFrame:
        if state == "Done":
            return self.spark.read.parquet(self.final_path)
        if state == ROLLED_BACK:
            return rollback(self.df, self.added)
        return self.df

    def _filled(self) -> DataFrame:
        wide = expand(self.df, self.plan.add)  # the schema: a range may be empty
        return self.spark.read.schema(wide.schema).parquet(f"{self.filled_path}/range-*")

    def _expand(self) -> dict:
        return {"columns": [c.name for c in self.added]}

    def _ranges(self) -> dict:
        """How the backfill is cut: upper bounds of key ranges, or the number of hash ranges if keys are no numbers."""
        rows = self.df.count()
        n = max(1, math.ceil(rows / max(self.range_rows, self.plan.batch_size)))
        if n == 1:
            return {"bounds": [], "hashed": 0}
        if isinstance(self.df.schema[self.key].dataType, T.IntegralType):
            at = self.df.agg(F.percentile_approx(self.key, [i / n for i in range(1, n)], 10_000)).first()[0]
            return {"bounds": sorted(set(at or [])), "hashed": 0}
        return {"bounds": [], "hashed": n}

    def _range_of(self, cut: dict) -> Column:
        """Number of a row's range, from 1; the first also has NULL keys."""
        if cut["hashed"]:
            return F.floor(F.coalesce(key_hash(self.key), F.lit(0)) / (2**32 / cut["hashed"])).cast("int") + 1
        k, bounds = F.col(self.key), cut["bounds"]
        above = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < k) if bounds else F.array()
        return F.when(k.isNull(), 1).otherwise(F.size(above) + 1)

    def _source(self, cut: dict, n: int, ranges: int) -> DataFrame:
        """The rows of a range. With several, the source is read once and dealt to a folder per range, before the first."""
        if ranges == 1:
            return self.df
        dealt = f"{self.workdir}/dealt"
        if not Folder(self.spark, self.workdir).exists("dealt"):
            tagged = self.df.withColumn("__range", self._range_of(cut))
            # By range and a hash of the whole row: no range and no key ends in one task.
            spread = tagged.repartition(ranges * RANGE_FILES, "__range", F.pmod(F.xxhash64(*(f"`{c}`" for c in self.df.columns)), F.lit(RANGE_FILES)))
            aside = f"{self.workdir}/attempts/{self.log.writer}/dealt"
            spread.write.partitionBy("__range").mode("overwrite").parquet(aside)
            Folder(self.spark, self.workdir).move(aside, "dealt")
        mine = f"__range={n}"
        if not Folder(self.spark, dealt).exists(mine):  # no key fell between two bounds
            return self.spark.createDataFrame([], self.df.schema)
        return self.spark.read.schema(self.df.schema).parquet(f"{dealt}/{mine}")

    def _backfill(self) -> dict:
        """Fill and write the next range; its event is the checkpoint that a later run goes on from."""
        before = self.noted if "batch_num" in self.noted else {"batch_num": 0, "rows_done": 0, "last_id": None, **self._cut()}
        n, ranges = before["batch_num"] + 1, before["hashed"] or len(before["bounds"]) + 1
        wide = expand(self._source(before, n, ranges), self.plan.add)
        filled = fill_pending(wide, self.plan.exprs) if self.plan.exprs else wide
        done = self._publish(filled, self.filled_path, f"range-{n:06d}", {"rows": F.count(F.lit(1)), "last": F.max(self.key)})
        # Named by the range, so a repeated step leaves one row.
        note = {"migration_id": self.plan.id, "batch_number": n, "rows_affected": done["rows"], "throttle_ms": self.plan.throttle_ms, "created_at": self._now()}
        Folder(self.spark, self.backfill_path).put(commit_name(n), as_file([note], BACKFILL_LOG))
        last = before["last_id"] if before["hashed"] or done["last"] is None else done["last"]
        point = {"batch_num": n, "rows_done": before["rows_done"] + done["rows"], "last_id": last}
        if n < ranges:
            return {**point, "bounds": before["bounds"], "hashed": before["hashed"], "next": "Backfilling"}
        return {**{k: v for k, v in point.items() if k != "batch_num"}, "batches": n, "filled": list(self.plan.exprs)}

    def _cut(self) -> dict:
        """The ranges of this change: those that a stopped run has dealt the source by, or new ones."""
        place = Folder(self.spark, self.workdir)
        if not place.exists("ranges.json"):
            place.put("ranges.json", json.dumps(self._ranges()).encode())
        return json.loads(place.read("ranges.json"))

    def _logged(self, path: str, kind: str, which: Column) -> bool:
        """Whether an interrupted step has written its log row already."""
        try:
            return not read_log(self.spark, path, kind).filter((F.col("migration_id") == self.plan.id) & which).isEmpty()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def _note(self, path: str, kind: str, rows: list[tuple], schema: str, at: str) -> None:
        frame = self.spark.createDataFrame(rows, schema).withColumns({"migration_id": F.lit(self.plan.id), at: F.lit(self._now())})
        append_log(frame.coalesce(1), path, kind)

    def _verify(self) -> dict:
        if not self.plan.exprs:
            return {"skipped": "nothing derived"}
        report = verify_columns(self._filled(), self.plan.exprs, self.key, self.plan.sample_rate, self.plan.id)
        rows = parity_gate(report, self.plan.min_parity).collect()  # one row per column
        for row in rows:
            if not row["passed"]:
                raise ChangeError(f"verify failed for {row['column_name']}: {row['reason']}")
        return {"parity": {r["column_name"]: r["parity"] for r in rows}}

    def _fail(self, why: str, note: dict) -> dict:
        if self.plan.on_failure == "rollback":
            return {**note, "reason": why, "next": ROLLING_BACK}
        raise ChangeError(why)

    def _canary(self) -> dict:
        lag = self._lag()
        if lag and lag["start_blocked"]:
            raise ChangeError(f"replication lag too high before canary: {lag['max_lag_ms']:.0f}ms (max: {self.plan.slo.max_p99_latency_ms}ms)")
        if self.requests is None:
            return {"skipped": "no request log"}
        r = self.requests
        run = canary_run(r.df, r.key, r.latency, r.is_error, self.plan.slo, self.plan.steps, self.plan.on_failure, self.plan.id)
        rows = run.orderBy("step").collect()  # one row per step
        seen = [(x["step"], x["traffic_pct"], None if x["p99_ms"] is None else float(x["p99_ms"]), x["err_pct"], x["slo_breached"]) for x in rows if x["outcome"] in ("healthy", "breach")]
        if seen and not self._logged(self.canary_path, "canary", F.col("step") == seen[-1][0]):
            self._note(self.canary_path, "canary", seen, "step int, traffic_pct int, p99_ms double, err_pct double, slo_breached boolean", "observed_at")
        for row in rows:
            if row["outcome"] == "breach":
                return self._fail(f"breach at {row['step']}%: {row['reason']}", {"canary_pct": row["step"]})
            if row["outcome"] == "no_data":
                raise ChangeError(f"no requests at {row['step']}%")
        return {"canary_pct": 100}

    def _lag(self):
        """The gate on the largest lag; None without lag rows or a latency limit."""
        if self.lag is None or not self.plan.slo.max_p99_latency_ms:
            return None
        return lag_gate(self.lag.agg(F.max("max_lag_ms").alias("max_lag_ms")), self.plan.slo).first()

    def _cutover(self) -> dict:
        if self.registry is not None:
            mine = self.registry.filter(F.col("migration_id").cast("string") == self.plan.id)
            row = service_readiness(mine.withColumn("_all", F.lit(1)), "_all").first()
            if row and not row["all_ready"]:
                return self._fail(f"{row['not_ready']} services not ready", {})
        if not self.plan.exprs:
            return {"skipped": "nothing derived"}
        rows = parity_gate(drift_columns(self._filled(), self.plan.exprs), self.plan.min_parity).collect()
        for row in rows:
            if not row["passed"]:
                return self._fail(f"{row['column_name']}: {row['reason']}", {"cutover_parity": row["parity"]})
        return {"cutover_parity": {r["column_name"]: r["parity"] for r in rows}}

    def _contract(self) -> dict:
        # Derived columns were counted at the cutover; the write still refuses NULLs.
        unchecked = [c for c in self.plan.required if c not in self.plan.exprs]
        final = contract(contract(self._filled(), (), unchecked), self.plan.drop, self.plan.required, check=False)
        self._publish(final, self.workdir, "final")
        return {"dropped": list(self.plan.drop), "not_null": self.plan.required}

    def _rollback(self) -> dict:
        names = [c.name for c in self.added]  # a column that was there before the change stays
        left = verify_rollback(rollback(self.df, self.added), names)
        if left:
            raise ChangeError(f"still there after rollback: {', '.join(left)}")
        return {"removed": names}


def run_change(df: DataFrame, plan: Plan, requests: RequestLog | None, workdir: str, key: str = "id", registry: DataFrame | None = None, max_steps: int | None = None,
               lag: DataFrame | None = None, as_of: dt.datetime | None = None, range_rows: int = RANGE_ROWS) -> ChangeResult:
    """Expand, backfill, verify, canary, cutover, contract; or roll back.

    Every step ends with an appended event; calling it again goes on from there,
    within a backfill from its last range.
    """
    return ChangeJob(df, plan, requests, workdir, key, registry, lag, as_of, range_rows).run(max_steps)


def change_state(result: ChangeResult) -> DataFrame:
    return current_state(result.events)
