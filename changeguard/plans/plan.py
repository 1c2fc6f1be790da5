"""A data change described as configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

# Lifecycle states in order, terminal states, defaults.
FLOW = ("Pending", "Expanding", "Backfilling", "Verifying", "Canary", "Cutover", "Contracting", "Done")
ROLLING_BACK, ROLLED_BACK = "RollingBack", "RolledBack"
STATES = (*FLOW, ROLLING_BACK, ROLLED_BACK)
TERMINAL = ("Done", ROLLED_BACK)
CANARY_STEPS = (1, 5, 25, 100)
PARITY_THRESHOLD = 0.999
ON_FAILURE = ("rollback", "pause")
STRATEGY = "expand-contract"
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"
BATCH_SIZE, THROTTLE_MS = 5000, 20


# Column types of raw statements and what they are here.
TYPES = {
    "text": "string", "varchar": "string", "character varying": "string", "char": "string", "uuid": "string", "json": "string", "jsonb": "string",
    "smallint": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "real": "float", "double precision": "double",
    "boolean": "boolean", "bool": "boolean", "date": "date", "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
    "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "bytea": "binary",
}
_ALTER = re.compile(r'ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?"?(?:\w+\.)?(\w+)"?\s+(.+)', re.I | re.S)
_ADD = re.compile(r'ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?"?(\w+)"?\s+([a-z ]+?(?:\(\s*\d+\s*(?:,\s*\d+\s*)?\))?)(\s+NOT\s+NULL|\s+NULL)?', re.I)
_DROP = re.compile(r'DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?"?(\w+)"?(?:\s+(?:CASCADE|RESTRICT))?', re.I)
_NO_DATA = re.compile(r"(?:CREATE\s+(?:UNIQUE\s+)?INDEX|DROP\s+INDEX|REINDEX|ANALYZE|VACUUM)\b", re.I)


class PlanError(ValueError):
    """The plan breaks one of its rules."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "string"
    expression: str | None = None
    nullable: bool = False
    indexed: bool = False  # kept for old plans; Spark tables have no indexes


@dataclass(frozen=True)
class Slo:
    """Limits of a rollout. 0 switches a limit off."""

    max_p99_latency_ms: int = 0
    max_error_rate_pct: float = 0.0
    min_parity: float = 0.0


@dataclass(frozen=True)
class ThrottleConfig:
    """Adaptive pacing of a backfill."""

    batch: int = 5000
    batch_min: int = 100
    batch_max: int = 50_000
    pause_ms: int = 20
    pause_min: int = 0
    pause_max: int = 5000
    trip_below: float = 0.1
    recover_above: float = 0.3


def column_type(text: str) -> str:
    """The type here of a column type in a raw statement."""
    name, _, size = text.strip().lower().partition("(")
    name = " ".join(name.split())
    if name in ("numeric", "decimal"):
        return f"decimal({size.rstrip(') ')})" if size else "double"
    if name not in TYPES:
        raise PlanError(f"column type {text.strip()!r} is not supported")
    return TYPES[name]


def read_statements(statements, table: str) -> tuple[list[ColumnSpec], list[str]]:
    """(added columns, dropped columns) of raw ALTER TABLE statements.

    Statements about indexes and statistics change no data here and are passed
    over; every other statement is refused.
    """
    add, drop = [], []
    for text in statements or ():
        body = text.strip().rstrip(";").strip()
        if _NO_DATA.match(body):
            continue
        alter = _ALTER.fullmatch(body)
        if not alter:
            raise PlanError(f"statement is not supported: {text!r}")
        if alter.group(1).lower() != table.lower():
            raise PlanError(f"statement is about another table: {text!r}")
        for part in re.split(r",(?![^(]*\))", alter.group(2)):
            part = part.strip()
            if m := _ADD.fullmatch(part):
                add.append(ColumnSpec(m.group(1), column_type(m.group(2)), nullable="NOT" not in (m.group(3) or "").upper()))
            elif m := _DROP.fullmatch(part):
                drop.append(m.group(1))
            else:
                raise PlanError(f"statement is not supported: {text!r}")
    return add, drop


@dataclass(frozen=True)
class Plan:
    id: str
    version: int
    table: str
    add: tuple[ColumnSpec, ...] = ()
    drop: tuple[str, ...] = ()
    strategy: str = STRATEGY
    batch_size: int = BATCH_SIZE
    throttle_ms: int = THROTTLE_MS
    parity_threshold: float = PARITY_THRESHOLD
    sample_rate: float = 1.0
    steps: tuple[int, ...] = CANARY_STEPS
    slo: Slo = field(default_factory=Slo)
    on_failure: str = "rollback"

    def __post_init__(self):
        problems = list(self._problems())
        if problems:
            raise PlanError("; ".join(problems))

    def _problems(self):
        if not self.id:
            yield "id is required"
        if self.version <= 0:
            yield "version must be above 0"
        for what, name in [("table", self.table), *[("column", c.name) for c in self.add]]:
            if not re.match(IDENTIFIER, name or ""):
                yield f"{what} {name!r} is not an identifier"
        if self.strategy != STRATEGY:
            yield f"strategy {self.strategy!r} is not supported"
        if not self.add and not self.drop:
            yield "nothing to add or drop"
        yield from (f"step {s} is not in 1..100" for s in self.steps if not 1 <= s <= 100)
        if self.on_failure not in ON_FAILURE:
            yield f"on_failure {self.on_failure!r} is not one of {', '.join(ON_FAILURE)}"

    @property
    def exprs(self) -> dict[str, str]:
        """Derived columns and their expressions."""
        return {c.name: c.expression for c in self.add if c.expression}

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.add if not c.nullable]

    @property
    def min_parity(self) -> float:
        return max(self.parity_threshold, self.slo.min_parity)

    @classmethod
    def from_dict(cls, doc: Mapping) -> Plan:
        """From the nested document form, with defaults for what it leaves out."""
        backfill, verify = doc.get("backfill") or {}, doc.get("verify") or {}
        slo, canary = doc.get("slo") or {}, doc.get("canary") or {}
        table = doc.get("table") or ""
        raw, odd = read_statements(doc.get("expand"), table)
        if odd:
            raise PlanError(f"expand must not drop columns: {', '.join(odd)}")
        odd, raw_drop = read_statements(doc.get("contract"), table)
        if odd:
            raise PlanError(f"contract must not add columns: {', '.join(c.name for c in odd)}")
        odd, undone = read_statements(doc.get("rollback"), table)
        add = [ColumnSpec(**c) for c in doc.get("add_columns") or ()]
        column = backfill.get("column")
        types = {c.name: c.type for c in raw}
        add += [c for c in raw if c.name not in {a.name for a in add} and c.name != column]
        drop = [*(doc.get("drop_columns") or ())]
        drop += [c for c in raw_drop if c not in drop]
        if column and column not in {c.name for c in add}:
            if not backfill.get("source_expr"):
                raise PlanError("backfill.source_expr is required with backfill.column")
            add.insert(0, ColumnSpec(column, backfill.get("type") or types.get(column, "string"), backfill["source_expr"]))
        stray = sorted(set(undone) - {c.name for c in add})
        if odd or stray:
            raise PlanError(f"rollback may only drop what the plan adds, not {', '.join([*(c.name for c in odd), *stray])}")
        return cls(
            id=doc.get("id") or "",
            version=int(doc.get("version") or 0),
            table=table,
            add=tuple(add),
            drop=tuple(drop),
            strategy=doc.get("strategy") or STRATEGY,
            batch_size=int(backfill.get("batch_size") or BATCH_SIZE),
            throttle_ms=int(backfill.get("throttle_ms") or THROTTLE_MS),
            parity_threshold=float(verify.get("parity_threshold") or PARITY_THRESHOLD),
            sample_rate=float(verify.get("sample_rate") or 1.0),
            steps=tuple(canary.get("steps") or CANARY_STEPS),
            slo=Slo(**{k: slo[k] for k in ("max_p99_latency_ms", "max_error_rate_pct", "min_parity") if k in slo}),
            on_failure=doc.get("on_failure") or "rollback",
        )

    @classmethod
    def from_yaml(cls, text: str) -> Plan:
        try:
            import yaml
        except ImportError as e:  # optional
            raise PlanError("PyYAML is needed to read YAML plans") from e
        return cls.from_dict(yaml.safe_load(text) or {})
