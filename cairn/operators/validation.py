"""Fail-closed checks: named counts of violations in one action, and reports of all failures together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ValidationError(RuntimeError):
    """Some check found violations."""


@dataclass
class Report:
    facts: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def raise_if_failed(self) -> Report:
        if self.errors:
            raise ValidationError("; ".join(self.errors))
        return self


def violations(name: str, rows: DataFrame) -> DataFrame:
    """(check, violations): how many rows there are."""
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def counted(name: str, table: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """Row rules of one table, counted in a single pass."""
    once = table.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, (_, rule) in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(f"{name}.{label}").alias("check"), F.col(f"r{i}").alias("violations")) for i, (label, _) in enumerate(rules)])
    return once.select(F.explode(pairs).alias("x")).select("x.*")


def duplicate_keys(name: str, table: DataFrame, *keys: str) -> DataFrame:
    return violations(f"{name}.duplicate_key", table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))


def orphans(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return violations(f"{name}.orphan_{key}", child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti"))


def childless(name: str, parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    return violations(f"{name}.without_{child_key}", parent.join(child.select(F.col(child_key).alias(key)).distinct(), key, "left_anti"))


def report(checks: list[DataFrame], tables_with_rows: dict[str, DataFrame] | None = None) -> Report:
    """Runs all checks in one action; every check that found something, and every empty table, is an error."""
    parts = [c.select("check", "violations", F.lit(False).alias("wanted")) for c in checks]
    parts += [violations(f"{n}.rows", t).withColumn("wanted", F.lit(True)) for n, t in (tables_with_rows or {}).items()]
    out = Report()
    for r in reduce(DataFrame.unionByName, parts).collect():
        out.facts[r["check"]] = r.violations
        if r.wanted and not r.violations:
            out.errors.append(f"{r['check']}: no rows")
        elif not r.wanted and r.violations:
            out.errors.append(f"{r['check']}: {r.violations}")
    return out


def schema_errors(table: DataFrame, contract: StructType, exact: bool = True) -> list[str]:
    """Columns that are missing, of another type, unknown, or out of order."""
    have, want = {f.name: f.dataType for f in table.schema}, {f.name: f.dataType for f in contract}
    out = [f"missing column {n}" for n in want if n not in have]
    out += [f"column {n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    if exact:
        out += [f"unknown column {n}" for n in have if n not in want]
        if not out and list(have) != list(want):
            out.append("columns are out of order")
    return out


def invariants(counts: dict[str, int], *rules: tuple[str, Callable[[dict[str, int]], bool]]) -> list[str]:
    """Names of the rules about row counts that do not hold, with the counts they were told."""
    return [f"{name}: {counts}" for name, holds in rules if not holds(counts)]


def row_counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, in one action."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return {r.name: r.n for r in reduce(DataFrame.unionByName, parts).collect()}


def expected_results(actual: DataFrame, expected: dict[str, object], digits: int = 6) -> list[str]:
    """Differences of a one-row summary from its pinned results; numbers are compared after rounding."""
    row = actual.first()
    found = row.asDict() if row else {}
    plain = lambda v: round(float(v), digits) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v
    return [f"{k}: expected {v}, found {found.get(k)}" for k, v in expected.items() if k not in found or plain(found[k]) != plain(v)]


@dataclass(frozen=True)
class Rule:
    """What a column of a published table must hold; each part is checked only where it is given."""

    required: bool = False
    one_of: tuple = ()
    between: tuple | None = None
    pattern: str | None = None
    refers_to: tuple[DataFrame, str] | None = None


def broken(column: str, rule: Rule) -> list[tuple[str, Column]]:
    """What is told of rows that break a rule of a column, and which do; references are checked by joins."""
    c, out = F.col(column), []
    if rule.required:
        out.append(("missing", c.isNull() | (F.trim(c.cast("string")) == "")))
    if rule.one_of:
        out.append(("unknown", c.isNotNull() & ~c.isin(*rule.one_of)))
    if rule.between:
        out.append(("out_of_range", c.isNotNull() & ~c.between(*rule.between)))
    if rule.pattern:
        out.append(("malformed", c.isNotNull() & ~c.rlike(rule.pattern)))
    return out


def mart_contract(name: str, table: DataFrame, schema: StructType, rules: dict[str, Rule], key: tuple[str, ...] = ()) -> Report:
    """Schema, key, required columns, sets of values, ranges, patterns and references of a table, all failures together.

    Timestamps must be of a type with a time zone where the schema says so: a schema that differs fails before rows are
    read. Row rules are counted in one pass; each reference and the key are one more.
    """
    wrong = schema_errors(table, schema)
    if wrong:
        return Report(errors=[f"{name}: {w}" for w in wrong])
    told, checks = [], []
    for c, rule in rules.items():
        told += [(f"{c}_{label}", wrong) for label, wrong in broken(c, rule)]
        if rule.refers_to:
            checks.append(orphans(name, table.where(F.col(c).isNotNull()), c, *rule.refers_to))
    checks += [counted(name, table, *told)] if told else []
    checks += [duplicate_keys(name, table, *key)] if key else []
    return report(checks) if checks else Report()


@dataclass(frozen=True)
class Published:
    """A published table and what it must be: schema, key, rules of columns, number of rows, rules that only warn."""

    rows: DataFrame
    schema: StructType
    key: tuple[str, ...] = ()
    rules: dict[str, Rule] = field(default_factory=dict)
    expected: int | None = None
    warn: dict[str, Column] = field(default_factory=dict)


#: (name, child table, child column, parent table, parent column): every value of the child is one of the parent's.
Identity = tuple[str, str, str, str, str]


def suite(tables: dict[str, Published], identities: tuple[Identity, ...] = (), *counts: tuple[str, Callable[[dict[str, int]], bool]]) -> Report:
    """All tables of one publication at once: schemas, keys, columns, numbers of rows and identities across tables.

    Tables whose schema is wrong are told and left out of what reads rows; everything else runs as one action. Empty
    tables are errors unless ``expected`` is 0. Rules of ``warn`` that rows break are warnings, which do not fail the suite.
    ``counts`` are rules over the numbers of rows by table.
    """
    out = Report()
    for name, t in tables.items():
        out.errors += [f"{name}: {w}" for w in schema_errors(t.rows, t.schema)]
    sound = {n: t for n, t in tables.items() if not schema_errors(t.rows, t.schema)}
    checks, soft = [], set()
    for name, t in sound.items():
        told = [("rows", F.lit(True)), *((f"warn_{k}", c) for k, c in t.warn.items()), *((f"{c}_{label}", rule) for c, r in t.rules.items() for label, rule in broken(c, r))]
        soft |= {f"{name}.rows", *(f"{name}.warn_{k}" for k in t.warn)}
        checks += [counted(name, t.rows, *told), *([duplicate_keys(name, t.rows, *t.key)] if t.key else [])]
        checks += [orphans(name, t.rows.where(F.col(c).isNotNull()), c, *r.refers_to) for c, r in t.rules.items() if r.refers_to]
    for label, child, column, parent, of in identities:
        if child in sound and parent in sound:
            left = sound[child].rows.select(F.col(column).alias("__value")).where("__value is not null")
            checks.append(violations(label, left.join(sound[parent].rows.select(F.col(of).alias("__value")).distinct(), "__value", "left_anti")))
        else:
            out.errors.append(f"{label}: not checked, a table of it is unsound")
    out.facts = {r["check"]: r.violations for r in reduce(DataFrame.unionByName, checks).collect()} if checks else {}
    found = {n: out.facts[f"{n}.rows"] for n in sound}
    out.errors += [f"{check}: {n}" for check, n in out.facts.items() if n and check not in soft]
    out.warnings += [f"{check.replace('.warn_', '.')}: {n}" for check, n in out.facts.items() if n and check in soft and ".warn_" in check]
    for name, t in sound.items():
        if t.expected is None and not found[name]:
            out.errors.append(f"{name}: no rows")
        elif t.expected is not None and found[name] != t.expected:
            out.errors.append(f"{name}: {found[name]} rows, not {t.expected}")
    if len(sound) == len(tables):
        out.errors += invariants(found, *counts)
    return out


def ensure_columns(table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``table`` with the columns that it lacks."""
    return table.withColumns({n: c for n, c in defaults.items() if n not in table.columns})


def nulls_as_empty(table: DataFrame) -> DataFrame:
    """Null texts as empty ones, as they come from delimited files."""
    return table.withColumns({n: F.coalesce(n, F.lit("")) for n, kind in table.dtypes if kind == "string"})


def bound_outputs(expected: DataFrame, outputs: DataFrame, *identity: str) -> DataFrame:
    """Outputs held against what was asked for, by identity: (identity, outputs, binding).

    ``binding`` is bound, missing, unexpected or duplicate; order of the outputs never matters.
    """
    got = outputs.groupBy(*identity).agg(F.count("*").alias("outputs"))
    asked = expected.select(*identity).distinct().withColumn("asked", F.lit(True))
    rows = asked.join(got, list(identity), "full")
    kind = F.when(F.col("asked").isNull(), "unexpected").when(F.col("outputs").isNull(), "missing").when(F.col("outputs") > 1, "duplicate").otherwise("bound")
    return rows.select(*identity, F.coalesce("outputs", F.lit(0)).alias("outputs"), kind.alias("binding"))
