"""Staged validation of seeds and schemas, statement lineage, tenant and idempotency lint, mutations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import audit, movement
from millrace.operators.schema import Schema, parse_ddl, statements, top_commas, without_comments
from millrace.sources import seeds

CRITICAL, ERROR, WARNING = "critical", "error", "warning"


@dataclass(frozen=True)
class Finding:
    level: int
    rule: str
    severity: str
    message: str


def seed_files(files: dict[str, str], schema_name: str | None = None) -> list[Finding]:
    """Level 1: the text of seed files; with ``schema_name``, INSERTs must go to that schema."""
    out = []
    for name, sql in sorted(files.items()):
        for rule, where in seeds.lint(sql):
            out.append(Finding(1, rule, ERROR if rule in ("bad_uuid", "union_columns") else WARNING, f"{name}: {where}"))
        for st in statements(sql):
            m = re.match(r"insert\s+into\s+([\w.\"]+)", without_comments(st).strip(), re.I)
            if m and schema_name and not m[1].replace('"', "").startswith(f"{schema_name}."):
                out.append(Finding(1, "schema_target", ERROR, f"{name}: {m[1]} isn't in {schema_name}"))
    return out


def key_pattern(s: Schema) -> list[Finding]:
    """Level 2: a final table tb_x has ``id``, ``pk_x`` and ``fk_y`` for every reference; a self-reference needs two passes."""
    out = []
    for t in s.tables:
        short = t.split(".")[-1]
        if not short.startswith("tb_"):
            continue
        entity, own = short[3:], {c["column"]: c for c in s.columns if c["table"] == t}
        for c in ("id", f"pk_{entity}"):
            if c not in own:
                out.append(Finding(2, "key_pattern", ERROR, f"{t}: no column {c}"))
        for r in s.constraints:
            if r["table"] == t and r["kind"] == "foreign key":
                m = re.match(r"\(\s*(\w+)", r["definition"])
                if m and not m[1].startswith("fk_"):
                    out.append(Finding(2, "foreign_key_name", WARNING, f"{t}: {m[1]} isn't named fk_…"))
                if r["target"] == t:
                    out.append(Finding(2, "self_reference", WARNING, f"{t}: resolve {m[1] if m else ''} after the load"))
    return out


def resolvers(sql: str) -> list[Finding]:
    """Level 3: a resolver's INSERT into fk_ columns joins a final table for each."""
    out = []
    for st in statements(sql):
        body = " ".join(without_comments(st).split())
        for m in re.finditer(r"insert\s+into\s+([\w.]+)\s*\(([^)]*)\)\s*select\b(.*?)(?:;|$)", body, re.I):
            fks = [c.strip() for c in m[2].split(",") if c.strip().lower().startswith("fk_")]
            joined = {t.lower() for t in re.findall(r"\bjoin\s+(?:[\w]+\.)?tb_(\w+)", m[3], re.I)}
            for c in fks:
                if c.lower()[3:] not in joined:
                    out.append(Finding(3, "unresolved_key", CRITICAL, f"{m[1]}: {c} without a join of tb_{c.lower()[3:]}"))
    return out


def runtime(spark: SparkSession, expected: dict[str, dict[str, str]]) -> list[Finding]:
    """Level 4: tables and column types as they are in the session."""
    out = []
    for t, columns in sorted(expected.items()):
        if not spark.catalog.tableExists(t):
            out.append(Finding(4, "missing_table", CRITICAL, t))
            continue
        live = {f.name.lower(): f.dataType.simpleString() for f in spark.table(t).schema.fields}
        for c, kind in columns.items():
            if live.get(c.lower(), "").lower() != kind.lower():
                out.append(Finding(4, "column_type", ERROR, f"{t}.{c}: {live.get(c.lower(), 'missing')}, not {kind}"))
    return out


def execution(df: DataFrame, name: str, keys: list[str] = [], not_null: list[str] = [], checks: dict[str, str] = {}, references: list[tuple[str, DataFrame, str]] = []) -> list[Finding]:
    """Level 5: violating rows of a loaded table, by rule: nulls and CHECKs in one pass, duplicates, references."""
    out = []
    if not_null or checks:
        for r in audit.violations(df, not_null, checks).filter("violations > 0").collect():
            out.append(Finding(5, r["rule"], ERROR, f"{name}: {r['violations']} rows"))
    if keys and (n := audit.duplicates(df, keys).count()):
        out.append(Finding(5, "duplicate_key", ERROR, f"{name}: {n} keys"))
    for column, parent, key in references:
        n = audit.fk_audit(df, column, parent, key, name).first()["violations"]
        if n:
            out.append(Finding(5, "orphans", ERROR, f"{name}.{column}: {n} rows"))
    return out


def run_levels(levels: list[Callable[[], list[Finding]]]) -> list[Finding]:
    """Level by level; the first with a critical finding is the last that runs."""
    out: list[Finding] = []
    for level in levels:
        found = level()
        out += found
        if any(f.severity == CRITICAL for f in found):
            break
    return out


def load_and_resolve(staged: DataFrame, final: DataFrame, natural: tuple[str, str], surrogate: str, as_: str) -> tuple[DataFrame, list[Finding]]:
    """Resolves a staged reference and reports what stayed unresolved."""
    out = movement.resolve_keys(staged, final, natural, surrogate, as_)
    n = out.filter(F.col(as_).isNull()).count()
    return out, [Finding(5, "unresolved", ERROR, f"{as_}: {n} rows")] if n else []


def signature_drift(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Live (name, arguments) that no source defines: overloads that were left behind."""
    return live.select("name", "arguments").join(expected.select("name", "arguments"), ["name", "arguments"], "left_anti")


def snapshot_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, change) of snapshots (kind, name, definition): added, removed, modified."""
    j = before.select("kind", "name", F.col("definition").alias("b")).join(after.select("kind", "name", F.col("definition").alias("a")), ["kind", "name"], "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return j.select("kind", "name", change.alias("change")).filter("change is not null")


def lineage(sql: str) -> list[tuple[int, str, str, str]]:
    """(statement, action, table, role) of INSERT, UPDATE, DELETE and their sources."""
    out = []
    for n, st in enumerate(statements(sql), 1):
        s = re.sub(r"'(?:[^']|'')*'", "''", " ".join(without_comments(st).split()))
        m = re.match(r"(insert)\s+into\s+([\w.]+)|(update)\s+(?:only\s+)?([\w.]+)|(delete)\s+from\s+(?:only\s+)?([\w.]+)", s, re.I)
        if not m:
            continue
        action = (m[1] or m[3] or m[5]).lower()
        target = m[2] or m[4] or m[6]
        out.append((n, action, target, "target"))
        for t in dict.fromkeys(re.findall(r"\b(?:from|join|using)\s+([a-z_][\w.]*)", s[m.end():], re.I)):
            out.append((n, action, t, "source"))
    return out


def missing_tables(sql: str, known: set[str]) -> list[str]:
    return sorted({t for _, _, t, _ in lineage(sql)} - known)


def tenant_isolation(sql: str, tenant_columns: dict[str, str]) -> list[tuple[str, str]]:
    """(table, column) of INSERTs into tenants' tables whose column list lacks the tenant's column."""
    out = []
    for st in statements(sql):
        m = re.match(r"\s*insert\s+into\s+([\w.]+)\s*\(([^)]*)\)", without_comments(st), re.I)
        if m and m[1] in tenant_columns and tenant_columns[m[1]] not in {c.strip() for c in top_commas(m[2])}:
            out.append((m[1], tenant_columns[m[1]]))
    return out


_IDEMPOTENT = (
    ("create_table", r"create\s+table\s+(?!if\s+not\s+exists)", "create table ", "CREATE TABLE IF NOT EXISTS "),
    ("create_index", r"create\s+(?:unique\s+)?index\s+(?!concurrently|if\s+not\s+exists)", r"index ", "INDEX IF NOT EXISTS "),
    ("create_sequence", r"create\s+sequence\s+(?!if\s+not\s+exists)", "create sequence ", "CREATE SEQUENCE IF NOT EXISTS "),
    ("create_schema", r"create\s+schema\s+(?!if\s+not\s+exists)", "create schema ", "CREATE SCHEMA IF NOT EXISTS "),
    ("create_view", r"create\s+view\s+", "create view ", "CREATE OR REPLACE VIEW "),
    ("create_function", r"create\s+function\s+", "create function ", "CREATE OR REPLACE FUNCTION "),
    ("drop_object", r"drop\s+(?:table|view|index|sequence|schema|type|function)\s+(?!if\s+exists|concurrently)", r"drop (table|view|index|sequence|schema|type|function) ", r"DROP \1 IF EXISTS "),
    ("add_column", r"alter\s+table\s+\S+\s+add\s+column\s+(?!if\s+not\s+exists)", "add column ", "ADD COLUMN IF NOT EXISTS "),
    ("drop_column", r"alter\s+table\s+\S+\s+drop\s+column\s+(?!if\s+exists)", "drop column ", "DROP COLUMN IF EXISTS "),
    ("insert", r"insert\s+into\s+(?!.*\bon\s+conflict\b)", None, None),
)


def idempotency(sql: str) -> list[tuple[str, str]]:
    """(pattern, statement) of statements that fail or repeat when run again."""
    out = []
    for st in statements(sql):
        s = " ".join(without_comments(st).split())
        out += [(name, s[:60]) for name, p, _, _ in _IDEMPOTENT if re.match(p, s, re.I)]
    return out


def make_idempotent(sql: str) -> str:
    done = []
    for st in statements(sql):
        s = " ".join(without_comments(st).split())
        for name, p, old, new in _IDEMPOTENT:
            if re.match(p, s, re.I):
                s = re.sub(old, new, s, count=1, flags=re.I) if old else s + " ON CONFLICT DO NOTHING"
        done.append(s + ";")
    return "\n".join(done) + "\n"


MUTATIONS = (
    ("drop_not_null", r"\s+not\s+null", ""), ("drop_unique", r"\s+unique\b", ""), ("drop_default", r"\s+default\s+\S+", ""), ("drop_reference", r"\s+references\s+\w+\s*(\([^)]*\))?", ""),
    ("narrow_integer", r"\bbigint\b", "integer"), ("flip_comparison", r"(?<![<>!=])>(?!=)", "<"), ("drop_where", r"\s+where\s+.*$", ""), ("drop_cascade", r"\s+on\s+delete\s+cascade", ""),
)


def mutants(sql: str) -> list[tuple[str, str]]:
    """(mutation, text) for every mutation that changes the text."""
    out = [(name, re.sub(p, new, sql, flags=re.I | re.M)) for name, p, new in MUTATIONS]
    return [(n, s) for n, s in out if s != sql]


def kill_rate(sql: str, passes: Callable[[str], bool]) -> tuple[float, list[str]]:
    """The share of mutants that the test rejects, and the names of those that survive."""
    all_ = mutants(sql)
    alive = [n for n, s in all_ if passes(s)]
    return (1 - len(alive) / len(all_) if all_ else 1.0), alive


def ddl_of(df: DataFrame, name: str) -> str:
    """A snapshot of a table's schema as DDL."""
    cols = ",\n".join(f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)
    return f"CREATE TABLE {name} (\n{cols}\n);\n"


def facts_of(ddl: str) -> list[tuple[str, str, str, bool]]:
    """(table_name, column_name, type, nullable) of DDL, as ``schema.drift`` takes them."""
    return [(c["table"], c["column"], c["type"], c["nullable"]) for c in parse_ddl(ddl).columns]
