"""Schemas as facts: types, DDL, comparison, drift, dependencies."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIASES = {
    "int2": "smallint", "int": "integer", "int4": "integer", "int8": "bigint", "serial": "integer", "serial4": "integer", "bigserial": "bigint",
    "serial8": "bigint", "decimal": "numeric", "float4": "real", "float8": "double precision", "float": "double precision", "double": "double precision",
    "character varying": "varchar", "character": "char", "bpchar": "char", "string": "text", "bool": "boolean", "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamptz", "time without time zone": "time", "time with time zone": "time", "timetz": "time", "bit varying": "varbit",
}
SPARK_TYPES = {
    "smallint": "smallint", "integer": "int", "bigint": "bigint", "numeric": "decimal(38,18)", "real": "float", "double precision": "double", "varchar": "string",
    "char": "string", "text": "string", "boolean": "boolean", "date": "date", "time": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "uuid": "string", "json": "string", "jsonb": "string", "bytea": "binary", "inet": "string", "cidr": "string", "macaddr": "string", "macaddr8": "string",
    "money": "decimal(19,2)", "bit": "string", "varbit": "string", "xml": "string", "interval": "string", "tsvector": "string", "tsquery": "string",
}
_TYPE = re.compile(r"^\s*([a-z][a-z0-9_ ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*((?:with|without) time zone)?\s*((?:\[\s*\d*\s*\])*)\s*$", re.I)


@dataclass(frozen=True)
class SqlType:
    base: str
    length: int | None = None
    scale: int | None = None
    dims: int = 0

    @classmethod
    def parse(cls, text: str) -> SqlType:
        m = _TYPE.match(text)
        if not m:
            return cls("unknown")
        base = " ".join(m[1].lower().split()) + (f" {m[4].lower()}" if m[4] else "")
        base = ALIASES.get(base, base)
        return cls(base, int(m[2]) if m[2] else None, int(m[3]) if m[3] else None, (m[5] or "").count("["))

    def __str__(self) -> str:
        n = "" if self.length is None else f"({self.length})" if self.scale is None else f"({self.length},{self.scale})"
        return self.base + n + "[]" * self.dims

    def spark(self) -> str:
        t = SPARK_TYPES.get(self.base, "string")
        if self.base == "numeric" and self.length:
            t = f"decimal({min(self.length, 38)},{self.scale or 0})"
        if self.base.endswith("range"):
            inner = {"int4range": "int", "int8range": "bigint", "numrange": "decimal(38,18)", "daterange": "date"}.get(self.base, "timestamp")
            t = f"struct<lower:{inner},upper:{inner},bounds:string>"
        for _ in range(self.dims):
            t = f"array<{t}>"
        return t


_INTS = ["smallint", "integer", "bigint"]
_FLOATS = ["real", "double precision"]
_TEXTS = ["char", "varchar", "text"]


def direction(old: str, new: str) -> str:
    """identical, widening, narrowing, lateral or unknown: what a change of type does to values."""
    a, b = SqlType.parse(old), SqlType.parse(new)
    if "unknown" in (a.base, b.base):
        return "unknown"
    if a.dims != b.dims:
        return "lateral"
    if a.base == b.base:
        if (a.length, a.scale) == (b.length, b.scale):
            return "identical"
        if a.base == "numeric":
            if b.length is None:
                return "widening"
            if a.length is None:
                return "narrowing"
            whole = lambda t: t.length - (t.scale or 0)
            wider = whole(b) >= whole(a) and (b.scale or 0) >= (a.scale or 0)
            return "widening" if wider else "narrowing"
        if a.length is None or b.length is None:
            return "widening" if b.length is None else "narrowing"
        return "widening" if b.length > a.length else "narrowing"
    for order in (_INTS, _FLOATS):
        if a.base in order and b.base in order:
            return "widening" if order.index(b.base) > order.index(a.base) else "narrowing"
    if a.base in _INTS and b.base in ("numeric", *_FLOATS):
        return "widening"
    if b.base in _INTS and a.base in ("numeric", *_FLOATS):
        return "narrowing"
    if {a.base, b.base} <= {"numeric", *_FLOATS}:
        return "lateral"
    if a.base in _TEXTS and b.base in _TEXTS:
        if b.base == "text":
            return "widening"
        if a.base == "text":
            return "narrowing"
        if a.length is not None and b.length is not None and b.length < a.length:
            return "narrowing"
        return "widening" if b.length is None or a.length is not None else "narrowing"
    if b.base == "text":
        return "widening"
    if a.base == "text":
        return "narrowing"
    if {a.base, b.base} == {"timestamp", "timestamptz"}:
        return "lateral"
    if a.base == "date" and b.base in ("timestamp", "timestamptz"):
        return "widening"
    if b.base == "date" and a.base in ("timestamp", "timestamptz"):
        return "narrowing"
    if {a.base, b.base} == {"json", "jsonb"}:
        return "lateral"
    return "lateral"


def needs_rewrite(old: str, new: str) -> bool:
    """Whether stored values change form: not where nothing changes, and not for wider text."""
    d, a, b = direction(old, new), SqlType.parse(old), SqlType.parse(new)
    if d == "identical":
        return False
    return not (d == "widening" and a.base in ("varchar", "text") and b.base in ("varchar", "text"))


def canonical_type(t: str) -> str:
    return str(SqlType.parse(t))


# statements


def statements(sql: str) -> list[str]:
    """Splits at ; outside quotes, dollar quotes and comments."""
    out, i, start, n = [], 0, 0, len(sql)
    while i < n:
        two = sql[i : i + 2]
        if two == "--":
            i = sql.find("\n", i)
            i = n if i < 0 else i
        elif two == "/*":
            depth, i = 1, i + 2
            while i < n and depth:
                depth += {"/*": 1, "*/": -1}.get(sql[i : i + 2], 0)
                i += 2 if sql[i : i + 2] in ("/*", "*/") else 1
        elif sql[i] in "'\"":
            q, i = sql[i], i + 1
            while i < n and not (sql[i] == q and sql[i + 1 : i + 2] != q):
                i += 2 if sql[i] == q else 1
            i += 1
        elif sql[i] == "$" and (m := re.compile(r"\$(?:[A-Za-z_]\w*)?\$").match(sql, i)):
            end = sql.find(m[0], m.end())
            i = n if end < 0 else end + len(m[0])
        elif sql[i] == ";":
            out.append(sql[start:i])
            start = i = i + 1
        else:
            i += 1
    return [s.strip() for s in [*out, sql[start:]] if s.strip()]


def without_comments(sql: str) -> str:
    return re.sub(r"('(?:[^']|'')*'|\"[^\"]*\")|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S)


def unclosed_comment(sql: str) -> bool:
    """Whether a block comment is open at the end."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*", "", sql)
    depth = 0
    for m in re.finditer(r"/\*|\*/", bare):
        depth = depth + 1 if m[0] == "/*" else max(0, depth - 1)
    return depth > 0


def top_commas(text: str) -> list[str]:
    """Parts between commas outside parentheses and quotes."""
    out, depth, quoted, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quoted:
            quoted = "" if c == quoted else quoted
        elif c in "'\"":
            quoted = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [p for p in [*out, text[last:].strip()] if p]


@dataclass
class Schema:
    """Facts of a set of DDL statements."""

    columns: list[dict] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    enums: list[dict] = field(default_factory=list)
    sequences: list[str] = field(default_factory=list)

    @property
    def tables(self) -> list[str]:
        return sorted({c["table"] for c in self.columns})

    def references(self) -> list[tuple[str, str]]:
        return sorted({(c["table"], c["target"]) for c in self.constraints if c["kind"] == "foreign key"})


_NAME = r'(?:"[^"]+"|[\w]+)(?:\.(?:"[^"]+"|[\w]+))?'
_STOP = r"\s+(?:not\s+null|null|default|primary|unique|references|check|constraint|generated|collate)\b"


def _plain(name: str) -> str:
    name = name.replace('"', "")
    return name.removeprefix("public.")


def parse_ddl(sql: str) -> Schema:
    """CREATE TABLE, INDEX, TYPE … AS ENUM, SEQUENCE and ALTER TABLE … ADD CONSTRAINT; other statements are passed over."""
    s = Schema()
    for st in statements(without_comments(sql)):
        if m := re.match(rf"create\s+(?:unlogged\s+|temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*\((.*)\)", st, re.I | re.S):
            for part in top_commas(m[2]):
                _table_part(s, _plain(m[1]), part)
        elif m := re.match(rf"create\s+(unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({_NAME})\s+on\s+({_NAME})[^(]*\((.*)\)", st, re.I | re.S):
            s.indexes.append({"name": _plain(m[2]), "table": _plain(m[3]), "columns": ", ".join(top_commas(m[4])), "unique": bool(m[1])})
        elif m := re.match(rf"create\s+type\s+({_NAME})\s+as\s+enum\s*\((.*)\)", st, re.I | re.S):
            s.enums.append({"name": _plain(m[1]), "values": re.findall(r"'((?:[^']|'')*)'", m[2])})
        elif m := re.match(rf"create\s+sequence\s+(?:if\s+not\s+exists\s+)?({_NAME})", st, re.I):
            s.sequences.append(_plain(m[1]))
        elif m := re.match(rf"alter\s+table\s+(?:only\s+)?({_NAME})\s+add\s+(.*)", st, re.I | re.S):
            body = re.sub(r"^column\s+", "", m[2], flags=re.I)
            _table_part(s, _plain(m[1]), body)
    return s


def _table_part(s: Schema, table: str, part: str) -> None:
    m = re.match(rf"(?:constraint\s+({_NAME})\s+)?(primary\s+key|unique|foreign\s+key|check|exclude)\b\s*(.*)", part, re.I | re.S)
    if m:
        kind = " ".join(m[2].lower().split())
        row = {"table": table, "name": _plain(m[1] or ""), "kind": kind, "definition": " ".join(m[3].split()), "target": ""}
        if kind == "foreign key":
            t = re.search(rf"references\s+({_NAME})", m[3], re.I)
            row["target"] = _plain(t[1]) if t else ""
        s.constraints.append(row)
        return
    m = re.match(r'("[^"]+"|\w+)\s+(.*)', part, re.S)
    if not m:
        return
    kind = re.split(_STOP, m[2], maxsplit=1, flags=re.I)[0].strip()
    rest = m[2][len(kind):]
    d = re.search(r"\bdefault\s+(.+?)(?=\s+(?:not\s+null|null|primary|unique|references|check|constraint)\b|$)", rest, re.I | re.S)
    primary = bool(re.search(r"\bprimary\s+key\b", rest, re.I))
    name = m[1].strip('"')
    s.columns.append({
        "table": table, "column": name, "type": canonical_type(kind), "nullable": not primary and not re.search(r"\bnot\s+null\b", rest, re.I),
        "default": d[1].strip() if d else "", "primary": primary})
    if t := re.search(rf"\breferences\s+({_NAME})", rest, re.I):
        s.constraints.append({"table": table, "name": "", "kind": "foreign key", "definition": f"({name}) {rest[t.start():].strip()}", "target": _plain(t[1])})
    if re.search(r"\bunique\b", rest, re.I):
        s.constraints.append({"table": table, "name": "", "kind": "unique", "definition": f"({name})", "target": ""})


def similarity(a: str, b: str) -> float:
    """Of two names: 1 if equal, 0.6 for a common first or last token, else shared tokens, else shared characters."""
    if a == b:
        return 1.0
    x, y = a.lower().split("_"), b.lower().split("_")
    if x[0] == y[0] or x[-1] == y[-1]:
        return 0.6
    t = len(set(x) & set(y)) / len(set(x) | set(y))
    return t or len(set(a) & set(b)) / max(1, len(set(a) | set(b)))


def similarity_column(a: Column, b: Column) -> Column:
    """The same as an expression."""
    x, y = F.split(F.lower(a), "_"), F.split(F.lower(b), "_")
    share = lambda p, q: F.size(F.array_intersect(p, q)) / F.greatest(F.size(F.array_union(p, q)), F.lit(1))
    chars = lambda c: F.split(c, "")
    return (
        F.when(a == b, 1.0)
        .when((F.element_at(x, 1) == F.element_at(y, 1)) | (F.element_at(x, -1) == F.element_at(y, -1)), 0.6)
        .when(share(x, y) > 0, share(x, y))
        .otherwise(share(chars(a), chars(b)))
    )


def renames(old: Iterable[str], new: Iterable[str], above: float = 0.5) -> list[tuple[str, str]]:
    """Pairs of the most similar names, best first, each name once; ties by name."""
    scored = sorted(((-similarity(a, b), a, b) for a in old for b in new), key=lambda t: t)
    used_a, used_b, out = set(), set(), []
    for s, a, b in scored:
        if -s > above and a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b))
    return sorted(out)


def diff(old: Schema, new: Schema) -> list[dict]:
    """Changes from one schema to another, in a fixed order.  Columns of a renamed table are compared, too."""
    out: list[dict] = []

    def add(change, table="", column="", before="", after=""):
        out.append({"change": change, "table": table, "column": column, "old": str(before), "new": str(after)})

    gone, fresh = set(old.tables) - set(new.tables), set(new.tables) - set(old.tables)
    moved = dict(renames(gone, fresh))
    for a, b in moved.items():
        add("rename_table", a, "", a, b)
    for t in sorted(gone - set(moved)):
        add("drop_table", t)
    for t in sorted(fresh - set(moved.values())):
        add("add_table", t)
    of = lambda s, t: {c["column"]: c for c in s.columns if c["table"] == t}
    for t in sorted((set(old.tables) & set(new.tables)) | set(moved)):
        a, b = of(old, t), of(new, moved.get(t, t))
        lost, got = set(a) - set(b), set(b) - set(a)
        same = dict(renames(lost, got))
        for x, y in same.items():
            add("rename_column", t, x, x, y)
        for x in sorted(lost - set(same)):
            add("drop_column", t, x, a[x]["type"])
        for y in sorted(got - set(same.values())):
            add("add_column", t, y, "", b[y]["type"])
        for x in sorted(set(a) & set(b)) + sorted(same):
            p, q = a[x], b[same.get(x, x)]
            for key, change in (("type", "alter_type"), ("nullable", "alter_nullable"), ("default", "alter_default"), ("primary", "alter_primary_key")):
                if p[key] != q[key]:
                    add(change, t, x, p[key], q[key])
    for kind, label in (("foreign key", "foreign_key"), ("check", "check"), ("unique", "unique"), ("primary key", "primary_key")):
        key = lambda s: {(c["table"], c["name"], c["definition"]) for c in s.constraints if c["kind"] == kind}  # noqa: E731, B023
        for t, n, d in sorted(key(old) - key(new)):
            add(f"drop_{label}", t, n, d)
        for t, n, d in sorted(key(new) - key(old)):
            add(f"add_{label}", t, n, "", d)
    key = lambda s: {i["name"]: i for i in s.indexes}
    for n in sorted(key(old).keys() - key(new).keys()):
        add("drop_index", key(old)[n]["table"], n)
    for n in sorted(key(new).keys() - key(old).keys()):
        add("add_index", key(new)[n]["table"], n)
    enum = lambda s: {e["name"]: e["values"] for e in s.enums}
    for n in sorted(enum(old).keys() - enum(new).keys()):
        add("drop_enum", n)
    for n in sorted(enum(new).keys() - enum(old).keys()):
        add("add_enum", n)
    for n in sorted(enum(old).keys() & enum(new).keys()):
        for v in [v for v in enum(old)[n] if v not in enum(new)[n]]:
            add("drop_enum_value", n, "", v)
        for v in [v for v in enum(new)[n] if v not in enum(old)[n]]:
            add("add_enum_value", n, "", "", v)
    for n in sorted(set(old.sequences) - set(new.sequences)):
        add("drop_sequence", n)
    for n in sorted(set(new.sequences) - set(old.sequences)):
        add("add_sequence", n)
    return out


def to_sql(c: dict) -> tuple[str, str]:
    """(up, down) statements of a change; an empty down can't be undone without the data."""
    t, col, a, b = c["table"], c["column"], c["old"], c["new"]
    alter = f"ALTER TABLE {t}"
    forms = {
        "rename_table": (f"{alter} RENAME TO {b}", f"ALTER TABLE {b} RENAME TO {a}"),
        "drop_table": (f"DROP TABLE {t}", ""),
        "add_column": (f"{alter} ADD COLUMN {col} {b}", f"{alter} DROP COLUMN {col}"),
        "drop_column": (f"{alter} DROP COLUMN {col}", f"{alter} ADD COLUMN {col} {a}"),
        "rename_column": (f"{alter} RENAME COLUMN {a} TO {b}", f"{alter} RENAME COLUMN {b} TO {a}"),
        "alter_type": (f"{alter} ALTER COLUMN {col} TYPE {b}", f"{alter} ALTER COLUMN {col} TYPE {a}"),
        "alter_nullable": tuple(f"{alter} ALTER COLUMN {col} {'DROP' if v == 'True' else 'SET'} NOT NULL" for v in (b, a)),
        "alter_default": tuple(f"{alter} ALTER COLUMN {col} " + (f"SET DEFAULT {v}" if v else "DROP DEFAULT") for v in (b, a)),
        "add_enum_value": (f"ALTER TYPE {t} ADD VALUE '{b}'", ""),
        "add_sequence": (f"CREATE SEQUENCE {t}", f"DROP SEQUENCE {t}"),
        "drop_sequence": (f"DROP SEQUENCE {t}", f"CREATE SEQUENCE {t}"),
    }
    return forms.get(c["change"], (f"-- {c['change']} {t} {col}".rstrip(), ""))


def set_difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key only in ``new`` (added) or only in ``old`` (dropped)."""
    side = lambda a, b, label: a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(label).alias("change"))
    return side(new, old, "added").unionByName(side(old, new, "dropped"))


def drift(expected: DataFrame, live: DataFrame) -> DataFrame:
    """(table_name, column_name, kind, severity) from facts (table_name, column_name, type, nullable).

    A missing table is reported once, not for its columns.  Types are compared by their ``canonical_type``."""
    known = {r[0]: canonical_type(r[0]) for r in expected.select("type").union(live.select("type")).distinct().collect() if r[0]}
    if known:  # the types that schemas name are few
        alike = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        expected, live = (d.withColumn("type", F.coalesce(alike[F.col("type")], "type")) for d in (expected, live))
    tables = lambda d: d.select("table_name").distinct()
    t = tables(expected).withColumn("e", F.lit(1)).join(tables(live).withColumn("l", F.lit(1)), "table_name", "full_outer")
    kind = F.when(F.col("l").isNull(), "missing_table").when(F.col("e").isNull(), "extra_table")
    by_table = t.select("table_name", F.lit(None).cast("string").alias("column_name"), kind.alias("kind")).filter("kind is not null")
    both = t.filter("e is not null and l is not null").select("table_name")
    e = expected.join(both, "table_name", "left_semi").select("table_name", "column_name", F.col("type").alias("et"), F.col("nullable").alias("en"))
    live = live.join(both, "table_name", "left_semi").select("table_name", "column_name", F.col("type").alias("lt"), F.col("nullable").alias("ln"))
    c = e.join(live, ["table_name", "column_name"], "full_outer")
    kinds = F.array_compact(F.array(
        F.when(F.col("lt").isNull(), F.lit("missing_column")), F.when(F.col("et").isNull(), F.lit("extra_column")),
        F.when(F.col("et") != F.col("lt"), F.lit("type_mismatch")), F.when(F.col("en") != F.col("ln"), F.lit("nullable_mismatch"))))
    by_column = c.select("table_name", "column_name", F.explode(kinds).alias("kind"))
    severity = F.when(F.col("kind").isin("missing_table", "missing_column", "type_mismatch"), "critical").when(F.col("kind") == "nullable_mismatch", "warning").otherwise("info")
    return by_table.unionByName(by_column).withColumn("severity", severity)


def topological(edges: Iterable[tuple[str, str]], nodes: Iterable[str] = ()) -> list[list[str]]:
    """Levels of child -> parent edges, parents first, names sorted; what is on cycles comes last in one level."""
    need: dict[str, set] = {n: set() for n in nodes}
    for c, p in edges:
        need.setdefault(p, set())
        need.setdefault(c, set())
        if c != p:
            need[c].add(p)
    out = []
    while need:
        free = sorted(n for n, ps in need.items() if not ps)
        if not free:
            return [*out, sorted(need)]
        out.append(free)
        need = {n: ps - set(free) for n, ps in need.items() if n not in free}
    return out


def reachable(edges: Iterable[tuple[str, str]], start: str) -> list[str]:
    to: dict[str, set] = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    seen, todo = set(), [start]
    while todo:
        for n in to.get(todo.pop(), ()):
            if n not in seen and n != start:
                seen.add(n)
                todo.append(n)
    return sorted(seen)


def schema_hash(files: dict[str, str]) -> str:
    h = hashlib.sha256()
    for path in sorted(files):
        for part in (path, files[path]):
            h.update(part.encode())
            h.update(b"\0")
    return h.hexdigest()


def normalized(ddl: str) -> str:
    return " ".join(without_comments(ddl).lower().split())


def detect_baseline(current: str, history: dict[str, str], least: float = 0.85) -> tuple[str, float] | None:
    """The recorded version whose DDL is that of ``current``, or most like it if at least ``least`` alike."""
    now, best = normalized(current), None
    for version in sorted(history):
        then = normalized(history[version])
        r = 1.0 if then == now else difflib.SequenceMatcher(None, then, now, autojunk=False).ratio()
        if r >= least and (best is None or r >= best[1]):
            best = (version, r)
    return best


def body_drift(expected: DataFrame, live: DataFrame) -> DataFrame:
    """(name, kind) of views or functions (name, body) that are missing, extra or differ but for blanks and case."""
    n = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    j = expected.select("name", n(F.col("body")).alias("e")).join(live.select("name", n(F.col("body")).alias("l")), "name", "full_outer")
    kind = F.when(F.col("l").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e") != F.col("l"), "changed")
    return j.select("name", kind.alias("kind")).filter("kind is not null")


def extract_foreign_keys(sql: str) -> tuple[str, list[str]]:
    """DDL without its foreign keys, and the statements that add them after a load."""
    kept, later = [], []
    for st in statements(sql):
        m = re.match(rf"(create\s+table\s+(?:if\s+not\s+exists\s+)?({_NAME})\s*\()(.*)(\).*)", st, re.I | re.S)
        if not m:
            kept.append(st)
            continue
        parts = []
        for p in top_commas(m[3]):
            if re.match(r"(constraint\s+\S+\s+)?foreign\s+key", p, re.I):
                later.append(f"ALTER TABLE {m[2]} ADD {p}")
            elif r := re.search(rf"\s+references\s+{_NAME}\s*(\([^)]*\))?(\s+on\s+(delete|update)\s+(cascade|restrict|set\s+null|set\s+default|no\s+action))*", p, re.I):
                col = p.split()[0]
                later.append(f"ALTER TABLE {m[2]} ADD FOREIGN KEY ({col}){r[0]}")
                parts.append(p[: r.start()] + p[r.end():])
            else:
                parts.append(p)
        kept.append(m[1] + ", ".join(parts) + m[4])
    return ";\n".join(kept) + ";", later


def lint(s: Schema) -> list[tuple[str, str, str]]:
    """(rule, table, message): tables without a primary key, names that aren't snake case, references without an index."""
    out = []
    keyed = {c["table"] for c in s.columns if c["primary"]} | {c["table"] for c in s.constraints if c["kind"] == "primary key"}
    indexed = {(i["table"], i["columns"].split(",")[0].strip()) for i in s.indexes} | {(c["table"], c["column"]) for c in s.columns if c["primary"]}
    snake = re.compile(r"^[a-z][a-z0-9_]*$")
    for t in s.tables:
        if t not in keyed:
            out.append(("primary_key", t, "no primary key"))
        if not snake.match(t.split(".")[-1]):
            out.append(("naming", t, "not in snake case"))
    for c in s.columns:
        if not snake.match(c["column"]):
            out.append(("naming", c["table"], f"{c['column']}: not in snake case"))
    for c in s.constraints:
        m = re.match(r"\(\s*(\w+)", c["definition"])
        if c["kind"] == "foreign key" and m and (c["table"], m[1]) not in indexed:
            out.append(("foreign_key_index", c["table"], f"{m[1]}: no index"))
    return sorted(out)
