"""Masking strategies by name, and policies that say which columns get which."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import masking as m

Strategy = Callable[..., Column]
_registry: dict[str, Strategy] = {}
#: What a policy file may name; anything else has to be registered in code.
FILE_STRATEGIES = frozenset({"hash", "email", "phone", "redact"})


def register(name: str, strategy: Strategy | None = None):
    """Registers ``strategy(column, seed=..., **options)``; without one, a decorator."""
    if strategy is None:
        return lambda f: register(name, f) or f
    if name in _registry:
        raise ValueError(f"strategy already registered: {name}")
    _registry[name] = strategy
    return None


def unregister(name: str) -> bool:
    return _registry.pop(name, None) is not None


def strategies() -> list[str]:
    return sorted(_registry)


def get(name: str) -> Strategy:
    try:
        return _registry[name]
    except KeyError:
        raise KeyError(f"unknown masking strategy: {name}; known: {', '.join(strategies())}") from None


def custom(function: Callable, with_seed: bool = False) -> Strategy:
    """A strategy from a plain function of one value, nulls included; it runs in Arrow batches."""

    def strategy(c: Column, seed: object = 0, **_) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda v: function(v, seed) if with_seed else function(v))

        return run(c.cast("string"))

    return strategy


def _seedless(f):
    return lambda c, seed=0, **o: f(c, **o)


for _name, _f in {
    "email": m.mask_email, "phone": m.mask_phone, "hash": m.mask_hash, "salted_hash": m.mask_salted, "name": m.mask_name,
    "date": m.mask_date, "date_text": m.mask_date_text, "address": m.mask_address, "credit_card": m.mask_card, "ip_address": m.mask_ip,
    "ipv6_address": m.mask_ipv6, "retention": lambda c, seed=0, hashed=False, **o: m.mask_retention(c, seed=seed if hashed else None, **o), "redact": _seedless(m.mask_redact),
    "preserve": _seedless(m.mask_preserve), "text": _seedless(m.mask_text), "noise": _seedless(m.dp_noise), "url": _seedless(m.redact_url),
    "sync_email": _seedless(m.sync_email), "sync_name": _seedless(m.sync_name), "sync_redact": _seedless(m.sync_redact),
    "sync_hash": _seedless(m.sync_hash), "sync_phone": lambda c, seed=0, **o: m.sync_phone(c, seed),
}.items():
    register(_name, _f)


@dataclass(frozen=True)
class Rule:
    column: str
    strategy: str
    seed: object | None = None
    seed_env: str | None = None
    options: dict = field(default_factory=dict)

    def resolved_seed(self, default: object | None = None) -> object:
        """The environment's, the rule's, the policy's, 0: the first that there is, for every strategy."""
        if self.seed_env and os.environ.get(self.seed_env):
            return os.environ[self.seed_env]
        for s in (self.seed, default):
            if s is not None:
                return s
        return 0


@dataclass
class Policy:
    """``tables``: table -> rules.  Rules for columns that a table lacks are ignored; the last rule for a column wins."""

    tables: dict[str, list[Rule]]
    seed: object | None = None

    @classmethod
    def load(cls, data: dict) -> Policy:
        """From plain data, as read from a file: only ``FILE_STRATEGIES`` may be named."""
        tables = {}
        for t, rules in (data.get("tables") or {}).items():
            own = []
            for r in rules:
                if not isinstance(r, dict) or not {"column", "strategy"} <= r.keys():
                    raise ValueError(f"{t}: a rule needs column and strategy: {r!r}")
                if r["strategy"] not in FILE_STRATEGIES:
                    raise ValueError(f"{t}.{r['column']}: strategy not allowed in a file: {r['strategy']}")
                own.append(Rule(r["column"], r["strategy"], r.get("seed"), r.get("seed_env_var"), dict(r.get("options") or {})))
            tables[t] = own
        return cls(tables, data.get("seed"))

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        """One projection: masked columns in place, the others and the order as they are."""
        rules = {r.column: r for r in self.tables.get(name, ()) if r.column in df.columns}
        if not rules:
            return df
        mask = lambda r: get(r.strategy)(F.col(r.column), seed=r.resolved_seed(self.seed), **r.options).alias(r.column)
        return df.select(*[mask(rules[c]) if c in rules else F.col(c) for c in df.columns])


def sync_rules(rules: dict[str, str]) -> list[Rule]:
    """Column -> sync strategy (email, phone, name, redact, hash); an unknown one redacts."""
    known = {"email", "phone", "name", "redact", "hash"}
    return [Rule(c, f"sync_{s if s in known else 'redact'}") for c, s in rules.items()]
