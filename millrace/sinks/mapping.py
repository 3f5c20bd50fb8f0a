"""Target layout, audit values and row policies applied before a write."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT = "__audit__:"


def _audit_value(token: str, df: DataFrame, run_id: str, user: str, job: str | None) -> Column:
    values: dict[str, Callable[[], Column]] = {
        "current_timestamp": F.current_timestamp,
        "current_date": F.current_date,
        "current_time": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"),
        "job_name": lambda: F.lit(job or df.sparkSession.conf.get("spark.app.name")),
        "run_id": lambda: F.lit(run_id),
        "user_name": lambda: F.lit(user),
    }
    if token not in values:
        raise ValueError(f"unknown audit token {token!r}")
    return values[token]()


def map_columns(df: DataFrame, mapping: Sequence[Mapping[str, str]] | str, *, run_id: str = "", user: str = "system", job: str | None = None) -> DataFrame:
    """Ordered ``{src, tgt}`` entries (or JSON text of them) as one projection. A source such as
    ``__audit__:run_id`` fills in run information. Incomplete entries are skipped; none means as is."""
    entries = json.loads(mapping) if isinstance(mapping, str) and mapping.strip() else (mapping or [])
    out = []
    for e in entries:
        src, tgt = (e.get("src") or "").strip(), (e.get("tgt") or "").strip()
        if src and tgt:
            value = _audit_value(src[len(AUDIT):], df, run_id, user, job) if src.startswith(AUDIT) else F.col(src)
            out.append(value.alias(tgt))
    return df.select(*out) if out else df


def auto_map(source: Sequence[str], target: Sequence[str], by: str = "name", *, case_sensitive: bool = False) -> list[dict[str, str]]:
    """Build a mapping from two column lists, by name or by position."""
    if by == "position":
        return [{"src": s, "tgt": t} for s, t in zip(source, target)]
    key = (lambda s: s) if case_sensitive else str.lower
    have = {key(s): s for s in source}
    return [{"src": have[key(t)], "tgt": t} for t in target if key(t) in have]


def null_policy(df: DataFrame, policy: str, *, keys: Sequence[str] = (), defaults: Mapping[str, object] | None = None) -> DataFrame:
    """KEEP | REJECT rows with NULL keys | DEFAULT values for NULLs."""
    if policy == "REJECT":
        return df.dropna(subset=list(keys))
    if policy == "DEFAULT":
        return df.fillna(dict(defaults or {}))
    return df
