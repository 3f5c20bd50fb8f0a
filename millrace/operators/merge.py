"""Upserts, slowly changing dimensions, change flags, surrogate keys and audit columns.

All take a target and a source DataFrame and return the new target. Keys are unique on the
source side by the time of the join (checked or reduced), so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.aggregates import latest_per_key
from millrace.operators.sizing import unique_by_plan
from millrace.operators.windows import WindowFn, window


def unique_source(source: DataFrame, keys: Sequence[str], latest_by: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the latest by ``latest_by``, or an error at run time when a key repeats. A source whose plan
    shows that its keys are unique is not checked again.

    A NULL business key is an error too: it would match nothing, and be inserted again on every run.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    named = F.lit(f"NULL in a business key ({', '.join(keys)})")
    # The row id keeps the optimizer from moving the check below the source's own filters, where it would see rows they drop.
    no_null = F.when(missing, F.raise_error(named)).otherwise(F.monotonically_increasing_id() >= 0)
    if latest_by:
        return latest_per_key(source, keys, latest_by).select(*source.columns).filter(no_null)
    if unique_by_plan(source, keys):
        return source.filter(no_null)
    # Numbering by key uses the same partitioning and order as the join that follows: no extra
    # shuffle or sort, and no buffering of a repeated key.
    spec = W.partitionBy(*keys).orderBy(*keys)
    message = F.concat(F.lit("several source rows for key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    single = F.when(missing, F.raise_error(named)).when(F.col("__rn") > 1, F.raise_error(message)).otherwise(F.lit(True))
    return source.withColumn("__rn", F.row_number().over(spec)).filter(single).drop("__rn")


def _changed(columns: Sequence[str], a: str, b: str) -> Column:
    """NULL-safe "any column differs"."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(False))


def _pack(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__{name}_{k}") for k in keys], F.struct(*df.columns).alias(name))


def _full(target: DataFrame, source: DataFrame, keys: Sequence[str], how: str = "full", null_safe: bool = False) -> DataFrame:
    """Full outer join of both rows packed as structs ``t`` and ``s``."""
    t, s = _pack(target, keys, "t"), _pack(source, keys, "s")
    same = [(t[f"__t_{k}"], s[f"__s_{k}"]) for k in keys]
    cond = reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in same])
    return t.join(s, cond, how).select("t", "s")


def change_hash(columns: Sequence[str]) -> Column:
    """Fingerprint that tells NULL from empty text and ('a', NULL) from (NULL, 'a')."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


# ------------------------------------------------------------------ change flags


def cdc_flags(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, alias: str = "change_type") -> DataFrame:
    """INSERT / UPDATE / DELETE / UNCHANGED per key, with the new values (old ones for deletes)."""
    compare = list(compare or [c for c in new.columns if c not in keys])
    j = _full(old, new, keys, null_safe=True)
    flag = (F.when(F.col("t").isNull(), "INSERT").when(F.col("s").isNull(), "DELETE")
            .when(_changed(compare, "t", "s"), "UPDATE").otherwise("UNCHANGED"))
    out = F.when(F.col("s").isNull(), F.struct(*[F.col(f"t.{c}").alias(c) for c in new.columns])).otherwise(F.col("s"))
    return j.select(flag.alias(alias), out.alias("r")).select("r.*", alias)


# ------------------------------------------------------------------ type 1


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], *, update_columns: Sequence[str] | None = None,
           skip_unchanged: bool = False, delete_unmatched: bool = False, soft_delete: str | None = None,
           stamp: tuple[str, object] | None = None, latest_by: Sequence[str] | None = None) -> DataFrame:
    """Matched rows take the listed (or all) source columns, unmatched source rows are inserted.

    ``skip_unchanged`` leaves equal rows and their ``stamp`` alone; ``delete_unmatched`` drops target
    rows missing from the source, ``soft_delete`` names a boolean target column to set instead.
    ``stamp`` = (column, value) is written on inserted and updated rows.
    """
    source = unique_source(source, keys, latest_by)
    updates = set(update_columns or [c for c in source.columns if c not in keys])
    # Flat rows: the join sorts and copies them faster than rows packed as structs.
    t = target.select(*[F.col(c).alias(f"__t_{c}") for c in target.columns], F.lit(True).alias("__in_t"))
    s = source.select(*[F.col(c).alias(f"__s_{c}") for c in source.columns if c in target.columns])
    j = t.join(s, reduce(lambda a, b: a & b, [t[f"__t_{k}"] == s[f"__s_{k}"] for k in keys]), "right" if delete_unmatched else "full")
    only_s, only_t = F.col("__in_t").isNull(), F.col(f"__s_{keys[0]}").isNull()      # no key of the source is NULL
    differs = reduce(lambda a, b: a | b, [~F.col(f"__t_{c}").eqNullSafe(F.col(f"__s_{c}")) for c in updates if c in target.columns], F.lit(False))
    write = ~only_t & (only_s | (differs if skip_unchanged else F.lit(True)))
    fields = []
    for c in target.columns:
        value = F.col(f"__t_{c}")
        if stamp and c == stamp[0]:
            value = F.when(write, stamp[1]).otherwise(value)
        elif c == soft_delete:
            value = F.when(only_t, F.lit(True)).otherwise(F.lit(False))
        elif c in source.columns:
            take = only_s | (write if c in updates else F.lit(False))
            value = F.when(take, F.col(f"__s_{c}")).otherwise(value)
        fields.append(value.alias(c))
    return j.select(*fields)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], *, op: str, order_by: Sequence[str]) -> DataFrame:
    """Apply I/U/D change rows: the last change of each key decides."""
    last = latest_per_key(changes, keys, order_by)
    j = _full(target, last, keys)
    keep = F.col("s").isNull() | (F.col(f"s.{op}") != "D")
    row = [F.when(F.col("s").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in target.columns]
    return j.filter(keep).select(*row)


def debezium_rows(events: DataFrame, schema, value: str = "value") -> DataFrame:
    """Flatten change envelopes {before, after, op, ts_ms, source.lsn} into columns plus
    _cdc_op (I/U/D), _cdc_ts and _cdc_lsn."""
    envelope = f"before struct<{schema}>, after struct<{schema}>, op string, ts_ms bigint, source struct<lsn: bigint>"
    e = events.select(F.from_json(value, envelope).alias("e"))
    op = F.col("e.op")
    row = F.when(op == "d", F.col("e.before")).otherwise(F.col("e.after"))
    code = F.when(op == "d", "D").when(op == "u", "U").otherwise("I")
    return e.select(row.alias("r"), code.alias("_cdc_op"), F.col("e.ts_ms").alias("_cdc_ts"),
                    F.col("e.source.lsn").alias("_cdc_lsn")).select("r.*", "_cdc_op", "_cdc_ts", "_cdc_lsn")


# ------------------------------------------------------------------ type 2


def scd2(target: DataFrame, source: DataFrame, *, keys: Sequence[str], tracked: Sequence[str], effective: str = "effective_date",
         end: str = "end_date", current: str = "is_current", as_of, high_date: str = "9999-12-31", close_deleted: bool = False,
         type1: Sequence[str] = (), surrogate: str | None = None, latest_by: Sequence[str] | None = None) -> DataFrame:
    """Version the tracked columns.

    Only current rows meet the source; closed history is passed through without a shuffle. One
    full join classifies every key, and a changed key yields two rows (closed and new) in the same
    pass. Changes are found by NULL-safe comparison. ``as_of`` is the load date: a second run with
    the same source changes nothing, and a key whose current version starts after ``as_of`` (a
    late record) is left alone. ``type1`` columns are overwritten in place on the current row.
    """
    date = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    high = F.lit(high_date).cast("date")
    source = unique_source(source, keys, latest_by)
    history = target.filter(~F.col(current))
    j = _full(target.filter(F.col(current)), source, keys)
    only_s, only_t = F.col("t").isNull(), F.col("s").isNull()
    late = F.col(f"t.{effective}") > date
    changed = ~only_s & ~only_t & ~late & _changed(tracked, "t", "s")

    def version(origin: str, start: Column, stop: Column, flag: Column) -> Column:
        fields = []
        for f in target.schema:
            c = f.name
            if c == effective:
                v = start
            elif c == end:
                v = stop
            elif c == current:
                v = flag
            elif c == surrogate:
                v = F.col(f"t.{c}") if origin == "t" else F.xxhash64(*[F.col(f"s.{k}") for k in keys], date)
            elif origin == "s":
                v = F.col(f"s.{c}") if c in source.columns else F.lit(None)
            elif c in type1:
                v = F.when(only_t, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
            else:
                v = F.col(f"t.{c}")
            fields.append(v.cast(f.dataType).alias(c))
        return F.struct(*fields)

    keep = version("t", F.col(f"t.{effective}"), F.col(f"t.{end}"), F.lit(True))
    closed = version("t", F.col(f"t.{effective}"), date, F.lit(False))
    fresh = version("s", date, high, F.lit(True))
    rows = F.when(only_s, F.array(fresh)).when(changed, F.array(closed, fresh))
    rows = rows.when(only_t & F.lit(close_deleted), F.array(closed)).otherwise(F.array(keep))
    return history.unionByName(j.select(F.explode(rows).alias("r")).select("r.*"))


# ------------------------------------------------------------------ types 3, 4 and 6


def scd3(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Mapping[str, str]) -> DataFrame:
    """``tracked`` maps a column to the column that keeps its previous value."""
    source = unique_source(source, keys)
    j = _full(target, source, keys)
    only_s, only_t = F.col("t").isNull(), F.col("s").isNull()
    previous = {p: c for c, p in tracked.items()}
    fields = []
    for c in target.columns:
        if c in previous:
            base = previous[c]
            moved = ~only_s & ~only_t & ~F.col(f"t.{base}").eqNullSafe(F.col(f"s.{base}"))
            v = F.when(moved, F.col(f"t.{base}")).otherwise(F.col(f"t.{c}"))
        elif c in source.columns:
            v = F.when(only_t, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        else:
            v = F.col(f"t.{c}")
        fields.append(v.alias(c))
    return j.select(*fields)


def scd4(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], *, as_of, changed_on: str = "changed_on") -> tuple[DataFrame, DataFrame]:
    """(new current table, history rows to append): the replaced rows with the change date."""
    source = unique_source(source, keys)
    j = _full(target, source, keys, "inner").filter(_changed(tracked, "t", "s"))
    history = j.select("t.*").withColumn(changed_on, F.lit(as_of).cast("date"))
    return upsert(target, source, keys), history


def scd6(target: DataFrame, source: DataFrame, *, keys: Sequence[str], tracked: Sequence[str], carry: Mapping[str, str], **kw) -> DataFrame:
    """Type 2 versions that also carry the latest value of some columns on every version.
    ``carry`` maps a tracked column to its "current value" column. Keys without a current version
    keep what they have."""
    versions = scd2(target, source.withColumns({now: F.col(c) for c, now in carry.items()}), keys=keys, tracked=tracked, **kw)
    flag = kw.get("current", "is_current")
    latest = versions.filter(F.col(flag)).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(True).alias("__known"),
                                                 *[F.col(c).alias(f"__l_{c}") for c in carry])
    cond = reduce(lambda a, b: a & b, [versions[k] == latest[f"__k_{k}"] for k in keys])
    joined = versions.join(latest, cond, "left")
    joined = joined.withColumns({now: F.when(F.col("__known"), F.col(f"__l_{c}")).otherwise(F.col(now)) for c, now in carry.items()})
    return joined.select(*versions.columns)


# ------------------------------------------------------------------ keys and audit


def surrogate_key(df: DataFrame, alias: str, strategy: str = "monotonic", *, order_by=None, partition_by: Sequence[str] = (),
                  columns: Sequence[str] = (), start: int = 1, increment: int = 1, separator: str = "|", **kw) -> DataFrame:
    """monotonic | uuid | row_number | md5 | sha256.

    row_number is gap-free: the sort is cut into ranges whose sizes give each range its offset, so
    it needs no single-task sort. Hash keys mark NULLs so that ('a', NULL) and (NULL, 'a') differ.
    """
    if strategy == "monotonic" or (strategy == "row_number" and order_by is None):
        return df.withColumn(alias, F.monotonically_increasing_id() * increment + start)
    if strategy == "uuid":
        return df.withColumn(alias, F.uuid())
    if strategy == "row_number":
        numbered = window(df, [WindowFn("row_number", alias)], partition_by=partition_by, order_by=order_by, **kw)
        return numbered.withColumn(alias, (F.col(alias).cast("long") - 1) * increment + start)
    text = F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.withColumn(alias, F.md5(text) if strategy == "md5" else F.sha2(text, 256))


def add_audit_columns(df: DataFrame, *, run_id: str, user: str, load_ts: str = "_load_ts", run_id_column: str = "_run_id",
                      user_column: str = "_run_user", record_hash: str | None = None, source: tuple[str, str] | None = None,
                      run_date: str | None = None) -> DataFrame:
    """Load timestamp, run id and user; a blank column name skips that column."""
    added: dict[str, Column] = {}
    if record_hash:
        added[record_hash] = change_hash(df.columns)
    if load_ts:
        added[load_ts] = F.current_timestamp()
    if run_id_column:
        added[run_id_column] = F.lit(run_id)
    if user_column:
        added[user_column] = F.lit(user)
    if run_date:
        added[run_date] = F.current_date()
    if source:
        added[source[0]] = F.lit(source[1])
    return df.withColumns(added)
