"""Data changes as transforms: each gives the table as it is afterwards, or the rows that RETURNING would give."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(Exception):
    """A row breaks a constraint."""


@dataclass
class Change:
    """The table afterwards, and the rows that were inserted or updated (as they are now) or deleted."""

    table: DataFrame
    returning: DataFrame


@dataclass(frozen=True)
class Constraints:
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: Mapping[str, Column] = field(default_factory=dict)
    #: (own columns, parent table, its columns)
    foreign: tuple[tuple[tuple[str, ...], DataFrame, tuple[str, ...]], ...] = ()

    def broken(self, table: DataFrame) -> DataFrame:
        """One row for each kind of breach that occurs, with how many rows do: name, n."""
        found = []
        whole = [F.count_if(F.col(c).isNull()).alias(f"NOT NULL {c}") for c in self.not_null]
        whole += [F.count_if(~F.coalesce(c.cast("boolean"), F.lit(True))).alias(f"CHECK {name}") for name, c in self.checks.items()]
        if whole:
            row = table.agg(*whole)
            names = ", ".join(f"'{c}', `{c}`" for c in row.columns)
            found.append(row.selectExpr(f"stack({len(row.columns)}, {names}) AS (name, n)"))
        for columns in self.unique:
            # A key with a NULL equals no other.
            keyed = table.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
            found.append(keyed.where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("UNIQUE " + ", ".join(columns)).alias("name"), "n"))
        for own, parent, theirs in self.foreign:
            found.append(orphans(table, own, parent, theirs).agg(F.count(F.lit(1)).alias("n")).select(F.lit("FOREIGN KEY " + ", ".join(own)).alias("name"), "n"))
        if not found:
            return table.sparkSession.createDataFrame([], "name string, n bigint")
        out = found[0]
        for other in found[1:]:
            out = out.union(other)
        return out.where("n > 0")

    def check(self, table: DataFrame) -> DataFrame:
        """The table, if it keeps all constraints."""
        rows = self.broken(table).collect()  # at most one for each constraint
        if rows:
            raise ConstraintError("; ".join(f"{r['name']} constraint failed ({r['n']} rows)" for r in rows))
        return table


def orphans(child: DataFrame, own: tuple[str, ...], parent: DataFrame, theirs: tuple[str, ...]) -> DataFrame:
    """Child rows whose key has no parent; a key with a NULL needs none."""
    keys = parent.select([F.col(c).alias(f"__{i}") for i, c in enumerate(theirs)]).distinct()
    match = F.lit(True)
    for i, c in enumerate(own):
        match = match & (child[c] == keys[f"__{i}"])
    return child.where(" AND ".join(f"`{c}` IS NOT NULL" for c in own)).join(keys, match, "left_anti")


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> Change:
    """Rows by name; columns that they lack take their default, else NULL."""
    defaults = defaults or {}
    whole = rows.select([F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)).cast(t).alias(c) for c, t in table.dtypes])
    whole = whole.select([F.col(c).cast(t).alias(c) for c, t in table.dtypes])
    return Change(table.unionByName(whole), whole)


def _last(rows: DataFrame, key: list[str], order: list[Column], first: bool) -> DataFrame:
    """Of rows with the same key, the first or last in order, found by a hash aggregate. A key with a NULL equals no
    other: such rows all stay."""
    whole = " AND ".join(f"`{c}` IS NOT NULL" for c in key)
    packed = F.struct(*rows.columns)
    pick = (F.min_by if first else F.max_by)(packed, F.struct(*order))
    return rows.where(whole).groupBy(*key).agg(pick.alias("__row")).select("__row.*").unionByName(rows.where(f"NOT ({whole})"))


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> Change:
    """Rows whose key is new; of several with one key the first in order."""
    new = _last(rows, key, order, True).join(table, key, "left_anti").select(table.columns)
    return Change(table.unionByName(new), new)


def insert_or_replace(table: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> Change:
    """Rows take the place of those with the same key; of several with one key the last in order."""
    new = _last(rows, key, order, False).select(table.columns)
    return Change(table.join(new, key, "left_anti").select(table.columns).unionByName(new), new)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], sets: Mapping[str, Column] | None, where: Column | None = None) -> Change:
    """ON CONFLICT (key) DO UPDATE SET sets WHERE where, or DO NOTHING with no sets. In expressions the table is ``t``
    and the new row ``excluded``; rows have one row for each key. One full outer join on the key."""
    t, excluded = table.withColumn("__t", F.lit(True)).alias("t"), rows.withColumn("__x", F.lit(True)).alias("excluded")
    match = F.lit(True)
    for k in key:
        match = match & (F.col(f"t.{k}") == F.col(f"excluded.{k}"))
    both = t.join(excluded, match, "full_outer")
    hit = F.col("__t").isNotNull() & F.col("__x").isNotNull()
    change = hit & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)) if sets else F.lit(False)
    kind = F.when(F.col("__t").isNull(), "insert").when(change, "update").otherwise("keep")
    columns = []
    for c, typ in table.dtypes:
        new = (sets or {}).get(c)
        old = F.col(f"t.{c}")
        value = F.when(F.col("__t").isNull(), F.col(f"excluded.{c}") if c in rows.columns else F.lit(None))
        value = value.when(change, new if new is not None else old).otherwise(old)
        columns.append(value.cast(typ).alias(c))
    out = both.select(*columns, kind.alias("__kind"))
    return Change(out.drop("__kind"), out.where("__kind <> 'keep'").drop("__kind"))


def insert_default(table: DataFrame, defaults: Mapping[str, Column] | None = None) -> Change:
    """INSERT ... DEFAULT VALUES: one row of defaults."""
    return insert(table, table.sparkSession.range(1).select(F.lit(1).alias("__one")), defaults)


#: What a statement may do with a row that breaks a constraint.
CONFLICTS = ("ABORT", "FAIL", "ROLLBACK", "IGNORE", "REPLACE")


def insert_checked(table: DataFrame, rows: DataFrame, limits: Constraints, conflict: str = "ABORT", order: list[Column] | None = None, defaults: Mapping[str, Column] | None = None) -> Change:
    """INSERT OR ...: rows that keep the constraints; rows are taken in the given order.

    ABORT, FAIL and ROLLBACK raise ConstraintError and leave the table as it is: a statement is one step here, so that FAIL
    keeps no earlier rows and ROLLBACK is the caller's. IGNORE leaves out the rows that break NOT NULL, CHECK or UNIQUE. REPLACE lets
    a row take the place of those with its unique keys, and a NULL take the default where there is one. Foreign keys always raise.
    """
    if conflict not in CONFLICTS:
        raise ValueError(f"no such conflict action: {conflict}")
    order = order or [F.col(c) for c in table.columns]
    new = insert(table.limit(0), rows, defaults).returning
    if conflict == "REPLACE":
        filled = {c: F.coalesce(F.col(c), (defaults or {}).get(c, F.lit(None)).cast(t)) for c, t in table.dtypes if c in limits.not_null}
        new = new.select([filled.get(c, F.col(c)).alias(c) for c in table.columns])
        old = table
        for key in limits.unique:
            change = insert_or_replace(old, new, list(key), order)
            new = change.returning
            old = old.join(new.select(*key), list(key), "left_anti").select(table.columns)
        done = Change(old.unionByName(new), new)
    elif conflict == "IGNORE":
        kept = F.lit(True)
        for c in limits.not_null:
            kept = kept & F.col(c).isNotNull()
        for check in limits.checks.values():
            kept = kept & F.coalesce(check.cast("boolean"), F.lit(True))
        new = new.where(kept)
        for key in limits.unique:
            new = insert_or_ignore(table, new, list(key), order).returning
        done = Change(table.unionByName(new), new)
    else:
        done = Change(table.unionByName(new), new)
    return Change(limits.check(done.table), done.returning)


def update_checked(table: DataFrame, sets: Mapping[str, Column], limits: Constraints, key: list[str], where: Column | None = None, conflict: str = "ABORT") -> Change:
    """UPDATE OR ...: key tells the table's rows apart. IGNORE leaves a row as it was where its new values break NOT NULL or
    CHECK, or a unique key that another row has; REPLACE removes the other rows; the rest raise."""
    if conflict not in CONFLICTS:
        raise ValueError(f"no such conflict action: {conflict}")
    done = update(table, sets, where)
    if conflict in ("IGNORE", "REPLACE"):
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        marked = table.withColumn("__hit", hit)
        new = marked.where("__hit").select([(sets[c] if c in sets else F.col(c)).cast(t).alias(c) for c, t in table.dtypes] + [F.col(k).alias(f"__old_{k}") for k in key])
        untouched = marked.where("NOT __hit").drop("__hit")
        if conflict == "REPLACE":
            for unique in limits.unique:
                new = _last(new, list(unique), [F.col(f"__old_{k}") for k in key], False)
                untouched = untouched.join(new.select(*unique), list(unique), "left_anti").select(table.columns)
            changed = new.select(table.columns)
            done = Change(untouched.unionByName(changed), changed)
        else:
            good = F.lit(True)
            for c in limits.not_null:
                good = good & F.col(c).isNotNull()
            for check in limits.checks.values():
                good = good & F.coalesce(check.cast("boolean"), F.lit(True))
            new = new.where(good)
            for unique in limits.unique:
                if not set(unique) & set(sets):
                    continue
                # Of several rows that would get one key the first gets it, unless a row has it already.
                new = _last(new, list(unique), [F.col(f"__old_{k}") for k in key], True)
                new = new.join(table.select(*unique), list(unique), "left_anti")
            changed, gone = new.select(table.columns), new.select([F.col(f"__old_{k}").alias(k) for k in key])
            done = Change(table.join(gone, key, "left_anti").select(table.columns).unionByName(changed), changed)
    return Change(limits.check(done.table), done.returning)


def update(table: DataFrame, sets: Mapping[str, Column], where: Column | None = None) -> Change:
    """All expressions see the old row; a WHERE that is NULL leaves the row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    marked = table.withColumn("__hit", hit)
    out = marked.select([F.when(F.col("__hit"), sets[c]).otherwise(F.col(c)).cast(t).alias(c) if c in sets else F.col(c) for c, t in table.dtypes] + [F.col("__hit")])
    return Change(out.drop("__hit"), out.where("__hit").drop("__hit"))


def update_from(table: DataFrame, source: DataFrame, on: Column, sets: Mapping[str, Column], order: list[Column], key: list[str]) -> Change:
    """UPDATE ... FROM: the first matching source row in order sets the row; key tells the table's rows apart."""
    joined = table.alias("t").join(source.alias("s"), on)
    values = joined.groupBy(*[F.col(f"t.{k}").alias(f"__{k}") for k in key]).agg(F.min_by(F.struct(*[v.cast(dict(table.dtypes)[c]).alias(c) for c, v in sets.items()]), F.struct(*order)).alias("__new"))
    match = F.lit(True)
    for k in key:
        match = match & table[k].eqNullSafe(values[f"__{k}"])
    both = table.join(values, match, "left").withColumn("__hit", F.col("__new").isNotNull())
    out = both.select([F.when(F.col("__hit"), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in table.columns] + [F.col("__hit")])
    return Change(out.drop("__hit"), out.where("__hit").drop("__hit"))


def delete(table: DataFrame, where: Column | None = None) -> Change:
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return Change(table.where(~hit), table.where(hit))


def chosen(table: DataFrame, order: list[Column], limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """The rows that ORDER BY ... LIMIT ... picks for a change: a top-k, then a join on nothing but the table's key."""
    some = table.where(where) if where is not None else table
    return limited(some.orderBy(*order), limit, offset)


def limited(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET: a negative limit is none, a negative offset is zero."""
    rest = df.offset(offset) if offset > 0 else df
    return rest.limit(limit) if limit >= 0 else rest


def delete_limited(table: DataFrame, key: list[str], order: list[Column], limit: int, where: Column | None = None) -> Change:
    gone = chosen(table, order, limit, 0, where)
    return Change(table.join(gone.select(*key), key, "left_anti").select(table.columns), gone)


def update_limited(table: DataFrame, key: list[str], sets: Mapping[str, Column], order: list[Column], limit: int) -> Change:
    some = chosen(table, order, limit).select(*key).withColumn("__pick", F.lit(True))
    marked = table.join(some, key, "left").select(*[table[c] for c in table.columns], F.col("__pick").isNotNull().alias("__pick"))
    done = update(marked, sets, F.col("__pick"))
    return Change(done.table.drop("__pick"), done.returning.drop("__pick"))

