"""Cut-off selection: the first n rows of every group without ranking the rest.

A cap of n rows on a group that may hold a third of all rows needs no window over
that group. Rows are counted per (group, bucket of the order), where a bucket is a
prefix of a text or a cell of a number's range; running sums over these counts find
the one bucket in which the n-th row lies. Only that boundary bucket is counted
again, by longer prefixes or finer cells, then by exact values and by the next
column of the order, until it holds few rows beyond the n-th. What lies above the
boundary is filtered out where it is read, and a window ranks the survivors: at most
``n + slack`` rows a group as long as the order tells rows apart. Mostly the first
counts suffice, so a cap costs one more read of its order columns.

Counts are combined in the map tasks, so a hot group costs as many rows as it has
buckets. Tables of bounds have a row per group that is larger than n; they are staged,
so the planner knows their size when it joins them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenor.operators.ranking import first_n
from tenor.staging import release, stage

#: Cells into which the range of a number is cut, twice if need be.
CELLS = 2048
#: Prefix lengths of a text: ids and hashes; dates by day, minute and second.
TEXT_STEPS = (3, 6)
DATE_STEPS = (10, 16, 19)


class Key(NamedTuple):
    """A column of the order. Nulls come last if told so, or if descending; NaN is the largest number."""

    column: Column | str
    descending: bool = False
    nulls_last: bool | None = None
    steps: tuple[int, ...] = TEXT_STEPS


class _Part(NamedTuple):
    """A key as two columns without nulls, both ascending: where nulls and NaN stand, then the value."""

    flag: Column
    value: Column
    text: bool
    steps: tuple[int, ...]


def _parts(df: DataFrame, keys) -> list[_Part]:
    out = []
    for k in (Key(k) if isinstance(k, (str, Column)) else k for k in keys):
        c = F.col(k.column) if isinstance(k.column, str) else k.column
        kind = df.select(c.alias("c")).schema["c"].dataType
        null = 3 if (k.descending if k.nulls_last is None else k.nulls_last) else 0
        if isinstance(kind, T.StringType):
            if k.descending:
                raise ValueError("texts are ordered ascending only")
            out.append(_Part(F.when(c.isNull(), null).otherwise(1), F.coalesce(c, F.lit("")), True, tuple(k.steps)))
            continue
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"no order by buckets for {kind.simpleString()}")
        if isinstance(kind, T.DecimalType):
            raise ValueError("cast decimals to double or long")
        odd = F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
        zero = F.lit(0).cast(kind)
        value = F.when(c.isNull() | odd, zero).otherwise(-c if k.descending else c)
        out.append(_Part(F.when(c.isNull(), null).when(odd, 1 if k.descending else 2).otherwise(2 if k.descending else 1), value, False, ()))
    return out


def _cell(x: Column, low: Column, high: Column) -> Column:
    """The cell of x between low and high: grows with x, also for infinite ends."""
    x, low, high = (c.cast("double") for c in (x, low, high))
    share = F.nanvl((x / 2 - low / 2) / F.greatest(high / 2 - low / 2, F.lit(5e-324)) * CELLS, F.lit(0.0))
    return F.when(x >= high, CELLS - 1).when(x <= low, 0).otherwise(F.greatest(F.least(F.floor(share), F.lit(CELLS - 2)), F.lit(0))).cast("int")


def _same(a: DataFrame, b: DataFrame, cols: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in cols], F.lit(True))


def _prefix(value: Column, length: Column) -> Column:
    """The first characters of a text; all of it where the length is 0."""
    return F.when(length > 0, F.substr(value, F.lit(1), length)).otherwise(value)


def bounds(df: DataFrame, group_cols, keys, n: int, slack: int | None = None) -> DataFrame | None:
    """A row per group of more than ``n + slack`` rows: its columns ``g0..`` and, key by key, the flag ``f0..`` and the value
    ``h0..`` up to which its rows are kept (null from where the rest needs no bound); of a text the first ``m0..``
    characters count. None if there is no such group.

    The first counts read the keys of ``df``; the rows of the boundary buckets are staged once, and later counts read
    those. Counts carry the ranges of the numbers still to come, so that numbers which are one value cost no count."""
    slack = max(n, 100) if slack is None else slack
    parts = _parts(df, keys)
    groups = [F.col(c) if isinstance(c, str) else c for c in group_cols]
    g = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[c.alias(x) for c, x in zip(groups, g)], *[c for i, p in enumerate(parts) for c in (p.flag.alias(f"k{i}"), p.value.alias(f"v{i}"))])
    kinds = [rows.schema[f"v{i}"].dataType for i in range(len(parts))]
    done, state, inside, seen, held = None, None, None, None, []

    def boundary(i: int, mine: DataFrame) -> Column:
        """The rows in the boundary bucket of each group, as far as the keys up to i say."""
        same = _same(rows, mine, [(x, f"s_{x}") for x in g])
        for j in range(i + 1):
            if f"f{j}" in state.columns:
                v, h = rows[f"v{j}"], mine[f"s_h{j}"]
                same = same & (rows[f"k{j}"] == mine[f"s_f{j}"]) & ((_prefix(v, mine[f"s_m{j}"]) == h) if parts[j].text else (v >= mine[f"s_l{j}"]) & (v <= h))
        return same

    def finish(rows: DataFrame) -> DataFrame:
        """Bounds as a table of their own: the planner then has their size, and no constants to reason about."""
        out = stage(rows, "cutoff-bounds")
        release(*held, *([inside] if inside is not None else []))
        return out

    for i, p in enumerate(parts):
        value, first = F.col(f"v{i}"), state is None
        if not p.text and not first and not seen[f"mixed{i}"]:
            state = state.withColumn(f"f{i}", F.col(f"a{i}"))
            levels = ["cell", "cell", "value"] if seen[f"spread{i}"] else []
        else:
            levels = [*p.steps, 0] if p.text else ["flag", "cell", "cell", "value"]
        for level in levels:
            if state is None:
                found, left = rows, F.lit(n).cast("long")
            else:
                mine = state.toDF(*[f"s_{c}" for c in state.columns])
                if inside is None:
                    rows = inside = stage(rows.join(mine, boundary(i, mine)).select(*rows.columns), "cutoff-inside")
                found, left = rows.join(mine, boundary(i, mine)), F.col("s_left")
            bucket = (F.lit(0) if level == "flag" else _cell(value, F.col(f"s_l{i}"), F.col(f"s_h{i}")) if level == "cell" else value if level in ("value", 0) else F.substring(value, 1, level))
            earlier = [c for j in range(i) for c in ((f"f{j}", f"h{j}", f"m{j}") if parts[j].text else (f"f{j}", f"l{j}", f"h{j}"))]
            later = [j for j in range(i + 1, len(parts)) if not parts[j].text]
            counts = (found.groupBy(*g, left.alias("left"), *[F.col(f"s_{c}").alias(c) for c in earlier], F.col(f"k{i}").alias(f"f{i}"), bucket.alias("bucket"))
                      .agg(F.count(F.lit(1)).alias("size"), *([] if p.text else [F.min(value).alias(f"l{i}"), F.max(value).alias(f"h{i}")]),
                           *[c for j in later for c in (F.min(f"k{j}").alias(f"a{j}"), F.max(f"k{j}").alias(f"b{j}"), F.min(f"v{j}").alias(f"l{j}"), F.max(f"v{j}").alias(f"h{j}"))]))
            run = Window.partitionBy(*g).orderBy(f"f{i}", "bucket")
            counts = counts.withColumn("upto", F.sum("size").over(run))
            if state is None:
                counts = counts.withColumn("total", F.sum("size").over(Window.partitionBy(*g))).filter(F.col("total") > n + slack).drop("total")
            if p.text:
                counts = counts.withColumns({f"h{i}": F.col("bucket"), f"m{i}": F.lit(level)})
            edge = (counts.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left")))
                    .withColumn("left", F.col("left") - F.col("upto") + F.col("size")).drop("upto", "bucket"))
            over = F.col("size") - F.col("left") > slack
            told = Observation()
            spread = {f"spread{j}": F.col(f"l{j}") != F.col(f"h{j}") for j in [*([] if p.text else [i]), *later]}
            mixed = {f"mixed{j}": F.col(f"a{j}") != F.col(f"b{j}") for j in later}
            edge = stage(edge.observe(told, F.count(F.lit(1)).alias("groups"), F.count_if(over).alias("open"), *[F.count_if(over & c).alias(x) for x, c in {**spread, **mixed}.items()]), "cutoff-edge")
            seen = told.get
            held.append(edge)
            ends = [F.col(c) for j in range(i + 1) for c in (f"f{j}", f"h{j}", *([f"m{j}"] if parts[j].text else []))]
            rest = [c for j in range(i + 1, len(parts)) for c in (F.lit(None).cast("int").alias(f"f{j}"), F.lit(None).cast(kinds[j]).alias(f"h{j}"), *([F.lit(None).cast("int").alias(f"m{j}")] if parts[j].text else []))]
            end = edge.filter(~over).select(*g, *ends, *rest)
            done = end if done is None else done.unionByName(end)
            if not seen["open"]:
                return finish(done) if not first or seen["groups"] else None
            state, first = edge.filter(over).drop("size"), False
            if not p.text and not seen[f"spread{i}"]:
                break
    # What is still open holds rows that are equal in the whole order: those are left to the window.
    end = state.select(*g, *[F.col(c) for j, p in enumerate(parts) for c in (f"f{j}", f"h{j}", *([f"m{j}"] if p.text else []))])
    return finish(done.unionByName(end))


def _within(df: DataFrame, group_cols, keys, n: int, slack: int | None) -> DataFrame:
    """``df`` up to the cut-off, with the columns ``__k0, __v0..`` of its order (columns of their own, so that the
    comparison and what is built on it share no expressions)."""
    parts = _parts(df, keys)
    keyed = df.select("*", *[c for i, p in enumerate(parts) for c in (p.flag.alias(f"__k{i}"), p.value.alias(f"__v{i}"))])
    cut = bounds(df, group_cols, keys, n, slack)
    if cut is None:
        return keyed
    groups = [F.col(c) if isinstance(c, str) else c for c in group_cols]
    cut = cut.toDF(*[f"__cut_{c}" for c in cut.columns])
    # Where a key has no bound the row's own value stands for it, so one comparison of structs says what is kept.
    own, most = [], []
    for i, p in enumerate(parts):
        flag, value, f, h = F.col(f"__k{i}"), F.col(f"__v{i}"), F.col(f"__cut_f{i}"), F.col(f"__cut_h{i}")
        value = _prefix(value, F.col(f"__cut_m{i}")) if p.text else value
        own += [flag, value]
        most += [F.coalesce(f, flag), F.when(f.isNull(), value).otherwise(h)]
    keep = F.struct(*[c.alias(f"c{j}") for j, c in enumerate(own)]) <= F.struct(*[c.alias(f"c{j}") for j, c in enumerate(most)])
    on = reduce(lambda x, y: x & y, [c.eqNullSafe(F.col(f"__cut_g{i}")) for i, c in enumerate(groups)], F.lit(True))
    return keyed.join(cut, on, "left").filter(keep).drop(*cut.columns)


def within_cutoff(df: DataFrame, group_cols, keys, n: int, slack: int | None = None) -> DataFrame:
    """``df`` without the rows that lie beyond their group's cut-off: the first n of each group, and few more."""
    return _within(df, group_cols, keys, n, slack).select(*df.columns)


def first_n_by_cutoff(df: DataFrame, group_cols, keys, n: int, rank_col: str | None = None, slack: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the order of ``keys`` (names, columns or :class:`Key`), which should be total;
    with ``rank_col`` the 1-based rank is a column. ``df`` is read twice: once its keys, once the rows that are kept."""
    few = _within(df, group_cols, keys, n, slack)
    order = [c for i in range(len(keys)) for c in (f"__k{i}", f"__v{i}")]
    return first_n(few, group_cols, order, n, rank_col=rank_col, salt_cols=[]).drop(*order)
