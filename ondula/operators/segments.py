"""Ordered access to series of any length.

A window over ``partitionBy(series)`` puts a whole series in one task.
:func:`lay_out` bounds that: it measures the series, and when some exceed
``max_rows`` it sets them apart and range-partitions them by (keys, order
column) into *segments*, marked in the ``_seg`` column; where segments are
short, a task holds several. Frames without that column hold only series that
fit a task.

The helpers below (:func:`neighbours`, :func:`moving_window`,
:func:`with_stats`, :func:`with_row_index`) accept either kind of frame. On a
segmented frame they compute a small table with one row per segment (what lies
just outside it, or the totals of its series), materialise only that table, and
join it on (keys, segment): no join key is hot, the big side keeps its
partitioning, and chained operators don't multiply the plan.

Expressions are SQL text: one call builds a whole expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.session import cut, parallelism

SEG = "_seg"
MAX_ROWS = 4_000_000
# Rows that one task of a layout sorts where segments are shorter than that.
TASK_ROWS = 250_000

Chain = Callable[[DataFrame], DataFrame]


def quoted(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def segmented(df: DataFrame) -> bool:
    return SEG in df.columns


def group_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """Columns that bound a window: the keys, and the segment if there is one."""
    return [*keys, SEG] if segmented(df) else list(keys)


def window_sql(keys: list[str], order: str | None = None, frame: str = "") -> str:
    ordering = f"ORDER BY `{order}`" if order else ""
    return f"OVER (PARTITION BY {quoted(keys)} {ordering} {frame})"


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by series into a fixed number of tasks.

    Resampling and sweeps multiply rows behind this shuffle, so its size must
    not decide how many tasks there are; a number given here is kept by AQE.
    """
    return df.repartition(parallelism(df.sparkSession), *group_columns(df, keys))


def spread_segments(long: DataFrame, keys: list[str]) -> DataFrame:
    """The same for the segments of :func:`lay_out`, into as many tasks as keep
    a task at about what one held there, however many segments there are."""
    tasks = max(parallelism(long.sparkSession), 4 * long.rdd.getNumPartitions())
    return long.repartition(tasks, *group_columns(long, keys))


def lay_out(
    df: DataFrame,
    keys: list[str],
    order: str = "x",
    max_rows: int = MAX_ROWS,
    prepare: Chain | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Split into the series that fit a task and, if there are any, the others.

    Only the key columns are read to measure, and not even those when the whole
    table is small. ``prepare`` is a step that only shortens series; it is run
    on the long ones before they are segmented, and is left to do on the short
    ones. Segments are materialised by a reliable checkpoint, because a range
    partitioning is sampled and must not differ between two evaluations.
    """
    if df.count() <= max_rows:
        return df, None
    sizes = df.groupBy(*keys).agg(F.expr("count(1) AS _rows"))
    long_series = sizes.where(f"_rows > {max_rows}")
    found = long_series.agg(F.expr("sum(_rows) AS rows")).first()["rows"]
    if not found:
        return df, None
    long_keys = cut(long_series.select(*keys))
    long_rows = df.join(long_keys, keys, "left_semi")
    if prepare is not None:
        long_rows = prepare(long_rows)
    parts = -(-found // max(max_rows, TASK_ROWS)) + 1
    ranged = long_rows.repartitionByRange(parts, *keys, order)
    if max_rows >= TASK_ROWS:
        segment = F.spark_partition_id().cast("bigint")
    else:  # ids count the sorted rows of a task, and leave gaps between tasks
        ranged = ranged.sortWithinPartitions(*keys, order)
        segment = F.expr(f"monotonically_increasing_id() DIV {max_rows}")
    segments = cut(ranged.withColumn(SEG, segment))
    return df.join(long_keys, keys, "left_anti"), segments


def by_length(
    df: DataFrame,
    keys: list[str],
    chain: Chain,
    order: str = "x",
    max_rows: int = MAX_ROWS,
    prepare: Chain | None = None,
) -> DataFrame:
    """Run a chain of operators over short and over segmented series.

    Short series are shuffled once, by key; ``prepare`` and the chain follow
    without a further shuffle by series.
    """
    short, long = lay_out(df, keys, order, max_rows, prepare)
    short = spread(short, keys)
    out = chain(short if prepare is None else prepare(short))
    if long is None:
        return out
    return out.drop(SEG).unionByName(chain(spread_segments(long, keys)).drop(SEG))


def surroundings(
    df: DataFrame, keys: list[str], columns: list[str], depth: int, order: str
) -> DataFrame:
    """Per segment: up to ``depth`` rows just before and just after it.

    Every segment in the table has at least one row, so the ``depth`` segments
    to either side always hold enough.
    """
    group = [*keys, SEG]
    row = f"struct({quoted([order, *[c for c in columns if c != order]])})"
    if depth == 1:
        ends = df.groupBy(*group).agg(
            F.expr(f"array(min({row})) AS _head"), F.expr(f"array(max({row})) AS _tail")
        )
    else:
        inside = f"PARTITION BY {quoted(group)} ORDER BY `{order}`"
        ends = (
            df.selectExpr(
                "*",
                f"row_number() OVER ({inside} ASC) AS _up",
                f"row_number() OVER ({inside} DESC) AS _down",
            )
            .where(f"_up <= {depth} OR _down <= {depth}")
            .groupBy(*group)
            .agg(
                F.expr(f"sort_array(collect_list(IF(_up <= {depth}, {row}, NULL))) AS _head"),
                F.expr(f"sort_array(collect_list(IF(_down <= {depth}, {row}, NULL))) AS _tail"),
            )
        )
    along = f"PARTITION BY {quoted(keys)} ORDER BY _head[0].`{order}` ROWS BETWEEN"
    return cut(
        ends.selectExpr(
            *group,
            f"flatten(collect_list(_tail) OVER ({along} {depth} PRECEDING AND 1 PRECEDING))"
            " AS _before",
            f"flatten(collect_list(_head) OVER ({along} 1 FOLLOWING AND {depth} FOLLOWING))"
            " AS _after",
        ).selectExpr(
            *group,
            f"slice(_before, greatest(size(_before) - {depth}, 0) + 1, {depth}) AS _before",
            f"slice(_after, 1, {depth}) AS _after",
        )
    )


def neighbours(
    df: DataFrame, keys: list[str], columns: list[str], ahead: int = 1, order: str = "x"
) -> DataFrame:
    """Attach ``prev_<c>``, ``next_<c>`` and, when ``ahead`` is 2, ``next2_<c>``
    for each of the (non-null) ``columns``; NULL beyond the ends of a series."""
    over = window_sql(group_columns(df, keys), order)
    added = {}
    for c in columns:
        added[f"prev_{c}"] = f"lag(`{c}`) {over}"
        added[f"next_{c}"] = f"lead(`{c}`) {over}"
        if ahead == 2:
            added[f"next2_{c}"] = f"lead(`{c}`, 2) {over}"
    out = df.selectExpr("*", *[f"{e} AS `{n}`" for n, e in added.items()])
    if not segmented(df):
        return out
    outside = surroundings(df, keys, columns, ahead, order)
    filled = {}
    for c in columns:
        filled[f"prev_{c}"] = f"coalesce(prev_{c}, get(_before, size(_before) - 1).`{c}`)"
        filled[f"next_{c}"] = f"coalesce(next_{c}, get(_after, 0).`{c}`)"
        if ahead == 2:
            filled[f"next2_{c}"] = (
                f"coalesce(next2_{c}, get(_after, IF(next_{c} IS NULL, 1, 0)).`{c}`)"
            )
    return out.join(outside, [*keys, SEG], "left").selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"{filled[n]} AS `{n}`" for n in added]
    )


def moving_window(
    df: DataFrame, keys: list[str], column: str, half: int, name: str, order: str = "x"
) -> DataFrame:
    """Collect ``column`` over ``half`` rows to either side, cut off at the ends."""
    group = group_columns(df, keys)

    def over(start: str, end: str) -> str:
        return window_sql(group, order, f"ROWS BETWEEN {start} AND {end}")

    around = over(f"{half} PRECEDING", f"{half} FOLLOWING")
    inside = f"collect_list(`{column}`) {around} AS `{name}`"
    if not segmented(df) or half == 0:
        return df.selectExpr("*", inside)
    outside = surroundings(df, keys, [column], half, order)
    before = over(f"{half} PRECEDING", "1 PRECEDING")
    after = over("1 FOLLOWING", f"{half} FOLLOWING")
    return (
        df.selectExpr(
            "*",
            inside,
            f"CAST({half} - count(1) {before} AS int) AS _lacks_before",
            f"CAST({half} - count(1) {after} AS int) AS _lacks_after",
        )
        .join(outside, [*keys, SEG], "left")
        .selectExpr(
            *[f"`{c}`" for c in df.columns],
            f"""concat(
                slice(transform(_before, r -> r.`{column}`),
                      greatest(size(_before) - _lacks_before, 0) + 1, _lacks_before),
                `{name}`,
                slice(transform(_after, r -> r.`{column}`), 1, _lacks_after)) AS `{name}`""",
        )
    )


def with_stats(df: DataFrame, keys: list[str], **stats: tuple[str, str]) -> DataFrame:
    """Attach series-wide aggregates to every row.

    ``stats`` maps a new column to ``(kind, expression)``, where kind is one of
    min, max, sum, count and mean. Unsegmented series use a window, which
    shares the partitioning of the ordered windows around it.
    """
    kept = [f"`{c}`" for c in df.columns]
    if not segmented(df):
        over = window_sql(keys)
        function = {"mean": "avg"}
        added = [f"{function.get(k, k)}({e}) {over} AS `{n}`" for n, (k, e) in stats.items()]
        return df.selectExpr(*kept, *added)
    over = window_sql(keys)
    partial, total = [], []
    for name, (kind, expr) in stats.items():
        if kind == "mean":
            partial += [f"sum({expr}) AS `{name}`", f"count({expr}) AS `{name}_rows`"]
            total.append(f"sum(`{name}`) {over} / sum(`{name}_rows`) {over} AS `{name}`")
        else:
            again = "sum" if kind == "count" else kind
            partial.append(f"{kind}({expr}) AS `{name}`")
            total.append(f"{again}(`{name}`) {over} AS `{name}`")
    per_segment = df.groupBy(*keys, SEG).agg(*[F.expr(p) for p in partial])
    totals = cut(per_segment.selectExpr(*keys, SEG, *total))
    return df.join(totals, [*keys, SEG], "left").selectExpr(*kept, *[f"`{n}`" for n in stats])


def with_row_index(df: DataFrame, keys: list[str], name: str = "i", order: str = "x") -> DataFrame:
    """0-based position of each row within its series."""
    position = f"row_number() {window_sql(group_columns(df, keys), order)} - 1"
    out = df.selectExpr("*", f"CAST({position} AS bigint) AS `{name}`")
    if not segmented(df):
        return out
    before = window_sql(keys, "_first", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    offsets = cut(
        df.groupBy(*keys, SEG)
        .agg(F.expr("count(1) AS _rows"), F.expr(f"min(`{order}`) AS _first"))
        .selectExpr(*keys, SEG, f"coalesce(sum(_rows) {before}, 0) AS _offset")
    )
    return out.join(offsets, [*keys, SEG], "left").selectExpr(
        *[f"`{c}`" for c in df.columns], f"`{name}` + _offset AS `{name}`"
    )


def explode_range(df: DataFrame, name: str, lo: str, hi: str, block: int = 4096) -> DataFrame:
    """One row per integer in ``lo .. hi-1``; rows with an empty range vanish.

    With a ``block`` there are two explodes, so no row builds a long array.
    """
    bounds = df.selectExpr("*", f"CAST({lo} AS bigint) AS _lo", f"CAST({hi} AS bigint) AS _hi")
    if block:
        numbers = f"sequence(_from, least(_from + {block - 1}, _hi - 1))"
        bounds = bounds.selectExpr(
            "*", f"explode(IF(_lo < _hi, sequence(_lo, _hi - 1, {block}L), NULL)) AS _from"
        )
    else:
        numbers = "IF(_lo < _hi, sequence(_lo, _hi - 1), NULL)"
    return bounds.selectExpr("*", f"explode({numbers}) AS `{name}`").drop("_lo", "_hi", "_from")
