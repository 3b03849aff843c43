"""Queries over text lines, settings, tags, checks, catalog and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.core import (
    EH,
    Y6,
    register,
    sweep_sql,
)
from checks.views import KEYS, events, hourly, rounded, six_sql, table, unique
from ondula.functions.names import natural_key, sanitise_name
from ondula.functions.values import format_length, is_power_of_two, parse_length
from ondula.operators import quality
from ondula.operators.columns import (
    extract_from_cells,
    extract_pairs,
    locate_pairs,
    rename_columns,
)
from ondula.operators.series import dedup_mean
from ondula.operators.sweep import sweep_domains
from ondula.plans.catalog import catalog, tag_values
from ondula.plans.settings import FIELDS, resolve_settings, unmatched_overrides, work_list
from ondula.sinks.stages import pack_pairs, unpack_pairs
from ondula.sources import text

# -- text lines -------------------------------------------------------------

_HEADERS = ["time (h)\tvalue", "", " user \tevent id\tV 37"]
_DIRTY = "CASE event_id % 50 WHEN 7 THEN '' WHEN 8 THEN '{t}1{t}2' WHEN 9 THEN '{t}1.5f' ELSE '{t}1e3' END"
_CLEAN = "'{t}1e3'"


def _line(tail: str, tab: str, join: str) -> str:
    value = "CAST(CAST(floor(value) AS bigint) AS {s}) || '.25'"
    number = "CAST({c} AS {s})"
    kind = "string" if join == "spark" else "varchar"
    parts = [
        f"{number.format(c='event_id', s=kind)} || '.5'",
        value.format(s=kind),
        number.format(c="user_id", s=kind),
        number.format(c="event_id", s=kind),
    ]
    return f" || '{tab}' || ".join(parts) + " || " + tail.replace("{t}", tab)


def lines(spark, d, tail=_CLEAN):
    """D: one source per event type, its events as lines below a header."""
    e = table(spark, d, "events")
    data = e.selectExpr(
        "event_type AS source", "10 + event_id AS pos", f"{_line(tail, chr(9), 'spark')} AS line"
    )
    header = ", ".join(
        f"struct({i}L AS pos, '{h}' AS line)" for i, h in enumerate(_HEADERS)
    )
    heads = e.selectExpr("event_type AS source").distinct().selectExpr(
        "source", f"inline(array({header})) AS (pos, line)"
    )
    return heads.unionByName(data)


def lines_sql(tail=_CLEAN):
    heads = " UNION ALL ".join(
        f"SELECT DISTINCT event_type, {i}, '{h}' FROM events" for i, h in enumerate(_HEADERS)
    )
    return f"""SELECT event_type AS source, 10 + event_id AS pos,
                      {_line(tail, chr(9), 'duck')} AS line FROM events UNION ALL {heads}"""


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def scanned_sql(tail=_CLEAN):
    return f"""
      SELECT *, min(CASE WHEN numeric THEN pos END) OVER (PARTITION BY source) AS first
      FROM (SELECT *, len(list_filter(names, lambda t: regexp_matches(t, '{_NUMBER}'))) > 0 AS numeric
            FROM (SELECT *, list_filter(list_transform(string_split(line, chr(9)),
                           lambda t: trim(t)), lambda t: t <> '') AS names,
                         string_split_regex(trim(line), '[ \\t]+') AS tokens
                  FROM ({lines_sql(tail)})))"""


COLUMNS = f"""
    SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY pos, nth) - 1 AS INT) AS idx,
           "column"
    FROM (SELECT source, pos, unnest(names) AS "column", generate_subscripts(names, 1) AS nth
          FROM ({scanned_sql()}) WHERE pos < first)"""


def rows_sql(tail=_CLEAN):
    return f"""SELECT source, pos, tokens,
                      row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS row
               FROM ({scanned_sql(tail)}) WHERE pos > first"""


CELLS = f"""
    SELECT source, row, "column", CAST(token AS DOUBLE) AS value
    FROM (SELECT source, row, unnest(tokens) AS token,
                 generate_subscripts(tokens, 1) - 1 AS idx FROM ({rows_sql()}))
    JOIN ({COLUMNS}) USING (source, idx)"""

register("scan_header", COLUMNS, lambda spark, d: text.columns(lines(spark, d)))
register("scan_cells", CELLS, lambda spark, d: text.cells(lines(spark, d)))
register(
    "scan_preview",
    f"""SELECT source, "column", count(*) AS n,
               list(value ORDER BY row) FILTER (row < 3) AS first_values
        FROM ({CELLS}) GROUP BY source, "column" """,
    lambda spark, d: text.preview(text.cells(lines(spark, d))),
)
register(
    "column_catalog",
    f"""SELECT DISTINCT source, "column",
               replace("column", '37', '00000000000000000037') AS natural_key FROM ({COLUMNS})""",
    lambda spark, d: text.column_catalog(lines(spark, d)),
)
register(
    "arity_check",
    f"""SELECT source, row, CAST(len(tokens) AS INT) AS n_tokens, 5 AS n_headers,
               'row ' || row || ': ' || len(tokens) || ' tokens for 5 headers' AS detail
        FROM ({rows_sql(_DIRTY)}) WHERE len(tokens) <> 5""",
    lambda spark, d: text.arity_problems(
        text.numbered_rows(text.data_rows(lines(spark, d, _DIRTY))),
        text.columns(lines(spark, d, _DIRTY)),
    ),
)
register(
    "bad_tokens",
    f"""SELECT source, row, CAST(idx AS INT) AS idx, token
        FROM (SELECT source, row, unnest(tokens) AS token,
                     generate_subscripts(tokens, 1) - 1 AS idx FROM ({rows_sql(_DIRTY)}))
        WHERE NOT regexp_matches(token, '{_NUMBER}')""",
    lambda spark, d: text.bad_tokens(text.numbered_rows(text.data_rows(lines(spark, d, _DIRTY)))),
)
register(
    "dup_headers",
    f"""SELECT source, "column", count(*) AS times
        FROM (SELECT source, "column" FROM ({COLUMNS}) UNION ALL
              SELECT DISTINCT event_type, 'value' FROM events)
        GROUP BY source, "column" HAVING count(*) > 1""",
    lambda spark, d: text.duplicate_headers(
        text.columns(lines(spark, d)).select("source", "column").unionByName(
            table(spark, d, "events")
            .selectExpr("event_type AS source", "'value' AS column").distinct()
        )
    ),
)

_RULES = [("V 37", "Vk"), ("absent", "B"), ("time (h)", "B"), ("user", "user"), ("value", "B"), ("Vk", "Vz")]
RENAMED = f"""
    SELECT source, idx, CASE "column" WHEN 'V 37' THEN 'Vz' WHEN 'time (h)' THEN 'B'
                        ELSE "column" END AS "column",
           CASE WHEN "column" = 'value' THEN 'B' END AS clash FROM ({COLUMNS})"""
register(
    "rename_columns",
    RENAMED,
    lambda spark, d: rename_columns(text.columns(lines(spark, d)), _RULES),
)

_EXTRACTS = [("Va", "B", "value"), ("Vb", "B", "user"), ("Vc", "B", "absent")]


def text_work(spark, d):
    files = table(spark, d, "events").selectExpr(
        "event_type AS source", "'dir/' || event_type AS file"
    ).distinct()
    return work_list(files, _EXTRACTS)


def located(spark, d):
    names = rename_columns(text.columns(lines(spark, d)), _RULES).drop("clash")
    return locate_pairs(text_work(spark, d), names)


EXTRACTED = f"""
    SELECT variable, 'dir/' || source AS file, CAST(tokens[1] AS DOUBLE) AS x,
           CAST(tokens[nth] AS DOUBLE) AS y
    FROM ({rows_sql()}), (VALUES ('Va', 2), ('Vb', 3)) AS v(variable, nth)"""
register(
    "rename_extract",
    EXTRACTED,
    lambda spark, d: extract_pairs(
        text.data_rows(lines(spark, d)), located(spark, d), ["variable", "file"]
    ),
)
register(
    "extract_from_cells",
    f"""SELECT variable, 'dir/' || source AS file,
               max(CASE WHEN "column" = 'time (h)' THEN value END) AS x,
               max(CASE WHEN "column" = y_col THEN value END) AS y
        FROM ({CELLS}), (VALUES ('Va', 'value'), ('Vb', 'user')) AS v(variable, y_col)
        GROUP BY variable, source, row""",
    lambda spark, d: extract_from_cells(
        text.cells(lines(spark, d)),
        text_work(spark, d).withColumn("x_col", F.lit("time (h)")),
        ["variable", "file"],
    ),
)

# -- settings ---------------------------------------------------------------

_GLOBAL = {"interpolation": "steffen", "trim_left": 1.5, "impulse_filter": 3}


def customer_work(spark, d):
    files = table(spark, d, "customer").selectExpr(
        "c_mktsegment AS source", "'c/' || c_custkey AS dest",
        "map('nation', CAST(c_nationkey AS string)) AS tags",
    )
    return work_list(files, [("Va", "B", "Ya"), ("Vb", "B", "Yb")])


def customer_overrides(spark, d):
    c, r = table(spark, d, "customer"), table(spark, d, "region")
    none = "CAST(NULL AS string)"
    levels = [
        c.where("c_acctbal < 0").selectExpr(
            "'c/' || c_custkey AS dest", f"{none} AS variable", "c_acctbal AS trim_left",
            "1 AS derivative", "CAST(NULL AS double) AS prefactor_x",
        ),
        c.where("c_nationkey = 3").selectExpr(
            "'c/' || c_custkey", "'Vb'", "5.0D", "CAST(NULL AS int)", "-1.0D"
        ),
        r.where("r_regionkey = 0").selectExpr(
            none, "'Va'", "CAST(NULL AS double)", "2", "0.5D"
        ),
        r.where("r_regionkey = 1").selectExpr("'zzz'", "'Vx'", "0.0D", "0", "1.0D"),
    ]
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def customer_settings(spark, d):
    return resolve_settings(customer_work(spark, d), customer_overrides(spark, d), _GLOBAL)


SETTLED = """
    SELECT 'c/' || c_custkey AS dest, variable, c_nationkey,
           CASE WHEN c_nationkey = 3 AND variable = 'Vb' THEN CAST(5.0 AS DOUBLE)
                WHEN c_acctbal < 0 THEN c_acctbal ELSE 1.5 END AS trim_left,
           CASE WHEN c_acctbal < 0 THEN 1 WHEN variable = 'Va' THEN 2 ELSE 0 END AS derivative,
           CASE WHEN c_nationkey = 3 AND variable = 'Vb' THEN CAST(-1.0 AS DOUBLE)
                WHEN variable = 'Va' THEN 0.5 ELSE 1.0 END AS prefactor_x
    FROM customer, (VALUES ('Va'), ('Vb')) AS v(variable)"""
register(
    "settings_resolve",
    f"""SELECT dest, variable, trim_left, derivative, prefactor_x, 3 AS impulse_filter,
               'steffen' AS interpolation, 'min' AS interpolation_n, false AS invert_x,
               0 AS n_masks FROM ({SETTLED})""",
    lambda spark, d: customer_settings(spark, d).selectExpr(
        "dest", "variable", "trim_left", "derivative", "prefactor_x", "impulse_filter",
        "interpolation", "interpolation_n", "invert_x", "size(masks) AS n_masks",
    ),
)
register(
    "unmatched_overrides",
    "SELECT 'zzz' AS dest, 'Vx' AS variable FROM region WHERE r_regionkey = 1",
    lambda spark, d: unmatched_overrides(customer_overrides(spark, d), customer_work(spark, d)),
)

# -- scalar functions -------------------------------------------------------

register(
    "sanitise_name",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0
                        THEN replace(event_type || '_' || props, ' ', '_') END AS name FROM events""",
    lambda spark, d: table(spark, d, "events").select(
        "event_id",
        sanitise_name(
            F.expr("IF(event_id % 3 = 0, '.', '') || event_type || '\\t' || props")
        ).alias("name"),
    ),
)
register(
    "parse_format_length",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id
                 WHEN 1 THEN CAST(pow(2, user_id % 40) AS BIGINT) END AS n,
              CASE event_id % 3
                 WHEN 0 THEN CASE WHEN event_id > 0 AND bit_count(event_id) = 1
                     THEN '2^' || CAST(log2(event_id) AS INT) ELSE CAST(event_id AS VARCHAR) END
                 WHEN 1 THEN '2^' || (user_id % 40) END AS shown,
              CASE event_id % 3 WHEN 0 THEN event_id > 0 AND bit_count(event_id) = 1
                 WHEN 1 THEN true END AS is_power
       FROM events""",
    lambda spark, d: table(spark, d, "events").select(
        "event_id",
        parse_length(
            F.expr(
                "CASE event_id % 3 WHEN 0 THEN CAST(event_id AS string)"
                " WHEN 1 THEN '2^' || (user_id % 40) ELSE '2^x' END"
            )
        ).alias("n"),
    ).withColumns({"shown": format_length(F.col("n")), "is_power": is_power_of_two(F.col("n"))}),
)
_NATURAL = """list_aggregate(list_transform(regexp_extract_all({c}, '[0-9]+|[^0-9]+'),
    lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN lpad(t, 20, '0') ELSE t END),
    'string_agg', '')"""
register(
    "natural_sort",
    f"SELECT p_partkey, {_NATURAL.format(c='p_brand || p_partkey')} AS natural_key FROM part",
    lambda spark, d: table(spark, d, "part").select(
        "p_partkey", natural_key(F.expr("p_brand || p_partkey")).alias("natural_key")
    ),
)

# -- tags -------------------------------------------------------------------

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS {t})"


def tags(spark, d):
    k = _K.format(t="int")
    return table(spark, d, "events").selectExpr("event_id AS ord", "value", f"{k} AS k").selectExpr(
        "ord",
        """stack(5, 'number', CAST(k AS string), 'half', k || '.5', 'label', '"' || k || 'p0K"',
             'flag', CAST(value > 50 AS string),
             'mixed', IF(ord % 2 = 0, CAST(k AS string), '"' || k || 'K"'))
           AS (key, value)""",
    )


register(
    "tag_summary",
    f"""
    WITH t AS (SELECT event_id AS ord, value > 50 AS flag, {_K.format(t='INT')} AS k FROM events),
    v AS (SELECT DISTINCT 'number' AS key, 'int' AS type, CAST(k AS VARCHAR) AS value, k AS rank FROM t
          UNION ALL SELECT DISTINCT 'half', 'float', k || '.5', k FROM t
          UNION ALL SELECT DISTINCT 'label', 'string', '"' || k || 'p0K"', k FROM t
          UNION ALL SELECT DISTINCT 'flag', 'boolean', CAST(flag AS VARCHAR), CAST(flag AS INT) FROM t
          UNION ALL SELECT 'mixed', 'mixed', CASE WHEN ord % 2 = 0 THEN CAST(k AS VARCHAR)
                    ELSE '"' || k || 'K"' END AS m, min(ord) FROM t GROUP BY m)
    SELECT key, type, value, row_number() OVER (PARTITION BY key ORDER BY rank) - 1 AS position
    FROM v""",
    lambda spark, d: tag_values(tags(spark, d)),
)

# -- checks -----------------------------------------------------------------


def series_settings(spark, d):
    """Settings per user that fit some series and fail others."""
    given = {
        "masks": "array(struct(20.0D + series % 3 AS left, 30.0D AS right),"
                 " struct(-5.0D + 10 * (series % 2) AS left, 690.0D + series % 40 AS right))",
        "trim_left": "IF(series % 4 = 0, NULL, CAST(series % 7 * 20 AS double))",
        "trim_right": "IF(series % 3 = 0, NULL, CAST(60 + series % 11 * 66 AS double))",
        "invert_x": "series % 2 = 0",
        "interpolation": "IF(series % 5 = 0, NULL, 'linear')",
        "interpolation_n": "CASE series % 4 WHEN 0 THEN '50' WHEN 1 THEN '2^x' ELSE 'min' END",
        "derivative": "CAST(series % 4 AS int)",
        "impulse_tuning": "CAST(series % 3 - 1 AS double)",
    }
    return events(spark, d).select("series").distinct().selectExpr(
        "series",
        *[
            f"CAST({given.get(f, 'NULL' if default is None else repr(default))} AS {dtype}) AS {f}"
            for f, (dtype, default) in FIELDS.items()
            if f not in ("masks", "prefactor_x", "prefactor_y")
        ],
        f"{given['masks']} AS masks",
    )


def coded(sql: str) -> str:
    return f"SELECT CAST(series AS VARCHAR) AS key, code, severity FROM ({sql})"


def only_codes(violations):
    return violations.select("key", "code", "severity")


_SETTINGS = """
    SELECT series, CASE WHEN series % 4 <> 0 THEN series % 7 * 20.0 END AS trim_left,
           CASE WHEN series % 3 <> 0 THEN 60 + series % 11 * 66.0 END AS trim_right,
           series % 2 = 0 AS invert_x, min(x) AS l, max(x) AS r
    FROM ({view}) GROUP BY series"""
_TRIMS = f"""
    SELECT *, CASE WHEN r <= 0 AND ar >= 0 THEN -ar ELSE al END AS lo,
              CASE WHEN r <= 0 AND ar >= 0 THEN -al ELSE ar END AS hi
    FROM (SELECT *, coalesce(trim_left, l) AS al, coalesce(trim_right, r) AS ar
          FROM ({_SETTINGS.format(view=EH)}))"""
_RULE = "SELECT series, '{code}' AS code, '{severity}' AS severity FROM ({source}) WHERE {when}"


def rules_sql(source: str, *rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        _RULE.format(
            code=c, severity="warn" if c in quality.WARNINGS else "error", source=source, when=w
        )
        for c, w in rules
    )


register(
    "violations_trim",
    coded(rules_sql(
        _TRIMS, ("V12", "al >= ar"), ("V13", "invert_x AND (lo = 0 OR hi = 0)"),
        ("V14", "l > lo"), ("V14", "r < hi"),
    )),
    lambda spark, d: only_codes(
        quality.trim_violations(
            dedup_mean(hourly(spark, d), KEYS), series_settings(spark, d), KEYS
        )
    ),
)
register(
    "violations_mask",
    coded(rules_sql(
        f"SELECT series, min(x) AS l, max(x) AS r FROM ({EH}) GROUP BY series",
        ("V10", "-5.0 + 10 * (series % 2) < l OR 690.0 + series % 40 > r"),
    )),
    lambda spark, d: only_codes(
        quality.mask_violations(
            dedup_mean(hourly(spark, d), KEYS), series_settings(spark, d), KEYS, 1
        )
    ),
)
register(
    "violations_settings",
    coded(rules_sql(
        "SELECT DISTINCT user_id AS series FROM events",
        ("V23", "series % 3 = 0"), ("V23", "series % 4 = 3"), ("V23", "series % 4 = 1"),
        ("V24", "series % 4 = 0"), ("V25", "series % 5 = 0 AND series % 2 = 0"),
        ("V26", "series % 5 = 0 AND series % 4 > 0"), ("V27", "series % 5 = 0"),
        ("V28", "series % 5 <> 0 AND series % 4 = 2"),
    )),
    lambda spark, d: only_codes(
        quality.settings_violations(series_settings(spark, d), KEYS, True)
    ),
)
register(
    "violations_pairs",
    """SELECT 'P' || p_partkey AS key,
              CASE WHEN p_size > 40 THEN 'V06' WHEN n < 2 THEN 'V07'
                   WHEN bad > 0 THEN 'V08' ELSE 'V09' END AS code,
              CASE WHEN p_size > 40 THEN 'warn' ELSE 'error' END AS severity
       FROM part LEFT JOIN (
         SELECT l_partkey, count(*) AS n, count(*) FILTER (l_quantity = 7) AS bad,
                min(l_linenumber) AS lo, max(l_linenumber) AS hi
         FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey
       WHERE p_size > 40 OR coalesce(n, 0) < 2 OR bad > 0 OR lo = hi""",
    lambda spark, d: only_codes(
        quality.pair_violations(
            table(spark, d, "part").selectExpr(
                "'P' || p_partkey AS series", "p_size <= 40 AS x_found", "true AS y_found"
            ),
            table(spark, d, "lineitem").join(
                table(spark, d, "part").where("p_size <= 40"),
                F.expr("l_partkey = p_partkey"), "left_semi",
            ).selectExpr(
                "'P' || l_partkey AS series", "CAST(l_linenumber AS double) AS x",
                "IF(l_quantity = 7, double('inf'), l_extendedprice) AS y",
            ),
            KEYS,
        )
    ),
)
register(
    "violations_files",
    f"""SELECT source AS key, code, 'error' AS severity FROM (
          SELECT source, 'V04' AS code FROM ({rows_sql(_DIRTY)}) WHERE len(tokens) <> 5
          UNION ALL SELECT source, 'V05' FROM (
            SELECT source, unnest(tokens) AS token FROM ({rows_sql(_DIRTY)}))
            WHERE NOT regexp_matches(token, '{_NUMBER}')
          UNION ALL SELECT source, 'V02' FROM ({RENAMED}) WHERE clash IS NOT NULL)""",
    lambda spark, d: only_codes(
        quality.file_violations(
            text.columns(lines(spark, d, _DIRTY)),
            rename_columns(text.columns(lines(spark, d, _DIRTY)), _RULES),
            text.arity_problems(
                text.numbered_rows(text.data_rows(lines(spark, d, _DIRTY))),
                text.columns(lines(spark, d, _DIRTY)),
            ),
            text.bad_tokens(text.numbered_rows(text.data_rows(lines(spark, d, _DIRTY)))),
        )
    ),
)
register(
    "violations_names",
    """SELECT dest AS key, unnest(CASE WHEN times > 1 AND dest LIKE '%/' THEN ['V21', 'V22']
              WHEN times > 1 THEN ['V21'] ELSE ['V22'] END) AS code, 'error' AS severity
       FROM (SELECT dest, count(*) AS times FROM (
         SELECT p_type || CASE WHEN p_size > 25 THEN '/' ELSE '' END AS dest FROM part)
         GROUP BY dest) WHERE times > 1 OR dest LIKE '%/'""",
    lambda spark, d: only_codes(
        quality.name_violations(
            table(spark, d, "part").selectExpr("p_type || IF(p_size > 25, '/', '') AS dest")
        )
    ),
)

_INDEXED = unique(EH).join(
    ("SELECT *, row_number() OVER (PARTITION BY series ORDER BY x) - 1 AS i FROM (", ")")
)


def domains_sql(steps: int) -> str:
    """All windows of all series, with the samples that they hold."""
    return f"""
    SELECT CAST(e.series AS VARCHAR) || '/' || e.w AS series, e.series AS id, e.w AS sweep_index,
           coalesce(c.n, 0) AS n, CASE WHEN c.n > 1 THEN c.dt END AS dt
    FROM (SELECT DISTINCT series, unnest(range(0, {steps})) AS w FROM ({unique(EH)})) e
    LEFT JOIN (SELECT series, sweep_index, max(n_data) AS n, max(dt) AS dt
               FROM ({sweep_sql(_INDEXED, 'windows', steps)}) GROUP BY series, sweep_index) c
    ON c.series = e.series AND c.sweep_index = e.w"""


def domains(spark, d, steps):
    return sweep_domains(dedup_mean(hourly(spark, d), KEYS), KEYS, "windows", steps)


SPECTRUM_RULES = (
    ("V17", "floor(0.05 * dt * 16.0) >= 9"),
    ("V18", "0.06 * dt * 16.0 > 9"),
    ("V19", "floor(0.05 * dt * 16.0) < 9 AND floor(0.05 * dt * 16.0) >= least(ceil(0.06 * dt * 16.0), 9)"),
    ("V20", "n > 16"),
    ("V32", "n < 2"),
)
for _name, _steps in (("violations_spectrum", 9), ("violations_spectrum_short", 150)):
    register(
        _name,
        coded(rules_sql(domains_sql(_steps), *SPECTRUM_RULES)),
        lambda spark, d, steps=_steps: only_codes(
            quality.spectrum_violations(domains(spark, d, steps), KEYS, 16, 0.05, 0.06)
        ),
    )
register(
    "violations_windows",
    f"SELECT id AS series, CAST(sweep_index AS INT) AS sweep_index, n AS n_data FROM ({domains_sql(150)}) WHERE n < 2",
    lambda spark, d: domains(spark, d, 150).where("n_data < 2").select(
        "series", "sweep_index", "n_data"
    ),
)

# -- storage and catalog ----------------------------------------------------

register(
    "pack_pairs",
    f"""SELECT series, CAST(0 AS INT) AS part, list(x ORDER BY x) AS x,
               list({Y6} ORDER BY x) AS y FROM ({unique(EH)}) GROUP BY series""",
    lambda spark, d: pack_pairs(rounded(dedup_mean(hourly(spark, d), KEYS), "y"), KEYS),
)
register(
    "unpack_pairs",
    f"SELECT series, x, {Y6} AS y FROM ({unique(EH)})",
    lambda spark, d: rounded(
        unpack_pairs(pack_pairs(dedup_mean(hourly(spark, d), KEYS), KEYS), KEYS), "y"
    ),
)

_PROJECT = {"title": "demo", "format": "messagepack"}
_FFT = {"zero_pad": 1024, "center": True, "hann": True, "sweep": "windows", "sweep_steps": 2}
CATALOG = f"""
    SELECT 'demo' AS project, variable, dest AS file, stage, 'parquet' AS format,
           'output/demo/' || variable || '/' || stage || '/' || dest || '.parquet' AS path,
           CASE WHEN stage LIKE 'fft%' THEN 'Frequency' ELSE 'B' END AS x_label,
           CASE WHEN stage LIKE 'fft%' THEN 'FFT Amplitude'
                ELSE variable || ' (Y' || substr(variable, 2) || ')' END AS y_label,
           c_nationkey AS nation
    FROM ({SETTLED}), (VALUES ('unprocessed'), ('raw'), ('preprocessed'), ('processed'),
         ('fft_sweep_window_0'), ('fft_sweep_window_1')) AS s(stage)"""


def customer_catalog(spark, d):
    return catalog(customer_settings(spark, d), _PROJECT, _FFT)


register(
    "catalog",
    CATALOG,
    lambda spark, d: customer_catalog(spark, d).selectExpr(
        "project", "variable", "file", "stage", "format", "path", "x_label", "y_label",
        "CAST(tags['nation'] AS int) AS nation",
    ),
)
