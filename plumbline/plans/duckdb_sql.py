"""The same results as plain SQL over the same tables, for DuckDB."""

from __future__ import annotations

from plumbline.operators.corruption import CANDIDATE_EDITS
from plumbline.operators.detection import (
    MAX_FISHER_DISTANCE, MAX_Z, MIN_EFFECT, MIN_ROWS_FOR_SHIFT, STD_RATIO,
)
from plumbline.operators.reconciliation import PRICE_TIERS, TOKEN_KINDS
from plumbline.plans.registered import (
    PLACEHOLDER, PLACEHOLDER_EVERY, SPLIT_SEED,
)
from plumbline.sources.tables import CLEAN_SHARE

INT, FLOAT, STR, TIME, LIST = "int", "float", "str", "datetime", None

SCHEMA: dict[str, dict[str, str | None]] = {
    "region": {"r_regionkey": INT, "r_name": STR},
    "nation": {"n_nationkey": INT, "n_name": STR, "n_regionkey": INT},
    "customer": {"c_custkey": INT, "c_name": STR, "c_nationkey": INT, "c_acctbal": FLOAT, "c_mktsegment": STR},
    "supplier": {"s_suppkey": INT, "s_name": STR, "s_nationkey": INT, "s_acctbal": FLOAT},
    "part": {"p_partkey": INT, "p_name": STR, "p_brand": STR, "p_type": STR, "p_size": INT,
             "p_retailprice": FLOAT},
    "orders": {"o_orderkey": INT, "o_custkey": INT, "o_orderstatus": STR, "o_totalprice": FLOAT,
               "o_orderdate": TIME, "o_orderpriority": STR},
    "lineitem": {"l_orderkey": INT, "l_partkey": INT, "l_suppkey": INT, "l_linenumber": INT,
                 "l_quantity": FLOAT, "l_extendedprice": FLOAT, "l_discount": FLOAT, "l_tax": FLOAT,
                 "l_returnflag": STR, "l_linestatus": STR, "l_shipdate": TIME},
    "events": {"event_id": INT, "ts": TIME, "user_id": INT, "event_type": STR, "value": FLOAT, "props": STR},
    "documents": {"doc_id": INT, "text": STR, "lang": STR, "source": STR, "n_chars": INT},
    "embeddings": {"vec_id": INT, "embedding": LIST, "label": INT},
    "pages": {"page_id": INT, "url": STR, "html": STR},
    "benchmark": {"item_id": INT, "text": STR},
    "labels": {"doc_id": INT, "quality": INT, "toxic": INT},
    "conversations": {"conv_id": INT, "turn": INT, "role": STR, "text": STR},
}

_SLOTS = ((1, 12), (13, 12), (25, 8))


def u(seed: str, *keys: str, slot: int = 0) -> str:
    """The uniform draw of (seed, keys)."""
    first, width = _SLOTS[slot]
    text = f"'{seed}'" + "".join(f" || ':' || ({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5({text}), {first}, {width}))::BIGINT / {16 ** width}::DOUBLE)"


def rounded(x: str, digits: int = 4) -> str:
    """Rounded, with no negative zero."""
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def columns_of(*kinds: str | None, tables: dict | None = None):
    for t, columns in sorted((tables or SCHEMA).items()):
        for i, (c, kind) in enumerate(columns.items()):
            if kind in kinds:
                yield t, c, i, kind


# --- derived inputs ------------------------------------------------------------------------------------

ORDERS_NULLS = f"""SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN {u('nulls', 'o_orderkey')} >= 0.1 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders"""
ORDERS_COPIES = f"""SELECT orders.* FROM orders, range(0, 2) r(i)
    WHERE i = 0 OR {u('copies', 'o_orderkey')} < 0.05"""


def placeholder(source: str) -> str:
    return f"""SELECT * REPLACE (CASE WHEN o_orderkey % {PLACEHOLDER_EVERY} = 0 THEN {PLACEHOLDER}::DOUBLE
        ELSE o_totalprice END AS o_totalprice) FROM ({source})"""


WIDENED = f"WITH orders_nulls AS ({ORDERS_NULLS}), orders_copies AS ({ORDERS_COPIES})\n"
WIDE_SCHEMA = {**SCHEMA, "orders_nulls": SCHEMA["orders"], "orders_copies": SCHEMA["orders"]}


# --- profile ---------------------------------------------------------------------------------------------

def _plain(c: str, kind: str | None) -> str:
    return f"({c} + 0.0)" if kind == FLOAT else c


def table_profile() -> str:
    return WIDENED + union(f"""SELECT '{t}' AS table_name, n AS nb_entries, {len(columns)} AS nb_columns,
        n - d AS nb_duplicated_rows, CASE WHEN n > 0 THEN {rounded('(n - d) / n::DOUBLE')} ELSE 0.0::DOUBLE END
        AS duplicates_distribution
        FROM (SELECT (SELECT count(*) FROM {t}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS d)"""
                           for t, columns in sorted(WIDE_SCHEMA.items()))


def _type(c: str, kind: str | None) -> str:
    if kind is None:
        return "max(NULL::VARCHAR)"
    if kind == TIME:
        return "CASE WHEN count(*) = 0 THEN 'bool' ELSE 'datetime' END"
    labels = "'Y', 'N'" if kind == STR else "0, 1"
    two = f"count({c}) = count(*) AND count(*) FILTER ({c} NOT IN ({labels})) = 0"
    date = ""
    if kind == STR:
        date = f"""WHEN count({c}) > 0 AND count(*) FILTER (regexp_matches({c}, '[-/:]') AND length({c}) <= 64
            AND try_cast({c} AS TIMESTAMP) IS NOT NULL) / count({c}) >= 0.95 THEN 'datetime'"""
    return f"CASE WHEN {two} THEN 'bool' {date} ELSE '{kind}' END"


def column_types() -> str:
    return WIDENED + union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, {_type(c, k)} AS datatype FROM {t}"
        for t, c, i, k in columns_of(INT, FLOAT, STR, TIME, LIST, tables=WIDE_SCHEMA))


def _column_rows(schema: dict) -> str:
    parts = []
    for t, c, i, k in columns_of(INT, FLOAT, STR, TIME, LIST, tables=schema):
        unique = f"count(DISTINCT {_plain(c, k)}) + (count(*) > count({c}))::BIGINT"
        if k is None:
            flags = "NULL::BIGINT AS nb_unique, false AS potential_primary_key, false AS is_categorical"
        else:
            flags = (f"{unique} AS nb_unique, {unique} = count(*) AS potential_primary_key, "
                     f"{unique} <= 100 AS is_categorical")
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal,
            {_type(c, k)} AS datatype, {flags}, count(*) > count({c}) AS null_values,
            count(*) - count({c}) AS nb_nulls FROM {t}""")
    return union(parts)


def column_profile() -> str:
    return WIDENED + _column_rows(WIDE_SCHEMA)


def primary_keys() -> str:
    return f"SELECT table_name, column_name FROM ({_column_rows(SCHEMA)}) WHERE potential_primary_key"


def primary_key_columns() -> str:
    return f"""SELECT column_name, string_agg(table_name, ',' ORDER BY table_name) AS tables
        FROM ({primary_keys()}) GROUP BY column_name"""


def categorical_columns() -> str:
    return f"""SELECT table_name, column_name, ordinal FROM ({_column_rows(SCHEMA)})
        WHERE is_categorical AND NOT potential_primary_key"""


def null_profile() -> str:
    return WIDENED + union(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nb_nulls,
        count(*) > count({c}) AS null_values FROM {t}"""
        for t, c, _, _ in columns_of(INT, FLOAT, STR, TIME, LIST, tables=WIDE_SCHEMA))


def category_distribution() -> str:
    return union(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, {_plain(c, k)}::VARCHAR AS category,
        count(*) AS cnt, {rounded(f'count(*) / (SELECT count({c}) FROM {t})::DOUBLE')} AS share FROM {t}
        WHERE {c} IS NOT NULL
          AND (SELECT count(DISTINCT {_plain(c, k)}) + (count(*) > count({c}))::BIGINT FROM {t}) <= 100
        GROUP BY {_plain(c, k)}""" for t, c, _, k in columns_of(INT, FLOAT, STR, TIME))


_SHARES = ("0.01", "0.05", "0.10", "0.25", "0.50", "0.75", "0.90", "0.95", "0.99")
_SHARE_NAMES = "'1%', '5%', '10%', '25%', '50%', '75%', '90%', '95%', '99%'"


def numeric_distribution() -> str:
    parts = []
    for t, c, _, _ in columns_of(INT, FLOAT):
        x = f"({c}::DOUBLE)"
        values = [f"count({c})::DOUBLE", rounded(f"avg({x})"), rounded(f"stddev_samp({x})"), rounded(f"min({x})")]
        values += [rounded(f"quantile_cont({x}, {p})") for p in _SHARES] + [rounded(f"max({x})")]
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
            unnest(['count', 'mean', 'std', 'min', {_SHARE_NAMES}, 'max']) AS stat,
            unnest([{', '.join(values)}]) AS value FROM {t}""")
    return union(parts)


def datetime_distribution() -> str:
    parts = []
    for t, c, _, _ in columns_of(TIME):
        x = f"epoch_us({c})"

        def show(value: str) -> str:
            return f"strftime(make_timestamp(({value})::BIGINT), '%Y-%m-%d %H:%M:%S.%f')"

        values = [f"count({c})::VARCHAR", show(f"sum({x})::HUGEINT // count({c})"), show(f"min({x})")]
        values += [show(f"round(quantile_cont({x}::DOUBLE, {p}))") for p in _SHARES] + [show(f"max({x})")]
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
            unnest(['count', 'mean', 'min', {_SHARE_NAMES}, 'max']) AS stat,
            unnest([{', '.join(values)}]) AS value FROM {t}""")
    return union(parts)


def string_distribution() -> str:
    return union(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, s.count, s.unique, b.{c} AS top, b.n AS freq
        FROM (SELECT count({c}) AS count, count(DISTINCT {c}) AS unique FROM {t}) s,
             (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1) b"""
                 for t, c, _, _ in columns_of(STR))


def datetime_strings() -> str:
    iso = "strftime(o_orderdate, '%Y-%m-%d')"
    texts = {
        "mostly_dates": f"CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE {iso} END",
        "too_few_dates": f"CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE {iso} END",
        "day_first": "strftime(o_orderdate, '%d/%m/%Y')",
        "digits_only": "strftime(o_orderdate, '%Y%m%d')",
        "words": "o_orderpriority",
    }
    return union(f"""SELECT nb_values, {rounded('hits / nb_values')} AS date_share,
        hits / nb_values >= 0.95 AS is_datetime, '{name}' AS column_name FROM (
        SELECT count(c) AS nb_values, count(*) FILTER (regexp_matches(c, '[-/:]') AND coalesce(
            try_cast(c AS TIMESTAMP), try_strptime(c, '%m/%d/%Y'), try_strptime(c, '%d/%m/%Y')) IS NOT NULL) AS hits
        FROM (SELECT {text} AS c FROM orders))""" for name, text in texts.items())


def correlations() -> str:
    parts = []
    for t, columns in sorted(SCHEMA.items()):
        numbers = [c for c, k in columns.items() if k in (INT, FLOAT)]
        for i, a in enumerate(numbers):
            for b in numbers[i + 1:]:
                parts.append(f"""SELECT '{t}' AS table_name, '{a}' AS col_a, '{b}' AS col_b,
                    {rounded(f'corr({a}::DOUBLE, {b}::DOUBLE)')} AS r FROM {t}""")
    return f"SELECT * FROM ({union(parts)}) WHERE r IS NOT NULL AND NOT isnan(r)"


def _flags(schema: dict) -> str:
    """CTE `profiled`: one row per column, with its flags."""
    return f"profiled AS MATERIALIZED ({_column_rows(schema)})"


def _is_categorical(t: str, c: str) -> str:
    return (f"(SELECT is_categorical AND NOT potential_primary_key FROM profiled WHERE table_name = '{t}' "
            f"AND column_name = '{c}')")


def cramers_v() -> str:
    parts = []
    for t, columns in sorted(SCHEMA.items()):
        names = [(c, k) for c, k in columns.items() if k is not None]
        for i, (a, kind_a) in enumerate(names):
            for b, kind_b in names[i + 1:]:
                parts.append(f"""SELECT '{t}' AS table_name, '{a}' AS col_a, '{b}' AS col_b,
                    {rounded('''coalesce(CASE WHEN least(count(DISTINCT a), count(DISTINCT b)) < 2 THEN 0
                        ELSE sqrt(greatest(sum(n * n / (na * nb)::DOUBLE) - 1, 0)
                             / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) END, 0.0)''')} AS v
                    FROM (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb
                          FROM (SELECT {_plain(a, kind_a)}::VARCHAR AS a, {_plain(b, kind_b)}::VARCHAR AS b, count(*) AS n FROM {t}
                                WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {_is_categorical(t, a)} AND {_is_categorical(t, b)}
                                GROUP BY 1, 2))
                    HAVING {_is_categorical(t, a)} AND {_is_categorical(t, b)}""")
    return f"WITH {_flags(SCHEMA)}\n{union(parts)}"


def _is_numerical(t: str, c: str) -> str:
    return f"('{t}' || '.' || '{c}' IN (SELECT table_name || '.' || column_name FROM numerical))"


def _numerical_ctes(schema: dict, tables: str = "") -> str:
    """CTEs up to `profiled` and `numerical`; `tables` are CTEs of derived tables."""
    return _key_ctes(schema, tables) + f""", {_flags(schema)},
        numerical AS MATERIALIZED (SELECT table_name, column_name, ordinal FROM profiled WHERE datatype IN ('int', 'float')
        AND (table_name, column_name) NOT IN (SELECT (parent_table, parent_column) FROM links))
        """


def correlation_ratio() -> str:
    parts = []
    for t, columns in sorted(SCHEMA.items()):
        for a, kind in columns.items():
            for b in (c for c, k in columns.items() if k in (INT, FLOAT)):
                if a != b and kind is not None:
                    wanted = f"{_is_categorical(t, a)} AND {_is_numerical(t, b)}"
                    parts.append(f"""SELECT '{t}' AS table_name, '{a}' AS categorical, '{b}' AS numerical,
                        {rounded('coalesce(CASE WHEN between_ss > 0 THEN sqrt(between_ss / total_ss) ELSE 0.0 END, 0.0)')} AS eta
                        FROM (SELECT sum(n * (m - mean) ** 2) AS between_ss, any_value(total_ss) AS total_ss
                              FROM (SELECT count(*) AS n, avg({b}::DOUBLE) AS m FROM {t}
                                    WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {wanted} GROUP BY {_plain(a, kind)}),
                                   (SELECT avg({b}::DOUBLE) AS mean, var_pop({b}::DOUBLE) * count(*) AS total_ss FROM {t}
                                    WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {wanted}))
                        WHERE {wanted}""")
    return f"{_numerical_ctes(SCHEMA)}\n{union(parts)}"


# --- keys ---------------------------------------------------------------------------------------------------

def _key_ctes(schema: dict = SCHEMA, tables: str = "") -> str:
    cells = []
    for t, c, i, k in columns_of(INT, FLOAT, STR, TIME, tables=schema):
        num, txt = "NULL::DOUBLE", "NULL::VARCHAR"
        if k in (INT, FLOAT):
            num = f"{c}::DOUBLE + 0.0"
        elif k == STR:
            txt = f"'S' || {c}"
        else:
            txt = f"'T' || epoch_us({c})::VARCHAR"
        cells.append(f"SELECT '{t}' AS t, '{c}' AS c, {i} AS o, {num} AS num, {txt} AS txt FROM {t}")
    return f"""WITH {tables} cells AS ({union(cells)}),
        vc AS (SELECT t, c, o, num, txt, count(*) AS cnt FROM cells GROUP BY ALL),
        stats AS (SELECT t, c, o, sum(cnt) AS n, count(*) AS u,
            coalesce(sum(cnt) FILTER (num IS NOT NULL OR txt IS NOT NULL), 0) AS filled FROM vc GROUP BY ALL),
        key_columns AS (SELECT t, c, o FROM stats WHERE n = u),
        parents AS (SELECT t, c, row_number() OVER (ORDER BY first_t, first_o, t) AS parent_rank
            FROM (SELECT t, c, o, first_value(t) OVER w AS first_t, first_value(o) OVER w AS first_o
                  FROM key_columns WINDOW w AS (PARTITION BY c ORDER BY t, o))),
        values_of AS (SELECT * FROM vc WHERE num IS NOT NULL OR txt IS NOT NULL),
        held AS (SELECT v.*, p.parent_rank FROM values_of v JOIN parents p ON p.t = v.t AND p.c = v.c),
        coverage AS (SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column,
                any_value(b.parent_rank) AS parent_rank,
                {rounded('sum(a.cnt)::DOUBLE / any_value(s.filled)::DOUBLE')} AS coverage
            FROM values_of a
            JOIN held b ON a.num IS NOT DISTINCT FROM b.num AND a.txt IS NOT DISTINCT FROM b.txt AND a.t <> b.t
            JOIN stats s ON s.t = a.t AND s.c = a.c
            GROUP BY a.t, a.c, b.t, b.c),
        links AS (SELECT child_table, child_column, parent_table, parent_column, coverage FROM (
            SELECT *, row_number() OVER (PARTITION BY child_table, child_column
                ORDER BY coverage DESC, parent_rank) AS place FROM coverage WHERE coverage >= 1)
            WHERE place = 1)
        """


def fk_coverage() -> str:
    return _key_ctes() + "SELECT child_table, child_column, parent_table, parent_column, coverage FROM coverage"


def foreign_keys() -> str:
    return _key_ctes() + "SELECT * FROM links"


def referenced_keys() -> str:
    return _key_ctes() + "SELECT DISTINCT parent_table, parent_column FROM links"


def numerical_columns() -> str:
    return f"{_numerical_ctes(SCHEMA)} SELECT * FROM numerical"


def pair_coverage() -> str:
    pairs = [("lineitem", "l_partkey", "customer", "c_custkey"), ("orders", "o_custkey", "customer", "c_custkey"),
             ("documents", "doc_id", "labels", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    return union(f"""SELECT '{a}.{b}' AS child, '{c}.{d}' AS parent,
        {rounded(f'avg(({b} IN (SELECT {d} FROM {c}))::INT::DOUBLE)')} AS coverage FROM {a}
        WHERE {b} IS NOT NULL""" for a, b, c, d in pairs)


# --- numerical profile ---------------------------------------------------------------------------------------

#: All tables, orders with gaps and placeholders in place of orders.
MARKED_SCHEMA = {"orders_marked" if t == "orders" else t: columns for t, columns in SCHEMA.items()}


def _suspects() -> str:
    """CTE `suspects`, after those that say which columns are numerical."""
    parts = []
    for t, c, _, _ in columns_of(INT, FLOAT, tables=MARKED_SCHEMA):
        wanted = f"{_is_numerical(t, c)} AND (SELECT count(*) FROM numerical WHERE table_name = '{t}') > 1"
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, v AS value,
            {rounded('f')} AS frequency, {rounded('CASE WHEN v > hi THEN (v - hi) / iqr ELSE (lo - v) / iqr END', 2)}
            AS gap_to_fence_iqr FROM (
            SELECT v, f, q3 - q1 AS iqr, q1 - 10 * (q3 - q1) AS lo, q3 + 10 * (q3 - q1) AS hi FROM (
                SELECT any_value(m.v) AS v, any_value(m.f) AS f,
                    quantile_cont(x, 0.25) FILTER (x <> m.v) AS q1, quantile_cont(x, 0.75) FILTER (x <> m.v) AS q3
                FROM (SELECT {c}::DOUBLE AS x FROM {t}),
                     (SELECT {c}::DOUBLE AS v, count(*) / (SELECT count(*) FROM {t})::DOUBLE AS f FROM {t}
                      WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY f DESC, v LIMIT 1) m))
            WHERE f > 0.01 AND iqr <> 0 AND (v > hi OR v < lo) AND {wanted}""")
    tables = f"orders_marked AS ({placeholder(ORDERS_NULLS)}),"
    return f"{_numerical_ctes(MARKED_SCHEMA, tables)}, suspects AS ({union(parts)})"


def disguised_missing() -> str:
    return f"{_suspects()} SELECT * FROM suspects"


def ml_row_counts() -> str:
    parts = []
    for t, columns in sorted(MARKED_SCHEMA.items()):
        keep = " AND ".join(f"(NOT {_is_numerical(t, c)} OR ({c} IS NOT NULL AND {c}::DOUBLE NOT IN (SELECT value FROM suspects "
                            f"WHERE table_name = '{t}' AND column_name = '{c}')))" for c, k in columns.items() if k in (INT, FLOAT))
        parts.append(f"""SELECT '{t}' AS table_name, n AS nb_numerical, CASE WHEN n > 1 THEN kept END AS nb_entries_profiled,
            CASE WHEN n > 1 THEN total - kept END AS nb_entries_dropped
            FROM (SELECT (SELECT count(*)::INT FROM numerical WHERE table_name = '{t}') AS n,
                  (SELECT count(*) FROM {t}) AS total, (SELECT count(*) FROM {t} WHERE {keep}) AS kept)""")
    return f"{_suspects()} {union(parts)}"


def pca_2col() -> str:
    return f"""WITH m AS (SELECT abs(corr(p_partkey::DOUBLE, p_retailprice)) AS r, count(*)::DOUBLE AS n FROM part
            WHERE p_partkey IS NOT NULL AND p_retailprice IS NOT NULL)
        SELECT component, {rounded('size / 2')} AS variance_explained,
            {rounded('CASE WHEN component = 1 THEN size / 2 ELSE 1 END')} AS cumulative_variance, kept AS dimension_kept,
            CASE WHEN kept AND weight >= 0.3 THEN {rounded('weight')} END AS p_partkey,
            CASE WHEN kept AND weight >= 0.3 THEN {rounded('weight')} END AS p_retailprice
        FROM (SELECT *, component = 1 OR (1 + r) / 2 < 0.95 AS kept, sqrt(0.5 * size * n / (n - 1)) AS weight
              FROM (SELECT c AS component, r, n, CASE WHEN c = 1 THEN 1 + r ELSE 1 - r END AS size
                    FROM m, (VALUES (1), (2)) v(c)))"""


def pca_power_sums() -> str:
    cells = []
    for t, columns in sorted(SCHEMA.items()):
        numbers = [c for c, k in columns.items() if k in (INT, FLOAT)]
        for i, a in enumerate(numbers):
            cells.append(f"""SELECT '{t}' AS t, {i} AS i, {i} AS j, CASE WHEN min({a}) < max({a}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r
                FROM {t} HAVING {_is_numerical(t, a)}""")
            for j, b in enumerate(numbers):
                if i != j:
                    cells.append(f"""SELECT '{t}' AS t, {i} AS i, {j} AS j, corr({a}::DOUBLE, {b}::DOUBLE) AS r
                        FROM {t} HAVING {_is_numerical(t, a)} AND {_is_numerical(t, b)}""")
    return f"""{_numerical_ctes(SCHEMA)}, cells AS MATERIALIZED ({union(cells)}),
        r1 AS MATERIALIZED (SELECT t, i, j, CASE WHEN r IS NULL OR isnan(r) THEN 0.0::DOUBLE ELSE r END AS r FROM cells_of),
        r2 AS MATERIALIZED (SELECT a.t, a.i, b.j, sum(a.r * b.r) AS r FROM r1 a JOIN r1 b ON a.t = b.t AND a.j = b.i GROUP BY ALL),
        wide AS (SELECT t FROM r1 GROUP BY t HAVING count(DISTINCT i) > 1),
        traces AS (
            SELECT t, 1 AS power, sum(r) AS total FROM r1 WHERE i = j GROUP BY t
            UNION ALL SELECT t, 2, sum(r) FROM r2 WHERE i = j GROUP BY t
            UNION ALL SELECT a.t, 3, sum(a.r * b.r) FROM r2 a JOIN r1 b ON a.t = b.t AND a.i = b.j AND a.j = b.i GROUP BY a.t
            UNION ALL SELECT a.t, 4, sum(a.r * b.r) FROM r2 a JOIN r2 b ON a.t = b.t AND a.i = b.j AND a.j = b.i GROUP BY a.t)
        SELECT t AS table_name, power, {rounded('total')} AS total FROM traces WHERE t IN (SELECT t FROM wide)""".replace(
        ", cells AS MATERIALIZED", ", cells_of AS MATERIALIZED")


# --- sources ----------------------------------------------------------------------------------------------

def split_counts() -> str:
    return union(f"""SELECT '{t}' AS table_name, role, nb_rows, CASE WHEN nb_rows > 0 THEN first_row END AS first_row,
        CASE WHEN nb_rows > 0 THEN first_row + nb_rows - 1 END AS last_row FROM (
        SELECT 'clean' AS role, cut AS nb_rows, 0::BIGINT AS first_row FROM c UNION ALL
        SELECT 'test', n - cut, cut FROM c)""".replace(
        "FROM c", f"FROM (SELECT count(*) AS n, floor(count(*) * {CLEAN_SHARE}::DOUBLE)::BIGINT AS cut FROM {t})")
                 for t in sorted(SCHEMA))


def split_keys() -> str:
    cut = f"(SELECT floor(count(*) * {CLEAN_SHARE}::DOUBLE) FROM orders)"
    return union(f"""SELECT sum(o_orderkey)::BIGINT AS key_sum, {rounded('sum(o_totalprice)', 2)} AS price_sum,
        '{role}' AS role FROM orders WHERE o_orderkey {op} {cut}""" for role, op in (("clean", "<"), ("test", ">=")))


VIEW_JOIN = """SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_mktsegment
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey LIMIT 50"""

BOUNDED_SQL = """SELECT * FROM (
    SELECT c_nationkey, c_mktsegment, count(*) AS nb_orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_nationkey, c_mktsegment ORDER BY c_nationkey, c_mktsegment)"""


# --- corruption ---------------------------------------------------------------------------------------------

def _flat(table: str, changes: dict[str, str], extra: str = "", source: str | None = None) -> str:
    """All columns of a table, timestamps as text, some replaced."""
    columns = []
    for c, kind in SCHEMA[table].items():
        if c in changes:
            columns.append(f"{changes[c]} AS {c}")
        elif kind == TIME:
            columns.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}")
        else:
            columns.append(c)
    return f"SELECT {', '.join(columns)}{', ' + extra if extra else ''} FROM {source or table}"


def inject_wrong_datatype() -> str:
    hit = f"{u('type', 'p_partkey')} < 0.3"
    value = f"printf('%.5f', round({u('type', 'p_partkey', slot=1)}, 5))"
    return _flat("part", {"p_size": f"CASE WHEN {hit} THEN {value} ELSE p_size::VARCHAR END"},
                 f"CASE WHEN {hit} THEN 'float' WHEN p_size IS NOT NULL THEN 'int' END AS p_size__type, {hit} AS hit")


def inject_wrong_datatype_dates() -> str:
    hit = f"{u('type', 'o_orderkey')} < 0.3"
    date = """strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(floor(place * (18627 * 86400)
        / greatest(total - 1, 1)::DOUBLE)::BIGINT), '%Y-%m-%d %H:%M:%S')"""
    source = f"""(SELECT *, {hit} AS hit, row_number() OVER (PARTITION BY {hit} ORDER BY o_orderkey) - 1 AS place,
        count(*) OVER (PARTITION BY {hit}) AS total FROM orders)"""
    return _flat("orders", {"o_orderstatus": f"CASE WHEN hit THEN {date} ELSE o_orderstatus END"},
                 """CASE WHEN hit THEN 'datetime' WHEN o_orderstatus IS NOT NULL THEN 'str' END
                    AS o_orderstatus__type, hit""", source)


def inject_null() -> str:
    hit = f"({u('null', 'o_orderkey')} < 0.3 AND o_totalprice IS NOT NULL)"
    return _flat("orders", {"o_totalprice": f"CASE WHEN NOT {hit} THEN o_totalprice END"}, f"{hit} AS hit")


def inject_duplicate_rows() -> str:
    source = f"(SELECT * FROM orders, range(0, 2) r(i) WHERE i = 0 OR {u('copy', 'o_orderkey')} < 0.15)"
    return _flat("orders", {"o_orderkey": "CASE WHEN i = 1 THEN -1 - o_orderkey ELSE o_orderkey END"},
                 "i = 1 AS hit", source)


def _orphan_ctes() -> str:
    edits = ", ".join(str(e) for e in CANDIDATE_EDITS)
    draws = ", ".join(f"{u('orphan', 't', 'n', slot=s)} AS u{s}" for s in range(3))
    return f"""WITH ks AS (SELECT DISTINCT o_custkey AS k, o_custkey::VARCHAR AS t FROM orders
            WHERE {u('orphan', 'o_orderkey')} < 0.2 AND o_custkey IS NOT NULL),
        tries AS (SELECT k, t, n, length(t) AS room, [{edits}][n + 1] AS e, {draws}
            FROM ks, range(0, {len(CANDIDATE_EDITS)}) r(n)),
        spots AS (SELECT *, floor(u1 * room)::INT AS i1, floor(u2 * (room - 1))::INT AS i2 FROM tries),
        places AS (SELECT *, least(i1, (i1 + 1 + i2) % room) + 1 AS a, greatest(i1, (i1 + 1 + i2) % room) + 1 AS b,
            lpad(floor(u2 * power(10, e))::BIGINT::VARCHAR, e, '0') AS added FROM spots),
        forms AS (SELECT k, n, (CASE WHEN e = 1 AND u0 < 0.5 AND room > 1
            THEN substr(t, 1, a - 1) || substr(t, b, 1) || substr(t, a + 1, b - a - 1) || substr(t, a, 1) || substr(t, b + 1)
            ELSE substr(t, 1, i1) || added || substr(t, i1 + 1) END)::BIGINT AS f FROM places),
        free AS (SELECT k, arg_min(f, n) AS f FROM forms
            WHERE f <> k AND f NOT IN (SELECT c_custkey FROM customer) GROUP BY k),
        mapping AS (SELECT ks.k, coalesce(free.f, greatest(ks.k, (SELECT max(c_custkey) FROM customer)) + 1) AS f
            FROM ks LEFT JOIN free ON ks.k = free.k)
        """


def inject_orphan_fk() -> str:
    source = f"""(SELECT orders.*, {u('orphan', 'o_orderkey')} < 0.2 AND o_custkey IS NOT NULL AS hit, f
        FROM orders LEFT JOIN mapping ON mapping.k = o_custkey)"""
    return _orphan_ctes() + _flat("orders", {"o_custkey": "CASE WHEN hit THEN f ELSE o_custkey END"}, "hit", source)


def inject_new_category() -> str:
    hit = f"{u('label', 'c_custkey')} < 0.25"
    return _flat("customer", {"c_mktsegment": f"CASE WHEN {hit} THEN 'UNKNOWN' ELSE c_mktsegment END"}, f"{hit} AS hit")


def _permuted(source: str, rate: float, key: str) -> str:
    """p_retailprice moved along a random cycle of the picked rows."""
    hit = f"{u('pair', key)} < {rate}"
    order = f"md5('pair:' || {key}::VARCHAR), {key}"
    return f"""(SELECT * REPLACE (CASE WHEN hit THEN coalesce(after_it, first_it)[1] ELSE p_retailprice END AS p_retailprice)
        FROM (SELECT *, lead([p_retailprice]) OVER (PARTITION BY hit ORDER BY {order}) AS after_it,
                     first_value([p_retailprice]) OVER (PARTITION BY hit ORDER BY {order}) AS first_it
              FROM (SELECT *, {hit} AS hit FROM {source})))"""


def inject_correlation_break() -> str:
    return _flat("part", {}, "hit", _permuted("part", 0.6, "p_partkey"))


def _part_stats(column: str) -> str:
    x = f"{column}::DOUBLE"
    return f"""(SELECT {rounded(f'stddev_samp({x})')} AS std, {rounded(f'min({x})')} AS low, {rounded(f'max({x})')} AS high
        FROM part)"""


def inject_distribution_shift(column: str, sizes: float, sign: str, whole: bool) -> str:
    hit = f"({u('shift', 'p_partkey')} < 0.4 AND {column} IS NOT NULL)"
    kept = "least(greatest(moved, low), high)"
    value = f"round_even({kept}, 0)::INT" if whole else kept
    source = f"""(SELECT part.*, low, high, {hit} AS hit, {column}::DOUBLE + {sign} * ({sizes} * std) AS moved
        FROM part, {_part_stats(column)})"""
    return _flat("part", {column: f"CASE WHEN hit THEN {value} ELSE {column} END"},
                 f"hit AND {kept} <> moved AS hit_clamped, hit", source)


def inject_duplicate_pk() -> str:
    hit = f"{u('donor', 'o_orderkey')} < 0.2"
    source = f"""(SELECT o.*, d.k AS donor FROM (
            SELECT *, {hit} AS hit, floor({u('donor', 'o_orderkey', slot=1)} * total)::BIGINT AS pick
            FROM orders, (SELECT count(*) AS total FROM (SELECT DISTINCT o_orderkey FROM orders WHERE NOT {hit}))) o
        LEFT JOIN (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS n
            FROM (SELECT DISTINCT o_orderkey FROM orders WHERE NOT {hit})) d ON d.n = o.pick)"""
    return _flat("orders", {"o_orderkey": "CASE WHEN hit THEN donor ELSE o_orderkey END"},
                 "o_orderkey AS row_id, hit", source)


def inject_out_of_range(column: str, whole: bool) -> str:
    hit = f"({u('range', 'p_partkey')} < 0.04 AND {column} IS NOT NULL)"
    below, distance = f"{u('range', 'p_partkey', slot=1)} < 0.5", (
        f"(0.05::DOUBLE + 0.95::DOUBLE * {u('range', 'p_partkey', slot=2)}) * (0.25 * (high - low))")
    low, high = f"low - {distance}", f"high + {distance}"
    if whole:
        value, old = f"(CASE WHEN {below} THEN floor({low}) ELSE ceil({high}) END)::BIGINT", f"{column}::BIGINT"
    else:
        value, old = f"CASE WHEN {below} THEN {low} ELSE {high} END", column
    return _flat("part", {column: f"CASE WHEN {hit} THEN {value} ELSE {old} END"},
                 f"{hit} AND {below} AS hit_below, {hit} AS hit", f"part, {_part_stats(column)}")


# --- detection --------------------------------------------------------------------------------------------------

def _sides(table: str, key: str) -> str:
    first = f"{u(SPLIT_SEED, key)} < {CLEAN_SHARE}"
    return f"""WITH clean AS (SELECT *, {key} AS row_id FROM {table} WHERE {first}),
        fresh AS (SELECT *, {key} AS row_id FROM {table} WHERE NOT {first})"""


def _finding(table: str, column: str, anomaly: str, calibration: str, current: str, affected: str, rows: str,
             source: str, found: str) -> str:
    share = f"({affected}) / ({rows})::DOUBLE"
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", '{anomaly}' AS anomaly,
        {calibration} AS calibration, {current} AS current, ({affected})::BIGINT AS nb_rows_affected,
        CASE WHEN {share} < 0.01 THEN 'Medium' WHEN {share} < 0.1 THEN 'High' ELSE 'Critical' END AS severity
        FROM {source} WHERE {found}"""


def _number(x: str) -> str:
    return f"printf('%.4f', round({x}, 4))"


def detect_wrong_datatype() -> str:
    return _sides("part", "p_partkey") + _finding(
        "part", "p_size", "wrong_datatype", "'int'", "'other types'", "n", "total",
        f"(SELECT count(*) FILTER ({u('type', 'row_id')} < 0.3) AS n, count(*) AS total FROM fresh)", "n > 0")


def detect_insert_null() -> str:
    return _sides("orders", "o_orderkey") + _finding(
        "orders", "o_totalprice", "insert_null", "'0'", "n::VARCHAR", "n", "total",
        f"(SELECT count(*) FILTER ({u('null', 'row_id')} < 0.3) AS n, count(*) AS total FROM fresh)", "n > 0")


def detect_duplicate_rows() -> str:
    rows = f"SELECT fresh.* FROM fresh, range(0, 2) r(i) WHERE i = 0 OR {u('copy', 'row_id')} < 0.15"
    return _sides("orders", "o_orderkey") + f", batch AS ({rows})" + _finding(
        "orders", "", "duplicate_rows", "'0'", "n::VARCHAR", "n", "total",
        "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM batch)) AS n, count(*) AS total FROM batch)",
        "n > 0")


def detect_insert_column() -> str:
    return _sides("customer", "c_custkey") + _finding(
        "customer", "c_mktsegment", "insert_column", "''", "'NEW_c_mktsegment'", "total", "total",
        "(SELECT count(*) AS total FROM fresh)", "true")


def detect_orphan_foreign_key() -> str:
    # every customer key that stays a customer key is covered; the profile's coverage is 1 over all links
    child = f"CASE WHEN {u('orphan', 'row_id')} < 0.2 THEN o_custkey + 1000000 ELSE o_custkey END"
    return _sides("orders", "o_orderkey") + f", batch AS (SELECT {child} AS k FROM fresh)" + _finding(
        "orders", "o_custkey", "orphan_foreign_key", "'1.0000'", _number("1 - n / total::DOUBLE"), "n", "total",
        """(SELECT count(*) FILTER (k NOT IN (SELECT c_custkey FROM customer)) AS n, count(*) AS total FROM batch)""",
        "n > 0")


def detect_new_category() -> str:
    label = f"CASE WHEN {u('label', 'row_id')} < 0.25 THEN 'UNKNOWN' ELSE c_mktsegment END"
    return _sides("customer", "c_custkey") + f", batch AS (SELECT {label} AS v FROM fresh)" + _finding(
        "customer", "c_mktsegment", "new_category",
        "(SELECT count(DISTINCT c_mktsegment) FROM clean)::VARCHAR || ' labels'", "'unknown labels'", "n", "total",
        """(SELECT count(*) FILTER (v NOT IN (SELECT c_mktsegment FROM clean)) AS n, count(*) AS total FROM batch)""",
        "n > 0")


def detect_correlation_break() -> str:
    def z(x: str) -> str:
        return f"atanh(least(greatest({x}, -0.999999::DOUBLE), 0.999999::DOUBLE))"

    numbers = ("p_partkey", "p_size", "p_retailprice")
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1:]]
    parts = []
    for a, b in pairs:
        source = f"""(SELECT (SELECT {rounded(f'corr({a}::DOUBLE, {b}::DOUBLE)')} FROM clean) AS r0,
            (SELECT count(*) FROM clean) AS n0, corr({a}::DOUBLE, {b}::DOUBLE) AS r1, count(*) AS n FROM batch)"""
        distance = f"abs({z('r1')} - {z('r0')}) / sqrt(1 / (n - 3)::DOUBLE + 1 / (n0 - 3)::DOUBLE)"
        parts.append(_finding(
            "part", "", "correlation_break", f"'{a} & {b}: ' || {_number('r0')}", f"'{a} & {b}: ' || {_number('r1')}",
            "n", "n", source, f"abs(r0) >= 0.3 AND n > 3 AND {distance} > {MAX_FISHER_DISTANCE}"))
    return (_sides("part", "p_partkey") + f", batch AS {_permuted('fresh', 0.9, 'row_id')}\n" + union(parts))


def detect_duplicate_primary_key() -> str:
    hit = f"{u('donor', 'row_id')} < 0.2"
    donors = f"SELECT DISTINCT o_orderkey FROM fresh WHERE NOT {hit}"
    batch = f"""SELECT * REPLACE (CASE WHEN {u('reuse', 'row_id')} < 0.1 THEN o_orderkey - 1 ELSE o_orderkey END
            AS o_orderkey) FROM (
        SELECT f.* EXCLUDE (pick) REPLACE (CASE WHEN {hit} THEN d.k ELSE o_orderkey END AS o_orderkey) FROM (
            SELECT *, floor({u('donor', 'row_id', slot=1)} * (SELECT count(*) FROM ({donors})))::BIGINT AS pick
            FROM fresh) f
        LEFT JOIN (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM ({donors})) d
            ON d.n = f.pick)"""
    return _sides("orders", "o_orderkey") + f""", batch AS ({batch}),
        held AS (SELECT o_orderkey AS k, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM batch) GROUP BY 1)""" + (
        _finding("orders", "o_orderkey", "duplicate_primary_key", "'unique'", "n::VARCHAR", "n", "total",
                 """(SELECT sum(CASE WHEN k IN (SELECT o_orderkey FROM clean) THEN n ELSE n - 1 END) AS n,
                     (SELECT count(*) FROM batch) AS total FROM held)""", "n > 0"))


_PRICE_STATS = f"""stats AS (SELECT {rounded('avg(o_totalprice)')} AS mean, {rounded('stddev_samp(o_totalprice)')} AS std,
    {rounded('min(o_totalprice)')} AS low, {rounded('max(o_totalprice)')} AS high, count(*) AS n0,
    count(DISTINCT o_totalprice) = count(*) AS is_key FROM clean)"""


def detect_distribution_shift() -> str:
    moved = f"""CASE WHEN {u('shift', 'row_id')} < 0.6 THEN least(greatest(o_totalprice + 1.0 * (1.5 * std), low), high)
        ELSE o_totalprice END"""
    drift = f"abs(ln(s / std)) * sqrt(2 * (n - 1)) > {MAX_Z}"
    found = f"""NOT is_key AND n >= {MIN_ROWS_FOR_SHIFT} AND ((abs(m - mean) / std * sqrt(n) > {MAX_Z} AND abs(m - mean) / std >= {MIN_EFFECT})
        OR (s / std NOT BETWEEN {STD_RATIO[0]} AND {STD_RATIO[1]} AND {drift}))"""
    # columns that are keys are never looked at, which at small scale takes in the price
    parts = []
    for c, value in (("o_totalprice", "x"), ("o_custkey", "o_custkey::DOUBLE")):
        stats = _PRICE_STATS.replace("o_totalprice", c).replace("stats AS ", "")
        source = f"""(SELECT any_value(p.mean) AS mean, any_value(p.std) AS std, any_value(is_key) AS is_key, count(v) FILTER (inside) AS n,
            avg(v) FILTER (inside) AS m, stddev_samp(v) FILTER (inside) AS s, count(*) AS total FROM (
            SELECT {value} AS v, {value} BETWEEN low AND high AS inside, p.* FROM batch, {stats} p) p)"""
        parts.append(_finding(
            "orders", c, "distribution_shift", f"'mean ' || {_number('mean')} || ' std ' || {_number('std')}",
            f"'mean ' || {_number('m')} || ' std ' || {_number('s')}", "n", "total", source, found))
    return (_sides("orders", "o_orderkey") + f", {_PRICE_STATS}, batch AS (SELECT fresh.*, {moved} AS x FROM fresh, stats)\n"
            + union(parts))


def detect_out_of_range() -> str:
    distance = f"(0.05::DOUBLE + 0.95::DOUBLE * {u('range', 'row_id', slot=2)}) * (0.25 * (high - low))"
    value = f"""CASE WHEN {u('range', 'row_id')} < 0.05 THEN CASE WHEN {u('range', 'row_id', slot=1)} < 0.5
        THEN low - {distance} ELSE high + {distance} END ELSE o_totalprice END"""
    parts = []
    for c, x in (("o_totalprice", "x"), ("o_custkey", "o_custkey::DOUBLE")):
        stats = _PRICE_STATS.replace("o_totalprice", c).replace("stats AS ", "")
        source = f"""(SELECT any_value(low) AS low, any_value(high) AS high, any_value(n0) AS n0,
            any_value(is_key) AS is_key, min(v) AS bl, max(v) AS bh,
            count(*) FILTER (v < low OR v > high) AS n, count(v) AS filled, count(*) AS total FROM (
            SELECT {x} AS v, p.* FROM batch, {stats} p))"""
        expected = "(2 * filled / (n0 + 1)::DOUBLE)"
        parts.append(_finding(
            "orders", c, "out_of_range", f"'[' || {_number('low')} || ', ' || {_number('high')} || ']'",
            f"'[' || {_number('bl')} || ', ' || {_number('bh')} || ']'", "n", "total", source,
            f"NOT is_key AND n > {expected} + 3 * sqrt({expected}) + 1"))
    return (_sides("orders", "o_orderkey") + f", {_PRICE_STATS}, batch AS (SELECT fresh.*, {value} AS x FROM fresh, stats)\n"
            + union(parts))


# --- reconciliation ----------------------------------------------------------------------------------------------

_LOGS = """WITH injected AS (SELECT (user_id % 5)::INT AS run_number, event_id + 1 AS id,
        't' || (user_id % 23)::VARCHAR AS tbl,
        CASE WHEN event_id % 11 = 0 THEN '' ELSE 'c' || (event_id % 37)::VARCHAR END AS col,
        'a' || (event_id % 10)::VARCHAR AS anomaly, (floor(abs(value) * 10) % 50)::BIGINT::VARCHAR AS nb FROM events),
    found AS (SELECT (o_custkey % 5)::INT AS run_number, o_orderkey + 1 AS id, 't' || (o_custkey % 23)::VARCHAR AS tbl,
        CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'c' || (o_orderkey % 41)::VARCHAR END AS col,
        'a' || (o_orderkey % 10)::VARCHAR AS anomaly, (floor(o_totalprice) % 50)::BIGINT::VARCHAR AS nb FROM orders)"""


def _matches(first: str, second: str) -> str:
    return f"""SELECT run_number, id1, id2, nb_rows_affected FROM (
        SELECT a.run_number, a.id AS id1, b.id AS id2, a.nb = b.nb AS nb_rows_affected,
            row_number() OVER (PARTITION BY a.run_number, b.id ORDER BY a.id) AS place
        FROM {first} a JOIN {second} b ON a.run_number = b.run_number AND a.tbl = b.tbl AND a.anomaly = b.anomaly
            AND (a.col = b.col OR a.col = '' OR b.col = '')) WHERE place = 1"""


def reconcile_scores() -> str:
    return f"""{_LOGS}, m AS ({_matches('injected', 'found')}), c AS ({_matches('found', 'injected')})
        SELECT run_number, (SELECT count(*) FROM m WHERE m.run_number = r.run_number) AS matched,
            (SELECT count(*) FROM found f WHERE f.run_number = r.run_number)
                - (SELECT count(*) FROM c WHERE c.run_number = r.run_number) AS false_positives,
            (SELECT count(*) FROM injected i WHERE i.run_number = r.run_number)
                - (SELECT count(*) FROM m WHERE m.run_number = r.run_number) AS not_found
        FROM (SELECT run_number FROM injected UNION SELECT run_number FROM found) r"""


def reconcile_strict() -> str:
    def paired(first: str, second: str, group: str) -> str:
        place = f"row_number() OVER (PARTITION BY {group} ORDER BY id) AS place"
        same = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in group.split(","))
        return f"""SELECT a.run_number, a.id AS id1, b.id AS id2, a.nb = b.nb AS nb_rows_affected
            FROM (SELECT *, {place} FROM {first}) a JOIN (SELECT *, {place} FROM {second}) b
            ON {same} AND a.place = b.place"""

    wide = "run_number, tbl, anomaly"
    return f"""{_LOGS}, same AS ({paired('injected', 'found', wide + ', col')}),
        i2 AS (SELECT * FROM injected WHERE (run_number, id) NOT IN (SELECT (run_number, id1) FROM same)),
        f2 AS (SELECT * FROM found WHERE (run_number, id) NOT IN (SELECT (run_number, id2) FROM same))
        SELECT * FROM same
        UNION ALL {paired("i2 WHERE col = ''", "f2 WHERE col <> ''", wide)}
        UNION ALL {paired("i2 WHERE col <> ''", "f2 WHERE col = ''", wide)}"""


_REPORTS = """WITH reports AS (SELECT (o_orderkey % 7)::INT AS run_number, o_orderkey AS report,
        'Looked at all tables.' || chr(10)
        || CASE WHEN o_orderkey % 29 = 0 THEN 'no section' || chr(10) ELSE '### **OUTPUT**' || chr(10) END
        || 'orders_new_data | o_custkey | insert_null | 0 | ' || o_custkey::VARCHAR || ' | ' || o_orderkey::VARCHAR
        || ' | ' || o_orderpriority || ' '
        || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'customer |  | duplicate_rows | 0 | ' || o_orderstatus
            || ' | 4 | High' ELSE '' END
        || CASE WHEN o_orderkey % 17 = 0 THEN chr(10) || 'no anomaly | here' ELSE '' END
        || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || chr(10) || '### **FEEDBACK**' || chr(10) || 'more tools'
            || chr(10) || chr(10) || '  run ' || o_orderkey::VARCHAR || ' ' ELSE '' END AS text FROM orders),
    sections AS (SELECT run_number, report, split_part(text, '### **FEEDBACK**', 1) AS body,
        contains(text, '### **FEEDBACK**') AS has_feedback, split_part(text, '### **FEEDBACK**', 2) AS feedback
        FROM reports WHERE contains(text, '**OUTPUT**')),
    raw_lines AS (SELECT run_number, report,
        string_split(trim(split_part(body, '**OUTPUT**', 2), ' ' || chr(9) || chr(10) || chr(13)), chr(10)) AS ls
        FROM sections),
    lines AS (SELECT run_number, report, unnest(range(0, len(ls)))::INT AS line_no, unnest(ls) AS line FROM raw_lines),
    parsed AS (SELECT *, list_transform(string_split(line, '|'), lambda f: trim(f, ' ' || chr(9) || chr(10) || chr(13)))
        AS fields FROM lines)"""


def parse_reports() -> str:
    return f"""{_REPORTS}
        SELECT run_number, report, line_no, replace(fields[1], '_new_data', '') AS "table", fields[2] AS "column",
            fields[3] AS anomaly, fields[4] AS calibration, fields[5] AS current, fields[6] AS nb_rows_affected,
            fields[7] AS severity, row_number() OVER (PARTITION BY run_number ORDER BY report, line_no) AS id
        FROM parsed WHERE len(fields) >= 7"""


def rejected_lines() -> str:
    return f"{_REPORTS} SELECT run_number, report, line_no, line FROM parsed WHERE len(fields) < 7"


def feedback_lines() -> str:
    return f"""{_REPORTS}, split_up AS (SELECT run_number, report, string_split(feedback, chr(10)) AS ls FROM sections
            WHERE has_feedback)
        SELECT run_number, report, line_no, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (
            SELECT run_number, report, unnest(range(0, len(ls)))::INT AS line_no, unnest(ls) AS line FROM split_up)
        WHERE line <> ''"""


def usage_cost() -> str:
    prices = ", ".join(f"('{m}', {', '.join(f'{p}::DOUBLE' for p in ps)})" for m, ps in PRICE_TIERS.items())
    names = ", ".join(f"price_{k}" for k in TOKEN_KINDS)
    cost = " + ".join(f"{k} * price_{k}" for k in TOKEN_KINDS)
    sums = ", ".join(f"sum({k})::BIGINT AS {k}" for k in TOKEN_KINDS)
    return f"""WITH usage AS (SELECT 'tier_' || (event_id % 3 + 1)::VARCHAR AS model, strftime(ts, '%Y-%m-%d') AS day,
            user_id * 10 + 500 AS total_input_tokens, event_id % 700 AS total_output_tokens,
            event_id % 90 * 40 AS total_cache_read, event_id % 45 * 20 AS total_cache_written FROM events),
        totals AS (SELECT model, day, {sums} FROM usage GROUP BY model, day)
        SELECT model, day, {', '.join(TOKEN_KINDS)}, {rounded(f'({cost}) / 1000000')} AS total_cost_usd
        FROM totals JOIN (VALUES {prices}) p(model, {names}) USING (model)"""


def statements() -> dict[str, str]:
    """SQL by query name. Clusters, wider components, rounds and saved profiles have no SQL twin."""
    found = {f.__name__: f() for f in (
        split_counts, split_keys, table_profile, column_types, column_profile, null_profile, primary_keys,
        primary_key_columns, category_distribution, numeric_distribution, datetime_distribution,
        string_distribution, datetime_strings, correlations, cramers_v, correlation_ratio, fk_coverage,
        pair_coverage, foreign_keys, referenced_keys, numerical_columns, categorical_columns,
        disguised_missing, ml_row_counts, pca_2col, pca_power_sums, inject_wrong_datatype, inject_wrong_datatype_dates,
        inject_null, inject_duplicate_rows, inject_orphan_fk, inject_new_category, inject_correlation_break,
        inject_duplicate_pk, detect_wrong_datatype, detect_insert_null, detect_duplicate_rows,
        detect_insert_column, detect_orphan_foreign_key, detect_new_category, detect_correlation_break,
        detect_duplicate_primary_key, detect_distribution_shift, detect_out_of_range, reconcile_scores,
        reconcile_strict, parse_reports, rejected_lines, feedback_lines, usage_cost)}
    found.update(
        view_join=VIEW_JOIN, bounded_sql=BOUNDED_SQL, whole_column="SELECT c_name FROM customer",
        inject_new_column=_flat("customer", {}, "c_mktsegment AS NEW_c_mktsegment, true AS hit"),
        inject_distribution_shift=inject_distribution_shift(
            "p_retailprice", 1.5, f"(CASE WHEN {u('shift', 'p_partkey', slot=1)} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)",
            False),
        inject_distribution_shift_int=inject_distribution_shift("p_size", 0.5, "1.0::DOUBLE", True),
        inject_out_of_range=inject_out_of_range("p_retailprice", False),
        inject_out_of_range_int=inject_out_of_range("p_size", True),
        reconcile_matches=f"{_LOGS} {_matches('injected', 'found')}",
        reconcile_claims=f"{_LOGS} {_matches('found', 'injected')}")
    return found
