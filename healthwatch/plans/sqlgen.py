"""Small SQL-text builders shared by the oracle strings (DuckDB dialect)."""

from __future__ import annotations

from healthwatch.functions.fields import NUMERIC_FIELDS

DBL = "CAST({} AS DOUBLE)"


def melt(view: str, fields: list[str] | None = None, ids: tuple[str, ...] = (),
         flag: str | None = None) -> str:
    """UNION ALL unpivot of ``view`` to ``(ids..., field, v[, flag])`` without NULL values."""
    fields = fields or NUMERIC_FIELDS
    idl = "".join(f"{i}, " for i in ids)
    fl = f", {flag}" if flag else ""
    return "\nUNION ALL ".join(
        f"SELECT {idl}'{f}' AS field, CAST({f} AS DOUBLE) AS v{fl} FROM {view} WHERE {f} IS NOT NULL"
        for f in fields)


def stats_cte(view: str = "base", fields: list[str] | None = None) -> str:
    """``st(field, mean, std)`` rounded to 4 digits, as the baseline stores them."""
    return (f"bs AS ({melt(view, fields)}),\n"
            "st AS (SELECT field, ROUND(AVG(v), 4) AS mean, ROUND(STDDEV_POP(v), 4) AS std "
            "FROM bs GROUP BY field)")


def z_cte(view: str = "inc", ids: tuple[str, ...] = ("event_id",), fields: list[str] | None = None) -> str:
    """``zl(ids..., field, v, z)``: per present field z-score against ``st``."""
    idl = ", ".join(f"l.{i}" for i in ids)
    return (f"il AS ({melt(view, fields, ids=ids)}),\n"
            f"zl AS (SELECT {idl}, l.field, l.v, CASE WHEN st.std = 0 THEN CAST(0 AS DOUBLE) "
            "ELSE ABS((l.v - st.mean) / st.std) END AS z FROM il l JOIN st ON l.field = st.field)")


def ks_p(lam: str) -> str:
    """Asymptotic Kolmogorov p-value series (k = 1..100), 1 when lambda < 0.3."""
    return (f"CASE WHEN {lam} < CAST(0.3 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 2 * list_sum(list_transform(range(1, 101), "
            f"lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * EXP(-2 * k * k * {lam} * {lam}))) END")


VITALS_COLUMNS = ["event_id", "patient_id", "ward", "heart_rate", "bp_systolic", "bp_diastolic",
                  "spo2", "temperature_c", "respiratory_rate", "diagnosis_code", "ts"]


def present_list(columns: list[str] | None = None, rename: dict | None = None) -> str:
    """DuckDB list of the non-null column names (``ts`` named ``timestamp``)."""
    columns = columns or VITALS_COLUMNS
    rename = {"ts": "timestamp"} if rename is None else rename
    items = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{rename.get(c, c)}' END" for c in columns)
    return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"


def sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def contract_cols(present: str, ver: str, fields: list[str]) -> str:
    """``miss_<v>, extra_<v>, d_<v>, rate_<v>`` for one contract."""
    lst = sql_list(fields)
    n = len(set(fields))
    miss = f"list_sort(list_filter({lst}, lambda x: NOT list_contains({present}, x)))"
    extra = f"list_sort(list_filter({present}, lambda x: NOT list_contains({lst}, x)))"
    return (f"{miss} AS miss_{ver}, {extra} AS extra_{ver}, "
            f"ROUND(CAST(len({miss}) + len({extra}) AS DOUBLE) / ({n} + len({extra})), 4) AS d_{ver}, "
            f"ROUND(CAST(len(list_filter({lst}, lambda x: list_contains({present}, x))) AS DOUBLE) / {n}, 4) AS rate_{ver}")


def joined(lst: str) -> str:
    """Comma-joined list, NULL when empty (matches ``join_or_null``)."""
    return f"CASE WHEN len({lst}) > 0 THEN array_to_string({lst}, ',') END"
