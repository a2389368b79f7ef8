"""DuckDB SQL twins of the fixture tables and shared CTEs for ``oracle_sql()``.

Used only for checking: each registered query has an independent SQL
formulation over the same Parquet tables (pre-registered views ``lineitem``,
``part``, ``pages``, ``documents`` ...). ``with_ctes(body, 'bars', ...)``
prepends the CTEs a body needs, dependencies first.
"""

from __future__ import annotations

from ..functions import constants as K

# name -> (dependencies, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


cte("bars", (), """
SELECT 'B' || substr(p.p_brand, 7) AS ticker,
       CAST(l.l_shipdate AS DATE) AS date,
       arg_min(l.l_extendedprice, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) AS open,
       max(l.l_extendedprice) AS high,
       min(l.l_extendedprice) AS low,
       arg_max(l.l_extendedprice, (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) AS close,
       sum(l.l_quantity) AS volume
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2""")

cte("headlines", (), """
SELECT ticker, date,
       CAST(date AS TIMESTAMP) + to_seconds((relevancy * 7919) % 86400) AS published_at,
       title, source, lang, relevancy
FROM (
  SELECT 'B' || CAST(page_id % 25 + 1 AS VARCHAR) AS ticker,
         DATE '2001-11-04' - CAST(page_id % 60 AS INTEGER) AS date,
         trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
         'pages' AS source, 'en' AS lang, page_id AS relevancy
  FROM pages
  UNION ALL
  SELECT 'B' || CAST(doc_id % 25 + 1 AS VARCHAR),
         DATE '2001-11-04' - CAST((doc_id // 25) % 60 AS INTEGER),
         trim(split_part(text, chr(10), 1)), 'documents', lang, doc_id
  FROM documents)""")

cte("requests", ("bars",), """
SELECT id + more AS request_id,
       'https://quotes.example.com/quote/' || ticker ||
         CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '/' ELSE '?p=x' END AS url,
       CAST(1 + (id * 13 + more) % 95 AS INTEGER) AS prediction_days
FROM (SELECT DISTINCT ticker, CAST(substr(ticker, 2) AS BIGINT) AS id FROM bars), (VALUES (0), (1017)) AS x(more)
UNION ALL
SELECT 0, 'https://quotes.example.com/quote/NOSUCH', 5
UNION ALL
SELECT 5000, 'https://quotes.example.com/quote/BAD TICKER|x', 5""")


def _ingest_sql(src: str, months: int | None) -> str:
    cut = f"WHERE date > (SELECT max(date) FROM {src}) - INTERVAL {months} MONTH" if months else ""
    return f"""
SELECT * FROM (
  SELECT ticker, date, open, high, low, close, volume,
         CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS ma_20
  FROM {src}
  {cut}
  WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WHERE ma_20 IS NOT NULL"""


cte("prices5y", ("bars",), _ingest_sql("bars", 60))
cte("prices2y", ("bars",), _ingest_sql("bars", 24))
cte("prices3mo", ("bars",), _ingest_sql("bars", 3))
cte("prices_all", ("bars",), _ingest_sql("bars", None))

# one row per ticker, closes ordered by date
cte("series5y", ("prices5y",), """
SELECT ticker, list(close ORDER BY date) AS closes, list(date ORDER BY date) AS dates,
       min(date) AS first_date, max(date) AS last_date
FROM prices5y GROUP BY ticker""")

cte("series_all", ("prices_all",), """
SELECT ticker, list(close ORDER BY date) AS closes FROM prices_all GROUP BY ticker""")


def _window(start0: str, length: str) -> str:
    return f"closes[{start0} + 1 : {start0} + {length}]"


def window_mean_sql(start0: str, length: str) -> str:
    return f"(CAST(list_sum(list_transform({_window(start0, length)}, lambda x: CAST(x AS DECIMAL(18, 4)))) AS DOUBLE) / {length})"


def window_std_sql(start0: str, length: str) -> str:
    return f"list_aggregate({_window(start0, length)}, 'stddev_samp')"


cte("vol2y", ("prices2y",), f"""
SELECT ticker, CAST(count(*) AS BIGINT) AS n,
       stddev_samp(CASE WHEN prev <> 0 THEN close / prev - 1 END) * sqrt({K.TRADING_DAYS_PER_YEAR}) AS volatility,
       count(*) FILTER (WHERE prev = 0 AND close <> 0) AS n_inf
FROM (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM prices2y)
GROUP BY ticker""")

cte("volatility", ("vol2y",), f"""
SELECT ticker, n, volatility FROM vol2y
WHERE n >= {K.MIN_ROWS_FOR_VOLATILITY} AND volatility IS NOT NULL AND NOT isnan(volatility) AND n_inf = 0""")

cte("portfolio", ("volatility",), f"""
SELECT CAST(row_number() OVER (ORDER BY side DESC, volatility DESC, ticker ASC) - 1 AS BIGINT) AS pos,
       side, ticker, volatility
FROM (
  (SELECT 'volatile' AS side, ticker, volatility FROM volatility WHERE volatility > 0
   ORDER BY volatility DESC, ticker ASC LIMIT {K.NUM_VOLATILE})
  UNION ALL
  (SELECT 'stable' AS side, ticker, volatility FROM volatility WHERE volatility > 0
   ORDER BY volatility ASC, ticker DESC LIMIT {K.NUM_STABLE}))""")


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------------------
# SQL text helpers (DuckDB)
# ---------------------------------------------------------------------------

def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render_sql(template: str, **exprs: str) -> str:
    """``{name}`` template -> ``'lit' || (expr) || ...`` (DuckDB)."""
    import string

    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(sql_lit(literal))
        if field:
            parts.append(f"({exprs[field]})")
    return " || ".join(parts)


def fmt2_sql(x: str) -> str:
    return f"coalesce(printf('%.2f', {x}), 'nan')"


def list_text_sql(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda x: printf('%.2f', x)), ', ')"


def mean_sql(arr: str) -> str:
    return f"list_avg({arr})"


def std_sql(arr: str) -> str:
    return f"list_aggregate({arr}, 'stddev_samp')"


def bucket_sql(seed: str, *parts: str, start: int = 1) -> str:
    joined = " || '|' || ".join([sql_lit(seed)] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"('0x' || substr(md5({joined}), {start}, 8))::BIGINT"


TICKER_SQL = ("list_filter(string_split(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), "
              "'^[a-zA-Z]+://[^/]*', ''), '/'), lambda x: x <> '')[-1]")


def drift_list_sql(last: str, k: str) -> str:
    """Stand-in drift prices (formatted) for ``k`` steps from ``last``."""
    return (f"list_transform(range(1, greatest({k}, 1) + 1), lambda j: printf('%.2f', {last} * "
            f"(CAST(1.0 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (((j * 7) % 5) - 2))))")


# a URL with a blank or a bar is none: no ticker
cte("rq", ("requests",), f"SELECT *, CASE WHEN NOT regexp_matches(url, '[ |]') THEN {TICKER_SQL} END AS ticker FROM requests")

cte("responses", ("rq", "series5y"), f"""
SELECT request_id,
       'PREDICTION:' || CASE WHEN request_id % 5 = 4 THEN ' I cannot forecast this stock.'
            WHEN request_id % 5 = 3 THEN ' Sure. Here is my forecast:  [' || array_to_string(pl, ', ') || '] -- hope this helps.'
            ELSE ' [' || array_to_string(pl, ', ') || ']' END AS text
FROM (SELECT r.request_id, {drift_list_sql('s.closes[-1]', '''CASE WHEN r.request_id % 5 = 1 THEN r.prediction_days + 3
                 WHEN r.request_id % 5 = 2 THEN greatest(r.prediction_days // 2, 1)
                 WHEN r.request_id % 5 = 4 THEN 0 ELSE r.prediction_days END''')} AS pl
      FROM rq r JOIN series5y s ON r.ticker = s.ticker)""")
