"""Registration of queries with their oracle SQL, and the common parts of that SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the oracles, by name; each may use those before it.
PARTS = {
    "tx": """SELECT l_orderkey AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code, p_name AS description, p_brand AS brand,
        CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_extendedprice / l_quantity AS price,
        CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS sales_amount,
        l_shipdate AS invoice_ts, CAST(l_shipdate AS DATE) AS date, o_custkey AS customer_id, n_name AS country,
        p_brand || '-' || CAST(p_size AS VARCHAR) AS line
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "daily": "SELECT description AS sku, date, round(sum(sales_amount), 2) AS y FROM tx GROUP BY 1, 2",
    "spine": "SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily",
    "panel": """SELECT s.sku, d.date, coalesce(y, 0.0) AS y FROM (SELECT DISTINCT sku FROM daily) s CROSS JOIN spine d
        LEFT JOIN daily USING (sku, date)""",
    "cut": "SELECT max(date) - 55 AS test_start FROM daily",
    "train": "SELECT panel.* FROM panel, cut WHERE date < test_start",
    "test": "SELECT panel.* FROM panel, cut WHERE date >= test_start",
    "lines": "SELECT line AS sku, date, round(sum(sales_amount), 2) AS y FROM tx GROUP BY 1, 2",
    "line_panel": """SELECT s.sku, d.date, coalesce(y, 0.0) AS y FROM (SELECT DISTINCT sku FROM lines) s
        CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM lines) d
        LEFT JOIN lines USING (sku, date)""",
    "naive": """SELECT t.sku, t.date, t.y, greatest(coalesce(h.y, 0), 0) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY date) AS h FROM test) t
        LEFT JOIN (SELECT sku, y, 8 - row_number() OVER (PARTITION BY sku ORDER BY date DESC) AS k FROM train QUALIFY k >= 1) h
        ON h.sku = t.sku AND h.k = (t.h - 1) % 7 + 1""",
    "periods": "SELECT date, 'P' || CAST(ntile(4) OVER (ORDER BY date) AS VARCHAR) AS period FROM (SELECT DISTINCT date FROM test)",
    "scored": "SELECT naive.*, period FROM naive JOIN periods USING (date)",
}
NEEDS = {
    "tx": [], "daily": ["tx"], "spine": ["daily"], "panel": ["daily", "spine"], "cut": ["daily"], "train": ["panel", "cut"], "test": ["panel", "cut"],
    "lines": ["tx"], "line_panel": ["lines"], "naive": ["test", "train"], "periods": ["test"], "scored": ["naive", "periods"],
}


def with_parts(*names: str) -> str:
    """A WITH clause of the named parts and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in order) + " "


def query(sql: str | None = None, parts: str = "") -> Callable[[Callable], Callable]:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with oracle SQL that may use parts."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            head = with_parts(*parts.split()) if parts else ""
            ORACLES[function.__name__] = head + (", " + sql.strip()[5:] if head and sql.strip()[:5].upper() == "WITH " else sql)
        return function

    return register
