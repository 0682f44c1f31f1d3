"""Plain SQL for the queries of the catalogue, written independently of them.

The SQL favours definitions over speed: global windows, all-pairs distances and
range joins, which are fine on the small tables it is meant for.
"""

from __future__ import annotations

from collections.abc import Sequence

from patronlens.operators.clustering import Centers
from patronlens.operators.distributions import FUNNEL_STAGES
from patronlens.plans.catalogue import ROBUST_CENTERS, STANDARD_CENTERS, diagonal_centers

# What the reports are to say, written out apart from the code that says it.
RANKED_TEXTS = [
    ("Champions", "keep: ask what they would miss, and never let their favourites run out of stock"),
    ("Loyal", "extend: offer the category that goes with what they buy most"),
    ("New", "learn: find out what brought them before writing to them again"),
    ("Hibernating", "decide: send one message; stop mailing those who do not open it"),
]
RULED_TEXTS = [
    ("Champions", "mean spend above the third quartile, last purchase before the first quartile of days",
     "reserve stock ahead of launches; ask for reviews"),
    ("At-Risk VIP", "mean spend above the third quartile, last purchase after the third quartile of days",
     "check open complaints and returns first; write from a named person; note the reason for leaving"),
    ("New Customers", "last purchase before the first quartile of days, fewer orders than the median",
     "confirm that the first order was right; show how reordering works"),
    ("Hibernating", "last purchase after the third quartile of days", "one seasonal reminder a year"),
    ("Regular", "none of the other rules", "usual newsletter; watch for a change of rule"),
]

LINES = """
lines AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' || CAST(o_orderkey AS VARCHAR)
              ELSE CAST(o_orderkey AS VARCHAR) END AS "InvoiceNo",
         CAST(l_partkey AS VARCHAR) AS "StockCode", p_name AS "Description",
         l_quantity AS "Quantity", o_orderdate AS "InvoiceDate", p_retailprice AS "UnitPrice",
         o_custkey AS "CustomerID", n_name AS "Country"
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) AS home
    ON o_custkey = c_custkey
)"""

CLEAN = LINES + """,
clean AS (
  SELECT *, "Quantity" * "UnitPrice" AS "TotalPrice" FROM lines
  WHERE "CustomerID" IS NOT NULL AND "InvoiceNo" NOT LIKE 'C%' AND "Quantity" > 0 AND "UnitPrice" > 0
)"""

# The order dates are whole days, so calendar days equal elapsed days.
RFM = CLEAN + """,
rfm AS (
  SELECT "CustomerID",
         CAST(date_diff('day', max("InvoiceDate"),
                        (SELECT max("InvoiceDate") FROM clean) + INTERVAL 1 DAY) AS BIGINT) AS "Recency",
         count(DISTINCT "InvoiceNo") AS "Frequency",
         sum("TotalPrice") AS "Monetary"
  FROM clean GROUP BY "CustomerID"
)"""

EVENT_RFM = """
bought AS (
  SELECT user_id AS "CustomerID", event_id, ts, value FROM events
  WHERE event_type = 'purchase' AND value > 0
),
rfm AS (
  SELECT "CustomerID",
         CAST((epoch_us((SELECT max(ts) FROM bought) + INTERVAL 1 DAY) - epoch_us(max(ts)))
              // 86400000000 AS BIGINT) AS "Recency",
         count(DISTINCT event_id) AS "Frequency",
         sum(value) AS "Monetary"
  FROM bought GROUP BY "CustomerID"
)"""

TOTAL = '"R_Score" + "F_Score" + "M_Score"'
LEVEL = f"""CASE WHEN {TOTAL} <= 6 THEN 'Low' WHEN {TOTAL} <= 9 THEN 'Mid'
            WHEN {TOTAL} <= 12 THEN 'High' ELSE 'Champion' END"""


def _scores(rfm: str, recency: str = "{}") -> str:
    """Scores from quantile edges (distinct ones) and from ranks; ``recency`` may turn R around."""
    r = f"""1 + (SELECT count(*) FROM (SELECT DISTINCT unnest(e.r[2:5]) AS edge) AS x
                 WHERE edge > e.r[1] AND edge < e.r[6] AND "Recency" > edge)"""
    m = f"""1 + (SELECT count(*) FROM (SELECT DISTINCT unnest(e.m[2:5]) AS edge) AS x
                 WHERE edge > e.m[1] AND edge < e.m[6] AND "Monetary" > edge)"""
    return rfm + f""",
edges AS (
  SELECT quantile_cont(CAST("Recency" AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS r,
         quantile_cont("Monetary", [0, 0.2, 0.4, 0.6, 0.8, 1]) AS m
  FROM rfm
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY "Frequency", "CustomerID") AS place, count(*) OVER () AS n FROM rfm
),
numbers AS (
  SELECT "CustomerID", "Recency", "Frequency", "Monetary",
         CAST({recency.format(r)} AS INTEGER) AS "R_Score",
         CAST(1 + CAST(5 * (place - 1) > n - 1 AS INTEGER) + CAST(5 * (place - 1) > 2 * (n - 1) AS INTEGER)
              + CAST(5 * (place - 1) > 3 * (n - 1) AS INTEGER) + CAST(5 * (place - 1) > 4 * (n - 1) AS INTEGER)
              AS INTEGER) AS "F_Score",
         CAST({m} AS INTEGER) AS "M_Score"
  FROM ranked, edges AS e
),
scored AS (
  SELECT *, CAST("R_Score" AS VARCHAR) || CAST("F_Score" AS VARCHAR) || CAST("M_Score" AS VARCHAR) AS "RFM_Score",
         {LEVEL} AS "Customer_Level"
  FROM numbers
)"""


SCORED = _scores(RFM)
LEVELS = "(VALUES ('Low', 4), ('Mid', 3), ('High', 2), ('Champion', 1)) AS levels(name, place)"

ROBUST = RFM + """,
logs AS (
  SELECT "CustomerID", "Recency", "Frequency", "Monetary",
         ln(1.0 + "Recency") AS lr, ln(1.0 + "Frequency") AS lf, ln(1.0 + "Monetary") AS lm FROM rfm
),
spread AS (
  SELECT quantile_cont(lr, [0.25, 0.5, 0.75]) AS r, quantile_cont(lf, [0.25, 0.5, 0.75]) AS f,
         quantile_cont(lm, [0.25, 0.5, 0.75]) AS m FROM logs
),
features AS (
  SELECT "CustomerID", "Recency", "Frequency", "Monetary",
         (lr - s.r[2]) / coalesce(nullif(s.r[3] - s.r[1], 0), 1) AS "R",
         (lf - s.f[2]) / coalesce(nullif(s.f[3] - s.f[1], 0), 1) AS "F",
         (lm - s.m[2]) / coalesce(nullif(s.m[3] - s.m[1], 0), 1) AS "M"
  FROM logs, spread AS s
)"""

STANDARD = RFM + """,
spread AS (
  SELECT avg("Recency") AS ra, stddev_pop("Recency") AS rs, avg("Frequency") AS fa,
         stddev_pop("Frequency") AS fs, avg("Monetary") AS ma, stddev_pop("Monetary") AS ms FROM rfm
),
features AS (
  SELECT rfm.*, ("Recency" - ra) / coalesce(nullif(rs, 0), 1) AS "R",
         ("Frequency" - fa) / coalesce(nullif(fs, 0), 1) AS "F",
         ("Monetary" - ma) / coalesce(nullif(ms, 0), 1) AS "M"
  FROM rfm, spread
)"""


def _centers(candidates: Sequence[Centers]) -> str:
    rows = [
        f"({c.k}, {i}, {r!r}::DOUBLE, {f!r}::DOUBLE, {m!r}::DOUBLE)"
        for c in candidates for i, (r, f, m) in enumerate(c.points)
    ]
    return "centers(k, cluster, cr, cf, cm) AS (VALUES " + ", ".join(rows) + ")"


def _assigned(features: str, candidates: Sequence[Centers]) -> str:
    """Every customer with its nearest center, per candidate."""
    return features + f""",
{_centers(candidates)},
costs AS (
  SELECT features.*, k, cluster, ("R" - cr) * ("R" - cr) + ("F" - cf) * ("F" - cf) + ("M" - cm) * ("M" - cm) AS cost
  FROM features, centers
),
assigned AS (
  SELECT * EXCLUDE (place, cluster), CAST(cluster AS INTEGER) AS "Cluster" FROM (
    SELECT *, row_number() OVER (PARTITION BY k, "CustomerID" ORDER BY cost, cluster) AS place FROM costs)
  WHERE place = 1
)"""


CLUSTERED = _assigned(ROBUST, [ROBUST_CENTERS])
SWEEP_CENTERS = [diagonal_centers(k) for k in range(2, 11)]

# All pairs of customers, squared distance.
SILHOUETTE = """,
distances AS (
  SELECT a.k, a."CustomerID", a."Cluster" AS own, b."Cluster" AS facing,
         sum((a."R" - b."R") ** 2 + (a."F" - b."F") ** 2 + (a."M" - b."M") ** 2) AS total, count(*) AS n
  FROM assigned AS a JOIN assigned AS b ON a.k = b.k GROUP BY ALL
),
sides AS (
  SELECT k, "CustomerID", max(CASE WHEN own = facing AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN own <> facing THEN total / n END) AS b
  FROM distances GROUP BY ALL
),
widths AS (
  SELECT k, avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS silhouette FROM sides GROUP BY k
)"""

# The same with plain distances.
PLAIN = SILHOUETTE.replace("sum((", "sum(sqrt((").replace("** 2) AS total", "** 2)) AS total")

SWEEP = _assigned(ROBUST, SWEEP_CENTERS) + SILHOUETTE + """,
sweep AS (
  SELECT CAST(k AS INTEGER) AS k, inertia, silhouette
  FROM (SELECT k, sum(cost) AS inertia FROM assigned GROUP BY k) JOIN widths USING (k)
)"""

MEANS = """,
means AS (
  SELECT "Cluster", avg("Recency") AS r, avg("Frequency") AS f, avg("Monetary") AS m, count(*) AS n,
         sum("Monetary") AS revenue
  FROM assigned GROUP BY "Cluster"
),
ranks AS (
  SELECT *, CAST(row_number() OVER (ORDER BY m DESC, "Cluster") AS INTEGER) AS spend_rank FROM means
)"""

RULED = _assigned(STANDARD, [STANDARD_CENTERS]) + MEANS + """,
cuts AS (
  SELECT quantile_cont(CAST("Recency" AS DOUBLE), [0.25, 0.75]) AS r,
         quantile_cont(CAST("Frequency" AS DOUBLE), 0.5) AS f, quantile_cont("Monetary", 0.75) AS m FROM rfm
),
names AS (
  SELECT "Cluster", CASE WHEN means.m > c.m AND means.r < c.r[1] THEN 'Champions'
                         WHEN means.m > c.m AND means.r > c.r[2] THEN 'At-Risk VIP'
                         WHEN means.r < c.r[1] AND means.f < c.f THEN 'New Customers'
                         WHEN means.r > c.r[2] THEN 'Hibernating' ELSE 'Regular' END AS "Segment_Name"
  FROM means, cuts AS c
),
named AS (SELECT assigned.*, "Segment_Name" FROM assigned LEFT JOIN names USING ("Cluster"))"""


def _even(expression: str, digits: int) -> str:
    return f"round_even(({expression}) * 1e{digits}, 0) / 1e{digits}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: Sequence[Sequence[str]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_text, row)) + ")" for row in rows)


def _histogram(measure: str) -> str:
    return f"""
SELECT '{measure}' AS measure, bin, round(bin_start, 4) AS bin_start, round(bin_end, 4) AS bin_end,
       (SELECT count(*) FROM rfm WHERE "{measure}" >= bin_start
          AND ("{measure}" < bin_end OR (bin = 49 AND "{measure}" <= bin_end))) AS customers
FROM (
  SELECT CAST(b AS INTEGER) AS bin, low + b * step AS bin_start,
         CASE WHEN b = 49 THEN high ELSE low + (b + 1) * step END AS bin_end
  FROM (SELECT CAST(min("{measure}") AS DOUBLE) AS low, CAST(max("{measure}") AS DOUBLE) AS high,
               (max("{measure}") - min("{measure}")) / 50.0 AS step FROM rfm), range(50) AS grid(b)
)"""


def _density(measure: str) -> str:
    return f"""
SELECT '{measure}' AS measure, CAST(point AS INTEGER) AS point, round(x, 4) AS x,
       round(total / n * 1e9, 2) AS density_e9, round(total * (high - low) / 50.0, 4) AS count_scale
FROM (
  SELECT point, x, n, low, high, sum(exp(-0.5 * ((x - v) / h) ** 2) / (h * sqrt(2 * pi()))) AS total
  FROM (
    SELECT g AS point, low, high, n, h, low + g * ((high - low) / 199.0) AS x
    FROM (SELECT CAST(min("{measure}") AS DOUBLE) AS low, CAST(max("{measure}") AS DOUBLE) AS high,
                 count(*) AS n, stddev_samp("{measure}") * count(*) ** -0.2 AS h FROM rfm),
         range(200) AS grid(g)
  ) CROSS JOIN (SELECT CAST("{measure}" AS DOUBLE) AS v FROM rfm)
  GROUP BY ALL
)"""


def _describe(column: str, table: str, edge_digits: bool) -> str:
    extreme = 'round({}, 4)' if edge_digits else '{}'
    v = f'CAST("{column}" AS DOUBLE)'
    return f"""
SELECT '{column}' AS "column", count({v}) AS count, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std,
       {extreme.format(f'min({v})')} AS min, round(quantile_cont({v}, 0.25), 4) AS q25,
       round(quantile_cont({v}, 0.5), 4) AS q50, round(quantile_cont({v}, 0.75), 4) AS q75,
       {extreme.format(f'max({v})')} AS max
FROM {table}"""


def _radar(by: str, table: str, recency_top: float) -> str:
    return f"""
SELECT "{by}", {_even('avg(r)', 2)} AS "R", {_even('avg(f)', 2)} AS "F", {_even('avg(m)', 2)} AS "M" FROM (
  SELECT "{by}", {recency_top} - "Recency" / (SELECT CAST(max("Recency") AS DOUBLE) FROM {table}) * 4.0 AS r,
         "Frequency" / (SELECT CAST(max("Frequency") AS DOUBLE) FROM {table}) * 4.0 + 1 AS f,
         "Monetary" / (SELECT max("Monetary") FROM {table}) * 4.0 + 1 AS m
  FROM {table}) GROUP BY "{by}\""""


# Power iteration on the covariance matrix, then again after removing the first component.
PCA = STANDARD + """,
centered AS (
  SELECT "CustomerID", "R" - avg("R") OVER () AS r, "F" - avg("F") OVER () AS f, "M" - avg("M") OVER () AS m
  FROM features
),
cov AS (
  SELECT covar_samp(r, r) AS rr, covar_samp(f, f) AS ff, covar_samp(m, m) AS mm,
         covar_samp(r, f) AS rf, covar_samp(r, m) AS rm, covar_samp(f, m) AS fm FROM centered
),
first_steps AS (
  SELECT 0 AS step, 0.5::DOUBLE AS a, 0.6::DOUBLE AS b, 0.7::DOUBLE AS c
  UNION ALL
  SELECT step + 1, x / n, y / n, z / n FROM (
    SELECT step, x, y, z, sqrt(x * x + y * y + z * z) AS n FROM (
      SELECT step, rr * a + rf * b + rm * c AS x, rf * a + ff * b + fm * c AS y, rm * a + fm * b + mm * c AS z
      FROM first_steps, cov WHERE step < 400))
),
one AS (
  SELECT a, b, c, rr * a * a + ff * b * b + mm * c * c + 2 * (rf * a * b + rm * a * c + fm * b * c) AS value
  FROM (SELECT * FROM first_steps WHERE step = 400), cov
),
rest AS (
  SELECT rr - value * a * a AS rr, ff - value * b * b AS ff, mm - value * c * c AS mm,
         rf - value * a * b AS rf, rm - value * a * c AS rm, fm - value * b * c AS fm FROM cov, one
),
second_steps AS (
  SELECT 0 AS step, 0.9::DOUBLE AS a, -0.4::DOUBLE AS b, 0.1::DOUBLE AS c
  UNION ALL
  SELECT step + 1, x / n, y / n, z / n FROM (
    SELECT step, x, y, z, sqrt(x * x + y * y + z * z) AS n FROM (
      SELECT step, rr * a + rf * b + rm * c AS x, rf * a + ff * b + fm * c AS y, rm * a + fm * b + mm * c AS z
      FROM second_steps, rest WHERE step < 400))
),
two AS (
  SELECT a, b, c, rr * a * a + ff * b * b + mm * c * c + 2 * (rf * a * b + rm * a * c + fm * b * c) AS value
  FROM (SELECT * FROM second_steps WHERE step = 400), rest
),
parts AS (
  SELECT 1 AS component, * FROM one UNION ALL SELECT 2, * FROM two
),
signed AS (
  SELECT component, value, a * s AS a, b * s AS b, c * s AS c FROM (
    SELECT *, sign(CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a
                        WHEN abs(b) >= abs(c) THEN b ELSE c END) AS s FROM parts)
)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {'RECURSIVE ' if 'first_steps' in ctes else ''}{ctes.strip()}\n{select.strip()}"


_SCORE_COLUMNS = '"CustomerID", "Recency", "Frequency", round("Monetary", 2) AS "Monetary"'
_FEATURE_COLUMNS = '"CustomerID", round("R", 6) AS "R", round("F", 6) AS "F", round("M", 6) AS "M"'
_ALL_SCORES = f'{_SCORE_COLUMNS}, "R_Score", "F_Score", "M_Score", "RFM_Score", "Customer_Level"'
_LETTERS = ", ".join(f"""['E', 'D', 'C', 'B', 'A']["{s}"] AS "{s}\"""" for s in ("R_Score", "F_Score", "M_Score"))
_LETTER_TEXT = " || ".join(
    f"""['E', 'D', 'C', 'B', 'A']["{s}"]""" for s in ("R_Score", "F_Score", "M_Score")
)

ORACLES: dict[str, str] = {
    "csv_chunks_by_country": _with(CLEAN, """
SELECT "Country", count(*) AS lines, round(sum("TotalPrice"), 2) AS revenue, min("InvoiceDate") AS first_date,
       max(length("Description")) AS longest_description
FROM clean GROUP BY "Country\""""),
    "stage_monthly_revenue": _with(CLEAN, """
SELECT strftime("InvoiceDate", '%Y-%m') AS month, round(sum("TotalPrice"), 2) AS revenue FROM clean GROUP BY 1"""),
    "union_yearly_sources": _with(LINES, """
SELECT CAST(year("InvoiceDate") AS INTEGER) AS year, count(*) AS lines,
       round(sum("Quantity" * "UnitPrice"), 2) AS amount FROM lines GROUP BY 1"""),
    "strategy_csv": _with(CLUSTERED + MEANS, f"""
SELECT "Cluster", "Segment", n AS "Customers", "Strategy"
FROM ranks JOIN (VALUES (1, 'Champions'), (2, 'Loyal'), (3, 'New'), (4, 'Hibernating')) AS s(rank, "Segment")
  ON rank = spend_rank
JOIN ({_values(RANKED_TEXTS)}) AS t("Segment", "Strategy") USING ("Segment")"""),
    "clean_lines": _with(CLEAN, """
SELECT "InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country",
       "TotalPrice" FROM clean"""),
    "clean_audit": _with(LINES, """
SELECT step, rule, rows_before, rows_after, rows_before - rows_after AS rows_removed FROM (
  SELECT 1 AS step, 'has_customer' AS rule, (SELECT count(*) FROM lines) AS rows_before,
         (SELECT count(*) FROM lines WHERE "CustomerID" IS NOT NULL) AS rows_after
  UNION ALL
  SELECT 2, 'not_cancelled', (SELECT count(*) FROM lines WHERE "CustomerID" IS NOT NULL),
         (SELECT count(*) FROM lines WHERE "CustomerID" IS NOT NULL AND "InvoiceNo" NOT LIKE 'C%')
  UNION ALL
  SELECT 3, 'positive_amount',
         (SELECT count(*) FROM lines WHERE "CustomerID" IS NOT NULL AND "InvoiceNo" NOT LIKE 'C%'),
         (SELECT count(*) FROM lines WHERE "CustomerID" IS NOT NULL AND "InvoiceNo" NOT LIKE 'C%'
             AND "Quantity" > 0 AND "UnitPrice" > 0))"""),
    "ordered_chunks": _with(LINES, """
SELECT count(*) AS lines, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS over_bound FROM lines"""),
    "followed_parts": _with(RFM, f"SELECT {_SCORE_COLUMNS} FROM rfm"),
    "head_preview": _with(CLEAN, """
SELECT "InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country",
       "TotalPrice" FROM clean ORDER BY ALL LIMIT 10"""),
    "shape_and_range": _with(LINES, """
SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns, min("InvoiceDate") AS first_date,
       max("InvoiceDate") AS last_date FROM lines"""),
    "schema_listing": _with(LINES, " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS type, count("{c}") AS non_null FROM lines"""
        for i, (c, kind) in enumerate((
            ("InvoiceNo", "string"), ("StockCode", "string"), ("Description", "string"), ("Quantity", "double"),
            ("InvoiceDate", "timestamp_ntz"), ("UnitPrice", "double"), ("CustomerID", "bigint"), ("Country", "string"),
        ), 1))),
    "null_counts": _with(LINES, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL) AS missing FROM lines"""
        for c in ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID",
                  "Country"))),
    "describe_lines": _with(LINES, " UNION ALL ".join(
        _describe(c, "lines", False) for c in ("Quantity", "UnitPrice", "CustomerID"))),
    "describe_rfm": _with(RFM, " UNION ALL ".join(
        _describe(c, "rfm", True) for c in ("Recency", "Frequency", "Monetary"))),
    "kpis": _with(CLEAN, """
SELECT count(DISTINCT "CustomerID") AS customers, count(DISTINCT "InvoiceNo") AS invoices,
       round(sum("TotalPrice"), 2) AS revenue, min("InvoiceDate") AS first_date, max("InvoiceDate") AS last_date
FROM clean"""),
    "top_countries": _with(CLEAN, """
SELECT "Country", count(*) AS lines FROM clean WHERE "Country" IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "monthly_revenue": _with(CLEAN, """
SELECT strftime("InvoiceDate", '%Y-%m') AS month, round(sum("TotalPrice"), 2) AS revenue FROM clean GROUP BY 1"""),
    "snapshot_date": _with(CLEAN, """
SELECT max("InvoiceDate") AS last_purchase, max("InvoiceDate") + INTERVAL 1 DAY AS snapshot FROM clean"""),
    "rfm_table": _with(RFM, f"SELECT {_SCORE_COLUMNS} FROM rfm"),
    "rfm_by_sketches": _with(RFM, f"SELECT {_SCORE_COLUMNS} FROM rfm"),
    "rfm_given_snapshot": _with(CLEAN, """
SELECT "CustomerID",
       CAST((epoch_us(TIMESTAMP '2002-01-01 12:00:00') - epoch_us(max("InvoiceDate"))) // 86400000000 AS BIGINT)
         AS "Recency",
       count(DISTINCT "InvoiceNo") AS "Frequency", round(sum("TotalPrice"), 2) AS "Monetary"
FROM clean GROUP BY "CustomerID\""""),
    "rfm_events": _with(EVENT_RFM, f"SELECT {_SCORE_COLUMNS} FROM rfm"),
    "rfm_scores": _with(SCORED, f"SELECT {_ALL_SCORES} FROM scored"),
    "rfm_scores_recent_high": _with(_scores(RFM, "6 - ({})"), f"SELECT {_ALL_SCORES} FROM scored"),
    "rfm_scores_labelled": _with(SCORED, f"""
SELECT {_SCORE_COLUMNS}, {_LETTERS}, {_LETTER_TEXT} AS "RFM_Score", "Customer_Level" FROM scored"""),
    "rfm_scores_events": _with(_scores(EVENT_RFM), f"SELECT {_ALL_SCORES} FROM scored"),
    "frequency_scores": _with(SCORED, 'SELECT "CustomerID", "Frequency", "F_Score" FROM scored'),
    "level_distribution": _with(SCORED, f"""
SELECT name AS "Customer_Level", count("CustomerID") AS customers
FROM {LEVELS} LEFT JOIN scored ON name = "Customer_Level" GROUP BY 1"""),
    "level_counts": _with(SCORED, f"""
SELECT name AS "Customer_Level", CAST(place AS BIGINT) AS level_order, count("CustomerID") AS customers
FROM {LEVELS} LEFT JOIN scored ON name = "Customer_Level" GROUP BY 1, 2"""),
    "level_shares": _with(SCORED, f"""
SELECT name AS "Customer_Level", CAST(place AS BIGINT) AS level_order, count("CustomerID") AS customers,
       round(100.0 * count("CustomerID") / (SELECT count(*) FROM scored), 4)::DOUBLE AS pct_customers
FROM {LEVELS} LEFT JOIN scored ON name = "Customer_Level" GROUP BY 1, 2"""),
    "level_profile": _with(SCORED, f"""
SELECT name AS "Customer_Level", {_even('avg("Recency")', 2)} AS "Recency",
       {_even('avg("Frequency")', 2)} AS "Frequency", {_even('avg("Monetary")', 2)} AS "Monetary"
FROM {LEVELS} LEFT JOIN scored ON name = "Customer_Level" GROUP BY 1"""),
    "quantile_thresholds": _with(RFM, " UNION ALL ".join(
        f"""SELECT '{c}' AS measure, round(quantile_cont(CAST("{c}" AS DOUBLE), 0.25), 4) AS p25,
       round(quantile_cont(CAST("{c}" AS DOUBLE), 0.5), 4) AS p50,
       round(quantile_cont(CAST("{c}" AS DOUBLE), 0.75), 4) AS p75 FROM rfm"""
        for c in ("Recency", "Frequency", "Monetary"))),
    "funnel": _with(RFM, " UNION ALL ".join(
        f"SELECT {i + 1} AS stage_order, {_text(name)} AS stage, count(*) AS customers FROM rfm WHERE {condition}"
        for i, (name, condition) in enumerate(zip(FUNNEL_STAGES, [
            "true", '"Recency" < 90', '"Frequency" >= 1', '"Frequency" >= 2',
            '"Monetary" > (SELECT quantile_cont("Monetary", 0.75) FROM rfm)'])))),
    "rfm_histograms": _with(RFM, " UNION ALL ".join(map(_histogram, ("Recency", "Frequency", "Monetary")))),
    "rfm_density": _with(RFM, " UNION ALL ".join(map(_density, ("Recency", "Frequency", "Monetary")))),
    "log_features": _with(RFM, """
SELECT "CustomerID", round(ln(1.0 + "Recency"), 6) AS "Recency", round(ln(1.0 + "Frequency"), 6) AS "Frequency",
       round(ln(1.0 + "Monetary"), 6) AS "Monetary" FROM rfm"""),
    "robust_features": _with(ROBUST, f"SELECT {_FEATURE_COLUMNS} FROM features"),
    "standard_features": _with(STANDARD, f"SELECT {_FEATURE_COLUMNS} FROM features"),
    "standard_check": _with(STANDARD, " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg("{c}"), 6) + 0.0 AS mean, round(stddev_samp("{c}"), 6) AS std
FROM features""" for c in "RFM")),
    "fixed_center_assignment": _with(CLUSTERED, 'SELECT "CustomerID", "Cluster" FROM assigned'),
    "fixed_center_inertia": _with(CLUSTERED, "SELECT round(sum(cost), 4) AS inertia FROM assigned"),
    "silhouette_squared": _with(CLUSTERED + SILHOUETTE, """
SELECT CAST(k AS INTEGER) AS k, round(silhouette, 6) AS silhouette FROM widths"""),
    "silhouette_plain": _with(CLUSTERED + PLAIN, """
SELECT CAST(k AS INTEGER) AS k, round(silhouette, 2) AS silhouette FROM widths"""),
    "plain_sweep": _with(_assigned(ROBUST, SWEEP_CENTERS) + PLAIN, """
SELECT CAST(arg_max(k, silhouette) AS INTEGER) AS best_k,
       CAST((SELECT max(k) FROM widths WHERE silhouette >= 0.8 * (SELECT max(silhouette) FROM widths)) AS INTEGER) AS business_k
FROM widths"""),
    "k_sweep": _with(SWEEP, """
SELECT k, round(inertia, 4) AS inertia, round(silhouette, 6) AS silhouette, 'squared' AS metric FROM sweep"""),
    "sweep_best_k": _with(SWEEP, "SELECT k FROM sweep ORDER BY silhouette DESC, k LIMIT 1"),
    "sweep_business_k": _with(SWEEP, """
SELECT max(k) AS k FROM sweep WHERE silhouette >= 0.8 * (SELECT max(silhouette) FROM sweep)"""),
    "canonical_clusters": _with(CLUSTERED + MEANS, """
SELECT "CustomerID", CAST(spend_rank - 1 AS INTEGER) AS "Cluster" FROM assigned JOIN ranks USING ("Cluster")"""),
    "pca_projection": _with(PCA, """
SELECT "CustomerID", round(r * p.a + f * p.b + m * p.c, 4) AS "PC1", round(r * q.a + f * q.b + m * q.c, 4) AS "PC2"
FROM centered, signed AS p, signed AS q WHERE p.component = 1 AND q.component = 2"""),
    "pca_variance": _with(PCA, """
SELECT CAST(component AS INTEGER) AS component, round(value / (SELECT rr + ff + mm FROM cov), 6) AS variance_ratio
FROM signed"""),
    "cluster_sizes": _with(CLUSTERED, 'SELECT "Cluster", count(*) AS customers FROM assigned GROUP BY 1'),
    "cluster_shares": _with(CLUSTERED, """
SELECT "Cluster", count(*) AS customers,
       round(100.0 * count(*) / (SELECT count(*) FROM assigned), 4)::DOUBLE AS pct_customers
FROM assigned GROUP BY 1"""),
    "cluster_profile": _with(CLUSTERED, "SELECT \"Cluster\", " + ", ".join(
        f"""{_even(f'avg("{c}")', 2)} AS "{c}_mean", count("{c}") AS "{c}_count\""""
        for c in ("Recency", "Frequency", "Monetary")) + " FROM assigned GROUP BY 1"),
    "cluster_revenue": _with(CLUSTERED + MEANS, """
SELECT "Cluster", n AS "Count", round(revenue, 2) AS "Revenue",
       round(revenue / (SELECT sum(revenue) FROM means) * 100, 4) AS "Pct" FROM means"""),
    "ranked_segments": _with(CLUSTERED + MEANS, """
SELECT "Cluster", spend_rank, ['Champions', 'Loyal', 'New', 'Hibernating'][spend_rank] AS "Segment" FROM ranks"""),
    "rule_segments": _with(RULED, 'SELECT "CustomerID", "Cluster", "Segment_Name" FROM named'),
    "segment_summary": _with(RULED, f"""
SELECT *, {_even('"Count" / (SELECT count(*) FROM named) * 100', 1)} AS "Pct_Customers",
       {_even('"Total_Revenue" / (sum("Total_Revenue") OVER ()) * 100', 1)} AS "Pct_Revenue"
FROM (
  SELECT "Segment_Name", count(*) AS "Count", {_even('avg("Recency")', 2)} AS "Avg_Recency",
         {_even('avg("Frequency")', 2)} AS "Avg_Frequency", {_even('avg("Monetary")', 2)} AS "Avg_Monetary",
         {_even('sum("Monetary")', 2)} AS "Total_Revenue"
  FROM named GROUP BY 1)"""),
    "radar_by_cluster": _with(CLUSTERED, _radar("Cluster", "assigned", 2.0)),
    "radar_by_segment": _with(RULED, _radar("Segment_Name", "named", 5.0)),
    "strategy_report": _with(CLUSTERED + MEANS, f"""
SELECT "Cluster", "Segment", n AS "Customers", {_even('revenue', 2)} AS "Revenue",
       {_even('revenue / (SELECT sum(revenue) FROM means) * 100', 2)} AS "Revenue_Share_%",
       "Strategy", CAST(NULL AS VARCHAR) AS "Expected_Impact"
FROM ranks JOIN (VALUES (1, 'Champions'), (2, 'Loyal'), (3, 'New'), (4, 'Hibernating')) AS s(rank, "Segment")
  ON rank = spend_rank
JOIN ({_values(RANKED_TEXTS)}) AS t("Segment", "Strategy") USING ("Segment")"""),
    "strategy_matrix": _with(RULED, f"""
SELECT "Segment", "Characteristic", "Strategy", CAST(NULL AS VARCHAR) AS "Expected_Impact",
       (SELECT count(*) FROM named WHERE "Segment_Name" = "Segment") AS customers
FROM ({_values(RULED_TEXTS)}) AS t("Segment", "Characteristic", "Strategy")"""),
    **{
        f"kmeans_checks_{variant}": _with(RFM, f"""
SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM rfm) AS customers,
       CAST(0 AS BIGINT) AS empty_clusters, CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS off_mean,
       CAST(0 AS BIGINT) AS dearer_than_rival, CAST(0 AS BIGINT) AS rising
FROM range(2, {end}) AS ks(k)""")
        for variant, end in (("cli", 11), ("notebook", 11), ("verify", 8))
    },
    "scatter_extract": _with(RULED, f'SELECT {_SCORE_COLUMNS}, "Segment_Name" FROM named'),
    "scatter_sample": _with(RULED, f"""
SELECT {_SCORE_COLUMNS}, "Segment_Name" FROM named
QUALIFY row_number() OVER (PARTITION BY "Segment_Name" ORDER BY md5('42:' || "CustomerID"), CAST("CustomerID" AS VARCHAR)) <= 500"""),
    "quality": _with(SCORED, f"""
SELECT 'line_columns_present' AS "check", CAST(0 AS BIGINT) AS failed_rows
UNION ALL SELECT 'clean_lines_remain', CAST((SELECT count(*) FROM clean) = 0 AS BIGINT)
UNION ALL SELECT 'rfm_columns_present', 0
UNION ALL SELECT 'monetary_positive', (SELECT count(*) FROM scored WHERE NOT "Monetary" > 0)
UNION ALL SELECT 'rfm_score_present', (SELECT count(*) FROM scored WHERE "RFM_Score" IS NULL)
UNION ALL SELECT 'best_silhouette_positive', (
  WITH {_assigned(ROBUST.split(RFM)[1].lstrip(','), [diagonal_centers(2)]).strip()}{SILHOUETTE}
  SELECT CAST(max(silhouette) <= 0 AS BIGINT) FROM widths)"""),
}
