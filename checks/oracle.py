"""SQL twins of the registered queries, for DuckDB on the same Parquet tables.

The statements are put together from named CTEs; they share no code with the engine except
the fixed label and prompt texts.
"""

from __future__ import annotations

from string import Formatter

from salesloom.functions.labels import label
from salesloom.operators.cleaning import DEFAULT_COLUMNS
from salesloom.operators.retrieval import BLOCK_FIELDS, BLOCK_HEADERS
from salesloom.plans import prompts
from salesloom.plans.report import SECTION_RULES

SEGMENTS = ("category", "product", "customer_id", "channel")

# ---------------------------------------------------------------------------
# Facts
# ---------------------------------------------------------------------------

SALES = """sales AS (
  SELECT o_orderdate AS date, l_extendedprice * (1 - l_discount) AS amount,
         l_quantity * p_retailprice AS cost, p_type AS category, p_name AS product,
         CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS channel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

ORDERS_TX = """orders_tx AS (
  SELECT o_orderkey AS order_key, o_orderdate AS date, o_totalprice AS amount,
         o_orderpriority AS category, CAST(o_custkey AS VARCHAR) AS customer_id,
         o_orderstatus AS channel
  FROM orders)"""

PURCHASES = """purchases AS (
  SELECT ts AS date, value AS amount, CAST(user_id AS VARCHAR) AS customer_id
  FROM events WHERE event_type = 'purchase')"""

RAW_ORDERS = """raw_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_key,
    CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-date' WHEN o_orderkey % 89 = 0 THEN NULL
         WHEN o_orderkey % 83 = 0 THEN strftime(o_orderdate, '%Y-%-m-%-d')
         WHEN o_orderkey % 101 = 0 THEN '2024-02-30'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    CASE WHEN o_orderkey % 79 = 0 THEN '1,234' WHEN o_orderkey % 73 = 0 THEN NULL
         WHEN o_orderkey % 67 = 0 THEN '1d'
         WHEN o_orderkey % 61 = 0
           THEN '  ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' '
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS total_price,
    CASE WHEN o_orderkey % 71 = 0 THEN 'abc'
         ELSE CAST(CAST(round(o_totalprice * 0.6, 2) AS DECIMAL(18,2)) AS VARCHAR)
         END AS cost,
    CASE WHEN o_orderkey % 59 <> 0 THEN o_orderpriority END AS category,
    CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS sales_channel
  FROM orders)"""

_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def _num(col: str) -> str:
    return (f"CASE WHEN regexp_matches(lower(trim({col})), '{_NUMBER}') "
            f"THEN try_cast(trim({col}) AS DOUBLE) END")


PARSED = f"""parsed AS (
  SELECT *,
    CASE WHEN regexp_matches(order_date, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$')
         THEN try_strptime(order_date, '%Y-%m-%d') END AS p_date,
    {_num('total_price')} AS p_amount, {_num('cost')} AS p_cost
  FROM raw_orders)"""


def ts_text(x: str, sep: str = " ") -> str:
    x = f"CAST({x} AS TIMESTAMP)"
    return (f"(CASE WHEN microsecond({x}) % 1000000 = 0 "
            f"THEN strftime({x}, '%Y-%m-%d{sep}%H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%d{sep}%H:%M:%S.%f') END)")


# ---------------------------------------------------------------------------
# KPI CTEs: everything is keyed by k (the group, or 0)
# ---------------------------------------------------------------------------


def total(x: str) -> str:
    """Money is added exactly, in ten-thousandths, and shown as the nearest double."""
    return f"CAST(sum(CAST({x} AS DECIMAL(38,4))) AS DOUBLE)"


def kpis(source: str, by: str | None = None, cost: bool = True,
         segments: tuple[str, ...] = SEGMENTS) -> str:
    c = total("cost") if cost else "NULL"
    segments = tuple(s for s in segments if s != by)
    union = " UNION ALL ".join(
        f"SELECT k, '{s}' AS segment_type, {i} AS t, {s} AS segment_value, "
        f"{total('amount')} AS revenue, {c} AS cost, count(amount) AS order_count "
        f"FROM f WHERE {s} IS NOT NULL GROUP BY k, {s}" for i, s in enumerate(segments))
    return f"""f AS (SELECT {by or 0} AS k, * FROM {source}),
ov AS (
  SELECT *, total_revenue - total_cost AS gross_profit,
         CASE WHEN total_revenue > 0
              THEN (total_revenue - total_cost) / total_revenue * 100 END AS gross_margin_pct,
         total_revenue / n_transactions AS avg_order_value
  FROM (SELECT k, {total("amount")} AS total_revenue, {c} AS total_cost,
               count(*) AS n_transactions, min(date) AS date_min, max(date) AS date_max
        FROM f GROUP BY k)),
dsum AS (SELECT k, CAST(date AS DATE) AS period, {total("amount")} AS revenue, {c} AS cost
         FROM f GROUP BY ALL),
span AS (SELECT k, min(period) AS lo, max(period) AS hi FROM dsum GROUP BY k),
days AS (SELECT k, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                INTERVAL 1 DAY)) AS DATE) AS period FROM span),
day AS (SELECT k, period, coalesce(revenue, 0.0) AS revenue, coalesce(cost, 0.0) AS cost
        FROM days LEFT JOIN dsum USING (k, period)),
week AS (SELECT k, CAST(period + CAST(7 - isodow(period) AS INTEGER) AS DATE) AS period,
                {total("revenue")} AS revenue, {total("cost")} AS cost FROM day GROUP BY ALL),
month AS (SELECT k, last_day(period) AS period, {total("revenue")} AS revenue,
                 {total("cost")} AS cost FROM day GROUP BY ALL),
nz AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period DESC) AS rn
       FROM month WHERE revenue <> 0),
tr AS (SELECT a.k, true AS has_enough_data,
         CASE WHEN a.revenue > b.revenue THEN 'up' WHEN a.revenue < b.revenue THEN 'down'
              ELSE 'flat' END AS direction,
         a.period AS current_period, a.revenue AS current_revenue,
         b.period AS previous_period, b.revenue AS previous_revenue,
         a.revenue - b.revenue AS absolute_change,
         (a.revenue - b.revenue) / b.revenue * 100 AS percent_change
       FROM nz a JOIN nz b ON a.k = b.k AND a.rn = 1 AND b.rn = 2),
an0 AS (SELECT k, hi AS last,
          max(CASE WHEN period = hi THEN revenue END) AS current_revenue,
          avg(revenue) FILTER (WHERE period < hi) AS history_mean,
          stddev_pop(revenue) FILTER (WHERE period < hi) AS history_std
        FROM day JOIN span USING (k) WHERE period >= hi - 30 GROUP BY k, hi),
an AS (SELECT k, true AS has_enough_history,
         CASE WHEN z_score > 2 THEN 'high' WHEN z_score < -2 THEN 'low'
              ELSE 'normal' END AS status,
         last AS "current_date", current_revenue, history_mean, history_std, z_score
       FROM (SELECT *, CASE WHEN history_std > 0 THEN
               (current_revenue - history_mean) / history_std END AS z_score FROM an0)),
sg AS (SELECT *, revenue / CAST(sum(CAST(revenue AS DECIMAL(38,4))) OVER (PARTITION BY k, segment_type) AS DOUBLE) * 100 AS share,
         row_number() OVER (PARTITION BY k, segment_type
                            ORDER BY revenue DESC, segment_value) AS rank
       FROM ({union}))"""


def _profit(digits: int = 4) -> str:
    return (f"round(revenue, {digits}) AS revenue, round(cost, {digits}) AS cost, "
            f"round(revenue - cost, {digits}) AS gross_profit, "
            "round(CASE WHEN revenue > 0 THEN (revenue - cost) / revenue * 100 END, 6) "
            "AS gross_margin_pct")


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _by(by: str | None) -> str:
    return f"k AS {by}, " if by else ""


def series(source: str, cte: str, grain: str, cost: bool = True) -> str:
    shown = _profit() if cost else "round(revenue, 4) AS revenue"
    return _with(cte, kpis(source, cost=cost, segments=("customer_id",))) + (
        f"SELECT CAST(period AS VARCHAR) AS period, {shown} FROM {grain}")


def segment(name: str, top_n: int | None = 5) -> str:
    limit = f" AND rank <= {top_n}" if top_n else ""
    rank = "rank, " if top_n else ""
    return _with(SALES, kpis("sales")) + (
        f"SELECT segment_type, {rank}segment_value, {_profit()}, order_count, "
        f"round(share, 6) AS revenue_share_pct FROM sg WHERE segment_type = '{name}'{limit}")


def trend(by: str | None = None) -> str:
    return _with(SALES, kpis("sales", by)) + f"""
SELECT {_by(by)}has_enough_data, direction, CAST(current_period AS VARCHAR) AS current_period,
  round(current_revenue, 4) AS current_revenue,
  CAST(previous_period AS VARCHAR) AS previous_period,
  round(previous_revenue, 4) AS previous_revenue,
  round(absolute_change, 4) AS absolute_change, round(percent_change, 6) AS percent_change
FROM tr"""


def anomaly(source: str, cte: str, by: str | None = None, cost: bool = True,
            segments: tuple[str, ...] = SEGMENTS) -> str:
    return _with(cte, kpis(source, by, cost, segments)) + f"""
SELECT {_by(by)}has_enough_history, status, CAST("current_date" AS VARCHAR) AS "current_date",
  round(current_revenue, 4) AS current_revenue, round(history_mean, 6) AS history_mean,
  round(history_std, 6) AS history_std, round(z_score, 6) AS z_score FROM an"""


def anomalies(source: str, cte: str, by: str | None = None, cost: bool = True,
              segments: tuple[str, ...] = SEGMENTS, empty_days: bool = True) -> str:
    """Every day against the 30 days before it in the series without gaps."""
    shown = "" if empty_days else "JOIN dsum USING (k, period)"
    return _with(cte, kpis(source, by, cost, segments)) + f"""
SELECT {_by(by)}n >= 5 AS has_enough_history,
  CASE WHEN n < 5 THEN 'insufficient_history' WHEN z > 2 THEN 'high' WHEN z < -2 THEN 'low'
       ELSE 'normal' END AS status,
  CAST(period AS VARCHAR) AS "current_date", round(current_revenue, 4) AS current_revenue,
  round(CASE WHEN n >= 5 THEN mean END, 6) AS history_mean,
  round(CASE WHEN n >= 5 THEN std END, 6) AS history_std, round(z, 6) AS z_score
FROM (SELECT *, CASE WHEN n >= 5 AND std > 0 THEN (current_revenue - mean) / std END AS z
      FROM (SELECT k, period, day.revenue AS current_revenue, count(*) OVER w AS n,
                   avg(day.revenue) OVER w AS mean, stddev_pop(day.revenue) OVER w AS std
            FROM day WINDOW w AS (PARTITION BY k ORDER BY period
              RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))) {shown}"""


def metrics_long(by: str | None = None) -> str:
    none = "CAST(NULL AS VARCHAR)"

    def cells(table: str, section: str, numbers: dict[str, int], texts: dict[str, str],
              period: str = none, kind: str = none, value: str = none,
              where: str = "") -> list[str]:
        head = (f"SELECT {_by(by)}'{section}' AS section, {period} AS period, "
                f"{kind} AS segment_type, {value} AS segment_value, ")
        out = [f"{head}'{m}' AS metric, round(CAST({m} AS DOUBLE), {d}) AS value, "
               f"{none} AS text FROM {table}{where}" for m, d in numbers.items()]
        out += [f"{head}'{m}' AS metric, CAST(NULL AS DOUBLE) AS value, "
                f"CAST({x} AS VARCHAR) AS text FROM {table}{where}" for m, x in texts.items()]
        return out

    profit = ("(SELECT *, revenue - cost AS gross_profit, CASE WHEN revenue > 0 THEN "
              "(revenue - cost) / revenue * 100 END AS gross_margin_pct, "
              "{extra} FROM {table})")
    selects = cells("ov", "overall", {
        "total_revenue": 2, "total_cost": 2, "gross_profit": 2, "gross_margin_pct": 6,
        "n_transactions": 6, "avg_order_value": 6},
        {"date_min": ts_text("date_min"), "date_max": ts_text("date_max")})
    money = {"revenue": 4, "cost": 4, "gross_profit": 4, "gross_margin_pct": 6}
    selects += cells(profit.format(table="month", extra="0 AS zero"), "time_series", money, {},
                     period="CAST(period AS VARCHAR)")
    selects += cells(
        profit.format(table="sg", extra="share AS revenue_share_pct"), "segments",
        {"rank": 6, **money, "order_count": 6, "revenue_share_pct": 6}, {},
        kind="segment_type", value="segment_value", where=" WHERE rank <= 5")
    selects += cells("tr", "monthly_trend", {
        "current_revenue": 4, "previous_revenue": 4, "absolute_change": 4,
        "percent_change": 6},
        {c: c for c in ("has_enough_data", "direction", "current_period", "previous_period")})
    selects += cells("an", "anomaly", {
        "current_revenue": 4, "history_mean": 6, "history_std": 6, "z_score": 6},
        {"has_enough_history": "has_enough_history", "status": "status",
         "current_date": '"current_date"'})
    return _with(SALES, kpis("sales", by)) + "\nUNION ALL ".join(selects)


# ---------------------------------------------------------------------------
# Report lines: (k, sec, g, i, section, text)
# ---------------------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **values: str) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if name is not None:
            parts.append(f"({values[name]})")
    return " || ".join(parts)


def cur(x: str) -> str:
    return f"coalesce('Rp' || replace(format('{{:,.0f}}', CAST({x} AS DOUBLE)), ',', '.'), 'N/A')"


def num(x: str, d: int = 2) -> str:
    return f"format('{{:,.{d}f}}', CAST({x} AS DOUBLE))"


def pct(x: str, d: int = 2) -> str:
    return f"format('{{:.{d}f}}%', CAST({x} AS DOUBLE))"


def _line(sec: int, g: int, i: str, section: str, text: str, source: str) -> str:
    return (f"SELECT k, {sec} AS sec, {g} AS g, {i} AS i, '{section}' AS section, "
            f"{text} AS text FROM {source}")


def overview(language: str, cost: bool) -> list[str]:
    def say(key: str, **v: str) -> str:
        return fill(label(f"report.overview.{key}", language), **v)

    span = "CAST(CAST(date_min AS DATE) AS VARCHAR) || ' to ' || " \
           "CAST(CAST(date_max AS DATE) AS VARCHAR)"
    texts = [say("heading", date_range=span),
             say("total_revenue", total_revenue=cur("total_revenue"),
                 n_transactions=num("n_transactions", 0)),
             say("avg_order_value", avg_order_value=cur("avg_order_value"))]
    if cost:
        texts += [say("cost_and_profit", total_cost=cur("total_cost"),
                      gross_profit=cur("gross_profit")),
                  say("gross_margin", gross_margin_pct=pct("gross_margin_pct"))]
    return [_line(1, g, "0", "overview", t, "ov") for g, t in enumerate(texts)]


def segments_report(language: str, names: tuple[str, ...]) -> list[str]:
    def say(key: str, **v: str) -> str:
        return fill(label(f"report.segments.{key}", language), **v)

    out = []
    for g, s in enumerate(names):
        if g:
            out.append(_line(2, g, "-1", "segments", "''", "ov"))
        out.append(_line(2, g, "0", "segments", say(
            "top_segment_header", segment_label=lit(s.replace("_", " ").title())), "ov"))
        out.append(_line(2, g, "rank", "segments", say(
            "item_line", label="segment_value", revenue=cur("revenue"),
            order_count="CAST(order_count AS VARCHAR)",
            share_str=pct("revenue / total_revenue * 100")),
            f"sg JOIN ov USING (k) WHERE segment_type = '{s}' AND rank <= 3"))
    return out


def trend_report(language: str) -> list[str]:
    def say(key: str, **v: str) -> str:
        return fill(label(f"report.trend.{key}", language), **v)

    def case(column: str, words: dict[str, str], group: str) -> str:
        whens = " ".join(f"WHEN {column} {test} THEN {lit(label(f'report.trend.{group}.{w}', language))}"
                         for test, w in words.items())
        return f"CASE {whens} END"

    direction = case("direction", {"= 'up'": "up", "= 'down'": "down", "= 'flat'": "flat"},
                     "direction_word")
    change = case("absolute_change", {"> 0": "increase", "< 0": "decrease",
                                      "= 0": "no_change"}, "change_direction")
    period = say("period_range", previous_period="CAST(previous_period AS VARCHAR)",
                 current_period="CAST(current_period AS VARCHAR)")
    texts = [say("heading", period_str=period),
             say("revenue_change_line", direction_word=direction,
                 previous_revenue=cur("previous_revenue"),
                 current_revenue=cur("current_revenue")),
             say("change_line", change_direction=change,
                 absolute_change=cur("absolute_change"),
                 percent_change=pct("percent_change"))]
    return [_line(3, g, "0", "trend", t, "tr") for g, t in enumerate(texts)]


def anomaly_report(language: str) -> list[str]:
    def say(key: str, **v: str) -> str:
        return fill(label(f"report.anomaly.{key}", language), **v)

    status = " ".join(f"WHEN status = '{s}' THEN {say(f'status.{s}')}"
                      for s in ("high", "low", "normal"))
    texts = [say("heading", date='CAST("current_date" AS VARCHAR)'),
             say("line_revenue_vs_avg", current_revenue=cur("current_revenue"),
                 mean=cur("history_mean"), std=cur("history_std")),
             say("line_zscore", z_score=num("z_score")), f"CASE {status} END"]
    return [_line(4, g, "0", "anomaly", t, "an") for g, t in enumerate(texts)]


def report_selects(language: str, cost: bool, names: tuple[str, ...]) -> dict[str, list[str]]:
    return {"overview": overview(language, cost),
            "segments": segments_report(language, names),
            "trend": trend_report(language), "anomaly": anomaly_report(language)}


def report_lines(language: str, cost: bool = True,
                 names: tuple[str, ...] = SEGMENTS) -> str:
    """Body of a CTE with every line of the full report."""
    selects = [_line(0, g, "0", "title", lit(label(f"report.{key}", language)), "ov")
               for g, key in enumerate(("title", "underline"))]
    sections = report_selects(language, cost, names)
    for sec, (section, lines) in enumerate(sections.items(), 1):
        for g, text in enumerate(("", label(f"report.section.{section}", language),
                                  SECTION_RULES[section])):
            selects.append(_line(sec, g - 9, "0", section, lit(text), "ov"))
        selects += lines
    return "\nUNION ALL ".join(selects)


def _numbered(by: str | None) -> str:
    return (f"SELECT {_by(by)}section, row_number() OVER (PARTITION BY k ORDER BY sec, g, i) "
            "AS line_no, text FROM lines")


def report_section(section: str) -> str:
    body = "\nUNION ALL ".join(report_selects("en", True, SEGMENTS)[section])
    return _with(SALES, kpis("sales"), f"lines AS ({body})") + _numbered(None)


def full_report(language: str, by: str | None = None) -> str:
    names = tuple(s for s in SEGMENTS if s != by)
    return _with(SALES, kpis("sales", by),
                 f"lines AS ({report_lines(language, True, names)})") + _numbered(by)


# ---------------------------------------------------------------------------
# Context lines
# ---------------------------------------------------------------------------


def context_body(cost: bool = True, names: tuple[str, ...] = SEGMENTS) -> str:
    def plain(x: str) -> str:
        return f"CAST(round({x}, 6) AS VARCHAR)"

    overall = [("Total revenue", "total_revenue")]
    if cost:
        overall += [("Total cost", "total_cost"), ("Gross profit", "gross_profit"),
                    ("Gross margin %", "gross_margin_pct")]
    overall += [("Number of transactions", "n_transactions"),
                ("Average order value", "avg_order_value")]
    s = [_line(1, 0, "0", "overall", "'[Overall metrics]'", "ov")]
    s += [_line(1, g, "0", "overall", f"'- {shown}: ' || {num(c)}", "ov")
          for g, (shown, c) in enumerate(overall, 1)]
    s.append(_line(1, 9, "0", "overall", f"'- Date range: ' || {ts_text('date_min')} || ' to '"
                   f" || {ts_text('date_max')}", "ov"))
    shown = ["period", "revenue"] + (["cost", "gross_profit", "gross_margin_pct"]
                                     if cost else [])
    values = {"period": "CAST(period AS VARCHAR)", "revenue": num("revenue"),
              "cost": num("cost"), "gross_profit": num("revenue - cost"),
              "gross_margin_pct": f"coalesce(CASE WHEN revenue > 0 THEN "
                                  f"{num('(revenue - cost) / revenue * 100')} END, '-')"}
    s += [_line(2, g, "0", "time_series", lit(text), "ov") for g, text in enumerate((
        "[Revenue time series (last rows)]", " | ".join(shown),
        " | ".join("-" * len(c) for c in shown)))]
    s.append(_line(2, 3, "-age", "time_series",
                   " || ' | ' || ".join(values[c] for c in shown),
                   "(SELECT *, row_number() OVER (PARTITION BY k ORDER BY period DESC) AS age "
                   "FROM month) WHERE age <= 6"))
    s.append(_line(3, -1, "0", "segments", "'[Top segments]'", "ov"))
    for g, name in enumerate(names):
        s.append(_line(3, g, "0", "segments", f"'- Segment type: {name}'", "ov"))
        s.append(_line(
            3, g, "rank", "segments",
            f"'  • {name}=''' || segment_value || ''', revenue=' || {num('revenue')} || "
            f"', share=' || {pct('share', 1)}",
            f"sg WHERE segment_type = '{name}' AND rank <= 5"))
    trend_rows = [("Direction", "direction"), ("Current period", ts_text("current_period")),
                  ("Current revenue", plain("current_revenue")),
                  ("Previous period", ts_text("previous_period")),
                  ("Previous revenue", plain("previous_revenue")),
                  ("Absolute change", plain("absolute_change")),
                  ("Percent change", plain("percent_change"))]
    s.append(_line(4, 0, "0", "monthly_trend", "'[Monthly trend summary]'", "ov"))
    s += [_line(4, g, "0", "monthly_trend", f"'- {shown}: ' || {x}", "tr")
          for g, (shown, x) in enumerate(trend_rows, 1)]
    anomaly_rows = [("Status", "status"), ("Last date", ts_text('"current_date"')),
                    ("Last revenue", plain("current_revenue")),
                    ("Expected mean", plain("history_mean")),
                    ("Expected std", plain("history_std")), ("Z-score", plain("z_score"))]
    s.append(_line(5, 0, "0", "anomaly", "'[Recent anomaly check]'", "ov"))
    s += [_line(5, g, "0", "anomaly", f"'- {shown}: ' || {x}", "an")
          for g, (shown, x) in enumerate(anomaly_rows, 1)]
    return "\nUNION ALL ".join(s)


def context_lines(by: str | None = None) -> str:
    names = tuple(s for s in SEGMENTS if s != by)
    return _with(SALES, kpis("sales", by), f"lines AS ({context_body(True, names)})"
                 ) + _numbered(by)


def _joined_context(lines: str = "lines") -> str:
    return (f"SELECT k, string_agg(body, chr(10) || chr(10) ORDER BY sec) AS context FROM ("
            f"SELECT k, sec, string_agg(text, chr(10) ORDER BY g, i) AS body FROM {lines} "
            "GROUP BY k, sec) GROUP BY k")


def context_summary() -> str:
    return _with(SALES, kpis("sales"), f"lines AS ({context_body()})") + (
        f"SELECT context FROM ({_joined_context()})")


# ---------------------------------------------------------------------------
# Documents, embeddings, index
# ---------------------------------------------------------------------------


def docs(source: str, name: str = "docs") -> str:
    return f"""{name} AS (
  SELECT 'txn-' || order_key AS id, order_key AS pos,
    'Transaction txn-' || order_key || ' on ' || {ts_text('date', 'T')} || ', in category '
      || category || ', with amount ' || CAST(amount AS VARCHAR) || ', for customer '
      || customer_id || ', via channel ' || channel || '.' AS text,
    {ts_text('date', 'T')} AS date, amount, category, customer_id, channel
  FROM {source})"""


_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
_DIGIT = r"[^\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def _kept(text: str, pattern: str) -> str:
    return f"CAST(length(regexp_replace({text}, '{pattern}', '', 'g')) AS BIGINT)"


def shape(text: str) -> str:
    """n, letters, digits, spaces of a text."""
    return (f"CAST(length({text}) AS BIGINT) AS e0, {_kept(text, r'[^\p{L}]')} AS e1, "
            f"{_kept(text, _DIGIT)} AS e2, {_kept(text, _SPACE)} AS e3")


def _flat_index(body: str) -> str:
    return body + f"""
SELECT id, pos, text, round(amount, 4) AS amount, CAST(e0 AS DOUBLE) AS e0,
  CAST(e1 AS DOUBLE) AS e1, CAST(e2 AS DOUBLE) AS e2, CAST(e3 AS DOUBLE) AS e3,
  round(sqrt(e0*e0 + e1*e1 + e2*e2 + e3*e3), 6) AS norm
FROM (SELECT *, {shape('text')} FROM merged)"""


_HALVES = """old_tx AS (SELECT * FROM orders_tx WHERE channel IN ('F', 'O')),
new_tx AS (SELECT * REPLACE (amount + 1 AS amount) FROM orders_tx
           WHERE channel IN ('O', 'P'))"""

INDEX_UPSERT = _flat_index(_with(
    ORDERS_TX, _HALVES, docs("old_tx", "old_docs"), docs("new_tx", "new_docs"),
    """merged AS (
  SELECT * FROM old_docs WHERE id NOT IN (SELECT id FROM new_docs)
  UNION ALL
  SELECT n.* REPLACE (coalesce(o.pos, (SELECT max(pos) FROM old_docs) + 1 + n.pos
                                      - (SELECT min(pos) FROM new_docs)) AS pos)
  FROM new_docs n LEFT JOIN old_docs o ON n.id = o.id)"""))

INDEX_REBUILD = _flat_index(_with(
    ORDERS_TX, _HALVES, docs("new_tx", "new_docs"), "merged AS (SELECT * FROM new_docs)"))

TRANSACTION_DOCUMENTS = _with(ORDERS_TX, docs("orders_tx")) + """
SELECT id, pos, text, id AS transaction_id, date, round(amount, 4) AS amount, category,
  CAST(NULL AS VARCHAR) AS product, customer_id, channel, pos AS row_index FROM docs"""

TEXT_EMBEDDINGS = f"""SELECT doc_id, e0 AS n_chars, e1 AS n_letters, e2 AS n_digits,
  e3 AS n_spaces FROM (SELECT doc_id, {shape('text')} FROM documents)"""

_VECTORS = """vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""

COSINE_PAIRS = _with(_VECTORS) + """
SELECT a.vec_id AS pos, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine,
  round(1 / (1 + list_distance(a.embedding, b.embedding) ** 2), 6) AS distance_score
FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1"""


def similar(score: str) -> str:
    return _with(_VECTORS, """cells AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
  FROM vectors)""", """means AS (SELECT label, i, avg(x) AS mean FROM cells GROUP BY ALL)""",
                 """centroids AS (
  SELECT label, list(mean ORDER BY i) AS center FROM means GROUP BY label)""",
                 f"""scored AS (SELECT c.label, v.vec_id, {score} AS score
  FROM centroids c, vectors v)""") + """
SELECT label, rank, CAST(vec_id AS VARCHAR) AS id, vec_id AS pos, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY label
             ORDER BY round(score, 12) DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


# ---------------------------------------------------------------------------
# Retrieval
# ---------------------------------------------------------------------------


def matches(asked: str, keys: str) -> str:
    """CTEs: best five documents per row of ``asked`` (keys, query) by cosine."""
    return f"""asked_shape AS (SELECT {keys}, {shape('query')} FROM {asked}),
doc_shape AS (SELECT *, {shape('text')} FROM docs),
scored AS (
  SELECT {', '.join('q.' + k.strip() for k in keys.split(','))}, d.id, d.pos,
    (q.e0*d.e0 + q.e1*d.e1 + q.e2*d.e2 + q.e3*d.e3)
    / (sqrt(CAST(q.e0*q.e0 + q.e1*q.e1 + q.e2*q.e2 + q.e3*q.e3 AS DOUBLE))
       * sqrt(CAST(d.e0*d.e0 + d.e1*d.e1 + d.e2*d.e2 + d.e3*d.e3 AS DOUBLE))) AS score
  FROM asked_shape q, doc_shape d),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
    ORDER BY round(score, 12) DESC, pos) AS rank FROM scored) WHERE rank <= 5),
found AS (SELECT r.*, d.* EXCLUDE (id, pos) FROM ranked r JOIN docs d USING (id))"""


_KEYS = "conv_id, turn"
_QUESTION_HEAD = "transactions that help answer the following business question: "
ASKED = f"""totals AS (SELECT {total("amount")} AS revenue, count(*) AS n, min(date) AS lo,
  max(date) AS hi FROM orders_tx),
asked AS (
  SELECT conv_id, turn, text AS question,
    '{_QUESTION_HEAD}' || CASE WHEN length(text) > 0
        THEN regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') || '; '
        ELSE '' END
      || 'overall revenue around ' || format('{{:.2f}}', revenue) || '; ' || n
      || ' transactions total' AS query,
    {ts_text('lo')} || ' to ' || {ts_text('hi')} AS date_range
  FROM conversations, totals WHERE role = 'user')"""
RETRIEVAL = _with(ORDERS_TX, docs("orders_tx"), ASKED, matches("asked", _KEYS))

RETRIEVE = RETRIEVAL + f"""
SELECT {_KEYS}, rank, id, round(score, 6) AS score, text, id AS transaction_id, date,
  round(amount, 4) AS amount, category, CAST(NULL AS VARCHAR) AS product, customer_id, channel,
  pos AS row_index FROM found"""

RETRIEVAL_DOCUMENTS = RETRIEVAL + f"""
SELECT {_KEYS}, rank, text AS page_content, id, id AS transaction_id, round(score, 6) AS score,
  round(amount, 4) AS amount, query, 'en' AS language, CAST(5 AS BIGINT) AS top_k
FROM found JOIN asked USING ({_KEYS})"""

RETRIEVAL_JSON = RETRIEVAL + f"""
SELECT {_KEYS}, CAST(to_json({{'query': query, 'top_k': 5, 'language': 'en',
    'filters': {{'date_range': date_range}}, 'matches': items}}) AS VARCHAR) AS context_json
FROM (SELECT {_KEYS}, list({{'id': id, 'score': score, 'transaction_id': id, 'date': date,
        'amount': amount, 'category': category, 'product': CAST(NULL AS VARCHAR),
        'customer_id': customer_id, 'channel': channel, 'row_index': pos}} ORDER BY rank)
      AS items FROM found GROUP BY ALL) JOIN asked USING ({_KEYS})"""

SEARCH_LINES = RETRIEVAL + f"""
SELECT {_KEYS}, rank, rank || '. ' || date || ' | id=' || id || ' | category=' || category
  || ' | product=? | amount=' || CAST(amount AS VARCHAR) || ' | similarity='
  || format('{{:.3f}}', score) AS line FROM found"""


def block(keys: str, language: str, audience: str, max_chars: int, marker: str) -> str:
    """Body of a CTE: the context block per question."""
    category, product, amount, similarity = BLOCK_FIELDS[language]
    return f"""SELECT {keys}, CASE WHEN length(b) > {max_chars}
    THEN substring(b, 1, {max_chars}) || {lit(marker)} ELSE b END AS block
FROM (SELECT {keys}, {lit(BLOCK_HEADERS[audience, language])} || chr(10) || string_agg(
    rank || '. ' || date || ' | {category}=' || category || ' | {product}=- | {amount}='
    || format('{{:,.2f}}', amount) || ' | {similarity}=' || format('{{:.3f}}', score),
    chr(10) ORDER BY rank) AS b FROM found GROUP BY {keys})"""


_MARKER = "\n[Context truncated for length]"
_LONG_MARKER = "\n\n[Context truncated for length]"
ORDER_SEGMENTS = ("category", "customer_id", "channel")
_ORDER_KPIS = kpis("orders_tx", None, False, ORDER_SEGMENTS)
_REPORT_HEAD = "transactions that best explain the following aspects of the data: "
REPORT_ASKED = f"""report_asked AS (
  SELECT k, '{_REPORT_HEAD}overall revenue around ' || format('{{:.2f}}', total_revenue)
      || '; ' || n_transactions || ' transactions total; month-over-month trend for '
      || {ts_text('current_period')} || ' vs ' || {ts_text('previous_period')}
      || CASE WHEN status IN ('high', 'low') THEN '; recent daily revenue anomaly'
              ELSE '' END AS query,
    {ts_text('current_period')} AS current_period, {ts_text('"current_date"')} AS anomaly_date
  FROM ov JOIN tr USING (k) JOIN an USING (k))"""
_REPORT_CTES = (ORDERS_TX, docs("orders_tx"), _ORDER_KPIS, REPORT_ASKED,
                matches("report_asked", "k"))

REPORT_RETRIEVAL = _with(*_REPORT_CTES) + """
SELECT query, current_period, anomaly_date, rank, id, round(score, 6) AS score, date,
  round(amount, 4) AS amount, category, text FROM found JOIN report_asked USING (k)"""


def report_prompts(language: str, hybrid: bool) -> str:
    parts = [*_REPORT_CTES, f"lines AS ({context_body(False, ORDER_SEGMENTS)})",
             f"ctx AS ({_joined_context()})",
             f"blocks AS ({block('k', language, 'report', 1200, '')})"]
    head = prompts.REPORT_INSTRUCTIONS[language] + "\n\n" + prompts.SUMMARY_HEADING + "\n"
    user = f"{lit(head)} || context"
    join = "ctx JOIN blocks USING (k)"
    if hybrid:
        parts += [f"rlines AS ({report_lines(language, False, ORDER_SEGMENTS)})",
                  "rep AS (SELECT k, string_agg(text, chr(10) ORDER BY sec, g, i) AS report "
                  "FROM rlines GROUP BY k)"]
        tail = "\n\n" + prompts.TEMPLATE_HEADING + "\n"
        user += f" || {lit(tail)} || report"
        join += " JOIN rep USING (k)"
    return _with(*parts) + (
        f"SELECT {lit(prompts.SYSTEM_REPORT[language])} AS system_prompt, "
        f"{user} || chr(10) || chr(10) || block AS user_prompt FROM {join}")


def question_prompts(language: str, with_blocks: bool, max_chars: int) -> str:
    commands = "\n".join([prompts.COMMANDS_HEADING[language], *[
        f"- {c}: {d}" for c, d in prompts.COMMANDS[language].items()]])
    head = (prompts.QUESTION_INSTRUCTIONS[language] + "\n\n" + commands + "\n\n"
            + prompts.SUMMARY_HEADING + "\n")
    middle = f"\n\n{prompts.QUESTION_LABEL[language]}:\n"
    user = f"{lit(head)} || context || {lit(middle)} || trim(question, ' ' || chr(10) || chr(9))"
    parts = [ORDERS_TX, docs("orders_tx"), _ORDER_KPIS, ASKED,
             f"lines AS ({context_body(False, ORDER_SEGMENTS)})", f"ctx AS ({_joined_context()})"]
    join = "asked CROSS JOIN ctx"
    if with_blocks:
        parts += [matches("asked", _KEYS), f"blocks AS ({block(_KEYS, language, 'chat', 1200, _MARKER)})"]
        join += f" JOIN blocks USING ({_KEYS})"
        user += " || chr(10) || chr(10) || block"
    return _with(*parts) + (
        f"SELECT {_KEYS}, {lit(prompts.SYSTEM_CHAT[language])} AS system_prompt, "
        f"CASE WHEN length(u) > {max_chars} THEN substring(u, 1, {max_chars}) || "
        f"{lit(_LONG_MARKER)} ELSE u END AS user_prompt FROM (SELECT {_KEYS}, {user} AS u "
        f"FROM {join})")


_CLEAN = "p_date IS NOT NULL AND p_amount IS NOT NULL"

ORACLE_SQL: dict[str, str] = {
    "validation_report": _with(RAW_ORDERS, PARSED) + f"""
SELECT count(*) AS n_rows, CAST({len(DEFAULT_COLUMNS)} AS BIGINT) AS n_columns,
  '' AS missing_required_columns,
  count(*) FILTER (WHERE order_date IS NOT NULL AND p_date IS NULL) AS invalid_dates,
  count(*) FILTER (WHERE total_price IS NOT NULL AND p_amount IS NULL) AS invalid_amounts,
  count(*) FILTER (WHERE cost IS NOT NULL AND p_cost IS NULL) AS invalid_costs FROM parsed""",
    "cleaning_summary": _with(RAW_ORDERS, PARSED) + f"""
SELECT count(*) AS original_rows, count(*) FILTER (WHERE {_CLEAN}) AS clean_rows,
  count(*) FILTER (WHERE NOT ({_CLEAN})) AS dropped_rows,
  strftime(min(p_date) FILTER (WHERE {_CLEAN}), '%Y-%m-%dT%H:%M:%S') AS date_min,
  strftime(max(p_date) FILTER (WHERE {_CLEAN}), '%Y-%m-%dT%H:%M:%S') AS date_max
FROM parsed""",
    "clean_transactions": _with(RAW_ORDERS, PARSED) + f"""
SELECT order_key, {ts_text('p_date')} AS date, round(p_amount, 4) AS amount,
  round(p_cost, 4) AS cost, category, customer_id, sales_channel AS channel
FROM parsed WHERE {_CLEAN}""",
    "broken_csv_rows": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_key,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total_price,
  CASE WHEN o_orderkey % 53 <> 0 AND o_orderkey % 47 <> 0
       THEN o_orderstatus || ', order' END AS status,
  CASE WHEN o_orderkey % 53 = 0 THEN 3 WHEN o_orderkey % 47 = 0 THEN 5 END AS n_fields,
  CASE WHEN o_orderkey % 53 = 0 THEN 'too few fields'
       WHEN o_orderkey % 47 = 0 THEN 'too many fields' END AS cause
FROM orders""",
    "clean_sink_touched": _with(RAW_ORDERS, PARSED) + f"""
SELECT order_key, {ts_text('p_date')} AS date,
  round(p_amount + CASE WHEN year(p_date) = 1997 THEN 1 ELSE 0 END, 4) AS amount,
  round(p_cost, 4) AS cost, category, customer_id, sales_channel AS channel
FROM parsed WHERE {_CLEAN}""",
    "overall_metrics": _with(SALES, kpis("sales")) + f"""
SELECT round(total_revenue, 2) AS total_revenue, round(total_cost, 2) AS total_cost,
  round(gross_profit, 2) AS gross_profit, round(gross_margin_pct, 6) AS gross_margin_pct,
  n_transactions, round(avg_order_value, 6) AS avg_order_value,
  {ts_text('date_min')} AS date_min, {ts_text('date_max')} AS date_max FROM ov""",
    "revenue_daily": series("sales", SALES, "day"),
    "revenue_weekly": series("sales", SALES, "week"),
    "revenue_monthly": series("sales", SALES, "month"),
    "revenue_daily_purchases": series("purchases", PURCHASES, "day", cost=False),
    "revenue_daily_streamed": series("orders_tx", ORDERS_TX, "day", cost=False),
    "segment_category": segment("category"),
    "segment_product": segment("product"),
    "segment_customer": segment("customer_id"),
    "segment_channel": segment("channel"),
    "segment_all": segment("customer_id", None),
    "monthly_trend": trend(),
    "anomaly_last_day": anomaly("orders_tx", ORDERS_TX, None, False, ORDER_SEGMENTS),
    "monthly_trend_by_channel": trend("channel"),
    "anomaly_by_channel": anomaly("sales", SALES, "channel"),
    "anomaly_every_day": anomalies("orders_tx", ORDERS_TX, None, False, ORDER_SEGMENTS),
    "anomaly_every_day_by_channel": anomalies("sales", SALES, "channel", empty_days=False),
    "metrics_bundle_long": metrics_long(),
    "metrics_bundle_by_channel": metrics_long("channel"),
    "report_overview": report_section("overview"),
    "report_segments": report_section("segments"),
    "report_trend": report_section("trend"),
    "report_anomaly": report_section("anomaly"),
    "full_report": full_report("en"),
    "full_report_id": full_report("id"),
    "full_report_by_channel": full_report("en", "channel"),
    "context_lines": context_lines(),
    "context_lines_by_channel": context_lines("channel"),
    "context_summary": context_summary(),
    "transaction_documents": TRANSACTION_DOCUMENTS,
    "text_embeddings": TEXT_EMBEDDINGS,
    "cosine_pairs": COSINE_PAIRS,
    "similar_topk": similar("list_cosine_similarity(v.embedding, c.center)"),
    "similar_topk_l2": similar("1 / (1 + list_distance(v.embedding, c.center) ** 2)"),
    "index_upsert": INDEX_UPSERT,
    "index_upsert_stored": INDEX_UPSERT,
    "index_rebuild": INDEX_REBUILD,
    "retrieve_for_questions": RETRIEVE,
    "retrieval_json": RETRIEVAL_JSON,
    "retrieval_documents": RETRIEVAL_DOCUMENTS,
    "search_result_lines": SEARCH_LINES,
    "rag_context_block": RETRIEVAL + block(_KEYS, "en", "chat", 1200, ""),
    "rag_context_block_id": RETRIEVAL + block(_KEYS, "id", "report", 1_200, _MARKER),
    "report_retrieval": REPORT_RETRIEVAL,
    "report_prompts": report_prompts("en", False),
    "report_prompts_hybrid_id": report_prompts("id", True),
    "question_prompts": question_prompts("en", True, 12_000),
    "question_prompts_id": question_prompts("id", False, 1_000_000),
}
