"""SQL for DuckDB that states the expected result of each query on its own."""

from __future__ import annotations

from weektide import constants as K
from weektide.models.search import draw

ORACLE: dict[str, str] = {}


def r(*names: str) -> str:
    return ", ".join(f"ROUND({n}, 6) + 0.0 AS {n}" for n in names)


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def code_case(column: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{code}'" for i, code in enumerate(K.MAJOR_CODES))
    return f"CASE {column} {arms} WHEN 11 THEN NULL ELSE 'ZZ' || CAST({column} AS VARCHAR) END"


GEO_CASE = (
    "CASE l_partkey % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'CH' WHEN 2 THEN 'RS' WHEN 3 THEN 'IR' "
    "WHEN 4 THEN 'IS' WHEN 5 THEN 'SY' WHEN 6 THEN 'UK' END"
)

LINE_COLUMNS = f"""l_orderkey, l_linenumber,
  CAST(l_shipdate AS DATE) AS ship_date,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
  {GEO_CASE} AS geo,
  LPAD(CAST(1 + l_partkey % 20 AS VARCHAR), 2, '0') AS root,
  LPAD(CAST(1 + l_partkey % 20 AS VARCHAR), 2, '0') || CAST(l_linenumber % 10 AS VARCHAR) AS code,
  CAST(1 + (l_linenumber - 1) % 4 AS INTEGER) AS quad,
  ROUND((0.05 - l_discount) * 200, 1) AS goldstein,
  CAST(CAST(l_quantity AS INTEGER) AS BIGINT) AS mentions,
  CAST(CAST(l_quantity AS INTEGER) + l_linenumber AS BIGINT) AS articles,
  ROUND((l_tax - 0.04) * 100, 2) AS tone,
  CASE l_suppkey % 10 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS major,
  CASE WHEN l_orderkey % 10 <> 0 THEN 'https://example.test/' || CAST(l_orderkey AS VARCHAR) END AS url"""

LINES = f"lines AS (SELECT {LINE_COLUMNS} FROM lineitem)"

EVENTS = f"""ev AS (
  SELECT {LINE_COLUMNS},
    CAST(o_orderdate AS DATE) AS ref_date,
    CAST(date_trunc('week', o_orderdate) AS DATE) AS ref_week,
    c_name AS actor1_name,
    {code_case('c_nationkey')} AS actor1,
    {code_case('s_nationkey')} AS actor2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""

COUNTRIES = f"countries AS (SELECT {code_case('n_nationkey')} AS code, n_name AS name FROM nation WHERE n_nationkey < 23)"

CODES = """codes AS (
  SELECT LPAD(CAST(1 + p_partkey % 20 AS VARCHAR), 2, '0') || CAST(1 + p_partkey % 7 AS VARCHAR) AS code,
    MIN(p_name) AS description
  FROM part WHERE 1 + p_partkey % 20 <> 13 AND 1 + p_partkey % 7 <> 5 GROUP BY 1)"""

ROOT_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ROOT_DESCRIPTIONS.items()) + " END"
QUAD_CASE = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.QUAD_LABELS.items()) + " END"

DIRTY = """
  CASE WHEN l_linenumber = 7 THEN NULL ELSE {day} END AS day,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE goldstein END AS goldstein,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE mentions END AS mentions,
  CASE WHEN l_orderkey % 11 <> 0 THEN tone END AS tone,
  CASE WHEN l_linenumber <> 4 THEN 'class ' || CAST(quad AS VARCHAR) END AS label,
  CASE WHEN l_linenumber <> 3 THEN 'root ' || root END AS root_text,
  CASE WHEN l_linenumber % 2 = 0 THEN 'event ' || code END AS event_text"""
DIRTY_LINES = f"dirty AS (SELECT l_orderkey, l_linenumber, geo, {DIRTY.format(day='ship_date')} FROM lines)"
DIRTY_EVENTS = (
    "dirty AS (SELECT l_orderkey, l_linenumber, week, geo, actor1, actor2, code, quad, major, "
    f"{DIRTY.format(day='ship_date')} FROM ev)"
)
CLEAN = (
    "clean AS (SELECT * FROM dirty WHERE day IS NOT NULL AND goldstein IS NOT NULL "
    "AND mentions IS NOT NULL AND tone IS NOT NULL)"
)

RAW_CODES = """raw AS (
  SELECT l_orderkey, l_linenumber, quad, geo,
    CASE l_linenumber WHEN 4 THEN '0' || code ELSE LPAD(CAST(CAST(code AS INTEGER) AS VARCHAR), 3, '0') END AS code,
    CASE l_linenumber WHEN 6 THEN '07' ELSE root END AS root
  FROM lines)"""


def flag(condition: str) -> str:
    return f"COALESCE({condition}, FALSE)"


MAJOR_LIST = quoted(K.MAJOR_CODES)
PLACE = " OR ".join(flag(f"{c} IN ({MAJOR_LIST})") for c in ("actor1", "actor2", "geo"))
MAJOR = f"({PLACE} OR {flag('major = 1')})"


def involves(actor: str, geo: str) -> str:
    return f"({flag(f'''actor1 = '{actor}' ''')} OR {flag(f'''actor2 = '{actor}' ''')} OR {flag(f'''geo = '{geo}' ''')})"


def pair(a: str, b: str) -> str:
    return (
        f"({flag(f'''actor1 = '{a}' AND actor2 = '{b}' ''')} OR {flag(f'''actor1 = '{b}' AND actor2 = '{a}' ''')})"
    )


USA, CHINA, RUSSIA = involves("USA", "US"), involves("CHN", "CH"), involves("RUS", "RS")
MIDDLE_EAST = flag(f"geo IN ({quoted(K.MIDDLE_EAST_GEO)})")
NEGATIVE = "(CASE WHEN goldstein < 0 THEN -goldstein ELSE 0.0 END * mentions)"
POSITIVE = "(CASE WHEN goldstein > 0 THEN goldstein ELSE 0.0 END * mentions)"


def sum_if(condition: str, value: str = "mentions", kind: str = "BIGINT") -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN {value} ELSE 0 END) AS {kind})"


def weekly_sql(source: str, name: str = "weekly", material: int = 4, week: str = "week") -> str:
    m = f"quad = {material}"
    return f"""{name}_sums AS (
  SELECT {week} AS week, COUNT(code) AS nb_events, CAST(SUM(mentions) AS BIGINT) AS total_mentions,
    CAST(SUM(articles) AS BIGINT) AS total_articles,
    AVG(goldstein) AS avg_goldstein, MIN(goldstein) AS min_goldstein, AVG(tone) AS avg_tone, MIN(tone) AS min_tone,
    SUM({NEGATIVE}) AS tension_score, SUM({POSITIVE}) AS cooperation_score,
    {sum_if('quad = 3')} AS verbal_conflict_mentions, {sum_if(m)} AS material_conflict_mentions,
    {sum_if('quad = 1')} AS verbal_coop_mentions, {sum_if('quad = 2')} AS material_coop_mentions,
    {sum_if(MAJOR, '1')} AS major_country_events,
    {sum_if(f'{MAJOR} AND {m}')} AS major_country_conflict_mentions,
    {sum_if(f'{USA} AND {m}')} AS usa_conflict_mentions,
    {sum_if(f'{CHINA} AND {m}')} AS china_conflict_mentions,
    {sum_if(f'{RUSSIA} AND {m}')} AS russia_conflict_mentions,
    {sum_if(f'{MIDDLE_EAST} AND {m}')} AS middle_east_conflict_mentions,
    {sum_if(pair('USA', 'CHN'), NEGATIVE, 'DOUBLE')} AS usa_china_tension,
    {sum_if(pair('USA', 'RUS'), NEGATIVE, 'DOUBLE')} AS usa_russia_tension
  FROM {source} GROUP BY 1),
{name} AS (
  SELECT *, verbal_conflict_mentions + material_conflict_mentions AS conflict_mentions,
    verbal_coop_mentions + material_coop_mentions AS coop_mentions,
    (verbal_conflict_mentions + material_conflict_mentions) / CAST(total_mentions + 1 AS DOUBLE) AS conflict_ratio,
    material_conflict_mentions / CAST(total_mentions + 1 AS DOUBLE) AS material_conflict_ratio,
    major_country_conflict_mentions / CAST(total_mentions + 1 AS DOUBLE) AS major_conflict_ratio
  FROM {name}_sums)"""


WEEKLY = f"{EVENTS}, {weekly_sql('ev')}"

LITE = f"""lite AS (
  SELECT week, COUNT(code) AS nb_events, CAST(SUM(mentions) AS BIGINT) AS total_mentions,
    AVG(goldstein) AS avg_goldstein, AVG(tone) AS avg_tone, SUM({NEGATIVE}) AS tension_score,
    {sum_if('quad = 4')} AS mat_conf_mentions, {sum_if('quad = 3')} AS verb_conf_mentions
  FROM lines GROUP BY week)"""


def day_sql(source: str, material: int) -> str:
    return f"""days AS (
  SELECT ship_date AS ingest_date, ref_week AS week, COUNT(code) AS nb_events, AVG(tone) AS avg_tone,
    SUM({NEGATIVE}) AS tension_score, {sum_if(f'quad = {material}')} AS mat_conf_mentions
  FROM {source} GROUP BY ALL),
live AS (
  SELECT week, CAST(SUM(nb_events) AS BIGINT) AS nb_events, AVG(avg_tone) AS avg_tone,
    SUM(tension_score) AS tension_score, CAST(SUM(mat_conf_mentions) AS BIGINT) AS mat_conf_mentions
  FROM days GROUP BY week)"""


LAST_DROP = "(SELECT MAX(CAST(l_shipdate AS DATE)) FROM lineitem)"
RECENT = f"recent AS (SELECT * FROM ev WHERE ship_date BETWEEN {LAST_DROP} - 6 AND {LAST_DROP})"


def prices_sql(ticker: str = "c_mktsegment", kept: str = "TRUE") -> str:
    return f"""prices AS (
  SELECT CAST({ticker} AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS d, MAX(o_totalprice) AS px
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING {kept})"""


def market_sql(ticker: str = "c_mktsegment", kept: str = "TRUE") -> str:
    return f"""{prices_sql(ticker, kept)},
known AS (
  SELECT ticker, CAST(date_trunc('week', d + INTERVAL 6 DAY) AS DATE) AS week, MAX_BY(px, d) AS px
  FROM prices GROUP BY ALL),
calendar AS (
  SELECT ticker, CAST(UNNEST(generate_series(MIN(week), MAX(week), INTERVAL 7 DAY)) AS DATE) AS week
  FROM known GROUP BY ticker),
dense AS (SELECT c.ticker, c.week, k.px FROM calendar c LEFT JOIN known k ON c.ticker = k.ticker AND c.week = k.week),
carried AS (
  SELECT *, LAST_VALUE(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY week ROWS UNBOUNDED PRECEDING) AS pad
  FROM dense),
returned AS (
  SELECT *, pad / NULLIF(LAG(pad) OVER (PARTITION BY ticker ORDER BY week), 0) - 1 AS ret FROM carried),
mk AS (
  SELECT ticker, week, px AS weekly_price, ret AS weekly_return_current,
    CASE WHEN COUNT(ret) OVER w4 >= 4 THEN STDDEV_SAMP(ret) OVER w4 END AS vol_4w,
    CASE WHEN COUNT(ret) OVER w8 >= 8 THEN STDDEV_SAMP(ret) OVER w8 END AS vol_8w,
    CASE WHEN COUNT(ret) OVER w12 >= 12 THEN STDDEV_SAMP(ret) OVER w12 END AS vol_12w,
    pad / NULLIF(LAG(pad, 4) OVER w, 0) - 1 AS momentum_4w,
    pad / NULLIF(LAG(pad, 12) OVER w, 0) - 1 AS momentum_12w,
    pad / NULLIF(LAG(pad, 26) OVER w, 0) - 1 AS momentum_26w,
    px / NULLIF(CASE WHEN COUNT(px) OVER w26 >= 26 THEN MAX(px) OVER w26 END, 0) - 1 AS drawdown_26w,
    LEAD(px, 4) OVER w / NULLIF(px, 0) - 1 AS future_return_4w
  FROM returned
  WINDOW w AS (PARTITION BY ticker ORDER BY week),
    w4 AS (PARTITION BY ticker ORDER BY week ROWS 3 PRECEDING),
    w8 AS (PARTITION BY ticker ORDER BY week ROWS 7 PRECEDING),
    w12 AS (PARTITION BY ticker ORDER BY week ROWS 11 PRECEDING),
    w26 AS (PARTITION BY ticker ORDER BY week ROWS 25 PRECEDING))"""


def zscore(x: str) -> str:
    w = "OVER (PARTITION BY ticker ORDER BY week ROWS 51 PRECEDING)"
    return f"CASE WHEN COUNT({x}) {w} >= 20 THEN ({x} - AVG({x}) {w}) / (STDDEV_SAMP({x}) {w} + 1e-9) END"


MARKET = market_sql()


def vix_sql(market: str) -> str:
    return f"""{market},
aligned AS (
  SELECT mk.*, v.px AS vix FROM mk LEFT JOIN (SELECT week, px FROM dense WHERE ticker = 'MACHINERY') v ON mk.week = v.week),
mv AS (
  SELECT *, vix - LAG(vix) OVER (PARTITION BY ticker ORDER BY week) AS vix_delta_1w, {zscore('vix')} AS vix_zscore_52w
  FROM aligned)"""


VIX = vix_sql(MARKET)
GAP = "NOT (ANY_VALUE(c_mktsegment) = 'MACHINERY' AND ANY_VALUE(CAST(o_orderdate AS DATE)) BETWEEN DATE '2001-07-01' AND DATE '2001-07-31')"
GAPPY_VIX = vix_sql(market_sql(kept=GAP))

MARKET_NAMES = [
    "weekly_price",
    "weekly_return_current",
    "vol_4w",
    "vol_8w",
    "vol_12w",
    "momentum_4w",
    "momentum_12w",
    "momentum_26w",
    "drawdown_26w",
    "future_return_4w",
    "vix",
    "vix_delta_1w",
    "vix_zscore_52w",
]

PANEL = f"""{WEEKLY}, {VIX},
joined AS (
  SELECT weekly.*, mv.* EXCLUDE (week) FROM weekly JOIN mv ON weekly.week = mv.week
  WHERE {' AND '.join(f'mv.{n} IS NOT NULL' for n in MARKET_NAMES)})"""

LAG_W = "OVER (PARTITION BY ticker ORDER BY week)"
LAGS = ", ".join(
    f"LAG({n}) {LAG_W} AS {n}_lag1, LAG({n}, 2) {LAG_W} AS {n}_lag2, {n} - LAG({n}) {LAG_W} AS {n}_delta1"
    for n in K.EVENT_FEATURES
)
SCORES = ", ".join(f"{zscore(n)} AS {n}_zscore_52w" for n in K.EVENT_FEATURES)


def temporal_sql(source: str, complete: list[str] = ()) -> str:
    present = "".join(f" AND {n} IS NOT NULL" for n in complete)
    return f"""temporal AS (SELECT *, {LAGS}, {SCORES} FROM {source}),
finished AS (
  SELECT *, tension_score_zscore_52w * vol_4w AS tension_x_vol_4w,
    material_conflict_ratio_zscore_52w * ABS(drawdown_26w) AS conflict_x_drawdown,
    vix_zscore_52w * tension_score_zscore_52w AS vix_x_tension
  FROM temporal WHERE nb_events_lag2 IS NOT NULL AND nb_events_zscore_52w IS NOT NULL{present})"""


LIVE_NAMES = [n for n in MARKET_NAMES if n not in ("weekly_price", "future_return_4w")]


def filled_sql(weeks: str, names: list[str], out: str = "filled") -> str:
    past = "OVER (PARTITION BY ticker ORDER BY week ROWS UNBOUNDED PRECEDING)"
    whole = "OVER (PARTITION BY ticker ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    fills = ", ".join(
        f"COALESCE(LAST_VALUE({n} IGNORE NULLS) {past}, FIRST_VALUE({n} IGNORE NULLS) {whole}) AS {n}" for n in names
    )
    return f"""scaffold AS (SELECT w.*, t.ticker FROM {weeks} w CROSS JOIN (SELECT DISTINCT ticker FROM mv) t),
sparse AS (
  SELECT s.*, {', '.join(f'z.{n}' for n in names)} FROM scaffold s
  LEFT JOIN (SELECT ticker, week, {', '.join(names)} FROM mv) z ON s.ticker = z.ticker AND s.week = z.week),
{out} AS (SELECT * EXCLUDE ({', '.join(names)}), {fills} FROM sparse)"""


FEATURE_NAMES = (
    [
        "nb_events", "total_mentions", "total_articles", "avg_goldstein", "min_goldstein", "avg_tone", "min_tone",
        "tension_score", "cooperation_score", "verbal_conflict_mentions", "material_conflict_mentions",
        "verbal_coop_mentions", "material_coop_mentions", "major_country_events", "major_country_conflict_mentions",
        "usa_conflict_mentions", "china_conflict_mentions", "russia_conflict_mentions", "middle_east_conflict_mentions",
        "usa_china_tension", "usa_russia_tension", "conflict_mentions", "coop_mentions", "conflict_ratio",
        "material_conflict_ratio", "major_conflict_ratio",
    ]
    + LIVE_NAMES
    + [f"{n}{s}" for n in K.EVENT_FEATURES for s in K.TEMPORAL_SUFFIXES]
    + ["tension_x_vol_4w", "conflict_x_drawdown", "vix_x_tension"]
)
LIVE = f"{WEEKLY}, {GAPPY_VIX}, {filled_sql('weekly', LIVE_NAMES)}, {temporal_sql('filled', LIVE_NAMES)}"

RISK = "CASE WHEN goldstein < 0 THEN -goldstein * mentions ELSE 0.0 END"
REGIONS = quoted(K.RADAR_REGIONS)


def radar_sql(source: str) -> str:
    return f"""candidates AS (
  SELECT ref_date AS "SQLDATE", actor1_name AS "Actor1Name", geo AS "ActionGeo_CountryCode",
    goldstein AS "GoldsteinScale", mentions AS "NumMentions", url AS "SOURCEURL", {RISK} AS "RiskScore", ship_date
  FROM {source} WHERE (actor1 IN ({REGIONS}) OR actor2 IN ({REGIONS})) AND url IS NOT NULL)"""


RADAR_SHOWN = ", ".join(f'"{n}"' for n in K.RADAR_COLUMNS)


def radar_order(names: list[str]) -> str:
    rest = ", ".join(f'"{n}" NULLS FIRST' for n in names if n != "RiskScore")
    return f'"RiskScore" DESC, {rest}'


DECODED = f"""{EVENTS}, {COUNTRIES}, {CODES},
broken AS (SELECT *, CASE WHEN l_linenumber = 6 THEN '07' ELSE root END AS root_code FROM ev),
decoded AS (
  SELECT b.actor1, b.code AS "EventCode", b.root_code AS "EventRootCode", SUBSTR(b.code, 1, 2) AS "EventRootFromEventCode",
    c.description AS "EventDescription", {ROOT_CASE.format('b.root_code')} AS "EventRootDescription",
    COALESCE(c.description, {ROOT_CASE.format('b.root_code')}) AS "EventDescriptionFinal",
    n1.name AS "Actor1CountryName", n2.name AS "Actor2CountryName", n3.name AS "ActionGeo_CountryName"
  FROM broken b LEFT JOIN codes c ON b.code = c.code
  LEFT JOIN countries n1 ON b.actor1 = n1.code LEFT JOIN countries n2 ON b.actor2 = n2.code
  LEFT JOIN countries n3 ON b.geo = n3.code)"""
CODE_VIEW = '"EventCode", "EventRootCode", "EventDescription", "EventRootDescription", "EventDescriptionFinal"'


def first_order(columns: str) -> str:
    return ", ".join(f"{c.strip()} NULLS FIRST" for c in columns.split(","))


GUESSED = f"""{MARKET},
guessed AS (
  SELECT ticker, week, CASE WHEN future_return_4w <= -0.15 THEN 1 ELSE 0 END AS label,
    CASE WHEN drawdown_26w > -0.1 THEN 1 ELSE 0 END AS prediction,
    CASE WHEN week < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split
  FROM mk WHERE future_return_4w IS NOT NULL)"""
COUNTS = f"""{GUESSED},
counts AS (
  SELECT ticker, COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS a, COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS b,
    COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS c, COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS d
  FROM guessed GROUP BY ticker)"""


def share(part: str, whole: str) -> str:
    return f"COALESCE(CAST({part} AS DOUBLE) / NULLIF({whole}, 0), 0.0)"


# --- sources ---------------------------------------------------------------------------

ORACLE["read_stack"] = f"""WITH {LINES}
SELECT ship_date AS "SQLDATE", code AS "EventCode", mentions AS "NumMentions",
  CASE WHEN YEAR(ship_date) < 1999 THEN articles END AS "NumArticles" FROM lines"""

ORACLE["last_seven_days"] = f"""WITH {LINES}
SELECT ship_date AS ingest_date, code AS "EventCode", goldstein AS "GoldsteinScale", mentions AS "NumMentions"
FROM lines WHERE ship_date BETWEEN {LAST_DROP} - 6 AND {LAST_DROP}"""

ORACLE["price_fallback"] = """SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS d,
  COALESCE(MAX(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END), MAX(o_totalprice)) AS px
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""

ORACLE["yearly_table"] = f"""WITH {WEEKLY}
SELECT week, nb_events, {r('tension_score')}, CAST(YEAR(week) AS INTEGER) AS year FROM weekly"""

ORACLE["lookup_files"] = f"""WITH {COUNTRIES}, {CODES}
SELECT code, description AS text FROM codes UNION ALL SELECT code, name FROM countries WHERE code IS NOT NULL"""

# --- cleaning --------------------------------------------------------------------------

ORACLE["parse_dates"] = f"""WITH {LINES}
SELECT l_orderkey, l_linenumber, ship_date AS "SQLDATE", CAST(YEAR(ship_date) AS INTEGER) AS year, week
FROM lines WHERE l_linenumber <> 7"""

ORACLE["numeric_coerce"] = f"""WITH {LINES}, {DIRTY_LINES}
SELECT l_orderkey, l_linenumber, goldstein AS "GoldsteinScale", mentions AS "NumMentions", tone AS "AvgTone",
  COALESCE(goldstein, 0.0) AS "GoldsteinScale_or_zero", COALESCE(mentions, 0) AS "NumMentions_or_zero",
  COALESCE(tone, 0.0) AS "AvgTone_or_zero" FROM dirty"""

ORACLE["clean_rows"] = f"""WITH {EVENTS}, {DIRTY_EVENTS}, {CLEAN}
SELECT l_orderkey, l_linenumber, week, COALESCE(actor1, 'UNK') AS "Actor1CountryCode",
  COALESCE(actor2, 'UNK') AS "Actor2CountryCode", COALESCE(geo, 'UNK') AS "ActionGeo_CountryCode",
  goldstein AS "GoldsteinScale", mentions AS "NumMentions", tone AS "AvgTone",
  COALESCE(label, 'Unknown') AS "QuadClassLabel", COALESCE(root_text, 'Unknown') AS "EventRootDescription",
  COALESCE(event_text, root_text, 'Unknown') AS "EventDescriptionFinal" FROM clean"""

ORACLE["clean_rows_lite"] = f"""WITH {LINES}, dirty AS (SELECT l_orderkey, l_linenumber, week, ship_date, {DIRTY.format(day='ship_date')} FROM lines)
SELECT l_orderkey, l_linenumber, CAST(YEAR(ship_date) AS INTEGER) AS year, week,
  COALESCE(event_text, CASE WHEN l_linenumber <> 1 THEN root_text END) AS "EventDescriptionFinal", mentions AS "NumMentions"
FROM dirty WHERE goldstein IS NOT NULL AND mentions IS NOT NULL AND tone IS NOT NULL
  AND COALESCE(event_text, CASE WHEN l_linenumber <> 1 THEN root_text END) IS NOT NULL"""

ORACLE["fill_fallback"] = f"""WITH {LINES}, {DIRTY_LINES}
SELECT l_orderkey, l_linenumber, COALESCE(geo, 'UNK') AS "ActionGeo_CountryCode", COALESCE(label, 'Unknown') AS "QuadClassLabel",
  COALESCE(root_text, 'Unknown') AS "EventRootDescription", COALESCE(event_text, root_text, 'Unknown') AS "EventDescriptionFinal"
FROM dirty"""

ORACLE["pad_codes"] = f"""WITH {LINES}, {RAW_CODES}
SELECT l_orderkey, l_linenumber, code, root AS root_code, SUBSTR(code, 1, 2) AS root_of_code FROM raw"""

ORACLE["trim_codes"] = f"""WITH {LINES} SELECT l_orderkey, l_linenumber, geo AS "ActionGeo_CountryCode" FROM lines"""

# --- lookups ---------------------------------------------------------------------------

ORACLE["country_lookup"] = f"""WITH {EVENTS}, {COUNTRIES}
SELECT l_orderkey, l_linenumber, actor1 AS "Actor1CountryCode", actor2 AS "Actor2CountryCode", geo AS "ActionGeo_CountryCode",
  a.name AS "Actor1CountryName", b.name AS "Actor2CountryName", c.name AS "ActionGeo_CountryName"
FROM ev LEFT JOIN countries a ON actor1 = a.code LEFT JOIN countries b ON actor2 = b.code LEFT JOIN countries c ON geo = c.code"""

ORACLE["event_lookup"] = f"""WITH {LINES}, {CODES}
SELECT l_orderkey, l_linenumber, lines.code AS "EventCode", root AS "EventRootCode", description AS "EventDescription",
  {ROOT_CASE.format('root')} AS "EventRootDescription", COALESCE(description, {ROOT_CASE.format('root')}) AS "EventDescriptionFinal"
FROM lines LEFT JOIN codes ON lines.code = codes.code"""

ORACLE["live_codes"] = f"""WITH {LINES}, {CODES}, {RAW_CODES}
SELECT l_orderkey, l_linenumber, raw.code AS "EventCodeMapped", COALESCE(description, raw.code) AS "EventDescriptionFinal",
  {QUAD_CASE.format('quad')} AS "QuadClassLabel", CAST({flag(f'geo IN ({MAJOR_LIST})')} AS INTEGER) AS is_major_country
FROM raw LEFT JOIN codes ON raw.code = codes.code"""

ORACLE["quad_root_labels"] = f"""WITH {LINES}
SELECT l_orderkey, l_linenumber, {QUAD_CASE.format('quad')} AS quad_label, {ROOT_CASE.format('root')} AS root_description FROM lines"""

# --- predicates ------------------------------------------------------------------------

ORACLE["country_flags"] = f"""WITH {EVENTS}
SELECT l_orderkey, l_linenumber, {MAJOR} AS major_actor_event, {USA} AS usa_event, {CHINA} AS china_event,
  {RUSSIA} AS russia_event, {MIDDLE_EAST} AS middle_east_event FROM ev"""

ORACLE["pair_flags"] = f"""WITH {EVENTS}
SELECT l_orderkey, l_linenumber, {pair('USA', 'CHN')} AS usa_china_relation, {pair('USA', 'RUS')} AS usa_russia_relation FROM ev"""

ORACLE["major_flag"] = f"""WITH {EVENTS}
SELECT l_orderkey, l_linenumber, CAST(({PLACE}) AS INTEGER) AS is_major_country FROM ev"""

ORACLE["quad_flags"] = f"""WITH {LINES}
SELECT l_orderkey, l_linenumber, quad = 1 AS is_verbal_coop, quad = 2 AS is_material_coop, quad = 3 AS is_verbal_conflict,
  quad = 4 AS is_material_conflict, quad >= 3 AS is_conflict, CAST(NULL AS BOOLEAN) AS from_text FROM lines
UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL, NULL, NULL, quad = 3 FROM lines"""

ORACLE["intensity"] = f"""WITH {LINES}, named AS (
  SELECT l_orderkey, l_linenumber, {NEGATIVE} AS negative_intensity, {POSITIVE} AS positive_intensity, {RISK} AS risk_score FROM lines)
SELECT l_orderkey, l_linenumber, {r('negative_intensity', 'positive_intensity', 'risk_score')} FROM named"""

ORACLE["region_filter"] = f"""WITH {EVENTS}
SELECT l_orderkey, l_linenumber, actor1 AS "Actor1CountryCode", actor2 AS "Actor2CountryCode"
FROM ev WHERE actor1 IN ({REGIONS}) OR actor2 IN ({REGIONS})"""

ORACLE["conflict_filter"] = f"""WITH {LINES}
SELECT l_orderkey, l_linenumber, quad AS "QuadClass", geo AS "ActionGeo_CountryCode" FROM lines WHERE quad >= 3"""

ORACLE["latest_week"] = f"""WITH {LINES}
SELECT l_orderkey, l_linenumber, ship_date AS "SQLDATE", code AS "EventCode", mentions AS "NumMentions"
FROM lines WHERE week = (SELECT MAX(week) FROM lines)"""

# --- weekly aggregates -----------------------------------------------------------------

ORACLE["weekly_core"] = f"""WITH {WEEKLY}
SELECT week, nb_events, total_mentions, total_articles,
  {r('avg_goldstein', 'min_goldstein', 'avg_tone', 'min_tone', 'tension_score', 'cooperation_score')} FROM weekly"""

COUNT_NAMES = [n for n in FEATURE_NAMES[:26] if n.endswith(("_mentions", "_events", "_articles"))]
DOUBLE_NAMES = [n for n in FEATURE_NAMES[:26] if n not in COUNT_NAMES]
ORACLE["weekly_panel"] = f"WITH {WEEKLY} SELECT week, {', '.join(COUNT_NAMES)}, {r(*DOUBLE_NAMES)} FROM weekly"

ORACLE["weekly_conditional"] = f"""WITH {WEEKLY}
SELECT week, verbal_conflict_mentions, material_conflict_mentions, verbal_coop_mentions, material_coop_mentions,
  major_country_events, major_country_conflict_mentions, usa_conflict_mentions, china_conflict_mentions,
  russia_conflict_mentions, middle_east_conflict_mentions, {r('usa_china_tension', 'usa_russia_tension')} FROM weekly"""

ORACLE["weekly_ratios"] = f"""WITH {WEEKLY}
SELECT week, conflict_mentions, coop_mentions, {r('conflict_ratio', 'material_conflict_ratio', 'major_conflict_ratio')} FROM weekly"""

ORACLE["weekly_from_dirty"] = f"""WITH {EVENTS}, {DIRTY_EVENTS}, {CLEAN}
SELECT week, COUNT(code) AS nb_events, CAST(SUM(mentions) AS BIGINT) AS total_mentions,
  ROUND(AVG(goldstein), 6) + 0.0 AS avg_goldstein, ROUND(AVG(tone), 6) + 0.0 AS avg_tone,
  ROUND(SUM({NEGATIVE}), 6) + 0.0 AS tension_score, {sum_if(MAJOR, '1')} AS major_country_events,
  {sum_if(f'{USA} AND quad = 4')} AS usa_conflict_mentions FROM clean GROUP BY week"""

ORACLE["weekly_material3"] = f"""WITH {EVENTS}, {weekly_sql('ev', material=3)}
SELECT week, material_conflict_mentions, usa_conflict_mentions, {r('material_conflict_ratio')} FROM weekly"""

ORACLE["weekly_merged"] = f"""WITH {EVENTS}, {weekly_sql('ev', week='ref_week')}
SELECT week, nb_events, total_mentions, {r('avg_goldstein', 'min_tone', 'avg_tone', 'tension_score', 'conflict_ratio')} FROM weekly"""

ORACLE["weekly_lite"] = f"""WITH {LINES}, {LITE}
SELECT week, nb_events, total_mentions, {r('avg_goldstein', 'avg_tone', 'tension_score')}, mat_conf_mentions, verb_conf_mentions FROM lite"""

ORACLE["drop_day_week"] = f"""WITH {EVENTS}, {day_sql('ev', 4)}
SELECT ingest_date, week, nb_events, {r('avg_tone', 'tension_score')}, mat_conf_mentions FROM days"""

BAD_ROW = "DAY(ship_date) = 13 AND l_linenumber = 1"
GOOD_DAYS = f"good AS (SELECT * FROM ev WHERE ship_date NOT IN (SELECT ship_date FROM ev WHERE {BAD_ROW}))"
ORACLE["skipped_days"] = f"""WITH {EVENTS}
SELECT ship_date AS ingest_date, COUNT(*) FILTER (WHERE {BAD_ROW}) AS bad_rows, COUNT(*) AS n_rows FROM ev
GROUP BY ship_date HAVING bad_rows > 0"""

ORACLE["live_two_phase"] = f"""WITH {EVENTS}, {GOOD_DAYS}, {day_sql('good', 3)}
SELECT week, nb_events, {r('avg_tone', 'tension_score')}, mat_conf_mentions FROM live"""

THIRTY = f"""thirty AS (SELECT * FROM ev WHERE ship_date BETWEEN {LAST_DROP} - 29 AND {LAST_DROP}),
sound AS (SELECT * FROM thirty WHERE ship_date NOT IN (SELECT ship_date FROM thirty WHERE {BAD_ROW}))"""
NINETY = f"ninety AS (SELECT * FROM lines WHERE ship_date BETWEEN {LAST_DROP} - 89 AND {LAST_DROP})"
ORACLE["malformed_lines"] = f"""WITH {LINES}, {NINETY}
SELECT ship_date AS ingest_date, CAST(COUNT(*) AS BIGINT) AS landed, COUNT(*) FILTER (WHERE l_linenumber = 7) AS malformed
FROM ninety GROUP BY ship_date"""
ORACLE["skipped_files"] = f"""WITH {LINES}, {NINETY}
SELECT 'text' AS kind, ship_date AS ingest_date, 'malformed lines' AS reason, COUNT(*) AS rows FROM ninety WHERE l_linenumber = 7 GROUP BY ship_date
UNION ALL SELECT DISTINCT 'parquet', ship_date, 'unreadable', 0 FROM ninety WHERE DAY(ship_date) % 10 = 0"""
ORACLE["loaded_events"] = f"""WITH {EVENTS}
SELECT strftime(ship_date, '%Y%m%d') AS "SQLDATE", code AS "EventCode", COUNT(*) AS rows, COUNT(actor1) AS actors, CAST(SUM(mentions) AS BIGINT) AS mentions,
  {r('SUM(goldstein)').replace('AS SUM(goldstein)', 'AS goldstein')} FROM ev GROUP BY ALL"""
ORACLE["ledger_live"] = f"""WITH {EVENTS}, {THIRTY}, {day_sql('sound', 4)}
SELECT week, nb_events, {r('avg_tone', 'tension_score')}, mat_conf_mentions FROM live"""
ORACLE["ledger_radar"] = f"""WITH {EVENTS}, {THIRTY}, {radar_sql('sound')}
SELECT {RADAR_SHOWN} FROM candidates ORDER BY {radar_order(K.RADAR_COLUMNS)} LIMIT 50"""
ORACLE["ledger_counts"] = f"""WITH {EVENTS}, {THIRTY}, {radar_sql('sound')}
SELECT (SELECT COUNT(DISTINCT ship_date) FROM sound) AS days,
  (SELECT COUNT(DISTINCT ship_date) FROM thirty) - (SELECT COUNT(DISTINCT ship_date) FROM sound) AS skipped_days,
  COUNT(*) AS total_events_filtered, LEAST(COUNT(*), 50) AS events_returned FROM candidates"""
ORACLE["ledger_reads"] = f"""WITH {EVENTS}, {THIRTY}
SELECT CAST(1 AS INTEGER) AS update, ship_date AS ingest_date FROM ev WHERE ship_date BETWEEN {LAST_DROP} - 30 AND {LAST_DROP} - 1
  AND ship_date > {LAST_DROP} - 30 GROUP BY ship_date
UNION ALL SELECT 2, {LAST_DROP}"""

ORACLE["latest_three"] = f"""WITH {EVENTS}, {RECENT}, {day_sql('recent', 4)},
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY week DESC) AS age FROM live),
pivoted AS (SELECT {', '.join(
    f"MAX(CASE WHEN age = {age + 1} THEN {n} END) AS {n}{suffix}"
    for age, suffix in enumerate(['', '_lag1', '_lag2'])
    for n in ['nb_events', 'avg_tone', 'tension_score', 'mat_conf_mentions'][: 4 if age == 0 else 3]
)}, COUNT(*) AS n_weeks FROM ranked WHERE age <= 3)
SELECT nb_events, {r('avg_tone', 'tension_score')}, mat_conf_mentions, nb_events_lag1, {r('avg_tone_lag1', 'tension_score_lag1')},
  nb_events_lag2, {r('avg_tone_lag2', 'tension_score_lag2')} FROM pivoted WHERE n_weeks = 3"""

TOP = """SELECT COALESCE(description, lines.code) AS "EventDescriptionFinal", CAST(SUM(mentions) AS BIGINT) AS mentions
FROM lines LEFT JOIN codes ON lines.code = codes.code {0} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
IN_LATEST = "WHERE week = (SELECT MAX(week) FROM lines)"
TOP_PLACES = f"""SELECT geo AS "ActionGeo_CountryCode", CAST(SUM(mentions) AS BIGINT) AS mentions
FROM lines {IN_LATEST} AND quad >= 3 AND geo IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""

ORACLE["top_events"] = f"WITH {LINES}, {CODES} {TOP.format(IN_LATEST)}"
ORACLE["top_events_all_time"] = f"WITH {LINES}, {CODES} {TOP.format('')}"
ORACLE["top_conflict_geo"] = f"WITH {LINES} {TOP_PLACES}"

# --- market ----------------------------------------------------------------------------

ORACLE["weekly_price"] = f"WITH {market_sql('c_nationkey')} SELECT ticker, week, {r('px')} FROM dense"

ORACLE["returns_with_gaps"] = f"""WITH {market_sql('c_nationkey')}
SELECT ticker, week, {r('weekly_price', 'weekly_return_current', 'vol_4w', 'momentum_4w', 'drawdown_26w', 'future_return_4w')} FROM mk"""

ORACLE["returns_vol"] = f"""WITH {MARKET}
SELECT ticker, week, {r('weekly_return_current', 'vol_4w', 'vol_8w', 'vol_12w')} FROM mk"""

ORACLE["momentum_drawdown"] = f"""WITH {MARKET}
SELECT ticker, week, {r('momentum_4w', 'momentum_12w', 'momentum_26w', 'drawdown_26w')} FROM mk"""

ORACLE["future_return"] = f"WITH {MARKET} SELECT ticker, week, {r('weekly_price', 'future_return_4w')} FROM mk"

ORACLE["vix_zscore"] = f"WITH {VIX} SELECT ticker, week, {r('vix', 'vix_delta_1w', 'vix_zscore_52w')} FROM mv"

ORACLE["direction_target"] = f"""WITH {LINES}, {LITE}, {MARKET},
targets AS (SELECT ticker, week, LEAD(weekly_return_current) OVER (PARTITION BY ticker ORDER BY week) AS target_return FROM mk),
joined AS (SELECT lite.*, ticker, target_return FROM lite JOIN targets ON lite.week = targets.week WHERE target_return IS NOT NULL),
lagged AS (
  SELECT *, LAG(tension_score) {LAG_W} AS tension_score_lag1, LAG(avg_tone) {LAG_W} AS avg_tone_lag1,
    LAG(nb_events) {LAG_W} AS nb_events_lag1, LAG(target_return) {LAG_W} AS weekly_return_current,
    CAST(target_return > 0 AS INTEGER) AS target_direction FROM joined)
SELECT week, ticker, nb_events, total_mentions, mat_conf_mentions, verb_conf_mentions, nb_events_lag1, target_direction,
  {r('avg_goldstein', 'avg_tone', 'tension_score', 'target_return', 'tension_score_lag1', 'avg_tone_lag1', 'weekly_return_current')}
FROM lagged WHERE nb_events_lag1 IS NOT NULL"""

ORACLE["short_momentum"] = f"""WITH {prices_sql()},
aged AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY d DESC) AS age FROM prices),
ends AS (SELECT ticker, MAX(CASE WHEN age = 1 THEN px END) AS last_px, MAX(CASE WHEN age = 5 THEN px END) AS base_px FROM aged GROUP BY ticker)
SELECT ticker, {r('last_px', 'base_px')}, ROUND((last_px - base_px) / base_px, 6) + 0.0 AS current_return FROM ends"""

# --- panel -----------------------------------------------------------------------------

ORACLE["panel_join"] = f"""WITH {PANEL}
SELECT ticker, week, nb_events, {r('tension_score', 'conflict_ratio', 'weekly_return_current', 'momentum_26w', 'vix')} FROM joined"""

ORACLE["crisis_label"] = f"""WITH {PANEL}
SELECT ticker, week, {r('future_return_4w')}, CASE WHEN future_return_4w <= -0.15 THEN 1 ELSE 0 END AS crisis_level FROM joined"""


def lag_columns() -> str:
    whole = {n for n in K.EVENT_FEATURES if n.endswith("_mentions") or n == "nb_events"}
    parts = []
    for n in K.EVENT_FEATURES:
        for suffix in ("_lag1", "_lag2", "_delta1"):
            parts.append(f"{n}{suffix}" if n in whole else r(f"{n}{suffix}"))
    return ", ".join(parts)


ORACLE["lags_deltas"] = f"""WITH {PANEL}, temporal AS (SELECT ticker, week, {LAGS} FROM joined)
SELECT ticker, week, {lag_columns()} FROM temporal"""

ORACLE["zscores"] = f"""WITH {PANEL}, temporal AS (SELECT ticker, week, {SCORES} FROM joined)
SELECT ticker, week, {r(*[f'{n}_zscore_52w' for n in K.EVENT_FEATURES])} FROM temporal"""

ORACLE["interactions"] = f"""WITH {PANEL}, {temporal_sql('joined')}
SELECT ticker, week, CASE WHEN future_return_4w <= -0.15 THEN 1 ELSE 0 END AS crisis_level, nb_events_lag2,
  {r('tension_score_zscore_52w', 'tension_x_vol_4w', 'conflict_x_drawdown', 'vix_x_tension')} FROM finished"""

FILL_NAMES = ["weekly_return_current", "vol_12w", "momentum_26w", "drawdown_26w", "future_return_4w", "vix"]
FILL_NAMES += ["vix_delta_1w", "vix_zscore_52w"]
ORACLE["fill_both"] = f"""WITH {LINES}, {GAPPY_VIX}, weeks AS (SELECT week, COUNT(*) AS nb_events FROM lines GROUP BY week),
{filled_sql('weeks', FILL_NAMES)}
SELECT ticker, week, nb_events, {r(*FILL_NAMES)} FROM filled"""

CHANGES = " UNION ALL ".join(
    f"SELECT ticker, week, '{n}' AS variable, ROUND(({n} - LAG({n}) {LAG_W}) / NULLIF(ABS(LAG({n}) {LAG_W}), 0) * 100, 2) AS change_percent FROM finished"
    for n in K.EVOLUTION_VARIABLES
)
ORACLE["evolution"] = f"""WITH {LIVE}, changes AS ({CHANGES})
SELECT ticker, week, variable, change_percent FROM changes
WHERE week = (SELECT MAX(week) FROM finished) AND change_percent IS NOT NULL"""

ENTRIES = " UNION ALL ".join(
    f"SELECT ticker, 'features' AS part, '{n}' AS entry, ROUND(CAST({n} AS DOUBLE), 6) + 0.0 AS value FROM newest WHERE {n} IS NOT NULL"
    for n in FEATURE_NAMES
)
ORACLE["crisis_documents"] = f"""WITH {LIVE}, {LINES}, {CODES},
newest AS (SELECT * FROM finished WHERE week = (SELECT MAX(week) FROM finished)),
te AS ({TOP.format(IN_LATEST)}), tp AS ({TOP_PLACES}), tickers AS (SELECT DISTINCT ticker FROM newest)
{ENTRIES}
UNION ALL SELECT ticker, 'top_events', "EventDescriptionFinal", CAST(mentions AS DOUBLE) FROM tickers CROSS JOIN te
UNION ALL SELECT ticker, 'top_conflict_countries', "ActionGeo_CountryCode", CAST(mentions AS DOUBLE) FROM tickers CROSS JOIN tp
UNION ALL SELECT ticker, 'evolution', variable, change_percent FROM ({CHANGES})
WHERE week = (SELECT MAX(week) FROM finished) AND change_percent IS NOT NULL"""

# The last 90 drops by ingest day, weeks by the event's own date, prices of two years.
RECENT_PRICES = f"d BETWEEN CAST({LAST_DROP} - INTERVAL 24 MONTH AS DATE) AND {LAST_DROP}"
DROPS_90 = f"""drops AS (
  SELECT * EXCLUDE (week, major), ref_week AS week, CAST(({PLACE}) AS INTEGER) AS major
  FROM ev WHERE ship_date BETWEEN {LAST_DROP} - 89 AND {LAST_DROP})"""
TOP_90 = """SELECT {0} AS entry, SUM(mentions) AS mentions FROM drops d LEFT JOIN codes ON d.code = codes.code
  WHERE {1} AND week = (SELECT MAX(week) FROM drops) GROUP BY 1 HAVING entry IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 10"""
ORACLE["live_refresh"] = f"""WITH {EVENTS}, {CODES}, {DROPS_90}, {weekly_sql('drops')}, {vix_sql(market_sql(kept=RECENT_PRICES))},
{filled_sql('weekly', LIVE_NAMES)}, {temporal_sql('filled', LIVE_NAMES)},
newest AS (SELECT * FROM finished WHERE week = (SELECT MAX(week) FROM finished)), tickers AS (SELECT DISTINCT ticker FROM newest),
te AS ({TOP_90.format('COALESCE(description, d.code)', 'TRUE')}), tp AS ({TOP_90.format('geo', 'quad >= 3')})
{ENTRIES}
UNION ALL SELECT ticker, 'top_events', entry, CAST(mentions AS DOUBLE) FROM tickers CROSS JOIN te
UNION ALL SELECT ticker, 'top_conflict_countries', entry, CAST(mentions AS DOUBLE) FROM tickers CROSS JOIN tp
UNION ALL SELECT ticker, 'evolution', variable, change_percent FROM ({CHANGES})
WHERE week = (SELECT MAX(week) FROM finished) AND change_percent IS NOT NULL"""

# --- radar -----------------------------------------------------------------------------

ORACLE["radar_top50"] = f"""WITH {EVENTS}, {GOOD_DAYS}, {radar_sql('good')}
SELECT {RADAR_SHOWN} FROM candidates ORDER BY {radar_order(K.RADAR_COLUMNS)} LIMIT 50"""

ORACLE["daily_top3"] = f"""WITH {EVENTS}, {radar_sql('ev')}
SELECT {RADAR_SHOWN} FROM candidates ORDER BY {radar_order(K.RADAR_COLUMNS)} LIMIT 3"""

PERIOD = "strftime({0}, '%Y%m%d') || ' to ' || strftime({1}, '%Y%m%d')"
ORACLE["radar_counts"] = f"""WITH {EVENTS}, {radar_sql('ev')}
SELECT {PERIOD.format('MIN(ship_date)', 'MAX(ship_date)')} AS period, '{','.join(K.RADAR_REGIONS)}' AS regions_tracked,
  CAST(COUNT(*) AS VARCHAR) AS total_events_filtered, CAST(LEAST(COUNT(*), 50) AS VARCHAR) AS events_returned FROM candidates"""

TEXT_COLUMNS = [n for n in K.RADAR_COLUMNS if n != "Actor1Name"]


def as_text(names: list[str]) -> str:
    return ", ".join(f"""COALESCE(CAST("{n}" AS VARCHAR), '') AS "{n}" """ for n in names)


ORACLE["radar_text"] = f"""WITH {EVENTS}, {RECENT}, {radar_sql('recent')},
top AS (SELECT * FROM candidates ORDER BY {radar_order(TEXT_COLUMNS)} LIMIT 50) SELECT {as_text(TEXT_COLUMNS)} FROM top"""

ORACLE["radar_documents"] = f"""WITH {EVENTS}, {RECENT}, {radar_sql('recent')},
top AS (SELECT * FROM candidates ORDER BY {radar_order(K.RADAR_COLUMNS)} LIMIT 50),
header AS (SELECT CAST(COUNT(*) AS VARCHAR) AS total_events_filtered, CAST(LEAST(COUNT(*), 50) AS VARCHAR) AS events_returned FROM candidates)
SELECT {PERIOD.format(f'{LAST_DROP} - 6', LAST_DROP)} AS period, '{','.join(K.RADAR_REGIONS)}' AS regions_tracked, header.*,
  {as_text(K.RADAR_COLUMNS)} FROM top CROSS JOIN header"""

ORACLE["published_refresh"] = f"""WITH {EVENTS}, {CODES}, {DROPS_90}, {weekly_sql('drops')}, {vix_sql(market_sql(kept=RECENT_PRICES))},
{filled_sql('weekly', LIVE_NAMES)}, {temporal_sql('filled', LIVE_NAMES)},
newest AS (SELECT * FROM finished WHERE week = (SELECT MAX(week) FROM finished)),
{RECENT}, {day_sql('recent', 4)}, {radar_sql('recent')}
SELECT 'crisis' AS document, ticker AS key, CAST(nb_events AS BIGINT) AS events FROM newest
UNION ALL SELECT 'direction', 'nb_events', nb_events FROM live WHERE week = (SELECT MAX(week) FROM live) AND (SELECT COUNT(*) FROM live) >= 3
UNION ALL SELECT 'radar', {PERIOD.format(f'{LAST_DROP} - 6', LAST_DROP)}, COUNT(*) FROM candidates"""

ORACLE["newest_weeks"] = f"""WITH {WEEKLY}
SELECT week, nb_events, {r('tension_score')} FROM weekly ORDER BY week DESC LIMIT 10"""

# --- data quality ----------------------------------------------------------------------

PROFILED = ["Actor1CountryName", "Actor2CountryName", "ActionGeo_CountryName", "EventDescription", "EventDescriptionFinal"]
ORACLE["null_profile"] = f"WITH {DECODED} " + " UNION ALL ".join(
    f"""SELECT COUNT(*) AS n_rows, '{n}' AS column_name, COUNT(*) - COUNT("{n}") AS n_null,
  ROUND(CAST(COUNT("{n}") AS DOUBLE) / COUNT(*), 6) + 0.0 AS match_rate FROM decoded"""
    for n in PROFILED
)

ORACLE["unmapped_codes"] = f"""WITH {EVENTS}, {COUNTRIES}
SELECT DISTINCT actor1 AS code FROM ev WHERE NOT EXISTS (SELECT 1 FROM countries c WHERE c.code = ev.actor1)"""

ORACLE["root_consistency"] = f"""WITH {DECODED}
SELECT "EventCode", "EventRootCode", "EventRootFromEventCode", COUNT(*) AS n FROM decoded
WHERE "EventRootFromEventCode" <> "EventRootCode" GROUP BY ALL"""

MISMATCH_VIEW = '"EventCode", "EventRootCode", "EventRootFromEventCode", "EventDescription", "EventRootDescription"'
ORACLE["root_examples"] = f"""WITH {DECODED}
SELECT DISTINCT {MISMATCH_VIEW} FROM decoded WHERE "EventRootFromEventCode" <> "EventRootCode"
ORDER BY {first_order(MISMATCH_VIEW)} LIMIT 20"""

IS_FALLBACK = '"EventDescription" IS NULL AND "EventDescriptionFinal" IS NOT NULL'
ORACLE["fallback_rows"] = f"""WITH {DECODED}
SELECT "EventRootCode", "EventDescriptionFinal", COUNT(*) AS n FROM decoded WHERE {IS_FALLBACK} GROUP BY ALL"""

ORACLE["fallback_examples"] = f"""WITH {DECODED}
SELECT DISTINCT {CODE_VIEW} FROM decoded WHERE {IS_FALLBACK} ORDER BY {first_order(CODE_VIEW)} LIMIT 20"""

ORACLE["code_sample"] = f"WITH {DECODED} SELECT DISTINCT {CODE_VIEW} FROM decoded ORDER BY {first_order(CODE_VIEW)} LIMIT 20"

ORACLE["distinct_codes"] = f"WITH {DECODED} SELECT DISTINCT {CODE_VIEW} FROM decoded"

# --- labels, weights and metrics -------------------------------------------------------

ORACLE["temporal_split"] = f"WITH {GUESSED} SELECT ticker, week, split FROM guessed"

ORACLE["class_distribution"] = f"WITH {GUESSED} SELECT ticker, split, label, COUNT(*) AS n FROM guessed GROUP BY ALL"

ORACLE["balanced_weights"] = f"""WITH {GUESSED},
sizes AS (SELECT ticker, label, COUNT(*) AS n FROM guessed WHERE split = 'train' GROUP BY ALL)
SELECT ticker, label, n, ROUND(CAST(MAX(n) OVER (PARTITION BY ticker) AS DOUBLE) / n, 6) + 0.0 AS weight FROM sizes"""

ORACLE["confusion"] = f"""WITH {COUNTS}
SELECT ticker, 0 AS label, a AS predicted_0, b AS predicted_1 FROM counts
UNION ALL SELECT ticker, 1, c, d FROM counts"""

ORACLE["metrics"] = f"""WITH {COUNTS}
SELECT ticker, ROUND({share('a + d', 'a + b + c + d')}, 6) + 0.0 AS accuracy,
  ROUND(({share('a', 'a + b')} + {share('d', 'c + d')}) / 2, 6) + 0.0 AS balanced_accuracy,
  ROUND(({share('2 * a', '2 * a + b + c')} + {share('2 * d', '2 * d + b + c')}) / 2, 6) + 0.0 AS f1_macro FROM counts"""

ORACLE["per_class_report"] = f"""WITH {COUNTS}
SELECT ticker, 'Normal' AS class, ROUND({share('a', 'a + c')}, 6) + 0.0 AS precision, ROUND({share('a', 'a + b')}, 6) + 0.0 AS recall,
  ROUND({share('2 * a', '2 * a + b + c')}, 6) + 0.0 AS f1, a + b AS support FROM counts
UNION ALL SELECT ticker, 'Stress', ROUND({share('d', 'b + d')}, 6) + 0.0, ROUND({share('d', 'c + d')}, 6) + 0.0,
  ROUND({share('2 * d', '2 * d + b + c')}, 6) + 0.0, c + d FROM counts"""

ORACLE["aligned_features"] = f"""WITH {WEEKLY}
SELECT week, {r('tension_score')}, CAST(nb_events AS DOUBLE) AS nb_events, CAST(0.0 AS DOUBLE) AS not_in_the_panel, {r('avg_tone')} FROM weekly"""

# --- models: keys, rows and what holds for every model ---------------------------------

HOLD_OUT = "WHERE week >= DATE '2000-06-01'"
STRESS = "CASE WHEN future_return_4w <= -0.15 THEN 1 ELSE 0 END"
SCORE_TRUTHS = "TRUE AS is_probability, TRUE AS follows_threshold, TRUE AS is_confidence"
ORACLE["gbt_scores"] = f"""WITH {PANEL}, {temporal_sql('joined')}
SELECT ticker, week, {STRESS} AS crisis_level, {SCORE_TRUTHS} FROM finished {HOLD_OUT}"""

ORACLE["holdout_metrics"] = f"""WITH {PANEL}, {temporal_sql('joined')}
SELECT ticker, COUNT(*) AS n_weeks, CAST(SUM({STRESS}) AS BIGINT) AS n_stress, ROUND(SUM(future_return_4w), 6) AS sum_future_return,
  TRUE AS accuracy_fits, TRUE AS balanced_fits, TRUE AS f1_fits FROM finished {HOLD_OUT} GROUP BY ticker"""

DIRECTION = ORACLE["direction_target"]
ORACLE["forest_scores"] = f"""SELECT ticker, week, target_direction, {SCORE_TRUTHS} FROM ({DIRECTION}) {HOLD_OUT}"""

ORACLE["feature_importance"] = f"""WITH {PANEL}, {temporal_sql('joined')}
SELECT DISTINCT ticker, CAST(UNNEST(range(1, 26)) AS INTEGER) AS rank, TRUE AS in_order, TRUE AS sums_to_one FROM finished"""

ORACLE["scenario_scores"] = f"""WITH {LINES}, {LITE}, tickers AS (SELECT DISTINCT CAST(c_mktsegment AS VARCHAR) AS actif FROM customer)
SELECT actif, ROUND(avg_tone, 6) + 0.0 AS simulated_tone, ROUND(tension_score, 6) + 0.0 AS simulated_tension,
  mat_conf_mentions AS simulated_material_conflicts, TRUE AS is_confidence, TRUE AS is_named, TRUE AS is_told FROM lite CROSS JOIN tickers"""

ORACLE["direction_served"] = f"""SELECT ticker AS actif, current_return, TRUE AS is_named, TRUE AS is_confidence, TRUE AS is_told, TRUE AS is_dated
FROM ({ORACLE['short_momentum']})"""

CHECKS = ", ".join(f"('{n}')" for n in ("probabilities", "confidence", "level", "dated"))
REPORTED = " UNION ALL ".join(
    f"SELECT ticker, week, '{n}' AS entry, ROUND(CAST({n} AS DOUBLE), 6) + 0.0 AS value FROM newest" for n in K.REPORT_VARIABLES
)
ORACLE["crisis_reports"] = f"""WITH {LIVE}, {LINES}, {CODES},
newest AS (SELECT * FROM finished WHERE week = (SELECT MAX(week) FROM finished)), tickers AS (SELECT DISTINCT ticker, week FROM newest),
te AS ({TOP.format(IN_LATEST)}), tp AS ({TOP_PLACES}), rows AS (
  SELECT ticker, week, 'variables' AS part, entry, value FROM ({REPORTED}) WHERE value IS NOT NULL
  UNION ALL SELECT ticker, week, 'top_events', "EventDescriptionFinal", CAST(mentions AS DOUBLE) FROM tickers CROSS JOIN te
  UNION ALL SELECT ticker, week, 'top_conflict_countries', "ActionGeo_CountryCode", CAST(mentions AS DOUBLE) FROM tickers CROSS JOIN tp
  UNION ALL SELECT ticker, week, 'evolution', variable, change_percent FROM ({CHANGES})
    WHERE week = (SELECT MAX(week) FROM finished) AND change_percent IS NOT NULL
  UNION ALL SELECT ticker, week, 'check', name, 1.0 FROM tickers CROSS JOIN (VALUES {CHECKS}) c(name))
SELECT ticker AS actif, CAST(week AS VARCHAR) AS week, part, entry, value FROM rows"""

SETTINGS = ", ".join(f"({n}, {x.iterations}, {x.depth}, {x.rate!r}::DOUBLE, {x.min_rows})" for n, x in enumerate(draw(42)))
ORACLE["parameter_search"] = f"""SELECT ticker, trial, iterations, depth, {r('rate')}, min_rows, TRUE AS is_share, TRUE AS in_order, TRUE AS is_fitted
FROM (SELECT DISTINCT CAST(c_mktsegment AS VARCHAR) AS ticker FROM customer),
  (VALUES {SETTINGS}) AS settings(trial, iterations, depth, rate, min_rows)"""

# --- streaming: the batch result over the same rows ------------------------------------

ACTIVITY = f"""ev AS (
  SELECT CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS DATE) AS week, 'user ' || CAST(user_id AS VARCHAR) AS actor1_name,
    {code_case('(user_id % 25)')} AS actor1, {code_case('((user_id + 1) % 25)')} AS actor2,
    {GEO_CASE.replace('l_partkey', 'user_id')} AS geo, event_type AS code, CAST(event_id % 21 - 10 AS DOUBLE) AS goldstein,
    CAST(event_id % 4 + 1 AS INTEGER) AS quad, CAST(event_id % 50 + 1 AS BIGINT) AS mentions,
    CAST(event_id % 50 + 2 AS BIGINT) AS articles, ROUND(value, 2) AS tone, CAST(user_id % 10 = 0 AS INTEGER) AS major,
    'https://example.test/' || CAST(event_id AS VARCHAR) AS url
  FROM events)"""

ORACLE["stream_weekly"] = f"""WITH {ACTIVITY}, {weekly_sql('ev')}
SELECT week, nb_events, total_mentions, {r('avg_goldstein', 'min_tone', 'avg_tone', 'tension_score', 'conflict_ratio')},
  usa_conflict_mentions FROM weekly"""

ORACLE["stream_closed_weeks"] = f"""WITH {ACTIVITY}
SELECT week, COUNT(*) AS nb_events, CAST(SUM(mentions) AS BIGINT) AS total_mentions FROM ev
WHERE week + 7 <= (SELECT MAX(day) FROM ev) - 3 GROUP BY week"""

ORACLE["stream_late_dropped"] = f"""WITH {ACTIVITY}, span AS (SELECT MIN(day) AS first, MAX(day) AS last FROM ev),
quarters AS (SELECT *, CAST(FLOOR((day - first) * 4 / (last - first + 1)) AS INTEGER) AS quarter FROM ev, span)
SELECT week, CAST(COUNT(*) AS BIGINT) AS late_rows FROM quarters
WHERE quarter = 0 AND week + 7 <= (SELECT MAX(day) FROM quarters WHERE quarter IN (1, 2)) - 3 GROUP BY week"""

NEWEST_ACTIVITY = "WHERE week = (SELECT MAX(week) FROM ev)"
ORACLE["stream_top_events"] = f"""WITH {ACTIVITY}
SELECT code AS "EventDescriptionFinal", CAST(SUM(mentions) AS BIGINT) AS mentions FROM ev {NEWEST_ACTIVITY} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""

ORACLE["stream_radar"] = f"""WITH {ACTIVITY}, dated AS (
  SELECT *, day AS ref_date, day AS ship_date FROM ev {NEWEST_ACTIVITY}), {radar_sql('dated')}
SELECT {RADAR_SHOWN} FROM candidates ORDER BY {radar_order(K.RADAR_COLUMNS)} LIMIT 50"""
