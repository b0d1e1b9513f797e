"""Match, fixture, player and page tables derived from the generated base tables.

The texts are common SQL; with double quotes for back quotes they run on other
engines as they are, which is how results are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "pages"]

VIEWS: dict[str, str] = {}

VIEWS["fx_matches"] = r"""
WITH ln AS (
  SELECT l_orderkey, MIN(l_suppkey) AS suppkey,
    CAST(SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS INT) AS hg,
    CAST(SUM(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS INT) AS ag,
    CAST(SUM(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 1 ELSE 0 END) AS INT) AS hthg,
    CAST(SUM(CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN 1 ELSE 0 END) AS INT) AS htag,
    CAST(SUM(l_linenumber) AS INT) AS sh,
    CAST(SUM(CASE WHEN l_discount > 0.04 THEN l_linenumber ELSE 0 END) AS INT) AS sht,
    CAST(SUM(CASE WHEN l_tax > 0.03 THEN l_linenumber ELSE 0 END) AS INT) AS sa,
    CAST(SUM(CASE WHEN l_tax > 0.05 THEN l_linenumber ELSE 0 END) AS INT) AS sat,
    CAST(MAX(l_quantity) AS INT) AS qmax, CAST(MIN(l_quantity) AS INT) AS qmin,
    CAST(SUM(l_quantity) AS INT) AS q
  FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey AS MatchId, o.o_orderstatus AS src,
  CONCAT(CAST(YEAR(o.o_orderdate) AS STRING), '-', LPAD(CAST((YEAR(o.o_orderdate)+1) % 100 AS STRING), 2, '0')) AS Season,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'TBC' ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS Date,
  hn.n_name AS HomeTeam, an.n_name AS AwayTeam,
  hg AS FTHG, ag AS FTAG, CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS FTR,
  hthg AS HalfTimeHomeTeamGoals, htag AS HalfTimeAwayTeamGoals,
  sh AS HS, sa AS `AS`, sht AS HST, sat AS AST, qmax % 13 AS HC, qmin % 11 AS AC,
  q % 23 AS HomeTeamFouls, q % 19 AS AwayTeamFouls,
  CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE q % 5 END AS HomeTeamYellowCards, sh % 4 AS AwayTeamYellowCards,
  CASE WHEN q % 17 = 0 THEN 1 ELSE 0 END AS HomeTeamRedCards, CASE WHEN q % 13 = 0 THEN 1 ELSE 0 END AS AwayTeamRedCards,
  NULLIF(o.o_orderpriority, '4-NOT SPECIFIED') AS Referee,
  1.5E0 + CAST(o.o_orderkey % 100 AS DOUBLE) / 100 AS OddsOver,
  1.5E0 + CAST(o.o_orderkey % 70 AS DOUBLE) / 100 AS OddsUnder
FROM orders o JOIN ln ON ln.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation hn ON hn.n_nationkey = c.c_nationkey
JOIN supplier s ON s.s_suppkey = ln.suppkey JOIN nation an ON an.n_nationkey = s.s_nationkey
WHERE hn.n_nationkey <> an.n_nationkey
"""

VIEWS["fx_league"] = r"""
SELECT MatchId, Season, Date, HomeTeam, AwayTeam, FTHG AS FullTimeHomeTeamGoals, FTAG AS FullTimeAwayTeamGoals,
  FTR AS FullTimeResult, HalfTimeHomeTeamGoals, HalfTimeAwayTeamGoals, HS AS HomeTeamShots, `AS` AS AwayTeamShots,
  HST AS HomeTeamShotsOnTarget, AST AS AwayTeamShotsOnTarget, HC AS HomeTeamCorners, AC AS AwayTeamCorners,
  HomeTeamFouls, AwayTeamFouls, HomeTeamYellowCards, AwayTeamYellowCards, HomeTeamRedCards, AwayTeamRedCards,
  Referee, OddsOver, OddsUnder
FROM fx_matches WHERE src = 'F'
"""

VIEWS["fx_results"] = r"""
SELECT MatchId, Season, Date, HomeTeam, AwayTeam, FTHG, FTAG, FTR, HalfTimeHomeTeamGoals, HalfTimeAwayTeamGoals,
  HS, `AS`, HST, AST, HC, AC, HomeTeamFouls, AwayTeamFouls, HomeTeamYellowCards, AwayTeamYellowCards,
  HomeTeamRedCards, AwayTeamRedCards, Referee, OddsOver, OddsUnder
FROM fx_matches WHERE src = 'P'
"""

VIEWS["fx_remaining"] = r"""
SELECT MatchId, Season, Date, HomeTeam, AwayTeam, OddsOver, OddsUnder
FROM fx_matches WHERE src = 'O' AND Season = (SELECT MAX(Season) FROM fx_matches WHERE src <> 'O' AND Date <> 'TBC') AND Date <> 'TBC'
"""

VIEWS["fx_remaining_wide"] = r"""
WITH s AS (
  SELECT Season, MatchId, Date, HomeTeam AS Team, AwayTeam AS Opponent FROM fx_remaining
  UNION ALL SELECT Season, MatchId, Date, AwayTeam, HomeTeam FROM fx_remaining),
r AS (SELECT Season, Team, Opponent, ROW_NUMBER() OVER (PARTITION BY Season, Team ORDER BY Date, MatchId) AS k FROM s)
SELECT Season, Team, MAX(CASE WHEN k=1 THEN Opponent END) AS Opponent1, MAX(CASE WHEN k=2 THEN Opponent END) AS Opponent2,
  MAX(CASE WHEN k=3 THEN Opponent END) AS Opponent3, MAX(CASE WHEN k=4 THEN Opponent END) AS Opponent4
FROM r WHERE k <= 4 GROUP BY Season, Team
"""

VIEWS["fx_past"] = r"""
WITH s AS (
  SELECT Season, HomeTeam AS Team, CASE FTR WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS p FROM fx_matches
  UNION ALL SELECT Season, AwayTeam, CASE FTR WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM fx_matches)
SELECT Season, Team AS SquadName, CAST(SUM(p) AS INT) AS Pts FROM s WHERE Season <> (SELECT MAX(Season) FROM fx_matches WHERE src <> 'O' AND Date <> 'TBC') GROUP BY Season, Team
"""

VIEWS["fx_players"] = r"""
WITH a AS (
  SELECT l_partkey, CAST(SUM(l_quantity) AS INT) * 2 AS m,
    CAST(SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS INT) AS Gls,
    CAST(SUM(CASE WHEN l_returnflag='A' AND l_linenumber < 4 THEN 1 ELSE 0 END) AS INT) AS Ast,
    CAST(SUM(CASE WHEN l_returnflag='N' THEN l_linenumber ELSE 0 END) AS INT) AS Sh,
    ROUND(SUM(l_discount) * 6, 1) AS xG, ROUND(SUM(l_tax) * 6, 1) AS xA,
    CAST(SUM(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS INT) AS KP,
    CAST(SUM(l_linenumber) AS INT) AS Touches,
    CAST(SUM(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS INT) AS CrdY,
    CAST(SUM(CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END) AS INT) AS CrdR,
    CAST(SUM(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS INT) AS Fls,
    CAST(COUNT(*) AS INT) AS Matches
  FROM lineitem GROUP BY l_partkey)
SELECT CONCAT('P', CAST(p_partkey AS STRING)) AS Player, n_name AS Squad, p_brand AS Nation,
  p_size AS Age, 2000 - p_size AS Born,
  CASE p_type WHEN 'ECONOMY' THEN 'FW' WHEN 'PROMO' THEN 'MF,FW' WHEN 'SMALL' THEN 'MF' WHEN 'STANDARD' THEN 'GK' ELSE 'DF' END AS Pos,
  CASE WHEN p_partkey % 53 = 0 THEN 0E0 ELSE ROUND(CAST(m AS DOUBLE) / 90, 1) END AS `90s`,
  CASE WHEN m >= 1000 THEN CONCAT(CAST(CAST((m - m % 1000) / 1000 AS INT) AS STRING), ',', LPAD(CAST(m % 1000 AS STRING), 3, '0'))
       ELSE CAST(m AS STRING) END AS Min,
  Gls, Ast, Matches, Sh, xG, xA, KP, Touches, m % 37 AS PrgC, m % 41 AS PrgP, m % 43 AS PrgR,
  m % 17 AS GCA, m % 31 AS SCA, CrdY, CrdR, Fls,
  m % 29 AS GA, CAST(m % 31 AS DOUBLE) AS PSxG, CAST(m % 7 AS DOUBLE) / 10 AS `PSxG/SoT`, CAST(m % 13 AS DOUBLE) AS `Stp%`,
  m % 23 AS `#OPA`, CAST(m % 19 AS DOUBLE) / 10 AS `#OPA/90`, CAST(m % 11 AS DOUBLE) + 10 AS AvgDist,
  CAST(m % 47 AS DOUBLE) AS `Launch%`, CAST(m % 53 AS DOUBLE) AS `Cmp%`
FROM part JOIN a ON l_partkey = p_partkey JOIN nation ON n_nationkey = p_size % 25
"""

VIEWS["fx_html"] = r"""
SELECT page_id, CONCAT(html, '<!--<div><table id="stats ', CAST(page_id AS STRING),
  '" class="a b" data-rule="x > 0"><thead><tr><th></th><th>Totals</th></tr><tr><th>Player</th><th>Squad</th><th>Gls</th></tr></thead><tbody>',
  CASE WHEN page_id % 2 = 1
    THEN CONCAT('<tr><th><a href="/p/', CAST(page_id AS STRING), '">N', CAST(page_id % 97 AS STRING), '</a><td title="a > b"> A &amp; B <td>', CAST(page_id % 5 AS STRING))
    ELSE CONCAT('<tr><th><a href="/p/', CAST(page_id AS STRING), '">N', CAST(page_id % 97 AS STRING), '</a></th><td> A &amp; B </td><td>', CAST(page_id % 5 AS STRING), '</td></tr>') END,
  '<tr class="thead"><th>Player</th><th>Squad</th><th>Gls</th></tr>',
  '<tr><th>short</th><td>', url,
  CASE WHEN page_id % 7 = 0 THEN '<table><thead><tr><th></th></tr><tr><th>Inner</th></tr></thead><tbody><tr><td>in</td></tr></tbody></table>' ELSE '' END,
  '</td></tr></tbody></table>',
  CASE WHEN page_id % 3 = 0 THEN CONCAT('<table class="squads x"><thead><tr><th></th></tr><tr><th>Squad</th><th>Gls</th></tr></thead><tbody><tr><td>T', CAST(page_id % 7 AS STRING), '</td><td>3</td></tr></tbody></table>') ELSE '' END,
  '</div>-->', CASE WHEN page_id % 5 = 0 THEN '<!--<table><thead><tr><th></th></tr><tr><th>Other</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody>-->' ELSE '' END) AS html
FROM pages
"""

# The cells that fx_html holds, stated beside it: odd pages leave cells and rows open, every
# seventh nests a table in a cell (its own table, numbered after the outer one), every fifth
# leaves its last table open; '>' stands in attribute values.
VIEWS["fx_html_cells"] = r"""
WITH hp AS (SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS n7, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS n3 FROM pages),
hc AS (
  SELECT page_id, 0 AS table_no, 0 AS row_no, 0 AS col_no, '' AS value, 1 AS is_header FROM hp
  UNION ALL SELECT page_id, 0, 0, 1, 'Totals', 1 FROM hp
  UNION ALL SELECT page_id, 0, 1, 0, 'Player', 1 FROM hp
  UNION ALL SELECT page_id, 0, 1, 1, 'Squad', 1 FROM hp
  UNION ALL SELECT page_id, 0, 1, 2, 'Gls', 1 FROM hp
  UNION ALL SELECT page_id, 0, 2, 0, CONCAT('N', CAST(page_id % 97 AS STRING)), 1 FROM hp
  UNION ALL SELECT page_id, 0, 2, 1, 'A & B', 0 FROM hp
  UNION ALL SELECT page_id, 0, 2, 2, CAST(page_id % 5 AS STRING), 0 FROM hp
  UNION ALL SELECT page_id, 0, 3, 0, 'Player', 1 FROM hp
  UNION ALL SELECT page_id, 0, 3, 1, 'Squad', 1 FROM hp
  UNION ALL SELECT page_id, 0, 3, 2, 'Gls', 1 FROM hp
  UNION ALL SELECT page_id, 0, 4, 0, 'short', 1 FROM hp
  UNION ALL SELECT page_id, 0, 4, 1, TRIM(REPLACE(url, '&amp;', '&')), 0 FROM hp
  UNION ALL SELECT page_id, 1, 0, 0, '', 1 FROM hp WHERE n7 = 1
  UNION ALL SELECT page_id, 1, 1, 0, 'Inner', 1 FROM hp WHERE n7 = 1
  UNION ALL SELECT page_id, 1, 2, 0, 'in', 0 FROM hp WHERE n7 = 1
  UNION ALL SELECT page_id, 1 + n7, 0, 0, '', 1 FROM hp WHERE n3 = 1
  UNION ALL SELECT page_id, 1 + n7, 1, 0, 'Squad', 1 FROM hp WHERE n3 = 1
  UNION ALL SELECT page_id, 1 + n7, 1, 1, 'Gls', 1 FROM hp WHERE n3 = 1
  UNION ALL SELECT page_id, 1 + n7, 2, 0, CONCAT('T', CAST(page_id % 7 AS STRING)), 0 FROM hp WHERE n3 = 1
  UNION ALL SELECT page_id, 1 + n7, 2, 1, '3', 0 FROM hp WHERE n3 = 1
  UNION ALL SELECT page_id, 1 + n7 + n3, 0, 0, '', 1 FROM hp WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 1 + n7 + n3, 1, 0, 'Other', 1 FROM hp WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 1 + n7 + n3, 2, 0, '1', 0 FROM hp WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, 1 + n7 + n3, 2, 1, '2', 0 FROM hp WHERE page_id % 5 = 0)
SELECT page_id, table_no, row_no, col_no, value, is_header, (table_no = 0 AND row_no = 3) AS repeated FROM hc
"""

# The tables of fx_html with their slugs: id, else classes, else table<number from 1>.
VIEWS["fx_html_tables"] = r"""
WITH hq AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS n7, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS n3 FROM pages)
SELECT page_id, 0 AS table_no, SUBSTR(CONCAT('stats_', CAST(page_id AS STRING)), 1, 30) AS slug FROM hq
UNION ALL SELECT page_id, 1, 'table2' FROM hq WHERE n7 = 1
UNION ALL SELECT page_id, 1 + n7, 'squads_x' FROM hq WHERE n3 = 1
UNION ALL SELECT page_id, 1 + n7 + n3, CONCAT('table', CAST(2 + n7 + n3 AS STRING)) FROM hq WHERE page_id % 5 = 0
"""

# A fixed boosted forest as a node table (weights and leaves exact in binary, so sums do not depend
# on their order): 3 parts (one-against-rest), 20 trees each, complete
# trees of depth 3 (nodes 0-6 split, 7-14 are leaves, children 2i+1 and 2i+2). ``slot`` is
# taken modulo the number of features of the model that uses it.
VIEWS["fx_forest"] = r"""
SELECT r.r_regionkey AS part, a.n_nationkey AS tree, CAST(CASE WHEN a.n_nationkey = 0 THEN 1 ELSE 0.125 END AS DOUBLE) AS weight,
  b.n_nationkey AS node,
  CASE WHEN b.n_nationkey < 7 THEN (a.n_nationkey * 3 + b.n_nationkey * 5 + r.r_regionkey) % 17 ELSE -1 END AS slot,
  CAST(CASE WHEN b.n_nationkey < 7 THEN ((a.n_nationkey * 7 + b.n_nationkey * 5 + r.r_regionkey) % 11) * 0.5 ELSE 0 END AS DOUBLE) AS split,
  CASE WHEN b.n_nationkey < 7 THEN 2 * b.n_nationkey + 1 ELSE -1 END AS left_node,
  CASE WHEN b.n_nationkey < 7 THEN 2 * b.n_nationkey + 2 ELSE -1 END AS right_node,
  CAST((((a.n_nationkey * 13 + b.n_nationkey * 7 + r.r_regionkey * 5) % 9) - 4) * 0.25 AS DOUBLE) AS leaf,
  CAST(CASE WHEN b.n_nationkey < 7 THEN ((a.n_nationkey + b.n_nationkey * 3) % 5 + 1) * 0.1 ELSE -1 END AS DOUBLE) AS gain,
  CAST(60 - b.n_nationkey * 3 AS DOUBLE) AS cnt
FROM region r JOIN nation a ON a.n_nationkey < 20 AND r.r_regionkey < 3 JOIN nation b ON b.n_nationkey < 15
"""

VIEWS["fx_files"] = r"""
SELECT o_orderkey AS row_id, o_orderpriority AS stat,
  CONCAT('playerData/', o_orderpriority, '/', CASE WHEN o_orderkey % 3 = 0 THEN 'Squad_' ELSE 'Player_' END,
    REPLACE(o_orderpriority, ' ', '_'), CASE WHEN o_orderkey % 11 = 0 THEN '_undated' ELSE CONCAT('_', CAST(CAST(o_orderdate AS DATE) AS STRING)) END,
    '.csv') AS file_name
FROM orders
"""

# Columns of the seven player tables besides the keys.
PLAYER_TABLES = {
    "standard": ["Min", "Gls", "Ast", "Matches"],
    "shooting": ["Sh", "xG"],
    "passing": ["xA", "KP", "PrgP"],
    "possession": ["Touches", "PrgC", "PrgR"],
    "gca": ["GCA", "SCA"],
    "misc": ["CrdY", "CrdR", "Fls", "Matches"],
    "gk": ["GA", "PSxG", "PSxG/SoT", "Stp%", "#OPA", "#OPA/90", "AvgDist", "Launch%", "Cmp%"],
}
PLAYER_KEYS = ["Player", "Squad", "Nation", "Age", "Born", "Pos", "90s"]


# Joined once and stored, as the other match views are cut from it.
STORED = {"fx_matches"}


def load(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, DataFrame]:
    """The derived tables over the parquet files of ``sf_dir``; stored ones go to ``folder``."""
    for table in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    tables = {}
    for view, text in VIEWS.items():
        df = spark.sql(text)
        if view in STORED:
            df.write.mode("overwrite").parquet(f"{folder}/{view}")
            df = spark.read.parquet(f"{folder}/{view}")
        df.createOrReplaceTempView(view)
        tables[view] = df
    return tables


def player_tables(players: DataFrame) -> dict[str, DataFrame]:
    """The seven stat tables cut from the wide player table."""
    cut = {}
    for name, stats in PLAYER_TABLES.items():
        rows = players
        if name == "shooting":
            rows = rows.filter("Age % 29 <> 0")
        if name == "gk":
            rows = rows.filter("Pos = 'GK'")
        cut[name] = rows.select(*[f"`{c}`" for c in [*PLAYER_KEYS, *stats]])
    return cut
