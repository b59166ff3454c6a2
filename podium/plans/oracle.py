"""DuckDB oracle SQL for every registered query that SQL can express.

The model views of ``podium.plans.model`` are repeated here as CTEs over the
pre-registered tables. The questions are worked out from their definitions in
DuckDB's own idiom (``FILTER``, ``QUALIFY``, ``arg_min``, one window pass), apart from
how the DataFrame plans do it, so the check compares two derivations.
"""

from __future__ import annotations

from podium.plans import analytics as A

# -- model views -------------------------------------------------------------------------

RACE = """Race AS (SELECT o_orderkey AS RaceId, CAST(year(o_orderdate) AS INTEGER) AS RaceYear,
                   CAST(o_orderdate AS DATE) AS RaceDate, o_custkey AS CustomerId FROM orders)"""

RESULT = """Result AS (SELECT l_orderkey AS RaceId, l_suppkey AS DriverId, l_partkey AS PartId,
                       l_linenumber AS Position, CAST(l_linenumber AS VARCHAR) AS PositionText,
                       l_linenumber AS FastestLap, l_quantity AS Laps,
                       l_extendedprice AS FastestLapTime, l_partkey AS ResultNumber,
                       l_discount AS Points, l_returnflag AS ResultStatus FROM lineitem)"""

SUPPLIER_DRIVER = """Driver AS (SELECT s_suppkey AS DriverId, s_name AS Firstname,
                               CAST(NULL AS VARCHAR) AS Lastname FROM supplier)"""

PART_DRIVER = """Driver AS (SELECT p_partkey AS DriverId,
                           CASE WHEN strpos(p_name, ' ') = 0 THEN p_name
                                ELSE left(p_name, strpos(p_name, ' ') - 1) END AS Firstname,
                           ltrim(substr(p_name, strpos(p_name || ' ', ' '))) AS Lastname
                    FROM part)"""

CUSTOMER_DRIVER = """Driver AS (SELECT c_custkey AS DriverId, c_name AS Firstname,
                               CAST(NULL AS VARCHAR) AS Lastname FROM customer)"""

CIRCUIT_OF_RACE = """RaceCircuit AS (SELECT o.o_orderkey AS RaceId, n.n_name AS CircuitName
                     FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
                                   JOIN nation n ON n.n_nationkey = c.c_nationkey)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def hundredths(num: str, den: str) -> str:
    """Exact ROUND(100.0 * num / den, 2) * 100, half up, NULL for den = 0."""
    return f"(CAST({num} AS BIGINT) * 20000 + NULLIF({den}, 0)) // (2 * NULLIF({den}, 0))"


def pct_fixed(h: str) -> str:
    return f"(CAST(({h}) // 100 AS VARCHAR) || '.' || lpad(CAST(({h}) % 100 AS VARCHAR), 2, '0') || '%')"


def pct_trimmed(h: str) -> str:
    return (f"(CASE WHEN ({h}) % 100 = 0 THEN CAST(({h}) // 100 AS VARCHAR)"
            f" WHEN ({h}) % 10 = 0 THEN CAST(({h}) // 100 AS VARCHAR) || '.' || CAST((({h}) % 100) // 10 AS VARCHAR)"
            f" ELSE CAST(({h}) // 100 AS VARCHAR) || '.' || lpad(CAST(({h}) % 100 AS VARCHAR), 2, '0') END || '%')")


def year_range(lo: str, hi: str) -> str:
    return f"CASE WHEN {lo} = {hi} THEN CAST({lo} AS VARCHAR) ELSE concat_ws('-', {lo}, {hi}) END"


def periods_view(pairs_sql: str) -> str:
    """Active periods over a (DriverId, RaceYear) query: consecutive years keep the same
    difference to their rank among the driver's years."""
    return f"""Active AS (SELECT DISTINCT DriverId, RaceYear FROM ({pairs_sql}) p),
Stretch AS (SELECT DriverId, min(RaceYear) AS lo, max(RaceYear) AS hi
            FROM (SELECT *, RaceYear - row_number() OVER (PARTITION BY DriverId ORDER BY RaceYear) AS offs FROM Active)
            GROUP BY DriverId, offs),
DriverYearRanges AS (SELECT DriverId, array_to_string(list({year_range('lo', 'hi')} ORDER BY lo), ', ') AS Ranges,
                            count(*) AS Periods FROM Stretch GROUP BY DriverId)"""


# -- Q1 ----------------------------------------------------------------------------------

Q1 = _with(PART_DRIVER) + f"""
, entry AS (SELECT l_partkey AS DriverId, l_quantity AS laps, max(l_quantity) OVER (PARTITION BY l_orderkey) AS longest
            FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = {A.Q1_SEASON}) s ON o_orderkey = l_orderkey),
worst AS (SELECT DriverId, min(laps::DOUBLE / nullif(longest::DOUBLE, 0)) AS share,
                 min((200 * laps::BIGINT + longest::BIGINT) // (2 * nullif(longest::BIGINT, 0))) AS pct
          FROM entry GROUP BY DriverId)
SELECT concat_ws(' ', Firstname, Lastname) AS Name, pct || '%' AS Completion, share AS MinCompletion
FROM worst JOIN Driver USING (DriverId) WHERE share >= 0.9
"""

# -- Q2 ----------------------------------------------------------------------------------

def _lap_report(chosen: str) -> str:
    """What is shown of the chosen results; ``chosen`` picks them from ``run``, the results of the races asked about."""
    return _with(RACE, RESULT, SUPPLIER_DRIVER, CIRCUIT_OF_RACE) + f"""
, run AS (FROM Result SEMI JOIN (FROM Race WHERE RaceYear >= {A.Q2_FROM} AND RaceYear <= {A.Q2_TO}) asked USING (RaceId)),
chosen AS ({chosen})
SELECT ResultStatus, Laps, Points, PositionText AS Position, FastestLapTime, FastestLap::BIGINT AS FastestLap,
       array_to_string([Firstname, Lastname], ' ') AS Name, RaceDate::VARCHAR AS RaceDate, CircuitName
FROM chosen JOIN Driver USING (DriverId) JOIN RaceCircuit USING (RaceId) JOIN Race USING (RaceId)
"""


_LAP_ORDER = "FastestLapTime, Position, PartId, DriverId"
Q2_FIRST = _lap_report(f"SELECT unnest(first(run ORDER BY {_LAP_ORDER})) FROM run WHERE FastestLapTime IS NOT NULL GROUP BY RaceId")
Q2_ALL_TIES = _lap_report("FROM run WHERE Laps IS NOT NULL QUALIFY rank() OVER (PARTITION BY RaceId ORDER BY Laps) = 1")
Q2_SCALAR = _lap_report(f"SELECT DISTINCT ON (RaceId) * FROM run WHERE FastestLapTime IS NOT NULL ORDER BY RaceId, {_LAP_ORDER}")

# -- Q4 ----------------------------------------------------------------------------------


def _q4(least: int) -> str:
    """A period begins in a year without the year before and ends in one without the year after; drivers with ``least`` periods."""
    return _with(CUSTOMER_DRIVER) + f"""
, active AS (SELECT o_custkey AS DriverId, list_sort(list_distinct(list(year(o_orderdate)))) AS ys FROM orders GROUP BY o_custkey),
ends AS (SELECT DriverId, [y FOR y IN ys IF NOT list_contains(ys, y - 1)] AS a, [y FOR y IN ys IF NOT list_contains(ys, y + 1)] AS b FROM active)
SELECT array_to_string([a[i] || CASE WHEN b[i] > a[i] THEN '-' || b[i] ELSE '' END FOR i IN range(1, len(a) + 1)], ', ') AS Periodes,
       array_to_string([Firstname, Lastname], ' ') AS Coureur
FROM ends JOIN Driver USING (DriverId) WHERE len(a) >= {least}
"""


Q4_ALL, Q4_RETURNERS = _q4(1), _q4(2)

# -- Q5 ----------------------------------------------------------------------------------

def _q5(entries: str, wins: str) -> str:
    return _with(RACE, RESULT, SUPPLIER_DRIVER, periods_view(
        "SELECT DriverId, RaceYear FROM Result JOIN Race USING (RaceId)")) + f"""
, tally AS (SELECT DriverId, {entries} AS n, {wins} AS w FROM Result GROUP BY DriverId)
SELECT concat_ws(' ', Firstname, Lastname) AS Driver, Ranges AS Seasons, n AS Entries, w AS Wins,
       {pct_trimmed(hundredths('w', 'n'))} AS Percentage
FROM tally JOIN Driver USING (DriverId) LEFT JOIN DriverYearRanges USING (DriverId) WHERE w >= {A.Q5_MIN_WINS}
"""


Q5 = _q5("count(*)", "count(*) FILTER (Position = 1)")
Q5_RACES = _q5("count(DISTINCT RaceId)", "count(DISTINCT RaceId) FILTER (Position = 1)")

# -- Q6 ----------------------------------------------------------------------------------

Q6_SINGLE = _with(RACE, RESULT, SUPPLIER_DRIVER) + f"""
, tally AS (SELECT DriverId, RaceYear, count(*) AS n, count(*) FILTER (Position = 1) AS w
            FROM Result JOIN Race USING (RaceId) GROUP BY ALL)
SELECT concat_ws(' ', Firstname, Lastname) AS Driver, RaceYear::BIGINT AS Season, n AS Races, w AS Wins,
       {pct_fixed(hundredths('w', 'n'))} AS Percentage
FROM tally JOIN Driver USING (DriverId)
"""

# the same shares from one window pass over the single results
Q6_WINDOW = _with(RACE, RESULT, SUPPLIER_DRIVER) + f"""
, each AS (SELECT DISTINCT DriverId, RaceYear, count(*) OVER s AS n, sum((Position = 1)::INT) OVER s AS w
           FROM Result JOIN Race USING (RaceId) WINDOW s AS (PARTITION BY DriverId, RaceYear))
SELECT concat_ws(' ', Firstname, Lastname) AS Driver, RaceYear::BIGINT AS Season, n::BIGINT AS Races, coalesce(w, 0)::BIGINT AS Wins,
       {pct_fixed(hundredths('coalesce(w, 0)', 'n'))} AS Percentage
FROM each JOIN Driver USING (DriverId)
"""

ORACLE = {
    "q1_min_completion": Q1,
    "q1_window": Q1,
    "q2_fastest_first": Q2_FIRST,
    "q2_fastest_all_ties": Q2_ALL_TIES,
    "q2_scalar_top1": Q2_SCALAR,
    "q4_periods": Q4_ALL,
    "q4_returners": Q4_RETURNERS,
    "q5_career_wins": Q5,
    "q6_win_share": Q6_SINGLE,
    "q6_left_join": Q6_WINDOW,
    "q5_two_aggregates": Q5,
    "q5_window": Q5,
    "q5_distinct_races": Q5_RACES,
    "q6_lateral": Q6_SINGLE,
    "o3_latest_race": """SELECT o_orderkey AS RaceId, o_orderdate::DATE::VARCHAR AS RaceDate,
        (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS Results
        FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1""",
}


# -- championship (Q3, Q7) ---------------------------------------------------------------

CHAMPIONSHIP = """Sale AS (SELECT CAST(year(o.o_orderdate) AS INTEGER) AS RaceYear,
                 CAST(month(o.o_orderdate) AS INTEGER) AS NrOfRound, c.c_nationkey AS DriverId,
                 c.c_mktsegment AS Seg, CAST(o.o_totalprice AS DECIMAL(18,2)) AS Value
          FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
SegPts AS (SELECT RaceYear, NrOfRound, DriverId, Seg, SUM(Value) AS SegPoints
           FROM Sale GROUP BY RaceYear, NrOfRound, DriverId, Seg),
RoundAgg AS (SELECT RaceYear * 100 + NrOfRound AS RaceId, RaceYear, NrOfRound, DriverId,
                    SUM(SegPoints) AS Points,
                    first(Seg ORDER BY SegPoints DESC, Seg) AS ConstructorName
             FROM SegPts GROUP BY RaceYear, NrOfRound, DriverId),
RoundResult AS (SELECT *, CAST(RaceId AS BIGINT) * 1000 + DriverId AS ResultId,
                       ROW_NUMBER() OVER (PARTITION BY RaceId ORDER BY Points DESC, DriverId) AS Position
                FROM RoundAgg),
Race AS (SELECT DISTINCT RaceId, RaceYear, NrOfRound,
                CAST(make_date(RaceYear, NrOfRound, 1) AS VARCHAR) AS RaceDate,
                'Round ' || CAST(NrOfRound AS VARCHAR) AS RaceName FROM RoundResult),
Entrant AS (SELECT DISTINCT RaceYear, DriverId FROM RoundResult),
Cum AS (SELECT r.RaceId, r.RaceYear, r.NrOfRound, e.DriverId,
               SUM(COALESCE(rr.Points, 0)) OVER (PARTITION BY r.RaceYear, e.DriverId ORDER BY r.NrOfRound
                                                ROWS UNBOUNDED PRECEDING) AS Points
        FROM Race r JOIN Entrant e ON e.RaceYear = r.RaceYear
        LEFT JOIN RoundResult rr ON rr.RaceId = r.RaceId AND rr.DriverId = e.DriverId),
DriverStanding AS (SELECT RaceId, DriverId, Points,
                          ROW_NUMBER() OVER (PARTITION BY RaceId ORDER BY Points DESC, DriverId) AS Position
                   FROM Cum),
Driver AS (SELECT n.n_nationkey AS DriverId, split_part(n.n_name, '_', 1) AS Firstname,
                  CASE WHEN len(string_split(n.n_name, '_')) >= 2 THEN string_split(n.n_name, '_')[2] END AS Lastname,
                  r.r_name AS Nationality
           FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey)"""

STANDINGS = _with(CHAMPIONSHIP) + """
SELECT CAST(RaceId AS BIGINT) AS RaceId, CAST(DriverId AS BIGINT) AS DriverId,
       CAST(Points AS DOUBLE) AS Points, CAST(Position AS BIGINT) AS Position FROM DriverStanding
"""

# The leader of every round; the champion leads the last. He leads for good from the round after
# the last one that somebody else led.
Q3 = _with(CHAMPIONSHIP) + """
, led AS (SELECT RaceYear, NrOfRound, RaceDate, RaceName, DriverId AS leader,
                 arg_max(DriverId, NrOfRound) OVER (PARTITION BY RaceYear) AS champion
          FROM DriverStanding JOIN Race USING (RaceId) WHERE Position = 1),
stay AS (SELECT *, count(*) OVER (PARTITION BY RaceYear) AS n_races,
                coalesce(max(NrOfRound) FILTER (leader <> champion) OVER (PARTITION BY RaceYear), 0) AS other FROM led),
won AS (SELECT RaceYear, DriverId AS champion, count(*) AS n FROM RoundResult WHERE Position = 1 GROUP BY ALL),
since AS (SELECT RaceYear, champion, any_value(n_races) AS n_races, min(NrOfRound) AS round_no,
                 arg_min(RaceDate, NrOfRound) AS day, arg_min(RaceName, NrOfRound) AS label
          FROM stay WHERE NrOfRound > other GROUP BY ALL)
SELECT RaceYear::BIGINT AS Seizoen, concat_ws(' ', Firstname, Lastname) AS Kampioen, coalesce(n, 0)::BIGINT AS RaceWins,
       n_races::BIGINT AS TotaalRaces, day AS LeiderVanaf, round_no::BIGINT AS Volgnummer, label AS Race
FROM since LEFT JOIN won USING (RaceYear, champion) JOIN Driver ON DriverId = champion
"""

# Standings after each season's last round, with the car of the driver's latest result in it.
Q7 = _with(CHAMPIONSHIP) + """
, final AS (SELECT RaceId, RaceYear, DriverId, s.Position, s.Points FROM DriverStanding s JOIN Race USING (RaceId)
            QUALIFY NrOfRound = max(NrOfRound) OVER (PARTITION BY RaceYear)),
car AS (SELECT RaceId, DriverId, arg_max(ConstructorName, ResultId) AS name FROM RoundResult GROUP BY ALL)
SELECT RaceYear::BIGINT AS Season, Position::BIGINT AS POS, Firstname || ' ' || Lastname AS DRIVER, Nationality AS NATIONALITY,
       car.name AS CAR, Points::DOUBLE AS PTS
FROM final JOIN Driver USING (DriverId) LEFT JOIN car USING (RaceId, DriverId)
"""

ORACLE.update({
    "q3_apply_rewrite": Q3,
    "q7_lateral_top1": Q7,
    "standings_builder": STANDINGS,
    "standings_continued": STANDINGS,
    "q3_unbroken_lead": Q3,
    "q7_final_standings": Q7,
})


# -- integrity: rules, overlays, upserts ----------------------------------------------------

from podium.plans import integrity as I  # noqa: E402

_CUT = f"TIMESTAMP '{I.CUT} 00:00:00'"
_SEQ = "ShipDate, RaceId, Position, ResultNumber, DriverId"

IRACE = """IRace AS (SELECT o_orderkey AS RaceId, CAST(year(o_orderdate) AS INTEGER) AS RaceYear,
                    o_custkey AS CustomerId, o_orderstatus AS Status, o_orderdate AS RaceDate FROM orders)"""
IRES = """IRes AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                             strftime(l_shipdate, '%Y%m%d')) AS ResultId,
                   l_orderkey AS RaceId, l_suppkey AS DriverId, l_linenumber AS Position,
                   l_partkey AS ResultNumber, l_linestatus AS LineStatus, l_shipdate AS ShipDate
            FROM lineitem)"""
ISPLIT = f"""IBase AS (SELECT * FROM IRes WHERE ShipDate < {_CUT}),
IBatch AS (SELECT * FROM IRes WHERE ShipDate >= {_CUT})"""
IUPD = """IUpd AS (SELECT ResultId, RaceId, DriverId, Position + 1 AS Position, ResultNumber
                 FROM IRes WHERE LineStatus = 'O')"""


def _dup_sql(key: str, label: str, gate: int | None, extra: str = "") -> str:
    gate_sql = f" AND ra.RaceYear >= {gate}" if gate is not None else ""
    return _with(IRACE, IRES, ISPLIT) + f"""
SELECT r.RaceId, r.{key}, CAST(COUNT(*) AS BIGINT) AS Count,
       concat('Duplicate {label} detected: RaceId = ', r.RaceId, ', {key} = ', r.{key},
              ', Count = ', COUNT(*)) AS Message
FROM IRes r JOIN IRace ra ON ra.RaceId = r.RaceId
WHERE r.{key} IS NOT NULL{gate_sql}{extra}
GROUP BY r.RaceId, r.{key} HAVING COUNT(*) > 1
"""


R1_AUDIT = _dup_sql("Position", "position", I.POSITION_GATE)
R1_TOUCHED = _dup_sql("Position", "position", None, " AND r.RaceId IN (SELECT RaceId FROM IBatch)")
R2_AUDIT = _dup_sql("DriverId", "driver", I.DRIVER_GATE)
R2_TOUCHED = _dup_sql("DriverId", "driver", I.DRIVER_GATE,
                      " AND r.RaceId IN (SELECT RaceId FROM IBatch) AND r.DriverId IN (SELECT DriverId FROM IBatch)")

R3_AUDIT = _with(IRACE) + f"""
SELECT CustomerId, CAST(RaceYear AS BIGINT) AS RaceYear, CAST(COUNT(*) AS BIGINT) AS Count,
       concat('Season with more than {I.SEASON_CAP} races detected: RaceYear = ', CustomerId, '/', RaceYear) AS Message
FROM IRace GROUP BY CustomerId, RaceYear HAVING COUNT(*) > {I.SEASON_CAP}
"""

R3_TOUCHED = _with(IRACE) + f"""
SELECT CustomerId, CAST(RaceYear AS BIGINT) AS RaceYear, CAST(COUNT(*) AS BIGINT) AS Count,
       concat('Season with more than {I.SEASON_CAP} races detected: RaceYear = ', CustomerId, '/', RaceYear) AS Message
FROM IRace
WHERE (CustomerId, RaceYear) IN (SELECT (CustomerId, RaceYear) FROM IRace WHERE RaceDate >= {_CUT})
GROUP BY CustomerId, RaceYear HAVING COUNT(*) > {I.SEASON_CAP}
"""


def _owner_sql(extra: str = "") -> str:
    return _with(IRACE, IRES, ISPLIT) + f"""
SELECT CAST(ra.RaceYear AS BIGINT) AS RaceYear, r.ResultNumber,
       CAST(COUNT(DISTINCT r.DriverId) AS BIGINT) AS Drivers,
       'ResultNumber already used by another driver in this season' AS Message
FROM IRes r JOIN IRace ra ON ra.RaceId = r.RaceId
WHERE r.ResultNumber IS NOT NULL AND r.DriverId IS NOT NULL AND ra.RaceYear >= {I.NUMBER_GATE}{extra}
GROUP BY ra.RaceYear, r.ResultNumber HAVING COUNT(DISTINCT r.DriverId) > 1
"""


R4_AUDIT = _owner_sql()
R4_TOUCHED = _owner_sql(" AND (ra.RaceYear, r.ResultNumber) IN (SELECT (x.RaceYear, b.ResultNumber) "
                        "FROM IBatch b JOIN IRace x ON x.RaceId = b.RaceId WHERE b.ResultNumber IS NOT NULL)")

S8 = _with(IRACE, IRES, IUPD) + """
SELECT ResultId, RaceId, DriverId, Position, ResultNumber FROM IRes
WHERE ResultId NOT IN (SELECT ResultId FROM IUpd)
UNION ALL
SELECT u.ResultId, u.RaceId, u.DriverId, u.Position, u.ResultNumber FROM IUpd u
WHERE u.ResultId IN (SELECT ResultId FROM IRes)
"""

S9 = _with(IRACE, IRES, IUPD) + """
SELECT r.ResultId, r.RaceId, r.DriverId,
       CASE WHEN u.ResultId IS NOT NULL THEN u.Position ELSE r.Position END AS Position, r.ResultNumber
FROM IRes r LEFT JOIN IUpd u ON u.ResultId = r.ResultId
"""


def _create_unique_sql(key: str, gate: int, message: str) -> str:
    return _with(IRACE, IRES, ISPLIT) + f"""
, B AS (SELECT b.*, ra.RaceYear FROM IBatch b LEFT JOIN IRace ra ON ra.RaceId = b.RaceId),
Ranked AS (SELECT ResultId, ROW_NUMBER() OVER (PARTITION BY RaceId, {key} ORDER BY {_SEQ}) AS rn
           FROM B WHERE RaceYear IS NOT NULL AND {key} IS NOT NULL AND RaceYear >= {gate}),
E AS (SELECT B.ResultId,
             CASE WHEN B.RaceYear IS NULL THEN 'Race does not exist'
                  WHEN B.{key} IS NOT NULL AND B.RaceYear >= {gate}
                       AND (EXISTS (SELECT 1 FROM IBase x WHERE x.RaceId = B.RaceId AND x.{key} = B.{key})
                            OR k.rn > 1) THEN '{message}' END AS Error
      FROM B LEFT JOIN Ranked k ON k.ResultId = B.ResultId)
SELECT ResultId, CASE WHEN Error IS NULL THEN 'accepted' ELSE 'rejected' END AS Status, Error FROM E
"""


U1 = _create_unique_sql("Position", I.POSITION_GATE, "Position is already occupied in race")
U3 = _create_unique_sql("DriverId", I.DRIVER_GATE, "Driver already has a result in this race")

U5 = _with(IRACE) + f"""
, Base AS (SELECT * FROM IRace WHERE RaceDate < {_CUT}),
Batch AS (SELECT * FROM IRace WHERE RaceDate >= {_CUT}),
BC AS (SELECT CustomerId, RaceYear, COUNT(*) AS n FROM Base GROUP BY CustomerId, RaceYear),
Rk AS (SELECT b.RaceId, COALESCE(bc.n, 0) AS n,
              ROW_NUMBER() OVER (PARTITION BY b.CustomerId, b.RaceYear ORDER BY b.RaceDate, b.RaceId) AS rn
       FROM Batch b LEFT JOIN BC bc ON bc.CustomerId = b.CustomerId AND bc.RaceYear = b.RaceYear)
SELECT RaceId, CASE WHEN n + rn <= {I.SEASON_CAP} THEN 'accepted' ELSE 'rejected' END AS Status,
       CASE WHEN n + rn <= {I.SEASON_CAP} THEN NULL
            ELSE 'The number of races in the season will exceed {I.SEASON_CAP} with the insertion of a new one.' END AS Error
FROM Rk
"""

U7 = _with(IRACE, IRES, ISPLIT) + f"""
, B AS (SELECT b.*, ra.RaceYear FROM IBatch b LEFT JOIN IRace ra ON ra.RaceId = b.RaceId),
BaseOwn AS (SELECT ra.RaceYear, r.ResultNumber, COUNT(DISTINCT r.DriverId) AS n, MIN(r.DriverId) AS o
            FROM IBase r JOIN IRace ra ON ra.RaceId = r.RaceId
            WHERE r.ResultNumber IS NOT NULL AND r.DriverId IS NOT NULL
            GROUP BY ra.RaceYear, r.ResultNumber),
FirstOwn AS (SELECT RaceYear, ResultNumber, first(DriverId ORDER BY {_SEQ}) AS o FROM B
             WHERE RaceYear IS NOT NULL AND ResultNumber IS NOT NULL AND RaceYear >= {I.NUMBER_GATE}
             GROUP BY RaceYear, ResultNumber),
E AS (SELECT B.ResultId,
             CASE WHEN B.RaceYear IS NULL THEN 'Race does not exist'
                  WHEN B.ResultNumber IS NOT NULL AND B.RaceYear >= {I.NUMBER_GATE}
                       AND COALESCE(B.DriverId <> CASE WHEN bo.n IS NULL THEN fo.o WHEN bo.n = 1 THEN bo.o END, TRUE)
                  THEN 'ResultNumber already used by another driver in this season' END AS Error
      FROM B LEFT JOIN BaseOwn bo ON bo.RaceYear = B.RaceYear AND bo.ResultNumber = B.ResultNumber
             LEFT JOIN FirstOwn fo ON fo.RaceYear = B.RaceYear AND fo.ResultNumber = B.ResultNumber)
SELECT ResultId, CASE WHEN Error IS NULL THEN 'accepted' ELSE 'rejected' END AS Status, Error FROM E
"""

_REFUSED = "Batch refused: another row of the batch violates a rule"


IDIRTY = """IOne AS (SELECT CASE WHEN DriverId % 41 = 0 THEN concat_ws(':', RaceId, Position + 1000, ResultNumber, DriverId,
                                      strftime(ShipDate, '%Y%m%d')) ELSE ResultId END AS ResultId,
                CASE WHEN DriverId % 40 = 0 THEN -RaceId ELSE RaceId END AS RaceId, DriverId,
                nullif(Position + 1, 7) AS Position, CASE WHEN ResultNumber % 10 <> 0 THEN ResultNumber END AS ResultNumber
         FROM IRes WHERE LineStatus = 'O'),
IUpd AS (SELECT * FROM IOne UNION ALL SELECT * FROM IOne WHERE DriverId % 43 = 0)"""


def _held_once(*group: str, number: str = "ResultNumber") -> str:
    return f"""IUpd AS (SELECT ResultId, RaceId, DriverId, Position + 100 AS Position, {number} AS ResultNumber
             FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(group)}) AS held FROM IRes)
             WHERE held = 1 AND LineStatus = 'O')"""


def _update_sql(clash: str, message: str, batch: str = IDIRTY) -> str:
    return _with(IRACE, IRES, batch) + f"""
, B AS (SELECT u.*, ra.RaceYear, u.ResultId IN (SELECT ResultId FROM IRes) AS known,
               count(*) OVER (PARTITION BY u.ResultId) AS copies
        FROM IUpd u LEFT JOIN IRace ra ON ra.RaceId = u.RaceId),
Sound AS (SELECT * FROM B WHERE RaceYear IS NOT NULL AND known AND copies = 1),
State AS (SELECT ResultId, RaceId, DriverId, Position, ResultNumber FROM IRes
          WHERE ResultId NOT IN (SELECT ResultId FROM Sound)
          UNION ALL
          SELECT ResultId, RaceId, DriverId, Position, ResultNumber FROM Sound),
StateSeason AS (SELECT s.*, r2.RaceYear FROM State s JOIN IRace r2 ON r2.RaceId = s.RaceId),
NumberSpan AS (SELECT RaceYear, ResultNumber, MIN(DriverId) AS lo, MAX(DriverId) AS hi FROM StateSeason
               WHERE ResultNumber IS NOT NULL GROUP BY RaceYear, ResultNumber),
E AS (SELECT B.ResultId,
             CASE WHEN B.RaceYear IS NULL THEN 'Race does not exist'
                  WHEN NOT B.known THEN 'Result does not exist'
                  WHEN B.copies > 1 THEN 'Key is repeated in the batch'
                  WHEN {clash} THEN '{message}' END AS Error FROM B),
Failed AS (SELECT COUNT(*) FILTER (WHERE Error IS NOT NULL) AS failed FROM E)
SELECT ResultId,
       CASE WHEN COALESCE(Error, CASE WHEN failed > 0 THEN '{_REFUSED}' END) IS NULL THEN 'accepted'
            ELSE 'rejected' END AS Status,
       COALESCE(Error, CASE WHEN failed > 0 THEN '{_REFUSED}' END) AS Error
FROM E, Failed
"""


_U2 = (f"""B.Position IS NOT NULL AND B.RaceYear >= {I.POSITION_GATE} AND EXISTS (
    SELECT 1 FROM State s WHERE s.RaceId = B.RaceId AND s.Position = B.Position AND s.ResultId <> B.ResultId)""",
       "Position is already occupied in race")
_U4 = (f"""B.DriverId IS NOT NULL AND B.RaceYear >= {I.DRIVER_GATE} AND EXISTS (
    SELECT 1 FROM State s WHERE s.RaceId = B.RaceId AND s.DriverId = B.DriverId AND s.ResultId <> B.ResultId)""",
       "Driver already has a result in this race")
# another row of the season holds the number with another driver exactly when the
# number's lowest or highest driver differs from this row's driver
_U8 = (f"""B.ResultNumber IS NOT NULL AND B.RaceYear >= {I.NUMBER_GATE} AND EXISTS (
    SELECT 1 FROM NumberSpan n
    WHERE n.RaceYear = B.RaceYear AND n.ResultNumber = B.ResultNumber
      AND (n.lo <> B.DriverId OR n.hi <> B.DriverId))""",
       "ResultNumber already used by another driver in this season")


def _cap_move_sql(years: int, which: str = "") -> str:
    return _with(IRACE) + f"""
, Base AS (SELECT RaceId, CustomerId, RaceYear FROM IRace),
Upd AS (SELECT CASE WHEN CustomerId % 20 = 0 THEN -RaceId ELSE RaceId END AS RaceId, CustomerId,
               RaceYear + {years} AS RaceYear FROM IRace WHERE Status = 'P' {which}),
B AS (SELECT u.*, b.RaceYear AS OldYear, b.CustomerId AS OldCust, b.RaceId IS NOT NULL AS known
      FROM Upd u LEFT JOIN Base b ON b.RaceId = u.RaceId),
State AS (SELECT * FROM Base WHERE RaceId NOT IN (SELECT RaceId FROM Upd)
          UNION ALL SELECT RaceId, CustomerId, RaceYear FROM Upd WHERE RaceId IN (SELECT RaceId FROM Base)),
E AS (SELECT B.RaceId, B.known,
             CASE WHEN B.known
                   AND NOT (B.CustomerId IS NOT DISTINCT FROM B.OldCust AND B.RaceYear IS NOT DISTINCT FROM B.OldYear)
                   AND (SELECT COUNT(*) FROM State s WHERE s.CustomerId = B.CustomerId AND s.RaceYear = B.RaceYear) > {I.SEASON_CAP}
                  THEN 'The number of races in the season will exceed {I.SEASON_CAP} with the addition of a new one.' END AS Error
      FROM B),
Failed AS (SELECT COUNT(*) FILTER (WHERE Error IS NOT NULL) AS failed FROM E)
SELECT RaceId,
       CASE WHEN NOT known THEN 'ignored'
            WHEN COALESCE(Error, CASE WHEN failed > 0 THEN '{_REFUSED}' END) IS NULL THEN 'accepted'
            ELSE 'rejected' END AS Status,
       CASE WHEN NOT known THEN NULL ELSE COALESCE(Error, CASE WHEN failed > 0 THEN '{_REFUSED}' END) END AS Error
FROM E, Failed
"""


_SMALL = f"QUALIFY count(*) OVER (PARTITION BY CustomerId, RaceYear) <= {I.SEASON_CAP}"

# All three result rules at once, each row reporting the first rule its group breaks
# in base + batch; the batch is refused as a whole if any row fails.
_T15_CLEAN = f"""INew AS (SELECT ResultId, RaceId, -DriverId AS DriverId, 1000 AS Position, NULL::BIGINT AS ResultNumber FROM IBatch
                         QUALIFY row_number() OVER (PARTITION BY RaceId ORDER BY {_SEQ}) = 1)"""


def _combined_sql(batch: str = "INew AS (SELECT * FROM IBatch)") -> str:
    return _with(IRACE, IRES, ISPLIT, batch) + f"""
, B AS (SELECT b.*, ra.RaceYear FROM INew b LEFT JOIN IRace ra ON ra.RaceId = b.RaceId),
State AS (SELECT ResultId, RaceId, DriverId, Position, ResultNumber FROM IBase
          UNION ALL SELECT ResultId, RaceId, DriverId, Position, ResultNumber FROM B WHERE RaceYear IS NOT NULL),
StateSeason AS (SELECT s.*, r.RaceYear FROM State s JOIN IRace r ON r.RaceId = s.RaceId),
PosCount AS (SELECT RaceId, Position, COUNT(*) AS n FROM State WHERE Position IS NOT NULL GROUP BY RaceId, Position),
DrvCount AS (SELECT RaceId, DriverId, COUNT(*) AS n FROM State WHERE DriverId IS NOT NULL GROUP BY RaceId, DriverId),
NumberSpan AS (SELECT RaceYear, ResultNumber, MIN(DriverId) AS lo, MAX(DriverId) AS hi FROM StateSeason
               WHERE ResultNumber IS NOT NULL GROUP BY RaceYear, ResultNumber),
E AS (SELECT B.ResultId,
             CASE WHEN B.RaceYear IS NULL THEN 'Race does not exist'
                  WHEN B.Position IS NOT NULL AND B.RaceYear >= {I.POSITION_GATE} AND pc.n > 1
                       THEN 'Position is already occupied in race'
                  WHEN B.DriverId IS NOT NULL AND B.RaceYear >= {I.DRIVER_GATE} AND dc.n > 1
                       THEN 'Driver already has a result in this race'
                  WHEN B.ResultNumber IS NOT NULL AND B.RaceYear >= {I.NUMBER_GATE}
                       AND (ns.lo <> B.DriverId OR ns.hi <> B.DriverId)
                       THEN 'ResultNumber already used by another driver in this season' END AS Error
      FROM B LEFT JOIN PosCount pc ON pc.RaceId = B.RaceId AND pc.Position = B.Position
             LEFT JOIN DrvCount dc ON dc.RaceId = B.RaceId AND dc.DriverId = B.DriverId
             LEFT JOIN NumberSpan ns ON ns.RaceYear = B.RaceYear AND ns.ResultNumber = B.ResultNumber),
Failed AS (SELECT COUNT(*) FILTER (WHERE Error IS NOT NULL) AS failed FROM E)
SELECT ResultId,
       CASE WHEN COALESCE(Error, CASE WHEN failed > 0 THEN '{_REFUSED}' END) IS NULL THEN 'accepted'
            ELSE 'rejected' END AS Status,
       COALESCE(Error, CASE WHEN failed > 0 THEN '{_REFUSED}' END) AS Error
FROM E, Failed
"""

# T15 row by row. A claim is a row's stake in a rule's group, under an owner; a row waits (U) while an earlier waiting row shares one
# of its groups under another owner, and is refused (R) by the base or an earlier accepted row (A) that does.
T15_REPLAY = "WITH RECURSIVE " + _with(IRACE, IRES, ISPLIT).removeprefix("WITH ") + f"""
, B AS (SELECT b.*, ra.RaceYear FROM (SELECT *, row_number() OVER (ORDER BY {_SEQ}) AS turn FROM IBatch) b JOIN IRace ra ON ra.RaceId = b.RaceId),
BaseSeason AS (SELECT x.*, ra.RaceYear FROM IBase x JOIN IRace ra ON ra.RaceId = x.RaceId),
Owners AS (SELECT RaceYear, ResultNumber, min(DriverId) AS lo, max(DriverId) AS hi FROM BaseSeason GROUP BY RaceYear, ResultNumber),
Claim AS (
  SELECT ResultId, turn, 0 AS rule, RaceId AS g1, Position AS g2, ResultId AS owner,
         EXISTS (SELECT 1 FROM IBase x WHERE x.RaceId = B.RaceId AND x.Position = B.Position) AS taken FROM B WHERE RaceYear >= {I.POSITION_GATE}
  UNION ALL SELECT ResultId, turn, 1, RaceId, DriverId, ResultId,
         EXISTS (SELECT 1 FROM IBase x WHERE x.RaceId = B.RaceId AND x.DriverId = B.DriverId) FROM B WHERE RaceYear >= {I.DRIVER_GATE}
  UNION ALL SELECT ResultId, turn, 2, B.RaceYear, B.ResultNumber, DriverId::VARCHAR, coalesce(lo <> DriverId OR hi <> DriverId, FALSE)
         FROM B LEFT JOIN Owners o ON o.RaceYear = B.RaceYear AND o.ResultNumber = B.ResultNumber WHERE B.RaceYear >= {I.NUMBER_GATE}),
Turn AS (
  SELECT DISTINCT 0 AS step, ResultId, 'U' AS st FROM Claim
  UNION ALL
  SELECT step + 1, ResultId, CASE WHEN st <> 'U' THEN st WHEN bool_or(clash) THEN 'R' WHEN bool_or(waits) THEN 'U' ELSE 'A' END
  FROM (SELECT step, c.ResultId, st, bool_or(st = 'U') OVER () AS going,
               taken OR coalesce(min(CASE WHEN st = 'A' THEN owner END) OVER w <> owner OR max(CASE WHEN st = 'A' THEN owner END) OVER w <> owner, FALSE) AS clash,
               coalesce(min(CASE WHEN st = 'U' THEN owner END) OVER w <> owner OR max(CASE WHEN st = 'U' THEN owner END) OVER w <> owner, FALSE) AS waits
        FROM Claim c JOIN Turn t ON t.ResultId = c.ResultId
        WINDOW w AS (PARTITION BY rule, g1, g2 ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE going GROUP BY step, ResultId, st),
Final AS (SELECT ResultId, st FROM Turn WHERE step = (SELECT max(step) FROM Turn)),
Broken AS (SELECT ResultId, min(rule) AS rule FROM (
             SELECT c.ResultId, rule, taken OR coalesce(min(CASE WHEN st = 'A' THEN owner END) OVER w <> owner
                                                        OR max(CASE WHEN st = 'A' THEN owner END) OVER w <> owner, FALSE) AS clash
             FROM Claim c JOIN Final f ON f.ResultId = c.ResultId
             WINDOW w AS (PARTITION BY rule, g1, g2 ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
           WHERE clash GROUP BY ResultId)
SELECT B.ResultId, CASE WHEN rule IS NULL THEN 'accepted' ELSE 'rejected' END AS Status,
       ['Position is already occupied in race', 'Driver already has a result in this race',
        'ResultNumber already used by another driver in this season'][rule + 1] AS Error
FROM B LEFT JOIN Broken ON Broken.ResultId = B.ResultId
"""


X3_COUNTS = _with(IRACE, IRES) + f"""
, State AS (SELECT s.*, ra.RaceYear, CASE WHEN LineStatus = 'O' THEN Position + 1 ELSE Position END AS Place FROM IRes s JOIN IRace ra ON ra.RaceId = s.RaceId)
SELECT 'R1' AS Rule, RaceId AS First, Place AS Second, count(*) AS Count FROM State WHERE RaceYear >= {I.POSITION_GATE}
GROUP BY RaceId, Place HAVING count(*) > 1 AND bool_or(LineStatus = 'O')
UNION ALL SELECT 'R2', RaceId, DriverId, count(*) FROM State WHERE RaceYear >= {I.DRIVER_GATE} GROUP BY RaceId, DriverId HAVING count(*) > 1 AND bool_or(LineStatus = 'O')
UNION ALL SELECT 'R4', RaceYear, ResultNumber, count(DISTINCT DriverId) FROM State WHERE RaceYear >= {I.NUMBER_GATE}
GROUP BY RaceYear, ResultNumber HAVING count(DISTINCT DriverId) > 1 AND bool_or(LineStatus = 'O')
"""


def _partial_sql(key: str, gate: int, message: str, moves: str) -> str:
    """The moves that fit: a move fails if it is not the first into its place, or if one who is there stays or fails."""
    return "WITH RECURSIVE " + _with(IRACE, IRES).removeprefix("WITH ") + f"""
, Move AS (SELECT m.*, ra.RaceYear >= {gate} AND m.{key} IS NOT NULL AS asks
           FROM (SELECT ResultId, RaceId, {moves} AS {key}, row_number() OVER (ORDER BY {_SEQ}) AS turn FROM IRes WHERE LineStatus = 'O') m
           JOIN IRace ra ON ra.RaceId = m.RaceId),
First AS (SELECT RaceId, {key}, arg_min(ResultId, turn) AS winner FROM Move WHERE asks GROUP BY RaceId, {key}),
Leaves AS (SELECT r.ResultId, f.winner, m.ResultId IS NOT NULL AS moves
           FROM IRes r JOIN First f ON f.RaceId = r.RaceId AND f.{key} = r.{key} LEFT JOIN Move m ON m.ResultId = r.ResultId WHERE r.ResultId <> f.winner),
Failed AS (
  SELECT m.ResultId FROM Move m JOIN First f ON f.RaceId = m.RaceId AND f.{key} = m.{key} WHERE asks AND m.ResultId <> winner
  UNION SELECT winner FROM Leaves WHERE NOT moves
  UNION SELECT l.winner FROM Failed f JOIN Leaves l ON l.ResultId = f.ResultId AND l.moves)
SELECT m.ResultId, CASE WHEN f.ResultId IS NULL THEN 'accepted' ELSE 'rejected' END AS Status, CASE WHEN f.ResultId IS NOT NULL THEN '{message}' END AS Error
FROM Move m LEFT JOIN (SELECT DISTINCT ResultId FROM Failed) f ON f.ResultId = m.ResultId
"""


U2_PARTIAL = _partial_sql("Position", I.POSITION_GATE, "Position is already occupied in race", """CASE WHEN DriverId % 7 = 0 THEN -Position WHEN DriverId % 11 = 0 THEN NULL
    WHEN DriverId % 2 = 0 THEN Position + 1 ELSE 8 - Position END""")
U4_PARTIAL = _partial_sql("DriverId", I.DRIVER_GATE, "Driver already has a result in this race", "DriverId + CASE WHEN Position % 2 = 1 THEN 1 ELSE -1 END")

# creates with keys that exist, keys given twice and drivers that are gone, in the order of the checks
U_KEYS = _with(IRACE, IRES, ISPLIT) + f"""
, Asked AS (SELECT * FROM IBatch UNION ALL SELECT * FROM IBase WHERE DriverId % 9 = 0
            UNION ALL SELECT * FROM IBatch WHERE DriverId % 7 = 0),
B AS (SELECT b.*, ra.RaceYear, count(*) OVER (PARTITION BY b.ResultId) AS copies FROM Asked b LEFT JOIN IRace ra ON ra.RaceId = b.RaceId),
Early AS (SELECT *, CASE WHEN RaceYear IS NULL THEN 'Race does not exist'
                         WHEN ResultId IN (SELECT ResultId FROM IBase) THEN 'Key already exists'
                         WHEN copies > 1 THEN 'Key is repeated in the batch'
                         WHEN DriverId NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 <> 0)
                         THEN 'Driver does not exist' END AS e FROM B),
Ranked AS (SELECT ResultId, row_number() OVER (PARTITION BY RaceId, Position ORDER BY {_SEQ}) AS rn FROM Early
           WHERE e IS NULL AND Position IS NOT NULL AND RaceYear >= {I.POSITION_GATE}),
Done AS (SELECT Early.ResultId, coalesce(e, CASE WHEN rn > 1 OR (rn = 1 AND EXISTS (
             SELECT 1 FROM IBase x WHERE x.RaceId = Early.RaceId AND x.Position = Early.Position))
             THEN 'Position is already occupied in race' END) AS Error
         FROM Early LEFT JOIN Ranked ON Ranked.ResultId = Early.ResultId)
SELECT ResultId, CASE WHEN Error IS NULL THEN 'accepted' ELSE 'rejected' END AS Status, Error FROM Done
"""

S8_LAST = _with(IRES) + """
SELECT ResultId, RaceId, DriverId, CASE WHEN LineStatus = 'O' THEN Position + 3 ELSE Position END AS Position, ResultNumber FROM IRes
"""

_MIDDLE = """
, Ends AS (SELECT min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) * 45 // 100 AS low, min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) * 55 // 100 AS high FROM orders)
SELECT ResultId, RaceId, DriverId, CASE WHEN LineStatus = 'O' AND RaceId BETWEEN low AND high THEN Position + {step} ELSE Position END AS Position, ResultNumber
FROM IRes, Ends
"""
S8_FILES, S9_FILES = _with(IRES) + _MIDDLE.format(step=1), _with(IRES) + _MIDDLE.format(step=11)

S14_CLEAN = _with(IRES, _held_once("RaceId", "Position")) + """
SELECT r.ResultId, r.RaceId, r.DriverId, coalesce(u.Position, r.Position) AS Position, r.ResultNumber
FROM IRes r LEFT JOIN IUpd u ON u.ResultId = r.ResultId
"""

S14_REFUSED = _with(IRACE, IRES) + f"""
, State AS (SELECT *, CASE WHEN LineStatus = 'O' THEN Position + 1 ELSE Position END AS Place FROM IRes)
SELECT s.RaceId, Place AS Position, count(*) AS Count, 'R1' AS Refused, FALSE AS Published
FROM State s JOIN IRace ra ON ra.RaceId = s.RaceId WHERE ra.RaceYear >= {I.POSITION_GATE}
GROUP BY s.RaceId, Place HAVING count(*) > 1 AND count(*) FILTER (LineStatus = 'O') > 0
"""

ORACLE.update({
    "t15_combined_rules": _combined_sql(),
    "t15_combined_rules_clean": _combined_sql(_T15_CLEAN),
    "u_key_checks": U_KEYS,
    "s8_last_change": S8_LAST,
    "t15_combined_replay": T15_REPLAY,
    "x3_maintained_counts": X3_COUNTS,
    "u2_update_partial": U2_PARTIAL,
    "u4_update_partial": U4_PARTIAL,
    "s8_file_overlay": S8_FILES,
    "s9_file_update": S9_FILES,
    "s14_publish_clean": S14_CLEAN,
    "s14_publish_refused": S14_REFUSED,
    "u2_update_clean": _update_sql(*_U2, _held_once("RaceId", "Position")),
    "u4_update_clean": _update_sql(*_U4, _held_once("RaceId", "DriverId")),
    "u8_update_clean": _update_sql(*_U8, _held_once(
        "RaceId", "Position", number="1000000000 + RaceId * 1000 + Position + 100")),
    "u6_cap_move_clean": _cap_move_sql(50, _SMALL),
    "r1_dup_position": R1_AUDIT,
    "r1_touched": R1_TOUCHED,
    "r2_dup_driver": R2_AUDIT,
    "r2_touched_groups": R2_TOUCHED,
    "r3_season_cap": R3_AUDIT,
    "r3_touched": R3_TOUCHED,
    "r4_number_owner": R4_AUDIT,
    "r4_touched": R4_TOUCHED,
    "s8_overlay": S8,
    "s9_partial_update": S9,
    "u1_create": U1,
    "u2_update": _update_sql(*_U2),
    "u3_create": U3,
    "u4_update": _update_sql(*_U4),
    "u5_cap_create": U5,
    "u6_cap_move": _cap_move_sql(1),
    "u7_create": U7,
    "u8_update": _update_sql(*_U8),
})


# -- ingest (I2, I6, I7): the reference's ROW_NUMBER() OVER (ORDER BY ...) + MAX(id) ---------

from podium.plans import loading as L  # noqa: E402

I2 = f"""
WITH Named AS (SELECT o.o_custkey, o.o_orderdate, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
Existing AS (SELECT DISTINCT o_custkey AS DriverId, c_name AS DriverRef FROM Named
             WHERE o_orderdate < TIMESTAMP '{L.DIM_CUT} 00:00:00'),
Cand AS (SELECT DISTINCT c_name AS DriverRef FROM Named WHERE o_orderdate >= TIMESTAMP '{L.DIM_CUT} 00:00:00'),
New AS (SELECT DriverRef FROM Cand WHERE NOT EXISTS (SELECT 1 FROM Existing e WHERE e.DriverRef = Cand.DriverRef))
SELECT CAST(ROW_NUMBER() OVER (ORDER BY DriverRef) + (SELECT COALESCE(MAX(DriverId), 0) FROM Existing) AS BIGINT)
         AS DriverId, DriverRef
FROM New
"""

_LINES = """Lines AS (SELECT l_orderkey AS RaceId, l_linenumber AS Position, l_partkey AS PartId,
                     l_suppkey AS DriverId, l_shipdate AS ShipDate,
                     concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                               strftime(l_shipdate, '%Y%m%d')) AS ResultKey FROM lineitem)"""

I6 = f"""WITH {_LINES}
SELECT ResultKey, CAST(ROW_NUMBER() OVER (ORDER BY RaceId, Position, PartId, DriverId, ShipDate) AS BIGINT) AS ResultId
FROM Lines
"""

I7 = f"""WITH {_LINES},
Loaded AS (SELECT *, ROW_NUMBER() OVER (ORDER BY RaceId, Position, PartId, DriverId, ShipDate) AS ResultId
           FROM Lines WHERE ShipDate < TIMESTAMP '{I.CUT} 00:00:00'),
Staged AS (SELECT * FROM Lines WHERE ShipDate >= TIMESTAMP '{I.CUT} 00:00:00'),
New AS (SELECT * FROM Staged s WHERE NOT EXISTS (SELECT 1 FROM Loaded l
        WHERE l.RaceId = s.RaceId AND l.DriverId = s.DriverId))
SELECT ResultKey, CAST(ROW_NUMBER() OVER (ORDER BY RaceId, Position, PartId, DriverId, ShipDate)
                       + (SELECT COALESCE(MAX(ResultId), 0) FROM Loaded) AS BIGINT) AS ResultId
FROM New
"""

ORACLE.update({"i2_new_dimension": I2, "i6_surrogate_keys": I6, "i7_new_facts": I7})


# -- the result file of podium.plans.feeds -----------------------------------------------------

FEED = """Feed AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS RaceNr, 'Circuit ' || month(o_orderdate) AS Circuit,
        l_quantity = 50 AS stopped, l_linenumber AS place, l_suppkey AS NO,
        CASE WHEN l_suppkey % 13 = 0 AND l_linenumber = 1 THEN '' WHEN l_suppkey % 11 = 0 THEN 'Solo' || l_suppkey
             ELSE 'Rider ' || l_suppkey END AS Driver,
        CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE o_orderpriority END AS Car, l_quantity::INTEGER AS Laps,
        strftime(l_shipdate, '%Y-%m-%d') AS day, round(l_tax * 100) = 8 AS short, round(l_discount * 100) = 10 AS blank
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
Stage AS (SELECT RaceNr, Circuit, CASE WHEN NOT stopped THEN place END AS POS, NO, Driver, Car, Laps,
                 CASE WHEN NOT short THEN day END AS TimeRetired, CASE WHEN NOT short THEN place END AS Points
          FROM Feed WHERE NOT blank),
Texts AS (SELECT *, concat_ws(';', RaceNr, Circuit, CASE WHEN stopped THEN 'DNF' ELSE place::VARCHAR END, NO, Driver, Car, Laps)
                    || CASE WHEN short THEN '' ELSE concat(';', day, ';', place) END AS line,
                 concat_ws('; ', CASE WHEN short THEN 'missing fields' END, CASE WHEN stopped THEN 'POS is not int' END) AS reason
          FROM Feed WHERE NOT blank)"""

ORACLE.update({
    "s2_strict_csv": _with(FEED) + """
SELECT RaceNr, Circuit, place AS POS, NO, nullif(Driver, '') AS Driver, nullif(Car, '') AS Car, Laps, day AS TimeRetired, place AS Points
FROM Feed WHERE NOT (short OR blank OR stopped)""",
    "s3_tolerant_load": _with(FEED) + "SELECT * FROM Stage",
    "s3_rejects": _with(FEED) + "SELECT line, reason FROM Texts WHERE reason <> ''",
    "i3_new_constructors": _with(FEED) + """
SELECT row_number() OVER (ORDER BY lower(name)) + 2 AS ConstructorId, name AS ContstructorName, 'Unknown' AS Nationality
FROM (SELECT DISTINCT coalesce(nullif(Car, ''), 'UNKNOWN') AS name FROM Stage) WHERE left(name, 1) NOT IN ('1', '2')""",
    "i4_new_drivers": _with(FEED) + """
SELECT row_number() OVER (ORDER BY lower(Driver)) + (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0) AS DriverId,
       Driver AS DriverRef, NO AS DriverNumber, split_part(Driver, ' ', 1) AS Firstname, split_part(Driver, ' ', 2) AS Lastname
FROM (SELECT DISTINCT Driver, NO FROM Stage WHERE Driver <> '') WHERE NO % 2 = 1 OR Driver LIKE 'Solo%'""",
    "i5_seasons_races": _with(FEED) + """
, C AS (SELECT Circuit, row_number() OVER (ORDER BY Circuit) AS CircuitId FROM (SELECT DISTINCT Circuit FROM Stage))
SELECT row_number() OVER (ORDER BY RaceNr) AS RaceId, RaceNr // 100 AS RaceYear, RaceNr % 100 AS NrOfRound, CircuitId,
       Circuit AS RaceName, '2020-02-02' AS RaceDate
FROM (SELECT DISTINCT RaceNr, Circuit FROM Stage) JOIN C USING (Circuit)""",
    "i7_ingest_job": _with(FEED) + """
SELECT RaceNr // 100 AS RaceYear, RaceNr % 100 AS NrOfRound, Driver AS DriverRef, coalesce(nullif(Car, ''), 'UNKNOWN') AS ContstructorName,
       POS::BIGINT AS Position, Laps::BIGINT AS Laps, TimeRetired AS Time, Points::DOUBLE AS Points FROM Stage WHERE Driver <> ''""",
    "i7_ingest_rejects": _with(FEED) + """
SELECT line, reason FROM Texts WHERE reason <> ''
UNION ALL SELECT concat_ws(';', RaceNr, Circuit, coalesce(POS::VARCHAR, ''), NO, Driver, coalesce(nullif(Car, ''), 'UNKNOWN'), Laps,
                           coalesce(TimeRetired, ''), coalesce(Points::VARCHAR, '')), 'driver is missing' FROM Stage WHERE Driver = ''""",
})


# -- layouts (same answers as the plain questions) and the stream ---------------------------

S12 = _with(CHAMPIONSHIP) + """
SELECT s.RaceId::BIGINT AS RaceId, s.DriverId::BIGINT AS DriverId, s.Position::BIGINT AS Position, s.Points::DOUBLE AS Points,
       r.Position::BIGINT AS Place, r.Points::DOUBLE AS Scored
FROM DriverStanding s LEFT JOIN RoundResult r ON r.RaceId = s.RaceId AND r.DriverId = s.DriverId
"""

_LAPS = """SELECT l_orderkey AS RaceId, l_suppkey AS DriverId, l_partkey AS PartId, l_linenumber::BIGINT AS Position,
       l_extendedprice AS FastestLapTime, l_quantity AS Laps FROM lineitem
"""
S13 = _LAPS + """WHERE l_extendedprice IS NOT NULL
  AND l_orderkey BETWEEN (SELECT min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) * 2 // 5 FROM orders)
                     AND (SELECT min(o_orderkey) + (max(o_orderkey) - min(o_orderkey)) * 3 // 5 FROM orders)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) = 1
"""
S13_DRIVER = _LAPS + "WHERE l_suppkey = (SELECT (min(s_suppkey) + max(s_suppkey)) // 2 FROM supplier)"

# deliveries come in the order of seq, so a feed ends as the creates do
ORACLE.update({
    "s11_bucketed_win_share": Q6_SINGLE,
    "s12_standings_results": S12,
    "s13_clustered_fastest": S13,
    "s13_curve_races": S13,
    "s13_curve_driver": S13_DRIVER,
    "ts1_stream": U1,
    "ts1_stream_driver": U3,
    "ts1_stream_number": U7,
    "ts1_stream_cap": U5,
})


# -- single operators ---------------------------------------------------------------------

def _nth(text: str, sep: str, n: int) -> str:
    return f"CASE WHEN len(string_split({text}, '{sep}')) >= {n} THEN string_split({text}, '{sep}')[{n}] END"


_FIN = hundredths("SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)", "COUNT(*)")

ORACLE.update({
    "w5_w6_periods_lag": Q4_ALL,
    "q4_continued_periods": Q4_ALL,
    "j8_exists_other": _with(RESULT) + """, N AS (SELECT RaceId, DriverId, ResultNumber % 20 AS Number, PartId FROM Result)
        SELECT * FROM N WHERE EXISTS (SELECT 1 FROM N x WHERE x.RaceId = N.RaceId AND x.Number = N.Number AND x.DriverId <> N.DriverId)""",
    "j10_no_later_race": _with(RACE) + """SELECT RaceId, CustomerId, RaceDate::VARCHAR AS RaceDate FROM Race r
        QUALIFY RaceDate = max(RaceDate) OVER (PARTITION BY CustomerId, RaceYear)""",
    "j10_again_within": _with(RACE) + """SELECT RaceId, CustomerId, RaceDate::VARCHAR AS RaceDate FROM Race r
        WHERE EXISTS (SELECT 1 FROM Race x WHERE x.CustomerId = r.CustomerId AND x.RaceDate BETWEEN r.RaceDate + 1 AND r.RaceDate + 30)""",
    "w6_global_islands": _with(RACE) + """, Pair AS (SELECT DISTINCT CustomerId AS DriverId, RaceYear FROM Race),
        Flag AS (SELECT *, CASE WHEN lag(DriverId) OVER w = DriverId AND lag(RaceYear) OVER w + 1 = RaceYear THEN 0 ELSE 1 END AS fresh
                 FROM Pair WINDOW w AS (ORDER BY DriverId, RaceYear)),
        Nr AS (SELECT *, sum(fresh) OVER (ORDER BY DriverId, RaceYear) AS Island FROM Flag)
        SELECT DriverId, CAST(min(RaceYear) AS BIGINT) AS FromYear, CAST(max(RaceYear) AS BIGINT) AS ToYear, CAST(Island AS BIGINT) AS Island
        FROM Nr GROUP BY DriverId, Island""",
    "f12_name_split": _with(PART_DRIVER) + "SELECT DriverId, Firstname, Lastname FROM Driver",
    "f15_nth_part": f"""SELECT o_orderkey AS OrderId, {_nth('o_orderpriority', '-', 1)} AS Part1,
        {_nth('o_orderpriority', '-', 2)} AS Part2, {_nth('o_orderpriority', '-', 3)} AS Part3 FROM orders""",
    "f5_f6_percent_text": f"""SELECT o_custkey AS CustomerId, CAST(COUNT(*) AS BIGINT) AS Orders,
        CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS Finished,
        {pct_trimmed(_FIN)} AS Trimmed, {pct_fixed(_FIN)} AS Fixed
        FROM orders GROUP BY o_custkey""",
    "j13_lateral_count": _with(RACE, RESULT) + """SELECT Race.RaceId, CAST(c.n AS BIGINT) AS Results FROM Race,
        LATERAL (SELECT COUNT(*) AS n FROM Result WHERE Result.RaceId = Race.RaceId) c""",
    "j9_anti": _with(RACE, RESULT) + """SELECT RaceId, CAST(RaceYear AS BIGINT) AS RaceYear FROM Race
        WHERE NOT EXISTS (SELECT 1 FROM Result WHERE Result.RaceId = Race.RaceId)""",
})
