"""The SQL each query is checked against, written from the definitions and not from the jobs."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"
KEY_OUT = (
    "CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey, "
    "CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
    "round(l_extendedprice, 6) AS l_extendedprice"
)
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NAMES = [*NUMERIC, "l_returnflag", "l_linestatus"]
BINS = [5, 5, 5, 5, 3, 2]
LN2 = "ln(2.0::DOUBLE)"

# Rows with their class and codes, and the numeric columns in long form.
SRC = """
src AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
         CASE WHEN l_quantity * l_extendedprice * (1 - l_discount) < 400000 THEN 0
              WHEN l_quantity * l_extendedprice * (1 - l_discount) < 1400000 THEN 1 ELSE 2 END AS cls,
         dense_rank() OVER (ORDER BY l_returnflag) - 1 AS flag,
         dense_rank() OVER (ORDER BY l_linestatus) - 1 AS status
  FROM lineitem)"""
NUM = "num AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT rid, cls, l_linenumber AS block, {i} AS f, '{c}' AS feature, {c} AS x FROM src" for i, c in enumerate(NUMERIC)
) + ")"
ENDS = "ends AS MATERIALIZED (SELECT f, feature, min(x) AS lo, max(x) AS hi FROM num GROUP BY f, feature)"
SETS = """
cores AS MATERIALIZED (SELECT f, feature, k AS bin, lo + (hi - lo) / 4.0::DOUBLE * k AS b FROM ends, range(5) t(k)),
sets AS MATERIALIZED (
  SELECT f, feature, bin, lag(b) OVER w AS a, b, lead(b) OVER w AS c FROM cores WINDOW w AS (PARTITION BY f ORDER BY b))"""


def triangle(x: str = "x") -> str:
    """Membership of x in the triangle (a, b, c) with open null feet."""
    return (
        f"CASE WHEN (a IS NULL OR {x} > a) AND (c IS NULL OR {x} < c) THEN "
        f"CASE WHEN {x} <= b THEN CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE ({x} - a) / (b - a) END "
        f"ELSE CASE WHEN c IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - ({x} - b) / (c - b) END END ELSE 0.0::DOUBLE END"
    )


# Fired bins of every row: the numeric columns 0..3, then the two nominal ones.
MUS = f"""
mus AS MATERIALIZED (
  SELECT * FROM (
    SELECT rid, cls, num.f, bin, {triangle()} AS mu FROM num JOIN sets
      ON num.f = sets.f AND (a IS NULL OR x > a) AND (c IS NULL OR x < c)) WHERE mu > 0
  UNION ALL SELECT rid, cls, 4, flag, 1.0::DOUBLE FROM src
  UNION ALL SELECT rid, cls, 5, status, 1.0::DOUBLE FROM src)"""
PLAN = "plan(f, name, nb) AS (VALUES " + ", ".join(f"({i}, '{n}', {b})" for i, (n, b) in enumerate(zip(NAMES, BINS))) + ")"
FUZZY = f"{SRC}, {NUM}, {ENDS}, {SETS}, {MUS}, {PLAN}"


def xlogx(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0.0::DOUBLE END)"


def bits(total: str, logs: str) -> str:
    return f"(CASE WHEN {total} > 0 THEN ({xlogx(total)} - {logs}) / ({total} * {LN2}) ELSE 0.0::DOUBLE END)"


def big(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


# ---- columns, codes, validation --------------------------------------------------------------

ORACLE["feature_min_max"] = f"WITH {SRC}, {NUM}, {ENDS} SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ends"
ORACLE["class_map"] = """
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS class
FROM (SELECT DISTINCT event_type AS label FROM events)"""
ORACLE["fit_metadata"] = """
SELECT n AS rows, least(1000, n) AS bins, least(1000, n) - 1 AS splits, CAST(floor(n * 0.01::DOUBLE) AS BIGINT) AS min_instances
FROM (SELECT count(*) AS n FROM lineitem)"""
DIGITS = "CAST(length(CAST(year(l_shipdate) AS VARCHAR)) AS VARCHAR)"
ORACLE["constant_features"] = f"""
SELECT CAST(6 AS BIGINT) AS idx, 'year_digits' AS name, min({DIGITS}) AS listing
FROM lineitem HAVING count(DISTINCT {DIGITS}) = 1"""
ORACLE["encode_and_drop"] = f"""
WITH {SRC} SELECT {KEY_OUT}, CAST(flag AS BIGINT) AS l_returnflag, CAST(status AS BIGINT) AS l_linestatus,
  CAST(cls AS BIGINT) AS cls FROM src"""
ORACLE["reindexed_features"] = f"""
WITH c AS (SELECT count(DISTINCT {DIGITS}) AS n FROM lineitem),
all_features(i, name, kind) AS (VALUES (0,'l_quantity','numeric'), (1,'l_extendedprice','numeric'), (2,'l_discount','numeric'),
  (3,'l_tax','numeric'), (4,'l_returnflag','nominal'), (5,'l_linestatus','nominal'), (6,'year_digits','nominal'), (7,'cls','nominal'))
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS idx, name, kind FROM all_features, c WHERE name <> 'year_digits' OR n > 1"""
ORACLE["rule_violations"] = f"""
WITH {SRC} SELECT rule, CAST(bad AS BIGINT) AS bad FROM (
  {" UNION ALL ".join(f"SELECT '{c}: null or NaN' AS rule, count(*) FILTER ({c} IS NULL OR isnan({c})) AS bad FROM src" for c in NUMERIC)}
  UNION ALL SELECT 'l_returnflag: code outside 0..1', count(*) FILTER (flag > 1) FROM src
  UNION ALL SELECT 'l_linestatus: code outside 0..0', count(*) FILTER (status > 0) FROM src
  UNION ALL SELECT 'cls: class outside 0..1', count(*) FILTER (cls > 1) FROM src)"""

# ---- fuzzy sets and t-norms ------------------------------------------------------------------

ORACLE["uniform_cores"] = f"""
WITH {SRC}, {NUM}, {ENDS} SELECT feature, CAST(k AS BIGINT) AS bin, round(k / 4.0::DOUBLE, 6) AS core FROM ends, range(5) t(k)"""
ORACLE["triangular_partition"] = """
WITH v AS (SELECT 'l_discount' AS feature, l_discount AS b FROM lineitem UNION SELECT 'l_tax', l_tax FROM lineitem)
SELECT feature, row_number() OVER w - 1 AS bin, round(lag(b) OVER w, 6) AS a, round(b, 6) AS b, round(lead(b) OVER w, 6) AS c
FROM v WINDOW w AS (PARTITION BY feature ORDER BY b)"""
ORACLE["singleton_partition"] = f"""
WITH v AS (
  SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS n FROM lineitem
  UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem
  UNION ALL SELECT 'year_digits', count(DISTINCT {DIGITS}) FROM lineitem
  UNION ALL SELECT 'cls', 3)
SELECT feature, CAST(k AS BIGINT) AS bin, CAST(k AS DOUBLE) AS v FROM v, range(25) t(k) WHERE k < n"""
ORACLE["fuzzy_sets"] = f"""
WITH {SRC}, {NUM}, {ENDS}, {SETS}, {PLAN}
SELECT feature, {big('bin')}, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM sets
UNION ALL SELECT name, CAST(k AS BIGINT), CAST(k AS DOUBLE), CAST(k AS DOUBLE), CAST(k AS DOUBLE) FROM plan, range(3) t(k) WHERE f > 3 AND k < nb"""
ORACLE["triangular_sets"] = """
SELECT p_partkey, round(t[1], 6) AS a, round(t[2], 6) AS b, round(t[3], 6) AS c
FROM (SELECT p_partkey, list_sort([p_retailprice, p_size * 20.0::DOUBLE, 1000.0::DOUBLE]) AS t FROM part)"""
PRICES = """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
cores AS (SELECT k AS bin, lo + (hi - lo) / 4.0::DOUBLE * k AS b FROM e, range(5) t(k)),
sets AS (SELECT bin, lag(b) OVER (ORDER BY b) AS a, b, lead(b) OVER (ORDER BY b) AS c FROM cores)"""
ORACLE["membership_triangular"] = f"""
{PRICES} SELECT o_orderkey, CAST(bin AS BIGINT) AS bin, round({triangle('o_totalprice')}, 6) AS mu FROM orders, sets"""
ORACLE["in_support"] = f"""
{PRICES} SELECT o_orderkey, CAST(bin AS BIGINT) AS bin,
  (a IS NULL OR o_totalprice > a) AND (c IS NULL OR o_totalprice < c) AS inside FROM orders, sets"""
ORACLE["membership_singleton"] = f"""
WITH {SRC} SELECT {KEY_OUT}, CAST(k AS BIGINT) AS bin, CASE WHEN flag = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mu FROM src, range(3) t(k)"""
ORACLE["binned_rows"] = f"""
WITH {FUZZY} SELECT l_orderkey AS k0, l_partkey AS k1, l_suppkey AS k2, CAST(l_linenumber AS BIGINT) AS k3,
  round(l_extendedprice, 6) AS k4, name AS feature, {big('bin')}, round(mu, 6) AS mu
FROM mus JOIN src USING (rid) JOIN plan ON plan.f = mus.f"""
ORACLE["tnorm_pairs"] = f"""
WITH {SRC}, {NUM}, {ENDS}, {SETS},
top AS (SELECT rid, num.f, max(b) AS b FROM num JOIN sets ON num.f = sets.f AND b <= x WHERE num.f < 2 GROUP BY rid, num.f),
up AS (SELECT num.rid, num.f, CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE (x - sets.b) / (c - sets.b) END AS u
  FROM num JOIN top USING (rid, f) JOIN sets ON sets.f = top.f AND sets.b = top.b)
SELECT {KEY_OUT}, round(p.u * q.u, 6) AS product, round(least(p.u, q.u), 6) AS least
FROM src JOIN up p ON p.rid = src.rid AND p.f = 0 JOIN up q ON q.rid = src.rid AND q.f = 1"""

# ---- impurities ------------------------------------------------------------------------------

GROUPS = f"""
{SRC}, counts AS (
  SELECT l_linenumber, l_returnflag, l_linestatus, cls, CAST(count(*) AS DOUBLE) AS c FROM src GROUP BY ALL),
groups AS (
  SELECT l_linenumber, l_returnflag, l_linestatus, sum(c) AS t, sum(c * ln(c)) AS l, max(c) AS top, count(*) AS k,
    coalesce(sum(c) FILTER (cls = 0), 0) AS c0, coalesce(sum(c) FILTER (cls = 1), 0) AS c1, coalesce(sum(c) FILTER (cls = 2), 0) AS c2
  FROM counts GROUP BY ALL)"""
GROUP_KEYS = "CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus"
ORACLE["entropy_by_group"] = f"WITH {GROUPS} SELECT {GROUP_KEYS}, round({bits('t', 'l')}, 6) AS bits FROM groups"
ORACLE["weighted_impurity"] = f"""
WITH {GROUPS} SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, sum(t) AS n, round(sum(t * {bits('t', 'l')}) / sum(t), 6) AS bits
FROM groups GROUP BY l_linenumber"""
ORACLE["node_measures"] = f"""
WITH {GROUPS} SELECT {GROUP_KEYS}, round(top / t, 6) AS purity, t AS total, k = 1 AS mono,
  round(c0 / t, 6) AS share0, round(c1 / t, 6) AS share1, round(c2 / t, 6) AS share2 FROM groups"""
ORACLE["category_subsets"] = """
SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size,
  coalesce((SELECT string_agg(CAST(j AS VARCHAR), ',' ORDER BY j DESC) FROM range(6) t(j) WHERE (p_size >> j) & 1 = 1), '') AS listing
FROM part"""

# ---- quantiles and scaling -------------------------------------------------------------------

def quantiles(bins: int) -> str:
    return f"""
{SRC}, {NUM}, {ENDS},
positions AS (
  SELECT DISTINCT greatest(0, CAST(ceil(i / {bins}.0::DOUBLE * n - 1) AS BIGINT)) AS p
  FROM range(1, {bins} + 1) t(i), (SELECT count(*) AS n FROM lineitem)),
placed AS (SELECT f, feature, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS p FROM num),
quantiles AS MATERIALIZED (
  SELECT f, feature, row_number() OVER (PARTITION BY f ORDER BY p) - 1 AS idx, x AS q FROM placed JOIN positions USING (p))"""


ORACLE["exact_quantiles"] = f"WITH {quantiles(1000)} SELECT feature, idx, round(q, 6) AS q FROM quantiles"
# Per distinct value: the first quantile not below it, and the map of its segment.
SEGMENTS = """
segments AS (
  SELECT f, idx, q, coalesce(lag(q) OVER w, lo) AS x1, idx / CAST(count(*) OVER (PARTITION BY f) AS DOUBLE) AS y1,
    (idx + 1) / CAST(count(*) OVER (PARTITION BY f) AS DOUBLE) AS y2
  FROM quantiles JOIN ends USING (f) WINDOW w AS (PARTITION BY f ORDER BY idx)),
firsts AS (SELECT f, q, min(idx) AS idx FROM quantiles GROUP BY f, q),
vals AS (SELECT DISTINCT f, x FROM num),
hit AS (SELECT v.f, v.x, fi.idx FROM vals v ASOF LEFT JOIN firsts fi ON v.f = fi.f AND v.x <= fi.q),
scaled AS MATERIALIZED (
  SELECT hit.f, hit.x, CASE WHEN s.idx IS NULL THEN 1.0::DOUBLE WHEN s.q - x1 > 0
    THEN (y2 - y1) / (s.q - x1) * (hit.x - x1) + y1 ELSE y1 END AS y
  FROM hit LEFT JOIN segments s ON s.f = hit.f AND s.idx = hit.idx)"""
ORACLE["uniform_scale"] = f"""
WITH {quantiles(1000)}, {SEGMENTS} SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(src.l_extendedprice, 6) AS price, round(a.y, 6) AS l_quantity, round(b.y, 6) AS l_extendedprice,
  round(c.y, 6) AS l_discount, round(d.y, 6) AS l_tax
FROM src JOIN scaled a ON a.f = 0 AND a.x = l_quantity JOIN scaled b ON b.f = 1 AND b.x = src.l_extendedprice
JOIN scaled c ON c.f = 2 AND c.x = src.l_discount JOIN scaled d ON d.f = 3 AND d.x = src.l_tax"""

# ---- cuts and contingency --------------------------------------------------------------------

WIDTH = f"""
{SRC}, {NUM}, {ENDS},
cuts AS MATERIALIZED (SELECT f, feature, k AS bin, lo + (hi - lo) / 32.0::DOUBLE * k AS cut FROM ends, range(33) t(k)),
lasts AS (SELECT f, min(cut) AS c0, max(cut) AS c1 FROM cuts GROUP BY f),
ct AS MATERIALIZED (
  SELECT f, feature, greatest(0, least(CAST(floor((x - c0) / (c1 - c0) * 32.0::DOUBLE) AS BIGINT), 31)) AS bin, cls AS label, count(*) AS n
  FROM num JOIN lasts USING (f) GROUP BY ALL)"""
SAMPLED = f"{SRC}, {NUM}".replace("FROM src", """FROM src WHERE CAST('0x' || substr(md5('17|' || l_orderkey || '|' || l_partkey || '|'
  || l_suppkey || '|' || l_linenumber), 1, 15) AS BIGINT) < 576460752303423488""")
ORACLE["sampled_cuts"] = f"""
WITH {SAMPLED}, {ENDS}, cuts AS (SELECT feature, CAST(k AS BIGINT) AS bin, lo + (hi - lo) / 32.0::DOUBLE * k AS cut FROM ends, range(33) t(k))
SELECT feature, bin, round(cut, 6) AS cut FROM cuts"""
ORACLE["equi_width_cuts"] = f"WITH {WIDTH} SELECT feature, bin, round(cut, 6) AS cut FROM cuts"


def walk_steps(last: int) -> str:
    """The walk over distinct values, one cut per step: the t-th cut lies before the first value,
    after the previous cut's, whose count with it is farther from target t than the count before it."""
    steps = ["step0 AS (SELECT DISTINCT block, f, CAST(1 AS BIGINT) AS i FROM walk)"]
    for t in range(1, last + 1):
        steps.append(f"""step{t} AS MATERIALIZED (
  SELECT w.block, w.f, min(w.i) AS i FROM step{t - 1} s JOIN walk w ON w.block = s.block AND w.f = s.f AND w.i > s.i
  WHERE abs(16 * before - {t} * total) < abs(16 * upto - {t} * total) GROUP BY w.block, w.f)""")
    return ",\n".join(steps)


FREQUENCY = f"""
{SRC}, {NUM},
vc AS (SELECT block, f, feature, x, count(*) AS n FROM num GROUP BY ALL),
walk AS MATERIALIZED (
  SELECT block, f, feature, x, row_number() OVER w AS i, CAST(sum(n) OVER w AS BIGINT) AS upto,
    CAST(sum(n) OVER w - n AS BIGINT) AS before, lag(x) OVER w AS prev, CAST(sum(n) OVER (PARTITION BY block, f) AS BIGINT) AS total
  FROM vc WINDOW w AS (PARTITION BY block, f ORDER BY x)),
{walk_steps(15)},
block_cuts AS MATERIALIZED (
  SELECT block, f, feature, (prev + x) / 2 AS cut FROM walk
  JOIN ({" UNION ALL ".join(f"SELECT * FROM step{t}" for t in range(1, 16))}) USING (block, f, i)
  UNION SELECT block, f, feature, min(x) FROM walk GROUP BY ALL
  UNION SELECT block, f, feature, max(x) FROM walk GROUP BY ALL),
cuts AS MATERIALIZED (
  SELECT f, feature, row_number() OVER (PARTITION BY f ORDER BY cut) - 1 AS bin, cut
  FROM (SELECT DISTINCT f, feature, cut FROM block_cuts)),
vals AS (SELECT f, feature, x, cls, count(*) AS n FROM num GROUP BY ALL),
binned AS (SELECT v.f, v.x, count(c.cut) AS bin FROM (SELECT DISTINCT f, x FROM vals) v LEFT JOIN cuts c ON c.f = v.f AND c.cut < v.x GROUP BY ALL),
ct AS MATERIALIZED (
  SELECT f, feature, bin, cls AS label, CAST(sum(n) AS BIGINT) AS n FROM vals JOIN binned USING (f, x) GROUP BY ALL)"""
ORACLE["equi_frequency_cuts"] = f"WITH {FREQUENCY} SELECT CAST(block AS BIGINT) AS block, feature, round(cut, 6) AS cut FROM block_cuts"
ORACLE["merged_cuts"] = f"WITH {FREQUENCY} SELECT feature, bin, round(cut, 6) AS cut FROM cuts"
CT_OUT = "SELECT feature, CAST(bin AS BIGINT) AS bin, CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS n FROM ct"
ORACLE["contingency_width"] = f"WITH {WIDTH} {CT_OUT}"
ORACLE["contingency_freq"] = ORACLE["contingency_ranked"] = f"WITH {FREQUENCY} {CT_OUT}"

# Every searchable bin and class, zeros included.
GRID = """
tops AS (SELECT f, max(bin) AS top FROM cuts GROUP BY f),
grid AS MATERIALIZED (
  SELECT c.f, c.feature, c.bin, c.cut AS x, label, coalesce(n, 0) AS n
  FROM cuts c JOIN tops USING (f) CROSS JOIN (VALUES (0), (1), (2)) k(label) LEFT JOIN ct USING (f, bin, label) WHERE c.bin < top)"""
ORACLE["range_counts"] = f"""
WITH {WIDTH}, {GRID} SELECT feature, CAST(label AS BIGINT) AS label, CAST(coalesce(sum(n) FILTER (bin >= 5 AND bin < 20), 0) AS BIGINT) AS n
FROM grid GROUP BY feature, label"""
WHOLE = "seg0 AS MATERIALIZED (SELECT f, feature, 0 AS first, top AS last FROM cuts JOIN tops USING (f) GROUP BY ALL)"


def set_sums(seg: str) -> str:
    """Class sums of three sets for every middle position i of every segment."""
    return f"""
  SELECT s.f, s.feature, s.first, s.last, i, g.label, sum(g.n) AS nt, coalesce(sum(g.n) FILTER (g.bin < i), 0) AS nb,
    coalesce(sum(g.n * (1 - (g.x - mn.x) / (pk.x - mn.x))) FILTER (g.bin < i), 0) AS s0,
    coalesce(sum(CASE WHEN g.bin < i THEN g.n * ((g.x - mn.x) / (pk.x - mn.x)) ELSE g.n * (1 - (g.x - pk.x) / (mx.x - pk.x)) END), 0) AS s1,
    coalesce(sum(g.n * ((g.x - pk.x) / (mx.x - pk.x))) FILTER (g.bin >= i), 0) AS s2
  FROM {seg} s JOIN points mn ON mn.f = s.f AND mn.bin = s.first JOIN points mx ON mx.f = s.f AND mx.bin = s.last - 1
  JOIN points pk ON pk.f = s.f AND pk.bin > s.first AND pk.bin < s.last - 1 CROSS JOIN LATERAL (SELECT pk.bin + 1 AS i) AS mid
  JOIN grid g ON g.f = s.f AND g.bin >= s.first AND g.bin < s.last
  GROUP BY s.f, s.feature, s.first, s.last, i, g.label"""


POINTS = "points AS MATERIALIZED (SELECT DISTINCT f, bin, x FROM grid)"
TWO = """
  SELECT s.f, s.feature, s.first, s.last, g.label, sum(g.n) AS nt,
    sum(CASE WHEN mx.x > mn.x THEN g.n * (1 - (g.x - mn.x) / (mx.x - mn.x)) ELSE 0 END) AS t0,
    sum(CASE WHEN mx.x > mn.x THEN g.n * ((g.x - mn.x) / (mx.x - mn.x)) ELSE 0 END) AS t1
  FROM {seg} s JOIN points mn ON mn.f = s.f AND mn.bin = s.first JOIN points mx ON mx.f = s.f AND mx.bin = s.last - 1
  JOIN grid g ON g.f = s.f AND g.bin >= s.first AND g.bin < s.last GROUP BY s.f, s.feature, s.first, s.last, g.label"""
ORACLE["cardinality_two"] = f"""
WITH {WIDTH}, {GRID}, {POINTS}, {WHOLE} SELECT feature, CAST(label AS BIGINT) AS label, round(t0, 4) AS t0, round(t1, 4) AS t1
FROM ({TWO.format(seg="seg0")})"""
ORACLE["cardinality_three"] = f"""
WITH {WIDTH}, {GRID}, {POINTS}, {WHOLE} SELECT feature, {big('i').replace('AS i', 'AS bin')}, CAST(label AS BIGINT) AS label,
  round(s0, 4) AS s0, round(s1, 4) AS s1, round(s2, 4) AS s2 FROM ({set_sums("seg0")})"""


def search(levels: int, least: str = "0") -> str:
    """The entropy search, level by level; `least` is the fewest rows a side must exceed."""
    ctes = [GRID.strip(), POINTS, WHOLE]
    for v in range(levels):
        mass = {s: f"({xlogx(f'sum({s})')} - sum({xlogx(s)})) / {LN2}" for s in ("nt", "t0", "t1", "s0", "s1", "s2")}
        term = {s: f"count(*) FILTER ({s} > 0) * {bits(f'sum({s})', f'sum({xlogx(s)})')}" for s in ("s0", "s1", "s2")}
        prior = mass["nt"] if v == 0 else f"{mass['t0']} + {mass['t1']}"
        ctes.append(f"""prior{v} AS MATERIALIZED (
  SELECT f, first, last, sum(nt) AS total, count(*) FILTER (nt > 0) AS k, ({prior}) / sum(nt) AS prior
  FROM ({TWO.format(seg=f"seg{v}")}) GROUP BY f, first, last HAVING sum(nt) > 0 AND sum(nt) >= {least})""")
        ctes.append(f"""best{v} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY f, first ORDER BY round(ent, 12), i) AS place FROM (
    SELECT f, feature, first, last, i, sum(nb) AS nl, ({mass['s0']} + {mass['s1']} + {mass['s2']}) / sum(nt) AS ent,
      {term['s0']} + {term['s1']} + {term['s2']} AS term
    FROM ({set_sums(f"seg{v}")}) GROUP BY f, feature, first, last, i HAVING sum(nb) > {least} AND sum(nt) - sum(nb) > {least}))""")
        ctes.append(f"""core{v} AS MATERIALIZED (
  SELECT b.f, b.feature, b.first, b.last, i AS core, prior - ent AS gain FROM best{v} b JOIN prior{v} p ON p.f = b.f AND p.first = b.first
  WHERE place = 1 AND prior - ent > 0.000001::DOUBLE
    AND prior - ent >= (ln(total - 1.0::DOUBLE) / {LN2} + ln(3.0::DOUBLE ** k - 2) / {LN2} - (k * prior - term)) / total)""")
        ctes.append(f"""seg{v + 1} AS MATERIALIZED (
  SELECT f, feature, first, core AS last FROM core{v} UNION ALL SELECT f, feature, core, last FROM core{v})""")
    found = " UNION ALL ".join(f"SELECT f, feature, core FROM core{v}" for v in range(levels))
    ctes.append(f"""found AS ({found}),
listed AS MATERIALIZED (
  SELECT f, feature, row_number() OVER (PARTITION BY f ORDER BY cut) - 1 AS bin, cut AS core FROM (
    SELECT c.f, c.feature, c.cut FROM cuts c JOIN found ON found.f = c.f AND found.core = c.bin
    UNION SELECT c.f, c.feature, c.cut FROM cuts c JOIN (SELECT DISTINCT f FROM found) USING (f) JOIN tops USING (f) WHERE bin = 0 OR bin = top)),
cores AS (SELECT DISTINCT c.f, c.feature, l.bin, l.core FROM cuts c LEFT JOIN listed l ON l.f = c.f)""")
    return ",\n".join(ctes)


ORACLE["first_core"] = f"WITH {WIDTH}, {search(1)} SELECT feature, CAST(core AS BIGINT) AS core, round(gain, 6) AS gain FROM core0"
CORES_OUT = "SELECT feature, CAST(bin AS BIGINT) AS bin, round(core, 6) AS core FROM cores"
ORACLE["fuzzy_partition_width"] = f"WITH {WIDTH}, {search(8)} {CORES_OUT}"
ORACLE["fuzzy_partition_freq"] = f"""
WITH {FREQUENCY}, {search(8, "(SELECT floor(0.05::DOUBLE * count(*)) FROM lineitem)")} {CORES_OUT}"""
ORACLE["partition_stats"] = f"""
WITH {WIDTH}, {search(8)}, sized AS (SELECT feature, count(core) AS sets FROM cores GROUP BY feature)
SELECT CAST(sum(sets) AS BIGINT) AS total_sets, round(avg(sets), 6) AS average_sets, count(*) FILTER (sets = 0) AS discarded,
  (SELECT feature FROM sized ORDER BY sets DESC, feature LIMIT 1) AS most_feature, max(sets) AS most_sets,
  (SELECT feature FROM sized WHERE sets > 0 ORDER BY sets, feature LIMIT 1) AS fewest_feature, min(sets) FILTER (sets > 0) AS fewest_sets
FROM sized"""
ORACLE["partition_listing"] = """
SELECT feature, string_agg(CAST(b AS VARCHAR), ', ' ORDER BY b) AS listing
FROM (SELECT 'l_discount' AS feature, l_discount AS b FROM lineitem UNION SELECT 'l_tax', l_tax FROM lineitem) GROUP BY feature"""

# ---- statistics and splits of a node ---------------------------------------------------------

STATS = f"""
{FUZZY},
stats AS MATERIALIZED (SELECT f, bin, cls, sum(mu) AS u, count(*) AS freq FROM mus GROUP BY ALL)"""
ROOT = f"""
rootc AS (SELECT cls, sum(u) AS u, sum(freq) AS freq FROM stats WHERE f = 0 GROUP BY cls),
root AS MATERIALIZED (SELECT {bits('sum(u)', f"sum({xlogx('u')})")} AS e FROM rootc)"""
PER_BIN = f"""
per_bin AS MATERIALIZED (
  SELECT f, bin, floor(sum(u) + 0.000001::DOUBLE) AS w, {bits('sum(u)', f"sum({xlogx('u')})")} AS e, sum(u) AS t,
    coalesce(sum(u) FILTER (cls = 0), 0) AS u0, coalesce(sum(u) FILTER (cls = 1), 0) AS u1, coalesce(sum(u) FILTER (cls = 2), 0) AS u2
  FROM stats GROUP BY f, bin)"""
ORACLE["node_stats_root"] = f"""
WITH {STATS} SELECT CAST(f AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin, CAST(cls AS BIGINT) AS label, round(u, 3) AS u,
  CAST(freq AS BIGINT) AS freq FROM stats"""
ORACLE["node_predict_root"] = f"""
WITH {STATS}, {ROOT} SELECT round(e, 6) AS impurity, CAST(cls AS BIGINT) AS label, round(u, 3) AS u, CAST(freq AS DOUBLE) AS freq FROM rootc, root"""
GAIN = "any_value(root.e) - sum(per_bin.e * w) / sum(w)"
ORACLE["multi_gains"] = f"""
WITH {STATS}, {ROOT}, {PER_BIN} SELECT CAST(f AS BIGINT) AS feature,
  round(CASE WHEN sum(w) > 0 AND {GAIN} >= 0.000001::DOUBLE THEN {GAIN} END, 6) AS gain FROM per_bin, root GROUP BY f"""
ORACLE["best_split_multi"] = f"""
WITH {STATS}, {ROOT}, {PER_BIN}, gains AS (SELECT f, {GAIN} AS gain FROM per_bin, root GROUP BY f HAVING sum(w) > 0),
best AS (SELECT f, gain FROM gains WHERE gain >= 0.000001::DOUBLE ORDER BY round(gain, 12) DESC, f LIMIT 1)
SELECT name AS feature, round(gain, 6) AS gain, CAST(bin AS BIGINT) AS bin, round(u0 / t, 6) AS share0, round(u1 / t, 6) AS share1,
  round(u2 / t, 6) AS share2 FROM best JOIN per_bin USING (f) JOIN plan USING (f)"""
ORACLE["bin_plan"] = """
WITH c AS (
  SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS bins FROM lineitem
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer
  UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
  UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM nation)
SELECT feature, 'nominal' AS kind, bins, CASE WHEN bins <= 5 THEN 'unordered' ELSE 'ordered' END AS split_kind,
  CAST(CASE WHEN bins <= 5 THEN 2 * (2 ** (bins - 1) - 1) ELSE bins END AS BIGINT) AS slots,
  CAST(CASE WHEN bins <= 5 THEN 2 ** (bins - 1) - 1 ELSE bins - 1 END AS BIGINT) AS splits FROM c"""
SUBSETS = """
arity AS (SELECT count(DISTINCT o_orderpriority) AS n FROM orders),
codes AS (SELECT code, j, (code >> j) & 1 AS hit FROM range(1, 1000) a(code), range(20) b(j), arity WHERE code < 2 ** (n - 1) AND j < n)"""
ORACLE["subset_splits"] = f"""
WITH {SUBSETS} SELECT CAST(0 AS BIGINT) AS feature, code - 1 AS split, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j DESC) AS listing
FROM codes WHERE hit = 1 GROUP BY code"""
ORACLE["allowed_bins"] = f"""
WITH {SUBSETS} SELECT code - 1 AS split, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j DESC) FILTER (hit = 1) AS left,
  string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) FILTER (hit = 0) AS right FROM codes GROUP BY code"""


def sides(inside: str) -> str:
    """Gain of parting bins in two, from rows (f, split, bin, cls, u) and the condition for left."""
    left, right = f"sum(u) FILTER ({inside})", f"sum(u) FILTER (NOT ({inside}))"
    return f"""
  SELECT f, split, CASE WHEN g >= 0.000001::DOUBLE THEN g END AS gain FROM (
    SELECT f, split, any_value(root.e) - ({bits('sum(l)', f"sum({xlogx('l')})")} * floor(sum(l) + 0.000001::DOUBLE)
      + {bits('sum(r)', f"sum({xlogx('r')})")} * floor(sum(r) + 0.000001::DOUBLE))
      / (floor(sum(l) + 0.000001::DOUBLE) + floor(sum(r) + 0.000001::DOUBLE)) AS g
    FROM (SELECT f, split, cls, coalesce({left}, 0) AS l, coalesce({right}, 0) AS r FROM cand GROUP BY f, split, cls), root GROUP BY f, split)"""


NUMERIC_CAND = "cand AS (SELECT s.f, k AS split, bin, cls, u FROM stats s JOIN plan USING (f), range(4) t(k) WHERE s.f < 4)"
ORACLE["binary_split_numeric"] = f"""
WITH {STATS}, {ROOT}, {NUMERIC_CAND} SELECT CAST(f AS BIGINT) AS feature, CAST(split AS BIGINT) AS split,
  array_to_string(range(split + 1), ',') AS listing, round(gain, 6) AS gain FROM ({sides("bin <= split")})"""
ORACLE["binary_split_unordered"] = f"""
WITH {STATS}, {ROOT}, cand AS (
  SELECT s.f, code - 1 AS split, bin, cls, u FROM stats s JOIN plan USING (f), range(1, 4) t(code) WHERE s.f > 3 AND code < 2 ** (nb - 1))
SELECT CAST(f AS BIGINT) AS feature, CAST(split AS BIGINT) AS split,
  (SELECT string_agg(CAST(j AS VARCHAR), ',' ORDER BY j DESC) FROM range(5) t(j) WHERE ((split + 1) >> j) & 1 = 1) AS listing,
  round(gain, 6) AS gain FROM ({sides("((split + 1) >> bin) & 1 = 1")})"""
ORACLE["running_bins"] = f"""
WITH {STATS}, {NUMERIC_CAND}, dense AS (
  SELECT f, k AS split, c AS label FROM range(4) t(f), range(4) r(k), range(3) q(c))
SELECT CAST(d.f AS BIGINT) AS feature, d.split, CAST(d.label AS BIGINT) AS label,
  round(coalesce(sum(u) FILTER (bin <= d.split), 0), 3) AS l_u, CAST(coalesce(sum(freq) FILTER (bin <= d.split), 0) AS BIGINT) AS l_freq,
  round(coalesce(sum(u) FILTER (bin > d.split), 0), 3) AS r_u, CAST(coalesce(sum(freq) FILTER (bin > d.split), 0) AS BIGINT) AS r_freq
FROM dense d LEFT JOIN stats s ON s.f = d.f AND s.cls = d.label GROUP BY d.f, d.split, d.label"""


def customers(label: str) -> str:
    return f"""
rows_ AS (SELECT {label} AS cls, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment, c_nationkey FROM customer),
stats AS MATERIALIZED (
  SELECT 0 AS f, segment AS bin, cls, CAST(count(*) AS DOUBLE) AS u FROM rows_ GROUP BY ALL
  UNION ALL SELECT 1, c_nationkey, cls, CAST(count(*) AS DOUBLE) FROM rows_ GROUP BY ALL),
rootc AS (SELECT cls, sum(u) AS u FROM stats WHERE f = 0 GROUP BY cls),
root AS MATERIALIZED (SELECT {bits('sum(u)', f"sum({xlogx('u')})")} AS e FROM rootc),
bins AS (SELECT 0 AS f, k AS bin FROM range(5) t(k) UNION ALL SELECT 1, k FROM range(25) t(k)),
per_bin AS MATERIALIZED (
  SELECT b.f, b.bin, coalesce(sum(u), 0) AS t, {bits('coalesce(sum(u), 0)', f"coalesce(sum({xlogx('coalesce(u, 0)')}), 0)")} AS e,
    coalesce(sum(u) FILTER (cls = 0), 0) AS u0, coalesce(sum(u) FILTER (cls = 1), 0) AS u1
  FROM bins b LEFT JOIN stats s ON s.f = b.f AND s.bin = b.bin GROUP BY b.f, b.bin)"""


ORACLE["binary_split_ordered"] = f"""
WITH {customers("CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END")},
ranked AS MATERIALIZED (
  SELECT f, bin, row_number() OVER (PARTITION BY f ORDER BY CASE WHEN t < 1 THEN 2 WHEN u1 > u0 THEN 1 ELSE 0 END, bin) - 1 AS rank FROM per_bin),
cand AS (SELECT s.f, k AS split, rank, cls, u FROM stats s JOIN ranked USING (f, bin), range(24) t(k) WHERE k < CASE s.f WHEN 0 THEN 4 ELSE 24 END)
SELECT CAST(f AS BIGINT) AS feature, split,
  (SELECT string_agg(CAST(bin AS VARCHAR), ',' ORDER BY rank) FROM ranked r WHERE r.f = z.f AND r.rank <= z.split) AS listing,
  round(gain, 6) AS gain FROM ({sides("rank <= split")}) z"""
ORACLE["order_categories"] = f"""
WITH {customers("CASE WHEN c_acctbal < 1000 THEN 0 WHEN c_acctbal < 6000 THEN 1 ELSE 2 END")}
SELECT CAST(0 AS BIGINT) AS feature, CAST(bin AS BIGINT) AS bin,
  row_number() OVER (ORDER BY CASE WHEN t < 1 THEN 1 ELSE 0 END, round(e, 12), bin) - 1 AS rank FROM per_bin WHERE f = 1"""

# ---- trees -----------------------------------------------------------------------------------

U = ("coalesce(sum(u) FILTER (cls = 0), 0) AS u0, coalesce(sum(u) FILTER (cls = 1), 0) AS u1, "
     "coalesce(sum(u) FILTER (cls = 2), 0) AS u2, coalesce(sum(freq), 0) AS freq")
MEASURES = f"{bits('sum(u)', f'sum({xlogx(chr(117))})')} AS e, {U}"
PURE = "greatest(u0, u1, u2) / (u0 + u1 + u2) >= 1"
NODE_OUT = (
    "CAST(node AS BIGINT) AS node_id, CAST(parent AS BIGINT) AS parent_id, CAST(level AS BIGINT) AS level, "
    "CAST(f AS BIGINT) AS split_feature, leaf AS is_leaf, round(gain, 6) AS gain, round(e, 6) AS impurity, "
    "CAST(freq AS DOUBLE) AS freq, round(u0, 3) AS u0, round(u1, 3) AS u1, round(u2, 3) AS u2"
)
NODE_COLUMNS = "node, parent, level, path, e, u0, u1, u2, freq"


def multi_tree(depth: int) -> str:
    """All nodes of a multi-way tree as `nodes`, and `fired0`.. with the nodes each row reaches per level."""
    ctes = ["fired0 AS MATERIALIZED (SELECT rid, cls, 1 AS node, 1.0::DOUBLE AS act FROM src)"]
    parts = []
    for v in range(depth):
        used = "" if v == 0 else f"JOIN open{v} o ON o.node = x.node AND NOT list_contains(o.used, m.f)"
        ctes.append(f"""st{v} AS MATERIALIZED (
  SELECT x.node, m.f, m.bin, m.cls, sum(x.act * m.mu) AS u, count(*) AS freq FROM fired{v} x JOIN mus m ON m.rid = x.rid {used} GROUP BY ALL)""")
        if v == 0:
            ctes.append(f"""open0 AS MATERIALIZED (
  SELECT 1 AS node, 0 AS parent, 0 AS level, '' AS path, CAST([] AS INTEGER[]) AS used, {MEASURES}
  FROM (SELECT cls, sum(u) AS u, sum(freq) AS freq FROM st0 WHERE f = 0 GROUP BY cls))""")
        start = "2" if v == 0 else f"(SELECT max(node) + 1 FROM ch{v - 1})"
        ctes.append(f"""pb{v} AS MATERIALIZED (SELECT node, f, bin, floor(sum(u) + 0.000001::DOUBLE) AS w, {MEASURES} FROM st{v} GROUP BY node, f, bin),
ga{v} AS (SELECT p.node, p.f, any_value(o.e) - sum(p.e * w) / sum(w) AS gain FROM pb{v} p JOIN open{v} o USING (node) GROUP BY p.node, p.f HAVING sum(w) > 0),
be{v} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, f) AS place FROM ga{v} WHERE gain >= 0.000001::DOUBLE),
de{v} AS MATERIALIZED (
  SELECT o.*, b.f, b.gain, (b.f IS NULL OR b.gain <= 0 OR {PURE}) AS leaf FROM open{v} o LEFT JOIN be{v} b ON b.node = o.node AND place = 1),
sp{v} AS MATERIALIZED (
  SELECT d.*, nb, name, {start} + coalesce(sum(nb) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM de{v} d JOIN plan USING (f) WHERE NOT leaf),
ch{v} AS MATERIALIZED (
  SELECT *, ({v + 1} = {depth} OR e <= 0 OR freq <= 1 OR u0 + u1 + u2 <= 0) AS leaf FROM (
    SELECT s.first + k AS node, s.node AS parent, {v + 1} AS level,
      concat(CASE WHEN s.path = '' THEN '' ELSE concat(s.path, ' and ') END, name, ' = ', k) AS path, list_append(s.used, s.f) AS used,
      coalesce(p.e, 0) AS e, coalesce(p.u0, 0) AS u0, coalesce(p.u1, 0) AS u1, coalesce(p.u2, 0) AS u2, coalesce(p.freq, 0) AS freq
    FROM sp{v} s JOIN range(5) t(k) ON k < nb LEFT JOIN pb{v} p ON p.node = s.node AND p.f = s.f AND p.bin = k)),
open{v + 1} AS MATERIALIZED (SELECT {NODE_COLUMNS.replace("path", "path, used")} FROM ch{v} WHERE NOT leaf),
fired{v + 1} AS MATERIALIZED (
  SELECT x.rid, x.cls, s.first + m.bin AS node, x.act * m.mu AS act FROM fired{v} x JOIN sp{v} s ON s.node = x.node JOIN mus m ON m.rid = x.rid AND m.f = s.f)""")
        parts.append(f"SELECT {NODE_COLUMNS}, CASE WHEN leaf THEN NULL ELSE f END AS f, CASE WHEN leaf THEN NULL ELSE gain END AS gain, leaf FROM de{v}")
        parts.append(f"SELECT {NODE_COLUMNS}, NULL, NULL, leaf FROM ch{v} WHERE leaf")
    ctes.append(f"nodes AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    return ",\n".join(ctes)


def confidences(levels: list[str]) -> str:
    """Class confidences of every row from the leaves it reached in the given tables of (rid, node, act)."""
    reached = " UNION ALL ".join(f"SELECT rid, node, act FROM {t}" for t in levels)
    share = ", ".join(
        f"sum(act * CASE WHEN u0 + u1 + u2 > 0 THEN u{j} / (u0 + u1 + u2) ELSE 0 END) AS score{j}" for j in range(3)
    )
    later = "round(score{}, 12) >= round(score{}, 12)"
    return f"""
sums AS (SELECT rid, {share} FROM ({reached}) JOIN (SELECT * FROM nodes WHERE leaf) USING (node) GROUP BY rid),
scored AS MATERIALIZED (
  SELECT src.*, score0, score1, score2, CASE WHEN score0 IS NULL THEN -1
    WHEN {later.format(2, 1)} AND {later.format(2, 0)} THEN 2 WHEN {later.format(1, 0)} THEN 1 ELSE 0 END AS prediction
  FROM src LEFT JOIN sums USING (rid))"""


DEPTH = 3
MULTI = f"{FUZZY}, {multi_tree(DEPTH)}"
MULTI_SCORED = f"{MULTI}, {confidences([f'fired{v}' for v in range(DEPTH + 1)])}"
SCORES_OUT = (
    f"{KEY_OUT}, round(score0, 6) AS score0, round(score1, 6) AS score1, round(score2, 6) AS score2, "
    "CAST(prediction AS BIGINT) AS prediction"
)
ORACLE["multi_tree_nodes"] = f"WITH {MULTI} SELECT {NODE_OUT} FROM nodes"
ORACLE["multi_scores"] = f"WITH {MULTI_SCORED} SELECT {SCORES_OUT} FROM scored"
ORACLE["multi_scores_staged"] = f"WITH {MULTI_SCORED} " + " UNION ALL ".join(
    f"SELECT {KEY_OUT}, CAST({j} AS BIGINT) AS label, round(score{j}, 6) AS score FROM scored" for j in range(3)
)


def binary_tree(depth: int, minimum: bool = False) -> str:
    """All nodes of a binary tree as `nodes`, and its splits as `sp0`.. per level."""

    def norm(x: str, y: str) -> str:
        return f"least({x}, {y})" if minimum else f"{x} * {y}"

    ctes = [
        "fired0 AS MATERIALIZED (SELECT rid, cls, 1 AS node, 1.0::DOUBLE AS act, CAST([] AS INTEGER[]) AS crossed FROM src)",
        "al0 AS MATERIALIZED (SELECT 0 AS node, 0 AS f, CAST([] AS BIGINT[]) AS bins WHERE false)",
    ]
    parts = []
    for v in range(depth):
        only = "" if v == 0 else f"JOIN open{v} o ON o.node = x.node"
        ctes.append(f"""st{v} AS MATERIALIZED (
  SELECT x.node, m.f, m.bin, m.cls, sum({norm("x.act", "CASE WHEN a.bins IS NULL THEN m.mu ELSE 1.0::DOUBLE END")}) AS u, count(*) AS freq
  FROM fired{v} x {only} JOIN mus m ON m.rid = x.rid LEFT JOIN al{v} a ON a.node = x.node AND a.f = m.f
  WHERE a.bins IS NULL OR list_contains(a.bins, m.bin) GROUP BY ALL)""")
        if v == 0:
            ctes.append(f"""open0 AS MATERIALIZED (
  SELECT 1 AS node, 0 AS parent, 0 AS level, '' AS path, {MEASURES}
  FROM (SELECT cls, sum(u) AS u, sum(freq) AS freq FROM st0 WHERE f = 0 GROUP BY cls))""")

        def side(s: str) -> str:
            measure = bits(f"sum({s}u)", f"sum({xlogx(s + 'u')})")
            each = ", ".join(f"coalesce(sum({s}u) FILTER (cls = {j}), 0) AS {s}{j}" for j in range(3))
            return f"{measure} AS {s}e, floor(sum({s}u) + 0.000001::DOUBLE) AS {s}w, sum({s}f) AS {s}freq, {each}"

        ctes.append(f"""us{v} AS MATERIALIZED (
  SELECT o.node, p.f, p.nb, coalesce(a.bins, range(p.nb)) AS bins FROM open{v} o CROSS JOIN plan p LEFT JOIN al{v} a ON a.node = o.node AND a.f = p.f),
ca{v} AS MATERIALIZED (
  SELECT node, f, k AS split, list_filter(bins, lambda b: b <= k) AS lb FROM us{v}, range(5) t(k) WHERE f < 4 AND list_contains(bins, k) AND k < list_max(bins)
  UNION ALL SELECT node, f, code - 1, lb FROM (
    SELECT node, f, bins, code, list_reverse_sort(list_filter(range(nb), lambda b: (code >> b) & 1 = 1)) AS lb FROM us{v}, range(1, 8) t(code) WHERE f > 3 AND code < 2 ** (nb - 1))
  WHERE list_has_all(bins, lb) AND len(lb) < len(bins)),
si{v} AS (
  SELECT c.node, c.f, c.split, c.lb, s.cls, coalesce(sum(u) FILTER (list_contains(lb, s.bin)), 0) AS lu, coalesce(sum(u) FILTER (NOT list_contains(lb, s.bin)), 0) AS ru,
    coalesce(sum(freq) FILTER (list_contains(lb, s.bin)), 0) AS lf, coalesce(sum(freq) FILTER (NOT list_contains(lb, s.bin)), 0) AS rf
  FROM ca{v} c JOIN st{v} s ON s.node = c.node AND s.f = c.f GROUP BY c.node, c.f, c.split, c.lb, s.cls),
ga{v} AS (SELECT node, f, split, lb, {side("l")}, {side("r")} FROM si{v} GROUP BY node, f, split, lb),
be{v} AS (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, f, split) AS place FROM (
    SELECT g.*, o.e - (le * lw + re * rw) / (lw + rw) AS gain FROM ga{v} g JOIN open{v} o USING (node) WHERE lw + rw > 0) WHERE gain >= 0.000001::DOUBLE),
de{v} AS MATERIALIZED (
  SELECT o.*, b.* EXCLUDE (node, place), (b.f IS NULL OR b.gain <= 0 OR {PURE}) AS leaf FROM open{v} o LEFT JOIN be{v} b ON b.node = o.node AND place = 1),
sp{v} AS MATERIALIZED (SELECT * FROM de{v} WHERE NOT leaf),
ch{v} AS MATERIALIZED (
  SELECT *, ({v + 1} = {depth} OR e <= 0 OR freq < 1 OR u0 + u1 + u2 <= 0) AS leaf FROM (
    SELECT 2 * node AS node, node AS parent, {v + 1} AS level, '' AS path, le AS e, l0 AS u0, l1 AS u1, l2 AS u2, lfreq AS freq FROM sp{v}
    UNION ALL SELECT 2 * node + 1, node, {v + 1}, '', re, r0, r1, r2, rfreq FROM sp{v})),
open{v + 1} AS MATERIALIZED (SELECT {NODE_COLUMNS} FROM ch{v} WHERE NOT leaf),
al{v + 1} AS MATERIALIZED (
  SELECT 2 * s.node + side AS node, a.f, a.bins FROM sp{v} s JOIN al{v} a ON a.node = s.node AND a.f <> s.f, range(2) t(side)
  UNION ALL SELECT 2 * s.node, s.f, s.lb FROM sp{v} s
  UNION ALL SELECT 2 * s.node + 1, s.f, list_filter(u.bins, lambda b: NOT list_contains(s.lb, b)) FROM sp{v} s JOIN us{v} u ON u.node = s.node AND u.f = s.f),
hi{v} AS MATERIALIZED (
  SELECT x.rid, x.cls, x.node, x.act, x.crossed, s.f, count(*) AS fired, count(*) FILTER (list_contains(s.lb, m.bin)) AS inside,
    coalesce(sum(m.mu) FILTER (list_contains(s.lb, m.bin)), 0) AS lmu, coalesce(sum(m.mu) FILTER (NOT list_contains(s.lb, m.bin)), 0) AS rmu
  FROM fired{v} x JOIN sp{v} s ON s.node = x.node JOIN mus m ON m.rid = x.rid AND m.f = s.f GROUP BY ALL),
fired{v + 1} AS MATERIALIZED (
  SELECT rid, cls, 2 * node + side AS node,
    CASE WHEN inside IN (0, fired) OR list_contains(crossed, f) THEN act WHEN side = 0 THEN {norm("act", "lmu")} ELSE {norm("act", "rmu")} END AS act,
    CASE WHEN inside IN (0, fired) OR list_contains(crossed, f) THEN crossed ELSE list_append(crossed, f) END AS crossed
  FROM hi{v}, range(2) t(side) WHERE (side = 0 AND inside > 0) OR (side = 1 AND inside < fired))""")
        parts.append(f"SELECT {NODE_COLUMNS}, CASE WHEN leaf THEN NULL ELSE f END AS f, CASE WHEN leaf THEN NULL ELSE gain END AS gain, leaf, CASE WHEN leaf THEN NULL ELSE lb END AS lb FROM de{v}")
        parts.append(f"SELECT {NODE_COLUMNS}, NULL, NULL, leaf, NULL FROM ch{v} WHERE leaf")
    ctes.append(f"nodes AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    return ",\n".join(ctes)


def binary_paths(depth: int) -> str:
    """Scoring routes: `go0`.. with what each row remembers per column (-2 nothing, -1 the right side)."""
    ctes = ["go0 AS MATERIALIZED (SELECT rid, 1 AS node, 1.0::DOUBLE AS act, CAST([-2, -2, -2, -2, -2, -2] AS BIGINT[]) AS mem FROM src)"]
    for v in range(depth):
        note = "list_concat(list_concat(mem[1:f], [{}]), mem[f + 2:6])"
        ctes.append(f"""at{v} AS MATERIALIZED (
  SELECT *, mem[f + 1] AS known, round(coalesce(s, 0), 12) AS deg FROM (
    SELECT x.rid, x.node, x.act, x.mem, p.f, p.lb, sum(m.mu) FILTER (list_contains(p.lb, m.bin)) AS s, max(m.bin) FILTER (list_contains(p.lb, m.bin)) AS top
    FROM go{v} x JOIN sp{v} p ON p.node = x.node JOIN mus m ON m.rid = x.rid AND m.f = p.f GROUP BY ALL)),
go{v + 1} AS MATERIALIZED (
  SELECT rid, 2 * node AS node, CASE WHEN known = -2 AND deg < 1 THEN act * deg ELSE act END AS act,
    CASE WHEN (known = -2 AND deg < 1) OR known = -1 THEN {note.format("top")} ELSE mem END AS mem
  FROM at{v} WHERE (known < 0 AND deg > 0) OR (known >= 0 AND list_contains(lb, known))
  UNION ALL
  SELECT rid, 2 * node + 1, CASE WHEN known = -2 AND deg > 0 THEN act * (1 - deg) ELSE act END,
    CASE WHEN known = -2 AND deg > 0 THEN {note.format("-1")} ELSE mem END
  FROM at{v} WHERE (known = -2 AND deg < 1) OR (known = -1 AND deg = 0) OR (known >= 0 AND NOT list_contains(lb, known)))""")
    return ",\n".join(ctes)


LISTING = "array_to_string(lb, ',') AS listing"
ORACLE["binary_tree_nodes"] = f"WITH {FUZZY}, {binary_tree(DEPTH)} SELECT {NODE_OUT}, {LISTING} FROM nodes"
ORACLE["binary_tree_nodes_min"] = f"WITH {FUZZY}, {binary_tree(DEPTH, True)} SELECT {NODE_OUT}, {LISTING} FROM nodes"
BINARY_SCORED = f"{FUZZY}, {binary_tree(DEPTH)}, {binary_paths(DEPTH)}, {confidences([f'go{v}' for v in range(DEPTH + 1)])}"
ORACLE["binary_scores"] = f"WITH {BINARY_SCORED} SELECT {SCORES_OUT} FROM scored"
ORACLE["binary_scores_staged"] = f"WITH {BINARY_SCORED} " + " UNION ALL ".join(
    f"SELECT {KEY_OUT}, CAST({j} AS BIGINT) AS label, round(score{j}, 6) AS score FROM scored" for j in range(3)
)
ORACLE["tree_rules"] = f"""
WITH {MULTI} SELECT path AS rule, round(u0 + u1 + u2, 3) AS u, CAST(freq AS DOUBLE) AS freq FROM nodes WHERE leaf AND freq > 0"""
SIZES = """
count(*) FILTER ({filled} OR level = 0) AS nodes, count(*) FILTER (leaf AND freq > 0) AS leaves, CAST(max(level) AS BIGINT) AS max_depth,
CAST(min(level) FILTER (leaf) AS BIGINT) AS min_depth, round(avg(level) FILTER (leaf AND {filled}), 6) AS avg_depth FROM nodes"""
ORACLE["tree_stats"] = f"WITH {MULTI} SELECT {SIZES.format(filled='freq > 0')}"
ORACLE["tree_stats_binary"] = f"WITH {FUZZY}, {binary_tree(DEPTH)} SELECT {SIZES.format(filled='true')}"

# ---- evaluation ------------------------------------------------------------------------------

MATRIX = """
matrix AS MATERIALIZED (
  SELECT l AS label, p AS prediction, count(rid) AS n FROM range(3) a(l) CROSS JOIN range(3) b(p)
  LEFT JOIN scored ON cls = l AND scored.prediction = p GROUP BY l, p),
recalls AS (SELECT label, sum(n) FILTER (label = prediction) / CAST(sum(n) AS DOUBLE) AS recall FROM matrix GROUP BY label)"""
ACCURACY = "sum(n) FILTER (label = prediction) / CAST(sum(n) AS DOUBLE)"
MEASURED = f"""
measured AS (SELECT (SELECT {ACCURACY} FROM matrix) AS accuracy, product(recall) ** (1.0::DOUBLE / 3) AS geometric_mean,
  avg(recall) AS mean_recall FROM recalls)"""
ORACLE["confusion_matrix"] = f"WITH {MULTI_SCORED}, {MATRIX} SELECT label, prediction, n FROM matrix"
ORACLE["accuracy_stats"] = f"""
WITH {MULTI_SCORED}, {MATRIX}, {MEASURED} SELECT round(accuracy, 6) AS accuracy, round(geometric_mean, 6) AS geometric_mean,
  round(mean_recall, 6) AS mean_recall FROM measured"""
ORACLE["accuracy_report"] = f"""
WITH {MULTI_SCORED}, {MATRIX}, {MEASURED} SELECT 'Accuracy rate' AS measure, round(accuracy, 6) AS value FROM measured
UNION ALL SELECT 'Geometric mean', round(geometric_mean, 6) FROM measured
UNION ALL SELECT 'Avg. accuracy per class', round(mean_recall, 6) FROM measured"""
ORACLE["confusion_report"] = f"""
WITH {MULTI_SCORED}, {MATRIX} SELECT label, {", ".join(f"CAST(sum(n) FILTER (prediction = {j}) AS BIGINT) AS p{j}" for j in range(3))}
FROM matrix GROUP BY label"""
ORACLE["error_rate"] = f"""
WITH {MULTI_SCORED} SELECT round(avg(CASE WHEN cls <> prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS error_rate FROM scored"""
ORACLE["model_summary"] = f"""
WITH {MULTI}, sizes AS (SELECT {SIZES.format(filled='freq > 0')})
SELECT measure, CAST(value AS DOUBLE) AS value FROM (
  VALUES ('Fuzzy sets', 20), ('Fuzzy sets per numeric feature', 5), ('Discarded features', 0), ('Most fuzzy sets of a feature', 5),
    ('Fewest fuzzy sets of a kept feature', 5)) s(measure, value)
UNION ALL SELECT 'Nodes', CAST(nodes AS DOUBLE) FROM sizes UNION ALL SELECT 'Leaves', CAST(leaves AS DOUBLE) FROM sizes
UNION ALL SELECT 'Maximum depth', CAST(max_depth AS DOUBLE) FROM sizes UNION ALL SELECT 'Minimum depth', CAST(min_depth AS DOUBLE) FROM sizes
UNION ALL SELECT 'Average depth', avg_depth FROM sizes"""
ORACLE["examples_round_trip"] = f"""
WITH {SRC} SELECT CAST(cls AS BIGINT) AS cls, count(*) AS n,
  {", ".join(f"round(sum({c}), 2) AS sum_{c}" for c in NUMERIC)}, CAST(sum(flag) AS BIGINT) AS sum_l_returnflag,
  CAST(sum(status) AS BIGINT) AS sum_l_linestatus, CAST(0 AS BIGINT) AS sum_year_digits FROM src GROUP BY cls"""
ORACLE["rejected_lines"] = """
SELECT CASE WHEN l_orderkey % 7 = 0 THEN '2 fields instead of 3' WHEN l_orderkey % 5 = 0 THEN 'quantity: not a number'
  ELSE 'read, flag ' || l_returnflag END AS outcome, count(*) AS n,
  round(sum(CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 5 = 0 THEN 0.0 ELSE CAST(l_quantity AS DOUBLE) END), 2) AS quantity
FROM lineitem GROUP BY 1"""
# The study: the fuzzy sets lie evenly on [0, 1] and are met by the scaled values.
UNIT_SETS = """
cores AS (SELECT f, k AS bin, k * 0.25::DOUBLE AS b FROM range(4) a(f), range(5) t(k)),
sets AS MATERIALIZED (SELECT f, bin, lag(b) OVER w AS a, b, lead(b) OVER w AS c FROM cores WINDOW w AS (PARTITION BY f ORDER BY b)),
scaled_num AS MATERIALIZED (SELECT rid, cls, f, y AS x FROM num JOIN scaled USING (f, x))"""
STUDY = (
    f"{quantiles(100)}, {SEGMENTS}, {UNIT_SETS}, "
    f"{MUS.replace('num.f', 'scaled_num.f').replace('FROM num JOIN', 'FROM scaled_num JOIN')}, {PLAN}, {multi_tree(2)}"
)
ORACLE["fit_and_evaluate_nodes"] = f"WITH {STUDY} SELECT {NODE_OUT} FROM nodes"
ORACLE["fit_and_evaluate_confusion"] = f"""
WITH {STUDY}, {confidences([f"fired{v}" for v in range(3)])}, {MATRIX} SELECT label, prediction, n FROM matrix"""
