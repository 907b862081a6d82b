"""Registered queries of screens over many sets of uneven size in one plan, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.plans import standins

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def core_sql(p: str, subsets: str) -> str:
    """CTEs {p}h (homologs), {p}r (anchor), {p}c (core items) and {p}s (core sizes) of the subsets (k, sid, grp)."""
    return f"""
{p}n AS (SELECT k, sid, count(*) AS n FROM {subsets} GROUP BY k, sid),
{p}h AS (
  SELECT u.k, u.sid, u.grp, coalesce(c.c, 0) AS homologs FROM {subsets} u LEFT JOIN (
    SELECT k, sid, grp, count(*) AS c FROM (
      SELECT a.k, a.sid, a.grp, hf.item, count(DISTINCT hf.other) AS m FROM hf
      JOIN {subsets} a ON a.k = hf.k AND a.grp = hf.grp JOIN {subsets} b ON b.k = a.k AND b.sid = a.sid AND b.grp = hf.other GROUP BY ALL)
    JOIN {p}n USING (k, sid) WHERE m = n - 1 GROUP BY k, sid, grp) c ON c.k = u.k AND c.sid = u.sid AND c.grp = u.grp),
{p}r AS (
  SELECT k, sid, grp AS ref, homologs FROM (SELECT *, row_number() OVER (PARTITION BY k, sid ORDER BY homologs, CAST(grp AS VARCHAR)) AS j FROM {p}h) WHERE j = 1),
{p}c AS (
  SELECT k, sid, ref, item FROM (
    SELECT r.k, r.sid, r.ref, q.item, count(DISTINCT q.other) AS m FROM {p}r r
    JOIN partner q ON q.k = r.k AND q.grp = r.ref JOIN {subsets} b ON b.k = r.k AND b.sid = r.sid AND b.grp = q.other GROUP BY ALL)
  JOIN {p}n USING (k, sid) WHERE m = n - 1
  UNION ALL SELECT r.k, r.sid, r.ref, i.item FROM {p}r r JOIN {p}n USING (k, sid) JOIN items i ON i.k = r.k AND i.grp = r.ref WHERE n = 1),
{p}s AS (
  SELECT r.k, r.sid, r.ref, coalesce(c.c, 0) AS core_size FROM {p}r r LEFT JOIN (SELECT k, sid, count(*) AS c FROM {p}c GROUP BY k, sid) c ON c.k = r.k AND c.sid = r.sid)
"""


#: The screen of all sets (k): the same rules as for one set, with the set in every key.
SETS = f"""
WITH RECURSIVE items AS MATERIALIZED (SELECT {standins.VECTOR_SET} AS k, vec_id AS item, CAST(label AS BIGINT) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
groups AS MATERIALIZED (SELECT DISTINCT k, grp FROM items),
kept AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.k, a.item AS q, b.item AS s, a.grp AS gq, b.grp AS gs, 50 * (1 + list_cosine_similarity(a.v, b.v)) AS pident
    FROM items a JOIN items b ON a.k = b.k AND a.grp <> b.grp) WHERE pident >= {standins.MIN_HIT}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, q, gs ORDER BY pident DESC, s) AS n FROM kept) WHERE n = 1),
rbh AS MATERIALIZED (
  SELECT x.k, x.gq AS ga, x.gs AS gb, x.q AS l, x.s AS r, (x.pident + y.pident) / 2 AS ident
  FROM best x JOIN best y ON x.k = y.k AND x.q = y.s AND x.s = y.q WHERE x.gq < x.gs),
partner AS MATERIALIZED (
  SELECT k, l AS item, ga AS grp, gb AS other, r AS mate FROM rbh WHERE ident >= 60 UNION ALL SELECT k, r, gb, ga, l FROM rbh WHERE ident >= 60),
aai AS (SELECT k, ga, gb, avg(ident) AS aai, count(*) AS shared FROM rbh GROUP BY k, ga, gb),
half AS MATERIALIZED (
  SELECT a.k, a.grp AS ga, b.grp AS gb, aai, coalesce(shared, 0) AS shared FROM groups a JOIN groups b ON a.k = b.k AND a.grp < b.grp
  LEFT JOIN aai m ON m.k = a.k AND m.ga = a.grp AND m.gb = b.grp),
matrix AS MATERIALIZED (
  SELECT * FROM half UNION ALL SELECT k, gb, ga, aai, shared FROM half UNION ALL SELECT k, grp, grp, 100.0, 0 FROM groups),
hf AS MATERIALIZED (SELECT DISTINCT k, s AS item, gs AS grp, gq AS other FROM kept),
big AS (SELECT k FROM groups GROUP BY k HAVING count(*) > 2),
subsets AS MATERIALIZED (
  SELECT k, CAST(-1 AS BIGINT) AS sid, grp FROM groups
  UNION ALL SELECT a.k, a.grp, b.grp FROM groups a JOIN big USING (k) JOIN groups b ON a.k = b.k AND a.grp <> b.grp),
{core_sql('x', 'subsets')},
loo AS (
  SELECT a.k, a.sid AS excluded, a.core_size, a.core_size - b.core_size AS change, b.core_size AS baseline
  FROM xs a JOIN xs b ON a.k = b.k WHERE a.sid >= 0 AND b.sid = -1),
pres AS MATERIALIZED (
  SELECT i.k, i.item AS ref_item, g.grp, CAST(g.grp = r.ref OR EXISTS (
    SELECT 1 FROM partner p WHERE p.k = i.k AND p.item = i.item AND p.other = g.grp) AS BIGINT) AS present
  FROM xr r JOIN items i ON i.k = r.k AND i.grp = r.ref JOIN groups g ON g.k = r.k WHERE r.sid = -1),
near AS (
  SELECT k, ga AS grp, CASE WHEN aai IS NOT NULL THEN gb END AS nearest, aai, CASE WHEN aai IS NULL THEN 0 ELSE shared END AS shared
  FROM (SELECT *, row_number() OVER (PARTITION BY k, ga ORDER BY aai DESC NULLS LAST, gb) AS j FROM matrix WHERE ga <> gb) WHERE j = 1),
spec AS (
  SELECT *, CASE WHEN aai IS NULL THEN 'no orthologs' WHEN aai >= 95 THEN 'same species' WHEN aai >= 80 THEN 'same genus, different species'
      WHEN aai >= 65 THEN 'same genus, divergent' ELSE 'likely different genus' END AS reading,
    CASE WHEN aai IS NULL OR aai < 65 THEN 'CANDIDATE NOVEL TAXON'
      WHEN gain = best AND best > 0 AND gain >= greatest(1, baseline) AND aai < 95 THEN 'REVIEW - collapses the shared core'
      WHEN aai < 80 THEN 'distinct species within the genus' WHEN aai < 95 THEN 'distinct species' ELSE 'consistent with the group' END AS verdict
  FROM (SELECT n.*, coalesce(l.change, 0) AS gain, coalesce(l.baseline, 0) AS baseline, coalesce((SELECT max(change) FROM loo WHERE loo.k = n.k), 0) AS best
        FROM near n LEFT JOIN loo l ON l.k = n.k AND l.excluded = n.grp)),
st(k, step, grp, bin, l, bi, bj) AS (
  SELECT k, CAST(0 AS BIGINT), grp, grp, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM groups
  UNION ALL
  SELECT s.k, s.step + 1, s.grp, CASE WHEN s.bin = m.bj THEN m.bi ELSE s.bin END, m.l, m.bi, m.bj
  FROM st s JOIN (
    SELECT k, bi, bj, l FROM (
      SELECT k, bi, bj, l, row_number() OVER (PARTITION BY k ORDER BY l DESC, bi, bj) AS j FROM (
        SELECT x.k, x.bin AS bi, y.bin AS bj, min(coalesce(h.aai, -1e308)) AS l
        FROM st x JOIN st y ON x.k = y.k AND x.bin < y.bin
        LEFT JOIN half h ON h.k = x.k AND h.ga = least(x.grp, y.grp) AND h.gb = greatest(x.grp, y.grp)
        GROUP BY x.k, x.bin, y.bin) WHERE l >= 65.0) WHERE j = 1) m ON m.k = s.k),
final AS (SELECT s.k, s.grp, s.bin AS low FROM st s JOIN (SELECT k, max(step) AS step FROM st GROUP BY k) z ON z.k = s.k AND z.step = s.step),
binned AS MATERIALIZED (
  SELECT f.k, f.grp, b.bin AS sid FROM final f JOIN (
    SELECT k, low, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, low) AS bin FROM final GROUP BY k, low) b ON b.k = f.k AND b.low = f.low),
{core_sql('b', 'binned')},
bins AS (
  SELECT s.k, s.sid AS bin, n.n AS size, s.ref, s.core_size, (SELECT string_agg(CAST(grp AS VARCHAR), ' ' ORDER BY grp) FROM binned m WHERE m.k = s.k AND m.sid = s.sid) AS members, p.lo, p.mean
  FROM bs s JOIN bn n ON n.k = s.k AND n.sid = s.sid LEFT JOIN (
    SELECT h.k, a.sid, min(aai) AS lo, avg(aai) AS mean FROM half h JOIN binned a ON a.k = h.k AND a.grp = h.ga JOIN binned b ON b.k = h.k AND b.grp = h.gb AND a.sid = b.sid GROUP BY h.k, a.sid) p
  ON p.k = s.k AND p.sid = s.sid),
merges AS (
  SELECT DISTINCT n.k, n.step, n.l,
    (SELECT list(o.grp ORDER BY o.grp) FROM st o WHERE o.k = n.k AND o.step = n.step - 1 AND o.bin = n.bi) AS side_a,
    (SELECT list(o.grp ORDER BY o.grp) FROM st o WHERE o.k = n.k AND o.step = n.step - 1 AND o.bin = n.bj) AS side_b FROM st n WHERE n.step > 0),
gr(k, sid, grp, removed) AS (
  SELECT k, CAST(0 AS BIGINT), grp, CAST(NULL AS BIGINT) FROM groups
  UNION ALL
  SELECT s.k, s.sid + 1, s.grp, b.cand FROM gr s JOIN (
    SELECT k, cand FROM (
      SELECT c.k, c.grp AS cand, row_number() OVER (PARTITION BY c.k ORDER BY coalesce(o.n, 0) DESC, c.grp) AS j
      FROM gr c JOIN (
        SELECT k, grp AS ref, n, total FROM (
          SELECT u.k, u.grp, t.n, t.total, row_number() OVER (PARTITION BY u.k ORDER BY coalesce(h.c, 0), CAST(u.grp AS VARCHAR)) AS j
          FROM gr u JOIN (SELECT k, count(*) AS n, sum(grp) AS total FROM gr GROUP BY k HAVING count(*) > 2) t ON t.k = u.k LEFT JOIN (
            SELECT k, grp, count(*) AS c FROM (
              SELECT f.k, f.grp, f.item, count(DISTINCT f.other) AS m FROM hf f JOIN gr a ON a.k = f.k AND a.grp = f.grp JOIN gr b ON b.k = f.k AND b.grp = f.other GROUP BY ALL) y
            WHERE m = (SELECT count(*) - 1 FROM gr z WHERE z.k = y.k) GROUP BY k, grp) h ON h.k = u.k AND h.grp = u.grp) WHERE j = 1) r
      ON r.k = c.k AND r.ref <> c.grp LEFT JOIN (
        SELECT k, grp, miss, count(*) AS n FROM (
          SELECT p.k, p.grp, p.item, (SELECT sum(grp) FROM gr z WHERE z.k = p.k) - p.grp - sum(p.other) AS miss, count(*) AS m
          FROM (SELECT DISTINCT k, grp, item, other FROM partner) p JOIN gr a ON a.k = p.k AND a.grp = p.grp JOIN gr b ON b.k = p.k AND b.grp = p.other GROUP BY p.k, p.grp, p.item) y
        WHERE m = (SELECT count(*) - 2 FROM gr z WHERE z.k = y.k) GROUP BY k, grp, miss) o ON o.k = c.k AND o.grp = r.ref AND o.miss = c.grp) WHERE j = 1) b
  ON b.k = s.k WHERE s.grp <> b.cand),
{core_sql('z', '(SELECT k, sid, grp FROM gr)')},
greedy AS (
  SELECT s.k, s.sid, n.n AS retained, s.core_size, (SELECT any_value(removed) FROM gr WHERE gr.k = s.k AND gr.sid = s.sid) AS removed FROM zs s JOIN zn n ON n.k = s.k AND n.sid = s.sid)
"""

REPORTS = """
, curve AS (
  SELECT n.k, n.n, p, (SELECT count(*) FROM (SELECT ref_item FROM pres WHERE pres.k = n.k GROUP BY ref_item HAVING sum(present) >= p)) AS c
  FROM (SELECT k, n, unnest(range(1, n + 1)) AS p FROM xn WHERE sid = -1) n),
lines AS (
  SELECT k, 'homolog_counts' AS report, concat_ws('\t', grp, homologs) AS line FROM xh WHERE sid = -1
  UNION ALL SELECT k, 'leave_one_out', concat_ws('\t', excluded, core_size, change) FROM loo
  UNION ALL SELECT k, 'greedy_removal', concat_ws('\t', retained, core_size, coalesce(CAST(removed AS VARCHAR), '')) FROM greedy
  UNION ALL SELECT k, 'soft_core_curve', concat_ws('\t', p, n, CAST(round(CAST(p AS DOUBLE) * 100 / n, 1) AS VARCHAR), c) FROM curve
  UNION ALL SELECT k, 'speciation_prediction', concat_ws('\t', grp, coalesce(CAST(nearest AS VARCHAR), '-'), coalesce(CAST(round(aai, 2) AS VARCHAR), 'NA'), shared, gain, reading, verdict) FROM spec
  UNION ALL SELECT k, 'proposed_bins', concat_ws('\t', bin, size, core_size, ref, coalesce(CAST(round(lo, 2) AS VARCHAR), 'NA'), coalesce(CAST(round(mean, 2) AS VARCHAR), 'NA'), members) FROM bins
  UNION ALL SELECT k, 'merge_trace', concat_ws('\t', step, CAST(round(l, 2) AS VARCHAR), len(side_a), len(side_b), len(side_a) + len(side_b), array_to_string(side_a, ';'), array_to_string(side_b, ';')) FROM merges
  UNION ALL SELECT k, 'aai_matrix', concat_ws('\t', ga, string_agg(coalesce(printf('%.2f', CAST(aai AS DOUBLE)), 'NA'), '\t' ORDER BY gb)) FROM matrix GROUP BY k, ga
  UNION ALL SELECT k, 'shared_orthologs', concat_ws('\t', ga, string_agg(CAST(shared AS VARCHAR), '\t' ORDER BY gb)) FROM matrix GROUP BY k, ga
  UNION ALL SELECT k, r, concat_ws('\t', 'genome', string_agg(CAST(grp AS VARCHAR), '\t' ORDER BY grp)) FROM groups, (VALUES ('aai_matrix'), ('shared_orthologs')) v(r) GROUP BY k, r
  UNION ALL SELECT k, 'pangenome_matrix', concat_ws('\t', grp, string_agg(CAST(present AS VARCHAR), '\t' ORDER BY ref_item)) FROM pres GROUP BY k, grp
  UNION ALL SELECT k, 'pangenome_matrix', concat_ws('\t', 'genome', string_agg('group' || CAST(j AS VARCHAR), '\t' ORDER BY j)) FROM (SELECT DISTINCT k, ref_item, dense_rank() OVER (PARTITION BY k ORDER BY ref_item) - 1 AS j FROM pres) GROUP BY k
  UNION ALL SELECT g.k, r, replace(h, ' ', '\t') FROM (SELECT DISTINCT k FROM groups) g, (VALUES __HEADERS__) v(r, h)
)
"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = SETS + sql
        return f

    return add


def _set(df):
    """The set's id under a name of its own; integers are long and doubles rounded, as the SQL side has them."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias("k" if c == "set_id" else c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns])


@query("aai_sets", "SELECT k, ga, gb, round(aai, 6) AS aai, shared FROM matrix")
def _(spark, d):
    return _set(standins.set_screen(spark, d).matrix)


@query("core_sets", "SELECT k, sid AS subset_id, ref, core_size FROM xs")
def _(spark, d):
    s = standins.set_screen(spark, d, keep=True)
    full = s.core_of(s.full).withColumn("subset_id", F.lit(-1).cast("long"))
    return _set(full.unionByName(s.without_each))


@query("bins_sets", "SELECT k, bin, size, ref, core_size, round(lo, 6) AS min_aai, round(mean, 6) AS mean_aai, members FROM bins")
def _(spark, d):
    return _set(standins.set_screen(spark, d, keep=True).bin_report)


@query("speciation_sets", "SELECT k, grp, nearest, round(aai, 6) AS aai, shared, gain, reading, verdict FROM spec")
def _(spark, d):
    return _set(standins.set_screen(spark, d, keep=True).speciation)


@query("greedy_sets", "SELECT k, retained, core_size, removed FROM greedy")
def _(spark, d):
    return _set(standins.set_screen(spark, d).greedy_removal)


#: The same rules with all vectors in one set.
ORACLES["greedy_removal"] = SETS.replace(standins.VECTOR_SET, "CAST(0 AS BIGINT)") + "SELECT retained, core_size, removed FROM greedy"
