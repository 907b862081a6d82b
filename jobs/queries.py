"""The jobs as registered queries: each runs twice into one new folder and returns the whole output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import screen_survey, shared_items
from kinfold.plans import standins
from kinfold.plans.set_queries import REPORTS, SETS
from kinfold.sinks.screen_reports import HEADERS, RULE, read_lines


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name under the cluster's spark.checkpoint.dir, or beside the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_jobs"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_lines(df: DataFrame, report: str, key: str, columns: list[str]) -> DataFrame:
    """Rows of a table as (report, set_id, line)."""
    cells = [F.coalesce(F.round(c, 6).cast("string") if dict(df.dtypes)[c] == "double" else F.col(c).cast("string"), F.lit("NA")) for c in columns]
    return df.select(F.lit(report).alias("report"), F.col(key).cast("string").alias("set_id"), F.concat_ws("\t", *cells).alias("line"))


def job1_shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file stream over all documents; the second run finds nothing new."""
    at = new_folder(spark, "job1")
    # A pattern, as the path of a single file can't be a stream's folder.
    config = {"input": f"{sf_dir}/documents.parque[t]", "out": f"{at}/out", "checkpoint": f"{at}/checkpoint"}
    for _ in range(2):
        shared_items.run(spark, config)
    reports = read_lines(spark, f"{at}/out/reports")
    items = spark.read.schema(shared_items.ITEMS).parquet(f"{at}/out/items")
    totals = spark.read.schema(shared_items.TOTALS).parquet(f"{at}/out/totals")
    return reports.unionByName(as_lines(items, "items", "set_id", ["grp", "item"])).unionByName(as_lines(totals, "totals", "set_id", ["grp", "total"]))


JOB1_SQL = r"""
WITH RECURSIVE i AS MATERIALIZED (
  SELECT DISTINCT lang AS k, source AS g, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS item FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
t AS MATERIALIZED (SELECT k, g, count(*) AS total, row_number() OVER (PARTITION BY k ORDER BY g) - 1 AS place FROM i GROUP BY k, g),
m AS MATERIALIZED (
  SELECT a.k, a.g AS ga, b.g AS gb, a.place AS x, b.place AS y, a.total + b.total AS items, CASE WHEN a.g = b.g THEN 2 * a.total ELSE 2 * coalesce(c, 0) END AS conserved
  FROM t a JOIN t b ON a.k = b.k LEFT JOIN (SELECT a.k, a.g AS ga, b.g AS gb, count(*) AS c FROM i a JOIN i b ON a.k = b.k AND a.item = b.item AND a.g <> b.g GROUP BY ALL) c
  ON c.k = a.k AND c.ga = a.g AND c.gb = b.g),
h AS (SELECT *, (conserved * 20000 + items) // (items * 2) AS h FROM m),
st(k, step, x, bin) AS (
  SELECT k, CAST(0 AS BIGINT), place, place FROM t
  UNION ALL
  SELECT s.k, s.step + 1, s.x, CASE WHEN s.bin = n.bj THEN n.bi ELSE s.bin END FROM st s JOIN (
    SELECT k, bi, bj FROM (
      SELECT k, bi, bj, row_number() OVER (PARTITION BY k ORDER BY l DESC, bi, bj) AS j FROM (
        SELECT a.k, a.bin AS bi, b.bin AS bj, min(m.conserved * 100.0::DOUBLE / m.items) AS l FROM st a JOIN st b ON a.k = b.k AND a.bin < b.bin
        JOIN m ON m.k = a.k AND m.x = a.x AND m.y = b.x GROUP BY a.k, a.bin, b.bin) WHERE l >= 50) WHERE j = 1) n ON n.k = s.k),
final AS (SELECT s.k, s.x, s.bin AS low FROM st s JOIN (SELECT k, max(step) AS step FROM st GROUP BY k) z ON z.k = s.k AND z.step = s.step),
b AS (SELECT f.k, low, count(*) AS n, string_agg(g, ' ' ORDER BY g) AS m FROM final f JOIN t ON t.k = f.k AND t.place = f.x GROUP BY f.k, low)
SELECT 'pocp_matrix' AS report, k AS set_id, concat_ws(chr(9), ga, string_agg(concat(h // 100, '.', lpad(CAST(h % 100 AS VARCHAR), 2, '0')), chr(9) ORDER BY gb)) AS line FROM h GROUP BY k, ga
UNION ALL SELECT 'pocp_matrix', k, concat_ws(chr(9), 'genome', string_agg(g, chr(9) ORDER BY g)) FROM t GROUP BY k
UNION ALL SELECT 'genome_totals', k, concat_ws(chr(9), place, g, total) FROM t
UNION ALL SELECT DISTINCT 'genome_totals', k, concat_ws(chr(9), 'genome_index', 'genome', 'proteins_counted') FROM t
UNION ALL SELECT 'pocp_bins', k, concat_ws(chr(9), row_number() OVER (PARTITION BY k ORDER BY n DESC, low), n, m) FROM b
UNION ALL SELECT DISTINCT 'pocp_bins', k, concat_ws(chr(9), 'bin', 'genomes', 'members') FROM t
UNION ALL SELECT 'items', k, concat_ws(chr(9), g, item) FROM i
UNION ALL SELECT 'totals', k, concat_ws(chr(9), g, total) FROM t
"""

SURVEY = ["groups", "items", "core_size", "bins", "largest_bin", "lone_groups", "pairs", "min_aai", "mean_aai", "pairs_95", "most_gain", "most_gain_without"]


def job2_screen_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey over all vectors in many sets; the second run finds every set done."""
    at = new_folder(spark, "job2")
    config = {
        "items": f"{sf_dir}/embeddings.parquet", "set": standins.VECTOR_SET, "item": "vec_id", "group": "label", "content": "embedding",
        "min_hit": standins.MIN_HIT, "out": f"{at}/out", "mark": f"{at}/mark",
    }
    for _ in range(2):
        screen_survey.run(spark, config)
    return read_lines(spark, f"{at}/out/reports").unionByName(as_lines(spark.read.parquet(f"{at}/out/survey"), "survey", "set_id", SURVEY))


def _section(title: str, columns: str, rows: str) -> str:
    fixed = ", ".join(f"('{x}')" for x in (RULE, title, "", columns))
    return f" UNION ALL SELECT k, 'summary', v.x FROM (SELECT DISTINCT k FROM groups) g, (VALUES {fixed}) v(x) UNION ALL SELECT k, 'summary', {rows}"


SUMMARY = (
    """
, whole AS (
  SELECT g.k, g.n, i.items, r.ref, r.homologs, s.core_size, b.bins, b.largest, b.lone FROM (SELECT k, count(*) AS n FROM groups GROUP BY k) g
  JOIN (SELECT k, count(*) AS items FROM items GROUP BY k) i USING (k) JOIN (SELECT * FROM xr WHERE sid = -1) r USING (k) JOIN (SELECT * FROM xs WHERE sid = -1) s USING (k)
  JOIN (SELECT k, count(*) AS bins, max(n) AS largest, count(*) FILTER (n = 1) AS lone FROM bn GROUP BY k) b USING (k)),
heads AS (
  SELECT k, unnest(list_filter([
    printf('groups  : %d', n), printf('items   : %d', items), printf('anchor  : %s (fewest homologs, %d)', CAST(ref AS VARCHAR), homologs),
    'limits  : identity >= 60%, binning at mean identity >= 65% (complete linkage)', '', printf('CORE: %d items shared by all %d groups', core_size, n),
    CASE WHEN core_size = 0 THEN 'No item is shared by every group. Rule out incomplete groups and too strict limits first.' END,
    CASE WHEN bins = 1 THEN 'One bin: the set is coherent at this limit.' ELSE printf('%d bins: the set is not one coherent group at this limit.', bins) END], lambda x: x IS NOT NULL)) AS line FROM whole),
gains AS (SELECT k, max(change) AS change, arg_min(excluded, struct_pack(a := -change, b := excluded)) AS g FROM loo GROUP BY k),
found AS (SELECT k, count(*) AS pairs, min(aai) AS lo, avg(aai) AS mean, count(*) FILTER (aai >= 95) AS high FROM aai GROUP BY k),
texts AS (SELECT k, 'summary' AS report, line FROM heads"""
    + _section("PROPOSED BINS", f"{'bin':>5} {'groups':>7} {'core':>10} {'min AAI':>8} {'mean AAI':>8}  members", "printf('%5d %7d %10d %8s %8s  %s', bin, size, core_size, coalesce(CAST(round(lo, 2) AS VARCHAR), 'NA'), coalesce(CAST(round(mean, 2) AS VARCHAR), 'NA'), members) FROM bins")
    + _section("NEAREST GROUP AND CORE GAINED WITHOUT EACH GROUP", f"{'group':<28} {'nearest':<22} {'AAI%':>7} {'gain':>9}  verdict", "printf('%-28s %-22s %7s %+9d  %s', CAST(grp AS VARCHAR), coalesce(CAST(nearest AS VARCHAR), '-'), coalesce(CAST(round(aai, 2) AS VARCHAR), 'NA'), gain, verdict) FROM spec")
    + _section("HOMOLOGS PER GROUP", f"{'group':<48} {'items':>6}", "printf('%-48s %6d', CAST(grp AS VARCHAR), homologs) FROM xh WHERE sid = -1")
    + _section("LEAVE-ONE-OUT", f"{'group left out':<48} {'core':>8} {'change':>8}", "printf('%-48s %8d %+8d', CAST(excluded AS VARCHAR), core_size, change) FROM loo")
    + _section("GREEDY REMOVAL", f"{'groups':>8} {'core':>8}   group left out", "printf('%8d %8d   %s', retained, core_size, coalesce(CAST(removed AS VARCHAR), '')) FROM greedy")
    + """),
surveys AS (
  SELECT w.k, concat_ws('\t', n, items, core_size, bins, largest, lone, coalesce(f.pairs, 0), coalesce(CAST(round(f.lo, 6) AS VARCHAR), 'NA'), coalesce(CAST(round(f.mean, 6) AS VARCHAR), 'NA'),
    coalesce(f.high, 0), coalesce(CAST(g.change AS VARCHAR), 'NA'), coalesce(CAST(g.g AS VARCHAR), 'NA')) AS line
  FROM whole w LEFT JOIN found f USING (k) LEFT JOIN gains g USING (k))
SELECT report, CAST(k AS VARCHAR) AS set_id, line FROM lines UNION ALL SELECT report, CAST(k AS VARCHAR), line FROM texts UNION ALL SELECT 'survey', CAST(k AS VARCHAR), line FROM surveys
"""
)

JOB2_SQL = SETS + REPORTS.replace("__HEADERS__", ", ".join(f"('{r}', '{' '.join(h)}')" for r, h in HEADERS.items())) + SUMMARY

QUERIES = {"job1_shared_items": job1_shared_items, "job2_screen_survey": job2_screen_survey}
ORACLES = {"job1_shared_items": JOB1_SQL, "job2_screen_survey": JOB2_SQL}
