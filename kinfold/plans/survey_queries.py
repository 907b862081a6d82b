"""Registered queries of the survey, evaluation and older-pipeline operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import scalars
from kinfold.operators import evaluation, relational
from kinfold.plans.screen_queries import ARI_SQL, tidy
from kinfold.plans.standins import judged, labels, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: tidy(f(lambda t: table(spark, d, t), spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- evaluation ------------------------------------------------------------------------

LAB = "lab AS (SELECT c_mktsegment AS t, o_orderstatus AS a, o_orderpriority AS b FROM orders JOIN customer ON o_custkey = c_custkey)"
JUDGED = "j AS (SELECT d.doc_id, lang, source, n_chars < 1500 AS p, quality = 0 AS a FROM documents d JOIN labels USING (doc_id))"
CONF = "count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn"


@query("contingency", f"WITH {LAB} SELECT t AS segment, a, b, count(*) AS n FROM lab GROUP BY t, a, b")
def _(t, spark, d):
    return evaluation.contingency(labels(spark, d)).select(F.col("set_id").alias("segment"), "a", "b", "n")


@query("adjusted_rand", f"WITH {LAB}, {ARI_SQL} SELECT t AS segment, n, round(ari, 6) AS ari FROM ari")
def _(t, spark, d):
    x = evaluation.adjusted_rand(evaluation.contingency(labels(spark, d)))
    return x.select(F.col("set_id").alias("segment"), "n", "ari")


BAND = "CASE WHEN ari IS NULL THEN 'undefined' WHEN ari >= 0.75 THEN 'strong' WHEN ari >= 0.4 THEN 'moderate' WHEN ari >= 0.1 THEN 'weak' ELSE 'little or none' END"


@query("ari_bands", f"WITH lab AS (SELECT o_orderpriority AS t, o_orderstatus AS a, CASE WHEN o_custkey % 5 < 4 THEN o_orderstatus ELSE 'X' END AS b FROM orders), {ARI_SQL} SELECT {BAND} AS band, count(*) AS n FROM ari GROUP BY 1")
def _(t, spark, d):
    x = t("orders").select(
        F.col("o_orderpriority").alias("set_id"), F.col("o_orderstatus").alias("a"), F.when(F.col("o_custkey") % 5 < 4, F.col("o_orderstatus")).otherwise("X").alias("b")
    )
    ari = evaluation.adjusted_rand(evaluation.contingency(x))
    return ari.groupBy(evaluation.ari_band(F.col("ari")).alias("band")).agg(F.count("*").alias("n"))


@query("confusion", f"WITH {JUDGED} SELECT lang, {CONF} FROM j GROUP BY lang")
def _(t, spark, d):
    return evaluation.confusion(judged(spark, d), F.col("predicted"), F.col("actual"), ["lang"])


@query("screen_metrics", f"WITH {JUDGED}, c AS (SELECT lang, {CONF} FROM j GROUP BY lang) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM c")
def _(t, spark, d):
    return evaluation.screen_metrics(evaluation.confusion(judged(spark, d), F.col("predicted"), F.col("actual"), ["lang"]))


@query("outcome_share", f"""WITH {JUDGED} SELECT CASE WHEN p AND a THEN 'split/split corroborated' WHEN p THEN 'split/coherent only here'
    WHEN a THEN 'coherent/split too permissive' ELSE 'coherent/coherent agree' END AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM j GROUP BY 1""")
def _(t, spark, d):
    return evaluation.shares(judged(spark, d), scalars.outcome(F.col("predicted"), F.col("actual")))


@query("dominant_share", "SELECT source, CAST(sum(c) AS BIGINT) AS n, count(*) AS taxa, count(*) FILTER (c >= 5) AS real_taxa, round(max(c) * 100.0 / sum(c), 4) AS dominant_pct FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY source, lang) GROUP BY source")
def _(t, spark, d):
    return evaluation.dominant(t("documents"), "source", "lang", 5)


@query("majority_taxon", "SELECT source, lang, c FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, lang) AS n FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY source, lang)) WHERE n = 1")
def _(t, spark, d):
    return evaluation.majority(t("documents"), "source", "lang")


WILSON = """round(100 * greatest(0.0, ((k / n) + z * z / (2 * n) - z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
  round(100 * least(1.0, ((k / n) + z * z / (2 * n) + z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high"""


@query("wilson_interval", f"SELECT lang, {WILSON} FROM (SELECT lang, CAST(count(*) FILTER (quality = 1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, 1.959963985::DOUBLE AS z FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def _(t, spark, d):
    x = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = scalars.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return x.select("lang", low.alias("low"), high.alias("high"))


KAPPA = """((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / nullif(1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n), 0)"""


@query("cohen_kappa", f"WITH {JUDGED}, c AS (SELECT lang, {CONF} FROM j GROUP BY lang) SELECT lang, round({KAPPA}, 6) AS kappa FROM (SELECT *, CAST(tp + fp + fn + tn AS DOUBLE) AS n FROM c)")
def _(t, spark, d):
    c = evaluation.confusion(judged(spark, d), F.col("predicted"), F.col("actual"), ["lang"])
    return c.select("lang", scalars.kappa(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("kappa"))


@query("sign_test", """SELECT lang, n, k, round((SELECT sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - n * ln(2.0))) FROM (SELECT unnest(range(k, n + 1)) AS x)), 6) AS p
    FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def _(t, spark, d):
    x = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    return x.withColumn("p", scalars.sign_test(F.col("k"), F.col("n")))


@query("interval_overlap", f"""WITH w AS (SELECT lang, {WILSON} FROM (SELECT lang, CAST(count(*) FILTER (quality = 1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, 1.959963985::DOUBLE AS z FROM documents JOIN labels USING (doc_id) GROUP BY lang))
    SELECT a.lang AS x, b.lang AS y, a.low <= b.high AND b.low <= a.high AS overlap FROM w a JOIN w b ON a.lang < b.lang""")
def _(t, spark, d):
    w = QUERIES["wilson_interval"](spark, d)
    a, b = (w.select(F.col("lang").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for n in "xy")
    both = a.join(b, F.col("x") < F.col("y"))  # one row a language pair
    return both.select("x", "y", scalars.overlap(F.col("low_x"), F.col("high_x"), F.col("low_y"), F.col("high_y")).alias("overlap"))


@query("kappa_interval")
def _(t, spark, d):
    return evaluation.kappa_interval(evaluation.confusion(judged(spark, d), F.col("predicted"), F.col("actual"), ["lang"]), "lang")


@query("metrics_rollup", f"WITH {JUDGED} SELECT coalesce(lang, 'All') AS domain, {CONF} FROM j GROUP BY ROLLUP (lang)")
def _(t, spark, d):
    p, a = F.col("predicted"), F.col("actual")
    return judged(spark, d).rollup("lang").agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    ).select(F.coalesce("lang", F.lit("All")).alias("domain"), "tp", "fp", "fn", "tn")


LENGTHS = "SELECT source, n_chars // 500 AS size, doc_id FROM documents"


@query("singleton_check", f"""WITH d AS ({LENGTHS}), s AS (SELECT source, size FROM d GROUP BY source, size HAVING count(*) = 1),
    m AS (SELECT source, size AS main FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, size) AS n FROM (SELECT source, size, count(*) AS c FROM d JOIN labels USING (doc_id) GROUP BY source, size)) WHERE n = 1)
    SELECT CASE WHEN main IS NULL THEN 'nodata' WHEN main <> size THEN 'hit' ELSE 'miss' END AS result, count(*) AS n FROM s LEFT JOIN m USING (source) GROUP BY 1""")
def _(t, spark, d):
    # Sizes that one document of a source has alone, against the size that most of its labelled documents have.
    docs = t("documents").select("source", F.floor(F.col("n_chars") / 500).alias("size"), "doc_id")
    lone = docs.groupBy("source", "size").agg(F.count("*").alias("c")).where("c = 1").select("source", "size")
    main = evaluation.majority(docs.join(t("labels"), "doc_id"), "source", "size").select("source", F.col("size").alias("main"))
    r = F.when(F.col("main").isNull(), "nodata").when(F.col("main") != F.col("size"), "hit").otherwise("miss")
    return lone.join(main, "source", "left").groupBy(r.alias("result")).agg(F.count("*").alias("n"))


@query("db_agreement", """WITH l AS (SELECT p_size AS a, p_brand AS b FROM part), ab AS (SELECT DISTINCT a, b FROM l)
    SELECT b, count(*) = 1 AND min((SELECT count(*) FROM ab y WHERE y.a = ab.a)) = 1 AS agrees FROM ab GROUP BY b""")
def _(t, spark, d):
    x = t("part").select(F.lit(0).cast("long").alias("set_id"), F.col("p_size").alias("a"), F.col("p_brand").alias("b"))
    return evaluation.db_agreement(x)


@query("bootstrap_median")
def _(t, spark, d):
    return evaluation.bootstrap_median(t("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v")), "v", rounds=5000)


# ---- selection and roll-up -------------------------------------------------------------


@query("select_latest_named", "SELECT p_partkey, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_size >= 10 AND regexp_matches(lower(p_name), '^[a-z0-9 ]+$') AND p_type NOT IN ('', 'na')")
def _(t, spark, d):
    return t("part").where(
        F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & (F.col("p_size") >= 10) & F.lower("p_name").rlike("^[a-z0-9 ]+$") & ~F.col("p_type").isin("", "na")
    ).select("p_partkey", "p_type")


@query("having_min_species", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) >= 3")
def _(t, spark, d):
    return relational.having_count(t("customer"), ["c_nationkey"], 3, distinct="c_mktsegment")


@query("having_range", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12")
def _(t, spark, d):
    return relational.having_count(t("customer"), ["c_nationkey", "c_mktsegment"], 2, 12)


RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


@query("dedup_ranked", f"SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {RANK}, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def _(t, spark, d):
    rank = relational.rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return relational.first_by(t("orders"), ["o_custkey"], [rank, F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("dedup_with_exception", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS VARCHAR) ELSE '' END ORDER BY {RANK}, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(t, spark, d):
    rank = relational.rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    x = relational.first_with_exception(t("orders"), "o_custkey", F.col("o_orderstatus") == "P", "o_orderkey", [rank, "o_orderkey"])
    return x.select("o_custkey", "o_orderkey")


@query("longest_per_group", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def _(t, spark, d):
    return relational.first_by(t("documents"), ["source"], [F.desc("n_chars"), "doc_id"]).select("source", "doc_id", "n_chars")


@query("taxonomy_lookup", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def _(t, spark, d):
    found, _ = relational.taxonomy_lookup(t("documents").select("doc_id"), t("labels").select("doc_id", "quality"), "doc_id", "quality")
    return found


@query("taxonomy_unmatched", "SELECT count(*) FILTER (l.quality IS NULL) AS unmatched FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t, spark, d):
    return relational.taxonomy_lookup(t("documents").select("doc_id"), t("labels").select("doc_id", "quality"), "doc_id", "quality")[1]


@query("method_join", "WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT k, customers, suppliers FROM a JOIN b USING (k)")
def _(t, spark, d):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k")


@query("semi_clash", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def _(t, spark, d):
    x = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return relational.clashes(x, t("supplier").select(F.col("s_nationkey").alias("k")), "k").select("c_custkey")


UPS = "n AS (SELECT o_orderkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderstatus = 'P')"


@query("anti_upsert", f"WITH {UPS} SELECT o_orderkey AS k, round(o_totalprice, 6) AS v FROM orders WHERE o_orderkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, round(v, 6) FROM n")
def _(t, spark, d):
    old = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("v"))
    return relational.upsert(old, new, "k")


@query("duplicates", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(t, spark, d):
    return relational.duplicates(t("orders"), "o_custkey")


@query("missing_ids", "SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t, spark, d):
    return relational.missing_ids(t("documents").select(F.col("doc_id").alias("k")), t("labels").select(F.col("doc_id").alias("k")), "k")


@query("partition_valid", """SELECT count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n IS NULL) AS missing FROM nation LEFT JOIN (
    SELECT s_nationkey AS n_nationkey, count(DISTINCT s_suppkey % 3) AS n FROM supplier GROUP BY 1) USING (n_nationkey)""")
def _(t, spark, d):
    # Suppliers put nations into bins: a nation may be in several, or in none.
    g = t("nation").select(F.lit(0).cast("long").alias("set_id"), F.col("n_nationkey").alias("grp"))
    bins = t("supplier").select(F.lit(0).cast("long").alias("set_id"), F.col("s_nationkey").alias("grp"), (F.col("s_suppkey") % 3).alias("bin")).distinct()
    return evaluation.partition_valid(bins, g)


@query("level_pivot", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS n_machinery, count(*) FILTER (coalesce(c_mktsegment NOT IN ('BUILDING', 'MACHINERY'), true)) AS n_other, count(*) AS n FROM customer GROUP BY c_nationkey")
def _(t, spark, d):
    return relational.level_pivot(t("customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("upper_median", "SELECT source, min(n_chars) AS lowest, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median, max(n_chars) AS highest FROM documents GROUP BY source")
def _(t, spark, d):
    return relational.upper_median(t("documents"), "source", "n_chars")


@query("group_sizes", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(t, spark, d):
    return t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("batches", "SELECT p_partkey, CAST(floor((row_number() OVER (ORDER BY p_size, p_partkey) - 1) / 25) AS BIGINT) AS batch FROM part")
def _(t, spark, d):
    return relational.batches(t("part").select("p_partkey", "p_size"), ["p_size", "p_partkey"], 25).select("p_partkey", "batch")


@query("top_gaps", "SELECT p_partkey, round(65 - p_retailprice / 20, 6) AS margin FROM part ORDER BY p_retailprice / 20, p_partkey LIMIT 10")
def _(t, spark, d):
    m = F.lit(65.0) - F.col("p_retailprice") / 20
    return t("part").select("p_partkey", m.alias("margin")).orderBy(F.desc("margin"), "p_partkey").limit(10)


@query("triage_bands", "SELECT CASE WHEN m <= 1 THEN 'within 1' WHEN m <= 5 THEN 'within 5' ELSE 'wider' END AS band, count(*) AS n FROM (SELECT p_size / 5 AS m FROM part) GROUP BY 1")
def _(t, spark, d):
    return t("part").groupBy(scalars.margin_band(F.col("p_size") / 5).alias("band")).agg(F.count("*").alias("n"))


@query("expectation_match", "SELECT CASE WHEN l.quality IS NULL THEN 'NA' WHEN l.quality = (d.n_chars > 1000)::INT THEN 'MATCH' ELSE 'MISMATCH' END AS result, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(t, spark, d):
    x = t("documents").join(t("labels"), "doc_id", "left")
    return x.groupBy(scalars.expectation((F.col("n_chars") > 1000).cast("int"), F.col("quality")).alias("result")).agg(F.count("*").alias("n"))


@query("pocp", """WITH l AS (SELECT DISTINCT s_nationkey AS g, l_partkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    h AS (SELECT a.g AS ga, b.g AS gb, a.item FROM l a JOIN l b ON a.item = b.item AND a.g <> b.g),
    c AS (SELECT ga, gb, count(*) AS c FROM h GROUP BY ga, gb),
    t AS (SELECT s_nationkey AS g, count(DISTINCT l_partkey) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey)
    SELECT a.g AS ga, b.g AS gb, round(CASE WHEN a.g = b.g THEN 100.0 ELSE (coalesce(x.c, 0) + coalesce(y.c, 0)) * 100.0 / (a.total + b.total) END, 6) AS pocp
    FROM t a CROSS JOIN t b LEFT JOIN c x ON x.ga = a.g AND x.gb = b.g LEFT JOIN c y ON y.ga = b.g AND y.gb = a.g""")
def _(t, spark, d):
    return _pocp(t).select("ga", "gb", "pocp")


def supplied(t, set_id="0"):
    """(set_id, grp, item): the parts that each nation supplies."""
    l = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return l.select(F.expr(set_id).cast("long").alias("set_id"), F.col("s_nationkey").alias("grp"), F.col("l_partkey").alias("item"))


def _pocp(t):
    """POCP of nations by the parts they supply."""
    return relational.pocp_of_shared(supplied(t))


@query("pocp_bins")
def _(t, spark, d):
    from kinfold.operators.iterative import bins

    return bins(_pocp(t).withColumn("aai", F.col("pocp")), [20.0]).select("bin", "grp")


#: Many sets of very uneven size: one holds a third of the parts, others a few each.
PART_SET = "CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 + CAST(floor(sqrt(4 * l_partkey)) AS BIGINT) END"


@query("pocp_sets", f"""WITH l AS (SELECT DISTINCT {PART_SET} AS set_id, s_nationkey AS g, l_partkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    c AS (SELECT a.set_id, a.g AS ga, b.g AS gb, count(*) AS c FROM l a JOIN l b ON a.set_id = b.set_id AND a.item = b.item AND a.g <> b.g GROUP BY ALL),
    t AS (SELECT set_id, g, count(*) AS total FROM l GROUP BY ALL)
    SELECT CAST(a.set_id AS VARCHAR) AS part_set, a.g AS ga, b.g AS gb, CASE WHEN a.g = b.g THEN 2 * a.total ELSE 2 * coalesce(c, 0) END AS conserved, a.total + b.total AS items,
      round(CASE WHEN a.g = b.g THEN 100.0 ELSE 200.0 * coalesce(c, 0) / (a.total + b.total) END, 6) AS pocp
    FROM t a JOIN t b ON a.set_id = b.set_id LEFT JOIN c ON c.set_id = a.set_id AND c.ga = a.g AND c.gb = b.g""")
def _(t, spark, d):
    return relational.pocp_of_shared(supplied(t, PART_SET)).select(F.col("set_id").cast("string").alias("part_set"), "ga", "gb", "conserved", "items", "pocp")


# ---- text rules, older pipeline --------------------------------------------------------


@query("regex_extract", "SELECT page_id, regexp_extract(url, '://([^/:]+)', 1) AS host, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang FROM pages")
def _(t, spark, d):
    lang = F.nullif(F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit(""))
    return t("pages").select("page_id", F.regexp_extract("url", "://([^/:]+)", 1).alias("host"), lang.alias("lang"))


@query("explode_members", r"SELECT item_id, m AS member, count(*) AS n FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '[;\s]+'), lambda x: x <> '')) AS m FROM benchmark) GROUP BY item_id, m")
def _(t, spark, d):
    return t("benchmark").select("item_id", F.explode(scalars.members(F.col("text"))).alias("member")).groupBy("item_id", "member").agg(F.count("*").alias("n"))


@query("safe_name", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe, trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_') AS label FROM pages")
def _(t, spark, d):
    return t("pages").select("page_id", scalars.safe_name(F.col("url")).alias("safe"), scalars.label(F.col("url")).alias("label"))


@query("name_parts", "SELECT p_partkey, split_part(p_name, ' ', 1) AS genus, split_part(p_name, ' ', 2) AS epithet, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded FROM part")
def _(t, spark, d):
    sp, n = F.lit(" "), F.col("p_name")
    return t("part").select("p_partkey", F.split_part(n, sp, F.lit(1)).alias("genus"), F.split_part(n, sp, F.lit(2)).alias("epithet"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"))


@query("supermatrix", "SELECT role, conv_id % 10 AS grp, string_agg(text, '' ORDER BY conv_id * 1000 + turn) AS joined FROM conversations GROUP BY role, conv_id % 10")
def _(t, spark, d):
    x = t("conversations").select("role", (F.col("conv_id") % 10).alias("grp"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "text")
    return relational.supermatrix(x, ["role", "grp"], "o", "text")


@query("transpose_groups", """SELECT l_orderkey, array_to_string(list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity), ' ') AS quantities,
    count(DISTINCT l_linenumber) AS n, count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS complete
    FROM lineitem GROUP BY l_orderkey""")
def _(t, spark, d):
    x = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("v"))
    g = relational.transposed(x, "l_orderkey", "l_linenumber", "v", x.select("l_linenumber"))
    return g.select("l_orderkey", F.array_join(F.transform("cells", lambda v: v.cast("string")), " ").alias("quantities"), "n", "complete")


@query("recombinant_split", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN (d.doc_id % 100) / 100.0 END < 0.05, false) AS recombinant FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t, spark, d):
    tests = t("labels").select("doc_id", F.when(F.col("quality") == 1, (F.col("doc_id") % 100) / 100.0).alias("p"))
    return relational.split_recombinant(t("documents").select("doc_id"), tests, "doc_id", 0.05).select("doc_id", "recombinant")


@query("reuse_index", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def _(t, spark, d):
    x = relational.reuse_index(t("lineitem"), "l_partkey", ["l_suppkey", "l_orderkey", "l_linenumber"])
    return x.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("status_counts", "SELECT count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS n FROM orders")
def _(t, spark, d):
    return relational.status_counts(t("orders"), "o_orderstatus", ["O", "F", "P"])


@query("bins_side_by_side", "SELECT c_mktsegment, coalesce(CAST(nullif(count(*) FILTER (c_nationkey % 3 = 0), 0) AS VARCHAR), '') AS bin_0, coalesce(CAST(nullif(count(*) FILTER (c_nationkey % 3 = 1), 0) AS VARCHAR), '') AS bin_1, coalesce(CAST(nullif(count(*) FILTER (c_nationkey % 3 = 2), 0) AS VARCHAR), '') AS bin_2 FROM customer GROUP BY c_mktsegment")
def _(t, spark, d):
    x = t("customer").select("c_mktsegment", (F.col("c_nationkey") % 3).alias("b"))
    return relational.side_by_side(x, "c_mktsegment", "b", [0, 1, 2])


@query("window_spread", "SELECT count(lo) AS n, round(max((lo + hi) / 2) - min((lo + hi) / 2), 6) AS spread, round(count(*) FILTER (25 BETWEEN lo AND hi) * 100.0 / count(*), 6) AS recoverable_pct FROM (SELECT p_brand, CAST(min(p_size) FILTER (p_size > 20) AS DOUBLE) AS lo, CAST(max(p_size) FILTER (p_size > 20) AS DOUBLE) AS hi FROM part GROUP BY p_brand)")
def _(t, spark, d):
    s = F.when(F.col("p_size") > 20, F.col("p_size").cast("double"))
    return evaluation.window_spread(t("part").groupBy("p_brand").agg(F.min(s).alias("exact_low"), F.max(s).alias("exact_high")), 25.0)
