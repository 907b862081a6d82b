"""Jobs over growing input, broken-off runs and reruns; reports byte for byte."""

import glob
import os
import random
import re

import duckdb
import pytest
from test_queries import plain

from jobs import common, queries, screen_survey, shared_items
from kinfold.plans.screen import Screen
from kinfold.sinks import screen_reports

# ---- the ten reports -------------------------------------------------------------------

EXPECTED = {
    "homolog_counts": "genome\thomologs\nalpha\t1\nbeta\t1\ngamma\t1\n",
    "leave_one_out": "excluded_genome\tcore_size\tchange_vs_baseline\ngamma\t2\t1\nalpha\t1\t0\nbeta\t1\t0\n",
    "greedy_removal": "genomes_retained\tcore_size\tgenome_removed\n3\t1\t\n2\t2\tgamma\n",
    "soft_core_curve": "genomes_present\tgenomes_total\tpercent\tgroup_count\n3\t3\t100.0\t1\n2\t3\t66.7\t2\n1\t3\t33.3\t2\n",
    "speciation_prediction": "genome\tnearest_genome\taai_percent\tshared_orthologs\tcore_gain_if_removed\taai_reading\tverdict\n"
    "alpha\tbeta\t80.0\t2\t0\tsame genus, different species\tdistinct species\n"
    "beta\tgamma\t85.0\t1\t0\tsame genus, different species\tdistinct species\n"
    "gamma\tbeta\t85.0\t1\t1\tsame genus, different species\tREVIEW - collapses the shared core\n",
    "proposed_bins": "bin\tgenomes\tcore_genes\tbin_reference\tmin_aai\tmean_aai\tmembers\n1\t3\t1\talpha\t80.0\t81.67\talpha beta gamma\n",
    "merge_trace": "step\tlinkage_aai\tsize_a\tsize_b\tmerged_size\tside_a\tside_b\n1\t85.0\t1\t1\t2\tbeta\tgamma\n2\t80.0\t1\t2\t3\talpha\tbeta;gamma\n",
    "aai_matrix": "genome\talpha\tbeta\tgamma\nalpha\t100.00\t80.00\t80.00\nbeta\t80.00\t100.00\t85.00\ngamma\t80.00\t85.00\t100.00\n",
    "shared_orthologs": "genome\talpha\tbeta\tgamma\nalpha\t0\t2\t1\nbeta\t2\t0\t1\ngamma\t1\t1\t0\n",
    "pangenome_matrix": "genome\tgroup0\tgroup1\nalpha\t1\t1\nbeta\t1\t1\ngamma\t1\t0\n",
    "summary": """groups  : 3
items   : 5
anchor  : alpha (fewest homologs, 1)
limits  : identity >= 60%, binning at mean identity >= 65% (complete linkage)

CORE: 1 items shared by all 3 groups
One bin: the set is coherent at this limit.
{rule}
PROPOSED BINS

  bin  groups       core  min AAI mean AAI  members
    1       3          1     80.0    81.67  alpha beta gamma
{rule}
NEAREST GROUP AND CORE GAINED WITHOUT EACH GROUP

group                        nearest                   AAI%      gain  verdict
alpha                        beta                      80.0        +0  distinct species
beta                         gamma                     85.0        +0  distinct species
gamma                        beta                      85.0        +1  REVIEW - collapses the shared core
{rule}
HOMOLOGS PER GROUP

group                                             items
alpha                                                 1
beta                                                  1
gamma                                                 1
{rule}
LEAVE-ONE-OUT

group left out                                       core   change
gamma                                                   2       +1
alpha                                                   1       +0
beta                                                    1       +0
{rule}
GREEDY REMOVAL

  groups     core   group left out
       3        1   
       2        2   gamma
""".format(rule="-" * 72),
}


def test_reports_byte_for_byte(spark, tmp_path):
    items = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (5, 10, 1), (5, 11, 1), (5, 20, 2), (9, 0, 4)], "set_id long, item long, grp long")
    names = spark.createDataFrame([(5, 0, "alpha"), (5, 1, "beta"), (5, 2, "gamma"), (9, 4, "lone")], "set_id long, grp long, name string")
    pairs = [(0, 0, 10, 1, 90.0), (1, 0, 11, 1, 70.0), (0, 0, 20, 2, 80.0), (10, 1, 20, 2, 85.0)]
    hits = [(5, q, s, gq, gs, p, p) for q, gq, s, gs, p in pairs] + [(5, s, q, gs, gq, p, p) for q, gq, s, gs, p in pairs]
    screen = Screen(items, spark.createDataFrame(hits, "set_id long, q long, s long, gq long, gs long, pident double, score double"), names=names)
    screen_reports.write_lines(screen_reports.report_lines(screen).unionByName(screen_reports.summary_lines(screen)), str(tmp_path))
    assert {os.path.basename(x) for x in glob.glob(f"{tmp_path}/report=*")} == {f"report={k}" for k in EXPECTED}
    read = lambda k, i: "".join(open(x).read() for x in glob.glob(f"{tmp_path}/report={k}/set_id={i}/part-*"))
    for k, text in EXPECTED.items():
        assert read(k, 5) == text, k
    # A set of one group: headers, one bin, and no row that needs another group.
    assert read("proposed_bins", 9).split("\n")[1] == "1\t1\t1\tlone\tNA\tNA\tlone"
    assert read("leave_one_out", 9).count("\n") == read("merge_trace", 9).count("\n") == 1


# ---- texts that arrive in files --------------------------------------------------------

SCHEMA = "text string, lang string, source string"


def brute_shared(rows):
    held = {}
    for text, lang, source in rows:
        if lang is not None and source is not None:
            for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
                held.setdefault(lang, {}).setdefault(source, set()).add(w)
    out = {}
    for k, groups in held.items():
        names = sorted(groups)
        out["genome_totals", k] = ["genome_index\tgenome\tproteins_counted"] + [f"{i}\t{g}\t{len(groups[g])}" for i, g in enumerate(names)]
        cell = lambda a, b: int(100 * 200 * len(a & b) / (len(a) + len(b)) + 0.5) / 100 if a is not b else 100.0
        out["pocp_matrix", k] = ["\t".join(["genome", *names])] + ["\t".join([g, *(f"{cell(groups[g], groups[h]):.2f}" for h in names)]) for g in names]
    return out


def lines(path):
    out = {}
    for at in glob.glob(f"{path}/report=*/set_id=*"):
        report, k = re.search("report=(.*)/set_id=(.*)", at).groups()
        out[report, k] = [x for f in glob.glob(f"{at}/part-*") for x in open(f).read().split("\n")[:-1]]
    return out


def test_shared_items_of_growing_input(spark, tmp_path):
    first = [("a b c d", "en", "s1"), ("a b c x", "en", "s2"), ("A! b, é", "fr", "s1"), (None, "fr", "s2"), ("q", None, "s1"), ("q", "en", None)]
    second = [("a b c d e f g h", "en", "s1"), ("y z", "en", "s3"), ("b é b", "fr", "s1")]
    config = {"input": f"{tmp_path}/in", "out": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/c", "min_shared": 50.0}
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(config["input"])
    got = shared_items.run(spark, config)
    assert (got["rows_read"], got["sets_done"]) == (len(first), 2)
    reports = lines(f"{tmp_path}/out/reports")
    for key, want in brute_shared(first).items():
        assert reports[key] == want
    assert reports["pocp_bins", "en"] == ["bin\tgenomes\tmembers", "1\t2\ts1 s2"]
    files = set(glob.glob(f"{tmp_path}/out/reports/*/*/part-*"))
    assert shared_items.run(spark, config) == {"rows_read": 0, "sets_done": 0, "lines_written": 0}
    assert set(glob.glob(f"{tmp_path}/out/reports/*/*/part-*")) == files

    spark.createDataFrame(second, SCHEMA).coalesce(1).write.mode("append").parquet(config["input"])
    got = shared_items.run(spark, config)
    assert (got["rows_read"], got["sets_done"]) == (len(second), 1)  # French has no new word
    reports = lines(f"{tmp_path}/out/reports")
    for key, want in brute_shared(first + second).items():
        assert reports[key] == want
    assert {f for f in files if "set_id=fr" in f} == {f for f in glob.glob(f"{tmp_path}/out/reports/*/*/part-*") if "set_id=fr" in f}
    # In one go, elsewhere: the same.
    whole = {**config, "out": f"{tmp_path}/out2", "checkpoint": f"{tmp_path}/c2"}
    shared_items.run(spark, whole)
    assert lines(f"{tmp_path}/out2/reports") == reports


def test_shared_items_broken_off(spark, tmp_path, monkeypatch):
    """A run that ends between the stream and the reports is made up for by the next."""
    config = {"input": f"{tmp_path}/in", "out": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/c"}
    spark.createDataFrame([("a b", "en", "s1"), ("b c", "en", "s2")], SCHEMA).write.parquet(config["input"])

    def fail(*_):
        raise RuntimeError("broken off")

    with monkeypatch.context() as m:
        m.setattr(shared_items, "write_lines", fail)
        with pytest.raises(RuntimeError):
            shared_items.run(spark, config)
    got = shared_items.run(spark, config)
    assert (got["rows_read"], got["sets_done"]) == (0, 1)
    assert lines(f"{tmp_path}/out/reports")["pocp_matrix", "en"] == ["genome\ts1\ts2", "s1\t100.00\t50.00", "s2\t50.00\t100.00"]


# ---- many sets, taken up again ---------------------------------------------------------


def vectors(sets, change=()):
    out = []
    for k in sets:
        for i in range(3 + 2 * (k % 4)):
            v = [float((i * 7 + k + j * (3 + i % 3)) % 11 - 5) + (0.5 if k in change else 0.0) for j in range(8)]
            out.append((k, 100 * k + i, i % 3, v))
    return out


def survey(spark, tmp_path, sets, change=(), **more):
    spark.createDataFrame(vectors(sets, change), "set_id long, item long, grp long, vector array<float>").write.mode("overwrite").parquet(f"{tmp_path}/items")
    return screen_survey.run(spark, {"items": f"{tmp_path}/items", "out": f"{tmp_path}/out", "mark": f"{tmp_path}/mark", "content": "vector", "min_hit": 50.0, **more})


def stamps(tmp_path):
    return {x: os.stat(x).st_mtime_ns for x in glob.glob(f"{tmp_path}/out/*/*/*/part-*") + glob.glob(f"{tmp_path}/out/survey/*/part-*")}


def of_set(files, k):
    return {x: t for x, t in files.items() if f"set_id={k}/" in x or f"set={k}/" in x}


def test_survey_takes_up_what_is_new(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise RuntimeError("broken off")

    with monkeypatch.context() as m:  # after the search, before the reports
        m.setattr(screen_survey, "write_lines", fail)
        with pytest.raises(RuntimeError):
            survey(spark, tmp_path, range(3))
    with monkeypatch.context() as m:
        m.setattr(screen_survey, "vector_hits", fail)  # the search isn't run again
        assert survey(spark, tmp_path, range(3))["sets_done"] == 3
    first = stamps(tmp_path)
    assert len(glob.glob(f"{tmp_path}/out/reports/*/*")) == 3 * 11
    assert survey(spark, tmp_path, range(3)) == {"sets_done": 0, "items_read": 0, "hits": 0, "lines_written": 0}
    assert stamps(tmp_path) == first

    # One set is new and one has changed.
    assert survey(spark, tmp_path, range(4), change=(1,))["sets_done"] == 2
    second = stamps(tmp_path)
    for k in (0, 2):
        assert of_set(second, k) == of_set(first, k)
    assert not set(of_set(second, 1)) & set(of_set(first, 1)) and of_set(second, 3)
    table = lambda at: sorted(map(str, spark.read.parquet(f"{at}/out/survey").drop("set").collect()))
    whole = tmp_path / "whole"
    assert survey(spark, whole, range(4), change=(1,))["sets_done"] == 4
    assert lines(f"{whole}/out/reports") == lines(f"{tmp_path}/out/reports") and table(whole) == table(tmp_path)
    # Other limits: every set again.
    assert survey(spark, tmp_path, range(4), change=(1,), limits={"bin_aai": 70.0})["sets_done"] == 4


def test_survey_of_protein_files(spark, tmp_path):
    """From folders of FASTA to reports: related sets of mutated families, a set of one file, and one of clashing names."""
    random.seed(2)
    alphabet = "LVIMCAGSTPFYWEDNQKRH"
    mutate = lambda seq, rate: "".join(random.choice(alphabet) if random.random() < rate else x for x in seq)
    files = {"lone/only.faa": [("x", "MKV" * 30)], "clash/a.faa": [("x", "MKV" * 30)], "clash/a.fa": [("x", "MKV" * 30)], "near/notes.txt": [("x", "MM")]}
    for k, rate in (("near", 0.05), ("far", 0.2)):
        families = ["".join(random.choice(alphabet) for _ in range(120)) for _ in range(8)]
        for g in range(4):
            held = families[: 8 - g] if g < 3 else families[1:4]
            files[f"{k}/g{g}.faa"] = [(f"{k}{g}_{i}", mutate(f, rate)) for i, f in enumerate(held)]
    for name, records in files.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/in/{name}"), exist_ok=True)
        with open(f"{tmp_path}/in/{name}", "w") as f:
            f.write("".join(f">{n} a protein\n{s[:60]}\n{s[60:]}\n" for n, s in records))
    config = {"items": f"{tmp_path}/in", "format": "fasta", "search": "proteins", "out": f"{tmp_path}/out", "mark": f"{tmp_path}/mark", "limits": {"max_gapopen": 3, "max_evalue": 1e-4, "bin_aai": 80.0}, "tree": True}
    got = screen_survey.run(spark, config)
    assert got["sets_done"] == 2 and got["items_read"] == sum(len(v) for k, v in files.items() if k[:4] in ("near", "far/") and k.endswith(".faa"))
    assert screen_survey.run(spark, config)["sets_done"] == 0
    reports = lines(f"{tmp_path}/out/reports")
    ids = {k: next(i for r, i in reports if r == "aai_matrix" and float(reports[r, i][1].split("\t")[2]) > low) for k, low in (("near", 85.0),)}
    near = ids["near"]
    far = next(i for r, i in reports if i != near)
    # Families 1 to 3 are everywhere: the core of all four; identities follow the mutations.
    for i in (near, far):
        assert any(x == "CORE: 3 items shared by all 4 groups" for x in reports["summary", i])
        assert reports["homolog_counts", i][1:] == sorted(reports["homolog_counts", i][1:], key=lambda x: int(x.split("\t")[1]))
    assert reports["proposed_bins", near][1].endswith("g0 g1 g2 g3") and len(reports["proposed_bins", far]) == 5
    core = lambda kind, part: [x for f in glob.glob(f"{tmp_path}/out/core_genes/report={kind}/set_id={near}/part={part}/part-*") for x in open(f).read().split("\n")[:-1]]
    names = [core("gene_names", f"g{g}") for g in range(4)]
    assert all(len(x) == 3 for x in names) and len({tuple(y.split("_")[1] for y in x) for x in names[:3]}) == 1  # the same family in each line
    sequence = {n: s for v in files.values() for n, s in v}
    assert core("per_genome", "g1") == [y for n in names[1] for y in (f">{n}", sequence[n])]
    trees = spark.read.parquet(f"{tmp_path}/out/trees").collect()
    for i in (int(near), int(far)):
        edges = [r for r in trees if r.set_id == i]
        assert len(edges) == 5 and {r.name for r in edges if r.node >= 0} == {"g0", "g1", "g2", "g3"} and all(r.name is None for r in edges if r.node < 0)
    assert spark.read.parquet(f"{tmp_path}/out/recombination").where("set_id = " + near).count() == 3
    assert core("ortholog_groups", "group0") == [y for g in range(4) for y in (f">g{g}|{names[g][0]}", sequence[names[g][0]])]


def test_configs_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="wrong"):
        common.checked({"a": 1, "wrong": 2}, {"a": int}, {})
    with pytest.raises(ValueError, match="'a'"):
        common.checked({}, {"a": int}, {})
    paths = {"items": "/a/x", "out": "/a/y", "mark": "/a/z"}
    for wrong in ({"search": "letters"}, {"min_hit": 0}, {"max_evalue": 0}, {"max_targets": 0}, {"out": "/a/x/out"}, {"mark": "/a"}):
        with pytest.raises(ValueError, match="config entr"):
            screen_survey.run(spark, {**paths, **wrong})
    with pytest.raises(ValueError, match="bin_aai"):
        screen_survey.run(spark, {"items": "x", "out": "y", "mark": "z", "limits": {"bin_aai": 200}})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_queries(spark, sf, name):
    before = {k: v for k, v in spark.sparkContext.getConf().getAll()}
    got = sorted(repr([plain(x) for x in r]) for r in queries.QUERIES[name](spark, sf).select("report", "set_id", "line").toPandas().values)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = sorted(repr([plain(x) for x in r]) for r in con.execute(f"SELECT report, set_id, line FROM ({queries.ORACLES[name]})").fetchall())
    assert got == want and dict(spark.sparkContext.getConf().getAll()) == before
