import gzip
import os

import pytest
from pyspark.sql import functions as F

from kinfold.operators import relational
from kinfold.operators.numbering import numbered
from kinfold.sinks import reports
from kinfold.sources import fasta, tables
from kinfold.streaming import survey


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.fixture
def proteomes(tmp_path):
    d = tmp_path / "p"
    d.mkdir()
    write(d / "b.faa", "preamble\n>x1 first one\r\nMK\r\nLV\r\n\r\n>x2\nAA AA\n>empty\n>x3 d\nCC")
    write(d / "a.FA", ">y1\nMM\n")
    write(d / "notes.txt", ">no\nMM\n")
    return str(d)


WANT = [("a.FA", 0, "y1", "", "MM"), ("b.faa", 0, "x1", "first one", "MKLV"), ("b.faa", 1, "x2", "", "AAAA"), ("b.faa", 2, "x3", "d", "CC")]


def test_fasta(spark, proteomes):
    got = sorted(tuple(r) for r in fasta.read_records(spark, proteomes).select("file", "position", "name", "description", "sequence").collect())
    assert got == WANT
    spark.dataSource.register(fasta.FastaSource)
    got = sorted(tuple(r) for r in spark.read.format("fasta").load(proteomes).collect())
    assert [(f, p, n, d, s.replace(" ", "")) for f, p, n, d, s in got] == WANT
    items, groups = fasta.load_items(fasta.read_records(spark, proteomes))
    assert [(r["name"], r["first"], r["stop"]) for r in groups.orderBy("grp").collect()] == [("a", 0, 1), ("b", 1, 4)]
    assert sorted(r["item"] for r in items.collect()) == [0, 1, 2, 3]


def test_fasta_opens_what_is_asked_for(spark, tmp_path):
    for k, names in (("x", "ab"), ("y", "ac")):
        for n in names:
            os.makedirs(tmp_path / k, exist_ok=True)
            write(tmp_path / k / f"{n}.faa", f">{k}{n}1 d\nMK\n>{k}{n}2\nLV\n>{k}{n}1\nAA\n")
    every = fasta.read_records(spark, str(tmp_path), sets=True)
    assert {r.file for r in every.collect()} == {"x/a.faa", "x/b.faa", "y/a.faa", "y/c.faa"}
    some = fasta.read_records(spark, str(tmp_path), sets=True, only=["y"])
    assert {r.file for r in some.collect()} == {"y/a.faa", "y/c.faa"} and len(some.inputFiles()) == 2
    one = fasta.read_records(spark, str(tmp_path / "x"), only=["b.faa"])
    assert [r.name for r in one.orderBy("position").collect()] == ["xb1", "xb2", "xb1"] and len(one.inputFiles()) == 1
    wanted = spark.createDataFrame([("y/a.faa", "ya1"), ("x/b.faa", "xb2"), ("x/b.faa", "none")], "file string, name string")
    assert sorted((r.name, r.sequence) for r in fasta.lookup(every, wanted).collect()) == [("xb2", "LV"), ("ya1", "MK")]
    items, groups, refused = fasta.load_sets(every)
    assert refused.count() == 0 and {(r.set_name, r["name"], r.grp) for r in groups.collect()} == {("x", "a", 0), ("x", "b", 1), ("y", "a", 0), ("y", "c", 1)}
    assert sorted((r["item"], r["grp"]) for r in items.join(groups.where("set_name = 'y'").select("set_id").distinct(), "set_id").collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)]


def test_fasta_aborts(spark, tmp_path):
    write(tmp_path / "a.fa", ">x\nMM\n")
    with pytest.raises(ValueError, match="two groups"):
        fasta.load_items(fasta.read_records(spark, str(tmp_path)))
    write(tmp_path / "a.faa", ">x\nMM\n")
    with pytest.raises(ValueError, match="stem"):
        fasta.load_items(fasta.read_records(spark, str(tmp_path)))


def test_text_readers(spark, tmp_path):
    h = write(tmp_path / "h.tsv", "1\t2\t99.5\t10\t20\t30\t0\t1e-9\t55\n3\t4\tshort\n5\t6\t80\t1\t2\t3\t4\t0.5\t6\textra\n")
    assert [(r.q, r.evalue, r.score) for r in tables.read_hits(spark, h).orderBy("line").collect()] == [(1, 1e-9, 55.0), (5, 0.5, 6.0)]
    m = write(tmp_path / "m.tsv", "genome\tA\tB\nA\t100.0\tNA\nB\tnan\t100.0\n")
    assert {(r.row, r.col): r.value for r in tables.read_matrix(spark, m).collect()} == {("A", "A"): 100.0, ("A", "B"): None, ("B", "A"): None, ("B", "B"): 100.0}
    p = write(tmp_path / "p.tsv", "genome\tg0\tg1\nA\t1\t0\nB\tx\tNA\n")
    assert sorted(map(tuple, tables.read_presence(spark, p).collect())) == [("A", "g0"), ("B", "g0")]
    t1, t2 = write(tmp_path / "t1", "RS_GCF_1.1\td__B;g__Xa;s__y\n"), write(tmp_path / "t2", "GB_GCA_2.1\td__A;g__;s__\nbad\n")
    from kinfold.functions.scalars import genus_of_lineage

    tax = tables.read_taxonomy(spark, [t1, t2]).withColumn("g", genus_of_lineage(F.col("lineage")))
    assert sorted((r.accession, r.g) for r in tax.collect()) == [("GCA_2.1", None), ("GCF_1.1", "Xa")]
    row = ["GCF_9.1"] + [""] * 34 + ["7"]
    row[19] = "na"
    a = write(tmp_path / "a.txt", "# c\n" + "\t".join(row) + "\nshort\trow\n")
    assert [(r.accession, r.ftp_path, r.protein_genes) for r in tables.read_assemblies(spark, a).collect()] == [("GCF_9.1", None, "7")]
    f = tmp_path / "f.txt.gz"
    cds = ["CDS"] + [""] * 18
    cds[10], cds[15], cds[18] = "P1", "G1", "12"
    f.write_bytes(gzip.compress(("\t".join(cds) + "\n" + "\t".join(["gene"] + [""] * 18) + "\n").encode()))
    assert [tuple(r) for r in tables.read_features(spark, str(f)).collect()] == [("P1", "G1", 12)]
    s = write(tmp_path / "s.txt", "genomes: 5\nproteins: 25,697\n")
    r = tables.read_report(spark, s, {"genomes": r"genomes: ([\d,]+)", "proteins": r"proteins: ([\d,]+)"}).first()
    assert (r.genomes, r.proteins) == (5, 25697)
    x = write(tmp_path / "rec3.txt", "a\nPHI (Normal):  0.01\nPHI (Normal): 0.9\n")
    y = write(tmp_path / "rec4.txt", "PHI (Normal): --\n")
    assert sorted(map(tuple, tables.read_phi(spark, [x, y]).collect())) == [(3, 0.01), (4, None)]
    z = write(tmp_path / "z.tsv", "title\nbin\tn\n1\t5\n2\t3\n# end\nx\ty\nbin\tn\n9\t9\n")
    assert [(r.section, r.fields) for r in tables.read_sections(spark, z, "bin").collect()] == [(1, ["1", "5"]), (1, ["2", "3"]), (2, ["9", "9"])]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("A", "A", 100.0), ("A", "B", None), ("B", "A", None), ("B", "B", 100.0)], "ga string, gb string, aai double")
    assert [tuple(r) for r in reports.as_matrix(cells, ["A", "B"]).orderBy("genome").collect()] == [("A", "100.00", "NA"), ("B", "NA", "100.00")]
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, None, ["x", "y"])], "a int, b string, c array<string>")
    reports.write_table(df, out)
    text = "".join(open(os.path.join(out, n)).read() for n in os.listdir(out) if n.startswith("part"))
    assert text == "a\tb\tc\n1\tNA\tx y\n"
    with pytest.raises(Exception, match="exist"):
        reports.write_table(df, out)
    seqs = spark.createDataFrame([("g1", 1, "MK"), ("g0", 0, "AA")], "name string, n int, sequence string")
    reports.write_fasta(seqs, str(tmp_path / "f"), F.col("name"), ["n"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "f")).collect()) == [">g0", ">g1", "AA", "MK"]
    reports.write_parts(seqs, str(tmp_path / "w"), "name", ["n"], F.col("sequence"))
    assert sorted(x for x in os.listdir(tmp_path / "w") if "=" in x) == ["name=g0", "name=g1"]
    up = str(tmp_path / "u")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    reports.upsert_table(spark, up, old, "k")
    reports.upsert_table(spark, up, spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int"), "k")
    assert sorted(map(tuple, spark.read.parquet(up).collect())) == [("a", 1), ("b", 5), ("c", 6)]


def test_survey_state_and_stream(spark, tmp_path):
    schema = "genus string, n_species int, state string, attempts int, started_utc string, updated_utc string, wall_seconds int, note string"
    rows = [("A", 3, "done", 1), ("B", 2, "running", 1), ("C", 1, "failed", 2), ("D", 2, "pending", 0)]
    status = spark.createDataFrame([(*r, None, None, None, None) for r in rows], schema)
    assert [r.genus for r in survey.todo(status).collect()] == ["B", "D"]
    assert [r.genus for r in survey.todo(status, retry_failed=True).collect()] == ["C", "B", "D"]
    moved = survey.advance(status, "D", "fetching", F.lit("t"))
    assert [(r.state, r.attempts, r.started_utc) for r in moved.where("genus = 'D'").collect()] == [("fetching", 1, "t")]
    assert moved.count() == 4
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, 1, 2, 60.0), (1, 3, 4, 10.0)], "set_id long, q long, s long, pident double").write.parquet(src)
    for _ in range(2):  # a second run finds nothing new
        q = survey.collect_hits(survey.hits_stream(spark, src, "set_id long, q long, s long, pident double"), str(tmp_path / "out"), str(tmp_path / "cp"), F.col("pident") > 50)
        q.awaitTermination()
    assert [(r.set_id, r.q) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, 1)]


def test_numbering_and_transposed(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.n for r in numbered(df, ["k"], "n").collect()}
    assert got == {k: k + 1 for k in range(1000)}
    parts = spark.createDataFrame([("r1", 1, "a"), ("r1", 0, "b"), ("r2", 1, "c")], "r string, c int, v string")
    got = {x.r: (x.cells, x.complete) for x in relational.transposed(parts, "r", "c", "v", parts).collect()}
    assert got == {"r1": (["b", "a"], True), "r2": (["c"], False)}


def test_hit_lines_keep_the_order_of_a_file_of_many_splits(spark, tmp_path):
    h = tmp_path / "h.tsv"
    h.write_text("".join(f"{i}\t{i + 1}\t60.0\t9\t9\t9\t0\t1e-9\t50.0\n" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        hits = tables.read_hits(spark, f"file://{h}")
        assert hits.rdd.getNumPartitions() > 3
        assert [r.q for r in hits.orderBy("line").collect()] == list(range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
