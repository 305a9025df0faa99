import os
import time

import pytest
from pyspark.sql import functions as F

from duocount import ComparisonSpec
from duocount.functions.attributes import parse_attributes, widen_attributes
from duocount.sources import coordinates as CO
from duocount.sources import scores as SC
from duocount.sources.store import load_comparison, save_comparison
from duocount.streaming.landing import (REFUSED, ingest_available, ingest_coordinates_available, landed, landing_log,
                                         landing_schema)

GFF = ("#gff-version 3\n#second header\n"
       "1\ttnseq\tmisc_feature\t7212\t7212\t5\t.\t.\tnote=a#b;\n"
       "# mid comment\n"
       "1\ttnseq\tmisc_feature\t7300\t7300\t.\t.\t.\tnote=insertion;\n"
       "bad line\n"
       "2\ttnseq\tmisc_feature\t10\t10\tx\t.\t.\tnote=insertion;\n"
       "# tail\n")


def write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_read_coordinates_comment_modes_and_corrupt(spark, tmp_out):
    p = write(os.path.join(tmp_out, "a.gff"), GFF)
    inline = CO.read_coordinates(spark, p, comment="inline")
    rows = inline.where(F.col("_corrupt").isNull()).orderBy("seq_id", "start").collect()
    assert [(r.seq_id, r.start, r.attributes) for r in rows] == [("1", 7212, "note=a"), ("1", 7300, "note=insertion;"),
                                                                 ("2", 10, "note=insertion;")]
    assert inline.where(F.col("_corrupt").isNotNull()).count() == 1
    line = CO.read_coordinates(spark, p, comment="line").where("start = 7212").first()
    assert line.attributes == "note=a#b;"  # kept in line mode (Q7)
    bad = CO.unreadable_scores(inline.where(F.col("_corrupt").isNull())).first()
    assert bad.unreadable_scores == 1  # 'x' is neither '.' nor a number (Q12)


def test_header_and_roundtrip(spark, tmp_out):
    p = write(os.path.join(tmp_out, "b.gff"), GFF)
    h = CO.read_header(spark, p).orderBy("line_no").collect()
    assert [r.text for r in h] == ["#gff-version 3", "#second header"]
    coords = CO.read_coordinates(spark, p).where(F.col("_corrupt").isNull())
    out = os.path.join(tmp_out, "out")
    CO.write_coordinates(coords, out, CO.read_header(spark, p))
    lines = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert lines.startswith("#gff-version 3\n#second header\n1\ttnseq")
    back = CO.read_coordinates(spark, out + "/part-*")
    assert back.count() == 3


def test_header_reads_the_start_of_a_file_only(spark, tmp_out):
    import gzip

    os.makedirs(tmp_out, exist_ok=True)
    long_comment = "#" + "x" * 200_000
    cases = {"plain.gff": ("#a\n\n#b\n1\tdata\n#below\n", [(1, "#a"), (3, "#b")]), "none.gff": ("1\tdata\n#below\n", []),
             "only.gff": ("#a\r\n#b", [(1, "#a"), (2, "#b")]), "empty.gff": ("", []),
             "long one.gff": (long_comment + "\n#z\n" + "d" * 300_000 + "\n#below\n", [(1, long_comment), (2, "#z")])}
    for name, (text, _) in cases.items():
        write(os.path.join(tmp_out, name), text)
    with gzip.open(os.path.join(tmp_out, "packed.gff.gz"), "wt") as f:
        f.write("#p\n1\tdata\n")
    cases["packed.gff.gz"] = ("", [(1, "#p")])
    got = {}
    for r in CO.read_header(spark, tmp_out, "*.gff*").collect():
        got.setdefault(r.file_path.split("/")[-1].replace("%20", " "), []).append((r.line_no, r.text))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in cases.items() if v}
    # 64 MB of data below a header: about one piece is read
    big = os.path.join(tmp_out, "big.txt")
    with open(big, "w") as f:
        f.write("#h\n" + ("1\tx\t" + "y" * 1000 + "\n") * 64_000)
    with open("/proc/self/io") as f:
        before = int(f.readline().split()[1])
    assert list(CO._header_lines("file://" + big)) == [(1, "#h")]
    with open("/proc/self/io") as f:
        assert int(f.readline().split()[1]) - before < 4 * CO.HEADER_PIECE


SCORES = ("seq_id,locus_tag,type,gene,start_pos,end_pos,feat_length,product,S_NIM_score,S_NRM_score,rep1_MP_control\n"
          "1,L1,CDS,,1,10,10,p1,1.5,NaN,3\n"
          "1,,CDS,g,20,30,11,p2,2.0,1.0,4\n"
          ",,,,,,,,,,\n")


def test_read_scores_nan_and_missing_locus(spark, tmp_out):
    p = write(os.path.join(tmp_out, "s_control.csv"), SCORES)
    df = SC.read_scores(spark, p)
    assert df.count() == 2  # all-null row dropped (F01)
    r = df.where("locus_tag = 'L1'").first()
    assert r.gene is None and r.S_NRM_score is None and r.start_pos == 1
    assert SC.drop_missing_locus(df).count() == 1  # F02
    files = SC.discover(spark, tmp_out, "*.csv").collect()
    assert len(files) == 1 and files[0].condition == "control"


def test_save_load_export(spark, tmp_out):
    df = spark.createDataFrame([("r1", "A", 1.0), ("r2", "B", 2.0)], "run_id string, locus_tag string, fold_change double")
    spec = ComparisonSpec(run_cols=("run_id",), metrics=("fold_change",))
    save_comparison(df, spec, os.path.join(tmp_out, "saved"))
    back, spec2 = load_comparison(spark, os.path.join(tmp_out, "saved"))
    assert spec2 == spec and back.count() == 2
    SC.export_table(df, os.path.join(tmp_out, "exp"), readable_headers=True)
    got = spark.read.option("header", True).csv(os.path.join(tmp_out, "exp"))
    assert "fold change" in got.columns


def test_landing_ingest_counts_each_file_once(spark, tmp_out):
    land = os.path.join(tmp_out, "landing")
    os.makedirs(land)
    table, ckpt = os.path.join(tmp_out, "table"), os.path.join(tmp_out, "ckpt")
    schema = landing_schema(["S_NIM_score", "S_NRM_score", "rep1_MP_control"])
    write(os.path.join(land, "a_control.csv"), SCORES)
    ingest_available(spark, land, table, ckpt, schema)
    assert spark.read.parquet(table).count() == 1  # null locus dropped
    ingest_available(spark, land, table, ckpt, schema)
    assert spark.read.parquet(table).count() == 1  # same file not ingested twice
    write(os.path.join(land, "b_test.csv"), SCORES)
    ingest_available(spark, land, table, ckpt, schema)
    t = spark.read.parquet(table)
    assert t.count() == 2 and {r.source_file for r in t.collect()} == {"a_control.csv", "b_test.csv"}


def test_landing_refuses_a_stored_name(spark, tmp_out):
    drops, table, ckpt = (os.path.join(tmp_out, x) for x in ("drops", "table", "ckpt"))
    schema = landing_schema(["S_NIM_score", "S_NRM_score", "rep1_MP_control"])

    def drop(folder, name, text=SCORES, at=None):
        os.makedirs(os.path.join(drops, folder), exist_ok=True)
        path = write(os.path.join(drops, folder, name), text)
        if at:
            os.utime(path, (at, at))
        return path

    drop("x", "a.csv")
    ingest_available(spark, drops + "/*", table, ckpt, schema)
    drop("y", "a.csv", SCORES.replace("1.5", "9.5"))       # stored by an earlier batch
    drop("y", "b.csv", SCORES.replace("1.5", "2.5"), time.time() - 50)  # later than z/b.csv of the same batch
    drop("z", "b.csv", SCORES.replace("1.5", "3.5"), time.time() - 100)
    ingest_available(spark, drops + "/*", table, ckpt, schema)
    got = sorted((r.source_file, r.S_NIM_score) for r in landed(spark, table).collect())
    assert got == [("a.csv", 1.5), ("b.csv", 3.5)]
    log = sorted((r.source_file, r.file_path.split("/")[-2], r.stored, r.reason) for r in landing_log(spark, table).collect())
    assert log == [("a.csv", "x", True, None), ("a.csv", "y", False, REFUSED),
                   ("b.csv", "y", False, REFUSED), ("b.csv", "z", True, None)]


def test_landing_batch_run_again_stores_nothing_twice(spark, tmp_out):
    """A batch whose commit was lost runs again under its id, and overwrites its own rows and names."""
    drops, table, ckpt = (os.path.join(tmp_out, x) for x in ("drops", "table", "ckpt"))
    os.makedirs(drops)
    schema = landing_schema(["S_NIM_score", "S_NRM_score", "rep1_MP_control"])
    write(os.path.join(drops, "a.csv"), SCORES)
    ingest_available(spark, drops, table, ckpt, schema)
    os.remove(os.path.join(ckpt, "commits", "0"))
    crc = os.path.join(ckpt, "commits", ".0.crc")
    if os.path.exists(crc):
        os.remove(crc)
    ingest_available(spark, drops, table, ckpt, schema)
    assert [(r.source_file, r.S_NIM_score) for r in landed(spark, table).collect()] == [("a.csv", 1.5)]
    assert [(r.source_file, r.stored) for r in landing_log(spark, table).collect()] == [("a.csv", True)]


def test_landing_coordinates(spark, tmp_out):
    drops, table, ckpt = (os.path.join(tmp_out, x) for x in ("drops", "table", "ckpt"))
    os.makedirs(drops)
    path = write(os.path.join(drops, "a.gff"), GFF)
    for _ in range(2):
        ingest_coordinates_available(spark, drops, table, ckpt)
    got = landed(spark, table).drop("source_file").collect()
    want = CO.read_coordinates(spark, path, keep_file=False).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4


def test_parse_attributes(spark):
    df = spark.createDataFrame([("a=b=c;x;n=1;n=2;",), ("ID=7;",)], "attributes string")
    m = df.select(parse_attributes("attributes").alias("m")).collect()
    assert m[0].m == {"a": "b", "n": "2"} and m[1].m == {"ID": "7"}
    w = widen_attributes(df.select(parse_attributes("attributes").alias("attr_map")), "attr_map")
    assert sorted(w.columns) == ["ID", "a", "n"]


def test_coordinate_lines_are_read_once_for_a_profile(spark):
    from pyspark.sql import functions as F
    from duocount.operators import insertions as I
    from duocount.sources.coordinates import parse_coordinates
    read = spark.sparkContext.accumulator(0)

    def make(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    row = "s\tx\tm\t{}\t{}\t{}\t.\t.\tn=1;"
    lines = [("control", "##gff # 3"), ("control", row.format(5, 5, ".")), ("control", row.format(5, 5, ".") + "#end\t"), ("control", "  "),
             ("test", row.format(7, 7, "2.5")), ("test", row.format(7, 7, "1")), ("test", row.format("x", 9, "#.")), ("test", "a\tb"), ("test", "# a\u2028b")]
    df = spark.createDataFrame(lines, "condition string, line string").mapInPandas(make, "condition string, line string")
    coords = parse_coordinates(df, keep=["condition"])
    got = sorted(((r.condition, r.seq_id, r.position, r["count"]) for r in I.profile_from_coordinates(coords).collect()), key=str)
    assert read.value == len(lines)
    assert ("control", "s", 5, 2.0) in got and [x for x in got if x[:3] == ("test", "s", 7)] == [("test", "s", 7, 1.0), ("test", "s", 7, 2.5)]
    corrupt = sorted(r._corrupt for r in coords.collect() if r._corrupt is not None)
    assert corrupt == ["# a\u2028b", "a\tb", "s\tx\tm\tx\t9\t"]
