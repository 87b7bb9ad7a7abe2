import sqlite3

import pytest

from peakloom.operators.match import match_massifs
from peakloom.plans.analyses import analyse_samples, browse_map, build_map, store_map
from peakloom.sources import readers, writers
from peakloom.streaming.ingest import massif_stream, match_stream


def test_peak_lists_skip_what_is_not_there(spark, tmp_path):
    (tmp_path / "a.csv").write_text("M+H,rt,Area,Height,sample\n1.5,2,3,4,s\n")
    (tmp_path / "b.csv").write_text("M+H,rt,Area,Height,sample,SN\n2.5,2,3,4,t,9\n")
    (tmp_path / "c.doc").write_text("x")
    out = readers.read_peak_lists(spark, [f"{tmp_path}/{n}" for n in ("a.csv", "b.csv", "c.doc", "none.csv")])
    assert sorted((r["M+H"], r["SN"]) for r in out.collect()) == [(1.5, None), (2.5, 9)]
    assert readers.read_peak_lists(spark, [f"{tmp_path}/none.csv"]) is None


def test_massifs_need_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("M+H,CE-time\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_massifs(spark, [f"{tmp_path}/a.csv"])


def test_abundance_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ID,s1,s2\nf1,1.5,\nf2,,2.5\n")
    cells = readers.read_abundance(spark, f"{tmp_path}/m.csv")
    assert sorted(map(tuple, cells.collect())) == [("f1", "s1", 1.5), ("f2", "s2", 2.5)]
    writers.write_matrix(cells, f"{tmp_path}/out")
    back = readers.read_abundance(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_parameters_round_trip(spark, tmp_path):
    writers.write_parameters(spark, {"max charge": 8, "adducts": ["[M+H]+", "[M+Na]+"]}, f"{tmp_path}/p")
    assert readers.read_parameters(spark, f"{tmp_path}/p") == {"max charge": "8", "adducts": ["[M+H]+", "[M+Na]+"]}
    assert writers.remove_files(spark, f"{tmp_path}/p", ".txt") == 1


def test_parameters_of_many_lines(spark, tmp_path):
    (tmp_path / "p.txt").write_text("".join(f"key {i}: {i}\n" for i in range(3000)))
    assert readers.read_parameters(spark, f"{tmp_path}/p.txt")["key 2999"] == "2999"


def test_text_files_are_comma_separated(spark, tmp_path):
    (tmp_path / "a.txt").write_text("M+H,rt\n1.5,2\n")
    (tmp_path / "b.tsv").write_text("M+H\trt\n2.5\t2\n")
    assert sorted(r["M+H"] for r in readers.read_peak_lists(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.tsv"]).collect()) == [1.5, 2.5]


def test_workbooks(spark, tmp_path):
    cells = spark.createDataFrame([("f1", "s1", 1.5), ("f2", "s2", 2.5)], "feature string, sample string, x double")
    writers.write_matrix(cells, f"{tmp_path}/m.xlsx")
    assert sorted(map(tuple, readers.read_abundance(spark, f"{tmp_path}/m.xlsx").collect())) == [("f1", "s1", 1.5), ("f2", "s2", 2.5)]
    peaks = spark.createDataFrame([("a<&>\x01 é", 1, None, [1.0, 2.0], True)], "sample string, n int, x double, iso array<double>, ok boolean")
    writers.write_corrected(peaks, f"{tmp_path}/c.xlsx", {"bandwidth": 20}, cells)
    assert readers.read_sheet(spark, f"{tmp_path}/c.xlsx").first().asDict() == {"sample": "a<&> é", "n": 1.0, "x": None, "iso": "1.0,2.0", "ok": "True"}
    assert readers.read_sheet(spark, f"{tmp_path}/c.xlsx", "Sample_Info").count() == 2
    assert ("bandwidth", "20") in set(map(tuple, readers.read_sheet(spark, f"{tmp_path}/c.xlsx", "Correction_Summary").collect()))
    writers.write_corrected(peaks, f"{tmp_path}/c", {"bandwidth": 20})
    assert spark.read.csv(f"{tmp_path}/c/Corrected_Peaks", header=True).count() == 1


def test_maps_in_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "old.sqlite") as con:
        con.execute('CREATE TABLE map_ref (ID TEXT, "M.H" REAL, rt REAL, maxo REAL, "iso.mass.link" TEXT)')
        con.execute("INSERT INTO map_ref VALUES ('FT1', 500.25, 60, 10, 'x'), ('FT2', 600, 70, NULL, 'y')")
    assert readers.list_maps(spark, tmp_path.as_uri()) == ["old"]
    got = readers.read_map(spark, tmp_path.as_uri(), "old")
    assert sorted(map(tuple, got.collect())) == [("FT1", 500.25, 60.0, 10.0), ("FT2", 600.0, 70.0, None)]
    with pytest.raises(KeyError):
        readers.read_map(spark, tmp_path.as_uri(), "old", normalizers=True)
    # the file goes with its map, so a new map of that name is not hidden behind it
    assert writers.delete_map(spark, tmp_path.as_uri(), "old", confirmed=True)
    assert readers.list_maps(spark, tmp_path.as_uri()) == []
    assert writers.delete_map(spark, tmp_path.as_uri(), "old", confirmed=True) is False


def test_empty_peaks(spark):
    assert len(readers.empty_peaks(spark, external=True).columns) == 16
    assert readers.empty_peaks(spark).count() == 0


def test_map_end_to_end(spark, tmp_path):
    rows = [(i * 10 + j, f"s{j}", 400.0 + 10 * i + 0.01 * j, 600.0 + 30 * i + j, [400.0 + 10 * i + 0.01 * j + k for k in range(3)], 1000.0 * (i + 1) * (1 + 0.05 * j)) for i in range(8) for j in range(4)]
    peaks = spark.createDataFrame(rows, "peak_id long, sample string, mh double, rt double, iso array<double>, intensity double")
    frames = build_map(peaks, bandwidth=200.0, min_normalizers=5, min_density=0.0)
    store_map(frames, tmp_path.as_uri(), "m1")
    assert readers.list_maps(spark, tmp_path.as_uri()) == ["m1"]
    stored = browse_map(spark, tmp_path.as_uri(), "m1", mass=(None, 425.0))
    assert stored.count() == 3
    assert browse_map(spark, tmp_path.as_uri(), "m1", normalizers_only=True).count() == 5
    iso = spark.createDataFrame([(400.0 + 10 * i,) for i in range(8)], "m double").selectExpr("m", "array(m, m + 1, m + 2) AS ref_iso")
    ref = frames["map_ref"].join(iso, frames["map_ref"]["mh"].between(iso["m"] - 1, iso["m"] + 1)).selectExpr("id AS ref_id", "mh AS ref_mh", "rt AS ref_rt", "ref_iso", "maxo AS ref_intensity")
    samples = peaks.withColumnRenamed("peak_id", "idtab")
    out = analyse_samples(ref, samples, ref.select("ref_id"), min_iset=4)
    assert {r.percent_matched for r in out["stats"].collect()} == {100.0}
    assert out["normalized"].count() == 32
    assert writers.delete_map(spark, tmp_path.as_uri(), "m1", confirmed=False) is False
    writers.delete_map(spark, tmp_path.as_uri(), "m1", confirmed=True)
    assert readers.list_maps(spark, tmp_path.as_uri()) == []


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ["s1,1,500.02,1040,500.02;501.02,10", "s1,2,700,900,700;701,20"]
    for i, x in enumerate(lines):
        (tmp_path / "in" / f"{i}.csv").write_text("sample,idtab,mh,rt,iso,intensity\n" + x + "\n")
    ref = spark.createDataFrame([("R1", 500.0, 1000.0, [500.0, 501.0])], "ref_id string, ref_mh double, ref_rt double, ref_iso array<double>")
    q = match_stream(massif_stream(spark, f"{tmp_path}/in", 1), ref, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination()
    got = {(r.idtab, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "Matched"), (2, "No match")}
    assert match_massifs is not None
