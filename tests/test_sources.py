import json

import pytest

from orrery.sources import runs, tables, text


def test_csv_union_required_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,score\nA,1.5\nB,\n")
    (tmp_path / "b.csv").write_text("id,score,extra\nC,2,x\n")
    df = tables.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["id", "score"])
    assert sorted((r.id, r.score, r.extra) for r in df.collect()) == [("A", "1.5", None), ("B", None, None), ("C", "2", "x")]
    with pytest.raises(tables.SchemaError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), ["label"])
    (tmp_path / "c.csv").write_text("id,score\n")
    with pytest.raises(tables.SchemaError):
        tables.read_csv(spark, str(tmp_path / "c.csv"), ["id"])


def test_ism_lines_and_failure(spark, tmp_path):
    (tmp_path / "m.ism").write_text("CCO m1 x\n\nCCC m2\n")
    rows = text.read_ism(spark, str(tmp_path / "m.ism")).collect()
    assert [(r.smiles, r.source_molecule_id, r.source_extra_id, r.source_line_number) for r in rows] == [("CCO", "m1", "x", 1), ("CCC", "m2", None, 3)]
    (tmp_path / "bad.ism").write_text("CCO\n")
    with pytest.raises(Exception, match="molecule id"):
        text.read_ism(spark, str(tmp_path / "bad.ism")).collect()


PDB = """MODEL        1
ATOM      1  N   ALA A  12      11.104   6.134  -6.504  1.00 10.00           N
HETATM    2  CA AALA A  12B     -1.500   2.250   3.125  0.50 10.00
ENDMDL
MODEL        2
ATOM      3  N   ALA A  12      99.000   0.000   0.000  1.00 10.00           N
"""


def test_pdb_first_model_and_elements(spark, tmp_path):
    (tmp_path / "x.pdb").write_text(PDB)
    rows = text.lines(spark, str(tmp_path / "x.pdb"))
    atoms = text.parse_pdb(rows).orderBy("serial").collect()
    assert [(a.serial, a.atom_name, a.altloc, a.resseq, a.icode, a.x, a.occupancy, a.element) for a in atoms] == [
        (1, "N", "", 12, "", 11.104, 1.0, "N"),
        (2, "CA", "A", 12, "B", -1.5, 0.5, "C"),
    ]
    again = text.format_pdb(text.parse_pdb(rows)).collect()
    assert again[0].value.startswith("ATOM      1 N    ALA A  12      11.104   6.134  -6.504")


def test_engine_table_single_score_and_config(spark, tmp_path):
    (tmp_path / "log.txt").write_text("mode | affinity\n   1   -9.1   0.000   0.000\n   2   -8.5   1.2   2.0\nbest: -9.1\n")
    rows = text.lines(spark, str(tmp_path / "log.txt"))
    assert [(r.pose_rank, r.docking_score) for r in text.score_table(rows).orderBy("pose_rank").collect()] == [(1, -9.1), (2, -8.5)]
    assert text.single_score(rows, r"best: (-?[0-9.]+)").first().score == -9.1
    with pytest.raises(Exception, match="single score"):
        text.single_score(rows, r"worst: (-?[0-9.]+)").collect()
    (tmp_path / "c.cfg").write_text("# box\ncenter_x = 1.5 # mid\nsize=20\n")
    assert text.read_key_values(spark, str(tmp_path / "c.cfg"), ["size"]) == {"center_x": "1.5", "size": "20"}
    with pytest.raises(ValueError):
        text.read_key_values(spark, str(tmp_path / "c.cfg"), ["seed"])


def test_sinks_do_not_clobber(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0)], "id string, score double")
    more = spark.createDataFrame([("B", "x")], "id string, note string")
    tables.write_csv([df, more], str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), ["id", "score", "note"])
    assert back.count() == 2
    with pytest.raises(Exception, match="exist"):
        tables.write_csv(df, str(tmp_path / "out"))
    assert tables.write_summary(df, str(tmp_path / "s.json")) == {"id": "A", "score": 1.0}
    assert json.loads((tmp_path / "s.json").read_text())["id"] == "A"
    with pytest.raises(FileExistsError):
        tables.write_summary(df, str(tmp_path / "s.json"))
    tables.write_once(df, str(tmp_path / "once"), str(tmp_path / "marker"))
    with pytest.raises(FileExistsError):
        tables.write_once(df, str(tmp_path / "twice"), str(tmp_path / "marker"))


def test_bundles_and_manifest_are_deterministic(spark, tmp_path):
    members = {"b.txt": b"2", "a.txt": b"1"}
    one, two = tables.write_bundle(members, str(tmp_path / "1.tgz")), tables.write_bundle(dict(reversed(members.items())), str(tmp_path / "2.tgz"))
    assert one == two
    rows = tables.file_manifest(spark, str(tmp_path)).collect()
    assert {r.sha256 for r in rows} == {one}
    assert tables.config_difference({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b"]


def test_pdbqt_summary(spark, tmp_path):
    line = "ATOM      1  C   LIG A   1       0.000   0.000   0.000  1.00  0.00    {:>6} {:<2}\n"
    (tmp_path / "l.pdbqt").write_text(line.format("-0.100", "C") + line.format("0.250", "OA") + "TORSDOF 4\n")
    r = text.summarize_pdbqt(text.lines(spark, str(tmp_path / "l.pdbqt"))).first()
    assert (r.atom_count, r.charge_min, r.charge_max, r.atom_types, r.torsdof) == (2, -0.1, 0.25, "C;OA", 4)


def test_runs_are_found_and_checked(spark, tmp_path):
    import hashlib

    for name, body in (("r1", "id,score\nA,1\n"), ("r2", "id,score\nB,2\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.csv").write_text(body)
        (tmp_path / name / "summary.json").write_text(json.dumps({"csv": "t.csv", "sha256": hashlib.sha256(body.encode()).hexdigest(), "n": 1}, indent=2))
    found = runs.discover_runs(spark, str(tmp_path / "r*"))
    assert sorted((r.run, r.intact) for r in found.collect()) == [(str(tmp_path / "r1"), True), (str(tmp_path / "r2"), True)]
    assert sorted((r.id, r.score) for r in runs.load_intact(spark, found, "id string, score double").collect()) == [("A", 1.0), ("B", 2.0)]
    (tmp_path / "r2" / "t.csv").write_text("id,score\nB,3\n")
    with pytest.raises(ValueError, match="r2"):
        runs.load_intact(spark, runs.discover_runs(spark, str(tmp_path / "r*")), "id string, score double")


def test_progress_recovery_package_and_report(spark, tmp_path):
    runs.replace_json(str(tmp_path / "p.json"), {"done": 3})
    runs.replace_json(str(tmp_path / "p.json"), {"done": 4})
    assert json.loads((tmp_path / "p.json").read_text()) == {"done": 4} and not (tmp_path / "p.json.part").exists()
    assert runs.recovered(str(tmp_path / "p.json"), json.loads) == {"done": 4} and runs.recovered(str(tmp_path / "no"), json.loads) is None
    (tmp_path / "bad.json").write_text("{")
    assert runs.recovered(str(tmp_path / "bad.json"), json.loads) is None
    (tmp_path / "t.csv").write_text("id\n1\n2\n")
    assert runs.package(str(tmp_path / "x.tar.gz"), str(tmp_path), ["t.csv", "p.json"], {"t.csv": 2}) == ["p.json", "t.csv"]
    first = (tmp_path / "x.tar.gz").read_bytes()
    runs.package(str(tmp_path / "y.tar.gz"), str(tmp_path), ["p.json", "t.csv"])
    assert first == (tmp_path / "y.tar.gz").read_bytes()
    for names, rows in ((["none.csv"], None), (["t.csv"], {"t.csv": 3})):
        with pytest.raises(ValueError):
            runs.package(str(tmp_path / "z.tar.gz"), str(tmp_path), names, rows)
    assert not (tmp_path / "z.tar.gz").exists()
    text_ = runs.markdown_report("Run", {"n": 2}, spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "k string, v double"))
    assert text_.startswith("# Run\n\n- n: 2\n\n| k | v |\n|---|---|\n") and "| a\\|b | 0.5 |" in text_ and "|  | 1 |" in text_


def test_key_values_are_read_whole(spark, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"k{i} = {i} # x\n" for i in range(12_000)))
    assert len(text.read_key_values(spark, str(tmp_path / "c.txt"), ["k11999"])) == 12_000
