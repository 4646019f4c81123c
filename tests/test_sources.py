import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from attestra.sources import cards, files, workbook
from attestra.streaming import stream


def book(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>age</t></si><si><t>A1</t></si></sst>")
        head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData>{head}<row r="2"><c r="A2" t="s"><v>2</v></c></row><row r="3"><c r="B3"><v>40</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData>{head}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    book(path)
    assert [n for n, _ in workbook.sheets(path)] == ["One", "Two"]
    assert [tuple(r) for r in files.read_table(spark, path).collect()] == [("A1", None), (None, "40")]
    assert files.read_table(spark, path, "Two").count() == 0


def test_text_tables_hashes_and_cards(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "b.tsv").write_text("id\tv\n1\t2\n")
    (tmp_path / "c.bin").write_bytes(b"x")
    assert files.read_table(spark, str(tmp_path / "a.csv")).columns == files.read_table(spark, str(tmp_path / "b.tsv")).columns == ["id", "v"]
    with pytest.raises(ValueError, match="unsupported"):
        files.read_table(spark, str(tmp_path / "c.bin"))
    assert cards.file_hashes(spark, str(tmp_path), "*.bin").first()["sha256"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_cards_of_all_kinds_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"two\nlines"\n\n3,4\n')
    (tmp_path / "b.tsv").write_text("id\tv\n1\t2\n")
    (tmp_path / "d.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    (tmp_path / "e.jsonl").write_text("{broken\n")
    (tmp_path / "f.xlsx").write_bytes(b"no zip")
    (tmp_path / "g.csv").write_text("")
    (tmp_path / "h.csv").write_bytes(b"a\xff\n1\n")
    (tmp_path / "c.bin").write_bytes(b"x")
    book(str(tmp_path / "w.xlsx"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next(str(f) for f in (tmp_path / "p").iterdir() if f.suffix == ".parquet")
    names = ["a.csv", "b.tsv", "c.bin", "d.jsonl", "e.jsonl", "f.xlsx", "g.csv", "h.csv", "w.xlsx", "gone.csv"]
    rows = [(n, f"file://{tmp_path}/{n}" if n == "a.csv" else str(tmp_path / n), ["id", "age", "zz"]) for n in names] + [("p", part, None)]
    got = {r["artifact_id"]: r for r in cards.file_cards(spark.createDataFrame(rows, "artifact_id string, path string, selected_columns array<string>")).collect()}
    shape = lambda n: [(t["sheet_name"], t["rows"], t["columns"], t["column_names"]) for t in got[n]["structure"]]
    assert shape("a.csv") == [(None, 2, 2, ["id", "v"])] and shape("b.tsv") == [(None, 1, 2, ["id", "v"])] and shape("d.jsonl") == [(None, 2, 1, ["k"])]
    assert shape("w.xlsx") == [("One", 2, 2, ["id", "age"]), ("Two", 0, 2, ["id", "age"])] and shape("p") == [(None, 7, 1, ["id"])] and shape("g.csv") == [(None, 0, 0, [])]
    failed = {n: r["error_type"] for n, r in got.items() if r["parser_status"] == "failed"}
    assert failed == {"c.bin": "ValueError", "e.jsonl": "JSONDecodeError", "f.xlsx": "BadZipFile", "h.csv": "UnicodeDecodeError", "gone.csv": "FileNotFoundError"}
    assert got["w.xlsx"]["missing_requested_columns"] == ["zz"] and got["a.csv"]["missing_requested_columns"] == ["age", "zz"] and got["p"]["missing_requested_columns"] == []
    for n in ("a.csv", "f.xlsx", "c.bin"):
        data = (tmp_path / n).read_bytes()
        assert (got[n]["source_sha256"], got[n]["source_size"], got[n]["card_id"]) == (hashlib.sha256(data).hexdigest(), len(data), f"file:{n}")
    assert got["gone.csv"]["source_sha256"] is None


def test_a_manifest_of_a_thousand_files_is_one_job(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"t{i}.csv").write_text("a,b\n" + "1,2\n" * (i % 7))
    manifest = spark.createDataFrame([(f"t{i}", str(tmp_path / f"t{i}.csv")) for i in range(1000)], "artifact_id string, path string")
    spark.sparkContext.setJobGroup("manifest", "cards")
    try:
        found = cards.structures(manifest).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("manifest")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["artifact_id"]: r["rows"] for r in found} == {f"t{i}": i % 7 for i in range(1000)}
    # adaptive execution runs the exchange and what follows as two jobs
    assert len(jobs) <= 2


def test_a_file_beyond_two_gigabytes_is_hashed_in_chunks(spark, tmp_path):
    size = 3 * 1024**3
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size)
    want = hashlib.sha256()
    zeros = bytes(1 << 24)
    for _ in range(size >> 24):
        want.update(zeros)
    got = cards.file_hashes(spark, str(tmp_path)).first()
    assert (got["length"], got["sha256"]) == (size, want.hexdigest())


def test_shards_and_summaries(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"shard_{k:03d}.jsonl").write_text("".join(f'{{"case_id": "c{i}"}}\n' for i in range(k, 9, 3)))
    (tmp_path / "other.jsonl").write_text('{"case_id": "no"}\n')
    got = files.read_shards(spark, str(tmp_path), "case_id string").collect()
    assert {(r["case_id"], r["shard"]) for r in got} == {(f"c{i}", f"shard_{i % 3:03d}") for i in range(9)}
    assert files.summary_json(spark.createDataFrame([(2, "x")], "b int, a string")) == '{\n  "a": "x",\n  "b": 2\n}'


def test_jsonl_keeps_nulls_and_sorts_keys(spark, tmp_path):
    df = spark.createDataFrame([(2, None)], "b int, a string")
    files.write_jsonl(df, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first()[0] == '{"a":null,"b":2}'
    (tmp_path / "m.yaml").write_text("artifacts:\n- path: ${ROOT}/a\n")
    assert files.read_manifest(str(tmp_path / "m.yaml"), {"ROOT": "/r"}) == {"artifacts": [{"path": "/r/a"}]}
    with pytest.raises(ValueError, match="ROOT"):
        files.read_manifest(str(tmp_path / "m.yaml"))
    assert files.markdown(df, "T").splitlines()[2] == "| b | a |"


def test_square_matrices_only(spark, tmp_path):
    rows = [(p, str(p), i, j, float(i * 10 + j)) for p in (0, 1) for i in range(3) for j in range(3)]
    spark.createDataFrame(rows, "pos int, analysis_id string, i int, j int, value double").write.parquet(str(tmp_path / "f"))
    assert files.read_features(spark, str(tmp_path / "f")).filter("pos = 0").first()["vec"] == [10.0, 20.0, 21.0]
    spark.createDataFrame(rows[:-1], "pos int, analysis_id string, i int, j int, value double").write.parquet(str(tmp_path / "g"))
    with pytest.raises(ValueError, match="square"):
        files.read_features(spark, str(tmp_path / "g"))


def test_stream_drops_what_is_too_late(spark, tmp_path):
    def put(*times):
        spark.createDataFrame([(t, "a") for t in times], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").write.mode("append").parquet(str(tmp_path / "in"))

    put("2024-01-01 10:00:00", "2024-01-01 11:00:00")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        events = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
        stream.run_available(stream.windowed_counts(events, "ts", ["k"]), out, check)

    run()
    put("2024-01-05 00:00:00")
    run()
    put("2024-01-01 12:00:00", "2024-01-09 00:00:00")
    run()
    got = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01"] == 2
