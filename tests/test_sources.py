import zipfile

from pyspark.sql import functions as F

from docket.operators import schema as S
from docket.sources import documents, tabular


def test_headers():
    assert tabular.canonical("  FIR   No. ") == "fir_number" and tabular.canonical("Thana") == "police_station"
    assert tabular.canonical("Weird (Header)!") == "weird_header"
    assert len(tabular.ALIASES) == 116 and len(tabular.HEADERS) == 39


def test_csv_to_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(
        'FIR No,Type of Crime,Date,Incident Date,Name of Victim,Victim Age,Weapon Used,Vehicle No\n'
        'F-1," Theft ",,2024-01-15,"O""Neil, A",34,N/A,MH 12\n\nF-2,Arson,01/02/2024,,--,x, knife ,\n'.encode("latin-1")
    )
    rows, warnings = tabular.extract_rows(tabular.read_table(spark, str(path)))
    assert warnings == ["2 columns are named 'incident_date'"]
    got = tabular.rows_to_records(rows, "a.csv").orderBy("fir_number").collect()
    assert [r.crime_type for r in got] == ["Theft", "Arson"]
    assert [str(r.incident_date) for r in got] == ["2024-01-15", "2024-02-01"]
    assert got[0].victims[0].name == 'O"Neil, A' and got[0].victims[0].age == 34 and got[1].victims == []
    assert got[0].weapons == [] and got[1].weapons[0].weapon_name == "knife"
    assert got[0].vehicles[0].registration_number == "MH 12" and got[1].vehicles == []
    assert [f.name for f in S.RECORD.fields] == list(got[0].asDict())


def test_encodings(spark, tmp_path):
    late = b"FIR No,Details\n" + b"1,x\n" * 300_000 + "2,caf\xe9\n".encode("latin-1")
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_bytes("FIR No,Details\n7,é😀\n".encode())
    (tmp_path / "many" / "b.csv").write_bytes(late)
    got = tabular.read_csv(spark, str(tmp_path / "many")).where("Details <> 'x'").collect()
    assert sorted((r["FIR No"], r.Details) for r in got) == [("2", "café"), ("7", "é😀")]
    (tmp_path / "b.csv").write_bytes("FIR No,Details\n1,caf\xe9\n".encode("latin-1"))
    assert tabular.read_csv(spark, str(tmp_path / "b.csv")).first().Details == "café"


def test_large_files_are_read_in_ranges(spark, tmp_path):
    """The only bad byte is in the last range of a file that many tasks read; characters may lie across range ends."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        folder = tmp_path / "l a"
        folder.mkdir()
        lines = "".join(f"{i},日本語é😀\n" for i in range(40_000)).encode()
        (folder / "good.csv").write_bytes(b"FIR No,Details\n" + lines)
        (folder / "bad.csv").write_bytes(b"FIR No,Details\n" + lines + b"x,caf\xe9\n")
        (folder / "quoted.csv").write_bytes(b'FIR No,Details\n1,"two\nlines"\n')
        (folder / "empty.csv").write_bytes(b"")
        traits = {r.path.rsplit("/", 1)[1]: (r.encoding, r.multi_line) for r in tabular.file_traits(spark, str(folder)).collect()}
        assert traits == {"good.csv": ("utf-8", False), "bad.csv": ("latin-1", False), "quoted.csv": ("utf-8", True)}
        read = tabular.read_csv(spark, str(folder))
        assert read.rdd.getNumPartitions() > 20 and read.count() == 80_002
        found = {r.Details for r in read.where("Details not like '%日%' and Details not like '%ð%'").collect()}
        assert found == {"café", "two\nlines"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_xlsx(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>FIR No</t></si><si><r><t>The</t></r><r><t>ft</t></r></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Crime Type</t></is></c></row>'
            '<row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>1</v></c></row><row/></sheetData></worksheet>',
        )
    rows = tabular.read_table(spark, str(tmp_path / "a.xlsx")).collect()
    assert len(rows) == 1 and rows[0]["FIR No"] == "7" and rows[0]["Crime Type"] == "Theft"


def test_first_sheet_is_the_workbooks(tmp_path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="{rel}"><sheets><sheet r:id="r2"/><sheet r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="p"><r Id="r1" Target="worksheets/sheet1.xml"/><r Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>')
        assert tabular.first_sheet(z) == "xl/worksheets/sheet2.xml"


def test_article_text():
    page = "<head><title>t</title><style>p</style></head><body><nav><p>menu</p></nav><p>out</p><article><h1> A&amp;B </h1><p>one<p>two <b>x</b><ul><li><p>in</p></li></ul><form><p>f</p></form></article></body>"
    assert documents.article_text(page) == "A&B\n\none\n\ntwo x\n\nin\n\nin"
    assert documents.article_text("<main><p>m</p></main><p>x</p>") == "m"
    assert documents.article_text("<body>just text</body>") == "just text"
    assert documents.article_text("") == documents.article_text(None) == ""


def test_pages_and_boxes(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, "")], "doc_id long, page int, text string")
    assert {r.doc_id: r.text for r in documents.join_pages(pages).collect()} == {1: "a\n\nb", 2: ""}
    layers = spark.createDataFrame([(["x" * 20, " " * 9, "y" * 29, "z" * 99],), (["x" * 20, "", "y" * 30],)], "p array<string>")
    assert [r.d for r in layers.select(documents.has_text_layer(F.col("p")).alias("d")).collect()] == [False, True]
    boxes = spark.createDataFrame([([("a", 0.5), (" ", 0.1), ("b", 1.0)],), ([(" ", 0.1)],)], "b array<struct<text:string,confidence:double>>")
    got = [r.x for r in boxes.select(documents.box_text(F.col("b")).alias("x")).collect()]
    assert [(x.text, x.confidence) for x in got] == [("a b", 0.75), ("", None)]


def test_replies(spark):
    replies = ['{"crime_type": "Theft", "victims": null, "zzz": 1}', '```json\n{"fir_number": "F"}\n```', "{", " ", None, '{"confidence_score": "high"}', '{"incident_date": "2024-01-02", "victims": [{"name": "A", "age": 3}]}']
    frame = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = [r.p for r in frame.select("i", documents.parse_reply(F.col("reply")).alias("p")).orderBy("i").collect()]
    assert [p.error for p in got] == [None, None, "json", "empty", "empty", "schema", None]
    assert got[0].record.crime_type == "Theft" and got[1].record.fir_number == "F" and got[6].record.victims[0].age == 3


def test_injected_reader(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one|two")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.bin"))
    pages = documents.apply_reader(files, lambda content: content.decode().split("|"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(0, "one"), (1, "two")]
