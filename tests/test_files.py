"""Data sources against plain reading: ranges of every size, mixed encodings, odd lines, workbooks written by the test."""

import os
import random
import zipfile
from xml.sax.saxutils import escape

import pytest

from metaspan.sources import files, readers, sheets, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
@pytest.mark.parametrize("size", [1, 5, 33, 1000])
def test_ranges_hold_every_line_once(tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(files, "BLOCK", block)
    rnd = random.Random(size * block)
    lines = ["head,er"] + ["x" * rnd.randint(0, 40) for _ in range(60)]
    for end in ("", "\n"):
        path = tmp_path / f"f{len(end)}"
        content = ("\n".join(lines) + end).encode()
        path.write_bytes(content)
        got = b""
        with open(path, "rb") as file:
            for at in range(0, len(content), size):
                got += b"".join(files._lines(file, at, min(at + size, len(content))))
        assert got == content.split(b"\n", 1)[1]


def test_mixed_encodings_in_small_ranges(spark, tmp_path):
    rnd = random.Random(1)
    want = []
    for name, encoding in (("a.csv", "utf-8"), ("b.csv", "cp949"), ("c.csv", "utf-8-sig"), ("d.csv", "euc-kr")):
        # an ASCII head leaves the encoding open; the ranges behind it decide
        own = [(f"{'x' if k < 20_000 else rnd.choice(['김', '박하늘', 'y'])}", str(k)) for k in range(20_300)]
        (tmp_path / name).write_bytes(("name,n\r\n" + "".join(f"{a},{b}\r\n" for a, b in own)).encode(encoding))
        want += [(a, b, name) for a, b in own]
    spark.dataSource.register(files.FlatFiles)
    df = spark.read.format("flat_files").option("suffix", ".csv").option("range", 10_000).load(str(tmp_path)).select("name", "n", "file_name")
    assert rows(df) == sorted(want, key=repr)
    assert df.rdd.getNumPartitions() > 60


def test_odd_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a, b ,,a\n1,2,3,4\n5\n\n6,7,8,9,10\n"x, ""y""",NA,,\n')
    path = str(tmp_path / "a.csv")
    df = readers.read_csv(spark, path)
    assert df.columns == ["a", "b", "_c2", "a_1"]
    assert rows(df) == sorted([("1", "2", "3", "4"), ("5", None, None, None), ("6", "7", "8", "9"), ('x, "y"', None, None, None)], key=repr)
    assert rows(readers.read_csv(spark, path, skip_bad=True)) == sorted([("1", "2", "3", "4"), ('x, "y"', None, None, None)], key=repr)


def test_empty_and_undecodable_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("k,v\n")
    assert rows(readers.read_directory(spark, str(tmp_path)).select("k", "v")) == []
    (tmp_path / "bad.csv").write_bytes(b"k\n\xff\xff\xff\n")
    with pytest.raises(Exception, match="none of the encodings"):
        readers.read_directory(spark, str(tmp_path)).collect()


def book(path, sheets, shared):
    """A workbook with the parts that a spreadsheet program writes."""
    index = {s: k for k, s in enumerate(shared)}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(ref, v):
        if v in index:
            return f'<c r="{ref}" t="s"><v>{index[v]}</v></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        items = "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>hint</t></rPh></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")
        for k, lines in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j) if j < 26 else 'A' + chr(39 + j)}{i}", v) for j, v in enumerate(line) if v is not None) + "</row>" for i, line in enumerate(lines, 1) if line is not None)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    wide = [f"c{k}" for k in range(30)]
    first = [["name ", "n", "flag", None, "last"], ["김 & <b>", 1, True, None, "x"], None, [None, 2.5, False, None, "NA"], ["inline", None, None, None, None]]
    book(tmp_path / "a.xlsx", {"one": first, "wide": [wide, [k if k % 2 else None for k in range(30)]]}, ["name ", "김 & <b>", "x"])
    df = readers.read_excel(str(tmp_path / "a.xlsx"), spark)
    assert df.columns == ["name", "n", "flag", "_c3", "last"]
    none = (None,) * 5
    assert rows(df) == sorted([("김 & <b>", "1", "TRUE", None, "x"), none, (None, "2.5", "FALSE", None, None), ("inline", None, None, None, None)], key=repr)
    second = readers.read_excel(str(tmp_path / "a.xlsx"), spark, "wide")
    assert second.columns == wide and second.first()[:] == tuple(str(k) if k % 2 else None for k in range(30))


def test_large_workbook_is_streamed(tmp_path):
    lines = [["k", "v"]] + [[k, f"v{k}"] for k in range(20_000)]
    book(tmp_path / "b.xlsx", {"s": lines}, [])
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        got = [*files.sheet_rows(z, files.sheets_of(z)["s"])]
    assert got == [["k", "v"]] + [[str(k), f"v{k}"] for k in range(20_000)]


@pytest.mark.parametrize("encoding, text", [("EUC-KR", "고객"), ("x-windows-949", "고객 똠")])
def test_flat_files_in_legacy_encodings(spark, tmp_path, encoding, text):
    path = str(tmp_path / "out")
    writers.write_csv(spark.createDataFrame([(1, text), (2, None)], "k int, v string"), path, encoding=encoding)
    assert rows(readers.read_csv(spark, path)) == sorted([("1", text), ("2", None)], key=repr)
    writers.write_csv(spark.createDataFrame([(3, "é ﬁ")], "k int, v string"), path, append=True)
    assert rows(readers.read_directory(spark, path).select("k", "v")) == sorted([("1", text), ("2", None), ("3", "é ﬁ")], key=repr)
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        writers.write_csv(spark.createDataFrame([(1, "ﬁ")], "k int, v string"), path, encoding=encoding)
    with pytest.raises(ValueError, match="byte-order mark"):
        writers.write_csv(spark.createDataFrame([(1, "x")], "k int, v string"), path, mark=True, encoding=encoding)


ODD = [" a ", "", "<&>\"'", "two\nlines", "carriage\rreturn", "\x00\x1f￾", "_x0041_", "_x005F_", "김 😀", "_", "x" * sheets.CELL]


def test_workbooks_give_back_what_was_written(spark, tmp_path):
    path = str(tmp_path / "books")
    schema = "text string, n long, f double, d decimal(9,2), b boolean, l array<int>"
    data = [(t, k, k / 4, None, k % 2 == 0, [k]) for k, t in enumerate(ODD)] + [(None, None, float("nan"), None, None, None), ("min", -(2**63), -1e300, None, None, [])]
    df = spark.createDataFrame(data, schema).repartition(3)
    writers.write_excel(df, path)
    got = rows(readers.read_excel(path, spark))
    text = lambda v: None if v is None or v in readers.NULL_TOKENS else v
    want = [(text(t), None if n is None else str(n), text(str(f)), None, None if b is None else str(b).upper(), None if a is None else f"[{','.join(map(str, a))}]") for t, n, f, _, b, a in data]
    assert got == sorted(want, key=repr)
    writers.write_excel(df.limit(1), path, append=True)
    assert readers.read_excel(path, spark).count() == len(data) + 1
    writers.write_excel(df.where("n < 0").toDF("t", "n", "f", "d", "b", "l"), path)
    assert readers.read_excel(path, spark).select("t", "n").collect() == [("min", str(-(2**63)))]
    writers.write_excel(df.limit(0), path)
    empty = readers.read_excel(path, spark)
    assert empty.columns == df.columns and empty.count() == 0
    assert [f for f in os.listdir(path) if f.startswith(".")] == []


def test_long_tables_become_more_workbooks(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.dataSource.register(files.Workbook)
    spark.range(0, 25, 1, 2).selectExpr("id", *[f"id + {k} AS c{k}" for k in range(30)]).write.format("workbook").option("rows", 5).mode("overwrite").save(path)
    books = sorted(os.listdir(path))
    assert len(books) == 3 + 4  # 12 and 13 rows, four to a sheet below its header
    df = readers.read_excel(path, spark)
    assert rows(df.select("id", "c29")) == sorted([(str(k), str(k + 29)) for k in range(25)], key=repr)
    assert sheets.letters_of(0) == "A" and sheets.letters_of(25) == "Z" and sheets.letters_of(26) == "AA" and sheets.letters_of(702) == "AAA"


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "kept")
    writers.write_excel(spark.createDataFrame([("a",)], "v string"), path)
    with pytest.raises(Exception, match="a workbook's cell holds"):
        writers.write_excel(spark.createDataFrame([("b",), ("x" * (sheets.CELL + 1),)], "v string").repartition(2), path)
    assert rows(readers.read_excel(path, spark)) == [("a",)]
