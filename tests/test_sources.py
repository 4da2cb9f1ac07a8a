"""Manifests and context files."""

import io
import random
import zipfile
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from metadoc import fixed_values as fv
from metadoc.runtime import shared_dir
from metadoc.sources.files import (
    docx_files, file_contents, missing_sheets, text_files, workbook_files, workbook_rows, xlsx_rows, delimited_files, _cells_in,
)
from metadoc.sources.manifests import manifest_entries
from metadoc.sources.merge import load_sources, merged_sources
from metadoc.sources.tables import first_rows, table_text


def plain_entries(text):
    """(kind, name, description) of every entry, by the rules of the format."""
    found, section = [], None
    for line in map(str.strip, text.split("\n")):
        if line.startswith("#"):
            title = line.lstrip("#").lower()
            section = "archivo" if "archivo" in title else "tabla" if "tabla" in title else None
        elif section and ":" in line:
            name, purpose = line.split(":", 1)
            name, purpose = name.strip().strip("`").strip(), purpose.strip()
            right = "." in name if section == "archivo" else name.count(".") == 2
            if name and purpose and right:
                found.append((section, name, purpose))
    return found


def entries_of(spark, texts, **options):
    frame = spark.createDataFrame(list(texts.items()), "manifest string, text string")
    rows = manifest_entries(frame, **options).orderBy("manifest", "position").collect()
    return {name: [(r["kind"], r["name"], r["description"]) for r in rows if r["manifest"] == name]
            for name in texts}


def test_manifests(spark):
    rng = random.Random(3)
    pieces = ["# Archivos", "## TABLAS ", "#Notas", "### archivo y tabla", "`a.md`: texto", " ` b.txt ` : x: y ",
              "main.s.t: [columnas: a]", "s.t: dos", "a.b.c.d: tres", "sin dos puntos", "x:", ": y", "", "c: z",
              "<!-- Ejemplos:", "-->", "\tq.csv:\t1", " \u2003# archivos", "x.y:\u2028# tabla", "p.md: a\x85# tablas"]
    texts = {f"m{i}": "\n".join(rng.choices(pieces, k=rng.randint(0, 30))) for i in range(150)}
    got = entries_of(spark, texts)
    for name, text in texts.items():
        assert got[name] == plain_entries(text), text


TEMPLATE = """# Archivos

<!-- Ejemplos:
`a.docx`: Uno
`b.md`: Dos
`c.xlsx`: Tres. [tabs: x, y]
-->

# Tablas

<!-- Ejemplos:
main.r.g: Cuatro. [columnas: t]
main.r.h: Cinco
-->
"""


def test_commented_examples_are_entries_unless_asked_for(spark):
    assert len(entries_of(spark, {"m": TEMPLATE})["m"]) == 5
    assert entries_of(spark, {"m": TEMPLATE}, skip_html_comments=True)["m"] == []


def test_merge_keeps_first_position_and_last_values(spark):
    rows = [(10, "a", "a1"), (20, "b", "b1"), (30, "a", "a2"), (40, "c", "c1"), (50, "a", "a3")]
    frame = spark.createDataFrame(rows, "ord long, name string, content string")
    got = sorted(tuple(r) for r in merged_sources(frame).select("ord", "name", "content").collect())
    assert got == [(10, "a", "a3"), (20, "b", "b1"), (40, "c", "c1")]


def docx(*paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>celda</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml",
                         f'<w:document xmlns:w="{space}"><w:body>{body}{table}</w:body></w:document>')
    return out.getvalue()


def xlsx(**sheets):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared, parts, listed, links = [], {}, "", ""
    for number, (name, rows) in enumerate(sheets.items(), 1):
        lines = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, value in enumerate(row):
                place = f'r="{chr(65 + c)}{r}"'
                if value is None:
                    continue
                if isinstance(value, str):
                    shared.append(value)
                    cells += f'<c {place} t="s"><v>{len(shared) - 1}</v></c>'
                else:
                    cells += f"<c {place}><v>{value}</v></c>"
            lines += f"<row>{cells}</row>"
        parts[f"xl/worksheets/sheet{number}.xml"] = \
            f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>'
        listed += f'<sheet name="{name}" sheetId="{number}" r:id="rId{number}"/>'
        links += f'<Relationship Id="rId{number}" Target="worksheets/sheet{number}.xml"/>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{links}</Relationships>"
    texts = "".join(f"<si><t>{text}</t></si>" for text in shared)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">{texts}</sst>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for path, content in parts.items():
            archive.writestr(path, content)
    return out.getvalue()


def as_dict(frame):
    return {r["name"]: r["content"] for r in frame.select("name", "content").collect()}


def test_text_files(spark, folder):
    (folder / "sub").mkdir()
    (folder / "a.md").write_bytes("línea 1\r\nlínea 2".encode())
    (folder / "sub" / "b c.TXT").write_text("x")
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    (folder / "bad.bin").write_bytes(b"\xff\xfe")
    (folder / "noext").write_text("sin extensión")
    (folder / "t.csv").write_text("a,b\n1,2\n")
    assert as_dict(text_files(spark, str(folder))) == {
        "a.md": "línea 1\nlínea 2", "sub/b c.TXT": "x", "bad.txt": None, "bad.bin": "",
        "noext": "sin extensión"}


def test_text_files_take_one_listing_and_open_no_other_kind(spark, folder):
    for name in ("a.md", "b.TXT", "c", "e.CSV", "f.xlsx"):
        (folder / name).write_text(name)
    found = text_files(spark, str(folder))
    plan = found._jdf.queryExecution().executedPlan()
    assert {r["name"]: r["content"] for r in found.collect()} == {"a.md": "a.md", "b.TXT": "b.TXT", "c": "c"}
    leaves = plan.collectLeaves()
    assert leaves.size() == 1
    assert leaves.head().metrics().apply("numFiles").value() == 3


def test_many_texts_share_folders(spark, folder):
    from metadoc.sinks.text_files import write_texts

    rows = spark.createDataFrame(
        [(f"t{i}.txt", n, None if n == 2 else f"ñ{i} {n}") for i in range(500) for n in (3, 1, 2)], "name string, n int, line string")
    write_texts(rows, str(folder / "new"), F.col("name"), F.col("line"), ["n"])
    got = {name.rpartition("/")[2]: content for name, content in as_dict(text_files(spark, str(folder / "new"))).items()}
    assert got == {f"t{i}.txt": f"ñ{i} 1\n\nñ{i} 3\n" for i in range(500)}
    assert len(list((folder / "new").iterdir())) <= 8
    with pytest.raises(Exception, match="no name of a file"):
        write_texts(rows.withColumn("name", F.lit("a/b")), str(folder / "bad"), F.col("name"), F.col("line"), ["n"])


def test_conversations_as_text_files_share_folders(spark, folder):
    """A folder per file took the listing, and the commands that set its mode, as long as there are files."""
    from checks.queries import QUERIES

    rows = spark.createDataFrame([(i, n, "user", f"{i}\r\n{n}") for i in range(300) for n in (2, 1)],
                                 "conv_id long, turn long, role string, text string")
    rows.write.parquet(str(folder / "conversations.parquet"))
    shared = Path(shared_dir(spark).removeprefix("file:")) / "metadoc"
    before = set(shared.glob("texts-*"))
    got = {r["conv_id"]: r["content_chars"] for r in QUERIES["text_file_content"](spark, str(folder)).collect()}
    assert got == {i: 2 * len(f"{i}\n1\n") for i in range(300)}
    written, = set(shared.glob("texts-*")) - before
    assert len([p for p in written.rglob("*") if p.is_dir()]) <= 8


def test_delimited_files(spark, folder):
    (folder / "a.csv").write_text('x,y\n1,"a, b"\n2,"dos\nlíneas"\n3,\n', encoding="utf8")
    (folder / "b b+.csv").write_text("k\n" + "".join(f"{i}\n" for i in range(450)))
    (folder / "c.tsv").write_text("p\tq\n1,5\tz\n")
    (folder / "d.csv").write_text("solo,cabecera\n")
    got = as_dict(delimited_files(spark, str(folder), ".csv"))
    assert got["a.csv"] == "x | y\n1 | a, b\n2 | dos\\nlíneas\n3 | NULL"
    assert got["d.csv"] == "(tabla vacía — sin registros)"
    lines = got["b b+.csv"].split("\n")
    assert lines == ["k", *map(str, range(100)), "...", *map(str, range(350, 450))]
    assert as_dict(delimited_files(spark, str(folder), ".tsv")) == {"c.tsv": "p | q\n1,5 | z"}


def test_large_delimited_file_in_splits(spark, folder):
    """No record spans lines, so the file is split; the first and last rows are still the right ones."""
    with open(folder / "big.csv", "w") as out:
        out.write("n,t\n")
        out.writelines(f'{i},"a, {i}"\n' for i in range(300_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        text = as_dict(delimited_files(spark, str(folder), ".csv"))["big.csv"].split("\n")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert text == ["n | t", *[f"{i} | a, {i}" for i in range(100)], "...",
                    *[f"{i} | a, {i}" for i in range(299_900, 300_000)]]


def test_documents(spark, folder):
    (folder / "a.docx").write_bytes(docx("Uno", "  ", "Dos"))
    (folder / "empty.docx").write_bytes(docx())
    (folder / "broken.docx").write_bytes(b"no zip")
    assert as_dict(docx_files(spark, str(folder))) == {
        "a.docx": "Uno\nDos", "empty.docx": "", "broken.docx": None}


def test_workbooks(spark, folder):
    book = xlsx(uno=[["a", "b"], ["x", 1], [None, 2.5]], dos=[["c"], ["z"]])
    for name in ("first.xlsx", "some.xlsx"):
        (folder / name).write_bytes(book)
    (folder / "broken.xlsx").write_bytes(book[:200])
    entries = spark.createDataFrame(
        [("first.xlsx", []), ("some.xlsx", ["dos", "tres", "uno"]), ("broken.xlsx", [])], "name string, hint_tabs array<string>")
    rows = workbook_rows(spark, str(folder))
    first = "a | b\nx | 1\nNULL | 2.5"
    assert as_dict(workbook_files(rows, entries)) == {
        "first.xlsx": first,
        "some.xlsx": f"--- Hoja: dos ---\nc\nz\n--- Hoja: uno ---\n{first}"}
    assert [tuple(r) for r in missing_sheets(rows, entries).collect()] == [("some.xlsx", "tres")]


def test_missing_sheets_are_reported_and_empty_ones_are_there(spark, folder):
    book = xlsx(uno=[["a"], ["x"]], nada=[])
    (folder / "some.xlsx").write_bytes(book)
    (folder / "broken.xlsx").write_bytes(book[:200])
    (folder / "general.md").write_text(
        "# Archivos\nsome.xlsx: libro [tabs: uno, tres, nada]\nbroken.xlsx: roto [tabs: uno]\n", encoding="utf-8")
    sources, failed = load_sources(spark, str(folder), ["general.md"])
    assert [r.content for r in sources.collect()] == ["--- Hoja: uno ---\na\nx"]
    assert sorted(map(tuple, failed.collect())) == [
        ("general.md", "broken.xlsx", "not found or not readable"), ("general.md", "some.xlsx", "sheet not found: tres")]


def test_a_large_sheet_is_never_one_tree():
    import tracemalloc

    book = xlsx(uno=[[str(i), i] for i in range(60_000)])
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        last = None
        for last in xlsx_rows(book):
            pass
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert last[2] == 59_999 and peak < 8_000_000


def test_table_text(spark):
    frame = spark.createDataFrame([(2, "b"), (1, None), (3, "c" * 300)], "k int, v string")
    assert table_text(frame, order_by=["k"]).first()[0] == \
        "k | v\n1 | NULL\n2 | b\n3 | " + "c" * 197 + "..."
    assert table_text(frame.filter("k > 9")).first()[0] == "(tabla vacía — sin registros)"
    assert table_text(spark.range(1000), rows=200).first()[0].count("\n") == 200


def test_load_sources(spark, folder):
    spark.sql("CREATE SCHEMA IF NOT EXISTS referencia")
    spark.range(3).select("id", F.concat(F.lit("t"), "id").alias("termino")).write.mode("overwrite")\
        .saveAsTable("referencia.glosario")
    (folder / "general.md").write_text(
        "# Archivos\n`a.md`: Reglas\n`falta.txt`: No está\n`libro.xlsx`: Libro [tabs: dos]\n"
        "# Tablas\nspark_catalog.referencia.glosario: Términos [columnas: termino]\n"
        "spark_catalog.referencia.nada: No existe\n", encoding="utf8")
    (folder / "extra.md").write_text("# Archivos\nd.csv: Datos\na.md: Otra vez\n", encoding="utf8")
    (folder / "a.md").write_text("contenido")
    (folder / "d.csv").write_text("x\n1\n")
    (folder / "libro.xlsx").write_bytes(xlsx(uno=[["a"]], dos=[["c"], ["z"]]))
    sources, failed = load_sources(spark, str(folder), ["general.md", "extra.md", "no.md"])
    rows = sources.orderBy("ord").collect()
    assert [(r["name"], r["description"], r["content"], r["kind"], r["manifest"]) for r in rows] == [
        ("a.md", "Otra vez", "contenido", "archivo", "extra.md"),
        ("libro.xlsx", "Libro [tabs: dos]", "--- Hoja: dos ---\nc\nz", "archivo", "general.md"),
        ("spark_catalog.referencia.glosario", "Términos [columnas: termino]", "termino\nt0\nt1\nt2",
         "tabla", "general.md"),
        ("d.csv", "Datos", "x\n1", "archivo", "extra.md")]
    assert sorted(r["name"] for r in failed.collect()) == ["falta.txt", "spark_catalog.referencia.nada"]
    assert [r["size"] for r in rows][0] == 9


def test_only_named_files_are_sources(spark, folder):
    (folder / "a.md").write_text("x")
    (folder / "b.md").write_text("y")
    entries = spark.createDataFrame([("a.md", [])], "name string, hint_tabs array<string>")
    assert as_dict(file_contents(spark, str(folder), entries)) == {"a.md": "x"}


def test_each_delimited_file_has_its_own_width(spark, folder):
    """Neither an unnamed file nor a wide, quoted or invalid one touches the others."""
    wide = "x," * 25_000
    (folder / "unnamed.csv").write_text(f'k,v\n1,"{wide}"\n{wide}\n')
    (folder / "a.csv").write_text("p,q\n1,2\n")
    (folder / "long [1].csv").write_text(f'k,v\n1,"{wide}"\n{wide}\n')
    (folder / "head.csv").write_text('"dos\nlíneas, una",b,c\n1,2,3\n', encoding="utf8")
    (folder / "bad.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    (folder / "roto.xlsx").write_bytes(b"no es un libro")
    names = ["a.csv", "long [1].csv", "head.csv", "bad.csv"]
    entries = spark.createDataFrame([(name, []) for name in names], "name string, hint_tabs array<string>")
    got = as_dict(file_contents(spark, str(folder), entries))
    assert got.keys() == {"a.csv", "long [1].csv", "head.csv"}
    assert got["a.csv"] == "p | q\n1 | 2"
    assert got["long [1].csv"].startswith("k | v\n1 | x,x,") and got["long [1].csv"].endswith("\nx | x")
    assert got["head.csv"] == "dos\\nlíneas, una | b | c\n1 | 2 | 3"


def test_blank_lines_before_the_header(spark, folder):
    texts = {
        "one.csv": "\na,b,c\n1,2,3\n", "many.csv": "\r\n  \r\n\r\na,b,c\r\n1,2,3\r\n", "spans.csv": '\n  \na,b,c\n1,2,"3\n4"\n',
        "head.csv": '\n \n"a, or\na",b,c\n1,2,3\n', "tabs.tsv": "\n\t\t\na\tb\tc\n1\t2\t3\n", "spans.tsv": '\n\t\t\na\tb\tc\n1\t2\t"3\n4"\n',
        "blank.csv": "\n\n"}
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    got = as_dict(delimited_files(spark, str(folder), ".csv")) | as_dict(delimited_files(spark, str(folder), ".tsv"))
    assert {k: v for k, v in got.items() if k != "blank.csv"} == {
        "one.csv": "a | b | c\n1 | 2 | 3", "many.csv": "a | b | c\n1 | 2 | 3", "spans.csv": "a | b | c\n1 | 2 | 3\\n4",
        "head.csv": "a, or\\na | b | c\n1 | 2 | 3", "tabs.tsv": "a | b | c\n1 | 2 | 3", "spans.tsv": "a | b | c\n1 | 2 | 3\\n4"}


def test_first_rows_open_the_first_files_only(spark, folder):
    path = str(folder / "a table")
    for n in range(5):
        spark.range(n * 100, n * 100 + 100, 1, 1).selectExpr("1000 - id AS k", "id % 3 AS v", "map('m', id) AS m").write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    files = sorted(table.inputFiles())
    first = [spark.read.parquet(unquote(f)).collect() for f in files]
    for rows, opened in ((30, 1), (100, 1), (101, 4), (1000, 5)):
        want = [f"{r.k} | {r.v}" for part in first for r in part][:rows]
        assert table_text(table, ["k", "v"], rows=rows).first()[0].split("\n")[1:] == want
        read = first_rows(table, ["k"], rows).select("_file").distinct().collect()
        assert 1 <= len(read) <= opened
    plan = first_rows(table, ["k", "v"], 30)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "m#" not in plan and "orderBy=[_file" in plan
    assert table_text(spark.read.parquet(path).limit(3), ["k"]).first()[0].count("\n") == 3
    assert first_rows(spark.range(3), ["id"], 2) is None
    spark.range(0).write.parquet(str(folder / "empty"))
    assert table_text(spark.read.parquet(str(folder / "empty"))).first()[0] == fv.EMPTY_TABLE_TEXT


def test_headers_and_records_that_span_lines(spark, folder):
    (folder / "a.csv").write_text('a,"b\nx",c\n1,2,"3\n4"\n')
    (folder / "b.csv").write_text('a,b,"c\n\nd","e\nf"\n1\n')
    # Every line of the record has an even number of quotes.
    (folder / "c.csv").write_text('a,b,c\n5" x,"one\ntwo"" "" 6"" ",3\n7,8,9\n')
    (folder / "d.tsv").write_text('a\t"b\nx"\tc\n1\t2\n')
    got = as_dict(delimited_files(spark, str(folder), ".csv")) | as_dict(delimited_files(spark, str(folder), ".tsv"))
    assert got == {
        "a.csv": "a | b\\nx | c\n1 | 2 | 3\\n4", "b.csv": "a | b | c\\n\\nd | e\\nf\n1 | NULL | NULL | NULL",
        "c.csv": 'a | b | c\n5" x | one\\ntwo" " 6"  | 3\n7 | 8 | 9', "d.tsv": "a | b\\nx | c\n1 | 2 | NULL"}


def test_quotes_inside_unquoted_cells(spark, folder):
    (folder / "a.csv").write_text('5" a,6" b,c\n1,2,3\n')
    (folder / "b.csv").write_text('5" a,b,c\n1,2,3\n')
    (folder / "c.csv").write_text('"5"" a, or 6""",b\n1,2\n')
    got = as_dict(delimited_files(spark, str(folder), ".csv"))
    assert got["a.csv"] == '5" a | 6" b | c\n1 | 2 | 3' and got["b.csv"] == '5" a | b | c\n1 | 2 | 3'
    assert got["c.csv"] == '5" a, or 6" | b\n1 | 2'


def test_width_is_never_below_what_the_reader_finds(spark):
    rnd = random.Random(9)
    heads = sorted({"".join(rnd.choice('a",, ') for _ in range(rnd.randint(1, 14))) + "z" for _ in range(3000)})
    schema = ", ".join(f"c{i} string" for i in range(20))
    cells = F.array(*(F.col(f"r.c{i}") for i in range(20)))
    last = F.array_max(F.transform(cells, lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0)))
    rows = spark.createDataFrame([(h,) for h in heads], "head string").withColumn(
        "r", F.from_csv("head", schema, {"quote": '"', "escape": '"'}))
    wrong = rows.select("head", _cells_in(F.col("head"), ",").alias("have"), last.alias("need")).filter("have < need")
    assert wrong.collect() == []


def test_dates_in_workbooks(spark, folder):
    import xml.etree.ElementTree as xml

    from metadoc.sources.files import _date_styles, _date_text, xlsx_rows

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    styles = (
        f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/>'
        '<numFmt numFmtId="165" formatCode="0.0&quot; dias&quot;"/><numFmt numFmtId="166" formatCode="[Red]0.0"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>')
    assert _date_styles(xml.fromstring(styles), "{" + main + "}") == {1, 2}
    assert [_date_text(x, False) for x in ("45292", "45292.5", "0.25")] == ["2024-01-01", "2024-01-01 12:00:00", "06:00:00"]
    assert _date_text("43830", True) == "2024-01-01"
    book = io.BytesIO(xlsx(uno=[["a", 45292]]))
    with zipfile.ZipFile(book, "a") as archive:
        archive.writestr("xl/styles.xml", styles)
    assert [r[3] for r in xlsx_rows(book.getvalue())] == [["a", "45292"]]
    old = zipfile.ZipFile(book)
    dated = io.BytesIO()
    with zipfile.ZipFile(dated, "w") as archive:
        for name in old.namelist():
            archive.writestr(name, old.read(name).replace(b'<c r="B1">', b'<c r="B1" s="1">'))
    assert [r[3] for r in xlsx_rows(dated.getvalue())] == [["a", "2024-01-01"]]
