"""Context files as text: plain text, delimited tables, documents and workbooks.

Every reader takes a folder and returns ``(name, content)`` per file, ``name`` being the path below
the folder. Files are read in parallel; decoding of zipped formats is a small per-file helper.
"""

import re
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from metadoc import fixed_values as fv
from metadoc.functions.text import file_extension, or_empty
from metadoc.runtime import materialize
from metadoc.sources.tables import rows_text

TEXT_EXTENSIONS = (".txt", ".md", ".json", ".yaml", ".yml")
DELIMITERS = {".csv": ",", ".tsv": "\t"}
OTHER_KINDS = {*DELIMITERS, ".docx", ".xlsx", ".xls"}


def _relative(path, folder):
    """The part of a file path below ``folder``."""
    return F.substring_index(path, folder.rstrip("/").split(":")[-1] + "/", -1)


#: Longer files cannot be one value of a column.
MOST_BYTES = (1 << 31) - 16


def _escaped(paths):
    """Paths whose characters stand for themselves where Spark expects patterns."""
    return [re.sub(r"([{}\[\]*?\\])", r"\\\1", path) for path in paths]


def _binary(spark, folder, glob=None, paths=None):
    """Files below ``folder``, or those of the given ``paths``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob and paths is None:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(folder if paths is None else _escaped(paths))
    return found.withColumn("name", _relative(F.col("path"), folder))


def _contents(spark, folder, glob=None, paths=None):
    """Whole files; those that are too long are left out, unread."""
    return _binary(spark, folder, glob, paths).filter(F.col("length") <= MOST_BYTES)


def named_paths(spark, folder, entries):
    """``{extension: paths}`` of the files that ``entries`` names. A listing; no content is read."""
    listed = _binary(spark, folder).select("name", "path").join(
        entries.select("name").distinct(), "name", "left_semi")
    found = defaultdict(list)
    for row in listed.select("path", file_extension(F.col("name")).alias("ext")).collect():
        found[row["ext"]].append(row["path"])
    return found


def named_texts(spark, folder, names):
    """(name, text) of the few given files, as far as they exist; no other file is read."""
    listed = _binary(spark, folder).filter(F.col("name").isin(*names)).select("path").collect()
    if not listed:
        return spark.createDataFrame([], "name string, text string")
    files = _contents(spark, folder, paths=[row["path"] for row in listed])
    return files.select(
        "name",
        unix_lines(F.col("content").cast("string")).alias("text"),
    )


def _any_case(extension):
    """Glob for an extension in any mix of cases."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def unix_lines(text):
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def text_files(spark, folder, paths=None):
    """UTF-8 texts, whole: of the given paths, or of all files below ``folder`` that are no other kind.

    Of files that are not valid UTF-8, those with a text extension give null content (an error for the
    caller) and the others give the empty text. Too long files are left out."""
    if paths is not None and not paths:
        return spark.createDataFrame([], "name string, content string")
    files = _contents(spark, folder, paths=paths)
    if paths is None:
        # Told by the listing alone: files of other kinds are not opened.
        files = files.filter(~file_extension(F.col("_metadata.file_name")).isin(*OTHER_KINDS))
    text = unix_lines(F.try_validate_utf8(F.col("content").cast("string")))
    known = file_extension(F.col("name")).isin(*TEXT_EXTENSIONS)
    return files.select("name", F.when(known, text).otherwise(or_empty(text)).alias("content"))


def _decoded_path():
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


#: What the CSV reader skips as blank, and the blank lines ahead of a header.
_NOT_BLANK = r"[^\x00-\x20]"
_BLANK_LINES = r"\A(?:[\x00-\x09\x0b\x0c\x0e-\x20]*+[\r\n]++)++"
#: A quoted cell. Quotes count only where a cell begins.
_QUOTED = '"(?:[^"]++|"")*+"'


def _cells_in(text, separator):
    """Number of cells of the first record, at least: how many there are is for the CSV reader to say."""
    cell = rf"\G(?:{_QUOTED})?+[^{separator}\r\n]*+{separator}"
    return F.size(F.regexp_extract_all(text, F.lit(cell), F.lit(0))) + 1


def _open(line, separator):
    """Whether a quoted cell of ``line`` is not closed in it."""
    closed = rf'(?:{_QUOTED}[^{separator}]*+|(?!")[^{separator}]*+){separator}'
    return line.rlike(rf'\A(?:{closed})*+"(?:[^"]++|"")*+\z')


def _shapes(spark, folder, separator, options, paths):
    """``{(width, spanning): (paths, separators in the widest line)}``, each file on its own terms.

    The width is that of the file's own header, the first line that is not blank, rounded up to a power of
    two: cells beyond the header are not shown, and few widths make few reads. ``spanning`` says whether a
    record of the file may span lines. Files that are not valid UTF-8 are left out.
    """
    lines = spark.read.options(**options).text(folder if paths is None else _escaped(paths)).select(
        "value", _decoded_path().alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    # The first line of a record that spans lines leaves a quoted cell open, whatever quotes its cells hold.
    opened = F.contains("value", F.lit('"')) & F.coalesce(_open(F.col("value"), separator), F.lit(False))
    files = lines.groupBy("path").agg(
        F.max(F.size(F.split("value", separator))).alias("widest"),
        F.max(opened).alias("spanning"), F.min(F.is_valid_utf8("value")).alias("valid"))
    # Only the first split of a file, a bounded part, is looked through for the header; a file with blank
    # lines only there is as wide as its widest line.
    heads = lines.filter(F.col("value").rlike(_NOT_BLANK) & (F.col("start") == 0)).groupBy("path").agg(
        F.min_by("value", "at").alias("head"))
    files = files.join(heads, "path", "left").select(
        "path", "widest", "spanning", "valid",
        F.when(F.col("head").isNull(), F.col("widest")).otherwise(_cells_in(F.col("head"), separator)).alias("width"),
        F.coalesce(_open(F.col("head"), separator), F.lit(False)).alias("open")).filter("valid").collect()
    widths = {row["path"]: row["width"] for row in files}
    if unclosed := [row["path"] for row in files if row["open"]]:
        # The header itself spans lines.
        whole = spark.read.text(_escaped(unclosed), wholetext=True, recursiveFileLookup=True)
        head = F.regexp_replace("value", _BLANK_LINES, "")
        wider = dict(map(tuple, whole.select(_decoded_path(), _cells_in(head, separator)).collect()))
        widths |= {path: max(widths[path], width) for path, width in wider.items()}
    shapes = {}
    for row in files:
        width = 1 << (widths[row["path"]] - 1).bit_length()
        own, widest = shapes.get((width, row["spanning"]), ([], 0))
        shapes[width, row["spanning"]] = ([*own, row["path"]], max(widest, row["widest"]))
    return shapes


def delimited_rows(spark, folder, extension, paths=None):
    """(name, row_no, cells) of every record of the files with ``extension``, header included.

    ``paths`` limits it to these files. Lines are looked at once before, for the shape of each file
    (see ``_shapes``); only files in which a record may span lines are read whole by one task.
    """
    separator = DELIMITERS[extension]
    options = {"recursiveFileLookup": "true"} | ({"pathGlobFilter": _any_case(extension)} if paths is None else {})
    found = spark.createDataFrame(
        [], "name string, row_no struct<split:bigint,at:bigint>, cells array<string>")
    for (width, spanning), (own, widest) in _shapes(spark, folder, separator, options, paths).items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        records = spark.read.schema(schema).options(
            sep=separator, header="false", multiLine=str(bool(spanning)), quote='"', escape='"',
            maxColumns=str(max(20_480, widest + 1)), recursiveFileLookup="true",
        ).csv(_escaped(own))
        cells = F.array(*[F.col(f"c{i}") for i in range(width)])
        if spanning and width > 1:
            # Lines of white space, which are skipped where records do not span lines.
            empty = F.forall(F.slice(cells, 2, width), lambda c: c.isNull()) & (
                F.col("c0").rlike(r"\A[\x00-\x20]+\z") if separator != "\t" else ~F.coalesce(F.col("c0"), F.lit(" ")).rlike(rf"{_NOT_BLANK}|\A\z"))
            records = records.filter(~F.coalesce(empty, F.lit(False)))
        # A split is read by one task, in order, and splits are ordered by where they start.
        row_no = F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")
        )
        found = found.unionByName(records.select(
            _relative(_decoded_path(), folder).alias("name"), row_no.alias("row_no"),
            _without_trailing_nulls(cells).alias("cells"),
        ))
    return found


def _without_trailing_nulls(cells):
    last = F.array_max(
        F.transform(cells, lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(F.lit(0)))
    )
    return F.slice(cells, F.lit(1), F.greatest(last, F.lit(1)))


def delimited_files(spark, folder, extension, paths=None):
    return rows_text(delimited_rows(spark, folder, extension, paths), ["name"])


def _decoder(rows_of, columns, batch=5_000):
    """mapInPandas function that turns each file into rows; an unreadable file gives an error row."""

    def decode(batches):
        from itertools import islice

        import pandas as pd

        for files in batches:
            for name, content in zip(files["name"], files["content"]):
                error = None
                try:
                    found = ((name, *row, None) for row in rows_of(bytes(content)))
                    while part := list(islice(found, batch)):
                        yield pd.DataFrame(part, columns=columns)
                except Exception as problem:
                    error = str(problem)[:200] or repr(problem)
                if error:
                    blank = [None] * (len(columns) - 2)
                    yield pd.DataFrame([(name, *blank, error)], columns=columns)

    return decode


def docx_paragraphs(content):
    """Non-blank paragraphs of the body of a .docx file."""
    import io
    import xml.etree.ElementTree as xml
    import zipfile

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    marks = {space + "tab": "\t", space + "br": "\n", space + "cr": "\n"}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = xml.fromstring(archive.read("word/document.xml")).find(space + "body")
    for number, paragraph in enumerate(body.findall(space + "p")):
        runs = [run for run in paragraph.iter(space + "r")]
        text = "".join(
            (part.text or "") if part.tag == space + "t" else marks.get(part.tag, "")
            for run in runs for part in run
        )
        if text.strip():
            yield number, text


#: The number formats that show a serial number as a date or a time.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(styles, main):
    """The styles of cells, by number, whose format shows a date or a time."""
    own = {
        int(node.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", node.get("formatCode") or "", flags=re.I)
        for node in styles.iter(main + "numFmt")
    }
    cells = styles.find(main + "cellXfs")
    kinds = [int(node.get("numFmtId") or 0) for node in (cells if cells is not None else ())]
    return {
        at for at, kind in enumerate(kinds)
        if (re.search("[dmyhs]", own[kind], re.I) if kind in own else kind in DATE_FORMATS)
    }


def _date_text(serial, since_1904):
    """A serial number of days as a date, a time or both, as far as it has such parts."""
    from datetime import datetime, timedelta

    days = float(serial)
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
    moment = start + timedelta(seconds=round(days * 86400))
    if 0 <= days < 1:
        return moment.strftime("%H:%M:%S")
    return moment.strftime("%Y-%m-%d" if days == int(days) else "%Y-%m-%d %H:%M:%S")


def _elements(stream, parent, tag):
    """The ``tag`` elements below the ``parent`` one as they are read; each is dropped before the next comes."""
    import xml.etree.ElementTree as xml

    holder = None
    for event, node in xml.iterparse(stream, ("start", "end")):
        if event == "start" and node.tag == parent:
            holder = node
        elif event == "end" and node.tag == tag and holder is not None:
            yield node
            holder.clear()


def xlsx_rows(content):
    """(sheet_no, sheet, row_no, cells) of every row of a workbook; dates as ``2024-01-31 12:00:00``.

    Rows are read one after another. A sheet without any rows has one row without a number or cells.
    """
    import io
    import re
    import xml.etree.ElementTree as xml
    import zipfile

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def texts(node):
        return "".join(part.text or "" for part in node.iter(main + "t"))

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in parts:
            with archive.open("xl/sharedStrings.xml") as stream:
                shared = [texts(item) for item in _elements(stream, main + "sst", main + "si")]
        dates = set()
        if "xl/styles.xml" in parts:
            dates = _date_styles(xml.fromstring(archive.read("xl/styles.xml")), main)
        targets = {
            node.get("Id"): node.get("Target")
            for node in xml.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        book = xml.fromstring(archive.read("xl/workbook.xml"))
        setup = book.find(main + "workbookPr")
        since_1904 = setup is not None and setup.get("date1904") in ("1", "true")
        sheets = book.find(main + "sheets")
        for sheet_no, sheet in enumerate(sheets):
            target = targets[sheet.get(link)].lstrip("/")
            part = target if target.startswith("xl/") else "xl/" + target
            seen = False
            for row_no, row in enumerate(_elements(archive.open(part), main + "sheetData", main + "row")):
                cells = []
                for node in row.findall(main + "c"):
                    letters = re.match(r"[A-Z]+", node.get("r") or "")
                    at = len(cells) + 1
                    if letters:
                        at = 0
                        for letter in letters.group():
                            at = at * 26 + ord(letter) - 64
                    value = node.findtext(main + "v")
                    kind = node.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = texts(node)
                    elif kind == "b":
                        value = "True" if value == "1" else "False"
                    elif kind in (None, "n") and value and int(node.get("s") or 0) in dates:
                        value = _date_text(value, since_1904)
                    cells += [None] * (at - 1 - len(cells)) + [value]
                if any(cell is not None for cell in cells):
                    seen = True
                    yield sheet_no, sheet.get("name"), row_no, cells
            if not seen:
                yield sheet_no, sheet.get("name"), None, None


def docx_files(spark, folder, paths=None):
    files = _contents(spark, folder, _any_case(".docx"), paths).select("name", "content")
    rows = files.mapInPandas(
        _decoder(docx_paragraphs, ["name", "nth", "text", "error"]),
        "name string, nth int, text string, error string",
    )
    parts = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("nth", "text"))))
    joined = F.array_join(F.transform(parts, lambda part: part["text"]), "\n")
    read = rows.groupBy("name").agg(F.when(F.max("error").isNull(), joined).alias("content"))
    return files.select("name").join(read, "name", "left").select(
        "name", F.when(read["name"].isNull(), "").otherwise(F.col("content")).alias("content")
    )


def workbook_rows(spark, folder, paths=None):
    """(name, sheet_no, sheet, row_no, cells, error) of every workbook row."""
    files = _contents(spark, folder, _any_case(".xlsx"), paths).select("name", "content")
    return files.mapInPandas(
        _decoder(xlsx_rows, ["name", "sheet_no", "sheet", "row_no", "cells", "error"]),
        "name string, sheet_no int, sheet string, row_no long, cells array<string>, error string",
    )


def workbook_files(rows, entries):
    """Text per workbook: the first sheet, or the hinted sheets in the order of the hint.

    ``entries`` holds ``(name, hint_tabs)``. Hinted sheets that do not exist are left out; see
    ``missing_sheets``.
    """
    broken = rows.filter(F.col("error").isNotNull()).select("name").distinct()
    rows = rows.filter("cells IS NOT NULL").join(broken, "name", "left_anti")
    hinted = entries.select("name", F.posexplode_outer("hint_tabs").alias("at", "sheet"))
    whole = hinted.filter(F.col("sheet").isNull()).select("name")
    single = rows.filter("sheet_no = 0").join(whole, "name", "left_semi")
    first = rows_text(single.select("name", "row_no", "cells"), ["name"])
    wanted = hinted.filter(F.col("sheet").isNotNull())
    chosen = rows.join(wanted, ["name", "sheet"]).select(
        "name", "at", "sheet", "row_no", "cells"
    )
    titled = rows_text(chosen, ["name", "at", "sheet"]).select(
        "name", "at",
        F.concat(
            F.replace(F.lit(fv.SHEET_TITLE), F.lit("{sheet}"), F.col("sheet")), F.lit("\n"), "content"
        ).alias("text"),
    )
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    sheets = titled.groupBy("name").agg(
        F.array_join(F.transform(parts, lambda part: part["text"]), "\n").alias("content")
    )
    return first.unionByName(sheets)


def missing_sheets(rows, entries):
    """``(name, sheet)``: hinted sheets that a readable workbook does not have."""
    hinted = entries.select("name", F.explode("hint_tabs").alias("sheet"))
    readable = rows.groupBy("name").agg(F.max("error").alias("error")).filter("error IS NULL").select("name")
    return hinted.join(readable, "name", "left_semi").join(rows.select("name", "sheet").distinct(), ["name", "sheet"], "left_anti")


def load_files(spark, folder, entries):
    """The files below ``folder`` that a manifest entry names; others stay unopened.

    ``entries`` holds ``(name, hint_tabs)``, one row per name. Returns ``(name, content)`` of every file,
    and ``(name, sheet)`` of the hinted sheets that workbooks do not have.
    """
    paths = named_paths(spark, folder, entries)
    found = text_files(spark, folder, [p for ext in sorted(paths.keys() - OTHER_KINDS) for p in paths[ext]])
    missing = spark.createDataFrame([], "name string, sheet string")
    for extension in sorted(paths.keys() & DELIMITERS.keys()):
        found = found.unionByName(delimited_files(spark, folder, extension, paths[extension]))
    if ".docx" in paths:
        found = found.unionByName(docx_files(spark, folder, paths[".docx"]))
    if ".xlsx" in paths:
        # Its rows are used in several ways: each workbook is decoded once.
        rows = materialize(workbook_rows(spark, folder, paths[".xlsx"]), "workbook-rows")
        found = found.unionByName(workbook_files(rows, entries))
        missing = missing_sheets(rows, entries)
    return found, missing


def file_contents(spark, folder, entries):
    """``(name, content)`` of every file below ``folder`` that a manifest entry names."""
    return load_files(spark, folder, entries)[0]
