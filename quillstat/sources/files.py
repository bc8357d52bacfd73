"""Reading and writing: delimited and fixed text, free-format text, spreadsheets, databases, CSV, and per-case text."""

from __future__ import annotations

import gzip
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat import ordering


def _typed(c: Column, kind: str) -> Column:
    return c.try_cast("double") if kind == "N" else F.coalesce(F.rtrim(c), F.lit(""))


def data_list_fixed(spark: SparkSession, path: str, fields: list[tuple], records: int = 1) -> DataFrame:
    """(name, first column, last column, 'N' or 'A'[, record]) of each case of ``records`` lines; blank numbers are missing."""
    lines = spark.read.text(path)
    cut = lambda line, a, b, k: _typed(F.trim(F.substring(line, a, b - a + 1)) if k == "N" else F.substring(line, a, b - a + 1), k)
    if records == 1:
        return lines.select(*[cut("value", a, b, k).alias(n) for n, a, b, k, *_ in fields])
    rows = _numbered(lines).withColumn("__n", F.col("__case") - 1)
    cases = rows.groupBy(F.floor(F.col("__n") / records).alias("__c")).agg(*[F.max(F.when(F.col("__n") % records == i, F.col("value"))).alias(f"__l{i}") for i in range(records)])
    return cases.select(*[cut(f"__l{r[0] - 1 if r else 0}", a, b, k).alias(n) for n, a, b, k, *r in fields])


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines, stored, with ``__id`` and ``__case``, their number in file order."""
    return ordering.numbered(ordering.store(lines.withColumn("__id", F.monotonically_increasing_id()), "lines"))


def _fields(line: str, delimiters: str) -> Column:
    """The fields of a line. Blanks and tabs only part fields, other delimiters end one, so two in a row hold an empty one; quotes hold delimiters."""
    escape = lambda cs: "".join(f"\\x{ord(c):02x}" for c in cs)
    soft, hard = escape([c for c in delimiters if c in " \t"]), escape([c for c in delimiters if c not in " \t"])
    gap = f"[{soft}]*" if soft else ""
    one = f"""'[^']*'|"[^"]*"|[^{soft}{hard}]+"""
    whole = f"(?:{one}){gap}(?:[{hard}]{gap})?|[{hard}]{gap}" if hard else f"(?:{one}){gap}"
    found = F.regexp_extract_all(F.regexp_replace(line, f"^{gap}", "") if soft else F.col(line), F.lit(whole), F.lit(0))
    tail = f"{gap}[{hard}]?{gap}$" if hard else f"{gap}$"
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_extract(x, f"(?s)^(.*?){tail}", 1), "^(['\"])(.*)\\1$", "$2"))


def data_list_list(spark: SparkSession, path: str, names: list[tuple[str, str]], delimiters: str = " \t,") -> DataFrame:
    """One case a line; fields that are empty or not there are missing."""
    return spark.read.text(path).select(_fields("value", delimiters).alias("f")).select(*[_typed(F.try_element_at("f", F.lit(i + 1)), k).alias(n) for i, (n, k) in enumerate(names)])


def data_list_free(spark: SparkSession, path: str, names: list[tuple[str, str]], delimiters: str = " \t,") -> DataFrame:
    """Fields run on over lines: every len(names) fields are a case; an unfinished last case is dropped. Fields are placed by the fields of the lines before."""
    lines = spark.read.text(path).select(_fields("value", delimiters).alias("f"), F.monotonically_increasing_id().alias("__id"))
    placed = ordering.cumulated(ordering.store(lines, "fields"), F.size("f").cast("long"), "end")
    tokens = placed.select((F.col("end") - F.size("f")).alias("at"), F.posexplode("f").alias("i", "x")).withColumn("at", F.col("at") + F.col("i"))
    k = len(names)
    rows = tokens.groupBy(F.floor(F.col("at") / k).alias("case")).agg(*[F.max(F.when(F.col("at") % k == i, F.col("x"))).alias(f"f{i}") for i in range(k)], F.count("*").alias("n"))
    return rows.where(F.col("n") == k).select("case", *[_typed(F.col(f"f{i}"), t).alias(n) for i, (n, t) in enumerate(names)])


def get_text(spark: SparkSession, path: str, schema: str, delimiter: str = ",", qualifier: str = '"', first_case: int = 1, escape: str | None = None, cases: int | None = None, fields_per_case: int | None = None) -> DataFrame:
    """Delimited text with declared variables, from line ``first_case`` on; at most ``cases`` cases (IMPORTCASES FIRST).

    ``fields_per_case`` reads fields without regard to lines (DELCASE VARIABLES); ``escape`` is the character before a qualifier within a field.
    """
    options = {"sep": delimiter, "quote": qualifier, "mode": "PERMISSIVE", "escape": escape or qualifier}
    if fields_per_case is not None:
        kinds = spark.createDataFrame([], schema).schema.fields[:fields_per_case]
        rows = data_list_free(spark, path, [(f.name, "A" if f.dataType.typeName() == "string" else "N") for f in kinds], delimiter)
        rows = rows.where(F.col("case") >= first_case - 1)
        return (rows.where(F.col("case") < first_case - 1 + cases) if cases is not None else rows).drop("case")
    if first_case <= 2 and cases is None:
        return spark.read.schema(schema).options(header=first_case == 2, **options).csv(path)
    lines = _numbered(spark.read.text(path)).where(F.col("__case") >= first_case)
    if cases is not None:
        lines = lines.where(F.col("__case") < first_case + cases)
    return lines.select(F.from_csv("value", schema, options).alias("c")).select("c.*")


def get_jdbc(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


_ODS = {"t": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "o": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "x": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}


def _ods_rows(path: str, sheet: int) -> list[list]:
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    table = root.findall(".//t:table", _ODS)[sheet]
    rows = []
    for row in table.iter(f"{{{_ODS['t']}}}table-row"):
        cells = []
        for cell in row.findall("t:table-cell", _ODS):
            n = int(cell.get(f"{{{_ODS['t']}}}number-columns-repeated", "1"))
            number = cell.get(f"{{{_ODS['o']}}}value")
            text = "\n".join("".join(p.itertext()) for p in cell.findall("x:p", _ODS))
            value = float(number) if number is not None else (text or None)
            cells += [value] * (n if value is not None or n < 1000 else 0)
        rows.append(cells)
    return rows


def _gnumeric_rows(path: str, sheet: int) -> list[list]:
    raw = Path(path).read_bytes()
    root = ElementTree.fromstring(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    ns = root.tag.partition("}")[0] + "}"
    cells = {}
    for c in list(root.iter(f"{ns}Sheet"))[sheet].iter(f"{ns}Cell"):
        number = c.get("ValueType") in ("30", "40")
        cells[int(c.get("Row")), int(c.get("Col"))] = float(c.text) if number else c.text
    height, width = (max(k[i] for k in cells) + 1 for i in (0, 1)) if cells else (0, 0)
    return [[cells.get((r, c)) for c in range(width)] for r in range(height)]


def _column(letters: str) -> int:
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters.upper())))


def get_spreadsheet(spark: SparkSession, path: str, sheet: int = 0, names: bool = True, cell_range: str | None = None) -> DataFrame:
    """An ODS or Gnumeric sheet, or its ``cell_range`` such as "B2:D9"; the first data cell decides whether a column is numeric. Sheets are files of bounded size, read on the driver."""
    rows = _ods_rows(path, sheet) if zipfile.is_zipfile(path) else _gnumeric_rows(path, sheet)
    if cell_range:
        (c0, r0), (c1, r1) = (re.fullmatch(r"([A-Za-z]+)(\d+)", x).groups() for x in cell_range.split(":"))
        rows = [r[_column(c0) - 1 : _column(c1)] for r in rows[int(r0) - 1 : int(r1)]]
    head = [str(c) for c in rows.pop(0)] if names and rows else [f"VAR{i + 1:03d}" for i in range(max(map(len, rows), default=0))]
    rows = [(r + [None] * len(head))[: len(head)] for r in rows]
    numeric = [isinstance(next((r[i] for r in rows if r[i] is not None), None), float) for i in range(len(head))]
    clean = [tuple((v if isinstance(v, float) else None) if n else ("" if v is None else f"{v:g}" if isinstance(v, float) else v) for v, n in zip(r, numeric, strict=True)) for r in rows]
    return spark.createDataFrame(clean, ", ".join(f"`{h}` {'double' if n else 'string'}" for h, n in zip(head, numeric, strict=True)))


def save_translate(df: DataFrame, path: str, delimiter: str = ",", field_names: bool = True, labels: dict[str, dict] | None = None) -> None:
    for name, map_ in (labels or {}).items():
        out = F.col(name).cast("string")
        for k, v in map_.items():
            out = F.when(F.col(name) == k, v).otherwise(out)
        df = df.withColumn(name, out)
    df.write.mode("overwrite").option("sep", delimiter).option("header", field_names).csv(path)


def write_cases(df: DataFrame, path: str, template: str, *columns: str) -> None:
    """PRINT and WRITE: a formatted line for each case."""
    df.select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)
