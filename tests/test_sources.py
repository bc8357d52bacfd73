import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillstat import Frame, Missing
from quillstat.frame import Meta
from quillstat.session import Session
from quillstat.sources import files, sav


def test_fixed_list_and_free(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("12ab\n 3cd\n")
    assert [tuple(r) for r in files.data_list_fixed(spark, str(p), [("n", 1, 2, "N"), ("s", 3, 4, "A")]).collect()] == [(12.0, "ab"), (3.0, "cd")]
    p.write_text("1,'x y'\n2 z\n")
    assert [tuple(r) for r in files.data_list_list(spark, str(p), [("n", "N"), ("s", "A")]).collect()] == [(1.0, "x y"), (2.0, "z")]
    p.write_text("1 2 3\n4\n5 6 7\n")
    assert [tuple(r) for r in files.data_list_free(spark, str(p), [("a", "N"), ("b", "N")]).orderBy("case").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)]


def test_ods(spark, tmp_path):
    t, o, x = (files._ODS[k] for k in "tox")
    cell = lambda v: f'<t:table-cell o:value="{v}"><x:p>{v}</x:p></t:table-cell>' if isinstance(v, int) else f"<t:table-cell><x:p>{v}</x:p></t:table-cell>"
    table = "".join("<t:table-row>" + "".join(map(cell, r)) + "</t:table-row>" for r in (["n", "s"], [1, "a"], [2, "b"]))
    path = tmp_path / "a.ods"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f'<d xmlns:t="{t}" xmlns:o="{o}" xmlns:x="{x}"><t:table>{table}</t:table></d>')
    assert [tuple(r) for r in files.get_spreadsheet(spark, str(path)).collect()] == [(1.0, "a"), (2.0, "b")]


def read(spark, path, text, names, kind=files.data_list_list, **kw):
    path.write_text(text)
    return [tuple(r) for r in kind(spark, str(path), names, **kw).collect()]


def test_list_fields(spark, tmp_path):
    names = [("a", "N"), ("b", "N"), ("c", "A")]
    text = "1,,3\n,2,x\n 1 , 2 ,'p, q'\n4 5 \"it's\"\n7\n"
    assert read(spark, tmp_path / "l.txt", text, names) == [(1.0, None, "3"), (None, 2.0, "x"), (1.0, 2.0, "p, q"), (4.0, 5.0, "it's"), (7.0, None, "")]
    assert read(spark, tmp_path / "s.txt", "1;;a b\n", names, delimiters=";") == [(1.0, None, "a b")]


def test_free_fields_keep_quotes(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("1 'a b' 2\n\"c,d\"\n3,,4 e\n5")
    got = files.data_list_free(spark, str(path), [("n", "N"), ("s", "A")]).orderBy("case").collect()
    assert [tuple(r)[1:] for r in got] == [(1.0, "a b"), (2.0, "c,d"), (3.0, ""), (4.0, "e")]


def test_fixed_records_and_text_options(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("1a\n10\n2b\n20\n")
    got = files.data_list_fixed(spark, str(path), [("n", 1, 1, "N"), ("s", 2, 2, "A"), ("m", 1, 2, "N", 2)], records=2).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1.0, "a", 10.0), (2.0, "b", 20.0)]
    path.write_text("junk\nn,s\n1,a\n2,\"x\\\"y\"\n3,c\n")
    assert [tuple(r) for r in files.get_text(spark, str(path), "n double, s string", first_case=3, cases=2, escape="\\").orderBy("n").collect()] == [(1.0, "a"), (2.0, 'x"y')]
    path.write_text("1,a,2\nb,3,c\n")
    assert [tuple(r) for r in files.get_text(spark, str(path), "n double, s string", fields_per_case=2).orderBy("n").collect()] == [(1.0, "a"), (2.0, "b"), (3.0, "c")]


def sample(spark):
    long = "é" * 200 + "z" * 300
    rows = [(1.0, "ab", long, 5), (None, "", "", -7), (1e300, "ç c", "short", 1000000), (-3.25, "x" * 9, None, 99)]
    df = spark.createDataFrame(rows, "x double, s string, a_long_name string, n int").coalesce(1)
    meta = Meta(missing={"x": Missing((9.0,), None, -5.0), "n": Missing((1.0, 2.0))}, labels={"x": "an odd label"}, value_labels={"n": {5.0: "five"}}, formats={"x": "F10.3"}, level={"x": "scale", "s": "nominal"}, documents=("one", "two"), title="a file", attributes={"x": {"unit": "cm"}})
    return rows, Frame(df, meta, weight_by="n")


def test_sav_round_trip(spark, tmp_path):
    rows, frame = sample(spark)
    sav.write_sav(frame, str(tmp_path / "out"))
    back = sav.read_sav(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in back.df.collect()] == [(x, s, t or "", float(n)) for x, s, t, n in rows]
    m = back.meta
    assert (m.missing, m.labels, m.value_labels, m.documents, m.title, back.weight_by, m.attributes) == (frame.meta.missing, frame.meta.labels, frame.meta.value_labels, ("one", "two"), "a file", "n", {"x": {"unit": "cm"}})
    assert m.formats["x"] == "F10.3" and m.level["x"] == "scale" and m.level["s"] == "nominal"
    many = Frame(spark.range(0, 50_000, 1, 3).select(F.col("id").cast("double").alias("i")))
    sav.write_sav(many, str(tmp_path / "many"))
    assert sav.read_sav(spark, str(tmp_path / "many")).df.agg(F.sum("i"), F.count("*")).first()[:] == (sum(range(50_000)), 50_000)
    sav.write_sav(Frame(many.df.limit(0)), str(tmp_path / "none"))
    assert sav.read_sav(spark, str(tmp_path / "none")).df.count() == 0


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [0, 1, 2])
def test_sav_layouts(spark, tmp_path, order, compression):
    """A file put together by hand: two cases of a number and a string, plain, byte-coded or deflated, in either byte order."""
    i = lambda *x: struct.pack(f"{order}{len(x)}i", *x)
    d = lambda *x: struct.pack(f"{order}{len(x)}d", *x)
    f = 5 << 16 | 8 << 8 | 2
    head = (b"$FL3" if compression == 2 else b"$FL2") + b"by hand".ljust(60) + i(2, 2, compression, 0, 2) + d(100.0) + b"01 Jan 0000:00:00" + b"t".ljust(64) + b"\0" * 3
    head += i(2, 0, 0, 1, f, f) + b"NUM".ljust(8) + d(9.0) + i(2, 5, 1, 0, 1 << 16 | 5 << 8, 1 << 16 | 5 << 8) + b"STR".ljust(8) + i(3) + b"lab "
    head += i(3, 1) + d(7.0) + b"\x05seven" + b"  " + i(4, 1, 1) + i(999, 0)
    if compression == 0:
        body = d(7.0) + b"abc".ljust(8) + d(sav.SYSMIS) + b" " * 8
    else:
        body = bytes([107, 253, 255, 254, 252, 0, 0, 0]) + b"abc".ljust(8)
    if compression == 2:
        packed, at = zlib.compress(body), len(head)
        trailer = at + 24 + len(packed)
        body = struct.pack(f"{order}3q", at, trailer, 48) + packed + struct.pack(f"{order}2q2i", -100, 0, 0x3FF000, 1) + struct.pack(f"{order}2q2i", at, at + 24, len(body), len(packed))
    (tmp_path / "a.sav").write_bytes(head + body)
    frame = sav.read_sav(spark, str(tmp_path / "a.sav"))
    assert [tuple(r) for r in frame.df.collect()] == [(7.0, "abc"), (None, "")]
    assert frame.meta.value_labels == {"NUM": {7.0: "seven"}} and frame.meta.missing == {"NUM": Missing((9.0,))} and frame.meta.labels == {"STR": "lab"} and frame.meta.formats == {"NUM": "F8.2", "STR": "A5"}


def test_session(spark, tmp_path):
    s = Session(spark)
    s.begin_data(["1 a", "2 b", "3 c"], [("n", "N"), ("t", "A")])
    s.dataset_name("first")
    s.dataset_copy("second")
    s.use(s.active.select_if(F.col("n") > 1))
    assert s.execute() == 2 and s.dataset_activate("second").df.count() == 3
    assert [tuple(r) for r in s.dataset_display().collect()] == [("first", False), ("second", True)]
    s.cd(str(tmp_path))
    s.file_handle("h", "kept")
    later = s.xsave("h", keep=["n"])
    s.new_file()
    later()
    assert s.active is None and s.get("h", rename={"n": "m"}).df.columns == ["m"] and s.execute() == 3
    spark.range(2).write.parquet(str(tmp_path / "p"))
    assert s.get("p").df.count() == 2 and s.sysfile_info("h").first()["name"] == "n"
    s.erase("h")
    with pytest.raises(Exception):
        s.get("h")
    s.preserve()
    s.set(mxloops=7)
    assert s.show("mxloops").first()["value"] == "7"
    s.restore()
    assert s.show("mxloops").first()["value"] == "40"
    s.dataset_close("first")
    s.dataset_declare("third")
    s.dataset_close("ALL")
    assert not s.datasets and s.active is None
    frame = s.input_program("part long, k long", lambda part: ((part, k) for k in range(3 + part)), parts=2)
    assert frame.df.count() == 7 and s.cache().df.agg(F.sum("k")).first()[0] == 9
    s.use(Frame(spark.createDataFrame([("12ab",)], "line string")))
    assert s.reread("line", [("n", 1, 2, "N"), ("s", 3, 4, "A")]).df.first()[1:] == (12.0, "ab")
    s.title("t"), s.subtitle("u"), s.echo("hello"), s.print_space()
    assert (s.titles, s.output) == (["t", "u"], ["hello", ""]) and s.file_label("f").meta.title == "f" and s.variable_display("width", n=5).meta.attributes == {"n": {"$display.width": "5"}}
    assert s.use_all().limit is None
    s.close_file_handle("h"), s.finish()
    assert s.active is None
