"""System files (.sav, .zsav): dictionary and cases, plain, byte-coded or deflated.

A file is one stream, so a file is decoded by one task; a folder of files is read in
parallel, and a frame is written as one file a partition.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstat.frame import Frame, Meta, Missing

#: Fixed values of the format: format type numbers, numbers that stand for missing and for open ends of ranges, measurement levels.
FORMATS = {1: "A", 2: "AHEX", 3: "COMMA", 4: "DOLLAR", 5: "F", 6: "IB", 7: "PIBHEX", 8: "P", 9: "PIB", 10: "PK", 11: "RB", 12: "RBHEX", 15: "Z", 16: "N", 17: "E", 20: "DATE", 21: "TIME", 22: "DATETIME", 23: "ADATE", 24: "JDATE", 25: "DTIME", 26: "WKDAY", 27: "MONTH", 28: "MOYR", 29: "QYR", 30: "WKYR", 31: "PCT", 32: "DOT", 38: "EDATE", 39: "SDATE"}
SYSMIS = -np.finfo(np.float64).max
HIGHEST = np.finfo(np.float64).max
LOWEST = np.nextafter(SYSMIS, 0)
LEVELS = {1: "nominal", 2: "ordinal", 3: "scale"}
#: Bytes of a very long string that a segment of it holds.
SEGMENT = 252
#: Bytes of a file that are read to find its dictionary.
HEAD = 1 << 24
#: Cases of an Arrow batch.
BATCH = 20_000


@dataclass
class Variable:
    name: str
    width: int  # 0: a number
    at: int  # first 8-byte element of a case
    label: str = ""
    missing: Missing | None = None
    format: str = ""
    level: str = ""
    segments: int = 1
    labels: dict = field(default_factory=dict)


@dataclass
class Dictionary:
    variables: list[Variable]
    elements: int  # 8-byte elements of a case
    compression: int
    bias: float
    order: str  # byte order
    encoding: str
    data: int  # where the cases begin
    weight: str | None = None
    label: str = ""
    documents: tuple[str, ...] = ()
    attributes: dict = field(default_factory=dict)

    def schema(self) -> str:
        return ", ".join(f"`{v.name}` {'string' if v.width else 'double'}" for v in self.variables)


class _Reader:
    def __init__(self, raw: bytes, order: str):
        self.raw, self.order, self.at = raw, order, 0

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file ends within its dictionary")
        self.at += n
        return out

    def ints(self, n: int = 1):
        out = struct.unpack(f"{self.order}{n}i", self.take(4 * n))
        return out[0] if n == 1 else out

    def floats(self, n: int):
        return struct.unpack(f"{self.order}{n}d", self.take(8 * n))


def is_sav(raw: bytes) -> bool:
    return raw[:4] in (b"$FL2", b"$FL3")


def read_dictionary(raw: bytes) -> Dictionary:
    if not is_sav(raw):
        raise ValueError("not a system file")
    order = "<" if struct.unpack("<i", raw[64:68])[0] in (2, 3) else ">"
    r = _Reader(raw, order)
    r.at = 64
    _, _, compression, weight_at, _ = r.ints(5)
    bias = r.floats(1)[0]
    r.take(17)
    file_label = r.take(64)
    r.take(3)
    raw_vars, labels, documents, extra = [], [], [], {}
    element = 0
    while (kind := r.ints()) != 999:
        if kind == 2:
            width, has_label, n_missing, print_, _ = r.ints(5)
            name = r.take(8)
            text = b""
            if has_label:
                n = r.ints()
                text = r.take(-(-n // 4) * 4)[:n]
            values = [r.take(8) for _ in range(abs(n_missing))]
            if width >= 0:
                raw_vars.append([name, width, element, text, n_missing, values, print_])
            element += 1
        elif kind == 3:
            found = []
            for _ in range(r.ints()):
                value, n = r.take(8), r.take(1)[0]
                found.append((value, r.take(-(-(n + 1) // 8) * 8 - 1)[:n]))
            if r.ints() != 4:
                raise ValueError("value labels without variables")
            n = r.ints()
            labels.append((found, [r.ints() for _ in range(n)]))
        elif kind == 6:
            documents = [r.take(80) for _ in range(r.ints())]
        elif kind == 7:
            sub, size, count = r.ints(3)
            extra[sub] = r.take(size * count)
        else:
            raise ValueError(f"record of unknown type {kind}")
    r.ints()
    encoding = extra.get(20, b"").decode("ascii", "replace").strip() or "utf-8"
    try:
        "".encode(encoding)
    except LookupError:
        encoding = "latin-1"
    word = lambda b: b.decode(encoding, "replace").rstrip(" \0")
    number = lambda b: struct.unpack(f"{order}d", b)[0]
    long_names = dict(x.split("=", 1) for x in word(extra.get(13, b"")).split("\t") if "=" in x)
    very_long = {x.split("=")[0]: int(x.split("=")[1].strip("\0 ")) for x in extra.get(14, b"").decode(encoding, "replace").split("\t") if "=" in x}
    shows = struct.unpack(f"{order}{len(extra.get(11, b'')) // 4}i", extra.get(11, b""))
    per = len(shows) // len(raw_vars) if raw_vars and len(shows) % len(raw_vars) == 0 else 0
    variables, by_element, skip, short = [], {}, 0, {}
    for i, (name, width, at, text, n_missing, values, print_) in enumerate(raw_vars):
        if skip:
            skip -= 1
            continue
        name = word(name)
        v = Variable(long_names.get(name, name), width, at, word(text))
        if name in very_long:
            v.width, v.segments = very_long[name], -(-very_long[name] // SEGMENT)
            skip = v.segments - 1
        kind, w, d = print_ >> 16, print_ >> 8 & 255, print_ & 255
        v.format = f"{FORMATS.get(kind, 'F')}{v.width if width else w}" + (f".{d}" if d else "")
        value = (lambda b: word(b)) if width else number
        if n_missing > 0:
            v.missing = Missing(tuple(map(value, values)))
        elif n_missing < 0:
            low, high = map(number, values[:2])
            v.missing = Missing(tuple(map(number, values[2:])), None if low <= LOWEST else low, None if high >= HIGHEST else high)
        if per >= 2:
            v.level = LEVELS.get(shows[i * per], "")
        variables.append(v)
        by_element[at + 1] = short[name] = v
    for found, at in labels:
        for k in at:
            if k in by_element:
                v = by_element[k]
                v.labels = {(word(b) if v.width else number(b)): word(text) for b, text in found}
    attributes = {}
    for part in word(extra.get(18, b"")).split("/"):
        name, _, rest = part.partition(":")
        if rest:
            attributes[name] = {k: x.strip("'") for k, x in (e.rstrip(")").split("(", 1) for e in rest.replace("\n", "").split(")") if "(" in e)}
    weight = by_element[weight_at].name if weight_at in by_element else None
    return Dictionary(variables, element, compression, bias, order, encoding, r.at, weight, word(file_label), tuple(map(word, documents)), attributes)


def _inflated(raw: bytes, d: Dictionary) -> bytes:
    _, trailer, _ = struct.unpack(f"{d.order}3q", raw[d.data : d.data + 24])
    n = struct.unpack(f"{d.order}i", raw[trailer + 20 : trailer + 24])[0]
    out = []
    for k in range(n):
        _, at, _, size = struct.unpack(f"{d.order}2q2i", raw[trailer + 24 + 24 * k : trailer + 48 + 24 * k])
        out.append(zlib.decompress(raw[at : at + size]))
    return b"".join(out)


def _elements(raw: bytes, d: Dictionary) -> np.ndarray:
    """All 8-byte elements of the cases, a row a case."""
    if d.compression == 0:
        body = np.frombuffer(raw, np.uint8, offset=d.data)
    else:
        data = np.frombuffer(_inflated(raw, d) if d.compression == 2 else raw[d.data :], np.uint8)
        # Eight codes are followed by as many raw elements as there are codes 253 among them.
        heads, at, is_raw = [], 0, np.r_[data == 253, np.zeros(8, bool)]
        while at + 1 <= len(data):
            heads.append(at)
            at += 8 + 8 * int(np.count_nonzero(is_raw[at : at + 8]))
        place = np.array(heads, np.int64)[:, None] + np.arange(8)
        codes = np.where(place < len(data), data[np.minimum(place, len(data) - 1)] if len(data) else 0, 0).ravel()
        raws = (np.cumsum((codes == 253).reshape(-1, 8), axis=1) - 1) * 8 + (place[:, :1] + 8)
        end = np.flatnonzero(codes == 252)
        stop = end[0] if len(end) else len(codes)
        codes, raws = codes[:stop], raws.ravel()[:stop]
        used = codes != 0
        codes, raws = codes[used], raws[used]
        values = np.where(codes == 255, SYSMIS, codes.astype(np.float64) - d.bias).astype(f"{d.order}f8")
        body = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).copy()
        body[codes == 254] = 32
        at = np.flatnonzero(codes == 253)
        body[at] = data[raws[at][:, None] + np.arange(8)]
        body = body.ravel()
    cases = len(body) // (8 * d.elements) if d.elements else 0
    return body[: cases * 8 * d.elements].reshape(cases, 8 * d.elements)


def decode(raw: bytes, d: Dictionary):
    """Arrow batches of the cases; missing numbers are null, strings lose trailing blanks."""
    rows = _elements(raw, d)
    for lo in range(0, len(rows), BATCH):
        part, columns = rows[lo : lo + BATCH], []
        for v in d.variables:
            if not v.width:
                x = np.ascontiguousarray(part[:, 8 * v.at : 8 * v.at + 8]).view(f"{d.order}f8").ravel().astype(np.float64)
                columns.append(pa.array(x, mask=x == SYSMIS))
                continue
            texts, at, left = [b""] * len(part), 8 * v.at, v.width
            for _ in range(v.segments):
                n = min(left, SEGMENT if v.segments > 1 else left)
                block = np.ascontiguousarray(part[:, at : at + n]).tobytes()
                texts = [t + block[i * n : (i + 1) * n] for i, t in enumerate(texts)]
                at, left = at + (256 if v.segments > 1 else -(-n // 8) * 8), left - n
            columns.append(pa.array([t.decode(d.encoding, "replace").rstrip(" \0") for t in texts]))
        yield pa.RecordBatch.from_arrays(columns, [v.name for v in d.variables])


def read_sav(spark: SparkSession, path: str) -> Frame:
    """The cases and dictionary of a file or of the files of a folder, which must share a dictionary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    first = files.orderBy("path").select(F.substring("content", 1, HEAD).alias("head")).first()
    if first is None:
        raise FileNotFoundError(path)
    d = read_dictionary(bytes(first["head"]))

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_py()
                yield from decode(raw, read_dictionary(raw))

    df = files.select("content").mapInArrow(run, d.schema())
    named = lambda get: {v.name: x for v in d.variables if (x := get(v))}
    meta = Meta(missing=named(lambda v: v.missing), labels=named(lambda v: v.label), value_labels=named(lambda v: v.labels), formats=named(lambda v: v.format), level=named(lambda v: v.level), attributes=d.attributes, documents=d.documents, title=d.label)
    return Frame(df, meta, weight_by=d.weight)


def _header(columns: list[tuple[str, int]], meta: Meta, weight: str | None) -> bytes:
    """Everything before the cases; columns are (name, width)."""
    i = lambda *x: struct.pack(f"<{len(x)}i", *x)
    padded = lambda b, n: b + b" " * (-len(b) % n)
    codes = {v: k for k, v in FORMATS.items()}
    records, ext, at, place, names, shows, long_strings = [], [], 0, {}, [], [], []

    def variable(short: bytes, width: int, label: str, missing: Missing | None, format_: int):
        nonlocal at
        text = label.encode()
        values, n = [], 0
        if missing:
            num = lambda x: struct.pack("<d", x)
            one = (lambda x: x.encode()[:8].ljust(8)) if width else (lambda x: num(float(x)))
            values = [one(x) for x in missing.values]
            n = len(values)
            if missing.low is not None or missing.high is not None:
                values = [num(LOWEST if missing.low is None else missing.low), num(HIGHEST if missing.high is None else missing.high), *values]
                n = -len(values)
        records.append(i(2, width, int(bool(text)), n, format_, format_) + short.ljust(8) + (i(len(text)) + padded(text, 4) if text else b"") + b"".join(values))
        for _ in range(max(1, -(-width // 8)) - 1):
            records.append(i(2, -1, 0, 0, 0, 0) + b" " * 8)
        at += max(1, -(-width // 8))

    for k, (name, width) in enumerate(columns):
        short = f"V{k:X}".encode()
        place[name] = at + 1
        spec = meta.formats.get(name, "")
        kind = spec.rstrip("0123456789.") or ("A" if width else "F")
        digits, _, decimals = spec[len(kind) :].partition(".")
        first = min(width, 255)
        code = codes.get(kind, 5) << 16 | (first if width else int(digits or 8)) << 8 | (0 if width else int(decimals or (0 if digits else 2)))
        pieces = -(-width // SEGMENT) if width > 255 else 1
        for p in range(pieces):
            last = width - SEGMENT * (pieces - 1)
            w = first if pieces == 1 else 255 if p < pieces - 1 else last
            variable(short if p == 0 else f"S{k:X}_{p:X}".encode()[:8], w, meta.labels.get(name, "") if p == 0 else "", meta.missing.get(name) if p == 0 and pieces == 1 else None, code if p == 0 else 1 << 16 | w << 8)
            shows.append(i({v: n for n, v in LEVELS.items()}.get(meta.level.get(name), 1 if width else 3), 8, 0 if width else 1))
        if pieces > 1:
            long_strings.append(short + b"=%05d" % width + b"\0\t")
        names.append(short + b"=" + name.encode())
    for name, labels in meta.value_labels.items():
        width = dict(columns).get(name)
        if width is None or width > 8 or not labels:
            continue
        out = i(3, len(labels))
        for value, text in labels.items():
            raw = (str(value).encode()[:8].ljust(8) if width else struct.pack("<d", float(value))) + bytes([len(text.encode()[:120])]) + text.encode()[:120]
            out += raw + b" " * (-(len(raw) - 8) % 8)
        records.append(out + i(4, 1, place[name]))
    if meta.documents:
        records.append(i(6, len(meta.documents)) + b"".join(line.encode()[:80].ljust(80) for line in meta.documents))
    extension = lambda sub, size, data: i(7, sub, size, len(data) // size) + data
    ext += [extension(3, 4, i(1, 0, 0, -1, 1, 1, 2, 65001)), extension(4, 8, struct.pack("<3d", SYSMIS, HIGHEST, LOWEST)), extension(11, 4, b"".join(shows)), extension(13, 1, b"\t".join(names))]
    if long_strings:
        ext.append(extension(14, 1, b"".join(long_strings)))
    if meta.attributes:
        ext.append(extension(18, 1, "/".join(f"{n}:" + "".join(f"{k}('{v}'\n)" for k, v in a.items()) for n, a in meta.attributes.items()).encode()))
    ext.append(extension(20, 1, b"UTF-8"))
    head = b"$FL2" + b"quillstat".ljust(60) + i(2, at, 1, place.get(weight or "", 0), -1) + struct.pack("<d", 100.0) + b"01 Jan 0000:00:00" + meta.title.encode()[:64].ljust(64) + b"\0" * 3
    return head + b"".join(records) + b"".join(ext) + i(999, 0)


def _coded(elements: np.ndarray, numeric: np.ndarray) -> bytes:
    """Byte codes of 8-byte elements; ``numeric`` tells which hold numbers."""
    x = np.ascontiguousarray(elements).view("<f8").ravel()
    codes = np.full(len(x), 253, np.uint8)
    small = numeric & (np.floor(x) == x) & (x >= -99) & (x <= 151)
    codes[small] = (x[small] + 100).astype(np.uint8)
    codes[numeric & (x == SYSMIS)] = 255
    codes[~numeric & (elements == 32).all(axis=1)] = 254
    pad = -len(codes) % 8
    codes, elements = np.r_[codes, np.zeros(pad, np.uint8)].reshape(-1, 8), np.vstack([elements, np.zeros((pad, 8), np.uint8)]).reshape(-1, 8, 8)
    return b"".join(c.tobytes() + e[c == 253].tobytes() for c, e in zip(codes, elements, strict=True))


def write_sav(frame: Frame, path: str) -> None:
    """Write the frame's cases and dictionary below ``path``, a file for each partition with cases (one for an empty frame)."""
    df, meta = frame.df, frame.meta
    kinds = [f.dataType.typeName() == "string" for f in df.schema.fields]
    widths = df.agg(F.lit(0), *[F.coalesce(F.max(F.octet_length(F.col(f"`{c}`"))), F.lit(1)) for c, s in zip(df.columns, kinds, strict=True) if s]).first()[1:]
    each = iter(widths)
    columns = [(c, max(1, next(each)) if s else 0) for c, s in zip(df.columns, kinds, strict=True)]
    header = _header(columns, meta, frame.weight_by)
    cast = df.select(*[F.col(f"`{c}`").cast("string" if s else "double").alias(c) for c, s in zip(df.columns, kinds, strict=True)])

    def run(batches):
        body = []
        for b in batches:
            if not b.num_rows:
                continue
            blocks, numeric = [], []
            for k, (_, width) in enumerate(columns):
                if not width:
                    x = np.where(b.column(k).is_null().to_numpy(zero_copy_only=False), SYSMIS, b.column(k).fill_null(0.0).to_numpy(zero_copy_only=False))
                    blocks.append(x.astype("<f8").view(np.uint8).reshape(-1, 8))
                    numeric.append(True)
                    continue
                texts = [(t or "").encode() for t in b.column(k).to_pylist()]
                pieces = -(-width // SEGMENT) if width > 255 else 1
                for p in range(pieces):
                    w = width if pieces == 1 else SEGMENT if p < pieces - 1 else width - SEGMENT * (pieces - 1)
                    size = 256 if p < pieces - 1 else -(-w // 8) * 8
                    raw = b"".join(t[SEGMENT * p : SEGMENT * p + w].ljust(size) if pieces > 1 else t[:w].ljust(size) for t in texts)
                    blocks.append(np.frombuffer(raw, np.uint8).reshape(len(texts), size))
                    numeric += [False] * (size // 8)
            rows = np.hstack(blocks)
            body.append((rows.reshape(-1, 8), np.tile(np.array(numeric), len(rows))))
        if body:
            coded = _coded(np.vstack([e for e, _ in body]), np.concatenate([n for _, n in body]))
            yield pa.RecordBatch.from_arrays([pa.array([header + coded], pa.large_binary()).cast(pa.binary())], ["content"])

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(where, True)
    fs.mkdirs(where)
    n = 0
    for row in cast.mapInArrow(run, "content binary").toLocalIterator():
        _put(jvm, fs, f"{path}/part-{n:05d}-{uuid.uuid4().hex}.sav", bytes(row["content"]))
        n += 1
    if not n:
        _put(jvm, fs, f"{path}/part-00000.sav", header)


def _put(jvm, fs, path: str, content: bytes) -> None:
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        for lo in range(0, len(content), 1 << 22):
            out.write(bytearray(content[lo : lo + (1 << 22)]))
    finally:
        out.close()

