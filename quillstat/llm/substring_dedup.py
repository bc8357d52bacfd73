"""Substring deduplication over a log-structured index of window fingerprints.

Every window of ``window`` words has one anchor, the ``anchor``-word window inside
it with the least hash. Equal windows have equal anchors at equal offsets, so a
window can only recur if its anchor's fingerprint does.

The index keeps the fingerprints of all batches in sorted immutable runs, one a
batch, and the batches' texts. A new run is merge-joined with the earlier ones, which
names the batch's fingerprints that recur; runs are compacted by merging when
there are too many. A recurring fingerprint is verified on the whole windows
around it, taken from the texts of the batch and of the history: only windows
whose own hash occurs twice count. Fingerprints that occur at most HOT times are
settled one by one in sorted order; those above are counted by partial sums and
their repeated windows sent to their rows, so a passage in a third of all documents
is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm import _words as W
from quillstat.llm._tables import BROADCAST_ROWS, arrow_batches, discard, forget, new_path, small, store

WINDOW = 35
ANCHOR = 12
#: Bits of a packed minimum that hold the position within a piece of a text.
_POS = 26
#: Occurrences of a fingerprint that a task holds at once; of those that occur more often, windows are counted by partial sums.
HOT = 500
#: Recurring fingerprints, of 16 bytes each, that are broadcast; beyond, anchors and fingerprints are dealt out by fingerprint.
BROADCAST_FINGERPRINTS = 2_000_000
#: Repeated windows of one hot fingerprint that go to each of its anchors; more are joined window by window.
PACKED = 256
#: Bytes of a window's key: a 64-bit hash and, of hot fingerprints, 32 bits of a second one.
KEY, HOT_KEY = 8, 12
#: Texts that a task sends to Python at once.
ROWS = 1_000
#: Runs above which the index merges them all into one.
FAN_IN = 2


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - have :]) if have < n else out


def anchors(first: np.ndarray, hashes: np.ndarray, window: int, anchor: int):
    """(rows, fingerprints, first window, number of windows) of the anchors of a block; a window is named by its first word within its row."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none.view(W.U64), none, none
    if len(hashes) >> _POS:  # too long to pack positions: row by row, long rows in pieces of whole windows
        step, found = (1 << _POS) - window, []
        for r in range(len(first) - 1):
            for lo in range(first[r], first[r + 1], step):
                piece = hashes[lo : min(lo + step + window - 1, first[r + 1])]
                rows, fps, starts, counts = anchors(np.array([0, len(piece)]), piece, window, anchor)
                found.append((rows + r, fps, starts + lo - first[r], counts))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    grams = W.windows(hashes, anchor)
    mask = W.U64((1 << _POS) - 1)
    packed = (W.mix(grams) & ~mask) | np.arange(len(grams), dtype=W.U64)
    place = (_sliding_min(packed, window - anchor + 1) & mask).astype(np.int64)
    words = np.diff(first)
    starts_per_row = np.maximum(0, words - window + 1)
    row = np.repeat(np.arange(len(words)), starts_per_row)
    within = np.arange(len(row)) - np.repeat(np.cumsum(starts_per_row) - starts_per_row, starts_per_row)
    if not len(row):
        return none, none.view(W.U64), none, none
    at = place[first[row] + within]
    heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    return row[heads], grams[at[heads]], within[heads], np.diff(np.r_[heads, len(row)])


def _blocks(column: pa.Array, window: int, anchor: int):
    for lo, data, offsets in W.blocks(column):
        first, _, _, hashes = W.word_table(data, offsets)
        yield lo, first, hashes, anchors(first, hashes, window, anchor)


def _anchor_rows(docs: DataFrame, window: int, anchor: int, key: int) -> DataFrame:
    """(fp, id, tk, mine, start, wins) of the anchors of docs (id, tk, mine, text); wins holds the keys of the anchor's windows, ``key`` bytes each (none: 0)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, first, hashes, (rows, fps, starts, counts) in _blocks(b.column(3), window, anchor):
                if not len(rows):
                    continue
                raw = np.empty((int(counts.sum()) if key else 0, max(key, 1)), np.uint8)
                if key:
                    places = np.repeat(first[rows] + starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                    raw[:, :8] = W.windows(hashes, window)[places].view(np.uint8).reshape(-1, 8)
                    if key > 8:
                        raw[:, 8:] = W.windows(W.mix(hashes ^ W.U64(0xE7037ED1A0B428DB)), window)[places].view(np.uint8).reshape(-1, 8)[:, : key - 8]
                take = pa.array(lo + rows)
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(fps)), *[b.column(k).take(take) for k in range(3)], pa.array(starts.astype(np.int32)), _binary(raw, counts if key else np.zeros(len(rows), np.int64))], ["fp", "id", "tk", "mine", "start", "wins"])

    return docs.mapInArrow(run, f"fp long, id {id_type}, tk int, mine boolean, start int, wins binary")


def fingerprint_counts(docs: DataFrame, text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(fp, n): the anchors of docs and how often each occurs."""
    base = docs.select(F.lit(0).alias("id"), F.lit(0).alias("tk"), F.lit(True).alias("mine"), F.col(text_col).cast("string").alias("text"))
    return _anchor_rows(base, window, anchor, 0).groupBy("fp").agg(F.count("*").alias("n"))


class FingerprintIndex:
    """Sorted immutable runs of (fp, n) and the texts of the batches below ``path``; reopening the path finds them again."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path or new_path(spark, "fingerprints"), fan_in
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(s.getPath().getName()) for s in fs.listStatus(where)] if fs.exists(where) else []
        done = sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))
        self.next = max([int(n.split("-")[1]) + 1 for n in found], default=0)
        self.runs = [n for n in done if n.startswith("run-")]
        self.texts = [n for n in done if n.startswith("texts-")]

    def _read(self, names: list[str], schema: str = "fp long, n long") -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{self.next:08d}"
        self.next += 1
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def ingest(self, counts: DataFrame) -> DataFrame:
        """Add a batch's (fp, n) as a new run and merge-join it with the earlier ones; returns, stored, the batch's fingerprints that occur twice or more by now, and how often."""
        earlier = self._read(list(self.runs)).groupBy("fp").agg(F.sum("n").alias("before"))
        name = self._write(counts.groupBy("fp").agg(F.sum("n").alias("n")).sortWithinPartitions("fp"), "run")
        self.runs.append(name)
        both = self._read([name]).join(earlier, "fp", "left").select("fp", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"))
        return store(both.where("n > 1"), "recurring")

    def keep(self, docs: DataFrame) -> None:
        """Keep the texts of a batch (column text), on which later batches are verified."""
        self.texts.append(self._write(docs.select("text"), "texts"))

    def history(self) -> DataFrame:
        """The texts kept so far."""
        return self._read(list(self.texts), "text string")

    def compact(self, force: bool = False) -> None:
        """Merge all runs into one if there are more than ``fan_in``."""
        if len(self.runs) > (1 if force else self.fan_in):
            old, self.runs = self.runs, [self._write(self._read(self.runs).groupBy("fp").agg(F.sum("n").alias("n")).sortWithinPartitions("fp"), "run")]
            for name in old:
                forget(f"{self.path}/{name}", self.spark)

    def recurring(self) -> DataFrame:
        """Fingerprints that occur twice or more in all that was ingested."""
        return self._read(self.runs).groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")


def _binary(raw: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Keys, so many a row."""
    ends = (np.r_[0, np.cumsum(counts)] * raw.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _keys(wins: pa.Array, key: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(raw keys, their parts of 8 and of 4 bytes, number of each row)."""
    wins = wins.cast(pa.large_binary())
    _, off, buf = wins.buffers()
    ends = np.frombuffer(off, np.int64)[wins.offset : wins.offset + len(wins) + 1]
    raw = np.frombuffer(buf if buf is not None else b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, key)
    parts = [np.ascontiguousarray(raw[:, :8]).view(W.U64).ravel()]
    if key > 8:
        parts.append(np.ascontiguousarray(raw[:, 8:]).view(np.uint32).ravel())
    return raw, parts, np.diff(ends) // key


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row counts."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _spans_of(t: pa.RecordBatch, row: np.ndarray, start: np.ndarray):
    """(id, tk, start, count) of the runs of windows of t's rows; windows come in order within a row."""
    if len(row):
        heads = np.flatnonzero(_changes(row, start - np.arange(len(start))))
        take = pa.array(row[heads])
        yield pa.RecordBatch.from_arrays([t.column("id").take(take), t.column("tk").take(take), pa.array(start[heads].astype(np.int32)), pa.array(np.diff(np.r_[heads, len(row)]).astype(np.int32))], _SPAN)


_SPAN = ["id", "tk", "start", "count"]


def _starts(t: pa.RecordBatch, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of each window of t's rows."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, t.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _settled(batches):
    """Of anchor rows sorted by fp: the spans of windows that another row of the fingerprint has too. Holds 4,096 rows and one fingerprint."""

    def settle(t):
        _, (k,), counts = _keys(t.column("wins"), KEY)
        row, start = _starts(t, counts)
        fp = t.column("fp").to_numpy()[row]
        order = np.lexsort((k, fp))
        heads = np.flatnonzero(_changes(fp[order], k[order])) if len(order) else order
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(np.diff(np.r_[heads, len(order)]) > 1, np.diff(np.r_[heads, len(order)]))
        again &= t.column("mine").to_numpy(zero_copy_only=False)[row]
        yield from _spans_of(t, row[again], start[again])

    tail = None
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            t = b.slice(lo, 4096)
            whole = t if tail is None else pa.Table.from_batches([tail, t]).combine_chunks().to_batches()[0]
            fp = whole.column("fp").to_numpy()
            last = int(np.searchsorted(fp, fp[-1]))
            if last:
                yield from settle(whole.slice(0, last))
            tail = whole.slice(last)
    if tail is not None:
        yield from settle(tail)


def _explode_entries(batches):
    """(fp, n, key) of entries (fp, n, wins)."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            t = b.slice(lo, 4096)
            raw, _, counts = _keys(t.column("wins"), HOT_KEY)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([t.column("fp").take(row), t.column("n").take(row), _binary(raw, np.ones(len(raw), np.int64))], ["fp", "n", "key"])


def _explode_rows(batches):
    """(fp, key, id, tk, start) of anchor rows."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            t = b.slice(lo, 4096)
            raw, _, counts = _keys(t.column("wins"), HOT_KEY)
            row, start = _starts(t, counts)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([t.column("fp").take(take), _binary(raw, np.ones(len(raw), np.int64)), t.column("id").take(take), t.column("tk").take(take), pa.array(start.astype(np.int32))], ["fp", "key", "id", "tk", "start"])


def _marked(batches):
    """The spans of windows of (id, tk, start, wins, keys) that are among the row's keys."""
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            t = b.slice(lo, 1024)
            _, (a1, a2), have = _keys(t.column("wins"), HOT_KEY)
            _, (b1, b2), known = _keys(t.column("keys"), HOT_KEY)
            row, start = _starts(t, have)
            mine = np.arange(len(row) + len(b1)) < len(row)
            every, k1, k2 = np.r_[row, np.repeat(np.arange(t.num_rows), known)], np.r_[a1, b1], np.r_[a2, b2]
            order = np.lexsort((mine, k2, k1, every))  # a known key comes before the windows that have it
            heads = np.flatnonzero(_changes(every[order], k1[order], k2[order]))
            again = np.zeros(len(order), bool)
            again[order] = np.repeat(~mine[order][heads], np.diff(np.r_[heads, len(order)]))
            again = again[: len(row)]
            yield from _spans_of(t, row[again], start[again])


def _merged(batches):
    """Spans (start << 32 | end) of each row with overlapping and touching ones merged, in order."""
    for b in batches:
        spans = b.column("spans")
        ends, x = np.asarray(spans.offsets), spans.values.to_numpy() if len(spans.values) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(b.num_rows), np.diff(ends))
        order = np.lexsort((x[ends[0] : ends[-1]], row))
        row, x = row[order], x[ends[0] : ends[-1]][order]
        start, end = x >> 32, x & 0xFFFFFFFF
        reach = np.maximum.accumulate((row << 32) | end)  # rows come in order, so this never looks past a row
        heads = _changes(row) if len(row) else np.zeros(0, bool)
        heads[1:] |= ((row[1:] << 32) | start[1:]) > reach[:-1]
        at = np.flatnonzero(heads)
        last = reach[np.r_[at[1:] - 1, len(row) - 1]] & 0xFFFFFFFF if len(at) else at
        merged = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(b.num_rows + 1)).astype(np.int32)), pa.array((start[at] << 32) | last))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), merged], ["sid", "stk", "spans"])


def repeated_spans(docs: DataFrame, recurring: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, tk, start, count): runs of windows of docs (id, tk, mine, text) that occur twice or more among docs; only rows that are mine are reported. ``recurring`` is stored and names the fingerprints that may recur and how often they do at most."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, tk int, start int, count int"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = recurring.where(F.col("n") <= HOT).select("fp")
    if recurring.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS:
        cold = _anchor_rows(docs, window, anchor, KEY).join(F.broadcast(few), "fp", "left_semi").repartition(parts, "fp")
    else:  # both sides are dealt out alike, so the join adds no exchange and a fingerprint's rows stay together
        cold = _anchor_rows(docs, window, anchor, KEY).repartition(parts, "fp").join(few.repartition(parts, "fp").hint("merge"), "fp", "left_semi")
    spans = cold.sortWithinPartitions("fp").mapInArrow(_settled, schema)
    hot = store(recurring.where(F.col("n") > HOT).select("fp"), "hot-fingerprints")
    if hot.isEmpty():
        return spans
    rows = store(_anchor_rows(docs, window, anchor, HOT_KEY).join(small(hot), "fp", "left_semi"), "hot-rows")
    entries = rows.groupBy("fp", "wins").agg(F.count("*").alias("n")).select("fp", "n", "wins")
    keys = entries.mapInArrow(_explode_entries, "fp long, n long, key binary")
    keys = store(keys.groupBy("fp", "key").agg(F.sum("n").alias("n")).where("n > 1").select("fp", "key"), "repeated-keys")
    narrow = keys.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") <= PACKED).select("fp")
    joined = F.expr("aggregate(keys, cast('' as binary), (a, x) -> concat(a, x))")
    packed = store(keys.join(narrow, "fp", "left_semi").groupBy("fp").agg(F.collect_list("key").alias("keys")).select("fp", joined.alias("keys")), "repeated-packed")
    wide = store(keys.join(packed, "fp", "left_anti"), "repeated-wide")
    mine = rows.where("mine")
    spans = spans.unionByName(mine.join(small(packed, BROADCAST_ROWS // 100), "fp").select("id", "tk", "start", "wins", "keys").mapInArrow(_marked, schema))
    if wide.isEmpty():
        return spans
    many = mine.join(small(store(wide.select("fp").distinct(), "wide")), "fp", "left_semi").select("fp", "id", "tk", "start", "wins")
    many = many.mapInArrow(_explode_rows, f"fp long, key binary, id {kind}, tk int, start int").join(wide, ["fp", "key"], "left_semi")
    return spans.unionByName(many.select("id", "tk", "start", F.lit(1).alias("count")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, index: FingerprintIndex | None = None, batches: int = FAN_IN + 1) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept (the kept words joined by one space).

    Each word covered by a window whose word sequence starts anywhere else too,
    in the same document or another, is removed; windows are judged on the input.
    docs are ingested into ``index`` in ``batches`` by a hash of the id and then
    judged against themselves and all that it held before, so a given index also
    judges against the documents of earlier calls, whose texts it keeps. Documents
    given again to the same index repeat themselves. Without an index one is made and
    dropped.

    Null and empty texts have no words and give an empty ``kept``. Rows that
    repeat id and text are documents of their own, so they repeat each other.
    Null ids are allowed. Other columns are ignored. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    own = FingerprintIndex(spark) if index is None else index
    base = docs.select(F.col(id_col).alias("id"), F.hash(F.col(text_col).cast("string")).alias("tk"), F.lit(True).alias("mine"), F.col(text_col).cast("string").alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    every = base
    if own.texts:
        every = base.unionByName(own.history().select(F.lit(None).cast(id_type).alias("id"), F.lit(0).alias("tk"), F.lit(False).alias("mine"), "text"))
    found = []
    for k in range(batches):
        part = base.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        with arrow_batches(spark, ROWS):
            found.append(own.ingest(fingerprint_counts(part, "text", window, anchor)))
        own.compact()
    if index is None:
        forget(own.path, spark)
    else:
        own.keep(base)
    # A fingerprint that recurs is found by the last batch that holds it, with its whole number.
    recurring = store(reduce(DataFrame.unionByName, found).groupBy("fp").agg(F.max("n").alias("n")), "recurring")
    discard(*found)
    with arrow_batches(spark, ROWS):
        spans = repeated_spans(every, recurring, window, anchor)
    words = F.collect_list(F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("start").cast("long") + F.col("count") + (window - 1)))
    spans = spans.groupBy(F.col("id").alias("sid"), F.col("tk").alias("stk")).agg(words.alias("spans"))
    with arrow_batches(spark, ROWS):
        spans = store(spans.mapInArrow(_merged, f"sid {id_type}, stk int, spans array<long>"), "doc-spans")
    discard(recurring)
    n, values = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    side = F.broadcast(spans) if n <= BROADCAST_ROWS and values <= 4 * BROADCAST_ROWS else spans
    both = base.join(side, F.col("id").eqNullSafe(F.col("sid")) & F.col("tk").eqNullSafe(F.col("stk")), "left").select("id", "text", "spans")

    def run(parts):
        for b in parts:
            spans = b.column(2).to_pylist()
            for lo, data, offsets in W.blocks(b.column(1)):
                starts, ends = W._spans(data, offsets)
                first = np.searchsorted(starts, offsets)
                n, gone, kept = [], [], []
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    s, e = starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist()
                    out = np.zeros(len(s) + 1, np.int64)
                    for x in spans[lo + i] or ():
                        out[x >> 32] += 1
                        out[x & 0xFFFFFFFF] -= 1
                    stay = np.cumsum(out)[:-1] == 0
                    n.append(len(s)), gone.append(int(len(s) - stay.sum()))
                    kept.append(b" ".join([raw[s[j] : e[j]] for j in np.flatnonzero(stay).tolist()]))
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), text], ["id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"id {id_type}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
