"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A CGK walk reads a word sequence: at step j it emits the word under its pointer
and moves on by one random bit of (j, word), so sequences at a small edit
distance fall back into step and their outputs are at a small Hamming distance.
A few sampled coordinates of the output, hashed, are a bucket key; WALKS walks
with SAMPLES samples each bring the recall to 0.9 or more at the most edits allowed,
at every item size (a test measures it against full edit distance). Windows are as long as an
item's size class, embedded at each word of an item that has room for one and at every few words of
a document, so each side's windows meet. Candidates are verified by the exact edit
distance, in words, of the whole item to the best matching passage.

What the buckets miss is joined by a search that misses none: an item cut into one
piece more than its allowed edits has a piece that no edit touches, and pieces are
looked up exactly at each word of a document. Items under MIN_WORDS words allow no
edits and are one piece.

Items are small next to documents: they are taken in blocks of bounded size, each
of which is sent to all tasks, and documents never shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm import _words as W
from quillstat.llm._tables import store

#: Items of fewer words match only exactly.
MIN_WORDS = 8
#: Edit distance of a match: at most this share of the item's words.
MAX_EDITS = 0.25
#: Walks, samples of each walk, and coordinates of a sample.
WALKS, SAMPLES, COORDINATES = 3, 8, 5
STRIDE = 4
#: Items sent to the tasks at once.
BLOCK_ITEMS = 2000
_BLOOM = 20

_FOLD = W._LOWER.copy()
_FOLD[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, word hashes): A-Z lowered, ASCII punctuation read as blanks."""
    first, _, _, hashes = W.word_table(_FOLD[data], offsets)
    return first, hashes


def window_size(words: int) -> int:
    """The item's size class: the greatest power of two that leaves room for a window at each of STRIDE words."""
    return 1 << (max(words - STRIDE + 1, 2).bit_length() - 1)


def allowed(words: int, max_edits: float) -> int:
    """Edits that a match of an item of so many words may have."""
    return int(max_edits * words) if words >= MIN_WORDS else 0


def piece_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on; none where fewer are left."""
    return W.mix(W.windows(hashes, length) ^ W.U64(length))


def keys(hashes: np.ndarray, at: np.ndarray, end: np.ndarray, size: int):
    """Bucket keys (one array for each walk and sample) of the windows that start at ``at``; words from ``end`` on read as nothing."""
    padded = np.r_[hashes, np.zeros(1, W.U64)]
    steps = 2 * size
    end = np.minimum(end, len(hashes))
    for walk in range(WALKS):
        bits = W.mix(padded ^ W.U64(0xA24BAED4963EE407 * (walk + 1) & 0xFFFFFFFFFFFFFFFF))
        rng = np.random.default_rng([size, walk, 11])
        samples = [set(rng.choice(steps, min(COORDINATES, steps), replace=False).tolist()) for _ in range(SAMPLES)]
        out = [np.full(len(at), W.U64(size * 64 + walk * 8 + s + 1)) for s in range(SAMPLES)]
        place = at.copy()
        for j in range(max(map(max, samples)) + 1):
            if j and j % 64 == 0:  # all bits of the words are used up
                bits = W.mix(bits)
            here = np.where(place < end, place, len(hashes))
            chosen = [s for s in range(SAMPLES) if j in samples[s]]
            if chosen:
                words = padded[here]
                for s in chosen:
                    out[s] = out[s] * W.U64(W.WORD_BASE) + words
            place += ((bits[here] >> W.U64(j % 64)) & W.U64(1)).astype(np.int64)
        yield from (W.mix(x) for x in out)


def edit_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end): least edit distance of item to any passage of text, and the end of the first such passage."""
    row = np.zeros(len(text) + 1, np.int64)
    column = np.arange(len(text) + 1)
    for w in item:
        step = row + 1
        np.minimum(step[1:], row[:-1] + (text != w), out=step[1:])
        step -= column
        np.minimum.accumulate(step, out=step)
        step += column
        row = step
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Items:
    """A block of items: their words, and bucket tables by window size."""

    ids: list
    words: list[np.ndarray]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # size -> keys, items, offsets
    blooms: dict[int, np.ndarray] = field(default_factory=dict)
    max_edits: float = MAX_EDITS
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # words -> keys, items, offsets
    piece_blooms: dict[int, np.ndarray] = field(default_factory=dict)
    plain: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        by_size: dict[int, list] = {}
        self.plain = [w.tolist() for w in self.words]
        by_length: dict[int, list] = {}
        for i, w in enumerate(self.words):
            cuts = np.linspace(0, len(w), min(allowed(len(w), self.max_edits) + 1, len(w)) + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                by_length.setdefault(b - a, []).append((piece_keys(w[a:b], b - a), np.full(1, i), np.full(1, a)))
            if len(w) < MIN_WORDS:
                continue
            size = window_size(len(w))
            at = np.arange(len(w) - size + 1)
            for slot, k in enumerate(keys(w, at, np.full(len(at), len(w)), size)):
                by_size.setdefault(size, []).append((k ^ W.U64(slot), np.full(len(at), i), at))
        for by, tables, blooms in ((by_size, self.tables, self.blooms), (by_length, self.pieces, self.piece_blooms)):
            for size, parts in by.items():
                k, i, o = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(k)
                tables[size] = k[order], i[order], o[order]
                blooms[size] = np.zeros(1 << _BLOOM, bool)
                blooms[size][k >> W.U64(64 - _BLOOM)] = True

    def search(self, first: np.ndarray, hashes: np.ndarray):
        """(row, item, distance, start, end) of the best passage of each matching item in each row."""
        none = np.zeros(0, np.int64)
        lines, which, begins = [none], [none], [none]
        for length, (table, items, offsets) in self.pieces.items():
            k = piece_keys(hashes, length)
            hit = np.flatnonzero(self.piece_blooms[length][k >> W.U64(64 - _BLOOM)])
            in_row = np.searchsorted(first, hit, "right") - 1
            whole = hit + length <= first[in_row + 1]
            hit, in_row = hit[whole], in_row[whole]
            lo, hi = np.searchsorted(table, k[hit], "left"), np.searchsorted(table, k[hit], "right")
            n = hi - lo
            y = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x = np.repeat(np.arange(len(hit)), n)
            lines.append(in_row[x]), which.append(items[y]), begins.append(hit[x] - first[in_row[x]] - offsets[y])
        for size, (table, items, offsets) in self.tables.items():
            stride = min(STRIDE, size)
            counts = np.maximum(0, (np.diff(first) - 1) // stride + 1)
            row = np.repeat(np.arange(len(counts)), counts)
            if not len(row):
                continue
            at = first[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
            end = first[row + 1]
            bloom = self.blooms[size]
            for slot, k in enumerate(keys(hashes, at, end, size)):
                k = k ^ W.U64(slot)
                hit = np.flatnonzero(bloom[k >> W.U64(64 - _BLOOM)])
                lo, hi = np.searchsorted(table, k[hit], "left"), np.searchsorted(table, k[hit], "right")
                n = hi - lo
                y = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                x = np.repeat(hit, n)
                lines.append(row[x]), which.append(items[y]), begins.append(at[x] - first[row[x]] - offsets[y])
        # Passages that begin within a word of each other are verified once, with room to spare.
        found = np.unique(np.stack([np.concatenate(lines), np.concatenate(which), np.concatenate(begins) // 2 * 2]), axis=1).T.tolist()
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, i, begin in found:
            item = self.words[i]
            most = allowed(len(item), self.max_edits)
            text = hashes[first[r] : first[r + 1]]
            lo, hi = max(0, begin - most - 2), min(len(text), begin + len(item) + most + 3)
            # Each item word that the passage lacks costs an edit at least.
            if hi <= lo or sum(map(set(text[lo:hi].tolist()).__contains__, self.plain[i])) < len(item) - most:
                continue
            d, stop = edit_passage(item, text[lo:hi])
            if d <= most and d < best.get((r, i), (most + 1,))[0]:
                _, back = edit_passage(item[::-1], text[lo : lo + stop][::-1])
                best[r, i] = d, lo + stop - back, lo + stop
        for (r, i), (d, start, stop) in best.items():
            yield r, i, d, start, stop


def _items(rows, max_edits: float) -> Items:
    ids, words = [], []
    for r in rows:
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        _, h = folded_words(data, np.array([0, len(data)]))
        if len(h):
            ids.append(r["id"]), words.append(h)
    return Items(ids, words, max_edits=max_edits)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document and item where a passage of the document is within ``max_edits`` of the item: id, item id, item_words, distance, start_word, end_word (the best passage).

    Items of fewer than MIN_WORDS words match without edits only; null texts have
    no words, and an item without words matches nothing. Repeated rows of either table each give their rows. Null ids are
    carried. An empty table on either side gives an empty table. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64("text", "id"), F.lit(1 << 20))
    items = store(benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text")).withColumn("block", block), "items")
    blocks = max(1, -(-items.count() // block_items))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, item_words long, distance long, start_word long, end_word long"
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for n in range(blocks):
        sent = spark.sparkContext.broadcast(_items(items.where(F.col("block") % blocks == n).collect(), max_edits))

        def run(batches, sent=sent):
            these = sent.value
            for b in batches:
                rows, found = [], []
                for lo, data, offsets in W.blocks(b.column(1)):
                    for r, i, *rest in these.search(*folded_words(data, offsets)):
                        rows.append(lo + r)
                        found.append((these.ids[i], len(these.words[i]), *rest))
                if rows:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *[pa.array(c) for c in cols]], ["id", "item", "item_words", "distance", "start_word", "end_word"])

        part = base.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col if item_col != id_col else f"benchmark_{item_col}")
