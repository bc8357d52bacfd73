"""Toxicity by compression distance: windows are compressed with a zstandard dictionary of toxic and one of ordinary text.

Windows are runs of WORDS words. Both dictionaries begin as the windows of their
class's labelled texts, half against half. The stretches of toxic texts that the
toxic dictionary shortens more than the ordinary one does are then what the next
toxic dictionary is trained on, so that over a few rounds it narrows down to what
is toxic in toxic texts. Both end in the same trained base of ordinary text, which
keeps their lengths equal on everything else.

Lengths in whole bytes are coarse for short windows, so each byte is first written as
WIDTH bytes. A document is described by the differences of its windows' two
lengths: the greatest ones and how many reach each of THRESHOLDS, and the same of the
single words of windows that stand out; a logistic fit and
isotonic regression on differences from the other half's dictionaries calibrate
them to a probability.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.llm import _words as W
from quillstat.llm._fitting import SAMPLE_ROWS, calibrated, isotonic, labelled_sample

#: Words of a window, and bytes that each byte of a window becomes.
WORDS, WIDTH = 4, 2
LEVEL = 13
#: Rounds in which the toxic dictionary is narrowed.
ROUNDS = 2
#: Bytes of the base of ordinary text and of what each class adds to it.
BASE, OWN = 400_000, 6_000
#: Bytes of the raw dictionaries of the first round.
FIRST = 6_000_000
#: A window, and then a word of it, is kept for the next dictionary if its difference is greater.
WINDOW_OVER, WORD_OVER = 2, 1
#: Windows are compared if the ordinary dictionary shortens them no better than all but this share of the telling ones.
OPEN = 0.05
#: Most windows of each class and half that the dictionaries are trained on, chosen by a hash.
TRAIN_WINDOWS = 100_000
#: Differences in bytes whose windows are counted.
THRESHOLDS = (1, 2, 3, 4, 5, 7, 9, 12)
FEATURES = 3 + 2 * len(THRESHOLDS) + 2 + len(THRESHOLDS)
#: Windows compressed at once.
BATCH = 50_000

_rng = random.Random(7)
_WIDE = np.array([[_rng.randrange(256) for _ in range(WIDTH)] for _ in range(256)], np.uint8)
_WIDE[65:91] = _WIDE[97:123]
_WIDE[9:14] = _WIDE[32]


def windows(data: np.ndarray, offsets: np.ndarray, words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end byte) of the windows of a block, each with the blanks around it; a row's last window may be shorter."""
    words = words or WORDS
    starts, ends = W._spans(data, offsets)
    first = np.searchsorted(starts, offsets)
    n = -(-np.diff(first) // words)
    row = np.repeat(np.arange(len(n)), n)
    head = first[row] + words * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    tail = np.minimum(head + words, first[row + 1]) - 1
    return row, np.maximum(starts[head] - 1, offsets[row]), np.minimum(ends[tail] + 1, offsets[row + 1])


def widened(text: bytes | np.ndarray) -> bytes:
    return _WIDE[np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text].tobytes()


def _lengths(compressor: zstandard.ZstdCompressor, wide: bytes, segments: np.ndarray) -> np.ndarray:
    """Compressed length of each (offset, length) of ``wide``."""
    if not len(segments):
        return np.zeros(0, np.int64)
    out = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(wide, segments.astype(np.uint64).tobytes()))
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


@dataclass
class Dictionaries:
    """Contents of the two dictionaries; compressors are made where they are used."""

    toxic: bytes
    ordinary: bytes
    open: float = 0.0  # windows that the ordinary dictionary brings below this share of their length differ by 0

    def __post_init__(self):
        self._made = None

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "open": self.open, "_made": None}

    def differences(self, wide: bytes, segments: np.ndarray) -> np.ndarray:
        """Bytes that the ordinary dictionary needs beyond the toxic one for each (offset, length) of ``wide``."""
        if self._made is None:
            self._made = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        plain, toxic = self._made
        lengths = _lengths(plain, wide, segments)
        at = np.flatnonzero(lengths >= self.open * segments[:, 1])
        out = np.zeros(len(segments), np.int64)
        out[at] = lengths[at] - _lengths(toxic, wide, segments[at])
        return out

    def of(self, texts: list[bytes]) -> np.ndarray:
        """Differences of windows given as bytes."""
        return np.concatenate([np.zeros(0, np.int64), *(self.differences(*_packed(texts[lo : lo + BATCH])) for lo in range(0, len(texts), BATCH))])

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Share of their length to which the ordinary dictionary brings windows given as bytes."""
        self.of(texts[:1])
        wide, segments = _packed(texts)
        return _lengths(self._made[0], wide, segments) / np.maximum(segments[:, 1], 1)

    def features(self, column: pa.Array) -> np.ndarray:
        """What describes each whole text: its greatest difference, the sum of the greatest three, the number of windows, and those reaching each threshold, by number and by share; the same of the single words of telling windows. All 0 without words."""
        out = np.zeros((len(column), FEATURES))
        for lo, data, offsets in W.blocks(column):
            row, start, end = windows(data, offsets)
            if not len(row):
                continue
            rows = len(offsets) - 1
            d = self._block(data, start, end)
            n = np.bincount(row, minlength=rows)
            mine = out[lo : lo + rows]
            mine[:, 0], mine[:, 1] = _top(row, d, rows)
            mine[:, 2] = np.log1p(n)
            for k, t in enumerate(THRESHOLDS):
                count = np.bincount(row, d >= t, rows)
                mine[:, 3 + 2 * k], mine[:, 4 + 2 * k] = np.log1p(count), count / np.maximum(n, 1)
            telling = np.flatnonzero(d > WINDOW_OVER)
            if len(telling):
                w_row, w_start, w_end = windows(data, offsets, 1)
                at = np.searchsorted(start, w_start, "right") - 1  # the window that a word is in
                inside = np.isin(at, telling)
                w_row, w_start, w_end = w_row[inside], w_start[inside], w_end[inside]
                d = self._block(data, w_start, w_end)
                at = 3 + 2 * len(THRESHOLDS)
                mine[:, at], mine[:, at + 1] = _top(w_row, d, rows)
                for k, t in enumerate(THRESHOLDS):
                    mine[:, at + 2 + k] = np.log1p(np.bincount(w_row, d >= t, rows))
        return out

    def _block(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Differences of the stretches from start to end, which ascend."""
        out = [np.zeros(0, np.int64)]
        for at in range(0, len(start), BATCH):
            s, e = start[at : at + BATCH], end[at : at + BATCH]
            out.append(self.differences(widened(data[s[0] : e[-1]]), np.stack([s - s[0], e - s], axis=1) * WIDTH))
        return np.concatenate(out)


def _top(row: np.ndarray, d: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest difference of each row and the sum of its greatest three."""
    n = np.bincount(row, minlength=rows)
    order = np.lexsort((-d, row))
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return np.bincount(row, np.where(nth == 0, d[order], 0), rows), np.bincount(row, np.where(nth < 3, d[order], 0), rows)


def _packed(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    ends = np.cumsum([0, *map(len, texts)]) * WIDTH
    return widened(b"".join(texts)), np.stack([ends[:-1], np.diff(ends)], axis=1)


def _trained(texts: list[bytes], size: int) -> bytes:
    """A dictionary trained on widened texts; where they are too few to train on, their end."""
    wide = [widened(t) for t in texts]
    try:
        return zstandard.train_dictionary(size, wide).as_bytes()
    except zstandard.ZstdError:
        return b"".join(wide)[-size:]


def _shuffled(texts: list[bytes]) -> list[bytes]:
    """The same order whatever order they come in."""
    texts = sorted(texts)
    random.Random(len(texts)).shuffle(texts)
    return texts


def narrowed(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[Dictionaries, list[Dictionaries]]:
    """Dictionaries of all windows, and of each half, from the windows of the two halves of each class."""
    first = lambda texts: widened(b" ".join(texts))[:FIRST]
    halves = [Dictionaries(first(toxic[h]), first(ordinary[h])) for h in (0, 1)]
    bases = [_trained(ordinary[h], BASE) for h in (0, 1)]
    others = [_trained(ordinary[h][::3], OWN) for h in (0, 1)]
    telling: list[list[bytes]] = [[], []]
    for round_ in range(ROUNDS + 1):
        for h in (0, 1):  # each half is judged by the other half's dictionaries
            d = halves[1 - h].of(toxic[h])
            words = [b" " + w + b" " for i in np.flatnonzero(d > WINDOW_OVER) for w in toxic[h][i].lower().split()]
            telling[h] = [words[i] for i in np.flatnonzero(halves[1 - h].of(words) > WORD_OVER)]
        if round_ < ROUNDS:
            halves = [Dictionaries(_trained(telling[h], OWN) + bases[h], others[h] + bases[h]) for h in (0, 1)]
    base = _trained(ordinary[0] + ordinary[1], BASE)
    whole = Dictionaries(_trained(telling[0] + telling[1], OWN) + base, _trained((ordinary[0] + ordinary[1])[::5], OWN) + base)
    found = [halves[1 - h].shares([toxic[h][i] for i in np.flatnonzero(halves[1 - h].of(toxic[h]) > WINDOW_OVER)]) for h in (0, 1)]
    found = np.concatenate(found)
    for d in (whole, *halves):
        d.open = float(np.quantile(found, OPEN)) if len(found) else 0.0
    return whole, halves


@dataclass
class Logistic:
    """A ridge logistic fit over standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> Logistic:
        out = cls(x.mean(0), x.std(0) + 1e-9, np.zeros(x.shape[1] + 1))
        a = out._design(x)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ out.weights, -30, 30)))
            out.weights += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1]), a.T @ (y - p) - ridge * out.weights)
        return out

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.centre) / self.scale]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weights


@dataclass
class ToxicityModel:
    dictionaries: Dictionaries | None
    logistic: Logistic | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(column), self.prior)
        return calibrated(self.logistic.raw(self.dictionaries.features(column)), self.knots)


def _sampled_windows(sample: DataFrame) -> list[list[list[bytes]]]:
    """Windows by class (0 ordinary, 1 toxic) and half, about TRAIN_WINDOWS of each at most."""

    def run(share):
        def rows(batches):
            for b in batches:
                label, half = b.column(1).to_numpy(), b.column(2).to_numpy() % 2
                for lo, data, offsets in W.blocks(b.column(0)):
                    row, start, end = windows(data, offsets)
                    raw = data.tobytes()
                    kind = (label[lo + row] * 2 + half[lo + row]).astype(np.int64)
                    if share is None:
                        n = np.bincount(kind, minlength=4)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4)), pa.array(n), pa.array([b""] * 4)], ["kind", "n", "window"])
                        continue
                    chance = np.array([zlib.crc32(raw[s:e], int(i) & 0xFFFF) for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True))]) / 2**32
                    at = np.flatnonzero(chance < np.array(share)[kind])
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(kind[at]), pa.array(np.ones(len(at), np.int64)), pa.array([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)], pa.binary())], ["kind", "n", "window"])

        return rows

    schema = "kind long, n long, window binary"
    counts = {r["kind"]: r["n"] for r in sample.mapInArrow(run(None), schema).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    share = [min(1.0, TRAIN_WINDOWS / max(1, counts.get(k, 0))) for k in range(4)]
    found: list[list[bytes]] = [[], [], [], []]
    for r in sample.mapInArrow(run(share), schema).select("kind", "window").toLocalIterator():
        found[r["kind"]].append(bytes(r["window"]))
    found = [_shuffled(x) for x in found]
    return [found[:2], found[2:]]


def fit(sample: DataFrame) -> ToxicityModel:
    """Dictionaries from the windows of the sample; calibration from scoring each half with the other half's dictionaries.

    Without words of either class in either half the score is the share of label 1 (0.5 without any labels).
    """
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / sum(n.values()) if n else 0.5
    ordinary, toxic = _sampled_windows(sample)
    if not all(map(len, (*ordinary, *toxic))):
        return ToxicityModel(None, None, None, prior)
    whole, halves = narrowed(toxic, ordinary)
    def held(batches):
        for b in batches:
            half = b.column(2).to_numpy() % 2
            x = np.zeros((b.num_rows, FEATURES))
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                x[at] = halves[1 - h].features(b.column(0).take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel())), b.column(1)], ["x", "label"])

    scored = sample.mapInArrow(held, "x array<double>, label int").collect()
    x, y = np.array([r["x"] for r in scored]), np.array([r["label"] for r in scored])
    logistic = Logistic.fit(x, y)
    return ToxicityModel(whole, logistic, isotonic(logistic.raw(x), y), prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of docs and ``toxicity_score`` (0 to 1, higher: label 1 likelier), every whole text scored.

    ``usable`` says which rows of labels may be learned from, at most ``rows`` of
    them. Only the text is an input of a score; null and empty texts have no windows
    and get the score of such texts. A column named toxicity_score is replaced. An
    empty table gives an empty table; without labels of both classes all score the
    share of label 1.
    """
    model = fit(labelled_sample(docs, labels, label_col, id_col, text_col, usable, rows))
    docs = docs.drop("toxicity_score")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(b.column(at)))], [*b.schema.names, "toxicity_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))
