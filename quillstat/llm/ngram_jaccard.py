"""Parity-sketch join: documents whose word-shingle sets have a Jaccard similarity of at least a threshold.

A set's sketch holds SKETCH_BITS parities, each shingle flipping one of them, so the
Hamming distance of two sketches is at most the symmetric difference d of the sets.
A link of similarity s needs d <= (1 - s) / (1 + s) * (a + b) =: D; pairs whose sketches
differ in more than D bits are never verified.

Pairs are found by pigeonhole: each set is spread over K hash classes and each class
holds a wide parity word, the XOR of one bit for each shingle in it. Sets that
differ in d shingles agree in at least K - d parity words, hence the larger set of a
pair meets the smaller one in at least one of *any* D + 1 of its own classes: it
probes the D + 1 rarest ones, and the other side is indexed by all its non-empty classes.

K depends on the size band [2^j, 2^(j+1)); a set that lies low in its band also
probes the band below. Classes that only one set has count among the rarest, so a
set with more than D of them probes nothing, and a set that shares too few classes
to have a partner is not indexed. So passages that many documents share
make no pairs.

Pairs are formed twice: first each set is paired with the member of a few of its
classes that shares most of its own classes; then, with the components of the verified links at hand, every
probe-index pair that still crosses components and whose sketches are near enough;
the sketches are compared inside the join. So a class of n near copies makes about n
pairs, and no link between different components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm import _words as W
from quillstat.llm._tables import discard, keyed_rows, small, store, text_digest, without
from quillstat.llm.components import connected_components

#: Sets below this size get so many classes that each shingle has its own.
SMALL = 64
SMALL_CLASSES = 1 << 22
#: Bits of a sketch. Sets of many more shingles have sketches that tell little apart; they are verified instead.
SKETCH_BITS = 1024
#: Longs that a sketch is folded to (by XOR) for the pairs of the first round.
FOLDED = 8
#: A set's classes that take part in the first round: so many of the most frequent and of the rarest.
STARS = 2
#: Sets of a class beyond which it counts as one of the most frequent without further distinction.
HELD = 65_536
#: Set ids that a task remembers to pass each set on once.
REMEMBERED = 1_000_000


def classes(low: int, num: int, den: int) -> int:
    """Number of classes of the band that starts at ``low``: above any D + 1 that is probed there."""
    if low < SMALL:
        return SMALL_CLASSES
    furthest = 2 * low * den // num + 2  # the largest set that can have a partner below 2 * low
    return max(int((0.9 if low < 128 else 0.8) * low), _most(2 * low - 1, furthest, num, den) + 2)


def _most(a: int, b: int, num: int, den: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b: den * inter >= num * union."""
    return (den - num) * (a + b) // (den + num)


def _class_keys(values: np.ndarray, rows: np.ndarray, low: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of each row's classes that have a set bit.

    ``rows``, ``low`` and ``k`` go with ``values``. A parity word is 2**32 bits
    wide and nearly empty, so only the XOR of its set positions' codes is held:
    equal words have equal codes, and a position set twice cancels as in the word.
    """
    h = W.mix(values ^ (W.U64(0x51ED270B35AE87F1) + low))
    slot = (rows << 24) | ((h >> W.U64(32)) * k >> W.U64(32)).astype(np.int64)
    order = np.argsort(slot)
    slot, codes = slot[order], W.mix((h[order] & W.U64(0xFFFFFFFF)) + W.U64(1))
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    parity = np.bitwise_xor.reduceat(codes, starts)
    starts, parity = starts[parity != 0], parity[parity != 0]
    low = low[order[starts]]
    keys = W.mix(W.mix(parity + low) ^ ((slot[starts] & 0xFFFFFF).astype(W.U64) * W.U64(0x9FB21C651E98DF25)))
    return slot[starts] >> 24, keys


def signatures(first: np.ndarray, values: np.ndarray, num: int, den: int):
    """(rows, keys, below) of the sets values[first[i]:first[i+1]]: a key for each class with a set bit, of the set's own band (0) or the band below (1)."""
    n = np.diff(first)
    out = []
    bands: dict[int, int] = {}
    low_of, k_of, k_under = np.ones(len(n), np.int64), np.ones(len(n), np.int64), np.ones(len(n), np.int64)
    for i in np.flatnonzero(n):
        low = 1 << (int(n[i]).bit_length() - 1)
        low_of[i] = low
        for b in (low, low // 2):
            if b and b not in bands:
                bands[b] = classes(b, num, den)
        k_of[i], k_under[i] = bands[low], bands.get(low // 2, 1)
    every = np.repeat(np.arange(len(n)), n)
    if not len(every):
        return tuple(np.zeros(0, t) for t in (np.int64, W.U64, np.int64))
    down = (low_of > 1) & ((low_of - 1) * den >= num * n)
    for below, part in ((0, np.ones(len(every), bool)), (1, down[every])):
        if part.any():
            low, k = (low_of, k_of) if not below else (low_of // 2, k_under)
            rows, keys = _class_keys(values[part], every[part], low[every[part]].astype(W.U64), k[every[part]].astype(W.U64))
            out.append((rows, keys, np.full(len(rows), below)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def set_ids(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An even hash of each whole set; the empty set has 0."""
    n = np.diff(first)
    ids = W.mix(W.sums_by_row(W.mix(values), first) ^ n.astype(W.U64)) & ~W.U64(1)
    ids[ids == 0] = 2
    ids[n == 0] = 0
    return W.signed(ids)


def sketches(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The parity sketch of each set, a row of longs."""
    longs = SKETCH_BITS // 64
    out = np.zeros((len(first) - 1) * longs, W.U64)
    at = W.mix(values ^ W.U64(0x8EBC6AF09C88C6E3)) & W.U64(SKETCH_BITS - 1)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.bitwise_xor.at(out, rows * longs + (at >> W.U64(6)).astype(np.int64), W.U64(1) << (at & W.U64(63)))
    return W.signed(out).reshape(-1, longs)


def _sets(column: pa.Array, shingle: int):
    """(first row, first, values) of each block of rows."""
    for lo, data, offsets in W.blocks(column):
        yield lo, *W.shingle_sets(data, offsets, shingle)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def shingle_counts(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int = 75, den: int = 100) -> DataFrame:
    """One row for each row of docs: id, n_shingles, set_id, classes (of the set's own band), under (of the band below), sketch."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, first, values in _sets(b.column(1), shingle):
                rows, _, below = signatures(first, values, num, den)
                size = len(first) - 1
                own, under = (np.bincount(rows[below == k], minlength=size) for k in (0, 1))
                bits = sketches(first, values)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, size), pa.array(np.diff(first)), pa.array(set_ids(first, values)), pa.array(own), pa.array(under), _lists(bits.ravel(), np.arange(size + 1) * bits.shape[1])],
                    ["id", "n_shingles", "set_id", "classes", "under", "sketch"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, n_shingles long, set_id long, classes long, under long, sketch array<long>")


def _class_rows(docs: DataFrame, text_col: str, shingle: int, num: int, den: int) -> DataFrame:
    """(key, ref) of each class of each set; ref is the set's id, one more where the key is of the band below."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, first, values in _sets(b.column(0), shingle):
                sids = set_ids(first, values)
                new = np.zeros(len(sids), bool)
                for i, sid in enumerate(sids.tolist()):
                    if sid not in seen:
                        new[i] = True
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(sid)
                rows, keys, below = signatures(first, values, num, den)
                keep = new[rows]
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(keys[keep])), pa.array((sids[rows] | below)[keep])], ["key", "ref"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, ref long")


def _shared(batches):
    """Of rows sorted by (key, ref): each once, with the size of its class (HELD if above), for classes of two sets or more. Holds one batch and one class of at most HELD sets."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last class so far
    count, open_key, last = 0, None, None
    for b in batches:
        key, ref = b.column(0).to_numpy(), b.column(1).to_numpy()
        fresh = np.r_[last != (key[0], ref[0]), (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])] if len(key) else np.zeros(0, bool)
        if len(key):
            last = (key[-1], ref[-1])
        key, ref = key[fresh], ref[fresh]
        if not len(key):
            continue
        if open_key is not None:  # a class too large to hold is passed on as it comes
            n = int(np.searchsorted(key, open_key, "right"))
            if n:
                yield _sized(key[:n], ref[:n], np.full(n, HELD))
            key, ref = key[n:], ref[n:]
            if not len(key):
                continue
            open_key = None
        if held:
            key, ref = (np.concatenate([*(h[i] for h in held), x]) for i, x in enumerate((key, ref)))
        at = int(np.searchsorted(key, key[-1]))
        yield from _sizes(key[:at], ref[:at])
        held, count = [(key[at:], ref[at:])], len(key) - at
        if count >= HELD:
            yield _sized(key[at:], ref[at:], np.full(count, HELD))
            held, open_key = [], key[-1]
    if held:
        yield from _sizes(*held[0])


def _sizes(key: np.ndarray, ref: np.ndarray):
    if len(key):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        size = np.repeat(sizes, sizes)
        if (size > 1).any():
            yield _sized(key[size > 1], ref[size > 1], size[size > 1])


def _sized(key, ref, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ref), pa.array(np.minimum(size, HELD).astype(np.int32))], ["key", "ref", "size"])


def _near(a: str, b: str, longs: int, num: int, den: int) -> str:
    """Whether sets of sizes n{a}, n{b} may link by size and by the longs s{a}{i}, s{b}{i} of their sketches (columns of their own, which keeps the generated code short)."""
    hamming = " + ".join(f"bit_count(s{a}{i} ^ s{b}{i})" for i in range(longs))
    return f"{den} * least(n{a}, n{b}) >= {num} * greatest(n{a}, n{b}) and ({hamming}) <= {den - num} * (n{a} + n{b}) div {den + num}"


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among pairs (u, v): den * inter >= num * union on the whole sets."""
    both = pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    return both.where(F.expr(f"{den + num} * size(array_intersect(su, sv)) >= {num} * (size(su) + size(sv))")).select("u", "v")


def _stored_sets(docs: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(sid, s) for the wanted set ids, read again from one document of each."""

    def run(batches):
        for b in batches:
            for _, first, values in _sets(b.column(0), shingle):
                have = np.flatnonzero(np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(first, values)[have]), _lists(W.signed(values), np.r_[first[have], len(values)])], ["sid", "s"])

    texts = docs.join(small(wanted.select(F.col("id").alias("_wanted"))), F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi")
    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sid long, s array<long>").join(small(wanted.select("sid")), "sid", "left_semi")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100):
    """(counts, links), both stored: counts has id, n_shingles, set_id for each row; links has pairs u < v of set ids.

    Documents with the same set share a set id and are linked by it. Every link
    between different sets lies inside a component of ``links``; pairs that are
    already connected by others are not all listed.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias(text_col))
    counts = store(shingle_counts(docs, "_id", text_col, shingle, num, den), "shingle-counts")
    own = [F.first(c).alias(c) for c in ("n_shingles", "classes", "under", "sketch")]
    sets = store(counts.where("set_id <> 0").groupBy(F.col("set_id").alias("sid")).agg(F.min("id").alias("id"), *own).withColumnRenamed("n_shingles", "n"), "shingle-sets")
    shared = store(_class_rows(docs, text_col, shingle, num, den).repartition("key").sortWithinPartitions("key", "ref").mapInArrow(_shared, "key long, ref long, size int"), "shared-classes")
    gap, whole = den - num, den + num
    low = "cast(power(2, floor(log2(n))) as bigint)"
    known = shared.selectExpr("key", "size", "ref & -2 as sid", "ref & 1 as below").join(sets.drop("sketch", "id"), "sid").withColumn("classes", F.expr("if(below = 1, under, classes)"))
    mine = Window.partitionBy("sid", "below")
    known = known.withColumns({"met": F.count("*").over(mine), "rarest": F.row_number().over(mine.orderBy("size", "key"))})
    most = F.expr(f"{gap} * (n + if(below = 1, {low} - 1, n)) div {whole}")
    furthest = F.expr(f"{gap} * (n + n * {den} div {num}) div {whole}")
    known = known.withColumn("probe", F.col("rarest") <= most + 1 - (F.col("classes") - F.col("met"))).withColumn("index", (F.col("below") == 0) & (F.col("met") >= F.col("classes") - furthest))
    star = (F.col("rarest") <= STARS) | (F.col("rarest") > F.col("met") - STARS)
    live = store(known.where("probe or index").select("key", "sid", "probe", "index", star.alias("star"), (F.col("classes") - F.col("met")).alias("alone")), "live-classes")
    discard(shared)

    star = live.where("star")
    # A text from which others were copied shares nearly all its classes, so it has the fewest alone.
    hubs = live.where("index").groupBy("key").agg(F.min(F.struct("alone", "sid")).alias("hub")).select("key", F.col("hub.sid").alias("hub"))
    pairs = star.join(hubs, "key").where("hub <> sid").select(F.least("hub", "sid").alias("u"), F.greatest("hub", "sid").alias("v")).distinct()
    longs = SKETCH_BITS // 64
    folded = [" ^ ".join(f"sketch[{i}]" for i in range(k, longs, FOLDED)) for k in range(FOLDED)]
    for e in "uv":
        pairs = pairs.join(sets.selectExpr(f"sid as {e}", f"n as n{e}", *(f"{x} as s{e}{k}" for k, x in enumerate(folded))), e)
    pairs = pairs.where(F.expr(_near("u", "v", FOLDED, num, den)))
    first = _check(docs, sets, pairs, text_col, shingle, num, den)

    comp = connected_components(first)
    label = live.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = label.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("probe").alias("p"), F.max("index").alias("i")).where("lo <> hi and p and i").select("key")
    open_rows = store(label.drop("star", "alone").join(mixed, "key", "left_semi").join(sets.select("sid", "n", F.col("sketch").alias("s")), "sid"), "open-classes")
    side = lambda e: ["key", f"sid as {e}", f"component as c{e}", f"n as n{e}", *(f"s[{i}] as s{e}{i}" for i in range(longs))]
    probe, index = open_rows.where("probe").selectExpr(*side("x")), open_rows.where("index").selectExpr(*side("y"))
    rest = probe.join(index, "key").where("x <> y and cx <> cy and " + _near("x", "y", longs, num, den)).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    second = _check(docs, sets, rest, text_col, shingle, num, den)
    links = store(first.unionByName(second), "near-links")
    discard(live, open_rows, first, second, sets)
    return counts, links


def _check(docs, sets, pairs, text_col, shingle, num, den) -> DataFrame:
    """The links among pairs (u, v), stored."""
    pairs = store(pairs.select("u", "v"), "pairs")
    ids = pairs.select(F.col("u").alias("sid")).union(pairs.select("v")).distinct()
    wanted = store(sets.select("sid", "id").join(ids, "sid", "left_semi"), "wanted")
    whole = store(_stored_sets(docs, wanted, text_col, shingle).dropDuplicates(["sid"]), "sets")
    links = store(_verify(pairs, whole, num, den), "verified")
    discard(pairs, wanted, whole)
    return links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (least id reachable by links, itself included).

    Null and empty texts have no shingles and are linked with nothing: each such
    row's component is its own id. Rows with a null id take part in links; their
    component is the least non-null id of its members, null if there is none.
    Repeated rows each give a row. An empty table gives an empty table. Other
    columns of docs are ignored.
    """
    counts, links = jaccard_links(docs, id_col, text_col, shingle, num, den)
    comp = connected_components(links)
    nodes = counts.where("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("least"))
    named = nodes.join(comp, nodes.set_id == comp.node, "left").withColumn("component", F.coalesce("component", "set_id")).select("set_id", "least", "component")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("set_id", "component_id")
    out = counts.join(named, "set_id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """docs with only the least id of each linked component, all columns unchanged.

    Rows without shingles stay. Rows are told apart by id and text (its SHA-256), so
    rows that share an id go or stay by their own text; of a component's rows with
    the least id, those with the least digest stay, and rows with a null id come last.
    Rows that repeat id and text stay or go together.
    """
    digest = text_digest(F.col(text_col))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest"))
    comp = jaccard_components(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle, num, den)
    gone = comp.where("n_shingles > 0 and not (key <=> component_id)").select(F.col("key.id").alias("gone_id"), F.col("key.digest").alias("gone_digest")).distinct()
    return without(keyed_rows(docs, id_col, digest), store(gone, "near-copies")).select("row.*")
