"""Each operator on nulls, empty, very long and repeated texts, ties, empty tables and columns that clash with its own names; the queries' columns; the pipeline against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstat.llm import curriculum, queries, warc
from quillstat.llm import ngram_jaccard as nj
from quillstat.llm import substring_dedup as sub
from quillstat.llm import toxicity as tox
from quillstat.llm.decontaminate import contaminated, edit_passage
from quillstat.llm.exact_dedup import drop_copies, exact_groups
from quillstat.llm.html_text import extract
from quillstat.llm.licenses import scan_licenses, template_table
from quillstat.llm.ngram_jaccard import drop_near_copies, jaccard_components
from quillstat.llm.quality import FEATURES, QualityModel, _solve, score_quality, statistics
from quillstat.llm.toxicity import score_toxicity

#: Names that the operators give to columns of their own.
CLASHES = ["id", "_id", "row", "own_id", "own_digest", "gone_id", "gone_digest", "key", "size", "position", "n_shingles", "component_id", "set_id", "fp", "start", "_len", "_t", "full_hash", "h", "bin", "spans", "sid", "label", "template", "container"]


def odd_rows():
    rng = random.Random(12)
    long = " ".join(rng.choices([f"t{i}" for i in range(5000)], k=60_000))
    plain = " ".join(rng.choices([f"u{i}" for i in range(300)], k=50))
    return [(1, plain), (1, plain), (2, plain), (3, None), (None, None), (None, plain + " more"), (4, ""), (5, long), (6, long + " end"), (7, "﻿　é\u0000 x"), (7, "other text"), (8, " \n\t ")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{(i or 0) % 2}" if i != 7 else None, "en", *["c"] * len(CLASHES)) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(1, 9)] + [(None, 1, 1, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, text string")


def test_filters_keep_rows_whole(spark, odd):
    texts = {(i, t) for i, t in odd_rows()}
    for stage, gone in ((drop_copies, {(1, odd_rows()[0][1]), (3, None), (None, None)}), (drop_near_copies, {(2, odd_rows()[0][1]), (None, odd_rows()[5][1]), (6, odd_rows()[8][1])})):
        kept = stage(odd)
        assert kept.columns == odd.columns
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert set(got) == texts - gone, stage
        assert {r[c] for r in kept.select(*CLASHES).collect() for c in CLASHES} == {"c"}
        assert stage(odd.limit(0)).count() == 0


def test_groups_and_repeats(spark, odd):
    rows = odd_rows()
    assert exact_groups(odd).count() == jaccard_components(odd).count() == sub.remove_repeats(odd).count() == curriculum.mix(odd).count() == len(rows)
    kept = [r["doc_id"] for r in exact_groups(odd).where("kept").collect()]
    assert sorted(x for x in kept if x is not None) == [2, 4, 5, 6, 7, 7, 8]
    removed = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in sub.remove_repeats(odd).collect()}
    assert removed[2, 50] == 50 and removed[None, 51] == 50 and removed[5, 60_000] == 60_000 and removed[6, 60_001] == 60_000 and removed[3, 0] == 0


def test_searches_and_scores(spark, odd, labels):
    bench = spark.createDataFrame([(1, " ".join(odd_rows()[0][1].split()[5:30]), "c"), (1, None, "c"), (None, "other text", "c"), (2, "", "c")], "item_id long, text string, id string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(odd, bench).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (7, None)}
    assert contaminated(odd.limit(0), bench).count() == contaminated(odd, bench.limit(0)).count() == scan_licenses(odd, template_table(spark)).count() == 0
    for score, name in ((score_quality, "quality_score"), (score_toxicity, "toxicity_score")):
        for table in (labels, labels.limit(0)):
            out = score(odd, table, F.lit(True))
            assert out.columns == [*odd.columns, name] and out.count() == len(odd_rows())
            assert out.where(F.col(name).between(0, 1)).count() == len(odd_rows())
        assert score(odd.limit(0), labels, F.lit(True)).count() == 0
        again = score(score(odd, labels.limit(0), F.lit(True)), labels.limit(0), F.lit(True))
        assert again.columns.count(name) == 1


def test_pages(spark):
    rows = [(1, "http://h/1", "<p>a"), (1, "http://h/1", "<p>a"), (None, None, None), (2, "", ""), (3, "no host", "<div>" * 2000 + "deep" + "</div>" * 10), (4, "http://h/2", "<article>" + "<p>word &amp; word</p>\n" * 20_000), (5, "http://h/3", "<a <b> c \u0000")]
    pages = spark.createDataFrame([(*r, *["c"] * len(CLASHES)) for r in rows], "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in CLASHES))
    got = extract(pages).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got}[4].count("word & word") == 20_000 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[3] == "deep" and extract(pages.limit(0)).count() == 0
    back = warc.archive_round_trip(pages).collect()
    assert len(back) == len(rows) and {r["page_id"]: r["payload_bytes"] for r in back}[4] == len(rows[5][2]) and warc.archive_round_trip(pages.limit(0)).count() == 0


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in rng.integers(1, 600, 60)]
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    bits = nj.sketches(first, np.concatenate(sets)).view(np.uint64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            distance = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert distance <= len(np.setxor1d(a, b)) and (distance - len(np.setxor1d(a, b))) % 2 == 0


def test_shared_classes_across_batches(monkeypatch):
    monkeypatch.setattr(nj, "HELD", 5)
    rng = random.Random(2)
    rows = sorted({(k, 2 * rng.randrange(30)) for k in range(40) for _ in range(rng.choice([1, 1, 2, 12]))} | {(7, 2 * i) for i in range(20)})
    rows = sorted(rows + rng.choices(rows, k=30))
    cuts = [0, *sorted(rng.sample(range(len(rows)), 12)), len(rows)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], pa.int64()) for i in (0, 1)], ["key", "ref"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = [tuple(r.values()) for b in nj._shared(batches) for r in b.to_pylist()]
    sizes = {}
    for k, r in set(rows):
        sizes.setdefault(k, set()).add(r)
    assert sorted(got) == sorted((k, r, min(len(s), 5)) for k, s in sizes.items() if len(s) > 1 for r in s)


def test_windows_differences_against_one_by_one():
    """Lengths in blocks are those of compressing each window alone, and features are counts over them."""
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choice("abcdef") + rng.choice("lmnop") * 2 for _ in range(k))
    d = tox.Dictionaries(tox.widened(say(300).encode()), tox.widened(say(300).encode()))
    texts = [say(50), "", None, say(3), "\n\n" + say(9) + "  "]
    got = d.features(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        raw = (text or "").encode()
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        windows = [raw[max(spans[i][0] - 1, 0) : min(spans[min(i + tox.WORDS, len(spans)) - 1][1] + 1, len(raw))] for i in range(0, len(spans), tox.WORDS)]
        each = [int(d.of([w])[0]) for w in windows]
        assert row[0] == max(each, default=0) and row[1] == sum(sorted(each)[-3:]) and row[2] == np.log1p(len(each)) and len(words) == len(spans)
        assert [row[3 + 2 * k] for k in range(len(tox.THRESHOLDS))] == [np.log1p(sum(x >= t for x in each)) for t in tox.THRESHOLDS]


def test_summed_normal_equations(spark):
    """Ridge weights from sums by partition are those of the whole design at once."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "GAMMA!!", "x", "1234"], k=rng.randrange(1, 40)))) for i in range(300)]
    y = np.array([int("GAMMA" not in t) for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for (i, _), v in zip(rows, y, strict=True)], "doc_id long, quality int")
    got = np.array([r["quality_score"] for r in score_quality(docs, labels, F.lit(True)).orderBy("doc_id").collect()])
    x = statistics(pa.array([t for _, t in rows]))
    model = QualityModel(x.mean(0), x.std(0) + 1e-9, None, (np.zeros(1), np.zeros(1)), 0.5)
    z = model.features(x)
    raw = z @ _solve(z.T @ z, z.T @ y, len(y))
    order = np.argsort(raw)
    assert z.shape[1] == FEATURES + 1 and (np.diff(got[order]) >= -1e-12).all() and ((got >= 0.5) == y).mean() > 0.97


TYPES = {
    "op1_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op2_substring_dedup": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
    "op3_warc": [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")],
    "op5_exact_dedup": [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")],
    "op6_curriculum_mix": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op8_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op9_html_text": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op10_ngram_jaccard": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [say(n) for n in (12, 20, 40)]
    texts = [say(rng.choice([30, 60, 120])) + "." for _ in range(40)]
    texts += [texts[0].upper(), texts[1], texts[2] + " tail", texts[3] + " " + items[0], items[1] + " " + texts[4], "!! ## $$ || " * 20, "@@ %% ^^ {} " * 30, None, "", texts[5][:-2]]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in (45, 46)), int(i % 5 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h{i % 2}/", f"<article><p>{t}</p></article>") for i, t in enumerate(texts[:12])], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows, items


@pytest.mark.parametrize("name", sorted(TYPES))
def test_query_columns(spark, folder, name):
    df = queries.QUERIES[name](spark, folder[0])
    assert set(TYPES[name]) <= set(df.dtypes)
    table = "pages" if name in ("op3_warc", "op9_html_text") else "documents"
    assert df.count() == spark.read.parquet(f"{folder[0]}/{table}.parquet").count()


def test_pipeline_against_brute_force(spark, folder):
    path, rows, items = folder
    documents = spark.read.parquet(f"{path}/documents.parquet")
    quality = corpus_pipeline.quality(spark, documents, path)
    assert quality.columns == documents.columns
    left = {r["doc_id"]: r["text"] for r in quality.collect()}
    assert set(left) >= set(range(45))
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    newest = {}
    for i, t in sorted(left.items()):
        newest[(t or "").translate(az)] = i
    left = {i: left[i] for i in newest.values()}
    shingles = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(az))
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if i < j and shingles[i] and 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    left = {i: t for i, t in left.items() if up[i] == i}
    word = lambda t: np.array([hash(x) for x in re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").translate(az)).split()], np.int64)
    leaked = {i for i, t in left.items() if any(edit_passage(word(x), word(t))[0] <= len(x.split()) // 4 for x in items)}
    assert leaked and {i for i in left if left[i] is not None and items[0] in left[i]} <= leaked
    out = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in out} <= set(left) - leaked
    whole = corpus_pipeline.benchmark_leaks(spark, corpus_pipeline.near_copies(spark, corpus_pipeline.exact_copies(spark, quality, path), path), path)
    assert whole.columns == documents.columns and {r["doc_id"] for r in whole.collect()} == set(left) - leaked
    times = [r["position"] for r in out]
    assert times == sorted(times) and [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
