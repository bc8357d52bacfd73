"""The operators against brute force on small tables with nulls, empty and repeated rows."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstat.llm import curriculum, queries, warc
from quillstat.llm import substring_dedup as sub
from quillstat.llm.components import connected_components
from quillstat.llm.decontaminate import Items, contaminated, edit_passage, folded_words
from quillstat.llm.exact_dedup import drop_copies, exact_groups
from quillstat.llm.html_text import _key, blocks, expression, extract, infer_wrappers
from quillstat.llm.licenses import _MIT, TEMPLATES, scan_licenses, template_table
from quillstat.llm.ngram_jaccard import drop_near_copies, jaccard_components
from quillstat.llm.quality import score_quality
from quillstat.llm.toxicity import score_toxicity

SCHEMA = "doc_id long, text string, source string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 20, 60, 150, 400]))) for _ in range(60)]
    for t in texts[:25]:
        w = t.split()
        for edits in (0, 1, 3, len(w) // 25):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append("\n".join(v))
    texts += [texts[50] + " " + texts[40], texts[51] + "\t" + texts[40], None, "", " \n ", "A", "a", "A"]
    return [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)] + [(3, texts[3], "s3"), (None, "null id " * 9, "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_jaccard_components(spark, docs):
    rows = [r for r in corpus() if r[0] is not None]
    sets = {}
    for i, t, _ in rows:
        w = words((t or "").translate(AZ))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    got = jaccard_components(docs).where("doc_id is not null").collect()
    assert len(got) == len(rows)
    assert {(r[0], r[1], r[2]) for r in got} == {(i, len(sets[i]), root(i)) for i in sets}
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.collect()} == {i for i in sets if root(i) == i or not sets[i]} | {None}


def test_rows_that_share_an_id_go_by_their_own_text(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choices([f"x{i}" for i in range(800)], k=60))
    copied, clean, other = text(), text(), text()
    rows = [(1, copied), (None, copied + " end"), (None, clean), (2, copied + " tail"), (2, other), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in drop_near_copies(df).collect()}
    assert kept == {(1, copied), (None, clean), (2, other), (3, None)}
    item = " ".join(copied.split()[5:30])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {tuple(r) for r in corpus_pipeline.benchmark_leaks(spark, df, str(tmp_path)).collect()}
    assert kept == {(None, clean), (2, other), (3, None)}


def test_exact_groups(spark, docs):
    got = exact_groups(docs).collect()
    norm = {}
    for i, t, _ in corpus():
        norm.setdefault((t or "").translate(AZ), []).append(i)
    assert len(got) == len(corpus())
    size = {i: (len(ids), max((x for x in ids if x is not None), default=None)) for ids in norm.values() for i in ids}
    assert all((r["group_size"], r["keep_id"]) == size[r["doc_id"]] for r in got)
    assert sum(r["kept"] for r in got) == len(norm)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(norm)


@pytest.mark.parametrize("hot,packed,broadcast,batches", [(sub.HOT, sub.PACKED, sub.BROADCAST_FINGERPRINTS, 1), (2, sub.PACKED, sub.BROADCAST_FINGERPRINTS, 5), (1, 2, 3, 2), (sub.HOT, sub.PACKED, 3, 2)])
def test_substring_dedup(spark, docs, hot, packed, broadcast, batches, monkeypatch):
    for name, value in (("HOT", hot), ("PACKED", packed), ("BROADCAST_FINGERPRINTS", broadcast)):
        monkeypatch.setattr(sub, name, value)
    texts = [words(t) for _, t, _ in corpus()]
    seen = {}
    for n, w in enumerate(texts):
        for s in range(len(w) - 34):
            seen.setdefault(tuple(w[s : s + 35]), []).append((n, s))
    gone = {(n, p) for at in seen.values() if len(at) > 1 for n, s in at for p in range(s, s + 35)}
    want = sorted((str(i), len(w), sum((n, p) in gone for p in range(len(w))), " ".join(x for p, x in enumerate(w) if (n, p) not in gone)) for n, ((i, _, _), w) in enumerate(zip(corpus(), texts, strict=True)))
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in sub.remove_repeats(docs, batches=batches).collect())
    assert got == want


def test_index_compacts(spark):
    index = sub.FingerprintIndex(spark, fan_in=2)
    for k in range(4):
        batch = spark.createDataFrame([(7, 1), (k, 1)], "fp long, n long")
        assert {r[0] for r in index.ingest(batch).collect()} == ({7} if k else set())
        index.compact()
    assert len(index.runs) <= 2
    assert [r[0] for r in sub.FingerprintIndex(spark, index.path).recurring().collect()] == [7]


def test_hot_windows_differ_in_any_byte():
    key = np.arange(sub.HOT_KEY, dtype=np.uint8)
    keys = [key, *(np.where(np.arange(sub.HOT_KEY) == k, 99, key).astype(np.uint8) for k in (6, 7, 11)), key]
    ones = np.ones(5, np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array([1] * 5), pa.array([0] * 5), pa.array(range(5), pa.int32()), sub._binary(np.stack(keys), ones), sub._binary(np.stack([key] * 5), ones)], ["id", "tk", "start", "wins", "keys"])
    assert [x for b in sub._marked([rows]) for x in b.column("start").to_pylist()] == [0, 4]


def test_anchors_of_texts_beyond_the_packed_positions(monkeypatch):
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 900).astype(np.uint64)
    first = np.array([0, 20, 700, 900])
    want = sub.anchors(first, hashes, 35, 12)
    monkeypatch.setattr(sub, "_POS", 8)
    got = sub.anchors(first, hashes, 35, 12)
    each = lambda x: [(r, f, s + k) for r, f, s, n in zip(*(y.tolist() for y in x), strict=True) for k in range(n)]
    assert each(got) == each(want)


@pytest.mark.parametrize("hot,packed", [(sub.HOT, sub.PACKED), (1, 2)])
def test_second_batch_repeats_first(spark, hot, packed, monkeypatch):
    monkeypatch.setattr(sub, "HOT", hot)
    monkeypatch.setattr(sub, "PACKED", packed)
    rng = random.Random(8)
    fresh = lambda n: " ".join(rng.choices([f"q{i}" for i in range(500)], k=n))
    passage = fresh(60)
    old = [(1, fresh(80) + " " + passage + " " + fresh(50)), (2, fresh(200))]
    new = [(3, "a b " + passage + " c"), (4, fresh(100)), (None, passage + " d")]
    index = sub.FingerprintIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in sub.remove_repeats(frame(old), index=index).collect()] == [0, 0]
    assert len(index.runs) <= sub.FAN_IN
    again = sub.FingerprintIndex(spark, index.path)
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in sub.remove_repeats(frame(new[:1] + new[1:2]), index=again).collect()}
    assert got == {3: (60, "a b c"), 4: (0, new[1][1])}
    assert [(r["n_removed"], r["kept"]) for r in sub.remove_repeats(frame(new[2:]), index=again).collect()] == [(60, "d")]


def test_mix(spark, docs):
    got = curriculum.mix(docs).collect()
    assert len(got) == len(corpus())
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
    assert all(abs(t - target) <= 0.5 and target <= 2 * size for t, target, size in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * total) <= 2
    ordered = curriculum.in_training_order(curriculum.mix(docs)).select("position").collect()
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)


def test_mix_query_returns_training_order(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_curriculum_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(corpus())
    times = [r["position"] for r in got if r["position"] is not None]
    assert times and times == sorted(times) and all(0 <= t <= 1 for t in times)
    assert all((r["taken"] > 0) == (r["position"] is not None) and (r["taken"] > r["size"]) <= (r["repeat_position"] is not None) for r in got)


def test_warc_round_trip(spark):
    pages = [(5, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (9, None, None), (1, "x", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert tuple(got[5])[1:] == (9, digest, "revisit", 2) and tuple(got[2])[1:] == (9, digest, "response", None)
    assert got[9]["record_type"] == "revisit" and got[1]["payload_bytes"] == 0
    path = warc.new_path(spark, "w")
    warc.write_archive(df, path, min_bytes=100)
    assert {r["record_type"] for r in warc.parsed(warc.read_records(spark, path)).collect()} == {"response"}


def license_brute(text, parts, dice=90):
    """Matches of a text by plain Python sets: (kind, number, license, part, dice)."""

    def clean(t):
        t = (t or "").translate(AZ).replace("licence", "license")
        return re.sub(r"(^|\n)[^a-z0-9\n]*copyright[ \t]+(\(c\)|©|[0-9])[^\n]*", "\n", t).strip(" \t\r\n")

    def pairs(t):
        w = re.findall("[a-z0-9]+", t)
        return set(zip(w, w[1:], strict=False))

    def paragraphs(t):
        return re.split(r"\n(?:[ \t\r]*\n)+", t)

    if parts is None:
        return [(name, k, pairs(x)) for name, t in sorted({(n, clean(t)) for n, t in TEMPLATES}) for k, x in enumerate([t, *(paragraphs(t) if len(paragraphs(t)) > 1 else [])])]
    x = clean(text)
    units = [("line", i, u) for i, u in enumerate(x.split("\n"), 1)] + [("paragraph", i, u) for i, u in enumerate(paragraphs(x), 1) if "\n" in u] + [("text", 1, x)] * (len(paragraphs(x)) > 1)
    out = []
    for kind, i, u in units:
        a = pairs(u)
        found = [(kind, i, name, k, round(2 * len(a & b) / (len(a) + len(b)), 9)) for name, k, b in parts if a and b and 200 * len(a & b) >= dice * (len(a) + len(b))]
        out += [m for m in found if m[-1] == max(x[-1] for x in found)]
    whole = re.findall("[a-z0-9]+", x)
    spans = {}
    for name, t in sorted({(n, clean(t)) for n, t in TEMPLATES}):
        for k, part in enumerate([t, *(paragraphs(t) if len(paragraphs(t)) > 1 else [])]):
            w = re.findall("[a-z0-9]+", part)
            own = list(zip(w, w[1:], strict=False))
            long = lambda g: g[0] if len(g[0]) >= len(g[1]) else g[1]
            ranked = sorted(set(own), key=lambda g: (-len(long(g)), long(g), g))
            need = (dice * len(ranked) + 199 - dice) // (200 - dice)
            for g in ranked[: len(ranked) - need + 1]:
                for i, here in enumerate(zip(whole, whole[1:], strict=False)):
                    if here == g:
                        at = i - own.index(g)
                        a = set(zip(whole[max(at, 0) : at + len(w)], whole[max(at, 0) + 1 : at + len(w)], strict=False))
                        if a and 200 * len(a & set(own)) >= dice * (len(a) + len(set(own))):
                            spans.setdefault(max(at, 0) + 1, set()).add((name, k, round(2 * len(a & set(own)) / (len(a) + len(set(own))), 9)))
    return out + [("span", at, *m) for at, found in spans.items() for m in found if m[-1] == max(f[-1] for f in found)]


def test_license_scan(spark):
    mit = "MIT Licence\n\nCopyright (c) 2020 A. Person\n© x\n\n" + re.sub(r"(.{60}\S*) ", r"\1\n", _MIT)
    texts = [mit, "story\n\n" + mit + "\n\nend", mit.replace("merge", "blend").upper(), "Prose.\nReleased under the MIT License.\nMore é prose.", "Released under the mit licence", "Released under an MIT-like License.",
             "Licensed under CC BY-NC 4.0.\r\n\r\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0.", None, "", " \n\n ", "word", "long prose " * 30000 + "\n" + TEMPLATES[5][1]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, texts[4], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    parts = license_brute(None, None)
    want = sorted((str(i), *m) for i, t, _ in rows for m in license_brute(t, parts))
    found = scan_licenses(docs, template_table(spark))
    got = sorted((str(r["doc_id"]), r["unit_kind"], r["unit_no"], r["license_id"], r["template_part"], round(r["dice"], 9)) for r in found.collect())
    assert got == want
    names = {(r[0], r[3]) for r in got}
    assert {("0", "MIT"), ("1", "MIT"), ("2", "MIT"), ("3", "MIT"), ("4", "MIT"), ("6", "CC-BY-NC-4.0"), ("6", "CC-BY-4.0"), ("11", "Apache-2.0")} <= names
    assert not {r[0] for r in got if r[1] != "span"} & {"5", "7", "8", "9", "10"}
    amid = spark.createDataFrame([(1, "Some prose. Released under the MIT License. More prose."), (2, "x = 1 # " + " ".join(_MIT.split("\n\n")[0].split()[:70]) + " and then code"), (3, "the public may see that this is released under the sun")], "doc_id long, text string")
    spans = {(r["doc_id"], r["license_id"], r["unit_no"]) for r in scan_licenses(amid, template_table(spark)).where("unit_kind = 'span'").collect()}
    assert (1, "MIT", 3) in spans and (2, "MIT", 3) in spans and not {x for x in spans if x[0] == 3}
    assert scan_licenses(docs.limit(0), template_table(spark)).count() == scan_licenses(docs, template_table(spark).limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [rng.choices(vocabulary, k=n) for n in (9, 17, 30, 45)]
    filler = lambda n: rng.choices(vocabulary, k=n)
    rows = []
    for i, item in enumerate(items):
        for edits in (0, len(item) // 10):
            v = list(item)
            for _ in range(edits):
                v[rng.randrange(len(v))] = "changed"
            rows.append((10 * i + edits, " ".join(filler(37) + [w.upper() + "," for w in v] + filler(11))))
    rows += [(1000 + k, " ".join(filler(300))) for k in range(20)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(10 * i + e, i) for i, w in enumerate(items) for e in (0, len(w) // 10)}
    assert all(got[10 * i, i]["distance"] == 0 and got[10 * i, i]["start_word"] == 37 for i in range(4))
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_recall():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(900)]
    items = [rng.choices(vocabulary, k=n) for n in (1, 3, 7, 8, 9, 12, 16, 32) for _ in range(12)]
    texts = []
    for item in items:
        for _ in range(4):
            v = list(item)
            for _ in range(len(item) // 4 if len(item) >= 8 else 0):
                at = rng.randrange(len(v))
                v[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
            texts.append(rng.choices(vocabulary, k=23) + v + rng.choices(vocabulary, k=9))
    hashed = [folded_words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]))[1] for w in [*items, *texts]]
    items, texts = hashed[: len(items)], hashed[len(items) :]
    want = {(r, i): d for r, t in enumerate(texts) for i, w in enumerate(items) if (d := edit_passage(w, t)[0]) <= (len(w) // 4 if len(w) >= 8 else 0)}
    got = {(r, i): d for r, i, d, _, _ in Items(list(range(len(items))), items).search(np.r_[0, np.cumsum([len(t) for t in texts])], np.concatenate(texts))}
    assert got == want and len(want) >= len(texts)


def test_buckets_alone_reach_the_target_recall():
    """Without the exact pieces, the buckets of item-sized windows find nine in ten passages at every size and number of edits."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(2000)]
    hashed = lambda w: folded_words(np.frombuffer(" ".join(w).encode(), np.uint8), np.array([0, len(" ".join(w))]))[1]
    for size in (10, 16, 24, 32, 48, 64, 100):
        items = [rng.choices(vocabulary, k=size) for _ in range(100)]
        for share in (0, 0.1, 0.25):
            texts = []
            for item in items:
                v = list(item)
                for _ in range(int(share * size)):
                    at = rng.randrange(len(v))
                    v[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(vocabulary)], [rng.choice(vocabulary)]])
                texts.append(hashed(rng.choices(vocabulary, k=rng.randrange(20, 40)) + v + rng.choices(vocabulary, k=25)))
            held = Items(list(range(100)), [hashed(w) for w in items])
            held.pieces = {}
            near = [k for k in range(100) if edit_passage(held.words[k], texts[k])[0] <= size // 4]
            got = {(r, i) for r, i, *_ in held.search(np.r_[0, np.cumsum([len(t) for t in texts])], np.concatenate(texts))}
            assert sum((k, k) in got for k in near) >= 0.9 * len(near), (size, share)


def test_extract(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<p>three <b>bold</b></article><div class=\"comments\">no</div><footer>f</footer></body></html>"
    loose = "<body><div><p>site notice text</p></div><div><p>{}</p></div></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, "http://h/3", "<p>plain")] + [(10 + k, "http://t/x", loose.format(f"story {k}")) for k in range(6)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "A & B\none two\nthree bold" and got[2] == ("", 0) and got[3] == ("plain", 5)
    assert got[12] == ("story 2", 7)


def site(k):
    """A page of a site whose articles hold unmarked template text, a line that some lack and a list that some have longer."""
    listed = "".join(f"<li>point {k} {i}</li>" for i in range(1 + k % 3))
    extra = f"<p class='by{k}'>By writer {k}</p>" if k % 2 else ""
    return f"<body><nav><a href=/>Home</a></nav><article><h1>Story {k}</h1><p>Read also our other stories.</p>{extra}<div><p>Body of {k}.</p></div><ul>{listed}</ul><p>Share this</p></article><footer>c</footer></body>"


def test_wrappers_decide_inside_articles(spark):
    rows = [(k, "https://Site.example/" + str(k), site(k)) for k in range(12)] + [(100 + k, "https://few.example/", site(k)) for k in range(3)] + [(200 + k, "https://same.example/", site(1)) for k in range(8)] + [(300, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for k in range(12):
        by = [f"By writer {k}"] if k % 2 else []
        assert got[k].split("\n") == [f"Story {k}", *by, f"Body of {k}.", *(f"point {k} {i}" for i in range(1 + k % 3))]
    off = {r["page_id"]: r["text"] for r in extract(pages, template_pages=100).collect()}
    assert "Read also our other stories." in off[3] and "Share this" in off[3] and got[100] == off[100] and got[200] == off[200] and got[300] == ""
    spread = extract(pages.repartition(7, "html"))
    assert {r["page_id"]: r["text"] for r in spread.collect()} == got


def test_wrappers_find_the_container(spark):
    """Without an article element the host's pages together tell where the text is; one page alone does not."""
    page = lambda k: f"<body><div class=top><span>No {k}</span></div><div id=x{k} class=col><h2>Head {k}</h2><p>{'Long text of its own. ' * 9}{k}</p></div><div class=side><p>Aside {k} words</p></div></body>"
    pages = spark.createDataFrame([(k, "http://a.example/", page(k)) for k in range(6)] + [(9, "http://b.example/", page(9))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in extract(pages).collect()}
    assert got[2] == ["Head 2", "Long text of its own. " * 9 + "2"] and len(got[9]) == 4


def test_wrappers_agree_with_aligning_page_by_page(spark):
    """A wrapper grown page by page: texts of a place that all pages so far share stay, places that a page lacks turn optional."""
    pages = [site(k) for k in range(12)]
    fixed, seen, often = {}, {}, {}
    for page in pages:
        here = {}
        for path, _, _, text in blocks(page):
            here.setdefault(path, []).append(text)
        for path, texts in here.items():
            fixed[path] = set(texts) & fixed[path] if path in fixed else set(texts)
            seen[path] = seen.get(path, 0) + 1
            often[path] = max(often.get(path, 0), len(texts))
    df = spark.createDataFrame([(k, "http://s/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    rows = infer_wrappers(df).collect()
    literal = {(r["place"], r["literal"]) for r in rows if r["literal"] is not None}
    assert literal == {(path, _key(path, t)) for path, texts in fixed.items() for t in texts if seen[path] >= 5}
    assert {(r["place"], r["optional"], r["repeated"]) for r in rows} == {(path, seen[path] < 12, often[path] > 1) for path in seen}
    assert {r["place"] for r in rows if r["literal"] is None} == {path for path in seen if len(fixed[path]) < often[path] or seen[path] < 5}
    assert expression([("body/h#", "T", False, False), ("p", None, True, False), ("ul/li", None, False, True)]) == "<body><h#>T</h#></body>(<p>#text</p>)?(<ul><li>#text</li></ul>)+"


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 7)], "u long, v long")
    got = {r[0]: r[1] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_classifiers_learn_held_out_labels(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = [rng.choice("aeiou") + rng.choice("bcdfg") + rng.choice("lmnrst") + rng.choice("aeiou") for _ in range(30)]
        bad, rude = i % 5 == 0, i % 4 == 1
        if bad:
            w = [x.upper() + "!!" for x in w]
        if rude:
            w[7] = w[19] = "zzkwyx"
        rows.append((i, " ".join(w), int(not bad), int(rude)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text").union(spark.createDataFrame([(900, None), (901, "")], "doc_id long, text string")), df.select("doc_id", "quality", "toxic")
    truth = {r[0]: r for r in rows}
    for score, at, name in ((score_quality, 2, "quality_score"), (score_toxicity, 3, "toxicity_score")):
        got = {r["doc_id"]: r[name] for r in score(docs, labels, F.col("doc_id") % 3 != 0).collect()}
        held = [i for i in truth if i % 3 == 0]
        assert np.mean([(got[i] >= 0.5) == truth[i][at] for i in held]) > 0.95
        assert len(got) == 402 and all(0 <= v <= 1 for v in got.values())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard_components(none).count() == exact_groups(none).count() == sub.remove_repeats(none).count() == curriculum.mix(none).count() == 0
