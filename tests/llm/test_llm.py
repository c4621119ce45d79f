"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st

from strata.llm import decontam, exact, exchange, kernels as K, langid, lm, mixing, neardup, substring, suffix, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, kind string, size string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéñxyz") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(70))
    texts = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(0, 200)))
        if i % 3 == 0:
            t += " " + passage + " " + word()
        if i % 7 == 0 and texts:
            t = texts[-1]
        if i % 11 == 5 and texts:
            w = texts[-1].split(" ")
            w[len(w) // 2 : len(w) // 2 + 1] = [word()]
            t = " ".join(w)
        texts.append(t)
    texts += ["", "  \n\t ", "a", "A b", "the " * 300, "x" * 5000, "é" * 400, "Ab\t\tc  d\n", "Ab c d "]
    rows = [(i, t, "en", f"s{i % 4}", 0, i, "k", "z") for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None, None, None, None), (len(rows) + 1, texts[3] + " " + texts[4], "en", "s1", 0, 0, "k", "z")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(spark, docs, rows, none):
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        w = SPLIT.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(docs).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert substring.dedup_substrings(none).count() == 0
    twice = docs.filter("doc_id = 3").union(docs.filter("doc_id = 3"))
    assert [r.n_removed for r in substring.dedup_substrings(twice.union(twice.selectExpr("cast(null as long)", *twice.columns[1:]))).collect()] == [0] * 4


@pytest.mark.parametrize("hot", [100_000, 2])
def test_suffix(docs, rows, none, hot):
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if k in seen:
                gone[s : s + 100] = True
            seen.add(k)
        want[i] = (len(b), int(gone.sum()), K.runs(gone), bytes(np.frombuffer(b, np.uint8)[~gone]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.dedup_bytes(docs, hot=hot).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert suffix.dedup_bytes(none).count() == 0


def suffix_parts(hot: int):
    """(batches, rows of anchors, hot minimizers, rows of segments): 40 texts that share passages, each a batch of its own."""
    rng = random.Random(5)
    shared = " ".join(f"s{rng.randint(0, 10**6)}" for _ in range(200))
    batches = [pa.record_batch({"doc_id": [i], "version": pa.array([0], pa.int64()), "text": [f"{rng.random()} {shared} {rng.random()}"]}) for i in range(40)]
    anchors = pa.Table.from_batches(list(suffix.hash_anchors(100, 3)(iter(batches))))
    group = lambda t, b: t.filter(pc.equal(t.column("bucket"), b))
    found = pa.concat_tables([suffix.repeated(3, hot)(group(anchors, b)) for b in pc.unique(anchors.column("bucket")).to_pylist()])
    hottest = np.concatenate([np.frombuffer(h, "<u8") for h in found.filter(pc.equal(found.column("kind"), 2)).column("h").to_pylist()] or [np.zeros(0, "<u8")])
    texts = pa.Table.from_batches([x for b in batches for x in exchange.pack_texts(3)(iter([b]))])
    found = found.filter(pc.equal(found.column("kind"), 1))
    cuts = [suffix.cut_segments(100, 6, hottest)(group(texts, b), group(found, b)) for b in pc.unique(texts.column("bucket")).to_pylist()]
    return batches, anchors, hottest, cuts


def test_suffix_rows_follow_bytes_not_batches():
    batches, anchors, _, cuts = suffix_parts(100_000)
    assert anchors.num_rows <= 8 < len(batches)
    for t in cuts:
        t = t.filter(pc.equal(t.column("kind"), 0))
        assert t.num_rows and t.num_rows == len(pc.unique(t.column("bucket")))


def test_suffix_sends_windows_of_hot_minimizers_one_by_one():
    *_, hottest, cuts = suffix_parts(2)
    sent = np.concatenate([exchange.records(t.filter(pc.equal(t.column("kind"), 0)), suffix.RUN) for t in cuts])
    assert len(hottest) and len(sent) and (sent["n"] == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_two_stage_sort(parts):
    width = 5
    n = np.array([len(p) - width + 1 for p in parts])
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size + 1) - size - 1
    text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.uint16) + 1, 0) for p in parts]).astype(np.uint16)
    order = suffix.two_stage_sort(text, first, n, width)
    got = [bytes(text[i : i + width].astype(np.uint8)) for i in order]
    assert got == sorted(bytes(text[f + k : f + k + width].astype(np.uint8)) for f, m in zip(first, n) for k in range(m))
    prefix = suffix.adjacent_prefixes(text, order, width)
    assert [bool(p >= width) for p in prefix[1:]] == [a == b for a, b in zip(got, got[1:])]


def test_exact(spark, docs, rows, none):
    key = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    groups = collections.defaultdict(list)
    for i, k in key.items():
        groups[k].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.dedup_exact(docs).collect()}
    assert got == {i: (min(groups[k]), len(groups[k]), i == min(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, k in key.items()}
    assert exact.dedup_exact(none).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (5, "a"), (6, None)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.keep_id, r.kept) for r in exact.dedup_exact(odd).collect())) == [(0, 5, False), (0, 5, False), (5, 5, True), (6, 6, True)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(0, 40), max_size=50))
def test_quotient_filter(wide, narrow):
    prefix, skip = 5, 3
    fit = lambda x: np.array([(prefix << 61) | (v >> 3) for v in x], np.uint64)
    a, b = fit(wide + [1 << 40] * 3), fit(narrow + [1 << 40])
    f = exact.QuotientFilter.of(a, np.ones(len(a), np.int64), skip).merge(exact.QuotientFilter.load(*exact.QuotientFilter.of(b, np.ones(len(b), np.int64), skip).dump()), prefix)
    h, n = f.items(prefix)
    assert dict(zip(h.tolist(), n.tolist())) == collections.Counter([*a.tolist(), *b.tolist()])


def components(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    lo, hi = sorted((comp[a], comp[b]))
                    comp = {k: lo if v == hi else v for k, v in comp.items()}
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_neardup(spark, docs, rows, none, monkeypatch):
    want = components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedup_near(docs, 3, 85).collect()}
    assert got == want and any(v[1] != k for k, v in want.items())
    assert neardup.dedup_near(none).count() == 0
    # a family in which most are linked to the first and some only to each other, with small blocks and buckets
    monkeypatch.setattr(neardup, "CROWD", 7)
    monkeypatch.setattr(neardup, "BUCKET", 5)
    monkeypatch.setattr(neardup, "FEW", 2)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    family = []
    for i in range(45):
        w = list(base)
        for p in rng.sample(range(150), rng.choice((1, 3, 9, 12))):
            w[p] = f"e{p % 20}"
        family.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.dedup_near(spark.createDataFrame(family, "doc_id long, text string"), 3, 85).collect()}
    assert got == {k: v[1] for k, v in components(family, 3, 85).items()}
    odd = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (8, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.dedup_near(odd).collect() if r.doc_id) == [(7, 7, True), (7, 7, True), (8, 8, True)]


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_neardup_distance_follows_the_percentage(percent):
    chunks, distance = neardup.search(neardup.SLOTS, percent)
    assert neardup.miss(neardup.SLOTS, percent, distance) < 1e-4 <= neardup.miss(neardup.SLOTS, percent, distance - 1)
    parts, rng = neardup.index_parts(neardup.SLOTS, chunks, distance), random.Random(percent)
    assert min(map(len, parts)) >= 3
    for _ in range(500):  # any `distance` slots leave some key alone
        bad = set(rng.sample(range(neardup.SLOTS), distance))
        assert any(bad.isdisjoint(p) for p in parts)


def test_neardup_finds_an_isolated_pair_at_80_percent(spark):
    rng = random.Random(8)
    while True:  # exactly 80 %: of 5-word shingles one changed last word takes one
        w = [f"w{rng.randint(0, 10**9)}" for _ in range(49)]
        pair = [" ".join(w), " ".join([*w[:-5], *(f"v{rng.randint(0, 10**9)}" for _ in range(5))])]
        s, first = neardup.shingles(*K.buffers(pa.array(pair, pa.large_string())), 5)
        sig = neardup.signatures(s, first, neardup.SLOTS)
        if 23 < np.count_nonzero(sig[0] != sig[1]) <= 28:
            break
    assert len(np.intersect1d(s[: first[1]], s[first[1] :])) == 40 and len(np.unique(s)) == 50
    out = neardup.dedup_near(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {0}


def test_neardup_of_repeated_ids(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randint(0, 10**9)}" for _ in range(100)]
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, c), (2, [*a[:-2], "x", "y"]), (3, [*b[:-2], "x", "y"]), (4, [*c[:-2], "x", "y"]), (5, text()), (0, [*c[:-2], "x", "z"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert [r.component_id for r in sorted(neardup.dedup_near(df).collect())] == [0, 0, 0, 0, 0, 0, 0, 5]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.dedup_near(df, by_text=True).collect()}
    assert got == {(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 1, False), (4, 0, False), (5, 5, True)}


def test_mixing(spark, docs, rows, none):
    out = mixing.mix(docs, shares=(0.3, 1.0)).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), shares=(0.3, 1.0)).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    by = collections.defaultdict(list)
    for r in out:
        assert r.size == len(SPLIT.findall(rows[r.doc_id][1] or "")) and 0 <= r.taken <= 3 * r.size and r.takes[0] <= r.takes[1]
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by.items()}
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight, total, capped = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:  # what is above three times a source goes to the others
        left = total - sum(3 * sizes[s] for s in capped)
        goal = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, v in by.items():
        assert v[0].source_size == sizes[s] and v[0].target == pytest.approx(goal[s])
        assert abs(sum(r.taken for r in v) - goal[s]) <= max((r.size for r in v), default=0)
    assert mixing.mix(none).count() == 0


def test_urls(spark):
    rows = [("http://A.Example.com/en/7x?casino", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("https://x.com/en/1", "x.com", "/en/1", "com/en/", "block"), ("http://casino.biz", "casino.biz", "", None, "block"), ("http://casinos.biz/", "casinos.biz", "/", None, "allow"), ("http://free.biz/win", "free.biz", "/win", None, "block"), ("http://free.biz/free", "free.biz", "/free", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("http://net/de/", "net", "/de/", "net/de/", "allow")]
    pages = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert urls.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontam(spark, docs, rows, none, most):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    some = words(rows[0][1])
    items = [(1, " ".join(some[5:40])), (2, "A"), (3, None), (4, " ".join(some[60:66])), (2, "a"), (5, "Zq zq!"), (None, "x"), (None, " ".join(some[20:34]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add(i)
    want = {}
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for s in range(len(w)):
            for n in {len(k) for k in windows}:
                if s + n <= len(w) and tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        want[i] = (len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w))
    judged = decontam.decontaminate(docs, bench, most=most)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items, r.contaminated) for r in judged.collect()} == want
    assert any(v[4] for v in want.values())
    assert decontam.remove_documents(docs, judged).count() == sum(not v[4] for v in want.values())
    cleaned = {r.doc_id: r.text for r in decontam.remove_spans(docs, judged).collect()}
    assert all(len(words(cleaned[i])) == v[0] - v[1] for i, v in want.items())
    assert decontam.decontaminate(none, bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_decontam_lowers_each_letter_by_itself(spark):
    docs = spark.createDataFrame([(1, "x \u0391\u03a3'\u0391 y"), (2, "x \u0391\u03a3 \u0391 y"), (3, "x \u03b1\u03c3 \u03b1 y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "X \u0391\u03a3-\u0391 Y")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.decontaminate(docs, bench).collect()} == {1: 4, 2: 4, 3: 0}


def test_lm(spark, docs, rows, none):
    from pyspark.sql import functions as F

    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tok = {i: [*SPLIT.findall((t or "").translate(low)), 0] for i, t, *_ in rows}
    c = collections.Counter(w for i in tok if not held(i) for w in tok[i])
    n, v = sum(c.values()), len(c)
    for head in (65_536, 20):
        got = {r.doc_id: r for r in lm.score(docs, training, head=head, symbols=10).collect()}
        for i, w in tok.items():
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(i))
            assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            assert math.isfinite(got[i].score) and got[i].score < 0
    assert lm.score(none, training).count() == 0
    odd = spark.createDataFrame([(None, "a a"), (3, None), (3, "b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in lm.score(odd, training).collect()) == [1, 2, 3]


def test_lm_is_normalised_and_learns():
    rng = np.random.RandomState(0)
    line = np.resize([0, 1, 2], 3000)
    vocab = lm.Vocabulary(3000, 3, 1, np.array([1, 2, 3], np.uint64), np.array([1000] * 3), np.arange(3), 3, np.zeros(16, np.int64), np.zeros(16, np.int64))
    model = lm.Model.start(vocab, 8)
    a, b, w, _ = lm.contexts(line, np.array([0, 3000]), vocab)
    before = model.tables()
    t = lm.Trainer(model, vocab)
    for _ in range(40):
        for k in rng.permutation(6):
            t.step(a[k::6], b[k::6], w[k::6])
    aq, bq, z = model.tables()
    p = np.exp(aq[a[5]] + bq[b[5]] - z[a[5], b[5]])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    score = lambda t: float((t[0][a, w] + t[1][b, w] - t[2][a, b]).mean())
    assert score((aq, bq, z)) > score(before) + 0.5


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "ti", "is")) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(700):
        w = [word() for _ in range(rng.randint(20, 80))]
        if i % 5 == 0:
            w.insert(rng.randint(0, 10), rng.choice(("grumpf", "blorst", "krawunk", "SNIRT!")))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (None, "grumpf")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 4] + [(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if not i % 4]
    assert sum(held) / len(held) > 0.97
    assert 0 <= got[1000] == got[1001] < 0.3 <= got[None] <= 1
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_langid(spark):
    text = {"en": "the cat and the dog with this thing", "de": "der hund und die katze mit dem ding", "fr": "le chien et la chatte avec cette chose"}
    docs = spark.createDataFrame([(i, t * 3, k) for i, (k, t) in enumerate(list(text.items()) * 5)], "doc_id long, text string, lang string")
    pages = [(i, f"http://h{i % 2}.example.org/{k}/1", f'<html lang="{k}"><body><p>{t}</p><script>{text["fr"]}</script></body></html>') for i, (k, t) in enumerate(list(text.items()) * 4)]
    pages += [(100, None, None), (101, "http://h0.example.org/", text["de"]), (102, "", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in langid.identify(df, docs).collect()}
    assert all(got[i].lang == u.split("/")[3] and got[i].declared == got[i].suffix == got[i].lang for i, u, _ in pages[:12])
    assert got[101].lang == "de" and got[101].declared is None and got[100].lang is not None
    assert all(0 < r.probability <= 1 for r in got.values())
    assert langid.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identify(df, docs.limit(0)).collect()} == {None}


def test_pipeline_is_the_stages_in_turn(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in P.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.3").collect()}
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id not in bad]
    first = {}
    for r in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    comp = components(list(first.values()), 5, 80)
    kept = [r for r in first.values() if comp[r.doc_id][1] == r.doc_id]
    judged = decontam.decontaminate(spark.createDataFrame(kept, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert set(out) == {r.doc_id for r in judged.filter("not contaminated").collect()}


def test_pipeline_drops_rows_not_ids(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    rng = random.Random(6)
    text = lambda n=60: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    base, near = text(), text()
    clean = [(None, text()), (None, text()), (7, text()), (8, text()), (9, text()), (1, base), (2, near)]
    gone = {"stage_toxicity": [(None, ["grumpf"]), (7, ["grumpf", "x"])], "stage_exact": [(None, base), (8, base)], "stage_neardup": [(9, [*near[:-1], "x"])]}
    far = toxicity.Model(toxicity.window(b"grumpf"), True, b" " * 8, True, (0.0, 1.0), (0.0, 1.0))
    d = toxicity.Measure(far)
    most = max(d(w.encode()) for _, x in clean for w in x)
    assert d(b"grumpf") > max(most, 0)
    model = toxicity.Model(far.toxic, True, far.ordinary, True, (float(max(most, 0)), float(d(b"grumpf"))), (0.0, 1.0))
    monkeypatch.setattr(P.toxicity, "train", lambda *_: model)
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda rows: sorted((str(i), " ".join(w)) for i, w in rows)
    for stage, bad in gone.items():
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in clean + bad], "doc_id long, text string")
        out = getattr(P, stage)(spark, df, str(tmp_path)).collect()
        assert key((r.doc_id, r.text.split(" ")) for r in out) == key(clean), stage


def repeated_ids():
    """Rows whose doc_id is null or repeats with other texts: a passage copied into one text of id 5, unique words in the other."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    return [(1, " ".join(a)), (5, " ".join(a[10:50])), (5, " ".join(b)), (5, " ".join(b)), (None, " ".join(a)), (None, " ".join(c)), (7, " ".join(c)), (7, " ".join(c[5:40])), (8, None)]


def test_repeated_ids_lose_only_their_own_copies(spark):
    rows = repeated_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = {t: len((t or "").split()) for _, t in rows}
    key = lambda r, n: (r.doc_id or 0, n)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_substrings(df).collect())
    sevens = [got.pop((7, 60, 0), 0) and "long", got.pop((7, 35, 35), 0) and "short", got.pop((7, 60, 35), 0) and "cut", got.pop((7, 35, 0), 0) and "kept"]
    assert sorted(filter(None, sevens)) in (["long", "short"], ["cut", "kept"])  # one of the two texts of id 7 comes first
    assert got == {(1, 60, 0): 1, (5, 40, 40): 1, (5, 60, 0): 2, (None, 60, 0): 2, (8, 0, 0): 1}
    out = suffix.dedup_bytes(df).collect()
    assert len(out) == len(rows) and words
    fives = sorted((r.n_bytes, r.n_removed) for r in out if r.doc_id == 5)
    assert fives == sorted([(len(rows[1][1]), len(rows[1][1])), (len(rows[2][1]), 0), (len(rows[2][1]), 0)])
    assert all(r.n_removed == 0 for r in out if r.doc_id in (None, 1, 8))
    assert sorted(r.n_removed > 0 for r in out if r.doc_id == 7) == [False, True]


def test_texts_beyond_a_block(spark):
    rng = random.Random(3)
    shared = " ".join(f"s{rng.randint(0, 10**6)}" for _ in range(40))
    long = " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(330_000))
    rows = [(1, f"{long[:1_500_000]} {shared} {long[1_500_000:]}"), (2, f"x {shared} y")]
    assert len(rows[0][1]) > 2 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(df).collect()}
    assert got == {1: 0, 2: 40}
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.dedup_bytes(df).collect()} == {1: (0, 0), 2: (len(shared) + 2, 1)}


def test_keep_first_leaves_one_row_of_each_text(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (2, "a b", "z"), (3, "c", "p"), (3, "c", "q"), (3, "c", "q"), (None, "d", "r"), (None, "d", "r"), (4, "e", "s"), (5, None, "t"), (6, "", "u")]
    out = exact.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.columns == ["doc_id", "text", "source"]
    got = sorted(((r.doc_id or 0), re.sub(r"\s+", " ", r.text or "")) for r in out.collect())
    assert got == [(0, "d"), (1, "a b"), (3, "c"), (4, "e"), (5, "")]


def test_lm_score_of_a_fixed_model(spark, docs, rows, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.RandomState(5)
    held = {}

    def fixed(_, vocab, width, rounds):
        held["v"] = vocab
        held["m"] = lm.Model(*(rng.normal(0, 0.3, s).astype(np.float32) for s in ((vocab.size, width), (width, width), (width, width), (vocab.size - 1, width), (vocab.size - 1,))))
        return held["m"]

    monkeypatch.setattr(lm, "train", fixed)
    got = {r.doc_id: r.score for r in lm.score(docs, F.lit(True), head=20, symbols=10, width=4).collect()}
    v, m = held["v"], held["m"]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    text = {i: SPLIT.findall((t or "").translate(low)) for i, t, *_ in rows}
    c = collections.Counter(w for x in text.values() for w in x)
    name = {w: int(lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]) for w in c}
    top = sorted(c, key=lambda w: (-c[w], name[w]))[:10]
    kind = lambda w: min(len(w.encode()), 16) - 1
    mass, kinds = collections.Counter(), collections.Counter()
    for w in c:
        if w not in top:
            mass[kind(w)] += c[w]
            kinds[kind(w)] += 1
    for i, x in list(text.items())[::5]:
        sym = [top.index(w) if w in top else 10 + kind(w) for w in x] + [v.end]
        line, total = [v.size - 1, v.size - 1, *sym], 0.0
        for k, s in enumerate(sym):
            logits = (m.r[line[k + 1]] @ m.c1 + m.r[line[k]] @ m.c2) @ m.q.T + m.bias
            total += float(logits[s] - np.log(np.exp(logits.astype(float)).sum())) / math.log(10)
            if k < len(x) and x[k] not in top:
                total += math.log10((c[x[k]] - lm.DISCOUNT) / mass[kind(x[k])])
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-3)
    # known words of a class and as many unseen ones, and one more, share it
    for k in kinds:
        known = sum((c[w] - lm.DISCOUNT) / mass[k] for w in c if w not in top and kind(w) == k)
        unseen = 10 ** float(v.rare(np.array([0]), np.array([k]))[0])
        assert known + (kinds[k] + 1) * unseen == pytest.approx(1)


def test_langid_against_a_plain_bayes(spark):
    rng = random.Random(12)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "pqrst"]  # forty languages
    parts = {x: ["".join(rng.choice("abcdefghijklmnoprstuvwxyzéñ") for _ in range(3)) for _ in range(12)] for x in names}
    say = lambda x, n: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(i, say(names[i % 40], 60), names[i % 40]) for i in range(120)] + [(900, None, "ap"), (901, "zz", None)]
    pages = []
    for i in range(90):
        x = rng.choice(names[:6] if i % 3 else names)
        told = x if i % 4 else rng.choice(names)
        pages.append((i, f"http://H{i % 5}.site{i % 2}.org/{told if i % 2 else 'index'}/p", f'<html lang="{told}"><p>{say(x, rng.choice((1, 4, 30)))}</p></html>' if i % 5 else f"<p>{say(x, 3)}</p>"))
    pages += [(500, None, None), (501, "http://h0.site0.org/", "")]

    def bins(text):
        t = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()]
        h = [(a << 16) | (b << 8) | c for a, b, c in zip(t, t[1:], t[2:]) if (a, b, c) != (32, 32, 32)]
        return (K.mix(np.array(h, np.uint64)) >> np.uint64(51)).astype(int).tolist() if h else []

    order = sorted(names)
    count = {x: collections.Counter() for x in order}
    for _, t, x in docs:
        if x:
            count[x].update(bins(t))
    log = {x: [math.log((count[x][b] + 0.5) / (sum(count[x].values()) + 0.5 * langid.BINS)) for b in range(langid.BINS)] for x in order}
    seen = []
    for i, url, html in pages:
        b = bins(re.sub(r"<[^>]*>", " ", html or ""))
        text = [sum(log[x][k] for k in b) / max(1, len(b)) * max(1, len(b)) ** 0.6 for x in order]
        host = (re.search("://([^/?#]*)", url or "") or [0, ""])[1].lower()
        d = re.search('lang="([a-z]+)"', html or "")
        s = re.search("://[^/]*/([a-z]{2})/", url or "")
        where = lambda m: order.index(m[1]) if m and m[1] in order else -1
        seen.append((i, host, ".".join(host.split(".")[-2:]), where(d), where(s), text, max(range(40), key=text.__getitem__)))
    n, own, soft = 40, {}, {}
    rate = [(sum(r[k] == r[6] for r in seen) + 4) / (sum(r[k] >= 0 for r in seen) + 5) for k in (3, 4)]
    for r in seen:
        x = list(r[5])
        for k, p in zip((3, 4), rate):
            if r[k] >= 0:
                x = [v + (math.log(p) if j == r[k] else math.log((1 - p) / (n - 1))) for j, v in enumerate(x)]
        own[r[0]] = x
        e = [math.exp(v - max(x)) for v in x]
        soft[r[0]] = [v / sum(e) for v in e]
    total = lambda keep: [sum(soft[r[0]][j] for r in seen if keep(r)) for j in range(n)]
    every = total(lambda r: True)
    base = [(v + 1) / (sum(every) + n) for v in every]
    want = {}
    for r in seen:
        d, h = total(lambda o: o[2] == r[2]), total(lambda o: o[1] == r[1])
        up = [(v + 8 * q) / (sum(d) + 8) for v, q in zip(d, base)]
        prior = [(v + 8 * q) / (sum(h) + 8) for v, q in zip(h, up)]
        a = [v + math.log(q) for v, q in zip(own[r[0]], prior)]
        best = max(range(n), key=a.__getitem__)
        want[r[0]] = (order[best], 1 / sum(math.exp(v - a[best]) for v in a))
    got = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = {r.page_id: (r.lang, r.probability) for r in got.collect()}
    assert set(got) == set(want)
    for i, (x, p) in want.items():
        assert got[i][0] == x and got[i][1] == pytest.approx(p, abs=1e-4), i
