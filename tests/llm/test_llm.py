"""The ten operators against brute force, exact round trips and held-out accuracy, and their edge
cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, cover_tree, exact_dedup, html_text, minhash, mixing, packing, quality, suffix_dedup, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "a", "n", "size", "kept", "keep_id", "_id", "_t", "_text", "score", "tie", "rank", "word", "spans", "bands")


def documents(spark, texts, ids=None, sources=None, clash=False):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH]) if clash else df


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with everything: nulls, empty, blank, short, long, copies, near copies, shared passages."""
    rng = random.Random(5)
    passage, base = words(rng, 90), words(rng, 200)
    texts = [None, "", " \t\n", "one", "one two", "One TWO", "aaaa" * 300, "ab " * 500, "é" * 450, "x" * 399, "x" * 400]
    texts += [words(rng, rng.randint(3, 80)) for _ in range(25)]
    texts += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(6)]
    texts += [base] * 4
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [words(rng, 20_000, 5000), base.upper(), base + " " + passage, "日本語の文章。" * 80]
    return texts


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --------------------------------------------------------------------- 1 suffix
def removed(texts, length):
    """For each text its bytes that a repeated window covers, by counting all windows."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p: p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p: p + length]] > 1:
                gone[p: p + length] = True
        out.append((b, gone))
    return out


@pytest.mark.parametrize("length", [400, 100])
def test_suffix_dedup_against_all_windows(spark, corpus, length):
    texts = [t for t in corpus if t is None or len(t) < 30_000]
    got = {r.doc_id: r for r in suffix_dedup.dedup(documents(spark, texts, clash=True), length=length).collect()}
    assert len(got) == len(texts)
    for i, (b, gone) in enumerate(removed(texts, length)):
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), gone.sum(), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_random_copies(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("ab") for _ in range(700)) for _ in range(3)]
    texts = []
    for _ in range(40):
        p, a = rng.choice(pool), rng.randrange(300)
        texts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) + p[a: a + rng.randrange(90, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(200))))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(documents(spark, texts), length=100).collect()}
    assert got == {i: int(g.sum()) for i, (_, g) in enumerate(removed(texts, 100))}
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.kept_texts(documents(spark, texts), length=100).collect()}
    assert kept == {i: bytes(np.frombuffer(b, np.uint8)[~g]) for i, (b, g) in enumerate(removed(texts, 100))}


def test_suffix_dedup_repeated_rows_and_empty(spark):
    t = words(random.Random(2), 100)
    assert [r.n_removed for r in suffix_dedup.dedup(documents(spark, [t, t], ids=[5, 5])).collect()] == [len(t)] * 2
    assert suffix_dedup.dedup(documents(spark, ["x"]).limit(0)).count() == 0


def sharing(texts, words):
    """Whether each text shares a run of ``words`` words with another one."""
    grams = [{tuple(w[i: i + words]) for i in range(len(w) - words + 1)} for w in (WORD.findall(t or "") for t in texts)]
    held = Counter(g for own in grams for g in own)
    return [any(held[g] > 1 for g in own) for own in grams]


@pytest.mark.parametrize("n", [51, 20])
def test_suffix_dedup_shared_passages(spark, corpus, n):
    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [t for t in corpus if t is None or len(t) < 30_000]
    texts += [words(rng, 30) + " " + " ".join(passage.split()[k: k + 50 + k % 3]) + "\n" + words(rng, 20) for k in range(8)]
    texts += [words(rng, 52) + " " + "x y " * 200]          # repeats itself only
    got = {r.doc_id: r.shares_passage for r in suffix_dedup.dedup(documents(spark, texts, clash=True), words=n).collect()}
    assert got == dict(enumerate(sharing(texts, n)))


def test_suffix_dedup_null_and_reused_identifiers(spark):
    rng = random.Random(3)
    passage = words(rng, 120)
    texts = [words(rng, 300) + passage, passage, words(rng, 10) + passage + words(rng, 5), words(rng, 90), passage]
    df = documents(spark, texts, ids=[1, 1, 2, None, None])
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df).collect())
    assert got == sorted((len(b), int(g.sum())) for b, g in removed(texts, 400))


def test_suffix_dedup_text_of_many_slices(spark):
    rng = random.Random(4)
    size = suffix_dedup.SLICE
    raw = bytes(rng.choices(b"abcdefgh ", k=3 * size + 1000))
    passage = raw[size - 300: size + 500]                   # across the border of two slices
    texts = [raw.decode(), "start " + passage.decode() + " end", raw[2 * size: 2 * size + 450].decode()]
    got = {r.doc_id: r for r in suffix_dedup.dedup(documents(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(3)] == [800 + 450, 800, 450] and got[0].n_spans == 2
    assert [got[i].shares_passage for i in range(3)] == sharing(texts, 51)


# --------------------------------------------------------------------- 2 mixing
def test_targets():
    assert mixing.targets([100, 100, 100]) == [pytest.approx(300 * w / 8) for w in (5, 2, 1)]
    got = mixing.targets([10, 1000, 1000])          # the first stops at 30, the rest share by 2 : 1
    assert got == [30.0, pytest.approx(1980 * 2 / 3), pytest.approx(1980 / 3)]
    assert mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([]) == []
    assert sum(mixing.targets([3, 50, 7, 900, 2])) == pytest.approx(962)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_one(n):
    p = mixing.permute(np.arange(n), n, 3)
    assert sorted(p.tolist()) == list(range(n)) and (mixing.permute(p, n, 3, back=True) == np.arange(n)).all()


def test_mixing_meets_targets(spark, corpus):
    sources = [None if i % 11 == 0 else "z" if i % 3 else "ä" for i in range(len(corpus))]
    df = documents(spark, corpus, sources=sources, clash=True)
    got = {r.doc_id: r for r in mixing.taken(df).collect()}
    size = [len(WORD.findall(t or "")) for t in corpus]
    assert [got[i].size for i in range(len(corpus))] == size
    order = sorted(set(sources), key=lambda s: (s is None, (s or "").encode()))
    total = [sum(n for n, s in zip(size, sources) if s == x) for x in order]
    for x, want, own in zip(order, mixing.targets(total), total):
        rows = [got[i] for i in range(len(corpus)) if sources[i] == x]
        assert all(r.source_size == own and r.target == pytest.approx(want) for r in rows)
        assert abs(sum(r.taken for r in rows) - want) <= 1
    assert all(r.taken <= 3 * r.size for r in got.values())
    again = {r.doc_id: r.taken for r in mixing.taken(df.repartition(5)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mixed_texts_hold_what_is_taken(spark, corpus):
    df = documents(spark, corpus, ids=[i // 2 if i < 4 else i for i in range(len(corpus))])
    taken, held = Counter(), Counter()
    for r in mixing.taken(df).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_texts(df)
    assert out.columns == df.columns
    originals = defaultdict(set)
    for r in df.collect():
        originals[r.doc_id].add(r.text)
    for r in out.collect():
        held[r.doc_id] += len(WORD.findall(r.text))
        assert any(r.text in (t or "") for t in originals[r.doc_id]) and r.n_chars == len(r.text)
    assert +taken == +held


def test_mixing_taken_from_slots_naively(spark, corpus):
    """What the mix takes of each document, counted word by word from the slots."""
    sources = [None if i % 11 == 0 else "z" if i % 3 else "ä" for i in range(len(corpus))]
    df = documents(spark, corpus, sources=sources)
    placed, slots, _ = mixing.mix(df, block=7)
    slots, placed = slots.collect(), placed.collect()
    times = defaultdict(Counter)
    for s in slots:
        times[s.rank].update(range(s.block * 7, s.block * 7 + s.words))
    by_rank = {p.rank: p for p in placed}
    for rank, own in times.items():
        assert sum(own.values()) == round(by_rank[rank].target) and max(own) < by_rank[rank].source_size
        whole = Counter((s.shard, s.slot) for s in slots if s.rank == rank)
        assert max(whole.values()) == 1
        passes = defaultdict(list)
        for s in slots:
            if s.rank == rank:
                passes[s["pass"]].append(s.block)
        assert all(len(b) == len(set(b)) for b in passes.values())
    mixing_block = mixing.BLOCK
    got = {r.doc_id: r.taken for r in mixing.taken(df).collect()}
    placed, slots, _ = mixing.mix(df)
    times = defaultdict(Counter)
    for s in slots.collect():
        times[s.rank].update(range(s.block * mixing_block, s.block * mixing_block + s.words))
    assert got == {p.id: sum(times[p.rank][w] for w in range(p.start, p.start + p.size)) for p in placed.collect()}


def test_mixing_empty(spark):
    assert mixing.taken(documents(spark, ["x"]).limit(0)).count() == 0
    assert [r.taken for r in mixing.taken(documents(spark, [None, ""])).collect()] == [0, 0]


# ---------------------------------------------------------------------- 3 exact
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, corpus, keep):
    texts = corpus + corpus[:20]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(spark, texts, clash=True), keep=keep, salts=5).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        best = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_by_any_salts(spark):
    df = documents(spark, ["same"] * 40 + ["other", "other", None, ""])
    want = sorted(map(tuple, exact_dedup.exact_dedup(df, keep="largest", salts=1).collect()))
    for salts in (3, 64, 1000):
        assert sorted(map(tuple, exact_dedup.exact_dedup(df, keep="largest", salts=salts).collect())) == want


def test_exact_dedup_cases(spark):
    df = documents(spark, ["a", "a", "a", "b", "b"], ids=[1, 1, None, None, None])
    rows = exact_dedup.exact_dedup(df, keep="largest").collect()
    assert sum(r.kept for r in rows if r.group_size == 3) == 1 and all(r.keep_id == 1 for r in rows if r.group_size == 3)
    assert sum(r.kept for r in rows if r.group_size == 2) == 1 and all(r.keep_id is None for r in rows if r.group_size == 2)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    folded = exact_dedup.exact_dedup(documents(spark, ["A b", "a  B"]), normalise=lambda c: F.lower(F.regexp_replace(c, r"\s+", " ")))
    assert {r.group_size for r in folded.collect()} == {2}


# -------------------------------------------------------------------- 4 packing
def test_packing_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(documents(spark, corpus, clash=True), public_tokenizers.path("word_bpe_49k.json")).collect()
    whole = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(corpus)}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start: r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(whole[r.doc_id])
    for i, ids in whole.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(own) <= packing.SEGMENTS
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(map(len, whole.values()))


def test_packer_keeps_all_limits():
    rng = random.Random(4)
    box = packing.Packer(tokens=100, segments=5, loss=60, pool=16)
    sizes = {}
    for k in range(300):
        n = rng.randint(1, 250)
        sizes[k] = n
        box.add(k, np.arange(n, dtype=np.int32), rng.randint(0, n))
    box.finish()
    seen = Counter()
    for own in box.take():
        assert sum(len(p[2]) for p in own) <= 100 and len(own) <= 5
        assert sum(packing.Packer._loss(p[1], len(p[2]), p[3]) for p in own) <= 60
        for key, start, ids, _ in own:
            assert ids.tolist() == list(range(start, start + len(ids)))
            seen[key] += len(ids)
    assert seen == sizes


# -------------------------------------------------- 5 quality, 9 toxicity
@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    texts, good, toxic = [], [], []
    for i in range(700):
        t = words(rng, rng.randint(20, 120))
        q, x = 1, 0
        if i % 7 == 0:
            t, q = " ".join(w + rng.choice(("!!", "%%%")) for w in t.upper().split()), 0
        elif i % 7 == 1:
            t, q = " ".join([rng.choice(t.split())] * 60), 0
        elif i % 5 == 0:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(("idiot", "Scum", "vermelo", "vermeixa", "vermeita")))
            t, x = " ".join(w), 1
        texts.append(t), good.append(q), toxic.append(x)
    texts += [None, "", "   "]
    labels = spark.createDataFrame([(i, q, x) for i, (q, x) in enumerate(zip(good, toxic))], "doc_id long, quality int, toxic int")
    return documents(spark, texts, clash=True), labels, good, toxic


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels, good, _ = labelled
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(good) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i in range(len(good)) if crc(i, 3) == 1]
    assert all(got[i].held_out == (crc(i, 3) == 1) for i in got)
    assert np.mean([got[i].predicted == good[i] for i in held]) > 0.95
    # held-out labels are never learnt from
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality(docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    kept = {r.doc_id for r in quality.good_documents(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels, _, toxic = labelled
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(len(toxic)) if crc(i, 5) == 0]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    found = toxicity.toxic_passages(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert found and all(re.search("(?i)idiot|scum|verme", r.text.encode()[r.start: r.end].decode()) for r in found)


def naive_features(text):
    """The features that a few lines of Python can count."""
    raw, ws = text.encode(), WORD.findall(text)
    n, per = max(1, len(ws)), max(1, len(raw))
    size = lambda w: len(w.encode())
    lines = text.split("\n")
    pairs = list(zip(ws, ws[1:]))
    return {
        "log_words": np.log1p(len(ws)), "word_length": sum(map(size, ws)) / n, "upper": sum(65 <= b <= 90 for b in raw) / per,
        "digit": sum(48 <= b <= 57 for b in raw) / per, "bang": raw.count(b"!") / per, "bars": raw.count(b"|") / per,
        "accents": sum(b >= 0xC3 for b in raw) / per, "distinct_words": len(set(ws)) / n, "same_as_last": sum(a == b for a, b in pairs) / n,
        "short_words": sum(size(w) <= 3 for w in ws) / n, "long_words": sum(size(w) >= 12 for w in ws) / n,
        "top_word": max(Counter(ws).values(), default=0) / n, "distinct_pairs": len(set(pairs)) / max(1, len(pairs)),
        "line_words": np.log1p(len(ws) / len(lines)) if ws else 0.0}


def test_quality_features_and_tables_naively(corpus):
    texts = [t or "" for t in corpus if t is None or len(t) < 30_000] + ["A!! b|c 12\nx x x\n\nÉcole ééé", "\n\n a"]
    data, off = common.flat_bytes(__import__("pyarrow").array(texts))
    got = quality.features(data, off)
    for i, t in enumerate(texts):
        for name, value in naive_features(t).items():
            assert got[i, quality.FEATURES.index(name)] == pytest.approx(value), (i, name)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)       # only the pair tells
    model = quality.fit(x[:3500], y[:3500])
    for row, score in zip(x[3500:], model.score(x[3500:])):
        total = model.base
        at = [sum(e <= v for e in edges) for v, edges in zip(row, model.edges)]
        total += sum(t[b] for t, b in zip(model.tables, at))
        total += sum(t[at[i] * quality.PAIR_BINS // quality.BINS, at[j] * quality.PAIR_BINS // quality.BINS] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x[3500:]) >= 0.5) == y[3500:]).mean() > 0.8


def test_quality_trees_split_best():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=(6, 5)), rng.uniform(0.5, 2, size=(6, 5))
    gain = lambda a, b: a.sum() ** 2 / (b.sum() + 5.0)
    cuts = [(gain(g[:k], h[:k]) + gain(g[k:], h[k:]), 0, k) for k in range(1, 6)] + [(gain(g[:, :k], h[:, :k]) + gain(g[:, k:], h[:, k:]), 1, k) for k in range(1, 5)]
    _, axis, k = max(cuts)
    want = np.zeros((6, 5))
    for part in ((slice(0, k), slice(k, None)) if axis == 0 else ((slice(None), slice(0, k)), (slice(None), slice(k, None)))):
        want[part] = g[part].sum() / (h[part].sum() + 5.0)
    assert np.allclose(quality._steps2(g, h, 1), want)


def test_classifiers_with_repeated_rows(spark, labelled):
    """An id that is repeated, also with another text, is one training row."""
    docs, labels, _, _ = labelled
    docs = docs.select("doc_id", "text")
    again = docs.where("doc_id = 3").crossJoin(spark.range(50)).drop("id")
    rows = quality.labelled(docs.union(again).union(again.withColumn("text", F.lit("other"))), labels, "quality", "doc_id", "text", F.lit(True), 1000)
    assert rows.count() == labels.count()


def test_toxicity_scores_naively(spark, labelled):
    """Scores from the model's table by a loop over words and the segments' definition."""
    docs, labels, _, _ = labelled
    model = toxicity.fit_toxicity(docs, labels)
    texts = [r.text for r in docs.where("doc_id < 60 and text is not null").collect()]
    data, off = common.flat_bytes(__import__("pyarrow").array(texts))
    got = model.measure(data, off)
    hashes, _, _, first = toxicity.tokens(data, off)
    table = dict(zip(model.hashes.tolist(), model.value.tolist()))
    for i in range(len(texts)):
        values = []
        for w in range(first[i], first[i + 1]):
            own = table.get(int(hashes[0][w]))
            stems = [table[int(h[w])] for h in hashes[1:] if int(h[w]) in table]
            best = max([v for v in (own, *stems) if v is not None], default=None)
            values.append(toxicity.DRIFT if best is None else best + toxicity.DRIFT)
        scores = sorted((s for s, _, _ in toxicity.maximal_segments(np.array(values), np.arange(len(values)))), reverse=True)
        if not scores:
            assert (got[i] == 0).all()
            continue
        chance = np.log(len(values) + 1) / model.rate
        assert got[i] == pytest.approx([scores[0] * model.rate, np.log1p(sum(max(0, s - chance) for s in scores)), scores[0] - chance])


def test_classifiers_without_labels_or_rows(spark, labelled):
    docs, labels, _, _ = labelled
    for f in (quality.quality, toxicity.toxicity):
        assert {r.score for r in f(docs.limit(5), labels.limit(0)).collect()} == {0.5}
        assert f(docs.limit(0), labels).count() == 0


def brute_segments(values):
    """Maximal scoring segments by their recursive definition."""
    def best(lo, hi):
        found = [(sum(values[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        return max(found, key=lambda x: (x[0], -(x[2] - x[1]), -x[1]), default=(0, 0, 0))

    def walk(lo, hi):
        s, a, b = best(lo, hi)
        return [] if s <= 1e-12 else walk(lo, a) + [(round(s, 9), a, b - 1)] + walk(b, hi)

    return walk(0, len(values))


def test_maximal_segments():
    rng = random.Random(6)
    for _ in range(200):
        values = [rng.choice([toxicity.DRIFT, toxicity.DRIFT, rng.uniform(-3, 3)]) for _ in range(rng.randint(1, 14))]
        at = np.flatnonzero(np.array(values) != toxicity.DRIFT)
        got = [(round(s, 9), a, b) for s, a, b in toxicity.maximal_segments(np.array(values)[at], at)]
        assert got == brute_segments(values)


# --------------------------------------------------------------------- 6 tokens
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, corpus, name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    texts = corpus + ["<|endoftext|> a<|endoftext|>b.", "<|STARTOFTEXT|>", "x  y \n z", "it's, don't'. O'Re", " lead", "trail \n", "a　b  c", "é , Ω.Σ ΑΣ.", "a,b.c!!d ..e", "\r\n\r\nx", "1 000,50%"]
    got = {r.doc_id: r for r in tokens.count_tokens(documents(spark, texts, clash=True), public_tokenizers.path(name)).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), t
    assert tokens.count_tokens(documents(spark, ["x"]).limit(0), public_tokenizers.path(name)).count() == 0


# -------------------------------------------------------------------- 7 minhash
def shingles(t, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_minhash_against_all_pairs(spark, corpus, n, percent):
    sets = [shingles(t, n) for t in corpus]
    edges = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(len(sets), edges)
    got = {r.doc_id: r for r in minhash.near_dedup(documents(spark, corpus, clash=True), n=n, percent=percent).collect()}
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(sets))] == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_minhash_large_group_of_near_copies(spark):
    """A base with copies whose mutual similarity straddles the threshold: links to it, and chains."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"r{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    sets = [shingles(t, 3) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(documents(spark, texts), n=3, percent=85).collect()}
    assert [got[i] for i in range(len(texts))] == components(len(texts), edges)


def test_minhash_reused_identifiers(spark, corpus):
    """Rows that share an identifier but not a text keep links of their own, however rows are dealt."""
    rng = random.Random(3)
    texts = [*corpus, "a b c d e f g h i j k l m n", "o p q r s t u v w x y z", "a b c d e f g h i j k l m n", "o p q r s t u v w x y z aa"]
    ids = [rng.randrange(25) for _ in corpus] + [101, 101, 102, 103]
    sets = [shingles(t, 3) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = components(len(sets), edges)
    least = {r: min(ids[i] for i in range(len(ids)) if root[i] == r) for r in set(root)}
    want = Counter((ids[i], len(sets[i]), least[root[i]], ids[i] == least[root[i]]) for i in range(len(ids)))
    assert least[root[-1]] == 101 and least[root[-2]] == 101
    df = documents(spark, texts, ids=ids)
    for parts in (1, 4, 9):
        got = minhash.near_dedup(df.repartition(parts), n=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
        assert Counter(tuple(r) for r in got.collect()) == want


def test_minhash_estimate():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8, 0.95):
        common_, rest = rng.integers(0, 1 << 62, int(2000 * share)), rng.integers(0, 1 << 62, (2, int(1000 * (1 - share))))
        a, b = (np.sort(np.concatenate([common_, r])).astype(np.uint64) for r in rest)
        j = len(common_) / (len(common_) + rest.size)
        est = minhash.estimate(*[np.frombuffer(minhash.pack_bits(minhash.minima(x)), np.uint8)[None] for x in (a, b)])[0]
        assert abs(est - j) < 0.2


def test_minhash_cases(spark):
    df = documents(spark, ["a b c d e f g"] * 3 + [None], ids=[4, 4, None, 9])
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_dedup(df).collect())
    assert got == [(-1, None, True), (4, 4, True), (4, 4, True), (9, 9, True)]
    assert minhash.near_dedup(df.limit(0)).count() == 0


# ----------------------------------------------------------------------- 8 html
@pytest.mark.parametrize("page, expected", [
    (None, ""), ("", ""), ("plain   words", "plain words"), ("<p>a&amp;b &eacute;&#233;\n c<br>d", "a&b éé c d"),
    ("<body><nav>Menu</nav><article><h1>T</h1><p>Some <b>bold</b>, text.</article><footer>F</footer>", "T Some bold, text."),
    ("<article><p>a<script>var x='</p><p>no';</script>b</p><style>p{}</style></article>", "ab"),
    ("<div class='cookie-notice'>Accept all cookies, please.</div><main><p>Words, here.</p><div class=comments><p>Nice, one.</p></div></main>", "Words, here."),
    ("<header><h1>Site</h1></header><article><p>One.</p><aside>x</aside><form>y</form><p>Two.</p></article>", "One. Two."),
    ("<div id=top><a href=/>Home</a> <a href=/b>News</a></div><div class=body><h2>Head</h2><p>First, a long sentence of words.</p><p>Second; another one, also long.</p></div>"
     "<ul><li><a href=1>x</a></li><li><a href=2>y</a></li></ul>", "Head First, a long sentence of words. Second; another one, also long."),
    ("<article><p>unclosed <a href='x>y</p>", "unclosed y"),
])
def test_html(page, expected):
    if page and "unclosed" in page:
        assert html_text.main_text(page).startswith("unclosed")
    else:
        assert html_text.main_text(page or "") == expected


P = "<p>A sentence of the article, with some words in it; and another one.</p>"


@pytest.mark.parametrize("page", [
    f"<article>{P}<ul><li><a href=1>Ten gardens to see</a></li><li><a href=2>Read more</a></li></ul>{P}</article>",
    f"<article>{P}{P}</article><article class=comment><p>Nice words, thank you, all of you.</p></article>",
    f"<main>{P}<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>{P}</main>",
])
def test_html_ratios_decide_in_articles(page):
    text = P[3:-4]
    assert html_text.main_text(page) == f"{text} {text}"
    short = f"<article><h2>Oil</h2>{P}<table><tr><td>3</td></tr></table><ul><li>Milk</li></ul></article>"
    assert html_text.main_text(short) == f"Oil {text} 3 Milk"


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'><article>{P}{P}</article></div>",
    f"<div id=page class=no-sidebar><div>{P}{P}</div></div>",
    f"<div class=widget><article>{P}{P}</article></div><div class=widget>Weather, today.</div>",
    f"<div class=overlay><div>{P}{P}</div></div><div class=cookie-notice>Accept, please.</div>",
    f"<body><form action=/go><article>{P}{P}</article></form></body>",
    f"<form><div>{P}{P}</div></form>",
    f"<article>{P}<div class=widget-text>{P}</div></article>",
    f"<article>{P}<section id=related-work>{P}</section></article>",
    f"<article>{P}{P}</article><div class=comments><article>Nice.</article></div>",
    f"<article>{P}{P}<div class='comment-list'>{P}</div></article>",
    f"<article>{P}{P}</article><article class=comment>{P}{P}{P}</article>",
])
def test_html_class_words_are_no_verdict(page):
    assert html_text.main_text(page) == f"{P[3:-4]} {P[3:-4]}"


S = "A sentence of the article, with some words in it; and another one."
REFERENCE = "Smith, J. (2001). On the tides of rivers. Journal of Water, 3, 14."


@pytest.mark.parametrize("page, expected", [
    (f"<body><section>{P * 8}</section><section>{P}</section><div><a href=1>Home</a></div></body>", [S] * 9),
    (f"<div id=content>{f'<div>{P}</div>' * 7}</div><div>Rights kept</div>", [S] * 7),
    (f"<div id=content>{P * 8}<blockquote>So it is.</blockquote>{P}<div><p>The end.</p></div></div>", [S] * 8 + ["So it is.", S, "The end."]),
    (f"<body>{P * 6}<ul><li>Milk</li></ul><div>{P}</div></body>", [S] * 6 + ["Milk", S]),
    (f"<div>{P * 8}<ul><li><a href=1>{REFERENCE}</a></li></ul></div><ul><li><a href=2>Older news of the town and the river</a></li></ul>", [S] * 8 + [REFERENCE]),
    (f"<article>{P * 8}<ol><li><a href=1>{REFERENCE}</a></li></ol></article>", [S] * 8 + [REFERENCE]),
])
def test_html_several_containers(page, expected):
    assert html_text.main_text(page) == " ".join(expected)


@pytest.mark.parametrize("tag", ["svg", "object", "math", "template", "noscript"])
def test_html_unclosed_elements(tag):
    prose = "The council met on Monday, and agreed on the plan. It will be read again, in full, next week."
    assert html_text.main_text(f"<body><div><p>{prose}</p><{tag} class=x><p>{prose}</p></div><p>{prose}</p></body>") == " ".join([prose] * 3)
    assert html_text.main_text(f"<body><div><p>{prose}</p><{tag}>gone</{tag}><p>{prose}</p></div></body>") == " ".join([prose] * 2)


def brute_blocks(page):
    """Scores by plain definitions over path strings and lists of containers, from the blocks of a page."""
    def path_of(p):
        up, tag = page.paths[p]
        return (*path_of(up), tag) if p else ()

    def around(c):
        return [c, *around(page.containers[c][0])] if c else [0]

    factor = html_text.factors(page)
    rows = [dict(text=b[0], path=path_of(b[1]), box=b[2], art=b[3], link=b[4], f=f, box_path=path_of(page.containers[b[2]][1]), around=around(b[2])) for b, f in zip(page.blocks, factor)]
    vouch = Counter()
    for r in rows:
        vouch[r["art"]] += (len(r["text"]) - r["link"]) * (r["f"] == 1) * (r["art"] > 0)
    vouched = {a for a, n in vouch.items() if n > 0 and n >= 0.1 * max(vouch.values())}
    for r in rows:
        r["in"] = r["art"] in vouched
        signs = len(re.findall("[.,;:!?。，！？]+", r["text"]))
        link = r["link"] * ((1 - min(1, max(0, signs - 1) / 3)) if len(r["text"]) >= 40 else 1)
        r["plain"], r["marks"] = len(r["text"]) - link, signs * (1 - link / len(r["text"]))

    def ratio(path, inside, f):
        mine = [r for r in rows if (r["path"], r["in"], r["f"]) == (path, inside, f)]
        if not mine:
            return 0.0, 0.0
        n = len(mine)
        return f * (sum(r["plain"] for r in mine) / n * (1 + sum(r["marks"] for r in mine) / n)) ** 0.5, sum(r["plain"] for r in mine) / sum(len(r["text"]) for r in mine)

    for r in rows:
        r["own"], r["share"] = ratio(r["path"], r["in"], r["f"])
        if len(r["path"]) > 1 and r["path"][-2] in html_text._CONTAINERS and r["path"][-1] not in html_text._CONTAINERS:
            r["own"] = max(r["own"], 0.5 * ratio((*r["path"][:-2], r["path"][-1]), r["in"], r["f"])[0])
    for r, after in reversed(list(zip(rows, rows[1:]))):
        if re.fullmatch("h[1-6]", r["path"][-1] if r["path"] else "") and r["box"] == after["box"] and r["f"] == after["f"]:
            r["own"] = max(r["own"], after["own"])
    for i, r in enumerate(rows):
        three = sorted(rows[j]["own"] if 0 <= j < len(rows) and rows[j]["box"] == r["box"] else r["own"] for j in (i - 1, i, i + 1))
        r["smooth"] = max(r["own"], r["f"] * three[1])

    def mean(chosen):
        weight = sum(r["smooth"] * r["share"] * len(r["text"]) for r in chosen)
        return weight, weight / (sum(r["share"] * len(r["text"]) for r in chosen) or 1)

    names = [(r["art"], r["box_path"]) for r in rows]
    groups = {g: mean([r for r, n in zip(rows, names) if n == g]) for g in names}
    whole = {a: mean([r for r in rows if r["art"] == a and r["f"] == 1]) for a in vouched}
    best = max((whole if vouched else groups).values())[1]
    fused = [r["smooth"] if r["f"] < 1 or not groups[n][1] else r["smooth"] ** 0.25 * groups[n][1] ** 0.75 for r, n in zip(rows, names)]
    if vouched:
        weigh = [1.25 if r["in"] else 0.3 for r in rows]
    else:
        passed = [r for r, x in zip(rows, fused) if r["share"] * x >= 0.5 * best]
        size = Counter(c for r in passed for c in r["around"] for _ in r["text"])
        inner = max((c for c in size if c and size[c] >= 0.9 * size[0] and path_of(page.containers[c][1])[-1] != "body"), default=0)
        good = {r["box_path"] for r in passed if r["box"]}
        weigh = [1.25 if r["box_path"] in good or any(c == inner and c or path_of(page.containers[c][1]) in good - {("body",)} and c for c in r["around"]) else 1 for r in rows]
    return [r["share"] * x * w for r, x, w in zip(rows, fused, weigh)], best


L = "The council met on Monday, and agreed on the plan of the river; it will be read again, in full, next week. "
PAGES = [
    f"<article><p>{L * 3}</p><p>{L}</p><section class='thoughts'>First!! lol</section></article>",
    f"<article><p>{L * 3}</p><div>Buy now! Sale!</div><p>{L * 3}</p><table><tr><td>3</td></tr></table><p class=notice>{L * 3}</p><p>Yes.</p></article>",
    f"<body><div><h2>Plan</h2><p>{L * 2}</p><p>{L}</p><div><p>Short.</p></div><ul><li>Milk</li></ul></div><div><a href=1>Home</a> news</div><div class=ad>Buy, now.</div></body>",
    f"<main><h1>T</h1>{P * 3}<ul><li><a href=1>One</a></li></ul><div class=comments><p>{L}</p></div></main><div>{L}</div>",
]


@pytest.mark.parametrize("page", PAGES)
def test_html_scores_naively(page):
    read = html_text.Page(page)
    got, best = html_text.scores(read)
    want, most = brute_blocks(read)
    assert best == pytest.approx(most) and got == pytest.approx(want)


def test_html_ratios_decide(monkeypatch):
    """Comments and adverts without a listed word go, an author's notice and short cells stay; with a constant
    in the ratios' place they would not."""
    first, second = (html_text.main_text(p) for p in PAGES[:2])
    assert "lol" not in first and "Sale" not in second and second.endswith("Yes.") and " 3 " in second and second.count("Monday") == 9
    monkeypatch.setattr(html_text.math, "sqrt", lambda x: 1.0 if x else 0.0)
    assert "lol" in html_text.main_text(PAGES[0]) and "Sale" in html_text.main_text(PAGES[1])


@pytest.mark.parametrize("page, words", [
    ("<div>x " * 100_000, 100_000), ("<div class=ad>x " * 50_000, None), ("<p>a <b>b " * 50_000, 100_000), ("<div>x " * 50_000 + "</p></span>" * 50_000, 50_000)])
def test_html_deep_pages(page, words):
    began = time.process_time()
    got = html_text.main_text(page)
    assert time.process_time() - began < 20
    assert words is None or len(got.split()) == words


def test_html_query(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>"), (1, "u", "<article><p>é</p></article>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    assert html_text.main_text(long) == " ".join(["word, word."] * 20_000)
    assert html_text.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 10 cover tree
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)


def test_cover_tree_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([rng.normal(size=(200, 16)), *[c + rng.normal(scale=s, size=(25, 16)) for c, s in zip(centres, np.linspace(0.01, 0.6, 30))], np.tile(centres[:3], (20, 1))]).astype(np.float32)
    rows = [(i * 3 + 1, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0] * 8, [None] + [1.0] * 15]
    rows += [(10_000 + i, v, 1) for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in cover_tree.near_vectors(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(len(u), zip(*np.nonzero(near)))
    for i in range(len(u)):
        r = got[i * 3 + 1]
        assert (r.n_links, r.component_id, r.kept) == (near[i].sum(), want[i] * 3 + 1, want[i] == i)
    for i in range(len(odd)):
        assert (got[10_000 + i].n_links, got[10_000 + i].component_id, got[10_000 + i].kept) == (0, 10_000 + i, True)


def test_cover_tree_nodes_cover():
    x = np.random.default_rng(3).normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.Tree(x)

    def check(node):
        rows, centre, radius, children = node
        assert np.sqrt(np.maximum(0, 2 - 2 * x[rows] @ x[centre])).max() <= radius + 1e-7
        if children:
            assert sorted(np.concatenate([c[0] for c in children]).tolist()) == sorted(rows.tolist())
        return sum(map(check, children)) if children else len(rows)

    assert check(tree.root) == 900
    order = np.concatenate(tree.order)
    again = cover_tree.Tree(x[order], tree.paths[order])
    assert len(again.root[3]) == len(tree.root[3])


def test_cover_tree_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CHUNK", 60)
    x = np.random.default_rng(4).normal(size=(300, 4)).astype(np.float32)
    got = {r.vec_id: r.n_links for r in cover_tree.near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    assert [got[i] for i in range(300)] == (near.sum(1) - 1).tolist()
    assert cover_tree.near_vectors(vectors(spark, [(1, None, 0)])).first().component_id == 1
    assert cover_tree.near_vectors(vectors(spark, [(1, None, 0)]).limit(0)).count() == 0


@pytest.mark.parametrize("kind, size", [("array<float>", 1024), ("array<double>", 5)])
def test_cover_tree_deals_again(spark, monkeypatch, kind, size):
    """Few pivots, so that cells are dealt again, a clump that no pivots divide, links at the threshold."""
    monkeypatch.setattr(cover_tree, "CHUNK", 30)
    monkeypatch.setattr(cover_tree, "PIVOTS", 2)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, size))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.48, size=(20, size)), base[0] + rng.normal(scale=1e-4, size=(90, size))])
    x = x.astype(np.float32 if kind == "array<float>" else float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, [2.0, 4.0])], f"vec_id long, embedding {kind}")
    got = {r.vec_id: r for r in cover_tree.near_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(len(u), zip(*np.nonzero(near)))
    assert [(got[i].n_links, got[i].component_id) for i in range(len(u))] == [(near[i].sum(), want[i]) for i in range(len(u))]
    assert (got[900].n_links, got[901].component_id) == (1, 900)


# -------------------------------------------------------------- shared, pipeline
def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = components(500, edges)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: want[v] for v in {x for e in edges if e[0] != e[1] for x in e}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_never_cross_texts():
    data, off = common.flat_bytes(__import__("pyarrow").array(["ab c", "", None, "d", " e"]))
    begins, stops, first = common.words_of(data, off)
    assert [data[a:b].tobytes() for a, b in zip(begins, stops)] == [b"ab", b"c", b"d", b"e"] and first.tolist() == [0, 2, 2, 2, 3, 4]


def test_pipeline_stages(spark, labelled, tmp_path):
    import corpus_pipeline

    docs, labels, good, _ = labelled
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    copies = docs.where("doc_id between 2 and 6").withColumn("doc_id", F.col("doc_id") + 1000)
    docs = docs.union(copies)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (now, now := spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "packing":
            assert now.columns == docs.columns
    before, after = seen["exact_dedup"]
    texts = [r.text for r in after.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in before.collect()}
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in minhash.near_dedup(before).where("kept").collect()}
    before, after = seen["mixing"]
    assert after.agg(F.sum("n_chars")).first()[0] > 0
    piece = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert len(piece(corpus_pipeline.run(spark, str(tmp_path)))) == len(piece(now))


def test_pipeline_stages_on_odd_rows(spark, labelled, tmp_path):
    """Nulls in every column, empty texts, repeated rows, then no rows at all."""
    import corpus_pipeline

    docs, labels, _, _ = labelled
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", None, None, 0), (5001, None, "en", None, None), (5002, "three plain words here, and a few more.", None, None, None)] * 2, docs.schema)
    for name, df in (("odd", docs.union(odd)), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            f(spark, now, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{stage}")
            now = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        if name == "none":
            assert now.count() == 0
    near = [r.text for r in spark.read.parquet(f"{tmp_path}/odd/near_dedup").collect()]
    sets = [{tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (WORD.findall((t or "").lower()) for t in near)]
    assert all(not (a and b) or len(a & b) < 0.8 * len(a | b) for a, b in itertools.combinations(sets, 2))


def test_pipeline_stages_with_clashing_columns(spark, labelled, tmp_path):
    """Columns named like the stages' own pass through all but the last, unchanged; reused identifiers keep
    the rows that are their own, and the near stage equals all pairs."""
    import corpus_pipeline

    docs, labels, good, _ = labelled
    names = ("_id", "_tie", "_src", "_rep", "_spans", "id", "tie", "src", "rep", "row", "rank", "start", "size", "pass", "lo", "hi", "run", "spans", "kept", "row_key", "comp", "fp",
             "_key", "_text", "_t", "_sha", "score", "predicted", "held_out", "s", "key", "count", "keep_id", "component_id", "quality", "features", "_kept_key", "source_size", "target")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(120)
    again = docs.limit(10).withColumn("doc_id", F.lit(3).cast("long")).withColumn("text", F.concat(F.lit("Other words stand before it. "), "text"))
    docs = docs.union(again).select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.substring("text", 1, 30)).alias(c) for c in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            continue
        assert now.columns == docs.columns
        assert {tuple(r) for r in now.select("doc_id", *names).collect()} <= {tuple(r) for r in docs.select("doc_id", *names).collect()}
        if name == "near_dedup":
            rows = before.select("doc_id", "text").collect()
            sets = [shingles(r.text, 5) for r in rows]
            root = components(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
            least = {r: min(rows[i].doc_id for i in range(len(rows)) if root[i] == r) for r in set(root)}
            want = Counter((r.doc_id, r.text) for i, r in enumerate(rows) if r.doc_id == least[root[i]])
            assert Counter((r.doc_id, r.text) for r in now.select("doc_id", "text").collect()) == want
