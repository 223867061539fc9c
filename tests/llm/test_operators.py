"""Each operator against a plain version, over odd inputs and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempoframe.llm import decontamination, exact_dedup, line_dedup, near_copies, packing, quality, simhash, suffix_dedup, token_shards, toxicity, warc
from tempoframe.llm.components import connected_components
from tempoframe.llm.memo_tokens import MemoEncoder
from tempoframe.llm.shared import shared_folder
from tempoframe.llm.words import word_numbers
from tests.llm.conftest import SCHEMA, prose, rows_of

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def text_of(t):
    return "" if t is None else t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1
def plain_spans(pairs, least=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", text_of(t))) for i, t in pairs]
    seen = collections.Counter(tuple(w[k : k + least]) for _, w in words for k in range(len(w) - least + 1))
    out = collections.Counter()
    for i, text in set(pairs):
        w, now = re.findall(r"[^\x20\x09-\x0D]+", text_of(text)), None
        for k in [k for k in range(len(w) - least + 1) if seen[tuple(w[k : k + least])] > 1]:
            if now and k <= now[1]:
                now[1] = k + least
            else:
                if now:
                    out[i, *now] += 1
                now = [k, k + least]
        if now:
            out[i, *now] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0}, {"hot_classes": 0}])
def test_repeated_spans_are_those_of_all_windows(spark, odd, odd_pairs, options):
    assert collections.Counter(tuple(r) for r in suffix_dedup.repeated_spans(odd, **options).collect()) == plain_spans(odd_pairs)


def test_repeats_at_the_limit(spark):
    rng = random.Random(8)
    p49, p50 = prose(rng, 49, 10**6), prose(rng, 50, 10**6)
    pairs = [(i, f"{prose(rng, 40, 10**6)} {p} {prose(rng, 40, 10**6)}") for i, p in enumerate([p49, p49, p50, p50])]
    got = collections.Counter(tuple(r) for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows_of(pairs), SCHEMA)).collect())
    assert got == plain_spans(pairs) == collections.Counter([(2, 40, 90), (3, 40, 90)])


@pytest.mark.parametrize("options", [{}, {"broadcast_keys": 0}, {"hot_classes": 0}])
def test_repeats_that_extend_differently(spark, options):
    """Occurrences that share some words to the left with one copy and some to the right with another; ids that repeat or lack."""
    rng = random.Random(12)
    core, pairs = prose(rng, 60, 10**6).split(), []
    for i in range(40):
        a, b = rng.randrange(0, 25), rng.randrange(35, 60)
        pairs.append((rng.choice([i, 3, None]), " ".join([prose(rng, 30, 10**6), *core[a:b], prose(rng, 30, 10**6)])))
    two = prose(rng, 1, 2)
    pairs += [(60, " ".join(rng.choice("ab") for _ in range(400))), (61, f"{two} " * 120)]
    got = collections.Counter(tuple(r) for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows_of(pairs), SCHEMA), **options).collect())
    assert got == plain_spans(pairs) and len(got) > 3


def paired_words(n):
    """Two different words of n letters that polynomial hashes modulo powers of two do not tell apart."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_are_hard_to_tell_apart(spark):
    rng = random.Random(14)
    for n in (1024, 2048):
        one, two = paired_words(n)
        a, b = prose(rng, 30, 10**6), prose(rng, 30, 10**6)
        pairs = [(0, f"{a} {one} {b}"), (1, f"{a} {two} {b}"), (2, f"{one} {two}")]
        df = spark.createDataFrame(rows_of(pairs), SCHEMA).coalesce(1)
        assert suffix_dedup.repeated_spans(df).isEmpty() and not plain_spans(pairs)
        items = spark.createDataFrame([(7, f"{one} {one} {one}")], "item_id long, text string")
        assert decontamination.contaminated(df, items).isEmpty()
        for got, path, end in ((token_shards.token_shards(df, BYTES), BYTES, 2), (packing.best_fit_packing(df, WORDS), WORDS, 1)):
            t = Tokenizer.from_file(path)
            assert {r["doc_id"]: r["ids_crc32"] for r in got.collect()} == {i: crc(t.encode(x, add_special_tokens=False).ids + [end]) for i, x in pairs}


def test_words_with_one_number_are_compared_as_words(monkeypatch):
    def weak(texts, plain=True):
        words = [decontamination.plain_words(t) for t in texts]
        return np.array([len(w) for x in words for w in x], np.uint64), np.cumsum([0, *map(len, words)])

    monkeypatch.setattr(decontamination, "word_numbers", weak)
    items = [(1, " ".join("abcdefghijklmno")), (2, "ab cd ef")]
    index = decontamination.SeedIndex(items)
    assert index.found([" ".join("abcdefghijklmno"), " ".join("onmlkjihgfedcba"), "x ab cd ef", "x ab cd eg"], 13, 0.8) == [(0, 1, 0, 15, 15), (2, 2, 1, 4, 3)]


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    from tempoframe.llm import memo_tokens

    monkeypatch.setattr(memo_tokens, "hashed", lambda keys: keys[:, -1] << np.uint64(60))
    t, m = Tokenizer.from_file(BYTES), MemoEncoder(BYTES, "kept", 4000)
    texts = [prose(random.Random(3), 300), "nul \x00 a\x00 a a\x00\x00"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# 2
def test_wavelet_matrix():
    for n, top in ((0, 1), (1, 1), (5000, 3), (70_000, 60_000), (66_000, 1 << 30)):
        rng = np.random.default_rng(n)
        tokens = rng.zipf(1.3, n).clip(max=top).astype(np.uint32) if top < 1 << 24 else rng.integers(0, top, n, dtype=np.uint32)
        w = token_shards.WaveletMatrix(token_shards.WaveletMatrix.encode(tokens))
        assert (w.tokens() == tokens).all()
        for i in rng.integers(0, n, 12).tolist() if n else []:
            t = int(tokens[i])
            places = np.flatnonzero(tokens == t)
            assert (w.access(i), w.count(t), w.rank(t, i)) == (t, len(places), (places < i).sum())
            assert w.select(t, len(places) - 1) == places[-1] and (len(places) > 50 or list(w.occurrences(t)) == places.tolist())
        assert w.count(1 << 31) == 0
        with pytest.raises(IndexError):
            w.access(n)


@pytest.mark.parametrize(("path", "spaces"), [(BYTES, "kept"), (WORDS, "dropped")])
def test_memo_ids_are_the_tokenizers(path, spaces, odd_pairs):
    rng, t = random.Random(1), Tokenizer.from_file(path)
    texts = [text_of(x) for _, x in odd_pairs] + ["".join(rng.choice(" \n\tab'sZé́.,1 \x1c　ｱ日<|>") for _ in range(rng.randrange(30))) for _ in range(800)]
    texts += [" ".join([prose(rng, 3000)] * 30), "y" * 600_000]
    m = MemoEncoder(path, spaces)
    for _ in range(2):  # the second time from the table
        assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_shards(spark, odd, odd_pairs, none):
    t = Tokenizer.from_file(BYTES)
    expected, start = [], 0
    hashes = {text_of(r["t"]): r["h"] for r in odd.select(F.col("text").alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for i, text in sorted(((i, text_of(x)) for i, x in odd_pairs), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = token_shards.token_shards(odd, BYTES, shard_tokens=20_000).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert token_shards.token_shards(none, BYTES).count() == 0


# 3
def plain_exact(pairs):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", text_of(t))
    for i, t in pairs:
        groups[norm(t)].append((-len(text_of(t)), i is None, i))
    out = []
    for i, t in pairs:
        g = groups[norm(t)]
        keep = min(g, key=lambda r: (r[0], r[1], r[2] or 0))[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"pattern": "(?s).{1,3}"}, {"identifiers": (lambda c: F.struct(F.length(c).alias("a")), exact_dedup.long_identifier)}])
def test_exact_dedup(odd, odd_pairs, none, options):
    got = exact_dedup.exact_dedup(odd, **options)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain_exact(odd_pairs)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_resist_shifts_in_other_scripts(spark):
    rng = random.Random(4)
    scripts = {"ru": range(0x430, 0x450), "ja": [*range(0x3041, 0x3090), *range(0x4E00, 0x5200)], "ar": range(0x621, 0x64A), "hi": range(0x905, 0x93A), "en": range(97, 123)}
    texts = {k: "".join(chr(rng.choice(list(v))) for _ in range(20_000)) for k, v in scripts.items()}
    rows = [(i, t) for i, t in enumerate(x for t in texts.values() for x in (t, "1" * 37 + t))]
    found = {r["doc_id"]: r["chunks"] for r in exact_dedup.chunked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(0, len(rows), 2):
        assert len(found[i]) > 8 and len(set(found[i]) - set(found[i + 1])) <= 4


# 4 and 6
def labelled(spark, rng, n=900):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, 60, 200).split()
        if toxic:
            words[10::20] = [f"vile{rng.choice('abc')}" for _ in words[10::20]]
        poor = i % 5 == 0
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    extra = [(n, None), (n + 1, ""), (None, "abc"), (n + 2, "z" * 200_000)]
    return spark.createDataFrame(rows_of(docs + extra), SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "column", "folds", "fold"), [(toxicity.toxicity, "toxic", 5, 0), (quality.quality, "quality", 3, 1)])
def test_scores_of_held_out_rows(spark, none, score, column, folds, fold):
    docs, labels = labelled(spark, random.Random(2))
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert score(none, labels).count() == 0
    flat = {round(r["score"], 6) for r in score(docs, labels.filter("doc_id < 0")).collect()}
    assert flat == {0.5}


@pytest.mark.parametrize(("score", "column"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_scores_of_odd_rows(spark, odd, odd_pairs, score, column):
    """Odd rows, labels that repeat, lack or name no document: a score for each row, the same for equal texts."""
    ids = sorted({i for i, _ in odd_pairs if i is not None})
    labels = [(i, int(i % 3 == 0), "extra") for i in ids] + [(ids[0], None, "x"), (None, 1, "x"), (10**9, 1, "x"), (ids[1], 1, "x")]
    rows = score(odd, spark.createDataFrame(labels, f"doc_id long, {column} int, text string")).collect()
    assert len(rows) == len(odd_pairs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    texts, by_text = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in odd_pairs:
        texts[i].add(text_of(t))
    for r in rows:
        if len(texts[r["doc_id"]]) == 1:
            by_text[next(iter(texts[r["doc_id"]]))].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = labelled(spark, random.Random(4), 400)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {tuple(r) for r in toxicity.toxicity(docs, labels).collect()} == {tuple(r) for r in toxicity.toxicity(docs, turned).collect()}


def plain_models(docs):
    """Ratios of words and of pairs by dictionaries; docs: (text, label). Words are told by their numbers only for the classes before them."""
    number = {w: int(n) for text, _ in docs for w, n in zip(text.split(), word_numbers([text])[0], strict=True)}
    count, follow, kinds = [collections.Counter() for _ in "01"], [collections.Counter() for _ in "01"], collections.defaultdict(set)
    for text, label in docs:
        before = None
        for w in text.split():
            count[label][w] += 1
            follow[label][before, w] += 1
            kinds[w].add(int(toxicity.mixed(np.array([number.get(before, 0)], np.uint64))[0]) >> 58)
            before = w
    total, k, v = [sum(c.values()) for c in count], sum(map(len, kinds.values())), len(kinds)

    def single(c, w):
        shared = (len(kinds[w]) - 0.75) / k + 0.75 * v / k / (v + 1)
        return (max(count[c][w] - 0.75, 0) + 0.75 * len(count[c]) * shared) / total[c]

    def ratio(p):
        return np.log(p[1]) - np.log(p[0])

    words = {w: ratio([single(c, w) for c in (0, 1)]) for w in kinds if count[0][w] + count[1][w] >= 2}
    pairs, weights = {}, {}
    for h in [h for h, r in words.items() if abs(r) >= 1]:
        own = [{w: n for (b, w), n in follow[c].items() if b == h} for c in (0, 1)]
        free = [0.75 * len(o) / sum(o.values()) if o else 1 for o in own]
        if own[0] or own[1]:
            weights[h] = ratio(free)
        for w in own[0].keys() | own[1].keys():
            if w in words and own[0].get(w, 0) + own[1].get(w, 0) >= 2:
                r = ratio([(max(o.get(w, 0) - 0.75, 0) / sum(o.values()) if o else 0) + f * single(c, w) for c, (o, f) in enumerate(zip(own, free, strict=True))])
                if abs(r - weights[h] - words[w]) >= 0.25:
                    pairs[h, w] = r
    return number, words, weights, pairs


def test_ratios_are_those_of_models_by_dictionaries(spark):
    rng, docs = random.Random(21), []
    for i in range(120):
        label = int(i % 3 == 0)
        words = prose(rng, rng.randrange(1, 80), 120).split()
        docs.append((" ".join(f"vile {w}" if label and rng.random() < 0.2 else f"fair {w}" if not label and rng.random() < 0.1 else w for w in words), label))
    number, words, weights, pairs = plain_models(docs)
    model = toxicity.WordModel(spark.createDataFrame(docs, "text string, label int"))
    signed = lambda w: number[w] - (1 << 64) if number[w] >> 63 else number[w]
    close = lambda got, want: got.keys() == want.keys() and all(abs(got[x] / toxicity.SCALE - want[x]) < 2e-5 for x in want)
    rows = model.words.collect()
    assert close({r["word"]: r["ratio"] for r in rows}, {signed(w): r for w, r in words.items()})
    assert close({r["word"]: r["weight"] for r in rows}, {signed(w): weights.get(w, 0) for w in words})
    assert len(pairs) > 20 and close({(r["before"], r["word"]): r["ratio"] for r in model.pairs.collect()}, {(signed(h), signed(w)): r for (h, w), r in pairs.items()})
    # Evidence by a loop over the words of each text.
    texts, unseen = [docs[0][0], "", "vile unheard vile", docs[1][0] + " vile w3"], model.unseen / toxicity.SCALE
    for text, x in zip(texts, toxicity.evidence(texts, model.arrays()), strict=True):
        sums, own = np.zeros(8), text.split()
        for before, w in zip([None, *own], own, strict=False):
            one = words.get(w, unseen)
            both = pairs.get((before, w), weights.get(before, 0) + one)
            for k, r in enumerate((both, one)):
                sums[4 * k : 4 * k + 4] += [r, max(r - 1, 0), max(r - 2, 0), max(-r - 1, 0)]
        assert np.allclose(x, [*(sums / max(len(own), 1)), np.log(max(len(own), 1))], atol=1e-4)


def test_ranking_is_that_of_all_pairs():
    """Bradley-Terry strengths by plain gradient steps on each pair of a good and a poor row."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 3))
    label = (x @ [1.5, -1.0, 0.3] + rng.normal(size=120) > 0.3).astype(int)
    ranking = quality.Ranking(x, label, 100_000)
    z, w = (x - x.mean(0)) / x.std(0), np.zeros(3)
    for _ in range(400):
        slope = np.zeros(3)
        for g in z[label == 1]:
            d = g - z[label == 0]
            slope += (d / (1 + np.exp(d @ w))[:, None]).sum(0)
        w += 2 * slope / (label.sum() * (1 - label).sum())
    plain, got = z @ w, ranking.strength(x)
    assert np.corrcoef(plain, got)[0, 1] > 0.9999 and abs(plain.std() / got.std() - 1) < 0.15  # the ridge draws them in
    assert (got < ranking.threshold).sum() == (label == 0).sum()
    assert ((ranking.score(x) >= 0.5) == (got >= ranking.threshold)).all()


def test_toxic_words_of_equal_character_classes_are_told_apart(spark):
    rng = random.Random(8)
    vile, fair = (lambda: f"{rng.choice((1234, 9031))}"), (lambda: f"{rng.choice((4321, 1309, 7777))}")
    docs, labels = [], []
    for i in range(600):
        toxic = int(i % 3 == 0)
        words = prose(rng, 60, 200).split()
        words[5::20] = [vile() if toxic else fair() for _ in words[5::20]]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    df, marked = spark.createDataFrame(rows_of(docs), SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [sorted(map(tuple, toxicity.toxicity(df, marked, **options).collect())) for options in ({}, {"broadcast_words": 0, "broadcast_pairs": 0})]
    assert [r[:2] + r[3:] for r in got[0]] == [r[:2] + r[3:] for r in got[1]] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(*got, strict=True))
    left = [sorted(r[0] for r in toxicity.without_toxic(df, marked, **options).select("doc_id").collect()) for options in ({}, {"broadcast_words": 0}, {"broadcast_pairs": 0, "broadcast_ids": 0})]
    assert left[0] == left[1] == left[2] == [r[0] for r in got[0] if r[2] < 0.5]
    held = [(p, labels[i][1]) for i, h, _, p in got[0] if h]
    assert sum(p == t for p, t in held) / len(held) > 0.97


# 5
def test_packing(odd, odd_pairs, none):
    t = Tokenizer.from_file(WORDS)
    expected = []
    for i, x in odd_pairs:
        ids = t.encode(text_of(x), add_special_tokens=False).ids + [1]
        expected += [(i, k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
    rows = packing.best_fit_packing(odd, WORDS, per_part=7).collect()
    assert {r["gap"] for r in rows} <= {0, 1}
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = np.array([e[3] for e in expected])
    short = lengths[lengths < 4096]
    assert len(by) <= (lengths == 4096).sum() + packing.lower_bound(np.bincount(short, minlength=4097), 4096) + 1
    assert packing.best_fit_packing(none, WORDS).count() == 0


def test_lower_bounds_hold():
    rng = random.Random(5)

    def best(items, capacity):
        fewest = len(items)

        def place(i, bins):
            nonlocal fewest
            if len(bins) >= fewest:
                return
            if i == len(items):
                fewest = len(bins)
                return
            for j in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return fewest

    for _ in range(400):
        c = rng.choice([10, 12, 17, 20])
        items = sorted((rng.randint(1, c) for _ in range(rng.randint(0, 8))), reverse=True)
        got = np.array(items, int)
        assert packing.lower_bound(np.bincount(got, minlength=c + 1), c) <= best(items, c) <= packing.best_fit_decreasing(got, c)[2]


# 7
def test_warc(spark):
    big = "é" * 600
    pages = [(1, "http://a.example.com/x?b=2&a=1", big), (2, "https://www.b.example.com:443/", big), (9, "ftp://c", big), (3, None, None), (4, "not a url", ""), (5, "http://a.example.com/x", "short"), (6, "http://d.example.com/", "short"), (None, "http://e.example.com/\r\n", big), (9, "ftp://c", big), (7, "http://[bad", "y" * 40_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, keep string, digest int")
    rows = warc.warc_captures(df, archive_bytes=3000).collect()
    assert len(rows) == len(pages)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    expected = []
    for i, _, h in pages:
        data = text_of(h).encode()
        twin = h == big and i != 9
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if twin else "response", 9 if twin else None))
    assert got == sorted(expected, key=str)
    order = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in rows]
    assert order == sorted(order)
    assert warc.url_key("https://www.B.example.com:443/P?b=2&a=1#f") == "com,example,b)/p?a=1&b=2"
    assert warc.warc_captures(df.filter("page_id < 0")).count() == 0


def test_warc_of_very_long_and_many_equal_payloads(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh <>/\n") for _ in range(3_000_000))
    pages = [(1, "http://a.example.com/", long), (2, "http://b.example.com/", long), (3, "http://c.example.com/", long + "x")] + [(10 + i, f"http://d{i % 3}.example.com/{i}", "z" * 1000) for i in range(300)] + [(400 + i, None, "z" * 999) for i in range(20)]
    rows = {r["page_id"]: r for r in warc.warc_captures(spark.createDataFrame(pages, "page_id long, url string, html string"), archive_bytes=1 << 20, range_rows=50).collect()}
    assert len(rows) == len(pages) and all(rows[i]["payload_digest"] == hashlib.sha1(h.encode()).hexdigest() and rows[i]["payload_bytes"] == len(h) for i, _, h in pages)
    assert [rows[i]["record_type"] for i in (1, 2, 3)] == ["revisit", "response", "response"] and rows[1]["refers_to"] == 2
    assert sum(rows[10 + i]["record_type"] == "response" for i in range(300)) == 1 and all(rows[10 + i]["refers_to"] == 309 for i in range(299))
    assert all(rows[400 + i]["record_type"] == "response" for i in range(20))


def test_archives_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.example.com/", "<p>one</p>")], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    ((_, _, fields, block),) = warc.warc_records(file.read_bytes())
    assert fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://a.example.com/" and block.endswith(b"\r\n\r\n<p>one</p>")


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


# 8
def test_decontamination(spark, odd, none):
    rng = random.Random(6)
    items = [(i, prose(rng, 30, 5000)) for i in range(6)] + [(6, "only four words here"), (7, ""), (8, None), (None, prose(rng, 20, 5000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = prose(rng, 200, 5000)
    swapped = items[1][1].split()
    swapped[7], swapped[20] = "other", "words"
    docs = [(0, f"{clean} {items[0][1]} {clean}"), (1, f"{clean} {' '.join(swapped)}"), (2, clean), (3, None), (4, f"x Only four, WORDS here! y"), (5, "only four other words here"), (6, items[9][1].upper()), (7, " ".join(items[2][1].split()[:12])), (8, " ".join(items[2][1].split()[:13])), (None, items[3][1])]
    df = spark.createDataFrame(rows_of(docs), SCHEMA)
    for options in ({}, {"block_words": 20}):
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, bench, **options).collect()} == {(0, 0), (1, 1), (4, 6), (6, None), (8, 2), (None, 3)}
        left = decontamination.without_benchmark(df, bench, **options)
        assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {2, 3, 5, 7}
    spans = {(r["doc_id"], r["start"], r["end"], r["matched"]) for r in decontamination.benchmark_overlaps(df, bench).collect()}
    assert {(0, 200, 230, 30), (1, 200, 230, 28)} <= spans
    assert decontamination.contaminated(none, bench).count() == 0 and decontamination.contaminated(odd, bench.filter("item_id < 0")).count() == 0


def test_seeds_miss_no_accepted_overlap():
    for n in range(decontamination.LEAST, 26):
        windows = [sum(1 << (k + i) for i, c in enumerate(m) if c == "1") for m in decontamination.MASKS for k in range(n - len(m) + 1)]
        for spoilt in range(int(n * (1 - decontamination.SHARE) + 1e-9) + 1):
            if n - spoilt >= decontamination.LEAST:
                assert all(any(not w & gone for w in windows) for gone in (sum(1 << i for i in c) for c in itertools.combinations(range(n), spoilt)))
    index = decontamination.SeedIndex([(7, " ".join(f"w{i}" for i in range(16)))])
    for gone in itertools.combinations(range(16), 3):
        text = " ".join("other" if i in gone else f"w{i}" for i in range(16))
        accepted = index.overlaps(0, word_numbers([text])[0], np.zeros(1, np.int64), decontamination.LEAST, decontamination.SHARE)
        assert index.found([text], decontamination.LEAST, decontamination.SHARE) == [(0, 7, *best) for best in accepted]


def test_overlaps_are_those_of_all_alignments():
    rng = random.Random(1)
    for _ in range(60):
        some = rng.choice([1, 2, 3, 30])
        items = [(i, prose(rng, rng.randrange(40), some)) for i in range(4)] + [(9, "a b c " * 9)]
        texts = ["a b c " * 20]
        for _ in range(3):
            own = rng.choice(items)[1].split()
            for _ in range(len(own) // 7):
                own[rng.randrange(len(own))] = "sub"
            texts.append(f"{prose(rng, rng.randrange(60), some)} {' '.join(own)} {prose(rng, rng.randrange(5), some)}")
        expected = set()
        for (d, t), (i, x) in itertools.product(enumerate(texts), items):
            words, own = t.split(), x.split()
            for shift in range(1 - len(own), len(words)):
                same = [(j, own[j] == words[shift + j]) for j in range(len(own)) if 0 <= shift + j < len(words)]
                best = (-1.0, 0, 0, 0)
                for a in range(len(same)):
                    worth, matched = 0.0, 0
                    for b in range(a, len(same)):
                        worth, matched = worth + (1 if same[b][1] else -4), matched + same[b][1]
                        if worth > best[0] + 1e-6 or (worth > best[0] - 1e-6 and b + 1 == best[2]):
                            best = (worth, a, b + 1, matched)
                if same and best[3] >= min(13, len(own)):
                    expected.add((d, i, shift + same[0][0] + best[1], shift + same[0][0] + best[2]))
        assert {r[:4] for r in decontamination.SeedIndex(items).found(texts, 13, 0.8)} == expected


def test_accepted_overlaps_of_any_length_are_found():
    rng = random.Random(17)
    for n in range(13, 61):
        for share in (0.8, 0.85, 0.9, 0.95, 1.0):
            item = [f"w{j}" for j in range(n)]
            index, found, accepted = decontamination.SeedIndex([(1, " ".join(item))]), 0, 0
            for _ in range(12):
                gone = set(rng.sample(range(n), round(n * (1 - share))))
                text = " ".join("other" if j in gone else w for j, w in enumerate(item))
                accepted += bool(index.overlaps(0, word_numbers([text])[0], np.zeros(1, np.int64), 13, 0.8))
                found += bool(index.found([text], 13, 0.8))
            assert found == accepted


def test_one_repeated_word_does_not_multiply():
    index = decontamination.SeedIndex([(1, "la " * 400), (2, "la " * 400)])
    words, starts = word_numbers(["la " * 4000])
    assert len(index.hits(words, starts)[0]) < 2 * 4400 and len(index.place) < 20


def test_words():
    words, starts = word_numbers(["A b,", "", None, " «x»  -- B "], plain=True)
    assert starts.tolist() == [0, 2, 2, 2, 5] and words[1] == words[4] and len(set(words.tolist())) == 4
    long = "ab " * 900_000
    assert word_numbers([long, "c"], plain=False)[1].tolist() == [0, 900_000, 900_001]


# 9
def plain_chunks(text):
    """A chunk ends after a line where a number of this and the line before is even, if it has two lines by then."""
    lines, out, now = text.split("\n"), [], []
    h = [xxhash.xxh64_intdigest(line.encode()) for line in lines]
    for i, line in enumerate(lines):
        now.append(line)
        two = (h[i] + (h[i - 1] * 0x9E3779B97F4A7C15 if i else 0)) % 2**64
        if len(now) >= 2 and (two ^ two >> 31) % 2 == 0:
            out.append(now)
            now = []
    if len(now) == 1 and out:
        out[-1] = out[-1] + now
    elif now:
        out.append(now)
    return ["\n".join(c) for c in out]


def test_line_dedup(spark, odd, odd_pairs, none):
    rng = random.Random(9)
    pool = ["\n".join(f"{prose(rng, 4)}." for _ in range(rng.randrange(1, 9))) for _ in range(14)]
    pairs = odd_pairs + [(rng.choice([100 + i, 100 + i, 101, None]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(5)
    tids = {r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    for options in ({}, {"digests": (lambda c: c[:1], line_dedup.long_digest)}):
        got = collections.defaultdict(list)
        for r in line_dedup.line_dedup(df, **options).collect():
            got[r["doc_id"]].append(r["text"])
            assert r["n_chars"] == len(r["text"]) and r["gone"] == "g"
        first = {}
        for i, t in sorted(((i, text_of(t)) for i, t in pairs), key=lambda r: (r[0] is None, r[0] or 0, tids[r[1]])):
            for c in plain_chunks(t):
                first.setdefault(c, (i, t))
        for i, t in pairs:
            kept, met = [], set()
            for c in plain_chunks(text_of(t)):
                if "\n" not in c or c.isspace() or (first[c] == (i, text_of(t)) and c not in met):
                    kept.append(c)
                met.add(c)
            assert "\n".join(kept) in got[i]
    assert line_dedup.line_dedup(none).columns == none.columns and line_dedup.line_dedup(none).count() == 0


def test_boundaries_resist_shifts():
    lines = [f"line {i * i}" for i in range(200)]
    one, two = line_dedup.line_chunks("\n".join(lines)), line_dedup.line_chunks("\n".join(["new", *lines]))
    assert len(set(one) - set(two)) <= 2 and "\n".join(two) == "\n".join(["new", *lines])


# 10
def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, joined):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if joined(values[i], values[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("options", [{}, {"limit": 2}, {"blocks": 6}])
def test_simhash(odd, odd_pairs, none, options):
    fps = [plain_fingerprint(text_of(t)) for _, t in odd_pairs]
    label = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {k: min((i for (i, _), x in zip(odd_pairs, label, strict=True) if x == k and i is not None), default=None) for k in label}
    got = simhash.simhash_components(odd, **options).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, f"{fp:016x}", least[k]) for (i, _), fp, k in zip(odd_pairs, fps, label, strict=True)), key=str)
    assert simhash.simhash_components(none).count() == 0


def test_shards_lose_no_link(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:100]:
        values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for blocks, limit in ((5, 4096), (6, 3), (7, 4096)):
        pairs = [tuple(r) for r in simhash.links(df, 4, blocks, limit).collect()]
        own = {v: i for i, (v,) in enumerate(df.collect())}
        edges = {frozenset((own[a], own[b])) for a, b in pairs}
        one = components(list(range(len(values))), lambda i, j: frozenset((i, j)) in edges)
        assert one == components(values, lambda a, b: (a ^ b).bit_count() <= 4)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: k for n, k in label.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("options", [{}, {"limit": 2}, {"limit": 3, "part_shingles": 300}])
def test_near_copies(spark, odd, odd_pairs, none, options):
    rng = random.Random(5)
    base = prose(rng, 150, 5000).split()
    copies = []
    for i in range(8):
        w = list(base)
        w[10 + 15 * i] = "swap"
        copies.append((200 + i, " ".join(w)))
    chain = prose(rng, 60, 5000).split()  # each is near the next ones only
    chained = [(300 + i, " ".join(chain[3 * i :] + [f"n{j}" for j in range(3 * i)])) for i in range(12)]
    twice = [(200, prose(rng, 90)), (201, copies[5][1]), (201, "a text of its own")]
    pairs = odd_pairs + copies + chained + twice
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (text_of(t).lower().split() for _, t in pairs)]
    named = sorted({(i, text_of(t), frozenset(s)) for (i, t), s in zip(pairs, sets, strict=True) if i is not None}, key=lambda r: r[:2])
    label = components([s for _, _, s in named], lambda a, b: (not a and not b) or len(a & b) >= 0.8 * len(a | b) > 0)
    least = {k: min(i for (i, _, _), x in zip(named, label, strict=True) if x == k) for k in label}
    df = spark.createDataFrame(rows_of(pairs), SCHEMA)
    hashed = {(r["doc_id"], r["tid"]): text_of(r["text"]) for r in df.select("doc_id", "text", near_copies._tid().alias("tid")).collect()}
    got = near_copies.near_copy_groups(df, **options).collect()
    assert {(r["doc_id"], hashed[r["doc_id"], r["tid"]], r["keep_id"]) for r in got} == {(i, t, least[k]) for (i, t, _), k in zip(named, label, strict=True)}
    left = near_copies.without_near_copies(df, broadcast_ids=options.get("limit", 100), **options)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == df.columns and sorted(i for i in ids if i is not None) == sorted(least.values()) and ids.count(None) == 2
    assert near_copies.without_near_copies(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"limit": 8}])
def test_long_near_copies_are_decided_exactly(spark, options):
    pairs, whole = [], []
    for words in (600, 1000, 1800, 3000, 5000):
        for k, share in enumerate((0.78, 0.785, 0.79, 0.795, 0.798, 0.802, 0.805, 0.81, 0.815, 0.82)):
            name = f"{words}x{k}"
            common = round(2 * (words - 4) * share / (1 + share)) + 4
            head = [f"c{name}x{j}" for j in range(common)]
            for side in "ab":
                pairs.append((len(pairs), " ".join(head + [f"{side}{name}x{j}" for j in range(words - common)])))
            whole.append((len(pairs) - 2, len(pairs) - 1, (common - 4) / (2 * (words - 4) - common + 4)))
    got = {r["doc_id"]: r["keep_id"] for r in near_copies.near_copy_groups(spark.createDataFrame(rows_of(pairs), SCHEMA), **options).collect()}
    assert {(a, b) for a, b, _ in whole if got[a] == got[b]} == {(a, b) for a, b, s in whole if s >= 0.8}


def test_files_of_other_attempts_are_not_read(spark, tmp_path):
    """The work runs twice into one folder, in another order; each manifest reads its own files."""
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i}", f"<p>{i}</p>" * 30) for i in range(200)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(200)], "doc_id long, text string")
    folder, expected = f"file://{tmp_path}", None
    for df, rows, name in ((pages, lambda: warc.warc_captures(pages_in(), f"{folder}/w", archive_bytes=3000), "w"), (docs, lambda: token_shards.token_shards(docs_in(), BYTES, shard_tokens=500, folder=f"{folder}/t"), "t")):
        expected = None
        for order in ("a", "b"):
            mixed = df.repartition(3 if order == "a" else 5, F.rand(1 if order == "a" else 2))
            pages_in = docs_in = lambda m=mixed: m
            got = sorted(tuple(r[c] for c in r.asDict() if c not in ("archive", "offset", "shard", "place", "length")) for r in rows().collect())
            assert len(got) == 200 and (expected is None or got == expected)
            expected = got
        assert len(list((tmp_path / name).iterdir())) > 4


def test_ranges_of_captures_follow_each_other(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.example.com/{i % 31}", f"<p>{i}</p>") for i in range(500)] + [(7, "http://h7.example.com/7", "<p>7</p>")] * 40, "page_id long, url string, html string")
    got = warc.warc_captures(pages, archive_bytes=2000, range_rows=60)
    assert got.rdd.getNumPartitions() > 5
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in got.collect()]
    assert order == sorted(order) and len(order) == 540


def test_a_cluster_needs_a_shared_folder(spark):
    class Other:
        conf, sparkContext = type("C", (), {"get": lambda *_: None})(), type("S", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Other())
    assert shared_folder(spark).startswith("file:///")
