"""Whitening against numpy's eigenvectors, the byte network against plain loops, alignments against whole texts."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tempoframe.llm import alignment, language, queries, whitening
from tempoframe.llm.memo_tokens import LONGEST

# --- whitening ---


def operator(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T, q


@pytest.mark.parametrize(
    ("values", "k", "block", "most"),
    [
        (np.linspace(1, 0.01, 64), 16, 16, 256),
        (np.linspace(1, 0.01, 200) ** 4, 10, 8, 40),  # restarts from Ritz vectors
        (np.array([3.0, 2.0, 2.0, 2.0, 1.0] + [0.0] * 45), 5, 4, 64),  # equal eigenvalues, and blocks that vanish
        (np.ones(30), 6, 4, 64),  # all of the first block stays where it is
        (np.array([2.0]), 16, 16, 256),
    ],
)
def test_block_lanczos(values, k, block, most):
    a, _ = operator(values)
    found = whitening.block_lanczos(lambda v: a @ v, len(values), k, block, most)
    k = min(k, len(values))
    assert np.allclose(found.values, values[:k], atol=1e-11)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(k), atol=1e-12)
    assert np.abs(a @ found.vectors - found.vectors * found.values).max() < 1e-11


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, x string, i int")


def plain_whitening(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == 5 and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((60, 5)) @ np.diag([5, 3, 2, 1, 0.4])).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100, base[0].tolist()), (100, base[0].tolist()), (None, base[1].tolist()), (101, None), (102, []), (103, [1.0] * 4), (104, [1.0, None, 1.0, 1.0, 1.0]), (105, [float("nan")] * 5), (106, [float("inf")] * 5), (107, [1e30] * 5)]
    kept, n, sums, values, vectors = plain_whitening(rows[:-1])
    found = whitening.whitened(vectors_table(spark, [(i, v, 0, 1, "x", 2) for i, v in rows])).toPandas()
    assert len(found) == 5 * len(kept) and set(found.n) == {n} and found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    share = found.drop_duplicates("component").sort_values("component").explained
    assert np.allclose(share, values / values.sum(), rtol=1e-10)
    by_id = {i: x for i, x in kept if i is not None}
    wide = found[found.vec_id.notna() & (found.vec_id != 100)].pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([[(n * c - s) / n for c, s in zip(by_id[i], sums, strict=True)] for i in wide.index]) @ vectors / np.sqrt(values)
    sign = np.sign((wide.to_numpy() * want).sum(axis=0))
    assert np.allclose(wide.to_numpy(), want * sign, atol=1e-9)
    for row in found[found.vec_id.notna()].itertuples():
        assert row.deviation == sum((n * c - s) ** 2 for c, s in zip(by_id[row.vec_id], sums, strict=True))


def test_whitening_of_little(spark):
    one = [(1, [1.0, 2.0], 0, 1, "", 0)] * 3
    assert whitening.whitened(vectors_table(spark, one)).count() == 0
    assert whitening.whitened(vectors_table(spark, [])).count() == 0
    assert whitening.whitened(vectors_table(spark, [(1, None, 0, 1, "", 0)])).count() == 0
    flat = whitening.whitened(vectors_table(spark, [(k, [float(k), 1.0, 2.0 * k], 0, 1, "", 0) for k in range(8)])).toPandas()
    assert set(flat.component) == {1} and np.isclose(flat.explained[0], 1) and np.isclose((flat.whitened**2).mean(), 1)


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(k, [1e8 * (k % 7 - 3), float(k)], 0, 1, "", 0) for k in range(400)]
    found = whitening.whitened(vectors_table(spark, rows)).toPandas()
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((400 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    got = found[found.component == 1].sort_values("vec_id").deviation.tolist()
    assert any(w >= 1 << 63 for w in want)
    assert all((w >= 1 << 63 and (g is None or g != g)) or g == w for g, w in zip(got, want, strict=True))


# --- languages ---


def plain_network(weights, piece):
    """Probabilities at each byte of one part, byte by byte."""
    h = len(weights["u0"])

    def side(k, bytes_):
        state, out = np.zeros(h), []
        for b in bytes_:
            given, own = weights[f"x{k}"][b], state @ weights[f"u{k}"]
            update, reset = (1 / (1 + np.exp(-(given[i * h : (i + 1) * h] + own[i * h : (i + 1) * h]))) for i in (0, 1))
            state = (1 - update) * np.tanh(given[2 * h :] + reset * own[2 * h :]) + update * state
            out.append(state)
        return out

    both = np.concatenate((side(0, piece), side(1, piece[::-1])[::-1]), axis=1)
    e = np.exp(both @ weights["w"] + weights["c"])
    return e / e.sum(axis=1, keepdims=True)


def plain_parts(text):
    words = [w + b" " for w in text.encode().translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ") if w]
    return [w[at : at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]


def test_words_and_pooling_against_plain_loops():
    net = language.Network(3, 5)
    texts = ["", "  ", "one two\n\nthree", "x" * 100, "Ünï çødé 日本語", " a  b ", "a" * (LONGEST - 1) + " " + "b" * LONGEST]
    data, low, high, owner = language.pieces([t.encode() for t in texts])
    assert [(int(o), data[i:j]) for i, j, o in zip(low, high, owner, strict=True)] == [(k, p) for k, t in enumerate(texts) for p in plain_parts(t)]
    for entries in (100, 2):  # with and without room for all
        reader = language.Reader(net.weights, entries)
        for _ in range(2):
            found = reader.documents([t.encode() for t in texts])
            for k, t in enumerate(texts):
                want = [plain_network(net.weights, p) for p in plain_parts(t)]
                assert np.allclose(found[k], np.concatenate(want).mean(axis=0) if want else 0, atol=1e-5)


def test_gradients_are_slopes():
    keys = language.keys_of(*language.pieces([b"hello w\xc3\xa4rld abc defghij"])[:3])
    data, size = language.bytes_of(keys)
    label, net = np.array([0, 1, 2, 1]), language.Network(3, 4)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    _, slopes = net.gradients(data, size, label)
    rng = np.random.default_rng(0)
    for name, w in net.weights.items():
        places = [np.unravel_index(np.argmax(np.abs(slopes[name])), w.shape)] + [tuple(rng.integers(0, s) for s in w.shape) for _ in range(5)]
        for at in places:
            old, ends = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = old + step
                ends.append(-np.log(net.labels(net.states(s := language.Sequences(data, size)))[np.arange(s.total), np.repeat(label[s.order], s.size)]).mean())
            w[at] = old
            assert np.isclose((ends[0] - ends[1]) / 2e-3, slopes[name][at], atol=2e-5)


SYLLABLES = {"en": ["th", "ing", "er", "wh", "and"], "fr": ["eau", "ç", "ment", "qu", "ère"], "de": ["sch", "ung", "ü", "keit", "pf"]}


def spoken(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, spoken(rng, lang := sorted(SYLLABLES)[i % 3], rng.randrange(3, 60)), lang) for i in range(300)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 345 !!", "fr"), (1003, "schung keit", None), (None, "eau ment", "en"), (1004, "th" * 40_000, "en")] + [rows[0]] * 3
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema)
    found = language.languages(docs, steps=150).toPandas()
    assert len(found) == len(rows) and found.score.between(0, 1).all()
    by_id = found.dropna().drop_duplicates("doc_id").set_index("doc_id")
    assert by_id.lang_pred[[1000, 1001, 1002]].tolist() == ["und"] * 3 and (by_id.score[[1000, 1001, 1002]] == 0).all()
    assert by_id.lang_pred[1003] == "de" and by_id.lang_pred[1004] == "en" and not found[found.doc_id.isna()].held_out.any()
    held = by_id[by_id.held_out]
    truth = {r[0]: r[2] for r in rows}
    told = held[held.lang_pred != "und"]
    assert len(told) > 40 and (told.lang_pred == [truth[i] for i in told.index]).mean() > 0.97
    # languages of held-out rows are never learnt
    hidden = set(held.index)
    other = spark.createDataFrame([(i, t, "fr" if i in hidden else lang) for i, t, lang in rows], schema)
    again = language.languages(other, steps=150).toPandas()
    assert again.sort_values(["doc_id", "score"]).lang_pred.tolist() == found.sort_values(["doc_id", "score"]).lang_pred.tolist()


def test_languages_of_little(spark):
    schema = "doc_id long, text string, lang string, score string, held_out int"
    assert language.languages(spark.createDataFrame([], schema)).count() == 0
    blank = language.languages(spark.createDataFrame([(1, "some text", None, "", 1), (None, "b", "en", "", 1)], schema)).toPandas()
    assert blank.lang_pred.tolist() == ["und", "und"] and blank.score.tolist() == [0, 0]
    one = language.languages(spark.createDataFrame([(i, "some text", "en", "", 1) for i in range(9)], schema), steps=3).toPandas()
    assert set(one.lang_pred) == {"en"} and np.allclose(one.score, 1)


# --- tokens ---

NAMES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def plain_alignment(texts):
    """Whole texts, token by token: per text the seven columns after doc_id."""
    both = alignment.Pair(*map(queries.vocabulary, NAMES))
    found, counts = [], Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        a, b = both.encode_a([" " + t])[0], both.b.encode(t)
        if not both.agree(t):
            found.append(None)
            continue
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((both.a_bytes, a), (both.b_bytes, b))]
        i = j = 0
        links, groups, left, right = [], [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                left.append(a[i])
                i += 1
            if y <= x:
                right.append(b[j])
                j += 1
            if x == y:
                groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
                left, right = [], []
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[x] == highest[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found]


HARD = ["x▁y and more", "▁", "a\n b  c\n\n\n  d ", " lead", "tail ", "tail  ", "\n", "\t\ttabs\r\n", " nbsp  x", "\x00nul \x1c \x85", "é ﬁ 日本。 語", "<0x0A> <s> <|endoftext|> </s>", " ", "  ", "a  b", "🙂 🙂🙂", "don't I'll", "ʼn ​ z"]


@pytest.mark.parametrize("options", [{}, {"bucket": 20_000, "broadcast_pairs": 0}])
def test_alignment_against_whole_texts(spark, odd_pairs, options):
    pairs = [*odd_pairs, *((900 + k, t) for k, t in enumerate(HARD))]
    docs = spark.createDataFrame([(i, t, 1, "g", 2) for i, t in pairs], "doc_id long, text string, n_a int, `groups` string, bucket int")
    found = alignment.cross_tokenizer_alignment(docs, *map(queries.vocabulary, NAMES), **options).toPandas()
    want = Counter((i, *row) for (i, _), row in zip(pairs, plain_alignment([t for _, t in pairs]), strict=True))
    assert Counter((None if r[0] != r[0] else int(r[0]), *r[1:]) for r in found.itertuples(index=False)) == want


def test_parts_join_to_the_text():
    for t in [*HARD, "plain words.\nAnd lines", "x", "\nx", "x\n", " \nx", "a \nb", "a\n b"]:
        parts = alignment.parts_of(t)
        assert "".join(map(alignment.part_text, parts)) == " " + t
        cuts = [m.start() for m in alignment.CUT.finditer(" " + t)]
        assert np.cumsum([len(alignment.part_text(p)) for p in parts])[:-1].tolist() == cuts


def test_a_name_has_one_text():
    texts = ["x", " x", "\nx", " \nx", "  x", " ", "\n", "\n x"]
    names = [p for t in texts for p in alignment.parts_of(t)]
    assert len({alignment.part_text(n) for n in names}) == len(set(names))


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross_tokenizer_alignment(docs, *map(queries.vocabulary, NAMES)).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in alignment.cross_tokenizer_alignment(docs, *map(queries.vocabulary, NAMES)).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
