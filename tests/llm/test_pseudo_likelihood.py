import math
from collections import Counter
from dataclasses import replace

import numpy as np

from sheafwork.llm import pseudo_likelihood as P
from tests.llm.helpers import corpus, documents, empty

SMALL = P.Shape(classes=4, members=5, hidden=6, side=2, shared=1, batch=64, cells=1 << 12)


def narrow(docs):
    return docs.selectExpr("doc_id as id", "text")


def test_gradient():
    net = P.WindowNetwork(SMALL, np.random.default_rng(0).standard_normal(P.WindowNetwork(SMALL).flat.size) * 0.5)
    words = np.array([20, 20, 3, 4, 19, 7, 20, 20, 0, 20, 20])
    at = np.flatnonzero(words < 20)
    whole = P.WindowNetwork(SMALL, np.zeros_like(net.flat))
    for part, rows, g in net.gradient(words, at):
        whole.parts[part][rows] += g
    for k in range(0, net.flat.size, 7):
        old, ends = net.flat[k], []
        for e in (1e-5, -1e-5):
            net.flat[k] = old + e
            ends.append(-net.log_probability(words, at).mean())
        net.flat[k] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - whole.flat[k]) < 1e-6


def brute(text, vocabulary, net, counts):
    """The sum of conditional log-probabilities, word by word, with plain loops."""
    s = net.shape
    tables, bias, cw, cb, ww, wb = (p.astype(float) for p in net.parts)
    words = P.words_of(text)
    ids = [s.size] * s.side + [vocabulary.numbers.get(w, vocabulary.shared_number(vocabulary.cell(w))) for w in words] + [s.size] * s.side
    rare = {x: n for x, n in counts.items() if x not in vocabulary.numbers}
    cells, totals = Counter(), Counter()
    for x, n in rare.items():
        cells[vocabulary.cell(x)] += n
        totals[vocabulary.shared_number(vocabulary.cell(x))] += n
    total = 0.0
    for w, i in zip(words, range(s.side, len(ids) - s.side)):
        h = np.tanh(bias + sum(tables[k][ids[i + o]] for k, o in enumerate(net.offsets)))
        c, m = divmod(ids[i], s.members)
        for logits, k in ((h @ cw + cb, c), (h @ ww[c] + wb[c], m)):
            total += logits[k] - math.log(np.exp(logits).sum())
        if w not in vocabulary.numbers:
            total += math.log(cells[vocabulary.cell(w)] / totals[ids[i]])
    return total


def test_scores_match_brute_force(spark):
    rows = corpus(11)
    rows += [rows[0], (None, rows[1][1])]
    docs = documents(spark, rows)
    _, vocabulary, net = P.fit(narrow(docs), SMALL)
    counts = Counter(w for _, t in rows for w in P.words_of((t or "").encode()))
    out = P.score_documents(docs, shape=SMALL).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, (t or "").encode())
    for r in out:
        n = len(P.words_of(texts[r.doc_id]))
        assert r.n_words == n and (r.mean_log_likelihood is None) == (n == 0)
        if n < 400 or n > 2000:
            assert abs(r.log_likelihood - brute(texts[r.doc_id], vocabulary, net, counts)) < 1e-2 * max(1, n) ** 0.5


def test_scores_do_not_depend_on_partitions(spark):
    rows = corpus(12)
    shape = replace(SMALL, shard_words=900)
    found = [{r.doc_id: r.log_likelihood for r in P.score_documents(documents(spark, rows, n), shape=shape).collect()} for n in (1, 7)]
    assert all(abs(found[0][i] - found[1][i]) < 1e-3 * (1 + abs(found[0][i])) for i in found[0])


def test_held_out_text_scores_above_its_unigrams(spark):
    import random

    r = random.Random(1)
    tongues = [["".join(r.choice(letters) for _ in range(4)) for _ in range(60)] for letters in ("abcde", "fghij", "klmno")]
    text = lambda: " ".join(r.choices(r.choice(tongues), k=60))
    _, vocabulary, net = P.fit(narrow(documents(spark, [(i, text()) for i in range(600)])), P.Shape(classes=8, members=12, shared=2, batch=128, shard_words=12_000))
    held = [vocabulary.read(text().encode())[0] for _ in range(50)]
    counts, logs = P.score_numbers([x.tobytes() for x in held], net)
    plain = sum(np.log(vocabulary.total[x] / vocabulary.total.sum()).sum() for x in held)
    assert logs.sum() / counts.sum() > plain / counts.sum() + 0.5


def test_the_vocabulary_grows():
    sizes = [P.Shape().sized(n) for n in (10, 10**4, 10**6, 10**12)]
    assert [s.classes for s in sizes] == [8, 8, 25, 256] and all(a.numbered <= b.numbered and a.cells <= b.cells for a, b in zip(sizes, sizes[1:]))


def test_probabilities_sum_to_one():
    net = P.WindowNetwork(SMALL)
    base = np.array([20, 20, 1, 2, 3, 20, 20])
    total = 0.0
    for w in range(SMALL.size):
        base[3] = w
        total += np.exp(net.log_probability(base, np.array([3])))[0]
    assert abs(total - 1) < 1e-5


def test_order_of_words_is_learned(spark):
    rows = [(i, "aa bb cc dd ee ff " * 30) for i in range(40)]
    scores = {r.doc_id: r.mean_log_likelihood for r in P.score_documents(documents(spark, [*rows, (900, "aa bb cc dd ee ff " * 5), (901, "ff cc aa ee bb dd aa dd " * 4)]), shape=SMALL).collect()}
    assert scores[900] > scores[901] + 1


def test_counts_cover_all_words(spark):
    docs = narrow(documents(spark, [(1, "A a b b b c"), (2, None), (3, "b a d")]))
    vocabulary, n = P.read_vocabulary(docs, P.Shape(classes=2, members=2, shared=1, cells=64))
    assert vocabulary.numbers == {b"b": 0, b"a": 1} and vocabulary.total[:2].tolist() == [4, 3] and vocabulary.total.sum() == n == 9


def test_empty_table(spark):
    assert P.score_documents(empty(spark), shape=SMALL).count() == 0


def test_every_word_has_a_number_as_far_as_the_limit_reaches(spark):
    assert all(P.Shape().sized(n).numbered >= min(n, P.Shape().most_numbered) for n in (1, 10, 28, 300, 10**4, 65_536, 10**6, 10**12))
    rows = corpus(13)
    vocabulary, n = P.read_vocabulary(narrow(documents(spark, rows)), P.Shape())
    counts = Counter(w for _, t in rows for w in P.words_of((t or "").encode()))
    assert set(vocabulary.numbers) == set(counts) and vocabulary.total[: len(counts)].sum() == n == sum(counts.values())


GROUPS = replace(SMALL, classes=2, groups=3, members=5)


def test_gradient_with_groups():
    net = P.WindowNetwork(GROUPS, np.random.default_rng(0).standard_normal(P.WindowNetwork(GROUPS).flat.size) * 0.5)
    words = np.array([30, 30, 3, 4, 29, 7, 30, 30, 0, 17, 30, 30])
    at = np.flatnonzero(words < 30)
    whole = P.WindowNetwork(GROUPS, np.zeros_like(net.flat))
    for part, rows, g in net.gradient(words, at):
        whole.parts[part][rows] += g
    for k in range(0, net.flat.size, 3):
        old, ends = net.flat[k], []
        for e in (1e-5, -1e-5):
            net.flat[k] = old + e
            ends.append(-net.log_probability(words, at).mean())
        net.flat[k] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - whole.flat[k]) < 1e-6


def test_probabilities_of_groups_sum_to_one_and_start_from_counts():
    counts = np.arange(30.0)
    net = P.WindowNetwork(GROUPS).start_from(counts)
    net.parts[0][:] = net.parts[1][:] = 0
    words = np.concatenate([[30, 30], np.arange(30), [30, 30]])
    found = np.exp([net.log_probability(words, np.array([k]))[0] for k in range(2, 32)])
    assert np.allclose(found, (counts + 0.1) / (counts + 0.1).sum(), atol=1e-5)


def test_runs_are_multiplied_in_stacks():
    """Words of thousands of groups cost a few products, not some for each group; long and short runs give what plain loops give."""
    r = np.random.default_rng(4)
    key = np.sort(np.concatenate([np.repeat(np.arange(3000), r.integers(1, 17, 3000)), np.full(40, 7)]))
    runs = P.Runs(key)
    assert len(runs.stacks) <= 5 and len(runs.long) == 1
    shape = P.Shape(classes=50, groups=60, members=3, hidden=4)
    net = P.WindowNetwork(shape, r.standard_normal(P.WindowNetwork(shape).flat.size))
    h = r.standard_normal((len(key), 4))
    assert np.allclose(net.logits(4, h, key, runs), [x @ net.parts[4][k] + net.parts[5][k] for x, k in zip(h, key, strict=True)])
    words = np.concatenate(([shape.size], np.sort(r.integers(0, shape.size, 4000) ** 2 // shape.size), [shape.size]))
    at = np.flatnonzero(words < shape.size)
    found = {part: (rows, g) for part, rows, g in net.gradient(words, at) if part in (4, 5)}
    h, target = net.hidden(words, at), words[at]
    d = np.array([x @ net.parts[4][k] + net.parts[5][k] for x, k in zip(h, target // 3, strict=True)])
    d = np.exp(d - d.max(axis=1, keepdims=True))
    d = d / d.sum(axis=1, keepdims=True) - (np.arange(3) == (target % 3)[:, None])
    rows, g = found[4]
    assert rows.tolist() == sorted(set((target // 3).tolist()))
    for k, own, own_bias in zip(rows, g, found[5][1], strict=True):
        some = target // 3 == k
        assert np.allclose(own, h[some].T @ d[some] / len(at)) and np.allclose(own_bias, d[some].sum(axis=0) / len(at))


def test_large_logits():
    logits, choice = np.array([[900.0, 0, -900], [0, 1, 2]]), np.array([2, 1])
    plain = [-1800, 1 - math.log(1 + math.e + math.e**2)]
    assert np.allclose(P.WindowNetwork.picked(logits.copy(), choice), plain)
    assert np.allclose(P.WindowNetwork.slopes(logits.copy(), choice)[0], [1, 0, -1])
