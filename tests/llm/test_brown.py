from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import crowded, prose
from weftline.llm import brown

SMALL = brown.Settings(listed=60, core=20, classes=5)


def tokens(text: str | None) -> list:
    return [*(text or "").encode().lower().split(), None]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(31)
    return [(i, prose(rng, rng.randint(0, 60), rng.choice(["en", "de", "fr"]))) for i in range(200)] + [(500, None), (501, "")]


@pytest.fixture(scope="module")
def scored(make_docs, corpus):
    return {r.doc_id: r for r in brown.brown_scores(make_docs(corpus), settings=SMALL).collect()}


def train_counts(corpus) -> Counter:
    return Counter(t for i, x in corpus if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))


def test_counts_and_base_scores(corpus, scored):
    c = train_counts(corpus)
    n, v = sum(c.values()), len(c)
    assert len(scored) == len(corpus)
    for i, x in corpus:
        r = scored[i]
        t = tokens(x)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)


def g(x: float) -> float:
    return x * math.log(x) if x > 1 else 0.0


def slow_exchange(pairs: Counter, words: list, width: int, sweeps: int) -> dict:
    """Each word in turn goes where the likelihood, computed anew for each choice, is greatest."""
    of = {w: 0 if i == 0 else 1 + (i - 1) % (width - 1) for i, w in enumerate(words)}
    pairs = {k: n for k, n in pairs.items() if k[0] in of and k[1] in of}

    def likelihood() -> float:
        cells, rows, columns = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            cells[of[a], of[b]] += n
            rows[of[a]] += n
            columns[of[b]] += n
        return sum(map(g, cells.values())) - sum(map(g, rows.values())) - sum(map(g, columns.values()))

    for _ in range(sweeps):
        moved = False
        for w in words[1:]:
            own, found = of[w], []
            for k in range(1, width):
                of[w] = k
                found.append(likelihood())
            best = max(found)
            of[w] = own if best <= found[own - 1] + 1e-9 else 1 + found.index(best)
            moved |= of[w] != own
        if not moved:
            break
    return of


def slow_model(corpus, settings) -> tuple[dict, Counter, np.ndarray]:
    """The class of each word, the counts and the transitions, word by word."""
    texts = [[brown.END if t is None else t for t in tokens(x)] for i, x in corpus if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in texts for w in t)
    listed = [brown.END, *sorted((w for w in c if w != brown.END), key=lambda w: (-c[w], w))[: settings.listed]]
    pairs = Counter((a, b) for t in texts for a, b in zip([brown.END, *t], t))  # noqa: B905
    width = settings.classes
    of = slow_exchange(pairs, listed[: settings.core], width, settings.sweeps)
    core = set(of)
    for turn in range(settings.rounds):
        near = {w: k for w, k in of.items() if w in (listed if turn else core)}
        cells = np.zeros((width, width))
        for (a, b), n in pairs.items():
            if a in near and b in near:
                cells[near[a], near[b]] += n
        before, after = {w: Counter() for w in c}, {w: Counter() for w in c}
        for (a, b), n in pairs.items():
            if a in near:
                before[b][near[a]] += n
            if b in near:
                after[a][near[b]] += n
        new = dict(of)
        for w in c:
            if w == brown.END or (turn == 0 and w in core):
                continue
            if not before[w] and not after[w]:
                seeds = Counter(of[x] for x in listed[1 : settings.core])
                new.setdefault(w, max(range(1, width), key=lambda k: (seeds[k], -k)))
                continue
            gains = []
            for k in range(1, width):
                sign = -1 if of.get(w) == k else 1
                add = lambda x, n: sign * (g(max(x + sign * n, 0)) - g(x))  # noqa: E731, B023
                gain = sum(add(cells[j, k], n) for j, n in before[w].items()) + sum(add(cells[k, j], n) for j, n in after[w].items())
                gains.append(gain - add(cells[:, k].sum(), before[w].total()) - add(cells[k].sum(), after[w].total()))
            best = max(gains)
            own = of.get(w)
            new[w] = own if own is not None and gains[own - 1] >= best - 1e-9 else 1 + gains.index(best)
        of = new
    steps = np.zeros((width, width))
    for (a, b), n in pairs.items():
        steps[of[a], of[b]] += n
    return of, c, steps


def classes_of(spark, model, words) -> dict:
    """``{word: (count, class)}`` of the words in the model's table, all of whose rows are used."""
    names = spark.createDataFrame([(w,) for w in words], "word binary").withColumn("id", brown.word_id("word"))
    rows = model.table.join(names, "id").collect()
    assert len(rows) == model.table.count()
    return {bytes(r.word): (r.c, r.k) for r in rows}


@pytest.mark.parametrize(
    ("settings", "often"),
    [(SMALL, 1 << 20), (SMALL, 30), (brown.Settings(listed=5000, core=30, classes=4, rounds=3), 10), (brown.Settings(listed=40, core=40, classes=6, rounds=1), 1 << 20)],
)
def test_classes_transitions_and_scores_against_brute_force(spark, make_docs, corpus, settings, often, monkeypatch):
    monkeypatch.setattr(brown, "OFTEN", often)
    of, c, steps = slow_model(corpus, settings)
    marked = make_docs(corpus).select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0).alias("held_out"),
                                      F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    model, ready = brown.learn(marked, settings)
    assert classes_of(spark, model, c) == {w: (n, of[w]) for w, n in c.items()}
    total = sum(c.values())
    sizes = np.zeros(settings.classes)
    for w, n in c.items():
        sizes[of[w]] += n
    step = (steps + settings.prior * sizes / total) / (steps.sum(1, keepdims=True) + settings.prior)
    assert np.allclose(model.step, step)
    unseen = sum(n == 1 for w, n in c.items() if w != brown.END) / (total + 1)

    def p(word, before: int) -> float:
        if not c[word]:
            return unseen
        k = of[word]
        return (1 - unseen) * (settings.weight * step[before, k] * c[word] / sizes[k] + (1 - settings.weight) * c[word] / total)

    rows = {r.doc_id: r for r in brown.score(ready, model).collect()}
    for i, x in corpus:
        before, logs = 0, 0.0
        for w in tokens(x):
            w = brown.END if w is None else w
            logs += math.log10(p(w, before))
            before = of.get(w, before)
        assert rows[i].score == pytest.approx(logs, rel=1e-6, abs=1e-6)
    # Whatever stands before, the chances of all words, the end and "any other word" sum to 1.
    for before in range(settings.classes):
        assert sum(p(w, before) for w in c) + unseen == pytest.approx(1, abs=1e-9)


def test_without_later_rounds_every_word_still_has_a_class(make_docs, corpus):
    rows = brown.brown_scores(make_docs(corpus), settings=brown.Settings(listed=10, core=5, classes=3, rounds=0)).collect()
    assert len(rows) == len(corpus) and all(math.isfinite(r.score) for r in rows)


def test_words_too_long_for_the_list_have_classes(spark, make_docs):
    long = "x" * 1000
    docs = make_docs([(i, f"a {long} b c d {long}") for i in range(40)])
    marked = docs.select("doc_id", F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("b"))
    model, _ = brown.learn(marked, brown.Settings(classes=3))
    assert long.encode() not in model.listed
    count, k = classes_of(spark, model, [*(w.encode() for w in ("a", "b", "c", "d", long)), brown.END])[long.encode()]
    assert count == 80 and 1 <= k < 3


def test_held_out_text_is_likelier_than_under_the_base(corpus, scored):
    held = [r for r in scored.values() if r.held_out and r.n_tokens > 5]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_classes_and_never_gets_worse():
    """Words of two kinds that follow their own kind end in classes of one kind; the likelihood grows."""
    n = 21
    bigrams = np.zeros((n, n))
    for a in range(1, n):
        for b in range(1, n):
            bigrams[a, b] = 10 + a % 3 if a % 2 == b % 2 else 1
    bigrams[0, 1:] = bigrams[1:, 0] = 2
    of = brown.exchange(bigrams, 3, 10)

    def likelihood(classes) -> float:
        one = np.eye(3)[classes]
        cells = one.T @ bigrams @ one
        return brown._g(cells).sum() - brown._g(cells.sum(1)).sum() - brown._g(cells.sum(0)).sum()

    assert of[0] == 0 and {len({of[w] for w in range(1, n) if w % 2 == k}) for k in (0, 1)} == {1} and of[1] != of[2]
    start = np.concatenate(([0], 1 + np.arange(n - 1) % 2))
    assert likelihood(of) >= likelihood(start)
    rng = np.random.default_rng(1)
    noisy = rng.poisson(3, (n, n)).astype(float)
    bigrams = noisy
    assert likelihood(brown.exchange(noisy, 3, 10)) > likelihood(start)


def test_odd_rows_and_clashing_names(odd_docs, empty_docs):
    rows = brown.brown_scores(crowded(odd_docs)).collect()
    assert len(rows) == 12 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1} and max(r.n_tokens for r in rows) == 60_001
    same = [r for r in rows if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert brown.brown_scores(empty_docs).count() == 0


def test_without_training_rows(make_docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = brown.brown_scores(make_docs([(held, "a b c")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (4, 0, 0, 0.0, 0.0)


def test_crc_is_of_the_decimal_text(spark):
    assert spark.range(3).select(F.crc32(F.col("id").cast("string").cast("binary"))).first()[0] == zlib.crc32(b"0")
