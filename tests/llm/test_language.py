from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import crowded, prose
from weftline.llm import language


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(21)
    return [(i, prose(rng, rng.randint(1, 40), lang), lang, "s") for i in range(600) for lang in [rng.choice(["en", "de", "fr", "es"])]]


def test_held_out_accuracy(make_docs, labelled):
    truth = {r[0]: r[2] for r in labelled}
    rows = language.identify(make_docs(labelled), ["doc_id"]).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.95 * len(held) > 80
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_depends_on_text_alone(make_docs, labelled):
    """Labels, sources and ids of the rows to predict change nothing."""
    texts = {r[0]: r[1] for r in labelled}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    lied = [(i, t, "xx" if i in held else lang, "other") for i, t, lang, _ in labelled]
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(make_docs(labelled), ["doc_id"]).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(make_docs(lied), ["doc_id"]).collect()}
    assert a == b


def test_families():
    assert language.family_of("en") == language.family_of("de") != language.family_of("fr")
    assert language.family_of("xx-odd") == "xx-odd"


def test_svm_separates_and_weighs_small_classes():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 0.3, (200, 5)), rng.normal(-1, 0.3, (6, 5))]).astype(np.float32)
    y = np.array([1.0] * 200 + [-1.0] * 6)
    w = language.linear_svm(x, y, 10.0, 50)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).all()


def test_features_of_long_texts_have_length_one():
    text = prose(random.Random(1), 300_000).encode()
    assert len(text) > language._STRETCH
    assert abs(float(np.linalg.norm(language.features(text, 13, 4))) - 1) < 1e-4
    assert not language.features(b"", 13, 4).any()


def slow_features(text: str, bits: int, orders: int) -> dict:
    """By the definition, gram by gram."""
    letters, last = [], ""
    for b in text.encode():
        c = chr(b).lower() if b < 128 and chr(b).isalpha() else chr(b) if b >= 128 else " "
        if c != " " or last != " " or not letters:
            letters.append(ord(c))
        last = c
    counts: dict = {}
    for order in range(1, orders + 1):
        for i in range(len(letters) - order + 1):
            h = 0
            for c in letters[i : i + order]:
                h = (h * 263 + c + 1) % 2**32
            slot = (h * 2654435761 % 2**32) >> (32 - bits)
            counts[slot] = counts.get(slot, 0) + 1
    total = sum(counts.values())  # square roots of counts, scaled to length 1
    return {k: (n / total) ** 0.5 for k, n in counts.items()}


def test_predictions_against_brute_force(make_docs, labelled):
    """Features, margins, votes and scores computed apart from the weights of the trained machines."""
    docs = make_docs(labelled).selectExpr("doc_id", "lang", "CAST(text AS BINARY) AS b")
    settings = language.Settings(bits=10, per_language=60)
    model = language.train(docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 != 2"), settings)
    got = {r.doc_id: r for r in language.identify(make_docs(labelled), ["doc_id"], settings=settings).collect()}
    for i, text, *_ in labelled[:150]:
        x = slow_features(text, 10, 4)

        def decide(group: int, names: list, x=x) -> tuple[str, float]:
            if len(names) == 1:
                return names[0], math.inf
            votes, sums, worst = {n: 0 for n in names}, {n: 0.0 for n in names}, {n: math.inf for n in names}
            for (g, a, b), w in zip(model.pairs, model.weights.T, strict=True):
                if g == group:
                    m = sum(v * float(w[k]) for k, v in x.items()) + float(w[-1])
                    votes[names[a] if m >= 0 else names[b]] += 1
                    for n, side in ((names[a], m), (names[b], -m)):
                        sums[n] += side
                        worst[n] = min(worst[n], side)
            best = max(names, key=lambda n: (votes[n], sums[n], -names.index(n)))
            return best, worst[best]

        family, first = decide(-1, model.names)
        at = model.names.index(family)
        lang, second = decide(at, model.members[at])
        score = 1.0
        for margin in (first, second):
            score /= 1 + math.exp(-settings.slope * min(margin, 50))
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, rel=1e-3)


def test_very_many_values_of_lang_are_bounded(make_docs):
    docs = make_docs([(i, f"text {i} of it", f"dirty{i}" if i % 3 else "en", "s") for i in range(300)]).selectExpr("doc_id", "lang", "CAST(text AS BINARY) AS b")
    model = language.train(docs, language.Settings(languages=5, bits=8))
    assert sum(map(len, model.members)) == 5 and ["en"] in model.members and len(model.pairs) == 10
    assert {m[0] for m in model.members} == {"en", *sorted(f"dirty{i}" for i in range(300) if i % 3)[:4]}


def test_winner_by_votes_then_margins():
    assert language._winner(3, [(0, 1, 1.0), (0, 2, 0.5), (1, 2, 2.0)]) == (0, 0.5)
    best, least = language._winner(3, [(0, 1, 1.0), (0, 2, -2.0), (1, 2, 0.5)])  # one vote each
    assert best == 2 and least == -0.5
    assert language._winner(1, []) == (0, np.inf)


def test_odd_rows(odd_docs, empty_docs, make_docs):
    rows = language.identify(odd_docs, ["doc_id", "text"]).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert (r.score == 0) == (r.lang_pred == "und")
    assert language.identify(empty_docs, ["doc_id"]).count() == 0
    nothing = language.identify(make_docs([(1, "some text", None, "s")]), ["doc_id"]).collect()
    assert nothing[0].lang_pred == "und"


def test_one_language_alone_is_predicted(make_docs):
    rows = language.identify(make_docs([(i, f"text {i}", "nl", "s") for i in range(20)]), ["doc_id"]).collect()
    assert {r.lang_pred for r in rows} == {"nl"} and {r.score for r in rows} == {1.0}


def test_sample_is_bounded_and_holds_every_language(make_docs):
    docs = make_docs([(i, f"t {i}", "en" if i % 50 else f"l{i % 7}", "s") for i in range(3000)])
    small = language.Settings(per_language=20, sample=100)
    found = language.bounded_sample(docs, "lang", small.per_language, small.sample).collect()
    assert {r.lang for r in found} == {r.lang for r in docs.select("lang").distinct().collect()} and len(found) <= 100


def test_keep_identified_keeps_columns_and_fills_lang(odd_docs):
    docs = crowded(odd_docs)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [4, 5, 5, 6, 8, 9, None]))
    assert all(r.lang is not None and r.score == "x score" for r in rows)
