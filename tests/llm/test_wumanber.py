from __future__ import annotations

import hashlib
import random
import re

import pytest

from tests.llm.conftest import crowded, prose
from weftline.llm import wumanber

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text: str | None) -> list[bytes]:
    return WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode())


def slow(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    words, hit, found = slow_words(text), set(), set()
    for name, item in items:
        w = slow_words(item)
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(name)
    return len(words), len(hit), sorted(str(x) for x in found - {None})


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, n)) for i, n in enumerate([10, 11, 25, 9, 3, 1, 40, 12])]
    rows += [(8, None), (9, ""), (10, "!!! ..."), (None, prose(rng, 12)), (11, rows[2][1]), (2, rows[2][1]), (12, " ".join(rows[6][1].split()[5:17]))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def documents(rows: list[tuple]) -> list[tuple]:
    rng = random.Random(12)
    out = [(100, None), (101, ""), (102, " \t"), (103, "a"), (103, "a")]
    for i in range(60):
        words = prose(rng, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            piece = (rng.choice(rows)[1] or "").split()
            a = rng.randint(0, max(0, len(piece) - 10))
            at = rng.randint(0, len(words))
            words[at:at] = piece[a : a + rng.choice([5, 9, 10, 11, 30])]
        out.append((i, rng.choice([" ", "\n", ", ", "--"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_search_against_naive_search(make_docs, items, block_bytes):
    """With all items in one block, and with so many that tables have to be built anew."""
    rows, table = items
    docs = documents(rows)
    got = wumanber.search(make_docs(docs), table, ["doc_id", "text"], block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.item_ids) == slow(r.text, rows), r.text
        assert sum(s.b - s.a for s in r.spans) == r.n_hit


def test_many_overlapping_patterns():
    rng = random.Random(1)
    for _ in range(50):
        alphabet = [b"a", b"b", b"c"]
        text = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        patterns = {tuple(rng.choice(alphabet) for _ in range(rng.randint(1, 6))): {k} for k in range(8)}
        spans, owners = wumanber.WuManber(patterns).find(text)
        expected = {(i, i + len(p)) for p in patterns for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p}
        assert set(spans) == expected
        assert owners == {k for p, ks in patterns.items() for k in ks if any(tuple(text[a:b]) == p for a, b in expected)}


def test_empty_tables_and_odd_rows(spark, odd_docs, empty_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in wumanber.search(odd_docs, none, ["doc_id"]).collect()] == [0] * 12
    assert wumanber.search(empty_docs, items[1], ["doc_id"]).count() == 0
    same = spark.createDataFrame([(1, "same words HERE")], "item_id long, text string")
    kept = wumanber.keep_clean(crowded(odd_docs), same)
    assert kept.columns == crowded(odd_docs).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 3, 4, 7, 8, 9]))


def test_very_long_text_is_searched_to_its_end(make_docs, spark):
    tail = "zq wx ev rt yn um io pl kj hg"
    docs = make_docs([(1, prose(random.Random(3), 200_000) + " " + tail), (2, prose(random.Random(4), 30))])
    got = {r.doc_id: r for r in wumanber.search(docs, spark.createDataFrame([(5, tail)], "item_id long, text string"), ["doc_id"]).collect()}
    assert got[1].n_hit == 10 and got[1].n_words == 200_010 and got[2].n_hit == 0
    assert hashlib.sha256(",".join(got[1].item_ids).encode()).hexdigest() == hashlib.sha256(b"5").hexdigest()
