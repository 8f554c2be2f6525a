from __future__ import annotations

import math
import pickle
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import crowded, prose
from weftline.llm import quality


class SlowModel:
    """Interpolated modified Kneser-Ney with dictionaries; END, RARE and BEGIN are strings of their own."""

    def __init__(self, texts: list[str]):
        words = Counter(w for t in texts for w in t.encode().lower().split())
        self.known = {w for w, n in words.items() if n > 1}
        self.rare = max(1, sum(n == 1 for n in words.values()))
        tri = Counter()
        for t in texts:
            s = self.sequence(t)
            tri.update(zip(s, s[1:], s[2:], strict=False))
        bi = Counter((b, c) for _, b, c in tri)
        uni = Counter((c,) for _, c in bi)
        self.orders = [self.order(x) for x in (uni, bi, tri)]
        self.size = len(self.known) + 2

    def sequence(self, text: str) -> list:
        return ["<s>", "<s>", *(w if w in self.known else "<rare>" for w in text.encode().lower().split()), "</s>"]

    @staticmethod
    def order(counts: Counter):
        of = Counter(counts.values())
        y = of[1] / max(1, of[1] + 2 * of[2])
        d = [min(max(k - (k + 1) * y * of[k + 1] / max(1, of[k]), 0.1), k - 0.05) for k in (1, 2, 3)]
        total, cut = defaultdict(int), defaultdict(float)
        for gram, c in counts.items():
            total[gram[:-1]] += c
            cut[gram[:-1]] += d[min(c, 3) - 1]
        return counts, d, total, cut

    def p(self, gram: tuple) -> float:
        if not gram:
            return 1 / self.size
        counts, d, total, cut = self.orders[len(gram) - 1]
        lower, h = self.p(gram[1:]), gram[:-1]
        if not total[h]:
            return lower
        c = counts[gram]
        return (c - d[min(c, 3) - 1] if c else 0) / total[h] + cut[h] / total[h] * lower

    def perplexity(self, text: str) -> float | None:
        s = self.sequence(text)
        if len(s) == 3:
            return None
        logs = [math.log(self.p(tuple(s[i - 2 : i + 1]))) - (math.log(self.rare) if s[i] == "<rare>" else 0) for i in range(2, len(s))]
        return math.exp(-sum(logs) / len(logs))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(41)
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        text = prose(rng, rng.randint(1, 50), lang)
        if i % 6 == 0:
            text = " ".join(w + "$%&"[k % 3] * 3 for k, w in enumerate(text.split()))
        rows.append((i, text, lang, "s"))
    labels = [(i, int(i % 6 != 0), 0) for i in range(240) if i % 5]
    return rows, labels


def trains(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 2 != 0


@pytest.mark.parametrize("shard_rows", [1 << 20, 600])
def test_perplexities_and_thresholds_against_dictionaries(spark, make_docs, corpus, shard_rows):
    """Also with a model of many more grams than a shard, so than a task, may hold."""
    rows, labels = corpus
    trusted = {i for i, q, _ in labels if q == 1}
    slow = SlowModel([t for i, t, _, _ in rows if i in trusted and trains(i)])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(make_docs(rows), table, quality.Settings(shard_rows=shard_rows)).collect()
    assert len(got) == len(rows)
    texts = {i: (t, lang) for i, t, lang, _ in rows}
    for r in got:
        assert r.perplexity == pytest.approx(slow.perplexity(texts[r.doc_id][0]), rel=1e-3)
        assert r.keep == (r.perplexity <= r.threshold)
    for lang in ("en", "de"):
        held = sorted(r.perplexity for r in got if r.lang == lang and r.doc_id in trusted and not trains(r.doc_id))
        (threshold,) = {r.threshold for r in got if r.lang == lang}
        assert threshold == held[math.ceil(0.99 * len(held)) - 1]
    junk = [r.keep for r in got if r.doc_id % 6 == 0]
    clean = [r.keep for r in got if r.doc_id % 6]
    assert sum(clean) > 0.9 * len(clean) and sum(junk) < 0.5 * len(junk)


def test_chances_sum_to_one(corpus):
    rows, labels = corpus
    trusted = {i for i, q, _ in labels if q == 1}
    slow = SlowModel([t for i, t, _, _ in rows if i in trusted])
    some = sorted(slow.known)[:5]
    for h in [("<s>", "<s>"), (some[0], some[1]), ("<rare>", some[2])]:
        assert sum(slow.p((*h, w)) for w in [*slow.known, "<rare>", "</s>"]) == pytest.approx(1)


def test_table_finds_what_was_put_in():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    values = rng.random((len(keys), 2)).astype(np.float32)
    table = quality.Table(keys, values)
    found, out = table.find(keys)
    assert found.all() and (out == values).all()
    found, out = table.find(rng.integers(0, 1 << 62, 1000) | 1 << 61)
    assert not out[~found].any()
    assert not quality.Table(np.zeros(0, np.int64), np.zeros((0, 1))).find(keys)[0].any()
    sent = pickle.loads(pickle.dumps(table))
    assert sent.find(keys)[0].all() and (sent.find(keys)[1] == values).all()


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards_of_keys_and_of_columns_agree(spark, shards):
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 500)
    rows = spark.createDataFrame([(int(k),) for k in keys], "k long").select(quality._shard(shards)).collect()
    assert [r[0] for r in rows] == quality.shard_of(keys, shards).tolist()


def test_words_are_told_apart_by_their_bytes():
    """Words as ``bytes.lower().split()`` cuts them, of all bytes and lengths, get the same hash if and only if they are the same."""
    rng = random.Random(15)
    texts = [b"", b" \n", bytes(range(256)), b"a\0 a a\0\0 A", bytes(70), b"\x1c\x85\xa0 \x0b\x0c x"]
    texts += [b" ".join(bytes(rng.choice(b"aB\0\xc3") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 40, 200]))) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    words = [text.lower().split() for text in texts]
    hashes, counts = quality._hashed(texts)
    assert counts.tolist() == [len(x) for x in words] and len(hashes) == sum(map(len, words)) and hashes.min() >= 0
    of = defaultdict(set)
    for word, h in zip([w for x in words for w in x], hashes.tolist(), strict=True):
        of[word].add(h)
    assert all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)
    known = np.sort(quality._hashed([b"b c"])[0])
    numbers, starts = quality._numbers([b"", b"C zz b", b""], known)
    b, c = (quality.FIRST + int(np.searchsorted(known, quality._hashed([x])[0][0])) for x in (b"b", b"c"))
    assert numbers.tolist() == [1, 1, 2, 1, 1, c, quality.RARE, b, 2, 1, 1, 2] and starts.tolist() == [0, 3, 9]
    assert quality._numbers([b"b c"], np.zeros(0, np.int64))[0].tolist() == [1, 1, quality.RARE, quality.RARE, 2]


def test_numbering_costs_little_more_than_cutting():
    """Words are numbered without an object each, and without a copy of the table of all words."""
    rng = random.Random(16)
    texts = [prose(rng, 400).encode() for _ in range(500)]
    texts = [b" ".join(w + b"%d" % rng.randint(0, 99) for w in t.split()) for t in texts]
    words = {w for t in texts for w in t.split()}
    known = np.unique(np.random.default_rng(17).integers(0, 1 << 63, len(words)))

    def seconds(run):
        times = []
        for _ in range(7):
            begin = time.process_time()
            run()
            times.append(time.process_time() - begin)
        return min(times)

    assert seconds(lambda: quality._numbers(texts, known)) < 4 * seconds(lambda: [t.lower().split() for t in texts])
    table = np.arange(2_000_000)
    tracemalloc.start()
    quality._numbers([b"a few words"], table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_000_000


@pytest.mark.parametrize("blocks", [1, 40])
def test_blocks_are_looked_up_together(blocks):
    """A shard's blocks in one batch give one batch of sums, a row for each block, whatever their number."""
    pack = quality._pack
    kept = pa.schema([("doc_id", pa.int64())])
    pairs = np.arange(10, 20)
    shard = [pairs, np.full(10, 0.5, "<f4"), np.ones(10, "<i4"), np.full(10, 3, "<i4"), np.full(10, 2.0, "<f4")]
    rows = [dict(zip("abcde", map(pack, shard), strict=True)) | {"shard": 4, "kind": 0}]
    for k in range(blocks):
        block = {"a": np.array([19, 5, 10, 12]), "b": np.array([3, 3, 1, 3], "<i4"), "c": np.array([0, 0, 2, k + 3], "<i4")}
        rows.append({x: pack(v) for x, v in block.items()} | {"shard": 4, "kind": 1, "chunk": k})
    types = {"shard": pa.int32(), "kind": pa.int32(), "chunk": pa.int64(), "key": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "log_p": pa.float64()}
    schema = pa.schema([*types.items(), *((x, pa.binary()) for x in "abcde")])
    out = [b for b in quality._looked_up(kept)(iter([pa.RecordBatch.from_pylist(rows, schema)])) if b.num_rows]
    assert len(out) == 1 and out[0].column("chunk").to_pylist() == list(range(blocks))
    for k, row in enumerate(out[0].to_pylist()):
        assert quality._unpack(row["docs"], "<i4").tolist() == [0, 2, k + 3]
        assert quality._unpack(row["sums"], "<f8").tolist() == [2.5, 0.5, 2.5]


def test_odd_rows(spark, odd_docs, empty_docs, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(crowded(odd_docs), none).collect()
    assert len(rows) == 12 and all(r.threshold is None for r in rows)
    assert {r.doc_id: r.keep for r in rows if r.doc_id in (1, 2, 3, 4, 8)} == {1: False, 2: False, 3: False, 4: True, 8: True}
    assert {r.lang for r in rows if r.doc_id == 3} == {"und"}
    table = spark.createDataFrame([(None, 1, 0), (5, 1, 0), (5, 0, 0), (5, 1, 1), (6, 1, None), (8, None, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd_docs, table).count() == 12
    assert quality.judge(empty_docs, table).count() == 0


def test_a_text_over_the_bound_does_not_push_out_the_others(spark, make_docs):
    """A trusted text longer than all training bytes, first in the order of the choice, changes no model."""
    rng = random.Random(12)
    rows = [(i, prose(rng, 60, lang), lang) for i in range(60) for lang in [("en", "de", "fr")[i % 3]]]
    fold = lambda i: zlib.crc32(str(i).encode()) % 2
    order = spark.range(1000, 3000).select("id", quality.F.xxhash64("id").alias("o")).orderBy("o").collect()
    first = next(r.id for r in order if fold(r.id))
    labels = spark.createDataFrame([(i, 1) for i in [*range(60), first]], "doc_id long, quality int")
    settings = quality.Settings(sample_bytes=50_000)
    docs = rows + [(first, prose(rng, 20_000), "en")]
    without = {r.doc_id: r.perplexity for r in quality.judge(make_docs(rows), labels, settings).collect()}
    got = {r.doc_id: r.perplexity for r in quality.judge(make_docs(docs), labels, settings).collect()}
    assert {i: got[i] for i in without} == pytest.approx(without)


def test_each_language_keeps_its_shortest_and_all_that_fit(spark):
    rows = [(i, "big", 400) for i in range(30)] + [(100 + i, "small", 20) for i in range(7)] + [(200 + i, "huge", 9000 + i) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, n long")
    taken = {lang: sorted(r.doc_id for r in quality.within_bytes(frame, 10_140).collect() if r.lang == lang) for lang in ("big", "small", "huge")}
    assert len(taken["big"]) == 12 and taken["small"] == list(range(100, 107)) and taken["huge"] == list(range(200, 205))
    assert quality.within_bytes(frame, 10**6).count() == len(rows)
    assert quality.within_bytes(frame.limit(0), 100).count() == 0


def test_all_trusted_texts_train(spark, make_docs):
    """More texts than any sample held, in many shards and slices; a repeated row counts once."""
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(3, 12)), "en") for i in range(4000)]
    slow = SlowModel([t for i, t, _ in rows if trains(i)])
    labels = spark.createDataFrame([(i, 1) for i in range(4000)], "doc_id long, quality int")
    got = quality.judge(make_docs(rows + rows[:50]), labels, quality.Settings(shard_rows=2000)).collect()
    assert len(got) == 4050
    texts = {i: t for i, t, _ in rows}
    for r in got[::9]:
        assert r.perplexity == pytest.approx(slow.perplexity(texts[r.doc_id]), rel=1e-4)


@pytest.mark.parametrize("n", [1, 7, 100, 30_000])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(14)
    for draw in (rng.random, lambda: float(rng.randint(1, 3))):
        values = [draw() for _ in range(n)]
        rows = quality.quantiles(spark.createDataFrame([("a", x) for x in values], "lang string, perplexity double"), 0.99).collect()
        assert [(r.lang, r.n, r.threshold) for r in rows] == [("a", n, sorted(values)[math.ceil(0.99 * n) - 1])]
