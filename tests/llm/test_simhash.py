from __future__ import annotations

import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import crowded, prose
from weftline.llm import simhash
from weftline.llm.components import connected_components


def words_of(text: str) -> list[str]:
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for blank in "\t\n\v\f\r":
        raw = raw.replace(blank, " ")
    return [w for w in raw.split(" ") if w]


def slow_simhash(text: str, size: int = 3) -> int:
    """By the definition, bit by bit."""
    words = words_of(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes: list[int], bits: int) -> dict[int, int]:
    """The least code that each code reaches, over all pairs."""
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("text", ["", " ", "one", "Two WORDS", "a b c", "a b c d\te\nf", "Straße über ÄÖÜ A B", "x y z w q", "r " * 50])
def test_fingerprint_matches_the_definition(text):
    assert simhash.simhash(text.encode()) == slow_simhash(text)


def test_fingerprints_of_long_texts_in_chunks(monkeypatch):
    text = prose(random.Random(1), 1000)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.simhash(text.encode()) == slow_simhash(text)


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64(b"a b c", seed=42).intdigest()


def clustered(seed: int) -> list[int]:
    rng = random.Random(seed)
    codes = {0, -1, 1 << 62, -(1 << 63)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            c = centre
            for _ in range(rng.randint(0, 3)):
                c ^= 1 << rng.randrange(64)
            codes.add(c - 2**64 if c >= 2**63 else c)
    return sorted(codes | {rng.getrandbits(63) for _ in range(60)})


def near_groups(texts: dict) -> dict:
    """The least id of each text's group over all pairs, by the definition: eleven bits and a Jaccard similarity of 0.8."""
    root, codes = {i: i for i in texts}, {i: slow_simhash(t, 5) for i, t in texts.items()}
    sets = {}
    for i, t in texts.items():
        words = words_of(t)
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and (sets[i] == sets[j] or (bin(codes[i] ^ codes[j]).count("1") <= 11 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in texts}


@pytest.mark.parametrize(("bits", "segments"), [(2, 3), (2, 5), (2, 7), (2, 9), (1, 2), (1, 7)])
def test_every_near_pair_has_a_chain(spark, bits, segments):
    """For random differences within the budget some start keeps to it, its head is equal, and none beyond the budget passes."""
    rng = random.Random(segments)
    rows = []
    for k in (*range(1, bits + 1), bits + 1):
        for _ in range(200):
            x = sum(1 << b for b in rng.sample(range(64), k))
            rows.append((x - 2**64 if x >= 2**63 else x, k))
    x = F.col("x")
    heads = [simhash._segment(x, *key) == 0 for key in simhash.chain_keys(bits, segments)]
    chains = [simhash._chain(x, i, bits, segments) for i in range(segments)]
    both = [h & c for h, c in zip(heads, chains, strict=True)]
    found = spark.createDataFrame(rows, "x long, k int").select("k", F.array(*both).alias("ok"), F.array(*chains).alias("chain")).collect()
    assert all(any(r.ok) == (r.k <= bits) and r.ok == r.chain for r in found)


@pytest.mark.parametrize(("bits", "crowd"), [(2, 1), (2, 8), (2, 10_000), (2, None), (1, 1), (1, 10_000)])
def test_links_against_all_pairs(spark, bits, crowd):
    """Whatever part of the buckets counts as crowded, the same fingerprints are connected."""
    crowd = crowd or inspect.signature(simhash.links).parameters["crowd"].default
    codes = clustered(bits)
    frame = spark.createDataFrame([(c,) for c in codes], "fp long")
    edges = simhash.links(frame, bits, crowd)
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= bits for r in edges.collect())
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert {c: found.get(c, c) for c in codes} == classes(codes, bits)


def test_links_refuse_other_distances(spark):
    one = spark.createDataFrame([(1,)], "fp long")
    with pytest.raises(ValueError):
        simhash.links(one, 3)
    with pytest.raises(ValueError):
        simhash.wide_classes(one.selectExpr("fp AS node", "fp", "1 AS n"), 12, 0, lambda p: p)


@pytest.mark.parametrize(("bits", "large"), [(3, 64), (5, 10), (8, 10_000), (11, 5), (11, 64)])
def test_wide_classes_against_all_pairs(spark, monkeypatch, bits, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng, codes = random.Random(bits), set()
    for _ in range(5):
        centre = rng.getrandbits(64)
        for _ in range(50):
            c = centre
            for _ in range(rng.randint(0, bits + 3)):
                c ^= 1 << rng.randrange(64)
            codes.add(c - 2**64 if c >= 2**63 else c)
    codes = sorted(codes | {rng.getrandbits(63) for _ in range(60)})
    nodes = spark.createDataFrame([(c, c, 1) for c in codes], "node long, fp long, n long")
    found = {r.node: r.root for r in simhash.wide_classes(nodes, bits, 80, lambda pairs: pairs.distinct()).collect()}
    assert {c: found.get(c, c) for c in codes} == classes(codes, bits)


@pytest.mark.parametrize("bits", [3, 5, 7, 11])
def test_a_pair_is_met_under_one_key(spark, bits):
    """Every pair within the budget is made once, however many segment keys it shares."""
    rng = random.Random(bits)
    codes = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for c in [rng.getrandbits(64) for _ in range(6)] for _ in range(12)})
    rows = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    dealt = simhash._dealt(spark.createDataFrame(rows, "fp long"), simhash._quartered(bits))
    near = "a.key = b.key AND a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= " + str(bits)
    met = dealt.alias("a").join(dealt.alias("b"), F.expr(near) & simhash._met_once(bits)).select("a.fp", "b.fp").collect()
    want = {(a, b) for (a,) in rows for (b,) in rows if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
    assert want and len(met) == len(want) and {tuple(r) for r in met} == want


@pytest.mark.parametrize("seed", range(3))
def test_sketches_and_positions_keep_similar_sets(seed):
    """The bits that differ never exceed the difference of two sets, and similar sets share an early hash of their prefixes."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 400)
    frequency = np.bincount(base & (simhash.FREQUENCIES - 1), minlength=simhash.FREQUENCIES)
    for change in (0, 1, 20, 44, 90, 300):
        other = np.unique(np.concatenate([base[change:], rng.integers(-(1 << 63), (1 << 63) - 1, change)]))
        sets = [np.unique(base), other]
        apart = len(np.setxor1d(*sets))
        bits = np.bitwise_count(simhash.sketch(sets[0]).view(np.uint64) ^ simhash.sketch(sets[1]).view(np.uint64)).sum()
        assert bits <= apart and (apart == 0 or bits > 0)
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["node", "hashes"])
        (out,) = simhash._prefixes(frequency, 80)([batch])
        first, second = (set(h) for h in out.column(1).to_pylist())
        if len(np.intersect1d(*sets)) >= 0.8 * len(np.union1d(*sets)):
            assert first & second


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 400)]
    star = [(5000, 1000 + i) for i in range(300)] + [(1000, 1000), (7, 7)]
    random.Random(3).shuffle(path)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert {found[i] for i in range(100, 401)} == {100}
    assert {found[i] for i in [5000, *range(1000, 1300)]} == {1000} and 7 not in found
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_against_brute_force(spark, make_docs):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(3, 40)) for _ in range(60)]
    for _ in range(60):
        words = rng.choice(texts[:20]).split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(rows)).collect()}
    codes = {i: slow_simhash(t) for i, t in rows}
    reach = classes(sorted(set(codes.values())), 2)
    least = {}
    for i in sorted(codes):
        least.setdefault(reach[codes[i]], i)
    assert {i: r.fp % 2**64 for i, r in got.items()} == codes
    assert {i: r.component_id for i, r in got.items()} == {i: least[reach[codes[i]]] for i in codes}


def test_odd_rows(odd_docs, empty_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_keep_first_leaves_one_row_of_each_class(odd_docs, empty_docs):
    docs = crowded(odd_docs)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [1, 4, 5, 7, 8, 9]
    assert all(r.fp == "x fp" for r in rows)
    assert simhash.keep_first(empty_docs).count() == 0


def copies(seed: int) -> dict:
    """Texts, copies of them with more and more words changed, and a line that many texts share."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(3, 300)) for _ in range(40)]
    for _ in range(120):
        words = rng.choice(texts[:12]).split()
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = prose(rng, 1) + "x"
        texts.append(" ".join(words))
    line = prose(rng, 30)
    texts += [f"{line} {prose(rng, rng.randint(1, 12))}" for _ in range(30)] + [f"{prose(rng, 60)} {line}" for _ in range(30)]
    return dict(enumerate(texts))


@pytest.mark.parametrize(("seed", "large", "sent"), [(1, 64, 1 << 20), (2, 3, 0), (3, 10_000, 1 << 20)])
def test_kept_documents_against_all_pairs(make_docs, monkeypatch, seed, large, sent):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "SENT", sent)
    texts = copies(seed)
    kept = simhash.keep_first(make_docs(list(texts.items()))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(near_groups(texts).values()))


@pytest.mark.parametrize("large", [4, 64])
def test_a_crowd_of_texts_that_are_close_but_not_similar(make_docs, monkeypatch, large):
    """Many variants of one text, most of them below the similarity, are not compared in full, and no link is lost."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(21)
    base, texts = prose(rng, 60).split(), {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(60)] = f"v{rng.randrange(40)}"
        texts[i] = " ".join(words)
    kept = simhash.keep_first(make_docs(list(texts.items()))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(near_groups(texts).values()))


def test_planted_near_copies_are_dropped(make_docs):
    """Of copies with a similarity of 0.85 or more nearly all are found; copies below 0.8 all stay."""
    rng = random.Random(11)
    rows, near, far = [], set(), set()
    for i in range(60):
        words = prose(rng, 300).split()
        a, b = list(words), list(words)
        for k in range(rng.randint(1, 4)):
            a[60 * k + 20] = f"changed{i}"
        for k in range(12):
            b[25 * k + 12] = f"other{i}"
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(a)), (3 * i + 2, " ".join(b))]
        near.add(3 * i + 1)
        far |= {3 * i, 3 * i + 2}
    kept = {r.doc_id for r in simhash.keep_first(make_docs(rows)).collect()}
    assert far <= kept and len(near - kept) >= 0.95 * len(near)


def test_a_large_group_is_linked_without_all_pairs(spark, make_docs):
    """A group larger than any bucket that is compared pair by pair."""
    base = prose(random.Random(4), 400).split()
    rows = [(i, " ".join([*base, str(i)])) for i in range(150)] + [(500 + i, " ".join(base)) for i in range(100)]
    rows.append((999, prose(random.Random(9), 50)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(make_docs(rows), crowd=4).collect()}
    codes = {i: slow_simhash(t) for i, t in rows}
    reach = classes(sorted(set(codes.values())), 2)
    least = {}
    for i in sorted(codes):
        least.setdefault(reach[codes[i]], i)
    assert got == {i: least[reach[codes[i]]] for i in codes}


def test_prefixes_take_one_row_a_node_until_they_are_keys(spark, make_docs):
    """Joins by node are made before the prefixes' hashes are dealt: a crowd of long texts makes no more rows there than texts."""
    rng = random.Random(21)
    base = prose(rng, 300).split()
    docs = make_docs([(i, " ".join([*base[:-1], f"end{i}"])) for i in range(40)])
    marked = simhash.stored(simhash.fingerprints(docs, 5, 42, sets=True))
    rows = simhash._Jaccard(docs, marked, 5, 80, 42).prefixes(marked.select("node").distinct()).collect()
    sizes = {r.node: r.n for r in marked.collect()}
    assert len(rows) == len(sizes) == 40
    assert all(len(r.hs) == sizes[r.node] - -(-80 * sizes[r.node] // 100) + 1 for r in rows)
