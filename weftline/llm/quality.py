"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model is kept in back-off form: the log probability of a token is a sum of terms that are looked up by one gram each.
So the grams of the model and those of the texts are dealt in shards by a hash, in packed blocks, each shard is joined in one
task, and the terms found are added up by document.  No task holds more grams than one shard; words alone are sent to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from weftline.llm.common import bounded_sample, chunks, crc_mod, dropped, released, stored, text_bytes, tidied

#: Bits of a word's number: two make up a pair's key.
WORD = 31
LAST = (1 << WORD) - 1
#: The shift by which keys are folded to tell their shard.
BITS = 21
BEGIN, END, RARE = 1, 2, 3
#: Words seen twice or more in training get a number of their own.
FIRST = 4


@dataclass(frozen=True)
class Settings:
    per_language: int | None = None  #: training documents of a language at most, if they are to be bounded
    sample: int | None = None  #: training documents in all (five of each language at least), likewise
    folds: int = 2  #: trusted documents with ``crc32(doc_id) mod folds`` 0 are held out for the thresholds
    sample_bytes: int | None = None  #: bytes of training text in all, whole documents, likewise (see :func:`within_bytes`)
    shard_rows: int = 1 << 18  #: tokens of training text whose grams make up a shard, about
    slices: int = 8  #: parts in which the texts are scored, if there are as many shards
    quantile: float = 0.99  #: of the perplexities of trusted documents held out from training
    enough: int = 20  #: held-out documents that a language needs for a threshold of its own


class Table:
    """A fixed table from 64-bit keys to values, probed for many keys at once.

    It is sent without its empty slots and laid out again by the process that gets it.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.__setstate__((keys, values))

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        full = self.keys >= 0
        return self.keys[full], self.values[full]

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        keys, values = state
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.6))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros((1 << self.bits, values.shape[1]), np.float32)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[at[placed]] = keys[left[placed]]
            self.values[at[placed]] = values[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (zeros for others)."""
        out, found = np.zeros((len(keys), self.values.shape[1]), np.float32), np.zeros(len(keys), bool)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            found[left[hit]] = True
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return found, out


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64 bits of each number, each made to depend on all others (the last steps of MurmurHash3)."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


#: Words of more bytes are hashed one by one.
LONG = 32
_SEEDS = _mixed(np.arange(1, LONG + 3, dtype=np.uint64))
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """63 bits that stand for each word of the texts in a row, and how many words each text has.

    All words are cut and hashed together, eight bytes at a time.  Among 20 million words the odds that two have the same bits
    are about 1 to 50,000.
    """
    joined = b"\n".join([b"", *texts, bytes(8)]).lower()
    data = np.frombuffer(joined, np.uint8)[:-8]
    space = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    at, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    own = _SEEDS[np.minimum(length, LONG + 1)]
    for k in range(0, LONG, 8):
        on = np.flatnonzero(length > k)
        own[on] = _mixed(own[on] ^ (eight[at[on] + k] & _BYTES[np.minimum(length[on] - k, 8)]))
    for i in np.flatnonzero(length > LONG).tolist():
        own[i] = xxh64_intdigest(joined[at[i] : at[i] + length[i]])
    counts = np.diff(np.searchsorted(at, np.cumsum([1, *(len(t) + 1 for t in texts)])))
    return (own >> np.uint64(1)).astype(np.int64), counts


def _numbers(texts: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts' words in a row, each text between two BEGINs and an END, and where texts start.

    A word's number is the place of its hash in ``hashes``, from ``FIRST`` on.
    """
    words, counts = _hashed(texts)
    distinct, place = np.unique(words, return_inverse=True)
    at = np.searchsorted(hashes, distinct)
    there = hashes[np.minimum(at, len(hashes) - 1)] == distinct if len(hashes) else np.zeros(len(distinct), bool)
    starts = np.cumsum(counts + 3) - counts - 3
    numbers = np.full(len(words) + 3 * len(texts), BEGIN, np.int64)
    numbers[np.arange(len(words)) + np.repeat(3 * np.arange(len(texts)) + 2, counts)] = np.where(there, FIRST + at, RARE)[place]
    numbers[starts + counts + 2] = END
    return numbers, starts


def _grams(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens to predict, and the bigram key that ends at each position."""
    pairs = np.concatenate(([0], (numbers[:-1] << WORD) | numbers[1:]))
    predicted = np.ones(len(numbers), bool)
    predicted[starts] = False
    predicted[starts + 1] = False
    return np.flatnonzero(predicted), pairs


def _pack(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones: high bytes are mostly alike, so that they compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _blocks(shards: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each shard: its number, and its entries of each column, packed."""
    # Numbers of 16 bits are sorted by their digits, others by comparison.
    order = np.argsort(shards.astype(np.uint16 if shards.max(initial=0) < 1 << 16 else np.int32), kind="stable")
    first = _firsts(shards[order])
    names = shards[order][first]
    parts = [order[a:b] for a, b in zip(first, [*first[1:], len(order)], strict=True)]
    packed = [pa.array([_pack(v[x]) for x in parts], pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *packed], ["shard", *columns])


def _gathered(blocks: DataFrame, shards: int, *order: str) -> DataFrame:
    """All blocks of a shard in one task, one after another."""
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard", *order)


def _by_shard(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The whole columns of each shard, from blocks in the order of shards."""
    rows = ((batch.column("shard")[i].as_py(), [_unpack(batch.column(c)[i].as_buffer(), k) for c, k in kinds.items()]) for batch in batches for i in range(batch.num_rows))
    for shard, group in groupby(rows, key=itemgetter(0)):
        yield shard, [np.concatenate(x) for x in zip(*(parts for _, parts in group), strict=True)]
        released()


def _row(shard: int, columns: list[np.ndarray], counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One shard's columns, packed, and how many of its ``counts`` are 1, 2, 3 and 4."""
    of = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
    values = [pa.array([shard], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in columns), *(pa.array([n], pa.int64()) for n in of)]
    return pa.RecordBatch.from_arrays(values, ["shard", *names, "n1", "n2", "n3", "n4"])


_OF = "n1 long, n2 long, n3 long, n4 long"
_TRIGRAMS = {"uv": "<i8", "w": "<i4", "c": "<i8"}
#: A trigram in the shard of its last two words; with 0 as its first word it stands for the pair as a context.
_ENTRIES = {"vw": "<i8", "u": "<i4", "alpha": "<f4", "gamma": "<f4"}


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _merged(uv: np.ndarray, w: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The different trigrams in order, with their counts added up."""
    order = np.lexsort((w, uv))
    uv, w, c = uv[order], w[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], (uv[1:] != uv[:-1]) | (w[1:] != w[:-1]))))
    return [uv[first], w[first], np.add.reduceat(c, first)]


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(seen: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c, pa.int64())], ["h", "c"])

    none = np.zeros(0, np.int64)
    seen = [none]
    for batch in batches:
        for texts in chunks(t.as_py() for t in batch.column(0)):
            seen.append(_hashed(texts)[0])
            if sum(map(len, seen)) > 1 << 21:
                yield found(seen)
                seen = [none]
    yield found(seen)


def _counted_trigrams(sent, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks((t.as_py() for t in batch.column(0))):
                numbers, starts = _numbers(texts, sent.value)
                at, pairs = _grams(numbers, starts)
                uv, w, c = _merged(pairs[at - 1], numbers[at].astype("<i4"), np.ones(len(at), np.int64))
                yield _blocks(shard_of(uv, shards), {"uv": uv, "w": w, "c": c})
            released()

    return run


def _merged_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, columns in _by_shard(batches, _TRIGRAMS):
        merged = _merged(*columns)
        yield _row(shard, merged, merged[2], list(_TRIGRAMS))


def _entries(d: np.ndarray, shards: int):
    """Each trigram with its discounted share of its context and what the context leaves, dealt by its last two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (uv, w, c) in _by_shard(batches, _TRIGRAMS):
            cut = d[np.minimum(c, 3) - 1]
            first = _firsts(uv)
            t = np.add.reduceat(c, first)
            left = (np.add.reduceat(cut, first) / t).astype("<f4")
            context = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(uv))))
            vw = ((uv & LAST) << WORD) | w
            yield _blocks(shard_of(vw, shards), {"vw": vw, "u": (uv >> WORD).astype("<i4"), "alpha": ((c - cut) / t[context]).astype("<f4"), "gamma": left[context]})
            yield _blocks(np.full(len(first), shard), {"vw": uv[first], "u": np.zeros(len(first), "<i4"), "alpha": np.zeros(len(first), "<f4"), "gamma": left})

    return run


def _ordered_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, columns in _by_shard(batches, _ENTRIES):
        order = np.lexsort((columns[1], columns[0]))
        columns = [x[order] for x in columns]
        yield _row(shard, columns, _before(*columns[:2])[1], list(_ENTRIES))


def _before(vw: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of ordered entries, and before how many words each was seen."""
    first = _firsts(vw)
    return vw[first], np.add.reduceat((u > 0).astype(np.int64), first) if len(first) else first


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, one, two, more, t, before)``: sums over the pairs that a word begins, and the number of those that it ends."""
    for _, (vw, u) in _by_shard(batches, {"vw": "<i8", "u": "<i4"}):
        pairs, n = _before(vw, u)
        pairs, n = pairs[n > 0], n[n > 0]
        v = pairs >> WORD
        first = _firsts(v)
        w, before = np.unique(pairs & LAST, return_counts=True)
        sums = [np.add.reduceat(x.astype(np.int64), first) if len(first) else first for x in (n == 1, n == 2, n > 2, n)]
        none = np.zeros(len(w), np.int64)
        columns = [np.append(v[first], w), *(np.append(x, none) for x in sums), np.append(np.zeros(len(first), np.int64), before)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["word", "one", "two", "more", "t", "before"])


def _gains(sent, d: np.ndarray):
    """The terms: what a pair adds as a bigram and as the context of the next token, and what each trigram on it adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p1, gamma2, t2 = sent.value
        for shard, (vw, u, alpha, gamma) in _by_shard(batches, _ENTRIES):
            pairs, n = _before(vw, u)
            v, w = pairs >> WORD, pairs & LAST
            lower = gamma2[v] * p1[w]
            p2 = np.where(n > 0, (n - d[np.clip(n, 1, 3) - 1]) / np.maximum(t2[v], 1), 0.0) + lower
            both = np.where(n > 0, np.log(p2 / lower), 0.0)
            pair = np.repeat(np.arange(len(pairs)), np.diff(np.append(_firsts(vw), len(vw))))
            context, own = np.flatnonzero(u == 0), np.flatnonzero(u > 0)
            both[pair[context]] += np.log(gamma[context].astype(float))
            lower = gamma[own] * p2[pair[own]]
            gain = np.log((alpha[own] + lower) / lower)
            packed = [pairs, both.astype("<f4"), n.astype("<i4"), u[own], gain.astype("<f4")]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([_pack(x)], pa.binary()) for x in packed)], ["shard", *"abcde"])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """The modified Kneser-Ney discounts of counts 1, 2 and 3 or more, given how many counts are 1 to 4 (Chen and Goodman, 1998)."""
    y = n[0] / max(1, n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / max(1, n[k - 1]) for k in (1, 2, 3)]
    return np.array([min(max(d, 0.1), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)])


def _discounts(rows: DataFrame) -> np.ndarray:
    return discounts([x or 0 for x in rows.agg(*[F.sum(f"n{k}") for k in range(1, 5)]).first()])


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  #: of the words with a number, in order from ``FIRST``
    rare: int  #: words seen once in training: what the chance of a word without number is split among
    unigrams: np.ndarray  #: log probability, and log of what the context leaves, by number
    shards: int  #: of the table of pairs and trigrams, dealt by the trigram's last two words
    terms: DataFrame  #: ``(shard, a, b, c, d, e)``, packed: pairs, their terms, how many words stand before each, these words and their terms


def train(texts: DataFrame, settings: Settings = Settings(), spent: tuple[DataFrame, ...] = ()) -> Model:
    """Count all trigrams of ``texts(b)`` and work out the model's terms, shard by shard.

    Highest-order counts are occurrences, lower ones the numbers of different words before.  Every
    order is interpolated with the next, the last with equal chances for all words.  Words alone are
    gathered on the driver; trigrams are dealt twice, by their first two words and by their last two.
    The stored tables ``spent`` are deleted once the trigrams are counted.
    """
    context = texts.sparkSession.sparkContext
    counts = stored(texts.select("b").mapInArrow(_counted_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    rare, tokens = counts.agg(F.count(F.when(F.col("c") == 1, 1)), F.sum("c")).first()
    hashes = np.sort(counts.where("c > 1").select("h").toArrow()["h"].to_numpy())
    size = FIRST + len(hashes)
    shards = max(1, -(-(tokens or 0) // settings.shard_rows))

    binary = lambda names: ", ".join(f"{c} binary" for c in names)
    found = texts.select("b").mapInArrow(_counted_trigrams(context.broadcast(hashes), shards), f"shard int, {binary(_TRIGRAMS)}")
    tri = stored(_gathered(found, shards).mapInArrow(_merged_trigrams, f"shard int, {binary(_TRIGRAMS)}, {_OF}"))
    del found
    dropped(counts, *spent)
    _cleared(texts.sparkSession)
    found = tri.drop("n1", "n2", "n3", "n4").mapInArrow(_entries(_discounts(tri), shards), f"shard int, {binary(_ENTRIES)}")
    entries = stored(_gathered(found, shards).mapInArrow(_ordered_entries, f"shard int, {binary(_ENTRIES)}, {_OF}"))
    del found
    dropped(tri)
    _cleared(texts.sparkSession)

    columns = ["one", "two", "more", "t", "before"]
    by_word = entries.select("shard", "vw", "u").mapInArrow(_counted_pairs, "word long, one long, two long, more long, t long, before long")
    by_word = by_word.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    one, two, more, t2, before = np.zeros((5, size), np.int64)
    for c, x in zip(columns, (one, two, more, t2, before), strict=True):
        x[by_word["word"].to_numpy()] = by_word[c].to_numpy()
    d2 = _discounts(entries)
    gamma2 = np.where(t2 > 0, np.stack([one, two, more], axis=1) @ d2 / np.maximum(t2, 1), 1.0)
    d1 = discounts([int((before == k).sum()) for k in range(1, 5)])
    cut = np.where(before > 0, d1[np.clip(before, 1, 3) - 1], 0.0)
    # END, RARE and the words can come next; BEGIN can't.
    p1 = (before - cut) / max(1, before.sum()) + (cut.sum() / before.sum() if before.any() else 1.0) / (size - END)
    p1[:END] = 1.0
    terms = stored(entries.drop("n1", "n2", "n3", "n4").mapInArrow(_gains(context.broadcast((p1, gamma2, t2)), d2), f"shard int, {binary('abcde')}"))
    dropped(entries)
    _cleared(texts.sparkSession)
    return Model(hashes, max(1, rare), np.log(np.stack([p1, gamma2], axis=1)).astype(np.float32), shards, terms)


def _numbered(sent, kept: pa.Schema, shards: int):
    """Texts (kind 2) with their length and the part of their log probability that takes no gram; their trigrams in blocks (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rare, unigrams = sent.value
        key = (TaskContext.get().partitionId() + 1) << 40
        names = ["shard", "kind", "chunk", "key", *kept.names, "n_tokens", "log_p", *"abcde"]
        for batch in batches:
            at = 0
            for texts in chunks((t.as_py() for t in batch.column(len(kept)))):
                n = len(texts)
                numbers, starts = _numbers(texts, hashes)
                positions, pairs = _grams(numbers, starts)
                logs = np.zeros(len(numbers))
                logs[positions] = unigrams[numbers[positions], 0] + unigrams[numbers[positions - 1], 1].astype(float)
                logs[numbers == RARE] -= np.log(rare)
                lengths = np.diff(np.append(starts, len(numbers)))
                keys = np.arange(key, key + n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((keys % shards).astype(np.int32)), pa.array(np.full(n, 2, np.int32)), pa.array(np.full(n, key)), pa.array(keys), *(batch.column(i).slice(at, n) for i in range(len(kept))),
                        pa.array(lengths - 3), pa.array(np.add.reduceat(logs, starts)), *[pa.nulls(n, pa.binary())] * 5,
                    ],
                    names,
                )
                # Each pair with the word before it, 0 for the two BEGINs: a term for the pair, and one for the three words.
                at_pairs = np.delete(np.arange(len(numbers)), starts)
                before = np.where(numbers[at_pairs] == BEGIN, 0, pairs[at_pairs - 1] >> WORD).astype("<i4")
                vw, doc = pairs[at_pairs], np.repeat(np.arange(n, dtype="<i4"), lengths - 1)
                found = _blocks(shard_of(vw, shards), {"a": vw, "b": before, "c": doc})
                m = found.num_rows
                none = [pa.nulls(m, f.type) for f in (pa.field("key", pa.int64()), *kept, pa.field("n", pa.int64()), pa.field("p", pa.float64()))]
                columns = [found.column(0), pa.array(np.ones(m, np.int32)), pa.array(np.full(m, key)), *none, *found.columns[1:], *[pa.nulls(m, pa.binary())] * 2]
                yield pa.RecordBatch.from_arrays(columns, names)
                key += n
                at += n
            released()

    return run


class _Shard:
    """One shard of the model's terms."""

    def __init__(self, pairs: np.ndarray, both: np.ndarray, n: np.ndarray, before: np.ndarray, gains: np.ndarray):
        self.pairs, self.both = pairs, both
        self.trigrams, self.gains = np.append((np.repeat(np.arange(len(pairs)), n) << WORD) | before, -1), np.append(gains, 0)

    def terms(self, vw: np.ndarray, u: np.ndarray) -> np.ndarray:
        """What each pair, and the trigram of ``u`` and the pair, add; searched in order, so that near ones follow each other."""
        order = np.argsort(vw)
        vw, u = vw[order], u[order]
        at = np.minimum(np.searchsorted(self.pairs, vw), len(self.pairs) - 1)
        there = np.flatnonzero(self.pairs[at] == vw)
        at = at[there]
        keys = (at << WORD) | u[there]
        own = np.searchsorted(self.trigrams[:-1], keys)
        out = np.zeros(len(vw))
        out[order[there]] = self.both[at].astype(float) + np.where(self.trigrams[own] == keys, self.gains[own], 0.0)
        return out


def _looked_up(kept: pa.Schema):
    """The rows of texts as they are, and for each block the sums of its texts' terms in the shard, which comes first."""
    kinds = ({"a": "<i8", "b": "<f4", "c": "<i4", "d": "<i4", "e": "<f4"}, {"a": "<i8", "b": "<i4", "c": "<i4"})
    names = ["chunk", "key", *kept.names, "n_tokens", "log_p", "docs", "sums"]

    def added_up(batch: pa.RecordBatch, rows: list[int], blocks: list[list[np.ndarray]], held: _Shard) -> pa.RecordBatch:
        """Blocks of the shard are looked up together: with many shards each is short."""
        vw, u, docs = (np.concatenate(x) for x in zip(*blocks, strict=True))
        of = np.repeat(np.arange(len(blocks)), [len(x) for x, _, _ in blocks])
        first = _firsts((of << 32) | docs)
        sums, docs, cuts = np.add.reduceat(held.terms(vw, u), first), docs[first], np.flatnonzero(np.diff(of[first])) + 1
        none = [pa.nulls(len(rows), f.type) for f in (pa.field("key", pa.int64()), *kept, pa.field("n", pa.int64()), pa.field("p", pa.float64()))]
        packed = [pa.array(list(map(_pack, np.split(x, cuts))), pa.binary()) for x in (docs, sums)]
        return pa.RecordBatch.from_arrays([batch.column("chunk").take(pa.array(rows)), *none, *packed], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            kind, shards = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            texts = batch.select(names[:-2]).filter(pa.array(kind == 2))
            yield pa.RecordBatch.from_arrays([*texts.columns, *[pa.nulls(texts.num_rows, pa.binary())] * 2], names)
            rows, blocks, size = [], [], 0
            for i in np.flatnonzero(kind < 2).tolist():
                columns = [_unpack(batch.column(x)[i].as_buffer(), k) for x, k in kinds[kind[i]].items()]
                if rows and (shards[i] != shard or size >= 1 << 18):
                    yield added_up(batch, rows, blocks, held)
                    rows, blocks, size = [], [], 0
                if kind[i] == 0:
                    shard, held = shards[i], _Shard(*columns)
                elif shards[i] == shard:
                    rows.append(i)
                    blocks.append(columns)
                    size += len(columns[0])
            if rows:
                yield added_up(batch, rows, blocks, held)
        released()

    return run


def _added(kept: pa.Schema):
    """The texts of each chunk with the sums that come before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*kept.names, "n_tokens", "log_p"]
        chunk, total = None, np.zeros(0)
        for batch in batches:
            of = batch.column("chunk").to_numpy()
            first = _firsts(of).tolist()
            for a, b in zip(first, [*first[1:], len(of)], strict=True):
                if of[a] != chunk:
                    chunk, total = of[a], np.zeros(0)
                rows = batch.slice(a, b - a)
                sums = rows.num_rows - rows.column("docs").null_count
                if sums:
                    docs, own = (np.concatenate([_unpack(x.as_buffer(), k) for x in rows.column(c).slice(0, sums)]) for c, k in (("docs", "<i4"), ("sums", "<f8")))
                    more = np.bincount(docs, weights=own, minlength=len(total))
                    more[: len(total)] += total
                    total = more
                if sums < rows.num_rows:
                    texts = rows.slice(sums)
                    at = texts.column("key").to_numpy() - chunk
                    # Every text has a sum, were it 0, unless the model has no shard for it.
                    log_p = texts.column("log_p").to_numpy() + np.append(total, 0.0)[np.minimum(at, len(total))]
                    yield pa.RecordBatch.from_arrays([*texts.select(names[:-1]).columns, pa.array(log_p)], names)

    return run


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; the same as :func:`_shard` for columns."""
    return (keys ^ (keys >> BITS) ^ (keys >> 2 * BITS)) % shards


def _shard(shards: int) -> Column:
    return F.expr(f"(k ^ shiftright(k, {BITS}) ^ shiftright(k, {2 * BITS})) % {shards}")


def _cleared(spark: SparkSession) -> None:
    """:func:`tidied`, also of the last finished query: Spark lets go of it when another one ends."""
    spark.range(1).count()
    tidied(spark)


def log_probabilities(texts: DataFrame, model: Model, kept: list[str], settings: Settings = Settings()) -> DataFrame:
    """``kept`` columns of ``texts(.., b)`` with ``n_tokens`` and ``log_p``, the log probability of the words and the end.

    A large corpus goes in ``slices`` parts, the first of ``kept`` telling which, so that the disk holds the trigrams of one part only.
    """
    sent = texts.sparkSession.sparkContext.broadcast((model.hashes, model.rare, model.unigrams))
    outer = texts.select(*kept).schema
    inner = to_arrow_schema(outer)
    text = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in outer.fields)
    binary = ", ".join(f"{c} binary" for c in "abcde")
    slices, found = min(settings.slices, model.shards), []
    for k in range(slices):
        part = texts.where(F.pmod(F.xxhash64(kept[0]), F.lit(slices)) == k) if slices > 1 else texts
        blocks = part.select(*kept, "b").mapInArrow(_numbered(sent, inner, model.shards), f"shard int, kind int, chunk long, key long, {text}n_tokens long, log_p double, {binary}")
        blocks = blocks.unionByName(model.terms.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        rows = _gathered(blocks, model.shards, "kind").mapInArrow(_looked_up(inner), f"chunk long, key long, {text}n_tokens long, log_p double, docs binary, sums binary")
        rows = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("docs").isNull())
        found.append(stored(rows.mapInArrow(_added(inner), f"{text}n_tokens long, log_p double")))
        del blocks, rows
        _cleared(texts.sparkSession)
    return reduce(DataFrame.unionAll, found)


def within_bytes(rows: DataFrame, most: int, least: int = 5) -> DataFrame:
    """``(doc_id, lang)`` of those ``rows(doc_id, lang, n)`` that fit in ``most`` bytes in all.

    Languages share the bytes evenly; what a small one leaves goes to the others.  Each gets its ``least`` shortest texts,
    whatever their size, and of the others, by a hash of the id, every one that still fits its share.
    """
    sizes = np.sort(rows.groupBy("lang").agg(F.sum("n").alias("n")).toArrow()["n"].to_numpy())  # one for each language
    share, before = most, 0
    for i, size in enumerate(sizes.tolist()):
        share = (most - before) // (len(sizes) - i)
        if size > share:
            break
        share, before = size, before + size
    kind = rows.schema["doc_id"].dataType.simpleString()
    by_lang = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("doc_id").alias("o"), "doc_id"))).alias("all"))
    first = F.slice("all", 1, least)
    others = F.array_sort(F.transform(F.slice("all", least + 1, 1 << 30), lambda x: F.struct(x["o"].alias("o"), x["doc_id"].alias("doc_id"), x["n"].alias("n"))))
    state = lambda so_far, ids: F.struct(so_far.alias("so_far"), ids.cast(f"array<{kind}>").alias("ids"))
    begin = state(F.aggregate(first, F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.transform(first, lambda x: x["doc_id"]))
    add = lambda a, x: F.when(a["so_far"] + x["n"] <= share, state(a["so_far"] + x["n"], F.concat(a["ids"], F.array(x["doc_id"])))).otherwise(a)
    return by_lang.select("lang", F.explode(F.aggregate(others, begin, add)["ids"]).alias("doc_id")).select("doc_id", "lang")


def _once(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, lang, b)`` without repeated rows; only those whose id is repeated are compared."""
    again = stored(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return texts
    return texts.join(again, "doc_id", "left_anti").unionAll(texts.join(again, "doc_id", "left_semi").distinct())


def _bounded(texts: DataFrame, settings: Settings) -> DataFrame:
    """All ``texts(doc_id, lang, b)``, or those within the bounds that the settings give."""
    if settings.per_language or settings.sample:
        most, total = (x or 1 << 31 for x in (settings.per_language, settings.sample))
        texts = texts.join(bounded_sample(texts.select("doc_id", "lang"), "lang", most, total), ["doc_id", "lang"], "left_semi")
    if settings.sample_bytes:
        taken = within_bytes(texts.select("doc_id", "lang", F.length("b").cast("long").alias("n")), settings.sample_bytes)
        texts = texts.join(taken, ["doc_id", "lang"], "left_semi")
    return texts


def quantiles(values: DataFrame, q: float) -> DataFrame:
    """``(lang, n, threshold)``: the least of the ``n`` perplexities of a language that has a share ``q`` at or below it.

    Approximate quantiles on either side bound it; only the values between them are ranked, so it is exact.
    """
    near = lambda x: F.percentile_approx("perplexity", min(max(x, 0.0), 1.0), 10_000)
    bounds = stored(values.groupBy("lang").agg(near(q - 2e-3).alias("lo"), near(q + 2e-3).alias("hi"), F.count(F.lit(1)).alias("n")))
    told = values.join(bounds, "lang").where("perplexity <= hi")
    # Equal values are one row; those below the bounds are one row in all.
    told = told.groupBy("lang", "n", F.greatest("perplexity", "lo").alias("threshold")).agg(F.count(F.lit(1)).alias("m"))
    up_to = F.sum("m").over(Window.partitionBy("lang").orderBy("threshold"))
    reached = told.withColumn("up_to", up_to).where(F.col("up_to") >= F.ceil(F.lit(q) * F.col("n")))
    return reached.groupBy("lang", "n").agg(F.min("threshold").alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, lang, n_tokens, perplexity, threshold, keep)``, one row for each row of ``docs(doc_id, text, lang)``.

    Trusted documents are those with ``quality`` 1 in ``labels(doc_id, quality)``.  One fold of them is held
    out; all the rest train the model, repeated rows once.  The perplexities of all held-out ones give the thresholds: for each language the
    ``quantile`` of its own, or of all languages together if it has fewer than ``enough``.  A document is
    kept if its perplexity is at most its language's threshold.  Perplexity is per word, the text's end
    counting as one; words are lower-cased (A-Z) runs without ASCII white space.

    Texts without words (null too) have no perplexity and aren't kept.  A null lang is a language of its
    own, ``und``.  Without any held-out trusted document there is no threshold and all texts with
    words are kept.  Labels with null ids count for nothing; repeated labels count once, a document
    labelled both ways as trusted.  Repeated documents give repeated rows; other columns are ignored.
    """
    named = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes().alias("b"))
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held_out = crc_mod("doc_id", settings.folds) == 0
    texts = stored(_once(named.where(~held_out).join(trusted, "doc_id", "left_semi")))
    _cleared(docs.sparkSession)
    model = train(_bounded(texts, settings).select("b"), settings, (texts,))

    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_p") / (F.col("n_tokens") + 1)))
    scored = log_probabilities(named, model, ["doc_id", "lang"], settings).select("doc_id", "lang", "n_tokens", perplexity.alias("perplexity"))
    held = scored.where(F.col("perplexity").isNotNull() & held_out).join(trusted, "doc_id", "left_semi")
    held = stored(held.select("lang", "perplexity"))
    overall = quantiles(held.withColumn("lang", F.lit("")), settings.quantile).first()
    overall = overall["threshold"] if overall else None
    own = quantiles(held, settings.quantile).where(F.col("n") >= settings.enough).select("lang", "threshold")
    fallback = F.lit(overall).cast("double")
    # One row for each language with enough documents: sent while they are few, else an ordinary join.
    own = stored(own)
    placed = scored.join(F.broadcast(own) if own.count() <= 10_000 else own, "lang", "left").withColumn("threshold", F.coalesce("threshold", fallback))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return placed.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", keep.alias("keep"))
