"""SimHash near-duplicate groups, candidates pruned by pigeonring chains.

Small budgets (one or two bits of 64) are sought by chains of whole segments that must be equal.  Wider ones, up to
``WIDEST`` bits, are for texts that are similar rather than almost equal: four segments, the first of a chain within two
bits, and every pair that passes the full Hamming check can be verified by the Jaccard similarity of its shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from weftline.llm.common import Guarded, checkpointed, chunks, dropped, released, stored, text_bytes, tidied
from weftline.llm.components import connected_components

BITS = 64
#: Shingles hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 16
#: Segments of the ring for small budgets: with two bits, chains start with three equal segments, 27 bits.
SEGMENTS = 7
#: The widest budget, and the segments of its ring.
WIDEST, QUARTERS = 11, 4
#: Close ones of a fingerprint from which it is crowded.
LARGE = 64
#: Classes of shingles whose frequencies order the prefixes, and longs of a sketch.
FREQUENCIES, SKETCH = 1 << 16, 8
#: Rows that are sent to all tasks at most (two longs each); beyond that, tables are joined by shuffles.
SENT = 1 << 20


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, ``CHUNK`` at a time."""
    found = text.lower().split()
    if not found:
        return
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[min(words, len(found)) - 1 :]
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(at + CHUNK, n)].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pairs], dtype="<u8")


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if set in over half the shingle hashes.

    Words are maximal runs without ASCII white space, A-Z lower-cased; shingles of
    ``words`` words are joined by one space and counted with repeats.  A text of fewer
    words is one shingle; a text without words has fingerprint zero.
    """
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        n += len(hashes)
        ones += _ones(hashes)
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def _signed(codes: list[int]) -> pa.Array:
    return pa.array(np.array(codes, dtype=np.uint64).view(np.int64), pa.int64())


def fingerprint(text: bytes, words: int = 5, seed: int = 42) -> tuple[int, np.ndarray]:
    """The fingerprint as in :func:`simhash`, and the sorted distinct shingle hashes, from one pass over the shingles."""
    ones, n, found = np.zeros(BITS, np.int64), 0, []
    for hashes in shingle_hashes(text, words, seed):
        n += len(hashes)
        ones += _ones(hashes)
        found.append(np.unique(hashes))
    distinct = np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, "<u8")
    return _majority(ones, n), distinct.view(np.int64)


def _set_key(hashes: np.ndarray, seed: int) -> int:
    return xxh64_intdigest(hashes.tobytes(), seed)


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int, sets: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if sets:
            codes, keys, sizes = [], [], []
            for text in batch.column(2):
                code, distinct = fingerprint(text.as_py(), words, seed)
                codes.append(code)
                keys.append(_set_key(distinct, seed))
                sizes.append(len(distinct))
            found = [_signed(codes), _signed(keys), pa.array(sizes, pa.int64())]
        else:
            found = [_signed([simhash(t.as_py(), words, seed) for t in batch.column(2)])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], ["doc_id", "th", "fp", "node", "n"][: 2 + len(found)])
        released()


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, sets: bool = False) -> DataFrame:
    """``(doc_id, th, fp)``, one row for each row of ``docs``.

    ``fp`` is the fingerprint as a signed long, ``th`` a hash that tells the text of rows with one id.  With ``sets`` also
    ``node``, a hash of the set of shingles, and ``n``, its size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), text_bytes().alias("b")).mapInArrow(
        partial(_fingerprints, words=words, seed=seed, sets=sets), f"doc_id {kind}, th long, fp long{', node long, n long' * sets}"
    )


def ring(segments: int) -> list[tuple[int, int]]:
    """``segments`` segments (shift, width) that make up the 64 bits."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    """``width`` bits of the ring from ``shift`` on."""
    found = F.shiftrightunsigned(fp, shift)
    if shift + width > BITS:
        found = found.bitwiseOR(F.shiftleft(fp, BITS - shift))
    return found.bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else found


def _chain(x: Column, start: int, max_bits: int, segments: int) -> Column:
    """Whether the differing bits ``x`` stay within the proportional budget along the chain from ``start``.

    After l of the m consecutive segments at most ``floor(l * max_bits / m)`` bits may
    differ.  Any pair within ``max_bits`` has such a chain from at least one start (the
    strong form of the pigeonhole principle on a ring); the whole ring is the Hamming check.
    """
    parts = ring(segments)
    ok, so_far = F.lit(True), F.lit(0)
    for step in range(segments):
        shift, width = parts[(start + step) % segments]
        so_far = so_far + F.bit_count(_segment(x, shift, width))
        ok = ok & (so_far <= (step + 1) * max_bits // segments)
    return ok


def chain_keys(max_bits: int, segments: int) -> list[tuple[int, int]]:
    """For each start the (shift, width) of the segments at the head of its chain whose budget is zero."""
    whole = -(-segments // max_bits) - 1
    parts = ring(segments)
    return [(parts[i][0], sum(parts[(i + k) % segments][1] for k in range(whole))) for i in range(segments)]


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 128, segments: int = SEGMENTS) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct fingerprints ``fp`` within ``max_bits`` (1 or 2).

    Fingerprints are dealt by (start, the segments at the chain's head, which must be equal).
    In a bucket of at most ``crowd`` fingerprints, pairs that keep to the chain's budgets
    are linked.  With 27 bits to a key, billions of unrelated fingerprints make no larger bucket: those are groups of
    near copies.  No bucket is cut: the members of a larger one are linked through
    the codes at one bit from each of them (two codes within two bits share such a
    code or are one of them), which takes 65 rows a fingerprint and at most 65 rows
    for a key, however large the bucket is.
    """
    if max_bits not in (1, 2) or segments <= max_bits:
        raise ValueError("max_bits must be 1 or 2, and less than segments")
    keys = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), _segment(F.col("fp"), *k).alias("s")) for i, k in enumerate(chain_keys(max_bits, segments))])
    )
    dealt = fps.select("fp", keys.alias("k")).select("fp", "k.i", "k.s")
    sizes = dealt.groupBy("i", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(dealt.join(checkpointed(sizes), ["i", "s"]))
    few = shared.where(F.col("n") <= crowd)
    x = F.col("u").bitwiseXOR(F.col("v"))
    within = F.coalesce(*[F.when(F.col("a.i") == i, _chain(x, i, max_bits, segments)) for i in range(segments)])
    pairs = (
        few.select("i", "s", F.col("fp").alias("u")).alias("a")
        .join(
            few.select("i", "s", F.col("fp").alias("v")).alias("b"),
            (F.col("a.i") == F.col("b.i")) & (F.col("a.s") == F.col("b.s")) & (F.col("u") > F.col("v")) & within,
        )
        .select("u", "v")
    )
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63))) for b in range(BITS)]
    if max_bits == 1:
        # Codes one bit apart are each other's neighbours: only codes that exist count as keys.
        hubs = crowded.select("fp", F.explode(F.array(*near)).alias("v")).where("fp > v")
        through = hubs.join(checkpointed(crowded).select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("u"), "v")
    else:
        keyed = crowded.select("fp", F.explode(F.array(*near)).alias("key"))
        through = keyed.select(F.col("fp").alias("u"), F.min("fp").over(Window.partitionBy("key")).alias("v")).where("u != v")
    return pairs.unionAll(through)


_Verify = Callable[[DataFrame], DataFrame]


def _quartered(max_bits: int) -> list[tuple[int, int]]:
    """The (start, change) pairs that a fingerprint's 16-bit segments are dealt under.

    Budgets of the four segments that sum to ``max_bits - 3`` leave one segment within its own, for any pair within ``max_bits``.
    A budget of one or two bits is met by changing up to one bit on either side.
    """
    codes = []
    for i in range(QUARTERS):
        own = (max_bits - QUARTERS + 1 + i) // QUARTERS
        codes += [(i, 0)] + [(i, 1 << b) for b in range(16 if own else 0)]
    return codes


def _dealt(nodes: DataFrame, codes: list[tuple[int, int]]) -> DataFrame:
    """``nodes`` once for each code, with the ``key`` of the segment so changed."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).cast("long").alias("x")) for i, x in codes])
    key = F.expr("(shiftrightunsigned(fp, 16 * c.i) & 65535L ^ c.x) + c.i * 65536L")
    return nodes.select("*", F.explode(table).alias("c")).select(*nodes.columns, key.alias("key"))


def _met_once(max_bits: int) -> Column:
    """Of the keys that ``a`` and ``b`` share, true for one: the first segment that is near enough, changed on ``b`` before ``a``."""
    i = "cast(shiftright(a.key, 16) AS int)"
    change = [f"((shiftrightunsigned({s}.fp, 16 * {i}) & 65535L) ^ (a.key & 65535L))" for s in ("a", "b")]
    found = f"({change[0]} < {change[1]} OR ({change[0]} = 0 AND {change[1]} = 0))"
    reach = [2 if any(j == k and x for k, x in _quartered(max_bits)) else 0 for j in range(QUARTERS)]
    for j in range(QUARTERS - 1):
        found += f" AND ({i} <= {j} OR bit_count(shiftrightunsigned(a.fp ^ b.fp, {16 * j}) & 65535L) > {reach[j]})"
    return F.expr(found)


def wide_classes(nodes: DataFrame, max_bits: int, percent: int, verify: _Verify, prefixes: _Verify | None = None) -> DataFrame:
    """``(node, root)`` of the ``nodes(node, fp, n)`` that are linked with another one: within ``max_bits`` (3 to 11) and verified.

    Sizes ``n`` must lie within ``percent`` of each other.  Two steps, so that a crowd of near fingerprints, however large, is
    never compared with itself in full.  First the members of each bucket with an equal segment are compared with three of
    them; those close to one that has ``LARGE`` others close to it are crowded.  Then nodes that aren't crowded are
    compared with all, wherever a segment lies within its budget.  Crowded ones are compared with each other where they share
    one of their ``prefixes`` (see :meth:`_Jaccard.prefixes`), if given: two nodes that are to be linked have to share one, and
    pairs whose positions or sketches rule the similarity out are not made.  Without prefixes every
    close pair is a link, so that the members of a crowd are in one class by then, and only classes are compared.
    """
    if not QUARTERS - 1 <= max_bits <= WIDEST:
        raise ValueError(f"max_bits must be {QUARTERS - 1} to {WIDEST}")

    def fits(a: str, b: str) -> Column:
        x = F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))
        near = F.bit_count(x) <= max_bits
        least, most = (f(F.col(f"{a}.n"), F.col(f"{b}.n")).cast("long") for f in (F.least, F.greatest))
        return near & (least * 100 >= most * percent) & (F.col(f"{a}.node") != F.col(f"{b}.node"))

    def paired(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()

    def three(*columns: str, first: tuple[str, ...] = (), by: tuple[str, ...] = ("node",)) -> Column:
        """Three members of each group: the least in ``first``, then drawn by a hash."""
        order = lambda k: F.struct(*first, F.xxhash64(*by, F.lit(k)))
        return F.array(*[F.min_by(F.struct(*columns), order(k)) for k in range(3)]).alias("hubs")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def keyed(rows: DataFrame) -> DataFrame:
        """The rows of nodes once for each of their keys ``h``: made only after joins by node, which take one row a node."""
        if prefixes is None:
            return _dealt(rows, codes).withColumnRenamed("key", "h")
        return rows.select("*", F.posexplode("hs").alias("at", "h")).drop("hs")

    equal = checkpointed(_dealt(nodes, [(i, 0) for i in range(QUARTERS)]))
    hubs = checkpointed(equal.groupBy("key").agg(three("node", "fp", "n"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "hubs"))
    first = equal.join(hubs.hint("merge"), "key").select(F.struct("node", "fp", "n").alias("a"), F.explode("hubs").alias("b")).where(fits("a", "b"))
    first = checkpointed(first.select("a.node", F.col("b.node").alias("hub")).distinct())
    edges = verify(first.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct())
    roots = checkpointed(connected_components(edges))
    tidied(nodes.sparkSession)

    centres = first.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= LARGE).select("hub")
    around = first.join(checkpointed(centres).hint("merge"), "hub").select("node", "hub")
    crowd = checkpointed(around.select("node").unionAll(around.select("hub")).distinct().withColumn("big", F.lit(True)))
    marked = stored(nodes.join(crowd.hint("merge"), "node", "left").select("node", "fp", F.col("n").cast("int").alias("n"), F.coalesce("big", F.lit(False)).alias("big")))
    codes = _quartered(max_bits)
    some, other = _dealt(marked.where("NOT big").drop("big"), codes).alias("a"), _dealt(marked, codes).alias("b")
    once = F.col("b.big") | (F.col("a.node") < F.col("b.node"))
    # By shuffle: a table that is dealt 68 times over looks small to the planner, but must not be sent whole.
    rest = checkpointed(paired(some.join(other.hint("merge"), (F.col("a.key") == F.col("b.key")) & once & fits("a", "b") & _met_once(max_bits))))
    tidied(nodes.sparkSession)
    if not crowd.isEmpty():
        ours = marked.where("big").drop("big")
        if prefixes is None:
            columns, hubs_of, alike = ("node", "fp", "n"), three("node", "fp", "n", "root"), fits
        else:
            ours = prefixes(ours.select("node")).join(ours.hint("merge"), "node")
            columns = ("node", "fp", "n", *_SKETCH)
            # Those whose shared shingle comes first have the fewest of their own: the heart of a crowd.
            hubs_of = three(*columns, "root", first=("at",), by=("node", "h"))
            alike = lambda a, b: fits(a, b) & _sketched(a, b, percent)
        ours = stored(ours)

        def mixed(roots: DataFrame) -> DataFrame:
            """Those of the buckets whose members are of several classes."""
            told = keyed(rooted(ours, roots))
            keys = told.groupBy("h").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p != q").select("h")
            return checkpointed(told.join(checkpointed(keys).hint("merge"), "h", "left_semi"))

        open_ = mixed(roots)
        # Where a bucket is large, again three of each bucket first; then the pairs that are still of different classes.
        if not open_.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= LARGE).isEmpty():
            hubs = checkpointed(open_.groupBy("h").agg(hubs_of))
            near = open_.join(hubs, "h").select(F.struct(*columns, "root").alias("a"), F.explode("hubs").alias("b"))
            more = verify(paired(near.where(alike("a", "b") & (F.col("a.root") != F.col("b.root")))))
            known = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u != v")
            roots = checkpointed(connected_components(known.unionAll(more)))
            open_ = mixed(roots)
            tidied(nodes.sparkSession)
        differ = (F.col("a.h") == F.col("b.h")) & alike("a", "b")
        if prefixes is None:
            small, differ = open_, differ & (F.col("a.root") < F.col("b.root"))
        else:
            # The smaller of two similar sets holds their first common shingle early; which of two is told by size, then by node.
            small = open_.where(F.expr(f"at <= n - cast(ceil({2 * percent}L * n / {100 + percent}) as int)"))
            ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
            differ = differ & ordered & (F.col("a.root") != F.col("b.root")) & _placed("a", "b", percent)
        rest = rest.unionAll(paired(small.alias("a").join(open_.alias("b"), differ)))
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u != v")
    rest = rest.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")).hint("merge"), "u", "left")
    rest = rest.join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")).hint("merge"), "v", "left")
    more = verify(rest.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"))
    if more.isEmpty():
        return roots
    return connected_components(known.unionAll(more))


#: The columns of a sketch: bit i of the whole tells whether the set holds an odd number of the hashes of class i.
_SKETCH = tuple(f"odd{i}" for i in range(SKETCH))


def _sketched(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar by their sketches: each bit that differs takes a hash that one set alone holds."""
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH), F.lit(0))
    return apart * (100 + percent) <= (F.col(f"{a}.n").cast("long") + F.col(f"{b}.n")) * (100 - percent)


def _placed(a: str, b: str, percent: int) -> Column:
    """Whether enough of both sets is left from the shared hash on, if it is the first that they share."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")).cast("long")
    return left * (100 + percent) >= (F.col(f"{a}.n").cast("long") + F.col(f"{b}.n")) * percent


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes, as ``SKETCH`` signed longs."""
    # Bits that neither the order of prefixes nor its classes use.
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(frequency: np.ndarray, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, sketches = [], []
            for row in batch.column(1):
                hashes = row.values.to_numpy()
                n = len(hashes)
                order = np.lexsort((hashes, frequency[hashes & (FREQUENCIES - 1)]))
                firsts.append(hashes[order[: n + (-percent * n) // 100 + 1]])
                sketches.append(sketch(hashes))
            bits = np.array(sketches, np.int64).reshape(-1, SKETCH)
            found = [batch.column(0), pa.array(firsts, pa.list_(pa.int64())), *[pa.array(bits[:, i].copy()) for i in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays(found, ["node", "hs", *_SKETCH])
            released()

    return run


def _sets(words: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks((t.as_py() for t in batch.column(0)), 1 << 20):
                sets = [fingerprint(t, words, seed)[1] for t in texts]
                yield pa.RecordBatch.from_arrays([_signed([_set_key(s, seed) for s in sets]), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])
            released()

    return run


class _Jaccard:
    """Similarity of nodes by their sets of shingles, which are made anew, from one text each, for those nodes that need it."""

    def __init__(self, docs: DataFrame, marked: DataFrame, words: int, percent: int, seed: int):
        self.docs, self.words, self.percent, self.seed = docs, words, percent, seed
        self.texts = stored(marked.groupBy("node").agg(F.min("th").alias("_t")))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``(node, hashes)`` of the distinct ``nodes(node)``."""
        wanted = checkpointed(self.texts.join(nodes.hint("merge"), "node", "left_semi").select("_t"))
        chosen = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        found = self.docs.select("text", F.xxhash64("text").alias("_t")).join(chosen, "_t", "left_semi").dropDuplicates(["_t"])
        return stored(found.select(text_bytes().alias("b")).mapInArrow(_sets(self.words, self.seed), "node long, hashes array<long>"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(u, v)`` whose similarity is ``percent`` / 100 or more."""
        pairs = checkpointed(pairs.distinct())
        sets = self.sets(checkpointed(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct()))
        left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(y)).hint("merge") for x, y in (("u", "a"), ("v", "b")))
        similar = F.size(F.array_intersect("a", "b")) * (100 + self.percent) >= (F.size("a") + F.size("b")) * self.percent
        found = checkpointed(pairs.join(left, "u").join(right, "v").where(similar).select("u", "v"))
        dropped(sets)
        tidied(pairs.sparkSession)
        return found

    def prefixes(self, nodes: DataFrame) -> DataFrame:
        """``(node, hs, odd0, ...)``: of each set its sketch and the first hashes, so many that two similar sets share one.

        All sets are in one order, by how frequent a hash's class is, then by the hash; the frequencies of ``FREQUENCIES``
        classes are all that is sent to the tasks.  ``hs`` is in that order.
        """
        sets = self.sets(nodes)
        h = F.explode("hashes").alias("h")
        counts = sets.select(h).groupBy(F.col("h").bitwiseAND(F.lit(FREQUENCIES - 1)).alias("c")).agg(F.count(F.lit(1)).alias("m")).toArrow()
        frequency = np.zeros(FREQUENCIES, np.int64)
        frequency[counts["c"].to_numpy()] = counts["m"].to_numpy()
        schema = "node long, hs array<long>, " + ", ".join(f"{c} long" for c in _SKETCH)
        first = sets.select("node", "hashes").mapInArrow(_prefixes(frequency, self.percent), schema)
        found = stored(first)
        dropped(sets)
        tidied(nodes.sparkSession)
        return found


def _rooted(marked: DataFrame, max_bits: int, crowd: int) -> DataFrame:
    """``(fp, root, least)`` for each distinct fingerprint: its class and its own smallest doc_id."""
    codes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if max_bits <= 2:
        roots = connected_components(links(codes.select("fp"), max_bits, crowd))
    else:
        nodes = codes.select(F.col("fp").alias("node"), "fp", F.lit(1).alias("n"))
        roots = wide_classes(nodes, max_bits, 0, lambda pairs: checkpointed(pairs.distinct()))
    return checkpointed(
        codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    )


def near_duplicates(docs: DataFrame, max_bits: int = 2, words: int = 3, seed: int = 42, crowd: int = 128) -> DataFrame:
    """Near-duplicate classes of whole texts: ``(doc_id, fp, component_id)``, one row for each row.

    Equal fingerprints are first reduced to one; links are sought between distinct
    fingerprints only (see :func:`links` and, for ``max_bits`` of 3 to 11, :func:`wide_classes`), and classes are the
    connected components.  ``component_id`` is the smallest doc_id of the class.  Null and empty texts have
    fingerprint zero and are linked like any other; rows without doc_id are linked too
    and have a null ``component_id`` only in a class without any id.  Repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    marked = checkpointed(fingerprints(docs, words, seed))
    placed = _rooted(marked, max_bits, crowd)
    ids = checkpointed(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = checkpointed(placed.join(ids, "root").select("fp", "component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, max_bits: int = WIDEST, words: int = 5, percent: int = 80, seed: int = 42) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (null last), then the smallest text hash.

    Two texts are near copies if their fingerprints differ in ``max_bits`` (3 to 11) at most and the Jaccard similarity of
    their sets of ``words``-word shingles is ``percent`` / 100 or more; groups are the connected components.  Fingerprints
    find most such pairs, not all: the closer two texts, the surer.  Texts without words are copies of each other.  All
    columns are kept.  Of repeated rows with one id and text, one stays; an empty table gives an empty one.
    """
    tidied(docs.sparkSession)
    marked = stored(fingerprints(docs, words, seed, sets=True))
    nodes = stored(marked.where("n > 0").select("node", "fp", "n").distinct())
    similar = _Jaccard(docs, marked, words, percent, seed)
    roots = wide_classes(nodes, max_bits, percent, similar.verify, similar.prefixes)
    placed = marked.select("node").distinct().join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return _first_rows(docs, marked.select("doc_id", "th", "node"), checkpointed(placed))


def _first_rows(docs: DataFrame, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """The first document of each class, given ``marked(doc_id, th, node)`` of the rows and ``roots(node, root)`` of all nodes."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    # Per node before the join with the classes, so that hot nodes are one row each.
    by_node = checkpointed(marked.groupBy("node").agg(first.alias("one")))
    by_root = by_node.join(roots.hint("merge"), "node").groupBy("root").agg(F.min("one").alias("one"))
    kept = checkpointed(by_root.select(F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th")))
    again = marked.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = kept.join(again, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th"))).select("_id", "_th")
    again = checkpointed(again)
    g = Guarded(docs)
    chosen = F.col(g["doc_id"]).eqNullSafe(F.col("_id")) & (F.xxhash64(g["text"]) == F.col("_th"))
    if again.isEmpty():
        return g.restored(g.df.join(kept, chosen, "left_semi"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))
    once = kept.join(again.select(F.col("_id").alias("_i"), F.col("_th").alias("_t")), same, "left_anti")
    more = g.df.join(again, chosen, "left_semi").withColumn("_th", F.xxhash64(g["text"])).dropDuplicates([g["doc_id"], "_th"])
    return g.restored(g.df.join(once, chosen, "left_semi")).unionAll(g.restored(more))
