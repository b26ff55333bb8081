"""Operator 5, SimHash near-dedup through vantage-point trees.

Fingerprints are one or more words of 64 bits, cut into parts of 16. Those that differ in at
most 4 of 64 bits differ in at most 1 bit in one of their four parts, so a forest of four
vantage-point trees finds every link: each tree divides its part's values by their Hamming
distance from vantage points, taken with their radii from a bounded sample such that few
values lie at a border. A fingerprint lives in one leaf (shard) of each tree and also visits
the leaves that hold a value within reach of its own, of two leaves the one with the smaller
number; so a link is met once a tree. Only the leaf of each of the 65,536 values is sent
along; the 17 values within reach are read off it. Inside a shard vantage points divide on,
branches are pruned by the triangle inequality, and what is left is compared over all bits:
pairs are exact.

(A tree over all 64 bits hardly prunes: distances of unrelated fingerprints crowd at 32,
and 68 % of them lie within 4 of a median radius. Over a part with radius 1 it is 37 %, and
the finest leaves are single values of a part.)

Only distinct fingerprints are linked, a shard yields one edge a fingerprint at most
(links inside it are merged at once, not listed), and shards over MAX_SHARD rows are split
into pairs of chunks, so that no task holds more than two chunks and no link is lost.

`drop_near_copies` asks for similarity 0.8 over five-word shingles, which fingerprints can
only estimate. It takes fingerprints of 256 bits (sixteen trees) with a radius wide enough
to hardly miss a pair, sends on the shingles of those documents alone that have a
fingerprint within it, and links only pairs whose Jaccard index is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.llm.common import id_key, materialize, may_be_in, only, table, text_of
from lexbolt.llm.components import components

PART, WORD_BITS = 16, 64
WORDS, HASH_SEED = 4, 42
SHARD_POINTS, MAX_SHARD, SAMPLE = 4096, 65_536, 20_000
#: Shingles of a chunk of a shard (of 8 bytes each), and pairs that wait for comparison.
MAX_SHINGLES, MAX_PAIRS = 1 << 23, 1 << 20
CANDIDATES = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15
_EVERY = np.arange(1 << PART, dtype=np.uint16)


@dataclass(frozen=True)
class Rule:
    """Fingerprints of `lanes` words link if at most `radius` of their bits differ, and at
    most `reach` in one of their parts at least. With `likeness`, which is a Jaccard index
    of their sets of shingles, that makes candidates; the index decides."""

    lanes: int = 1
    radius: int = 4
    reach: int = 1
    likeness: float | None = None

    @property
    def parts(self) -> int:
        return self.lanes * WORD_BITS // PART


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    """Each run of `words` words, repeats included; the whole if it has fewer."""
    found = text.translate(_LOWER).split()  # bytes split at exactly \x20 and \x09-\x0D
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined] if found else []
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[s:e] for s, e in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())]


def _majority(hashes: np.ndarray) -> bytes:
    """A bit is 1 if it is in over half of the rows (bytes, a row a hash)."""
    ones = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK], axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprint(text: bytes | None, words: int = WORDS) -> bytes:
    """64 bits over the XXH64 of all shingles; zero without words. Big-endian."""
    raw = b"".join([xxhash.xxh64_digest(g, HASH_SEED) for g in shingles(text or b"", words)])
    return _majority(np.frombuffer(raw, np.uint8).reshape(-1, 8))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    raw = b"".join([xxhash.xxh3_64_digest(g, HASH_SEED) for g in {*shingles(text, words)}])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def set_fingerprint(hashes: np.ndarray, lanes: int) -> bytes:
    """64 * lanes bits over distinct shingles, spread from their 64-bit hashes."""
    x = hashes[:, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return _majority(x.astype(">u8").view(np.uint8).reshape(-1, 8 * lanes))


def fingerprints(docs: DataFrame, words: int = WORDS, rule: Rule = Rule()) -> DataFrame:
    """doc_id, mark (hash of the text), fp, n (distinct shingles, with a likeness) and node,
    which names the fingerprint or the set of shingles: a row a document, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, nodes = [], [], []
            for t in b.column(2).to_pylist():
                if rule.likeness is None:
                    fps.append(fingerprint(t, words))
                    nodes.append(int.from_bytes(fps[-1], "big", signed=True))
                    sizes.append(0)
                else:
                    own = shingle_set(t, words)
                    fps.append(set_fingerprint(own, rule.lanes))
                    nodes.append(int.from_bytes(xxhash.xxh3_64_digest(own.tobytes()), "big", signed=True))
                    sizes.append(len(own))
            columns = [b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp", "n", "node"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().cast("binary").alias("text"))
    return materialize(narrow.mapInArrow(run, "doc_id long, mark long, fp binary, n int, node long"), "fingerprints")


# ---- vantage-point trees over a part's values


def _distance(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(values ^ values.dtype.type(vantage)).astype(np.int16)


def _best_cut(own: np.ndarray, reach: int, least: float) -> tuple[int, int] | None:
    """Vantage point and radius that divide `own`, with at least `least` values on either
    side where that can be, for the fewest visits across the border a bit of division."""
    size, best = len(own), None
    for vantage in np.unique(own[np.arange(CANDIDATES) * size // CANDIDATES]).tolist():
        within = np.cumsum(np.bincount(_distance(own, vantage), minlength=17))[:16]
        border = within - np.concatenate((np.zeros(reach, np.int64), within))[:16]
        p = np.clip(within / size, 1e-9, 1 - 1e-9)
        cost = np.log2(1 + border / size) / -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
        small = np.minimum(within, size - within)
        fit = small >= max(1, least)
        if not fit.any():
            fit = small >= 1
        cost[~fit] = np.inf
        radius = int(np.argmin(cost))
        if fit.any() and (best is None or cost[radius] < best[0]):
            best = (cost[radius], vantage, radius)
    return best and best[1:]


def leaf_table(sample: np.ndarray, leaves: float, reach: int) -> tuple[np.ndarray, int]:
    """The tree over 16-bit values, read off for every value: its home leaf, and the number
    of leaves, each of about 1 / `leaves` of the sample. The tree is the same at any size of
    the data but for its depth; it holds 65,536 values whatever there is."""
    home = np.zeros(1 << PART, np.int32)
    share = max(1.0, len(sample) / max(1, leaves))
    stack, count = [(np.sort(sample), _EVERY)], 0
    while stack:
        own, here = stack.pop()
        cut = _best_cut(own, reach, share / 2) if len(own) > 1.5 * share and len(here) > 1 else None
        if cut is None:
            home[here] = count
            count += 1
            continue
        vantage, radius = cut
        inner, there = _distance(own, vantage) <= radius, _distance(here, vantage) <= radius
        stack.append((own[~inner], here[~there]))
        stack.append((own[inner], here[there]))  # inner leaves get the smaller numbers
    return home, count


def visits(home: np.ndarray, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into values, leaf): the other leaves that hold a value within reach, as far as
    their numbers are larger than that of the value's own."""
    near = _EVERY[_distance(_EVERY, 0) <= reach]
    there = np.sort(home[values[:, None] ^ near], axis=1)
    keep = there > home[values][:, None]
    keep[:, 1:] &= there[:, 1:] != there[:, :-1]
    return np.nonzero(keep)[0], there[keep]


def _blocks(a: np.ndarray, b: np.ndarray, part: np.ndarray, bits: int, radius: int, on: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of small index sets of points `a` and queries `b` that hold every pair whose
    values in `part` (of `bits` bits) are within the radius. A branch is entered only where
    the triangle inequality allows a link; what no vantage point divides goes to `on`."""
    stack = [(a, b, 0)]
    while stack:
        a, b, tries = stack.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= 1 << 16:
            yield a, b
            continue
        vantage = int(part[a[(7919 * (tries + 1)) % len(a)]])
        d = _distance(part[a], vantage)
        middle = int(np.median(d))
        if (d <= middle).all():
            middle -= 1
        inside = d <= middle
        if not inside.any() or tries >= 40:  # a tight cluster isn't divided for ever
            if on:
                yield from on(a, b)
            else:
                step = max(1, (1 << 18) // len(b))
                for at in range(0, len(a), step):
                    yield a[at : at + step], b
            continue
        e = _distance(part[b], vantage)
        stack.append((a[inside], b[e - radius <= middle], tries + 1))
        stack.append((a[~inside], b[e + radius > middle], tries + 1))


def part_of(fps: np.ndarray, k: int) -> np.ndarray:
    """The k-th 16 bits of fingerprints (a row each, uint64 a lane)."""
    return ((fps[:, k // 4] >> np.uint64(PART * (k % 4))) & np.uint64(0xFFFF)).astype(np.uint16)


def lanes_of(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)


@dataclass
class Shard:
    """Distinct nodes of a shard, their fingerprints and sizes, and which of them are points
    (of one chunk) and queries (of another)."""

    nodes: np.ndarray
    fps: np.ndarray
    sizes: np.ndarray
    points: np.ndarray
    queries: np.ndarray
    part: int
    first: np.ndarray  # the row of each node

    @classmethod
    def of(cls, nodes, fps, sizes, points, queries, part) -> Shard:
        names, first, inverse = np.unique(nodes, return_index=True, return_inverse=True)
        return cls(names, fps[first], sizes[first], np.unique(inverse[points]), np.unique(inverse[queries]), part, first)

    def near(self, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs x, y with their distances, of all candidates by the rule that are met first
        in this part."""
        if rule.lanes == 1:
            whole = self.fps[:, 0]
            on = lambda a, b: _blocks(a, b, whole, WORD_BITS, rule.radius, None)
        else:
            on = None
        own = part_of(self.fps, self.part)
        for i, j in _blocks(self.points, self.queries, own, PART, rule.reach, on):
            apart = np.bitwise_count(own[i][:, None] ^ own[j][None, :])
            x, y = np.nonzero(apart <= rule.reach)
            x, y = i[x], j[y]
            use = x != y
            if rule.likeness is not None:
                m, n = self.sizes[x], self.sizes[y]
                use &= (m >= rule.likeness * n) & (n >= rule.likeness * m)
            x, y = x[use], y[use]
            d = np.bitwise_count(self.fps[x] ^ self.fps[y]).sum(1, dtype=np.int64)
            use = d <= rule.radius
            x, y, d = x[use], y[use], d[use]
            if rule.likeness is not None:
                for k in range(self.part):
                    if not len(x):
                        break
                    use = np.bitwise_count(part_of(self.fps[x], k) ^ part_of(self.fps[y], k)) > rule.reach
                    x, y, d = x[use], y[use], d[use]
            if len(x):
                yield x, y, d


class Sets:
    """Disjoint sets of 0 ... n - 1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def flat(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent

    def join(self, x: int, y: int) -> None:
        r, s = self.find(x), self.find(y)
        if r != s:
            self.parent[max(r, s)] = min(r, s)

    def edges(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges between names that join what is joined: a member and the first of its set."""
        parent = self.flat()
        moved = np.nonzero(parent != np.arange(len(parent)))[0]
        return names[moved], names[parent[moved]]


def link(shard: Shard, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked by fingerprints."""
    sets = Sets(len(shard.nodes))
    for x, y, _ in shard.near(rule):
        parent = sets.flat()
        for p in np.unique(np.sort(np.stack([parent[x], parent[y]], 1), 1), axis=0).tolist():
            sets.join(*p)
    return sets.edges(shard.nodes)


def active(shard: Shard, rule: Rule) -> np.ndarray:
    """The nodes that have a candidate here."""
    seen = np.zeros(len(shard.nodes), bool)
    for x, y, _ in shard.near(rule):
        seen[x] = seen[y] = True
    return shard.nodes[seen]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays without repeats; empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def verified(shard: Shard, hashes: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked: candidates whose sets of shingles are as alike as the
    rule says, the nearest of each MAX_PAIRS first. What is joined already needn't be held or
    compared, so a large group of copies of one another is never listed by its pairs."""
    sets, held, size = Sets(len(shard.nodes)), [], 0

    def compare(held: list) -> None:
        x, y, d = (np.concatenate(c) for c in zip(*held))
        for k in np.argsort(d, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            if sets.find(i) != sets.find(j) and jaccard(hashes[i], hashes[j]) >= rule.likeness:
                sets.join(i, j)

    for x, y, d in shard.near(rule):
        parent = sets.flat()
        new = parent[x] != parent[y]
        held.append((x[new], y[new], d[new]))
        size += len(held[-1][0])
        if size >= MAX_PAIRS:
            compare(held)
            held, size = [], 0
    if held:
        compare(held)
    return sets.edges(shard.nodes)


def deal(reps: DataFrame, rule: Rule) -> DataFrame:
    """shard, part, node, fp, n, home: each fingerprint of the stored table `reps` in its
    leaf of every tree and in those that it visits."""
    spark = reps.sparkSession
    sample = reps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow().column(0).combine_chunks()
    sample, leaves = lanes_of(sample, rule.lanes), reps.count() / SHARD_POINTS
    trees = [leaf_table(part_of(sample, k), leaves, rule.reach) for k in range(rule.parts)]
    sent = spark.sparkContext.broadcast(trees)  # 256 KB a part, whatever there is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, base = lanes_of(b.column(1), rule.lanes), 0
            for k, (home, count) in enumerate(sent.value):
                own = part_of(fps, k)
                who, leaf = visits(home, own, rule.reach)
                rows = pa.array(np.concatenate([np.arange(len(fps)), who]))
                shard = np.concatenate([home[own], leaf]).astype(np.int32) + np.int32(base)
                columns = [pa.array(shard), pa.array(np.full(len(shard), k, np.int32)), *(c.take(rows) for c in b.columns), pa.array(np.arange(len(shard)) < len(fps))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "node", "fp", "n", "home"])
                base += count

    return reps.select("node", "fp", "n").mapInArrow(run, "shard int, part int, node long, fp binary, n int, home boolean")


def in_shards(dealt: DataFrame, work: Callable[[Shard, pa.Table], pa.Table], rule: Rule, returns: str) -> DataFrame:
    """`work` on every shard, or on every pair of chunks of a shard over MAX_SHARD rows or, if
    rows carry their shingles, over MAX_SHINGLES of them."""
    most = F.count("*") / MAX_SHARD
    if "hashes" in dealt.columns:
        most = F.greatest(most, F.sum("n") / MAX_SHINGLES)
    sizes = dealt.groupBy("shard").agg(F.ceil(most).cast("int").alias("chunks")).where("chunks > 1")
    rows = dealt.join(F.broadcast(sizes), "shard", "left").fillna(1, ["chunks"])  # at most 16 * 65,536 leaves
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
    rows = rows.withColumn("task", F.explode(mates)).select(*dealt.columns, "chunk", "task.i", "task.j")

    def run(key, t):
        home, chunk = t["home"].to_numpy(), t["chunk"].to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        out = []
        for a, b in [(i, j)] if i == j else [(i, j), (j, i)]:
            shard = Shard.of(t["node"].to_numpy(), lanes_of(t["fp"], rule.lanes), t["n"].to_numpy(), home & (chunk == a), chunk == b, t["part"][0].as_py())
            out.append(work(shard, t))
        return pa.concat_tables(out)

    return rows.groupBy("shard", "i", "j").applyInArrow(run, returns)


def _edges(found: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    return pa.table({"u": pa.array(found[0], pa.int64()), "v": pa.array(found[1], pa.int64())})


def links(reps: DataFrame, rule: Rule) -> DataFrame:
    """Edges u, v between nodes (`reps`: a stored table of distinct node, fp, n) whose
    components are those of all links by fingerprints."""
    return in_shards(deal(reps, rule), lambda shard, _: _edges(link(shard, rule)), rule, "u long, v long")


def verified_links(reps: DataFrame, docs: DataFrame, words: int, rule: Rule) -> DataFrame:
    """The same where a likeness is asked for; `reps` has the first document of each node.

    A first round keeps, shard by shard, the nodes that have a candidate. The texts of these
    alone are read for their sets of shingles, which a second round compares.
    """

    def some(shard: Shard, t: pa.Table) -> pa.Table:
        rows = np.isin(t["node"].to_numpy(), active(shard, rule))
        return t.select(["shard", "part", "node", "fp", "n", "home"]).filter(pa.array(rows))

    dealt = in_shards(deal(reps, rule), some, rule, "shard int, part int, node long, fp binary, n int, home boolean")
    dealt = materialize(dealt.distinct(), "active")
    first = reps.join(dealt.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"))
    first = materialize(first.select("node", *id_key(), "mark"), "active-documents")
    texts = docs.select(*id_key(), F.xxhash64(text_of()).alias("mark"), text_of().cast("binary").alias("text"))
    candidate = may_be_in(first, "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(candidate(b.column(2).to_numpy())))
            sets = pa.array([shingle_set(t.as_py(), words).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sets], ["__none", "__id", "mark", "hashes"])

    sets = texts.mapInArrow(run, "__none boolean, __id long, mark long, hashes binary").join(first, ["__none", "__id", "mark"])
    sets = materialize(sets.select("node", "hashes"), "shingle-sets")
    sets = sets.groupBy("node").agg(F.first("hashes").alias("hashes"))  # rows may repeat
    rows = dealt.join(sets, "node")

    def compare(shard: Shard, t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(t["hashes"][int(k)].as_py(), np.uint64) for k in shard.first]
        return _edges(verified(shard, hashes, rule))

    return in_shards(rows, compare, rule, "u long, v long")


def groups(fps: DataFrame, rule: Rule, docs: DataFrame | None = None, words: int = WORDS) -> DataFrame:
    """node, first (struct of none, doc_id, mark): the first document of the component, for
    each distinct node of the stored table `fps`."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    reps = materialize(fps.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), first), "representatives")
    found = components(links(reps, rule) if rule.likeness is None else verified_links(reps, docs, words, rule))
    rooted = reps.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    linked = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("node", "root").join(linked, "root").select("node", "first")


def near_groups(docs: DataFrame, words: int = WORDS, rule: Rule = Rule()) -> DataFrame:
    """A row for each row of `docs`: doc_id, fingerprint, component_id.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked
    like others. Repeated rows and ids stay as they are. Null ids get the smallest id
    reachable, or null where no other is. Columns other than doc_id and text aren't looked
    at. No rows give no rows.
    """
    fps = fingerprints(docs, words, rule)
    out = fps.join(groups(fps, rule), "node")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


#: Similarity 0.8 over sets of five-word shingles. A Jaccard index of 0.8 is a cosine of 8/9,
#: so a bit differs with probability acos(8/9) / pi = 0.15 and 256 bits in 39 with a standard
#: deviation of 6. Of sixteen parts one differs in at most 1 bit in 99.4 % of such pairs.
NEAR_WORDS, NEAR_RULE = 5, Rule(lanes=4, radius=56, reach=1, likeness=0.8)


def drop_near_copies(docs: DataFrame, words: int = NEAR_WORDS, rule: Rule = NEAR_RULE) -> DataFrame:
    """The rows of `docs` that stay, with their own columns: the first document (smallest
    id, nulls last) of each component of verified links. Texts without words aren't near
    copies of anything else, but of each other; a text of fewer than five words is one
    shingle. Of repeated rows one stays. Columns of any name pass through.
    """
    fps = fingerprints(docs, words, rule)
    stay = groups(fps, rule, docs, words).select("first.doc_id", "first.mark").distinct()
    return only(docs, F.xxhash64(text_of()), stay.select(*id_key(), F.col("mark").alias("__mark")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
