"""Similarity join of shingle sets: count-vector R-trees under shared rare shingles."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import batches_of, forget, hinted, map_rows, scope, store
from .graph import components

SHINGLE = 5
PERCENT = 75

#: Percent of a set by which its prefix exceeds what a link needs to show at all.
MORE = 8

#: Groups into which shingles are hashed: the coordinates of a document's point.
GROUPS = 128

#: Points in a leaf of the R-tree; members of one lead, and keys of members, that one task takes.
LEAF, BLOCK, ROWS = 32, 2048, 1 << 20

#: Word hashes that a worker remembers, at most.
MEMORY = 200_000

#: Texts that a task holds at once, guests of a list, and bytes of sets that a task hands on or takes at once.
BATCH, SENDS, SEND_BYTES = 1000, 500, 16 << 20

#: Rounds in which buckets link their members to a leader before the trees are searched, at
#: most, and the share of a round's pairs that must link for another one.
ROUNDS, HELPS = 6, 0.1

#: The order of shingles, in which common ones come last: how many documents hold them is counted in
#: all documents and told by slots of the hash; what fewer than SPARSE times COMMON of them hold
#: counts as rare, and so many slots at most are told apart. The order decides how much is searched,
#: never what is found: any order gives the same links.
SPARSE, SLOT_BITS, COMMON, SLOTS = 16, 22, 3, 1 << 19

#: Bytes of text, on average, whose shingles one group counts.
COUNTED = 16 << 20


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's 5-word shingles, sorted.

    Words are what lies between space and U+0009 to U+000D, with A-Z in lower case. A text of
    fewer words has its whole sequence as one shingle, one without words has none. Different
    shingles share a hash with a chance of 2**-64 a pair.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, found), np.uint64, n)
    width = min(n, SHINGLE)
    sums = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        sums += ids[k : n - width + 1 + k] * _MULTIPLIERS[k]
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    sums ^= sums >> np.uint64(32)
    return np.unique(sums)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    for batch in batches:
        yield zip(*(c.to_pylist() for c in batch.columns), strict=True)


def prefix_length(n):
    """How many of n shingles, the first in one order of all shingles, make the prefix.

    Sets x and y of n and m shingles that link share at least o = ceil(0.75 max(n, m)). If the
    first n - o + k of x and m - o + k of y had fewer than k in common, then fewer than o would
    be common in all. So the first n - ceil(0.75 n) + k show at least k, for the lesser k of
    the two.
    """
    return np.minimum(n, n - -(-PERCENT * n // 100) + 1 + MORE * n // 100)


def pair_shown(n, m):
    """Shingles that sets of n and m must share in their prefixes to link.

    They must share ceil(0.75 / 1.75 (n + m)) in all. Of the two prefixes one ends first; what
    they share beyond that end lies in the rest of the set whose prefix it is.
    """
    in_all = -(-PERCENT * (n + m) // (100 + PERCENT))
    return np.maximum(1, in_all - np.maximum(n - prefix_length(n), m - prefix_length(m)))


def least_shown(n):
    """Shingles that a set of n must share in its prefix with one of any size to link.

    By ``pair_shown`` it's least for a smaller set, of which it's 1 + MORE % of n.
    """
    return 1 + MORE * n // 100


def common_slots(docs: DataFrame) -> np.ndarray:
    """How common shingles are, by the first SLOT_BITS of their hash; 0 is rare.

    The result has a fixed size. It is the logarithm of the count of a slot's most frequent
    shingle in all documents; if more than SLOTS slots hold a common shingle, only
    the more frequent ones are told. Shingles are counted by ranges of their hash, as many as
    the texts' size asks for, by 32 bits within a range: of what is counted as one, about one in a
    thousand is two shingles.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min((size // COUNTED).bit_length(), 30)

    def told(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
        rest, counts = (keys << np.uint64(bits) >> np.uint64(32)).astype("<u4"), counts.astype("<u4")
        ends = [*cuts[1:], len(keys)]
        rows = [(part, rest[i:j].tobytes(), counts[i:j].tobytes()) for part, (i, j) in enumerate(zip(cuts, ends, strict=True)) if i < j]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "keys", "counts"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = shingle_set(text)
                if len(own):
                    sets.append(own)
                    held += own.nbytes
                if held >= SEND_BYTES // 2:
                    yield told(sets)
                    sets, held = [], 0
        if sets:
            yield told(sets)

    def common(table: pa.Table) -> pa.Table:
        joined = lambda c: np.frombuffer(b"".join(table[c].to_pylist()), "<u4").astype(np.uint64)
        both = joined("keys") << np.uint64(32) | joined("counts")
        both.sort()
        keys = both >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
        many = sums >= SPARSE * COMMON
        whole = keys[first[many]] << np.uint64(32) >> np.uint64(bits)
        if bits:
            whole |= np.uint64(table["part"][0].as_py()) << np.uint64(64 - bits)
        columns = [(whole >> np.uint64(64 - SLOT_BITS)).astype(np.int32), np.log2(sums[many]).astype(np.int32)]
        return pa.table([pa.array(c, pa.int32()) for c in columns], names=["slot", "level"])

    counts = docs.select("text").mapInArrow(made, "part long, keys binary, counts binary")
    slots = counts.groupBy("part").applyInArrow(common, "slot int, level int").groupBy("slot").agg(F.max("level").alias("level"))
    slots = store(slots, "slots")
    told, lowest = 0, 61
    for level, n in sorted(slots.groupBy("level").count().collect(), reverse=True):
        if told + n > SLOTS:
            break
        told, lowest = told + n, level
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    found = slots.filter(F.col("level") >= lowest).toPandas()
    out[found["slot"].to_numpy().astype(np.int64)] = found["level"].to_numpy()
    forget(slots)
    return out


def _points(own: np.ndarray) -> bytes:
    """The counts of a set's shingles by group."""
    point = np.bincount((own >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS)
    return point.astype("<u2" if point.max() < 1 << 16 else "<u4").tobytes()


def _prefixes(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """doc_id, n, digest of the set, its point, keys of its prefix and how many of them are rare.

    A prefix has the first shingles by how common they are, then by hash.
    """
    schema = "doc_id long, n long, digest binary, point binary, keys array<bigint>, rare int"
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            sets = [shingle_set(text) for text in batch.column(1).to_pylist()]
            first, rare = [], []
            for own in sets:
                level, size = levels[own >> np.uint64(64 - SLOT_BITS)], int(prefix_length(len(own)))
                n_rare = len(own) - int(np.count_nonzero(level))
                first.append(own[:size] if n_rare == len(own) else own[np.argsort(level, kind="stable")[:size]])
                rare.append(min(n_rare, size))
            ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
            keys = np.concatenate(first).view(np.int64) if first else np.empty(0, np.int64)
            digests = [blake2b(own.tobytes(), digest_size=16).digest() for own in sets]
            columns = [
                batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(map(_points, sets), pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), pa.array(rare, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "point", "keys", "rare"])

    return docs.mapInArrow(made, schema)


def _duties(pairs: DataFrame) -> DataFrame:
    """doc_id, duties (host, list, guest): where each document of the stored pairs (a, b) sends its set.

    Of a pair the one in more pairs is the host, the other its guest. A guest sends its set to each of its
    hosts; a host sends its own, with a null guest, to each of its lists, which have about SENDS guests.
    A document of many duties has several rows.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    many = hinted(store(ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "many"))
    side = lambda k: many.select(F.col("doc_id").alias(k), F.col("c").alias(f"c_{k}"))
    told = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    more = F.coalesce("c_a", F.lit(1)) >= F.coalesce("c_b", F.lit(1))
    told = told.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("guest"))
    large = told.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / SENDS).alias("lists")).filter("lists > 1")
    told = told.join(hinted(store(large, "large")), "host", "left")
    told = store(told.select("host", "guest", F.pmod(F.xxhash64("guest"), F.coalesce("lists", F.lit(1))).alias("list")), "told")
    duties = told.select(F.col("guest").alias("doc_id"), "host", "list", "guest")
    own = told.select("host", "list").distinct().select(F.col("host").alias("doc_id"), "host", "list", F.lit(None).cast("long").alias("guest"))
    duties = duties.unionByName(own)
    busy = hinted(store(duties.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / SENDS).alias("parts")).filter("parts > 1"), "busy"))
    duties = duties.join(busy, "doc_id", "left").withColumn("part", F.pmod(F.xxhash64("host", "list"), F.coalesce("parts", F.lit(1))))
    return store(duties.groupBy("doc_id", "part").agg(F.collect_list(F.struct("host", "list", "guest")).alias("duties")), "duties")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) whose sets link, by their exact intersection; stored.

    Only the texts of documents in a pair are read again. A list's rows are sorted behind its host's;
    a task holds the host's set and one batch of guests, which is bounded by bytes.
    """
    duties = _duties(pairs)
    chosen = docs.join(hinted(duties, duties.count()), "doc_id").select("text", "duties")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows, size = [], 0
        for batch in _rows(batches):
            for text, own in batch:
                held = shingle_set(text).tobytes()
                for duty in own:
                    rows.append((duty["host"], duty["list"], duty["guest"], held))
                    size += len(held)
                    if size >= SEND_BYTES:
                        yield rows
                        rows, size = [], 0
        yield rows

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        x = np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for host, guest, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                y = np.frombuffer(own.as_buffer(), np.uint64)
                if guest is None:
                    x = y.copy()
                elif 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * common >= PERCENT * (len(x) + len(y) - common):
                        rows.append((min(host, guest), max(host, guest)))
            yield rows

    sent = map_rows(chosen, sets, T._parse_datatype_string("host long, list long, guest long, own binary"))
    met = sent.repartition("host", "list").sortWithinPartitions("host", "list", F.col("guest").asc_nulls_first())
    with batches_of(docs.sparkSession, BATCH // 4, SEND_BYTES):
        return store(map_rows(met, test, T._parse_datatype_string("a long, b long")), "links")


class RTree:
    """Points of group counts under nested boxes, packed by size and by total in halves of groups."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, parts: np.ndarray):
        half = points[:, : points.shape[1] // 2].sum(1)
        self.order = np.lexsort((half, sizes * 20 // np.maximum(sizes.max(initial=1), 1), parts if len(np.unique(parts)) < 3 else parts * 0))
        self.sizes, self.points, self.parts = sizes[self.order], points[self.order], parts[self.order]
        n = len(sizes)
        self.levels = [[(i, min(i + LEAF, n)) for i in range(0, n, LEAF)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([(below[i][0], below[min(i + 8, len(below)) - 1][1]) for i in range(0, len(below), 8)])
        self.boxes = [
            [(self.points[a:b].max(0), int(self.sizes[a:b].min()), int(self.sizes[a:b].max()), len(np.unique(self.parts[a:b])) == 1 and self.parts[a]) for a, b in level]
            for level in self.levels
        ]

    @staticmethod
    def reaches(overlap, n, m):
        """Whether an overlap of at most so many shingles lets sets of n and m shingles link."""
        return (100 + PERCENT) * overlap >= PERCENT * (n + m)

    def _below(self, level: int, i: int) -> tuple[int, range]:
        """The boxes that a box holds; a leaf stands for itself."""
        return (level - 1, range(8 * i, min(8 * i + 8, len(self.levels[level - 1])))) if level else (0, range(i, i + 1))

    def pairs(self, other: RTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different parts that the bound by coordinate minima leaves.

        They are pairs of this tree's points, or of one of its points and one of the other's;
        they come as arrays of both points' places, those of two leaves at a time.
        """
        tree = other or self
        if not len(self.sizes) or not len(tree.sizes):
            return
        stack = [(len(self.levels) - 1, 0, len(tree.levels) - 1, 0)]
        while stack:
            level, i, level2, j = stack.pop()
            (high, low_n, top_n, own), (high2, low_m, top_m, own2) = self.boxes[level][i], tree.boxes[level2][j]
            if own is not False and own2 is not False and own == own2:
                continue
            if 100 * top_n < PERCENT * low_m or 100 * top_m < PERCENT * low_n:
                continue
            if not self.reaches(int(np.minimum(high, high2).sum()), low_n, low_m):
                continue
            if level or level2:
                down, left = self._below(level, i)
                down2, right = tree._below(level2, j)
                stack += [(down, a, down2, b) for a in left for b in right if other or a <= b or i != j]
                continue
            (a, b), (c, d) = self.levels[0][i], tree.levels[0][j]
            least = np.minimum(self.points[a:b, None, :], tree.points[None, c:d, :]).sum(2)
            fit = self.reaches(least, self.sizes[a:b, None], tree.sizes[None, c:d])
            fit &= self.parts[a:b, None] != tree.parts[None, c:d]
            if not other and i == j:
                fit &= np.tri(b - a, dtype=bool).T
            x, y = np.nonzero(fit)
            if len(x):
                yield self.order[a + x], tree.order[c + y]


def _unpacked(points: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, "<u2" if len(p) == 2 * GROUPS else "<u4") for p in points]).astype(np.int64)


def _block_pairs(own: np.ndarray, low: int, high: int, sizes: np.ndarray, points: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one block, or those across two blocks; each pair of a bucket comes from one task."""
    if low == high:
        yield from RTree(sizes, points, parts).pairs()
        return
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    one, two = (RTree(sizes[at], points[at], parts[at]) for at in (left, right))
    for x, y in one.pairs(two):
        yield left[x], right[y]


def _in_common(x: np.ndarray, y: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many keys the members x and y of each pair share; member i has those at places[starts[i] : starts[i + 1]].

    The pairs are of two leaves, so that few members are laid out at once.
    """
    some, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    held = np.zeros((len(some), int(places.max()) + 1), np.float32)
    for row, i in zip(held, some, strict=True):
        row[places[starts[i] : starts[i + 1]]] = 1
    return (held @ held.T)[at[: len(x)], at[len(x) :]].astype(np.int64)


def _found_pairs(members: DataFrame, points: DataFrame) -> DataFrame:
    """a, b, least, shared: a row per lead and pair, of members (key, lead, rep, part) of one bucket and of different parts.

    The buckets of one lead, mostly those of a group of similar documents, are searched in one tree, so that
    a pair comes once from them, with the keys that it shares there, and not once for each. Leads of
    more than BLOCK members or ROWS keys of members are cut into blocks; each block and each pair of
    blocks is a task's own, so that no task holds a large lead and no pair comes twice. A pair doesn't leave a
    task where what both members have under other leads can't make up what a link of its sizes shows.
    """
    ids = store(members.groupBy("rep").agg(F.count(F.lit(1)).alias("seen")), "ids")
    led = store(members.groupBy("lead", "rep", "part").agg(F.collect_list("key").alias("keys")), "led")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.size("keys")) / ROWS)).cast("int")
    large = store(led.groupBy("lead").agg(blocks.alias("blocks")).filter("blocks > 1"), "large")
    rows = led.join(hinted(large), "lead", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.select("lead", "rep", "part", "keys", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.join(store(points.join(hinted(ids), "rep"), "points"), "rep")
    rows = rows.select("lead", "rep", "n", "point", "seen", "part", "keys", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def search(table):
        reps, sizes, seen = (table[c].to_numpy() for c in ("rep", "n", "seen"))
        found = [(np.empty(0, np.int64),) * 4]
        if len(reps) > 1:
            low, high = table["low"][0].as_py(), table["high"][0].as_py()
            counts = pc.list_value_length(table["keys"]).to_numpy()
            starts = np.cumsum([0, *counts])
            places = np.unique(np.concatenate([c.flatten().to_numpy() for c in table["keys"].chunks]), return_inverse=True)[1]
            for x, y in _block_pairs(table["own"].to_numpy(), low, high, sizes, _unpacked(table["point"].to_pylist()), table["part"].to_numpy()):
                shared, least = _in_common(x, y, starts, places), pair_shown(sizes[x], sizes[y])
                fit = (shared > 0) & (shared + np.minimum(seen[x] - counts[x], seen[y] - counts[y]) >= least)
                x, y = x[fit], y[fit]
                found.append((np.minimum(reps[x], reps[y]), np.maximum(reps[x], reps[y]), least[fit], shared[fit]))
        columns = map(np.concatenate, zip(*found, strict=True))
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "least", "shared"])

    return rows.groupBy("lead", "low", "high").applyInArrow(search, "a long, b long, least long, shared long")


def _tree_pairs(members: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of members that share, under all leads, what a link of their sizes shows."""
    found = _found_pairs(members, points)
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).filter("shared >= least").select("a", "b")


def _shared(rare: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of buckets with members of different parts, each with its bucket's first as ``lead``.

    Rare keys have few rows, which a window takes together. A common key's rows are never
    gathered: each task hands on the first and the last of them.
    """
    by_key = W.partitionBy("key")
    first, high = F.min(F.struct("part", "rep")), F.max("part")
    rare = rare.select("*", F.lit(True).alias("rare"), first.over(by_key).alias("lead"), high.over(by_key).alias("high"))
    rare = rare.filter("lead.part != high").drop("high")
    common = common.withColumn("rare", F.lit(False))
    keys = common.groupBy("key").agg(first.alias("lead"), high.alias("high")).filter("lead.part != high").select("key", "lead")
    return rare.unionByName(common.join(hinted(store(keys, "keys")), "key"))


def _shared_again(rows: DataFrame) -> DataFrame:
    """As ``_shared``, of rows that it gave."""
    of = lambda which: rows.filter(which).drop("rare", "lead")
    return _shared(of("rare"), of("not rare"))


def _replaced(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """Write the new table, then delete the one that it was made of."""
    new = store(new, name)
    forget(old)
    return new


def shingle_links(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Links (a, b) between representatives, enough to connect all that link.

    Documents that share a shingle of their prefixes meet in that shingle's bucket. Documents
    whose buckets show less than any link must are dropped, and buckets of one with them. The
    others are first verified against one leader each, that of most of their buckets, in which
    a large group of near copies collapses; this is repeated while it helps. Members that are
    still apart are then indexed in R-trees of group counts, one for the buckets of a lead: an overlap is
    at most the sum of the coordinates' minima, and what this bound leaves is verified exactly.
    """
    need = 1 + F.floor(MORE * F.col("n") / 100)  # least_shown
    rep, rare = F.col("doc_id"), F.col("rare")
    of = lambda part: prefixes.select(F.explode(part).alias("key"), rep.alias("rep"), rep.alias("part"), "n")
    first, others = F.slice("keys", F.lit(1), rare), F.slice("keys", rare + 1, F.size("keys"))  # rare ones come first
    members = store(_shared(of(first), of(others)).drop("lead"), "members")
    enough = members.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= need).select("rep")
    enough = hinted(store(enough, "enough"))
    members = _replaced(members, _shared_again(members.drop("n").join(enough, "rep", "left_semi")), "members")
    links, tried = None, None
    for _ in range(ROUNDS):
        led = members.filter("part != lead.part").select("rep", F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b"))
        led = led.groupBy("rep", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        led = led if tried is None else led.join(hinted(tried), ["a", "b"], "left_anti")
        best = led.groupBy("rep").agg(F.max_by(F.struct("a", "b"), F.struct("n", -F.col("a"), -F.col("b"))).alias("pair"))
        pairs = store(best.select("pair.a", "pair.b").distinct(), "pairs")
        found = _verified(docs, pairs)
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        n_tried, n_found = pairs.count(), found.count()
        if n_found:
            parts = hinted(store(components(links), "parts"))
            now = members.drop("lead", "part").join(parts, F.col("rep") == F.col("node"), "left")
            now = now.select("key", "rep", F.coalesce("component", "rep").alias("part"), "rare")
            members = _replaced(members, _shared_again(now), "members")
        if n_found <= HELPS * n_tried:
            break
    points = prefixes.select(F.col("doc_id").alias("rep"), "n", "point")
    pairs = store(_tree_pairs(members.select("key", F.col("lead.rep").alias("lead"), "rep", "part"), points).join(hinted(tried), ["a", "b"], "left_anti"), "pairs")
    forget(members)
    return links.unionByName(_verified(docs, pairs))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Group documents whose sets of 5-word shingles link, at a Jaccard similarity of 0.75.

    Documents of equal sets form a class, represented by its least id; only representatives
    are compared. Null and empty texts have no shingles and link with nothing. Rows of one id
    are one document. Rows of a null id get a null component and link nothing. Texts of any length
    are read whole; a set is taken as a whole by the task that compares it. Other columns are
    ignored, whatever their names. An empty table gives an empty one.

    Returns:
        doc_id, n_shingles, component_id: a row per input row.
    """
    with scope() as kept:
        own, told = _classes_and_components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        kept += [own, told]
    out = own.join(told, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _classes_and_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: doc_id, n, digest of every document; digest, component_id of every class of equal sets."""
    with batches_of(docs.sparkSession, BATCH):
        made = store(_prefixes(docs, common_slots(docs)), "prefixes")
    own = store(made.select("doc_id", "n", "digest"), "digests")
    sets = made.filter("n > 0 and doc_id is not null")
    classes = store(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")), "classes")
    copied = classes.filter("n_copies > 1").select("digest", "rep")
    spare = sets.select("doc_id", "digest").join(hinted(copied), "digest").filter("doc_id != rep").select("doc_id", "digest")
    firsts = sets.join(hinted(store(spare, "spare")), ["doc_id", "digest"], "left_anti")
    parts = components(shingle_links(docs.filter("doc_id is not null"), firsts))
    forget(made)
    told = classes.join(hinted(store(parts, "parts")), F.col("rep") == F.col("node"), "left")
    return own, store(told.select("digest", F.coalesce("component", "rep").alias("component_id")), "told")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least id, with all its columns."""
    with scope() as kept:
        found = store(jaccard_components(docs).filter("doc_id != component_id").select("doc_id").distinct(), "dropped")
        kept.append(found)
    gone = "__skein_gone"
    dropped = hinted(found.withColumnRenamed("doc_id", gone))
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped[gone], "left_anti")
