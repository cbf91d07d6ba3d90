"""Size-aware n-gram Jaccard join and its components.

Documents with the same set of word shingles are one node. Every node is filed under
keys, so that two sets that link share a key:

- a small set under its subsets of the fixed sizes that an intersection with any partner
  must have;
- a large set under its least hashed shingles, as many as a partner can't all miss; the
  inverted list of such a key is scanned. The size where scanning gets cheaper than
  enumerating is the boundary. Where parts (below) would be thin, shingles are counted
  first and those of long lists come last in every set, so that a passage which many
  documents share files none of them that has enough shingles besides. Any order that all
  sets share is exact, so counts and their filter may be off without losing a link.

Short lists give their pairs. Long lists (of a shingle that many documents have) are not
paired: their nodes are filed anew under the parts of a partition of their set, with one
part more than two linked sets can differ in shingles, so linked sets share a part.
A long list of a part is a group of near copies. Its members are compared with the one
in most groups, the pivot. Members that link with it are joined through it. In a group
that has others, members are compared chunk by chunk, by the few shingles in which they
differ from the pivot, inside tasks that give edges joining what links; no pair of the
group becomes a row. Pairs of short lists are compared by parts first (sets that differ
in more parts than they may in shingles don't link), and then by whole sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafaudit.llm.common import document_key, each_batch, stored, text_or_empty
from leafaudit.llm.exact import filter_bits, places
from leafaudit.operators.boxes import component_labels

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CACHE_WORDS = 400_000
#: Mean members of a chunk of a group.
CHUNK = 400
#: Parts of fewer shingles than this on average are thin: many hold just common shingles.
THIN = 6
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values, one to one for a given salt."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles of texts, as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[bytes, int] = {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
        every = set().union(*split)
        new = every - self.words.keys()
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = every
        self.words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        get = self.words.__getitem__
        out = []
        for words in split:
            if len(words) < self.width:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 11)] if words else [], np.uint64))
                continue
            h = np.fromiter(map(get, words), np.uint64, len(words))
            n = len(h) - self.width + 1
            x = h[:n] * C1
            for i in range(1, self.width):
                x = ((x ^ (x >> np.uint64(29))) + h[i : i + n]) * (C2 if i % 2 else C3)
            out.append(np.unique(x ^ (x >> np.uint64(32))))
        return out


@dataclass(frozen=True)
class Scheme:
    """Keys of sets for links of den * intersection >= num * union."""

    num: int
    den: int
    list_cost: float = 8.0
    growth: float = 1.3

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, s: int) -> range:
        return range(-(-self.num * s // self.den), self.den * s // self.num + 1)

    def prefix(self, s: int) -> int:
        return s + 1 - (-(-self.num * s // self.den))

    @lru_cache(maxsize=None)  # noqa: B019
    def subset_sizes(self, s: int, limit: int) -> tuple[int, ...]:
        sizes = {self.overlap(s, b) for b in self.partners(s) if b <= limit}
        return tuple(sorted(c for c in sizes if c <= s))

    @cached_property
    def boundary(self) -> int:
        """Largest size up to which all subsets cost less keys than scanning lists does."""
        s = 1
        while sum(math.comb(s + 1, c) for c in self.subset_sizes(s + 1, 1 << 30)) <= self.list_cost * self.prefix(s + 1):
            s += 1
        return s

    @lru_cache(maxsize=None)  # noqa: B019
    def size_class(self, s: int) -> tuple[int, int, int]:
        """Number, first and last size of the class of a size."""
        first, number = 1, 0
        while True:
            after = max(first + 1, int(first * self.growth))
            if s < after:
                return number, first, after - 1
            first, number = after, number + 1

    def part_count(self, last: int) -> int:
        return 2 * last * (self.den - self.num) // (self.den + self.num) + 1

    @property
    def thin(self) -> bool:
        """Whether the parts of a set hold few shingles each."""
        return self.den + self.num < 2 * THIN * (self.den - self.num)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Keys of a set whose shingles come in an order that all sets share."""
        s = len(tokens)
        out = []
        if s and s <= self.boundary:
            spread = mix(tokens, 3)
            total = spread.sum(dtype=np.uint64)
            for c in self.subset_sizes(s, self.boundary):
                dropped = itertools.combinations(range(s), s - c)
                sums = np.array([spread[list(d)].sum(dtype=np.uint64) for d in dropped], np.uint64)
                sums = np.full(len(sums), total) - sums
                out.append(mix(sums, 5 + c))
        if s and self.den * s >= self.num * (self.boundary + 1):
            out.append(mix(tokens[: self.prefix(s)], 2))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)

    def parts(self, tokens: np.ndarray, last: int) -> np.ndarray:
        """A value for each part of the set, in the partition for sizes up to last."""
        m = self.part_count(last)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, (tokens % np.uint64(m)).astype(np.int64), mix(tokens, 4))
        return mix(sums + mix(np.arange(m, dtype=np.uint64), last), 6)

    def both_parts(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts in the set's own class, and in the next class if a partner may be there."""
        s = len(tokens)
        if not s:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        _, _, last = self.size_class(s)
        up = self.parts(tokens, self.size_class(last + 1)[2]) if self.den * s >= self.num * (last + 1) else np.empty(0, np.uint64)
        return self.parts(tokens, last), up


def list_array(items: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, items)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*items, np.empty(0, np.uint64)]).view(np.int64)))


def node_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), len(tokens))).view(np.int64))


def filled_filter(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter, and its size in bits, of a table's one column of integers. The size is bounded."""
    bits = filter_bits(rows.count())

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()] = True
        if seen.any():
            packed = np.packbits(seen)
            step = 1 << 15
            for at in range(0, len(packed), step):
                if packed[at : at + step].any():
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([packed[at : at + step].tobytes()], pa.binary())], ["at", "part"])

    filled = np.zeros(bits // 8, np.uint8)
    for r in rows.coalesce(4).mapInArrow(marks, "at long, part binary").toLocalIterator():
        part = np.frombuffer(r.part, np.uint8)
        filled[r.at : r.at + len(part)] |= part
    return filled, bits


def passes(filled: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: all it was filled with, and a few others."""
    at = places(hashes, bits)
    return ((filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def frequent_filter(docs: DataFrame, width: int, most: int) -> tuple[np.ndarray, int]:
    """Filter of the shingles, named by 32 bits, that more than most rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in each_batch(batches, 256):
            tokens = np.concatenate([*shingler.sets(batch.column(0).to_pylist()), np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.uint32).view(np.int32))], ["shingle"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(mix(names.astype(np.uint64)).view(np.int64))], ["hash"])

    counts = docs.select("text").mapInArrow(run, "shingle int").groupBy("shingle").agg(F.count("*").alias("c"))
    frequent = counts.filter(F.col("c") > most).select("shingle").mapInArrow(spread, "hash long")
    return filled_filter(stored(frequent, "near-frequent"))


def signatures(docs: DataFrame, scheme: Scheme, width: int, frequent: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(doc_id, row, n, node, last, keys, own, up) of each row; row is a hash of id and text.
    Keys come from sets in the order of their hashes, with those that the filter of
    frequent shingles lets through last."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def ordered(sets: list[np.ndarray]) -> list[np.ndarray]:
        if shared.value is None or not any(map(len, sets)):
            return sets
        tokens = np.concatenate(sets)
        late = np.split(passes(*shared.value, mix(tokens & np.uint64(0xFFFFFFFF))), np.cumsum([len(t) for t in sets])[:-1])
        return [np.concatenate([t[~f], t[f]]) if f.any() else t for t, f in zip(sets, late, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in each_batch(batches, 256):
            sets = shingler.sets(batch.column(2).to_pylist())
            pairs = [scheme.both_parts(t) for t in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(t) for t in sets], pa.int64()), pa.array([node_of(t) for t in sets], pa.int64()),
                    pa.array([scheme.size_class(len(t))[2] if len(t) else 0 for t in sets], pa.int64()),
                    list_array([scheme.keys(t) for t in ordered(sets)]), list_array([p[0] for p in pairs]), list_array([p[1] for p in pairs]),
                ],
                ["doc_id", "row", "n", "node", "last", "keys", "own", "up"],
            )

    return docs.mapInArrow(run, "doc_id long, row long, n long, node long, last long, keys array<long>, own array<long>, up array<long>")


def split_lists(postings: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Lists of (key, node) postings: the short ones as distinct sorted arrays of 2 nodes or
    more, and the postings of the long ones. Lengths are counted before any row moves to
    its list, so a long list stays spread."""
    counts = postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    met = postings.join(counts, "key")
    short = met.filter(F.col("c") <= most).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes")).filter("size(nodes) > 1").select("nodes").distinct()
    return short, met.filter(F.col("c") > most).select("key", "node")


def pairs_of(lists: DataFrame) -> DataFrame:
    """Distinct pairs a < b of the nodes of short lists."""
    firsts = F.transform("nodes", lambda x, i: F.struct(x.alias("a"), F.slice("nodes", i + 2, F.size("nodes")).alias("rest")))
    return lists.select(F.explode(firsts).alias("p")).select("p.a", F.explode("p.rest").alias("b")).distinct()


class Joiner:
    """State of one join: signatures, the scheme and the candidates' sets."""

    def __init__(self, docs: DataFrame, scheme: Scheme, width: int, doc_id: str, text: str, most: int):
        key = F.xxhash64(*document_key(doc_id, text))
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("row"), text_or_empty(text).alias("text"))
        self.scheme, self.width, self.most = scheme, width, most
        frequent = frequent_filter(self.docs, width, most) if scheme.thin else None
        self.signed = stored(signatures(self.docs, scheme, width, frequent), "near-signatures")

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and parts allow a link."""
        num, den = self.scheme.num, self.scheme.den
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # one byte of each part's value: equal bytes may hide a difference, but none is made up
        met = self.signed.join(wanted, "node", "left_semi").select("node", "n", "last", *[F.transform(c, lambda x: (F.pmod(x, F.lit(256)) - 128).cast("tinyint")).alias(c) for c in ("own", "up")])
        facts = stored(met.dropDuplicates(["node"]), "near-facts")
        side = lambda p: facts.select(F.col("node").alias(p), *[F.col(c).alias(p + c) for c in ("n", "last", "own", "up")])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        flip = F.col("an") > F.col("bn")
        low, high = F.least("an", "bn"), F.greatest("an", "bn")
        same = F.col("alast") == F.col("blast")
        left = F.when(same | flip, F.col("aown")).otherwise(F.col("aup"))
        right = F.when(same | ~flip, F.col("bown")).otherwise(F.col("bup"))
        differ = F.size(F.filter(F.zip_with(left, right, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
        least = F.ceil((low + high) * num / (num + den))
        return both.filter((low * den >= high * num) & (F.size(left) == F.size(right))).filter(differ <= low + high - 2 * least).select("a", "b")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(node, tokens) of the nodes of these pairs, from the rows that a Bloom filter of
        their row keys lets through; a false hit only adds a row. The filter is bounded."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        rows = stored(self.signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")).select("row"), "near-rows")
        filled, bits = filled_filter(rows)
        shared = self.docs.sparkSession.sparkContext.broadcast(filled)
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(width)
            for batch in each_batch(batches, 1024):
                hit = np.flatnonzero(passes(shared.value, bits, batch.column(0).to_numpy(zero_copy_only=False)))
                tokens = shingler.sets(batch.column(1).take(pa.array(hit)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["node", "tokens"])

        found = self.docs.select("row", "text").mapInArrow(run, "node long, tokens binary")
        return stored(found.join(wanted, "node", "left_semi"), "near-sets").dropDuplicates(["node"])

    def compared(self, pairs: DataFrame, sets: DataFrame, differences: bool) -> DataFrame:
        """(a, b, linked) by whole sets, and if asked for the shingles in which they differ."""
        scheme = self.scheme
        num, den = scheme.num, scheme.den
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("bt")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("at")), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in each_batch(batches, 256):
                linked, far, size = [], [], []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(den * common >= num * (len(x) + len(y) - common))
                    far.append(np.setxor1d(x, y, assume_unique=True) if differences else x[:0])
                    size.append(len(y))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), list_array(far), pa.array(size, pa.int64())], ["a", "b", "linked", "far", "size"])

        return both.select("a", "b", "at", "bt").mapInArrow(run, "a long, b long, linked boolean, far array<long>, size long")

    def within(self, star: DataFrame) -> DataFrame:
        """Links within the groups that hold a member not linked to its pivot, as edges that
        join what is linked. Members are dealt into chunks, and a task compares two chunks
        of a group by the shingles in which they differ from the pivot: it holds two chunks,
        and gives at most an edge for each of their members."""
        num, den = self.scheme.num, self.scheme.den
        sizes = star.groupBy("a").agg(F.count("*").alias("members"), F.bool_or(~F.col("linked")).alias("open")).filter("open")
        chunks = F.ceil(F.col("members") / CHUNK).cast("int")
        dealt = star.join(sizes, "a").select("a", "b", "linked", "far", "size", F.pmod(F.xxhash64("b"), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        dealt = dealt.select("a", "b", "linked", "far", "size", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            nodes, size = table.column("b").to_numpy(), table.column("size").to_numpy()
            tied = table.column("linked").to_numpy(zero_copy_only=False).astype(bool)
            far = table.column("far").combine_chunks()
            length = far.value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(nodes)), length)
            _, at, met = np.unique(far.flatten().to_numpy(), return_inverse=True, return_counts=True)
            shared = met[at] > 1
            names, column = np.unique(at[shared], return_inverse=True)
            row, common = row[shared], np.zeros((len(nodes), len(nodes)), np.float32)
            for slab in range(0, len(names), 4096):
                part = (column >= slab) & (column < slab + 4096)
                marks = np.zeros((len(nodes), min(4096, len(names) - slab)), np.float32)
                marks[row[part], column[part] - slab] = 1
                common += marks @ marks.T
            both = (size[:, None] + size - (length[:, None] + length - 2 * common)) / 2
            near = (den * both >= num * (size[:, None] + size - both)) & ~(tied[:, None] & tied)
            np.fill_diagonal(near, False)
            seen, edges = np.zeros(len(nodes), bool), []
            for root in np.flatnonzero(near.any(axis=1)):
                stack = [] if seen[root] else [root]
                seen[root] = True
                while stack:
                    here = stack.pop()
                    new = np.flatnonzero(near[here] & ~seen)
                    seen[new] = True
                    stack += new.tolist()
                    edges += [(int(nodes[here]), int(nodes[x])) for x in new]
            return pa.table([pa.array([min(e) for e in edges], pa.int64()), pa.array([max(e) for e in edges], pa.int64())], names=["a", "b"])

        return dealt.groupBy("a", "low", "high").applyInArrow(run, "a long, b long")

    def links(self) -> DataFrame:
        """Edges (a, b) between nodes that join all linked nodes into their components."""
        nodes = self.signed.filter("n > 0")
        short, long = split_lists(nodes.select(F.explode("keys").alias("key"), "node"), self.most)
        crowded = stored(long.select("node").distinct(), "near-crowded")
        lists = stored(short, "near-lists")
        filed = nodes.join(crowded, "node", "left_semi").select("node", F.explode(F.concat("own", "up")).alias("key")).distinct()
        short, long = split_lists(filed, self.most)
        lists = lists.unionByName(stored(short, "near-lists"))
        groups = stored(long, "near-groups")
        pairs = stored(self.passing(stored(pairs_of(lists), "near-pairs")), "near-pairs")
        central = groups.join(groups.groupBy("node").agg(F.count("*").alias("degree")), "node")
        pivots = central.groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("a"))
        stars = stored(groups.join(pivots, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "near-stars")
        sets = self.sets(pairs.unionByName(stars))
        met = self.compared(pairs, sets, False).filter("linked").select("a", "b")
        star = stored(self.compared(stars, sets, True), "near-stars")
        return met.unionByName(star.filter("linked").select("a", "b")).unionByName(self.within(star))


def near_components(docs: DataFrame, *, width: int = 5, num: int = 8, den: int = 10, most: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, row, n_shingles, component_id).

    A document's set holds the distinct shingles of width words (of its lower-cased words;
    with fewer words, the whole sequence). Documents link when den * intersection >=
    num * union; component_id is the least id that links reach. Null or empty texts have
    no shingles and link with nothing, so their component is their own id. Repeated rows
    each give a row; a null id is reached by links but never names a component that has
    another. row is a hash of id and text. most is the longest list that gives all its
    pairs; longer ones go the other way described above, so it drops nothing."""
    joiner = Joiner(docs, Scheme(num, den), width, doc_id, text, most)
    edges = joiner.links().select(F.lit(0).alias("book"), F.lit(0).alias("page"), "a", "b").distinct()
    labels = component_labels(stored(edges, "near-edges")).select("node", "label")
    rows = joiner.signed.select("doc_id", "row", "n", "node").join(labels, "node", "left")
    rows = stored(rows.select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("label")), "near-labels")
    full, empty = rows.filter("n_shingles > 0"), rows.filter("n_shingles = 0")
    names = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = full.join(names, "label").select("doc_id", "row", "n_shingles", "component_id")
    return out.unionByName(empty.select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id")))
