"""Exact n-gram Jaccard join: rare-first prefixes find groups, prefix trees verify them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ontocat.llm.common import components, cut, free_name, sorted_runs
from ontocat.operators.joins import broadcast_if_bounded

NGRAM = 3
SIMILARITY = (90, 100)
#: Counters of the frequency sketch that orders the n-grams: 4 bytes each, whatever the input.
SKETCH_BITS = 20
#: Parity bits of every set, and of sets of more n-grams than ``LONG``, which the few bits can't tell apart.
SHORT_BITS = 128
LONG_BITS = 4_096
LONG = 128
#: Bits of the filter that keeps documents without candidates out of the verifying join.
FILTER_BITS = 23
#: Rows of a prefix n-gram, and members of a candidate group, that one task compares at a time.
RUN_ROWS = 8_192
GROUP_ROWS = 512
#: Groups told apart by bits alone are dealt in parts so many times larger; runs from so many rows on are walked, not paired.
BITS_ROWS = 8
WALKED_ROWS = 32

_SLICE = 4_096
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of the words that this worker has seen, some 10 MB at most."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def ngram_set(text: bytes | None, ngram: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a whole text.

    Words are runs without ASCII white space, A-Z lowered. A text of fewer words
    is one n-gram; without words the set is empty.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(ngram, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        out = (out ^ hashes[at:len(words) - width + 1 + at]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def parity_bits(grams: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` parity bits as 64-bit words: two sets differ in at least as many n-grams as their bits differ."""
    odd = (np.bincount((grams >> np.uint64(9)).astype(np.int64) & bits - 1, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def overlap(n: int, m: int, similarity: tuple[int, int]) -> int:
    """The least common n-grams with which sets of ``n`` and ``m`` are similar enough."""
    part, whole = similarity
    return -(-part * (n + m) // (part + whole))


def _counters(rows: DataFrame, hashes, bits: int) -> np.ndarray:
    """How often each of ``2 ** bits`` counters is hit by the ``hashes`` (64 bits) of the rows' only column.

    Tasks count all their rows into one array and hand it on in slices; slices
    are added up as they stream in. The result has a fixed size.
    """
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for found in hashes(batch.column(0)):
                np.add.at(sums, (found >> shift).astype(np.int64), 1)
        yield from _slices(enumerate(sums.reshape(-1, min(_SLICE, 1 << bits))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(values, np.uint32)
                sums[at] = sums[at] + part if at in sums else part.copy()
        yield from _slices(sums.items())

    schema = "slice int, counts binary"
    out = np.zeros(1 << bits, np.uint32).reshape(-1, min(_SLICE, 1 << bits))
    for r in rows.mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def _sketch(docs: DataFrame, ngram: int, bits: int) -> np.ndarray:
    """How many documents' n-grams fall on each counter."""
    return _counters(docs.select("text"), lambda texts: (ngram_set(t.as_py(), ngram) for t in texts), bits)


def _only_members(rows: DataFrame, members: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` whose ``hash`` may be one of ``members (hash)``: a bit set of fixed size is broadcast and read in the scan.

    It lets through what it can't tell apart, so a join must follow; it spares
    that join's shuffle the texts of documents without any candidate.
    """
    found = _counters(members.select("hash"), lambda hashes: [_scrambled(hashes)], bits)
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(found > 0))

    @arrow_udf("boolean")
    def may_be(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in hashes:
            at = (_scrambled(chunk) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.array(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1)
    return rows.filter(may_be("hash"))


def _scrambled(hashes: pa.Array) -> np.ndarray:
    return hashes.to_numpy(zero_copy_only=False).view(np.uint64) * _MIX


def _slices(parts) -> Iterator[pa.RecordBatch]:
    used = [(int(at), values.tobytes()) for at, values in parts if values.any()]
    if used:
        at, values = zip(*used)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values, pa.binary())], ["slice", "counts"])


def _prefixes(shared, ngram: int, similarity: tuple[int, int], run_rows: int, long: int):
    """Per text: set size, set key, parity bits and its rare-first prefix with the parts of hot n-grams."""
    part, whole = similarity

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        shift = np.uint64(64 - (len(counts).bit_length() - 1))
        hot = max(run_rows, 8 * int(counts.mean()))
        for batch in batches:
            n, keys, low, high, tokens, parts, many = [], [], [], [], [], [], []
            for text in batch.column(2):
                grams = ngram_set(text.as_py(), ngram)
                size = len(grams)
                often = counts[(grams >> shift).astype(np.int64)]
                first = np.lexsort((grams, often))[:size + 1 + (-part * size // whole) if size else 0]
                a, b = parity_bits(grams, SHORT_BITS).view(np.int64)
                n.append(size)
                keys.append(set_key(grams))
                low.append(int(a))
                high.append(int(b))
                many.append(parity_bits(grams, LONG_BITS).tobytes() if size > long else None)
                tokens.append(grams[first].view(np.int64))
                part_of = (-(-often[first].astype(np.int64) // hot)).astype(np.int32)
                parts.append(part_of if (part_of > 1).any() else None)  # mostly all 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(keys, pa.binary()),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(tokens, pa.list_(pa.int64())),
                 pa.array(parts, pa.list_(pa.int32())), pa.array(many, pa.binary())],
                ["doc_id", "hash", "n", "key", "low", "high", "tokens", "parts", "many"])
    return describe


def _in_parts(rows: DataFrame, group: list[str], parts: str) -> DataFrame:
    """Deals a group's rows into ``parts`` parts and every pair of parts; a group of one part stays as it is.

    ``alone`` tells in a row of one part that this pair is its own part with itself.
    """
    own = F.pmod(F.xxhash64("key"), F.col(parts)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return (rows.withColumn("pair", F.least("own", "other") * F.col(parts) + F.greatest("own", "other"))
            .withColumn("alone", F.col("own") == F.col("other")).withColumnRenamed("own", "part")
            .drop("other", parts).repartition(*group, "pair"))


class Links:
    """Union-find that keeps the links that joined something."""

    def __init__(self):
        self.parent: dict = {}
        self.links: list[tuple] = []

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def add(self, x, y) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[b] = a
            self.links.append((x, y))


def _edge_batch(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _walked(rows: np.ndarray, near) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of ``rows`` as ``(row, rows found from it)``; ``near(row, others)`` tells which of the others are near.

    Rows go once they are found, so a group of copies costs its size, not its pairs.
    """
    while len(rows):
        todo, rows = [rows[0]], rows[1:]
        while todo and len(rows):
            at = todo.pop()
            found = near(at, rows)
            if found.any():
                yield int(at), rows[found]
                todo += rows[found].tolist()
                rows = rows[~found]


def _candidates(similarity: tuple[int, int]):
    """Sets that share a prefix n-gram and that size, position and parity bits can't tell apart, as a spanning forest."""
    part, whole = similarity

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["token", "pair"]):
            token, pair, n, pos, low, high = (table[c].to_numpy() for c in ("token", "pair", "n", "pos", "low", "high"))
            same = (token[1:] == token[:-1]) & (pair[1:] == pair[:-1])
            run = np.cumsum(np.r_[True, ~same])
            n, left = n.astype(np.int64), n.astype(np.int64) - pos
            low, high = low.view(np.uint64), high.view(np.uint64)
            key = table["key"]

            def near(one, other) -> np.ndarray:
                both = n[one] + n[other]
                need = -(-part * both // (part + whole))
                apart = (np.bitwise_count(low[one] ^ low[other]).astype(np.int64)
                         + np.bitwise_count(high[one] ^ high[other]))  # of unsigned words: signed ones count |x|
                return (np.minimum(left[one], left[other]) >= need) & (apart <= both - 2 * need)

            def near_by_size(one, other) -> np.ndarray:
                sizes, found = n[other], np.zeros(len(other), bool)  # rows of a run are sorted by size
                a, z = np.searchsorted(sizes, -(-n[one] * part // whole)), np.searchsorted(sizes, n[one] * whole // part, "right")
                found[a:z] = near(one, other[a:z])
                return found

            links, step = Links(), 1
            length = np.bincount(run)
            heads = np.flatnonzero(np.r_[True, ~same])
            for a in heads[length[run[heads]] >= WALKED_ROWS].tolist():
                for x, found in _walked(np.arange(a, a + length[run[a]]), near_by_size):
                    one = key[x].as_py()
                    for other in key.take(pa.array(found)).to_pylist():
                        links.add(one, other)
            rows = np.flatnonzero(np.r_[same, False] & (length[run] < WALKED_ROWS))
            while len(rows):
                rows = rows[rows + step < len(run)]
                rows = rows[run[rows] == run[rows + step]]
                rows = rows[n[rows + step] * part <= n[rows] * whole]
                found = rows[near(rows, rows + step)]
                for x, y in zip(key.take(pa.array(found)).to_pylist(), key.take(pa.array(found + step)).to_pylist()):
                    links.add(x, y)
                step += 1
            if links.links:
                yield _edge_batch(links.links)
    return find


def _refined(similarity: tuple[int, int]):
    """Members of a group that size and all their parity bits can't tell apart, as a spanning forest."""
    part, whole = similarity

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["component", "pair"]):
            keys, group, pair, many = (table[c].to_pylist() for c in ("key", "component", "pair", "many"))
            n, low, high = (table[c].to_numpy() for c in ("n", "low", "high"))
            n, bits = n.astype(np.int64), np.stack([low, high], axis=1).view(np.uint64)
            nothing = bytes(LONG_BITS // 8)
            links, a = Links(), 0
            for z in range(1, len(keys) + 1):
                if z < len(keys) and (group[z], pair[z]) == (group[a], pair[a]):
                    continue
                long = np.array([many[r] is not None for r in range(a, z)])
                more = np.frombuffer(b"".join(many[r] or nothing for r in range(a, z)), np.uint64).reshape(z - a, -1)

                def near(at, rest) -> np.ndarray:
                    both = n[at] + n[rest]
                    allowed = both + 2 * (-part * both // (part + whole))  # n + m - 2 * least overlap
                    found = ((n[rest] * part <= n[at] * whole) & (n[at] * part <= n[rest] * whole)
                             & (np.bitwise_count(bits[at] ^ bits[rest]).sum(axis=1, dtype=np.int64) <= allowed))
                    if long[at - a] and (too := np.flatnonzero(found & long[rest - a])).size:
                        apart = np.bitwise_count(more[at - a] ^ more[rest[too] - a]).sum(axis=1, dtype=np.int64)
                        found[too] = apart <= allowed[too]
                    return found

                for at, found in _walked(np.arange(a, z), near):
                    for other in found.tolist():
                        links.add(keys[at], keys[other])
                a = z
            if links.links:
                yield _edge_batch(links.links)
    return refine


class Trie:
    """A prefix tree of sets whose n-grams are in one global order, each edge a run of n-grams.

    Sets are numbered in tree order. A node knows the numbers, the smallest and
    the largest set below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.nodes: list[tuple] = []  # start, stop, set, first, last + 1, least size, largest size, children
        self.above: list[int] = []  # the node above each node; the root's is -1
        self.leaf = [0] * len(sets)
        self.root = self._build(0, len(sets), 0)
        self.left = [node[4] - node[3] for node in self.nodes]  # sets below a node that have not gone

    def _common(self, a: int, b: int, depth: int) -> int:
        """Length of the common prefix of two sets, known to be ``depth`` at least."""
        x, y = self.sets[a][depth:], self.sets[b][depth:]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return depth + (int(differ[0]) if len(differ) else m)

    def _build(self, first: int, stop: int, depth: int) -> int:
        """Nodes of the sets ``first .. stop`` below ``depth``, without recursion."""
        todo, root = [(first, stop, depth, None)], len(self.nodes)
        while todo:
            a, z, start, parent = todo.pop()
            end = self._common(a, z - 1, start) if z - a > 1 else len(self.sets[a])
            sizes = [len(s) for s in self.sets[a:z]]
            self.nodes.append((start, end, a, a, z, min(sizes), max(sizes), []))
            self.above.append(-1 if parent is None else parent)
            if parent is not None:
                self.nodes[parent][7].append(len(self.nodes) - 1)
            if z - a == 1:
                self.leaf[a] = len(self.nodes) - 1
            at, me = a, len(self.nodes) - 1
            while at < z and z - a > 1:
                if len(self.sets[at]) == end:  # a set that ends here is the first below
                    todo.append((at, at + 1, end, me))
                    at += 1
                    continue
                head, low, high = self.sets[at][end], at + 1, z
                while low < high:
                    middle = (low + high) // 2
                    if self.sets[middle][end] == head:
                        low = middle + 1
                    else:
                        high = middle
                todo.append((at, low, end, me))
                at = low
        return root

    def remove(self, at: int) -> None:
        """Has a set found no more."""
        node = self.leaf[at]
        while node >= 0:
            self.left[node] -= 1
            node = self.above[node]

    def similar(self, query: int, marked: np.ndarray, similarity: tuple[int, int], known=None) -> Iterator[int]:
        """Sets that are similar to ``query`` and have not been removed; with ``known``, those after ``query``.

        Overlap up to a node is counted once for all sets below it. A subtree
        goes when even all that is left of the query, or of its largest set,
        could not reach the overlap that its smallest set needs, when none of
        its sets is left, or when the one set in it is ``known``: reported by
        another tree.
        """
        mine = self.sets[query]
        size, (part, whole) = len(mine), similarity
        todo = [(self.root, 0)]
        while todo:
            node, common = todo.pop()
            start, stop, owner, first, last, least, most, below = self.nodes[node]
            if not self.left[node] or least * part > size * whole or most * whole < size * part:
                continue
            if known and (last <= query + 1 or last - first == 1 and known(first)):
                continue
            if stop > start:
                edge = self.sets[owner][start:stop]
                common += int(np.count_nonzero(marked[edge]))
                rest = size - int(np.searchsorted(mine, edge[-1], "right"))
            else:
                rest = size
            need = overlap(size, max(least, -(-size * part // whole)), similarity)
            if common + min(rest, most - stop) < need:
                continue
            if last - first == 1:
                if common >= overlap(size, least, similarity):
                    yield first
            else:
                todo += [(child, common) for child in below]


def similar_links(sets: list[np.ndarray], similarity: tuple[int, int], skip=None) -> list[tuple[int, int]]:
    """Links that connect whatever similar pairs connect, by a prefix tree over the sets.

    With ``skip``, all similar pairs but those of sets for which it holds.
    N-grams are ordered by how many of the sets have them, most first, so that
    near copies share long paths.
    """
    if len(sets) < 2:
        return []
    grams, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -counts))] = np.arange(len(grams))
    ordered = [np.sort(x) for x in np.split(rank[where], np.cumsum([len(s) for s in sets])[:-1])]
    order = sorted(range(len(sets)), key=lambda i: ordered[i].astype(">i8").tobytes())
    trie = Trie([ordered[i] for i in order])
    marked, found = np.zeros(len(grams), bool), []

    def similar_to(query: int, known=None) -> list[int]:
        marked[trie.sets[query]] = True
        others = list(trie.similar(query, marked, similarity, known))
        marked[trie.sets[query]] = False
        return others

    if skip:
        for query in range(len(sets)):
            found += [(query, x) for x in similar_to(query, lambda x: skip(order[query], order[x]))]
    else:  # sets go once they are found, so a group of copies costs its size, not its pairs
        gone = [False] * len(sets)
        for first in range(len(sets)):
            if gone[first]:
                continue
            trie.remove(first)
            todo = [first]
            while todo:
                query = todo.pop()
                others = similar_to(query)
                for x in others:
                    gone[x] = True
                    trie.remove(x)
                found += [(query, x) for x in others]
                todo += others
    return [(order[a], order[b]) for a, b in found]


def _verified(ngram: int, similarity: tuple[int, int]):
    """Links between the documents of a group, found in a prefix tree of their n-gram sets."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["component", "pair"]):
            keys, group, pair = (table[c].to_pylist() for c in ("key", "component", "pair"))
            texts, found, a = table["text"], [], 0
            for z in range(1, len(keys) + 1):
                if z == len(keys) or (group[z], pair[z]) != (group[a], pair[a]):
                    rows = list({keys[r]: r for r in range(a, z)}.values())  # a repeated row counts once
                    sets = [ngram_set(texts[r].as_py(), ngram) for r in rows]
                    found += [(keys[rows[x]], keys[rows[y]]) for x, y in similar_links(sets, similarity)]
                    a = z
            if found:
                yield _edge_batch(found)
    return verify


def _all_verified(ngram: int, similarity: tuple[int, int], pairs: bool):
    """All similar pairs of a group's classes, each from one tree; or, of each class, the documents linked in a tree and a forest."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["component", "pair"]):
            keys, group, pair, part, alone, copies = (table[c].to_pylist() for c in (
                "key", "component", "pair", "part", "alone", "copies"))
            texts, a = table["text"], 0
            for z in range(1, len(keys) + 1):
                if z < len(keys) and (group[z], pair[z]) == (group[a], pair[a]):
                    continue
                rows = list({keys[r]: r for r in range(a, z)}.values())
                sets = [ngram_set(texts[r].as_py(), ngram) for r in rows]
                # pairs inside one part are reported where the part is alone
                found = similar_links(sets, similarity, lambda x, y: part[rows[x]] == part[rows[y]] and not alone[rows[x]])
                found = [(rows[x], rows[y]) for x, y in found]
                if found and pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r in side], pa.binary()) for side in zip(*found)], ["a", "b"])
                elif found:
                    links, n = Links(), dict.fromkeys(rows, 0)
                    for x, y in found:
                        links.add(x, y)
                        n[x], n[y] = n[x] + copies[y], n[y] + copies[x]
                    out = [(keys[x], keys[y], None) for x, y in links.links] + [(keys[r], None, n[r]) for r in rows if n[r]]
                    one, other, linked = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(other, pa.binary()),
                                                      pa.array(linked, pa.int64())], ["a", "b", "n_links"])
                a = z
    return verify


def _once(ngram: int):
    """Rows whose text is the set that their key stands for, each key once per task."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for at, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen and set_key(ngram_set(batch.column(3)[at].as_py(), ngram)) == key:
                    seen.add(key)
                    keep.append(at)
            yield batch.take(pa.array(keep, pa.int64()))
    return pick


def _grouped(docs: DataFrame, doc_id: str, text: str, ngram: int, similarity: tuple[int, int], sketch_bits: int = SKETCH_BITS,
             run_rows: int = RUN_ROWS, group_rows: int = GROUP_ROWS, long: int = LONG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described documents, the classes of equal sets, and the texts of classes that may have similar ones, dealt by group."""
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(docs[text]).alias("hash"),
                       docs[text].cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(_sketch(rows, ngram, sketch_bits))
    described = cut(rows.mapInArrow(
        _prefixes(shared, ngram, similarity, run_rows, long),
        "doc_id bigint, hash bigint, n int, key binary, low bigint, high bigint, tokens array<bigint>, parts array<int>, "
        "many binary"))
    worded = described.filter("n > 0")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash"))
    classes = cut(worded.groupBy("key").agg(smallest.alias("least"), F.count(F.lit(1)).alias("copies")))
    sets = worded.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "low", "high", "tokens", "parts")])
    token = F.posexplode(F.arrays_zip("tokens", F.coalesce("parts", F.array().cast("array<int>")).alias("parts"))).alias("pos", "t")
    runs = _in_parts(sets.select("key", "n", "low", "high", token)
                     .select("key", "n", "low", "high", "pos", F.col("t.tokens").alias("token"),
                             F.coalesce("t.parts", F.lit(1)).alias("parts")), ["token"], "parts")
    groups = components(runs.sortWithinPartitions("token", "pair", "n")
                        .mapInArrow(_candidates(similarity), "a binary, b binary"))


    def sized(found: DataFrame, rows: int) -> DataFrame:
        """``(key, component, parts)``: members of the groups, which are dealt in parts of ``rows``."""
        sizes = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
        return found.join(sizes, "component").withColumnRenamed("node", "key")

    marks = sized(groups, BITS_ROWS * group_rows).join(worded.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "low", "high", "many")]), "key")
    groups = components(_in_parts(marks, ["component"], "parts").sortWithinPartitions("component", "pair")
                        .mapInArrow(_refined(similarity), "a binary, b binary"))
    members = sized(groups, group_rows).join(classes, "key")
    members = broadcast_if_bounded(cut(members))
    if not members._bounded:
        rows = _only_members(rows, members.select("least.hash"))
    texts = rows.join(members, (F.col("least.hash") == rows["hash"]) & F.col("least.doc_id").eqNullSafe(rows["doc_id"]))
    texts = (texts.select("key", "component", "parts", "text", "copies")
             .mapInArrow(_once(ngram), "key binary, component binary, parts int, text binary, copies bigint"))
    return described, classes, _in_parts(texts, ["component"], "parts").sortWithinPartitions("component", "pair")


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM,
                      similarity: tuple[int, int] = SIMILARITY, links: bool = False, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``hash`` (of the text), ``n``, ``component_id``, ``first``.

    Documents are linked when their n-gram sets have a Jaccard similarity of at
    least ``similarity`` (a fraction, compared in integers); ``component_id`` is
    the smallest id reachable by links and ``first`` marks the row(s) of the
    smallest (id, text hash) of each component. With ``links`` there is also
    ``n_links``, the number of other rows that a row is linked with: every
    candidate pair of classes is verified then, where components only need a
    forest. ``similar_pairs`` gives the pairs themselves. No component is lost:

    1. Equal sets become one class, however many copies there are.
    2. All n-grams are put into one global order, rare first: by a frequency
       sketch over all texts (fixed size, broadcast), then by hash. Similar sets
       must share one of their first n - ceil(s * n) + 1 n-grams.
    3. Classes are dealt by these n-grams. Rows of one n-gram are told apart by
       size, position and parity bits, all of which only exclude pairs that
       can't be similar; the rest is handed on as a spanning forest, never as
       all pairs. N-grams that the sketch shows to be hot are dealt in parts.
       Connected groups of candidates are then told apart once more, by many
       more parity bits for long sets.
    4. Each group that is left gets the texts of its classes once and
       builds a prefix tree of their sets, in which similar ones are found
       exactly; groups of more than ``group_rows`` classes are dealt in parts,
       every pair of which is one tree.
    5. Verified links give the components.

    Texts without words (null, empty, blank) have n = 0, are linked with nothing
    and are their own component. Null ids count as larger than any id and
    a component without ids has a null ``component_id``. Repeated rows are
    copies of each other. Empty input gives no rows. Other columns are not read.
    """
    described, classes, texts = _grouped(docs, doc_id, text, ngram, similarity, **options)
    if links:
        found = cut(texts.mapInArrow(_all_verified(ngram, similarity, False), "a binary, b binary, n_links bigint"))
        forest = found.filter("b is not null").select("a", "b")
        counts = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("n_links"))
        classes = cut(classes.join(counts, "key", "left").withColumn(
            "n_links", F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))))
    else:
        forest = texts.mapInArrow(_verified(ngram, similarity), "a binary, b binary")
    linked = components(forest)
    named = linked.join(classes.select(F.col("key").alias("node"), "least"), "node")
    heads = named.groupBy("component").agg(F.min("least").alias("head"))
    heads = named.select("node", "component").join(heads, "component").select(F.col("node").alias("key"), "head")
    # written, so that the join of all rows with it is one whose hot keys Spark can split
    more = ["n_links"] if links else []
    of_class = cut(classes.select("key", "least", *more).join(heads, "key", "left")
                   .select("key", F.coalesce("head", "least").alias("head"), *more))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    return (described.select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.col("key")).alias("key"), own.alias("own"))
            .join(of_class, "key", "left")
            .select("doc_id", "hash", F.col("n").cast("bigint").alias("n"),
                    F.coalesce("head", "own")["doc_id"].alias("component_id"),
                    F.coalesce("head", "own").eqNullSafe(F.col("own")).alias("first"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in more]))


def similar_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM,
                  similarity: tuple[int, int] = SIMILARITY, **options) -> DataFrame:
    """Every pair of similar classes once: ``doc_id``, ``hash``, ``copies``, ``other_id``, ``other_hash``, ``other_copies``.

    A class is all rows of one n-gram set, named by the smallest (id, text hash)
    among them; rows of one class are similar without being listed. The pair's
    first class is the one that is smaller by name. A group of m classes that
    are all similar has m * (m - 1) / 2 pairs.
    """
    _, classes, texts = _grouped(docs, doc_id, text, ngram, similarity, **options)
    found = cut(texts.mapInArrow(_all_verified(ngram, similarity, True), "a binary, b binary"))
    one, other = (classes.select(F.col("key").alias(c), F.struct("least", "copies").alias(name)) for c, name in (("a", "x"), ("b", "y")))
    found = found.join(one, "a").join(other, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return found.select(*[F.col(f"{side}.{c}").alias(name) for side, names in (
        ("x", ("doc_id", "hash", "copies")), ("y", ("other_id", "other_hash", "other_copies")))
        for c, name in zip(("least.doc_id", "least.hash", "copies"), names)])


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one of the smallest id.

    Rows equal in id and text are one document, so one of them stays.
    """
    found = similar_documents(docs, doc_id=doc_id, text=text, **options)
    keys = cut(found.groupBy("doc_id", "hash").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
               .filter("not first or n > 1"))  # few: the rows to drop, and those that are there several times
    at, out = free_name(docs, "_hash"), docs.columns
    rows = docs.withColumn(at, F.xxhash64(docs[text]))

    def among(picked: DataFrame, how: str) -> DataFrame:
        side = broadcast_if_bounded(picked.select(F.col("doc_id").alias("_i"), F.col("hash").alias("_h")))
        return rows.join(side, rows[doc_id].cast("bigint").eqNullSafe(side["_i"]) & (rows[at] == side["_h"]), how)

    repeated = among(keys.filter("first"), "left_semi").dropDuplicates([doc_id, at])
    return among(keys, "left_anti").unionByName(repeated).select(*out)
