"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ontocat.llm.common import free_name

WINDOW = 10
#: Bytes of benchmark text that one pattern index may hold; more text is searched block by block.
BLOCK_BYTES = 2 << 20
#: Bytes of texts that a task searches together for one block after another.
GROUP_BYTES = 32 << 20

#: Everything but 0-9, a-z and non-ASCII bytes separates words; A-Z is lowered.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))

MATCH_TYPE = "struct<n_words:bigint,spans:array<struct<start:int,length:int>>,items:array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; non-ASCII characters are word characters, so UTF-8 bytes can be split as they are."""
    return text.translate(_WORD_BYTES).split() if text else []


class _Length:
    """Wu-Manber tables of the windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = {}

    def add(self, window: tuple[bytes, ...], item: str) -> None:
        for end in range(self.block, self.length + 1):
            part = window[end - self.block:end]
            self.shift[part] = min(self.shift.get(part, self.length), self.length - end)
        self.buckets.setdefault(window[-self.block:], {}).setdefault(window, set()).add(item)

    def search(self, words: list[bytes], items: set[str]) -> list[int]:
        """Starts of the windows found in ``words``; adds their items."""
        found, length, block = [], self.length, self.block
        shift, free = self.shift, self.length - self.block + 1
        end, n = length, len(words)
        while end <= n:
            part = tuple(words[end - block:end])
            step = shift.get(part, free)
            if not step:
                owners = self.buckets[part].get(tuple(words[end - length:end]))
                if owners:
                    found.append(end - length)
                    items |= owners
                step = 1
            end += step
        return found


class Index:
    """Wu-Manber tables over the windows of a block of benchmark items."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.lengths: dict[int, _Length] = {}
        for item, text in rows:
            words = words_of(text)
            size = min(window, len(words))
            if not size:
                continue
            tables = self.lengths.setdefault(size, _Length(size))
            for start in range(len(words) - size + 1):
                tables.add(tuple(words[start:start + size]), item)

    def search(self, words: list[bytes], items: set[str]) -> list[tuple[int, int]]:
        """``(start, end)`` of the windows found in ``words``; adds their items."""
        return [(s, s + t.length) for t in self.lengths.values() for s in t.search(words, items)]

    def match(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged ``(start, length)`` spans of hit words, items found."""
        words, items = words_of(text), set()
        return len(words), merged(self.search(words, items)), items


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ``(start, end)`` spans as ``(start, length)``, overlapping and touching ones joined."""
    spans: list[list[int]] = []
    for start, end in sorted(hits):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(s, e - s) for s, e in spans]


_BUILT: dict[int, Index] = {}


def _index(shared, window: int) -> Index:
    """The index of a broadcast block, kept until another one is needed; of its rows nothing stays in the worker."""
    key = (shared, window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(shared.value, window)
        vars(shared).pop("_value", None)  # read again from the executor's copy when the block is next needed
    return _BUILT[key]


def _groups(texts: Iterator[pa.Array], most: int) -> Iterator[list[pa.Array]]:
    """Arrow batches together until they hold ``most`` bytes; 0: one by one."""
    group: list[pa.Array] = []
    for chunk in texts:
        group.append(chunk)
        if sum(c.nbytes for c in group) >= most:
            yield group
            group = []
    if group:
        yield group


def _matcher(blocks: list, window: int, group_bytes: int):
    """Matches of texts with the items of all blocks; the tables of one block are in memory at a time."""
    @arrow_udf(MATCH_TYPE)
    def match(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        order = [*blocks]
        for group in _groups(texts, group_bytes if len(blocks) > 1 else 0):
            bodies = [t.as_py() for chunk in group for t in chunk.cast(pa.binary())]
            found = [(0, [], set()) for _ in bodies]
            for shared in order:
                index = _index(shared, window)
                for at, body in enumerate(bodies):
                    words = words_of(body)
                    found[at][1].extend(index.search(words, found[at][2]))
                    found[at] = (len(words), *found[at][1:])
            order.reverse()  # the next group begins with the tables at hand
            out = [{"n_words": n, "spans": [{"start": s, "length": k} for s, k in merged(hits)], "items": sorted(items)}
                   for n, hits, items in found]
            yield pa.array(out, pa.struct([
                ("n_words", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                ("items", pa.list_(pa.string()))]))
    return match


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       group_bytes: int = GROUP_BYTES, out: str = "match") -> DataFrame:
    """``docs`` with a struct column ``out``: word count, hit spans (in words) and items found.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter item; a document matches where its words equal a window's. Items
    are cut into blocks of at most ``block_bytes`` of text (one larger item is a
    block of its own), each broadcast by itself. Documents are read once: a task
    takes texts of ``group_bytes`` together and searches them for block after
    block, with the tables of one block in memory, so memory does not grow with
    the benchmark. Documents are searched row by row: no shuffle, no size
    limit, nothing written; copies and hot sources cost the same as other rows.

    Null or empty texts have no words and no matches. Items without words or
    without id are no patterns; repeated items count once. An empty benchmark
    matches nothing. Other columns of ``docs`` are kept; a column already
    called ``out`` is replaced.
    """
    sc = docs.sparkSession.sparkContext
    items = (benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("body"))
             .filter("item is not null and length(body) > 0").distinct())
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    shared = []
    for block in range(blocks):
        rows = [(r.item, bytes(r.body)) for r in
                items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block).collect()]
        shared.append(sc.broadcast(sorted(rows)))
    return docs.withColumn(out, _matcher(shared, window, group_bytes)(F.col(text)))


def n_hit(match: Column) -> Column:
    """Number of words inside the spans."""
    return F.aggregate(match["spans"], F.lit(0).cast("bigint"), lambda a, x: a + x["length"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their columns."""
    match = free_name(docs, "match")
    return (find_contamination(docs, benchmark, out=match, **options)
            .filter(F.size(F.col(match)["items"]) == 0).select(*docs.columns))
