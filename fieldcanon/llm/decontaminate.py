"""Benchmark decontamination with an FM-index of every training shard.

A shard is a bounded run of a partition's documents; a longer text is searched in pieces. Its words
are numbered by the benchmark's vocabulary; stretches without a word of it can't hold a window, so
only stretches that are long enough are indexed. Windows are searched backwards through the ranks of
a wavelet matrix, all at once; their occurrences are located by walking back to sampled suffix
positions; and the spans found are merged. Memory is bounded by the shard size and the size of a
block of benchmark items, whatever the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import text_of, written

#: Words of a window; an item with fewer words is one window.
WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Words of a shard.
SHARD_WORDS = 1_000_000
#: A benchmark of more bytes is dealt into blocks of so many at most, searched one after the other; and bytes
#: that an item counts for besides its text.
ITEM_BYTES, ITEM_COST = 16_000_000, 64
#: Every so many positions, the suffix array is kept.
SAMPLE = 16
#: Bytes of a text that are cut into words at a time, and windows that are searched at a time.
TEXT_BYTES, SEARCHED = 4_000_000, 200_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.

    Every byte of a non-ASCII character belongs to a word, so bytes can be taken as they are.
    """
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def word_numbers(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The text's words as numbers of the vocabulary, others as zero; words are made a bounded part
    of the text at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    parts, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= TEXT_BYTES else data.find(b" ", at + TEXT_BYTES)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


class Windows:
    """The distinct windows of some benchmark items (their texts), as numbers of their vocabulary
    (from 1). Everything but the vocabulary is an array with an entry a word."""

    def __init__(self, texts: list[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        items = []
        for text in texts:
            items.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in words_of(text)), np.int32))
        sizes = np.array([len(x) for x in items], np.int64)
        counts = np.where(sizes > 0, np.maximum(1, sizes - WINDOW + 1), 0)
        item = np.repeat(np.arange(len(items)), counts)
        starts = np.cumsum(sizes) - sizes
        first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[item]
        length = np.minimum(sizes, WINDOW)[item]
        self.words = np.concatenate([*items, np.zeros(WINDOW, np.int32)])
        # Equal windows become neighbours in the order of a hash, and are told apart word by word.
        code = length.astype(np.uint64)
        for k in range(WINDOW):
            code = code * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, self.words[first + k], 0).astype(np.uint64)
        order = np.lexsort((item, code))
        first, length, self.item = first[order], length[order], item[order]
        same = length[1:] == length[:-1]
        for k in range(WINDOW):
            same &= (k >= length[1:]) | (self.words[first[1:] + k] == self.words[first[:-1] + k])
        self.groups = np.concatenate((np.flatnonzero(np.concatenate(([True], ~same))), [len(first)])) if len(first) else np.zeros(1, np.int64)
        self.first, self.lengths = first[self.groups[:-1]], length[self.groups[:-1]]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def backwards(self, a: int, b: int) -> np.ndarray:
        """Windows a to b, a row each, read backwards; zeros follow the first word."""
        k = self.lengths[a:b, None] - 1 - np.arange(WINDOW)
        return np.where(k >= 0, self.words[self.first[a:b, None] + np.maximum(k, 0)], 0)

    def owners(self, windows: np.ndarray) -> list[int]:
        """The items, in order, that have one of the windows."""
        return sorted({int(i) for w in set(windows.tolist()) for i in self.item[self.groups[w] : self.groups[w + 1]]})


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros separate stretches and compare by place."""
    n, symbols = len(symbols), symbols.astype(np.int64)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols + len(ends)
    rank[ends] = np.arange(len(ends))
    base, step = n + len(ends) + int(symbols.max()) + 2, 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * base + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over stretches of symbols that each end with a zero."""

    def __init__(self, symbols: np.ndarray, top: int):
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 2))))
        # Walks stop at the start of a stretch at the latest, as the ranks of zeros aren't kept in order.
        marked = (order % SAMPLE == 0) | (bwt == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.sampled = order[marked]
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the transform before ``place``."""
        start, place = np.zeros_like(place), place.copy()
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            set_ = ((symbol >> b) & 1).astype(bool)
            place = np.where(set_, zeros + ones[place], place - ones[place])
            start = np.where(set_, zeros + ones[start], start - ones[start])
        return place - start

    def symbol(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transform's symbol at each place, and its rank there."""
        found, at, start = np.zeros_like(place), place.copy(), np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            set_ = bit.astype(bool)
            found = (found << 1) | bit
            at = np.where(set_, zeros + ones[at], at - ones[at])
            start = np.where(set_, zeros + ones[start], start - ones[start])
        return found, at - start

    def search(self, backwards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each pattern (a row, read backwards)."""
        lo, hi = np.zeros(len(backwards), np.int64), np.full(len(backwards), self.marks.size - 1, np.int64)
        for symbol in backwards.T:
            live = np.flatnonzero((symbol > 0) & (lo < hi))
            if not len(live):
                break
            s = symbol[live]
            base = self.first[s]
            lo[live], hi[live] = base + self.rank(s, lo[live]), base + self.rank(s, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """The text positions of suffixes."""
        out, steps = np.empty(len(places), np.int64), 0
        pending, at = np.arange(len(places)), places.copy()
        while len(pending):
            done = self.marks[at + 1] > self.marks[at]
            out[pending[done]] = self.sampled[self.marks[at[done]]] + steps
            pending, at = pending[~done], at[~done]
            symbol, rank = self.symbol(at)
            at, steps = self.first[symbol] + rank, steps + 1
        return out


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _hits(texts: list[np.ndarray], windows: Windows) -> Hits:
    """Text, first word and window of every occurrence in a shard."""
    nothing = np.zeros(0, np.int64)
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    line = np.zeros(starts[-1] + 1, np.int32)
    for a, x in zip(starts, texts):
        line[a : a + len(x)] = x
    # Stretches of words of the vocabulary, from the shortest window's length on.
    known = np.concatenate(([0], (line > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(known))
    begins, ends = edges[::2], edges[1::2]
    kept = ends - begins >= max(1, windows.shortest)
    begins, ends = begins[kept], ends[kept]
    if not len(begins) or not len(windows.lengths):
        return nothing, nothing, nothing
    sizes = ends - begins + 1  # with the zero that ends it
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(begins, sizes)
    index = FMIndex(line[place], len(windows.vocabulary))
    where, which = [nothing], [nothing]
    for a in range(0, len(windows.lengths), SEARCHED):
        lo, hi = index.search(windows.backwards(a, a + SEARCHED))
        counts = hi - lo
        window = np.repeat(np.arange(len(lo)), counts)
        ranks = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        where.append(place[index.locate(ranks)] if len(ranks) else nothing)
        which.append(window + a)
    at = np.concatenate(where)
    text = np.searchsorted(starts, at, "right") - 1
    return text, at - starts[text], np.concatenate(which)


def _long_hits(text: np.ndarray, windows: Windows, shard_words: int) -> Hits:
    """The same for one text that is longer than a shard: pieces overlap by a window less a word."""
    found = []
    for a in range(0, len(text), shard_words):
        _, first, window = _hits([text[a : a + shard_words + WINDOW - 1]], windows)
        found.append((first + a, window))
    first, window = (np.concatenate(x) for x in zip(*found))
    return np.zeros(len(first), np.int64), first, window


def _spans_and_items(hits: Hits, n: int, windows: Windows) -> list[tuple[list[list[int]], list[int]]]:
    """The merged spans and the items of each of ``n`` texts."""
    text, first, window = hits
    by_text = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[by_text], np.arange(n + 1))
    out = []
    for k in range(n):
        mine = by_text[cuts[k] : cuts[k + 1]]
        spans = merge_spans(np.stack((first[mine], first[mine] + windows.lengths[window[mine]]), axis=1)) if len(mine) else []
        out.append((spans, windows.owners(window[mine]) if len(mine) else []))
    return out


def merge_spans(spans: np.ndarray) -> list[list[int]]:
    """Disjoint spans of words, in order, that cover the same words."""
    merged: list[list[int]] = []
    for a, b in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist() if len(spans) else []:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


#: The windows of the block that this worker searches, under the block's name.
_BUILT: dict[str, Windows] = {}


def windows_of(block: str, texts: list[str | None]) -> Windows:
    """Built once in each worker, however many tasks of a block it runs."""
    if block not in _BUILT:
        _BUILT.clear()
        _BUILT[block] = Windows(texts)
    return _BUILT[block]


def _search(rows: DataFrame, block: pa.Table, item_type, shard_words: int) -> DataFrame:
    """Add ``n_words, spans, items`` to the rows in place of their column ``text``; ``block`` has some
    items' ``item_id, text``, ``ITEM_BYTES`` at most."""
    name = uuid.uuid4().hex
    sent = rows.sparkSession.sparkContext.broadcast((block["item_id"].combine_chunks(), block["text"].to_pylist()))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType(kept).add("n_words", LongType()).add("spans", ArrayType(ArrayType(LongType()))).add("items", ArrayType(item_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts = sent.value
        windows = windows_of(name, texts)
        pending: list[pa.RecordBatch] = []  # rows of the shard, without their texts
        shard: list[np.ndarray] = []
        long: dict[int, tuple] = {}  # what was found in long texts
        counts: list[int] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = _spans_and_items(_hits(shard, windows), len(shard), windows)
            for k, x in long.items():
                found[k] = x
            table = pa.Table.from_batches(pending).combine_chunks()
            ends = np.cumsum([0, *(len(x) for _, x in found)])
            flat = pa.array([i for _, x in found for i in x], pa.int64())
            more = (
                pa.array(counts, pa.int64()),
                pa.array([x for x, _ in found], pa.list_(pa.list_(pa.int64()))),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(flat)),  # ids of any type
            )
            for name, column in zip(("n_words", "spans", "items"), more):
                table = table.append_column(name, column)
            yield from table.to_batches()

        for batch in batches:
            rest, at = batch.drop_columns(["text"]), 0
            for k, text in enumerate(batch.column("text")):
                words = word_numbers(text.as_py(), windows.vocabulary)
                counts.append(len(words))
                if len(words) > shard_words:
                    long[len(shard)] = _spans_and_items(_long_hits(words, windows, shard_words), 1, windows)[0]
                    words = words[:0]
                shard.append(words)
                size += len(words)
                if size >= shard_words:
                    pending.append(rest.slice(at, k + 1 - at))
                    at = k + 1
                    yield from flush()
                    pending, shard, long, counts, size = [], [], {}, [], 0
            if at < batch.num_rows:
                pending.append(rest.slice(at))
        if shard:
            yield from flush()

    return rows.mapInArrow(run, schema)


def _pieces(items: DataFrame, most: int) -> DataFrame:
    """The items ``item_id, text`` with texts of more than ``most`` bytes cut into pieces of words, which share a
    window less a word with the next one: every window lies in one. (A single word isn't cut.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not any(len(t or "") * 4 > most for t in batch.column("text").to_pylist()):
                yield batch
                continue
            at, texts = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = (text or "").encode("utf-8", "surrogatepass")
                if len(own) <= most:
                    at, texts = [*at, k], [*texts, text]
                    continue
                words = own.translate(_WORD_BYTES).split()
                ends = np.cumsum([len(w) + 1 for w in words])
                begin = 0
                while True:
                    end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")), begin + WINDOW)
                    at.append(k)
                    texts.append(b" ".join(words[begin:end]).decode("utf-8", "surrogatepass"))
                    if end >= len(words):
                        break
                    begin = end - WINDOW + 1
            yield pa.record_batch([batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], names=["item_id", "text"])

    return items.mapInArrow(run, items.schema)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> list[DataFrame]:
    """Tables ``item_id, text`` of ``most`` bytes at most, one for a smaller benchmark; none is empty but that.

    Pieces of items are dealt by a number of their own, so it doesn't matter how often an id occurs, and
    what a number gets too much of is cut by bytes.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), text_of(text_col).alias("text")).where("item_id is not null and text <> ''")
    bytes_ = (F.octet_length("text") + ITEM_COST).cast("bigint")
    size = items.agg(F.sum(bytes_)).first()[0] or 0
    if size <= most:
        return [items]
    pieces = written(_pieces(items, most // 4).withColumn("row", F.monotonically_increasing_id()), "pieces")
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("row"), F.lit(-(-2 * size // most))))
    so_far = F.sum(bytes_).over(Window.partitionBy("dealt").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = written(dealt.withColumn("cut", F.floor(so_far / max(1, most - most // 4 - ITEM_COST))), "blocks")
    # A row for each block: twice the benchmark's share of a block, about.
    names = [(r["dealt"], r["cut"]) for r in cut.select("dealt", "cut").distinct().orderBy("dealt", "cut").collect()]
    return [cut.where((F.col("dealt") == d) & (F.col("cut") == c)).select("item_id", "text") for d, c in names]


def contamination_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, item_bytes: int = ITEM_BYTES, keys: tuple[str, ...] = ()) -> DataFrame:
    """Return ``doc_id, n_words, spans, items`` for every row of ``docs``, after the columns ``keys``.

    ``spans`` are the merged word spans (end exclusive) of benchmark windows, ``items`` the ids
    whose windows occur, each once. Every row is judged by itself, whatever the benchmark's size:
    rows without a doc_id, rows that repeat one, and ids of any type are passed through as they
    are. Null and empty texts have no words; a text may be of any length. Items without words or
    id are never found; items that repeat an id count as one. Empty tables give empty results or
    rows without hits. Other columns are ignored, whatever their names.

    Only a benchmark of ``item_bytes`` bytes at most goes to the tasks as a whole; a larger one is
    searched block by block, each in a pass over the documents. The rows are then numbered and
    written first, and the blocks' spans are merged by that number.
    """
    rows = docs.select(*keys, F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    parts = blocks(benchmark, item_col, item_text_col, item_bytes)
    item_type = parts[0].schema["item_id"].dataType

    def search(of: DataFrame, items: DataFrame) -> DataFrame:
        return _search(of, items.toArrow(), item_type, shard_words)

    tidy = F.array_sort(F.array_distinct("items"))
    if len(parts) == 1:
        return search(rows, parts[0]).withColumn("items", tidy)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # so that a row has the same number in every block's search
    found = written(search(rows, parts[0]), "spans")
    for items in parts[1:]:
        found = found.unionByName(written(search(rows, items), "spans"))

    merge = F.pandas_udf(lambda s: s.map(lambda x: merge_spans(np.array([list(p) for p in x], np.int64).reshape(-1, 2))), "array<array<bigint>>")
    same = [F.first(c).alias(c) for c in (*keys, "doc_id", "n_words")]
    found = found.groupBy("row").agg(*same, F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return found.withColumn("spans", merge("spans")).withColumn("items", tidy).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Return ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` for every
    row, after ``keys``; see ``contamination_spans``. A document is contaminated if it has hit
    words and they make up one in ``SHARE`` at least."""
    found = contamination_spans(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    columns = [*options.get("keys", ()), "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "spans"]
    return found.select(*columns).withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> list[tuple]:
    """The same verdicts by comparing every window with every place; for tests."""
    out = []
    for doc, text in docs:
        words, hit, who = words_of(text), set(), set()
        for item, item_text in items:
            w = words_of(item_text)
            n = min(WINDOW, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[k : k + n]:
                        hit.update(range(p, p + n))
                        who.add(item)
        names = ",".join(sorted(map(str, who)))
        out.append((doc, len(words), len(hit), len(who), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and SHARE * len(hit) >= len(words)))
    return out
