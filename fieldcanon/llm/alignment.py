"""Alignment of two tokenizers over a corpus: how their tokens overlap, and how usual each overlap is.

Equal texts are found by a shuffle of the full text and aligned once; what a pair of ids counts is
weighted by the number of copies; and the measures are joined back to the rows by the text's digest.
Both tokenizers work on words: a text is cut in front of spaces where neither of the two has tokens
that cross the cut, and each worker remembers the words that it has aligned.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written
from .tokens import _byte_letters as byte_letters

#: Words that a worker remembers, about, and letters of them; and words that are aligned at a time.
CACHE, CACHE_LETTERS, LEARNED = 150_000, 4_000_000, 20_000
#: Letters of text that are looked up at a time.
SLICE = 2_000_000
#: Most id pairs, the most frequent ones, that every worker gets (17 bytes each).
TOP_PAIRS = 2**20
#: Texts with at least this share of all rows are joined by broadcast; there are no more of them.
HOT_SHARE = 1024

MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _joined(ids: list[int], of: list[bytes]) -> bytes:
    return b"".join(map(of.__getitem__, ids))


def _counts(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(map(len, ids), np.int64, len(ids))


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64)


class Aligner:
    """Both tokenizers, and the words that are aligned already.

    A word is kept as numbers at its place in parallel lists: tokens of either kind, groups, the
    groups as text, and where its id pairs begin in ``pairs``.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = {letter: n for n, letter in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            self.bytes_a[n] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
        self.bytes_b = [self._piece(self.b.id_to_piece(n)) for n in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # Ids as text, within a group and at the end of A's or B's part of it.
        self.text_a, self.text_b = (np.array([f"{n}," for n in range(len(x))], object) for x in (self.bytes_a, self.bytes_b))
        self.last_a, self.last_b = np.array([f"{n}|" for n in range(len(self.bytes_a))], object), np.array([f"{n};" for n in range(len(self.bytes_b))], object)
        self.cuts = self._can_cut(path_a)
        self.forget()

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _can_cut(self, path_a: str) -> bool:
        """Whether a text may be cut in front of a space that follows another character: if A cuts
        there itself, no piece of B goes across, and B leaves spaces as they are."""
        import json

        with open(path_a, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        own = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts.get("normalizer")
        across = any(re.search(r"[^ ] ", x.decode("utf-8", "replace")) for x in self.bytes_b)
        kept = all(_joined(self.b.encode(t), self.bytes_b) == (" " + t).encode() for t in ("x  y ", " x", "x \t y\n z  ", "  "))
        return bool(own and not across and kept)

    @property
    def width(self) -> int:
        """A pair of ids is the number ``a * width + b``."""
        return len(self.bytes_b)

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.n_groups: list[int] = []
        self.groups: list[str] = []
        self.begins: list[int] = [0]
        self.pairs: list[np.ndarray] = []
        self.odd: set[int] = set()  # places of words whose bytes differ
        self.letters = 0

    def words(self, text: str) -> list[str]:
        """The text behind its first space, cut in front of spaces; a word's own first space is left out."""
        if not self.cuts:
            return [text]
        if re.search(r"\s ", " " + text) is None:
            return text.split(" ")
        return [w[1:] for w in re.split(r"(?<=\S)(?= )", " " + text)]

    def _encode_b(self, words: list[str]) -> list[list[int]]:
        """B puts a space in front of everything but the empty text."""
        found = self.b.encode(words, num_threads=1)
        if "" in words:
            alone = [self.b.piece_to_id("▁")]
            found = [ids if w else alone for w, ids in zip(words, found)]
        return found

    def learn(self, words: list[str]) -> None:
        """Align words that aren't known yet."""
        for k in range(0, len(words), LEARNED):
            self._learn(words[k : k + LEARNED])

    def _learn(self, words: list[str]) -> None:
        # Words that another can follow are encoded as one text, which is cut where they end.
        chained = [w for w in words if w and not w[-1].isspace()] if self.cuts else []
        found = self._chained(chained) if chained else None
        if found is None:
            found = self._each(words)
        elif len(chained) < len(words):
            rest = [w for w in words if not w or w[-1].isspace()]
            words = chained + rest
            found = tuple(np.concatenate(x) for x in zip(found, self._each(rest, len(chained))))
        self.places.update(zip(words, range(len(self.n_a), len(self.n_a) + len(words))))
        count_a, count_b, a, b = found
        word_a = np.repeat(np.arange(len(words)), count_a)
        # Words have as many bytes of either kind, so their ends in one long row of bytes are common ends.
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        either = np.unique(np.concatenate([ends_a, ends_b]))
        at_a, at_b = np.searchsorted(ends_a, either), np.searchsorted(ends_b, either)
        links = np.bincount(word_a[at_a], minlength=len(words))
        where_a, where_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
        closes_a = ends_b[np.minimum(where_a, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(0, bool)
        closes_b = ends_a[np.minimum(where_b, len(ends_a) - 1)] == ends_b if len(ends_a) else np.zeros(0, bool)
        groups = np.bincount(word_a[closes_a], minlength=len(words))
        # Tokens with what follows them, A's of a group before B's of it.
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        shown = np.concatenate([np.where(closes_a, self.last_a[a], self.text_a[a]), np.where(closes_b, self.last_b[b], self.text_b[b])])[order].tolist()
        at = 0
        for n in (count_a + count_b).tolist():
            self.groups.append("".join(shown[at : at + n])[:-1])
            at += n
        self.n_a += count_a.tolist()
        self.n_b += count_b.tolist()
        self.n_groups += groups.tolist()
        self.begins += (self.begins[-1] + np.cumsum(links)).tolist()
        self.pairs.append(a[at_a] * self.width + b[at_b])
        self.letters += sum(map(len, words))

    def _chained(self, words: list[str]) -> tuple[np.ndarray, ...] | None:
        """Tokens of each word in either kind, and the tokens, of words that follow each other; ``None`` where their
        bytes aren't those of the words."""
        text = "".join([" " + w for w in words])
        own = text.encode()
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        found = []
        for ids, of, lengths in (
            (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.bytes_a, self.length_a),
            (self.b.encode(text[1:]), self.bytes_b, self.length_b),
        ):
            tokens = np.array(ids, np.int64)
            reach = np.cumsum(lengths[tokens])
            at = np.searchsorted(reach, ends)
            if not len(reach) or at[-1] >= len(reach) or not np.array_equal(reach[at], ends) or _joined(ids, of) != own:
                return None
            found.append((np.diff(at, prepend=-1), tokens))
        (count_a, a), (count_b, b) = found
        return count_a, count_b, a, b

    def _each(self, words: list[str], before: int = 0) -> tuple[np.ndarray, ...]:
        """The same for words that are encoded one by one. Those whose bytes aren't those of their tokens are noted
        as odd and have none; ``before`` words of the same lesson stand before them."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        ids_b = self._encode_b(words)
        for k, (w, x, y) in enumerate(zip(words, ids_a, ids_b)):
            own = (" " + w).encode()
            if _joined(x, self.bytes_a) != own or _joined(y, self.bytes_b) != own:
                self.odd.add(len(self.n_a) + before + k)
                ids_a[k] = ids_b[k] = []
        return _counts(ids_a), _counts(ids_b), _flat(ids_a), _flat(ids_b)

    def align(self, texts: list[str]) -> dict[str, list]:
        """The measures of each text, and its distinct id pairs with the number of links of each."""
        if len(self.places) > CACHE or self.letters > CACHE_LETTERS:
            self.forget()
        cut = [self.words(t) for t in texts]
        known = self.places
        missing = list(dict.fromkeys(w for words in cut for w in words if w not in known))
        if missing:
            self.learn(missing)
        at = [list(map(known.__getitem__, words)) for words in cut]
        if self.odd:
            for k, places in enumerate(at):
                if not self.odd.isdisjoint(places):
                    # What a word alone can't tell is asked of the whole text.
                    whole = texts[k]
                    if whole not in known:
                        self.learn([whole])
                    at[k] = [known[whole]]
        row, place = np.repeat(np.arange(len(texts)), _counts(at)), _flat(at)
        begins = np.array(self.begins, np.int64)
        lengths = np.diff(begins)
        counted = (("n_a", self.n_a), ("n_b", self.n_b), ("n_groups", self.n_groups), ("n_links", lengths))
        totals = {name: np.bincount(row, weights=np.array(of, np.float64)[place], minlength=len(texts)).astype(np.int64) for name, of in counted}
        # Each word of a text once with its number, then its pairs, then each pair of the text once.
        used, times = np.unique(row * len(lengths) + place, return_counts=True)
        row, place = np.divmod(used, len(lengths))
        many = lengths[place]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.concatenate(self.pairs)
        self.pairs = [pairs]
        span = len(self.bytes_a) * self.width
        key = np.repeat(row, many) * span + pairs[np.repeat(begins[place], many) + inside]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], np.repeat(times, many)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        weight = np.add.reduceat(weight, first) if len(first) else weight
        row, pair = np.divmod(key[first], span)
        offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        groups = [";".join(map(self.groups.__getitem__, places)) for places in at]
        return {
            **totals,
            "groups": groups,
            "pairs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair)),
            "times": pa.ListArray.from_arrays(pa.array(offsets), pa.array(weight.astype(np.int32))),
        }


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, as loading takes a second."""
    return Aligner(path_a, path_b)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``text, copies`` of each text that isn't empty: copies are counted in each task before the shuffle."""
    return docs.select(text_of(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``digest, copies``, the measures of each text, its id pairs as numbers, and the links of each, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            lengths = np.array([len(t) for t in batch.column("text").to_pylist()])
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // SLICE)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(lengths)]):
                part = batch.slice(int(begin), int(end - begin))
                found = own.align(part.column("text").to_pylist())
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
                yield pa.record_batch(
                    [part.column("digest"), part.column("copies"), *(pa.array(found[m]) for m in MEASURES), pa.array(hashes), found["pairs"], found["times"]],
                    names=["digest", "copies", *MEASURES, "groups_sha256", "pairs", "times"],
                )

    schema = "digest binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    return written(texts.select(digest_of(F.col("text")).alias("digest"), "copies", "text").mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``pair, count, best``: in how many documents each id pair is linked, and whether that is the most
    of its A id. Written. No window holds more rows than B has ids."""
    counts = aligned.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.expr(f"pair div {width}")))
    return written(counts.withColumn("best", F.col("count") == most), "counts")


def scored_texts(aligned: DataFrame, counts: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """The texts with ``n_best`` and ``count_sum``, written.

    The ``top`` most frequent pairs go to every worker, which settles nearly all links where they are;
    the links of all other pairs, none of which is frequent, are joined with the counts.
    """
    spark = aligned.sparkSession
    frequent = counts.orderBy(F.desc("count"), "pair").limit(top).toPandas().sort_values("pair", ignore_index=True)
    # The last one is larger than any pair.
    frequent.loc[len(frequent)] = [np.iinfo(np.int64).max, 0, False]
    table = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy(t) for c, t in (("pair", np.int64), ("count", np.int64), ("best", np.bool_))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = table.value
        for batch in batches:
            lists = batch.column("pairs")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            hit = keys[at] == pairs
            by_row = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[offsets])
            summed = by_row(np.where(hit, count[at] * times, 0))
            good = by_row(np.where(hit & best[at], times, 0))
            left = pa.array(np.concatenate([[0], np.cumsum(~hit)])[offsets].astype(np.int32))
            kept = [batch.column(c) for c in ("digest", "copies", *MEASURES, "groups_sha256")]
            yield pa.record_batch(
                [*kept, pa.array(good), pa.array(summed), pa.ListArray.from_arrays(left, pa.array(pairs[~hit])), pa.ListArray.from_arrays(left, pa.array(times[~hit]))],
                names=["digest", "copies", *MEASURES, "groups_sha256", "n_best", "count_sum", "pairs", "times"],
            )

    schema = "digest binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    settled = written(aligned.mapInArrow(run, schema), "settled")
    rest = settled.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("digest", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    more = rest.join(counts, "pair").groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_sum"))
    return written(
        settled.drop("pairs", "times").join(more, "digest", "left").select(
            "digest", "copies", *MEASURES, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256"
        ),
        "scored",
    )


def token_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP_PAIRS) -> DataFrame:
    """Return ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A is a byte-level tokenizer in the JSON form, B a sentencepiece model; both encode a space and the
    whole text, of any length, without special tokens. Null and empty texts, and those whose bytes
    aren't those of the tokens, have no tokens: zeros and an empty hash. Every row is a document: rows
    that repeat a text or an id count each, rows without an id too. Equal counts are all an A id's
    highest. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    own = text_of(text_col)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.when(own != "", digest_of(own)).alias("digest")), "rows")
    aligned = aligned_texts(distinct_texts(docs, text_col), path_a, path_b)
    scored = scored_texts(aligned, pair_counts(aligned, aligner(path_a, path_b).width), top)
    # A text with a large share of the rows would be one task's work in the join.
    least = max(2, -(-rows.count() // HOT_SHARE))
    hot = F.broadcast(scored.where(F.col("copies") >= least).drop("copies"))
    cold = scored.where(F.col("copies") < least).drop("copies")
    there = rows.where("digest is not null")
    numbers = [*MEASURES, "n_best", "count_sum"]
    empty = rows.where("digest is null").select("doc_id", *(F.lit(0).cast("bigint").alias(m) for m in numbers), F.lit("").alias("groups_sha256"))
    found = there.join(hot, "digest").unionByName(there.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    return found.select("doc_id", *numbers, "groups_sha256").unionByName(empty)
