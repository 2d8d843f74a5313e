"""Token counts by byte-pair merging with a heap and a linked list.

Only counts are made: a word's count is its number of initial symbols minus its merges. The
merges come from a tokenizer file in the JSON form whose path is a parameter; every Python worker
reads it once and remembers the counts of words.

Operators that only need the lengths for other work take ``library_count``: the same counts, but equal
stretches of a part of a batch are counted once, and their words are merged by the library.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import text_of

LIMIT = 2048
#: Stretches of text whose counts a task remembers; when there are as many, those not seen since the
#: last time that there were are forgotten.
CACHE = 300_000
#: A longer stretch is counted and forgotten.
LONGEST = 64
#: Bytes of the texts whose stretches are counted together (a longer text is a part of its own), and how many different
#: stretches are cut at a time.
PART, STRETCHES = 1 << 22, 1 << 18
#: Words, and stretches that aren't Latin, whose counts are remembered where the library merges. That is quick, so they are fewer.
WORDS = 100_000
WORD_END = "</w>"

#: Stretches of letters that all versions of Unicode agree on and that need no
#: normalising, the pre-tokenizer's pattern for them in lower case, and what Python takes for white
#: space between words but Unicode doesn't.
SIMPLE = r"[!-~À-ÖØ-öø-įĲ-ſ]+"
SIMPLE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Merges:
    """The merges of a tokenizer: symbols as numbers, the rank of a pair, and what it becomes."""

    def __init__(self, pairs: list[tuple[str, str]], letters: list[str]):
        numbers: dict[str, int] = {}
        number = lambda s: numbers.setdefault(s, len(numbers))
        self.inside = {x: number(x) for x in letters}
        self.at_end = {x: number(x + WORD_END) for x in letters}
        self.ranks = {number(a) << 32 | number(b): r for r, (a, b) in enumerate(pairs)}
        self.becomes = [number(a + b) for a, b in pairs]

    def left(self, word: str) -> int:
        """How many symbols are left when the lowest-rank adjacent pair is merged until none is.

        The heap holds rank and place in one number. An entry counts only while ``current`` has
        its rank at its place; ``after`` and ``before`` link what is left.
        """
        n = left = len(word)
        rank, becomes, push, pop = self.ranks.get, self.becomes, heapq.heappush, heapq.heappop
        ids = list(map(self.inside.__getitem__, word))
        ids[-1] = self.at_end[word[-1]]
        current = [rank(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        heap = [r << 32 | i for i, r in enumerate(current) if r >= 0]
        heapq.heapify(heap)
        current.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if current[i] != r:
                continue  # one of the two is merged already
            gone = after[i]
            after[i] = k = after[gone]
            ids[i] = merged = becomes[r]
            current[i] = current[gone] = -1
            left -= 1
            if k < n:
                before[k] = i
                r = current[i] = rank(merged << 32 | ids[k], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            k = before[i]
            if k >= 0:
                r = current[k] = rank(ids[k] << 32 | merged, -1)
                if r >= 0:
                    push(heap, r << 32 | k)
        return left


class _Counts(dict):
    """Remembered counts of words; others are counted when they are asked for."""

    def __init__(self, count: Callable[[str], int], most: int = CACHE):
        self.count, self.most, self.older = count, most, {}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.count(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def counter_for(path: str) -> Callable[[str | None], int]:
    """A function that counts a text's tokens by the tokenizer file at ``path``.

    A text is cut at white space, which no token crosses. A stretch of Latin letters is cut
    further by the pattern of the file; any other is normalised and cut by the library itself, so that
    letters are what the library's version of Unicode takes for letters.
    """
    import re

    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]], letters)
    library = Tokenizer.from_file(path)
    marks = tuple(t["content"] for t in spec["added_tokens"])
    special = regex.compile("|".join(regex.escape(m) for m in marks)) if marks else None
    simple, simple_pieces, spaced = re.compile(SIMPLE).fullmatch, re.compile(SIMPLE_PIECES).findall, regex.compile(r"\p{White_Space}+")

    others = _Counts(lambda piece: merges.left("".join([letters[b] for b in piece.encode()])))

    def count_stretch(stretch: str) -> int:
        if stretch.isascii() and stretch.isalpha():  # one piece, and its letters stand for themselves
            low = stretch.lower()
            return merges.left(low) if low == stretch else stretches[low]
        if not simple(stretch):
            return sum(map(by_letters.__getitem__, (p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(stretch)))))
        return sum([stretches[p] if p.isascii() and p.isalpha() else others[p] for p in simple_pieces(stretch.lower())])

    by_letters = _Counts(merges.left)
    stretches = _Counts(count_stretch)

    def count_plain(text: str) -> int:
        words = spaced.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return sum(map(stretches.__getitem__, words))

    def count(text: str | None) -> int:
        if not text:
            return 0
        if any(m in text for m in marks):
            parts = special.split(text)
            return len(parts) - 1 + sum(map(count_plain, parts))
        return count_plain(text)

    return count


class ArrayCounter:
    """Counts the tokens of Arrow arrays of texts by the tokenizer file at ``path``; words are merged by the library.

    Texts are cut at ASCII white space only: other white space is left to the library, as are all
    stretches that aren't Latin.
    """

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        library, letters = Tokenizer.from_file(path), _byte_letters()
        tokenize, normalize, cut = library.model.tokenize, library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.marks = tuple(t.content for t in library.get_added_tokens_decoder().values())
        self.cut_marks = regex.compile("|".join(map(regex.escape, self.marks))).split
        self.others = _Counts(lambda stretch: sum(len(tokenize(p)) for p, _ in cut(normalize(stretch))), WORDS)
        self.cut_simple = re.compile(f" |{SIMPLE_PIECES.removesuffix(']+')} ]+").findall
        # A space ends a stretch and has no tokens: it counts -1.
        self.pieces = _Counts(lambda p: -1 if p == " " else len(tokenize(p if p.isascii() else "".join([letters[b] for b in p.encode()]))), WORDS)

    def simple(self, stretches: pa.Array) -> np.ndarray:
        """The tokens of each of these stretches of Latin letters, which are cut as one text."""
        if not len(stretches):
            return np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(stretches)], stretches), pa.scalar(" ", stretches.type))[0].as_py()
        counts = np.fromiter(map(self.pieces.__getitem__, self.cut_simple(joined.lower() + " ")), np.int64)
        ends = np.flatnonzero(counts < 0)
        counts[ends] = 0
        return np.diff(np.cumsum(counts)[ends], prepend=0)

    def different(self, stretches: pa.Array) -> np.ndarray:
        """The tokens of each of these stretches."""
        plain = pc.match_substring_regex(stretches, f"^{SIMPLE}$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(stretches), np.int64)
        counts[is_plain] = self.simple(stretches.filter(plain))
        counts[~is_plain] = [self.others[s] for s in stretches.filter(pc.invert(plain)).to_pylist()]
        return counts

    def part(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text. What lies between special strings is counted like texts of their own."""
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        known = words.dictionary
        of_word = np.concatenate([np.zeros(0, np.int64), *(self.different(known.slice(at, STRETCHES)) for at in range(0, len(known), STRETCHES))])
        upto = np.cumsum(np.append(0, of_word[words.indices.to_numpy()]))
        counts = np.diff(upto[np.cumsum(np.append(0, pc.list_value_length(cut).to_numpy()))])
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if marked.any():
            between = [self.cut_marks(t) for t in texts.filter(pa.array(marked)).to_pylist()]
            n = np.array([*map(len, between)])
            counts[marked] = n - 1 + np.add.reduceat(self.part(pa.array([p for b in between for p in b], texts.type)), np.cumsum(n) - n)
        return counts

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The tokens of each text of an array without nulls, which is taken in parts of ``PART`` bytes."""
        ends, at, counts = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0, [np.zeros(0, np.int64)]
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
            counts.append(self.part(texts.slice(at, to - at)))
            at = to
        return pa.array(np.concatenate(counts))


@functools.lru_cache(maxsize=2)
def array_counter(path: str) -> ArrayCounter:
    """The worker's own, which remembers counts from batch to batch."""
    return ArrayCounter(path)


def library_count(tokenizer: str, text: Column) -> Column:
    """The tokens of ``text``, a column without nulls: what ``token_count`` gives, merged by the library."""

    @F.arrow_udf(LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(array_counter(tokenizer), batches)

    return count(text)


def token_count(tokenizer: str, text: Column) -> Column:
    """The tokens of ``text`` by the tokenizer file, as a column."""

    @F.pandas_udf(LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = counter_for(tokenizer)
        for batch in texts:
            yield batch.map(one).astype("int64")

    return count(text)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Return ``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer`` is the path of a tokenizer file that every worker can read. Special strings
    inside a text count as one token each; none are added. Null and empty texts have no tokens.
    Repeated rows, null ids and ids of any type are kept as they are, an empty table gives an
    empty result, and other columns are ignored whatever their names. Texts may be as long as a
    row can be: a long word takes time by its length and a logarithm of it.
    """
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(tokenizer, text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
