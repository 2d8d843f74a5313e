"""Secret scanning: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order models, one of random strings and one of ordinary identifiers, give each long
string of letters and digits a log-likelihood ratio. They are trained from labelled samples:
secrets that the fixed patterns find and strings drawn at random on the one side; on the other the
words of all documents and identifiers joined of them, numbers and marked strings as they stand in
documents, and drawn dates, paths, versions, numbers, constants and rulers. What is gathered are counts
of pairs of symbols, which are bounded; what they count is every document. Each sample has a share of its model
at most, so that a large corpus doesn't drown the drawn ones.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("assign", "access", "hex", "markov")
#: Strings drawn for either model.
FIT_RANDOM = FIT_ORDINARY = 6_000
#: A string is a secret if the ratio reaches so many nats in all, and so many for each pair of symbols.
TOTAL, EACH = 12.0, 0.45
#: Weight, in transitions, of the symbols' own frequencies.
PULL = 20.0
#: Transitions that a model counts as seen, and the share of each sample in them: for ordinary strings words
#: and identifiers, strings as they stand, drawn ones; for random strings found ones, drawn ones.
SEEN = 200_000
ORDINARY_SHARES, RANDOM_SHARES = (0.5, 0.1, 0.4), (0.1, 0.9)

# The patterns of secrets.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters of a text that are counted at a time.
PIECE = 1_000_000
#: Letters of the shortest word that is counted, and of the shortest string with other symbols.
LEAST_WORD, LEAST_MARKED = 3, 4

_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
_N = len(_SYMBOLS)
_MARKS = np.array([_SYMBOLS.index(x) for x in "_-/_"])  # by the kind of identifier, from the fifth on again


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of what the fixed patterns find; spans of matches, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    # Strings of the other kinds lie within candidates: no pattern crosses their borders.
    for c in CANDIDATE.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(c.start() + m.start(), c.start() + m.end(), kind) for m in pattern.finditer(c[0]) if m.end() - m.start() >= LEAST[kind]]
    return _ordered(found)


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def transitions(string: str) -> np.ndarray:
    """The pairs of neighbouring symbols, as numbers; other characters stand between strings."""
    codes = _CODE[np.frombuffer(string.encode("ascii"), np.uint8)]
    pairs = codes[:-1] * _N + codes[1:]
    return pairs[(codes[:-1] >= 0) & (codes[1:] >= 0)]


def random_strings(n: int = FIT_RANDOM, seed: int = 11) -> list[str]:
    """Strings drawn evenly from the usual alphabets of keys."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _SYMBOLS[:62], _SYMBOLS[:64], _SYMBOLS[:62] + "_-")
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 48))) for i in range(n)]


#: Words that drawn ordinary strings are made of.
_WORDS = (
    "user name file path data test main build release version update config index page image list item value type object service client server request response error message "
    "event time date start end size length count total number text table field column row key group order state status result report model view layer frame texture buffer "
    "positive negative left right top bottom first last next previous open close read write create delete insert select project source target default"
).split()


def ordinary_strings(n: int = FIT_ORDINARY, seed: int = 12) -> list[str]:
    """Long strings that aren't secrets: dated and numbered names, paths, constants, versions, numbers, rulers."""
    rng = random.Random(seed)
    word = lambda: rng.choice(_WORDS)
    digits = lambda a, b: "".join(rng.choices("0123456789", k=rng.randint(a, b)))
    date = lambda sign: sign.join((f"{rng.randint(1980, 2039)}", f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"))
    several = lambda sign, a=2, b=5: sign.join(word() for _ in range(rng.randint(a, b)))

    def one(kind: int) -> str:
        sign = rng.choice("-_/")
        if kind == 0:
            return date(rng.choice(["-", "/", ""])) + sign + several(sign)
        if kind == 1:
            return several("/") + "/" + rng.choice([digits(1, 6), date("/"), word() + "_" + digits(1, 4)])
        if kind == 2:
            return several("_", 3, 6).upper() + rng.choice(["", "_" + digits(1, 3), "_" + rng.choice("XYZABC")])
        if kind == 3:
            return several(sign) + sign + rng.choice(["v", "V", "release-", "r", ""]) + "-".join(digits(1, 2) for _ in range(rng.randint(1, 3)))
        if kind == 4:
            return digits(20, 30) if rng.random() < 0.5 else rng.choice("-/_=").join(digits(2, 5) for _ in range(rng.randint(5, 8)))
        if kind == 5:
            return rng.choice("=-_+/") * rng.randint(20, 90)
        if kind == 6:
            return rng.choice(["ISBN", "ISSN", "DOI", "No", "Tel", "REF"]) + "-" + "-".join(digits(1, 6) for _ in range(rng.randint(3, 6)))
        return "".join(w.title() if rng.random() < 0.9 else w.upper() for w in (word() for _ in range(rng.randint(3, 6))))

    return [one(i % 8) for i in range(n)]


def counted(strings: list[str]) -> np.ndarray:
    return np.bincount(transitions("\n".join(strings)), minlength=_N * _N) if strings else np.zeros(_N * _N, np.int64)


def samples(text: str) -> tuple[Iterator[str], list[str]]:
    """A text without what the fixed patterns find, in pieces of bounded length; and the strings that
    they find."""
    at, clear, secret = 0, [], []
    for start, end, _ in base_spans(text):
        clear += [text[at:start], "\n"]
        at = max(at, end)
        secret += re.findall(r"[A-Za-z0-9+/_=-]{6,}", text[start:end])[-1:]
    text = "".join([*clear, text[at:]]) if clear else text
    return (text[k : k + PIECE] for k in range(0, len(text), PIECE)), secret


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]  # what isn't ASCII is no symbol, nor is "?"


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edges[::2], edges[1::2]


def ordinary_counts(text: str) -> np.ndarray:
    """Transitions of ordinary strings: the words of a text, and identifiers made of four words each,
    joined by ``_``, ``-`` or ``/`` in lower case, written together with a capital third word, or joined by
    ``_`` in capitals."""
    codes = _codes(text)
    starts, ends = _runs((codes >= 0) & (codes < 52))
    long = ends - starts >= LEAST_WORD
    starts, ends = starts[long], ends[long]
    # Every letter of a word but the last, with the next one.
    sizes = ends - starts - 1
    at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    pairs = [codes[at] * _N + codes[at + 1]]
    whole = len(starts) // 4 * 4
    if whole:
        # Words in groups of four, their letters in lower case or all capitals; the kind of identifier goes round.
        small = np.where(codes >= 26, codes - 26, codes)
        kind = np.arange(whole // 4) % 5
        raised = np.where(kind == 4, 26, 0)
        at = at[: sizes[:whole].sum()]
        up = np.repeat(np.repeat(raised, 4), sizes[:whole])
        first, last = small[starts[:whole]].reshape(-1, 4)[:, 1:] + raised[:, None], small[ends[:whole] - 1].reshape(-1, 4)[:, :3] + raised[:, None]
        joined = kind != 3
        sign = _MARKS[kind[joined] % 4, None]
        capital = first[~joined] + np.array([0, 26, 0])
        pairs += [(small[at] + up) * _N + small[at + 1] + up, last[joined] * _N + sign, sign * _N + first[joined], last[~joined] * _N + capital]
    return np.bincount(np.concatenate([p.ravel() for p in pairs]), minlength=_N * _N)


def marked_counts(text: str) -> np.ndarray:
    """Transitions of strings as they stand that hold digits or joiners: numbers, dates, paths, rulers."""
    codes = _codes(text)
    starts, ends = _runs(codes >= 0)
    marks = np.concatenate(([0], np.cumsum(codes >= 52)))
    chosen = (ends - starts >= LEAST_MARKED) & (marks[ends] > marks[starts])
    starts, sizes = starts[chosen], (ends - starts)[chosen] - 1
    at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return np.bincount(codes[at] * _N + codes[at + 1], minlength=_N * _N)


def _chances(counts: np.ndarray) -> np.ndarray:
    """Transition probabilities, drawn towards the symbols' own frequency where seen seldom."""
    counts = counts.reshape(_N, _N)
    single = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * _N)
    return (counts + PULL * single) / (counts.sum(axis=1, keepdims=True) + PULL)


def ratios(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each transition."""
    return np.log(_chances(random_counts) / _chances(ordinary_counts)).ravel()


def _mixed(samples_: list[np.ndarray], shares: tuple[float, ...]) -> np.ndarray:
    """Samples that are larger than their share of ``SEEN`` transitions count as so many; smaller ones count as
    they are, so that the few marked strings of a small corpus don't count for more than they show."""
    return sum(c * min(1.0, SEEN * share / c.sum()) for c, share in zip(samples_, shares) if c.sum())


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Train both models on all documents; return their log ratio for each pair of symbols.

    Documents are counted one by one, so the same documents give the same models however they are
    dealt to tasks. Without documents only the drawn strings tell the models apart.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((3, _N * _N), np.int64)
        for batch in batches:
            for text in batch["text"]:
                pieces, secret = samples(text)
                for piece in pieces:
                    counts[0] += ordinary_counts(piece)
                    counts[1] += marked_counts(piece)
                if secret:
                    counts[2] += counted(secret)
        label, pair = np.nonzero(counts)
        yield pd.DataFrame({"label": label.astype(np.int32), "pair": pair, "n": counts[label, pair]})

    counts = np.zeros((3, _N * _N))
    found = docs.select(text_of(text_col).alias("text")).mapInPandas(count, "label int, pair bigint, n bigint")
    for r in found.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():  # at most three for each pair of symbols
        counts[r.label, r.pair] = r.n
    ordinary = _mixed([counts[0], counts[1], counted(ordinary_strings())], ORDINARY_SHARES)
    return ratios(_mixed([counts[2], counted(random_strings())], RANDOM_SHARES), ordinary)


def looks_random(string: str, model: np.ndarray) -> bool:
    total = float(model[transitions(string)].sum())
    return total >= TOTAL and total >= EACH * (len(string) - 1)


def all_spans(text: str, model: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans: with candidates that look random and touch no base span.

    Candidates come in order and apart, so one pass over the base spans tells which are touched:
    of those that begin before a candidate's end, the furthest end counts.
    """
    base = base_spans(text)
    more, k, reach = [], 0, 0
    for c in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < c.end():
            reach = max(reach, base[k][1])
            k += 1
        if reach <= c.start() and looks_random(c[0], model):
            more.append((c.start(), c.end(), "markov"))
    return base, _ordered(base + more)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None) -> DataFrame:
    """Return ``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans`` for every row.

    ``spans`` are ``kind:start:end`` in code points, end exclusive, by start and then kind,
    comma-joined; ``base_sha256`` is the digest of the same for the fixed patterns alone. Null
    is read as empty; texts without a secret have empty ``spans``, and texts may be of any length.
    Repeated rows, null ids and ids of any type are kept as they are; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    model = fit(docs, text_col) if model is None else model

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base string, spans string")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        for batch in texts:
            out = []
            for text in batch:
                base, spans = all_spans(text, model)
                kinds = [k for _, _, k in spans]
                out.append((*(kinds.count(k) for k in KINDS), joined(base), joined(spans)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    found = docs.select(F.col(id_col).alias("doc_id"), scan(text_of(text_col)).alias("s"))
    return found.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.n_markov", F.sha2("s.base", 256).alias("base_sha256"), "s.spans")
