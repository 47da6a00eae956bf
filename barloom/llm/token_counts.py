"""Exact token counts at every prefix by dynamic programming, for byte-level BPE vocabularies.

Within one pre-token, the encoding of a prefix ends in the one token whose pairing with the last token of the prefix
before it is stable, so last[i] and count[i] follow from shorter prefixes: one pass gives the exact count at every byte,
and the whole tables of pre-tokens are kept, as most pre-tokens recur.  Per document the operator stores
the ends of the pre-tokens and the counts summed up to them.  A budget is then a binary search among the pre-tokens and
a look into the tables of those at the budget (``PrefixCounter.fit``), and the count at any place is that of the last boundary plus a tail
of one or two pre-tokens.  The query takes its counts and its limit from these tables.

Defined results: a null text is the empty text with no bytes and no tokens; special strings inside a
text are one token each, as the library has it; repeated rows are each answered; very long texts are counted whole; an empty table gives an empty result;
other columns, whatever their names, are not read.
The vocabulary is read on the driver from a path that is a parameter, and its bytes (fixed, 1.6 MB) travel with the tasks as a broadcast.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space next to other white space; anywhere else a space begins a pre-token.
JOINED_SPACE = r"\p{White_Space} | \p{White_Space}"
CACHED = 300_000
LONG_PIECE = 256
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


class Kept(dict):
    """Values of short keys, computed when they are first asked for; emptied when it is full."""

    def __init__(self, compute: Callable[[str], int | list[int]]):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> int | list[int]:
        value = self.compute(key)
        if len(key) <= LONG_PIECE:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Counts of all prefixes of texts under one vocabulary (the JSON of a byte-level BPE tokenizer)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        if lacking := [b for b in range(256) if bytes([b]) not in {raw(k) for k in vocab if len(k) == 1}]:
            raise ValueError(f"the vocabulary lacks {len(lacking)} bytes")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # tokens by number: the bytes, then the merged tokens in order of rank
        self.index = {bytes([i]): i for i in range(256)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right = self.index[raw(a)], self.index[raw(b)]
            number = self.index.setdefault(raw(a) + raw(b), len(self.halves))
            if number == len(self.halves):
                self.halves.append((left, right))
            self.joined.setdefault((left, right), number)
        self.special = [t["content"] for t in spec.get("added_tokens", ()) if t.get("special")]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces, self.joined_space = regex.compile(PATTERN), regex.compile(JOINED_SPACE)
        self.suffixes = ahocorasick.Automaton()
        for token, number in self.index.items():
            self.suffixes.add_word(token.decode("latin-1"), (number, len(token)))
        self.suffixes.make_automaton()
        self.tables = Kept(lambda piece: self.table(piece.encode()))
        self.totals = Kept(lambda piece: self.tables[piece][-1])
        by_pieces = lambda text: sum(map(self.totals.__getitem__, self.pieces.findall(text)))
        self.words, self.spaced = Kept(by_pieces), Kept(lambda word: by_pieces(" " + word))

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when they meet.

        They would not, if a merge across the border came before the merges that make them up: walk both back along the border,
        the later made one first, and look for a pair whose merge is earlier than what has been taken apart.
        """
        joined, halves = self.joined.get, self.halves
        limit = 1 << 60
        while True:
            if joined((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def table(self, piece: bytes) -> list[int]:
        """count[i]: tokens of the first i bytes of one pre-token, each prefix encoded on its own."""
        count, last, fits = [0], [-1], self.fits
        # all tokens that end at each place, the longest first
        for end, (token, size) in self.suffixes.iter(piece.decode("latin-1")):
            if len(count) == end + 1:
                start = end + 1 - size
                if start == 0 or fits(last[start], token):
                    count.append(count[start] + 1)
                    last.append(token)
        return count

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches between special strings, and the special strings."""
        if not self.split:
            yield text, False
            return
        at = 0
        for m in self.split.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def prefixes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pre-tokens in characters, and the tokens up to each."""
        sizes: list[int] = []
        counts: list[int] = []
        totals = self.totals.__getitem__
        for part, is_special in self.parts(text):
            if is_special:
                sizes.append(len(part))
                counts.append(1)
                continue
            found = self.pieces.findall(part)
            sizes += map(len, found)
            counts += map(totals, found)
        return np.cumsum(np.array(sizes, np.int64)), np.cumsum(np.array(counts, np.int64))

    def count(self, text: str) -> int:
        """Tokens of a text: the sum over its words, each with the space before it, where spaces stand alone."""
        n = 0
        for part, is_special in self.parts(text):
            if is_special:
                n += 1
            elif self.joined_space.search(part):
                n += sum(map(self.totals.__getitem__, self.pieces.findall(part)))
            elif part:
                first, *words = part.split(" ")
                n += (self.words[first] if first else 0) + sum(map(self.spaced.__getitem__, words))
        return n

    def count_at(self, text: str, ends: np.ndarray, counts: np.ndarray, place: int) -> int:
        """Tokens of the first ``place`` characters: the table, and the pre-tokens the cut may change."""
        k = max(0, bisect_right(ends, place) - 2)  # the cut may join the last two pre-tokens, if they are white space
        start = int(ends[k - 1]) if k else 0
        return (int(counts[k - 1]) if k else 0) + self.count(text[start:place])


    def fit(self, text: str, ends: np.ndarray, counts: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix within a budget of tokens, which may end inside a pre-token.

        Counts of prefixes may fall again (a special string is complete, white space joins), so places are tried from the last
        one down whose certain part (all but the last two pre-tokens) is within the budget.
        """
        if budget < 0:
            return 0
        for k in range(min(bisect_right(counts, budget) + 2, len(ends) - 1), -1, -1):
            start, end = int(ends[k - 1]) if k else 0, int(ends[k])
            before, piece = int(counts[k - 1]) if k else 0, text[start:end]
            spaces = piece.isspace()
            # cut anywhere, these are pre-tokens as they are, but for white space that joins the white space before it
            whole = piece not in CONTRACTIONS and piece not in self.special and not (spaces and start and text[start - 1].isspace())
            table, at = (self.tables[piece], len(piece.encode())) if whole else ((), 0)
            for place in range(end, start, -1):
                if whole and (spaces or place > start + 1 or not piece[0].isspace()):
                    n = before + table[at]
                else:
                    n = self.count_at(text, ends, counts, place)
                if n <= budget:
                    return place
                at -= len(text[place - 1].encode())
        return 0


def fit(ends: np.ndarray, counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of whole pre-tokens within a budget of tokens, without the text; ``PrefixCounter.fit`` looks inside them."""
    k = bisect_right(counts, budget)
    return int(ends[k - 1]) if k else 0


_counters: dict[int, PrefixCounter] = {}


def counter_of(data: bytes) -> PrefixCounter:
    """One counter per worker process and vocabulary."""
    key = hash(data)
    if key not in _counters:
        _counters[key] = PrefixCounter(data)
    return _counters[key]


def prefix_tables(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", tables: bool = True, limit: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, with ``limit`` also n_chars and n_fit (characters of the longest prefix within it), and with ``tables`` ends and counts (arrays of int) of every document."""
    with open(vocabulary, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(data.value)
        for batch in batches:
            n_bytes, n_tokens, n_chars, n_fit, all_ends, all_counts = [], [], [], [], [], []
            for value in batch.column(1):
                t = value.as_py()
                ends, counts = counter.prefixes(t)
                n_bytes.append(len(t.encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                if limit is not None:
                    n_chars.append(len(t))
                    n_fit.append(len(t) if n_tokens[-1] <= limit else counter.fit(t, ends, counts, limit))
                if tables:
                    all_ends.append(ends.astype(np.int32))
                    all_counts.append(counts.astype(np.int32))
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            if limit is not None:
                columns += [pa.array(x, pa.int64()) for x in (n_chars, n_fit)]
            if tables:
                columns += [pa.array(x, pa.list_(pa.int32())) for x in (all_ends, all_counts)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {"doc_id": "long", "n_bytes": "long", "n_tokens": "long"}
    kinds |= {"n_chars": "long", "n_fit": "long"} if limit is not None else {}
    kinds |= {"ends": "array<int>", "counts": "array<int>"} if tables else {}
    names, schema = list(kinds), ", ".join(f"{n} {k}" for n, k in kinds.items())
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.mapInArrow(run, schema)


def digest(df: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    found = prefix_tables(df, vocabulary, tables=False, limit=limit)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_fit") < F.col("n_chars")).alias("over_limit"))
