"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda (best score first, leftmost of equals); each candidate is skipped when a keyed hash of the
seed, the document, the running number of the word, the candidate's place and its length falls below the dropout rate.  Every occurrence of a word
is so decided on its own, and reruns agree.

What the agenda of a word does is kept as a decision tree per worker (``Tree``): a node holds the candidates that are taken from there on if none is
skipped, and the pieces they lead to; skipping one of them leads to a child.  Occurrences walk their trees together: one array operation hashes
all candidates of all occurrences at a level, those with a skip go on to a child, and nodes met for the first time are made by running
the agendas of all of them side by side, a merge of each per round.  The trees only keep what would be computed again; they never change a result.

No piece of the model has a space mark behind another character (checked when it is loaded), so words are segmented one by one; a model with
such pieces is segmented as one word per text.  Characters without a piece become byte pieces, and so does a literal U+2581, which keeps
decoding lossless for every text.

Defined results: null and empty texts give no pieces; repeated rows get the same pieces, unless ``encoded`` is told that they are copies to vary;
documents without a key are told apart by their text; words of more than ``KEPT_WORD`` characters are segmented at every occurrence (in n log n beyond
``LONG_WORD``), and very long texts are encoded whole; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = "▁"
#: Nodes of decision trees that a worker keeps; with more it starts anew.
CACHED = 600_000
#: Texts that are encoded together.
TOGETHER = 512
KEPT_WORD, LONG_WORD = 20, 48
#: Words are segmented together with those of similar length.
WIDTHS = (6, 9, 13, KEPT_WORD, LONG_WORD)
PLACE, SIZE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
M64 = (1 << 64) - 1
NEVER = 1 << 40
SPREAD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.data, self.size = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> int:
        """Append values; the place of the first."""
        at, self.size = self.size, self.size + len(values)
        if self.size > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(len(self.data), len(values)), self.data.dtype)))
        self.data[at : self.size] = values
        return at


class Tree:
    """Nodes of the decision trees of words; node 0 stands for a literal U+2581."""

    def __init__(self, literal: list[int]):
        self.roots: dict[str | None, int] = {}
        self.words: list[str | None] = []
        #: spans (place and length in one number) that are skipped on the way to a node
        self.skips: list[tuple[int, ...]] = []
        self.depth, self.path_at, self.path_n, self.ids_at, self.ids_n = (Grown(np.int64) for _ in range(5))
        self.spans, self.child, self.ids = Grown(np.int64), Grown(np.int64), Grown(np.int32)
        self.add([None], [()], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.array(literal), np.array([len(literal)]))
        self.roots[None] = 0

    def add(self, words: list, skips: list, depth: np.ndarray, spans: np.ndarray, n_spans: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
        """Numbers of new nodes, given their paths and ids one after another."""
        first = len(self.words)
        self.words += words
        self.skips += skips
        self.depth.extend(depth)
        at = self.spans.extend(spans)
        self.child.extend(np.full(len(spans), -1))
        self.path_at.extend(at + np.cumsum(n_spans) - n_spans)
        self.path_n.extend(n_spans)
        at = self.ids.extend(ids)
        self.ids_at.extend(at + np.cumsum(n_ids) - n_ids)
        self.ids_n.extend(n_ids)
        return np.arange(first, len(self.words))


class DropoutEncoder:
    """Encoder and decoder of one model (its bytes), for one seed and rate."""

    def __init__(self, model: bytes, rate: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in normal}
        by_score = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = {names[i]: k for k, i in enumerate(by_score)}
        self.byte = {int(names[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.raw = [b""] * self.size
        for i in normal:
            self.raw[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        apart = not any(SPACE in n.lstrip(SPACE) for n in self.ids)
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else "(?s).+")
        self.rate, self.seed, self.below = rate, seed, int(rate * (1 << 64))
        # characters without a piece have numbers of their own beyond the pieces, and join no pair
        self.letters = np.arange(0x110000, dtype=np.int32) + self.size
        for name, i in self.ids.items():
            if len(name) == 1:
                self.letters[ord(name)] = i
        self.pair_table()
        self.literal = [self.byte[b] for b in SPACE.encode()]
        self.tree = Tree(self.literal)

    def pair_table(self) -> None:
        """Open-addressed table of the pairs of pieces that make a piece: rank and id of the result."""
        pairs = []
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                if (a := self.ids.get(name[:cut])) is not None and (b := self.ids.get(name[cut:])) is not None:
                    pairs.append((a << 21 | b, self.rank[name], i))
        self.shift = 64 - max(12, (8 * len(pairs)).bit_length())
        size = 1 << (64 - self.shift)
        self.pair_keys, self.pair_ranks, self.pair_ids = np.full(size, -1, np.int64), np.full(size, NEVER, np.int64), np.zeros(size, np.int32)
        for k, rank, i in pairs:
            slot = (k * SPREAD & M64) >> self.shift
            while self.pair_keys[slot] >= 0:
                slot = (slot + 1) % size
            self.pair_keys[slot], self.pair_ranks[slot], self.pair_ids[slot] = k, rank, i

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs of ids in the table; an empty slot (rank NEVER) where the pair makes no piece."""
        keys = left.astype(np.int64) << 21 | right
        slots = ((keys.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(self.shift)).astype(np.int64)
        wrong = np.flatnonzero(((got := self.pair_keys[slots]) != keys) & (got >= 0))
        while len(wrong):
            slots.flat[wrong] = (slots.flat[wrong] + 1) % len(self.pair_keys)
            got = self.pair_keys[slots.flat[wrong]]
            wrong = wrong[(got != keys.flat[wrong]) & (got >= 0)]
        return slots

    def by_width(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of up to LONG_WORD characters by similar length: their numbers, and rows of piece ids and piece lengths (0 beyond the end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        firsts = np.cumsum(sizes) - sizes
        codes = self.letters[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        width = np.searchsorted(WIDTHS, sizes)
        for number, w in enumerate(WIDTHS):
            group = np.flatnonzero(width == number)
            for at in range(0, len(group), 1 << 14):
                part = group[at : at + (1 << 14)]
                columns = np.arange(w + 1)  # one place is always beyond the end
                inside = columns < sizes[part][:, None]
                yield part, np.where(inside, codes[np.minimum(firsts[part][:, None] + columns, len(codes) - 1)], 0), inside.astype(np.int32)

    def agenda(self, ids: np.ndarray, sizes: np.ndarray, gone: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Runs the agendas of words in place, a merge of each per round; the rows and spans of the merges, by row and in order.

        Skipped are the spans of ``gone`` (one row each, -1 for none), and with ``keys`` those that the keyed hash has below the rate.
        """
        last = ids.shape[1] - 1
        columns = np.arange(last + 1)
        rest, p, z = np.arange(len(ids)), ids.copy(), sizes.copy()
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rest):
            slots = self.pairs(p[:, :-1], p[:, 1:])
            ranks = self.pair_ranks[slots]
            ranks[z[:, 1:] == 0] = NEVER
            start = np.cumsum(z, axis=1)[:, :-1] - z[:, :-1]
            size = z[:, :-1] + z[:, 1:]
            if keys is not None and self.below:
                ranks[self.skipped(keys[:, None], start.astype(np.uint64), size.astype(np.uint64))] = NEVER
            if gone.shape[1]:
                spans = start << 6 | size
                for k in range(gone.shape[1]):
                    ranks[spans == gone[:, k : k + 1]] = NEVER
            best = ranks.argmin(axis=1)
            row = np.arange(len(rest))
            going = ranks[row, best] < NEVER
            if not going.all():
                ended = ~going
                ids[rest[ended]], sizes[rest[ended]] = p[ended], z[ended]
                row, best, rest, p, z, gone = row[going], best[going], rest[going], p[going], z[going], gone[going]
                keys = keys[going] if keys is not None else None
            taken.append((rest, start[row, best] << 6 | size[row, best]))
            k = np.arange(len(rest))
            p[k, best] = self.pair_ids[slots[row, best]]
            z[k, best] += z[k, best + 1]
            take = columns + (columns > best[:, None])
            take[:, last] = last  # always beyond the end
            take += (k * (last + 1))[:, None]
            p, z = p.ravel()[take], z.ravel()[take]
        rows = np.concatenate([x for x, _ in taken]) if taken else np.zeros(0, np.int64)
        order = np.argsort(rows, kind="stable")
        return rows[order], (np.concatenate([x for _, x in taken])[order] if taken else rows)

    def flat(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows one after another, characters without a piece as bytes; and how many each row has."""
        inside = sizes > 0
        out, counts = ids[inside], inside.sum(axis=1)
        strange = np.flatnonzero(out >= self.size)
        if len(strange):
            spelt = [[self.byte[b] for b in chr(i).encode()] for i in (out[strange] - self.size).tolist()]
            more = np.ones(len(out), np.int64)
            more[strange] = list(map(len, spelt))
            counts = np.add.reduceat(more, np.cumsum(counts) - counts)
            firsts = np.cumsum(more) - more
            out = np.repeat(out, more)
            out[ragged(firsts[strange], more[strange])] = [b for x in spelt for b in x]
        return out, counts

    def grow(self, words: list[str], skips: list[tuple[int, ...]], depth: np.ndarray) -> np.ndarray:
        """Numbers of new nodes for words, what is skipped on the way to them, and the merges made before."""
        found = np.zeros(len(words), np.int64)
        if not words:
            return found
        for part, ids, sizes in self.by_width(words):
            held, deep = [skips[k] for k in part.tolist()], depth[part]
            gone = np.full((len(part), max(map(len, held))), -1, np.int64)
            if gone.shape[1]:
                n = np.fromiter(map(len, held), np.int64, len(held))
                gone[np.repeat(np.arange(len(held)), n), ragged(np.zeros(len(held), np.int64), n)] = [s for x in held for s in x]
            rows, spans = self.agenda(ids, sizes, gone)
            n = np.bincount(rows, minlength=len(part))
            later = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) >= deep[rows]
            out, counts = self.flat(ids, sizes)
            found[part] = self.tree.add([words[k] for k in part.tolist()], held, deep, spans[later], n - deep, out, counts)
        return found

    def alone(self, words: list[str], keys: np.ndarray) -> np.ndarray:
        """Numbers of nodes of their own for single occurrences of long words."""
        found = np.zeros(len(words), np.int64)
        if not words:
            return found
        none = lambda n: ([None] * n, [()] * n, np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64))
        for part, ids, sizes in self.by_width(words):
            self.agenda(ids, sizes, np.zeros((len(part), 0), np.int64), keys[part])
            found[part] = self.tree.add(*none(len(part)), *self.flat(ids, sizes))
        for k, word in enumerate(words):
            if len(word) > LONG_WORD:
                ids = self.spelled(self.merged(word, int(keys[k])))
                found[k] = self.tree.add(*none(1), np.array(ids, np.int32), np.array([len(ids)]))[0]
        return found

    def skipped(self, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the candidate of a place and length is skipped: a keyed hash against the rate."""
        return self.below_rate(key + start * np.uint64(PLACE) + size * np.uint64(SIZE))

    def below_rate(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(29))) < np.uint64(self.below)

    def spelled(self, parts: list[str]) -> tuple[int, ...]:
        """Ids of parts; characters without a piece become bytes."""
        out: list[int] = []
        for part in parts:
            if (known := self.ids.get(part)) is not None:
                out.append(known)
            else:
                out += [self.byte[b] for b in part.encode()]
        return tuple(out)

    def merged(self, word: str, key: int) -> list[str]:
        """Parts of one word (with its keyed hash) by an agenda (a heap of candidates), each skipped as ``skipped`` has it."""
        parts: list[str | None] = list(word)
        n, rank, below = len(parts), self.rank.get, self.below
        after, before = list(range(1, n + 1)), list(range(-1, n))
        agenda = [(r << 32) | i for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFF
            left, j = parts[i], after[i]
            if left is None or j >= n:
                continue
            whole = left + parts[j]
            if rank(whole) != top >> 32:
                continue
            if below:
                h = (key + i * PLACE + len(whole) * SIZE) & M64
                h = ((h ^ (h >> 31)) * 0x94D049BB133111EB) & M64
                if h ^ (h >> 29) < below:
                    continue
            parts[i], parts[j] = whole, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(whole + parts[k])) is not None:
                    heapq.heappush(agenda, (r << 32) | i)
            if (p := before[i]) >= 0 and (r := rank(parts[p] + whole)) is not None:
                heapq.heappush(agenda, (r << 32) | p)
        return [p for p in parts if p is not None]

    def words_of(self, text: str, stream: int) -> tuple[list[str | None], np.ndarray]:
        """Words (None for a literal space mark) and the keys of their places."""
        words: list[str | None] = []
        keys = []
        for number, stretch in enumerate(text.split(SPACE) if text else []):
            if number:
                words.append(None)
                keys.append(np.zeros(1, np.uint64))
            found = self.words.findall((SPACE if number == 0 else "") + stretch.replace(" ", SPACE))
            start = np.uint64(xxhash.xxh64_intdigest(b"%d:%d" % (stream, number), self.seed))
            words += found
            keys.append(mixed(np.arange(len(found), dtype=np.uint64) * np.uint64(SPREAD) + start))
        return words, np.concatenate(keys) if keys else np.zeros(0, np.uint64)

    def leaves(self, words: list[str | None], keys: np.ndarray) -> np.ndarray:
        """The nodes at which the occurrences of words end."""
        if len(self.tree.words) > CACHED:
            self.tree = Tree(self.literal)
        tree, roots = self.tree, self.tree.roots
        at = np.fromiter(map(roots.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(w for k in unknown if len(w := words[k]) <= KEPT_WORD))
            roots.update(zip(new, self.grow(new, [()] * len(new), np.zeros(len(new), np.int64)).tolist(), strict=True))
            at[unknown] = [roots.get(words[k], -1) for k in unknown]
            long = np.flatnonzero(at < 0)
            at[long] = self.alone([words[k] for k in long.tolist()], keys[long])
        active = np.arange(len(words)) if self.below else np.zeros(0, np.int64)
        while len(active):
            on = []
            for k in range(0, len(active), 1 << 16):
                rows = active[k : k + (1 << 16)]
                n = tree.path_n.data[at[rows]]
                places = ragged(tree.path_at.data[at[rows]], n)
                spans, owner = tree.spans.data[places].view(np.uint64), np.repeat(rows, n)
                hit = np.flatnonzero(self.skipped(keys[owner], spans >> np.uint64(6), spans & np.uint64(63)))
                rows = owner[hit]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                on.append((rows[first], places[hit[first]]))
            active, places = (np.concatenate(x) for x in zip(*on, strict=True))
            new, where = np.unique(places[tree.child.data[places] < 0], return_index=True)
            if len(new):
                parents = at[active[tree.child.data[places] < 0][where]]
                skips = [(*tree.skips[p], s) for p, s in zip(parents.tolist(), tree.spans.data[new].tolist(), strict=True)]
                depth = tree.depth.data[parents] + new - tree.path_at.data[parents]
                grown = self.grow([tree.words[p] for p in parents.tolist()], skips, depth)
                tree.child.data[new] = grown
            at[active] = tree.child.data[places]
        return at

    def encode_flat(self, texts: list[str], streams: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        split = [self.words_of(t, s) for t, s in zip(texts, streams, strict=True)]
        keys = np.concatenate([k for _, k in split]) if split else np.zeros(0, np.uint64)
        at = self.leaves([w for words, _ in split for w in words], keys)
        n = self.tree.ids_n.data[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        borders = ends[np.cumsum([0, *(len(words) for words, _ in split)])]
        return self.tree.ids.data[ragged(self.tree.ids_at.data[at], n)], np.diff(borders)

    def encode_batch(self, texts: list[str], streams: list[int]) -> list[list[int]]:
        """Ids of texts."""
        ids, counts = self.encode_flat(texts, streams)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def encode(self, text: str, stream: int = 0) -> list[int]:
        """Ids of a text; ``stream`` (a number of its own for each document) varies the segmentations."""
        return self.encode_batch([text], [stream])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation, byte for byte."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


_encoders: dict[tuple, DropoutEncoder] = {}


def encoder_of(model: bytes, rate: float, seed: int) -> DropoutEncoder:
    key = (hash(model), rate, seed)
    if key not in _encoders:
        _encoders[key] = DropoutEncoder(model, rate, seed)
    return _encoders[key]


def stream_of(doc: int | None, copy: int, text: str) -> int:
    """The number that stands for a document, or for a later copy of it."""
    if doc is not None and not copy:
        return doc
    return xxhash.xxh64_intdigest(b"%d:%d:" % (-1 if doc is None else doc, copy) + text.encode())


def encoded(df: DataFrame, model: str, rate: float = 0.1, seed: int = 7, key: str = "doc_id", text: str = "text", copies: bool = False) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, lossless (whether the ids decode to the text).

    With ``copies``, rows that repeat a document (its epochs) are numbered and each is segmented on its own.
    """
    with open(model, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data.value, rate, seed)
        raw = encoder.raw.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts = part.column(1).to_pylist()
                streams = map(stream_of, part.column(0).to_pylist(), part.column(2).to_pylist(), texts)
                ids, counts = encoder.encode_flat(texts, list(streams))
                ends = np.concatenate(([0], np.cumsum(counts)))
                same = [b"".join(map(raw, ids[a:b].tolist()))[1:] == t.encode() for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "lossless"])

    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same_document = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    docs = docs.withColumn("copy", F.row_number().over(same_document) - 1 if copies else F.lit(0))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, lossless boolean")


def decoded(df: DataFrame, model: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """doc_id and text of encoded rows (null ids: the empty text)."""
    with open(model, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data.value, 0.0, 0)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], names=["doc_id", "text"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
