"""A trigram language model over words in sharded Elias-Fano tries, and its scores.

Exchange. A partition's texts are handled in blocks of BLOCK_BYTES. Nothing is looked up from within a task that scans
texts: each block sends its distinct entries, sorted and with their counts, to the shards that own them, and each
shard returns what it knows of them in the same order, filed by the partition that asked. So a task opens one shard
or one block, whatever the size of the model.

1. Words, known by 62 bits of a hash, go to shards by ranges of the hash. A shard counts and numbers its words and
   returns number, count, and which trie shard the word's contexts are in.
2. Trigrams go to trie shards, as small tries themselves: words, the words after each, and the words after those.
   Trie shards are cut by the words' counts, SHARD_TOKENS each; a word that has more is cut by the word after it, so
   that a shard is a range or a part of contexts (first, second word) and the commonest word is no task of its own.
3. Each block is read again and scored from what came back.

Model. Interpolated Witten-Bell: p(w | h) = (c(hw) + t(h) p(w | h')) / (c(h) + t(h)), t(h) the number of words seen
after h; p(w) = (c(w) + 1) / (all words and ends + vocabulary). Every word, bigram and trigram is in the model, those
seen once too. A word that the model hasn't seen has a count of 0, and so is neither context nor successor.

Scores of the documents counted. In a model that has counted the text itself, a text of words that occur nowhere else
is the likeliest of all. So score_documents() takes a text's own counts, exactly, from those of its words, bigrams,
trigrams and successors: each text has its probability under the model of all other texts, over the vocabulary of all.
score() leaves the counts as they are, for other texts than those counted. A quantised probability can't be relieved of
a text's share; so the levels hold counts, from which the smoothed probability is made when it is asked for.

Trie. A shard has three levels, words, bigrams and trigrams. Each level's entries and each level's pointers into the
next are Elias-Fano sequences. An entry is stored relative to its context, as context number times the vocabulary plus
the word's number, which rises through the level; a query looks up the successor of that number, and t(h) is the
distance of two pointers. Counts are bytes, and those over 254 a list by place. Shards are files in the shared folder,
mapped into memory by the task that asks them (read into memory where that folder is not a file system).

Defined results. The score of a text is the natural logarithm of the probability of its words and of an end mark;
unknown tells how many of its words the model (for score_documents(): any other text) doesn't have.
A null text, or one without words, has 0 words and null scores. Repeated rows count each and get equal scores. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano
from .exchange import ROW_BITS, file_by_partition, read_own, shared_path, small_batches, stable, with_row_id
from .text import buffers, mix64, word_hashes, word_spans

#: Text that a task holds at once, unless one text is longer; words of a word shard at most, by the texts' size;
#: positions of a trie shard, on average. They change no result. The number of messages is blocks times shards, so beyond
#: GROW_FROM bytes of text, where a message has some hundred entries, blocks and trie shards grow with the root of the size.
BLOCK_BYTES = 6 << 20
SHARD_WORDS = 6_000_000
SHARD_TOKENS = 1_500_000
GROW_FROM = 80 * 10**9
_WORD_BYTES = 6
HASH_BITS = 62
UNKNOWN = 0
_PIECE = 1 << 20
#: Positions that are scored at once, unless one text has more.
_SCORED = 1 << 18
_ZSTD = pa.Codec("zstd", compression_level=1)
_SENT = "row long, block long, shard int, data binary"


def release() -> None:
    """Give what was freed back to the system: a worker waits for later tasks, and would keep the most that one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers from 0 to 2 ** 63, as the compressed planes of the bytes of each."""
    out = []
    for c in columns:
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        code = _ZSTD.compress(planes, asbytes=True)
        out += [np.array([len(c), width, len(code)], np.int64).tobytes(), code]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        n, width, size = np.frombuffer(data, np.int64, 3, at).tolist()
        planes = np.frombuffer(_ZSTD.decompress(data[at + 24 : at + 24 + size], n * width, asbytes=True), np.uint8).reshape(width, n)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = planes.T
        out.append(full.view("<u8").ravel().astype(np.int64))
        at += 24 + size
    return out


def in_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys of so many bits, and the keys in it. With the place in the bits that a key leaves,
    plain sorting does, which is several times faster than sorting places by key."""
    room = max(1, (len(key) - 1).bit_length())
    if bits + room > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = key.astype(np.uint64)
    both <<= np.uint64(room)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    order = both & np.uint64((1 << room) - 1)
    both >>= np.uint64(room)
    return order.view(np.int64), both.view(np.int64)


def grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of keys: their order, where in it each distinct one begins, how many there are of it, and for each key the
    number of its group."""
    order, ordered = in_order(key, bits)
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    first = np.flatnonzero(new)
    number = np.cumsum(new)
    number -= 1
    group = np.empty(len(key), np.int64)
    group[order] = number
    return order, first, np.diff(first, append=len(key)), group


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of hashes of HASH_BITS, and for each hash its place among them."""
    room = max(1, (len(h) - 1).bit_length())
    cut = max(0, HASH_BITS + room - 64)
    order, first, _, group = grouped(h >> cut, HASH_BITS - cut)
    known = h[order[first]]
    if cut and not np.array_equal(known[group], h):  # two that differ in the last bits only
        return np.unique(h, return_inverse=True)
    return known, group


def sums_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


class Counts:
    """Counts as bytes; those over 254 are in a list by place."""

    def __init__(self, small: np.ndarray, places: np.ndarray, large: np.ndarray):
        self.small, self.places, self.large = small, places, large

    @classmethod
    def encode(cls, values: np.ndarray) -> Counts:
        places = np.flatnonzero(values > 254)
        return cls(np.minimum(values, 255).astype(np.uint8), places.astype(np.int64), values[places].astype(np.int64))

    def parts(self) -> list[np.ndarray]:
        return [self.small, self.places, self.large]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The counts at i; of -1 it is 0."""
        if not len(self.small):
            return np.zeros(len(i), np.int64)
        out = np.where(i >= 0, self.small[i], 0).astype(np.int64)
        over = np.flatnonzero(out == 255)
        out[over] = self.large[np.searchsorted(self.places, i[over])]
        return out


def write_file(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after another, each at a multiple of 8 bytes, then their kinds, places and lengths. The file is
    written under another name first, so that a task that runs twice leaves one whole file."""
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rpartition("/")[0])
    places, size, draft = [], 0, f"{at}.{np.random.default_rng().integers(1 << 62)}"
    with system.open_output_stream(draft) as out:
        for a in arrays:
            places += [{"int64": 0, "uint64": 1, "uint8": 2}[a.dtype.name], size, len(a)]
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
            size += a.nbytes + -a.nbytes % 8
        out.write(np.array([*places, len(arrays)], np.int64).tobytes())
    system.move(draft, at)


def read_file(path: str) -> list[np.ndarray] | None:
    """The arrays of a file, mapped into memory; None if there is no such file."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    if isinstance(system, fs.LocalFileSystem):
        raw = np.asarray(np.memmap(at, np.uint8, "r"))
    else:
        with system.open_input_stream(at) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[-8:].view(np.int64)[0])
    places = raw[-8 - 24 * n : -8].view(np.int64).reshape(n, 3)
    kinds = [np.int64, np.uint64, np.uint8]
    return [raw[o : o + c * np.dtype(kinds[k]).itemsize].view(kinds[k]) for k, o, c in places.tolist()]


def hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin; hashed in pieces, as that takes 32 bytes for each of text."""
    s, e, first = word_spans(raw, offsets)
    h, i = np.zeros(len(s), np.int64), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(s, s[i] + _PIECE)))
        a, z = s[i], e[j - 1]
        h[i:j] = (word_hashes(raw[a:z], s[i:j] - a, e[i:j] - a) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        i = j
    return h, first


class Shard:
    """A trie over the contexts of a shard."""

    def __init__(self, arrays: list[np.ndarray]):
        self.words, self.pointers1, self.level2, self.pointers2, self.level3 = (EliasFano(*arrays[i : i + 6]) for i in range(0, 30, 6))
        self.c2, self.c3 = Counts(*arrays[30:33]), Counts(*arrays[33:36])

    @classmethod
    def build(cls, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, count: np.ndarray, size: int) -> list[np.ndarray]:
        """The arrays of a shard from trigrams in any order, repeated or not. w2 = size - 1 ends a text, and such rows
        are bigrams only."""
        return cls.encoded(*cls.distinct([w1, w2, w3, count], size), size)

    @staticmethod
    def distinct(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
        """First and second words of the distinct bigrams in order; of the distinct trigrams the bigram's number, the third
        word and the count. columns: first, second and third words and counts, which are taken from the list and let go
        once they are used, as a shard is the most that a worker holds."""
        count, w3, w2, w1 = (columns.pop() for _ in range(4))
        least = int(w1.min(initial=size))
        bits = lambda n: int(n).bit_length()
        key = w1.astype(np.int64)
        key -= least
        key *= size
        key += w2
        order, first2, _, pair = grouped(key, bits((int(w1.max(initial=least)) - least + 1) * size))
        some = order[first2]
        p1, p2 = w1[some].astype(np.int64), w2[some].astype(np.int64)
        del key, order, first2, some, w1, w2
        if bits(len(p1)) + bits(size) < 63:
            key = pair
            key *= size
            key += w3
            order, ordered = in_order(key, bits(len(p1) * size))
            del key, pair, w3
            first3 = np.flatnonzero(np.diff(ordered, prepend=-1))
            ordered = ordered[first3]
            t, last = ordered // size, ordered % size
        else:
            order = np.lexsort((w3, pair))
            first3 = np.flatnonzero((np.diff(pair[order], prepend=-1) != 0) | (np.diff(w3[order], prepend=-1) != 0))
            t, last = pair[order[first3]], w3[order[first3]].astype(np.int64)
        return p1, p2, t, last, sums_of(count[order], first3).astype(np.int64)

    @staticmethod
    def encoded(p1: np.ndarray, p2: np.ndarray, t: np.ndarray, last: np.ndarray, c: np.ndarray, size: int) -> list[np.ndarray]:
        c2 = np.bincount(t, c, len(p1)).astype(np.int64)
        event = p2[t] != size - 1
        c, t, last = c[event], t[event], last[event]
        words, first = np.unique(p1, return_index=True)
        of = np.repeat(np.arange(len(words)), np.diff(first, append=len(p1)))
        pointers2 = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(p1)))])
        out = []
        for values, universe in (
            (lambda: words, size), (lambda: np.append(first, len(p1)), len(p1) + 1), (lambda: of * size + p2, max(1, len(words)) * size),
            (lambda: pointers2, len(c) + 1), (lambda: t * size + last, max(1, len(p1)) * size),
        ):
            out += EliasFano.encode(values(), universe).parts()
        return out + Counts.encode(c2).parts() + Counts.encode(c).parts()

    @staticmethod
    def children(pointers: EliasFano, at: np.ndarray) -> np.ndarray:
        """How many children each entry has; -1 has none."""
        out, known = np.zeros(len(at), np.int64), np.flatnonzero(at >= 0)
        out[known] = pointers.access(at[known] + 1) - pointers.access(at[known])
        return out

    @staticmethod
    def below(level: EliasFano, context: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
        """The place of each word among the children of its context; -1 if it is none of them."""
        out = np.full(len(word), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        out[known] = level.find(context[known] * size + word[known])
        return out

    def answer(self, a1: np.ndarray, n2: np.ndarray, a2: np.ndarray, n3: np.ndarray, a3: np.ndarray, size: int) -> list[np.ndarray]:
        """t of words; c and t of bigrams, n2 for each word; c of trigrams, n3 for each bigram."""
        one = self.words.find(a1)
        two = self.below(self.level2, np.repeat(one, n2), a2, size)
        three = self.below(self.level3, np.repeat(two, n3), a3, size)
        return [self.children(self.pointers1, one), self.c2.access(two), self.children(self.pointers2, two), self.c3.access(three)]


def grown(size: int, block_bytes: int, tokens: int) -> tuple[int, int]:
    """Bytes of a block and positions of a trie shard for texts of so many bytes."""
    factor = max(1.0, (size / GROW_FROM) ** 0.5)
    return int(block_bytes * factor), int(tokens * factor)


def planned(c1: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """For the words of a word shard with these counts, the first of the trie shards that a word's contexts are in, and
    how many these are."""
    parts = np.maximum(1, -(-c1 // tokens))
    cut = c1 > tokens // 2  # so that no range goes far beyond tokens
    shard = np.maximum(np.cumsum(np.where(cut, 0, c1)) - 1, 0) // tokens
    shard[cut] = int(shard[~cut].max(initial=-1)) + 1 + np.cumsum(parts[cut]) - parts[cut]
    return shard, parts


class Block:
    """Texts of a partition: the words of all, an end mark after each text that has words, and their distinct bigrams and
    trigrams in order."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, trigrams: bool = True):
        h, first = hashes(raw, offsets)
        self.words, rank = ranked(h)
        self.lengths = np.diff(first)
        self.end = len(self.words)
        if not trigrams:
            self.word_counts = np.bincount(rank, minlength=self.end)
            return
        sizes = self.lengths + (self.lengths > 0)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.full(int(self.begin[-1]) + 2, self.end, np.int64)
        self.at = np.arange(len(h)) + np.repeat(np.cumsum(self.lengths > 0) - (self.lengths > 0), self.lengths)
        self.rank[self.at] = rank
        # a start is a word's place: with the one after it a bigram, with the one after that a trigram
        second = self.rank[self.at + 1]
        third = np.where(second == self.end, self.end, self.rank[self.at + 2])
        wide = self.end + 1
        order, first2, _, self.pair = grouped(rank * wide + second, 2 * wide.bit_length())
        self.p1, self.p2 = rank[order[first2]], second[order[first2]]
        order, first3, self.counts, self.trigram = grouped(self.pair * wide + third, wide.bit_length() + len(self.p1).bit_length())
        self.pair_of, self.third = self.pair[order[first3]], third[order[first3]]

    def route(self, number: np.ndarray, shard: np.ndarray, parts: np.ndarray, size: int) -> None:
        """Put words, bigrams and trigrams into the order in which they go to the shards. A word in no shard isn't sent,
        nor is what begins with it."""
        if len(number) != self.end:
            raise RuntimeError(f"the scan changed between its passes: {len(number)} words before, {self.end} now")
        asker = np.repeat(np.arange(self.end), parts)
        part = np.arange(len(asker)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.by_shard = np.argsort(shard[asker] + part, kind="stable")
        self.asker, self.shard = asker[self.by_shard], (shard[asker] + part)[self.by_shard]
        where = np.empty(len(asker), np.int64)
        where[self.by_shard] = np.arange(len(asker))
        number = np.append(number, size - 1)
        sent = np.flatnonzero(parts[self.p1] > 0)
        p1, p2 = self.p1[sent], number[self.p2[sent]]
        mine = (mix64(p2.astype(np.uint64)) % parts[p1].astype(np.uint64)).astype(np.int64)
        ask = where[(np.cumsum(parts) - parts)[p1] + mine]
        order, _ = in_order(ask, len(asker).bit_length())
        self.pairs_sent, self.n2 = sent[order], np.bincount(ask, minlength=len(asker))
        place = np.full(len(self.p1), len(self.p1))
        place[self.pairs_sent] = np.arange(len(sent))
        order, ordered = in_order(place[self.pair_of], (len(self.p1) + 1).bit_length())
        self.trigrams_sent = order[: int(np.searchsorted(ordered, len(self.p1)))]
        self.n3 = np.bincount(self.pair_of, minlength=len(self.p1))[self.pairs_sent]
        self.asked = number[self.asker], number[self.p2[self.pairs_sent]], number[self.third[self.trigrams_sent]]

    def messages(self, counted: bool) -> Iterator[tuple[int, bytes]]:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.shard)) + 1, [len(self.shard)]])
        ends2 = np.concatenate([[0], np.cumsum(self.n2)])
        ends3 = np.concatenate([[0], np.cumsum(self.n3)])
        counts = self.counts[self.trigrams_sent] if counted else np.zeros(len(self.trigrams_sent), np.int64)
        a1, a2, a3 = self.asked
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if z > a:
                p, q = int(ends2[a]), int(ends2[z])
                i, j = int(ends3[p]), int(ends3[q])
                yield int(self.shard[a]), pack([np.diff(a1[a:z], prepend=0), self.n2[a:z], a2[p:q], self.n3[p:q], a3[i:j], counts[i:j]])

    def scores(self, c1: np.ndarray, answers: list[list[np.ndarray]], ends: int, total: int, size: int, others: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log probability and number of unknown words of each text. others: without what the text itself counts."""
        t1, c2, t2, c3 = np.zeros(self.end, np.int64), *(np.zeros(len(self.p1), np.int64) for _ in range(2)), np.zeros(len(self.third), np.int64)
        if answers:
            got = [np.concatenate(x) for x in zip(*answers)]
            t1 = np.bincount(self.asker, got[0], self.end).astype(np.int64)
            c2[self.pairs_sent], t2[self.pairs_sent], c3[self.trigrams_sent] = got[1:]
        told, a = [], 0
        while a < len(self.lengths):
            z = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + _SCORED, "right")) - 1)
            told.append(self._scores(a, z, c1, t1, c2, t2, c3, ends, total, size, others))
            a = z
        log, unknown = zip(*told) if told else ((np.zeros(0),), (np.zeros(0, np.int64),))
        return np.concatenate(log), np.concatenate(unknown)

    def _scores(self, a: int, z: int, c1: np.ndarray, t1: np.ndarray, c2: np.ndarray, t2: np.ndarray, c3: np.ndarray, ends: int, total: int, size: int, others: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts from a to z, as what is held of each position is many times its text."""
        start = int(self.begin[a])
        sizes = np.diff(self.begin[a : z + 1])
        text = np.repeat(np.arange(len(sizes)), sizes)
        mine = slice(*np.searchsorted(self.at, [start, self.begin[z]]))
        n, at, trigram, pair_at = len(text), self.at[mine] - start, self.trigram[mine], self.pair[mine]
        total = total - sizes[text] if others else total
        if others:
            # entries of one text, which are also in the order of its bigrams and words
            wide = max(1, len(self.third))
            order, first3, n3, of3 = grouped(text[at] * wide + trigram, (len(sizes) * wide).bit_length())
            some = order[first3]
            pair, owner = pair_at[some], text[at][some]
            first2 = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
            of2 = np.repeat(np.arange(len(first2)), np.diff(first2, append=len(some)))
            n2, pair, owner = sums_of(n3, first2), pair[first2], owner[first2]
            word = self.p1[pair]
            first1 = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
            of1 = np.repeat(np.arange(len(first1)), np.diff(first1, append=len(first2)))
            # a successor that is seen in this text only is none in the others
            alone3, alone2 = sums_of((n3 == c3[trigram[some]]).astype(np.int64), first2), sums_of((n2 == c2[pair]).astype(np.int64), first1)
            here3 = (c3[trigram[some]] - n3)[of3]
            above2, after2 = (c2[pair] - n2)[of2[of3]], (t2[pair] - alone3)[of2[of3]]
            at1 = of1[of2[of3]]
            above1, after1 = (c1[word[first1]] - sums_of(n2, first1))[at1], (t1[word[first1]] - alone2)[at1]
        else:
            here3, above2, after2 = c3[trigram], c2[pair_at], t2[pair_at]
            above1, after1 = c1[self.rank[self.at[mine]]], t1[self.rank[self.at[mine]]]
        p = np.full(n, float(ends - others))
        p[at] = above1
        p = (p + 1) / (total + size)
        # at + 1 is in the same text always, at + 2 unless at + 1 is its end
        mass = above1 + after1
        fine = mass > 0
        i = at[fine] + 1
        p[i] = (above2[fine] + after1[fine] * p[i]) / mass[fine]
        mass = above2 + after2
        fine = (mass > 0) & (self.p2[pair_at] != self.end)
        i = at[fine] + 2
        p[i] = (here3[fine] + after2[fine] * p[i]) / mass[fine]
        unknown = np.bincount(text[at], above1 == 0, len(sizes)).astype(np.int64)
        return np.bincount(text, np.log(p), len(sizes)).astype(float), unknown


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[pa.Array]]]:
    """The partition's first row number, the block's number, its texts and their ids. Blocks are cut by the texts alone,
    so they are the same for each scan. Columns: row, t, and an id where it is wanted."""
    held, size, number, row = [], 0, 0, None

    def joined() -> tuple[int, int, np.ndarray, np.ndarray, list[pa.Array]]:
        lengths = np.concatenate([np.diff(o) for _, o, _ in held])
        return row, number, np.concatenate([r for r, _, _ in held]), np.concatenate([[0], np.cumsum(lengths)]), [x for *_, ids in held for x in ids]

    for b in batches:
        if b.num_rows and row is None:
            row = b.column(0)[0].as_py() >> ROW_BITS << ROW_BITS
        raw, offsets = buffers(b.column(1))
        i = 0
        while i < b.num_rows:
            j = min(b.num_rows, int(np.searchsorted(offsets, offsets[i] + most - size)))
            held.append((raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], [c.slice(i, j - i) for c in b.columns[2:]]))
            size += int(offsets[j] - offsets[i])
            i = j
            if size >= most:
                yield joined()
                held, size, number = [], 0, number + 1
    if held:
        yield joined()


def _record(row: int, block: int, shards: list[int], data: list[bytes]) -> pa.RecordBatch:
    n = len(shards)
    return pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(shards, pa.int32()), pa.array(data, pa.binary())], ["row", "block", "shard", "data"])


def _returned(path: str, row: int) -> dict[int, list[list[np.ndarray]]]:
    """What came back to a partition, by block, in the order of the shards."""
    out: dict[int, list[list[np.ndarray]]] = {}
    found = read_own(path, row >> ROW_BITS, ["block", "shard", "data"], shared=0).sort_by([("block", "ascending"), ("shard", "ascending")])
    for block, data in zip(found.column("block").to_pylist(), found.column("data")):
        out.setdefault(block, []).append(data.as_py())
    return out


def _words_back(held: dict[int, list[bytes]], block: int, base: np.ndarray, tries: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number, count, first trie shard and number of trie shards of each word of a block; base and tries: where each word
    shard's words and trie shards begin."""
    parts = []
    for data in held.get(block, []):
        (shard,), rank, c1, first, many = unpack(data)
        parts.append((np.where(c1 > 0, 1 + base[shard] + np.cumsum(rank), UNKNOWN), c1, tries[shard] + first, many))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))


def _exchange(docs: DataFrame, text_col: str, made: dict | None, reply: bool, most: int, tokens: int = 0, words: int = 0) -> tuple[dict, str, str, int]:
    """Count docs and write the model, or ask one that is made; the model, where the answers about words and about trigrams
    are filed, and the bytes of a block."""
    spark, build = docs.sparkSession, made is None
    slim = small_batches(docs).select("row", F.lower(F.col(text_col)).alias("t"))
    all_bytes = int(docs.select(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)
    most, tokens = grown(all_bytes, most, tokens)
    if build:
        made = {"folder": shared_path(spark, "lm"), "bits": max(0, (all_bytes // _WORD_BYTES // words).bit_length()), "tokens": tokens}
    folder, shift, tokens = made["folder"], HASH_BITS - made["bits"], made["tokens"]

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, number, raw, offsets, _ in _blocks(batches, most):
            block = Block(raw, offsets, trigrams=False)
            shard = block.words >> shift
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
            sent = [pack([np.diff(block.words[a:z] & ((1 << shift) - 1), prepend=0), block.word_counts[a:z]]) for a, z in zip(cuts[:-1], cuts[1:])]
            totals = pack([np.array([block.lengths.sum()]), np.array([(block.lengths > 0).sum()])])
            yield _record(row, number, [0, *(int(shard[a]) + 1 for a in cuts[:-1])], [totals, *sent])

    def own_words(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        s = int(key[0]) - 1
        held = [unpack(d) for d in group["data"]]
        if s < 0:
            return pd.DataFrame({"row": [-1], "block": [0], "shard": [-1], "data": [pack([np.array([int(sum(x[i][0] for x in held))]) for i in (0, 1)])]})
        asked = [np.cumsum(gaps) for gaps, _ in held]
        path = f"{folder}/words-{s}"
        if build:
            h, times = np.concatenate(asked), np.concatenate([c for _, c in held])
            order, first, _, _ = grouped(h, shift)
            write_file(path, EliasFano.encode(h[order[first]], 1 << shift).parts() + Counts.encode(sums_of(times[order], first)).parts())
        arrays = read_file(path)
        known, counts = (EliasFano(*arrays[:6]), Counts(*arrays[6:])) if arrays else (EliasFano.encode(np.zeros(0, np.int64), 1), Counts.encode(np.zeros(0, np.int64)))
        first, many = planned(counts.access(np.arange(known.n)), tokens)
        out = []
        for x in asked:
            at = known.find(x)
            rank = np.maximum.accumulate(np.maximum(at, 0))  # of those unknown it doesn't matter
            out.append(pack([np.array([s]), np.diff(rank, prepend=0), counts.access(at), *(np.where(at >= 0, np.append(c, 0)[at], 0) for c in (first, many))]))
        back = pd.DataFrame({"row": group["row"], "block": group["block"], "shard": group["shard"], "data": out})
        return pd.concat([back, pd.DataFrame({"row": [-1], "block": [0], "shard": [s], "data": [pack([np.array([known.n]), np.array([int((first + many).max(initial=0))])])]})])

    sent = slim.mapInArrow(send_words, _SENT).repartitionById((1 << made["bits"]) + 1, "shard")
    returned = sent.groupBy("shard").applyInPandas(own_words, _SENT)
    word_path = file_by_partition(returned, "words-back", shared=0, scan=docs)
    if build:
        told = {r["shard"]: [int(x[0]) for x in unpack(bytes(r["data"]))] for r in spark.read.schema(f"{_SENT}, folder long").parquet(word_path).where("folder = -1").collect()}
        n, ends = told.pop(-1, (0, 0))
        base, tries = (np.concatenate([[0], np.cumsum([told.get(s, (0, 0))[i] for s in range(1 << made["bits"])])]).astype(np.int64) for i in (0, 1))
        made |= {"base": base, "tries": tries, "ends": ends, "total": n + ends, "size": int(base[-1]) + 2}
    base, tries, size = made["base"], made["tries"], made["size"]

    def send_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = None
        for row, number, raw, offsets, _ in _blocks(batches, most):
            back = _returned(word_path, row) if back is None else back
            block = Block(raw, offsets)
            numbers, _, first, many = _words_back(back, number, base, tries)
            block.route(numbers, first, many, size)
            shards, data = zip(*m) if (m := list(block.messages(build))) else ((), ())
            yield _record(row, number, list(shards), list(data))
            del block, data, m
        del back
        release()

    def own_trigrams(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/trie-{int(key[0])}"
        if build:
            # messages are held as they came, and unpacked twice
            narrow, parts = np.uint32 if size < 1 << 32 else np.int64, ([], [], [], [])
            for a1, n2, a2, n3, a3, c in map(unpack, group["data"]):
                a1, a2 = np.cumsum(a1).astype(narrow), a2.astype(narrow)
                for held, x in zip(parts, (np.repeat(np.repeat(a1, n2), n3), np.repeat(a2, n3), a3.astype(narrow), c)):
                    held.append(x)
            columns = []
            for held in parts:
                columns.append(np.concatenate(held))
                held.clear()
            write_file(path, Shard.encoded(*Shard.distinct(columns, size), size))
        trie, out = Shard(read_file(path)), []
        for a1, n2, a2, n3, a3, _ in map(unpack, group["data"]) if reply else ():
            out.append(pack(trie.answer(np.cumsum(a1), n2, a2, n3, a3, size)))
        release()
        some = group.iloc[: len(out)]
        return pd.DataFrame({"row": some["row"], "block": some["block"], "shard": some["shard"], "data": pd.Series(out, some.index, object)})

    # a task for each shard, by its number: where a hash puts several into one task, the largest is several times as large
    sent = slim.mapInArrow(send_trigrams, _SENT).repartitionById(max(1, int(tries[-1])), "shard")
    returned = sent.groupBy("shard").applyInPandas(own_trigrams, _SENT)
    return made, word_path, file_by_partition(returned, "trigrams-back", shared=0, scan=docs), most


def _scored(docs: DataFrame, made: dict, word_path: str, trigram_path: str, most: int, others: bool) -> DataFrame:
    base, tries, size, ends, total = (made[k] for k in ("base", "tries", "size", "ends", "total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = trigrams = None
        for row, number, raw, offsets, ids in _blocks(batches, most):
            if words is None:
                words, trigrams = _returned(word_path, row), _returned(trigram_path, row)
            block = Block(raw, offsets)
            numbers, c1, first, many = _words_back(words, number, base, tries)
            block.route(numbers, first, many, size)
            log, unknown = block.scores(c1, [unpack(d) for d in trigrams.pop(number, [])], ends, total, size, others)
            n = block.lengths
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(n), pa.array(unknown), pa.array(log, mask=none), pa.array(np.exp(-log / (n + 1)), mask=none)], ["doc_id", "words", "unknown", "log_probability", "perplexity"]
            )
            del block
        del words, trigrams
        release()

    return docs.mapInArrow(run, "doc_id long, words long, unknown long, log_probability double, perplexity double")


def _slim(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    doc_id = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return with_row_id(stable(docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"))), "row")


def train(docs: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> dict:
    """Count all documents and write the model; the result names its files and is small."""
    return _exchange(_slim(docs, None, text_col), "text", None, False, block_bytes, shard_tokens, shard_words)[0]


def score(docs: DataFrame, made: dict, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, words, unknown, log_probability, perplexity of every document under a model that train() made."""
    slim = _slim(docs, id_col, text_col)
    return _scored(slim.select("row", F.lower("text").alias("t"), "doc_id"), *_exchange(slim, "text", made, True, block_bytes), False)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' scores, each under the model of all the others; see the module's text for edge cases."""
    slim = _slim(docs, id_col, text_col)
    return _scored(slim.select("row", F.lower("text").alias("t"), "doc_id"), *_exchange(slim, "text", None, True, block_bytes, shard_tokens, shard_words), True)
