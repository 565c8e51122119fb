"""Token ids of whole texts through bounded worker caches.

A tokenizer that drops white space gives a text the ids of its words one after the other; a byte-level one gives it the ids of its
pieces if the cuts are at places where no pre-token can span. Both are probed on the tokenizer itself; for any other tokenizer, and
for texts with the tokenizer's special strings, the library encodes the whole text. Either way the ids are those of the library.
"""

from __future__ import annotations

import importlib
import os

import numpy as np
import pyarrow as pa

from .common import SPACE, Texts

#: Words a worker keeps before it starts anew; frequent ones are soon back. An entry takes some forty bytes.
CACHE_WORDS, CACHE_IDS = 1 << 19, 1 << 23
#: Pieces kept by one worker: two generations, the older one is dropped when the newer one is full.
CACHE_PIECES = 400_000
_JOINED = 256
_LOADED: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file: ``MILLRACE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("MILLRACE_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def load(path: str) -> "Encoder":
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class WordTable:
    """Ids of words in one arena, found by the words' hashes in an open-addressed table. Two words of a table share a hash with a chance of
    about the square of their number times 2**-65."""

    def __init__(self, bits: int = 12):
        self.bits, self.n, self.used = bits, 0, 0
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.names, self.begins, self.sizes, self.arena = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of the given hashes, -1 for those the table does not hold."""
        out = np.full(len(hashes), -1, np.int32)
        rows, mask = np.arange(len(hashes)), (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rows):
            slot = self.slots[at]
            taken = slot >= 0
            hit = taken & (self.keys[at] == hashes[rows])
            out[rows[hit]] = slot[hit]
            more = taken & ~hit
            rows, at = rows[more], (at[more] + 1) & mask
        return out

    def _place(self, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (self.names[entries] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slots[at[put]], self.keys[at[put]] = entries[put], self.names[entries[put]]
            left = np.ones(len(entries), bool)
            left[put] = False
            entries, at = entries[left], (at[left] + 1) & mask

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.zeros(max(size, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New words, each once, with the number of their ids and the ids in a row."""
        n, used = self.n + len(hashes), self.used + len(ids)
        self.names, self.begins, self.sizes = self._room(self.names, n), self._room(self.begins, n), self._room(self.sizes, n)
        self.arena = self._room(self.arena, used)
        self.names[self.n : n], self.sizes[self.n : n], self.arena[self.used : used] = hashes, sizes, ids
        self.begins[self.n : n] = self.used + np.cumsum(sizes) - sizes
        fresh = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        if 2 * n > 1 << self.bits:
            self.bits = (2 * n).bit_length()
            self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            fresh = np.arange(n, dtype=np.int32)
        self._place(fresh)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of entries, and where each entry's ids start among them."""
        sizes = self.sizes[entries].astype(np.int64)
        starts = np.zeros(len(entries) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        return self.arena[np.repeat(self.begins[entries] - starts[:-1], sizes) + np.arange(starts[-1])], starts


class Encoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit = max(1, cache_pieces // 2)
        self.table, self.most = WordTable(), cache_words
        self.by_words = self._same("a b's. C\n d1", ["a", "b's.", "C", "d1"])
        self.by_pieces = not self.by_words and self._same("a b's. C\nd1", ["a", " b's.", " C", "\n", "d1"])
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.lower = self.by_words and all(self._ids(c) == self._ids(c.lower()) for c in letters)
        bar, feed = self._ids("|"), self._ids("\n")
        self.bar = bar[0] if len(bar) == 1 else None
        self.feed = feed[0] if len(feed) == 1 else None
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        #: Ids that end a pre-token; none if the tokenizer does not mark them.
        self.closes = np.array([n.endswith("</w>") for n in names])

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _same(self, text: str, parts: list[str]) -> bool:
        return self._ids(text) == [i for p in parts for i in self._ids(p)]

    def whole(self, text: bytes) -> bytes:
        """The library's ids of a text as little-endian unsigned 32-bit integers."""
        return np.array(self._ids(text.decode("utf-8", "replace")), "<u4").tobytes()

    def count(self, text: bytes) -> int:
        return len(self._ids(text.decode("utf-8", "replace")))

    def has_special(self, text: bytes) -> bool:
        return any(s in text for s in self.special)

    @staticmethod
    def _apart(piece: bytes) -> bool:
        """Whether a line feed before and after a piece leaves its pre-tokens alone."""
        text = piece.decode("utf-8", "replace")
        return not text[-1:].isspace() and not (text[:1].isspace() and (text[0] != " " or text[1:2].isspace()))

    def _encode(self, items: list[bytes], separator: bytes, sep_id: int | None) -> None:
        """Put the ids of new words into the cache. Plain ones are encoded many at a time around a separator of one known id."""
        plain, rest = [], items
        if sep_id is not None:
            mark = separator.strip(b" ")
            alone = self._apart if self.by_pieces else (lambda w: True)
            plain = [w for w in items if mark not in w and alone(w)]
            taken = set(plain)
            rest = [w for w in items if w not in taken]
        for at in range(0, len(plain), _JOINED):
            group = plain[at : at + _JOINED]
            text = separator.join(group).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == sep_id)
            if len(cuts) != len(group) - 1:
                rest = rest + group
                continue
            raw = ids.tobytes()
            ends = [*(cuts * 4).tolist(), len(raw)]
            begin = 0
            for w, end in zip(group, ends):
                self.new[w] = raw[begin:end]
                begin = end + 4
        for at in range(0, len(rest), _JOINED):
            group = rest[at : at + _JOINED]
            for w, e in zip(group, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in group], add_special_tokens=False)):
                self.new[w] = np.array(e.ids, "<u4").tobytes()

    def fill(self, pieces: set[bytes], separator: bytes, sep_id: int | None) -> dict[bytes, bytes]:
        """A mapping that holds the ids of all given pieces."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        missing = pieces.difference(self.new)
        kept = missing.intersection(self.old)
        self.new.update((w, self.old[w]) for w in kept)
        self._encode(list(missing - kept), separator, sep_id)
        return self.new

    def _joined_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Sizes and ids of words of letters: each is one pre-token, so its last id is the one that closes it."""
        sizes, parts = [], []
        for at in range(0, len(words), _JOINED):
            group = words[at : at + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(group).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                return None
            sizes.append(np.diff(ends, prepend=0))
            parts.append(ids)
        return np.concatenate(sizes), np.concatenate(parts)

    def _learn(self, hashes: np.ndarray, words: list[bytes], letters: np.ndarray) -> None:
        """Put new words into the table; ``letters`` marks those of letters alone."""
        easy, hard = np.flatnonzero(letters), np.flatnonzero(~letters)
        found = self._joined_letters([words[i] for i in easy.tolist()]) if len(easy) and self.closes.any() else None
        if found is None:
            hard = np.arange(len(words))
        else:
            self.table.add(hashes[easy], *found)
        if len(hard):
            names = [words[i] for i in hard.tolist()]
            self.new = {}
            self._encode(names, b" | ", self.bar)
            raw = [self.new[w] for w in names]
            self.new = {}
            self.table.add(hashes[hard], np.array([len(r) // 4 for r in raw]), np.frombuffer(b"".join(raw), "<u4"))

    def _word_ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts by their words, and where each text's ids start."""
        starts, ends, first = _marks_apart(texts, *texts.words())
        if self.table.n > self.most or self.table.used > CACHE_IDS:
            self.table = WordTable()
        hashes = texts.hashes(starts, ends)
        entry = self.table.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            at = missing[where]
            raw = texts.data.tobytes()
            self._learn(new, [raw[b:e] for b, e in zip(starts[at].tolist(), ends[at].tolist())], _letters_only(texts, starts[at], ends[at]))
            entry[missing] = self.table.find(hashes[missing])
        ids, begins = self.table.gather(entry)
        return ids, begins[first]

    def ids(self, text: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.ids_of(Texts(pa.array([text], pa.binary())))[0]

    def ids_of(self, texts: Texts) -> list[bytes]:
        """Ids of every text of a batch."""
        if not self.by_words:
            return [self.whole(texts.text(i)) for i in range(texts.n)]
        ids, at = self._word_ids(texts.lowered() if self.lower else texts)
        raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
        out = [raw[b:e] for b, e in zip(at, at[1:])]
        if self.has_special(texts.data.tobytes()):
            for i in range(texts.n):
                if self.has_special(texts.text(i)):
                    out[i] = self.whole(texts.text(i))
        return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
#: Bytes of ASCII letters and of the two-byte letters from U+00C0 to U+024F.
_LETTER_BYTE = _LETTER.copy()
_LETTER_BYTE[0x80:0xC0] = _LETTER_BYTE[0xC3:0xCA] = True


def _marks_apart(texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a closing mark after an ASCII letter cut in two: such a mark is a pre-token of its own."""
    cut = np.zeros(len(starts), bool)
    several = ends - starts > 1
    cut[several] = _MARK[texts.data[ends[several] - 1]] & _LETTER[texts.data[ends[several] - 2]]
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(cut, out=before[1:])
    at = np.arange(len(starts)) + before[:-1]
    begin, end = np.empty(len(starts) + before[-1], np.int64), np.empty(len(starts) + before[-1], np.int64)
    begin[at], end[at] = starts, ends - cut
    begin[at[cut] + 1], end[at[cut] + 1] = ends[cut] - 1, ends[cut]
    return begin, end, first + before[first]


def _letters_only(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of letters up to U+024F; two signs among them and the dotted capital i, whose small form is two characters, do not count."""
    data = texts.data
    odd = ~_LETTER_BYTE[data]
    if len(data) > 1:
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        odd[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(odd, out=sums[1:])
    return sums[ends] == sums[starts]


#: Lead bytes of two-byte letters, none of which is white space.
_LETTER_LEAD = np.zeros(256, bool)
_LETTER_LEAD[0xC3:0xCA] = True
_SAFE = np.zeros(256, bool)
_SAFE[0x20:0x80] = True
_SAFE &= ~SPACE


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts where no byte-level pre-token spans: before and after a run of white space, whose last space joins what follows.

    Starts, ends, and ``first`` with the pieces of text ``i`` at ``first[i]:first[i + 1]``.
    """
    data = texts.data
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[texts.offsets] = True
    at = np.flatnonzero(SPACE[data])
    if len(at):
        before = np.zeros(len(at), bool)  # a byte that surely ends a character other than white space
        inner = at > 0
        b = data[at[inner] - 1]
        two = data[np.maximum(at[inner] - 2, 0)]
        before[inner] = _SAFE[b] | ((b >= 0x80) & (b < 0xC0) & _LETTER_LEAD[two])
        after = np.zeros(len(at), bool)
        inner = at < n - 1
        a = data[at[inner] + 1]
        after[inner] = _SAFE[a] | _LETTER_LEAD[a]
        after &= ~cut[at + 1]  # so far, cuts are the texts' edges
        before &= ~cut[at]
        cut[at[before | after]] = True
        cut[at[after & (data[at] != 32)] + 1] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    if n == 0:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, texts.offsets)
