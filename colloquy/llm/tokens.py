"""Token ids of public tokenizers, computed once for each distinct pre-token that a worker meets.

Texts are cut into pre-tokens on whole arrays of characters, by the rules that the tokenizer files state; each pre-token
is looked up by hash in a table that a worker keeps from task to task, and only those not in it go to the model of the
tokenizers library.  Two kinds of file are known: byte-level BPE whose pre-tokens take a leading space along
(``spaced``), and BPE over composed, lower-cased text without white space.

Texts of any length and any number of distinct pre-tokens take bounded room beyond their own bytes: a long text is worked
through in parts that begin where a word follows a space, which no pre-token crosses, and pre-tokens are looked up ``GROUP``
at a time, so that the table is never more than half full.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

import numpy as np

from .bytewords import LOWER, flat, slices, span_hashes

#: Pre-tokens that a worker keeps (about 40 bytes each), in so many slots; the table starts afresh beyond it.
KEPT = 1_000_000
SLOTS = 1 << 21
#: Pre-tokens that are looked up at once, at most KEPT, and bytes of text that are cut into pre-tokens at once, about.
GROUP, PART = 1 << 18, 4 << 20
#: Bytes of a pre-token that is kept; longer ones go to the model each time.
LONG = 256
#: What may follow an apostrophe to make a pre-token with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = range(4)
#: ASCII letters; letters and digits.
LETTER_BYTE, WORD_BYTE = np.zeros(256, bool), np.zeros(256, bool)
LETTER_BYTE[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@cache
def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return str.maketrans({chr(b): chr(b) for b in plain} | {chr(b): chr(256 + i) for i, b in enumerate(others)})


@cache
def classes(limit: int) -> np.ndarray:
    """The class of each character below ``limit``: white space, letter, number or other."""
    kinds = np.full(limit, OTHER, np.uint8)
    for i in range(limit):
        c = chr(i)
        if c.isspace() and not 0x1C <= i <= 0x1F:
            kinds[i] = SPACE
        elif c.isalpha():
            kinds[i] = LETTER
        elif unicodedata.category(c)[0] == "N":
            kinds[i] = NUMBER
    return kinds


def fold(text: str) -> str:
    """Composed and lower-cased, each character by itself."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def starts(chars: np.ndarray, kinds: np.ndarray, first: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pre-tokens (and, if not ``spaced``, runs of white space) begin; ``first`` marks the first character of each row."""
    n = len(chars)
    blank = kinds == SPACE
    begin = first.copy()
    begin[1:] |= kinds[1:] != kinds[:-1]
    if spaced:
        inner = ~first[1:]
        # The last white space before a word stands apart from those before it, and a space goes with the word.
        begin[:-1] |= blank[:-1] & ~blank[1:] & inner
        begin[1:] &= ~(inner & (chars[:-1] == 0x20) & ~blank[1:])
    else:
        begin |= kinds == NUMBER
    marks = np.flatnonzero(begin & (chars == 0x27))
    rows = np.append(first, True)
    for tail in CONTRACTIONS:
        size = len(tail)
        here = marks[marks + size < n]
        for k, c in enumerate(tail):
            here = here[(chars[here + 1 + k] == ord(c)) & ~rows[here + 1 + k]]
        begin[here + 1] = False
        after = here + 1 + size
        after = after[after < n]
        begin[after[~blank[after]]] = True
        marks = np.setdiff1d(marks, here, assume_unique=True)
    return begin


def word_starts(data: np.ndarray, step: int) -> list[int]:
    """Places, ``step`` bytes apart or more, of a space between a letter or digit and a letter: pre-tokens begin there."""
    cuts, at = [], step
    while at < len(data) - 1:
        some = data[at - 1 : at + (1 << 16) + 1]
        here = np.flatnonzero((some[1:-1] == 0x20) & WORD_BYTE[some[:-2]] & LETTER_BYTE[some[2:]])
        if len(here):
            cuts.append(at + int(here[0]))
            at = cuts[-1] + step
        else:
            at += 1 << 16
    return cuts


class Encoder:
    """Encodes text columns with one tokenizer file; ``spaced`` where a space before a word is part of its tokens.

    With ``added``, the file's added tokens are single ids wherever a text holds them, as by the library's default, else
    their characters are encoded like any others.
    """

    def __init__(self, path: str, spaced: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.spaced = spaced
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        known = self.tokenizer.get_added_tokens_decoder() if added else {}
        if odd := [t.content for t in known.values() if t.normalized or t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"added tokens that aren't matched as they are: {odd}")
        self.added = {t.content.encode(): i for i, t in known.items()}
        self.marks = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if known else None
        self.alphabet = byte_alphabet()
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.count = self.used = 0
        self.at, self.size, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16)

    def pretoken(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.alphabet))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows (as uint16; the vocabularies are below 65,536) and each row's number of ids."""
        # A match that crosses a row's end may hide one that begins in the next row, so rows are searched by themselves.
        raw = data.tobytes() if self.marks else b""
        if not self.marks or not self.marks.search(raw):
            return self.encode_plain(data, offsets)
        found = [(i, a + m.start(), a + m.end(), self.added[m[0]]) for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)) for m in self.marks.finditer(raw[a:b])]
        if not found:
            return self.encode_plain(data, offsets)
        row, start, end, added = (np.array(x, np.int64) for x in zip(*found, strict=True))
        # Texts between added tokens are rows of their own, and so are the added tokens, which lose their bytes.
        bounds = np.sort(np.concatenate([offsets, start, end]), kind="stable")
        token = np.searchsorted(bounds, start, "right") - 1
        sizes = np.diff(bounds)
        keep = np.ones(len(sizes), bool)
        keep[token] = False
        ids, counts = self.encode_plain(data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(np.where(keep, sizes, 0))]))
        place = np.cumsum(counts)[token]
        # A piece without bytes has no ids, so its row doesn't matter.
        owner = np.searchsorted(offsets, bounds[:-1], "right") - 1
        used = counts > 0
        totals = np.bincount(owner[used], counts[used], len(offsets) - 1).astype(np.int64) + np.bincount(row, minlength=len(offsets) - 1)
        return np.insert(ids, place, added.astype(np.uint16)), totals

    def encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with no regard to added tokens."""
        if len(data) <= 2 * PART:
            return self.encode_part(data, offsets)
        cuts = word_starts(data, PART)
        out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
            first, last = min(first, len(sizes) - 1), max(last, first + 1)
            ids, some = self.encode_part(data[a:b], np.clip(offsets[first : last + 1], a, b) - a)
            out.append(ids)
            sizes[first:last] += some
        return np.concatenate(out), sizes

    def encode_part(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        wide = bool((data >= 0x80).any())
        if not self.spaced:
            if wide:
                raw = data.tobytes()
                folded = [fold(raw[a:b].decode(errors="replace")).encode() for a, b in zip(offsets, offsets[1:], strict=False)]
                data, offsets = np.frombuffer(b"".join(folded), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in folded])])
            else:
                data = LOWER[data]
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(rows, np.int64)
        if wide:
            head = (data & 0xC0) != 0x80
            where = np.flatnonzero(head)
            chars = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
            kinds = classes(0x110000)[chars]
        else:
            where, chars, kinds = None, data, classes(0x80)[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        first = first[:-1] if where is None else first[where]
        begin = np.flatnonzero(starts(chars, kinds, first, self.spaced))
        blank = kinds[begin] == SPACE
        if where is not None:
            begin = where[begin]
        end = np.append(begin[1:], len(data))
        if not self.spaced:
            begin, end = begin[~blank], end[~blank]
        row = np.searchsorted(offsets, begin, "right") - 1
        out, sizes = [], np.zeros(len(begin), np.int64)
        for at in range(0, len(begin), GROUP):
            ids, sizes[at : at + GROUP] = self.look_up(data, begin[at : at + GROUP], end[at : at + GROUP])
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint16), np.bincount(row, sizes, rows).astype(np.int64)

    def look_up(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of at most GROUP pre-tokens, and how many each has."""
        place, own = self.places(data, begin, end)
        sizes = self.size[place].astype(np.int64)
        for i, ids in own.items():
            sizes[i] = len(ids)
        to = np.cumsum(sizes)
        source = self.at[place] - (to - sizes)
        if not own:
            return self.ids[np.repeat(source, sizes) + np.arange(int(sizes.sum()))], sizes
        out = np.zeros(int(sizes.sum()), np.uint16)
        kept = np.ones(len(begin), bool)
        kept[list(own)] = False
        at = np.flatnonzero(np.repeat(kept, sizes))
        out[at] = self.ids[np.repeat(source[kept], sizes[kept]) + at]
        for i, ids in own.items():
            out[to[i] - sizes[i] : to[i]] = ids
        return out, sizes

    def places(self, data, begin, end) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Each pre-token's place in the table, and the ids of those that are too long for it."""
        hashes = span_hashes(data, begin, end)
        hashes[hashes == 0] = 1
        long = np.flatnonzero(end - begin > LONG)
        hashes[long] = 1  # not in the table, and not to be
        place = self.find(hashes)
        place[long] = 0
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = missing[np.unique(hashes[missing], return_index=True)[1]]
            if self.count + len(new) > KEPT:
                self.reset()
                new = np.unique(hashes, return_index=True)[1]
                new = new[end[new] - begin[new] <= LONG]
            self.learn(hashes[new], [self.pretoken(data[a:b].tobytes()) for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            place = self.find(hashes)
            place[long] = 0
        return place, {int(i): self.pretoken(data[begin[i] : end[i]].tobytes()) for i in long}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the table by open addressing, -1 where a hash isn't in it."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == hashes, self.slots[slot], -1)
        left = np.flatnonzero((there != hashes) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            there = self.keys[slot[left]]
            hit = there == hashes[left]
            out[left[hit]] = self.slots[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def learn(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in ids], np.int32)
        more = np.array([t for x in ids for t in x], np.uint16)
        n = self.count + len(hashes)
        while len(self.at) < n:
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        while len(self.ids) < self.used + len(more):
            self.ids = np.concatenate([self.ids, self.ids])
        self.at[self.count : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : n] = sizes
        self.ids[self.used : self.used + len(more)] = more
        slot, left = (hashes & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]] = hashes[won]
            self.slots[slot[won]] = self.count + won
            left = np.setdiff1d(left, won, assume_unique=True)
            taken = left[self.keys[slot[left]] != hashes[left]]
            slot[taken] = (slot[taken] + 1) & (SLOTS - 1)
        self.count, self.used = n, self.used + len(more)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for a file, with its added tokens; kept from task to task."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced, added=True)
    return _encoders[path, spaced]


def encoded(batches, path: str, spaced: bool, end: int):
    """For each slice of the batches: the slice, its rows' ids with the end id appended, and the len + 1 offsets of rows."""
    tool = encoder(path, spaced)
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = flat(part.column("text"))
            ids, sizes = tool.encode(data, at)
            ends = np.concatenate([[0], np.cumsum(sizes + 1)])
            out = np.full(ends[-1], end, np.uint16)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
            yield part, out, ends


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
