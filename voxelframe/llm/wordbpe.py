"""Whole texts to token ids with a word-level BPE tokenizer file.

WordEncoder splits a text at white space and remembers the ids of each piece,
which is exact because the tokenizer drops white space and no token spans it.
A new piece that is one word with punctuation around it is put together from
these parts, which the tokenizer encodes apart: they are remembered too, and
new ones go to ``encode_word`` as byte symbols, past the tokenizer's
normalizer and splitter. Other pieces go to ``encode_piece``. Texts outside
Latin-1, or with control characters or what may be a special token, take
``encode_text`` as a whole, and so do all texts for a tokenizer file with
another normalizer or splitter than ``splits_words`` looks for.

``encode_many`` and ``count_many`` take many texts at once: the words of joined
texts are found by array operations on their bytes and looked up in a hash table
of arrays, whose keys are the words' bytes themselves; only new words, and those
of over 16 bytes, become Python objects.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from .common import LOW, chunks, give_back, mix64

#: Slots of the table of short words, as a power of 2; it is emptied once it is half full.
TABLE_BITS = 21
#: Words that the library gets in one call; it keeps some hundred bytes for each until the call ends.
CALL = 1 << 13
#: Entries of a generation of a worker's memory; two are kept, and what is used again moves to the newer.
PIECES, PARTS = 200_000, 100_000
#: One word with ASCII punctuation before and behind (no apostrophe, which may begin a contraction).
_WORD = re.compile(rb"([!-&(-/:-@\[-`{-~]*)([a-z\xe0-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


def _latin_table() -> bytes:
    out = bytearray(range(256))
    for c in range(256):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < 256:
            out[c] = ord(low)
    for c in b"\t\n\x0b\x0c\r\x20\x85\xa0":
        out[c] = 0x20
    return bytes(out)


_LATIN = _latin_table()
_CONTROL = bytes([*range(0x00, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0), 0xAD])
SPACE, LETTER, DIGIT, OTHER = range(4)
_KINDS = np.array([SPACE if c == 0x20 else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(256)], np.uint8)


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Where words, as SPLIT finds them, and runs of white space begin in bytes
    that went through _LATIN and end with three spaces or more."""
    kind = _KINDS[raw]
    cut = kind == DIGIT
    cut[0] = True
    cut[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(raw == 0x27)
    at = at[cut[at]]  # contractions: an apostrophe that begins a word takes these letters, which end it
    x, y = raw[at + 1], raw[at + 2]
    for first, second in ("s", ""), ("t", ""), ("r", "e"), ("v", "e"), ("m", ""), ("l", "l"), ("d", ""):
        found = at[(x == ord(first)) & (y == ord(second) if second else True)]
        cut[found + 1] = False
        cut[found + (3 if second else 2)] = True
    return np.flatnonzero(cut)


def byte_symbols() -> list[str]:
    """The usual printable stand-ins for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


#: Fixed values of the tokenizer file: how it splits words, and what it does before.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BEFORE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def splits_words(path: str) -> bool:
    """Whether the file drops white space, lowers letters and splits words as WordEncoder takes for granted."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if (spec["normalizer"] or {}).get("normalizers") != BEFORE or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return False
    split, level = steps
    special = all(a["content"].startswith("<|") and not (a["lstrip"] or a["rstrip"] or a["normalized"]) for a in spec["added_tokens"])
    return special and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]


class WordEncoder:
    """Memory of pieces over three encoders, and ``encode_words`` for many words. Results are opaque to it; ``joined``
    makes one of several. Without ``words`` every text is encoded as a whole."""

    def __init__(self, encode_word: Callable, encode_piece: Callable, encode_text: Callable, joined: Callable, words: bool = True, encode_words: Callable | None = None) -> None:
        self.words = words
        self.encode_words = encode_words or (lambda many: [encode_word(w) for w in many])
        self.encode_word, self.encode_piece, self.encode_text, self.joined = encode_word, encode_piece, encode_text, joined
        self.symbols = byte_symbols()
        self.known, self.before, self.parts, self.parts_before = {}, {}, {}, {}

    @functools.cached_property
    def table(self) -> WordTable:
        return WordTable(lambda words: self.encode_words([self.spelt(w) for w in words]))

    def _part(self, part: bytes):
        r = self.parts.get(part)
        if r is None:
            r = self.parts_before.get(part)
            if r is None:
                r = self.encode_word(self.spelt(part))
            self.parts[part] = r
        return r

    def _piece(self, piece: bytes):
        r = self.before.get(piece)
        if r is None:
            m = _WORD.fullmatch(piece)
            r = self.joined([self._part(x) for x in m.groups() if x]) if m else self.encode_piece(piece.decode("latin-1"))
        return r

    def __call__(self, text: str) -> list:
        """The results of the pieces of ``text``, in order."""
        if not self.words:
            return [self.encode_text(text)]
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return [self.encode_text(text)]
        if "<|" in text or len(raw.translate(None, _CONTROL)) != len(raw):
            return [self.encode_text(text)]
        if len(self.known) > PIECES:
            self.known, self.before = {}, self.known
        if len(self.parts) > PARTS:
            self.parts, self.parts_before = {}, self.parts
        known, pieces = self.known, raw.translate(_LATIN).split()
        for p in set(pieces).difference(known):
            known[p] = self._piece(p)
        return [known[p] for p in pieces]

    def spelt(self, part: bytes) -> str:
        """The byte symbols of a word."""
        if part.isascii():
            return part.decode()
        return "".join([self.symbols[b] for b in part.decode("latin-1").encode()])



class WordTable:
    """A memory of words of up to 16 bytes: open addressing over two arrays of
    eight bytes of each word, so that equal keys are equal words."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]) -> None:
        self.encode, self.size = encode, 1 << TABLE_BITS
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(self.size, np.uint64) for _ in range(2)]  # 0: an empty slot; no word begins with a byte 0
        self.value = np.zeros(self.size, np.int32)
        self.n, self.flat = np.empty(0, np.int64), np.empty(0, "<u4")  # ids of each value, one after the other
        self.full = False

    def _slots(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the slot of each key or the empty one where its search ends, whether it is there)."""
        slot = (mix64(mix64(x.copy()) ^ y) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        there = self.keys[0][slot]
        hit = (there == x) & (self.keys[1][slot] == y)
        on = np.flatnonzero(~hit & (there != 0))
        while len(on):
            at = slot[on] = (slot[on] + 1) & (self.size - 1)
            there = self.keys[0][at]
            found = (there == x[on]) & (self.keys[1][at] == y[on])
            hit[on[found]] = True
            on = on[~found & (there != 0)]
        return slot, hit

    def _insert(self, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> None:
        """Different keys that aren't there; of those that end at one slot, one goes in and the others look on."""
        while len(x):
            slot, _ = self._slots(x, y)
            _, one = np.unique(slot, return_index=True)
            self.keys[0][slot[one]], self.keys[1][slot[one]], self.value[slot[one]] = x[one], y[one], value[one]
            rest = np.ones(len(x), bool)
            rest[one] = False
            x, y, value = x[rest], y[rest], value[rest]

    def find(self, data: bytes, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value of each word, number of ids of each value, ids of all values).
        ``data`` goes on for 16 bytes after the last word."""
        if self.full:
            self.clear()
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        x, y = eights[starts] & LOW[np.minimum(size, 8)], eights[starts + 8] & LOW[np.clip(size - 8, 0, 8)]
        slot, hit = self._slots(x, y)
        value = self.value[slot].astype(np.int64)
        short = size <= 16
        n, flat, known = self.n, self.flat, len(self.n)
        shorts, longs = np.flatnonzero(~hit & short), np.flatnonzero(~short)
        if not len(shorts) and not len(longs):
            return value, n, flat
        places: dict[bytes, int] = {}
        new = []
        for which in (shorts, longs):
            words = [data[s:e] for s, e in zip(starts[which].tolist(), (starts[which] + size[which]).tolist(), strict=True)]
            value[which] = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words)) + known
            new.append(len(places))
        ids = self.encode(list(places))
        n = np.concatenate([n, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        flat = np.concatenate([flat, np.frombuffer(b"".join(ids), "<u4")])
        kept = known + new[0]
        if kept <= self.size // 2:
            first = np.empty(new[0], np.int64)
            first[value[shorts] - known] = shorts
            self._insert(x[first], y[first], np.arange(known, kept))
            self.n, self.flat = n[:kept], flat[: n[:kept].sum()]
        else:
            self.full = True
        return value, n, flat


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> WordEncoder:
    """Pieces to little-endian 32-bit ids, by the tokenizers library."""
    t = load_tokenizer(path)
    tokenize = t.model.tokenize

    def word_ids(symbols: str) -> bytes:
        return np.array([x.id for x in tokenize(symbols)], "<u4").tobytes()

    def ids(text: str) -> bytes:
        return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    from tokenizers import Tokenizer, pre_tokenizers

    by_space = Tokenizer(t.model)
    by_space.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    suffix, vocab = t.model.end_of_word_suffix, t.get_vocab()
    last = np.zeros(max(vocab.values(), default=0) + 1, bool)
    last[[i for s, i in vocab.items() if suffix and s.endswith(suffix)]] = True

    def words_ids(many: list[str]) -> list[bytes]:
        return [x for at in range(0, len(many), CALL) for x in some_ids(many[at : at + CALL])]

    def some_ids(many: list[str]) -> list[bytes]:
        """In one call, where the suffix of a word's last id tells the words apart."""
        found = np.array(by_space.encode_batch_fast([" ".join(many)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(last[found]) + 1) * 4).tolist()
        if len(ends) != len(many) or ends and ends[-1] != found.nbytes:
            return [word_ids(w) for w in many]
        raw = found.tobytes()
        return [raw[x:y] for x, y in zip([0, *ends], ends)]

    out = WordEncoder(word_ids, ids, ids, b"".join, splits_words(path), words_ids)
    give_back()  # what parsing the file took
    return out


def encode_ids(path: str, text: str) -> bytes:
    return b"".join(library_encoder(path)(text))


def _plain(encoder: WordEncoder, texts: list[str]) -> tuple[list[bytes], list[int]]:
    """Latin-1 of the texts whose words ``word_starts`` finds, empty for the
    others, and where these are."""
    raws, others = [], []
    for k, t in enumerate(texts):
        try:
            raw = t.encode("latin-1") if encoder.words else b""
        except UnicodeEncodeError:
            raw = b""
        if t and (not raw or "<|" in t or len(raw.translate(None, _CONTROL)) != len(raw)):
            others.append(k)
            raw = b""
        raws.append(raw)
    return raws, others


def _looked_up(encoder: WordEncoder, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value of each word, number of ids of each value, ids of all values, ends of the texts in words)."""
    data = b" ".join(raws).translate(_LATIN) + b" " * 16
    raw = np.frombuffer(data, np.uint8)
    cut = word_starts(raw)
    words = raw[cut] != 0x20
    size = np.diff(cut, append=len(data))[words]
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1) - 1
    starts = cut[words]
    return *encoder.table.find(data, starts, size), np.searchsorted(starts, ends)


def encode_many(path: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text, as ``encode_ids`` gives them; of null, none."""
    encoder = library_encoder(path)
    for chunk in chunks(texts):
        raws, others = _plain(encoder, chunk)
        value, n, flat, ends = _looked_up(encoder, raws)
        first = (np.cumsum(n) - n)[value]
        n = n[value]
        total = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(first - total[:-1], n) + np.arange(total[-1])]
        out = np.split(ids, total[ends])[:-1]
        for k in others:
            out[k] = np.frombuffer(b"".join(encoder(chunk[k])), "<u4")
        yield from out


def count_many(path: str, texts: list[str | None]) -> np.ndarray:
    """The number of ids of each text; of null, 0."""
    encoder, out = library_encoder(path), [np.empty(0, np.int64)]
    for chunk in chunks(texts):
        raws, others = _plain(encoder, chunk)
        value, n, _, ends = _looked_up(encoder, raws)
        count = np.diff(np.append(0, np.cumsum(n[value]))[ends], prepend=0)
        for k in others:
            count[k] = len(b"".join(encoder(chunk[k]))) // 4
        out.append(count)
    return np.concatenate(out)
