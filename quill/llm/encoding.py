"""Fast exact token ids: texts are cut where the tokenizer always cuts, pieces are cached.

Both public vocabularies used here split a text before merging anything, and
those cuts depend only on where white space stands. A text is therefore
encoded as the concatenation of its pieces, and pieces repeat a great deal.
All pieces of a batch of texts are hashed at once from the column's bytes; only
different ones are looked up, and ids are gathered by their places. The ids of
pieces are cached by hash, up to a fixed number of entries, so memory is
bounded whatever the corpus holds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from .common import kept
from .wordhash import BYTE_VALUE, place_hashes, runs, text_bytes, word_places

# Characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"

#: Pieces kept at most, and bytes a kept piece has at most. The frequent
#: pieces are met first, so a full cache is simply left as it is.
CACHE_ENTRIES = 2_000_000
CACHE_BYTES = 64
#: Bytes of text looked at together, one text at least.
BATCH_BYTES = 4_000_000

_PIECES = {
    # White space only separates.
    "word": re.compile(f"[^{SPACE}]+").findall,
    # One blank goes with the word behind it; other white space stands alone.
    "byte": re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall,
}
#: White space beyond ASCII, as bytes.
_ODD_BYTES = tuple(c.encode() for c in map(chr, range(0x80, 0x3001)) if re.fullmatch(f"[{SPACE}]", c))
_ODD_LEADS = np.array(sorted({b[0] for b in _ODD_BYTES}), np.uint8)

#: Kinds of bytes for the split rules: 0 white space, then these.
_LETTER, _DIGIT, _SIGN, _STRANGE = 1, 2, 3, 4
_KIND = np.full(256, _STRANGE, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _STRANGE
#: Second bytes of the Latin-1 letters whose first is 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet, by rule: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: Byte 0, which no plain piece has, stands between split pieces.
_END = _LETTERS[0]
_MAPPED = _LETTERS | {0x0A: " ", 0x00: f" {_END} "}


class _Known:
    """Ids of pieces by the pieces' hashes, in sorted arrays."""

    def __init__(self, dtype: np.dtype):
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of keys, whether they are there)"""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), bool)
        at = np.minimum(at, len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.starts = np.insert(self.starts, at, starts[order] + len(self.pool))
        self.sizes = np.insert(self.sizes, at, sizes[order])
        self.pool = np.concatenate([self.pool, pool])


class Encoder:
    """ids of whole texts, equal to the tokenizer's own encoding of each text."""

    def __init__(self, path: str, cut: str, width: int = 4):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.cut = cut
        self.dtype = np.dtype(f"<u{width}")
        if self.tokenizer.get_vocab_size() > 256**width:
            raise ValueError(f"ids of {path} do not fit {width} bytes")
        # The merges alone, for pieces that are split already.
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.end,) = self.merges.encode(_END, add_special_tokens=False).ids
        self.known = _Known(self.dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes object of ids per text."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one behind the other; where each text's start, and all end)."""
        parts, counts = [], [np.zeros(1, np.int64)]
        for first, end in runs(column, BATCH_BYTES):
            ids, n = self._encode_run(column.slice(first, end - first))
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype), np.cumsum(np.concatenate(counts))

    def _encode_run(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = text_bytes(column)
        odd = _odd_texts(raw, ends) if self.cut == "byte" else np.zeros(0, np.int64)
        words = word_places(raw, ends)
        first, last = _split_words(raw, *words, digits_alone=self.cut == "word")
        if self.cut == "byte":
            first, last = _with_gaps(raw, ends, words, first, last)
        hashes = place_hashes(raw, first, last, BYTE_VALUE)
        coded = pa.array(hashes ^ (last - first).astype(np.uint64)).dictionary_encode()
        codes, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at, there = self.known.find(keys)
        starts, sizes, pool = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), self.known.pool
        starts[there], sizes[there] = self.known.starts[at[there]], self.known.sizes[at[there]]
        if not there.all():
            where = np.empty(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = np.flatnonzero(~there)
            fresh, fresh_starts, fresh_sizes = self._encode_pieces(raw, first[where[new]], last[where[new]])
            starts[new], sizes[new] = fresh_starts + len(pool), fresh_sizes
            pool = np.concatenate([pool, fresh])
            if len(self.known.keys) < CACHE_ENTRIES:
                short = (last - first)[where[new]] <= CACHE_BYTES
                self.known.add(keys[new][short], fresh_starts[short], fresh_sizes[short], fresh)
        lengths = sizes[codes]
        stops = np.cumsum(lengths)
        ids = pool[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts[codes] - stops + lengths, lengths)]
        bounds = np.concatenate([[0], stops])[np.searchsorted(first, ends)]
        if not len(odd):
            return ids, np.diff(bounds)
        # Texts with white space beyond ASCII are cut by the vocabulary's own rule.
        texts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in odd.tolist():
            found = self.tokenizer.encode_batch_fast(_PIECES[self.cut](column[i].as_py()), add_special_tokens=False)
            texts[i] = np.array([x for e in found for x in e.ids], self.dtype)
        return np.concatenate(texts), np.array(list(map(len, texts)), np.int64)

    def _encode_pieces(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the different pieces, where each piece's start, how many it has)."""
        # A piece that is split already starts with a letter, digit or sign, or a blank and then one, and holds nothing strange.
        kind = _kinds(raw)
        strange = np.concatenate([[0], np.cumsum(kind == _STRANGE)])
        plain = (strange[last] == strange[first]) & (kind[last - 1] != 0)
        starts, sizes = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        parts = [np.zeros(0, self.dtype)]
        some = np.flatnonzero(plain)
        if len(some):
            ids, sizes[some] = self._merged(raw, first[some], last[some])
            parts.append(ids)
        other = np.flatnonzero(~plain)
        if len(other):
            pieces = [raw[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(first[other].tolist(), last[other].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes[other] = list(map(len, found))
            parts.append(np.array([x for ids in found for x in ids], self.dtype))
        order = np.concatenate([some, other])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(parts), starts, sizes

    def _merged(self, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces none of which the vocabulary splits further, and how many each has."""
        lengths = last - first + 1  # a byte 0 behind each
        ends = np.cumsum(lengths)
        line = raw[np.minimum(np.arange(ends[-1]) + np.repeat(first - ends + lengths, lengths), len(raw) - 1)].copy()
        line[ends - 1] = 0
        if self.cut == "word":
            # Lower case: A-Z, and the capitals of Latin-1.
            line[(line >= 0x41) & (line <= 0x5A)] += 0x20
            second = np.flatnonzero(line[:-1] == 0xC3) + 1
            line[second[line[second] <= 0x9E]] += 0x20
        text = line[:-1].tobytes().decode("latin-1").translate(_MAPPED)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        marks = ids == self.end
        if marks.sum() != len(first) - 1:
            raise AssertionError("a piece holds the end mark")
        return ids[~marks].astype(self.dtype), np.diff(np.concatenate([[-1], np.flatnonzero(marks), [len(ids)]])) - 1


def _odd_texts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The texts that hold white space beyond ASCII."""
    lead = np.flatnonzero(raw >= 0xC2)
    lead = lead[np.isin(raw[lead], _ODD_LEADS)]
    found = [p for p in lead.tolist() if raw[p : p + 3].tobytes().startswith(_ODD_BYTES)]
    return np.unique(np.searchsorted(ends, found, "right") - 1) if found else np.zeros(0, np.int64)


def _kinds(raw: np.ndarray) -> np.ndarray:
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[_LATIN[raw[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _split_words(raw: np.ndarray, first: np.ndarray, last: np.ndarray, digits_alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """The parts of words where the split rules part ASCII and Latin-1; words with anything else, or an apostrophe, whole."""
    kind = _kinds(raw)
    strange = np.concatenate([[0], np.cumsum(kind == _STRANGE)])
    whole = np.flatnonzero(strange[last] > strange[first])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[first[whole]] += 1
    inside[last[whole]] -= 1
    starts = np.zeros(len(raw) + 1, bool)
    starts[1:-1] = kind[1:] != kind[:-1]
    if digits_alone:
        starts[:-1] |= kind == _DIGIT
    starts[:-1] &= (np.cumsum(inside[:-1]) == 0) & (kind != 0)
    starts[first] = True
    parts = np.flatnonzero(starts)
    # A part ends where its word does or the next one starts.
    starts[last] = True
    stops = np.flatnonzero(starts)
    return parts, stops[np.searchsorted(stops, parts, "right")]


def _with_gaps(raw: np.ndarray, ends: np.ndarray, words: tuple[np.ndarray, np.ndarray], parts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the byte-level rule: a word's first part takes the blank before it; of other white space the last stands alone, and what is before it."""
    first, last = words
    text = np.searchsorted(ends, first, "right") - 1
    before = np.concatenate([[0], last[:-1]]) if len(last) else last
    before = np.maximum(before, ends[text])  # where the gap before each word starts
    blank = (first > before) & (raw[np.maximum(first - 1, 0)] == 0x20)
    long = first - before > 1
    alone = (first > before) & ~blank
    # White space behind a text's last word, or all of a text.
    of_text = np.searchsorted(first, ends)
    some = of_text[1:] > of_text[:-1]
    tail = ends[:-1].copy()
    tail[some] = last[of_text[1:][some] - 1]
    rest = tail < ends[1:]
    parts = parts.copy()
    parts[np.searchsorted(parts, first)] -= blank
    gap_starts = np.concatenate([before[long], first[alone] - 1, tail[rest]])
    gap_stops = np.concatenate([first[long] - 1, first[alone], ends[1:][rest]])
    if not len(gap_starts):
        return parts, stops
    order = np.argsort(gap_starts)
    at = np.searchsorted(parts, gap_starts[order])
    return np.insert(parts, at, gap_starts[order]), np.insert(stops, at, gap_stops[order])


_KNOWN: dict[tuple, Encoder] = kept("encoding")


def encoder(path: str, cut: str, width: int = 4) -> Encoder:
    """One encoder per Python worker and vocabulary; a worker serves many tasks, and drops it for those of another operator."""
    key = (path, cut, width)
    if key not in _KNOWN:
        _KNOWN[key] = Encoder(path, cut, width)
    return _KNOWN[key]
