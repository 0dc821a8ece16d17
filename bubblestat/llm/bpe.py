"""Whole texts to token ids with the tokenizers library, a word at a time."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words whose ids one worker process keeps, twice: beyond, those that are used again move on and the others are dropped.
KEPT = 400_000
#: Text bytes handled at a time.
SLICE = 4 << 20
#: Normalizer and pre-tokenizer of the tokenizer files whose texts can be cut at spaces, as the files state them, and the patterns of their pieces.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KINDS = {
    "spaced": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    "lower": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        _WORDS,
    ),
}


class Encoder:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False) of the library.

    A text falls apart before each U+0020. That changes no ids if what precedes it is not white space: a token never
    holds something and then a space. Texts where white space precedes a space are encoded as they are, unless
    the tokenizer drops white space; so are texts that hold the string of an added token, and all texts of a tokenizer that is
    none of KINDS. Words lose their signs, digits and line ends where bytes alone tell that the tokenizer cuts there. What is distinct
    is encoded many in one call, and kept while it is used.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        added = told.get("added_tokens") or []
        kind = next((k for k, (n, p, _) in KINDS.items() if told.get("normalizer") == n and told.get("pre_tokenizer") == p), None)
        self.kind = kind if told["model"].get("type") == "BPE" and not told["model"].get("dropout") and not any(t["normalized"] for t in added) else None
        self.drops_space = self.kind == "lower"
        self.added = "|".join(_escaped(t["content"]) for t in added)
        vocab = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)  # ids that start with a space
        for w, i in vocab.items():
            self.starts[i] = w.startswith("Ġ")
        self.cut = regex.compile(KINDS[self.kind][2]).findall if self.kind else None
        self.digit = ids[0] if len(ids := self.tokenizer.encode("0", add_special_tokens=False).ids) == 1 else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One a worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, texts: list[str]) -> list[bytes]:
        """Ids of words, with the space that precedes them unless the tokenizer drops it. Other words than runs of letters are cut into the tokenizer's own pieces, and each piece is encoded once."""
        used = {x: self.older[x] for x in texts if x in self.older}
        if len(self.known) > KEPT:
            self.older, self.known = self.known, used
        else:
            self.known.update(used)
        known, older = self.known, self.older
        texts_new = [x for x in texts if x not in known]
        bare = texts_new if self.drops_space else [x.removeprefix(" ") for x in texts_new]
        letters = [w.isalpha() for w in bare]
        mixed = [x for x, is_plain in zip(texts_new, letters, strict=True) if not is_plain]
        if self.drops_space:  # A-Z is lower-cased before; of other letters the library sees to it
            cuts = [self.cut(x) if x.isascii() else [x] for x in mixed]
        else:
            cuts = [self.cut(x) for x in mixed]
        pieces = set(chain.from_iterable(cuts))
        known.update((x, older[x]) for x in pieces if x in older)
        new = list(pieces.union(compress(texts_new, letters)).difference(known))
        self._encode([x for x in new if (x.isalpha() if self.drops_space else x[0] == " " and len(x) > 1 and not x.isspace())])
        rest = [x for x in new if x not in known]
        known.update(zip(rest, self.whole(rest), strict=True))
        get = known.__getitem__
        known.update(zip(mixed, [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cuts], strict=True))
        return list(map(get, texts))

    def _encode(self, pieces: list[str]) -> None:
        """Makes pieces known, many in one text: each starts with a space, or, where spaces are dropped, is of letters and a digit follows it. Pieces whose ids can't be told apart stay unknown."""
        for i in range(0, len(pieces) if self.digit is not None or not self.drops_space else 0, 2000):
            part = pieces[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["0".join([*part, ""]) if self.drops_space else "".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            if self.drops_space:
                at = np.flatnonzero(ids == self.digit)
                begins, ends = np.append(0, at[:-1] + 1), at
            else:
                begins = np.flatnonzero(self.starts[ids])
                ends = np.append(begins[1:], len(ids))
            if len(begins) == len(part) and begins[0] == 0 and ends[-1] + self.drops_space == len(ids) and (begins < ends).all():
                self.known.update(zip(part, map(ids.tobytes().__getitem__, map(slice, (4 * begins).tolist(), (4 * ends).tolist())), strict=True))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts (null: empty): the ids of all of them, and where each ends in that array."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.append(np.searchsorted(size, np.arange(SLICE, size[-1] if len(size) else 0, SLICE)) + 1, len(texts)))
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            if b > a:
                yield self._slice(texts.slice(a, b - a))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind is None:
            each = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(x) // 4 for x in each])
        odd = pc.match_substring_regex(texts, self.added, ignore_case=self.drops_space).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        if not self.drops_space:
            odd = odd | pc.match_substring_regex(texts, r"[\s\v\x1c-\x1f\x{85}\pZ] ").to_numpy(zero_copy_only=False)
        whole = self.whole(texts.filter(pa.array(odd)).to_pylist())
        pieces, counts = _pieces(pc.if_else(pa.array(odd), "", texts) if len(whole) else texts, self.drops_space)
        coded = pieces.dictionary_encode()
        index, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.known.get, keys))
        if new := [k for k, v in zip(keys, values, strict=True) if v is None]:
            fresh = iter(self._learn(new))
            values = [next(fresh) if v is None else v for v in values]
        if whole:  # an odd text is one piece
            index = np.insert(index, (np.cumsum(counts) - counts)[odd], np.arange(len(values), len(values) + len(whole)))
            counts[odd] = 1
            values += whole
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<u4")
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths))), pa.array(flat))
        ids = lists.take(pa.array(index)).flatten().to_numpy(zero_copy_only=False)
        return ids, np.append(0, np.cumsum(lengths[index]))[np.cumsum(counts)]


#: Kinds of bytes: letters of ASCII and Latin-1, digits, other visible characters of ASCII, the apostrophe, a line's end that follows one of these, the space, and the rest; and pairs of kinds between which each tokenizer cuts.
_REST, _LETTER, _DIGIT, _SIGN, _QUOTE, _BREAK, _SPACE = range(7)
_BYTES = bytes(_SPACE if b == 32 else _BREAK if b == 10 else _REST if b < 33 or b > 126 else _DIGIT if chr(b).isdigit() else _LETTER if chr(b).isalpha() else _QUOTE if b == 39 else _SIGN for b in range(256))
_CUTS = {(a, b) for a in (_LETTER, _DIGIT, _SIGN) for b in (_LETTER, _DIGIT, _SIGN) if a != b} | {(a, b) for k in (_LETTER, _DIGIT, _SIGN, _QUOTE) for a, b in ((k, _BREAK), (_BREAK, k))}
_PAIRS = bytes((i >> 4, i & 15) in _CUTS or i & 15 == _SPACE for i in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256))


def _pieces(texts: pa.Array, drops_space: bool) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before each space and where ASCII alone tells that the tokenizer cuts; how many pieces each has. If it drops spaces they go, and A-Z is lower-cased."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes()
    raw, ends = raw.translate(_LOWER) if drops_space else raw, ends - ends[0]
    kinds, raw = np.frombuffer(bytearray(raw.translate(_BYTES)), np.uint8), np.frombuffer(raw, np.uint8)
    lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF; two of them are signs
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kinds[lead] = kinds[lead + 1] = _LETTER
    breaks = np.flatnonzero(kinds == _BREAK)
    before = kinds[breaks - 1]
    kinds[breaks[(before < _LETTER) | (before > _QUOTE)]] = _REST
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = np.frombuffer((kinds[:-1] << 4 | kinds[1:]).tobytes().translate(_PAIRS), bool)
    begins[ends] = True
    begins[-1] = False
    if drops_space:
        kept = kinds != _SPACE
        begins[1:-1] |= ~kept[:-1]
        raw, begins = raw[kept], begins[:-1][kept]
        ends = np.append(0, np.cumsum(kept))[ends]
    at = np.append(np.flatnonzero(begins), len(raw))
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]), np.diff(np.searchsorted(at, ends))


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() else rf"\x{{{ord(c):x}}}" for c in text)
