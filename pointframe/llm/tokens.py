"""Token ids of whole texts from a byte-level tokenizers file, with remembered words.

A byte-level pre-tokenizer cuts a text at every single space between two words,
so each distinct " word" of a batch is looked up once, and its ids are gathered
for all its places. It also cuts between letters and the marks or line feeds
after them, so only the letters of such a word are remembered, whatever follows.
Another word that is not remembered is cut by the pre-tokenizer's own pattern and
its parts go to the file's BPE model. Texts with runs of white space or other
blanks, or with the content of an added token, are encoded whole by the tokenizer.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: ASCII marks: neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# The byte-level pre-tokenizer's pattern; white space other than space and line feed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

_ENCODERS: dict[str, Encoder] = {}


def _plain(stem: str) -> bool:
    """Letters only, of blocks where Python and the pre-tokenizer agree on what a letter is: it cuts after them."""
    return stem.isalpha() and (stem.isascii() or max(stem) < "\u0250")


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _cuts_at_spaces(path: str) -> bool:
    """Whether a file's pre-tokenizer is the byte-level one with this module's pattern, before a plain BPE model: only then
    may words be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type") == "BPE" and plain


class _Memory(dict):
    """Ids of pieces of text, made on demand and remembered for two generations of ``limit`` pieces."""

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make = limit, make
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        return found

    def age(self) -> None:
        """Forget what was not used since the generation before, if this one is full."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as ``encode(text, add_special_tokens=False)`` gives them (of files with another normalizer or
    pre-tokenizer by the tokenizer itself, text by text); with ``plain``, special-token strings in a
    text are ordinary text. Needs a little-endian machine."""

    def __init__(self, path: str, limit: int = 200_000, plain: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        assert sys.byteorder == "little"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.by_words = _cuts_at_spaces(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.space = byte_letters()[32]
        self.words = _Memory(limit, self._word)
        self.parts = _Memory(limit // 4, self._part)
        self.cut = regex.compile(PATTERN).findall

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word."""
        if _plain(word):
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.tokenize(self.space + raw)]).tobytes()
        return b"".join(map(self.parts.__getitem__, self.cut(" " + word)))

    def _part(self, part: str) -> bytes:
        """Ids of a pre-tokenized part."""
        return array("I", [t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def whole(self, text: str) -> bytes:
        """Ids of one text by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a piece of text that begins and ends where the pre-tokenizer cuts."""
        return b"".join(map(self.parts.__getitem__, self.cut(text)))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text (null: none)."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        self.words.age()
        self.parts.age()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            every = [np.frombuffer(self.whole(t), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *every]), np.array([len(x) for x in every], np.int64)
        odd = pc.match_substring_regex(texts, BLANKS)
        for pattern in ("  ", " \n", "\n "):
            odd = pc.or_(odd, pc.match_substring(texts, pattern))
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = odd.to_numpy(zero_copy_only=False)
        ids, lengths = self._spaced(texts.filter(pa.array(~odd)) if odd.any() else texts)
        if not odd.any():
            return ids, lengths
        alone = [np.frombuffer(self.whole(t), "<u4") for t in texts.filter(pa.array(odd)).to_pylist()]
        every = np.zeros(len(odd), np.int64)
        every[~odd], every[odd] = lengths, [len(x) for x in alone]
        out = np.empty(every.sum(), "<u4")
        mine = np.repeat(odd, every)
        out[~mine] = ids
        out[mine] = np.concatenate(alone)
        return out, every

    def _known(self, words: pa.Array, names: list[str]) -> list[bytes]:
        """Ids of a space and each of the distinct words."""
        lines = pc.list_element(pc.split_pattern(words, "\n", max_splits=1), 0)
        stems = pc.ascii_rtrim(lines, MARKS)
        stem = stems.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.words.__getitem__, stem))
        more = pc.less(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(more).tolist():
            if _plain(stem[i]):
                rest = names[i][len(stem[i]) :]
                known[i] += self.piece(rest) if "\n" in rest else self.parts[rest]
            else:
                known[i] = self.words[names[i]]
        return known

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        which = coded.indices.to_numpy().copy()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._known(coded.dictionary, names)
        # The first word of a text has no space before it.
        heads = bounds[:-1]
        first: dict[int, int] = {}
        for w in np.unique(which[heads]).tolist():
            first[w] = len(known)
            known.append(self.piece(names[w]))
        which[heads] = [first[w] for w in which[heads].tolist()]
        table = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        total = int(ends[-1])
        kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
        at = np.repeat((start[which] - (ends - n)).astype(kind), n)
        at += np.arange(total, dtype=kind)
        ids = table[at]
        at = np.concatenate([[0], ends])
        return ids, at[bounds[1:]] - at[bounds[:-1]]


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file, with the library's default for special tokens."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, plain=False)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after every text."""
    return np.insert(ids, np.cumsum(lengths), end_id).astype("<u4"), lengths + 1


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False))
