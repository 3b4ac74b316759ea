"""Public tokenizer files at the speed of a cache: words and fragments are encoded once, then joined."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a cache before it starts anew.
CACHE = 600_000


def _load(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def _packed(encodings: Iterable) -> list[bytes]:
    ids = [x.ids for x in encodings]
    flat = np.fromiter(chain.from_iterable(ids), dtype="<u4").tobytes()
    ends = [0, *accumulate(4 * len(x) for x in ids)]
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after the other."""
    end = np.cumsum(length)
    return flat[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - length), length)]


def _strings(words: pa.Array) -> list[str]:
    """Words without white space as Python strings."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ") if len(words) else []


class WordEncoder:
    """A tokenizer that drops white space between words, over Arrow arrays of texts.

    ASCII white space always separates words there, so a text's ids are those of its words in order, and a
    batch needs the ids of its distinct words alone.  A word of plain Latin letters with a tail of ASCII
    signs is two pieces, lower-cased here; distinct pieces go to the library joined by spaces, and the
    vocabulary's word-end marks tell their ids apart.  All other words go through the library's whole chain.
    """

    _kept: dict[str, WordEncoder] = {}
    _signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    _letters = "".join(chr(c) for c in range(256) if chr(c).islower())
    #: Bytes of text split at once, pieces joined at once.
    _bytes, _joined = 4 << 20, 2000

    def __init__(self, path: str):
        from tokenizers import normalizers, pre_tokenizers

        self.whole, self.bare = _load(path), _load(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.bare.model.end_of_word_suffix
        vocabulary = self.bare.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {"": 0}
        self.flat, self.start, self.length = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids (little-endian uint32) of each text; null counts as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + self._bytes, "right")))
            yield from self._some(texts.slice(at, to - at))
            at = to

    def _some(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        found = split.flatten().dictionary_encode()
        start, length, flat = self._words(found.dictionary)
        which = found.indices.to_numpy()
        ids = _gather(flat, start[which], length[which])
        ends = np.concatenate(([0], np.cumsum(length[which])))[offsets - offsets[0]]
        for a, b in zip(ends, ends[1:]):
            yield ids[a:b]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of the distinct words' ids start, how many they are, and the array that holds them."""
        lower = pc.utf8_lower(words)
        stem, tail = pc.utf8_rtrim(lower, characters=self._signs), pc.utf8_ltrim(lower, characters=self._letters)
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False).copy()
        if not plain.all():
            plain[~plain] = pc.match_substring_regex(words.filter(pa.array(~plain)), "^[!-~\u00c0-\u00ff]+$").to_numpy(zero_copy_only=False)
        plain &= pc.or_(pc.utf8_is_alpha(stem), pc.equal(stem, "")).to_numpy(zero_copy_only=False)
        if len(self.row) > CACHE:
            self._forget()
        units = np.zeros((len(words), 2), np.int64)
        for k, piece in enumerate((stem, tail)):
            found = piece.filter(pa.array(plain)).dictionary_encode()
            units[plain, k] = self._rows(_strings(found.dictionary), True)[found.indices.to_numpy()]
        units[~plain, 0] = self._rows(_strings(words.filter(pa.array(~plain))), False)
        both = units.reshape(-1)
        flat = _gather(self.flat, self.start[both], self.length[both])
        length = self.length[units].sum(axis=1)
        return np.cumsum(length) - length, length, flat

    def _rows(self, pieces: list[str], joined: bool) -> np.ndarray:
        """The pieces' rows in the table of ids, after adding those that it lacks."""
        new = [x for x in pieces if x not in self.row]
        parts, lengths = [self.flat], []
        if joined:
            for k in range(0, len(new), self._joined):
                some = new[k : k + self._joined]
                ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(some):
                    raise ValueError("the vocabulary's word ends do not tell words apart")
                parts.append(ids)
                lengths += np.diff(ends, prepend=0).tolist()
        else:
            for x in self.whole.encode_batch_fast(new, add_special_tokens=False):
                parts.append(np.array(x.ids, "<u4"))
                lengths.append(len(x.ids))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            length = np.array(lengths, np.int64)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
            self.length = np.concatenate((self.length, length))
            self.flat = np.concatenate(parts)
        return np.fromiter(map(self.row.__getitem__, pieces), np.int64, len(pieces))


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 for
    itself, the other bytes in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FragmentCoder:
    """Byte-level BPE by forced boundaries.

    Two neighbouring bytes that no vocabulary token (special ones included) holds side by side can never
    end up in one token, so a cut between them is certain.  A cut is used where it also leaves the
    pre-tokenizer's matches as they are: before the first byte of a character, not after white space
    (whose runs look ahead) and not before an apostrophe (which starts contractions).  Fragments are
    encoded independently and concatenated.
    """

    _kept: dict[str, FragmentCoder] = {}

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_alphabet()
        special = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        size = max([*spec["model"]["vocab"].values(), *special]) + 1
        self.bytes_of = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = special.get(i) or bytes(of[c] for c in token)
        for i, content in special.items():
            self.bytes_of[i] = content
        cut = np.ones((256, 256), dtype=bool)
        for token in self.bytes_of:
            for x, y in zip(token, token[1:]):
                cut[x, y] = False
        cut[[*range(9, 14), *range(28, 33)], :] = False
        cut[:, 0x80:0xC0] = False
        cut[:, ord("'")] = False
        self.cut = cut.reshape(-1)
        self.ids: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> FragmentCoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def fragments(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        if len(raw) < 2:
            return [raw] if raw else []
        b = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero(self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]])
        if len(at):  # white space of several bytes: C2 85, C2 A0, E1 9A 80, E2 80 xx, E2 81 9F, E3 80 80
            one, two = b[np.maximum(at - 1, 0)], b[np.maximum(at - 2, 0)]
            last = b[at]
            wide = (last >= 0x80) & (((one == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((two >= 0xE1) & (two <= 0xE3) & (one <= 0x9A)))
            at = at[~wide]
        ends = (at + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], [*ends, len(raw)])]

    def encode(self, texts: list[str | None], at_once: int = 256) -> Iterable[bytes]:
        """Little-endian 32-bit ids of each text."""
        for k in range(0, len(texts), at_once):
            split = [self.fragments(x or "") for x in texts[k : k + at_once]]
            if len(self.ids) > CACHE:
                self.ids.clear()
            new = list({f for x in split for f in x if f not in self.ids})
            if new:
                self.ids.update(zip(new, _packed(self.tokenizer.encode_batch([f.decode() for f in new], add_special_tokens=False)), strict=True))
            get = self.ids.__getitem__
            for x in split:
                yield b"".join(map(get, x))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
