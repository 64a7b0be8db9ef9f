"""Token ids of many texts at once by the tokenizers library's model, which encodes each distinct word once a batch.

Words are cut by comparing classes of neighbouring characters, after the word vocabulary's
pattern: contractions, runs of letters, single digits, runs of other characters. Texts in which a special token's text may
stand go through the whole library one by one.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from voxloom.llm.bpe import LATER, LOWER, byte_letters

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Characters that a batch of joined texts holds at most, or one text; words kept from batch to batch.
BATCH, ROOM = 2_000_000, 100_000
# What the pattern takes as one word after an apostrophe.
ONE, TWO = "stmd", ("re", "ve", "ll")


def character_kinds() -> np.ndarray:
    """The class of every code point."""
    later = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *([0] * 0x800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, rf"(?V1)[\p{{L}}--[{later}]]+"), (NUMBER, rf"(?V1)[\p{{N}}--[{later}]]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


class BatchEncoder(dict):
    """A tokenizer file of this vocabulary's shape. As a dict: word -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kind = character_kinds()
        self.high = re.compile("[\U00010000-\U0010ffff]")
        self.odd = [re.compile(f"[{''.join(f'\\U{c:08x}' for c in LOWER if c < below)}]") for below in (0x10000, 0x110000)]
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        if self.kind[ord(word[0])] == SPACE:
            return b""
        spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        self[word] = ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32; null counts as empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held: list[tuple[int, str]] = []
        room = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text:
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            if room + len(text) > BATCH and held:
                self._joined(held, out)
                held, room = [], 0
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
                if self.odd[self.high.search(text) is not None].search(text):
                    text = text.translate(LOWER)
            held.append((i, text.lower()))
            room += len(text)
        if held:
            self._joined(held, out)
        return out

    def _joined(self, held: list[tuple[int, str]], out: list[np.ndarray]) -> None:
        """Encodes prepared texts, put together with a space after each, so that no word spans two."""
        text = " ".join([t for _, t in held])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *[len(t) + 1 for _, t in held]])[:-1]
        cuts = self._cuts(points, starts)
        raw, offsets = text.encode(), np.append(cuts, len(points))
        if len(raw) != len(points):
            wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            offsets = np.concatenate([[0], np.cumsum(wide)])[offsets]
        words = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        if len(self) > ROOM:
            self.clear()
        ids = list(map(self.__getitem__, words.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        each = words.indices.to_numpy()
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.Array.from_buffers(pa.uint32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(ids))]))
        flat = lists.take(words.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[each])])
        at = ends[np.append(np.searchsorted(cuts, starts), len(cuts))]
        for (i, _), a, b in zip(held, at[:-1], at[1:], strict=True):
            out[i] = flat[a:b]

    def _cuts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words and runs of white space begin, text starts included."""
        kind = self.kind[points]
        cut = np.empty(len(points), bool)
        cut[:1] = True
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        cut[starts] = True
        for q in np.flatnonzero((points == 39) & cut).tolist():
            after = "".join(map(chr, points[q + 1 : q + 3]))
            size = 2 if after[:1] and after[0] in ONE else 3 if after in TWO else 0
            if size:
                cut[q + 1] = False
                cut[q + size : q + size + 1] = True
        return np.flatnonzero(cut)


_loaded: dict[str, BatchEncoder] = {}


def loaded(path: str) -> BatchEncoder:
    """A file's encoder, made once a worker process."""
    if path not in _loaded:
        _loaded[path] = BatchEncoder(path)
    return _loaded[path]
