"""Byte-pair encoding with a deterministic token automaton built from the merges.

The automaton reads tokens; its state after a token is that token's own state. Merges are
compiled one after another by the merge gadget: the merge of u and v into w takes v's arc
away from the state that follows u, and gives w an arc from every state that then had an arc
for u, leading to a copy of the state that follows v at that time. A token string is accepted
exactly if it is the encoding of the text it spells.

All tables are flat. Copies of states are not written out, as there would be an arc for most pairs of
tokens: a row of the arc table is filled in when a text first needs it, from the tables of the
gadgets. Texts are read once, from left to right: a second table leads from a place in the text to the
longest token that ends there and on to shorter ones, and the state of every prefix is the one of
them that has an arc from the state where it begins. Each prefix has one state only, so nothing is undone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.store import trimmed

NEVER = 1 << 60
#: Entries of the arc table, and of the text table besides its tree, that are kept.
ROOM = 150_000


class MergeAutomaton:
    """vocab: number of each token; merges: (left, right) tokens in order; end: suffix of a word's last token.

    symbols: the number below 1024 of each letter that tokens are written in (default: its code point).
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "", symbols: dict[str, int] | None = None):
        self.symbols = symbols or {c: ord(c) for t in vocab for c in t}
        n = max(vocab.values()) + 1
        self.left, self.right, self.born, self.size = (array("i", [-1]) * n for _ in range(4))
        self.rule: dict[int, int] = {}
        unmade = bytearray(n)
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] >= 0 or rank <= max(self.born[u], self.born[v]):
                raise ValueError(f"merge {rank} uses a token before it exists, or makes one again")
            # a token that the merges never make of its own text has no arc from the start
            unmade[w] = unmade[u] or unmade[v] or not self.there(u, v)
            self.left[w], self.right[w], self.born[w], self.rule[u << 20 | v] = u, v, rank, rank
        self.arcs: dict[int, bool] = {}
        self._tree({t: i for t, i in vocab.items() if not unmade[i]}, end)

    def _tree(self, vocab: dict[str, int], end: str) -> None:
        """The text table: a tree of the tokens' letters; by node, (token, size) of those that end there, longest first, inside a word and at its end."""
        self.step: dict[int, int] = {}
        self.inner, self.final, self.fail = [()], [()], array("i", [0])
        for token, i in vocab.items():
            bare = token.removesuffix(end) if end else token
            if self.born[i] < 0 and len(bare) != 1:
                continue  # a special token: no merge makes it
            node = 0
            for c in bare:
                key = node << 10 | self.symbols[c]
                if key not in self.step:
                    self.step[key] = len(self.inner)
                    for table, x in ((self.inner, ()), (self.final, ()), (self.fail, 0)):
                        table.append(x)
                node = self.step[key]
            self.size[i] = len(bare)
            if not end or bare != token:
                self.final[node] = ((i, len(bare)),)
            if bare == token:
                self.inner[node] = ((i, len(bare)),)
        self.most = len(self.step) + ROOM
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.step.items():
            children.setdefault(key >> 10, []).append((key & 1023, node))
        level = [0]
        while level:
            after = []
            for parent in level:
                for c, node in children.pop(parent, ()):
                    fail = self.fail[node] = self._fallen(self.fail[parent], c) if parent else 0
                    for table in (self.inner, self.final):
                        table[node] = table[node] + table[fail] if table[node] else table[fail]
                    after.append(node)
            level = after

    def _fallen(self, node: int, symbol: int) -> int:
        """The tree's node for the longest end of the text read so far, and one more symbol."""
        while (to := self.step.get(node << 10 | symbol)) is None and node:
            node = self.fail[node]
        return to or 0

    def there(self, x: int, y: int) -> bool:
        """Whether the state after x had an arc for y when both were made: no gadget had taken away the arc it is a copy of."""
        born, rule = self.born, self.rule
        while True:
            bx, by = born[x], born[y]
            if by > bx:  # y's arc was made where its left part had one
                y = self.left[y]
                if rule.get(x << 20 | y, NEVER) <= by:
                    return False
            elif bx >= 0:  # x's state is a copy of the one after its right part, before that merge took an arc away
                x, y = self.right[x], self.left[y] if by == bx else y
                if rule.get(x << 20 | y, NEVER) < bx:
                    return False
            else:
                return True

    def accepts(self, x: int, y: int) -> bool:
        """An entry of the arc table: whether y may follow x once all merges are compiled."""
        if len(self.arcs) >= ROOM:
            self.arcs.clear()
        self.arcs[x << 20 | y] = found = (x << 20 | y) not in self.rule and self.there(x, y)
        return found

    def encode(self, word: str | bytes) -> list[int]:
        """The tokens of a word, given as letters or symbols: arc labels on the way back from the state at its end."""
        text: Iterable[int] = [self.symbols[c] for c in word] if isinstance(word, str) else word
        n, step, arcs, ends = len(word), self.step, self.arcs, self.inner
        states, node, e = [-1] * (n + 1), 0, 0
        for c in text:
            e += 1
            key = node << 10 | c
            if key in step:
                node = step[key]
            else:
                node = self._fallen(node, c)
                if len(step) < self.most:
                    step[key] = node
            if e == n:
                ends = self.final
            for token, size in ends[node]:
                if size == e:
                    states[e] = token
                    break
                key = states[e - size] << 20 | token
                if key in arcs:
                    if arcs[key]:
                        states[e] = token
                        break
                elif self.accepts(states[e - size], token):
                    states[e] = token
                    break
        path = []
        while n:
            if states[n] < 0:
                raise ValueError("the word holds a character without a token")
            path.append(states[n])
            n -= self.size[states[n]]
        return path[::-1]


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Letters and numbers that came after the library's Unicode tables (16.0), so that they are neither to it.
LATER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff
1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
# Lower case by character where Python's str.lower has no or another one.
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def ranges(pattern: str, below: int, without: str = "") -> str:
    """The characters below a code point that a one-character pattern matches, as the inside of a character class."""
    every = "".join(map(chr, range(below)))
    cut = regex.compile(f"(?V1)(?:[{pattern}--[{without}]])+" if without else f"(?:{pattern})+")
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in cut.finditer(every))


class WordTokenizer(dict):
    """A tokenizer file whose texts are put in NFC and lower case and split by a pattern, each word encoded alone.

    As a dict: word -> ids as little-endian unsigned 32-bit integers. At most `room` words are kept here and
    as many older ones beside, which come back when they are met again.
    """

    def __init__(self, path: str, room: int = 60_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.room, self.older = spec["model"], room, {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = {c: b for b, c in byte_letters().items()}
        self.automaton = MergeAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "", letters)
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        labels = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = [""] * (max(labels.values()) + 1)
        for token, i in labels.items():
            self.label[i] = token
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        later = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())
        self.odd = [re.compile(f"[{''.join(f'\\U{c:08x}' for c in LOWER if c < below)}]") for below in (0x10000, 0x110000)]
        self.high = re.compile("[\U00010000-\U0010ffff]")
        # the pattern spelt out for texts of ASCII, of the basic plane, and of any characters: each word costs less the fewer ranges there are
        self.words = []
        for below in (0x80, 0x10000, 0x110000):
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            for name in (r"\p{L}", r"\p{N}"):
                pattern = pattern.replace(name, ranges(name, below, later))
            self.words.append(re.compile(pattern.replace(r"\s", ranges(r"\p{White_Space}", below))))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.automaton.encode(word.encode())).tobytes()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def encode(self, text: str) -> bytes:
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out: list[bytes] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                words = self.words[0]
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                    high = self.high.search(part) is not None
                    if self.odd[high].search(part):
                        part = part.translate(LOWER)
                    words = self.words[1 + high]
                out += map(self.__getitem__, words.findall(part.lower()))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs along the path, as the library joins them for a file without a decoder."""
        label = self.label
        return " ".join([label[i] for i in memoryview(ids).cast("I")]) if ids else ""


_loaded: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    """A file's tokenizer, compiled once a worker process; tasks clear its words when they end."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def encoded(text: Column, path: str) -> Column:
    """struct(ids binary, decoded string) of a text. Null counts as empty: no ids, decoded ''."""

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = loaded(path)
        for texts in batches:
            ids = [t.encode(x or "") for x in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [t.decode(x) for x in ids]})
        t.forget()
        trimmed()

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of token ids (little-endian unsigned 32-bit integers); null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = loaded(path)
        for rows in batches:
            yield rows.map(lambda x, t=t: None if x is None else t.decode(x))

    return run(ids)


def tokenized(df: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """df with a struct column `out`: ids, decoded. Every row stays; a column of df with that name is replaced."""
    return df.withColumn(out, encoded(F.col(f"`{text}`"), path))
