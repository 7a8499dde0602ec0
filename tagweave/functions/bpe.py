"""Byte-level byte-pair encoding, with a special-token splitter, in Python for Arrow UDFs."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

# Fixed value: how text is cut before merging.
# ASCII texts are cut by the plain module, the same way and several times as fast.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def pieces(text: str) -> list[str]:
    return (_ASCII if text.isascii() else PIECES).findall(text)


def byte_letters() -> dict[int, str]:
    """A visible letter for every byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Splitter:
    """Cuts special tokens out of a text: the first to be completed wins, the longest of those completed together, a one-letter token at once.

    The tokens are a trie; where the live start cannot go on, the node's link leads to the next start that can, so a text is read once."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.ends = [0], [0]  # length of the longest token that ends at a node
        for token in tokens:
            node = 0
            for letter in token:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.link.append(0)
                    self.ends.append(0)
                node = self.next[node][letter]
            if token:
                self.ends[node] = len(token)
        self.single = {t for t in tokens if len(t) == 1}
        self.any = re.compile("|".join(re.escape(t) for t in tokens if t) or r"(?!)")
        level = list(self.next[0].values())
        while level:
            for node in level:
                for letter, child in self.next[node].items():
                    self.link[child] = self._step(self.link[node], letter)
                    self.ends[child] = self.ends[child] or self.ends[self.link[child]]
            level = [child for node in level for child in self.next[node].values()]

    def _step(self, node: int, letter: str) -> int:
        while letter not in self.next[node] and node:
            node = self.link[node]
        return self.next[node].get(letter, 0)

    def split(self, text: str) -> list[str]:
        if not self.any.search(text):
            return [text] if text else []
        out, at, node = [], 0, 0
        for i, letter in enumerate(text):
            node = self._step(node, letter)
            size = 1 if letter in self.single else self.ends[node]
            if size:
                start = i + 1 - size
                if start > at:
                    out.append(text[at:start])
                out.append(text[start : i + 1])
                at, node = i + 1, 0
        if at < len(text):
            out.append(text[at:])
        return out


_BROKEN = 1 << 40


class Encoder:
    """Encodes and decodes with a vocabulary and ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None, unknown: str = "<unk>"):
        self.vocab, self.special, self.unknown = vocab, special or {}, unknown
        self.rank = {m: i for i, m in enumerate(merges)}
        self.pairs = {i: m for m, i in self.rank.items()}
        self.letters = byte_letters()
        self.bytes = {v: k for k, v in self.letters.items()}
        self.names = {i: t for t, i in {**vocab, **self.special}.items()}
        self.plain = {t for t, i in vocab.items() if self.names[i] == t and t not in self.special}  # those whose ids give them back
        self.splitter = Splitter(sorted(self.special))
        self.merged = lru_cache(1 << 16)(self._merged)
        self.sized = lru_cache(1 << 18)(self._sized)

    @classmethod
    def load(cls, vocab_path: str, merges_path: str, added_path: str | None = None) -> Encoder:
        """From a vocabulary file, a merges file (its first line is a header) and a file of added tokens."""
        with open(vocab_path, encoding="utf-8") as v, open(merges_path, encoding="utf-8") as m:
            merges = [tuple(x.split()) for x in m.read().splitlines()[1:] if x.strip()]
            vocab = json.load(v)
        special = {}
        if added_path:
            with open(added_path, encoding="utf-8") as a:
                special = json.load(a)
        return cls(vocab, merges, special)

    @classmethod
    def of_file(cls, path: str) -> Encoder:
        """From a tokenizer file of a public library: its vocabulary, merges and added tokens."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in whole["model"]["merges"]]
        return cls(whole["model"]["vocab"], merges, {t["content"]: t["id"] for t in whole.get("added_tokens", [])})

    def _merged_short(self, word: str) -> tuple[str, ...]:
        """As ``_merged``; for a few letters, looking over all pairs is quicker than a heap."""
        parts = list(word)
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            left, right = self.pairs[least]
            i = ranks.index(least)
            while i < len(ranks):
                if ranks[i] == least and parts[i] == left and parts[i + 1] == right:
                    parts[i : i + 2] = [left + right]
                    del ranks[i]
                    if i:
                        ranks[i - 1] = none + 1  # set when all places of this rank are merged
                    if i < len(ranks):
                        ranks[i] = none + 1
                i += 1
            ranks = [get((parts[i], parts[i + 1]), none) if r > none else r for i, r in enumerate(ranks)]
        return tuple(parts)

    def _merged(self, word: str) -> tuple[str, ...]:
        """All pairs of the least rank at a time, left to right: parts are a linked list, pairs lie in a heap by rank and place."""
        if len(word) <= 32:
            return self._merged_short(word)
        parts: list[str | None] = list(word)
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            rank = heap[0][0]
            places = []
            while heap and heap[0][0] == rank:
                places.append(heapq.heappop(heap)[1])
            left, right = self.pairs[rank]
            for i in places:  # in order, as they come from the heap
                j = after[i]
                if parts[i] != left or j < 0 or parts[j] != right:
                    continue  # gone since it was put in
                parts[i], parts[j] = left + right, None
                after[i] = after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                for a, b in ((before[i], i), (i, after[i])):
                    if a >= 0 and b >= 0 and (pair := (parts[a], parts[b])) in self.rank:
                        heapq.heappush(heap, (self.rank[pair], a))
        return tuple(p for p in parts if p is not None)

    def tokens(self, text: str) -> list[str]:
        out = []
        for part in self.splitter.split(text):
            if part in self.special:
                out.append(part)
                continue
            for piece in pieces(part):
                out.extend(self._of_piece(piece))
        return out

    def _of_piece(self, piece: str) -> tuple[str, ...]:
        return self.merged("".join(self.letters[b] for b in piece.encode()))

    def _numbered(self, tokens) -> list[int]:
        lost = self.vocab.get(self.unknown, self.special.get(self.unknown, 3))
        return [self.special.get(t, self.vocab.get(t, lost)) for t in tokens]

    def ids(self, text: str) -> list[int]:
        return self._numbered(self.tokens(text))

    def _sized(self, part: str, special: bool = False) -> int:
        """Number of a piece's or special token's ids; beyond ``_BROKEN`` if their bytes are not its own."""
        if not special:
            tokens = self._merged("".join([self.letters[b] for b in part.encode()]))
            if self.plain.issuperset(tokens):
                return len(tokens)
        ids = self._numbered([part] if special else tokens)
        joined = "".join(self.names.get(i, "") for i in ids)
        same = bytes(self.bytes[c] for c in joined if c in self.bytes) == part.encode()
        return len(ids) + (0 if same else _BROKEN)

    def measured(self, text: str) -> tuple[int, bool]:
        """Number of a text's ids, and whether they give it back.  Pieces are looked at one by one; only where one does not give itself back the whole text is decoded."""
        n = 0
        for part in self.splitter.split(text):
            n += self.sized(part, True) if part in self.special else sum(map(self.sized, pieces(part)))
        return n % _BROKEN, n < _BROKEN or self.decode(self.ids(text), 0) == text

    def decode(self, ids: list[int], marks: int = 3) -> str:
        """Text of ids; leading ids below ``marks`` are passed over."""
        at = 0
        while at < len(ids) and ids[at] < marks:
            at += 1
        joined = "".join(self.names.get(i, "") for i in ids[at:])
        return bytes(self.bytes[c] for c in joined if c in self.bytes).decode("utf-8", "replace")
