"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

Speculate and verify. Every text is cut into words by the vocabulary's own pattern. For each new
word of a batch

1. greedy longest match over the vocabulary proposes tokens;
2. all adjacent pairs of all proposals are tested at once with NumPy: a sequence of tokens is what
   byte-pair merging gives exactly when merging the bytes of any two neighbours gives these two;
3. only words with a failing pair are merged exactly.

No shuffle and no aggregation: one pass of mapInPandas over (id, text).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the public vocabularies; a parameter of every entry point.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the word pattern of the vocabulary, stated in the folder's README.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept in a worker's memory between batches; beyond it the memory starts anew.
WORD_MEMORY = 200_000

_loaded: dict[str, "ByteBpe"] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 stands for itself,
    the other bytes follow from code point 256 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary, merges and the tables that verification needs."""

    def __init__(self, path: str):
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        # strings of special tokens are not reachable by merges and are ordinary text here
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, dtype=np.int64)  # order of the merge that makes a token; -1: a byte
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge_of[x, y] = (r, z)
            keys.append(x * size + y)
            ranks.append(r)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.size = size
        order = np.argsort(np.asarray(keys, dtype=np.int64))
        self.pair_key = np.asarray(keys, dtype=np.int64)[order]
        self.pair_rank = np.asarray(ranks, dtype=np.int64)[order]
        self.words = regex.compile(WORD_PATTERN)
        # a token can be proposed only if merging its own bytes gives it back
        reach = np.ones(size, dtype=bool)
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        fits = self.compatible(self.left[made], self.right[made], self.rank[made])
        for z, ok in zip(made.tolist(), fits.tolist()):
            reach[z] = ok and reach[self.left[z]] and reach[self.right[z]]
        self.token_of = {raw(s): i for s, i in vocab.items() if len(s) == 1 or self.rank[i] >= 0 and reach[i]}
        self.longest = max(map(len, self.token_of))
        self.memory: dict[str, list[int]] = {}

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a huge one where there is none."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, want), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == want, self.pair_rank[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does no merge ever cross their border?

        The merges of both tokens are undone from the last to the first. At each moment the tokens
        next to the border are known, and the merge across it must not come before the one that is
        undone next (a merge on the left comes first among equals, as merging runs from the left).
        `below`: only merges of lower rank than this count, for the two halves of one token.
        """
        n = len(a)
        good = np.ones(n, dtype=bool)
        live = np.arange(n)
        a, b = a.copy(), b.copy()
        # the border's merge would have to win before this moment; 2 * rank (+ 1: ties lose) keeps order
        limit = np.full(n, np.iinfo(np.int64).max) if below is None else 2 * below
        while len(live):
            cross = self.merge_rank(a, b)
            wins = np.where(cross == np.iinfo(np.int64).max, False, 2 * cross < limit)
            good[live[wins]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~wins & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, limit = live[go], a[go], b[go], ra[go], rb[go], limit[go]
            undo_left = ra > rb
            undo_both = (ra == rb) & (ra >= 0)
            # same rank on both sides: the right one is undone first, being merged last
            limit = np.where(undo_left, 2 * ra, 2 * rb + 1)
            a = np.where(undo_left & ~undo_both, self.right[a], a)
            b = np.where(~undo_left, self.left[b], b)
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.token_of.get(word)
        if whole is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        find = self.token_of
        while at < n:
            end = min(n, at + self.longest)
            while (t := find.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, from the left; a heap over a linked list."""
        import heapq

        tok = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := self.merge_of.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i] if tok[i] == x else n
            if j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = self.merge_of[x, y][1], -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := self.merge_of.get((tok[i], tok[k])):
                    heapq.heappush(heap, (m[0], i, tok[i], tok[k]))
            h = prv[i]
            if h >= 0 and (m := self.merge_of.get((tok[h], tok[i]))):
                heapq.heappush(heap, (m[0], h, tok[h], tok[i]))
        return [t for t in tok if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not in memory yet."""
        if len(self.memory) > WORD_MEMORY:
            self.memory.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        said = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
        flat = np.fromiter((t for s in said for t in s), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(said)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, dtype=np.int64)
        bad = set(owner[inside[~self.compatible(flat[inside], flat[inside + 1])]].tolist())
        for i, w in enumerate(words):
            self.memory[w] = self.merge(raw[i]) if i in bad else said[i]

    def cut_words(self, text: str) -> list[str]:
        return self.words.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for a null and for an empty text."""
        cut = [self.cut_words(t) if t else [] for t in texts]
        new = {w for ws in cut for w in ws} - self.memory.keys()
        if len(self.memory) + len(new) > WORD_MEMORY:
            new = {w for ws in cut for w in ws}
            self.memory.clear()
        self.learn(list(new))
        known = self.memory
        return [[t for w in ws for t in known[w]] for ws in cut]


def load(name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> ByteBpe:
    """The vocabulary, once per Python worker."""
    path = os.path.join(tokenizer_dir, f"{name}.json")
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """(id, ids): the ids of each text, without special tokens.

    A null and an empty text give an empty list, never null. Strings that look like special tokens
    are ordinary text. Rows with a null or repeated id are encoded like all others; other columns
    of df, whatever their names, are not read.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(name, tokenizer_dir)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": bpe.encode_batch(b["text"].tolist())})

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_ids(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """(id, n_ids): only the number of ids of each text; 0 for null and empty ones."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(name, tokenizer_dir)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_ids": [len(x) for x in bpe.encode_batch(b["text"].tolist())]})

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, n_ids int").withColumnRenamed("id", id_col)


def round_trip(ids: list[int], name: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> str:
    """The text of ids, for tests."""
    bpe = load(name, tokenizer_dir)
    of = {i: b for b, i in bpe.token_of.items()}
    return b"".join(of[i] for i in ids).decode("utf-8", "surrogatepass")


