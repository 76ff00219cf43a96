"""Byte-level BPE by speculation and verification.

A word (pre-token) is first cut greedily into the longest vocabulary entries. That cut is the one BPE
makes if every token is a cut of itself and every two neighbours are compatible, which means that
merging the bytes of the two alone gives the two back. The neighbours of all new words of a batch are
tested at once, as arrays: each token knows the two it was last merged from, a pair is taken apart from the merge
of highest rank down, and it is incompatible if on the way a merge across its border would have come first. Only
the words with an incompatible pair are merged exactly, by a heap over ranks, in n log n.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

#: Fixed value: how byte-level vocabularies of this family part text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words that a worker remembers from one group of texts to the next; beyond that it forgets all. No effect on results.
CACHE_WORDS = 400_000


def default_vocabulary(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class ByteBPE:
    """Encoder over a file of ranks (a base64 token and its id on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.size = max(self.token) + 1
        self.words: dict[str, list[int]] = {}
        self.left = np.full(self.size, -1, dtype=np.int64)  # of a token the two it is merged from last; -1 not known yet, -2 no merge gives it
        self.right = np.full(self.size, -1, dtype=np.int64)
        self.split = regex.compile(WORD_PATTERN).findall
        self.exact_words = self.all_words = 0

    def merge(self, data: bytes, last: list | None = None) -> list[int]:
        """The exact merges: always the pair of lowest rank, the leftmost of equals; `last` is given the two parts of the last one."""
        ranks = self.ranks
        if data in ranks and len(data) == 1:
            return [ranks[data]]
        n = len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] is None or parts[j] is None or parts[i] + parts[j] != both:
                continue
            if last is not None:
                last[:] = parts[i], parts[j]
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                r = ranks.get(both + parts[after[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, both + parts[after[j]]))
            if before[i] >= 0:
                r = ranks.get(parts[before[i]] + both)
                if r is not None:
                    heapq.heappush(heap, (r, before[i], parts[before[i]] + both))
        return [ranks[p] for p in parts if p is not None]

    def greedy(self, data: bytes) -> list[int]:
        ranks, out, i, n = self.ranks, [], 0, len(data)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (r := ranks.get(data[i:j])) is not None:
                    out.append(r)
                    i = j
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[i]}")
        return out

    def _know(self, tokens: np.ndarray) -> None:
        """Fill in what the tokens, and those they are merged from, are merged from. A single byte is merged from itself."""
        todo = tokens[self.left[tokens] == -1].tolist()
        while todo:
            t = todo.pop()
            if self.left[t] != -1:
                continue
            data, last = self.token[t], []
            if len(data) == 1:
                self.left[t] = self.right[t] = t
            elif self.merge(data, last) == [t]:
                self.left[t], self.right[t] = a, b = self.ranks[last[0]], self.ranks[last[1]]
                todo += [x for x in (a, b) if self.left[x] == -1]
            else:
                self.left[t] = self.right[t] = -2

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives the two back; all pairs step by step together."""
        self._know(np.unique(np.concatenate([first, second])))
        a, b = first.copy(), second.copy()
        whole = (self.left[a] >= 0) & (self.left[b] >= 0)
        good = whole.copy()
        rank = self.ranks.get
        token = self.token
        live = np.flatnonzero(whole)
        # merges of rank limit and above are undone already; across the border one of a lower rank would have come before them.
        # On the right a merge of equal rank comes later than one at the border, on the left earlier.
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            codes, place = np.unique(a[live] * self.size + b[live], return_inverse=True)
            over = np.array([rank(token[c // self.size] + token[c % self.size], -1) for c in codes.tolist()], dtype=np.int64)[place]
            stop = (over >= 0) & (over < limit[live])
            good[live[stop]] = False
            live = live[~stop]
            x, y = a[live], b[live]
            from_left = (x > y) & (self.right[x] != x) | (self.left[y] == y)
            done = from_left & (self.right[x] == x)
            live, x, y, from_left = live[~done], x[~done], y[~done], from_left[~done]
            limit[live] = np.where(from_left, x, y + 1)
            a[live] = np.where(from_left, self.right[x], x)
            b[live] = np.where(from_left, y, self.left[y])
        return good

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of each word: propose, verify all pairs of the batch, merge the rest."""
        out: dict[str, list[int]] = {}
        if not words:
            return out
        ranks = self.ranks
        many: list[tuple[str, bytes, list[int]]] = []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            many.append((w, data, [r] if (r := ranks.get(data)) is not None else self.greedy(data)))
        flat = np.fromiter(chain.from_iterable(m[2] for m in many), dtype=np.int64)
        ends = np.cumsum([len(m[2]) for m in many])
        tokens, place = np.unique(flat, return_inverse=True)
        self._know(tokens)
        bad = np.zeros(len(flat) + 1, dtype=np.int64)
        bad[1:] = (self.left[tokens] < 0)[place]
        if len(flat) > 1:
            codes = flat[:-1] * self.size + flat[1:]
            inside = np.ones(len(codes), dtype=bool)
            inside[ends[:-1] - 1] = False  # the neighbours across two words are none
            distinct, place = np.unique(codes[inside], return_inverse=True)
            wrong = np.zeros(len(codes), dtype=bool)
            wrong[inside] = ~self.compatible(distinct // self.size, distinct % self.size)[place]
            bad[1:-1] += wrong
        total = np.cumsum(bad)
        failed = total[ends] - total[np.concatenate([[0], ends[:-1]])]
        self.all_words += len(many)
        for (w, data, ids), miss in zip(many, failed.tolist()):
            if miss:
                self.exact_words += 1
                ids = self.merge(data)
            out[w] = ids
        return out

    def known(self, parted: list[list[str]]) -> dict[str, list[int]]:
        """The ids of all words of a group of texts, of which new ones are encoded; the cache is emptied between groups only."""
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        new = set(chain.from_iterable(parted)).difference(self.words)
        self.words.update(self.learn(list(new)))
        return self.words

    def lists(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text the ids of its words, one list a word; null as empty."""
        parted = [self.split(t) if t else [] for t in texts]
        get = self.known(parted)
        return [[get[w] for w in p] for p in parted]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.lists([text])[0]))


_encoders: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """The worker's encoder of a vocabulary file; loaded once a process."""
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]


def _groups(texts: list[str | None], chars: int = 4_000_000):
    """Parts of a batch of bounded size, so that a few huge texts do not meet in memory."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids) of each row: the text's token ids without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty list. Rows stay apart even if ids repeat; a null id stays null.
    Narrow: no shuffle, one scan of two columns.
    """
    ship(df.sparkSession)
    path = vocabulary or default_vocabulary()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = picked.schema["id"].dataType

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _groups(texts):
                words = enc.lists(texts[a:b])
                flat = [list(chain.from_iterable(w)) for w in words]
                offsets = np.zeros(len(flat) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in flat], out=offsets[1:])
                values = np.fromiter(chain.from_iterable(flat), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "ids"]
                )

    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return picked.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids")
