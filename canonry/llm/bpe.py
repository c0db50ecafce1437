"""Byte-level BPE by speculation and verification.

A text is cut into words by the tokenizer's pattern.  For every word not met
before, the greedy longest match proposes tokens; then one vectorised check over
all proposals of the batch decides for every adjacent token pair whether exact
BPE would keep that boundary.  A sequence of reachable tokens whose adjacent
pairs are all compatible is the BPE encoding, so only words with a failing pair
go through exact merging.

Defined results: a null or empty text has no ids and decodes to the empty
string; special token strings in a text become their ids, as the tokenizers
library does by default; ids decode byte by byte with invalid UTF-8 replaced;
repeated rows and equal texts get equal results; very long words are merged with
a heap in O(n log n); columns other than the named ones are not touched.
"""

from __future__ import annotations

import array
import gc
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: The word pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries a worker remembers before it starts over; bounds its memory.
CACHE_ENTRIES = 600_000
#: Characters of one remembered piece at most; longer ones are encoded each time.
CACHE_PIECE = 200


def default_vocabulary() -> str:
    """The vocabulary file installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself,
    the others take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one tokenizer file.  Tokens are numbered by *order*: single
    bytes first, then merged tokens in merge order; ``to_id`` maps to file ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if all(c in alphabet for c in k)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        n = 256 + len(merges)
        self.order = {bytes([b]): b for b in range(256)}
        self.to_id = np.zeros(n, np.int32)
        for b in range(256):
            self.to_id[b] = vocab[bytes([b])]
        self.left = np.arange(n, dtype=np.int64)
        self.right = np.arange(n, dtype=np.int64)
        self.merge: dict[tuple[int, int], int] = {}
        keys, made = [], []
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            pair, new = (self.order[a], self.order[b]), 256 + rank
            self.to_id[new] = vocab[a + b]
            self.left[new], self.right[new] = pair
            self.order.setdefault(a + b, new)
            self.merge[pair] = new
            keys.append(pair[0] * n + pair[1])
            made.append(new)
        at = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_made, self.n = np.array(keys, np.int64)[at], np.array(made, np.int64)[at], n
        reachable = self._compatible(self.left[256:], self.right[256:], np.arange(256, n))
        ok = np.concatenate([np.ones(256, bool), reachable])
        for i in range(256, n):
            if ok[i] and not (ok[self.left[i]] and ok[self.right[i]]):
                ok[i] = False
        #: Tokens that the proposal may use, by their bytes.
        self.usable = {k: v for k, v in self.order.items() if ok[v]}
        #: The longest usable token by its first three bytes.
        self.reach: dict[bytes, int] = {}
        for k in self.usable:
            self.reach[k[:3]] = max(self.reach.get(k[:3], 0), len(k))
        self.decimal = {i: str(i) for i in [*self.to_id.tolist(), *self.special.values()]}
        self.bytes_of_id = {int(self.to_id[v]): k for k, v in self.order.items()} | {v: k.encode() for k, v in self.special.items()}

    def _compatible(self, first: np.ndarray, second: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does exact BPE of their joined bytes keep the
        boundary?  Undoes the merges along the boundary, last merge first; if
        some merge across the boundary would have come before the merge undone
        last, BPE would have crossed it."""
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        bound = np.full(len(a), self.n + 1, np.int64) if limit is None else limit.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_made[at], self.n + 2)
            crossed = across < bound[live]
            ok[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            undo_left = x > y
            # A single byte can't be undone; then the other side is, if it can.
            single_x, single_y = self.right[x] == x, self.left[y] == y
            take_x = np.where(undo_left, ~single_x, single_y & ~single_x)
            take_y = ~take_x & ~single_y
            a[live[take_x]], bound[live[take_x]] = self.right[x[take_x]], x[take_x]
            # A merge at the boundary wins over an equal-ranked one to its right.
            b[live[take_y]], bound[live[take_y]] = self.left[y[take_y]], y[take_y] + 1
            live = live[take_x | take_y]
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match over usable tokens."""
        out, i, n, usable, reach = [], 0, len(word), self.usable, self.reach
        got = usable.get(word)
        if got is not None:
            return [got]
        while i < n:
            j = min(n, i + reach.get(word[i : i + 3], 2))
            while (got := usable.get(word[i:j])) is None:
                j -= 1
            out.append(got)
            i = j
        return out

    def exact(self, word: bytes) -> list[int]:
        """Exact BPE: merge the earliest pair, the leftmost first."""
        if len(word) > 40:
            return self._exact_long(word)
        token, find, never = list(word), self.merge.get, self.n
        made = [find(p, never) for p in zip(token, token[1:])]
        while made and (m := min(made)) < never:
            i = made.index(m)
            token[i : i + 2] = [m]
            del made[i]
            if i:
                made[i - 1] = find((token[i - 1], m), never)
            if i < len(made):
                made[i] = find((m, token[i + 1]), never)
        return token

    def _exact_long(self, word: bytes) -> list[int]:
        """The same with a heap of candidate merges."""
        token, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, token[i], token[i + 1]) for i in range(n - 1) if (m := self.merge.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, x, y = heapq.heappop(heap)
            j = after[i] if token[i] == x else n
            if j >= n or token[j] != y:
                continue
            token[i], token[j] = m, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := self.merge.get((m, token[k]))) is not None:
                    heapq.heappush(heap, (new, i, m, token[k]))
            if (h := before[i]) >= 0 and (new := self.merge.get((token[h], m))) is not None:
                heapq.heappush(heap, (new, h, token[h], m))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes], propose: Callable[[bytes], list[int]] | None = None) -> list[list[int]]:
        """Orders for each word: propose, verify all pairs at once, repair."""
        out = list(map(propose or self.propose, words))
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for o in out for t in o), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pair = flat[inner] * self.n + flat[inner + 1]
        kinds, back = np.unique(pair, return_inverse=True)
        good = self._compatible(kinds // self.n, kinds % self.n)
        for i in np.unique(owner[inner[~good[back]]]):
            out[i] = self.exact(words[i])
        return out


class _Codes(dict):
    """Numbers pieces in the order met; the new ones wait in ``pending``."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.pending.append(piece)
        return code


class Encoder:
    """Encodes batches of texts and remembers pieces met before.

    Where single blanks and line feeds separate everything, a text is cut at
    them; no word of the pattern goes across such a cut, so each piece can be
    remembered with its ids.  Any other text is cut by the pattern itself."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self.odd = re.compile("|".join([r"\s", *map(re.escape, self.v.special)]))
        self.propose = None
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.ids = array.array("i")
        self.starts, self.sizes = array.array("q"), array.array("q")
        self.chars = 0

    def _odd(self, piece: str) -> bool:
        """Pieces that can't be encoded by themselves.  They carry a leading
        blank, a leading line feed, or \\0 if they begin a text."""
        body = piece[1:]
        return not body or len(body) > CACHE_PIECE or self.odd.search(body) is not None

    def _settle(self) -> None:
        """Encode the pieces that wait."""
        pending, self.codes.pending = self.codes.pending, []
        cut = [None if self._odd(p) else self.pattern.findall(p[1:] if p[0] == "\0" else p) for p in pending]
        words = list({w for c in cut if c for w in c})
        known = dict(zip(words, self._words(words), strict=True))
        for p, c in zip(pending, cut, strict=True):
            self.starts.append(len(self.ids))
            if c is None:
                self.sizes.append(-1)
                continue
            for w in c:
                self.ids.extend(known[w])
            self.sizes.append(len(self.ids) - self.starts[-1])
            self.chars += len(p)

    def _words(self, words: list[str]) -> list[list[int]]:
        to_id = self.v.to_id.tolist().__getitem__
        return [list(map(to_id, o)) for o in self.v.encode_words([w.encode("utf-8", "surrogatepass") for w in words], self.propose)]

    def _by_pattern(self, text: str) -> np.ndarray:
        """Ids of one text by the pattern, special strings taken out first."""
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                words = self.pattern.findall(part)
                kinds = list(set(words))
                known = dict(zip(kinds, self._words(kinds), strict=True))
                for w in words:
                    out.extend(known[w])
        return np.array(out, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.codes) > CACHE_ENTRIES or self.chars > 16 * CACHE_ENTRIES:
            self._reset()
        gc.disable()  # nothing here is cyclic, and the many small lists would set it off all the time
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        coded = []
        for t in texts:
            if not t:
                coded.append(None)
                continue
            if "\0" in t:  # the mark of a first piece
                coded.append(np.zeros(0, np.int64))
                continue
            # Every piece keeps what stands before it: "\n" itself, or a blank.
            pieces = ("\0" + t.replace("\n", " \n")).split(" ")
            coded.append(np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces)))
        self._settle_blanks()
        starts, sizes = np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64)
        ids = np.frombuffer(self.ids, np.int32)
        out = []
        for t, c in zip(texts, coded, strict=True):
            if c is None:
                out.append(np.zeros(0, np.int32))
                continue
            n = sizes[c]
            if not len(n) or n.min() < 0:
                out.append(self._by_pattern(t))
                continue
            ends = np.cumsum(n)
            out.append(ids[np.repeat(starts[c] - ends + n, n) + np.arange(ends[-1])])
        del starts, sizes, ids  # views; the arrays grow again
        return out

    def _settle_blanks(self) -> None:
        """Pieces that begin with neither \\0 nor a line feed had a blank."""
        self.codes.pending = [p if p[:1] in ("\0", "\n") else " " + p for p in self.codes.pending]
        self._settle()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.bytes_of_id.__getitem__, ids.tolist())).decode("utf-8", "replace")


class QuickEncoder(Encoder):
    """Proposals from a compiled BPE instead of the longest match; they are
    verified and repaired alike, so the ids are the same."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        self.propose = tiktoken.Encoding("proposals", pat_str=PATTERN, mergeable_ranks=self.v.order, special_tokens={})._core_bpe.encode_single_piece


_encoders: dict[tuple[type, str], Encoder] = {}


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder a worker process."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def forget() -> None:
    for e in _encoders.values():
        e._reset()


def texts_in_slices(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    """Few texts at a time, so that their pieces stay small."""
    for i in range(0, len(column), rows):
        yield i, column.slice(i, rows).to_pylist()


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])


def encode_decode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` of every row."""
    common.ship(df.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for i, texts in texts_in_slices(b.column(1)):
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], ["key", "ids", "decoded"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *ENCODED.fields])
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(common.task(run), schema).withColumnRenamed("key", key)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Counts and digests of what ``encode_decode`` gives, made where the ids
    are, so that neither ids nor texts travel back."""
    common.ship(df.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            n, sha_ids, sha_text = [], [], []
            for _, texts in texts_in_slices(b.column(1)):
                for ids in own.encode(texts):
                    listed = ids.tolist()
                    n.append(len(listed))
                    sha_ids.append(hashlib.sha256(",".join(map(own.v.decimal.__getitem__, listed)).encode()).hexdigest())
                    sha_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(common.task(run), schema).withColumnRenamed("key", key)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict[str, str] = {}
