"""Byte-level BPE by speculation and verification.

Each new word gets a *proposal*, the greedy longest match over the vocabulary.
A sequence of tokens is what exact merging gives if, and only if, every token
is what its own bytes merge to and every adjacent pair merges to itself; the
pairs of all new words are tested together against a memo of verdicts
(sorted 64-bit pair keys, ``searchsorted``), and only the words with a failing
pair are merged exactly. Words are memoised per Python worker, bounded by
``MEMO_WORDS``.

Null texts count as empty and give no tokens; a special token's string inside
a text becomes its id, as the tokenizers library does. Texts are encoded
whole. Repeated rows and ties are independent of each other; empty tables give
empty results.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held

MEMO_WORDS = 200_000  # in each memo of chunks, in two generations; half as many pre-tokens
SLICE_BYTES = 1 << 20  # text turned into Python objects at a time
LONG_WORD = 64  # bytes; longer words are merged by a heap
ID = (1 << 24) - 1  # a merge is rank << 24 | new id
NEVER = 1 << 60
# FIXED VALUE: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of every ordinary token."""
    to_byte = byte_alphabet()
    return {i: bytes(to_byte[c] for c in t) for t, i in json.loads(open(path, encoding="utf-8").read())["model"]["vocab"].items()}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, raw = spec["model"]["vocab"], vocabulary(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*raw, *self.special.values()]) + 1)
        for i, b in raw.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)  # the bytes of all tokens, one behind the other
        self.n_bytes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.offset = np.cumsum(self.n_bytes) - self.n_bytes
        id_of = {b: i for i, b in raw.items()}
        self.byte_id = [id_of[bytes([b])] for b in range(256)]
        self.merge_of: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge_of[vocab[a], vocab[b]] = rank << 24 | vocab[a + b]
        self.longest = ahocorasick.Automaton()
        for i, b in raw.items():
            self.longest.add_word(b.decode("latin-1"), i)
        self.longest.make_automaton()
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # by pre-token
        self.older: dict[str, dict[str, bytes]] = {"first": {}, "spaced": {}, "known": {}}  # the memos before the last turn
        self.pairs = np.empty(0, np.int64)  # sorted keys of the tested pairs ...
        self.pair_ok = np.empty(0, bool)  # ... and their verdicts
        self.exact_words = self.new_words = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent pair of lowest rank first, leftmost among equals."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        rank = self.merge_of.get
        ranks = [rank(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best & ID]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), NEVER)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        right, left = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.merge_of[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge_of]
        heapify(heap)
        while heap:
            best, k, a, b = heappop(heap)
            j, new = right[k], best & ID
            if ids[k] != a or j < 0 or ids[j] != b:
                continue  # one of the two is merged already
            ids[k], ids[j], right[k] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 <= y and (p := (ids[x], ids[y])) in self.merge_of:
                    heappush(heap, (self.merge_of[p], x, *p))
        return [i for i in ids if i >= 0]

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Verdicts on sorted pairs ``left << 32 | right`` (``left == -1``: the token by itself)."""
        at = np.searchsorted(self.pairs, keys)  # the keys come sorted, each once
        new = keys[self.pairs[np.minimum(at, len(self.pairs) - 1)] != keys] if len(self.pairs) else keys
        if len(new):
            ok = np.empty(len(new), bool)
            for k, key in enumerate(new.tolist()):
                a, b = key >> 32, key & 0xFFFFFFFF
                want = [b] if a < 0 else [a, b]
                ok[k] = self.merge(b"".join(self.bytes_of[t] for t in want)) == want
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.pair_ok = np.insert(self.pairs, at, new), np.insert(self.pair_ok, at, ok)
        return self.pair_ok[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, by proposal, test of all pairs, and merging of those that fail."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [[i for _, i in self.longest.iter_long(b.decode("latin-1"))] for b in raw]
        n = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((i for g in guess for i in g), np.int64, int(n.sum()))
        word = np.repeat(np.arange(len(guess)), n)
        inner = word[1:] == word[:-1]
        keys = np.concatenate([flat | (-1 << 32), (flat[:-1] << 32 | flat[1:])[inner]])
        uniq, back = np.unique(keys, return_inverse=True)
        bad = ~self.compatible(uniq)[back]
        failing = set(np.concatenate([word, word[1:][inner]])[bad].tolist())
        self.new_words += len(words)
        self.exact_words += len(failing)
        return [little(self.merge(raw[k]) if k in failing else g) for k, g in enumerate(guess)]

    def remember(self, name: str, chunks: set[str], before: str) -> None:
        """Memoise the ids of ``before + chunk`` for every chunk."""
        memo, older, known = getattr(self, name), self.older[name], self.older["known"]
        again = chunks & older.keys()
        memo.update((x, older[x]) for x in again)
        cut = {x: self.words.findall(before + x) for x in chunks - again}
        words = {w for ws in cut.values() for w in ws}.difference(self.known)
        self.known.update((w, known[w]) for w in words & known.keys())
        words = list(words - known.keys())
        self.known.update(zip(words, self.learn(words)) if words else ())
        ids = self.known.__getitem__
        memo.update((x, ids(ws[0]) if len(ws) == 1 else b"".join(map(ids, ws))) for x, ws in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A single space before a non-space always starts a pre-token, so a text is cut there first, and the memo
        holds what follows a space (``self.spaced``) or starts a text (``self.first``). A text with two spaces
        together, or one at its end, is cut by the pattern alone.
        """
        for name, most in (("first", MEMO_WORDS // 2), ("spaced", MEMO_WORDS // 2), ("known", MEMO_WORDS // 4)):
            if len(memo := getattr(self, name)) > most:  # words still in use come back from the older memo
                self.older[name] = memo
                setattr(self, name, {})
        plan = []  # per text: (ids, chunk that starts it, chunks behind spaces)
        for t in texts:
            parts = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            for k, p in enumerate(parts):
                if k % 2:
                    plan.append((self.special[p].to_bytes(4, "little"), None, ()))
                elif "  " in p or p.endswith(" "):
                    for w in self.words.findall(p):
                        plan.append((None, w, ()))
                else:
                    head, *rest = p.split(" ")
                    plan.append((None, head, rest))
            plan.append(None)
        if new := {x[1] for x in plan if x and x[0] is None}.difference(self.first):
            self.remember("first", new, "")
        if new := set().union(*(x[2] for x in plan if x)).difference(self.spaced):
            self.remember("spaced", new, " ")
        first, spaced, out, ids = self.first, self.spaced.__getitem__, [], []
        for x in plan:
            if x is None:
                out.append(b"".join(ids))
                ids = []
            elif x[0] is not None:
                ids.append(x[0])
            else:
                ids.append(first[x[1]])
                ids.extend(map(spaced, x[2]))
        return out

    def decode(self, ids: bytes) -> str:
        t = np.frombuffer(ids, "<u4")
        n = self.n_bytes[t]
        end = np.cumsum(n)
        at = np.repeat(self.offset[t] - end + n, n) + np.arange(n.sum())
        return self.flat[at].tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return held("codec", path, lambda: Codec(path))


def _slices(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Runs of whole texts of about ``most`` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t or "")
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


def cut(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in runs of whole texts of about ``SLICE_BYTES`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES, prepend=0)).tolist()
    for begin, end in zip([0, *at], [*at, len(size)]):
        if end > begin:
            yield texts.slice(begin, end - begin)


def _passed(df: DataFrame, out: list[tuple[str, str]], made: Callable[[pa.RecordBatch], list[pa.Array]], text: str) -> DataFrame:
    """``df`` with columns made from slices of its batches; only one slice at a time is Python objects."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in out)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in cut(batch.column(at)):
                part = batch.slice(begin, len(texts))
                begin += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *made(part)], [*batch.schema.names, *(n for n, _ in out)])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text`` (binary, little-endian unsigned 32-bit integers), and with their decoded text if ``decoded`` names a column."""
    path = path or default_path()
    k = df.columns.index(text)

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path)
        got = c.encode([t or "" for t in batch.column(k).to_pylist()])
        return [pa.array(got, pa.binary())] + ([pa.array([c.decode(x) for x in got], pa.string())] if decoded else [])

    return _passed(df, [(ids, "binary"), *([(decoded, "string")] if decoded else [])], made, text)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of ``ids`` (as ``encode`` gives them), special tokens kept; null gives an empty text."""
    path = path or default_path()
    k = df.columns.index(ids)

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([codec(path).decode(x or b"") for x in batch.column(k).to_pylist()], pa.string())]

    return _passed(df, [(text, "string")], made, ids)
