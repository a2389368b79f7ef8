"""Substring de-duplication: bytes of repeated ``size``-byte strings are removed from all but the first document.

A byte goes if a string of ``size`` bytes that covers it also starts in a document
with a smaller doc_id. Where strings start is found by a suffix sort of the
places that can matter:

1. Anchors. Each string is found by its *anchor*, the position of the smallest
   hash among its ``GRAM``-byte substrings (leftmost of equals), so equal strings
   have the same anchor at the same offset, and only every 14th position or so is
   one. The blocks exchange two hashes of every anchor (Golomb-coded), one for
   each half of its strings, and learn which occur elsewhere.
2. Suffixes. Those anchors go to owners with the bytes that their strings cover,
   one entry for each different context of a block, under its smallest doc_id. An
   owner sorts the suffixes from the anchors, and the reversed prefixes before
   them, by mergesort; two are compared by their longest common extension, found
   by binary search over prefix polynomial hashes, and the byte behind it. Common
   extensions of neighbours are verified on the bytes. Strings of the same
   offset are equal where both extensions are long enough; the smallest doc_id
   of each is compared with the entry's.
3. Answers. One bit for each string of an entry returns to its block, which marks
   the covered bytes.

An anchor's half that ``HOT`` or more blocks send (a passage of a great part of all
documents) is split: each of its strings is an entry by itself and goes to an
owner by its own hash, so copies fall together in their block before they are sent.

Null texts count as empty; texts shorter than ``size`` lose nothing. Rows with
the same doc_id are no smaller than each other, so they do not remove each
other's bytes. A null doc_id is larger than any other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, Block, pack, raw_bytes, rows_of
from .exchange import marked, shared, with_answers
from .hashing import BYTE, MULT, Prefixes, mix, powers

GRAM, HOT, OWNER_ANCHORS = 24, 128, 200_000


class Anchors:
    """Anchors of a block's strings: position, first and last start of the strings that it stands for, document."""

    def __init__(self, b: Block, size: int):
        self.size, self.block = size, b
        raw = b.bytes()
        self.raw = raw
        self.prefixes = Prefixes(raw)
        grams = self.prefixes.windows(GRAM)
        reach = size - GRAM + 1
        if len(raw) < size:
            self.at = self.low = self.high = self.doc = np.empty(0, np.int64)
            self.hash = np.empty(0, np.uint64)
            return
        # 32 bits of hash in a block of any length, so equal strings have the same order of grams everywhere
        place = np.uint64((1 << 32) - 1)
        v = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            v = np.minimum(v[: len(v) - width], v[width:])
            width *= 2
        if reach > width:
            v = np.minimum(v[: len(v) - (reach - width)], v[reach - width :])
        # v[p]: anchor of the string at p; strings that cross a document's end do not exist
        doc = b.doc_of()
        start = np.flatnonzero(doc[: len(v)] == doc[size - 1 : size - 1 + len(v)])
        at = (v[start] & place).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        self.at, self.low = at[first], start[first]
        self.high = start[np.append(first[1:], len(start)) - 1] if len(start) else start
        self.hash, self.doc = grams[self.at], doc[self.at].astype(np.int64)

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, left half?, print): a print for an anchor's strings of small offset, and one for those of large.

        A string holds the anchor's gram and at least half of what it has besides on one side, so a print of that
        longer piece says more than the gram alone, and equal strings still share it.
        """
        mid = (self.size - GRAM) // 2
        right, left = np.flatnonzero(self.at - self.high <= mid), np.flatnonzero(self.at - self.low > mid)
        at_r, at_l = self.at[right], self.at[left]
        return (np.concatenate([right, left]), np.repeat([False, True], [len(right), len(left)]), np.concatenate(
            [mix(self.prefixes.spans(at_r, at_r + GRAM + mid)), mix(self.prefixes.spans(at_l - mid - 1, at_l + GRAM) ^ np.uint64(MULT))]))

    def prints(self) -> np.ndarray:
        v = np.sort(self.halves()[2])
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        return v[new]

    def entries(self, answer):
        """The block's entries. Returns (anchor hash, offset of the first string, of the last, context start, key that deals it out,
        document id, entry of each use, use's first string, use's last, use's document)."""
        anchor, is_left, half = self.halves()
        uniq, inv = np.unique(half, return_inverse=True)
        ids = self.block.ids[self.doc[anchor]] if len(anchor) else np.empty(0, np.int64)
        least = np.full(len(uniq), NO_ID)
        most = np.full(len(uniq), -NO_ID - 1)
        np.minimum.at(least, inv, ids)
        np.maximum.at(most, inv, ids)
        hit, hot = least < most, np.zeros(len(uniq), bool)
        if answer:
            hit, hot = hit | marked(answer), marked(answer, "hot")
        hit_by, hot_by = np.zeros((2, len(self.at)), bool), np.zeros((2, len(self.at)), bool)
        hit_by[is_left.astype(int), anchor], hot_by[is_left.astype(int), anchor] = hit[inv], hot[inv] & hit[inv]
        mid = (self.size - GRAM) // 2
        whole = hit_by.all(0) & ~hot_by.any(0)
        uses = [(np.flatnonzero(whole), self.low, self.high, False)]
        for side, (first, last) in enumerate(((np.maximum(self.low, self.at - mid), self.high), (self.low, np.minimum(self.high, self.at - mid - 1)))):
            uses += [(np.flatnonzero(hit_by[side] & ~hot_by[side] & ~whole), first, last, False), (np.flatnonzero(hot_by[side]), first, last, True)]
        take = np.concatenate([k for k, *_ in uses])
        low, high = np.concatenate([f[k] for k, f, *_ in uses]), np.concatenate([x[k] for k, _, x, _ in uses])
        is_hot = np.concatenate([np.full(len(k), z) for k, *_, z in uses])
        at, doc, h = self.at[take], self.doc[take], self.hash[take]
        if is_hot.any():  # one use for each string
            n = np.where(is_hot, high - low + 1, 1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            low, high, at, doc, h, is_hot = (np.repeat(x, n) for x in (low, high, at, doc, h, is_hot))
            low = np.where(is_hot, low + step, low)
            high = np.where(is_hot, low, high)
        text = self.prefixes.spans(low, high + self.size)
        key = mix(mix(text * np.uint64(MULT) + (at - low).astype(np.uint64)) + (high - low).astype(np.uint64))
        deal = np.where(is_hot, key, h)
        order = np.lexsort((self.block.ids[doc], key)) if len(key) else np.empty(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rep = order[new]  # smallest id of each context
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        # the 64-bit keys are checked on the bytes; a use that differs from its entry is an entry of its own
        odd = [k for k in np.flatnonzero(rep[entry] != np.arange(len(entry))) if not self._same(k, rep[entry[k]], low, high, at)]
        for k in odd:
            entry[k] = len(rep)
            rep = np.append(rep, k)
        return h[rep], at[rep] - high[rep], at[rep] - low[rep], low[rep], deal[rep], self.block.ids[doc[rep]], entry, low, high, doc

    def _same(self, k, j, low, high, at) -> bool:
        return at[k] - low[k] == at[j] - low[j] and high[k] - low[k] == high[j] - low[j] and \
            self.block.raw[low[k] : high[k] + self.size] == self.block.raw[low[j] : high[j] + self.size]


def extension(table: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common prefix of rows i and j, by binary search over prefix hashes (``table``: row x length)."""
    low, high = np.zeros(len(i), np.int64), np.minimum(sizes[i], sizes[j])
    flat, i, j = table.ravel(), i * table.shape[1], j * table.shape[1]
    while (low < high).any():
        mid = (low + high + 1) >> 1  # low itself where nothing is left to search
        same = flat.take(i + mid) == flat.take(j + mid)
        low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
    return low


def suffix_sort(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows within their groups (rows come grouped), and each one's common prefix with the one before (-1: first).

    Bottom-up mergesort of all groups at once: an element's place in a merged run is its place in its own run plus the
    number of elements of the other run before it, by binary search.
    """
    n = len(rows)
    table = np.zeros((n, rows.shape[1] + 1), np.uint64)
    part = BYTE[rows]
    part *= powers(rows.shape[1])[0][: rows.shape[1]]
    np.cumsum(part, axis=1, out=table[:, 1:])
    del part
    padded = np.zeros((n, rows.shape[1] + 1), np.int16)  # 0 ends a row, a byte counts one more
    padded[:, :-1] = np.where(np.arange(rows.shape[1]) < sizes[:, None], rows.astype(np.int16) + 1, 0)

    def before(i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Row i comes before row j (``ties``: also if equal)."""
        at = extension(table, sizes, i, j)
        a, b = padded[i, at], padded[j, at]
        return (a < b) | (ties & (a == b))

    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    count = np.diff(np.append(first, n))
    begin, size = np.repeat(first, count), np.repeat(count, count)
    order, width = np.arange(n), 1
    while n and width < count.max():
        pos = np.flatnonzero(size > width)  # places whose group still has two runs
        local = pos - begin[pos]
        run = local // width
        other = (run ^ 1) * width
        low = np.minimum(other, size[pos])
        base, high = low.copy(), np.minimum(other + width, size[pos])
        right = run & 1 == 1  # elements of a right run come behind equals of the left one
        while True:
            live = low < high
            if not live.any():
                break
            mid = (low + high) >> 1
            k = np.flatnonzero(live)
            ahead = np.zeros(len(pos), bool)
            ahead[k] = before(order[begin[pos[k]] + mid[k]], order[pos[k]], right[k])
            low, high = np.where(live & ahead, mid + 1, low), np.where(live & ~ahead, mid, high)
        to = begin[pos] + (run & ~1) * width + local % width + (low - base)
        merged = order.copy()
        merged[to] = order[pos]
        order, width = merged, 2 * width
    common = np.full(n, -1)
    inner = np.flatnonzero(np.arange(n) != begin)
    i, j = order[inner - 1], order[inner]
    common[inner] = extension(table, sizes, i, j)
    # verification: neighbours must be equal just so far, and in order
    unequal = padded[i] != padded[j]
    true = np.where(unequal.any(1), unequal.argmax(1), np.minimum(sizes[i], sizes[j]))
    if (true != common[inner]).any() or (padded[i, true] > padded[j, true]).any():  # a hash collision: sort those bytes themselves
        raw = [bytes(r[:s]) for r, s in zip(rows, sizes)]
        order = np.array(sorted(range(n), key=lambda k: (begin[k], raw[k])), np.int64)
        i, j = order[inner - 1], order[inner]
        unequal = padded[i] != padded[j]
        common[inner] = np.where(unequal.any(1), unequal.argmax(1), np.minimum(sizes[i], sizes[j]))
    return order, common


def alike(first, last, ids, context) -> np.ndarray:
    """For each entry the one of smallest id among those of the same strings: hashes are sorted, then compared on the bytes."""
    n, wide = context.shape
    words = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    words[:, :wide] = context
    key = mix(first.astype(np.uint64) << np.uint64(8) | last.astype(np.uint64))
    for word in words.view(np.uint64).T:
        key = mix(key * np.uint64(MULT) + word)
    order = np.lexsort((ids, key))
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    least = np.empty(n, np.int64)
    least[order] = order[new][np.cumsum(new) - 1]
    differs = (first != first[least]) | (last != last[least]) | (context != context[least]).any(1)
    return np.where(differs, np.arange(n), least)


def seen_before(h, first, last, ids, context, size: int) -> np.ndarray:
    """A mask for each entry: bit o is set if its string at offset ``first + o`` before the anchor starts in a document of smaller id.

    ``context``: row x (size + size - GRAM) bytes, from the entry's first string on, zeros behind its last. Of entries
    of the same strings only that of smallest id is sorted; all strings of one with a larger id start there as well.
    """
    least = alike(first, last, ids, context)
    k = np.flatnonzero(least == np.arange(len(least)))
    mask = np.empty(len(least), np.uint64)
    mask[k] = _seen_before(h[k], first[k], last[k], ids[k], context[k], size)
    full = (np.uint64(1) << (last - first + 1).astype(np.uint64)) - np.uint64(1)
    return np.where(ids > ids[least], full, mask[least])


def _seen_before(h, first, last, ids, context, size: int) -> np.ndarray:
    n = len(h)
    order = np.argsort(h, kind="stable")
    h, first, last, ids, context = h[order], first[order], last[order], ids[order], context[order]
    group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
    row = np.arange(n, dtype=np.int32)[:, None]
    # right of the anchor: up to the end of the string that starts last; left of it, reversed
    right_size, left_size = size - first, last
    behind = last.astype(np.int32)[:, None]
    col = np.minimum(behind + np.arange(size, dtype=np.int32), context.shape[1] - 1)
    right = np.where(np.arange(size) < right_size[:, None], context[row, col], 0).astype(np.uint8)
    del col
    most = max(1, int(last.max()))
    left = np.where(np.arange(most) < left_size[:, None], context[row, np.maximum(behind - 1 - np.arange(most, dtype=np.int32), 0)], 0).astype(np.uint8)
    by_right, common_right = suffix_sort(right, right_size, group)
    by_left, common_left = suffix_sort(left, left_size, group)
    mask = np.zeros(n, np.uint64)
    for o in range(int(first.min()), int(last.max()) + 1):
        have = (first <= o) & (o <= last)
        k = np.flatnonzero(have)
        if len(k) < 2:
            continue
        # equal strings: as long a common part on either side of the anchor
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[by_right] = np.cumsum(common_right < size - o)
        b[by_left] = np.cumsum(common_left < o)
        key = a[k] * (n + 1) + b[k]
        s = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[s][1:] != key[s][:-1]])
        least = np.minimum.reduceat(ids[k][s], start)
        reps = np.repeat(least, np.diff(np.append(start, len(s))))
        later = k[s][ids[k][s] > reps]
        mask[later] |= np.uint64(1) << (o - first[later]).astype(np.uint64)
    out = np.empty(n, np.uint64)
    out[order] = mask
    return out


def repeated(docs: DataFrame, size: int = 50, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 1 << 20, hot: int = HOT,
             with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row (and ``kept``, the remaining bytes)."""
    assert GRAM < size < GRAM + 64
    blocks = pack(docs, text, doc_id, block_bytes)
    total = raw_bytes(blocks)
    wide = 2 * size - GRAM

    def prints(row: dict) -> np.ndarray:
        return Anchors(Block(row["ids"], row["sizes"], row["data"]), size).prints()

    answers = shared(blocks, prints, 4 * total // (size - GRAM + 2), hot=hot)
    asked = with_answers(blocks, answers)
    owners = max(1, ceil(total / (size - GRAM + 2) / OWNER_ANCHORS))

    def dealt(deal: np.ndarray) -> np.ndarray:
        return ((mix(deal) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                anchors = Anchors(Block(row["ids"], row["sizes"], row["data"]), size)
                h, first, last, begin, deal, ids, *_ = anchors.entries(row["answer"])
                raw = np.append(anchors.raw, np.zeros(wide, np.uint8))
                owner = dealt(deal)
                order = np.argsort(owner, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if len(order) else []
                for k in np.split(order, cut[1:]) if len(order) else []:
                    context = raw[begin[k][:, None] + np.arange(wide)]
                    context = context[np.arange(wide) < (last - first)[k][:, None] + size]  # end to end
                    least = int(ids[k].min())
                    kind = np.min_scalar_type(int(ids[k].max()) - least)
                    body = b"".join([(ids[k] - least).astype(kind).tobytes(), first[k].astype(np.uint8).tobytes(), last[k].astype(np.uint8).tobytes(), context.tobytes()])
                    yield pa.record_batch([pa.array([int(owner[k[0]])], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([len(k)], pa.int32()),
                                           pa.array([least], pa.int64()), pa.array([kind.itemsize], pa.int32()), pa.array([len(body)], pa.int32()),
                                           pa.array([pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)], pa.binary())],
                                          names=["owner", "block", "n", "least", "width", "raw", "body"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for n, least, width, length, body in zip(*(pdf[c].tolist() for c in ("n", "least", "width", "raw", "body"))):
            raw = np.frombuffer(pa.Codec("zstd").decompress(body, length, asbytes=True), np.uint8)
            cut = np.cumsum([0, width * n, n, n])
            p = [raw[a:b] for a, b in zip(cut, cut[1:])]
            parts.append((p[0].view(f"<u{width}").astype(np.int64) + least, p[1].astype(np.int64), p[2].astype(np.int64), raw[cut[-1] :]))
        ids, first, last, flat = (np.concatenate(x) for x in zip(*parts))
        used = last - first + size
        begin = np.cumsum(used) - used
        h = mix(Prefixes(flat).spans(begin + last, begin + last + GRAM))  # the anchor's hash
        flat = np.append(flat, np.zeros(wide, np.uint8))
        context = flat[begin[:, None] + np.arange(wide)]
        context[np.arange(wide) >= used[:, None]] = 0
        mask = seen_before(h, first, last, ids, context, size)
        ends = np.cumsum(pdf["n"].to_numpy())
        return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "masks": [mask[e - n : e].astype("<u4" if size - GRAM < 32 else "<u8").tobytes() for e, n in zip(ends, pdf["n"])]})

    lists = asked.mapInArrow(send, "owner int, block long, n int, least long, width int, raw int, body binary")
    masks = lists.groupBy("owner").applyInPandas(answer, "block long, owner int, masks binary")
    masks = masks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("owner", "masks"))).alias("answer"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row["ids"], row["sizes"], row["data"])
                anchors = Anchors(b, size)
                _, first, last, _, deal, least, entry, low, high, doc = anchors.entries(row["answer"])
                mask = np.empty(len(deal), np.uint64)
                got = [np.frombuffer(a["masks"], "<u4" if size - GRAM < 32 else "<u8") for a in row["masks"] or ()]
                mask[np.argsort(dealt(deal), kind="stable")] = np.concatenate(got) if got else np.empty(0, np.uint64)
                # a use of larger id than its entry's: all its strings; else those that the owner marked
                full = (np.uint64(1) << (high - low + 1).astype(np.uint64)) - np.uint64(1)
                use = np.where(b.ids[doc] > least[entry], full, mask[entry])
                delta = np.zeros(len(b.raw) + 1, np.int64)
                for o in range(size - GRAM + 1):
                    p = high[(use >> np.uint64(o)) & np.uint64(1) == 1] - o
                    np.add.at(delta, p, 1)
                    np.add.at(delta, p + size, -1)
                gone = np.cumsum(delta[:-1]) > 0
                upto = np.append(0, np.cumsum(gone))
                removed = upto[b.ends] - upto[b.starts]
                spans, shas, kept = [], [], []
                for k, (s, e) in enumerate(zip(b.starts.tolist(), b.ends.tolist())):
                    if removed[k]:
                        part = gone[s:e]
                        spans.append(int(part[0]) + int((part[1:] & ~part[:-1]).sum()))
                        rest = anchors.raw[s:e][~part].tobytes()
                    else:
                        spans.append(0)
                        rest = b.raw[s:e]
                    shas.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest if with_text else None)
                yield pa.record_batch([pa.array(b.ids), pa.array(b.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())],
                                      names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = with_answers(asked, masks, "masks").mapInArrow(apply, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
