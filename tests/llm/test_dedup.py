import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from pricelab.llm import components, exactdedup, exchange, neardup, substring

from .helpers import SCHEMA, component_ids, docs_frame, key, normalised, odd_docs, without_repeats


@pytest.mark.parametrize("bits", [16, 40, 63])
def test_rice_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 2, 7, 1000):
        base = int(rng.integers(0, 1 << (bits - 2)))
        v = np.sort(rng.integers(base, 1 << bits, n, dtype=np.uint64))
        k, code = exchange.rice_encode(v, base)
        assert (exchange.rice_decode(code, n, k, base) == v).all()
    v = np.arange(500, dtype=np.uint64) // np.uint64(3)  # equal and adjacent values
    k, code = exchange.rice_encode(v, 0)
    assert (exchange.rice_decode(code, len(v), k, 0) == v).all()


def test_exchange_marks_what_occurs_in_two_blocks(spark):
    rng = np.random.default_rng(1)
    blocks = [np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64)) for _ in range(6)]
    blocks[3] = np.unique(np.concatenate([blocks[3], blocks[0][::7], blocks[5][:5]]))
    df = spark.createDataFrame([(k, bytearray(b.tobytes())) for k, b in enumerate(blocks)], "block long, prints binary")
    got = {r["block"]: r["answer"] for r in exchange.shared(df, lambda r: np.frombuffer(r["prints"], np.uint64), 2000, owner_share=300, hot=3).collect()}
    count = collections.Counter(x for b in blocks for x in b.tolist())
    for k, b in enumerate(blocks):
        assert exchange.marked(got[k]).tolist() == [count[x] > 1 for x in b.tolist()]
        assert exchange.marked(got[k], "hot").tolist() == [count[x] > 2 for x in b.tolist()]


def test_exact(spark):
    rows = odd_docs()
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exactdedup.decide(docs_frame(spark), block_bytes=3000).collect()), key=key)
    group = collections.defaultdict(list)
    for r in rows:
        group[normalised(r[1])].append(r[0])
    want = []
    for r in rows:
        ids = group[normalised(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(normalised(r[1]).encode()).hexdigest()))
    assert got == sorted(want, key=key)
    kept = exactdedup.deduplicated(docs_frame(spark))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] != 20) == sorted({w[0] for w in want if w[3]} - {None})
    assert exactdedup.decide(docs_frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Copies with equal and null ids, and ids repeated with other texts."""
    text = {x: " ".join(f"{x}{k}" for k in range(60)) for x in "abcde"}
    ids = [(1, "a"), (1, "a"), (None, "a"), (1, "b"), (0, "b"), (None, "c"), (None, "c"), (None, "d"), (2, "e"), (2, "e"), (3, "e")]
    rows = [(i, text[t], "en", "a") for i, t in ids]
    want = sorted([(1, text["a"]), (0, text["b"]), (None, text["c"]), (None, text["d"]), (2, text["e"])], key=key)
    for df in (exactdedup.deduplicated(docs_frame(spark, rows)), neardup.one_of_each(docs_frame(spark, rows))):
        assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key) == want
    near = [(i, text[t] + (" more" if k % 2 else ""), "en", "a") for k, (i, t) in enumerate(ids)] + [(None, None, None, None), (None, "", None, None)]
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in neardup.one_of_each(docs_frame(spark, near)).collect()]
    assert sorted(got, key=key) == sorted([(1, "a"), (0, "b"), (None, "c"), (None, "d"), (2, "e"), (None, ""), (None, "")], key=key)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 50)])
def test_near(spark, words, percent):
    rows = odd_docs()
    got = [tuple(r) for r in neardup.near_duplicates(docs_frame(spark), words, percent, block_bytes=3000).collect()]
    assert sorted(got, key=key) == sorted(component_ids(rows, words, percent), key=key)


def test_near_random_edits(spark, monkeypatch):
    """Groups of edited copies, verified slot by slot, against all pairs."""
    monkeypatch.setattr(neardup, "SLOT", 7)
    rng, rows = random.Random(3), []
    for g in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((4, 9, 40, 200)))]
        for _ in range(15):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t), "en", "a"))
    got = [tuple(r) for r in neardup.near_duplicates(docs_frame(spark, rows), 3, 90, block_bytes=5000).collect()]
    assert sorted(got) == sorted(component_ids(rows, 3, 90))


def test_links_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLOT", 40)
    made, links = [], neardup._links

    def counted(tiles, sets, percent, **how):
        out = links(tiles, sets, percent, **how)
        made.append((tiles.count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "_links", counted)
    sums = []
    for n in (150, 600):
        rng, rows = random.Random(n), []
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for k in range(n):  # each with two words of its own
            t = list(base)
            for _ in range(2):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append((k, " ".join(t), "en", "a"))
        made.clear()
        got = neardup.near_duplicates(docs_frame(spark, rows), 3, 90, block_bytes=20_000).collect()
        assert {r["component_id"] for r in got} == {0}
        sums.append([sum(x) for x in zip(*made)])
    assert sums[1][0] <= 5 * sums[0][0] and sums[1][1] <= 5 * sums[0][1] and sums[1][1] < 2 * 600  # 4 times the documents


def test_near_empty(spark):
    assert neardup.near_duplicates(docs_frame(spark, [])).count() == 0
    got = neardup.near_duplicates(docs_frame(spark, [(1, None, None, None), (2, " ", None, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_pigeonhole_holds_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 90):
        levels = neardup.Levels(percent, 3000)
        for size in (1, 2, 3, 5, 9, 17, 40, 300, 2000):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
                b = a.copy()
                for _ in range(200):  # change while still linked
                    c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.append(b, rng.integers(0, 1 << 64, dtype=np.uint64))
                    if not neardup.linked(len(a), len(c), len(np.intersect1d(a, c)), percent):
                        break
                    b = np.unique(c)
                sets = [a, b]
                count = np.array([len(s) for s in sets])
                doc, k = levels.keys(np.repeat([0, 1], count), np.concatenate(sets), count)
                assert set(k[doc == 0].tolist()) & set(k[doc == 1].tolist())


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (5, 4), (30, 30)] + [(100, k) for k in range(101, 140)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5), 1), 7: 7, 8: 7, 9: 7, 20: 20, 21: 20, **dict.fromkeys(range(100, 140), 100)}


@pytest.mark.parametrize("block_bytes,hot", [(2 << 20, 128), (2000, 128), (500, 2)])
def test_substrings(spark, block_bytes, hot):
    rows = odd_docs()
    got = [tuple(r) for r in substring.repeated(docs_frame(spark), block_bytes=block_bytes, hot=hot).collect()]
    assert sorted(got, key=key) == sorted(without_repeats(rows), key=key)
    assert substring.repeated(docs_frame(spark, [])).count() == 0


def test_suffix_sort_is_the_order_of_the_bytes():
    rng = np.random.default_rng(2)
    n = 400
    rows = rng.integers(97, 99, (n, 12)).astype(np.uint8)
    sizes = rng.integers(0, 13, n)
    rows[np.arange(12) >= sizes[:, None]] = 0
    group = np.sort(rng.integers(0, 20, n))
    order, common = substring.suffix_sort(rows, sizes, group)
    text = [bytes(r[:s]) for r, s in zip(rows, sizes)]
    assert [(group[k], text[k]) for k in order] == sorted((g, t) for g, t in zip(group, text))
    for x, y, c in zip(order, order[1:], common[1:]):
        if group[x] == group[y]:
            assert text[x][:c] == text[y][:c] and (c == min(len(text[x]), len(text[y])) or text[x][c] != text[y][c])
        else:
            assert c == -1


def test_suffix_sort_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(substring, "BYTE", np.zeros(256, np.uint64))
    rows = np.frombuffer(b"bbaaabab", np.uint8).reshape(4, 2)
    order, common = substring.suffix_sort(rows, np.full(4, 2), np.zeros(4, np.int64))
    assert [bytes(rows[k]) for k in order] == [b"aa", b"ab", b"ab", b"bb"] and common.tolist() == [-1, 1, 2, 0]


@pytest.mark.parametrize("collide", [False, True])
def test_strings_seen_before_equal_brute_force(monkeypatch, collide):
    """Entries of equal strings are merged before the sort; with colliding hashes each is sorted by itself."""
    rng = np.random.default_rng(3)
    size, n = 50, 300
    wide = 2 * size - substring.GRAM
    grams = rng.integers(97, 99, (4, substring.GRAM)).astype(np.uint8)
    h = rng.integers(0, 4, n)
    first = rng.integers(0, size - substring.GRAM + 1, n)
    last = np.minimum(first + rng.integers(0, 12, n), size - substring.GRAM)
    ids = rng.integers(0, 40, n)
    sides = rng.integers(97, 99, (3, 2 * wide)).astype(np.uint8)
    context = np.zeros((n, wide), np.uint8)
    for k in range(n):
        side = sides[rng.integers(0, 3)].copy()
        side[rng.integers(0, 2 * wide)] = 120
        whole = np.concatenate([side[:wide], grams[h[k]], side[wide:]])  # the gram starts at ``wide``
        context[k, : last[k] - first[k] + size] = whole[wide - last[k] : wide - first[k] + size]
    for c in (h, first, last, ids, context):
        c[n // 2 :] = c[: n - n // 2] if c is not ids else c[n // 2 :]  # half of the entries repeat the others' strings
    starts = {}
    for k in range(n):
        for o in range(first[k], last[k] + 1):
            at = last[k] - o
            starts.setdefault((h[k], o, bytes(context[k, at : at + size])), []).append(ids[k])
    expected = [sum(1 << int(o - first[k]) for o in range(first[k], last[k] + 1)
                    if min(starts[h[k], o, bytes(context[k, last[k] - o : last[k] - o + size])]) < ids[k]) for k in range(n)]
    if collide:
        monkeypatch.setattr(substring, "mix", lambda x: np.zeros(x.shape, np.uint64))
    assert substring.seen_before(h.astype(np.uint64), first, last, ids, context, size).tolist() == expected


def test_anchors_do_not_depend_on_the_block(monkeypatch):
    """Hashes that differ in low bits only: the anchors of a text are the same alone and within a block of any length."""
    windows = substring.Prefixes.windows
    monkeypatch.setattr(substring.Prefixes, "windows", lambda self, n: windows(self, n) & np.uint64((1 << 30) - 1))
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 300).astype(np.uint8).tobytes()
    found = []
    for before in (0, 5000, 3_000_000):
        data = rng.integers(97, 123, before).astype(np.uint8).tobytes() + text
        sizes = np.array([before, len(text)])
        b = substring.Block(np.array([1, 2]).tobytes(), sizes.tobytes(), substring.pa.Codec("zstd").compress(data, asbytes=True))
        a = substring.Anchors(b, 50)
        mine = a.doc == 1
        found.append([(x - before, y - before, z - before) for x, y, z in zip(a.at[mine].tolist(), a.low[mine].tolist(), a.high[mine].tolist())])
    assert found[0] == found[1] == found[2] and found[0]


def test_linked_pairs_share_the_keys_that_each_needs():
    """Sets below, at and above a band's border, changed while still linked, have the fewest shared keys in one level both are in."""
    rng = np.random.default_rng(11)
    for percent in (50, 80, 90):
        levels, most = neardup.Levels(percent, 10_000), 0
        for size in (1, 2, 5, 17, 60, 300, 1500, *(b + d for b in [b for b in levels.first if 2 < b < 3000][::4] for d in (-1, 0))):
            for grow in (0.0, 0.5, 1.0):
                a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
                b = a
                for step in (max(1, size // 20), 1):
                    while True:
                        new = rng.integers(0, 1 << 64, step, dtype=np.uint64)
                        c = np.append(b, new) if rng.random() < grow else np.append(np.delete(b, rng.choice(len(b), min(step, len(b)), replace=False)), new)
                        if not neardup.linked(len(a), len(c), len(np.intersect1d(a, c)), percent):
                            break
                        b = np.unique(c)
                count = np.array([len(a), len(b)])
                doc, key, side, need = levels.keyed(np.repeat([0, 1], count), np.concatenate([a, b]), count)
                band = np.searchsorted(levels.first, count, side="right") - 1
                ok = []
                for x in (0, 1):
                    for y in (0, 1):
                        if band[0] - x == band[1] - y:
                            both = len(np.intersect1d(key[(doc == 0) & (side == x)], key[(doc == 1) & (side == y)]))
                            ok.append(both >= need[x, 0] and both >= need[y, 1])
                assert any(ok)
                most = max(most, need.max())
        assert most > (20 if percent > 50 else 1)  # it binds on large sets


def test_a_common_passage_moves_no_sets(spark, monkeypatch):
    """Long texts that share a passage and nothing else are no suspects; near copies among them are."""
    seen, store = {}, neardup.stored

    def kept(df, name):
        out = store(df, name)
        if name == "suspects":
            seen[name] = out.count()
        return out

    monkeypatch.setattr(neardup, "stored", kept)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(45)]
    rows = [(k, " ".join([f"w{rng.randrange(10**7)}" for _ in range(700)] + passage + [f"w{rng.randrange(10**7)}" for _ in range(700)]), "en", "a") for k in range(60)]
    rows += [(100 + k, rows[k][1].replace(" p7 ", " changed "), "en", "a") for k in (3, 5)]
    got = [tuple(r) for r in neardup.near_duplicates(docs_frame(spark, rows), 5, 80, block_bytes=30_000).collect()]
    assert sorted(got) == sorted(component_ids(rows, 5, 80))
    assert 4 <= seen["suspects"] <= 8


def test_packing_lets_go_of_what_an_operator_before_kept(spark):
    """A worker that packs documents holds no model or codec of an earlier stage."""
    from pyspark.sql import functions as F

    from pricelab.llm import blocks, common

    @F.pandas_udf("long")
    def keep(s: "pd.Series") -> "pd.Series":
        common.held("test", "model", lambda: [0] * 1000)
        return s

    docs = docs_frame(spark, [(k, f"text {k}", "en", "a") for k in range(50)]).repartition(2)
    docs.select(keep("doc_id")).collect()
    held = blocks.pack(docs, extra=lambda b: {"held": str(len(common._HELD)).encode()}, extra_schema="held binary")
    assert {bytes(r["held"]) for r in held.collect()} == {b"0"}
