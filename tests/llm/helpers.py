"""Small hand-made documents with everything odd in them, and brute-force versions of the operators."""

import collections
import hashlib
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, block long, node long, sha string, ids string, size int, "
          "target string, shuffle int, label string, cluster int, answer string, token_ids int, n_tokens int, g string, id string")


def odd_docs():
    """(doc_id, text, lang, source): nulls, empty, blank, short, long, equal, nearly equal, repeated rows."""
    base = " ".join(f"word{k % 37} and{k % 11} the{k % 5}" for k in range(120))
    near = base.replace("word7 ", "changed ", 1)
    passage = "this passage of well over fifty bytes is found in several of the documents here "
    rows = [
        (1, base, "en", "a"), (2, base.replace(" ", "\n\t "), "en", "a"), (3, near, "en", "b"), (4, near + " tail", "en", None),
        (5, None, None, None), (6, "", "en", "a"), (7, " \n\t ", "de", "a"), (8, "A", "en", "b"), (9, "a", None, "b"), (10, "a b", "en", "a"),
        (11, "Wort " * 30 + passage, "de", "c"), (12, passage + "xyz", "de", "c"), (13, "q" + passage, None, "a"), (14, "é" * 60, "fr", "a"),
        (15, "x" + "é" * 60, "fr", "a"), (16, "der die das und nicht ein eine " * 3000, "de", "a"), (17, "12 34 !!", "en", "d"),
        (18, "ab" * 120, "en", "a"), (19, "ab" * 119 + "c", "en", "b"), (20, base, "en", "a"), (20, base, "en", "a"),
        (None, base, "en", "a"), (None, None, None, None), (21, "<|endoftext|> and  two  spaces ", "en", "a"),
    ]
    return rows


def docs_frame(spark, rows=None):
    rows = odd_docs() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "s", "i", 3, "t", 4, "l", 5, "a", 6, 7, "g", "x") for r in rows], SCHEMA)


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def component_ids(rows, width, percent):
    """Smallest id reachable for every row, by comparing all pairs; a null id counts as largest."""
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    group = collections.defaultdict(list)
    for k, r in enumerate(rows):
        group[find(k)].append(r[0])
    least = {k: min((x for x in ids if x is not None), default=None) for k, ids in group.items()}
    return [(r[0], len(sets[k]), least[find(k)]) for k, r in enumerate(rows)]


def without_repeats(rows, size=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    big = 1 << 62
    texts = [(big if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - size + 1):
            first[t[p : p + size]] = min(i, first.get(t[p : p + size], big))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((None if i == big else i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)
