"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import random
import re

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def raw(text) -> bytes:
    return (text or "").encode()


def texts(seed: int = 3) -> list[tuple]:
    """(doc_id, text) rows with copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = [(i, words(rng.randint(30, 140))) for i in range(12)]
    rows.append((12, rows[3][1]))
    near = list(rows[4][1])
    near[len(near) // 2] = "changed"
    rows.append((13, near))
    rows.append((14, words(20) + rows[5][1][3:40] + words(15)))
    rows.append((15, rows[6][1][:25] + words(3) + rows[5][1][10:45]))
    rows.append((16, ["buy"] * 150))
    rows.append((17, words(5) + ["buy"] * 90 + words(5)))
    rows.append((18, words(2500) + rows[7][1] + ["spam", "ham"] * 60))
    rows.append((19, ["spam", "ham"] * 45))
    out = [(i, " ".join(w)) for i, w in rows]
    out += [(20, None), (21, ""), (22, " \t\n"), (23, "One"), (24, "one"), (25, "Ünï cödé çà Straße ünï"), (26, None)]
    out.append((5, out[5][1]))  # a repeated row
    out.append((None, out[3][1]))
    out.append((None, None))
    # The same words in other case and spacing.
    out.append((27, "\n" + out[8][1].upper().replace(" ", "  ")))
    return out


def shingles(text, k: int) -> frozenset:
    words = raw(text).translate(LOWER).split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def similar(rows, k: int, percent: int) -> list[tuple]:
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(a) + len(b) - both):
                group[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = doc if r not in least or least[r] is None else min(least[r], doc)
    return [(doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def words_kept(rows, window: int) -> list[tuple]:
    first: dict = {}
    for doc, text in rows:
        words = raw(text).split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = raw(text).split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def bytes_kept(rows, window: int) -> list[tuple]:
    seen: dict = {}
    for _, text in rows:
        for i in range(len(raw(text)) - window + 1):
            key = raw(text)[i : i + window]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for doc, text in rows:
        data = raw(text)
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if seen[data[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def passages(rows, items, size: int) -> list[tuple]:
    windows: dict = {}
    for item, text in items:
        words = ITEM_WORD.findall(raw(text).translate(LOWER))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in rows:
        words = ITEM_WORD.findall(raw(text).translate(LOWER))
        hit, found = [0] * len(words), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                if (key := tuple(words[i : i + length])) in windows:
                    found |= windows[key]
                    hit[i : i + length] = [1] * length
        out.append((doc, len(words), sum(hit), len(found), sha(",".join(sorted(found)).encode())))
    return out


def mixed(rows, weights=(3, 1, 2), share=1.5, epochs=2, seed="mix-1") -> list[tuple]:
    """Rows are (doc_id, text, source); returns (doc_id, size, source_size, target, taken)."""
    sized = [(doc, len(raw(text).split()), source) for doc, text, source in rows]
    names = sorted({s for *_, s in sized}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(n for _, n, x in sized if x == s) for s in names}
    target, open_, left = {}, list(names), share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > epochs * total[s]]
        for s in above or open_:
            target[s] = min(level * weight[s], epochs * total[s])
        left -= sum(target[s] for s in above)
        open_ = [s for s in open_ if s in above] and [s for s in open_ if s not in above]
    out = []
    for s in names:
        own = [(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest(), doc is not None, doc or 0, n) for doc, n, x in sized if x == s]
        budget = min(int(target[s] + 0.5), epochs * total[s])
        times, rest = divmod(budget, max(total[s], 1))
        for _, known, doc, n in sorted(own):
            part = min(max(rest, 0), n)
            rest -= n
            out.append((doc if known else None, n, total[s], target[s], times * n + part))
    return out
