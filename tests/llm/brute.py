"""Plain re-computations of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(texts: list[str | None], size: int = 35) -> list[tuple[int, int, str]]:
    words = [PLAIN.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def contamination(texts: list[str | None], items: list[tuple], size: int = 13) -> list[tuple[int, int, list[str], bool]]:
    windows: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        w = LETTERS.findall(low(text))
        if w and item is not None:
            for k in range(max(1, len(w) - size + 1)):
                windows[tuple(w[k : k + size])].add(str(item))
    out = []
    for text in texts:
        w = LETTERS.findall(low(text))
        hit, ids = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    ids |= windows[tuple(w[k : k + n])]
        out.append((len(w), sum(hit), sorted(ids), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def fingerprint(text: str | None, size: int = 3) -> int:
    w = PLAIN.findall(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def groups(n: int, linked) -> list[int]:
    """The smallest index that each index reaches."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def distance(a: tuple, b: tuple) -> int:
    """Edit distance of two runs of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines(docs: list[tuple], least: int = 5) -> dict[tuple, str | None]:
    """(id, text) to the text left, by comparing each line with all earlier ones."""
    key = lambda d: (d[0] is None, d[0] if d[0] is not None else 0)
    before: list[tuple] = []
    out = {}
    for i, text in sorted(set(docs), key=key):
        if text is None:
            out[i, text] = None
            continue
        kept, total, some = [], 0, 0
        for line in text.split("\n"):
            w = tuple(x for x in BLANK.split(line) if x)
            if not w:
                kept.append(line)
                continue
            total += 1
            same = any(w == b or max(len(w), len(b)) >= least and abs(len(w) - len(b)) <= 1 and distance(w, b) <= 1 for b in before)
            before.append(w)
            if not same:
                kept.append(line)
                some += 1
        out[i, text] = text if some == total else "\n".join(kept) if some else ""
    return out


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def private(text: str | None) -> list[tuple[str, int, int]]:
    def good(kind: str, m: str) -> bool:
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, form in FORMS.items() for m in re.finditer(form, text or "") if good(k, m.group())]


def chat_valid(roles: list[str]) -> bool:
    last = ""
    for role in roles:
        if role not in {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}.get(last, ()):
            return False
        last = role
    return last == "assistant"


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def merkle(rows: list[dict], changed: list[dict]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; rows of equal id by leaf."""

    def leaf(r: dict) -> str:
        return sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))

    def grow(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        """The top, and for each digest the siblings before and behind, level by level."""
        level, where, steps = digests, list(range(len(digests))), [[] for _ in digests]
        while len(level) > 1:
            for k, i in enumerate(where):
                low = i - i % 3
                steps[k].append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
            level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
            where = [i // 3 for i in where]
        return level[0], steps

    own, trees = [leaf(r) for r in rows], defaultdict(list)
    for k, r in enumerate(rows):
        trees[r["source"]].append(k)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for source in order:
        trees[source].sort(key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, own[k]))
        made[source] = grow([own[k] for k in trees[source]])
    root, over = grow([made[s][0] for s in order]) if order else ("", [])
    out = []
    for s, top_steps in zip(order, over):
        for k, steps in zip(trees[s], made[s][1]):
            folded = leaf(changed[k])
            for before, behind in steps + top_steps:
                folded = sha(before + folded + behind)
            proof = sha("".join(a + b for a, b in steps + top_steps))
            out.append((rows[k]["doc_id"], own[k], made[s][0], root, proof, folded, folded == root))
    return out


def plant(words: list[str], doc_id) -> list[str]:
    h, n = crc(doc_id), len(words)
    g = h // 10
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def periodic(words: list[str], least: int = 24, repeats: int = 3) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(start, length, period) of all runs by trying every lag, and the words left."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words], dtype=np.int64)
    found = []
    for q in range(1, len(x) // repeats + 1):
        same = np.concatenate(([False], x[q:] == x[:-q], [False]))
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = high - low + q
            part = x[low : low + length]
            if length >= max(least, repeats * q) and not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                found.append((low, length, q))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return sorted(found, key=lambda r: (r[0], r[2])), [w for i, w in enumerate(words) if i not in gone]
