"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text, lower=True):
    raw = (text or "").encode()
    return WORD.findall(raw.translate(LOWER) if lower else raw)


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, percent=75):
    """{id: (set size, smallest id reachable)}"""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def later_lines(docs, percent=80, least=4):
    """{id: numbers of the lines with a similar earlier line}. Lines are compared with those that share a word, by counting shared words."""
    sets, by_word, equal, out = [], defaultdict(list), set(), defaultdict(list)
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if len(s) < least:
                continue
            if s in equal:
                out[i].append(k)
                continue
            common = Counter(n for w in s for n in by_word[w])
            if any(100 * c >= percent * (len(s) + len(sets[n]) - c) for n, c in common.items()):
                out[i].append(k)
            for w in s:
                by_word[w].append(len(sets))
            sets.append(s)
            equal.add(s)
    return out


def later_units(docs, unit, run_words):
    """{id: (units with a word, removed units, their spans, text that is left)}"""
    parted = {"line": r"(?<=\n)", "paragraph": r"(?<=\n\n)", "sentence": r"(?<=\n)|(?<=[.!?][ \t])"}[unit]
    seen, out = set(), {}
    for i, t in sorted(docs):
        at, run, runs, gone, left, n = 0, [], [], [], [], 0
        for piece in re.split(parted, t or ""):
            key = tuple(words(piece))
            if key:
                n += 1
                if key in seen:
                    run.append((at, at + len(piece), len(key)))
                else:
                    runs.append(run)
                    run = []
                seen.add(key)
            at += len(piece)
        for r in [*runs, run]:
            if sum(w for *_, w in r) >= run_words:
                gone += [(a, b) for a, b, _ in r]
        at = 0
        for a, b in gone:
            left.append((t or "")[at:a])
            at = b
        out[i] = n, len(gone), ",".join(f"{a}-{b}" for a, b in gone), "".join(left) + (t or "")[at:]
    return out


def repeats(docs, length=100):
    """{id: (bytes, removed, spans, digest of the rest)}"""
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def tile_coverage(doc, item, least=5):
    """Greedy string tiling: the longest common free run, by a table of common suffix lengths, is marked until none is long enough; ties by the earliest start in doc, then in item."""
    a, b = words(doc), words(item)
    least = max(1, min(least, len(b)))
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    where = defaultdict(list)
    for j, w in enumerate(b):
        where[w].append(j)
    while b:
        best, above = (0, 0, 0), {}
        for i, w in enumerate(a):
            row = {j: above.get(j - 1, 0) + 1 for j in where.get(w, ()) if free_a[i] and free_b[j]}
            for j, n in row.items():
                best = min(best, (-n, i - n + 1, j - n + 1))
            above = row
        n, i, j = -best[0], best[1], best[2]
        if n < least:
            break
        covered += n
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
    return covered / len(b) if b else 0.0


def covered(doc, item, share=0.5, least=5):
    """Does tiling cover the share? First whether enough words of the item are in the document at all, which is cheap."""
    a, b = set(words(doc)), words(item)
    return bool(b) and sum(w in a for w in b) >= share * len(b) and tile_coverage(doc, item, least) >= share
