"""Plain restatements of what the operators must return, for small tables."""

import collections
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality_base(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered))


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids, roots=False):
    """Smallest id that each row reaches over fingerprints within 2 bits, or its group; null ids count as none."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    if roots:
        return [root(i) for i in range(len(prints))]
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


def repeated(texts, units, window):
    """Which units of each text lie in a window that starts at two places or more."""
    parts = [units(t) for t in texts]
    seen = collections.Counter(tuple(p[i:i + window]) for p in parts for i in range(len(p) - window + 1))
    out = []
    for p in parts:
        gone = np.zeros(len(p), bool)
        for i in range(len(p) - window + 1):
            if seen[tuple(p[i:i + window])] > 1:
                gone[i:i + window] = True
        out.append((p, gone))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
}


def personal(text):
    """(start, kind number, end) of the seeds, sorted."""
    found = []
    for number, (pattern, check) in enumerate(KINDS.values()):
        for m in re.finditer(pattern, text or ""):
            if check(m.group(), re.sub("[^0-9]", "", m.group())):
                found.append((m.start(), number, m.end()))
    return sorted(found)


def masked(text):
    names, out, at = [f"[{k.upper()}]" for k in KINDS], "", 0
    for start, kind, end in personal(text):
        if start >= at:
            out, at = out + text[at:start] + names[kind], end
        else:
            at = max(at, end)
    return out + text[at:]
