"""Plain single-process forms of the operators, for comparison."""

import hashlib
import re

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, shingle=3):
    words = SPACE.findall(lower(text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=2):
    """doc_id -> smallest id reachable, for {doc_id: fingerprint}."""
    found = {}
    for start in sorted(prints):
        if start in found:
            continue
        found[start], todo = start, [start]
        while todo:
            own = prints[todo.pop()]
            for other in prints:
                if other not in found and bin(own ^ prints[other]).count("1") <= distance:
                    found[other] = start
                    todo.append(other)
    return found


def substrings(texts, window):
    """doc_id -> (words, kept words), for {doc_id: text}."""
    words = {i: SPACE.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def contamination(text, items, span=13, share=20):
    """(words, hit words, item ids, contaminated) of a text, for [(id, text)]."""
    words, hit, names = ALNUM.findall(lower(text)), set(), set()
    for name, item in items:
        own = ALNUM.findall(lower(item))
        n = min(span, len(own))
        windows = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)} if n else set()
        for j in range(len(words) - n + 1):
            if tuple(words[j : j + n]) in windows:
                names.add(str(name))
                hit.update(range(j, j + n))
    return len(words), len(hit), sorted(names), bool(hit) and share * len(hit) >= len(words)


def lines(texts, window=3):
    """doc_id -> text without later windows, for {doc_id: text}."""
    seen, gone = set(), {}
    for i in sorted(texts):
        own = (texts[i] or "").split("\n")
        for j in range(len(own) - window + 1):
            run = tuple(own[j : j + window])
            if not "".join(run).strip(" "):
                continue
            if run in seen:
                gone.setdefault(i, set()).update(range(j, j + window))
            seen.add(run)
    return {
        i: t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()
    }


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]
