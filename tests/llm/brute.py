"""Plain versions of the operators, one document at a time."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEPS = "\x20\x09\x0a\x0b\x0c\x0d"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def counts(t):
    t = t or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if c[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in t), dup, len(covered)


def shingles(t):
    w = WORD.findall((t or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def jaccard(rows):
    """(id, text) rows to {id: (n_shingles, n_similar, component_id)}; ids are distinct."""
    s = {i: shingles(t) for i, t in rows}
    near = {i: set() for i in s}
    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                both = len(s[a] & s[b])
                if 100 * both >= 70 * (len(s[a]) + len(s[b]) - both):
                    near[a].add(b)
                    near[b].add(a)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += near[x]
    return {i: (len(s[i]), len(near[i]), comp[i]) for i in ids}


def kept_lines(rows):
    """(id, text) rows to {id: (lines, dropped, rest)}."""
    key = lambda line: line.strip(SEPS).translate(FOLD)
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 10:
                held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        rest = [x for x in lines if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(rest), "\n".join(rest))
    return out
