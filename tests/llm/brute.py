"""Plain versions of what the operators compute, straight from their definitions."""

import hashlib
import re
from collections import defaultdict

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, percent):
    """Smallest reachable id of every (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            shared = len(x & y)
            if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i, _ in rows}


def contained(docs, items, percent=80):
    out = set()
    for item, text in items:
        w = words(text)
        n = min(5, len(w))
        if not n:
            continue
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for doc, body in docs:
            v = words(body)
            have = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            if 100 * len(wanted & have) >= percent * len(wanted):
                out.add((doc, item, len(wanted & have), len(wanted)))
    return out


def repeated_words(rows, least=50):
    """Positions of words inside windows that another document has too."""
    where = defaultdict(set)
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = defaultdict(set)
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                out[i].update(range(k, k + least))
    return dict(out)


def _sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


_ASSIGN = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text):
    t = text or ""
    found = {
        "assign": [m.span() for m in re.finditer(_ASSIGN, t, re.I | re.A) if len(m[2]) >= 6],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24],
    }
    kinds = list(found)
    spans = sorted(((k, *s) for k in kinds for s in found[k]), key=lambda s: (s[1], kinds.index(s[0])))
    return tuple(len(found[k]) for k in kinds), _sha(spans)


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    t = text or ""
    plain = lambda s: re.sub("[^0-9]", "", s)
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(ip, t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(plain(m[0])) <= 19 and _luhn(plain(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(plain(m[0])) <= 15],
    }
    return tuple(len(v) for v in found.values()), _sha([(k, *s) for k, v in found.items() for s in v])


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def prose(seed, n):
    """``n`` invented words, always the same for a seed."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))
