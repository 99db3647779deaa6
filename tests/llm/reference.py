"""Plain Python versions of the operators, over lists of (id, text)."""

import re
from collections import defaultdict

LOWER = {chr(i): chr(i + 32) for i in range(65, 91)}


def lower(t):
    return re.sub("[A-Z]", lambda m: LOWER[m[0]], t or "")


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def shingle_set(t):
    w = blank_words(lower(t))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(rows):
    """id -> smallest id reachable over pairs of similar sets."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def contamination(rows, items):
    """id -> (n_words, n_hit, sorted items)."""
    windows = defaultdict(set)
    for item, t in items:
        w = alnum_words(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w, hit, found = alnum_words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[g]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def quality(t):
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = t or ""
    w = blank_words(t)
    lines = [x for x in t.split("\n") if blank_words(x)]
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    repeat = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(repeat)


def removed(rows, n=50):
    """id -> a flag for each byte: it lies in n bytes that also start in a document of a smaller id."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        flags = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                flags[p : p + n] = b"\1" * n
        out[i] = flags
    return out


def base_spans(t):
    """(start, kind number, end) of the base secrets, by the words of the contract."""
    t, out = t or "", []
    for k, (pattern, least, group) in enumerate([(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return sorted(out)


def luhn_holds(digits):
    """The check digit rule, from the right: every second digit doubled, digit sums added."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


#: Kinds of personal data as the tables hold them: a form of its own for each, and what a value must be.
PRIVATE_FORMS = {
    "email": (r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com", lambda v: True),
    "card": (r"(?<![0-9.+-])[2-6][0-9]{15}(?![0-9])", luhn_holds),
    "ip": (r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.])", lambda v: all(int(x) < 256 and str(int(x)) == x for x in v.split("."))),
    "phone": (r"\+1 \([0-9]{3}\) 555-[0-9]{4}", lambda v: True),
}


def private_values(t):
    """(kind, value) in the order of the text."""
    found = [(m.start(), k, m[0]) for k, (form, holds) in PRIVATE_FORMS.items() for m in re.finditer(form, t or "") if holds(m[0])]
    return [(k, v) for _, k, v in sorted(found)]


def shape(v):
    """Letters and digits by their kind, every other character as it is."""
    return re.sub("[a-z]", "a", re.sub("[0-9]", "0", v))
