"""The contracts of the operators in a few plain lines each, for comparison."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_duplicates(docs, k):
    """doc_id: (n_shingles, component_id, kept), every pair compared."""
    sets = {i: shingles(t, k) for i, t in docs}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if not low or 100 * low < 80 * high:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (low + high - both):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed)


def secret_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for *_, x in sorted(found)]


def licence_places(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    found = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), sorted(found)


def url_verdict(url):
    """host, path, rule."""
    if url is None or "://" not in url:
        return "", "", None
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host, path = host.translate(LOWER), slash + path
    rules = [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
    fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def captures(pages):
    """Sorted (page_id, bytes, digest, type, refers_to)."""
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    rows = []
    for i, _, html in pages:
        raw, low = (html or "").encode(), first.get(html or "")
        same = low is None or i == low
        rows.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "response" if same else "revisit", None if same else low))
    return sorted(rows, key=str)
