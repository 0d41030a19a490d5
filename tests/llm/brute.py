"""Plain Python versions of the corpus operators, as slow and simple as they can be."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def union(pairs, items):
    """item -> smallest item it is linked to."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# repetition


def repetition(text, least=8):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_chars, longest_repeat)."""
    w = words(text)
    n = len(w)

    def covered(width):
        seen = Counter(tuple(w[i : i + width]) for i in range(n - width + 1))
        at = {j for i in range(n - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        return at

    longest = 0
    for width in range(least, n):
        seen = [tuple(w[i : i + width]) for i in range(n - width + 1)]
        if len(set(seen)) == len(seen):
            break
        longest = width
    lines = [line for line in text.split("\n") if words(line)]
    return (
        n,
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered(3)),
        sum(len(w[i]) for i in covered(least)),
        longest,
    )


def passes(text):
    n, chars, _, _, repeated, cover, longest = repetition(text)
    return not (n < 50 or 100 * repeated > 50 * n or cover > 0.3 * chars or longest > 100)


# lines


def one_edit(a, b):
    """Are two different word lists within one inserted, deleted or replaced word?"""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def dedup_lines(docs, least=5):
    """docs: (id, text), ids unique. id -> (text, lines with a word, lines taken out)."""
    seen, out = [], {}
    for doc_id, text in sorted(docs):
        kept, total, gone = [], 0, 0
        for line in (text or "").split("\n"):
            w = words(line)
            if not w:
                kept.append(line)
                continue
            total += 1
            repeat = any(w == s or (min(len(w), len(s)) >= least and abs(len(w) - len(s)) <= 1 and one_edit(w, s)) for s in seen)
            if repeat:
                gone += 1
            else:
                kept.append(line)
            if w not in seen:
                seen.append(w)
        out[doc_id] = ("\n".join(kept), total, gone)
    return out


# SimHash


def simhash(text):
    w = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    w = words(w)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hamming_components(prints, distance=3):
    prints = sorted(set(prints))
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= distance]
    return union(pairs, prints)


# mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: source -> words. source -> target, resharing the excess until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, "" if s is None else s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, wanted = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = wanted - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else rest * weight[s] / total for s in order}
        full.update(over)


def mix(docs, seed=8):
    """docs: (id, source, text). List of (id, copies)."""
    rows = []
    for doc_id, source, text in docs:
        place = "n" if source is None else f"s{len(source.encode())}:{source}"
        key = hashlib.md5("|".join([str(seed), "" if doc_id is None else str(doc_id), place, text or ""]).encode()).hexdigest()
        rows.append((doc_id, source, len(words(text)), key))
    sizes = defaultdict(int)
    for _, source, size, _ in rows:
        sizes[source] += size
    out = []
    for source, target in fill(sizes).items():
        whole = math.floor(target / sizes[source]) if sizes[source] else 0
        rest = target - whole * sizes[source]
        p = rest / sizes[source] if sizes[source] else 0
        begin, ranked = 0, []
        for doc_id, s, size, key in rows:
            if s == source:
                u = (int(key[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (p / (1 - p)) if p else 0, key, doc_id, size))
        for _, _, doc_id, size in sorted(ranked, key=lambda r: (r[0], r[1])):
            out.append((doc_id, size, whole + (p > 0 and begin + size / 2 <= rest)))
            begin += size
    return out


# spelling

LETTERS = re.compile("[A-Za-z\u00c0-\u00ff]+")


def spelling(docs, least_length=6, least_count=5):
    """word -> (form, root, n, n_near, form_n) of (doc_id, text)."""
    n = Counter()
    for doc_id, text in docs:
        for run in LETTERS.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    without = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            without[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), found in without.items():
        for w in found:
            near[w] |= found - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


# conversations


def prefix_trie(rows):
    """(conv_id, depth) -> the other columns, of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(q[:-1] for q in members if q)
    out = {}
    for q, found in members.items():
        below = [x for x in members if x[: len(q)] == q]
        ending = sorted(c for c in found if whole[c] == q)
        out[min(found), len(q)] = (
            min(members[q[:-1]]) if q else None, len(found), children[q], sum(not children[x] for x in below),
            sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in below if x),
            hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest(),
        )
    return out
