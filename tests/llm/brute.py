"""Plain versions of the corpus queries, as their results are defined; for tests on small tables only."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def simhash(docs, k=4, radius=4):
    fps = [fingerprint(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def decontaminate(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        words = cut(text)
        for i in range(max(1, len(words) - window + 1)):
            if words and item is not None:
                windows[tuple(words[i : i + window])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        words, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out.append((d, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return sorted(out, key=str)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def private(docs):
    out = []
    for d, text in docs:
        text = text or ""
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        kinds = [
            ("email", [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]),
            ("ip", [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]),
            ("card", [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]),
            ("phone", [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]),
        ]
        spans = [f"{k}:{a}:{b}" for k, found in kinds for a, b in found]
        out.append((d, *(len(f) for _, f in kinds), sha(",".join(spans)), spans))
    return out


def lines(docs, run=4, least=50):
    keyed = sorted({(-(2**63) if d is None else d, np.uint64(xxhash.xxh64_intdigest((t or "").encode(), seed=42)).astype(np.int64), t or "") for d, t in docs})
    first, gone, places = {}, defaultdict(set), defaultdict(list)
    for d, h, text in keyed:
        parts = text.split("\n")
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in parts]
        for i in range(len(parts)):
            for k in range(1, len(parts) - i + 1):
                places[tuple(parts[i : i + k])].append((d, text, i))
                if k == run or k < run and sum(words[i : i + k]) >= least:
                    e, g, j = first.setdefault(tuple(parts[i : i + k]), (d, h, i))
                    if (e, g, j) != (d, h, i):
                        gone[d, text] |= set(range(max(i, j + k) if (e, g) == (d, h) else i, i + k))
    depth = defaultdict(int)
    for content, at in places.items():
        if len(at) > 1 and len(content) & (len(content) - 1) == 0:
            for d, text, _ in at:
                depth[d, text] = max(depth[d, text], len(content))
    out = []
    for d, t in docs:
        parts, key = (t or "").split("\n"), (-(2**63) if d is None else d, t or "")
        out.append((d, len(parts), len(gone[key]), depth[key], sha("\n".join(p for i, p in enumerate(parts) if i not in gone[key]))))
    return sorted(out, key=str)


def tokens(docs, path):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def secrets(docs):
    out = []
    for d, text in docs:
        text = text or ""
        kinds = [
            ("assign", [m.span() for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]),
            ("access", [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]),
            ("hex", [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]),
        ]
        spans = sorted((a, n, f"{k}:{a}:{b}") for n, (k, found) in enumerate(kinds) for a, b in found)
        out.append((d, *(len(f) for _, f in kinds), sha(",".join(s for _, _, s in spans)), [s for _, _, s in spans]))
    return out


def repeats(docs, length=400):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(docs, raw, strict=True):
        dead = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                dead[i : i + length] = True
        kept = bytes(b for b, x in zip(r, dead, strict=False) if not x)
        out.append((d, len(r), int(dead.sum()), int((np.diff(dead.astype(int), prepend=0) > 0).sum()), sha(kept)))
    return sorted(out, key=str)


def nearest(rows, queries, k=5):
    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        dot = na = nb = 0.0
        for x, y in zip(a, b, strict=True):
            dot, na, nb = dot + x * y, na + x * x, nb + y * y
        return dot / (na**0.5 * nb**0.5)

    rows = [(i, [float(x) for x in v]) for i, v in rows if i is not None and sound(v)]
    out = []
    for q, v in rows:
        if q in queries:
            best = sorted((-cosine(v, w), i) for i, w in rows if i != q and len(v) == len(w))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def mixing(docs, weights=(3, 1, 2), share=1.5, most=2.0, seed=7):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    total = Counter()
    for (_, _, s), n in zip(docs, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), share * sum(size)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= most * total[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * total[s]
            rest -= target[s]
            free.discard(s)
    out = []
    for s in order:
        budget = int(target[s] + 0.5)
        epochs = budget // total[s] if total[s] else 0
        left = budget - epochs * total[s]
        key = lambda d, t: hashlib.md5(f"{seed}:{hashlib.md5((t or '').encode()).hexdigest() if d is None else d}".encode()).hexdigest()
        own = [(key(d, t), d is not None, d or 0, n, d) for (d, t, x), n in zip(docs, size, strict=True) if x == s]
        for _, _, _, n, d in sorted(own, key=lambda x: x[:4]):
            out.append((d, n, total[s], target[s], epochs * n + min(n, left)))
            left -= min(n, left)
    return sorted(out, key=str)
