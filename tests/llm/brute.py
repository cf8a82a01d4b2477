"""Plain-Python versions of the corpus operators, for whole small tables."""

import base64
import hashlib
import re

import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}
WORD4 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def components(pairs_of, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs_of:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def fingerprint_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def simhash(docs):
    """docs: (doc_id, text) -> {doc_id: (hex, component)}."""
    fp = {i: fingerprint_of(t) for i, t in docs}
    ids = sorted(fp)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    comp = components(near, ids)
    return {i: (f"{fp[i]:016x}", comp[i]) for i in ids}


def contamination(docs, items, width=10):
    win = {}
    for item, text in items:
        w = WORD4.findall((text or "").translate(LOWER))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(k) for k in win}
    out = {}
    for doc, text in docs:
        w = WORD4.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := win.get(tuple(w[i : i + n]))) is not None:
                    found |= own
                    hit.update(range(i, i + n))
        names = ",".join(sorted(map(str, found)))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def warc(pages, least=0):
    first = {}
    for i, html in sorted(pages):
        first.setdefault(html or "", i)
    out = {}
    for i, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= least and first[html or ""] != i
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None)
    return out


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def edited(docs):
    """(doc_id, text) with distinct ids -> {doc_id: (text, edited text, next text)}."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[i] = (text, text[: len(text) - half] + nxt[:half], nxt)
    return out


def versions(docs):
    """The same -> {doc_id: (n_chars, sha256 of the edited text)}."""
    return {i: (len(t), hashlib.sha256(e.encode()).hexdigest()) for i, (t, e, _) in edited(docs).items()}


def digests(text):
    parts = re.findall(r"[^\n.!?。]{0,96}+[\n.!?。]|[^\n.!?。]{32,96}?(?= [A-Ha-h])|[^\n.!?。]{1,96}", text or "")
    return {xxhash.xxh64_intdigest(p, seed=42) % 2**40 for p in parts}


def check(key):
    first = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=42)
    return xxhash.xxh64_intdigest((7).to_bytes(4, "little"), seed=first) % 2**24


def cells_of(key):
    return [32 * t + (key >> 5 * t) % 32 for t in range(3)]


def ladder(text):
    """[(digests, {cell: [n, key, check]})] of each step."""
    own, out = digests(text), []
    while own:
        cells = {}
        for k in own:
            for at in cells_of(k):
                c = cells.setdefault(at, [0, 0, 0])
                c[0], c[1], c[2] = c[0] + 1, c[1] ^ k, c[2] ^ check(k)
        out.append((len(own), cells))
        own = {k for k in own if (k >> 15) % 4 ** len(out) == 0}
    return out


def fingerprint(text):
    one = lambda cells: b"".join(bytes([j, n % 256]) + k.to_bytes(5) + c.to_bytes(3) for j, (n, k, c) in sorted(cells.items()))
    return ".".join(f"{n}:{base64.b64encode(one(cells)).decode()}" for n, cells in ladder(text))


def compared(a, b):
    """(likeness, step, differing digests) from two fingerprints' texts alone."""
    sides = []
    for text in (a, b):
        steps = []
        for part in text.split(".") if text else []:
            n, _, raw = part.partition(":")
            raw = base64.b64decode(raw)
            steps.append((int(n), {raw[i]: (raw[i + 1], int.from_bytes(raw[i + 2 : i + 7]), int.from_bytes(raw[i + 7 : i + 10])) for i in range(0, len(raw), 10)}))
        sides.append(steps)
    for step in range(max(map(len, sides))):
        n, cells = 0, {}
        for sign, steps in zip((1, -1), sides, strict=True):
            size, own = steps[step] if step < len(steps) else (0, {})
            n += size
            for j, (m, k, c) in own.items():
                x = cells.setdefault(j, [0, 0, 0])
                x[0], x[1], x[2] = (x[0] + sign * m) % 256, x[1] ^ k, x[2] ^ c
        if 96 - sum(any(x) for x in cells.values()) < 6:
            continue
        found = set()
        while pure := next((x for x in cells.values() if x[0] in (1, 255) and x[2] == check(x[1])), None):
            m, k = pure[0], pure[1]
            found.add(k)
            for j in cells_of(k):
                x = cells[j]
                x[0], x[1], x[2] = (x[0] - m) % 256, x[1] ^ k, x[2] ^ check(k)
        if not any(any(x) for x in cells.values()):
            return (n - len(found)) / (n + len(found)), step, sorted(found)
    return (0.0 if a or b else 1.0), -1, []
