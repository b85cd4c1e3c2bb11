"""Plain single-process versions of the text operators."""

import hashlib
from collections import defaultdict

import xxhash


def words(text):
    return (text or "").encode().split()


def low(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def substring(rows, window=50):
    """doc_id -> (n_words, n_removed, kept_sha256) of (doc_id, text) rows with unique ids."""
    first = {}
    for id_, text in sorted(rows):
        w = words(text)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), id_)
    out = {}
    for id_, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < id_:
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[id_] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def simhash(text, shingle=4):
    w = low(text).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, budget=4):
    """doc_id -> smallest doc_id reachable over fingerprints that differ in at most ``budget`` bits."""
    by = defaultdict(list)
    for id_, f in prints.items():
        by[f].append(id_)
    names = list(by)
    up = list(range(len(names)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if bin(names[i] ^ names[j]).count("1") <= budget:
                up[root(i)] = root(j)
    least = {}
    for k, f in enumerate(names):
        least[root(k)] = min(least.get(root(k), min(by[f])), min(by[f]))
    return {id_: least[root(k)] for k, f in enumerate(names) for id_ in by[f]}


def viterbi(text, v):
    """Ids of the best path over a whole text, by the full table."""
    space = "▁"
    if not text:
        return []
    text = space + text.replace(" ", space)
    n = len(text)
    best, back = [0] + [-(10**18)] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - v.longest), end):
            piece = v.ids.get(text[start:end])
            if piece is not None and best[start] + v.scores[piece] > best[end]:
                best[end], back[end] = best[start] + v.scores[piece], (start, piece)
        if best[end] < best[end - 1] + v.outside:
            best[end], back[end] = best[end - 1] + v.outside, (end - 1, -1)
    out, end = [], n
    while end:
        start, piece = back[end]
        out += [piece] if piece >= 0 else [v.byte_ids[b] for b in reversed(text[start:end].encode())]
        end = start
    return out[::-1]


def context_tree(training, depth, strings):
    """Function (context, byte) -> log10 probability, from a dictionary of all nodes."""
    import math

    tree = defaultdict(lambda: [0, 0])
    for text in training:
        for context, byte in strings(text):
            for d in range(depth + 1):
                for k in range(8):
                    tree[context[len(context) - d :], k, byte >> (8 - k)][byte >> (7 - k) & 1] += 1
    g = math.lgamma
    kt = {n: g(a + 0.5) + g(b + 0.5) - 2 * g(0.5) - g(a + b + 1) for n, (a, b) in tree.items()}
    weight, below = {}, defaultdict(float)
    for node in sorted(tree, key=lambda n: -len(n[0])):
        if len(node[0]) == depth:
            weight[node] = kt[node]
        else:
            x, y = kt[node], below[node]
            weight[node] = max(x, y) + math.log(0.5 + 0.5 * math.exp(-abs(x - y)))
        if node[0]:
            below[node[0][1:], node[1], node[2]] += weight[node]

    def score(context, byte):
        total = 0.0
        for k in range(8):
            p = None
            for d in range(depth, -1, -1):
                node = (context[len(context) - d :], k, byte >> (8 - k))
                counts = tree[node] if node in tree else [0, 0]
                own = (counts[byte >> (7 - k) & 1] + 0.5) / (sum(counts) + 1)
                share = 0.5 * math.exp(kt.get(node, 0) - weight.get(node, 0))
                p = own if p is None else share * own + (1 - share) * p
            total += math.log10(p)
        return total

    return score
