"""Plain Python versions that tests hold operators against."""

import math
import re
from collections import Counter, defaultdict


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def word_hash(w):
    """The operators break ties between words by hash."""
    import pyarrow as pa

    from lumenlake.llm.textblocks import SAME, SPACED, blocks

    return int(next(blocks(pa.array([w]))).word_hashes(SPACED, SAME)[0].view("int64")[0])


def word_model(texts, size):
    """texts: (text, language). A function of the same, to the log10 probabilities of its words: modified Kneser-Ney pairs."""
    seen, docs = defaultdict(Counter), defaultdict(list)
    for t, lang in texts:
        docs[lang or ""].append(spaced(t))
        seen[lang or ""].update(set(spaced(t)))
    models = {}
    for lang, rows in docs.items():
        names = sorted(seen[lang], key=lambda w: (-seen[lang][w], word_hash(w)))[:size]
        pairs = Counter(p for r in rows for p in zip(["<s>", *[w if w in names else None for w in r]], [w if w in names else None for w in r]))
        own = Counter(w for _, w in pairs)
        models[lang] = names, pairs, own

    def cuts(counts):
        n = [sum(v == i for v in counts.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(i, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 for i in (1, 2, 3)]
        return lambda v: min(v, d[min(v, 3) - 1])

    def of(t, lang):
        names, pairs, own = models[lang or ""]
        cut2, cut1 = cuts(pairs), cuts(own)
        total = sum(own.values())
        gamma1 = sum(map(cut1, own.values())) / total if total else 0
        out, before = [], "<s>"
        for w in spaced(t):
            w = w if w in names else None
            here = {p: v for p, v in pairs.items() if p[0] == before}
            q = (own[w] - cut1(own[w])) / total + gamma1 / len(own)
            all_ = sum(here.values())
            out.append(math.log10((pairs[before, w] - cut2(pairs[before, w])) / all_ + sum(map(cut2, here.values())) / all_ * q))
            before = w
        return out

    return of


def middle(values):
    """The lower median."""
    return sorted(values)[(len(values) + 1) // 2 - 1]


def quality_kept(texts, size, prior, width, floor):
    """texts: (text, language). Which the rules and the bands keep."""
    of = word_model(texts, size)
    base, mean = [], []
    for t, lang in texts:
        w = spaced(t)
        g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        base.append(len(w) < 10 or 100 * len(hit) > 20 * len(w))
        mean.append(sum(of(t, lang)) / len(w) if w else None)
    kept = [not b for b in base]
    for lang in {x or "" for _, x in texts}:
        own = [i for i, (_, x) in enumerate(texts) if (x or "") == lang and not base[i]]
        if not own:
            continue
        m = middle([mean[i] for i in own])
        drawn = {i: m + (mean[i] - m) * math.sqrt(len(spaced(texts[i][0])) / (len(spaced(texts[i][0])) + prior)) for i in own}
        half = width * max(1.4826 * middle([abs(x - m) for x in drawn.values()]), floor)
        for i in own:
            kept[i] = abs(drawn[i] - m) <= half
    return kept


def near_kept(sets):
    """sets: name -> shingles, in order of preference. The first name of every group of near copies."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(sets)
    place = {n: i for i, n in enumerate(names)}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y, key=place.get)] = min(x, y, key=place.get)
    return [n for n in names if find(n) == n]
