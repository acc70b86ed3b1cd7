"""Fill in the middle, ranked search and the n-gram join against plain Python, and their defined results for odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenlake.llm import fill_middle, ngram_join, ranked_search

VOCAB = [a + b for a in ("ba", "de", "lo", "mi", "ru", "ta") for b in ("n", "s", "ka", "vo", "x", "el")]
CLASH = "output string, row string, node string, h long, score long, rank int, n int"


def make(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", 1, 2, 3, 4) for r in rows], f"{schema}, {CLASH}").repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


ODD = [(0, None), (1, ""), (2, "x"), (3, "Ünï çødé – 漢字 🙂 mixed"), (4, "has <P> inside"), (5, "<"), (6, "a<P"), (7, "<M>"), (8, "word " * 30_000), (None, "null id text"), (9, "same id"), (9, "same id"), (9, "other text"), (10, "\n\t \r\n"), (11, "a1b2c3<P <S M>")]


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle(spark):
    rnd = random.Random(4)
    alphabet = "abcXYZ  <>PSM.é漢🙂\n"
    rows = ODD + [(100 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))) for i in range(400)]
    made = fill_middle.fill_in_middle(table(spark, rows)).persist()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256) for r in made.collect()), key=str)
    want = [(i, *plain_fim(i, t)) for i, t in rows]
    assert got == sorted(((*w, digest(w[-1])) for w in want), key=str)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    back = fill_middle.restored(made, ("doc_id", "output")).collect()
    assert sorted(((r.doc_id, r.text, r.restored_sha256) for r in back), key=str) == sorted(((i, t or "", digest(t or "")) for i, t in rows), key=str)


def test_piece_tables():
    text = memoryview(b"abcdefghij")
    whole = [fill_middle.Piece(fill_middle.TEXT, 0, 10)]
    parts = fill_middle.cut(whole, 3, 3, 8)
    assert [b"".join(fill_middle.streamed(p, text)) for p in parts] == [b"abc", b"", b"defgh", b"ij"]
    again = fill_middle.cut([*parts[2], *parts[0]], 2, 6)  # cutting a table of several descriptors
    assert [b"".join(fill_middle.streamed(p, text)) for p in again] == [b"de", b"fgha", b"bc"]
    assert fill_middle.arranged({"prefix": parts[0], "middle": parts[2], "suffix": parts[3]}, "spm")[0] == fill_middle.mark("suffix")


def test_fill_in_middle_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))


def plain_search(docs, items, k=50):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(w), len(w)) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, c, _ in bags for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c, n in bags:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("seeds", "block_terms", "k"), [(1000, 500_000, 50), (1, 3, 5), (20, 40, 3)])
def test_ranked_search(spark, monkeypatch, seeds, block_terms, k):
    monkeypatch.setattr(ranked_search, "SEEDS", seeds)
    rnd = random.Random(7)
    docs = [(i, make(rnd, rnd.randrange(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(60)]  # ties beyond k
    docs += ODD + [(300, "ÉTÉ été Été ban's 42"), (301, make(rnd, 5000))]
    items = [(1, "Ban lox LOX del"), (2, docs[3][1]), (3, None), (4, "never seen words"), (5, ""), (2, docs[3][1]), (2, "tavo ruel"), (None, "été 42 word"), (6, make(rnd, 300)), (7, "lox")]
    got = ranked_search.ranked(table(spark, docs), table(spark, items, "item_id long, text string"), k=k, block_terms=block_terms).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == plain_search(docs, items, k)


def test_ranked_search_common_terms_and_empty_tables(spark):
    docs = [(i, "the same words everywhere") for i in range(30)]
    assert ranked_search.ranked(table(spark, docs), table(spark, [(1, "the")], "item_id long, text string")).count() == len(plain_search(docs, [(1, "the")]))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ranked_search.ranked(none, table(spark, [(1, "the")], "item_id long, text string")).isEmpty()
    assert ranked_search.ranked(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).isEmpty()


def test_fewer_accumulators_than_documents():
    """A common term behind a rare one creates no accumulators once the floor is out of its reach."""
    lists = {0: (np.array([5]), np.array([900])), 1: (np.arange(1000), np.full(1000, 10))}
    seen = []
    rows, score = ranked_search.accumulate(lambda t: seen.append(len(lists[t][0])) or lists[t], np.array([0, 1]), np.array([10, 1]), np.array([9010, 10, 0]), -1, 500, np.zeros(1000, np.int64))
    assert rows.tolist() == [5] and score.tolist() == [9010]


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_join(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    label[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    return sorted(((i, len(sets[x]), ids.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("cluster_rows", "small_bucket", "percent"), [(4096, 32, 90), (2, 32, 80), (4096, 2, 80), (2, 2, 90)])
def test_ngram_join(spark, monkeypatch, cluster_rows, small_bucket, percent):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small_bucket)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rnd = random.Random(13)
    base = [make(rnd, rnd.randrange(30, 90)) for _ in range(20)]
    texts = list(base)
    for b in base[:10]:
        for changes in (1, 1, 2, 3, 4, 5):
            w = b.split()
            for _ in range(changes):
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "yy", "xx"])
            texts.append(" ".join(w))
    shared = make(rnd, 60)  # a passage in most of many texts: near the threshold, on both sides
    texts += [shared + " " + make(rnd, rnd.randrange(2, 12)) for _ in range(50)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate([base[0], base[0].upper(), "", None, "one two", "One TWO", "one", " \n\t ", "word " * 20_000])]
    rows += [(None, base[1]), (None, "nobody else has these words"), (7, base[2])]
    got = ngram_join.ngram_join(table(spark, rows), k=3, percent=percent, cluster_rows=cluster_rows).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_join(rows, 3, percent)


def test_ngram_join_empty_and_tiny_tables(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    got = ngram_join.ngram_join(spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 3), (4, 0, 4)]


def test_overlaps_and_prefixes():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 40, rnd.integers(0, 30)).astype(np.uint64)) for _ in range(12)]
    got = ngram_join.overlaps(sets[:7], sets[7:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[7:]] for a in sets[:7]]
    # any two sets at the threshold share a token of their prefixes, under every order
    classes = rnd.integers(0, 4, 1 << ngram_join.BITS).astype(np.uint8)
    for _ in range(200):
        a = rnd.integers(0, 2**63, 40).astype(np.uint64)
        b = np.concatenate([a[: rnd.integers(34, 40)], rnd.integers(0, 2**63, rnd.integers(0, 6)).astype(np.uint64)])
        pair = [np.unique(a), np.unique(b)]
        common = len(np.intersect1d(*pair))
        if 100 * common >= 80 * (len(pair[0]) + len(pair[1]) - common):
            for order in range(ngram_join.ORDERS):
                p, need = zip(*[(x[0], x[2][0]) for s in pair if (x := ngram_join._prefix(s, np.zeros(len(s), int), np.zeros(1, int), np.array([len(s)]), order, classes, 80))], strict=True)
                assert len(np.intersect1d(*p)) >= min(need)


# ---- scoring: memory by bytes, both sides of HOT, whole documents


def small_vocabulary():
    from lumenlake.llm import lm_score

    pieces = {lm_score.MARK: 0.1, lm_score.MARK + b"b": 0.1, b"an": 0.2, b"a": 0.1, b"na": 0.1, b"ban": 0.1, lm_score.MARK + b"banana": 0.1, b"xyzxyz": 0.05}
    names = [*pieces, *[bytes([b]) for b in range(256) if bytes([b]) not in pieces]]
    return np.array(names, object), np.log(np.array([pieces.get(x, 1e-4) for x in names]))


def test_long_words_by_stretches():
    from lumenlake.llm import lm_score

    table = lm_score._span_table(*small_vocabulary())
    rnd = random.Random(3)
    words = ["".join(rnd.choice("banxyz") for _ in range(n)).encode() for n in (1, 2, 7, 40, 333)]
    plain, uses = lm_score.lattice(words, table), lm_score.lattice(words, table, np.arange(1.0, 6.0))
    for stretch in (1, 3, 50, 10_000):
        assert np.allclose([lm_score._long_word(w, table, None, stretch=stretch) for w in words], plain)
        parts = [lm_score._long_word(w, table, float(i + 1), stretch=stretch) for i, w in enumerate(words)]
        assert all(np.allclose(sum(p[k] for p in parts), uses.get(k, 0)) for k in table)
    assert np.allclose(lm_score.values_of(words, table, most=20), plain)
    together = lm_score.uses_of(words, np.arange(1.0, 6.0), table, most=20)
    assert all(np.allclose(together[k], uses.get(k, 0)) for k in table)


def test_words_are_cut_by_bytes():
    from lumenlake.llm import lm_score

    words = [b"x" * n for n in (5, 5, 100, 1, 1, 9, 9)]
    cut = [words[s] for s in lm_score._by_bytes(words, 10)]
    assert [len(c) for c in cut] == [2, 1, 2, 1, 1] and sum(cut, []) == words


@pytest.mark.parametrize("hot", [1, 20, 200_000])
def test_document_scores(spark, monkeypatch, hot):
    """base_score and score against sums over each text's words, with all, some and no words broadcast."""
    from lumenlake.llm import lm_score

    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "vocabulary", lambda path: small_vocabulary())
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["banana", "Ban", "xyzxyz", "a", "q" + str(rnd.randrange(9))]) for _ in range(rnd.randrange(0, 30)))) for i in range(60)] + [(3, "same id"), (3, "same id"), (None, None)]
    got = lm_score.score_texts(table(spark, rows)).collect()
    import zlib

    held = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t in rows]
    count = Counter(w for _, out, ws in held if not out for w in ws)
    ends = sum(not out for _, out, _ in held)
    n, v = sum(count.values()) + ends, len(count) + 1
    arcs, stop = lm_score._span_table(*small_vocabulary()), lm_score.STOP
    names = sorted(count)
    for _ in range(2):  # the two passes, on the training words
        uses = lm_score.uses_of([w.encode() for w in names], np.array([float(count[w]) for w in names]), arcs, stop)
        total = {k: np.exp(x[1]) * lm_score.PRIOR + uses[k] for k, x in arcs.items()}
        used, both = sum(x.sum() for x in uses.values()), sum(x.sum() for x in total.values())
        stop = (sum(count.values()) + lm_score.PRIOR * stop) / (used + lm_score.PRIOR)
        arcs = {k: (x[0], np.log(total[k] / both)) for k, x in arcs.items()}
    end = (ends + 0.5) / (n + 1)
    value = lambda w: float(lm_score.values_of([w.encode()], arcs, stop)[0]) / math.log(10)
    want = []
    for i, out, ws in held:
        base = sum(math.log10((c + 1) / (n * 1.0 + v + 1)) for c in [*(count[w] for w in ws), ends])
        want.append((i, out, len(ws) + 1, sum(count[w] > 0 for w in ws) + 1, n, round(base, 6), round(sum(map(value, ws)) + len(ws) * math.log10(1 - end) + math.log10(end), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)


# ---- decontamination beyond what is broadcast


@pytest.mark.parametrize("rows", [0, 200_000])
def test_decontamination_with_and_without_broadcast(spark, monkeypatch, rows):
    from lumenlake.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words[:20])), (1, " ".join(words[:20])), (None, "short one here"), (2, "x y " + " ".join(words[12:25])), (3, None), (4, "clean text of other words")]
    items = table(spark, [(1, " ".join(words[3:16])), (2, "Short one"), (3, " ".join(words[10:30])), (None, None)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_hit, r["items"]) for r in decontaminate.decontaminate(table(spark, docs), items).collect()), key=str)
    assert got == sorted([(1, 17, ["1", "3"]), (1, 17, ["1", "3"]), (0, 2, ["2"]), (2, 13, ["3"]), (3, 0, []), (4, 0, [])], key=str)
