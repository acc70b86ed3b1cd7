"""Every stage of the pipeline against plain Python, on odd rows."""

import random
import re
from collections import Counter

import pytest
from plain import lower, near_kept, quality_kept, spaced

import corpus_pipeline as p
from lumenlake.llm import quality, secrets

VOCAB = [a + b for a in ("ba", "de", "lo", "mi", "ru", "ta") for b in ("n", "s", "ka", "vo", "x", "el")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, kept int, row long, domain string"


def make(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [make(rnd, rnd.randrange(30, 150)) for _ in range(30)]
    texts = [(i, t) for i, t in enumerate(base)]
    for i, b in enumerate(base[:6]):
        w = b.split()
        w[rnd.randrange(len(w))] = "zz"
        texts.append((100 + i, " ".join(w)))
    leak = " ".join(base[20].split()[5:17])
    texts += [(7, make(rnd, 60)), (7, make(rnd, 40) + " " + leak), (None, make(rnd, 50)), (None, make(rnd, 50) + " " + leak), (None, None), (8, None), (8, ""), (9, "few words")]
    texts += [(200, base[3]), (200, base[3]), (3, base[3]), (None, base[4]), (-5, base[4]), (300, make(rnd, 5000)), (301, "x password = \"hunter22\" y " + make(rnd, 30)), (302, " ".join(["same five words are here"] * 20))]
    return [(i, t, None if k % 11 == 0 else "en" if k % 3 else "de", None if k % 7 == 0 else f"s{k % 4}", None if t is None else len(t), "clash", 1, 2, "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    leak = " ".join(rows[20][1].split()[5:17])
    spark.createDataFrame([(1, leak), (2, None), (None, "zz qq")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def counted(df):
    return Counter(tuple(r) for r in df.select(*p.COLUMNS).collect())


def own(rows):
    return Counter(tuple(r[:5]) for r in rows)


def test_names():
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "mixing"]


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_empty_table(spark, tables, name):
    out = dict(p.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), tables)
    assert out.count() == 0 and out.columns[:5] == p.COLUMNS


def test_quality(spark, docs, rows, tables):
    kept = quality_kept([(r[1], r[2]) for r in rows], quality.VOCABULARY, quality.PRIOR, quality.BAND, quality.FLOOR)
    assert counted(p.quality(spark, docs, tables)) == own(r for r, k in zip(rows, kept, strict=True) if k)


def test_near_dedup(spark, docs, rows, tables):
    got = counted(p.near_dedup(spark, docs, tables))
    sets = {}
    for r in sorted({tuple(r[:5]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        w = spaced(lower(r[1]))
        sets[r] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    groups = Counter(frozenset(sets[r]) for r in got if sets[r])
    assert set(got.values()) == {1}
    want = near_kept(sets)
    # rows of one group that tie in their id are told apart by digest: any of them may stay
    of = lambda rs: Counter((r[0], frozenset(sets[r])) for r in rs)
    assert of(got) == of(want) and max(groups.values()) == 1


def test_decontamination(spark, docs, rows, tables):
    leak = rows[20][1].split()[5:17]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(leak[k : k + 10]) for k in range(3)} | {("zz", "qq")}
    hit = lambda t: any(tuple(words(t)[k : k + n]) in windows for n in (2, 10) for k in range(len(words(t))))
    want = own(r for r in rows if not hit(r[1]))
    assert counted(p.decontamination(spark, docs, tables)) == want and sum(want.values()) == len(rows) - 3


def test_secrets(spark, docs, rows, tables):
    def clean(t):
        out, at = "", 0
        for a, b, k in secrets.spans(t):
            out, at = (out + t[at:a] + f"[{k}]", b) if a >= at else (out, max(at, b))
        return out + t[at:]

    want = own((i, t and clean(t), a, s, t if t is None else len(clean(t))) for i, t, a, s, *_ in rows)
    assert counted(p.secrets(spark, docs, tables)) == want and any("[assign]" in (r[1] or "") for r in want)


def test_mixing(spark, docs, rows, tables):
    from lumenlake.llm.mixing import mix

    got = p.mixing(spark, docs, tables).collect()
    copies = Counter()
    for r in mix(docs).where("copies > 0").collect():
        copies[r.doc_id, r.n_tokens, r.domain, r.lang, r.source, r.copies] += 1
    assert Counter((r.doc_id, r.n_tokens, r.domain, r.lang or "unknown", r.source or "unknown", r.copies) for r in got) == copies
    left = own(rows)
    left.subtract(Counter(tuple(r)[:5] for r in got))
    assert min(left.values()) >= 0 and all(r.n_tokens == len(spaced(r.text)) for r in got)
    assert sum(r.n_tokens * r.copies for r in got) <= 0.6 * sum(len(spaced(r[1])) for r in rows)


def test_mixing_equals_sql(spark, tables):
    """The stage against DuckDB's water-filling, an implementation of its own, on rows with ids."""
    import duckdb
    import pyarrow as pa

    from lumenlake.llm.oracles import OP2

    rnd = random.Random(21)
    rows = [(i, " ".join("w" * rnd.randrange(1, 5) for _ in range(rnd.choice([0, 3, 40, 300]))), rnd.choice(["en", "en", "de", None]), rnd.choice([f"s{k}" for k in range(7)] + [None]), 1) for i in range(300)]
    documents = pa.table(list(map(list, zip(*rows, strict=True))), p.COLUMNS)
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, domain, n_tokens, copies FROM ({OP2}) WHERE copies > 0").fetchall()}
    got = p.mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tables).collect()
    assert {r.doc_id: (r.domain, r.n_tokens, r.copies) for r in got} == want and len(got) == len(want)


def test_whole_chain(spark, rows, tables, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert Counter(tuple(r) for r in p.run(spark, str(tmp_path)).collect()) == Counter(tuple(r) for r in docs.collect())
