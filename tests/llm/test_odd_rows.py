"""Defined results of the operators for repeated rows, null and repeated ids, ties, very long texts and clashing columns."""

import hashlib
import math
import random

from lumenlake.llm import lm_score, mixing, quality, repeats, toxicity, warc
from lumenlake.llm.decontaminate import decontaminate

CLASH = "row string, component_id long, h long, lang_key string, score string, salt string, n int"


def table(spark, rows, schema):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash", "clash", "clash", 3) for r in rows], f"{schema}, {CLASH}").repartition(3)


def test_mixing_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "en", "s"), (None, "a b c", "en", "s"), (None, "d e", "en", "s"), (7, "f g", "en", "s"), (7, "h i j", "en", "s"), (8, None, None, None), (9, "", "en", "s"), (10, "w " * 50_000, "de", "t")]
    got = mixing.mix(table(spark, rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 2, 3, 3, 3, 50_000]
    twins = [r.copies for r in got if r.doc_id is None and r.n_tokens == 3]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert all(0 <= r.copies <= 4 for r in got) and sum(r.copies * r.n_tokens for r in got) <= 0.6 * 50_013


def test_mixing_ties_of_weights_and_sizes(spark):
    rows = [(i, "one two three", "en", f"s{i % 4}") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), weights={}, domain="'web'").collect()
    per = {}
    for r in got:
        per[r.source] = per.get(r.source, 0) + r.copies
    assert set(per.values()) == {6}  # 18 of each source's 30 tokens


def test_decontamination_repeated_rows_and_null_items(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words[:20])), (1, " ".join(words[:20])), (None, " ".join(words[5:15])), (2, "x " * 100_000 + " ".join(words[:10])), (3, None)]
    items = spark.createDataFrame([(None, " ".join(words[3:16])), (4, " ".join(words[3:16])), (4, None)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate(table(spark, rows, "doc_id long, text string"), items).collect()), key=str)
    one = (1, 20, 13, ["4", "null"])
    assert got == sorted([one, one, (0, 10, 10, ["4", "null"]), (2, 100_010, 0, []), (3, 0, 0, [])], key=str)


def test_quality_repeated_rows_and_short_languages(spark):
    rnd = random.Random(1)
    rows = [(i % 50, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(40)), "en") for i in range(60)]
    rows += [(100, "only one text of this language with just enough words in it", "xx"), (None, rows[0][1], "en"), (None, rows[0][1], "en"), (101, "word " * 30_000, None), (102, None, "yy")]
    got = quality.judge(table(spark, rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    twins = [r[1:] for r in got if r.doc_id is None]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert next(r for r in got if r.doc_id == 100).kept and not next(r for r in got if r.doc_id == 102).kept
    assert next(r for r in got if r.doc_id == 101).n_repeat_words == 30_000


def test_toxicity_odd_rows(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(30)) + (" grumblor" if i % 3 == 0 else "")) for i in range(150)]
    labels = [(i, int(i % 3 == 0)) for i in range(150)] + [(i, 0) for i in range(0, 30, 3)] + [(None, 1), (3, None), (999, 1)]
    rows += [(500, "grumblor " * 60_000), (501, rows[0][1]), (501, rows[0][1]), (None, ""), (502, "12 34 !!")]
    got = toxicity.toxicity(table(spark, rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r.score)
    assert len(set(of[501])) == 1 and of[None] == of[502] and min(of[500][0], of[501][0]) > 0.7 > of[502][0]


def test_lm_repeated_rows_and_a_very_long_word(spark):
    rows = [(1, "some words of text"), (1, "some words of text"), (2, "some words of text"), (3, "x" * 20_000), (4, None), (None, "text")]
    got = lm_score.score_texts(table(spark, rows, "doc_id long, text string"), passes=1).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = {r.score for r in got if r.n_tokens == 5}
    assert len(same) == 1 and next(r for r in got if r.doc_id == 3).n_tokens == 2
    assert not next(r for r in got if r.doc_id is None).held_out


def test_warc_long_payloads_and_shared_ids(spark):
    long = "é<p>" * 300_000
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (3, "u", "z" * 99), (4, "u", "z" * 99)]
    got = warc.archive_round_trip(table(spark, rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id > 1} == {(2, "revisit", 1), (3, "response", None), (4, "response", None)}
    assert all(r.payload_digest == hashlib.sha256((long if r.page_id < 3 else "z" * 99).encode()).hexdigest() for r in got)


def test_repeats_are_judged_by_bytes_not_words(spark):
    rnd = random.Random(11)
    prose = lambda sizes: " ".join("".join(rnd.choices("abcdefghij", k=k)) for k in sizes)
    passages = {"59 words": prose([5] * 59), "51 words, 399 bytes": prose([7] * 43 + [6] * 8), "51 words, 400 bytes": prose([7] * 44 + [6] * 7), "10 words, 400 bytes": prose([39] * 9 + [40])}
    assert {k: len(v) for k, v in passages.items()} == {"59 words": 353, "51 words, 399 bytes": 399, "51 words, 400 bytes": 400, "10 words, 400 bytes": 400}
    rows = [(f"{name}/{i}", f"{prose([6] * 80)} {edge}{text}{edge} {prose([6] * 80)}") for name, text in passages.items() for i, edge in enumerate("ABCDEF")]  # edges end the shared string
    got = {r.doc_id: r for r in repeats.remove_repeats(table(spark, rows, "doc_id string, text string")).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        passage = passages[key.split("/")[0]]
        gone = len(passage) >= 400
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), 400 * gone, int(gone)), key
        assert bytes(r.kept).decode() == (text.replace(passage, "") if gone else text), key
