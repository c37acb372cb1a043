"""Stages of the pipeline on awkward documents, and the whole of it."""

import collections
import random

import corpus_pipeline
import pytest

from tessera.llm import decontamination, packing, substring
from tessera.llm._shared import hashed_words, settings, written
from tessera.llm.queries import tokenizer_path
from tests import oracle
from tests.llm import samples
from tests.llm.test_operators_llm import brute_groups, brute_substring


@pytest.fixture(scope="module")
def rows():
    return samples.messy()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return samples.documents(spark, rows)


def test_stages_keep_the_columns_and_survive(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, oracle.DATA)
        assert got.columns == docs.columns
        got.collect()
        assert stage(spark, docs.limit(0), oracle.DATA).count() == 0


def test_one_of_each_group(spark, docs, rows):
    got = collections.Counter(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, oracle.DATA).collect())
    named = {row for row, (i, _, c) in zip(rows, brute_groups(rows, 5, 80), strict=True) if i is not None and i == c}
    assert got == collections.Counter([i for i, _ in named] + [i for i, _ in rows if i is None])


def kept_of(spark, rows):
    got = corpus_pipeline.one_of_each_group(spark, samples.documents(spark, rows), oracle.DATA)
    return collections.Counter((r.doc_id, r.text) for r in got.collect())


def changed(text, *places):
    w = text.split()
    for p in places:
        w[p] = f"other{p}"
    return " ".join(w)


def test_near_copies_of_80_percent(spark):
    rnd = random.Random(5)
    a, b, c = (samples.sentence(rnd, 50) for _ in range(3))
    rows = [(1, a), (2, changed(a, 25)), (3, b), (4, changed(b, 15, 35)), (5, changed(a, 25, 40)), (6, c)]
    assert [g for *_, g in brute_groups(rows)] == [1, 2, 3, 4, 5, 6]
    assert [g for *_, g in brute_groups(rows, 5, 80)] == [1, 1, 3, 4, 1, 6]
    assert kept_of(spark, rows) == collections.Counter(rows[i] for i in (0, 2, 3, 5))


def test_rows_without_an_id_or_of_two_texts(spark):
    rnd = random.Random(6)
    a, b, c, d, e = (samples.sentence(rnd, 80) for _ in range(5))
    stay = [(7, a), (3, d), (15, e), (None, None), (None, None), (None, " ")]
    gone = [(None, a), (None, changed(a, 40)), (15, changed(d, 40))]
    unnamed = [(None, b), (None, b), (None, changed(b, 40)), (None, changed(b, 40)), (None, c)]
    got = kept_of(spark, stay + gone + unnamed)
    of_b = {t: n for (i, t), n in got.items() if t in (b, changed(b, 40))}
    assert list(of_b.values()) == [1]
    assert got == collections.Counter([*stay, (None, *of_b), (None, c)])


def test_exact_copies_leave_one_row(spark):
    rnd = random.Random(11)
    a, b = samples.sentence(rnd, 60), samples.sentence(rnd, 3)
    assert kept_of(spark, [(1, a)] * 4 + [(2, a), (3, b), (3, b), (4, ""), (4, "")]) == collections.Counter([(1, a), (3, b), (4, "")])


def test_repeats_leave_the_text(spark, docs, rows):
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.drop_repeats(spark, docs, oracle.DATA).collect())
    whole = {r.text: r.remains for r in substring.deduplicate(docs).collect()}
    want = collections.Counter()
    for (i, t), (_, _, gone, kept) in zip(rows, brute_substring(rows), strict=True):
        new = whole[t] if gone else t
        assert not gone or new.encode().split() == kept.encode().split()
        want[(i, new, None if new is None else len(new))] += 1
    assert got == want


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage over the table of documents, and what comes out."""
    docs, out = spark.read.parquet(f"{oracle.DATA}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = written(stage(spark, docs, oracle.DATA), f"stage-{n}")
        out.append((name, docs.collect(), got.collect()))
        docs = got
    return out


def test_the_toxicity_stage_follows_the_labels(spark, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{oracle.DATA}/labels.parquet").collect()}
    known = [r.doc_id for r in before if r.doc_id in toxic]
    assert sum((i in kept) == (toxic[i] == 0) for i in known) >= 0.95 * len(known) and kept <= {r.doc_id for r in before}


def test_the_near_copy_stage_by_brute_force(stages):
    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before]
    want = {(i, t) for (i, t), (_, _, c) in zip(rows, brute_groups(rows, 5, 80), strict=True) if i == c}
    assert collections.Counter((r.doc_id, r.text) for r in after) == collections.Counter(want)


def test_the_substring_stage_by_brute_force(stages):
    _, before, after = stages[2]
    want = brute_substring([(r.doc_id, r.text) for r in before])
    assert sorted((r.doc_id, r.text.encode().split()) for r in after) == sorted((i, kept.encode().split()) for i, _, _, kept in want)


def test_the_decontamination_stage_by_brute_force(spark, stages):
    """Every document that holds an item goes, and no other. An item cannot be near where more words than edits are missing."""
    _, before, after = stages[3]
    items = [w for r in spark.read.parquet(f"{oracle.DATA}/benchmark.parquet").collect() if len(w := decontamination.words(r.text)) >= decontamination.LEAST]
    held = set()
    for r in before:
        ws = decontamination.words(r.text)
        have = collections.Counter(ws)
        for item in items:
            most = len(item) // 5
            if sum((collections.Counter(item) - have).values()) <= most and decontamination.edits_within(item, ws, most):
                held.add(r.doc_id)
                break
    assert held and {r.doc_id for r in after} == {r.doc_id for r in before} - held


def test_the_packing_stage_by_brute_force(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    _, before, after = stages[4]
    want = collections.Counter()
    for r in before:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.update((r.doc_id, n, start, length) for n, (start, length) in enumerate(packing.cut(len(ids), 1024)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in after) == want
    fill = collections.Counter()
    for r in after:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 2


def test_the_whole(spark):
    got = corpus_pipeline.run(spark, oracle.DATA)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = got.select("doc_id").distinct().count()
    assert 0 < kept < spark.read.parquet(f"{oracle.DATA}/documents.parquet").count()


def test_words_are_cut_at_six_bytes_only():
    text = "a\u00a0b c\x1cd\x0be\x85f\n\n g"
    _, w = next(hashed_words([text, None, "", text]))
    found = [w.raw[s:e] for s, e in zip(w.start, w.end, strict=True)]
    assert found == text.encode().split() * 2 and w.sizes.tolist() == [4, 0, 0, 4]
    assert (w.hash[:4] == w.hash[4:]).all() and len(set(w.hash.tolist())) == 4


def test_settings_come_back(spark):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with pytest.raises(ZeroDivisionError), settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="77"):
        assert spark.conf.get(name) == "77"
        raise ZeroDivisionError
    assert spark.conf.get(name) == before
