"""Each operator against brute force on awkward documents; empty tables; columns of clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontamination, ngram_join, packing, quality, sharding, substring, toxicity, url_filter, warc
from tessera.llm.queries import tokenizer_path
from tests.llm import samples


@pytest.fixture(scope="module")
def rows():
    return samples.messy()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return samples.documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return samples.documents(spark, [])


# substring deduplication
def brute_substring(rows, length=35):
    ws = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for w in ws for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, ws, strict=True):
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone |= set(range(s, s + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("crowd", [1024, 1])
def test_substring(docs, rows, crowd):
    got = substring.deduplicate(docs, crowd=crowd)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept", "remains"]
    assert all((r.remains or "").split() == r.kept.split() and (r.n_removed or r.remains == r.text) for r in got.collect() if "\u2028" not in (r.text or ""))
    assert collections.Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect())) == collections.Counter(brute_substring(rows))


def test_what_remains_keeps_its_white_space():
    text = b"  a b\n\nc d\te  "
    assert substring.without(text, np.array([True, False, True, True, False])) == b"  a\n\nc d  "
    assert substring.without(text, np.array([False, True, False, False, True])) == b"b\te  "


def test_substring_other_lengths_and_empty(spark, none):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 40)))) for i in range(40)]
    got = substring.deduplicate(samples.documents(spark, rows, False), length=8, gram=3, shard_words=50)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect())) == collections.Counter(brute_substring(rows, 8))
    assert substring.deduplicate(none).count() == 0


# n-gram Jaccard join
def brute_groups(rows, k=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    ids = collections.defaultdict(list)
    for r, (i, _) in zip(root, rows, strict=True):
        ids[r].append(i)
    return [(i, len(s), i if not s else min((x for x in ids[r] if x is not None), default=None)) for (i, _), s, r in zip(rows, sets, root, strict=True)]


@pytest.mark.parametrize("bucket", [4096, 1])
def test_groups(docs, rows, bucket):
    got = ngram_join.groups(docs, bucket=bucket)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_groups(rows))


@pytest.mark.parametrize("bucket", [4096, 4])
def test_groups_of_near_copies(spark, bucket):
    rnd = random.Random(9)
    bases = [samples.sentence(rnd, 90).split() for _ in range(4)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = samples.sentence(rnd, 1)
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    got = ngram_join.groups(samples.documents(spark, rows), bucket=bucket)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_groups(rows))


def test_groups_of_nothing(none):
    assert ngram_join.groups(none).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {v: v for e in edges for v in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = ngram_join.components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert sorted(map(tuple, got)) == sorted((v, root[v]) for v in linked)


# sharding
@pytest.mark.parametrize("ranges", [512, 3])
def test_shards(spark, docs, rows, ranges):
    got = sharding.shard(docs, ranges=ranges).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_shards_are_even_under_one_hot_key(spark):
    rows = [(None if i % 3 else i, "same text of a hot group" if i % 2 else "x" * (i % 50)) for i in range(4000)]
    got = sharding.shard(samples.documents(spark, rows), ranges=16).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = sum(r.b for r in got)
    assert len(got) == 8 and max(abs(r.b - total / 8) for r in got) <= 100


@pytest.mark.parametrize("kind", ["plain", "long", "tiny", "copies"])
def test_shards_are_even(spark, kind):
    """Shards differ from their share by less than one record."""
    rnd = random.Random(kind)
    text = {"plain": lambda i: "x" * rnd.randrange(300), "long": lambda i: "é" * (20_000 if i == 77 else 30), "tiny": lambda i: "", "copies": lambda i: "the same" if i % 3 else f"{i}"}[kind]
    rows = [(i, text(i)) for i in range(3000)]
    got = sharding.shard(samples.documents(spark, rows), sample=500).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    total, largest = sum(size.values()), max(r["size"] for r in got)
    assert len(got) == 3000 and all(abs(size[s] - total / 8) <= largest for s in range(8))
    for n in range(8):
        assert sorted(r.slot for r in got if r.shard == n) == list(range(sum(r.shard == n for r in got)))


def test_shards_around_one_row_of_half_the_bytes(spark):
    """Its middle decides where it lies; the shards that it spans hold nothing else."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, F.repeat(F.lit("y"), 100_000)).otherwise("same").alias("text"))
    got = collections.defaultdict(list)
    for r in sharding.shard(df, sample=64, ranges=16).collect():
        got[r.shard].append(r.slot)
    assert sum(map(len, got.values())) == 20_000 and 4 <= len(got) <= 6
    assert all(sorted(s) == list(range(len(s))) for s in got.values())


def test_shards_of_nothing(none):
    assert sharding.shard(none).count() == 0


# packing
def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path()).toPandas()
    want = collections.Counter()
    total = 0
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        for n, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            want[(i, n, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
    seen = collections.Counter((None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert seen == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-total // 1024) + 1
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_packing_in_many_rounds(spark):
    rnd = random.Random(2)
    docs = samples.documents(spark, [(i, samples.sentence(rnd, rnd.randrange(1, 300))) for i in range(400)], False).repartition(16)
    got = packing.pack(docs, tokenizer_path(), group=20).toPandas()
    assert got.doc_id.nunique() == 400 and not got.duplicated(["doc_id", "piece"]).any()
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 1024 + 2
    assert got.groupby("sequence_id").length.sum().max() <= 1024


def test_no_group_of_bins_grows(spark):
    """The groups of a round hold some ``group`` bins each, however many rounds there are, and the last takes the emptiest."""
    left = spark.range(5000).select(F.col("id").alias("bin"), (F.col("id") % 900 + 1).cast("int").alias("fill"))
    bound = packing._emptiest(left, 100)
    assert left.where(F.col("fill") <= bound).count() <= 100 < left.where(F.col("fill") <= bound + 1).count()
    for level in (1, 2, 3):
        sizes = [r["count"] for r in packing._dealt(left, -(-5000 // 250), level).groupBy("g").count().collect()]
        assert len(sizes) == 20 and max(sizes) <= 2 * 250


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 5]), 10) == [[0, 2], [1, 3]]


@pytest.mark.parametrize("text", ["plain words", "naïve Ünïcode\n\n  x", "日本語 text \U0001f600", "<|endoftext|> it's 12 o'clock\r\n\t", "\u00a0\u2003 gaps \x85 \x1c end", ""])
def test_encoder_gives_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    assert packing.Encoder(tokenizer_path())(text).tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


# WARC
def test_archive_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = [(3, "http://a/1", big), (1, "http://a/2\r\nWARC-Type: forged", big), (2, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (1, "http://a/2", big), (6, "é", "ünï" * 60)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    warc.write_archive(df, str(tmp_path / "w"))
    got = warc.record_bytes(warc.read_archive(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(pages)
    by = collections.Counter((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in got)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = collections.Counter()
    for i, _, h in pages:
        n = len((h or "").encode())
        kind = "revisit" if h == big and i != 1 else "response"
        want[(str(i) if i is not None else "none", kind, "1" if kind == "revisit" else None, sha(h), n)] += 1
    assert by == want
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len({h or "" for _, _, h in pages})
    for r in got:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and b"\r\nWARC-Type: forged" not in head
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert len(block) - 4 == length == (0 if r.record_type == "revisit" else r.payload_bytes)


def test_archive_notices_changed_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    digest = spark.read.parquet(str(tmp_path / "w/payloads")).first().digest
    spark.createDataFrame([(digest, b"other")], "digest string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    with pytest.raises(Exception, match="do not match"):
        warc.read_archive(spark, str(tmp_path / "w")).collect()


def test_archive_of_nothing(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


def test_archive_of_long_payloads(spark, tmp_path):
    long = "é<p>" * 700_000
    df = spark.createDataFrame([(2, "u", long), (1, "u", long), (3, "u", long + "x")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    got = {r.record_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archive(spark, str(tmp_path / "w")).select("record_id", "record_type", "refers_to", "payload_bytes").collect()}
    assert got == {"1": ("response", None, 3_500_000), "2": ("revisit", "1", 3_500_000), "3": ("response", None, 3_500_001)}


# nearest neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16))
    x[700:900] = x[5] + 0.01 * rng.standard_normal((200, 16))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2100, [float("nan")] * 16), (2200, [1.0] * 15), (None, [1.0] * 16), (2300, [None, *[1.0] * 15])]
    df = spark.createDataFrame([(*r, "x") for r in data + odd], "vec_id long, embedding array<double>, query_id string")
    got = ann.neighbours(df, F.col("vec_id") % 100 == 0, block=400).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == pytest.approx([d[v] for _, v, _ in own]) and [s for _, _, s in own] == sorted(s for _, _, s in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(d)[:10]))
    assert hits >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 100))


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_by_the_forest(spark, clustered):
    """A part of each block is measured, a quarter at most, and holds nine in ten of the true neighbours."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 64))
    if clustered:
        x = np.repeat(x[:200], 30, axis=0) + 0.1 * rng.standard_normal((6000, 64))
    asked = np.arange(0, 6000, 100)
    share = 0.02 if clustered else ann.SHARE
    near = list(ann.Forest(x, ann.Hashes(x.mean(0))).candidates(x[asked], int(share * len(x))))
    assert np.mean([len(n) for n in near]) <= (0.05 if clustered else 0.25) * len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = ann.neighbours(df, F.col("vec_id") % 100 == 0, share=share, least=40, query_block=25).collect()
    hits = 0
    for q in asked.tolist():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(asked) and len(got) == 10 * len(asked)


def test_neighbours_of_many_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x[100:700] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(450, x[450].tolist())]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, least=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(100, 110)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=602, least=20).orderBy("rank").collect()
    assert sum(r.vec_id == 450 for r in got) == 2


def test_few_and_no_neighbours(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], kind)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.neighbours(spark.createDataFrame([], kind), F.col("vec_id") % 100 == 0).count() == 0


# decontamination
def test_leaks(spark, none):
    rnd = random.Random(8)
    items = [(i, samples.sentence(rnd, n)) for i, n in enumerate((15, 20, 37, 59, 5, 3))] + [(6, None), (7, ""), (8, "  ")]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")

    def edited(w, e):
        w = list(w)
        for _ in range(e):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randrange(2)] = ["zzz"] * rnd.randrange(1, 2)
        return w

    rows, want = [], {}
    for i, t in items[:5]:
        for e in (0, len(t.split()) // 5):
            n = len(rows)
            rows.append((n, f"{samples.sentence(rnd, 30)}. {' '.join(edited(t.split(), e)).upper()}! {samples.sentence(rnd, 30)}"))
            want[n] = i
    clean = len(rows)
    rows += [(clean + i, samples.sentence(rnd, 100)) for i in range(20)] + [(900, None), (901, ""), (None, items[2][1])]
    got = decontamination.find(samples.documents(spark, rows), bench, block=4)
    found = {r.doc_id: {x.item_id for x in r.leaks} for r in got.collect()}
    assert all(i in found[n] for n, i in want.items()) and found[None] == {2}
    assert not any(found[clean + i] - {4, 5} for i in range(20)) and not found[900] and not found[901]
    assert decontamination.find(none, bench).count() == 0
    assert decontamination.find(samples.documents(spark, rows), bench.limit(0)).where("size(leaks) > 0").isEmpty()


def test_leaks_by_brute_force(spark):
    """All pairs of documents and items by the edit distance of every stretch: what is found is there, and hardly any is missed."""
    rnd = random.Random(12)
    word = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(4))
    items = [[word() for _ in range(rnd.randrange(6, 26))] for _ in range(40)]
    docs = []
    for i in range(160):
        w = list(items[i % 40])
        for _ in range(rnd.randrange(len(w) // 5 + 3)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randrange(2)] = [word()] * rnd.randrange(2)
            w = w or [word()]
        docs.append([word() for _ in range(rnd.randrange(20))] + w + [word() for _ in range(rnd.randrange(20))])
    docs += docs[:5] + [items[0] * 3]  # repeated rows and ties
    want = {(d, i) for d, ws in enumerate(docs) for i, item in enumerate(items) if decontamination.edits_within(item, ws, len(item) // 5)}
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = decontamination.find(samples.documents(spark, [(d, " ".join(t)) for d, t in enumerate(docs)], False), bench, block=15).collect()
    found = {(r.doc_id, x.item_id) for r in got for x in r.leaks}
    assert found <= want and len(found) >= 0.99 * len(want) and len(want) > 100
    assert [x.item_id for x in got[0].leaks] == sorted(x.item_id for x in got[0].leaks)
    assert [(x.start, x.end) for r in got if r.doc_id == 165 for x in r.leaks if x.item_id == 0] == [(0, len(items[0]))]


def test_leaks_in_long_texts_and_of_short_items(spark):
    rnd = random.Random(13)
    long = " ".join(f"w{rnd.randrange(900)}" for _ in range(60_000))
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "w5"), (3, "w5 w6")], "item_id long, text string")
    got = decontamination.find(samples.documents(spark, [(0, f"{long} {item}"), (1, "w5 w6")], False), bench).orderBy("doc_id").collect()
    assert [[x.item_id for x in r.leaks] for r in got] == [[1], []]


def test_edit_distance_by_brute_force():
    rnd = random.Random(6)

    def full(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(last + (x != y), d[j] + 1, d[j - 1] + 1)
        return d[-1]

    for _ in range(60):
        a, b = [rnd.randrange(4) for _ in range(6)], [rnd.randrange(4) for _ in range(14)]
        got = decontamination.edits_within(a, b, 6)
        assert got[0] == min(full(a, b[s:e]) for s in range(15) for e in range(s, 15)) and full(a, b[got[1] : got[2]]) == got[0]


def test_cgk_walks_of_equal_windows_are_equal():
    ids = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6])
    out = decontamination.walk(ids, np.array([0, 6]), 18, np.array([6, 12]), np.array([7, 8], dtype=np.uint64))
    assert (out[0] == out[1]).all() and (out[:, :, -1] <= 6).all()


# classifiers
@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        w = samples.sentence(rnd, rnd.randrange(20, 120)).split()
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(f"{x}###" if bad else x for x in w)))
        labels.append((i, int(not bad), int(toxic)))
    return samples.documents(spark, rows + [(900, None), (901, ""), (None, "kalo mitu")]), spark.createDataFrame(labels + [(500, None, None)], "doc_id long, quality int, toxic int"), labels


def test_toxicity(labelled, none):
    docs, labels, known = labelled
    got = {r.doc_id: r for r in toxicity.score(docs, labels, F.col("doc_id") % 3 != 0).collect()}
    held = [(i, t) for i, _, t in known if i % 3 == 0]
    assert sum(got[i].predicted == t for i, t in held) >= 0.9 * len(held)
    assert got[900].score == got[901].score == 0 and len(got) == 243
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert toxicity.score(none, labels, F.lit(True)).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}


def test_quality(labelled, none):
    docs, labels, known = labelled
    got = {r.doc_id: r for r in quality.score(docs, labels, F.col("doc_id") % 3 != 0).collect()}
    held = [(i, q) for i, q, _ in known if i % 3 == 0]
    assert sum(got[i].predicted == q for i, q in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 243
    assert quality.score(none, labels, F.lit(True)).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_quality_with_a_repeated_id(labelled):
    """Rows of one id do not push the positives out of the sample."""
    docs, labels, known = labelled
    held = [(i, q) for i, q, _ in known if i % 3 == 0]
    again = docs.where(F.col("doc_id") == held[0][0]).crossJoin(docs.sparkSession.range(150).select()).select(docs.columns)
    got = {r.doc_id: r for r in quality.score(docs.unionByName(again), labels, F.col("doc_id") % 3 != 0, positives=300, unlabelled=300).collect()}
    assert sum(got[i].predicted == q for i, q in held) >= 0.9 * len(held)


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_gradient_of_the_risk(shift):
    """By differences: of the whole risk, and, where the risk of negatives is below zero, of its negative alone."""
    rng = np.random.default_rng(4)
    f, n, prior = rng.standard_normal(12), 5, 0.8
    f[n:] += shift
    f[:n] -= 2 * shift
    below = quality.negative_risk(f, n, prior) < 0
    assert below == (shift < 0)
    of = (lambda x: -quality.negative_risk(x, n, prior)) if below else (lambda x: quality.risk(x, n, prior))
    got = quality.risk_slope(f, n, prior)
    for i in range(12):
        step = np.zeros(12)
        step[i] = 1e-5
        assert got[i] == pytest.approx((of(f + step) - of(f - step)) / 2e-5, abs=1e-6)


def test_classifiers_on_repeated_rows_and_long_texts(labelled):
    docs, labels, _ = labelled
    spark = docs.sparkSession
    rnd = random.Random(21)
    long = samples.sentence(rnd, 40_000)
    more = samples.documents(spark, [(9000, long), (9001, f"{long} idiot scum moron idiot"), (9002, "plain words"), (9002, "plain words"), (9002, "other words")], False)
    both = docs.unionByName(more, allowMissingColumns=True)
    for score, learn in ((quality.score, F.col("doc_id") % 3 != 0), (toxicity.score, F.col("doc_id") % 5 != 0)):
        got = collections.defaultdict(set)
        for r in score(both, labels, learn).where("doc_id >= 9000").collect():
            got[r.doc_id, r.text].add(r.score)
        assert all(max(s) - min(s) < 1e-5 and 0 <= min(s) <= max(s) <= 1 for s in got.values()) and len(got) == 4


def test_gradient_of_the_network():
    net = toxicity.Network(["aa", "bb", "cc"], seed=1)
    ws = ["aa", "bb", "cc", "dd"]
    at, mask = np.array([[0, 1], [2, 3], [3, 0]]), np.array([[True, True], [True, True], [True, False]])
    y, blank = np.array([1, 0], np.float32), np.zeros(4, bool)

    def loss():
        x = net.inputs(ws, blank)[0][at] * mask[:, :, None]
        f, _ = net.run("f", x @ net.p["xf"] + net.p["bf"])
        b, _ = net.run("b", x[::-1] @ net.p["xb"] + net.p["bb"])
        z = net.pooled(np.concatenate([f, b[::-1]], axis=2), mask)[0].astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradient(ws, at, mask, y, blank)
    for name in ("xf", "ub", "a", "v", "o", "bf", "word"):
        flat, k = net.p[name].reshape(-1), int(np.abs(g[name].reshape(-1)).argmax())
        old = flat[k]
        flat[k] = old + 1e-2
        up = loss()
        flat[k] = old - 1e-2
        down = loss()
        flat[k] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[name].reshape(-1)[k]), rel=0.05, abs=1e-4)


def test_windows_overlap_and_reach_the_end():
    assert list(toxicity.window_starts(0)) == [] and list(toxicity.window_starts(5)) == [0]
    for n in range(1, 200):
        s = list(toxicity.window_starts(n))
        assert s[-1] + toxicity.WINDOW >= n and all(b - a == toxicity.STRIDE for a, b in zip(s, s[1:], strict=False))


def test_class_prior():
    rng = np.random.default_rng(0)
    p = rng.standard_normal((1500, 5)).astype(np.float32) + 2
    u = np.concatenate([rng.standard_normal((2100, 5)) + 2, rng.standard_normal((900, 5)) - 2]).astype(np.float32)[rng.permutation(3000)]
    assert quality.class_prior(p, u) == pytest.approx(0.7, abs=0.06)


# URL filter
def test_urls(spark):
    cases = [
        ("http://A.example.org/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/15", "example.org", "/en/15", "example.org/en/1", "block"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
        ("http://x.net/casino", "x.net", "/casino", None, "block"),
        ("http://x.net/casinos", "x.net", "/casinos", None, "allow"),
        ("http://x.net/bet/poker", "x.net", "/bet/poker", None, "block"),
        ("http://x.net/bet/bet", "x.net", "/bet/bet", None, "allow"),
        ("no scheme/es/", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = url_filter.judge(df).orderBy("page_id").select("host", "path", "rule", "verdict").collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_long_urls_weights_and_clashing_names(spark):
    long = "http://x.net/" + "a/" * 200_000
    urls = [long + "casino", long, "http://x.net/free/spam/cheap", "http://x.net/free/cheap", "http://x.net/free/win/bonus", "http://x.net/blog?utm_source=ref&page=2", None]
    names = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"]
    df = spark.createDataFrame([(i, u, *["x"] * 7) for i, u in enumerate(urls)], f"page_id long, url string, {', '.join(f'{n} string' for n in names)}")
    got = url_filter.judge(df).orderBy("page_id")
    assert sorted(got.columns) == sorted(["page_id", "url", *names])
    assert [(r.strict_hits, r.soft_hits, r.weight, r.verdict) for r in got.collect()] == [(1, 0, 0, "block"), (0, 0, 0, "allow"), (0, 3, 4, "block"), (0, 2, 2, "allow"), (0, 3, 3, "block"), (0, 0, 0, "allow"), (0, 0, 0, "allow")]
