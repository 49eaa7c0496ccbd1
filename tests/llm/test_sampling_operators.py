"""Whitening, importance resampling and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldspark.llm import importance, queries, sharding, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


# ---- whitening -------------------------------------------------------------

def test_factor_and_rotations_give_the_eigenvalues():
    rng = np.random.default_rng(3)
    for n, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (33, 33)):
        b = rng.normal(size=(n, rank)) * 10.0 ** rng.uniform(-4, 2, rank)
        a = b @ b.T
        g = whitening.pivoted_cholesky(a)
        assert g.shape[1] <= n and np.abs(g @ g.T - a).max() <= 1e-13 * a.diagonal().max()
        # in pivot order the factor is triangular
        order = [int(np.abs(g[:, k]).argmax()) for k in range(g.shape[1])]
        assert all(abs(g[order[i], j]) == 0 for i in range(len(order)) for j in range(i + 1, len(order)))
        values, vectors = whitening.one_sided_jacobi(g)
        assert np.all(np.diff(values) <= 0)
        want = np.linalg.eigvalsh(a)[::-1][:len(values)]
        assert np.allclose(values, want, rtol=1e-10, atol=1e-12 * want[0])
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(1.0, want[0])
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_small_eigenvalues_keep_their_digits():
    """A graded factor: an eigenvalue routine on its square loses them."""
    g = np.diag([1.0, 1e-6, 1e-11]) @ np.array([[1.0, 0, 0], [0.5, 1, 0], [0.3, 0.2, 1]])
    values, _ = whitening.one_sided_jacobi(g)
    assert np.isclose(values.prod(), (1e-6 * 1e-11) ** 2, rtol=1e-12)


def test_whitening_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = defaultdict(dict)
    for r in queries.QUERIES["op11_whitening"](spark, SF).collect():
        got[r["vec_id"]][r["component"]] = r
    x = np.array([np.floor(1024 * np.array(r["embedding"], dtype=np.float64)) + 100_000 for r in rows]).astype(np.int64)
    sums, n = x.sum(0), len(x)
    assert len(got) == n and all(sorted(c) == list(range(1, 9)) for c in got.values())
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    white = np.array([[got[r["vec_id"]][k]["whitened"] for k in range(1, 9)] for r in rows])
    want = centred @ vectors / np.sqrt(values)
    want *= np.sign((want * white).sum(0))
    assert np.abs(white - want).max() < 1e-8
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-9
    for r, row in zip(rows, x.tolist(), strict=True):
        mine = got[r["vec_id"]]
        assert mine[1]["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        assert mine[1]["n"] == n and 0 <= mine[3]["identity_error"] < 1e-9
        assert abs(mine[5]["explained"] / (values[4] / cov.trace()) - 1) < 1e-9


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(np.float32(t)) for t in rng.normal(size=3)]) for k in range(40)]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0]),
           (54, []), (55, [1.0, 2.0]), (None, good[0][1]), (0, good[0][1])]
    rows = spark.createDataFrame(good + odd, VECTORS).withColumn("whitened", F.lit("x")).withColumn("v", F.lit(1))
    model = whitening.fit(rows)
    assert model.n == 42 and len(model.values) == 3
    out = whitening.whiten(rows, model).collect()
    assert Counter(r["vec_id"] for r in out) == Counter([k for k, _ in good] + [None, 0])
    assert len({tuple(r["whitened"]) for r in out if r["vec_id"] in (None, 0)}) == 1
    assert whitening.identity_error(rows, model, 8) < 1e-9
    again = whitening.fit(rows.repartition(7))
    assert again.sums == model.sums and np.allclose(again.values, model.values, rtol=1e-12)
    empty = rows.limit(0)
    assert whitening.fit(empty).n == 0 and whitening.whiten(empty, whitening.fit(empty)).count() == 0
    # no spread at all, and spread in one direction only
    flat = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], VECTORS)
    assert whitening.whiten(flat, whitening.fit(flat)).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], VECTORS)
    assert whitening.fit(line).components.shape == (2, 1)
    # entries far beyond the usual range
    wide = spark.createDataFrame([(k, [1e30 * k, float(k)]) for k in range(4)], VECTORS)
    assert {r["deviation"] for r in whitening.whiten(wide, whitening.fit(wide)).collect()} == {None}


# ---- importance resampling -------------------------------------------------

def test_position_table_equals_crc32():
    random.seed(4)
    table = importance.PositionTable(8)
    data = bytes(random.randrange(256) for _ in range(4000)) + b"\0" * 100
    spans = [(random.randrange(3500), random.choice([1, 2, 7, 8, 9, 16, 17, 24, 333])) for _ in range(400)]
    spans += [(4000, 50), (0, 4100)]
    starts, lengths = np.array(spans).T
    got = table.checksums(np.frombuffer(data, np.uint8), starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s:s + n]) for s, n in spans]
    assert importance.position_table().checksums(np.frombuffer(data, np.uint8), starts, lengths).tolist() == got.tolist()
    assert len(table.checksums(np.zeros(1, np.uint8), np.array([], int), np.array([], int))) == 0


def brute_features(text, most, buckets):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[k:k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]
    return words, [zlib.crc32(f.encode()) % buckets for f in runs]


def brute_draw(docs, targets, most, buckets, seed, share, least):
    source, target = Counter(), Counter()
    for t in docs:
        source.update(brute_features(t[1], most, buckets)[1])
    for t in targets:
        target.update(brute_features(t, most, buckets)[1])
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
            for b in range(buckets)]
    out = []
    for number, text in docs:
        words, found = brute_features(text, most, buckets)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if number is None else number}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([number, len(words), len(found), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[:len(fit) * share[0] // share[1]]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=str)


ODD = [(None, "nobody " * 30), (900, None), (901, ""), (902, "--- !!"), (903, "w" * 70_000 + " é" * 30),
       (904, "Äpfel ÄPFEL naïve Straße 日本語 x1 " * 5), (905, "a" * 256 + " " + "b" * 257 + " " + "c" * 513),
       (906, "copy of it " * 9), (906, "copy of it " * 9), (907, "A\x00B C\u0085D " * 8)]


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_against_brute_force(spark, most):
    random.seed(6)
    words = [f"w{k}" for k in range(60)] + ["É", "ß", "Zoo"]
    docs = ODD + [(k, " ".join(random.choices(words, k=random.choice((5, 19, 20, 60))))) for k in range(150)]
    targets = [" ".join(random.choices(words[:20], k=30)) for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit("x")).repartition(5)
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    gain = importance.fit(frame, target, most=most, buckets=97)
    got = importance.resample(importance.weigh(frame, gain, most=most), 7, (25, 100), 20).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute_draw(docs, targets, most, 97, 7, (25, 100), 20)


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    gain = importance.fit(empty, empty)
    assert set(gain) == {0}
    assert importance.resample(importance.weigh(empty, gain)).count() == 0
    assert queries.QUERIES["op12_importance"](spark, SF).filter("rank is not null").count() > 0


def test_parts_of_a_batch_do_not_mix(spark, monkeypatch):
    monkeypatch.setattr(importance, "_PART", 64)
    monkeypatch.setattr(importance, "_SPANS", 3)
    texts = ["one two three", "", "four " * 40, "é"]
    bucket, owner, words = importance.features([t.encode() for t in texts], 2, 1000)
    for k, t in enumerate(texts):
        w, found = brute_features(t, 2, 1000)
        assert sorted(bucket[owner == k].tolist()) == sorted(found) and words[k] == len(w)


# ---- sharding --------------------------------------------------------------

def brute_shard(key, weights):
    bids = []
    for k, w in enumerate(weights):
        named = str(k) if key is None else f"{key}:{k}"
        u = (int(hashlib.md5(named.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        bids.append(-w / math.log(u))
    return bids.index(max(bids))


def test_rendezvous_shards_against_brute_force(spark):
    weights, added = [1.0, 2.0, 0.5, 1.5], [1.0, 3.0]
    keys = [None, "", "null", "0", *(f"k{k}" for k in range(6000))]
    rows = spark.createDataFrame([(k, "old") for k in keys], "id string, shard string").withColumn("_best", F.lit(0))
    out = sharding.assign(rows, "id", weights, added).collect()
    assert all(r["shard"] == brute_shard(r["id"], weights) for r in out)
    assert all(r["grown_shard"] == brute_shard(r["id"], weights + added) for r in out)
    assert all(r["grown_shard"] in (r["shard"], 4, 5) for r in out)
    share = Counter(r["shard"] for r in out)
    assert all(abs(share[k] / len(out) - w / 5) < 0.03 for k, w in enumerate(weights))
    moved = sum(r["grown_shard"] >= 4 for r in out) / len(out)
    assert abs(moved - 4 / 9) < 0.03
    # a raised weight takes records, and gives none away
    raised = sharding.assign(rows, "id", [1.0, 2.0, 2.5, 1.5]).collect()
    before = {r["id"]: r["shard"] for r in out}
    assert all(r["shard"] in (before[r["id"]], 2) and r["grown_shard"] == r["shard"] for r in raised)
    with pytest.raises(ValueError):
        sharding.assign(rows, "id", [1.0, 0.0])


def test_slots_are_gapless_for_any_blocks(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("doc_id"),
        F.lit("x").alias("slot"), F.lit(1).alias("_row"), F.lit(2).alias("_block"))
    placed = sharding.assign(rows, "doc_id", [1.0] * 4, [1.0])
    for block in (10, 100_000):
        got = sharding.numbered(placed, ["doc_id"], block_rows=block)
        slots = defaultdict(list)
        for r in got.collect():
            slots[r["shard"]].append(r["slot"])
        assert sum(map(len, slots.values())) == 4000
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert got.columns == ["doc_id", "_row", "_block", "shard", "grown_shard", "slot"]
    # a third of all rows under one key does not make one window
    heaviest = (sharding.numbered(placed, ["doc_id"], block_rows=10).filter("doc_id is null").count())
    assert heaviest == 1334


def test_sharding_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "é" * 3), (2, ""), (3, "long " * 100_000)],
                                 "doc_id long, text string").withColumn("size", F.lit("clash"))
    sized = sharding.sizes(rows)
    got = {(r["doc_id"], r["size"], r["text_crc32"]) for r in sized.collect()}
    assert got == {(1, 1, 0), (None, 7, zlib.crc32("ééé".encode())), (2, 1, 0),
                   (3, 500_001, zlib.crc32(b"long " * 100_000))}
    out = sharding.numbered(sharding.assign(sized, "doc_id", [1.0] * 3), ["doc_id"])
    assert out.count() == 5
    sharding.write(out, str(tmp_path / "shards"), rows_per_file=1)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select("doc_id", "shard", "slot").exceptAll(out.select("doc_id", "shard", "slot")).count() == 0
    empty = sharding.numbered(sharding.assign(sized.limit(0), "doc_id", [1.0]), ["doc_id"])
    assert empty.count() == 0


def test_sharding_runs_without_python_workers(spark):
    plan = queries.QUERIES["op13_sharding"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# ---- the packer's piece table ----------------------------------------------

@pytest.mark.parametrize("limit", [20, 100_000])
def test_joined_table_equals_the_library(limit):
    import public_tokenizers
    from tokenizers import Tokenizer

    from foldspark.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    random.seed(9)
    bits = ["a", "the", "Xy", "é", "日本", "\n", "\t", " ", "  ", "\r\n", "'s", "don't", "12", "3.5", "...", "!)", " ",
            " ", "<|endoftext|>", "🙂", "́", "_", "#", "\x00", "　", "-", "'", "word,"]
    texts = ["".join(random.choices([*bits, *[" "] * 12], k=random.choice((0, 1, 3, 30)))) for _ in range(4000)]
    texts += [None, "", " ", "  ", "a ", " a", "a\n", "a\n b", "x" * 5000, "x " * 5000, ("y" * 70 + " ") * 50]
    table = packing._tokenizer_table(path, limit)
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        column = pa.array([None, *part], pa.string()).slice(1)
        want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert table.encode(column) == want == table.encode(column)
    assert len(table._young) <= limit + 200 and table.encode(pa.array([], pa.string())) == []
