"""Operators over whole tables against brute force, and the pipeline."""

import collections
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foldspark.llm import chat, golay, masked_lm, queries, simhash, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"


# ---- near duplicates -------------------------------------------------------

def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Lowest index of each print's component, links at four bits or fewer."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_golay_keys_meet_within_two_bits():
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    codes, valid = golay.keys(words)
    assert set(valid.sum(axis=1).tolist()) == {1, 6}
    random.seed(0)
    for bits in (1, 2):
        near = np.array([w ^ sum(1 << b for b in random.sample(range(23), bits)) for w in words.tolist()])
        other, fine = golay.keys(near)
        assert all(set(a[v].tolist()) & set(b[w].tolist())
                   for a, v, b, w in zip(codes, valid, other, fine, strict=True))


def test_linked_prints_share_a_key():
    random.seed(1)
    base = np.array([random.getrandbits(64) for _ in range(400)], dtype=np.uint64)
    for bits in range(5):
        flip = np.array([sum(1 << b for b in random.sample(range(64), bits)) for _ in base], dtype=np.uint64)
        keys, rows = simhash.keys_of(np.concatenate([base, base ^ flip]))
        found = collections.defaultdict(set)
        for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
            found[r].add(k)
        assert all(found[k] & found[k + len(base)] for k in range(len(base)))


@pytest.mark.parametrize("tile", [4096, 5])
def test_links_connect_what_brute_force_connects(spark, tile):
    random.seed(2)
    prints = [random.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for _ in range(random.choice([0, 1, 12])):
            prints.append(random.choice([p, prints[-1]]) ^ sum(1 << b for b in random.sample(range(64), random.randint(1, 5))))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    place = {s: k for k, s in enumerate(signed)}
    want = brute_components(prints)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "print long"), tile).collect():
        x, y = find(place[r["a"]]), find(place[r["b"]])
        root[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(prints))] == want


def test_simhash_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [brute_print(texts[k]) for k in ids]
    component = dict(zip(ids, (ids[k] for k in brute_components(prints)), strict=True))
    rows = queries.QUERIES["op6_simhash"](spark, SF).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert r["fingerprint"] == f"{prints[ids.index(r['doc_id'])]:016x}"
        assert r["component_id"] == component[r["doc_id"]]


def test_simhash_odd_rows_and_deduplication(spark):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [(5, "One two THREE four five", "a"), (2, "one two three four five", "b"), (None, "one two three four five", "c"),
            (9, None, "d"), (8, "", "e"), (7, " \n", "f"), (7, " \n", "f"), (None, "alone here", "g"), (None, "alone here", "g"),
            (3, long, "h"), (4, long + " end", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _number string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {
        (5, 2), (2, 2), (None, 2), (9, 7), (8, 7), (7, 7), (None, None), (3, 3), (4, 3)}
    kept = sorted(((r["doc_id"], r["_number"]) for r in simhash.deduplicate(docs).collect()), key=str)
    assert kept == sorted([(2, "b"), (7, "f"), (None, "g"), (3, "h")], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.deduplicate(docs.limit(0)).count()


# ---- top-k search ----------------------------------------------------------

def test_topk_against_brute_force(spark):
    random.seed(4)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 8))
    vectors = [(centres[k % 6] + rng.normal(0, 0.2, 8)).tolist() for k in range(3000)]
    for k in range(1000):
        vectors[3 * k] = vectors[0]  # one vector is a third of all
    rows = list(enumerate(vectors)) + [(5000, None), (5050, [1.0, None, 2.0] + [0.0] * 5), (5100, [float("nan")] * 8),
                                       (5150, [float("inf")] * 8), (None, vectors[1]), (5200, [0.5, -0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.search(topk.integer_vectors(table, "vec_id", "embedding", 256), F.col("id") % 50 == 0, 5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = {k: np.floor(256 * np.array(v + [0.0] * (8 - len(v)))).astype(int) for k, v in [*enumerate(vectors), (5200, [0.5, -0.5])]}
    ids = np.array(list(fine))
    matrix = np.array(list(fine.values()))
    assert set(got) == {k for k in fine if k % 50 == 0}
    for q, found in got.items():
        scores = matrix @ fine[q]
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:5]
        assert sorted(found) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    few = topk.integer_vectors(table.filter("vec_id in (50, 51)"), "vec_id", "embedding", 256)
    assert [r["vec_id"] for r in topk.search(few, F.col("id") % 50 == 0, 5).collect()] == [51]
    assert topk.search(few.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_topk_never_broadcasts_its_visits(spark):
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(0, 1, (12000, 16)).tolist())],
                                  "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # room for the queries, not for the blocks
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        found = topk.search(topk.integer_vectors(table, "vec_id", "embedding", 256), F.col("id") % 50 == 0, 5)
        found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    above = []  # operators over a line of the plan, by depth
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*|"))
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        if "MapInArrow" in line:
            assert not any("BroadcastExchange" in x for _, x in above[:-1])
    assert "MapInArrow" in plan


def test_topk_best_cells_and_integer_kinds():
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 12, (50, 40)).astype(np.float64)
    least = rng.integers(0, 14, 50)
    scores[3, :38] = -np.inf
    i, j = topk._best(scores, least, 5)
    for q in range(50):
        fit = sorted((-s, c) for c, s in enumerate(scores[q].tolist()) if s >= least[q])
        assert j[i == q].tolist() == [c for _, c in fit[:5]]
    assert [topk._narrowest(*r) for r in ((-128, 0), (0, 128), (-(1 << 15) - 1, 0), (0, 1 << 31))] == ["<i1", "<i2", "<i4", "<i8"]


def test_topk_with_components_of_64_bits(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-(1 << 33), 1 << 33, (1200, 3)) >> rng.integers(0, 30, (1200, 1))
    table = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "id long, v array<long>")
    got = collections.defaultdict(list)
    for r in topk.search(table, F.col("id") % 400 == 0, 3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    with np.errstate(over="ignore"):
        for q in (0, 400, 800):
            scores = (vectors @ vectors[q]).tolist()
            assert got[q] == sorted((-s, k) for k, s in enumerate(scores) if k != q)[:3]


# ---- URL filter ------------------------------------------------------------

def test_urls_are_cut_and_ruled(spark):
    cases = {None: ("", "", None), "no scheme/x": ("", "", None), "http://A.example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/"),
             "https://org": ("org", "", None), "x://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"),
             "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/"), "a://b.com?u=c://d.com/fr/": ("b.com", "", None),
             "http://é.com/fr/ab#x": ("é.com", "/fr/ab", "com/fr/"), "http://b.com/de/": ("b.com", "/de/", "com/de/"),
             "http://casino-win.example.net/x\ny": ("casino-win.example.net", "/x\ny", None)}
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate([*cases, *cases])],
                                  "page_id long, url string, html string, verdict string")
    rows = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(rows) == 2 * len(cases)
    wanted = list(cases.values()) * 2
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == wanted[r["page_id"]]
        if r["rule"]:
            assert r["verdict"] == next(x.action for x in queries.URL_RULES if x.name == r["rule"])
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_segmentation_and_verdicts(spark):
    counts = {"red": 50, "garden": 40, "gar": 1, "den": 2, "the": 100, "ther": 1}
    assert url_filter.split_words("redgarden", counts, 300) == ["red", "garden"]
    assert url_filter.split_words("zzz", counts, 300) == ["zzz"]
    hosts = [f"{w}garden{k}.example.com" for k, w in enumerate(["red", "blue", "green", "old"] * 100)]
    rows = [(k, f"http://{h}/en/{k}", f"<title>the {h[:3]} garden</title>") for k, h in enumerate(hosts)]
    rows += [(1000, "http://freecasinobonus.example.com/en/1", None), (1001, "http://redgarden.example.com/en/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, []).collect()}
    assert verdict[1000] == "block" and {v for k, v in verdict.items() if k != 1000} == {"allow"}


def test_path_names_are_segmented(spark):
    rows = [(k, f"http://host{k % 7}.example.com/{'red-garden' if k % 2 else 'news'}/{k}", "<title>the garden</title>")
            for k in range(400)]
    rows += [(1000, "http://host1.example.com/freecasinobonus/1", None), (1001, "http://host1.example.com/redgarden/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, []).collect()}
    assert verdict[1000] == "block" and {v for k, v in verdict.items() if k != 1000} == {"allow"}


def test_split_words_against_all_splits():
    rng = random.Random(4)
    for _ in range(60):
        counts = {"".join(rng.choices("ab", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(6)}
        run, total = "".join(rng.choices("ab", k=rng.randint(1, 9))), 200

        def cost(words, counts=counts):
            return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)
                       for w in words)
        splits = []
        for mask in range(1 << (len(run) - 1)):
            ends = [k + 1 for k in range(len(run) - 1) if mask >> k & 1]
            splits.append([run[i:j] for i, j in zip([0, *ends], [*ends, len(run)], strict=True)])
        found = url_filter.split_words(run, counts, total)
        assert "".join(found) == run and abs(cost(found) - max(map(cost, splits))) < 1e-9


def test_verdicts_like_plain_bayes(spark):
    """Word counts, splits and naive Bayes over all pages in plain code."""
    sf = "/root/testdata/sf0.01"
    pages = [(r["url"] or "", r["html"] or "") for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    rules, letters = queries.URL_RULES, r"[^\W\d_]+"
    found = [re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u) for u, _ in pages]
    hosts, paths = [m[1].lower() if m else "" for m in found], [m[2] if m else "" for m in found]
    counts, single = collections.Counter(), collections.defaultdict(list)
    for (_, html), host, path in zip(pages, hosts, paths, strict=True):
        title = re.search(r"(?is)<title[^>]*>(.*?)</title", html)
        counts.update(re.findall(letters, title[1].lower()) if title else [])
        counts.update(w for x in host.split(".") if "-" in x for w in re.findall(letters, x))
        for name in path.split("/"):
            words = re.findall(letters, name.lower())
            counts.update(words if len(words) > 1 else [])
            if len(words) == 1:
                single[words[0]].append(host)
    for w, at in single.items():
        counts[w] += len(at) if len(set(at)) >= url_filter.COMMON_HOSTS else 0
    counts = {w: n for w, n in counts.items() if n and len(w) <= url_filter.LONGEST_WORD}
    usual = max(1, round(sum(counts.values()) / len(counts)))
    total = sum(counts.values()) + usual * len(url_filter.SEEDS)
    for s in url_filter.SEEDS:
        counts[s] = counts.get(s, 0) + usual
    tokens, classes = [], []
    for host, path in zip(hosts, paths, strict=True):
        runs = re.findall(letters, host) + re.findall(letters + "|0", re.sub(r"\d+", "0", path.lower()))
        tokens.append([w for r in runs for w in url_filter.split_words(r, counts, total)])
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        classes.append(max(fits, key=lambda r: len(r.name)).action if fits else None)
    n, by = collections.Counter(), {"block": collections.Counter(), "allow": collections.Counter()}
    for ts, c in zip(tokens, classes, strict=True):
        n.update(ts)
        if c:
            by[c].update(ts)
    overall = {t: (n[t] + 0.5) / (sum(n.values()) + 0.5 * (len(n) + 1)) for t in n}

    def odds(t):
        def share(c):
            return (by[c][t] + url_filter.SMOOTHING * overall[t]) / (sum(by[c].values()) + url_filter.SMOOTHING)
        a, p = url_filter.ALL_SHARE, url_filter.SEED_PART
        seed = (t in url_filter.SEEDS) / len(url_filter.SEEDS)
        return math.log(((1 - a) * share("block") + a * (p * seed + (1 - p) * overall[t]))
                        / ((1 - a) * share("allow") + a * overall[t]))
    prior = math.log(url_filter.BLOCKED_PRIOR / (1 - url_filter.BLOCKED_PRIOR))
    rows = queries.QUERIES["op4_url_filter"](spark, sf).orderBy("page_id").collect()
    assert len(rows) == len(pages)
    for r, ts, c, host, path in zip(rows, tokens, classes, hosts, paths, strict=True):
        wanted = prior + sum(map(odds, ts))
        assert (r["host"], r["path"]) == (host, path) and abs(r["odds"] - wanted) < 1e-6
        assert r["verdict"] == (c or ("block" if r["odds"] > 0 else "allow"))


# ---- chat ------------------------------------------------------------------

def brute_viterbi(symbols, model):
    scores, backs = [model.start[r] + model.show[r][symbols[0]] for r in range(chat._N)], []
    for s in symbols[1:]:
        back = [max(range(chat._N), key=lambda r, j=j: scores[r] + model.change[r][j]) for j in range(chat._N)]
        scores = [scores[back[j]] + model.change[back[j]][j] + model.show[j][s] for j in range(chat._N)]
        backs.append(back)
    out = [max(range(chat._N), key=lambda r: scores[r])]
    for back in reversed(backs):
        out.append(back[out[-1]])
    return out[::-1]


def test_chat_query_finds_roles(spark):
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in
             spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()}
    rows = queries.QUERIES["op2_chat_roles"](spark, "/root/testdata/sf0.01").collect()
    right = [r["role"] == truth[r["conv_id"], r["turn"]] for r in rows]
    assert sum(right) / len(right) > 0.9


def test_blocks_decode_like_one_sequence(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    monkeypatch.setattr(chat, "FAN", 3)
    random.seed(6)
    rows = []
    for conv, turns in ((1, 60), (2, 3), (3, 1), (None, 2)):
        for turn in range(turns):
            role = chat.ROLES[1 + turn % 2]
            mark = random.choice([f"{role}: ", "", ""])
            rows.append((conv, turn, role, mark + "\n".join("x" * random.choice([10, 90, 200]) for _ in range(random.randint(1, 4)))))
    rows += [(4, 0, None, None), (4, None, "user", ""), (4, 0, "user", "user: a")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = chat.observed(chat.lines_of(talk, "conv_id", "text", "turn", "role"))
    model = chat.fit(lines)
    found = collections.defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: (r["id"], r["turn"], r["line"], r["text"])):
        found[r["id"]].append(r["symbol"])
    got = collections.defaultdict(list)
    for r in chat.parse(lines, model).collect():
        got[chat._NO_ID if r["id"] is None else r["id"]].append(
            (-1 if r["turn"] is None else r["turn"], r["line"], chat.ROLES.index(r["role"]), r["new_turn"], r["rendered"]))
    assert set(got) == set(found)
    for key, symbols in found.items():
        want = sorted((s // 2, s % 2 == 0) for s in brute_viterbi(symbols, model))
        assert sorted((x[2], x[3]) for x in got[key]) == want
        if key in (1, 2, 3):  # no two lines of one place
            assert [(x[2], x[3]) for x in sorted(got[key])] == [(s // 2, s % 2 == 0) for s in brute_viterbi(symbols, model)]
        for x in got[key]:
            assert x[4].startswith(f"<|{chat.ROLES[x[2]]}|>\n") == x[3]
    assert chat.parse(lines.limit(0), model).count() == 0


def test_chat_blocks_by_lines(spark):
    """A text of many lines, negative turns, a hot null id of repeated rows, and
    columns with the operator's own names."""
    rows = [(7, -3, "user", "user: " + "\n".join("word" for _ in range(3000))), (7, -2, "assistant", "bot: yes"),
            (8, -5, "user", "user: a?"), (8, 0, "assistant", "b")]
    rows += [(None, None, "user", "user: again")] * 500
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("odd") for c in ("place", "block", "_number", "symbol", "id")}).repartition(4)
    lines = chat.observed(chat.lines_of(talk, "conv_id", "text", "turn", "role"))
    blocks = chat._in_blocks(lines).groupBy("id", "block").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("p"))
    assert blocks.agg(F.max("n")).first()[0] == chat.BLOCK
    assert blocks.filter("id = 7").agg(F.max("p")).first()[0] == 3000
    model = chat.fit(lines)
    got = chat.parse(lines, model).collect()
    assert len(got) == 3000 + 1 + 2 + 500
    long_text = sorted((r["turn"], r["line"], r["role"], r["new_turn"]) for r in got if r["id"] == 7)
    assert [r[:2] for r in long_text] == [(-3, k) for k in range(3000)] + [(-2, 0)]
    symbols = [r["symbol"] for r in lines.filter("id = 7").orderBy("turn", "line").collect()]
    assert [(chat.ROLES.index(r[2]), r[3]) for r in long_text] == [
        (s // 2, s % 2 == 0) for s in brute_viterbi(symbols, model)]
    assert {r["turn"] for r in got if r["id"] == 8} == {-5, 0}
    assert [r["turn"] for r in got if r["id"] is None] == [None] * 500


# ---- masked language model -------------------------------------------------

def test_language_model_prefers_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text") < 5000)
    train, held = docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 7 = 0")
    vocab, flat = masked_lm.fit(train)
    random.seed(8)
    shuffled = [(r["doc_id"], " ".join(random.sample(r["text"].split(), len(r["text"].split())))) for r in held.collect()]

    def mean(frame):
        x = masked_lm.score(frame, vocab, flat).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
        return x
    assert mean(held) > mean(spark.createDataFrame(shuffled, "doc_id long, text string"))


def test_language_model_gradient_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    net = masked_lm.Network()
    texts = [rng.integers(0, masked_lm.EDGE, n).astype(np.uint16) for n in (9, 0, 11)]
    (padded, at), = masked_lm.windows(texts, 20)
    target = rng.integers(0, masked_lm.CLASSES, 20)
    grad = net.gradient(padded, at, target)

    def loss(flat):
        return -masked_lm.Network(flat).log_probabilities(padded, at, target).mean()
    for k in rng.choice(np.flatnonzero(abs(grad) > 1e-3), 8):
        step = np.zeros_like(net.flat)
        step[k] = 1e-2
        assert abs((loss(net.flat + step) - loss(net.flat - step)) / 2e-2 - grad[k]) < 2e-3
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "word " * 50_000), (3, "word " * 50_000)],
                                 "doc_id long, text string")
    out = {r["doc_id"]: r for r in masked_lm.score(rows, *masked_lm.fit(rows)).collect()}
    assert out[1]["n_words"] == 0 and out[2]["log_likelihood"] == 0 and out[1]["mean_log_likelihood"] is None
    assert out[3]["n_words"] == 50_000 and out[None]["log_likelihood"] < 0
    assert masked_lm.score(rows.limit(0), *masked_lm.fit(rows.limit(0))).count() == 0


def plain_language_model(texts):
    """Counts, symbols and classes of all words by a plain pass."""
    counts = collections.Counter(w for t in texts for w in masked_lm.words_of((t or "").encode()))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    return counts, {w: k for k, w in enumerate(order[:masked_lm.SINGLE_SYMBOLS])}


def test_language_model_counts_and_scores_like_plain_code(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("symbols", F.lit("x"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    monkeypatch.setattr(masked_lm, "PART_BYTES", 20_000)
    vocab, flat = masked_lm.fit(docs)
    counts, single = plain_language_model(texts.values())
    table = {bytes(r["word"]): (r["n"], r["symbol"]) for r in vocab.table.collect()}
    assert {w: n for w, (n, _) in table.items()} == counts
    assert {w: s for w, (_, s) in table.items() if s < masked_lm.SINGLE_SYMBOLS} == single
    shared = [(counts[w], s) for w, (_, s) in table.items() if s >= masked_lm.SINGLE_SYMBOLS]
    assert all(s < masked_lm.UNKNOWN for _, s in shared)
    # rarer words have later symbols, up to words of one band
    assert all(not (m > 2 * n and s > t) for n, t in shared[:400] for m, s in shared[:400])
    mass = np.zeros(masked_lm.CLASSES)
    for n, s in table.values():
        mass[vocab.classes[s]] += n
    mass[vocab.classes[masked_lm.UNKNOWN]] += 1
    assert np.allclose(np.log(mass[vocab.classes[:masked_lm.EDGE]]), vocab.log_mass[:masked_lm.EDGE])
    # words of their own class, the others in classes of about equal mass
    assert (vocab.classes[:masked_lm.SINGLE_CLASSES] == np.arange(masked_lm.SINGLE_CLASSES)).all()
    wide = mass[masked_lm.SINGLE_CLASSES:]
    assert wide.max() < 2 * wide.mean() and wide.min() > 0.5 * wide.mean()
    odd = spark.createDataFrame([(-1, "never seen words zzzyx"), (-2, "")], "doc_id long, text string")
    rows = masked_lm.score(docs.select("doc_id", "text").unionByName(odd), vocab, flat).collect()
    assert len(rows) == len(texts) + 2
    texts.update({-1: "never seen words zzzyx", -2: ""})
    net, edge = masked_lm.Network(flat), masked_lm.EDGE
    for r in rows:
        words = masked_lm.words_of((texts[r["doc_id"]] or "").encode())
        own = [table.get(w, (1, masked_lm.UNKNOWN)) for w in words]
        symbols, total = [s for _, s in own], 0.0
        for at, (n, s) in enumerate(own):
            hidden = net.hidden.astype(float)
            for k, o in enumerate((-3, -2, -1, 1, 2, 3)):
                near = symbols[at + o] if 0 <= at + o < len(symbols) else edge
                hidden = hidden + net.embed[near] * (1 + net.place[k])
            logits = np.tanh(hidden) @ net.out + net.bias
            total += logits[vocab.classes[s]] - np.log(np.exp(logits).sum()) + np.log(n / mass[vocab.classes[s]])
        assert r["n_words"] == len(words)
        assert abs(r["log_likelihood"] - total) < 1e-3 * max(1, len(words))


def test_language_model_trains_on_every_word_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 900, n).astype(np.uint16) for n in (0, 1, 5, 0, 3000, 2, 0)]
    for size in (7, 1000, 10_000):
        found = list(masked_lm.windows(texts, size))
        assert all(len(at) <= size for _, at in found)
        assert np.array_equal(np.concatenate([p[at] for p, at in found]), np.concatenate(texts))
        around = np.concatenate([p[at[:, None] + [-3, -2, -1, 1, 2, 3]] for p, at in found])
        wanted = []
        for t in texts:
            wide = [masked_lm.EDGE] * 3 + t.tolist() + [masked_lm.EDGE] * 3
            wanted += [[*wide[k:k + 3], *wide[k + 4:k + 7]] for k in range(len(t))]
        assert around.tolist() == wanted
    assert list(masked_lm.windows([texts[0]], 7)) == []


def test_word_numbers_pack_and_unpack():
    for ids in ([], [0], [65535, 65536, 1 << 31, 7, (1 << 32) - 1]):
        assert masked_lm.unpack(masked_lm.pack(np.array(ids, np.uint32))).tolist() == ids


def test_language_model_one_pass_equals_fit_then_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    both = {r["doc_id"]: r for r in masked_lm.fit_and_score(docs).collect()}
    vocab, flat = masked_lm.fit(docs)
    again = {r["doc_id"]: r for r in masked_lm.score(docs, vocab, flat).collect()}
    assert both.keys() == again.keys()
    for k, r in both.items():
        assert r["n_words"] == again[k]["n_words"]
        # tasks may hold other documents, so the averaged weights differ a little
        assert abs((r["mean_log_likelihood"] or 0) - (again[k]["mean_log_likelihood"] or 0)) < 0.5


# ---- pipeline --------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("stats", F.lit("x"))
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near duplicates", "secrets", "packing"]
    before, tables = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, before, sf))
        if name != "packing":
            assert after.columns == docs.columns
        tables.append((name, before, after))
        before = after
    ids = {name: {r["doc_id"] for r in a.select("doc_id").collect()} for name, _, a in tables}
    judged = {r["doc_id"]: r for r in queries.QUERIES["op7_quality_rules"](spark, sf).collect()}
    assert ids["quality rules"] == {k for k, r in judged.items() if r["kept"]}
    good = {k for k, x in labels.items() if x["toxic"] == 0} & ids["quality rules"]
    assert len(good - ids["toxicity"]) <= 0.02 * len(good)
    groups = collections.defaultdict(set)
    for r in simhash.near_duplicates(tables[2][1]).collect():
        groups[r["component_id"]].add(r["doc_id"])
    assert ids["near duplicates"] == set(groups) == {min(g) for g in groups.values()}
    from foldspark.llm.secret_scan import find
    for r in tables[3][2].collect():
        assert not find(r["text"]) and r["n_chars"] == len(r["text"])
    assert ids["packing"] == ids["secrets"] == ids["near duplicates"]


def test_toxicity_stage_drops_planted_rows(spark):
    """Rows like the labelled toxic ones go, clean ones stay."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = docs.filter("doc_id in (1, 7, 9, 15)").collect()
    planted = [(10_000 + k, t["text"] + " scum idiot moron worthless pathetic", "en", "x", 1) for k, t in enumerate(clean)]
    more = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    left = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, more, sf).collect()}
    assert not {p[0] for p in planted} & left and {1, 7, 9, 15} <= left
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights == ()


def test_pipeline_near_duplicates_are_those_of_brute_force(spark):
    """Copies with scattered edits, exact copies, null and empty texts."""
    random.seed(12)
    words = [f"w{k}" for k in range(3000)]
    rows = [(None, " ".join(random.choices(words, k=120))), (5, None), (6, " "), (7, "two words"), (8, "Two  words"),
            (3, "same id " * 9), (3, "same id " * 9)]
    for group in range(60):
        base = random.choices(words, k=random.choice((40, 150, 400)))
        for copy in range(4):
            edited = list(base)
            for at in random.sample(range(len(base)), copy * len(base) // 200):
                edited[at] = random.choice(words)
            rows.append((100 + 10 * group + copy, " ".join(edited)))
    random.shuffle(rows)
    root = brute_components([brute_print(t) for _, t in rows])
    groups = collections.defaultdict(list)
    for (number, _), at in zip(rows, root, strict=True):
        groups[at].append((number is None, number))
    want = sorted(min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values() if not min(g)[0])
    assert 60 < len(want) < 180
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.simhash_stage(spark, docs, SF).collect()
    assert sorted((False, r["doc_id"]) for r in left if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in left) == 1


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_on_odd_rows(spark, stage):
    """Null ids, null, empty and very long texts, repeated rows and clashing
    columns pass through every stage; an empty table stays empty."""
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    odd = [(None, None), (None, None), (9001, ""), (9001, ""), (9002, None), (None, " word" * 3),
           (9003, "The river ran past the old mill and on. " * 6000), (9004, plain[0]["text"]), (9004, plain[0]["text"])]
    rows = [(r["doc_id"], r["text"]) for r in plain] + odd
    docs = (spark.createDataFrame(rows, "doc_id long, text string")
            .withColumns({c: F.lit("x") for c in ("kept", "score", "stats", "spans", "print", "key", "lowest")}))
    out = run(spark, docs, SF)
    ids = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
    given = collections.Counter(k for k, _ in rows)
    assert set(ids) <= set(given)
    if stage == "packing":
        assert set(ids) == set(given)
    else:
        assert out.columns == docs.columns and all(ids[k] <= given[k] for k in ids)
    if stage == "secrets":
        assert ids == given
        assert out.filter("text is null").count() == 0 or out.filter("text is null").count() == 3
    if stage == "toxicity":
        assert all(ids[k] == given[k] for k in (None, 9001, 9002, 9003))
    if stage == "quality rules":
        assert not {9001, 9002, None} & set(ids)
    if stage == "near duplicates":
        assert ids[9001] + ids[9002] + ids[None] <= 2 and ids[9004] == 0 and ids[9003] == 1
    assert run(spark, docs.limit(0), SF).count() == 0
