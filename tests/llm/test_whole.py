"""Operators, queries and the pipeline against independent brute force over all rows."""

import hashlib
import itertools
import math
import resource
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import ann, chat, lines, mix, pivots, queries, simhash, sketches, suffixes, toxicity, urls

DOCS = "doc_id long, text string, source string"
SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def some_words(n, seed, kinds=26):
    return [chr(97 + int(k)) * 2 for k in np.random.default_rng(seed).integers(0, kinds, n)]


def tied(pairs):
    """The smallest member of each group that pairs connect."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return top


# op1

def test_large_ids_beside_a_null_one_stay_apart(spark):
    rows = [(2**53, 0, "user", "a"), (2**53 + 1, 0, "user", "b"), (None, 0, "assistant", "c"), (None, 1, None, None)]
    made = chat.digests(chat.render(chat.fold(chat.logged(chat.numbered(spark.createDataFrame(rows, TURNS)))))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in made} == {2**53: (1, 0), 2**53 + 1: (1, 0), None: (2, 1)}


def test_rows_that_tie_or_lack_a_turn_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (1, None, "user", "z"), (1, None, None, None), (2, 5000, "user", ""), (2, 3, "assistant", None), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, TURNS)
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    made = chat.digests(chat.render(chat.fold(chat.logged(chat.numbered(df, ranges=3)), block=2), block=2)).collect()
    assert {r["conv_id"]: r["n_turns"] for r in made} == {c: len(t) for c, t in want.items()}
    for r in made:
        turns = want[r["conv_id"]]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_op1_is_all_conversations_and_the_probe(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    turns = defaultdict(list)
    for conv, turn, role, text in sorted([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)], key=lambda r: (r[0], r[1])):
        turns[conv].append((role, text or ""))
    got = {r["conv_id"]: r for r in queries.op1_chat_format(spark, SMALL).collect()}
    assert set(got) == set(turns)
    for conv, each in turns.items():
        masked = "".join(t for role, t in each if role == "assistant")
        assert got[conv]["n_turns"] == len(each)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in each).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert got[-7]["loss_chars"] == len(said) and got[-7]["formatted_chars"] > 2 * len(said)


def test_a_long_turn_is_read_back_in_memory_of_its_size():
    text = "a: b </turn> \\ ### " * 500_000  # 10 MB
    formatted = f"### user: {chat.escape(text)}</turn>\n"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    turns, _ = chat.read(formatted, [])
    assert turns == [("user", text)] and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 20 * len(text)


# op2

def test_fingerprints_are_the_majority_of_shingle_hashes(spark):
    import xxhash

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op2_simhash(spark, SMALL).collect()}
    want = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\x09\x0a\x0b\x0c\x0d":
            low = low.replace(c, " ")
        parts = [w for w in low.split(" ") if w]
        shingles = [" ".join(parts[k : k + 3]) for k in range(max(1, len(parts) - 2))] if parts else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {i: f for i, (f, _) in got.items()} == want
    top = tied((a, b) for a, b in itertools.combinations(sorted(want), 2) if (want[a] ^ want[b]).bit_count() <= 2)
    assert {i: c for i, (_, c) in got.items()} == {i: top(i) for i in want}


def test_rows_that_share_an_id_are_linked_by_their_texts_alone(spark):
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen", "fifteen sixteen seventeen eighteen")
    rows = [(1, a), (5, a), (1, b), (9, b), (0, c), (0, d), (4, d), (None, a)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3).collect()
    where = {x: simhash._fingerprint(x, 3, 42) for x in (a, b, c, d)}
    assert min(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in itertools.combinations(where.values(), 2)) > 2
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in got) == sorted([(False, 1, 1), (False, 5, 1), (True, 0, 1), (False, 1, 1), (False, 9, 1), (False, 0, 0), (False, 0, 0), (False, 4, 0)])
    assert {(r["fingerprint"], r["component_id"]) for r in got} == {(f"{where[x] & (1 << 64) - 1:016x}", k) for x, k in ((a, 1), (b, 1), (c, 0), (d, 0))}


# op3 and op8

def test_rows_of_one_id_that_are_queries_have_results_of_their_own(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(40, 4)), 2)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(0, (v[0] + 3).tolist()), (0, (v[0] + 3).tolist()), (20, v[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vec, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    for made, x in ((pivots.search(df, every=20, k=5, pivots=4, sample=20, block_rows=16, chunk_rows=2), np.floor(vec * 256)), (ann.search(df, every=20, k=5, sample=40, leaf=8, recall=1.0), vec)):
        got = sorted((r["query_id"], r["rank"], round(r["score"], 6)) for r in made.collect())
        want = []
        for q in np.flatnonzero(ids % 20 == 0):
            s = np.delete(x @ x[q], q)
            want += [(int(ids[q]), k + 1, round(float(y), 6)) for k, y in enumerate(np.sort(s)[::-1][:5])]
        assert got == sorted(want)


@pytest.mark.parametrize("size", [2.0**12, 2.0**20, 2.0**22.4])
def test_scores_are_exact_at_any_size_that_a_long_holds(spark, size):
    rng = np.random.default_rng(4)
    v = rng.uniform(-size, size, size=(90, 4))
    v[60:] = np.nextafter(v[:30], np.inf)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in pivots.search(df, every=9, k=5, pivots=5, sample=50, block_rows=16, chunk_rows=4).collect()}
    whole = [[math.floor(256 * y) for y in x] for x in v]
    for q in range(0, 90, 9):
        order = sorted((-sum(a * b for a, b in zip(whole[q], whole[k])), k) for k in range(90) if k != q)
        assert [got[q, r + 1] for r in range(5)] == [(k, -s) for s, k in order[:5]]


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(k, [2.0**30 + k, 2.0**30]) for k in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        pivots.search(df, every=1, k=2).collect()
    with pytest.raises(Exception, match="beyond a long"):
        pivots.search(spark.createDataFrame([(0, [1e200]), (1, [0.0])], "vec_id long, embedding array<double>"), every=1, k=2).collect()


def test_searches_with_ties_repeats_and_clashing_names(spark):
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=(300, 6)), 1)
    v[50:150] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(7, [float(x) for x in v[0]]), (7, [float(x) for x in v[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "v", "q", "qid", "cell", "near", "part", "chunk", "t", "floor", "score", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    top = pivots.search(df, every=50, k=5, pivots=5, sample=64, block_rows=32, chunk_rows=2).toPandas()
    near = ann.search(df, every=50, k=5, sample=128, leaf=8, recall=1.0).toPandas()
    ids, vec = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for made, x in ((top, np.floor(vec * 256)), (near, vec)):
        for q in range(0, 300, 50):
            s = x @ x[q]
            s[ids == q] = -np.inf
            best = np.lexsort((ids, -s))[:5]
            mine = made[made["query_id"] == q].sort_values("rank")
            assert np.allclose(np.sort(mine["score"])[::-1], s[best], atol=1e-9) and mine["rank"].tolist() == [1, 2, 3, 4, 5]
            if made is top:
                assert mine["vec_id"].tolist() == ids[best].tolist()


def test_cells_that_bounds_drop_hold_nothing_that_matters():
    rng = np.random.default_rng(12)
    v = np.floor(256 * (rng.normal(size=(600, 8)) + 6 * rng.normal(size=(6, 8))[rng.integers(6, size=600)]))
    points = pivots.choose(v, 8, 1)
    t = pivots.table(v, points)
    near = t.argmin(axis=1)
    cells = sorted(set(near.tolist()))
    reach = (cells, np.array([t[near == c].min(axis=0) for c in cells]), np.array([t[near == c].max(axis=0) for c in cells]), np.array([(v[near == c] ** 2).sum(axis=1).max() for c in cells]))
    scores = v[:40] @ v.T
    floor = np.sort(scores, axis=1)[:, -6].astype(float)
    keep = pivots.surviving(v[:40], t[:40], floor, reach)
    for i in range(40):
        for c in np.unique(near[scores[i] >= floor[i]]):
            assert keep[i, cells.index(c)]
    assert keep.mean() < 0.9 and pivots.surviving(v[:2], t[:2], np.array([np.nan, np.nan]), reach).all()


def test_few_vectors_in_the_nearest_leaves_are_made_up_for(spark):
    rng = np.random.default_rng(13)
    v = np.concatenate([rng.normal(size=(400, 4)) * 0.1 + 5, -20 * np.ones((1, 4)), [[-19.0, -20, -20, -20]]])
    df = spark.createDataFrame([(20 * i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, every=20, k=20, sample=402, leaf=4, recall=0.5).groupBy("query_id").count().collect()
    assert len(got) == 402 and {r["count"] for r in got} == {20}


# op4

def test_urls_of_many_levels_get_few_keys(spark):
    deep = "http://" + ".".join(["x"] * 300) + ".a.example/" + "p/" * 3000 + "end"
    log = spark.createDataFrame([("a.example", "2024-01-01"), ("a.example/p/p/", "2024-01-01")], "pattern string, day string").select("pattern", F.lit("add").alias("action"), F.to_date("day").alias("day"))
    caps = spark.createDataFrame([(1, deep, "2024-01-02"), (2, "http://b.example/p/p/", "2024-01-02")], "page_id long, url string, t string").withColumn("fetched", F.to_date("t"))
    assert {r["page_id"]: r["matched"] for r in urls.blocked(caps, log).collect()} == {1: "a.example/p/p/", 2: None}
    labels, levels = urls.shapes(log)
    assert caps.select(F.max(F.size(urls.keys(F.col("url"), labels, levels)))).first()[0] <= 6
    assert set(caps.where("page_id = 2").select(urls.keys(F.col("url")).alias("k")).first()["k"]) == {"b.example", "example", "b.example/", "b.example/p/", "b.example/p/p/", "example/", "example/p/", "example/p/p/"}


# op5

def without_repeats(rows):
    """What line dedup leaves, read off its definition: every pair of neighbouring lines met before, by id then place."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        for a, pair in enumerate(zip((t := text.split("\n")), t[1:])):
            seen.setdefault(pair, (i, a))
    for i, text in rows:
        t = text.split("\n")
        gone = [seen[t[a], t[a + 1]] != (i, a) for a in range(len(t) - 1)]
        keep, a = [True] * len(t), 0
        while a < len(gone):
            if not gone[a]:
                a += 1
                continue
            b = a
            while b < len(gone) and gone[b]:
                b += 1
            if any(c.isalnum() or c == "_" for line in t[a : b + 1] for c in line):
                keep[a : b + 1] = [False] * (b + 1 - a)
            a = b
        out[i] = "\n".join(x for x, k in zip(t, keep) if k)
    return out


@pytest.mark.parametrize("options", [{"modulus": None}, {"modulus": 2, "grow": True}, {"modulus": 5, "window": 3, "grow": True}, {"modulus": None, "digest_size": 1}, {"modulus": 2, "grow": True, "digest_size": 1}])
def test_line_dedup_is_its_definition(spark, options):
    rng = np.random.default_rng(14)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "-", "c d", "e"], int(rng.integers(1, 9))))) for i in range(120)]
    rows += [(200 + k, "\n".join(f"line {j} {j * j}" for j in range(3 * k, 40 + k))) for k in range(8)] + [(300, "same\n" * 30)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame([(*r, "s") for r in rows], DOCS), **options).collect()}
    assert got == without_repeats(rows)


def test_copies_of_chunks_go_without_a_look_at_their_lines(spark):
    text = "\n".join(f"line {j} {j * j}" for j in range(400))
    docs = spark.createDataFrame([(k, text, "s") for k in range(50)] + [(None, text, "s"), (7, text, "s")], DOCS)
    gone = lines.repeated(docs, modulus=2, grow=True).collect()
    assert len(gone) == 51 * len([1 for a, b in lines._cut(text.split("\n"), 2, 2) if min(b + 1, 400) - a > 1])
    left = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in lines.dedup(docs, modulus=2, grow=True).collect())
    assert left[0] == (False, 0, text) and {x for *_, x in left[1:]} == {""}


# op6

def spans_of(rows, length, within=False):
    """Windows of length words met in another document (with within, anywhere else), joined."""
    at = defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - length + 1):
            at[tuple(w[k : k + length])].add((i, k))
    out = {}
    for i, w in rows:
        words = set()
        for k in range(len(w) - length + 1):
            met = at[tuple(w[k : k + length])]
            if (len(met) > 1) if within else any(j != i for j, _ in met):
                words |= set(range(k, k + length))
        if words:
            out[i] = sorted(words)
    return out


@pytest.mark.parametrize("within", [False, True])
def test_passages_of_few_word_texts_are_all_found(spark, within):
    rng = np.random.default_rng(15)
    shared = [some_words(30, 500 + k, 3) for k in range(4)]
    rows = []
    for i in range(60):
        w = some_words(int(rng.integers(0, 60)), 600 + i, 3)
        for k in rng.integers(0, 4, int(rng.integers(0, 4))):
            cut = int(rng.integers(0, len(w) + 1))
            w = w[:cut] + shared[k][: int(rng.integers(8, 31))] + w[cut:]
        rows.append((i, w))
    rows.append((100, shared[0] * 12))
    df = spark.createDataFrame([(i, " ".join(w), "s") for i, w in rows], DOCS)
    got = {r["doc_id"]: sorted({k for s in r["spans"] for k in range(s["start"], s["end"])}) for r in suffixes.passages(df, length=12, gram=4, within=within).collect()}
    assert got == spans_of(rows, 12, within)


def test_decoys_and_repeats_within_a_document_hide_no_passage(spark):
    passage = some_words(60, 1)
    rows = [(1, [x for k in range(12) for x in passage + some_words(9, 50 + k)]), (2, some_words(40, 90) + passage + some_words(40, 91))]
    half = some_words(50, 2)
    rows += [(10, some_words(30, 92) + half + some_words(30, 93)), (11, some_words(30, 94) + half + some_words(30, 95))] + [(20 + k, some_words(40, 200 + k) + half[20:] + some_words(40, 300 + k)) for k in range(12)]
    df = spark.createDataFrame([(i, " ".join(w), "s") for i, w in rows], DOCS)
    got = {r["doc_id"]: sorted({k for s in r["spans"] for k in range(s["start"], s["end"])}) for r in suffixes.passages(df).collect()}
    assert got == spans_of(rows, 50) and len(got[1]) >= 720 and set(got) == {1, 2, 10, 11}


# op7

def test_quotas_split_every_source_exactly(spark):
    blocks = [40, 0, 7, 123]
    got = mix.quotas(blocks, 9, 3, spark).collect()
    assert sorted(got) == sorted(mix.quotas(blocks, 9, 3, spark, depth=1).collect())
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r["k"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert [by_source[k] for k in range(4)] == blocks and set(by_shard) == set(range(9)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_op7_takes_each_document_by_its_passes(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text").collect()]
    size = lambda t: len((t or "").encode().split())
    got = queries.op7_mix(spark, SMALL).collect()
    assert len(got) == len(docs) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, _, t in docs)
    whole = Counter()
    for _, s, t in docs:
        whole[s] += size(t)
    order = sorted(whole, key=lambda s: (s is None, (s or "").encode()))
    # Water-filling by bisection: the level at which weights times level, capped, add up.
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, 3 * whole[s]) for s in order) < sum(whole.values()) else (lo, mid)
    taken, source = Counter(), {i: s for i, s, _ in docs}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == whole[s] and r["target"] == pytest.approx(min(weight[s] * lo, 3 * whole[s]), rel=1e-6)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        passes = math.floor(r["target"] / whole[s]) if whole[s] else 0
        assert r["size"] == 0 or r["taken"] // r["size"] in (passes, passes + 1)
        taken[s] += r["taken"]
    longest = max(size(t) for _, _, t in docs)
    assert all(abs(taken[s] - min(weight[s] * lo, 3 * whole[s])) <= longest for s in order)


# op9

def edits(a, b):
    """Optimal string alignment: insert, delete, replace, swap neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_the_automaton_is_edit_distance(spark):
    rng = np.random.default_rng(16)
    made = lambda n: "".join(rng.choice(list("abc"), n))
    terms = sorted({made(int(n)) for n in rng.integers(3, 8, 25)})
    a = toxicity.Automaton(terms, [])
    for n in rng.integers(1, 9, 600):
        w = made(int(n))
        near = min((e for t in terms if (e := edits(t, w)) <= (1 if len(t) >= 5 else 0)), default=-1)
        assert a.find(w) == near, w


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    got = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in queries.op9_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y, _ in got if y], [s for s, y, _ in got if not y]
    assert len(pos) > 3 and len(neg) > 30
    # A third of the positive labels here are noise: their texts hold no term that marks any other.
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) >= 0.75
    assert sum(p for _, y, p in got if not y) / len(neg) <= 0.05


# The near-dedup stage and the pipeline

def five_word_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def classes(sets, similarity=0.8):
    jaccard = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    top = tied((a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= similarity)
    return {i: top(i) for i in sets}


def test_near_duplicates_are_those_of_exact_sets(spark):
    rng, rows = np.random.default_rng(17), []
    for k in range(40):
        base = some_words(int(rng.integers(1, 150)), 2000 + k)
        for c in range(int(rng.integers(1, 4))):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[at] = f"changed{k}{c}"
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in sketches.near_duplicates(spark.createDataFrame([(*r, "s") for r in rows], DOCS)).collect()}
    assert got == classes(five_word_sets(rows))


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, sent = docs.columns, docs
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, sent, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        state[name] = ([r.asDict() for r in sent.collect()], [r.asDict() for r in out.collect()])
        assert name == "byte_bpe" or out.columns == names
        sent = out
    texts = lambda rows: {r["doc_id"]: r["text"] for r in rows}

    before, after = state["toxicity"]
    flagged = {r["doc_id"] for r in queries.op9_toxicity(spark, SMALL).where("predicted = 1").collect()}
    assert texts(after) == {i: t for i, t in texts(before).items() if i not in flagged}
    before, after = map(texts, state["line_dedup"])
    left = without_repeats([(i, t) for i, t in before.items() if t is not None])
    assert after == {i: None if t is None else left[i] for i, t in before.items() if t is None or left[i] == t or left[i].strip()}
    before, after = map(texts, state["simhash_near_dedup"])
    keep = classes(five_word_sets(before.items()))
    assert after == {i: t for i, t in before.items() if keep[i] == i}
    before, after = state["mix_sources"]
    size = lambda t: len((t or "").encode().split())
    assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before}
    times, held = Counter(r["doc_id"] for r in after), Counter()
    assert max(times.values()) <= 3
    for r in before:
        held[r["source"]] += size(r["text"])
    drawn = Counter()
    for r in after:
        drawn[r["source"]] += size(r["text"])
    longest = max(size(r["text"]) for r in before)
    assert abs(sum(drawn.values()) - sum(held.values())) <= longest and all(drawn[s] <= 3 * held[s] for s in held)

    import tiktoken

    from driftline.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    before, after = state["byte_bpe"]
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
    original = texts(before)
    for r in after:
        text = original[r["doc_id"]] or ""
        assert list(r["ids"]) == want.encode_ordinary(text) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_of_nothing_and_of_nulls(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, "", "en", None, 0), (900_001, "", "en", None, 0), (900_002, None, None, "s", None)], docs.schema)
    for first in (docs.where("1 = 0"), odd):
        sent = first.withColumn("size", F.lit("clash")).withColumn("node", F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, sent, SMALL)
            assert name == "byte_bpe" or out.columns == sent.columns
            rows = out.collect()
            sent = out if name == "byte_bpe" else spark.createDataFrame(rows, sent.schema)
        assert len(rows) == (0 if first is not odd else 3) and all(r["n_tokens"] == 0 for r in rows)  # near copies, texts without words, are one a class
