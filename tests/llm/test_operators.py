"""Each operator against brute force, on small fixtures with nulls, empties, repeats and clashing names."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftline.llm import ann, bpe, chat, components, lines, mix, pivots, simhash, sketches, suffixes, toxicity, urls

DOCS = "doc_id long, text string, source string"


def words(n, seed, alphabet="abcdefgh"):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), 4)) for _ in range(n)]


# op1

def folded(spark, rows):
    ev = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    return {(r["conv_id"], r["message"]): r["text"] for r in chat.fold(ev, block=2).collect()}


def test_chat_fold_deltas_edits_and_regenerations(spark):
    got = folded(spark, [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", "assistant", "llo"), (1, 3, 2, "message", "user", "more"),
        (1, 4, 5, "message", "user", "late"), (1, 5, 1, "regenerate", "assistant", None), (1, 6, 1, "delta", "assistant", "again"), (1, 7, 2, "message", "user", "ok"),
        (2, 0, 0, "message", "user", None), (2, 1, 0, "edit", "user", "new"), (None, 0, 0, None, None, "x"),
    ])
    assert got == {(1, 0): "hi", (1, 1): "again", (1, 2): "ok", (2, 0): "new", (None, 0): "x"}


def test_chat_reads_back_what_it_wrote(spark):
    nasty = ["\\### Assistant: </turn> ok", "", "### : \\", "a\n</turn>\n### user: b", "é🙂" * 50, "\\\\", "</turn"]
    rows = [(1, k, "assistant" if k % 2 else "us: er### ", t) for k, t in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    turns, masked, length = [], [], 0
    for r in chat.render(df, block=3).orderBy("block").collect():
        t, m = chat.read(r["formatted"], r["loss"])
        turns, masked, length = turns + t, masked + m, length + len(r["formatted"])
    assert turns == [(r, t) for _, _, r, t in rows] and masked == [t for _, _, r, t in rows if r == "assistant"]
    d = chat.digests(chat.render(df, block=3)).first()
    assert d["n_turns"] == len(rows) and d["formatted_chars"] == length and d["loss_chars"] == sum(map(len, masked))
    assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


# op2

@pytest.mark.parametrize("crowd", [64, 1])
def test_simhash_links_are_those_of_all_pairs(spark, crowd):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)] + [0]
    for _ in range(80):
        fps.append(fps[int(rng.integers(len(fps)))] ^ (1 << int(rng.integers(63))))
    fps = sorted(set(fps))
    edges = simhash.link(spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, node long"), 2, crowd)
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(up))


def test_simhash_of_null_empty_and_copies(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "X y", "a"), (5, "x Y", "b"), (5, "x Y", "b")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")), words=3).collect()
    assert len(got) == 6 and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert {r["fingerprint"] for r in got if r["doc_id"] < 4} == {"0" * 16}


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3)], "a long, b long")
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(chain.where("a < 0")).count() == 0


def test_sketches_join_near_copies_and_leave_others(spark):
    base = words(400, 1)
    near = list(base)
    near[100] = near[300] = "changed"
    rows = [(1, " ".join(base), "s"), (2, " ".join(near), "s"), (3, " ".join(base), "s"), (4, " ".join(words(400, 2)), "s"), (5, " ".join(base[:150] + words(250, 3)), "s"), (6, None, "s"), (7, "", "s")]
    got = {r["doc_id"]: r["component_id"] for r in sketches.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}


def test_short_unrelated_texts_stay_apart_and_sets_decide(spark):
    short = [(k, " ".join(words(2, 5000 + k)), "s") for k in range(1500)]
    base = words(104, 9)  # 100 shingles
    edge = [(2000, " ".join(base), "s"), (2001, " ".join(base + words(24, 10)), "s"), (2002, " ".join(words(104, 11)), "s"), (2003, " ".join(words(104, 11) + words(29, 12)), "s")]
    got = {r["doc_id"]: r["component_id"] for r in sketches.near_duplicates(spark.createDataFrame(short + edge, DOCS)).collect()}
    assert all(got[k] == k for k, _, _ in short)
    assert got[2003] == 2003  # 100 of 129 shingles: similarity 0.775
    full = {k: set(zip(*(text.split()[n:] for n in range(5)))) for k, text, _ in edge}
    assert len(full[2000] & full[2001]) / len(full[2000] | full[2001]) == pytest.approx(100 / 124) and got[2001] == 2000


def test_pairs_just_alike_enough_are_found(spark):
    rows = []
    for k in range(300):
        a = words(104, 20_000 + k)  # 100 shingles of 125 or, if short, 4 of 5
        rows += [(2 * k, " ".join(a if k % 2 else a[:8]), "s"), (2 * k + 1, " ".join(a + words(25, 30_000 + k) if k % 2 else a[:9]), "s")]
    got = {r["doc_id"]: r["component_id"] for r in sketches.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) >= 298


def test_crowded_sketch_blocks_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 20)
    rows = []
    for k in range(60):
        sk = base.copy()
        sk[rng.integers(20)] ^= int(rng.integers(-(2**62), 2**62))
        rows.append((k, [int(x) for x in (sk if k < 40 else ~sk)]))
    nodes = spark.createDataFrame(rows, "node long, sk array<long>")
    for crowd in (64, 2):
        got = {r["node"]: r["component"] for r in components.connected_components(sketches.link(nodes, 1280, 100, crowd=crowd, part=8)).collect()}
        assert got == {k: 0 if k < 40 else 40 for k in range(60)}


def test_sketches_grow_with_the_number_of_texts():
    assert sketches.shape(0, 0.8) == sketches.shape(1_000_000, 0.8) == (1280, 20)
    bits, block = sketches.shape(1 << 30, 0.8)
    one = (1 - np.arccos(1.6 / 1.8) / np.pi) ** block
    assert block == 30 and bits % 64 == 0 and 1 - (1 - one) ** (bits // block) >= 0.91


# op3 and op8

def vectors(spark, n=400, zero=True):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(n, 8)) + 3 * rng.normal(size=(5, 8))[rng.integers(5, size=n)]
    v[10:40] = v[5]  # ties
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    bad = [(1000, None), (1020, []), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [float("inf")] * 8), (1100, [1.0] * 3)] + ([(1120, [0.0] * 8)] if zero else [])
    return spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), np.array([r[1] for r in rows])


def test_ann_recall_and_order(spark):
    df, v = vectors(spark)
    got = ann.search(df, every=20, k=10, sample=200, leaf=16).toPandas()
    hit = total = 0
    for q in range(0, len(v), 20):
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(v)), -s))[:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(mine) == 10 and q not in set(mine["vec_id"]) and (np.diff(mine["score"]) <= 0).all()
        assert np.allclose(mine["score"], s[mine["vec_id"]], atol=1e-12)
        hit += len(set(best) & set(mine["vec_id"]))
        total += 10
    assert hit / total >= 0.9 and set(got["query_id"]) == set(range(0, len(v), 20))
    assert ann.search(df.where("vec_id < 0")).count() == 0


def test_exact_top_k_is_exact(spark):
    df, v = vectors(spark, zero=False)
    got = pivots.search(df, every=50, k=5, pivots=6, sample=100, block_rows=64, chunk_rows=4).toPandas()
    x = np.floor(v * 256)
    for q in range(0, len(v), 50):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(v)), -s))[:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["vec_id"].tolist() == best.tolist() and mine["score"].tolist() == s[best].tolist()
    assert pivots.search(df.where("vec_id < 0")).count() == 0


# op4

def test_url_list_intervals_and_keys(spark):
    log = [("a.example", "add", "2024-01-10"), ("a.example", "remove", "2024-02-01"), ("a.example", "add", "2024-03-01"), ("b.example/x/", "add", "2024-01-01"), ("c.example", "remove", "2024-01-01"), ("a.example", "add", "2024-01-12"), (None, "add", "2024-01-01")]
    changes = spark.createDataFrame(log, "pattern string, action string, day string").withColumn("day", F.to_date("day"))
    caps = [(1, "http://a.example/", "2024-01-09"), (2, "http://www.A.example:80/p", "2024-01-10"), (3, "http://a.example", "2024-02-01"), (4, "http://a.example", "2024-05-01"), (5, "http://b.example/x/y?q#f", "2024-01-02"), (6, "http://b.example/xy", "2024-01-02"), (7, "http://nota.example/", "2024-01-20"), (8, None, "2024-01-20"), (9, "junk", "2024-01-20"), (10, "http://a.example/", None), (2, "http://www.A.example:80/p", "2024-01-10")]
    captures = spark.createDataFrame(caps, "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("blocked", F.lit("clash"))
    got = urls.blocked(captures, changes).collect()
    assert len(got) == len(caps) and {r["page_id"] for r in got if r["blocked"]} == {2, 4, 5}
    assert {r["matched"] for r in got if r["page_id"] == 5} == {"b.example/x/"}
    assert urls.blocked(captures, changes.where("1 = 0")).where("blocked").count() == 0


# op5

def test_line_dedup_removes_all_but_the_first(spark):
    rng = np.random.default_rng(3)
    shared = [" ".join(words(5, 100 + k)) for k in range(12)]
    rows = []
    for i in range(12):
        own = [" ".join(words(4, 1000 + 10 * i + k)) for k in range(int(rng.integers(0, 6)))]
        rows.append((i, "\n".join(own + (shared if i % 2 else []) + own[:1]), "s"))
    rows += [(50, rows[1][1], "s"), (51, None, "s"), (52, "", "s"), (53, "one line", "s"), (54, "\n\n\n\n", "s"), (55, "\n\n\n\n", "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("removed", F.lit("clash"))
    got = {r["doc_id"]: r for r in lines.dedup(df).collect()}
    seen = set()
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            assert got[i]["text"] is None
            continue
        parts, keep = text.split("\n"), []
        for a, b in lines.cut(text):
            body = "\n".join(parts[a:b])
            if b - a > 1 and re.search(r"\w", body):
                if body in seen:
                    continue
                seen.add(body)
            keep.append(body)
        assert got[i]["text"] == "\n".join(keep)
    assert got[50]["removed"] > 0 and got[54]["removed"] == 0


def test_every_repeated_run_of_lines_goes(spark):
    rows, kept = [], {}
    for n in (2, 3, 4, 5, 8):
        for k in range(20):
            run = [" ".join(words(4, 40_000 + 1000 * n + 10 * k + j)) for j in range(n)]
            if n == 8:
                run[2:6] = ["", "--", "", ""]  # lines without a word within a run
            for copy in range(2):
                own = [" ".join(words(4, 60_000 + 1000 * n + 40 * k + 20 * copy + j)) for j in range(6)]
                i = 10_000 * copy + 100 * n + k
                rows.append((i, "\n".join(own[:3] + run + own[3:]), "s"))
                kept[i] = "\n".join(own if copy else own[:3] + run + own[3:])
    rows += [(90_000, "\n\n\n\n", "s"), (90_001, "\n\n\n\n", "s"), (90_002, None, "s"), (90_003, "one line", "s"), (90_004, "one line", "s")]
    kept |= {i: text for i, text, _ in rows if i >= 90_000}
    got = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(rows, DOCS), modulus=None).collect()}
    assert {i: r["text"] for i, r in got.items()} == kept
    assert {i for i, r in got.items() if r["removed"]} == {i for i in got if 10_000 <= i < 90_000} and got[10_200]["removed"] == 1


def test_chunk_boundaries_resist_shifts():
    body = [f"line {k} {k * k}" for k in range(60)]
    chunk = lambda ls: {"\n".join(ls[a:b]) for a, b in lines.cut("\n".join(ls))}
    assert len(chunk(body) & chunk(["new first line"] + body)) >= len(chunk(body)) - 2


# op6

def test_repeated_passages_are_found_to_the_word(spark):
    passage = words(60, 1)
    rows = [(1, " ".join(words(80, 2) + passage + words(10, 3)), "s"), (2, " ".join(passage + words(90, 4)), "s"), (3, " ".join(words(30, 5)), "s"), (4, "\t".join(words(70, 6) + passage), "s"), (5, None, "s"), (6, "", "s"), (7, " ".join(words(40, 7) + passage[:45]), "s"), (8, " ".join(words(55, 8) * 2), "s")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [(80, 140)], 2: [(0, 60)], 4: [(70, 130)]}
    twice = suffixes.passages(spark.createDataFrame(rows, DOCS), within=True)
    assert 8 in {r["doc_id"] for r in twice.collect()}


def test_passages_around_a_frequent_gram_are_found(spark):
    frequent = words(10, 70_000)  # in every document; two of them share the 45 words before it too
    rows = []
    for i in range(200):
        before = words(45, 71_000 if i in (3, 150) else 72_000 + i)
        rows.append((i, " ".join(words(60, 73_000 + i) + before + frequent + words(60, 74_000 + i)), "s"))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {3: [(60, 115)], 150: [(60, 115)]}


# op7

def test_shares_stop_at_three_times_a_source():
    got = mix.share([10, 1000, 0], [5, 2, 1])
    assert got[0] == 30 and got[2] == 0 and sum(got) == pytest.approx(1010)
    assert mix.share([], []) == [] and mix.share([0], [5]) == [0.0]


def test_mix_draws_meet_their_targets_again_and_again(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), ["b", "a", None][min(2, i % 7 // 3)]) for i in range(300)] + [(300, None, "a"), (301, "", "b"), (302, "x", "b"), (302, "x", "b")]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("k", F.lit(1))
    runs = [mix.mix(df, block=4, shard_blocks=8).select("doc_id", "source", "size", "target", "draw", "shard").orderBy("doc_id", "draw", "shard").collect() for _ in range(2)]
    assert runs[0] == runs[1]
    taken, target, shards = {}, {}, {}
    for r in runs[0]:
        target[r["source"]] = r["target"]
        if r["shard"] is not None:
            taken[r["source"]] = taken.get(r["source"], 0) + r["size"]
            shards[r["shard"]] = shards.get(r["shard"], 0) + 1
    assert all(abs(taken[s] - t) <= 2 for s, t in target.items()) and len(shards) > 1
    assert max(shards.values()) <= 2 * min(shards.values()) + 8
    assert mix.mix(df.where("doc_id < 0")).count() == 0


# op9

def test_automaton_finds_misspelled_words_and_exact_stems():
    a = toxicity.Automaton(["idiot", "scum", "worthless"], ["vequ"])
    near = {"idiot": 0, "idoit": 1, "idiott": 1, "iditt": 1, "diot": 1, "scum": 0, "scam": -1, "worthles": 1, "vequilla": 0, "veq": -1, "idxxt": -1, "": -1}
    assert {w: a.find(w) for w in near} == near


def test_toxicity_learns_scores_and_tells_quotation(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(400):
        text = [str(w) for w in words(30, i)]
        if i % 5 == 0:
            for k in rng.integers(0, 30, 3):
                text[k] = ["grubbly", "snorkish"][int(rng.integers(2))]
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "you grubbly snorkis fool", "s"), (1003, 'he said "grubbly"', "s"), (1004, "you are grubbly and snorkish", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in toxicity.scores(docs, spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels) and got[1000]["score"] == got[1001]["score"] < 0.3
    assert got[1004]["predicted"] == 1 and got[1003]["score"] < got[1004]["score"] and got[1002]["score"] > got[1000]["score"]
    none = toxicity.scores(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("predicted = 1").count() == 0


# op10

def test_bpe_is_the_library_and_round_trips(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").read())
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(8)
    texts = ["", None, " ", "\n\n  x", "don't'll", "日本語🙂" * 30, "a" * 700, " " * 300, "<|endoftext|>", "é" * 200]
    for alphabet in ("ab", "etaoin shrdlu'", "éèaüß ñ\n", "01239 .,!", "日本語中文🙂👍"):
        texts += ["".join(rng.choice(list(alphabet), int(rng.integers(1, 200)))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    tok = bpe.ByteBpe(spark, path, public_tokenizers.PATTERN)
    for r in bpe.decode(bpe.encode(docs, tok), tok).collect():
        assert r["ids"] == want.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "")
    for r in docs.select("text", tok.round_trip(F.col("text")).alias("r")).collect():
        ids, text = want.encode_ordinary(r["text"] or ""), r["text"] or ""
        assert r["r"]["ids"] == ids and r["r"]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["r"]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_short_lookahead_and_small_tables_change_nothing():
    import regex

    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    find = regex.compile(public_tokenizers.PATTERN).findall
    big, small = bpe.Transducer(ranks), bpe.Transducer(ranks, lookahead=8, depth=2, max_states=50, max_pieces=20)
    text = " ".join(words(300, 1, "etaoinshrdlué")) + "x" * 500 + "abc" * 300
    assert big.encode(text, find) == small.encode(text, find)


def test_utf8_machine_across_blocks():
    raw = "aé日🙂".encode()
    for k in range(1, len(raw)):
        m = bpe.Utf8Machine()
        assert m.feed(raw[:k]) + m.feed(raw[k:]) + m.close() == "aé日🙂"
    m = bpe.Utf8Machine()
    assert m.feed(b"\xf0\x9f") + m.close() == "�"


def test_bpe_short_pieces_run_once_and_as_long_ones_do():
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    machine, rng = bpe.Transducer(ranks), np.random.default_rng(4)
    for n in (1, 2, 4, 5, 9, 30, 64):
        for letters in (b"abent ing", bytes(range(256))):
            raw = bytes(rng.choice(list(letters), n).tolist())
            want = b"".join(t.to_bytes(4, "little") for t in machine.merge(raw))
            assert machine._short(raw) == machine._run(raw) == want
    ran = []
    machine._short = machine._run = lambda raw: ran.append(raw) or b"\0\0\0\0"
    for _ in range(2):
        machine.encode("", lambda _: [f"~{k:x}~" for k in range(250_000)])
    assert len(ran) == 250_000  # none is forgotten in between
