"""Prefix trie, decontamination and structure repair against brute force over whole tables and made-up edges."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import leaks, queries, repair, streams, tries

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


# op11

def as_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, as_digest(r or "", x or ""), r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        leaves = 0 if kids[path] else 1
        for k in kids[path]:
            leaves += out[k][5]
            saved += out[k][6]
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(whole[c]) == len(path)))
        out[path] = (min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves, saved, sha(ends))
    return sorted(out.values())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df):
    return sorted(tuple(r[c] for c in NODE) for r in df.select(*NODE).collect())


def test_trie_is_brute_force_over_the_table(spark):
    assert nodes(queries.op11_prefix_trie(spark, SMALL)) == brute_trie(conversations(spark))


@pytest.mark.parametrize("block", [1024, 3])
def test_trie_with_copies_nulls_ties_and_long_conversations(spark, block):
    rng = np.random.default_rng(8)
    rows = [(c, None if t == 2 else int(t), "user" if t % 2 == 0 else None, None if t == 1 else "é" * int(rng.integers(2))) for c in range(60) for t in range(int(rng.integers(0, 12)))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(20) for t in range(11)]  # copies
    rows += [(200 + c, t, "user", f"same {t}") for c in range(6) for t in range(9 + 2 * c)]  # each one begins the next
    rows += [(300 - c, t, "user", f"back {t}") for c in range(6) for t in range(9 + 2 * c)]
    rows += [(7, 1, "user", "x"), (7, 1, "user", "x"), (7, 1, "assistant", "x"), (None, 0, "user", "lost"), (-3, 0, "user", "neg"), (10, 5, "user", "long " * 20_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("digest", F.lit(1)).withColumn("depth", F.lit(2)).withColumn("place", F.lit(3))
    turns, convs = tries.rebuilt(df)
    assert nodes(tries.trie(turns, convs, block=block)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert tries.trie(*tries.rebuilt(empty)).count() == 0


def test_prefix_digests_are_the_stated_chain(spark):
    turns = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    df = spark.createDataFrame([(1, k, d, 1) for k, d in enumerate(turns)], "conv_id long, place long, digest binary, bytes long")
    got = {r["depth"]: bytes(r["digest"]) for r in tries.prefixes(df, spark.createDataFrame([(1, 5)], "conv_id long, turns long"), block=2).collect()}
    h = lambda *p: hashlib.sha256(b"".join(p)).digest()
    one, two = [h(turns[0]), h(h(turns[0]), turns[1])], [h(turns[2]), h(h(turns[2]), turns[3])]
    carry = h(one[1]), h(h(one[1]), two[1])
    assert got == {0: h(b""), 1: one[0], 2: one[1], 3: h(carry[0], two[0]), 4: h(carry[0], two[1]), 5: h(carry[1], h(turns[4]))}


# op12

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL_LETTERS = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def brute_leaks(docs, items, length=10):
    wanted = defaultdict(set)
    for name, text in items:
        w = WORD.findall((text or "").translate(SMALL_LETTERS))
        for k in range(max(1, len(w) - length + 1)) if w else ():
            wanted[tuple(w[k : k + length])].add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(SMALL_LETTERS))
        hit, found = set(), set()
        for m in {len(k) for k in wanted}:
            for k in range(len(w) - m + 1):
                if (t := tuple(w[k : k + m])) in wanted:
                    hit |= set(range(k, k + m))
                    found |= wanted[t]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


LEAK = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_is_brute_force_over_the_tables(spark):
    table = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{n}.parquet").select(*c).collect()]
    got = [tuple(r[c] for c in LEAK) for r in queries.op12_decontaminate(spark, SMALL).collect()]
    want = brute_leaks(table("documents", "doc_id", "text"), table("benchmark", "item_id", "text"))
    assert sorted(got) == sorted(want) and any(r[5] for r in got)


@pytest.mark.parametrize("part, piece", [(200_000, 1 << 20), (7, 1 << 20), (5, 9)])
def test_short_items_overlaps_repeats_nulls_pieces_and_passes(spark, part, piece):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(rng.choice(["a", "b", "É", "é1", "zz"], n))
    items = [(k, words(n)) for k, n in enumerate([1, 2, 2, 3, 4, 5, 6, 12, 14, 30])] + [(10, "Q-w\x00e"), (11, None), (12, "..."), (None, words(4)), (3, words(11)), (3, words(11)), (20, items_of := words(40))]
    docs = [(k, words(int(n))) for k, n in enumerate(rng.integers(0, 80, 40))] + [(50, None), (51, ""), (51, ""), (52, items_of.replace(" ", "\n--")), (None, items_of), (53, "x " * 3000 + items_of + " y" * 3000), (54, "q.W!e\x7f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("window", F.lit("w")).withColumn("leak_text", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    got = leaks.occurrences(df, bench, part=part, piece=piece)
    assert got.columns == ["doc_id", "text", "window", "leak_text", "n_words", "spans", "items"]
    hashed = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]), sha(",".join(r["items"])), bool(r["spans"])) for r in got.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(hashed, key=order) == sorted(brute_leaks(docs, items), key=order)


def test_decontamination_of_and_by_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_words"] for r in leaks.occurrences(docs, none).collect()] == [3]
    assert leaks.occurrences(docs.limit(0), none).count() == 0


def test_most_blocks_are_skipped():
    asked = []

    class Counted(list):
        def __getitem__(self, k):
            asked.append(k)
            return list.__getitem__(self, k)

    window = tuple(b"w%d" % k for k in range(10))
    s = leaks.Searcher({window: [0]}, 10)
    text = Counted([b"x"] * 1000 + list(window) + [b"x"] * 1000)
    assert [e for e, _ in s.found(text)] == [1010]
    assert sum(isinstance(k, int) for k in asked) < 260


# op13

def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if n:
            row = (c, t, "user" if n == 4 else r, "" if n == 1 else re.sub("[.!?]", "", x) if n == 2 else x)
            out += [row] * (2 if n == 3 else 1)
    return out


def layered(rows):
    """Least (cost, audit, repaired) by layers over the rows: nothing like a queue."""
    def closed(best):
        for _ in range(3):
            for s, by in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if s in best:
                    c, a, left = best[s]
                    new = (c + 2, a + "I", left + (("user" if by == "u" else "assistant", ""),))
                    best[by] = min(best.get(by, new), new)
        return best

    best = closed({"": (0, "", ())})
    for role, text, fault in rows:
        then = {}
        for s, (c, a, left) in best.items():
            options = [(s, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                one = int(fault == "truncated")
                if role and s + role[0] in ("s", "u", "su", "ua", "au"):
                    options.append((role[:1], one, "K", ((role, text),)))
                options.append(("a" if s == "u" else "u", 2 + one, "R", (("assistant" if s == "u" else "user", text),)))
            for t, cost, e, more in options:
                new = (c + cost, a + e, left + more)
                then[t] = min(then.get(t, new), new)
        best = closed(then)
    return min(best[s] for s in ("", "a") if s in best)


def brute_report(original, rows):
    of = defaultdict(list)
    for c, t, r, x in rows:
        of[c].append((t is not None, t or 0, r, x))
    out = []
    for c in {r[0] for r in original}:
        seen, judged, listed = set(), [], sorted(of[c])
        for _, _, r, x in listed:
            body = re.findall("[^\x20\x09-\x0d]", x)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((r, x))
            judged.append((r, x, fault))
        turns = {t for known, t, _, _ in listed if known}
        count = lambda f: sum(j[2] == f for j in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        cost, audit, left = layered(judged)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in left))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(df):
    return sorted((tuple(r[c] for c in REPORT) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_repair_is_brute_force_over_the_table(spark):
    rows = conversations(spark)
    assert reported(queries.op13_repair(spark, SMALL)) == brute_report(rows, brute_damage(rows))


def odd_rows():
    rng = np.random.default_rng(9)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "User"], ["ok.", "so", "what?", " \n", "", None, "end!\t", "x" * 3000, "."]
    rows = [(c, None if rng.random() < 0.1 else int(rng.integers(0, 30)), str(r) if (r := roles[rng.integers(len(roles))]) is not None else None, texts[rng.integers(len(texts))]) for c in range(40) for _ in range(int(rng.integers(1, 14)))]
    rows += [(90, t, roles[t % 5], f"{t}" + ".!"[t % 2] * (t % 7 > 0)) for t in range(150)]
    rows += [(None, 0, "user", "a."), (None, 1, "user", "b."), (91, 3, "user", "a.")] + [(92, 1, "user", "same.")] * 30
    return rows


@pytest.mark.parametrize("block", [512, 4, 1])
def test_repair_with_nulls_ties_copies_and_long_conversations(spark, block):
    rows = odd_rows()
    df = spark.createDataFrame(rows, TURNS).withColumn("n", F.lit(1)).withColumn("fault", F.lit("f")).withColumn("place", F.lit(5))
    assert reported(repair.report(df, repair.damaged(df), block=block)) == brute_report(rows, brute_damage(rows))


def test_repair_of_no_rows_is_zeros(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.report(empty, repair.damaged(empty)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "a.")], TURNS)
    assert reported(repair.report(df, repair.damaged(df))) == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_repaired_conversations_are_legal_and_keep_what_they_may(spark):
    rows = odd_rows()
    known = repair.judged(spark.createDataFrame(rows, TURNS))
    made = repair.edits(known)
    left = defaultdict(list)
    for r in repair.repaired(known, made).orderBy("block", "n").collect():
        left[r["conv_id"]].append(r)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in c)) for c in left.values())
    assert all(r["text"] == "" for c in left.values() for r in c if r["edit"] == "I")


def test_hash_of_ordered_rows_keeps_large_ids_beside_nulls(spark):
    rows = [(2**53, 1, "a"), (2**53 + 1, 1, "b"), (2**53, 0, "c"), (None, 5, "d"), (None, 4, None)]
    df = spark.createDataFrame(rows, "k long, o long, x string")
    got = {r["k"]: r["sha256"] for r in streams.ordered_sha256(df, ["k"], ["o"], F.col("x"), "+").collect()}
    assert got == {2**53: sha("c+a"), 2**53 + 1: sha("b"), None: sha("+d")}
