"""Repeated passages by a sparse suffix array.

Of a text's suffixes those are kept that begin at anchors. The anchor of a window
of length words is the minimiser among its grams of words: the gram with the
smallest hash, the leftmost in a tie. It is chosen by the window's content alone,
so it stands at the same place wherever the window occurs, and a window is its
anchor's suffix so far to the right and its context so far to the left.

Suffixes whose gram begins suffixes of other texts are sorted by what follows, as
far as a window reaches, and ranges of them are read in order. A suffix has its
longest common prefix with one of its neighbours; windows that reach farther right
are met nowhere and are dropped. The others are extended to the left: runs of
neighbours whose windows are the same are found by hashes of the windows. A run over
two documents is a match of all its members. What a neighbour does not settle (same
words to the right, others to the left in between; ends of ranges) is looked up among
all runs: each run names its window once. As each window of a shared passage is
looked at, no passage of length words or more is missed, however many documents
share its gram, and each is found to the word.

Rows with equal texts are one text with a range of ids: it is keyed once,
however many copies it has, and if these have different ids all of it is one
span.

Scale: the first pass moves a hash for one word in twenty; texts with an anchor
met again move once, to make a row of fixed size of each such suffix (one word in
twenty again). Rows are dealt by ranges of the sort key with the place in the text
as its end, so a suffix that a third of all documents have is many ranges; a
range is read in blocks. A run names a window once, whatever its length, and names
are summed up before they are shuffled and kept as a table, so Spark may split a
crowded one. No pair of occurrences is made.

Edge cases: null and empty texts, and texts of fewer than length words, have no
spans. Words are what stands between white space (x20, x09-x0D). Rows that agree
in id and text are one occurrence. Only passages shared by different ids count,
unless within is set. Texts are equal by two 64-bit hashes, windows by two. Other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import ship, table


def _hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h, gram: int, length: int):
    """(place, gram hash) of the anchor of each window of length words, by the hashes of the words."""
    import numpy as np

    n, run = len(h) - gram + 1, length - gram + 1
    if len(h) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    grams = (grams ^ grams >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    found = []
    for at in range(0, n - run + 1, 1 << 15):  # windows in blocks, for texts of any length
        some = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 15) + run - 1], run)
        found.append(some.argmin(axis=1) + np.arange(at, at + len(some)))
    places = np.concatenate(found)
    return places, grams[places].view(np.int64)


def _words_and_grams(text: Column, gram: int, length: int) -> Column:
    """How many words a text has, and the grams that anchor its windows, one a place."""

    @F.arrow_udf("struct<n:int,grams:array<bigint>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for texts in batches:
            counts, sizes, grams = [], [0], [np.empty(0, np.int64)]
            for t in texts:
                words = (t.as_py() or "").encode("utf-8").split()
                places, each = anchors(_hashes(words), gram, length)
                g = each[np.unique(places, return_index=True)[1]]
                counts.append(len(words))
                sizes.append(sizes[-1] + len(g))
                grams.append(g)
            rows = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(grams), pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int32()), rows], ["n", "grams"])

    return made(text)


def windows(h, starts, length: int):
    """A hash of each window of length words that begins at one of the starts, by the hashes of the words."""
    import numpy as np

    base = 0xD1B54A32D192ED03
    rolled = np.zeros(len(starts), np.uint64)
    for k in range(length):
        x = h[starts + k] * np.uint64(pow(base, length - 1 - k, 1 << 64))
        rolled += x ^ x >> np.uint64(29)
    rolled = (rolled ^ rolled >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return rolled ^ rolled >> np.uint64(29)


_SUFFIX = "gram long, after binary, left long, windows binary, low long, high long, one long, two long, place int"
_NAMES = [c.split()[0] for c in _SUFFIX.split(", ")]


def _suffixes(gram: int, length: int, rows: int = 8192):
    """A row for each suffix of a text whose gram is met again: 16 bits of each word that follows the gram, the hashes of the windows that
    the suffix anchors by how far they reach left (0: not its own), and a hash of them all."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        run = length - gram + 1
        for b in batches:
            for k in range(b.num_rows):
                low, high, one, two, text, met = (b.column(c)[k].as_py() for c in ("low", "high", "one", "two", "text", "met"))
                h = _hashes(text.encode("utf-8").split())
                places, grams = anchors(h, gram, length)
                starts = np.flatnonzero(np.isin(grams, np.array(met, np.int64)))
                short = np.concatenate([(h >> np.uint64(48)).astype(">u2"), np.zeros(length, ">u2")])
                ends = np.flatnonzero(np.diff(places[starts], append=-1)) + 1  # windows of one anchor stand together
                for at in range(0, len(ends), rows):
                    first, last = (ends[at - 1] if at else 0), ends[min(at + rows, len(ends)) - 1]
                    some = starts[first:last]
                    win = windows(h, some, length) | np.uint64(1)
                    anchor, nth = np.unique(places[some], return_inverse=True)
                    table = np.zeros((len(anchor), run), np.uint64)
                    table[nth, places[some] - some] = win
                    after = np.lib.stride_tricks.sliding_window_view(short, length - gram)[anchor + gram]
                    left = (table * np.arange(1, 2 * run, 2, dtype=np.uint64)).sum(axis=1).view(np.int64)
                    known = grams[some][np.unique(nth, return_index=True)[1]]
                    pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                    cols = [pa.array(known, pa.int64()), pack(after), pa.array(left, pa.int64()), pack(table), *(pa.array(np.full(len(anchor), x, np.int64)) for x in (low, high, one, two)), pa.array(anchor, pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, _NAMES)

    return made


_MET = "settled boolean, gram long, win long, low long, high long, n long, one long, two long, start long, end long"


def _neighbours(gram: int, length: int, within: bool, rows: int = 8192):
    """Over suffixes in order: spans that neighbours settle, and windows to look up (a settled run names its window once)."""

    def looked(b: pa.Table):
        import numpy as np

        run, n = length - gram + 1, b.num_rows
        of = {c: b.column(c).to_numpy() for c in ("gram", "low", "high", "one", "two", "place")}
        fixed = lambda c, kind, w: np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(n, w)
        after, wins = fixed("after", ">u2", length - gram), fixed("windows", np.uint64, run)
        same = of["gram"][1:] == of["gram"][:-1]
        common = np.where(same, gram + np.cumprod(after[1:] == after[:-1], axis=1).sum(axis=1), 0)
        # What is before the first and behind the last row is not known here.
        reach = np.maximum(np.append(common, length), np.insert(common, 0, length))
        own = (wins != 0) & (length - np.arange(run)[None] <= reach[:, None])
        joined = np.zeros((n, run), bool)
        joined[1:] = same[:, None] & (wins[1:] == wins[:-1]) & (wins[1:] != 0)
        settled = np.zeros((n, run), bool)
        out = []
        for o in range(run):
            if not own[:, o].any():
                continue
            heads = np.flatnonzero(~joined[:, o])
            size = np.diff(heads, append=n)
            low, high = np.minimum.reduceat(of["low"], heads), np.maximum.reduceat(of["high"], heads)
            done = size > 1 if within else low < high
            done &= wins[heads, o] != 0
            settled[:, o] = np.repeat(done, size)
            name = (wins[:, o] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(o)).view(np.int64)
            for at, lo, hi, k, fixed_run in ((heads[done], low[done], high[done], size[done], True), *[(r := np.flatnonzero(own[:, o] & ~settled[:, o]), of["low"][r], of["high"][r], np.ones(len(r), np.int64), False)]):
                start = of["place"][at].astype(np.int64) - o
                out.append((np.full(len(at), fixed_run), of["gram"][at], name[at], lo, hi, k, of["one"][at], of["two"][at], start, start + length))
        # Neighbouring windows of one suffix that are settled are one span.
        rise = np.diff(np.pad(settled, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, near), (_, far) = np.nonzero(rise == 1), np.nonzero(rise == -1)
        place, zero = of["place"][row].astype(np.int64), np.zeros(len(row), np.int64)
        out.append((np.ones(len(row), bool), zero, zero, zero, zero, zero, of["one"][row], of["two"][row], place - far + 1, place - near + length))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [c.split()[0] for c in _MET.split(", ")])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for b in batches:
            held.append(b)
            many += b.num_rows
            if many >= rows:
                yield looked(pa.Table.from_batches(held))
                held, many = [], 0
        if many:
            yield looked(pa.Table.from_batches(held))

    return made


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50, gram: int = 10, within: bool = False) -> DataFrame:
    """(id, mark, start, end): windows of words that occur elsewhere too, and whole texts that do; mark is a hash of the text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("one"), F.xxhash64(text, F.lit(1)).alias("two"), F.col(text).alias("text")).where("text is not null and id is not null")
    found = rows.select("id", "one", "two", _words_and_grams(F.col("text"), gram, length).alias("w"))
    found = table(found.select("id", "one", "two", "w.*").where(F.col("n") >= length))
    texts = table(found.groupBy("one", "two").agg(F.min("id").alias("low"), F.max("id").alias("high")))
    # A text is read from its row with the smallest id; its grams too.
    first = found.join(texts.withColumnRenamed("low", "id"), ["one", "two", "id"]).dropDuplicates(["one", "two"])
    first = first.select("one", "two", F.col("id").alias("low"), "high", F.explode("grams").alias("gram"))
    again = first.groupBy("gram").agg(F.count("*").alias("n"), F.min("low").alias("l"), F.max("high").alias("h"), F.min("one").alias("a"), F.max("one").alias("b"))
    again = table(again.where("n > 1" if within else "l < h and a < b").select("gram"))  # one text alone has its copies' span already
    met = table(first.join(again, "gram").groupBy("one", "two").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.collect_set("gram").alias("met")))
    sources = rows.join(met.withColumn("id", F.col("low")), ["one", "two", "id"])
    suffixes = table(sources.select("low", "high", "one", "two", "text", "met").mapInArrow(_suffixes(gram, length), _SUFFIX))
    order = ["gram", "after", "left", "one", "two", "place"]
    seen = table(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(gram, length, within), _MET))
    named = seen.where("n > 0")
    shared = named.groupBy("gram", "win").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.sum("n").alias("all"), F.count_if(~F.col("settled")).alias("open"))
    shared = table(shared.where("open > 0").where("all > 1" if within else "a < b").select("gram", "win"))
    late = named.where("not settled").join(shared, ["gram", "win"]).select("one", "two", "start", "end")
    spans = seen.where("n = 0").select("one", "two", "start", "end").unionByName(late)
    held = found.select("id", "one", "two", "n").distinct()
    copied = held.join(texts.where("low < high"), ["one", "two"]).select("id", F.col("one").alias("mark"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    # Spans are joined by text before the copies' ids are put to them.
    joined = spans.groupBy("one", "two").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"))
    single = texts.where("low = high").select("one", "two", F.col("low").alias("id"))
    alone = joined.join(single, ["one", "two"]).select("id", F.col("one").alias("mark"), F.explode(_touching("all")).alias("s")).select("id", "mark", "s.start", "s.end")
    return alone.unionByName(copied)


def _touching(spans: str) -> Column:
    """Sorted spans, joined where they touch."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def joined(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, joined)


def passages(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, mark, spans, repeated_words) of each document with repeated passages: its spans of words, joined where they touch."""
    each = repeats(docs, id, text, **options).groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    out = each.select(F.col("id").alias(id), "mark", "spans")
    return out.withColumn("repeated_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
