"""Benchmark decontamination: passages of test items found in documents by Wu-Manber search over words.

A window is `length` consecutive words of an item; an item of fewer words, but
not none, is one window. Windows of one number of words m are searched together:
a table of shifts says for each block of two neighbouring words how far the
search may move on, as no window can end sooner; the last block of a window is
the bucket that holds it; the windows of the bucket are compared word by word.
Most blocks stand in no window, so most of a text is skipped in steps of m - 1 words.

Scale: documents are read once and not shuffled. What every worker gets is a part
of the windows, at most `windows` pairs of a window and its item (the driver holds
one part at a time); more items than that are searched in as many passes, whose
finds are put together by row. A long text is read in pieces of `piece` bytes that
overlap by a window less one word, so that a worker holds the words of one piece.

Words are runs of ASCII letters and digits and of all characters above ASCII,
with A-Z lower-cased. Null texts have no words. A null item_id is an item of its
own with the name "". Rows of one item_id are one item, repeated or not. Extra
columns of documents stay; those named n_words, spans or items are replaced.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.plans.scans import running
from driftline.session import kept, ship, table

#: Bytes of UTF-8 to what they count as: digits, small letters and bytes above ASCII as they are, A-Z small, all else a blank.
FOLDED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SPANS = "array<struct<start:bigint,end:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


class Searcher:
    """Windows of m words each: tables of shifts, buckets, comparison."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]], m: int):
        self.m, self.block = m, min(2, m)
        #: last word of a block -> first word of it (None where a block is one word) -> words that the search may move on
        self.shift: dict[bytes, dict] = {}
        #: block that ends a window -> the windows that end so
        self.bucket: dict[tuple, list] = {}
        for window, items in windows.items():
            for end in range(self.block, m + 1):
                first, last = window[end - 2] if self.block == 2 else None, window[end - 1]
                of = self.shift.setdefault(last, {})
                of[first] = min(of.get(first, m), m - end)
            self.bucket.setdefault(window[m - self.block :], []).append((window, items))

    def found(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(end, items) of each occurrence, in order."""
        m, two, shift, bucket, n = self.m, self.block == 2, self.shift, self.bucket, len(words)
        at, other = m - 1, m - self.block + 1
        while at < n:
            of = shift.get(words[at])
            far = other if of is None else of.get(words[at - 1] if two else None, other)
            if far:
                at += far
                continue
            for window, items in bucket[tuple(words[at - self.block + 1 : at + 1])]:
                if tuple(words[at - m + 1 : at + 1]) == window:
                    yield at + 1, items
            at += 1


def search(text: bytes | None, searchers: list[Searcher], piece: int = 1 << 20) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, spans of hit words (disjoint, in order), items found."""
    most = max((s.m for s in searchers), default=1)
    done, spans, items, held, at, size = 0, [], set(), [], 0, len(text or b"")
    while at < size:
        end = min(at + piece, size)
        while end < size and FOLDED[text[end]] != 32:  # a word is not cut
            end += 1
        words = held + words_of(text[at:end])
        base = done - len(held)
        for s in searchers:
            for stop, which in s.found(words):
                items.update(which)
                spans.append((base + stop - s.m, base + stop))
        done, at, held = base + len(words), end, words[len(words) - min(len(words), most - 1) :]
    spans.sort()
    joined: list[list[int]] = []
    for start, end in spans:
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return done, [(s, e) for s, e in joined], items


def windows(benchmark: DataFrame, length: int = 10) -> DataFrame:
    """(window, item): each window of each item, words joined by blanks."""
    ship(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names, made = [], []
            for name, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary())):
                words = words_of(text.as_py() or b"")
                seen = {b" ".join(words[k : k + length]) for k in range(max(1, len(words) - length + 1))} if words else ()
                made += [w.decode() for w in seen]
                names += [name] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(names, pa.string())], ["window", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(cut, "window string, item string").distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: int = 10, part: int = 200_000, piece: int = 1 << 20) -> DataFrame:
    """docs with n_words, spans (start and end in words of each stretch of hit words) and items (names of the items found, in order as strings)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_words", "spans", "items")
    pairs = windows(benchmark, length)
    pairs = table(pairs.withColumn("size", F.size(F.split("window", " "))))
    parts = -(-pairs.count() // part)
    numbered = running(pairs.withColumn("all", F.lit(0)), ["all"], [F.col("window").asc(), F.col("item").asc()], {"nth": F.lit(1)}) if parts > 1 else pairs.withColumn("nth", F.lit(0))
    numbered = numbered.select((F.col("nth") / part).cast("int").alias("part"), "window", "size", "item")
    if parts <= 1:
        return _pass(docs, numbered, text, piece)
    keyed = table(docs.withColumn("leak_row", F.monotonically_increasing_id()))
    numbered = table(numbered)
    only = keyed.select("leak_row", F.col(text).alias("leak_text"))
    found = None
    for k in range(parts):
        one = _pass(only, numbered.where(F.col("part") == k), "leak_text", piece).drop("leak_text")
        found = one if found is None else found.unionByName(one)
    met = found.groupBy("leak_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate(
        F.array_sort("s"), F.array().cast(SPANS),
        lambda out, x: F.when((F.size(out) > 0) & (x["start"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))),
    )
    return keyed.join(met.select("leak_row", "n_words", joined.alias("spans"), "items"), "leak_row").drop("leak_row")


def _pass(docs: DataFrame, numbered: DataFrame, text: str, piece: int) -> DataFrame:
    """One search for a part of the windows; the driver collects that part and sends it out."""
    spark = docs.sparkSession
    rows = numbered.orderBy("window", "item").select("window", "item").toArrow()
    sent = spark.sparkContext.broadcast((rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    at, mark = docs.columns.index(text), uuid.uuid4().hex

    def compiled() -> tuple[list[Searcher], list[str]]:
        named, names = sent.value
        known = sorted(set(names))
        of: dict[int, dict] = {}
        for window, name in zip(named, names):
            words = tuple(window.encode().split())
            of.setdefault(len(words), {}).setdefault(words, []).append(bisect.bisect_left(known, name))
        return [Searcher(w, m) for m, w in sorted(of.items())], known

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, known = kept(("leaks", mark), compiled)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows in batches:
            counts, spans, items = [], [], []
            for x in rows.column(at).cast(pa.binary()):
                n, stretches, found = search(x.as_py(), searchers, piece)
                counts.append(n)
                spans.append([{"start": s, "end": e} for s, e in stretches])
                items.append([known[i] for i in sorted(found)])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], [*rows.schema.names, "n_words", "spans", "items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(look, f"{fields}, n_words bigint, spans {SPANS}, items array<string>")
