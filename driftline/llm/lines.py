"""Line dedup by content-defined chunks of lines.

A text's lines are hashed; a rolling hash over the last few line hashes ends a
chunk wherever it falls into one of modulus classes, so boundaries depend on
nearby content alone and survive shifts. Chunks of two lines or more that occur
again anywhere are removed but for their first occurrence (smallest id, then
place). Chunks are nominated by digests, the first 128 bits of SHA-256; then the
bytes of all that were nominated are compared.

Chunks alone see a passage only where boundaries fall inside it. With grow, a
chunk takes in the first line of the next one, so that every two neighbouring
lines are in one chunk, and matches are grown line by line: of the chunks met for
the first time, every two neighbouring lines are looked up too, in all others.
Those met again join to runs where they overlap. So every repeated run of two lines
or more goes, from its first line to its last, whatever is around it; of each
line's text the first occurrence stays. Copies of chunks go whole, without their
lines being looked at. The queries use this. modulus=None has no boundaries: every
two neighbouring lines are looked up, with the same result.

Scale: a digest and a place move for each chunk, and of texts those that hold
nominated chunks; each text once more, to be rewritten. A chunk in a third of all
documents is summed up before it is shuffled, its bytes too, and the join that
tells its occurrences which is the first has one row a chunk on the other side,
cut off as a table so that Spark may split the crowded key. Should two different
chunks have one digest, occurrences are matched by their bytes instead.

Edge cases: null texts stay null; empty texts and texts of one line stay as they
are; chunks (or runs) without a word character are never removed. Rows that agree in id
and text are one occurrence and are rewritten alike. A text whose chunks are all
removed is empty. Extra columns pass through;
removed is added; input columns named removed, places, gone_id or gone_mark give
way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import release, ship, table


def _parts(lines: list[str], window: int, modulus: int | None, grow: bool) -> list[tuple[int, int]]:
    """The chunks by boundaries, with grow each with the next one's first line; or every two neighbouring lines."""
    if len(lines) < 2:
        return []
    if modulus is None:
        return [(a, a + 2) for a in range(len(lines) - 1)]
    return [(a, min(b + grow, len(lines))) for a, b in _cut(lines, window, modulus) if min(b + grow, len(lines)) - a > 1]


def cut(text: str, window: int = 2, modulus: int = 4) -> list[tuple[int, int]]:
    """(start, end) line numbers of a text's chunks."""
    return _cut(text.split("\n"), window, modulus)


def _cut(lines: list[str], window: int, modulus: int) -> list[tuple[int, int]]:
    import xxhash

    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    base, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    top, rolling, out, begun = pow(base, window, 1 << 64), 0, [], 0
    for i, h in enumerate(hashes):
        rolling = (rolling * base + h) & full
        if i >= window:
            rolling = (rolling - hashes[i - window] * top) & full
        mixed = (rolling ^ rolling >> 29) * 0xBF58476D1CE4E5B9 & full
        if (mixed >> 32) % modulus == 0:
            out.append((begun, i + 1))
            begun = i + 1
    if begun < len(lines):
        out.append((begun, len(lines)))
    return out


def _chunks(text: Column, window: int, modulus: int | None, grow: bool, digest_size: int) -> Column:
    """The chunks of a text that could be removed: first line, number of lines, digest; with grow also the digests of its neighbouring lines."""

    @F.arrow_udf("array<struct<place:int,size:int,digest:binary,pairs:array<binary>>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from hashlib import sha256

        import regex

        word = regex.compile(r"\w").search
        kind = pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("digest", pa.binary()), ("pairs", pa.list_(pa.binary()))]))
        digest = lambda part: sha256("\n".join(part).encode()).digest()[:digest_size]
        for texts in batches:
            out = []
            for t in texts:
                lines, found = (t.as_py() or "").split("\n"), []
                for a, b in _parts(lines, window, modulus, grow):
                    if modulus is None or grow or word("\n".join(lines[a:b])):
                        pairs = [digest(lines[k : k + 2]) for k in range(a, b - 1)] if grow and b - a > 2 else []
                        found.append({"place": a, "size": b - a, "digest": digest(lines[a:b]), "pairs": pairs})
                out.append(found)
            yield pa.array(out, kind)
        release()

    return made(text)


def _bodies(text: Column, spans: Column) -> Column:
    """(place, size, digest, body) of the spans of lines of a text."""

    @F.arrow_udf("array<struct<place:int,size:int,digest:binary,body:string>>")
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("digest", pa.binary()), ("body", pa.string())]))
        for texts, which in batches:
            out = []
            for t, spans in zip(texts, which):
                lines = t.as_py().split("\n")
                out.append([s | {"body": "\n".join(lines[s["place"] : s["place"] + s["size"]])} for s in spans.as_py()])
            yield pa.array(out, kind)
        release()

    return made(text, spans)


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs of lines that the spans make; spans that share a line are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: Column, places: Column, joined: bool) -> Column:
    """A text without the given spans of lines, and how many (or, joined, how many runs of them) went."""

    @F.arrow_udf("struct<text:string,removed:int>")
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import regex

        word = regex.compile(r"\w").search
        for texts, gone in batches:
            out, counts = [], []
            for t, g in zip(texts, gone):
                t, g = t.as_py(), {(s["place"], s["place"] + s["size"]) for s in g.as_py() or ()}
                if t is None or not g:
                    out.append(t)
                    counts.append(0)
                    continue
                lines = t.split("\n")
                spans = [(a, b) for a, b in runs(list(g)) if word("\n".join(lines[a:b]))] if joined else sorted(g)
                off = {i for a, b in spans for i in range(a, b)}
                out.append("\n".join(line for i, line in enumerate(lines) if i not in off))
                counts.append(len(spans))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["text", "removed"])
        release()

    return made(text, places)


_WHO = ("id", "mark", "place")


def _met_again(found: DataFrame) -> DataFrame:
    """The spans (id, mark, place, size, digest) whose digest is met more than once, each with the first."""
    first = table(found.groupBy("digest").agg(F.min(F.struct(*_WHO)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return found.join(first, "digest").select(*_WHO, "size", "digest", "first")


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 2, modulus: int | None = 4, grow: bool = False, digest_size: int = 16) -> DataFrame:
    """(id, mark, place, size) of every span of lines to be removed; mark is a hash of the text, so that id and mark name a row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).where("text is not null")
    chunks = rows.select("id", "mark", F.explode(_chunks(F.col("text"), window, modulus, grow, digest_size)).alias("c")).select("id", "mark", "c.*")
    chunks = table(chunks if grow else chunks.drop("pairs"))
    later = ~F.struct(*_WHO).eqNullSafe(F.col("first"))
    named = _met_again(chunks.select(*_WHO, "size", "digest"))
    if grow:
        named = table(named)
        copies = named.where(later).select(*(F.col(c).alias(f"c_{c}") for c in _WHO))
        same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")) & (F.col("place") == F.col("c_place"))
        own = chunks.join(copies, same, "left_anti")
        # A chunk of two lines has no other neighbours than those it is made of.
        pairs = F.when(F.col("size") == 2, F.array("digest")).otherwise(F.col("pairs"))
        inner = own.select("id", "mark", F.col("place").alias("at"), F.posexplode(pairs).alias("k", "digest")).select("id", "mark", (F.col("at") + F.col("k")).alias("place"), F.lit(2).alias("size"), "digest")
        named = named.unionByName(_met_again(table(inner)))
    named = table(named.withColumn("later", later).drop("first"))
    listed = named.groupBy("id", "mark").agg(F.collect_set(F.struct("place", "size", "digest")).alias("spans")).withColumnsRenamed({"id": "l_id", "mark": "l_mark"})
    # Merged at every size: what is joined to the texts grows with them.
    texts = rows.join(listed.hint("merge"), F.col("id").eqNullSafe(F.col("l_id")) & (F.col("mark") == F.col("l_mark")))
    bodies = texts.select("id", "mark", F.explode(_bodies(F.col("text"), F.col("spans"))).alias("b")).select("id", "mark", "b.*")
    different = table(bodies.groupBy("digest", "body").count().groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if different.isEmpty():
        return named.where("later").select(*_WHO, "size")
    if grow:  # what copies hold was not looked at, on the word of their digests
        return repeated(docs, id, text, modulus=None, digest_size=digest_size)
    first = table(bodies.groupBy("digest", "body").agg(F.min(F.struct(*_WHO)).alias("first"), F.count("*").alias("n")).where("n > 1"))
    return bodies.join(first, ["digest", "body"]).where(later).select(*_WHO, "size").distinct()


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 2, modulus: int | None = 4, grow: bool = False, digest_size: int = 16) -> DataFrame:
    """docs with the repeated chunks (with grow, or without a modulus, runs) taken out of their texts, and removed, how many."""
    docs = docs.drop("places", "gone_id", "gone_mark", "removed")
    gone = repeated(docs, id, text, window, modulus, grow, digest_size).groupBy("id", "mark").agg(F.collect_set(F.struct("place", "size")).alias("places"))
    gone = table(gone.select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"), "places"))
    same = docs[id].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs[text]) == F.col("gone_mark"))
    joined = docs.join(gone.hint("merge"), same, "left").drop("gone_id", "gone_mark")
    rewritten = joined.withColumn("places", _without(F.col(text), F.col("places"), grow or modulus is None))
    return rewritten.withColumn(text, F.col("places.text")).withColumn("removed", F.col("places.removed")).drop("places")
