"""Byte-level BPE: texts to token ids and back.

Encoding. A rank table is compiled, as far as the texts need it, into a
deterministic finite-state transducer over bytes. It rests on a known property
of byte-pair merges: a sequence of tokens is the encoding of its bytes if and
only if each two neighbours are the encoding of theirs. Every prefix of a piece
therefore has one last token, found from the prefixes before it. A state is
(last token emitted, bytes pending behind it); a byte extends the pending bytes,
and tokens leave as soon as every way in which the piece can go on starts with
them, which needs a lookahead no longer than the longest token. States and arcs
are made on first use and dropped when there are too many, so memory is bounded.

Decoding. Token bytes are joined in blocks and run through an incremental UTF-8
machine, which keeps the unfinished character at the end of one block for the
next.

Edge cases: a null text counts as empty and has no tokens; an invalid byte
sequence (possible only for ids that encode() did not make) decodes to U+FFFD;
an id outside the table raises ValueError. Extra columns pass through; a column
named like an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import kept, release, ship


#: Whether an array of 32-bit numbers is as ids are written.
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


class State:
    """What a prefix of a piece leaves open.

    token: the last token of the prefix's own encoding (None: no encoding
    passes here). live: where a longer token may have begun, as (start, node of
    the token trie).
    """

    __slots__ = ("token", "live", "arcs")

    def __init__(self, token: int | None, live: list):
        self.token, self.live = token, live
        self.arcs: dict[int, State] = {}


class Transducer:
    """The lazily determinised transducer of one rank table.

    lookahead: pending bytes at which tokens are emitted, if all ways to go on
    agree on them; until then a longer part stays pending. depth: bytes behind a
    base up to which arcs are kept; later ones are seldom met again, and making
    them anew costs less than keeping them.
    """

    def __init__(self, ranks: dict[bytes, int], lookahead: int = 64, depth: int = 4, max_states: int = 50_000, max_pieces: int = 200_000):
        self.ranks, self.lookahead, self.depth = ranks, lookahead, depth
        self.max_states, self.max_pieces = max_states, max_pieces
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.trie: dict[int, int] = {}
        self.rank_at: list[int] = [-1]
        self.inner: set[int] = {0}
        for t, rank in ranks.items():
            node = 0
            for b in t:
                self.inner.add(node)
                key = node << 8 | b
                nxt = self.trie.get(key)
                if nxt is None:
                    nxt = self.trie[key] = len(self.rank_at)
                    self.rank_at.append(-1)
                node = nxt
            self.rank_at[node] = rank
        self.goes_on = [node in self.inner for node in range(len(self.rank_at))]
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.bases: dict[int, State] = {}
        self.made = 0
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, raw: bytes, least: int = 1) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals, down to so many parts."""
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens of a token's last merge; of a single byte, itself; (-1, -1): no merges make it."""
        got = self.halves.get(token)
        if got is None:
            raw = self.bytes_of[token]
            two = self.merge(raw, 2)
            got = (token, token) if len(raw) == 1 else (two[0], two[1]) if len(two) == 2 else (-1, -1)
            self.halves[token] = got
        return got

    def _fits(self, left: int, right: int) -> bool:
        """Two tokens can be neighbours; left -1 is the start of a piece.

        Undo the later of the merges next to the border, again and again: if a
        merge across the border would ever have come before the one undone, the
        two tokens would not have come about.
        """
        halves, ranks, raw = self.halves, self.ranks, self.bytes_of
        if (halves.get(right) or self._halves(right))[0] < 0:
            return False
        if left < 0:
            return True
        limit, before, behind = 1 << 62, raw[left], raw[right]
        while True:
            across = ranks.get(before + behind)
            if across is not None and across < limit:
                return False
            if len(before) == len(behind) == 1:
                return True
            if len(behind) == 1 or (len(before) > 1 and left > right):
                limit = left
                left = (halves.get(left) or self._halves(left))[1]
                before = raw[left]
            else:
                limit = right + 1
                right = (halves.get(right) or self._halves(right))[0]
                behind = raw[right]

    def _step(self, tokens: list, live: list, byte: int) -> tuple[int | None, list]:
        """The last token and the live starts after one more byte; tokens: the last token of each shorter prefix."""
        trie, rank_at, inner, pairs = self.trie, self.rank_at, self.inner, self.pairs
        on, token = [], None
        for start, node in live:
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            if node in inner:
                on.append((start, node))
            if token is None and (t := rank_at[node]) >= 0:
                key = tokens[start] << 32 | t
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) > 200_000:
                        pairs.clear()
                    ok = pairs[key] = self._fits(tokens[start], t)
                if ok:
                    token = t
        if token is not None:
            on.append((len(tokens), 0))
        return token, on

    def _back(self, tokens: list, n: int) -> list[int]:
        """The tokens that lead to position n."""
        out, length = [], self.length
        while n:
            t = tokens[n]
            out.append(t)
            n -= length[t]
        return out[::-1]

    def _agreed(self, tokens: list, live: list) -> list[int]:
        """The tokens that every way to go on starts with."""
        paths = [self._back(tokens, start) for start, _ in live]
        k = 0
        while all(len(p) > k for p in paths) and len({p[k] for p in paths}) == 1:
            k += 1
        return paths[0][:k] if paths else []

    def _base(self, token: int) -> State:
        if token not in self.bases:
            self.bases[token] = State(token, [(0, 0)])
        return self.bases[token]

    def _run(self, raw: bytes) -> bytes:
        got, base, begun, due = [], -1, 0, self.lookahead
        while True:
            state = self._base(base)
            tokens, live, n = [base], state.live, begun
            for b in raw[begun : begun + self.depth]:
                nxt = state.arcs.get(b)
                if nxt is None:
                    nxt = state.arcs[b] = State(*self._step(tokens, state.live, b))
                    self.made += 1
                state = nxt
                tokens.append(state.token)
                n += 1
            live, step, ids = state.live, self._step, []
            while n < len(raw):
                token, live = step(tokens, live, raw[n])
                tokens.append(token)
                n += 1
                if n - begun >= due:
                    if ids := self._agreed(tokens, live):
                        break
                    due += self.lookahead
            if not ids:
                break
            got += ids
            begun += sum(self.length[t] for t in ids)
            base, due = ids[-1], n - begun + self.lookahead
        if tokens[-1] is None:
            raise ValueError("the rank table lacks single bytes")
        got += self._back(tokens, len(tokens) - 1)
        return b"".join([t.to_bytes(4, "little") for t in got])

    def _short(self, raw: bytes) -> bytes:
        """_run() of a piece within the lookahead: no token leaves before its end, and behind its last byte nothing goes on."""
        arc, rank_at, goes_on, pairs, fits = self.trie.get, self.rank_at, self.goes_on, self.pairs, self._fits
        state, tokens = self._base(-1), [-1]
        for b in raw[: self.depth]:
            nxt = state.arcs.get(b)
            if nxt is None:
                nxt = state.arcs[b] = State(*self._step(tokens, state.live, b))
                self.made += 1
            state = nxt
            tokens.append(state.token)
        live, n, end = state.live, len(tokens) - 1, len(raw)
        for b in raw[self.depth :]:
            n += 1
            on, token = [], None
            for start, node in live:
                node = arc(node << 8 | b)
                if node is None:
                    continue
                if goes_on[node]:
                    on.append((start, node))
                if token is None and (t := rank_at[node]) >= 0:
                    key = tokens[start] << 32 | t
                    ok = pairs.get(key)
                    if ok is None:
                        if len(pairs) > 200_000:
                            pairs.clear()
                        ok = pairs[key] = fits(tokens[start], t)
                    if ok:
                        token = t
                        if n == end:
                            break
            if token is not None:
                on.append((n, 0))
            tokens.append(token)
            live = on
        if tokens[-1] is None:
            raise ValueError("the rank table lacks single bytes")
        out, length = [], self.length
        while n:
            t = tokens[n]
            out.append(t)
            n -= length[t]
        return array("I", out[::-1]).tobytes() if _LITTLE else b"".join([t.to_bytes(4, "little") for t in out[::-1]])

    def piece(self, text: str) -> bytes:
        """The ids of one piece, as little-endian unsigned 32-bit integers."""
        out = self.older.get(text)
        if out is not None:
            self.pieces[text] = out
            return out
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            out = whole.to_bytes(4, "little")
        else:
            out = self._short(raw) if len(raw) <= self.lookahead else self._run(raw)
            if self.made > self.max_states:
                self.bases.clear()
                self.made = 0
        if len(raw) <= 64:
            if len(self.pieces) >= self.max_pieces:
                self.older = dict(self.pieces)
                self.pieces.clear()
            self.pieces[text] = out
        return out

    def encode(self, text: str, find) -> bytes:
        known, piece = self.pieces, self.piece
        return b"".join([known.get(w) or piece(w) for w in find(text)])


class Utf8Machine:
    """Incremental UTF-8: feed() gives the characters that are whole so far."""

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def _wants(lead: int) -> int:
        """Bytes of the character that a byte starts; 0: it starts none."""
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    def feed(self, raw: bytes) -> str:
        raw = self.tail + raw
        cut = len(raw)
        for back in range(1, min(3, cut) + 1):
            lead = raw[cut - back]
            if lead & 0xC0 != 0x80:
                if self._wants(lead) > back:
                    cut -= back
                break
        self.tail = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.tail = self.tail.decode("utf-8", "replace"), b""
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


def _transducer(raw: bytes) -> Transducer:
    """One transducer a worker, kept between tasks."""
    return kept(("transducer", hashlib.sha256(raw).digest()), lambda: Transducer(read_ranks(raw)))


def _made_table(raw: bytes) -> list:
    ranks = read_ranks(raw)
    table: list = [None] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        table[i] = t
    return table


def _table(raw: bytes) -> list:
    return kept(("table", hashlib.sha256(raw).digest()), lambda: _made_table(raw))


def _lists(parts: Iterable[bytes]) -> pa.Array:
    parts = list(parts)
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + len(p) // 4)
    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _decoded(ids: pa.Array, token, block: int) -> Iterator[str]:
    """The text of ids, block by block; token: the bytes of an id."""
    machine = Utf8Machine()
    for k in range(0, len(ids), block):
        some = ids[k : k + block].to_numpy(zero_copy_only=False).tolist()
        try:
            yield machine.feed(b"".join(map(token, some)))
        except (LookupError, TypeError) as e:
            raise ValueError("an id that the vocabulary lacks") from e
    yield machine.close()


def _digest(ids: pa.Array) -> str:
    return hashlib.sha256(ids.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest()


class ByteBpe:
    """A tokenizer for Spark columns.

    path: the rank file (read on the driver; its size is the vocabulary's, which
    does not grow with the data, and it goes to the executors as a broadcast).
    pattern: what splits a text into pieces.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ship(spark)
        with open(path, "rb") as f:
            self.ranks = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def ids(self, text: Column) -> Column:
        """Token ids, array<int>."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import regex

            machine, find = _transducer(ranks.value), regex.compile(pattern).findall
            for texts in batches:
                yield _lists(machine.encode(t.as_py() or "", find) for t in texts)

        return encode(text)

    def round_trip(self, text: Column, block: int = 4096) -> Column:
        """ids, their digest and the digest of what they decode to, in one worker: struct<ids, ids_sha256, decoded_sha256>."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("struct<ids:array<int>,ids_sha256:string,decoded_sha256:string>")
        def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import regex

            machine, find = _transducer(ranks.value), regex.compile(pattern).findall
            for texts in batches:
                lists = _lists(machine.encode(t.as_py() or "", find) for t in texts)
                decoded = []
                for one in lists:
                    said = hashlib.sha256()
                    for part in _decoded(one.values, machine.bytes_of.__getitem__, block):
                        said.update(part.encode("utf-8"))
                    decoded.append(said.hexdigest())
                digests = pa.array([_digest(one.values) for one in lists], pa.string())
                yield pa.StructArray.from_arrays([lists, digests, pa.array(decoded, pa.string())], ["ids", "ids_sha256", "decoded_sha256"])
            release()

        return made(text)

    def text(self, ids: Column, block: int = 4096) -> Column:
        """The text of an array of ids."""
        ranks = self.ranks

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = _table(ranks.value)
            for lists in batches:
                out = []
                for one in lists:
                    if not one.is_valid:
                        out.append("")
                        continue
                    out.append("".join(_decoded(one.values, table.__getitem__, block)))
                yield pa.array(out, pa.string())

        return decode(ids)


def ids_digest(ids: Column) -> Column:
    """Hex SHA-256 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([_digest(x.values) if x.is_valid else hashlib.sha256(b"").hexdigest() for x in lists], pa.string())

    return digest(ids)


def encode(docs: DataFrame, bpe: ByteBpe, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) and n_tokens."""
    ids = docs.withColumn("ids", bpe.ids(F.col(text)))
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


def decode(encoded: DataFrame, bpe: ByteBpe) -> DataFrame:
    """encoded with decoded, the text of its ids."""
    return encoded.withColumn("decoded", bpe.text(F.col("ids")))
