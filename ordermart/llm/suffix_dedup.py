"""Exact substring dedup: a distributed merge sort of suffixes that knows prefixes.

A string of `length` bytes that stands in two places has its smallest-hashed run of
`GRAM` bytes, its anchor, at the same offset in both. So only suffixes that begin at
anchors are sorted, one in seventy. Each task sorts the suffixes of its texts into
runs, cuts them at common range borders and hands them on front-coded: the length of
the prefix shared with the one before, and the rest. In each range a loser tree
merges the runs; it compares by the known common prefixes and reads letters only
beyond them. Suffixes that agree in their first GRAM bytes are a group.

The strings that have the same anchor form one stretch of text, told by a hash. Of a
group's stretches those that are there twice are removed whole. Where a group has
different stretches, copies begin or end near the anchor; these stretches are fetched
and their strings compared one by one, within the group.

Range borders hold a stretch's hash behind the suffix, so that a passage in a large
share of all texts, whose edges make as many different stretches, spreads over many
ranges. The strings of such a group are not gathered: they are counted by their hashes
over the whole cluster.

Null texts count as empty. Matches never cross documents; strings are judged on the
input. Repeated rows are copies of each other. Texts of any length are read in pieces.
An empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ordermart.llm.common import SLICE_ROWS, id_and_text, map_slices, saved, texts
from ordermart.llm.embedding_dedup import runs_by_key
from ordermart.llm.shingles import mixed

#: Bytes of an anchor.
GRAM = 64
#: Bytes of text that are worked on at once.
PIECE = 2**18
#: Suffixes in a run; bounds what a task holds.
RUN = 150_000
#: Bytes of text in a range of the sort.
RANGE_BYTES = 12_000_000
#: One in so many texts, and of their anchors one in so many, set the range borders.
#: They shape the ranges' sizes, not the result.
SAMPLE_SHARE, SAMPLE_ANCHORS = 512, 4
#: Stretches of a group that are compared in one task; larger groups are spread.
TOGETHER = 4096

ENTRY = np.dtype(
    [("doc", "<u4"), ("twice", "u1"), ("low", "<u8"), ("high", "<u8"), ("stretch", "<u8")]
)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """(anchor, first, last) of the strings of `length` bytes: strings that begin from
    `first` to `last` have their anchor at `anchor`. Strings lie within [start, end)."""
    wide = length - GRAM + 1
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 2**64)) + h[size:]
        size *= 2
    # of equal runs the last one counts; places fill the low bits
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64(2**24 - 1)
    key = (mixed(h) & ~low) | (low - place)
    size = 1
    while size * 2 <= wide:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if wide > size:
        key = np.minimum(key[: len(key) - (wide - size)], key[wide - size :])
    at = (low - (key & low)).astype(np.int64)
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    long_enough = ends - starts >= length
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, ends[long_enough] - length + 1, -1)
    begin = np.flatnonzero(np.cumsum(inside)[: len(at)])
    if not len(begin):
        return (np.zeros(0, np.int64),) * 3
    at = at[begin]
    new = np.flatnonzero((at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(begin)]]) - 1
    return at[first], begin[first], begin[last]


def pieces(rows: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Texts put together into pieces: bytes, and (row, offset in the row, start, end)
    of each part. Parts of a long text overlap so that every string is in one of them."""
    held: list[bytes] = []
    parts: list[tuple[int, int, int, int]] = []
    total = 0
    for row, text in enumerate(rows):
        for offset in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[offset : offset + PIECE + length - 1]
            held.append(part)
            parts.append((row, offset, total, total + len(part)))
            total += len(part)
            if total >= PIECE:
                yield b"".join(held), parts
                held, parts, total = [], [], 0
    if held:
        yield b"".join(held), parts


def found_in(rows: list[bytes], length: int):
    """Pieces with their anchors: (row, low, high, suffix, stretch hash) arrays; low and
    high are the places in the row where strings begin."""
    for piece, parts in pieces(rows, length):
        data = np.frombuffer(piece, dtype=np.uint8)
        edges = np.array(parts, dtype=np.int64).reshape(-1, 4)
        at, low, high = anchors(data, edges[:, 2], edges[:, 3], length)
        if not len(at):
            continue
        part = np.searchsorted(edges[:, 2], low, "right") - 1
        # parts without any byte share their start with the next
        move = edges[part, 1] - edges[part, 2]
        suffix = data[at[:, None] + np.arange(GRAM)]
        digest = xxhash.xxh3_64_intdigest
        # the anchor's place in the stretch belongs to what the hash tells
        stretch = np.fromiter(
            (
                digest(piece[a : b + length], seed=c - a)
                for a, b, c in zip(low.tolist(), high.tolist(), at.tolist())
            ),
            dtype=np.uint64,
            count=len(at),
        )
        yield edges[part, 0], low + move, high + move, suffix, stretch


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """For sorted rows of letters, how many each shares with the one before."""
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], first]).astype(np.uint8)


def front_coded(suffix: np.ndarray, entries: np.ndarray, docs: np.ndarray) -> bytes:
    """A sorted part of a run: known prefixes, rests, entries, and their documents."""
    known = common_prefixes(suffix)
    rest = suffix[np.arange(GRAM)[None, :] >= known[:, None]]
    own, place = np.unique(entries["doc"], return_inverse=True)
    entries = entries.copy()
    entries["doc"] = place
    body = [known.tobytes(), rest.tobytes(), entries.tobytes(), docs[own].tobytes()]
    packed = struct.pack("<III", len(known), len(rest), len(own)) + b"".join(body)
    return zstandard.ZstdCompressor(level=1).compress(packed)


def with_stretch(suffix: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Rows of letters: suffixes, and the hashes of their stretches behind them."""
    return np.hstack([suffix, stretch.astype(">u8").view(np.uint8).reshape(-1, 8)])


class Run:
    """A front-coded part of a run, read back."""

    def __init__(self, blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, letters, docs = struct.unpack_from("<III", data)
        at = 12
        self.known = data[at : at + n]
        at += n
        self.rest = data[at : at + letters]
        at += letters
        self.entries = np.frombuffer(data, ENTRY, n, at)
        at += n * ENTRY.itemsize
        self.docs = np.frombuffer(data, "<i8", docs * 3, at).reshape(-1, 3)

    def suffixes(self) -> Iterator[tuple[int, bytes]]:
        """(known common prefix with the one before, suffix)."""
        at, last, rest = 0, b"", self.rest
        for known in self.known:
            end = at + GRAM - known
            last = last[:known] + rest[at:end]
            at = end
            yield known, last


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the one before, suffix) of all runs in order.

    A tree of losers in which every contender knows its common prefix with the last
    winner. Of two, the one with the longer known prefix is smaller; only if both are
    equal are letters compared, from there on, and the loser then knows its common
    prefix with the winner. A run that has ended loses against all.
    """
    n = 1
    while n < len(runs):
        n *= 2
    nexts = [iter(r).__next__ for r in runs]
    words: list[bytes | None] = [None] * n
    prefix = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's known prefix."""
        x, y = words[a], words[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        i, j = int.from_bytes(x[p:], "big"), int.from_bytes(y[p:], "big")
        differ = i ^ j
        same = GRAM - (differ.bit_length() + 7) // 8
        if i <= j:
            prefix[b] = same
            return a, b
        prefix[a] = same
        return b, a

    for i, take in enumerate(nexts):
        try:
            _, words[i] = take()
        except StopIteration:
            pass
    losers = [0] * n

    def first(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    champion = first(1)
    while words[champion] is not None:
        yield champion, prefix[champion], words[champion]
        try:
            prefix[champion], words[champion] = nexts[champion]()
        except StopIteration:
            words[champion] = None
        node = (champion + n) >> 1
        while node:
            champion, losers[node] = play(champion, losers[node])
            node >>= 1


FOUND = "doc_id long, has_id boolean, hash long, low long, high long"


def sorted_runs(docs: DataFrame, length: int, borders: list[bytes]) -> DataFrame:
    """Front-coded parts of runs by range, and what a run alone shows to be twice
    there (range null). Of a run's equal stretches one goes on."""
    schema = f"range int, blob binary, {FOUND}"
    limits = np.array([np.frombuffer(b, np.uint8) for b in borders], np.uint8)
    limits = limits.reshape(-1, GRAM + 8).view(f"S{GRAM + 8}").ravel()

    def rows_of(names: dict, n: int) -> pa.RecordBatch:
        kinds = [
            ("range", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()),
            ("has_id", pa.bool_()), ("hash", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(names[k], t) if k in names else pa.nulls(n, t) for k, t in kinds],
            [k for k, _ in kinds],
        )

    def flush(held: list[tuple], docs: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        doc, low, high, suffix, stretch = (np.concatenate(c) for c in zip(*held))
        named = np.array(docs, dtype=np.int64)
        joined = with_stretch(suffix, stretch)
        order = np.argsort(np.ascontiguousarray(joined).view(f"S{GRAM + 8}").ravel(), kind="stable")
        joined = joined[order]
        doc, low, high = doc[order], low[order], high[order]
        same = (joined[1:] == joined[:-1]).all(axis=1)
        head = np.concatenate([[True], ~same])
        twice = np.concatenate([same, [False]]) | ~head
        some = np.flatnonzero(twice)
        if len(some):
            own = named[doc[some]]
            yield rows_of(
                {
                    "doc_id": own[:, 0], "has_id": own[:, 1] == 1, "hash": own[:, 2],
                    "low": low[some], "high": high[some],
                },
                len(some),
            )
        entries = np.zeros(int(head.sum()), ENTRY)
        entries["doc"], entries["low"], entries["high"] = doc[head], low[head], high[head]
        entries["twice"], entries["stretch"] = twice[head], stretch[order][head]
        suffix = joined[head]
        cuts = np.searchsorted(suffix.view(f"S{GRAM + 8}").ravel(), limits)
        suffix = suffix[:, :GRAM]
        edges = [0, *cuts.tolist(), len(suffix)]
        for r, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                blob = front_coded(suffix[a:b], entries[a:b], named)
                yield rows_of({"range": [r], "blob": [blob]}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, named, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [t.encode() for t in part.column("text").to_pylist()]
                first = len(named)
                for doc, h in zip(part.column("doc_id").to_pylist(), part.column("hash").to_pylist()):
                    named.append((doc or 0, doc is not None, h))
                for row, *columns in found_in(rows, length):
                    held.append((row + first, *columns))
                    n += len(row)
                if n >= RUN:
                    yield from flush(held, named)
                    held, named, n = [], [], 0
        if n:
            yield from flush(held, named)

    return docs.mapInArrow(run, schema)


def merge_range(
    blobs: list[bytes], border: set[bytes], together: int
) -> tuple[list[tuple], list[tuple]]:
    """Of one range: places that are there twice, and stretches of groups with different
    ones as (group, large, twice, place). A group whose suffix is at a `border` may go
    on beyond it and counts as large, like one of more than `together` stretches. Groups
    are told by a hash; should two have the same, their strings are compared in vain."""
    runs = [Run(b) for b in blobs]
    twice = [r.entries["twice"].tolist() for r in runs]
    stretch = [r.entries["stretch"].tolist() for r in runs]
    at = [0] * len(runs)
    whole, edges = [], []
    group: list[tuple[int, int]] = []

    def close(suffix: bytes) -> None:
        open_end = suffix in border
        if len(group) < 2 and not open_end:
            return
        by_stretch = defaultdict(list)
        for r, i in group:
            by_stretch[stretch[r][i]].append((r, i))
        name = signed(xxhash.xxh3_64_digest(suffix))[0]
        large = open_end or len(by_stretch) > together
        for places in by_stretch.values():
            # one that its own run holds twice has been handed on there
            again = len(places) > 1 or bool(twice[places[0][0]][places[0][1]])
            if len(places) > 1:
                whole.extend(places)
            if len(by_stretch) > 1 or open_end:
                edges.append((name, large, again, *places[0]))

    last = b""
    for r, prefix, suffix in merged([x.suffixes() for x in runs]):
        if prefix < GRAM:
            close(last)
            group = []
        group.append((r, at[r]))
        at[r] += 1
        last = suffix
    close(last)
    return (
        [named(runs[r], i) for r, i in whole],
        [(*told, *named(runs[r], i)) for *told, r, i in edges],
    )


def signed(digest: bytes) -> tuple[int, ...]:
    """A hash as longs."""
    return struct.unpack(f">{len(digest) // 8}q", digest)


def named(run: Run, i: int) -> tuple:
    e = run.entries[i]
    doc = run.docs[e["doc"]]
    return int(doc[0]), bool(doc[1]), int(doc[2]), int(e["low"]), int(e["high"])


MERGED = f"group long, large boolean, twice boolean, {FOUND}"


def merge_runs(parts: DataFrame, borders: list[bytes], together: int) -> DataFrame:
    """For every range: stretches that are there twice (group null), and those of
    groups with different stretches."""

    schema = to_arrow_schema(T.StructType.fromDDL(MERGED))

    def one(blobs: pa.Table) -> pa.Table:
        r = blobs.column("range")[0].as_py()
        border = {b[:GRAM] for b in borders[max(0, r - 1) : r + 1]}
        whole, edges = merge_range(blobs.column("blob").to_pylist(), border, together)
        rows = [(None, None, None, *x) for x in whole] + edges
        columns = zip(*rows) if rows else [[]] * len(schema)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.Table.from_arrays(arrays, schema=schema)

    ranges = parts.filter("range IS NOT NULL").select("range", "blob")
    return ranges.groupBy("range").applyInArrow(one, MERGED)


def strings(stretch: bytes, length: int) -> list[bytes]:
    """Hashes of a stretch's strings."""
    digest = xxhash.xxh3_128_digest
    return [digest(stretch[i : i + length]) for i in range(len(stretch) - length + 1)]


def strings_twice(stretches: list[bytes], twice: list[bool], length: int) -> list[list[int]]:
    """For each of a group's different stretches, the first places of strings that
    another one holds too."""
    seen: dict[bytes, int] = {}
    again: set[bytes] = set()
    found = []
    for t, s in enumerate(stretches):
        own = strings(s, length)
        again.update(h for h in own if seen.setdefault(h, t) != t)
        found.append(own)
    return [
        [] if whole else [i for i, h in enumerate(own) if h in again]
        for own, whole in zip(found, twice)
    ]


def runs_of(places: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of unbroken runs of growing places."""
    start = last = None
    for p in places:
        if start is None:
            start = p
        elif p != last + 1:
            yield start, last
            start = p
        last = p
    if start is not None:
        yield start, last


CUT = "key long, large boolean, twice boolean, doc_id long, hash long, low long, stretch binary"


def fetched(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """The bytes of stretches (CUT); key is the group."""
    wanted = edges.groupBy("doc_id", "has_id", "hash").agg(
        F.collect_list(F.struct("group", "large", "twice", "low", "high")).alias("places")
    )
    wanted = wanted.withColumnsRenamed({"doc_id": "own_id", "hash": "own_hash"})
    own = F.when(F.col("has_id"), F.col("own_id"))
    found = docs.join(
        wanted, (F.col("hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(own)
    ).select("doc_id", "hash", "text", "places")
    names = [c.split()[0] for c in CUT.split(", ")]

    def cut(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc, h, text, places in zip(*(batch.column(c).to_pylist() for c in range(4))):
            data = text.encode()
            for p in places:
                stretch = data[p["low"] : p["high"] + length]
                rows.append((p["group"], p["large"], p["twice"], doc, h, p["low"], stretch))
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    return map_slices(found, cut, CUT)


def compare_gathered(stretches: DataFrame, length: int) -> DataFrame:
    """FOUND rows of groups that are small enough to be compared in one task each."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_by_key(batches):
            c = {n: rows.column(n).to_pylist() for n in rows.schema.names}
            once, place = {}, []  # a repeated row brings its stretches again
            for s, whole in zip(c["stretch"], c["twice"]):
                place.append(once.setdefault(s, (len(once), whole))[0])
            found = strings_twice(list(once), [w for _, w in once.values()], length)
            got = [
                (c["doc_id"][k] or 0, c["doc_id"][k] is not None, c["hash"][k],
                 c["low"][k] + a, c["low"][k] + b)
                for k, p in enumerate(place)
                for a, b in runs_of(found[p])
            ]
            if got:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*got))))

    return stretches.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def compare_spread(stretches: DataFrame, length: int) -> DataFrame:
    """FOUND rows of groups of any size, one for each string. Strings are counted by
    their hashes, in part before the shuffle; a string that very many stretches hold is
    a hot key of a semi-join only, which adaptive execution splits."""
    schema = f"one long, two long, stretch long, twice boolean, {FOUND}"
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batch: pa.RecordBatch) -> dict:
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("doc_id", "hash", "low", "twice", "stretch"))
        for doc, h, low, twice, s in zip(*columns):
            own = signed(xxhash.xxh3_64_digest(s))[0]
            for at, digest in enumerate(strings(s, length), low):
                rows.append((*signed(digest), own, twice, doc or 0, doc is not None, h, at, at))
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    found = map_slices(stretches, each, schema)
    again = found.groupBy("one", "two").agg(
        F.min("stretch").alias("first"), F.max("stretch").alias("last")
    )
    again = again.filter("first < last").select("one", "two")
    found = found.filter("NOT twice").join(again, ["one", "two"], "left_semi")
    return found.select(*[x.split()[0] for x in FOUND.split(", ")])


def compare_edges(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """Stretches of strings (FOUND) that stand in two different stretches of a group."""
    # written, or each of its readers would join the texts anew
    stretches = saved(fetched(docs, edges, length))
    gathered = compare_gathered(stretches.filter("NOT large"), length)
    return gathered.union(compare_spread(stretches.filter("large"), length))


def range_borders(docs: DataFrame, length: int, ranges: int) -> list[bytes]:
    """Suffixes, with their stretches' hashes, that cut a sample's into equal parts. The
    sample is a share of all texts, so that it grows with the number of ranges."""
    if ranges < 2:
        return []
    drawn = F.pmod(F.xxhash64("doc_id", "hash", F.lit(5)), F.lit(SAMPLE_SHARE)) == 0

    def keys(batch: pa.RecordBatch) -> dict:
        found = set()
        for *_, suffix, stretch in found_in([t.encode() for t in texts(batch)], length):
            some = stretch % np.uint64(SAMPLE_ANCHORS) == 0
            found.update(row.tobytes() for row in with_stretch(suffix[some], stretch[some]))
        return {"key": sorted(found)}

    sample = map_slices(docs.filter(drawn).select("text"), keys, "key binary").distinct()
    found = sorted(bytes(r.key) for r in sample.toLocalIterator())
    if not found:
        return []
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)})


def duplicates(docs: DataFrame, length: int) -> DataFrame:
    """FOUND rows: strings that begin from low to high in a document stand elsewhere too.
    `docs` has doc_id, hash (of the text) and text without nulls."""
    if length < GRAM:
        raise ValueError(f"strings must have {GRAM} bytes at least")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    borders = range_borders(docs, length, math.ceil(total / RANGE_BYTES))
    parts = saved(sorted_runs(docs, length, borders))
    columns = [c.split()[0] for c in FOUND.split(", ")]
    local = parts.filter("range IS NULL").select(*columns)
    both = saved(merge_runs(parts, borders, TOGETHER))
    whole = both.filter("group IS NULL").select(*columns)
    edges = compare_edges(docs, both.filter("group IS NOT NULL"), length)
    return local.union(whole).union(edges)


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("hash", F.xxhash64("text"))


def spans_by_text(rows: DataFrame, length: int) -> DataFrame:
    """own_id, has_id, own_hash and the first and last places of strings to remove."""
    found = duplicates(rows, length)
    found = found.groupBy("doc_id", "has_id", "hash").agg(
        F.collect_list("low").alias("low"), F.collect_list("high").alias("high")
    )
    return found.select(
        F.when(F.col("has_id"), F.col("doc_id")).alias("own_id"),
        F.col("hash").alias("own_hash"),
        F.arrays_zip("low", "high").alias("spans"),
    )


def covered(spans: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings cover."""
    runs: list[list[int]] = []
    for a, b in sorted((s["low"], s["high"] + length) for s in spans or []):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row."""
    rows = hashed(docs)
    spans = saved(spans_by_text(rows, length))
    rows = rows.join(
        spans,
        (F.col("hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id")),
        "left",
    ).select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> dict:
        data = [t.encode() for t in batch.column("text").to_pylist()]
        runs = [covered(s, length) for s in batch.column("spans").to_pylist()]
        kept = [without(d, r) for d, r in zip(data, runs)]
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": [len(d) for d in data],
            "n_removed": [len(d) - len(k) for d, k in zip(data, kept)],
            "n_spans": [len(r) for r in runs],
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
        }

    return map_slices(
        rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def cut_texts(text: pa.Array, spans: pa.Array, length: int) -> pa.Array:
    """Texts without their spans. Of a batch, which may have 10,000 rows, only a slice is
    held as Python objects at a time."""

    def one(text: str | None, spans: list | None) -> str | None:
        if text is None or spans is None:
            return text
        return without(text.encode(), covered(spans, length)).decode("utf-8", "ignore")

    parts = [pa.array([], text.type)]
    for at in range(0, len(text), SLICE_ROWS):
        some = (c.slice(at, SLICE_ROWS).to_pylist() for c in (text, spans))
        parts.append(pa.array([one(t, s) for t, s in zip(*some)], text.type))
    return pa.concat_arrays(parts)


def cut_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The rows, with all their columns, whose text lacks what remove_repeats removes.
    Letters that a cut leaves in part are dropped; null texts stay null."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return cut_texts(text, spans, length)

    spans = saved(spans_by_text(hashed(docs), length))
    keyed = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (keyed["__hash"] == spans["own_hash"]) & keyed["doc_id"].eqNullSafe(spans["own_id"])
    joined = keyed.join(spans, same, "left")
    return joined.select(
        *(
            cut(keyed[c], spans["spans"]).alias(c) if c == "text" else keyed[c]
            for c in docs.columns
        )
    )
