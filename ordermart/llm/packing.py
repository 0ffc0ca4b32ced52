"""Packing of tokenized examples into sequences under several limits at once.

Vector bin packing by the dot-product heuristic: an example is a vector of tokens,
segments (one) and loss-bearing tokens, each as a share of its limit. Into the open
sequence goes the example of the pool whose vector has the largest dot product with
what the sequence has left, so that examples which are heavy where there is most
room come first. Where no whole example fits, one is cut to fill the sequence. What
is left at the end of a partition closes at powers of two, which need no padding.

Each task packs the rows of its own partition, so nothing is shuffled; the sequence
id holds the partition's number. Read the rows from a table, whose partitions are
the same when a lost task runs again.

Null and empty texts are one piece of one token, the closing id. Texts of any length
are cut into as many pieces as they need. Repeated rows are packed each for itself;
an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words whose ids a worker keeps, twice: beyond it those that weren't met since the last
#: time go.
CACHE_WORDS = 400_000
#: Words that are encoded in one call.
CALL_WORDS = 256
#: Bytes of texts whose different words are looked up together; a longer text is a run of
#: its own.
RUN_BYTES = 2 << 20
#: Signs that always part from a letter before them. Fixed value.
SIGNS = ".,;:!?$&%#"
#: Words that `latin` and `isalpha` hold for. Fixed value.
LATIN_WORD = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: A special string of the vocabulary. Fixed value.
SEPARATOR = "<|startoftext|>"
#: Examples among which the heuristic chooses.
POOL = 256
#: Pieces that are handed on at once.
OUT_ROWS = 4096

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


class WordIds:
    """A tokenizer that drops white space, applied word by word with a bounded cache.

    Spaces and line feeds always separate words for it, so a text's ids are the ids
    of its words, one after another. Texts are split and joined by Arrow, and only the
    different words of a run of texts are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.letters, self.last = letters_only(self.tokenizer)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        return [ids.tobytes() for ids in self.column(pa.array(texts, pa.string()))]

    def column(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """Each text's ids; null is empty."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(texts):
            most = RUN_BYTES + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, most, "right")))
            yield from self.run(texts.slice(at, to - at))
            at = to

    def run(self, texts: pa.StringArray) -> list[np.ndarray]:
        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        words = pc.split_pattern(spaced.cast(pa.large_string()), " ")
        different = words.values.dictionary_encode()
        parts = stems_and_signs(different.dictionary).dictionary_encode()
        found = self.look_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, data = pa.array(found, pa.large_binary()).take(parts.indices).buffers()
        # a word's ids are those of its two parts, which lie side by side
        ids = strings(np.frombuffer(ends, np.int64)[: len(parts) + 1 : 2], data, pa.large_binary())
        _, ends, data = ids.take(different.indices).buffers()
        at = np.frombuffer(ends, np.int64)[words.offsets.to_numpy()] // 4
        ids = np.frombuffer(data, "<u4", at[-1])
        return [ids[start:end] for start, end in zip(at[:-1].tolist(), at[1:].tolist())]

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known = self.known
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        whole, apart = [], []
        for w in self.unmet([words[i] for i in missing]):
            stem, signs = stem_and_signs(w)
            if stem == w:
                whole.append(w)
            else:
                apart.append((w, stem, signs))
        parts = whole + self.unmet({p for _, *two in apart for p in two}.difference(whole))
        plain = [p for p in parts if p.isalpha() and latin(p)] if self.letters else []
        for at in range(0, len(plain), CALL_WORDS):
            self.learn_letters(plain[at : at + CALL_WORDS])
        if plain:
            parts = self.unmet(parts)
        for at in range(0, len(parts), CALL_WORDS):
            self.learn(parts[at : at + CALL_WORDS])
        for w, stem, signs in apart:
            known[w] = known[stem] + known[signs] if signs else known[stem]
        for i in missing:
            found[i] = known[words[i]]
        return found

    def unmet(self, words: Iterable[str]) -> list[str]:
        """The words without ids; those of the older half of the cache are kept on."""
        new = [w for w in words if w not in self.known]
        if self.older:
            kept = {w: self.older[w] for w in new if w in self.older}
            self.known |= kept
            new = [w for w in new if w not in kept]
        return new

    def learn(self, words: list[str]) -> None:
        """Encode words in one call, with a special string, which is always an id of
        its own, between them; words that hold it are encoded one by one."""
        together = [w for w in words if SEPARATOR not in w]
        ids = np.array(self.encode(SEPARATOR.join(together)), dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.separator), len(ids)) * 4
        data, start = ids.tobytes(), 0
        for w, end in zip(together, ends.tolist(), strict=bool(together)):
            self.known[w] = data[start:end]
            start = end + 4
        for w in set(words).difference(together):
            self.known[w] = np.array(self.encode(w), dtype="<u4").tobytes()

    def learn_letters(self, words: list[str]) -> None:
        """Encode words of small Latin letters in one call. Normalizing leaves them as they
        are and each is one piece for the model, whose last id holds the end of a word."""
        text = " ".join(words)
        found = self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(found, dtype="<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(words):  # a letter that the vocabulary lacks
            return
        data, start = ids.tobytes(), 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.known[w] = data[start:end]
            start = end

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def strings(ends: np.ndarray, data: pa.Buffer, kind: pa.DataType) -> pa.Array:
    """Strings side by side in a buffer, by where each ends."""
    ends = pa.py_buffer(np.ascontiguousarray(ends))
    return pa.Array.from_buffers(kind, len(ends) // 8 - 1, [None, ends, data])


def stems_and_signs(words: pa.LargeStringArray) -> pa.LargeStringArray:
    """Each word as two strings, one after the other: as `stem_and_signs` parts it if it is
    Latin letters and signs behind them, else itself and an empty string."""
    stems = pc.utf8_rtrim(words, SIGNS)
    plain = pc.match_substring_regex(stems, LATIN_WORD)
    # lower case takes as many bytes for these letters
    _, ends, data = pc.if_else(plain, pc.utf8_lower(words), words).buffers()
    sizes = pc.binary_length(pc.if_else(plain, stems, words)).to_numpy()
    at = np.empty(2 * len(words) + 1, np.int64)
    at[::2] = np.frombuffer(ends, np.int64, len(words) + 1)
    at[1::2] = at[:-1:2] + sizes
    return strings(at, data, pa.large_string())


def stem_and_signs(word: str) -> tuple[str, str]:
    """A word as its letters and the signs behind them, which the tokenizer encodes one
    after the other, so that a word is learnt once whatever follows it. Case, which it
    drops, is dropped here where all letters are Latin ones, as others may compose with what
    follows before they lose their case, and none may make up a special string."""
    stem = word
    if not word.isalpha():
        stem = word.rstrip(SIGNS)
        if not stem or not stem[-1].lower().isalpha():
            stem = word
    plain = "<" not in stem and latin(stem)
    return stem.lower() if plain else stem, word[len(stem) :]


def latin(word: str) -> bool:
    """Are all letters ASCII or Latin-1? None of these composes with another, and each
    lower-cases to one letter."""
    return word.isascii() or max(word) <= "\xff"


def letters_only(tokenizer) -> tuple[object | None, np.ndarray]:
    """A tokenizer on the same model for words of small letters between spaces, which takes
    no normalizer and no pattern, and which ids end a word; None where the model marks no
    ends."""
    from tokenizers import Tokenizer, pre_tokenizers

    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None, np.zeros(0, dtype=bool)
    letters = Tokenizer(tokenizer.model)
    letters.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return letters, last


@cache
def word_ids(path: str) -> WordIds:
    """One tokenizer for a worker's life."""
    return WordIds(path)


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    #: loss-bearing tokens before each position, one more than ids
    loss: np.ndarray
    total: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:at], self.loss[: at + 1], self.total),
            Piece(self.doc, self.start + at, self.ids[at:], self.loss[at:], self.total),
        )

    @property
    def loss_tokens(self) -> int:
        return int(self.loss[-1] - self.loss[0])

    def fitting(self, tokens: int, loss: int) -> int:
        """Tokens of the longest beginning that stays within both."""
        most = min(tokens, len(self.ids))
        return min(most, int(np.searchsorted(self.loss, self.loss[0] + loss, "right")) - 1)


class Packer:
    """Fills one sequence after another from a pool of pieces."""

    def __init__(self, limits: Limits, first_id: int, emit: Callable):
        self.limits, self.caps, self.emit = limits, limits.vector(), emit
        self.sequence = first_id
        self.pool: list[Piece] = []
        self.sizes = self.shares = np.zeros((0, 3))

    def add(self, piece: Piece) -> None:
        if len(piece.ids):
            self.pool.append(piece)

    def weigh(self) -> None:
        self.sizes = np.array(
            [(len(p.ids), 1, p.loss_tokens) for p in self.pool], dtype=np.float64
        ).reshape(-1, 3)
        self.shares = self.sizes / self.caps

    def take(self, i: int) -> Piece:
        """Take piece i; the pool's last one goes to its place."""
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i] = last
            self.sizes[i] = self.sizes[len(self.pool)]
            self.shares[i] = self.shares[len(self.pool)]
        return piece

    def put(self, piece: Piece) -> None:
        n = len(self.pool)
        self.pool.append(piece)
        if n == len(self.sizes):
            self.sizes = np.vstack([self.sizes, np.zeros((1, 3))])
            self.shares = np.vstack([self.shares, np.zeros((1, 3))])
        self.sizes[n] = (len(piece.ids), 1, piece.loss_tokens)
        self.shares[n] = self.sizes[n] / self.caps

    def fill(self) -> tuple[list[Piece], np.ndarray]:
        """One sequence's pieces, and what it has left."""
        left, bin_ = self.caps.copy(), []
        while self.pool and left.min() > 0:
            tokens, _, loss = self.sizes[: len(self.pool)].T
            dot = self.shares[: len(self.pool)] @ (left / self.caps)
            # the last segment should fill what is left, so it is cut if it is longer
            whole = tokens <= left[0] if left[1] > 1 else tokens == left[0]
            whole &= loss <= left[2]
            if whole.any():
                piece = self.take(int(np.where(whole, dot, -1.0).argmax()))
            else:
                i = int(np.argmax(dot))
                at = self.pool[i].fitting(int(left[0]), int(left[2]))
                if not at:
                    break
                piece = self.take(i)
                if at < len(piece.ids):
                    piece, rest = piece.cut(at)
                    self.put(rest)
            bin_.append(piece)
            left -= (len(piece.ids), 1, piece.loss_tokens)
        return bin_, left

    def close(self, bin_: list[Piece]) -> None:
        offset = 0
        for p in bin_:
            self.emit(p, self.sequence, offset)
            offset += len(p.ids)
        self.sequence += 1

    def trim(self, bin_: list[Piece]) -> list[Piece]:
        """Cut to a power of two; the rest goes back."""
        total = sum(len(p.ids) for p in bin_)
        over = total - (1 << (total.bit_length() - 1))
        while over:
            p = bin_.pop()
            keep = max(0, len(p.ids) - over)
            over -= len(p.ids) - keep
            if keep:
                p, rest = p.cut(keep)
                bin_.append(p)
            else:
                rest = p
            self.put(rest)
        return bin_

    def run(self, last: bool) -> None:
        """Make full sequences while the pool is large enough; at the end, all."""
        self.weigh()
        while self.pool and (last or len(self.pool) > POOL // 2):
            bin_, left = self.fill()
            self.close(bin_ if left[0] == 0 else self.trim(bin_))


def pack(
    examples: DataFrame,
    to_ids: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray | None]]],
    id_col: str,
    limits: Limits = Limits(),
    rows: int = 64,
) -> DataFrame:
    """Pieces of all examples with their places (SCHEMA). `to_ids` gives each row's ids
    and which of them bear loss (None: all), row after row as they are asked for."""
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be at least 1")
    if limits.tokens & (limits.tokens - 1):
        raise ValueError("the token limit must be a power of two")
    arrow = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit(p: Piece, sequence: int, offset: int) -> None:
            ids = np.ascontiguousarray(p.ids, dtype="<u4")
            crc = zlib.crc32(ids.tobytes())
            out.append(
                (p.doc, p.start, len(ids), crc, p.total, sequence, offset, p.loss_tokens)
            )

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

        packer = Packer(limits, TaskContext.get().partitionId() << 40, emit)
        for batch in batches:
            rows_ids = zip(batch.column(id_col).to_pylist(), to_ids(batch))
            for n, (doc, (ids, mask)) in enumerate(rows_ids, 1):
                loss = np.arange(len(ids) + 1, dtype=np.int64)
                if mask is not None:
                    np.cumsum(mask, out=loss[1:])
                packer.add(Piece(doc, 0, ids, loss, len(ids)))
                if n % rows and n < batch.num_rows:
                    continue
                if len(packer.pool) >= POOL:
                    packer.run(last=False)
                if len(out) >= OUT_ROWS:
                    yield flush()
        packer.run(last=True)
        yield flush()

    return examples.mapInArrow(run, SCHEMA)


def pack_texts(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents as examples: the tokenizer's ids and a closing id. All bear loss."""

    def to_ids(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        end = np.array([end_id], dtype="<u4")
        for ids in word_ids(path).column(batch.column("text")):
            yield np.concatenate([ids, end]), None

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pack(rows, to_ids, "doc_id", limits)


def pack_conversations(
    turns: DataFrame,
    path: str,
    end_id: int = 1,
    limits: Limits = Limits(),
    loss_role: str = "assistant",
) -> DataFrame:
    """Instruction data: turns of (conv_id, turn, role, text). Each turn is an example
    of a segment of its own; only turns of `loss_role` bear loss. doc_id is the
    conversation's id."""

    def to_ids(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        end = np.array([end_id], dtype="<u4")
        found = word_ids(path).column(batch.column("text"))
        for ids, role in zip(found, batch.column("role").to_pylist()):
            ids = np.concatenate([ids, end])
            yield ids, np.full(len(ids), role == loss_role)

    rows = turns.select(F.col("conv_id").cast("long").alias("doc_id"), "role", "text")
    return pack(rows, to_ids, "doc_id", limits)
