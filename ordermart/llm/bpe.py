"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is exactly one token that ends its encoding. The
tokens that are suffixes of a prefix come from an automaton over the vocabulary;
of those, the one is right whose own beginning is compatible with the last token
of what precedes it: side by side, the two stay as they are under the merges.
Following the stored tokens back from the end yields the ids.

Null and empty texts encode to no ids. Ids of repeated rows are repeated. A text
of any length is encoded whole; memory holds one slice of rows and a bounded
cache of words.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from ordermart.llm.common import id_and_text, map_slices, texts

#: Words whose encoding a worker keeps; the cache starts anew beyond it.
CACHE_WORDS = 300_000

#: White space as the tokenizer's pattern engine defines it. Fixed values.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The pattern that splits a text into words. Fixed value.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes for themselves, the others for letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Known(dict):
    """Results by word, worked out when first asked for; starts anew beyond the bound."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = got = self.work(word)
        return got


class Encoder:
    """A tokenizer file as automaton, merges and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spell = {t: bytes(letters[c] for c in t) for t in vocab if t not in self.special}
        self.bytes_of = {vocab[t]: b for t, b in spell.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        #: rank of a merge by its two ids; a token's two parts and rank
        self.rank = {}
        self.parts = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault((vocab[a], vocab[b]), r)
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.auto = ahocorasick.Automaton()
        for t, b in spell.items():
            if len(b) == 1 or vocab[t] in self.parts:
                self.auto.add_word(b.decode("latin-1"), (len(b), vocab[t]))
        self.auto.make_automaton()
        self.words = regex.compile(WORDS)
        self.ids = Known(self.ids_text)
        self.spelled = Known(self.decode_word)
        self.fits: dict[tuple[int, int], bool] = {}
        self.at_special = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, are what the merges make of their bytes.

        Undo merges next to the seam, the latest first. If at some point the two
        pieces at the seam could be merged before the merge just undone, then they
        would have been, and the pair can't occur. Of equal merges the left one
        comes first, so one that crosses the seam precedes one right of it.
        """
        seen = self.fits.get((a, b))
        if seen is not None:
            return seen
        left, right, before = a, b, len(self.rank)
        good = True
        while True:
            if self.rank.get((left, right), before) < before:
                good = False
                break
            lp, rp = self.parts.get(left), self.parts.get(right)
            if lp is None and rp is None:
                break
            if rp is None or (lp is not None and lp[2] > rp[2]):
                before, left = lp[2], lp[1]
            else:
                before, right = rp[2] + 1, rp[0]
        if len(self.fits) > 4 * CACHE_WORDS:
            self.fits.clear()
        self.fits[a, b] = good
        return good

    def encode_bytes(self, word: bytes) -> list[int]:
        """The ids of one word: the last token of every prefix, then back from the end."""
        n = len(word)
        last, length = [0] * (n + 1), [0] * (n + 1)
        compatible = self.compatible
        for end, (size, token) in self.auto.iter(word.decode("latin-1")):
            end += 1
            if length[end]:
                continue  # there is one such token for a prefix
            start = end - size
            if start == 0 or compatible(last[start], token):
                last[end], length[end] = token, size
        ids = []
        at = n
        while at:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def ids_text(self, word: str) -> str:
        return ",".join(map(str, self.encode_bytes(word.encode())))

    def decode_word(self, word: str) -> bytes:
        """The bytes that a word's ids stand for."""
        return b"".join([self.bytes_of[int(i)] for i in self.ids[word].split(",")])

    def encode(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the text that they decode to."""
        if self.at_special is None:
            pieces = [text]
        else:
            pieces = self.at_special.split(text) if "<" in text else [text]
        ids, out = [], []
        special = self.special
        for piece in pieces:
            if piece in special:
                ids.append(str(special[piece]))
                out.append(self.bytes_of[special[piece]])
                continue
            words = self.words.findall(piece)
            ids.extend(map(self.ids.__getitem__, words))
            out.extend(map(self.spelled.__getitem__, words))
        return ",".join(ids), b"".join(out).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    """One encoder for a worker's life."""
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of doc_id and text;
    with_ids adds ids (array) and decoded (string)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batch):
        enc = encoder(path)
        both = [enc.encode(t) for t in texts(batch)]
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [i.count(",") + 1 if i else 0 for i, _ in both],
            "ids_sha256": [hashlib.sha256(i.encode()).hexdigest() for i, _ in both],
            "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in both],
        }
        if with_ids:
            out["ids"] = [[int(x) for x in i.split(",")] if i else [] for i, _ in both]
            out["decoded"] = [d for _, d in both]
        return out

    return map_slices(id_and_text(docs), run, schema)
