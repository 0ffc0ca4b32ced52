import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ordermart.llm import bpe, packing
from ordermart.llm.packing import Limits, Packer, Piece
from ordermart.llm.queries import QUERIES

from .conftest import AWKWARD, SF

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = "ab cdé'st'llreve  \n\t\x0b\x1c\x1f\x85\xa0 ​漢字😀٣Ⅷ½ǅσΣ̧́éİ!!?%%12345the inging"


def strange(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40)))
        yield text[:5] + rng.choice(["", "<|endoftext|>", "<|startoftext|>"]) + text[5:]


def hashes(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    joined = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_is_the_tokenizers_on_strange_texts():
    tokenizer, encoder = Tokenizer.from_file(BYTES), bpe.Encoder(BYTES)
    for text in strange(4000):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        ids, decoded = encoder.encode(text)
        assert ids == ",".join(map(str, want))
        assert decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    tokenizer, encoder = Tokenizer.from_file(BYTES), bpe.Encoder(BYTES)
    text = "many different words that won't fit the cache, many times different"
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == (",".join(map(str, want)), text)


@pytest.mark.parametrize("given", [AWKWARD, []])
def test_bpe_on_awkward_rows(docs, given):
    found = bpe.encode_decode(docs(given), BYTES, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found]
    want = [(i, *hashes(tokenizer, t)) for i, t in given]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(len(r.ids) == r.n_tokens for r in found)


def test_bpe_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(BYTES)
    found = QUERIES["op9_bpe"](spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == hashes(tokenizer, rows[r.doc_id])


def test_words_of_letters_take_no_normalizer(monkeypatch):
    """Words of Latin letters, whatever their case and the signs behind them, are learnt
    without the tokenizer's normalizer and pattern, with its ids."""
    tokenizer, ids = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    text = "Éanèier ÀÞÿß straße, STRASSE. ªº µm queBEß!! a Ø the\nThe THE."
    encode, seen = ids.encode, []
    monkeypatch.setattr(ids, "encode", lambda t: seen.append(t) or encode(t))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids([text])[0], "<u4").tolist() == want
    assert not any(c.isalpha() for t in seen for c in t.replace(packing.SEPARATOR, ""))
    every = [chr(c) + end for c in range(1, 0x250) for end in ("", "a", "\u0301", "!", "\u0301!")]
    for word, found in zip(every, ids(every)):
        want = tokenizer.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(found, "<u4").tolist() == want


def test_word_ids_are_the_tokenizers():
    tokenizer, ids = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    given = list(strange(4000))
    for text, found in zip(given, ids(given)):
        assert np.frombuffer(found, "<u4").tolist() == (
            tokenizer.encode(text, add_special_tokens=False).ids
        )


def test_words_are_looked_up_once_a_run(monkeypatch):
    """Whatever its case, the signs behind it and the text that holds it, a word of Latin
    letters is looked up once and kept once."""
    ids, looked = packing.WordIds(WORDS), []
    look_up = ids.look_up
    monkeypatch.setattr(ids, "look_up", lambda ws: looked.extend(ws) or look_up(ws))
    ids(["Word word, WORD!! \u00c9t\u00e9", "word.\n\u00e9t\u00e9 \u00c9T\u00c9, it's. word"] * 20)
    assert sorted(looked) == sorted(["word", "\u00e9t\u00e9", "", ",", "!!", ".", "it's."])
    assert not {"Word", "word,", "WORD!!", "\u00e9t\u00e9,"} & ids.known.keys()


@pytest.mark.parametrize("run_bytes", [1, 50, 1 << 20])
def test_word_ids_of_columns_in_runs(monkeypatch, run_bytes):
    """Runs of one text and of many, nulls, empty texts and a slice of a column."""
    monkeypatch.setattr(packing, "RUN_BYTES", run_bytes)
    tokenizer, ids = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    given = [None, "", *strange(60), None, "a " * 99, "", " \n ", "Word.\n\nWORD", None]
    for texts in (given, given[:1], ["", ""], []):
        column = pa.array(["cut off", *texts, "cut off"], pa.string()).slice(1, len(texts))
        found = list(ids.column(column))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [f.tolist() for f in found] == want


def check_packing(found, given, limits=Limits()):
    """Every id in one piece, pieces as told, sequences gapless and within the limits."""
    tokenizer = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in given:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    assert by_doc.keys() == want.keys()
    for i, texts in want.items():
        pieces = [(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[i]]
        assert sum(p[1] for p in pieces) == sum(map(len, texts))
        for start, length, crc, total in pieces:
            assert any(
                len(ids) == total
                and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
                for ids in texts
            )
        if len(texts) == 1:
            at = 0
            for start, length, *_ in sorted(pieces):
                assert start == at
                at += length
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p.loss_tokens for p in pieces) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_word_ids_of_signs_case_and_a_full_cache(monkeypatch):
    """Signs behind words, letters that change with their case, more words than are kept."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    ours = packing.WordIds(WORDS)
    theirs = Tokenizer.from_file(WORDS)
    theirs.no_truncation()
    theirs.no_padding()
    odd = ["Word.", "WORD!!", "it's.", "a.b.", "T\u0308.", "t\u0308.", "\u0130.", "\u0391\u03a3.", "x'S.",
           "1.", "a1.", "...", "$$a$$", "<|startoftext|>.", "a<|startoftext|>.", "A<|ENDOFTEXT|>.", "",
           "\u02b0.", "\u2167.", "a\x85B.", "Tail.,;:!?", "a\tB."]
    texts = [*odd, " ".join(odd), *[f"Word{i}, word{i % 7}. W{i}" for i in range(300)], "Word. word1."]
    for at in range(0, len(texts), 5):
        some = texts[at : at + 5]
        want = [e.ids for e in theirs.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in ours(some)] == want
        assert len(ours.known) <= 40 + 200


@pytest.mark.parametrize("given", [AWKWARD, []])
def test_packing_awkward_rows(docs, given):
    assert check_packing(packing.pack_texts(docs(given), WORDS).collect(), given) == 0


def test_packing_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert check_packing(QUERIES["op4_packing"](spark, SF).collect(), map(tuple, rows)) == 0


@pytest.mark.parametrize("limits", [Limits(64, 3, 40), Limits(64, 64, 7), Limits(1, 1, 1)])
def test_all_limits_hold_together(limits):
    rng = random.Random(3)
    out, total = [], 0
    packer = Packer(limits, 0, lambda p, s, o: out.append((p, s, o)))
    for doc in range(300):
        n = rng.choice([1, 2, 5, 30, 200])
        loss = np.concatenate([[0], np.cumsum([rng.random() < 0.5 for _ in range(n)])])
        packer.add(Piece(doc, 0, np.full(n, doc), loss, n))
        total += n
    packer.run(last=True)
    assert sum(len(p.ids) for p, *_ in out) == total
    by_sequence = defaultdict(list)
    for p, s, _ in out:
        by_sequence[s].append(p)
    for pieces in by_sequence.values():
        assert sum(len(p.ids) for p in pieces) <= limits.tokens
        assert len(pieces) <= limits.segments
        assert sum(p.loss_tokens for p in pieces) <= limits.loss


def test_conversations_bear_loss_in_answers_only(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found = packing.pack_conversations(turns, WORDS, limits=Limits(2048, 8, 512)).collect()
    assert 0 < sum(r.loss_tokens for r in found) < sum(r.length for r in found)
    loss = defaultdict(int)
    for r in found:
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) <= 512
