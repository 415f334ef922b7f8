import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from surfaceworks.llm import packing, token_files
from surfaceworks.llm.base import LETTERS, ChunkEncoder, encoder, slices

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_agrees_with_the_library_on_slices():
    texts = ["", None, "I'LL don't 'tis l'S ''s !'re", "ΑΣ İx ǅ ﬁ ² ½ _a_ Ⅷ", "a\x85b\x1fc d", "<|startoftext|>x <|endoftext|>", "é é ÀÉ×÷ªºµ ßẞ", " lead trail ", "42abc4.5"] * 3
    array = pa.array(["pad"] * 5 + texts).slice(5)
    for first, n in slices(array, 60):
        ids, counts = encoder("word_bpe_49k.json").encode(array.slice(first, n), 1)
        at = 0
        for text, k in zip(array.slice(first, n).to_pylist(), counts.tolist(), strict=True):
            assert ids[at : at + k].tolist() == ids_of(text)
            at += k


def test_encoder_agrees_with_the_library_on_signs():
    """All ASCII control signs and Latin-1 letters between what the file cuts, the vertical tab included."""
    r = random.Random(4)
    parts = [chr(c) for c in range(1, 256)] + ["'s", "'ll", "say", "it", "!", "2", "\x0b", " ", "\x0b'", "é"] * 12
    texts = ["say it!\x0b's", *("".join(r.choices(parts, k=12)) for _ in range(20_000))]
    ids, counts = encoder("word_bpe_49k.json").encode(pa.array(texts), 1)
    ends = np.cumsum(counts)
    bad = [t for t, a, b in zip(texts, ends - counts, ends, strict=True) if ids[a:b].tolist() != ids_of(t)]
    assert not bad, bad[:3]


class Counting:
    """A tokenizer that remembers what it got as texts."""

    def __init__(self):
        self.got = []

    def encode_batch_fast(self, texts, **how):
        self.got += texts
        return TOKENIZER.encode_batch_fast(texts, **how)


def test_words_of_letters_skip_what_cuts_texts():
    r, e = random.Random(6), ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    e.tokenizer = Counting()
    texts = [" ".join("".join(r.choices(LETTERS.replace("þ", "þÞÀ"), k=r.randint(1, 12))) for _ in range(20)) for _ in range(2_000)]
    ids, counts = e.encode(pa.array(texts), 1)
    assert not e.tokenizer.got
    ends = np.cumsum(counts)
    assert all(ids[a:b].tolist() == ids_of(t) for t, a, b in zip(texts, ends - counts, ends, strict=True))


def test_words_used_lately_stay_remembered():
    e = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), most=40)
    e.encode(pa.array([" ".join(f"日{i}" for i in range(100))]))  # fills it
    e.tokenizer = Counting()
    for i in range(0, 100, 5):
        text = " ".join(["月", *(f"火{k}" for k in range(i, i + 5))])
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == ids_of(text)[:-1]
    assert e.tokenizer.got.count("月") == 1 and len(e.known) + len(e.before) <= 40


def test_packing_covers_each_id_once(odd, empty):
    rows = packing.pack(odd, length=64).orderBy("sequence_id", "offset").collect()
    for s, group in itertools.groupby(rows, lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at and crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
            at += r.length
        assert at == 64 or s == rows[-1].sequence_id
    want = sorted((-1 if r.doc_id is None else r.doc_id, ids_of(r.text)) for r in odd.collect())
    got, open_doc = [], []
    for r in rows:  # documents follow each other in the stream
        open_doc += np.frombuffer(r.ids, "<u4").tolist()
        if r.start + r.length == r.doc_tokens:
            got.append((-1 if r.doc_id is None else r.doc_id, open_doc))
            open_doc = []
    assert sorted(got) == want
    assert packing.pack(empty).count() == 0


def test_token_files_round_trip(spark, odd, empty):
    manifest = token_files.write(odd, length=128)
    got = token_files.read_documents(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(i), crc(i)) for i in (ids_of(r.text) for r in odd.collect()))
    file = token_files.SequenceFile(manifest.first().path)
    ids, mask = file[len(file) - 1]
    assert len(ids) == len(mask) == 128 and ids.dtype == np.uint16
    assert token_files.read_documents(spark, token_files.write(empty)).count() == 0
