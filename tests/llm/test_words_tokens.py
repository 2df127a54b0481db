import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import tokens, words

RX = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TEXT = st.text(st.sampled_from(list("aAbZ é\t\n\x0b'.,1　\xa0 \x1cΣ<|>")), max_size=60)


def word_lists(texts):
    return [RX.findall((t or "").encode().translate(LOWER)) for t in texts]


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 64))
def test_words_are_those_of_the_pattern(texts, limit):
    got, names = [], {}
    for slab in words.slabs(pa.array(texts, pa.string()), limit):
        w = words.words(slab)
        h = words.span_hashes(slab.data, w.starts, w.ends)
        for i in range(len(slab)):
            part = range(w.first[i], w.first[i + 1])
            own = [slab.data[w.starts[k] : w.ends[k]].tobytes().translate(LOWER) for k in part]
            got.append(own)
            for x, k in zip(own, part, strict=True):
                assert names.setdefault(x, h[k]) == h[k]
    assert got == word_lists(texts) and len(set(names.values())) == len(names)


@given(st.lists(TEXT, max_size=6), st.integers(1, 5))
def test_shingles(texts, width):
    seen = {}
    for slab in words.slabs(pa.array(texts, pa.string())):
        w = words.words(slab)
        h, first = words.shingle_hashes(words.span_hashes(slab.data, w.starts, w.ends), w.first, width)
        for i, own in enumerate(word_lists(texts)):
            want = [tuple(own[k : k + width]) for k in range(len(own) - width + 1)] or ([tuple(own)] if own else [])
            assert first[i + 1] - first[i] == len(want)
            for s, x in zip(want, h[first[i] : first[i + 1]], strict=True):
                assert seen.setdefault(s, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_parts_give_the_library_s_ids(name):
    enc = tokens.Encoder(tokens.vocabulary_path(name), memo_parts=50)

    @given(st.lists(st.one_of(TEXT, st.text(max_size=30)), max_size=6))
    @settings(max_examples=150, deadline=None)
    def run(texts):
        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        got = [e.ids[e.first[i] : e.first[i + 1]].tolist() for slab, e in enc.encode(pa.array(texts, pa.string())) for i in range(len(slab))]
        assert got == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]

    run()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("memo", [50, 100_000])
def test_special_tokens_are_the_library_s(name, memo):
    path = tokens.vocabulary_path(name)
    enc, plain = tokens.Encoder(path, memo_parts=memo), Tokenizer.from_file(path)
    end = "<|endoftext|>"
    fixed = [f"hello {end} there", f"hello {end.upper()} there", f"hello {end} there", f"x{end}y, {end}{end}.", f"  {end}  \n", f"<{end}|>", "<|EndOfText|>", end, "<|endoftext", "<|startoftext|>A b", "<|StartOfText|>a B"]

    def same(texts):
        got = [e.ids[e.first[i] : e.first[i + 1]].tolist() for slab, e in enc.encode(pa.array(texts, pa.string())) for i in range(len(slab))]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]

    for texts in (fixed, fixed[::-1], *[[t] for t in fixed]):
        same(texts)
    piece = st.one_of(st.sampled_from([end, end.upper(), "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>"]), st.text(st.sampled_from(list("aAZ é\t\n'.,\xa0<|>!")), max_size=5))

    @given(st.lists(st.lists(piece, max_size=8).map("".join), max_size=6))
    @settings(max_examples=150, deadline=None)
    def run(texts):
        same(texts)

    run()


def thue_morse(a, b, doublings=10):
    x, y = a, b
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y


def test_patterns_do_not_collide():
    for a, b in (("a", "b"), ("é", "è"), ("abcdefgh", "ijklmnop"), ("ab", "ba")):
        for doublings in range(1, 14):
            pair = thue_morse(a, b, doublings)
            slab = next(words.slabs(pa.array(pair)))
            x, y = words.span_digests(slab.data, slab.bounds[:-1], slab.bounds[1:])
            assert x[0] != x[1] and y[0] != y[1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("weak", [False, True])
def test_parts_that_share_half_a_hash_keep_their_ids(name, weak, monkeypatch):
    if weak:  # many parts share their first 64 bits
        strong = tokens.span_digests
        monkeypatch.setattr(tokens, "span_digests", lambda *a, **k: (strong(*a, **k)[0] & np.uint64(7), strong(*a, **k)[1]))
    path = tokens.vocabulary_path(name)
    enc, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    x, y = thue_morse("a", "b")
    for texts in ([x], [y], [y, x], [f"one {x} two", f"one {y} two"], ["", "b", "a", "c d e f g h i j k l"]):
        got = [e.ids[e.first[i] : e.first[i + 1]].tolist() for slab, e in enc.encode(pa.array(texts)) for i in range(len(slab))]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
