"""The encoding transducer against a merge of whole words and the library, the decoder against bytes, and the memory of both."""

import json
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm import bpe, queries

PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary(PATH))


def whole(v, data):
    """Merges of least rank, leftmost first, by a search for each."""
    ids = [*map(v.first.__getitem__, data[:-1]), v.last[data[-1]]]
    while True:
        ranks = [(v.ranks[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in v.ranks]
        if not ranks:
            return ids
        r, k = min(ranks)
        ids[k : k + 2] = [v.merged[r]]


def cut(rng, data):
    while data:
        n = rng.randint(1, 700)
        yield data[:n]
        data = data[n:]


@pytest.mark.parametrize("alphabet", ["ab", "aeiou", "the", "abcdefghijklmnopqrstuvwxyz", "é漢\U0001f600"])
def test_streams_as_it_merges(enc, monkeypatch, alphabet):
    """Words far longer than the window, in pieces of any size, against a merge of the whole; text decoding gives bytes back piece by piece."""
    monkeypatch.setattr(bpe, "WINDOW", 64)
    monkeypatch.setattr(bpe, "PIECE", 100)
    rng = random.Random(3)
    word = "".join(rng.choice(alphabet) for _ in range(2000))
    want = whole(enc.v, word.encode())
    assert list(enc.stream(cut(rng, word.encode()))) == want == list(enc.word(word))
    if alphabet.isascii():  # one word for the tokenizer too
        assert [len(x) for x in enc.encode_pieces(word)][:-1] == [100] * (len(want) // 100)
    dec = bpe.Decoder(enc.v, "text")
    assert "".join([dec.feed([i]) for i in want] + [dec.feed([], last=True)]) == word + " "


def made_up(rng, tmp_path, ordered):
    """A tokenizer file of few symbols with random merges; parts of a merge come before it only if ordered."""
    with open(PATH, encoding="utf-8") as f:
        said = json.load(f)
    end = said["model"]["end_of_word_suffix"]
    symbols = bpe.byte_symbols()
    vocab = {t: k for k, t in enumerate([*symbols, *(s + end for s in symbols)])}
    have, merges = ["a", "b", "c", "a" + end, "b" + end, "c" + end], []
    for _ in range(12):
        a, b = rng.choice([t for t in have if not t.endswith(end)]), rng.choice(have)
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            have.append(a + b)
            merges.append(f"{a} {b}")
    if not ordered:
        rng.shuffle(merges)
    said["model"] |= {"vocab": vocab, "merges": merges}
    said["added_tokens"] = []
    path = tmp_path / f"{rng.random()}.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("ordered", [True, False])
def test_random_merge_lists(tmp_path, monkeypatch, ordered):
    """A few symbols of lookahead, also where no bound is known and words are read whole."""
    monkeypatch.setattr(bpe, "WINDOW", 3)
    rng = random.Random(7)
    unbound = 0
    for _ in range(150):
        e = bpe.Encoder(bpe.Vocabulary(made_up(rng, tmp_path, ordered)))
        unbound += e.v.lookahead is None
        for _ in range(12):
            data = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60))).encode()
            assert list(e.stream(cut(rng, data))) == whole(e.v, data)
    assert bool(unbound) != ordered


def test_special_tokens_and_long_words_are_the_library_s(enc):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    specials = list(enc.v.special)
    for text in ("", " ", "a" * 50_000, "ab " * 30_000 + "é" * 20_000, specials[0] * 3 + "x" + specials[-1], "漢字" * 9000, "1" * 40_000 + " ΑΣ Σ", "x" * bpe.PIECE + " " + "y" * (bpe.PIECE + 1)):
        want = t.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == want
        dec = bpe.Decoder(enc.v)
        assert "".join([*(dec.feed(x) for x in enc.encode_pieces(text)), dec.feed([], last=True)]) == t.decode(want, skip_special_tokens=False)


def test_decoder_keeps_three_bytes_at_most(enc):
    emoji = enc.encode("\U0001f600")
    dec = bpe.Decoder(enc.v, "text")
    assert "".join([dec.feed([i]) for i in emoji] + [dec.feed([], last=True)]).strip() == "\U0001f600"
    broken = [enc.v.first[0xF0], enc.v.first[0x9F], enc.v.last[0x61]]
    dec = bpe.Decoder(enc.v, "text")
    assert "".join([dec.feed([i]) for i in broken] + [dec.feed([], last=True)]) == b"\xf0\x9fa ".decode("utf-8", "replace")


def test_memory_is_constant(enc):
    """A word of three million bytes that is made as it is read: neither it nor its ids are ever held."""
    rng = random.Random(2)
    some = ["".join(rng.choice("etaoinshrdlu") for _ in range(1000)).encode() for _ in range(50)]

    def peak(n):
        tracemalloc.start()
        count = sum(1 for _ in enc.stream(some[k % 50] for k in range(n)))
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, count

    peak(20)
    small, a = peak(50)
    large, b = peak(500)
    assert large < 1.3 * small and small < 8 << 20 and b > 9 * a
    assert np.dtype(np.int32).itemsize * b > 0


def test_remembers_what_comes_again(enc):
    """Words that come once take no memory, those that come again do so once, with their ids as bytes; ids are the same before and after."""
    rng = random.Random(5)
    own = bpe.Encoder(enc.v)
    once = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(20_000)]
    tracemalloc.start()
    for at in range(0, len(once), 500):
        own.encode(" ".join(once[at : at + 500]))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1_000_000  # over 5 MB with an entry in both memories for each
    again = ["plain", "comma,", "comma", "naïve", "漢字", "don't", "a-b", *once[:50]]
    want = Tokenizer.from_file(PATH).encode(" ".join(again), add_special_tokens=False).ids
    assert own.encode(" ".join(again)) == own.encode(" ".join(again)) == own.encode(" ".join(again)) == want
    assert all(type(own.stretches.get(s)) is bytes for s in again)
    assert not any(own.words.get(s) for s in ("plain", *once[:50]))
