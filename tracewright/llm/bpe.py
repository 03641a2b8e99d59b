"""Byte-pair encoding and decoding as streaming transducers.

Encoding. Merges run in order of rank. What is still unseen to the right of n
symbols can shift the cut between agreed and open tokens to the left only by a
merge (u, v) whose v starts at that cut, by the length of u; after it, what
starts at the new cut begins with u. So a next shift needs a later merge whose
right part begins with u. The longest such chain, over all merges, is the
lookahead: tokens that end this far before the end of what has been read are
stable, and are emitted; the rest is kept, at most lookahead + WINDOW symbols
but for a token that is longer. Every word goes through this transducer, piece
by piece; the end of a word makes all that is kept stable. Ids of short words,
and of short stretches between white space, are remembered. The bound needs
every part of a merge to be made by an earlier one; a list without this order
gets no bound, and its words are read whole.

Decoding. Ids come in pieces of any size, and become bytes: of their tokens,
with a separator's between two where tokens are joined by one. Each piece gives
the text that is certain so far. Bytes of an unfinished character stay in the
state (three at most), bytes that can't be part of one give U+FFFD.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewright.llm.common import without

#: Symbols that a window adds to the lookahead.
WINDOW = 4096
#: Characters of a word that are read at once, and ids that come out of a long one at once.
PIECE = 1 << 14
#: Characters of a text that are normalised at once, if white space allows a cut.
SLICE = 1 << 16
#: Stretches between white space that a worker remembers, twice: the newer half, and the half before it. And the longest that it does.
REMEMBERED, LONGEST = 250_000, 40
#: Places that tell by a hash whether a text came before.
SEEN = 1 << 21
#: Characters, beyond a single row's, and rows in a batch that is given back.
TOGETHER, ROWS = 1 << 20, 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for themselves, the others from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: tokens, merges, words and special tokens. Files of BPE models with a word end, byte symbols and the steps of `load` only."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        steps = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in said["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or said.get("decoder"):
            raise ValueError(f"{path}: not a file of this kind")
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.symbols = byte_symbols()
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.first = [self.ids[s] for s in self.symbols]
        self.last = [self.ids[s + self.end] for s in self.symbols]
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.width = "H" if max(self.tokens, default=0) < 1 << 16 else "I"
        self.lookahead = lookahead(pairs, {*self.symbols, *(s + self.end for s in self.symbols)}, self.end)
        self.spellings: dict[str, dict[int, bytes]] = {}
        self.lengths = {i: max(1, len(t.removesuffix(self.end)) if self.end else len(t)) for i, t in self.tokens.items()}

    def spelt(self, kind: str) -> dict[int, bytes]:
        """The bytes of each token: those of its own name, or those that it stands for."""
        if kind not in self.spellings:
            number = {s: i for i, s in enumerate(self.symbols)}
            stands = lambda t: bytes(number[c] for c in t.removesuffix(self.end)) + b" " * t.endswith(self.end)
            self.spellings[kind] = {i: t.encode() if kind == "tokens" or t in self.special else stands(t) for i, t in self.tokens.items()}
        return self.spellings[kind]


def lookahead(pairs: list[tuple[str, str]], symbols: set[str], end: str = "") -> int | None:
    """Symbols that suffice for the merge list; None if a part of a merge is made after it, so that none is known to."""
    made = {a + b: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
    for rank, parts in enumerate(pairs):
        if any(p not in symbols and made.get(p, len(pairs)) >= rank for p in parts):
            return None
    size = lambda t: len(t.removesuffix(end)) if end else len(t)
    reach: dict[str, int] = {}  # for each prefix of a right part, the longest chain that starts with such a merge
    longest = 0
    for a, b in reversed(pairs):
        far = size(a) + reach.get(a, 0)
        longest = max(longest, far)
        for k in range(1, len(b) + 1):
            if reach.get(b[:k], 0) < far:
                reach[b[:k]] = far
    return longest


class Memory:
    """Text to ids, of bounded size: when the newer half is full it becomes the older one. Text is taken in when it comes again, for most never does."""

    def __init__(self):
        self.newer: dict = {}
        self.older: dict = {}
        self.seen = bytearray(SEEN)

    def get(self, key):
        got = self.newer.get(key)
        if got is None and (got := self.older.get(key)) is not None:
            self.newer[key] = got
        return got

    def put(self, found: dict) -> None:
        if len(self.newer) + len(found) > REMEMBERED:
            self.older, self.newer = self.newer, {}
            self.seen = bytearray(SEEN)
        self.newer.update((k, v) for k, v in found.items() if type(k) is int or len(k) <= LONGEST and self.again(k))

    def again(self, key: str) -> bool:
        """Whether a text with the place of this one came before, since the newer half began."""
        at = hash(key) % SEEN
        came, self.seen[at] = self.seen[at], 1
        return bool(came) or key in self.older


class Encoder:
    """Text to ids. All that lasts from text to text is the memory of stretches between white space, and of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.stretches, self.words = Memory(), Memory()

    def merge(self, ids: list[int]) -> list[int]:
        """The merges that apply to ids, each time the one of least rank, of these the leftmost."""
        if len(ids) > 48:
            return self.merge_many(ids)
        none, rank, merged = len(self.v.merged), self.v.ranks.get, self.v.merged
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i : i + 2] = [merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def merge_many(self, ids: list[int]) -> list[int]:
        """As merge, in n log n: pairs wait in a heap by rank and place, neighbours are linked."""
        rank, merged, n = self.v.ranks.get, self.v.merged, len(ids)
        after, ahead, heap = [*range(1, n), -1], [-1, *range(n - 1)], []
        ids = list(ids)

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (r := rank((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                ahead[after[j]] = i
            offer(ahead[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """The transducer: the ids of one word, whose bytes come in pieces, in bounded memory."""
        far, lengths, first = self.v.lookahead, self.v.lengths, self.v.first
        kept, enough = bytearray(), WINDOW
        for piece in pieces:
            for at in range(0, len(piece), WINDOW):
                kept += piece[at : at + WINDOW]
                if far is None or len(kept) <= far + enough:
                    continue
                done = 0
                # A symbol at least stays, for the word's last one is another.
                for token in self.merge([first[b] for b in kept]):
                    if done + lengths[token] > len(kept) - max(far, 1):
                        break
                    done += lengths[token]
                    yield token
                del kept[:done]
                enough = max(WINDOW, len(kept) - far + WINDOW)
        if kept:
            yield from self.merge([*map(first.__getitem__, kept[:-1]), self.v.last[kept[-1]]])

    def word(self, word: str) -> Iterator[int]:
        return self.stream(word[at : at + PIECE].encode() for at in range(0, len(word), PIECE))

    def packed(self, ids: Iterable[int]) -> bytes:
        """Ids as they are remembered: a tuple takes twice as much."""
        return array(self.v.width, ids).tobytes()

    def known(self, words: list[str]) -> Iterator[bytes]:
        """The ids of short words, from memory or, where it has none, from the transducer."""
        for w in words:
            # A plain word between white space is a stretch too: one memory of the two is enough.
            ids = self.stretches.get(w) if is_plain(w) else None
            ids = self.words.get(w) if ids is None else ids
            if ids is None:
                ids = self.packed(self.word(w))
                self.words.put({w: ids})
            yield ids

    def learn(self, stretches: set[str]) -> dict[str, bytes]:
        """The ids of stretches that aren't known, from those of their words."""
        return {s: (self.words.get(s) or self.packed(self.word(s))) if is_plain(s) else b"".join(self.known(self.v.words.findall(s))) for s in stretches}

    def split(self, text: str) -> Iterator[list]:
        """The text as lists of lower-case stretches, and numbers for special tokens. Words don't reach over white space."""
        at = 0
        for m in self.v.specials.finditer(text):
            yield from map(plain, slices(text[at : m.start()]))
            yield [self.v.special[m[0]]]
            at = m.end()
        yield from map(plain, slices(text[at:] if at else text))

    def lookup(self, flat: list) -> list[int]:
        got = list(map(self.stretches.newer.get, flat))
        if None in got:
            missing = {s for s, ids in zip(flat, got, strict=True) if ids is None}
            found = {s: self.packed([s]) if type(s) is int else self.stretches.older.get(s) for s in missing}
            found |= self.learn({s for s, ids in found.items() if ids is None})
            self.stretches.put(found)
            got = [found[s] if ids is None else ids for s, ids in zip(flat, got, strict=True)]
        return np.frombuffer(b"".join(got), self.v.width).tolist()

    def encode_pieces(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, as lists in order: one for each slice, and more for a long stretch without white space."""
        for part in self.split(text):
            if max(map(len, part), default=0) <= PIECE if part and type(part[0]) is str else True:
                yield self.lookup(part)
                continue
            for s in part:
                if len(s) <= PIECE:
                    yield self.lookup([s])
                    continue
                ids: list[int] = []
                for m in self.v.words.finditer(s):
                    for i in self.word(m[0]):
                        ids.append(i)
                        if len(ids) >= PIECE:
                            yield ids
                            ids = []
                yield ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_pieces(text)))


def is_plain(s: str) -> bool:
    """Whether a stretch is one word in any case."""
    return s.isascii() and s.isalpha()


def plain(part: str) -> list[str]:
    if not part.isascii():
        part = unicodedata.normalize("NFC", part)
        if "Σ" in part:  # lower() would look at its neighbours
            part = part.replace("Σ", "σ")
    # split() cuts at four control characters too, which the pattern doesn't hold for white space.
    return OWN_SPACE.split(part.lower()) if CONTROL.search(part) else part.lower().split()


def slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut only between white space and an ASCII character, where neither normal forms nor words reach across."""
    at = 0
    while len(text) - at > SLICE:
        m = CUT.search(text, at + SLICE)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


CUT = regex.compile(r"[ \n\t](?=[!-~])")
CONTROL = regex.compile(r"[\x1c-\x1f]")
OWN_SPACE = regex.compile(r"[ \n\t]+")


class Decoder:
    """Ids to text, piece by piece, through a byte-to-text state machine. As "tokens" it joins the tokens' own bytes with a space, as files without a decoder mean it; as "text" it gives back the bytes that they stand for, and a space for each word's end."""

    def __init__(self, vocabulary: Vocabulary, kind: str = "tokens"):
        if kind not in ("tokens", "text"):
            raise ValueError(kind)
        self.spelt, self.between = vocabulary.spelt(kind), b" " if kind == "tokens" else b""
        self.started = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        data = self.between.join(map(self.spelt.__getitem__, ids))
        if data and self.started:
            data = self.between + data
        self.started |= bool(data)
        return self.utf8.decode(data, last)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    return Vocabulary(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def code(docs: DataFrame, path: str, *, text: str = "text", decode: str | None = "tokens") -> DataFrame:
    """Adds ids (array of int) and, unless decode is None, decoded (string; see Decoder) to every row.

    Null text counts as empty and has no ids and empty decoded text. Texts of
    any length are read in slices, a word without an end in pieces; beside the
    row itself and what it gives, memory is bounded. Repeated rows, ties and empty tables need no
    care: each row stands for itself. Input columns named as an added one are
    replaced; other columns are kept. The file must be readable at `path` on
    every executor.
    """
    added = ["ids"] + ["decoded"] * bool(decode)
    docs = without(docs, *added)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * bool(decode))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            rows = whole.column(whole.schema.get_field_index(text))
            start, size, ids, ends, texts = 0, 0, [], [0], []
            for n in range(whole.num_rows):
                one, n_ids = rows[n].as_py() or "", 0
                dec = Decoder(enc.v, decode) if decode else None
                pieces = []
                for some in enc.encode_pieces(one):
                    ids.append(np.fromiter(some, np.int32, len(some)))
                    n_ids += len(some)
                    if dec:
                        pieces.append(dec.feed(some))
                if dec:
                    texts.append("".join([*pieces, dec.feed([], last=True)]))
                ends.append(ends[-1] + n_ids)
                size += len(one)
                if size >= TOGETHER or n + 1 - start == ROWS or n + 1 == whole.num_rows:
                    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                    columns = [*whole.slice(start, n + 1 - start).columns, found] + [pa.array(texts, pa.string())] * bool(decode)
                    yield pa.RecordBatch.from_arrays(columns, [*whole.schema.names, *added])
                    start, size, ids, ends, texts = n + 1, 0, [], [0], []

    return docs.mapInArrow(run, schema)
