"""Scores of a language model whose n-gram counts are in a log-frequency Bloom filter.

Tokens are words and one end for each text. How often every n-gram occurs in
the training texts is counted over all of them, quantised to its number of
digits to the base 4, and kept as that many entries of a Bloom filter:
(n-gram, 1), (n-gram, 2) and so on. A reader asks for (n-gram, 1), (n-gram, 2)
... until one is missing: the last that was there is the count's length. A count is never
read as less than it is, and rarely as more; nor does an n-gram count more than
its parts, which takes most of the filter's false entries away. Probabilities
are smoothed from the shortest n-grams on: each length adds its counts to WEIGHT
expected ones of the length before.

The filter is cut into shards by the n-gram's hash, each as large as its own
entries ask for, and each made in one task from its n-grams alone. Their number
follows the training tokens. While all of them are no more than HELD bytes they
are broadcast, and read where the texts are. Beyond, nothing of them is: the
texts are dealt into blocks, a block asks each shard once for each n-gram that
it has, and the answers are shuffled back. Both ways read the same.

The exact counts of tokens don't go through the filter. The HEAD most frequent
are broadcast; what a text has besides is joined to the whole vocabulary.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WORDS_BY_SPACE, durable, words
from tracewright.llm.importance import first_rows

#: Bytes of a filter that is broadcast at most, tokens of the vocabulary that are, and bytes of a token as it is kept: a longer one is kept as its digest.
HELD, HEAD, LONG = 256 << 20, 100_000, 64
#: Training tokens of a shard, about, and shards at least; bits and probes of an entry.
SHARE, SHARDS, BITS, PROBES = 1 << 21, 64, 8, 6
#: Expected counts that a length gets from the one before; what is added to a token's count.
WEIGHT, ADDED = 4.0, 0.1
#: n-grams that a task gathers before it hands their counts on, tokens that are scored at once, hashes of tokens that it remembers, and tokens of a block.
GATHER, AT_ONCE, KNOWN, BLOCK = 1 << 22, 1 << 18, 1 << 19, 1 << 20
END = b""
ROW = "key long, n_tokens long, head_known long, head_base double, score double, rest array<struct<token: binary, n: int>>"


def kept(token: bytes) -> bytes:
    """A token as it is counted: a long one by its digest behind a blank, which no word has."""
    return token if len(token) <= LONG else b" " + hashlib.sha256(token).digest()


class Hashes(dict):
    """A token's 64 bits, remembered for the first KNOWN."""

    def __missing__(self, token: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(token)
        if len(self) < KNOWN:
            self[token] = h
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def longer(grams: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that go on by a token."""
    return mix(grams * np.uint64(0x9E3779B97F4A7C15) + tokens)


def runs(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of all n-grams of tokens, for every n up to order: that at i of the n-th array ends at token i + n - 1."""
    out = [tokens]
    for n in range(2, order + 1):
        out.append(longer(out[-1][: max(0, len(tokens) - n + 1)], tokens[n - 1 :]))
    return out


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text, a bounded number at once; the last is its end."""
    last: list[bytes] | None = None
    for own in words(text, WORDS_BY_SPACE):
        if last is not None:
            yield last
        last = own
    yield [*(last or []), END]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By the first half of the bits; the second tells n-grams of a shard apart."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def places(h: np.ndarray, level: int, size: np.ndarray | int, probes: int) -> Iterator[np.ndarray]:
    """The bits of (n-gram, level) in a shard of so many."""
    x = mix((h & np.uint64(0xFFFFFFFF)) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = (x >> np.uint64(32)) | np.uint64(1)
    for i in range(probes):
        yield (x + np.uint64(i) * step) % np.asarray(size, np.uint64)


def levels_of(n: np.ndarray) -> np.ndarray:
    """The number of digits of counts to the base 4."""
    return (np.frexp(n.astype(np.float64))[1] + 1) // 2


def shard_bits(h: np.ndarray, n: np.ndarray, bits: int = BITS, probes: int = PROBES) -> np.ndarray:
    """The bytes of a shard that holds these n-grams with their counts."""
    levels = levels_of(n)
    flags = np.zeros(max(64, -(-int(levels.sum()) * bits // 64) * 64), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in places(h[levels >= level], level, len(flags), probes):
            flags[at.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


class Filter:
    """Shards laid one behind the other."""

    def __init__(self, shards: dict[int, bytes], count: int, probes: int = PROBES):
        self.probes = probes
        empty = bytes(8)  # 64 bits that hold nothing
        own = [shards.get(i, empty) for i in range(count)]
        self.bits = np.frombuffer(b"".join(own), np.uint8)
        self.sizes = np.array([8 * len(b) for b in own], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The length of each n-gram's count; 0 for one that was never seen."""
        out = np.zeros(len(h), np.int64)
        shard = shard_of(h, len(self.sizes)).astype(np.int64)
        size, start, open_ = self.sizes[shard], self.starts[shard], np.arange(len(h))
        for level in range(1, 65):
            hit = np.arange(len(open_))
            for at in places(h[open_], level, size[open_], self.probes):
                at = at[hit] + start[open_][hit]
                hit = hit[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if not len(hit):
                    break
            open_ = open_[hit]
            if not len(open_):
                break
            out[open_] = level
        return out


#: What a count of so many digits is taken for.
VALUES = np.concatenate([[0.0], 1.5 * 4.0 ** np.arange(64)])


class Scorer:
    """Scores texts; lookup gives the lengths of n-grams' counts by their hashes."""

    def __init__(self, order: int, total: int, distinct: int, head: dict[bytes, int], counts: np.ndarray, lookup: Callable[[np.ndarray], np.ndarray]):
        self.order, self.lookup, self.head = order, lookup, head
        self.all = total + ADDED * (distinct + 1)
        self.base = np.log10((counts + ADDED) / self.all)
        self.hashes = Hashes()

    def looked(self, h: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(h, return_inverse=True)
        return VALUES[self.lookup(distinct)][back]

    def rows(self, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        rest: list[Counter] = [Counter() for _ in range(n)]
        waiting: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            context = self.hashes.of([END])
            for own in pieces(text.as_py()):
                tokens[i] += len(own)
                at = np.fromiter((self.head.get(w, -1) for w in own), np.int64, len(own))
                inside = at[at >= 0]
                known[i] += len(inside)
                base[i] += self.base[inside].sum()
                rest[i].update(kept(own[j]) for j in np.flatnonzero(at < 0).tolist())
                full = np.concatenate([context, self.hashes.of(own)])
                waiting.append((i, len(context), full))
                context = full[max(0, len(full) - max(1, self.order - 1)) :]
                held += len(own)
                if held >= AT_ONCE:
                    self.settle(waiting, score)
                    waiting, held = [], 0
        self.settle(waiting, score)
        flat = [(t, c) for r in rest for t, c in r.items()]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.binary()), pa.array([c for _, c in flat], pa.int32())], ["token", "n"])
        return pa.RecordBatch.from_arrays([keys, pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), values)], ["key", "n_tokens", "head_known", "head_base", "score", "rest"])

    def settle(self, waiting: list[tuple[int, int, np.ndarray]], score: np.ndarray) -> None:
        """Adds to each text's score what its waiting tokens, behind a context, are worth."""
        if not waiting:
            return
        grams = [runs(full, self.order) for _, _, full in waiting]
        found = [np.split(self.looked(np.concatenate([g[n] for g in grams])), np.cumsum([len(g[n]) for g in grams])[:-1]) for n in range(self.order)]
        for k, (i, context, full) in enumerate(waiting):
            own = len(full) - context
            p = (found[0][k][context:] + ADDED) / self.all
            for n in range(2, self.order + 1):
                # The tokens with n - 1 others before them; the first that are a text's have fewer.
                m = min(own, len(full) - n + 1)
                if m > 0:
                    whole, before, end = (found[n - 1][k][-m:], found[n - 2][k][-m - 1 : -1], found[n - 2][k][-m:])
                    p[-m:] = (np.minimum(np.minimum(whole, before), end) + WEIGHT * p[-m:]) / (before + WEIGHT)
            score[i] += np.log10(p).sum()


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(token, n): how often each token is in texts (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(map(kept, seen)), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        seen, held = Counter(), 0
        for b in batches:
            for text in b.column(0):
                for own in pieces(text.as_py()):
                    seen.update(own)
                    held += len(own)
                    if held >= GATHER:
                        yield out(seen)
                        seen, held = Counter(), 0
        yield out(seen)

    return texts.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def head_of(known: DataFrame) -> list:
    """The HEAD most frequent short tokens, found as importance.first_rows finds rows: no task sends its own HEAD."""
    short = known.where(F.octet_length("token") <= LONG).withColumn("row", F.monotonically_increasing_id())
    if short.count() > HEAD:
        short = short.where(first_rows(short, HEAD, [-F.col("n"), F.xxhash64("token"), F.col("row")]))
    return short.select("token", "n").collect()


def filtered(texts: DataFrame, order: int, shards: int, bits: int, probes: int) -> DataFrame:
    """(shard, bits): the filter of all n-grams of texts (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            """A row for each shard: its n-grams' second halves, and their counts, 4 bytes each."""
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            own, starts = np.unique(shard_of(h, shards), return_index=True)  # in order, as h is
            halves, n = (h & np.uint64(0xFFFFFFFF)).astype("<u4"), n.astype("<u4")
            cut = lambda x: pa.array([p.tobytes() for p in np.split(x, starts[1:])] if len(own) else [], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), cut(halves), cut(n)], ["shard", "h", "n"])

        hashes, found, held = Hashes(), [], 0
        for b in batches:
            for text in b.column(0):
                context = hashes.of([END])
                for own in pieces(text.as_py()):
                    full = np.concatenate([context, hashes.of(own)])
                    for n, grams in enumerate(runs(full, order), 1):
                        found.append(grams[max(0, len(context) - n + 1) :])  # those that end in own
                        held += len(found[-1])
                    context = full[max(0, len(full) - max(1, order - 1)) :]
                    if held >= GATHER:
                        yield out(found)
                        found, held = [], 0
        yield out(found)

    def build(group: pa.Table) -> pa.Table:
        h, n = (np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in group.column(c)]) for c in ("h", "n"))
        h, back = np.unique(h, return_inverse=True)
        own = shard_bits(h.astype(np.uint64), np.bincount(back, n), bits, probes)
        return pa.table({"shard": group.column("shard")[:1], "bits": pa.array([own.tobytes()], pa.binary())})

    # Tasks have counted by themselves: what is a shard's goes to one task, which adds it up and builds the bits.
    return texts.mapInArrow(count, "shard int, h binary, n binary").groupBy("shard").applyInArrow(build, "shard int, bits binary")


def by_blocks(rows: DataFrame, filters: DataFrame, shards: int, probes: int, blocks: int, order: int, scorer: Callable[[Callable], Scorer]) -> DataFrame:
    """What Scorer.rows gives for rows (key, text), with filters that stay where they are: blocks of texts ask, shards answer."""
    dealt = durable(rows.withColumn("block", F.monotonically_increasing_id())).withColumn("block", F.pmod(F.xxhash64("block"), F.lit(blocks)))
    parts = 1 + blocks // (1 << 16)  # for what all blocks ask for

    def ask(group: pa.Table) -> pa.Table:
        hashes, found = Hashes(), []
        for text in group.column("text"):
            context = hashes.of([END])
            for own in pieces(text.as_py()):
                full = np.concatenate([context, hashes.of(own)])
                found += [np.unique(x) for x in runs(full, order)]
                context = full[max(0, len(full) - max(1, order - 1)) :]
        h = np.unique(np.concatenate(found))
        block = group.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(h), block)), "shard": shard_of(h, shards).astype(np.int32), "part": pa.array(np.full(len(h), block % parts), pa.int32()), "h": h.view(np.int64)})

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        h = asked.column("h").to_numpy().view(np.uint64)
        own = {shard.column("shard")[0].as_py(): shard.column("bits")[0].as_py()} if shard.num_rows else {}
        levels = Filter(own, shards, probes).levels(h) if len(h) else np.zeros(0, np.int64)
        return pa.table({"block": asked.column("block"), "h": asked.column("h"), "level": pa.array(levels.astype(np.int32))})

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        h, level = found.column("h").to_numpy().view(np.uint64), found.column("level").to_numpy()
        order_ = np.argsort(h)
        h, level = h[order_], level[order_]
        lookup = lambda asked: level[np.searchsorted(h, asked)]
        return pa.Table.from_batches([scorer(lookup).rows(b.column("key"), b.column("text")) for b in texts.select(["key", "text"]).combine_chunks().to_batches()])

    asks = dealt.groupBy("block").applyInArrow(ask, "block long, shard int, part int, h long")
    copies = filters.select("shard", "bits", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    answers = asks.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(answer, "block long, h long, level int")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, ROW)


def score(docs: DataFrame, *, order: int = 2, bits: int = BITS, probes: int = PROBES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Texts whose key isn't held out are learned from; a null key isn't. A null
    text is an empty one: its only token is the end. base_score adds the
    logarithms of smoothed exact counts of tokens, score is the log10
    probability by n-grams of up to `order` tokens. Repeated rows count, and are
    scored, each for itself; an empty table gives an empty one. Without any
    training text all tokens are new. Keys are whole numbers; other columns are
    not returned.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    learned = rows.where(~held_out(F.col("key"))).select("text")
    known = durable(vocabulary(learned))
    total, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    most = head_of(known)
    head, counts = {bytes(r["token"]): i for i, r in enumerate(most)}, np.array([r["n"] for r in most], np.float64)
    shards = max(SHARDS, -(-total * order // SHARE))
    filters = durable(filtered(learned, order, shards, bits, probes))
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((head, counts))
    scorer = lambda lookup: Scorer(order, total, distinct, *sent.value, lookup)
    size = filters.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    if size <= HELD:
        table = sc.broadcast(Filter({r["shard"]: bytes(r["bits"]) for r in filters.collect()}, shards, probes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = scorer(table.value.levels)
            for b in batches:
                yield of.rows(b.column(0), b.column(1))

        scored = rows.mapInArrow(run, ROW)
    else:
        scored = by_blocks(rows, filters, shards, probes, max(1, total // BLOCK), order, scorer)
    # Narrow rows; their numbers are those of the written ones.
    scored = durable(scored).withColumn("row", F.monotonically_increasing_id())
    asked = scored.select("row", F.explode("rest").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    met = asked.join(known, "token", "left")
    worth = F.log10((F.coalesce("n", F.lit(0)) + F.lit(ADDED)) / F.lit(total + ADDED * (distinct + 1))) * F.col("times")
    # As decimals they add up to the same in any order.
    sums = met.groupBy("row").agg(F.sum(worth.cast("decimal(28,12)")).cast("double").alias("rest_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    joined = scored.drop("rest").join(sums, "row", "left")
    none = F.lit(0)
    return joined.select(
        F.col("key").alias(key),
        held_out(F.col("key")).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", none)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rest_base", none.cast("double"))).alias("base_score"),
        "score",
    )
