"""Phrases that recur, by position bitmaps: shift, AND and popcount in shards, popcounts summed over them.

Texts stream into shards of a bounded number of positions: one per word, and an empty one where a piece ends, so that
no phrase crosses it. A shard is one row of a written table: its words, and for each a compressed bitmap of its
positions, which keeps only blocks of 16 positions with a bit. A shard ends with a few positions of what follows; they
can end a phrase and never start one, so no phrase is lost or counted twice where a long text is cut.

A bitmap that is shifted back by a phrase's length and ANDed with the phrase's bitmap leaves the places where the
phrase goes on. Runs of first words are extended depth-first to the longest phrase before the next run is begun.
What is pruned is pruned by sums over all shards: words below the limit leave every shard, pairs are then counted, and
longer phrases grow only through pairs that reach the limit. Nothing is pruned by what one shard knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop_written, materialize, release, small_batches

#: Lower case for A-Z only; what ends a piece becomes a byte that UTF-8 never holds; tabs become spaces.
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")
_GAP = b"\xff"
#: Positions in a block of a stored bitmap, in one that is worked on (fewer words share it), and in a shard: stored block numbers fit two bytes.
_STORED, _BLOCK, SHARD = 16, 8, 1 << 20
#: Bits for a word's place in a shard, and for a shard's number in its task.
_PLACE = 20
#: Bytes of a text that are split into words at once, and pairs of blocks that are ANDed at once.
_SLICE, _ANDS = 1 << 20, 1 << 21
#: First words are extended together up to so many blocks.
_RUN = 1 << 17
#: Parts of a language's candidates that are ranked apart before the last ranking.
RANK_SLICES = 64
_SHARDS = "shard long, own int, langs array<string>, words array<string>, counts array<long>, ends array<int>, blocks binary, masks binary"


class _Numbers(dict):
    """Words of one language in a shard, numbered in the order of their first use from a counter of the shard's."""

    def __init__(self, shard: list, lang: str):
        self.shard, self.lang = shard, lang
        self[_GAP] = -1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.shard)
        self.shard.append((self.lang, word))
        return n


def _tokens(text: bytes, least: int = 64) -> Iterator[list[bytes]]:
    """Words and gaps of a text, in slices of at least so many; a gap ends the last one."""
    text, at, held = text.translate(_LETTERS), 0, []
    while at < len(text):
        end = text.find(b" ", at + _SLICE) if len(text) - at > _SLICE else -1
        end = len(text) if end < 0 else end
        held += text[at:end].replace(_GAP, b" \xff ").split()
        at = end
        if len(held) >= least:
            yield held
            held = []
    yield [*held, _GAP]


class _Writer:
    """Collects positions and turns them into rows of _SHARDS."""

    def __init__(self, number: int, positions: int, ahead: int):
        self.number, self.positions, self.ahead = number, positions, ahead
        self.clear()

    def clear(self) -> None:
        self.vocabulary, self.known, self.parts, self.have = [], {}, [], 0

    def _note(self, lang: str, tokens: list[bytes]) -> None:
        known = self.known.get(lang) or self.known.setdefault(lang, _Numbers(self.vocabulary, lang))
        self.parts.append(np.fromiter(map(known.__getitem__, tokens), dtype=np.int32, count=len(tokens)))

    def add(self, lang: str, tokens: list[bytes], more: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Takes tokens of a text; more: those that follow, as far as a phrase can reach."""
        at = 0
        while at < len(tokens):
            own = tokens[at : at + self.positions - self.have]
            self._note(lang, own)
            self.have += len(own)
            at += len(own)
            if self.have == self.positions:
                self._note(lang, (tokens[at : at + self.ahead] + more)[: self.ahead])
                yield self.row()

    def row(self) -> pa.RecordBatch:
        ids, n = np.concatenate(self.parts), len(self.vocabulary)
        places = np.flatnonzero(ids >= 0)
        places = places[np.argsort(ids[places], kind="stable")]
        word, block = ids[places].astype(np.int64), places // _STORED
        starts = np.flatnonzero(np.diff(word * (1 << 32) + block, prepend=-1))
        bits = (1 << (places % _STORED)).astype(np.int64)
        masks = np.add.reduceat(bits, starts) if len(starts) else bits
        own = ids[: self.have]
        columns = {
            "shard": pa.array([self.number], pa.int64()),
            "own": pa.array([self.have], pa.int32()),
            "langs": pa.array([[lang for lang, _ in self.vocabulary]], pa.list_(pa.string())),
            "words": pa.array([[w for _, w in self.vocabulary]], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            "counts": pa.array([np.bincount(own[own >= 0], minlength=n)], pa.list_(pa.int64())),
            "ends": pa.array([np.searchsorted(word[starts], np.arange(n), side="right")], pa.list_(pa.int32())),
            "blocks": pa.array([block[starts].astype("<u2").tobytes()], pa.binary()),
            "masks": pa.array([masks.astype("<u2").tobytes()], pa.binary()),
        }
        self.number += 1
        self.clear()
        return pa.RecordBatch.from_pydict(columns)


def shards(docs: DataFrame, *, text: str, lang: str, longest: int, positions: int) -> DataFrame:
    """The written bitmaps of all texts; see the module's text."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(TaskContext.get().partitionId() << _PLACE, positions, longest - 1)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                before: list[bytes] = []
                for tokens in _tokens(body):  # one slice behind, so that the words after it are known
                    if before:
                        yield from writer.add(name, before, tokens[: longest - 1])
                    before = tokens
                yield from writer.add(name, before, [])
        if writer.have:
            yield writer.row()
        writer.clear()
        release()

    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(run, _SHARDS), "shards")


class Bitmaps:
    """A shard's bitmaps of the words that are left, in blocks of 8 positions, and their extensions."""

    def __init__(self, own: int, ends: np.ndarray, blocks: np.ndarray, masks: np.ndarray, slots: np.ndarray, names: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None):
        """first, last: the only numbers of words that may begin a phrase, and that may go on with one."""
        lengths = np.diff(ends, prepend=0)
        dense = np.full(len(ends), -1, dtype=np.int32)
        dense[slots] = np.arange(len(slots), dtype=np.int32)
        word = np.repeat(dense, lengths)
        held = word >= 0
        order = np.argsort(word[held], kind="stable")
        word, block, mask = word[held][order], blocks[held][order].astype(np.int32), masks[held][order]
        mask = np.column_stack([mask & 0xFF, mask >> _BLOCK]).ravel().astype(np.uint8)
        word, block = np.repeat(word, 2), np.column_stack([2 * block, 2 * block + 1]).ravel()
        held = mask > 0
        self.names, self.n = names, len(names)
        self.word, self.block, self.mask = word[held], block[held], mask[held]
        inside = np.where(self.block == own // _BLOCK, (1 << own % _BLOCK) - 1, np.where(self.block < own // _BLOCK, 0xFF, 0)).astype(np.uint8)
        self.starts = self.mask & inside  # a phrase starts at one of the shard's own positions
        self.size = (own + _STORED) // _BLOCK + 1
        self.first, self.last = (np.isin(np.arange(self.n), x) if x is not None else None for x in (first, last))
        self.shifted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def back(self, by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bitmaps that may go on with a phrase shifted back by so many positions, by block: where a block's entries begin, their words and masks."""
        if by not in self.shifted:
            word, block, mask = self.word, self.block, self.mask
            if self.last is not None:
                held = self.last[word]
                word, block, mask = word[held], block[held], mask[held]
            whole, rest = divmod(by, _BLOCK)
            word, block, mask = np.concatenate([word, word]), np.concatenate([block - whole, block - whole - 1]), np.concatenate([mask >> rest, mask << (_BLOCK - rest)])
            held = np.flatnonzero((mask > 0) & (block >= 0))
            held = held[np.argsort(block[held], kind="stable")]
            self.shifted[by] = np.searchsorted(block[held], np.arange(self.size + 1)).astype(np.int32), word[held], mask[held]
        return self.shifted[by]

    def step(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every phrase's bitmap ANDed with every word's, shifted: what isn't empty, as phrase, word, block and mask."""
        begin, word, other = self.back(by)
        first, counts = begin[block], begin[block + 1] - begin[block]
        reached, out = np.cumsum(counts, dtype=np.int64), []
        cuts = np.searchsorted(reached, np.arange(_ANDS, reached[-1] + _ANDS, _ANDS)) + 1 if len(counts) else []
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            n = counts[a:b]
            entry = np.repeat(np.arange(a, min(b, len(counts)), dtype=np.int32), n)
            place = np.repeat(first[a:b] - np.cumsum(n, dtype=np.int32) + n, n) + np.arange(len(entry), dtype=np.int32)
            both = mask[entry] & other[place]
            held = np.flatnonzero(both)
            out.append((phrase[entry[held]], word[place[held]], block[entry[held]], both[held]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (phrase[:0], phrase[:0], block[:0], mask[:0])

    def grow(self, longest: int, allowed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of 2 to `longest` words as rows of word names, and how often each occurs here; allowed: sorted first * n + second of the pairs that may stand in them."""
        ends = np.searchsorted(self.word, np.arange(self.n), side="right")
        a = 0
        while a < len(self.word):
            b = int(ends[max(self.word[a], np.searchsorted(ends, a + _RUN, side="right") - 1)])  # whole words, one at least
            run = slice(a, b)
            held = np.flatnonzero(self.starts[run] if self.first is None else np.where(self.first[self.word[run]], self.starts[run], 0))
            words, phrase = np.arange(self.word[a], self.word[b - 1] + 1)[:, None], self.word[run][held] - self.word[a]
            block, mask = self.block[run][held], self.starts[run][held]
            a = b
            for by in range(1, longest):
                if by > 1 and self.first is not None:
                    held = np.flatnonzero(self.first[words[phrase, -1]])
                    phrase, block, mask = phrase[held], block[held], mask[held]
                phrase, word, block, mask = self.step(phrase, block, mask, by)
                if allowed is not None:
                    pair = words[phrase, -1].astype(np.int64) * self.n + word
                    at = np.searchsorted(allowed, pair)
                    may = np.flatnonzero(allowed[np.minimum(at, len(allowed) - 1)] == pair) if len(allowed) else at[:0]
                    phrase, word, block, mask = phrase[may], word[may], block[may], mask[may]
                if not len(phrase):
                    break
                key = phrase.astype(np.int64) * self.n + word
                order = np.argsort(key, kind="stable")
                key, phrase, word, block, mask = key[order], phrase[order], word[order], block[order], mask[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                words = np.hstack([words[phrase[first]], word[first][:, None]])
                phrase = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(key)))
                yield self.names[words], np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first)


def _bitmaps(row: dict[str, np.ndarray]) -> tuple[Bitmaps, np.ndarray]:
    """A shard's bitmaps; of the pairs that may stand in phrases, if the row has any, the two words' numbers."""
    order = np.argsort(row["names"])  # names in order, so that a name's number is found by bisection
    names = row["names"][order]
    pairs = np.searchsorted(names, row["pairs"]) if "pairs" in row else None
    limits = () if pairs is None else (pairs[:, 0], pairs[:, 1])
    return Bitmaps(row["own"], row["ends"].astype(np.int64), row["blocks"], row["masks"], row["slots"][order], names, *limits), pairs


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of named shards, their arrays as numpy's; pairs: one row of two names each."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = {c: batch.column(c).slice(k, 1) for c in batch.schema.names}
            row = {c: x[0].as_py() for c, x in one.items() if c in ("shard", "own")}
            row |= {c: np.frombuffer(one[c][0].as_py(), dtype="<u2") for c in ("blocks", "masks")}
            row |= {c: one[c].flatten().to_numpy() for c in ("ends", "slots", "names")}
            if "pairs" in one:
                row["pairs"] = np.column_stack([x.to_numpy() for x in one["pairs"].flatten().flatten()])
            yield row


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        for words, n in _bitmaps(row)[0].grow(2):
            yield pa.RecordBatch.from_pydict({"shard": np.full(len(n), row["shard"], dtype=np.int64), "w1": words[:, 0], "w2": words[:, 1], "n": n})
    release()


def _longer(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        maps, pairs = _bitmaps(row)
        for words, n in maps.grow(longest, np.sort(pairs[:, 0] * maps.n + pairs[:, 1])):
            if words.shape[1] > 2:
                key = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1]), pa.int32()), pa.array(words.ravel(), pa.int64()))
                yield pa.RecordBatch.from_pydict({"key": key, "n": n})
    release()


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, positions: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: words (id, lang, word, f), phrases (key: the ids of 2 to `longest` words, f) with f of at least `least`, and languages (lang, n)."""
    spark = docs.sparkSession
    made = shards(docs, text=text, lang=lang, longest=longest, positions=min(positions, SHARD - longest))
    at = F.shiftleft("shard", _PLACE).bitwiseOR(F.col("slot")).alias("at")
    local = made.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("slot", "x")).select("shard", "slot", at, F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("f"))
    languages = materialize(local.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    same = Window.partitionBy("lang", "word")  # a row for each shard at most; the first one's place names the word
    named = local.withColumn("f", F.sum("f").over(same)).withColumn("id", F.min("at").over(same)).where(F.col("f") >= least)
    own = F.col("at") == F.col("id")
    named = materialize(named.select("shard", "slot", "id", *[F.when(own, F.col(c)).alias(c) for c in ("lang", "word", "f")]), "frequent-words")
    words = named.where("f IS NOT NULL").select("id", "lang", "word", "f")
    grouped = named.groupBy("shard").agg(F.collect_list(F.struct("slot", "id")).alias("x"))
    held = materialize(made.drop("langs", "words", "counts").join(grouped.select("shard", F.col("x.slot").alias("slots"), F.col("x.id").alias("names")), "shard"), "named-shards")
    drop_written(made)
    with small_batches(spark, 4):
        same = Window.partitionBy("w1", "w2")
        pairs = held.mapInArrow(_pairs, "shard long, w1 long, w2 long, n long").withColumn("f", F.sum("n").over(same)).withColumn("first", F.min("shard").over(same))
        pairs = materialize(pairs.where(F.col("f") >= least).select("shard", "w1", "w2", F.when(F.col("shard") == F.col("first"), F.col("f")).alias("f")), "pairs")
        two = pairs.where("f IS NOT NULL").select(F.array("w1", "w2").alias("key"), "f")
        if longest < 3:
            found = two
        else:
            known = pairs.groupBy("shard").agg(F.collect_list(F.struct("w1", "w2")).alias("pairs"))
            longer = held.join(known, "shard").mapInArrow(lambda batches: _longer(batches, longest), "key array<long>, n long")
            found = two.unionByName(longer.groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        found = materialize(found, "phrases")
    drop_written(pairs)
    drop_written(held)
    return words, found, languages


def _whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, inside: int = 80, top: int = 2000, positions: int = SHARD) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to `longest` words that occurs a >= `least` times within pieces is a candidate; overlapping
    occurrences all count. Its score is the least floor(2000000 * a / (l + r)) over its cuts into a first part that
    occurs l times and a rest that occurs r times (equal: the first cut). It is left out if its words stand in a row
    inside a longer candidate with 100 * f >= inside * a. The first `top` of a language come by score, then a (both
    descending), then phrase by its UTF-8 bytes. A null lang is `und`, a null text has no words; repeated rows count
    each; other columns are ignored; no text: no rows. Very long texts are cut into shards without losing a phrase.
    """
    words, found, languages = phrases(docs, text=text, lang=lang, least=least, longest=longest, positions=positions)
    known = found.select("key", "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word")).unionByName(words.select(F.array("id").alias("key"), "f", "lang", "word"))
    length = F.size("key")
    cut = lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), F.slice("key", F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), F.slice("key", k + 1, length - k).alias("part")))
    single = F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(i.alias("k"), F.lit(2).alias("side"), F.slice("key", i, F.lit(1)).alias("part")))
    asked = found.select("key", F.col("f").alias("a"), F.explode(F.concat(F.flatten(F.transform(F.sequence(F.lit(1), length - 1), cut)), single)).alias("x")).select("key", "a", "x.*")
    told = asked.join(known.withColumnRenamed("key", "part"), "part").groupBy("key", "a").agg(F.array_sort(F.collect_list(F.struct("side", "k", "f", "lang", "word"))).alias("x"))
    of = lambda side: F.filter("x", lambda e: e["side"] == side)
    score = lambda le, r: F.call_function("div", _whole(F.lit(2_000_000)) * _whole(F.col("a")), _whole(le["f"]) + _whole(r["f"]))
    cuts = F.zip_with(of(0), of(1), lambda le, r: F.struct(score(le, r).alias("score"), le["k"].alias("k"), le["f"].alias("l"), r["f"].alias("r")))
    told = told.select("key", "a", F.array_min(cuts).alias("cut"), F.array_join(F.transform(of(2), lambda e: e["word"]), " ").alias("phrase"), F.element_at(of(2), 1)["lang"].alias("lang"))
    # what a longer phrase covers, a phrase one word longer covers at least as often: it is a candidate, too
    covered = found.where(length > 2).select("f", F.explode(F.array(F.slice("key", F.lit(1), length - 1), F.slice("key", F.lit(2), length - 1))).alias("key")).groupBy("key").agg(F.max("f").alias("longer"))
    kept = told.join(covered, "key", "left").where(~F.coalesce(_whole(F.lit(100)) * _whole(F.col("longer")) >= _whole(F.lit(inside)) * _whole(F.col("a")), F.lit(False)))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES))
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(languages, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
