"""Vector bin packing of tokenised documents into fixed-length sequences.

Each input partition is packed on its own, as a stream: no shuffle, memory bounded by one Arrow batch plus the pool of
open items, and a lost task is simply run again. Only the last few sequences of a partition can be short; they are
cut at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import release

#: Texts with these take the tokenizer's plain way: control characters that only Python takes for white space, starts
#: of special tokens, and a letter whose lower case depends on its place.
_PLAIN = ("<|", "\u03a3", "\x1c", "\x1d", "\x1e", "\x1f")
#: Scripts whose letters the two libraries may class differently.
_OTHER_SCRIPTS = re.compile("[\u0530-\U0010ffff]")
#: What the fast way relies on, besides a splitting pattern that never crosses white space.
_NORMALIZERS, _PRE_TOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

#: Characters of the longest words and chunks that are kept from task to task.
_LONGEST = 64


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memory(dict):
    """Numbers parts in the order of their first use, and notes the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


class _Words(dict):
    """Ids of words between marks (as bytes of 32-bit integers), from the vocabulary's merges; of a line end -1."""

    def __init__(self, model, before: dict[str, bytes] | None = None):
        self.model, self.letters, self.before = model, _byte_letters(), before or {}
        self["\n"] = array("i", [-1]).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(word) <= _LONGEST:
            self[word] = found
        return found

    def aged(self) -> _Words:
        """An empty memory that looks words up in this one first, so those that are not met until it is aged too are dropped."""
        self.before = {}
        return _Words(self.model, self)


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    """Words and line ends of a text without letters of _OTHER_SCRIPTS, as `pattern` cuts them.

    Where its classes stand in brackets only they are written out, for the faster of the two libraries.
    """
    classes = set(regex.findall(r"\\(?:p\{\w+\}|.)", pattern))
    if "\\" in re.sub(r"\[[^\]]*\]", "", pattern) or not classes <= {r"\p{L}", r"\p{N}", r"\s"}:
        return regex.compile(pattern + r"|\n").findall
    for c in classes:
        pattern = pattern.replace(c, re.escape("".join(x for x in map(chr, range(0x530)) if regex.match(c, x))))
    return re.compile(pattern + r"|\n").findall


class ChunkTokenizer:
    """Ids of whole texts, through a bounded memory of lower-case chunks between white space.

    The tokenizer normalises, lower-cases and never joins characters across white space, so a text's ids are its
    chunks' ids in a row. Chunks not met before are cut into words together and go straight to the vocabulary's merges.
    Texts and chunks for which this could differ from the tokenizer, and tokenizers of another build, take its plain way.
    """

    def __init__(self, path: str | None = None, memory: int = 250_000, words: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.memory, self.most_words = memory, words
        built = json.loads(self.tokenizer.to_str())
        norm = [x["type"] for x in (built.get("normalizer") or {}).get("normalizers", [])]
        pre = (built.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fast = norm == _NORMALIZERS and [x["type"] for x in pre] == _PRE_TOKENIZERS and built["model"]["type"] == "BPE"
        if self.fast:
            self.split = _splitter(pre[0]["pattern"]["Regex"])
        self.forget()

    def forget(self) -> None:
        """Empties the memory."""
        self.words = _Words(self.tokenizer.model)
        self._empty()

    def _empty(self) -> None:
        self.known = _Memory()
        self.pool, self.used = np.zeros(1 << 20, dtype="<u4"), 0
        self.starts, self.lengths, self.uses = (np.zeros(1 << 18, dtype=np.int64) for _ in range(3))

    def trim(self) -> None:
        """Keeps the chunks that were used most since the last time, at most half of the memory and none long, and the words met lately."""
        if len(self.words) > self.most_words:
            self.words = self.words.aged()
        names, n = list(self.known), len(self.known)
        kept = np.array([k for k in np.flatnonzero(self.uses[:n] > 1).tolist() if len(names[k]) <= _LONGEST], dtype=np.int64)
        if len(kept) > self.memory // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.memory // 2]])
        lengths, starts = self.lengths[kept], self.starts[kept]
        ends = np.cumsum(lengths)
        pool = self.pool[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        self._empty()
        self.known.update(zip((names[k] for k in kept), range(len(kept)), strict=True))
        self._room(len(kept), len(pool))
        self.lengths[: len(kept)], self.starts[: len(kept)] = lengths, ends - lengths
        self.pool[: len(pool)], self.used = pool, len(pool)

    def _room(self, chunks: int, ids: int) -> None:
        while len(self.starts) < chunks:
            self.starts, self.lengths, self.uses = (np.append(x, np.zeros_like(x)) for x in (self.starts, self.lengths, self.uses))
        while len(self.pool) < ids:
            self.pool = np.append(self.pool, np.zeros_like(self.pool))

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self) -> None:
        new, first = self.known.new, len(self.known) - len(self.known.new)
        self.known.new = []
        lines = "\n".join(new)
        odd = {k: self._plain(c) for k, c in enumerate(new) if _OTHER_SCRIPTS.search(c)} if _OTHER_SCRIPTS.search(lines) else {}
        if odd:
            lines = "\n".join("" if k in odd else c for k, c in enumerate(new))
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, self.split(lines + "\n"))), dtype=np.int32)
        ends = np.flatnonzero(ids < 0)
        lengths = np.diff(ends, prepend=-1) - 1
        ids = np.concatenate([ids[ids >= 0], *odd.values()]).astype("<u4")
        self._room(first + len(new), self.used + len(ids))
        self.lengths[first : first + len(new)] = lengths
        self.starts[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
        behind = self.used + int(lengths.sum())
        for k, own in odd.items():
            self.starts[first + k], self.lengths[first + k] = behind, len(own)
            behind += len(own)
        self.pool[self.used : behind], self.used = ids, behind

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids per text; null: empty. Some thousand texts at once are faster than few."""
        if len(self.known) > self.memory:
            self.trim()
        lows, plain = [], {}
        for k, t in enumerate(texts):
            low = unicodedata.normalize("NFC", t).lower() if t else ""
            if t and (not self.fast or any(x in t for x in _PLAIN) or not unicodedata.is_normalized("NFC", low)):
                plain[k] = self._plain(t)
                low = ""
            lows.append(low)
        split = pc.utf8_split_whitespace(pa.array(lows, pa.string()))
        found = split.flatten().dictionary_encode()
        names = found.dictionary.to_pylist()
        own = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))
        if self.known.new:
            self._learn()
        place = found.indices.to_numpy()
        self.uses[own] += np.bincount(place, minlength=len(names))
        part = own[place]
        lengths = self.lengths[part]
        ends = np.cumsum(lengths)
        gathered = self.pool[np.repeat(self.starts[part] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [plain[k] if k in plain else gathered[bounds[k] : bounds[k + 1]] for k in range(len(texts))]


def parts(batch: pa.RecordBatch, rows: int = 2048, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows whose texts (strings in any column) have about so many bytes, one row at least."""
    bytes_ = sum((np.diff(np.frombuffer(c.buffers()[1], dtype="<i4" if c.type == pa.string() else "<i8")[c.offset : c.offset + len(c) + 1]) for c in batch.columns if c.type in (pa.string(), pa.large_string()) and len(c)), start=np.zeros(batch.num_rows, dtype=np.int64))
    at, reached = 0, np.cumsum(bytes_)
    while at < batch.num_rows:
        end = int(np.searchsorted(reached, (reached[at - 1] if at else 0) + size, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


@functools.lru_cache(maxsize=1)
def tokenizer_of(path: str | None) -> ChunkTokenizer:
    """One tokenizer per Python worker, kept from task to task."""
    return ChunkTokenizer(path)


@dataclass
class Item:
    """Ids [start, start + length) of a document; the first `prompt` ids of a document bear no loss."""

    doc: object
    ids: np.ndarray
    start: int
    length: int
    prompt: int = 0

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.prompt))

    def head(self, n: int) -> tuple[Item, Item]:
        return Item(self.doc, self.ids, self.start, n, self.prompt), Item(self.doc, self.ids, self.start + n, self.length - n, self.prompt)

    def longest(self, tokens: int, loss: int) -> int:
        """How many leading tokens fit into so many tokens and loss-bearing tokens."""
        free = max(0, self.prompt - self.start)
        return min(tokens, self.length, free + loss)


class VectorPacker:
    """Fills sequences one after the other from a pool of items, under limits on tokens, segments and loss tokens.

    Of the items that fit, the one whose size vector has the largest dot product with what is left of the limits goes
    in; if none fits, the longest is cut to fill the rest. Sequences end up full unless segments or loss run out.
    """

    def __init__(self, tokens: int = 2048, segments: int = 2048, loss: int | None = None, pool: int = 128):
        self.limits = np.array([tokens, segments, loss or tokens], dtype=np.int64)
        self.pool_size, self.pool, self.total = pool, [], 0
        self.room = np.zeros((2 * pool, 3), dtype=np.int64)

    @property
    def sizes(self) -> np.ndarray:
        """Tokens, segments and loss tokens of the items in the pool."""
        return self.room[: len(self.pool)]

    def add(self, item: Item) -> Iterator[list[Item]]:
        """Takes an item; yields the sequences that close."""
        tokens, _, loss = map(int, self.limits)
        while item.length >= tokens and (n := item.longest(tokens, loss)) == tokens:
            own, item = item.head(n)
            yield [own]
        if item.length:
            self._put(item)
        while len(self.pool) >= self.pool_size and self.total >= tokens:
            yield self._fill(self.limits)

    def flush(self) -> Iterator[list[Item]]:
        """Yields what is left: full sequences, then ones whose lengths are powers of two."""
        while self.total >= self.limits[0]:
            yield self._fill(self.limits)
        while self.total:
            limits = self.limits.copy()
            limits[0] = 1 << (int(self.total).bit_length() - 1)
            yield self._fill(limits)

    def _put(self, item: Item) -> None:
        if len(self.pool) == len(self.room):
            self.room = np.append(self.room, np.zeros_like(self.room), axis=0)
        self.room[len(self.pool)] = item.length, 1, item.loss
        self.pool.append(item)
        self.total += item.length

    def _take(self, k: int) -> Item:
        self.room[k : len(self.pool) - 1] = self.room[k + 1 : len(self.pool)]
        item = self.pool.pop(k)
        self.total -= item.length
        return item

    def _fill(self, limits: np.ndarray) -> list[Item]:
        left, out = limits.astype(np.int64).copy(), []
        while self.pool and left[0] > 0 and left[1] > 0:
            fits = (self.sizes <= left).all(axis=1)
            if fits.any():
                score = (self.sizes / self.limits) @ (left / self.limits)
                own = self._take(int(np.argmax(np.where(fits, score, -1.0))))
            else:
                k = int(np.argmax(self.sizes[:, 0]))
                n = self.pool[k].longest(int(left[0]), int(left[2]))
                if n <= 0:
                    break
                own, rest = self._take(k).head(n)
                if rest.length:
                    self._put(rest)
            out.append(own)
            left -= np.array([own.length, 1, own.loss])
        if not out:  # an item that no limits can take: never, as every limit is at least 1
            raise ValueError("packing limits must be positive")
        return out


_NONE = np.zeros(0, dtype="<u4")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None, tokenizer_path: str | None = None, end_id: int = 1, tokens: int = 2048, segments: int | None = None, loss: int | None = None, pool: int = 128) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's ids and `end_id`; null text: `end_id` alone. Repeated rows are packed once each;
    a null doc_id stays null. `prompt` names a column with a text whose ids come first and bear no loss (null: none);
    all others do. A sequence has at most so many tokens, segments and loss-bearing tokens; without a limit for the
    last two, only the tokens bind. Other columns are ignored. Empty table: no rows. sequence_id is the partition's number times 2**32 plus a
    running number, so it is unique without a shuffle.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(prompt).cast("string").alias("prompt")] if prompt else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = tokenizer_of(tokenizer_path), VectorPacker(tokens, segments or tokens, loss, pool)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def note(sequences: Iterator[list[Item]]) -> None:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for x in sequence:
                    own = x.ids[x.start : x.start + x.length]
                    rows.append((x.doc, x.start, x.length, zlib.crc32(own.tobytes()), len(x.ids), number, offset))
                    offset += x.length
                number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            for part in map(pa.RecordBatch.to_pydict, parts(batch)):
                heads = tokenizer.encode(part["prompt"]) if prompt else [_NONE] * len(part["doc_id"])
                for doc, ids, head in zip(part["doc_id"], tokenizer.encode(part["text"]), heads, strict=True):
                    ids = np.concatenate([head, ids, [end_id]]).astype("<u4")
                    note(packer.add(Item(doc, ids, 0, len(ids), len(head))))
            yield out()
        note(packer.flush())
        tokenizer.trim()  # the worker lives on beside other tasks, and its next task has many of these words
        yield out()
        release()

    return rows.mapInArrow(run, _SCHEMA)
