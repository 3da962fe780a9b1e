"""Language identification by interpolated Kneser-Ney character models.

One model of four-grams per language, of all its training texts: probabilities are computed as tables and written as
sorted arrays, which whoever looks a gram up maps into memory. A text belongs to the language under whose model it
has the lowest cross-entropy per character; how sure that is, and what no model explains, is calibrated on all
training texts, which the models have counted too.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import drop_written, materialize, shared_dir

ORDER = 4
UNKNOWN = "und"
SHARPNESS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PAD = "   "


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and single spaces of all texts in a row as 16-bit codes, each text behind three spaces; bounds.

    A text without letters has no codes of its own.
    """
    parts = [_NOT_LETTERS.sub(" ", (t or "").lower()).strip() for t in texts]
    raw = np.frombuffer("".join(f"{_PAD}{p} " if p else _PAD for p in parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.array([len(p) + 1 if p else 0 for p in parts], dtype=np.int64)
    return (raw & 0xFFFF).astype(np.uint64), np.concatenate([[0], np.cumsum(lengths + len(_PAD))])


def grams(code: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The grams that end at each code from the third on, 16 bits a letter."""
    n = len(code) - order + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | code[k : k + n]
    return out


def _own(bounds: np.ndarray) -> np.ndarray:
    """Positions of the grams that end inside a text rather than in the spaces before one."""
    lengths = np.diff(bounds) - len(_PAD)
    starts = np.repeat(bounds[:-1], lengths)
    return starts + np.arange(len(starts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@dataclass
class Table:
    """Sorted grams, as signed numbers, with a number each."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, values: np.ndarray) -> Table:
        keys = grams.view(np.int64)
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of grams, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(grams)), np.zeros(len(grams), dtype=bool)
        key = grams.view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.values[at], self.keys[at] == key


@lru_cache(maxsize=512)
def _mapped(path: str, kind: str) -> np.ndarray:
    """A written array, mapped into memory; from a store without local files, by way of a temporary one."""
    system, at = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.asarray(np.memmap(at, dtype=kind, mode="r"))
    with tempfile.NamedTemporaryFile() as local:
        fs.copy_files(at, local.name, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        return np.asarray(np.memmap(local.name, dtype=kind, mode="r"))


@dataclass
class Written:
    """A table in files: least gram, file, first entry and entries of each part, in the order of the grams."""

    parts: list[tuple[int, str, int, int]]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, there = np.zeros(len(grams)), np.zeros(len(grams), dtype=bool)
        part = np.searchsorted(np.array([p[0] for p in self.parts], dtype=np.int64), grams.view(np.int64), "right") - 1
        for k in np.unique(part[part >= 0]):
            _, path, first, n = self.parts[k]
            own = np.flatnonzero(part == k)
            values[own], there[own] = Table(_mapped(f"{path}.keys", "<i8")[first : first + n], _mapped(f"{path}.values", "<f8")[first : first + n]).find(grams[own])
        return values, there


class KneserNey:
    """Interpolated Kneser-Ney over four-gram counts; lower orders count the different letters before a gram."""

    def __init__(self, grams4: np.ndarray, counts: np.ndarray, alphabet: int):
        self.probability: list[Table | Written] = []
        self.backoff: list[Table | Written] = []
        self.alphabet = alphabet
        levels, gram, count = [], grams4, counts.astype(np.float64)
        for order in range(ORDER, 0, -1):
            levels.append((order, gram, count))
            shorter = gram & np.uint64((1 << 16 * (order - 1)) - 1)
            gram, count = np.unique(shorter, return_counts=True)
            count = count.astype(np.float64)
        lower = None
        for order, gram, count in reversed(levels):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            context, inverse = np.unique(gram >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, count), np.bincount(inverse)
            rest = discount * kinds / total
            below = lower(gram & np.uint64((1 << 16 * (order - 1)) - 1)) if lower else np.full(len(gram), 1.0 / (alphabet + 1))
            p = np.maximum(count - discount, 0.0) / total[inverse] + rest[inverse] * below
            self.probability.append(Table.of(gram, p))
            self.backoff.append(Table.of(context, rest))
            lower = lambda g, o=order: self._at(o, g)

    @classmethod
    def written(cls, probability: list[Written], backoff: list[Written], alphabet: int) -> KneserNey:
        out = cls.__new__(cls)
        out.probability, out.backoff, out.alphabet = probability, backoff, alphabet
        return out

    def _at(self, order: int, gram: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(gram), 1.0 / (self.alphabet + 1))
        p, there = self.probability[order - 1].find(gram)
        gone = np.flatnonzero(~there)
        if len(gone):
            rest, known = self.backoff[order - 1].find(gram[gone] >> np.uint64(16))
            p[gone] = np.where(known, rest, 1.0) * self._at(order - 1, gram[gone] & np.uint64((1 << 16 * (order - 1)) - 1))
        return p

    def surprise(self, gram: np.ndarray) -> np.ndarray:
        """Negative natural logarithm of the probability of each gram's last letter."""
        return -np.log(np.maximum(self._at(ORDER, gram), 1e-12))


@dataclass
class Identifier:
    languages: list[str] = field(default_factory=list)
    models: list[KneserNey] = field(default_factory=list)
    sharpness: float = 0.1
    ceiling: float = float("inf")

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of each text under each model, and letters per text."""
        code, bounds = codes(texts)
        own = _own(bounds)
        lengths = np.diff(bounds) - len(_PAD)
        out = np.full((len(texts), len(self.models)), np.inf)
        full = lengths > 0
        if full.any() and self.models:
            gram, inverse = np.unique(grams(code)[own], return_inverse=True)
            starts = (np.cumsum(lengths) - lengths)[full]
            for k, m in enumerate(self.models):
                out[full, k] = np.add.reduceat(m.surprise(gram)[inverse], starts) / lengths[full]
        return out, lengths

    def groups(self, texts: list[str | None], letters: int) -> Iterator[list[str | None]]:
        """The texts in groups of about so many letters, and of four times as many cross-entropies at most."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= letters or len(part) * len(self.models) >= 4 * letters:
                yield part
                part, size = [], 0
        if part:
            yield part

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and cross-entropy of each text; UNKNOWN and 0 without letters or models."""
        h, lengths = self.entropies(texts)
        out = []
        for row, n in zip(h, lengths, strict=True):
            if n and len(row):
                best = int(np.argmin(row))
                out.append((self.languages[best], float(confidence(row[None], np.array([n]), self.sharpness)[0, best]), float(row[best])))
            else:
                out.append((UNKNOWN, 0.0, 0.0))
        return out


def confidence(h: np.ndarray, lengths: np.ndarray, sharpness: float) -> np.ndarray:
    """Posterior of each language; a long text's letters count less than independent ones would."""
    z = -(h - h.min(axis=1, keepdims=True)) * sharpness * np.sqrt(lengths)[:, None]
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def _counted(rows: DataFrame, flush: int = 4_000_000) -> DataFrame:
    """lang, gram, n of rows (text, lang): counts of all texts, added up within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[str]] = {}
        size: dict[str, int] = {}

        def count(lang: str) -> None:
            code, bounds = codes(waiting.pop(lang))
            size.pop(lang)
            held.setdefault(lang, []).append(np.unique(grams(code)[_own(bounds)], return_counts=True))
            if len(held[lang]) > 8:
                held[lang] = [_added(held[lang])]

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    waiting.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    if size[lang] >= flush // 4:
                        count(lang)
        for lang in list(waiting):
            count(lang)
        for lang, parts in held.items():
            gram, n = _added(parts)
            for k in range(0, len(gram), 100_000):
                own = gram[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n[k : k + 100_000], pa.int64())], names=["lang", "gram", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def _probabilities(counts: DataFrame, alphabet: int) -> Iterator[DataFrame]:
    """kind, lang, gram, value: what KneserNey computes, of all languages at once; kind 2 (order - 1), one more for the back-off.

    One written table per order and kind, from the first order on.
    """
    levels = [counts.select("lang", "gram", F.col("n").alias("count"))]
    for order in range(ORDER - 1, 0, -1):
        levels.append(materialize(levels[-1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")).agg(F.count("*").alias("count")), "language-level"))
    lower = None
    for order, level in enumerate(reversed(levels), 1):
        ones, twos = F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)
        discount = level.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(F.lit(0.75)).cast("double").alias("discount"))
        rows = level.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)))
        backoff = rows.groupBy("lang", "context").agg(F.sum("count").cast("double").alias("total"), F.count("*").alias("kinds")).join(discount, "lang")
        backoff = materialize(backoff.select("lang", "context", "total", "discount", (F.col("discount") * F.col("kinds") / F.col("total")).alias("rest")), "language-backoff")
        rows = rows.join(backoff, ["lang", "context"])
        rows = rows.join(lower.select("lang", F.col("gram").alias("shorter"), F.col("value").alias("below")), ["lang", "shorter"]) if lower else rows.withColumn("below", F.lit(1.0 / (alphabet + 1)))
        p = F.greatest(F.col("count") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("below")
        lower = materialize(rows.select(F.lit(2 * order - 2).alias("kind"), "lang", "gram", p.alias("value")), "language-grams")
        yield lower
        yield backoff.select(F.lit(2 * order - 1).alias("kind"), "lang", F.col("context").alias("gram"), F.col("rest").alias("value"))
    for level in levels[1:]:
        drop_written(level)


def _write(rows: DataFrame, folder: str, files: int) -> list:
    """Writes kind, lang, gram, value as arrays in files of bounded size; kind, lang, least gram, file, first entry and entries of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}"  # a repeated task writes other files
        system, at = fs.FileSystem.from_uri(path)
        parts: list[list] = []
        done = 0
        with system.open_output_stream(f"{at}.keys") as keys, system.open_output_stream(f"{at}.values") as values:
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind, lang, gram, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                starts = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | (lang[1:] != lang[:-1])) + 1), len(kind)]
                for a, b in zip(starts, starts[1:]):
                    if not parts or parts[-1][:2] != [int(kind[a]), lang[a]]:
                        parts.append([int(kind[a]), lang[a], int(gram[a]), path, done + a, 0])
                    parts[-1][5] += b - a
                keys.write(gram.astype("<i8").tobytes())
                values.write(value.astype("<f8").tobytes())
                done += len(kind)
        columns = [list(c) for c in zip(*parts)] or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "lang", "least", "path", "first", "n"])

    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at)
    by = ("kind", "lang", "gram")
    return rows.repartitionByRange(files, *by).sortWithinPartitions(*by).mapInArrow(run, "kind int, lang string, least long, path string, first long, n long").collect()


def fit(train: DataFrame, *, ceiling: float = 0.999, file_rows: int = 2_000_000) -> Identifier:
    """Learns from all rows of train (text, lang; null lang: none): every language, and every four-gram of its texts.

    The model's arrays are in files of about file_rows entries in the shared folder, where they stay for as long as
    the model is used; the driver holds the list of their parts. Confidence and the ceiling of cross-entropy (that
    quantile) are calibrated on the same rows, all of them and whole.
    """
    spark = train.sparkSession
    rows = train.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = materialize(_counted(rows), "language-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        drop_written(counts)
        return Identifier()
    size, alphabet = counts.agg(F.count("*"), F.count_distinct(F.col("gram").bitwiseAND(F.lit(0xFFFF)))).first()
    tables = list(_probabilities(counts, alphabet))
    drop_written(counts)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    folder = re.sub("^file:/+", "/", f"{shared_dir(spark)}/evidentia-languages-{uuid.uuid4().hex}")
    parts: dict[tuple[str, int], list[tuple[int, str, int, int]]] = {}
    for r in _write(every, folder, 1 + 3 * size // file_rows):
        parts.setdefault((r["lang"], r["kind"]), []).append((r["least"], r["path"], r["first"], r["n"]))
    for t in tables:
        drop_written(t)
    table = lambda x, kind: Written(sorted(parts[x, kind]))
    out = Identifier(languages, [KneserNey.written([table(x, k) for k in range(0, 2 * ORDER, 2)], [table(x, k) for k in range(1, 2 * ORDER, 2)], alphabet) for x in languages])
    measured = _measured(rows, out)
    losses = {r["key"]: r["n"] for r in measured.where("measure = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    out.sharpness = SHARPNESS[min(sorted(losses), key=losses.get)]
    out.ceiling = _quantile(measured.where("measure = 0").select("key", "n"), ceiling) * 1.05
    drop_written(measured)
    return out


def _ordered(bits: np.ndarray) -> np.ndarray:
    """The bits of doubles as signed numbers in the doubles' order, and those as bits again."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _measured(rows: DataFrame, model: Identifier) -> DataFrame:
    """measure, key, n of all rows that have letters, as a written table.

    Measure 0: least cross-entropy as an ordered number, and rows that have it. Measure 1: place in SHARPNESS, and the
    sum of its losses in millionths, whole ones, so that no order of adding changes them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {x: k for k, x in enumerate(own.languages)}
        for batch in batches:
            langs, done = batch.column(1).to_pylist(), 0
            for part in own.groups(batch.column(0).to_pylist(), 1_000_000):
                h, lengths = own.entropies(part)
                full = np.flatnonzero(lengths > 0)
                h, lengths, truth = h[full], lengths[full], np.array([place[langs[done + k]] for k in full], dtype=np.int64)
                done += len(part)
                if not len(full):
                    continue
                keys, n = np.unique(_ordered(h.min(axis=1).view(np.int64)), return_counts=True)
                right = (confidence(h, lengths, s)[np.arange(len(h)), truth] for s in SHARPNESS)
                losses = [int(np.rint(-np.log(np.maximum(p, 1e-9)) * 1e6).sum()) for p in right]
                kinds = np.repeat(np.array([0, 1], dtype=np.int32), [len(keys), len(SHARPNESS)])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*keys.tolist(), *range(len(SHARPNESS))], pa.int64()), pa.array([*n.tolist(), *losses], pa.int64())], names=["measure", "key", "n"])

    return materialize(rows.select("text", "lang").mapInArrow(run, "measure int, key long, n long"), "language-measures")


def _ranked(counts: DataFrame, at: int) -> int:
    """The key at that place, from 0, of keys in order, each n times: by counts of 65,536 ranges at most, each a part of the one before."""
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key", shift)
        for r in sorted(counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect()):
            if at < r["n"]:
                break
            at -= r["n"]
        counts = counts.where(part == r["part"])
    return r["part"]


def _quantile(counts: DataFrame, q: float) -> float:
    """The quantile of doubles given as ordered numbers (key, n), exact; between two of them by their distance, as in numpy."""
    place = q * (counts.agg(F.sum("n")).first()[0] - 1)
    at = int(place)
    low = _ranked(counts, at)
    upto, after = counts.agg(F.sum(F.when(F.col("key") <= low, F.col("n"))), F.min(F.when(F.col("key") > low, F.col("key")))).first()
    a, b = _ordered(np.array([low, low if upto > at + 1 or after is None else after], dtype=np.int64)).view(np.float64)
    return float(a + (b - a) * (place - at))


def identify(docs: DataFrame, model: Identifier, *, doc_id: str = "doc_id", text: str = "text", reject: bool = False, letters: int = 1_000_000) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected per row, of whole texts; only the text counts.

    rejected: the cross-entropy is above what the languages' own documents have. With `reject`, such texts are `und`
    too. Texts without letters (null, empty) and everything under an empty model are `und` with score 0. Texts are
    taken in groups of about so many letters, so memory stays bounded. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [x for part in own.groups(texts, letters) for x in own.classify(part)]
            over = [h > own.ceiling for _, _, h in found]
            langs = [UNKNOWN if reject and o else x for (x, _, _), o in zip(found, over, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([h for _, _, h in found], pa.float64()), pa.array(over, pa.bool_())], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
