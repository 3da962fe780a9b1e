"""Phrases, token files and centroids against brute force, and their defined results on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, extra string"


# --- phrases


def brute_phrases(rows, least, longest=4, inside=80, top=2000):
    f, n = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [g for (other, q), g in f.items() if other == lang and len(q) > len(p) and g >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * g >= inside * a for g in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def phrases(spark, rows, **how):
    from evidentia.llm.collocations import collocations

    docs = spark.createDataFrame([(k, t, lang, "x") for k, (t, lang) in enumerate(rows)], DOCS).withColumn("word", F.lit(1)).withColumn("rank", F.lit("r")).repartition(3)
    return sorted(map(tuple, collocations(docs, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("positions", [7, 50, 1 << 20])
def test_phrases_against_brute_force(spark, positions):
    rng = random.Random(positions)
    words = ["a", "b", "A", "ß", "Éa", "x y", "\U0001d4d0", "￮", "c"]
    ends = [" ", " ", " ", "\t", "  ", ". ", "\n", ",", ";x ", " \r"]
    rows = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["de", "en", None])) for _ in range(25)]
    rows += [(None, "en"), ("", "fr"), (" ,. ", None), ("b c " * 40, "en"), ("b c " * 40, "en"), ("q " * 90, "und")]
    for least, top in ((3, 2000), (5, 4)):
        assert phrases(spark, rows, least=least, positions=positions, top=top) == brute_phrases(rows, least, top=top)


def test_phrases_other_lengths_and_ties(spark):
    rows = [("one two three four five six " * 5, "en"), ("p q . r s . " * 5, "en"), ("p q", "de")]
    for longest in (2, 3, 6):
        assert phrases(spark, rows, least=5, longest=longest, positions=11) == brute_phrases(rows, 5, longest)
    assert [r[2] for r in phrases(spark, rows, least=5, longest=2, positions=64)][:2] == ["five six", "four five"]  # equal scores and counts: by bytes
    assert phrases(spark, [], least=1) == [] and phrases(spark, [(None, None)], least=1) == []


def test_phrases_of_a_very_long_text(spark):
    from evidentia.llm import collocations as C

    text = " ".join(f"w{k % 7} v{k % 11}" for k in range(200_000))
    assert len(text) > C._SLICE
    rows = [(text, "en"), ("w0 v0 " * 3, "en")]
    assert phrases(spark, rows, least=12_000, positions=1 << 16) == brute_phrases_fast(rows, 12_000)


def brute_phrases_fast(rows, least):
    """brute_phrases() for few different phrases."""
    f, n = collections.Counter(), 0
    for text, _ in rows:
        words = text.split()
        n += len(words)
        for k in range(1, 5):
            f.update(zip(*(words[i:] for i in range(k)), strict=False))
    keep = {p: a for p, a in f.items() if a >= least}
    out = []
    for p, a in keep.items():
        if len(p) > 1 and not any(len(q) > len(p) and 100 * g >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, g in keep.items()):
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            out.append((-score, -a, " ".join(p), left, right))
    return sorted(("en", k, p, -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(out)[:2000], 1))


def test_bitmaps_shift_and_count():
    """Every extension of a random sequence by one, two and three words, with own positions and those ahead."""
    from evidentia.llm.collocations import Bitmaps, _Writer

    rng = random.Random(1)
    words = [rng.choice([b"\xff", b"a", b"b", b"c"]) for _ in range(203)]
    writer = _Writer(0, 200, 3)
    row = next(writer.add("en", words[:200], words[200:])).to_pylist()[0]
    names = np.arange(len(row["words"]))
    maps = Bitmaps(row["own"], np.array(row["ends"]), np.frombuffer(row["blocks"], "<u2"), np.frombuffer(row["masks"], "<u2"), names, names)
    got = {tuple(row["words"][i].encode() for i in p): c for block, n in maps.grow(4) for p, c in zip(block, n, strict=True)}
    want = collections.Counter(tuple(words[i : i + k]) for k in (2, 3, 4) for i in range(200) if i + k <= 203 and b"\xff" not in words[i : i + k])
    assert got == want and row["counts"] == [words[:200].count(w.encode()) for w in row["words"]]


# --- token files


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = encoded.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [(5, "Some text here."), (1, None), (3, ""), (None, "null id"), (2, "café\nß ДA <|endoftext|>"), (2, "another of the same id"), (2, "another of the same id"), (9, "long " * 30_000), (-4, "x" * 5000), (7, " \t ")]


@pytest.mark.parametrize("size", [1 << 25, 40_000])
def test_token_files_read_back(spark, tmp_path, size):
    from evidentia.llm.token_store import fetch, read_index, read_store, write_store

    rows = ODD + [(100 + k, f"document {k} about {k * k}") for k in range(50)]
    docs = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], DOCS).withColumn("start", F.lit(1)).withColumn("_tie", F.lit(1)).repartition(3)
    path = f"file://{tmp_path}/store"
    write_store(docs, path, file_bytes=size)
    got = read_store(spark, path, ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want, start = collections.Counter((i, tuple(encoded(t))) for i, t in rows), 0
    for r in got:
        ids = r["ids"]
        want[r["doc_id"], tuple(ids)] -= 1
        assert r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not +want and not -want
    index = read_index(spark, path)
    assert sorted((r["start"], r["n_tokens"]) for r in index.collect()) == sorted((r["start"], r["n_tokens"]) for r in got)
    some = spark.createDataFrame([(2,), (9,), (2,), (12345,)], "doc_id long")
    assert sorted((r["doc_id"], r["start"], tuple(r["ids"])) for r in fetch(spark, path, some).collect()) == sorted((r["doc_id"], r["start"], tuple(r["ids"])) for r in got if r["doc_id"] in (2, 9))


def test_token_files_share_one_dictionary(spark, tmp_path):
    """Short documents of like words compress better than each alone; another dictionary's hash and damaged bytes are refused."""
    import zstandard

    from evidentia.llm.token_store import read_index, read_store, write_store

    rng = random.Random(2)
    lines = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=40)) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, "en", "x") for k, t in enumerate(lines)], DOCS)
    write_store(docs, f"{tmp_path}/one")
    alone = sum(len(zstandard.compress(np.array(encoded(t), "<u2").tobytes())) for t in lines)
    assert spark.read.parquet(f"{tmp_path}/one/dictionary").first()["dictionary"]
    assert read_index(spark, f"{tmp_path}/one").agg(F.sum("bytes")).first()[0] < 0.9 * alone
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), bytearray(b"x"), 2)], "sha256 string, dictionary binary, width int").write.mode("overwrite").parquet(f"{tmp_path}/one/dictionary")
    with pytest.raises(Exception, match="of another dictionary"):
        read_store(spark, f"{tmp_path}/one")
    spark.createDataFrame([("0" * 64, bytearray(b"x"), 2)], "sha256 string, dictionary binary, width int").write.mode("overwrite").parquet(f"{tmp_path}/one/dictionary")
    with pytest.raises(ValueError, match="damaged dictionary"):
        read_store(spark, f"{tmp_path}/one")


def test_no_documents_give_no_rows(spark, tmp_path):
    from evidentia.llm.token_store import read_store, write_store

    write_store(spark.createDataFrame([], DOCS), f"{tmp_path}/none")
    assert read_store(spark, f"{tmp_path}/none").collect() == []


def test_the_tokenizers_memory_may_be_trimmed():
    from evidentia.llm.packing import ChunkTokenizer

    rng = random.Random(3)
    small, texts = ChunkTokenizer(memory=20), [" ".join(rng.choices([f"Word{k}" for k in range(60)] + ["a,b", "ДА", "x'll"], k=30)) for _ in range(60)]
    for k, t in enumerate(texts):
        assert [*small.encode([t, None])[0], 1] == encoded(t)
        assert len(small.known) <= 20 + 63
        if k % 7 == 0:
            small.trim()


# --- centroids


def brute_centroids(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in kept:
            groups[nearest(x)].append(x)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(centroids)]
    found = [(i, nearest(x), far(x, centroids[nearest(x)])) for i, x in kept]
    own = collections.Counter()
    for _, c, d in found:
        own[c] += d
    return sorted(((i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


@pytest.mark.parametrize(("n", "leaf", "tree"), [(400, 4, 90), (400, 16, 8192), (5, 2, 3)])
def test_centroids_against_brute_force(spark, n, leaf, tree):
    from evidentia.llm.kd_centroids import cluster

    rng = np.random.default_rng(n + leaf)
    middle = rng.normal(size=(5, 64))
    rows = [(int(i), (middle[rng.integers(5)] + 0.1 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 3)] + [rows[1]] * 3  # many copies of one vector, repeated rows
    rows += [(1, None), (2, [0.5] * 63), (3, [0.5] * 65), (4, [float("nan")] + [0.0] * 63), (5, [float("inf")] + [0.0] * 63), (6, [None] + [0.0] * 63), (None, [0.25] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1)).repartition(3)
    got = cluster(vectors, leaf=leaf, tree=tree).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_centroids(rows)


def test_centroids_of_nothing_and_of_equal_vectors(spark):
    from evidentia.llm.kd_centroids import cluster

    make = lambda rows: cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).collect() == [] and make([(1, [1.0])]).collect() == []
    rows = [(i, [0.5] * 64) for i in range(30)]
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in make(rows).collect()} == {(0, 0, 0)}


def test_filtering_agrees_with_all_distances():
    """Ties and boundaries: few different coordinates, so that many vectors are as near to one centroid as to another."""
    from evidentia.llm.kd_centroids import descend, grow

    rng = np.random.default_rng(0)
    for dims, spread in itertools.product((1, 2, 5), (2, 4, 50)):
        x, centroids = rng.integers(-spread, spread, (300, dims)), rng.integers(-spread, spread, (8, dims))
        order, tree = grow(x, 5)
        label, count, sums = descend(x[order], tree, centroids)
        want = ((x[order][:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
        assert (label == want).all() and (count == np.bincount(want, minlength=8)).all()
        assert all((sums[c] == x[order][want == c].sum(axis=0)).all() for c in range(8))
