"""op11 to op13 against the library and plain versions, over the smallest tables and over odd rows."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import byte_bpe, registry, runs
from caseflow.llm.byte_bpe import decode_documents, encode_documents, read_ranks, token_bytes
from caseflow.llm.resampling import Shifts, resample, running_crcs
from caseflow.llm.runs import Grammar, collapsed, find_runs, runs_of

SF_DIR = "/root/testdata/sf0.001"
RANKS = f"{registry.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
ODD = [None, "", " \t ", "x", "née İ <|endoftext|> 한국\n\x1c 🙂 don't 12 it's   \n\n ok", "a b " * 400, "x" * 3000, " ".join(f"w{i}" for i in range(300)), "ab" * 9 + " A9-b_c É\x00é " * 30]


def rows_of(name):
    return duckdb.sql(f"select * from '{SF_DIR}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def odd(spark, texts=ODD):
    """Odd texts under ids that repeat, one null, with columns that operators use themselves."""
    rows = [(i, t, "mine", 7, 8) for i, t in enumerate(texts)] + [(3, texts[3], "again", 7, 8), (None, texts[4], "none", 7, 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, rank int, runs int")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op11_equals_the_library(spark, texts, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op11_byte_bpe(spark, SF_DIR).collect()}
    want = {}
    for d, t in texts.items():
        ids = library.encode_ordinary(t or "")
        want[d] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
    assert got == want


@pytest.mark.parametrize("block", [1, 50, 1 << 21])
def test_byte_bpe_of_odd_rows(spark, library, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", block)
    docs = odd(spark)
    got = Counter((r["doc_id"], tuple(r["token_ids"]), bytes(r["decoded"])) for r in decode_documents(encode_documents(docs, RANKS), RANKS).collect())
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in docs.collect())
    assert got == want
    assert encode_documents(docs.limit(0), RANKS).count() == 0
    named = encode_documents(docs.select(F.col("block").alias("tokens"), F.col("text").alias("words")), RANKS, id_col="tokens", text_col="words")
    assert named.columns == ["tokens", "token_ids"] and {r["tokens"] for r in named.collect()} == {"mine", "again", "none"}


def test_byte_bpe_words_are_encoded_once(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    parts = byte_bpe.explode_words(rows, 8).select("block", F.explode("parts").alias("p")).select("block", "p.*")
    seen = [(r["bucket"], bytes(w)) for r in parts.collect() for _, n, t in [byte_bpe._unpack(r["words"], 3)] for ends in [np.cumsum(byte_bpe._from_planes(n)).tolist()] for w in [t[a:b] for a, b in zip([0, *ends], ends)]]
    assert len({w for _, w in seen}) == len(set(seen)) and all(crc32(w) % 8 == b for b, w in seen)


def test_decoding_null_and_unknown_ids(spark):
    vocabulary = {r["token_id"]: bytes(r["bytes"]) for r in token_bytes(spark, RANKS).collect()}
    rows = spark.createDataFrame([(None, 1), ([], 1), ([1, 10**6, 2], 1), ([-1], 1), ([1, None, 2], 1)], "token_ids array<int>, __decoded int")
    found = decode_documents(rows, RANKS)
    got = [tuple(x if x is None else bytes(x) for x in (r["decoded"], r["packed_ids"])) for r in found.collect()]
    both, number = vocabulary[1] + vocabulary[2], lambda *ids: np.array(ids).astype("<u4").tobytes()
    assert got == [(None, None), (b"", b""), (both, number(1, 10**6, 2)), (b"", number(-1)), (both, number(1, 2))] and found.columns == ["token_ids", "__decoded", "decoded", "packed_ids"]


def test_pre_tokens_of_all_characters(library):
    from caseflow.llm.token_counts import pre_token_finders

    basic, general = pre_token_finders()
    for first in range(0, 0x30000, 512):
        text = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)} !{chr(c)}\n" for c in range(first, first + 512) if not 0xD800 <= c < 0xE000)
        find = general if first >= 0x10000 else basic
        assert [i for w in find(text) for i in library._encode_single_piece(w.encode())] == library.encode_ordinary(text), hex(first)


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, targets, percent=5, min_words=20, buckets=10_000):
    hashed = {k: (n, [crc32(f.encode()) % buckets for f in fs]) for k, (n, fs) in ((k, features(t)) for k, (_, t) in enumerate(docs))}
    s = Counter(b for _, bs in hashed.values() for b in bs)
    t = Counter(crc32(f.encode()) % buckets for x in targets for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for k, (d, _) in enumerate(docs):
        weight = sum(gain[b] for b in hashed[k][1])
        h = None if d is None else int(sha(f"42:{d}".encode())[:8], 16)
        out.append([d, len(hashed[k][1]), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, hashed[k][0]])
    may = sorted((r for r in out if r[5] >= min_words and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(may[: len(may) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_op12_equals_the_plain_version(spark, texts):
    got = Counter(tuple(r) for r in registry.op12_importance_resampling(spark, SF_DIR).collect())
    assert got == plain_resample(list(texts.items()), [t for _, t in duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()])
    assert sum(1 for r in got if r[4] is not None)


@pytest.mark.parametrize("min_words,percent", [(0, 60), (20, 100)])
def test_resampling_of_odd_rows(spark, min_words, percent):
    docs, target = odd(spark), spark.createDataFrame([("the w1 w2",), (None,), ("x",)], "text string")
    keep = lambda df: Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert keep(resample(docs, target, min_words=min_words, percent=percent, buckets=50)) == plain_resample(rows, ["the w1 w2", None, "x"], percent, min_words, 50)
    assert keep(resample(docs, target.limit(0), min_words=min_words, percent=percent)) == plain_resample(rows, [], percent, min_words)
    assert resample(docs.limit(0), target).count() == 0


def test_shifts_cancel_prefixes_of_any_length():
    shifts, rng = Shifts(), np.random.default_rng(3)
    for n in [0, 1, 2, 255, 256, 257, 511, 70_000]:
        a, b = rng.bytes(int(rng.integers(0, 50))), rng.bytes(n)
        assert int(np.uint32(crc32(a + b)) ^ shifts(np.array([crc32(a)], np.uint32), np.array([n]))[0]) == crc32(b)
    assert running_crcs([b"a", b"bc"]).tolist() == [crc32(b"a"), crc32(b"a bc")] and shifts.blank(np.array([crc32(b"a")], np.uint32))[0] == crc32(b"a ")


def plain_runs(w, least=6, repeats=4):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, repeats * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(w, rng, k):
    if not w:
        return w
    a = int(rng.integers(len(w)))
    p = 1 + (len(w) - a) // k
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_runs_equal_the_plain_version():
    rng = np.random.default_rng(1)
    for _ in range(150):
        group = [rng.integers(0, rng.choice([1, 2, 3, 10]), rng.integers(0, 90)).astype(str).tolist() for _ in range(rng.integers(1, 8))]
        group = [periodic(w, rng, int(rng.integers(3, 11))) if rng.random() < 0.5 else w for w in group]
        assert runs_of(group) == [plain_runs(w) for w in group]
        assert runs_of(group, least=2, repeats=3) == [plain_runs(w, 2, 3) for w in group]


def test_extensions_equal_the_plain_version():
    rng = np.random.default_rng(2)
    for _ in range(40):
        w = np.array(periodic(rng.integers(0, rng.choice([1, 2, 4]), 120).tolist(), rng, 4))
        g = Grammar(w)
        for i, j in [sorted(rng.choice(len(w), 2, replace=False).tolist()) for _ in range(60)]:
            n = next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
            b = next((k for k in range(i) if w[i - 1 - k] != w[j - 1 - k]), i)
            assert (g.forward(i, j), g.backward(i, j)) == (n, b)


def test_very_long_texts_of_one_word_and_of_none_alike():
    assert runs_of([["a"] * 60_000, [str(i) for i in range(60_000)], ["a", "b"] * 20_000]) == [[(0, 60_000, 1)], [], [(0, 40_000, 2)]]


def plain_digest(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digests = (sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return (len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), *digests)


def test_op13_equals_the_plain_version(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op13_periodic_runs(spark, SF_DIR).collect()}
    want = {}
    for d, t in texts.items():
        w, h = WORD.findall(t or ""), crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 3000:  # the plain version is quadratic
            w = None
        want[d] = w and plain_digest(w, plain_runs(w)) if w != [] else plain_digest([], [])
    assert got.keys() == want.keys() and all(v is None or got[d] == v for d, v in want.items())
    assert sum(1 for v in got.values() if v[0])


def test_runs_of_odd_rows(spark, monkeypatch):
    for words in (1, 400_000):
        monkeypatch.setattr(runs, "GROUP_WORDS", words)
        docs = odd(spark)
        got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed_text"]) for r in find_runs(docs).collect())
        want = Counter()
        for r in docs.collect():
            w = WORD.findall(r["text"] or "")
            found = plain_runs(w)
            want[r["doc_id"], len(w), tuple(found), " ".join(collapsed(w, found))] += 1
        assert got == want
    assert find_runs(docs.limit(0)).count() == 0
