"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, held against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import components, shared, similar, substrings
from caseflow.llm.components import connected_components
from caseflow.llm.license_rules import signature_rules
from caseflow.llm.licenses import license_scanner, scan_licenses
from caseflow.llm.mixing import mix, words
from caseflow.llm.neighbours import build_index, search
from caseflow.llm.pii import contexts, find_personal_data, joined, pattern_totals, redact, trusted_patterns
from caseflow.llm.sentencepiece import Encoder, StreamingViterbi, decode, encode_documents
from caseflow.llm.simhash import fingerprinter, near_duplicates
from caseflow.llm.substrings import remove_repeats
from caseflow.llm.token_counts import count_tokens
from caseflow.llm.topk import exact_top_k, quantise
from caseflow.llm.toxicity import WINDOW_WORDS, WINDOWS, WORD, _forward_backward, fit_chain, score_toxicity, tagger, text_windows, train

TOKENIZERS = "/opt/tokenizers"
TEXTS = [None, "", "x", "a b " * 400, "one two three four five six seven eight nine ten " * 5, " ".join(f"w{i}" for i in range(300)), "née <|endoftext|> 한국\t\n  \x1c 🙂 don't 12"]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0, "mine") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_tokens int, label string")


@pytest.mark.parametrize("limit", [1, 512])
def test_substrings_against_sets(spark, monkeypatch, limit):
    monkeypatch.setattr(substrings, "SHARD_RUNS", limit)
    rng = np.random.default_rng(limit)
    line = [f"l{i}" for i in range(15)]
    texts = list(TEXTS)
    for _ in range(40):
        texts.append(" ".join([*map(str, rng.integers(0, 50, 30)), *line, *map(str, rng.integers(0, 50, 30))]))
    texts += [texts[10], texts[11][20:], texts[12] + " " + texts[13]]
    docs = docs_of(spark, texts)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        dead = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            dead[k : k + 20] |= key in seen
            seen.add(key)
        want[i] = (len(w), int(dead.sum()), hashlib.sha256(b" ".join(x for x, d in zip(w, dead, strict=True) if not d)).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()}
    assert got == want
    assert remove_repeats(docs.limit(0)).count() == 0


def test_repeats_are_equal_words_not_equal_hashes(spark):
    """A word of 2048 letters and its twin with a and b swapped collide in every polynomial hash modulo 2**64."""
    twin = ["ab"[i.bit_count() & 1] for i in range(2048)]
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:11], "".join(t), *words[12:]]) for t in (twin, ["ba"[c == "b"] for c in twin])]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 28}


def test_token_counts_against_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    got = count_tokens(docs_of(spark, TEXTS * 2), f"{TOKENIZERS}/byte_bpe_50k.json", prefix="bpe_").orderBy("doc_id").collect()
    assert [r["bpe_n_tokens"] for r in got] == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in TEXTS * 2]
    assert got[0]["n_tokens"] == 0 and got[0]["label"] == "mine" and [r["bpe_n_bytes"] for r in got] == [len((t or "").encode()) for t in TEXTS * 2]


def test_mixing_fills_siblings_first(spark):
    rows = [(i, "a " * 10, lang, source) for i, (lang, source) in enumerate([("en", "s1")] * 40 + [("en", "s2")] * 2 + [("fr", "s3")] * 40 + [(None, None)] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    options = {"domain": F.lit("d"), "weights": {"lang": {"en": 2, "fr": 2}}, "tokens": words(), "seed": "t"}
    got = {(r["lang"], r["source"]): r["n"] for r in mix(docs, budget_share=0.5, max_epochs=1, **options).groupBy("lang", "source").agg(F.sum("__tokens").alias("n")).collect()}
    total = 420
    assert got[("en", "s2")] == 20 and got[(None, None)] == 20  # too small for their share: all they have
    assert abs(got[("en", "s1")] + 20 - 200) <= 20 and abs(got[("fr", "s3")] - 200) <= 20 and abs(sum(got.values()) - total) <= 30
    assert mix(docs, budget_share=1.2, max_epochs=3, floor_epochs=1, **options).select("doc_id").distinct().count() == 84
    assert mix(docs.limit(0), budget_share=0.5, **options).count() == 0


def test_top_k_against_sorting(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [0.0] * 8), (304, rows[7][1]), (304, rows[7][1]), (305, [1.0])]
    vectors = quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all() and len(v) == 8]
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert 300 not in got and exact_top_k(vectors.limit(0), vectors.limit(0), k=5).count() == 0


@pytest.fixture(params=[False, True], ids=["plain", "hot"])
def hot_keys(request, monkeypatch):
    """With "hot" every key of over two rows is split."""
    if request.param:
        for module in (components, shared, similar):
            monkeypatch.setattr(module, "HOT_ROWS", 2)


def test_hot_keys_are_split_and_whole(spark, hot_keys):
    rows = spark.createDataFrame([(i % 7 and 1, i) for i in range(500)] + [(2, 1), (3, None), (1, 5), (1, 5)], "k long, v long")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, name string")
    got = shared.spread_join(rows, small, ["k"], "v", 430)
    assert got.columns == ["k", "v", "name"] and sorted(map(tuple, got.collect())) == sorted((k, v, "abc"[k]) for k, v in map(tuple, rows.collect()) if k < 3)
    split, parts = shared.split_hot(rows, ["k"], "v", "part")
    if shared.HOT_ROWS == 2:
        assert split.where("k = 1").groupBy("part").count().agg(F.max("count")).first()[0] < 30 and parts.where("k > 1").count() == 2


def test_components_against_merging(spark, hot_keys):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300), (301, 300), (301, 300)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and set(root) - set(got) == {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_all_pairs(spark, hot_keys):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [*TEXTS, base, base.replace("w7 ", "q "), base + " end", base.upper(), "  "]
    mark = fingerprinter(3)
    prints = [mark(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3:
                    root[i] = min(root[i], root[j])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs_of(spark, texts), shingle_words=3).collect()}
    assert got == {i: (p, r) for i, (p, r) in enumerate(zip(prints, root, strict=True))}
    assert near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_differences_from_a_hub_lose_no_link(spark, seed):
    """Random sets around some bases, at all distances; every pair that reaches the share and joins two classes is among the candidates."""
    rng = np.random.default_rng(seed)
    sets, bases = {}, [rng.choice(10**6, 60, replace=False) for _ in range(3)]
    for i in range(90):
        x = set(bases[i % 3][: rng.integers(30, 61)].tolist())
        for t in rng.choice(list(x), rng.integers(0, 12), replace=False).tolist():
            x.discard(t)
            if rng.random() < 0.8:
                x.add(int(rng.integers(0, 40) if rng.random() < 0.5 else rng.integers(10**6, 10**7)))
        sets[i] = x
    live = spark.createDataFrame([(i % 3 if i % 7 else 9, i, i) for i in sets] + [(i % 3, i, i) for i in sets if i % 7 == 0], "bucket long, node long, comp long")
    found = similar._difference_pairs(live, spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "node long, shingles array<long>"), 0.8, len(sets))
    got = {(r["a"], r["b"]) for r in found.collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    # links between texts that both reach the share with a hub may be missing: they are one class through it
    root = {i: i for i in sets}
    for pairs in (got & alike, alike):
        before = dict(root)
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        if pairs is alike:
            assert root == before
    assert len(got) < len(sets) * (len(sets) - 1) / 4


@pytest.mark.parametrize("rounds, hot_keys", [(0, False), (2, False), (2, True)], indirect=["hot_keys"])
def test_similar_groups_against_all_pairs(spark, monkeypatch, rounds, hot_keys):
    import corpus_pipeline

    monkeypatch.setattr(similar, "HUB_ROUNDS", rounds)
    rng, texts = np.random.default_rng(8), list(TEXTS)
    for changed in (1, 2, 3, 4, 5, 6, 8, 10) * 6:  # of 200 words: Jaccard 0.95 to 0.6
        words = [f"v{x}" for x in rng.integers(0, 10**6, 200)]
        again = list(words)
        for at in rng.choice(200, changed, replace=False):
            again[at] = "other"
        texts += [" ".join(words), " ".join(again)]
    crowd = [f"c{i}" for i in range(200)]
    texts += [" ".join([*crowd[:i], f"n{i}", *crowd[i + 1 :]]) for i in range(0, 200, 4)]
    texts += ["  ", texts[5].upper()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()} for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    while True:
        before = list(root)
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(root)) and similar.similar_groups(docs_of(spark, texts).limit(0)).count() == 0
    if rounds:
        kept = corpus_pipeline.simhash_near_dedup(spark, docs_of(spark, texts), "").select("doc_id").collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


def test_sentencepiece_against_the_library(spark):
    import sentencepiece

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), Encoder(path)
    texts = [*TEXTS, "x" * 3000 + "abc" * 900, "▁a  ▁", "<s>hi</s> \x00 ²."]
    rows = encode_documents(docs_of(spark, texts), path).orderBy("doc_id").collect()
    assert [list(r["piece_ids"]) for r in rows] == [library.encode(t or "") for t in texts] and all(r["round_trip"] for r in rows)
    assert all(decode(ours.encode(t), ours.vocabulary) == library.decode(library.encode(t)) for t in texts if t)
    assert ours.trellis.encode("x" * 20000) and ours.trellis.widest <= 3 * ours.vocabulary.longest  # the window stays bounded


def test_score_sums_against_a_plain_dynamic_program():
    """The trellis of a unigram model: many paths compete in the window, and the best sum wins."""
    encoder = Encoder(f"{TOKENIZERS}/piece_bpe_32k.model")
    v = encoder.vocabulary
    rng = np.random.default_rng(9)
    trellis = StreamingViterbi(v, bpe=False)
    for text in ["the information of international cooperation" * 20, "aaaaaaaaab" * 30, "é한x" * 10, "", *["".join(rng.choice(list("abet ing"), 300)) for _ in range(5)]]:
        best = [(0.0, ())] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - v.longest), end):
                piece = text[start:end]
                score = v.score.get(piece, trellis.lowest if len(piece) == 1 and piece not in v.id else None)
                if score is not None and best[start] is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                    best[end] = (best[start][0] + score, (*best[start][1], piece))
        got = list(trellis.pieces(text))
        assert "".join(v.text[i] if i >= 0 else chr(-2 - i) for i in got) == text
        total = sum(v.score[v.text[i]] if i >= 0 else trellis.lowest for i in got)
        assert abs(total - best[len(text)][0]) < 1e-6
    assert trellis.widest <= 3 * v.longest


def test_a_copy_finds_the_others_and_a_huge_row_hides_nothing(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(400, 8))
    v[100:160] = v[5]
    v[399] = 1e12
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = build_index(df)
    got = {}
    for r in search(index, df.where("vec_id in (150, 7, 399)"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[150] == [(i, 0.0) for i in [5, *range(100, 109)]]
    for q in (7, 399):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        assert [i for i, _ in got[q]] == [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
    with pytest.raises(ValueError):
        search(index, df, k=11)


def test_neighbours_find_nearly_all(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16))
    v[200:260] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2100, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in search(build_index(df), df.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(len(v)), d)) if i != q][:10]
        hits += sum(i in got[q] for i in best)
    assert hits >= 0.9 * 150 and set(got) == set(range(0, 1500, 100)) and sorted(got[100]) == list(range(200, 210))


def test_licenses(spark):
    assert len(signature_rules()) > 200
    texts = [*TEXTS, "Released under the MIT License. Licensed under CC BY-NC 4.0", "the Apache License, Version 2.0, under the mit license under the MIT license", "GNU General Public License, version 3"]
    rows = scan_licenses(docs_of(spark, texts), prefix="lic_").orderBy("doc_id").collect()
    assert rows[7]["lic_base_labels"] == "cc-by-nc,mit" and rows[8]["lic_n_base"] == 3 and rows[9]["lic_labels"] == "gpl-3" and rows[9]["lic_n_base"] == 0
    assert rows[0]["lic_n_words"] == 0 and rows[0]["lic_labels"] == "" and rows[0]["lic_first_word"] is None and rows[0]["label"] == "mine"


def test_licenses_named_by_version_only():
    scan = license_scanner()
    named = {
        "Apache 2.0": "apache-2", "BSD 3-clause": "bsd-3", "EPL-2.0": "epl-2", "MPL 2.0": "mpl-2", "CC0 1.0": "cc0", "apache2": "apache-2", "gpl2": "gpl-2", "LGPL 2.1": "lgpl-2.1",
        "subject to the MPL 2.0": "mpl-2", "subject to the isc": "isc",
    }
    got = {text: (row[5], row[6] > 0) for text in named for row in [scan(f"We ship {text} here")]}
    assert got == {text: (label, True) for text, label in named.items()}
    # the keywords leave out no rule: every rule alone, on texts made from all names and uses
    rules = [(label, re.compile(f" (?:{pattern})(?= )")) for _, label, _, _, pattern in signature_rules()]
    for text in [*named, "mit freundlichen", "spdx license identifier isc", "in the public domain", "server side public license", "creative commons zero", "ofl 1 1", "agpl3", "gfdl1 3", "eupl1 2"]:
        words = re.sub("[^a-z0-9]+", " ", text.lower())
        assert (scan(text)[5] != "") == any(r.search(f" {words} ") for _, r in rules), text


def test_personal_data(spark):
    texts = [*TEXTS, "Mail a@b.c_x@d.e or 1.2.3.4.5.6.7.8, 4111 1111 1111 1111 and +1 (017) 555-7713.", "9" * 20000, "é 300.1.1.1 +12 x@y"]
    texts += [f"badge no: {n} here" for n in ("4111111111111111", "4012888888881881", "5555555555554444", "AB-12345-X")]
    found = find_personal_data(docs_of(spark, texts))
    rows = found.withColumn("clean", redact(F.coalesce("text", F.lit("")), F.col("pii_spans"))).select("doc_id", joined(F.col("pii_spans")).alias("s"), "clean").orderBy("doc_id").collect()
    spans = {r["doc_id"]: r["s"] for r in rows}
    t = texts[7]
    for kind, value in (("email", "a@b.c"), ("email", "_x@d.e"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713")):
        at = t.index(value)
        assert f"{kind}:{at}:{at + len(value)}" in spans[7]
    assert spans[0] == spans[1] == spans[8] == spans[9] == ""
    assert spans[13] == "id:10:20" and rows[13]["clean"] == "badge no: <ID> here" and rows[10]["clean"] == "badge no: <CARD> here"
    assert "MapInPandas" not in (plan := found._jdf.queryExecution().toString()) and "Python" not in plan


def test_patterns_are_scored_against_all_their_occurrences(spark):
    """Seeds after a common word make it no pattern; a pattern with a sign is one; what it discovers seeds the next; key shapes are seeds."""
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(8)]
    cards = ["4111111111111111", "4012888888881881", "5555555555554444"]
    texts = [f"the {c} and the word and the other of the same" for c in cards] + [f'here token = "{k}" ends' for k in keys]
    shared = ["zz-1234-q", "AB-10001", "EF-30003", "IJ-50005"]
    texts += [f'here token = "{v}" ends' for v in shared] + [f"staff no: {v}" for v in [*shared, "GH-40004"]] + ["badge: nothing", "room: 5555 5"]
    rows = {r["text"]: r["s"] for r in find_personal_data(docs_of(spark, texts)).select("text", joined(F.col("pii_spans")).alias("s")).collect()}
    assert all("id:" not in rows[t] for t in texts[:3]) and all("id:14:54" in rows[t] for t in texts[3:11])
    assert rows['here token = "zz-1234-q" ends'] == "id:14:23" and rows["staff no: GH-40004"] == "id:10:18" and rows["room: 5555 5"] == ""
    # "staff no: " has no seed of its own: its values are those that the other patterns discovered
    edges = spark.createDataFrame([("p", "a", True, 1), ("p", "b", True, 1), ("p", "c", True, 1), ("p", "d", False, 1), ("q", "d", False, 3), ("q", "e", False, 1), ("w", "a", True, 2), ("w", "b", True, 1), ("w", "c", True, 1)], "pattern string, value string, seed boolean, n long")
    totals = spark.createDataFrame([("p", 4), ("q", 4), ("w", 100)], "pattern string, total long")
    got = {r["pattern"]: (round(r["score"], 9), r["n_seeds"]) for r in trusted_patterns(edges, totals, min_score=0.5, min_seeds=1, prior=1.0).collect()}
    assert set(got) == {"p", "q"} and got["q"] == (0.8, 2)


def test_pattern_totals(spark, monkeypatch):
    from caseflow.llm import pii

    texts = spark.createDataFrame([('The token = "x" and token="y", token: z. the THE (the',), (None,)], "t string")
    wanted = spark.createDataFrame([("the ",), ('token = "',), ('token="',), ("token: ",), ("none ",)], "pattern string")
    for limit in (pii.BROADCAST_PATTERNS, 0):
        monkeypatch.setattr(pii, "BROADCAST_PATTERNS", limit)
        assert {r["pattern"]: r["total"] for r in pattern_totals(texts, wanted).collect()} == {"the ": 4, 'token = "': 1, 'token="': 1, "token: ": 1}


def test_labels_are_not_used_up_by_words(spark):
    texts = {
        "my badge: 12345": [("badge: ", "12345")],
        "badge number: 12345": [("number: ", "12345")],
        "contact badge 12345": [("badge ", "12345")],
        "see the badge no: AB-12345-X here": [("no: ", "AB-12345-X")],
        "call me at +49(017) 555-7713 now": [("at ", "+49(017) 555-7713")],
        "card 4111 1111 1111 1111": [("card ", "4111 1111 1111 1111")],
        "key ab1c 2 badge id 12a4 56": [("id ", "12a4 56")],
        "one two three 123 four x12y 3": [],
        "room12 desk34 abcd": [],
    }
    docs = docs_of(spark, list(texts))
    got = {r["text"]: [(c["pattern"], c["value"]) for c in r["c"]] for r in docs.select("text", contexts(F.col("text")).alias("c")).collect()}
    assert got == texts
    assert all(r["text"][c["start"] : c["stop"]] == c["value"] for r in docs.select("text", contexts(F.col("text")).alias("c")).collect() for c in r["c"])


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = [" ".join(rng.choice([f"word{i}" for i in range(60)], 40)) for _ in range(120)]
    toxic = [re.sub(r"word3 |word7 ", "scum ", p + " word3 ") for p in plain[:60]]
    model = fit_chain([(*text_windows(t), y) for t, y in [(t, 1) for t in toxic[:50]] + [(t, 0) for t in plain[60:110]]], (900, 100))
    texts = [*TEXTS, *toxic[50:], *plain[110:]]
    rows = score_toxicity(docs_of(spark, texts), model).orderBy("doc_id").collect()
    flags = [r["toxic_score"] >= 0.3 for r in rows]
    assert flags == [False] * 7 + [True] * 10 + [False] * 10
    assert all(r["text"][s["start"] : s["stop"]] == "scum" for r in rows for s in r["toxic_spans"])
    assert tagger(fit_chain([], (0, 0)))("x")[0] == 0.5
    docs = docs_of(spark, texts)
    assert score_toxicity(docs.limit(0), model).count() == 0 and score_toxicity(docs.withColumnRenamed("label", "toxicity"), model).columns[:6] == [*docs.columns[:5], "toxicity"]
    # the trainer: ids that are held out, null labels and null texts teach nothing
    labels = docs.select("doc_id", F.when(F.col("doc_id").between(7, 16), 1).when(F.col("doc_id") > 16, 0).alias("toxic"))
    held = {r[0] for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).select("doc_id").collect()}
    assert held and tagger(train(docs, labels))(texts[7])[0] > tagger(train(docs, labels))(texts[20])[0]
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(*held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert train(docs, flipped) == train(docs, labels)
    assert tagger(train(docs, labels.limit(0)))("x")[0] == 0.5


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(4)
    evidence, moves, lengths = rng.normal(size=(6, 3)) * 2, rng.normal(size=(2, 2)), np.array([6, 4, 1])
    marginal, joint = _forward_backward(evidence, moves, lengths)
    want = np.zeros((2, 2))
    for j, n in enumerate(lengths):
        taggings = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        mass = np.exp([sum(evidence[i, j] * y for i, y in enumerate(t)) + sum(moves[a, b] for a, b in zip(t, t[1:], strict=False)) for t in taggings])
        mass /= mass.sum()
        assert np.allclose(marginal[:n, j], [sum(m for m, t in zip(mass, taggings, strict=True) if t[i]) for i in range(n)])
        for m, t in zip(mass, taggings, strict=True):
            for a, b in zip(t, t[1:], strict=False):
                want[a, b] += m
    assert np.allclose(joint, want)
    # the scorer's own pass gives the same marginals
    words = [f"w{i}" for i in range(6)]
    model = {"weights": {f"={w}": float(e) for w, e in zip(words, evidence[:, 0], strict=True)}, "bias": 0.0, "moves": moves.tolist(), "document": [0.0, 0.0, 0.0, 0.0]}
    spans = {s[0] // 3: s[2] for s in tagger(model)(" ".join(words))[1]}
    assert spans and all(np.isclose(p, marginal[i, 0]) for i, p in spans.items())


def test_long_texts_teach_in_windows():
    words = [f"w{i}" for i in range(WINDOW_WORDS * WINDOWS)]
    windows, n = text_windows(" ".join(words))
    assert n == len(words) and [w for t in windows for w in WORD.findall(t)] == words
    windows, n = text_windows(" ".join([*words, *words, "end"]))
    assert n == 2 * len(words) + 1 and len(windows) == WINDOWS and windows[0].startswith("w0 ") and windows[-1].endswith(" end")
    assert text_windows(None) == ([], 0) and text_windows(" ") == ([], 0)


def test_operators_run_where_only_the_driver_has_the_package(tmp_path):
    """Tasks must not import the package: another process, in another folder, with the package on the driver's path alone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = f"""import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
import __spark_entry__
for name in {["op10_toxicity", "op8_license_scan", "op1_substring_dedup", "op2_token_counts"]}:
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in got.stdout, got.stderr[-2000:]


@pytest.mark.parametrize("limit", [1, 512])
@pytest.mark.parametrize("order", [[1, 2], [1, 1, 2], [1, 2, 2], [2, 1, 2, 1, 3, 3]])
def test_substrings_of_repeated_rows_that_share_an_anchor(spark, monkeypatch, limit, order):
    monkeypatch.setattr(substrings, "SHARD_RUNS", limit)
    shared = " ".join(f"s{i}" for i in range(24))
    texts = {1: f"a b c d e f g {shared} h i j k l m n o", 2: f"p q r s t u v w {shared} x y z aa", 3: f"{shared} 1 2 3 4 5 6 7 8 9 10 11 12"}
    rows = spark.createDataFrame([(d, texts[d]) for d in order], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(rows).collect())
    assert got == sorted((d, 0 if d == 1 else 24) for d in order)


def test_sentencepiece_keeps_a_column_of_its_own_name(spark):
    got = encode_documents(spark.createDataFrame([("x", 1)], "text string, __sentencepiece int"), f"{TOKENIZERS}/piece_bpe_32k.model")
    assert got.columns[:2] == ["text", "__sentencepiece"] and got.first()["__sentencepiece"] == 1
