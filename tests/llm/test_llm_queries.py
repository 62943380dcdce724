"""The registered queries of the subpackage and the pipeline against plain versions over the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm import registry
from caseflow.llm.license_rules import signature_rules
from caseflow.llm.licenses import license_scanner
from caseflow.llm.mixing import mix, words
from caseflow.llm.pii import find_personal_data, joined
from caseflow.llm.toxicity import tagger, train

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels")
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SPECIAL = [None, "", " \t ", "x", "née İ <|endoftext|> 한국\n\x1c 🙂 don't 12 under the MIT license", "card 4111-1111-1111-1111 a@b.co 1.2.3.4 +49 (0) 171 5555555 " * 30]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables whose documents are the odd texts alone, one of them twice."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(SPECIAL)] + [(5, SPECIAL[5], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, SPECIAL[4]), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def result(spark, name, sf_dir=SF_DIR):
    return registry.QUERIES[name](spark, sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    found = result(spark, name)
    columns = sorted(found.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    twin = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in twin.description]
    assert sorted(names) == columns and rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in twin.fetchall())


def test_op2_counts(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{registry.TOKENIZERS}/byte_bpe_50k.json")
    got = {r["doc_id"]: tuple(r)[1:] for r in result(spark, "op2_token_counts").collect()}
    for d, t in texts.items():
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        assert got[d] == (len((t or "").encode()), n, n > 1024)


def xxh64(data: bytes, seed: int) -> int:
    """XXH64 by its published description."""
    p1, p2, p3, p4, p5, mask = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261, 2**64 - 1
    turn = lambda x, r: ((x << r) | (x >> (64 - r))) & mask
    step = lambda acc, lane: turn((acc + lane * p2) & mask, 31) * p1 & mask
    n, at = len(data), 0
    if n >= 32:
        v = [(seed + p1 + p2) & mask, (seed + p2) & mask, seed, (seed - p1) & mask]
        while at + 32 <= n:
            v = [step(x, int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")) for i, x in enumerate(v)]
            at += 32
        h = sum(turn(x, r) for x, r in zip(v, (1, 7, 12, 18), strict=True)) & mask
        for x in v:
            h = ((h ^ step(0, x)) * p1 + p4) & mask
    else:
        h = (seed + p5) & mask
    h = (h + n) & mask
    while at + 8 <= n:
        h = (turn(h ^ step(0, int.from_bytes(data[at : at + 8], "little")), 27) * p1 + p4) & mask
        at += 8
    if at + 4 <= n:
        h = (turn(h ^ (int.from_bytes(data[at : at + 4], "little") * p1 & mask), 23) * p2 + p3) & mask
        at += 4
    for b in data[at:]:
        h = turn(h ^ (b * p5 & mask), 11) * p1 & mask
    h = (h ^ (h >> 33)) * p2 & mask
    h = (h ^ (h >> 29)) * p3 & mask
    return h ^ (h >> 32)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxh64(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op5_fingerprints_and_components(spark, texts):
    assert xxh64(b"", 0) == 0xEF46DB3751D8E999 and xxh64(b"abc", 0) == 0x44BC2CF5AD770999
    prints = {d: fingerprint(t) for d, t in texts.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = {d: (f"{prints[d]:016x}", r) for d, r in groups(prints, near).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, "op5_simhash_near_dedup").collect()} == want


def test_op6_ids(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=f"{registry.TOKENIZERS}/piece_bpe_32k.model")
    for r in result(spark, "op6_sentencepiece").collect():
        assert list(r["piece_ids"]) == library.encode(texts[r["doc_id"]] or "") and r["round_trip"] and r["n_pieces"] == len(r["piece_ids"])


def license_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
    places = [(i, label) for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_op8_base_columns(spark, texts, odd_dir):
    for sf_dir, held in ((SF_DIR, texts), (odd_dir, dict(enumerate(SPECIAL)))):
        rows = result(spark, "op8_license_scan", sf_dir).collect()
        assert len(rows) >= len(held)
        for r in rows:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_base(held[r["doc_id"]])
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_op8_suppression_against_all_intervals():
    rules, scan = signature_rules(), license_scanner()
    pieces = ["under the mit license", "gpl", "gplv2", "apache license version 2 0", "apache 2", "cc by nc", "cc by nc sa 4 0", "and", "or isc", "licensed under the gnu general public license version 3", "x", "mpl 2 0", "all rights reserved", "bsd 3 clause license"]
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = " ".join(rng.choice(pieces, 12))
        joined_words = f" {text} "
        found = [(-p, m.start() - m.end(), m.start(), order, m.end(), label) for order, (p, label, _, _, pattern) in enumerate(rules) for m in re.finditer(f" (?:{pattern})(?= )", joined_words)]
        kept = []
        for _, _, a, _, b, label in sorted(found):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, label))
        want = sorted((joined_words.count(" ", 0, a), joined_words.count(" ", 0, b), label) for a, b, label in kept)
        assert sorted(s[:3] for s in scan(text)[7]) == want
    for _, _, _, gating, pattern in rules:  # the gating words stand in what the rule matches, where it names one
        assert any(w in pattern for w in gating), pattern


def luhn(number):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, good) in kinds.items() for m in re.finditer(p, text or "") if good(m[0])]


def test_op9_base_columns(spark, texts, odd_dir):
    for sf_dir, held in ((SF_DIR, texts), (odd_dir, dict(enumerate(SPECIAL)))):
        for r in result(spark, "op9_personal_data", sf_dir).collect():
            want = base_spans(held[r["doc_id"]])
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            n = Counter(k for k, _, _ in want)
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
            assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line) and r["n_spans"] >= len(want)


def test_op10_columns(spark, con, texts, odd_dir):
    import zlib

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tag = tagger(train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    for r in result(spark, "op10_toxicity").collect():
        score, spans = tag(texts[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and abs(r["score"] - score) < 1e-12 and r["predicted"] == (r["score"] >= 0.3) and len(r["toxic_spans"]) == len(spans)
    assert {r["score"] for r in result(spark, "op10_toxicity", odd_dir).collect()} == {0.5}


def test_odd_and_empty_tables(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("embeddings", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in registry.QUERIES:
        assert result(spark, name, str(tmp_path)).count() == 0, name
    for name in set(registry.QUERIES) - {"op3_source_mixing", "op4_exact_top_k", "op7_nearest_neighbours"}:
        assert result(spark, name, odd_dir).count() == docs.count(), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("__domain", "mix_key", "pii_row", "pii_spans", "key", "base", "more", "left", "__epoch")])
    assert find_personal_data(clash).count() == docs.count() and "key" in find_personal_data(clash).columns
    assert mix(clash, budget_share=1.0, domain=F.lit("d"), weights={}, tokens=words(), max_epochs=1).count() == docs.count()
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert mix(nulls, budget_share=1.0, domain=F.lit("d"), weights={}, tokens=words(), max_epochs=1).count() == docs.count() and find_personal_data(nulls).count() == docs.count()


def plain_mixture(rows, budget_share, weights, max_epochs, seed, floor_epochs=0):
    """(doc_id, epoch) by the tree, in plain Python. Rows are (doc_id, lang, source, tokens)."""
    leaves = defaultdict(list)
    for d, lang, source, n in rows:
        leaves[f"d{int(hashlib.md5(source.encode()).hexdigest()[0], 16) % 4}", lang, source].append((d, n))
    tokens = {leaf: sum(n for _, n in held) for leaf, held in leaves.items()}

    def split(budget, children, level):
        """children: name to capacity."""
        weight = {c: weights.get(level, {}).get(c, 1) for c in children}
        order, share, rest, open_weight = sorted(children, key=lambda c: (children[c] / weight[c], c)), {}, budget, sum(weight.values())
        for i, c in enumerate(order):
            if rest / open_weight >= children[c] / weight[c]:
                share[c], rest, open_weight = children[c], rest - children[c], open_weight - weight[c]
            else:
                exact = {o: rest / open_weight * weight[o] for o in order[i:]}
                share |= {o: int(x) for o, x in exact.items()}
                spare = rest - sum(int(x) for x in exact.values())
                for o in sorted(exact, key=lambda o: (-(exact[o] - int(exact[o])), o))[:spare]:
                    share[o] += 1
                break
        return share

    budgets = {(): int(sum(tokens.values()) * (budget_share - floor_epochs))}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = {}
        for parent, budget in budgets.items():
            children = defaultdict(int)
            for leaf, n in tokens.items():
                if leaf[:depth] == parent:
                    children[leaf[depth]] += n * (max_epochs - floor_epochs)
            below |= {(*parent, c): b for c, b in split(budget, children, level).items()}
        budgets = below
    taken = []
    for leaf, held in leaves.items():
        epochs = (min(budgets[leaf] // tokens[leaf], max_epochs - floor_epochs) if tokens[leaf] else max_epochs - floor_epochs) + floor_epochs
        taken += [(d, e) for d, _ in held for e in range(epochs)]
        left, ahead = budgets[leaf] - (epochs - floor_epochs) * tokens[leaf], 0
        for d, n in sorted(held, key=lambda x: hashlib.md5(f"{seed}:{epochs}:{x[0]}".encode()).hexdigest()):
            if left > 0 and ahead < left:
                taken.append((d, epochs))
            ahead += n
    return taken


def test_pipeline_against_plain_stages(spark, con):
    """All five stages: the chain's own scores, all pairs for near duplicates, base spans by Python, the tree in plain Python, the library's ids."""
    import sentencepiece

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    tag = tagger(train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    clean = {d: r for d, r in rows.items() if tag(r["text"])[0] < 0.3}
    shingles = {}
    for d, r in clean.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        shingles[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
    linked = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    kept = {d: clean[d] for d, r in groups(shingles, linked).items() if d == r}
    stage = spark.createDataFrame([tuple(r.values()) for r in kept.values()], docs.schema)
    spans = {r["doc_id"]: r["s"] for r in find_personal_data(stage).select("doc_id", joined(F.col("pii_spans")).alias("s")).collect()}
    for d, r in kept.items():
        found = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in filter(None, spans[d].split(",")))]
        assert {(k, a, b) for a, b, k in found if k != "id"} == set(base_spans(r["text"]))
        out, at = [], 0
        for a, b, k in sorted(found):
            if a >= at:
                out += [r["text"][at:a], f"<{k.upper()}>"]
            at = max(at, b)
        if found:
            r["text"] = "".join([*out, r["text"][at:]])
            r["n_chars"] = len(r["text"])
    options = {k: v for k, v in corpus_pipeline.PIPELINE_MIXTURE.items() if k != "tokens"}
    taken = plain_mixture([(d, r["lang"], r["source"], len(WORD.findall(r["text"]))) for d, r in kept.items()], **options)
    library = sentencepiece.SentencePieceProcessor(model_file=f"{registry.TOKENIZERS}/piece_bpe_32k.model")
    want = Counter((d, kept[d]["text"], kept[d]["n_chars"], tuple(library.encode(kept[d]["text"]))) for d, _ in taken)
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == [*docs.columns, "piece_ids", "n_pieces", "round_trip"]
    assert Counter((r["doc_id"], r["text"], r["n_chars"], tuple(r["piece_ids"])) for r in got.collect()) == want
