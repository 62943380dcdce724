"""Substring dedup with suffix automata of reference shards.

The reference is the corpus itself: a word goes if a window of ``window`` words that covers it starts earlier somewhere else. Automata of the
whole corpus would have to be broadcast to every task and would grow with the corpus, so shards are cut by content and each automaton stays in the task that streams its shard:

1. Every window names an anchor, the ``gram``-word sequence in it with the least hash. Equal windows have equal anchors, so they
   meet in one shard. Consecutive windows with the same anchor occurrence make a run of at most ``2 * window - gram`` words.
2. Anchors seen once are done with. Runs seen again word for word (equal in a 128-bit BLAKE2 digest of their words, within one anchor) are repeats as a whole and
   are found by an aggregation, which combines before the shuffle however many copies there are, so that each automaton meets a run once.
3. What remains are different runs around the same anchor. Each shard's runs are streamed in order of their place: matching statistics against the
   automaton of the runs before mark windows that reach the threshold, then the run enters the automaton. The automata compare the words themselves.
4. Anchors with more than ``SHARD_RUNS`` different runs (a short line that stands everywhere) would make one large automaton. Their shards are cut finer: a window
   holds at least half of the free words on the left of the anchor, or more than half on its right, and those words join the key. What is crowded even then (a line
   nearly as long as a window) has its windows compared by a digest in an aggregation, which is exact too and spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shared import materialize, release_shuffles

#: Different runs of an anchor that one automaton takes.
SHARD_RUNS = 512
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def _spans_hash(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hashes of values[start:stop], all at once."""
    up, down = powers.to(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return _mix((sums[stops] - sums[starts]) * down[starts])


def gram_hashes(parts: list[bytes], gram: int, letters: Powers, words: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the ``gram``-word sequences."""
    joined = np.frombuffer(b" ".join(parts) + b" ", np.uint8).astype(np.uint64)
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    word = _spans_hash(joined + np.uint64(1), np.concatenate([[0], stops[:-1]]), stops, letters)
    at = np.arange(len(parts) - gram + 1)
    return word, _spans_hash(word, at, at + gram, words)


def finer_shards(words: list[str], window: int, gram: int, letters: Powers, powers: Powers) -> Iterator[tuple[str, int, list[str]]]:
    """The one or two parts of a run by the words next to its anchor: context, first window of the part, its words."""
    per_window, left = window - gram + 1, (window - gram) // 2
    at = int(gram_hashes([w.encode() for w in words[:window]], gram, letters, powers)[1][:per_window].argmin())
    last = len(words) - window
    if at >= left:  # windows that hold ``left`` words before the anchor
        yield "l " + " ".join(words[at - left : at]), 0, words[: min(last, at - left) + window]
    first = max(0, at - left + 1)
    if first <= last:  # windows that hold more than the rest after it
        yield "r " + " ".join(words[at + gram : at + gram + window - gram - left + 1]), first, words[first:]


def document_anchors(parts: list[bytes], window: int, gram: int, letters: Powers, words: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the runs of a text, their places, first windows and numbers of windows. Anchors only decide which runs meet, so a fast hash does for them."""
    n = len(parts)
    _, grams = gram_hashes(parts, gram, letters, words)
    per_window = window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, per_window).argmin(axis=1) + np.arange(n - window + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    count = np.diff(np.concatenate([first, [len(least)]]))
    return grams[least[first]], least[first], first, count


def document_runs(text: str, window: int, gram: int, letters: Powers, words: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Anchors, run digests (two numbers each), first windows and numbers of windows of the runs of a text; None below one window.

    Runs with one digest count as equal, so that one is cryptographic: it holds the words and the anchor's place.
    """
    parts = text.encode().split()
    n = len(parts)
    if n < window:
        return None
    found, anchor, first, count = document_anchors(parts, window, gram, letters, words)
    joined, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    begin = np.concatenate([[0], ends[:-1]])[first].tolist()
    stop = (ends[first + count + window - 2] - 1).tolist()
    digests = b"".join([blake2b(joined[a:b], digest_size=16, salt=k.to_bytes(8, "little")).digest() for a, b, k in zip(begin, stop, (anchor - first).tolist(), strict=True)])
    return found, np.frombuffer(digests, np.int64).reshape(-1, 2), first, count


def anchors_of(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The anchor of every run of the texts of ``docs`` (doc_id, text), without the runs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, words = Powers(BASE), Powers(WORD_BASE)
        for batch in batches:
            texts = (text.as_py().encode().split() for text in batch.column(0))
            found = [document_anchors(parts, window, gram, letters, words)[0] for parts in texts if len(parts) >= window]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["anchor"])

    return docs.select("text").mapInArrow(find, "anchor long")


def anchored_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, run, run2, doc_id, start, n) for every run of the texts of ``docs`` (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, words = Powers(BASE), Powers(WORD_BASE)
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = document_runs(text.as_py(), window, gram, letters, words)
                if runs:
                    ids.append(np.full(len(runs[0]), doc_id, np.int64))
                    found.append(runs)
            if found:
                anchor, run, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
                arrays = [anchor.view(np.int64), run[:, 0].copy(), run[:, 1].copy(), np.concatenate(ids), first.astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["anchor", "run", "run2", "doc_id", "start", "n"])

    return docs.mapInArrow(cut, "anchor long, run long, run2 long, doc_id long, start int, n int")


class SuffixAutomaton:
    """The suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def matching(self, words) -> Iterator[int]:
        """Matching statistics: for each position, the longest sequence ending there that is in the automaton."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield length


def _stream_shards(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Runs sorted by shard and place; gives the maximal repeated spans of words (doc_id, start, stop)."""
    shard, automaton, place = None, None, None
    for batch in batches:
        out = []
        for a, context, doc_id, start, words in zip(batch["anchor"], batch["context"], batch["doc_id"], batch["start"], batch["words"], strict=True):
            if (a, context) != shard:
                shard, automaton, place = (a, context), SuffixAutomaton(), None
            if (doc_id, start) == place:  # a repeated row brings its runs once more
                continue
            place = doc_id, start
            words = list(words)
            begin = stop = None
            for at, length in enumerate(automaton.matching(words)):
                if length >= window:
                    if begin is None:
                        begin = at - length + 1
                    elif at - window + 1 > stop:
                        out.append((doc_id, start + begin, start + stop))
                        begin = at - length + 1
                    stop = at + 1
            if begin is not None:
                out.append((doc_id, start + begin, start + stop))
            automaton.add(words)
        yield pd.DataFrame(out, columns=["doc_id", "start", "stop"]).astype({"doc_id": "int64", "start": "int64", "stop": "int64"})


def repeated_spans(docs: DataFrame, *, window: int = 20, gram: int = 8) -> DataFrame:
    """(doc_id, start, stop): spans of words, each covered by windows that start earlier elsewhere. ``docs`` has doc_id (long, not null) and text (not null)."""
    spark = docs.sparkSession
    runs = anchored_runs(docs, window, gram)
    anchors = materialize(anchors_of(docs, window, gram).groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1").select("anchor"), "substrings-anchors")
    release_shuffles(spark)
    suspects = materialize(runs.join(anchors, "anchor"), "substrings-suspects")
    release_shuffles(spark)
    place, run = F.struct("doc_id", "start"), ["anchor", "run", "run2"]
    distinct = materialize(suspects.groupBy(*run).agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")), "substrings-runs")
    # whole runs that stand earlier
    copied = distinct.where("copies > 1").select(*run, "first")
    again = suspects.join(copied, run).where(place != F.col("first")).select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") + window - 1).cast("long").alias("stop"))
    # different runs of one anchor: their words, from the documents that hold their first places
    crowd = distinct.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1").select("anchor", (F.col("runs") > SHARD_RUNS).alias("crowded"))
    mixed = distinct.join(crowd, "anchor").select("anchor", "crowded", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "n")
    wanted = materialize(mixed.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "crowded", "start", "n")).alias("wanted")), "substrings-wanted")
    release_shuffles(spark)

    def cut_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, powers = Powers(BASE), Powers(WORD_BASE)
        for batch in batches:
            out = []
            for doc_id, text, asked in zip(batch["doc_id"], batch["text"], batch["wanted"], strict=True):
                parts = text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [w.decode() for w in text.encode().split()]
                for x in asked:
                    run = parts[x["start"] : x["start"] + x["n"] + window - 1]
                    shards = finer_shards(run, window, gram, letters, powers) if x["crowded"] else [("", 0, run)]
                    out += [(x["anchor"], context, x["crowded"], doc_id, x["start"] + first, some) for context, first, some in shards]
            yield pd.DataFrame(out, columns=["anchor", "context", "crowded", "doc_id", "start", "words"])

    worded = materialize(docs.join(wanted, "doc_id").mapInPandas(cut_words, "anchor long, context string, crowded boolean, doc_id long, start int, words array<string>"), "substrings-words")
    release_shuffles(spark)
    keys = ["anchor", "context"]
    finer = worded.where("crowded").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, (F.col("n") > SHARD_RUNS).alias("still"))
    finer = materialize(worded.where("crowded").join(finer, keys), "substrings-finer")
    shards = worded.where("not crowded").select(*keys, "doc_id", "start", "words").unionByName(finer.where("not still").select(*keys, "doc_id", "start", "words"))
    shards = shards.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "start")
    matched = shards.mapInPandas(lambda batches: _stream_shards(batches, window), "doc_id long, start long, stop long")
    windows = finer.where("still").select("doc_id", "start", "words", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("i"))
    windows = windows.select("doc_id", (F.col("start") + F.col("i")).cast("long").alias("start"), F.sha2(F.array_join(F.slice("words", F.col("i") + 1, window), " "), 256).alias("digest"))
    earliest = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    crowded = windows.join(earliest, "digest").where(place != F.col("first")).select("doc_id", "start", (F.col("start") + window).alias("stop"))
    return again.unionByName(matched).unionByName(crowded)


def remove_repeats(docs: DataFrame, *, window: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed): each row's words without those covered by an earlier repeated window.

    Words are runs of anything but ASCII white space and are kept as they are, joined by one blank. ``removed`` lists the removed spans of words. Earlier means
    smaller id, or the same id and an earlier start; windows are judged on the input. Null and empty texts have no words; texts below one window lose nothing. Ids are whole numbers, each
    for one text: rows that repeat an id and its text count as one document and get the same result each; rows without an id keep all their words and are no reference.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(rows.where("doc_id is not null"), window=window, gram=gram)
    per_doc = materialize(spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "substrings-spans")
    release_shuffles(docs.sparkSession)

    @F.pandas_udf("n_words long, n_removed long, kept_text string, removed array<struct<start:long,stop:long>>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, spans, strict=True):
            parts = text.encode().split()
            if gone is None or not len(gone):
                out.append((len(parts), 0, b" ".join(parts).decode(), []))
                continue
            edge = np.zeros(len(parts) + 1, np.int64)
            np.add.at(edge, [min(g["start"], len(parts)) for g in gone], 1)
            np.add.at(edge, [min(g["stop"], len(parts)) for g in gone], -1)
            dead = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[0], dead, [0]]).astype(np.int8))).tolist()
            removed = [{"start": a, "stop": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
            out.append((len(parts), int(dead.sum()), b" ".join([p for p, d in zip(parts, dead.tolist(), strict=True) if not d]).decode(), removed))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "removed"])

    return rows.join(per_doc, "doc_id", "left").select("doc_id", cut("text", "spans").alias("r")).select("doc_id", "r.*")
