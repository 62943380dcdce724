"""License scans by ordered signature rules.

The rules are the hand-written signatures of ``license_rules``: priority, label, weight, gating words, regex over the normalised words. A rule runs only where a word
starts with one of its gating words. Overlapping detections are resolved in rule order: higher priority first, then longer, then earlier; a detection
whose interval lies inside an accepted one is suppressed. Base phrases are always counted and always keep their label.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.license_rules import signature_rules
from caseflow.llm.shared import fresh_name

#: Base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Every byte that is no word byte becomes a blank, A-Z become a-z.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,stop:long,label:string,weight:double>>"


class Reach:
    """The farthest stop of the intervals that start at or before a place, as intervals are added: a tree of prefix maxima over the possible starts."""

    def __init__(self, starts: list[int]) -> None:
        self.at = {s: i + 1 for i, s in enumerate(sorted(set(starts)))}
        self.most = [-1] * (len(self.at) + 1)

    def add(self, start: int, stop: int) -> None:
        i = self.at[start]
        while i < len(self.most):
            self.most[i] = max(self.most[i], stop)
            i += i & -i

    def of(self, start: int) -> int:
        i, far = self.at[start], -1
        while i:
            far = max(far, self.most[i])
            i &= i - 1
        return far


def license_scanner():
    """A function from a text to a row of COLUMNS; spans count words, the stop exclusive."""
    by_word, rules = defaultdict(list), signature_rules()
    for order, (_, _, _, words, _) in enumerate(rules):
        for word in words:
            by_word[word.encode()].append(order)
    compiled: dict[int, re.Pattern] = {}
    base = [(f" {phrase} ".encode(), label) for phrase, label in BASE_PHRASES.items()]
    # a gating word starts a word; of gating words that start alike the longest is found, so it stands for the shorter ones too
    gates = re.compile(rb" (" + b"|".join(sorted(by_word, key=len, reverse=True)) + rb")")
    opened = {word: sorted({o for other, orders in by_word.items() if word.startswith(other) for o in orders}) for word in by_word}

    def scan(text: str | None) -> tuple:
        words = text.encode().translate(_FOLD).split() if text else []
        joined = b" " + b" ".join(words) + b" "
        starts, base_labels = [], set()
        for phrase, label in base:
            at = joined.find(phrase)
            while at >= 0:
                starts.append(joined.count(b" ", 0, at))
                base_labels.add(label)
                at = joined.find(phrase, at + 1)
        found = []
        for order in sorted({o for word in set(gates.findall(joined)) for o in opened[word]}):
            if order not in compiled:
                compiled[order] = re.compile(f" (?:{rules[order][4]})(?= )".encode())
            priority, label, weight = rules[order][:3]
            found += [(-priority, m.start() - m.end(), m.start(), order, m.end(), label, weight) for m in compiled[order].finditer(joined)]
        kept, reach = [], Reach([x[2] for x in found])
        for _, _, start, _, stop, label, weight in sorted(found):
            if reach.of(start) < stop:
                kept.append((start, stop, label, weight))
                reach.add(start, stop)
        spans = sorted((first := joined.count(b" ", 0, a), first + joined.count(b" ", a, b), label, weight) for a, b, label, weight in kept)
        missed = 1.0
        for *_, weight in spans:
            missed *= 1 - min(weight, 0.999)
        score = 1.0 if base_labels else 1 - missed
        labels = ",".join(sorted(base_labels | {x[2] for x in spans}))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), labels, score, spans

    return scan


def scan_licenses(docs: DataFrame, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the columns of COLUMNS to ``docs``.

    Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased. Null and empty texts have no words,
    no labels (empty strings) and score 0; repeated rows are scanned each; an empty table stays empty. Columns of
    the same names are replaced unless a ``prefix`` is given.
    """

    @F.pandas_udf(COLUMNS)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scan, names = license_scanner(), [x.split()[0] for x in COLUMNS.split(", ")]
        for texts in batches:
            rows = pd.DataFrame([scan(t) for t in texts], columns=names)
            spans = [[{"start": a, "stop": b, "label": c, "weight": d} for a, b, c, d in x] for x in rows["spans"]]
            yield rows.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64", "n_base": "int64"}).assign(spans=pd.Series(spans, dtype="object"))

    found = fresh_name(docs, "license_scan")
    out = docs.withColumn(found, scanned(F.col(text_col)))
    return out.withColumns({f"{prefix}{c.split()[0]}": F.col(f"{found}.{c.split()[0]}") for c in COLUMNS.split(", ")}).drop(found)
