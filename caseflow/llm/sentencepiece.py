"""SentencePiece encoding and decoding by a streaming Viterbi trellis.

The trellis runs over character boundaries. An edge is a piece that ends at a boundary; a boundary keeps one
backpointer. Only the last ``longest piece`` boundaries are open, and when the paths from all open boundaries meet in one boundary,
the ids before it are final and leave the window, so that memory does not grow with the text.

For a unigram model an edge costs its score and the best path wins. The public vocabulary here is a BPE model, whose ids follow from merge
order and not from score sums, so adding scores would give other ids than the library. There an edge is open only if its piece is what
merging gives for its own string and if merging the previous piece with it leaves both as they are; the path that
survives is the library's encoding. Pair verdicts are remembered.

Where no piece crosses from one kind of character to another, all paths converge: before a run of blanks, and here also between letters
and other characters. ``chunk_pattern`` proves this for the vocabulary; chunks between such boundaries are looked up before the trellis runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shared import fresh_name, per_worker

BLANK = "▁"
#: Encoded chunks of a generation and pair verdicts kept by a worker; beyond it the memory starts anew.
CACHE_ROWS, PAIR_ROWS = 200_000, 250_000
#: Documents encoded before their ids leave the task.
SLICE_ROWS = 128


def chunk_pattern(pieces) -> re.Pattern:
    """The finest cut that no piece crosses: blanks with the letters or with the other characters after them, blanks with
    all that follows, or no cut. Characters that count as word characters without being letters or digits stand with the others."""
    odd = "".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
    letter = f"[^\\W\\d_{re.escape(odd)}]"
    for pattern in (f"{BLANK}*{letter}+|{BLANK}*(?:(?!{letter}|{BLANK}).)+|{BLANK}+", f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"):
        found = re.compile(pattern, re.DOTALL)
        if all(found.findall(p) == [p] for p in pieces):
            return found
    return re.compile(".+", re.DOTALL)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, read by the public library; nothing else of it is used."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.id))
        self.chunks = chunk_pattern(self.id)


def merge_pieces(text: str, score: dict[str, float]) -> list[str]:
    """Merges characters by score, ties leftmost: the definition of a BPE encoding, used for single pieces and pairs of them."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class StreamingViterbi:
    """Encodes chunks; ``bpe`` says which edges are open and how paths are compared.

    A backpointer is the id of the piece that ends at a boundary; a character that no piece holds has the negative id
    ``-2 - code point``, the start of the text has -1.
    """

    def __init__(self, vocabulary: Vocabulary, *, bpe: bool = True) -> None:
        self.v, self.bpe = vocabulary, bpe
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.lowest = min(vocabulary.score.values(), default=0.0) - 10  # of a character that no piece holds
        self.endings: dict = {}  # pieces read backwards: for each character the id of the piece that it completes, if any, and the characters before
        for piece, i in vocabulary.id.items():
            node = self.endings
            for c in reversed(piece):
                entry = node.setdefault(c, [None, {}])
                node = entry[1]
            entry[0] = i
        self.endings_of_none: dict = {}
        self.widest = 0

    def _open(self, left: int, piece: int) -> bool:
        """Whether ``piece`` may follow ``left`` in a BPE encoding."""
        if piece < 0:  # nothing merges with it
            return True
        text = self.v.text
        if piece not in self.whole:
            self.whole[piece] = len(merge_pieces(text[piece], self.v.score)) == 1
        if not self.whole[piece] or left < 0:
            return self.whole[piece]
        if len(self.pairs) >= PAIR_ROWS:
            self.pairs.clear()
        found = self.pairs[left << 20 | piece] = merge_pieces(text[left] + text[piece], self.v.score) == [text[left], text[piece]]
        return found

    def _ids(self, piece: int) -> list[int]:
        if piece >= 0:
            return [piece]
        return [self.v.byte[b] for b in chr(-2 - piece).encode()] if self.v.byte else [self.v.unknown]

    def pieces(self, text: str) -> Iterator[int]:
        """The pieces of ``text``, each as soon as it is final.

        The window holds the boundaries from the last one on which all paths met. When it is wider than the longest piece, the open boundaries (those a further piece can start from) are
        followed back; where they meet, what is before is final and leaves the window, but for the piece that ends there, which still decides which pieces may follow.
        """
        bpe, root, longest, verdict = self.bpe, self.endings, self.v.longest, self.pairs.get
        back, begin, total, done = [-1], [0], [0.0], 0  # of the boundaries from ``done`` on: the piece that ends there, where it starts, the path's score
        for end in range(1, len(text) + 1):
            node, start, best, origin = root, end, None, 0
            while start > done:
                start -= 1
                entry = node.get(text[start])
                if entry is None:
                    if start < end - 1:
                        break
                    node, piece = self.endings_of_none, -2 - ord(text[start])
                else:
                    piece, node = entry
                    if piece is None:
                        continue
                left = back[start - done]
                if left is None:
                    continue
                if bpe:  # one piece at most is open at a boundary
                    fits = verdict(left << 20 | piece) if left >= 0 <= piece else None
                    if fits or fits is None and self._open(left, piece):
                        best, origin = piece, start
                        break
                else:
                    path = total[start - done] + (self.v.score[self.v.text[piece]] if piece >= 0 else self.lowest)
                    if best is None or path > score:
                        best, origin, score = piece, start, path
            back.append(best)
            begin.append(origin)
            if not bpe:
                total.append(score)
            if end - done > longest:
                self.widest = max(self.widest, end - done)
                meeting = self._convergence(back, begin, done, end)
                if meeting > done:
                    yield from self._path(back, begin, done, meeting)
                    back, begin, total = (kept[meeting - done :] for kept in (back, begin, total))
                    done = meeting
        yield from self._path(back, begin, done, len(text))

    def _convergence(self, back: list, begin: list, done: int, end: int) -> int:
        """The last boundary that the paths of all open boundaries share."""
        heads = {k for k in range(max(done, end - self.v.longest + 1), end + 1) if back[k - done] is not None}
        while len(heads) > 1:
            last = max(heads)
            heads.discard(last)
            heads.add(begin[last - done])
        return heads.pop() if heads else done

    @staticmethod
    def _path(back: list, begin: list, done: int, stop: int) -> list[int]:
        found, at = [], stop
        while at > done:
            found.append(back[at - done])
            at = begin[at - done]
        return found[::-1]

    def encode(self, text: str) -> tuple[int, ...]:
        found = tuple(self.pieces(text))
        return found if min(found, default=0) >= 0 else tuple(i for piece in found for i in self._ids(piece))


class Encoder(dict):
    """Chunks to ids; a missing chunk goes through the trellis. The last two generations of chunks are remembered, each within a bound."""

    def __init__(self, model_path: str) -> None:
        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}
        self.vocabulary = Vocabulary(model_path)
        self.trellis = StreamingViterbi(self.vocabulary)

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.trellis.encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE_ROWS:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text: a blank goes in front, blanks are written as the blank mark, nothing else is normalised."""
        if not text:
            return []
        return [i for ids in map(self.__getitem__, self.vocabulary.chunks.findall(BLANK + text.replace(" ", BLANK))) for i in ids]


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of a sequence of ids. Byte pieces are joined to characters; bytes that form none become U+FFFD."""
    out, pending = [], bytearray()
    for i in ids:
        if i in vocabulary.value:
            pending.append(vocabulary.value[i])
            continue
        if pending:
            out.append(pending.decode(errors="replace"))
            pending.clear()
        out.append(vocabulary.text.get(i, ""))
    if pending:
        out.append(pending.decode(errors="replace"))
    return "".join(out).replace(BLANK, " ").removeprefix(" ")


def encode_documents(docs: DataFrame, model_path: str, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``piece_ids`` (array of int), ``n_pieces`` and ``round_trip`` to ``docs``.

    ``round_trip`` says that the decoded ids give the text again (a blank mark U+2581 in a text comes back as a blank, as in the
    library, so it counts as one). Null and empty texts have no ids and make the round trip (a null text counts as empty). Repeated rows are encoded each;
    an empty table stays empty; columns of these names are replaced unless a ``prefix`` is given.
    """

    @F.pandas_udf("struct<ids:array<int>,round_trip:boolean>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encoder = per_worker(("sentencepiece", model_path), lambda: Encoder(model_path))
        words = {}  # decoded text of a run of pieces is the pieces' concatenation, unless there are byte pieces among them
        words.update({i: p.replace(BLANK, " ") for i, p in encoder.vocabulary.text.items()})
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows, same = [], []
                for text in batch.iloc[at : at + SLICE_ROWS]:
                    text = text or ""
                    ids = encoder.encode(text)
                    try:
                        back = "".join(map(words.__getitem__, ids)).removeprefix(" ")
                    except KeyError:
                        back = decode(ids, encoder.vocabulary)
                    rows.append(np.array(ids, dtype=np.int32))
                    same.append(back == text or back == text.replace(BLANK, " "))
                yield pd.DataFrame({"ids": pd.Series(rows, dtype="object"), "round_trip": pd.Series(same, dtype="bool")})

    found = fresh_name(docs, "__sentencepiece")
    out = docs.withColumn(found, encoded(F.col(text_col)))
    return out.withColumns(
        {
            f"{prefix}piece_ids": F.col(f"{found}.ids"),
            f"{prefix}n_pieces": F.size(f"{found}.ids").cast("long"),
            f"{prefix}round_trip": F.col(f"{found}.round_trip"),
        }
    ).drop(found)


def decode_documents(encoded: DataFrame, model_path: str, *, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids; null ids give a null text, no ids an empty one, null or unknown ids inside nothing."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = per_worker(("sentencepiece-vocabulary", model_path), lambda: Vocabulary(model_path))
        for rows in batches:
            yield pd.Series([None if r is None else decode([i for i in r if i is not None and i == i], vocabulary) for r in rows], dtype="object")

    return encoded.withColumn(out_col, decoded(F.col(ids_col)))
