"""Byte-level BPE by a global shuffle of distinct words.

Pre-tokens are merged alone, so each distinct one needs encoding once in the whole corpus, and its ids go back to every place it stands at:

1. A task explodes its documents into pre-tokens. Positions stay where they are, as numbers of the block's own list of words (a block is some million pre-tokens of one task); only
   that list of distinct words leaves it, packed by hash bucket. Blocks are a table bucketed by block, so that they are not shuffled later.
2. Words meet by bucket. Each distinct word is encoded once by the library, and its ids go back to the blocks that asked.
3. A block joins the ids of its words and puts every document together again by position.

What a block has is bounded by ``BLOCK_WORDS`` or one text, whatever the corpus; a word that stands everywhere is one entry of each block, so no key is hot.
Decoding joins the table of token bytes, which is as long as the vocabulary and therefore broadcast.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import checkpoint_root, fresh_name, per_worker
from caseflow.llm.token_counts import pre_token_finders

#: Pre-tokens after which a block is closed.
BLOCK_WORDS = 1 << 21
#: Pre-tokens of the documents of a block that are put together at once.
SLICE_WORDS = 1 << 17
#: Distinct words a task remembers with their ids; beyond it the memory starts anew.
MEMORY_WORDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a line each, in base64."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class _Slots(dict):
    """Numbers for words in the order they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**31 as all their low bytes, then all the next ones ...: the high ones are mostly zero."""
    return np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes | memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _pack(*parts: bytes) -> bytes:
    return zlib.compress(np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts), 1)


def _unpack(data: bytes, n: int) -> list[memoryview]:
    raw = memoryview(zlib.decompress(data))
    ends = 8 * n + np.cumsum(np.frombuffer(raw[: 8 * n], "<u8").astype(np.int64))
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _ragged(values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``offsets``, end to end."""
    ahead = np.cumsum(sizes)
    return values[np.repeat(offsets - (ahead - sizes), sizes) + np.arange(int(ahead[-1]) if len(ahead) else 0)]


def explode_words(rows: DataFrame, buckets: int) -> DataFrame:
    """Blocks of ``rows`` (id, text): the ids and numbers of pre-tokens of the documents, the number of the word at each position, and the distinct words by bucket."""
    kind = rows.schema[0].dataType.simpleString()

    def packed(words: list[bytes]) -> list[dict]:
        of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(of, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(words) else []
        return [{"bucket": int(of[p[0]]), "words": _pack(_planes(np.diff(p, prepend=0)), _planes([len(words[i]) for i in p.tolist()]), b"".join([words[i] for i in p.tolist()]))} for p in parts]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basic, general = per_worker(("byte-bpe-finders",), pre_token_finders)
        task, made = TaskContext.get().partitionId() << 32, 0
        ids, slots, names, held = [], [], _Slots(), 0
        for batch in batches:
            begin = 0
            for at, text in enumerate(batch.column(1), 1):
                text = text.as_py() or ""
                words = (basic if text.isascii() or max(text) <= "￿" else general)(text)
                slots.append(np.fromiter(map(names.__getitem__, words), np.uint32, len(words)))
                held += len(words)
                if held >= BLOCK_WORDS:
                    ids.append(batch.column(0).slice(begin, at - begin))
                    yield block(task + made, ids, slots, names)
                    ids, slots, names, held, made, begin = [], [], _Slots(), 0, made + 1, at
            ids.append(batch.column(0).slice(begin))
        if slots:
            yield block(task + made, ids, slots, names)

    def block(number: int, ids: list, slots: list, names: dict) -> pa.RecordBatch:
        own = pa.chunked_array(ids).combine_chunks()
        columns = [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
            pa.array([[len(s) for s in slots]], pa.list_(pa.int32())),
            pa.array([_pack(_planes(np.concatenate(slots)))], pa.binary()),
            pa.array([packed([w.encode() for w in names])], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "slots", "parts"])

    return rows.mapInArrow(explode, f"block long, ids array<{kind}>, sizes array<int>, slots binary, parts array<struct<bucket:int,words:binary>>")


def encode_words(parts: DataFrame, ranks_path: str) -> DataFrame:
    """(block, tokens) of (block, bucket, words), sorted by bucket in each partition: each distinct word goes through the library once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # one match for each word: it is a pre-token already
        library = per_worker(("byte-bpe", ranks_path), lambda: tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks_path), special_tokens={}))
        known, bucket = {}, None
        for batch in batches:
            out = []
            for own, data in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if own != bucket or len(known) > MEMORY_WORDS:
                    known, bucket = {}, own
                slots, lengths, text = _unpack(data, 3)
                ends = np.cumsum(_from_planes(lengths)).tolist()
                text, found = bytes(text), []
                for a, b in zip([0, *ends], ends):
                    word = text[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = library.encode_ordinary(word.decode())
                    found.append(ids)
                out.append(_pack(bytes(slots), _planes([len(x) for x in found]), _planes([i for x in found for i in x])))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], names=["block", "tokens"])

    return parts.mapInArrow(encode, "block long, tokens binary")


def assemble(blocks: DataFrame, id_type: str, name: str) -> DataFrame:
    """(id, token_ids) of every document of blocks that have been joined with the ids of their words (``tokens``, one entry for each bucket)."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sizes, slots, tokens in zip(*(batch.column(c) for c in ("ids", "sizes", "slots", "tokens")), strict=True):
                slots, sizes = _from_planes(_unpack(slots.as_py(), 1)[0]), sizes.values.to_numpy()
                parts = [[_from_planes(x) for x in _unpack(t.as_py(), 3)] for t in tokens.values] if tokens.is_valid else []
                of = np.concatenate([np.cumsum(p[0]) for p in parts] or [np.zeros(0, np.int64)])
                count, flat = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int32)]) for k in (1, 2))
                del parts
                order = np.argsort(of)
                if not np.array_equal(of[order], np.arange(slots.max() + 1 if len(slots) else 0)):
                    raise ValueError("a block misses the ids of some of its words")
                begin = (np.cumsum(count) - count)[order]
                count = count[order]
                ends = np.cumsum(sizes, dtype=np.int64)
                first = 0
                while first < len(sizes):
                    ahead = int(ends[first] - sizes[first])
                    last = max(first + 1, int(np.searchsorted(ends, ahead + SLICE_WORDS, side="right")))
                    some = slots[ahead : ends[last - 1]]
                    each = count[some]
                    upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], ends[first:last] - ahead])]
                    found = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(_ragged(flat, begin[some], each)))
                    yield pa.RecordBatch.from_arrays([own.values.slice(first, last - first), found], names=[name, "token_ids"])
                    first = last

    return blocks.select("ids", "sizes", "slots", "tokens").mapInArrow(put_together, f"{name} {id_type}, token_ids array<int>")


def encode_documents(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, token_ids) of each row of ``docs``: the ids that the library gives for the text without special tokens.

    Null and empty texts have no ids. Each row is encoded as it is, so ids may be null, of any type and repeated; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"caseflow_blocks_{uuid.uuid4().hex}"
    explode_words(rows, 4 * n).write.bucketBy(n, "block").options(path=f"{checkpoint_root(spark)}/{name}", compression="zstd").saveAsTable(name)
    blocks = spark.table(name)
    asked = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.bucket", "p.words").repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = encode_words(asked, ranks_path).repartition(n, "block").groupBy("block").agg(F.collect_list("tokens").alias("tokens"))
    joined = blocks.drop("parts").join(answers.hint("shuffle_hash"), "block", "left")
    return assemble(joined, rows.schema[0].dataType.simpleString(), id_col)


def token_bytes(spark: SparkSession, ranks_path: str) -> DataFrame:
    """The vocabulary as a table (token_id, bytes)."""
    return spark.createDataFrame([(rank, token) for token, rank in read_ranks(ranks_path).items()], "token_id int, bytes binary")


def decode_documents(encoded: DataFrame, ranks_path: str, *, ids_col: str = "token_ids", out_col: str = "decoded", packed_col: str = "packed_ids") -> DataFrame:
    """Adds the bytes of a column of ids, and the ids packed as little-endian unsigned 32-bit numbers; columns of these names are replaced.

    Null ids give null, no ids give no bytes; null or unknown ids inside give nothing among the bytes, and null ones nothing among the packed ids.
    """
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast({r["token_id"]: bytes(r["bytes"]) for r in token_bytes(spark, ranks_path).toLocalIterator()})

    @F.pandas_udf("decoded binary, packed binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = table.value
        for rows in batches:
            out, packed = [], []
            for ids in rows:
                ids = ids if ids is None or ids.dtype == np.int32 else np.array([i for i in ids if i is not None and i == i], np.int32)
                packed.append(None if ids is None else ids.astype("<u4").tobytes())
                try:
                    out.append(None if ids is None else b"".join(map(of.__getitem__, ids.tolist())))
                except KeyError:
                    out.append(b"".join([of.get(i, b"") for i in ids.tolist()]))
            yield pd.DataFrame({"decoded": pd.Series(out, dtype="object"), "packed": pd.Series(packed, dtype="object")})

    found = fresh_name(encoded, "__decoded")
    out = encoded.withColumn(found, decoded(F.col(ids_col)))
    return out.withColumns({out_col: F.col(f"{found}.decoded"), packed_col: F.col(f"{found}.packed")}).drop(found)
