"""Token ids of a corpus under a public byte-level BPE vocabulary.

Texts are split into words by Spark. Each block of documents keeps its words as
positions in its own list of distinct words; the lists of all blocks meet in one
table of distinct words, each of which is encoded once. The ids are joined back
to the lists and laid out by position.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.runtime import Scratch

#: Fixed value: the pattern that splits a text into words before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: So many blocks, a few MB each, are laid out by one task.
_TASK_BLOCKS = 2

_BLOCKS = "block bigint, doc_ids array<bigint>, lens array<int>, codes binary, words array<{}>"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a vocabulary file: in ``folder``, else in the installed package of public tokenizers."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=WORDS, mergeable_ranks=_ranks(path), special_tokens={})


def _split(documents: DataFrame) -> DataFrame:
    """(doc_id, w): the words of every text."""
    pattern = "(?U)" + WORDS
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(f"regexp_extract_all(coalesce(text, ''), r\"{pattern}\", 0)").alias("w"))


def _blocks(lists: DataFrame, kind: str, block_words: int) -> DataFrame:
    """Blocks of rows (doc_id, w): the positions of their elements in the block's own list of distinct ones."""
    of = {"string": pa.string(), "int": pa.int32()}[kind]

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        lens = pc.fill_null(pc.list_value_length(t["w"]), 0).cast(pa.int32()).combine_chunks()
        flat = pa.chunked_array([c.flatten() for c in t["w"].chunks], of).combine_chunks()
        coded = pc.dictionary_encode(flat)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        one = lambda a, kind: pa.array([a], pa.list_(kind))
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), whole(t["doc_id"].combine_chunks()), whole(lens), pa.array([codes.tobytes()], pa.binary()), whole(coded.dictionary)], ["block", "doc_ids", "lens", "codes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, number = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            at = 0
            lens = np.cumsum(pc.fill_null(pc.list_value_length(b["w"]), 0).to_numpy(zero_copy_only=False))
            while at < b.num_rows:
                done = lens[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(lens, done + block_words - words, "right")))
                held.append(b.slice(at, end - at))
                words += int(lens[end - 1] - done)
                at = end
                if words >= block_words or at < b.num_rows:
                    yield block(held, number)
                    held, words, number = [], 0, number + 1
        if held:
            yield block(held, number)

    return lists.mapInArrow(run, _BLOCKS.format(kind))


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["word"], pa.array([encode(w) for w in b["word"].to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _by_code(words: pa.Table, column: str) -> pa.Array:
    order = np.argsort(words["code"].to_numpy(), kind="stable")
    return words[column].combine_chunks().take(pa.array(order))


def _lay_ids(words: pa.Table, blocks: pa.Table) -> pa.Table:
    if not blocks.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    doc_ids, lens = blocks["doc_ids"].combine_chunks().flatten(), blocks["lens"].combine_chunks().flatten().to_numpy()
    codes = np.frombuffer(blocks["codes"][0].as_py(), np.int32)
    if not len(codes):
        return pa.table({"doc_id": doc_ids, "ids": pa.array([[]] * len(doc_ids), pa.list_(pa.int32()))})
    ids = _by_code(words, "ids").take(pa.array(codes))
    ends = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())][np.r_[0, np.cumsum(lens)]]
    return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.flatten())})


def _lay_counts(words: pa.Table, blocks: pa.Table) -> pa.Table:
    if not blocks.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})
    doc_ids, lens = blocks["doc_ids"].combine_chunks().flatten(), blocks["lens"].combine_chunks().flatten().to_numpy()
    codes = np.frombuffer(blocks["codes"][0].as_py(), np.int32)
    n = _by_code(words, "n").to_numpy().astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(lens)]]
    return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(np.diff(ends), pa.int64())})


def _lay_out(coded: DataFrame, blocks: DataFrame, count: int, lay, schema: str) -> DataFrame:
    """``lay`` of the elements (of, code, ...) of each block and the block, over as many tasks as there are blocks for."""
    tasks = max(1, -(-count // _TASK_BLOCKS))
    there = blocks.select("block", "doc_ids", "lens", "codes").repartition(tasks, "block")
    return coded.repartition(tasks, "of").groupBy("of").cogroup(there.groupBy("block")).applyInArrow(lay, schema)


def _by_words(documents: DataFrame, path: str, block_words: int, counts: bool) -> DataFrame:
    if not path.endswith(".tiktoken"):
        raise ValueError(f"{path} is no file of byte-level ranks")
    scratch = Scratch(documents.sparkSession, "tokens")
    blocks, count = scratch.write_counted(_blocks(_split(documents), "string", block_words))
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    table = _encode_words(words.select("word").distinct(), path)
    if counts:
        table = table.select("word", F.size("ids").alias("n"))
    coded = words.join(table, "word").drop("word").withColumnRenamed("block", "of")
    lay, schema = (_lay_counts, "doc_id bigint, n_tokens bigint") if counts else (_lay_ids, "doc_id bigint, ids array<int>")
    return _lay_out(coded.withColumn("of", F.col("of") + 0), blocks, count, lay, schema)


def encode_corpus(documents: DataFrame, path: str, block_words: int = 400_000) -> DataFrame:
    """(doc_id, ids) of every row of ``documents`` (doc_id, text), by the ranks in the file ``path``.

    No special tokens: their names in a text are ordinary text. Null and empty texts have an empty list; blank texts
    have the ids of their white space. A row comes out for each row that goes in, repeats and null doc_ids included.
    Other columns are ignored. An empty table gives no rows.

    ``path`` is read on every executor. A block holds about ``block_words`` words, or one text if that has more. What is
    shuffled is each block's list of distinct words, not its words. The number of tasks that lay out blocks follows from
    their number, so a task reads a few MB however large the corpus is.
    """
    return _by_words(documents, path, block_words, counts=False)


def count_tokens(documents: DataFrame, path: str, block_words: int = 400_000) -> DataFrame:
    """(doc_id, n_tokens) of every row, as ``encode_corpus`` would give ids."""
    return _by_words(documents, path, block_words, counts=True)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary: the bytes of each id. As many rows as the vocabulary has ids."""
    ranks = sorted((r, p) for p, r in _ranks(path).items())
    return spark.createDataFrame(pa.table({"id": pa.array([r for r, _ in ranks], pa.int32()), "piece": pa.array([bytearray(p) for _, p in ranks], pa.binary())}))


def _lay_bytes(pieces: pa.Table, blocks: pa.Table) -> pa.Table:
    if not blocks.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "bytes": pa.array([], pa.binary())})
    doc_ids, lens = blocks["doc_ids"].combine_chunks().flatten(), blocks["lens"].combine_chunks().flatten().to_numpy()
    codes = np.frombuffer(blocks["codes"][0].as_py(), np.int32)
    if not len(codes):
        return pa.table({"doc_id": doc_ids, "bytes": pa.array([b""] * len(doc_ids), pa.binary())})
    laid = _by_code(pieces, "piece").cast(pa.large_binary()).take(pa.array(codes))
    ends = np.r_[0, np.cumsum(pc.binary_length(laid).to_numpy())][np.r_[0, np.cumsum(lens)]].astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc_ids), [None, pa.py_buffer(ends), laid.buffers()[2]])
    return pa.table({"doc_id": doc_ids, "bytes": whole.cast(pa.binary())})


def decode_corpus(encoded: DataFrame, pieces: DataFrame, block_ids: int = 400_000) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids), through a join of ids to ``piece_table``.

    Empty and null lists give an empty text, null ids and ids that ``pieces`` lacks add nothing, bytes that are no UTF-8
    become U+FFFD. Each block of rows brings its distinct ids to the join and lays the pieces out by position.
    """
    lists = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.filter("ids", lambda x: x.isNotNull()), F.array().cast("array<int>")).alias("w"))
    blocks, count = Scratch(encoded.sparkSession, "pieces").write_counted(_blocks(lists, "int", block_ids))
    used = blocks.select("block", F.posexplode("words").alias("code", "id"))
    used = used.join(pieces.select("id", "piece"), "id", "left").select((F.col("block") + 0).alias("of"), "code", F.coalesce("piece", F.lit(b"")).alias("piece"))
    laid = _lay_out(used, blocks, count, _lay_bytes, "doc_id bigint, bytes binary")
    return laid.select("doc_id", F.make_valid_utf8(F.col("bytes").cast("string")).alias("text"))
