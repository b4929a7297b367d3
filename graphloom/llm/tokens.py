"""Encoding and decoding of the whole corpus with a public byte-level BPE (problem 7)."""

from __future__ import annotations

import base64
import importlib.util
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.shared import materialise

#: The vocabulary's published word pattern, and the same for Java's engine
#: ((?U) makes \s all Unicode white space there, as it is in the original).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
JAVA_PATTERN = "(?U)" + PATTERN

#: Documents of one dictionary: at most this many, and about this many words.
CHUNK_DOCS = 2_000
CHUNK_WORDS = 2_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The file's place in ``folder``, else in the installed package of public tokenizers, else in /opt/tokenizers."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The vocabulary as a tiktoken encoding, loaded once per worker."""
    if path not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODINGS[path]


def _dictionary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace words by their place in the dictionary of the chunk; send the documents, then the dictionary."""
    for batch in batches:
        words, ids = batch.column("words"), batch.column("doc_id")
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_pylist()
        at = 0
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and end - at < CHUNK_DOCS and (end == at or total + lengths[end] <= CHUNK_WORDS):
                total += lengths[end]
                end += 1
            part, chunk = words.slice(at, end - at), uuid.uuid4().hex
            coded = pc.list_flatten(part).dictionary_encode()
            offsets = [0]
            for n in lengths[at:end]:
                offsets.append(offsets[-1] + n)
            codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), coded.indices.cast(pa.int32()))
            n, m = end - at, len(coded.dictionary)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * n), ids.slice(at, n), codes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], ["chunk", "doc_id", "codes", "code", "word"]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * m), pa.nulls(m, ids.type), pa.nulls(m, codes.type), pa.array(range(m), pa.int32()), coded.dictionary.cast(pa.string())], ["chunk", "doc_id", "codes", "code", "word"]
            )
            at = end


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            ids = [enc.encode_ordinary(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _coded(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunk, doc_id, codes) of the documents and (chunk, table) with the ids of every code of a chunk."""
    # a text that holds code points the JVM's Unicode tables don't know yet may be split otherwise by the
    # vocabulary's own engine: it goes through as one piece and is split by the encoder
    text = F.coalesce("text", F.lit(""))
    split = F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))
    words = docs.select("doc_id", F.when(F.rlike(text, F.lit(r"\p{Cn}")), F.array(text)).otherwise(split).alias("words"))
    rows = materialise(words.mapInArrow(_dictionary_rows, "chunk string, doc_id bigint, codes array<int>, code int, word string"), "coded")
    coded, entries = rows.where(F.col("codes").isNotNull()), rows.where(F.col("word").isNotNull())
    distinct = entries.select("word").distinct()
    encoded = distinct.mapInArrow(_encode_rows(path), "word string, ids array<int>")
    tables = entries.select("chunk", "code", "word").join(encoded, "word").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("code", "ids"))).alias("entries"))
    return coded.select("chunk", "doc_id", "codes"), tables.select("chunk", F.col("entries.ids").alias("table"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text): the text's token ids without special tokens.

    A null or empty text has an empty list; equal rows give equal rows. The
    strings of special tokens are ordinary text.

    The text is split into words in the JVM once. Each chunk of documents keeps
    its words as places in a dictionary of the chunk; the distinct words of all
    dictionaries are encoded once each and joined back to the dictionaries, and
    the documents pick their ids by position out of the array of their chunk. Only
    dictionaries are shuffled by word: a word of every document, such as the
    commonest article, is there once per chunk and not once per occurrence.
    """
    coded, tables = _coded(docs, path or vocabulary_path())
    joined = coded.join(tables, "chunk", "left")
    return joined.select("doc_id", F.flatten(F.transform("codes", lambda c: F.get("table", c))).alias("ids"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row, by the same way without building the id lists."""
    coded, tables = _coded(docs, path or vocabulary_path())
    sizes = tables.select("chunk", F.transform("table", F.size).alias("table"))
    n = F.aggregate(F.transform("codes", lambda c: F.get("table", c)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return coded.join(sizes, "chunk", "left").select("doc_id", n.alias("n_tokens"))


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece) of the vocabulary, the piece as hexadecimal bytes; its size is fixed by the vocabulary."""
    ranks = read_ranks(path or vocabulary_path())
    return spark.createDataFrame([(i, b.hex()) for b, i in ranks.items()], "id int, piece string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): an id-to-piece join, pieces put together by position.

    An empty or null list gives an empty text. Ids that the vocabulary lacks are
    left out; bytes that are no UTF-8 (a list cut inside a character) become
    replacement characters. Equal doc_ids are told apart by row.
    """
    spark = encoded.sparkSession
    rows = materialise(encoded.select("doc_id", "ids").withColumn("_row", F.monotonically_increasing_id()), "ids")
    found = (
        rows.select("_row", F.posexplode("ids").alias("pos", "id"))
        .join(F.broadcast(pieces(spark, path)), "id")  # at most the vocabulary's 50,257 rows
        .groupBy("_row")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("hex"))
    )
    text = F.decode(F.unhex(F.coalesce("hex", F.lit(""))), "UTF-8")
    return rows.join(found, "_row", "left").select("doc_id", text.alias("text"))
