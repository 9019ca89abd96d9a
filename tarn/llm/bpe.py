"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before they are encoded: places where the splitting pattern
always starts a new match, whatever stands before and after. No piece crosses such a place, so the
ids are those of the whole text, and what the library holds stays bounded by the part (or by the longest stretch without a boundary,
such as one word of any length, which is a single piece for the pattern too).

Defined cases: a null text encodes as the empty text (no ids); the vocabulary has no special tokens, so
their strings are ordinary text; decoding joins the raw bytes of ids, which need not be valid UTF-8;
repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import bounded_batches, over_batches, table
from ._words import chunks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters that are encoded at once; a longer text is cut at the first safe boundary after them.
PART_CHARS = 1 << 16
#: Between a letter and a space that a letter follows: a match that has taken a letter never goes on with a space, and the next
#: one begins with it, by the patterns of all tokenizers of this kind.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: By ``PATTERN``, no match goes on from what is no space to a space, nor from a letter to punctuation. (Scripts that are written
#: without spaces are cut at their own punctuation.)
_SAFE_HERE = re.compile("(?<=\\S)(?=[ \\t\\n\\x0b\\x0c\\r])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def parts(text: str, size: int = PART_CHARS, pattern: str = public_tokenizers.PATTERN) -> Iterator[str]:
    """The text in parts of about ``size`` characters (at least one), cut at safe boundaries only; a stretch without one stays whole."""
    if size < 1:
        raise ValueError("a part has at least one character")
    safe, begin = _SAFE_HERE if pattern == public_tokenizers.PATTERN else _SAFE, 0
    while len(text) - begin > size:
        cut = safe.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


@lru_cache(maxsize=4)
def encoding(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(tokenizer: tiktoken.Encoding, text: str | None) -> list[int]:
    out: list[int] = []
    for part in parts(text or "", pattern=tokenizer._pat_str):
        out += tokenizer.encode_ordinary(part)
    return out


def _load(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path(RANKS), "rb") as file:  # on the driver; its size is a vocabulary's
        return spark.sparkContext.broadcast(file.read())


def encode_texts(docs: DataFrame, *, text: str = "text", into: str = "ids", digest: str | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The documents with their token ids in the column ``into``, and where named in ``digest`` the SHA-256 of the bytes
    these decode to; they replace columns of those names."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = _load(spark, path)
    added = [T.StructField(into, T.ArrayType(T.IntegerType())), *([T.StructField(digest, T.StringType())] if digest else [])]
    docs = docs.drop(*(x.name for x in added if x.name != text))
    schema, names = T.StructType([*docs.schema.fields, *added]), [x.name for x in added]

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value, pattern)
        for whole in stream:
            for batch in chunks(whole, text):
                ids = [encode(tokenizer, x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                columns = [pa.array(ids, pa.list_(pa.int32()))]
                if digest:
                    columns.append(pa.array([hashlib.sha256(tokenizer.decode_bytes(x)).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return docs.mapInArrow(over_batches(over), schema)


def decode_ids(encoded: DataFrame, *, ids: str = "ids", into: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The rows with the raw bytes of their ids in the column ``into`` (null ids: null)."""
    spark = encoded.sparkSession
    ranks = _load(spark, path)
    encoded = encoded.drop(into) if into != ids else encoded
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())])

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value, pattern)
        for batch in stream:
            raw = [None if x is None else tokenizer.decode_bytes(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, into])

    return encoded.mapInArrow(over_batches(over), schema)


DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def digest_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes they decode to, in one pass."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = _load(spark, path)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), *DIGESTS.fields])

    def over(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks.value, pattern)
        name = [str(i) for i in range(tokenizer.n_vocab)].__getitem__
        for whole in stream:
            for batch in chunks(whole, "text"):
                counts, of_ids, of_bytes = [], [], []
                for x in batch.column(1).to_pylist():
                    ids = encode(tokenizer, x)
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(tokenizer.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(counts, np.int64)), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", *DIGESTS.names])

    return source.mapInArrow(over_batches(over), schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(table(spark, sf_dir, "documents"))
