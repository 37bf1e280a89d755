"""Encoding of a corpus with a public byte-level tokenizer, and decoding.

Texts of at most ``chunk`` characters are encoded as they are. A longer one is
cut into overlapping chunks, which are pre-tokenised in parallel. A pre-token
boundary that two neighbours share in their overlap is where they have
resynchronised: from there on both would go on alike, so the text is cut there
and the pieces are encoded in parallel. Where no boundary is shared, the chunks
from there on stay one piece. The ids are those of the whole text in one go.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.util import broadcast_if_small, cut, ship, spread

#: Where the vocabulary files of public tokenizers lie, on every machine.
TOKENIZER_DIR = "/opt/tokenizers"
CHUNK, OVERLAP = 65_536, 1_024
#: A boundary this close to a chunk's end may look different with what follows (the longest contraction has 3 characters).
_EDGE = 4


@functools.cache
def _pattern(directory: str) -> str:
    spec = importlib.util.spec_from_file_location("public_tokenizers_at", os.path.join(directory, "__init__.py"))
    module = importlib.util.module_from_spec(spec)  # type: ignore[arg-type]
    spec.loader.exec_module(module)  # type: ignore[union-attr]
    return module.PATTERN


@functools.cache
def vocabulary(name: str, directory: str) -> dict[bytes, int]:
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(name: str, directory: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=_pattern(directory), mergeable_ranks=vocabulary(name, directory), special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens start, but for those after a blank: how a run of blanks is split depends on what follows it."""
    import regex

    return [s for m in regex.compile(pattern).finditer(text) if (s := m.start()) and not text[s - 1].isspace()]


def _lists(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _encode(batches: Iterator[pa.RecordBatch], name: str, directory: str) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its ids."""
    encode = encoding(name, directory).encode_ordinary
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            ids = [encode(t) if t else [] for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(ids)], names=[*part.schema.names[:-1], "ids"])


def _seams(batches: Iterator[pa.RecordBatch], directory: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """For each chunk (key, h, k, last, text) the boundaries in the overlaps with its neighbours, as absolute positions."""
    pattern = _pattern(directory)
    kinds = pa.list_(pa.int32())
    for b in (x.slice(at, 64) for x in batches for at in range(0, x.num_rows, 64)):
        keep: list[int] = []
        seam, head, tail = [], [], []
        for row, (k, last, text) in enumerate(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
            starts = boundaries(text, pattern)
            end = len(text) if last else len(text) - _EDGE
            if k:
                keep.append(row)
                seam.append(k)
                head.append([k * chunk + s for s in starts if s < overlap and s <= end])
                tail.append(None)
            if not last:
                keep.append(row)
                seam.append(k + 1)
                head.append(None)
                tail.append([k * chunk + s for s in starts if s > chunk and s <= end])
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(rows), b.column(1).take(rows), pa.array(seam, pa.int32()), pa.array(head, kinds), pa.array(tail, kinds)], names=["key", "h", "seam", "head", "tail"]
        )


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, ids for every row of df, without special tokens; strings of special tokens are ordinary text.

    Null and empty texts give an empty list. Repeated rows are encoded each; an empty table gives none.
    """
    if not 2 * _EDGE < overlap < chunk:
        raise ValueError("overlap must lie between 8 and chunk")
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    texts = spread(df).select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    short = texts.filter(n <= chunk).mapInArrow(lambda it: _encode(it, name, directory), f"key {kind}, ids array<int>")

    # equal (key, text) rows share h; their pieces are told apart again by how often the first piece came
    long = texts.filter(n > chunk).withColumns({"h": F.xxhash64("text"), "n": n})
    count = F.ceil((F.col("n") - overlap) / chunk).cast("int")
    chunk_of = lambda k: F.struct(
        k.alias("k"), (k == count - 1).alias("last"), F.substr("text", k * chunk + 1, F.when(k == count - 1, F.col("n")).otherwise(F.lit(chunk + overlap))).alias("text")
    )
    chunks = long.select("key", "h", F.explode(F.transform(F.sequence(F.lit(0), count - 1), chunk_of)).alias("c")).select("key", "h", "c.*")
    seams = (
        chunks.mapInArrow(lambda it: _seams(it, directory, chunk, overlap), f"key {kind}, h long, seam int, head array<int>, tail array<int>")
        .groupBy("key", "h", "seam")
        .agg(F.array_min(F.array_intersect(F.max("head"), F.max("tail"))).alias("at"))
    )
    # a seam only counts if all before it resynchronised; a document has one short list of cuts
    by_doc = seams.groupBy("key", "h").agg(F.min(F.when(F.col("at").isNull(), F.col("seam"))).alias("broken"), F.collect_list(F.struct("seam", "at")).alias("cuts"))
    cuts = by_doc.select(
        F.col("key").alias("k_"), F.col("h").alias("h_"), F.array_sort(F.transform(F.filter("cuts", lambda c: F.col("broken").isNull() | (c["seam"] < F.col("broken"))), lambda c: c["at"])).alias("cuts")
    )
    joined = long.join(broadcast_if_small(cut(cuts)), F.col("key").eqNullSafe(F.col("k_")) & (F.col("h") == F.col("h_")), "left")
    edges = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array("n"))
    piece_of = lambda start, i: F.struct(start.alias("start"), F.substr("text", start + 1, F.get("edges", i + 1) - start).alias("text"))
    pieces = joined.withColumn("edges", edges).select("key", "h", F.explode(F.transform(F.slice("edges", F.lit(1), F.size("edges") - 1), piece_of)).alias("p")).select("key", "h", "p.*")
    coded = pieces.mapInArrow(lambda it: _encode(it, name, directory), f"key {kind}, h long, start int, ids array<int>")
    whole = coded.groupBy("key", "h").agg(F.collect_list(F.struct("start", "ids")).alias("parts"))
    copies = F.size(F.filter("parts", lambda p: p["start"] == 0))
    whole = whole.select("key", F.flatten(F.transform(F.array_sort(F.array_distinct("parts")), lambda p: p["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")
    return short.unionByName(whole).withColumnRenamed("key", key)


def _decode(batches: Iterator[pa.RecordBatch], name: str, directory: str) -> Iterator[pa.RecordBatch]:
    words = {i: w for w, i in vocabulary(name, directory).items()}
    for b in batches:
        texts = [None if ids is None else b"".join(words[i] for i in ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])


def decode(df: DataFrame, key: str, ids: str = "ids", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """key, text: the tokens' bytes, one after the other. A null list gives null, an empty one ''."""
    ship(df.sparkSession)
    out = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return out.mapInArrow(lambda it: _decode(it, name, directory), f"key {dict(df.dtypes)[key]}, text string").withColumnRenamed("key", key)


def _count(batches: Iterator[pa.RecordBatch], name: str, directory: str) -> Iterator[pa.RecordBatch]:
    encode = encoding(name, directory).encode_ordinary
    for b in (x.slice(at, 500) for x in batches for at in range(0, x.num_rows, 500)):
        sizes = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])


def lengths(df: DataFrame, keep: list[str], text: str, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """The kept columns and n_tokens of each row; 0 for null and empty texts. The ids themselves never leave the worker."""
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long"
    return spread(df).select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(lambda it: _count(it, name, directory), schema)
