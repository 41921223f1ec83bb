"""Encoding a whole corpus with a public byte-level BPE (problem 7).

Long texts are cut into overlapping chunks that are pre-tokenised on their own. Neighbouring chunks are stitched at a boundary both
see in their overlap; the pieces between stitches are encoded in parallel and put together in order.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a chunk and of the overlap with the next one. A text up to CHUNK + OVERLAP is one chunk and is never shuffled.
CHUNK, OVERLAP = 8_192, 512


def default_vocabulary() -> str:
    """Place of the byte_bpe_50k ranks in the installed public tokenizers."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def _pre_token():
    import regex

    return regex.compile(_pattern())


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of a text."""
    return [m.start() for m in _pre_token().finditer(text)]


def encode(texts: list[str], vocabulary: str) -> list[list[int]]:
    """Ids of each text, special tokens read as ordinary text."""
    return _encoding(vocabulary).encode_ordinary_batch(texts, num_threads=1)


def decode(ids: list[int], vocabulary: str) -> str:
    """The text of ids, by concatenating raw bytes."""
    return _encoding(vocabulary).decode_bytes(ids).decode("utf-8", "replace")


def _encode_batches(vocabulary: str, columns: tuple[str, ...]):
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(encode(texts, vocabulary), kind)], names=[*columns, "ids"])

    return run


def sure_boundaries(text: str) -> list[int]:
    """Those starts of pre-tokens that any context before or behind leaves as they are: the first place after letters or after digits.

    No pre-token goes on from a letter to anything else, nor from a digit. Other starts, as within blanks or behind an apostrophe,
    depend on where the scan began, so two chunks can agree on one that the whole text doesn't have.
    """
    at = (x for x in boundaries(text) if x)
    return [x for x in at if text[x - 1].isalpha() and not text[x].isalpha() or text[x - 1].isdecimal() and not text[x].isnumeric()]


def _edges(size: int, overlap: int):
    """Sure boundaries, as places in the whole text, in the first and in the last `overlap` code points of each chunk."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                at = [k * size + x for x in sure_boundaries(text)]
                heads.append([x for x in at if x < k * size + overlap])
                tails.append([x for x in at if x >= (k + 1) * size])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("k"), pa.array(heads, kind), pa.array(tails, kind)], names=["doc", "k", "head", "tail"])

    return run


_DOC = "doc struct<doc_id:bigint,h:bigint,n:int>"


def _cut(names: tuple[str, str]):
    """(doc, <name>, text): the slices of each text that its `cuts` name, from begin to end, each numbered by its cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, numbers, texts = [], [], []
            for row, (text, cuts) in enumerate(zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist())):
                docs += [row] * len(cuts)
                numbers += [c["number"] for c in cuts]
                texts += [text[c["begin"] : c["end"]] for c in cuts]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(docs, pa.int64())), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def encode_corpus(documents: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row of documents(doc_id, text, ...), other columns aside.

    An empty and a null text give an empty list. Rows are kept as they are: equal doc_ids give as many rows. ids equal those of the
    whole text whatever the chunk: where an overlap has no common boundary, as inside one endless word, the chunks are encoded as one.
    Long texts are the only rows shuffled, spread by text and chunk; each is cut in one pass, and one piece is never larger than a text.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = documents.select("doc_id", "text")
    is_long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_encode_batches(vocabulary, ("doc_id",)), "doc_id bigint, ids array<int>")

    # A row of its own identity, so equal doc_ids with other texts are not mixed up.
    long = rows.where(is_long).withColumn("doc", F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")))
    copies = long.groupBy("doc").count()
    one = long.dropDuplicates(["doc"])
    each = F.transform(F.sequence(F.lit(0), F.floor((F.col("doc.n") - 1) / chunk)), lambda k: F.struct(k.alias("number"), (k * chunk).alias("begin"), (k * chunk + chunk + overlap).alias("end")))
    chunks = one.select("doc", "text", each.alias("cuts")).mapInArrow(_cut(("doc", "k")), f"{_DOC}, k bigint, text string")
    spread = chunks.repartition("doc", "k")
    edges = spread.mapInArrow(_edges(chunk, overlap), f"{_DOC}, k bigint, head array<bigint>, tail array<bigint>")
    in_order = Window.partitionBy("doc").orderBy("k")
    common = F.array_intersect("head", F.lag("tail").over(in_order))
    stitched = edges.select("doc", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.try_element_at(F.array_sort(common), F.lit(1))).alias("start"))
    kept = stitched.where(F.col("start").isNotNull())
    ends = kept.select("doc", "start", F.coalesce(F.lead("start").over(Window.partitionBy("doc").orderBy("start")), F.col("doc.n").cast("bigint")).alias("end"))
    cuts = ends.groupBy("doc").agg(F.collect_list(F.struct(F.col("start").alias("number"), F.col("start").alias("begin"), "end")).alias("cuts"))
    pieces = one.join(cuts, "doc").select("doc", "text", "cuts").mapInArrow(_cut(("doc", "start")), f"{_DOC}, start bigint, text string")
    encoded = pieces.repartition("doc", "start").mapInArrow(_encode_batches(vocabulary, ("doc", "start")), f"{_DOC}, start bigint, ids array<int>")
    whole = encoded.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])).alias("ids"))
    again = whole.join(copies, "doc").select(F.col("doc.doc_id").alias("doc_id"), F.explode(F.array_repeat("ids", F.col("count").cast("int"))).alias("ids"))
    return short.unionByName(again)
