"""Token counts of flat token files, by a separator scan.

A token file is nothing but ids, one after the other (``dtype``), with an end id after each document:
no header and no index. ``count_tokens`` cuts files into blocks of ``block`` ids that tasks read by
range, finds the end ids of each block with one vectorised comparison, and stitches documents that
cross blocks by a prefix scan over block summaries (end ids so far, place of the last end id). The scan
has two levels, blocks within chunks and chunks within a file, so one file of any size is split.

``write_token_files`` makes such files from a table of texts. A file appears under its name only when
it is whole, and names are unique to a task's attempt: only those that the returned table names count,
so a repeated or lost attempt leaves a file that nothing refers to.

Defined results: null text is empty text (0 tokens); ids after the last end id are a document that has
not ended; a file's last bytes that do not fill an id are not counted; repeated rows are documents of
their own; an empty table or folder gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.lineage import shared_folder, written

END_ID = 50256  # free in the vocabulary
DTYPE = "<u2"
BLOCK = 1 << 20
CHUNK = 1024
ROLL_BYTES = 256 << 20

_WRITTEN = "name string, ordinal bigint, id bigint"
_SUMMARY = "path string, block bigint, n bigint, last bigint, ends array<bigint>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(2)
def load(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern's ``\\s`` has it.
_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def encode_whole(encoding, text: str) -> list[int]:
    """Ids of a text. A long run of white space, on which the library's search overflows its stack, is cut out: the
    pattern makes one piece of all of it but its last character, or of all of it at the text's end."""
    out, at = [], 0
    for m in _BLANK.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += encoding.encode_ordinary(text[at : m.start()]) + encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def check_ids(encoding, end_id: int, dtype: str) -> None:
    """Refuses an end id that is a token's, and a type that cannot hold all ids."""
    if end_id in encoding._mergeable_ranks.values():
        raise ValueError(f"the end id {end_id} is a token of the vocabulary")
    if max(end_id, encoding.max_token_value) > np.iinfo(dtype).max:
        raise ValueError(f"ids up to {max(end_id, encoding.max_token_value)} do not fit {dtype}")


def _writer(folder: str, vocabulary: str, end_id: int, dtype: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, (fs, root) = load(vocabulary), FileSystem.from_uri(folder)
        check_ids(encoding, end_id, dtype)
        tail, out, name, size, ids = np.array([end_id], dtype).tobytes(), None, "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64())], names=["name", "ordinal", "id"])

        for batch in batches:
            for i in range(len(batch)):
                if out is None:
                    name, size, ids = f"{uuid.uuid4().hex}.bin", 0, []
                    out = fs.open_output_stream(f"{root}/.{name}")
                tokens = np.array(encode_whole(encoding, batch.column(1)[i].as_py() or ""), dtype=dtype).tobytes() + tail
                out.write(tokens)
                size += len(tokens)
                ids.append(batch.column(0)[i].as_py())
                if size >= roll:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, dtype: str = DTYPE, roll: int = ROLL_BYTES
) -> DataFrame:
    """Writes the texts' ids to flat files in ``folder`` (which tasks and driver share, created here), and
    returns (name, ordinal, id): which document is which of a file. The files themselves hold only ids."""
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(source.mapInArrow(_writer(folder, vocabulary or default_vocabulary(), end_id, dtype, roll), _WRITTEN))


def _scan(end_id: int, dtype: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for path, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = FileSystem.from_uri(path)
                with fs.open_input_file(place) as f:
                    data = f.read_at(min(block * width, size // width * width - at * block * width), at * block * width)
                ends = np.flatnonzero(np.frombuffer(data, dtype) == end_id) + at * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([at]), pa.array([len(ends)]), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["path", "block", "n", "last", "ends"],
                )

    return run


def count_tokens(spark: SparkSession, folder: str, end_id: int = END_ID, dtype: str = DTYPE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row for each document of the flat files in ``folder``: path, ordinal (in its file), start
    (ids before it in its file), n_tokens (without the end id) and ended."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").where(F.col("length") >= width)
    whole = F.floor(F.col("length") / width)
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / block))).alias("block"))
    found = written(blocks.repartition("path", "block").mapInArrow(_scan(end_id, dtype, block), _SUMMARY)).withColumn("chunk", F.floor(F.col("block") / chunk))

    def scanned(rows: DataFrame, order: str, *keys: str) -> DataFrame:
        """End ids before each row, and the place of the last one."""
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*keys, order, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{order}_n"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias(f"{order}_last"))

    chunks = found.groupBy("path", "chunk").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    carried = scanned(found, "block", "path", "chunk").join(scanned(chunks, "chunk", "path"), ["path", "chunk"])
    carried = carried.select("path", "block", (F.col("block_n") + F.col("chunk_n")).alias("before"), F.greatest("block_last", "chunk_last").alias("last_before"))
    starts = F.concat(F.array(F.col("last_before") + 1), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda x: x + 1))
    some = found.where("n > 0").select("path", "block", "ends").join(carried, ["path", "block"])
    each = some.select("path", "before", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("k", "d"))
    ended = each.select("path", (F.col("before") + F.col("k")).alias("ordinal"), "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = files.join(chunks.groupBy("path").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start")), "path")
    rest = totals.select("path", "ordinal", "start", (whole - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **files) -> DataFrame:
    """One row for each row of ``docs``: id (named as given) and n_tokens, read from flat token files
    that are written to the shared folder. ``files`` are options of ``write_token_files``."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    places = write_token_files(docs, folder, id_col, text_col, **files)
    counted = count_tokens(spark, folder, files.get("end_id", END_ID), files.get("dtype", DTYPE)).where("ended")
    named = counted.select(F.element_at(F.split("path", "/"), -1).alias("name"), "ordinal", "n_tokens")
    return places.join(named, ["name", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
