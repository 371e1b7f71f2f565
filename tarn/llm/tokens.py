"""Token counts from flat token files: documents lie end to end, each closed by a separator, with no index.

Blocks of a file are searched for the separator independently; a document may begin blocks before it ends. A prefix scan
over the blocks gives each the documents before it and the tokens carried in. The scan has two levels, so even a file
of very many blocks is never scanned by one task alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import arrow, checkpointed

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id after the last rank closes a document; ids of two bytes.
SEPARATOR = 50256
TYPE = "<u2"
BLOCK_TOKENS = 1 << 15
#: Blocks of one part of the scan.
SPAN_BLOCKS = 1 << 10
#: The byte-level pattern that the ranks were made with (fixed values).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(ranks: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


FILES = "file long, block long, data binary, first_doc long, doc_ids array<long>"


def pack(docs: DataFrame, ranks: bytes, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files, one for each task, cut into blocks: (file, block, data), and beside them who was written when.

    Rows with data are the files; they know nothing of documents. Rows with doc_ids list the documents of a file in
    order (first_doc counts from 0), which only names the counts later. A null text is written as an empty document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file = encoder(sent.value), TaskContext.get().partitionId()
        rest, block, seen = np.zeros(0, TYPE), 0, 0

        def rows(blocks: list[np.ndarray], ids: list | None = None) -> pa.RecordBatch:
            n = len(blocks) + (ids is not None)
            lists = [None] * len(blocks) + ([ids] if ids is not None else [])
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.int64()), pa.array([*range(block, block + len(blocks))] + [None] * (ids is not None), pa.int64()), pa.array([x.tobytes() for x in blocks] + [None] * (ids is not None), pa.binary()), pa.array([None] * len(blocks) + [seen] * (ids is not None), pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["file", "block", "data", "first_doc", "doc_ids"],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(1).to_pylist()
                flat = [rest]
                for t in texts:
                    flat += [np.array(bpe.encode_ordinary(t), TYPE) if t else rest[:0], np.array([separator], TYPE)]
                joined = np.concatenate(flat)
                whole = len(joined) // block_tokens
                blocks = [joined[k * block_tokens : (k + 1) * block_tokens] for k in range(whole)]
                rest = joined[whole * block_tokens :]
                yield rows(blocks, part.column(0).to_pylist())
                block += whole
                seen += len(texts)
        if len(rest):
            yield rows([rest])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow, run, FILES)


def flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = TYPE) -> DataFrame:
    """(file, block, data) of raw token files under a path: any store that Spark reads, files of up to 2 GB each."""
    size = np.dtype(dtype).itemsize * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = max(1, -(-len(data) // size)) if data else 0
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([data[k * size : (k + 1) * size] for k in range(n)], pa.binary())], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").transform(arrow, run, "file string, block long, data binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = TYPE, span: int = SPAN_BLOCKS) -> DataFrame:
    """(file, document, n_tokens) from (file, block, data): the tokens before each separator, in file order from 0.

    Tokens after the last separator belong to no finished document and are not counted; an empty file has none.
    """
    of = blocks.schema["file"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, heads, tails, inner = [], [], [], [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype)
                at = np.flatnonzero(ids == separator)
                sizes.append(len(ids))
                counts.append(len(at))
                heads.append(int(at[0]) if len(at) else None)
                tails.append(len(ids) - 1 - int(at[-1]) if len(at) else None)
                inner.append((np.diff(at) - 1).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, inner)]).astype(np.int32)), pa.array(np.concatenate(inner) if inner else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(heads, pa.int64()), pa.array(tails, pa.int64()), lists], ["file", "block", "n", "closed", "head", "tail", "inner"])

    found = blocks.select("file", "block", "data").transform(arrow, search, f"file {of}, block long, n long, closed long, head long, tail long, inner array<long>")
    found = found.withColumn("part", F.floor(F.col("block") / span))
    # Within a part: tokens and documents before each block, and the place (in the part) after the last separator before it.
    inside = Window.partitionBy("file", "part").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs", F.coalesce(F.sum("closed").over(before), F.lit(0)))
    local = local.withColumn("after", F.max(F.when(F.col("closed") > 0, F.col("at") + F.col("n") - F.col("tail"))).over(before))
    parts = found.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"))
    last = local.filter("closed > 0").groupBy("file", "part").agg(F.max(F.col("at") + F.col("n") - F.col("tail")).alias("after"))
    across = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(last, ["file", "part"], "left").withColumn("p_at", F.coalesce(F.sum("n").over(across), F.lit(0))).withColumn("p_docs", F.coalesce(F.sum("closed").over(across), F.lit(0)))
    parts = parts.withColumn("p_after", F.coalesce(F.max(F.col("p_at") + F.col("after")).over(across), F.lit(0))).select("file", "part", "p_at", "p_docs", "p_after")
    ends = local.filter("closed > 0").join(parts, ["file", "part"])
    carried = F.col("p_at") + F.col("at") - F.coalesce(F.col("p_at") + F.col("after"), F.col("p_after"))
    sizes = F.concat(F.array(carried + F.col("head")), "inner")
    return ends.select("file", (F.col("p_docs") + F.col("docs")).alias("first"), F.posexplode(sizes).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("document"), "n_tokens")


def token_counts(docs: DataFrame, ranks: bytes, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, span: int = SPAN_BLOCKS) -> DataFrame:
    """(doc_id, n_tokens) of each row: the documents are packed into flat token files, which are then scanned.

    Null and empty texts have no tokens; repeated rows each get a row, a null id stays null. Extra columns are ignored.
    """
    files = checkpointed(pack(docs, ranks, separator, block_tokens))
    counts = scan(files.filter("data is not null"), separator, span=span)
    names = files.filter("doc_ids is not null").select("file", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first_doc") + F.col("k")).alias("document"), "doc_id")
    return names.join(counts, ["file", "document"]).select("doc_id", "n_tokens")
