"""Export and import as a stream of lines: one JSON document by its format, with no collection in one row.

Every line is an element, or the opening or closing of a list; put one after the other they are the exchange document. They
are dealt by ranges and sorted, so the part files in order of their names are the document, and a collection of any size is
many lines in many files. Elements carry their own kind and owner in addition to the format's fields, so an import reads
each line by itself, wherever the files are cut.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.scalars import import_hash
from tarn.operators.crawl import checkpointed
from tarn.schemas import FORMAT_VERSION
from tarn.sources.exchange import FormatError, report

#: What an import accepts, packed or not.
BODY_BYTES = 512 * 1024 * 1024
#: Lines of one part file: an import holds a file's packed bytes.
FILE_LINES = 2000
#: Where a line stands: head, collections, tail; the collection; its part; the key in the part; a target's page.
_ORDER = ["top", "name", "part", "key", "sub", "page"]


def _line(text: Column, top: int = 1, name: Column | str | None = None, part: int = 0, key: Column | str | None = None, sub: int = 0, page: Column | str | None = None) -> list[Column]:
    say = lambda c: F.lit("") if c is None else F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return [F.lit(top).alias("top"), say(name).alias("name"), F.lit(part).alias("part"), say(key).alias("key"), F.lit(sub).alias("sub"), say(page).alias("page"), text.alias("line")]


def _opened(item: Column, field: str) -> Column:
    """An object's JSON, left open in a list field that follows."""
    return F.concat(F.substring(item, F.lit(1), F.length(item) - 1), F.lit(f',"{field}":['))


def _json(kind: str, **columns: Column | str) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def _after_first(rows: DataFrame, owner: list[str], key: str) -> DataFrame:
    """rows (with `item`) as list elements: a comma before all but the first of each owner; the least key is found by a combined aggregate.

    Where collections own the rows, their first keys are broadcast, so that no collection's rows come together in a task.
    """
    first = rows.groupBy(*[F.col(c).alias(f"_own_{c}") for c in owner]).agg(F.min(key).alias("_first"))
    first = F.broadcast(first) if owner == ["name"] else first
    joined = rows.join(first, [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in owner]) if owner else rows.crossJoin(F.broadcast(first))
    comma = F.when(F.col(key) == F.col("_first"), "").otherwise(",")
    return joined.select(*[c for c in rows.columns if c != "item"], F.concat(comma, "item").alias("item"))


def export_lines(tables: dict[str, DataFrame], docs: DataFrame, exported_at: str, self_url: str) -> DataFrame:
    """(top, name, part, key, sub, page, line): the lines of the exchange document and the order in which they stand.

    Documents of unknown collections are left out. Urls are the keys of pages and documents within their owner.
    """
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    collections, targets, pages = tables["collections"], tables["crawl_targets"], tables["crawled_pages"]
    names = collections.select(F.col("id").alias("collection_id"), "name")
    ranking = tables["ranking_config"].select("collection_id", F.struct("freshness_half_life_days", F.to_json("source_weights").alias("source_weights_json"), F.to_json("domain_boosts").alias("domain_boosts_json"), "config_json").alias("ranking_config"))
    heads = collections.withColumnRenamed("id", "collection_id").join(ranking, "collection_id", "left")
    heads = heads.select("name", _opened(_json("collection", name="name", description="description", created_at=stamp("created_at"), updated_at=stamp("updated_at"), ranking_config="ranking_config"), "crawl_targets").alias("item"))
    target = targets.join(names, "collection_id").select(
        "name", "url_prefix", F.col("id").alias("target_id"),
        _opened(_json("target", collection="name", url_prefix="url_prefix", recrawl_interval_s="recrawl_interval_s", recrawl_interval_secs="recrawl_interval_s", enabled=F.col("enabled").cast("long"), crawl_delay_secs="crawl_delay_secs", created_at=F.col("created_at").cast("string")), "crawled_pages").alias("item"),
    )
    page = pages.drop("collection_id").join(target.select("target_id", "name", "url_prefix"), "target_id").select(
        "name", "url_prefix", "url",
        _json("page", collection="name", target="url_prefix", url="url", etag="etag", last_modified="last_modified", content_hash="content_hash", last_status=F.col("last_status").cast("long"), last_crawled_at="last_crawled_at", indexed_content_hash="indexed_content_hash").alias("item"),
    )
    outlink = tables["outlink_host_suggestions"].join(names, "collection_id").select("name", "host", _json("outlink", collection="name", host="host", link_count="link_count", examples_json=F.to_json("examples"), first_seen_at="first_seen_at", last_seen_at="last_seen_at", status="status").alias("item"))
    doc = docs.join(names.select(F.col("name").alias("collection")), "collection", "left_semi").select(F.col("collection").alias("name"), "url", _json("document", collection="collection", url="url", title="title", body="body", indexed_at="indexed_at").alias("item"))
    nodes = tables["node_peers"]
    node = nodes.select("url", _json("node", url="url", name="name", enabled=F.col("enabled").cast("long")).alias("item"))
    asked = tables["collection_peers"].join(nodes.select(F.col("id").alias("node_peer_id"), F.col("url").alias("node_peer_url")), "node_peer_id")
    peer = asked.select(F.concat_ws("\n", "local_collection", "node_peer_url", "remote_collection").alias("key"), _json("peer", local_collection="local_collection", node_peer_url="node_peer_url", remote_collection="remote_collection", source_weight="source_weight", enabled=F.col("enabled").cast("long")).alias("item"))
    one = tables["collections"].sparkSession.range(1)
    head = f'{{"format_version":{FORMAT_VERSION},"exported_at":{json.dumps(exported_at)},"self_url":{json.dumps(self_url)},"collections":['
    parts = [
        one.select(*_line(F.lit(head), 0)),
        _after_first(heads, [], "name").select(*_line(F.col("item"), name="name")),
        _after_first(target, ["name"], "url_prefix").select(*_line(F.col("item"), name="name", part=1, key="url_prefix")),
        _after_first(page, ["name", "url_prefix"], "url").select(*_line(F.col("item"), name="name", part=1, key="url_prefix", sub=1, page="url")),
        target.select(*_line(F.lit("]}"), name="name", part=1, key="url_prefix", sub=2)),
        collections.select(*_line(F.lit('],"outlink_host_suggestions":['), name="name", part=2)),
        _after_first(outlink, ["name"], "host").select(*_line(F.col("item"), name="name", part=3, key="host")),
        collections.select(*_line(F.lit('],"documents":['), name="name", part=4)),
        _after_first(doc, ["name"], "url").select(*_line(F.col("item"), name="name", part=5, key="url")),
        collections.select(*_line(F.lit("]}"), name="name", part=6)),
        one.select(*_line(F.lit('],"node_peers":['), 2, part=0)),
        _after_first(node, [], "url").select(*_line(F.col("item"), 2, part=1, key="url")),
        one.select(*_line(F.lit('],"collection_peers":['), 2, part=2)),
        _after_first(peer, [], "key").select(*_line(F.col("item"), 2, part=3, key="key")),
        one.select(*_line(F.lit("]}"), 2, part=4)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str, gzip: bool = True) -> None:
    """The document in part files at path; joined in order of their names they are one (gzipped or plain) file."""
    ranged = lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("line")
    ranged.write.mode("overwrite").option("maxRecordsPerFile", FILE_LINES).option("compression", "gzip" if gzip else "none").text(path)


# ---------------------------------------------------------------- import


def read_lines(spark: SparkSession, path: str, most: int = BODY_BYTES) -> DataFrame:
    """(line): the lines of the files at path, gzipped or not as their first two bytes say, whatever their names.

    A file larger than `most` bytes, packed or unpacked, is refused (FormatError, from the task that meets its end). Files
    are unpacked piece by piece, straight from the batch that holds their packed bytes.
    """
    files = spark.read.format("binaryFile").load(path)
    if not files.select("length").filter(F.col("length") > most).isEmpty():
        raise FormatError(f"a file of more than {most} bytes")

    def unpacked(content: pa.Buffer) -> Iterator[bytes]:
        view, step = memoryview(content), 1 << 18
        packed = bytes(view[:2]) == b"\x1f\x8b"
        inflate = zlib.decompressobj(31)
        for i in range(0, len(view), step):
            left = bytes(view[i : i + step])
            if not packed:
                yield left
                continue
            while left:
                if inflate.eof:  # files joined to one
                    inflate = zlib.decompressobj(31)
                yield inflate.decompress(left, 1 << 20)
                left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if packed:
            yield inflate.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rest, size = b"", 0
                for piece in unpacked(content.as_buffer()):
                    size += len(piece)
                    if size > most:
                        raise FormatError(f"a document of more than {most} bytes")
                    *whole, rest = (rest + piece).split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in whole], pa.string())], ["line"])
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([rest.decode()], pa.string())], ["line"])

    return files.select("content").mapInArrow(run, "line string")


_TEXT = "kind string, collection string, "
_KINDS = {
    "collection": "kind string, name string, description string, created_at string, updated_at string, ranking_config struct<freshness_half_life_days:double,source_weights_json:string,domain_boosts_json:string,config_json:string>",
    "target": _TEXT + "url_prefix string, recrawl_interval_s long, enabled long, crawl_delay_secs long, created_at string",
    "page": _TEXT + "target string, url string, etag string, last_modified string, content_hash string, last_status long, last_crawled_at long",
    "outlink": _TEXT + "host string, link_count long, examples_json string, first_seen_at long, last_seen_at long, status string",
    "document": _TEXT + "url string, title string, body string, indexed_at long",
    "node": "kind string, url string, name string, enabled long",
    "peer": "kind string, local_collection string, node_peer_url string, remote_collection string, source_weight double, enabled long",
}


def _is(kind: str) -> Column:
    return F.startswith(F.ltrim(F.col("line"), F.lit(",")), F.lit(f'{{"kind":"{kind}",'))


def _elements(lines: DataFrame, kind: str) -> DataFrame:
    """The elements of one kind as columns."""
    text = F.ltrim(F.col("line"), F.lit(","))
    whole = F.when(F.endswith(text, F.lit("[")), F.concat(text, F.lit("]}"))).otherwise(text)
    return lines.filter(_is(kind)).select(F.from_json(whole, _KINDS[kind]).alias("e")).select("e.*").drop("kind")


def checked(lines: DataFrame) -> DataFrame:
    """lines, if one of them is the head of a document of the known format version."""
    if lines.filter(F.startswith("line", F.lit(f'{{"format_version":{FORMAT_VERSION},'))).isEmpty():
        raise FormatError(f"format_version is not {FORMAT_VERSION}")
    return lines


def imported(lines: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that an import adds to each table, and to `documents` (with their import hash), as `exchange.import_tables`.

    A collection whose name is taken is skipped with all it holds; ids follow from names. The files are read twice: once for
    all lines but the documents', which are kept for every table, and once for the documents.
    """
    rest = checkpointed(lines.filter(~_is("document")))
    elements = lambda kind: _elements(lines if kind == "document" else rest, kind)
    ident = lambda *c: F.sha2(F.concat_ws("\n", *c), 256)
    new = elements("collection").join(tables["collections"].select("name"), "name", "left_anti")
    names = new.select(F.col("name").alias("collection"))
    of = lambda kind: elements(kind).join(names, "collection", "left_semi").withColumn("collection_id", ident("collection"))
    nodes = elements("node").join(tables["node_peers"].select("url"), "url", "left_anti").withColumn("id", ident("url"))
    every = tables["node_peers"].select("id", "url").unionByName(nodes.select("id", "url"))
    known = tables["collections"].select("name").unionByName(new.select("name"))
    asked = elements("peer").join(known.withColumnRenamed("name", "local_collection"), "local_collection", "left_semi")
    return {
        "collections": new.select(ident("name").alias("id"), "name", "description", "created_at", "updated_at"),
        "crawl_targets": of("target").withColumn("id", ident("collection_id", "url_prefix")).drop("collection"),
        "crawled_pages": of("page").withColumn("target_id", ident("collection_id", "target")).drop("collection", "target").withColumn("indexed_content_hash", F.lit(None).cast("string")),
        "ranking_config": new.filter("ranking_config is not null").select(ident("name").alias("collection_id"), "ranking_config.*"),
        "outlink_host_suggestions": of("outlink").drop("collection"),
        "node_peers": nodes,
        "collection_peers": asked.join(every.select(F.col("id").alias("node_peer_id"), F.col("url").alias("node_peer_url")), "node_peer_url").select("local_collection", "node_peer_id", "remote_collection", "source_weight", "enabled"),
        "documents": elements("document").join(names, "collection", "left_semi").withColumn("content_hash", import_hash("body")),
    }


def import_report(lines: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row, as `exchange.import_report`, from lines."""
    return report(lines.filter(_is("collection")).agg(F.count("*").alias("collections_total")), imported(lines, tables))
