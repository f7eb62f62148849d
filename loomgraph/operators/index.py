"""From source texts to the graph: symbols, raw calls and resolved edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import one_line_signature
from ..plans.shared import cut
from ..sources.scan import MAX_BYTES, detect_language, files_below
from .resolve import heavy_names, resolve_calls

SYMBOL = "id string, name string, kind string, file string, line int, column int, end_line int, signature string, exported boolean, parent string, is_static boolean, extends array<string>, implements array<string>"
CALL = "from_id string, to_name string, file string, line int, column int"
EXTRACT = f"file string, error string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, calls array<struct<{CALL.replace(' ', ':').replace(',:', ',')}>>"


BATCH_FILES, BATCH_CHARS = 256, 1 << 20  # of the texts whose rows go back to Spark together


def extract(files: DataFrame, spread: bool = True) -> DataFrame:
    """(file, error, symbols, calls) per row of ``files`` (file, content as text or bytes).

    A file that cannot be read carries an error and empty lists; unknown
    extensions and files above 5 MiB are left out; null content is an error.
    A row is one file of at most 5 MiB, so a task's memory is bounded.

    Reading costs far more than moving a text, so rows are dealt to all cores
    first, however few files of a table they come from; without ``spread``
    they stay where they are, for sources that are split already.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ..sources.structure import read_source

        schema, rows, size = None, [], 0
        for batch in batches:
            for path, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                error, found, calls, data = None, [], [], content.as_py()
                try:
                    found, calls = read_source(data.decode("utf-8", "replace") if isinstance(data, bytes) else data, path)
                except Exception as why:  # one bad file must not end the job; it is reported in its row
                    error = f"{type(why).__name__}: {why}"[:200]
                schema = schema or arrow_schema()
                rows.append({"file": path, "error": error, "symbols": found, "calls": calls})
                size += len(data or "")
                if len(rows) >= BATCH_FILES or size >= BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def arrow_schema():
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        struct = lambda ddl: pa.list_(pa.struct([(n, kinds[k]) for n, k in (p.split(" ") for p in ddl.split(", "))]))
        return pa.schema([("file", pa.string()), ("error", pa.string()), ("symbols", struct(SYMBOL)), ("calls", struct(CALL))])

    some = files.select("file", F.col("content")).filter(detect_language(F.col("file")).isNotNull() & (F.coalesce(F.octet_length("content"), F.lit(0)) <= MAX_BYTES))
    if spread:
        spark = some.sparkSession
        some = some.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "file")
    return some.mapInArrow(run, EXTRACT)


def extracted_symbols(parsed: DataFrame) -> DataFrame:
    """Symbols with redacted one-line signatures; ``seq`` orders by file, then place in it."""
    rows = parsed.select("file", F.posexplode("symbols").alias("ord", "s")).select("s.*", F.struct(F.col("file"), F.col("ord")).alias("seq"))
    return rows.withColumn("signature", one_line_signature(F.col("signature"))).withColumn("name_lower", F.lower("name"))


def extracted_calls(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.posexplode("calls").alias("ord", "c")).select("c.*", F.struct(F.col("file"), F.col("ord")).alias("seq"))


def derive_raw_calls(edges: DataFrame) -> DataFrame:
    """Edges without what resolution added."""
    return edges.drop("to_id", "ambiguous", "candidate_count")


@dataclass
class Graph:
    symbols: DataFrame
    edges: DataFrame
    files_indexed: int = 0
    files_failed: int = 0


def build(files: DataFrame, spread: bool = True) -> Graph:
    """Parse once (the result is written, so a lost executor costs no second parse), then resolve."""
    parsed = cut(extract(files, spread), "parsed")
    counts = parsed.agg(F.count_if(F.col("error").isNull()), F.count("error")).first()
    nodes, calls = extracted_symbols(parsed), extracted_calls(parsed)
    return Graph(nodes, resolve_calls(calls, nodes, heavy=heavy_names(calls)), counts[0], counts[1])


def index_directory(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> Graph:
    """The graph of a folder; files whose links leave it count as failed."""
    files, skipped = files_below(spark, root, ignore)
    graph = build(files, spread=False)  # Spark reads folders in parts of even size
    graph.files_failed += skipped
    return graph
