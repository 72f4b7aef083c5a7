"""Sources and sinks: page documents, printed lines, turns, key-value upserts and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
_RECT = T.ArrayType(T.DoubleType())
#: A page as one JSON object a line; boxes are arrays of four numbers there.
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("ocr", T.BooleanType()),
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("b", _RECT),
                        T.StructField(
                            "lines",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("b", _RECT),
                                        T.StructField("size", T.DoubleType()),
                                        T.StructField("font", T.StringType()),
                                        T.StructField("bold", T.BooleanType()),
                                        T.StructField("italic", T.BooleanType()),
                                        T.StructField("words", T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("b", _RECT)]))),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page documents from JSON lines (blank lines are skipped); ``doc_id`` is the file's name without its ending."""
    return spark.read.schema(PAGE_SCHEMA).json(path).withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def _box(rect: Column) -> Column:
    return F.struct(*[rect[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def page_words(pages: DataFrame) -> DataFrame:
    """doc_id, page, width, height, block, line_no (in the page), word_no, t, b and the line's b, size, bold, italic."""
    blocks = pages.select("doc_id", "page", "width", "height", F.posexplode("blocks").alias("block", "x"))
    lines = blocks.select("doc_id", "page", "width", "height", "block", F.posexplode("x.lines").alias("in_block", "line"))
    order = Window.partitionBy("doc_id", "page").orderBy("block", "in_block")
    lines = lines.withColumn("line_no", F.row_number().over(order) - 1)
    words = lines.select("*", F.posexplode("line.words").alias("word_no", "w"))
    return words.select("doc_id", "page", "width", "height", "block", "line_no", "word_no", F.col("w.t").alias("t"), _box(F.col("w.b")).alias("b"), _box(F.col("line.b")).alias("line_b"), F.col("line.size").alias("size"), F.col("line.bold").alias("bold"), F.col("line.italic").alias("italic"))


def document_lines(docs: DataFrame) -> DataFrame:
    """The printed lines of plain documents that aren't blank: book (the source), page (doc_id), line_no, text."""
    lines = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.where(F.trim("text") != "")


#: Page size and type size of lines without a layout of their own.
PAGE_WIDTH, PAGE_HEIGHT, TYPE_SIZE = 432.0, 648.0, 11.0


def laid_out(lines: DataFrame) -> DataFrame:
    """Lines with a plain layout: 15 points a line from the top, 5 points a character, every seventh line indented, the first one larger."""
    left = F.when(F.col("line_no") % 7 == 0, 68.0).otherwise(54.0)
    top = F.lit(20.0) + F.col("line_no") * 15
    size = F.when(F.col("line_no") == 0, 14.0).otherwise(TYPE_SIZE)
    return lines.select("*", left.alias("x0"), top.alias("y0"), (left + F.length("text") * 5).alias("x1"), (top + size).alias("y1"), size.alias("size"), F.lit(PAGE_HEIGHT).alias("height"))


def latest_per_key(events: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """Upsert by keys: of the rows with one key, that with the greatest ``order`` (then ``ties``) wins."""
    own = [c for c in events.columns if c not in keys]
    ranked = F.struct(order, *ties, *[c for c in own if c != order and c not in ties])
    best = events.groupBy(*keys).agg(F.max(ranked).alias("_best"))  # combined before the shuffle, unlike a window
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in own])


def keep_first_content(files: DataFrame, content: str, order: str) -> DataFrame:
    """Uploads by SHA-256 of their content: the first of each stays."""
    hashed = files.withColumn("sha256", F.sha2(content, 256))
    first = hashed.groupBy("sha256").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
    return first


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str, sep: str) -> DataFrame:
    """One text for each key: its rows in order, for text sinks."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("_x"))
    return listed.select(*keys, F.array_join(F.transform("_x", lambda x: x[text]), sep).alias("text"))


def systematic_sample(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each key at even distances (all, if there are fewer)."""
    w = Window.partitionBy(key).orderBy(order)
    ranked = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    taken = F.floor((F.col("_k") + 1) * n / F.col("_n")) > F.floor(F.col("_k") * n / F.col("_n"))
    return ranked.where((F.col("_n") <= n) | taken).drop("_k", "_n")


def write_partition(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
