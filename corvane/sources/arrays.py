"""Elements of JSON array files of any size and layout, read split by split.

The scan cuts files at every ``}`` instead of at line ends, so neither long lines nor indented elements
matter. A first pass notes for each split whether it turns strings inside out and how far it moves the
depth of brackets, for both cases of starting within a string or not; prefix sums over a file's splits then
give every split its true state. The second pass cuts whole elements; one that crosses splits leaves its
pieces, which are put together by their order in the file.

Worker functions are nested and import what they need, so executors need no copy of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQ = "seq"
#: The place of an element that begins in one split and ends in another: after all others of the first.
LAST_ROW = 1 << 62


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text between closing braces, in order within a split."""
    scan = spark.read.option("lineSep", "}").text(path)
    return scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, quoted, depth): the state in which every split begins. Unbalanced files are an error."""

    def summarise(batches):
        import re

        import pyarrow as pa

        escaped = re.compile(r"\\.", re.DOTALL)
        found: dict = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
            for file, block, value in zip(*columns):
                own = found.setdefault((file, block), [0, 0, 0])
                parts = escaped.sub("", value).split('"')
                parts[-1] += "}"
                # Text outside of strings if the split begins outside, and if it begins inside.
                for inside in (0, 1):
                    text = "".join(parts[(own[0] + inside) % 2 :: 2])
                    own[1 + inside] += text.count("{") + text.count("[") - text.count("}") - text.count("]")
                own[0] = (own[0] + len(parts) - 1) % 2
        rows = [(*k, *v) for k, v in found.items()]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        names = ["file", "block", "turns", "outside", "inside"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    splits = _fragments(spark, path).mapInArrow(summarise, "file string, block bigint, turns int, outside bigint, inside bigint")
    splits = splits.groupBy("file", "block").agg(*(F.max(c).alias(c) for c in ("turns", "outside", "inside")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file")
    none = F.lit(0).cast("bigint")
    states = splits.withColumn("quoted", (F.coalesce(F.sum("turns").over(before), none) % 2).cast("int"))
    moved = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    states = states.withColumn("moved", moved).withColumn("depth", F.coalesce(F.sum("moved").over(before), none))
    # The scan shows no brace after a file's last fragment, but every fragment was counted with one.
    ends = states.withColumn("whole", (F.sum("moved").over(after) == -1) & (F.sum("turns").over(after) % 2 == 0))
    bad = F.raise_error(F.concat(F.lit("not a whole JSON array: "), F.col("file"))).cast("bigint")
    return ends.select("file", "block", "quoted", F.when(F.col("whole"), F.col("depth")).otherwise(bad).alias("depth"))


PIECES = "file string, block bigint, row bigint, role string, item string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``PIECES``: whole elements, and what an element that crosses splits has in each of them."""

    def cut(batches):
        import re

        import pyarrow as pa

        token = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\Z|[{}\[\]]', re.DOTALL)
        rest_of_string = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
        at, depth, quoted, buffer, started, row = None, 0, 0, [], False, 0
        out: list = []

        def flush():
            # An element that is still open: its beginning, or a split in the middle of one.
            if at is not None and depth > 1 and buffer:
                out.append((*at, row, "tail" if started else "middle", "".join(buffer)))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "block", "value", "quoted", "depth"))
            for file, block, value, start_quoted, start_depth in zip(*columns):
                if (file, block) != at:
                    flush()
                    at, depth, quoted, buffer, started, row = (file, block), start_depth, start_quoted, [], False, 0
                text = value + "}"
                low = begin = 0
                if quoted:
                    closed = rest_of_string.match(text)
                    if not closed:
                        buffer.append(text)
                        continue
                    low, quoted = closed.end(), 0
                for m in token.finditer(text, low):
                    sign = m.group()
                    if sign[0] == '"':
                        # The text ends with a brace, so only a string that stays open reaches its end.
                        quoted = int(m.end() == len(text))
                    elif sign in "{[":
                        if depth == 1:
                            buffer, started, begin = [], True, m.start()
                        depth += 1
                    else:
                        depth -= 1
                        if depth == 1:
                            item = "".join([*buffer, text[begin : m.end()]])
                            if not started:
                                out.append((*at, row, "head", item))
                            elif item[0] == "{":
                                out.append((*at, row, "whole", item))
                            row += 1
                            buffer, started, begin = [], True, m.end()
                if depth > 1:
                    buffer.append(text[begin:])
                if len(out) >= 1000:
                    yield batch_of(out)
                    out.clear()
        flush()
        yield batch_of(out)

    def batch_of(rows):
        import pyarrow as pa

        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "row", "role", "item"])

    # One row per split; the rows of a split stay together and in order, as the states are broadcast.
    states = F.broadcast(split_states(spark, path))
    return _fragments(spark, path).join(states, ["file", "block"]).select("file", "block", "value", "quoted", "depth").mapInArrow(cut, PIECES)


def order_of(file: Column, block: Column, row: Column) -> Column:
    return F.struct(file.alias("file"), block.alias("block"), row.alias("row")).alias(SEQ)


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(item, seq): the objects of the arrays in the files at ``path``, as text, in their order."""
    from corvane.session import materialise

    pieces = materialise(_pieces(spark, path), "pieces")
    whole = pieces.where("role = 'whole'").select("item", order_of(F.col("file"), F.col("block"), F.col("row")))
    # At most two pieces a split: a tail opens an element, middles and a head follow.
    crossing = pieces.where("role <> 'whole'")
    ordered = Window.partitionBy("file").orderBy("block", F.when(F.col("role") == "tail", 1).otherwise(0))
    crossing = crossing.withColumn("element", F.sum(F.when(F.col("role") == "tail", 1).otherwise(0)).over(ordered))
    parts = F.array_sort(F.collect_list(F.struct("block", "item")))
    joined = crossing.groupBy("file", "element").agg(F.min("block").alias("block"), parts.alias("parts"))
    joined = joined.withColumn("item", F.array_join(F.transform("parts", lambda p: p["item"]), ""))
    joined = joined.where(F.col("item").startswith("{"))
    return whole.unionByName(joined.select("item", order_of(F.col("file"), F.col("block"), F.lit(LAST_ROW).cast("bigint"))))
