"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so, so equal stretches give equal chunks wherever they stand. Equal chunks get one
identifier: a 64-bit hash, numbered further where two chunks share the hash but not the SHA-256 of their bytes. A text is then the
ordered list of its chunk identifiers, and two texts are equal exactly when these lists are. Texts are read once; what moves between
executors is the hashes, about a twentieth of the bytes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import lower_ascii, session
from tidemark.session import materialise

MIN_CHUNK, MAX_CHUNK = 512, 8192


def _chars(remainder: int) -> str:
    """A class of the code points below 0x250 whose lowest three bits equal ``remainder``."""
    return "[" + "".join(rf"\x{{{c:x}}}" for c in range(0x20, 0x250) if c & 7 == remainder) + "]"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """Chunks of ``least`` to ``most`` characters that end behind four characters of given classes; else ``most`` or the rest."""
    return f"(?s).{{{least - 4},{most - 4}}}?{_chars(4)}{_chars(0)}{_chars(5)}{_chars(2)}|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; joined, they are the text again. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def chunk_identifiers(pieces: DataFrame) -> DataFrame:
    """(hash, witness, chunk): one row for each distinct chunk. ``chunk`` is the hash with a number, 1 unless another chunk shares it.

    The number runs within one hash over distinct chunks, which are as good as always single: no window grows with the copies.
    """
    distinct = pieces.groupBy("hash", "witness").agg(F.count("*").alias("uses"))
    number = F.row_number().over(Window.partitionBy("hash").orderBy("witness"))
    return distinct.select(F.col("hash"), F.col("witness"), F.struct(F.col("hash").alias("h"), number.alias("n")).alias("chunk"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lower_ascii, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text_sha256, recipe) and the columns ``carry`` for every row: the ordered identifiers of the chunks of the
    normalised text."""
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    # the row number is only used once it is written: no later task can give a row another one
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text.alias("__t"), *carry)
    rows = rows.select("row", "doc_id", *carry, F.sha2("__t", 256).alias("text_sha256"),
                       F.transform(chunks(F.col("__t")), lambda c: F.struct(F.xxhash64(c).alias("hash"), F.unhex(F.sha2(c, 256)).alias("witness"))).alias("parts"))
    rows = materialise(rows, "chunked")
    pieces = rows.select("row", F.posexplode("parts").alias("at", "part")).select("row", "at", "part.hash", "part.witness")
    named = pieces.join(chunk_identifiers(pieces), ["hash", "witness"])
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "chunk"))).alias("list"))
    empty = F.array().cast("array<struct<h:bigint,n:int>>")
    return (rows.drop("parts").join(lists, "row", "left")
            .select("row", "doc_id", *carry, "text_sha256", F.coalesce(F.col("list.chunk"), empty).alias("recipe")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lower_ascii,
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks) and the columns ``carry`` for every row, dropped ones too.

    Texts are equal when their recipes are; the SHA-256 of the whole text is compared as well. The row with the largest id stays, a
    null id being smaller than any. Of repeated rows with that id exactly one stays. Null text counts as empty, and all empty texts
    are one group. An empty table gives an empty result; other columns are ignored whatever their names. Groups are counted before
    the shuffle, and the join that hands the kept id to all copies may be split, so a group may hold any share of the rows.
    """
    session(docs.sparkSession)
    rows = materialise(recipes(docs, id_col, text_col, normalise, carry), "recipes")
    groups = rows.groupBy("recipe", "text_sha256").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("keep"), F.count("*").alias("group_size"))
    groups = materialise(groups, "groups")  # both sides of the join then come from a plain exchange, which may be split
    joined = rows.join(groups, ["recipe", "text_sha256"])
    return joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == -rows["row"]).alias("kept"),
                         "text_sha256", F.size("recipe").alias("n_chunks"), *carry)
