"""Line deduplication across documents with DataFrame functions only.

Method: explode normalised lines, hash them, count distinct documents per hash, drop lines over the
threshold, reassemble the text by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.plans.durable import durable

#: Space and the five ASCII controls that count as white space at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is. Pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    """The lines of a text, trailing empty ones included; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_key(line: Column, min_chars: int) -> Column:
    """16 bytes that stand for a line's key, or null where the key is too short to count."""
    stripped = F.btrim(line, F.lit(BLANKS))
    return F.when(F.char_length(stripped) >= min_chars, F.unhex(F.md5(F.encode(ascii_lower(stripped), "UTF-8"))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with two more columns: ``kept_lines`` (array, in order) and ``n_lines`` (before dropping).

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points that occur in at least ``min_docs`` different ids lose all their lines,
    except in the largest id that holds the key.

    Defined cases: null text equals the empty text (one empty line); a key repeated inside one
    document counts once for it; rows with the same id are one document to the counts and each keep or
    lose the same keys; a null id holds lines that count as no document and lose nothing; an empty
    table gives an empty table; columns named as the two made here are replaced, any others pass through.

    The counts are combined before the shuffle, so a line held by a third of all documents is one row
    per task there. Only (id, position, hash) of long lines is joined; the skew join splits such a line.
    Text crosses one shuffle, on its id, and only for the join with the dropped positions. Work grows with a
    text's lines, and not with their product with the dropped ones.
    """
    # columns go by number meanwhile, so that no name of theirs can meet one of the lines' tables
    number = {c: f"c{k}" for k, c in enumerate(c for c in docs.columns if c not in ("kept_lines", "n_lines"))}
    rows = docs.toDF(*(number.get(c, f"gone{k}") for k, c in enumerate(docs.columns))).select(*number.values())
    unique = rows.where(F.col(number[id_col]).isNotNull()).groupBy(number[id_col]).count().where("count > 1").limit(1).count() == 0
    # what a row is known by while its lines are apart: its id, or where ids repeat a number of its own, stored to stay the same
    rows = rows.withColumn("row", F.col(number[id_col])) if unique else durable(rows.withColumn("row", F.monotonically_increasing_id()))
    own, text = F.col(number[id_col]), F.col(number[text_col])
    ids = rows.select("row", own.alias("id"), split_lines(text).alias("lines")).where("id is not null")
    keyed = F.transform("lines", lambda x: _long_key(x, min_chars))
    lines = ids.select("row", "id", F.posexplode(keyed).alias("pos", "key")).where("key is not null")
    per_doc = ids.select("id", F.explode(F.array_distinct(keyed)).alias("key")).where("key is not null")
    per_doc = per_doc if unique else per_doc.distinct()
    # stored, so that the join below has a plain exchange on both sides and can split the rows of a hot line
    spread = durable(per_doc.groupBy("key").agg(F.count("*").alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= min_docs))
    dropped = (
        lines.join(spread.select("key", "last"), "key").where("id <> last")
        .groupBy(F.col("row").alias("at")).agg(F.collect_list("pos").alias("out"))
    )
    whole = rows.withColumn("lines", split_lines(text)).join(dropped, F.col("row") == F.col("at"), "left")
    # the difference of two sets of positions is hashed and keeps its order, so a text's lines are walked once
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "out")
    stays = F.transform(left, lambda i: F.get("lines", i))
    kept = F.when(F.col("out").isNull(), F.col("lines")).otherwise(stays)
    return whole.select(*number.values(), kept, F.size("lines").cast("long")).toDF(*number, "kept_lines", "n_lines")
