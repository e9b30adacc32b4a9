"""The engine's one relation, postings, and what is derived from it."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import DOCUMENT_RANGE, document_block, varint_length
from ..functions.text import words
from ..runtime import shuffle_width
from .postings import TERM_PATTERN
from .salted import heavy_keys
from .slices import deal, running_total, slice_bounds, with_slice

#: Bytes of a segment without terms, and of each term besides its name, counts and postings.
SEGMENT_BYTES, TERM_BYTES = 30, 24
SLICES_EACH = 2


def number_documents(documents: DataFrame, key: str = "doc_id", segment: str = "segment_id", bounds: list | None = None) -> DataFrame:
    """Add ``local_document_id``, 0-based within each segment in the order of ``key``, and ``_slice``.

    The numbers come from range slices, so a segment of any size is spread over all
    partitions. Keys should be whole numbers and unique in their segment; rows with a
    null key come first. ``bounds`` of the slices may be given if they come cheaper from
    elsewhere; any ascending ones are right.
    """
    width = shuffle_width(documents.sparkSession)
    if bounds is None:
        bounds = slice_bounds(documents, key, width * SLICES_EACH)
    sliced = with_slice(documents, F.col(key), bounds).withColumn("_one", F.lit(1))
    counted = running_total(sliced, [segment], [key], "_one", "_n", width)
    return counted.withColumn("local_document_id", (F.col("_n") - 1).cast("bigint")).drop("_one", "_n")


def placed_texts(documents: DataFrame, segments: int = 4) -> DataFrame:
    """(doc_id, text, segment_id) of the texts that clean to something, dealt out to segments by doc_id.

    Null and empty texts and those that clean to nothing are no documents.
    """
    some = documents.select("doc_id", "text").where(F.col("text").rlike("[A-Za-z0-9]"))
    return some.withColumn("segment_id", (F.pmod("doc_id", F.lit(segments)) + 1).cast("bigint"))


def table_corpus(documents: DataFrame, segments: int = 4) -> DataFrame:
    """(_slice, segment_id, local_document_id, text) of ``placed_texts``; the texts are shuffled once, by ``_slice``."""
    bounds = slice_bounds(documents, "doc_id", shuffle_width(documents.sparkSession) * SLICES_EACH)
    return number_documents(placed_texts(documents, segments), bounds=bounds).select(
        "_slice", "segment_id", "local_document_id", "text"
    )


def term_frequencies(corpus: DataFrame, tokens: Column) -> DataFrame:
    """(segment_id, term, local_document_id, term_frequency) of a corpus; empty tokens don't count.

    A corpus that was dealt out by ``_slice`` has each document in one task, so its terms
    are counted there without a shuffle. Otherwise tokens are counted on the map side
    first, and the shuffle is keyed by term and document together, so that neither a
    common term nor a long document fills one task.
    """
    where = ["_slice"] if "_slice" in corpus.columns else []
    flat = corpus.select(*where, "segment_id", "local_document_id", F.explode(tokens).alias("term")).where(F.col("term") != "")
    counted = flat.groupBy(*where, "segment_id", "term", "local_document_id").agg(F.count(F.lit(1)).alias("term_frequency"))
    return counted.drop(*where)


def postings_of(corpus: DataFrame, text: str = "text") -> DataFrame:
    """Postings of texts, which are cleaned on the way."""
    return term_frequencies(corpus, words(F.col(text)))


def posting_lists(postings: DataFrame) -> DataFrame:
    """(segment_id, term, block, postings): the postings of each term as arrays by document range, in the order of documents."""
    pairs = F.sort_array(F.collect_list(F.struct("local_document_id", "term_frequency")))
    return postings.groupBy("segment_id", "term", document_block("local_document_id").alias("block")).agg(pairs.alias("postings"))


def dictionary_of(postings: DataFrame) -> DataFrame:
    """(segment_id, term, document_frequency, postings_bytes) of postings that are unique per document.

    The bytes need the document before in the same term. A hot term is cut into document
    ranges, and the last document of the earlier ranges enters each range as one more
    row, so no term has to fit into one task.
    """
    keys = ["segment_id", "term"]
    # With the same condition everywhere, the three uses read one shuffle of the postings.
    known = [F.col(c).isNotNull() for c in (*keys, "local_document_id")]
    postings = postings.where(reduce(and_, known, F.col("term_frequency") > 0))
    hot = heavy_keys(postings, keys).select(*keys, F.lit(True).alias("_hot"))
    # At most HEAVY_SHARE rows, whatever the size of the data.
    ranged = postings.join(F.broadcast(hot), keys, "left").select(
        *keys,
        F.when(F.col("_hot"), F.floor(F.col("local_document_id") / DOCUMENT_RANGE)).otherwise(F.lit(0)).alias("_slice"),
        "local_document_id",
        "term_frequency",
        "_hot",
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.where("_hot").groupBy(*keys, "_slice").agg(F.max("local_document_id").alias("_max"))
    starts = last.withColumn("local_document_id", F.max("_max").over(earlier)).where(F.col("local_document_id").isNotNull())
    rows = ranged.drop("_hot").unionByName(
        starts.select(*keys, "_slice", "local_document_id", F.lit(None).cast("bigint").alias("term_frequency"))
    )
    by = Window.partitionBy(*keys, "_slice").orderBy("local_document_id")
    deltas = rows.withColumn(
        "_delta", F.col("local_document_id") - F.coalesce(F.lag("local_document_id").over(by), F.lit(0))
    ).where(F.col("term_frequency").isNotNull())
    size = varint_length(F.col("_delta")) + varint_length(F.col("term_frequency"))
    parts = deltas.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("document_frequency"), F.sum("_b").alias("postings_bytes"))


def term_number(term: Column) -> Column:
    """A whole number of the first seven bytes of a term, which never falls as the term grows in byte order."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(term, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def with_ordinals(dictionary: DataFrame) -> DataFrame:
    """Add ``term_ordinal``: 0-based rank of the term in byte order within its segment, by range slices."""
    width = shuffle_width(dictionary.sparkSession)
    numbered = dictionary.withColumn("_number", term_number(F.col("term")))
    bounds = slice_bounds(numbered, "_number", width * SLICES_EACH)
    sliced = with_slice(numbered, F.col("_number"), bounds).withColumn("_one", F.lit(1))
    ranked = running_total(sliced, ["segment_id"], ["term"], "_one", "_n", width)
    return ranked.withColumn("term_ordinal", (F.col("_n") - 1).cast("bigint")).drop("_slice", "_one", "_n", "_number")


def sorted_postings(postings: DataFrame) -> DataFrame:
    """Postings of one segment in the order of term and document, with ``part`` and ``posting_bytes``.

    Parts are range slices of that order, one after the other; a term that fills several
    is cut by document, so parts stay in order. ``posting_bytes`` is what a posting takes
    after the one before it in its part and term; null for the first, whose distance
    depends on earlier parts. Postings may come with ``_number``, the ``term_number`` of their term.
    """
    width = shuffle_width(postings.sparkSession)
    numbered = postings if "_number" in postings.columns else postings.withColumn("_number", term_number(F.col("term")))
    bounds = slice_bounds(numbered, "_number", width * SLICES_EACH)
    sliced = with_slice(numbered, F.col("_number"), bounds)
    copies = {int(b): n for b, n in Counter(bounds).items() if n > 1}
    if copies:
        # A number that fills several slices stands for one hot term, whose rows are dealt out by document within those;
        # other terms with the same first bytes go before or behind it. As many rows as slices, whatever the data.
        spark = postings.sparkSession
        known = F.broadcast(spark.createDataFrame(list(copies.items()), "_number bigint, _copies int"))
        counts = numbered.join(known, "_number").groupBy("_number", "_copies", "term").agg(F.count(F.lit(1)).alias("_n"))
        hot = F.broadcast(counts.groupBy("_number", "_copies").agg(F.max_by("term", F.struct("_n", "term")).alias("_hot")))
        last = postings.agg(F.max("local_document_id")).first()[0] or 0
        place = F.floor((F.lit(last) - F.col("local_document_id")) * (F.col("_copies") + 1) / F.lit(last + 1))
        back = F.when(F.col("term") < F.col("_hot"), F.col("_copies")).when(F.col("term") == F.col("_hot"), place).otherwise(F.lit(0))
        joined = sliced.join(hot, "_number", "left")
        sliced = joined.withColumn("_slice", (F.col("_slice") - F.coalesce(back, F.lit(0))).cast("int"))
    by = Window.partitionBy("_slice", "term").orderBy("local_document_id")
    delta = F.col("local_document_id") - F.lag("local_document_id").over(by)
    size = (varint_length(delta) + varint_length(F.col("term_frequency"))).cast("int")
    rows = deal(sliced, width).withColumn("posting_bytes", size)
    return rows.select("segment_id", "term", "local_document_id", "term_frequency", F.col("_slice").alias("part"), "posting_bytes").sortWithinPartitions(
        "part", "term", "local_document_id"
    )


def dictionary_of_parts(postings: DataFrame) -> DataFrame:
    """(segment_id, term, part, document_frequency, postings_bytes) of postings from ``sorted_postings``.

    Rows are added up on the map side, so one row for each term and part is shuffled; the
    first posting of each part takes the distance from the last of the part before.
    ``part`` is the first in which the term stands.
    """
    keys = ["segment_id", "term"]
    first = F.min_by("term_frequency", "local_document_id").alias("_tf")
    parts = postings.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("posting_bytes"), F.lit(0)).alias("_b"), first,
        F.min("local_document_id").alias("_low"), F.max("local_document_id").alias("_high"),
    )
    before = F.lag("_high").over(Window.partitionBy(*keys).orderBy("part"))
    head = varint_length(F.col("_low") - F.coalesce(before, F.lit(0))) + varint_length(F.col("_tf"))
    return parts.withColumn("_b", F.col("_b") + head).groupBy(*keys).agg(
        F.min("part").alias("part"), F.sum("_n").alias("document_frequency"), F.sum("_b").alias("postings_bytes")
    )


def ordinals_of_parts(dictionary: DataFrame) -> DataFrame:
    """Add ``term_ordinal`` to a dictionary whose ``part`` is in the order of terms: terms of earlier parts, and the place in its own."""
    counts = dictionary.groupBy("segment_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each part, as many as a shuffle has partitions.
    earlier = Window.partitionBy("segment_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("segment_id", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("segment_id", "part").orderBy("term"))
    ranked = dictionary.withColumn("_place", place).join(F.broadcast(offsets), ["segment_id", "part"])
    return ranked.withColumn("term_ordinal", (F.col("_before") + F.col("_place") - 1).cast("bigint")).drop("_before", "_place")


def term_bytes() -> Column:
    """Bytes of a dictionary record with its postings in the segment format."""
    name = F.octet_length("term")
    return TERM_BYTES + varint_length(name) + name + varint_length(F.col("document_frequency")) + F.col("postings_bytes")


def segment_stats(dictionary: DataFrame, documents: DataFrame) -> DataFrame:
    """(segment_id, documents, term_count, segment_bytes) of every segment that has rows in ``documents``."""
    terms = dictionary.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("term_count"), (F.sum(term_bytes()) + SEGMENT_BYTES).cast("bigint").alias("segment_bytes")
    )
    documents = documents.groupBy("segment_id").agg(F.count(F.lit(1)).alias("documents"))
    return documents.join(terms, "segment_id", "left").select(
        "segment_id",
        "documents",
        F.coalesce("term_count", F.lit(0)).alias("term_count"),
        F.coalesce("segment_bytes", F.lit(SEGMENT_BYTES)).cast("bigint").alias("segment_bytes"),
    )


def manifest_totals(stats: DataFrame) -> DataFrame:
    """Totals over segments; term entries are the sum of the dictionaries, not of distinct terms."""
    return stats.agg(
        F.count(F.lit(1)).alias("segments"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("segment_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("term_count"), F.lit(0)).alias("term_entries"),
    )


def unordered_lists(lists: DataFrame) -> DataFrame:
    """(segment_id, term, document, previous): the first place of each posting list at which documents don't strictly increase.

    ``lists`` are as from ``posting_lists``, in the order in which they would be encoded.
    """
    documents = F.transform("postings", lambda p: p["local_document_id"])
    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("_d") - 1), lambda i: F.struct(F.get("_d", i).alias("document"), F.get("_d", i - 1).alias("previous"))),
        lambda p: p["previous"] >= p["document"],
    )
    several = lists.select("segment_id", "term", documents.alias("_d")).where(F.size("_d") > 1)
    return several.select("segment_id", "term", F.get(pairs, F.lit(0)).alias("at")).where(F.col("at").isNotNull()).select("segment_id", "term", "at.*")


def invalid_records() -> Column:
    """Whether a stored dictionary record breaks a rule: a term of letters and digits, documents and bytes of at least 1."""
    fine = F.col("term").rlike(TERM_PATTERN) & (F.col("document_frequency") > 0) & (F.col("postings_bytes") > 0) & (F.col("term_ordinal") >= 0)
    return ~F.coalesce(fine, F.lit(False))


def invariant_violations(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for a sound index: empty_term, zero_tf, unknown_doc, repeated_doc.

    ``documents`` has (segment_id, documents). Order is a matter of the sorted store, so
    what is left of strictly increasing documents is that none is repeated.
    """
    keys = ["segment_id", "term", "local_document_id"]
    repeats = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("term_frequency").alias("term_frequency"))
    return repeats.join(documents, "segment_id", "left").agg(
        F.count_if(F.coalesce("term", F.lit("")) == "").alias("empty_term"),
        F.count_if(F.coalesce("term_frequency", F.lit(0)) < 1).alias("zero_tf"),
        F.count_if(
            (F.col("local_document_id") < 0) | (F.col("local_document_id") >= F.coalesce("documents", F.lit(0)))
        ).alias("unknown_doc"),
        F.count_if(F.col("_n") > 1).alias("repeated_doc"),
    )
