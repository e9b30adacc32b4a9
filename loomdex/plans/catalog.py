"""Named queries of the core and the SQL that must agree with them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import encoded_postings, decoded_postings, varint_hex, varint_value, with_deltas, with_documents
from ..functions.text import clean_text, is_query_term, words
from ..operators.index import (
    dictionary_of,
    invariant_violations,
    manifest_totals,
    placed_texts,
    posting_lists,
    postings_of,
    segment_stats,
    table_corpus,
    unordered_lists,
    with_ordinals,
)
from ..runtime import cut, shared_dir, table
from ..sources.corpus import CorpusScan, corpus_faults, lines_of_texts
from ..sources.files import Files
from ..sources.storage import IndexStorage
from .build import build_segment, create_index, publish_table_segment
from .skew import dictionary_conflicts, posting_counts
from .snapshot import IndexSnapshot, batch_lookup, lookup_stats

Query = Callable[[SparkSession, str], DataFrame]

#: Terms that are looked up: common, the same in another case, rarer, rare, and missing.
TERMS = {"common": "the", "case": "The", "medium": "lookup", "rare": "frozen", "missing": "zzzmissing"}

#: DuckDB form of the counting postings; used by several oracles.
COUNTING_SQL = """
counting as (
  select segment_id, term, document_id, max(term_frequency) as term_frequency
  from postings
  where segment_id is not null and document_id is not null and term_frequency >= 1
    and regexp_full_match(term, '[A-Za-z0-9]+')
  group by 1, 2, 3)
"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table_corpus(table(spark, d, "documents"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return postings_of(_corpus(spark, d))


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    # As in a stored segment, the postings are written once and then read.
    return dictionary_of(cut(_postings(spark, d)))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return segment_stats(_dictionary(spark, d), placed_texts(table(spark, d, "documents")))


def _lookup(term: str) -> Query:
    return lambda spark, d: _stored_index(spark, d).query_term(term)


def _lookup_stats(spark: SparkSession, d: str) -> DataFrame:
    snapshot = _stored_index(spark, d)
    return lookup_stats(snapshot.dictionary, snapshot.segments, list(TERMS.values()))


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    keys = ["segment_id", "term"]
    deltas = with_deltas(_postings(spark, d))
    again = with_documents(deltas, keys, "local_document_id", "again")
    return again.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("again") != F.col("local_document_id")).alias("bad"))


def _codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Postings encoded to bytes and decoded again."""
    return decoded_postings(encoded_postings(_postings(spark, d))).where(F.col("error").isNull()).drop("error")


#: Index folders that were built, by application, kind and data directory.
_BUILT: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, d: str, kind: str, build: Callable[[IndexStorage, IndexSnapshot], None]) -> IndexSnapshot:
    """An index that is built once for an application and opened again by each query."""
    key = (spark.sparkContext.applicationId, kind, d)
    if key not in _BUILT:
        storage = IndexStorage(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
        build(storage, IndexSnapshot(storage))
        _BUILT[key] = storage.folder
    return IndexSnapshot(IndexStorage(spark, _BUILT[key]))


def _stored_index(spark: SparkSession, d: str) -> IndexSnapshot:
    """The documents as four published segments."""

    def build(storage: IndexStorage, snapshot: IndexSnapshot) -> None:
        documents = table(spark, d, "documents")
        for part in range(4):
            publish_table_segment(storage, snapshot, documents.where(F.pmod("doc_id", F.lit(4)) == part))

    return _index(spark, d, "tables", build)


def text_files(lines: DataFrame, key: str, value: str) -> list[str]:
    """Write lines in the order of ``key`` as text files; gives the files in order."""
    spark = lines.sparkSession
    folder = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    ordered = lines.repartitionByRange(4, key).sortWithinPartitions(key)
    ordered.select(F.col(value).alias("value")).write.text(folder, lineSep="\n")
    files = Files(spark)
    return [f"{folder}/{n}" for n in sorted(n for n, is_file in files.names(folder) if is_file and n.startswith("part-")) if files.size(f"{folder}/{n}")]


def _clean_files(spark: SparkSession, d: str) -> list[str]:
    documents = table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("c"))
    return text_files(documents.where(F.col("c") != ""), "doc_id", "c")


def _text_index(spark: SparkSession, d: str) -> IndexSnapshot:
    """The cleaned documents as lines of text files, checked, indexed and published as one segment."""
    return _index(spark, d, "text", lambda storage, snapshot: build_segment(storage, snapshot, _clean_files(spark, d)))


def _text_stats(spark: SparkSession, d: str) -> DataFrame:
    storage = IndexStorage(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    _, stats = create_index(storage, _clean_files(spark, d))
    return stats.to_df(spark).select("input_bytes", "document_count", "token_count", "unique_term_count", "posting_count", "segment_bytes")


def _text_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Terms and postings by ordinal: the first, the last and some between."""
    snapshot = _text_index(spark, d)
    count = snapshot.manifest.segments[0].term_count
    found = None
    for ordinal in sorted({0, 1, count // 2, count - 1}):
        term = snapshot.term_at(1, ordinal)
        rows = snapshot.postings_at(1, ordinal).select(F.lit(ordinal).cast("bigint").alias("ord"), F.lit(term).alias("term"), "local_document_id", "term_frequency")
        found = rows if found is None else found.unionByName(rows)
    return found


def _text_fault(spark: SparkSession, d: str) -> DataFrame:
    """The first fault of the documents as they are, each as one line."""
    documents = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.translate("text", "\n", " ").alias("v"))
    found = CorpusScan(spark, text_files(documents, "doc_id", "v"), check=True).checked()
    return spark.createDataFrame([(found.document_count, found.error)], "documents bigint, error string")


def _rejected_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct term of the postings table and whether a lookup of it is refused."""
    refused = F.udf(lambda t: not is_query_term(t), "boolean")
    terms = table(spark, d, "postings").select("term").distinct()
    return terms.select("term", refused("term").alias("refused"))


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """What checking finds in segments whose tables were altered: a posting lost, one twice, one changed, and a term record lost."""
    plain = _stored_index(spark, d)
    found = []
    for i, segment in enumerate(plain.manifest.segments):
        path = plain.storage.segment_path(segment.segment_id)
        copy = f"{shared_dir(spark)}/damaged-{uuid.uuid4().hex}"
        postings, dictionary = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "dictionary"))
        first = postings.agg(F.min(F.struct("term", "local_document_id")).alias("m")).select("m.*").first()
        here = (F.col("term") == first["term"]) & (F.col("local_document_id") == first["local_document_id"])
        if i == 0:
            postings = postings.where(~here)
        elif i == 1:
            postings = postings.unionByName(postings.where(here))
        elif i == 2:
            postings = postings.withColumn("term_frequency", F.when(here, F.lit(99)).otherwise(F.col("term_frequency")).cast("bigint"))
        else:
            dictionary = dictionary.where(F.col("term") != first["term"])
        postings.write.parquet(f"{copy}/postings")
        dictionary.write.parquet(f"{copy}/dictionary")
        digest = plain.storage.segment_digest(copy)
        found.append((segment.segment_id, plain.storage.segment_digest(path)["checksum"] == segment.checksum, digest["checksum"] == segment.checksum, digest["postings_rows"]))
    return spark.createDataFrame(found, "segment_id bigint, intact boolean, damaged_passes boolean, postings bigint")


def _stored_totals(spark: SparkSession, d: str) -> DataFrame:
    snapshot = _stored_index(spark, d)
    return manifest_totals(
        snapshot.segments.select(
            F.col("document_count").alias("documents"), F.col("length_bytes").alias("segment_bytes"), "term_count"
        )
    )


def _batch(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in TERMS.values()], "term string")
    return batch_lookup(_stored_index(spark, d).postings, terms).groupBy("term").agg(F.count("segment_id").alias("matched"))


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """The postings table as it is, with its faults."""
    return table(spark, d, "postings").select("segment_id", "term", "local_document_id", "term_frequency")


def queries() -> dict[str, Query]:
    """The core's queries by name."""
    found: dict[str, Query] = {
        "corpus_clean": lambda spark, d: table(spark, d, "documents")
        .select("doc_id", clean_text(F.col("text")).alias("c"))
        .where(F.col("c") != ""),
        "corpus_lines": lambda spark, d: lines_of_texts(table(spark, d, "documents")),
        "validation_errors": lambda spark, d: corpus_faults(table(spark, d, "documents")),
        "document_numbers": lambda spark, d: _corpus(spark, d).select(
            "segment_id", "local_document_id", clean_text(F.col("text")).alias("c")
        ),
        "token_count": lambda spark, d: table(spark, d, "documents").agg(
            F.coalesce(F.sum(F.size(words(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("n")
        ),
        "postings": _postings,
        "posting_lists": lambda spark, d: posting_lists(_postings(spark, d)).select(
            "segment_id", "term", "block", F.to_json("postings").alias("postings")
        ),
        "dictionary": _dictionary,
        "term_ordinals": lambda spark, d: with_ordinals(_postings(spark, d).select("segment_id", "term").distinct()).select(
            "segment_id", "term", F.col("term_ordinal").alias("ord")
        ),
        "segment_stats": _stats,
        "index_stats": lambda spark, d: _postings(spark, d)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("posting_count"), F.count(F.lit(1)).alias("terms")),
        "manifest_totals": lambda spark, d: manifest_totals(_stats(spark, d)),
        "published_totals": lambda spark, d: manifest_totals(
            table(spark, d, "manifest_segments").select(
                F.col("document_count").alias("documents"), F.col("length_bytes").alias("segment_bytes"), "term_count"
            )
        ),
        "lookup_stats": _lookup_stats,
        "batch_lookup": _batch,
        "stored_lookup": lambda spark, d: _stored_index(spark, d).query_term(TERMS["common"]),
        "stored_totals": _stored_totals,
        "delta_roundtrip": _roundtrip,
        "codec_postings": lambda spark, d: encoded_postings(_postings(spark, d))
        .groupBy("segment_id", "term")
        .agg(F.sum("document_frequency").alias("document_frequency"), F.sum(F.octet_length("encoded")).cast("bigint").alias("bytes")),
        "codec_bytes": lambda spark, d: encoded_postings(_postings(spark, d)).select("segment_id", "term", "block", F.hex("encoded").alias("encoded")),
        "codec_roundtrip": _codec_roundtrip,
        "codec_varint": lambda spark, d: table(spark, d, "dictionary")
        .select(F.explode(F.array("document_frequency", F.col("document_frequency") * 99_991, "postings_bytes")).alias("n"))
        .distinct()
        .select("n", varint_hex(F.col("n")).alias("bytes"), varint_value(F.unhex(varint_hex(F.col("n")))).alias("again")),
        "crc32": lambda spark, d: table(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc")),
        "invariants": lambda spark, d: invariant_violations(
            _postings(spark, d), placed_texts(table(spark, d, "documents")).groupBy("segment_id").agg(F.count(F.lit(1)).alias("documents"))
        ),
        "invariants_planted": lambda spark, d: invariant_violations(
            _planted(spark, d), table(spark, d, "manifest_segments").select("segment_id", F.col("document_count").alias("documents"))
        ),
        "unordered_lists": lambda spark, d: unordered_lists(posting_lists(_planted(spark, d))).groupBy("segment_id", "term").agg(
            F.min("document").alias("document"), F.min("previous").alias("previous")
        ),
        "text_stats": _text_stats,
        "text_lookup": lambda spark, d: _text_index(spark, d).query_term(TERMS["common"]),
        "text_ordinals": _text_ordinals,
        "text_fault": _text_fault,
        "rejected_terms": _rejected_terms,
        "damaged_segments": _damaged,
        "top_terms": lambda spark, d: _postings(spark, d)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .orderBy(F.desc("df"), "term")
        .limit(20),
        "p3_counts": lambda spark, d: posting_counts(table(spark, d, "postings")),
        "p3_found": lambda spark, d: dictionary_conflicts(table(spark, d, "postings"), table(spark, d, "dictionary")),
    }
    for name, term in TERMS.items():
        found[f"lookup_{name}"] = _lookup(term)
    return found


_VL = "case when {0} < 128 then 1 when {0} < 16384 then 2 when {0} < 2097152 then 3 when {0} < 268435456 then 4 else 5 end"

_BASE_SQL = f"""
cl as (select doc_id, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) as c from documents),
d as (select doc_id, c, cast(doc_id % 4 + 1 as bigint) as segment_id,
        cast(row_number() over (partition by doc_id % 4 order by doc_id) - 1 as bigint) as local_document_id
      from cl where c <> ''),
tok as (select segment_id, local_document_id, unnest(string_split(c, ' ')) as term from d),
post as (select segment_id, term, local_document_id, cast(count(*) as bigint) as term_frequency from tok group by 1, 2, 3),
dl as (select *, local_document_id - coalesce(lag(local_document_id) over (partition by segment_id, term order by local_document_id), 0) as delta
       from post),
dict as (select segment_id, term, cast(count(*) as bigint) as document_frequency,
           cast(sum({_VL.format("delta")} + {_VL.format("term_frequency")}) as bigint) as postings_bytes from dl group by 1, 2),
seg as (select segment_id, cast(count(*) as bigint) as term_count,
          cast(30 + sum(24 + {_VL.format("length(term)")} + length(term) + {_VL.format("document_frequency")} + postings_bytes) as bigint) as segment_bytes
        from dict group by 1),
docs as (select segment_id, count(*) as documents from d group by 1)
"""

#: Hexadecimal digits of a number's bytes.
_VARINT = "array_to_string(list_transform(range(0, " + _VL + "), lambda i: printf('%02X', (({0} >> (7 * i)) & 127) | case when i < " + _VL + " - 1 then 128 else 0 end)), '')"

#: The same as one segment of lines.
_TEXT_SQL = _BASE_SQL.replace("cast(doc_id % 4 + 1 as bigint) as segment_id", "cast(1 as bigint) as segment_id").replace(
    "over (partition by doc_id % 4 order by doc_id)", "over (order by doc_id)"
)

#: White space of the grammar: Unicode White_Space as an explicit class, which DuckDB's patterns know.
_WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _lookup_stats_sql(term: str) -> str:
    """One row of lookup statistics; the search is stepped through by recursion."""
    return f"""
    select '{term}' as term, cast(count(*) as bigint) as searched, cast(count(*) filter (found) as bigint) as matching,
      cast(coalesce(sum(c), 0) as bigint) as comparisons, cast(sum(df) as bigint) as matched, cast(sum(pb) as bigint) as bytes
    from (
      with recursive probe as (select segment_id, count(*) as n, sum(case when term < '{term}' then 1 else 0 end) as r,
            max(case when term = '{term}' then 1 else 0 end) = 1 as found,
            coalesce(sum(case when term = '{term}' then document_frequency end), 0) as df,
            coalesce(sum(case when term = '{term}' then postings_bytes end), 0) as pb from dict group by 1),
      bs as (select segment_id, cast(0 as bigint) as lo, cast(n as bigint) as hi, cast(0 as bigint) as c, false as done, r, found from probe
        union all
        select segment_id,
          case when found and (lo + hi) // 2 = r then lo when (lo + hi) // 2 < r then (lo + hi) // 2 + 1 else lo end,
          case when found and (lo + hi) // 2 = r then hi when (lo + hi) // 2 < r then hi else (lo + hi) // 2 end,
          c + 1, found and (lo + hi) // 2 = r, r, found from bs where not done and lo < hi)
      select probe.segment_id, any_value(probe.found) as found, max(bs.c) as c, any_value(df) as df, any_value(pb) as pb
      from probe join bs using (segment_id) group by 1)"""


def oracle_sql() -> dict[str, str]:
    """Equivalent DuckDB SQL by query name."""
    base = f"with {_BASE_SQL}"
    found = {
        "corpus_clean": f"{base} select doc_id, c from cl where c <> ''",
        "corpus_lines": """
            with l as (select doc_id, unnest(string_split(text, chr(10))) as ln,
                         generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
            c as (select doc_id, pos, trim(regexp_replace(ln, '[^A-Za-z0-9]+', ' ', 'g')) as c from l)
            select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as bigint) as local_document_id, c
            from c where c <> ''""",
        "validation_errors": f"""
            with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '') as toks from documents),
            b as (select doc_id, len(toks) as n, list_filter(toks, lambda x: not regexp_full_match(x, '[A-Za-z0-9]+')) as bad from t)
            select doc_id, cast(n as bigint) as n_tokens, cast(len(bad) as bigint) as n_bad, bad[1] as first_bad from b""",
        "document_numbers": f"{base} select segment_id, local_document_id, c from d",
        "token_count": f"{base} select count(*) as n from tok",
        "postings": f"{base} select * from post",
        "dictionary": f"{base} select * from dict",
        "term_ordinals": f"""{base} select segment_id, term,
            cast(row_number() over (partition by segment_id order by term) - 1 as bigint) as ord from dict""",
        "segment_stats": f"{base} select segment_id, documents, term_count, segment_bytes from docs join seg using (segment_id)",
        "index_stats": f"{base} select count(*) as posting_count, count(distinct term) as terms from post",
        "manifest_totals": f"""{base} select count(*) as segments, cast(sum(documents) as bigint) as documents,
            cast(sum(segment_bytes) as bigint) as bytes, cast(sum(term_count) as bigint) as term_entries from docs join seg using (segment_id)""",
        "published_totals": """select count(*) as segments, cast(sum(document_count) as bigint) as documents,
            cast(sum(length_bytes) as bigint) as bytes, cast(sum(term_count) as bigint) as term_entries from manifest_segments""",
        "lookup_stats": f"{base} " + " union all ".join(_lookup_stats_sql(t) for t in TERMS.values()),
        "stored_lookup": f"{base} select segment_id, local_document_id, term_frequency from post where term = '{TERMS['common']}'",
        "stored_totals": f"""{base} select count(*) as segments, cast(sum(documents) as bigint) as documents,
            cast(sum(segment_bytes) as bigint) as bytes, cast(sum(term_count) as bigint) as term_entries from docs join seg using (segment_id)""",
        "batch_lookup": f"""{base}, w as (select unnest({list(TERMS.values())}) as term)
            select w.term, count(post.term) as matched from w left join post on post.term = w.term group by 1""",
        "delta_roundtrip": f"{base} select count(*) as total, cast(0 as bigint) as bad from post",
        "posting_lists": f"""{base} select segment_id, term, local_document_id // 65536 as block,
            cast(to_json(list({{'local_document_id': local_document_id, 'term_frequency': term_frequency}} order by local_document_id)) as varchar) as postings
            from post group by 1, 2, 3""",
        "codec_postings": f"{base} select segment_id, term, document_frequency, postings_bytes as bytes from dict",
        "codec_bytes": f"""{base} select segment_id, term, local_document_id // 65536 as block,
            string_agg({_VARINT.format("delta")} || {_VARINT.format("term_frequency")}, '' order by local_document_id) as encoded
            from dl group by 1, 2, 3""",
        "codec_varint": f"""with v as (select distinct unnest([document_frequency, document_frequency * 99991, postings_bytes]) as n from dictionary)
            select n, case when n between 0 and 4294967295 then {_VARINT.format("n")} end as bytes,
              case when n between 0 and 4294967295 then n end as again from v""",
        "crc32": """
            with t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                         lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
            h as (select doc_id, hex(encode(text)) as h from documents),
            b as (select doc_id, case when h is not null then list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint) end as b from h)
            select doc_id, case when b is not null then xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295::bigint) end as crc
            from b, t""",
        "invariants_planted": """
            with g as (select segment_id, term, local_document_id, count(*) as n, min(term_frequency) as tf from postings group by 1, 2, 3),
            j as (select g.*, m.document_count as documents from g left join manifest_segments m using (segment_id))
            select count(*) filter (coalesce(term, '') = '') as empty_term, count(*) filter (coalesce(tf, 0) < 1) as zero_tf,
              count(*) filter (local_document_id < 0 or local_document_id >= coalesce(documents, 0)) as unknown_doc,
              count(*) filter (n > 1) as repeated_doc from j""",
        "unordered_lists": """
            select segment_id, term, min(local_document_id) as document, min(local_document_id) as previous
            from (select segment_id, term, local_document_id from postings where local_document_id is not null group by 1, 2, 3 having count(*) > 1) group by 1, 2""",
        "text_stats": f"""with {_TEXT_SQL}
            select (select cast(sum(length(c) + 1) as bigint) from d) as input_bytes, (select count(*) from d) as document_count,
              (select count(*) from tok) as token_count, term_count as unique_term_count, (select count(*) from post) as posting_count,
              segment_bytes from seg""",
        "text_lookup": f"with {_TEXT_SQL} select segment_id, local_document_id, term_frequency from post where term = '{TERMS['common']}'",
        "text_ordinals": f"""with {_TEXT_SQL},
            o as (select term, cast(row_number() over (order by term) - 1 as bigint) as ord, count(*) over () as n from dict)
            select ord, term, local_document_id, term_frequency from o join post using (term) where ord in (0, 1, n // 2, n - 1)""",
        "text_fault": f"""
            with t as (select cast(row_number() over (order by doc_id) as bigint) as line,
                   list_filter(regexp_split_to_array(replace(text, chr(10), ' '), '{_WS}'), lambda x: x <> '') as toks from documents where text is not null),
            b as (select line, len(toks) as n, list_filter(toks, lambda x: not regexp_full_match(x, '[A-Za-z0-9]+'))[1] as bad from t),
            e as (select line, case when n = 0 then 'document on line ' || line || ' is empty'
                    when bad is not null then 'token ''' || bad || ''' on line ' || line || ' is not ASCII alphanumeric' end as error from b)
            select (select count(*) from t) as documents, (select arg_min(error, line) from e where error is not null) as error""",
        "rejected_terms": "select distinct term, not coalesce(regexp_full_match(term, '[A-Za-z0-9]+'), false) as refused from postings",
        "damaged_segments": f"""{base} select segment_id, true as intact, false as damaged_passes,
            count(*) + case segment_id when 1 then -1 when 2 then 1 else 0 end as postings from post group by 1""",
        "codec_roundtrip": f"{base} select * from post",
        "invariants": """select cast(0 as bigint) as empty_term, cast(0 as bigint) as zero_tf,
            cast(0 as bigint) as unknown_doc, cast(0 as bigint) as repeated_doc""",
        "top_terms": f"{base} select term, count(*) as df from post group by 1 order by 2 desc, 1 limit 20",
        "p3_counts": f"with {COUNTING_SQL} select segment_id, term, count(*) as postings from counting group by 1, 2",
        "p3_found": f"""
            with {COUNTING_SQL}, n as (select segment_id, term, count(*) as n from counting group by 1, 2)
            select distinct coalesce(n.segment_id, d.segment_id) as segment_id, coalesce(n.term, d.term) as term
            from n full join dictionary d on n.segment_id = d.segment_id and n.term = d.term
            where n.n is null and d.document_frequency is distinct from 0
               or n.n is not null and d.document_frequency is distinct from n.n""",
    }
    for name, term in TERMS.items():
        found[f"lookup_{name}"] = f"{base} select segment_id, local_document_id, term_frequency from post where term = '{term}'"
    return found
