"""Named queries of the corpus operators and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import COUNTING_SQL
from ..runtime import spread, table
from .cooccurrence import strong_pairs, term_pairs
from .encoding import decode_ids, encode_texts
from .frequencies import marked_terms, useless_terms
from .languages import identify_languages, language_model, mislabelled
from .mixing import mix_report, mixed_documents, short_sources
from .percentiles import monthly_percentiles, summary_percentiles, unfit_figures
from .topn import top_postings

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = identify_languages(documents, language_model(table(spark, d, "language_samples"), documents))
    return found.select("doc_id", "label", F.explode_outer("stretches").alias("at")).select("doc_id", "label", "at.*")


def queries() -> dict[str, Query]:
    """The corpus queries by name."""
    return {
        "p1_found": lambda spark, d: unfit_figures(table(spark, d, "lookup_samples"), table(spark, d, "lookup_summaries")),
        "p1_percentiles": lambda spark, d: summary_percentiles(
            table(spark, d, "lookup_samples"), table(spark, d, "lookup_summaries")
        ).select("period_start", "period_days", "term", "segment_access", "metric", "size", "median", "p95"),
        "p1_monthly": lambda spark, d: monthly_percentiles(table(spark, d, "lookup_samples")).withColumn(
            "month", F.date_format("month", "yyyy-MM")
        ),
        "p2_found": lambda spark, d: useless_terms(table(spark, d, "postings")),
        "p2_frequencies": lambda spark, d: marked_terms(table(spark, d, "postings")).select(
            "term", "occurrences", "documents", "mark"
        ),
        "p4_found": lambda spark, d: strong_pairs(table(spark, d, "postings")),
        "p4_pairs": lambda spark, d: term_pairs(table(spark, d, "postings")).select(
            F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"), "together", F.round("ratio", 6).alias("ratio")
        ),
        "p5_found": lambda spark, d: top_postings(table(spark, d, "postings")),
        "p6_ids": lambda spark, d: encode_texts(_texts(spark, d)),
        "p6_decoded": lambda spark, d: decode_ids(encode_texts(_texts(spark, d))),
        "p8_found": lambda spark, d: mislabelled(table(spark, d, "documents"), table(spark, d, "language_samples")),
        "p8_stretches": _stretches,
        "p7_found": lambda spark, d: short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")),
        "p7_shares": lambda spark, d: mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets")),
        "p7_mix": lambda spark, d: mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets")),
    }


_FREQUENCY_SQL = f"""
{COUNTING_SQL},
n as (select count(distinct document_id) as n from counting),
freq as (select term, cast(sum(term_frequency) as bigint) as occurrences, count(distinct document_id) as documents
         from counting group by 1),
marks as (select term, 'rare' as mark from freq where documents < 3
          union all select term, 'common' from freq, n where documents * 10 >= n.n)
"""

_PAIR_SQL = f"""
{COUNTING_SQL},
d as (select distinct document_id, term from counting),
n as (select count(distinct document_id) as n from d),
df as (select term, count(*) as df from d group by 1),
often as (select term from df, n where df >= 8 and df * 2000 >= n.n),
k as (select d.document_id, d.term from d join often using (term)),
c as (select a.term as term_a, b.term as term_b, count(*) as together
      from k a join k b on a.document_id = b.document_id and a.term < b.term group by 1, 2),
m as (select c.*, x.df as da, y.df as db, n.n as n from c, df x, df y, n
      where x.term = c.term_a and y.term = c.term_b and together >= 8 and together * 2000 >= n.n)
"""


_SAMPLE_SQL = """
s as (select sample_id, recorded_on, term, segment_access, segment_open_ms, total_ms from (
        select *, row_number() over (partition by sample_id order by coalesce(arrived_at, timestamp '9999-01-01')) as k
        from lookup_samples) where k = 1 or sample_id is null),
l as (select recorded_on, term, segment_access, 'segment_open' as metric, segment_open_ms as x from s
      union all select recorded_on, term, segment_access, 'total', total_ms from s),
x as (select * from l where x is not null and not isnan(x) and x >= 0),
g as (select distinct period_start, period_days, term, segment_access from lookup_summaries),
m as (select g.*, x.metric, x.x as x from g join x on x.segment_access = g.segment_access and (g.term = '*' or g.term = x.term)
        and x.recorded_on >= g.period_start
        and x.recorded_on < strftime(cast(g.period_start as date) + g.period_days, '%Y-%m-%d'))
"""


def oracle_sql() -> dict[str, str]:
    """Equivalent DuckDB SQL by query name."""
    return {
        "p1_found": f"""
            with {_SAMPLE_SQL},
            f as (select distinct summary_id, period_start, period_days, term, segment_access, metric, stat, v from (
              select *, 'segment_open' as metric, 'median' as stat, segment_open_median_ms as v from lookup_summaries
              union all select *, 'segment_open', 'p95', segment_open_p95_ms from lookup_summaries
              union all select *, 'total', 'median', total_median_ms from lookup_summaries
              union all select *, 'total', 'p95', total_p95_ms from lookup_summaries) where v is not null),
            c as (select f.summary_id, f.metric, f.stat, f.v, count(*) as n, count(*) filter (x <= v) as upto,
                    count(*) filter (x < v) as under
                  from f join m using (period_start, period_days, term, segment_access, metric) group by 1, 2, 3, 4)
            select distinct summary_id, metric, stat from c
            where upto * 100 < n * case stat when 'median' then 49 else 94 end
               or under * 100 > n * case stat when 'median' then 51 else 96 end""",
        "p1_percentiles": f"""
            with {_SAMPLE_SQL}
            select period_start, period_days, term, segment_access, metric, count(*) as size,
              quantile_disc(x, 0.5) as median, quantile_disc(x, 0.95) as p95
            from m group by 1, 2, 3, 4, 5""",
        "p1_monthly": f"""
            with {_SAMPLE_SQL}
            select metric, segment_access, strftime(try_cast(recorded_on as date), '%Y-%m') as month, count(*) as size,
              quantile_disc(x, 0.5) as median, quantile_disc(x, 0.95) as p95
            from x group by 1, 2, 3""",
        "p2_found": f"with {_FREQUENCY_SQL} select term, mark from marks",
        "p2_frequencies": f"with {_FREQUENCY_SQL} select term, occurrences, documents, mark from freq left join marks using (term)",
        "p4_found": f"with {_PAIR_SQL} select term_a, term_b from m where together * n >= 5 * da * db",
        "p4_pairs": f"""with {_PAIR_SQL},
            r as (select *, together * (n * 1.0::double) / (da * db) as ratio, cast(together as double) o, cast(da as double) a, cast(db as double) b,
                  cast(n as double) t from m),
            l as (select *, 2 * (o * ln(o * t / (a * b))
                  + case when a - o > 0 then (a - o) * ln((a - o) * t / (a * (t - b))) else 0 end
                  + case when b - o > 0 then (b - o) * ln((b - o) * t / ((t - a) * b)) else 0 end
                  + case when t - a - b + o > 0 then (t - a - b + o) * ln((t - a - b + o) * t / ((t - a) * (t - b))) else 0 end) as llr
                  from r)
            select term_a, term_b, together, round(ratio, 6) as ratio from l where ratio > 1 and llr >= 10.83""",
        "p5_found": f"""
            with {COUNTING_SQL}
            select segment_id, term, cast(place as int) as place, document_id from (
              select *, row_number() over (partition by segment_id, term order by term_frequency desc, document_id) as place
              from counting) where place <= 3""",
        "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
