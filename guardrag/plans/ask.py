"""The ask pipeline (A11, A12): a table of questions in, one audit row per question out.

Plan shape: gates are plain columns (no shuffle); rejected rows leave before any
embedding or search; survivors are scrubbed, embedded and checkpointed once (so
a model-backed embedder runs once per question even though retrieval reads the
block twice); exact top-k (see ``operators.retrieval``); a bounded per-question
``collect_list`` assembles context; the answer slot and output safety run only
on questions that pass the confidence gate; the four outcomes are unioned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardrag.config import AskOptions
from guardrag.functions import gates, pii
from guardrag.functions.embedding import Embedder, hashing_embedder
from guardrag.functions.safety import template_answer, with_output_safety
from guardrag.operators.answer import assemble_context
from guardrag.operators.audit import AUDIT_COLUMNS, correlation_id, write_answers, write_audit
from guardrag.operators.audit_reports import check_observed, observed
from guardrag.operators.pii_report import pii_type_report
from guardrag.operators.retrieval import topk_batch
from guardrag.session import materialize

Answerer = Callable[[Column, Column], Column]


def _no_sources() -> Column:
    return F.array().cast("array<string>")


def prepare_queries(queries: DataFrame, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """``(query_id, query)``; a missing query text counts as the empty string, and a question
    without an id (or a table without that column) gets a fresh one."""
    fresh = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    given = F.coalesce(F.col(query_id).cast("string"), fresh) if query_id in queries.columns else fresh
    return queries.select(given.alias("query_id"), F.coalesce(F.col(query_col).cast("string"), F.lit("")).alias("query"))


def route(queries: DataFrame, opts: AskOptions = AskOptions()) -> DataFrame:
    """G1–G6, G8 (first two gates): adds ``outcome`` ∈ {too_long, off_topic, null}."""
    rel = gates.relevance("query", opts.relevance)
    return queries.withColumn("_rel", rel).withColumn(
        "outcome",
        F.when(gates.is_too_long("query", opts.query.max_query_length), F.lit("too_long"))
        .when(~F.col("_rel.is_relevant"), F.lit("off_topic"))
        .otherwise(F.lit(None).cast("string")),
    )


def _no_counts() -> Column:
    return F.array_repeat(F.lit(0), len(pii.PATTERNS))


def _audit_row(df: DataFrame, *, random_ids: bool = False, scrubbed_query, scrubbed_response, sources, top, length, relevance, low, n_in,
               n_out, disclaimer, as_of: Column, in_counts: Column | None = None,
               out_counts: Column | None = None) -> DataFrame:
    return df.select(
        "query_id",
        "outcome",
        correlation_id("query_id", random_ids).alias("correlation_id"),
        as_of.alias("event_ts"),
        scrubbed_query.alias("scrubbed_query"),
        scrubbed_response.alias("scrubbed_response"),
        sources.alias("sources"),
        top.cast("float").alias("top_confidence_score"),
        (length if isinstance(length, Column) else F.lit(length)).alias("was_rejected_for_length"),
        (relevance if isinstance(relevance, Column) else F.lit(relevance)).alias("was_rejected_for_relevance"),
        (low if isinstance(low, Column) else F.lit(low)).alias("was_low_confidence"),
        n_in.cast("int").alias("input_pii_redaction_count"),
        n_out.cast("int").alias("output_pii_redaction_count"),
        (disclaimer if isinstance(disclaimer, Column) else F.lit(disclaimer)).alias("disclaimer_appended"),
        # Per-type redaction counts (pattern order) behind the two PII warnings.
        (_no_counts() if in_counts is None else in_counts).alias("input_pii_type_counts"),
        (_no_counts() if out_counts is None else out_counts).alias("output_pii_type_counts"),
    )


def ask_batch(queries: DataFrame, chunks: DataFrame, opts: AskOptions = AskOptions(), *,
              embedder: Embedder | None = None, answerer: Answerer | None = None, as_of: Column | None = None,
              checkpoint: bool = True, strategy: str = "auto") -> DataFrame:
    """A12. ``queries``: (query_id, query), where ids may be missing or repeated: every row
    is one question with one audit record, kept apart by an internal row number; ``chunks``: a validated store
    (chunk_id, content, title, embedding). Returns the audit table:
    ``query_id, outcome`` + the 12 audit fields. The answer table (S7) is
    ``answers_of(audit)``.
    """
    embedder = embedder or hashing_embedder(64)
    answerer = answerer or template_answer
    as_of = as_of if as_of is not None else F.current_timestamp()
    # Written once: fresh ids and row numbers stay the same whatever is retried, and the gates run once.
    q = materialize(route(prepare_queries(queries).withColumn("_row", F.monotonically_increasing_id()), opts).drop("_rel"), "ask-questions")

    # Both rejection outcomes in one pass over the questions (built-in expressions only).
    is_long = F.col("outcome") == "too_long"
    off_topic_q = pii.scrub_text("query") if opts.scrub_rejected else F.col("query")
    rejected = _audit_row(
        q.filter(F.col("outcome").isNotNull()), random_ids=opts.random_correlation_ids,
        scrubbed_query=F.when(is_long, gates.truncation_marker("query")).otherwise(off_topic_q),
        scrubbed_response=F.when(is_long, gates.too_long_message(opts.query)).otherwise(
            F.lit(opts.relevance.off_topic_response)),
        sources=_no_sources(), top=F.lit(0.0), length=is_long, relevance=~is_long, low=False, n_in=F.lit(0),
        n_out=F.lit(0), disclaimer=False, as_of=as_of)

    survivors = pii.with_scrub(q.filter(F.col("outcome").isNull()).select("_row", "query_id", "query"), "query", "in")
    survivors = survivors.select("_row", "query_id", "in_text", "in_count", "in_counts").withColumn("embedding", embedder(F.col("in_text")))
    survivors = materialize(survivors, "ask-survivors")

    ranked = topk_batch(chunks, survivors.select("_row", "embedding"), opts.query.top_k, query_id="_row",
                        carry=["content", "title"], opts=opts.retrieval, strategy=strategy, unique_ids=True)
    ctx = assemble_context(ranked, "_row")
    joined = survivors.drop("embedding").join(ctx, "_row", "left").withColumn(
        "top_score", F.coalesce(F.col("top_score"), F.lit(0.0).cast("float")))
    joined = joined.withColumn("outcome", F.when(
        gates.is_low_confidence("top_score", opts.query.confidence_threshold), F.lit("low_confidence")
    ).otherwise(F.lit("answered")))
    if checkpoint:
        # One row per surviving question (context ≤ k chunks): the store scan runs once,
        # and the answer slot below sees only the rows that passed the confidence gate.
        joined = materialize(joined, "ask-retrieved")

    low = _audit_row(
        joined.filter(F.col("outcome") == "low_confidence"), random_ids=opts.random_correlation_ids,
        scrubbed_query=F.col("in_text"), scrubbed_response=F.lit(opts.query.low_confidence_response),
        sources=_no_sources(), top=F.col("top_score"), length=False, relevance=False, low=True,
        n_in=F.col("in_count"), n_out=F.lit(0), disclaimer=False, as_of=as_of, in_counts=F.col("in_counts"))

    answered = joined.filter(F.col("outcome") == "answered").withColumn(
        "_raw", answerer(F.col("in_text"), F.coalesce(F.col("context"), _no_sources()))
    )
    answered = with_output_safety(answered, "_raw", opts.disclaimer, "out")
    answered = _audit_row(
        answered, random_ids=opts.random_correlation_ids,
        scrubbed_query=F.col("in_text"), scrubbed_response=F.col("out_response"),
        sources=F.coalesce(F.col("sources"), _no_sources()), top=F.col("top_score"), length=False,
        relevance=False, low=False, n_in=F.col("in_count"), n_out=F.col("out_count"),
        in_counts=F.col("in_counts"), out_counts=F.col("out_counts"),
        disclaimer=F.col("out_disclaimer"), as_of=as_of)

    return rejected.unionByName(low).unionByName(answered)


def ask_pii_report(audit: DataFrame) -> DataFrame:
    """P12 over the ask pipeline: redactions by direction (input question /
    output answer) and type — the content of the two PII warnings as a table."""
    return pii_type_report(audit, "input_pii_type_counts", "input").unionByName(
        pii_type_report(audit, "output_pii_type_counts", "output"))


def run_ask(queries: DataFrame, chunks: DataFrame, audit_path: str, answers_path: str,
            opts: AskOptions = AskOptions(), **kwargs) -> tuple[DataFrame, DataFrame]:
    """A12 + S6 + S7: write the audit table (append, by event date) once, then the
    answer table as a projection of what was written — the pipeline, and any
    model-backed slot in it, runs once for both outputs. The write is observed: unless it has one record for
    each question, ``AuditMismatch`` is raised and no answer is written."""
    queries = materialize(prepare_queries(queries), "run-questions")  # counted and answered from one copy, also where ids are fresh
    audit, watch = observed(ask_batch(queries, chunks, opts, **kwargs))
    run_id = uuid.uuid4().hex
    spark = audit.sparkSession
    write_audit(audit, audit_path, run_id)
    check_observed(watch, queries.count())
    # ``run_id`` is a partition column: only this run's folders are read.
    written = spark.read.parquet(audit_path).filter(F.col("run_id") == run_id)
    write_answers(answers_of(written), answers_path, run_id)
    return written, spark.read.parquet(answers_path).filter(F.col("run_id") == run_id)


def answers_of(audit: DataFrame) -> DataFrame:
    """(query_id, answer, sources) — rejected rows carry the canned text and no sources."""
    return audit.select("query_id", F.col("scrubbed_response").alias("answer"), "sources")


__all__ = ["ask_batch", "answers_of", "ask_pii_report", "run_ask", "route", "prepare_queries", "AUDIT_COLUMNS"]
