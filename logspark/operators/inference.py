"""Requests for an outside model and the use of its responses.

The model is not called here. A request table goes out to batch inference, a response table comes
back and is joined on ``request_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.shapes import at, integer_at, is_object, list_at, present, text_at
from ..functions.tokens import TokenCounter
from ..model import SOURCE
from .budget import DIRECT, EMPTY, RESPONSE_RESERVE
from .chunking import assign_chunks

# Request settings and the analysis of a container without usable lines.
TEMPERATURE = 0.3
ANALYSIS_REPLY_TOKENS = 4000
CHUNK_REPLY_TOKENS = 2000
NOTHING_PROCESSED = "No logs could be processed within token limits"
NO_CHOICES = "no choices in response"
# What is said of a response that cannot be read, and its type.
UNREADABLE, MALFORMED = "the response is no JSON object", "malformed"

CHUNK, SYNTHESIS, EXECUTIVE = "chunk", "synthesis", "executive"


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def _request(scan_id: str, kind: Column, index: Column, total: Column, system: Column, user: Column,
             reply_tokens: Column, text_tokens: Column | None = None) -> list[Column]:
    """The request columns; ``n_logs`` and ``token_count`` tell what the packing put into it."""
    return [
        F.concat_ws("/", F.lit(scan_id), F.col(SOURCE), kind, index.cast("string"))
        .alias("request_id"),
        F.col(SOURCE), F.col("name"), kind.alias("kind"),
        index.cast("long").alias("chunk_index"), total.cast("long").alias("chunk_total"),
        messages(system, user).alias("messages"),
        F.lit(TEMPERATURE).alias("temperature"), reply_tokens.cast("int").alias("max_tokens"),
        F.col("n_logs"), F.col("token_count"),
        (F.lit(None) if text_tokens is None else text_tokens).cast("long").alias("text_tokens"),
    ]


def first_requests(budgets: DataFrame, chunks: DataFrame, scan_id: str, counter: TokenCounter,
                   prompts: P.Prompts = P.Prompts()) -> DataFrame:
    """One analysis request per direct container, one summary request per chunk otherwise.

    ``chunks`` comes from :func:`operators.chunking.chunk_texts`. A direct container none of whose
    lines was kept still gets its request, with an empty text. ``text_tokens`` counts a chunk's text.
    """
    c = F.col
    about = (SOURCE, "name", "strategy", "processed_count", "instructions")
    # An inner join, so that either side can be split when one container has most of the chunks.
    filled = budgets.select(*about).join(
        chunks.select(SOURCE, "chunk_index", "chunk_total", "text", "n_logs", "token_count"),
        SOURCE)
    blank = (budgets.filter((c("strategy") == DIRECT) & (c("lines_kept") == 0))
             .select(*about, F.lit(0).cast("long").alias("chunk_index"),
                     F.lit(1).cast("long").alias("chunk_total"), F.lit("").alias("text"),
                     F.lit(0).cast("long").alias("n_logs"),
                     F.lit(0).cast("long").alias("token_count")))
    rows = filled.unionByName(blank)
    direct = c("strategy") == DIRECT
    user = (F.when(direct, P.analysis_prompt(prompts, c("name"), c("text"), c("processed_count")))
            .otherwise(P.chunk_summary_prompt(prompts, c("name"), c("chunk_index") + 1,
                                              c("chunk_total"), c("text"))))
    return rows.select(*_request(
        scan_id, F.when(direct, DIRECT).otherwise(CHUNK), c("chunk_index"), c("chunk_total"),
        P.system_prompt(prompts, c("instructions")), user,
        F.when(direct, ANALYSIS_REPLY_TOKENS).otherwise(CHUNK_REPLY_TOKENS),
        F.when(~direct, counter.of_text(c("text")))))


def error_text(error: Column) -> Column:
    code = error["code"]
    return F.when(F.coalesce(code, F.lit("")) != "",
                  F.concat(code, F.lit(": "), error["message"])).otherwise(error["message"])


def unwrap(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with ``content``, ``usage_tokens`` and, if it failed, ``failure``."""
    failure = (F.when(F.col("error").isNotNull(), error_text(F.col("error")))
               .when(F.coalesce(F.size("choices"), F.lit(0)) <= 0, F.lit(NO_CHOICES)))
    content = F.get("choices", F.lit(0))["message"]["content"]
    answers = one_response(responses).select(
        "request_id", failure.alias("failure"),
        F.when(failure.isNull(), F.coalesce(content, F.lit(""))).alias("content"),
        F.coalesce(F.col("usage.total_tokens"), F.lit(0)).alias("usage_tokens"),
        F.lit(True).alias("_answered"))
    return (requests.join(answers, "request_id", "left")
            .withColumn("failure", F.when(F.col("_answered").isNull(), F.lit("no response"))
                        .otherwise(F.col("failure"))).drop("_answered"))


def responses_of(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Responses out of the JSON texts that providers return, whose shapes differ.

    Fields of no meaning here are passed over. The text of a choice is ``message.content``, as a
    string or as a list of parts whose texts are joined, or ``text``; a choice that is no object is
    none. Numbers may be strings; a missing total is the sum of its parts. An ``error`` is an object
    or a text, and JSON's null is none. A text that is no JSON object, or NULL, is an error too.
    """
    read = bodies.select("request_id", F.try_parse_json(F.col(body)).alias("_v"))
    whole, error = F.col("_v"), at(F.col("_v"), "$.error")

    def content(choice: Column) -> Column:
        parts = F.transform(F.filter(list_at(choice, "$.message.content"), is_object),
                            lambda part: F.coalesce(text_at(part, "$.text"), F.lit("")))
        return F.coalesce(F.array_join(parts, ""), text_at(choice, "$.message.content"),
                          text_at(choice, "$.text"))

    choices = F.transform(F.filter(list_at(whole, "$.choices"), is_object), lambda choice: F.struct(
        integer_at(choice, "$.index").cast("int").alias("index"),
        F.struct(text_at(choice, "$.message.role").alias("role"),
                 content(choice).alias("content")).alias("message"),
        text_at(choice, "$.finish_reason").alias("finish_reason")))
    prompt, completion = (integer_at(whole, f"$.usage.{part}_tokens")
                          for part in ("prompt", "completion"))
    usage = F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
                     F.coalesce(integer_at(whole, "$.usage.total_tokens"), prompt + completion)
                     .alias("total_tokens"))
    told = F.struct(
        F.coalesce(text_at(error, "$.message"), F.try_variant_get(error, "$", "string"))
        .alias("message"), text_at(error, "$.type").alias("type"),
        F.try_variant_get(error, "$.code", "string").alias("code"))
    unread = F.struct(F.lit(UNREADABLE).alias("message"), F.lit(MALFORMED).alias("type"),
                      F.lit(None).cast("string").alias("code"))
    return read.select("request_id", choices.alias("choices"), usage.alias("usage"),
                       F.when(~is_object(whole), unread).when(present(error), told).alias("error"))


def one_response(responses: DataFrame) -> DataFrame:
    """One response a request: a repeated request counts by its best answer, good before failed.

    Among several of a kind the one whose text is smallest is taken, so any order gives the same.
    """
    good = F.col("error").isNull() & (F.coalesce(F.size("choices"), F.lit(0)) > 0)
    body = F.struct("choices", "usage", "error")
    best = F.min_by(body, F.struct(~good, F.xxhash64(F.to_json(body)), F.to_json(body)))
    return responses.groupBy("request_id").agg(best.alias("_r")).select("request_id", "_r.*")


def chunk_summaries(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Summaries of the containers all of whose chunks were answered."""
    rows = unwrap(requests.filter(F.col("kind") == CHUNK), responses)
    complete = (rows.groupBy(SOURCE).agg(F.count_if(F.col("failure").isNotNull()).alias("bad"))
                .filter("bad = 0").select(SOURCE))
    return rows.join(complete, SOURCE, "left_semi").select(
        SOURCE, "name", "chunk_index", "chunk_total", F.col("content").alias("summary"))


def synthesis_requests(summaries: DataFrame, budgets: DataFrame, scan_id: str,
                       counter: TokenCounter, limit: int | Column,
                       prompts: P.Prompts = P.Prompts(), level: int = 0,
                       segment_span: int = 1 << 16) -> DataFrame:
    """Requests that combine the chunk summaries of each container, in chunk order.

    Summaries that fit into ``limit`` tokens together give one final request. More are packed, in
    order, into several (``chunk_total`` > 1): their replies are summaries for the next ``level``
    (see :func:`next_level`), until one request is left. So the text of a request stays bounded
    however many chunks a container has. ``limit`` may be a column over ``budgets``, such as
    :func:`summary_limit`.
    """
    c = F.col
    part = P.summary_part(c("chunk_index") + 1, c("summary"))
    if isinstance(limit, int):
        limited = summaries.withColumn("chunk_limit", F.lit(limit).cast("long"))
    else:
        limited = summaries.join(budgets.select(SOURCE, limit.cast("long").alias("chunk_limit")),
                                 SOURCE)
    lines = limited.select(
        SOURCE, "name", F.floor(c("chunk_index") / segment_span).cast("long").alias("segment"),
        c("chunk_index").alias("seq"), part.alias("line"), counter.of_text(part).alias("tokens"),
        "chunk_limit")
    packs = _pack(lines).join(budgets.select(SOURCE, "instructions"), SOURCE)
    return packs.select(*_request(
        scan_id, F.lit(SYNTHESIS if level == 0 else f"{SYNTHESIS}{level}"),
        c("chunk_index"), c("chunk_total"), P.system_prompt(prompts, c("instructions")),
        P.synthesis_prompt(prompts, c("name"), c("text")), F.lit(ANALYSIS_REPLY_TOKENS)))


def summary_limit(counter: TokenCounter, max_tokens: int,
                  prompts: P.Prompts = P.Prompts()) -> Column:
    """Tokens left for summaries in a synthesis request, as a column over budgets.

    What the reply, the system prompt and the template itself take is taken off.
    """
    template = P.synthesis_prompt(prompts, F.col("name"), F.lit(""))
    free = (F.lit(max_tokens - RESPONSE_RESERVE).cast("long") - F.col("system_tokens")
            - counter.of_text(template))
    return F.greatest(free, F.lit(1).cast("long"))


def _pack(lines: DataFrame) -> DataFrame:
    from .chunking import chunk_texts

    return chunk_texts(assign_chunks(lines))


def next_level(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Replies to one level's packed requests as the summaries of the next level.

    Only of containers all of whose packs were answered, and whose packs are fewer than the summaries
    that went into them: what can no longer be packed closer would never come to an end.
    """
    packs = requests.filter(F.col("kind").startswith(SYNTHESIS) & (F.col("chunk_total") > 1))
    answered = unwrap(packs, responses)
    going = (answered.groupBy(SOURCE).agg(
        F.count_if(F.col("failure").isNotNull()).alias("bad"),
        F.sum("n_logs").alias("given"), F.count("*").alias("left"))
        .filter((F.col("bad") == 0) & (F.col("left") < F.col("given"))).select(SOURCE))
    return answered.join(going, SOURCE, "left_semi").select(
        SOURCE, "name", "chunk_index", "chunk_total", F.col("content").alias("summary"))


def is_reduced(requests: DataFrame, level: int) -> bool:
    """Whether no request of a round leads to another one, whatever the replies to it are."""
    leads = (F.col("kind") == CHUNK) if level == 0 else (
        F.col("kind").startswith(SYNTHESIS) & (F.col("chunk_total") > 1))
    return requests.filter(leads).isEmpty()


def results(budgets: DataFrame, requests: DataFrame, responses: DataFrame,
            counter: TokenCounter) -> DataFrame:
    """One row per analysed container; a container with any failed request is left out.

    ``requests`` holds every round sent so far, ``responses`` their answers. Tokens: the reported
    usage of direct and synthesis requests, plus the counted text and summary of each chunk.
    """
    c = F.col
    answered = unwrap(requests, responses)
    spent = F.when(c("kind") == CHUNK, c("text_tokens") + counter.of_text(c("content"))).otherwise(
        c("usage_tokens"))
    final = _is_final()
    outcome = answered.groupBy(SOURCE).agg(
        F.max(F.when(final, c("content"))).alias("_content"),
        F.sum(spent).alias("tokens_used"),
        F.count_if(c("kind").isin(DIRECT, CHUNK)).alias("chunks_used"),
        F.count_if(c("failure").isNotNull()).alias("_failed"))
    analysed = (outcome.filter((c("_failed") == 0) & c("_content").isNotNull())
                .select(SOURCE, c("_content").alias("analysis"), "tokens_used", "chunks_used"))
    nothing = budgets.filter(c("strategy") == EMPTY).select(
        SOURCE, F.lit(NOTHING_PROCESSED).alias("analysis"),
        F.lit(0).cast("long").alias("tokens_used"), F.lit(0).cast("long").alias("chunks_used"))
    return (budgets.join(analysed.unionByName(nothing), SOURCE)
            .select(SOURCE, "name", "analysis", "tokens_used", "chunks_used", "deduplicated",
                    "original_count", "processed_count", "lines_total", "lines_filtered",
                    "lines_kept"))


def failed_containers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Containers with a request that failed, or without an answer to a final request.

    So a container whose summaries could not be reduced to one request is failed, never just absent.
    """
    answered = unwrap(requests, responses).groupBy(SOURCE, "name").agg(
        F.count_if(F.col("failure").isNotNull()).alias("bad"), F.count_if(_is_final()).alias("final"))
    return answered.filter("bad > 0 OR final = 0").select(SOURCE, "name")


def _is_final() -> Column:
    kind = F.col("kind")
    return (kind == DIRECT) | (kind.startswith(SYNTHESIS) & (F.col("chunk_total") == 1))


def latest_per_name(rows: DataFrame, order: Column) -> DataFrame:
    """One result per container name: the last in scan order wins.

    The winning position is found first, from names and positions alone; whole rows are only joined.
    """
    placed = rows.withColumn("_order", order)
    last = placed.groupBy("name").agg(F.max("_order").alias("_order"))
    return placed.join(last, ["name", "_order"], "left_semi").drop("_order")


def interactions(requests: DataFrame, responses: DataFrame, now, enabled: bool = True) -> DataFrame:
    """Answered requests with request and response as JSON, for the interaction log."""
    body = F.struct("messages", "temperature", "max_tokens")
    rows = requests.join(one_response(responses), "request_id").filter(
        F.col("error").isNull() & (F.size("choices") > 0))
    rows = rows if enabled else rows.filter(F.lit(False))
    return rows.select(
        "request_id", "name", F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz").alias("ts"),
        F.get("messages", F.lit(1))["content"].alias("original_input"),
        F.to_json(body).alias("request_json"),
        F.to_json(F.struct("choices", "usage")).alias("response_json"))
