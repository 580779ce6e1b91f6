"""Bounded context packing and the decision to answer at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.ranking import explode_rows
from hitweave.functions.text import let, text_or_empty, trim_ws
from hitweave.params import CONTEXT

PAGE = "Página "
SEPARATOR = "\n\n---\n\n"
SECTION = ["ord", "source_name", "page_key", "llm_text", "chunk_index"]
TAKEN = "array<struct<at:int,source_name:string,chunk_index:int,bare:boolean>>"


def _pack(items: Column, p=CONTEXT) -> Column:
    """Sequential packing as one fold over the lengths of a query's (bounded) list.

    State: characters used, whether the budget has stopped the packing, the
    position in the list, and the places of the list taken so far.
    """

    def fold(list_: Column) -> Column:
        n = F.size(list_)
        several = F.size(F.array_distinct(F.transform(list_, lambda x: x["source_name"]))) > 1

        def step(acc: Column, x: Column) -> Column:
            out = acc["out"]
            used = F.size(out)
            mine = F.size(F.filter(out, lambda o: o["source_name"] == x["source_name"]))
            enough = (n - acc["i"]) > (p.max_chunks - used) * 2
            skip = acc["stop"] | (several & (mine >= p.max_per_source) & enough)
            prev = F.try_element_at(out, F.lit(-1))
            follows = (prev["source_name"] == x["source_name"]) & (prev["chunk_index"] + 1 == x["chunk_index"])

            def place(bare: Column) -> Column:
                size = (
                    F.when(used > 0, len(SEPARATOR)).otherwise(0)
                    + len("SOURCE ") + 1 + F.length(x["page_key"]) + F.when(bare, x["bare_size"]).otherwise(x["text_size"])
                )
                over = ~skip & (acc["chars"] + size > p.max_chars)
                take = ~skip & ~over
                taken = F.struct(acc["i"].alias("at"), x["source_name"].alias("source_name"), x["chunk_index"].alias("chunk_index"), bare.alias("bare"))
                return F.struct(
                    F.when(take, acc["chars"] + size).otherwise(acc["chars"]).alias("chars"),
                    (acc["stop"] | over | (take & (used + 1 >= p.max_chunks))).alias("stop"),
                    (acc["i"] + 1).alias("i"),
                    F.when(take, F.concat(out, F.array(taken))).otherwise(out).alias("out"),
                )

            return let(F.coalesce(follows & (x["bare_size"] > 0), F.lit(False)), place)

        zero = F.expr(f"named_struct('chars', 0, 'stop', false, 'i', 0, 'out', cast(array() as {TAKEN}))")
        return F.aggregate(list_, zero, step)

    return let(items, fold)


def build_context(rows: DataFrame, params=CONTEXT, chunks: DataFrame | None = None) -> DataFrame:
    """Per query: context text, counts, and the sections taken (``packed``).

    At most 8 chunks, 3 per source while enough others remain, 1000 characters per chunk and 5000 in all.
    The page key is the chunk's ``page_number`` where there is one, else its chunk number.

    Long lists need not carry texts: with ``chunks`` (chunk_id, text, content_without_overlap; one row per id), rows have
    ``chunk_id`` and the lengths ``text_size`` and ``bare_size``, and texts are joined to the sections taken only.
    """
    most = params.max_chunk_chars
    numbers = ["page_number", "chunk_index"] if "page_number" in rows.columns else ["chunk_index"]
    page = F.concat(F.lit(PAGE), F.coalesce(*numbers, F.lit(0)).cast("string"))
    # no more than a section shows of them
    text, bare = F.substring(text_or_empty("text"), 1, most), F.substring("content_without_overlap", 1, most)
    own = [text.alias("text"), bare.alias("bare")] if chunks is None else [F.col("chunk_id")]
    sizes = [F.length(text), F.length(bare)] if chunks is None else [F.coalesce("text_size", F.lit(0)), F.col("bare_size")]
    item = F.struct(
        F.col("ord").cast("int").alias("ord"),
        F.coalesce(F.nullif("source_name", F.lit("")), F.lit("Documento")).alias("source_name"),
        page.alias("page_key"),
        *own,
        F.coalesce("chunk_index", F.lit(0)).cast("int").alias("chunk_index"),
        *[F.when(n.isNotNull(), F.least(n, F.lit(most))).cast("int").alias(name) for n, name in zip(sizes, ("text_size", "bare_size"))],
    )
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    packed = lists.select("query_id", F.size("_l").alias("total_chunks"), "_l", _pack(F.col("_l"), params).alias("_p"))
    packed = packed.select("query_id", "total_chunks", F.col("_p.chars").alias("total_chars"), _taken(own=chunks is None).alias("packed"))
    if chunks is not None:
        packed = _with_texts(packed, chunks.select("chunk_id", text.alias("text"), bare.alias("bare")))
    sections = F.transform(
        "packed", lambda s: F.concat(F.lit("SOURCE "), s["page_key"], F.lit("\n"), s["llm_text"])
    )
    return packed.select(
        "query_id",
        trim_ws(F.array_join(sections, SEPARATOR)).alias("context"),
        F.size("packed").alias("used_chunks"),
        "total_chunks",
        "total_chars",
        F.array_distinct(F.transform("packed", lambda s: s["source_name"])).alias("sources"),
        "packed",
    )


def _taken(own: bool) -> Column:
    """The items of ``_l`` that ``_p`` has taken, as sections with their texts if they have their ``own``."""

    def section(o: Column) -> Column:
        def of(x: Column) -> Column:
            body = F.when(o["bare"], x["bare"]).otherwise(x["text"]).alias("llm_text") if own else x["chunk_id"].alias("chunk_id")
            side = [] if own else [o["bare"].alias("bare")]
            return F.struct(*[body if c == "llm_text" else x[c].alias(c) for c in SECTION], *side)

        return let(F.get(F.col("_l"), o["at"]), of)

    return F.transform("_p.out", section)


def _with_texts(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections that name chunks, with their texts; lists without sections stay."""
    rows = packed.select("query_id", "total_chunks", "total_chars", F.posexplode_outer("packed").alias("_pos", "_s"))
    rows = rows.withColumn("chunk_id", F.col("_s.chunk_id")).join(chunks, "chunk_id", "left")
    body = F.when(F.col("_s.bare"), F.col("bare")).otherwise(F.col("text")).alias("llm_text")
    section = F.struct("_pos", *[body if c == "llm_text" else F.col(f"_s.{c}").alias(c) for c in SECTION])
    lists = rows.groupBy("query_id").agg(
        F.first("total_chunks").alias("total_chunks"),
        F.first("total_chars").alias("total_chars"),
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), section))).alias("_l"),
    )
    return lists.select(
        "query_id",
        "total_chunks",
        "total_chars",
        F.transform("_l", lambda s: F.struct(*[s[c].alias(c) for c in SECTION])).alias("packed"),
    )


def context_pages(contexts: DataFrame) -> DataFrame:
    """(query_id, page_key, llm_text): what was shown under each page key; two sources may share a key."""
    rows = explode_rows(contexts, ["query_id"], F.col("packed"), "pos", "s")
    item = F.struct("pos", F.col("s.llm_text").alias("t"))
    return rows.groupBy("query_id", F.col("s.page_key").alias("page_key")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n").alias("llm_text")
    )


def answer_gate(per_query: DataFrame, high_score: float = 0.6) -> DataFrame:
    """Adds ``refusal_reason`` (null: answer).

    Needs: results, kept, context_rows, entailment_count, neutral_kept, used_fallback, list_mode, top_score, used_chunks.
    """
    sure = (
        (F.col("neutral_kept") > 0)
        | F.col("used_fallback")
        | (F.col("list_mode") & (F.col("context_rows") > 0))
        | (F.coalesce("top_score", F.lit(0.0)) >= high_score)
    )
    reason = (
        F.when((F.col("kept") == 0) & (F.col("results") > 0), "llm_filter_zero_relevant")
        .when((F.col("entailment_count") == 0) & (F.col("context_rows") > 0) & ~sure, "no_entailments_after_rerank")
        .when(F.col("used_chunks") == 0, "no_chunks")
    )
    return per_query.withColumn("refusal_reason", reason)
