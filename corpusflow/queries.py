"""Registered queries: one per operator of the blueprint, over the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of its SQL twin in :mod:`corpusflow.sql_oracle`.  Message
arrays are returned flattened (``role:content`` joined by ``␞``) so results
hash the same in both engines.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions import text as T
from corpusflow.functions.chat import flatten_messages, render_chat, render_quarantine, render_with, to_prompt_messages
from corpusflow.functions.rand import seeded_bits
from corpusflow.functions.takes import completion_content, strip_fence, take_status
from corpusflow.operators import dedup as D
from corpusflow.operators import ingest as I
from corpusflow.operators import quality as Q
from corpusflow.operators.chatfmt import choose_templates, format_examples, generation_requests
from corpusflow.operators.counts import SKETCH_BITS, count_by, id_sketch, stage_counts, united_count
from corpusflow.operators.prefix import running_before
from corpusflow.operators.split import split_exact, split_grouped, split_hash
from corpusflow.operators.synth import take_quarantine, take_rows, trim_takes
from corpusflow.plans.collect import collect_items
from corpusflow import schemas as S
from corpusflow.plans.corpus import answer_text, build_corpus, clean_filter, write_corpus
from corpusflow.plans.synthetic import build_synthetic, numbered_topics, request_loop
from corpusflow.session import drop_written, ensure_checkpoint_dir, scratch_path, written, written_once
from corpusflow.sources import tables as TB
from corpusflow.sources.payloads import explode_comments, explode_listing
from corpusflow.sources.readers import read_chat, read_items, read_prompt, split_quarantine
from corpusflow.streaming.appends import append_once, read_appended
from corpusflow.streaming.collect import Collection
from corpusflow.streaming.ingest import completed_sink, item_stream, new_ids_only, run_available, state_settings

GENERATION_PROMPT = "Write {count} short, confident takes about {topic}. Answer with a JSON array of strings."


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def _items(spark, sf):
    return TB.items(spark, sf)


def _passing(spark, sf) -> DataFrame:
    """Passing items with ``text`` and ``topic``."""
    return clean_filter(_items(spark, sf))


def _item_examples(spark, sf) -> DataFrame:
    kept = written(_passing(spark, sf).select("id", "ord", "text", "topic"), "passing")
    deduped = D.dedup(kept, "text", "ord", mode="reference")
    return format_examples(deduped, key="ord").select(F.lit("item").alias("origin"), "ord", "messages")


def _conv_examples(spark, sf) -> DataFrame:
    conv = TB.conversation_examples(TB.table(spark, sf, "conversations"))
    return conv.select(F.lit("synthetic").alias("origin"), F.col("conv_id").alias("ord"), "messages")


def _all_examples(spark, sf) -> DataFrame:
    return _item_examples(spark, sf).unionByName(_conv_examples(spark, sf))


def _example_key() -> F.Column:
    return F.concat_ws(":", F.col("origin"), F.col("ord").cast("string"))


# ---------------------------------------------------------------------------
# 2.1 scans, sources, sinks
# ---------------------------------------------------------------------------

def q_item_read_union(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + U1 + K1: write both item sources as JSONL, read them back in file
    and line order."""
    ensure_checkpoint_dir(spark)
    docs = TB.items_from_documents(TB.table(spark, sf, "documents"))
    bench = TB.items_from_benchmark(TB.table(spark, sf, "benchmark"))
    paths = []
    for name, df in (("items_documents", docs), ("items_benchmark", bench)):
        path = scratch_path(spark, name)
        df.orderBy("ord").drop("ord").write.mode("overwrite").json(path)
        paths.append(path)
    missing = scratch_path(spark, "never_written")
    back = read_items(spark, [paths[0], missing, paths[1]])
    # the missing file keeps its slot: second file gets file_ord 2
    return back.select(
        "id", "type", "title", "selftext", "post_title", "body", "score", "num_comments", "source",
        F.col("file_ord").alias("file_ord"), (F.col("ord") % F.lit(1 << 40)).alias("line"),
    )


def q_listing_explode(spark, sf):
    """S5 + F1: every post child of every landed page."""
    pages = TB.listing_pages(TB.table(spark, sf, "documents"))
    return explode_listing(pages, keep=("q", "page_no")).select(
        "q", "page_no", "pos", "id", "title", "selftext", "score", "num_comments"
    )


def q_comments_explode(spark, sf):
    """S6 + F1 + W1: first ten ``t1`` children of element 1."""
    pages = TB.comment_pages(TB.table(spark, sf, "documents"))
    return explode_comments(pages).select("post_id", "cpos", "id", "body", "score")


def q_top_comments(spark, sf):
    """Comments per post after the top-10 cut."""
    pages = TB.comment_pages(TB.table(spark, sf, "documents"))
    c = explode_comments(pages)
    return c.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_comments"), F.max("cpos").alias("max_pos"))


def q_completion_extract(spark, sf):
    """The text content of each landed response."""
    comp = TB.completions(TB.table(spark, sf, "documents"))
    return comp.select("batch", completion_content("response").alias("content"))


# ---------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# ---------------------------------------------------------------------------

def q_main_text(spark, sf):
    return _items(spark, sf).select("id", Q.main_text().alias("text"))


def q_filter_text(spark, sf):
    return _items(spark, sf).select("id", Q.filter_text().alias("filter_text"))


def q_topic(spark, sf):
    return _items(spark, sf).select("id", Q.topic().alias("topic"))


def q_source_tag(spark, sf):
    b = Q.tag_source(TB.items_from_benchmark(TB.table(spark, sf, "benchmark")).drop("source"), K.TARGETED_SOURCE)
    return b.select("id", "source")


def q_score_gate(spark, sf):
    return _items(spark, sf).where(Q.score_gate()).select("id", "type", "score")


def q_length_gate(spark, sf):
    t = _items(spark, sf).select("id", Q.filter_text().alias("ft"))
    return t.where(Q.length_gate(F.col("ft"))).select("id", F.length("ft").alias("n_chars"))


def q_bot_gate(spark, sf):
    t = _items(spark, sf).select("id", Q.filter_text().alias("ft"))
    return t.where(~Q.bot_gate(F.col("ft"))).select("id")


def q_passes_filter(spark, sf):
    return Q.passes_filter(_items(spark, sf)).select("id", F.length("filter_text").alias("n_chars"))


def q_page_cutoff(spark, sf):
    pages = TB.listing_pages(TB.table(spark, sf, "documents"))
    again = pages.where((F.col("q") % 4 == 1) & (F.col("page_no") <= 2))  # these landed twice
    return I.page_cutoff(pages.unionByName(again), K.MAX_PAGES_GENERAL).select("q", "page_no")


def q_generation_requests(spark, sf):
    topics = TB.table(spark, sf, "benchmark").select(F.col("item_id"), F.col("text").alias("topic"))
    req = generation_requests(topics, GENERATION_PROMPT)
    body = F.from_json("request", "model string, max_tokens int, temperature double, messages array<struct<role:string,content:string>>")
    return req.select(
        "item_id", "prompt", body["model"].alias("model"), body["max_tokens"].alias("max_tokens"),
        body["messages"][0]["content"].alias("content"),
    )


# ---------------------------------------------------------------------------
# 2.7 scalar functions
# ---------------------------------------------------------------------------

def q_strip_urls(spark, sf):
    p = TB.table(spark, sf, "pages")
    return p.select("page_id", T.strip_urls("html").alias("html"))


def q_strip_mentions(spark, sf):
    return _items(spark, sf).select("id", T.strip_mentions("body").alias("body"))


def q_strip_tombstones(spark, sf):
    return _items(spark, sf).select("id", T.strip_tombstones("body").alias("body"))


def q_cut_edit(spark, sf):
    return _items(spark, sf).select("id", T.cut_edit("body").alias("body"))


def q_collapse_ws(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", T.collapse_ws("text").alias("text"))


def q_clean_text(spark, sf):
    return _items(spark, sf).select("id", T.clean_text("body").alias("body"))


def q_ustrip(spark, sf):
    return _items(spark, sf).select("id", T.ustrip("selftext").alias("selftext"))


def q_fence_strip(spark, sf):
    comp = TB.completions(TB.table(spark, sf, "documents"))
    c = completion_content("response")
    return comp.select("batch", strip_fence(c).alias("text"), take_status(c).alias("status"))


def q_seeded_order(spark, sf):
    p = _passing(spark, sf)
    return p.select("ord", seeded_bits(K.SEED, "shuffle", F.col("ord")).alias("u"))


def q_template_route(spark, sf):
    p = _passing(spark, sf)
    t = choose_templates(p, key="ord")
    return t.select("ord", "family", "idx")


def q_template_fill(spark, sf):
    p = _passing(spark, sf)
    return choose_templates(p, key="ord").select("ord", "user")


def q_chat_messages(spark, sf):
    p = _passing(spark, sf)
    return format_examples(p, key="ord").select("ord", flatten_messages("messages").alias("messages"))


def q_prompt_messages(spark, sf):
    b = TB.table(spark, sf, "benchmark")
    m = to_prompt_messages(F.lit(K.DEFAULT_SYSTEM_PROMPT), F.col("text"))
    return b.select("item_id", flatten_messages(m).alias("messages"))


def q_chat_render(spark, sf):
    conv = TB.conversation_examples(TB.table(spark, sf, "conversations"))
    return conv.select("conv_id", render_chat("messages").alias("text"))


def q_chat_render_hook(spark, sf):
    """Conversations rendered by a caller's Python function."""
    def renderer(some):
        return ["".join(K.CHAT_PREFIX.format(role=m["role"]) + m["content"] + K.CHAT_SUFFIX for m in x) for x in some]

    conv = TB.conversation_examples(TB.table(spark, sf, "conversations"))
    return render_quarantine(render_with(conv, renderer))[0].select("conv_id", "text")


def q_trigram_counts(spark, sf):
    """Trigram count and distinct trigrams of every distinct passing text."""
    return D.gram_sizes(D.distinct_texts(_passing(spark, sf)))


# ---------------------------------------------------------------------------
# 2.3 joins, 2.4 aggregations and dedup
# ---------------------------------------------------------------------------

def q_seen_anti(spark, sf):
    seen = TB.seen_ids(TB.table(spark, sf, "labels"))
    return I.seen_anti(_items(spark, sf), seen).select("id")


def q_comment_title_join(spark, sf):
    docs = TB.table(spark, sf, "documents")
    posts = explode_listing(TB.listing_pages(docs), keep=("q", "page_no")).withColumn("ord", F.lit(0))
    comments = explode_comments(TB.comment_pages(docs))
    return I.comment_title_join(comments, posts, K.MIN_COMMENTS_GENERAL).select("id", "post_id", "post_title")


def q_worklist_anti(spark, sf):
    docs = TB.table(spark, sf, "documents")
    return I.worklist_anti(TB.worklist(docs), TB.completed_labels(docs, TB.table(spark, sf, "labels")))


def q_id_first_wins(spark, sf):
    """The first event of every user."""
    ev = TB.table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("ord"))
    return D.id_first_wins(ev, "user_id", "ord").select("user_id", "event_id", "event_type")


def q_distinct_ids(spark, sf):
    docs = TB.table(spark, sf, "documents")
    got = collect_items(TB.listing_pages(docs), TB.comment_pages(docs), TB.seen_ids(TB.table(spark, sf, "labels")))
    return I.distinct_ids(got)


def q_collect_items(spark, sf):
    """New posts and comments in walk order."""
    docs = TB.table(spark, sf, "documents")
    got = collect_items(TB.listing_pages(docs), TB.comment_pages(docs), TB.seen_ids(TB.table(spark, sf, "labels")))
    ord_ = [F.col("ord")[c].alias(c) for c in ("q", "page_no", "pos", "sub")]
    return got.select("id", "type", *ord_, "title", "post_title", "score")


def q_collect_targeted(spark, sf):
    """E2, targeted: three pages, posts with five comments, source tag on all items."""
    docs = TB.table(spark, sf, "documents")
    got = collect_items(
        TB.listing_pages(docs), TB.comment_pages(docs), TB.seen_ids(TB.table(spark, sf, "labels")),
        max_pages=K.MAX_PAGES_TARGETED, min_comments=K.MIN_COMMENTS_TARGETED, source=K.TARGETED_SOURCE)
    ord_ = [F.col("ord")[c].alias(c) for c in ("q", "page_no", "pos", "sub")]
    return got.select("id", "type", *ord_, "title", "post_title", "source")


def q_item_quarantine(spark, sf):
    """Items that cannot be processed, and a fractional score that can."""
    b = TB.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("i"))
    lines = b.select(F.explode(F.array(
        F.concat(F.lit('{"id": "g'), "i", F.lit('", "type": "comment", "body": "x", "score": '), "i", F.lit(".5}")),
        F.concat(F.lit('{"id": "m'), "i", F.lit('", "type": ')),
        F.concat(F.lit('{"id": "t'), "i", F.lit('", "score": 1.5}')),
        F.concat(F.lit('{"id": "p'), "i", F.lit('", "type": "post"}')),
    )).alias("value"))
    path = scratch_path(spark, "items_odd")
    lines.write.text(path)
    good, bad = split_quarantine(read_items(spark, [path]))
    both = good.select(F.lit("good").alias("reason"), "score").unionByName(bad.select("reason", "score"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def q_id_counts(spark, sf):
    """A2 over four runs: the exact number of identifiers up to each run, and
    whether the estimate from the runs' stored sketches lies within three
    standard errors of it."""
    ensure_checkpoint_dir(spark)
    docs = TB.table(spark, sf, "documents")
    ids = docs.select((F.col("doc_id") % 4).alias("run"), F.floor(F.col("doc_id") / 6).cast("string").alias("id"))
    table = scratch_path(spark, "id-sketches")
    for run in range(4):  # one after the other, each knows its own rows only
        append_once(id_sketch(ids.where(F.col("run") == run)).select(F.lit(run).cast("long").alias("run"), "sketch"), table, run)
    estimate = united_count(read_appended(spark, table, "run long, sketch binary"), "run")
    first = ids.groupBy("id").agg(F.min("run").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    runs = estimate.join(first, "run", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    exact = running_before(runs, "run", "n", "n_before").select("run", (F.col("n_before") + F.col("n")).alias("n_ids"), "estimate")
    bound = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)
    return exact.select("run", "n_ids", (F.abs(F.col("estimate") - F.col("n_ids")) <= F.col("n_ids") * bound + 1).alias("within_bound"))


def q_item_offset_order(spark, sf):
    """S1 in one scan: items read back in the order of their byte offsets."""
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "items_offsets")
    TB.items_from_documents(TB.table(spark, sf, "documents")).repartitionByRange("ord").sortWithinPartitions("ord").drop("ord").write.json(path)
    back = read_items(spark, [path], order="offset")
    return running_before(back, "ord", F.lit(1), "line").select("id", "line", "body")


def q_prompt_file(spark, sf):
    """A prompt file (the first benchmark text, with white space around) as
    the system turn of every benchmark item."""
    ensure_checkpoint_dir(spark)
    b = TB.table(spark, sf, "benchmark")
    path = scratch_path(spark, "prompt")
    first = b.orderBy("item_id").limit(1)
    first.select(F.concat(F.lit(" \n\t"), F.col("text"), F.lit("\n\n "))).coalesce(1).write.text(path)
    m = to_prompt_messages(F.lit(read_prompt(spark, path)), F.col("text"))
    return b.select("item_id", flatten_messages(m).alias("messages"))


def q_near_dup_pairs(spark, sf):
    texts = written(D.distinct_texts(_passing(spark, sf)), "distinct-texts")
    return D.near_dup_pairs(texts)


def q_dedup_reference(spark, sf):
    kept = written(_passing(spark, sf).select("id", "ord", "text"), "passing")
    return D.dedup(kept, "text", "ord", mode="reference").select("id", "ord")


def q_dedup_strict(spark, sf):
    kept = written(_passing(spark, sf).select("id", "ord", "text"), "passing")
    return D.dedup(kept, "text", "ord", mode="strict").select("id", "ord")


def q_stage_counts(spark, sf):
    items = _items(spark, sf)
    passing = written(clean_filter(items).select("id", "ord", "text"), "passing")
    texts = D.distinct_texts(passing)
    deduped = D.dedup(passing, "text", "ord", mode="reference")
    return stage_counts({"raw": items, "filtered": passing, "distinct_texts": texts, "deduped": deduped})


# ---------------------------------------------------------------------------
# synthetic takes
# ---------------------------------------------------------------------------

def _takes(spark, sf):
    return take_rows(TB.completions(TB.table(spark, sf, "documents")))


def q_take_parse(spark, sf):
    return _takes(spark, sf).where(F.col("status") == "ok").select("batch", "pos", "take")


def q_take_fallback(spark, sf):
    return _takes(spark, sf).where(F.col("status") == "fallback").select("batch", "pos", "take")


def q_take_trim(spark, sf):
    return trim_takes(_takes(spark, sf).drop("status")).select("batch", "pos", "take")


def q_take_quarantine(spark, sf):
    return take_quarantine(TB.completions(TB.table(spark, sf, "documents"))).select("batch", "status")


def q_request_loop(spark, sf):
    """E3's loop: seeded topics, running totals, the batch that reaches the target."""
    comp = TB.completions(TB.table(spark, sf, "documents"))
    topics = numbered_topics(TB.table(spark, sf, "benchmark"), "item_id", "text")
    return request_loop(comp, topics)


def q_synthetic_examples(spark, sf):
    """Every take with a seeded user prompt."""
    res = build_synthetic(TB.completions(TB.table(spark, sf, "documents")))
    return res.examples.select("batch", "pos", flatten_messages("messages").alias("messages"))


# ---------------------------------------------------------------------------
# 2.5 / 2.6: unions, shuffle, split
# ---------------------------------------------------------------------------

def q_synth_union(spark, sf):
    ex = _all_examples(spark, sf)
    return ex.select("origin", "ord", flatten_messages("messages").alias("messages"))


def q_split_exact(spark, sf):
    ex = _all_examples(spark, sf)
    return split_exact(ex, _example_key()).select("origin", "ord", "pos", "split")


def q_split_filtered(spark, sf):
    """L2 + L3 alone: the exact split of the passing items, not deduplicated."""
    ex = _passing(spark, sf).select(F.lit("item").alias("origin"), "ord", "text")
    return split_exact(ex, _example_key()).select("ord", "pos", "split")


def q_split_hash(spark, sf):
    ex = _all_examples(spark, sf)
    return split_hash(ex, _example_key()).select("origin", "ord", "split")


def q_split_grouped(spark, sf):
    ex = _all_examples(spark, sf)
    return split_grouped(ex, answer_text("messages")).select("origin", "ord", "split")


def q_line_count(spark, sf):
    ex = _all_examples(spark, sf)
    return count_by(split_exact(ex, _example_key()), "split")


def q_corpus_build(spark, sf):
    """The whole corpus build, with the conversations as the
    preformatted source."""
    items = _items(spark, sf)
    synthetic = TB.conversation_examples(TB.table(spark, sf, "conversations")).select(
        F.col("conv_id").alias("ord"), "messages"
    )
    res = build_corpus(items, synthetic)
    return res.examples.select("origin", "ord", "pos", "split", flatten_messages("messages").alias("messages"))


def q_build_counts(spark, sf):
    """A1: the counts of a whole corpus build."""
    synthetic = TB.conversation_examples(TB.table(spark, sf, "conversations")).select(F.col("conv_id").alias("ord"), "messages")
    return build_corpus(_items(spark, sf), synthetic).stages


def q_read_splits(spark, sf):
    """K2 + S2/S3: the written splits read back with their line order."""
    synthetic = TB.conversation_examples(TB.table(spark, sf, "conversations")).select(F.col("conv_id").alias("ord"), "messages")
    out = scratch_path(spark, "corpus")
    write_corpus(build_corpus(_items(spark, sf), synthetic), out)
    parts = [
        read_chat(spark, f"{out}/{name}").select(
            F.lit(name).alias("split"), F.col("ord").alias("line"), flatten_messages("messages").alias("messages"))
        for name in ("train", "val")
    ]
    return parts[0].unionByName(parts[1])


def q_write_splits(spark, sf):
    """K2: the corpus written as ordered train/val JSONL, read back."""
    items = _items(spark, sf)
    synthetic = TB.conversation_examples(TB.table(spark, sf, "conversations")).select(
        F.col("conv_id").alias("ord"), "messages"
    )
    out = scratch_path(spark, "corpus")
    write_corpus(build_corpus(items, synthetic), out)
    parts = [
        spark.read.schema(S.CHAT).json(f"{out}/{name}").select(
            F.lit(name).alias("split"), flatten_messages("messages").alias("messages"))
        for name in ("train", "val")
    ]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------------------
# 2.8 streaming
# ---------------------------------------------------------------------------

def q_stream_new_ids(spark, sf):
    """T1 + T2: a file stream over the events table emits each user once."""
    ensure_checkpoint_dir(spark)
    out = scratch_path(spark, "stream_out")
    ck = scratch_path(spark, "stream_ck")
    schema = TB.table(spark, sf, "events").schema
    stream = item_stream(spark, TB.stream_path(sf, "events"), fmt="parquet", schema=schema)
    run_available(new_ids_only(stream.select("user_id", "event_id"), "user_id"), out, ck)
    return spark.read.parquet(out).select("user_id")


def _landing_run(q: F.Column, page_no: F.Column) -> F.Column:
    """The run in which a page lands: out of order, and the first page of some
    queries lands broken at first (see :func:`_land_pages`)."""
    return F.when((q % 6 == 1) & (page_no == 0), 2).otherwise((q + page_no) % 3)


def _land_pages(pages: DataFrame, run: int, folder: str) -> None:
    at = F.to_timestamp(F.lit(f"2024-01-0{run + 1} 00:00:00"))
    q, no = F.col("q"), F.col("page_no")
    here = pages.where(_landing_run(q, no) == run)
    if run == 0:  # a fetch that broke off
        cut = pages.where((q % 6 == 1) & (no == 0)).withColumn("payload", F.substring("payload", 1, 20))
        here = here.unionByName(cut)
    here.withColumn("landed_at", at).write.mode("append").parquet(folder)


def q_stream_collect(spark, sf):
    """E2 as three incremental runs over growing folders; the second one dies
    between its append and its checkpoint, and is started again."""
    ensure_checkpoint_dir(spark)
    docs = TB.table(spark, sf, "documents")
    base = scratch_path(spark, "collection")
    # built once: the runs land parts of them
    (pages, pages_at), (comments, comments_at) = written_once(TB.listing_pages(docs), "listing-pages"), written_once(TB.comment_pages(docs), "comment-pages")
    seen = TB.seen_ids(TB.table(spark, sf, "labels"))
    collection = Collection(spark, f"{base}/state", f"{base}/pages", f"{base}/comments")

    def die(table: str, batch: int) -> None:
        if table == "items":
            raise InterruptedError("the run dies here")

    for run in range(3):
        _land_pages(pages, run, f"{base}/pages")
        mine = F.pmod(F.xxhash64("post_id"), F.lit(3)) == run
        comments.where(mine).withColumn("landed_at", F.to_timestamp(F.lit(f"2024-01-0{run + 1} 00:00:00"))).write.mode("append").parquet(f"{base}/comments")
        if run == 2:  # all of them has landed
            drop_written(spark, pages_at)
            drop_written(spark, comments_at)
        if run == 1:
            try:
                collection.run(run, seen, after_append=die)
            except StreamingQueryException:
                pass  # as meant: the batch is in the table, the checkpoint does not know
        collection.run(run, seen)
    return collection.items().select("id", "type", "q", "page_no", "pos", "sub", "title", "post_title", "score")


def q_stream_walks(spark, sf):
    """The labels of ended walks over three runs, why and in which run."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "walks")
    pages = TB.listing_pages(TB.table(spark, sf, "documents"))
    collection = Collection(spark, f"{base}/state", f"{base}/pages", f"{base}/comments")
    for run in range(3):
        _land_pages(pages, run, f"{base}/pages")
        collection.walk(run)
    return collection.completed()


def q_append_replay(spark, sf):
    """K1: three batches appended; one is replayed, one is half-written."""
    ensure_checkpoint_dir(spark)
    docs = TB.table(spark, sf, "documents").select("doc_id", "text")
    table = scratch_path(spark, "appends")
    for batch in (0, 1, 2, 1):
        append_once(docs.where(F.col("doc_id") % 3 == batch), table, batch)
    docs.where("doc_id % 3 = 0").write.parquet(f"{table}/data/batch=3")  # not in the manifest
    return read_appended(spark, table, docs.schema)


def q_stream_bounded(spark, sf):
    """T2 with bounded state: one row per user, event type and period of ten
    days, from events that land out of order.  A row may be a period late; rows
    that land after the watermark has passed their period are dropped."""
    ensure_checkpoint_dir(spark)
    base = scratch_path(spark, "bounded")
    period = F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / 10).cast("int")
    ev = TB.table(spark, sf, "events").select("event_id", "user_id", "event_type", period.alias("period"))
    ev = ev.withColumn("at", F.to_timestamp(F.date_add(F.lit("2024-01-01"), F.col("period") * 10)))
    lands = F.when(F.col("event_id") % 97 == 0, 4).when(F.col("event_id") % 17 == 0, F.col("period") + 1).otherwise(F.col("period"))
    for run in range(5):
        ev.where(lands == run).write.mode("append").parquet(f"{base}/landing")
        with state_settings(spark):
            stream = item_stream(spark, f"{base}/landing", fmt="parquet", schema=ev.schema)
            fresh = new_ids_only(stream, ["user_id", "event_type", "period"], "at", "10 days")
            run_available(fresh.select("user_id", "event_type", "period"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


def q_stream_completed(spark, sf):
    """Finished search labels recorded once by a foreachBatch sink."""
    ensure_checkpoint_dir(spark)
    done = scratch_path(spark, "completed")
    ck = scratch_path(spark, "completed_ck")
    schema = TB.table(spark, sf, "documents").schema
    stream = item_stream(spark, TB.stream_path(sf, "documents"), fmt="parquet", schema=schema)
    labels = stream.select(F.concat(F.col("source"), F.lit(":"), F.col("lang")).alias("label"))
    run_available(labels, None, ck, foreach_batch=completed_sink(done))
    return spark.read.parquet(done).select("label")


QUERIES = {
    "item_read_union": q_item_read_union,
    "listing_explode": q_listing_explode,
    "comments_explode": q_comments_explode,
    "top_comments": q_top_comments,
    "completion_extract": q_completion_extract,
    "main_text": q_main_text,
    "filter_text": q_filter_text,
    "topic": q_topic,
    "source_tag": q_source_tag,
    "score_gate": q_score_gate,
    "length_gate": q_length_gate,
    "bot_gate": q_bot_gate,
    "passes_filter": q_passes_filter,
    "page_cutoff": q_page_cutoff,
    "generation_requests": q_generation_requests,
    "strip_urls": q_strip_urls,
    "strip_mentions": q_strip_mentions,
    "strip_tombstones": q_strip_tombstones,
    "cut_edit": q_cut_edit,
    "collapse_ws": q_collapse_ws,
    "clean_text": q_clean_text,
    "ustrip": q_ustrip,
    "fence_strip": q_fence_strip,
    "seeded_order": q_seeded_order,
    "template_route": q_template_route,
    "template_fill": q_template_fill,
    "chat_messages": q_chat_messages,
    "prompt_messages": q_prompt_messages,
    "chat_render": q_chat_render,
    "trigram_counts": q_trigram_counts,
    "seen_anti": q_seen_anti,
    "comment_title_join": q_comment_title_join,
    "worklist_anti": q_worklist_anti,
    "id_first_wins": q_id_first_wins,
    "distinct_ids": q_distinct_ids,
    "collect_items": q_collect_items,
    "collect_targeted": q_collect_targeted,
    "item_quarantine": q_item_quarantine,
    "near_dup_pairs": q_near_dup_pairs,
    "dedup_reference": q_dedup_reference,
    "dedup_strict": q_dedup_strict,
    "stage_counts": q_stage_counts,
    "take_parse": q_take_parse,
    "take_fallback": q_take_fallback,
    "take_trim": q_take_trim,
    "take_quarantine": q_take_quarantine,
    "synthetic_examples": q_synthetic_examples,
    "synth_union": q_synth_union,
    "split_exact": q_split_exact,
    "split_filtered": q_split_filtered,
    "split_hash": q_split_hash,
    "split_grouped": q_split_grouped,
    "line_count": q_line_count,
    "corpus_build": q_corpus_build,
    "write_splits": q_write_splits,
    "build_counts": q_build_counts,
    "read_splits": q_read_splits,
    "stream_new_ids": q_stream_new_ids,
    "stream_completed": q_stream_completed,
    "stream_collect": q_stream_collect,
    "stream_walks": q_stream_walks,
    "stream_bounded": q_stream_bounded,
    "append_replay": q_append_replay,
    "id_counts": q_id_counts,
    "item_offset_order": q_item_offset_order,
    "prompt_file": q_prompt_file,
    "request_loop": q_request_loop,
    "chat_render_hook": q_chat_render_hook,
}
