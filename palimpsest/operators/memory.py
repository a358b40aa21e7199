"""Translation memory: what to do with each segment, batches, costs, and the rewriting of translations and cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as X
from palimpsest.functions.glossary import parse_answer

# Limits and prices (per million tokens) of the planner.
SEED_RATIO = 0.72
BATCH_SEGMENTS, BATCH_CHARS = 12, 1800
COMPLETION_PER_CHAR = 0.6
MESSAGE_TOKENS = 4
RETRIES = (1, 2, 4)


def plan(segments: DataFrame, existing: DataFrame, cache: DataFrame, links: DataFrame, *, force: bool = False) -> DataFrame:
    """(id, version_id, action, answer, reuse_of) per segment, the first that holds:

    cached: has a sound answer; carried_verbatim: not body, or trivial;
    carried: the memory has a sound text; seeded: an old counterpart of ratio
    ``SEED_RATIO`` or more has a text; machine: none of these.  ``force``
    leaves out the first and third.

    ``segments``: id, version_id, role, text, fingerprint; ``existing``: id,
    text (one per segment); ``cache``: fingerprint, text (one each);
    ``links``: id, old_id, ratio, old_text (one per segment).  The memory joins
    on distinct fingerprints, so a running header costs one row.
    """
    sound = lambda c: ~X.is_blank(c) & ~X.looks_broken_identifier(c)
    has = existing.select("id", F.col("text").alias("_own"))
    held = cache.filter(sound(F.col("text"))).select("fingerprint", F.col("text").alias("_held"))
    wanted = segments.select("fingerprint").distinct().join(held, "fingerprint")
    seeds = links.filter((F.col("ratio") >= SEED_RATIO) & ~X.is_blank(F.col("old_text"))).select("id", F.col("old_id").alias("_old"), F.col("old_text").alias("_seed"))
    rows = segments.join(has, "id", "left").join(wanted, "fingerprint", "left").join(seeds, "id", "left")
    own, memory = sound(F.col("_own")), F.col("_held").isNotNull()
    local = (F.coalesce("role", F.lit("body")) != "body") | X.is_trivial(F.col("text"))
    if force:
        own = memory = F.lit(False)
    action = F.when(own, "cached").when(local, "carried_verbatim").when(memory, "carried").when(F.col("_seed").isNotNull(), "seeded").otherwise("machine")
    answer = F.when(action == "cached", F.col("_own")).when(action == "carried_verbatim", F.col("text")).when(action == "carried", F.col("_held"))
    return rows.select("id", "version_id", action.alias("action"), answer.alias("answer"), F.when(action == "seeded", F.col("_old")).alias("reuse_of"), "text", F.when(action == "seeded", F.col("_seed")).alias("seed"))


def greedy_batches(planned: DataFrame, group: str, order: str, length: Column, most: int = BATCH_SEGMENTS, chars: int = BATCH_CHARS) -> DataFrame:
    """(group, batch_no, ids, n, chars): items in order, a new batch when it would exceed ``most`` items or ``chars`` characters.

    The running sum starts anew with each batch, which no window can say, so
    it is a fold over rows sorted by group and order, which holds one batch at
    a time.  A single item over the limit is a batch of its own; a null length
    counts as 0, and items without a group are a group.
    """
    rows = planned.select(F.col(group).cast("bigint").alias("g"), F.col(order).cast("bigint").alias("o"), F.coalesce(length, F.lit(0)).cast("bigint").alias("n"))

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: object = ()  # no group yet
        no, ids, size = 0, [], 0
        for part in parts:
            out: list[tuple] = []
            for g, o, n in zip(*(part[c].to_pylist() for c in "gon"), strict=True):
                if ids and (g != of or len(ids) >= most or size + n > chars):
                    out.append((of, no, ids, len(ids), size))
                    no, ids, size = no + 1, [], 0
                if g != of:
                    of, no = g, 0
                ids.append(o)
                size += n
            yield _batches_of(out)
        if ids:
            yield _batches_of([(of, no, ids, len(ids), size)])

    spread = rows.repartition("g").sortWithinPartitions("g", F.asc_nulls_last("o"))
    return spread.mapInArrow(fold, "g bigint, batch_no int, ids array<bigint>, n bigint, chars bigint").withColumnRenamed("g", group)


_BATCHES = pa.schema([("g", pa.int64()), ("batch_no", pa.int32()), ("ids", pa.list_(pa.int64())), ("n", pa.int64()), ("chars", pa.int64())])


def _batches_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_BATCHES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BATCHES, strict=True)], schema=_BATCHES)


def prompts(planned: DataFrame) -> DataFrame:
    """(id, payload): the JSON record of each segment to translate, with the old pair where it is seeded."""
    todo = planned.filter(F.col("action").isin("seeded", "machine"))
    return todo.select("id", F.to_json(F.struct(F.col("id"), F.col("text").alias("en"), F.col("seed").alias("prev_zh"))).alias("payload"))


def estimate(planned: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Per version: segments and characters to translate, tokens and cost, without writing anything."""
    todo = planned.filter(F.col("action").isin("seeded", "machine")).withColumn("_t", X.estimate_tokens(F.col("text")) + MESSAGE_TOKENS)
    sums = todo.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.sum("_t").alias("prompt_tokens"))
    out = F.floor(F.col("chars") * COMPLETION_PER_CHAR + 0.5).cast("bigint")
    return sums.withColumn("completion_tokens", out).withColumn("cost", F.round((F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out) / 1e6, 6))


class Fatal(Exception):
    """A failure that another attempt cannot mend."""


def execute(batches: DataFrame, ask: Callable[[str], str], *, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, text, status) of batches (ids, payload) answered by ``ask``; three further attempts, blank texts and failures are ``failed``."""

    def one(ids: list[int], payload: str) -> dict[int, str]:
        for pause in (*RETRIES, None):
            try:
                return parse_answer(ask(payload), ids)
            except Fatal:
                return {}
            except Exception:
                if pause is None:
                    return {}
                wait(pause)
        return {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for ids, payload in zip(pdf["ids"], pdf["payload"], strict=True):
                got = one([int(i) for i in ids], payload)
                rows += [(int(i), got.get(int(i), ""), "machine" if got.get(int(i)) else "failed") for i in ids]
            yield pd.DataFrame(rows, columns=["id", "text", "status"])

    return batches.select("ids", "payload").mapInPandas(run, "id bigint, text string, status string")


def upsert_translations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Translations with the new answers: the revision rises only if the text changes; blank provider, model and reuse keep the old.

    ``old``: segment_id, text, status, provider, model, revision, reuse_of;
    ``new``: the same without revision.  One row per segment on either side.
    """
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    both = o.join(n, F.col("o.segment_id") == F.col("n.segment_id"), "full")
    fresh, known = F.col("n._n").isNotNull(), F.col("o._o").isNotNull()
    changed = fresh & (F.coalesce("n.text", F.lit("")) != F.coalesce("o.text", F.lit("")))
    kept = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    return both.select(
        F.coalesce("o.segment_id", "n.segment_id").alias("segment_id"),
        F.when(fresh, F.coalesce("n.text", F.lit(""))).otherwise(F.col("o.text")).alias("text"),
        F.when(fresh, F.col("n.status")).otherwise(F.col("o.status")).alias("status"),
        kept("provider"),
        kept("model"),
        F.when(~known, 1).when(changed, F.coalesce("o.revision", F.lit(1)) + 1).otherwise(F.col("o.revision")).cast("int").alias("revision"),
        F.coalesce("n.reuse_of", "o.reuse_of").alias("reuse_of"),
    )


def put_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """The memory with new entries written over old ones; ``hits`` stay.  Of several new entries the latest counts; blank fingerprints are ignored."""
    rest = ["text", "provider", "model", "created_at"]
    last = new.filter(~X.is_blank(F.col("fingerprint"))).groupBy("fingerprint").agg(F.max_by(F.struct(*rest), F.struct("created_at", "text")).alias("r"))
    both = old.alias("o").join(last.alias("n"), "fingerprint", "full")
    fresh = F.col("n.r").isNotNull()
    return both.select("fingerprint", *(F.when(fresh, F.col(f"n.r.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest), F.coalesce("o.hits", F.lit(0)).cast("bigint").alias("hits"))


def audit(segments: DataFrame, answers: DataFrame) -> DataFrame:
    """(version_id, id, why): machine answers that look wrong, but for those whose segment goes on in the next one.

    ``segments``: version_id, id, page, order_index, text of the body;
    ``answers``: id, text, status.
    """
    w = Window.partitionBy("version_id").orderBy("order_index", "id")
    rows = segments.withColumns({"_b": F.lead("text").over(w), "_p": F.lead("page").over(w)}).withColumnRenamed("text", "_en")
    judged = rows.join(answers.filter("status = 'machine'").select("id", F.col("text").alias("_zh")), "id").withColumn("why", X.suspect(F.col("_en"), F.col("_zh"))).filter("why IS NOT NULL")
    en = F.regexp_replace("_en", "\\s+\\z", "")
    open_end = ~en.rlike("[.!?。！？:;\"'”’)]\\z")
    goes_on = F.coalesce(F.regexp_replace("_b", "^\\s+", "").rlike("^[\\p{Ll}0-9]"), F.lit(False)) | en.rlike("[,;，、–—-]\\z")
    near = F.coalesce((F.col("_p") - F.col("page")).isin(0, 1), F.lit(False))
    legitimate = (X.substantive_length(F.col("_zh")) >= 3) & F.col("_b").isNotNull() & (en != "") & near & open_end & goes_on
    return judged.filter(~legitimate).select("version_id", "id", "why")
