"""Mixing sources to target weights by Pfair scheduling."""

import base64
import heapq
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_id, terms
from millrace.plans.store import materialize, running_total, small

#: A public byte-level BPE; the path is a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts a text before merging. A fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Tokens of a block at most, and blocks of the whole mix at least (as far as there are tokens).
BLOCK, LEAST_BLOCKS = 65_536, 10_000
#: Slots that the driver schedules at most: one period of the weights, or all blocks where the period is longer.
PERIOD = 1_000_000
#: Documents of one source that one task puts in order, about.
BUCKET_ROWS = 500_000


def _tokens(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def schedule(weights: list[Fraction], slots: int) -> list[list[int]]:
    """The slots that each source gets, in order, of `slots` equal blocks.

    Block i (from 1) of a source of weight w may start at slot floor((i - 1) / w) and must be done by slot ceil(i / w). Of the blocks
    released, the one of the earliest deadline goes first (then the longer window, then the source's place). With weights
    that add up to 1 or less no deadline is missed, so at every slot each source has had its share to less than one block.
    """
    got: list[list[int]] = [[] for _ in weights]
    waiting = [(0, k, 1) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, Fraction, int, int]] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i // weights[k]), weights[k], k, i))
        if ready:
            _, w, k, i = heapq.heappop(ready)
            got[k].append(slot)
            heapq.heappush(waiting, (max(slot + 1, i // w), k, i + 1))
    return got


@dataclass
class Mix:
    """uses: (doc_id, source, tokens, uses, first_slot, slots, starts), one row per used document; slots and starts have an entry per use:
    its block, and the token of the source at which it begins, counted through all passes. shares: one row per target source
    (source, weight, max_repeats, available, capacity, target, used, share, blocks, filled, missed, short): the blocks that the
    schedule gives the source, those that its placed documents fill, the rest, and whether there is a rest. block: tokens of a block. total: tokens of the whole mix."""

    uses: DataFrame
    shares: DataFrame
    block: int
    total: int


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = TOKENIZER) -> DataFrame:
    """doc_id, source (trimmed, lower-cased), tokens of the documents that count: text not null, source neither null nor blank.
    tokenizer: the driver's file of a byte-level BPE as ranks, which is sent to the executors, or None for plain words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(clean_id(source)).alias("source"), F.col(text).alias("text")).where("text is not null and source is not null")
    if tokenizer is None:
        return rows.select("doc_id", "source", F.size(terms("text")).cast("long").alias("tokens"))
    if not os.path.exists(tokenizer):
        raise FileNotFoundError(tokenizer)
    docs.sparkSession.sparkContext.addFile(tokenizer)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_tokens(os.path.basename(tokenizer)), f"doc_id {kind}, source string, tokens long")


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = TOKENIZER, block: int | None = None, total: int | None = None) -> Mix:
    """Combines documents so that each source of `targets` (source, weight, max_repeats) has its weight of all tokens.

    The mix is as large as all counted documents once (or `total` tokens) and is cut into blocks of `block` tokens (by default
    BLOCK, less for a mix of under LEAST_BLOCKS of these), scheduled by release times and deadlines from the weights (see
    `schedule`). A schedule repeats itself after as many slots as the weights' common denominator, so the driver holds one
    period however large the mix is; weights of a longer period than PERIOD get their whole mix scheduled, in blocks so large that
    these slots suffice. A source's documents stand in the order of a hash and fill its blocks one after the other, pass after
    pass; every use has its block. The source ends when its weight is reached or when every document was used max_repeats
    times: it is short if blocks that the schedule gives it stay unfilled. Those remain empty: other sources don't grow,
    and the shares tell what was reached. A document is used in a pass if it begins before the source's last token, so a
    source exceeds its target by less than a document, and at every slot it has had its share to less than a block and a document.

    Weights are read as the decimal numbers they print as, and taken exactly. If they add up to more than 1 all of them are
    divided by their sum, for every purpose. Positions inside sources come from bucketed running totals, so a source of
    any size is spread over tasks.

    Documents with null text, null or blank source don't count; blank texts have 0 tokens; documents of sources without a target are
    counted in the size of the mix but not used; a target without documents is short; repeated target rows: the first by
    weight counts; null weights and repeats count as 0. Other columns are ignored. Without documents every share is 0.
    """
    spark = docs.sparkSession
    sized = materialize(document_sizes(docs, doc_id, text, source, tokenizer))
    size = {r["source"]: (r["t"] or 0, r["n"]) for r in sized.join(small(targets.select(F.lower(clean_id("source")).alias("source")).distinct()), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    everything = total if total is not None else sized.agg(F.sum("tokens")).first()[0] or 0
    want: dict[str, tuple[Fraction, int]] = {}
    for r in targets.select(F.lower(clean_id("source")).alias("s"), "weight", "max_repeats").where("s is not null").orderBy("s", F.desc("weight"), F.desc("max_repeats")).collect():
        want.setdefault(r["s"], (Fraction(str(r["weight"] or 0)), int(r["max_repeats"] or 0)))
    names = sorted(want)
    over = max(Fraction(1), sum(w for w, _ in want.values()))
    weights = [want[s][0] / over for s in names]
    period = math.lcm(*(w.denominator for w in weights))
    if block is None:
        block = max(1, min(BLOCK, everything // LEAST_BLOCKS))
    if period > PERIOD:
        block = max(block, -(-everything // PERIOD))
        period = -(-everything // block) + 1
    plan = schedule(weights, period)
    rows, places = [], []
    for s, w, own in zip(names, weights, plan, strict=True):
        have, repeats = size.get(s, (0, 0))[0], want[s][1]
        goal = math.ceil(w * everything)
        blocks = -(-goal // block)
        rows.append((s, float(want[s][0]), repeats, int(have), int(have * repeats), float(w * everything), int(goal), int(min(goal, have * repeats)), int(blocks)))
        places.append((s, own[: min(len(own), blocks)], len(own)))
    quota = spark.createDataFrame(rows, "source string, weight double, max_repeats int, available long, capacity long, target double, goal long, take long, blocks long")
    where = F.broadcast(spark.createDataFrame(places, "source string, places array<int>, each int"))  # PERIOD numbers at most

    buckets = min(1 << 24, max(256, 1 << (sum(n for _, n in size.values()) // BUCKET_ROWS).bit_length()))
    placed = running_total(sized.join(F.broadcast(quota.where("take > 0").select("source", "available", "take", "max_repeats")), "source"), "source", "doc_id", "tokens", "_start", buckets)
    passes = F.when(F.col("_start") < F.col("take"), F.least(F.col("max_repeats").cast("long"), F.expr("(take - _start - 1) div greatest(available, 1L)") + 1))
    used = placed.withColumn("uses", passes).where("uses > 0")
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1), lambda i: F.col("_start") + i * F.col("available"))
    # block i of a source is in period i // each, at the place that the schedule gives it there; a last block beyond a whole schedule comes after all
    spot = lambda i: F.expr("0L") + F.floor(i / F.col("each")) * period + F.coalesce(F.get("places", F.pmod(i, F.col("each")).cast("int")), F.lit(0))
    spots = F.transform("starts", lambda x: spot(F.floor(x / F.lit(block))))
    used = used.withColumn("starts", starts).join(where, "source").withColumn("slots", spots)
    used = used.select("doc_id", "source", "tokens", "uses", F.get("slots", F.lit(0)).alias("first_slot"), "slots", "starts")
    used = materialize(used)
    reached = {r["source"]: r["used"] or 0 for r in used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used")).collect()}
    done = sum(reached.values())
    result = []
    for s, weight, repeats, have, capacity, target, goal, _, blocks in rows:
        own = reached.get(s, 0)
        filled = blocks if own >= goal else own // block
        result.append((s, weight, repeats, have, capacity, target, own, own / done if done else 0.0, blocks, filled, blocks - filled, filled < blocks))
    shares = spark.createDataFrame(result, "source string, weight double, max_repeats int, available long, capacity long, target double, used long, share double, blocks long, filled long, missed long, short boolean")
    return Mix(used, shares, block, everything)


def deviations(mix: Mix) -> DataFrame:
    """Per source of a mix: source, uses, worst (the greatest distance in tokens between what stands before a block of the source and its weight
    of all slots before that block), longest (its longest document). Taken over the placed uses; worst stays below block + longest."""
    each = mix.uses.select("source", "tokens", F.explode(F.arrays_zip("slots", "starts")).alias("x"))
    blocks = each.groupBy("source", F.col("x.slots").alias("slot")).agg(F.min("x.starts").alias("before"), F.count("*").alias("uses"), F.max("tokens").alias("longest"))
    weight = mix.shares.select("source", (F.col("target") / F.lit(float(max(mix.total, 1)))).alias("w"))
    away = F.abs(F.col("before") - F.col("w") * F.col("slot") * mix.block)
    return blocks.join(F.broadcast(weight), "source").groupBy("source").agg(F.sum("uses").alias("uses"), F.max(away).alias("worst"), F.max("longest").alias("longest"))
