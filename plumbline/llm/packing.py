"""Problem 6: texts of varying length packed into containers of fixed capacity.

Mixture-controlled packing. Texts are measured in tokens of a public tokenizer;
only a text longer than a container is cut, into full containers and a rest.
Each partition holds one queue of pieces for each source and fills one window
(container) after the other by deficit round-robin: every window gives each
source the credit of its target share, the source with the most credit places
the largest piece that still fits, and what is over- or underdrawn is carried
to the next window. Partitions work at the same time, and yet deficits are
carried across them: a partition places everything it holds, so the deficit at
its end, which is the credit its successor starts with, follows from the token
counts of the partitions before it, a table of partitions times sources.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans.lineage import cut

CAPACITY = 2048
#: Tokens that a partition should hold: enough that its last, partly filled
#: containers (a few by partition) do not matter, little enough for one task.
PARTITION_TOKENS = 8_000_000
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COUNTS = "doc_id long, source string, n_tokens long"
PLACED = "container_id string, position int, doc_id long, piece_no int, token_from long, n_tokens int, source string"


#: Largest vocabulary file that is sent to the workers.
MOST_VOCABULARY = 64 << 20


def vocabulary_bytes(vocabulary: str) -> bytes:
    """The file as it is; ValueError if it is too large to be sent around."""
    with open(vocabulary, "rb") as f:
        data = f.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MOST_VOCABULARY} bytes")
    return data


@lru_cache(2)
def tokenizer(data: bytes):
    """The tokenizer of the lines ``base64 rank`` of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A text is encoded in parts of about so many characters, cut before a blank
#: that follows a letter, where the split pattern cuts as well.
PART = 200_000


def token_count(text: str, enc) -> int:
    if len(text) <= PART:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = at + PART
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
            end += 1
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def measure(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document with at least one token.

    Null and empty texts take no space and are left out; ``source`` is trimmed
    lower case, ``unknown`` where null or blank. Repeated rows are measured and
    packed each; extra columns are ignored. ``vocabulary`` is a file that the
    driver reads; workers get its content (at most MOST_VOCABULARY bytes).
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    own = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown")).alias("source"),
        F.col("text").cast("string").alias("text"),
    ).where(F.length("text") > 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(shared.value)
        for batch in batches:
            raw = batch.column(2).cast(pa.large_binary())
            counts = [token_count(x.as_py().decode("utf-8", "replace"), enc) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "n_tokens"])

    return own.mapInArrow(scan, COUNTS)


class Queue:
    """Pieces of one source by size; the largest that fits is found with the
    bits of one integer."""

    def __init__(self) -> None:
        self.by_size: dict[int, list[tuple]] = {}
        self.sizes = 0

    def add(self, size: int, piece: tuple) -> None:
        self.by_size.setdefault(size, []).append(piece)
        self.sizes |= 1 << size

    def largest(self, room: int) -> int:
        """Size of the largest piece of at most ``room``, 0 if there is none."""
        fits = self.sizes & ((2 << room) - 1)
        return fits.bit_length() - 1 if fits else 0

    def take(self, size: int) -> tuple:
        pieces = self.by_size[size]
        piece = pieces.pop()
        if not pieces:
            self.sizes ^= 1 << size
        return piece


def fill(queues: Mapping[str, Queue], shares: Mapping[str, float], credit: dict[str, float], capacity: int) -> Iterator[list[tuple[str, tuple]]]:
    """Yield windows of ``(source, piece)`` until all queues are empty.

    ``credit`` is the deficit of each source in tokens; it is updated in place.
    A source without pieces gives its share to the others for the window.
    """
    while any(q.sizes for q in queues.values()):
        window, room = [], capacity
        for s in queues:
            credit[s] += shares.get(s, 0.0) * capacity
        while room > 0:
            size, s = 0, ""
            for s in sorted(queues, key=lambda s: (-credit[s], s)):
                if size := queues[s].largest(room):
                    break
            if not size:
                break
            window.append((s, queues[s].take(size)))
            credit[s] -= size
            room -= size
        yield window
        for s in queues:  # the empty part of a window is nobody's debt
            credit[s] -= shares.get(s, 0.0) * room


def place(part: int, pieces: list[tuple[str, int, tuple]], shares: Mapping[str, float], credit: Mapping[str, float], capacity: int) -> Iterator[tuple]:
    """Rows of PLACED for one partition; ``pieces`` are (source, tokens, piece)."""
    queues: dict[str, Queue] = {s: Queue() for s in sorted(set(shares) | {p[0] for p in pieces})}
    for s, size, piece in sorted(pieces, key=lambda p: (p[1], p[2]), reverse=True):
        queues[s].add(size, piece)
    own = {s: credit.get(s, 0.0) for s in queues}
    for n, window in enumerate(fill(queues, shares, own, capacity)):
        for pos, (s, (doc, piece_no, start, size, _)) in enumerate(window):
            yield f"{part:06d}-{n:08d}", pos, doc, piece_no, start, size, s


def credits(dealt: DataFrame, total: int, shares: Mapping[str, float] | None = None) -> DataFrame:
    """``part, source, share, credit``: what each source that a partition holds
    starts with there, its target share of the tokens of all partitions before
    less what these held of it. Running sums over the token counts by partition
    (one row each) and by partition and source; nothing goes to the driver.
    """
    sums = dealt.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    back = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    passed = sums.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(back), F.lit(0)).alias("passed"))
    own = W.Window.partitionBy("source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    held = sums.withColumn("held", F.coalesce(F.sum("n").over(own), F.lit(0)))
    if shares is None:
        target = sums.groupBy("source").agg((F.sum("n") / F.lit(float(total))).alias("share"))
    else:
        target = dealt.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()] or [("", 0.0)], "source string, share double")
    each = held.join(target, "source", "left").join(passed, "part").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return each.select("part", "source", "share", (F.col("share") * F.col("passed") - F.col("held")).alias("credit"))


def pack(measured: DataFrame, capacity: int = CAPACITY, shares: Mapping[str, float] | None = None, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """Pack all pieces: one row for each, with its container.

    ``measured`` has ``doc_id, source, n_tokens``. ``shares`` are the target
    proportions of the sources in every window; without them the proportions of
    the whole input, found by one aggregation. Every token is placed exactly
    once and no container holds more than ``capacity``; a piece is part of a
    text only if the text exceeds the capacity. Texts are dealt to partitions by
    a hash of id and number of tokens, so one source, however large, is spread
    over all of them; a text of no tokens is left out and an empty table gives
    an empty result. A source that ``shares`` does not name gets no credit and
    fills what the others leave.

    The driver learns the number of tokens, nothing else; the credit that a
    partition starts with joins its texts there (:func:`credits`).
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    texts = cut(measured.where("n_tokens > 0"))
    total = texts.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return measured.sparkSession.createDataFrame([], PLACED)
    parts = max(1, math.ceil(total / partition_tokens))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(parts)).cast("int"))

    def run(key, left, right):
        part = int(key[0].as_py())
        sources, targets, owed = (right.column(c).to_pylist() for c in ("of", "share", "credit"))
        docs, of, sizes = (left.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens"))
        pieces = []
        for i, (d, s, n) in enumerate(zip(docs, of, sizes, strict=True)):
            d = -1 if d is None else d
            # A text beyond the capacity is one row: its containers are made here.
            for k, start in enumerate(range(0, n, capacity)):
                size = min(capacity, n - start)
                pieces.append((s, size, (d, k, start, size, i)))
        out = list(place(part, pieces, dict(zip(sources, targets, strict=True)), dict(zip(sources, owed, strict=True)), capacity))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
        names = ("container_id", "position", "doc_id", "piece_no", "token_from", "n_tokens", "source")
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

    owed = credits(dealt, total, shares).select(F.col("part").alias("at"), F.col("source").alias("of"), "share", "credit")
    return dealt.groupBy("part").cogroup(owed.groupBy("at")).applyInArrow(run, PLACED)


def mixture(placed: DataFrame, shares: Mapping[str, float] | None = None) -> DataFrame:
    """How closely the windows follow the targets, by source: ``source, target,
    share, n_windows, window_deviation, running_deviation, behind``.

    ``window_deviation`` is the mean over containers of the distance of a
    source's share of the container from its target; it cannot be small where
    single texts fill most of a container. What deficit round-robin bounds is
    the running sum: ``running_deviation`` is the largest distance, in tokens,
    between what the windows of a partition up to some window hold of a source
    and its target share of them, while the source is not used up;
    ``behind`` is the same for a source short of its target, which a source that
    has run out would exceed. Sums of each partition's windows are taken in
    order by a task for the partition and source, of as many rows as the
    partition has containers.
    """
    own = cut(placed.select("container_id", "source", "n_tokens").groupBy("container_id", "source").agg(F.sum("n_tokens").alias("n")))
    whole = own.groupBy("container_id").agg(F.sum("n").alias("all")).withColumn("part", F.substring_index("container_id", "-", 1))
    used = own.groupBy("source").agg(F.sum("n").alias("n"))
    if shares is None:
        target = used.select("source", (F.col("n") / F.sum("n").over(W.Window.partitionBy(F.lit(1)))).alias("target"))
    else:
        target = placed.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, target double")
    held = own.withColumn("part", F.substring_index("container_id", "-", 1)).groupBy("part", "source").agg(F.max("container_id").alias("last"))
    grid = whole.join(held, "part").join(own, ["container_id", "source"], "left").join(target, "source", "left")
    n, goal = F.coalesce("n", F.lit(0)), F.coalesce("target", F.lit(0.0))
    order = W.Window.partitionBy("part", "source").orderBy("container_id")
    off = F.sum(n - goal * F.col("all")).over(order)
    rows = grid.select("source", goal.alias("target"), n.alias("n"), "all", F.when(F.col("container_id") <= F.col("last"), off).alias("off"))
    return rows.groupBy("source", "target").agg(
        F.round(F.sum("n") / F.sum("all"), 6).alias("share"), F.count(F.lit(1)).alias("n_windows"), F.round(F.avg(F.abs(F.col("n") / F.col("all") - F.col("target"))), 6).alias("window_deviation"),
        F.round(F.max(F.abs("off")), 1).alias("running_deviation"), F.round(F.max(-F.col("off")), 1).alias("behind"),
    )


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``source, n_pieces, n_tokens, share`` for each source and, under the
    source ``(all)``, the number of containers and the part of them in use."""
    placed = cut(placed.select("container_id", "source", "n_tokens"))
    by = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").cast("long").alias("n_tokens"))
    total = F.sum("n_tokens").over(W.Window.partitionBy(F.lit(1)))
    each = by.withColumn("share", F.round(F.col("n_tokens") / total, 6)).withColumn("n_containers", F.lit(None).cast("long"))
    whole = placed.agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.count_distinct("container_id").alias("n_containers"))
    whole = whole.where("n_pieces > 0").select(F.lit("(all)").alias("source"), "n_pieces", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("share"), "n_containers")
    return each.unionByName(whole)


def promises(measured: DataFrame, placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``n_texts`` packed, ``n_lost`` texts of which tokens are missing or
    placed twice, ``n_cut`` texts cut though they fit, ``n_over`` containers
    above the capacity, ``tight``: at least 98 % of all containers in use, the
    last few of each partition allowed for. Rows of one id count as one text."""
    wanted = measured.where("n_tokens > 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("want"), F.max("n_tokens").alias("most"), F.count(F.lit(1)).alias("k"))
    got = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    each = wanted.join(got, "doc_id", "left")
    texts = each.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("n_lost"), F.count_if((F.col("most") <= capacity) & (F.col("pieces") > F.col("k"))).alias("n_cut"))
    boxes = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_over"), (F.sum("n") >= F.lit(0.98 * capacity) * (F.count(F.lit(1)) - 4)).alias("tight"))
    return texts.select("*", boxes.select("n_over").scalar().alias("n_over"), boxes.select("tight").scalar().alias("tight"))
