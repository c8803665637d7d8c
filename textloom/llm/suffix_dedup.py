"""Repeated passages by distributed prefix doubling over word positions.

A position's rank tells which run of words begins there; it starts with runs
of ``base`` words and grows by doubling: Spark sorts the pairs (rank at p,
rank at p + offset), names each class of equal pairs by its first position,
drops positions whose pair is unique, and goes on until the runs are
``passage`` words long. Equal ranks then are repeated passages.

Positions that can't be part of any repeated passage never enter the sort.
Every passage of ``passage`` words holds the least of its runs of ``base``
words, its anchor, and equal passages have equal anchors (winnowing); so a
position whose anchor stands at one place of the corpus only is unique already.
This drops nothing that repeats. Documents of equal words are sorted once.

Ranks are named by 64-bit hashes, and two runs are one only if both of a pair's
ranks are equal, which is 128 bits together; they aren't compared word by word.

Classes of so many positions that they would overload the task that sorts them
are found from a sample of positions (at most ``HOT`` of them for each length of
runs, as each holds more than that share of the sample). Their first positions
come from a pre-aggregated minimum, and their rows go through the sort in
shares that keep that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_BYTES, only, settle, small
from textloom.llm.near_dedup import docs_repeat
from textloom.llm.text import Words, chunks, list_array, mix, spans_hash, words_of

_U = np.uint64
#: A class with more than one in so many of the sampled positions isn't sorted by one task.
HOT = 4096
#: One position in so many is sampled to find such classes.
SAMPLED = 256
#: Shares that the positions of such a class are dealt into.
SHARES = 256


def _sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """pick over values[i : i + width] for each i; the result is shorter by width - 1."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def _anchors(words: Words, passage: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of base words, starts of all passages within documents, and the anchor of each."""
    n, count = len(words.hashes), np.diff(words.offsets)
    per = np.maximum(count - passage + 1, 0)
    total = np.concatenate([[0], np.cumsum(per)])
    starts = np.arange(total[-1]) + np.repeat(words.offsets[:-1] - total[:-1], per)
    if not len(starts):
        return np.zeros(0, _U), starts, np.zeros(0, _U)
    grams = spans_hash(words.hashes, np.arange(n - base + 1), base)
    return grams, starts, _sliding(np.minimum, grams, passage - base + 1)[starts]


def _whole(words: Words) -> np.ndarray:
    return spans_hash(words.hashes, words.offsets[:-1], np.diff(words.offsets))


def _surveyor(passage: int, base: int, sampled: int):
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column("text"))
                grams, starts, least = _anchors(words, passage, base)
                count = np.diff(words.offsets)
                long = np.flatnonzero(count >= passage)
                chosen = np.zeros(0, np.int64)
                if len(starts):
                    # a run is an anchor if it is the least of some passage that holds it: their largest least is it
                    width = passage - base + 1
                    most = np.zeros(len(grams) + width - 1, _U)
                    most[starts + width - 1] = least
                    chosen = np.flatnonzero(_sliding(np.maximum, most, width) == grams)
                bounds = np.append(words.offsets[:-1][long], len(words.hashes))
                ranges = np.searchsorted(chosen, bounds)
                # positions sampled for the sizes of classes, by a hash of where they stand and not of what stands there
                owner = np.searchsorted(words.offsets, starts, side="right") - 1
                ids = np.asarray(part.column("doc_id")).astype(_U)[owner]
                drawn = starts[mix(mix(ids) + (starts - words.offsets[owner]).astype(_U)) % _U(sampled) == 0]
                pairs = np.stack([_named_run(words, drawn, r, n) for r, n in enumerate(_lengths(passage, base))], 1).ravel() if len(drawn) else np.zeros(0, _U)
                bound = np.searchsorted(drawn, bounds) * len(_lengths(passage, base))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(long)),
                        pa.array(_whole(words)[long].view(np.int64)),
                        pa.array(count[long]),
                        list_array(pa.array(grams[chosen].view(np.int64)), ranges),
                        list_array(pa.array(pairs.view(np.int64)), bound),
                    ],
                    names=["doc_id", "whole", "n_words", "anchors", "drawn"],
                )

    return survey


def _offsets(passage: int, base: int) -> list[int]:
    """How far apart the two ranks of a pair are, round by round."""
    length, offsets = base, [base]
    while (length := length + offsets[-1]) < passage:
        offsets.append(min(length, passage - length))
    return offsets


def _lengths(passage: int, base: int) -> list[int]:
    """The lengths of runs that are named, round by round."""
    return [base + sum(_offsets(passage, base)[: r + 1]) for r in range(len(_offsets(passage, base)))]


def _named_run(words: Words, at: np.ndarray, round_: int, length: int) -> np.ndarray:
    """What the class of the run of a round that begins at each place is called among the hot ones."""
    return mix(spans_hash(words.hashes, at, length) ^ mix(np.array([round_ + 1], _U)))


def _kept(part: pa.RecordBatch, passage: int, base: int):
    """The words of a part, hashes of their runs, the places that are ranked and the document of each."""
    # a passage's rank comes to hang on the ranks at these places after its start
    needed = np.zeros(1, np.int64)
    for offset in _offsets(passage, base)[1:]:
        needed = np.union1d(needed, needed + offset)
    words = words_of(part.column("text"))
    grams, starts, least = _anchors(words, passage, base)
    marks = np.asarray(part.column("anchors").flatten()).view(_U)
    keep = np.unique((starts[np.isin(least, marks)][:, None] + needed).ravel())
    return words, grams, keep, np.searchsorted(words.offsets, keep, side="right") - 1


def _hot_of(words: Words, keep: np.ndarray, owner: np.ndarray, round_: int, length: int, hot: np.ndarray) -> np.ndarray:
    """The number of the hot class of each place in a round, or -1. hot: sorted names."""
    out = np.full(len(keep), -1, np.int32)
    inside = np.flatnonzero(keep + length <= words.offsets[owner + 1])
    if len(inside) and len(hot):
        name = _named_run(words, keep[inside], round_, length)
        at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
        out[inside] = np.where(hot[at] == name, at, -1)
    return out


def _first_finder(passage: int, base: int, hot: np.ndarray):
    """Of each partition, the least (doc_id, pos) of each hot class."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                words, _, keep, owner = _kept(part, passage, base)
                ids = np.asarray(part.column("doc_id"))[owner] if len(keep) else keep
                for r, n in enumerate(_lengths(passage, base)):
                    number = _hot_of(words, keep, owner, r, n, hot)
                    some = np.flatnonzero(number >= 0)
                    order = some[np.lexsort((keep[some] - words.offsets[owner[some]], ids[some], number[some]))]
                    first = order[np.append(True, np.diff(number[order]) != 0)] if len(order) else order
                    for k in first.tolist():
                        place = int(ids[k]), int(keep[k] - words.offsets[owner[k]])
                        least[int(number[k])] = min(least.get(int(number[k]), place), place)
        rows = sorted(least.items())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1][0] for x in rows], pa.int64()), pa.array([x[1][1] for x in rows], pa.int32())], names=["hot", "doc_id", "pos"])

    return find


def _positions(passage: int, base: int, hot: np.ndarray):
    rounds = list(enumerate(_lengths(passage, base)))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words, grams, keep, owner = _kept(part, passage, base)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), pa.array(keep - words.offsets[owner], pa.int32()), pa.array(grams[keep].view(np.int64)), pa.array(grams[keep + base].view(np.int64))]
                    + [pa.array(_hot_of(words, keep, owner, r, n, hot)) for r, n in rounds],
                    names=["doc_id", "pos", "rank", "next"] + [f"hot{r}" for r, _ in rounds],
                )

    return positions


def repeated_passages(docs: DataFrame, passage: int = 50, base: int = 13, id_column: str = "doc_id", text_column: str = "text", sampled: int = SAMPLED) -> DataFrame:
    """(doc_id, whole, first_word, n_words, first_doc): the stretches of words that repeat an earlier passage, earlier by (doc_id, word).

    Every run of ``passage`` words that stands at an earlier place too belongs
    to a stretch; overlapping and touching runs are joined. first_doc is the
    least document in which any of them stands first, and whole a hash of the
    document's words. A repetition that overlaps its own first occurrence, as in one
    word said over and over, counts from where it no longer does.

    Words are compared without case and punctuation. Of equal passages the one
    of the least (doc_id, word) is the first, so ties don't arise. Very long
    texts are searched whole. Null or empty texts and
    texts of fewer than ``passage`` words repeat nothing. Rows with a null
    doc_id are left out; rows that share a doc_id are one document, whose
    least text counts. An empty table gives an empty result. Other columns are
    ignored, whatever their names. ``sampled`` only bears on how large classes
    are found and spread over tasks.
    """
    if passage < 2 * base or base < 1:
        raise ValueError("a passage has at least twice as many words as the base")
    docs = only(docs, doc_id=id_column, text=text_column)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    if docs_repeat(docs):
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    survey = settle(docs.mapInArrow(_surveyor(passage, base, sampled), "doc_id bigint, whole bigint, n_words bigint, anchors array<bigint>, drawn array<bigint>"))
    equal = settle(survey.groupBy("whole", "n_words").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = settle(survey.join(small(equal), ["whole", "n_words"]).where("doc_id <> first_doc").select("doc_id", "whole", "n_words", "first_doc"))
    # sorting copies again would only find them again
    own = survey.join(small(copies.select("doc_id")), "doc_id", "left_anti")
    anchors = own.select("doc_id", F.explode("anchors").alias("anchor"))
    # an anchor of one document that stands there twice is shared too
    shared = settle(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    marked = settle(anchors.join(small(shared), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    drawn = own.select(F.explode("drawn").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    total = own.agg(F.sum(F.size("drawn"))).first()[0] or 0
    rounds = len(_lengths(passage, base))
    hot = np.sort(np.array([r["pair"] for r in drawn.where(F.col("n") > max(total // rounds // HOT, 16)).select("pair").collect()], np.int64).view(_U))
    rows = docs.join(_small_lists(marked), "doc_id").select("doc_id", "text", "anchors")
    firsts = None
    if len(hot):
        found = rows.mapInArrow(_first_finder(passage, base, hot), "hot int, doc_id bigint, pos int").groupBy("hot").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
        firsts = settle(found.select("hot", F.col("at.doc_id").alias("first_doc"), F.col("at.pos").alias("first_pos")))
    flags = [f"hot{r}" for r in range(rounds)]
    ranked = rows.mapInArrow(_positions(passage, base, hot), "doc_id bigint, pos int, rank bigint, next bigint, " + ", ".join(f"{f} int" for f in flags))
    for r, offset in enumerate([*_offsets(passage, base)[1:], None]):
        named = _named(ranked, flags[r], firsts)
        if offset:
            ahead = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(offset, offset)
            ranks = named.select("doc_id", "pos", F.xxhash64("at_doc", "at_pos").alias("rank"), *flags[r + 1 :])
            ranked = ranks.withColumn("next", F.first("rank").over(ahead)).where("next is not null")
    again = named.where(~((F.col("doc_id") == F.col("at_doc")) & (F.col("pos") - F.col("at_pos") < passage)))
    along = Window.partitionBy("doc_id").orderBy("pos")
    islands = again.withColumn("gap", (F.col("pos") - F.coalesce(F.lag("pos").over(along), F.lit(-passage - 1)) > passage).cast("int"))
    islands = islands.withColumn("island", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = islands.groupBy("doc_id", "island").agg(F.min("pos").cast("bigint").alias("first_word"), (F.max("pos") + passage - F.min("pos")).cast("bigint").alias("n_words"), F.min("at_doc").alias("first_doc"))
    wholes = survey.select("doc_id", "whole")
    found = settle(stretches.join(wholes, "doc_id").select("doc_id", "whole", "first_word", "n_words", "first_doc"))
    earlier = found.groupBy(F.col("doc_id").alias("first_doc")).agg(F.min("first_doc").alias("before"))
    entire = copies.join(earlier, "first_doc", "left").select("doc_id", "whole", F.lit(0).cast("bigint").alias("first_word"), "n_words", F.least("first_doc", "before").alias("first_doc"))
    return found.unionByName(entire)


def _named(ranked: DataFrame, flag: str, firsts: DataFrame | None) -> DataFrame:
    """The positions whose pair of ranks isn't unique, with the first position of their class (at_doc, at_pos). Those of a hot class are sorted in shares, and have it given."""
    salt = F.when(F.col(flag) >= 0, F.pmod(F.hash("doc_id"), F.lit(SHARES))).otherwise(0)
    pair = Window.partitionBy("rank", "next", "salt")
    order = pair.orderBy("doc_id", "pos")
    named = ranked.withColumn("salt", salt).withColumns({"at_doc": F.first("doc_id").over(order), "at_pos": F.first("pos").over(order), "n": F.count("*").over(pair)})
    named = named.where((F.col("n") > 1) | (F.col(flag) >= 0)).drop("n", "salt", "rank", "next")
    if firsts is None:
        return named
    # at most HOT rows for each length of runs
    given = named.join(F.broadcast(firsts.withColumnRenamed("hot", flag)), flag, "left")
    return given.withColumns({"at_doc": F.coalesce("first_doc", "at_doc"), "at_pos": F.coalesce("first_pos", "at_pos")}).drop("first_doc", "first_pos")


def _small_lists(marked: DataFrame) -> DataFrame:
    size = marked.agg(F.sum(F.lit(64) + 8 * F.size("anchors"))).first()[0] or 0
    return F.broadcast(marked) if size <= BROADCAST_BYTES else marked


def _cutter(columns: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column("text"))
                whole = _whole(words).view(np.int64)
                texts, empty = [], []
                for k, (text, spans) in enumerate(zip(part.column("text").to_pylist(), part.column("spans").to_pylist())):
                    a, b = words.offsets[k], words.offsets[k + 1]
                    kept, at, gone = [], 0, 0
                    for s in sorted((x for x in spans or () if b > a and x["whole"] == whole[k]), key=lambda x: x["first_word"]):
                        begin, end = int(words.starts[a + s["first_word"]]), a + s["first_word"] + s["n_words"]
                        kept.append(text[at:begin])
                        at = int(words.starts[end]) if end < b else len(text)
                        gone += s["n_words"]
                    texts.append(text if not at else "".join([*kept, text[at:]]))
                    empty.append(bool(gone) and gone >= b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(empty)], names=[*columns, "text", "emptied"])

    return cut


def drop_repeats(docs: DataFrame, passage: int = 50, base: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without their repeated stretches of words; a document of which nothing else remains goes.

    A stretch goes with the characters up to the next word that stays. All
    other rows stay as they are, with null ids and texts too. Of rows that
    share a doc_id, those with the least text are cut. Very long texts are cut
    whole; an empty table stays empty; docs' other columns come back as they
    are, whatever their names.
    """
    spans = repeated_passages(docs, passage, base, id_column, text_column).groupBy("doc_id").agg(F.collect_list(F.struct("whole", "first_word", "n_words")).alias("spans"))
    spans = settle(spans)
    size = spans.agg(F.sum(F.lit(64) + 40 * F.size("spans"))).first()[0] or 0
    given = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    # what docs carries stands in one column of ours, so that no name of it can clash
    rest = [c for c in docs.columns if c != text_column]
    packed = docs.select(F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest))).alias("rest"), docs[f"`{text_column}`"].alias("text"), docs[f"`{id_column}`"].cast("bigint").alias("doc_id"))
    inner = packed.join(given, "doc_id", "left").select("rest", "text", "spans")
    kinds = {f.name: f.dataType for f in inner.schema.fields}
    done = inner.mapInArrow(_cutter(["rest"]), f"rest {kinds['rest'].simpleString()}, text string, emptied boolean").where("not emptied")
    place = {c: f"c{i}" for i, c in enumerate(rest)}
    return done.select(*(F.col("text").alias(c) if c == text_column else F.col("rest").getField(place[c]).alias(c) for c in docs.columns))
