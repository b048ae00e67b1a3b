"""Passages that repeat across documents, by a sparse suffix array.

A passage is ``LENGTH`` or more consecutive words (``WORD``) that stand in two
or more different texts.  Only suffixes that begin at minimisers are kept: of
every ``WINDOW`` consecutive ``GRAM``-word grams the one with the least hash.
Equal passages select equal places, and every passage has one among its first
``WINDOW`` words, so at least ``PREFIX`` = LENGTH - WINDOW + 1 words of it follow.

1. Suffixes are range-sorted by the hash of their first ``PREFIX`` words; those
   whose prefix only one text has go.  Rows at the rim of a task are kept
   unseen, so no neighbour is missed.
2. The suffixes left get their context from their text, up to the words that a
   passage can reach: WINDOW - 1 to the left, LENGTH to the right.
3. They are range-sorted by prefix and right context (the suffix array) and
   neighbours are compared: the longest common prefix with a neighbour bounds
   how far any match can reach right.  Within that bound matches are extended
   left and right: a window of LENGTH words around the minimiser counts if
   another text of the same run has it too.  Range borders lie between runs of
   equal prefixes, so such a run is settled in one task.  Only runs of more than
   ``RUN_ROWS`` suffixes are cut, by their next words; a window of theirs that is
   still lone in its task, and whose right part reaches as far as the row at the
   task's rim does, is settled by one more group-by.
4. Overlapping windows of a text join into spans; texts of LENGTH or more words
   that several documents have are spans as a whole, and equal texts take part
   as one, so a group of copies costs no more than one text.

Sizes: a suffix is kept for about every 15 words and weighs 24 bytes; contexts
(about 240 bytes) exist for repeated prefixes only.  No group is gathered: a
run of more than ``RUN_ROWS`` suffixes is many tasks' work, and what they leave
open is at most the windows of its rows that no other text of the task has.

Every repeat of the length counts, common phrases, templates, near copies and
quoted benchmark items alike: a document that is clean otherwise is touched
where such a stretch stands in it.

Cases: null and short texts have no passage; a passage that repeats only within
one text is not reported; rows that repeat id and text are one document; null
ids take part, and a passage that only rows without an id share is reported for
them with a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stretches, mixed64, take, text_chunks, word_bounds, word_hashes, write_shared
from .mixing import words as n_words

LENGTH = 50
WINDOW = 30
GRAM = 8
PREFIX = LENGTH - WINDOW + 1
LEFT, RIGHT = WINDOW - 1, LENGTH - PREFIX  # context beyond the prefix
RUN_ROWS = 5_000
BUFFER_ROWS = 50_000
RUNS_BROADCAST = 100_000
NO_ID = (1 << 63) - 1  # stands for a null id
_ODD = np.uint64(0xD6E8FEB86659FD93)

def minimisers(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Word numbers (in the chunk) at which suffixes are kept."""
    n = np.bincount(row, minlength=rows)
    if not len(words) or n.max() < LENGTH:
        return np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    last_gram = np.repeat(first + n - GRAM, n)  # greatest first word of a gram, for each word
    at = np.arange(len(words))
    gram = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    ok = at <= last_gram
    gram[ok] = Stretches(words).of(at[ok], GRAM)
    # Least gram of each stretch of WINDOW grams: leftmost of equal ones, by doubling.
    best, width = at.copy(), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        other = best[np.minimum(at + step, len(words) - 1)]
        best = np.where(gram[other] < gram[best], other, best)
        width += step
    full = at + WINDOW - 1 <= last_gram  # the stretch lies within one text
    chosen = np.unique(best[full])
    # A passage needs PREFIX words from here on.
    return chosen[chosen + PREFIX <= np.repeat(first + n, n)[chosen]]


def suffixes(docs: DataFrame) -> DataFrame:
    """(h, dk, pos): prefix hash, text key and word number of every kept suffix."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            dk = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in text_chunks(b.column(0), 2 << 20):
                start, end, row = word_bounds(buf, offs)
                if not len(start):
                    continue
                w = word_hashes(buf, start, end)
                m = minimisers(w, row, j - i)
                if not len(m):
                    continue
                first = np.searchsorted(row, np.arange(j - i))
                h = Stretches(w).of(m, PREFIX)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(dk[i:j][row[m]]), pa.array((m - first[row[m]]).astype(np.int32))],
                    ["h", "dk", "pos"])

    return take(docs, "text").select("text", F.xxhash64("text").alias("dk")).mapInArrow(run, "h long, dk long, pos int")


def _repeated(frames):
    """Sorted (h, dk, pos) -> rows of runs of equal h with two texts or more, and
    the runs at either rim of the task; rows equal to the one before go."""
    carry, opening = None, True

    def settle(e: pd.DataFrame, rim_first: bool, rim_last: bool) -> pd.DataFrame:
        h, dk = e["h"].to_numpy(), e["dk"].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(begin, len(h)))
        mixed = np.minimum.reduceat(dk, begin) != np.maximum.reduceat(dk, begin)
        if rim_first:
            mixed[0] = True
        if rim_last:
            mixed[-1] = True
        return e.loc[np.repeat(mixed, size), ["dk", "pos"]]

    good = False  # the carried run is known to hold two texts
    for f in frames:
        if not len(f):
            continue
        e = f if carry is None else pd.concat([carry, f])
        same = e.eq(e.shift()).all(axis=1).to_numpy()
        e = e[~same]
        h = e["h"].to_numpy()
        tail = int(np.searchsorted(h, h[-1]))  # sorted by h: the last run
        if tail:
            yield settle(e.iloc[:tail], opening or good, False)
            opening, good = False, False
        carry = e.iloc[tail:]
        if len(carry) > 10_000:  # long run: hand on what need not wait
            known = opening or good or carry["dk"].iloc[0] != carry["dk"].iloc[-1]
            if known:
                good = good or not opening
                yield carry.iloc[:-1][["dk", "pos"]]
                carry = carry.iloc[-1:]
    if carry is not None and len(carry):
        yield settle(carry, True, True)


def contexts(docs: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, r, l, nr, nl, dk, pos, id): word hashes around the given places, taken
    from the first document of each text (``texts``: dk, id)."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            dk = b.column(1).to_numpy(zero_copy_only=False)
            ids, pos = b.column(2), b.column(3)
            for i, j, buf, offs in text_chunks(b.column(0), 2 << 20):
                start, end, row = word_bounds(buf, offs)
                if not len(start):
                    continue
                w = word_hashes(buf, start, end)
                n = np.bincount(row, minlength=j - i)
                first = np.cumsum(n) - n
                some = pos.slice(i, j - i)
                who = np.repeat(np.arange(j - i), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                p = some.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ok = p + PREFIX <= n[who]
                who, p = who[ok], p[ok]
                m = first[who] + p
                h = Stretches(w).of(m, PREFIX)
                small = np.append((w >> np.uint64(32)).astype(">u4"), np.zeros(1, ">u4"))
                right = m[:, None] + PREFIX + np.arange(RIGHT)
                left = m[:, None] - 1 - np.arange(LEFT)
                in_r, in_l = right < (first + n)[who][:, None], left >= first[who][:, None]
                # The number of words there are goes last, so that sorting is by words alone.
                r = small[np.where(in_r, right, len(w))]
                l = small[np.where(in_l, left, len(w))]  # noqa: E741
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), _fixed(r), _fixed(l), pa.array(in_r.sum(1).astype(np.int16)),
                     pa.array(in_l.sum(1).astype(np.int16)), pa.array(dk[i:j][who]), pa.array(p.astype(np.int32)),
                     ids.slice(i, j - i).take(pa.array(who))],
                    ["h", "r", "l", "nr", "nl", "dk", "pos", "id"])

    where = (places.groupBy("dk").agg(F.sort_array(F.collect_set("pos")).alias("pos")).join(texts, "dk")
             .withColumnRenamed("dk", "of"))
    src = take(docs, "doc_id", "text").withColumn("dk", F.xxhash64("text")).withColumn("doc", _id("doc_id"))
    # By text and id, so that a group of copies is not one task's.
    src = src.join(where, (F.col("dk") == F.col("of")) & (F.col("doc") == F.col("id"))).select("text", "dk", "id", "pos")
    return src.mapInArrow(run, "h long, r binary, l binary, nr short, nl short, dk long, pos int, id long")


def _id(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def _fixed(a: np.ndarray):
    import pyarrow as pa
    n, width = a.shape[0], a.shape[1] * 4
    offs = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(a))])


def _cumulated(a: np.ndarray) -> np.ndarray:
    """(n, k) word hashes -> (n, k + 1) hashes of the first 0..k of them."""
    out = np.zeros((a.shape[0], a.shape[1] + 1), np.uint64)
    for i in range(a.shape[1]):
        out[:, i + 1] = mixed64(out[:, i] * _ODD + a[:, i].astype(np.uint64) + np.uint64(i + 1))
    return out


def matches(e: pd.DataFrame, cut_first: bool = False, cut_last: bool = False) -> pd.DataFrame:
    """Suffixes in suffix-array order -> windows (settled, dk, a, b, key, other).

    Settled windows are in another text here too.  Where the first or last run
    goes on in another task (``cut_first``, ``cut_last``), its other windows may
    have a partner there.  Partners stand in order of their next words, so those
    of a row share with the row at the rim whatever they share with each other:
    windows that need more words than that cannot have one.  The rest stay open,
    and two texts that have a settled one speak for it.
    """
    n = len(e)
    h = e["h"].to_numpy().view(np.uint64)
    dk, pos, ident = e["dk"].to_numpy(), e["pos"].to_numpy().astype(np.int64), e["id"].to_numpy()
    r = np.frombuffer(b"".join(e["r"]), ">u4").reshape(n, RIGHT)
    l = np.frombuffer(b"".join(e["l"]), ">u4").reshape(n, LEFT)  # noqa: E741
    nr, nl = e["nr"].to_numpy(), e["nl"].to_numpy()
    # Common prefix with the next suffix; the longest on either side bounds any match.
    differ = r[1:] != r[:-1]
    lcp = np.where(h[1:] == h[:-1], np.where(differ.any(1), differ.argmax(1), RIGHT), -1)
    rim = np.full(n, -1)  # words that a partner beyond the rim can share
    if cut_first:
        rim = np.maximum(rim, np.minimum.accumulate(np.insert(lcp, 0, RIGHT)))
    if cut_last:
        rim = np.maximum(rim, np.minimum.accumulate(np.append(lcp, RIGHT)[::-1])[::-1])
    lcp = np.minimum(lcp, np.minimum(nr[1:], nr[:-1]))
    reach = np.maximum(np.append(lcp, -1), np.insert(lcp, 0, -1))
    rc, lc = _cumulated(r), _cumulated(l)
    out: list[tuple] = []  # settled, row, window, key, other

    def keys(rows: np.ndarray, w: int) -> np.ndarray:
        return mixed64(h[rows] + mixed64(lc[rows, w] * _ODD + rc[rows, RIGHT - w]) + np.uint64(w))

    for w in range(LEFT + 1):  # the window that begins w words before the minimiser
        need = RIGHT - w  # words beyond the prefix
        fits = (nl >= w) & (nr >= need)
        pick = np.flatnonzero(fits & (reach >= need))
        if len(pick):
            key = keys(pick, w)
            order = np.lexsort((dk[pick], key))
            key, pick = key[order], pick[order]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(begin[1:], len(key)) - 1
            size = last - begin + 1
            shared = dk[pick[begin]] != dk[pick[last]]
            two = np.repeat(shared, size)
            x = ident[pick]
            low, high = (np.repeat(f.reduceat(x, begin), size) for f in (np.minimum, np.maximum))
            other = np.where(low != x, low, high)
            out.append((True, pick[two], w, key[two], other[two]))
            lone = ~two & (rim[pick] >= need)
            ends = np.concatenate([begin[shared], last[shared]])
            ends = ends[rim[pick[ends]] >= need]
            for some in (np.flatnonzero(lone), ends):
                out.append((False, pick[some], w, key[some], x[some]))
        alone = np.flatnonzero(fits & (reach < need) & (rim >= need))
        if len(alone):
            out.append((False, alone, w, keys(alone, w), ident[alone]))
    out = [o for o in out if len(o[1])]
    if not out:
        return _nothing()
    rows = np.concatenate([o[1] for o in out])
    begin = pos[rows] - np.concatenate([np.full(len(o[1]), o[2]) for o in out])
    return pd.DataFrame({"settled": np.concatenate([np.full(len(o[1]), o[0]) for o in out]), "dk": dk[rows], "a": begin,
                         "b": begin + LENGTH, "key": np.concatenate([o[3] for o in out]).view(np.int64),
                         "other": np.concatenate([o[4] for o in out])})


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"settled": np.zeros(0, bool), **{c: np.zeros(0, np.int64) for c in ("dk", "a", "b", "key", "other")}})


_OUT = "settled boolean, dk long, a long, b long, key long, other long"


def _joined(got: pd.DataFrame) -> pd.DataFrame:
    """Settled windows of each text that overlap or touch as one; open ones as they are."""
    done, still = got[got["settled"]], got[~got["settled"]]
    if not len(done):
        return still
    done = done.sort_values(["dk", "a"], kind="stable")
    d, a, b = done["dk"].to_numpy(), done["a"].to_numpy(), done["b"].to_numpy()
    # All windows have one length, so in order of begin they end in order too.
    at = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (a[1:] > b[:-1]))))
    last = np.append(at[1:], len(d)) - 1
    joined = pd.DataFrame({"settled": True, "dk": d[at], "a": a[at], "b": b[last], "key": 0,
                           "other": np.minimum.reduceat(done["other"].to_numpy(), at)})
    return pd.concat([joined, still])


def _scan(buffer_rows: int):
    """Sorted suffixes (``cut``: their run may go on in another task) -> joined
    settled windows of each text, and what stays open."""
    def run(frames):
        held, rows, begun = [], 0, True  # the first run may have begun in the task before
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            rows += len(f)
            if rows < buffer_rows:
                continue
            e = pd.concat(held)
            h, cut = e["h"].to_numpy(), e["cut"].to_numpy()
            tail = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if tail:
                yield _joined(matches(e.iloc[:tail], begun and cut[0], False))
                held, rows, begun = [e.iloc[tail:]], len(e) - tail, False
            elif cut[0]:  # one run fills the buffer
                yield _joined(matches(e, True, True))
                held, rows, begun = [], 0, True
        if rows:
            e = pd.concat(held)
            cut = e["cut"].to_numpy()
            yield _joined(matches(e, begun and cut[0], cut[-1]))
    return run


def _windows(ctx: DataFrame, tasks: int) -> DataFrame:
    """Contexts -> ``_OUT``.  Rows are dealt by prefix alone, those of long runs by their next words too."""
    long = write_shared(ctx.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > RUN_ROWS).select(F.col("h").alias("of")), "long-runs")
    ids = F.broadcast(long) if long.count() <= RUNS_BROADCAST else long
    c = ctx.join(ids, F.col("h") == F.col("of"), "left").withColumn("cut", F.col("of").isNotNull()).drop("of")
    deal = [F.when(F.col("cut"), F.col(k)) for k in ("r", "dk", "pos")]
    c = c.repartitionByRange(tasks, "h", *deal).sortWithinPartitions("h", "r", "dk", "pos")
    return c.mapInPandas(_scan(BUFFER_ROWS), _OUT)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), other_id: spans of each document
    that stand in another text, and the smallest id of one met there."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = write_shared(take(docs, "doc_id", "text").select(
        _id("doc_id").alias("id"), F.xxhash64("text").alias("dk"), n_words(F.col("text")).alias("n")), "texts")
    texts = slim.groupBy("dk").agg(F.min("id").alias("id"), F.max("id").alias("i1"), F.max("n").alias("n"))
    found = write_shared(suffixes(docs).withColumn("row", F.monotonically_increasing_id()), "suffixes")
    order = ["h", "dk", "pos"]
    # Copies have equal rows: the row number lets them fall into several ranges.
    places = (found.repartitionByRange(tasks, *order, "row").drop("row").sortWithinPartitions(*order)
              .mapInPandas(_repeated, "dk long, pos int"))
    places = write_shared(places, "repeated-prefixes")
    ctx = write_shared(contexts(docs, places, texts.select("dk", "id")), "contexts")
    seen = write_shared(_windows(ctx, tasks), "windows")
    still = seen.filter("not settled").select("dk", "a", "b", "key", "other")
    both = (still.groupBy("key").agg(F.min("dk").alias("d0"), F.max("dk").alias("d1"), F.min("other").alias("i0"),
                                     F.max("other").alias("i1")).filter("d0 <> d1").select(F.col("key").alias("k"), "i0", "i1"))
    late = (still.join(both, F.col("key") == F.col("k"))
            .select("dk", "a", "b", F.when(F.col("i0") == F.col("other"), F.col("i1")).otherwise(F.col("i0")).alias("other")))
    copies = texts.filter((F.col("n") >= LENGTH) & (F.col("id") != F.col("i1")))
    whole = copies.select("dk", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.col("id").alias("other"))
    spans = seen.filter("settled").select("dk", "a", "b", "other").unionByName(late).unionByName(whole)
    # Join what overlaps or touches; a text's own windows are all that meet here.
    mine = Window.partitionBy("dk").orderBy("a", "b")
    before = mine.rowsBetween(Window.unboundedPreceding, -1)
    spans = (spans.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(before)).cast("int"), F.lit(1)))
             .withColumn("island", F.sum("new").over(mine)).groupBy("dk", "island")
             .agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("other").alias("other")))
    spans = write_shared(spans.join(copies.select("dk", F.col("id").alias("i0"), "i1"), "dk", "left")
                         .select(F.col("dk").alias("of"), "start_word", "end_word", "other", "i0", "i1"), "spans")
    out = slim.select("id", "dk").distinct().join(spans, F.col("dk") == F.col("of"))
    other = F.when(F.col("other") != F.col("id"), F.col("other")).when(F.col("i0") != F.col("id"), F.col("i0")).otherwise(F.col("i1"))
    return out.select(*[F.when(c != NO_ID, c).alias(n) for c, n in ((F.col("id"), "doc_id"),)], "start_word", "end_word",
                      F.when(other != NO_ID, other).alias("other_id"))
