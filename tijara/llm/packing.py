"""Best-fit packing of token pieces into sequences, bulk-synchronous.

Tokens: every document is encoded by a public tokenizer and gets one end id;
documents longer than ``cap`` are cut into pieces of ``cap`` ids.  Encoding
works word by word (white space always ends a token of that tokenizer), and
each worker remembers the ids of up to ``CACHE`` words.  Any other tokenizer
whose tokens end at white space and which ignores ASCII case will do.

Packing: a piece longer than half a sequence opens one.  The others are placed
in waves of falling length; in each wave the open gaps and the wave's pieces
go through two supersteps.

* Range sweep: pieces and gaps are range-sorted together by size, and every
  range is swept from its largest piece down; a piece takes its successor, the
  smallest gap of the range that holds it.  If pieces compete for a gap the
  one of higher rank (longer, then smaller number) gets it.  The shrunk gap
  returns to the sweep while it is long enough for the wave.
* Conflict round: pieces that lost, and all gaps still open for the wave, are
  dealt out evenly (by number) and swept again in order of rank; a piece for
  which no gap is left opens a sequence.

Gaps carry over to later waves, so shorter pieces fill what is left.  State is
(number, size) per open piece or gap, never a text; tasks hold about
``PER_TASK`` of them, and the number of tasks grows with the input.  The
number of supersteps depends on ``cap`` alone.

Cases: null and empty texts are one piece that holds the end id; repeated rows
are packed as often as they occur; null ids are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts, take, text_chunks, word_bounds, word_hashes, write_shared

CAP = 2048
END_ID = 0
CACHE = 200_000
LOT = 500  # letter runs encoded in one call
CHUNK = 2 << 20  # bytes of text encoded at a time
#: Marks that, behind a run of letters, are a token run of their own.
MARKS = b".,!?;:*#$%&()-"
PER_TASK = 20_000
SMALLEST_WAVE = 64


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Words(dict):
    """word (bytes) -> its number; a word is one or two units with known ids.

    A unit is a run of letters (ASCII in lower case), marks after such a run, or
    a word of any other kind as a whole: the tokenizer never joins across these
    and ignores case.  Letter runs are encoded many at a time, one space apart;
    their last id, and no other, ends a word.
    """

    def __init__(self, path: str | None):
        super().__init__()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path or tokenizer_path())
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.first = np.zeros(1 << 14, np.int64)  # units of every word; the second is -1 if there is none
        self.second = np.zeros(1 << 14, np.int64)
        self.units: dict[bytes, int] = {}
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.fresh: list[bytes] = []  # words met in this batch

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.fresh.append(word)
        return k

    def learn(self) -> None:
        """Units of the fresh words, and the ids of units not met before."""
        n, new = len(self.fresh), len(self.units)
        if not n:
            return
        stems = [w.rstrip(MARKS).lower() for w in self.fresh]
        texts = b"\n".join(stems).decode("utf-8", "replace")
        run = [t.isalpha() for t in texts.split("\n")]
        if not texts.isascii():  # lower case of some letters is more than letters
            run = [a and t.isalpha() for a, t in zip(run, texts.lower().split("\n"))]
        units = self.units
        first = [units.setdefault(s if a else w, len(units)) for w, s, a in zip(self.fresh, stems, run)]
        second = [units.setdefault(w[len(s):], len(units)) if a and len(s) < len(w) else -1
                  for w, s, a in zip(self.fresh, stems, run)]
        end = len(self)
        if end > len(self.first):
            more = np.zeros(max(end - len(self.first), len(self.first) // 2), np.int64)
            self.first, self.second = np.concatenate([self.first, more]), np.concatenate([self.second, more])
        self.first[end - n:end], self.second[end - n:end] = first, second
        if len(units) > len(self.begin):
            more = np.zeros(max(len(units) - len(self.begin), len(self.begin) // 2), np.int64)
            self.begin, self.length = np.concatenate([self.begin, more]), np.concatenate([self.length, more])
        letters, others = [], []
        for k, u in enumerate(itertools.islice(reversed(units), len(units) - new), start=1):
            t = u.decode("utf-8", "replace")
            (letters if t.isalpha() and t.lower().isalpha() else others).append((len(units) - k, t))
        for i in range(0, len(letters), LOT):
            self._runs(letters[i:i + LOT])
        if others:
            self._plain(others)

    def _store(self, units: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = self.used + len(ids)
        if n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat) // 2), np.uint32)])
        self.flat[self.used:n] = ids
        self.begin[units] = self.used + np.cumsum(lengths) - lengths
        self.length[units] = lengths
        self.used = n

    def _runs(self, lot: list[tuple[int, str]]) -> None:
        ids = np.array(self.tok.encode(" ".join(t for _, t in lot), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(lot) and ends[-1] == len(ids):
            self._store([k for k, _ in lot], ids, np.diff(ends, prepend=0))
        else:
            self._plain(lot)

    def _plain(self, lot: list[tuple[int, str]]) -> None:
        ids = [e.ids for e in self.tok.encode_batch_fast([t for _, t in lot], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._store([k for k, _ in lot], np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def trim(self) -> None:
        """Beyond ``CACHE`` words, forget the newest and the units only they have.

        The first CACHE words have at most 2 * CACHE units, which stay."""
        excess = len(self) - CACHE
        if excess > 0:
            for w in self.fresh[-excess:]:
                del self[w]
        excess = len(self.units) - 2 * CACHE
        if excess > 0:
            for u in list(itertools.islice(reversed(self.units), excess)):
                del self.units[u]
            stay = slice(0, 2 * CACHE)  # units of one batch are not stored in the order of their numbers
            self.used = int((self.begin[stay] + self.length[stay]).max())
        self.fresh = []

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid out in ``buf`` at ``offs``, each with its end id, and where each text's ids end."""
        docs = len(offs) - 1
        start, end, row = word_bounds(buf, offs)
        # One look-up for each different word of the chunk; equal 64-bit hashes stand for equal words.
        _, one, which = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
        data = buf.tobytes()
        words = [data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.learn()
        r = number[which]
        units = np.column_stack((self.first[r], self.second[r]))
        lens = np.where(units >= 0, self.length[units], 0)
        # Every text's words, then its end id.
        per_doc = np.bincount(row, weights=lens.sum(axis=1), minlength=docs).astype(np.int64) + 1
        ends = np.cumsum(per_doc)
        ids = np.full(int(ends[-1]) if docs else 0, END_ID, np.uint32)
        lens = lens.ravel()
        to = np.cumsum(lens) - lens + np.repeat(row, 2)  # an end id for every text before
        n = int(lens.sum())
        at = np.arange(n) - np.repeat(np.cumsum(lens) - lens, lens)
        ids[at + np.repeat(to, lens)] = self.flat[at + np.repeat(self.begin[units.ravel()], lens)]
        self.trim()
        return ids, ends


_encoders: dict[str | None, _Words] = {}


def encoder(path: str | None = None) -> _Words:
    if path not in _encoders:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = _Words(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, cap: int = CAP, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, on
    request, ids.  ``path``: of the tokenizer's file on the executors (None:
    the installed ``word_bpe_49k.json``)."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        import pyarrow as pa
        enc = encoder(path)
        for b in batches:
            doc = b.column(0)
            for i, j, buf, offs in text_chunks(b.column(1), CHUNK):
                ids, ends = enc.encode(buf, offs)
                n = np.diff(ends, prepend=0)
                pieces = -(-n // cap)
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (ends - n)[row] + piece * cap
                last = np.minimum(first + cap, ends[row])
                parts = [ids[x:y] for x, y in zip(first.tolist(), last.tolist())]
                cols = [doc.slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * cap),
                        pa.array(last - first), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    src = take(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.mapInArrow(run, fields)


# Rows of a superstep: kind 0 a piece without a place, 1 an open gap, 2 a placed piece.
STATE = "kind int, id long, size int, seq long, offset int"


def sweep(kind: np.ndarray, ident: np.ndarray, size: np.ndarray, cap: int, low: int, opens: bool):
    """Best fit, longest piece first, into the smallest gap that holds it.

    Gaps that shrink to ``low`` or less are done for this wave.  Returns rows of ``STATE``.
    """
    stacks: dict[int, list[int]] = {}
    gaps = np.flatnonzero(kind == 1)
    for g, s in zip(ident[gaps].tolist(), size[gaps].tolist()):
        stacks.setdefault(s, []).append(g)
    for v in stacks.values():
        v.sort(reverse=True)  # the smallest number first out
    sizes = sorted(stacks)
    pieces = np.flatnonzero(kind == 0)
    pieces = pieces[np.lexsort((ident[pieces], -size[pieces]))]
    out: list[tuple[int, int, int, int, int]] = []
    for p, n in zip(ident[pieces].tolist(), size[pieces].tolist()):
        k = bisect_left(sizes, n)
        if k < len(sizes):
            gap = sizes[k]
            seq = stacks[gap].pop()
            if not stacks[gap]:
                del stacks[gap], sizes[k]
        elif opens:
            gap, seq = cap, p
        else:
            out.append((0, p, n, -1, -1))
            continue
        out.append((2, p, n, seq, cap - gap))
        rest = gap - n
        if rest > low:
            if rest not in stacks:
                stacks[rest] = []
                insort(sizes, rest)
            stacks[rest].append(seq)
        elif rest:
            out.append((1, seq, rest, -1, -1))
    out.extend((1, seq, s, -1, -1) for s, v in stacks.items() for seq in v)
    return out


def _superstep(events: DataFrame, cap: int, low: int, opens: bool, label: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        e = pd.concat(got)
        rows = sweep(e["kind"].to_numpy(), e["id"].to_numpy(), e["size"].to_numpy(), cap, low, opens)
        yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 5), columns=["kind", "id", "size", "seq", "offset"])

    return write_shared(events.mapInPandas(run, STATE), label)


def pack(pieces: DataFrame, cap: int = CAP, per_task: int = PER_TASK) -> DataFrame:
    """``pieces``: uid (unique long), length in 1..cap, in a written table.
    Returns uid, sequence_id, offset; no sequence is longer than ``cap``."""
    p = pieces.select(F.col("uid").alias("id"), F.col("length").cast("int").alias("size"))
    placed = p.filter(F.col("size") > cap // 2).select("id", F.col("id").alias("seq"), F.lit(0).alias("offset"))
    gaps = p.filter((F.col("size") > cap // 2) & (F.col("size") < cap)).select(
        F.lit(1).alias("kind"), "id", (F.lit(cap) - F.col("size")).alias("size"))
    tasks = n_parts(p.filter(F.col("size") < cap).count(), per_task)
    high = cap // 2
    while high > 0:
        low = high // 2 if high // 2 >= SMALLEST_WAVE else 0
        wave = p.filter((F.col("size") > low) & (F.col("size") <= high)).select(F.lit(0).alias("kind"), "id", "size")
        fits, short = F.col("size") > low, F.col("size") <= low
        events = wave.unionByName(gaps.filter(fits))
        spread = F.xxhash64("id")  # pieces and gaps of one frequent size go to several tasks together
        one = _superstep(events.repartitionByRange(tasks, F.col("size").desc(), spread), cap, low, False, f"sweep-{high}")
        done = one.filter("kind = 1").filter(short).select("kind", "id", "size")
        again = one.filter((F.col("kind") == 0) | ((F.col("kind") == 1) & fits)).select("kind", "id", "size")
        two = _superstep(again.repartition(tasks, "id"), cap, low, True, f"conflict-{high}")
        gaps = gaps.filter(short).unionByName(done).unionByName(two.filter("kind = 1").select("kind", "id", "size"))
        for step in (one, two):
            placed = placed.unionByName(step.filter("kind = 2").select("id", "seq", "offset"))
        high = low
    return placed.select(F.col("id").alias("uid"), F.col("seq").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, cap: int = CAP, path: str | None = None, keep_ids: bool = False,
                   per_task: int = PER_TASK) -> DataFrame:
    """All pieces of ``docs`` with the sequence and the place in it."""
    pieces = write_shared(token_pieces(docs, cap, path, keep_ids).withColumn("uid", F.monotonically_increasing_id()),
                          "pieces")
    return pieces.join(pack(pieces, cap, per_task), "uid").drop("uid").withColumn("offset", F.col("offset").cast("long"))
