"""Fill-in-the-middle rewriting of documents, with exact restoration.

A text is cut at two units into prefix, middle and suffix, which are written
with sentinels in PSM or SPM order.  Units are lines (a line keeps its break)
or characters.  Cut points come from a keyed hash of the id, so a rerun on any
number of executors cuts alike.

Cuts at lines are known in bytes and wanted in code points; cuts at characters
are drawn in code points and needed in bytes.  :class:`ExceptionIndex` converts
both ways: it records the multi-byte characters of a chunk of texts only (their
byte position and the running excess of bytes over characters), and one
``searchsorted`` finds the excess before a cut.  Everywhere else a byte is a
character and the cut is arithmetic, so an ASCII text has an empty index.

One pass, no shuffle: every row is rewritten in the task that reads it, in
chunks of whole texts of a few megabytes (a longer text is a chunk of its own).

Cases: a null text counts as empty; an empty text, one that holds a sentinel,
and one that the ``rate`` leaves out stay plain (output is the text; cuts are
null); a null id is hashed as empty; rows that repeat an id are cut by the same
numbers; an empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import take, text_chunks

SEED = "7"
RATE = 100  # texts in a hundred that are rewritten
SPM = 50  # of those, texts in a hundred in SPM order
PRE, SUF, MID = "<P>", "<S>", "<M>"
UNITS = ("line", "char")

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Positions and excess bytes of the multi-byte characters of a UTF-8 buffer."""

    def __init__(self, buf: np.ndarray):
        self.at = np.flatnonzero(buf >= 0xC0)  # lead bytes
        lead = buf[self.at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate((np.zeros(1, np.int64), np.cumsum(extra)))
        self.at_char = self.at - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before a byte at which a character begins."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Byte at which a code point begins."""
        return char + self.excess[np.searchsorted(self.at_char, char)]


def line_ends(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends of all lines, and for each row its first line and its number
    of lines; a row's last line need not end in a break."""
    ends = np.flatnonzero(buf == 10) + 1
    lo, hi = offs[:-1], offs[1:]
    full = hi[hi > lo]
    ends = np.unique(np.concatenate((ends, full[buf[full - 1] != 10]))) if len(full) else ends
    first = np.searchsorted(ends, lo, side="right")
    return ends, first, np.searchsorted(ends, hi, side="right") - first


def cuts(buf: np.ndarray, offs: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str):
    """(units, first cut, second cut, characters before each) for every row;
    cuts are bytes of ``buf``."""
    index = ExceptionIndex(buf)
    begin = index.chars(offs)
    if unit == "line":
        ends, first, n = line_ends(buf, offs)
        # Unit k of a row ends at ends[first + k - 1]; 0 units end where the row begins.
        where = np.concatenate((ends, np.zeros(1, np.int64)))

        def place(k):
            return np.where(k > 0, where[np.maximum(first + k - 1, 0)], offs[:-1])
    else:
        n = np.diff(begin)

        def place(k):
            return index.bytes(begin[:-1] + k)
    x, y = h1 % (n + 1), h2 % (n + 1)
    a, b = place(np.minimum(x, y)), place(np.maximum(x, y))
    ca, cb = index.chars(a), index.chars(b)
    return n, a, b, ca - begin[:-1], cb - ca


def numbers(doc_id: Column, seed: str = SEED) -> list[Column]:
    """The four hash numbers of a document."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: str = SEED,
              sentinels: tuple[str, str, str] = (PRE, SUF, MID)) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars,
    output: one row for each row of ``docs``."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    if len(set(sentinels)) < 3 or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("sentinels must be three strings, none inside another")
    pre, suf, mid = (s.encode() for s in sentinels)

    def rewrite(batches):
        import pyarrow as pa
        for batch in batches:
            ids = batch.column(0)
            h = [batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)]
            for i, j, buf, offs in text_chunks(batch.column(1), 4 << 20):
                n, a, b, pc, mc = cuts(buf, offs, h[0][i:j], h[1][i:j], unit)
                raw = buf.tobytes()
                texts = [raw[s:e] for s, e in zip(offs[:-1], offs[1:])]
                plain = np.array([not t or pre in t or suf in t or mid in t for t in texts], bool)
                plain |= h[2][i:j] % 100 >= rate
                first_suffix = h[3][i:j] % 100 < spm
                out = []
                for k, t in enumerate(texts):
                    if not plain[k]:
                        s, e = int(a[k] - offs[k]), int(b[k] - offs[k])
                        p, m, rest = t[:s], t[s:e], t[e:]
                        t = suf + rest + pre + p + mid + m if first_suffix[k] else pre + p + suf + rest + mid + m
                    out.append(t)
                form = np.where(plain, "plain", np.where(first_suffix, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()),
                     pa.array(pc.astype(np.int64), mask=plain), pa.array(mc.astype(np.int64), mask=plain),
                     pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    src = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                              *numbers(F.col("doc_id"), seed))
    return src.mapInArrow(rewrite, OUT)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PRE, SUF, MID)) -> Column:
    """The text that an output was made from.  No part holds a sentinel, so each
    sentinel of a rewritten output stands there once."""
    pre, suf, mid = sentinels

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    tail = F.substring_index(output, mid, -1)
    psm = F.concat(between(pre, suf), tail, between(suf, mid))
    spm = F.concat(between(pre, mid), tail, between(suf, pre))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
