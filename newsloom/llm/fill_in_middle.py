"""Fill-in-the-middle: texts cut in three, the middle last, by rotations of blocks.

A text is scanned for line ends, marks are put in at the two cuts, and the
blocks they begin change places: two neighbouring blocks are exchanged by
reversing each of them and then both together.  The same rotation, seen from the
other side, undoes it, so the text comes back from the output and its form
alone.  All of it works on the bytes of one text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
# Of 100 texts, how many are rearranged, and how many of these start with the suffix.
RATE, SUFFIX_FIRST = 100, 50


def checked(marks: tuple[str, str, str]) -> tuple[bytes, bytes, bytes]:
    """The marks as bytes, if they can be told from any text without them.

    Each must start with a byte that none of them holds further on: then no
    mark can be read partly from a mark and partly from the text.
    """
    raw = tuple(m.encode() for m in marks)
    if len(set(raw)) < 3 or not all(raw) or any(m[0] in o[1:] for m in raw for o in raw):
        raise ValueError("marks must differ, and begin with a character found nowhere else in them")
    if any(o.startswith(m) for m in raw for o in raw if o != m):
        raise ValueError("no mark may begin another one")
    return raw


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the blocks ``[lo, mid)`` and ``[mid, hi)`` of ``buf`` by three reversals."""
    view = np.frombuffer(buf, np.uint8)
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        half = (b - a) // 2
        front, back = view[a:a + half], view[b - half:b]
        kept = front.copy()
        front[:] = back[::-1]
        back[:] = kept[::-1]


def line_ends(text: bytes) -> np.ndarray:
    """Where each line ends, its line feed included."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def characters(text: bytes, lo: int, hi: int) -> int:
    """Code points in a stretch of UTF-8."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8)[lo:hi] & 0xC0 != 0x80))


def arrange(text: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """``text`` with the middle, from ``first`` to ``second``, last."""
    prefix, suffix, middle = marks
    buf = bytearray(text)
    # back to front, so that the cuts still hold: prefix, middle, suffix, each behind its mark
    for at, mark in ((second, suffix), (first, middle), (0, prefix)):
        buf[at:at] = mark
    to_middle = len(prefix) + first
    to_suffix = second + len(prefix) + len(middle)
    rotate(buf, to_middle if form == "psm" else 0, to_suffix, len(buf))
    return bytes(buf)


def rebuild(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text ``arrange`` was given."""
    if form == "plain":
        return output
    prefix, suffix, middle = marks
    buf = bytearray(output)
    if form == "psm":
        rotate(buf, output.index(suffix), output.index(middle), len(buf))
    else:
        rotate(buf, 0, output.index(prefix), len(buf))
    for mark in (suffix, middle, prefix):
        at = buf.index(mark)
        del buf[at:at + len(mark)]
    return bytes(buf)


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the row's key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with ``(n, form, prefix_chars, middle_chars, output)``; columns of these names are replaced.

    ``n`` counts lines.  The cuts, and whether and how a text is rearranged,
    follow from ``doc_id`` and ``seed``, so a repeated task or row gives the
    same output.  Null and empty texts, and texts that hold a mark, are
    ``plain``: the output is the text (empty for null), both lengths are null.
    A null id draws like an empty one.
    """
    raw = checked(marks)

    @F.arrow_udf("struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: binary>")
    def arranged(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        ns, forms, befores, middles, outputs = [], [], [], [], []
        for text, *h in zip(texts, *(h.to_pylist() for h in (h1, h2, h3, h4))):
            text = text.as_py()
            ends = line_ends(text)
            n, form, before, between, output = len(ends), "plain", None, None, text
            if text and h[2] % 100 < rate and not any(m in text for m in raw):
                first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                form = "spm" if h[3] % 100 < suffix_first else "psm"
                before, between = characters(text, 0, first), characters(text, first, second)
                output = arrange(text, first, second, form, raw)
            for column, value in zip((ns, forms, befores, middles, outputs), (n, form, before, between, output)):
                column.append(value)
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip((ns, forms, befores, middles, outputs), kinds)],
                                          ["n", "form", "prefix_chars", "middle_chars", "output"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    done = docs.withColumn("__arranged", arranged(text, *_draws(F.col("doc_id"), seed)))
    return done.withColumns({c: F.col(f"__arranged.{c}") for c in ("n", "form", "prefix_chars", "middle_chars")}
                            | {"output": F.col("__arranged.output").cast("string")}).drop("__arranged")


def restore(docs: DataFrame, name: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs(output, form)`` with the texts before ``fill_in_middle`` in column ``name``; null outputs stay null."""
    raw = checked(marks)

    @F.arrow_udf("binary")
    def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array((rebuild(o.as_py(), f.as_py(), raw) if o.is_valid else None for o, f in zip(outputs, forms)), pa.binary())

    return docs.withColumn(name, rebuilt(F.col("output").cast("binary"), F.col("form")).cast("string"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, CAST('0x' || h[1:8] AS BIGINT) AS h1,
  CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(lines) AS BIGINT) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
  greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
  array_to_string(lines[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
