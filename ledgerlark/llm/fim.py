"""Fill-in-the-middle: a text is cut in two places and its parts are put in another order.

Cuts are counted in code points, while texts are UTF-8 bytes. A text is stored as the maximal runs of
code points of one class, the class being the bytes that a code point takes, with the code points and
bytes before each run. A binary search finds the run that holds a cut, and as all code points of a run
are equally wide, its byte offset is arithmetic. ASCII texts are one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import bound_batches, documents_of, fresh, raw_texts

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are cut, and of a hundred that are cut so many have the suffix first.
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: Bytes of a text that are classified at once.
SLAB = 1 << 22

#: Bytes of a code point by its first byte; 0 marks a byte that begins none.
_WIDTH = np.zeros(256, np.uint8)
_WIDTH[:0x80], _WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 1, 2, 3, 4


class Runs(NamedTuple):
    """Maximal runs of equally wide code points: ``units`` and ``bytes`` before each, and of the whole
    text at the end; ``width`` of each."""

    units: np.ndarray
    bytes: np.ndarray
    width: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def offset(self, cut: int) -> int:
        """The byte at which code point ``cut`` begins, or the text ends."""
        run = int(np.searchsorted(self.units, cut, side="right")) - 1
        if run >= len(self.width):
            return int(self.bytes[-1])
        return int(self.bytes[run] + (cut - self.units[run]) * int(self.width[run]))


def class_runs(raw: bytes) -> Runs:
    """The runs of a UTF-8 text, classified SLAB bytes after another."""
    if raw.isascii():
        ends = np.unique([0, len(raw)])
        return Runs(ends, ends, np.ones(len(ends) - 1, np.uint8))
    units, places, widths, n, last = [], [], [], 0, 0
    for at in range(0, len(raw), SLAB):
        slab = _WIDTH[np.frombuffer(raw, np.uint8, min(SLAB, len(raw) - at), at)]
        begins = np.flatnonzero(slab)
        width = slab[begins]
        first = np.flatnonzero(np.diff(width, prepend=np.uint8(last)))
        units.append(first + n)
        places.append(begins[first] + at)
        widths.append(width[first])
        n += len(begins)
        last = width[-1] if len(width) else last
    return Runs(np.concatenate([*units, [n]]), np.concatenate([*places, [len(raw)]]), np.concatenate(widths))


def parted(raw: bytes, one: int, other: int) -> tuple[int, int, int, bytes, bytes, bytes]:
    """(code points of the text, of its prefix and middle, and the three parts). Both draws are taken
    modulo the number of places where a text can be cut."""
    runs = class_runs(raw)
    a, b = sorted((one % (runs.n + 1), other % (runs.n + 1)))
    i, j = runs.offset(a), runs.offset(b)
    return runs.n, a, b - a, raw[:i], raw[i:j], raw[j:]


def _transformer(marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)
    arrow = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    @F.arrow_udf("struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,output:string>")
    def transformed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, forms, ones, others in batches:
            counts, firsts, middles, outputs = [], [], [], []
            for raw, form, one, other in zip(raw_texts(texts), forms.to_pylist(), ones.to_pylist(), others.to_pylist(), strict=True):
                if form == "plain":
                    counts.append(class_runs(raw).n)
                    firsts.append(None)
                    middles.append(None)
                    outputs.append(raw)
                    continue
                n, a, b, prefix, middle, suffix = parted(raw, one, other)
                counts.append(n)
                firsts.append(a)
                middles.append(b)
                outputs.append(b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)))
            columns = [pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.StructArray.from_arrays(columns, fields=list(arrow))

    return transformed


def draw(key: Column, k: int, salt: str = "1") -> Column:
    """The k-th number (1 to 8) drawn for a key: eight hexadecimal digits of the SHA-256 of ``salt:key``.
    A null key is drawn for as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def transform(documents: DataFrame, *, key: str = "doc_id", text: str = "text", to: str = "fim", salt: str = "1", marks: tuple[str, str, str] = MARKS, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Add ``to`` to every row: ``form`` (plain, psm for prefix-suffix-middle, spm for suffix-prefix-
    middle), ``n``, ``prefix_chars``, ``middle_chars`` (code points) and ``output``.

    A text is left plain if it is null (it then is the empty text), empty or holds a mark, or if it is
    not drawn; cuts depend on key, salt and length only, so repeated rows are cut alike and a null key
    counts as the empty text. Other columns stay, but a column ``to`` is replaced. An empty table stays
    empty.
    """
    bound_batches(documents)
    (drawn,) = fresh(documents, "_drawn")
    value = F.coalesce(F.col(text), F.lit(""))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | value.contains(mark)
    h = [draw(F.col(key), k, salt) for k in (1, 2, 3, 4)]
    whole = (value == "") | marked | (h[2] % 100 >= cut_percent)
    form = F.when(whole, "plain").when(h[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    # The form is computed once, in a step of its own: it is both an argument and a result.
    df = documents.withColumn(drawn, F.struct(form.alias("form"), h[0].alias("one"), h[1].alias("other")))
    cut = _transformer(marks)(F.coalesce(F.col(text), F.lit("")), F.col(f"{drawn}.form"), F.col(f"{drawn}.one"), F.col(f"{drawn}.other"))
    (made,) = fresh(df, "_made")
    df = df.withColumn(made, cut)
    fields = [F.col(f"{made}.{c}").alias(c) for c in ("n", "prefix_chars", "middle_chars", "output")]
    return df.withColumn(to, F.struct(F.col(f"{drawn}.form").alias("form"), *fields)).drop(*{drawn, made} - {to})


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was transformed. Its parts hold no mark, and no mark overlaps another or itself, so
    each is found where it was put."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    psm = F.concat(between(p, s), F.substring_index(output, m, -1), between(s, m))
    spm = F.concat(between(p, m), F.substring_index(output, m, -1), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut and put together again; null texts count as empty ones."""
    made = transform(documents_of(spark, sf_dir, "doc_id", "text"))
    form, output = F.col("fim.form"), F.col("fim.output")
    return made.select(
        "doc_id",
        F.col("fim.n").alias("n"),
        form.alias("form"),
        F.col("fim.prefix_chars").alias("prefix_chars"),
        F.col("fim.middle_chars").alias("middle_chars"),
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(form, output), 256).alias("restored_sha256"),
    )


_MARKED = " OR ".join(f"contains(t, '{m}')" for m in MARKS)
OP11_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR {_MARKED} OR h3 % 100 >= {CUT_PERCENT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
