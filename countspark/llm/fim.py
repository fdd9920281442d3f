"""Fill-in-the-middle: texts cut at two token boundaries and written with the middle last.

A token is a run of ASCII letters, or any other single character. Each text is an array of code points (UTF-32): a token
begins wherever a letter doesn't follow a letter, so the boundaries are the places at which neighbouring classes say so, and
the cut after k tokens is the k-th boundary. Two hashes of the row's id choose the numbers of tokens, two more the form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from countspark.llm.common import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN_OF_100, SPM_OF_100 = 10, 20  # of all texts that stay as they are; of the others that begin with the suffix
SEED = "1"


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(codes: np.ndarray) -> np.ndarray:
    """Where each token begins."""
    low = codes | np.uint32(32)
    letter = (low >= 97) & (low <= 122)
    begins = np.ones(len(codes), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def draws(row_id, seed: str = SEED) -> list[int]:
    """Four unsigned 32-bit numbers from the id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearranged(text: str, row_id, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of the prefix, of the middle, output)."""
    codes = codepoints(text)
    at = starts(codes)
    n = len(at)
    h1, h2, h3, h4 = draws(row_id, seed)
    if not n or any(m in text for m in MARKS) or h3 % 100 >= 100 - PLAIN_OF_100:
        return n, "plain", None, None, text
    bounds = np.append(at, len(codes))
    lo, hi = (int(x) for x in bounds[sorted((h1 % (n + 1), h2 % (n + 1)))])
    prefix, middle, suffix = (codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in ((0, lo), (lo, hi), (hi, len(codes))))
    if h4 % 100 < SPM_OF_100:
        return n, "spm", lo, hi - lo, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", lo, hi - lo, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output and its form come from. No mark is in a rearranged text, so each is where it was put."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row; prefix_chars and middle_chars are null where the form is plain.

    A null text counts as empty and stays plain; so do texts that hold a mark. Rows that share id and text, ties of the two
    cuts included, get the same result; a null id draws like an empty one. Very long texts cost time and memory by their length. Other columns,
    whatever their names, are not read, and an empty table gives no row.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rearranged(t.as_py() or "", i.as_py(), seed) for i, t in zip(batch.column(0), batch.column(1))]
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """The rows of transform() with the exact text in a column more; null where output or form is null."""
    ship(rows.sparkSession)
    out, form = rows.columns.index(output_col), rows.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((o.as_py(), f.as_py()) for o, f in zip(batch.column(out), batch.column(form)))
            texts = [None if o is None or f is None else restored(o, f) for o, f in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(to, StringType())]))
