"""Operator 11, fill-in-middle transformation.

A text is decoded once to a UTF-32 numpy array of code points. Its *units* are runs of code points of one class: neighbouring classes are compared, ``flatnonzero`` of the
differences yields the boundaries, and two ranks of boundaries, chosen by a keyed hash of the record's key, part the text into prefix, middle and suffix. The three
slices of the array are encoded again and put in order around three marks: prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``).
With the unit ``char`` every code point is a class of its own, so each place between two code points is a boundary; ``word`` parts runs of white space from runs of other code points, ``line`` ends units after each line feed.

The choice depends only on ``seed``, the key and the text's number of units: h1 to h4 are the first four groups of eight digits of the hex SHA-256 of
``seed:key``. The prefix ends after min(h1 mod (n+1), h2 mod (n+1)) of n units, the middle after the larger; h3 and h4 choose the form. Reruns, lost executors and other partitionings agree.

A text that already holds a mark stays plain, since its output couldn't be told apart; an inserted mark can't be made ambiguous by its neighbours, as no mark ends
with what a mark begins with. :func:`restored` rebuilds the exact text from output and form alone, by DataFrame functions.

Cases: a null text is the empty text, an empty one is plain; a null key is spelled ``null``; a text of any length is one array of four bytes a code point, held while its
own row is worked on; repeated rows give equal outputs; an empty table gives an empty result; other columns are kept by :func:`transform`, those that have a name of its outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

UNITS = ("char", "word", "line")

OUTPUTS = "fim_output string, fim_form string, fim_units long, fim_prefix_chars long, fim_middle_chars long, fim_chars long"


def boundaries(points, unit: str = "char"):
    """Places (numpy, ascending, the text's two ends included) between the units of an array of code points."""
    import numpy as np

    if unit == "char":
        classes = np.arange(len(points))
    elif unit == "word":
        classes = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    elif unit == "line":
        classes = np.concatenate([[0], np.cumsum(points[:-1] == 0x0A)]) if len(points) else points
    else:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def choices(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits, from the key."""
    digits = sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str, key: str, *, unit: str = "char", seed: int = 1, rate: int = 90, spm: int = 20) -> tuple[str, str, int, int | None, int | None, int]:
    """(output, form, number of units, code points of the prefix, of the middle, of the text) of one text; ``rate`` and ``spm`` in percent."""
    import numpy as np

    raw = text.encode("utf-32-le")
    points = np.frombuffer(raw, np.uint32)
    places = boundaries(points, unit)
    n = len(places) - 1
    h1, h2, h3, h4 = choices(key, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return text, "plain", n, None, None, len(points)
    lo, hi = sorted((int(places[h1 % (n + 1)]), int(places[h2 % (n + 1)])))
    prefix, middle, suffix = (points[a:b].tobytes().decode("utf-32-le") for a, b in ((0, lo), (lo, hi), (hi, len(points))))
    p, s, m = MARKS
    if h4 % 100 < spm:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", "spm", n, lo, hi - lo, len(points)
    return f"{p}{prefix}{s}{suffix}{m}{middle}", "psm", n, lo, hi - lo, len(points)


def transform(docs: DataFrame, *, unit: str = "char", seed: int = 1, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with fim_output, fim_form, fim_units (long), fim_chars, fim_prefix_chars and fim_middle_chars (long, null if plain)."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    names = [x.split()[0] for x in OUTPUTS.split(", ")]
    kept = without(docs, text_col, *names)
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept.columns] or [F.lit(None).cast("int").alias("none")]).alias("doc"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("key"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        for batch in batches:
            rows = [transformed(t, k, unit=unit, seed=seed, rate=rate, spm=spm) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", *names])

    schema = boxed.select("doc").withColumns({n: F.lit(None).cast(x.split()[1]) for n, x in zip(names, OUTPUTS.split(", "), strict=True)}).schema
    out = boxed.mapInArrow(run, schema)
    return out.select(*[F.col(f"doc.`{c}`") for c in kept.columns], *names)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form."""
    p, s, m = MARKS
    at = lambda mark: F.instr(output, mark)
    between = lambda first, a, b: F.substring(output, a + len(first), b - a - len(first))
    rest = lambda a: F.substring(output, a + len(m), F.length(output))
    psm = F.concat(between(p, F.lit(1), at(s)), rest(at(m)), between(s, at(s), at(m)))
    spm = F.concat(between(p, at(p), at(m)), rest(at(m)), between(s, F.lit(1), at(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of transformed rows."""
    back = restored(F.col("fim_output"), F.col("fim_form"))
    return rows.select("doc_id", F.col("fim_chars").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of the query: cuts, forms and digests by string functions; restored_sha256 is that of the text, as the transformation is lossless."""
    part = lambda k: f"CAST('0x' || substr(hex, {8 * k + 1}, 8) AS BIGINT)"
    p, s, m = MARKS
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hex FROM documents),
    hashed AS (SELECT doc_id, t, n, {", ".join(f"{part(k)} AS h{k + 1}" for k in range(4))} FROM texts),
    cuts AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
    pieces AS (SELECT *, substr(t, 1, lo) AS prefix, substr(t, lo + 1, hi - lo) AS middle, substr(t, hi + 1) AS suffix FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM pieces"""
