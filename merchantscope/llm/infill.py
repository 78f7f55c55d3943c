"""Fill-in-the-middle rewriting with counted quantifiers.

``regexp_count`` gives the number n of units of a text; two cuts a <= b of 0..n are drawn
from a hash of the id, and a pattern made for the row - possessive groups of exactly a
and b - a units, then the rest - captures prefix, middle and suffix in one match, whose
replacement is the rewritten text. A possessive counted group neither backtracks nor
recurses, so a text of any length is matched in one pass.

Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm``
(suffix, prefix, middle), each part behind its marker. Texts that hold a marker stay
plain, so the markers of a rewritten text always tell its parts apart.

Row-local: no shuffle, no Python; hot keys have no meaning here.

Edge cases: a null text counts as empty; empty texts are plain with n = 0; a null id draws
as the text "null"; rows alike in id and text are rewritten alike; an empty table gives
an empty result; other columns are not touched, whatever they are called.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: A word with the white space before it, or the white space at the end of a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKERS = ("<P>", "<S>", "<M>")


def _check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must not overlap each other or themselves, else parts could run into them."""
    for x in markers:
        for y in markers:
            inside = x in y and x != y
            overlap = any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y))))
            if not x or inside or overlap or len(set(markers)) < 3:
                raise ValueError(f"markers {markers} cannot be told apart")


def _draw(id_: Column, seed: int, place: int) -> Column:
    """The place-th 32-bit number of an id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", seed: int = 42, rewritten: int = 50, suffix_first: int = 80,
    markers: tuple[str, str, str] = MARKERS, unit: str = UNIT,
) -> DataFrame:
    """doc_id, n (units), form, output and, where rewritten, prefix, middle and suffix (else null).

    ``rewritten`` percent of the texts are rewritten, ``suffix_first`` percent of those as spm.
    """
    _check_markers(markers)
    raw = docs.select(F.col(id_).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = F.lit(False)
    for mark in markers:
        held |= F.contains("text", F.lit(mark))
    key = F.col("doc_id")
    plain = (F.col("text") == "") | held | (_draw(key, seed, 3) % 100 >= rewritten)
    form = F.when(plain, "plain").when(_draw(key, seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    counted = raw.select("doc_id", "text", form.alias("form"), F.regexp_count("text", F.lit(unit)).cast("long").alias("n"))
    first, second = (_draw(key, seed, place) % (F.col("n") + 1) for place in (1, 2))
    cut = counted.select("*", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"))
    groups = [F.lit(rf"\A((?:{unit}){{"), F.col("a"), F.lit(rf"}}+)((?:{unit}){{"), F.col("b") - F.col("a"), F.lit(r"}+)((?s:.*))\z")]
    p, s, m = (re.sub(r"([\\$])", r"\\\1", mark) for mark in markers)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    matched = F.regexp_replace("text", F.concat(*groups), order)
    done = cut.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(matched).alias("output"))
    prefix, middle, suffix = parts_of(F.col("output"), F.col("form"), markers)
    return done.select("doc_id", "n", "form", "output", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))


def parts_of(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of a rewritten text; null for plain ones."""
    cut = F.split(output, "|".join(rf"\Q{mark}\E" for mark in markers), -1)
    spm, psm = form == "spm", form == "psm"
    prefix = F.when(spm, cut[2]).when(psm, cut[1])
    suffix = F.when(spm, cut[1]).when(psm, cut[2])
    return prefix, F.when(spm | psm, cut[3]), suffix


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` rewrote."""
    return F.when(form == "plain", output).otherwise(F.concat(*[parts_of(output, form, markers)[i] for i in (0, 1, 2)]))


def op11_counted_quantifier_infill(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(cast(doc_id AS VARCHAR), 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (
  SELECT doc_id, text, u, cast(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) AS BIGINT)) AS x FROM d),
c AS (
  SELECT doc_id, text, u, n, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain'
      WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
