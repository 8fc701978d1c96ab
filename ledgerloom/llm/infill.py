"""Fill-in-the-middle texts: one counted regular expression cuts a text into prefix, middle and suffix.

A unit is a word with the white space before it, or white space at the end of a text.
``regexp_count`` gives the number n of units; two numbers drawn from a hash of seed and id
give the cuts a <= b. A pattern made for the row, ``unit{a}``, ``unit{b - a}`` and the rest,
takes the three parts in a single match, and the replacement puts them in the new order:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is

All quantifiers are possessive: the regular expression engine then counts in a loop, without a
stack that grows with the text, and never tries a second division into units.

Texts with one of the markers stay plain, so markers of an output stand where they were set: no
marker begins inside another or at the seam of a text's end and a marker. Null text counts as
empty and is plain with no units; a null id is drawn as an id of no digits. Equal rows give equal
outputs. An empty table gives no rows. Everything is a projection of its row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import read

__all__ = ["infill", "restored", "op11", "ORACLE", "UNIT"]

SEED = 42
RATE = 50  # per cent of texts that are transformed
SPM_RATE = 80  # per cent of those with the suffix first
MARKERS = ("<P>", "<S>", "<M>")
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def infill(documents: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, markers=MARKERS) -> DataFrame:
    """Input columns and ``_n``, ``_form``, ``_output``, ``_prefix_chars``, ``_middle_chars``; ``_text`` is the text, never null."""
    p, s, m = markers
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = documents.withColumn("_text", text)
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(F.col("_text"), F.lit(marker))
    form = F.when((F.col("_text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"_n": F.regexp_count(F.col("_text"), F.lit(UNIT)).cast("long"), "_form": form})
    rows = rows.withColumns({"_x": h1 % (F.col("_n") + 1), "_y": h2 % (F.col("_n") + 1)})
    first, second = F.least("_x", "_y"), F.greatest("_x", "_y") - F.least("_x", "_y")
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), first.cast("string"), F.lit(rf"}}+)((?:{UNIT}){{"), second.cast("string"), F.lit("}+)(.*)"))
    # Neither parentheses nor dollar signs of other markers are special in a pattern or replacement here.
    order = F.when(F.col("_form") == "psm", F.lit(f"{p}$1{s}$3{m}$2")).otherwise(F.lit(f"{s}$3{p}$1{m}$2"))
    rows = rows.withColumn("_output", F.when(F.col("_form") == "plain", F.col("_text")).otherwise(F.regexp_replace(F.col("_text"), pattern, order)))
    at = {k: F.locate(k, F.col("_output")) for k in markers}
    rows = rows.withColumns({
        "_prefix_chars": F.when(F.col("_form") == "psm", at[s] - at[p] - len(p)).when(F.col("_form") == "spm", at[m] - at[p] - len(p)).cast("long"),
        "_middle_chars": F.when(F.col("_form") != "plain", F.char_length("_output") - at[m] - len(m) + 1).cast("long")})
    return rows.drop("_x", "_y")


def restored(output: Column, form: Column, markers=MARKERS) -> Column:
    """The text again, from an output and its form alone."""
    p, s, m = markers
    return F.when(form == "psm", F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)", "$1$3$2")).when(
        form == "spm", F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)", "$2$3$1")).otherwise(output)


def op11(spark, sf_dir: str) -> DataFrame:
    rows = infill(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"),
                       F.col("_middle_chars").alias("middle_chars"), F.sha2("_output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("_output"), F.col("_form")), 256).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, sha256('{SEED}:' || COALESCE(doc_id::VARCHAR, '')) AS h,
             regexp_extract_all(COALESCE(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
g AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
             WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
