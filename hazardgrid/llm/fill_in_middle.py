"""Fill-in-the-middle rearrangement by escaped marker injection, and back.

Two control characters are escaped out of the text, one of them is put after every line by
``regexp_replace``, and ``substring_index`` cuts the text at its ranks. All of it is built-in functions
of the text itself: nothing is shuffled, and no list of lines is made.

Nulls: a null text counts as empty, a null doc_id hashes as the empty string. Repeated rows and ties give
equal rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[^\n]*\n|[^\n]+"
#: What is put after each unit, and what escapes it.
CUT, ESCAPE = "\x01", "\x02"
# Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


def check_markers(markers: tuple[str, str, str]) -> None:
    """A marker's first character may stand nowhere else in the markers: then none can arise where a
    piece of text and a marker meet, and the first one found is the one that was put there."""
    heads = {m[:1] for m in markers}
    if "" in heads or len(set(markers)) < 3 or any(c in heads for m in markers for c in m[1:]) or any(a != b and b.startswith(a) for a in markers for b in markers):
        raise ValueError("markers must differ, and their first characters may stand nowhere else in them")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(CUT), F.lit(ESCAPE + "c"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "c"), F.lit(CUT)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text of an output of ``fill_in_middle`` and its form."""
    p, s, m = markers

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """The three pieces behind the markers: behind the first, the second and the middle's."""
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        tail = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(tail, m, 1)
        return one, two, F.substr(tail, F.length(two) + len(m) + 1)

    prefix, suffix, middle = between(p, s)
    suffix2, prefix2, middle2 = between(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n (lines of the text), form (plain, psm or
    spm), prefix_chars, middle_chars (code points; null if plain), output.

    Four numbers of the SHA-256 of ``seed:doc_id`` decide: the first two are places among the n + 1
    between lines, the smaller one ends the prefix, the larger one the middle; the third leaves
    100 - ``rate`` percent of the texts plain, the fourth makes ``spm`` percent of the others
    suffix-first. Texts that are empty or hold a marker stay plain.
    """
    check_markers(markers)
    p, s, m = markers
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(text), UNIT, "$0" + CUT))
    marked = F.col("marked")
    rows = rows.withColumn("n", (F.length(marked) - F.length(F.replace(marked, F.lit(CUT), F.lit("")))).cast("long"))
    rows = rows.withColumn("one", h[0] % (F.col("n") + 1)).withColumn("two", h[1] % (F.col("n") + 1))
    first, second = F.least("one", "two").cast("int"), F.greatest("one", "two").cast("int")
    whole = lambda piece: unescaped(F.replace(piece, F.lit(CUT), F.lit("")))
    # ranks from the right count the cut behind the last unit, too
    rows = rows.withColumn("head", F.call_function("substring_index", marked, F.lit(CUT), second))
    rows = rows.select(
        "doc_id", "text", "n", whole(F.call_function("substring_index", "head", F.lit(CUT), first)).alias("prefix"), whole(F.col("head")).alias("head"),
        whole(F.call_function("substring_index", marked, F.lit(CUT), (second - F.col("n") - 1).cast("int"))).alias("suffix"),
    )
    plain = (text == "") | F.contains(text, F.lit(p)) | F.contains(text, F.lit(s)) | F.contains(text, F.lit(m)) | (h[2] % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm"))
    rows = rows.withColumn("middle", F.substr("head", F.length("prefix") + 1))
    form, prefix, middle, suffix = F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix")
    output = F.when(form == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).when(form == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(text)
    chars = lambda piece: F.when(form != "plain", F.length(piece)).cast("long")
    return rows.select("doc_id", "n", "form", chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"), output.alias("output"))


def fill_in_middle_rows(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with hashes of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
