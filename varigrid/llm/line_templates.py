"""Line deduplication by a log-template tree of fixed depth, in DataFrame functions alone.

A line's words with a digit become ``<*>``. The tree leads by the number of words and the first two words to a leaf. In a leaf, a word that
fewer than ``least`` documents have at its place, or a smaller share of the leaf's documents than ``usual``, is a variable field and becomes ``<*>``
as well; what remains is the line's template. A template recurs if it stands in ``least`` documents or more and at least ``fixed`` of its words are no
fields. Lines of recurring templates are dropped from every document but copies.

Documents count by their texts, so copies of a text count once. A group of near copies makes all its lines recur, though the group is one document told several times;
its texts are left whole for a later step to choose one. A text is a copy if lines of recurring templates make more than half of its words, and if lines that one
single other such text holds as well make more than ``same`` of them. That other text is sought line by line, as the one with the smallest digest, so each line names one text.

For the fields, a document counts once for each distinct line that has the word at the place. Leaves with too few documents are left out early: no line there can recur.
Before lines are shuffled with their words, a broadcast Bloom filter of bounded size drops most of those in such leaves; the exact join follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import SPACE, discard, store
from varigrid.llm.url_filter import ask, blocks_for, divide

FIELD = "<*>"
#: A longest run of characters other than the six of white space that holds a digit; it is tried once for each run.
_NUMBER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _normal(line: Column) -> Column:
    """The line's words, those with a digit as ``<*>``, with one space between them; patterns run only on lines that need them."""
    odd = reduce(Column.__or__, (F.contains(line, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")))
    plain = F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, _NUMBER, FIELD)).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line: id, fp, pos, n (words), leaf, h (hash of the masked words), line (the masked words)."""
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("fp"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line IS NOT NULL")
    rows = rows.select("id", "fp", "pos", _normal(F.col("line")).alias("line"))
    n = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return rows.select("id", "fp", "pos", n.alias("n"), F.xxhash64(n, F.substring_index("line", " ", 2)).alias("leaf"), F.xxhash64("line").alias("h"), "line")


def recurring(docs: DataFrame, least: int = 10, usual: float = 0.01, fixed: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """All lines (id, fp, pos, n, leaf, h), and the kinds of lines (leaf, h, template) whose template recurs."""
    lines = _lines(docs)
    found = store(lines.drop("line"), "lines")
    some = found.where("n > 0").select("leaf", "h", "fp").distinct()
    leaves = found.where("n > 0").select("leaf", "fp").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= least)
    kinds = store(some.join(leaves, "leaf").groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("c"), F.first("of").alias("of")), "kinds")
    worded = ask(lines.select("leaf", "h", "line"), "h", kinds, blocks_for(kinds.count())).where("possible").drop("possible")
    worded = worded.join(kinds, ["leaf", "h"]).groupBy("leaf", "h", "c", "of").agg(F.first("line").alias("line"))
    places = store(worded.select("leaf", "h", "c", "of", F.posexplode(F.split("line", " ")).alias("at", "word")), "places")
    often = places.groupBy("leaf", "at", "word").agg(F.sum("c").alias("s"), F.first("of").alias("of")).where((F.col("s") >= least) & (F.col("s") >= usual * F.col("of"))).select("leaf", "at", "word", F.lit(True).alias("usual"))
    field = F.when(F.col("usual") & (F.col("word") != FIELD), F.col("word")).otherwise(FIELD)
    made = places.join(often, ["leaf", "at", "word"], "left").groupBy("leaf", "h").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", field.alias("word")))), lambda x: x["word"]).alias("t"))
    firm = F.size(F.filter("t", lambda x: x != FIELD)) >= fixed * F.size("t")
    templates = store(made.where(firm).select("leaf", "h", F.array_join("t", " ").alias("template")), "templates")
    documents = some.join(templates, ["leaf", "h"]).select("leaf", "template", "fp").distinct().groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("documents"))
    out = store(templates.join(documents.where(F.col("documents") >= least), ["leaf", "template"]).select("leaf", "h", "template"), "recurring")
    discard(kinds, places, templates)
    return found, out


def _copies(docs: DataFrame, found: DataFrame, hits: DataFrame, same: float) -> DataFrame:
    """fp of the texts that are copies by their recurring lines (``hits``), with the texts that they are copies of."""
    share = hits.groupBy("fp").agg(F.sum("n").alias("hit")).join(found.groupBy("fp").agg(F.sum("n").alias("all")), "fp")
    mostly = store(share.where("2 * hit > all").select("fp"), "mostly")
    digests = docs.select(F.xxhash64("text").alias("fp"), "text").join(mostly, "fp", "left_semi").groupBy("fp").agg(F.min(F.md5("text")).alias("digest"))
    held = store(hits.select("fp", "pos", "leaf", "h", "n").distinct().join(digests, "fp"), "held")
    own = found.join(mostly, "fp", "left_semi").select("fp", "pos", "n").distinct().groupBy("fp").agg(F.sum("n").alias("own"))
    other = held.groupBy("leaf", "h").agg(F.min("digest").alias("other"))
    pairs = held.join(other, ["leaf", "h"]).where("digest <> other").select("digest", "other").distinct()
    y = held.select(F.col("digest").alias("other"), "leaf", "h")
    both = pairs.join(held, "digest").join(y, ["other", "leaf", "h"], "left_semi").groupBy("fp", "digest", "other").agg(F.sum("n").alias("both"))
    copies = both.join(own, "fp").where(F.col("both") > same * F.col("own")).select(F.explode(F.array("digest", "other")).alias("digest")).distinct()
    out = store(held.join(copies, "digest", "left_semi").select("fp").distinct(), "copies")
    discard(mostly, held)
    return out


def drop_recurring(docs: DataFrame, least: int = 10, usual: float = 0.01, fixed: float = 0.5, same: float = 0.5) -> DataFrame:
    """Documents without their lines of recurring templates: all columns of ``docs`` (doc_id, text), and n_lines, n_dropped.

    Lines are what ``\\n`` separates; words are runs of anything but ASCII white space; blank lines stay. A null text stays null with 0 lines; an
    empty one is one blank line; an empty table gives no rows. Rows that repeat a doc_id are handled each; tied and repeated lines all go or all
    stay. A very long text is a row for each of its lines. Columns of any name are carried along, but n_lines and n_dropped replace those of ``docs``.
    """
    found, gone = recurring(docs.select("doc_id", "text"), least, usual, fixed)
    hits = store(found.join(gone.select("leaf", "h"), ["leaf", "h"]), "hits")
    marks = hits.join(_copies(docs.select("text"), found, hits, same), "fp", "left_anti").groupBy("id", "fp").agg(F.collect_set("pos").alias("gone"))
    marks = store(marks.withColumn("key", F.xxhash64("id", "fp")), "marks")
    discard(found, gone, hits)
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("fp"))
    some, none = divide(rows.withColumn("key", F.xxhash64("id", "fp")), "key", marks)
    rows = some.join(marks.drop("key"), ["id", "fp"], "left").select("row", "gone").unionByName(none.select("row", F.lit(None).cast("array<int>").alias("gone")))
    rows = rows.withColumn("lines", F.split("row.text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by hashing, so a text's lines cost their number
    kept = F.array_join(F.transform(places, lambda i: F.col("lines")[i]), "\n")
    text = F.when(F.col("gone").isNotNull() & F.col("lines").isNotNull(), kept).otherwise(F.col("row.text"))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(F.col("lines").isNull() | F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in others), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
