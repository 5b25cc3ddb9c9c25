"""Prompts of many questions as a table: head, the excerpts that fit, question. Lengths are in UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.retrieval import budgeted

HEAD = """Below are excerpts of one code base. Each is labelled with its file and lines.

- Answer from the excerpts alone; there is no other evidence.
- If the answer is not in them, say that you do not know.
- Name file and lines for each claim.

EXCERPTS

"""
BEFORE, AFTER = "\nQUESTION\n\n", "\n\nAnswer from the excerpts alone, name file and lines, or say that you do not know.\n"
CUT = "\n[excerpt cut short]\n\n"
LEAST_ROOM, MOST = 200, 12_000


def units(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane are two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def cut_to(text: Column, most: Column) -> Column:
    """The longest beginning of at most so many UTF-16 units; no character is halved."""
    raw = F.encode(text, "UTF-16BE")
    last = F.hex(F.substring(raw, 2 * most - 1, F.lit(2)))
    halved = (units(text) > most) & last.between("D800", "DBFF")
    return F.decode(F.substring(raw, F.lit(1), 2 * (most - halved.cast("int"))), "UTF-16BE")


def prompts(questions: DataFrame, hits: DataFrame, by: str = "qid", most: int = MOST) -> DataFrame:
    """(by, prompt, excerpts, cut): a prompt for each question (by, question) from its hits (by, rank, file_path,
    start_line, end_line, content), best first while they fit.

    The first hit that doesn't fit ends the list; if it is the best, it is cut rather than left out, where more than a
    few of its characters fit. A question without hits has a prompt without excerpts; a hit without a text is skipped,
    and a question that is null counts as empty. What is gathered for a question is no longer than its prompt.
    """
    tail = F.concat(F.lit(BEFORE), F.coalesce("question", F.lit("")), F.lit(AFTER))
    asked = questions.select(by, tail.alias("tail")).withColumn("room", F.greatest(F.lit(0), most - units(F.lit(HEAD)) - units(F.col("tail"))))
    label = F.concat(F.lit("["), "file_path", F.lit(" lines "), "start_line", F.lit("-"), "end_line", F.lit("]\n"))
    sized = hits.where("content is not null").select(by, "rank", label.alias("label"), "content").join(asked.select(by, "room"), by)
    sized = sized.withColumn("block", F.concat("label", "content", F.lit("\n\n"))).withColumn("size", units(F.col("block")))
    whole = budgeted(sized, F.col("rank"), F.col("size"), F.col("room"), [by]).select(by, "rank", "block", F.lit(False).alias("cut"))
    left = F.col("room") - units(F.col("label")) - len(CUT)
    best = sized.groupBy(by).agg(F.min_by(F.struct("rank", "label", "content", "room", "size"), "rank").alias("b")).select(by, "b.*")
    short = best.where((F.col("size") > F.col("room")) & (left > LEAST_ROOM)).select(by, "rank", F.concat("label", cut_to(F.col("content"), left), F.lit(CUT)).alias("block"), F.lit(True).alias("cut"))
    body = whole.unionByName(short).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"), F.max("cut").alias("cut"))
    made = asked.join(body, by, "left")
    text = F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit(""))
    return made.select(by, F.concat(F.lit(HEAD), text, "tail").alias("prompt"), F.coalesce(F.size("b"), F.lit(0)).alias("excerpts"), F.coalesce("cut", F.lit(False)).alias("cut"))
