"""Name search by an inverted index of trigrams.

The index holds (gram, id) for every three consecutive characters of a folded name. It is split into parts by id, each
sorted by gram, so that a search reads the pages of a few grams of each part and counts an id's grams where they lie
together. The pattern's literal runs give the grams that every match must contain; names that hold all of them are
candidates, and the regular expression decides. A pattern without such runs (alternatives, classes, short literals)
reads all names, as ``filters.name_search`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

#: The characters beyond ASCII that match an ASCII letter without regard to case, and that letter.
ALIKE = ("\u0130\u0131\u017f\u212a", "iisk")
NAMES = 150_000  # rows for a part of the index: the grams of as many names are sorted in a task's memory


def folded(c: Column) -> Column:
    """Both cases of a letter, and the letters that match it without regard to case, become one."""
    return F.lower(F.translate(c, *ALIKE))


def grams_of(text: Column) -> Column:
    """The distinct grams of a folded name. ``text`` should be a column of its own: every gram is cut from it, and an expression
    would be computed again for each."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))))


def build_index(staff: DataFrame, id_col: str = "employee_id", name_col: str = "name") -> DataFrame:
    """(gram, id) by part and gram, for storing beside the data set; rows without a name or an id have no entries.

    ``staff`` should be a stored table, as its rows are counted first. Names are shuffled by id, never the grams cut from them:
    an id's entries lie in one part. Most ids have one name, whose grams are distinct by themselves; only those of ids
    with several names are made distinct over rows."""
    parts = -(-staff.count() // NAMES) or 1
    texts = (staff.select(F.col(id_col).alias("id"), folded(F.col(name_col)).alias("text"))
             .where(F.col("id").isNotNull() & (F.length("text") >= 3)).repartition(parts, "id"))
    by_id = texts.groupBy("id").agg(F.min("text").alias("text"), F.max("text").alias("last"))
    grams = lambda df: df.select(F.explode(grams_of(F.col("text"))).alias("gram"), "id")
    several = texts.join(by_id.where("text <> last").select("id"), "id", "left_semi")
    pairs = grams(by_id.where("text = last")).unionByName(grams(several).distinct())
    return pairs.sortWithinPartitions("gram", "id")


def required_runs(pattern: str) -> list[str]:
    """Literal ASCII runs that every match of the pattern contains; none if that can't be told simply."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        literal, step = c, 1
        if c == "\\":
            nxt = pattern[i + 1:i + 2]
            if nxt.isalnum() or not nxt:  # a class, a boundary, a reference or a quotation
                return []
            literal, step = nxt, 2
        elif c in "|([{)]}":
            return []  # alternatives, groups and classes: every name is read
        elif c in ".^$?*+":
            runs.append(run)
            run, i = "", i + 1
            continue
        after = pattern[i + step:i + step + 1]
        if after and after in "?*{":  # the character may be missing
            if after == "{":
                return []
            runs.append(run)
            run = ""
        elif literal.isascii():
            run += literal
            if after == "+":
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
        i += step
    return [r for r in [*runs, run] if len(r) >= 3]


def required_grams(pattern: str) -> list[str]:
    return sorted({r.lower()[k:k + 3] for r in required_runs(pattern) for k in range(len(r) - 2)})


def search(staff: DataFrame, index: DataFrame, pattern: str, id_col: str = "employee_id") -> DataFrame:
    """``filters.name_search`` of rows with an id: candidates from the index, the pattern on those."""
    named = staff.where(F.col(id_col).isNotNull())
    grams = required_grams(pattern)
    if not grams:
        return filters.name_search(named, pattern)
    found = (index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n"))
             .where(F.col("n") == len(grams)).select(F.col("id").alias("__id")))
    return filters.name_search(named.join(found, F.col(id_col) == F.col("__id"), "left_semi"), pattern)
