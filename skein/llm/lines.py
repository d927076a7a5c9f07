"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites; it goes out of every text. The spread of a
line is measured by a HyperLogLog sketch of the sites of all its occurrences, one for each line hash, made by one
aggregation: partial sketches merge before the shuffle. Where the estimate is within ``margin`` of the threshold, the
distinct sites are counted exactly.

Copies of a document carry their lines to other sites, too. Where copies are to be judged later, by document dedup,
``independent`` asks in addition that a line stands in ``min_sites`` independent texts. A text is independent if other
texts have half of its runs of three words at most, by a sample of its ``SKETCH`` smallest hashes of runs. Exact copies
thus tell as one text and near copies not at all; nor do they speak against a line that other texts show to be
boilerplate.

Only 64-bit hashes of lines travel: the lines' text is read again in the last pass, where each document gets the list of
its positions to remove. Skew: every aggregation is partial before its shuffle, so a line that stands in a third of all
rows is one row a task by then; the joins are plain ones against the list of boilerplate, which adaptive execution
splits, or on documents' keys.

Defined results: a null text stays null with 0 lines; lines are divided by line feeds and compared without blanks, tabs
and carriage returns at their ends, empty lines are never removed; a null site is no site; repeated rows each get the
same result, and rows with one id but different texts are told apart; columns of any other names come back as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, narrow

#: log2 of the registers of a sketch: a standard error of about 1.6 %.
LOG_K = 12
#: Runs of words in the sample of a text.
SKETCH = 32


def _lines(source: DataFrame) -> DataFrame:
    """id, digest (of the text), site, at, line (hash); without empty lines."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    arrays = source.where("text is not null").select("id", F.sha2("text", 256).alias("digest"), "site", trimmed.alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.when(x != "", F.xxhash64(x)).alias("line")))
    return arrays.select("id", "digest", "site", F.inline(each)).where("line is not null")


def spread_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, margin: float = 0.1) -> DataFrame:
    """``line``: the hashes of the lines on ``min_sites`` sites."""
    lines = _lines(narrow(df, id=id_col, text=text_col, site=site_col).where("site is not null")).select("line", "site")
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("spread"))
    spread = materialise(spread.where(F.col("spread") >= min_sites * (1 - margin)), "spread")
    sure = spread.where(F.col("spread") > min_sites * (1 + margin)).select("line")
    near = spread.where(F.col("spread") <= min_sites * (1 + margin)).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return sure.unionAll(exact)


def _independent(source: DataFrame) -> DataFrame:
    """``text``: the hashes of the texts that do not consist of runs of words of other texts for the greater part."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    runs = F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    texts = source.where("text is not null").select(F.xxhash64(F.sha2("text", 256)).alias("text"), words.alias("words"))
    sketches = texts.select("text", F.slice(F.array_sort(F.array_distinct(runs)), 1, SKETCH).alias("runs"))
    each = materialise(sketches.groupBy("text").agg(F.any_value("runs").alias("runs")), "sketches").select("text", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    ends = each.groupBy("run").agg(F.min("text").alias("first"), F.max("text").alias("last"))
    own = each.join(ends.where("first = last").select("run"), "run", "left_semi")
    return own.groupBy("text", "n").count().where(F.col("count") * 2 >= F.col("n")).select("text")


def independent_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, margin: float = 0.1) -> DataFrame:
    """``line``: the hashes of the lines on ``min_sites`` sites and in as many independent texts."""
    source = narrow(df, id=id_col, text=text_col, site=site_col).where("site is not null")
    wide = materialise(spread_lines(source, id_col="id", text_col="text", site_col="site", min_sites=min_sites, margin=margin), "wide-lines")
    hits = _lines(source).join(wide, "line", "left_semi").select(F.xxhash64("digest").alias("text"), "line").distinct()
    told = hits.join(_independent(source), "text", "left_semi")
    return told.groupBy("line").count().where(F.col("count") >= min_sites).select("line")


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, margin: float = 0.1, independent: bool = False) -> DataFrame:
    """``df`` with the boilerplate taken out of the text column, and two more columns: ``n_lines`` and
    ``n_removed`` (columns of these names are replaced). Every row stays, also where no line does."""
    df = df.drop("n_lines", "n_removed")
    columns = {"id_col": id_col, "text_col": text_col, "site_col": site_col, "min_sites": min_sites, "margin": margin}
    remove = materialise(independent_lines(df, **columns) if independent else spread_lines(df, **columns), "boilerplate")
    hits = _lines(narrow(df, id=id_col, text=text_col, site=site_col)).join(remove, "line", "left_semi")
    marks = hits.groupBy("id", "digest").agg(F.collect_set("at").alias("marks"))
    # the caller's columns travel inside one, where no name can clash
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("of"), F.sha2(F.col(f"`{text_col}`"), 256).alias("key"))
    joined = whole.join(marks, F.col("of").eqNullSafe(F.col("id")) & (F.col("key") == F.col("digest")), "left")
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("marks"), i)), "\n")
    columns = [(F.when(F.col("marks").isNull(), text).otherwise(kept) if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*columns, n_lines.alias("n_lines"), F.when(F.col("marks").isNull(), 0).otherwise(F.size("marks")).cast("long").alias("n_removed"))
