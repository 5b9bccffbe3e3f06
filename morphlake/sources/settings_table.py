"""Settings files as tables: physical lines in, the settings' tables and their errors out, all by joins and ordered aggregates.

A line that ends with a backslash goes on in the next one, ``$include name`` stands for the lines of that file, a comment
begins with #, and a line in brackets begins a section.  What is wrong becomes a row with its file and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.schema import GENDERS
from morphlake.storage import carried, numbered, stored

SECTIONS = ("noun_preferences", "stem_preferences", "adjective_template", "undeclinable_adjectives", "bin_errata", "bin_deletions")


def logical_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) with continued lines put together; line_no is that of the last of them."""
    n = numbered(lines.select("file", "line_no", "line"), ["file", "line_no"], "n").withColumn("_goes_on", F.rtrim("line").endswith("\\"))
    before = n.select((F.col("n") + 1).alias("n"), F.col("file").alias("_file"), F.col("_goes_on").alias("_open"))
    starts = n.join(before, "n", "left").withColumn("_start", F.when(~(F.coalesce("_open", F.lit(False)) & (F.col("file") == F.col("_file"))), F.col("n")))
    parts = carried(starts, "n", "_start", "_from")
    text = F.when(F.col("_goes_on"), F.regexp_replace(F.trim("line"), r"\\$", "")).when(F.col("_from") < F.col("n"), F.ltrim("line")).otherwise(F.col("line"))
    whole = parts.groupBy("file", "_from").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("_p"), F.max("line_no").alias("line_no"))
    return whole.select("file", "line_no", F.array_join(F.transform("_p", lambda x: x["t"]), "").alias("line"))


def resolved(lines: DataFrame, main: str) -> tuple[DataFrame, DataFrame]:
    """(n, file, line_no, line) of the main file with its includes in their places, and (file, line_no, message) of those that can't be read.

    Each round puts the files in the place of the include lines of the round before; names are relative to the including file.
    """
    every = stored(logical_lines(lines).withColumn("_name", F.when(F.lower("line").startswith("$include "), F.trim(F.substr("line", F.lit(10))))))
    folder = F.regexp_extract("file", "^(.*/)?", 0)
    every = every.withColumn("_target", F.concat(folder, "_name"))
    todo = every.where(F.col("file") == main).withColumns({"key": F.array("line_no"), "_path": F.array("file")})
    kept, errors = [], [every.sparkSession.createDataFrame([], "file string, line_no long, message string")]
    while True:
        todo = stored(todo)
        kept.append(todo.where("_target is null").select("key", "file", "line_no", "line"))
        includes = todo.where("_target is not null").select("key", F.col("_target").alias("_to"), "_path", F.col("file").alias("_of"), F.col("line_no").alias("_at"))
        if includes.isEmpty():
            break
        circle = F.array_contains("_path", F.col("_to"))
        known = every.select(F.col("file").alias("_to")).distinct().withColumn("_there", F.lit(True))
        checked = includes.join(known, "_to", "left")
        wrong = checked.where(circle | F.col("_there").isNull())
        errors.append(wrong.select(F.col("_of").alias("file"), F.col("_at").alias("line_no"), F.when(circle, F.concat(F.lit("a file includes itself: "), "_to")).otherwise(F.concat(F.lit("missing file "), "_to")).alias("message")))
        good = checked.where(~circle & F.col("_there")).select("key", "_to", "_path")
        todo = good.join(every, F.col("_to") == F.col("file")).select("file", "line_no", "line", "_target", F.concat("key", F.array("line_no")).alias("key"), F.concat("_path", F.array("file")).alias("_path"))
    out, wrong = kept[0], errors[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    for part in errors[1:]:
        wrong = wrong.unionByName(part)
    return numbered(out, ["key"], "n").drop("key"), wrong


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def settings_tables(lines: DataFrame, main: str) -> dict[str, DataFrame]:
    """The tables of the settings that begin in the file main, from lines (file, line_no, line).

    adjective_template (ending, mark, seq), stem_preferences (form, worse, better), noun_preferences (form, gender, score),
    bin_errata and bin_deletions (ord, ofl, hluti), and errors (file, line_no, message).  Of a form's stem preferences the
    first counts, of equal errata the last.  Scores of genders are given in the order of the lines: a new pair gets -2 and 2,
    a new gender 4 from the one that already has a score.  Lines with errors give nothing else.
    """
    rows, unread = resolved(lines, main)
    rows = rows.withColumn("line", F.trim(F.substring_index("line", "#", 1))).where("line <> ''")
    header = F.col("line").startswith("[") & F.col("line").endswith("]")
    rows = stored(carried(rows.withColumn("_header", F.when(header, F.lower(F.trim(F.substr("line", F.lit(2), F.length("line") - 2))))), "n", "_header", "section"))
    body = rows.where("_header is null").select("n", "file", "line_no", "section", "line")
    known = F.col("section").isin(*SECTIONS)
    place = ["file", "line_no"]
    wrong = [unread, rows.where(F.col("_header").isNotNull() & ~F.col("_header").isin(*SECTIONS)).select(*place, F.concat(F.lit("unknown section "), "_header").alias("message")), body.where("section is null").select(*place, F.lit("a line before any section").alias("message"))]
    body = body.where(known)

    def of(section: str, message: Column) -> DataFrame:
        """The right lines of a section; message is null for them."""
        mine = body.where(F.col("section") == section).withColumn("message", message)
        wrong.append(mine.where("message is not null").select(*place, "message"))
        return mine.where("message is null").drop("message")

    line = F.col("line")
    low = F.split(F.lower(line), "<", 2)
    left, right = _words(F.get(low, 0)), _words(F.coalesce(F.get(low, 1), F.lit("")))
    template = of("adjective_template", F.when(F.size(_words(line)) != 2, "an ending and a tag are expected"))
    template = numbered(template, ["n"], "_seq").select(F.get(_words(line), 0).alias("ending"), F.get(_words(line), 1).alias("mark"), (F.col("_seq") - 1).cast("int").alias("seq"))
    stems = of("stem_preferences", F.when((F.size(left) < 2) | (F.size(right) < 1), "a form, its worse lemmas, < and its better lemmas are expected"))
    stems = stems.select("n", *place, F.get(left, 0).alias("form"), F.slice(left, F.lit(2), F.size(left)).alias("worse"), right.alias("better"))
    first = stems.groupBy("form").agg(F.min("n").alias("_first"))
    stems = stored(stems.join(first, "form"))
    wrong.append(stems.where("n > _first").select(*place, F.concat(F.lit("a second preference for "), "form").alias("message")))
    genders = F.array(*[F.lit(g) for g in GENDERS])
    nouns = of("noun_preferences", F.when((F.size(left) != 2) | (F.size(right) != 1), "a form, a gender, < and a gender are expected").when(~F.array_contains(genders, F.get(left, 1)) | ~F.array_contains(genders, F.get(right, 0)), "a gender is expected"))
    pair = F.struct("n", F.array_position(genders, F.get(left, 1)).cast("int").alias("low"), F.array_position(genders, F.get(right, 0)).cast("int").alias("high"), *place)
    pairs = nouns.groupBy(F.get(left, 0).alias("form")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))

    def score(state: Column, x: Column) -> Column:
        worse, better = F.element_at(state["scores"], x["low"]), F.element_at(state["scores"], x["high"])
        both = worse.isNotNull() & better.isNotNull()
        low = F.when(worse.isNull() & better.isNull(), -2).when(worse.isNull(), better - 4).otherwise(worse)
        high = F.when(worse.isNull() & better.isNull(), 2).when(better.isNull(), worse + 4).otherwise(better)
        new = F.transform(state["scores"], lambda s, i: F.when(i + 1 == x["high"], high).when(i + 1 == x["low"], low).otherwise(s))
        return F.struct(F.when(both, state["scores"]).otherwise(new).alias("scores"), F.when(both, F.concat(state["wrong"], F.array(F.struct(x["file"].alias("file"), x["line_no"].alias("line_no"))))).otherwise(state["wrong"]).alias("wrong"))

    none = F.lit(None).cast("int")
    start = F.struct(F.array(none, none, none).alias("scores"), F.array().cast("array<struct<file:string,line_no:bigint>>").alias("wrong"))
    scored = stored(pairs.withColumn("s", F.aggregate("pairs", start, score)).select("form", "s.*"))
    wrong.append(scored.select("form", F.explode("wrong").alias("w")).select("w.*", F.concat(F.lit("both genders have a score: "), "form").alias("message")))
    nouns = scored.select("form", F.posexplode("scores").alias("_i", "score")).where("score is not null").select("form", F.get(genders, F.col("_i")).alias("gender"), "score")
    fields = _words(line)
    three = F.when(F.size(fields) != 3, "three fields are expected").when((F.get(fields, 1) != F.lower(F.get(fields, 1))) | (F.get(fields, 2) != F.lower(F.get(fields, 2))), "class and domain are in lower case")
    triple = [F.get(fields, i).alias(c) for i, c in enumerate(("ord", "ofl", "hluti"))]
    errata = of("bin_errata", three).select("n", *triple).groupBy("ord", "ofl").agg(F.max_by("hluti", "n").alias("hluti"))
    deletions = of("bin_deletions", three).select(*triple).distinct()
    errors = wrong[0]
    for part in wrong[1:]:
        errors = errors.unionByName(part)
    return {"adjective_template": template, "stem_preferences": stems.where("n = _first").select("form", "worse", "better"), "noun_preferences": nouns, "bin_errata": errata, "bin_deletions": deletions, "errors": errors.select("file", F.col("line_no").cast("long").alias("line_no"), "message")}
